"""Connected components of a distributed edge list, and union-find for one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialize


class Forest:
    """Union-find with path halving; unions keep the edges that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.edges.append((i, j))
        return True


def _contract(df: DataFrame) -> DataFrame:
    """Replaces each partition's edges by a star forest with the same components."""
    import pyarrow as pa

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        a, b = t.column(0).to_numpy(), t.column(1).to_numpy()
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        f = Forest(len(ids))
        for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            f.union(i, j)
        root = np.array([f.find(i) for i in range(len(ids))])
        own = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["a", "b"])

    return df.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str, rounds: int = 40) -> DataFrame:
    """(v, root): root is the least id of v's component; vertices without an edge don't occur.

    edges: (a, b) of longs. Rounds of large-star and small-star steps, with each partition's
    edges contracted before every shuffle, until no round changes the edges.
    """
    cur = materialize(_contract(edges.select("a", "b").where("a <> b")).where("a > b").distinct(), name)
    for _ in range(rounds):
        # large star: every larger neighbour of u points to the least of u and its neighbours
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: u and its smaller neighbours point to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), F.col("a").alias("y"), "m")
        nxt = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("y").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        nxt = materialize(_contract(nxt).where("a > b").distinct(), name)
        # done when it is a star forest: no root is also a leaf, and each leaf has one root
        flaws = nxt.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a").unionByName(nxt.select(F.col("b").alias("a")).distinct().join(nxt.select("a").distinct(), "a", "left_semi"))
        cur = nxt
        if flaws.isEmpty():
            break
    else:
        raise RuntimeError(f"components of {name} did not settle in {rounds} rounds")
    roots = cur.select(F.col("b").alias("v")).distinct()
    return cur.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots.select("v", F.col("v").alias("root")))
