"""N-gram Jaccard join in metric space, exact.

1. Coarse regions. A link needs 0.8 of the union in common, so at least one of any floor(0.2 n) + 1 of a
   document's shingles; the rarest are taken, where rarity is counted over the part of
   the shingle space with the smallest hashes. Documents that share such a shingle are held against each other by sketches, the parities of
   their shingles by place, which differ in no more places than the sets have elements of one only; so no link is lost, and documents that share a
   phrase by chance don't chain up to regions that grow with the corpus. What passes makes, directly or over others, a coarse region.
2. In a region, documents chosen as pivots make Voronoi cells by Jaccard distance. A partner of a
   document of a cell lies, by the triangle inequality, within twice the radius of the cell's border
   and within the radius of the cell's reach, so only such boundary documents are replicated.
   Documents that are far from every pivot make a cell of their own. Cells are joined in the same way until they are
   small or pivots don't split them; then each set meets those with which it shares one of its rarest shingles. Regions too large for a task are split by the same rule across tasks.
3. Documents that are already connected are not compared again: what is returned is classes, not pairs.

Equal sets are one vertex. Null and empty texts have no shingles and no links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.llm.common import buffer_of, documents, materialize, mix, slices, spread, tidy, word_hashes, workers
from tideline.llm.components import Forest, components

WORDS, SIMILAR = 5, 80  # words in a shingle; links at SIMILAR / 100
#: Part of the shingle space over which rarity is counted.
SPACE = 0.3
#: Elements of one task's share in the rarity count, and of shingles in one region that a task joins at once.
SHARE, REGION = 1_500_000, 1_500_000
PIVOTS = 16
#: Cells of so many sets are finished by the windows of one pivot; levels of cells within a region at most.
SMALL, DEEP = 48, 12
TIGHT = 0.8  # a cell with more of its region's rows than this is not split further
SPREAD = 1.5  # nor is a region whose cells, windows included, hold so many times its rows
#: Words of 64 bits in a sketch at most; sets of one shingle that are held against each other pair by pair at once; sets of one shingle from which on they are dealt by size; rows of a task that does so.
SKETCH, FEW, MANY, ROWS = 32, 16, 2000, 100_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document."""
    w, counts, _ = word_hashes(data, offsets)
    out, at = [], 0
    a = np.uint64(0xD6E8FEB86659FD93)
    if len(w) >= width:
        h = w[: len(w) - width + 1].copy()
        for k in range(1, width):
            h = h * a + w[k : len(w) - width + 1 + k]
        h = mix(h)
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(h[at : at + n - width + 1]))
        elif n:
            x = np.uint64(n)
            for v in w[at : at + n]:
                x = x * a + v
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def vertex(s: np.ndarray) -> int:
    """The id of a set: the same for equal sets; 0 if it is empty."""
    if not len(s):
        return 0
    x = np.array([int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))), int(np.add.reduce(s))], np.uint64)
    return int(mix(x * np.uint64(3) + x[::-1])[:1].view(np.int64)[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a set's elements by place: a bit for each element about, as a power of two, up to SKETCH words. One of half the length follows by adding its halves."""
    words = min(SKETCH, max(1, 1 << (-(-len(s) // 64) - 1).bit_length()))
    odd = np.bincount((mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def need(n: np.ndarray | int):
    """So many of a set's elements can't all be missing from a set that it links with."""
    return n - -(-n * SIMILAR // 100) + 1


def ends(heads: np.ndarray, n: int) -> np.ndarray:
    """Where the groups that begin at heads end."""
    return np.append(heads, n)[1:]


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * common >= SIMILAR * (a + b - common)


# ---------------------------------------------------------------- joining one region in memory


class Region:
    """Sets of one region, with union-find over them."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.heads = np.cumsum(self.n) - self.n
        self.forest = Forest(len(sets))
        self.found = {"pivots": 0, "windows": 0, "index": 0}  # uniting links by what found them

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.heads[i] : self.heads[i] + self.n[i]]

    def common(self, pivot: np.ndarray, own: np.ndarray, flat: np.ndarray, heads: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
        return np.add.reduceat((pivot[at] == flat).astype(np.int64), heads)

    def gather(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(own) == len(self.n):
            return self.flat, self.heads
        return np.concatenate([self.of(i) for i in own]), np.cumsum(self.n[own]) - self.n[own]

    def join(self, own: np.ndarray, depth: int = 0) -> None:
        """Unites all of own that links connect."""
        m = len(own)
        if m < 2 or len({self.forest.find(i) for i in own.tolist()}) == 1:
            return
        if m <= SMALL:
            return self.windows(own)
        flat, heads = self.gather(own)
        n = self.n[own]
        many = max(PIVOTS, int(m**0.5))
        step = max(1, m // many)
        pivots = own[np.argsort(n, kind="stable")][step // 2 :: step][:many]
        d = np.empty((m, len(pivots)))
        for k, p in enumerate(pivots.tolist()):
            c = self.common(self.of(p), own, flat, heads)
            d[:, k] = 1 - c / (n + self.n[p] - c)
            for i in own[linked(c, n, self.n[p])].tolist():
                self.found["pivots"] += self.forest.union(p, i)
        near = d.min(1)
        parts = cells(d, near)
        if depth > DEEP or sum(int(c.sum()) for c in parts) > SPREAD * m:
            return self.one_by_one(own)
        for cell in parts:
            if cell.mean() > TIGHT:
                self.one_by_one(own[cell])
            else:
                self.join(own[cell], depth + 1)

    def windows(self, own: np.ndarray) -> None:
        """A small cell: its sets in order of their distance to a pivot. Sets that link are no further apart in it than RADIUS, so each is held against those in the window behind it."""
        flat, heads = self.gather(own)
        n = self.n[own]
        p = int(own[np.argsort(n, kind="stable")[len(own) // 2]])
        c = self.common(self.of(p), own, flat, heads)
        d = 1 - c / (n + self.n[p] - c)
        for i in own[linked(c, n, self.n[p])].tolist():
            self.found["pivots"] += self.forest.union(p, i)
        order = np.argsort(d, kind="stable")
        own, n, d = own[order], n[order], d[order]
        reach = np.searchsorted(d, d + RADIUS + EPS, "right").tolist()
        rows, size = own.tolist(), n.tolist()
        for x in range(len(rows)):
            s = None
            for y in range(x + 1, reach[x]):
                a, b = size[x], size[y]
                if 100 * min(a, b) < SIMILAR * max(a, b) or self.forest.find(rows[x]) == self.forest.find(rows[y]):
                    continue
                s = self.of(rows[x]) if s is None else s
                t = self.of(rows[y])
                both = int((s[np.minimum(np.searchsorted(s, t), a - 1)] == t).sum())
                if 100 * both >= SIMILAR * (a + b - both):
                    self.found["windows"] += self.forest.union(rows[x], rows[y])

    def one_by_one(self, own: np.ndarray) -> None:
        """Compares every set outside the largest class with sets of other classes; then nothing can be missing.

        Few such sets are held against all; of many, each meets those with which it shares one of its shingles
        that are rarest in the cell, need(n) of them.
        """
        roots = np.array([self.forest.find(i) for i in own.tolist()])
        ids, size = np.unique(roots, return_counts=True)
        if len(ids) == 1:
            return
        rest = np.flatnonzero(roots != ids[size.argmax()])
        flat, heads = self.gather(own)
        n = self.n[own]
        if len(rest) <= 48 and len(own) > 48:
            for i in own[rest].tolist():
                c = self.common(self.of(i), own, flat, heads)
                for j in own[linked(c, n, self.n[i])].tolist():
                    self.found["index"] += self.forest.union(i, j)
            return
        doc = np.repeat(np.arange(len(own)), n)
        _, at, df = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.lexsort((at, df[at], doc))
        first = np.arange(len(flat)) - np.repeat(heads, n) < np.repeat(need(n), n)
        keys, docs = at[order][first], doc[order][first]
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        cut = np.searchsorted(keys, np.arange(len(df) + 1))
        prefix = np.argsort(docs, kind="stable")
        begin = np.searchsorted(docs[prefix], np.arange(len(own) + 1))
        for x in rest.tolist():
            mine = keys[prefix[begin[x] : begin[x + 1]]]
            near = np.unique(np.concatenate([docs[cut[k] : cut[k + 1]] for k in mine.tolist()]))
            near = near[100 * np.minimum(n[near], n[x]) >= SIMILAR * np.maximum(n[near], n[x])]
            i, k = int(own[x]), int(n[x])
            s = None
            for j, m in zip(own[near].tolist(), n[near].tolist(), strict=True):
                if self.forest.find(i) != self.forest.find(j):
                    s = self.of(i) if s is None else s
                    t = self.of(j)
                    c = int((s[np.minimum(np.searchsorted(s, t), k - 1)] == t).sum())
                    if 100 * c >= SIMILAR * (m + k - c):
                        self.found["index"] += self.forest.union(i, j)


RADIUS = 1 - SIMILAR / 100
EPS = 1e-9


def cells(d: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
    """Masks of the cells of a distance matrix [documents, pivots], windows included: any two documents within RADIUS of each other share a cell in which one is at home."""
    home = d.argmin(1)
    far = near > 1 - RADIUS + EPS  # can't be told apart by the pivots
    out = []
    for k in range(d.shape[1]):
        own = (home == k) & ~far
        if own.sum():
            reach = d[own, k].max()
            out.append(own | (d[:, k] <= np.minimum(near + 2 * RADIUS, reach + RADIUS) + EPS))
    if far.any():
        out.append(near > near[far].min() - RADIUS - EPS)
    return [c for c in out if c.sum() > 1]


def join_region(vs: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect each class of the region: a forest."""
    r = Region(sets)
    r.join(np.arange(len(sets)))
    return [(vs[i], vs[j]) for i, j in r.forest.edges]


# ---------------------------------------------------------------- distributed steps


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n, v, sketch) per row of docs(doc_id, text)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, v long, sketch binary")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in slices(batches):
            sets = shingle_sets(*buffer_of(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(arrow.field(0).type), pa.array([len(s) for s in sets], pa.int64()), pa.array([vertex(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], schema=arrow)

    return docs.mapInArrow(run, schema)


def rare_keys(docs: DataFrame, buckets: int) -> DataFrame:
    """(h, v): for each set the shingles that name its coarse regions; shingles of one set only are left out.

    Shingles are ordered by (in the counted space first, number of sets, hash); a set's keys are the first need(n) of them.
    Shingles travel as packed arrays by a bucket of their hash, are counted there, and those of at least two sets travel
    back to a bucket of their set. 32 bits beside the bucket tell them apart; a collision only makes one
    seem more frequent for all, so the order stays the same everywhere and no link is lost.
    """
    import pyarrow as pa

    top = np.uint64(int(SPACE * 2**64))
    width = np.uint64(int(top) // buckets + 1)
    shift = np.uint64(max(0, int(width).bit_length() - 32))

    def elements(batches):
        for b in slices(batches):
            sets = list({vertex(s): s for s in shingle_sets(*buffer_of(b.column("text"))) if len(s)}.items())
            if not sets:
                continue
            vs = np.array([v for v, _ in sets], np.int64)
            inside = np.array([int(np.searchsorted(s, top)) for _, s in sets])
            wanted = np.array([int(need(len(s))) for _, s in sets])
            slack = np.maximum(inside - wanted, 0).astype(np.int32)
            h = np.concatenate([s[: max(k, r)] for (_, s), k, r in zip(sets, inside.tolist(), wanted.tolist(), strict=True)])
            doc = np.repeat(np.arange(len(sets)), np.maximum(inside, wanted))
            # keys beyond the counted space, which short sets need: buckets under 0
            part = np.where(h < top, (h // width).astype(np.int64), -1 - (h % np.uint64(buckets)).astype(np.int64))
            order = np.argsort(part, kind="stable")
            h, doc, part = h[order], doc[order], part[order]
            names, heads = np.unique(part, return_index=True)
            rows = []
            for p, lo, hi in zip(names.tolist(), heads, ends(heads, len(part)), strict=True):
                d = doc[lo:hi]
                first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                low = ((h[lo:hi] - np.uint64(p) * width) >> shift).astype(np.uint32) if p >= 0 else (h[lo:hi] >> np.uint64(32)).astype(np.uint32)
                rows.append((vs[d[first]], np.diff(np.append(first, hi - lo)).astype(np.int32), slack[d[first]], low))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in range(4))], names=["bucket", "ids", "counts", "slack", "low"])

    def shared(key, t):
        """Of a bucket: the elements that at least two sets have, by a bucket of the set."""
        tidy()
        bucket = key[0].as_py()
        join = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        counts = join("counts", np.int32)
        v, slack, low = np.repeat(join("ids", np.int64), counts), np.repeat(join("slack", np.int32), counts), join("low", np.uint32)
        order = np.argsort(low, kind="stable")
        low = low[order]
        again = np.zeros(len(low), bool)
        again[1:] = low[1:] == low[:-1]
        again[:-1] |= again[1:]
        v, slack, low = v[order][again], slack[order][again], low[again]
        order = np.lexsort((v, low))
        v, slack, low = v[order], slack[order], low[order]
        new = np.append(True, (low[1:] != low[:-1]) | (v[1:] != v[:-1])) if len(v) else np.zeros(0, bool)
        v, slack, low = v[new], slack[new], low[new]  # copies of a set are one
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(v) else np.zeros(0, int)
        df = np.repeat(np.diff(np.append(first, len(v))), np.diff(np.append(first, len(v))))
        some = df > 1
        v, slack, df = v[some], slack[some], df[some].astype(np.int32)
        h = mix(low[some].astype(np.uint64) + np.uint64((bucket % (1 << 31)) << 32)).view(np.int64)
        part = (mix(v.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        names, heads = np.unique(part[order], return_index=True)
        own = [order[lo:hi] for lo, hi in zip(heads, ends(heads, len(part)), strict=True)]
        return pa.table({"part": pa.array(names, pa.int32()), "outer": pa.array([bucket < 0] * len(own), pa.bool_()), **{n: pa.array([x[o].tobytes() for o in own], pa.binary()) for n, x in (("v", v), ("h", h), ("df", df), ("slack", slack))}})

    def choose(key, t):
        """The keys of the sets of a part: all shared elements but the most frequent ones that the set has to spare."""
        tidy()
        outs_v, outs_h = [], []
        for outer in (False, True):
            rows = t.filter(pa.compute.equal(t.column("outer"), outer))
            join = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind)  # noqa: E731, B023
            v, h, df, slack = join("v", np.int64), join("h", np.int64), join("df", np.int32), join("slack", np.int32)
            if len(v) and not outer:
                order = np.lexsort((h, df, v))
                v, h, slack = v[order], h[order], slack[order]
                first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
                count = np.diff(np.append(first, len(v)))
                keep = np.arange(len(v)) - np.repeat(first, count) < np.repeat(count, count) - slack
                v, h = v[keep], h[keep]
            outs_v.append(v)
            outs_h.append(h)
        return pa.table({"h": pa.array(np.concatenate(outs_h), pa.int64()), "v": pa.array(np.concatenate(outs_v), pa.int64())})

    return (
        docs.select("text").mapInArrow(elements, "bucket int, ids binary, counts binary, slack binary, low binary")
        .groupBy("bucket").applyInArrow(shared, "part int, outer boolean, v binary, h binary, df binary, slack binary")
        .groupBy("part").applyInArrow(choose, "h long, v long")
    )


class Sketches:
    """Sketches of some sets, to be compared at the length of the shorter one."""

    def __init__(self, n: np.ndarray, data: list[bytes]):
        self.n = n
        size = np.array([len(x) // 8 for x in data], np.int64)
        self.level = np.round(np.log2(np.maximum(size, 1))).astype(np.int64)
        self.at, self.rows = {}, {}  # by level: places in its matrix; the matrix, with the sketches of the next level folded
        for k in np.unique(self.level).tolist():
            own, next_ = np.flatnonzero(self.level == k), np.flatnonzero(self.level == k + 1)
            matrix = lambda which: np.frombuffer(b"".join([data[i] for i in which.tolist()]), np.uint64)
            longer = matrix(next_).reshape(len(next_), 2, 1 << k)
            self.rows[k] = np.concatenate([matrix(own).reshape(len(own), 1 << k), longer[:, 0] ^ longer[:, 1]])
            self.at[k] = np.zeros(len(n), np.int32)
            self.at[k][np.concatenate([own, next_])] = np.arange(len(own) + len(next_))

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the sets a[i] and b[i] may link: their sizes allow it, and so do the places in which the sketches differ."""
        small, large = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        out = 100 * small >= SIMILAR * large
        level = np.minimum(self.level[a], self.level[b])
        for k in np.unique(level[out]).tolist():
            some = np.flatnonzero(out & (level == k))
            for lo in range(0, len(some), 1 << 14):
                i = some[lo : lo + (1 << 14)]
                differ = np.bitwise_count(self.rows[k][self.at[k][a[i]]] ^ self.rows[k][self.at[k][b[i]]]).sum(1, dtype=np.int64)
                out[i] = (100 + SIMILAR) * differ <= (100 - SIMILAR) * (self.n[a[i]] + self.n[b[i]])
        return out


def close_in_groups(heads: np.ndarray, sketches: Sketches) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of rows that connect, in each group of rows that begins at heads, all that may link. Rows of a group come by size."""
    n = sketches.n
    count = ends(heads, len(n)) - heads
    out = []
    for c in range(2, FEW + 1):
        first = heads[count == c]
        x, y = np.triu_indices(c, 1)
        step = max(1, (1 << 18) // len(x))
        for lo in range(0, len(first), step):
            a, b = (first[lo : lo + step, None] + x).ravel(), (first[lo : lo + step, None] + y).ravel()
            hit = sketches.close(a, b)
            out.append((a[hit], b[hit]))
    for lo, c in zip(heads[count > FEW].tolist(), count[count > FEW].tolist(), strict=True):
        label = np.arange(c)
        reach = np.searchsorted(n[lo : lo + c], n[lo : lo + c] * 100 // SIMILAR, "right").tolist()
        for i in range(c):
            other = i + 1 + np.flatnonzero(label[i + 1 : reach[i]] != label[i])
            if len(other):
                hit = other[sketches.close(np.full(len(other), lo + i), lo + other)]
                if len(hit):
                    hit = hit[np.unique(label[hit], return_index=True)[1]]  # one of each class
                    out.append((np.full(len(hit), lo + i), lo + hit))
                    label[np.isin(label, label[hit])] = label[i]
    return out


def close_pairs(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of sets that share a key and may link by their sketches, so many that all such pairs are connected. keys: (h, v); sets: (v, n, sketch).

    Of keys that the same sets have, one is looked at. The sets of a frequent key are dealt by size to bands, each with the next one, as sets that link are of about the same size.
    """
    import pyarrow as pa

    group = keys.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y")).where("c > 1")
    group = group.groupBy("c", "x", "y").agg(F.min("h").alias("h")).select("h", "c")
    rows = materialize(keys.join(group, "h"), "groups")
    parts = max(workers(keys), -(-rows.count() // ROWS))
    rows = rows.join(sets.select("v", "n", "sketch"), "v")
    place = F.log("n") / np.log(100 / SIMILAR)  # sizes that link are at most 1 apart
    bands = F.array(F.floor(place).cast("int"), F.floor(place + 1 + 1e-9).cast("int"))
    rows = rows.withColumn("band", F.explode(F.when(F.col("c") > MANY, bands).otherwise(F.array(F.lit(-9)))))

    def run(key, t):
        tidy()
        h, band, v, n, data = t.column("h").to_numpy(), t.column("band").to_numpy(), t.column("v").to_numpy(), t.column("n").to_numpy(), t.column("sketch").to_pylist()
        order = np.lexsort((v, n, band, h))
        h, band, v, n = h[order], band[order], v[order], n[order]
        heads = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (band[1:] != band[:-1]))) if len(h) else np.zeros(0, int)
        pairs = close_in_groups(heads, Sketches(n, [data[i] for i in order.tolist()]))
        a, b = (np.concatenate([v[:0], *(v[p[k]] for p in pairs)]) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    part = F.pmod(F.xxhash64("h", "band"), F.lit(parts)).alias("part")
    return rows.select("h", "band", "v", "n", "sketch").groupBy(part).applyInArrow(run, "a long, b long").distinct()


def with_sets(docs: DataFrame) -> DataFrame:
    """(v, region, n, s) from docs(text, v, region): s is the set's bytes."""
    import pyarrow as pa

    def run(batches):
        for b in slices(batches):
            sets = shingle_sets(*buffer_of(b.column("text")))
            # where an id is repeated with other texts, only the one with the vertex's set
            own = [i for i, v in enumerate(b.column("v").to_pylist()) if vertex(sets[i]) == v]
            b, sets = b.take(pa.array(own, pa.int64())), [sets[i] for i in own]
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("region"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["v", "region", "n", "s"])

    return docs.select("v", "region", "text").mapInArrow(run, "v long, region long, n long, s binary")


def join_small(members: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) that connect the classes of regions that fit a task; several regions share a part."""
    import pyarrow as pa

    def run(key, t):
        tidy()
        region, v, s = t.column("region").to_numpy(), t.column("v").to_numpy(), t.column("s").to_pylist()
        order = np.lexsort((v, region))
        cut = np.flatnonzero(np.append(True, region[order][1:] != region[order][:-1])) if len(order) else np.zeros(0, int)
        a, b = [], []
        for lo, hi in zip(cut, ends(cut, len(order)), strict=True):
            own = order[lo:hi]
            for x, y in join_region(v[own].tolist(), [np.frombuffer(s[i], np.uint64) for i in own]):
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.groupBy(F.pmod(F.xxhash64("region"), F.lit(parts)).alias("part")).applyInArrow(run, "a long, b long")


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def split_large(members: DataFrame, total: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One level of cells across tasks for regions too large for one: (links, children with region, parent, v, n, s, best).

    The rows of a region are dealt to salts; its pivots' sets (at most PIVOTS) go to each salt.
    """
    import pyarrow as pa

    m = members.join(total.select("region", F.ceil(F.col("elements") / REGION * 4).cast("int").alias("salts")), "region")
    pivots = m.withColumn("r", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("v"), "v"))).where(F.col("r") <= PIVOTS)
    pivots = pivots.select("region", "v", "s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = m.withColumn("salt", F.pmod(F.xxhash64("v", F.lit(1)), F.col("salts")).cast("int"))
    schema = "region long, v long, n long, s binary, d array<double>, links array<long>"

    def distances(key, left, right):
        vs, ss = left.column("v").to_numpy(), [np.frombuffer(x, np.uint64) for x in left.column("s").to_pylist()]
        pv, order = right.column("v").to_numpy(), np.argsort(right.column("v").to_numpy(), kind="stable")
        if not len(vs) or not len(pv):
            return pa.table({"region": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "s": pa.array([], pa.binary()), "d": pa.array([], pa.list_(pa.float64())), "links": pa.array([], pa.list_(pa.int64()))})
        ps = right.column("s").to_pylist()
        r = Region(ss)
        d, links = np.empty((len(vs), len(pv))), [[] for _ in vs]
        for k, i in enumerate(order.tolist()):
            p = np.frombuffer(ps[i], np.uint64)
            c = r.common(p, None, r.flat, r.heads)
            d[:, k] = 1 - c / (r.n + len(p) - c)
            for j in np.flatnonzero(linked(c, r.n, len(p))).tolist():
                links[j].append(int(pv[i]))
        return pa.table({"region": left.column("region"), "v": left.column("v"), "n": left.column("n"), "s": left.column("s"), "d": pa.array(list(d), pa.list_(pa.float64())), "links": pa.array(links, pa.list_(pa.int64()))})

    got = materialize(dealt.groupBy("region", "salt").cogroup(fresh(pivots).groupBy("region", "salt")).applyInArrow(distances, schema), "cells")
    links = got.select(F.col("v").alias("a"), F.explode("links").alias("b")).where("a <> b")
    got = got.withColumn("near", F.array_min("d")).withColumn("home", F.array_position("d", F.array_min("d")).cast("int"))
    far = 1 - RADIUS + EPS
    reach = got.groupBy("region", "home").agg(F.max(F.when(F.col("near") <= far, F.col("near"))).alias("reach"), F.min(F.when(F.col("near") > far, F.col("near"))).alias("far"))
    reach = reach.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("home", "reach"))).alias("reach"), F.min("far").alias("far"))  # PIVOTS entries a region
    best = got.select("region", F.explode("links").alias("p")).groupBy("region", "p").count().groupBy("region").agg(F.max_by("p", F.struct("count", "p")).alias("best"))
    got = got.join(reach, "region").join(best, "region", "left")
    own = F.expr(f"transform(d, (x, i) -> if(reach[i + 1] is not null and ((home = i + 1 and near <= {far}) or x <= least(near + {2 * RADIUS}, reach[i + 1] + {RADIUS}) + {EPS}), i, null))")
    own = F.array_compact(F.concat(own, F.array(F.when(F.col("near") > F.col("far") - RADIUS - EPS, F.lit(-1)))))
    children = got.select(
        F.explode(own).alias("cell"), F.col("region").alias("parent"), "v", "n", "s",
        (F.array_contains("links", F.col("best")) | (F.col("v") == F.col("best"))).alias("core"),
    ).withColumn("region", F.xxhash64("parent", "cell")).drop("cell")
    return links, children


def join_tight(members: DataFrame, total: DataFrame) -> DataFrame:
    """Links of regions that pivots don't split: every row outside the core (the rows linked with one pivot) against all rows, in blocks of both."""
    import pyarrow as pa

    m = members.join(total.select("region", F.ceil(F.col("elements") / REGION * 4).cast("int").alias("salts")), "region")
    dealt = m.withColumn("salt", F.pmod(F.xxhash64("v", F.lit(1)), F.col("salts")).cast("int"))
    rest = m.where(~F.coalesce("core", F.lit(False)))
    many = rest.groupBy("region").agg(F.ceil(F.sum(F.octet_length("s")) / 8 / REGION * 4).cast("int").alias("blocks"))  # of the rest only, so all rows are copied no more often than that
    rest = rest.join(many, "region").withColumn("block", F.pmod(F.xxhash64("v", F.lit(2)), F.col("blocks")).cast("int"))
    blocks = fresh(rest.select("region", "block").distinct())
    left = dealt.join(blocks, "region").select("region", "salt", "block", "v", "s", F.coalesce("core", F.lit(False)).alias("core"))
    right = rest.select("region", "block", "v", "s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def run(key, a, b):
        va, vb = a.column("v").to_numpy(), b.column("v").to_numpy()
        out_a, out_b = [], []
        if len(va) and len(vb):
            r = Region([np.frombuffer(x, np.uint64) for x in a.column("s").to_pylist()])
            core = np.flatnonzero(a.column("core").to_numpy(zero_copy_only=False))
            for i in core[1:].tolist():
                r.forest.up[i] = int(core[0])
            for u, x in zip(vb.tolist(), b.column("s").to_pylist(), strict=True):
                s = np.frombuffer(x, np.uint64)
                hit = np.flatnonzero(linked(r.common(s, None, r.flat, r.heads), r.n, len(s)))
                for root in {r.forest.find(i): i for i in hit.tolist()}.values():
                    out_a.append(u)
                    out_b.append(int(va[root]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    keys = ["region", "salt", "block"]
    return left.groupBy(*keys).cogroup(fresh(right).groupBy(*keys)).applyInArrow(run, "a long, b long").where("a <> b")


def region_links(members: DataFrame, levels: int = 6) -> DataFrame:
    """Links (a, b) that connect the classes of all regions. members: (region, v, n, s)."""
    spark = members.sparkSession
    out: DataFrame | None = None
    cur = members.withColumn("parent", F.lit(None).cast("long")).withColumn("core", F.lit(False))
    parent: DataFrame | None = None
    for level in range(levels):
        total = materialize(cur.groupBy("region").agg(F.sum("n").alias("elements"), F.min("parent").alias("parent")), "totals")
        if parent is not None:
            total = total.join(parent.select(F.col("region").alias("parent"), F.col("elements").alias("before")), "parent", "left")
        else:
            total = total.withColumn("before", F.lit(None).cast("long"))
        total = total.withColumn("kind", F.when(F.col("elements") <= REGION, 0).when((F.col("elements") > TIGHT * F.col("before")) | F.lit(level == levels - 1), 2).otherwise(1))
        total = materialize(total.select("region", "elements", "kind"), "totals")
        kinds = {r.kind: (r.n, r.elements) for r in total.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("elements").alias("elements")).collect()}
        found = []
        if 0 in kinds:
            parts = max(workers(members), -(-int(kinds[0][1]) // REGION))
            small = cur if len(kinds) == 1 else cur.join(total.where("kind = 0").select("region"), "region", "left_semi")
            found.append(join_small(small.select("region", "v", "s"), parts))
        if 2 in kinds:
            t = total.where("kind = 2")
            found.append(join_tight(cur.join(t.select("region"), "region", "left_semi"), t))
        if 1 in kinds:
            t = total.where("kind = 1")
            links, nxt = split_large(cur.select("region", "v", "n", "s").join(t.select("region"), "region", "left_semi"), t)
            found.append(links)
        for f in found:
            out = f if out is None else out.unionByName(f)
        if 1 not in kinds:
            break
        cur, parent = nxt, total
    return out if out is not None else spark.createDataFrame([], "a long, b long")


def jaccard_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included).

    Null texts, empty texts and texts without words have no shingles and are alone. Rows with a null id link like others; a null is the least id of a component only
    where there is no other. Repeated rows are repeated in the result. Only doc_id and text are read, so other columns can't clash. An empty table gives no rows.
    """
    # rows without an id are told apart by their texts; keys without nulls compare equal to themselves, and those with an id come first
    at = F.col(doc_id)
    keyed = isinstance(docs.schema[doc_id].dataType, StructType)
    key = at if keyed else F.struct(at.isNull().alias("no_id"), F.coalesce(at, F.lit("0").cast(docs.schema[doc_id].dataType)).alias("id"), F.when(at.isNull(), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))).otherwise(F.lit(b"")).alias("digest"))
    src = spread(docs.select(key.alias("doc_id"), F.col(text).alias("text")))
    base = materialize(describe(src), "sets")
    sets = materialize(base.where("n > 0").groupBy("v").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "vertices")
    shingles = base.agg(F.sum("n")).first()[0] or 0
    buckets = max(workers(docs), int(-(-shingles * SPACE // SHARE)))
    keys = materialize(rare_keys(src, buckets), "keys")
    regions = components(close_pairs(keys, sets), "coarse").withColumnRenamed("root", "region")
    members = regions.join(sets.select("v", "doc_id"), "v")
    members = materialize(with_sets(src.join(members, "doc_id")), "members")
    links = components(region_links(members), "classes")
    found = base.join(links, "v", "left").withColumn("class", F.when(F.col("n") > 0, F.coalesce("root", "v")))
    ids = found.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    alone = found.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    every = found.where("n > 0").join(ids, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
    if keyed:
        return every
    own = lambda c: F.when(~F.col(c)["no_id"], F.col(c)["id"]).alias(c)
    return every.select(own("doc_id"), "n_shingles", own("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each class the row with the least id, null ids last; texts without words stay.

    Rows are told apart by id and text, so a repeated id with other texts, or a null id, is a row of its own. Rows that repeat both go or stay together.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    # no nulls inside, so that keys compare equal to themselves; they order by id, then by text
    zero = F.lit("0").cast(kind)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", zero).alias("id"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"))
    keyed = docs.withColumn("_key", key)
    keep = jaccard_classes(keyed, doc_id="_key").where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(keep, "_key", "left_semi").select(docs.columns)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


#: Shingles by unnesting, links by a self-join, components by a recursive query. For small tables.
SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) end as s from w
), e as (
  select doc_id, len(s) as n, unnest(s) as x from s
), links as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach as (
  select doc_id, doc_id as root from s union select links.b, reach.root from reach join links on reach.doc_id = links.a
)
select doc_id, cast(len(any_value(s)) as bigint) as n_shingles, min(root) as component_id from s join reach using (doc_id) group by doc_id
"""
