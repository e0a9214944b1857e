"""Best-fit packing by minimum bin slack.

Pieces are at most ``capacity`` tokens, so all that planning needs is how many pieces of each
length there are: a histogram of ``capacity`` counts, whatever the size of the corpus. For
each bin a bitset subset-sum dynamic program over the lengths still available finds the fullest
combination that holds the longest one; it is then removed as often as the counts allow.
The plan has a number of patterns that is bounded by the capacity, not by the data, and is broadcast;
pieces find their bin from their rank among the pieces of their length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import documents, materialize, spread

CAPACITY, END = 1024, 2
#: Pieces of a length are ranked within so many buckets at least, and so many pieces in all for each, then by the buckets' counts before.
BUCKETS, BUCKET_ROWS = 256, 1 << 20


@lru_cache(2)
def _encoder(path: str):
    """The vocabulary of a tokenizer file as byte ranks, in the faster of the two libraries that read it.

    Both give the same ids for every text (the tests compare them); the vocabulary, its merge order and the added tokens are read from the file itself.
    """
    import json
    from pathlib import Path

    import public_tokenizers
    import tiktoken

    # the byte alphabet of such files: printable bytes stand for themselves, the others follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    spec = json.loads(Path(path).read_text())
    added = spec.get("added_tokens", [])
    if any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that take in or look at their surroundings are not supported")
    special = {x["content"]: x["id"] for x in added}
    ranks = {bytes(back[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text; none are put around it, but where an added token's string stands in it, it is that token, as the file's own library has it."""
    t = _encoder(path)
    return [np.array(t.encode(x, allowed_special="all"), "<u4") for x in texts]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut only if longer than capacity; then the first piece takes what is over."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    path = path or tokenizer_path()
    schema = _parse_datatype_string(f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import zlib

        from tideline.llm.common import slices

        for batch in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode([t or "" for t in batch.column("text").to_pylist()], path)):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                at = 0
                for p in range(-(-len(ids) // capacity)):
                    to = at + ((len(ids) - 1) % capacity + 1 if p == 0 else capacity)
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[at:to].tobytes()))
                    at = to
            ids_of = batch.column("doc_id").take(pa.array(row, pa.int64())).cast(arrow.field(0).type)
            yield pa.RecordBatch.from_arrays([ids_of, *(pa.array(c, f.type) for c, f in zip((piece, start, length, crc), list(arrow)[1:], strict=True))], schema=arrow)

    return spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, schema)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(length, how many)])]: the bins' patterns in the order in which they are filled. counts[l]: pieces of length l."""
    left = counts.astype(np.int64).copy()
    out = []
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        space = capacity - longest
        left[longest] -= 1
        # reach[i]: bit s is set if lengths from the i longest on can be combined to s
        lengths = [int(x) for x in np.flatnonzero(left[: space + 1])[::-1] if x]
        mask, reach, steps = (1 << (space + 1)) - 1, 1, []
        for ln in lengths:
            before, many, k = reach, min(int(left[ln]), space // ln), 1
            while many > 0:  # bounded multiples by binary splitting
                take = min(k, many)
                reach |= reach << (take * ln) & mask
                many -= take
                k *= 2
            steps.append((ln, before))
            if reach >> space & 1:
                break
        fill = reach.bit_length() - 1
        bin_ = {longest: 1}
        for ln, before in reversed(steps):
            n = 0
            while not before >> fill & 1:
                fill -= ln
                n += 1
            if n:
                bin_[ln] = bin_.get(ln, 0) + n
        left[longest] += 1
        times = min(int(left[ln]) // n for ln, n in bin_.items())
        for ln, n in bin_.items():
            left[ln] -= times * n
        out.append((times, sorted(bin_.items(), reverse=True)))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of one end id. Repeated rows are packed as often as they occur. An
    empty table gives no rows; other columns are not read.
    """
    cut = materialize(pieces(docs, capacity, path, text, doc_id), "pieces")
    buckets = max(BUCKETS, cut.count() // BUCKET_ROWS)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in per.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[length] = n
    # For each length the ranks are dealt to patterns in turn: (first rank, pieces in a bin, first bin, offset in the bin).
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    at, bins = np.zeros(capacity + 1, np.int64), 0
    for times, pattern in plan(counts, capacity):
        offset = 0
        for ln, n in pattern:
            runs.setdefault(ln, []).append((int(at[ln]), n, bins, offset))
            at[ln] += times * n
            offset += ln * n
        bins += times
    flat = [(ln, *r) for ln in sorted(runs) for r in runs[ln]]
    table = docs.sparkSession.sparkContext.broadcast(np.array(flat, np.int64).reshape(-1, 5))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        t = table.value
        key = t[:, 0] * (1 << 48) + t[:, 1]
        ln, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = t[np.searchsorted(key, ln * (1 << 48) + r, "right") - 1]
        k = r - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + k // row[:, 2], "offset": row[:, 4] + k % row[:, 2] * ln})

    ranked = (
        cut.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
        .join(F.broadcast(before) if buckets * capacity <= 1 << 18 else before, ["length", "bucket"])  # at most buckets * capacity rows of 20 bytes
        .withColumn("at", place("length", F.col("r") + F.col("before")))
    )
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
