"""What the text operators share: shared storage, byte-level word splitting, crc32 folds.

Text rules used by every operator here: a null text counts as empty; rows whose
doc_id is null are kept and treated like any other id (they never win a tie).
"""

from __future__ import annotations

import gc
import itertools
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
M64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return path or "/tmp/tideline-checkpoints"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tideline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    gc.collect()  # shuffle files go once nothing refers to them
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    return out


def materialize_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like materialize, with rows dealt to buckets by key: a later grouping by the key needs no exchange of this side."""
    spark = df.sparkSession
    unique = f"tideline_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{unique}"
    df.write.bucketBy(buckets, key).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(unique)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.table(unique)
    out._written_to = path
    return out


def forget(df: DataFrame | None) -> None:
    """Deletes what materialize wrote for df. Only for tables that no later plan reads."""
    path = getattr(df, "_written_to", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def fold(c: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def workers(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Deals rows evenly if the scan has fewer partitions than the cluster has cores."""
    have, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if have < cores else df


# ---------------------------------------------------------------- bytes and words

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER_LUT = np.arange(256, dtype=np.uint8)
LOWER_LUT[65:91] += 32


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        with np.errstate(over="ignore"):
            if n > 1:
                np.cumprod(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published murmur3 constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as (bytes, offsets) with offsets from 0; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if a.null_count:
        a = pc.fill_null(a, "")
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    bufs = a.buffers()
    if not len(a) or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    off = np.frombuffer(bufs[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, words per document, first byte of each word). Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z.

    The hash is a 64-bit polynomial over the word's bytes with a finaliser.
    """
    n_docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64), np.zeros(0, np.int64)
    inside = ~SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][(offsets[:-1] < len(data)) & (np.diff(offsets) > 0)]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    counts = np.zeros(n_docs, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), counts, starts
    counts = np.diff(np.searchsorted(starts, offsets))
    word = np.cumsum(begins, dtype=np.int32)
    at = np.flatnonzero(inside)
    pos = at - starts[word[at] - 1]
    table = powers(int(pos.max()) + 1)
    terms = (LOWER_LUT[data[at]].astype(np.uint64) + np.uint64(1)) * table[pos]
    heads = np.searchsorted(at, starts)
    return mix(np.add.reduceat(terms, heads)), counts, starts


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, then begin[1], ..."""
    total = int(count.sum())
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(total)


def small(x: np.ndarray) -> np.ndarray:
    """x in the least unsigned type that holds it."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def pack(**arrays: np.ndarray) -> bytes:
    """One-dimensional arrays as compressed bytes. The bytes of numbers go by place, as the high ones of small numbers are alike."""
    import pickle

    import pyarrow as pa

    cells = {k: (v.dtype.str, np.ascontiguousarray(np.ascontiguousarray(v).view(np.uint8).reshape(-1, v.dtype.itemsize).T).tobytes()) for k, v in arrays.items()}
    raw = pickle.dumps(cells, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    """What pack wrote."""
    import pickle

    import pyarrow as pa

    cells = pickle.loads(pa.Codec("zstd").decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True))
    return {k: np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(t).itemsize, -1).T).reshape(-1).view(t) for k, (t, b) in cells.items()}


def tidy(keep: int = 1 << 20) -> None:
    """Gives freed memory back to the system: workers live through many tasks, and what they hold counts against the executor.

    Until the next call, arrays under ``keep`` bytes are kept for reuse when they are freed; larger ones are unmapped.
    """
    import ctypes

    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())  # its buffers are unmapped like others; the default pool keeps them
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, keep)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 8 * keep)  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches, bytes_: int = 2 << 20):
    """Re-cuts Arrow batches so that one slice holds about bytes_ of text at most (a longer single text stays whole)."""
    tidy()
    for batch in batches:
        col = batch.column("text")
        if not len(col):
            continue
        import pyarrow.compute as pc

        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(col):
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + bytes_, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    tidy()


def packed(batches):
    """Record batches with their texts as zstd bytes behind the text's length (8 bytes); null counts as empty. An exchange's or a file's own codec leaves about half as much again."""
    import pyarrow as pa

    codec = pa.Codec("zstd", compression_level=1)
    for b in slices(batches):
        data, offsets = buffer_of(b.column("text"))
        rows = [(hi - lo).to_bytes(8, "little") + codec.compress(data[lo:hi].tobytes(), asbytes=True) for lo, hi in itertools.pairwise(offsets.tolist())]
        yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(rows, pa.binary()))


def unpacked(batches, bytes_: int = 2 << 20):
    """What packed wrote, with texts as plain bytes, cut like slices: no more are unpacked at once, however well they compress."""
    import pyarrow as pa

    tidy()
    codec = pa.Codec("zstd")
    for b in batches:
        place = b.schema.get_field_index("text")
        rows = [x.as_buffer() for x in b.column(place)]
        length = [int.from_bytes(x[:8], "little") for x in map(memoryview, rows)]
        lo = 0
        while lo < len(rows):
            hi, size = lo + 1, length[lo]
            while hi < len(rows) and size + length[hi] <= bytes_:
                size += length[hi]
                hi += 1
            texts = [codec.decompress(rows[i].slice(8), decompressed_size=length[i], asbytes=True) for i in range(lo, hi)]
            yield b.slice(lo, hi - lo).set_column(place, "text", pa.array(texts, pa.large_binary()))
            lo = hi
    tidy()
