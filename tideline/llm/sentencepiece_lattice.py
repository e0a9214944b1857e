"""Encoding with a piece vocabulary as a relational lattice, and decoding.

A document is its text with a space in front, cut into segments: between two characters that stand next to each other in no piece of the vocabulary, no piece
can cross, so the best path of a text is that of its segments one after the other, exactly. Words are segments or several of them.
Distinct segments are exploded into substrings as long as the longest piece, equi-joined to the piece table and grouped by segment; a higher-order
aggregate folds the edges into the path with the greatest sum of piece scores (Viterbi). Characters without a piece cost ten more than the worst piece and
become byte pieces.

Documents stay where they are: a chunk, in a bucketed table, keeps its distinct segments and, for each document, their numbers. Segments that most chunks share
(a bounded number) reach the chunks by broadcast, the others by a join whose result is packed by chunk; the chunks themselves are never exchanged.
"""

from __future__ import annotations

from contextlib import contextmanager
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import documents, forget, materialize, materialize_buckets, mix, pack, powers, ranges, slices, small, spread, tidy, unpack, workers

SPACE = "▁"
#: Bytes of text in a chunk; segments that go by broadcast, of at most so many characters.
CHUNK, COMMON, SHORT = 32 << 20, 1 << 16, 64
#: Starts of substrings that are exploded from one window of a segment; windows overlap by the longest piece.
WINDOW = 64
#: Back-pointers that the fold sets aside at a time, so that long segments aren't copied at every step; more than any piece is long.
RUN = 256
#: Segments that share a task of the lattice, about.
TASK = 20_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str | None = None):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or model_path())


def pieces_of(path: str | None = None) -> tuple[list[tuple[str, int, float]], int]:
    """((piece, id, score) with plain spaces, id of the first byte piece). Of equal pieces the first counts."""
    sp = load(path)
    rows: dict[str, tuple[str, int, float]] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            piece = sp.id_to_piece(i).replace(SPACE, " ")
            rows.setdefault(piece, (piece, i, float(sp.get_score(i))))
    return list(rows.values()), next(i for i in range(sp.get_piece_size()) if sp.is_byte(i))


def joined_pairs(pieces: list[str]) -> set[str]:
    """Pairs of characters that are neighbours within some piece."""
    return {a + b for p in pieces for a, b in zip(p, p[1:], strict=False)}


class Cutter:
    """Cuts texts into segments: between characters that are neighbours in no piece."""

    def __init__(self, pairs: set[str]):
        chars = sorted({c for p in pairs for c in p})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1) ** 2, bool)
        self.wide = len(chars) + 1
        for a, b in pairs:
            self.joined[int(self.number[ord(a)]) * self.wide + int(self.number[ord(b)])] = True

    def __call__(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """(all marked texts in one, begin and length of each segment in characters, segments of each text). A text that isn't empty gets a space in front."""
        marked = [" " + t if t else "" for t in texts]
        whole = "".join(marked)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        offsets = np.cumsum([0, *map(len, marked)])
        kind = self.number[codes].astype(np.int64)
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.joined[kind[:-1] * self.wide + kind[1:]]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        begin = np.flatnonzero(cut)
        return whole, begin, np.diff(np.append(begin, len(codes))), np.diff(np.searchsorted(begin, offsets))


def segment_hashes(whole: str, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.uint64)
    base = 0x9E3779B97F4A7C15
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers(len(codes), base))])
    back = powers(len(codes) + 1, pow(base, -1, 1 << 64))
    return mix((sums[begin + length] - sums[begin]) * back[begin] + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def segments(text: str, pairs: set[str]) -> list[str]:
    """The segments of one text."""
    whole, begin, length, _ = Cutter(pairs)([text])
    return [whole[b : b + n] for b, n in zip(begin.tolist(), length.tolist(), strict=True)]


def chunks(docs: DataFrame, pairs: set[str]) -> DataFrame:
    """(part long, words array<string>, doc_ids array, body binary) from docs(doc_id, text): distinct segments of a chunk (told apart by 64-bit hashes), and for its documents the
    numbers of their segments, how many each has, and the digest of each text."""
    import pyarrow as pa

    def run(batches):
        import hashlib

        from pyspark import TaskContext

        cutter, first = Cutter(pairs), TaskContext.get().partitionId() << 32
        made = size = 0
        number: dict[int, int] = {}
        words: list[str] = []
        held: list[tuple] = []

        def out():
            ids = pa.concat_arrays([h[0] for h in held])
            # frequent segments get small numbers; those over two bytes are kept apart
            numbers = np.concatenate([h[1] for h in held])
            times = np.bincount(numbers, minlength=len(words))
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words))
            numbers = place[numbers]
            low = np.minimum(numbers, 65535).astype(np.uint16)
            body = pack(low=low, high=small(numbers[low == 65535]), count=small(np.concatenate([h[2] for h in held])), digest=np.frombuffer(b"".join(d for h in held for d in h[3]), np.uint8))
            alone = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), alone(pa.array([words[i] for i in order.tolist()], pa.string())), alone(ids), pa.array([body], pa.binary())], names=["part", "words", "doc_ids", "body"])

        for b in batches:
            for s in slices([b], 1 << 20):
                texts = [t or "" for t in s.column("text").to_pylist()]
                whole, begin, length, count = cutter(texts)
                unique, at, back = np.unique(segment_hashes(whole, begin, length), return_index=True, return_inverse=True)
                own = np.fromiter(map(number.get, unique.tolist(), repeat(-1)), np.int64, len(unique))
                new = np.flatnonzero(own < 0)
                own[new] = np.arange(len(words), len(words) + len(new))
                number.update(zip(unique[new].tolist(), own[new].tolist(), strict=True))
                words += [whole[b : b + n] for b, n in zip(begin[at[new]].tolist(), length[at[new]].tolist(), strict=True)]
                own = own.astype(np.uint32)
                ids = s.column("doc_id")
                held.append((ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, own[back], count, [hashlib.sha256(t.encode()).digest() for t in texts]))
                size += sum(map(len, texts))
                if size >= CHUNK:
                    yield out()
                    made, size, number, words, held = made + 1, 0, {}, [], []
                    tidy()
        if held:
            yield out()
        number, words, held = {}, [], []
        tidy()

    return docs.mapInArrow(run, f"part long, words array<string>, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>, body binary")


def by_chunk(answers: DataFrame) -> DataFrame:
    """(part, data) from (part, n, ids): the ids of a chunk's segments, packed by task."""
    import pyarrow as pa

    def run(batches):
        held: list[tuple] = []
        rows = 0

        def out():
            part, n, size = (np.concatenate([h[k] for h in held]) for k in range(3))
            flat, begin = np.concatenate([h[3] for h in held]), np.cumsum(size) - size
            order = np.lexsort((n, part))
            cut = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
            data = []
            for own in np.split(order, cut[1:]):
                data.append(pack(n=small(np.diff(n[own], prepend=0)), size=small(size[own]), ids=small(flat[ranges(begin[own], size[own])])))
            return pa.RecordBatch.from_arrays([pa.array(part[order][cut], pa.int64()), pa.array(data, pa.binary())], names=["part", "data"])

        for b in batches:
            if b.num_rows:
                ids = b.column("ids")
                held.append((b.column("part").to_numpy(), b.column("n").to_numpy().astype(np.int64), np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.flatten().to_numpy()))
                rows += b.num_rows
                if rows >= 1_000_000:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    return answers.select("part", "n", "ids").mapInArrow(run, "part long, data binary")


def utf8_ids(c: Column, first_byte: int) -> Column:
    """Ids of the byte pieces of a code point."""
    tail = lambda k: F.shiftright(c, k).bitwiseAND(63) + (0x80 + first_byte)
    head = lambda k, mark: F.shiftright(c, k) + (mark + first_byte)
    return (
        F.when(c < 0x80, F.array(c + first_byte)).when(c < 0x800, F.array(head(6, 0xC0), tail(0)))
        .when(c < 0x10000, F.array(head(12, 0xE0), tail(6), tail(0))).otherwise(F.array(head(18, 0xF0), tail(12), tail(6), tail(0)))
    )


def best_paths(words: DataFrame, pieces: list[tuple[str, int, float]], first_byte: int, tasks: int) -> DataFrame:
    """(key, ids array<int>, parts) of distinct segments. words: (key, long), a row for each chunk that asks; the segment is ``long``, or the key where that is null.

    An edge (e, n, cost, id) is a piece of n characters that ends after e of them. The fold goes over a segment's positions; its state is the best edge into each position
    so far with the cost of the best path that it ends. Of equal sums the shorter last piece wins.
    """
    spark = words.sparkSession
    longest = max((len(p[0]) for p in pieces), default=1)
    if longest > RUN:
        raise ValueError("pieces are longer than the fold looks back")
    table = F.broadcast(spark.createDataFrame([(p, i, -s) for p, i, s in pieces], "piece string, id int, cost double"))  # the vocabulary: its size is fixed
    lengths: dict[str, set[int]] = {}
    for p, _, _ in pieces:
        if len(p) > 2:
            lengths.setdefault(p[:3], set()).add(len(p))
    heads = F.broadcast(spark.createDataFrame([(k, sorted(v)) for k, v in lengths.items()] or [("", [])], "head string, lengths array<int>"))
    unknown = max((-s for _, _, s in pieces if s > -1e8), default=0.0) + 10.0

    # one shuffle; all that follows stays with the segment
    each = words.repartition(tasks, "key").groupBy("key").agg(F.first("long").alias("long"), F.count(F.lit(1)).alias("parts"))
    each = each.withColumn("word", F.coalesce("long", "key")).withColumn("len", F.length("word"))
    windows = each.select("key", "parts", "len", F.explode(F.sequence(F.lit(0), F.expr(f"cast((len - 1) div {WINDOW} as int)"))).alias("j"), "word")
    windows = windows.select("key", "parts", "len", "j", F.expr(f"substring(word, j * {WINDOW} + 1, {WINDOW + longest - 1})").alias("part"))
    starts = windows.select("key", "parts", "len", "j", "part", F.explode(F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.col("len") - F.col("j") * WINDOW))).alias("r"))
    starts = starts.withColumn("head", F.expr("substring(part, r, 3)")).join(heads, "head", "left")
    b = F.col("j") * WINDOW + F.col("r") - 1
    spans = starts.select("key", "parts", b.alias("b"), "len", "part", "r", F.explode(F.concat(F.array(F.lit(1), F.lit(2)), F.coalesce("lengths", F.array().cast("array<int>")))).alias("n")).where("b + n <= len")
    found = spans.withColumn("piece", F.expr("substring(part, r, n)")).join(table, "piece", "left").where("id is not null or n = 1")
    # a character without a piece has -1 less its code point for an id
    edge = F.struct((F.col("b") + F.col("n")).alias("e"), "n", F.coalesce("cost", F.lit(unknown)).alias("cost"), F.coalesce("id", -1 - F.ascii("piece")).alias("id"))
    lattice = found.select("key", "parts", edge.alias("edge")).groupBy("key").agg(F.first("parts").alias("parts"), F.sort_array(F.collect_list("edge")).alias("edges"))
    # a position's edges begin with the one of a single character, which always is there
    lattice = lattice.withColumn("begins", F.filter(F.sequence(F.lit(1), F.size("edges")), lambda i: F.element_at("edges", i)["n"] == 1))

    best_edge = "struct<cost:double,n:int,id:int>"
    zero = F.expr(f"named_struct('last', array(named_struct('cost', 0D, 'n', 0, 'id', 0)), 'done', cast(array() as array<array<{best_edge}>>))")
    edges, begins = F.col("edges"), F.col("begins")

    def step(s: Column, e: Column) -> Column:
        last = s["last"]
        lo = F.element_at(begins, e)
        hi = F.when(e < F.size(begins), F.element_at(begins, e + 1)).otherwise(F.size(edges) + 1)
        ways = F.transform(F.slice(edges, lo, hi - lo), lambda x: F.struct((F.element_at(last, F.size(last) + 1 - x["n"])["cost"] + x["cost"]).alias("cost"), x["n"].alias("n"), x["id"].alias("id")))
        best = F.array(F.array_min(ways))
        aside = F.struct(F.concat(F.slice(last, F.lit(RUN + 1), F.lit(RUN)), best).alias("last"), F.concat(s["done"], F.array(F.slice(last, F.lit(1), F.lit(RUN)))).alias("done"))
        return F.when(F.size(last) >= 2 * RUN, aside).otherwise(F.struct(F.concat(last, best).alias("last"), s["done"].alias("done")))

    folded = lattice.select("key", "parts", F.aggregate(F.sequence(F.lit(1), F.size("begins")), zero, step, lambda s: F.concat(F.flatten(s["done"]), s["last"])).alias("back"))

    def walk(s: Column, i: Column) -> Column:
        here = F.element_at(F.col("back"), i + 1)
        return F.when(i == s["at"], F.struct((i - here["n"]).alias("at"), F.concat(s["out"], F.array(here["id"])).alias("out"))).otherwise(s)

    size = F.size("back") - 1
    begin = F.struct(size.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    path = folded.select("key", "parts", F.reverse(F.aggregate(F.sequence(size, F.lit(1), F.lit(-1)), begin, walk, lambda s: s["out"])).alias("path"))
    ids = F.when(F.array_min("path") >= 0, F.col("path")).otherwise(F.flatten(F.transform("path", lambda i: F.when(i >= 0, F.array(i)).otherwise(utf8_ids(-1 - i, first_byte)))))
    return path.select("key", "parts", ids.alias("ids"))


@contextmanager
def wide_lists(spark: SparkSession):
    """Room for a task's segments in the hash map of collect_list, which else sorts all edges; tasks are cut to TASK segments."""
    option = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(option)
    spark.conf.set(option, str(4 * TASK))
    try:
        yield
    finally:
        spark.conf.set(option, before)


def segment_key(c: str) -> Column:
    """Short segments stand for themselves, long ones for their digest, which no short one can be."""
    return F.when(F.length(c) <= SHORT, F.col(c)).otherwise(F.concat(F.lit("\0"), F.sha2(F.col(c).cast("binary"), 256)))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", keep: bool = False) -> DataFrame:
    """One row per document: doc_id, ids, and with keep the SHA-256 of its text as digest.

    The ids are those of the path with the greatest sum of piece scores over the text with a space in front. A null or empty text has no ids; repeated rows give
    repeated results; null ids are ids like others; other columns are not read. A text's own ▁ becomes byte pieces.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    pieces, first_byte = pieces_of(path)
    src = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    table = materialize_buckets(chunks(src, joined_pairs([p[0] for p in pieces])), "chunks", "part", max(workers(docs), src.rdd.getNumPartitions()))
    asked = table.select("part", F.posexplode("words").alias("n", "word")).select("part", "n", segment_key("word").alias("key"), F.when(F.length("word") > SHORT, F.col("word")).alias("long"))
    number = table.agg(F.sum(F.size("words"))).first()[0] or 0
    tasks = max(workers(docs) * 4, int(number // TASK) + 1)
    with wide_lists(spark):
        coded = materialize_buckets(best_paths(asked.select("key", "long"), pieces, first_byte, tasks), "codes", "key", tasks)
    often = coded.where((F.length("key") <= SHORT) & (F.col("parts") > 1)).orderBy(F.desc("parts"), "key").limit(COMMON).select("key", "ids").toArrow()  # COMMON rows
    known = dict(zip(often.column("key").to_pylist(), (np.array(i, np.int32).tobytes() for i in often.column("ids").to_pylist()), strict=True))
    shared = spark.sparkContext.broadcast(known)
    names = spark.createDataFrame([(k,) for k in known], "key string")
    others = asked.select("part", "n", "key").join(F.broadcast(names), "key", "left_anti")
    rest = coded.join(F.broadcast(names), "key", "left_anti").select("key", "ids")
    answers = materialize(by_chunk(others.join(rest, "key").coalesce(max(workers(docs), tasks // 8))), "answers")
    forget(coded)
    schema = _parse_datatype_string(f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>" + ", digest binary" * keep)
    arrow = to_arrow_schema(schema)

    def put(key, left, right):
        tidy()
        words = left.column("words")[0].values.to_pylist()
        got = shared.value
        codes = [got.get(w, b"") for w in words]
        for data in right.column("data").to_pylist():
            x = unpack(data)
            raw, size = x["ids"].astype(np.int32).tobytes(), x["size"].astype(np.int64) * 4
            for n, e, m in zip(np.cumsum(x["n"].astype(np.int64)).tolist(), np.cumsum(size).tolist(), size.tolist(), strict=True):
                codes[n] = raw[e - m : e]
        size = np.array([len(c) // 4 for c in codes], np.int64)
        flat, begin = np.frombuffer(b"".join(codes), np.int32), np.cumsum(size) - size
        if len(size) and not size.all():
            raise RuntimeError("a segment has no path")
        x = unpack(left.column("body")[0].as_py())
        ids, digest, numbers = left.column("doc_ids").combine_chunks().flatten().cast(arrow.field(0).type), x["digest"].tobytes(), x["low"].astype(np.int64)
        numbers[numbers == 65535] = x["high"]
        ends = np.append(0, np.cumsum(x["count"].astype(np.int64)))
        tables = []
        for lo in range(0, len(ids), 2000):
            hi = min(lo + 2000, len(ids))
            own = numbers[ends[lo] : ends[hi]]
            upto = np.append(0, np.cumsum(size[own]))
            lists = pa.ListArray.from_arrays(pa.array(upto[ends[lo : hi + 1] - ends[lo]].astype(np.int32)), pa.array(flat[ranges(begin[own], size[own])], pa.int32()))
            tables.append(pa.table([ids.slice(lo, hi - lo), lists, *([pa.array([digest[32 * i : 32 * i + 32] for i in range(lo, hi)], pa.binary())] if keep else [])], schema=arrow))
        return pa.concat_tables(tables) if tables else arrow.empty_table()

    return table.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(put, schema)


def decode(coded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """coded with ``text``: the bytes of all pieces joined, byte pieces as they are, and the space in front dropped. Null ids give null; ids outside the vocabulary raise.

    The vocabulary is one array of constants; bytes that are no UTF-8 become replacement characters.
    """
    sp = load(path)
    table = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(sp.get_piece_size())]
    joined = lambda cells, mark: F.array_join(F.transform(ids, lambda i: F.element_at(F.split(F.lit(mark.join(cells)), mark), i + 1)), "")
    # pieces that are characters join as they are; texts with parts of characters go byte by byte
    part = "\uffff"
    whole = joined([part if len(t) == 1 and not 0 < t[0] < 128 else t.decode() for t in table], "\0")
    spelled = F.make_valid_utf8(F.unhex(joined([t.hex() for t in table], ",")).cast("string"))
    got = coded.withColumn("_whole", whole)
    return got.withColumn("text", F.substr(F.when(F.instr("_whole", part) > 0, spelled).otherwise(F.col("_whole")), F.lit(2))).drop("_whole")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32 of the ids as text, round_trip): every document encoded, decoded, and held against itself by SHA-256."""
    coded = decode(encode(documents(spark, sf_dir), keep=True))
    same = F.unhex(F.sha2(F.col("text").cast("binary"), 256)) == F.col("digest")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"), same.alias("round_trip"))
