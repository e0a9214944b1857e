"""Exact top-k search: a kept inverted index by shard, BM25 with block-max WAND pruning, merged with global statistics.

The index is built once and written to the shared folder. A shard holds the documents of about SHARD bytes of one scan partition;
equal ones are indexed once, with the list of their ids. Similar documents stand together, BLOCK to a block. A word
has its postings (document, occurrences) and, for every block it occurs in, what bounds its contribution there: most occurrences and
least length.

Queries pass in blocks of bounded size. For a query, words fall into two kinds: rare ones, whose postings are few, and common ones, which most
queries share. The cursors of rare words go over their postings and sum exactly; common words only add their block maxima. A document whose sum of
both does not reach the query's threshold is passed over (it can't be a pivot), and so is a whole block without a pivot: the postings of common words
are not touched there. In blocks with a pivot the common words are added, for all queries at once, and thresholds rise with what is found.
Before the first shard a query has no threshold. So shards are visited in rounds, each about eight times the one before: the k-th best score of a
round is the threshold of the next, and of all shards only a bounded number of hits comes back for a query, however many shards there are.
Sums in blocks are in single precision and thresholds are lowered by more than its error; every hit is scored again in double
precision, words in one fixed order, so that equal documents have equal scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import buffer_of, documents, forget, materialize, mix, pack, ranges, slices, small, spread, tidy, unpack, word_hashes, workers

K, K1, B = 10, 1.2, 0.75
#: Bytes of text in a shard, documents in a block, distinct query words (summed over queries) and queries in a pass.
SHARD, BLOCK, PASS_WORDS, PASS_QUERIES = 8 << 20, 64, 3_000_000, 4096
#: Queries and (query, posting) pairs worked on at once.
CHUNK, PAIRS = 512, 1_000_000
#: A word is common where its documents times its queries exceed this share of all (document, query) pairs.
COMMON = 0.003
#: Thresholds are lowered by this share, which covers single precision.
SLACK = 1e-4
#: A word with fewer postings in a shard than this has no block entries: its postings bound it better.
FEW = 8


def build(hashes: np.ndarray, n: np.ndarray, ids: np.ndarray, null: np.ndarray) -> dict[str, np.ndarray] | None:
    """The arrays of a shard from the word hashes of its documents, their word counts and ids. Documents without words aren't in it."""
    have = n > 0
    n, ids, null = n[have], ids[have], null[have]
    if not len(n):
        return None
    # equal documents (same words, same counts): one entry with all ids, in the order of ties
    heads = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        sign = np.stack([np.add.reduceat(hashes, heads), np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), heads), n.astype(np.uint64)])
    order = np.lexsort((ids, null, *sign))
    new = np.append(True, (sign[:, order[1:]] != sign[:, order[:-1]]).any(0))
    first = order[new]
    group = np.cumsum(new) - 1
    lengths = n[first]
    flat = hashes[ranges(heads[first], lengths)]
    doc = np.repeat(np.arange(len(first)), lengths)
    words, at = np.unique(flat, return_inverse=True)
    key = np.sort(doc * len(words) + at)
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    tf = np.diff(np.append(cut, len(key)))
    doc, word = key[cut] // len(words), key[cut] % len(words)
    lead = np.maximum.reduceat(tf * len(words) + word, np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))) % len(words)
    place = np.empty(len(first), np.int64)
    place[np.lexsort((lengths, lead))] = np.arange(len(first))
    order2 = np.argsort(word * len(first) + place[doc])
    word, doc, tf = word[order2], place[doc][order2], tf[order2]
    length = np.empty(len(first), np.int64)
    length[place] = lengths
    count = np.bincount(word, minlength=len(words))
    some = count[word] >= FEW
    cell_word, cell_block, cell_tf, cell_len = word[some], doc[some] // BLOCK, tf[some], length[doc[some]]
    edge = np.flatnonzero(np.append(True, (cell_word[1:] != cell_word[:-1]) | (cell_block[1:] != cell_block[:-1]))) if len(cell_word) else np.zeros(0, np.int64)
    # ids by entry: entries are in the order of place
    entry = place[group]
    by_entry = np.argsort(entry, kind="stable")
    return {
        "words": words, "df": small(np.bincount(word, np.bincount(entry)[doc], len(words)).astype(np.int64)), "count": small(count), "doc": small(doc), "tf": small(tf), "length": small(length),
        "cell_count": small(np.bincount(cell_word[edge], minlength=len(words))), "cell_block": small(cell_block[edge]),
        "cell_tf": small(np.maximum.reduceat(cell_tf, edge) if len(edge) else edge), "cell_len": small(np.minimum.reduceat(cell_len, edge) if len(edge) else edge),
        "ids": ids[order][by_entry], "null": null[order][by_entry], "copies": small(np.bincount(entry)),
        "total": np.array([len(n), int(n.sum())]),
    }


class Plan:
    """The queries of a pass: their distinct words (sorted hashes) with idf, and each query's words as numbers of these."""

    def __init__(self, queries: list[np.ndarray]):
        self.words, at = np.unique(np.concatenate(queries), return_inverse=True) if queries else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.size = np.array([len(q) for q in queries], np.int64)
        self.begin = np.append(0, np.cumsum(self.size))
        self.word = at.astype(np.int32)
        self.idf = np.zeros(len(self.words))
        self.avgdl = 1.0


class Shard:
    """A shard with the values of the plan's words."""

    def __init__(self, x: dict[str, np.ndarray], plan: Plan):
        at = np.minimum(np.searchsorted(plan.words, x["words"]), max(0, len(plan.words) - 1))
        on = plan.words[at] == x["words"] if len(plan.words) else np.zeros(len(x["words"]), bool)
        self.plan, self.ids, self.null = plan, x["ids"], x["null"]
        self.copies = x["copies"].astype(np.int64)
        self.first = np.cumsum(self.copies) - self.copies
        self.docs = len(x["length"])
        self.blocks = -(-self.docs // BLOCK)
        self.norm = K1 * (1 - B + B * x["length"] / plan.avgdl)
        count = x["count"].astype(np.int64)
        self.word = at[on]  # by number of the plan, ascending
        self.count = count[on]
        own = ranges((np.cumsum(count) - count)[on], self.count)
        self.begin = np.cumsum(self.count) - self.count
        self.doc, self.tf = x["doc"][own].astype(np.int64), x["tf"][own].astype(np.int64)
        self.value = self.part(np.repeat(plan.idf[self.word], self.count), self.tf, self.norm[self.doc])
        cells = x["cell_count"].astype(np.int64)
        cell = ranges((np.cumsum(cells) - cells)[on], cells[on])
        self.cell_count = cells[on]
        self.cell_begin = np.cumsum(self.cell_count) - self.cell_count
        self.cell_block = x["cell_block"][cell].astype(np.int64)
        self.cell_top = self.part(np.repeat(plan.idf[self.word], self.cell_count), x["cell_tf"][cell].astype(np.int64), K1 * (1 - B + B * x["cell_len"][cell] / plan.avgdl))
        self.back = np.full(len(plan.words), -1)
        self.back[self.word] = np.arange(len(self.word))

    @staticmethod
    def part(idf, tf, norm):
        return idf * (tf * (K1 + 1) / (tf + norm))

    def choose_common(self) -> None:
        """The common words get a dense matrix of values by document, and one of maxima by block."""
        asked = np.bincount(self.plan.word, minlength=len(self.plan.words))[self.word]
        common = np.flatnonzero((self.count * asked > COMMON * self.docs * len(self.plan.size)) & (self.cell_count > 0))
        self.column = np.full(len(self.word) + 1, -1)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        self.top = np.zeros((len(common), self.blocks), np.float32)
        at = ranges(self.begin[common], self.count[common])
        self.dense[np.repeat(np.arange(len(common)), self.count[common]), self.doc[at]] = self.value[at]
        at = ranges(self.cell_begin[common], self.cell_count[common])
        self.top[np.repeat(np.arange(len(common)), self.cell_count[common]), self.cell_block[at]] = self.cell_top[at]

    def search(self, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, score): all entries that may be among a query's k best, and reach its floor."""
        if not len(self.word):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.choose_common()
        plan, out = self.plan, []
        mine = self.back[plan.word]  # of every query word: the word of the shard, or -1
        rare = (mine >= 0) & (self.column[mine] < 0)
        work = np.add.reduceat(np.append(np.where(rare, self.count[mine], 0), 0), np.minimum(plan.begin[:-1], len(mine))) * (plan.size > 0)
        lo, done = 0, np.cumsum(work)
        while lo < len(plan.size):
            limit = (done[lo - 1] if lo else 0) + PAIRS
            hi = min(max(lo + 1, int(np.searchsorted(done, limit, "right"))), lo + CHUNK)
            out.append(self.search_some(lo, hi, mine, rare, k, floors))
            lo = hi
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, d = (np.concatenate(x) for x in zip(*out, strict=True))
        return self.exact(q, d, mine)

    def search_some(self, lo: int, hi: int, mine, rare, k: int, floors) -> tuple[np.ndarray, np.ndarray]:
        n, plan = hi - lo, self.plan
        span = slice(plan.begin[lo], plan.begin[hi])
        query = np.repeat(np.arange(n), plan.size[lo:hi])
        own, few = mine[span], rare[span]
        # rare words: exact sums over their postings
        count = self.count[own[few]]
        at = ranges(self.begin[own[few]], count)
        wide = self.blocks * BLOCK
        score = np.bincount(np.repeat(query[few] * wide, count) + self.doc[at], self.value[at], n * wide).astype(np.float32).reshape(n, wide)
        # common words: their block maxima
        many = (own >= 0) & ~few
        has = np.zeros((n, len(self.dense)), np.float32)
        has[query[many], self.column[own[many]]] = 1
        bound = has @ self.top
        best = np.zeros((n, k), np.float32)  # of the k best so far
        theta = np.maximum(floors[lo:hi] * (1 - SLACK), 1e-30).astype(np.float32)
        live = score.reshape(n, self.blocks, BLOCK).max(2) + bound
        qs, ds, ss = [], [], []
        # a query's most promising block first, which raises its threshold, then the blocks in order
        for step in range(-1, -(-self.blocks // 8)):
            if step < 0:
                block = live.argmax(1)
                rows = np.flatnonzero(live[np.arange(n), block] >= theta)
                cols = block[rows, None] * BLOCK + np.arange(BLOCK)
                got = score[rows[:, None], cols]
                for b in np.unique(block[rows]):
                    on = np.flatnonzero(block[rows] == b)
                    got[on] += has[rows[on]] @ self.dense[:, b * BLOCK : (b + 1) * BLOCK]
                live[rows, block[rows]] = 0  # seen
            else:
                group = live[:, step * 8 : step * 8 + 8] >= theta[:, None]
                rows = np.flatnonzero(group.any(1))
                cols = np.arange(step * 8 * BLOCK, min((step + 1) * 8, self.blocks) * BLOCK)
                got = score[rows, cols[0] : cols[-1] + 1] + has[rows] @ self.dense[:, cols[0] : cols[-1] + 1]
                got[~np.repeat(group[rows], BLOCK, 1)] = 0
            if not len(rows):
                continue
            hit = got >= theta[rows, None]
            some = np.flatnonzero(hit.any(1))
            if not len(some):
                continue
            r, c = np.nonzero(hit[some])
            qs.append(rows[some[r]])
            ds.append(cols[some[r], c] if step < 0 else cols[c])
            ss.append(got[some[r], c])
            top = np.partition(np.concatenate([best[rows[some]], got[some]], 1), -k, 1)[:, -k:]
            best[rows[some]] = top
            theta[rows[some]] = np.maximum(theta[rows[some]], top.min(1) * (1 - SLACK))
        if not qs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, d, s = np.concatenate(qs), np.concatenate(ds), np.concatenate(ss)
        on = (s >= theta[q]) & (d < self.docs)
        return q[on] + lo, d[on]

    def exact(self, q: np.ndarray, d: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores in double precision: over the words that query and document share, in the order of their hashes."""
        order = np.argsort(self.doc, kind="stable")  # postings by document, words ascending
        count = np.bincount(self.doc, minlength=self.docs)
        begin = np.cumsum(count) - count
        word = np.repeat(np.arange(len(self.word)), self.count)[order]
        value = self.value[order]
        score = np.zeros(len(q))
        on = mine >= 0
        query = np.repeat(np.arange(len(self.plan.size)), self.plan.size)[on]
        wide = len(self.word) + 1
        keys = query * wide + mine[on]  # ascending: a query's words are in order of their numbers
        size = count[d]
        done, lo = np.cumsum(size), 0
        while lo < len(q):  # as many at once as have PAIRS words in all; long documents are few at once
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, "right")))
            c = size[lo:hi]
            at = ranges(begin[d[lo:hi]], c)
            key = np.repeat(q[lo:hi] * wide, c) + word[at]
            place = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            hit = keys[place] == key if len(keys) else np.zeros(len(key), bool)
            score[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), c)[hit], value[at][hit], hi - lo)
            lo = hi
        return q, d, score


def best_of(query, null, ids, score, k: int) -> np.ndarray:
    """Places of each query's k best: higher scores first, then smaller ids, null ids last."""
    order = np.lexsort((ids, null, -score, query))
    q = query[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    return order[np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k]


def index(docs: DataFrame) -> DataFrame:
    """(shard long, data binary) from docs(doc_id long, text): one row per shard. A shard's number comes from its place in the scan."""
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        held: list[tuple[np.ndarray, ...]] = []
        size = made = 0
        part = TaskContext.get().partitionId() << 32

        def out():
            x = build(*(np.concatenate(c) for c in zip(*held, strict=True)))
            if x:
                yield pa.RecordBatch.from_arrays([pa.array([part + made], pa.int64()), pa.array([pack(**x)], pa.binary())], names=["shard", "data"])

        for b in batches:
            for s in slices([b]):
                data, offsets = buffer_of(s.column("text"))
                h, n, _ = word_hashes(data, offsets)
                ids = s.column("doc_id")
                held.append((h, n, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
                size += len(data)
                if size >= SHARD:
                    yield from out()
                    held, size, made = [], 0, made + 1
                    tidy()
        if held:
            yield from out()

    return docs.mapInArrow(run, "shard long, data binary")


def frequencies(shards: DataFrame, buckets: int) -> DataFrame:
    """(bucket, h, c): documents of every word, by bucket of the word; bucket -1 has documents and words in all."""
    import pyarrow as pa

    kind = "bucket int, h binary, c binary"

    def count(batches):
        for b in batches:
            for data in b.column("data").to_pylist():
                x = unpack(data)
                part = (mix(x["words"] + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                names, heads = np.unique(part[order], return_index=True)
                rows = [(-1, x["total"].astype(np.int64), np.zeros(0, np.int64))]
                rows += [(int(p), x["words"][r], x["df"][r].astype(np.int64)) for p, r in zip(names, np.split(order, heads[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[j].tobytes() for r in rows], pa.binary()) for j in (1, 2))], names=["bucket", "h", "c"])

    def add(key, t):
        if key[0].as_py() < 0:
            h, c = np.sum([np.frombuffer(x, np.int64) for x in t.column("h").to_pylist()], axis=0), np.zeros(0, np.int64)
        else:
            h, at = np.unique(np.frombuffer(b"".join(t.column("h").to_pylist()), np.uint64), return_inverse=True)
            c = np.bincount(at, np.frombuffer(b"".join(t.column("c").to_pylist()), np.int64)).astype(np.int64)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "h": pa.array([h.tobytes()], pa.binary()), "c": pa.array([c.tobytes()], pa.binary())})

    return shards.select("data").mapInArrow(count, kind).groupBy("bucket").applyInArrow(add, kind)


def parse_queries(queries: DataFrame) -> DataFrame:
    """(query_id, key, n, words): the distinct words of each query row as sorted hashes; key: their digest."""
    import pyarrow as pa

    def run(batches):
        for b in slices(batches):
            h, n, _ = word_hashes(*buffer_of(b.column("text")))
            each = [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array([len(x) for x in each], pa.int64()), pa.array([x.tobytes() for x in each], pa.binary())], names=["query_id", "n", "words"])

    return queries.mapInArrow(run, "query_id long, n long, words binary").select("query_id", F.unhex(F.sha2("words", 256)).alias("key"), "n", "words")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = K, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of every query, ties by the smaller id; documents that share no word with a query don't occur.

    Both sides: id (an integer) and text; other columns are not read. A query is its distinct words after lower-casing A-Z. Scores are rounded to 9 places before
    ranking. Null and empty texts find nothing and are not found; a null id is an id like others that loses every tie; a query's own document is found like any
    other. Every query row has a list of its own, rows with one id or one text included. Repeated documents are repeated.
    Words and query texts are told apart by hashes of 64 and 256 bits.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    src = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    shards = materialize(index(src), "index")
    number = shards.count()
    rows = materialize(parse_queries(queries.select(F.col(doc_id).cast("long").alias("query_id"), F.col(text).alias("text"))), "queries")
    if not number:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    size = shards.agg(F.sum(F.length("data"))).first()[0]
    table = materialize(frequencies(shards, max(workers(docs), int(size >> 28))), "frequencies")
    total = np.sum([np.frombuffer(bytes(r.h), np.int64) for r in table.where("bucket = -1").collect()], axis=0)  # one row
    sets = rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("words").alias("words"))
    asked, weight = sets.agg(F.count(F.lit(1)), F.sum("n")).first()
    passes = max(1, -(-asked // PASS_QUERIES), -(-(weight or 0) // PASS_WORDS))
    results: DataFrame | None = None
    hits_kind = "query int, doc_id long, score double"
    for p in range(passes if asked else 0):
        here = sets.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == p).select("key", "words").toArrow()  # bounded by the size of a pass
        keys = here.column("key").to_pylist()
        plan = Plan([np.frombuffer(x, np.uint64) for x in here.column("words").to_pylist()])
        wanted = spark.sparkContext.broadcast(plan.words)

        def pick(batches, wanted=wanted):
            w = wanted.value
            for b in batches:
                for h, c in zip(b.column("h").to_pylist(), b.column("c").to_pylist(), strict=True):
                    u = np.frombuffer(h, np.uint64)
                    at = np.minimum(np.searchsorted(w, u), max(0, len(w) - 1))
                    on = w[at] == u if len(w) else np.zeros(len(u), bool)
                    yield pa.RecordBatch.from_arrays([pa.array([at[on].astype(np.int32).tobytes()], pa.binary()), pa.array([np.frombuffer(c, np.int64)[on].tobytes()], pa.binary())], names=["at", "n"])

        freq = np.zeros(len(plan.words))
        for at, n in table.where("bucket >= 0").select("h", "c").mapInArrow(pick, "at binary, n binary").toLocalIterator():  # each word of the pass once
            freq[np.frombuffer(bytes(at), np.int32)] = np.frombuffer(bytes(n), np.int64)
        plan.idf = np.log(1 + (total[0] - freq + 0.5) / (freq + 0.5))
        plan.avgdl = float(total[1]) / int(total[0])
        shared = spark.sparkContext.broadcast(plan)
        found: DataFrame | None = None
        low, floors = 0.0, np.zeros(len(keys))
        share = min(1.0, 2 / number)
        while low < 1:
            high = 1.0 if share >= 0.5 else share
            first = spark.sparkContext.broadcast(floors)

            def search(batches, shared=shared, first=first):
                theta, held = first.value.copy(), None
                for b in batches:
                    for data in b.column("data").to_pylist():
                        s = Shard(unpack(data), shared.value)
                        q, d, score = s.search(k, theta)
                        # the ids of an entry are equal documents: its first k
                        n = np.minimum(s.copies[d], k)
                        at = ranges(s.first[d], n)
                        new = (np.repeat(q, n), s.null[at], s.ids[at], np.round(np.repeat(score, n), 9))
                        held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
                        keep = best_of(*held, k)
                        held = tuple(x[keep] for x in held)
                        full = np.bincount(held[0], minlength=len(theta)) >= k
                        least = np.full(len(theta), np.inf)
                        np.minimum.at(least, held[0], held[3])
                        theta[full] = np.maximum(theta[full], least[full])
                        del s
                        tidy()
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), pa.array(held[2], pa.int64(), mask=held[1]), pa.array(held[3], pa.float64())], names=["query", "doc_id", "score"])

            turn = F.pmod(F.xxhash64("shard", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
            some = shards.where((turn >= low) & (turn < high)).select("data").mapInArrow(search, hits_kind)
            every = some if found is None else some.unionByName(found.drop("rank"))
            rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            before, found = found, materialize(every.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "doc_id", "score", "rank"), "hits")
            forget(before)
            low, share = high, high * 8
            if low < 1:
                for r in found.where(F.col("rank") == k).collect():  # a row for each query of the pass at most
                    floors[r["query"]] = r["score"]
            first.unpersist()
        names = spark.createDataFrame(list(enumerate(keys)), "query int, key binary")  # the queries of a pass
        part = found.join(F.broadcast(names), "query").select("key", "rank", "doc_id", "score")
        results = part if results is None else results.unionByName(part)
        wanted.unpersist()
        shared.unpersist()
    forget(table)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    return rows.select("query_id", "key").join(results, "key").select("query_id", "rank", "doc_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100 as a query against all documents; scores to 6 places."""
    docs = documents(spark, sf_dir)
    return bm25_topk(docs, docs.where("doc_id % 100 = 0")).withColumn("score", F.round("score", 6))


#: Every query against every document that shares a word with it.
SQL = r"""
with w as (
  select doc_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as w from documents
), tf as (
  select doc_id, w, count(*) as tf from w group by 1, 2
), len as (
  select doc_id, sum(tf) as n from tf group by 1
), total as (
  select count(*) as docs, sum(n) / count(*) as avg from len
), idf as (
  select w, ln(1 + (any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, total group by w
), score as (
  select q.doc_id as query_id, tf.doc_id, round(sum(idf * tf.tf * 2.2e0 / (tf.tf + 1.2e0 * (0.25e0 + 0.75e0 * n / avg)) order by tf.w), 9) as score
  from tf q join tf on q.w = tf.w join idf on tf.w = idf.w join len on len.doc_id = tf.doc_id, total where q.doc_id % 100 = 0 group by 1, 2
)
select query_id, cast(rank as int) as rank, doc_id, round(score, 6) as score
from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from score) where rank <= 10
"""
