"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words and their first four and six bytes are hashed to embedding rows, which are added up for
each word (so inflected forms share evidence); filters of several widths slide over the word sequence,
each keeps its largest response (max pooling), and a logistic layer turns the pooled values into a
score. For scoring, embeddings and filter taps are multiplied out beforehand, so a filter
of width w costs w table rows for each part of a word. All labelled rows are learned from, in parts whose nets are averaged; decisions use thresholds calibrated
by language, on all of them, each scored by a net that did not see it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import LOWER_LUT, SEPARATOR, buffer_of, documents, fold, materialize, mix, packed, slices, spread, tidy, unpacked, word_hashes

#: Labelled documents of one task's fit, about.
SHARE = 4800
ROWS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 6, (1, 2, 3)
#: Documents that a word's log odds count on either side beforehand.
PRIOR = 10.0
#: Bytes of text that are hashed and scored at once, so that their arrays stay in the cache.
SLICE = 128 << 10
#: Bytes of a word's parts; 0 is the whole word.
PARTS = (0, 4, 6)


@dataclass
class ConvNet:
    """tables[width][tap]: ROWS x FILTERS responses of each hashed word under that tap; the last row is padding."""

    rows: int = ROWS
    emb: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    taps: dict[int, np.ndarray] = field(default_factory=dict)  # width -> [width, DIM, FILTERS]
    bias: dict[int, np.ndarray] = field(default_factory=dict)
    out: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    out_bias: float = 0.0
    tables: dict[int, list[np.ndarray]] = field(default_factory=dict)
    joined: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # the tables of all widths and taps, side by side

    def multiply_out(self) -> ConvNet:
        self.joined = np.concatenate([self.emb @ self.taps[w][k] for w in self.taps for k in range(w)], 1)
        columns = iter(np.split(self.joined, self.joined.shape[1] // FILTERS, axis=1))
        self.tables = {w: [next(columns) for _ in range(w)] for w in self.taps}  # views
        return self

    def __getstate__(self) -> dict:
        """Without the tables, which follow from the rest."""
        return self.__dict__ | {"tables": {}, "joined": self.joined[:0], "_multiplied": bool(self.tables)}

    def __setstate__(self, state: dict) -> None:
        multiplied = state.pop("_multiplied")
        self.__dict__.update(state)
        if multiplied:
            self.multiply_out()

    def pooled(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """[documents, filters]: the largest response of each filter. Positions past the end of a document are padding."""
        n = len(counts)
        out = np.zeros((n, FILTERS * len(self.tables)), np.float32)
        some = np.flatnonzero(counts)
        if not len(some):
            return out
        ends = np.cumsum(counts)[some]
        heads = ends - counts[some]
        every = np.take(self.joined, words[:, 0], axis=0)
        for j in range(1, words.shape[1]):
            every += np.take(self.joined, words[:, j], axis=0)
        at = 0
        for i, w in enumerate(self.tables):
            conv = every[:, at : at + FILTERS].copy()
            for k in range(1, w):
                response = every[k:, at + k * FILTERS : at + (k + 1) * FILTERS].copy()
                for j in range(k):
                    past = ends - 1 - j
                    response[past[(past >= heads) & (past < len(response))]] = 0
                conv[: len(response)] += response
            at += w * FILTERS
            out[some, i * FILTERS : (i + 1) * FILTERS] = np.maximum(np.maximum.reduceat(conv, heads, axis=0) + self.bias[w], 0)
        return out

    def score(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = self.pooled(words, counts) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def start(pos: np.ndarray, neg: np.ndarray, share: float, seed: int = 5) -> ConvNet:
    """The net before the fit. One embedding dimension starts at each word's smoothed log odds by document; pos and neg are the documents of either class that have the word."""
    rng = np.random.default_rng(seed)
    net = ConvNet()
    net.emb = rng.normal(0, 0.1, (ROWS + 1, DIM)).astype(np.float32)
    odds = np.log((pos + PRIOR * share) / (neg + PRIOR * (1 - share))) - np.log(share / (1 - share))
    net.emb[:, 0] = np.clip(odds, -0.5, 5) / 2
    net.emb[ROWS] = 0
    for w in WIDTHS:
        net.taps[w] = rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32)
        net.taps[w][0, 0, : FILTERS // 2] += 0.8
        net.bias[w] = np.full(FILTERS, -0.5, np.float32)
    net.out = rng.uniform(0.1, 0.4, FILTERS * len(WIDTHS)).astype(np.float32)
    net.out_bias = -1.5
    return net


def fit(net: ConvNet, docs: list[np.ndarray], y: np.ndarray, share: float, epochs: int = 12, rate: float = 0.05, seed: int = 5) -> ConvNet:
    """Adagrad on the logistic loss with balanced classes, from net on; share: of class 1 in all rows of the fold."""
    rng = np.random.default_rng(seed)
    net = replace(net, emb=net.emb.copy(), taps=dict(net.taps), bias=dict(net.bias))
    weight = np.where(y > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    seen: dict[str, np.ndarray | float] = {"emb": np.full_like(net.emb, 1e-2), "out": np.full_like(net.out, 1e-2), "b": 1e-2} | {f"t{w}": np.full_like(net.taps[w], 1e-2) for w in WIDTHS} | {f"c{w}": np.full_like(net.bias[w], 1e-2) for w in WIDTHS}

    def step(name, value, grad):
        seen[name] = seen[name] + grad * grad
        return value - rate * grad / np.sqrt(seen[name])

    size = 128
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), size):
            own = [i for i in order[lo : lo + size] if len(docs[i])]
            if not own:
                continue
            counts = np.array([len(docs[i]) for i in own])
            words = np.concatenate([np.concatenate([docs[i] for i in own]).astype(np.int64), np.full((1, len(PARTS)), ROWS)])  # the last one is padding
            ends = np.cumsum(counts)
            heads = ends - counts
            total = int(ends[-1])
            past = [(p := ends - 1 - j)[p >= heads] for j in range(max(WIDTHS) - 1)]
            vectors = np.take(net.emb, words[:, 0], axis=0)
            for j in range(1, len(PARTS)):
                vectors += np.take(net.emb, words[:, j], axis=0)
            response = np.concatenate([net.taps[w][k] for w in WIDTHS for k in range(w)], 1).T @ vectors[:total].T  # [taps' filters, position]
            conv, at = np.empty((len(WIDTHS) * FILTERS, total), response.dtype), 0
            for i, w in enumerate(WIDTHS):
                here = conv[i * FILTERS : (i + 1) * FILTERS]
                here[:] = response[at : at + FILTERS]
                for k in range(1, min(w, total)):
                    later = response[at + k * FILTERS : at + (k + 1) * FILTERS, k:]
                    for j in range(k):
                        later[:, past[j][past[j] < total - k]] = 0
                    here[:, : total - k] += later
                at += w * FILTERS
            top = np.maximum.reduceat(conv, heads, axis=1)
            same = np.flatnonzero(conv >= np.repeat(top, counts, axis=1))
            row = np.arange(len(conv))[:, None] * total
            hit = (same[np.searchsorted(same, (row + heads).ravel())].reshape(top.shape) - row).T  # first position with the largest response
            pools = [top[i * FILTERS : (i + 1) * FILTERS].T + net.bias[w] for i, w in enumerate(WIDTHS)]
            where = [hit[:, i * FILTERS : (i + 1) * FILTERS] for i in range(len(WIDTHS))]
            pool = np.maximum(np.concatenate(pools, 1), 0)
            p = 1 / (1 + np.exp(-(pool @ net.out + net.out_bias)))
            err = ((p - y[own]) * weight[own] / len(own)).astype(np.float32)
            back = err[:, None] * net.out[None, :] * (pool > 0)
            touched, grads = [], []
            net.out = step("out", net.out, pool.T @ err + 1e-4 * net.out)
            net.out_bias = float(step("b", net.out_bias, float(err.sum())))
            for i, w in enumerate(WIDTHS):
                b = back[:, i * FILTERS : (i + 1) * FILTERS]
                g_tap = np.zeros_like(net.taps[w])
                for k in range(w):
                    seen_at = where[i] + k  # past the document's end is padding
                    ids = words[np.where(seen_at < ends[:, None], seen_at, total)]  # [docs, FILTERS, parts]
                    vec = net.emb[ids].sum(2)
                    g_tap[k] = np.einsum("nfd,nf->df", vec, b)
                    grad = (b[:, :, None] * net.taps[w][k].T[None]).reshape(-1, DIM)
                    for j in range(ids.shape[2]):
                        touched.append(ids[:, :, j].ravel())
                        grads.append(grad)
                net.bias[w] = step(f"c{w}", net.bias[w], b.sum(0))
                net.taps[w] = step(f"t{w}", net.taps[w], g_tap)
            # rows without a gradient stay as they are
            some, at = np.unique(np.concatenate(touched), return_inverse=True)
            every = np.concatenate(grads)
            g = np.stack([np.bincount(at, every[:, d], len(some)) for d in range(DIM)], 1).astype(np.float32)
            seen["emb"][some] += g * g
            net.emb[some] -= rate * g / np.sqrt(seen["emb"][some])
            net.emb[ROWS] = 0
    return net


def flat(net: ConvNet) -> np.ndarray:
    """The net's numbers in one row."""
    return np.concatenate([net.emb.ravel(), *(x.ravel() for w in WIDTHS for x in (net.taps[w], net.bias[w])), net.out, [net.out_bias]]).astype(np.float32)


def unflat(x: np.ndarray) -> ConvNet:
    """What flat wrote."""
    net, at = ConvNet(), 0

    def take(*shape):
        nonlocal at
        at += int(np.prod(shape))
        return x[at - int(np.prod(shape)) : at].reshape(shape).astype(np.float32)

    net.emb = take(ROWS + 1, DIM)
    for w in WIDTHS:
        net.taps[w], net.bias[w] = take(w, DIM, FILTERS), take(FILTERS)
    net.out, net.out_bias = take(FILTERS * len(WIDTHS)), float(x[-1])
    return net.multiply_out()


@dataclass
class Model:
    net: ConvNet
    thresholds: dict[str, float]  # by language
    threshold: float  # for other languages


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([words, parts] embedding rows, words per document)."""
    h, counts, starts = word_hashes(data, offsets)
    out = np.empty((len(h), len(PARTS)), np.int64)
    out[:, 0] = (h & np.uint64(ROWS - 1)).astype(np.int64)
    if len(h):
        padded = np.append(LOWER_LUT[data], np.zeros(max(PARTS), np.uint8))
        on = np.ones(len(h), bool)
        last = np.repeat(offsets[1:], counts)
        prefix = np.zeros(len(h), np.uint64)
        for i in range(max(PARTS)):
            byte = padded[starts + i]
            on &= ~SEPARATOR[byte] & (starts + i < last)
            prefix = prefix * np.uint64(0x9E3779B97F4A7C15) + np.where(on, byte, 0).astype(np.uint64)
            if i + 1 in PARTS:
                out[:, PARTS.index(i + 1)] = (mix(prefix + np.uint64(i)) & np.uint64(ROWS - 1)).astype(np.int64)
    return out, counts


#: Thresholds to choose from.
LIMITS = np.arange(0.5, 0.991, 0.02)


def calibrated(clean: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold with the best F1, 0.5 where all are alike. clean, toxic: rows of either class by the number of LIMITS that their score reaches."""
    best, at = -1.0, 0.5
    for i, t in enumerate(LIMITS):
        f1 = 2 * toxic[i + 1 :].sum() / max(1, toxic[i + 1 :].sum() + clean[i + 1 :].sum() + toxic.sum())
        if f1 > best + 1e-9:
            best, at = f1, float(t)
    return at


def added_up(df: DataFrame, kind: type) -> dict[int, np.ndarray]:
    """The sums of the arrays x of df(fold, part, x) by fold, in two steps, so that no task and not the driver holds more than a few."""
    import pyarrow as pa

    def run(key, t):
        total = 0
        for x in t.column("x"):
            total = total + np.frombuffer(x.as_buffer(), kind).astype(np.float64)
        return pa.table({"fold": pa.array([t.column("fold")[0].as_py()], pa.int32()), "x": pa.array([total.astype(kind).tobytes()], pa.binary())})

    some = materialize(df.groupBy("fold", F.pmod("part", F.lit(16)).alias("slot")).applyInArrow(run, "fold int, x binary"), "sums")
    return {r.fold: np.frombuffer(bytes(r.x), kind) for r in some.groupBy("fold").applyInArrow(run, "fold int, x binary").collect()}  # a row for each of two folds


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, toxic): the documents to learn from, their texts packed, as the join exchanges those of all documents outside the held-out fold."""
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    known = labels.where((fold(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    language = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    rows = docs.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", text.alias("text"), language.alias("lang"), F.xxhash64(text).alias("hash"))
    schema = StructType([rows.schema["doc_id"], StructField("text", BinaryType()), StructField("lang", StringType()), StructField("hash", LongType())])
    rows = rows.mapInArrow(packed, schema).join(known, "doc_id")
    # of rows with one id the one whose text has the least hash, so that fits don't differ between runs
    one = F.min_by(F.struct("text", "lang", "toxic"), F.struct("hash", "lang"))
    return rows.groupBy("doc_id").agg(one.alias("r")).select("doc_id", "r.text", "r.lang", (F.col("r.toxic") > 0).cast("int").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, share: int = SHARE) -> Model:
    """Learns from every labelled document whose crc32 fold is not 0.

    Rows are dealt to parts of about ``share`` documents by the hash of their id, and parts to two folds. Each part fits a net from its fold's start, with the word counts of the whole fold; the nets are averaged, weighted by their documents.
    Thresholds are calibrated over all these rows, each scored by the other fold's net. With fewer than ten rows, or one class only in a fold, there is nothing to fit: every score is the same, about 0.12, and nothing is rejected.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    rows = materialize(labelled(docs, labels), "labelled")
    parts = 2 * max(1, round(rows.count() / share / 2))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).withColumn("fold", F.col("part") % 2)
    classes = {(r.fold, r.toxic): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    if sum(classes.values()) < 10 or len(classes) < 4:
        net = ConvNet()
        net.emb, net.taps = np.zeros((ROWS + 1, DIM), np.float32), {w: np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS}
        net.bias, net.out, net.out_bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS), np.float32), -2.0
        return Model(net.multiply_out(), {}, 0.5)
    shares = [classes[f, 1] / (classes[f, 0] + classes[f, 1]) for f in (0, 1)]

    def prepared(t):
        """(words of each document, class) of a part, by id."""
        tidy()
        t = t.select(["doc_id", "text", "toxic"]).sort_by("doc_id")
        out = []
        for b in unpacked(t.to_batches(), SLICE):
            words, counts = hashed(*buffer_of(b.column("text")))
            out += np.split(words.astype(np.uint16), np.cumsum(counts)[:-1])
        return out, t.column("toxic").to_numpy().astype(float)

    def row(t, x):
        first = [t.column(c)[0].as_py() for c in ("fold", "part")]
        return pa.table({"fold": pa.array(first[:1], pa.int32()), "part": pa.array([first[1] // 2], pa.int32()), "x": pa.array([x.tobytes()], pa.binary())})

    def count(key, t):
        seen = np.zeros((2, ROWS + 1))
        for d, toxic in zip(*prepared(t), strict=True):
            seen[int(toxic)][np.unique(d)] += 1
        return row(t, seen.astype(np.int64))

    by_part = rows.groupBy("part")
    seen = added_up(by_part.applyInArrow(count, "fold int, part int, x binary"), np.int64)
    begin = spark.sparkContext.broadcast([start(seen[f].reshape(2, -1)[1], seen[f].reshape(2, -1)[0], shares[f]) for f in (0, 1)])

    def learn(key, t):
        each, y = prepared(t)
        f = t.column("fold")[0].as_py()
        return row(t, np.append(flat(fit(begin.value[f], each, y, shares[f])), 1).astype(np.float32) * np.float32(len(y)))

    total = added_up(by_part.applyInArrow(learn, "fold int, part int, x binary"), np.float32)
    others = spark.sparkContext.broadcast([unflat(total[1 - f][:-1] / total[1 - f][-1]) for f in (0, 1)])

    def reached(batches):
        for b in unpacked(batches, SLICE):
            words, counts = hashed(*buffer_of(b.column("text")))
            which, at = b.column("fold").to_numpy(), np.repeat(b.column("fold").to_numpy(), counts)
            got = np.zeros(len(which))
            for f in (0, 1):
                got[which == f] = others.value[f].score(words[at == f], counts[which == f])
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), pa.array(np.searchsorted(LIMITS, got, "right"), pa.int64())], names=["lang", "toxic", "reach"])

    table: dict[str | None, np.ndarray] = {}
    for r in rows.mapInArrow(reached, "lang string, toxic int, reach long").groupBy("lang", "toxic", "reach").count().collect():  # a few rows for each language
        table.setdefault(r.lang, np.zeros((2, len(LIMITS) + 1)))[r.toxic, r.reach] += r["count"]
    by = {x: calibrated(*t) for x, t in table.items() if x and t[1].sum() >= 5}
    return Model(unflat((total[0] + total[1])[:-1] / (total[0] + total[1])[-1]), by, calibrated(*sum(table.values())))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with a column ``name`` (0 to 1) from the text alone, in place of one of that name; other columns and all rows stay. Null and empty texts get the score of no words."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    net = docs.sparkSession.sparkContext.broadcast(model.net)
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in slices(batches, SLICE):
            words, counts = hashed(*buffer_of(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(net.value.score(words, counts))], schema=arrow)

    return docs.mapInArrow(run, schema)


def reject(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs whose score stays under the threshold of their language."""
    model = model or train(docs, labels)
    limit = F.lit(model.threshold)
    for lang, t in model.thresholds.items() if "lang" in docs.columns else ():
        limit = F.when(F.col("lang") == lang, F.lit(t)).otherwise(limit)
    name = "_toxicity"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return score(docs, model, name=name).where(F.col(name) < limit).drop(name)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(spread(docs.select("doc_id", "text")), model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )
