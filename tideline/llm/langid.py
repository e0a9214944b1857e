"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from labelled text. A document is parsed into phrases,
each the longest match found in the language's text; the language that needs the fewest
phrases wins. All documents of a batch walk the automata of a group of languages in
step, one character at a time, as one table lookup; more languages are more groups, one after the other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import documents, fold, spread

#: Labelled documents and letters that a language's automaton is built from, at most: those with the least hash of their id, of each a piece from a place that the hash gives.
SAMPLE_DOCS, SAMPLE_CHARS = 80, 24_000
#: Languages of one table.
GROUP = 32
#: Characters that a batch of texts is laid out for at a time; texts at once; bytes of text of a slice.
PART, WIDE, SLICE = 1500, 512, 8 << 20
TOP = 1 << 16


def _fold_table() -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased code or 0 if not a letter, is a letter) for the codes under 65536."""
    out = np.zeros(TOP + 1, np.uint32)
    for i in range(TOP):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out, out > 0


_TABLE: list = []


def codes(t: str) -> np.ndarray:
    """The letters of t in lower case, with one 0 for every run of other characters."""
    if not _TABLE:
        _TABLE.append(_fold_table()[0])
    raw = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _TABLE[0][np.minimum(raw, TOP)]
    high = raw >= TOP  # letters beyond the table stand for themselves
    if high.any():
        x = np.where(high & np.array([chr(c).isalpha() for c in raw]), raw, x)
    keep = x > 0
    keep[1:] |= x[:-1] > 0
    return x[keep]


def suffix_automaton(s: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of s (the published online construction)."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in s.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """The automata of all languages in one table: entry = next state, or with the top bit set a new phrase that begins at this symbol."""

    BREAK = np.int32(1 << 30)

    def __init__(self, texts: dict[str, np.ndarray]):
        self.langs = sorted(texts)
        symbols = np.unique(np.concatenate([*texts.values(), np.zeros(1, np.uint32)])) if texts else np.zeros(1, np.uint32)
        self.symbols = symbols
        self.width = w = len(symbols) + 1  # the last symbol is any that was never seen
        self.pad = w  # a column that leaves the state as it is
        tables, self.roots, base = [], [], 0
        for lang in self.langs:
            nxt = suffix_automaton(np.searchsorted(symbols, texts[lang]))
            root = np.full(w, base, np.int32)
            for c, to in nxt[0].items():
                root[c] = base + to
            t = np.tile(root | self.BREAK, (len(nxt), 1))
            t[0] = root | self.BREAK
            for s, moves in enumerate(nxt):
                if s:
                    for c, to in moves.items():
                        t[s, c] = base + to
            t = np.concatenate([t, np.arange(base, base + len(nxt), dtype=np.int32)[:, None]], 1)
            tables.append(t)
            self.roots.append(base)
            base += len(nxt)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def encode(self, x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.symbols, x), len(self.symbols) - 1)
        return np.where(self.symbols[at] == x, at, len(self.symbols)).astype(np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[texts, languages]: phrases that each text takes."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        width, mask = self.width + 1, np.int32(self.BREAK - 1)
        for lo in range(0, len(order), WIDE):
            own = [self.encode(texts[i]) for i in order[lo : lo + WIDE]]
            size = np.array([len(x) for x in own])
            state = np.repeat(np.array(self.roots, np.int32)[:, None], len(own), 1)
            count = np.zeros(state.shape, np.int64)
            for at in range(0, int(size[0]) if len(size) else 0, PART):
                m = int((size > at).sum())  # the longest come first
                grid = np.full((min(PART, int(size[0]) - at), m), self.pad, np.int32)
                for j, x in enumerate(own[:m]):
                    x = x[at : at + PART]
                    grid[: len(x), j] = x
                now, seen = state[:, :m], np.zeros((len(self.langs), m), np.int32)
                for row in grid:
                    v = self.table[now * width + row]
                    seen += v >> 30
                    now = v & mask
                state[:, :m] = now
                count[:, :m] += seen
            out[order[lo : lo + WIDE]] = count.T
        return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[Parser]:
    """Automata from bounded text of every language, out of the rows whose crc32 fold is not 2: of at most sample_docs documents, the ones with the least hash of their id, a
    piece of chars / 20 letters each, until there are chars letters. As many tables as GROUP languages need."""
    import pyarrow as pa

    known = docs.where((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    some = known.withColumn("h", F.xxhash64("doc_id")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample_docs)
    share = max(300, chars // 20)

    def cut(batches):
        for b in batches:
            pieces = []
            for t, h in zip(b.column("text").to_pylist(), b.column("h").to_pylist(), strict=True):
                x = codes(t)
                at = h % max(1, len(x) - share + 1)
                pieces.append(x[at : at + share].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("r"), pa.array(pieces, pa.binary())], names=["lang", "r", "piece"])

    texts: dict[str, list[np.ndarray]] = {}
    for r in some.select("lang", "r", "h", "text").mapInArrow(cut, "lang string, r int, piece binary").orderBy("lang", "r").toLocalIterator():  # sample_docs pieces of a language
        own = texts.setdefault(r.lang, [])
        if (n := sum(map(len, own))) < chars:
            own.append(np.frombuffer(bytes(r.piece), np.uint32)[: chars - n])
    langs = sorted(texts)
    return [Parser({k: np.concatenate(texts[k]) for k in langs[lo : lo + GROUP]}) for lo in range(0, len(langs), GROUP)]


def identify(docs: DataFrame, parsers: Parser | list[Parser], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score): the language with the fewest phrases, the alphabetically first on ties, and one minus the ratio of its phrases to the second's.

    Null texts, texts without a letter, and all texts if no language was learned, are ``und`` with score 0; a repeated row gives a repeated result.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    parsers = [parsers] if isinstance(parsers, Parser) else parsers
    schema = _parse_datatype_string(f"doc_id {docs.schema[doc_id].dataType.simpleString()}, text string, lang_pred string, best long, second long")
    arrow = to_arrow_schema(schema)

    def walk(shared, last):
        def run(batches):
            from tideline.llm.common import slices

            p = shared.value
            for batch in slices(batches, bytes_=SLICE):
                texts = [codes(t or "") for t in batch.column("text").to_pylist()]
                counts = p.phrases(texts)
                out = []
                for x, c, name, best, second in zip(texts, counts, *(batch.column(n).to_pylist() for n in ("lang_pred", "best", "second")), strict=True):
                    if x.any():
                        mine = [(int(c[i]), p.langs[i]) for i in np.argsort(c, kind="stable")[:2]] + [(best, name)] * (best is not None) + [(second, "\U0010ffff")] * (second is not None)
                        mine.sort()
                        best, name, second = *mine[0], mine[1][0] if len(mine) > 1 else None
                    out.append((name, best, second))
                body = pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text").cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(arrow.field(0).type), body, *(pa.array([o[j] for o in out], f) for j, f in enumerate((pa.string(), pa.int64(), pa.int64())))], schema=arrow)

        return run

    empty = [F.lit(None).cast(t).alias(n) for n, t in (("lang_pred", "string"), ("best", "long"), ("second", "long"))]
    x = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "text", *empty)
    for i, p in enumerate(parsers):
        x = x.mapInArrow(walk(docs.sparkSession.sparkContext.broadcast(p), i == len(parsers) - 1), schema)
    second = F.coalesce("second", F.col("best") + 1)
    return x.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce(1 - F.col("best") / second, F.lit(0.0)).alias("score"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs)).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
