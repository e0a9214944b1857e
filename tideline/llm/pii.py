"""Personal data: high-recall generators propose overlapping spans, boosted trees with calibrated thresholds choose.

Kinds: email, ip, card, phone. The four base patterns always count; generators add looser
forms (spelled-out addresses, numbers with other separators, national phone formats), which are
kept only where the trees, trained here on generated examples with hard negatives,
pass the threshold of their kind.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.boosting import BoostedTrees
from tideline.llm.common import documents, spread

KINDS = ("email", "ip", "card", "phone")
MAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Every number-like match lies in one run of these characters and begins at its first digit or a plus before a digit.
RUN = re.compile(r"\+?[0-9][0-9 ().+-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # the same matches as without the possessive marks, in linear time
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE_MAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\(\[{](?:at|AT)[\)\]}]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\(\[{](?:dot|DOT)[\)\]}])\s?[A-Za-z0-9-]{1,63}){1,4}")
LOOSE_CARD = re.compile(r"[0-9]{4}(?:[ .-]{1,2}[0-9]{4}){2,3}(?:[ .-]{1,2}[0-9]{1,3})?")
LOOSE_PHONE = re.compile(r"(?<![0-9.+])(?:\+?[0-9]{1,3}[ .-]?\(|1[ .-])?[0-9]{3}(?:\) ?|[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| \. )[0-9]{1,3}){3}(?![0-9])")
WORDS = {"email": ("mail", "contact", "write", "correo", "courriel"), "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"), "phone": ("phone", "tel", "call", "mobile", "fax", "anruf"), "ip": ("ip", "host", "server", "address", "addr", "adresse"), "other": ("version", "isbn", "order", "invoice", "page", "serial", "license", "section", "no.", "ref")}
CONTEXT = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_emails(t: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the base email pattern: only the run before each @ can begin one."""
    out, done, q = [], 0, t.find("@")
    while q >= 0:
        s = q
        while s > done and t[s - 1] in LOCAL:
            s -= 1
        m = MAIL_REST.match(t, q) if s < q else None
        if m:
            out.append((s, m.end()))
            done = m.end()
        q = t.find("@", max(q + 1, done))
    return out


def base_spans(t: str) -> list[list[tuple[int, int]]]:
    """Spans of the base patterns, a list for each kind of KINDS."""
    out: list[list[tuple[int, int]]] = [base_emails(t) if "@" in t else [], [], [], []]
    for run in RUN.finditer(t):
        a, b = run.span()
        if b - a < 7:
            continue
        s = run.group()
        if s.count(".") >= 3:
            for m in IP.finditer(t, a, b):
                if all(len(x) < 4 and int(x) < 256 if len(x) < 20 else not x.strip("0") for x in (p.lstrip("0") or "0" for p in m.group().split("."))):
                    out[1].append(m.span())
        if b - a >= 16:
            for m in CARD.finditer(t, a, b):
                d = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(d) <= 19 and luhn(d):
                    out[2].append(m.span())
        if "+" in s:
            for m in PHONE.finditer(t, a, b):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out[3].append(m.span())
    return out


def candidates(t: str) -> list[tuple[int, int, int]]:
    """Looser proposals (kind, start, end); they may overlap."""
    out = []
    if "(at)" in (low := t.lower() if "at" in t or "AT" in t else "") or "[at]" in low or "{at}" in low:
        out += [(0, *m.span()) for m in LOOSE_MAIL.finditer(t)]
    if "." in t or "dot" in t:
        out += [(1, *m.span()) for m in LOOSE_IP.finditer(t) if all(int(x) < 256 for x in re.findall("[0-9]+", m.group()))]
    for run in RUN.finditer(t):
        a, b = run.span()
        if b - a >= 12:
            a = max(0, a - 1)
            out += [(2, *m.span()) for m in LOOSE_CARD.finditer(t, a, b)]
            out += [(3, *m.span()) for m in LOOSE_PHONE.finditer(t, a, b)]
    return out


def features(t: str, kind: int, a: int, b: int) -> list[float]:
    s, before, after = t[a:b], t[max(0, a - CONTEXT) : a].lower(), t[b : b + CONTEXT].lower()
    digits = [c for c in s if "0" <= c <= "9"]
    groups = re.findall(r"[0-9]+", s)
    out = [float(kind == 0), float(kind == 1), float(kind == 2), float(kind == 3), float("[" in s or "dot" in s), len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0)]
    out += [len(set(digits)), float(luhn("".join(digits))) if digits else 0.0, float("(" in s), s.count("-"), s.count("."), s.count(" ")]
    out += [float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in {"$", "#", "=", "/", ":"} and bool(before)), float(any(c.isdigit() for c in before[-3:])), float(any(c.isdigit() for c in after[:3]))]
    return out + [float(any(w in before or w in after for w in words)) for words in WORDS.values()]


def generated_examples(n: int = 2400, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of generated candidates: half personal data, half hard negatives in like formats."""
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    filler = lambda: " ".join("".join(pick(*"aeinorstlhd") for _ in range(int(rng.integers(2, 8)))) for _ in range(int(rng.integers(2, 5))))

    def card() -> str:
        body = d(15)
        return body + next(str(i) for i in range(10) if luhn(body + str(i)))

    x, y, kinds = [], [], []
    while len(x) < n:
        good, kind = bool(rng.integers(2)), int(pick(0, 1, 2, 3))
        near = pick("", *WORDS[KINDS[kind]]) if good else pick("", "", *WORDS["other"])
        if kind == 0:
            s = f"{filler().split()[0]}{pick('', d(1), d(2))}{pick(' (at) ', ' [at] ', '[at]')}{filler().split()[0]}{pick('.', ' [dot] ', ' (dot) ')}{pick('com', 'org', 'de', 'fr')}" if good else f"{pick('a', 'x', 'it')} (at) {filler().split()[0]} . {filler().split()[0]}"
        elif kind == 1:
            parts = [str(int(rng.integers(256))) for _ in range(4)]
            s = pick("[.]", "(.)", "[dot]", "(dot)").join(parts) if good else " . ".join(str(int(rng.integers(20))) for _ in range(4))
        elif kind == 2:
            c, sep = card(), pick(" ", ".", "--", ". ")
            if not good:
                c = d(16)
                if luhn(c):
                    continue
            s = sep.join(c[i : i + 4] for i in range(0, 16, 4))
        else:
            s = pick(f"{d(3)}) {d(3)}-{d(4)}", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}") if good else pick(f"{d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(3)} {d(4)}", f"{d(3)}.{d(3)} {d(4)}")
        t = f"{filler()} {near}{pick(' ', ': ') if near else ''}{s}{pick(' ', ', ', '. ')}{filler()}"
        for k, a, b in candidates(t):
            if k == kind:
                x.append(features(t, k, a, b))
                y.append(float(good))
                kinds.append(k)
    return np.array(x), np.array(y), np.array(kinds)


@lru_cache(1)
def model(precision: float = 0.995) -> tuple[BoostedTrees, dict[int, float]]:
    """The trees and the least score that reaches the precision, for each kind, on the held-out quarter."""
    x, y, kinds = generated_examples()
    held = np.arange(len(x)) % 4 == 3
    trees = BoostedTrees(rounds=40).fit(x[~held], y[~held])
    p, limits = trees.predict(x[held]), {}
    for k in range(4):
        own = kinds[held] == k
        score, label = p[own], y[held][own]
        order = np.argsort(-score)
        exact = np.cumsum(label[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(exact >= precision)
        limits[k] = max(0.5, float(score[order][good[-1]])) if len(good) else 1.01
    return trees, limits


def find_spans(t: str, trees: BoostedTrees, limits: dict[int, float]) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int]]]:
    """(base spans by kind, added spans): added ones overlap no other span."""
    base = base_spans(t)
    found = candidates(t)
    if not found:
        return base, []
    taken = [s for spans in base for s in spans]
    found = [c for c in found if all(c[2] <= a or c[1] >= b for a, b in taken)]
    if not found:
        return base, []
    p = trees.predict(np.array([features(t, *c) for c in found]))
    added: list[tuple[int, int, int]] = []
    for i in np.argsort(-p, kind="stable"):
        k, a, b = found[i]
        if p[i] >= limits[k] and all(b <= x or a >= y for _, x, y in added):
            added.append((k, a, b))
    return base, added


SCHEMA = "doc_id {id}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, span_list array<struct<kind:string,start:int,end:int>>"


def pii_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document with its spans (code points, end exclusive). Null and empty texts have no spans; repeated rows give repeated results; other columns are not read."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    trees, limits = model()
    schema = _parse_datatype_string(SCHEMA.format(id=docs.schema[doc_id].dataType.simpleString()))
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in batch.column(1).to_pylist():
                base, added = find_spans(t or "", trees, limits)
                first = [f"{KINDS[k]}:{a}:{b}" for k, spans in enumerate(base) for a, b in spans]
                every = sorted([(k, a, b) for k, spans in enumerate(base) for a, b in spans] + added)
                for c, v in zip(cols, (*map(len, base), hashlib.sha256(",".join(first).encode()).hexdigest(), ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in every), [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in every]), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *(pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:], strict=True))], schema=arrow)

    return spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, schema)


def redact_text(t: str | None, trees: BoostedTrees, limits: dict[int, float]) -> str | None:
    """t with each span replaced by its kind in brackets; spans that overlap become one, of the first kind."""
    if not t:
        return t
    base, added = find_spans(t, trees, limits)
    spans = sorted([(a, b, k) for k, own in enumerate(base) for a, b in own] + [(a, b, k) for k, a, b in added])
    if not spans:
        return t
    out, done, i = [], 0, 0
    while i < len(spans):
        a, b, k = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][1])
            i += 1
        out += [t[done:a], f"[{KINDS[k].upper()}]"]
        done = b
    return "".join([*out, t[done:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in its text replaced; all rows and columns stay."""
    trees, limits = model()

    @F.pandas_udf("string")
    def clean(s):
        return s.map(lambda t: redact_text(t, trees, limits))

    return docs.withColumn(text, clean(text))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(documents(spark, sf_dir)).drop("span_list")
