"""Removal of byte passages that documents with smaller ids hold, over a multi-document suffix order.

1. Strings of MATCH bytes are dealt out by the least hash of their M-byte parts (their anchor): equal strings
   have the same anchor. Anchors of one document only are dropped; copies of whole texts take no part.
2. Neighbouring strings with one anchor form a piece of fewer than MATCH + RUN bytes. The distinct pieces
   of a bucket are a collection whose suffix order is built column by column: each round inserts one symbol of
   every piece, from the right, into the collection's Burrows-Wheeler transform and updates the
   common prefixes at the places of insertion, reading and writing sequential files.
3. In the finished order, neighbours with a common prefix of at least MATCH bytes are equal strings; those that also
   start in a document with a smaller id mark their bytes.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import buffer_of, documents, materialize, mix, ranges, slices, spread, tidy, workers

MATCH, M, RUN = 50, 20, 32
WINDOW = MATCH - M + 1
#: Strings whose anchors are looked for at once.
BLOCK = 1 << 14
BASE = 0x9E3779B97F4A7C15
#: Bytes of text in one part of the documents; anchors and bytes of pieces in one bucket.
PART, ANCHORS, PIECES = 12 << 20, 1_500_000, 12 << 20
#: Collections that a bin is worked through as, one after the other, so that their columns stay in the cache.
SUB = 24


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """The least (or greatest) of each w neighbours, by doubling."""
    f = np.minimum if least else np.maximum
    have = 1
    while have < w:
        step = min(have, w - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


def hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every M bytes: of their three words of eight bytes, which overlap."""
    words = np.ascontiguousarray(np.ndarray((len(data) - 7,), np.dtype("<u8"), np.ascontiguousarray(data), 0, (1,))).astype(np.uint64, copy=False)
    n = len(data) - M + 1
    x = words[:n] * np.uint64(BASE)
    for at in (8, M - 8):
        x ^= x >> np.uint64(32)
        x += words[at : at + n]
        x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring MATCH-byte strings of one document with one anchor: (first start, strings, document, anchor) of each."""
    n, size = len(data) - MATCH + 1, np.diff(offsets)
    some = np.flatnonzero(size >= MATCH)
    begin, end = offsets[:-1][some], offsets[1:][some] - MATCH + 1
    if not len(some):
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, np.uint64)
    least, new = np.empty(n, np.uint64), np.zeros(n + 1, bool)
    for lo in range(0, n, BLOCK):  # what a block needs stays in the cache
        hi = min(lo + BLOCK, n)
        least[lo:hi] = sliding(hashes(data[lo : hi + MATCH - 1]), WINDOW, True)
        at = max(lo, 1)
        np.not_equal(least[at:hi], least[at - 1 : hi - 1], out=new[at:hi])
    # runs begin where documents do, and end where their last string does
    new[begin] = new[end] = True
    first = np.flatnonzero(new)
    place = np.searchsorted(begin, first, "right") - 1
    inside = (place >= 0) & (first < end[place])
    count = np.diff(np.append(first, n + 1))[inside]
    first = first[inside]
    return first, count, some[place[inside]], least[first]


def collection_order(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, common prefix with the one before) of all suffixes of at least one byte, in suffix order.

    Suffixes that are equal to their end are ordered by length of the rest being absent, then by piece.
    """
    r = len(pieces)
    size = np.array([len(p) for p in pieces], np.int64)
    longest = int(size.max()) if r else 0
    cols = np.zeros((r, longest + 1), np.uint8)  # cols[i, j]: the j-th symbol from the right
    for i, p in enumerate(pieces):
        cols[i, : len(p)] = np.frombuffer(p, np.uint8)[::-1]
    # symbols as ranks from 1; 0 ends a piece
    used = np.unique(cols[np.arange(longest + 1)[None, :] < size[:, None]])
    rank = np.zeros(256, np.uint8)
    rank[used] = np.arange(1, len(used) + 1)
    cols = np.where(np.arange(longest + 1)[None, :] < size[:, None], rank[cols], 0).astype(np.uint8)
    with tempfile.TemporaryFile(buffering=0) as bwt_file, tempfile.TemporaryFile(buffering=0) as lcp_file:

        def put(f, a):
            f.seek(0)
            f.write(a.data)

        def get(f, n):
            f.seek(0)
            return np.frombuffer(f.read(n), np.uint8)

        # round 0: the empty suffix of every piece
        put(bwt_file, cols[:, 0].copy())
        put(lcp_file, np.zeros(r, np.uint8))
        total = r
        who, p = np.arange(r), np.arange(r)  # pieces that go on, by the place of their last suffix
        for j in range(1, longest + 1):
            on = size[who] >= j
            who, p = who[on], p[on]
            bwt, lcp = get(bwt_file, total), get(lcp_file, total)
            # A new suffix is c + the last one: the order is that of (c, place of the last one), after the r empty
            # suffixes. All entries with a symbol stand in it already, but for those of the last round.
            here = np.argsort(bwt, kind="stable")[len(bwt) - np.count_nonzero(bwt) :]
            new = np.zeros(len(bwt), bool)
            new[p] = True
            k = np.flatnonzero(new[here])
            who = who[np.searchsorted(p, here[k])]
            p = r + k
            total = r + len(here)
            keep = np.ones(total, bool)
            keep[p] = False
            # common prefixes where something was inserted: of each new one with the one before, and of the one after it with it
            flag = np.zeros(len(here) + 1, bool)
            flag[k] = True
            flag[k + 1] = True
            touched = np.flatnonzero(flag[:-1])
            inner = touched[touched > 0]
            x, y = here[inner - 1], here[inner]
            same = bwt[x] == bwt[y]
            value = np.zeros(len(touched), np.uint8)
            if same.any():
                lo, hi = x[same] + 1, y[same] + 1
                by = np.argsort(lo, kind="stable")
                pairs = np.empty(2 * len(lo), np.int64)
                pairs[0::2], pairs[1::2] = lo[by], hi[by]
                least = np.empty(len(lo), np.uint8)
                least[by] = np.minimum.reduceat(np.append(lcp, np.uint8(0)), pairs)[0::2]
                v = np.zeros(len(inner), np.uint8)
                v[same] = np.minimum(least, 253) + 1
                value[len(touched) - len(inner) :] = v
            nb, nl = np.empty(total, np.uint8), np.empty(total, np.uint8)
            nb[keep], nl[keep] = bwt, lcp
            nb[p] = cols[who, j]
            nl[r + touched] = value
            put(bwt_file, nb)
            put(lcp_file, nl)
        bwt, lcp = get(bwt_file, total), get(lcp_file, total)
    # Walking back from each piece's end gives the suffix at every place.
    ended = len(bwt) - np.count_nonzero(bwt)
    step = np.empty(len(bwt), np.int32)
    step[np.argsort(bwt, kind="stable")] = np.arange(-ended, len(bwt) - ended, dtype=np.int32) + r
    piece, length = np.zeros(len(bwt), np.int32), np.zeros(len(bwt), np.uint8)
    who = p = np.arange(r)
    for j in range(1, longest + 1):
        on = size[who] >= j
        who, p = who[on], step[p[on]]
        piece[p], length[p] = who, j
    piece, length = piece[r:].astype(np.int64), length[r:]
    return piece, size[piece] - length, np.minimum(lcp[r:], length)


def whole_copies(right) -> set[bytes]:
    """The (id, half digest) pairs of a part's packed copies."""
    raw = b"".join(x for x in right.column("later").to_pylist() if x)
    return {raw[i : i + 24] for i in range(0, len(raw), 24)}


def without(left, right):
    """The rows of a part that are not whole copies."""
    import pyarrow as pa

    gone = whole_copies(right)
    if not gone:
        return left
    keep = [i.to_bytes(8, "big", signed=True) + d[:16] not in gone for i, d in zip(left.column("id").to_pylist(), left.column("digest").to_pylist(), strict=True)]
    return left.filter(pa.array(keep, pa.bool_()))


def removed_spans(rows: DataFrame, copies: DataFrame, total: int) -> DataFrame:
    """(part, ids, lo, hi): packed spans [lo, hi) of bytes to remove. rows: (id long, part int, digest, text); copies: (part, later), the packed (id, first half of the digest) of whole copies, which take no part."""
    import pyarrow as pa

    buckets = max(workers(rows), int(total * 2 / WINDOW) // ANCHORS + 1)

    def name(a: np.ndarray) -> np.ndarray:
        return (a >> np.uint64(32)).astype(np.uint32)

    def bucket_of(a: np.ndarray) -> np.ndarray:
        return ((a & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)

    def grouped(keys: np.ndarray, *arrays: np.ndarray):
        order = np.argsort(keys, kind="stable")
        names, heads = np.unique(keys[order], return_index=True)
        for k, lo, hi in zip(names.tolist(), heads, np.append(heads, len(keys))[1:], strict=True):
            yield k, [a[order[lo:hi]] for a in arrays]

    def find(key, left, right):
        """A part's anchors, each once, with whether several ids of the part have it; however many documents share an anchor, a part sends it once. An id is in one part only."""
        own: list[tuple[np.ndarray, np.ndarray]] = []
        for b in slices(without(left, right).to_batches()):
            ids = b.column("id").to_numpy()
            _, _, doc, a = anchors(*buffer_of(b.column("text")))
            own.append((a, ids[doc]))
        a, ids = (np.concatenate([x[i] for x in own]) if own else np.zeros(0, kind) for i, kind in ((0, np.uint64), (1, np.int64)))
        del own
        order = np.argsort(a, kind="stable")
        a, ids = a[order], ids[order]
        heads = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
        least, most = (f.reduceat(ids, heads) if len(a) else ids for f in (np.minimum, np.maximum))
        a, more = a[heads], least != most
        outs = [(k, x[0], np.packbits(x[1])) for k, x in grouped(bucket_of(a), name(a), more)]
        return pa.table({"bucket": pa.array([o[0] for o in outs], pa.int32()), **{c: pa.array([o[i].tobytes() for o in outs], pa.binary()) for i, c in enumerate(("anchor", "more"), 1)}, "part": pa.array([key[0].as_py()] * len(outs), pa.int32())})

    def several(key, t):
        """The anchors of a bucket that at least two documents have, for each part that has them."""
        bucket = key[0].as_py()
        get = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        a, size = get("anchor", np.uint32), [len(x) // 4 for x in t.column("anchor").to_pylist()]
        more = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t.column("more").to_pylist(), size, strict=True)]) if size else np.zeros(0, np.uint8)
        part = np.repeat(t.column("part").to_numpy(), size)
        order = np.argsort(a, kind="stable")
        a, more, part = a[order], more[order], part[order]
        new = np.append(True, a[1:] != a[:-1]) if len(a) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        many = (np.diff(np.append(heads, len(a))) > 1) | (np.maximum.reduceat(more, heads) > 0) if len(a) else np.zeros(0, bool)
        keep = np.repeat(many, np.diff(np.append(heads, len(a))))
        full = (a[keep].astype(np.uint64) << np.uint64(32)) + np.uint64(bucket)
        out = [(p, np.unique(x)) for p, (x,) in grouped(part[keep].astype(np.int64), full)]
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "live": pa.array([x.tobytes() for _, x in out], pa.binary())})

    found = rows.groupBy("part").cogroup(copies.groupBy("part")).applyInArrow(find, "bucket int, anchor binary, more binary, part int")
    live = materialize(found.groupBy("bucket").applyInArrow(several, "part int, live binary"), "anchors")
    known_ = live.select("part", "live", F.lit(None).cast("binary").alias("later")).unionByName(copies.select("part", F.lit(None).cast("binary").alias("live"), "later"))
    sizes = live.agg(F.sum(F.octet_length("live"))).first()[0] or 0
    bins = max(workers(rows), int(sizes / 8 * 70) // PIECES + 1)

    def cut(key, left, right):
        """Pieces of a part's documents: (bin, piece bytes, their lengths, documents, starts), equal ones only for the least id of the part. The others lose them wholly, as
        that document has them too: they go along as spans, rows without bytes, whose subs are their ends."""
        known = np.unique(np.frombuffer(b"".join(x for x in right.column("live").to_pylist() if x), np.uint64))
        outs, raw, held = [], [], []
        for b in slices(without(left, right).to_batches(), bytes_=2 << 20) if len(known) else ():
            data, offsets = buffer_of(b.column("text"))
            ids = b.column("id").to_numpy()
            start, count, doc, a = anchors(data, offsets)
            full = (name(a).astype(np.uint64) << np.uint64(32)) + bucket_of(a).astype(np.uint64)
            i = np.minimum(np.searchsorted(known, full), len(known) - 1)
            on = known[i] == full
            start, count, doc, a = start[on], count[on], doc[on], a[on]
            if not len(a):
                continue
            # pieces of RUN strings at most
            many = (count + RUN - 1) // RUN
            whole = np.repeat(np.arange(len(a)), many)
            step = RUN * ranges(np.zeros(len(a), np.int64), many)
            lo, count, doc, a = start[whole] + step, np.minimum(count[whole] - step, RUN), doc[whole], a[whole]
            length = (count + MATCH - 1).astype(np.uint8)
            ln = length.astype(np.int64)
            raw.append(data[np.repeat(lo - (np.cumsum(ln) - ln), ln) + np.arange(ln.sum())].tobytes())
            h = mix(a)
            held.append((length, ids[doc], (lo - offsets[doc]).astype(np.uint32), (h % np.uint64(bins)).astype(np.int64), ((h // np.uint64(bins)) % np.uint64(SUB)).astype(np.uint8)))
        if held:
            whole = b"".join(raw)
            del raw
            length, ids, start, bin_, sub = (np.concatenate([x[i] for x in held]) for i in range(5))
            part, ln = key[0].as_py(), length.astype(np.int64)
            ends = np.cumsum(ln)
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(whole[e - n : e], len(number)) for e, n in zip(ends.tolist(), ln.tolist(), strict=True)], np.int64)
            least = np.full(len(number), np.iinfo(np.int64).max)
            np.minimum.at(least, which, ids)
            del number
            first = ids == least[which]
            view = np.frombuffer(whole, np.uint8)
            for k, (h,) in grouped(bin_[first], np.flatnonzero(first)):
                n = ln[h]
                index = np.repeat(ends[h] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
                outs.append((k, view[index].tobytes(), length[h].tobytes(), ids[h].tobytes(), start[h].tobytes(), np.full(len(h), part, np.int32).tobytes(), sub[h].tobytes()))
            h = np.flatnonzero(~first)
            if len(h):
                outs.append((part % bins, None, b"", ids[h].tobytes(), start[h].tobytes(), np.full(1, part, np.int32).tobytes(), (start[h] + length[h]).astype(np.uint32).tobytes()))
        return pa.table({"bin": pa.array([o[0] for o in outs], pa.int32()), **{c: pa.array([o[i] for o in outs], pa.binary()) for i, c in enumerate(("bytes", "lengths", "ids", "starts", "parts", "subs"), 1)}})

    def mark(key, t):
        """Spans of a bin's pieces whose strings also start in a document with a smaller id."""
        tidy(16 << 20)  # the rounds' arrays are reused
        spans = t.filter(pa.compute.is_null(t.column("bytes")))
        t = t.filter(pa.compute.is_valid(t.column("bytes")))
        get = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        raw, length, ids, start, part = b"".join(t.column("bytes").to_pylist()), get("lengths", np.uint8).astype(np.int64), get("ids", np.int64), get("starts", np.uint32), get("parts", np.int32)
        ends, sub = np.cumsum(length), get("subs", np.uint8)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _, (own,) in grouped(sub.astype(np.int64), np.arange(len(sub))):
            distinct: dict[bytes, int] = {}
            which = np.array([distinct.setdefault(raw[e - n : e], len(distinct)) for e, n in zip(ends[own].tolist(), length[own].tolist(), strict=True)], np.int64)
            least = np.full(len(distinct), np.iinfo(np.int64).max)
            np.minimum.at(least, which, ids[own])
            piece, offset, common = collection_order(list(distinct))
            size = np.array([len(x) for x in distinct])
            whole = size[piece] - offset >= MATCH
            # a run of suffixes with common prefixes of MATCH bytes; shorter suffixes stand between no two of a run
            group = np.cumsum(common < MATCH)
            first = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, group[whole], least[piece[whole]])
            earliest = np.full((len(distinct), RUN), np.iinfo(np.int64).max)
            earliest[piece[whole], offset[whole]] = first[group[whole]]
            hit = earliest[which] < ids[own][:, None]  # [pieces, RUN]
            edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            x, lo = np.nonzero(edge == 1)
            found.append((own[x], lo, np.nonzero(edge == -1)[1]))
        tidy()
        at, lo, hi = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        out = list(grouped(part[at].astype(np.int64), ids[at], (start[at] + lo).astype(np.uint32), (start[at] + hi + MATCH - 1).astype(np.uint32)))
        done = [[np.frombuffer(p, np.int32)[0] for p in spans.column("parts").to_pylist()], *(spans.column(c).to_pylist() for c in ("ids", "starts", "subs"))]
        return pa.table({"part": pa.array([*(p for p, _ in out), *done[0]], pa.int32()), **{c: pa.array([*(x[i].tobytes() for _, x in out), *done[i + 1]], pa.binary()) for i, c in enumerate(("ids", "lo", "hi"))}})

    pieces = rows.groupBy("part").cogroup(known_.groupBy("part")).applyInArrow(cut, "bin int, bytes binary, lengths binary, ids binary, starts binary, parts binary, subs binary")
    return materialize(pieces.groupBy("bin").applyInArrow(mark, "part int, ids binary, lo binary, hi binary"), "spans")


def dedup_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    A null text is empty; texts under MATCH bytes lose nothing. Rows that repeat an id have no smaller id
    in each other, so neither loses to the other; rows with a null id come last, as the largest id. Other columns are not read.
    """
    import pyarrow as pa

    src = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(workers(docs), int(total // PART) + 1)
    id_ = F.coalesce("doc_id", F.lit(2**63 - 1))
    keyed = src.select(id_.alias("id"), F.col("doc_id").isNull().alias("no_id"), F.pmod(F.xxhash64(id_), F.lit(parts)).cast("int").alias("part"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.octet_length("text").alias("n"), "text")
    # copies of a whole text: only the one with the least id takes part
    heads = materialize(keyed.where(f"n >= {MATCH}").select("id", "part", "digest"), "digests")
    least = heads.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    pair = F.concat(F.expr("unhex(lpad(hex(id), 16, '0'))"), F.substring("digest", 1, 16))
    copies = materialize(heads.join(least, "digest").where("id <> first").select("part", pair.alias("pair")).distinct().groupBy("part").agg(F.expr("unhex(array_join(transform(collect_list(pair), x -> hex(x)), ''))").alias("later")), "later")
    spans = removed_spans(keyed.where(f"n >= {MATCH}").select("id", "part", "digest", "text"), copies, total)
    right = spans.withColumn("later", F.lit(None).cast("binary")).unionByName(copies, allowMissingColumns=True)

    def cut_out(key, left, right):
        get = lambda c, kind: np.frombuffer(b"".join(x for x in right.column(c).to_pylist() if x), kind)
        ids, lo, hi = get("ids", np.int64), get("lo", np.uint32), get("hi", np.uint32)
        gone_ = whole_copies(right)
        order = np.argsort(ids, kind="stable")
        ids, lo, hi = ids[order], lo[order], hi[order]
        cols: list[list] = [[] for _ in range(6)]
        for i, no_id, digest, t in zip(left.column("id").to_pylist(), left.column("no_id").to_pylist(), left.column("digest").to_pylist(), left.column("text").to_pylist(), strict=True):
            raw = np.frombuffer(t.encode(), np.uint8)
            a, b = np.searchsorted(ids, [i, i + 1 if i < 2**63 - 1 else i], "left") if i < 2**63 - 1 else (np.searchsorted(ids, i), len(ids))
            edge = np.zeros(len(raw) + 1, np.int32)
            if len(raw) >= MATCH and i.to_bytes(8, "big", signed=True) + digest[:16] in gone_:
                edge[0], edge[-1] = 1, -1
            elif a < b:
                np.add.at(edge, lo[a:b].astype(np.int64), 1)
                np.add.at(edge, hi[a:b].astype(np.int64), -1)
            gone = np.cumsum(edge)[:-1] > 0
            rest = raw[~gone].tobytes()
            for c, v in zip(cols, (None if no_id else i, len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest(), rest), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), cols, kinds, strict=True)})

    marked = keyed.select("id", "no_id", "digest", "part", "text")
    return marked.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(documents(spark, sf_dir)).drop("kept")


#: Every string of 50 bytes in hexadecimal with the least id that has it; runs of covered bytes are islands. For small tables.
SQL = """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), p as (
  select doc_id, unnest(range(0, len(h) // 2 - 49)) as p, h from d
), q as (
  select doc_id, p, substr(h, 2 * p + 1, 100) as x from p
), hit as (
  select q.doc_id, p from q join (select x, min(doc_id) as first from q group by x having count(*) > 1) f on q.x = f.x where f.first < q.doc_id
), g as (
  select doc_id, p, sum(case when p <= before + 50 then 0 else 1 end) over (partition by doc_id order by p) as run
  from (select doc_id, p, coalesce(lag(p) over (partition by doc_id order by p), -100) as before from hit)
), run as (
  select doc_id, min(p) as lo, max(p) + 50 as hi from g group by doc_id, run
), runs as (
  select doc_id, sum(hi - lo) as gone, count(*) as n, list_sort(list({'lo': lo, 'hi': hi})) as r from run group by doc_id
)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, cast(coalesce(n, 0) as bigint) as n_spans,
       sha256(unhex(case when r is null then h else substr(h, 1, 2 * r[1].lo) || array_to_string([substr(h, 2 * r[i].hi + 1, 2 * (case when i < len(r) then r[i+1].lo else len(h) // 2 end - r[i].hi)) for i in range(1, len(r) + 1)], '') end)) as kept_sha256
from d left join runs using (doc_id)
"""
