"""Language-model scores by logistic context mixing over bits, and the add-one unigram score beside them.

A text is a sequence of tokens: a run of bytes that are no separators, and the separators after it; the last one ends with an end mark. Every symbol (byte or end
mark) is a path in a binary code tree (a Huffman code of the training text), and each bit of the path is predicted from how often training text went which way at
that node in hashed contexts of several kinds: the last two, three and four symbols of the token, the token so far, and the token so far with what came before it: how
the token before it ended, and the class of the last frequent word. Classes group the most frequent words by the documents that they share, so they tell languages and topics
apart. The predictions are mixed in the logistic domain by weights that a gate selects (how much is known at the node in the longer contexts), learned online over all training
tokens, each predicted as if it had not been counted itself, and then refined by an adaptive probability map.

Nothing has a fixed size but the weights and the map. A chunk of documents keeps its distinct tokens and the numbers of each document's tokens; counts of (context, symbol) go to
buckets by context and come back to the chunks that asked, as two logarithmic counts for every node of the symbol's path. All contexts depend on the last symbols of the token and on
the state before it, so each distinct combination of these with a symbol in a chunk, an event, is counted, learned from and predicted once, with the number of times that it occurs.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import M64, SEPARATOR, buffer_of, documents, fold, forget, materialize, mix, pack, powers, ranges, slices, small, spread, tidy, unpack, word_hashes, workers

#: Bytes of text in a chunk; bytes of text in all for each bucket of contexts.
CHUNK, BUCKET = 24 << 20, 64 << 20
END = 256
#: Contexts: so many symbols back within the token; and the last one with so many symbols and the token's state.
BACK, STATED = (2, 3, 5), 4
KINDS, DEEP = len(BACK) + 1, max(*BACK, STATED)
#: Frequent words and classes of these; states before a token: start of the text, line end, end of a sentence or clause, others.
FREQUENT, CLASSES, STATES = 64, 8, 4
ALIKE = 0.5
#: Logarithmic counts: the least count of each level.
LEVELS = np.array([0, 1, 2, 3, 4, 6, 10, 16, 28, 50, 100, 250, 700, 2500, 12000, 100000])
MEAN = np.array([0, 1, 2, 3, 4.8, 7.5, 12.5, 21, 38, 70, 160, 420, 1300, 5500, 35000, 300000])
#: Added to both counts of a node; observations that hold a weight where it starts; events in the first update; units, and events, expanded at once.
PRIOR, RIDGE, BATCH, WIDE, SLICE = 0.1, 10.0, 128, 8192, 16384
#: Buckets of the map; weight of its straight line in observations.
BUCKETS_MAP, LINE = 24, 30.0
BASE = 0x9E3779B97F4A7C15

BYTE = np.arange(256)
STRETCH = (np.log(MEAN[BYTE >> 4] + PRIOR) - np.log(MEAN[BYTE & 15] + PRIOR)).astype(np.float32)
#: The byte of a node without one of its own counts.
WITHOUT = np.where((BYTE >> 4 >= 1) & (BYTE >> 4 <= 4), BYTE - 16, BYTE).astype(np.uint8)
KNOWN = np.searchsorted([1, 4, 40], MEAN[BYTE >> 4] + MEAN[BYTE & 15], "right").astype(np.uint8)  # 0 to 3
GATES = 4 * 3 * 3
#: What a byte of the stated context, and of the longest and the next longest run of symbols, adds to the number of the gate.
GATE = tuple((np.minimum(KNOWN, most) * times).astype(np.uint8) for most, times in ((3, 9), (2, 3), (2, 1)))


def level(n: np.ndarray) -> np.ndarray:
    return (np.searchsorted(LEVELS, n, "right") - 1).astype(np.uint8)


class Coder:
    """A Huffman code of symbols, whose leaves are ranked in the order of the tree: a node is a range of ranks."""

    def __init__(self, counts: np.ndarray):
        heap = [(float(c) + 1.0, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        child, n = {}, len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            child[n] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], n, n))
            n += 1
        ranks: list[int] = []
        paths: list[list[tuple[int, int]]] = []
        stack: list[tuple[int, list[tuple[int, int]]]] = [(n - 1, [])]
        while stack:
            node, path = stack.pop()
            if node < len(counts):
                ranks.append(node)
                paths.append(path)
            else:
                stack += [(child[node][1], [*path, (node - len(counts), 1)]), (child[node][0], [*path, (node - len(counts), 0)])]
        self.symbol = np.array(ranks)
        self.rank = np.argsort(self.symbol)
        self.length = np.array([len(p) for p in paths])  # by rank
        self.begin = np.cumsum(self.length) - self.length
        self.node = np.array([x for p in paths for x, _ in p], np.int32)
        self.bit = np.array([x for p in paths for _, x in p], np.uint8)


# ---------------------------------------------------------------- tokens


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, document) of all tokens. An empty document is one token without bytes."""
    n = len(offsets) - 1
    apart = SEPARATOR[data]
    begins = ~apart
    if len(data):
        begins[1:] &= apart[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    count = np.diff(np.searchsorted(starts, offsets))
    doc = np.concatenate([np.repeat(np.arange(n), count), np.flatnonzero(count == 0)])
    begin = np.concatenate([starts, offsets[:-1][count == 0]])
    order = np.argsort(doc, kind="stable")
    begin, doc = begin[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    end = np.append(begin[1:], offsets[-1])
    end[last] = offsets[1:][doc[last]]
    return begin, end - begin, doc


def token_hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    up = powers(len(data), BASE)
    down = powers(len(data) + 1, pow(BASE, -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    return mix((sums[begin + length] - sums[begin]) * down[begin] + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def read_tokens(data: np.ndarray, offsets: np.ndarray, held_out: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bytes, hash, length and begin of each token, tokens of each document, whether it is held out) of some documents."""
    begin, length, doc = cut(data, offsets)
    return data, token_hashes(data, begin, length), length.astype(np.int32), begin.astype(np.int32), np.bincount(doc, minlength=len(offsets) - 1).astype(np.int32), held_out


def chunk_body(held: list[tuple[np.ndarray, ...]]) -> bytes:
    """A chunk's documents and distinct tokens, packed; held is emptied. Last tokens of documents, which an end mark follows, are others than equal ones before."""
    columns = [list(c) for c in zip(*held, strict=True)]
    held.clear()
    base = np.cumsum([0, *map(len, columns[0])][:-1])
    columns[3] = [h + b for h, b in zip(columns[3], base.tolist(), strict=True)]
    joined = []
    while columns:  # one after the other, so that no more than one is there twice
        joined.append(np.concatenate(columns.pop(0)))
    data, hashes, length, begin, per_doc, held_out = joined
    del joined
    ends = np.cumsum(per_doc) - 1
    hashes[ends] ^= np.uint64(0x94D049BB133111EB)
    unique = distinct(hashes)
    find, number, at = Lookup(unique), np.empty(len(hashes), np.int32), np.zeros(len(unique), np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        number[lo : lo + (1 << 16)] = n = find(hashes[lo : lo + (1 << 16)])
        at[n] = np.arange(lo, lo + len(n))
    last = np.zeros(len(unique), bool)
    last[number[ends]] = True
    del hashes, find
    return pack(number=small(number), tokens=small(per_doc), held=held_out, bytes=data[ranges(begin[at], length[at].astype(np.int64))], length=small(length[at]), last=last)


def chunks(docs: DataFrame, id_type: str) -> DataFrame:
    """(part, ids, body) from docs(doc_id, text, held_out): a chunk's distinct tokens with their bytes, and the numbers of the tokens of each document."""
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        first, made, size, held, seen = TaskContext.get().partitionId() << 32, 0, 0, [], []

        def out():
            ids = pa.concat_arrays(seen)
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([chunk_body(held)], pa.binary())], names=["part", "ids", "body"])

        for b in batches:
            for s in slices([b], 96 << 10):
                held.append(read_tokens(*buffer_of(s.column("text")), s.column("held_out").to_numpy(zero_copy_only=False)))
                ids = s.column("doc_id")
                seen.append(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids)
                size += len(held[-1][0])
                if size >= CHUNK:
                    yield out()
                    made, size, held, seen = made + 1, 0, [], []
                    tidy()
        if held:
            yield out()

    return docs.mapInArrow(run, f"part long, ids array<{id_type}>, body binary")


class Chunk:
    """A chunk's tokens and documents."""

    def __init__(self, body: bytes):
        x = unpack(body)
        self.number, self.bytes, self.last, self.held = x["number"].astype(np.int32), x["bytes"], x["last"], x["held"]
        self.length, self.tokens = x["length"].astype(np.int64), x["tokens"].astype(np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.doc = np.repeat(np.arange(len(self.tokens), dtype=np.int32), self.tokens)
        self.times = self.count(self.number, len(self.length))  # in training documents

    def count(self, which: np.ndarray, most: int) -> np.ndarray:
        """How often each number of ``which``, one for each token of the documents, occurs in training documents."""
        out, one = np.zeros(most, np.int64), np.int64(1)
        for at in self.blocks():
            np.add.at(out, which[at][~self.held[self.doc[at]]], one)
        return out

    def by_document(self, values: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The sum of values[which] over the tokens of each document."""
        out = np.zeros(len(self.tokens), values.dtype)
        for at in self.blocks():
            np.add.at(out, self.doc[at], values[which[at]])
        return out

    def blocks(self, tokens: int = 1 << 16):
        """Slices of the tokens, whole documents each."""
        ends, lo = np.cumsum(self.tokens), 0
        while lo < len(self.number):
            hi = int(ends[min(np.searchsorted(ends, lo + tokens), len(ends) - 1)])
            yield slice(lo, hi)
            lo = hi

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the token's word after lower-casing A-Z, whether it has one)."""
        h, n, _ = word_hashes(self.bytes, np.append(self.begin, len(self.bytes)))
        out = np.zeros(len(self.length), np.uint64)
        out[n > 0] = h
        return out, n > 0

    def symbols_seen(self) -> np.ndarray:
        c = np.bincount(self.bytes, np.repeat(self.times, self.length), 256).astype(np.int64)
        return np.append(c, int(self.times[self.last].sum()))

    def frequent(self, words: np.ndarray) -> np.ndarray:
        """Place among the frequent words (sorted hashes) of each token, or -1."""
        h, has = self.words()
        at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
        return np.where(has & (words[at] == h), at, -1) if len(words) else np.full(len(h), -1)

    def shared_documents(self, words: np.ndarray) -> np.ndarray:
        """Training documents that hold each pair of frequent words."""
        at = self.frequent(words).astype(np.int8)[self.number]
        on = (at >= 0) & ~self.held[self.doc]
        seen = np.zeros((len(self.tokens), FREQUENT), np.float32)
        seen[self.doc[on], at[on]] = 1
        return (seen.T @ seen).astype(np.int64)


class Units:
    """The distinct (token, state) of a chunk: every context follows from these."""

    def __init__(self, c: Chunk, words: np.ndarray, classes: np.ndarray):
        self.c = c
        at = c.frequent(words)
        kind = np.where(at >= 0, classes[at], -1).astype(np.int8) if len(classes) else np.full(len(at), -1, np.int8)
        tails = self.tails().astype(np.int8)
        states = (CLASSES + 1) * STATES
        key = np.empty(len(c.number), np.int32 if len(c.length) * states < 1 << 31 else np.int64)
        starts = np.cumsum(c.tokens) - c.tokens
        for block in c.blocks():
            number = c.number[block]
            n = np.arange(len(number))
            doc = c.doc[block]
            first = starts[doc] - block.start  # of each token's document
            own = kind[number]
            newest = np.maximum.accumulate(np.where(own >= 0, n, -1))
            before = np.append(-1, newest[:-1])
            group = np.where(before >= first, own[before] + 1, 0)
            state = np.where(n == first, 0, np.append(0, tails[number[:-1]]))
            key[block] = number.astype(np.int64) * states + group * STATES + state
        unique = distinct(key).astype(np.uint64)
        find = Lookup(unique)
        for block in c.blocks():
            key[block] = find(key[block].astype(np.uint64))
        self.of = key
        self.token, self.state = (unique // np.uint64(states)).astype(np.int64), (unique % np.uint64(states)).astype(np.int64)
        self.times = c.count(self.of, len(unique)).astype(np.float64)

    def tails(self) -> np.ndarray:
        """How each token ends: 1 with a line end, 2 with a mark before its separators, else 3."""
        c = self.c
        doc = np.repeat(np.arange(len(c.length)), c.length)
        lines = np.bincount(doc, c.bytes == 10, len(c.length)) > 0
        word = np.bincount(doc, ~SEPARATOR[c.bytes], len(c.length)).astype(np.int64)
        mark = np.isin(c.bytes[np.minimum(c.begin + np.maximum(word - 1, 0), max(0, len(c.bytes) - 1))], np.frombuffer(b".!?:;", np.uint8)) & (word > 0) if len(c.bytes) else np.zeros(len(c.length), bool)
        return np.where(lines, 1, np.where(mark, 2, 3))

    def symbols(self, lo: int, hi: int, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
        """(packed event of each symbol of units lo to hi, symbols of each unit)."""
        c, token, state = self.c, self.token[lo:hi], self.state[lo:hi]
        own = c.length[token]
        count = own + c.last[token]
        ends = np.cumsum(count)
        first = ends - count
        total = int(count.sum())
        symbol = np.full(total, END, np.uint64)
        inside = np.ones(total, bool)
        inside[ends[c.last[token]] - 1] = False
        symbol[inside] = c.bytes[ranges(c.begin[token], own)]
        packed = np.zeros(total, np.uint64)
        for k in range(1, DEEP + 1):
            packed[k:] |= symbol[: max(0, total - k)] << np.uint64(9 * (DEEP - k))
        # before the token stand marks that tell the state's kind of end
        edge = (300 + state % STATES).astype(np.uint64)
        for j in range(DEEP):
            on = np.flatnonzero(count > j)
            fill = edge[on] * np.uint64(sum(1 << 9 * i for i in range(DEEP - j)))
            low = np.uint64(9 * (DEEP - j))
            at = first[on] + j
            packed[at] = (packed[at] >> low << low) | fill
        packed = packed * np.uint64((CLASSES + 1) * STATES) + np.repeat(state.astype(np.uint64), count)
        return (packed << np.uint64(9)) | coder.rank.astype(np.uint64)[symbol.view(np.int64)], count

    def expand(self, lo: int, hi: int, coder: Coder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rank of each symbol of units lo to hi, symbols of each unit, keys[kind, symbol])."""
        packed, count = self.symbols(lo, hi, coder)
        rank, keys = contexts(packed)
        return rank, count, keys

    def entries(self, coder: Coder) -> list[np.ndarray]:
        return entries(self, coder, WIDE)


class Events:
    """The distinct (last symbols, state, symbol) of a chunk's units, in an order without meaning, with how often each occurs in training documents."""

    def __init__(self, u: Units, coder: Coder):
        self.u, self.coder = u, coder
        parts = [distinct(self.shuffled(lo)[0]) for lo in range(0, len(u.token), WIDE)]
        self.find = Lookup(distinct(np.concatenate(parts)) if parts else np.zeros(0, np.uint64))
        self.times = np.zeros(len(self.find.keys))

    def shuffled(self, lo: int) -> tuple[np.ndarray, np.ndarray]:
        packed, count = self.u.symbols(lo, min(lo + WIDE, len(self.u.token)), self.coder)
        return packed * np.uint64(BASE), count

    def count(self) -> Events:
        for lo in range(0, len(self.u.token), WIDE):
            times = self.u.times[lo : lo + WIDE]
            if times.any():
                key, n = self.shuffled(lo)
                np.add.at(self.times, self.find(key), np.repeat(times, n))
        return self

    def by_unit(self, values: np.ndarray) -> np.ndarray:
        """The sum of values, one for each event, over the symbols of each unit."""
        out = np.zeros(len(self.u.token), values.dtype)
        for lo in range(0, len(out), WIDE):
            key, n = self.shuffled(lo)
            out[lo : lo + len(n)] = np.add.reduceat(values[self.find(key)], np.cumsum(n) - n)
        return out

    def expand(self, lo: int, hi: int, coder: Coder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rank, 1, keys[kind]) of events lo to hi."""
        rank, keys = contexts(self.find.keys[lo:hi] * np.uint64(pow(BASE, -1, 1 << 64)))
        return rank, np.ones(len(rank), np.int64), keys

    def entries(self, coder: Coder) -> list[np.ndarray]:
        return entries(self, coder, SLICE)

    def places(self, find: list[Lookup]) -> np.ndarray:
        """[kind, event]: the place of each event's key among the entries of a kind."""
        out = np.empty((KINDS, len(self.times)), np.int32)
        for lo in range(0, len(self.times), SLICE):
            _, _, keys = self.expand(lo, lo + SLICE, self.coder)
            for k, f in enumerate(find):
                out[k, lo : lo + SLICE] = f(keys[k])
        return out


def contexts(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, keys[kind]) of packed events."""
    states = np.uint64((CLASSES + 1) * STATES)
    rank, rest = packed & np.uint64(511), packed >> np.uint64(9)
    deep, state = rest // states, rest % states
    keys = np.empty((KINDS, len(packed)), np.uint64)
    for k, back in enumerate((*BACK, STATED)):
        key = deep >> np.uint64(9 * (DEEP - back))
        if k == KINDS - 1:
            key = key * states + state
        keys[k] = (mix(key + np.uint64((k + 1) * 0xA0761D6478BD642F & M64)) & ~np.uint64(511)) | rank
    return rank.astype(np.int64), keys


def entries(u: Units | Events, coder: Coder, step: int) -> list[np.ndarray]:
    """The distinct keys of each kind, sorted."""
    parts: list[list[np.ndarray]] = [[] for _ in range(KINDS)]
    for lo in range(0, len(u.times), step):
        _, _, keys = u.expand(lo, min(lo + step, len(u.times)), coder)
        for k in range(KINDS):
            parts[k].append(distinct(keys[k]))
    return [distinct(np.concatenate(p)) if p else np.zeros(0, np.uint64) for p in parts]


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Lookup:
    """Places of keys in a sorted array that holds them all, by a table of slots; keys that lose their slot have another table, these a third, and those that lose there too are searched."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.tables = []
        left = np.arange(len(keys))
        for factor in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
            shift = np.uint64(64 - max(8, int(len(left)).bit_length() + 1))
            slot = np.zeros(1 << (64 - int(shift)), np.int32)
            at = ((keys[left] * np.uint64(factor)) >> shift).astype(np.int64)
            slot[at] = left
            left = left[slot[at] != left]
            self.tables.append((np.uint64(factor), shift, slot))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        f, shift, slot = self.tables[0]
        got = slot[((keys * f) >> shift).view(np.int64)]
        bad = np.flatnonzero(self.keys[got] != keys)
        for f, shift, slot in self.tables[1:]:
            if not len(bad):
                break
            again = keys[bad]
            got[bad] = other = slot[((again * f) >> shift).view(np.int64)]
            bad = bad[self.keys[other] != again]
        if len(bad):
            got[bad] = np.searchsorted(self.keys, keys[bad])
        return got


# ---------------------------------------------------------------- counts


def path_counts(keys: np.ndarray, count: np.ndarray, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each key): for every node of each key's path the levels of the counts that went the same way and the other way.

    keys are sorted and distinct, and hold all that was counted in their contexts; their ranks are in tree order, so the keys of a node lie together.
    """
    rank, context = (keys & np.uint64(511)).astype(np.int64), keys >> np.uint64(9)
    size = coder.length[rank]
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    own = np.arange(len(keys))
    new = np.append(True, context[1:] != context[:-1]) if len(keys) else np.zeros(0, bool)
    here = total_by(new, count)
    depth = 0
    while len(own):
        # to the child on the path: a change of direction at this depth starts another node
        way = coder.bit[coder.begin[rank[own]] + depth]
        new[1:] |= way[1:] != way[:-1]
        same = total_by(new, count[own])
        out[begin[own] + depth] = level(same) * 16 + level(here - same)
        depth += 1
        go = size[own] > depth
        starts = np.cumsum(new)[go]
        own, here = own[go], same[go]
        new = np.append(True, starts[1:] != starts[:-1]) if len(own) else np.zeros(0, bool)
    return out, begin


def total_by(new: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sum over each run that begins where new is set, at every place."""
    if not len(new):
        return count
    first = np.flatnonzero(new)
    return np.repeat(np.add.reduceat(count, first), np.diff(np.append(first, len(new))))


ASK = "bucket int, part long, kind int, low binary, high binary, count binary"


def ask_contexts(table: DataFrame, shared, buckets: int) -> DataFrame:
    """The (context, symbol) of every chunk with its counts in training text, by bucket of the context. Sorted keys travel as differences.

    With them goes, to bucket -1, what the mixer learns in the chunk, from the chunk's own counts: count has the weights times the bits learned from, the cells of the map, and the bits.
    """
    import pyarrow as pa

    def run(batches):
        coder, words, classes = shared.value
        names = [f.split()[0] for f in ASK.split(", ")]

        def row(bucket, part, kind, low, high, count):
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([part], pa.int64()), pa.array([kind], pa.int32()), *(pa.array([x], pa.binary()) for x in (low, high, count))], names=names)

        for b in batches:
            for part, body in zip(b.column("part").to_pylist(), b.column("body").to_pylist(), strict=True):
                e = Events(Units(Chunk(body), words, classes), coder).count()
                find, counts = counted(e, coder)
                mixer = Mixer(END)
                w, cells, n = learn(e, Bits(e, coder, find, [path_counts(f.keys, c, coder)[0] for f, c in zip(find, counts, strict=True)]), mixer)
                yield row(-1, part, -1, b"", b"", np.concatenate([w.ravel() * n, cells.ravel(), [n]]).tobytes())
                for k, f in enumerate(find):
                    edge = np.searchsorted(f.keys >> np.uint64(9), bucket_edges(buckets))
                    for i, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                        if lo < hi:
                            step = np.diff(f.keys[lo:hi], prepend=np.uint64(0))
                            yield row(i, part, k, (step & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), pack(x=small(step >> np.uint64(32))), pack(x=small(counts[k][lo:hi])))
                del e, find, counts
                tidy()

    return table.select("part", "body").mapInArrow(run, ASK)


def counted(e: Events, coder: Coder) -> tuple[list[Lookup], list[np.ndarray]]:
    """For each kind, a chunk's (context, symbol) and their counts in its training text."""
    find = [Lookup(k) for k in e.entries(coder)]
    counts = [np.zeros(len(f.keys)) for f in find]
    for lo in range(0, len(e.times), SLICE):
        times = e.times[lo : lo + SLICE]
        _, _, keys = e.expand(lo, lo + len(times), coder)
        for k, f in enumerate(find):
            np.add.at(counts[k], f(keys[k]), times)
    return find, [c.astype(np.int64) for c in counts]


def bucket_edges(buckets: int) -> np.ndarray:
    """Borders of the buckets in the space of contexts (55 bits)."""
    return np.array([(i << 55) // buckets for i in range(buckets + 1)], np.uint64)


def answer_contexts(asked: DataFrame, shared) -> DataFrame:
    """(part, kind, bucket, data): for every key that a chunk asked for, the bytes of its path, from the counts of all chunks."""
    import pyarrow as pa

    def run(key, t):
        coder = shared.value[0]
        rows = []
        if key[0].as_py() < 0:
            learned = np.sum([np.frombuffer(x, np.float64) for x in t.column("count").to_pylist()], axis=0)
            rows.append((-1, -1, -1, learned.tobytes()))
            t = t.slice(0, 0)
        for kind in range(KINDS):
            own = t.filter(pa.compute.equal(t.column("kind"), kind))
            if not own.num_rows:
                continue
            keys, counts = [], []
            for low, high, count in zip(*(own.column(c).to_pylist() for c in ("low", "high", "count")), strict=True):
                keys.append(np.cumsum(np.frombuffer(low, np.uint32).astype(np.uint64) + (unpack(high)["x"].astype(np.uint64) << np.uint64(32))))
                counts.append(unpack(count)["x"])
            every = distinct(np.concatenate(keys))
            find, total = Lookup(every), np.zeros(len(every), np.int64)
            at = [find(k) for k in keys]
            for a, c in zip(at, counts, strict=True):
                total[a] += c.astype(np.int64)  # a chunk names a key once
            data, begin = path_counts(every, total, coder)
            size = coder.length[(every & np.uint64(511)).astype(np.int64)]
            for part, a in zip(own.column("part").to_pylist(), at, strict=True):
                rows.append((part, kind, key[0].as_py(), data[ranges(begin[a], size[a])].tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.table({n: pa.array([r[j] for r in rows], f) for j, (n, f) in enumerate(zip(("part", "kind", "bucket", "data"), kinds, strict=True))})

    return asked.groupBy("bucket").applyInArrow(run, "part long, kind int, bucket int, data binary")


# ---------------------------------------------------------------- the mixer


class Mixer:
    """Weights by gate and kind, and the map: log odds by node and bucket of the mixed prediction."""

    def __init__(self, nodes: int, weights: np.ndarray | None = None, seen: np.ndarray | None = None):
        self.weights = np.full((GATES, KINDS), 0.3, np.float32) if weights is None else weights.astype(np.float32)
        self.columns = np.ascontiguousarray(self.weights.T)
        self.seen = np.zeros((nodes * BUCKETS_MAP, 2)) if seen is None else seen  # of each cell: bits, and those that are 1
        middle = 1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS_MAP)))
        p = (self.seen[:, 1] + LINE * np.tile(middle, nodes)) / (self.seen[:, 0] + LINE)
        self.map = (np.log(p) - np.log(1 - p)).astype(np.float32)

    @staticmethod
    def gate(paths: np.ndarray) -> np.ndarray:
        """How much is known at the node: in the stated context, and for the two longest runs of symbols."""
        return GATE[0][paths[KINDS - 1]] + GATE[1][paths[KINDS - 2]] + GATE[2][paths[KINDS - 3]]

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Log odds that a bit is what it is."""
        z = self.columns[0][gate] * x[0]
        for k in range(1, KINDS):
            z += self.columns[k][gate] * x[k]
        return np.clip(z, -14, 14, out=z)

    @staticmethod
    def cell(z: np.ndarray, node: np.ndarray) -> np.ndarray:
        """z: log odds that the bit is 1."""
        return node * BUCKETS_MAP + np.clip((z + 8) * ((BUCKETS_MAP - 1) / 16) + 0.5, 0, BUCKETS_MAP - 1).astype(np.int32)

    def loss(self, paths: np.ndarray, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Natural logarithm of one over the probability of each bit."""
        z = self.mixed(STRETCH[paths], self.gate(paths))
        sign = bit.astype(np.float32) * 2 - 1
        z = (z + sign * self.map[self.cell(z * sign, node)]) / 2
        return np.log1p(np.exp(-z))


class Bits:
    """The bits of slices of a chunk's events or units, with the bytes of their paths in every kind of context."""

    def __init__(self, u: Units | Events, coder: Coder, find: list[Lookup], data: list[np.ndarray]):
        self.u, self.coder, self.find, self.data = u, coder, find, data
        sizes = [coder.length[(f.keys & np.uint64(511)).astype(np.int64)] for f in find]
        self.begin = [np.cumsum(s) - s for s in sizes]
        self.at = u.places(find) if isinstance(u, Events) else None
        if any(len(d) != int(s.sum()) for d, s in zip(data, sizes, strict=True)):
            raise RuntimeError("the answers of a chunk are not what it asked for")

    def __call__(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(paths[kind, bit], node, bit, bits of each event or unit)."""
        if self.at is None:
            rank, symbols, keys = self.u.expand(lo, hi, self.coder)
            place = [f(x) for f, x in zip(self.find, keys, strict=True)]
        else:
            place = self.at[:, lo:hi]
            rank, symbols = (self.find[0].keys[place[0]] & np.uint64(511)).astype(np.int64), np.ones(len(place[0]), np.int64)
        size = self.coder.length[rank]
        ends = np.cumsum(size)
        step = np.arange(int(ends[-1]) if len(ends) else 0)
        first = ends - size
        at = np.repeat(self.coder.begin[rank] - first, size) + step
        paths = np.empty((KINDS, len(at)), np.uint8)
        for k in range(KINDS):
            paths[k] = self.data[k][np.repeat(self.begin[k][place[k]] - first, size) + step]
        return paths, self.coder.node[at], self.coder.bit[at], np.add.reduceat(size, np.cumsum(symbols) - symbols)


def learn(u: Units | Events, bits: Bits, mixer: Mixer) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, cells, bits): one Newton step after each batch of events, each event as often as training text has it but without its own count; curvatures add up, so every bit counts alike.

    All events take part, in an order without meaning; batches grow to SLICE events. The map then counts every bit by the weights learned.
    """
    curve = np.tile(np.eye(KINDS) * RIDGE, (GATES, 1, 1))
    seen = np.zeros_like(mixer.seen)
    total, start = 0.0, 0
    while start < len(u.times):
        every = u.times[start : start + min(SLICE, max(BATCH, start))]
        start += len(every)
        if not every.any():
            continue
        paths, _, _, n = bits(start - len(every), start)
        paths = WITHOUT[paths]
        weights, x, gate = np.repeat(every, n), STRETCH[paths], mixer.gate(paths)
        q = 1 / (1 + np.exp(mixer.mixed(x, gate)))
        err = weights * q
        g = np.stack([np.bincount(gate, err * x[k], GATES) for k in range(KINDS)], 1)
        err *= 1 - q
        for k in range(KINDS):
            by = err * x[k]
            for j in range(k + 1):
                curve[:, j, k] += np.bincount(gate, by * x[j], GATES)
                curve[:, k, j] = curve[:, j, k]
        mixer.weights += np.clip(np.linalg.solve(curve, g[:, :, None])[:, :, 0], -0.5, 0.5).astype(np.float32)
        mixer.columns = np.ascontiguousarray(mixer.weights.T)
    for lo in range(0, len(u.times), SLICE):
        every = u.times[lo : lo + SLICE]
        if not every.any():
            continue
        paths, node, bit, n = bits(lo, lo + len(every))
        paths = WITHOUT[paths]
        weights, z = np.repeat(every, n), mixer.mixed(STRETCH[paths], mixer.gate(paths))
        total += float(weights.sum())
        cell = mixer.cell(np.where(bit == 1, z, -z), node)
        seen[:, 0] += np.bincount(cell, weights, len(seen))
        seen[:, 1] += np.bincount(cell, weights * bit, len(seen))
    return mixer.weights.astype(np.float64), seen, total


def classes_of(shared: np.ndarray) -> np.ndarray:
    """A class for each frequent word from the documents that pairs of words share: in order of frequency, a word joins the leader it is most alike (cosine), or leads a class itself."""
    leaders: list[int] = []
    out = np.zeros(len(shared), np.int64)
    size = np.sqrt(np.maximum(np.diag(shared), 1))
    alike = shared / size[:, None] / size[None, :]
    for i in np.lexsort((np.arange(len(shared)), -np.diag(shared))):
        best = max(range(len(leaders)), key=lambda k: alike[i, leaders[k]], default=None)
        if best is not None and (alike[i, leaders[best]] >= ALIKE or len(leaders) == CLASSES):
            out[i] = best
        else:
            out[i] = len(leaders)
            leaders.append(i)
    return out


# ---------------------------------------------------------------- all together


def lm_scores(docs: DataFrame, held_out: int = 2, folds: int = 7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from all rows whose crc32 fold is not held_out. A null text is empty; an empty text has one token, its end. Without training rows all counts are 0 and bits are even.
    Repeated rows count and are scored as often as they occur; null ids are ids like others; other columns are not read. Chunks follow the scan's partitions; of
    these only the averaged weights and the map depend, and only slightly.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType.simpleString()
    src = spread(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (fold(F.col(doc_id), folds) == held_out).alias("held_out")))
    schema = _parse_datatype_string(f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    arrow = to_arrow_schema(schema)
    table = materialize(chunks(src, id_type), "chunks")
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(workers(docs), int(total // BUCKET) + 1)

    # words: by bucket of the word, and back to the chunks that hold it; bucket -1 has the symbols of all training text
    def count(batches):
        for b in batches:
            for part, body in zip(b.column("part").to_pylist(), b.column("body").to_pylist(), strict=True):
                c = Chunk(body)
                h, has = c.words()
                u, at = np.unique(h[has], return_inverse=True)
                n = np.bincount(at, c.times[has], len(u)).astype(np.int64)
                k = (mix(u + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(k, kind="stable")
                names, heads = np.unique(k[order], return_index=True)
                rows = [(-1, c.symbols_seen(), np.zeros(0, np.int64))] + [(int(i), u[r], n[r]) for i, r in zip(names, np.split(order, heads[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int64()), *(pa.array([r[j].tobytes() for r in rows], pa.binary()) for j in (1, 2))], names=["bucket", "part", "h", "c"])

    def total_up(key, t):
        hs, cs = ([np.frombuffer(x, kind) for x in t.column(n).to_pylist()] for n, kind in (("h", np.uint64), ("c", np.int64)))
        if key[0].as_py() < 0:
            rows = [(-1, np.sum([x.view(np.int64) for x in hs], axis=0), np.zeros(0, np.int64), 0, 0)]
        else:
            u, at = np.unique(np.concatenate(hs), return_inverse=True)
            c = np.bincount(at, np.concatenate(cs), len(u)).astype(np.int64)
            top = np.lexsort((u, -c))[:FREQUENT]
            ends = np.cumsum([len(x) for x in hs])
            rows = [(-2, u[top], c[top], int(c.sum()), int((c > 0).sum()))] + [(p, x, c[at[e - len(x) : e]], 0, 0) for p, x, e in zip(t.column("part").to_pylist(), hs, ends, strict=True)]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        cells = [(r[0], r[1].tobytes(), r[2].tobytes(), r[3], r[4]) for r in rows]
        return pa.table({n: pa.array([r[j] for r in cells], f) for j, (n, f) in enumerate(zip(("part", "h", "c", "tokens", "kinds"), kinds, strict=True))})

    counted = table.select("part", "body").mapInArrow(count, "bucket int, part long, h binary, c binary").groupBy("bucket").applyInArrow(total_up, "part long, h binary, c binary, tokens long, kinds long")
    known = materialize(counted, "words")
    seen, n_all, v_all = np.zeros(END + 1, np.int64), 0, 0
    best: list[tuple[int, int]] = []
    for r in known.where("part < 0").toLocalIterator():  # a row for each bucket; only the FREQUENT best are kept
        if r.part == -1:
            seen += np.frombuffer(bytes(r.h), np.int64)
        else:
            n_all, v_all = n_all + r.tokens, v_all + r.kinds
            pairs = zip(np.frombuffer(bytes(r.h), np.uint64).tolist(), np.frombuffer(bytes(r.c), np.int64).tolist(), strict=True)
            best = heapq.nsmallest(FREQUENT, [*best, *((-c, h) for h, c in pairs if c)])
    trained = int(seen[END])
    n_all, v_all = n_all + trained, v_all + (trained > 0)
    coder = Coder(seen)
    words = np.sort(np.array([h for _, h in best], np.uint64))
    top = spark.sparkContext.broadcast(words)

    # classes of the frequent words
    def pairs_seen(batches):
        for b in batches:
            m = sum(Chunk(body).shared_documents(top.value) for body in b.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["m"])

    def add(key, t):
        m = np.sum([np.frombuffer(x, np.int64) for x in t.column("m").to_pylist()], axis=0)
        return pa.table({"m": pa.array([m.tobytes()], pa.binary())})

    some = F.pmod(F.xxhash64("m"), F.lit(32)).alias("slot")
    matrices = table.select("body").mapInArrow(pairs_seen, "m binary").groupBy(some).applyInArrow(add, "m binary").collect()  # 32 rows at most
    both = np.sum([np.frombuffer(bytes(r.m), np.int64) for r in matrices], axis=0).reshape(FREQUENT, FREQUENT) if matrices else np.zeros((FREQUENT, FREQUENT), np.int64)
    shared = spark.sparkContext.broadcast((coder, words, classes_of(both)[: len(words)]))

    # contexts: asked for by the chunks, counted in buckets, answered
    answers = materialize(answer_contexts(ask_contexts(table, shared, buckets), shared), "paths")

    def bits_of(left, right):
        coder, words, classes = shared.value
        c = Chunk(left.column("body")[0].as_py())
        u = Units(c, words, classes)
        right = right.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        got: dict[int, list[bytes]] = {}
        for kind, data in zip(right.column("kind").to_pylist(), right.column("data").to_pylist(), strict=True):
            got.setdefault(kind, []).append(data)
        e = Events(u, coder)
        return c, u, e, Bits(e, coder, [Lookup(k) for k in e.entries(coder)], [np.frombuffer(b"".join(got.get(k, [])), np.uint8) for k in range(KINDS)])

    mixer, cut_at = Mixer(END), GATES * KINDS
    for r in answers.where("kind = -1").collect():  # one row
        m = np.frombuffer(bytes(r.data), np.float64)
        if m[-1] > 0:
            mixer = Mixer(END, (m[:cut_at] / m[-1]).reshape(GATES, KINDS), m[cut_at:-1].reshape(-1, 2))
    model = spark.sparkContext.broadcast(mixer)
    floor = np.log10(n_all + v_all + 1)

    def score(key, left, right):
        tidy()
        kind = right.column("kind")
        mine = right.filter(pa.compute.equal(kind, KINDS))
        c, u, e, bits = bits_of(left, right.filter(pa.compute.less(kind, KINDS)))
        nat = np.zeros(len(e.times))
        for lo in range(0, len(nat), SLICE):
            paths, node, bit, n = bits(lo, min(lo + SLICE, len(nat)))
            nat[lo : lo + len(n)] = np.add.reduceat(model.value.loss(paths, node, bit).astype(np.float64), np.cumsum(n) - n)
        del bits
        s = -c.by_document(e.by_unit(nat), u.of) / np.log(10)
        del e
        h, has = c.words()
        keys = np.frombuffer(b"".join(mine.column("data").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(mine.column("more").to_pylist()), np.int64)
        order = np.argsort(keys)
        times = np.zeros(len(h), np.int64)
        times[has] = counts[order][np.searchsorted(keys[order], h[has])]
        n = c.by_document(has.astype(np.int64), c.number)
        base = c.by_document(np.where(has, np.log10(times + 1.0), 0.0), c.number) + np.log10(trained + 1.0) - (n + 1) * floor
        n_known = c.by_document((has & (times > 0)).astype(np.int64), c.number) + (trained > 0)
        size = c.by_document(c.length, c.number)
        docs_ = len(c.tokens)
        ids = left.column("ids").combine_chunks().flatten().cast(arrow.field(0).type)
        return pa.table([ids, pa.array(c.held), pa.array(n + 1, pa.int64()), pa.array(n_known), pa.array(np.full(docs_, n_all, np.int64)), pa.array(base), pa.array(s), pa.array(-s * np.log2(10) / np.maximum(size, 1))], schema=arrow)

    counts = known.where("part >= 0").select("part", F.lit(KINDS).alias("kind"), F.lit(0).alias("bucket"), F.col("h").alias("data"), F.col("c").alias("more"))
    every = answers.where("kind >= 0").withColumn("more", F.lit(None).cast("binary")).unionByName(counts)
    return table.groupBy("part").cogroup(every.groupBy("part")).applyInArrow(score, schema)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
