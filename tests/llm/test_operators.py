"""The text operators against brute force, on hard cases: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from tokenizers import Tokenizer

from tideline.llm import common, context_mixing, exact_dedup, jaccard_join, langid, packing, pii, sentencepiece_lattice, suffix_dedup, topk_search, toxicity
from tideline.llm.components import components

WORDS = "the of and to in that er ing tion an re st en at".split()


def text(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(WORDS, 2)) for _ in range(n))


def hard_rows():
    a, b = text(1, 120), text(2, 300)
    near = " ".join([*a.split()[:60], "changed", *a.split()[61:]])
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, a), (6, a.upper()), (7, near), (8, b), (9, b + " " + a), (10, b), (11, text(3, 4000)), (12, "a b c d e"), (13, "é漢 \U0001f600 x"), (14, near + " tail"), (5, a)]
    return [(i, t, f"l{i % 2}", "s", len(t or "")) for i, t in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def test_exact(docs):
    groups = {}
    for i, t, *_ in hard_rows():
        groups.setdefault(low(t), []).append(i)
    got = sorted(tuple(r) for r in exact_dedup.exact_groups(docs, counters=2).collect())
    assert got == sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def test_frequent_digests_finds_every_heavy_one(spark):
    rows = [(i, bytes([0 if i % 3 == 0 else 1 if i % 5 == 0 else 2 + i % 250])) for i in range(4000)]
    got = exact_dedup.frequent_digests(spark.createDataFrame(rows, "doc_id long, digest binary"), 6, 100).collect()
    count = Counter(d for _, d in rows)
    assert {bytes(r.digest) for r in got} >= {d for d, c in count.items() if c > 4000 / 7}
    assert len(got) <= 6 and all(r.group_size == count[bytes(r.digest)] for r in got)


def brute_classes(rows):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return sorted((r[0], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def test_jaccard(docs):
    assert sorted(tuple(r) for r in jaccard_join.jaccard_classes(docs).collect()) == brute_classes(hard_rows())


def chains():
    rows, k = [], 0
    for g in range(6):
        base = text(100 + g, 80).split()
        for v in range(30):
            w = list(base)
            for j in range(v % 4):
                w[(v * 7 + j * 13) % 80] = f"x{g}{v}{j}"
            rows.append((k, " ".join(w), "l", "s", 0))
            k += 1
    return rows + [(k + i, text(500 + i, 30 + i), "l", "s", 0) for i in range(40)]


@pytest.mark.parametrize("region", [2_000_000, 1500])
def test_jaccard_regions(spark, monkeypatch, region):
    """Also with regions that must be split across tasks."""
    monkeypatch.setattr(jaccard_join, "REGION", region)
    d = spark.createDataFrame(chains(), SCHEMA)
    assert sorted(tuple(r) for r in jaccard_join.jaccard_classes(d).collect()) == brute_classes(chains())


def chance_rows() -> list[tuple[int, str]]:
    """Texts whose shingles all occur elsewhere by chance, with a near copy of every tenth."""
    r = np.random.default_rng(11)
    out = [(i, " ".join(f"w{k}" for k in r.integers(0, 5, int(n)))) for i, n in enumerate(r.integers(30, 120, 300))]
    return out + [(1000 + i, t + " w9") for i, t in out[::10]]


@pytest.mark.parametrize(("few", "many"), [(16, 2000), (1, 3)])
def test_chance_shingles_make_no_regions(spark, monkeypatch, few, many):
    monkeypatch.setattr(jaccard_join, "FEW", few, raising=False)
    monkeypatch.setattr(jaccard_join, "MANY", many, raising=False)
    seen = []
    join = jaccard_join.region_links
    monkeypatch.setattr(jaccard_join, "region_links", lambda members: seen.extend(r["count"] for r in members.groupBy("region").count().collect()) or join(members))
    d = spark.createDataFrame(chance_rows(), "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.jaccard_classes(d).collect()) == brute_classes(chance_rows())
    assert max(seen) <= 10 and 60 <= sum(seen) <= 120  # of 330; regions by single shingles took nearly all into one


def test_sketches_keep_every_link():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in (1, 4, 5, 60, 64, 65, 127, 129, 500, 2047, 2100, 5000)]
    sets += [np.sort(r.permutation(s)[: max(1, int(len(s) * f))]) for s in sets for f in (0.81, 0.9, 0.7)]
    sets += [np.unique(np.concatenate([s, r.integers(0, 1 << 63, len(s) // 10).astype(np.uint64)])) for s in sets[:12]]
    n = np.array([len(s) for s in sets])
    k = jaccard_join.Sketches(n, [jaccard_join.sketch(s).tobytes() for s in sets])
    a, b = np.triu_indices(len(sets), 1)
    close = k.close(a, b)
    link = np.array([100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (n[i] + n[j] - c) for i, j in zip(a, b, strict=True)])
    assert link.sum() >= 30 and close[link].all() and close.sum() < 4 * link.sum()


def test_voronoi_cells_in_memory():
    rows = chains()
    sets = [np.array(sorted({zlib.crc32(" ".join(w[k : k + 5]).encode()) for w in [t.split()] for k in range(len(w) - 4)}), np.uint64) for _, t, *_ in rows]
    f = jaccard_join.Region(sets)
    f.join(np.arange(len(sets)))
    got = [f.forest.find(i) for i in range(len(sets))]
    want = [c for _, _, c in sorted(brute_classes(rows))]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components(spark):
    e = [(i + 1, i) for i in range(200)] + [(500 + i, 499) for i in range(1, 50)] + [(7, 7)]
    got = {r.v: r.root for r in components(spark.createDataFrame(e, "a long, b long"), "t").collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[500 + i] == 499 for i in range(1, 50))


def test_pii(docs, spark):
    t = "mail 9.a@b.example.com ip 1.2.3.4 999.1.1.1 card 4111 1111 1111 1111 tel +1 (555) 010-9999 contact bob7 [at] site.org no 1234 5678 9012 3456"
    d = spark.createDataFrame([(1, t), (2, None), (3, ""), (1, t)], "doc_id long, text string")
    r = {x.doc_id: x for x in pii.pii_spans(d).collect()}
    assert (r[1].n_email, r[1].n_ip, r[1].n_card, r[1].n_phone) == (1, 1, 1, 1) and r[2].spans == r[3].spans == ""
    assert "bob7 [at] site.org" in [t[s.start : s.end] for s in r[1].span_list]
    clean = {x.doc_id: x.text for x in pii.redact(d).collect()}
    assert "4111" not in clean[1] and "[EMAIL]" in clean[1] and "1234 5678" in clean[1] and clean[2] is None and clean[3] == ""
    assert pii.pii_spans(docs).count() == len(hard_rows())


def test_packing(docs):
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x, *_ in hard_rows()}
    rows = packing.pack(docs, 256).collect()
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and (r.piece == 0 or r.length == 256)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(s[-1]) <= 256
    total = sum(len(want[i]) for i, *_ in hard_rows())
    assert sum(r.length for r in rows) == total and len(seqs) <= total / 256 + 4


def test_tokenizer_libraries_agree():
    t = Tokenizer.from_file(packing.tokenizer_path())
    r = np.random.default_rng(0)
    texts = ["".join(r.choice(list(" \n\tab's1²é漢 <|endoftext|>-_."), 40)) for _ in range(500)] + [x or "" for _, x, *_ in hard_rows()]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [x.tolist() for x in packing.encode(texts, packing.tokenizer_path())]


def test_added_tokens_in_texts(spark):
    """Against the file's own library with its default setting."""
    t = Tokenizer.from_file(packing.tokenizer_path())
    r = np.random.default_rng(1)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n\n x  <|endoftext|>", "<|endoftext|", text(4, 300) + "  <|endoftext|>  " + text(5, 300)]
    texts += ["".join(r.choice(["<|endoftext|>", "  ", "\n", "é", "漢", "ab", "'s", "1", "<|", "|>"], 30)) for _ in range(300)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert want == [x.tolist() for x in packing.encode(texts, packing.tokenizer_path())] and want[0] == [64, 220, 50256, 275]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 256).collect()
    assert all(zlib.crc32(np.array([*want[r.doc_id], 2][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert sum(r.length for r in rows) == sum(map(len, want)) + len(want)


def test_plan_is_exact_where_it_can_be():
    c = np.zeros(11, np.int64)
    c[[6, 4, 3]] = [5, 5, 2]
    bins = packing.plan(c, 10)
    assert sum(n for n, _ in bins) == 6 and sum(n * k for n, b in bins for _, k in b) == 12


def brute_spans(rows):
    out, first = [], {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, i), i)
    for i, t, *_ in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                m[k : k + 50] = b"\1" * 50
        out.append((i, len(b), sum(m), sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1])), hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest()))
    return sorted(out)


def test_passages(docs, spark):
    for rows in (hard_rows(), [(i, t[: 40 + 3 * i] + "z" * 90 + t[: 60 + i], "l", "s", 0) for i in range(30) for t in [text(i % 3, 60)]]):
        d = spark.createDataFrame(rows, SCHEMA)
        assert sorted(tuple(r)[:5] for r in suffix_dedup.dedup_passages(d).collect()) == brute_spans(rows)


def test_suffix_order():
    r = np.random.default_rng(1)
    pieces = ["".join(r.choice(list("abc"), int(r.integers(1, 80)))).encode() for _ in range(300)]
    p, o, c = suffix_dedup.collection_order(pieces)
    s = [pieces[i][j:] for i, j in zip(p, o, strict=True)]
    assert len(s) == sum(map(len, pieces)) and all(a <= b for a, b in zip(s, s[1:], strict=False))
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert all(common(a, b) == k for a, b, k in zip(s, s[1:], c[1:], strict=False))


def test_anchors_are_runs(monkeypatch):
    """Runs of strings with one anchor, worked out block by block, against every string's least hash; whatever the block, no longer or shorter runs."""
    m, r = suffix_dedup, np.random.default_rng(0)
    data, offsets = r.integers(0, 3, 3000).astype(np.uint8), np.array([0, 0, 10, 60, 60, 1000, 1049, 1099, 2500, 3000])
    h = m.hashes(data)
    assert len({data[i : i + m.M].tobytes() for i in range(len(h))}) == len(np.unique(h))
    want = [(p, i, h[p : p + m.WINDOW].min()) for i in range(len(offsets) - 1) for p in range(offsets[i], offsets[i + 1] - m.MATCH + 1)]
    for block in (1, 7, m.BLOCK):
        monkeypatch.setattr(m, "BLOCK", block)
        start, count, doc, a = m.anchors(data, offsets)
        assert [(x + j, d, z) for x, n, d, z in zip(start, count, doc, a, strict=True) for j in range(n)] == want
        assert all((start[1:] != start[:-1] + count[:-1]) | (a[1:] != a[:-1]) | (doc[1:] != doc[:-1]))


def test_language_model(docs):
    count = Counter(w for i, t, *_ in hard_rows() if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    for r in context_mixing.lm_scores(docs).collect():
        t = next(t for i, t, *_ in hard_rows() if i == r.doc_id)
        w = [*words(t), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0


def plain_tokens(t):
    """(token bytes, is the last) of a text: a run of bytes that are no separators, and the separators after it."""
    b = (t or "").encode()
    out = [m.group() for m in re.finditer(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|^[\x20\x09-\x0D]+", b)] or [b""]
    assert b"".join(out) == b
    return [(x, i == len(out) - 1) for i, x in enumerate(out)]


def plain_contexts(rows, frequent):
    """For every token of every row: its symbols, and for each kind the context of each symbol. frequent: word -> class."""
    out = []
    for i, t, *_ in rows:
        group, tail, own = 0, 0, []
        for token, last in plain_tokens(t):
            symbols = [*token, *([context_mixing.END] if last else [])]
            back = lambda j, k: tuple(symbols[j - x] if j >= x else -tail - 1 for x in range(1, k + 1))  # noqa: E731, B023
            own.append((token, last, symbols, [[(*back(j, k),) for j in range(len(symbols))] for k in context_mixing.BACK] + [[(group, tail, *back(j, context_mixing.STATED)) for j in range(len(symbols))]]))
            word = re.sub(rb"[\x20\x09-\x0D]", b"", token)
            tail = 1 if b"\n" in token else 2 if word[-1:] in (b".", b"!", b"?", b":", b";") else 3
            group = frequent.get(word.lower(), -1) + 1 or group
        out.append((zlib.crc32(str(i).encode()) % 7 == 2, own))
    return out


def built(rows):
    """(chunk, coder, frequent words with classes, units) of rows, as the chunks of a table are built."""
    import pyarrow as pa

    m = context_mixing
    column = pa.array([t for _, t, *_ in rows], pa.string())
    held = np.array([zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows])
    data, offsets = m.buffer_of(column)
    half = len(rows) // 2
    c = m.Chunk(m.chunk_body([m.read_tokens(data[: offsets[half]], offsets[: half + 1], held[:half]), m.read_tokens(data[offsets[half] :], offsets[half:] - offsets[half], held[half:])]))
    frequent = {w: k % 3 for k, (w, _) in enumerate(Counter(w.encode() for _, t, *_ in rows for w in words(t)).most_common(9))}
    h = {m.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]: k for w, k in frequent.items()}
    known = np.array(sorted(h), np.uint64)
    return c, m.Coder(c.symbols_seen()), frequent, m.Units(c, known, np.array([h[x] for x in known]))


def lm_rows():
    r = np.random.default_rng(8)
    rows = [(i, "".join(r.choice(["the ", "of ", "Le ", "la.", " ", "\n", "tion", "x", "é", "! ", "and "], int(r.integers(0, 40))))) for i in range(120)]
    return rows + [(i, t) for i, t, *_ in hard_rows() if len(t or "") < 4000]


def test_context_counts_against_plain_dictionaries():
    """The bytes of every bit's path in every kind of context, and the symbols of every document, against counts in dictionaries."""
    m = context_mixing
    rows = lm_rows()
    c, coder, frequent, u = built(rows)
    plain = plain_contexts(rows, frequent)
    counts = Counter((k, ctx, x) for held, own in plain if not held for _, _, symbols, kinds in own for k, at in enumerate(kinds) for ctx, x in zip(at, symbols, strict=True))
    by_context = {}
    for (k, ctx, x), n in counts.items():
        by_context.setdefault((k, ctx), []).append((x, n))
    find = [m.Lookup(k) for k in u.entries(coder)]
    totals = [np.zeros(len(f.keys), np.int64) for f in find]
    _, n, keys = u.expand(0, len(u.token), coder)
    for k, f in enumerate(find):
        np.add.at(totals[k], f(keys[k]), np.repeat(u.times, n).astype(np.int64))
    bits = m.Bits(u, coder, find, [m.path_counts(f.keys, x, coder)[0] for f, x in zip(find, totals, strict=True)])
    paths, node, bit, per_unit = bits(0, len(u.token))
    begin = np.cumsum(per_unit) - per_unit
    leaves = {}  # (node, way) -> symbols below
    for x in range(m.END + 1):
        r = coder.rank[x]
        for j in range(coder.begin[r], coder.begin[r] + coder.length[r]):
            leaves.setdefault((coder.node[j], coder.bit[j]), set()).add(x)
    place = 0
    for _, own in plain:
        for _, _, symbols, kinds in own:
            at = begin[u.of[place]]
            for j, x in enumerate(symbols):
                r = coder.rank[x]
                for step in range(coder.begin[r], coder.begin[r] + coder.length[r]):
                    assert (node[at], bit[at]) == (coder.node[step], coder.bit[step])
                    for k in range(m.KINDS):
                        have = by_context.get((k, kinds[k][j]), [])
                        same, other = (sum(n for y, n in have if y in leaves.get((node[at], way), ())) for way in (bit[at], 1 - bit[at]))
                        assert paths[k, at] == m.level(np.array([same]))[0] * 16 + m.level(np.array([other]))[0]
                    at += 1
            place += 1
    assert place == len(u.of)


def test_mixed_bits_against_plain_formula():
    """The loss of each bit, computed one by one."""
    m, r = context_mixing, np.random.default_rng(2)
    mixer = m.Mixer(m.END, r.normal(0.3, 0.2, (m.GATES, m.KINDS)), r.integers(0, 50, (m.END * m.BUCKETS_MAP, 1)) * np.array([[1, 0.4]]))
    paths, node, bit = r.integers(0, 256, (m.KINDS, 300)).astype(np.uint8), r.integers(0, m.END, 300), r.integers(0, 2, 300).astype(np.uint8)
    got = mixer.loss(paths, node, bit)
    for i in range(300):
        same, other = m.MEAN[paths[:, i] >> 4], m.MEAN[paths[:, i] & 15]
        known = np.searchsorted([1, 4, 40], same + other, "right")
        gate = known[-1] * 9 + min(known[-2], 2) * 3 + min(known[-3], 2)
        z = np.clip(mixer.weights[gate] @ np.log((same + m.PRIOR) / (other + m.PRIOR)), -14, 14)
        one = z if bit[i] else -z
        cell = int(np.clip((one + 8) * (m.BUCKETS_MAP - 1) / 16 + 0.5, 0, m.BUCKETS_MAP - 1))
        one = (one + mixer.map[node[i] * m.BUCKETS_MAP + cell]) / 2
        assert got[i] == pytest.approx(np.log1p(np.exp(-(one if bit[i] else -one))), abs=2e-3)


def test_probabilities_of_all_symbols_sum_to_one():
    """Whatever the counts of a context, the weights and the map: the probabilities of the symbols, each a product along its path, add up to 1."""
    m, r = context_mixing, np.random.default_rng(4)
    coder = m.Coder(r.integers(0, 1000, m.END + 1) ** 2)
    assert sum(2.0 ** -int(x) for x in coder.length) == 1.0
    ranks = np.arange(m.END + 1).astype(np.uint64)
    for _ in range(20):
        mixer = m.Mixer(m.END, r.normal(0.3, 0.2, (m.GATES, m.KINDS)), r.integers(0, 50, (m.END * m.BUCKETS_MAP, 1)) * np.array([[1, 0.4]]))
        paths = np.stack([m.path_counts((np.uint64(k) << np.uint64(9)) | ranks, r.integers(0, 3, m.END + 1) * r.integers(0, 400, m.END + 1), coder)[0] for k in range(m.KINDS)])
        loss = mixer.loss(paths, coder.node, coder.bit).astype(np.float64)
        assert np.exp(-np.add.reduceat(loss, coder.begin)).sum() == pytest.approx(1, abs=1e-4)


def test_mixer_learns_from_every_unit():
    """The map counts each bit of training text once, whatever the number of batches."""
    m = context_mixing
    for texts in ([f"word{i} and{i * 7} more{i % 50}." for i in range(1500)], ["one", ""]):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.append(0, np.cumsum([len(t) for t in texts]))
        held = np.arange(len(texts)) % 7 == 2
        c = m.Chunk(m.chunk_body([m.read_tokens(data, offsets, held)]))
        coder = m.Coder(c.symbols_seen())
        u = m.Units(c, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        find = [m.Lookup(k) for k in u.entries(coder)]
        paths = [m.path_counts(f.keys, np.ones(len(f.keys), np.int64), coder)[0] for f in find]
        _, cells, n = m.learn(u, m.Bits(u, coder, find, paths), m.Mixer(m.END))
        every = sum(int(coder.length[coder.rank[[*t.encode(), m.END]]].sum()) for t, h in zip(texts, held, strict=True) if not h)
        assert n == cells[:, 0].sum() == every


def test_events_stand_for_all_their_symbols():
    """Each distinct (last symbols, state, symbol) is worked out once: training counts and the losses of units are those of all symbols one by one."""
    m = context_mixing
    c, coder, _, u = built(lm_rows() * 3)
    e = m.Events(u, coder).count()
    find, counts = m.counted(e, coder)
    _, n, keys = u.expand(0, len(u.token), coder)
    assert 5 * len(e.times) < 3 * keys.shape[1] and e.times.sum() == np.repeat(u.times, n).sum()
    for k, f in enumerate(find):
        assert (f.keys == m.distinct(keys[k])).all()
        assert (counts[k] == np.bincount(f(keys[k]), np.repeat(u.times, n), len(f.keys))).all()
    paths = [m.path_counts(f.keys, x, coder)[0] for f, x in zip(find, counts, strict=True)]
    bits = m.Bits(e, coder, find, paths)
    w, cells, total = m.learn(e, bits, m.Mixer(m.END))
    assert total == cells[:, 0].sum() == c.count(u.of, len(u.token)) @ np.add.reduceat(coder.length[keys[0] & np.uint64(511)], np.cumsum(n) - n)
    mixer = m.Mixer(m.END, w, cells)
    loss = lambda b, size: np.add.reduceat(mixer.loss(*(x := b(0, size))[:3]).astype(np.float64), np.cumsum(x[3]) - x[3])
    assert e.by_unit(loss(bits, len(e.times))) == pytest.approx(loss(m.Bits(u, coder, find, paths), len(u.token)), rel=1e-5)


def test_language_model_learns(spark):
    """Held-out text of independent words costs little more than their entropy; repeated rows, null ids and clashing columns."""
    r = np.random.default_rng(3)
    vocabulary = [text(900 + i, 1) for i in range(40)]
    rows = [(i, " ".join(r.choice(vocabulary, 60)), 0.0) for i in range(300)]
    got = context_mixing.lm_scores(spark.createDataFrame([*rows, (None, "null id", 0.0), (7, rows[7][1], 0.0)], "doc_id long, text string, score double")).collect()
    assert len(got) == 302 and sum(x.doc_id is None for x in got) == 1 and sum(x.doc_id == 7 for x in got) == 2
    held = [x for x in got if x.held_out and x.doc_id is not None]
    assert held and -sum(x.score for x in held) * np.log2(10) / (61 * len(held)) < 1.15 * np.log2(40)


def plain_viterbi():
    """t -> ids of the path with the greatest sum of scores over the whole text; of equal sums the one whose last pieces are shorter."""
    pieces, first = sentencepiece_lattice.pieces_of()
    table = {p: (i, x) for p, i, x in pieces}
    longest, unknown = max(map(len, table)), min(x for _, _, x in pieces if x > -1e8) - 10

    def best(t):
        t = " " + t if t else ""
        at = [(0.0, 0)] + [None] * len(t)
        for e in range(1, len(t) + 1):
            for b in range(e - 1, max(-1, e - longest - 1), -1):
                p = table.get(t[b:e])
                if p or e == b + 1:
                    cost = at[b][0] - (p[1] if p else unknown)
                    if at[e] is None or cost < at[e][0]:
                        at[e] = (cost, b)
        out, e = [], len(t)
        while e:
            b = at[e][1]
            p = table.get(t[b:e])
            out = ([p[0]] if p else [first + x for x in t[b:e].encode()]) + out
            e = b
        return out

    return best


def test_pieces_against_plain_viterbi(spark):
    """Whole texts, with runs without a space, marks, characters outside the vocabulary, nulls, and null and repeated ids."""
    r = np.random.default_rng(3)
    long = text(71, 400).replace(" ", "")
    texts = [long, "https://example.org/" + long[:150], long[:63] + "漢字" * 40 + long[63:200], long[:64], long[:65], "one " + long[7:140] + " two", "\n".join(text(72, 60).split()), "a" * 900, "=" * 300, "  two  spaces ", "x▁y ▁", "", None, "\n\n\t\0"]
    texts += ["".join(r.choice(["a", "b", "the", " ", "ing", "\n", "▁", "é", "漢", ".", "1", "\U0001f600"], 150)) for _ in range(40)]
    rows = [*enumerate(texts), (3, texts[3]), (None, "null id"), (None, "null id")]
    best = plain_viterbi()
    d = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int")
    got = sentencepiece_lattice.decode(sentencepiece_lattice.encode(d, keep=True)).collect()
    assert sorted((str(x.doc_id), list(x.ids), x.text) for x in got) == sorted((str(i), best(t or ""), t or "") for i, t in rows)
    assert all(bytes(x.digest) == hashlib.sha256(x.text.encode()).digest() for x in got)


def test_pieces_of_several_chunks(spark, monkeypatch):
    """The same result when a partition is many chunks and only a few segments go by broadcast."""
    monkeypatch.setattr(sentencepiece_lattice, "CHUNK", 2000)
    monkeypatch.setattr(sentencepiece_lattice, "COMMON", 5)
    rows = [(i, text(300 + i % 17, 40 + i % 7)) for i in range(90)]
    best = plain_viterbi()
    got = sentencepiece_lattice.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((x.doc_id, list(x.ids)) for x in got) == sorted((i, best(t)) for i, t in rows)


def test_segments_are_never_crossed():
    pieces, _ = sentencepiece_lattice.pieces_of()
    pairs = sentencepiece_lattice.joined_pairs([p for p, _, _ in pieces])
    assert all(sentencepiece_lattice.segments(p[1:], pairs) == [p] for p, _, _ in pieces if len(p) > 1 and p[0] == " ")
    assert "".join(sentencepiece_lattice.segments("a b\n\ncd▁漢", pairs)) == " a b\n\ncd▁漢"


def brute_search(rows, queries, k):
    """[(query_id, rank, doc_id, score)]; ties by the smaller id, null ids last."""
    tf = [(i, Counter(words(t))) for i, t in rows]
    tf = [(i, c, sum(c.values())) for i, c in tf if c]
    n, avg = len(tf), sum(s for *_, s in tf) / len(tf)
    df = Counter(w for _, c, _ in tf for w in c)
    out = []
    for q, t in queries:
        score = [(i, sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * s / avg)) for w in sorted(set(words(t))) if w in c)) for i, c, s in tf]
        best = sorted(((-round(x, 7), i is None, i or 0) for i, x in score if x > 0))[:k]
        out += [(str(q), r, None if null else i, -x) for r, (x, null, i) in enumerate(best, 1)]
    return out


def test_search(spark, docs, monkeypatch):
    """Ids, ranks and scores on hard rows, and on many documents in several blocks, shards, rounds and passes, with equal documents and null and repeated ids."""
    r = np.random.default_rng(5)
    vocabulary = [text(i, 1) + str(i) for i in range(60)] + ["the", "of", "and"] * 10
    many = [(i, " ".join(r.choice(vocabulary, int(r.integers(1, 60))))) for i in range(700)]
    many += [(1000 + i, many[3][1]) for i in range(30)] + [(None, many[3][1]), (None, many[4][1]), (5, many[6][1]), (7, many[7][1])]
    hard = [(i, t) for i, t, *_ in hard_rows()]
    for rows, queries, settings in ((hard, hard, {}), (many, [*many[:40], (3, "the of"), (None, "the"), (90, None), (91, "nowhere")], {"SHARD": 3000, "BLOCK": 4, "PASS_QUERIES": 15, "PAIRS": 500, "CHUNK": 7})):
        for name, value in settings.items():
            monkeypatch.setattr(topk_search, name, value)
        d = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, score int, shard int")
        q = spark.createDataFrame(queries, "doc_id long, text string")
        got = sorted((str(x.query_id), x["rank"], x.doc_id, round(x.score, 7)) for x in topk_search.bm25_topk(d.repartition(2), q, 5).collect())
        want = sorted(brute_search(rows, queries, 5), key=str)
        assert len(got) == len(want)
        assert [(a, b, c) for a, b, c, _ in sorted(got, key=str)] == [(a, b, c) for a, b, c, _ in want]
        assert all(abs(x[3] - y[3]) < 1e-6 for x, y in zip(sorted(got, key=str), want, strict=True))


def test_search_prunes():
    """Blocks without a pivot are not scored: a query's rare word is in one block only, and its score beats all that common words can give."""
    many = [["common", f"w{i}"] for i in range(640)] + [["rare"] * 5 + ["common"]]
    flat = [topk_search.mix(np.array([zlib.crc32(w.encode())], np.uint64))[0] for d in many for w in d]
    x = topk_search.build(np.array(flat, np.uint64), np.array([len(d) for d in many]), np.arange(len(many)), np.zeros(len(many), bool))
    h = lambda w: topk_search.mix(np.array([zlib.crc32(w.encode())], np.uint64))
    plan = topk_search.Plan([np.unique(np.concatenate([h("rare"), h("common")]))])
    plan.idf, plan.avgdl = np.where(plan.words == h("rare")[0], 6.0, 0.01), 2.0
    s = topk_search.Shard(x, plan)
    q, d, score = s.search(1, np.zeros(1))
    assert len(q) == 1 and s.ids[s.first[d[0]]] == 640 and score[0] > 6


def test_search_repeated_queries(spark, docs):
    """A query row that occurs twice, and another text under the same id, each have a list of their own."""
    d = docs.dropDuplicates(["doc_id"])
    one = lambda i, t: [(r.rank, r.doc_id, r.score) for r in topk_search.bm25_topk(d, spark.createDataFrame([(i, t)], "doc_id long, text string"), 3).collect()]
    a, b = text(1, 120), "one a b"
    q = spark.createDataFrame([(5, a), (5, a), (5, b)], "doc_id long, text string")
    got = topk_search.bm25_topk(d, q, 3).collect()
    assert sorted((r.rank, r.doc_id, r.score) for r in got) == sorted(2 * one(5, a) + one(5, b))


def test_classifiers_hold_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    r = langid.op4_language(spark, SF).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x.lang_pred == x.lang for x in r) / len(r) > 0.95
    x = toxicity.op3_toxicity(spark, SF)
    assert x.count() == d.count() and x.where("score < 0 or score > 1 or score is null").count() == 0


def test_und_and_ties(docs):
    p = langid.Parser({"a": langid.codes("abc abc"), "b": langid.codes("abc abc")})
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, p).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "a"


def test_toxicity_learns(spark):
    rows = [(i, text(i, 40) + (" awful" if i % 3 == 0 else ""), "x", "s", 0) for i in range(400)]
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    m = toxicity.train(d, labels)
    got = toxicity.score(d, m).where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    assert sum((r.toxicity >= 0.5) == (r.doc_id % 3 == 0) for r in got) / len(got) > 0.9
    assert toxicity.reject(d, labels, m).columns == d.columns


def test_toxicity_learns_from_every_label(spark):
    """The toxic documents are those that come last by the hash of their id, behind 6,000 others."""
    ids = [r.id for r in spark.sql("select id from range(9000) where crc32(cast(cast(id as string) as binary)) % 5 <> 0 order by xxhash64(id), id").collect()]
    toxic = set(ids[6000:])
    assert len(toxic) > 300
    d = spark.createDataFrame([(i, f"w{i % 89} w{i % 97} w{i % 83}" + (" vile" if i in toxic else ""), "x") for i in ids], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in ids], "doc_id long, toxic int")
    m = toxicity.train(d, labels)
    probe = spark.createDataFrame([(i, f"w{i} w{i + 1}" + " vile" * (i % 2), "x") for i in range(40)], d.schema)
    got = {r.doc_id: r.toxicity for r in toxicity.score(probe, m).collect()}
    assert min(got[i] for i in range(1, 40, 2)) > 0.5 > max(got[i] for i in range(0, 40, 2))
    assert {r.doc_id for r in toxicity.reject(probe, labels, m).collect()} == set(range(0, 40, 2))


def test_empty_tables(spark):
    e = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (exact_dedup.exact_groups, jaccard_join.jaccard_classes, pii.pii_spans, packing.pack, suffix_dedup.dedup_passages, context_mixing.lm_scores, sentencepiece_lattice.encode):
        assert f(e).count() == 0, f
    assert langid.identify(e, langid.train(e)).count() == toxicity.score(e, toxicity.train(e, labels)).count() == topk_search.bm25_topk(e, e).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda x: {r.doc_id for r in x.select("doc_id").collect()}
    exact = cp.exact_dedup(spark, d, SF)
    near = cp.near_dedup(spark, exact, SF)
    assert exact.columns == near.columns == d.columns
    groups = {}
    for r in d.collect():
        groups.setdefault(low(r.text), []).append(r.doc_id)
    assert ids(exact) == {max(g) for g in groups.values()}
    kept = [(r.doc_id, r.text) for r in exact.collect()]
    assert ids(near) == {c if n else i for i, n, c in brute_classes(kept)}


def test_pipeline_null_and_repeated_ids(spark):
    """Rows are dropped for their text, never for an id that is null or that another text has too."""
    import corpus_pipeline as cp

    a, b, c = text(61, 120), text(62, 120), text(63, 120)
    near = lambda t, k: " ".join([*t.split()[:60], f"x{k}", *t.split()[61:]])
    rows = [(5, a), (9, a.upper()), (5, b), (None, c), (None, c), (None, text(64, 90)), (7, text(65, 90)), (None, text(65, 90)), (3, text(66, 90)), (3, text(66, 90)), (11, None), (None, "")]
    d = spark.createDataFrame([(i, t, "l", f"s{n}", n) for n, (i, t) in enumerate(rows)], SCHEMA)
    got = [(r.doc_id, low(r.text)) for r in cp.exact_dedup(spark, d, SF).collect()]
    want = [(9, a), (5, b), (None, c), (None, text(64, 90)), (7, text(65, 90)), (3, text(66, 90)), (11, "")]
    assert sorted(got, key=str) == sorted(want, key=str)
    rows = [(4, a), (4, near(a, 1)), (4, b), (None, c), (None, near(c, 1)), (None, text(64, 90)), (None, near(b, 2)), (None, None), (8, "one"), (8, "")]
    d = spark.createDataFrame([(i, t, "l", "s", 0) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in cp.near_dedup(spark, d, SF).collect()]
    assert len(got) == 7 and {(4, b), (None, text(64, 90)), (None, None), (8, "one"), (8, "")} < set(got)
    assert len({(4, a), (4, near(a, 1))} & set(got)) == 1 and len({(None, c), (None, near(c, 1))} & set(got)) == 1


def test_links_come_from_pivots_and_windows():
    """Regions of near copies, of unlike sets, and chains: what unites sets are pivots and windows, and the classes are those of brute force."""
    r = np.random.default_rng(12)
    for trial in range(40):
        base = [r.choice(10_000, 60, replace=False) for _ in range(int(r.integers(1, 6)))]
        sets = []
        for _ in range(int(r.integers(2, jaccard_join.SMALL + 1))):
            s = base[int(r.integers(len(base)))].copy()
            s[r.choice(60, int(r.integers(0, 12)), replace=False)] = 10_000 + r.integers(0, 10**6)
            sets.append(np.unique(s[: int(r.integers(40, 61))]).astype(np.uint64))
        region = jaccard_join.Region(sets)
        region.join(np.arange(len(sets)))
        up = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j]))
                if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                    a, b = up[i], up[j]
                    up = [min(a, b) if x in (a, b) else x for x in up]
        assert [up.index(x) for x in up] == [[region.forest.find(k) for k in range(len(sets))].index(region.forest.find(i)) for i in range(len(sets))]
        assert region.found["index"] == 0 and sum(region.found.values()) == len(sets) - len(set(up))


def test_phrases_against_plain_parsing(monkeypatch):
    """Phrases carry on over the borders of the layout: each is the longest match in the language's text."""
    monkeypatch.setattr(langid, "PART", 7)
    monkeypatch.setattr(langid, "WIDE", 3)
    r = np.random.default_rng(4)
    learned = {k: "".join(r.choice(list("abcde "), 300, p=q)) for k, q in (("x", [0.4, 0.3, 0.1, 0.05, 0.05, 0.1]), ("y", [0.05, 0.1, 0.1, 0.4, 0.25, 0.1]), ("z", [0.2, 0.2, 0.2, 0.1, 0.2, 0.1]))}
    texts = ["".join(r.choice(list("abcdef "), int(n))) for n in r.integers(0, 90, 25)] + ["", "ffff", learned["x"]]
    p = langid.Parser({k: langid.codes(v) for k, v in learned.items()})
    got = p.phrases([langid.codes(t) for t in texts])

    def plain(s, t):
        n, match = 0, ()
        for c in t:
            if match and any(s[i : i + len(match) + 1] == (*match, c) for i in range(len(s))):
                match = (*match, c)
            else:
                n, match = n + 1, (c,) if c in s else ()
        return n

    for t, row in zip(texts, got, strict=True):
        assert row.tolist() == [plain(tuple(langid.codes(learned[k]).tolist()), tuple(langid.codes(t).tolist())) for k in p.langs]


def test_more_languages_than_a_table_holds(spark, monkeypatch):
    """Every language is learned, and groups of tables give the same as one."""
    r = np.random.default_rng(9)
    letters = [list(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6, replace=False)) for _ in range(7)]
    rows = [(i, " ".join("".join(r.choice(letters[i % 7], 5)) for _ in range(30)), f"l{i % 7}", 0.0) for i in range(210)] + [(None, "null id", "l1", 0.0), (500, None, "l1", 0.0), (501, "12 34", None, 0.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    one = langid.identify(d, langid.train(d)).collect()
    monkeypatch.setattr(langid, "GROUP", 3)
    parsers = langid.train(d)
    many = langid.identify(d, parsers).collect()
    assert [len(p.langs) for p in parsers] == [3, 3, 1] and sorted(map(str, one)) == sorted(map(str, many)) and len(many) == len(rows)
    truth = {i: lang for i, _, lang, _ in rows[:210]}
    assert sum(x.lang_pred == truth[x.doc_id] for x in many if x.doc_id in truth) > 200
    assert {x.doc_id: (x.lang_pred, x.score) for x in many if x.doc_id in (500, 501)} == {500: ("und", 0.0), 501: ("und", 0.0)}


def test_base_spans_against_plain_patterns():
    """The four base patterns as they are given, by plain re, on random strings of what they are made of."""
    plain = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def good(k, s):
        d = re.sub("[^0-9]", "", s)
        return (True, all(int(x) <= 255 for x in s.split(".")) if k == 1 else True, 16 <= len(d) <= 19 and pii.luhn(d), 8 <= len(d) <= 15)[k]

    r = np.random.default_rng(6)
    for n in range(6000):
        t = "".join(r.choice(list("a@.-+_ 0123456789().\n"), int(r.integers(0, 60)), p=None if n % 2 else [0.05, 0.05, 0.15, 0.05, 0.05, 0.02, 0.08, *[0.05] * 10, 0.01, 0.02, 0.01, 0.01]))
        if n % 5 == 0:
            t = "4111 1111-1111 1111".replace("4", "45"[n % 2]) + t
        want = [[m.span() for m in p.finditer(t) if good(k, m.group())] for k, p in enumerate(plain)]
        assert pii.base_spans(t) == want, t


def test_added_spans_are_right():
    """Spans beyond the base ones: personal data in looser forms, whole; and none in hard negatives."""
    trees, limits = pii.model()
    yes = {"call +1 (826) 555-4081 110.220.130.140 now": "+1 (826) 555-4081", "our phone: 415-555-0199, please": "415-555-0199", "write bob7 [at] site.org today": "bob7 [at] site.org", "the server 10[.]0[.]12[.]7 is down": "10[.]0[.]12[.]7", "card 4111.1111.1111.1111 ok": "4111.1111.1111.1111"}
    for t, s in yes.items():
        base, added = pii.find_spans(t, trees, limits)
        assert any(t[a:b] == s for _, a, b in [*added, *((k, *x) for k, own in enumerate(base) for x in own)]), (t, base, added)
    for t in ("order 1234.5678.9012.3456 is late", "meet at (at) noon . sharp", "version 1 . 2 . 3 . 4 of it", "page 12 and 13", "", "1 2 3 4 5 6 7 8 9"):
        assert pii.find_spans(t, trees, limits)[1] == []


def test_null_ids_link_and_clashing_columns_stay(spark):
    import corpus_pipeline as cp

    a, b = text(81, 120), text(82, 120)
    near = " ".join([*a.split()[:60], "changed", *a.split()[61:]])
    d = spark.createDataFrame([(1, a), (None, near), (None, near), (None, b), (4, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.jaccard_classes(d).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (None, 1), (None, None), (4, 4)], key=str)
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(150).selectExpr("*", "1.5 as toxicity", "'q' as _toxicity", "7 as digest", "'k' as v")
    kept = cp.toxicity(spark, d, SF)
    assert kept.columns == d.columns and kept.where("toxicity <> 1.5 or _toxicity <> 'q'").count() == 0 and 100 < kept.count() <= 150
    for stage in (cp.exact_dedup, cp.near_dedup, cp.redact_pii):
        kept = stage(spark, kept, SF)
        assert kept.columns == d.columns and kept.where("digest <> 7 or v <> 'k'").count() == 0
    assert cp.packing(spark, kept, SF).count() >= kept.count() > 0


def test_toxicity_score_against_plain_loops():
    """Embeddings of a word's parts added up, filters over every position with padding behind the end, the largest response of each, and the logistic layer; one number at a time."""
    m, r = toxicity, np.random.default_rng(3)
    net = m.ConvNet()
    net.emb = r.normal(0, 1, (m.ROWS + 1, m.DIM)).astype(np.float32)
    net.emb[m.ROWS] = 0
    for w in m.WIDTHS:
        net.taps[w], net.bias[w] = r.normal(0, 0.5, (w, m.DIM, m.FILTERS)).astype(np.float32), r.normal(0, 0.5, m.FILTERS).astype(np.float32)
    net.out, net.out_bias = r.normal(0, 0.3, m.FILTERS * len(m.WIDTHS)).astype(np.float32), 0.1
    net.multiply_out()
    texts = [t or "" for _, t, *_ in hard_rows() if len(t or "") < 2500]
    import pyarrow as pa

    rows, counts = m.hashed(*m.buffer_of(pa.array(texts)))
    got = net.score(rows, counts)
    ends = np.cumsum(counts)
    for t, lo, hi, score in zip(texts, ends - counts, ends, got, strict=True):
        assert hi - lo == len(words(t))
        vectors = [sum(net.emb[x] for x in row) for row in rows[lo:hi]]
        pooled = []
        for w in m.WIDTHS:
            for f in range(m.FILTERS):
                at = [sum(float(vectors[i + k] @ net.taps[w][k][:, f]) for k in range(w) if i + k < len(vectors)) for i in range(len(vectors))]
                pooled.append(max(max(at) + net.bias[w][f], 0) if at else 0.0)
        assert score == pytest.approx(1 / (1 + np.exp(-(np.dot(pooled, net.out) + net.out_bias))), abs=1e-4)


def test_toxicity_gathers_a_word_once(monkeypatch):
    """Scoring reads one row of the joined tables for each part of a word; slices and a net that was sent give the same scores."""
    import pickle

    m, r = toxicity, np.random.default_rng(6)
    net = m.start(r.integers(0, 9, m.ROWS + 1).astype(float), r.integers(0, 9, m.ROWS + 1).astype(float), 0.3).multiply_out()
    counts = r.choice([0, 1, 2, 3, 40], 60)
    words = r.integers(0, m.ROWS, (counts.sum(), len(m.PARTS)))
    taken, take = [], np.take
    monkeypatch.setattr(np, "take", lambda a, i, **k: taken.append(np.size(i)) or take(a, i, **k))
    whole = net.score(words, counts)
    assert sum(taken) == words.size
    sent = pickle.loads(pickle.dumps(net))
    ends = np.cumsum(counts)
    assert np.allclose(whole, np.concatenate([sent.score(words[e - n : e], np.array([n])) for e, n in zip(ends, counts, strict=True)]), atol=1e-6)
    assert len(pickle.dumps(net)) < 1.1 * net.emb.nbytes + 10_000


def shuffled(spark):
    """Bytes that all stages so far wrote for exchanges."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_toxicity_moves_packed_texts(spark, tmp_path):
    """With labels for all documents, the join's exchange and the rows that are kept take less than four fifths of what they take with plain texts."""
    ids = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5]
    d = spark.createDataFrame([(i, text(i, 300), "x") for i in ids], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in ids], "doc_id long, toxic int")

    def cost(df, name):
        before = shuffled(spark)
        df.write.parquet(str(tmp_path / name))
        return shuffled(spark) - before, sum(p.stat().st_size for p in (tmp_path / name).rglob("*.parquet"))

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, packed = cost(d.repartition(4, "doc_id"), "plain"), cost(toxicity.labelled(d, labels), "packed")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert spark.read.parquet(str(tmp_path / "packed")).count() == len(ids)
    assert sum(packed) < 0.8 * sum(plain) and plain[0] > 100_000


def test_packed_texts_come_back_a_few_at_a_time():
    import pyarrow as pa

    texts = [t for _, t, *_ in hard_rows()] + ["a" * 3_000_000, None, ""]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    sent = list(common.packed([b.slice(0, 0), b.slice(2), b]))
    got = list(common.unpacked(sent, 4000))
    assert [x for g in got for x in g.column("doc_id").to_pylist()] == [*range(2, len(texts)), *range(len(texts))]
    assert [x.decode() for g in got for x in g.column("text").to_pylist()] == [t or "" for t in texts[2:] + texts]
    assert all(len(g) == 1 or sum(map(len, g.column("text").to_pylist())) <= 4000 for g in got) and sum(len(x) for x in sent) > len(got)
    assert sum(len(x) for s in sent for x in s.column("text").to_pylist()) < 100_000


def test_word_parts_are_hashed_alike():
    """Words that share their first four or six bytes share rows; case doesn't matter, and shorter words have no longer parts than themselves."""
    import pyarrow as pa

    rows, counts = toxicity.hashed(*toxicity.buffer_of(pa.array(["Information informal infomercial INFORMATION", "inform", None, " "])))
    assert counts.tolist() == [4, 1, 0, 0] and (rows[0] == rows[3]).all()
    assert rows[0, 1] == rows[1, 1] == rows[2, 1] and rows[0, 2] == rows[1, 2] != rows[2, 2] and rows[4, 2] == rows[0, 2]


def test_few_bins_against_the_best_packing():
    """Never more than one bin over the optimum on small cases, found by trying all ways."""
    r = np.random.default_rng(7)

    def best(items, capacity):
        items, low = sorted(items, reverse=True), [len(items)]

        def place(i, bins):
            if len(bins) >= low[0]:
                return
            if i == len(items):
                low[0] = len(bins)
                return
            for k in {b: j for j, b in enumerate(bins)}.values():
                if bins[k] + items[i] <= capacity:
                    bins[k] += items[i]
                    place(i + 1, bins)
                    bins[k] -= items[i]
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return low[0]

    over = 0
    for _ in range(60):
        items = r.integers(1, 21, int(r.integers(1, 10))).tolist()
        bins = packing.plan(np.bincount(items, minlength=21), 20)
        assert sorted(x for n, b in bins for x, k in b for _ in range(k) for _ in range(n)) == sorted(items)
        assert all(sum(x * k for x, k in b) <= 20 for _, b in bins)
        over += sum(n for n, _ in bins) - best(items, 20)
        assert sum(n for n, _ in bins) <= best(items, 20) + 1
    assert over <= 3
