"""Each operator against a brute-force version, over odd and empty tables."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quireflow.llm import factorization, mixing, near_dedup, packing, quality_rules, revisits, spotsigs, suffixes, textvec, token_counts, toxicity
from quireflow.llm.bpe import WordBpe, tokenizer_path
from quireflow.llm.components import components

from . import helpers as H

SPACES = r"[^\x20\x09-\x0D]+"


def texts(rows=None):
    return [(r[0], r[1] or "") for r in (rows or H.odd_rows())]


# texts of any length


def drawn(how):
    rng, n = np.random.default_rng(2), how.filters * len(how.widths)
    draw = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    model = {"word": draw(how.buckets, how.width), "stem": draw(how.buckets, how.width), "kernel": draw(how.width, how.filters * sum(how.widths))}
    return model | {"bias": draw(n), "out": draw(n), "b": draw(1), "cut": np.zeros(len(toxicity.FUNCTION_WORDS) + 1)}


def found(rows):
    """What the operators make of each text."""
    out = [[] for _ in rows]
    net = toxicity.Network(at_once=near_dedup.RUN)
    model = drawn(net)
    for how in (near_dedup.NearDedup(), near_dedup.NearDedup(counted=True)):
        for at, part in textvec.blocks(rows):
            h, weight, first = near_dedup.shingles(part, how)
            kept, some = near_dedup.signatures(part, how)
            bucket, share, begin, stats = factorization.vectors(part, 1 << 15)
            score = toxicity.scores_of(model, part, net)
            for i in range(len(part)):
                own, mine = slice(first[i], first[i + 1]), slice(begin[i], begin[i + 1])
                out[at + i] += [h[own].tolist(), weight[own].tolist(), kept[i].tolist(), bool(some[i]), bucket[mine].tolist(), share[mine].tolist(), stats[i].tolist(), round(float(score[i]), 4)]
    for n, p in enumerate(spotsigs.fingerprints(rows)):
        out[n].append(spotsigs.written(p))
    return out


def test_long_texts_by_pieces(monkeypatch):
    """Pieces that cut words, shingles and chains anywhere give what the whole text gives."""
    rows = [t.encode() for _, t in texts()[:8] + texts()[9:]] + [(H.prose(9, 700) + " the of and " + "x" * 900).encode(), b"the " * 90 + b"cat sat far off", "é漢 ".encode() * 70]
    want = found(rows)
    monkeypatch.setattr(textvec, "BLOCK", 61)
    for module in (near_dedup, spotsigs):
        monkeypatch.setattr(module, "RUN", 23)
    assert found(rows) == want


def test_spans(monkeypatch):
    """Every text in one run, in order; a run over the bound is a single text, and no two neighbours fit in one."""
    monkeypatch.setattr(textvec, "BLOCK", 10)
    assert list(textvec.spans([])) == []
    for seed in range(50):
        sizes = np.random.default_rng(seed).integers(0, 15, seed).tolist()
        runs = list(textvec.spans(sizes))
        assert [i for a, b in runs for i in range(a, b)] == list(range(len(sizes)))
        assert all(b > a and (b == a + 1 or sum(sizes[a:b]) <= 10) for a, b in runs)
        assert all(sum(sizes[a:b]) + sizes[b] > 10 for a, b in runs[:-1])


def test_memory_of_a_long_text():
    """Worker memory for a text is a bounded multiple of its bytes (words of five bytes here)."""
    net = toxicity.Network()
    model = drawn(net)
    text = " ".join(f"{n * 2654435761 % 2**16:04x}" for n in range(4_000_000)).encode()
    for run in (
        lambda: near_dedup.signatures([text], near_dedup.NearDedup()), lambda: spotsigs.fingerprints([text]),
        lambda: factorization.vectors([text], 1 << 15), lambda: toxicity.scores_of(model, [text], net),
    ):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 18 * len(text)


# 1 near duplicates


def shingle_set(text):
    w = re.findall(SPACES, text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup(spark):
    got = sorted((tuple(r) for r in near_dedup.classes(H.odd(spark)).collect()), key=repr)
    sets = {t: shingle_set(t) for _, t in texts()}
    group = {t: {u for u in sets if u == t or (sets[t] | sets[u] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u]))} for t in sets}
    want = []
    for d, t in texts():
        own = [i for i, u in texts() if u in group[t]]
        known = [i for i in own if i is not None]
        want.append((d, min(known) if known else None, len(own), sum(u == t for _, u in texts())))
    assert got == sorted(want, key=repr)
    assert near_dedup.classes(H.none(spark)).count() == 0
    kept = near_dedup.one_of_each(H.odd(spark))
    assert kept.columns == H.odd(spark).columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c, _, _ in want}


def test_near_dedup_of_large_buckets(spark):
    """Pairs of copies in buckets that all documents share, which are dealt out to many parts."""
    base, rows = H.prose(1, 200).split(), []
    for n in range(40):
        own = base[:80] + [f"own{n}x{i}" for i in range(25)] + base[105:]
        rows += [(2 * n, " ".join(own)), (2 * n + 1, " ".join([*own[:-1], "end"]))]
    sets = [shingle_set(t) for _, t in rows]
    want = sorted((i, min(j for j in range(len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))) for i in range(len(rows)))
    how = near_dedup.NearDedup(bands=2, rows=1, dealt=4)
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), how).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == want


def test_one_of_each_by_row(spark):
    """Near copies without ids, and an id that stands for two texts, one of them a near copy of another's."""
    a, b, c = (H.prose(n, 120) for n in (1, 2, 3))
    rows = [(None, a), (None, a + " end"), (None, b), (3, b + " end"), (4, c), (4, b + " last"), (4, c)]
    got = near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [(r.doc_id, r.text) for r in got]
    assert len(kept) == 3 and {(3, b + " end"), (4, c)} < set(kept)
    assert {k for k in kept if k[0] is None} < {(None, a), (None, a + " end")}


def test_signatures_estimate_weighted_similarity():
    how = near_dedup.NearDedup(counted=True)
    a, b = "x y z w v " * 30 + H.prose(1, 200), "x y z w v " * 10 + H.prose(1, 200)
    kept, some = near_dedup.signatures([a.encode(), b.encode(), b""], how)
    h, weight, first = near_dedup.shingles([a.encode(), b.encode()], how)
    p, q = ({x: y for x, y in zip(h[first[i] : first[i + 1]].tolist(), weight[first[i] : first[i + 1]].tolist(), strict=True)} for i in (0, 1))
    exact = sum(min(p.get(x, 0), q.get(x, 0)) for x in p | q) / sum(max(p.get(x, 0), q.get(x, 0)) for x in p | q)
    assert abs((kept[0] == kept[1]).mean() - exact) < 0.12
    assert some.tolist() == [True, True, False]
    assert (near_dedup.signatures([a.encode()], how)[0][0] == kept[0]).all()


def test_components(spark):
    links = [(3, 2), (2, 1), (9, 8), (7, 8), (5, 5)]
    got = components(spark.createDataFrame(links, "u long, v long"))
    assert sorted(tuple(r) for r in got.collect()) == [(2, 1), (3, 1), (8, 7), (9, 7)]


# 2 fingerprints


def test_spotsigs(spark):
    rows = spotsigs.compared(H.odd(spark), spotsigs.Spots(part_bytes=20_000)).collect()
    order = sorted(texts(), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    want = Counter()
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        p, q, n = spotsigs.fingerprints([t.encode(), edited.encode(), after.encode()])
        want[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.written(p), spotsigs.written(q), spotsigs.likeness(p, q), spotsigs.likeness(p, n)] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert spotsigs.compared(H.none(spark)).count() == 0


def chains(text):
    w = [x.lower() for x in re.findall(r"[0-9A-Za-z]+", text)]
    common = set(spotsigs.ANCHORS.split())
    content = [i for i, x in enumerate(w) if x not in common]
    anchored = {(w[i], *(w[j] for j in after[:3])) for i, x in enumerate(w) if x in common and len(after := [j for j in content if j > i]) >= 3}
    return anchored, {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def test_fingerprints_are_chains():
    rng = np.random.default_rng(5)
    pool = ["the", "of", "and", *H.WORDS]
    docs = [" ".join(rng.choice(pool, int(n))) for n in rng.integers(4, 60, 30)]
    docs += ["the " + docs[0], "one two three four five six", "the one two three four five six"]
    prints = spotsigs.fingerprints([t.encode() for t in docs])
    for i, a in enumerate(docs):
        for j, b in enumerate(docs):
            (p, e), (q, f) = chains(a), chains(b)
            x, y = (p, q) if min(len(p), len(q)) >= 8 else (e, f)
            assert np.isclose(spotsigs.likeness(prints[i], prints[j]), len(x & y) / len(x | y) if x | y else 1.0)
    assert spotsigs.likeness(prints[-1], prints[-2]) == 0.75
    long = [" ".join(f"w{n}" for n in range(at, at + 4000)) for at in (0, 1000)]
    assert abs(spotsigs.likeness(*spotsigs.fingerprints([t.encode() for t in long])) - 0.6) < 0.2


def test_near_pairs(spark):
    docs = [" the ".join(re.findall(r"(?:\S+ ){5}", H.prose(n % 6, 80 + n))) for n in range(30)]
    got = {(r.u, r.v) for r in spotsigs.near_pairs(spark.createDataFrame([(t,) for t in docs], "text string"), 0.7).collect()}
    prints = {spotsigs.written((p,)): chains(t)[0] for t, (p, _) in zip(docs, spotsigs.fingerprints([t.encode() for t in docs]), strict=True)}
    assert got == {(a, b) for a in prints for b in prints if a < b and len(prints[a] & prints[b]) >= 0.7 * len(prints[a] | prints[b])} != set()
    assert spotsigs.near_pairs(H.none(spark)).count() == 0


# 3 repeated strings


def removed(rows, depth=50):
    key = lambda d: -(2**63) if d is None else d
    first = {}
    for d, t in sorted(((key(d), t.encode()) for d, t in rows), key=lambda r: r[0]):
        for i in range(len(t) - depth + 1):
            first.setdefault(t[i : i + depth], d)
    for d, t in rows:
        b = t.encode()
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - depth + 1):
            if first[b[i : i + depth]] < key(d):
                mask[i : i + depth] = True
        spans = int((np.diff(mask.astype(int), prepend=0) == 1).sum())
        yield d, len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()


def test_suffixes(spark, monkeypatch):
    rows = H.odd_rows() + [(20, "short", "en", "a", 0, 0.5, "x"), (21, H.prose(3, 20000)[5000:9000], "fr", "c", 0, 0.5, "x")]
    got = suffixes.digests(spark.createDataFrame(rows, H.SCHEMA))
    assert Counter(tuple(r) for r in got.collect()) == Counter(removed(texts(rows)))
    assert suffixes.digests(H.none(spark)).count() == 0
    cut = suffixes.without_repeats(H.odd(spark))
    assert cut.columns == H.odd(spark).columns
    assert {r.doc_id for r in cut.collect()} >= {4, 7, 8, 9, 10, 12, None}


@pytest.mark.parametrize("how", [suffixes.Depth(8, 4, 200), suffixes.Depth(8, 3, 10**9, 2), suffixes.Depth(20, 5, 300, 3, 1)])
def test_suffixes_of_texts_that_repeat_themselves(spark, monkeypatch, how):
    """Few different bytes: frequent minimizers, dealt out by suffixes; ties of ids; strings cut at their longest."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 20)) or None, "".join(rng.choice(list("abc"), int(rng.integers(0, 90))))) for _ in range(40)]
    rows += [(30, "ab" * 2000), (31, "x" + "ab" * 1500 + "y"), (32, "é" * 40), (33, "é" * 30)]
    docs = spark.createDataFrame([(d, t, "a", "b", 1, 2) for d, t in rows], "doc_id long, text string, row string, c0 string, spans int, size int")
    assert Counter(tuple(r) for r in suffixes.digests(docs, how).collect()) == Counter(removed(rows, how.depth))
    cut = suffixes.without_repeats(docs, how)
    assert cut.columns == docs.columns and {(r.row, r.c0, r.spans, r.size) for r in cut.collect()} == {("a", "b", 1, 2)}


def test_least_of_equal_suffixes():
    rng = np.random.default_rng(0)
    for depth in (3, 8, 9, 50):
        data = bytes(rng.integers(97, 99, 200).astype(np.uint8))
        at, key = np.arange(len(data) - depth + 1), rng.integers(0, 4, len(data) - depth + 1)
        want = [min(key[j] for j in at if data[j : j + depth] == data[i : i + depth]) for i in at]
        assert suffixes.least_of_equal(data + bytes(8), at, key, depth).tolist() == want


def test_keys_come_back():
    for keys in ([], [5], [-(2**63), 0, 2**63 - 1], [1, 1, 2, 300], [*range(1000), 2**40]):
        k = np.array(keys, np.int64)
        assert (suffixes.unpacked_keys(suffixes.packed_keys(k)) == k).all()


# 4 and 10 classifiers


@pytest.mark.parametrize("module, columns", [(toxicity, None), (factorization, None)])
def test_classifiers(spark, module, columns):
    got = module.scores(H.odd(spark), H.labels(spark)).collect()
    modulus, held = (4, 2) if module is toxicity else (3, 1)
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((d, d is not None and zlib.crc32(str(d).encode()) % modulus == held) for d, _ in texts())
    cut = 0.3 if module is toxicity else 0.5
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)
    by_text = defaultdict(set)
    for r, (_, t) in zip(sorted(got, key=lambda r: repr(r.doc_id)), sorted(texts(), key=lambda r: repr(r[0])), strict=True):
        by_text[t].add(r.score)
    assert all(max(s) - min(s) < 1e-6 for s in by_text.values())
    assert module.scores(H.none(spark), H.labels(spark)).count() == 0
    assert module.scores(H.odd(spark), H.labels(spark).limit(0)).count() == len(texts())


def test_held_out_accuracy():
    clean, bad = [H.prose(n, 60) for n in range(300)], [H.prose(n, 60) + " stupid " + H.prose(n + 1000, 60) for n in range(100)]
    rows, y = [t.encode() for t in clean[:200] + bad[:70]], [0] * 200 + [1] * 70
    how = toxicity.Network()
    model = toxicity.fit(rows, y, how)
    p = toxicity.scores_of(model, [t.encode() for t in clean[200:] + bad[70:]], how) >= how.threshold
    assert (p == np.array([0] * 100 + [1] * 30)).mean() > 0.95
    junk = ["# " + "spam " * n + "$$ %% " * n for n in range(20, 120)]
    m = factorization.Machine()
    model = factorization.fit([t.encode() for t in clean[:200] + junk[:70]], [1] * 200 + [0] * 70, m)
    bucket, share, first, stats = factorization.vectors([t.encode() for t in clean[200:] + junk[70:]], m.buckets)
    z, _ = factorization.score(model, bucket, share, first, factorization.binned(stats, model["edges"], m.buckets))
    assert ((z >= 0) == np.array([1] * 100 + [0] * 30)).mean() > 0.95


def test_interactions_in_linear_time():
    rng = np.random.default_rng(1)
    v, x = rng.standard_normal((6, 3)), rng.random(6).astype(np.float32)
    model = {"b": np.zeros(1), "w": np.zeros(6), "v": v}
    z, _ = factorization.score(model, np.arange(6), x, np.array([0, 6]), np.zeros((1, 0), int))
    assert np.isclose(z[0], sum(v[i] @ v[j] * x[i] * x[j] for i in range(6) for j in range(i)))


# 5 revisits


def test_revisits(spark):
    schema = "record_id long, kind string, url string, ts long, etag string, last_modified string, digest string, headers map<string,string>, length long"
    full = lambda i, url, ts, etag, mod=None: (i, "response", url, ts, etag, mod, f"d{i}", {"etag": etag or "-", "content-length": "9"}, 9)
    again = lambda i, url, ts, etag=None, mod=None, dig=None, headers=None: (i, "revisit", url, ts, etag, mod, dig, headers, 0)
    rows = [
        full(1, "http://www.A.org/p/?b=2&a=1", 10, '"x"'), full(2, "https://a.org/p?a=1&utm_source=f&b=2#frag", 200_000, '"y"', "m"), again(3, "a.org:80/p/index.html?b=2&a=1", 50, 'W/"x"', headers={"content-length": "0", "etag": "new"}),
        again(4, "http://a.org/p?a=1&b=2", 200_000, '"x"'), again(5, "http://a.org/p?a=1&b=2", 200_001, '"x"'), again(6, "http://a.org/p?a=1&b=2", 900_000, None, "m"), again(7, "http://a.org/p?a=1&b=2", 900_000), again(8, "http://b.org", 5, '"x"'),
        again(9, None, 5, '"x"'), again(10, "http://a.org/p?a=1&b=2", None, '"x"'), again(11, "http://a.org/p?a=1&b=2", 900_000, None, None, "d2"), again(11, "http://a.org/p?a=1&b=2", 900_000, None, None, "d2"),
    ]
    got = revisits.resolved(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.record_id, r.outcome, r.target_id) for r in got) == [
        (3, "resolved", 1), (4, "resolved", 1), (5, "mismatch", None), (6, "resolved", 2), (7, "unverified", None), (8, "missing", None), (9, "missing", None), (10, "missing", None), (11, "resolved", 2), (11, "resolved", 2),
    ]
    assert next(r.headers for r in got if r.record_id == 3) == "content-length: 9\netag: new"
    assert revisits.resolved(spark.createDataFrame([], schema)).count() == 0


# 6 and 8 tokens


def test_token_counts(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    extra = ["a  b", " lead", "trail ", "x\n \ny", "it's\tI'll", "tab \t b", "é́ 　z"]
    rows = H.odd_rows() + [(100 + n, t, "en", "a", 0, 0.5, "x") for n, t in enumerate(extra)]
    got = token_counts.token_counts(spark.createDataFrame(rows, H.SCHEMA), token_counts.byte_counting())
    want = Counter()
    for d, t in texts(rows):
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        want[d, len(t.encode()), n, n > 1024] += 1
    assert Counter(tuple(r) for r in got.collect()) == want
    assert token_counts.token_counts(H.none(spark), token_counts.byte_counting()).count() == 0


def test_token_counts_of_what_is_no_utf8(spark):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = [(1, b"plain \xff\xfe text"), (2, b"\xe6\xbc two  spaces"), (3, b"x" * 5000 + b" \x80")]
    docs = spark.createDataFrame([(d, bytearray(t)) for d, t in rows], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, token_counts.byte_counting()).collect()}
    assert got == {d: (len(t), len(tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids)) for d, t in rows}


def test_cache_keeps_short_pieces_only():
    from quireflow.llm.bpe import KEPT, Cache

    made = []
    cache = Cache(lambda k: made.append(k) or len(k), {b"a": 1}, 3)
    assert [cache[k] for k in (b"a", b"bb", b"bb", b"x" * 100, b"x" * 100, b"cc", b"dd", b"a")] == [1, 2, 2, 100, 100, 2, 2, 1]
    assert made == [b"bb", b"x" * 100, b"x" * 100, b"cc", b"dd"] and all(len(k) <= KEPT for k in cache)


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = packing.packed(H.odd(spark), packing.word_packing()).collect()
    want = Counter()
    for d, t in texts():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[d, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    rows = defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for places in rows.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    assert packing.packed(H.none(spark), packing.word_packing()).count() == 0


def test_words_like_the_library():
    bpe = WordBpe(tokenizer_path("word_bpe_49k.json"))
    for chunk in ("Hello,", "it's", "O'Neill's", "Straße|x", "naïve--ÉCOLE", "a1b22", "<|endoftext|>x", "ΑΣ", "İi", "'''", "%%$$"):
        assert bpe.ids(chunk) == bpe.library.ids(chunk)


@pytest.mark.parametrize("counts", [{}, {2048: 3}, {1000: 5, 24: 10, 1: 7}, {1500: 4, 700: 3, 500: 9, 48: 2}, {1: 5000}])
def test_sweeps_place_every_piece_once(counts):
    used, seen = defaultdict(list), Counter()
    for length, rank, first, each, offset in packing.sweeps(counts, 2048):
        following = [p[1] for p in sorted(packing.sweeps(counts, 2048)) if p[0] == length and p[1] > rank]
        for nth in range((following[0] if following else counts[length]) - rank):
            used[first + nth // each].append((offset + nth % each * length, length))
            seen[length] += 1
    assert seen == Counter(counts)
    for places in used.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 2048


def best_fit(counts, capacity):
    gaps = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        fits = [g for g in gaps if g >= length]
        gap = min(fits) if fits else capacity
        if fits:
            gaps.remove(gap)
        gaps.append(gap - length)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sweeps_are_best_fit(seed):
    """The sequences are filled as by placing the longest document left, one by one, into the smallest gap."""
    rng = np.random.default_rng(seed)
    counts = {int(n): int(k) for n, k in zip(rng.integers(1, 100, 30), rng.integers(1, 9, 30), strict=True)}
    left, placed = Counter(), sorted(packing.sweeps(counts, 100))
    for i, (length, rank, first, each, _) in enumerate(placed):
        end = placed[i + 1][1] if i + 1 < len(placed) and placed[i + 1][0] == length else counts[length]
        for nth in range(end - rank):
            left[first + nth // each] += length
    assert sorted(100 - n for n in left.values()) == best_fit(counts, 100)


# 7 quality rules and 9 mixing


def classes_of(text):
    kinds = (r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[#*$%&|<>]", r"[^\x00-\x7F]")
    lower, upper, digit, space, symbol, beyond = (len(re.findall(k, text)) for k in kinds)
    return np.array([lower, upper, digit, space, symbol, len(text) - lower - upper - digit - space - symbol - beyond, beyond], float)


def words_in(text):
    w = Counter(re.findall(SPACES, text))
    common = [w[x] for x in quality_rules.COMMON_WORDS]
    return np.array([*common, w.total() - sum(common)], float)


def distance(p, q):
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return np.sqrt(sum(x * np.log2(x / y) for r in (p, q) for x, y in zip(r, m, strict=True) if x) / 2)


def test_divergence(spark):
    """Distances and verdicts by brute force: letters of three bytes, a text without common words, a list of digits."""
    usual = [" ".join(x + ("", " the", "", " and")[i % 4] for i, x in enumerate(H.prose(n, 260).split())) for n in range(12)]
    rows = [(n, t, "en") for n, t in enumerate(usual)] + [(20, H.prose(30, 300), "en"), (21, "12 34 567 " * 2 + " ".join(str(n * n) for n in range(300)), "en"), (22, " ".join("漢字かな交じり文"[n % 7 :] + str(n) for n in range(210)), "ja"), (23, usual[0], "ja"), (24, "漢" * 240, "ja")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    rules = quality_rules.Rules()
    for d, t, lang in rows:
        refs = [sum(f(x) for _, x, k in rows if k == lang) for f in (classes_of, words_in)]
        near = distance(classes_of(t), refs[0]) if len(t) >= 200 else None, distance(words_in(t), refs[1]) if words_in(t).sum() >= 200 else None
        r = got[d]
        for x, y in zip(near, (r.char_distance, r.word_distance), strict=True):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-3)
        assert r.kept == (not r.base_failed and (near[0] or 0) <= rules.max_char_distance and (near[1] or 0) <= rules.max_word_distance)
    assert got[0].kept and not got[20].base_failed and not got[20].kept and not got[21].base_failed and not got[21].kept


def test_quality_rules(spark):
    got = quality_rules.judge(H.odd(spark)).collect()
    want = Counter()
    for d, t in texts():
        w = re.findall(SPACES, t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(SPACES, x)]
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality_rules.judge(H.none(spark)).count() == 0


def test_distance(spark):
    from pyspark.sql import functions as F

    p, q = [3.0, 1.0, 0.0], [1.0, 1.0, 2.0]
    got = spark.range(1).select(quality_rules.js_distance(F.lit(p), F.lit(q)).alias("d"), quality_rules.js_distance(F.lit(p), F.lit([0.0] * 3)).alias("e")).first()
    a, b = np.array(p) / 4, np.array(q) / 4
    m = (a + b) / 2
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m, strict=True) if v)
    assert np.isclose(got.d, np.sqrt((kl(a) + kl(b)) / 2)) and got.e is None


def test_mix(spark):
    rows = H.odd_rows() + [(100 + n, H.prose(n, 200), "en", f"s{n % 5}", 0, 0.5, "x") for n in range(200)]
    docs = spark.createDataFrame(rows, H.SCHEMA)
    got = mixing.mixed(docs).collect()
    size = lambda t: len(re.findall(SPACES, t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[n % 3] for n, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= share
    by_id = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = by_id[r.doc_id]
        assert np.isclose(r.target, target[s]) and r.source_size == sizes[s]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 16 for s in names)
    assert Counter(map(tuple, mixing.mixed(docs).collect())) == Counter(map(tuple, got))
    assert mixing.mixed(H.none(spark)).count() == 0


def test_mix_of_small_sources(spark):
    """Sources of a few words beside large ones come as near their targets as whole words can; ids repeat."""
    rows = [(n, f"s{n}", H.prose(n, n)) for n in range(5, 40)] + [(100 + n, "large", H.prose(n, 3000)) for n in range(10)] + [(5, "large", H.prose(1, 7)), (200, "empty", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(docs).join(docs.select("doc_id", "source").withColumnRenamed("doc_id", "d"), None, "cross").filter("doc_id = d").select("doc_id", "source", "size", "source_size", "target", "taken").distinct().collect()
    by = {r.doc_id: r for r in got if r.doc_id not in (5,) and r.source != "large"}
    assert all(abs(r.taken - r.target) <= 1 for r in by.values() if r.size) and len(by) == 35
    assert abs(sum(r.taken for r in got if r.doc_id >= 100) - next(r.target for r in got if r.doc_id == 100)) <= 16 + 21


def test_mix_ignores_clashing_names(spark):
    rows = [(n, "ab"[n % 2], H.prose(n, 50), 1, 2, 3) for n in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _times int, _nth int, _taken int")
    assert {tuple(r)[3:] for r in mixing.repeated(docs).collect()} == {(1, 2, 3)}
    names = docs.withColumnsRenamed({"_times": "_node", "_nth": "_kept", "_taken": "_best"})
    assert {tuple(r)[3:] for r in near_dedup.one_of_each(names).collect()} == {(1, 2, 3)}


def test_step_shares_no_factor():
    assert all(len({t * mixing.step(n) % n for t in range(n)}) == n for n in range(1, 200))


def test_mix_returns_documents(spark):
    docs = H.odd(spark)
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    assert set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
