"""The corpus operators against brute force, on small tables with nulls, ties and odd texts."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from lodestrata.llm import bpe, dedup, html, licenses, lm, packing, quality, simhash, tokenfiles, unigram  # noqa: E402
from lodestrata.llm.tokens import library_encoder  # noqa: E402

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} the of{i}" for i in range(9000))
TEXTS = [
    None, "", " ", "one", "one two", "a  b\n\nc  d\x1ce", "the cat sat on the mat " * 30, LONG, LONG, LONG + " tail", "Ünïcode ß İ Σίσυφος ΣΑΣ 日本語 👩‍👧",
    " <|endoftext|> a<|endoftext|>b", "x" * 3000, "line one here\nline one here\nother\nline one here", "Licensed under the Apache License, Version 2.0.", "one two", "don't I'LL we'Re 12 3.5",
]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def rows():
    out = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one two"), (5, TEXTS[5]), (5, TEXTS[5])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    # extra columns with names that operators use for themselves
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], "doc_id long, text string, fp int, kept string, component_id double").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_empty_tables(empty, spark):
    for f in (quality.ledger, dedup.find_copies, dedup.drop_copies, simhash.near_duplicates, simhash.drop_near_duplicates, quality.keep_clean, lm.score_documents, licenses.scan_documents):
        assert f(empty).count() == 0
    assert packing.pack_documents(empty, BYTE).count() == 0
    assert bpe.round_trip(empty, BYTE).count() == 0
    assert tokenfiles.write_and_read(empty, WORD, 2).count() == 0
    assert unigram.count_tokens(empty, P.path("piece_bpe_32k.model")).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_quality(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, rows):
    got = quality.ledger(docs).collect()
    want = sorted(map(repr, ((i, *brute_quality(t)) for i, t in rows)))
    assert sorted(repr((r.doc_id, *[r[m] for m in quality.MEASURES])) for r in got) == want
    for r in got:
        assert (r.failures & 1 > 0) == (r.n_words < 50)
    kept = quality.keep_clean(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {7, 8, 9}
    table = {r.rule: r for r in quality.ablation(quality.ledger(docs)).collect()}
    assert table["few_words"].failed == sum(r.n_words < 50 for r in got)


def test_quality_sorts_whole_hashes_where_parts_collide(spark):
    df = spark.sql("select array((7L << 24) + 1, (7L << 24) + 2, (7L << 24) + 1, 5L) as __windows")
    assert quality._covered(quality._window_order(df)).first().n_repeat_words == 5


def test_counting_quotient_filter():
    rng = np.random.default_rng(1)
    for bits in (12, 40, 63):
        x = np.unique(np.r_[np.zeros(1, np.int64), rng.integers(0, 1 << bits, 700)]).astype(np.uint64)
        c = rng.choice([1, 1, 2, 3, 4, 5, 70, 1 << 12], len(x)).astype(np.int64)
        if bits == 12:
            c = np.minimum(c, 3)
        f = dedup.CountingQuotientFilter.of(x, c, bits)
        for g in (f, dedup.CountingQuotientFilter.from_bytes(f.to_bytes())):
            a, b = g.items()
            assert (a == x).all() and (b == c).all()
        half = len(x) // 3
        y = dedup.CountingQuotientFilter.merged([dedup.CountingQuotientFilter.of(x[: 2 * half], c[: 2 * half], bits), dedup.CountingQuotientFilter.of(x[half:], c[half:], bits)])
        a, b = y.items()
        both = c.copy()
        both[half : 2 * half] *= 2
        assert (a == x).all() and (b == both).all()


def test_exact_dedup(docs, rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for r in dedup.find_copies(docs).collect():
        g = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        keep = max((i for i in g if i is not None), default=None)
        assert (r.group_size, r.keep_id, r.kept) == (len(g), keep, r.doc_id == keep)
    left = dedup.drop_copies(docs)
    assert left.columns == docs.columns
    got = collections.Counter(r.text or "" for r in left.collect())
    assert got == dict.fromkeys(groups, 1)


def test_large_class_tables_join_by_parts(docs, monkeypatch):
    want = sorted(map(repr, dedup.find_copies(docs).collect()))
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, dedup.find_copies(docs).collect())) == want


def brute_fingerprint(text):
    w = WORDS.findall(lower_az(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def check_components(df, rows):
    fp = [(i, brute_fingerprint(t)) for i, t in rows]
    root = brute_components([f for _, f in fp])
    least = {}
    for i, f in fp:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    got = df.select("doc_id", simhash.hex_fingerprint("fp").alias("h"), "component_id").collect()
    assert sorted(map(repr, ((r.doc_id, r.h, r.component_id) for r in got))) == sorted(map(repr, ((i, f"{f:016x}", least.get(root[f])) for i, f in fp)))


def test_simhash(docs, rows, corpus):
    check_components(simhash.near_duplicates(docs), rows)
    some = [(r.doc_id, r.text) for r in corpus.collect()]
    check_components(simhash.near_duplicates(corpus), some)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_near_duplicates_leave_what_is_different(spark, few, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", few)
    a, b, c = "alpha beta gamma delta", "totally other words here now", "a third text with its own words"
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "y"), (None, a, "x"), (None, c, "z"), (7, c, "z"), (7, c, "z"), (None, None, "n"), (None, "", "n"), (9, "only once", "o")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key string, fp int")
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(repr((r.doc_id, r.text or "", r.key)) for r in got.collect()) == sorted(map(repr, [(3, a, "x"), (5, b, "y"), (7, c, "z"), (None, "", "n"), (9, "only once", "o")]))


@pytest.mark.parametrize("m", [4, 3, 2])
def test_links_are_complete(spark, m, monkeypatch):
    rng = np.random.default_rng(m)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base[:20].tolist():
        for _ in range(25):  # chains and dense groups
            x = b
            for k in rng.integers(0, 63, rng.integers(1, 4)).tolist():
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "groups_for", lambda n: m)
    monkeypatch.setattr(simhash, "BLOCK", 5)
    got = {(r.a, r.b) for r in simhash.links(spark, spark.createDataFrame([(f,) for f in fps], "fp long"), len(fps)).collect()}
    a = np.array(fps)
    want = {(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3).tolist() if fps[i] < fps[j]}
    assert got == want and len(want) > 500


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90}


def test_library_ids(corpus):
    texts = [*TEXTS[1:], "a\x00b c", "\x00", "İstanbul ſ ǅ x", "é ́x", "μ ª º ² ½ x²", "a\x1cb \x85c\xa0d", "a,\n,b ... \t«é» “x” – 1'2 '2s"]
    texts += [r.text or "" for r in corpus.select("text").collect()]
    random = np.random.default_rng(7)
    parts = ["'", "'s", "'re", "ll", "s", "t", " ", "  ", "\n", ",", "..", "3", "12", "ü", "É", "’", "–", "x" * 70, "日", "the", "Wh", "\x00", "|", "<|endoftext|>"]
    texts += ["".join(random.choice(parts, 40)) for _ in range(400)]
    for path in (BYTE, WORD):
        lib = Tokenizer.from_file(path)
        enc = library_encoder(path)
        for _ in range(2):
            for t, got in zip(texts, enc.encode_many(texts), strict=True):
                assert np.frombuffer(got, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, (path, t[:40])
            enc.release()


def test_cache_is_bounded_by_memory():
    from lodestrata.llm.common import TwoGenerationCache

    cache = TwoGenerationCache(lambda new: [k.encode() for k in new], 100_000)
    for i in range(100):
        keys = {f"{j}" * (j % 7 + 1) for j in range(i * 50, i * 50 + 300)}
        cache.fetch(keys)
        assert all(cache[k] == k.encode() for k in keys)
        assert len(cache) + len(cache.old) < 2000
    cache.release()
    assert not cache and not cache.old


def test_bpe(docs, rows):
    lib = Tokenizer.from_file(BYTE)
    model = bpe.load(BYTE)
    for word in (b"hello", b" the", b"aaaaaaaaaaaaaaa", b"x" * 64, "größe".encode()):
        assert np.frombuffer(model.merge_many([word, b"zz"], 64)[0], "<u4").tolist() == model.merge(word)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in bpe.round_trip(docs, BYTE).collect())
    back = bpe.decode_ids(bpe.encode_documents(docs, BYTE), BYTE)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t in rows)


def test_packing(docs, rows):
    lib = Tokenizer.from_file(BYTE)
    full = collections.Counter((i, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    got = packing.pack_documents(docs, BYTE).collect()
    seen = collections.Counter()
    for r in got:
        assert len(r.ids) == r.length <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert any(i == r.doc_id and len(x) == r.doc_tokens and list(x[r.start : r.start + r.length]) == r.ids for i, x in full)
        seen[r.doc_id] += r.length
    assert seen == {i: sum(len(x) * n for (j, x), n in full.items() if j == i) for i, _ in rows}
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) == math.ceil(sum(r.length for r in got) / 2048)


def test_padded_sequences(spark, docs):
    packed = packing.pack_documents(docs, BYTE)
    got = packing.sequences(packed, 3).collect()
    by = collections.defaultdict(list)
    for r in packed.collect():
        by[r.sequence_id].append((r.offset, list(r.ids)))
    assert {r.sequence_id for r in got} == by.keys()
    for r in got:
        ids = [x for _, part in sorted(by[r.sequence_id]) for x in part]
        power = len(ids) & (len(ids) - 1) == 0
        assert r.n_tokens == len(ids) and list(r.ids) == ids + ([] if power else [3] * (2048 - len(ids)))
    eight = spark.createDataFrame([(0, 4, [5, 6, 7, 8]), (0, 0, [1, 2, 3, 4]), (1, 0, [9, 9, 9])], "sequence_id long, offset long, ids array<int>")
    assert [(r.sequence_id, len(r.ids)) for r in packing.sequences(eight, 0).orderBy("sequence_id").collect()] == [(0, 8), (1, 2048)]


def test_closest_fill():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(200):
        items = rng.integers(1, 30, rng.integers(1, 9)).tolist()
        cap = int(rng.integers(1, 60))
        counts = collections.Counter(items)
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= cap)
        fill = packing.closest_fill(dict(counts), cap)
        assert sum(k * n for k, n in fill.items()) == best and all(n <= counts[k] for k, n in fill.items())


def by_count(own, of_count=lambda c: c):
    """doc -> log10 probability of its text by the model's formula over counted n-grams."""
    tokens = [(i, [*WORDS.findall(lower_az(t or "")), None]) for i, t in own]
    train = [ws for i, ws in tokens if not lm.held_out_doc(i)]
    c1 = collections.Counter(w for ws in train for w in ws)
    c2 = collections.Counter(p for ws in train for p in zip([None, *ws], ws))
    total = sum(c1.values()) + len(c1) + 1
    c1, c2 = ({k: of_count(c) for k, c in x.items()} for x in (c1, c2))

    def log_p(v, w):
        a, b = c1.get(v, 0), c1.get(w, 0)
        return math.log10((min(c2.get((v, w), 0), a, b) + lm.MU * (b + 1) / total) / (a + lm.MU))

    return [(i, len(ws), sum(log_p(v, w) for v, w in zip([None, *ws], ws))) for i, ws in tokens]


def test_language_model(docs, rows, corpus):
    for df, own in ((docs, rows), (corpus, [(r.doc_id, r.text) for r in corpus.collect()])):
        tokens = [(i, [*WORDS.findall(lower_az(t or "")), None]) for i, t in own]
        c = collections.Counter(w for i, ws in tokens if not lm.held_out_doc(i) for w in ws)
        n, v = sum(c.values()), len(c)
        want = collections.Counter((i, lm.held_out_doc(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in tokens)
        got = lm.score_documents(df).collect()
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_is_that_of_the_counts(docs, rows, corpus):
    """Beside false positives of the filter, scores are those of levels of brute-force counts;
    quantising moves them little."""
    own = [(r.doc_id, r.text) for r in corpus.collect()]
    got = {r.doc_id: r.score for r in lm.score_documents(corpus).collect()}
    level = by_count(own, lambda c: float(lm.COUNT_OF[lm.level_of(np.array([c]))[0]]))
    off = [abs(got[i] - s) / n for i, n, s in level]
    assert max(off) < 0.1 and sum(off) / len(off) < 0.01
    off = [abs(got[i] - s) / n for i, n, s in by_count(own)]
    assert sum(off) / len(off) < 0.03


def test_probabilities_of_a_word_sum_to_about_one(corpus):
    own = [(r.doc_id, r.text) for r in corpus.collect()]
    train = [[*WORDS.findall(lower_az(t or "")), None] for i, t in own if not lm.held_out_doc(i)]
    c1 = collections.Counter(w for ws in train for w in ws)
    c2 = collections.Counter(p for ws in train for p in zip([None, *ws], ws))
    total, q = sum(c1.values()) + len(c1) + 1, lambda c: float(lm.COUNT_OF[lm.level_of(np.array([c]))[0]])
    for v, _ in c1.most_common(20):
        p = sum((min(q(c), q(c1[v]), q(c1[w])) if c else 0) + lm.MU * (q(c1[w]) + 1) / total for w in c1 for c in [c2.get((v, w), 0)]) / (q(c1[v]) + lm.MU)
        assert 0.85 < p < 1.15


def test_filter_in_regions_scores_alike(docs, corpus, empty, monkeypatch):
    rows = lambda df: sorted(repr((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))) for r in lm.score_documents(df).collect())
    monkeypatch.setattr(lm, "REGION_BYTES", 20_000)
    want = rows(docs), rows(corpus)
    monkeypatch.setattr(lm, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 50_000)
    monkeypatch.setattr(lm, "TASK_TOKENS", 5000)
    assert (rows(docs), rows(corpus)) == want
    assert lm.score_documents(empty).count() == 0
    assert all(r.n_known == 0 for r in lm.score_documents(docs.where("doc_id is null or doc_id = 5")).collect() if r.held_out is False) is False


def test_hashes_are_of_words(monkeypatch):
    import pyarrow as pa

    texts = ["", " ", "A b", "b\x0ba\tä  Ä", "x" * 300 + " " + "X" * 300, "y" * 5000, "b a" * 2000, "c"]
    for size in (1 << 18, 1 << 10):
        monkeypatch.setattr(lm, "CHUNK_BYTES", size)
        arr = pa.array(["zz", *texts]).slice(1)
        h, ends = lm.hashes(arr)
        words = [w for t in texts for w in [*lower_az(t).encode().split(), None]]
        assert len(h) == len(words) and ends.tolist() == np.cumsum([1 + len(t.split()) for t in texts]).tolist()
        assert len({*zip(words, h.tolist(), strict=True)}) == len(set(words)) == len(set(h.tolist()))
        parts = [lm.hashes(pa.array([t]))[0] for t in texts]
        assert np.concatenate(parts).tolist() == h.tolist()
    h, ends = lm.hashes(pa.array([], pa.string()))
    assert len(h) == len(ends) == 0


def test_filter_grows_with_the_corpus():
    assert [lm.region_bits(n) for n in (0, 1 << 20, 1 << 30, 1 << 40, 1 << 50)] == [4, 4, 7, 17, 18]
    sizes = [len(lm.Region.build(np.arange(n, dtype=np.uint64), np.full(n, 2), np.zeros(0, np.uint32), np.zeros(0, np.int64)).bits) for n in (10**3, 10**5)]
    assert sizes[1] > 99 * sizes[0] and sizes[1] * 64 >= 2 * 10**5 * lm.BITS_PER_ENTRY


def test_filter_levels():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 1 << 62, 100_000).astype(np.uint64))
    low = np.unique(rng.integers(0, 1 << 32, 200_000).astype(np.uint32))
    count = lambda x: (1 + rng.pareto(0.7, len(x)) * 3).astype(np.int64)
    c, n = count(h), count(low)
    made = lm.Region.build(h, c, low, n)
    exact, got, got_pairs = made.answer(h, low)
    assert (exact == c).all()
    for levels, want in ((got, lm.level_of(c)), (got_pairs, lm.level_of(n))):
        assert (levels >= want).all() and (levels == want).mean() > 0.98
    absent, got, got_pairs = made.answer(lm.mix(h), np.setdiff1d(rng.integers(0, 1 << 32, 100_000).astype(np.uint32), low))
    assert not absent.any() and (got == 0).mean() > 0.98 and (got_pairs == 0).mean() > 0.98


def test_licenses(docs, spark):
    text = "foo bar.\nThis project is licensed UNDER the\n MIT-License. Also CC-BY-NC 4.0; Apache License, Version 2.0\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: under the mit license"
    cases = [text, "Redistribution and use in source and binary, forms without", "All rights reserved.", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International License", "apache license, version 2"]
    r = licenses.scan_documents(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].base_labels == "apache-2,cc-by-nc,mit" and r[0].labels == "apache-2,bsd,cc-by-nc,mit" and r[0].n_base == 4 and r[0].first_word == 6
    assert r[1].labels == "" and r[1].first_word is None and r[1].score == 0
    assert [x.labels for x in r[2:]] == ["all-rights-reserved", "cc-by", "cc-by-sa", "apache-2"]
    assert r[2].score == 0.5 and r[3].score == 0.9 and r[5].score == 0.6


def test_automata_against_regular_expressions():
    rng = np.random.default_rng(3)
    templates = [t for ts in licenses.TEMPLATES.values() for _, t in ts] + ["x <<beginOptional>>y <<beginOptional>>z<<endOptional>><<endOptional>> <<var;2>> end", "<<beginOptional>>a<<endOptional>> <<var;1>> b <<var;3>>"]
    for template in templates:
        a, find = licenses.Automaton(template), re.compile(licenses.pattern(template))
        kept = [m[0] for m in licenses.MARKUP.finditer(template) if not m[1] and licenses.words(m[0])]
        for _ in range(30):
            # the template's own words, now and then one more, one less or another
            words = [w.decode() for x in kept for w in licenses.words(x) if rng.random() > 0.05]
            for _ in range(rng.integers(0, 3)):
                words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(["x", "y", "end", "b", "version"])))
            words = ["lead", *words, "tail"]
            text = "".join(f"{w} " for w in words)
            for i in {0, 1, int(rng.integers(0, len(words)))}:
                at = sum(len(w) + 1 for w in words[:i])
                ends = [k for k in range(i, len(words) + 1) if find.fullmatch(text, at, sum(len(w) + 1 for w in words[:k]))]
                assert a.match([w.encode() for w in words], i) == max(ends, default=None), (template, text)


def test_whole_licences_need_their_wording():
    for label, ts in licenses.TEMPLATES.items():
        for kind, t in ts:
            if kind != "text":
                continue
            parts, depth = [], 0
            for m in licenses.MARKUP.finditer(t):
                depth += {"beginOptional": 1, "endOptional": -1}.get(m[1], 0)
                if not m[1] and not depth:
                    parts.append(m[0])
            scan = licenses.Scanner({label: [(kind, t)]}).scan
            assert scan("Copyright 2020 X\n" + ", ".join(parts).upper() + ".")[2:] == ({label: (3, 3 + len(parts))}, 1.0)
            for k in range(0, len(parts), 9):
                assert scan(" ".join([*parts[:k], "other", "words", *[str(x) for x in range(12)], *parts[k + 1 :]]))[2] == {}


def test_licence_base_columns(docs, rows):
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_documents(docs).collect())
    want = collections.Counter()
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(t or ""))
        found = [(k, label) for phrase, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        want[(i, len(w), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted({x for _, x in found})))] += 1
    assert got == want


def test_token_files(docs, rows):
    lib = Tokenizer.from_file(WORD)
    got = tokenfiles.digests(tokenfiles.write_and_read(docs, WORD, 2)).orderBy("start").collect()
    at = 0
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    for r in got:
        assert r.start == at
        at += r.n_tokens
        assert any(i == r.doc_id and r.ids_crc32 == zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows)
    assert len(got) == len(rows)


def test_token_files_are_pruned_by_document(spark):
    import glob

    import pyarrow.orc as orc

    docs = spark.range(0, 40000, 2).selectExpr("id as doc_id", "concat('word ', id) as text")
    path = tokenfiles.new_path(spark, "tokens-orc")
    tokenfiles.write_tokens(docs, path, WORD, 2, files=4)
    assert sum(orc.ORCFile(f).nrows for f in glob.glob(path.removeprefix("file:") + "/*.orc")) == 20000
    raw = spark.read.schema(tokenfiles.SCHEMA).orc(path)

    def rows_read(df):
        df = df.select("doc_id", "n_tokens")
        out = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return len(out), scan.metrics().apply("numOutputRows").value(), plan

    there, read, plan = rows_read(raw.where("doc_id = 20002"))
    assert there == 1 and read <= 2000 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,20002)]" in plan  # a row group of 10,000 at most
    absent, read, _ = rows_read(raw.where("doc_id = 20001"))  # within the bounds, so only the Bloom filters know
    assert absent == 0 and read == 0


def test_token_files_split_one_id(spark):
    docs = spark.createDataFrame([(7, f"w{i}") for i in range(400)] + [(None, "n")] * 50 + [(9, "z")], "doc_id long, text string").repartition(5)
    path = tokenfiles.new_path(spark, "tokens-orc")
    tokenfiles.write_tokens(docs, path, WORD, 2, files=6)
    got = tokenfiles.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 50 + [7] * 400 + [9]
    assert [r.start for r in got] == [sum(len(r.ids) for r in got[:k]) for k in range(len(got))]
    assert spark.read.schema(tokenfiles.SCHEMA).orc(path).select("_metadata.file_name").distinct().count() > 3


def test_token_counts(docs, rows):
    from tokenizers import models, pre_tokenizers

    lib = Tokenizer(models.Unigram(unigram.vocabulary(P.path("piece_bpe_32k.model")), 0, True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    got = unigram.count_tokens(docs, P.path("piece_bpe_32k.model")).collect()
    assert sorted(repr((r.doc_id, r.n_tokens)) for r in got) == sorted(repr((i, len(lib.encode(t or "", add_special_tokens=False).ids))) for i, t in rows)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site">Site name</header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First   para <a href=x>link</a>.<p>Second<br>para &eacute;</p><form><input>Search</form><div class="ad">Buy</div>
<section id="comments"><p>Nice post</p></section></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", "<p>just <b>some"), (4, "w", "a < b &am <!-- x"), (1, "u", PAGE)], "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in html.extract(pages).collect()]
    main = "Head & line\nFirst para link.\nSecond para é"
    assert got == [(1, main, len(main)), (2, "", 0), (3, "just some", 9), (4, "a < b &am", 9), (1, main, len(main))]


def test_html_without_article():
    long = "The cat is on the mat and it was in the house with all of them. " * 4
    links = "<div><a href=1>Some link of a menu</a> <a href=2>Another link here</a></div>" * 3
    page = f"<body>{links}<h2>A title</h2><p>{long}</p><p>Short one</p><p>{long}</p>{links}<p>tail</p></body>"
    assert html.main_text(page) == "\n".join(["A title", long.strip(), "Short one", long.strip()])


def random_tree(rng, depth):
    """A tree of elements that no rule of unclosed tags touches: (tag, attributes, children) or text."""
    words = "the of and in house mountain river table is was eu zx".split()
    if depth == 0 or rng.random() < 0.35:
        return " ".join(rng.choice(words, rng.integers(1, 40))) + " "
    tag = str(rng.choice(["div", "section", "article", "nav", "aside", "ul", "span", "b", "a", "h2", "header", "blockquote"]))
    attributes = str(rng.choice(["", "", "", ' class="ad"', ' id="main-text"', ' class="share-bar"']))
    return tag, attributes, [random_tree(rng, depth - 1) for _ in range(rng.integers(1, 5))]


def rendered(node):
    return node if isinstance(node, str) else f"<{node[0]}{node[1]}>{''.join(map(rendered, node[2]))}</{node[0]}>"


def tree_blocks(node):
    """(text, link characters, boilerplate, in article, heading) by recursion over the tree."""
    out, text, links = [], [], []

    def flush(path):
        t = " ".join("".join(text).split())
        if t:
            tags = [tag for tag, _ in path]
            bad = any(tag in html.BOILERPLATE_TAGS or a in (' class="ad"', ' class="share-bar"') for tag, a in path)
            article = "article" in tags
            heading = "h2" in tags
            out.append((t, len(" ".join(" ".join(links).split())), bad or "header" in tags and not (article and heading), article, heading))
        text.clear()
        links.clear()

    def walk(node, path, linked):
        if isinstance(node, str):
            text.append(node)
            if linked:
                links.append(node)
            return
        tag, a, children = node
        if tag in html.BLOCK_TAGS:
            flush(path)
        if tag == "article":  # no menu holds an article
            path = [x for x in path if x[0] != "nav"]
        for c in children:
            walk(c, [*path, (tag, a)], tag == "a" or linked)
        if tag in html.BLOCK_TAGS:
            flush([*path, (tag, a)])

    walk(node, [], False)
    flush([])
    return out


def no_nested_links(node, inside=False):
    if isinstance(node, str):
        return True
    return not (inside and node[0] == "a") and all(no_nested_links(c, inside or node[0] == "a") for c in node[2])


def has_article_in_nav(node, inside=False):
    if isinstance(node, str):
        return False
    return inside and node[0] == "article" or any(has_article_in_nav(c, inside or node[0] == "nav") for c in node[2])


def brute_main_text(blocks):
    """Both passes, block by block over all others."""
    has = any(article and not bad for _, _, bad, article, _ in blocks)
    place = ["article" if b[3] else "beside" if has else "page" for b in blocks]
    first = []
    for (t, links, bad, _, heading), w in zip(blocks, place):
        short, long, low, high = html.BOUNDS[w]
        stop = sum(x.strip(".,;:!?\"'()[]#*$%&|<>-").lower() in html.STOP_WORDS for x in t.split()) / len(t.split())
        if bad:
            first.append("markup")
        elif links / len(t) > html.LINKS_HIGH:
            first.append(None if w == "article" and len(t) < 70 and not heading else "boilerplate")
        elif len(t) < short:
            first.append(None)
        else:
            first.append("content" if stop >= high and len(t) >= long else None if stop >= low else "boilerplate")
    out = []
    for i, b in enumerate(blocks):
        label = first[i]
        if label is None:
            near = [(abs(i - j), j > i, j) for j in range(len(blocks)) if first[j] and place[j] == place[i] and not (first[j] == "markup" and place[j] == "article") and (j > i or not b[4])]
            label = first[min(near)[2]] if near else html.ALONE[place[i]]
        if label == "content":
            out.append(b[0])
    return "\n".join(out)


def test_html_against_brute_force():
    rng, rules = np.random.default_rng(11), collections.Counter()
    for _ in range(600):
        tree = ("div", "", [random_tree(rng, 4) for _ in range(rng.integers(1, 7))])
        if not no_nested_links(tree) or has_article_in_nav(tree):
            continue
        want = tree_blocks(tree)
        got = html.blocks_of(rendered(tree))
        assert [(b.text, b.link_chars, b.boilerplate, b.in_article, b.heading) for b in got] == want
        assert html.main_text(rendered(tree)) == brute_main_text(want)
        html.decide(got)
        html.settle(got)
        rules.update(b.rule for b in got)
    assert min(rules[r] for r in ("markup", "links", "density", "neighbour", "place")) > 20


def test_html_of_long_and_broken_pages(spark):
    import time

    pages = ["<b>" * 20000 + "<p>x</p>" * 2000, "<b>" * 20000 + "</i>" * 20000 + "<nav><article>" * 3000, "<a '" * 20000, "<" * 50000, "<!--" * 20000, "<script>" * 20000, "<table><tr><td>" * 20000]
    began = time.process_time()
    for p in pages:
        html.main_text(p)
    assert time.process_time() - began < 5
    df = spark.createDataFrame([(1, "u", "<p>a", "t", 5)], "page_id int, url string, html string, text string, n_chars int")
    assert html.extract(df).collect() == [(1, "u", "a", 1)] and html.extract(df.where("false")).count() == 0
