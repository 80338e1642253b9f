"""The corpus pipeline against a brute-force version of its stages."""

import pytest

pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_operators import brute_components, brute_fingerprint, brute_quality  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    clean = []
    for i, t in rows:
        n, chars, symbols, lines, dup, repeat = brute_quality(t)
        if not (n < 50 or 100 * repeat > 50 * n or 10 * symbols > chars or lines >= 4 and 2 * dup > lines or chars < 2 * n or chars > 20 * n):
            clean.append((i, t))
    keep = {}
    for i, t in clean:
        keep[t] = max(i, keep.get(t, i))
    left = [(i, t, brute_fingerprint(t)) for t, i in keep.items()]
    root, first = brute_components([f for _, _, f in left]), {}
    for i, _, f in left:
        first[root[f]] = min(i, first.get(root[f], i))
    want = {i: t for i, t, _ in left if first.get(root[_]) == i}
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, SF).collect()
    tokens = {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
        assert r.doc_tokens >= r.start + r.length
    assert tokens == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
