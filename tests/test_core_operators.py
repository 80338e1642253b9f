"""Operators on small inputs of our own, each with a case that must and one that must not match."""


import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import edges, extract, feedback, graph, rules, scoring, similarity, treesearch
from lodestrata.sources import files


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_paths(spark):
    df = table(spark, "p string", ("a/b/__init__.py",), ("a/b.py",), ("x/y.md",), ("z",))
    got = df.select(T.module_name(F.col("p")), T.file_class(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("a.b", "tree"), ("a.b", "tree"), ("x.y", "weed"), ("z", "other")]


@pytest.mark.parametrize(
    ("pattern", "path", "fits"),
    [("*.log", "a/b.log", True), ("*.log", "a/b.logs", False), ("build", "x/build/y", True), ("a/*/c", "a/b/c", True), ("a/*/c", "a/b/d/c", False), ("a/**/c", "a/b/d/c", True), ("a/**/c", "a/c", True), ("#x", "#x", False)],
)
def test_ignore_patterns(spark, pattern, path, fits):
    assert table(spark, "p string", (path,)).select(T.ignored(F.col("p"), [pattern])).first()[0] is fits


def test_identifiers(spark):
    df = table(spark, "s string", ("getHttpName",), ("kebab-case_x",), ("XMLParser",), ("UserAuth",), (None,), ("",))
    assert [r[0] for r in df.select(T.identifier_tokens(F.col("s"))).collect()] == [["get", "http", "name"], ["kebab", "case", "x"], ["xml", "parser"], ["user", "auth"], None, []]


def test_line_number(spark):
    assert table(spark, "s string", ("a\nb\nc",)).select(T.line_number(F.col("s"), F.lit(4))).first()[0] == 3


def test_scan(spark, tmp_path):
    for p, t in {"src/a.py": "import os\n", "node_modules/x.js": "1", ".git/c": "1", "tests/test_a.py": "1", "r.md": "# hi", "skip/b.py": "", "vendor/v.c": "int x;", "own/o.c": "1"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "i.png").write_bytes(bytes(range(256)))
    (tmp_path / "bad.py").write_bytes(b"x = 'a\xff\xfeb'\n")
    got = files.scan(spark, str(tmp_path), ["skip"], True, ["own"]).collect()
    assert {r.path: r["class"] for r in got} == {"src/a.py": "tree", "r.md": "weed", "vendor/v.c": "tree", "i.png": "weed", "bad.py": "tree"}
    text = {r.path: r.text for r in got}
    assert text["i.png"] is None and text["bad.py"] == "x = 'ab'\n"


def test_edges_are_unique_and_changes_equal_a_rebuild(spark):
    e = edges.normalized(table(spark, "source string, target string", ("a", "b"), ("a", "b"), ("b", "c"), ("d", "a")))
    assert e.count() == 3
    ch = table(spark, "file string, change string, was string", ("a", "modified", None), ("c", "deleted", None), ("e", "renamed", "d"))
    out = edges.apply_changes(e, ch, table(spark, "source string, target string", ("a", "z")))
    assert {(r.source, r.target) for r in out.collect()} == {("a", "z"), ("e", "a")}
    assert out.where(out["id"] != T.stable_id("g_", *edges.KEY)).count() == 0


def test_changes(spark):
    a = table(spark, "file string, fingerprint string", ("same", "1"), ("old", "2"), ("gone", "3"), ("mod", "4"))
    b = table(spark, "file string, fingerprint string", ("same", "1"), ("new", "2"), ("fresh", "9"), ("mod", "5"))
    assert {tuple(r) for r in edges.changes(a, b).collect()} == {("new", "renamed", "old"), ("gone", "deleted", None), ("fresh", "added", None), ("mod", "modified", None)}


def test_all_deleted_names_go_to_the_last_added_one(spark):
    a = table(spark, "file string, fingerprint string", ("a", "1"), ("b", "1"), ("x", ""), ("y", None))
    b = table(spark, "file string, fingerprint string", ("c", "1"), ("d", "1"), ("z", ""))
    assert {tuple(r) for r in edges.changes(a, b).collect()} == {("d", "renamed", "a"), ("d", "renamed", "b"), ("c", "added", None), ("z", "added", None), ("x", "deleted", None), ("y", "deleted", None)}
    e = edges.normalized(table(spark, "source string, target string", ("a", "q"), ("q", "b"), ("q", "r")))
    out = edges.apply_changes(e, edges.changes(a, b), e.limit(0)).select("source", "target").collect()
    assert {tuple(r) for r in out} == {("d", "q"), ("q", "d"), ("q", "r")} and len(out) == 3


def test_calls_resolve_by_whole_name_or_leaf(spark):
    calls = table(spark, "file string, name string", ("a.py", "m.run"), ("a.py", "x.help"), ("a.py", "own"))
    defs = table(spark, "file string, name string", ("b.py", "m.run"), ("c.py", "run"), ("c.py", "help"), ("a.py", "own"))
    assert {(r.symbol, r.target) for r in edges.resolve_calls(calls, defs).collect()} == {("m.run", "b.py"), ("x.help", "c.py")}


def test_liveness_and_unreferenced(spark):
    e = edges.normalized(table(spark, "source string, target string, verified boolean", ("a", "b", True), ("a", "x", True), ("b", "a", False)))
    got = {(r.source, r.target): r.state for r in edges.liveness(e, table(spark, "file string", ("a",), ("b",))).collect()}
    assert got == {("a", "b"): "alive", ("a", "x"): "dead", ("b", "a"): "stale"}
    d = table(spark, "name string", ("f",), ("g",))
    assert [r.name for r in edges.unreferenced(d, table(spark, "name string", ("f",))).collect()] == ["g"]


def test_graph(spark):
    e = table(spark, "source string, target string", ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "a"))
    assert [tuple(r) for r in graph.cycles(e, 4).collect()] == [(2, "a>b")]
    node = lambda n: table(spark, "node string", (n,))
    assert {tuple(r) for r in graph.impact(e, node("d"), 2).collect()} == {("c", 1), ("b", 2)}
    assert {r.node for r in graph.reachable(e, node("b")).collect()} == {"a", "b", "c", "d"}
    got = graph.propagate(e, table(spark, "node string, rank int", ("x", 3), ("b", 1)), 2)
    assert {tuple(r) for r in got.collect()} == {("x", 3), ("a", 3), ("b", 3), ("c", 1), ("d", 1)}


def test_dead_ends_and_pruned_nodes_take_no_place(spark):
    n = table(spark, "id int, parent int, status string, pruned boolean, depth int, seq int, total double", (1, None, "expanded", False, 0, 0, None), (2, 1, "scored", True, 1, 1, 0.9), (3, 1, "scored", False, 1, 2, 0.8), (4, 1, "scored", False, 1, 3, 0.7), (5, 1, "dead_end", False, 1, 4, 0.1), (6, 5, "scored", False, 2, 5, 0.9))
    assert {r.id for r in treesearch.beam(n, 1).where("cut").collect()} == {4, 5}
    # an open node is dead once it is left: its own parent is no place to go on from for its sake
    m = table(spark, "id int, parent int, status string, pruned boolean", (1, None, "expanded", False), (2, 1, "expanded", False), (3, 1, "open", False), (4, 2, "open", False))
    assert graph.backtrack(m, table(spark, "id int", (4,))).first().id == 1
    assert {r.id for r in treesearch.dead(m, table(spark, "id int", (2,))).where("status = 'dead_end'").collect()} == {2, 4}


def test_search_state(spark, tmp_path):
    path = str(tmp_path / "state")
    fresh = treesearch.load_state(spark, path)
    assert [(r.id, r.status) for r in fresh.collect()] == [(0, "open")]
    kids = table(spark, treesearch.STATE, (0, None, 0, 0, "expanded", False, None, "root"), (1, 0, 1, 1, "scored", False, 0.5, "one\n two"), (2, 0, 1, 2, "open", True, None, None), (3, 1, 2, 3, "open", False, None, "deep"))
    for _ in range(2):
        treesearch.save_state(kids, path)
    back = treesearch.load_state(spark, path)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in kids.collect()}
    assert treesearch.render(back).first().text == "+ root\n  * one two [0.5]\n    o deep\n  - "
    (tmp_path / "broken").write_text("{not json")
    assert treesearch.load_state(spark, str(tmp_path / "broken")).count() == 1


def test_mixed_similarity(spark):
    rows = [("a cat sat", "a cat sat"), ("a cat sat", "THE  cat  sat"), ("", "x"), (None, "x"), ("abab", "ab")]
    got = [r[0] for r in table(spark, "a string, b string", *rows).select(treesearch.mixed_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and 0.4 < got[1] < 1 and got[2] == 0 and got[3] in (None, 0) and got[4] == pytest.approx((1 / 3**0.5))


def test_trees(spark):
    n = table(spark, "id int, parent int, status string, pruned boolean, depth int, seq int, total double", (1, None, "expanded", False, 0, 0, None), (2, 1, "open", False, 1, 1, 0.2), (3, 1, "scored", False, 1, 2, 0.9), (4, 3, "dead_end", False, 2, 3, None))
    assert graph.backtrack(n, table(spark, "id int", (4,))).first().id == 1
    assert [treesearch.select(n, s).first().id for s in ("bfs", "dfs", "beam")] == [2, 2, 3]
    assert {r.id for r in treesearch.prune(n, 1).where("pruned").collect()} == {2}
    score = table(spark, "evidence double, relevance double, novelty double, verifiable double", (0.9, 0.9, 0.4, 0.8)).select(F.struct("*").alias("s"))
    assert score.select(treesearch.total_score(F.col("s"))).first()[0] == 0.79


def test_scores(spark):
    found = table(spark, "type string, severity string", ("a", "critical"), ("b", "high"), ("c", "low"))
    r = rules.risk(found).first()
    assert (r.score, r.grade) == (24, "B")
    dims = table(spark, "run int, dim string, score double", *[(1, d, 90.0) for d in scoring.WEIGHTS], *[(2, d, 10.0) for d in scoring.WEIGHTS])
    got = scoring.trend(scoring.composite(dims, ["run"]), "run").orderBy("run").collect()
    assert [(r.score, r.grade, r.trend) for r in got] == [(90.0, "A", "new"), (10.0, "F", "down")]


def test_composite_sends_halves_to_the_even_tenth(spark):
    # the means are 61.650000000000006 and 63.949999999999996 as doubles
    dims = table(spark, "run int, dim string, score double", *[(i, d, x) for i, xs in enumerate([(74.0, 21.0, 95.0, 96.0, 31.0, 50.0), (71.0, 35.0, 95.0, 93.0, 31.0, 50.0)]) for d, x in zip(scoring.WEIGHTS, xs, strict=True)])
    assert [r.score for r in scoring.composite(dims, ["run"]).orderBy("run").collect()] == [61.6, 64.0]


def test_grade_trend_equals_its_sql_beyond_the_smallest_tables(spark):
    import pytest

    from lodestrata.plans import catalog

    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.sql("create view orders as select * from '/root/testdata/sf0.1/orders.parquet'")
    got = catalog.QUERIES["grade_trend"](spark, "/root/testdata/sf0.1")
    assert {tuple(r) for r in got.collect()} == set(db.sql(catalog.ORACLES["grade_trend"]).fetchall())


def test_similarity_is_exact(spark):
    import itertools
    import random

    rnd = random.Random(3)
    sets = {i: sorted(set(rnd.choices(range(25), k=rnd.randint(1, 14)))) for i in range(60)}
    df = table(spark, "k int, grams array<int>", *sets.items())
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if len({*sets[a]} & {*sets[b]}) >= 0.5 * len({*sets[a]} | {*sets[b]})}
    assert {(r.a, r.b) for r in similarity.similar_sets(df, "k", "grams", 0.5).collect()} == want and want


def test_breaker(spark):
    df = table(spark, "f string, i int, failed boolean", ("a", 1, True), ("a", 2, True), ("b", 1, True), ("b", 2, False), ("b", 3, True), ("c", 1, True), ("c", 2, False))
    assert {(r.f, r.i) for r in feedback.breaker(df, "f", "i").where("tripped").collect()} == {("a", 2), ("b", 3)}


def test_extraction():
    py = set(extract.python_facts("from a import b\nclass C(D):\n  def f(self, x=[]):\n    if x and y:\n      z.g(1)\n"))
    assert {("import", "a.b", "", 1, 0), ("base", "D", "C", 2, 0), ("call", "z.g", "", 5, 1), ("complexity", "f", "C", 3, 3), ("mutable-default", "f", "", 3, 0)} <= py
    assert [f[0] for f in extract.python_facts("def (")] == ["syntax-error"]
    js = {f[:2] for f in extract.facts_of("x.js", "import x from 'm'; // no(1)\nfunction run(a) { return b(a, 'not()'); }")}
    assert {("import", "m"), ("function", "run"), ("call", "b")} <= js and ("call", "no") not in js and ("call", "run") not in js and ("call", "not") not in js


def test_profile_and_coverage(spark):
    spans = table(spark, "id int, parent int, func string, seconds double", (1, None, "f", 5.0), (2, 1, "g", 2.0), (3, 1, "g", 1.0))
    got = {r.func: (r.calls, r.total, r.self) for r in scoring.profile(spans).collect()}
    assert got == {"f": (1, 5.0, 2.0), "g": (2, 3.0, 3.0)}
    line = lambda *n: table(spark, "file string, line int", *[("f", i) for i in n])
    assert scoring.coverage(line(1, 2, 3, 4), line(2, 2, 3)).first().ratio == 0.5


def test_repeated_blocks(spark):
    rows = [("f", i + 1, c) for i, c in enumerate(["a", "b", "x", " a", "b ", "y"])]
    got = similarity.repeated_blocks(table(spark, "file string, line int, code string", *rows), "file", 2).collect()
    assert [(r.first, r.again) for r in got] == [(1, 4)]


def test_near_duplicates_compares_whole_texts(spark, tmp_path):
    import random
    import string

    from lodestrata.plans import catalog

    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choices(string.ascii_lowercase, k=n))
    lead, tail = text(320), text(4000)
    rows = [(1, lead + text(4000)), (2, lead + text(4000)), (3, text(100) + tail), (4, text(100) + tail)]
    table(spark, "doc_id long, text string", *rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.a, r.b) for r in catalog.QUERIES["near_duplicates"](spark, str(tmp_path)).collect()] == [(3, 4)]


def test_similar_texts_are_those_of_whole_sets(spark, monkeypatch):
    import itertools
    import random

    from lodestrata.functions import text as T
    from lodestrata.operators import alike

    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdefgh é7中-", k=rnd.randint(2, 9))) for _ in range(60)]
    texts = [" ".join(rnd.choices(words[: rnd.choice((8, 20, 60))], k=rnd.choice((1, 5, 30, 90)))) for _ in range(120)]
    texts += [x[: rnd.randint(1, 9)].upper() + x[5:] for x in texts[:60]] + [texts[7]] * 25 + ["", "ab", "---", None]
    df = table(spark, "id long, text string", *enumerate(texts), (None, texts[7]))
    sets = {r.id: set(r.g) for r in df.where("id is not null").select("id", T.gram_hashes(F.col("text"), None).alias("g")).collect() if r.g}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    want = {(*p, x) for p, x in share.items() if x >= 0.8}
    assert {tuple(r) for r in alike.similar_texts(df, "id", "text").collect()} == want and len(want) > 400
    # many blocks, sizes dealt to parts, chunks and tiles, grams without a bit of their own
    for name, value in {"SMALL": 20, "MANY": 99, "CHUNK": 8, "TILE": 5, "SPAN": 3, "WIDE": 70}.items():
        monkeypatch.setattr(alike, name, value)
    assert {(i, j) for i, j in pairs_of(alike, sets)} == {p[:2] for p in want}
    monkeypatch.setattr(alike, "CHUNK", 64)
    got = alike.similar_texts(df.repartition(3), "id", "text").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert alike.similar_texts(df.where("false"), "id", "text").count() == 0


def pairs_of(alike, sets):
    """The pairs that a task finds among sets, by key."""
    import numpy as np
    import pyarrow as pa

    ids = sorted(((k, np.array(sorted(int(x, 16) for x in s))) for k, s in sets.items()), key=lambda r: len(r[1]))
    side = alike._Side(pa.table({"k": [k for k, _ in ids], "n": [len(s) for _, s in ids], "g": pa.array([alike._packed(s) for _, s in ids], pa.binary())}))
    return [tuple(sorted((int(side.keys[i]), int(side.keys[x])))) for i, j, _ in alike._pairs(side, side, 0.8) for x in j]


def test_similar_texts_of_many_pairs_make_few_rows(spark, tmp_path):
    """Candidates of a small alphabet: the prefix filter joined every pair of them by many grams."""
    import random

    from lodestrata.plans import catalog

    rnd = random.Random(2)
    table(spark, "doc_id long, text string", *[(i, "".join(rnd.choices("abcdefghijkl", k=900))) for i in range(300)]).write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog.QUERIES["near_duplicates"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and df.count() == 0


def test_weak_signals_is_one_leader_scan_over_all(spark, tmp_path):
    import collections
    import random

    from lodestrata.plans import catalog

    rnd = random.Random(9)
    words = ["alpha", "bravo", "kilo", "zulu", "echo", "oxen", "fjord", "quiz", "myth", "jump"]
    rows = [(c, t, " ".join(rnd.choices(words, k=2))) for c in range(90) for t in range(2)]
    table(spark, "conv_id long, turn long, text string", *rows).write.parquet(str(tmp_path / "conversations.parquet"))
    grams = lambda s, n: [s[i : i + n] for i in range(len(s) - n + 1)]

    def alike(a, b):
        x, y, p, q = {*grams(a, 3)}, {*grams(b, 3)}, collections.Counter(grams(a, 2)), collections.Counter(grams(b, 2))
        return max(len(x & y) / len(x | y), sum((p & q).values()) / (sum(p.values()) * sum(q.values())) ** 0.5) > 0.4

    want = set()
    for depth in range(2):
        leaders, found = [], []
        for c, t, text in rows:
            if t == depth:
                k = next((i for i, x in enumerate(leaders) if alike(x, text)), len(leaders))
                leaders += [text] if k == len(leaders) else []
                found.append((c * 1000 + t, k))
        n = collections.Counter(k for _, k in found)
        want |= {(depth, i, k, n[k] / len(found) <= 0.3) for i, k in found}
    got = {(r.depth, r.id, r.cluster, r.weak) for r in catalog.QUERIES["weak_signals"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 180
    t = spark.read.parquet(str(tmp_path / "conversations.parquet")).selectExpr("turn depth", "conv_id * 1000 + turn id", "conv_id seq", "text")
    assert {tuple(r) for r in treesearch.signals(t, head=3).collect()} == want  # many rounds


def test_components_hold_cycles_of_any_length(spark):
    import random

    rnd = random.Random(4)
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    e = {*ring, *((f"n{rnd.randrange(24)}", f"n{rnd.randrange(24)}") for _ in range(30)), ("r3", "n1"), ("a", "b"), ("b", "c"), ("z", "z")}
    nodes = sorted({x for p in e for x in p})
    reach = {x: {t for s, t in e if s == x} for x in nodes}
    for k in nodes:
        for x in nodes:
            if k in reach[x]:
                reach[x] |= reach[k]
    want = {(x, min(m), len(m)) for x in nodes if len(m := {x, *(y for y in reach[x] if x in reach[y])}) > 1}
    assert {tuple(r) for r in graph.components(table(spark, "source string, target string", *sorted(e))).collect()} == want
    assert ("r5", "r0", 7) in want


def test_ratio_pairs_at_every_size(spark):
    import itertools

    sizes = {i: n for i, n in enumerate([0, 0, 1, 1, 2, 10, 13, 14, 100, 130, 131, 1000, 1200, 1300, 1301, 10**6, 13 * 10**5])}
    want = {(a, b) for a, b in itertools.combinations(sizes, 2) if max(sizes[a], sizes[b]) <= 1.3 * min(sizes[a], sizes[b])}
    got = similarity.band_pairs(table(spark, "k int, n int", *sizes.items()), "k", "n").collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and (11, 12) in want


def test_parts_and_seeds_of_all_rows(spark, tmp_path):
    from lodestrata.plans import catalog

    put = lambda name, schema, *rows: table(spark, schema, *rows).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("part", "p_partkey int, p_name string, p_brand string, p_size int", (1, "red bolt", "x", 7), (2, "red nut", "x", 9), (3, "Red Bolt", "x", 2), (4, "red bolt", "y", 1))
    got = {(r.a, r.b): r.similarity for r in catalog.QUERIES["ochiai_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(1, 3): 1.0}  # (1, 2) is 0.37 alike, below the least of 0.4
    put("customer", "c_custkey int, c_nationkey int", (1, 1))
    put("orders", "o_orderkey int, o_custkey int, o_orderstatus string", (5, 1, "F"))
    put("nation", "n_nationkey int, n_regionkey int", (1, 1))
    got = {tuple(r) for r in catalog.QUERIES["taint_reach"](spark, str(tmp_path)).collect()}
    assert got == {("o5", 3), ("c1", 3), ("n1", 3), ("r1", 3)}
