"""Core operators on nulls, ties, repeated rows, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import edges as E
from lodestrata.operators import feedback, graph, scoring, similarity, treesearch
from lodestrata.sources import files


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


@pytest.fixture(scope="module")
def links(spark):
    # columns named like results and like what operators call things inside
    rows = [("a", "b", "x", 1), ("a", "b", "x", 2), ("b", "c", None, 3), (None, "c", "y", 4), ("c", None, "y", 5), ("c", "a", "", 6), ("d", "d", "z", 7)]
    return table(spark, "source string, target string, symbol string, node int", *rows)


def pairs(df, *columns):
    return sorted(tuple("" if v is None else v for v in r) for r in df.select(*columns).collect())


def test_edges(spark, links):
    e = E.normalized(links)
    assert pairs(e, "source", "target", "symbol") == [("", "c", "y"), ("a", "b", "x"), ("b", "c", ""), ("c", "", "y"), ("c", "a", ""), ("d", "d", "z")]
    assert E.normalized(links.where("false")).count() == 0 and E.stats(e.where("false")).first().asDict() == {"total": 0, "strong": 0, "weak": 0, "deep": 0}
    assert [r.node for r in E.hubs(e, 3).collect()] == ["c", "", "a"]
    assert E.insert_absent(e, e).count() == e.count() and E.neighbourhood(e, None).count() == 0
    assert E.resolve_calls(table(spark, "file string, name string, key int", (None, "f", 1), ("a", None, 1), ("a", "f", 1), ("a", "f", 2)), table(spark, "file string, name string, leaf int", ("b", "f", 1), ("b", "f", 2), (None, "f", 3))).collect() == [("a", "f", "b", "call")]
    assert E.unreferenced(table(spark, "name string, name2 int", (None, 1), ("f", 2)), table(spark, "name string", (None,))).count() == 2
    none = e.where("false")
    f = files.scan.__doc__ and table(spark, "path string, text string", ("a", "x")).where("false")
    assert E.core(none, f).count() == E.call_graph(none, f)[1].count() == E.to_files(none, f).count() == 0
    assert E.mermaid(*E.call_graph(none, f)).first().text == "flowchart LR"


def test_graphs(spark, links):
    node = lambda *n: table(spark, "node string, depth int", *[(x, 9) for x in n])
    assert pairs(graph.impact(links, node("c", "c", None), 5), "node", "depth") == [("a", 2), ("b", 1)]
    assert pairs(graph.reachable(links, node("a", None)), "node") == [("a",), ("b",), ("c",)]
    assert pairs(graph.components(links), "node", "component", "size") == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3)]
    assert pairs(graph.cycles(links, 4), "length", "cycle") == [(3, "a>b>c")]
    assert pairs(graph.propagate(links, table(spark, "node string, rank int", ("a", 3), ("a", 1), (None, 2))), "node", "rank")[-3:] == [("a", 3), ("b", 3), ("c", 3)]
    none = links.where("false")
    assert graph.cycles(none).count() == graph.components(none).count() == graph.bridges(none, node("a")).count() == graph.impact(none, node("a")).count() == 0
    assert graph.reachable(none, node("a")).count() == 1 and graph.reachable(links, node().where("false")).count() == 0


def test_similarity(spark):
    sets = table(spark, "id int, grams array<string>, k int, a int", (1, ["x", "y", "y"], 7, 7), (2, ["y", "x"], 7, 7), (3, None, 7, 7), (4, [], 7, 7), (5, ["z"], 7, 7))
    assert similarity.similar_sets(sets, "id").collect() == [(1, 2, 1.0)] and similarity.similar_sets(sets.where("false"), "id").count() == 0
    grams = table(spark, "key int, gram string, grams int", (1, "a", 1), (1, "a", 1), (1, "b", 1), (2, "a", 1), (2, "b", 1), (3, None, 1))
    assert [(r.a, r.b, round(r.similarity, 4)) for r in similarity.ochiai_pairs(grams, "key", "gram").collect()] == [(1, 2, 0.8165)]
    sizes = table(spark, "k int, n int, band int", (1, 10, 0), (2, 12, 0), (3, None, 0), (4, -1, 0), (5, 0, 0), (6, 0, 0))
    assert pairs(similarity.band_pairs(sizes, "k", "n"), "a", "b") == [(1, 2), (5, 6)]
    names = table(spark, "k int, name string, score int", (1, "get_tree", 1), (2, "get_tree", 1), (3, None, 1), (4, "", 1), (1, "zzz", 1))
    assert [tuple(r) for r in similarity.search(names, "get_tree", "k", "name").collect()] == [(1, 1.0), (2, 1.0)] and similarity.search(names.where("false"), "x", "k", "name").count() == 0
    assert similarity.search(names, "", "k", "name").count() <= 2
    lines = table(spark, "file string, line int, code string, block int", ("f", 1, None, 1), ("f", 2, "a", 1), ("f", 3, " a", 1), ("f", 4, "a ", 1), ("f", 5, "a", 1))
    assert similarity.repeated_blocks(lines, "file", 2).count() >= 1 and similarity.repeated_blocks(lines.where("false"), "file").count() == 0


def test_similar_sets_of_every_measure_against_brute_force(spark):
    import itertools
    import random

    rnd = random.Random(8)
    sets = {i: sorted(set(rnd.choices(range(30), k=rnd.randint(1, 16)))) for i in range(70)}
    df = table(spark, "k int, g array<int>", *sets.items())
    for measure, of in (("jaccard", lambda x, y: len(x & y) / len(x | y)), ("ochiai", lambda x, y: len(x & y) / (len(x) * len(y)) ** 0.5)):
        for least in (0.3, 0.6, 0.9):
            want = {(a, b) for a, b in itertools.combinations(sets, 2) if of({*sets[a]}, {*sets[b]}) >= least}
            assert {(r.a, r.b) for r in similarity.similar_sets(df, "k", "g", least, measure).collect()} == want


def test_scores(spark):
    spans = table(spark, "id int, parent int, func string, seconds double, own int", (1, None, "f", 2.0, 0), (2, 1, None, None, 0), (3, 9, "g", 1.0, 0))
    assert pairs(scoring.profile(spans).where("func is not null"), "func", "calls", "self") == [("f", 1, 2.0), ("g", 1, 1.0)]
    assert scoring.profile(spans.where("false")).count() == scoring.hot_spots(spans.where("false")).count() == 0
    dims = table(spark, "run int, dim string, score double, before int", (1, "security", None, 0), (1, "debt", 50.0, 0), (1, "unknown", 99.0, 0))
    assert scoring.composite(dims, ["run"]).count() == 1 and scoring.composite(dims.where("false"), ["run"]).count() == 0
    line = table(spark, "file string, line int, hit int", ("f", 1, 0), ("f", 1, 0), ("f", 2, 0), ("g", None, 0))
    assert pairs(scoring.coverage(line, line.where("line = 1")).where("file = 'f'"), "lines", "covered", "ratio") == [(2, 1, 0.5)]
    assert scoring.clear_layers(table(spark, "path string", ("a",)).where("false")).first().asDict() == {"layers": 0, "clear": False}


def test_feedback(spark):
    rows = table(spark, "f string, i int, failed boolean, reason string, last int", (None, 1, True, "a", 0), (None, 2, True, None, 0), ("x", 1, None, "n", 0), ("x", 2, True, "b", 0), ("x", 3, None, "c", 0), ("x", 4, True, "d", 0))
    assert pairs(feedback.breaker(rows, "f", "i").where("tripped"), "f", "i") == [("", 2), ("x", 4)]
    assert {r.f: r.reasons for r in feedback.last_reasons(rows, "f", "i", 1).collect()} == {None: ["a"], "x": ["d"]}
    none = rows.where("false")
    assert feedback.breaker(none, "f", "i").count() == feedback.last_reasons(none, "f", "i").count() == feedback.confirmed(none, ["f"]).count() == feedback.converged(none, "i").count() == 0


def test_tree_search(spark):
    n = table(spark, "id long, parent long, depth long, seq long, status string, pruned boolean, total double, text string, cut int, cluster int", (1, None, 0, 1, "open", False, None, None, 0, 0), (2, None, 0, 2, "open", False, None, "", 0, 0), (3, None, 0, 2, "open", False, 0.5, "same text", 0, 0), (4, None, 0, 4, "scored", False, 0.5, "same text", 0, 0))
    assert [treesearch.select(n, s).first().id for s in ("bfs", "dfs", "beam")] == [1, 1, 3] and treesearch.select(n.where("false")).count() == 0
    got = {(r.id, r.cluster) for r in treesearch.signals(n.drop("cut", "cluster")).collect()}
    assert len(got) == 4 and len({c for _, c in got}) == 3
    none = n.where("false").drop("cut", "cluster")
    assert treesearch.signals(none).count() == treesearch.prune(none, 1).count() == treesearch.overlap(none, none).first().nodes == 0
    assert treesearch.overlap(n, n).first().asDict() == {"nodes": 4, "alike": 2, "overlap": 0.5}
    assert treesearch.converged(n, none).first().converged is None


def test_sources(spark):
    pages = table(spark, "page_id int, url string, html string, host string, script int", (1, None, None, "h", 1), (2, "http://a/b", '<a href="/x"><script> </script><SCRIPT>f()</SCRIPT>', "h", 1), (2, "http://a/b", "", "h", 1))
    assert pairs(files.inline_scripts(pages), "page_id", "code") == [(2, "f()")] and pairs(files.links(pages), "page_id", "host", "target") == [(2, "a", "a")]
    assert files.lines(pages.where("false"), "page_id", "html").count() == 0 and pairs(files.lines(pages, "page_id", "html"), "page_id", "line").count((2, 1)) == 2
    df = table(spark, "t string", (None,), ("",), ("ab",), ("Abc!",))
    got = df.select(T.ngrams(F.col("t")), T.gram_hashes(F.col("t")), T.gram_hashes(F.col("t"), None), T.extension(F.col("t"))).collect()
    assert got[0][0] is None and got[1][0] == [] and got[2][0] == [] and got[3][0] == ["abc", "bc!"] and got[3][1] == got[3][2] and got[1][3] == ""
