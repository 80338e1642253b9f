"""Registered queries: the library's operators over the test tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import edges as E
from ..operators import alike, dynamic, extract, feedback, graph, review, rules, scoring, similarity, treesearch
from ..sources import files, store
from ..streaming import feeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LINKS = r"""l AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
links AS (SELECT page_id, host, CASE WHEN regexp_extract(href, '^[a-z]+://([^/?#]+)', 1) = '' THEN host ELSE regexp_extract(href, '^[a-z]+://([^/?#]+)', 1) END AS target,
          href, regexp_extract(href, '^[a-z]+://([^/?#]+)', 1) = '' AS internal FROM l),
e AS (SELECT DISTINCT host AS source, target, href AS symbol, CASE WHEN internal THEN 'internal' ELSE 'external' END AS relation FROM links)"""


def link_table(spark, d) -> DataFrame:
    found = files.links(table(spark, d, "pages"))
    return E.normalized(found.select(F.col("host").alias("source"), "target", F.col("href").alias("symbol"), F.when(F.col("internal"), "internal").otherwise("external").alias("relation")))


@query(f"WITH {LINKS} SELECT source, target, symbol, relation, 'g_' || substr(sha1(concat_ws('|', source, target, symbol, relation)), 1, 12) AS id FROM e")
def link_edges(spark, d):
    return link_table(spark, d).select("source", "target", "symbol", "relation", "id")


@query(f"WITH {LINKS} SELECT relation, count(*) AS n FROM e GROUP BY relation")
def edges_by_relation(spark, d):
    return link_table(spark, d).groupBy("relation").agg(F.count("*").alias("n"))


@query(f"WITH {LINKS} SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT source AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e) GROUP BY node ORDER BY n_in DESC, n_out DESC, node LIMIT 10")
def hub_ranking(spark, d):
    return E.hubs(link_table(spark, d))


PARTS = "e AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem)"


def supply(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.lit("supplies").alias("relation")).distinct()


@query(f"WITH {PARTS} SELECT 'out' AS direction, target AS other, 'supplies' AS relation FROM e WHERE source = 's1' UNION ALL SELECT 'in', source, 'supplies' FROM e WHERE target = 's1'")
def neighbourhood(spark, d):
    return E.neighbourhood(supply(spark, d), "s1")


KEYS = """e AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
  UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def key_edges(spark, d) -> DataFrame:
    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target"))
    return edge(c, "c", "c_custkey", "n", "c_nationkey").unionAll(edge(o, "o", "o_orderkey", "c", "o_custkey")).unionAll(edge(n, "n", "n_nationkey", "r", "n_regionkey"))


@query(f"""WITH {KEYS}, a AS (SELECT source AS node, 1 AS depth FROM e WHERE target = 'r1'), b AS (SELECT e.source AS node, 2 AS depth FROM e JOIN a ON e.target = a.node),
  c AS (SELECT e.source AS node, 3 AS depth FROM e JOIN b ON e.target = b.node) SELECT node, min(depth) AS depth FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY node""")
def impact_depth3(spark, d):
    return graph.impact(key_edges(spark, d), spark.range(1).select(F.lit("r1").alias("node")), 3)


STEPS = "e AS (SELECT DISTINCT event_type AS source, n AS target FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n IS NOT NULL AND n <> event_type)"


def steps(spark, d) -> DataFrame:
    from pyspark.sql import Window

    ev = table(spark, d, "events").select("user_id", "event_id", "event_type")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return ev.select(F.col("event_type").alias("source"), after.alias("target")).where("target is not null and target != source").distinct()


@query(f"""WITH {STEPS}, two AS (SELECT a.source AS x, b.source AS y FROM e a JOIN e b ON a.target = b.source AND b.target = a.source WHERE a.source < b.source),
  three AS (SELECT a.source AS x, b.source AS y, c.source AS z FROM e a JOIN e b ON a.target = b.source JOIN e c ON b.target = c.source AND c.target = a.source WHERE a.source < b.source AND a.source < c.source AND b.source <> c.source)
  SELECT 2 AS length, x || '>' || y AS cycle FROM two UNION ALL SELECT 3, x || '>' || y || '>' || z FROM three""")
def cycles_bounded(spark, d):
    return graph.cycles(steps(spark, d), 3)


@query(f"""WITH RECURSIVE {STEPS}, r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON r.target = e.source),
  m AS (SELECT x.source AS node, min(x.target) AS component FROM r x JOIN r y ON x.source = y.target AND x.target = y.source GROUP BY x.source HAVING count(*) > 1)
  SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM m""")
def scc_members(spark, d):
    return graph.components(steps(spark, d))


@query(r"""SELECT page_id, (i - 1)::INT AS script, s[i] AS code FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS s FROM pages), unnest(range(1, len(s) + 1)) t(i) WHERE trim(s[i]) <> ''""")
def inline_scripts(spark, d):
    return files.inline_scripts(table(spark, d, "pages"))


LINES = "x AS (SELECT doc_id, i AS line, s[i] AS code FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) t(i))"


@query(f"WITH {LINES} SELECT doc_id, line::INT AS line, code FROM (SELECT *, max(regexp_matches(code, '[0-9]{{4}}')::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS b FROM x) WHERE regexp_matches(code, '@') AND b = 1")
def context_findings(spark, d):
    return rules.near_lines(files.lines(table(spark, d, "documents"), "doc_id"), "@", "[0-9]{4}", 1, "doc_id")


@query(rf"WITH {LINES} SELECT doc_id, min(line) FILTER (regexp_matches(code, '[Ll]icense'))::INT AS line FROM x GROUP BY doc_id HAVING bool_or(regexp_matches(code, '[Ll]icense')) AND NOT bool_or(regexp_matches(code, 'Version'))")
def file_level_rule(spark, d):
    return rules.files_with_and_without(files.lines(table(spark, d, "documents"), "doc_id"), "[Ll]icense", "Version", "doc_id")


@query("SELECT p_partkey, len(g)::INT AS n_grams, len(list_distinct(g))::INT AS n_distinct FROM (SELECT p_partkey, list_transform(range(1, greatest(1, length(p_name) - 1)), lambda i: lower(p_name)[i:i + 2]) AS g FROM part)")
def ngram_profile(spark, d):
    g = T.ngrams(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.size(g).alias("n_grams"), F.size(F.array_distinct(g)).alias("n_distinct"))


NAMES = """k AS (SELECT p_partkey AS k, p_brand AS b, lower(p_name) AS name, min(p_partkey) OVER (PARTITION BY p_brand, lower(p_name)) AS first FROM part)"""


@query(f"""WITH {NAMES}, g AS (SELECT k, b, name[i:i + 2] AS gram, count(*) AS c FROM k, unnest(range(1, length(name) - 1)) t(i) WHERE k = first GROUP BY ALL), s AS (SELECT k, sum(c) AS n FROM g GROUP BY k)
  SELECT x.k AS a, y.k AS b, round(sum(least(x.c, y.c)) / sqrt(any_value(p.n) * any_value(q.n)), 6) AS similarity FROM g x JOIN g y ON x.b = y.b AND x.gram = y.gram AND x.k < y.k JOIN s p ON p.k = x.k JOIN s q ON q.k = y.k GROUP BY ALL
  HAVING sum(least(x.c, y.c)) / sqrt(any_value(p.n) * any_value(q.n)) >= 0.4
  UNION ALL SELECT first, k, 1.0 FROM k WHERE k <> first AND length(name) >= 3""")
def ochiai_pairs(spark, d):
    """All parts: the pairs of different names of a brand, 0.4 alike or more, by the least part key
    of each, and each part of the same name with that key; a part's other pairs are its name's."""
    name = table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_brand", F.lower("p_name").alias("name"))
    first = name.groupBy("p_brand", "name").agg(F.min("key").alias("key"))
    grams = first.select("key", "p_brand", F.explode(T.ngrams(F.col("name"))).alias("gram"))
    pairs = similarity.ochiai_pairs(grams, "key", "gram", 0.4, "p_brand").select("a", "b", F.round("similarity", 6).alias("similarity"))
    copies = name.join(first.withColumnRenamed("key", "a"), ["p_brand", "name"]).where((F.col("key") != F.col("a")) & (F.length("name") >= 3))
    return pairs.unionAll(copies.select("a", F.col("key").alias("b"), F.lit(1.0).alias("similarity")))


WHOLE_GRAMS = """g AS (SELECT doc_id, list_distinct(list_transform(list_filter(list_transform(range(1, greatest(1, length(text) - 1)), lambda i: lower(text)[i:i + 2]), lambda x: regexp_matches(x, '[A-Za-z0-9一-鿿]')), lambda x: substr(sha1(x), 1, 6))) AS g FROM documents)"""


@query(f"""WITH {WHOLE_GRAMS}, p AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g), j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s, any_value(a.n) AS na, any_value(b.n) AS nb FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2)
  SELECT a, b, round(s / (na + nb - s), 6) AS similarity FROM j WHERE s / (na + nb - s) >= 0.8""")
def near_duplicates(spark, d):
    return alike.similar_texts(table(spark, d, "documents"), "doc_id", "text", 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("""SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE greatest(x.vec_id + 1, y.vec_id + 1) <= 1.3 * least(x.vec_id + 1, y.vec_id + 1)""")
def band_pairs(spark, d):
    return similarity.band_pairs(table(spark, d, "embeddings").withColumn("n", F.col("vec_id") + 1), "vec_id", "n")


@query("SELECT sha1(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def exact_copies(spark, d):
    return table(spark, d, "documents").groupBy(F.sha1("text").alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


SNAP = "a AS (SELECT 'o' || o_orderkey AS f, o_orderstatus || o_orderkey AS h FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT 'o' || CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS f, o_orderstatus || o_orderkey || CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0 THEN 'x' ELSE '' END AS h FROM orders WHERE o_orderkey % 7 <> 0)"


@query(f"WITH {PARTS} SELECT source, target FROM e WHERE target NOT IN ('p1', 'p2')")
def cdc_apply(spark, d):
    e = E.normalized(supply(spark, d))
    changed = spark.createDataFrame([("p1", "deleted", None), ("p2", "deleted", None), ("s1", "modified", None)], "file string, change string, was string")
    return E.apply_changes(e, changed, e.where("source = 's1' and target not in ('p1', 'p2')")).select("source", "target")


@query("SELECT user_id, event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS tripped FROM events")
def breaker_trips(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    return feedback.breaker(ev, "user_id", "event_id").select("user_id", "event_id", "tripped")


@query("SELECT user_id, event_type, count(*) AS reports FROM events GROUP BY 1, 2 HAVING count(*) >= 2")
def weak_confirmed(spark, d):
    return feedback.confirmed(table(spark, d, "events"), ["user_id", "event_type"])


@query(r"SELECT doc_id, (1 + len(regexp_extract_all(text, '\b(if|for|while|case|catch|elif|except)\b|&&|\|\||\?')))::INT AS complexity FROM documents ORDER BY complexity DESC, doc_id LIMIT 20")
def complexity_rank(spark, d):
    return table(spark, d, "documents").select("doc_id", scoring.complexity(F.col("text")).alias("complexity")).orderBy(F.desc("complexity"), "doc_id").limit(20)


@query("SELECT l_orderkey % 50 AS g, (least(25, floor(avg(l_tax) * 125)) + least(25, 3 * count(*) FILTER (l_quantity > 48)) + least(25, 2 * count(*) FILTER (l_discount > 0.09)) + least(25, 8 * count(*) FILTER (l_returnflag = 'X')))::BIGINT AS debt FROM lineitem GROUP BY 1")
def debt_score(spark, d):
    li = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("g"))
    agg = li.agg(F.avg("l_tax").alias("t"), F.count_if(F.col("l_quantity") > 48).alias("q"), F.count_if(F.col("l_discount") > 0.09).alias("c"), F.count_if(F.col("l_returnflag") == "X").alias("x"))
    return agg.select("g", scoring.debt(F.col("t"), F.col("q"), F.col("c"), F.col("x")).cast("long").alias("debt"))


NODES = """n AS (SELECT vec_id AS id, CASE WHEN vec_id = 0 THEN NULL ELSE (vec_id - 1) // 5 END AS parent, vec_id AS seq, label::BIGINT AS depth, round((abs(embedding[1]::DOUBLE) % 1) * 0.35 + (abs(embedding[2]::DOUBLE) % 1) * 0.30 + (abs(embedding[3]::DOUBLE) % 1) * 0.20 + (abs(embedding[4]::DOUBLE) % 1) * 0.15, 2) AS total FROM embeddings)"""


def tree_nodes(spark, d) -> DataFrame:
    v = table(spark, d, "embeddings")
    part = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double")) % 1
    score = F.struct(*[part(i).alias(k) for i, k in enumerate(treesearch.WEIGHTS)])
    return v.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") > 0, F.floor((F.col("vec_id") - 1) / 5).cast("long")).alias("parent"), F.col("vec_id").alias("seq"), F.col("label").cast("long").alias("depth"), treesearch.total_score(score).alias("total"), F.lit("scored").alias("status"), F.lit(False).alias("pruned"))


@query(f"WITH {NODES} (SELECT 'bfs' AS strategy, id FROM n ORDER BY depth, seq LIMIT 1) UNION ALL (SELECT 'dfs', id FROM n ORDER BY depth DESC, seq LIMIT 1) UNION ALL (SELECT 'beam', id FROM n ORDER BY total DESC NULLS LAST, seq LIMIT 1)")
def select_next(spark, d):
    n = tree_nodes(spark, d)
    one = lambda s: treesearch.select(n, s).select(F.lit(s).alias("strategy"), "id")
    return one("bfs").unionAll(one("dfs")).unionAll(one("beam"))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, greatest(1, length(x) - 1)), lambda i: lower(x)[i:i + 2])) AS g FROM (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS x FROM conversations)),
  p AS (SELECT a.conv_id, max((len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) > 0.4)::INT) AS alike, a.turn FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.turn = 0 AND len(a.g) + len(b.g) > 0 WHERE a.turn > 0 GROUP BY a.conv_id, a.turn)
  SELECT conv_id, count(*) AS nodes, coalesce(sum(alike), 0)::BIGINT AS alike, coalesce(sum(alike), 0) / count(*) AS overlap FROM p GROUP BY conv_id""")
def layer_overlap(spark, d):
    t = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("id"), "text")
    return treesearch.overlap(t.where("id > 0"), t.where("id = 0"), 0.4, "conv_id")


@query(f"""WITH {KEYS}, r AS (SELECT source AS a, target AS b FROM e), s AS (SELECT 'o' || o_orderkey AS node, CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 2 END AS rank FROM orders),
  l1 AS (SELECT b AS node, rank FROM s JOIN r ON a = node), l2 AS (SELECT b AS node, rank FROM l1 JOIN r ON a = node), l3 AS (SELECT b AS node, rank FROM l2 JOIN r ON a = node)
  SELECT node, max(rank) AS rank FROM (SELECT * FROM s UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY node""")
def taint_reach(spark, d):
    seeds = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.when(F.col("o_orderstatus") == "F", 3).otherwise(2).alias("rank"))
    return graph.propagate(key_edges(spark, d), seeds)


@query("""WITH s AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id - event_id % 4 END AS parent, event_type AS func, floor(value) AS seconds FROM events),
  k AS (SELECT parent AS id, sum(seconds) AS inner_ FROM s WHERE parent IS NOT NULL GROUP BY 1)
  SELECT func, count(*) AS calls, sum(seconds) AS total, sum(seconds - coalesce(inner_, 0)) AS self, round(avg(seconds), 6) AS avg, min(seconds) AS min, max(seconds) AS max FROM s LEFT JOIN k USING (id) GROUP BY func""")
def profile_hotspots(spark, d):
    i = F.col("event_id")
    spans = table(spark, d, "events").select(i.alias("id"), F.when(i % 4 != 0, i - i % 4).alias("parent"), F.col("event_type").alias("func"), F.floor("value").cast("double").alias("seconds"))
    return scoring.profile(spans).withColumn("avg", F.round("avg", 6))


@query(f"WITH {LINES}, b AS (SELECT doc_id, line, sha1(array_to_string(list(trim(code, ' ')) OVER w, chr(10))) AS h, len(list(code) OVER w) AS n, length(array_to_string(list(trim(code, ' ')) OVER w, '')) AS z FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)), f AS (SELECT doc_id, line, min(line) OVER (PARTITION BY doc_id, h) AS first FROM b WHERE n = 2 AND z > 0) SELECT doc_id, first::INT AS first, line::INT AS again FROM f WHERE line >= first + 2")
def line_block_dups(spark, d):
    return similarity.repeated_blocks(files.lines(table(spark, d, "documents"), "doc_id"), "doc_id", 2)




@query()
def weak_signals(spark, d):
    t = table(spark, d, "conversations")
    return treesearch.signals(t.select(F.col("turn").alias("depth"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("seq"), "text"))


ALL_LINES = "(SELECT doc_id, i AS line, s[i] AS code, array_to_string(s[greatest(1, i - 3):i + 3], chr(10)) AS around FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) t(i))"
FOUND = f"f AS MATERIALIZED ({rules.sql(rules.RULES, ALL_LINES, 'doc_id')})"


def document_findings(spark, d) -> DataFrame:
    return rules.findings(files.lines(table(spark, d, "documents"), "doc_id", around=3, only=rules.near_literals()), None, "doc_id")


@query(f"WITH {FOUND} SELECT doc_id, line::INT AS line, type, severity, code FROM f")
def secret_findings(spark, d):
    """All rules over all lines of all documents."""
    return document_findings(spark, d)


@query(f"""WITH {FOUND}, s AS (SELECT source, least(100, sum(CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 8 WHEN 'medium' THEN 3 ELSE 1 END))::BIGINT AS score, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM f JOIN documents USING (doc_id) GROUP BY source)
  SELECT *, CASE WHEN score >= 70 THEN 'F' WHEN score >= 50 THEN 'D' WHEN score >= 30 THEN 'C' WHEN score >= 10 THEN 'B' ELSE 'A' END AS grade FROM s""")
def severity_score(spark, d):
    return rules.risk(document_findings(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id"), by=["source"])


@query(f"WITH {FOUND} SELECT type, count(DISTINCT source) AS files FROM f JOIN documents USING (doc_id) GROUP BY type HAVING count(DISTINCT source) >= 2")
def cross_file_types(spark, d):
    return rules.recurring_types(document_findings(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id"), "source")


@query(f"WITH {FOUND} SELECT doc_id, line::INT AS line, type, severity, code, rank FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY doc_id, line, type) AS rank FROM f) WHERE rank <= 30")
def findings_report(spark, d):
    """A report's order: the first 30 of each severity, its display cap."""
    return rules.ordered(document_findings(spark, d), 30, "doc_id")


@query(f"WITH {FOUND} SELECT doc_id, count(*) AS findings FROM f GROUP BY doc_id ORDER BY findings DESC, doc_id LIMIT 1")
def worst_file(spark, d):
    return rules.worst_file(document_findings(spark, d), "doc_id")


LAYER = " ".join(f"WHEN regexp_matches(p, '{'|'.join(ws)}') THEN '{k}'" for k, ws in scoring.LAYERS.items())
PATHS = r"n AS (SELECT page_id, regexp_replace(lower(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')), '\.[^./]*$', '') AS p FROM pages)"


@query(f"WITH {PATHS} SELECT CASE {LAYER} ELSE 'unknown' END AS layer, count(*) AS n FROM n GROUP BY 1")
def layer_classify(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, d, "pages").groupBy(scoring.layers(path).alias("layer")).agg(F.count("*").alias("n"))


@query(f"WITH {PATHS}, l AS (SELECT CASE {LAYER} ELSE 'unknown' END AS layer FROM n) SELECT count(DISTINCT layer) AS layers, count(DISTINCT layer) >= 3 AND count(*) FILTER (layer = 'unknown') < 0.5 * count(*) AS clear FROM l")
def clear_layers(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return scoring.clear_layers(table(spark, d, "pages").select(path.alias("path")))


NORM = r"replace(lower(regexp_replace(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '-', '_')"


@query(f"SELECT p_partkey, list_filter(string_split({NORM.format('p_name')}, '_'), lambda t: t <> '') AS tokens FROM part")
def identifier_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", T.identifier_tokens(F.col("p_name")).alias("tokens"))


@query(f"""WITH q AS (SELECT range AS i, 'blue widgets'[range:range + 2] AS g FROM range(1, 11)), qc AS (SELECT g, count(*) AS c FROM q GROUP BY g), qh AS (SELECT list(DISTINCT g) AS h FROM q WHERE regexp_matches(g, '[A-Za-z0-9一-鿿]')),
  n AS (SELECT p_partkey, p_name, {NORM.format('p_name')} AS nm, list_filter(string_split({NORM.format('p_name')}, '_'), lambda t: t <> '') AS tk, list_distinct(list_transform(range(1, greatest(1, length(p_name) - 1)), lambda i: lower(p_name)[i:i + 2])) AS gs FROM part),
  g AS (SELECT p_partkey, nm[i:i + 2] AS g, count(*) AS c FROM n, unnest(range(1, length(nm) - 1)) t(i) GROUP BY ALL),
  o AS (SELECT p_partkey, sum(least(g.c, qc.c)) AS s FROM g JOIN qc USING (g) GROUP BY 1),
  r AS (SELECT n.*, coalesce(s, 0) / sqrt(greatest(1, length(nm) - 2) * 10.0) AS r, len(list_intersect(gs, h)) / len(h) AS hit FROM n LEFT JOIN o USING (p_partkey), qh)
  SELECT p_partkey, round(greatest(CASE WHEN p_name = 'blue widgets' THEN 1.0 ELSE 0 END, CASE WHEN r >= 0.4 THEN r WHEN list_has_any(tk, ['blue widgets']) THEN 0.5 ELSE 0 END, CASE WHEN hit >= 0.3 THEN hit ELSE 0 END), 6) AS score
  FROM r WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 5""")
def semantic_search(spark, d):
    return similarity.search(table(spark, d, "part"), "blue widgets", "p_partkey", "p_name").select("p_partkey", F.round("score", 6).alias("score"))


HOT = "c AS (SELECT source, target FROM e WHERE source <> target), k AS (SELECT node FROM (SELECT 'n' || n_nationkey AS node FROM nation UNION SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 5000))"


@query(f"WITH {KEYS}, {HOT} SELECT DISTINCT source, target FROM c WHERE source IN (SELECT node FROM k) AND target IN (SELECT node FROM k)")
def bridges(spark, d):
    """Edges among nations and the customers with the most, of all keys."""
    own = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node")).unionAll(table(spark, d, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("c"), "c_custkey").alias("node")))
    return graph.bridges(key_edges(spark, d), own)


@query("SELECT p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) AND p_size <> 1")
def unreferenced_with_allowlist(spark, d):
    """A stand-in for names that are not used (parts of no line with a discount) and not on a list."""
    p = table(spark, d, "part")
    used = table(spark, d, "lineitem").where("l_discount > 0.08").select(F.col("l_partkey").alias("name"))
    return E.unreferenced(p.select(F.col("p_partkey").alias("name")), used, p.where("p_size = 1").select(F.col("p_partkey").alias("name")))


@query("SELECT p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def dead_symbols(spark, d):
    """A stand-in for definitions without calls: parts that no large line has."""
    return E.unreferenced(table(spark, d, "part").select(F.col("p_partkey").alias("name")), table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("name")))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M') AS round, count(*) AS events, count(*) <= 2 AS converged FROM events GROUP BY 1")
def converged_rounds(spark, d):
    return feedback.converged(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("round")), "round")


@query(f"""WITH {{SNAP}}, gone AS (SELECT f, h FROM a WHERE f NOT IN (SELECT f FROM b)), came AS (SELECT f, h FROM b WHERE f NOT IN (SELECT f FROM a)), m AS (SELECT g.f AS was, max(c.f) AS file FROM gone g JOIN came c USING (h) GROUP BY g.f)
  SELECT file, 'renamed' AS change, was FROM m UNION ALL SELECT f, 'deleted', NULL FROM gone WHERE f NOT IN (SELECT was FROM m) UNION ALL SELECT f, 'added', NULL FROM came WHERE f NOT IN (SELECT file FROM m)
  UNION ALL SELECT a.f, 'modified', NULL FROM a JOIN b ON a.f = b.f WHERE a.h <> b.h""".replace("{SNAP}", SNAP))
def snapshot_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    key, mark = F.col("o_orderkey"), F.concat("o_orderstatus", "o_orderkey")
    before = o.where(key % 5 != 0).select(F.concat(F.lit("o"), key).alias("file"), mark.alias("fingerprint"))
    after = o.where(key % 7 != 0).select(F.concat(F.lit("o"), F.when(key % 11 == 0, -key).otherwise(key)).alias("file"), F.concat(mark, F.when((key % 13 == 0) & (key % 11 != 0), "x").otherwise("")).alias("fingerprint"))
    return E.changes(before, after)


@query(f"WITH {LINKS}, w AS (SELECT *, CASE WHEN relation = 'external' THEN 'weak' ELSE 'strong' END AS kind, CASE WHEN symbol LIKE '%a%' THEN 'call' ELSE relation END AS r FROM e) SELECT count(*) AS total, count(*) FILTER (kind = 'strong') AS strong, count(*) FILTER (kind = 'weak') AS weak, count(*) FILTER (r = 'call') AS deep FROM w")
def edge_stats(spark, d):
    """Links to other hosts as weak edges, and those with an a in them as calls."""
    e = link_table(spark, d)
    return E.stats(e.withColumn("kind", F.when(F.col("relation") == "external", "weak").otherwise("strong")).withColumn("relation", F.when(F.col("symbol").contains("a"), "call").otherwise(F.col("relation"))))


TREE = NODES.replace("FROM embeddings)", "FROM embeddings), s AS (SELECT *, id % 17 = 5 AS pruned, CASE WHEN id % 23 = 3 THEN 'dead_end' ELSE 'scored' END AS status FROM n), x AS (SELECT s.*, NOT s.pruned AND coalesce(p.status, '') <> 'dead_end' AS inside FROM s LEFT JOIN s p ON s.parent = p.id), b AS (SELECT *, inside AND row_number() OVER (PARTITION BY parent, inside ORDER BY total DESC NULLS LAST, seq) > 3 AS cut FROM x)")


def marked_nodes(spark, d) -> DataFrame:
    return tree_nodes(spark, d).withColumn("pruned", F.col("id") % 17 == 5).withColumn("status", F.when(F.col("id") % 23 == 3, "dead_end").otherwise("scored"))


@query(f"WITH {TREE} SELECT id, parent, total, cut FROM b")
def beam_prune(spark, d):
    return treesearch.beam(marked_nodes(spark, d), 3).select("id", "parent", "total", "cut")


@query(f"WITH RECURSIVE {TREE}, c AS (SELECT id FROM b WHERE cut AND parent IS NOT NULL), g AS (SELECT id FROM c UNION SELECT n.id FROM n JOIN g ON n.parent = g.id) SELECT id, pruned OR id IN (SELECT id FROM g) AS pruned FROM b")
def subtree_prune(spark, d):
    return treesearch.prune(marked_nodes(spark, d), 3).select("id", "pruned")


DIMS = """m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS p, count(*) AS n, count(DISTINCT o_custkey) AS c, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1),
  c AS (SELECT month, (least(100, floor(p / 2000)) * 0.30::DOUBLE + (c % 101) * 0.25::DOUBLE + (n % 101) * 0.20::DOUBLE + (f % 101) * 0.10::DOUBLE + (u % 101) * 0.10::DOUBLE + 50 * 0.05::DOUBLE)
  / (0.30::DOUBLE + 0.25::DOUBLE + 0.20::DOUBLE + 0.10::DOUBLE + 0.10::DOUBLE + 0.05::DOUBLE) AS s FROM m)"""


@query(f"""WITH {DIMS}, g AS (SELECT month, round_even(s, 1) AS score FROM c), t AS (SELECT month, score, lag(score) OVER (ORDER BY month) AS before FROM g)
  SELECT month, score, CASE WHEN score >= 95 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 65 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END AS grade, before,
  CASE WHEN before IS NULL THEN 'new' WHEN score - before >= 0.5 THEN 'up' WHEN score - before <= -0.5 THEN 'down' ELSE 'same' END AS trend FROM t""")
def grade_trend(spark, d):
    """All six dimensions, from numbers of a month's orders."""
    m = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    m = m.agg(F.avg("o_totalprice").alias("p"), F.count("*").alias("n"), F.countDistinct("o_custkey").alias("c"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    part = lambda c: (F.col(c) % 101).cast("double")
    of = {"security": F.least(F.lit(100.0), F.floor(F.col("p") / 2000).cast("double")), "debt": part("c"), "structure": part("n"), "performance": part("f"), "logic": part("u"), "smells": F.lit(50.0)}
    dims = m.select("month", F.explode(F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v)])).alias("dim", "score"))
    return scoring.trend(scoring.composite(dims, ["month"]), "month").select("month", "score", "grade", "before", "trend")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    out = feeds.run_to_end(feeds.windowed_counts(feeds.events(spark, d)), "complete", "stream-windows")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS tripped FROM events")
def stream_breaker(spark, d):
    ev = feeds.events(spark, d).withColumn("failed", F.col("event_type") == "error")
    return feeds.run_to_end(feeds.breaker(ev), "append", "stream-breaker").select("user_id", "event_id", "tripped")


@query("SELECT user_id, event_type, count(*) AS reports, count(*) >= 2 AS confirmed FROM events GROUP BY 1, 2")
def stream_confirmed(spark, d):
    return feeds.run_to_end(feeds.confirmations(feeds.events(spark, d), ["user_id", "event_type"]), "complete", "stream-confirmed")


@query("WITH r AS (SELECT user_id, event_id, event_type || ':' || event_id AS reason, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'error') SELECT user_id, list(reason ORDER BY event_id) AS reasons FROM r WHERE n <= 10 GROUP BY user_id")
def last_reasons(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"), F.concat_ws(":", "event_type", "event_id").alias("reason"))
    return feedback.last_reasons(ev, "user_id", "event_id")


@query(f"WITH {LINES}, s AS (SELECT doc_id, line, code, (len(code) - len(replace(code, '|', '')))::BIGINT AS k FROM x) SELECT doc_id, line::INT AS line, sum(len(regexp_extract_all(code, '\\{{')) - len(regexp_extract_all(code, '\\}}'))) OVER (PARTITION BY doc_id ORDER BY line)::BIGINT AS depth FROM s")
def brace_depth(spark, d):
    return extract.brace_depth(files.lines(table(spark, d, "documents"), "doc_id"), "doc_id").select("doc_id", "line", "depth")


ABILITY = ", ".join(f"CASE WHEN list_has_any(w, [{', '.join(f"'{x}'" for x in ws.split())}]) THEN '{k}' END" for k, ws in review.ABILITIES.items())


@query(f"SELECT doc_id, list_filter([{ABILITY}], lambda x: x IS NOT NULL) AS tags FROM (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+') AS w FROM documents)")
def keyword_tagging(spark, d):
    return table(spark, d, "documents").select("doc_id", review.tags(F.col("text"), review.ABILITIES).alias("tags"))


@query("WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT func, count(*) AS calls, max(depth)::BIGINT AS depth FROM (SELECT event_type AS func, event_id, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS depth FROM events) WHERE func <> 'error' GROUP BY func")
def call_trace(spark, d):
    """Events as a trace: an error returns from what was open."""
    ev = table(spark, d, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), F.col("event_type").alias("func"), F.when(F.col("event_type") == "error", "return").otherwise("call").alias("event"))
    return scoring.call_summary(ev)


@query("SELECT func, calls, total, self FROM (WITH s AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id - event_id % 4 END AS parent, event_type AS func, floor(value) AS seconds FROM events), k AS (SELECT parent AS id, sum(seconds) AS inner_ FROM s WHERE parent IS NOT NULL GROUP BY 1) SELECT func, count(*) AS calls, sum(seconds) AS total, sum(seconds - coalesce(inner_, 0)) AS self FROM s LEFT JOIN k USING (id) GROUP BY func) ORDER BY self DESC, func LIMIT 3")
def hot_spots(spark, d):
    i = F.col("event_id")
    spans = table(spark, d, "events").select(i.alias("id"), F.when(i % 4 != 0, i - i % 4).alias("parent"), F.col("event_type").alias("func"), F.floor("value").cast("double").alias("seconds"))
    return scoring.hot_spots(spans, 3).select("func", "calls", "total", "self")


COVER = "t AS (SELECT l_orderkey AS file, l_linenumber AS line, bool_or(l_returnflag <> 'N') AS hit FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {COVER} SELECT file, list(line ORDER BY line) AS missing FROM t WHERE NOT hit GROUP BY file")
def uncovered_lines(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), "l_returnflag")
    return scoring.uncovered(li.select("file", "line"), li.where("l_returnflag != 'N'").select("file", "line"))


@query(f"WITH {COVER} SELECT count(*) FILTER (hit)::BIGINT AS covered, count(*)::BIGINT AS lines, count(*) FILTER (hit) / count(*) AS ratio FROM t")
def overall_coverage(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), "l_returnflag")
    return scoring.overall_coverage(li.select("file", "line"), li.where("l_returnflag != 'N'").select("file", "line"))


@query("SELECT sum(len(p)) AS full_size, sum(least(60, len(p))) AS brief_size, 1 - sum(least(60, len(p))) / sum(len(p)) AS saved FROM (SELECT coalesce(text, '') AS p FROM documents)")
def brief_savings(spark, d):
    own = table(spark, d, "documents").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("full_size"), F.sum(F.least(F.lit(60), F.length(F.coalesce("text", F.lit(""))))).alias("brief_size"))
    return own.withColumn("saved", scoring.savings(F.col("brief_size"), F.col("full_size")))


@query(f"WITH {FOUND} SELECT json_object('doc_id', doc_id, 'line', line::INT, 'type', type) AS json FROM f")
def findings_json(spark, d):
    return store.to_json(document_findings(spark, d).select("doc_id", "line", "type"))


@query("SELECT p_partkey, p_name FROM part")
def json_round_trip(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return store.from_json(store.to_json(p), p.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


ERROR = " ".join(f"WHEN {' OR '.join(f"contains(t, '{w}')" for w in ws)} THEN '{k}'" for k, ws in dynamic.ERRORS.items())


@query(f"SELECT error, count(*) AS n FROM (SELECT CASE WHEN t = '' THEN '' {ERROR} ELSE 'unknown' END AS error FROM (SELECT lower(coalesce(text, '')) AS t FROM documents)) GROUP BY 1")
def error_classes(spark, d):
    return table(spark, d, "documents").groupBy(dynamic.error_class(F.coalesce("text", F.lit(""))).alias("error")).agg(F.count("*").alias("n"))
