"""Registered queries of relations, filters, folds and contexts over whole driver tables, with DuckDB SQL for the same rows.

Line items are spans of an order's file (line number, quantity as tokens), events are hits and calls, parts are entities.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates, budgets, context, dedup, patches, predicates, relations, retrieval, tree
from .catalog import query, table
from .trees import _N, _P, _blocks, _nodes

_RAW = "CASE page_id % 4 WHEN 0 THEN '/repo/a/' || page_id WHEN 1 THEN '//b/' || page_id WHEN 2 THEN 'work/x/' || page_id ELSE 'repo/repo/' || page_id END"


@query(f"SELECT page_id, regexp_replace(regexp_replace(CASE WHEN starts_with(p, 'work/') THEN substr(p, 6) ELSE p END, '^/+', ''), '^repo/', '') AS path FROM (SELECT page_id, {_RAW} AS p FROM pages)")
def p04_normal_path(spark, d):
    return table(spark, d, "pages").select("page_id", predicates.normal_path(F.expr(_RAW), "work/").alias("path"))


@query("SELECT event_id, NOT (e < 20 OR s > 30) AS meets, s >= 20 AND e <= 30 AS inside FROM (SELECT event_id, event_id % 40 AS s, event_id % 40 + user_id % 9 AS e FROM events)")
def p11_line_ranges(spark, d):
    s, e = F.col("event_id") % 40, F.col("event_id") % 40 + F.col("user_id") % 9
    return table(spark, d, "events").select("event_id", predicates.overlaps(s, e, F.lit(20), F.lit(30)).alias("meets"), predicates.within(s, e, F.lit(20), F.lit(30)).alias("inside"))


@query("SELECT doc_id FROM documents WHERE n_chars > 0 AND NOT (doc_id % 3 = 0 AND n_chars > 1000)")
def p13_not_generated(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("tokens"), F.when(F.col("doc_id") % 3 == 0, "Auto-GENERATED file").alias("first_comment"))
    return predicates.not_generated(rows, 1000).select("doc_id")


@query(f"""
WITH {_P}, n AS ({_N}), c AS (SELECT parent_id AS node_id, count(*) AS k FROM n WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT node_id FROM n LEFT JOIN c USING (node_id) WHERE coalesce(action, '') <> 'Finish' AND reward % 5 > 0 AND coalesce(k, 0) < greatest(reward % 20, 1)""")
def p19_expandable(spark, d):
    nodes = _nodes(spark, d).selectExpr("node_id", "parent_id", "action = 'Finish' as is_terminal", "reward % 5 = 0 as is_duplicate", "reward % 20 as max_expansions")
    return predicates.expandable(nodes).select("node_id")


@query("SELECT event_id, event_id % 3 <> 2 AS complete FROM events")
def p21_has_keys(spark, d):
    reply = F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("so: "), "props")).otherwise(F.regexp_replace("props", r"^\{", '{"score": 1, '))
    return table(spark, d, "events").select("event_id", predicates.has_keys(reply, ["score", "k"]).alias("complete"))


@query("SELECT 'class' AS source_type, p_brand AS source_id, 'class' AS target_type, unnest([p_type, 'Base' || p_size]) AS target_id, 'inherits' AS relationship_type FROM part")
def r03_inherits(spark, d):
    return relations.inherits(table(spark, d, "part").select(F.col("p_brand").alias("name"), F.array("p_type", F.concat(F.lit("Base"), "p_size")).alias("bases")))


@query("SELECT class_name, attribute, function FROM (SELECT DISTINCT p_brand AS class_name, 'a' || (p_size % 20) AS attribute FROM part) JOIN (SELECT p_brand AS class_name, p_partkey AS function, 'x = self.a' || p_size AS code FROM part) USING (class_name) WHERE contains(code, 'self.' || attribute)")
def r04_attribute_users(spark, d):
    p = table(spark, d, "part")
    attributes = p.select(F.col("p_brand").alias("class_name"), F.concat(F.lit("a"), F.col("p_size") % 20).alias("name")).distinct()
    return relations.attribute_users(attributes, p.select(F.col("p_brand").alias("class_name"), F.col("p_partkey").alias("name"), F.concat(F.lit("x = self.a"), "p_size").alias("code")))


_SPANS = "SELECT l_orderkey AS file_path, l_linenumber::VARCHAR AS span_id, l_linenumber * 10 AS start_line, l_linenumber * 10 + 9 AS end_line, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem"


def _spans(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey as file_path", "cast(l_linenumber as string) as span_id", "l_linenumber * 10 as start_line", "l_linenumber * 10 + 9 as end_line", "cast(l_quantity as bigint) as tokens")


@query(f"""
WITH s AS ({_SPANS}), h AS (SELECT o_orderkey AS file_path, (o_orderkey % 9)::VARCHAR AS span_id, 15 AS start_line, 35 AS end_line FROM orders)
SELECT h.file_path, h.span_id FROM h JOIN s USING (file_path, span_id)
UNION ALL SELECT h.file_path, s.span_id FROM h JOIN s USING (file_path) WHERE (h.file_path, h.span_id) NOT IN (SELECT (file_path, span_id) FROM s) AND s.end_line >= h.start_line AND s.start_line <= h.end_line""")
def r10_resolved_spans(spark, d):
    hits = table(spark, d, "orders").selectExpr("o_orderkey as file_path", "cast(o_orderkey % 9 as string) as span_id", "15 as start_line", "35 as end_line")
    return relations.resolved_spans(hits, _spans(spark, d)).select("file_path", "span_id")


@query(f"""
WITH e AS (SELECT file_path, span_id FROM ({_SPANS}) WHERE span_id <> '2'), f AS (SELECT o_orderkey AS file_path, (o_custkey % 6)::VARCHAR AS span_id FROM orders WHERE o_orderkey % 5 > 0)
SELECT file_path, span_id FROM e ANTI JOIN f USING (file_path, span_id)
UNION ALL SELECT DISTINCT file_path, NULL AS span_id FROM e ANTI JOIN f USING (file_path)""")
def r14_missing(spark, d):
    """Expected spans that weren't found, and files with none (span_id null)."""
    expected = _spans(spark, d).where("span_id <> '2'").select("file_path", "span_id")
    found = table(spark, d, "orders").where("o_orderkey % 5 > 0").selectExpr("o_orderkey as file_path", "cast(o_custkey % 6 as string) as span_id")
    spans = patches.missing_spans(expected, found)
    return spans.select("file_path", "span_id").union(patches.missing_files(expected, found).select("file_path", F.lit(None).cast("string")))


@query(f"""
WITH s AS (SELECT file_path // 4 AS instance_id, file_path % 2 AS solution, file_path, span_id FROM ({_SPANS})), f AS (SELECT DISTINCT file_path // 4 AS instance_id, file_path, span_id FROM ({_SPANS}) WHERE file_path % 3 > 0 AND tokens > 5),
e AS (SELECT instance_id, solution, bool_and(file_path IN (SELECT file_path FROM f)) AS ff, bool_and((file_path, span_id) IN (SELECT (file_path, span_id) FROM f)) AS fs FROM s GROUP BY 1, 2)
SELECT instance_id, bool_or(ff) AS found_files, bool_or(fs) AS found_spans FROM e GROUP BY 1""")
def r16_any_solution(spark, d):
    s = _spans(spark, d).withColumn("instance_id", F.expr("file_path div 4")).withColumn("solution", F.expr("file_path % 2"))
    return patches.any_solution(s, s.where("file_path % 3 > 0 and tokens > 5"))


@query(f"""
WITH e AS (SELECT file_path // 3 AS instance_id, file_path, start_line + 1 AS s, start_line + 4 AS t FROM ({_SPANS})), a AS (SELECT file_path // 3 AS instance_id, file_path, start_line AS s, end_line AS t FROM ({_SPANS}) WHERE tokens > 20),
m AS (SELECT e.instance_id, count(*) AS met FROM e JOIN a USING (instance_id, file_path) WHERE e.s >= a.s AND e.t <= a.t GROUP BY 1),
f AS (SELECT instance_id, count(*) AS missed FROM (SELECT DISTINCT instance_id, file_path FROM e) ANTI JOIN a USING (instance_id, file_path) WHERE instance_id IN (SELECT instance_id FROM a) GROUP BY 1)
SELECT instance_id, coalesce(missed, 0) AS missed_files, n - coalesce(met, 0) AS missed_hunks FROM (SELECT instance_id, count(*) AS n FROM e GROUP BY 1) LEFT JOIN m USING (instance_id) LEFT JOIN f USING (instance_id)""")
def r17_compared(spark, d):
    s = _spans(spark, d).withColumn("instance_id", F.expr("file_path div 3"))
    expected = s.select("instance_id", "file_path", (F.col("start_line") + 1).alias("start_line"), (F.col("start_line") + 4).alias("end_line"))
    return patches.compared(expected, s.where("tokens > 20").select("instance_id", "file_path", "start_line", "end_line"))


@query(f"""
WITH s AS (SELECT *, CASE WHEN span_id IN ('1', '2') THEN 'init' ELSE 'impl' END AS span_type, CASE WHEN span_id <> '1' THEN 'C' END AS class_name FROM ({_SPANS})),
e AS (SELECT file_path, span_id AS source, (span_id::INT + 2)::VARCHAR AS target FROM s), w AS (SELECT file_path, span_id FROM s WHERE tokens > 40),
m AS (SELECT DISTINCT file_path, class_name FROM s SEMI JOIN w USING (file_path, span_id)),
r AS (SELECT e.file_path, target AS span_id FROM e JOIN w ON e.file_path = w.file_path AND e.source = w.span_id UNION SELECT e.file_path, source FROM e JOIN w ON e.file_path = w.file_path AND e.target = w.span_id
  UNION SELECT s.file_path, span_id FROM s JOIN m USING (file_path, class_name) WHERE span_type = 'init' UNION SELECT s.file_path, span_id FROM s SEMI JOIN m USING (file_path) WHERE span_type = 'init' AND class_name IS NULL)
SELECT file_path, span_id FROM r ANTI JOIN w USING (file_path, span_id)""")
def r18_related_spans(spark, d):
    s = _spans(spark, d).withColumn("span_type", F.expr("case when span_id in ('1', '2') then 'init' else 'impl' end")).withColumn("class_name", F.expr("case when span_id <> '1' then 'C' end"))
    edges = s.selectExpr("file_path", "span_id as source", "cast(cast(span_id as int) + 2 as string) as target")
    return relations.related_spans(s, edges, s.where("tokens > 40").select("file_path", "span_id"))


@query("""
WITH s AS (SELECT p_partkey, p_brand || '/' || p_type || '/m' || (p_size % 9) || '.py' AS file_path FROM part), t AS (SELECT DISTINCT p_brand || '/' || p_type || '/test_m' || (p_size % 7) || '.py' AS test_path FROM part),
j AS (SELECT DISTINCT file_path, test_path FROM s JOIN t ON 'test_' || regexp_replace(file_path, '^.*/', '') = regexp_replace(test_path, '^.*/', '')),
k AS (SELECT *, list_max(list_transform(list_filter(range(0, length(file_path) + 1), lambda i: left(regexp_replace(file_path, '[^/]*$', ''), i) = left(regexp_replace(test_path, '[^/]*$', ''), i) AND i <= least(length(regexp_replace(file_path, '[^/]*$', '')), length(regexp_replace(test_path, '[^/]*$', '')))), lambda i: i)) AS n FROM j)
SELECT file_path, test_path FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY n DESC, test_path) AS r FROM k) WHERE r = 1""")
def r22_test_files(spark, d):
    path = lambda head, m: F.concat("p_brand", F.lit("/"), "p_type", F.lit(f"/{head}"), F.col("p_size") % m, F.lit(".py"))
    p = table(spark, d, "part")
    return relations.test_files(p.select(path("m", 9).alias("file_path")).distinct(), p.select(path("test_m", 7).alias("file_path")).distinct())


@query("SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS n FROM lineitem")
def a11_span_count(spark, d):
    return aggregates.span_count(_spans(spark, d))


@query(f"WITH {_P}, n AS ({_N}) SELECT parent_id, action, count(*) AS n, count(*) FILTER (reward % 5 = 0) AS duplicates FROM n WHERE parent_id IS NOT NULL GROUP BY ALL")
def a21_sibling_actions(spark, d):
    return aggregates.sibling_actions(_nodes(spark, d).withColumn("is_duplicate", F.col("reward") % 5 == 0))


@query(f"WITH a AS (SELECT file_path, span_id FROM ({_SPANS}) WHERE tokens > 30), b AS (SELECT DISTINCT file_path, span_id FROM ({_SPANS}) WHERE tokens < 40) SELECT file_path, span_id, true AS is_new FROM b ANTI JOIN a USING (file_path, span_id) UNION ALL SELECT file_path, span_id, false FROM a")
def d05_merged_contexts(spark, d):
    s = _spans(spark, d).select("file_path", "span_id", "tokens")
    every, new = dedup.merged_contexts(s.where("tokens > 30").drop("tokens"), s.where("tokens < 40").drop("tokens"))
    return every.join(new.withColumn("is_new", F.lit(True)), ["file_path", "span_id"], "left").na.fill(False, ["is_new"])


@query("SELECT event_id, had_duplicates FROM (SELECT event_id, r, max(r > 1) OVER (PARTITION BY user_id) AS had_duplicates FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS r FROM events)) WHERE r = 1")
def d11_tool_calls(spark, d):
    calls = table(spark, d, "events").selectExpr("user_id as message_id", "event_type as name", "props as arguments", "event_id as pos")
    return dedup.tool_calls(calls).select(F.col("pos").alias("event_id"), "had_duplicates")


@query(f"WITH {_P} SELECT block_id, count(*) OVER (PARTITION BY parent_id, type, identifier) > 1 AS repeated FROM b")
def d13_flagged_names(spark, d):
    return dedup.flagged_names(_blocks(spark, d)).select("block_id", "repeated")


@query("SELECT p_partkey, lower(p_name) = lower(p_type || ' bolt') AS same FROM part")
def f02_exact_match(spark, d):
    return table(spark, d, "part").select("p_partkey", T.exact_match(F.concat(F.lit("The "), "p_name", F.lit("!")), F.concat("p_type", F.lit(" a bolt."))).alias("same"))


@query("SELECT user_id, event_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS total FROM events")
def w01_running(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return budgets.running(rows, ["user_id"], ["event_id"]).select("user_id", "event_id", "total")


@query(f"SELECT o_orderkey AS file, 10 + o_custkey % 30 AS line, min_by(span_id, start_line) AS ord FROM orders JOIN ({_SPANS}) ON file_path = o_orderkey WHERE start_line >= 10 + o_custkey % 30 GROUP BY ALL")
def w11_block_at(spark, d):
    blocks = _spans(spark, d).select(F.col("file_path").alias("file"), "start_line", F.col("span_id").alias("ord"))
    return budgets.block_at(blocks, table(spark, d, "orders").selectExpr("o_orderkey as file", "10 + o_custkey % 30 as line"))


@query(f"""
WITH {_P}, c AS (SELECT node_id, p.ancestor_id, distance, ancestor_id % 4 > 0 AS corrects FROM p WHERE distance > 0), k AS (SELECT node_id, coalesce(min(distance) FILTER (NOT corrects) - 1, max(distance)) AS n FROM c GROUP BY 1)
SELECT block_id AS node_id, greatest(-100, -25 * coalesce(n, 0)) AS penalty FROM b LEFT JOIN k ON node_id = block_id""")
def w12_penalties(spark, d):
    nodes = _nodes(spark, d).selectExpr("node_id", "parent_id", "node_id % 4 > 0 as expect_correction")
    return budgets.penalties(nodes, tree.closure(nodes.select("node_id", "parent_id")))


_CHUNK = "SELECT l_orderkey * 10 + l_linenumber AS chunk_id, CASE l_orderkey % 3 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'src/test_a.py' ELSE 'lib/a.py' END AS file_path, l_linestatus || ' ' || l_returnflag AS content FROM lineitem"


@query(f"SELECT l_partkey AS query_id, l_suppkey AS rank, chunk_id FROM lineitem JOIN ({_CHUNK}) ON chunk_id = l_orderkey * 10 + l_linenumber WHERE file_path = 'src/a.py' AND contains(content, 'A') AND contains(replace(content, ' ', ''), 'FA')")
def v04_post_filters(spark, d):
    li = table(spark, d, "lineitem").withColumn("chunk_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    path = F.expr("case l_orderkey % 3 when 0 then 'src/a.py' when 1 then 'src/test_a.py' else 'lib/a.py' end")
    chunks = li.select("chunk_id", path.alias("file_path"), F.concat_ws(" ", "l_linestatus", "l_returnflag").alias("content"))
    hits = li.select(F.col("l_partkey").alias("query_id"), F.col("l_suppkey").alias("rank"), "chunk_id")
    return retrieval.post_filters(hits, chunks, include=["src/*"], exclude=["lib/*"], category="implementation", exact="A", snippet="F A").select("query_id", "rank", "chunk_id")


@query(f"WITH s AS (SELECT file_path % 50 AS node_id, * FROM ({_SPANS})), c AS (SELECT * FROM s WHERE tokens > 10), r AS (SELECT o_orderkey % 50 AS node_id, o_orderkey AS file_path, 12 AS low, 25 + o_custkey % 40 AS high FROM orders) SELECT * FROM r WHERE EXISTS (SELECT 1 FROM c WHERE c.node_id = r.node_id AND c.file_path = r.file_path AND low BETWEEN start_line AND end_line) AND EXISTS (SELECT 1 FROM c WHERE c.node_id = r.node_id AND c.file_path = r.file_path AND high BETWEEN start_line AND end_line)")
def y11_covers(spark, d):
    spans = _spans(spark, d)
    held = spans.where("tokens > 10").selectExpr("file_path % 50 as node_id", "file_path", "span_id")
    ranges = table(spark, d, "orders").selectExpr("o_orderkey % 50 as node_id", "o_orderkey as file_path", "12 as low", "25 + o_custkey % 40 as high")
    return context.covers(held, spans, ranges)


@query(f"WITH c AS (SELECT file_path % 50 AS node_id, file_path, span_id, tokens > 40 AS pinned FROM ({_SPANS})) SELECT node_id, file_path, span_id, pinned OR tokens_odd AS pinned FROM (SELECT *, span_id IN ('1', '3') AS tokens_odd FROM c) WHERE pinned OR span_id <> '2'")
def x05_removed_and_pinned(spark, d):
    held = _spans(spark, d).selectExpr("file_path % 50 as node_id", "file_path", "span_id", "tokens > 40 as pinned")
    left = context.removed(held, held.where("span_id = '2'").select("node_id", "file_path", "span_id"))
    return context.pinned(left, held.where("span_id in ('1', '3')").select("node_id", "file_path", "span_id"))


_FAILS = "CASE event_id % 6 WHEN 0 THEN 'file_not_found' WHEN 1 THEN 'no_search_hits' END"
_ACTS = "CASE event_id % 4 WHEN 0 THEN 'FindClass' WHEN 1 THEN 'ViewCode' WHEN 2 THEN 'SemanticSearch' ELSE 'Finish' END"


@query(f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN -50 WHEN 1 THEN -25 ELSE CASE event_id % 4 WHEN 0 THEN CASE WHEN user_id % 3 > 0 THEN 100 ELSE 0 END WHEN 1 THEN CASE WHEN user_id % 2 > 0 THEN 50 ELSE 25 END WHEN 2 THEN CASE WHEN user_id % 3 > 0 THEN 100 ELSE 0 END ELSE 50 END END AS reward FROM events")
def g09_rule_rewards(spark, d):
    steps = table(spark, d, "events").selectExpr("event_id", f"{_FAILS} as fail_reason", f"{_ACTS} as action", "user_id % 3 as hits", "user_id % 2 as new_spans")
    return tree.rule_rewards(steps).select("event_id", "reward")


@query("SELECT e.user_id AS query_id, e.event_id, e.spare FROM (SELECT user_id, event_id, false AS spare FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, event_id, true FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')) e")
def v14_fallback(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("query_id"), "event_id", "event_type")
    of = lambda t: rows.where(F.col("event_type") == t).select("query_id", "event_id", F.lit(t == "view").alias("spare"))
    return retrieval.fallback(of("purchase"), of("view"))
