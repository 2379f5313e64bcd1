"""Registered queries over trees: blocks, feedback and histories, each with DuckDB SQL for the same rows.

Parts make a forest of blocks whose numbers are a depth-first walk: thousands are roots, hundreds below them, then tens, then
single numbers. Their name is a block's content, their size gives identifiers, spans and replies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, context, feedback, relations, tree
from .catalog import query, table

_UP = "CASE WHEN n % 10 > 0 THEN n - n % 10 WHEN n % 100 > 0 THEN n - n % 100 WHEN n % 1000 > 0 THEN n - n % 1000 END"
_TYPE = "CASE WHEN n % 1000 = 0 THEN 'module' WHEN n % 100 = 0 THEN 'class' WHEN n % 10 = 0 THEN 'function' WHEN n % 7 = 0 THEN 'commented_out_code' WHEN n % 11 = 0 THEN 'error' ELSE 'statement' END"
_BLOCK = f"n AS block_id, {_UP} AS parent_id, n AS ord, {_TYPE} AS type, CASE WHEN n % 1000 = 0 THEN 'm' WHEN n % 100 = 0 THEN 'c' WHEN n % 10 = 0 THEN 'f' ELSE 's' END || (p_size % 4) AS identifier, p_name AS content, CASE WHEN p_size % 5 > 0 THEN 's' || (p_size % 3) END AS span_id"
_B = f"b AS (SELECT {_BLOCK} FROM (SELECT *, p_partkey AS n FROM part))"
_P = f"RECURSIVE {_B}, p AS (SELECT block_id AS node_id, block_id AS ancestor_id, parent_id AS up, 0 AS distance FROM b UNION ALL SELECT p.node_id, b.block_id, b.parent_id, distance + 1 FROM p JOIN b ON b.block_id = p.up), d AS (SELECT p.ancestor_id AS start_id, p.distance, b.* FROM p JOIN b ON b.block_id = p.node_id)"


def _blocks(spark, d) -> DataFrame:
    return table(spark, d, "part").withColumn("n", F.col("p_partkey")).selectExpr(*_split(_BLOCK))


def _split(columns: str) -> list[str]:
    """A select list's columns; commas inside brackets don't part them."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


def _paths(b: DataFrame) -> DataFrame:
    return tree.closure(b.select(F.col("block_id").alias("node_id"), "parent_id"))


@query(f"WITH {_P} SELECT DISTINCT start_id AS block_id FROM d WHERE contains(content, 'bolt') AND span_id = 's1'")
def p10_has_content(spark, d):
    b = _blocks(spark, d)
    return blocks.has_content(b, _paths(b), "bolt", "s1")


@query("SELECT list_slice(p, 1, k) AS path, bool_or(k = len(p)) AS show FROM (SELECT string_split(p_type, ' ') AS p, unnest(range(0, len(string_split(p_type, ' ')) + 1)) AS k FROM part) GROUP BY 1")
def g05_path_trie(spark, d):
    return blocks.path_trie(table(spark, d, "part").select(F.split("p_type", " ").alias("path")))


@query(f"""
WITH {_B}, f AS (SELECT *, row_number() OVER (PARTITION BY parent_id, identifier ORDER BY ord) = 1 AS is_first FROM b WHERE parent_id IS NOT NULL)
SELECT r.block_id AS root_id, x.identifier || '.' || y.identifier AS path, y.block_id FROM b r JOIN f x ON x.parent_id = r.block_id AND x.is_first AND x.identifier[1] = 'c' JOIN f y ON y.parent_id = x.block_id AND y.is_first AND y.identifier[1] = 'f' WHERE r.parent_id IS NULL""")
def g06_by_path(spark, d):
    b = _blocks(spark, d)
    steps = F.array(*[F.array(F.lit(f"c{i}"), F.lit(f"f{j}")) for i in range(4) for j in range(4)])
    wanted = b.where("parent_id is null").select(F.col("block_id").alias("root_id"), F.explode(steps).alias("path"))
    return blocks.by_path(b, _paths(b), wanted).select("root_id", F.array_join("path", ".").alias("path"), "block_id")


@query(f"WITH {_P} SELECT start_id, min_by(block_id, ord) AS block_id FROM d WHERE distance > 0 AND identifier = 's3' AND type = 'statement' GROUP BY 1")
def g06_by_identifier(spark, d):
    b = _blocks(spark, d)
    return blocks.by_identifier(b, _paths(b), "s3", "statement", recursive=True)


@query(f"WITH {_P}, gaps AS (SELECT DISTINCT start_id AS block_id FROM d WHERE type = 'commented_out_code') SELECT start_id, block_id FROM d JOIN gaps USING (block_id) WHERE distance > 0 AND type IN ('class', 'function')")
def g06_incomplete(spark, d):
    b = _blocks(spark, d)
    return blocks.incomplete(b, _paths(b), "class", "function")


@query(f"WITH {_P} SELECT start_id, block_id, 'Found validation errors in ' || content AS error FROM d WHERE type = 'error'")
def g06_errors(spark, d):
    b = _blocks(spark, d)
    return blocks.errors(b.withColumns({"messages": F.array().cast("array<string>"), "path": F.array("content")}), _paths(b))


@query(f"WITH {_P} SELECT start_id, list_sort(list_distinct(list(span_id))) AS span_ids FROM d WHERE span_id IS NOT NULL GROUP BY 1")
def y04_span_ids(spark, d):
    b = _blocks(spark, d)
    return blocks.span_ids(b, _paths(b))


@query(f"WITH {_P}, f AS (SELECT start_id, min_by(block_id, ord) AS first_id FROM d WHERE span_id = 's2' GROUP BY 1), t AS (SELECT start_id, min_by(block_id, ord) AS error_id FROM d WHERE type = 'error' GROUP BY 1) SELECT start_id, first_id, error_id FROM f JOIN t USING (start_id)")
def y04_first_of(spark, d):
    b = _blocks(spark, d)
    paths = _paths(b)
    first = blocks.first_of_span(b, paths, "s2").withColumnRenamed("block_id", "first_id")
    return first.join(blocks.first_of_type(b, paths, "error").withColumnRenamed("block_id", "error_id"), "start_id")


@query(f"""
WITH {_P}, w AS (SELECT p.node_id, min(p.distance) AS wall FROM p JOIN b ON b.block_id = p.ancestor_id WHERE type = 'function' GROUP BY 1)
SELECT start_id, block_id, content AS target FROM d LEFT JOIN w ON w.node_id = block_id WHERE wall IS NULL OR distance <= wall""")
def y04_relationships(spark, d):
    b = _blocks(spark, d)
    return blocks.relationships(b, _paths(b), b.select("block_id", F.col("content").alias("target")), "function").select("start_id", "block_id", "target")


_E = "SELECT user_id AS search_id, event_id AS node_id, event_id % 7 AS pos, CASE WHEN event_id % 9 = 0 THEN event_id WHEN event_id % 2 = 0 THEN event_id - 1 END AS suggested_node_id FROM events"


@query(f"SELECT search_id, coalesce(min_by(node_id, pos * 100000000 + node_id) FILTER (suggested_node_id = node_id), max(node_id)) AS node_id FROM ({_E}) GROUP BY 1")
def v17_suggested(spark, d):
    return feedback.suggested(table(spark, d, "events").selectExpr(*_split(_E.removeprefix("SELECT ").removesuffix(" FROM events"))))


@query("""
WITH n AS (SELECT o_custkey AS search_id, o_orderkey AS node_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
r AS (SELECT search_id, pos AS attempt, CASE WHEN node_id % 3 = 0 THEN node_id END AS node_id FROM n WHERE pos <= 3),
h AS (SELECT search_id, min_by(node_id, attempt) AS hit FROM r WHERE node_id IS NOT NULL GROUP BY 1),
f AS (SELECT search_id, min_by(node_id, pos) AS first, count(*) AS k FROM n GROUP BY 1)
SELECT search_id, CASE WHEN k > 1 THEN coalesce(hit, first) ELSE first END AS node_id, CASE WHEN k = 1 THEN 'only' WHEN hit IS NULL THEN 'first' ELSE 'reply' END AS by FROM f LEFT JOIN h USING (search_id)""")
def y17_chosen(spark, d):
    """Each customer's orders are nodes; a reply for each tells the node in one of two forms, or nothing."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    nodes = table(spark, d, "orders").select(F.col("o_custkey").alias("search_id"), F.col("o_orderkey").alias("node_id"), place.alias("pos"))
    said = F.when(F.col("node_id") % 3 > 0, "none of them").when(F.col("node_id") % 2 == 0, F.concat(F.lit("<node_id>: "), "node_id")).otherwise(F.concat(F.lit("I take "), "node_id", F.lit(" of 9")))
    return feedback.chosen(nodes, nodes.select("search_id", F.col("pos").alias("attempt"), said.alias("reply")))


_N = "SELECT block_id AS node_id, parent_id, CASE WHEN block_id % 3 = 1 THEN 'Finish' WHEN block_id % 3 = 2 THEN 'ViewCode' END AS action, content AS args, CASE WHEN block_id % 4 = 1 THEN content END AS observation, block_id % 100 AS reward, 'e' || block_id AS explanation, CASE WHEN block_id % 6 = 4 OR block_id % 100 = 0 THEN 'f' || block_id END AS feedback FROM b"


def _nodes(spark, d) -> DataFrame:
    return _blocks(spark, d).selectExpr(*_split(_N.removeprefix("SELECT ").removesuffix(" FROM b")))


@query(f"""
WITH {_P}, n AS ({_N}), r AS (SELECT node_id, max_by(ancestor_id, distance) AS root_id FROM p GROUP BY 1),
s AS (SELECT p.node_id AS solution_id, max_by(feedback, distance) AS feedback FROM p JOIN n ON n.node_id = p.ancestor_id WHERE feedback IS NOT NULL GROUP BY 1),
e AS (SELECT node_id AS solution_id, root_id, reward, explanation FROM n JOIN r USING (node_id) WHERE action = 'Finish' AND node_id NOT IN (SELECT parent_id FROM n WHERE parent_id IS NOT NULL))
SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY solution_id) AS attempt, solution_id, reward, explanation, feedback FROM r JOIN e USING (root_id) LEFT JOIN s USING (solution_id) WHERE solution_id < node_id""")
def y23_previous_attempts(spark, d):
    nodes = _nodes(spark, d)
    paths = tree.closure(nodes.select("node_id", "parent_id"))
    return feedback.previous_attempts(nodes, paths)


@query(f"""
WITH {_B}, n AS ({_N}), k AS (SELECT parent_id, list(node_id ORDER BY node_id) AS kids FROM n WHERE parent_id IS NOT NULL GROUP BY 1),
a AS (SELECT parent_id, list({{'id': node_id, 'said': '<attempt_' || node_id || '>' || chr(10) || 'Action: ' || action || '(' || args || ')' || CASE WHEN observation IS NULL THEN '' ELSE chr(10) || 'Observation:' || chr(10) || observation END || chr(10) || '</attempt_' || node_id || '>', 'done': action = 'Finish'}} ORDER BY node_id) AS did FROM n WHERE parent_id IS NOT NULL AND action IS NOT NULL GROUP BY 1)
SELECT n.node_id, 'Current node: ' || n.node_id || chr(10) || 'Parent node: ' || n.parent_id || chr(10) || 'Sibling nodes: [' || array_to_string(list_filter(k.kids, lambda x: x <> n.node_id), ', ') || ']' || chr(10) || 'Child nodes: [' || coalesce(array_to_string(c.kids, ', '), '') || ']' AS relations,
  coalesce(array_to_string(list_transform(list_filter(did, lambda x: x.id <> n.node_id), lambda x: x.said), chr(10) || chr(10)), '') AS attempts, coalesce(len(list_filter(did, lambda x: x.id <> n.node_id AND x.done)) > 0, false) AS finished
FROM n JOIN k USING (parent_id) LEFT JOIN k c ON c.parent_id = n.node_id LEFT JOIN a ON a.parent_id = n.parent_id""")
def y33_analyses(spark, d):
    return feedback.analyses(_nodes(spark, d))


@query("SELECT p_brand AS action, min(p_size - 25) AS min_reward, max(p_size) AS max_reward FROM part GROUP BY 1")
def f25_reward_range(spark, d):
    scales = table(spark, d, "part").select(F.col("p_brand").alias("action"), (F.col("p_size") - 25).alias("min_value"), F.col("p_size").alias("max_value"))
    return feedback.reward_range(scales, "action")


@query(f"""
WITH {_P}, n AS ({_N}), s AS (SELECT p.node_id, n.*, distance FROM p JOIN n ON n.node_id = p.ancestor_id WHERE distance > 0)
SELECT node_id, string_agg('Thought: ' || coalesce(feedback, '') || chr(10) || 'Action: ' || coalesce(action, '') || chr(10) || 'Action Input: ' || args || chr(10) || 'Observation: ' || coalesce(observation, ''), chr(10) ORDER BY distance DESC) AS react,
  string_agg(coalesce(action, '') || '(' || args || ')', chr(10) ORDER BY distance DESC) AS compact FROM s GROUP BY 1""")
def x06_messages(spark, d):
    nodes = _nodes(spark, d).withColumnRenamed("feedback", "thoughts")
    paths = tree.closure(nodes.select("node_id", "parent_id"))
    react, compact = (context.messages(nodes, paths, s).withColumnRenamed("history", s) for s in ("react", "compact"))
    return react.join(compact, "node_id")


@query(f"""
WITH {_P}, r AS (SELECT block_id, 's' || (block_id % 4) AS name FROM b),
f AS (SELECT r.block_id, r.name, c.block_id AS target_id, row_number() OVER (PARTITION BY r.block_id, r.name ORDER BY distance, c.block_id) AS n FROM r JOIN p ON p.node_id = r.block_id JOIN b c ON c.parent_id = p.ancestor_id AND c.identifier = r.name)
SELECT block_id, name, target_id FROM f WHERE n = 1""")
def r20_in_scope(spark, d):
    b = _blocks(spark, d)
    wanted = b.select("block_id", F.concat(F.lit("s"), F.col("block_id") % 4).alias("name"))
    return relations.in_scope(wanted, b.select("block_id", "parent_id", "identifier"), _paths(b)).select("block_id", "name", "target_id")
