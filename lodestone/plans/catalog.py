"""The registered queries of the engine: each operator over whole driver tables, and DuckDB SQL for the same rows.

Table roles: embeddings are chunk vectors, documents and benchmark are texts and needles, pages.url are file paths,
conversations are histories and (turn - 1) parent chains, labels.quality is a judgement, events a usage log, part and
nation are entities that templates name. Search queries ask with every row whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates, budgets, dedup, evaluation, predicates, relations, templates, tree, vectors
from ..session import small
from ..sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def asked(e: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Vector retrieval, a label filter after the rank, and a prefix budget of the texts' characters."""
    e = table(spark, d, "embeddings")
    hits = vectors.filtered(vectors.topk(e, asked(e), 100), e.select("vec_id", "label"), "label <> 0")
    rows = hits.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("n_chars").alias("tokens")), "vec_id")
    return budgets.prefix(rows, ["query_id"], ["rank"], 20_000).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), "tokens", "total")


_L2 = "SELECT q.vec_id AS query_id, e.vec_id, round(pow(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 2), 9) AS d FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM ({_L2})"

ORACLES["flagship"] = f"""
SELECT query_id, vec_id, rank, tokens, CAST(total AS BIGINT) AS total FROM (
  SELECT r.*, n_chars AS tokens, sum(n_chars) OVER (PARTITION BY query_id ORDER BY rank) AS total
  FROM ({_RANKED}) r JOIN embeddings e USING (vec_id) JOIN documents ON doc_id = vec_id WHERE rank <= 100 AND label <> 0)
WHERE total <= 20000"""
QUERIES["flagship"] = flagship


@query(f"SELECT query_id, vec_id, rank, round(d, 6) AS score FROM ({_RANKED}) WHERE rank <= 10")
def v02_topk_l2(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.topk(e, asked(e), 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("""
SELECT query_id, vec_id, rank, round(s, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id DESC) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS s
    FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE rank <= 5""")
def v06_topk_cosine(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.topk(e, asked(e), 5, metric="cosine").select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"SELECT query_id, r.vec_id, rank, label FROM ({_RANKED}) r JOIN embeddings USING (vec_id) WHERE rank <= 500 AND label IN (1, 3, 5)")
def v04_filter_after_rank(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.filtered(vectors.topk(e, asked(e), 500), e.select("vec_id", "label"), "label in (1, 3, 5)").select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), "label")


@query(f"SELECT label, vec_id, round(d, 6) AS score FROM (SELECT label, r.vec_id, d, row_number() OVER (PARTITION BY label ORDER BY d, r.vec_id, query_id) AS n FROM ({_RANKED}) r JOIN embeddings USING (vec_id) WHERE rank <= 50 AND query_id <> r.vec_id) WHERE n = 1")
def v12_best_of_each_label(spark, d):
    e = table(spark, d, "embeddings")
    hits = vectors.topk(e, asked(e), 50).where("query_id <> vec_id").join(e.select("vec_id", "label"), "vec_id")
    best = hits.groupBy("label").agg(F.min(F.struct(F.round("score", 9).alias("s"), "vec_id", "query_id")).alias("b"))
    return best.select("label", "b.vec_id", F.round("b.s", 6).alias("score"))


_FILE = "CASE page_id % 6 WHEN 0 THEN 'setup.py' WHEN 1 THEN 'pkg/setup.py' WHEN 2 THEN 'src/a/t' || page_id || '.py' WHEN 3 THEN 'x/src/a/t' || page_id || '.py' WHEN 4 THEN 'a/de/' || page_id || '.html' ELSE 'a/b.htm' END"


@query(f"SELECT page_id, path, regexp_matches(path, '^([^/]+/)*setup\\.py$') AS plain, regexp_matches(path, '^src/([^/]+/)*t[^/]*\\.py$') AS anchored, regexp_matches(path, '(^|/)de/[^/]*$') OR path LIKE '%.html' AS either FROM (SELECT page_id, {_FILE} AS path FROM pages)")
def p02_globs(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.expr(_FILE).alias("path"))
    hit = lambda *globs: predicates.matches_any(F.col("path"), list(globs))
    return rows.select("page_id", "path", hit("setup.py").alias("plain"), hit("src/**/t*.py").alias("anchored"), hit("**.html", "de/*").alias("either"))


@query(r"SELECT page_id, regexp_matches(p, '(^|/)testing(/|$)') OR (regexp_matches(p, '(^|/)((unit)?tests?_[^/]*\.py|[^/]*_test\.py|tests?\.py)$') AND NOT regexp_matches(p, '(^|/)unittests_[^/]*\.py$')) AS is_test FROM (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'a/testing/x.py' WHEN 1 THEN 'tests/x' || page_id || '.py' WHEN 5 THEN 'a/unittest_' || page_id || '.py' WHEN 6 THEN 'tests_' || page_id || '.py' WHEN 7 THEN 'a/XTest.java' WHEN 2 THEN 'x' || page_id || '_test.py' WHEN 3 THEN 'test_' || page_id || '.py' ELSE split_part(url, '/', 4) || '.py' END AS p FROM pages)")
def p05_is_test(spark, d):
    p = F.expr("CASE page_id % 8 WHEN 0 THEN 'a/testing/x.py' WHEN 1 THEN 'tests/x' || page_id || '.py' WHEN 5 THEN 'a/unittest_' || page_id || '.py' WHEN 6 THEN 'tests_' || page_id || '.py' WHEN 7 THEN 'a/XTest.java' WHEN 2 THEN 'x' || page_id || '_test.py' WHEN 3 THEN 'test_' || page_id || '.py' ELSE split_part(url, '/', 4) || '.py' END")
    return table(spark, d, "pages").select("page_id", predicates.is_test(p).alias("is_test"))


_SQUEEZE = "replace(replace(replace({}, ' ', ''), chr(9), ''), chr(10), '')"


@query(f"SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains({_SQUEEZE.format('d.text')}, {_SQUEEZE.format('b.text')})")
def p08_contains_compact(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.compact(F.col("text")).alias("t"))
    needles = table(spark, d, "benchmark").select("item_id", T.compact(F.col("text")).alias("needle"))
    return docs.join(small(needles), F.contains("t", F.col("needle"))).select("doc_id", "item_id")


@query("""
SELECT doc_id, item_id, line, content FROM (
  SELECT doc_id, item_id, needle, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line
  FROM documents, (SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS needle FROM benchmark) WHERE contains(text, needle))
WHERE contains(content, needle)""")
def p09_line_search(spark, d):
    needles = table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("needle"))
    return predicates.line_search(table(spark, d, "documents").select("doc_id", "text"), needles).select("doc_id", "item_id", "line", "content")


@query("SELECT doc_id, quality FROM labels WHERE quality >= 1")
def p12_quality_threshold(spark, d):
    return predicates.quality(table(spark, d, "labels"), 1, "quality").select("doc_id", "quality")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
c AS (SELECT *, length(content) < 200 AS is_comment FROM l),
b AS (SELECT *, sum(CASE WHEN is_comment THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS block, is_comment AND regexp_matches(content, '(?i)copyright|license|author') AS bad FROM c),
s AS (SELECT *, max(bad::INT) OVER (PARTITION BY doc_id, block ORDER BY line ROWS UNBOUNDED PRECEDING) AS sticky FROM b)
SELECT doc_id, line FROM s WHERE NOT (is_comment AND sticky = 1)""")
def p14_without_licences(spark, d):
    rows = predicates.lines(table(spark, d, "documents").select("doc_id", "text")).withColumn("is_comment", F.length("content") < 200)
    return predicates.without_licences(rows, ["doc_id"], "line").select("doc_id", "line")


@query("SELECT doc_id, split_part(text, '.', 1) AS sentence FROM documents")
def p17_first_sentence(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


_NORMAL = r"regexp_replace(trim(lower(text)), '[^\p{L}\p{N}\s]', '', 'g')"


@query(f"SELECT min(doc_id) AS doc_id, max_by(text, doc_id) AS text FROM documents GROUP BY {_NORMAL}")
def d01_dedup_by_text(spark, d):
    return dedup.by_text(table(spark, d, "documents").select("doc_id", "text"), pos="doc_id")


@query("SELECT doc_id, content_hash FROM (SELECT doc_id, sha256(lower(regexp_replace(text, '\\s+', '', 'g'))) AS content_hash FROM documents)")
def d03_content_hash(spark, d):
    return dedup.content_keys(table(spark, d, "documents")).select("doc_id", "content_hash")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_linenumber, l_shipdate, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def d02_dedup_by_items(spark, d):
    rows = table(spark, d, "lineitem").withColumn("items", F.array(F.col("l_orderkey") * -1, "l_partkey", "l_suppkey")).withColumn("pos", F.struct("l_linenumber", "l_shipdate", "l_extendedprice"))
    return dedup.by_items(rows).select("l_orderkey", "l_partkey", "l_suppkey")


@query("""
WITH old AS (SELECT doc_id, md5(text) AS h FROM documents),
new AS (SELECT doc_id, md5(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'fr' UNION ALL SELECT -1 - item_id, md5(text) FROM benchmark)
SELECT doc_id, CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'delete' ELSE 'update' END AS action
FROM old o FULL JOIN new n USING (doc_id) WHERE o.h IS DISTINCT FROM n.h""")
def d04_ingestion(spark, d):
    """A new version of the corpus: German texts edited, French ones gone, the benchmark's items added."""
    docs = table(spark, d, "documents")
    edited = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    kept = docs.where("lang <> 'fr'").select("doc_id", F.md5(edited).alias("hash"))
    added = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.md5("text").alias("hash"))
    return dedup.ingestion(docs.select("doc_id", F.md5("text").alias("hash")), kept.union(added))


@query("""
WITH w AS (SELECT item_id, list_distinct(string_split(text, ' ')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 6) AS jaccard FROM w a, w b WHERE a.item_id < b.item_id""")
def d06_jaccard(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    pairs = w.select(F.col("item_id").alias("a"), F.col("w").alias("x")).join(small(w.select(F.col("item_id").alias("b"), F.col("w").alias("y"))), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(dedup.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


_TOKENS = r"list_filter(string_split_regex(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the'))"


@query(f"""
WITH p AS (SELECT u.conv_id, u.turn, {_TOKENS.format('u.text')} AS p, {_TOKENS.format('v.text')} AS t
  FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1 WHERE u.role = 'user'),
a AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS w FROM p) GROUP BY ALL),
b AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(t) AS w FROM p) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(least(a.n, b.n)) AS same FROM a JOIN b USING (conv_id, turn, w) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN coalesce(same, 0) = 0 OR (array_to_string(p, ' ') <> array_to_string(t, ' ') AND (array_to_string(p, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(t, ' ') IN ('yes', 'no', 'noanswer'))) THEN 0 ELSE 2.0 * same / (len(p) + len(t)) END, 6) AS f1
FROM p LEFT JOIN s USING (conv_id, turn)""")
def f03_token_f1(spark, d):
    c = table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    pairs = c.where("role = 'user'").select("conv_id", "turn", "text").join(after, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(T.token_f1(F.col("text"), F.col("truth"))["f1"], 6).alias("f1"))


@query(f"SELECT conv_id, turn, array_to_string({_TOKENS.format('text')}, ' ') AS answer FROM conversations")
def f01_normalized_answer(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.normalized_answer(F.col("text")).alias("answer"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def f05_json_reply(spark, d):
    reply = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))
    return table(spark, d, "events").select("event_id", T.parsed_reply(reply, "k int")["k"].alias("k"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS score, CASE event_id % 4 WHEN 2 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS node FROM events")
def f10_integer_for(spark, d):
    """Replies with the keyword in three forms, the third by a node's number, and with a number but without the keyword."""
    k = F.get_json_object("props", "$.k")
    forms = [F.concat(F.lit("After 12 steps: <score>: "), k), F.concat(F.lit("**Score:** "), k, F.lit(" of 100")), F.concat(F.lit("Score: node "), k), F.concat(F.lit("I saw "), k, F.lit(" files, no verdict"))]
    reply = F.element_at(F.array(*forms), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.integer_for(reply, "score").alias("score"), T.node_id(reply).alias("node"))


@query("SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%02dh:', s // 3600) ELSE '' END || CASE WHEN s >= 60 THEN printf('%02dm:', s % 3600 // 60) ELSE '' END || printf('%02ds', s % 60) AS took FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) // CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 10000 END AS s FROM orders)")
def f12_duration(spark, d):
    seconds = F.expr("cast(floor(o_totalprice) as bigint) div CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 10000 END")
    return table(spark, d, "orders").select("o_orderkey", T.duration(seconds).alias("took"))


@query("SELECT event_id, 'call_' || substr(sha256(event_type || props), 1, 8) AS id FROM events")
def f13_call_id(spark, d):
    return table(spark, d, "events").select("event_id", T.call_id(F.col("event_type"), F.col("props")).alias("id"))


_SCORES = "SELECT o_orderkey, CAST(o_orderkey % 5 AS DOUBLE) AS rag, CAST(o_custkey % 5 AS DOUBLE) AS decompose, CAST(length(o_orderpriority) % 5 AS DOUBLE) AS tree FROM orders"


def _scores(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *[x.cast("double").alias(n) for n, x in (("rag", F.col("o_orderkey") % 5), ("decompose", F.col("o_custkey") % 5), ("tree", F.length("o_orderpriority") % 5))])


@query(f"SELECT o_orderkey, CASE WHEN rag > decompose AND rag > tree THEN 'rag' WHEN decompose > rag AND decompose > tree THEN 'decompose' ELSE 'tree' END AS chosen FROM ({_SCORES})")
def e04_best_of_three(spark, d):
    return _scores(spark, d).select("o_orderkey", evaluation.best_of_three(F.col("rag"), F.col("decompose"), F.col("tree")).alias("chosen"))


@query(f"SELECT o_orderkey, CASE WHEN rag = greatest(rag, decompose, tree) THEN 0 WHEN decompose = greatest(rag, decompose, tree) THEN 1 ELSE 2 END AS picked FROM ({_SCORES})")
def q05_pick(spark, d):
    return _scores(spark, d).select("o_orderkey", evaluation.picked(F.col("rag"), F.col("decompose"), F.col("tree")).alias("picked"))


@query(f"SELECT round(avg(rag), 6) AS avg_rag, round(avg(decompose), 6) AS avg_decompose, round(avg(tree), 6) AS avg_tree, count(*) FILTER (c = 'rag') AS n_rag, count(*) FILTER (c = 'decompose') AS n_decompose, count(*) FILTER (c = 'tree') AS n_tree FROM (SELECT *, CASE WHEN rag > decompose AND rag > tree THEN 'rag' WHEN decompose > rag AND decompose > tree THEN 'decompose' ELSE 'tree' END AS c FROM ({_SCORES}))")
def a04_selection_report(spark, d):
    rows = _scores(spark, d).withColumn("chosen", evaluation.best_of_three(F.col("rag"), F.col("decompose"), F.col("tree")))
    out = aggregates.selection_report(rows)
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("avg") else c for c in out.columns])


@query("""
SELECT lang AS type, tag, count(*) AS n FROM (SELECT lang, unnest(list_transform(regexp_extract_all(q, '`<([^>]+)>`', 1), lambda t: CASE WHEN t IN ('Parameter', 'Object') THEN 'Undirect' ELSE t END)) AS tag FROM (
  SELECT lang, 'What is `<' || ['Class', 'Method', 'Parameter', 'Object'][doc_id % 4 + 1] || '>` in `<' || ['Module', 'Class'][doc_id % 2 + 1] || '>`?' AS q FROM documents)) GROUP BY ALL""")
def a01_tag_counts(spark, d):
    q = F.expr("'What is `<' || element_at(array('Class', 'Method', 'Parameter', 'Object'), int(doc_id % 4 + 1)) || '>` in `<' || element_at(array('Module', 'Class'), int(doc_id % 2 + 1)) || '>`?'")
    return aggregates.tag_counts(table(spark, d, "documents").select("lang", q.alias("question")), kind="lang")


@query("SELECT lang AS type, source AS tag, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY CUBE (lang, source)")
def a02_totals(spark, d):
    return aggregates.with_totals(table(spark, d, "documents").groupBy(F.col("lang").alias("type"), F.col("source").alias("tag")).agg(F.count("*").alias("n")))


@query()
def a01_crosstab(spark, d):
    counts = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("type"), F.col("event_type").alias("tag")).agg(F.count("*").alias("n"))
    return aggregates.crosstab(counts, ["click", "error", "purchase", "view"])


ORACLES["a01_crosstab"] = "SELECT user_id % 10 AS type, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "view")) + " FROM events GROUP BY ALL"


@query("SELECT count(*) AS n, round(avg(quality), 6) AS avg_quality, round(avg(toxic), 6) AS avg_toxic FROM labels")
def a03_mean_scores(spark, d):
    out = aggregates.mean_scores(table(spark, d, "labels"), "quality", "toxic")
    return out.select("n", F.round("avg_quality", 6).alias("avg_quality"), F.round("avg_toxic", 6).alias("avg_toxic"))


@query("SELECT count(*) AS total, round(coalesce(avg(quality), 0), 6) AS average FROM labels")
def a05_report(spark, d):
    return aggregates.report(table(spark, d, "labels"), "quality").select("total", F.round("average", 6).alias("average"))


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey), 4) AS file_tokens FROM lineitem")
def a08_file_tokens(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_path"), "l_linenumber", F.col("l_quantity").alias("tokens"))
    return aggregates.file_tokens(rows).select(F.col("file_path").alias("l_orderkey"), "l_linenumber", F.round("file_tokens", 4).alias("file_tokens"))


@query("SELECT event_type, count(*) AS calls, round(sum(coalesce(value, 0)), 2) AS cost, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS prompt_tokens FROM events GROUP BY event_type")
def a09_usage(spark, d):
    rows = table(spark, d, "events").select("event_type", F.col("value").alias("cost"), F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"), F.lit(0).alias("cached_tokens"))
    return aggregates.usage(rows, ["event_type"]).select("event_type", "calls", F.round("cost", 2).alias("cost"), "prompt_tokens")


@query("SELECT r_name AS name, list(n_name ORDER BY n_nationkey) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def a14_children(spark, d):
    items = table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"))
    out = aggregates.children(table(spark, d, "region"), items, "r_regionkey", ["name"], "nations")
    return out.select(F.col("r_name").alias("name"), F.transform("nations", lambda x: x["name"]).alias("nations"))


@query("SELECT o_orderkey AS file_path, list_sort(list_distinct(list(l_partkey::VARCHAR))) AS span_ids FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def a16_spans_by_file(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return aggregates.spans_by_file(rows.select(F.col("o_orderkey").alias("file_path"), F.col("l_partkey").cast("string").alias("span_id")))


@query("SELECT source, CAST(floor((n - 1) / 10) AS BIGINT) AS batch, count(*) AS n, string_agg(lang || ':' || doc_id, chr(10) ORDER BY n) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) GROUP BY ALL")
def a19_in_groups(spark, d):
    return aggregates.in_groups(table(spark, d, "documents").select("source", "doc_id", "lang"), F.concat_ws(":", "lang", "doc_id"), ["doc_id"], by=["source"])


@query("SELECT doc_id, len(list_filter(l, lambda x: starts_with(x, 'T'))) AS additions, len(list_filter(l, lambda x: starts_with(x, 'I'))) AS deletions FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def a20_patch_size(spark, d):
    diff = F.regexp_replace(F.regexp_replace("text", "(?m)^([+-])", " $1"), "(?m)^T", "+T")
    diff = F.regexp_replace(diff, "(?m)^I", "-I")
    return aggregates.patch_size(table(spark, d, "documents").select("doc_id", diff.alias("patch"))).select("doc_id", "additions", "deletions")


@query("SELECT user_id, count(*) AS methods FROM events WHERE event_type = 'click' GROUP BY user_id ORDER BY methods DESC, user_id::VARCHAR LIMIT 5")
def a22_largest(spark, d):
    rows = table(spark, d, "events").where("event_type = 'click'").select(F.lit(True).alias("is_method"), F.col("user_id").cast("string").alias("class_name"))
    return aggregates.largest_classes(rows).select(F.col("class_name").cast("long").alias("user_id"), "methods")


@query("SELECT user_id, event_id, total FROM (SELECT user_id, event_id, CAST(sum(k) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS total FROM (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)) WHERE total <= 500")
def w02_prefix_budget(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return budgets.prefix(rows, ["user_id"], ["event_id"], 500).select("user_id", "event_id", "total")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events),
w AS (SELECT user_id, event_id, n, CASE WHEN k <= 500 THEN k ELSE 0 END AS total, k <= 500 AS kept FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN w.total + k <= 500 THEN w.total + k ELSE w.total END, w.total + k <= 500 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id FROM w WHERE kept""")
def w03_greedy_budget(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return budgets.greedy(rows, ["user_id"], ["event_id"], 500).select("user_id", F.explode("rows").alias("r")).select("user_id", "r.event_id")


@query("SELECT user_id, event_id, CASE WHEN r = 0 THEN i ELSE i || '_' || t END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS t, row_number() OVER (PARTITION BY user_id, event_type, i ORDER BY event_id) - 1 AS r FROM (SELECT *, 'f' || (event_id % 3) AS i FROM events))")
def w04_unique_ids(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("type"), F.concat(F.lit("f"), F.col("event_id") % 3).alias("identifier"))
    return budgets.unique_ids(rows, ["user_id"], "event_id").select("user_id", "event_id", "unique_id")


@query("SELECT user_id AS file, event_id, CASE WHEN n = 1 THEN event_type ELSE event_type || ':' || n END AS span_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)")
def w05_span_ids(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("file"), "event_id", F.col("event_type").alias("base_id"))
    return budgets.span_ids(rows, "event_id").select("file", "event_id", "span_id")


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def _k():
    return F.get_json_object("props", "$.k").cast("long")


@query(f"SELECT user_id AS file, event_id AS ord, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next, CAST(coalesce(sum({_K}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tokens_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def w10_neighbours(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("ord"), _k().alias("tokens"))
    return budgets.neighbours(rows).select("file", "ord", "previous", "next", "tokens_before")


@query(f"""
WITH h AS (SELECT user_id AS search_id, event_id % 20 AS file_path, event_id AS rank, event_id % 50 AS start_line, event_id % 50 + 30 AS end_line, sum({_K}) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events),
c AS (SELECT p_partkey % 20 AS file_path, min(p_size) AS low, min(p_size) + 5 AS high FROM part GROUP BY 1)
SELECT search_id, file_path, low, high, min(rank) AS rank, CAST(min_by(t, rank) AS BIGINT) AS context_tokens FROM h JOIN c USING (file_path) WHERE start_line - 1 <= low AND end_line + 1 >= high GROUP BY ALL""")
def r12_covered_changes(spark, d):
    hits = table(spark, d, "events").select(F.col("user_id").alias("search_id"), (F.col("event_id") % 20).alias("file_path"), F.col("event_id").alias("span_id"), F.col("event_id").alias("rank"), (F.col("event_id") % 50).alias("start_line"), (F.col("event_id") % 50 + 30).alias("end_line"), _k().alias("tokens"))
    changes = table(spark, d, "part").groupBy((F.col("p_partkey") % 20).alias("file_path")).agg(F.min("p_size").alias("low"), (F.min("p_size") + 5).alias("high"))
    return budgets.covered_changes(hits, changes).select("search_id", "file_path", "low", "high", "rank", "context_tokens")


@query("SELECT 'function' AS source_type, event_type AS source_id, 'function' AS target_type, e.n_name AS target_id, 'calls' AS relationship_type FROM (SELECT event_type, 'NATION_' || (user_id % 40) AS n_name FROM events) e SEMI JOIN nation USING (n_name)")
def r02_calls(spark, d):
    made = table(spark, d, "events").select(F.col("event_type").alias("name"), F.array(F.concat(F.lit("NATION_"), F.col("user_id") % 40)).alias("calls"))
    known = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.array().cast("array<string>").alias("calls"))
    calls = relations.calls(made.union(known))
    return calls.where("target_id like 'NATION%'")


@query(r"SELECT n AS variable, doc_id AS function FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents) JOIN (SELECT DISTINCT regexp_extract(text, '[\p{L}\p{N}_]+') AS n FROM benchmark) ON w = n")
def r05_variable_users(spark, d):
    names = table(spark, d, "benchmark").select(F.regexp_extract("text", r"[\p{L}\p{N}_]+", 0).alias("name")).distinct()
    code = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("name"), F.col("text").alias("code"))
    return relations.variable_users(names, code)


@query("SELECT o_orderkey, c_custkey AS class_pos FROM orders JOIN (SELECT c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) ON c_mktsegment = CASE o_orderkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END")
def r06_first_owner(spark, d):
    methods = table(spark, d, "orders").select("o_orderkey", F.expr("CASE o_orderkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END").alias("class_name"))
    classes = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("f").alias("file"), F.col("c_custkey").alias("pos"))
    return relations.owners(methods, classes).select("o_orderkey", "class_pos")


@query("SELECT p_brand AS name, list_sort(list_distinct(list({'file_path': p_type, 'block_path': p_name}))) AS places FROM part GROUP BY p_brand")
def r07_name_index(spark, d):
    return relations.name_index(table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("file_path"), F.col("p_name").alias("block_path")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def r08_include_exclude(spark, d):
    hits = table(spark, d, "lineitem").withColumn("file_path", F.col("l_partkey"))
    kept = relations.included(hits, table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("file_path")))
    bad = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("file_path"))
    return relations.excluded(kept.withColumn("file_path", F.col("l_suppkey")), bad).select("l_orderkey", "l_linenumber")


@query("""
WITH b AS (SELECT o_custkey AS file_path, o_orderkey AS block_id, o_orderkey % 1000 AS start_line, o_orderkey % 1000 + 20 AS end_line FROM orders),
r AS (SELECT c_custkey AS file_path, 400 + c_nationkey AS low, 420 + c_nationkey AS high FROM customer),
h AS (SELECT * FROM b JOIN r USING (file_path) WHERE NOT (end_line < low OR start_line > high)),
m AS (SELECT *, row_number() OVER (PARTITION BY file_path, low, high ORDER BY end_line DESC, start_line DESC) AS n FROM b JOIN r USING (file_path) WHERE end_line < low AND (file_path, low, high) NOT IN (SELECT (file_path, low, high) FROM h))
SELECT file_path, low, high, start_line, end_line FROM h UNION ALL SELECT file_path, low, high, start_line, end_line FROM m WHERE n = 1""")
def r11_blocks_in_lines(spark, d):
    blocks = table(spark, d, "orders").selectExpr("o_custkey as file_path", "o_orderkey as block_id", "o_orderkey % 1000 as start_line", "o_orderkey % 1000 + 20 as end_line")
    ranges = table(spark, d, "customer").selectExpr("c_custkey as file_path", "400 + c_nationkey as low", "420 + c_nationkey as high")
    return relations.blocks_in_lines(blocks, ranges).select("file_path", "low", "high", "start_line", "end_line")


_TREE = "SELECT conv_id * 1000 + turn AS node_id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id, turn, role, text FROM conversations"
_PATHS = f"RECURSIVE n AS ({_TREE}), p AS (SELECT node_id, node_id AS ancestor_id, parent_id AS up, 0 AS distance FROM n UNION ALL SELECT p.node_id, n.node_id, n.parent_id, distance + 1 FROM p JOIN n ON n.node_id = p.up)"


def _tree(spark, d):
    return table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn as node_id", "case when turn > 0 then conv_id * 1000 + turn - 1 end as parent_id", "turn", "role", "text")


@query(f"WITH {_PATHS} SELECT node_id, ancestor_id, distance FROM p")
def g01_ancestors(spark, d):
    return tree.closure(_tree(spark, d))


@query(f"SELECT node_id FROM ({_TREE}) WHERE node_id NOT IN (SELECT parent_id FROM ({_TREE}) WHERE parent_id IS NOT NULL)")
def g02_leaves(spark, d):
    return tree.leaves(_tree(spark, d)).select("node_id")


@query(f"WITH {_PATHS}, r AS (SELECT node_id, length(text) % 100 AS reward FROM n WHERE role <> 'system'), b AS (SELECT ancestor_id AS node_id, count(*) AS visits, sum(reward) AS value FROM p JOIN r USING (node_id) GROUP BY 1) SELECT node_id, coalesce(visits, 0) AS visits, CAST(coalesce(value, 0) AS BIGINT) AS value FROM n LEFT JOIN b USING (node_id)")
def a13_backpropagation(spark, d):
    nodes = _tree(spark, d).withColumn("reward", F.when(F.col("role") != "system", F.length("text") % 100))
    return tree.backpropagated(nodes, tree.closure(nodes)).select("node_id", "visits", "value")


@query(f"WITH {_PATHS}, r AS (SELECT node_id AS ancestor_id, CASE WHEN turn % 3 > 0 THEN (length(text) % 100) / (turn % 3) ELSE 0 END AS r FROM n) SELECT node_id, round(avg(r), 6) AS mean_reward FROM p JOIN r USING (ancestor_id) GROUP BY node_id")
def a12_trajectory_means(spark, d):
    nodes = _tree(spark, d).withColumn("visits", F.col("turn") % 3).withColumn("value", F.length("text") % 100)
    return tree.trajectory_means(nodes, tree.closure(nodes)).select("node_id", F.round("mean_reward", 6).alias("mean_reward"))


@query(f"WITH {_PATHS}, t AS (SELECT p.ancestor_id AS block_id, sum(len(string_split(text, ' '))) AS tokens FROM p JOIN n USING (node_id) GROUP BY 1) SELECT block_id, CAST(tokens AS BIGINT) AS tokens FROM t")
def a06_subtree_tokens(spark, d):
    nodes = _tree(spark, d)
    return aggregates.subtree_tokens(nodes.select(F.col("node_id").alias("block_id"), F.size(F.split("text", " ")).cast("long").alias("tokens")), tree.closure(nodes))


@query(f"""
WITH {_PATHS}, x AS (SELECT n.*, turn + 1 AS visits, CAST(length(text) % 101 AS DOUBLE) AS reward FROM n),
d AS (SELECT node_id, max(distance) AS depth FROM p GROUP BY 1),
k AS (SELECT parent_id AS node_id, max(reward) AS best, count(*) AS children FROM x WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT x.node_id, round(x.reward + sqrt(ln(coalesce(y.visits, 1)) / x.visits) - 0.8 * sqrt(depth)
  + CASE WHEN children IS NULL AND x.reward >= 50 THEN 50 ELSE 0 END - CASE WHEN best >= 75 THEN 5 ELSE 0 END
  + CASE WHEN children IS NULL AND x.parent_id IS NOT NULL AND y.reward > 50 AND x.reward <= 0 THEN 50 - x.reward ELSE 0 END, 6) AS uct
FROM x LEFT JOIN x y ON y.node_id = x.parent_id JOIN d ON d.node_id = x.node_id LEFT JOIN k ON k.node_id = x.node_id""")
def g08_uct(spark, d):
    nodes = _tree(spark, d).select("node_id", "parent_id", (F.col("turn") + 1).alias("visits"), (F.length("text") % 101).cast("double").alias("reward"), F.lit(None).cast("string").alias("action"), F.lit(False).alias("is_duplicate"), F.lit(False).alias("expect_correction"), F.lit(False).alias("has_context"))
    return tree.uct(nodes, tree.closure(nodes)).select("node_id", F.round("uct", 6).alias("uct"))


@query(f"WITH {_PATHS} SELECT max(distance) AS depth FROM p")
def f26_dag_depth(spark, d):
    edges = _tree(spark, d).where("parent_id is not null").select("node_id", F.col("parent_id").alias("depends_on"))
    return tree.dag_depth(edges)


@query(f"SELECT node_id, sibling AS duplicate_of FROM (SELECT event_id AS node_id, min(event_id) OVER (PARTITION BY user_id, event_type, props) AS sibling FROM events) WHERE sibling < node_id")
def r13_duplicate_siblings(spark, d):
    nodes = table(spark, d, "events").select(F.col("event_id").alias("node_id"), F.col("user_id").alias("parent_id"), F.col("event_type").alias("action"), F.col("props").alias("args"))
    return dedup.duplicate_siblings(nodes)


_QUESTIONS = (("What is `<Class>`?", "Class"), ("Where is `<Method>` of `<Class>`?", "Class"), ("Why?", None), ("Which `<Decorator>` does `<Class>` have?", None))


@query("""
SELECT 'What' AS category, 'Class' AS rule, replace(t, '<Class>', p_name || ' ' || p_partkey) AS question
FROM part, (VALUES ('What is `<Class>`?'), ('Where is `<Method>` of `<Class>`?')) v(t)""")
def t03_questions(spark, d):
    asked_ = spark.createDataFrame([("What", t) for t, _ in _QUESTIONS], "category string, template string")
    classes = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.col("p_type").alias("code"))
    things = templates._entity(classes, "Class", Class="name")
    return templates.questions(asked_, things).select("category", "rule", "question")


@query("SELECT page_id, regexp_extract_all(html, '<([^>]+)>', 1) AS tags FROM pages")
def t01_tags(spark, d):
    return table(spark, d, "pages").select("page_id", templates.tags(F.col("html")).alias("tags"))


@query(f"""
SELECT u.conv_id, u.turn, f.form, CASE f.form WHEN 'general' THEN 'system_instruction,question,answer,context' WHEN 'llama' THEN 'system,instruction,output' ELSE 'messages' END AS keys,
  CASE f.form WHEN 'claude' THEN 'system,human,assistant' WHEN 'openai' THEN 'system,user,assistant' END AS roles, '{files.about("app")[0]}' AS system, u.text AS instruction, v.text AS output
FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1, (VALUES ('claude'), ('openai'), ('llama'), ('general')) f(form)
WHERE u.role = 'user' AND u.text <> '' AND v.text <> ''""")
def s18_training_records(spark, d):
    """Every form's records: their keys in order, roles, system message, question and answer."""
    c = table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(after, ["conv_id", "turn"])
    out = None
    for form in files.FORMS[:-1]:
        lines = pairs.select("conv_id", "turn", "question", "answer")
        value = files.training_value(form, "app")
        rows = lines.where("question <> '' and answer <> ''").select("conv_id", "turn", F.lit(form).alias("form"), value.alias("value"))
        m = F.from_json("value", "messages array<struct<role:string,content:string>>")["messages"]
        said = lambda i: F.get(m, F.lit(i))["content"]
        key = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
        rows = rows.select(
            "conv_id", "turn", "form", F.array_join(F.json_object_keys("value"), ",").alias("keys"), F.when(m.isNotNull(), F.array_join(F.transform(m, lambda x: x["role"]), ",")).alias("roles"),
            F.coalesce(said(0), key("system", "system_instruction")).alias("system"), F.coalesce(said(1), key("instruction", "question")).alias("instruction"), F.coalesce(said(2), key("output", "answer")).alias("output"),
        )
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS code FROM documents")
def s20_clipped(spark, d):
    return table(spark, d, "documents").select("doc_id", files.clipped(F.col("text")).alias("code"))


@query("SELECT count(*) AS files, coalesce(max(page_id) FILTER (page_id % 3 = 0), 0) + 1 AS next FROM pages")
def s25_next_number(spark, d):
    name = F.concat("page_id", F.when(F.col("page_id") % 3 == 0, F.lit(".json")).otherwise(F.lit(".log")))
    out = files.next_number(table(spark, d, "pages").select(name.alias("file_name")))
    return out.select("files", F.col("next").cast("long").alias("next"))


@query("SELECT coalesce(list_sort(list_distinct(list(f) FILTER (NOT contains(f, '/')))), []::VARCHAR[]) AS files, list_sort(list_distinct(list(split_part(f, '/', 1)) FILTER (contains(f, '/')))) AS directories FROM (SELECT regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', '') AS f FROM pages)")
def s23_listing(spark, d):
    from ..operators import retrieval

    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+/", ""), "[?#].*$", "")
    return retrieval.listing(table(spark, d, "pages").select(path.alias("file_path")))


@query(f"""
WITH h AS (SELECT user_id AS query_id, event_id AS rank, event_id % 3 AS f, event_id % 4 AS s, {_K} AS tokens FROM events),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, f, s ORDER BY rank) AS n FROM h),
w AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) - tokens AS before, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS c FROM u WHERE n = 1)
SELECT query_id, f::VARCHAR AS file_path, s::VARCHAR AS span_id, rank, tokens FROM w WHERE before <= 300 AND c <= 9""")
def v05_admitted_spans(spark, d):
    from ..operators import retrieval

    spans = F.array(F.struct((F.col("event_id") % 4).cast("string").alias("span_id"), _k().alias("tokens")))
    hits = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("rank"), (F.col("event_id") % 3).cast("string").alias("file_path"), spans.alias("spans"))
    return retrieval.admitted_spans(hits, 8, 300)


@query("SELECT l_orderkey AS query_id, count(*) AS spans, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, CASE WHEN (sum(CAST(l_quantity AS BIGINT)) > 100 AND count(*) > 1) OR count(*) > 6 THEN 'identify' WHEN sum(CAST(l_quantity AS BIGINT)) > 100 THEN 'too_large' ELSE 'ok' END AS state FROM lineitem GROUP BY 1")
def x02_budget_state(spark, d):
    from ..operators import retrieval

    return retrieval.budget_state(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_quantity").cast("long").alias("tokens")), 100, 6)


from . import relational as _relational, trees as _trees  # noqa: E402, F401
