"""Relations between code entities: equi-joins on names, with the order-dependent choices made explicit by `pos`."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settled


def file_graph(files: DataFrame) -> DataFrame:
    """(src, dst) module edges: an import's last part is another file's stem. Self-edges stay; each edge once."""
    stems = files.select(F.regexp_replace("file", r"^.*/|\.py$", "").alias("stem"), F.col("module").alias("dst"))
    imports = files.select(F.col("module").alias("src"), F.explode("imports").alias("i")).select("src", T.last_part(F.col("i")).alias("stem"))
    return imports.join(stems, "stem").select("src", "dst").distinct()


def calls(functions: DataFrame) -> DataFrame:
    """One edge for each call of a known function by its plain name; repeated calls stay, dotted calls never match."""
    made = functions.select(F.col("name").alias("source_id"), F.explode("calls").alias("target_id"))
    known = functions.select(F.col("name").alias("target_id")).distinct()
    return _edges(made.join(known, "target_id", "left_semi"), "function", "function", "calls")


def inherits(classes: DataFrame) -> DataFrame:
    """Class to base name; targets need not exist."""
    return _edges(classes.select(F.col("name").alias("source_id"), F.explode("bases").alias("target_id")), "class", "class", "inherits")


def _edges(rows: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    return rows.select(F.lit(source).alias("source_type"), "source_id", F.lit(target).alias("target_type"), "target_id", F.lit(kind).alias("relationship_type"))


def attribute_users(attributes: DataFrame, functions: DataFrame) -> DataFrame:
    """(class_name, attribute, function): a method of the class holds `self.<name>` as a substring."""
    a = attributes.select("class_name", F.col("name").alias("attribute"))
    f = functions.where("class_name is not null").select("class_name", F.col("name").alias("function"), "code")
    return a.join(f, "class_name").where(F.contains("code", F.concat(F.lit("self."), F.col("attribute")))).drop("code")


def variable_users(variables: DataFrame, functions: DataFrame) -> DataFrame:
    """(variable, function): the name is a word of the code. An equi-join on the code's words, not a pattern per pair."""
    word = F.regexp_extract_all("code", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    words = functions.select("pos", F.col("name").alias("function"), F.explode(F.array_distinct(word)).alias("variable"))
    return variables.select(F.col("name").alias("variable")).join(words, "variable").select("variable", "function")


def owners(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """Each method with the first class of its class's name, in scan order."""
    first = classes.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("file", "pos"))).where("_n = 1")
    return methods.join(first.select(F.col("name").alias("class_name"), F.col("file").alias("class_file"), F.col("pos").alias("class_pos")), "class_name")


def name_index(blocks: DataFrame) -> DataFrame:
    """name to its places, sorted."""
    return blocks.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("file_path", "block_path"))).alias("places"))


def probe(index: DataFrame, names: DataFrame) -> DataFrame:
    return index.join(names, "name")


def included(hits: DataFrame, files: DataFrame) -> DataFrame:
    return hits.join(files, "file_path", "left_semi")


def excluded(hits: DataFrame, files: DataFrame) -> DataFrame:
    return hits.join(files, "file_path", "left_anti")


def resolved_spans(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits (file_path, span_id, start_line, end_line) with their span; unknown ids fall back to spans over their lines."""
    own = spans.select("file_path", "span_id", F.col("start_line").alias("span_start"), F.col("end_line").alias("span_end"))
    by_id = hits.join(own, ["file_path", "span_id"])
    rest = hits.join(own, ["file_path", "span_id"], "left_anti").withColumnRenamed("span_id", "_asked")
    by_line = rest.join(own, "file_path").where("span_end >= start_line and span_start <= end_line").drop("_asked")
    return by_id.unionByName(by_line)


def blocks_in_lines(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks that overlap (file_path, low, high) line ranges; where none does, the last block before the range."""
    pairs = blocks.join(ranges, "file_path")
    hit = pairs.where("not (end_line < low or start_line > high)")
    missed = pairs.join(hit.select("file_path", "low", "high").distinct(), ["file_path", "low", "high"], "left_anti").where("end_line < low")
    last = missed.withColumn("_n", F.row_number().over(Window.partitionBy("file_path", "low", "high").orderBy(F.desc("end_line"), F.desc("start_line")))).where("_n = 1").drop("_n")
    return hit.unionByName(last)


def related_spans(spans: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Successors, predecessors, the parent class's init spans and the module's init span of wanted (file_path, span_id)."""
    out = wanted.join(edges.withColumnRenamed("source", "span_id"), ["file_path", "span_id"]).select("file_path", F.col("target").alias("span_id"))
    into = wanted.join(edges.withColumnRenamed("target", "span_id"), ["file_path", "span_id"]).select("file_path", F.col("source").alias("span_id"))
    mine = spans.join(wanted, ["file_path", "span_id"], "left_semi").select("file_path", "class_name").distinct()
    init = spans.where("span_type = 'init'")
    of_class = init.where("class_name is not null").join(mine, ["file_path", "class_name"], "left_semi").select("file_path", "span_id")
    of_module = init.where("class_name is null").join(mine.select("file_path").distinct(), "file_path", "left_semi").select("file_path", "span_id")
    return out.union(into).union(of_class).union(of_module).distinct().join(wanted, ["file_path", "span_id"], "left_anti")


def spread_spans(spans: DataFrame, edges: DataFrame, wanted: DataFrame, budget: int = 2000) -> DataFrame:
    """Related spans, nearest first, until the token budget of each file is used: (file_path, span_id, distance, tokens)."""
    seen = wanted.select("file_path", "span_id", F.lit(0).alias("distance"))
    front = wanted
    for k in count(1):
        front = settled(related_spans(spans, edges, front).join(seen, ["file_path", "span_id"], "left_anti"))
        if front.isEmpty():
            break
        seen = settled(seen.union(front.select("file_path", "span_id", F.lit(k))))
    rows = seen.join(spans.select("file_path", "span_id", "tokens"), ["file_path", "span_id"])
    total = F.sum("tokens").over(Window.partitionBy("file_path").orderBy("distance", "span_id"))
    return rows.withColumn("_total", total).where(F.col("_total") <= budget).drop("_total")


def in_scope(references: DataFrame, blocks: DataFrame, closure: DataFrame) -> DataFrame:
    """References (file_path, block_id, name) to the nearest block of that name among ancestors' children."""
    up = closure.select(F.col("node_id").alias("block_id"), F.col("ancestor_id").alias("parent_id"), "distance")
    found = references.join(up, "block_id").join(blocks.select("parent_id", F.col("block_id").alias("target_id"), F.col("identifier").alias("name")), ["parent_id", "name"])
    nearest = F.row_number().over(Window.partitionBy("block_id", "name").orderBy("distance", "target_id"))
    return found.withColumn("_n", nearest).where("_n = 1").drop("_n")


def test_files(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Each source file's test file: `test_<base>`; of several the one with the longest common start of folders."""
    s = sources.select("file_path", F.concat(F.lit("test_"), F.regexp_replace("file_path", "^.*/", "")).alias("base"), F.regexp_replace("file_path", "[^/]*$", "").alias("_d"))
    t = files.select(F.col("file_path").alias("test_path"), F.regexp_replace("file_path", "^.*/", "").alias("base"), F.regexp_replace("file_path", "[^/]*$", "").alias("_t"))
    shared = F.aggregate(F.sequence(F.lit(0), F.least(F.length("_d"), F.length("_t"))), F.lit(0), lambda a, i: F.when(F.left("_d", i) == F.left("_t", i), i).otherwise(a))
    rows = s.join(t, "base").withColumn("_n", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc(shared), "test_path")))
    return rows.where("_n = 1").select("file_path", "test_path")
