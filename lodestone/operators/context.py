"""A node's file context: spans it has, in order, some pinned; histories built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["node_id", "file_path", "span_id"]


def added(context: DataFrame, new: DataFrame, spans: DataFrame) -> DataFrame:
    """The context with new (node_id, file_path, span_id) spans, their class's init span and the file's pinned imports."""
    mine = new.join(spans.select("file_path", "span_id", "class_name", "tokens"), ["file_path", "span_id"])
    init = spans.where("span_type = 'init'").select("file_path", F.col("span_id").alias("_init"), "class_name", F.col("tokens").alias("_tokens"))
    of_class = mine.where("class_name is not null").drop("span_id", "tokens").join(init.where("class_name is not null"), ["file_path", "class_name"]).select("node_id", "file_path", F.col("_init").alias("span_id"), F.lit(False).alias("pinned"), F.col("_tokens").alias("tokens"))
    imports = mine.select("node_id", "file_path").distinct().join(init.where("class_name is null"), "file_path").select("node_id", "file_path", F.col("_init").alias("span_id"), F.lit(True).alias("pinned"), F.col("_tokens").alias("tokens"))
    every = mine.select("node_id", "file_path", "span_id", F.lit(False).alias("pinned"), "tokens").union(of_class).union(imports)
    every = every.groupBy(*KEY).agg(F.max("pinned").alias("pinned"), F.max("tokens").alias("tokens"))
    fresh = every.join(context, KEY, "left_anti")
    last = context.groupBy("node_id").agg(F.max("pos").alias("_last"))
    place = F.row_number().over(Window.partitionBy("node_id").orderBy("file_path", "span_id"))
    fresh = fresh.join(last, "node_id", "left").withColumn("pos", F.coalesce("_last", F.lit(0)) + place).drop("_last")
    return context.unionByName(fresh, allowMissingColumns=True)


def by_lines(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """(node_id, file_path, span_id) of spans that line ranges meet."""
    return ranges.join(spans, "file_path").where("end_line >= low and start_line <= high").select(*KEY).distinct()


def removed(context: DataFrame, gone: DataFrame) -> DataFrame:
    """Without (node_id, file_path, span_id) spans; pinned ones stay."""
    return context.join(gone.select(*KEY).distinct().withColumn("_gone", F.lit(True)), KEY, "left").where("pinned or _gone is null").drop("_gone")


def pinned(context: DataFrame, wanted: DataFrame) -> DataFrame:
    return context.join(wanted.select(*KEY).distinct().withColumn("_pin", F.lit(True)), KEY, "left").withColumn("pinned", F.col("pinned") | F.coalesce("_pin", F.lit(False))).drop("_pin")


def cloned(context: DataFrame, pairs: DataFrame) -> DataFrame:
    """Copies for (node_id, new_id)."""
    return context.unionByName(context.join(pairs, "node_id").drop("node_id").withColumnRenamed("new_id", "node_id"))


def covers(context: DataFrame, spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges (node_id, file_path, low, high) both of whose ends lie in spans of the context."""
    own = context.join(spans.select("file_path", "span_id", "start_line", "end_line"), ["file_path", "span_id"])
    ends = own.select("node_id", "file_path", "start_line", "end_line")
    low = ranges.join(ends, ["node_id", "file_path"]).where("low between start_line and end_line").select(*ranges.columns).distinct()
    return low.join(ends, ["node_id", "file_path"]).where("high between start_line and end_line").select(*ranges.columns).distinct()


def tokens(context: DataFrame) -> DataFrame:
    return context.groupBy("node_id").agg(F.sum("tokens").alias("tokens"), F.count_distinct("file_path").alias("files"), F.count("*").alias("spans"))


def messages(nodes: DataFrame, paths: DataFrame, style: str = "messages") -> DataFrame:
    """(node_id, history): each node's steps from the root down, as role and text pairs (messages), one line a step
    (compact), thought-action-observation blocks (react), or actions alone (summary)."""
    steps = paths.where("distance > 0").join(nodes.select(F.col("node_id").alias("ancestor_id"), "action", "args", "observation", "thoughts"), "ancestor_id")
    nz = lambda c: F.coalesce(F.col(c), F.lit(""))
    forms = {
        "messages": F.concat(F.lit("assistant: "), nz("action"), F.lit(" "), nz("args"), F.lit("\nuser: "), nz("observation")),
        "compact": F.concat(nz("action"), F.lit("("), nz("args"), F.lit(")")),
        "react": F.concat(F.lit("Thought: "), nz("thoughts"), F.lit("\nAction: "), nz("action"), F.lit("\nAction Input: "), nz("args"), F.lit("\nObservation: "), nz("observation")),
        "summary": nz("action"),
    }
    rows = steps.select("node_id", F.struct((-F.col("distance")).alias("o"), forms[style].alias("t")).alias("s"))
    return rows.groupBy("node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), "\n").alias("history"))


def next_ids(nodes: DataFrame, copies: DataFrame) -> DataFrame:
    """Copies of nodes with ids after the greatest, in their order."""
    top = nodes.agg(F.max("node_id").alias("_top"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("node_id"))
    return nodes.join(copies.select("node_id"), "node_id", "left_semi").withColumn("_n", place).join(F.broadcast(top)).withColumn("node_id", F.col("_top") + F.col("_n")).drop("_top", "_n")
