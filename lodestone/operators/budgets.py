"""Token budgets over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, by: list[str], order: list, tokens: str = "tokens") -> DataFrame:
    """With `total`: tokens up to and with the row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(tokens).over(w))


def prefix(rows: DataFrame, by: list[str], order: list, budget: int, tokens: str = "tokens") -> DataFrame:
    """Rows before the first that overflows the budget."""
    return running(rows, by, order, tokens).where(F.col("total") <= budget)


def kept_positions(tokens: Column, viewed: Column | None, budget: int) -> Column:
    """Places (from 0) that a newest-first budget keeps: what doesn't fit is skipped and later ones are still tried;
    viewed ones always stay and are counted."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        seen = F.get(viewed, a["i"]) if viewed is not None else F.lit(False)
        fits = seen | (a["total"] + x <= budget)
        return F.struct(F.when(fits, a["total"] + x).otherwise(a["total"]).alias("total"), F.when(fits, F.concat(a["kept"], F.array(a["i"]))).otherwise(a["kept"]).alias("kept"), (a["i"] + 1).alias("i"))

    return F.aggregate(tokens, start, step, lambda a: a["kept"])


def greedy(rows: DataFrame, by: list[str], newest_first: list[str], budget: int, tokens: str = "tokens", viewed: str | None = None) -> DataFrame:
    """(by, rows: the rows kept as structs, newest first). One history fits one row."""
    item = F.struct(*newest_first, *[c for c in rows.columns if c not in {*by, *newest_first}])
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(item), asc=False).alias("_all"))
    sizes = F.transform("_all", lambda x: x[tokens].cast("long"))
    seen = F.transform("_all", lambda x: x[viewed]) if viewed else None
    lists = lists.withColumn("_kept", kept_positions(sizes, seen, budget))
    return lists.select(*by, F.transform("_kept", lambda i: F.get("_all", i)).alias("rows"))


def covered_changes(hits: DataFrame, changes: DataFrame, slack: int = 1) -> DataFrame:
    """For each expected change (file_path, low, high) the first hit by rank that covers it, give or take a line, and the
    tokens of the context up to there."""
    w = Window.orderBy("rank").partitionBy("search_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hits.withColumn("context_tokens", F.sum("tokens").over(w))
    found = changes.join(ranked, "file_path").where(f"start_line - {slack} <= low and end_line + {slack} >= high")
    return found.groupBy("search_id", "file_path", "low", "high").agg(F.min_by(F.struct("rank", "span_id", "context_tokens"), "rank").alias("hit")).select("search_id", "file_path", "low", "high", "hit.*")


def unique_ids(blocks: DataFrame, by: list[str], order: str = "ord", base: str = "identifier") -> DataFrame:
    """`unique_id` among siblings: a repeat gets the number of siblings of its type so far as a suffix."""
    of_type = F.row_number().over(Window.partitionBy(*by, "type").orderBy(order)) - 1
    repeat = F.row_number().over(Window.partitionBy(*by, "type", base).orderBy(order)) - 1
    return blocks.withColumn("unique_id", F.when(repeat == 0, F.col(base)).otherwise(F.concat_ws("_", F.col(base), of_type.cast("string"))))


def span_ids(spans: DataFrame, order: str = "ord") -> DataFrame:
    """`span_id`: the base id, with :n from the second of a file on."""
    n = F.row_number().over(Window.partitionBy("file", "base_id").orderBy(order))
    return spans.withColumn("span_id", F.when(n == 1, F.col("base_id")).otherwise(F.concat_ws(":", "base_id", n.cast("string"))))


def neighbours(blocks: DataFrame, by: str = "file", order: str = "ord") -> DataFrame:
    """Previous and next block, and tokens between a block and the one before it."""
    w = Window.partitionBy(by).orderBy(order)
    return blocks.withColumns({"previous": F.lag(order).over(w), "next": F.lead(order).over(w), "tokens_before": F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})


def block_at(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """First block that starts at or after each (file, line)."""
    return lines.join(blocks, "file").where("start_line >= line").groupBy("file", "line").agg(F.min_by("ord", F.struct("start_line", "ord")).alias("ord"))


def penalties(nodes: DataFrame, closure: DataFrame, step: int = 25, floor: int = -100) -> DataFrame:
    """Reward cut for corrections in a row: -step for each ancestor that corrects, up to the first that doesn't; floored."""
    up = closure.where("distance > 0").join(nodes.select(F.col("node_id").alias("ancestor_id"), "expect_correction"), "ancestor_id")
    w = Window.partitionBy("node_id").orderBy("distance")
    run = up.withColumn("_breaks", F.sum((~F.col("expect_correction")).cast("int")).over(w)).where("_breaks = 0")
    counted = run.groupBy("node_id").agg(F.count("*").alias("n"))
    return nodes.select("node_id").join(counted, "node_id", "left").select("node_id", F.greatest(F.lit(floor), -step * F.coalesce("n", F.lit(0))).alias("penalty"))
