"""Counts, means, groupings and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tags that count as indirect questions.
INDIRECT = ("Decorator", "Condition", "Component", "Model", "BaseClass", "Object", "Model1", "Model2", "Parameter", "Field")


def tag_counts(questions: DataFrame, kind: str = "type", text: str = "question", pattern: str = r"`<([^>]+)>`", indirect: tuple[str, ...] = INDIRECT, whole: Column | None = None) -> DataFrame:
    """(type, tag, n): tags of each question, those in `indirect` folded to Undirect; rows where `whole` holds (lines of
    indirect and high-level files) count once as Undirect; other questions without tags count nowhere."""
    tags = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda t: F.when(t.isin(*indirect), F.lit("Undirect")).otherwise(t) if indirect else t)
    if whole is not None:
        tags = F.when(whole, F.array(F.lit("Undirect"))).otherwise(tags)
    return questions.select(F.col(kind).alias("type"), F.explode(tags).alias("tag")).groupBy("type", "tag").agg(F.count("*").alias("n"))


def crosstab(counts: DataFrame, tags: list[str]) -> DataFrame:
    """Counts as a matrix, zero-filled."""
    return counts.groupBy("type").pivot("tag", tags).agg(F.sum("n")).na.fill(0)


def with_totals(counts: DataFrame) -> DataFrame:
    """Cells, row totals, column totals and the grand total; null marks `all`."""
    return counts.cube("type", "tag").agg(F.sum("n").alias("n"))


def mean_scores(rows: DataFrame, *scores: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), *[F.avg(s).alias(f"avg_{s}") for s in scores])


def report(rows: DataFrame, score: str = "score") -> DataFrame:
    """total, avg (0 when there are no rows)."""
    return rows.agg(F.count("*").alias("total"), F.coalesce(F.avg(score), F.lit(0.0)).alias("average"))


def selection_report(rows: DataFrame) -> DataFrame:
    """Means of three scores and how often each answer was chosen."""
    means = [F.avg(c).alias(f"avg_{c}") for c in ("rag", "decompose", "tree")]
    return rows.agg(*means, *[F.count_if(F.col("chosen") == c).alias(f"n_{c}") for c in ("rag", "decompose", "tree")])


def subtree_tokens(blocks: DataFrame, closure: DataFrame) -> DataFrame:
    """Tokens of each block with all its descendants."""
    own = blocks.select(F.col("block_id").alias("node_id"), "tokens")
    return closure.join(own, "node_id").groupBy(F.col("ancestor_id").alias("block_id")).agg(F.sum("tokens").alias("tokens"))


def file_tokens(hits: DataFrame) -> DataFrame:
    return hits.withColumn("file_tokens", F.sum("tokens").over(Window.partitionBy("file_path")))


def usage(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cost and token sums, null as 0."""
    names = ("cost", "prompt_tokens", "completion_tokens", "cached_tokens")
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("calls"), *[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in names])


def span_count(context: DataFrame) -> DataFrame:
    return context.agg(F.count_distinct("file_path", "span_id").alias("n"))


def children(parents: DataFrame, items: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with their items as an array in the order of pos."""
    lists = items.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))
    return parents.join(lists, key, "left")


def spans_by_file(rows: DataFrame) -> DataFrame:
    """file_path, its distinct span ids sorted."""
    return rows.groupBy("file_path").agg(F.array_sort(F.collect_set("span_id")).alias("span_ids"))


def summary(entities: DataFrame, line: Column, order: str = "pos", separator: str = "\n") -> DataFrame:
    """One text of a line for each entity, in order. The order is a sort of (pos, line) pairs, so entities are one repository's."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return entities.agg(F.array_join(F.transform(parts, lambda p: p["l"]), separator).alias("summary"))


def function_json(functions: DataFrame, calls: int = 5) -> DataFrame:
    """A JSON line for each function with its first calls."""
    return functions.select("pos", F.to_json(F.struct("name", "class_name", "docstring", "parameters", F.slice("calls", 1, calls).alias("calls"))).alias("json"))


def in_groups(rows: DataFrame, line: Column, order: list[str], size: int = 10, by: list[str] | None = None) -> DataFrame:
    """Lines joined in groups of `size`, numbered by order within `by` (the whole table without)."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    numbered = rows.withColumn("_n", F.row_number().over(w) - 1).withColumn("batch", F.floor(F.col("_n") / size).cast("long"))
    parts = F.sort_array(F.collect_list(F.struct("_n", line.alias("l"))))
    return numbered.groupBy(*(by or []), "batch").agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda p: p["l"]), "\n").alias("lines"))


def patch_size(patches: DataFrame, patch: str = "patch") -> DataFrame:
    """additions and deletions of a unified diff, headers left out."""
    rows = F.split(patch, "\n")
    plus = F.size(F.filter(rows, lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++"))))
    minus = F.size(F.filter(rows, lambda x: F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("---"))))
    return patches.select("*", plus.cast("long").alias("additions"), minus.cast("long").alias("deletions"))


def sibling_actions(nodes: DataFrame) -> DataFrame:
    """(parent_id, action, n, duplicates)."""
    return nodes.where("parent_id is not null").groupBy("parent_id", "action").agg(F.count("*").alias("n"), F.count_if("is_duplicate").alias("duplicates"))


def structure_counts(**tables: DataFrame) -> DataFrame:
    """(entity, n) of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("entity"), F.count("*").alias("n"))
        out = row if out is None else out.unionAll(row)
    return out


def largest_classes(functions: DataFrame, k: int = 5) -> DataFrame:
    return functions.where("is_method").groupBy("class_name").agg(F.count("*").alias("methods")).orderBy(F.desc("methods"), "class_name").limit(k)


def features(docs: DataFrame, least: int = 3, spare: tuple[str, ...] = ("main functionality", "error handling", "configuration")) -> DataFrame:
    """Distinct feature phrases of docstrings; fixed ones are added where there are fewer than `least`."""
    found = docs.select(F.explode(F.regexp_extract_all("docstring", F.lit(r"(?i)\b(?:provides?|supports?|implements?|handles?)\s+([A-Za-z][A-Za-z ]{2,40})"), F.lit(1))).alias("f")).select(F.trim(F.lower("f")).alias("feature")).distinct()
    few = found.agg((F.count("*") < least).alias("few"))
    more = few.where("few").select(F.explode(F.array(*map(F.lit, spare))).alias("feature"))
    return found.union(more).distinct()
