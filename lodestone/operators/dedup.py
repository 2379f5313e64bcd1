"""Dedup, set similarity and content keys."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions import text as T


def normal_text(c: Column) -> Column:
    """Lower case, trimmed, letters, digits and white space only."""
    return F.regexp_replace(F.trim(F.lower(c)), r"[^\p{L}\p{N}\s]", "")


def by_text(rows: DataFrame, text: str = "text", pos: str = "pos") -> DataFrame:
    """(pos, text): of texts that are equal when normalised the last stays, at the place of the first."""
    return rows.groupBy(normal_text(F.col(text)).alias("_key")).agg(F.min(pos).alias(pos), F.max_by(text, pos).alias(text)).drop("_key")


def by_items(rows: DataFrame, items: str = "items", pos: str = "pos") -> DataFrame:
    """The first row of each set of (tag, value) items, whatever their order."""
    w = Window.partitionBy(F.array_sort(items)).orderBy(pos)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ingestion(current: DataFrame, incoming: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, action): insert, update or delete by content hash; unchanged documents are left out."""
    a = current.select(id, F.col("hash").alias("_old"))
    b = incoming.select(id, F.col("hash").alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old") != F.col("_new"), "update")
    return a.join(b, id, "full_outer").select(id, action.alias("action")).where("action is not null")


def merged_contexts(mine: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(union without repeats, the new spans alone) of two contexts' (file_path, span_id) rows."""
    new = other.join(mine, ["file_path", "span_id"], "left_anti").dropDuplicates(["file_path", "span_id"])
    return mine.unionByName(new, allowMissingColumns=True), new.select("file_path", "span_id")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 where both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every)


@lru_cache(maxsize=4096)
def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio() if a or b else 1.0


@F.pandas_udf(DoubleType())
def patch_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; 1 where both are empty."""
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def partial_ratio(needle: pd.Series, text: pd.Series) -> pd.Series:
    """0 to 100: the best ratio of the shorter text to a window of the longer of its length."""

    def one(a: str, b: str) -> float:
        a, b = sorted((a or "", b or ""), key=len)
        if not a:
            return 0.0 if b else 100.0
        if a in b:
            return 100.0
        # Windows that begin where matching blocks line the two up are enough for the best alignment of a block.
        starts = {max(0, m.b - m.a) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()}
        return 100 * max(difflib.SequenceMatcher(None, a, b[s : s + len(a)], autojunk=False).ratio() for s in starts)

    return pd.Series([one(x, y) for x, y in zip(needle, text)])


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series(["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), p, p)) for a, b, p in zip(old, new, path)])


@F.pandas_udf(StringType())
def without_overlap(before: pd.Series, text: pd.Series) -> pd.Series:
    """The text without leading lines that the lines before it end with."""

    def one(a: str, b: str) -> str:
        x, y = (a or "").split("\n"), (b or "").split("\n")
        n = next((k for k in range(min(len(x), len(y)), 0, -1) if x[-k:] == y[:k]), 0)
        return "\n".join(y[n:])

    return pd.Series([one(a, b) for a, b in zip(before, text)])


def context_similarity(pairs: DataFrame) -> DataFrame:
    """`similarity` of contexts a, b (maps of file to span ids, and patches):
    0.4 files + 0.2 mean over shared files of their spans + 0.4 mean over shared files of their patches; no shared
    files count as 1 in the last two."""
    shared = F.array_intersect(F.map_keys("a"), F.map_keys("b"))
    files = jaccard(F.map_keys("a"), F.map_keys("b"))
    spans = F.transform(shared, lambda f: jaccard(F.try_element_at("a", f), F.try_element_at("b", f)))
    mean = lambda xs: F.when(F.size(xs) == 0, 1.0).otherwise(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs))
    return pairs.withColumn("similarity", 0.4 * files + 0.2 * mean(spans) + 0.4 * F.coalesce("patch_similarity", F.lit(1.0)))


def finished(nodes: DataFrame, order: str = "preorder") -> DataFrame:
    """Finished nodes, the first of each parent."""
    w = Window.partitionBy("parent_id").orderBy(order)
    return nodes.where("action = 'Finish'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tool_calls(calls: DataFrame) -> DataFrame:
    """First of equal calls of a message, with `had_duplicates`."""
    key = ["message_id", "name", "arguments"]
    w = Window.partitionBy(*key)
    rows = calls.withColumn("_n", F.row_number().over(w.orderBy("pos")))
    return rows.withColumn("had_duplicates", F.max(F.col("_n") > 1).over(Window.partitionBy("message_id"))).where("_n = 1").drop("_n")


def flagged_names(blocks: DataFrame) -> DataFrame:
    """`repeated`: another sibling of the type has the name."""
    return blocks.withColumn("repeated", F.count("*").over(Window.partitionBy("parent_id", "type", "identifier")) > 1)


def duplicate_siblings(nodes: DataFrame) -> DataFrame:
    """(node_id, duplicate_of): siblings with the same action and arguments, thoughts aside; the least id is meant."""
    key = nodes.select("node_id", "parent_id", F.xxhash64("action", "args").alias("_h"), "action", "args").where("parent_id is not null")
    first = F.min("node_id").over(Window.partitionBy("parent_id", "action", "args"))
    return key.withColumn("duplicate_of", first).where("duplicate_of < node_id").select("node_id", "duplicate_of")


def content_keys(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("content_hash", T.content_hash(F.col(text)))
