"""Code retrieval: search hits to spans under budgets, name lookups, test files, and the actions built on them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small
from . import dedup, predicates

TOP = 500


def query_text(query: str, pattern: str | None = None, snippet: str | None = None) -> str:
    return query + (f" file:{pattern}" if pattern else "") + (f"\n{snippet}" if snippet else "")


def post_filters(hits: DataFrame, chunks: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, category: str | None = None, exact: str | None = None, snippet: str | None = None) -> DataFrame:
    """Ranked hits with their chunk, filtered after the rank: ranks never move and recall may fall.

    The order is: chunk missing, excluded files, included files, test or not, exact text, snippet without white space."""
    rows = hits.join(chunks, "chunk_id")
    path = F.col("file_path")
    if exclude:
        rows = rows.where(~predicates.matches_any(path, exclude))
    rows = predicates.without_tests(rows, category)
    if include:
        rows = rows.where(predicates.matches_any(path, include))
    rows = predicates.of_category(rows, category)
    if exact:
        rows = rows.where(F.contains("content", F.lit(exact)))
    if snippet:
        rows = rows.where(predicates.T.contains_compact(F.col("content"), F.lit(snippet)))
    return rows


SEMANTIC = "query_id long, file_path string, span_id string, rank int, tokens int"


def semantic(hits: DataFrame, max_results: int = 25, max_tokens: int = 8000, max_per_file: int = 5, exact: bool = False) -> DataFrame:
    """Hits (query_id, rank, file_path, spans: array of (span_id, tokens), is_exact) to admitted spans.

    Hits go by rank until the tokens are over the limit when a hit begins, so its last hit may overshoot. Spans are
    admitted while their number is at most max_results, which lets one more in. With `exact`, the first hit that holds
    the exact text drops what was admitted before and asks it of all that follow; counters go on.

    A query has TOP hits at most, so its group is bounded."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        admitted: dict[tuple[str, str], tuple[int, int]] = {}
        per_file: dict[str, int] = {}
        count = tokens = 0
        strict = False
        for r in rows.sort_values("rank").itertuples():
            if tokens > max_tokens:
                break
            if exact and r.is_exact and not strict:
                strict = True
                admitted.clear()
            if strict and not r.is_exact:
                continue
            for s in r.spans:
                key = (r.file_path, s["span_id"])
                if key in admitted or per_file.get(r.file_path, 0) >= max_per_file:
                    continue
                if count > max_results:
                    break
                admitted[key] = (int(r.rank), int(s["tokens"]))
                per_file[r.file_path] = per_file.get(r.file_path, 0) + 1
                count += 1
                tokens += int(s["tokens"])
        out = [(rows["query_id"].iloc[0], f, s, rank, n) for (f, s), (rank, n) in admitted.items()]
        return pd.DataFrame(out, columns=["query_id", "file_path", "span_id", "rank", "tokens"])

    return hits.where(F.col("rank") <= TOP).groupBy("query_id").applyInPandas(one, SEMANTIC)


def admitted_spans(hits: DataFrame, max_results: int, max_tokens: int) -> DataFrame:
    """The same without exact mode or a cap on files, as windows alone: (query_id, file_path, span_id, rank, tokens)."""
    spans = hits.select("query_id", "rank", "file_path", F.posexplode("spans").alias("at", "s")).select("query_id", "rank", "at", "file_path", "s.span_id", "s.tokens")
    first = Window.partitionBy("query_id", "file_path", "span_id").orderBy("rank", "at")
    spans = spans.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    order = Window.partitionBy("query_id").orderBy("rank", "at")
    spans = spans.withColumn("_before", F.sum("tokens").over(order) - F.col("tokens")).withColumn("_count", F.row_number().over(order))
    # Tokens before the hit decide, so all spans of a hit see the total at its first.
    spans = spans.withColumn("_hit", F.first("_before").over(Window.partitionBy("query_id", "rank").orderBy("at")))
    return spans.where((F.col("_hit") <= max_tokens) & (F.col("_count") <= max_results + 1)).select("query_id", "file_path", "span_id", "rank", "tokens")


def by_name(blocks: DataFrame, names: DataFrame, include: list[str] | None = None, category: str | None = None) -> DataFrame:
    """Blocks by (class_name, function_name) of names; a class alone gives its spans and its children's, with a function
    that child. (name's columns, file_path, span_id, rank) without repeats, ranks anew."""
    rows = predicates.of_category(blocks, category)
    if include:
        rows = rows.where(predicates.matches_any(F.col("file_path"), include))
    n = names.select("query_id", F.col("class_name").alias("_c"), F.col("function_name").alias("_f"))
    whole = rows.join(n.where("_c is not null and _f is null"), F.col("_c") == F.col("class_name"))
    member = rows.join(n.where("_c is not null and _f is not null"), (F.col("_c") == F.col("class_name")) & (F.col("_f") == F.col("identifier")))
    free = rows.join(n.where("_c is null and _f is not null"), (F.col("_f") == F.col("identifier")) & F.col("type").isin("function", "constructor"))
    found = whole.unionByName(member).unionByName(free).select("query_id", "file_path", "span_id").distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("file_path", "span_id")) - 1)


def function_alternatives(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """Where a member isn't found: all functions of the class, and functions of its name in other places."""
    n = names.select("query_id", F.col("class_name").alias("_c"), F.col("function_name").alias("_f"))
    functions = blocks.where("type in ('function', 'constructor')")
    of_class = functions.join(n, F.col("_c") == F.col("class_name")).select("query_id", "file_path", "span_id")
    of_name = functions.join(n, F.col("_f") == F.col("identifier")).select("query_id", "file_path", "span_id")
    return of_class.union(of_name).distinct()


def rerank_files(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(query_id, file_path, score, rank) by the best partial match of a pattern, highest first, then in their order."""
    rows = files.join(small(patterns)).withColumn("score", dedup.partial_ratio("pattern", "file_path"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")) - 1)


def test_hits(hits: DataFrame, most_tokens: int = 500, budget: int = 8000, per_file: int = 5) -> DataFrame:
    """Function spans of test hits: small ones, named test where any is, capped by file, within the budget by rank."""
    rows = hits.where(f"type = 'function' and tokens <= {most_tokens}")
    any_test = F.max(F.lower("identifier").contains("test").cast("int")).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("_any", any_test).where((F.col("_any") == 0) | F.lower("identifier").contains("test"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy("rank"))).where(F.col("_n") <= per_file)
    total = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank", "span_id"))
    return rows.withColumn("_t", total).where(F.col("_t") <= budget).drop("_any", "_n", "_t")


def first_hits(hits: DataFrame, most: int = 10) -> DataFrame:
    """The first hits by path and line: a report's limit."""
    return hits.orderBy("file_path", "line").limit(most)


def fallback(primary: DataFrame, spare: DataFrame, key: str = "query_id") -> DataFrame:
    """Rows of primary, and of spare for the keys that primary has none of."""
    return primary.unionByName(spare.join(primary.select(key).distinct(), key, "left_anti"))


def budget_state(hits: DataFrame, most_tokens: int = 2000, most_spans: int = 10) -> DataFrame:
    """(query_id, spans, tokens, state): `identify` where a model must choose, `too_large` for one oversize span, else ok."""
    rows = hits.groupBy("query_id").agg(F.count("*").alias("spans"), F.sum("tokens").alias("tokens"))
    over = F.col("tokens") > most_tokens
    state = F.when((over & (F.col("spans") > 1)) | (F.col("spans") > most_spans), "identify").when(over, "too_large").otherwise("ok")
    return rows.withColumn("state", state)


def viewed(spans: DataFrame, requests: DataFrame, most: int = 3000) -> DataFrame:
    """Spans of view requests (request_id, file_path, span_id, low, high): by id, by the class it names, by lines, or the
    whole file; requests over `most` tokens are marked too_large."""
    s, r = spans, requests
    by_id = r.where("span_id is not null").join(s, (r["file_path"] == s["file_path"]) & ((s["span_id"] == r["span_id"]) | F.startswith(s["span_id"], F.concat(r["span_id"], F.lit(".")))))
    by_line = r.where("span_id is null and low is not null").join(s, (r["file_path"] == s["file_path"]) & (s["end_line"] >= r["low"]) & (s["start_line"] <= r["high"]))
    whole = r.where("span_id is null and low is null").join(s, r["file_path"] == s["file_path"])
    pick = lambda x: x.select("request_id", s["file_path"], s["span_id"], s["tokens"])
    rows = pick(by_id).union(pick(by_line)).union(pick(whole)).distinct()
    return rows.withColumn("too_large", F.sum("tokens").over(Window.partitionBy("request_id")) > most)


def listing(files: DataFrame, folder: str = "") -> DataFrame:
    """One row: a folder's direct files and folders, each sorted."""
    head = folder.strip("/") + "/" if folder.strip("/") else ""
    rest = files.where(F.startswith("file_path", F.lit(head))).select(F.substring("file_path", len(head) + 1, 1 << 30).alias("p"))
    return rest.agg(
        F.array_sort(F.collect_set(F.when(~F.contains("p", F.lit("/")), F.col("p")))).alias("files"),
        F.array_sort(F.collect_set(F.when(F.contains("p", F.lit("/")), F.split_part("p", F.lit("/"), F.lit(1))))).alias("directories"),
    )


def element_text(classes: DataFrame, functions: DataFrame, attributes: DataFrame) -> DataFrame:
    """(kind, name, text) to embed: one string for each class, function or method, and attribute."""
    nz = lambda c: F.coalesce(F.col(c), F.lit(""))
    c = classes.select(F.lit("class").alias("kind"), "name", F.format_string("Class %s: %s", "name", nz("docstring")).alias("text"))
    f = functions.select(F.when(F.col("is_method"), "method").otherwise("function").alias("kind"), "name", F.format_string("%s %s: %s", F.when(F.col("is_method"), F.concat(F.lit("Method "), nz("class_name"))).otherwise(F.lit("Function")), "name", nz("docstring")).alias("text"))
    a = attributes.select(F.lit("attribute").alias("kind"), "name", F.format_string("Attribute %s of class %s", "name", "class_name").alias("text"))
    return c.union(f).union(a)
