"""Path, line and row predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import small


def glob_regex(pattern: str) -> str:
    """A file glob as a regular expression over whole paths without a leading slash.

    A leading `/` goes, and `**.ext` as a name means `**/*.ext`. A pattern matches at any depth unless it holds `**/`: with
    a plain name its folders decide that, else the whole of it."""
    p = pattern.removeprefix("/")
    head, slash, name = p.rpartition("/")
    name = name.replace("**.", "**/*.")
    fixed = "**/" in (p if re.search(r"[*?\[\]]", name) else head + slash if head.startswith("**") else head)
    p = head + slash + name if fixed else "**/" + head + slash + name
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (end := p.find("]", i + 2)) > 0:
            body = p[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, i = out + _quoted(p[i]), i + 1
    return "^" + out + "$"


def _quoted(s: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)


def matches_any(path: Column, patterns: list[str]) -> Column:
    """The path matches one of the globs; commas aren't allowed in a pattern."""
    if any("," in p for p in patterns):
        raise ValueError("a file pattern may not hold a comma")
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def normal_path(path: Column, repo: str = "") -> Column:
    """Without the repository's prefix, a leading slash and a leading repo/."""
    if repo:
        path = F.when(F.startswith(path, F.lit(repo)), F.substring(path, len(repo) + 1, 1 << 30)).otherwise(path)
    return F.regexp_replace(F.regexp_replace(path, "^/+", ""), "^repo/", "")


#: Base names of test files.
TEST_NAMES = ("unittest_*.py", "test_*.py", "tests_*.py", "*_test.py", "test.py", "tests.py")
TEST_GLOBS = ("**/tests/**", "tests*", "*_test.py", "test_*.py")


def is_test(path: Column) -> Column:
    """A part of the path is `testing`, or its base name is a test file's."""
    names = "|".join(_quoted(n).replace(r"\*", "[^/]*") for n in TEST_NAMES)
    return F.array_contains(F.split(path, "/"), "testing") | path.rlike(f"(^|/)(?:{names})$")


def without_tests(files: DataFrame, category: str | None, path: str = "file_path") -> DataFrame:
    """Test files go when a category other than test is asked for."""
    return files if category in (None, "test") else files.where(~matches_any(F.col(path), list(TEST_GLOBS)))


def of_category(files: DataFrame, category: str | None, path: str = "file_path") -> DataFrame:
    if category == "test":
        return files.where(is_test(F.col(path)))
    return files.where(~is_test(F.col(path))) if category == "implementation" else files


def lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line, `line` from 1."""
    return texts.select("*", F.posexplode(F.split(text, "\n")).alias("_at", "content")).withColumn("line", (F.col("_at") + 1).cast("long")).drop("_at")


def line_search(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle") -> DataFrame:
    """Lines that hold a needle, as (texts' columns, needles' columns, line, content).

    A word inside a needle, with white space on both sides, is a whole word of every line that holds it. So lines and
    needles meet by the needle's longest inner word and are then compared: an equi-join. Needles without inner words are
    compared with every line, as a stated query set behind a check of its size."""
    own = [c for c in texts.columns if c != text]
    split = F.split(F.col(needle), r"\s+")
    inner = F.filter(F.slice(split, 2, F.greatest(F.size(split) - 2, F.lit(0))), lambda w: w != "")
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    keyed = needles.withColumn("_anchor", F.when(F.size(inner) > 0, longest))
    rows = lines(texts, text)
    words = rows.withColumn("_word", F.explode(F.array_distinct(F.split("content", r"\s+"))))
    anchored = small(keyed.where("_anchor is not null"))
    found = words.join(anchored, F.col("_word") == F.col("_anchor")).where(F.contains("content", F.col(needle)))
    found = found.select(*own, *needles.columns, "line", "content")
    bare = keyed.where("_anchor is null").drop("_anchor")
    if bare.isEmpty():
        return found
    return found.union(rows.join(small(bare), F.contains("content", F.col(needle))).select(*own, *needles.columns, "line", "content"))


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    return ~((end < low) | (start > high))


def within(start: Column, end: Column, low: Column, high: Column) -> Column:
    return (start >= low) & (end <= high)


def quality(rows: DataFrame, least: float = 3, score: str = "score") -> DataFrame:
    return rows.where(F.col(score) >= least)


def without_licences(comments: DataFrame, group: list[str], order: str, text: str = "content", is_comment: str = "is_comment") -> DataFrame:
    """Licence, copyright and author comments go, with the comments that follow them up to the next other block."""
    w = Window.partitionBy(*group).orderBy(order)
    block = F.sum(F.when(F.col(is_comment), 0).otherwise(1)).over(w)
    rows = comments.withColumn("_block", block)
    bad = F.col(is_comment) & F.col(text).rlike("(?i)copyright|license|author")
    so_far = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_bad", F.max(bad.cast("int")).over(so_far))
    return rows.where(~(F.col(is_comment) & (F.col("_bad") == 1))).drop("_block", "_bad")


def not_generated(files: DataFrame, limit: int = 6000) -> DataFrame:
    """Files with tokens that aren't marked as generated: first comment says so and tokens are over the limit."""
    marked = F.coalesce(F.lower("first_comment").contains("generated"), F.lit(False))
    return files.where((F.col("tokens") > 0) & ~(marked & (F.col("tokens") > limit)))


def top_level_functions(functions: DataFrame) -> DataFrame:
    return functions.where(~F.col("is_method"))


def expandable(nodes: DataFrame) -> DataFrame:
    """Nodes that may get another child: not terminal, not a duplicate, fewer children than max(max_expansions, 1)."""
    children = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("_children"))
    rows = nodes.join(children, "node_id", "left")
    free = F.coalesce("_children", F.lit(0)) < F.greatest(F.coalesce("max_expansions", F.lit(1)), F.lit(1))
    return rows.where(~F.coalesce("is_terminal", F.lit(False)) & ~F.coalesce("is_duplicate", F.lit(False)) & free).drop("_children")


def has_keys(reply: Column, keys: list[str]) -> Column:
    """A reply's JSON holds all keys."""
    out = F.json_object_keys(T.json_text(reply)).isNotNull()
    for k in keys:
        out = out & F.array_contains(F.json_object_keys(T.json_text(reply)), k)
    return F.coalesce(out, F.lit(False))


def question_files(files: DataFrame, skip: tuple[str, ...] = ("Rule.txt", "code_qa_categorized.txt")) -> DataFrame:
    """Files to count: not JSON, not the two named ones, not empty."""
    return files.where(~F.endswith("file_name", F.lit(".json")) & ~F.col("file_name").isin(*skip) & (F.col("file_size") > 0))
