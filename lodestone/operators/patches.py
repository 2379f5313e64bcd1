"""Patches and expected changes against what a search found."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a patch's lines tell: a file's name on the old side, by git's header or else the first old file, and a hunk.
_MARK = re.compile(r"^(?:diff --git a/(?P<git>.+) b/.+|--- a/(?P<old>.+)|@@ -(?P<at>\d+),(?P<before>\d+) \+\d+,(?P<after>\d+) @@)", re.M)


def hunk(old_start: int, old_length: int, new_length: int) -> tuple[int, int, str]:
    """(start, end, kind) of what a hunk changes, its three lines of context taken off."""
    start = old_start + max(1, min(3, old_start - 3))
    kind = "addition" if old_length == 0 else "deletion" if new_length == 0 else "modification"
    return start, start + max(0, old_length - 7), kind


def hunks(patches: DataFrame, id: str = "instance_id", patch: str = "patch") -> DataFrame:
    """(id, file_path, start_line, end_line, change)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text in zip(frame[id], frame[patch]):
                path = None
                for m in _MARK.finditer(text or ""):
                    path = m["git"] or path or m["old"]
                    if m["at"] and path:
                        rows.append((key, path, *hunk(int(m["at"]), int(m["before"]), int(m["after"]))))
            yield pd.DataFrame(rows, columns=[id, "file_path", "start_line", "end_line", "change"])

    kind = dict(patches.dtypes)[id]
    return patches.select(id, patch).mapInPandas(run, f"{id} {kind}, file_path string, start_line int, end_line int, change string")


def compared(expected: DataFrame, actual: DataFrame, id: str = "instance_id") -> DataFrame:
    """(id, missed_files, missed_hunks): expected hunks less the times that an actual hunk of the file contains one; no
    actual hunks at all miss no files."""
    some = actual.select(id).distinct()
    files = expected.select(id, "file_path").distinct().join(actual.select(id, "file_path").distinct(), [id, "file_path"], "left_anti").join(some, id, "left_semi")
    a = actual.select(id, "file_path", F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    met = expected.join(a, [id, "file_path"]).where("start_line >= _s and end_line <= _e").groupBy(id).agg(F.count("*").alias("_met"))
    counts = expected.groupBy(id).agg(F.count("*").alias("_all")).join(met, id, "left").join(files.groupBy(id).agg(F.count("*").alias("missed_files")), id, "left").na.fill(0)
    return counts.select(id, "missed_files", (F.col("_all") - F.col("_met")).alias("missed_hunks"))


def missing_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.select("file_path").distinct().join(found.select("file_path"), "file_path", "left_anti")


def missing_spans(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected (file_path, span_id) not found; docstring and imports spans don't count."""
    return expected.where("span_id not in ('docstring', 'imports')").join(found, ["file_path", "span_id"], "left_anti")


def identified(expected: DataFrame, found: DataFrame) -> DataFrame:
    """files and spans of the expected ones that were found."""
    f = expected.select("file_path").distinct().join(found, "file_path", "left_semi").agg(F.count("*").alias("files"))
    s = expected.select("file_path", "span_id").distinct().join(found, ["file_path", "span_id"], "left_semi").agg(F.count("*").alias("spans"))
    return f.join(F.broadcast(s))


def any_solution(solutions: DataFrame, found: DataFrame) -> DataFrame:
    """(instance_id, found_files, found_spans): some solution has all its files, or all its spans, among the found."""
    hit = found.select("instance_id", "file_path", "span_id", F.lit(True).alias("_s"))
    files = found.select("instance_id", "file_path", F.lit(True).alias("_f")).distinct()
    rows = solutions.join(hit.distinct(), ["instance_id", "file_path", "span_id"], "left").join(files, ["instance_id", "file_path"], "left")
    each = rows.groupBy("instance_id", "solution").agg(F.bool_and(F.coalesce("_f", F.lit(False))).alias("f"), F.bool_and(F.coalesce("_s", F.lit(False))).alias("s"))
    return each.groupBy("instance_id").agg(F.bool_or("f").alias("found_files"), F.bool_or("s").alias("found_spans"))


def updated_spans(before: DataFrame, after: DataFrame) -> DataFrame:
    """Spans whose content hash changed, or that are gone or new: (file_path, span_id)."""
    a, b = before.select("file_path", "span_id", F.col("hash").alias("_a")), after.select("file_path", "span_id", F.col("hash").alias("_b"))
    return a.join(b, ["file_path", "span_id"], "full_outer").where("not (_a <=> _b)").select("file_path", "span_id")
