"""Blocks to spans and chunks, and code as text: folds over one file's rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Sizes in tokens.
LEAST, SOFT, MOST, HARD = 100, 750, 1500, 6000
SPAN_TOKENS = 500

SPAN_SCHEMA = "file string, span_id string, span_type string, start_line int, end_line int, tokens int, ord int"


def spans(blocks: DataFrame, most: int = SPAN_TOKENS) -> DataFrame:
    """Spans of each file's blocks: imports together, one for each function or constructor, a class's own lines as its
    init span, and module code in runs of up to `most` tokens. Repeated ids get :n from the second on."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        kinds = dict(zip(rows["ord"], rows["type"]))
        out: list[dict] = []

        def put(base: str, kind: str, r, joins: bool) -> None:
            if joins and out and out[-1]["base"] == base and out[-1]["tokens"] + r.tokens <= most:
                out[-1]["end_line"] = max(out[-1]["end_line"], int(r.end_line))
                out[-1]["tokens"] += int(r.tokens)
            else:
                out.append({"base": base, "span_type": kind, "start_line": int(r.start_line), "end_line": int(r.end_line), "tokens": int(r.tokens)})

        for r in rows.itertuples():
            parent = kinds.get(r.parent_ord)
            name = ".".join(r.path) if r.path is not None else ""
            if r.type == "import":
                put("imports", "init", r, True)
            elif r.type == "class":
                inner = rows[rows["parent_ord"] == r.ord]
                end = int(inner.loc[inner["type"].isin(["function", "constructor", "class"]), "start_line"].min() - 1) if inner["type"].isin(["function", "constructor", "class"]).any() else int(r.end_line)
                out.append({"base": name, "span_type": "init", "start_line": int(r.start_line), "end_line": end, "tokens": int(r.tokens - inner.loc[inner["type"].isin(["function", "constructor", "class"]), "tokens"].sum())})
            elif r.type in ("function", "constructor") and parent not in ("function", "constructor"):
                out.append({"base": name, "span_type": "init" if r.type == "constructor" else "impl", "start_line": int(r.start_line), "end_line": int(r.end_line), "tokens": int(r.tokens)})
            elif parent == "module":
                put("impl", "impl", r, True)
        seen: dict[str, int] = {}
        for at, s in enumerate(out):
            n = seen[s["base"]] = seen.get(s["base"], 0) + 1
            s |= {"file": rows["file"].iloc[0], "span_id": s.pop("base") + (f":{n}" if n > 1 else ""), "ord": at}
        return pd.DataFrame(out, columns=["file", "span_id", "span_type", "start_line", "end_line", "tokens", "ord"])

    return blocks.groupBy("file").applyInPandas(one, SPAN_SCHEMA)


CHUNK_SCHEMA = "file string, chunk int, span_ids array<string>, start_line int, end_line int, tokens int"


def merged(sizes: list[int], least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """Neighbours joined in one pass: a chunk under `least` goes to the smaller neighbour, if both fit in `most`."""
    groups = [[i] for i in range(len(sizes))]
    total = list(sizes)
    i = 0
    while i < len(groups):
        if total[i] < least and len(groups) > 1:
            sides = [j for j in (i - 1, i + 1) if 0 <= j < len(groups) and total[j] + total[i] <= most]
            if sides:
                j = min(sides, key=lambda j: (total[j], j))
                a, b = sorted((i, j))
                groups[a] += groups.pop(b)
                total[a] += total.pop(b)
                i = a
        i += 1
    return groups


def chunks(span_rows: DataFrame, least: int = LEAST, soft: int = SOFT, most: int = MOST) -> DataFrame:
    """Chunks of each file's spans: spans in order up to the soft size, then small ones merged toward the smaller side."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        runs: list[list[int]] = []
        size = 0
        for k, t in enumerate(rows["tokens"]):
            if runs and size + t <= soft:
                runs[-1].append(k)
                size += t
            else:
                runs.append([k])
                size = t
        joined = [[k for r in g for k in runs[r]] for g in merged([int(rows["tokens"].iloc[r].sum()) for r in runs], least, most)]
        out = []
        for n, ks in enumerate(joined):
            part = rows.iloc[ks]
            out.append((rows["file"].iloc[0], n, sorted(part["span_id"]), int(part["start_line"].min()), int(part["end_line"].max()), int(part["tokens"].sum())))
        return pd.DataFrame(out, columns=["file", "chunk", "span_ids", "start_line", "end_line", "tokens"])

    return span_rows.groupBy("file").applyInPandas(one, CHUNK_SCHEMA)


def chunk_nodes(chunk_rows: DataFrame, sources: DataFrame, limit: int = HARD) -> DataFrame:
    """chunk_id, content (its lines, cut at `limit` characters), content hash."""
    lines = F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    rows = chunk_rows.join(sources.select("file", "text"), "file")
    rows = rows.withColumn("content", F.substring(F.array_join(lines, "\n"), 1, limit))
    rows = rows.withColumn("chunk_id", F.concat_ws("_", "file", F.col("chunk").cast("string")))
    return rows.withColumn("content_hash", T.content_hash(F.col("content"))).drop("text")


def rendered(text: Column, shown: Column, mark: str = "#", numbers: bool = True) -> Column:
    """A file's lines with only the shown (start, end) ranges; each gap becomes one comment line."""
    lines = F.split(text, "\n")
    inside = lambda n: F.exists(shown, lambda r: (n >= r["start"]) & (n <= r["end"]))
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("x")))
    own = lambda p: F.format_string("%6d\t%s", p["n"], p["x"]) if numbers else p["x"]
    gap = F.lit(f"{mark} ...")
    pick = F.transform(numbered, lambda p: F.when(inside(p["n"]), own(p)).when((p["n"] == 1) | inside(p["n"] - 1), gap))
    return F.array_join(F.filter(pick, lambda x: x.isNotNull()), "\n")
