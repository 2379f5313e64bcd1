"""Searches in block trees: by content, path, identifier, type and span.

Blocks are (block_id, parent_id, ord, type, identifier, content, span_id) with `ord` the place in a depth-first walk, so
that a recursive search for the first block is a minimum of `ord` below the start. `paths` is tree.closure of the same
tree: each search joins it once instead of walking, for all starts at the same time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _below(blocks: DataFrame, paths: DataFrame, least: int = 0) -> DataFrame:
    """(start_id, distance, block's columns): each start with the blocks at or below it."""
    down = paths.where(F.col("distance") >= least).select(F.col("node_id").alias("block_id"), F.col("ancestor_id").alias("start_id"), "distance")
    return blocks.join(down, "block_id")


def _first(rows: DataFrame) -> DataFrame:
    """(start_id, block_id) of the first block in the walk."""
    return rows.groupBy("start_id").agg(F.min_by("block_id", "ord").alias("block_id"))


def has_content(blocks: DataFrame, paths: DataFrame, text: str, span_id: str | None = None) -> DataFrame:
    """(block_id): blocks that hold the text, or have a block below that does; with a span only blocks of that span count.
    Blocks without content hold nothing, also not the empty text."""
    hits = blocks.where((F.col("content") != "") & F.contains("content", F.lit(text)))
    if span_id:
        hits = hits.where(F.col("span_id") == span_id)
    return paths.join(hits.select(F.col("block_id").alias("node_id")), "node_id", "left_semi").select(F.col("ancestor_id").alias("block_id")).distinct()


def path_trie(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, show): every start of the paths as a node of their trie, shown where a whole path ends. The empty path is the
    root, which is there for any path; null paths add nothing. Tries merge by the union of their paths."""
    starts = F.transform(F.sequence(F.lit(0), F.size(path)), lambda n: F.struct(F.slice(path, F.lit(1), n).alias("path"), (n == F.size(path)).alias("show")))
    return paths.where(F.col(path).isNotNull()).select(F.explode(starts).alias("x")).groupBy("x.path").agg(F.max("x.show").alias("show"))


def path_tree(block_paths: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """The trie of dotted block paths, with the paths that they refer to, from links (block_path, scope, path); references
    outside the repository don't count."""
    own = block_paths.select(F.when(F.col("block_path") == "", F.array().cast("array<string>")).otherwise(F.split("block_path", r"\.")).alias("path"))
    if links is not None:
        own = own.union(links.where("scope <> 'external'").join(block_paths.where("block_path <> ''"), "block_path", "left_semi").select("path"))
    return path_trie(own)


def by_path(blocks: DataFrame, paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (root_id, path) with the block_id that its identifiers lead to: at each step the first child of the name, with
    no way back. The empty path leads to the root itself; paths that lead nowhere go."""
    among = Window.partitionBy("parent_id", "identifier").orderBy("ord")
    steps = blocks.where("parent_id is not null").select(F.col("block_id").alias("ancestor_id"), "identifier", (F.row_number().over(among) == 1).alias("_first"))
    roots = blocks.where("parent_id is null").select(F.col("block_id").alias("root_id"))
    up = paths.join(steps, "ancestor_id")
    route = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.coalesce("identifier", F.lit("")).alias("i")))), lambda s: s["i"])
    # A block without an identifier is on no path.
    led = up.groupBy("node_id").agg(F.bool_and(F.col("_first") & F.col("identifier").isNotNull()).alias("_ok"), route.alias("path")).where("_ok")
    root = paths.join(roots, F.col("ancestor_id") == F.col("root_id")).select("node_id", "root_id")
    found = led.join(root, "node_id").select("root_id", "path", F.col("node_id").alias("block_id"))
    found = found.union(roots.select("root_id", F.array().cast("array<string>"), F.col("root_id")))
    return wanted.join(found, ["root_id", "path"])


def by_identifier(blocks: DataFrame, paths: DataFrame, identifier: str, kind: str | None = None, recursive: bool = False) -> DataFrame:
    """(start_id, block_id): the first child of the name and type, or with `recursive` the first block below."""
    rows = _below(blocks.where(F.col("identifier") == identifier), paths, 1)
    if kind:
        rows = rows.where(F.col("type") == kind)
    return _first(rows if recursive else rows.where("distance = 1"))


def with_identifier(blocks: DataFrame, paths: DataFrame, identifier: str) -> DataFrame:
    """(start_id, block_id): all blocks of the name below."""
    return _below(blocks.where(F.col("identifier") == identifier), paths, 1).select("start_id", "block_id")


def with_types(blocks: DataFrame, paths: DataFrame, *types: str) -> DataFrame:
    """(start_id, block_id): all blocks of the types, the start itself included."""
    return _below(blocks.where(F.col("type").isin(*types)), paths).select("start_id", "block_id")


def first_of_type(blocks: DataFrame, paths: DataFrame, kind: str) -> DataFrame:
    """(start_id, block_id): the first block of the type, the start itself included."""
    return _first(_below(blocks.where(F.col("type") == kind), paths))


def complete(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """(block_id): blocks with no commented-out code at or below them."""
    gaps = with_types(blocks, paths, "commented_out_code").select(F.col("start_id").alias("block_id")).distinct()
    return blocks.select("block_id").join(gaps, "block_id", "left_anti")


def incomplete(blocks: DataFrame, paths: DataFrame, *types: str) -> DataFrame:
    """(start_id, block_id): blocks of the types below the start that aren't complete."""
    rows = blocks.where(F.col("type").isin(*types)).join(complete(blocks, paths), "block_id", "left_anti")
    return _below(rows, paths, 1).select("start_id", "block_id")


def errors(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """(start_id, block_id, error) of error blocks at or below the start: what its check said (`messages`), else its path."""
    said = F.when(F.size("messages") > 0, F.col("messages")).otherwise(F.array(F.concat(F.lit("Found validation errors in "), F.array_join("path", "."))))
    return _below(blocks.where("type = 'error'"), paths).select("start_id", "block_id", F.explode(said).alias("error"))


def of_span(blocks: DataFrame, paths: DataFrame, span_id: str) -> DataFrame:
    """(start_id, block_id): all blocks of the span, the start itself included."""
    return _below(blocks.where(F.col("span_id") == span_id), paths).select("start_id", "block_id")


def first_of_span(blocks: DataFrame, paths: DataFrame, span_id: str) -> DataFrame:
    """(start_id, block_id): the first block of the span, the start itself included."""
    return _first(_below(blocks.where(F.col("span_id") == span_id), paths))


def last_of_span(blocks: DataFrame, paths: DataFrame, span_id: str) -> DataFrame:
    """(start_id, block_id): the first block of the span below the start in a walk that takes the last child first and a
    block before those below it. The negated places from the root down sort in that order."""
    mine = blocks.where(F.col("span_id") == span_id).select(F.col("block_id").alias("node_id"))
    places = blocks.select(F.col("block_id").alias("ancestor_id"), "ord")
    up = paths.join(mine, "node_id", "left_semi").join(places, "ancestor_id")
    order = up.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), (-F.col("ord")).alias("o")))), lambda s: s["o"]).alias("_order"))
    rows = paths.where("distance > 0").join(order, "node_id")
    return rows.groupBy(F.col("ancestor_id").alias("start_id")).agg(F.min_by("node_id", "_order").alias("block_id"))


def last_before_span(blocks: DataFrame, paths: DataFrame, span_id: str) -> DataFrame:
    """(root_id, block_id): from each root, the last block of another span before the span's first block.

    It is the nearest among earlier siblings and ancestors of the hit. A walk leaves the children of a block at the first
    hit among them, so later hits there and hits below a hit count for nothing; a hit with nothing before it is passed."""
    hit = F.coalesce(F.col("span_id") == span_id, F.lit(False))
    among = Window.partitionBy("parent_id")
    step = F.struct("ord", "block_id")
    before = among.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    # The start is passed over: it takes part only as what comes before.
    rows = blocks.where("parent_id is not null").withColumn("_cut", F.min(F.when(hit, F.col("ord"))).over(among))
    rows = rows.withColumn("_before", F.max(F.when(~hit & F.col("span_id").isNotNull(), step)).over(before))
    other = blocks.where("parent_id is not null").select(F.col("block_id").alias("ancestor_id"), F.when(~hit & F.col("span_id").isNotNull(), step).alias("_self"))
    facts = rows.select(F.col("block_id").alias("ancestor_id"), F.col("ord").alias("_ord"), "_cut", "_before").join(other, "ancestor_id")
    hits = blocks.where(hit & F.col("parent_id").isNotNull()).select(F.col("block_id").alias("node_id"), "ord")
    up = paths.join(hits, "node_id").join(facts, "ancestor_id", "left")
    # On the way down, each step comes before the first hit among its siblings; the hit is that first one.
    open_ = F.col("_cut").isNull() | (F.col("_ord") < F.col("_cut")) | ((F.col("distance") == 0) & (F.col("_ord") == F.col("_cut")))
    near = F.greatest("_before", F.when(F.col("distance") > 0, F.col("_self")))
    seen = up.groupBy("node_id", "ord").agg(F.bool_and(F.coalesce(open_, F.lit(True))).alias("_open"), F.max(near).alias("_near"), F.max_by("ancestor_id", "distance").alias("root_id"))
    roots = blocks.where(hit & F.col("parent_id").isNull()).select(F.col("block_id").alias("root_id"))
    found = seen.where("_open and _near is not null").join(roots, "root_id", "left_anti")
    return found.groupBy("root_id").agg(F.min_by(F.col("_near.block_id"), F.col("ord")).alias("block_id"))


def span_ids(blocks: DataFrame, paths: DataFrame, include_self: bool = True) -> DataFrame:
    """(start_id, span_ids): the spans of the blocks at or below each start, sorted."""
    rows = _below(blocks.where("span_id is not null"), paths, 0 if include_self else 1)
    return rows.groupBy("start_id").agg(F.array_sort(F.collect_set("span_id")).alias("span_ids"))


def relationships(blocks: DataFrame, paths: DataFrame, links: DataFrame, *exclude: str) -> DataFrame:
    """(start_id, links' columns): relationships (block_id, ...) of the blocks at or below each start; a block of an excluded
    type below the start takes all below it away."""
    if exclude:
        closed = blocks.where(F.col("type").isin(*exclude)).select(F.col("block_id").alias("ancestor_id"))
        # Starts beyond the nearest excluded block don't see past it; that block itself does.
        wall = paths.join(closed, "ancestor_id", "left_semi").groupBy("node_id").agg(F.min("distance").alias("_wall"))
        paths = paths.join(wall, "node_id", "left").where("_wall is null or distance <= _wall").drop("_wall")
    down = paths.select(F.col("node_id").alias("block_id"), F.col("ancestor_id").alias("start_id"))
    return down.join(links, "block_id")


def attribute_line(code: Column, name: Column) -> Column:
    """The first line (from 0) that assigns the attribute; null if none does. The name is taken as a pattern."""
    lines = F.transform(F.split(code, "\n"), lambda line, i: F.when(F.regexp(line, F.concat(F.lit(r"\s*"), name, F.lit(r"\s*="))), i))
    return F.array_min(lines)
