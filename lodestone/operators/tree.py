"""Search trees as flat tables: closures, rewards, scores, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled


def closure(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(node_id, ancestor_id, distance), each node its own ancestor at 0, from (node_id, parent_id).

    Path doubling: paths of a full d steps join all paths so far, so depth n takes log2(n) rounds, each cut by a
    checkpoint; it ends when no path is new. `most` bounds the depth, against cycles."""
    reach = settled(edges.where("parent_id is not null").select("node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance")))
    d = 1
    while d < most:
        # The lower half is d full steps, the upper any path: every distance in (d, 2d] comes about once.
        lower = reach.where(F.col("distance") == d).select("node_id", F.col("ancestor_id").alias("_via"))
        upper = reach.select(F.col("node_id").alias("_via"), "ancestor_id", "distance")
        further = settled(lower.join(upper, "_via").select("node_id", "ancestor_id", (F.col("distance") + d).alias("distance")))
        if further.isEmpty():
            break
        reach = reach.union(further)
        d *= 2
    own = edges.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    return own.union(reach)


def depths(paths: DataFrame) -> DataFrame:
    """(node_id, depth, root_id)."""
    return paths.groupBy("node_id").agg(F.max("distance").alias("depth"), F.max_by("ancestor_id", "distance").alias("root_id"))


def leaves(nodes: DataFrame) -> DataFrame:
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    return nodes.join(parents, "node_id", "left_anti")


def expanded(nodes: DataFrame) -> DataFrame:
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    return nodes.join(parents, "node_id", "left_semi")


def siblings(nodes: DataFrame) -> DataFrame:
    """(node_id, sibling_id)."""
    a = nodes.where("parent_id is not null").select("node_id", "parent_id")
    return a.join(a.withColumnRenamed("node_id", "sibling_id"), "parent_id").where("node_id <> sibling_id").select("node_id", "sibling_id")


def preorder(paths: DataFrame) -> DataFrame:
    """(node_id, preorder): place in a depth-first walk, children by id. The path from the root sorts as an array."""
    route = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor_id")))
    rows = paths.groupBy("node_id").agg(F.transform(route, lambda x: x["ancestor_id"]).alias("route"))
    return rows.withColumn("preorder", F.row_number().over(Window.partitionBy(F.get("route", F.lit(0))).orderBy("route"))).drop("route")


def without_later(nodes: DataFrame, paths: DataFrame, after: int) -> DataFrame:
    """The tree cut back to nodes up to an id: later ones go with all below them."""
    gone = paths.where(F.col("ancestor_id") > after).select("node_id").distinct()
    return nodes.join(gone, "node_id", "left_anti")


def backpropagated(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """visits and value of each node: one visit and its reward for every rewarded node at or below it."""
    rewards = nodes.where("reward is not null").select("node_id", "reward")
    sums = paths.join(rewards, "node_id").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("visits"), F.sum("reward").alias("value"))
    return nodes.drop("visits", "value").join(sums, "node_id", "left").na.fill({"visits": 0, "value": 0})


def trajectory_means(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(node_id, mean_reward): mean over the node and its ancestors of value / visits, 0 where unvisited."""
    each = nodes.select(F.col("node_id").alias("ancestor_id"), F.when(F.col("visits") > 0, F.col("value") / F.col("visits")).otherwise(0.0).alias("r"))
    return paths.join(each, "ancestor_id").groupBy("node_id").agg(F.avg("r").alias("mean_reward"))


# Weights and thresholds of the score.
UCT = {
    "exploitation_weight": 1.0, "exploration_weight": 1.0, "depth_weight": 0.8, "depth_bonus_factor": 0.0, "high_value": 50.0, "low_value": 0.0, "very_high_value": 75.0,
    "leaf_bonus": 50.0, "bad_children_factor": 5.0, "child_penalty": 5.0, "finished_penalty": 50.0, "correction_bonus": 50.0, "diversity_weight": 100.0,
    "duplicate_child": 25.0, "duplicate_action": 50.0,
}
BAD_CHILD_ACTIONS = ("RequestCodeChange",)


def uct(nodes: DataFrame, paths: DataFrame, similarity: DataFrame | None = None, use_mean: bool = False, **weights: float) -> DataFrame:
    """node_id, the score's parts and `uct`; nodes without visits score infinity.

    nodes: node_id, parent_id, visits, value, reward, action, is_duplicate, expect_correction, has_context.
    similarity: (node_id, similarity), the mean to other expanded nodes; a node with context and none gets the whole bonus."""
    k = UCT | weights
    kids = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(
        F.count("*").alias("children"), F.count("reward").alias("rewarded"), F.max("reward").alias("best_child"), F.avg("reward").alias("mean_child"),
        F.max(F.col("action").isin(*BAD_CHILD_ACTIONS)).alias("bad_action"), F.count_if("is_duplicate").alias("duplicates"),
    )
    same = nodes.where("parent_id is not null and action is not null").groupBy("parent_id", "action").count().groupBy(F.col("parent_id").alias("node_id")).agg(F.sum(F.when(F.col("count") > 1, (F.col("count") - 1) ** 2).otherwise(0)).alias("same_actions"))
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("visits").alias("parent_visits"), F.col("reward").alias("parent_reward"), F.col("expect_correction").alias("parent_corrects"))
    done = paths.where("distance > 0").join(nodes.where("action = 'Finish' and reward >= 100").select("node_id"), "node_id").select(F.col("ancestor_id").alias("node_id"), F.lit(True).alias("on_finished")).distinct()
    rows = nodes.join(kids, "node_id", "left").join(same, "node_id", "left").join(parents, "parent_id", "left").join(done, "node_id", "left").join(depths(paths), "node_id")
    rows = rows.join(similarity, "node_id", "left") if similarity is not None else rows.withColumn("similarity", F.lit(None).cast("double"))
    rows = rows.join(trajectory_means(nodes, paths), "node_id") if use_mean else rows
    c = F.col
    none, no = F.coalesce(c("children"), F.lit(0)) == 0, F.lit(0.0)
    exploit = k["exploitation_weight"] * (c("mean_reward") if use_mean else F.coalesce(c("reward").cast("double"), no))
    when = lambda cond, value: F.when(F.coalesce(cond, F.lit(False)), value).otherwise(no)
    corrects = F.coalesce(c("expect_correction"), F.lit(False)) & ~F.coalesce(c("parent_corrects"), F.lit(False))
    parts = {
        "exploitation": exploit,
        "exploration": k["exploration_weight"] * F.sqrt(F.ln(F.greatest(F.coalesce(c("parent_visits"), F.lit(1)), F.lit(1)).cast("double")) / F.nullif(c("visits"), F.lit(0))),
        "depth_bonus": when(c("depth") == 0, F.lit(k["depth_bonus_factor"]) * F.exp(-k["depth_weight"] * (c("depth") - 1))),
        "depth_penalty": -k["depth_weight"] * F.sqrt(c("depth").cast("double")),
        "leaf_bonus": when(none & (c("reward") >= k["high_value"]), F.lit(k["leaf_bonus"])),
        "bad_children_bonus": when((exploit >= k["high_value"]) & (c("rewarded") == 1) & c("bad_action") & (c("mean_child") <= k["low_value"]), (exploit - c("mean_child")) * k["bad_children_factor"]),
        "child_penalty": when(c("best_child") >= k["very_high_value"], F.lit(-k["child_penalty"])),
        "parent_bonus": when(none & c("parent_id").isNotNull() & (c("parent_reward").isNull() | (c("parent_reward") > k["high_value"])) & (exploit <= k["low_value"]), k["high_value"] - exploit),
        "finished_penalty": when(c("has_context") & c("on_finished"), F.lit(-k["finished_penalty"])),
        "correction_bonus": when(corrects, k["correction_bonus"] / (1 + F.coalesce(c("children"), F.lit(0)) ** 2)),
        "diversity_bonus": when(c("has_context"), k["diversity_weight"] * (1 - F.coalesce(c("similarity"), no))),
        "duplicate_child_penalty": -k["duplicate_child"] * F.coalesce(c("duplicates"), F.lit(0)) ** 2,
        "duplicate_action_penalty": -k["duplicate_action"] * F.coalesce(c("same_actions"), F.lit(0)),
    }
    rows = rows.withColumns(parts)
    total = sum((F.coalesce(c(p), no) for p in parts), no)
    return rows.withColumn("uct", F.when(c("visits") == 0, F.lit(float("inf"))).otherwise(total)).select("node_id", *parts, "uct")


def selected(expandable: DataFrame, scores: DataFrame, least: float = float("-inf")) -> DataFrame:
    """The node to expand: highest score among those whose reward reaches the threshold; the root if none does."""
    rows = expandable.join(scores.select("node_id", "uct"), "node_id").withColumn("_ok", F.coalesce("reward", F.lit(0.0)) >= least)
    usable = rows.where(F.col("_ok") | F.col("parent_id").isNull())
    return usable.orderBy(F.desc("_ok"), F.desc("uct"), "node_id").limit(1).drop("_ok")


def finished_or_leaves(nodes: DataFrame) -> DataFrame:
    """Finished nodes, or all leaves where none is."""
    done = nodes.where("action = 'Finish'")
    any_done = done.agg((F.count("*") > 0).alias("any"))
    ends = leaves(nodes).join(F.broadcast(any_done.where("not any"))).drop("any")
    return done.unionByName(ends)


# Failures by weight and what they cost.
FAILURES = {
    "file_not_found": -50, "is_directory": -50, "invalid_file": -50, "no_spans_found": -50, "string_not_found": -50, "string_already_exists": -50, "no_changes": -50,
    "too_many_tokens": -25, "no_spans_added": -25, "no_search_hits": -25, "file_exists": -25, "multiple_occurrences": -25, "indentation_differs": -25, "line_breaks_differs": -25, "multiple_format_matches": -25,
}


def rule_rewards(steps: DataFrame) -> DataFrame:
    """`reward` by rule: failures by their table, searches 100 with hits and 0 without, views 50 with new spans and 25
    without, anything else 50. steps: fail_reason, action, hits, new_spans."""
    table = F.create_map(*[F.lit(x) for kv in FAILURES.items() for x in kv])
    by_action = (
        F.when(F.col("action").isin("FindClass", "FindFunction", "FindCodeSnippet", "FindCalledObject", "SemanticSearch"), F.when(F.col("hits") > 0, 100).otherwise(0))
        .when(F.col("action").isin("ViewCode", "FurtherViewCode"), F.when(F.col("new_spans") > 0, 50).otherwise(25))
        .otherwise(50)
    )
    return steps.withColumn("reward", F.coalesce(F.try_element_at(table, F.col("fail_reason")), by_action))


def combined_reward(a, b):
    return F.floor((a + b) / 2)


def dag_depth(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """The longest shortest path of a dependency graph (one row, `depth`), from (node_id, depends_on)."""
    paths = edges.select(F.col("node_id").alias("a"), F.col("depends_on").alias("b"), F.lit(1).alias("d"))
    best = settled(paths.groupBy("a", "b").agg(F.min("d").alias("d")))
    size, k = best.agg(F.count("*"), F.sum("d")).first(), 1
    while k < most:
        longer = best.alias("x").join(best.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b", (F.col("x.d") + F.col("y.d")).alias("d"))
        best = settled(best.union(longer).groupBy("a", "b").agg(F.min("d").alias("d")))
        if (now := best.agg(F.count("*"), F.sum("d")).first()) == size:
            break
        size, k = now, 2 * k
    return best.agg(F.coalesce(F.max("d"), F.lit(0)).alias("depth"))


def modules(files: DataFrame, path: str = "file") -> DataFrame:
    """Module tree from file paths: (module_id, parent_id, depth, name, is_package); hidden folders are left out, root
    files are modules unless __init__."""
    parts = F.split(F.regexp_replace(path, r"\.py$", ""), "/")
    rows = files.where(~F.col(path).rlike(r"(^|/)\.")).select(parts.alias("p"))
    heads = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.struct(F.slice("p", 1, n).alias("path"), (n < F.size("p")).alias("folder")))).alias("x"))
    ids = heads.select(F.array_join("x.path", ".").alias("module_id"), F.size("x.path").alias("depth"), F.element_at("x.path", -1).alias("name"), "x.folder")
    ids = ids.where("folder or name <> '__init__'").groupBy("module_id", "depth", "name").agg(F.max("folder").alias("is_package"))
    parent = F.when(F.col("depth") > 1, F.regexp_replace("module_id", r"\.[^.]*$", ""))
    return ids.select("module_id", parent.alias("parent_id"), "depth", "name", "is_package")
