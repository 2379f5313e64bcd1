"""Feedback on a search tree's nodes: what a model is told of the attempts, and which node its replies choose.

Nodes are (search_id, node_id, parent_id, pos, action, args, observation, reward, explanation, feedback), replies come from a
port; everything around them is columns. A node's siblings are bounded by the expansions of its parent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import evaluation, tree

#: Bounds of the reward scale's entries, best first.
REWARD_SCALE = ((75, 100), (50, 74), (25, 49), (0, 24), (-49, -1), (-100, -50))
#: Up to this many steps a trajectory counts as exploring.
EXPLORING = 3
CRITERIA = {
    True: ("Exploration: early searches need not find anything yet.", "Fit: the action suits what is known so far."),
    False: ("Quality: the step fits the question and breaks nothing.", "Progress: the step builds on what was found.", "Repetition: the step doesn't repeat what failed."),
}
REPLY = "analysis string, feedback string, suggested_node_id long"
TRIES = 3


def criteria(length: Column) -> Column:
    """What a step is judged by, from the length of its trajectory."""
    return F.when(length < EXPLORING, F.array(*map(F.lit, CRITERIA[True]))).otherwise(F.array(*map(F.lit, CRITERIA[False])))


def reward_range(scales: DataFrame, *keys: str) -> DataFrame:
    """(keys, min_reward, max_reward) of scale entries (keys, min_value, max_value)."""
    return scales.groupBy(*keys).agg(F.min("min_value").alias("min_reward"), F.max("max_value").alias("max_reward"))


def suggested(nodes: DataFrame) -> DataFrame:
    """(search_id, node_id): the first node by pos whose feedback suggests that node itself, else the greatest id."""
    own = F.when(F.col("suggested_node_id") == F.col("node_id"), F.struct("pos", "node_id"))
    return nodes.groupBy("search_id").agg(F.coalesce(F.min(own)["node_id"], F.max("node_id")).alias("node_id"))


def chosen(nodes: DataFrame, replies: DataFrame, tries: int = TRIES) -> DataFrame:
    """(search_id, node_id, by): what replies (search_id, attempt, reply) choose of the nodes.

    A reply's node is the one that it names, else its first number. The first of the first `tries` replies that chooses a
    node of the search counts; without one, the first node by pos does. A search with one node asks nobody."""
    named = F.coalesce(T.node_id(F.col("reply")), F.regexp_extract("reply", r"\d+", 0).try_cast("int"))
    asked = replies.where(F.col("attempt") <= tries).select("search_id", "attempt", named.cast("long").alias("node_id"))
    hit = asked.join(nodes.select("search_id", "node_id").distinct(), ["search_id", "node_id"]).groupBy("search_id").agg(F.min_by("node_id", "attempt").alias("_hit"))
    first = nodes.groupBy("search_id").agg(F.min_by("node_id", "pos").alias("_first"), F.count("*").alias("_n"))
    rows = first.join(hit, "search_id", "left").withColumn("_hit", F.when(F.col("_n") > 1, F.col("_hit")))
    by = F.when(F.col("_n") == 1, "only").when(F.col("_hit").isNotNull(), "reply").otherwise("first")
    return rows.select("search_id", F.coalesce("_hit", "_first").alias("node_id"), by.alias("by"))


def previous_attempts(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(node_id, attempt, solution_id, reward, explanation, feedback): for each node the finished leaves of its tree with a
    lower id, numbered in the order of the walk; feedback is the first on the way from the root to the leaf."""
    walk = tree.preorder(paths)
    roots = tree.depths(paths).select("node_id", "root_id")
    done = tree.leaves(nodes).where("action = 'Finish'").select(F.col("node_id").alias("solution_id"), "reward", "explanation")
    given = nodes.where("feedback is not null").select(F.col("node_id").alias("ancestor_id"), F.col("feedback").alias("_f"))
    said = paths.join(given, "ancestor_id").groupBy(F.col("node_id").alias("solution_id")).agg(F.max_by("_f", "distance").alias("feedback"))
    place = walk.join(roots, "node_id").select(F.col("node_id").alias("solution_id"), "root_id", "preorder")
    ends = done.join(place, "solution_id").join(said, "solution_id", "left")
    rows = roots.join(ends, "root_id").where("solution_id < node_id")
    n = F.row_number().over(Window.partitionBy("node_id").orderBy("preorder"))
    return rows.select("node_id", n.alias("attempt"), "solution_id", "reward", "explanation", "feedback")


def relatives(nodes: DataFrame) -> DataFrame:
    """(node_id, parent_id, siblings, children): ids in order; a root has no siblings."""
    kids = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("_p")).agg(F.array_sort(F.collect_list("node_id")).alias("_kids"))
    none = F.array().cast(f"array<{dict(nodes.dtypes)['node_id']}>")
    beside = nodes.select("node_id", "parent_id").join(kids.withColumnRenamed("_p", "parent_id"), "parent_id", "left")
    beside = beside.select("node_id", "parent_id", F.coalesce(F.filter("_kids", lambda k: k != F.col("node_id")), none).alias("siblings"))
    below = kids.select(F.col("_p").alias("node_id"), F.col("_kids").alias("children"))
    return beside.join(below, "node_id", "left").withColumn("children", F.coalesce("children", none))


def analyses(nodes: DataFrame) -> DataFrame:
    """(node_id, relations, attempts, finished): what a model is told of each node that has a parent: where it stands, what
    its siblings that acted did and saw, and whether one of them finished."""
    ids = lambda c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]"))
    stands = F.format_string("Current node: %d\nParent node: %d\nSibling nodes: %s\nChild nodes: %s", "node_id", "parent_id", ids("siblings"), ids("children"))
    nz = lambda c: F.coalesce(F.col(c), F.lit(""))
    seen = F.when(nz("observation") != "", F.concat(F.lit("\nObservation:\n"), F.col("observation"))).otherwise("")
    said = F.concat(F.format_string("<attempt_%d>\nAction: %s(%s)", "node_id", nz("action"), nz("args")), seen, F.format_string("\n</attempt_%d>", "node_id"))
    did = nodes.where("parent_id is not null and action is not null").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "action", said.alias("said")))).alias("_did"))
    rows = relatives(nodes).where("parent_id is not null").join(did, "parent_id", "left")
    rows = rows.withColumn("_others", F.filter("_did", lambda x: x["node_id"] != F.col("node_id")))
    return rows.select(
        "node_id", stands.alias("relations"), F.coalesce(F.array_join(F.transform("_others", lambda x: x["said"]), "\n\n"), F.lit("")).alias("attempts"),
        F.coalesce(F.exists("_others", lambda x: x["action"] == "Finish"), F.lit(False)).alias("finished"),
    )


def generated(nodes: DataFrame, port: Callable[[list[str]], list[str]], suggest: bool = True) -> DataFrame:
    """(node_id, analysis, feedback, suggested_node_id) of the nodes that have a parent, by a model's reply; a reply that is
    no JSON gives nulls. Without `suggest` no node is suggested."""
    warning = F.when(F.col("finished"), "\n\nA sibling has finished already: look for another way.").otherwise("")
    prompt = F.concat(F.lit("Judge the current node and say what to do next. Reply as JSON with analysis, feedback, suggested_node_id.\n\n"), "relations", F.lit("\n\n"), "attempts", warning)
    said = evaluation.asked(analyses(nodes), port, prompt).withColumn("_r", T.parsed_reply(F.col("reply"), REPLY))
    return said.select("node_id", "_r.analysis", "_r.feedback", (F.col("_r.suggested_node_id") if suggest else F.lit(None).cast("long")).alias("suggested_node_id"))


def log(entries: DataFrame) -> DataFrame:
    """(node_id, entry): each node's feedback as text to append to a log, from (node_id, at, system, messages, reply)."""
    rule, thin = "=" * 80, "-" * 80
    nz = lambda c, spare: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(spare))
    each = F.transform("messages", lambda m, i: F.concat(F.format_string("[Message %d - %s]\n", i + 1, m["role"]), m["content"], F.lit("\n" + "-" * 40 + "\n")))
    at = F.date_format("at", "yyyy-MM-dd HH:mm:ss")
    text = F.concat_ws(
        "\n", F.lit(rule), F.format_string("Node %d - %s", "node_id", at), F.lit(rule), F.lit(""), F.lit("SYSTEM PROMPT"), F.lit(thin), nz("system", "No system prompt provided"),
        F.lit(""), F.lit("MESSAGES"), F.lit(thin), each, F.lit("COMPLETION"), F.lit(thin), nz("reply", "No raw completion provided"), F.lit(""), F.lit(rule), F.lit(""),
    )
    return entries.select("node_id", text.alias("entry"))
