"""Chat formatting with cumulative-snapshot collapse; DataFrame functions only.

Logged conversations often hold growing snapshots of one exchange. Every turn gets a hash of its place, role and text;
the exclusive-or of these over a conversation's first k turns is the hash of its k-turn prefix, rolled along by a window.
A conversation whose whole hash is a proper prefix hash of a longer one is a snapshot and goes, by an anti-join; of equal
conversations the least conv_id stays. What is left is maximal, and is rendered.

Two 64-bit hashes with different seeds make one 128-bit key. Prefixes are made distinct before the join, so a first turn
that all conversations share is one row there. Hashes move, texts only once, to be rendered.

Defined results: turns order by turn (null first), equal turns by hash; null role or text renders as empty, but is not
equal to empty; a null conv_id is one conversation; repeated rows are repeated turns; no rows render nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled

_KEY = ["n", "h1", "h2"]


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, n (turns so far), h1, h2 (hash of the prefix), size (turns in all)."""
    hashed = turns.select("conv_id", "turn", *[F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias(f"t{seed}") for seed in (1, 2)])
    every = Window.partitionBy("conv_id")
    order = every.orderBy("turn", "t1", "t2")
    rows = hashed.withColumn("n", F.row_number().over(order))
    rows = rows.withColumns({f"x{s}": F.xxhash64(F.lit(s), "n", f"t{s}") for s in (1, 2)})
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("conv_id", "n", F.bit_xor("x1").over(so_far).alias("h1"), F.bit_xor("x2").over(so_far).alias("h2"), F.count("*").over(every).alias("size"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations, itself included) of the conversations that stay."""
    rolled = settled(prefixes(turns))
    shorter = rolled.where("n < size").select(*_KEY).distinct()
    whole = rolled.where("n = size").groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    kept = whole.join(shorter, _KEY, "left_anti")
    return kept.select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat: the maximal conversations in role blocks. Turns meet the kept conversations before
    they are gathered, by one key that both steps share: few of them are sent to the turns, many meet where they lie."""
    key = F.struct(F.col("conv_id").alias("id"))  # null is an id like others inside a struct
    kept = maximal(turns).select(key.alias("_key"), "n_turns", "n_copies")
    hashed = [F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias(f"t{seed}") for seed in (1, 2)]
    parts = turns.select(key.alias("_key"), F.struct("turn", *hashed, "role", "text").alias("p"))
    lists = parts.join(kept, "_key").groupBy("_key", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("p")).alias("parts"))
    block = lambda p: F.concat(F.lit("<|im_start|>"), F.coalesce(p["role"], F.lit("")), F.lit("\n"), F.coalesce(p["text"], F.lit("")), F.lit("<|im_end|>\n"))
    return lists.select("_key.id", "n_turns", "n_copies", F.array_join(F.transform("parts", block), "").alias("chat")).withColumnRenamed("id", "conv_id")


#: DuckDB SQL for the query: prefixes as lists of turns, compared whole.
ORACLE = """
WITH t AS (
  SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn, role, text) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS chat
  FROM conversations GROUP BY conv_id),
w AS (SELECT turns, any_value(chat) AS chat, min(conv_id) AS conv_id, count(*) AS n_copies, len(turns) AS n FROM t GROUP BY turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM w, generate_series(1, 10000) AS g(k) WHERE k < n)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, n_copies, chat FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = w.turns)
"""
