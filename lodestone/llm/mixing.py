"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

1. Sizes are words. Sources, by code point with null last, share `share` times all words by repeating weights; a target
   stops at `cap` times its source's size, the excess is dealt again by weight among the others.
2. Each source falls into blocks by a keyed hash of its rows. Shards hold about SHARD_WORDS words, SHARDS at least; there
   are BLOCKS_PER_SHARD blocks for each over all sources, BLOCKS at least and MOST_BLOCKS at most, and one for each source.
   So shards stay of one size as data grow, and the block table, which goes to the driver, is bounded.
3. A source gives whole passes over its blocks, then further blocks in permuted order until its target; the block in
   which the target ends gives rows in hash order, the last row its first words. So each source's words meet its target.
4. The draws (source, pass, block) are split among output shards by a binary tree: a node's draws go left or right by a
   multivariate hypergeometric sample of the source counts, which fixes every shard's quota of each source exactly.
   Within a source, draws go to shards in permuted order: disjoint, permuted blocks. A shard's rows are shuffled by hash.

Rows decide by (source, block, hash) alone, so texts are never moved to plan the mix, and a rerun decides alike.

Defined results: null text has size 0 and is never taken; null source is a source of its own, after all others;
repeated rows (equal doc_id, source, size) are taken alike, the last words shared evenly among them; a source without
words has target 0; an empty table mixes to nothing. One row for each source goes to the driver: weights are given per
source, so sources are few.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settled

SHARE = 1.5
WEIGHTS = (5, 2, 1)
CAP = 2.0
BLOCKS, BLOCKS_PER_SHARD, MOST_BLOCKS = 4096, 16, 1 << 20
SHARDS, SHARD_WORDS = 64, 1 << 26
#: Rows of the block table that are broadcast; a longer one is joined as Spark chooses.
MOST_BROADCAST = 100_000
SEED = 20_240_229

_WORD = r"[^\x20\x09-\x0D]+"


def size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> list[float]:
    """Words that each source is to give, sources in their order."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    rest, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if rest * weight[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weight[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        rest -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def quotas(draws: list[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws of each source for each shard: int[shards, sources]; shards get equally many draws, within one."""
    out = np.zeros((shards, len(draws)), np.int64)

    def split(first: int, n: int, counts: np.ndarray) -> None:
        if n == 1:
            out[first] = counts
            return
        half = n // 2
        total = int(counts.sum())
        left = rng.multivariate_hypergeometric(counts, total * half // n, method="marginals")
        split(first, half, left)
        split(first + half, n - half, counts - left)

    if len(draws):
        split(0, shards, np.array(draws, np.int64))
    return out


def _hashed(docs: DataFrame, seed: int) -> DataFrame:
    """source, _size, _hash, and the whole row as `_row`, so that no column of docs can clash."""
    rows = docs.select("source", "doc_id", size().alias("_size"), F.struct(*docs.columns).alias("_row"))
    return rows.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "source", "_size")).drop("doc_id")


def planned(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """_row (a row of docs), _size, _source_size, _target, and _draws: array of (pass, shard, words), empty if never taken."""
    return _planned(docs, share, weights, cap, shards, seed)[0]


def _planned(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, int]:
    """The plan, and the number of shards."""
    spark = docs.sparkSession
    small = settled(_hashed(docs, seed).select("source", "_size", "_hash"))
    totals = sorted(((r["source"], r["n"]) for r in small.groupBy("source").agg(F.sum("_size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in totals]
    aims = targets(sizes, share, weights, cap)
    every = max(1, sum(sizes))
    shards = shards or max(SHARDS, math.ceil(sum(aims) / SHARD_WORDS))
    most = min(MOST_BLOCKS, max(BLOCKS, BLOCKS_PER_SHARD * shards))
    blocks = [max(1, round(most * n / every)) for n in sizes]
    kinds = "source string, _i int, _source_size long, _target double, _blocks int"
    sources = spark.createDataFrame([(s, i, sizes[i], aims[i], blocks[i]) for i, (s, _) in enumerate(totals)], kinds)

    def in_blocks(rows: DataFrame) -> DataFrame:
        # A row for each source: far below any broadcast limit, or Spark's own choice of join when not.
        table = F.broadcast(sources) if len(totals) < 50_000 else sources
        joined = rows.join(table.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        return joined.withColumn("_block", F.pmod("_hash", F.col("_blocks").cast("long")).cast("int"))

    rng = np.random.default_rng(seed)
    held: list[dict[int, int]] = [{} for _ in totals]
    for r in in_blocks(small).groupBy("_i", "_block").agg(F.sum("_size").alias("n")).collect():  # MOST_BLOCKS + sources rows at most
        held[r["_i"]][r["_block"]] = r["n"]
    draws: list[list[tuple[int, int, int]]] = []  # of each source: (pass, block, words)
    for i, n in enumerate(sizes):
        own: list[tuple[int, int, int]] = []
        whole = int(aims[i] // n) if n else 0
        left = round(aims[i] - whole * n)
        for turn in range(whole + 1):
            order = rng.permutation(np.array(sorted(held[i]), np.int64)).tolist()
            for b in order:
                take = held[i][b] if turn < whole else min(left, held[i][b])
                if turn == whole:
                    left -= take
                if take:
                    own.append((turn, b, take))
        draws.append(own)
    share_out = quotas([len(x) for x in draws], shards, rng)
    plan: dict[tuple[int, int], list[tuple[int, int, int]]] = {(i, b): [] for i, x in enumerate(held) for b in x}
    parts: dict[tuple[int, int], int] = {}
    for i, own in enumerate(draws):
        shard = np.repeat(np.arange(shards), share_out[:, i]).tolist()
        for (turn, b, take), s in zip(own, shard):
            whole = take == held[i][b]
            plan[i, b].append((turn, s, int(whole)))
            if not whole:
                parts[i, b] = take
    # The row in which a source's target ends: its hash, and what each row of that hash gives.
    edges: dict[int, tuple[int, int]] = {}
    if parts:
        cut = spark.createDataFrame([(i, b, n) for (i, b), n in parts.items()], "_i int, _block int, _quota long")
        rows = in_blocks(small).where("_size > 0").join(F.broadcast(cut), ["_i", "_block"]).groupBy("_i", "_quota", "_hash").agg(F.sum("_size").alias("n"), F.count("*").alias("m"))
        rows = rows.withColumn("before", F.expr("sum(n) over (partition by _i order by _hash) - n")).where("before < _quota and before + n >= _quota")
        edges = {r["_i"]: (r["_hash"], (r["_quota"] - r["before"]) // r["m"]) for r in rows.collect()}
    listed = [(i, b, d, *edges.get(i, (0, 0))) for (i, b), d in plan.items()]
    table = spark.createDataFrame(listed, "_i int, _block int, _plan array<struct<pass:int,shard:int,whole:int>>, _edge long, _last long")
    rows = in_blocks(_hashed(docs, seed)).join(F.broadcast(table) if len(listed) <= MOST_BROADCAST else table, ["_i", "_block"], "left")
    words = lambda d: F.when((d["whole"] == 1) | (F.col("_hash") < F.col("_edge")), F.col("_size")).when(F.col("_hash") == F.col("_edge"), F.col("_last")).otherwise(F.lit(0))
    taken = F.transform("_plan", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), words(d).cast("long").alias("words")))
    taken = F.filter(F.coalesce(taken, F.array().cast("array<struct<pass:int,shard:int,words:bigint>>")), lambda d: d["words"] > 0)
    return rows.withColumn("_draws", taken).drop("_i", "_block", "_blocks", "_plan", "_edge", "_last", "source"), shards


def taken() -> Column:
    """Words that the mix takes of a planned row, repeats counted."""
    return F.aggregate("_draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])


def shards_of() -> Column:
    """Shards of a planned row's draws, pass by pass."""
    return F.transform("_draws", lambda d: d["shard"])


def mixed(docs: DataFrame, with_shard: bool = False, **options) -> DataFrame:
    """The mix itself: a row of docs for each draw, in its shard's partition and shuffled there.

    with_shard: (_row, _shard) instead of docs' own columns.
    A row that gives only its first words has its text cut after them, and n_chars to match."""
    rows, shards = _planned(docs, **options)
    rows = rows.withColumn("_draw", F.explode("_draws"))
    cut = F.col("_draw.words") < F.col("_size")
    first = F.regexp_extract_all("_row.text", F.lit(r"[\x20\x09-\x0D]*" + _WORD), F.lit(0))
    text = F.when(cut, F.array_join(F.slice(first, 1, F.col("_draw.words").cast("int")), "")).otherwise(F.col("_row.text"))
    row = F.col("_row").withField("text", text)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        row = row.withField("n_chars", F.when(cut, F.length(text).cast(kind)).otherwise(F.col("_row.n_chars")))
    rows = rows.select(row.alias("_row"), F.col("_draw.shard").alias("_shard"), F.xxhash64("_hash", "_draw.pass").alias("_order"))
    rows = rows.repartitionById(shards, "_shard").sortWithinPartitions("_shard", "_order")
    return rows.select("_row.*") if not with_shard else rows.select("_row", "_shard")
