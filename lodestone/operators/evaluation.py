"""Judging, choosing and decomposing answers. Models sit behind ports; everything around them is columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from ..functions import text as T

BASIC = 2
LEAST = 3


def asked(rows: DataFrame, port: Callable[[list[str]], list[str]], prompt: Column, reply: str = "reply", tries: int = 3, batch: int = 100) -> DataFrame:
    """rows with the port's reply to a prompt, asked in batches; a batch that fails is tried again, then one by one; what
    still fails has a null reply. Ports must be idempotent: Spark may run a task again."""
    schema = StructType([*rows.schema.fields, StructField(reply, StringType())])

    def each(prompts: list[str]) -> list[str | None]:
        for _ in range(tries):
            try:
                return list(port(prompts))
            except Exception:
                continue
        return [None] if len(prompts) == 1 else [r for p in prompts for r in each([p])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies: list[str | None] = []
            prompts = frame["_prompt"].tolist()
            for at in range(0, len(prompts), batch):
                replies += each(prompts[at : at + batch])
            frame = frame.drop(columns="_prompt")
            frame[reply] = replies
            yield frame

    return rows.withColumn("_prompt", prompt).mapInPandas(run, schema)


def judged(rows: DataFrame, port: Callable[[list[str]], list[str]]) -> DataFrame:
    """score (1 to 5; BASIC where the reply is no judgement) and reasoning of question, answer, ground_truth rows."""
    prompt = T.judge_prompt(F.col("question"), F.col("answer"), F.col("ground_truth"))
    said = asked(rows, port, prompt).withColumn("_j", T.parsed_reply(F.col("reply"), schemas.EVALUATION))
    valid = F.col("_j.score").between(1, 5)
    return said.select(*rows.columns, F.when(valid, F.col("_j.score")).otherwise(BASIC).alias("score"), F.when(valid, F.col("_j.reasoning")).alias("reasoning"))


def kept(rows: DataFrame, least: int = LEAST) -> DataFrame:
    return rows.where(F.col("score") >= least)


NO_CONTEXT = "No relevant code found."


def rag_answers(rows: DataFrame, port: Callable[[list[str]], list[str]]) -> DataFrame:
    """Answers from each question's own code list; questions without code get a fixed sentence and aren't asked."""
    with_code = F.size(F.coalesce("codes", F.array().cast("array<string>"))) > 0
    said = asked(rows.where(with_code), port, T.rag_prompt(F.col("question"), T.code_list(F.col("codes"))))
    said = said.withColumn("_r", T.parsed_reply(F.col("reply"), schemas.RESULT_PAIR))
    answered = said.select(*rows.columns, F.col("_r.answer").alias("rag_answer"), F.col("_r.ground_truth").alias("rag_ground_truth"), F.col("_r.thought").alias("rag_thought"))
    return answered.unionByName(rows.where(~with_code).withColumns({"rag_answer": F.lit(NO_CONTEXT), "rag_ground_truth": F.lit(None).cast("string"), "rag_thought": F.lit(None).cast("string")}))


def best_of_three(rag: Column, decompose: Column, tree: Column) -> Column:
    """rag or decompose only if strictly above both others; else tree, also when it scored lowest."""
    return F.when((rag > decompose) & (rag > tree), "rag").when((decompose > rag) & (decompose > tree), "decompose").otherwise("tree")


def picked(direct: Column, decomposed: Column, contracted: Column) -> Column:
    """0, 1 or 2: the answer with the highest score, the first of equal ones; all equal: direct."""
    return F.when((direct >= decomposed) & (direct >= contracted), 0).when(decomposed >= contracted, 1).otherwise(2)


def decomposed(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Sub-questions of replies: (…, position, description, answer, dependencies, is_independent)."""
    parsed = rows.withColumn("_d", T.parsed_reply(F.col(reply), schemas.DECOMPOSITION))
    subs = parsed.select(*rows.columns, F.posexplode(F.col("_d").getField("sub-questions")).alias("position", "s"))
    return subs.select(*rows.columns, "position", "s.*").withColumn("is_independent", F.size(F.coalesce("dependencies", F.array().cast("array<int>"))) == 0)


def capped_depth(depth: Column) -> Column:
    return F.least(depth, F.lit(3))


def chosen_action(reply: Column, names: list[str]) -> Column:
    """The first action name that a reply holds."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.contains(reply, F.lit(n)), n).otherwise(out)
    return out


def batches(rows: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """`batch` of rows in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size))


def batch_scores(rows: DataFrame) -> DataFrame:
    return rows.groupBy("batch").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
