"""Vector search: exact top-k over all rows for a stated query set, in blocks.

Each Arrow batch meets the queries as a matrix product; a batch keeps k rows for each query, and one window by query
ranks what is left. Queries are split into blocks of BLOCK rows, so neither side's matrix grows with the other.
Distances are worked out in double precision. Squared L2 ranks ascending, cosine descending.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

BLOCK = 1024
#: Most queries that are sent to the executors at once; larger sets are searched in parts, by a hash of their ids.
MOST_QUERIES = 100_000


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def topk(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", metric: str = "l2", itself: bool = True) -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, query): the k nearest; ties by id (cosine: larger id first)."""
    asked = queries.where("query is not null").select("query_id", "query")
    parts = -(-asked.count() // MOST_QUERIES)
    if parts > 1:
        parts += parts // 4 + 1  # parts by hash are uneven
        each = [settled(_topk(vectors, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i), k, id, vector, metric, itself)) for i in range(parts)]
        return reduce(DataFrame.union, each)
    return _topk(vectors, asked, k, id, vector, metric, itself)


def _topk(vectors: DataFrame, queries: DataFrame, k: int, id: str, vector: str, metric: str, itself: bool) -> DataFrame:
    asked = queries.collect()
    kind = dict(vectors.dtypes)[id]
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {id} {kind}, score double"
    ids = [r["query_id"] for r in asked]
    shared = vectors.sparkSession.sparkContext.broadcast((ids, np.array([r["query"] for r in asked], np.float64)))
    query_type = pa.int64() if "int" in dict(queries.dtypes)["query_id"] else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, every = shared.value
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            rows, own = _matrix(batch.column(vector)), batch.column(id)
            order = np.array(own.to_pylist())
            for at in range(0, len(names), BLOCK):
                q = every[at : at + BLOCK]
                if metric == "l2":
                    score = np.maximum((q * q).sum(1)[:, None] + (rows * rows).sum(1)[None] - 2 * q @ rows.T, 0.0)
                    rank = score
                else:
                    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None]
                    score = np.divide(q @ rows.T, norms, out=np.zeros((len(q), len(rows))), where=norms > 0)
                    rank = -score
                if not itself:
                    rank = np.where(np.array(names[at : at + BLOCK])[:, None] == order[None], np.inf, rank)
                m = min(k, len(rows))
                # The k-th value of each query; all rows up to it stay, so that ties are settled by the window.
                edge = np.partition(rank, m - 1, axis=1)[:, m - 1 : m] + 1e-9
                if metric == "l2":
                    # The product form is off by a rounding error of the squared norms; exact distances decide below.
                    edge = edge + 1e-12 * ((q * q).sum(1)[:, None] + (rows * rows).sum(1).max())
                i, j = np.nonzero((rank <= edge) & np.isfinite(rank))
                if metric == "l2":
                    exact = ((q[i] - rows[j]) ** 2).sum(1)
                else:
                    exact = score[i, j]
                yield pa.RecordBatch.from_arrays([pa.array([names[at + x] for x in i], query_type), own.take(pa.array(j)), pa.array(exact)], names=["query_id", id, "score"])

    near = vectors.select(id, vector).where(F.col(vector).isNotNull()).mapInArrow(run, schema)
    order = (F.round("score", 9), F.col(id)) if metric == "l2" else (F.desc(F.round("score", 9)), F.desc(id))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def filtered(hits: DataFrame, metadata: DataFrame, condition, id: str = "vec_id") -> DataFrame:
    """Conditions after the rank, as post-filters: fewer than k may stay, ranks don't move."""
    return hits.join(metadata, id).where(condition)


def squared_l2(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def appended(vectors: DataFrame, new: DataFrame, text: str = "text") -> DataFrame:
    """The store with new rows; ids are content hashes, so a second add can't take an id over."""
    keyed = new.withColumn("vec_id", F.xxhash64(text))
    return vectors.unionByName(keyed.join(vectors.select("vec_id"), "vec_id", "left_anti"), allowMissingColumns=True)


def without_documents(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """The store without documents' vectors, as written at the next persist."""
    return vectors.join(gone, "doc_id", "left_anti")


def best_first(nodes: DataFrame, score: str = "score") -> DataFrame:
    """The highest score; the first of equal ones."""
    return nodes.orderBy(F.desc(score), "pos").limit(1)


def softmax_sample(nodes: DataFrame, draws: int, seed: int = 0, score: str = "score") -> DataFrame:
    """(draw, node_id): nodes drawn by softmax of their scores. Candidates of one choice are few, so one group holds them."""
    w = Window.partitionBy(F.lit(0))
    order = w.orderBy("node_id")
    p = nodes.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w))).withColumn("_hi", F.sum("_e").over(order) / F.sum("_e").over(w))
    p = p.withColumn("_lo", F.coalesce(F.lag("_hi").over(order), F.lit(0.0)))
    tries = nodes.sparkSession.range(draws).select(F.col("id").alias("draw"), F.rand(seed).alias("_u"))
    return tries.join(F.broadcast(p), (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select("draw", "node_id")


def sampled(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows at random."""
    return rows.orderBy(F.rand(seed)).limit(k)
