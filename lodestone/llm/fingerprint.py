"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a piece between newlines, exactly as it stands) is hashed to a wide vector of two parts:
- identity: `IDENTITY` words of 32 bits from SHAKE-128, added modulo 2^32. Equal multisets of paragraphs, in any order,
  have equal sums; a paragraph is inserted by adding its vector and deleted by subtracting it.
- likeness: `LANES` signed counters added modulo 2^16. Each shingle of `SHINGLE` words of the paragraph (fewer words:
  all of them) adds +1 or -1 to one lane. Inner products of such sums estimate those of the shingle counts.

A fingerprint is the base64 text of both parts, so `likeness(x, y)` needs the two strings alone:
2<x,y> / (<x,x> + <y,y>) over the lanes, within 0 and 1; 1 for equal fingerprints. Its standard error is about
LANES ** -0.5; lanes hold up to about 4e7 shingles a document before the modulus shows.

Defined results: null text counts as empty (one empty paragraph); any two texts with the same lines in another order
have equal fingerprints; repeated rows get equal fingerprints; no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import SLICE_BYTES, mapped, slices, strings, widened, words

IDENTITY = 32
LANES = 256
SHINGLE = 3

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(identity uint32[n, IDENTITY], lanes int16[n, LANES]) of texts: the sums of their paragraphs' vectors."""
    n = len(texts)
    lists = pc.split_pattern(texts, "\n")
    paragraphs = lists.flatten()
    per = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(n), per)
    wide = b"".join(hashlib.shake_128(p).digest(4 * IDENTITY) for p in paragraphs.cast(pa.large_binary()).to_pylist())
    identity = np.zeros((n, IDENTITY), np.uint32)
    if n:
        identity = np.add.reduceat(np.frombuffer(wide, "<u4").reshape(-1, IDENTITY), np.cumsum(per) - per, axis=0, dtype=np.uint32)
    count, flat = words(paragraphs)
    lanes = np.zeros(n * LANES, np.float64)
    if len(flat):
        coded = flat.dictionary_encode()
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
        h = own[coded.indices.to_numpy(zero_copy_only=False)]
        place = np.repeat(np.arange(len(count)), count)
        size = np.minimum(count[place], SHINGLE)
        begins = np.cumsum(count) - count
        within = np.arange(len(h)) - begins[place]
        at = np.flatnonzero(within + size <= count[place])
        mix = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            there = size[at] > k
            mix[there] += _mixed(h[at[there] + k] * _ODD[k] + np.uint64(k))
        mix = _mixed(mix)
        lane = owner[place[at]] * LANES + (mix >> np.uint64(8)).astype(np.int64) % LANES
        lanes = np.bincount(lane, weights=np.where(mix & np.uint64(1), 1.0, -1.0), minlength=n * LANES)
    return identity, lanes.astype(np.int64).astype(np.int16).reshape(n, LANES)


def packed(identity: np.ndarray, lanes: np.ndarray) -> list[str]:
    raw = np.concatenate([identity.astype("<u4").view(np.uint8), lanes.astype("<i2").view(np.uint8)], axis=1)
    return [base64.b64encode(x).decode() for x in raw]


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 4 * IDENTITY], "<u4"), np.frombuffer(raw[4 * IDENTITY :], "<i2")


def inserted(x: tuple, y: tuple) -> tuple:
    """The sums with y's paragraphs added."""
    return x[0] + y[0], x[1] + y[1]


def deleted(x: tuple, y: tuple) -> tuple:
    """The sums with y's paragraphs taken away."""
    return x[0] - y[0], x[1] - y[1]


def alike(x: tuple, y: tuple) -> np.ndarray:
    """Likeness of each row of x to the same row of y."""
    a, b = x[1].astype(np.float64), y[1].astype(np.float64)
    both = (a * a).sum(1) + (b * b).sum(1)
    near = np.divide(2 * (a * b).sum(1), both, out=np.zeros(len(a)), where=both > 0)
    return np.where((x[0] == y[0]).all(1) & (x[1] == y[1]).all(1), 1.0, np.clip(near, 0.0, 1.0))


def likeness(x: str, y: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    return float(alike(*(tuple(p[None] for p in unpacked(f)) for f in (x, y)))[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with a column `fingerprint` of its `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                fp = packed(*vectors(strings(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, pa.string())], names=[*batch.schema.names, "fingerprint"])

    docs = docs.drop("fingerprint")
    return mapped(docs, run, widened(docs.schema, fingerprint=StringType()))


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as many code points of the following text, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


def _compared(ids: list, texts: list[str], names: list[str]) -> pa.RecordBatch:
    """Rows for texts[:-1], each followed by the next in the list.

    The edited fingerprint comes from the text's own by deleting the paragraphs from the cut on and inserting the new."""
    lost, put, whole = [], [], []
    for t, after in zip(texts, texts[1:]):
        e = edited(t, after)
        keep = len(t) - len(t) // 3
        at = t.rfind("\n", 0, keep) + 1
        lost.append(t[at:])
        put.append(e[at:])
        whole.append(hashlib.sha256(e.encode()).hexdigest())
    large = lambda x: pa.array(x, pa.large_string())
    every = vectors(large(texts))
    own, after = tuple(x[:-1] for x in every), tuple(x[1:] for x in every)
    new = inserted(deleted(own, vectors(large(lost))), vectors(large(put)))
    columns = [ids, pa.array(map(len, texts[:-1]), pa.int64()), whole, packed(*own), packed(*new), alike(own, new), alike(own, after)]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    The following document is the one with the next smaller doc_id (null last; equal ids by text); the first follows
    the last. One pass over the ids finds range splits and each range's first id; then texts move once, by range,
    with a copy of each range's first row behind the range before it."""
    spark = docs.sparkSession
    low = F.lit(-(2**63))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), low).alias("_key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = keyed.agg(F.percentile_approx("_key", F.lit([i / n for i in range(1, n)] or [0.5]), 10_000)).first()[0] if n > 1 else []
    splits = np.array(sorted(~int(x) for x in set(marks or [])), dtype=np.int64)  # ~key grows as the key falls

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, ~key.to_numpy(np.int64)).astype(np.int32))

    placed = keyed.withColumn("_range", place("_key"))
    heads = sorted((r["_range"], r["first"]) for r in placed.groupBy("_range").agg(F.max("_key").alias("first")).collect())
    firsts = np.array([~x for _, x in heads], dtype=np.int64)
    before = np.array([heads[i - 1][0] for i in range(len(heads))], dtype=np.int32)

    @F.pandas_udf("array<int>")
    def ahead(key: pd.Series) -> pd.Series:
        """The range whose last row this row follows, if any."""
        k = ~key.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(firsts, k), len(firsts) - 1)
        return pd.Series([[int(before[i])] if hit else [] for i, hit in zip(at, firsts[at] == k)])

    copies = F.concat(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("x"))), F.transform(ahead("_key"), lambda r: F.struct(r.alias("r"), F.lit(1).alias("x"))))
    dealt = placed.select("_key", "doc_id", "text", F.explode(copies).alias("c")).select("_key", "doc_id", "text", "c.r", "c.x")
    dealt = dealt.repartitionById(n, "r").sortWithinPartitions("r", "x", F.desc("_key"), "text").drop("_key")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, inside, last = [], [], 0, None, 0
        for batch in batches:
            for doc, text, r, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "r", "x"))):
                if r != inside:
                    if ids and last == 0:
                        raise ValueError("a range ended without its following row")
                    ids, texts, size, inside, last = [], [], 0, r, 0
                if last:
                    continue
                last = x
                texts.append(text)
                if x or size > SLICE_BYTES:
                    if ids:
                        yield _compared(pa.array(ids, batch.schema.field("doc_id").type), texts, names)
                    ids, texts, size = [], texts[-1:], 0
                ids.append(doc)
                size += len(text)

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(dealt, run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
