"""Best-fit packing by non-negative least squares over length patterns.

1. Documents become token ids plus id 0; only longer ones are cut, into pieces of `limit` tokens.
2. The histogram of piece lengths (at most `limit` rows, whatever the input) goes to the driver.
3. Length classes of limit / CLASSES tokens; patterns are the multisets of up to MOST_PARTS classes that fill a sequence.
   Non-negative least squares (active set) fits repeat counts to the class histogram, rounded down. Each repeat takes
   exact lengths from its classes, the last ones by best fit, so that sequences end full.
4. What is left is packed by best fit, longest first, whole runs of equal sequences at a time.
5. Pieces of one length are numbered within salts, so that a hot length spreads, and look their place up in the plan.

The plan holds runs: (length, first rank, sequences, offset). Each run of the plan uses up a length or a pattern, so it
is bounded by `limit` and the number of patterns, not by the input.

Defined results: null text counts as empty and has one piece (id 0 alone); ties and repeated rows (also of doc_id) each
get a place of their own; an empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import wordbpe
from .shared import mapped, settled, slices, strings, widened

LIMIT = 2048
CLASSES = 64
MOST_PARTS = 4
SALTS = 64
SEPARATOR = 0
#: Bytes of text whose ids are made at once; a worker's arrays take some 27 times as much.
ID_BYTES = 1 << 20


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, uint32; where each text's ids end), the separator after each text."""
    per, index, chunks = wordbpe.coded(texts)
    lists = [*wordbpe.load_ids(path).chunk_id_lists(chunks), np.array([SEPARATOR], "<u4").tobytes()]
    size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
    first = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(lists), "<u4")
    ends = np.cumsum(per)
    index = np.insert(index.astype(np.int64), ends, len(lists) - 1)
    n = size[index]
    done = np.cumsum(n)
    ids = flat[np.arange(done[-1] if len(done) else 0) + np.repeat(first[index] - (done - n), n)]
    return ids, done[ends + np.arange(len(per))] if len(per) else done


def pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=ID_BYTES):
                ids, ends = token_ids(strings(batch.column("text")), path)
                length = np.diff(ends, prepend=0)
                per = np.maximum(1, -(-length // limit))
                doc = np.repeat(np.arange(len(per)), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * limit
                size = np.minimum(limit, length[doc] - start)
                at = (ends - length)[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist())]
                columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(total: int = CLASSES, parts: int = MOST_PARTS) -> list[tuple[int, ...]]:
    """Multisets of 1 to `parts` classes, largest first, whose sizes add up to `total`."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < parts:
            for x in range(min(left, most), 0, -1):
                grow((*head, x), left - x, x)

    grow((), total, total)
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |a x - b| with x >= 0, by the active set method."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(3 * n):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        if gain.max(initial=-np.inf) <= slack:
            break
        passive[int(np.argmax(gain))] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (s <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x += step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = s
    return x


def plan(counts: np.ndarray, limit: int = LIMIT, classes: int = CLASSES, parts: int = MOST_PARTS) -> tuple[np.ndarray, int]:
    """(runs: length, first rank, sequences, first sequence, offset; number of sequences) for counts[length]."""
    left = counts.astype(np.int64).copy()
    ranks = np.zeros(limit + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    made = 0

    def longest(upto: int, above: int = 0) -> int:
        """The longest length left in (above, upto]; 0 if none."""
        there = np.flatnonzero(left[above + 1 : upto + 1])
        return int(there[-1]) + above + 1 if len(there) else 0

    def place(lengths: list[int], most: int) -> int:
        """As many sequences of these lengths as there are pieces for, `most` at most."""
        nonlocal made
        uses = {x: lengths.count(x) for x in lengths}
        n = min([most, *(int(left[x]) // k for x, k in uses.items())])
        offset = 0
        for x in lengths:
            runs.append((x, int(ranks[x]), n, made, offset))
            ranks[x] += n
            left[x] -= n
            offset += x
        made += n
        return n

    def filled(lengths: list[int]) -> list[int]:
        """The lengths, and best fits for the room they leave."""
        room = limit - sum(lengths)
        while room > 0:
            kept = [(x, lengths.count(x)) for x in set(lengths)]
            for x, k in kept:
                left[x] -= k
            fit = longest(room)
            for x, k in kept:
                left[x] += k
            if not fit:
                break
            lengths = [*lengths, fit]
            room -= fit
        return lengths

    width = limit // classes
    of = -(-np.arange(limit + 1) // width)
    shapes = patterns(classes, parts)
    matrix = np.zeros((classes, len(shapes)))
    for k, shape in enumerate(shapes):
        for c in shape:
            matrix[c - 1, k] += 1
    repeats = np.floor(nnls(matrix, np.bincount(of, weights=left, minlength=classes + 1)[1:]) + 1e-6).astype(np.int64)
    for k in sorted(np.flatnonzero(repeats), key=lambda k: tuple(-c for c in shapes[k])):
        todo = int(repeats[k])
        while todo:
            lengths: list[int] = []
            for c in shapes[k][:-1]:
                taken = {x: lengths.count(x) for x in lengths}
                for x, m in taken.items():
                    left[x] -= m
                x = longest(min(c * width, limit - sum(lengths)), (c - 1) * width)
                for y, m in taken.items():
                    left[y] += m
                if not x:
                    break
                lengths.append(x)
            if len(lengths) < len(shapes[k]) - 1 or not (n := place(filled(lengths), todo)):
                break
            todo -= n
    while first := longest(limit):
        place(filled([first]), int(left[first]))
    return np.array(runs, np.int64).reshape(-1, 5), made


def pack(parts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pieces (doc_id, piece, length, further columns) with sequence_id and offset, in as few sequences as the plan finds."""
    spark = parts.sparkSession
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counted = salted.groupBy("length", "_salt").count().collect()  # limit * SALTS rows at most
    table = np.zeros((limit + 1, SALTS), np.int64)
    for r in counted:
        table[r["length"], r["_salt"]] = r["count"]
    before = np.cumsum(table, axis=1) - table
    runs, _ = plan(table.sum(1), limit)
    runs = runs[runs[:, 2] > 0]
    key = runs[:, 0] << 44 | runs[:, 1]
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((before, key[order], runs[order]))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    own = parts.columns
    names = [*own, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, key, runs = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, salt, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_salt", "_rank"))
            rank = before[length, salt] + rank
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            found = runs[at]
            columns = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], names=names)

    schema = widened(parts.schema, sequence_id=LongType(), offset=LongType())
    return mapped(ranked.select(*own, "_salt", "_rank"), run, schema)


def packed(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Every piece of docs with its sequence and offset."""
    return pack(settled(pieces(docs, path, limit)), limit)
