"""SimHash near-dedup: a binary trie self-join over 64-bit fingerprints.

Fingerprint: ASCII-lower-cased words, shingles of `shingle` words joined by a space (repeats count; fewer words: all of
them as one shingle; none: fingerprint 0), XXH64 with seed 42; a bit is 1 if set in over half of the shingle hashes.
Fingerprints link when at most `budget` bits differ. Equal fingerprints are one class, so copies never meet as pairs.

The self-join walks a binary trie over the distinct fingerprints two nodes at a time: descending from a pair of nodes,
each side goes left or right, a differing step costs one bit, and a pair is left as soon as the budget is exceeded or a
side is empty. Spark spreads the top of the trie: every fingerprint goes to the pairs of subtries (by the top `b` bits)
that can still be within the budget, one group for each pair of subtries. A group returns a spanning forest of the links
it found, never the pairs themselves; `least_labels` joins the forests.

Wider budgets (`wide_links`) go by blocks of the bits, one trie for each with that block on top: fingerprints that differ
in up to WIDE = blocks * (errors + 1) - 1 bits differ in `errors` at most in one block.

Defined results: null text counts as empty; null doc_id rows belong to their component but never name it unless all
its ids are null (component_id null); repeated rows stay repeated; an empty table gives an empty result; further
columns of the input are ignored by `components`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mapped, settled, slices, strings

SHINGLE = 3
BUDGET = 2
#: Fingerprints in a subtrie, about, and the least number of bits that spread subtries.
SUBTRIE = 1 << 16
LEAST_BITS = 4
#: Most links that one task joins, at 16 bytes each; more are joined in distributed rounds.
FEW_LINKS = 1 << 20
#: Bits of the wide search; its (blocks, errors in one) up to MANY fingerprints, and beyond; its subtries and their least bits.
WIDE = 11
BLOCKS, MANY, BLOCKS_OF_MANY = (4, 2), 1 << 20, (3, 3)
WIDE_SUBTRIE, WIDE_LEAST_BITS = 1 << 19, 3
#: Fingerprints of one block that others of a like block meet, where these are many.
FEW = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    n = len(w)
    if n <= shingle:
        h = [xxhash.xxh64_intdigest(line, 42)]
    else:
        size = np.fromiter(map(len, w), np.int64, n) + 1
        end = np.cumsum(size) - 1
        start = (end - size + 1)[: n - shingle + 1].tolist()
        digest, view = xxhash.xxh64_intdigest, memoryview(line)
        h = [digest(view[s:e], 42) for s, e in zip(start, end[shingle - 1 :].tolist())]
    # Few distinct rows of 8 bytes at a time keep the bit matrix of a very long text small.
    h = np.array(h, dtype="<u8")
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long: the fingerprint's bits as a signed number), a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                fp = np.array([fingerprint(t, shingle) for t in strings(batch.column("text")).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


def trie_links(a: np.ndarray, b: np.ndarray | None, top: int, spent: int, budget: int, block: int = 64, wide: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between sorted distinct uint64 arrays a and b, or within a if b is None, in chunks of index arrays.

    top: bits that all of a (and all of b) share already; spent: how many of these differ between a and b. With a block,
    the budget holds for its first bits only and `wide` for all; of many that share a block, a FEW meet the others."""
    wide = budget if wide is None else wide
    same = b is None
    b = a if same else b
    if not len(a) or not len(b):
        return
    one = np.uint64(1)
    todo = [(top, *(np.array([x], np.int64) for x in (0, len(a), 0, len(b), spent)), np.array([same]))]
    while todo:
        depth, alo, ahi, blo, bhi, err, own = todo.pop()
        small = ((ahi - alo) * (bhi - blo) <= 64) | (depth >= block)
        if small.any():
            lo, n, m = alo[small], (ahi - alo)[small], (bhi - blo)[small]
            n = np.where(n * m > 64, np.minimum(n, FEW), n)
            size = n * m
            pair = np.repeat(np.arange(len(size)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = lo[pair] + k // m[pair], blo[small][pair] + k % m[pair]
            ok = (np.bitwise_count(a[i] ^ b[j]) <= wide) & (~own[small][pair] | (i < j))
            if ok.any():
                yield i[ok], j[ok]
        big = ~small
        if not big.any():
            continue
        alo, ahi, blo, bhi, err, own = (x[big] for x in (alo, ahi, blo, bhi, err, own))
        bit = np.uint64(63 - depth)

        def middle(x: np.ndarray, lo: np.ndarray) -> np.ndarray:
            head = (x[lo] >> bit >> one) << one << bit if depth else np.zeros(len(lo), np.uint64)
            return np.searchsorted(x, head | (one << bit))

        am, bm = np.clip(middle(a, alo), alo, ahi), np.clip(middle(b, blo), blo, bhi)
        zero, yes, no = np.zeros_like(err), own, np.zeros_like(own)
        parts = [(alo, am, blo, bm, zero, yes), (am, ahi, bm, bhi, zero, yes), (alo, am, bm, bhi, zero + 1, no), (am, ahi, blo, bm, zero + 1, no)]
        below = []
        for k, (al, ah, bl, bh, cost, mine) in enumerate(parts):
            # Within one node the right-left pairs are the left-right pairs again.
            keep = (ah > al) & (bh > bl) & (err + cost <= budget) & ~(own if k == 3 else no)
            below.append([x[keep] for x in (al, ah, bl, bh, err + cost, mine)])
        child = [np.concatenate(x) for x in zip(*below)]  # one run of pairs a level, cut only to bound memory
        for at in range(0, len(child[0]), 1 << 18):
            todo.append((depth + 1, *(x[at : at + (1 << 18)] for x in child)))


def hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j in label, in place; every label is the least index of its set."""
    while True:
        p, q = label[i], label[j]
        if (apart := p != q).any():
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while (label[label] != label).any():
                label[:] = label[label]
        else:
            return


def joining(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `hook`; returns those of the links that joined two sets."""
    used = [np.zeros((2, 0), np.int64)]
    while (apart := label[i] != label[j]).any():
        i, j = i[apart], j[apart]
        p, q = label[i], label[j]
        high, at = np.unique(np.maximum(p, q), return_index=True)
        label[high] = np.minimum(p, q)[at]
        used.append(np.stack([i[at], j[at]]))
        while (label[label] != label).any():
            label[:] = label[label]
    return tuple(np.concatenate(used, axis=1))


def _order(counts: list[int], total: int) -> list[int]:
    """Bits from the most balanced to the least: a trie in this order spreads best."""
    return sorted(range(64), key=lambda b: (abs(2 * counts[b] - total), b))


def _permuted(fp: np.ndarray, order: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for at, b in enumerate(order):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(63 - at)
    return out


def _balance(classes: DataFrame) -> tuple[int, list[int]]:
    """The number of fingerprints, and the bits in the trie's order."""
    ones = [F.sum(F.getbit("fp", F.lit(b)).cast("long")).alias(f"b{b}") for b in range(64)]
    counted = classes.agg(F.count("*").alias("n"), *ones).first()
    return counted["n"], _order([counted[f"b{b}"] or 0 for b in range(64)], counted["n"])


def _masks(bits: int, budget: int) -> list[int]:
    """Differences of up to `budget` bits."""
    masks = [0] + [1 << i for i in range(bits)] * (budget > 0)
    for _ in range(1, budget):
        masks = sorted({m | 1 << i for m in masks for i in range(bits)} | set(masks))
    return masks


def _prefix(order: list[int], bits: int) -> Column:
    prefix = F.lit(0)
    for at in range(bits):
        prefix = prefix + F.shiftleft(F.getbit("fp", F.lit(order[at])).cast("int"), bits - 1 - at)
    return prefix


def forests(classes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Spanning forests (a, b long) of the links between distinct fingerprints `fp`, one for each pair of subtries."""
    n, order = _balance(classes)
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, n / SUBTRIE))))
    masks = _masks(bits, budget)
    near = classes.select("fp", _prefix(order, bits).alias("p")).select("fp", "p", F.explode(F.array(*map(F.lit, masks))).alias("m"))
    near = near.select("fp", "p", F.least("p", F.col("p").bitwiseXOR(F.col("m"))).alias("lo"), F.greatest("p", F.col("p").bitwiseXOR(F.col("m"))).alias("hi"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = map(int, key)
        fp = rows["fp"].to_numpy(np.int64)
        trie = _permuted(fp.view(np.uint64), order)
        side = rows["p"].to_numpy() == lo
        left = np.flatnonzero(side)[np.argsort(trie[side])]
        right = np.flatnonzero(~side)[np.argsort(trie[~side])]
        both = np.concatenate([left, right])
        label = np.arange(len(both))
        found = trie_links(trie[left], None if lo == hi else trie[right], bits, (lo ^ hi).bit_count(), budget)
        for i, j in found:
            hook(label, i, j if lo == hi else j + len(left))
        moved = np.flatnonzero(label != np.arange(len(both)))
        return pd.DataFrame({"a": fp[both[moved]], "b": fp[both[label[moved]]]})

    return near.groupBy("lo", "hi").applyInPandas(run, "a long, b long")


def wide_links(classes: DataFrame) -> DataFrame:
    """Links (a, b long) of at most WIDE bits between distinct fingerprints `fp`: for each block and pair of subtries those
    that span its components. They are links themselves, so that a further test can follow."""
    n, order = _balance(classes)
    blocks, errors = BLOCKS if n <= MANY else BLOCKS_OF_MANY
    bits = max(WIDE_LEAST_BITS, math.ceil(math.log2(max(1, n / WIDE_SUBTRIE))))
    # Every block has balanced bits on top.
    orders = [order[k::blocks][: 64 // blocks] for k in range(blocks)]
    orders = [own + [b for b in order if b not in own] for own in orders]
    tops = F.array(*(F.struct(F.lit(k).alias("k"), _prefix(own, bits).alias("p")) for k, own in enumerate(orders)))
    near = classes.select("fp", F.explode(tops).alias("top")).select("fp", "top.k", "top.p", F.explode(F.array(*map(F.lit, _masks(bits, errors)))).alias("m"))
    near = near.select("fp", "k", "p", F.least("p", F.col("p").bitwiseXOR(F.col("m"))).alias("lo"), F.greatest("p", F.col("p").bitwiseXOR(F.col("m"))).alias("hi"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k, lo, hi = map(int, key)
        fp = rows["fp"].to_numpy(np.int64)
        trie = _permuted(fp.view(np.uint64), orders[k])
        side = rows["p"].to_numpy() == lo
        left = np.flatnonzero(side)[np.argsort(trie[side])]
        right = np.flatnonzero(~side)[np.argsort(trie[~side])]
        both = np.concatenate([left, right])
        label = np.arange(len(both))
        found = trie_links(trie[left], None if lo == hi else trie[right], bits, (lo ^ hi).bit_count(), errors, 64 // blocks, WIDE)
        used = [joining(label, i, j if lo == hi else j + len(left)) for i, j in found]
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*used)) if used else (label[:0], label[:0])
        return pd.DataFrame({"a": fp[both[i]], "b": fp[both[j]]})

    return near.groupBy("k", "lo", "hi").applyInPandas(run, "a long, b long")


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every vertex of all the edges with the least one of its component."""
    held = [np.stack([part.column(c).to_numpy() for c in ("a", "b")]) for part in parts if part.num_rows]
    if not held:
        return
    vertex, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(vertex))
    while len(a):
        # Hook the greater root of each edge to the lesser one, then let all find their roots.
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root != root[root]).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    yield pa.RecordBatch.from_arrays([pa.array(vertex), pa.array(vertex[root])], names=["v", "root"])


def least_labels(edges: DataFrame) -> DataFrame:
    """(v, root long): every vertex of edges (a, b) with the least vertex of its component.

    Up to FEW_LINKS edges, 16 MB, meet in one task. More take rounds of hooking to the least neighbouring label and label
    doubling, each cut by a checkpoint. Both give the same rows."""
    edges = settled(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    if edges.limit(FEW_LINKS + 1).count() <= FEW_LINKS:
        return settled(mapped(edges.coalesce(1), _joined, "v long, root long"))
    edges = settled(edges.distinct())
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a"))
    labels = settled(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("root")))
    while True:
        # The least label of a neighbour, offered to the vertex and to its present root.
        offer = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("root").alias("near"))
        seen = labels.join(offer, "v").select("v", "root", F.least("root", "near").alias("near"))
        hooked = seen.select("v", "near").union(seen.select(F.col("root").alias("v"), "near")).groupBy("v").agg(F.min("near").alias("near"))
        jump = hooked.select(F.col("v").alias("near"), F.col("near").alias("far"))
        new = hooked.join(jump, "near", "left").select("v", F.coalesce(F.least("near", "far"), "near").alias("root"))
        new = settled(new)
        changed = new.join(labels.withColumnRenamed("root", "old"), "v").where("root <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def classes_with_roots(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, root, component_id): each distinct fingerprint, the least one linked to it, and the component's least id."""
    classes = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = least_labels(forests(classes, budget))
    rooted = classes.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(ids, "root")


def components(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp long, component_id, for every row of docs."""
    fps = settled(fingerprints(docs, shingle))
    return fps.join(classes_with_roots(fps, budget).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """docs with one row of each component: that of least doc_id (rows without one last, by their text's hash)."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("_row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", text))
    # Fingerprints travel with their row's hash, under the name of the id.
    fps = settled(fingerprints(keyed.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("doc_id"), "text"), shingle))
    roots = classes_with_roots(fps.select("fp", F.col("doc_id._row").alias("doc_id")), budget).select("fp", "root")
    kept = fps.join(roots, "fp").groupBy("root").agg(F.min("doc_id").alias("least")).select(F.col("least._row").alias("_row"))
    return keyed.join(kept.hint("merge"), "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
