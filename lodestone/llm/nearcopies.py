"""Near copies by SimHash, then exactly: components of every pair of texts at Jaccard similarity 0.8 or more.

SimHash comes first: fingerprints of the texts over shingles of five words, operator 10's trie self-join by blocks of bits
(`simhash.wide_links`, 11 bits), and each pair so found is verified by its whole sets. It finds most near copies, but no
number of bits makes it find all, so an exact search follows for what its components leave apart.

Set of a text: 52-bit hashes of its distinct shingles of five ASCII-lower-cased words (fewer words: all as one shingle;
none: the one value 0). Texts link at 9 * shared >= 4 * (n + m), which is similarity 0.8. Sets are read in one order:
shingles that a sample finds common last, else by hash. Two sets that link share one of their first n - ceil(0.8 n) + 1
values, so texts meet by those; the sample decides only what this costs, never what is found.

Pairs that meet pass two tests. First a parity sketch: bit h mod B of a text's sketch is the parity of its values there,
so the bits in which two sketches differ never outnumber the values in which the sets differ; pairs over the bound go
without their sets being moved, and no link is lost. Then the whole sets, for those that are left.

All values whose least text is the same make one group: near copies and texts with one passage share many values, and so
meet once. Groups that SimHash joined whole are done. Texts of the others are first compared with a few members of their
group of unlike components, and of these each text verifies one. Only pairs that all these links leave apart are compared after that: with a few members again, last all; one for each two
components, then the rest. So a large group of near copies isn't compared pair by pair. Groups of many texts are dealt out
in blocks of BLOCK texts; a text of the group's largest component meets only texts of other ones.

Defined results: null text counts as empty; rows without a doc_id belong to their component but stay only if all its rows
have none. Texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mapped, settled, slices, strings, words
from .simhash import fingerprints, least_labels, wide_links

SHINGLE = 5
#: Texts of a sample, and of how many of them a shingle is common.
SAMPLE, COMMON, MOST_COMMON = 4000, 8, 50_000
#: Members that a group is compared with first.
PIVOTS = 8
#: Rounds in which texts of unlike components meet a few others, before those still apart meet all.
ROUNDS = 1
#: Texts of one value that one task holds together.
BLOCK = 1 << 13
#: Most large groups that are broadcast, a row each.
MOST_LARGE = 50_000
#: Bits of the sketch that is at hand where texts meet.
SHORT = 512
#: Most bits of the filter that is sent to all executors; a fuller one lets more texts pass, and loses none.
MOST_BITS = 1 << 28
_DOCS = 1 << 12  # texts at once: their number and a value share 64 bits
_HASH = np.uint64((1 << 51) - 1)
_COMMON = 1 << 51


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sets(texts: pa.Array, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets in one array, each ascending, and where each begins; common: sorted hashes that come last."""
    per, flat = words(strings(texts))
    coded = flat.dictionary_encode()
    known = [xxhash.xxh64_intdigest(w.lower(), 42) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    h = np.array(known, np.uint64)[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    ends = np.cumsum(per)
    doc = np.repeat(np.arange(len(per)), per)
    left = ends[doc] - np.arange(len(h))
    value = h
    for k in range(1, SHINGLE):
        later = np.concatenate([h[k:], np.zeros(min(k, len(h)), np.uint64)])
        value = np.where(left > k, _mixed(value) + later, value)
    whole = (left >= SHINGLE) | (left == per[doc])
    doc, value = doc[whole], _mixed(value[whole]) & _HASH
    if len(common):
        at = np.minimum(np.searchsorted(common, value), len(common) - 1)
        value |= (common[at] == value).astype(np.uint64) << np.uint64(51)
    bare = np.flatnonzero(per == 0)
    key = np.unique(np.concatenate([doc.astype(np.uint64) << np.uint64(52) | value, bare.astype(np.uint64) << np.uint64(52)]))
    starts = np.searchsorted(key, np.arange(len(per), dtype=np.uint64) << np.uint64(52))
    return key & np.uint64((1 << 52) - 1), np.append(starts, len(key))


def sketch(value: np.ndarray, bits: int = 0) -> bytes:
    """Parities of the values by their low bits; a power of two of bits, by itself twice the set's size at least."""
    bits = bits or 1 << max(6, math.ceil(math.log2(2 * len(value))))
    odd = np.bincount((value & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(a: bytes, n: int, b: bytes, m: int) -> bool:
    """False only if the sets, of n and m values, differ in more values than a link allows."""
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "little")
    for size in (len(a) >> k for k in range(1, len(a).bit_length()) if len(a) >> k >= len(b)):
        # By one bit less of a value's hash: parities of both halves together.
        x = (x >> 8 * size) ^ (x & ((1 << 8 * size) - 1))
    return 9 * (x ^ int.from_bytes(b, "little")).bit_count() <= n + m


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    both = np.sort(np.concatenate([s, t]))
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both)


def _each(docs: DataFrame, run: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, common: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """run(text hashes, sets, starts) over few texts at a time, equal ones once; wanted: which text hashes at all."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in slices(whole, most=2 << 20):
                text = part.column("_text").to_numpy(zero_copy_only=False)
                keep = np.zeros(len(text), bool)
                keep[np.unique(text, return_index=True)[1]] = True
                if wanted is not None:
                    keep &= wanted(text)
                part = part.filter(pa.array(keep))
                for at in range(0, part.num_rows, _DOCS):
                    few = part.slice(at, _DOCS)
                    yield run(few.column("_text").to_numpy(zero_copy_only=False), *sets(few.column("text"), common))

    return mapped(docs.select("_text", "text"), batches, schema)


def _common(docs: DataFrame, texts: int) -> np.ndarray:
    def run(_: np.ndarray, value: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64))], names=["value"])

    few = docs.where(F.pmod("_text", F.lit(max(1, texts // SAMPLE))) == 0)
    often = _each(few, run, "value long", np.zeros(0, np.uint64)).groupBy("value").count().where(F.col("count") >= COMMON)
    rows = often.orderBy(F.desc("count"), "value").limit(MOST_COMMON).select("value").toArrow()
    return np.sort(rows.column("value").to_numpy()).astype(np.uint64)


def _prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(value, text, place): the first values of each text's set; place holds the set's size and the value's position."""

    def run(text: np.ndarray, value: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        n = np.diff(start)
        first = n - (4 * n + 4) // 5 + 1
        of = np.repeat(np.arange(len(n)), first)
        at = np.arange(len(of)) - np.repeat(np.cumsum(first) - first, first)
        columns = [value[start[of] + at].astype(np.int64), text[of], n[of].astype(np.int64) << 32 | at]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["value", "text", "place"])

    return _each(docs, run, "value long, text long, place long", common)


def _groups(rows: DataFrame, texts: int) -> DataFrame:
    """(key, text, place): texts that share a value, by the value's least text, with their first place there."""
    salt = F.when(F.col("value") >= _COMMON, F.pmod("text", F.lit(max(1, texts // BLOCK)))).otherwise(0)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The row before, not yet given out; its value's least text; and whether the row before it has its value.
        last: pa.RecordBatch | None = None
        head, joined = 0, False
        for part in parts:
            if not part.num_rows:
                continue
            table = pa.Table.from_batches([part] if last is None else [last, part]).combine_chunks()
            value, text = table.column("value").to_numpy(), table.column("text").to_numpy()
            at = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])))
            value, text = value[at], text[at]
            alike = value[1:] == value[:-1]
            stay = np.append(joined, alike) | np.append(alike, False) | (value >= _COMMON)
            first = np.maximum.accumulate(np.where(np.append(True, ~alike), np.arange(len(at)), 0))
            key = np.where((first == 0) & joined, head, text[first])
            out = np.flatnonzero(stay[:-1])
            yield batch(table.take(pa.array(at[out])), key[out])
            last, head, joined = table.slice(int(at[-1]), 1).to_batches()[0], int(key[-1]), bool(alike[-1]) if len(alike) else joined
        if last is not None and (joined or last.column("value")[0].as_py() >= _COMMON):
            yield batch(pa.Table.from_batches([last]), np.array([head]))

    def batch(table: pa.Table, key: np.ndarray) -> pa.RecordBatch:
        columns = [table.column(c).combine_chunks() for c in ("value", "text", "place")]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *columns], names=["key", "value", "text", "place"])

    dealt = rows.repartition("value", salt).sortWithinPartitions("value", "text")
    found = settled(mapped(dealt, run, "key long, value long, text long, place long"))
    # Common values lie in several tasks: their least texts, MOST_COMMON rows at most, come by an aggregate.
    often = found.where(F.col("value") >= _COMMON)
    least = F.broadcast(settled(often.groupBy("value").agg(F.min("text").alias("least"))))
    often = often.join(least, "value").select(F.col("least").alias("key"), "text", "place")
    return found.where(F.col("value") < _COMMON).select("key", "text", "place").union(often).groupBy("key", "text").agg(F.min("place").alias("place"))


def _runs(rows: DataFrame, run: Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run(rows, starts, sizes) over the runs of equal `key`, some at a time and each whole."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None
        for part in parts:
            if not part.num_rows:
                continue
            key = part.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if kept and (cut or key[0] != last):
                # All before the last run of this part is whole.
                yield from of(pa.Table.from_batches([*kept, part.slice(0, cut)]))
                kept = []
            elif cut:
                yield from of(pa.Table.from_batches([part.slice(0, cut)]))
            kept.append(part.slice(cut))
            last = key[-1]
        if kept:
            yield from of(pa.Table.from_batches(kept))

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table.column("key").to_numpy()
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        yield from run(table, start[size > 1], size[size > 1])

    return mapped(rows.repartition("key").sortWithinPartitions("key", "text"), batches, schema)


def _pairs(blocks: DataFrame, every: bool, turn: int = 0) -> DataFrame:
    """Pairs (a, b) of a block's texts that may link: with a few of its members, others in each turn, or (every) all with
    unlike `root`, of which one isn't `big`. `short`: sketches of SHORT bits, or null."""

    def run(table: pa.Table, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        text, place, root, big = (table.column(c).to_numpy() for c in ("text", "place", "root", "big"))
        n, rest = place >> 32, (place >> 32) - (place & 0xFFFFFFFF)
        order = _mixed(text.view(np.uint64) + np.uint64(turn))
        sketches = None
        if table.num_rows and table.column("short").null_count == 0:
            sketches = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint64).reshape(table.num_rows, -1)
        found, held = [], 0
        for s, m in zip(start.tolist(), size.tolist()):
            own = slice(s, s + m)
            if every:
                chosen = np.flatnonzero(big[own] == 0).tolist() if (root[own] != root[s]).any() else ()
            else:
                # The same members for all values of a group, so that few pairs are met.
                chosen = {*np.argsort(order[own])[:PIVOTS].tolist(), *(np.flatnonzero(big[own]).tolist() if sketches is None else ())}
            for p in chosen:
                # Both sets' values from the first shared one on hold all that they share.
                most = np.minimum(rest[own], rest[s + p])
                near = np.flatnonzero((9 * most >= 4 * (n[own] + n[s + p])) & (root[own] != root[s + p])) + s
                if sketches is not None and len(near):
                    apart = np.bitwise_count(sketches[near] ^ sketches[s + p]).sum(1, dtype=np.int64)
                    near = near[9 * apart <= n[near] + n[s + p]]
                other = text[near]
                if len(other):
                    found.append(np.stack([np.minimum(other, text[s + p]), np.maximum(other, text[s + p])]))
                    held += len(other)
            if held > 1 << 17:
                yield batch(found)
                found, held = [], 0
        if found:
            yield batch(found)

    def batch(found: list[np.ndarray]) -> pa.RecordBatch:
        pair = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    return _runs(blocks, run, "a long, b long").distinct()


def _chunk(count: Column) -> Column:
    """The chunk of a text among `count` rows, of BLOCK rows about."""
    return F.pmod(F.xxhash64(F.lit(7), "text"), F.greatest(F.ceil(count / BLOCK), F.lit(1)))


def _around_pivots(groups: DataFrame) -> DataFrame:
    """Blocks in which texts meet a few members: groups themselves, large ones in chunks that share one member."""
    stats = groups.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.lit(9), "text").alias("order"), "text", "place", "root")).alias("first"))
    stats = settled(stats.where(F.col("n") > BLOCK))
    stats = F.broadcast(stats) if stats.count() <= MOST_LARGE else stats
    chunk = F.when(F.col("n").isNotNull(), F.xxhash64("key", _chunk(F.col("n")))).otherwise(F.col("key"))
    dealt = groups.join(stats.select("key", "n"), "key", "left").select(chunk.alias("key"), "text", "place", "root")
    every = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK) - 1)
    firsts = stats.select("key", F.explode(every).alias("c"), "first").select(F.xxhash64("key", "c").alias("key"), "first.text", "first.place", "first.root")
    blocks = dealt.withColumn("big", F.lit(0)).union(firsts.withColumn("big", F.lit(1)))
    return blocks.withColumn("short", F.lit(None).cast("binary"))


def _large(groups: DataFrame, label: DataFrame, sketches: DataFrame) -> DataFrame:
    """(key, n, text, place, short) of groups with texts of unlike components. Groups of up to PIVOTS texts have met whole."""
    counts = groups.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PIVOTS)
    rows = _several(groups.join(counts, "key"), label)
    return settled(rows.drop("root").join(sketches.select("text", "short"), "text"))


def _several(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows with their `root`, of groups with two roots or more."""
    rooted = settled(rows.join(label, "text", "left").select(*rows.columns, F.coalesce("root", "text").alias("root")))
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return rooted.join(several, "key")


def _apart(large: DataFrame, label: DataFrame) -> DataFrame:
    """Blocks in which texts of one group and of unlike components meet. Large groups: texts outside the largest component
    in chunks that meet each other and the chunks of the largest."""
    rows = _several(large, label)
    columns = ["text", "place", "big", "root", "short"]
    small = rows.where(F.col("n") <= BLOCK).withColumn("big", F.lit(0)).select("key", *columns)
    large = rows.where(F.col("n") > BLOCK)
    sizes = large.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"))
    large = large.join(sizes, "key").withColumn("big", (F.col("root") == F.col("top.root")).cast("int"))
    large = large.withColumn("minor", F.ceil((F.col("n") - F.col("top.m")) / BLOCK)).withColumn("major", F.ceil(F.col("top.m") / BLOCK))
    own = F.when(F.col("big") == 1, _chunk(F.col("top.m"))).otherwise(_chunk(F.col("n") - F.col("top.m")))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), c - 1)
    with_major = F.transform(upto(F.col("major")), lambda j: F.struct(F.lit(1).alias("kind"), F.col("own").alias("i"), j.alias("j")))
    with_minor = F.transform(upto(F.col("minor")), lambda j: F.struct(F.lit(0).alias("kind"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    of_major = F.transform(upto(F.col("minor")), lambda i: F.struct(F.lit(1).alias("kind"), i.alias("i"), F.col("own").alias("j")))
    block = F.explode(F.when(F.col("big") == 1, of_major).otherwise(F.concat(with_major, with_minor)))
    dealt = large.withColumn("own", own).withColumn("block", block)
    return small.union(dealt.select(F.xxhash64("key", "block.kind", "block.i", "block.j").alias("key"), *columns))


def _filter(docs: DataFrame, ids: DataFrame, column: str = "text") -> Callable[[np.ndarray], np.ndarray]:
    """Whether hashes may be among the ids: bits by hash, sent to all executors. Never false for one of them."""
    count = ids.count()
    size = 1 << min(MOST_BITS.bit_length() - 1, max(16, math.ceil(math.log2(16 * max(1, count)))))
    at = ids.select((F.pmod(column, F.lit(size)) + 1).alias("at"))  # buckets count from 1
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in maps:
        place = (r["k"] - 1) * 4096
        bits[place : place + 4096] = np.frombuffer(r["m"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def wanted(hashes: np.ndarray) -> np.ndarray:
        at = np.mod(hashes, size)
        return (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    return wanted


def _ends(pairs: DataFrame) -> DataFrame:
    return settled(pairs.select(F.col("a").alias("text")).union(pairs.select("b")).distinct())


def _per_text(docs: DataFrame, ids: DataFrame, common: np.ndarray, made: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(text, n, data: made(set), short: a sketch) of the texts that ids (settled) holds."""

    def run(text: np.ndarray, value: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        every = [value[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist())]
        columns = [pa.array(text), pa.array(np.diff(start).astype(np.int64)), pa.array(map(made, every), pa.binary()), pa.array([sketch(v, SHORT) for v in every], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["text", "n", "data", "short"])

    rows = _each(docs, run, "text long, n long, data binary, short binary", common, _filter(docs, ids))
    return settled(rows.join(ids, "text", "left_semi").dropDuplicates(["text"]))


def _tested(pairs: DataFrame, held: DataFrame, test: Callable[[bytes, int, bytes, int], bool]) -> DataFrame:
    """The pairs whose texts' data pass the test."""
    sides = [held.select(F.col("text").alias(c), F.col("n").alias(f"n_{c}"), F.col("data").alias(f"data_{c}")) for c in ("a", "b")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 256):
                few = part.slice(at, 256)
                columns = (few.column(c).to_pylist() for c in ("data_a", "n_a", "data_b", "n_b"))
                yield few.select(["a", "b"]).filter(pa.array([test(*x) for x in zip(*columns)], pa.bool_()))

    return settled(mapped(pairs.join(sides[0], "a").join(sides[1], "b"), run, "a long, b long"))


def _verified(docs: DataFrame, pairs: DataFrame, common: np.ndarray) -> DataFrame:
    test = lambda a, n, b, m: linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))
    return _tested(pairs, _per_text(docs, _ends(pairs), common, lambda value: value.tobytes()), test)


def _unlike(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs of unlike components, with the components (p < q)."""
    p, q = (label.select(F.col("text").alias(c), F.col("root").alias(f"r_{c}")) for c in ("a", "b"))
    rows = pairs.join(p, "a", "left").join(q, "b", "left").select("a", "b", F.coalesce("r_a", "a").alias("r_a"), F.coalesce("r_b", "b").alias("r_b"))
    return rows.where("r_a <> r_b").select("a", "b", F.least("r_a", "r_b").alias("p"), F.greatest("r_a", "r_b").alias("q"))


def by_fingerprint(docs: DataFrame) -> DataFrame:
    """Pairs (a < b) of texts that SimHash links: equal fingerprints by their least text, others by the trie."""
    prints = settled(fingerprints(docs.select(F.col("_text").alias("doc_id"), "text"), SHINGLE).distinct())
    classes = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    same = prints.join(classes, "fp").where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    a, b = (classes.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in ("a", "b"))
    unlike = settled(wide_links(classes).distinct()).join(a, "a").join(b, "b")
    return same.union(unlike.select(F.least("least_a", "least_b"), F.greatest("least_a", "least_b"))).distinct()


def _one(pairs: DataFrame) -> DataFrame:
    """Each text's pair with one of the others, the same for a whole group where that can be."""
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    one = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(9), "b").alias("order"), "b")).alias("to"))
    return settled(one.select(F.least("a", "to.b").alias("a"), F.greatest("a", "to.b").alias("b")).distinct())


def roots(docs: DataFrame) -> DataFrame:
    """(text, root long): the texts' hashes with those of their components, for texts that have a near copy; docs has `_text`."""
    texts = docs.agg(F.approx_count_distinct("_text")).first()[0]
    common = _common(docs, texts)
    groups = settled(_groups(_prefixes(docs, common), texts))
    labels = lambda links: least_labels(links).select(F.col("v").alias("text"), "root")
    sketches = _per_text(docs, settled(groups.select("text").distinct()), common, sketch)
    # SimHash's pairs first, of which each text verifies one; then the same with a few members of its group.
    met = _tested(by_fingerprint(docs), sketches, may_link)
    links = _verified(docs, _one(met), common)
    label = labels(links)
    near = _tested(_pairs(_around_pivots(_several(groups, label)), False), sketches, may_link)
    met = met.union(near)
    if not near.isEmpty():
        links = links.union(_verified(docs, _one(near), common))
        label = labels(links)
    # Then what these components leave apart: a few pairs, and last all; one for each two components first.
    large = _large(groups, label, sketches)
    for turn in range(1, ROUNDS + 2):
        met = met.union(_tested(_pairs(_apart(large, label), turn > ROUNDS, turn), sketches, may_link))
        left = settled(_unlike(met.distinct(), label))
        best = settled(left.groupBy("p", "q").agg(F.min(F.struct("a", "b")).alias("x")).select("x.a", "x.b"))
        if best.isEmpty():
            continue
        links = links.union(_verified(docs, best, common))
        label = labels(links)
        met = settled(left.select("a", "b").join(best, ["a", "b"], "left_anti"))
    rest = settled(_unlike(met, label).select("a", "b"))
    return label if rest.isEmpty() else labels(links.union(_verified(docs, rest, common)))


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of least doc_id (rows without one last). Texts that no other row is like
    stay where they are; only the others' rows move."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("_text", F.xxhash64(text)).withColumn("_row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", text))
    narrow = settled(keyed.groupBy("_text").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("least"), F.count("*").alias("rows")))
    label = roots(keyed).withColumnRenamed("text", "_text")
    rooted = settled(narrow.join(label, "_text", "left").select("_text", "root", "least", "rows"))
    shared = rooted.where("root is not null or rows > 1")
    kept = shared.groupBy(F.coalesce("root", "_text").alias("root")).agg(F.min("least").alias("least")).select(F.col("least._row").alias("_row"))
    # Texts that the filter takes for shared ones, although they are alone, stay by their own row.
    wanted = _filter(docs, shared.select("_text"), "_text")

    @F.pandas_udf("boolean")
    def may(x: pd.Series) -> pd.Series:
        return pd.Series(wanted(x.to_numpy()))

    alone = rooted.where("root is null and rows = 1").where(may("_text")).select("least._row")
    marked = keyed.withColumn("_may", may("_text"))
    # Rows meet by the key by which repeated rows are dropped, so they move once.
    moved = marked.where("_may").join(kept.union(alone).hint("merge"), "_row", "left_semi").dropDuplicates(["_row"])
    return marked.where("not _may").select(*docs.columns).union(moved.select(*docs.columns))
