"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Base spans (kinds assign, access, hex): leftmost non-overlapping matches of fixed patterns, those too short dropped.

The method adds spans of kind `random`: runs of 16 or more of the letters that encodings use. Each run's encoding is the
smallest that holds its characters (hex, letters, base32, lower or upper with digits, base62, base64), and its characters
are numbered in that alphabet. The battery tests the run against randomness over that alphabet:
- alphabet uniformity: the chi-squared statistic, alphabet / n * sum(c * c) - n, rejects if counts are too uneven. It is a
  linear function of the number of equal pairs, whose law under randomness is nearly Poisson with a known mean;
- runs: the Wald-Wolfowitz test of the lower against the upper half of the alphabet, two-sided;
- serial correlation: lag 1, of the symbol numbers, two-sided.
A run is random if none of the three rejects at LEVEL / 3.

Ordinary long words can pass by chance, the more easily the shorter they are. So each run also has a p-value, the chance
that ordinary text of its length looks as random: by equal pairs against text's coincidence rate, by changes between small
letters, capitals and digits (runs of classes), and by changes between vowels and consonants (serial), joined by Fisher's
method; runs that the battery rejects have p-value 1. The Benjamini-Hochberg step-up then holds the false-discovery rate
within each stratum of encoding and length over the whole corpus: many long words of a kind ask for stronger evidence. The
step-up works on a histogram of p-values (strata * BINS rows at most), each counted at its bin's upper edge.

Runs of digits alone aren't candidates: numbers of accounts, cards and orders are as random as any secret.

Runs that overlap a base span are not added. Defined results: null text counts as empty; repeated rows have equal spans;
very long texts are scanned whole; an empty table has no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, settled, slices, strings

FDR = 0.01
#: The battery's level: a run of its alphabet's letters at random is rejected this often.
LEVEL = 0.03
#: Steps of a p-value's common logarithm, and their number.
STEP, BINS = 0.1, 400
KINDS = ("assign", "access", "hex", "random")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Rates of ordinary text. Chance that two letters agree, sum of cubed frequencies, class changes, alternation.
COINCIDENCE, CUBES, CLASS_CHANGE, ALTERNATION = 0.07, 0.0065, 0.1, 0.65
_RUN = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name, pattern and alphabet, each letter at its number; letters of either case have one number where case isn't mixed.
_ENCODINGS = [
    ("decimal", r"[0-9]+", _DIGITS), ("hex", r"[0-9a-f]+|[0-9A-F]+", _DIGITS + "abcdef"), ("letters", r"[A-Z]?[a-z]+|[A-Z]+", _LOWER), ("base32", r"[A-Z2-7]+", _LOWER + "234567"),
    ("alnum36", r"[0-9a-z]+|[0-9A-Z]+", _DIGITS + _LOWER), ("base62", r"[0-9A-Za-z]+", _DIGITS + _UPPER + _LOWER), ("base64", r".+", _UPPER + _LOWER + _DIGITS + "+/"),
]
_ENCODINGS = [(n, re.compile(p), {c: i for i, c in enumerate(a)}) for n, p, a in _ENCODINGS]
#: Marks that stand for + and / in file names and addresses.
_SAFE = str.maketrans("-_=", "+//")
_LENGTHS = (24, 32, 48, 64)
_CLASS = {c: k for k, s in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/=_-")) for c in s}


@lru_cache(maxsize=1 << 16)
def _binomial(n: int, k: int, p: float, upper: bool) -> float:
    """P(Bin(n, p) >= k), or <= k."""
    if upper and k <= 0 or not upper and k >= n:
        return 1.0
    term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    return min(1.0, math.fsum(map(term, range(k, n + 1) if upper else range(k + 1))))


def encoding(run: str) -> tuple[str, dict[str, int]]:
    body = run.rstrip("=") or run
    return next((n, a) for n, p, a in _ENCODINGS if p.fullmatch(body))


def symbols(run: str) -> tuple[list[int], int]:
    """The run's characters as numbers of its encoding's alphabet, and the alphabet's size."""
    name, alphabet = encoding(run)
    body = run.rstrip("=") or run
    body = body.translate(_SAFE) if name == "base64" else body if name == "base62" else body.lower()
    return [alphabet[c] for c in body], len(alphabet)


def _poisson_tail(mean: float, k: int) -> float:
    """P(Poisson(mean) >= k)."""
    if k <= 0:
        return 1.0
    if k > mean + 40 * math.sqrt(mean + 1):
        return 0.0
    return max(0.0, 1 - math.fsum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k)))


def battery(run: str) -> tuple[float, float, float]:
    """p-values of alphabet uniformity, runs and serial correlation under randomness over the run's alphabet."""
    x, size = symbols(run)
    n = len(x)
    pairs = sum(c * (c - 1) // 2 for c in Counter(x).values())
    uniform = _poisson_tail(n * (n - 1) / 2 / size, pairs)
    high = [2 * v >= size for v in x]
    n1 = sum(high)
    n2 = n - n1
    if n1 and n2:
        mean = 2 * n1 * n2 / n + 1
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        off = max(0.0, abs(1 + sum(a != b for a, b in zip(high, high[1:])) - mean) - 0.5)
        runs = math.erfc(off / spread / math.sqrt(2))
    else:
        runs = 2 * 0.5**n
    middle = sum(x) / n
    around = sum((v - middle) ** 2 for v in x)
    if around:
        lag = sum((a - middle) * (b - middle) for a, b in zip(x, x[1:])) / around
        serial = math.erfc(abs(lag + 1 / n) * math.sqrt(n / 2))
    else:
        serial = 0.0
    return uniform, runs, serial


def is_random(run: str) -> bool:
    return min(battery(run)) >= LEVEL / 3


def ordinary(run: str) -> tuple[float, float, float]:
    """How likely ordinary text has so few equal pairs, so many class changes, so few changes of vowel and consonant."""
    body = run.rstrip("=") or run
    n = len(body)
    same = sum(c * (c - 1) for c in Counter(body).values())
    mean = n * (n - 1) * COINCIDENCE
    spread = math.sqrt(2 * n * (n - 1) * (COINCIDENCE - COINCIDENCE**2) + 4 * n * (n - 1) * (n - 2) * (CUBES - COINCIDENCE**2))
    pairs = 0.5 * math.erfc((mean - same) / spread / math.sqrt(2))
    kinds = [_CLASS[c] for c in body]
    # A capital at the start of a word is ordinary.
    changes = sum(a != b for a, b in zip(kinds[1:], kinds[2:]))
    classes = _binomial(n - 2, changes, CLASS_CHANGE, True)
    low = body.lower()
    letters = [(a in "aeiou", b in "aeiou") for a, b in zip(low, low[1:]) if a.isalpha() and b.isalpha()]
    vowels = _binomial(len(letters), sum(a != b for a, b in letters), ALTERNATION, False)
    return pairs, classes, vowels


def evidence(run: str) -> float:
    """-log10 of the p-value against ordinary text; 0 for runs that aren't random."""
    if not is_random(run):
        return 0.0
    x = -sum(math.log(max(p, 1e-300)) for p in ordinary(run))
    return max(0.0, (x - math.log(1 + x + x * x / 2)) / math.log(10))


def stratum(run: str) -> str:
    return f"{encoding(run)[0]}:{sum(len(run) >= n for n in _LENGTHS)}"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # A run of hex digits matches whole or not at all, so its least length can stand in the pattern.
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, stratum, bin of the evidence) of runs that no base span overlaps."""
    out = []
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))  # the furthest end of the spans so far
    for m in _RUN.finditer(text):
        s, e = m.span()
        before = bisect_left(starts, e)  # spans that start before this run ends
        if (not before or ends[before - 1] <= s) and not m[0].isdigit():
            out.append((s, e, stratum(m[0]), min(BINS - 1, int(evidence(m[0]) / STEP))))
    return out


_SPAN = "struct<s:bigint,k:int,e:bigint>"
_SCANNED = f"base array<{_SPAN}>, runs array<struct<s:bigint,e:bigint,stratum:string,bin:int>>"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and candidate runs of every text."""
    base_type = pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())]))
    runs_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("stratum", pa.string()), ("bin", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = strings(batch.column("text")).to_pylist()
                base = [base_spans(t) for t in texts]
                runs = [candidates(t, b) for t, b in zip(texts, base)]
                columns = [
                    batch.column("doc_id"),
                    pa.array([[{"s": s, "k": k, "e": e} for s, k, e in x] for x in base], base_type),
                    pa.array([[{"s": s, "e": e, "stratum": q, "bin": b} for s, e, q, b in x] for x in runs], runs_type),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "runs"])

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, {_SCANNED}")


def thresholds(histogram: dict[tuple[str, int], int], rate: float = FDR) -> dict[str, int]:
    """Each stratum's least bin that the step-up rejects; strata without one are left out."""
    out = {}
    for name in {s for s, _ in histogram}:
        counts = [histogram.get((name, b), 0) for b in range(BINS)]
        total, above = sum(counts), 0
        for b in range(BINS - 1, -1, -1):
            above += counts[b]
            if above and 10 ** (-b * STEP) * total <= rate * above:
                out[name] = b
    return out


def spans(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """doc_id, base and all: arrays of (s, k, e), k the kind's place in KINDS, for every row of docs."""
    rows = settled(scanned(docs))
    bins = rows.select(F.explode("runs").alias("r")).groupBy("r.stratum", "r.bin").count().collect()
    least = thresholds({(r["stratum"], r["bin"]): r["count"] for r in bins}, rate)
    table = F.create_map(*[F.lit(x) for kv in sorted(least.items()) for x in kv]) if least else F.lit(None).cast("map<string,int>")
    found = F.filter("runs", lambda r: F.coalesce(r["bin"] >= F.try_element_at(table, r["stratum"]), F.lit(False)))
    added = F.transform(found, lambda r: F.struct(r["s"].alias("s"), F.lit(3).alias("k"), r["e"].alias("e")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("every"))


def written(spans: str):
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and written spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written("base"), 256).alias("base_sha256"), written("every").alias("spans"))
