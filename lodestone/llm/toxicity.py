"""Toxicity: a linear-chain conditional random field tags toxic spans; marginals make document scores.

Learning, on the driver, from a bounded sample of labelled rows (TRAIN_ROWS of each label, least hashes first; equal texts
count once):
1. Tokens are runs of letters, lower-cased. Features: the token, and its first 3 to 6 letters. Features whose documents
   are toxic far more often than others (smoothed log odds, a lower bound) label tokens of toxic documents weakly: 1 where
   such a feature holds; all tokens of documents that aren't toxic are 0.
2. A two-state chain with those features is fitted by gradient ascent on the exact conditional likelihood of these tags
   (forward-backward), with an L2 penalty.
3. A document's score is a logistic function of two sums of its marginals, fitted on the document labels.

Scoring: tokens without any known feature have one constant potential, so a run of m of them is the m-th power of one
2x2 matrix. Forward-backward steps over known tokens only, exactly, whatever the text's length. Offending spans are known
tokens with a marginal of SPAN or more.

Defined results: null text counts as empty and scores as a text without known tokens; rows with null label or id teach
nothing; where one of the labels is missing altogether every score is the share of toxic labels (0 without labels);
repeated rows score alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, settled, slices, strings

#: Different texts of each label that are learned from, at most.
TRAIN_ROWS = 2000
THRESHOLD = 0.7
SPAN = 0.5
LEAST_DOCS = 3
LEAST_ODDS = 2.0
PREFIXES = (3, 4, 5, 6)
#: Most tokens of one training sequence; longer ones are cut.
WINDOW = 64
_TOKEN = re.compile(r"[^\W\d_]+")


def features(token: str) -> list[str]:
    return [token, *(f"{token[:n]}-" for n in PREFIXES if len(token) > n)]


class Crf:
    """Weights of known features, of tokens without any, of the two tags' transitions, and of the document score."""

    def __init__(self, weights: dict[str, float], blank: float, trans: np.ndarray, start: np.ndarray, score: tuple[float, float, float]):
        self.weights, self.blank, self.trans, self.start, self.score = weights, blank, trans, start, score
        self._step = np.exp(trans) * np.array([1.0, math.exp(blank)])  # into a token without features
        self._powers: dict[int, np.ndarray] = {}
        self._tokens: dict[str, float | None] = {}

    def _power(self, m: int) -> np.ndarray:
        """The matrix of m tokens without features, scaled to a largest entry of 1."""
        if (x := self._powers.get(m)) is None:
            x, base, k = np.eye(2), self._step / self._step.max(), m
            while k:
                if k & 1:
                    x = x @ base
                    x /= x.max()
                base = base @ base
                base /= base.max()
                k >>= 1
            if len(self._powers) < 100_000:
                self._powers[m] = x
        return x

    def emission(self, token: str) -> float | None:
        """The token's potential for tag 1, None without known features."""
        if token in self._tokens:
            return self._tokens[token]
        known = [w for f in features(token.lower()) if (w := self.weights.get(f)) is not None]
        x = self.blank + sum(known) if known else None
        if len(self._tokens) > 300_000:
            self._tokens.clear()
        self._tokens[token] = x
        return x

    def marginals(self, emissions: list[tuple[int, float]], n: int) -> np.ndarray:
        """P(tag 1) at the known places of n tokens."""
        k = len(emissions)
        into, hops = [], []
        last = -1
        for i, e in emissions:
            gap = i - last - 1
            if last < 0:
                first = np.exp(self.start)
                if gap:
                    first = (first * [1.0, math.exp(self.blank)]) @ self._power(gap - 1)
                    first = first / first.sum() @ np.exp(self.trans)
                into.append(first)
            else:
                hops.append(self._power(gap) @ np.exp(self.trans))
            last = i
        own = np.array([[1.0, math.exp(min(e, 50.0))] for _, e in emissions])
        ahead = np.empty((k, 2))
        a = into[0] * own[0]
        ahead[0] = a / a.sum()
        for t in range(1, k):
            a = (ahead[t - 1] @ hops[t - 1]) * own[t]
            ahead[t] = a / a.sum()
        behind = self._power(n - 1 - last) @ np.ones(2)
        out = np.empty(k)
        for t in range(k - 1, -1, -1):
            both = ahead[t] * behind
            out[t] = both[1] / both.sum()
            if t:
                behind = hops[t - 1] @ (own[t] * behind)
                behind = behind / behind.max()
        return out

    def tagged(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """(start, end, marginal) of the known tokens, and the number of tokens."""
        get, emission = self._tokens.get, self.emission
        tokens = _TOKEN.findall(text)
        known = []
        for i, t in enumerate(tokens):
            if (e := get(t, 0)) is None or (e == 0 and (e := emission(t)) is None):
                continue
            known.append((i, e))
        n = len(tokens)
        if not known:
            return [], n
        places = {i for i, _ in known}
        spans = [m.span() for i, m in enumerate(_TOKEN.finditer(text)) if i in places]
        return [(s, e, float(p)) for (s, e), p in zip(spans, self.marginals(known, n))], n

    def sums(self, tags: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        """What a document's score rests on: expected toxic tokens (log), and the chance of any, of known ones."""
        p = np.array([x for *_, x in tags])
        return math.log1p(p.sum()), 1 - math.exp(np.log1p(-np.minimum(p, 1 - 1e-9)).sum()) if len(p) else 0.0

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score and tagged known tokens."""
        tags, n = self.tagged(text)
        x, y = self.sums(tags, n)
        a, b, c = self.score
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x + c * y)))), [t for t in tags if t[2] >= SPAN]


def _lexicon(texts: list[str], toxic: list[int]) -> dict[str, float]:
    """Features whose documents are toxic far more often than not, by a lower bound of the smoothed log odds ratio."""
    seen = [Counter(), Counter()]
    size = [toxic.count(0), toxic.count(1)]
    for t, y in zip(texts, toxic):
        seen[y].update({f for w in set(_TOKEN.findall(t.lower())) for f in features(w)})
    out = {}
    for f, k in seen[1].items():
        if k < LEAST_DOCS:
            continue
        a, b, c, d = k + 0.5, size[1] - k + 0.5, seen[0][f] + 0.5, size[0] - seen[0][f] + 0.5
        odds = math.log(a / b) - math.log(c / d) - 1.64 * math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        if odds > LEAST_ODDS / 2 and a / c > math.exp(LEAST_ODDS):
            out[f] = odds
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, a column of ones first in x."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * w
        h = (x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fitted(texts: list[str], toxic: list[int], rounds: int = 120, ridge: float = 2.0) -> Crf:
    """The model of labelled texts; deterministic."""
    lexicon = _lexicon(texts, toxic)
    names = sorted(lexicon)
    place = {f: i for i, f in enumerate(names)}
    # Only windows around known tokens teach the chain; the rest are runs of tag 0 without features.
    rows: list[tuple[list[list[int]], list[int]]] = []
    for t, y in zip(texts, toxic):
        tokens = [[place[f] for f in features(w) if f in place] for w in _TOKEN.findall(t.lower())]
        hits = [i for i, f in enumerate(tokens) if f]
        near = sorted({j for i in hits for j in range(max(0, i - 4), min(len(tokens), i + 5))} | set(range(min(4, len(tokens)))))
        run: list[int] = []
        for j in [*near, -1]:
            if run and (j != run[-1] + 1 or len(run) == WINDOW):
                rows.append(([tokens[k] for k in run], [int(bool(y and tokens[k])) for k in run]))
                run = []
            run.append(j)
    rows = [r for r in rows if r[0]]
    rows.sort(key=lambda r: len(r[0]))
    n, long_ = len(rows), max((len(r[0]) for r in rows), default=1)
    mask = np.zeros((n, long_), bool)
    tags = np.zeros((n, long_), int)
    at_row, at_place, at_feature = [], [], []
    for i, (fs, ys) in enumerate(rows):
        mask[i, : len(fs)] = True
        tags[i, : len(ys)] = ys
        for j, f in enumerate(fs):
            at_row += [i] * len(f)
            at_place += [j] * len(f)
            at_feature += f
    flat = np.array(at_row, int) * long_ + np.array(at_place, int)
    feature = np.array(at_feature, int)
    w, blank, trans, start = np.zeros(len(names)), -3.0, np.zeros((2, 2)), np.zeros(2)
    # Adam on the mean log-likelihood; the gradient is observed minus expected counts.
    theta = np.concatenate([w, [blank], trans.ravel(), start])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pair_seen = mask[:, 1:] & mask[:, :-1]
    for turn in range(1, rounds + 1):
        w, blank, trans, start = theta[: len(names)], theta[len(names)], theta[len(names) + 1 : len(names) + 5].reshape(2, 2), theta[-2:]
        emit = blank + np.bincount(flat, weights=w[feature], minlength=n * long_).reshape(n, long_)
        own = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], axis=2)
        move = np.exp(trans)
        ahead = np.zeros((n, long_, 2))
        a = np.exp(start) * own[:, 0]
        ahead[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, long_):
            a = (ahead[:, t - 1] @ move) * own[:, t]
            ahead[:, t] = np.where(mask[:, t, None], a / a.sum(1, keepdims=True), ahead[:, t - 1])
        behind = np.ones((n, long_, 2))
        for t in range(long_ - 2, -1, -1):
            b = (own[:, t + 1] * behind[:, t + 1]) @ move.T
            behind[:, t] = np.where(mask[:, t + 1, None], b / b.max(1, keepdims=True), 1.0)
        p = ahead * behind
        p /= p.sum(2, keepdims=True)
        pairs = ahead[:, :-1, :, None] * move * (own[:, 1:] * behind[:, 1:])[:, :, None, :]
        pairs /= pairs.sum((2, 3), keepdims=True)
        gap = np.where(mask, tags - p[:, :, 1], 0.0)
        seen = np.array([[(pair_seen & (tags[:, :-1] == i) & (tags[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
        g_trans = seen - (pairs * pair_seen[:, :, None, None]).sum((0, 1))
        g_start = np.array([(tags[:, 0] == i).sum() for i in (0, 1)]) - p[:, 0].sum(0)
        g = np.concatenate([np.bincount(feature, weights=gap.ravel()[flat], minlength=len(names)), [gap.sum()], g_trans.ravel(), g_start]) / max(1, n)
        g -= ridge / max(1, n) * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.2 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    crf = Crf({f: float(theta[i]) for f, i in place.items()}, float(theta[len(names)]), theta[len(names) + 1 : len(names) + 5].reshape(2, 2).copy(), theta[-2:].copy(), (0.0, 0.0, 0.0))
    sums = np.array([crf.sums(*crf.tagged(t)) for t in texts]).reshape(-1, 2)
    score = _logistic(np.column_stack([np.ones(len(sums)), sums]), np.array(toxic, float))
    crf.score = tuple(map(float, score))
    return crf


def held_out(doc_id: str = "doc_id"):
    """The fold that no label is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[list[str], list[int]]:
    """Up to `most` different texts of each label outside the held-out fold, those of the least hashes: a bounded sample."""
    labelled = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("_doc"), F.col("toxic").cast("int").alias("_toxic")).where(~held_out("_doc"))
    hashes = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    rows = settled(hashes.join(labelled, F.col("doc_id") == F.col("_doc")).groupBy("_toxic", "h").agg(F.min("doc_id").alias("doc_id")))
    chosen = [(r["doc_id"], y) for y in (0, 1) for r in rows.where(F.col("_toxic") == y).orderBy("h").limit(most).collect()]
    if not chosen:
        return [], []
    wanted = docs.sparkSession.createDataFrame(chosen, "_doc long, _toxic int")  # 2 * most rows at most
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("_doc")).select("text", "_toxic").distinct().collect()
    pairs = sorted(((r["_toxic"], r["text"] or "") for r in found))
    return [t for _, t in pairs], [y for y, _ in pairs]


def model(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Crf | float:
    """The fitted field, or the constant score where a label is missing."""
    texts, toxic = training_rows(docs, labels, most)
    if len(set(toxic)) < 2:
        return sum(toxic) / len(toxic) if toxic else 0.0
    return fitted(texts, toxic)


def scored(docs: DataFrame, crf: Crf | float) -> DataFrame:
    """doc_id, score, spans (start:end:marginal of offending tokens, comma-joined; code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for whole in batches:
            for batch in slices(whole):
                made = [crf.document(t) if isinstance(crf, Crf) else (crf, []) for t in strings(batch.column("text")).to_pylist()]
                spans = [",".join(f"{s}:{e}:{p:.3f}" for s, e, p in x) for _, x in made]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in made], pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "score", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, spans string")
