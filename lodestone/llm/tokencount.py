"""Token counts by prefix dynamic programming.

`PrefixTable` holds the exact token count at the end of every chunk of a text (the sum of its chunks' counts, each from
the prefix dynamic programme of `wordbpe`), and answers for any prefix of code points with one partial chunk: how many
tokens has text[:i], and how far does a budget reach. `counts` does the same in bulk for a table.

Defined results: null text counts as empty (0 tokens); very long texts are slices of their own; repeated rows repeat;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import wordbpe
from .shared import mapped, slices, strings

LIMIT = 2048
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")


class PrefixTable:
    """Exact token counts of all prefixes of one text."""

    def __init__(self, text: str, path: str):
        self.bpe, self.text = wordbpe.load(path), text
        spans = [m.span() for m in _CHUNK.finditer(text)]
        own = self.bpe.chunk_counts(pa.array([text[s:e] for s, e in spans], pa.large_string())) if spans else np.zeros(0, np.int64)
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]
        self.counts = np.concatenate([[0], np.cumsum(own)])

    def count(self, i: int | None = None) -> int:
        """Tokens of text[:i]."""
        i = len(self.text) if i is None else i
        k = bisect_left(self.ends, i)
        if k < len(self.ends) and self.ends[k] == i:
            k += 1
        part = self.text[self.starts[k] : i] if k < len(self.starts) and self.starts[k] < i else ""
        return int(self.counts[k]) + (self.bpe.chunk_count(part) if part else 0)

    def fit(self, budget: int) -> int:
        """The length of the longest prefix with at most `budget` tokens.

        Counts at chunk ends never fall, so the answer lies in or before the first chunk that ends above the budget."""
        k = int(np.searchsorted(self.counts[1:], budget, side="right"))
        if k == len(self.ends):
            return len(self.text)
        for i in range(self.ends[k] - 1, self.starts[k], -1):
            if self.count(i) <= budget:
                return i
        return self.starts[k]


def counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chunks: chunks of the longest whole-chunk prefix within the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(path)
        for whole in batches:
            for batch in slices(whole, most=16 << 20):
                texts = strings(batch.column("text"))
                per, index, chunks = wordbpe.coded(texts)
                prefix = np.concatenate([[0], np.cumsum(bpe.chunk_counts(chunks)[index])]) if len(index) else np.zeros(1, np.int64)
                end = np.cumsum(per)
                begin = end - per
                n = prefix[end] - prefix[begin]
                fit = np.searchsorted(prefix, prefix[begin] + limit, side="right") - 1 - begin
                size = pc.binary_length(texts).cast(pa.int64())
                columns = [batch.column("doc_id"), size, pa.array(n), pa.array(n > limit), pa.array(np.minimum(fit, per))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chunks"])

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chunks long")
