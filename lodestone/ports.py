"""Ports for models that the engine can't hold: plain callables on lists, with deterministic stand-ins.

A port must be picklable and idempotent; it runs on executors, batch by batch."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter


def embed(texts: list[str], dimensions: int = 64) -> list[list[float]]:
    """Stand-in embedding: signed hashed word counts, unit length."""
    out = []
    for t in texts:
        v = [0.0] * dimensions
        for w, n in Counter(re.findall(r"\w+", t.lower())).items():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dimensions] += n if h >> 63 else -n
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / norm for x in v])
    return out


def embed_batches(texts: list[str], port=embed, batch: int = 80, least: int = 10) -> list[list[float]]:
    """A port asked in batches; a batch that is too large for it is halved, down to `least` texts."""
    out: list[list[float]] = []
    for at in range(0, len(texts), batch):
        out += _halved(texts[at : at + batch], port, least)
    return out


def _halved(texts: list[str], port, least: int) -> list[list[float]]:
    try:
        return port(texts)
    except ValueError:
        if len(texts) < least:
            raise
        mid = len(texts) // 2
        return _halved(texts[:mid], port, least) + _halved(texts[mid:], port, least)


def judge(prompts: list[str]) -> list[str]:
    """Stand-in judge: a score from the words that answer and reference share."""
    out = []
    for p in prompts:
        answer, reference = (set(re.findall(r"\w+", (re.search(rf"(?m)^{k}: (.*)$", p) or [None, ""])[1].lower())) for k in ("Answer", "Reference"))
        share = len(answer & reference) / max(1, len(answer | reference))
        out.append(json.dumps({"score": 1 + round(4 * share), "reasoning": f"{len(answer & reference)} shared words"}))
    return out


def answer(prompts: list[str]) -> list[str]:
    """Stand-in answerer: the first line of code in the prompt."""
    out = []
    for p in prompts:
        line = (re.search(r"```\n([^\n]*)", p) or [None, ""])[1].strip()
        out.append(json.dumps({"thought": "first line", "ground_truth": line, "answer": line}))
    return out
