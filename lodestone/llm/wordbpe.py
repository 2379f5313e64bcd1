"""BPE with word ends (`</w>`): exact ids, and exact token counts of every prefix by dynamic programming.

Texts fall into chunks at ASCII white space; no rule of the tokenizer reaches across it, so a text's ids are its chunks'
ids one after the other. A chunk falls into the special strings, and pieces as the library's normaliser and splitter give
them. Chunks of plain Latin letters with closing marks, the common kind, are split here by the same rule, in bulk.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

from .shared import words

#: Entries kept in a worker's caches; a fuller cache starts anew. Bounds memory, never results.
CACHE = 150_000
#: Letters whose lower case and normal form (NFC) are code point for code point, then marks that form one piece.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-į]*[.,;:!?|]*$"
MARKS = ".,;:!?|"
#: Chunks of these code points alone are split here too; LATIN is the library's splitting rule for them.
NARROW = "^[!-~À-ÖØ-öø-į]+$"
LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-į]+|[0-9]|[^a-zß-öø-į0-9]+")
END = b"\xff"  # never in UTF-8; stands for a word's end


def _byte_chars() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 as itself, other bytes from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))
        alphabet = _byte_chars()
        self._alphabet = str.maketrans({c: chr(b) for c, b in alphabet.items()})
        vocab = model["model"]["vocab"]
        raw = lambda t: t.translate(self._alphabet).encode("latin-1")
        self.inner = {raw(t): i for t, i in vocab.items() if not t.endswith("</w>")}
        self.final = {raw(t[:-4]): i for t, i in vocab.items() if t.endswith("</w>") and t != "</w>"}
        self.symbols = {i: [self.inner[b[k : k + 1]] for k in range(len(b))] for b, i in self.inner.items()}
        self.symbols |= {i: [*(self.inner[b[k : k + 1]] for k in range(len(b) - 1)), self.final[b[-1:]]] for b, i in self.final.items()}
        self.spelt = {i: b for b, i in self.inner.items()} | {i: b + END for b, i in self.final.items()}
        self.merges = {}
        for rank, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"]):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self._narrow = re.compile(NARROW)
        self._apart: dict[int, bool] = {}
        self._counts: dict[bytes, int] = {}
        self._ids: dict[bytes, bytes] = {}

    # --- exact pieces

    def pieces(self, chunk: str) -> list[bytes | int]:
        """A chunk's pieces as bytes, special strings as their ids: the library's own steps."""
        if self._narrow.match(chunk) and not self._special.search(chunk):
            return [p.encode() for p in LATIN.findall(chunk.lower())]
        out: list[bytes | int] = []
        at = 0
        for m in [*self._special.finditer(chunk), None]:
            if part := chunk[at : m.start() if m else len(chunk)]:
                split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out += [p.translate(self._alphabet).encode("latin-1") for p, _ in split]
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    # --- merges of one piece, step by step: the definition; `ranks` below gives the same, and tests compare both

    def merged(self, ids: list[int]) -> list[int]:
        ids = list(ids)
        while len(ids) > 1:
            best = min((self.merges.get(p, (1 << 60, 0))[0] for p in zip(ids, ids[1:])))
            if best == 1 << 60:
                break
            k = next(k for k, p in enumerate(zip(ids, ids[1:])) if self.merges.get(p, (-1, 0))[0] == best)
            ids[k : k + 2] = [self.merges[ids[k], ids[k + 1]][1]]
        return ids

    def apart(self, a: int, b: int) -> bool:
        """Do tokens a, b stand side by side in an encoding? They do iff their joint string is encoded as a, b."""
        if (known := self._apart.get(key := a << 20 | b)) is None:
            if len(self._apart) > 4 * CACHE:
                self._apart.clear()
            known = self._apart[key] = self.ranks._encode_single_piece(self.spelt[a] + self.spelt[b]) == [a, b]
        return known

    @lru_cache(maxsize=1 << 16)  # noqa: B019 - as many as there are tokens
    def whole(self, a: int) -> bool:
        """Is the token its own string's encoding?"""
        return self.merged(self.symbols[a]) == [a]

    # --- prefix dynamic programming

    @property
    def matches(self) -> ahocorasick.Automaton:
        """Every token that ends at each place. Made at its first use: ids go without it."""
        if not hasattr(self, "_matches"):
            made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for b, i in self.inner.items():
                if self.whole(i):
                    made.add_word(b.decode("latin-1"), i << 6 | len(b))
            made.make_automaton()
            self._matches = made
        return self._matches

    def inner_prefixes(self, piece: bytes, most: int) -> tuple[list[int], list[int]]:
        """For each prefix of up to `most` bytes without a word's end: number of tokens, last token (-1: empty prefix).

        An encoding without its last token is the encoding of the shorter string; so the last token of a prefix is
        the one token that ends there and may stand after the last token of the prefix before it."""
        count, last = [0] * (most + 1), [-1] * (most + 1)
        known, done = self._apart.get, 0
        for end, v in self.matches.iter(piece[:most].decode("latin-1")):
            if end < done:
                continue  # the last token of this prefix is found
            q, t = end + 1 - (v & 63), v >> 6
            if q:
                if (fits := known(last[q] << 20 | t)) is None:
                    fits = self.apart(last[q], t)
                if not fits:
                    continue
            done = end + 1
            count[done], last[done] = count[q] + 1, t
        return count, last

    def ended(self, piece: bytes, p: int, count: list[int], last: list[int]) -> int:
        """Tokens of the first p bytes as a word of its own."""
        for q in range(p - 1, max(0, p - self.longest) - 1, -1):
            if (t := self.final.get(piece[q:p])) is not None and (self.apart(last[q], t) if q else self.whole(t)):
                return count[q] + 1
        return 0

    def piece_count(self, piece: bytes) -> int:
        if (n := self._counts.get(piece)) is None:
            if len(self._counts) > CACHE:
                self._counts.clear()
            n = self._counts[piece] = self.ended(piece, len(piece), *self.inner_prefixes(piece, len(piece) - 1))
        return n

    def chunk_count(self, chunk: str) -> int:
        return sum(1 if isinstance(p, int) else self.piece_count(p) for p in self.pieces(chunk))

    # --- ids

    @property
    def ranks(self) -> tiktoken.Encoding:
        """The same merges by ranks: a word's end is a byte of its own that joins the byte before it first of all."""
        if not hasattr(self, "_ranks"):
            table = {b: i for b, i in self.inner.items() if self.whole(i)} | {b + END: i for b, i in self.final.items() if self.whole(i)}
            self._ranks = tiktoken.Encoding("word_ends", pat_str=r"\S+", mergeable_ranks=table, special_tokens={})
        return self._ranks

    def piece_ids(self, piece: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of one piece."""
        if (x := self._ids.get(piece)) is None:
            if len(self._ids) > CACHE:
                self._ids.clear()
            x = self._ids[piece] = np.array(self.ranks._encode_single_piece(piece + END), "<u4").tobytes()
        return x

    def chunk_ids(self, chunk: str) -> bytes:
        return b"".join(np.array([p], "<u4").tobytes() if isinstance(p, int) else self.piece_ids(p) for p in self.pieces(chunk))

    # --- many chunks

    def _split(self, chunks: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array]:
        """(is plain; of the plain: distinct letters, index into them, marks)."""
        plain = pc.match_substring_regex(chunks, PLAIN)
        low = pc.utf8_lower(chunks.filter(plain))
        core = pc.utf8_rtrim(low, characters=MARKS)
        coded = core.dictionary_encode()
        tail = pc.binary_length(low).to_numpy(zero_copy_only=False) - pc.binary_length(core).to_numpy(zero_copy_only=False)
        return plain.to_numpy(zero_copy_only=False), coded, tail, low

    def chunk_counts(self, chunks: pa.Array) -> np.ndarray:
        """Tokens of each of many different chunks."""
        plain, coded, tail, low = self._split(chunks)
        out = np.zeros(len(chunks), np.int64)
        count = self.piece_count
        own = np.array([count(w) if w else 0 for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.int64)
        some = own[coded.indices.to_numpy(zero_copy_only=False)] if len(low) else np.zeros(0, np.int64)
        if tail.any():
            lows = low.to_pylist()
            for k, n in zip(np.flatnonzero(tail).tolist(), tail[tail > 0].tolist()):
                some[k] += count(lows[k][-n:].encode())
        out[plain] = some
        for k, chunk in zip(np.flatnonzero(~plain).tolist(), chunks.filter(pa.array(~plain)).to_pylist()):
            out[k] = self.chunk_count(chunk)
        return out

    def chunk_id_lists(self, chunks: pa.Array) -> list[bytes]:
        """Ids of each of many different chunks."""
        plain, coded, tail, low = self._split(chunks)
        out: list[bytes] = [b""] * len(chunks)
        ids = self.piece_ids
        own = [ids(w) if w else b"" for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
        for k, i, n, w in zip(np.flatnonzero(plain).tolist(), coded.indices.to_pylist(), tail.tolist(), low.to_pylist()):
            out[k] = own[i] + ids(w[-n:].encode()) if n else own[i]
        for k, chunk in zip(np.flatnonzero(~plain).tolist(), chunks.filter(pa.array(~plain)).to_pylist()):
            out[k] = self.chunk_ids(chunk)
        return out


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One for each worker process and vocabulary."""
    return WordBpe(path)


@lru_cache(maxsize=2)
def load_ids(path: str) -> WordBpe:
    """One as `load` gives, for ids alone: once the ranks are made, the tables that only merges step by step and counts
    read are given up, and asking for these fails."""
    made = WordBpe(path)
    _ = made.ranks  # made from the tables that go now
    del made.symbols, made.merges, made.spelt, made.inner, made.final
    WordBpe.whole.cache_clear()
    return made


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(each text's number of chunks, every chunk's index into the distinct chunks, the distinct chunks)."""
    per, flat = words(texts)
    d = flat.dictionary_encode()
    return per, d.indices.to_numpy(zero_copy_only=False), d.dictionary
