"""Encoding with a public byte-level BPE vocabulary.

The encoder needs no merge loop. An Aho-Corasick automaton over the reversed tokens gives, in one pass, the longest
token that starts at each byte. From left to right the encoder takes the longest token that may stand beside the one
before it, falls back to that token's longest proper prefix where it may not, and steps back where no prefix fits. Two
tokens may stand side by side if undoing their merges, youngest first, never meets a pair that merging would have joined
earlier; answers are kept in a compatibility table. A position that once proved to be a dead end is never tried again, so
the work is linear. Decoding slices one byte string by an offset table.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import keyed_text, map_arrow, spread

VOCABULARY = "byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the vocabulary's split
CACHE = 400_000  # pieces remembered by one worker before it starts afresh


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """Characters by which the vocabulary file writes bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Exact BPE of one vocabulary file (``vocab`` and ``merges``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        ids = {raw(s): i for s, i in model["vocab"].items() if all(c in alphabet for c in s)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ids = {}
        self.rank = {}  # by token: when it is merged; single bytes come first
        self.parts = {}  # token -> the two tokens it is merged from; a byte has none
        self.joined = {}  # pair -> token
        for data, i in ids.items():
            if len(data) == 1:
                self.ids[data], self.rank[i] = i, -1
        for k, (a, b) in enumerate(merges):
            pair = ids[raw(a)], ids[raw(b)]
            whole = raw(a + b)
            i = self.ids[whole] = ids[whole]
            self.rank[i], self.parts[i], self.joined[pair] = k, pair, i
        self.size = max(self.ids.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        self.automaton = ahocorasick.Automaton()
        for data, i in self.ids.items():
            self.bytes_of[i] = data
            self.automaton.add_word(data[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])])
        self.blob = b"".join(self.bytes_of)
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE of the joined bytes leaves the border between the two tokens alone."""
        answer = self.fits.get((left, right))
        if answer is None:
            answer = self.fits[left, right] = self._may_follow(left, right)
        return answer

    def _may_follow(self, left: int, right: int) -> bool:
        rank, parts = self.rank, self.parts
        # (bound, side): a merge across the border wins if it ranks below the merge that was undone last; at equal
        # rank the one further left goes first
        bound, on_right = len(self.joined), False
        while True:
            across = self.joined.get((left, right))
            if across is not None and (rank[across] < bound or (on_right and rank[across] == bound)):
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            # undo the merge that BPE does last: the higher rank; of two equal ones the right one
            if b is None or (a is not None and rank[left] > rank[right]):
                bound, on_right, left = rank[left], False, a[1]
            else:
                bound, on_right, right = rank[right], True, b[0]

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        found = self.shorter.get(token)
        if found is None:
            data = self.bytes_of[token]
            found = self.shorter[token] = next((self.ids[data[:k]] for k in range(len(data) - 1, 0, -1) if data[:k] in self.ids), -1)
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        n = len(data)
        longest = [-1] * n
        for end, token in self.automaton.iter(data[::-1].decode("latin-1")):
            start = n - 1 - end
            if longest[start] < 0 or len(self.bytes_of[token]) > len(self.bytes_of[longest[start]]):
                longest[start] = token
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            end = at + len(self.bytes_of[token])
            if open_at[end] and (not out or self.may_follow(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = self._prefix(token)
            if token < 0:
                open_at[at] = 0
                token = out.pop()
                at -= len(self.bytes_of[token])
        return out

    def piece(self, text: str) -> tuple[int, ...]:
        found = self.known.get(text)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[text] = tuple(self.encode_piece(text.encode("utf-8", "replace")))
        return found

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known = self.known
        return list(chain.from_iterable([known.get(p) or self.piece(p) for p in self.split.findall(text)]))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known = self.known
        return sum([len(known.get(p) or self.piece(p)) for p in self.split.findall(text)])

    def decode(self, ids: Iterable[int]) -> str:
        off, blob = self.offsets, self.blob
        return b"".join([blob[off[i] : off[i + 1]] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a process and file."""
    return Encoder(path)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Token ids of every text, without special tokens: ``<id_col>, ids array<int>``.

    Null and empty texts get the empty list, blank texts their tokens; repeated rows stay rows of their own.
    ``vocabulary`` is the path of a vocabulary file, by default the one of the installed public tokenizers.
    """
    path = vocabulary or vocabulary_path()

    def run(batches):
        own = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for k in range(0, len(texts), 500):
                rows = [own.encode(t) for t in texts[k : k + 500]]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
                yield {id_col: keys.slice(k, len(rows)), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}

    return map_arrow(spread(keyed_text(df, id_col, text_col)), run, f"`{id_col}` long, ids array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The texts behind lists of token ids: ``<id_col>, text``; an empty or null list gives the empty text."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        own = encoder(path)
        for batch in batches:
            yield {id_col: batch.column(0), "text": [own.decode(x or ()) for x in batch.column(1).to_pylist()]}

    return map_arrow(df.select(F.col(id_col).cast("long"), ids_col), run, f"`{id_col}` long, text string")


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: list[str], vocabulary: str | None = None) -> DataFrame:
    """``<id_col>``, the string columns ``keep``, and ``n_tokens`` (0 for null and empty texts)."""
    path = vocabulary or vocabulary_path()

    def run(batches):
        own = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield {id_col: batch.column(0), "n_tokens": [own.count(t) for t in texts]} | {c: batch.column(2 + k) for k, c in enumerate(keep)}

    source = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).cast("string").alias(c) for c in keep])
    return map_arrow(spread(source), run, f"`{id_col}` long, n_tokens long, " + ", ".join(f"`{c}` string" for c in keep))
