"""Corpus-wide term statistics by burst-trie counting.

Every worker routes the terms of its rows into a burst trie: containers hang below adaptive prefixes, and a container
that outgrows ``BURST`` terms bursts into one container for each next character. A container leaves the worker as one
front-coded blob under its prefix. Blobs of one prefix meet in one task, where they stream into a trie again, so
matching subtrees merge. Workers may have burst to different depths; a last sum by term joins those, over rows that
number no more than the distinct terms of each task.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import durable, map_arrow, spread

BURST = 512  # terms of a container before it bursts
FLUSH = 400_000  # distinct terms that one task holds before it hands its trie on
ROWS = "\0"  # stands for the rows themselves; no term holds it
TERM = regex.compile(r"[\p{L}\p{M}]+")


class BurstTrie:
    """Term counters (occurrences, records) in containers below adaptive prefixes."""

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.size = 0
        self.inner: set[str] = {""}
        self.containers: dict[str, dict[str, list[int]]] = {}

    def route(self, term: str) -> str:
        """The shortest prefix that isn't burst; a term that ends inside the burst part is its own prefix."""
        for k in range(1, len(term)):
            if term[:k] not in self.inner:
                return term[:k]
        return term

    def add(self, term: str, occurrences: int, records: int) -> None:
        prefix = self.route(term)
        box = self.containers.setdefault(prefix, {})
        at = box.get(term)
        if at is not None:
            at[0] += occurrences
            at[1] += records
            return
        box[term] = [occurrences, records]
        self.size += 1
        if len(box) > self.burst:
            self._burst(prefix)

    def _burst(self, prefix: str) -> None:
        self.inner.add(prefix)
        deeper = len(prefix) + 1
        for term, at in self.containers.pop(prefix).items():
            self.containers.setdefault(term[:deeper], {})[term] = at
        # a container may be as full as before when all its terms share the next character
        for child in [p for p in self.containers if len(p) == deeper and p.startswith(prefix) and len(self.containers[p]) > self.burst]:
            self._burst(child)

    def blobs(self) -> Iterator[tuple[str, bytes]]:
        for prefix, box in self.containers.items():
            yield prefix, pack(sorted(box), box)


def pack(terms: list[str], counts: dict[str, list[int]]) -> bytes:
    """Front coding: each term as the length it shares with the one before, and the rest."""
    last, shared, rests = "", [], []
    for term in terms:
        k, most = 0, min(len(last), len(term))
        while k < most and last[k] == term[k]:
            k += 1
        shared.append(k)
        rests.append(term[k:])
        last = term
    numbers = np.array([shared, [counts[t][0] for t in terms], [counts[t][1] for t in terms]], np.int64)
    return struct.pack("<I", len(terms)) + numbers.tobytes() + "\n".join(rests).encode()


def unpack(blob: bytes) -> Iterator[tuple[str, int, int]]:
    (n,) = struct.unpack_from("<I", blob)
    shared, occurrences, records = np.frombuffer(blob, np.int64, 3 * n, 4).reshape(3, n).tolist()
    last = ""
    for k, rest, o, r in zip(shared, blob[4 + 24 * n :].decode().split("\n"), occurrences, records):
        last = last[:k] + rest
        yield last, o, r


def fold(text: str) -> str:
    """SQL ``lower``: character by character, so a capital sigma never becomes the final form."""
    return text.replace("Σ", "σ").lower()


def _drain(trie: BurstTrie) -> Iterator[dict[str, list]]:
    pairs = list(trie.blobs())
    for k in range(0, len(pairs), 5000):
        yield {"prefix": [p for p, _ in pairs[k : k + 5000]], "blob": [b for _, b in pairs[k : k + 5000]]}


def _count(batches: Iterable) -> Iterator[dict[str, list]]:
    trie = BurstTrie()
    for batch in batches:
        occurrences: Counter[str] = Counter()
        records: Counter[str] = Counter()
        texts = batch.column(0).to_pylist()
        trie.add(ROWS, len(texts), len(texts))
        for k in range(0, len(texts), 2000):
            found = [TERM.findall(fold(t)) for t in texts[k : k + 2000]]
            occurrences.update(chain.from_iterable(found))
            records.update(chain.from_iterable(map(set, found)))
        for term, n in occurrences.items():
            trie.add(term, n, records[term])
        if trie.size > FLUSH:
            yield from _drain(trie)
            trie = BurstTrie()
    yield from _drain(trie)


def _merge(batches: Iterable) -> Iterator[dict[str, list]]:
    def drain(trie: BurstTrie) -> Iterator[dict[str, list]]:
        rows = [(t, *at) for box in trie.containers.values() for t, at in box.items()]
        for k in range(0, len(rows), 50_000):
            terms, occurrences, records = zip(*rows[k : k + 50_000])
            yield {"term": list(terms), "occurrences": list(occurrences), "records": list(records)}

    trie = BurstTrie()
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            for term, o, r in unpack(blob):
                trie.add(term, o, r)
            if trie.size > FLUSH:
                yield from drain(trie)
                trie = BurstTrie()
    yield from drain(trie)


def _all_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``term_counts`` with a row ``ROWS`` that counts the rows with a text."""
    texts = df.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    subtrees = map_arrow(spread(texts), _count, "prefix string, blob binary").repartition("prefix")
    partial = map_arrow(subtrees, _merge, "term string, occurrences long, records long")
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Occurrences and records of every distinct term of ``text_col``.

    A term is a longest run of letters and combining marks in the lower-cased text as stored. Null and empty texts
    hold no terms; an empty table gives an empty result; repeated rows all count. Other columns are not read.

    Returns ``term, occurrences, records``.
    """
    return _all_counts(df, text_col).where(F.col("term") != ROWS)


def frequency_mark(records: Column, total: int, rare: int = 1, common_share: float = 0.05) -> Column:
    """``rare`` for terms of at most ``rare`` records, ``common`` above ``common_share`` of all, else null.

    A term that is both (a tiny collection) is ``rare``.
    """
    return F.when(records <= rare, "rare").when(records > F.lit(common_share) * F.lit(total), "common")


def term_frequencies(df: DataFrame, text_col: str = "text", rare: int = 1, common_share: float = 0.05) -> DataFrame:
    """``term_counts`` with the ``mark`` of each term; the share refers to the rows with non-null text.

    The texts are read once: the tries count the rows too, and the counts, a row a term, are kept.
    """
    counts = durable(_all_counts(df, text_col))
    rows = counts.where(F.col("term") == ROWS).first()
    total = rows.records if rows else 0
    return counts.where(F.col("term") != ROWS).withColumn("mark", frequency_mark(F.col("records"), total, rare, common_share))
