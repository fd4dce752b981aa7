"""Long verbatim spans shared between records.

Difference-cover anchors: with a cover ``D`` modulo ``v``, any two positions i and j have some shift below ``v`` that
takes both into the cover. So if windows of ``length - v + 1`` characters are hashed at cover positions only, any common
span of ``length`` characters has an aligned pair of equal windows in it. Anchors are about a ninth of the positions.
Windows whose hash occurs in one record only are done with. The others extend: around each, every window of the full
``length`` that holds the anchor is hashed, in one record of each class of equal texts, and equal full windows nominate
pairs of classes. For each pair one such window is cut out of both texts and compared character by character. Nothing is
ever compared pair by pair before that.

What a task knows by itself never travels: anchors that recur within a task nominate their records there, and one of them
goes on. Hashes travel as packed blobs by bucket of their leading bits, a few bytes each, instead of as rows; there are as
many buckets as the input's size asks for, and a bucket is worked through in turns. Texts travel only if they hold a
recurring anchor, which a bitmap of fixed size tests before the shuffle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import durable, keyed_text, map_arrow, shuffle_width, spread

# A perfect difference set modulo 91 (every residue is a difference of two members).
PERIOD = 91
COVER = [0, 1, 3, 9, 27, 49, 56, 61, 77, 81]
LENGTH = 200
CHUNK = 1 << 20  # characters hashed at a time; longer texts are cut with overlap
AT_ONCE = 1 << 21  # hashes of a bucket that a task unpacks together
FLUSH = 1 << 20  # hashes that one task holds before it packs them
ANCHOR_BYTES = 4  # of an anchor's hash, beside its bucket; equal anchors only nominate, full windows keep all eight bytes
BUCKET_BYTES = 8 << 20  # of stored input that a bucket stands for
MOST_BUCKETS = 1 << 20
BITMAP = 1 << 20  # words of 64 bits in the bitmap of records with recurring anchors; its broadcast has at most so many rows
GROUP = 512  # records of one window that a task pairs by itself; larger groups are paired in blocks
ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


class Hasher:
    """Polynomial hashes modulo 2**64 of windows at any positions, by prefix sums."""

    def __init__(self, size: int):
        one = np.ones(size + 1, np.uint64)
        up, down = one.copy(), one.copy()
        up[1:] = np.uint64(ODD)
        down[1:] = np.uint64(pow(ODD, -1, 1 << 64))
        with np.errstate(over="ignore"):
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            own = mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(ODD)) * self.up[: len(codes)]
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])

    def windows(self, sums: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[at + width] - sums[at]) * self.down[at])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(n: int, width: int, chunk: int) -> Iterator[tuple[int, int]]:
    """Cuts of a text of ``n`` characters such that every window of ``width`` starts in exactly one of them."""
    for lo in range(0, n - width + 1, chunk):
        yield lo, min(n, lo + chunk + width - 1)


class Packer:
    """Collects (hash, record, position) and packs them by bucket."""

    def __init__(self, buckets: int, digest: int):
        self.buckets, self.digest, self.parts, self.n = buckets, digest, [], 0

    def add(self, hashes: np.ndarray, record: int, at: np.ndarray) -> None:
        self.parts.append((hashes, record, at))
        self.n += len(hashes)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All that was collected: hashes, records, positions."""
        h = np.concatenate([p[0] for p in self.parts])
        rec = np.repeat(np.array([p[1] for p in self.parts], np.int64), [len(p[0]) for p in self.parts])
        at = np.concatenate([p[2] for p in self.parts]).astype(np.int64)
        self.parts, self.n = [], 0
        return h, rec, at

    def packed(self, h: np.ndarray, rec: np.ndarray, at: np.ndarray) -> Iterator[tuple[list[int], list[bytes]]]:
        """Numbers and blobs of buckets; rows come in runs of one record with rising positions."""
        bucket = ((h >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        ends = np.append(first[1:], len(order))
        for k in range(0, len(names), 64):
            blobs = [pack(h[own], rec[own], at[own], self.digest) for own in (order[a:b] for a, b in zip(first[k : k + 64], ends[k : k + 64]))]
            yield names[k : k + 64].tolist(), blobs


def planes(x: np.ndarray, size: int) -> bytes:
    """The ``size`` low bytes of each number, byte by byte, so that equal high bytes lie together."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :size].T).tobytes()


def numbers(data: bytes, n: int, size: int, at: int, kind: type) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T
    return wide.view(kind).ravel()


def pack(h: np.ndarray, rec: np.ndarray, at: np.ndarray, digest: int) -> bytes:
    """``digest`` low bytes of each hash (the bucket holds the leading bits), records as runs, positions as steps."""
    first = np.flatnonzero(np.concatenate([[True], rec[1:] != rec[:-1]]))
    runs = np.diff(np.append(first, len(rec)))
    with np.errstate(over="ignore"):
        steps = np.diff(at, prepend=0)
        jumps = np.diff(rec[first], prepend=np.int64(0))
    steps[first] = at[first]
    size = 2 if 0 <= steps.min() and steps.max() < 1 << 16 else 8
    head = struct.pack("<IIBB", len(h), len(first), size, digest)
    return head + zstandard.compress(planes(jumps, 8) + planes(runs, 4) + planes(steps, size) + planes(h, digest), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, record ids and positions."""
    n, m, size, digest = struct.unpack_from("<IIBB", blob)
    data = zstandard.decompress(blob[10:])
    with np.errstate(over="ignore"):
        ids = np.cumsum(numbers(data, m, 8, 0, np.int64))
    runs = numbers(data, m, 4, 8 * m, np.int64)
    steps = numbers(data, n, size, 12 * m, np.int64)
    sums = np.cumsum(steps)
    starts = np.concatenate([[0], np.cumsum(runs)[:-1]])
    base = np.where(starts > 0, sums[starts - 1], 0)
    return numbers(data, n, digest, 12 * m + size * n, np.uint64), np.repeat(ids, runs), sums - np.repeat(base, runs)


def shared_groups(blobs: list[bytes], at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The (hash, record, position) of hashes that occur in two records or more, sorted by hash and record.

    A bucket of more than ``at_once`` hashes is worked through in turns by the hashes' low bits, and each blob is unpacked
    by itself and thinned out to its turn before the next, so memory is bounded by the packed blobs, one blob and one turn;
    only the places of one single hash are never divided.
    """
    turns = 1
    while sum(struct.unpack_from("<I", b)[0] for b in blobs) > at_once * turns:
        turns *= 2
    for turn in range(turns):
        parts = []
        for blob in blobs:
            part = unpack(blob)
            if turns > 1:
                mine = part[0] & np.uint64(turns - 1) == np.uint64(turn)
                part = tuple(x[mine] for x in part)
            parts.append(part)
        yield _shared(*(np.concatenate(x) for x in zip(*parts)))


def _shared(h: np.ndarray, rec: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h), bool)
    same = h[order][1:] == h[order][:-1]
    again[1:] |= same
    again[:-1] |= same
    own = order[again]
    own = own[np.lexsort((at[own], rec[own], h[own]))]
    h, rec, at = h[own], rec[own], at[own]
    if len(h):
        new = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(new) - 1
        other = np.concatenate([[False], (h[1:] == h[:-1]) & (rec[1:] != rec[:-1])])
        keep = (np.bincount(group, other) > 0)[group]
        h, rec, at = h[keep], rec[keep], at[keep]
    return h, rec, at


def _by_bucket(df: DataFrame, width: int) -> DataFrame:
    """Blobs of a bucket side by side in one task, without gathering them into one row."""
    return df.repartition(width, "bucket").sortWithinPartitions("bucket")


def _groups(batches: Iterable[pa.RecordBatch], at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    name, blobs = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if b != name and blobs:
                yield from shared_groups(blobs, at_once)
                blobs = []
            name = b
            blobs.append(blob)
    if blobs:
        yield from shared_groups(blobs, at_once)


def _runs(rec: np.ndarray, at: np.ndarray) -> Iterator[dict[str, list]]:
    """``rec_id, places``: the positions of each record, as int64 bytes."""
    order = np.lexsort((at, rec))
    rec, at = rec[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], rec[1:] != rec[:-1]]))
    ends = np.append(first[1:], len(rec))
    for k in range(0, len(first), 20_000):
        yield {"rec_id": rec[first[k : k + 20_000]], "places": [at[a:b].astype(np.int64).tobytes() for a, b in zip(first[k : k + 20_000], ends[k : k + 20_000])]}


def anchors(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """``bucket, blob, rec_id, places``: packed anchors, and in rows of their own the places of those that recur within a task.

    Of anchors that a task has in several records one goes on, so an anchor of any number of records sends no more rows
    than tasks have turns.
    """
    window, chunk, flush = length - PERIOD + 1, CHUNK, FLUSH

    def run(batches):
        hasher, packer = Hasher(chunk + window), Packer(buckets, ANCHOR_BYTES)

        def drain(least: int):
            if packer.n < least:
                return
            h, rec, at = packer.take()
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            if same.any():
                twice = np.zeros(len(h), bool)
                twice[1:] |= same
                twice[:-1] |= same
                group = np.cumsum(np.concatenate([[True], ~same])) - 1
                mixed = np.zeros(group[-1] + 1, bool)
                mixed[group[1:][same & (rec[order][1:] != rec[order][:-1])]] = True
                found = order[twice & mixed[group]]
                again = np.zeros(len(h), bool)
                again[order[1:][same & mixed[group[1:]]]] = True  # all but the first of each hash that several records have
                for out in _runs(rec[found], at[found]) if len(found) else ():
                    n = len(out["places"])
                    yield {"bucket": np.arange(n) % buckets, "blob": [None] * n} | out
                h, rec, at = h[~again], rec[~again], at[~again]
            for names, blobs in packer.packed(h, rec, at):
                yield {"bucket": names, "blob": blobs, "rec_id": [None] * len(names), "places": [None] * len(names)}

        for batch in batches:
            for rec_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = code_points(text)
                for lo, hi in chunks(len(codes), window, chunk):
                    sums = hasher.sums(codes[lo:hi])
                    turn = np.arange(lo // PERIOD, (hi - window) // PERIOD + 1)
                    at = (turn[:, None] * PERIOD + np.array(COVER)).ravel() - lo
                    at = at[(at >= 0) & (at <= hi - lo - window)]
                    packer.add(hasher.windows(sums, at, window), rec_id, at + lo)
                yield from drain(flush)
        yield from drain(1)

    return map_arrow(spread(rows), run, "bucket int, blob binary, rec_id long, places binary")


def candidates(blobs: DataFrame, width: int) -> DataFrame:
    """``rec_id, places``: for each record the positions (as int64 bytes) of anchors that another record has too."""

    at_once = AT_ONCE

    def run(batches):
        def only_blobs():
            for batch in batches:
                known = batch.filter(batch.column(3).is_valid())
                if known.num_rows:
                    passed.append({"rec_id": known.column(2), "places": known.column(3)})
                yield batch.filter(batch.column(1).is_valid())

        passed: list[dict] = []
        for _, rec, at in _groups(only_blobs(), at_once):
            while passed:
                yield passed.pop()
            if len(rec):
                yield from _runs(rec, at)
        yield from passed

    return map_arrow(_by_bucket(blobs, width), run, "rec_id long, places binary").groupBy("rec_id").agg(F.collect_list("places").alias("places"))


def full_windows(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Packed windows of ``length`` around the places of ``rows`` (``rec_id, text, places``)."""
    window, chunk, flush = length - PERIOD + 1, CHUNK, FLUSH

    def run(batches):
        hasher, packer = Hasher(chunk + length), Packer(buckets, 8)

        def drain(least: int):
            if packer.n >= least:
                for names, blobs in packer.packed(*packer.take()):
                    yield {"bucket": names, "blob": blobs}

        for batch in batches:
            for rec_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                codes = code_points(text)
                n = len(codes)
                anchor = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in found]))
                edge = np.zeros(n + 2, np.int32)
                anchor = anchor[anchor + window <= n]
                np.add.at(edge, np.maximum(anchor - (length - window), 0), 1)
                np.add.at(edge, np.minimum(anchor, n - length) + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge[: n - length + 1]) > 0)
                for lo, hi in chunks(n, length, chunk):
                    at = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi - length, "right")] - lo
                    if len(at):
                        packer.add(hasher.windows(hasher.sums(codes[lo:hi]), at, length), rec_id, at + lo)
                yield from drain(flush)
        yield from drain(1)

    return map_arrow(rows, run, "bucket int, blob binary")


def bucket_count(df: DataFrame, width: int) -> int:
    """Buckets by the stored size of the input, as Spark estimates it, at least two a task; a power of two."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    want = size // BUCKET_BYTES if size < 1 << 60 else 0  # an input of unknown size is estimated beyond all bounds
    return 1 << (max(2 * width, min(want, MOST_BUCKETS)) - 1).bit_length()


class Shared:
    """The classes of equal texts that hold a recurring anchor, and what their full windows share.

    ``cls`` is a hash of the text (of its MD5); ``texts`` has ``cls, text, places`` of one record of each class, ``members``
    ``cls, rec_id``, ``sizes`` ``cls, rep, n``.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, length: int, buckets: int | None):
        if length < 2 * PERIOD:
            raise ValueError(f"spans must have at least {2 * PERIOD} characters")
        self.length, self.width = length, shuffle_width(df.sparkSession)
        self.buckets = buckets or bucket_count(df.select(F.col(text_col)), self.width)
        rows = keyed_text(df, id_col, text_col).where((F.char_length("text") >= length) & F.col("rec_id").isNotNull())
        # read twice, after costly Python work
        places = durable(candidates(anchors(rows, length, self.buckets), self.width))
        spot = F.pmod(F.xxhash64("rec_id"), F.lit(64 * BITMAP))
        bit = F.expr("shiftleft(1L, cast(_spot % 64 as int))")
        bitmap = places.select(spot.alias("_spot")).groupBy((F.col("_spot") / 64).cast("long").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
        # at most BITMAP rows, however many records there are; a full bitmap lets all texts pass to the join
        maybe = rows.withColumn("_spot", spot).join(F.broadcast(bitmap), (F.col("_spot") / 64).cast("long") == F.col("_word")).where(F.col("_bits").bitwiseAND(bit) != 0)
        # kept, as classes, windows and the final comparison all start from these few texts
        found = durable(maybe.select("rec_id", "text").join(places, "rec_id").withColumn("cls", F.xxhash64(F.md5("text"))))
        self.members = found.select("cls", "rec_id").distinct()
        self.sizes = self.members.groupBy("cls").agg(F.min("rec_id").alias("rep"), F.count("*").alias("n"))
        # a repeated row of a repeated id may stand here twice, which changes nothing
        self.texts = found.join(self.sizes.select("cls", "rep"), "cls").where("rec_id = rep").drop("rep")
        self.windows = full_windows(self.texts.select(F.col("cls").alias("rec_id"), "text", "places"), length, self.buckets)

    def linked(self) -> DataFrame:
        """``a, b``: pairs of classes (``a < b``) with a common span, compared by characters."""
        at_once = AT_ONCE
        ddl = "a long, b long, at_a long, at_b long, grp long, block int, recs binary, places binary"

        def small(a, b, at_a, at_b) -> dict:
            return {"a": a, "b": b, "at_a": at_a, "at_b": at_b} | {k: [None] * len(a) for k in ("grp", "block", "recs", "places")}

        def run(batches):
            seen: set[bytes] = set()
            for h, rec, at in _groups(batches, at_once):
                if not len(h):
                    continue
                one = np.concatenate([[True], (h[1:] != h[:-1]) | (rec[1:] != rec[:-1])])
                h, rec, at = h[one], rec[one], at[one]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                size = np.diff(np.append(first, len(h)))
                two = first[size == 2]
                _, pick = np.unique(np.stack([rec[two], rec[two + 1]], 1), axis=0, return_index=True)
                two = two[pick]
                for k in range(0, len(two), 100_000):
                    part = two[k : k + 100_000]
                    yield small(rec[part], rec[part + 1], at[part], at[part + 1])
                for a, m in zip(first[size > 2], size[size > 2]):
                    group, where = rec[a : a + m], at[a : a + m]
                    key = group.tobytes()
                    if key in seen:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(key)
                    if m > GROUP:  # left to several tasks
                        for k in range(0, m, GROUP):
                            none = [None]
                            yield {"a": none, "b": none, "at_a": none, "at_b": none, "grp": [int(h[a].view(np.int64))], "block": [k // GROUP], "recs": [group[k : k + GROUP].tobytes()], "places": [where[k : k + GROUP].tobytes()]}
                        continue
                    i, j = np.triu_indices(m, 1)
                    yield small(group[i], group[j], where[i], where[j])

        # kept, as pairs and blocks of large groups are read from it
        found = durable(map_arrow(_by_bucket(self.windows, self.width), run, ddl))
        blocks = found.where("grp is not null").select("grp", "block", "recs", "places").dropDuplicates(["grp", "block"])
        other = blocks.toDF("grp", "block_b", "recs_b", "places_b")

        def paired(batches):
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    ra, pa_, rb, pb = (np.frombuffer(x, np.int64) for x in row)
                    for k in range(len(ra)):
                        keep = rb > ra[k]
                        n = int(keep.sum())
                        yield {"a": np.full(n, ra[k]), "b": rb[keep], "at_a": np.full(n, pa_[k]), "at_b": pb[keep]}

        both = blocks.join(other, "grp").where("block <= block_b").select("recs", "places", "recs_b", "places_b")
        pairs = found.where("grp is null").select("a", "b", "at_a", "at_b").unionByName(map_arrow(both, paired, "a long, b long, at_a long, at_b long"))
        pairs = pairs.groupBy("a", "b").agg(F.min(F.struct("at_a", "at_b")).alias("at"))
        # the characters of one window of each side
        asked = pairs.select("a", "b", F.inline(F.array(F.struct(F.col("a").alias("cls"), F.col("at.at_a").alias("at")), F.struct(F.col("b").alias("cls"), F.col("at.at_b").alias("at")))))
        cut = asked.join(self.texts.select("cls", "text"), "cls").select("a", "b", F.substring(F.col("text"), (F.col("at") + 1).cast("int"), F.lit(self.length)).alias("cut"))
        return cut.groupBy("a", "b").agg(F.min("cut").alias("lo"), F.max("cut").alias("hi"), F.count("*").alias("n")).where("n >= 2 and lo = hi").select("a", "b")

    def copies(self) -> DataFrame:
        """``doc_a, doc_b``: pairs of records of equal texts. Members are cut into blocks by their class's size, so no task pairs more than blocks."""
        many = self.members.join(self.sizes.where("n > 1").select("cls", F.ceil(F.col("n") / GROUP).cast("int").alias("_blocks")), "cls")
        rows = many.withColumn("_own", F.pmod(F.xxhash64("rec_id"), F.col("_blocks")).cast("int"))
        sides = rows.select("cls", "rec_id", "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
        left = sides.where("_own <= _other").select("cls", F.col("_own").alias("_i"), F.col("_other").alias("_j"), F.col("rec_id").alias("x"))
        right = sides.where("_other <= _own").select("cls", F.col("_other").alias("_i"), F.col("_own").alias("_j"), F.col("rec_id").alias("y"))
        pairs = left.join(right, ["cls", "_i", "_j"]).where("x <> y and (_i < _j or x < y)")
        return pairs.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def shared_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, buckets: int | None = None) -> DataFrame:
    """``doc_a, doc_b``: pairs of records (``doc_a < doc_b``) with a common verbatim span of ``length`` code points.

    Null, empty and shorter texts and rows without an id are in no pair; whole copies are; repeats of one id count as one
    record. Pairs of classes of equal texts are found first and made pairs of records at the end, so the result is as long
    as its definition makes it; ``shared_classes`` gives the short form.
    """
    found = Shared(df, id_col, text_col, length, buckets)
    links = durable(found.linked())
    left = links.join(found.members.select(F.col("cls").alias("a"), F.col("rec_id").alias("x")), "a")
    both = left.join(found.members.select(F.col("cls").alias("b"), F.col("rec_id").alias("y")), "b").where("x <> y")
    pairs = both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    return pairs.unionByName(found.copies()).distinct()


def shared_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, buckets: int | None = None) -> DataFrame:
    """``<id_col>, class_id, copies, links``: the short form of ``shared_pairs``, a row a record.

    ``class_id`` is the least id of the records with an equal text, ``copies`` their number, ``links`` the number of other
    classes that a span of ``length`` is shared with. Texts that are too short to share a span, and null ones, are classes of
    their own without links; rows without an id aren't reported, and of a repeated id one row is.
    """
    found = Shared(df, id_col, text_col, length, buckets)
    links = durable(found.linked())
    degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("cls")).agg(F.count("*").alias("links"))
    own = found.members.join(found.sizes, "cls").join(degree, "cls", "left").groupBy("rec_id").agg(F.min("rep").alias("rep"), F.max("n").alias("n"), F.max("links").alias("links"))
    ids = df.select(F.col(id_col).cast("long").alias("rec_id")).where("rec_id is not null").distinct()
    return ids.join(own, "rec_id", "left").select(
        F.col("rec_id").alias(id_col), F.coalesce("rep", "rec_id").alias("class_id"), F.coalesce("n", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links")
    )


def shared_cover(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, buckets: int | None = None) -> DataFrame:
    """How much of each record stands in others too: ``<id_col>, spans, n_shared, n_chars, share``.

    ``spans`` is an array of (start, end) of the maximal shared stretches, ``n_shared`` the characters they cover; of a
    record whose whole text others have, that is all of it. Records without a shared span have an empty array and 0; null
    and empty texts have share 0. A repeated id is reported once, by its longest text; rows without an id aren't reported.
    The work is linear in the text however many records share a span.
    """
    found = Shared(df, id_col, text_col, length, buckets)
    at_once = AT_ONCE

    def run(batches):
        for h, rec, at in _groups(batches, at_once):
            if len(h):
                order = np.lexsort((at, rec))
                rec, at = rec[order], at[order]
                new = np.concatenate([[True], (rec[1:] != rec[:-1]) | (at[1:] > at[:-1] + length)])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(rec)) - 1
                yield {"cls": rec[first], "lo": at[first], "hi": at[last] + length}

    single = map_arrow(_by_bucket(found.windows, found.width), run, "cls long, lo long, hi long")
    alone = single.join(found.sizes.where("n = 1").select("cls", F.col("rep").alias("rec_id")), "cls").select("rec_id", "lo", "hi")
    n_chars = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    whole = found.texts.select("cls", F.lit(0).cast("long").alias("lo"), n_chars.alias("hi")).join(found.sizes.where("n > 1").select("cls"), "cls").join(found.members, "cls").select("rec_id", "lo", "hi")
    # runs of one bucket are joined to maximal ones by folding the sorted runs of each record
    folded = F.expr(
        "aggregate(array_sort(collect_list(struct(lo, hi))), cast(array() as array<struct<lo: bigint, hi: bigint>>),"
        " (a, x) -> case when size(a) > 0 and element_at(a, -1).hi >= x.lo"
        " then concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).lo as lo, greatest(element_at(a, -1).hi, x.hi) as hi)))"
        " else concat(a, array(x)) end)"
    )
    spans = alone.unionByName(whole).groupBy("rec_id").agg(folded.alias("spans"))
    size = keyed_text(df, id_col, text_col).where("rec_id is not null").groupBy("rec_id").agg(F.max(n_chars).alias("n_chars"))
    out = size.join(spans, "rec_id", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<lo: bigint, hi: bigint>>)")))
    n = F.expr("aggregate(spans, 0L, (a, x) -> a + x.hi - x.lo)")
    return out.select(F.col("rec_id").alias(id_col), "spans", n.alias("n_shared"), "n_chars", F.when(F.col("n_chars") > 0, n / F.col("n_chars")).otherwise(0.0).alias("share"))
