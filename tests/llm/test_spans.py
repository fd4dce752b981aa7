import random
from collections import defaultdict

import pytest

from lectern.llm import spans


def test_cover():
    diffs = {(a - b) % spans.PERIOD for a in spans.COVER for b in spans.COVER}
    assert diffs == set(range(spans.PERIOD))


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé字👩") for _ in range(r.randint(1, 7)))
    body = lambda n: " ".join(word() for _ in range(n))
    out = [body(r.randint(0, 150)) for _ in range(40)]
    for n in (198, 199, 200, 201, 202, 260, 500):
        source = max(out, key=len)
        at = r.randint(0, max(0, len(source) - n))
        out.append(body(r.randint(0, 30)) + "|" + source[at : at + n] + "|" + body(r.randint(0, 30)))
    out += [out[3], out[3], max(out, key=len), "x" * 450, "x" * 230, None, "", "short"]
    return out


def brute(values, length):
    at = defaultdict(set)
    for k, t in enumerate(values):
        for i in range(len(t or "") - length + 1):
            at[t[i : i + length]].add(k)
    pairs, cover = set(), defaultdict(set)
    for w, ids in at.items():
        if len(ids) > 1:
            pairs |= {(a, b) for a in ids for b in ids if a < b}
    for k, t in enumerate(values):
        for i in range(len(t or "") - length + 1):
            if len(at[t[i : i + length]]) > 1:
                cover[k] |= set(range(i, i + length))
    return pairs, cover


@pytest.mark.parametrize("seed,chunk,flush,once", [(1, 1 << 20, 1 << 20, 1 << 21), (2, 300, 100, 1 << 21), (3, 1 << 20, 500, 40)])
def test_against_brute_force(spark, monkeypatch, seed, chunk, flush, once):
    values = texts(seed)
    rows = spark.createDataFrame([(k, t, "z") for k, t in enumerate(values)], "doc_id long, text string, bucket string").repartition(3)
    monkeypatch.setattr(spans, "CHUNK", chunk)
    monkeypatch.setattr(spans, "FLUSH", flush)
    monkeypatch.setattr(spans, "AT_ONCE", once)
    pairs, cover = brute(values, 200)
    got = [tuple(r) for r in spans.shared_pairs(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    report = {r.doc_id: r for r in spans.shared_cover(rows).collect()}
    assert set(report) == set(range(len(values)))
    for k, t in enumerate(values):
        assert report[k].n_shared == len(cover[k]) and report[k].n_chars == len(t or "")
        assert report[k].n_shared == sum(s.hi - s.lo for s in report[k].spans)


def test_very_long_texts(spark):
    r = random.Random(8)
    long = lambda n: "".join(r.choices("abcdefgh ", k=n))
    a, b = long(180_000), long(90_000)
    piece = a[171_003:171_203]
    rows = spark.createDataFrame([(1, a), (2, b[:80_001] + piece + b[80_001:]), (3, b[:199]), (4, piece[:-1])], "doc_id long, text string")
    assert [tuple(x) for x in spans.shared_pairs(rows).collect()] == [(1, 2)]
    assert {x.doc_id: x.n_shared for x in spans.shared_cover(rows).collect()} == {1: 200, 2: 200, 3: 0, 4: 0}


def test_empty(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert spans.shared_pairs(rows).count() == 0 and spans.shared_cover(rows).count() == 0
    with pytest.raises(ValueError):
        spans.shared_pairs(rows, length=50)


def test_classes_and_large_groups(spark, monkeypatch):
    """Groups beyond ``GROUP`` are paired in blocks; the short form counts classes, not copies."""
    monkeypatch.setattr(spans, "GROUP", 4)
    r = random.Random(5)
    body = lambda n: "".join(r.choices("abcdefgh ", k=n))
    span, other = body(220), body(400)
    values = [body(30) + span + body(40) for _ in range(13)] + [other] * 11 + [other + "tail"] + [body(300), "", None, "short"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(values)], "doc_id long, text string").repartition(4)
    want, _ = brute(values, 200)
    assert {tuple(x) for x in spans.shared_pairs(rows).collect()} == want
    got = {x.doc_id: (x.class_id, x.copies, x.links) for x in spans.shared_classes(rows).collect()}
    assert [got[k] for k in range(13)] == [(k, 1, 12) for k in range(13)]
    assert [got[k] for k in range(13, 24)] == [(13, 11, 1)] * 11 and got[24] == (24, 1, 1)
    assert [got[k] for k in range(25, 29)] == [(k, 1, 0) for k in range(25, 29)]


def test_equal_hashes_of_different_texts_make_no_pair(spark, monkeypatch):
    """Characters decide: windows are made to have equal hashes, which only nominates."""
    r = random.Random(9)
    body = lambda n: "".join(r.choices("abcdefgh ", k=n))
    a, b = body(260), body(260)
    anchor = body(150)
    rows = spark.createDataFrame([(1, a[:60] + anchor + a[60:]), (2, b[:60] + anchor + b[60:]), (3, a)], "doc_id long, text string")

    class Blunt(spans.Hasher):
        def windows(self, sums, at, width):
            h = super().windows(sums, at, width)
            import numpy as np

            return np.full(len(h), 77, np.uint64) if width == 200 else h

    monkeypatch.setattr(spans, "Hasher", Blunt)
    assert spans.shared_pairs(rows).count() == 0


def test_memory_of_a_bucket_is_flat(monkeypatch):
    """However many hashes a bucket has, one blob and one turn are unpacked at once."""
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(1)
    once = 1 << 16

    def blobs(n):
        return [spans.pack(r.integers(0, 1 << 63, once // 8, np.uint64), np.sort(r.integers(0, 1 << 40, once // 8)), np.zeros(once // 8, np.int64), 8) for _ in range(n)]

    def peak(n):
        data = blobs(n)
        tracemalloc.start()
        for _ in spans.shared_groups(data, once):
            pass
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    assert peak(128) < 1.3 * peak(16)


def test_a_hot_anchor_sends_one_entry_a_turn(spark, monkeypatch):
    r = random.Random(11)
    text = "".join(r.choices("abcdefgh ", k=2000))
    rows = spark.createDataFrame([(k, text) for k in range(400)], "rec_id long, text string").coalesce(1)
    sent = spans.anchors(rows, 200, 8)
    import struct

    n = sum(struct.unpack_from("<I", x.blob)[0] for x in sent.where("blob is not null").collect())
    assert n <= 4 * 210  # the anchors of one text for each of the four tasks
    assert sent.where("places is not null").select("rec_id").distinct().count() == 400
