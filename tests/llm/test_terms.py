from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import terms
from lectern.llm import queries as q

from ..oracle import assert_same

ALPHABET = "abcABCéÉßΣσς́ж字 0-.\n"


@given(st.lists(st.tuples(st.text("abcdé", min_size=1, max_size=7), st.integers(1, 9), st.integers(1, 9)), max_size=120), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_trie_counts_and_packs(rows, burst):
    trie, want = terms.BurstTrie(burst), {}
    for term, o, r in rows:
        trie.add(term, o, r)
        a, b = want.get(term, (0, 0))
        want[term] = a + o, b + r
    got = {}
    for prefix, blob in trie.blobs():
        for term, o, r in terms.unpack(blob):
            assert term.startswith(prefix) and term not in got
            got[term] = o, r
    assert got == want and trie.size == len(want)


def test_against_brute_force(spark, monkeypatch):
    import random

    r = random.Random(4)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(400)] + [None, "", "  ", "x" * 100_000, "a a a"]
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "id long, text string, term int").repartition(5)
    occurrences, records = Counter(), Counter()
    for t in texts:
        found = terms.TERM.findall(terms.fold(t or ""))
        occurrences.update(found)
        records.update(set(found))
    got = {x.term: (x.occurrences, x.records) for x in terms.term_counts(rows).collect()}
    assert got == {t: (n, records[t]) for t, n in occurrences.items()}
    marks = {x.term: x.mark for x in terms.term_frequencies(rows).collect()}
    total = sum(t is not None for t in texts)
    assert marks == {t: "rare" if n == 1 else "common" if n > 0.05 * total else None for t, n in records.items()}


def test_hand_over_midway(spark, monkeypatch):
    """A task that hands its trie on more than once gives the same counts."""
    batches = [__import__("pyarrow").RecordBatch.from_pydict({"text": [f"w{chr(97 + k % 26)}{chr(97 + k // 26)} same" for k in range(200)]}) for _ in range(3)]
    monkeypatch.setattr(terms, "FLUSH", 50)
    total = Counter()
    for out in terms._count(batches):
        for blob in out["blob"]:
            for t, o, _ in terms.unpack(blob):
                total[t] += o
    assert total["same"] == 600 and total["w"] == 0 and total["waa"] == 3


def test_empty(spark):
    assert terms.term_frequencies(spark.createDataFrame([], "text string")).count() == 0


def test_sql(spark, sf, duck):
    for name in q.SQL:
        assert_same(q.QUERIES[name](spark, sf), duck, q.SQL[name])
