import pytest

from lectern.llm.mixing import Mixture, repetition_rates


def test_rates():
    rates = repetition_rates({"a": 100, "b": 100, "c": 10}, {"a": (0.5, 3), "b": (0.3, 3), "c": (0.2, 2), "d": (0.0, 1)}, 210)
    assert rates["c"] == 2.0 and rates["d"] == 0.0
    assert abs(rates["a"] * 100 / (rates["b"] * 100) - 5 / 3) < 1e-9
    assert abs(sum(rates[k] * n for k, n in (("a", 100), ("b", 100), ("c", 10))) - 210) < 1e-9
    assert repetition_rates({}, {"a": (1.0, 2)}) == {"a": 0.0}
    assert repetition_rates({"a": 10}, {"a": (1.0, 2)}, 1000) == {"a": 2.0}


def test_mixture(spark):
    docs = spark.createDataFrame([(k, "word " * 20, " A " if k % 2 else "b", "x") for k in range(400)] + [(900, None, "a", "x"), (901, "", "b", "x"), (902, "text", None, "x"), (903, "text", "other", "x")], "doc_id long, text string, source string, rate string")
    targets = spark.createDataFrame([("a", 0.75, 2), ("B", 0.25, 1), ("gone", 0.0, 3), (None, 0.1, 1)], "source string, weight double, max_repeats int")
    mix = Mixture(docs, targets)
    rows = mix.chosen().collect()
    assert max(r.repeats for r in rows) <= 2 and {r.source for r in rows} == {"a", "b"}
    assert not {900, 901, 902, 903} & {r.doc_id for r in rows}
    shares = {r.source: r for r in mix.shares().collect()}
    assert abs(shares["a"].share - 0.75) < 0.05 and shares["gone"].tokens == 0
    assert abs(sum(r.share for r in shares.values()) - 1) < 1e-9
    assert sum(r.repeats for r in rows) == mix.copies().count()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, Mixture(docs.repartition(7), targets).chosen().collect()))


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, None)], "source string, weight double, max_repeats int")
    assert Mixture(docs, targets).chosen().count() == 0
    with pytest.raises(ValueError):
        Mixture(docs, targets.union(targets))


def test_exact_size_and_shortfall(spark):
    from lectern.llm.mixing import largest_exact

    available, targets = {"a": 1000, "b": 100, "c": 500}, {"a": (0.5, 2), "b": (0.3, 2), "c": (0.1, 1), "gone": (0.1, 3)}
    size = largest_exact(available, targets)
    assert size == pytest.approx(600)  # b may give 200 of it, a third
    rates = repetition_rates(available, targets, size)
    assert [rates[s] * available[s] for s in "abc"] == pytest.approx([size * w / 0.9 for w in (0.5, 0.3, 0.1)])
    assert largest_exact({}, targets) == 0.0
    docs = spark.createDataFrame([(k, "word " * (5 + k % 40), "a" if k % 10 else "b") for k in range(3000)], "doc_id long, text string, source string")
    table = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("gone", 0.1, 2)], "source string, weight double, max_repeats int")
    loose = {r.source: r for r in Mixture(docs, table).shares().collect()}
    assert loose["b"].shortfall > 0 and loose["gone"].shortfall > 0 and loose["a"].shortfall == 0
    assert loose["b"].tokens == 2 * loose["b"].available
    exact = {r.source: r for r in Mixture(docs, table, exact=True).shares().collect()}
    assert exact["a"].share == pytest.approx(5 / 9, abs=0.01) and exact["b"].share == pytest.approx(4 / 9, abs=0.01) and exact["gone"].shortfall > 0


def test_draws_of_small_sources_come_near(spark):
    docs = spark.createDataFrame([(k, "word " * (1 + 37 * k % 90), "small" if k % 50 == 0 else "large") for k in range(2000)], "doc_id long, text string, source string")
    table = spark.createDataFrame([("small", 0.01, 1), ("large", 0.99, 1)], "source string, weight double, max_repeats int")
    rows = {r.source: r for r in Mixture(docs, table).shares().collect()}
    assert rows["small"].tokens == pytest.approx(rows["small"].rate * rows["small"].available, rel=0.1)
