"""What the plans must look like to hold at scale."""

import pytest

from lectern import queries

#: A test of several equalities by OR has no join key; the side that is broadcast is the table of languages.
NESTED_LOOP = {"language_resolver"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"stream_daily_quota"}))
def test_no_cross_joins(spark, sf, name):
    text = plan(queries.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text or name in NESTED_LOOP
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES) if n.startswith("search_")])
def test_a_search_is_one_pass(spark, sf, name):
    assert "Exchange" not in plan(queries.QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES) if n.startswith("lookup_") and n not in ("lookup_by_bcv", "lookup_verse_ids")])
def test_lookups_reach_the_scan(spark, sf, name):
    text = plan(queries.QUERIES[name](spark, sf))
    scan = text[text.index("PushedFilters") :].split("]")[0]
    assert "book" in scan and "text" not in text[text.index("ReadSchema") :].split(">")[0]


def test_a_chain_shares_one_exchange(spark, sf):
    text = plan(queries.QUERIES["prox_chain_three"](spark, sf))
    assert text.count("REPARTITION_BY_COL") == 1 and text.count("Window [") == 4
    assert "text" not in text[: text.index("REPARTITION_BY_COL")].split("Exchange")[-1]


def test_quota_ranks_before_the_shuffle(spark, sf):
    assert plan(queries.QUERIES["daily_quota_accepted"](spark, sf)).count("WindowGroupLimit") == 2


def scans(df):
    return [x.split("\n")[0] for x in plan(df).split("FileScan parquet")[1:]]


def test_editions_reach_every_scan(spark, sf):
    """The newest-row plan reads and shuffles the editions asked for only, on both of its sides."""
    from lectern import corpus
    from lectern.engine import Engine, Request

    found = scans(corpus.units(spark, sf, modules=["a", "b"]))
    assert len(found) == 2 and all("In(module, [a,b])" in x for x in found)
    engine = Engine(spark, sf)
    for r in (Request(["a"], search="king"), Request(["a"], search="king lamp", search_type="proximity"), Request(["a"], reference="1B 2"), Request(["a", "b"], search="king")):
        found = [x for x in scans(engine.query(r)) if "verses.parquet" in x]
        assert len(found) >= 2 and all("module" in x.split("PushedFilters")[1] for x in found), r
    found = scans(engine.query(Request(["a"], reference="1B 2:3-5")))
    assert all("GreaterThanOrEqual(chapter_verse,2003)" in x or "chapter_verse" in x.split("PushedFilters")[1] for x in found)


def test_small_updates_aggregate_only_touched_rows(spark, sf):
    text = plan(queries.QUERIES["update_or_create"](spark, sf))
    assert "LeftAnti" in text and "LeftSemi" in text
