"""Null ids and sources, clashing columns, repeated rows: nothing crashes, and each has its defined result."""

import pytest

from lectern.llm import abuse, language, mixing, queries, spans, terms, tokens, unify

ROWS = [(None, "text " * 60, None, "a"), (1, "text " * 60, "s", "b"), (2, None, "s", None), (3, "", None, None), (3, "", None, None), (4, "\t \u3000", "s", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    names = "doc_id long, text string, source string, rec_id string, bucket string, term string, n_tokens string, look string, grp string, lang string, score string"
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x", "x")[:11] for r in ROWS], names)


def test_nothing_crashes(spark, odd):
    assert {r.term: (r.occurrences, r.records) for r in terms.term_counts(odd).collect()} == {"text": (120, 2)}
    assert unify.unify(odd, "doc_id", "text").count() == 6
    assert unify.same_looking({"f": (odd, "doc_id", "text")}).count() == 0
    assert unify.looking_alike({"f": (odd, "doc_id", "text"), "g": (odd.limit(0), "doc_id", "text")}).count() == 0
    assert sorted(tuple(r) for r in spans.shared_classes(odd).collect()) == [(k, k, 1, 0) for k in (1, 2, 3, 4)]
    assert spans.shared_classes(odd.limit(0)).count() == 0
    assert spans.shared_pairs(odd).count() == 0  # the other copy has no id
    assert {r.doc_id: r.n_chars for r in spans.shared_cover(odd).collect()} == {1: 300, 2: 0, 3: 0, 4: 3}
    assert tokens.encode_texts(odd).count() == 6
    targets = spark.createDataFrame([("s", 1.0, 2, "x")], "source string, weight double, max_repeats int, rate string")
    assert [r.doc_id for r in mixing.Mixture(odd, targets).chosen().orderBy("doc_id").collect()] == [1, 4]


def test_models_on_odd_rows(spark, odd, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    languages = spark.read.parquet(f"{sf}/languages.parquet")
    model = language.train_on(docs, "doc_id", "text", language.label_code(docs["lang"], languages))
    assert {r.doc_id for r in language.detect(odd, "doc_id", "text", model, keep=["source"]).collect()} == {None, 1}
    assert language.detect_groups(odd, "source", "text", model).count() == 1
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rated = abuse.train_on(docs, labels, "doc_id", "text")
    scored = abuse.score_documents(odd, "doc_id", "text", rated, keep=["source"])
    assert scored.count() == 6 and abuse.source_rates(scored).count() == 2


@pytest.mark.parametrize("name", ["p1_documents", "p1_bibles", "p3_names", "p3_classes", "p4_cover", "p4_classes", "p7_shares", "p7_exact", "p8_sources"])
def test_queries_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf if name[:2] != "p1" and name[:2] != "p8" else "/root/testdata/sf0.01").count() > 0
