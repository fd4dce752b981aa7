import pytest

from lectern import queries

from .oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_its_sql(spark, sf, duck, name):
    assert_same(queries.QUERIES[name](spark, sf), duck, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_clean_spacing_takes_all_documents(spark, sf):
    import re

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect()}
    got = {r.doc_id: r.clean for r in queries.QUERIES["clean_spacing_all"](spark, sf).collect()}
    assert got == {k: re.sub(r" ([?,.!:;])", r"\1", re.sub(r"[ \t\n\x0b\f\r]+", " ", t)).strip(" ") for k, t in rows.items()}
    assert any(not t.isascii() for t in rows.values())


def test_request_cache_takes_all_requests(spark, sf):
    import json

    rows = {r.request_id: {k: r[k] for k in ("reference", "search") if r[k] is not None} for r in spark.read.parquet(f"{sf}/passage_requests.parquet").collect()}
    got = {r.request_id: r.form for r in queries.QUERIES["request_cache_all"](spark, sf).collect()}
    assert {k: json.loads(v) for k, v in got.items()} == rows
    assert all(list(json.loads(v)) == sorted(json.loads(v)) for v in got.values())
    assert got == {k: json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for k, v in rows.items()}
    assert any("\\n" in v for v in got.values()) and any("/" in v for v in got.values())


def test_requested_books_takes_all_passages(spark, sf):
    from pyspark.sql import functions as F

    from lectern.operators import catalog

    rows = queries.QUERIES["requested_books"](spark, sf).collect()
    passages = queries.QUERIES["p5_found"](spark, sf).where("tbl = 'passage_requests'").collect()
    assert sorted((r.request_id, r.item_no, r.item) for r in rows) == sorted((r.rec_id, r.item_no, r["item"]) for r in passages)
    requests = spark.read.parquet(f"{sf}/passage_requests.parquet").select("request_id", "language")
    lang = dict(requests.collect())
    books = spark.read.parquet(f"{sf}/books.parquet")
    resolve = {x: catalog.book_resolver(books, x, catalog.COMMON, loose=True) for x in {v for v in lang.values() if v}}
    assert all(r.book == resolve[lang[r.request_id]](r.entered) and r.item.startswith(r.entered) for r in rows)
    part = {(r.request_id, r.book) for r in queries.QUERIES["resolve_requested_books"](spark, sf).collect()}
    assert part < {(r.request_id, r.book) for r in rows if r.book is not None}


def test_book_resolver_all_tiers_has_loose_tiers(spark, sf):
    assert {r.tier for r in queries.QUERIES["book_resolver_all_tiers"](spark, sf).select("tier").distinct().collect()} >= {1, 2, 3, 4}


def test_megabyte_sizes_of_large_ids(spark, tmp_path):
    """Sizes beyond 32 bits, from the first such id (17,395). The SQL runs over 64-bit ids, since it multiplies in the type of the id."""
    import duckdb

    ids = [None, 0, 1, 17394, 17395, 90000, 262144, 786432, 2147483647]
    spark.createDataFrame([(i,) for i in ids], "id int").write.parquet(f"{tmp_path}/bibles.parquet")
    got = queries.QUERIES["megabyte_sizes"](spark, str(tmp_path))
    assert got.dtypes == [("id", "int"), ("mb", "double")]
    rows = {r.id: r.mb for r in got.collect()}
    assert rows[17394] == 2047.9 and rows[17395] == 2048.0 and rows[262144] == 30864.3 and rows[2147483647] == 252839935.9
    con = duckdb.connect()
    con.execute(f"create view bibles as select id::bigint as id from '{tmp_path}/bibles.parquet/*.parquet'")
    assert rows == dict(con.execute(queries.SQL["megabyte_sizes"]).fetchall()) and set(rows) == set(ids)
