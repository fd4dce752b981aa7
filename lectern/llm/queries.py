"""Queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import abuse, language, mixing, spans, terms, tokens, unify


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _language_model(spark: SparkSession, sf: str) -> tuple[language.Model, dict[str, DataFrame]]:
    """The classifier trained on labelled documents, and the labelled tables with the code that each label names."""
    languages = table(spark, sf, "languages")
    docs, bibles = table(spark, sf, "documents"), table(spark, sf, "bibles")
    doc_code = language.label_code(F.col("lang"), languages)
    bible_code = language.label_code(F.col("lang_short"), languages)
    model = language.train_on(docs, "doc_id", "text", doc_code)
    return model, {
        "documents": docs.select(F.col("doc_id").alias("rec_id"), "text", doc_code.alias("code")),
        "bibles": bibles.select(F.col("id").alias("rec_id"), "module", bible_code.alias("code")),
    }


def p1_documents(spark: SparkSession, sf: str) -> DataFrame:
    model, tables = _language_model(spark, sf)
    return language.detect(tables["documents"], "rec_id", "text", model, keep=["code"]).withColumnRenamed("rec_id", "doc_id")


def p1_bibles(spark: SparkSession, sf: str) -> DataFrame:
    model, tables = _language_model(spark, sf)
    found = language.detect_groups(table(spark, sf, "verses"), "module", "text", model)
    return tables["bibles"].join(found, F.col("module") == F.col("grp"), "left").select(F.col("rec_id").alias("id"), "module", "code", "lang", "confidence")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    model, tables = _language_model(spark, sf)
    docs = language.detect(tables["documents"], "rec_id", "text", model, keep=["code"])
    found = language.detect_groups(table(spark, sf, "verses"), "module", "text", model)
    editions = tables["bibles"].join(found, F.col("module") == F.col("grp"), "left").withColumn("seg_no", F.lit(0))
    columns = ["tbl", F.col("rec_id").cast("long").alias("rec_id"), "seg_no", "lang"]
    both = docs.withColumn("tbl", F.lit("documents")).select(*columns, "code").unionByName(editions.withColumn("tbl", F.lit("bibles")).select(*columns, "code"))
    # without a valid label, with a wrong one, or mixed
    case = F.col("lang").isNotNull() & ((F.col("seg_no") > 0) | F.col("code").isNull() | (F.col("code") != F.col("lang")))
    return both.where(case).drop("code")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_frequencies(table(spark, sf, "verses")).where("mark is not null").select("term", "mark")


def p2_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_frequencies(table(spark, sf, "verses"))


def _compared(spark: SparkSession, sf: str) -> dict[str, tuple[DataFrame, str, str]]:
    return {
        "verses.text": (table(spark, sf, "verses"), "row_id", "text"),
        "documents.text": (table(spark, sf, "documents"), "doc_id", "text"),
        "bibles.name": (table(spark, sf, "bibles"), "id", "name"),
    }


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return unify.same_looking(_compared(spark, sf))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    return unify.looking_alike(_compared(spark, sf))


def p3_names(spark: SparkSession, sf: str) -> DataFrame:
    return unify.unify(table(spark, sf, "bibles"), "id", "name")


def p3_documents(spark: SparkSession, sf: str) -> DataFrame:
    return unify.unify(table(spark, sf, "documents"), "doc_id", "text")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf, "documents"))


def p4_cover(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_cover(table(spark, sf, "documents")).withColumn("spans", F.to_json("spans"))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_classes(table(spark, sf, "documents"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf, "documents"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.Mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).chosen()


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.Mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).shares()


def p7_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the largest mixture that meets every weight."""
    return mixing.Mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), exact=True).shares()


def _abuse_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = abuse.train_on(docs, table(spark, sf, "labels"), "doc_id", "text")
    return abuse.score_documents(docs, "doc_id", "text", model, keep=["source"])


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _abuse_scores(spark, sf).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _abuse_scores(spark, sf)


def p8_sources(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.source_rates(_abuse_scores(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_documents, p1_bibles, p2_found, p2_terms, p3_found, p3_classes, p3_names, p3_documents, p4_found, p4_cover, p4_classes, p6_ids, p7_mix, p7_shares, p7_exact, p8_found, p8_scores, p8_sources)
}

_TERMS = r"""
with rows_ as (select row_number() over () as n, regexp_extract_all(lower(text), '[\p{L}\p{M}]+') as found from verses where text is not null),
flat as (select n, unnest(found) as term from rows_),
counted as (select term, count(*) as occurrences, count(distinct n) as records from flat group by term),
marked as (select term, occurrences, records, case when records = 1 then 'rare' when records > 0.05 * (select count(*) from rows_) then 'common' end as mark from counted)
"""

SQL: dict[str, str] = {
    "p2_found": _TERMS + "select term, mark from marked where mark is not null",
    "p2_terms": _TERMS + "select term, occurrences::bigint as occurrences, records::bigint as records, mark from marked",
}
