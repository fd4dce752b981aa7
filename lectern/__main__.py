"""Command line over a folder of tables.

    python -m lectern ROOT editions
    python -m lectern ROOT query MODULE[,MODULE] --search TEXT [--type boolean] [--reference REF] [--page N]
    python -m lectern ROOT statistics MODULE[,MODULE] REFERENCE
    python -m lectern ROOT compare MODULE MODULE
    python -m lectern ROOT compare-all MODULE
    python -m lectern ROOT enable|disable|install|uninstall MODULE[,MODULE] OUT
    python -m lectern ROOT refresh ARTIFACTS VERSION
    python -m lectern ROOT import KIND FILE MODULE OUT
    python -m lectern ROOT export KIND MODULE[,MODULE] LANG OUT
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus
from .engine import Engine, Request
from .operators import catalog
from .operators.stats import missing_addresses, missing_from_default
from .sources import exports, importers


FLAGS = {"enable": {"enabled": 1}, "disable": {"enabled": 0}, "install": {"installed": 1}, "uninstall": {"installed": 0, "enabled": 0}}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lectern", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("root")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("editions")
    query = sub.add_parser("query")
    query.add_argument("modules")
    for name in ("search", "reference", "request"):
        query.add_argument(f"--{name}", default="")
    query.add_argument("--type", default="and")
    query.add_argument("--page", type=int, default=1)
    query.add_argument("--whole-words", action="store_true")
    statistics = sub.add_parser("statistics")
    statistics.add_argument("modules")
    statistics.add_argument("reference")
    compare = sub.add_parser("compare")
    compare.add_argument("left")
    compare.add_argument("right")
    sub.add_parser("compare-all").add_argument("default")
    for name in FLAGS:
        change = sub.add_parser(name)
        change.add_argument("modules")
        change.add_argument("out")
    refresh = sub.add_parser("refresh")
    refresh.add_argument("artifacts")
    refresh.add_argument("version")
    load = sub.add_parser("import")
    for name in ("kind", "file", "module", "out"):
        load.add_argument(name)
    save = sub.add_parser("export")
    for name in ("kind", "modules", "lang", "out"):
        save.add_argument(name)
    return top


def show(rows: DataFrame) -> None:
    """All rows as tab-separated lines, a partition at a time."""
    print("\t".join(rows.columns))
    for r in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v).replace("\t", " ").replace("\n", " ") for v in r))


def main(arguments: list[str], spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    engine = Engine(spark, a.root)
    if a.command == "editions":
        show(engine.editions().select("module", "name", "lang_short", "year"))
    elif a.command == "query":
        r = Request(a.modules.split(","), a.reference, a.search, a.request, a.type, whole_words=a.whole_words, page=a.page)
        show(engine.query(r).select("module", "book", "chapter", "verse", "text", "unmatched"))
        engine.paging(r).show()
    elif a.command == "statistics":
        show(engine.statistics(a.reference, a.modules.split(",")))
    elif a.command == "compare":
        left, right = (corpus.units(spark, a.root, text=False, modules=[m]) for m in (a.left, a.right))
        for sign, x, y in (("-", left, right), ("+", right, left)):
            show(missing_addresses(x, y).select(F.lit(sign).alias("side"), "book", "chapter", "verse").orderBy("book", "chapter", "verse"))
    elif a.command == "compare-all":
        show(missing_from_default(engine.table("verses"), a.default).orderBy("module", "book", "chapter", "verse"))
    elif a.command in FLAGS:
        # the new catalog stands beside the old one, which is read while it is written
        catalog.flagged(engine.table("bibles"), a.modules.split(","), **FLAGS[a.command]).write.mode("overwrite").parquet(a.out)
    elif a.command == "refresh":
        editions = engine.table("bibles").withColumn("meta_hash", catalog.metadata_hash(["name", "year"]))
        show(catalog.stale(editions, spark.read.parquet(a.artifacts), a.version).select("module", "reason").orderBy("module"))
    elif a.command == "import":
        importers.import_edition(spark, a.kind, a.file, a.module).write.mode("append").partitionBy("module").parquet(a.out)
    elif a.command == "export":
        rows = exports.with_book_names(corpus.units(spark, a.root, modules=a.modules.split(",")), engine.table("books"), a.lang)
        exports.render(rows, a.kind, a.out)


if __name__ == "__main__":
    main(sys.argv[1:])
