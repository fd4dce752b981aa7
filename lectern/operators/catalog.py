"""The catalog of editions, its dimensions, and artifacts rendered from it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..corpus import small
from .packed import packed_values


def rows_of_dimension(rows: DataFrame, most: int, what: str) -> list:
    """The rows of a dimension on the driver; more than ``most`` are refused, as they are no dimension."""
    out = rows.limit(most + 1).collect()
    if len(out) > most:
        raise ValueError(f"more than {most} {what}")
    return out


def editions(bibles: DataFrame, languages: DataFrame, enabled_only: bool = True, licences: DataFrame | None = None) -> DataFrame:
    """Editions with their language, and whether they may be downloaded (a licence is known and the edition installed).

    ``licences`` (``id, name, type, url, download``, and a ``statement``) decide on downloads and statements if given.
    """
    lang = languages.select(F.col("code").alias("lang_short"), F.col("name").alias("lang_name"), F.col("native_name").alias("lang_native"), "rtl")
    rows = bibles.where("enabled = 1") if enabled_only else bibles
    # the table of languages has a row a language, far below the size at which Spark stops broadcasting by itself
    rows = rows.join(lang, "lang_short", "left")
    if licences is not None:
        return licensed(rows, licences)
    return rows.withColumn("downloadable", downloadable()).withColumn("statement", copyright_statement())


def licensed(editions_: DataFrame, licences: DataFrame) -> DataFrame:
    """Editions with their licence's name: ``licence, downloadable, statement``.

    An edition may be downloaded if its licence allows it and the edition isn't restricted (a column ``restrict``, if there is
    one). The statement is the edition's own (``copyright_statement``, if there is one), else the licence's, for a licence of
    the type ``creative_commons`` led by the year and owner, and with the place of the terms; else the description.
    """
    own = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in editions_.columns else F.lit(None).cast("string")
    free = ~F.coalesce(F.col("restrict").cast("boolean"), F.lit(False)) if "restrict" in editions_.columns else F.lit(True)
    terms = licences.select(F.col("id").alias("copyright_id"), F.col("name").alias("licence"), F.col("type").alias("_type"), F.nullif(F.trim("url"), F.lit("")).alias("_url"), F.col("download").cast("boolean").alias("_free"), F.col("statement").alias("_says"))
    rows = editions_.join(small(terms), "copyright_id", "left")
    held = F.nullif(F.concat_ws(" ", own("year"), own("owner")), F.lit(""))
    commons = F.concat(F.coalesce(F.concat(F.lit("Copyright © "), held, F.lit(". ")), F.lit("")), F.lit("Licensed under "), F.col("licence"), F.coalesce(F.concat(F.lit(": "), "_url"), F.lit("")))
    other = F.concat(F.coalesce("_says", F.lit("")), F.coalesce(F.concat(F.lit(" Terms: "), "_url"), F.lit("")))
    says = F.coalesce(own("copyright_statement"), F.when(F.col("_type") == "creative_commons", commons).when(F.col("_type").isNotNull(), F.nullif(F.trim(other), F.lit(""))), F.col("description"))
    return rows.withColumn("downloadable", F.coalesce(free & F.col("_free"), F.lit(False))).withColumn("statement", says).drop("_type", "_url", "_free", "_says")


def grid_listing(bibles: DataFrame, languages: DataFrame, licences: DataFrame) -> DataFrame:
    """The rows of the administration's grid: every edition with the names of its language and licence."""
    return editions(bibles, languages, enabled_only=False, licences=licences)


def downloadable() -> Column:
    return F.coalesce((F.col("copyright_id") > 0) & (F.col("installed") == 1), F.lit(False))


def copyright_statement() -> Column:
    """The edition's own description, or its name and year."""
    return F.coalesce(F.when(F.trim("description") != "", F.col("description")), F.concat_ws(", ", F.col("name"), F.when(F.trim("year") != "", F.col("year"))))


# sort keys by name, and the column behind each
SORT_KEYS = {k: k for k in ("lang_native", "name", "shortname", "lang_short", "module", "id", "year", "rank")} | {"lang_name": "lang_native", "lang_name_english": "lang_name"}


def ordered(rows: DataFrame, keys: str, first_language: str | None = None) -> DataFrame:
    """Editions by ``|``-separated sort keys, one language floated to the top if asked for; keys that the rows lack are passed over."""
    names = [SORT_KEYS[k] for k in keys.split("|") if SORT_KEYS.get(k) in rows.columns]
    lead = [(F.col("lang_short") == first_language).desc_nulls_last()] if first_language else []
    return rows.orderBy(*lead, *[F.col(k).asc_nulls_last() for k in names], "id")


def sections(books: DataFrame, counts: DataFrame, most: int = 66) -> DataFrame:
    """Section lists with the greatest chapter of each edition's counts; ids above ``most`` are left out."""
    return books.where(F.col("id") <= most).join(counts, F.col("id") == F.col("book"), "left")


def used_languages(languages: DataFrame, bibles: DataFrame) -> DataFrame:
    """Languages that some edition is in."""
    return languages.join(bibles.select(F.col("lang_short").alias("code")), "code", "left_semi")


def languages_with_books(languages: DataFrame, books: DataFrame) -> DataFrame:
    """Languages that have a section list."""
    return languages.join(books.select(F.col("lang").alias("code")), "code", "left_semi")


def attributes(rows: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Rows of (key, name, value) as one map a key; of a repeated name the greatest value stays."""
    last = rows.groupBy(key, name).agg(F.max(value).alias("_v"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), F.col("_v"))))).alias("attributes"))


def metadata_hash(columns: list[str]) -> Column:
    """MD5 of the named columns as canonical text; nulls count as empty."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def stale(editions_: DataFrame, artifacts: DataFrame, version: str) -> DataFrame:
    """Editions that need rendering: no artifact, another version, or changed metadata. ``artifacts`` has module, version, meta_hash."""
    made = artifacts.select("module", F.col("version").alias("_version"), F.col("meta_hash").alias("_hash"))
    rows = editions_.join(made, "module", "left")
    why = F.when(F.col("_hash").isNull(), "missing").when(F.col("_version") != version, "version").when(F.col("_hash") != F.col("meta_hash"), "metadata")
    return rows.withColumn("reason", why).where("reason is not null").drop("_version", "_hash")


def flagged(bibles: DataFrame, modules: list[str], **flags: int) -> DataFrame:
    """The catalog with flags (``enabled``, ``installed``) set for some editions; others stay as they are."""
    mine = F.col("module").isin(*modules)
    return bibles.withColumns({k: F.when(mine, F.lit(v).cast(bibles.schema[k].dataType)).otherwise(F.col(k)) for k, v in flags.items()})


def unknown_only(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet, once each (insert-or-ignore)."""
    return found.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def unique_slugs(rows: DataFrame, title: Column, id_col: str) -> DataFrame:
    """``slug`` from a title; repeats get the suffix ``_2``, ``_3`` in the order of their ids.

    A slug that all rows share is still numbered by one task over its ids only.
    """
    from ..functions.text import slug

    rows = rows.withColumn("_base", slug(title))
    n = F.row_number().over(W.partitionBy("_base").orderBy(id_col))
    return rows.withColumn("slug", F.when(n == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", n.cast("string")))).drop("_base")


def tiers(query: DataFrame, dimension: DataFrame, tests: list[tuple[int, Column]], order: list[str], key: str, joint: Column) -> DataFrame:
    """The best match of each query row: least tier, then dimension order."""
    tier = reduce(lambda acc, t: F.when(t[1], t[0]).otherwise(acc), reversed(tests), F.lit(None).cast("int"))
    hit = query.join(small(dimension), joint).withColumn("tier", tier).where("tier is not null")
    return hit.groupBy(key).agg(F.min_by(F.struct("*"), F.struct("tier", *order)).alias("_m")).select("_m.*")


MOST_BOOKS = 1000  # of one language
MOST_SHORTCUTS = 10_000  # of one language
#: Signs that no name is a pattern with; then a repetition sign that stands behind nothing it could repeat.
NO_PATTERN = r"[()\[\]{}\\|+*&]|(?:^|[?^$])\?"
#: Words that only ever name a book exactly.
COMMON = frozenset({"a", "and", "the", "or", "but"})


def resolve_books(names: DataFrame, books: DataFrame, loose: bool = False, common: frozenset[str] = frozenset()) -> DataFrame:
    """Books by the names that users enter: ``entered, lang`` to ``entered, lang, book, book_name, tier``.

    Tiers: 1 exact on any name, 2 prefix, and if ``loose`` 3 whole later words of any name, 4 as a regular expression within
    the matching names. ``NB`` is book N; ``common`` words must be exact. Names are compared without case; the first book by
    id wins a tier. Section lists have 66 rows a language, so they're broadcast.
    """
    fields = [F.lower(F.col(c)) for c in ("name", "shortname", "matching1", "matching2")]
    want = F.lower(F.regexp_replace(F.trim("entered"), r"^\.+|\.+$", ""))
    any_of = lambda test, among=fields: F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(test(f), F.lit(False)) for f in among]), F.lit(False))
    number = F.regexp_extract("entered", r"^([0-9]{1,2})B$", 1)
    free = (F.col("_want") != "") & ~F.col("_want").isin(*common) if common else F.col("_want") != ""
    tests = [(0, number == F.col("book").cast("string")), (1, any_of(lambda f: f == F.col("_want"))), (2, free & any_of(lambda f: f.startswith(F.col("_want"))))]
    if loose:
        word = F.concat(F.lit(" "), F.col("_want"))
        tests.append((3, free & any_of(lambda f: f.contains(F.concat(word, F.lit(" "))) | f.endswith(word))))
        # a name that is no pattern is tried as one that matches nothing
        pattern = F.when(F.col("_want").rlike(NO_PATTERN), F.lit("(?!)")).otherwise(F.col("_want"))
        tests.append((4, free & any_of(lambda f: F.rlike(f, pattern), fields[2:])))
    dim = books.select(F.col("lang").alias("_lang"), F.col("id").alias("book"), F.col("name").alias("book_name"), "name", "shortname", "matching1", "matching2")
    found = tiers(names.select("entered", "lang").distinct().withColumn("_want", want).withColumn("_key", F.struct("entered", "lang")), dim, tests, ["book"], "_key", F.col("lang") == F.col("_lang"))
    return found.select("entered", "lang", "book", "book_name", "tier")


def book_resolver(books: DataFrame, lang: str, common: frozenset[str] = frozenset(), loose: bool = False):
    """A function from an entered name to a book number, for the reference parser (a section list is 66 rows); tiers as in ``resolve_books``."""
    rows = [r.asDict() for r in rows_of_dimension(books.where(F.col("lang") == lang).orderBy("id"), MOST_BOOKS, "books of one language")]
    fields = ("name", "shortname", "matching1", "matching2")

    def resolve(name: str) -> int | None:
        want = name.strip().strip(".").lower()
        if not want or any(c in want for c in "()[]{}\\|+*"):
            return None
        if want[:-1].isdigit() and want.endswith("b"):
            return next((r["id"] for r in rows if r["id"] == int(want[:-1])), None)

        def first(test, among=fields) -> int | None:
            return next((r["id"] for r in rows if any(test((r[f] or "").lower()) for f in among)), None)

        exact = first(lambda f: f == want)
        if exact is not None or want in common:
            return exact
        found = first(lambda f: f.startswith(want))
        if found is None and loose:
            found = first(lambda f: f" {want} " in f or f.endswith(f" {want}"))
        if found is None and loose and not re.search(NO_PATTERN, want):
            found = first(lambda f: re.search(want, f) is not None, fields[2:])
        return found

    return resolve


def shortcut_aliases(shortcuts: DataFrame, lang: str) -> DataFrame:
    """``id, place, alias, reference``: every alias of a language in lower case; ``place`` counts a shortcut's names from 0."""
    names = F.array(*[F.lower(c) for c in ("name", "short1", "short2", "short3")])
    rows = shortcuts.where(F.col("lang") == lang).select("id", F.posexplode(names).alias("place", "alias"), "reference")
    return rows.where("alias is not null and alias <> ''")


def shortcut_map(shortcuts: DataFrame, lang: str) -> dict[str, str]:
    """Aliases to references of one language, the first shortcut that has an alias; more than ``MOST_SHORTCUTS`` are refused.

    A shortcut packs its passages with whatever separators; here they are separated by semicolons, as the parser wants them.
    """
    out: dict[str, str] = {}
    rows = shortcut_aliases(shortcuts, lang).orderBy("id", "place").select("alias", F.array_join(packed_values(F.col("reference")), "; ").alias("reference"))
    for r in rows_of_dimension(rows, 4 * MOST_SHORTCUTS, "aliases of shortcuts"):
        out.setdefault(r.alias, r.reference)
    return out


def resolve_language(entered: DataFrame, languages: DataFrame) -> DataFrame:
    """``entered`` to ``entered, code``: two letters by code, three by ISO 639-2, else by name, first hit first."""
    want = F.lower(F.trim("entered"))
    eq = lambda c: F.coalesce(F.lower(F.col(c)) == F.col("_want"), F.lit(False))
    n = F.length("_want")
    tests = [(1, (n == 2) & (eq("code") | eq("iso_639_1"))), (2, (n == 3) & (eq("iso_639_2") | eq("iso_639_2_b"))), (3, (n > 3) & (eq("lang_name") | eq("native_name")))]
    dim = languages.select("code", "iso_639_1", "iso_639_2", "iso_639_2_b", F.col("name").alias("lang_name"), "native_name")
    any_test = reduce(lambda a, b: a | b, [t for _, t in tests])
    return tiers(entered.select("entered").distinct().withColumn("_want", want), dim, tests, ["code"], "entered", any_test).select("entered", "code", "tier")


def lexicon_lookup(queries: DataFrame, text_col: str, lexicon: DataFrame) -> DataFrame:
    """Definitions of the lexicon numbers in a text, those without one included: ``number, definition, found``."""
    from ..functions.text import lexicon_numbers

    wanted = queries.select(F.explode(lexicon_numbers(F.col(text_col))).alias("number")).distinct()
    return wanted.join(lexicon.select("number", "definition"), "number", "left").withColumn("found", F.col("definition").isNotNull())


def usage(artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """Artifacts with their counters advanced: hits, rendering time and last download of ``events`` (module, seconds, at) are added."""
    n = events.groupBy("module").agg(F.count("*").alias("_n"), F.sum("seconds").alias("_s"), F.max("at").alias("_at"))
    joined = artifacts.join(n, "module", "left")
    kept = [c for c in artifacts.columns if c not in ("hits", "seconds", "downloaded_at")]
    hits, seconds = F.col("hits") + F.coalesce("_n", F.lit(0)), F.col("seconds") + F.coalesce("_s", F.lit(0.0))
    return joined.select(*kept, hits.alias("hits"), seconds.alias("seconds"), F.greatest("downloaded_at", "_at").alias("downloaded_at"))


def live_size(artifacts: DataFrame, now: Column, pending_days: int = 2) -> DataFrame:
    """``total``: size of the artifacts that were downloaded, or rendered in the last days and may yet be."""
    live = F.col("downloaded_at").isNotNull() | (F.col("rendered_at") > now - F.expr(f"interval {pending_days} days"))
    return artifacts.where(live).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))


def section_list_usable(found: DataFrame, known: DataFrame, lang: str, least: int = 66) -> bool:
    """Whether a file's section list may become its language's: complete, all named, and none there yet (lists of tens of rows)."""
    n, named = found.agg(F.count("*"), F.count_if(F.length(F.trim(F.coalesce("name", F.lit("")))) > 0)).first()
    return n >= least and n == named and known.where(F.col("lang") == lang).isEmpty()
