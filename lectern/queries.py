"""Queries of the engine over the test tables, and the SQL that states each of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus
from .corpus import table
from .engine import Engine, Request
from .functions import text as T
from .operators import catalog, grid, mutate, parallel, quota, shape, stats
from .operators.packed import packed_values, split_packed
from .plans import proximity, refs
from .plans import search as lang
from .sources import exports, importers
from .storage import shared_folder
from .streaming import quota as stream_quota

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


# ---- shared pieces of SQL -------------------------------------------------------------------------------------------

STORED = "stored as (select row_id, module, id, book, chapter, verse, coalesce(text, '') as text from verses)"
UNITS = """units as (select row_id, module, id, book, chapter, verse, coalesce(text, '') as text, book::bigint * 1000000 + chapter * 1000 + verse as bcv,
 chapter * 1000 + verse as chapter_verse, loaded_at from (select *, row_number() over (partition by module, id order by loaded_at desc, row_id desc) as n from verses) where n = 1)"""
HIT = ["row_id", "module", "book", "chapter", "verse"]
HIT_SQL = "select row_id, module, book, chapter, verse from stored where "
EDGE = r"[^\p{L}\p{M}\p{N}_]"


def _fold(col: str = "text") -> str:
    return f"translate(lower({col}), '{T.ACCENTED}', '{T.FOLDED}')"


def _has(word: str) -> str:
    return f"contains({_fold()}, '{word}')"


def _whole(word: str, head: bool = True, tail: bool = True) -> str:
    return f"regexp_matches(text, '(?i){f'(^|{EDGE})' if head else ''}{word}{f'({EDGE}|$)' if tail else ''}')"


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Verses as stored, every load of them, with a text that is never null."""
    return table(spark, sf, "verses").select("row_id", "module", "id", "book", "chapter", "verse", "chapter_verse", F.coalesce("text", F.lit("")).alias("text"))


# ---- search ---------------------------------------------------------------------------------------------------------


def _search(name: str, text: str, kind: str, where: str, limit: int | None = None, **how: bool) -> None:
    @query(f"with {STORED} {HIT_SQL}{where}", name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return stored(spark, sf).where(lang.column(lang.parse(text, kind, limit).parts[0], **how)).select(*HIT)


_search("search_all_words", "king valley river", "and", f"{_has('king')} and {_has('valley')} and {_has('river')}")
_search("search_any_word", "potter watchman", "or", f"{_has('potter')} or {_has('watchman')}")
_search("search_xor", "king potter lamp", "xor", f"({_has('king')} <> {_has('potter')}) <> {_has('lamp')}")
_search("search_none", "the", "not", f"not {_has('the')}")
_search("search_two_or_more", "king lamp scroll covenant", "two_or_more", " + ".join(f"{_has(w)}::int" for w in ("king", "lamp", "scroll", "covenant")) + " >= 2")
_search("search_keyword_limit_3", "king lamp valley law river", "keyword_limit", " + ".join(f"{_has(w)}::int" for w in ("king", "lamp", "valley", "law", "river")) + " >= 3", limit=3)
_GAP = "([^a-fi-zA-FI-Z]+)"
_search("search_phrase", "law of the river", "phrase", f"regexp_matches(text, '(?i)law{_GAP}of{_GAP}the{_GAP}river')")
_search("search_phrase_whole", "silver cup", "phrase", f"regexp_matches(text, '(?i)(^|{EDGE})silver{_GAP}cup({EDGE}|$)')", whole_words=True)
_search("search_regexp", r"lamp|scr[a-z]+l", "regexp", r"regexp_matches(text, '(?i)lamp|scr[a-z]+l')")
_search("search_whole_words", "the", "and", f"{_has('the')} and {_whole('the')}", whole_words=True)
_search("search_wildcard_prefix", "shep*", "and", f"{_has('shep')} and {_whole('shep', tail=False)}", whole_words=True)
_search("search_wildcard_suffix", "%herd", "and", f"{_has('herd')} and {_whole('herd', head=False)}", whole_words=True)
_search("search_exact_case", "The king", "and", "contains(text, 'The') and contains(text, 'king')", exact_case=True)
_search("search_boolean_nested", 'king && (lamp || "silver cup") NOT covenant', "boolean", f"{_has('king')} and ({_has('lamp')} or regexp_matches(text, '(?i)silver{_GAP}cup')) and not {_has('covenant')}")
_search("search_boolean_precedence", "lamp OR cup XOR king potter", "boolean", f"{_has('lamp')} or ({_has('cup')} <> ({_has('king')} and {_has('potter')}))")
_search("search_accent_fold", "epis", "and", _has("epis"))
_search("search_cyrillic", "царь", "and", "contains(lower(text), 'царь')")
_search("search_lexicon_number", "H2230", "and", f"regexp_matches(text, '(?i)(^|{EDGE})H2230({EDGE}|$)')")


@query(f"with {STORED} {HIT_SQL}({_has('king')} and {_has('valley')}) and ({_has('lamp')} or {_has('cup')} or {_has('scroll')}) and not ({_has('covenant')} or {_has('rain')})")
def search_advanced_combined(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).where(lang.advanced({"all": "king valley", "any": "lamp cup scroll", "none": "covenant rain"})).select(*HIT)


@query(f"select id, module from bibles where (({_has('version').replace('text', 'coalesce(name, $$$$)')}) or ({_has('version').replace('text', 'coalesce(description, $$$$)')}))")
def search_multi_field(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bibles").where(lang.multi_field(lang.parse("version").parts[0], ["name", "description"])).select("id", "module")


@query(f"with {STORED} select module, count(*) as hits from stored where {_has('king')} group by module")
def count_hits_by_edition(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).where(lang.column(lang.parse("king").parts[0])).groupBy("module").agg(F.count("*").alias("hits"))


@query(
    "select request_id, search, case when len(list_filter(w, lambda x: x not in ('the', 'of', 'and', 'in', 'a'))) = 0 then 'refused' else 'accepted' end as verdict "
    r"from (select request_id, search, regexp_extract_all(lower(search), '[\p{L}\p{M}]+') as w from passage_requests where search is not null) where len(w) > 0"
)
def stop_word_policy(spark: SparkSession, sf: str) -> DataFrame:
    """A search is refused only if all of its words are common."""
    words = F.regexp_extract_all(F.lower("search"), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1))
    rows = table(spark, sf, "passage_requests").where("search is not null").withColumn("w", words).where(F.size("w") > 0)
    refused = lang.common_only(F.col("w"), ("the", "of", "and", "in", "a"))
    return rows.select("request_id", "search", F.when(refused, "refused").otherwise("accepted").alias("verdict"))


# ---- lookup ---------------------------------------------------------------------------------------------------------


def _lookup(name: str, reference: str, where: str) -> None:
    @query(f"with {STORED} {HIT_SQL}{where.replace('cv', '(chapter * 1000 + verse)')}", name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        passages = refs.parse_references(reference, lambda b: int(b[:-1]) if b.endswith("B") else None)
        return stored(spark, sf).where(refs.predicate(passages)).select(*HIT)


_lookup("lookup_single", "19B 2:3", "book = 19 and cv = 2003")
_lookup("lookup_ranges", "1B 1:2-5, 3B 1:4 - 2:2; 40B 1,3", "(book = 1 and cv between 1002 and 1005) or (book = 3 and cv between 1004 and 2002) or (book = 40 and (cv between 1000 and 1999 or cv between 3000 and 3999))")
_lookup("lookup_book_range", "5B - 7B", "book between 5 and 7")
_lookup("lookup_open_ranges", "1B 2:5 - ; 2B - 1:7; 19B 3-", "(book = 1 and cv between 2005 and 2999) or (book = 2 and cv <= 1007) or (book = 19 and cv >= 3000)")
_lookup("lookup_default_chapter", "8B", "book = 8 and cv between 1000 and 1999")


@query(f"with {STORED} {HIT_SQL} book = 1 and chapter = 1 and verse between 5 and 15")
def lookup_context(spark: SparkSession, sf: str) -> DataFrame:
    p = refs.with_context(refs.parse_references("1B 1:10", lambda b: int(b[:-1]))[0], 5)
    return stored(spark, sf).where(refs.predicate([p])).select(*HIT)


@query(
    f"with {UNITS}, wanted as (select distinct bcv from units where book = 19 and verse = 1) select u.row_id, u.module, u.book, u.chapter, u.verse from units u semi join wanted w on u.bcv = w.bcv"
)
def lookup_by_bcv(spark: SparkSession, sf: str) -> DataFrame:
    wanted = corpus.units(spark, sf, text=False, inside=F.expr("book = 19 and verse = 1"))
    return refs.at_addresses(corpus.units(spark, sf, text=False), wanted).select(*HIT)


@query(f"with {UNITS} select row_id, module, book, chapter, verse from units where module = (select min(module) from verses) and id in (1, 5, 9)")
def lookup_verse_ids(spark: SparkSession, sf: str) -> DataFrame:
    """References by verse id, as in ``1V, 5V``: the ids' addresses come from the first edition."""
    return Engine(spark, sf).hits(Request([_baseline(spark, sf)], reference="1V, 5V, 9V")).select(*HIT)


@query(f"with {UNITS}, c as (select book, max(chapter) as n from units group by book) select book, unnest(generate_series(1, n))::int as chapter from c where book between 3 and 6")
def explode_passages(spark: SparkSession, sf: str) -> DataFrame:
    """A range of books as one passage a chapter; the last chapters are a row a book."""
    last = {r.book: r.n for r in corpus.units(spark, sf, text=False).groupBy("book").agg(F.max("chapter").alias("n")).collect()}
    parts = refs.exploded(refs.parse_references("3B - 6B", lambda b: int(b[:-1]))[0], lambda b: last.get(b, 0))
    return spark.createDataFrame([(p.book, p.items[0].c0) for p in parts], "book int, chapter int")


@query(f"with {STORED} {HIT_SQL} {_has('king')} and book between 1 and 3")
def search_within_passage(spark: SparkSession, sf: str) -> DataFrame:
    inside = refs.predicate(refs.parse_references("1B - 3B", lambda b: int(b[:-1])))
    return stored(spark, sf).where(inside & lang.column(lang.parse("king").parts[0])).select(*HIT)


@query("select count(*) as n from verses where book = 19 and chapter = 1 and verse between 2 and 9")
def count_verses(spark: SparkSession, sf: str) -> DataFrame:
    passages = refs.parse_references("19B 1:2-9", lambda b: int(b[:-1]))
    return stats.count_verses(stored(spark, sf), refs.predicate(passages))


_RANGES = [(1, 19, 1002, 1009), (2, 1, 1000, 2003), (3, 19, 1005, 1012), (4, 40, 0, 999_999)]
_RANGES_SQL = "ranges(passage, book, low, high) as (values (1, 19, 1002, 1009), (2, 1, 1000, 2003), (3, 19, 1005, 1012), (4, 40, 0, 999999))"


def _ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RANGES, "passage int, book int, low int, high int")


@query(f"with {UNITS}, {_RANGES_SQL} select passage, row_id, module, chapter, verse from units u join ranges r on u.book = r.book and u.chapter_verse between low and high")
def claim_rows(spark: SparkSession, sf: str) -> DataFrame:
    return stats.claimed(corpus.units(spark, sf, text=False), _ranges(spark)).select("passage", "row_id", "module", "chapter", "verse")


@query(f"with {UNITS}, {_RANGES_SQL} select passage, max(n) as verses_count from (select passage, module, count(*) as n from units u join ranges r on u.book = r.book and u.chapter_verse between low and high group by all) group by passage")
def claim_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.claim_counts(corpus.units(spark, sf, text=False), _ranges(spark))


@query(
    "select request_id, b.id as book from (select request_id, language, regexp_extract(reference, '^\\s*([0-9]?\\s?[^\\x00-\\x40\\[-`{-~]+)\\s[0-9]+$', 1) as entered from passage_requests where reference is not null) q "
    "join (select lang, lower(name) as name, min(id) as id from books group by all) b on b.lang = q.language and lower(q.entered) = b.name"
)
def resolve_requested_books(spark: SparkSession, sf: str) -> DataFrame:
    """Books of the requests that name just one, by exact name."""
    entered = F.regexp_extract("reference", "^\\s*([0-9]?\\s?[^\\x00-\\x40\\[-`{-~]+)\\s[0-9]+$", 1)
    q = table(spark, sf, "passage_requests").where("reference is not null").select("request_id", F.col("language").alias("lang"), F.lower(entered).alias("name"))
    names = table(spark, sf, "books").groupBy("lang", F.lower("name").alias("name")).agg(F.min("id").alias("book"))
    return q.join(F.broadcast(names), ["lang", "name"]).select("request_id", "book")


@query(
    """with q as (select distinct language as lang, search as entered from passage_requests where search is not null and language is not null
 union select lang, substr(name, 1, 4) from books union select lang, matching2 from books where matching2 is not null),
 c as (select q.lang, q.entered, b.id as book, b.name as book_name, trim(both '.' from lower(trim(q.entered))) as w, lower(b.name) as n, lower(b.shortname) as s, lower(coalesce(b.matching1, chr(1))) as m1, lower(coalesce(b.matching2, chr(1))) as m2
  from q join books b on q.lang = b.lang),
 t as (select *, case when regexp_extract(entered, '^([0-9]{1,2})B$', 1) = book::varchar then 0 when w in (n, s, m1, m2) then 1 when w <> '' and (starts_with(n, w) or starts_with(s, w) or starts_with(m1, w) or starts_with(m2, w)) then 2 end as tier from c)
 select entered, lang, book, book_name, tier from (select *, row_number() over (partition by entered, lang order by tier, book) as k from t where tier is not null) where k = 1"""
)
def book_resolver_tiers(spark: SparkSession, sf: str) -> DataFrame:
    books = table(spark, sf, "books")
    names = table(spark, sf, "passage_requests").where("search is not null and language is not null").select(F.col("search").alias("entered"), F.col("language").alias("lang"))
    names = names.unionByName(books.select(F.substring("name", 1, 4).alias("entered"), "lang")).unionByName(books.where("matching2 is not null").select(F.col("matching2").alias("entered"), "lang"))
    return catalog.resolve_books(names, books)


@query()
def requested_books(spark: SparkSession, sf: str) -> DataFrame:
    """The book of every passage of every request, by all tiers; without a book where no tier knows the name.

    ``resolve_requested_books`` is the part of it that SQL states: requests that are one bare name and number.
    """
    requests = table(spark, sf, "passage_requests").select("request_id", F.col("language").alias("lang"), "reference")
    items = requests.select("request_id", "lang", F.posexplode(packed_values(F.col("reference"))).alias("at", "item"))
    # the name is what stands before the chapters and verses
    items = items.withColumn("entered", F.regexp_replace("item", r"[\s\p{Z}\d:,;.\-–]+$", ""))
    found = catalog.resolve_books(items.select("entered", "lang"), table(spark, sf, "books"), loose=True, common=catalog.COMMON)
    rows = items.join(found, ["entered", "lang"], "left")
    return rows.select("request_id", (F.col("at") + 1).cast("int").alias("item_no"), "item", "entered", "book", "tier")


@query(
    """with q as (select distinct language as lang, search as entered from passage_requests where search is not null and language is not null
 union select lang, substr(name, 1, 4) from books union select lang, matching2 from books where matching2 is not null
 union select lang, regexp_extract(name, ' ([^ ]+)$', 1) from books union select lang, substr(matching1, 2) from books where matching1 is not null union select lang, substr(matching2, 2) from books where matching2 is not null),
 c as (select q.lang, q.entered, b.id as book, b.name as book_name, trim(both '.' from lower(trim(q.entered, ' '))) as w, lower(b.name) as n, lower(b.shortname) as s, lower(coalesce(b.matching1, chr(1))) as m1, lower(coalesce(b.matching2, chr(1))) as m2
  from q join books b on q.lang = b.lang),
 d as (select *, w <> '' and w not in ('a', 'and', 'the', 'or', 'but') as free, ' ' || n || chr(1) || s || chr(1) || m1 || chr(1) || m2 || chr(1) as every from c),
 t as (select *, case when regexp_extract(entered, '^([0-9]{1,2})B$', 1) = book::varchar then 0 when w in (n, s, m1, m2) then 1 when free and (starts_with(n, w) or starts_with(s, w) or starts_with(m1, w) or starts_with(m2, w)) then 2
   when free and (contains(substr(every, 2), ' ' || w || ' ') or contains(substr(every, 2), ' ' || w || chr(1))) then 3
   when free and not regexp_matches(w, '[()\\[\\]{}\\\\|+*&?]') and (regexp_matches(m1, w) or regexp_matches(m2, w)) then 4 end as tier from d)
 select entered, lang, book, book_name, tier from (select *, row_number() over (partition by entered, lang order by tier, book) as k from t where tier is not null) where k = 1"""
)
def book_resolver_all_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """``book_resolver_tiers`` with the loose tiers and with names that only those know: later words and inner parts."""
    books = table(spark, sf, "books")
    names = table(spark, sf, "passage_requests").where("search is not null and language is not null").select(F.col("search").alias("entered"), F.col("language").alias("lang"))
    for own in (F.substring("name", 1, 4), F.col("matching2"), F.regexp_extract("name", " ([^ ]+)$", 1), F.expr("substr(matching1, 2)"), F.expr("substr(matching2, 2)")):
        names = names.unionByName(books.select(own.alias("entered"), "lang").where("entered is not null"))
    return catalog.resolve_books(names, books, loose=True, common=catalog.COMMON)


@query("select id, alias, reference from (select id, unnest([lower(name), lower(short1), lower(short2), lower(short3)]) as alias, reference from shortcuts where lang = 'en') where alias is not null")
def shortcut_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.shortcut_aliases(table(spark, sf, "shortcuts"), "en").select("id", "alias", "reference")


@query()
def shortcut_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Verses of each passage behind every alias of a language, through the alias map and the parser; no SQL, as the parser decides."""
    aliases = catalog.shortcut_map(table(spark, sf, "shortcuts"), "en")
    resolve = Engine(spark, sf).resolver("en")
    rows = [(alias, *x) for alias in aliases for x in refs.Ranges.of(refs.parse_references(alias, resolve, aliases)).rows]
    ranges = spark.createDataFrame(rows, "alias string, passage int, book int, low int, high int")
    return stats.claimed(corpus.units(spark, sf, text=False), ranges).groupBy("alias", "passage", "module").agg(F.count("*").alias("n_verses"))


@query("select module, book, chapter from (select distinct module, book, chapter from verses) order by md5('7' || chr(31) || module || chr(31) || book || chr(31) || chapter), module, book, chapter limit 1")
def random_reference_seeded(spark: SparkSession, sf: str) -> DataFrame:
    return parallel.random_unit(table(spark, sf, "verses"), seed=7, what="chapter")


# ---- proximity ------------------------------------------------------------------------------------------------------

_PAIR = "a.module = b.module and a.book = b.book and (b.book <> 19 or a.chapter = b.chapter)"


def _near(name: str, text: str, sql: str, inside: str | None = None, kind: str = "boolean", limit: int | None = None) -> None:
    @query(f"with {UNITS}, hit as (select *, {_has('king')} as k, {_has('lamp')} as l, {_has('covenant')} as c from units), found as ({sql}) select distinct u.row_id, u.module, u.book, u.chapter, u.verse from units u join found f on u.row_id = f.row_id", name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        passage = refs.predicate(refs.parse_references(inside, lambda b: int(b[:-1]))) if inside else None
        return proximity.chain(corpus.units(spark, sf), lang.parse(text, kind, limit), passage).select(*HIT)


def _both(on: str, a: str = "k", b: str = "l", extra: str = "") -> str:
    pair = f"select a.row_id as x, b.row_id as y from hit a join hit b on {on} and a.{a} and b.{b}{extra}"
    return f"select unnest([x, y]) as row_id from ({pair})"


_near("prox_two_terms", "king PROX(3) lamp", _both(f"{_PAIR} and b.id between a.id - 3 and a.id + 3"))
_near("prox_search_type", "king lamp", _both(f"{_PAIR} and b.id between a.id - 5 and a.id + 5"), kind="proximity")
_near("prox_same_chapter_distance", "king PROC(4) lamp", _both("a.module = b.module and a.book = b.book and a.chapter = b.chapter and b.id between a.id - 4 and a.id + 4"))
_near("prox_same_chapter", "king CHAP lamp", _both("a.module = b.module and a.book = b.book and a.chapter = b.chapter"))
_near("prox_same_book", "king ~b covenant", _both("a.module = b.module and a.book = b.book", b="c"))
_near("prox_scoped_book", "king PROX(20) lamp", f"select row_id from ({_both(f'{_PAIR} and b.id between a.id - 20 and a.id + 20')}) join hit using (row_id) where book = 19", inside="19B 0-")
_chain = (
    f"select unnest([x, y, z]) as row_id from (select a.row_id as x, b.row_id as y, d.row_id as z from hit a join hit b on {_PAIR} and b.id between a.id - 2 and a.id + 2 and a.k and b.l"
    f" join hit d on b.module = d.module and b.book = d.book and (d.book <> 19 or b.chapter = d.chapter) and d.id between b.id - 4 and b.id + 4 and d.c)"
)
_near("prox_chain_three", "king ~p(2) lamp PROX(4) covenant", _chain)
_near("prox_chain_mixed", "king PROX(2) lamp CHAP covenant", _chain.replace("(d.book <> 19 or b.chapter = d.chapter) and d.id between b.id - 4 and b.id + 4 and d.c", "b.chapter = d.chapter and d.c"))
_near(
    "prox_in_passage",
    "king PROX(3) lamp",
    f"select row_id from ({_both(f'{_PAIR} and b.id between a.id - 3 and a.id + 3', extra=' and a.book between 1 and 20')}) join hit using (row_id) where book between 1 and 20",
    inside="1B - 20B",
)

# ---- counts, positions, differences ---------------------------------------------------------------------------------


@query(f"with {UNITS} select module, book, chapter, max(verse) as verses from units group by all")
def chapter_verse_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.verse_counts(corpus.units(spark, sf, text=False))


@query(f"with {UNITS} select module, book, max(chapter) as chapters, string_agg(chapter || ':' || v, ',' order by chapter) as verses from (select module, book, chapter, max(verse) as v from units group by all) group by all")
def nested_counts(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.transform(F.map_entries("verses_by_chapter"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return stats.chapter_counts(corpus.units(spark, sf, text=False)).select("module", "book", "chapters", F.array_join(pairs, ",").alias("verses"))


_BASE = "(select min(module) from verses)"


def _baseline(spark: SparkSession, sf: str) -> str:
    return table(spark, sf, "verses").agg(F.min("module")).first()[0]


@query(
    f"with {UNITS}, c as (select module, book, chapter, max(verse) as verses from units group by all) select a.module, a.book, a.chapter, a.verses, b.verses as expected from c a join c b on b.module = {_BASE} and a.book = b.book and a.chapter = b.chapter where a.module <> b.module and a.verses <> b.verses"
)
def count_diffs_vs_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return stats.count_differences(corpus.units(spark, sf, text=False), _baseline(spark, sf))


_SCOPES = {"passage": "book = 19 and chapter_verse between 1002 and 1009", "chapter": "book = 19 and chapter = 1", "book": "book = 19", "full": "true"}


@query(
    f"with {UNITS} " + " union all ".join(f"select module, '{s}' as scope, count(*) filter ({w}) as n_verses, count(distinct (book, chapter)) filter ({w}) as n_chapters, count(distinct book) filter ({w}) as n_books from units group by module" for s, w in _SCOPES.items())
)
def statistics_scopes(spark: SparkSession, sf: str) -> DataFrame:
    passage = refs.predicate(refs.parse_references("19B 1:2-9", lambda b: int(b[:-1])))
    return stats.statistics(corpus.units(spark, sf, text=False), passage, 19, 1)


@query("select module, book, chapter, (row_number() over (partition by module order by book, chapter))::int as position from (select distinct module, book, chapter from verses)")
def chapter_positions(spark: SparkSession, sf: str) -> DataFrame:
    return stats.chapter_positions(table(spark, sf, "verses"))


@query(
    "select module, book, chapter, coalesce(lag(book) over w, 0) as prev_book, coalesce(lag(chapter) over w, 0) as prev_chapter, coalesce(lead(book) over w, 0) as next_book, coalesce(lead(chapter) over w, 0) as next_chapter from (select distinct module, book, chapter from verses) window w as (partition by module order by book, chapter)"
)
def navigation(spark: SparkSession, sf: str) -> DataFrame:
    return stats.navigation(table(spark, sf, "verses")).fillna(0)


@query("select module, book, coalesce(lag(book) over w, 0) as prev_book, coalesce(lead(book) over w, 0) as next_book from (select distinct module, book from verses) window w as (partition by module order by book)")
def book_navigation(spark: SparkSession, sf: str) -> DataFrame:
    return stats.book_navigation(table(spark, sf, "verses")).fillna(0)


@query("select book, chapter, string_agg(verse, ',' order by verse) as verse_numbers from (select distinct book, chapter, verse from verses) group by all")
def verse_index(spark: SparkSession, sf: str) -> DataFrame:
    return stats.verse_index(table(spark, sf, "verses")).withColumn("verse_numbers", F.array_join("verse_numbers", ","))


@query(
    f"""with {UNITS}, {_RANGES_SQL}, c as (select passage, module, chapter, min(verse) as a, max(verse) as b from units u join ranges r on u.book = r.book and u.chapter_verse between low and high group by all)
 select passage, module, string_agg(chapter || ':' || a || case when a < b then ' - ' || b else '' end, '; ' order by chapter) as label from c group by all"""
)
def passage_labels(spark: SparkSession, sf: str) -> DataFrame:
    return stats.passage_labels(corpus.units(spark, sf, text=False), _ranges(spark))


_TWO = "pair as (select min(module) as a, max(module) as b from verses)"


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    a, b = table(spark, sf, "verses").agg(F.min("module"), F.max("module")).first()
    rows = table(spark, sf, "verses").select("module", "book", "chapter", "verse").distinct()
    return rows.where(F.col("module") == a), rows.where(F.col("module") == b)


@query(f"with {_TWO}, d as (select distinct module, book, chapter, verse from verses) select x.* from d x, pair where x.module = a and not exists (select 1 from d y where y.module = b and y.book = x.book and y.chapter = x.chapter and y.verse = x.verse)")
def edition_minus(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _pair(spark, sf)
    return stats.missing_addresses(left, right)


@query(f"with {_TWO}, d as (select distinct module, book, chapter, verse from verses) select x.* from d x, pair where x.module = b and not exists (select 1 from d y where y.module = a and y.book = x.book and y.chapter = x.chapter and y.verse = x.verse)")
def edition_plus(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _pair(spark, sf)
    return stats.missing_addresses(right, left)


@query(
    f"with d as (select distinct module, book, chapter, verse from verses), base as (select book, chapter, verse from d where module = {_BASE}), m as (select distinct module from d where module <> {_BASE}) select m.module, b.* from base b, m where not exists (select 1 from d where d.module = m.module and d.book = b.book and d.chapter = b.chapter and d.verse = b.verse)"
)
def edition_diff_all(spark: SparkSession, sf: str) -> DataFrame:
    return stats.missing_from_default(table(spark, sf, "verses"), _baseline(spark, sf))


@query("select greatest((select max(greatest(created_at, coalesce(updated_at, created_at))) from bibles), (select max(loaded_at) from verses)) as changed_at")
def max_updated(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(spark, sf).changed()


@query("select epoch(greatest((select max(greatest(created_at, coalesce(updated_at, created_at))) from bibles), (select max(loaded_at) from verses)))::bigint as changed_at")
def max_updated_unix(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(spark, sf).changed().select(F.unix_timestamp(F.col("changed_at")).alias("changed_at"))


# ---- parallel editions, lists, pages --------------------------------------------------------------------------------


@query(f"with {UNITS}, t as (select *, not ({_has('king')} and {_has('lamp')}) as unmatched from units), m as (select distinct bcv from t where not unmatched) select row_id, module, t.bcv, unmatched from t semi join m on t.bcv = m.bcv")
def parallel_align(spark: SparkSession, sf: str) -> DataFrame:
    hit = lang.column(lang.parse("king lamp").parts[0])
    return parallel.aligned(corpus.units(spark, sf), hit).select("row_id", "module", "bcv", "unmatched")


@query(
    f"with {STORED}, d as (select distinct book, chapter, verse from stored where {_has('king')}), r as (select *, row_number() over (order by book, chapter, verse) as n from d) select lpad(book::varchar, 2, '0') || '_' || lpad(chapter::varchar, 3, '0') || '_' || lpad(verse::varchar, 3, '0') as sort_key, book, chapter, verse, n between 31 and 60 as showing from r"
)
def results_list_page(spark: SparkSession, sf: str) -> DataFrame:
    return parallel.result_list(stored(spark, sf).where(lang.column(lang.parse("king").parts[0])), page=2)


@query(f"with {STORED} {HIT_SQL} {_has('king')} order by book, chapter, verse, module, row_id limit 30 offset 30")
def paginate_page_2(spark: SparkSession, sf: str) -> DataFrame:
    hits = stored(spark, sf).where(lang.column(lang.parse("king").parts[0]))
    return parallel.page(hits, ["book", "chapter", "verse", "module", "row_id"], number=2).select(*HIT)


@query(f"with {STORED}, t as (select count(*) as total from stored where {_has('king')}) select total, 30 as per_page, 2 as current_page, greatest(ceil(total / 30.0), 1)::bigint as last_page, case when total >= 31 then 31 end::bigint as from_row, case when total >= 31 then least(60, total) end::bigint as to_row from t")
def paging_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return parallel.envelope(stored(spark, sf).where(lang.column(lang.parse("king").parts[0])), number=2)


@query(f"with {STORED}, r as (select *, row_number() over (partition by module order by book, chapter, verse, row_id) as n from stored where {_has('the')}) select row_id, module, book, chapter, verse from r where n <= 20")
def per_module_limit(spark: SparkSession, sf: str) -> DataFrame:
    hits = stored(spark, sf).where(lang.column(lang.parse("the").parts[0]))
    return parallel.first_of_each(hits, ["module"], ["book", "chapter", "verse", "row_id"], 20).select(*HIT)


# ---- text -----------------------------------------------------------------------------------------------------------


@query(f"with {STORED} select row_id, regexp_replace(text, '(?i)(silver cup|king)', '<b>\\1</b>', 'g') as marked from stored where {_has('king')}")
def highlight_terms(spark: SparkSession, sf: str) -> DataFrame:
    hits = stored(spark, sf).where(lang.column(lang.parse("king").parts[0]))
    return hits.select("row_id", T.highlight(F.col("text"), ["king", "silver cup"]).alias("marked"))


_EPIS = "[eèéêëēĕėęě]p[iìíîïīĭį][sšś]"


@query(f"with {STORED} select row_id, regexp_replace(text, '(?i)({_EPIS}|silver cup|king)', '<b>\\1</b>', 'g') as marked from stored where {_has('epis')} or {_has('king')}")
def highlight_accented(spark: SparkSession, sf: str) -> DataFrame:
    """``highlight_terms`` with a word that the texts write with accents."""
    hits = stored(spark, sf).where(lang.column(lang.parse("epis king", "or").parts[0]))
    return hits.select("row_id", T.highlight(F.col("text"), ["epis", "king", "silver cup"]).alias("marked"))


@query(r"with " + STORED + r" select row_id, regexp_replace(text, '(?i)(^|[^\p{L}\p{M}\p{N}_])(watchman)($|[^\p{L}\p{M}\p{N}_])', '\1<i>\2</i>\3', 'g') as marked from stored where contains(lower(text), 'watchman')")
def highlight_whole_word(spark: SparkSession, sf: str) -> DataFrame:
    hits = stored(spark, sf).where(F.lower("text").contains("watchman"))
    return hits.select("row_id", T.highlight(F.col("text"), ["watchman"], "i", whole_words=True).alias("marked"))


_STRIP = r"trim(regexp_replace(regexp_replace(translate(text, '‹›[]', ''), '\{[^}]+\}', '', 'g'), ' {2,}', ' ', 'g'), ' ')"


@query(f"with {STORED} select row_id, {_STRIP} as plain from stored where regexp_matches(text, '[\\[{{‹]')")
def strip_markup(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).where(F.col("text").rlike(r"[\[{‹]")).select("row_id", T.strip_markup(F.col("text")).alias("plain"))


@query(f"with {STORED} select row_id, case when verse = 10 then '<b>' || text || '</b>' else text end as shown from stored where book = 1 and chapter = 1 and verse between 5 and 15")
def mark_context_target(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf).where("book = 1 and chapter = 1 and verse between 5 and 15")
    return rows.select("row_id", shape.mark_target(F.col("text"), F.col("verse") == 10).alias("shown"))


@query(r"with " + STORED + r", f as (select row_id, unnest(regexp_extract_all(text, '[GHgh][0-9]+')) as x from stored) select regexp_replace(upper(x), '^([GH])0+', '\1') as number, count(*) as n from f group by all")
def lexicon_usage(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).select(F.explode(T.lexicon_numbers(F.col("text"))).alias("number")).groupBy("number").agg(F.count("*").alias("n"))


@query(r"with " + STORED + r", f as (select distinct regexp_replace(upper(unnest(regexp_extract_all(text, '[GHgh][0-9]+'))), '^([GH])0+', '\1') as number from stored), d as (select strongs as number, min(row_id)::varchar as definition from verses where strongs is not null group by all) select f.number, definition, definition is not null as found from f left join d on f.number = d.number")
def lexicon_lookup(spark: SparkSession, sf: str) -> DataFrame:
    lexicon = table(spark, sf, "verses").where("strongs is not null").groupBy(F.col("strongs").alias("number")).agg(F.min("row_id").cast("string").alias("definition"))
    return catalog.lexicon_lookup(stored(spark, sf), "text", lexicon)


@query("select doc_id, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), ' ([?,.!:;])', '\\1', 'g')) as clean from documents where doc_kind = 'notice' and text is not null and not regexp_matches(text, '[^\\x00-\\x7f]')")
def clean_spacing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("doc_kind = 'notice' and text is not null").where(~F.col("text").rlike(r"[^\x00-\x7f]"))
    return rows.select("doc_id", T.clean_spaces(F.col("text")).alias("clean"))


@query("select doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ([?,.!:;])', '\\1', 'g'), ' ') as clean from documents where text is not null")
def clean_spacing_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with a text, in any script; ``clean_spacing`` is the part of it that its older SQL states."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.clean_spaces(F.col("text")).alias("clean"))


_HTML = "'<p>' || coalesce(name, '') || '<br/>' || coalesce(year, '') || ' &amp; &lt;' || module || '&gt;</p>'"


@query(f"select id, regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({_HTML}, '(?i)<br\\s*/?>|</p>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '^\\s+|\\s+$', '', 'g') as plain from bibles")
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    html = F.concat(F.lit("<p>"), F.coalesce("name", F.lit("")), F.lit("<br/>"), F.coalesce("year", F.lit("")), F.lit(" &amp; &lt;"), "module", F.lit("&gt;</p>"))
    return table(spark, sf, "bibles").select("id", T.html_to_text(html).alias("plain"))


@query("select id, module || '.example.org' as host from bibles")
def host_parse(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit("HTTPS://www."), "module", F.lit(".example.org:8080/find?x=1#top"))
    return table(spark, sf, "bibles").select("id", T.host(url).alias("host"))


_SLUG = "regexp_replace(regexp_replace(lower(coalesce(shortname, 'edition')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"select id, case when k = 1 then s else s || '_' || k end as slug from (select id, s, row_number() over (partition by s order by id) as k from (select id, {_SLUG} as s from bibles))")
def slug_unique(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.unique_slugs(table(spark, sf, "bibles"), F.coalesce("shortname", F.lit("edition")), "id").select("id", "slug")


@query("select id, id || case when id % 100 between 11 and 13 then 'th' when id % 10 = 1 then 'st' when id % 10 = 2 then 'nd' when id % 10 = 3 then 'rd' else 'th' end as ordinal from bibles")
def ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bibles").select("id", T.ordinal(F.col("id")).alias("ordinal"))


@query("select id, (id * (case id % 4 when 0 then 1 when 1 then 1024 when 2 then 1048576 else 1073741824 end)::bigint)::bigint as bytes from bibles")
def size_strings(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit(""), F.lit("K"), F.lit("m"), F.lit("G")), F.col("id") % 4 + 1)
    return table(spark, sf, "bibles").select("id", T.size_bytes(F.concat(F.col("id").cast("string"), unit)).alias("bytes"))


@query("select a.id as id_a, b.id as id_b from bibles a join bibles b on b.id = a.id + 1 where [a.id // 10, a.id % 10] < [b.id // 10, b.id % 10]")
def version_compare(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "bibles").select("id", F.concat_ws(".", F.floor(F.col("id") / 10), F.col("id") % 10).alias("v"))
    a, b = v.toDF("id_a", "v_a"), v.toDF("id_b", "v_b")
    return a.join(b, F.col("id_b") == F.col("id_a") + 1).where(T.version_parts(F.col("v_a")) < T.version_parts(F.col("v_b"))).select("id_a", "id_b")


@query("select id, md5(coalesce(name, '') || chr(31) || coalesce(year, '') || chr(31) || coalesce(lang_short, '')) as meta_hash, sha256(coalesce(name, '')) as name_hash from bibles")
def metadata_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bibles").select("id", catalog.metadata_hash(["name", "year", "lang_short"]).alias("meta_hash"), F.sha2(F.coalesce("name", F.lit("")), 256).alias("name_hash"))


@query("select request_id, request_id % 3 = 0 as flag, coalesce(trim(lower(whole_words::varchar)) in ('1', 'true', 'on', 'yes', 'y'), false) as whole from passage_requests")
def input_coercion(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "passage_requests")
    word = F.when(F.col("request_id") % 3 == 0, " YES ").otherwise("off")
    return rows.select("request_id", T.truthy(word).alias("flag"), F.coalesce(T.truthy(F.col("whole_words")), F.lit(False)).alias("whole"))


@query("select bcv, (bcv // 1000000)::int as book, (bcv // 1000 % 1000)::int as chapter, (bcv % 1000)::int as verse from (select distinct book::bigint * 1000000 + chapter * 1000 + verse as bcv from verses)")
def address_codes(spark: SparkSession, sf: str) -> DataFrame:
    codes = table(spark, sf, "verses").select(corpus.bcv(F.col("book"), F.col("chapter"), F.col("verse")).alias("bcv")).distinct()
    book, chapter, verse = corpus.from_bcv(F.col("bcv"))
    return codes.select("bcv", book.alias("book"), chapter.alias("chapter"), verse.alias("verse"))


# ---- shape ----------------------------------------------------------------------------------------------------------


@query(f"with {STORED}, {_RANGES_SQL} select passage, module, s.book, chapter, count(*) as n_hits, min(verse) as first_verse, max(verse) as last_verse from stored s join ranges r on s.book = r.book and chapter * 1000 + verse between low and high where {_has('the')} group by all")
def group_hits_by_chapter(spark: SparkSession, sf: str) -> DataFrame:
    hits = stored(spark, sf).where(lang.column(lang.parse("the").parts[0]))
    return shape.hits_by_chapter(hits, _ranges(spark))


@query(f"with {UNITS}, {_RANGES_SQL} select passage, module, count(*) as n_verses, string_agg(chapter || ':' || verse || ' ' || text, chr(10) order by chapter, verse) as body from units u join ranges r on u.book = r.book and u.chapter_verse between low and high group by all")
def passages_nested(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.transform("verses", lambda v: F.concat(v["chapter"], F.lit(":"), v["verse"], F.lit(" "), v["text"]))
    return shape.by_passage(corpus.units(spark, sf), _ranges(spark)).select("passage", "module", "n_verses", F.array_join(lines, "\n").alias("body"))


@query(f"with {UNITS} select bcv, book, chapter, verse, string_agg(module, ',' order by module) as modules from units where {_has('king')} and {_has('lamp')} group by all")
def results_by_address(spark: SparkSession, sf: str) -> DataFrame:
    hits = corpus.units(spark, sf).where(lang.column(lang.parse("king lamp").parts[0]))
    return shape.by_address(hits).select("bcv", "book", "chapter", "verse", F.array_join(F.map_keys("texts"), ",").alias("modules"))


@query(f"with {UNITS}, p as (select *, sum(contains(text, '¶')::int) over (partition by module, book, chapter order by verse, id) as paragraph from units) select module, book, chapter, paragraph::bigint as paragraph, min(verse) as first_verse, string_agg(trim(replace(text, '¶', ''), ' '), ' ' order by verse, id) as text from p group by all")
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return shape.paragraphs(corpus.units(spark, sf))


@query(
    f"with {UNITS}, e as (select row_id, module, book, chapter, verse, id, text || case when verse % 5 = 0 then ' ¶' else '' end as text from units), c as (select row_id, coalesce(lag(regexp_matches(text, '¶\\s*$')) over (partition by module, book, chapter order by verse, id), false) as carry, trim(regexp_replace(text, '\\s*¶\\s*$', ''), ' ') as bare, text from e) select row_id, case when carry and not starts_with(text, '¶') then '¶ ' || bare else bare end as text from c"
)
def paragraph_carry(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.units(spark, sf).withColumn("text", F.concat("text", F.when(F.col("verse") % 5 == 0, " ¶").otherwise("")))
    return shape.carry_paragraph(rows).select("row_id", "text")


# ---- catalog and grid -----------------------------------------------------------------------------------------------


@query(
    "select b.id, b.module, b.lang_short, l.name as lang_name, coalesce(l.rtl, -1) as rtl, coalesce(copyright_id > 0 and installed = 1, false) as downloadable, coalesce(case when trim(description) <> '' then description end, b.name || case when trim(year) <> '' then ', ' || year else '' end) as statement from bibles b left join languages l on b.lang_short = l.code where enabled = 1"
)
def edition_catalog_join(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.editions(table(spark, sf, "bibles"), table(spark, sf, "languages")).select("id", "module", "lang_short", "lang_name", "rtl", "downloadable", "statement").fillna(-1, ["rtl"])


@query("select id, module from bibles order by (lang_short = 'fr') desc nulls last, name asc nulls last, id limit 25")
def edition_order_float(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.ordered(table(spark, sf, "bibles"), "name", "fr").select("id", "module").limit(25)


@query("select code, name from languages l where exists (select 1 from bibles b where b.lang_short = l.code)")
def languages_in_use(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.used_languages(table(spark, sf, "languages"), table(spark, sf, "bibles")).select("code", "name")


@query("select code, name from languages l where exists (select 1 from books b where b.lang = l.code)")
def languages_with_books(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.languages_with_books(table(spark, sf, "languages"), table(spark, sf, "books")).select("code", "name")


@query(f"with c as (select book, max(chapter) as chapters from verses where module = {_BASE} group by book) select id, name, coalesce(chapters, 0) as chapters from books left join c on id = book where lang = 'en' and id <= 66")
def section_list_with_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "verses")
    counts = stats.chapter_counts(rows.where(F.col("module") == _baseline(spark, sf)))
    return catalog.sections(table(spark, sf, "books").where("lang = 'en'"), counts).select("id", "name", "chapters").fillna(0)


_META = "md5(coalesce(name, '') || chr(31) || coalesce(year, ''))"


@query(f"select id, module, case when id % 4 = 0 then 'missing' when id % 4 = 1 then 'version' else 'metadata' end as reason from bibles where id % 4 < 3 and not (id % 4 = 2 and false)")
def stale_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts derived from the ids: every fourth is missing, of an old version, of old metadata, or current."""
    bibles = table(spark, sf, "bibles").withColumn("meta_hash", catalog.metadata_hash(["name", "year"]))
    kind = F.col("id") % 4
    made = bibles.where(kind > 0).select("module", F.when(kind == 1, "1").otherwise("2").alias("version"), F.when(kind == 2, "old").otherwise(F.col("meta_hash")).alias("meta_hash"))
    return catalog.stale(bibles, made, "2").select("id", "module", "reason")


@query("select distinct module from verses where module not in (select module from bibles where id % 2 = 0)")
def unknown_only_append(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.unknown_only(table(spark, sf, "verses").select("module"), table(spark, sf, "bibles").where("id % 2 = 0"), "module")


@query("select id, module from bibles where coalesce(installed = 1, false) and coalesce(name like '%o%', false) and not coalesce(module like 's%', false) order by id limit 30")
def grid_filter_and(spark: SparkSession, sf: str) -> DataFrame:
    rules = [{"field": "installed", "op": "eq", "data": 1}, {"field": "title", "op": "cn", "data": "o"}, {"field": "module", "op": "bn", "data": "s"}, {"field": "year", "op": "eq", "data": "_no_rest_"}]
    return grid.grid(table(spark, sf, "bibles"), rules, "AND", {"title": "name"}, sort="id").select("id", "module")


@query("select id, case when module in (select min(module) from bibles union select max(module) from bibles) then 0 else enabled end as enabled, installed from bibles")
def edition_flags(spark: SparkSession, sf: str) -> DataFrame:
    bibles = table(spark, sf, "bibles")
    return catalog.flagged(bibles, list(bibles.agg(F.min("module"), F.max("module")).first()), enabled=0).select("id", "enabled", "installed")


@query("select id, module from bibles where (coalesce(lang_short = 'de', false) or coalesce(module like '%1', false)) and enabled = 1 order by name desc nulls last, id limit 30")
def grid_filter_or(spark: SparkSession, sf: str) -> DataFrame:
    rules = [{"field": "lang_short", "op": "eq", "data": "de"}, {"field": "module", "op": "ew", "data": "1"}]
    return grid.grid(table(spark, sf, "bibles"), rules, "or", post=F.col("enabled") == 1, sort="name", descending=True).select("id", "module")


@query(
    """select entered, code, tier from (select q.entered, l.code, case when length(w) = 2 and (lower(code) = w or lower(iso_639_1) = w) then 1 when length(w) = 3 and (lower(iso_639_2) = w or lower(iso_639_2_b) = w) then 2
 when length(w) > 3 and (lower(name) = w or lower(native_name) = w) then 3 end as tier, row_number() over (partition by q.entered order by tier nulls last, code) as k from (select distinct lang as entered, lower(trim(lang)) as w from documents where lang is not null) q, languages l) where k = 1 and tier is not null"""
)
def language_resolver(spark: SparkSession, sf: str) -> DataFrame:
    entered = table(spark, sf, "documents").where("lang is not null").select(F.col("lang").alias("entered"))
    return catalog.resolve_language(entered, table(spark, sf, "languages"))


@query("select lang, string_agg(k || '=' || v, ';' order by k) as attributes from (select lang, 'books' as k, count(*)::varchar as v from books group by lang union all select lang, 'first', min(name) from books group by lang) group by lang")
def attribute_map(spark: SparkSession, sf: str) -> DataFrame:
    books = table(spark, sf, "books")
    eav = books.groupBy("lang").agg(F.count("*").cast("string").alias("books"), F.min("name").alias("first")).select("lang", F.inline(F.array(F.struct(F.lit("books").alias("k"), F.col("books").alias("v")), F.struct(F.lit("first").alias("k"), F.col("first").alias("v")))))
    pairs = F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return catalog.attributes(eav, "lang", "k", "v").select("lang", F.array_join(pairs, ";").alias("attributes"))


@query("select request_id, case when search is null then '{\"reference\":' || to_json(reference) || '}' when reference is null then '{\"search\":' || to_json(search) || '}' else '{\"reference\":' || to_json(reference) || ',\"search\":' || to_json(search) || '}' end as form from passage_requests where (search is not null or reference is not null) and not regexp_matches(coalesce(reference, '') || coalesce(search, ''), '[\\x00-\\x1f\\x7f/]')")
def request_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as canonical JSON with sorted keys, for replay by key."""
    rows = table(spark, sf, "passage_requests").where("search is not null or reference is not null")
    rows = rows.where(~F.concat(F.coalesce("reference", F.lit("")), F.coalesce("search", F.lit(""))).rlike(r"[\x00-\x1f\x7f/]"))
    pairs = F.map_filter(F.create_map(F.lit("search"), F.col("search"), F.lit("reference"), F.col("reference")), lambda k, v: v.isNotNull())
    return rows.select("request_id", T.canonical_json(pairs).alias("form"))


@query("select request_id, '{' || concat_ws(',', '\"reference\":' || to_json(reference), '\"search\":' || to_json(search)) || '}' as form from passage_requests")
def request_cache_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every request as canonical JSON, whatever signs it holds; one that asks for nothing gives ``{}``.

    ``request_cache`` is the part of it that its older SQL states.
    """
    pairs = F.map_filter(F.create_map(F.lit("search"), F.col("search"), F.lit("reference"), F.col("reference")), lambda k, v: v.isNotNull())
    return table(spark, sf, "passage_requests").select("request_id", T.canonical_json(pairs).alias("form"))


@query(
    "with e as (select bible as module, count(*) as n, sum((request_id % 10)::double) as s, max(requested_at) as at from passage_requests where bible is not null group by 1) select id, b.module, id % 5 + coalesce(n, 0) as hits, 1.5 + coalesce(s, 0) as seconds from bibles b left join e on b.module = e.module"
)
def artifact_usage(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "bibles").select("id", "module", (F.col("id") % 5).cast("long").alias("hits"), F.lit(1.5).alias("seconds"), F.lit(None).cast("timestamp_ntz").alias("downloaded_at"))
    events = table(spark, sf, "passage_requests").where("bible is not null").select(F.col("bible").alias("module"), (F.col("request_id") % 10).cast("double").alias("seconds"), F.col("requested_at").alias("at"))
    return catalog.usage(made, events).select("id", "module", "hits", "seconds")


@query("select coalesce(sum(id), 0)::bigint as total from bibles where updated_at is not null or created_at > timestamp '2024-12-01' - interval 2 day")
def live_artifact_size(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "bibles").select(F.col("updated_at").alias("downloaded_at"), F.col("created_at").alias("rendered_at"), F.col("id").cast("long").alias("size"))
    return catalog.live_size(made, F.lit("2024-12-01").cast("timestamp_ntz"))


# ---- changes --------------------------------------------------------------------------------------------------------


@query(f"with {UNITS} select row_id, module, id from units")
def update_or_create(spark: SparkSession, sf: str) -> DataFrame:
    """Loads of verses put into a table that has the others: of each unit the row loaded last stays."""
    rows = table(spark, sf, "verses").select("row_id", "module", "id", "loaded_at")
    held = corpus.latest(rows.where("row_id % 10 <> 0"), ["module", "id"], ["loaded_at", "row_id"])
    return mutate.update_or_create(held, rows.where("row_id % 10 = 0"), ["module", "id"], ["loaded_at", "row_id"]).select("row_id", "module", "id")


@query("select id, module from bibles where id % 2 = 0 union all select min(id), module from bibles where id % 3 = 0 and module not in (select module from bibles where id % 2 = 0) group by module")
def insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "bibles").select("id", "module")
    return mutate.insert_or_ignore(rows.where("id % 2 = 0"), rows.where("id % 3 = 0"), ["module"])


@query("select row_id, module from verses where module in (select module from bibles where id % 2 = 0)")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.cascade_delete(table(spark, sf, "verses").select("row_id", "module"), table(spark, sf, "bibles").where("id % 2 = 0"), "module")


@query("select id from bibles where created_at::date + interval 6 month < date '2024-12-01'")
def month_expiry(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.expired(table(spark, sf, "bibles"), "created_at", F.lit("2024-12-01").cast("timestamp"), 6).select("id")


@query(
    """with a as (select request_id as id, (length(coalesce(reference, '')) + 1)::double as size, requested_at, coalesce(ip_id, 0) as hits from passage_requests where request_id % 17 <> 0),
 ruled as (select * from a where requested_at < timestamp '2024-02-01'), f as (select coalesce(sum(size), 0) as freed from ruled),
 g as (select *, coalesce(sum(size) over (order by size desc, hits asc, id asc rows between unbounded preceding and 1 preceding), 0) as before from a where not requested_at < timestamp '2024-02-01')
 select id, size, 'rule' as reason from ruled union all select id, size, 'space' from g, f where before + freed < (select sum(size) / 2 from a)"""
)
def cache_eviction(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "passage_requests").select(F.col("request_id").alias("id"), (F.length(F.coalesce("reference", F.lit(""))) + 1).cast("double").alias("size"), "requested_at", F.coalesce("ip_id", F.lit(0)).alias("hits"))
    needed = rows.where("id % 17 <> 0").agg(F.sum("size") / 2).first()[0]
    out = mutate.eviction(rows, needed, F.col("id") % 17 == 0, F.col("requested_at") < F.lit("2024-02-01").cast("timestamp_ntz"), [F.col("size").desc(), F.col("hits").asc()])
    return out.select("id", "size", "reason")


# ---- usage limits ---------------------------------------------------------------------------------------------------


@query("select request_id from (select request_id, row_number() over (partition by ip_id, requested_at::date order by requested_at, request_id) as n from passage_requests) where n <= 2")
def daily_quota_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return quota.accepted_requests(table(spark, sf, "passage_requests"), "ip_id", "requested_at", "request_id", 2).select("request_id")


@query("select coalesce(ip_id, -1) as client, requested_at::date::varchar as day, count(*) as hits, least(count(*), 3) as accepted, count(*) >= 3 as limit_reached from passage_requests group by all")
def daily_quota_flags(spark: SparkSession, sf: str) -> DataFrame:
    return quota.daily_usage(table(spark, sf, "passage_requests"), "ip_id", "requested_at", 3).withColumn("day", F.col("day").cast("string")).fillna(-1, ["client"])


@query("select user_id as client, date_trunc('minute', ts) as minute, count(*) as hits, greatest(count(*) - 1, 0) as rejected from events group by all")
def minute_throttle(spark: SparkSession, sf: str) -> DataFrame:
    return quota.throttled(table(spark, sf, "events"), "user_id", "ts", 1)


@query("select event_type as key, user_id as client, ts::date::varchar as day, count(*) as hits from events where event_type <> 'view' group by all")
def hits_by_key_day(spark: SparkSession, sf: str) -> DataFrame:
    log = quota.counted(table(spark, sf, "events"), "event_type", frozenset({"view"}))
    return quota.hits_by_key(log, "event_type", "user_id", "ts").withColumn("day", F.col("day").cast("string"))


@query("select id, case when id % 7 = 0 or id % 11 = 0 then 0 when id % 13 = 0 then -1 else coalesce(case when id % 3 = 0 then id * 10 end, copyright_id, 2000) end::int as day_limit from bibles")
def effective_limit(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    limit = quota.effective_limit(i % 7 == 0, i % 11 == 0, i % 13 == 0, F.when(i % 3 == 0, i * 10), F.col("copyright_id"))
    return table(spark, sf, "bibles").select("id", limit.alias("day_limit"))


@query("select request_id, not (bible is not null and search_type = 'regexp') as allowed from passage_requests where search_type is not null")
def action_permission(spark: SparkSession, sf: str) -> DataFrame:
    allowed = F.when(F.col("bible").isNotNull(), F.array(*[F.lit(x) for x in ("and", "or", "phrase")]))
    return table(spark, sf, "passage_requests").where("search_type is not null").select("request_id", quota.permitted(F.col("search_type"), allowed).alias("allowed"))


@query("select user_id as client, ts::date::varchar as day, count(*) as hits, least(count(*), 5) as accepted, count(*) >= 5 as limit_reached from events group by all")
def stream_daily_quota(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming twin over the events as they are there, in complete mode so that every day is seen."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    daily = stream_quota.daily_usage(stream, "user_id", "ts", 5)
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream_quota.run_complete(daily, f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out").withColumn("day", F.col("day").cast("string"))


# ---- import and export ----------------------------------------------------------------------------------------------


@query("select row_id::int as row_no, book, chapter, verse, text from verses where trim(text) <> '' and not starts_with(trim(text), '=')")
def import_role_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "verses")
    cells = F.array(F.lit("x"), F.concat(F.col("book").cast("string"), F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), F.col("verse").cast("string")), F.coalesce("text", F.lit("")))
    out = importers.role_mapped(rows.select(F.col("row_id").cast("int").alias("row_no"), cells.alias("cells")), ["none", "b c:v", "t"], as_stored=True)
    return out.select("row_no", "book", "chapter", "verse", "text")


@query("select book, chapter, verse, text from verses where text is not null and text <> '' and not contains(text, '|') and not regexp_matches(text, '[\\r\\n]')")
def import_module_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Verses written as module lines and read back."""
    rows = table(spark, sf, "verses").where("text is not null and text <> ''").where(~F.col("text").contains("|") & ~F.col("text").rlike(r"[\r\n]"))
    lines = exports.module_lines(rows).select(F.col("line").alias("value"))
    return importers.delimited_lines(lines, ["book", "chapter", "verse", "text"]).select("book", "chapter", "verse", "text")


@query("select id, case when trim(name, ' ') = '' then null else trim(name, ' ') end as name, installed = 1 as installed, coalesce(copyright_id, -1)::int as copyright_id, null::varchar as missing from bibles")
def typed_csv_map(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "bibles").select(F.col("id").cast("string"), "name", F.when(F.col("installed") == 1, "Yes").otherwise("no").alias("installed"), F.coalesce(F.col("copyright_id").cast("string"), F.lit("")).alias("copyright_id"))
    return importers.dimension_csv(raw, {"id": "int", "name": "string", "installed": "boolstr", "copyright_id": "int", "missing": "string"}, "id").fillna(-1, ["copyright_id"])


@query(f"with {UNITS}, b as (select * from units where module = {_BASE}) select id, book, chapter, verse, 'line ' || id as text from b")
def positional_align(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a file that knows no addresses, as many as the edition has verses."""
    base = corpus.units(spark, sf, text=False, modules=[_baseline(spark, sf)])
    lines = spark.range(1, base.count() + 1).select(F.col("id").alias("line_no"), F.format_string("line %d", "id").alias("text"))
    return importers.positional(lines, base)


@query("select module, v.book, chapter, verse, b.name || ' ' || chapter || ':' || verse || ' ' || coalesce(text, '') as line from verses v join books b on b.id = v.book and b.lang = 'en'")
def export_lines(spark: SparkSession, sf: str) -> DataFrame:
    return exports.machine_lines(exports.with_book_names(stored(spark, sf), table(spark, sf, "books"), "en"))


@query("select row_id, 'INSERT INTO `verses_' || module || '` (`id`, `book`, `chapter`, `verse`, `text`) VALUES (' || id || ', ' || book || ', ' || chapter || ', ' || verse || ', ' || coalesce('''' || replace(replace(text, '\\', '\\\\'), '''', '''''') || '''', 'NULL') || ');' as line from verses")
def export_sql_dump(spark: SparkSession, sf: str) -> DataFrame:
    return exports.sql_lines(table(spark, sf, "verses"), F.concat(F.lit("verses_"), F.col("module")), ["id", "book", "chapter", "verse", "text"], ["row_id"])


@query("select module, v.book, chapter, verse, id || ',' || n || ',' || v.book || ',' || chapter || ',' || verse || ',' || t as line from (select *, case when regexp_matches(coalesce(text, ''), '[\",\\n\\r]') then '\"' || replace(text, '\"', '\"\"') || '\"' else coalesce(text, '') end as t from verses) v join (select id as book, case when regexp_matches(name, '[\",\\n\\r]') then '\"' || replace(name, '\"', '\"\"') || '\"' else name end as n from books where lang = 'en') b on b.book = v.book")
def export_csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    return exports.csv_lines(exports.with_book_names(stored(spark, sf), table(spark, sf, "books"), "en"))


@query("select row_id, case when b.lang_short in ('en', 'es', 'zh') then coalesce(text, '') else trim(regexp_replace(regexp_replace(coalesce(text, ''), '\\{[^}]+\\}', '', 'g'), ' {2,}', ' ', 'g'), ' ') end as text from verses v join bibles b on v.module = b.module")
def export_without_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf).join(table(spark, sf, "bibles").select("module", "lang_short"), "module")
    return rows.select("row_id", exports.without_lexicon(F.col("text"), F.col("lang_short")).alias("text"))


@query("select coalesce(lang_short, '') as lang_short, string_agg(module || coalesce(' - ' || name, ''), chr(10) order by module || coalesce(' - ' || name, '')) as entries from bibles group by 1")
def bundle_index(spark: SparkSession, sf: str) -> DataFrame:
    return exports.bundle_index(table(spark, sf, "bibles").withColumn("lang_short", F.coalesce("lang_short", F.lit(""))))


@query(
    "select 'languages' as tbl, 'INSERT INTO `languages` (`code`, `name`, `rtl`) VALUES (''' || code || ''', ''' || replace(name, '''', '''''') || ''', ' || rtl || ');' as line from languages union all select 'shortcuts', 'INSERT INTO `shortcuts` (`id`, `lang`, `short1`) VALUES (' || id || ', ''' || lang || ''', ' || coalesce('''' || replace(short1, '''', '''''') || '''', 'NULL') || ');' from shortcuts"
)
def export_extras(spark: SparkSession, sf: str) -> DataFrame:
    return exports.extras({"languages": table(spark, sf, "languages").select("code", "name", "rtl"), "shortcuts": table(spark, sf, "shortcuts").select("id", "lang", "short1")})


# ---- several values in one field ------------------------------------------------------------------------------------


@query()
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        split_packed(table(spark, sf, name), key, "reference").select(F.lit(name).alias("tbl"), F.col(key).alias("rec_id"), "item_no", "item")
        for name, key in (("passage_requests", "request_id"), ("shortcuts", "id"))
    ]
    return parts[0].unionByName(parts[1])


# ---- results by passage, catalog with licences, formats there and back -----------------------------------------------

_RESULTS = (
    "r(passage, book, low, high) as (values (1, 19, 1002, 1009), (2, 1, 1000, 1999), (3, 3, 1005, 1005), (4, 40, 0, 999999)),"
    " ends as (select book, max(chapter) as n from verses where module in (select distinct module from (select min(module) as module from verses union select max(module) from verses)) group by book)"
)


@query(
    f"""with {UNITS}, {_RESULTS}, b as (select id, name, shortname from books where lang = 'en'), two as (select u.* from units u where module in (select min(module) from verses union select max(module) from verses)),
 h as (select passage, module, chapter, verse from two u join r on u.book = r.book and chapter_verse between low and high),
 lab as (select passage, string_agg(chapter || ':' || lo || case when lo < hi then ' - ' || hi else '' end, '; ' order by chapter) as label from (select passage, chapter, min(verse) as lo, max(verse) as hi from h group by all) group by passage),
 idx as (select passage, string_agg(chapter || '.' || verse, ',' order by chapter, verse) as verse_index from (select distinct passage, chapter, verse from h) group by passage),
 cnt as (select passage, max(n) as n from (select passage, module, count(*) as n from h group by all) group by passage),
 p(passage, first, final, single, whole) as (values (1, 1, 1, false, false), (2, 1, 1, false, true), (3, 1, 1, true, false), (4, 1, null, false, false))
 select p.passage, b.name as book_name, b.shortname as book_short, label as chapter_verse, idx.verse_index, coalesce(cnt.n, 0)::int as verses_count, single as single_verse,
  case when not single then coalesce(pb.name, '-') || '|' || coalesce(nb.name, '-') || '|' || coalesce(case when first > 1 then b.name || ' ' || (first - 1) else pb.name || ' ' || pe.n end, '-') || '|'
   || coalesce(case when coalesce(final, e.n) < e.n then b.name || ' ' || (coalesce(final, e.n) + 1) else nb.name || ' 1' end, '-') || '|' || coalesce(case when not whole and not coalesce(passage = 4 and e.n = 1, false) then b.name || ' 1' end, '-') end as nav
 from p join r using (passage) join b on b.id = r.book left join b pb on pb.id = r.book - 1 left join b nb on nb.id = r.book + 1 left join ends e on e.book = r.book left join ends pe on pe.book = r.book - 1
 left join lab using (passage) left join idx using (passage) left join cnt using (passage)"""
)
def passage_results(spark: SparkSession, sf: str) -> DataFrame:
    """Requested passages of two editions with label, index and navigation."""
    a, b = table(spark, sf, "verses").agg(F.min("module"), F.max("module")).first()
    rows = Engine(spark, sf).passage_results(Request([a, b], reference="19B 1:2-9; 1B 1; 3B 1:5; 40B 1-"))
    pairs = F.flatten(F.transform(F.map_entries("verse_index"), lambda e: F.transform(e["value"], lambda v: F.concat_ws(".", e["key"], v))))
    nav = F.when(F.col("nav").isNotNull(), F.concat_ws("|", *[F.coalesce(F.col(f"nav.{c}"), F.lit("-")) for c in ("prev_book", "next_book", "prev_chapter", "next_chapter", "cur_chapter")]))
    return rows.select("passage", "book_name", "book_short", "chapter_verse", F.array_join(pairs, ",").alias("verse_index"), F.col("verses_count").cast("int").alias("verses_count"), "single_verse", nav.alias("nav"))


_LICENCES = [(1, "Public domain", "public_domain", None, 1, "Free to use."), (2, "CC BY", "creative_commons", "https://example.org/by", 1, None), (3, "Restricted", "copyrighted", "https://example.org/no", 0, "All rights reserved."), (6, "CC BY-ND", "creative_commons", None, 1, None)]
_LICENCES_SQL = "lic(cid, licence, kind, url, download, says) as (values (1, 'Public domain', 'public_domain', null, 1, 'Free to use.'), (2, 'CC BY', 'creative_commons', 'https://example.org/by', 1, null), (3, 'Restricted', 'copyrighted', 'https://example.org/no', 0, 'All rights reserved.'), (6, 'CC BY-ND', 'creative_commons', null, 1, null))"


@query(
    f"""with {_LICENCES_SQL} select b.id, l.name as lang_name, licence, coalesce(download = 1, false) as downloadable,
 case when kind = 'creative_commons' then coalesce('Copyright © ' || nullif(trim(year, ' '), '') || '. ', '') || 'Licensed under ' || licence || coalesce(': ' || url, '')
  when kind is not null then coalesce(says, '') || coalesce(' Terms: ' || url, '') else description end as statement
 from bibles b left join languages l on b.lang_short = l.code left join lic on cid = b.copyright_id"""
)
def edition_licences(spark: SparkSession, sf: str) -> DataFrame:
    """Every edition with the names of its language and licence, as the grid lists it."""
    licences = spark.createDataFrame(_LICENCES, "id int, name string, type string, url string, download int, statement string")
    return catalog.grid_listing(table(spark, sf, "bibles"), table(spark, sf, "languages"), licences).select("id", "lang_name", "licence", "downloadable", "statement")


@query("select id from bibles left join languages on lang_short = code where enabled = 1 order by native_name asc nulls last, languages.name asc nulls last, id limit 40")
def edition_order_language(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(spark, sf).editions("lang_name|rank|lang_name_english").select("id").limit(40)


@query("with e as (select module, count(*) as hits from (select * from (select *, row_number() over (partition by module, id order by loaded_at desc, row_id desc) as n from verses) where n = 1) where contains(lower(coalesce(text, '')), 'king') and module in (select min(module) from verses union select max(module) from verses) group by module) select module from e where hits >= 1")
def limit_warning(spark: SparkSession, sf: str) -> DataFrame:
    """Editions whose hits fill the greatest result, here of one row each."""
    modules = sorted(set(table(spark, sf, "verses").agg(F.min("module"), F.max("module")).first()))
    from .config import Limits

    hits = Engine(spark, sf, Limits(max_rows=1, max_rows_parallel=1, mixed_languages="always")).limit_reached(Request(modules, search="king"))
    matched = corpus.units(spark, sf, modules=modules).where(lang.column(lang.parse("king").parts[0])).select("module").distinct()
    return hits.where("limit_reached").join(matched, "module", "left_semi").select("module")


@query("select id, try_cast(nullif(regexp_extract(coalesce(year, ''), '(^|[^0-9])(1[0-9]{3}|20[0-9]{2})([^0-9]|$)', 2), '') as int) as year from bibles")
def edition_year(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bibles").select("id", T.year_of(F.col("year")).alias("year"))


@query("select request_id, regexp_replace(reference, '[\\r\\n]+', ' ', 'g') as reference, case when try_cast(trim(search, ' ') as int) > 0 then try_cast(trim(search, ' ') as int) else 30 end as size from passage_requests")
def input_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "passage_requests").select("request_id", T.one_line(F.col("reference")).alias("reference"), T.positive_int(F.col("search"), 30).alias("size"))


@query("select request_id, trim(regexp_replace(regexp_replace(reference, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), '^[;, ]+|[;, ]+$', '', 'g'), ' ') as reference from passage_requests")
def trim_requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "passage_requests").select("request_id", T.trim_request(F.col("reference")).alias("reference"))


@query("select id, round(id * 123457 / 1048576, 1) as mb from bibles")
def megabyte_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bibles").select("id", T.megabytes(F.col("id").cast("long") * 123457).alias("mb"))


@query("select row_id, module from verses where module not in (select min(module) from verses union select max(module) from verses)")
def drop_editions(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.without_editions(table(spark, sf, "verses"), list(table(spark, sf, "verses").agg(F.min("module"), F.max("module")).first())).select("row_id", "module")


@query(f"select row_id, module, case when module = {_BASE} then 'new' else coalesce(text, '') end as text from verses")
def replace_edition(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf).select("row_id", "module", "text")
    return mutate.replace_edition(rows, rows.where(F.col("module") == _baseline(spark, sf)).withColumn("text", F.lit("new")))


@query("select id from bibles where updated_at is null")
def soft_deletion(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.soft_deleted(table(spark, sf, "bibles"), "updated_at").select("id")


@query("select 'bibles' as tbl, id::bigint as id from bibles where not coalesce(created_at::date + interval 6 month < date '2024-12-01', false) union all select 'requests', request_id from passage_requests where not coalesce(requested_at::date + interval 1 month < date '2024-12-01', false) union all select 'shortcuts', id from shortcuts")
def weekly_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    kept = mutate.cleaned_up(
        {"bibles": table(spark, sf, "bibles"), "requests": table(spark, sf, "passage_requests").withColumnRenamed("request_id", "id"), "shortcuts": table(spark, sf, "shortcuts")},
        {"bibles": ("created_at", 6), "requests": ("requested_at", 1)},
        F.lit("2024-12-01").cast("timestamp"),
    )
    out = [t.select(F.lit(k).alias("tbl"), F.col("id").cast("long").alias("id")) for k, t in kept.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    """with f as (select '{' || concat_ws(',', '"reference":' || to_json(reference), '"search":' || to_json(search)) || '}' as form, requested_at, request_id from passage_requests),
 g as (select form, min(requested_at) filter (request_id % 2 = 0) as a, min(requested_at) filter (request_id % 2 = 1) as b from f group by form)
 select substr(sha256(form), 1, 24) as hash, form from g where (a is not null and not a::date + interval 1 month < date '2024-06-01') or b is not null"""
)
def request_cache_store(spark: SparkSession, sf: str) -> DataFrame:
    """A stored cache of the even requests, its run out entries dropped and the odd requests put in."""
    forms = request_cache_all(spark, sf).join(table(spark, sf, "passage_requests").select("request_id", F.col("requested_at").alias("created_at")), "request_id")
    now = F.lit("2024-06-01").cast("timestamp")
    empty = spark.createDataFrame([], "hash string, form string, created_at timestamp_ntz")
    held = mutate.cache_requests(empty, forms.where("request_id % 2 = 0"), now)
    return mutate.cache_requests(held, forms.where("request_id % 2 = 1"), now).select("hash", "form")


@query("select row_id as row_no, v.book, b.name as book_name, chapter, verse, text from verses v join books b on b.id = v.book and b.lang = 'en' where trim(coalesce(text, ''), ' ') <> '' and not starts_with(trim(text, ' '), '=') and not regexp_matches(text, '[\\r\\n]')")
def import_csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Verses written as CSV lines and read back by the roles of the columns; a record is one line, so texts of several lines are no CSV."""
    rows = exports.with_book_names(table(spark, sf, "verses").where(F.trim("text") != "").where(~F.col("text").rlike(r"[\r\n]")), table(spark, sf, "books"), "en")
    lines = exports.csv_lines(rows.withColumn("id", F.col("row_id"))).select(F.regexp_extract("line", "^([0-9]+)", 1).cast("long").alias("row_no"), F.col("line").alias("value"))
    return importers.role_mapped(importers.csv_cells(lines, 6), ["none", "bn", "b", "c", "v", "t"], as_stored=True)


@query("select book, chapter, verse, trim(text, ' ') as text from verses where trim(coalesce(text, ''), ' ') <> '' and not contains(text, chr(9))")
def import_tabbed_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "verses").where(F.trim("text") != "").where(~F.col("text").contains("\t"))
    line = F.concat_ws("\t", F.format_string("%02dO", "book"), F.col("chapter").cast("string"), F.col("verse").cast("string"), F.lit(""), F.col("id").cast("string"), F.col("text"))
    return importers.tabbed_lines(rows.select(line.alias("value")))


@query("select module, book, chapter, verse, 'word ' || id || '{G' || verse || '} [' || chapter || ']' as text from verses v where row_id in (select min(row_id) from verses group by module, book, chapter, verse)")
def import_usfm(spark: SparkSession, sf: str) -> DataFrame:
    """Editions written with markers, a file a book, and read back: words with lexicon numbers, italics, notes and headings."""
    rows = table(spark, sf, "verses").join(table(spark, sf, "verses").groupBy("module", "book", "chapter", "verse").agg(F.min("row_id").alias("row_id")), ["module", "book", "chapter", "verse", "row_id"], "left_semi")
    line = F.format_string('\\v %d \\w word %d|strong="G00%d"\\w* \\add %d\\add*\\f + \\ft note\\f*\n', "verse", "id", "verse", "chapter")
    parts = F.array_sort(F.collect_list(F.struct("verse", line.alias("line"))))
    chapter = rows.groupBy("module", "book", "chapter").agg(F.concat(F.lit("\\c "), F.col("chapter").cast("string"), F.lit("\n\\s1 heading\n"), F.array_join(F.transform(parts, lambda x: x["line"]), "")).alias("body"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "body"))), lambda x: x["body"]), "")
    codes = F.array(*[F.lit(c) for c in importers.USFM_BOOKS])
    files = chapter.groupBy("module", "book").agg(F.concat(F.lit("\\id "), F.element_at(codes, F.col("book")), F.lit("\n\\h x\n"), body).alias("value"))
    files = files.withColumn("book", importers.usfm_book(F.col("value")))
    return importers.usfm(files, ["module"]).select("module", "book", "chapter", "verse", "text")


@query("select id::varchar as id, book::varchar as book, chapter::varchar as chapter, verse::varchar as verse, text from verses where not regexp_matches(coalesce(text, ''), '[\\r\\n]')")
def import_sql_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Verses written as statements of a dump and read back."""
    rows = table(spark, sf, "verses").where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[\r\n]"))
    columns = ["id", "book", "chapter", "verse", "text"]
    return importers.sql_rows(exports.sql_lines(rows, F.lit("verses"), columns).select(F.col("line").alias("value")), "verses", columns)


@query("select id, name as root_word, shortname as transliteration, lang_short as pronunciation, 'of ' || module || ' x' as definition from bibles where name is not null and shortname is not null and lang_short is not null and not regexp_matches(name || shortname || lang_short, '[<>]') and name = trim(name) and shortname = trim(shortname) and lang_short = trim(lang_short)")
def import_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "bibles").where("name is not null and shortname is not null and lang_short is not null").where(~F.concat("name", "shortname", "lang_short").rlike("[<>]")).where("name = trim(name) and shortname = trim(shortname) and lang_short = trim(lang_short)")
    entry = F.concat(F.lit("<b>"), "name", F.lit("</b><br>"), "shortname", F.lit("<br/>"), "lang_short", F.lit("<BR />of <i>"), "module", F.lit("</i><br>x"))
    return importers.lexicon_entries(rows.select(F.col("id").alias("number"), entry.alias("entry"))).select(F.col("number").alias("id"), "root_word", "transliteration", "pronunciation", "definition")


@query(r"with " + STORED + r" select row_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\{[^}]*\}', '', 'g') || ' [so]{H7}', '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ([?,.!:;])', '\1', 'g'), ' ') as text from stored where not regexp_matches(text, '[<>¶()]')")
def import_markup(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a foreign format's tags in the corpus's markup."""
    rows = stored(spark, sf).where(~F.col("text").rlike(r"[<>¶()]")).withColumn("text", F.concat(F.regexp_replace("text", r"\{[^}]*\}", ""), F.lit(" <i>so</i><WH07><br>")))
    return rows.select("row_id", T.import_text(F.col("text"), italics=("<i>", "</i>")).alias("text"))


@query("select row_id, 'b' || verse || ' c' as note from verses")
def lexicon_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Grammar notes without their leading counts."""
    note = F.format_string("<b>Count:</b> %d times<br>b%d c", "verse", "verse")
    return table(spark, sf, "verses").select("row_id", T.without_counts(note).alias("note"))


@query("select id from bibles b where not exists (select 1 from bibles o where o.shortname = b.shortname and o.id <> b.id) and shortname is not null")
def unique_values(spark: SparkSession, sf: str) -> DataFrame:
    return grid.unshared(table(spark, sf, "bibles"), "shortname", "id").select("id")
