"""The engine: requests in, one plan out."""

from __future__ import annotations

import hashlib
import json
import re
import secrets
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus
from .config import Limits, search_type
from .functions.text import highlight, strip_markup
from .operators import catalog, parallel, shape, stats
from .plans import proximity, refs
from .plans import search as lang


class RequestError(ValueError):
    """A request that contradicts itself or can't be understood; ``level`` says how grave (1 to 5)."""

    def __init__(self, message: str, level: int = 4):
        super().__init__(message)
        self.level = level


@dataclass
class Request:
    """What a user asks for. ``request`` is undecided text that is either a reference or a search."""

    modules: list[str]
    reference: str = ""
    search: str = ""
    request: str = ""
    search_type: str = "and"
    limit: int | None = None  # k of keyword_limit, or the distance of proximity
    whole_words: bool = False
    exact_case: bool = False
    advanced: dict[str, str] = field(default_factory=dict)
    page: int = 1
    page_size: int | None = None
    page_all: bool = False
    context: bool = False
    markup: str = "none"  # raw keeps the markup
    highlight: bool = False
    highlight_tag: str = "b"
    lang: str = "en"
    seed: int | None = None  # of random references; none draws one


class Engine:
    """Compiles requests over a folder of tables into plans.

    Only small reads of dimensions run before the caller acts on a result: the section list and the shortcuts of the
    request's languages, the languages of the editions asked for, and the addresses of verse ids or random places in a reference.
    """

    def __init__(self, spark: SparkSession, root: str, limits: Limits | None = None, common_words: frozenset[str] | dict[str, frozenset[str]] = frozenset()):
        """``common_words`` may be of all languages, or by language."""
        self.spark, self.root, self.limits, self.common_words = spark, root, limits or Limits(), common_words

    @cached_property
    def units(self) -> DataFrame:
        """The current units of all editions."""
        return corpus.units(self.spark, self.root)

    def _units(self, modules: list[str], inside: Column | None = None, text: bool = True) -> DataFrame:
        return corpus.units(self.spark, self.root, text, modules, inside)

    def common(self, lang_: str) -> frozenset[str]:
        """Common words of the named languages (``en,fr``)."""
        if isinstance(self.common_words, dict):
            return frozenset().union(*(self.common_words.get(x.strip(), frozenset()) for x in lang_.split(",")))
        return self.common_words

    def table(self, name: str) -> DataFrame:
        return corpus.table(self.spark, self.root, name)

    def _route(self, r: Request) -> tuple[str, str]:
        """(reference, search) of a request; an undecided text goes one way or the other.

        Beside a search it is the reference; beside a reference it is the better reference if it is one, else the search.
        """
        given = (r.reference.strip(" ;,."), r.search.strip(), r.request.strip(" ;,."))
        if all(given):
            raise RequestError("a reference, a search and undecided text can't be asked for together")
        if not any(given) and not any(v.strip() for v in r.advanced.values()):
            raise RequestError("nothing was asked for")
        if not given[2]:
            return r.reference, r.search
        if given[1]:
            return r.request, r.search
        is_reference = refs.random_kind(r.request) is not None or refs.is_reference(r.request, self.resolver(r.lang))
        if given[0]:
            return (r.request, "") if is_reference else (r.reference, r.request)
        return (r.request, "") if is_reference else ("", r.request)

    def resolver(self, lang_: str, loose: bool = False):
        """Book names of one language, or of several (``en,fr``): the first that knows a name decides, in the end the default language.

        Ids agree over languages, so a book that another language knew is the book of that id in the first.
        """
        names = dict.fromkeys([*(x.strip() for x in lang_.split(",")), self.limits.default_language])
        each = [catalog.book_resolver(self.table("books"), x, self.common(x) | catalog.COMMON if loose else self.common(x), loose) for x in names]

        def resolve(name: str) -> int | None:
            return next((b for b in (f(name) for f in each) if b is not None), None)

        return resolve

    def disambiguation(self, request: str, lang_: str = "en") -> DataFrame:
        """Books that a text searched as keywords may have meant, by prefix."""
        want = F.lit(request.strip().lower())
        names = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "shortname", "matching1", "matching2")]
        hit = names[0].startswith(want) | names[1].startswith(want) | names[2].startswith(want) | names[3].startswith(want)
        return self.table("books").where((F.col("lang") == lang_) & hit & (F.length(want) > 0)).select("id", "name").orderBy("id")

    def verse_address(self, text: str, module: str):
        """Addresses of the verse ids in a reference (``123V``) by the numbers of one edition, as a function; as many rows as ids are read."""
        ids = [int(x) for x in re.findall(r"(?<!\d)(\d{1,9})V(?!\w)", text)]
        rows = self._units([module], text=False).where(F.col("id").isin(*ids)).select("id", "book", "chapter", "verse").collect() if ids else []
        return {r.id: (r.book, r.chapter, r.verse) for r in rows}.get

    def random_reference(self, module: str, kind: str, seed: int | None = None) -> str:
        """The reference of a random book, chapter or verse of an edition; the same seed gives the same."""
        r = parallel.random_unit(corpus.table(self.spark, self.root, "verses").where(F.col("module") == module), secrets.randbits(31) if seed is None else seed, kind).first()
        if r is None:
            raise RequestError(f"no such edition: {module}")
        return f"{r.book}B 0-" if kind == "book" else f"{r.book}B {r.chapter}" + (f":{r.verse}" if kind == "verse" else "")

    def passages(self, text: str, lang_: str, searching: bool = False, module: str | None = None, seed: int | None = None) -> list[refs.Passage]:
        """Passages of a reference; an unknown book is an error. Verse ids and random places are looked up in ``module``."""
        kind = refs.random_kind(text)
        if kind and module:
            text = self.random_reference(module, kind, seed)
        address = self.verse_address(text, module) if module else None
        found = refs.parse_references(text, self.resolver(lang_), catalog.shortcut_map(self.table("shortcuts"), lang_), default_chapter=not searching, verse_address=address)
        if any(p.book is None for p in found):  # only those are looked up loosely, so that known books stay as they are
            loosely = self.resolver(lang_, loose=True)
            found = [q for p in found for q in ([p] if p.book is not None else refs.parse_references(p.text, loosely, default_chapter=not searching))]
        unknown = [p.text for p in found if p.book is None]
        if unknown:
            raise RequestError("no such book: " + ", ".join(unknown))
        return found

    def _languages(self, r: Request) -> None:
        """Refuse editions of several languages where the policy or the search type wants one."""
        policy, kind = self.limits.mixed_languages, search_type(r.search_type)
        if len(r.modules) < 2 or policy == "always" or (policy == "search_type" and kind.many_languages):
            return
        # the catalog's rows of the asked editions
        n = self.table("bibles").where(F.col("module").isin(r.modules)).select("lang_short").distinct().limit(2).count()
        if n > 1:
            raise RequestError("these editions are in several languages")

    def hits(self, r: Request) -> DataFrame:
        """Units that a request finds, in the layout of ``corpus.units``, unordered; over several editions aligned, with ``unmatched``."""
        reference, text = self._route(r)
        searching = bool(text or r.advanced)
        inside: Column | None = None
        if reference:
            found = self.passages(reference, r.lang, searching, r.modules[0], r.seed)
            if r.context and not searching:
                found = [refs.with_context(p, self.limits.context) for p in found]
            inside = refs.predicate(found)
        if not searching:
            return self._units(r.modules, inside).withColumn("unmatched", F.lit(False))
        self._languages(r)
        how = {"whole_words": r.whole_words, "exact_case": r.exact_case}
        if text:
            lang.misplaced(text, r.search_type)
            tree = lang.parse(text, r.search_type, r.limit)
            lang.stop_words(tree, set(self.common(r.lang)), self.limits.common_words)
            if tree.hops:
                rows = self._units(r.modules)  # a passage doesn't hold the terms between, so it prunes nothing
                found_rows = proximity.chain(rows, tree, inside, r.limit or self.limits.proximity, self.limits.scoped_books, **how)
                if r.advanced:
                    found_rows = found_rows.where(lang.advanced(r.advanced, **how))
                if len(r.modules) == 1:
                    return found_rows.withColumn("unmatched", F.lit(False))
                keys = found_rows.select("module", "id").distinct().withColumn("_hit", F.lit(True))
                return parallel.aligned(rows.join(keys, ["module", "id"], "left"), F.col("_hit")).drop("_hit")
            test = lang.column(tree.parts[0], **how)
            if r.advanced:
                test = test & lang.advanced(r.advanced, **how)
        else:
            test = lang.advanced(r.advanced, **how)
        rows = self._units(r.modules, inside)
        if len(r.modules) == 1:
            return rows.where(test).withColumn("unmatched", F.lit(False))
        return parallel.aligned(rows, test)

    def query(self, r: Request) -> DataFrame:
        """A page of a request's result in canonical order, with markup stripped and terms highlighted as asked."""
        rows = self.hits(r)
        text = F.col("text") if r.markup == "raw" else strip_markup(F.col("text"))
        _, search = self._route(r)
        if r.highlight and search:
            tree = lang.parse(search, r.search_type, r.limit)
            words, phrases = ([t.text for t in lang.terms(tree) if t.kind == kind] for kind in ("word", "phrase"))
            marked = highlight(text, words, r.highlight_tag, r.whole_words, r.exact_case, phrases)
            text = F.when(F.col("unmatched"), text).otherwise(marked)
        rows = rows.withColumn("text", text)
        order = ["book", "chapter", "verse", "module", "id"]
        if r.page_all:
            most = self.limits.max_rows if len(r.modules) == 1 else self.limits.max_rows_parallel
            return parallel.first_of_each(rows, ["module"], order, most).orderBy(*order)
        return parallel.page(rows, order, r.page, r.page_size or self.limits.page_size, self.limits.max_rows)

    def paging(self, r: Request) -> DataFrame:
        return parallel.envelope(self.hits(r), r.page, r.page_size or self.limits.page_size, self.limits.max_rows)

    def result_list(self, r: Request) -> DataFrame:
        return parallel.result_list(self.hits(r), r.page, r.page_size or self.limits.page_size)

    def limit_reached(self, r: Request) -> DataFrame:
        """``module, hits, limit_reached``: whether the hits of an edition fill the greatest result, so that some may be missing."""
        most = self.limits.max_rows if len(r.modules) == 1 else self.limits.max_rows_parallel
        return self.hits(r).groupBy("module").agg(F.count("*").alias("hits")).withColumn("limit_reached", F.col("hits") >= most)

    def _found(self, r: Request) -> tuple[list[refs.Passage], DataFrame]:
        found = self.passages(self._route(r)[0], r.lang, module=r.modules[0], seed=r.seed)
        return found, self.spark.createDataFrame(refs.Ranges.of(found).rows, "passage int, book int, low int, high int")

    def by_passage(self, r: Request) -> DataFrame:
        """A lookup grouped by requested passage and edition."""
        found, ranges = self._found(r)
        return shape.by_passage(self._units(r.modules, refs.predicate(found)), ranges)

    def passage_results(self, r: Request, verbose: bool = True) -> DataFrame:
        """A row a requested passage: names, label, verse index, verses by edition and navigation, with names of books if ``verbose``."""
        found, ranges = self._found(r)
        # a section list, and the chapters of its books
        books = catalog.rows_of_dimension(self.table("books").where(F.col("lang") == r.lang.split(",")[0].strip()), catalog.MOST_BOOKS, "books of one language")
        ends = self.table("verses").where(F.col("module").isin(*r.modules)).groupBy("book").agg(F.max("chapter").alias("n"))
        last = {x.book: x.n for x in catalog.rows_of_dimension(ends, catalog.MOST_BOOKS, "books of one edition")}
        asked = refs.described(found, {x.id: (x.name, x.shortname) for x in books}, last, verbose)
        return shape.passage_results(self._units(r.modules, refs.predicate(found)), ranges, self.spark.createDataFrame(asked, refs.DESCRIBED))

    def statistics(self, reference: str, modules: list[str], lang_: str = "en") -> DataFrame:
        p = self.passages(reference, lang_)[0]
        chapter = p.chapters()[0] or 1
        return stats.statistics(self._units(modules, text=False), refs.predicate([p]), p.book or 0, chapter)

    def editions(self, order: str = "lang_name|name", first_language: str | None = None, licences: DataFrame | None = None) -> DataFrame:
        return catalog.ordered(catalog.editions(self.table("bibles"), self.table("languages"), licences=licences), order, first_language)

    def books(self, lang_: str, module: str) -> DataFrame:
        counts = stats.chapter_counts(self._units([module], text=False))
        return catalog.sections(self.table("books").where(F.col("lang") == lang_), counts)

    def self_test(self, module: str, references: list[str], lang_: str = "en") -> DataFrame:
        """``reference, found``: how many verses an edition has for each of some references; it works if any has some."""
        rows = []
        for k, text in enumerate(references):
            rows += [(k, text, *x[1:]) for x in refs.Ranges.of(self.passages(text, lang_, module=module)).rows]
        ranges = self.spark.createDataFrame(rows, "passage int, reference string, book int, low int, high int")
        units = self._units([module], text=False)
        found = stats.claimed(units, ranges).groupBy("passage").agg(F.count("*").alias("found"))
        return ranges.select("passage", "reference").distinct().join(found, "passage", "left").select("reference", F.coalesce("found", F.lit(0)).alias("found"))

    def lexicon(self, text: str, definitions: DataFrame) -> DataFrame:
        """Definitions of the lexicon numbers in a text; ``definitions`` has number and definition."""
        asked = self.spark.createDataFrame([(text,)], "text string")
        return catalog.lexicon_lookup(asked, "text", definitions)

    def cached(self, r: Request) -> tuple[str, str]:
        """Key and canonical JSON of a request without its page, for replay."""
        form = {k: v for k, v in sorted(vars(r).items()) if k not in ("page", "page_size", "page_all") and v not in ("", None, False, {}, [])}
        text = json.dumps(form, sort_keys=True, ensure_ascii=False)
        return hashlib.sha256(text.encode()).hexdigest()[:24], text

    def replay(self, text: str, page: int = 1) -> DataFrame:
        """Run a cached request again, at another page."""
        return self.query(Request(**(json.loads(text) | {"page": page})))

    def action(self, name: str, allowed: frozenset[str] | None = None, **arguments) -> DataFrame:
        """An action by its public name; ``allowed`` are the actions of the caller's access level."""
        actions = {
            "query": self.query, "passages": self.passage_results, "bibles": self.editions, "books": self.books, "statistics": self.statistics, "statics_changed": self.changed,
            "readcache": self.replay, "strongs": self.lexicon, "shortcuts": lambda lang_="en": self.table("shortcuts").where(F.col("lang") == lang_),
            "languages": lambda: catalog.used_languages(self.table("languages"), self.table("bibles")),
        }
        if name not in actions:
            raise RequestError(f"no such action: {name}", 4)
        if allowed is not None and name not in allowed:
            raise RequestError(f"action not permitted: {name}", 5)
        return actions[name](**arguments)

    def changed(self) -> DataFrame:
        """When any of the static tables last changed."""
        a = self.table("bibles").agg(F.max(F.greatest("created_at", F.coalesce("updated_at", "created_at"))).alias("t"))
        b = self.table("verses").agg(F.max("loaded_at").alias("t"))
        return a.unionByName(b).agg(F.max("t").alias("changed_at"))
