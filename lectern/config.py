"""Limits and policies of the engine, as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Limits:
    page_size: int = 30
    max_rows: int = 500  # one edition
    max_rows_parallel: int = 2000  # each of several editions
    context: int = 5  # verses around a looked-up verse
    proximity: int = 5
    daily_hits: int = 2000
    per_minute: int = 60
    scoped_books: frozenset[int] = frozenset({19})  # books whose chapters are units of their own: nearness never crosses them
    free_actions: frozenset[str] = frozenset({"statics", "version", "readcache"})
    common_words: str = "exact"  # always | never | exact (reject a search only if all of its words are common)
    mixed_languages: str = "search_type"  # always | search_type | never
    default_language: str = "en"  # of book names that no asked language knows


@dataclass(frozen=True)
class SearchType:
    name: str
    boolean: bool = False
    many_languages: bool = True
    aliases: frozenset[str] = field(default_factory=frozenset)


# Names, aliases and permissions of the search types.
SEARCH_TYPES = [
    SearchType("and", aliases=frozenset({"all_words", "all"})),
    SearchType("or", aliases=frozenset({"any_word", "any"})),
    SearchType("xor", aliases=frozenset({"one_word", "one"})),
    SearchType("two_or_more"),
    SearchType("keyword_limit"),
    SearchType("phrase"),
    SearchType("regexp"),
    SearchType("not", aliases=frozenset({"none"})),
    SearchType("boolean", boolean=True),
    SearchType("proximity", many_languages=False),
    SearchType("chapter", many_languages=False),
    SearchType("book", many_languages=False),
]


def search_type(name: str | None) -> SearchType:
    """The search type of a name or alias; nothing means ``and``, an unknown name is an error."""
    key = (name or "and").strip().lower()
    for t in SEARCH_TYPES:
        if key == t.name or key in t.aliases:
            return t
    raise ValueError(f"unknown search type: {name}")
