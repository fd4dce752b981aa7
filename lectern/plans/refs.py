"""The passage-reference language: text to passages, passages to predicates.

A reference names a book and, after it, chapters and verses: ``c``, ``c:v``, ``c:v-v``, ``c:v-c:v``, ``c-c``, lists, and
ranges left open at either end. Parsing is plain Python on the driver; nothing here touches data.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Item:
    """Verses from (c0, v0) to (c1, v1); a missing bound is open. A single chapter or verse has equal ends."""

    c0: int | None
    v0: int | None
    c1: int | None
    v1: int | None
    single: bool = False

    def bounds(self) -> tuple[int, int]:
        """The range of chapter*1000+verse that it covers."""
        low = (self.c0 or 0) * 1000 + (self.v0 or 0)
        high = (999 if self.c1 is None else self.c1) * 1000 + (999 if self.v1 is None else self.v1)
        return low, high


@dataclass(frozen=True)
class Passage:
    book: int | None
    items: tuple[Item, ...] = ()
    book_end: int | None = None  # of a range of books
    text: str = ""

    @property
    def whole_book(self) -> bool:
        return not self.items

    def chapters(self) -> tuple[int | None, int | None]:
        """Least and greatest chapter named."""
        named: list[int | None] = []
        for x in self.items:
            # an open start counts as named only where verses are given
            named += [x.c0] if x.single or x.c0 is not None or x.v1 is not None else []
            named += [] if x.c1 is None else [x.c1]
        if not named:
            return 1, None
        return (None if None in named else min(named)), max(x for x in named if x is not None)


def split_references(text: str) -> list[tuple[str, str]]:
    """(book, chapters and verses) of each reference in a list, in order."""
    out, start = [], 0
    token = re.compile(r"[,;]")
    cuts = [m.start() for m in token.finditer(text)]
    pieces = []
    for at in [*cuts, len(text)]:
        piece = text[start:at]
        # a piece whose rest has letters opens a book; one of numbers only goes on with the book before
        if pieces and not re.search(r"[^\W\d_]", piece):
            pieces[-1] += text[start - 1] + piece
        else:
            pieces.append(piece)
        start = at + 1
    for piece in pieces:
        piece = piece.strip(" .,;")
        if not piece:
            continue
        last = max((m.end() for m in re.finditer(r"[^\d\s:,;\-]", piece)), default=0)
        out.append((piece[:last].strip(" .,;"), piece[last:].strip(" .,;")))
    return out


def parse_verses(text: str, default_chapter: bool = True) -> list[Item]:
    """The items of a chapter-and-verse part.

    Without any chapter a lookup means chapter 1 (``default_chapter``), a search the whole book (no items). A list
    inherits the chapter before it. In ``4:19-5`` the 5 is a chapter, as it lies before the start verse and behind the
    start chapter.
    """
    clean = re.sub(r"\s+", "", text).replace(";", ",")
    clean = re.sub(r"([,\-:])\1+", r"\1", clean).strip(",")
    if not re.search(r"\d", clean):
        return [Item(1, None, 1, None, True)] if default_chapter else []
    verses = ":" in clean
    items: list[Item] = []
    chapter: int | None = None

    def number(x: str) -> int | None:
        return int(x) if x else None

    for part in clean.split(","):
        if not part:
            continue
        left, dash, right = part.partition("-")
        lc, colon, lv = left.partition(":")
        if not verses:
            if dash:
                items.append(Item(number(left), None, number(right), None))
            else:
                items.append(Item(int(left), None, int(left), None, True))
            continue
        if colon:
            chapter, verse = number(lc), number(lv)
        elif chapter is None:
            chapter, verse = number(lc), None
        else:
            verse = number(lc)
        if not dash:
            items.append(Item(chapter, verse, chapter, verse, True))
            if verse is None and not colon:
                chapter = None  # a bare chapter doesn't scope what follows
            continue
        rc, rcolon, rv = right.partition(":")
        if not right:
            if colon and verse is None:  # "14:-" is the chapter
                items.append(Item(chapter, None, chapter, None, True))
            elif verse is None:
                items.append(Item(chapter, None, None, None))
                chapter = None
            else:
                items.append(Item(chapter, verse, chapter, None))
        elif right == ":":
            items.append(Item(chapter, verse, None, None))
        elif rcolon:
            items.append(Item(chapter, verse, int(rc), number(rv)))
            chapter = int(rc)
        else:
            end = int(rc)
            if chapter is None or verse is None:
                # "-3" or "2-3" among verses: whole chapters
                items.append(Item(chapter, verse, end, None) if chapter is None or not colon else Item(chapter, None, chapter, end))
            elif end < verse and end > chapter:
                items.append(Item(chapter, verse, end, None))
            else:
                items.append(Item(chapter, verse, chapter, end))
    return items


Resolver = Callable[[str], int | None]


def parse_references(text: str, resolve: Resolver, shortcuts: dict[str, str] | None = None, default_chapter: bool = True, verse_address: Callable[[int], tuple[int, int, int] | None] | None = None) -> list[Passage]:
    """Passages of a reference list; what no book is found for has ``book`` None.

    ``shortcuts`` maps lower-case aliases to references, ``verse_address`` an id (written ``123V``) to its address. A
    range of books is written ``Book - Book``.
    """
    aliases = shortcuts or {}
    out: list[Passage] = []
    text = re.sub(r"\s*\n\s*", ";", text.strip())
    if verse_address:
        text = _with_addresses(text, verse_address)
    for book, verses in [(text, "")] if text.lower() in aliases else split_references(text):
        if not verses and book.lower() in aliases:
            out += parse_references(aliases[book.lower()], resolve, None, default_chapter, verse_address)
            continue
        first, dash, last = book.partition(" - ") if " - " in book else book.partition("-")
        ends = resolve(first.strip()) if dash else None, resolve(last.strip()) if dash else None
        if None not in ends and not verses:
            out.append(Passage(ends[0], (), ends[1], book))
        else:
            out.append(Passage(resolve(book), tuple(parse_verses(verses, default_chapter)), None, f"{book} {verses}".strip()))
    return out


def _with_addresses(text: str, verse_address: Callable[[int], tuple[int, int, int] | None]) -> str:
    """Verse ids (``123V``, ``-123V``) replaced by ``<book>B c:v``."""
    last: list[int | None] = [None]

    def one(m: re.Match) -> str:
        at = verse_address(int(m.group(2)))
        if at is None:
            last[0] = None
            return m.group()
        name = "" if last[0] == at[0] else f"{at[0]}B "
        last[0] = at[0]
        return ("-" if m.group(1) else "") + f"{name}{at[1]}:{at[2]}"

    return re.sub(r"(-\s*)?([0-9]{1,9})V", one, text)


def predicate(passages: list[Passage], book: str = "book", chapter_verse: str = "chapter_verse") -> Column:
    """Rows in any of the passages. Passages without a known book match nothing; an empty list matches nothing.

    Address bounds are plain comparisons, so they reach the parquet scan.
    """
    parts = []
    for p in passages:
        if p.book is None:
            continue
        here = F.col(book).between(p.book, p.book_end) if p.book_end else F.col(book) == p.book
        if p.items:
            ranges = [F.col(chapter_verse) == low if low == high else F.col(chapter_verse).between(low, high) for low, high in (x.bounds() for x in p.items)]
            here = here & reduce(lambda a, b: a | b, ranges)
        parts.append(here)
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


@dataclass
class Ranges:
    """Passages as rows (passage number, book, bounds), for lists too long for a predicate."""

    rows: list[tuple[int, int, int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, passages: list[Passage]) -> "Ranges":
        rows = []
        for k, p in enumerate(passages, 1):
            if p.book is None:
                continue
            for b in range(p.book, (p.book_end or p.book) + 1):
                rows += [(k, b, *x.bounds()) for x in (p.items or (Item(None, None, None, None),))]
        return cls(rows)


def exploded(p: Passage, last_chapter: Callable[[int], int]) -> list[Passage]:
    """A passage by book and chapter: a range of books gives a passage for each chapter of each."""
    out = []
    for b in range(p.book or 0, (p.book_end or p.book or 0) + 1):
        for c in range(1, last_chapter(b) + 1):
            parts = tuple(_within(x, c) for x in p.items if (x.c0 or 0) <= c <= (999 if x.c1 is None else x.c1)) if p.items else (Item(c, None, c, None, True),)
            if parts:
                out.append(Passage(b, parts, None, p.text))
    return out


def _within(x: Item, chapter: int) -> Item:
    low = x.v0 if x.c0 == chapter else None
    high = x.v1 if x.c1 == chapter else None
    return Item(chapter, low, chapter, high, low == high)


def random_kind(text: str) -> str | None:
    """``book``, ``chapter`` or ``verse`` if a reference asks for a random one (``Random Chapter``)."""
    m = re.match(r"random[ _](book|chapter|verse)", text.strip().lower())
    return m.group(1) if m else None


_NAV = ("pb", "nb", "pcb", "pcc", "ncb", "ncc", "ccb", "ccc")
_NAMED = ("prev_book", "next_book", "prev_chapter", "next_chapter", "cur_chapter")
#: Columns of ``described``.
DESCRIBED = (
    "passage int, book_id int, book_name string, book_short string, raw string, single_verse boolean, "
    f"nav struct<{', '.join([f'{k}: int' for k in _NAV] + [f'{k}: string' for k in _NAMED])}>"
)


def navigation(p: Passage, names: dict[int, tuple[str, str]], last: dict[int, int], verbose: bool = True) -> dict[str, int | str | None] | None:
    """Book and chapter before and behind a passage, over the ends of books; null at the ends of the canon and for a single verse.

    The current chapter is given only if a part of it was asked for. ``names`` are the section list's, ``last`` the chapters
    of each book; ``verbose`` adds names.
    """
    if _single(p):
        return None
    first, end = p.chapters()
    first, final = first or 1, last.get(p.book)
    end = final if end is None or any(x.c1 is None for x in p.items) else end
    before, behind = p.book - 1 or None, p.book + 1 if p.book < max(names, default=66) else None
    whole = all(x.v0 is None and x.v1 is None for x in p.items) and first == end
    inner = end is not None and final is not None and end < final
    nav: dict[str, int | str | None] = dict.fromkeys(_NAV + _NAMED)
    nav |= {"pb": before, "nb": behind, "ncb": p.book if inner else behind, "ncc": end + 1 if inner else behind and 1}
    nav |= {"pcb": p.book if first > 1 else before, "pcc": first - 1 if first > 1 else last.get(before)}
    if not whole:
        nav |= {"ccb": p.book, "ccc": first}
    if verbose:
        name = lambda b: names.get(b, (None, None))[0]
        nav |= {"prev_book": name(before), "next_book": name(behind)}
        for k, c in (("prev", "p"), ("next", "n"), ("cur", "c")):
            book, chapter = nav[f"{c}cb"], nav[f"{c}cc"]
            nav[f"{k}_chapter"] = f"{name(book)} {chapter}" if name(book) and chapter else None
    return nav


def _single(p: Passage) -> bool:
    return len(p.items) == 1 and p.items[0].single and p.items[0].v0 is not None


def described(passages: list[Passage], names: dict[int, tuple[str, str]], last: dict[int, int], verbose: bool = True) -> list[tuple]:
    """What a result tells of each passage besides its verses."""
    rows = []
    for k, p in enumerate(passages, 1):
        ends = [names.get(b, (None, None)) for b in (p.book, p.book_end) if b is not None]
        long, short = (" - ".join(x[j] for x in ends if x[j]) for j in (0, 1))
        nav = navigation(p, names, last, verbose)
        rows.append((k, p.book, long, short, p.text, _single(p), nav and tuple(nav[c] for c in _NAV + _NAMED)))
    return rows


def at_addresses(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """Units at any of the addresses in ``wanted`` (``bcv``), of every edition."""
    return units.join(wanted.select("bcv").distinct(), "bcv", "left_semi")


def with_context(p: Passage, around: int = 5) -> Passage:
    """A single verse widened to its neighbours in the chapter; anything else stays."""
    if len(p.items) != 1 or not p.items[0].single or p.items[0].v0 is None:
        return p
    x = p.items[0]
    return Passage(p.book, (Item(x.c0, max(1, x.v0 - around), x.c1, x.v0 + around),), p.book_end, p.text)


def is_reference(text: str, resolve: Resolver) -> bool:
    """Whether an undecided request is a reference: it has digits or several passages of known books, and no operator."""
    if re.search(r"[()|&!^~\"`%*{}\[\]]|\b(?:AND|OR|XOR|NOT|PROX|PROC|CHAP|BOOK)\b|\b[GH]\d+", text):
        return False
    parts = split_references(text)
    if not parts or not (re.search(r"\d", text) or len(parts) > 1):
        return False
    return all(resolve(book) is not None for book, _ in parts)
