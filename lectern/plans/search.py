"""The search language: text to a syntax tree, the tree to one Column.

Terms are words, ``"phrases"`` and `` `regular expressions` ``. Operators, upper case only: ``AND && &``, ``OR || |``,
``XOR ^^ ^``, ``NOT !`` (a ``-`` before a word is NOT too; inside a word it is part of the word), parentheses; words side
by side are joined by AND. Precedence: NOT, AND, XOR, OR. Proximity operators bind loosest and never stand inside
parentheses: ``~`` or ``PROX(n)``, ``PROC(n)``/``PROXC(n)``, ``CHAP``/``CHAPTER``, ``BOOK``. ``%`` or ``*`` is a wildcard.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import search_type
from ..functions.text import LETTER, fold, fold_text, literal


class SearchError(ValueError):
    """A search that can't be understood; the message says why."""


@dataclass(frozen=True)
class Term:
    text: str
    kind: str = "word"  # word | phrase | regexp


@dataclass(frozen=True)
class Op:
    """AND, OR, XOR over two or more parts, NOT over one, or at least ``k`` of the parts."""

    name: str
    parts: tuple
    k: int = 0


Node = Term | Op


@dataclass(frozen=True)
class Hop:
    kind: str  # prox | proc | chap | book
    distance: int | None = None


@dataclass(frozen=True)
class Search:
    """A chain of expressions with a hop between each two; usually one expression."""

    parts: tuple[Node, ...]
    hops: tuple[Hop, ...] = ()


TOKEN = re.compile(
    r"""\s*(?:
    "(?P<phrase>[^"]*)" | `(?P<regexp>[^`]*)`
  | (?P<hop>~p|~l|~c|~b|~|PROXC|PROX|PROC|CHAPTER|CHAP|BOOK)(?![\w])(?:\((?P<n>\d+)\))?
  | (?P<and>AND(?!\w)|&&?) | (?P<or>OR(?!\w)|\|\|?) | (?P<xor>XOR(?!\w)|\^\^?) | (?P<not>NOT(?!\w)|!|-(?=[\w("`]))
  | (?P<open>\() | (?P<close>\))
  | (?P<word>[^\s"`()&|^!~]+)
  | (?P<bad>.)
    )""",
    re.X,
)
HOPS = {"~": "prox", "~p": "prox", "PROX": "prox", "~l": "proc", "PROC": "proc", "PROXC": "proc", "~c": "chap", "CHAP": "chap", "CHAPTER": "chap", "~b": "book", "BOOK": "book"}


def tokens(text: str) -> list[tuple[str, str, int | None]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        kind = m.lastgroup if m else "bad"
        if kind == "n":
            kind = "hop"
        if m is None or kind == "bad":
            raise SearchError(f"unexpected character at {at}: {text[at:].strip()[:1]}")
        out.append((kind, m.group(kind), int(m.group("n")) if kind == "hop" and m.group("n") else None))
        at = m.end()
    return out


def parse_boolean(text: str) -> Search:
    """A boolean search, with proximity operators if there are any."""
    items = tokens(text)
    if not items:
        raise SearchError("nothing to search for")
    at = 0

    def peek() -> str | None:
        return items[at][0] if at < len(items) else None

    def binary(name: str, below):
        def parse() -> Node:
            nonlocal at
            parts = [below()]
            while peek() == name or (name == "and" and peek() in ("word", "phrase", "regexp", "open", "not")):
                if peek() == name:
                    at += 1
                parts.append(below())
            return parts[0] if len(parts) == 1 else Op(name, tuple(parts))

        return parse

    def unary() -> Node:
        nonlocal at
        kind = peek()
        if kind is None:
            raise SearchError("an operator has nothing behind it")
        _, value, _ = items[at]
        at += 1
        if kind == "not":
            return Op("not", (unary(),))
        if kind == "open":
            inner = expression()
            if peek() == "hop":
                raise SearchError("a proximity operator can't stand inside parentheses")
            if peek() != "close":
                raise SearchError("a parenthesis isn't closed")
            at += 1
            return inner
        if kind in ("word", "phrase", "regexp"):
            if not value.strip(" %*"):
                raise SearchError("a term is empty")
            return Term(value if kind == "regexp" else value.strip(), kind)
        if kind == "close":
            raise SearchError("a parenthesis is closed that was never opened")
        raise SearchError(f"an operator has nothing before it: {value}")

    expression = binary("or", binary("xor", binary("and", unary)))
    parts, hops = [expression()], []
    while peek() == "hop":
        _, name, n = items[at]
        hops.append(Hop(HOPS[name], n))
        at += 1
        parts.append(expression())
    if at < len(items):
        raise SearchError("a parenthesis is closed that was never opened")
    return Search(tuple(parts), tuple(hops))


def words_of(text: str) -> list[str]:
    """The distinct words of a plain search; punctuation separates."""
    return list(dict.fromkeys(re.findall(r"[^\s.,;:?!\"`()&|^~<>=+/\\]+", text)))


def parse(text: str, kind: str | None = None, limit: int | None = None) -> Search:
    """A search of a given type; ``limit`` is k for ``keyword_limit`` and the distance for ``proximity``."""
    name = search_type(kind).name
    if name == "boolean":
        return parse_boolean(text)
    if name in ("phrase", "regexp"):
        if not text.strip():
            raise SearchError("nothing to search for")
        inner = text.strip()
        return Search((Term(inner.strip('"') if name == "phrase" else inner.strip("`"), name),))
    words = tuple(Term(w) for w in words_of(text) if w.strip("%*"))
    if not words:
        raise SearchError("nothing to search for")
    if name in ("proximity", "chapter", "book"):
        hop = Hop({"proximity": "prox", "chapter": "chap", "book": "book"}[name], limit if name == "proximity" else None)
        return Search(words, (hop,) * (len(words) - 1))
    if name == "not":
        return Search((Op("not", (words[0] if len(words) == 1 else Op("and", words),)),))
    if len(words) == 1:
        return Search(words)
    if name in ("two_or_more", "keyword_limit"):
        k = 2 if name == "two_or_more" else max(1, limit or 2)
        return Search((Op("and", words) if len(words) <= k else Op("atleast", words, k),))
    return Search((Op(name, words),))


def terms(node: Node | Search) -> list[Term]:
    """All terms, in order, once each; negated ones too."""
    if isinstance(node, Search):
        return list(dict.fromkeys(t for p in node.parts for t in terms(p)))
    return [node] if isinstance(node, Term) else list(dict.fromkeys(t for p in node.parts for t in terms(p)))


def stop_words(search: Search, common: set[str], policy: str = "exact") -> None:
    """Refuse common words: any of them (``always``), only if all words are common (``exact``), or none (``never``)."""
    words = [t.text.lower() for t in terms(search) if t.kind == "word"]
    found = [w for w in words if w in common]
    if policy == "always" and found or policy == "exact" and words and len(found) == len(words):
        raise SearchError("too common to search for: " + ", ".join(found))


def terms_by_class(search: Search) -> dict[str, list[str]]:
    """Terms as ``word``, ``phrase`` and ``regexp`` lists; longest first if a word stands within a phrase, as marks must not nest."""
    found = terms(search)
    out = {kind: [t.text for t in found if t.kind == kind] for kind in ("word", "phrase", "regexp")}
    if any(w.lower() in p.lower() for w in out["word"] for p in out["phrase"]):
        out = {kind: sorted(v, key=lambda x: (-len(x), x)) for kind, v in out.items()}
    return out


def misplaced(text: str, kind: str | None = None) -> None:
    """Refuse a reference (``3:16``) that stands among the words of a search; phrases and regular expressions may hold one."""
    if search_type(kind).name in ("phrase", "regexp"):
        return
    found = re.findall(r"(?<![\w:])\d+:\d+(?:-\d+)?(?![\w:])", re.sub(r'"[^"]*"|`[^`]*`', " ", text))
    if found:
        raise SearchError("a reference can't stand in a search: " + ", ".join(found))


def common_only(words: Column, common: Iterable[str]) -> Column:
    """Whether all of a search's words (an array, lower case) are common, as ``stop_words`` tests by the policy ``exact``; over a table of searches."""
    return F.size(F.array_except(words, F.array(*[F.lit(x) for x in sorted(common)]).cast("array<string>"))) == 0


def like(term: str) -> str:
    return "%" + re.sub(r"([\\_])", r"\\\1", term.replace("*", "%")).strip("%") + "%"


def word_pattern(term: str) -> str:
    """Whole-word pattern of a word with wildcards; a wildcard at an end frees that end."""
    own = term.replace("*", "%")
    core = ".*".join(literal(p) for p in own.strip("%").split("%"))
    head = "" if own.startswith("%") else f"(^|{LETTER})"
    tail = "" if own.endswith("%") else f"({LETTER}|$)"
    return head + core + tail


def term_column(term: Term, text: Column, whole_words: bool = False, exact_case: bool = False) -> Column:
    """Whether a text holds a term.

    Words match anywhere, without regard to case and accents; phrases and regular expressions regard accents. A cheap
    substring test stands before every pattern.
    """
    flags = "" if exact_case else "(?iu)"
    if term.kind == "regexp":
        return text.rlike(flags + term.text)
    if re.fullmatch(r"[GHgh]\d+", term.text):  # a lexicon number is always whole
        return text.rlike(f"(?i)(^|{LETTER}){term.text}({LETTER}|$)")
    if term.kind == "phrase":
        parts = [p for p in re.split(r"\s+", term.text) if p]
        bare = [p.replace("*", "%") for p in parts]
        gap = "([^a-fi-zA-FI-Z]+)"  # fixed value: anything but letters, though g and h may mark lexicon numbers
        core = gap.join(".*".join(literal(x) for x in p.split("%")) for p in bare)
        if whole_words:
            core = f"(^|{LETTER}){core}({LETTER}|$)"
        guard = reduce(lambda a, b: a & b, [_contains(p, text, exact_case) for p in bare])
        return guard & text.rlike(flags + core)
    guard = _contains(term.text, text, exact_case)
    return guard & text.rlike(flags + word_pattern(term.text)) if whole_words else guard


def _contains(term: str, text: Column, exact_case: bool) -> Column:
    own = term.replace("*", "%").strip("%")
    where, what = (text, own) if exact_case else (fold(text), fold_text(own))
    return where.like(like(what)) if "%" in what else where.contains(what)


def column(node: Node, text: Column | str = "text", whole_words: bool = False, exact_case: bool = False) -> Column:
    """The predicate of an expression; the text must not be null."""
    col = F.col(text) if isinstance(text, str) else text
    if isinstance(node, Term):
        return term_column(node, col, whole_words, exact_case)
    parts = [column(p, col, whole_words, exact_case) for p in node.parts]
    if node.name == "not":
        return ~parts[0]
    if node.name == "atleast":
        return reduce(lambda a, b: a + b, [p.cast("int") for p in parts]) >= node.k
    fold_with = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b}[node.name]
    return reduce(fold_with, parts)


def multi_field(node: Node, fields: list[str], **how: bool) -> Column:
    """A search over several fields: it must hold within one of them."""
    return reduce(lambda a, b: a | b, [column(node, F.coalesce(F.col(c), F.lit("")), **how) for c in fields])


ADVANCED = {"all": "and", "any": "or", "one": "xor", "none": "not", "phrase": "phrase", "regexp": "regexp", "boolean": "boolean"}


def advanced(inputs: dict[str, str], **how: bool) -> Column:
    """All filled inputs (all, any, one, none, phrase, regexp, boolean) must hold; ``none`` means none of its words."""
    parts = []
    for name, kind in ADVANCED.items():
        if inputs.get(name, "").strip():
            if name == "none":
                words = parse(inputs[name], "or")
                parts.append(~column(words.parts[0], **how))
            else:
                parts.append(column(parse(inputs[name], kind).parts[0], **how))
    if not parts:
        raise SearchError("nothing to search for")
    return reduce(lambda a, b: a & b, parts)
