"""Scalar text functions as JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to, position by position.
ACCENTED = "àáâãäåāăąçćčèéêëēĕėęěìíîïīĭįñńňòóôõöøōŏőùúûüūŭůűųýÿšśžźżłřťďģķļņ"
FOLDED = "aaaaaaaaaccceeeeeeeeeiiiiiiinnnooooooooouuuuuuuuuyysszzzlrtdgkln"
LETTER = r"[^\p{L}\p{M}\p{N}_]"  # what may stand beside a whole word


def fold(col: Column) -> Column:
    """Lower case without accents, for comparisons."""
    return F.translate(F.lower(col), ACCENTED, FOLDED)


def fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans(ACCENTED, FOLDED))


def literal(text: str) -> str:
    """``text`` as a regular expression that Java and RE2 read alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", text)


def strip_markup(col: Column) -> Column:
    """Text without italics, red-letter and lexicon markup."""
    plain = F.regexp_replace(F.translate(col, "‹›[]", ""), r"\{[^}]+\}", "")
    return F.trim(F.regexp_replace(plain, r" {2,}", " "))


def lexicon_numbers(col: Column) -> Column:
    """Lexicon numbers in a text, upper case and without leading zeros, in order."""
    found = F.regexp_extract_all(col, F.lit(r"([GHgh][0-9]+)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(F.upper(x), r"^([GH])0+(?=[0-9])", "$1"))


def highlight(col: Column, terms: list[str], tag: str = "b", whole_words: bool = False, exact_case: bool = False, phrases: list[str] | None = None) -> Column:
    """Matches of any term wrapped in a tag; longer terms first, so tags never nest.

    As in a search, words regard accents only if ``whole_words`` or ``exact_case``; ``phrases``, and terms with blanks, always do.
    """
    every = {t: whole_words or exact_case or bool(re.search(r"\s", t)) for t in terms} | dict.fromkeys(set(phrases or []) - set(terms), True)
    patterns = [literal(t) if exact else accent_classes(t) for t, exact in sorted(every.items(), key=lambda x: (-len(x[0]), x[0])) if t]
    parts = [p.replace(r"\*", r"[\p{L}\p{M}\p{N}_]*").replace("%", r"[\p{L}\p{M}\p{N}_]*") for p in patterns]
    if not parts:
        return col
    pattern = f"({'|'.join(parts)})"
    if whole_words:
        pattern = rf"(?<![\p{{L}}\p{{M}}\p{{N}}_]){pattern}(?![\p{{L}}\p{{M}}\p{{N}}_])"
    return F.regexp_replace(col, pattern if exact_case else f"(?iu){pattern}", f"<{tag}>$1</{tag}>")


def accent_classes(term: str) -> str:
    """A pattern in which every plain letter also matches its accented forms."""
    out = []
    for c in fold_text(term):
        forms = "".join(a for a, b in zip(ACCENTED, FOLDED) if b == c)
        out.append(f"[{c}{forms}]" if forms else literal(c))
    return "".join(out)


def html_to_text(col: Column) -> Column:
    """Line breaks for breaks and paragraphs, tags dropped, common entities decoded."""
    x = F.regexp_replace(col, r"(?i)<br\s*/?>|</p>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    for name, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(to))
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_spaces(col: Column) -> Column:
    """Single blanks, and none before closing punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, r"\s+", " "), r" ([?,.!:;])", "$1"))


def trim_request(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col, r"\s+", " "), r"^[;, ]+|[;, ]+$", ""))


def slug(col: Column) -> Column:
    """A module name from a title: lower case, runs of other characters as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def valid_module(col: Column) -> Column:
    return col.rlike(r"^[a-z][a-z0-9_]*$")


def host(url: Column) -> Column:
    """The domain of an address as users write it: no scheme, www, port, path or fragment; null for localhost."""
    x = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://", "")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[/?#].*$", ""), r":[0-9]+$", ""), r"^www\.", "")
    return F.when(~x.isin("", "localhost", "127.0.0.1"), x)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    last, teens = n % 10, (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(teens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def size_bytes(col: Column) -> Column:
    """Bytes of a size such as 512M."""
    number = F.regexp_extract(col, r"^\s*([0-9]+)", 1).cast("long")
    unit = F.upper(F.regexp_extract(col, r"^\s*[0-9]+\s*([kKmMgG]?)", 1))
    return number * F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).otherwise(1)


def version_parts(col: Column) -> Column:
    """A version as an array of numbers, which compares in the right order."""
    return F.transform(F.split(col, r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^([0-9]+)", 1).try_cast("int"), F.lit(0)))


def canonical_json(pairs: Column) -> Column:
    """JSON of a map with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def valid_utf8(col: Column) -> Column:
    """Text without the bytes that aren't UTF-8."""
    return F.when(F.is_valid_utf8(col), col).otherwise(F.replace(F.make_valid_utf8(col), F.lit("\ufffd"), F.lit("")))


def year_of(col: Column) -> Column:
    """The year in a date as people write it: the first four digits that may be one."""
    return F.regexp_extract(col, r"(?:^|[^0-9])(1[0-9]{3}|20[0-9]{2})(?:[^0-9]|$)", 1).try_cast("int")


def positive_int(col: Column, default: int) -> Column:
    """A whole number above zero as users write it, else the default."""
    n = F.trim(col.cast("string")).try_cast("int")
    return F.when(n > 0, n).otherwise(default)


def one_line(col: Column) -> Column:
    """Line ends as blanks; nothing stays null."""
    return F.regexp_replace(col, r"[\r\n]+", " ")


def wrap(col: Column, width: int = 80) -> Column:
    """Lines of at most ``width`` characters, broken at blanks; longer words stay whole."""
    return F.regexp_replace(F.regexp_replace(col, rf"(.{{1,{width}}})(?: +|$)", "$1\n"), r"\s+$", "")


def truthy(col: Column) -> Column:
    """Flags as users and forms write them."""
    return F.lower(F.trim(col.cast("string"))).isin("1", "true", "on", "yes", "y")


def import_text(col: Column, italics: tuple[str, str] = ("[", "]"), red: tuple[str, str] = ("‹", "›"), paragraph: str = "¶", parentheses: str = "retain", lexicon: tuple[str, str] | None = None) -> Column:
    """Text of a foreign module in the corpus's own markup.

    Italics, lexicon numbers, red letters and paragraph signs become ``[ ]``, ``{ }``, ``‹ ›`` and ``¶``; other tags go;
    blanks are single. ``parentheses`` says what to do with parentheses around lexicon numbers: retain, trim or discard.
    ``lexicon`` are the signs around numbers in formats that have no tags for them.
    """
    x = col
    if lexicon:
        x = F.regexp_replace(x, f"(?s){literal(lexicon[0])}((?:(?!{literal(lexicon[1])}).)*?[0-9].*?){literal(lexicon[1])}", "{$1}")
    x = F.regexp_replace(x, f"(?s){literal(italics[0])}(.*?){literal(italics[1])}", "[$1]")
    x = F.regexp_replace(x, r"<[WS]([GH])0*([0-9]+)[^>]*>|<([GH])0*([0-9]+)>", "{$1$2$3$4}")
    # several numbers in one pair of braces
    x = F.regexp_replace(x, r"(?<=[0-9)])[\s,;]*(?=\(?[GHgh][0-9]+\)?[^{}]*\})", "} {")
    if parentheses == "trim":
        x = F.regexp_replace(x, r"\((\{[GHgh][0-9]+\})\)", "$1")
        x = F.regexp_replace(x, r"\{\(([GHgh][0-9]+)\)\}", "{$1}")
    elif parentheses == "discard":
        x = F.regexp_replace(x, r"\(\{[GHgh][0-9]+\}\)|\{\([GHgh][0-9]+\)\}", "")
    x = F.regexp_replace(x, f"(?s){literal(red[0])}(.*?){literal(red[1])}", "‹$1›")
    x = F.replace(x, F.lit(paragraph), F.lit("¶ "))
    return clean_spaces(F.regexp_replace(x, r"<[^>]+>", ""))


def usfm_inline(col: Column) -> Column:
    """Word attributes as lexicon numbers, italics and red letters in the corpus's markup, notes and references removed, other markers dropped."""
    x = F.regexp_replace(col, r"\\\+?w\s+([^|\\]*)\|[^\\]*?strong=\"([GH])0*([0-9]+)[^\\]*\\\+?w\*", "$1{$2$3}")
    x = F.regexp_replace(x, r"\\\+?w\s+([^|\\]*)(?:\|[^\\]*)?\\\+?w\*", "$1")
    x = F.regexp_replace(x, r"(?s)\\([fx])\s.*?\\\1\*", "")
    for name, opens, closes in (("add", "[", "]"), ("wj", "‹", "›")):  # italics and red letters
        x = F.regexp_replace(F.regexp_replace(x, rf"\\\+?{name}\*", closes), rf"\\\+?{name}\s+", opens)
    return clean_spaces(F.regexp_replace(x, r"\\\+?[a-z]+[0-9]*\*?", " "))


def without_counts(col: Column) -> Column:
    """A grammar note without its leading count of uses."""
    return F.regexp_replace(col, r"<b>Count:</b> [0-9]+.*?<br>", "")


def short_key(col: Column, seed: int = 0) -> Column:
    """A deterministic key of a value in base 36."""
    return F.lower(F.conv(F.hex(F.xxhash64(F.lit(seed), col)), 16, 36))


def megabytes(col: Column) -> Column:
    return F.round(col / (1024 * 1024), 1)
