"""One form for text that reads the same.

``Unifier.text`` works by quick check: one scan finds the segments that may be unstable (characters that compose,
decompose, vanish or change width), each taken with the starter before it as boundary context. Only those segments are
normalised, and they are spliced between the untouched rest. ``Unifier.skeleton`` then replaces letters that another
script draws alike, by a table over code points, for comparison keys; ``Unifier.form`` gives each word of the skeleton
the script that its unmistakable letters belong to, which is the form for output. Equal skeletons give equal forms.

Only what can't be seen is unified: glyph width, the width of a single blank, invisible characters, composition,
ligatures and look-alike letters. Case, accents, superscripts, circled digits, fractions and dashes stay apart, as do
joiners that shape emoji, Arabic or Indic text.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import durable, keyed_text, map_arrow, spread

# Letters that are drawn like a Latin one of their case, from the confusable characters of Unicode (UTS #39,
# confusables.txt; the tests ask ICU's spoof checker). Letters that are only similar there (α, ρ, г, ҽ, զ) are left out.
CYRILLIC = dict(zip("аеорсухіјѕԁһԛԝѵАВЕКМНОРСТХІЈЅҮѴԜԌ", "aeopcyxijsdhqwvABEKMHOPCTXIJSYVWG"))
GREEK = dict(zip("ονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿϹϺϜ", "ovcjABEZHIKMNOPTYXJCMF"))
ARMENIAN = dict(zip("հոսօՍՏՕ", "hnuoUSO"))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏃᏙᏚᏞᏟᏢᏦᏳᏴ", "DRTAJEWMHZVSLCPKGB"))
COPTIC = dict(zip("ⲟⲣⲥⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "opcHIKMNOPCTYX"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
PHONETIC = dict(zip("ɡᴄᴏᴠᴡᴢ", "gcovwz"))
RARE = "".join([*ARMENIAN, *CHEROKEE, *COPTIC, *LISU, *PHONETIC])
ALIKE = {"CYRILLIC": CYRILLIC, "GREEK": GREEK, "ARMENIAN": ARMENIAN, "CHEROKEE": CHEROKEE, "COPTIC": COPTIC, "LISU": LISU}
# Code points that print nothing, and blanks of other width than U+0020.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0000, 0xE0080)]
BLANKS = [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
# What compatibility mapping may replace without a visible change (ligatures, digraphs, numerals, widths).
SAME_GLYPH = [(0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xFF01, 0xFFEE)]
OTHER = {0x2010: "-", 0x2011: "-", 0x2BC: "’", 0xB5: "μ"}
JOINED = re.compile("[؀-෿ក-᢯☀-➿️\U0001f000-\U0001faff]")


def _char_class(points: set[int]) -> str:
    out, run = [], []
    for c in [*sorted(points), -9]:
        if run and c != run[-1] + 1:
            out.append(f"\\U{run[0]:08x}" + (f"-\\U{run[-1]:08x}" if len(run) > 1 else ""))
            run = []
        run.append(c)
    return "".join(out)


@lru_cache(maxsize=4096)
def script(c: str) -> str:
    """The script of a letter, or nothing if another script draws it alike."""
    base = unicodedata.normalize("NFD", c)[0]
    return "" if base in "aeopcyxijsdhqwvABEKMHOPCTXIJSYZN" else unicodedata.name(base, "").split(" ", 1)[0]


class Unifier:
    def __init__(self):
        self.map: dict[int, str] = {c: "" for c in INVISIBLE} | {c: " " for c in BLANKS} | OTHER
        for a, b in SAME_GLYPH:
            for c in range(a, b + 1):
                if (to := unicodedata.normalize("NFKC", chr(c))) != chr(c):
                    self.map.setdefault(c, to)
        # quick check: a code point is stable if it neither changes by itself nor can join the starter before it
        unstable = set(self.map)
        for c in range(0xC0, 0x30000):
            kind = unicodedata.decomposition(chr(c))
            if unicodedata.combining(chr(c)) or (kind and kind[0] != "<" and unicodedata.normalize("NFC", chr(c)) != chr(c)):
                unstable.add(c)
        unstable |= {*range(0x1160, 0x1200), 0x9BE, 0x9D7, 0xB3E, 0xB56, 0xB57, 0xBBE, 0xBD7, 0xCC2, 0xCD5, 0xCD6, 0xD3E, 0xD57, 0xDCF, 0xDDF, 0x102E, 0x1B35}
        either = _char_class(unstable)
        self.unstable = re.compile(f"[{either}]")
        self.segment = re.compile(f"[^{either}]?[{either}]+", re.DOTALL)
        self.foreign = re.compile(f"[Ͱ-ԯἀ-῿{RARE}]")
        self.other = re.compile("[Ͱ-֏Ꭰ-ᏽἀ-῿Ⲁ-⳿ꓐ-꓿]")
        letters = {ord(a): b for m in (*ALIKE.values(), PHONETIC) for a, b in m.items()}
        self.table = np.arange(0x110000, dtype=np.uint32)
        for c in [*range(0x370, 0x530), *range(0x1F00, 0x2000), *letters]:
            to = unicodedata.normalize("NFC", unicodedata.normalize("NFD", chr(c)).translate(letters))
            if len(to) == 1:
                self.table[c] = ord(to)
        self.back = {script: {ord(b): a for a, b in reversed(m.items())} for script, m in ALIKE.items()}

    def _invisible(self, text: str, at: int, lo: int, hi: int) -> bool:
        """A joiner or selector shapes the glyph if it stands between (or after) characters that join."""
        c = ord(text[at])
        if not (0x200C <= c <= 0x200D or 0xFE00 <= c <= 0xFE0F):
            return True
        before = at > 0 and JOINED.match(text[at - 1])
        after = at + 1 < len(text) and JOINED.match(text[at + 1])
        return not (before and (after or c >= 0xFE00))

    def text(self, text: str) -> str:
        """Width, blanks, invisible characters and composition made uniform."""
        if text.isascii() or not self.unstable.search(text):
            return text
        out, done = [], 0
        for m in self.segment.finditer(text):
            lo, hi = m.span()
            out.append(text[done:lo])
            part = []
            for at in range(lo, hi):
                to = self.map.get(ord(text[at]))
                part.append(text[at] if to is None or (to == "" and not self._invisible(text, at, lo, hi)) else to)
            out.append("".join(part))
            done = hi
        out.append(text[done:])
        # a removed character may have kept a mark from its starter, so segments compose after the splice
        return self._composed("".join(out))

    def _composed(self, joined: str) -> str:
        if unicodedata.is_normalized("NFC", joined):
            return joined
        parts, done = [], 0
        for m in self.segment.finditer(joined):
            parts += [joined[done : m.start()], unicodedata.normalize("NFC", m.group())]
            done = m.end()
        return "".join([*parts, joined[done:]])

    def skeleton(self, text: str) -> str:
        """``text`` with the letters that another script draws alike replaced by the Latin ones."""
        text = self.text(text)
        if text.isascii() or not self.foreign.search(text):
            return text
        # a mark may have waited for a letter of its own script
        return self._composed(self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].tobytes().decode("utf-32-le", "surrogatepass"))

    def form(self, text: str) -> str:
        """The form for output: the skeleton, each word in the script of its unmistakable letters."""
        bones = self.skeleton(text)
        if bones.isascii() or not self.other.search(bones):
            return bones
        last = "LATIN"

        def word(m: re.Match) -> str:
            nonlocal last
            own = m.group()
            scripts = {s for s in map(script, own) if s}
            if scripts:
                others = scripts - {"LATIN"}
                one = others.pop() if len(others) == 1 else "LATIN"
                # Latin letters that the other script draws alike are no sign of Latin
                plain = one in self.back and all(ord(c) in self.back[one] for c in unicodedata.normalize("NFD", own) if script(c) == "LATIN")
                last = one if plain or "LATIN" not in scripts else "LATIN"
            if last not in self.back:
                return own
            return unicodedata.normalize("NFC", unicodedata.normalize("NFD", own).translate(self.back[last]))

        return re.sub(r"[^\W\d_]+", word, bones)


UNSTABLE, FOREIGN, LATIN, LETTER, DIGIT, SIGN, GAP = 1, 2, 4, 8, 16, 32, 64


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """What each code point may be, as flags: a quick check of many texts by one table lookup."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x20000):
        x = chr(c)
        if x.isalpha():
            out[c] |= LETTER | (LATIN if c < 0x250 else 0)
        elif x.isdigit():
            out[c] |= DIGIT
    out[0x370:0x530] |= FOREIGN
    out[[ord(c) for c in RARE]] |= FOREIGN
    out[[ord(c) for c in "*@$!"]] |= SIGN
    out[[ord(c) for c in "-. "]] |= GAP
    own = unifier()
    for c in [*range(0x80, 0x30000), *range(0xE0000, 0xE0080)]:
        if own.unstable.match(chr(c)):
            out[c] |= UNSTABLE
    return out


def surveys(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts as (index of the first, code points, their kinds, start of each text); a line feed ends each text."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= most or k + 1 == len(texts):
            part = texts[lo : k + 1]
            codes = np.frombuffer(("\n".join(part) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
            starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in part])[:-1]]).astype(np.int64)
            yield lo, codes, kinds()[codes], starts
            lo, size = k + 1, 0


@lru_cache(maxsize=1)
def unifier() -> Unifier:
    return Unifier()


def unify(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``<id_col>, form``: every value in its one form. Null stays null, empty stays empty, repeated rows stay."""

    def run(batches):
        own = unifier()
        for batch in batches:
            yield {id_col: batch.column(0), "form": [None if t is None else own.form(t) for t in batch.column(1).to_pylist()]}

    return map_arrow(spread(keyed_text(df, id_col, text_col)), run, f"`{id_col}` long, form string")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def comparison_keys(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``rec_id, raw, look, check``: hashes of each non-blank value as stored and of its skeleton; of ASCII values, and of the others.

    ASCII values are their own skeleton, so the JVM hashes them; only the others visit Python.
    """
    rows = keyed_text(df, id_col, text_col).where("text IS NOT NULL")
    plain = F.octet_length("text") == F.char_length("text")
    ascii_rows = rows.where(plain & F.col("text").rlike(r"\S")).select("rec_id", F.xxhash64("text").alias("raw"), F.xxhash64("text").alias("look"), F.crc32("text").alias("check"))

    def run(batches) -> Iterator[dict]:
        own = unifier()
        for batch in batches:
            keep, raw, look, check = [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                bones = own.skeleton(t)
                if not bones.strip():
                    continue
                stored = t.encode("utf-8", "replace")
                data = stored if bones is t else bones.encode("utf-8", "replace")
                h = signed(xxhash.xxh64_intdigest(data, 42))
                keep.append(k)
                raw.append(h if data is stored else signed(xxhash.xxh64_intdigest(stored, 42)))
                look.append(h)
                check.append(zlib.crc32(data))
            yield {"rec_id": pc.take(batch.column(0), pa.array(keep, pa.int32())), "raw": raw, "look": look, "check": check}

    return ascii_rows, map_arrow(spread(rows.where(~plain)), run, "rec_id long, raw long, look long, check long")


PARTS = 64  # a spelling's records are joined in so many parts


def _spelled(fields: dict[str, tuple[DataFrame, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Keys of all values (``field, rec_id, raw, look, check``), and the looks that are spelled in several ways.

    Only the keys that come from Python are kept; those of ASCII values cost the JVM little and are worked out again.
    """
    keys = None
    for name, (df, id_col, text_col) in fields.items():
        plain, others = comparison_keys(df, id_col, text_col)
        part = plain.unionByName(durable(others)).select(F.lit(name).alias("field"), "*")
        keys = part if keys is None else keys.unionByName(part)
    looks = keys.groupBy("field", "look", "check").agg(F.min("raw").alias("least"), F.max("raw").alias("most")).where("least <> most")
    return keys, looks.select("field", "look", "check")


def same_looking(fields: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Pairs of records whose values read the same but are different strings: ``field, id_a, id_b`` (``id_a < id_b``).

    ``fields`` maps a name to (table, id column, text column). Null, empty and blank values are in no pair; equal
    strings are no pair; repeated ids give a pair once. Skeletons with a single spelling are dropped by a two-value
    aggregate before anything is joined; spellings are then paired first and rows joined to spelling pairs, so rows of
    one spelling, however many, never meet one another. A spelling's rows are joined in ``PARTS`` parts by a hash of their
    ids, so a popular value is spread over tasks. ``looking_alike`` gives the short form.
    """
    keys, mixed = _spelled(fields)
    on = ["field", "look", "check"]
    rows = durable(keys.join(mixed, on, "left_semi").distinct()).withColumn("part", F.pmod(F.xxhash64("rec_id"), F.lit(PARTS)).cast("int"))
    spellings = rows.select(*on, "raw", "part").distinct()
    pairs = spellings.join(spellings.withColumnRenamed("raw", "other").withColumnRenamed("part", "other_part"), on).where("raw <> other")
    left = pairs.join(rows.withColumnRenamed("rec_id", "id_a"), [*on, "raw", "part"])
    right = rows.select(*on, F.col("raw").alias("other"), F.col("part").alias("other_part"), F.col("rec_id").alias("id_b"))
    return left.join(right, [*on, "other", "other_part"]).where("id_a < id_b").select("field", "id_a", "id_b").distinct()


def looking_alike(fields: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """The short form of ``same_looking``: ``field, rec_id, class_id, spellings, records``, a row a record of a class with several spellings.

    ``class_id`` is the least id of the class; ``spellings`` and ``records`` count the class's different strings and its records.
    """
    keys, mixed = _spelled(fields)
    on = ["field", "look", "check"]
    rows = durable(keys.join(mixed, on, "left_semi").distinct())
    # spellings are counted from their own rows, so no task gathers a class's records
    size = rows.groupBy(*on, "raw").agg(F.min("rec_id").alias("least"), F.count("*").alias("n")).groupBy(*on).agg(F.min("least").alias("class_id"), F.count("*").alias("spellings"), F.sum("n").alias("records"))
    return rows.join(size, on).select("field", "rec_id", "class_id", "spellings", "records")
