"""Abusive, hateful or sexually explicit content of documents.

Every sentence of every document is scored by gradient-boosted trees over dense features: densities of a lexicon of words
and of pairs of neighbours with learned weights, nearness of the second person to the worst word, capitals, punctuation and
obfuscation rates, and densities of a small seed lexicon. A document has the score of its worst sentence, calibrated by
isotonic regression on labelled documents that the trees didn't see. Obfuscated words (look-alike letters, digits and signs
for letters, stretched, spaced or starred letters) are restored first. Features are worked out for whole batches of
sentences by array operations; only sentences with signs of obfuscation are looked at one by one, to restore their words.

The lexicon, the trees and the calibration are fitted on a bounded, hash-picked sample of labelled documents
(``SAMPLE``); every document is scored, whole.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow, spread
from .boosting import Ensemble, Isotonic
from .language import readable_all
from .unify import surveys

SAMPLE = 12_000  # labelled documents that the model is fitted on
SAMPLE_CHARS = 8_000  # longer documents aren't taken into that sample
THRESHOLD = 0.5  # calibrated rate from which a document counts as a case
SUPPORT = 5  # documents of the sample that a word or pair must be in to have a weight
PRIOR = 4  # documents' worth of the base rate that smooths a weight
HOT = 1.2  # weight from which a word is a strong sign
QUIET = 8  # one in so many sentences without a strong sign is learned from, and counts for all of them
ROUNDS = 3  # of learning
UNRATED = 2  # unrated documents of the sample for each rated one, at most
LIKELY = -1.0  # log-odds from which the worst sentence of a marked document is taken for the reason
SURE = 2.0  # log-odds from which an unlabelled document teaches as a marked one
CACHE = 300_000  # words remembered by a worker
BATCH = 1 << 20  # characters looked at together

# Words that address the reader.
SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine deinen deinem deiner toi tu te ton ta tes vous votre tú ti tus usted vos teu tua teus tuas vais"
    " tuo tuoi tue jij je jou jouw ni dig din dina ditt ты тебя тебе тебой твой твоя твоё твои твою свою εσύ εσένα σου σε".split()
)
# A seed of common insults, words of contempt for a people, and explicit words; the lexicon learns the rest.
INSULTS = frozenset(
    "idiot moron asshole bastard bitch scumbag loser shit fucking arschloch schwein missgeburt schlampe hurensohn connard abruti salope crétin gilipollas"
    " cabrón idiota imbécil imbecil puta mierda cabrão merda stronzo bastardo coglione puttana klootzak idioot eikel hoer jävel jävla svin hora"
    " идиот козёл сволочь сука хуй ηλίθιε ηλίθιος μαλάκα μαλάκας πουτάνα".split()
)
CONTEMPT = frozenset("vermin scum subhuman ungeziefer untermenschen vermine racaille alimañas escoria escória parassiti feccia ongedierte uitschot ohyra avskum нелюди παράσιτα".split())
EXPLICIT = frozenset("sex fuck porn nude ficken nackt baiser nue follar desnuda desnudo foder nua scopare nuda nudo neuken naakt knulla naken трахнуть голая γαμήσω γυμνή".split())

WORD = regex.compile(r"[\p{L}\p{M}\p{N}*@$!]+")
PLAIN = regex.compile(r"[\p{L}\p{M}]+")
SPACED = re.compile(r"(?<!\w)(?:\w(?:\.\w){2,}|\w(?:-\w){2,}|[^\W\d_](?: [^\W\d_]){2,})(?!\w)")
LEET = str.maketrans("013457@$!", "oieastasi")
LEET_CYRILLIC = str.maketrans("03@!1", "оеаии")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
SUSPECT = re.compile(
    r"[*@$!](?<=[^\W\d_].)[*@$!]*(?=[^\W\d_])|\d(?<=[^\W\d_]\d)\d*(?=[^\W\d_])|(?<!\w)[45013]\d*[a-zà-ÿ]|[@$]\w|([^\W\d_])\1\1|(?<!\w)[^\W\d_]([-. ])[^\W\d_]\2[^\W\d_](?!\w)"
)
FEATURES = 18


ALPHA, DECIMAL, WORDLY, SIGN, GAP, LOWER, MONEY = 1, 2, 4, 8, 16, 32, 64


@lru_cache(maxsize=1)
def signs() -> np.ndarray:
    """What ``SUSPECT`` may take each code point for, as flags: ``[^\\W\\d_]``, ``\\d``, ``\\w`` and its own classes."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalnum():
            out[c] = WORDLY | (DECIMAL if x.isdecimal() else ALPHA)
    out[ord("_")] |= WORDLY
    out[[ord(c) for c in "*@$!"]] |= SIGN
    out[[ord(c) for c in "-. "]] |= GAP
    out[[*range(97, 123), *range(0xE0, 0x100)]] |= LOWER
    out[[36, 64]] |= MONEY
    return out


def may_be_obfuscated(texts: list[str]) -> np.ndarray:
    """Whether ``SUSPECT`` may match each text, by neighbouring kinds of characters; never false where it does match."""
    out = np.zeros(len(texts), bool)
    for lo, codes, _, starts in surveys(texts):
        codes = np.append(codes, [10] * 4)
        kind = signs()[codes]
        letter, digit, word, sign, gap, lower, money = (kind & k > 0 for k in (ALPHA, DECIMAL, WORDLY, SIGN, GAP, LOWER, MONEY))
        hit = np.zeros(len(codes), bool)
        hit[:-1] |= sign[:-1] & letter[1:]
        # digits before a letter are common in names of books; only lower-case letters, or a letter before the run of digits, count
        ends = np.flatnonzero(digit[:-1] & (letter | lower)[1:])
        if len(ends):
            others = np.flatnonzero(~digit)
            at = np.searchsorted(others, ends) - 1  # what stands before the run; the first text may begin with it
            hit[ends] |= lower[ends + 1] | ((at >= 0) & letter[others[np.maximum(at, 0)]])
        hit[:-2] |= letter[:-2] & (codes[:-2] == codes[1:-1]) & (codes[1:-1] == codes[2:])
        # a single letter between two equal gaps, and another single letter behind
        hit[:-4] |= gap[:-4] & letter[1:-3] & (codes[:-4] == codes[2:-2]) & letter[3:-1] & ~word[4:]
        hit[:-1] |= money[:-1] & word[1:]
        if len(codes):
            out[lo : lo + len(starts)] = np.logical_or.reduceat(hit, starts)
    return out


def restore(sentence: str, known: dict[str, float]) -> tuple[list[str], int, int]:
    """Lower-case words with obfuscation undone, the number of words restored, and how many of those have a weight above ``HOT``."""
    undone = hot = 0
    low = sentence.lower()
    if not SUSPECT.search(sentence):
        return PLAIN.findall(low), 0, 0

    def joined(m: re.Match) -> str:
        nonlocal undone
        letters = re.sub(r"[-. ]", "", m.group())
        if not any(c.isalpha() for c in letters):
            return m.group()
        undone += 1
        for k, part in ((0, letters), (1, letters[1:]), (2, letters[:-1])):
            if known.get(STRETCHED.sub(r"\1", part.translate(LEET)), 0) > HOT:
                return (letters[0] + " ") * (k == 1) + part + (" " + letters[-1]) * (k == 2)
        return letters

    low = SPACED.sub(joined, low)
    words = []
    for w in WORD.findall(low):
        if w.isalpha():
            if STRETCHED.search(w):
                undone += 1
                w = STRETCHED.sub(r"\1", w)
                hot += known.get(w, 0) > HOT
            words.append(w)
            continue
        if "*" in w.strip("*!"):
            own = w.rstrip("!")
            undone += 1
            form = re.compile(re.escape(own).replace(r"\*", r"\w"))
            best = max((k for k in known if len(k) == len(own) and known[k] > HOT and form.fullmatch(k)), key=lambda k: (known[k], k), default=None)
            hot += best is not None
            words.append(best or "*")
            continue
        own = w.strip("*")
        if any(c.isalpha() for c in own):
            table = LEET_CYRILLIC if any("а" <= c <= "я" for c in own) else LEET
            tries = [own.rstrip("!").translate(table), own.translate(table)]
            if own.rstrip("!").isalpha():
                words.append(own.rstrip("!"))
                continue
            best = max(tries, key=lambda k: known.get(STRETCHED.sub(r"\1", k), 0))
            best = STRETCHED.sub(r"\1", best)
            if known.get(best, 0) > HOT or not own[:1].isdigit() or any(c in "@$" for c in own):
                undone += 1
                hot += known.get(best, 0) > HOT
            words.append(best)
    return words, undone, hot


def prior(x: np.ndarray) -> np.ndarray:
    """Log-odds by the fixed lists alone, where the trees begin: insults to the reader, contempt, explicit words."""
    insult, coarse, you, restored = x[:, 16] > 0, x[:, 17] > 0, x[:, 9] > 0, x[:, 14] > 0
    return -3.5 + 3.0 * (insult & you) + 1.0 * insult + 1.5 * coarse + 1.5 * (coarse & you) + 1.0 * restored


class Sentences:
    """The sentences of a batch of texts: which text each is of, where it lies in it, and what its characters are.

    A sentence ends at a line end, or at ``.!?`` before anything that isn't part of a word.
    """

    def __init__(self, texts: list[str]):
        text, lo, hi, upper, marks, letters = [], [], [], [], [], []
        word_at, base = [], 0
        for first, codes, _, starts in surveys(texts):
            kind = characters()[codes]
            end = (kind & END) > 0
            after_end, after_word = np.append(end[1:], False), np.append(kind[1:] & WORDY, 0) > 0
            cut = (codes == 10) | (end & ~after_end & ~after_word)
            edges = np.flatnonzero(cut) + 1
            begins = np.concatenate([[0], edges[:-1]])
            owner = np.searchsorted(starts, begins, "right") - 1
            text.append(owner + first)
            lo.append(begins - starts[owner])
            hi.append(edges - (codes[edges - 1] == 10) - starts[owner])
            for out, flag in ((upper, UPPER), (marks, MARK), (letters, LETTER)):
                out.append(np.add.reduceat((kind & flag > 0).astype(np.int32), begins))
            part = (kind & PART) > 0
            where = np.flatnonzero(part & ~np.concatenate([[False], part[:-1]]))
            word_at.append(np.searchsorted(edges, where, "right") + base)
            base += len(edges)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, int)
        self.text, self.lo, self.hi, self.upper, self.marks, self.letters, self.word_at = map(join, (text, lo, hi, upper, marks, letters, word_at))

    def __len__(self) -> int:
        return len(self.text)

    def string(self, texts: list[str], k: int) -> str:
        return texts[self.text[k]][self.lo[k] : self.hi[k]]


END, WORDY, UPPER, MARK, LETTER, PART = 1, 2, 4, 8, 16, 32


@lru_cache(maxsize=1)
def characters() -> np.ndarray:
    """What each code point is, as flags: sentence end, part of a word in ``\\w``, capital, ``!?*``, letter, part of a term."""
    out = np.zeros(0x110000, np.uint8)
    for c in [*range(0xD800), *range(0xE000, 0x33480), *range(0xE0100, 0xE01F0)]:
        x = chr(c)
        alpha = x.isalpha()
        if alpha or x.isalnum():
            out[c] = WORDY | (LETTER | PART if alpha else 0) | (UPPER if x.isupper() else 0)
        elif c > 0x2FF and PLAIN.match(x):
            out[c] = PART
    out[ord("_")] |= WORDY
    out[[ord(c) for c in ".!?"]] |= END
    out[[ord(c) for c in "!?*"]] |= MARK
    return out


class Batch:
    """The sentences and words of some texts, as far as no lexicon is needed for them."""

    def __init__(self, texts: list[str]):
        self.found = found = Sentences(texts)
        words = list(chain.from_iterable(PLAIN.findall(t.lower()) for t in texts))
        self.owner = found.word_at
        if len(words) != len(self.owner):  # a letter whose lower case is no letter may split a run; then sentences are cut one by one
            parts = [PLAIN.findall(found.string(texts, k).lower()) for k in range(len(found))]
            words, self.owner = list(chain.from_iterable(parts)), np.repeat(np.arange(len(found)), [len(p) for p in parts])
        numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
        self.words, self.at = list(numbers), np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        maybe = np.array([bool(m) and SUSPECT.search(t) is not None for m, t in zip(may_be_obfuscated(texts), texts)], bool)
        self.suspects = {}  # sentences with signs of obfuscation
        for k in np.flatnonzero(maybe[found.text]).tolist() if len(found) else ():
            if SUSPECT.search(sentence := found.string(texts, k)):
                self.suspects[k] = sentence


class Lexicon:
    """Weights of words and of pairs of neighbours (``a b``, with ``^`` and ``$`` for the ends of a sentence)."""

    def __init__(self, words: dict[str, float], pairs: dict[str, float]):
        # a listed word too rare for a weight of its own is a strong sign; one with a weight goes by that
        listed = {w: HOT + 0.3 for w in sorted(INSULTS | CONTEMPT | EXPLICIT) if w not in words}
        self.words = {w: v for w, v in words.items() if abs(v) > 0.2} | listed
        self.pairs = {w: v for w, v in pairs.items() if abs(v) > 0.2}
        self.reset()

    def __getstate__(self):
        return {"words": self.words, "pairs": self.pairs}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def reset(self) -> None:
        """Numbers for the lexicon's own words; 0 and 1 are the ends of a sentence."""
        self.ids: dict[str, int] = {"^": 0, "$": 1}
        self.weight, self.flags = np.zeros(1024), np.zeros(1024, np.uint8)
        self.learn(chain(self.words, chain.from_iterable(p.split(" ") for p in self.pairs)))
        keys = np.array([self.ids[a] << 32 | self.ids[b] for a, b in (p.split(" ") for p in self.pairs)], np.int64)
        order = np.argsort(keys)
        self.keys, self.pair_weight = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array(list(self.pairs.values()), float)[order], 0.0)

    def learn(self, words: Iterable[str]) -> None:
        for w in words:
            if w in self.ids:
                continue
            k = self.ids[w] = len(self.ids)
            if k >= len(self.weight):
                self.weight, self.flags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.weight, self.flags))
            self.weight[k] = self.words.get(w, 0.0)
            self.flags[k] = (w in SECOND_PERSON) | (w in INSULTS) << 1 | (w in CONTEMPT or w in EXPLICIT) << 2

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.pair_weight[at], 0.0)

    def features(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the sentences that have words, and their features."""
        if len(self.ids) > CACHE:
            self.reset()
        found, owner = batch.found, batch.owner
        self.learn(batch.words)
        ids = np.fromiter(map(self.ids.__getitem__, batch.words), np.int64, len(batch.words))[batch.at]
        undone, hot = np.zeros(len(found)), np.zeros(len(found))
        if batch.suspects:
            restored = {}
            for k, sentence in batch.suspects.items():
                restored[k], undone[k], hot[k] = restore(sentence, self.words)
            self.learn(chain.from_iterable(restored.values()))
            keep = ~np.isin(owner, list(restored))
            more = np.array([self.ids[w] for own in restored.values() for w in own], np.int64)
            ids, owner = np.concatenate([ids[keep], more]), np.concatenate([owner[keep], np.repeat(list(restored), [len(v) for v in restored.values()])]).astype(int)
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        if not len(ids):
            return np.zeros(0, int), np.zeros((0, FEATURES))
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        own = owner[first]
        n = np.diff(np.append(first, len(ids)))
        row, place = np.repeat(np.arange(len(first)), n), np.arange(len(ids))
        add, top = (lambda x: np.add.reduceat(x, first)), (lambda x: np.maximum.reduceat(x, first))
        w, flags = self.weight[ids], self.flags[ids]
        best = top(w)
        at = np.minimum.reduceat(np.where(w == best[row], place, len(ids)), first)
        rest = w.copy()
        rest[at] = -np.inf
        second = np.where(n > 1, top(rest), 0.0)
        opens = np.zeros(len(ids), bool)
        opens[first] = True
        both = self.pair(np.where(opens, 0, np.concatenate([[0], ids[:-1]])), ids)
        last = self.pair(ids[first + n - 1], np.ones(len(first), np.int64))
        you = (flags & 1) > 0
        far = np.minimum(np.minimum.reduceat(np.where(you, np.abs(place - at[row]), 20), first), 20)
        size = np.maximum(found.hi - found.lo, 1)[own]
        x = np.stack([
            best, second, add(w) / n, add(np.where(w > HOT, w, 0)) / n,
            np.maximum(top(both), last), (add(both) + last) / (n + 1), np.minimum(np.minimum.reduceat(both, first), last),
            (add(both > 1.0) + (last > 1)) / (n + 1), (add(both < -0.7) + (last < -0.7)) / (n + 1),
            add(you) / n, far, found.upper[own] / np.maximum(found.letters[own], 1), found.marks[own] / size, undone[own] / n, hot[own], np.minimum(n, 40),
            add((flags & 2) > 0) / n, add((flags & 4) > 0) / n,
        ], 1)
        return own, x


def parts_of(texts: list[str], most: int = BATCH) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``most`` characters, with the index of the first; a longer text is a run of its own."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most or k + 1 == len(texts):
            yield lo, texts[lo : k + 1]
            lo, size = k + 1, 0


class AbuseModel:
    def __init__(self, lexicon: Lexicon, trees: Ensemble, calibration: Isotonic, floor: float):
        self.lexicon, self.trees, self.calibration, self.floor = lexicon, trees, calibration, floor

    def worst(self, texts: list[str]) -> tuple[np.ndarray, list[str | None]]:
        """The raw score of each text's worst sentence (-inf for texts without words), and that sentence."""
        best, what = np.full(len(texts), -np.inf), [None] * len(texts)
        for lo, part in parts_of(readable_all(texts)):
            batch = Batch(part)
            found = batch.found
            own, x = self.lexicon.features(batch)
            if not len(own):
                continue
            score, doc = self.trees.score(x), found.text[own]
            order = np.lexsort((-score, doc))
            for i in order[np.diff(doc[order], prepend=-1) > 0]:
                best[lo + doc[i]], what[lo + doc[i]] = score[i], found.string(part, own[i]).strip()
        return best, what

    def rate(self, raw: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(raw), self.calibration(np.where(np.isfinite(raw), raw, 0)), self.floor)


class Terms:
    """Which term each place of the sample holds, by document and sentence, and the terms of each document once."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, sentence: np.ndarray, n: int):
        order = np.argsort(doc, kind="stable")
        self.term, self.sentence, self.n = term[order], sentence[order], n
        self.at = np.searchsorted(doc[order], np.arange(doc.max(initial=-1) + 2))
        once = np.unique(doc.astype(np.int64) * n + term)
        self.once_doc, self.once = once // n, (once % n).astype(np.int32)

    def odds(self, label: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Smoothed log-odds of the label for every term that enough documents have, else 0.

        ``label`` is -1 for documents that don't count. A marked document with a worst sentence counts as two: that sentence,
        marked, and the others, unmarked.
        """
        count = lambda which: np.bincount(self.once[which[self.once_doc]], minlength=self.n)
        whole = (label == 1) & (worst < 0)
        bad = count(whole)
        n = bad + count(label == 0)
        split = np.flatnonzero((label == 1) & (worst >= 0))
        for k in split:
            own = slice(self.at[k], self.at[k + 1])
            mine = self.sentence[own] == worst[k]
            for part, marked in ((self.term[own][mine], 1), (self.term[own][~mine], 0)):
                part = np.unique(part)
                n[part] += 1
                bad[part] += marked
        total, marks = (label >= 0).sum() + len(split), (label == 1).sum()
        rate = min(max(marks / max(1, total), 1e-3), 1 - 1e-3)
        odds = np.log((bad + PRIOR * rate) / (n - bad + PRIOR * (1 - rate))) - np.log(rate / (1 - rate))
        return np.where(n >= SUPPORT, odds, 0.0)


class Lessons:
    """The sample as the lexicon is learned from it: words and pairs by document, and what each document is taken for.

    ``groups`` are documents whose features are asked for together. ``label`` is -1 for documents that teach nothing,
    ``worst`` the sentence of a marked document that is marked alone, or -1.
    """

    def __init__(self, texts: list[str], groups: list[np.ndarray]):
        self.batches = [[(g[lo : lo + len(part)], Batch(part)) for lo, part in parts_of([texts[k] for k in g])] for g in groups]
        self.label, self.worst = np.full(len(texts), -1), np.full(len(texts), -1)
        numbers: dict[str, int] = {"^": 0, "$": 1}
        number = lambda words: np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32)
        seeds = dict.fromkeys(sorted(INSULTS | CONTEMPT | EXPLICIT), 2.0)
        word, doc, sentence = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for docs, batch in chain.from_iterable(self.batches):
            restored = {k: restore(s, seeds)[0] for k, s in batch.suspects.items()}
            keep = ~np.isin(batch.owner, list(restored))
            ids = np.concatenate([number(batch.words)[batch.at][keep], number(chain.from_iterable(restored.values()))])
            owner = np.concatenate([batch.owner[keep], np.repeat(list(restored), [len(v) for v in restored.values()])]).astype(int)
            order = np.argsort(owner, kind="stable")
            ids, owner, text = ids[order], owner[order], batch.found.text
            word.append(ids)
            doc.append(docs[text[owner]].astype(np.int32))
            sentence.append((owner - np.searchsorted(text, text[owner])).astype(np.int32))
        ids, doc, sentence = np.concatenate(word), np.concatenate(doc), np.concatenate(sentence)
        self.names = list(numbers)
        self.words = Terms(ids, doc, sentence, len(numbers))
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])])[: len(ids)]
        last = np.append(new[1:], True)[: len(ids)]
        left = np.where(new, 0, np.concatenate([[0], ids[:-1]])[: len(ids)])
        codes = np.concatenate([left.astype(np.int64) << 32 | ids, ids[last].astype(np.int64) << 32 | 1])
        self.pair_codes, pair = np.unique(codes, return_inverse=True)
        self.pairs = Terms(pair.astype(np.int32), np.concatenate([doc, doc[last]]), np.concatenate([sentence, sentence[last]]), max(1, len(self.pair_codes)))

    def lexicon(self, docs: np.ndarray) -> Lexicon:
        """What the documents (flags) teach."""
        label = np.where(docs, self.label, -1)
        w, p = self.words.odds(label, self.worst), self.pairs.odds(label, self.worst)
        names, codes = self.names, self.pair_codes
        return Lexicon(
            {names[k]: float(w[k]) for k in np.flatnonzero(w).tolist()},
            {f"{names[codes[k] >> 32]} {names[codes[k] & 0xFFFFFFFF]}": float(p[k]) for k in np.flatnonzero(p[: len(codes)]).tolist()},
        )

    def features(self, lexicon: Lexicon, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, sentence and features of each sentence with words of a group."""
        doc, sentence, x = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros((0, FEATURES))]
        for docs, batch in self.batches[group]:
            own, features = lexicon.features(batch)
            text = batch.found.text
            doc.append(docs[text[own]])
            sentence.append(own - np.searchsorted(text, text[own]))
            x.append(features)
        return np.concatenate(doc), np.concatenate(sentence), np.concatenate(x)


def worst_of(owner: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The row of the highest score of each owner."""
    order = np.lexsort((-score, owner))
    return order[np.diff(owner[order], prepend=-1) > 0]


def train(rows: list[tuple[str, float | None, float]], seed: int = 3) -> AbuseModel:
    """A model from (text, label of the document or None, documents that the row stands for) rows.

    Labels are of documents, so the lexicon is learned in rounds: first from whole documents, then with only the worst
    sentence of each marked document as marked, which frees the words around it. Documents without a label join from the
    second round on, marked if the trees are sure of them; they teach the lexicon words, never the trees or the calibration.
    Features for the trees are crossed: a labelled document's come from a lexicon that was learned without it. The trees are
    fitted thrice, each time without a third of the documents, which calibrate; the model has all of them.
    """
    if len({r[1] for r in rows} - {None}) < 2:
        raise ValueError("labels of both kinds are needed")
    texts = readable_all([r[0] for r in rows])
    rated = np.array([r[1] is not None for r in rows])
    y, weight = np.array([r[1] or 0.0 for r in rows]), np.array([r[2] for r in rows])
    rng = np.random.default_rng(seed)
    fold, third = rng.random(len(texts)) < 0.5, rng.integers(0, 3, len(texts))
    lessons = Lessons(texts, [np.flatnonzero(rated & ~fold), np.flatnonzero(rated & fold), np.flatnonzero(~rated)])
    lessons.label[rated] = y[rated]
    del texts

    def crossed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = [lessons.features(lessons.lexicon((fold != side) | ~rated), int(side)) for side in (False, True)]
        return tuple(np.concatenate(x) for x in zip(*both))

    known: dict[tuple[int, int], float] = {}
    for turn in range(ROUNDS):
        owner, number, x = crossed()
        places = list(zip(owner.tolist(), number.tolist()))
        score = x[:, 4] + x[:, 5] + x[:, 0] if not known else np.array([known[k] for k in places])
        loud = (x[:, 0] > HOT) | (x[:, 4] > HOT) | (x[:, 13] > 0) | (x[:, 16] > 0) | (x[:, 17] > 0)
        lot = rng.random(len(x)) < 1 / QUIET
        parts: list[Ensemble] = []
        for again in (True, False):
            top = worst_of(owner, score)
            # sentences of unmarked documents are negatives, of a marked one the worst is a positive and the others tell nothing
            use = np.concatenate([top[y[owner[top]] > 0], np.flatnonzero((y[owner] == 0) & (loud | lot))])
            if again:
                part = use[third[owner[use]] != 0]
                score = _fit(x[part], y[owner[part]] > 0, loud[part], 1).score(x)
                continue
            for k in range(3):
                part, rest = use[third[owner[use]] != k], third[owner] == k
                parts.append(_fit(x[part], y[owner[part]] > 0, loud[part], 3 if turn == ROUNDS - 1 else 1))
                score[rest] = parts[-1].score(x[rest])
        trees = Ensemble.of(parts)
        if turn == ROUNDS - 1:
            break
        fitted = trees.score(x)  # what was learned by heart may teach; it never calibrates
        known = dict(zip(places, fitted.tolist()))
        lessons.label[rated & (y > 0)] = -1  # marked, but maybe nothing in it tells why
        for i in worst_of(owner, fitted):
            if y[owner[i]] > 0 and fitted[i] > LIKELY:
                lessons.label[owner[i]], lessons.worst[owner[i]] = 1, number[i]
        if not rated.all():
            doc, which, z = lessons.features(lessons.lexicon(np.ones(len(rated), bool)), 2)
            sure = trees.score(z)
            lessons.label[~rated] = -1
            for i in worst_of(doc, sure):
                if sure[i] > SURE or sure[i] < 0:
                    lessons.label[doc[i]], lessons.worst[doc[i]] = int(sure[i] > SURE), which[i]
    best = np.full(len(rated), -np.inf)
    np.maximum.at(best, owner, score)
    some, none = rated & np.isfinite(best), rated & ~np.isfinite(best)
    floor = float(((y * weight)[none].sum() + 0.05) / (weight[none].sum() + 1))
    calibration = Isotonic().fit(best[some], y[some], weight[some]) if y[some].sum() >= 5 else logistic
    return AbuseModel(lessons.lexicon(np.ones(len(rated), bool)), trees, calibration, floor)


def _fit(x: np.ndarray, marked: np.ndarray, loud: np.ndarray, members: int) -> Ensemble:
    return Ensemble(members, least=int(np.clip(marked.sum() // 8, 3, 12)), rounds=50, prior=prior).fit(x, marked.astype(float), np.where(loud | marked, 1.0, QUIET))


def logistic(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-score))


def train_on(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "toxic", sample: int = SAMPLE) -> AbuseModel:
    """Fit on at most about ``sample`` documents, picked by a hash of their id: rated ones, and if those are fewer, others too.

    Raters are averaged, and a tie counts as marked. Up to a third of the sample are marked documents, which are rarer; the
    calibration weighs each row by the documents that it stands for.
    """
    rated = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("rec_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    n = {x.y: x["count"] for x in rated.groupBy("y").count().collect()}
    bad = min(n.get(1.0, 0), sample // 3)
    share = {1.0: bad / max(1, n.get(1.0, 0)), 0.0: min(1.0, (sample - bad) / max(1, n.get(0.0, 0)))}
    lot = F.pmod(F.xxhash64("rec_id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    picked = rated.where(lot < F.when(F.col("y") > 0, share[1.0]).otherwise(share[0.0]))
    # the picked labels are about ``sample`` rows; should they be far more, the least hashes stay, so a run can be repeated
    picked = picked.orderBy(F.xxhash64("rec_id"), "rec_id").limit(2 * sample)
    texts = docs.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).cast("string").alias("text")).where(F.char_length("text").between(1, SAMPLE_CHARS))
    known = texts.join(F.broadcast(picked), "rec_id")
    taken = sum(int(n.get(k, 0) * v) for k, v in share.items())
    room = min(sample - taken, UNRATED * taken)
    if room > 0:
        more = texts.where(lot < min(1.0, room / max(1, docs.count()))).join(F.broadcast(picked.select("rec_id")), "rec_id", "left_anti")
        known = known.unionByName(more.withColumn("y", F.lit(None).cast("double")))
    # a repeated id counts once, so the sample is as bounded as said
    rows = known.groupBy("rec_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("rec_id").limit(3 * sample).select("text", "y").collect()
    return train([(x.text, x.y, 1.0 if x.y is None else 1 / max(share[x.y], 1e-9)) for x in rows])


def score_documents(docs: DataFrame, id_col: str, text_col: str, model: AbuseModel, keep: list[str] | None = None) -> DataFrame:
    """``<id_col>, <keep>, score, worst``: calibrated score of every document and its worst sentence.

    Null, empty and blank texts have score 0 and no sentence, texts without words the rate of such documents and no sentence. Repeated rows are scored again; other columns aren't read.
    """
    keep = keep or []
    state = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by the sample it was fitted on

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        own: AbuseModel = pickle.loads(state.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 2000):
                part = texts[lo : lo + 2000]
                raw, worst = own.worst([t or "" for t in part])
                score = np.where([bool(t and t.strip()) for t in part], own.rate(raw), 0.0)
                yield {id_col: batch.column(0).slice(lo, len(part)), "score": score, "worst": worst} | {c: batch.column(2 + k).slice(lo, len(part)) for k, c in enumerate(keep)}

    rows = docs.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).cast("string").alias(c) for c in keep])
    return map_arrow(spread(rows), run, f"`{id_col}` long, score double, worst string" + "".join(f", `{c}` string" for c in keep))


def source_rates(scored: DataFrame, source_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``source, n_docs, n_flagged, rate, mean_score`` by source, without regard to case and outer blanks; null is a source of its own."""
    key = F.lower(F.trim(F.col(source_col))).alias("source")
    flagged = (F.col("score") >= threshold).cast("long")
    return scored.groupBy(key).agg(F.count("*").alias("n_docs"), F.sum(flagged).alias("n_flagged"), F.avg(flagged).alias("rate"), F.avg("score").alias("mean_score"))
