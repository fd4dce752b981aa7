"""Language of documents and of the one-language stretches in them.

A nearest-centroid classifier: words give character n-grams of one to four characters with word ends, n-grams are
hashed to TF-IDF features, and the normalised vector of a text is compared by cosine with several k-means centroids per
language; the language of the nearest centroid is the text's. A text that lies much further from it than held-out texts of that
language and about that length do, and isn't clearly nearer to it than to all others, is rejected. Dot products are sums over words, so every worker keeps the dot products of
each word with all centroids and adds them up; the length of a vector is worked out from its features.

Sentences of a document whose nearest languages differ are segmented by dynamic programming over languages with a price for
each change, and words within a sentence likewise where they speak for another language strongly enough.

The classifier is trained on a bounded sample of labelled rows (``SAMPLE``, ``SENTENCES``, ``RARE_SENTENCES``), cleaned by
dropping sentences that lie nearer to another language's mean and languages that keep few. All rows are classified, whole.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import re
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow, spread
from .unify import FOREIGN, LATIN, RARE, UNSTABLE, surveys, unifier

SAMPLE = 250  # labelled documents a language that the classifier is trained on
SENTENCES = 350  # of those documents, that the model of a language is fitted on
RARE_SENTENCES = 100  # the same for a label that is rare (``RARE``)
SAMPLE_CHARS = 8_000  # longer documents aren't taken into that sample
FEATURES = 1 << 13
CENTROIDS = 3
RESTARTS = 8  # clusterings tried
ROUNDS = 3  # of cleaning
TRIM = 0.12  # part of each language's sentences, the least clear ones, that isn't learned from
LEAST_SENTENCES = 20  # labelled sentences that a language must have to be learned
COHESION = 0.8  # a label is a mistake if its sentences are this much as near to another language as to themselves
SHARED = 0.1  # weight left to a feature that two languages have equally
RARE = 30  # a label this much rarer than the most frequent one doesn't decide which features are shared, and is learned from less
CHANGE = 5.0  # price of a change of language between sentences, in units of a usual word's evidence
INNER_CHANGE = 6.0  # price of a change within a sentence
INNER_WORDS = 5  # words that a stretch within a sentence has at least
WORD_EVIDENCE = 2.0  # most that one word can speak for or against a change within a sentence, as a foreign name may stand there
LENGTHS = (3, 6, 12, 25, 50, 100, 200)  # words of the texts that the bounds of rejection are found by
DRAWS = 100  # such texts of each language and length
FAR = 0.01  # part of them that may lie beyond the bound
SLACK = 0.55  # the bound is this part of their cosine
CLEAR = 0.8  # confidence from which a text beyond the bound still is its language's, as it lies far from all others
MOST_LANGUAGES = 20_000  # rows of the table of languages
CACHE = 300_000  # words remembered by a worker
TOKEN = regex.compile(r"[\p{L}\p{M}]+|[.!?\n]")
MIXED_SCRIPT = re.compile(f"[A-Za-zÀ-ɏ][Ͱ-ԯ{RARE}]|[Ͱ-ԯ{RARE}][A-Za-zÀ-ɏ]")


def readable(text: str) -> str:
    """Disguised characters undone, so that words are words again."""
    if text.isascii():
        return text
    own = unifier()
    if MIXED_SCRIPT.search(text):
        return own.form(text)
    return own.text(text)


def readable_all(texts: list[str]) -> list[str]:
    """``readable`` of each text; one table lookup finds the few that need work."""
    out = list(texts)
    for lo, _, kind, starts in surveys(texts):
        seen = np.bitwise_or.reduceat(kind, starts)
        for k in np.flatnonzero((seen & UNSTABLE > 0) | (seen & (FOREIGN | LATIN) == FOREIGN | LATIN)):
            out[lo + k] = readable(texts[lo + k])
    return out


def ngram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, and the word that each belongs to."""
    data = "".join(f"_{w}_" for w in words)
    codes = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters from here to the word's end
    features, owners = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, 5):
            h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
            ok = left[: len(h)] >= n
            x = (h[ok] ^ (h[ok] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            features.append((x >> np.uint64(51)).astype(np.int32))
            owners.append(owner[: len(h)][ok])
    return np.concatenate(features), np.concatenate(owners)


class Model:
    """Centroids as a matrix of feature by (language, cluster) with the IDF applied, the IDF, and the bounds of rejection."""

    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, unit: float = 1.0, bounds: np.ndarray | None = None):
        self.languages, self.weights, self.idf, self.unit = languages, weights, idf, unit
        self.bounds = np.zeros((len(languages), len(LENGTHS))) if bounds is None else bounds
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {c: 0 for c in ".!?\n"}
        self.rows = np.zeros((1024, self.weights.shape[1]), np.float32)
        self.at, self.grams = np.zeros(1025, np.int64), np.zeros(0, np.uint16)  # features of each word, end to end
        self.n = 1

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("languages", "weights", "idf", "unit", "bounds")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        if not new:
            return
        if self.n + len(new) > len(self.rows):
            more = max(len(self.rows), len(new))
            self.rows = np.concatenate([self.rows, np.zeros((more, self.rows.shape[1]), np.float32)])
            self.at = np.concatenate([self.at, np.zeros(more, np.int64)])
        grams = [self.grams]
        for k in range(0, len(new), 4000):
            part = new[k : k + 4000]
            features, owner = ngram_features(part)
            order = np.argsort(owner, kind="stable")
            starts = np.searchsorted(owner[order], np.arange(len(part) + 1))
            self.rows[self.n : self.n + len(part)] = np.add.reduceat(self.weights[features[order]], starts[:-1], axis=0)
            self.at[self.n : self.n + len(part) + 1] = self.at[self.n] + starts
            grams.append(features[order].astype(np.uint16))
            for w in part:
                self.ids[w] = self.n
                self.n += 1
        self.grams = np.concatenate(grams)

    def words(self, clean: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By word of readable texts: its number, its sentence, its text. Sentences count through all texts."""
        if self.n > CACHE:
            self.reset()
        found = [TOKEN.findall(t.lower()) for t in clean]
        flat = list(chain.from_iterable(chain.from_iterable((f, (".",)) for f in found)))
        self.learn(flat)
        ids = np.fromiter(map(self.ids.__getitem__, flat), np.int32, len(flat))
        text = np.repeat(np.arange(len(clean)), [len(f) + 1 for f in found])
        ends = ids == 0
        sentence = np.cumsum(ends) - ends
        word = ~ends
        return ids[word], sentence[word], text[word]

    def sums(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Dot products with all centroids of the words from each start to the next."""
        total = np.empty((len(starts), self.rows.shape[1]), np.float32)
        for k in range(0, len(starts), 4000):  # bounded memory
            lo, hi = starts[k], starts[k + 4000] if k + 4000 < len(starts) else len(ids)
            total[k : k + 4000] = np.add.reduceat(self.rows[ids[lo:hi]], starts[k : k + 4000] - lo, axis=0)
        return total

    def lengths(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Lengths of the TF-IDF vectors of the words from each start to the next."""
        out, ends, square = np.empty(len(starts)), np.append(starts[1:], len(ids)), (self.idf**2).astype(np.float32)
        for k in range(0, len(starts), 128):
            lo, hi = starts[k], ends[min(k + 128, len(starts)) - 1]
            n = min(128, len(starts) - k)
            table = np.zeros((n, FEATURES), np.float32)
            owner = np.repeat(np.arange(n), (ends - starts)[k : k + n])
            for a in range(lo, hi, 50_000):  # a text may be long
                own = ids[a : min(a + 50_000, hi)]
                size = self.at[own + 1] - self.at[own]
                place = np.repeat(self.at[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                key = np.repeat(owner[a - lo : a - lo + len(own)] * FEATURES, size) + self.grams[place]
                table += np.bincount(key, minlength=n * FEATURES).reshape(n, FEATURES)
            out[k : k + n] = (table**2) @ square
        return np.maximum(np.sqrt(out), 1e-6)

    def evidence(self, dots: np.ndarray) -> np.ndarray:
        """What sums speak for each language, for the search of stretches: nearness to its best centroid and to all of them."""
        each = dots.reshape(len(dots), len(self.languages), CENTROIDS)
        return 0.5 * each.max(2) + 0.5 * each.mean(2)

    def decide(self, cosines: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of the nearest centroid (-1: rejected) and the confidence of texts of ``n`` words by their cosines with all centroids."""
        near = cosines.reshape(len(cosines), len(self.languages), CENTROIDS).max(2)
        best, sure = near.argmax(1), confidence(near)
        return np.where((near.max(1) >= self.bound(best, n)) | (sure >= CLEAR), best, -1), sure

    def bound(self, language: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The least cosine of a text of ``n`` words of a language; shorter texts than the shortest known aren't rejected."""
        at = np.interp(np.log(np.maximum(n, 1)), np.log(LENGTHS), np.arange(len(LENGTHS)))
        k = np.minimum(at.astype(int), len(LENGTHS) - 2)
        low = self.bounds[language, k] * (k + 1 - at) + self.bounds[language, k + 1] * (at - k)
        return np.where(n < LENGTHS[0], 0.0, low)

    def stretches(self, gain: np.ndarray, price: float) -> np.ndarray:
        """The language of each step by what it speaks for each: most evidence, less ``price`` for each change."""
        best, back = gain[0].copy(), np.zeros((len(gain), gain.shape[1]), int)
        for k in range(1, len(gain)):
            top = int(best.argmax())
            stay = best >= best[top] - price
            back[k] = np.where(stay, np.arange(len(best)), top)
            best = np.where(stay, best, best[top] - price) + gain[k]
        out = np.empty(len(gain), int)
        out[-1] = best.argmax()
        for k in range(len(gain) - 1, 0, -1):
            out[k - 1] = back[k, out[k]]
        return out


def confidence(cosines: np.ndarray) -> np.ndarray:
    """Softmax of the cosines, sharpened: 1 for a clear winner, 1/languages for none."""
    z = np.exp(40 * (cosines - cosines.max(1, keepdims=True)))
    return 1 / z.sum(1)


def _sentence_vectors(texts: list[str]) -> np.ndarray:
    """Dense count vectors of sentences (training only)."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for k, t in enumerate(texts):
        words = regex.findall(r"[\p{L}\p{M}]+", t.lower())
        if words:
            np.add.at(out[k], ngram_features(words)[0], 1)
    return out


def _means(groups: list[np.ndarray]) -> np.ndarray:
    middle = np.stack([v.mean(0) for v in groups])
    return middle / np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-6)


def _clusters(groups: list[np.ndarray], rng: np.random.Generator) -> list[np.ndarray]:
    """k-means centroids of unit vectors for each language, from spread-out starts."""
    out = []
    for v in groups:
        c = v[rng.integers(len(v))][None]
        while len(c) < CENTROIDS:  # the next start is a sentence far from all starts so far
            far = np.maximum(1 - (v @ c.T).max(1), 0) ** 2 + 1e-9
            c = np.concatenate([c, v[rng.choice(len(v), p=far / far.sum())][None]])
        for _ in range(8):
            own = (v @ c.T).argmax(1)
            c = np.stack([v[own == j].mean(0) if (own == j).any() else c[j] for j in range(CENTROIDS)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-6)
        out.append(c)
    return out


def _worst_margin(groups: list[np.ndarray], centres: list[np.ndarray]) -> float:
    """How much nearer the hardest half per cent of the sentences are to their own language than to the next."""
    margins = []
    for j, v in enumerate(groups):
        near = np.stack([(v @ c.T).max(1) for c in centres], 1)
        own = near[:, j].copy()
        near[:, j] = -1
        margins.append(own - near.max(1))
    return float(np.quantile(np.concatenate(margins), 0.005))


def _genuine(x: dict[str, np.ndarray], sizes: dict[str, int], rate: np.ndarray) -> np.ndarray:
    """Rates of the labels that aren't rare; a rare label may be another language's by mistake."""
    most = max(sizes.get(k, 0) for k in x)
    keep = [j for j, k in enumerate(x) if sizes.get(k, 0) * RARE >= most]
    return rate[keep] if len(keep) > 1 else rate


def train(rows: Iterable[tuple[str, str]], sizes: dict[str, int] | None = None, seed: int = 5, most: int = SENTENCES, rare: int = RARE_SENTENCES) -> Model:
    """A model from (language, text) rows; ``most`` sentences of each language are used, ``rare`` of a label that is rare.

    ``sizes`` says how many rows the whole table has of each label, if ``rows`` are a sample.
    """
    by: dict[str, list[str]] = {}
    rows = list(rows)
    sizes = sizes or Counter(lang for lang, _ in rows)
    for lang, text in rows:
        by.setdefault(lang, []).extend(s for s in re.split(r"[.!?\n]+", readable(text)) if len(s) > 25)
    rng = np.random.default_rng(seed)
    languages = sorted(k for k, v in by.items() if len(v) >= LEAST_SENTENCES)
    if not languages:
        raise ValueError("no language has enough labelled text to learn from")
    top = max(sizes.get(k, 0) for k in languages)
    picks = {k: [by[k][i] for i in rng.permutation(len(by[k]))[: most if sizes.get(k, 0) * RARE >= top else rare]] for k in languages}
    x = {k: _sentence_vectors(v) for k, v in picks.items()}
    rate = np.stack([(v > 0).mean(0) for v in x.values()])  # of the sentences of each label that have a feature
    idf = np.log(1 / np.maximum(rate.mean(0), 1e-3)) + 0.3
    if len(rate) > 1:  # what two languages share tells little about either
        first, second = -np.sort(-_genuine(x, sizes, rate), axis=0)[:2]
        idf *= SHARED + np.where(first > 0, (first - second) / np.maximum(first, 1e-6), 0)
    idf = idf.astype(np.float32)
    for v in x.values():
        np.log1p(v, out=v)
        v *= idf
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)
    # wrong labels: from the rarest on, a label whose sentences lie about as near to another language's mean as to their
    # own was only ever set by mistake; then the sentences least on their language's side are dropped, as some are mislabelled
    for k in sorted(x, key=lambda k: sizes.get(k, 0)):
        others = [j for j in x if j != k]
        if not others:
            break
        middle = _means([x[j] for j in others])
        other, own = np.median((x[k] @ middle.T).max(1)), np.median(x[k] @ _means([x[k]])[0])
        if other > COHESION * own:
            del x[k]
    languages, groups = list(x), list(x.values())
    for _ in range(ROUNDS):
        middle = _means(groups)
        cleaner = []
        for j, k in enumerate(languages):
            near = x[k] @ middle.T
            own = near[:, j].copy()
            near[:, j] = -1
            margin = own - near.max(1) if len(languages) > 1 else own
            cleaner.append(x[k][margin > max(0.0, np.quantile(margin, TRIM))])
        groups = [c if len(c) >= CENTROIDS else g for c, g in zip(cleaner, groups)]
    # of several clusterings the one whose hardest sentences are furthest on the right side
    centres = max((_clusters(groups, rng) for _ in range(RESTARTS)), key=lambda c: _worst_margin(groups, c))
    flat = np.concatenate(centres)
    model = Model(languages, (flat.T * idf[:, None]).astype(np.float32), idf)
    gaps = []
    for j, k in enumerate(languages):
        ids, sentence, _ = model.words(picks[k][:60])
        starts = np.flatnonzero(np.diff(sentence, prepend=-1))
        dots = model.evidence(model.sums(ids, starts))
        gaps.append((dots[:, j] - dots.mean(1)) / np.diff(np.append(starts, len(ids))))
    model.unit = float(np.median(np.concatenate(gaps)))
    model.bounds = np.stack([_bounds(model, j, by[k], picks[k], rng) for j, k in enumerate(languages)])
    model.reset()
    return model


def _bounds(model: Model, language: int, every: list[str], learned: list[str], rng: np.random.Generator) -> np.ndarray:
    """The least cosines of a language's texts by ``LENGTHS``, from its sentences that weren't learned from, if there are enough."""
    known = set(learned)
    held = [t for t in every if t not in known]
    ids, sentence, _ = model.words(held if len(held) >= LEAST_SENTENCES else learned)
    starts = np.flatnonzero(np.diff(sentence, prepend=-1))
    own = model.evidence(model.sums(ids, starts)).argmax(1) == language  # some labels are wrong
    parts = [x for x, mine in zip(np.split(ids, starts[1:]), own) if mine]
    if not parts:
        return np.zeros(len(LENGTHS))
    out = []
    for n in LENGTHS:
        texts = []
        for _ in range(DRAWS):
            text = parts[rng.integers(len(parts))]
            while len(text) < n:
                text = np.concatenate([text, parts[rng.integers(len(parts))]])
            texts.append(text[:n])
        first = np.arange(DRAWS) * n
        flat = np.concatenate(texts)
        near = model.sums(flat, first).reshape(DRAWS, len(model.languages), CENTROIDS).max(2)[:, language] / model.lengths(flat, first)
        out.append(SLACK * np.quantile(near, FAR))
    return np.array(out)


def label_code(label: Column, languages: DataFrame) -> Column:
    """The two-letter code that a label names, or null: by code, ISO codes, names, with or without a region.

    The table of languages is a dimension with a row a language, so its names become a literal map; more than ``MOST_LANGUAGES`` are refused.
    """
    names: dict[str, str] = {}
    rows = languages.select("code", "iso_639_1", "iso_639_2", "iso_639_2_b", "name", "native_name").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    for x in rows:
        for n in x:
            if n:
                names.setdefault(n.strip().lower(), x.code)
    clean = F.lower(F.trim(label))
    table = F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in names.items())) if names else F.create_map(F.lit(""), F.lit(None).cast("string"))
    return F.coalesce(F.try_element_at(table, clean), F.try_element_at(table, F.split(clean, "[-_]")[0]))


def train_on(docs: DataFrame, id_col: str, text_col: str, code: Column, sample: int = SAMPLE, most: int = SENTENCES, rare: int = RARE_SENTENCES) -> Model:
    """Train on ``most`` sentences (``rare`` of a rare label) of about ``sample`` documents a language, picked by a hash of their id."""
    rows = docs.select(F.col(id_col).alias("rec_id"), F.col(text_col).alias("text"), code.alias("lang")).where("lang is not null and text is not null")
    sizes = {x.lang: x["count"] for x in rows.groupBy("lang").count().collect()}
    if not sizes:
        raise ValueError("no labelled text to learn from")
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(int(1e6 * min(1.0, 1.3 * sample / n)) + 1)) for k, n in sizes.items()))
    picked = rows.where((F.pmod(F.xxhash64("rec_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang"))) & F.char_length("text").between(40, SAMPLE_CHARS))
    # the hash picks about 1.3 times ``sample`` a language; should it be far more, the least hashes stay, so a run can be repeated
    rows = picked.orderBy(F.xxhash64("rec_id"), "rec_id").select("lang", "text").limit(2 * sample * len(sizes)).collect()
    return train([(x.lang, x.text) for x in rows], sizes, most=most, rare=rare)


def detect(docs: DataFrame, id_col: str, text_col: str, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``<id_col>, <keep>, seg_no, lang, confidence, start, end``: language of every text and of its stretches.

    ``keep`` names string columns to carry along; other columns aren't read.

    A text in one language gives one row with ``seg_no`` 0; one that mixes languages a row for each longest stretch in
    one language, from 1 in text order. ``start`` and ``end`` are code points of the text as stored; stretches follow each
    other without a gap. Null, empty and blank texts, and texts without letters, give no row; a rejected text or stretch has a
    null ``lang``. Repeated rows repeat.
    """
    keep = keep or []
    state = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # its size is fixed by FEATURES and CENTROIDS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        own: Model = pickle.loads(state.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            kept = {id_col: batch.column(0)} | {c: batch.column(2 + k) for k, c in enumerate(keep)}
            for lo in range(0, len(texts), 1000):
                out = _rows(own, texts[lo : lo + 1000])
                at = pa.array(np.array(out.pop("doc"), np.int64) + lo)
                yield {c: v.take(at) for c, v in kept.items()} | out

    rows = docs.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).cast("string").alias(c) for c in keep])
    ddl = f"`{id_col}` long, " + "".join(f"`{c}` string, " for c in keep) + "seg_no int, lang string, confidence double, start int, end int"
    return map_arrow(spread(rows.where(F.col("text").rlike(r"\S"))), run, ddl)


def _rows(own: Model, texts: list[str]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("doc", "seg_no", "lang", "confidence", "start", "end")}
    clean = readable_all(texts)
    ids, sentence, doc = own.words(clean)
    if not len(ids):
        return out
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    starts = np.flatnonzero(np.diff(sentence, prepend=-1))
    sums = own.sums(ids, starts)
    dots = own.evidence(sums)
    nearest, n_words = dots.argmax(1), np.diff(np.append(first, len(ids)))
    by_text = np.searchsorted(starts, first)
    whole = np.add.reduceat(sums, by_text, axis=0)
    lang, sure = own.decide(whole / own.lengths(ids, first)[:, None], n_words)
    low, high = np.minimum.reduceat(nearest, by_text), np.maximum.reduceat(nearest, by_text)
    inner = _inner(own, ids, starts, nearest)
    maybe = (low != high) | np.logical_or.reduceat(inner, by_text)
    ends, lasts = np.append(first[1:], len(ids)), np.append(by_text[1:], len(starts))
    for k in range(len(first)):
        d = int(doc[first[k]])
        cuts = _cuts(own, ids, starts, dots, inner, first[k], ends[k], by_text[k], lasts[k]) if maybe[k] else []
        parts = [(lang[k], sure[k], 0)]
        if cuts:
            begin = np.array([first[k], *cuts])
            size = np.diff(np.append(begin, ends[k]))
            piece = ids[first[k] : ends[k]]
            cosines = own.sums(piece, begin - first[k]) / own.lengths(piece, begin - first[k])[:, None]
            languages, confidences = own.decide(cosines, size)
            parts = [(languages[0], confidences[0], first[k])]
            for which, c, at in zip(languages[1:], confidences[1:], begin[1:]):
                if which != parts[-1][0]:
                    parts.append((which, c, at))
            if len(parts) == 1:
                parts = [(lang[k], sure[k], 0)]
        edges = [0, *(_offset(texts[d], clean[d], int(at - first[k])) for _, _, at in parts[1:]), len(texts[d])]
        for no, (which, c, _) in enumerate(parts):
            out["doc"].append(d)
            out["seg_no"].append(no + 1 if len(parts) > 1 else 0)
            out["lang"].append(own.languages[which] if which >= 0 else None)
            out["confidence"].append(float(c))
            out["start"].append(edges[no])
            out["end"].append(edges[no + 1])
    return out


def _inner(own: Model, ids: np.ndarray, starts: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    """Sentences in which some run of words speaks for another language than the sentence's by more than a change costs."""
    size = np.diff(np.append(starts, len(ids)))
    out = np.zeros(len(starts), bool)
    which = np.flatnonzero(size >= 2 * INNER_WORDS)
    means = own.rows[: own.n].reshape(own.n, len(own.languages), CENTROIDS).mean(2) / own.unit
    for lo in range(0, len(which), 20_000):
        part = which[lo : lo + 20_000]
        n = size[part]
        row = np.repeat(np.arange(len(part)), n)
        place = np.repeat(starts[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
        gain = means[ids[place]]
        gain = np.clip(gain - gain[np.arange(len(gain)), nearest[part][row]][:, None], -WORD_EVIDENCE, WORD_EVIDENCE)
        # the greatest sum of a run, by sums from the start less the least of those before; a fall between sentences parts them
        total = np.cumsum(gain, 0, np.float64) - 1e4 * row[:, None]
        least = np.minimum.accumulate(np.concatenate([np.zeros((1, total.shape[1])), total[:-1] - 1e4 * (np.diff(row) > 0)[:, None]]) if len(total) else total, 0)
        rise = (total - least).max(1)
        out[part] = np.maximum.reduceat(rise, np.cumsum(n) - n) > INNER_CHANGE
    return out


def _cuts(own: Model, ids: np.ndarray, starts: np.ndarray, dots: np.ndarray, inner: np.ndarray, lo: int, hi: int, a: int, b: int) -> list[int]:
    """Words of one document (from ``lo`` to ``hi``, sentences ``a`` to ``b``) at which its language changes."""
    gain = (dots[a:b] - dots[a:b].mean(1, keepdims=True)) / own.unit
    path = own.stretches(gain, CHANGE)
    found = [(int(starts[a + k]), int(x)) for k, x in enumerate(path)]
    for k in np.flatnonzero(inner[a:b]):
        s, e = starts[a + k], starts[a + k + 1] if a + k + 1 < len(starts) else len(ids)
        words = own.rows[ids[s : min(e, hi)]].reshape(-1, len(own.languages), CENTROIDS).mean(2) / own.unit
        inside = own.stretches(np.clip(words - words[:, path[k]][:, None], -WORD_EVIDENCE, WORD_EVIDENCE), INNER_CHANGE)
        turns = np.flatnonzero(np.diff(inside, prepend=-1))
        if len(turns) > 1 and np.diff(np.append(turns, len(inside))).min() >= INNER_WORDS:
            found = [x for x in found if x[0] != s] + [(int(s + t), int(inside[t])) for t in turns]
    found.sort()
    return [at for (_, before), (at, now) in zip(found, found[1:]) if before != now]


def _offset(stored: str, clean: str, word: int) -> int:
    """The code point of the stored text at which its ``word``-th word (from 0) begins."""
    at = next(islice((m.start() for m in TOKEN.finditer(clean) if m.group() not in ".!?\n"), word, None))
    if stored == clean:
        return at
    # the readable form of a beginning of the text is a beginning of the readable form
    lo, hi = 0, len(stored)
    while lo < hi:
        middle = (lo + hi) // 2
        if len(readable(stored[: middle + 1])) > at:
            hi = middle
        else:
            lo = middle + 1
    return lo


def detect_groups(rows: DataFrame, group_col: str, text_col: str, model: Model) -> DataFrame:
    """``grp, lang, confidence`` of each group of texts (an edition by its units).

    The texts of a group that a worker has together are one vector; a group's cosines are the means of those of its vectors
    by their words. Workers add up by group before the shuffle, so a group of any size costs each task a few rows. Groups
    without words give no row.
    """
    state = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    width = len(model.languages) * CENTROIDS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        own: Model = pickle.loads(state.value)
        total: dict[str, np.ndarray] = {}

        def drain() -> dict:
            return {"grp": list(total), "v": [x.tolist() for x in total.values()]}

        for batch in batches:
            groups, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 5000):
                ids, _, doc = own.words(readable_all(texts[lo : lo + 5000]))
                if not len(ids):
                    continue
                names: dict[str, int] = {}
                owner = np.array([names.setdefault(g, len(names)) for g in groups[lo : lo + 5000]])[doc]
                order = np.argsort(owner, kind="stable")
                ids, owner = ids[order], owner[order]
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                n = np.diff(np.append(first, len(ids)))
                cosines = own.sums(ids, first) / own.lengths(ids, first)[:, None]
                part = np.concatenate([cosines * n[:, None], n[:, None]], 1).astype(np.float64)
                by_id = list(names)
                for k, f in enumerate(first):
                    g = by_id[owner[f]]
                    total[g] = total[g] + part[k] if g in total else part[k]
            if len(total) > 20_000:
                yield drain()
                total = {}
        yield drain()

    texts = rows.select(F.col(group_col).cast("string").alias("grp"), F.col(text_col).cast("string").alias("text")).where("grp is not null and text is not null")
    partial = map_arrow(spread(texts), run, "grp string, v array<double>")
    summed = partial.groupBy("grp").agg(*[F.sum(F.element_at("v", k + 1)).alias(f"v{k}") for k in range(width + 1)])

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        own: Model = pickle.loads(state.value)
        for batch in batches:
            table = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(width + 1)], 1)
            lang, sure = own.decide(table[:, :-1] / table[:, -1:], table[:, -1])
            yield {"grp": batch.column(0), "lang": [own.languages[x] if x >= 0 else None for x in lang], "confidence": sure}

    return map_arrow(summed, finish, "grp string, lang string, confidence double")
