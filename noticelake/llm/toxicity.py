"""Toxicity from a weighted lexicon, matched by Aho-Corasick in folded text.

Folding undoes the usual disguises: compatibility forms, accents, invisible
characters, Cyrillic and Greek homoglyphs, digits and signs in place of letters
within a word; i and l become one letter.  Entries
are whole words or word beginnings (a stem with any ending).

The lexicon is learned: a term's weight is the lower confidence bound of its
log odds between toxic and clean training documents, by documents.  Seed words
stay at a fixed weight unless the training documents speak against them.
Exception phrases (fixed ones, and word pairs around an entry that occur in
clean documents alone) cancel the hits inside them.  A text's hits are summed
by weight and normalised by its length; a logistic curve over the sum, the
density and the number of different entries gives the score.

Bounds: lexicon and curve are fitted on at most about ``TRAIN_ROWS`` and
``CURVE_ROWS`` labelled documents, chosen by a hash of their id.  An entry stands
in a two-hundredth of the toxic ones at least and a phrase in a two-thousandth of
the clean ones, so what is sent to the executors doesn't grow with the corpus.
A word of ``LONG_WORD`` letters or more counts by its beginnings alone.

Defined results: a null or empty text has no hits and the curve's value there;
a null or other label than 0 or 1 doesn't train; an id with different labels is
toxic; without labelled documents of both kinds the seed words and a fixed curve
are used.  Rows that repeat an id are scored one by one.  Texts are matched
whole, however long; of entries that start at one place the heaviest counts
(the first found of equal ones), and overlapping ones each count.  An empty
table gives no rows.  Other columns pass through; where one is called as the
new column, that gets an underscore before its name.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import free_names, keep

TRAIN_ROWS = 100_000
CURVE_ROWS = 50_000
LONG_WORD = 40
PREFIXES = (4, 5, 6, 7)
LEAST_BOUND = 3.0
SEED_WEIGHT = 3.0

# Seed words and exception phrases.
SEEDS = "asshole bastard bitch clown cretin disgusting dumbass filthy idiot imbecile jerk loser moron pathetic scum stupid trash worthless".split()
EXCEPTIONS = ["trash can", "trash bin", "clown fish", "class clown", "white trash bag", "sore loser board"]
# Letters that look like a Latin one.
CYRILLIC = dict(zip("авезікмнорсѕтухһӏјԁԛԝ", "abeeikmhopcstyxhljdqw", strict=True))
OTHERS = dict(zip("ɡıոս", "ginu", strict=True))
GREEK = dict(zip("αβεικνορτυχγω", "abeikvoptuxyw", strict=True))
LETTERS = str.maketrans(CYRILLIC | GREEK | OTHERS)
SIGNS = str.maketrans("01345789@$!|+€£", "oieastbgasiitel")
ONE = str.maketrans("l", "i")

_HIDDEN = re.compile("[­​-‏⁠-⁤︀-️﻿]|[̀-ͯ]")
_STRANGE = re.compile("[ɐ-ʯıͰ-֏]")
_SIGN = re.compile(r"(?<=[^\W\d_])[0134578@$!|+€£9]+(?=[^\W\d_])|(?<![^\W_])[0134578@$9]+(?=[^\W\d_])|(?<=[^\W\d_]{2})[0134578$]+(?![^\W_])")
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The text in folded words, with one space around each."""
    text = text or ""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
        if not text.isascii():
            text = text.casefold()
            if _STRANGE.search(text):
                text = text.translate(LETTERS)
    text = text.lower()
    text = _SIGN.sub(lambda m: m[0].translate(SIGNS), text)
    return f" {_GAP.sub(' ', text).translate(ONE).strip()} "


def terms(folded: str) -> set[str]:
    """The whole words (`` word ``) and word beginnings (`` wor``) of a text."""
    out = set()
    for word in set(folded.split()):
        if len(word) > 2:
            if len(word) < LONG_WORD:
                out.add(f" {word} ")
            out.update([f" {word[:k]}" for k in PREFIXES if k < len(word)])
    return out


def held_out(ident: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % 5 == 0


def training(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``id, toxic, folded`` of the documents to learn from."""
    known = labels.where("toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    part = min(1.0, rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < round(part * 1_000_000))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fold(t) for t in batch.column(2).to_pylist()])], ["id", "toxic", "folded"])

    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
    found = found.join(F.broadcast(known), "id").select("id", "toxic", "t")  # about `rows` rows of two numbers
    return keep(found.mapInArrow(run, "id long, toxic int, folded string"), "training")


def _counted(rows: DataFrame, column: str, of) -> DataFrame:
    """(term, documents) by counting in each task first."""

    def run(batches):
        count: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])
            count.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                count.update(of(text))
                if len(count) > 200_000:
                    yield flush()
        if count:
            yield flush()

    return rows.select(column).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Lexicon:
    """Weighted entries and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.weights, self.exceptions, self._automaton = weights, exceptions, None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "_automaton": None}

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the entries in a folded text, the heaviest at
        each place, without those in an exception phrase."""
        import ahocorasick

        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                self._automaton.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(phrase, (len(phrase), None))
            if len(self._automaton):
                self._automaton.make_automaton()
        if not len(self._automaton):
            return []
        found: dict[int, tuple[int, float]] = {}
        spans = []
        for end, (size, weight) in self._automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                spans.append((start, end))
            elif start not in found or found[start][1] < weight:
                found[start] = (end, weight)
        return [(a, b, w) for a, (b, w) in found.items() if not any(s <= a and b <= e for s, e in spans)]

    def features(self, folded: str) -> list[float]:
        found = self.hits(folded)
        words = max(1, folded.count(" ") - 1)
        total = sum(w for _, _, w in found)
        different = len({folded[a:b] for a, b, _ in found})
        return [np.log1p(total), np.log1p(1000 * total / (words + 50)), np.log1p(different), float(bool(found))]


def learn(train: DataFrame) -> Lexicon:
    """The lexicon of the training documents."""
    seeds = {f" {fold(w).strip()} ": SEED_WEIGHT for w in SEEDS}
    count = dict(train.groupBy("toxic").count().collect())
    bad, good = count.get(1, 0), count.get(0, 0)
    phrases = [fold(p) for p in EXCEPTIONS]
    if not bad or not good:
        return Lexicon(seeds, phrases)
    least = max(3, round(0.005 * bad))  # so there are at most 200 terms for each one of a document
    found = dict(_counted(train.where("toxic = 1"), "folded", terms).where(F.col("n") >= least).collect())
    known = frozenset(found) | frozenset(seeds)
    clean = dict(_counted(train.where("toxic = 0"), "folded", lambda t: terms(t) & known).collect())
    bounds = {}
    for term in known:
        p, n = found.get(term, 0), clean.get(term, 0)
        odds = np.log((p + 0.5) / (bad - p + 0.5)) - np.log((n + 0.5) / (good - n + 0.5))
        bounds[term] = float(odds - 1.64 * np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5)))
    widest: dict[str, int] = {}  # the most frequent word with a beginning
    for term in found:
        if term.endswith(" "):
            for k in PREFIXES:
                widest[term[: k + 1]] = max(widest.get(term[: k + 1], 0), found[term])
    kept: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t.strip()), t)):
        word = term.strip()
        stem = max((kept[f" {word[:k]}"] for k in PREFIXES if k <= len(word) and f" {word[:k]}" in kept), default=-1.0)
        if not term.endswith(" ") and found[term] < 1.3 * widest.get(term, 0):
            continue  # one word makes up the beginning
        if bounds[term] >= LEAST_BOUND and bounds[term] > stem + 0.5:
            kept[term] = bounds[term]
    kept = dict(sorted(kept.items(), key=lambda x: (-x[1] * found[x[0]], x[0])))
    for term, weight in seeds.items():
        if term not in kept and clean.get(term, 0) <= max(2, found.get(term, 0)):
            kept[term] = weight
    lexicon = Lexicon(kept, phrases)

    def pairs(text):
        out = set()
        for a, b, _ in lexicon.hits(text):
            end = text.find(" ", b) if text[b] != " " else b
            before, after = text.rfind(" ", 0, a) if a else -1, text.find(" ", end + 1)
            if before >= 0:
                out.add(text[before : end + 1])
            if after > 0:
                out.add(text[a : after + 1])
        return out

    often = max(5, round(0.0005 * good))  # at most 2,000 pairs for each one of a document
    usual = dict(_counted(train.where("toxic = 0"), "folded", pairs).where(F.col("n") >= often).collect())
    if usual:
        shown = frozenset(usual)
        toxic = dict(_counted(train.where("toxic = 1"), "folded", lambda t: pairs(t) & shown).collect())
        phrases += sorted((p for p in usual if usual[p] >= 4 * good / bad * toxic.get(p, 0) + often), key=lambda p: (-usual[p], p))
    return Lexicon(kept, phrases)


DEFAULT_CURVE = [-4.0, 2.0, 0.5, 0.8, 0.5]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps, with a ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    slope = w[1:] / scale
    return [float(w[0] - slope @ mean), *map(float, slope)]


def curve(train: DataFrame, lexicon: Lexicon, rows: int = CURVE_ROWS) -> list[float]:
    """Coefficients of the score, from about ``rows`` training documents at most,
    chosen by a hash of their id."""

    def run(batches):
        for batch in batches:
            x = np.array([lexicon.features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, k]) for k in range(4)]], ["toxic", "a", "b", "c", "d"])

    part = min(1.0, rows / max(1, train.count()))
    some = train.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) < round(part * 1_000_000))
    found = np.array(some.select("toxic", "folded").mapInArrow(run, "toxic int, a double, b double, c double, d double").collect(), float).reshape(-1, 5)
    y = found[:, 0]
    return fit(found[:, 1:], y) if 0 < y.sum() < len(y) else DEFAULT_CURVE


def score(docs: DataFrame, lexicon: Lexicon, coefficients: list[float], text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) as its last column."""
    names, (new,) = docs.columns, free_names(docs, "score")
    at = names.index(text_col)
    intercept, slope = coefficients[0], np.array(coefficients[1:])

    def run(batches):
        for batch in batches:
            x = np.array([lexicon.features(fold(t)) for t in batch.column(at).cast(pa.string()).to_pylist()], float).reshape(-1, 4)
            value = 1 / (1 + np.exp(-np.clip(intercept + x @ slope, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array(value)], [*names, new])

    schema = T.StructType([*docs.schema.fields, T.StructField(new, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def model(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, list[float]]:
    """Lexicon and curve, learned from the labelled documents."""
    train = training(docs, labels)
    lexicon = learn(train)
    return lexicon, curve(train, lexicon)
