"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, with exception phrases.

Folding: compatibility forms to plain ones (NFKC), lower case, look-alike letters of other scripts and accented letters to plain ones, digits and signs that stand
for letters to those letters, all other signs to blanks; marks without width are taken out; three or more single letters with one blank or sign between are one word. The lexicon has a few fixed words and what is learned from
labelled rows: words, or beginnings of words, whose contexts lie in toxic texts far more often than chance allows.
Contexts (the word before and after) are counted once each, so that copies of one text don't make its words toxic.
An exception phrase cancels the hits inside it: fixed phrases, and longer words around a learned beginning that were
seen in clean texts only. Score: logistic in the net weight of a text and in its weight per word.

Defined cases: null or empty texts have no hits and the score of a text without hits; null labels are no labels; without
toxic rows the fixed lexicon alone decides. Repeated rows are scored each; counts take a context once. Texts of any
length are matched whole.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convan.llm.common import saved

FIT_TOXIC, FIT_CLEAN = 4_000, 8_000  # at most so many labelled rows of each kind fit lexicon and weights
BEGINNINGS = range(4, 8)  # letters of a word's beginning
STARTING_WEIGHT = 3.0  # of a starting word that no labelled text holds

# Words of the starting lexicon and exception phrases.
STARTING_WORDS = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "pathetic", "worthless", "disgusting", "loser", "losers", "imbecile", "retard", "bastard", "bitch", "whore", "asshole", "fuck", "fucking", "dumbass")
EXCEPTION_PHRASES = ("stupid o clock", "pond scum", "soap scum", "trash can", "trash bin", "clown fish", "class clown", "sore loser")
# Look-alikes of a to z in other scripts, accented forms, digits and signs that stand for letters.
LOOKALIKES = {
    "a": "аαáàâäãåāɑ4@", "b": "ЬƄ", "c": "сϲçćč", "d": "ԁɗ", "e": "еεéèêëēėę3€", "g": "ɡ9", "h": "һ", "i": "іιíìîïīı1!|", "j": "јϳ", "k": "κк", "l": "ӏⅼ", "m": "м", "n": "ոñń",
    "o": "оοóòôöõōø0", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕšś5$", "t": "тτ7+", "u": "υսúùûüū", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уүýÿ", "z": "ᴢžź",
}
class _Folding(dict):
    """By code point; what is not listed is found by its Unicode class, once a process."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        kind = unicodedata.category(x)
        # Spacing marks are parts of words in the scripts that have them.
        self[c] = x if x.isalnum() or kind == "Mc" else "" if kind in ("Mn", "Me", "Cf") else " "
        return self[c]


_FOLD: dict[int, str] = _Folding()
_FOLD |= {ord(x): a for a, xs in LOOKALIKES.items() for x in xs}
_FOLD |= {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: str(i) for i in range(10)}
#: Signs that stand for letters do so only inside or before the rest of a word.
_SPACED = re.compile(r"(?<= )(?:\w ){2,}\w(?= )")
_NOT_LETTERS = re.compile(r"[!|+$@]+(?!\w)|(?<!\S)[!|+]+")


def fold(text: str) -> str:
    """The folded text with a blank at each end; one blank stands for each sign that is no letter."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if any(c in text for c in "!|+$@"):
        text = _NOT_LETTERS.sub(" ", text)
    return _SPACED.sub(lambda m: m[0].replace(" ", ""), f" {text.translate(_FOLD)} ")


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct (term, context, label) of each batch; a text gives each of its terms once, in its first context there."""
    for batch in batches:
        seen = set()
        for text, y in zip(batch["t"], batch["y"], strict=True):
            words = fold(text or "").split()
            first: dict[str, int] = {}
            for i, word in enumerate(words):
                if f" {word} " not in first:
                    first[f" {word} "] = i
                    for k in BEGINNINGS:
                        if len(word) >= k:
                            first.setdefault(f" {word[:k]}", i)
            seen.update((term, hash_of(words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""), y) for term, i in first.items())
        yield pd.DataFrame(seen, columns=["term", "context", "y"]).astype({"context": "int64", "y": "int32"})


def hash_of(a: str, b: str) -> int:
    """A hash that is the same in every process, unlike hash()."""
    return xxhash.xxh3_64_intdigest(f"{a}\0{b}") - (1 << 63)


def strength(toxic: int, clean: int) -> Column:
    """How unlikely chance makes a term's toxic share of contexts (t toxic, n clean), as a Chernoff bound; below 0 for terms that aren't mostly toxic."""
    share = min(0.5, toxic / (toxic + clean))
    p = F.col("t") / (F.col("t") + F.col("n"))
    other = F.when(p == 1, 0.0).otherwise((1 - p) * F.ln((1 - p) / (1 - share)))
    return F.when(p >= 0.8, (F.col("t") + F.col("n")) * (p * F.ln(p / share) + other)).otherwise(-1.0)


def nested_terms(good: dict[str, tuple[int, int]]) -> list[str]:
    """Of nested beginnings and words the longest that keeps nearly all toxic contexts stays."""
    kept: dict[str, int] = {}
    for term in sorted(good, key=lambda x: (len(x), x)):
        t = good[term][0]
        shorter = [s for k in BEGINNINGS if (s := term[: k + 1]) in kept and s != term]
        if not shorter:
            kept[term] = t
        elif t >= 0.97 * kept[shorter[-1]]:
            del kept[shorter[-1]]
            kept[term] = t
    return sorted(kept)


def learn_terms(counts: DataFrame, toxic: int, clean: int) -> tuple[dict[str, float], list[str]]:
    """Weighted terms and exception words from counts (term, t, n: toxic and clean contexts) and the numbers of labelled texts.

    A term is " word " or " beginning". It is taken if its contexts are toxic more often than the share of toxic texts
    allows by chance, corrected for the number of terms tried. Only terms that pass come to the driver."""
    if not toxic or not clean:
        return {}, []
    tried = counts.where("t + n >= 3").count()
    bar = math.log(max(tried, 1)) + 3
    good = {r.term: (r.t, r.n) for r in counts.where("t > 0").where(strength(toxic, clean) >= bar).collect()}
    weights = {x: math.log((good[x][0] + 0.5) / (good[x][1] + 0.5) * (clean + 1) / (toxic + 1)) for x in nested_terms(good)}
    begun = [x for x in weights if not x.endswith(" ")]
    if not begun:
        return weights, []
    starts = [F.substring("term", 1, k + 1).isin([x for x in begun if len(x) == k + 1]) for k in BEGINNINGS]
    longer = counts.where("t = 0 and n >= 3").where(F.col("term").endswith(" ")).where(functools.reduce(Column.__or__, starts))
    return weights, sorted(r.term for r in longer.select("term").collect())


class Lexicon:
    """Terms with weights and exceptions, and the logistic calibration of their net weight."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.weights, self.exceptions = weights, exceptions
        self.bias, self.slope = -3.0, 2.0
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for term, w in self.weights.items():
                a.add_word(term, (len(term), w))
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def feature(self, text: str | None) -> tuple[float, int]:
        """The text's feature, 0 without hits, and its number of hits that count."""
        if not text or not self.weights:
            return 0.0, 0
        folded = fold(text)
        hits = list(self.automaton().iter(folded))
        if not hits:
            return 0.0, 0
        calm = [(end - n + 1, end) for end, (n, w) in hits if w is None]
        terms = [(end - n + 1, end, w) for end, (n, w) in hits if w is not None]
        if calm:
            terms = [(a, b, w) for a, b, w in terms if not any(x <= a and b <= y for x, y in calm)]
        weight = sum(max(w, 0.0) for _, _, w in terms)
        words = folded.count(" ") + 1
        return math.log1p(weight) / 2 + math.log1p(100 * weight / (words + 20)) / 2, len(terms)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression on the feature by Newton's method; a weak prior around the fixed values stands in for rows where there are few. The slope stays positive."""
        if not len(y) or not 0 < y.mean() < 1 or x[y == 1].mean() <= x[y == 0].mean():
            return
        prior = b = np.array([-3.0, 2.0])
        z = np.column_stack([np.ones(len(x)), x])
        w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.eye(2) * 0.1, z.T @ (w * (p - y)) + 0.1 * (b - prior))
            b = b - np.clip(step, -2, 2)
        if b[1] > 0:
            self.bias, self.slope = map(float, b)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * x, -30, 30)))


def fit(docs: DataFrame, labelled: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Lexicon:
    """The lexicon learned from at most FIT_TOXIC and FIT_CLEAN rows of labelled (id_col, label_col: 0 or 1)."""
    rows = labelled.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).dropna()
    bounded = lambda df: functools.reduce(DataFrame.unionByName, (df.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))))
    # An id may be on any number of rows: each of its texts counts once, and so many rows of each kind are taken in all.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).join(F.broadcast(bounded(rows)), "_id").withColumn("h", F.xxhash64("t")).dropDuplicates(["_id", "h", "y"])
    texts = saved(texts, "labelled-texts")
    chosen = bounded(texts.select("_id", "h", "y"))  # at most FIT_TOXIC + FIT_CLEAN rows are sent
    texts = texts.join(F.broadcast(chosen), ["_id", "h", "y"], "left_semi").select("t", "y")
    seen = texts.mapInPandas(_terms, "term string, context long, y int").distinct()
    counts = saved(seen.groupBy("term").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("n")), "terms")
    kinds = dict(chosen.groupBy("y").count().toPandas().itertuples(index=False))
    toxic, clean = int(kinds.get(1, 0)), int(kinds.get(0, 0))
    weights, exceptions = learn_terms(counts, toxic, clean)
    known = {r.term: (r.t, r.n) for r in counts.where(F.col("term").isin([f" {x} " for x in STARTING_WORDS])).collect()}
    odds = (toxic + 1) / (clean + 1)
    for word in STARTING_WORDS:
        t, n = known.get(f" {word} ", (0, 0))
        if not any(f" {word} ".startswith(x) for x in weights):  # contexts move the weight, down to none
            weights[f" {word} "] = max(0.0, math.log((t + 0.5 * odds * math.exp(STARTING_WEIGHT)) / (n + 0.5) / odds))
    lexicon = Lexicon(weights, sorted({*exceptions, *(f" {x} " for x in EXCEPTION_PHRASES)}))
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [sent.value.feature(t)[0] for t in batch["t"]], "y": batch["y"].astype("float64")})

    got = texts.mapInPandas(features, "x double, y double").toPandas().sort_values(["x", "y"])
    lexicon.calibrate(got["x"].to_numpy(), got["y"].to_numpy())
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> Column:
    """The probability that each row of docs is toxic, as a column expression."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(sent.value.score(np.array([sent.value.feature(t)[0] for t in batch], dtype="float64")))

    return probability(F.col(text_col))
