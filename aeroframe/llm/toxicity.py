"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes look-alike letters, accents, digit and symbol substitutions,
inner punctuation and stretched letters, in the lexicon as in the texts. Terms
are whole words or word beginnings; a token counts with the longest term that
fits. Terms inside an exception phrase do not count. The summed evidence is
normalised by the text's length, and a logistic curve turns it into a score.

Term weights are smoothed log-odds of the number of distinct training texts
(near copies count once, by their smallest word-pair hash) with and without the
label. Terms and curve are fitted on at most ``max_rows`` labelled rows.

Edge cases: null and empty texts get the score of a text without matches;
labelled rows with a null label or without a document are ignored; an id whose
labels disagree does not train, of rows that share an id the smallest text does;
without rows of both labels every score is that of the label there is (0 without
any); repeated rows are scored each on their own, and alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.common import bound_batches, training_rows

# Letters that look like Latin ones, and substitutions. i, l and 1
# fold to one letter, as a 1 can stand for either.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "γ": "y", "σ": "o", "ı": "i", "ɑ": "a", "ɡ": "g", "ß": "ss", "ø": "o", "ł": "l", "đ": "d",
}
SUBSTITUTIONS = {
    "0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "€": "e", "£": "i", "|": "i",
}
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash collection", "clown fish", "clown school",
    "pond scum", "scum of algae", "idiot proof", "pathetic fallacy", "sore loser", "stupid mistake of mine",
)
PREFIXES = (4, 5, 6, 7, 8)

_TABLE = {i: None for i in range(0x300, 0x370)} | {ord(k): v for k, v in SUBSTITUTIONS.items()}
_TABLE |= {ord(k): "".join(SUBSTITUTIONS.get(c, c) for c in v) for k, v in HOMOGLYPHS.items()}
_TABLE |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_INNER = re.compile(r"(?<=\w)[.\-_*·'’!](?=\w)")
_SPELT = re.compile(r"\b(?:\w[ .\-_*]){2,}\w\b")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Folded words, with one space before, between and after them."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    text = _SPELT.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), text)
    text = _INNER.sub("", text).translate(_TABLE)
    return f" {' '.join(_WORD.findall(_RUN.sub(r'\1', text)))} "


def _terms(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def _sketch(folded: str) -> int:
    words = folded.split()
    pairs = zip(words, words[1:]) if len(words) > 1 else [(folded, "")]
    import xxhash

    return min(xxhash.xxh3_64_intdigest(a + " " + b) for a, b in pairs) - (1 << 63)


class Matcher:
    """Evidence of a text under a lexicon; the automaton is built once per copy."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.lexicon, self.exceptions, self._built = lexicon, exceptions, None

    def __getstate__(self):
        return self.__dict__ | {"_built": None}

    def automaton(self):
        if self._built is None:
            import ahocorasick

            auto = ahocorasick.Automaton()
            for phrase in self.exceptions:
                auto.add_word(p := fold(phrase), (len(p), None))
            for term, weight in self.lexicon.items():
                auto.add_word(term, (len(term), weight))
            if len(auto):
                auto.make_automaton()
            self._built = auto
        return self._built

    def features(self, text: str) -> tuple[float, float, float]:
        """Evidence, evidence by length, largest weight."""
        folded, auto = fold(text), self.automaton()
        if not len(auto):
            return 0.0, 0.0, 0.0
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in auto.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif size > best.get(start, (0, 0.0))[0]:
                best[start] = (size, weight)
        hits = [w for at, (_, w) in best.items() if not any(a <= at < b for a, b in spared)] if spared else [w for _, w in best.values()]
        if not hits:
            return 0.0, 0.0, 0.0
        total = sum(hits)
        return math.log1p(total), total / math.sqrt(folded.count(" ") + 9), max(hits)


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], curve: list[float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.matcher, self.curve = Matcher(lexicon, exceptions), curve

    def score(self, text: Column) -> Column:
        """Probability of the label, 0 to 1."""
        matcher, curve = self.matcher, np.array(self.curve)

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                x = np.array([matcher.features(t) for t in texts]).reshape(len(texts), 3)
                yield pd.Series(1 / (1 + np.exp(-np.clip(x @ curve[1:] + curve[0], -30, 30))))

        return scored(F.coalesce(text, F.lit("")))


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Ridge logistic regression by Newton steps; the intercept is not shrunk."""
    a = np.hstack([np.ones((len(x), 1)), x])
    b, shrink = np.zeros(a.shape[1]), np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + shrink, a.T @ (y - p) - shrink @ b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b.tolist()


def fit(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id",
    max_rows: int = 20_000, least_texts: int = 6, least_weight: float = 2.5,
) -> ToxicityModel:
    """Learn terms and curve from ``docs`` (id, text) and ``labels`` (id, label 0/1).

    At most ``max_rows`` rows train (see ``training_rows``). Every term of these
    that is told often and strongly enough enters the lexicon, whose size is so
    bounded by the sample; besides it, ids, labels and three numbers per sampled
    row reach the driver.
    """
    spark = docs.sparkSession
    bound_batches(spark, 250, "4m")
    marked = labels.where(F.col(label_col).isin(0, 1))
    rows = training_rows(docs, marked, max_rows, id_col, text_col, label_col)

    @F.pandas_udf("long")
    def sketched(texts: pd.Series) -> pd.Series:
        return pd.Series([_sketch(fold(t)) for t in texts], dtype="int64")

    # of near copies the smallest text trains
    rows = rows.withColumn("sketch", sketched("text")).groupBy("sketch", "y").agg(F.min("text").alias("text")).select("text", "y").persist()
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        rows.unpersist()
        return ToxicityModel({}, [40.0 if n1 else -40.0, 0.0, 0.0, 0.0])

    def counted(batches):
        for b in batches:
            n = [Counter(), Counter()]
            for text, y in zip(b["text"], b["y"]):
                n[y].update(_terms(fold(text)))
            terms = list(n[0].keys() | n[1].keys())
            yield pd.DataFrame({"term": terms, "n0": [n[0][t] for t in terms], "n1": [n[1][t] for t in terms]})

    weight = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    lexicon = {
        r["term"]: r["weight"] for r in rows.mapInPandas(counted, "term string, n0 long, n1 long")
        .groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(F.col("n1") >= least_texts).withColumn("weight", weight).where(F.col("weight") >= least_weight).collect()
    }
    matcher = Matcher(lexicon)

    def featured(batches):
        for b in batches:
            x = [matcher.features(t) for t in b["text"]]
            yield pd.DataFrame(x, columns=["a", "b", "c"], dtype="float64").assign(y=b["y"].to_numpy())

    seen = rows.mapInPandas(featured, "a double, b double, c double, y int").toPandas().sort_values(["y", "a", "b", "c"])
    rows.unpersist()
    return ToxicityModel(lexicon, _fit_curve(seen[["a", "b", "c"]].to_numpy(), seen["y"].to_numpy()))
