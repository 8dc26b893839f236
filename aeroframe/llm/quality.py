"""Quality by ordinal cumulative-link regression on hashed text.

P(grade <= k) = logistic(threshold_k - w.x), with one weight vector for all
grades and rising thresholds. x holds, of the whole text, hashed words and word
shapes (log counts at unit length), and one indicator per structural figure:
length, share of distinct words and lines, repeated neighbours, capitals,
digits, symbols, most common word.

The model is fitted on at most ``max_rows`` rated rows (those with the smallest
id hashes); scoring covers every row.

Edge cases: null and empty texts are scored by their structural figures alone;
rows without a grade do not train, nor does an id whose grades disagree; of rows
that share an id the smallest text trains; with one grade or none, that grade (or
null) is expected everywhere; repeated rows are scored each on their own, and
alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.common import bound_batches, training_rows

BITS = 15
_SIZE = 1 << BITS
_FIGURES = 8  # structural figures, each in _LEVELS levels, after the hashed part
_LEVELS = 12
WIDTH = _SIZE + _FIGURES * _LEVELS
_SHAPES = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "9"))

_UPPER, _DIGIT, _SPACE, _ALNUM = (re.compile(x) for x in (r"[A-ZÀ-ÖØ-Þ]", r"\d", r"\s", r"[^\W_]"))


def _letters(m) -> str:
    s = m[0]
    return "a" if s.islower() else "A" if s.isupper() else "Aa" if s[0].isupper() and s[1:].islower() else "x"


class _Slots(dict):
    """word -> (slot of the word, slot of its shape)."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 300_000:
            self.clear()
        shape = _SHAPES[1][0].sub("9", _SHAPES[0][0].sub(_letters, word))
        shape = re.sub(r"(.)\1+", r"\1\1", shape)[:24]
        self[word] = out = (
            xxhash.xxh3_64_intdigest("w" + word.lower()) % _SIZE,
            xxhash.xxh3_64_intdigest("s" + shape) % _SIZE,
        )
        return out


_SLOTS = _Slots()


def _level(share: float) -> int:
    return min(_LEVELS - 1, int(share * _LEVELS))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a whole text."""
    text = text or ""
    words = text.split()
    n = len(words)
    if n:
        pairs = np.array([_SLOTS[w] for w in words])
        slots, counts = np.unique(pairs.ravel(), return_counts=True)
        values = np.log1p(counts)
        values /= np.linalg.norm(values)
        own, per = np.unique(pairs[:, 0], return_counts=True)
        lines = [x for x in text.split("\n") if x.strip()]
        upper, digits, spaces = len(_UPPER.findall(text)), len(_DIGIT.findall(text)), len(_SPACE.findall(text))
        alnum = len(_ALNUM.findall(text))
        figures = [
            min(_LEVELS - 1, int(np.log2(n + 1))), _level(len(own) / n), _level(float((pairs[1:, 0] == pairs[:-1, 0]).mean()) if n > 1 else 0),
            _level(len(set(lines)) / len(lines)), _level(upper / max(1, alnum) * 0.999),
            _level(digits / len(text)), _level(min(0.999, 4 * (len(text) - alnum - spaces) / len(text))), _level(per.max() / n * 0.999),
        ]
    else:
        slots, values, figures = np.empty(0, np.int64), np.empty(0), [0] * _FIGURES
    own = _SIZE + np.arange(_FIGURES) * _LEVELS + np.array(figures)
    return np.concatenate([slots, own]).astype(np.int32), np.concatenate([values, np.full(_FIGURES, 0.5)]).astype("f4")


class OrdinalModel:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def score(self, text: Column, tail_from: int | None = None) -> Column:
        """struct(expected double, tail double): the expected grade, and the
        probability of at least ``tail_from`` (the best grade where not given)."""
        w, cut, grades = self.weights.astype("f4"), self.thresholds, np.array(self.grades, float)
        from_ = grades[-1] if tail_from is None and len(grades) else tail_from

        @F.pandas_udf("expected double, tail double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                if not len(grades):
                    yield pd.DataFrame({"expected": [None] * len(texts), "tail": [None] * len(texts)}, dtype="float64")
                    continue
                z = np.array([float(w[s] @ v) for s, v in map(features, texts)])
                below = 1 / (1 + np.exp(-np.clip(cut[None, :] - z[:, None], -30, 30)))
                p = np.diff(np.hstack([np.zeros((len(z), 1)), below, np.ones((len(z), 1))]), axis=1)
                yield pd.DataFrame({"expected": p @ grades, "tail": p[:, grades >= from_].sum(axis=1)})

        return scored(F.coalesce(text, F.lit("")))


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, levels: int, rounds: int = 30, rate: float = 0.05, ridge: float = 1e-5, seed: int = 3):
    """Adam on the cumulative-link likelihood; thresholds are a base and positive steps."""
    rng = np.random.default_rng(seed)
    theta = np.zeros(WIDTH + levels - 1)
    share = np.clip(np.cumsum(np.bincount(y, minlength=levels))[:-1] / len(y), 0.01, 0.99)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(levels - 1))
    theta[WIDTH] = start[0]
    theta[WIDTH + 1 :] = np.log(np.maximum(np.diff(start), 1e-3))
    m, v, t = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 256):
            batch = order[lo : lo + 256]
            steps = np.exp(theta[WIDTH + 1 :])
            cut = theta[WIDTH] + np.concatenate([[0], np.cumsum(steps)])
            slots = np.concatenate([rows[i][0] for i in batch])
            values = np.concatenate([rows[i][1] for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            z = np.bincount(of, theta[slots] * values, minlength=len(batch))
            full = np.concatenate([[-np.inf], cut, [np.inf]])
            hi, lo_ = _sigmoid(full[y[batch] + 1] - z), _sigmoid(full[y[batch]] - z)
            p = np.maximum(hi - lo_, 1e-9)
            dhi, dlo = hi * (1 - hi) / p, lo_ * (1 - lo_) / p
            g = np.zeros_like(theta)
            g[:WIDTH] = np.bincount(slots, (dhi - dlo)[of] * values, minlength=WIDTH) / len(batch) + ridge * theta[:WIDTH]
            dcut = np.zeros(levels + 1)
            np.add.at(dcut, y[batch] + 1, -dhi)
            np.add.at(dcut, y[batch], dlo)
            dcut = dcut[1:-1] / len(batch)
            g[WIDTH] = dcut.sum()
            g[WIDTH + 1 :] = np.cumsum(dcut[::-1])[::-1][1:] * steps
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:WIDTH], theta[WIDTH] + np.concatenate([[0], np.cumsum(np.exp(theta[WIDTH + 1 :]))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", grade_col: str = "quality", id_col: str = "doc_id", max_rows: int = 6000,
) -> OrdinalModel:
    """Fit on ``docs`` (id, text) and ``labels`` (id, grade); slots and values of at
    most ``max_rows`` texts (see ``training_rows``) reach the driver."""
    bound_batches(docs.sparkSession)
    texts = training_rows(docs, labels, max_rows, id_col, text_col, grade_col)

    def run(batches):
        for b in batches:
            found = [features(t) for t in b["text"]]
            yield pd.DataFrame({"grade": b["y"], "slots": [s.tobytes() for s, _ in found], "data": [v.tobytes() for _, v in found]})

    # sorted, so that the steps of the fit do not depend on how rows were dealt
    got = texts.mapInPandas(run, "grade int, slots binary, data binary").toPandas().sort_values(["grade", "slots", "data"], kind="stable")
    grades = sorted(got["grade"].unique().tolist())
    if len(grades) < 2:
        return OrdinalModel(np.zeros(WIDTH), np.zeros(0), grades)
    rows = [(np.frombuffer(s, np.int32), np.frombuffer(v, "f4")) for s, v in zip(got["slots"], got["data"])]
    y = np.searchsorted(grades, got["grade"].to_numpy())
    return OrdinalModel(*_fit(rows, y, len(grades)), grades)


def select_quality(
    docs: DataFrame, labels: DataFrame, keep_training: Column, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", least_tail: float = 0.5,
) -> DataFrame:
    """One row per document: id, expected_grade, tail_probability, kept."""
    model = fit(docs.where(keep_training), labels, text_col, grade_col, id_col)
    scored = docs.select(id_col, model.score(F.col(text_col)).alias("s"))
    return scored.select(id_col, F.col("s.expected").alias("expected_grade"), F.col("s.tail").alias("tail_probability"), F.coalesce(F.col("s.tail") >= least_tail, F.lit(False)).alias("kept"))
