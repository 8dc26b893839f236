"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark passages become TF-IDF rows over hashed words (``SLOTS`` slots, so
   that the matrices do not grow with the benchmark; of its vocabulary, only a
   word's slot is held). Document counts are over all passages. A randomised SVD finds the latent basis: Gaussian test vectors are
   multiplied by the matrix and its transpose in Spark, each task adding up the
   rows it holds, so that only slot-by-rank blocks are exchanged.
2. Every document is read whole. Word vectors are summed over sliding windows
   through prefix sums, in window sizes that fit the passages' lengths, and each
   window is compared with all passages of its size by one matrix product. The
   cosine counts the window's whole TF-IDF norm, so that words outside the latent
   space tell against it, and is relative to what the space holds of the passage.
   Windows at or over ``cosine`` are the candidates; nothing else proposes any.
3. A candidate is verified on the words: the longest common subsequence must
   cover ``lcs`` of the passage within a span of the document not much longer
   than the passage, and the words inside that span must hold ``answer`` of the
   passage's IDF weight; where passages come with an answer, as much of the
   answer's words. A passage of fewer than ``least_words`` words must stand there
   word for word.

Counts, weights and basis belong to the whole benchmark, so a verdict does not
depend on how passages are grouped. Up to ``block`` passages share one pass over
the documents, which bounds what a task holds; a larger benchmark takes more.
Comparing costs windows times passages of their size.

Edge cases: null and empty documents or passages match nothing; repeated rows
are judged each on their own; an empty benchmark or corpus gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.common import bound_batches, materialize
from aeroframe.llm.minhash import row_hash

SLOTS = 1 << 17


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, bit-parallel over ``a``."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


_WORD = re.compile(r"""[^\s.,;:!?"'()\[\]{}<>|*#$%&_/\\-]+""")


def _plain(text: str | None) -> list[str]:
    """Lower-case words between white space and punctuation."""
    return _WORD.findall((text or "").lower())


def slot_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % SLOTS


class Space:
    """Weights and latent basis of all passages, by used slot."""

    def __init__(self, words: list[str], slots: np.ndarray, idf: np.ndarray, unseen: float, basis: np.ndarray):
        self.idf = idf
        self.rows = dict(zip(words, np.searchsorted(slots, [slot_of(w) for w in words]).tolist()))
        # a slot's latent vector and the square of its weight; then a row for words of no passage,
        # which count as average ones, and one for no word at all
        self.vectors = np.vstack([idf[:, None] * basis, np.zeros((2, basis.shape[1]))]).astype("f4")
        self.squares = np.append(idf, [unseen, 0.0]) ** 2
        self.unseen = len(idf)

    def weight(self, word: str) -> float:
        return float(self.idf[self.rows[word]])

    def codes(self, text: str | None) -> np.ndarray:
        """Rows of the words of ``_plain``."""
        words = _plain(text)
        return np.fromiter(map(self.rows.get, words, repeat(self.unseen)), np.int64, len(words))


class Block:
    """Passages that share a pass, by window size."""

    STRETCH, CELL, PRODUCT = 16_384, 4, 4_000_000

    def __init__(self, items: list[tuple[str | None, list[str], list[str]]], space: Space, least_words: int):
        self.ids = [i for i, _, _ in items]
        self.words = [w for _, w, _ in items]
        self.answers = [set(a) for _, _, a in items]
        self.space, self._members = space, {}
        self.whole = np.array([len(w) < least_words for w in self.words])
        self.counts = [Counter(words) for words in self.words]
        self.weights = [{w: space.weight(w) for w in set(words)} for words in self.words]
        self.coded = [Counter(space.rows[w] for w in words) for words in self.words]
        rows, norms = np.zeros((len(items), space.vectors.shape[1])), np.zeros(len(items))
        for r, words in enumerate(self.words):
            rows[r] = space.vectors[[space.rows[w] for w in words]].sum(axis=0)
            norms[r] = np.sqrt(sum((n * self.weights[r][w]) ** 2 for w, n in self.counts[r].items()))
        # unit vectors over the share of the passage that the space holds: the passage itself has cosine 1
        held = np.maximum(np.linalg.norm(rows, axis=1), 1e-9)
        self.items = (rows / held[:, None] * (norms / held)[:, None]).astype("f4")
        # windows are laid in cells of ``g`` words, every ``step`` cells: a passage's length (long
        # ones in powers of the fourth root of two) and a step more, so that one covers it
        # wherever it starts
        self.tiers: dict[int, dict[tuple[int, int], list[int]]] = {}
        for k, n in enumerate(map(len, self.words)):
            g = self.CELL if n >= 12 else 2 if n >= 8 else 1
            m = -(-n // g)
            m = m if m <= 16 else int(np.ceil(2 ** (np.ceil(4 * np.log2(m)) / 4)))
            step = max(1, m // 5)
            self.tiers.setdefault(g, {}).setdefault((m + step, step), []).append(k)

    def candidates(self, texts: list[np.ndarray], cosine: float) -> list[dict[int, list[tuple[float, int, int]]]]:
        """Per text: passage -> (cosine, start, end) of its windows at or over ``cosine``, best first.

        Texts are taken together up to STRETCH words, longer ones in stretches
        that overlap by the longest window."""
        found: list[dict[int, list]] = [{} for _ in texts]
        for g, windows in self.tiers.items():
            longest, parts, size = g * max(windows)[0], [], 0
            for nth, at in enumerate(texts):
                for base in range(0, len(at), self.STRETCH):
                    part = at[base : base + self.STRETCH + longest]
                    if size + len(part) > self.STRETCH + longest:
                        self._search(parts, g, windows, cosine, found)
                        parts, size = [], 0
                    parts.append((nth, base, part))
                    size += len(part)
            if parts:
                self._search(parts, g, windows, cosine, found)
        return [{k: sorted(v, reverse=True) for k, v in f.items()} for f in found]

    def _search(self, parts: list[tuple[int, int, np.ndarray]], g: int, windows: dict[tuple[int, int], list[int]], cosine: float, found: list[dict]) -> None:
        """Windows of the parts (text, offset, words) against the passages of their size."""
        most = max(windows)[0]
        cells = np.array([-(-len(p) // g) for _, _, p in parts])
        firsts = np.cumsum(cells + most) - cells - most  # empty cells after each part keep parts apart
        at = np.full(g * int((cells + most).sum()), len(self.space.squares) - 1, np.int64)
        for first, (_, _, p) in zip(firsts, parts):
            at[g * first : g * first + len(p)] = p
        vectors, squares = self.space.vectors, self.space.squares
        sums = np.zeros((len(at) // g + 1, vectors.shape[1]), "f4")
        np.cumsum(sum(vectors.take(at[x::g], axis=0) for x in range(g)), axis=0, out=sums[1:])
        mass = np.concatenate([[0], np.cumsum(squares[at].reshape(-1, g).sum(axis=1))])
        for (m, step), items in windows.items():
            window = sums[m::step] - sums[:-m:step]
            # repeated words weigh more than the sum of squares tells, which the latent norm shows
            norm = np.sqrt(np.maximum(np.maximum(mass[m::step] - mass[:-m:step], np.einsum("ij,ij->i", window, window)), 1e-6)).astype("f4")
            mine = self.items[items].T
            batch = max(1, self.PRODUCT // len(items))
            for lo in range(0, len(window), batch):
                close = (window[lo : lo + batch] @ mine) / norm[lo : lo + batch, None]
                row, k = np.nonzero(close >= cosine)
                if not len(row):
                    continue
                cos, cell = close[row, k], (lo + row) * step
                part = np.searchsorted(firsts, cell, "right") - 1
                # of windows that start within half a passage, the best one: its span holds what the others show
                bins = (cell - firsts[part]) // max(1, (m - step) // 2)
                order = np.lexsort((-cos, bins, k, part))
                same = (np.diff(part[order]) == 0) & (np.diff(k[order]) == 0) & (np.diff(bins[order]) == 0)
                best = order[np.concatenate([[True], ~same])]
                for c, i, x, at_cell in zip(cos[best].tolist(), k[best].tolist(), part[best].tolist(), (cell - firsts[part])[best].tolist()):
                    nth, base, p = parts[x]
                    start, end = base + g * at_cell, base + min(g * (at_cell + m), len(p))
                    if start < end:
                        found[nth].setdefault(items[i], []).append((c, start, end))

    def _member(self, k: int) -> np.ndarray:
        """Which rows are words of a passage."""
        if k not in self._members:
            if len(self._members) > 512:
                self._members.clear()
            self._members[k] = np.zeros(len(self.space.squares), bool)
            self._members[k][list(self.coded[k])] = True
        return self._members[k]

    def verify(self, text: str, at: np.ndarray, found: dict[int, list[tuple[float, int, int]]], lcs: float, answer: float):
        """The best span of each passage that passes the word checks; ``at`` are the text's codes."""
        words = None
        for k, windows in found.items():
            item, weights, done, best = self.words[k], self.weights[k], [], None
            # no common subsequence is longer than the passage's words inside the span
            inside = np.zeros(len(at) + 1, np.int32)
            np.cumsum(self._member(k)[at], out=inside[1:])
            spans = np.array([(max(0, start - len(item) // 2), end + len(item) // 2) for _, start, end in windows])
            np.minimum(spans, len(at), out=spans)
            for nth in np.flatnonzero(inside[spans[:, 1]] - inside[spans[:, 0]] >= lcs * len(item)).tolist():
                cos, start, end = windows[nth]
                if any(a <= start and end <= b for a, b in done):
                    continue
                a, b = spans[nth].tolist()
                done.append((a, b))
                # codes tell most spans apart; only then the text is split into words
                near = self.coded[k].keys() & at[a:b].tolist()
                if sum(map(self.coded[k].__getitem__, near)) < lcs * len(item):
                    continue
                words = _plain(text) if words is None else words
                span = words[a:b]
                if self.whole[k]:
                    if any(span[i : i + len(item)] == item for i in range(len(span) - len(item) + 1)):
                        best = (cos, 1.0, a, b)
                        break
                    continue
                held = Counter(span)
                if sum(min(n, held[w]) for w, n in self.counts[k].items()) < lcs * len(item):
                    continue
                if sum(x for w, x in weights.items() if w in held) < answer * sum(weights.values()):
                    continue
                if sum(w in held for w in self.answers[k]) < answer * len(self.answers[k]):
                    continue
                share = lcs_length(item, span) / len(item)
                if share >= lcs and (best is None or share > best[1]):
                    best = (cos, share, a, b)
            if best:
                yield self.ids[k], *best


def latent_space(passages: DataFrame, rank: int, seed: int = 7, rounds: int = 2) -> Space | None:
    """Document counts and right singular vectors (slots x rank) of all passages.

    Randomised range finder: ``rounds`` products with the transpose times the
    matrix, each a pass over the passages in Spark. None without any word.
    """

    def words(batches):
        for b in batches:
            seen = Counter(w for t in b["text"] for w in set(_plain(t)))
            yield pd.DataFrame({"word": list(seen.keys()), "n": np.array(list(seen.values()), np.int64)}).astype({"word": object})

    counts = passages.mapInPandas(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return None
    total = passages.count()
    used, back = np.unique([slot_of(w) for w in counts["word"]], return_inverse=True)
    n = np.bincount(back, counts["n"])
    idf = np.log((1 + total) / (1 + np.minimum(n, total))) + 1
    k = min(rank + 8, len(used))
    y = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(used), k)))[0]
    for _ in range(rounds):
        y = np.linalg.qr(_gram(passages, used, idf, y))[0]
    small = y.T @ _gram(passages, used, idf, y)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[: min(rank, k)]
    return Space(counts["word"].tolist(), used, idf, float(np.average(idf, weights=n)), y @ turn[:, order[values[order] > 1e-9 * max(values.max(), 1e-9)]])


def _gram(passages: DataFrame, used: np.ndarray, idf: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A^T A y, summed over the passages where they are."""
    shared = passages.sparkSession.sparkContext.broadcast((used, idf, y.astype("f4")))

    def run(batches):
        slots, weight, test = shared.value
        out = np.zeros(test.shape)
        for b in batches:
            for text in b["text"]:
                own, n = np.unique(np.array([slot_of(w) for w in _plain(text)], np.int64), return_counts=True)
                at = np.searchsorted(slots, own)
                row = n * weight[at]
                norm = np.linalg.norm(row)
                if norm:
                    row = row / norm
                    out[at] += row[:, None] * (row @ test[at])
        rows = np.flatnonzero(out.any(axis=1))
        yield pd.DataFrame(out[rows], columns=names).assign(r=rows)

    names = [f"v{c}" for c in range(y.shape[1])]
    rows = passages.mapInPandas(run, ", ".join(f"{c} double" for c in names) + ", r long")
    summed = rows.groupBy("r").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    out = np.zeros(y.shape)
    out[summed["r"]] = summed[names]
    shared.unpersist()
    return out


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, rank: int = 96, cosine: float = 0.5,
    lcs: float = 0.6, answer: float = 0.5, least_words: int = 8, block: int = 16_384,
) -> DataFrame:
    """One row per document and passage found in it: id, item, cosine, lcs share, word span,
    and the document's row hash (of id and text)."""
    spark = docs.sparkSession
    bound_batches(spark, 500)
    # ids cross to Python as text, since pandas would turn a batch with a null into floats
    texts = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"), row_hash(id_col, text_col).alias("row"))
    schema = "doc_id string, item_id string, cosine double, lcs double, start_word long, end_word long, row string"
    told = F.lit("") if answer_col is None else F.coalesce(F.col(answer_col), F.lit(""))
    items = materialize(
        benchmark.select(F.col(item_col).cast("long").cast("string").alias("item_id"), F.col(item_text_col).alias("text"), told.alias("answer"))
        .where("text is not null").withColumn("nth", F.monotonically_increasing_id())
    )
    space = latent_space(items.select("text"), rank)
    parts = max(1, -(-items.count() // block)) if space else 0
    out = None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("nth"), F.lit(parts)) == part)
        held = [(r["item_id"], w, _plain(r["answer"])) for r in rows.collect() if (w := _plain(r["text"]))]
        if not held:
            continue
        shared = spark.sparkContext.broadcast(Block(held, space, least_words))

        def run(batches, shared=shared):
            passages = shared.value
            for b in batches:
                found = []
                coded = [passages.space.codes(t) for t in b["text"]]
                for doc, text, row, at, near in zip(b["doc_id"], b["text"], b["row"], coded, passages.candidates(coded, cosine)):
                    found += [(doc, *hit, row) for hit in passages.verify(text, at, near, lcs, answer)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "cosine", "lcs", "start_word", "end_word", "row"])

        hits = texts.mapInPandas(run, schema)
        out = hits if out is None else out.unionByName(hits)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "item_id")})


def remove_leaks(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no leak was found, judged by id and text."""
    found = leaks.select(F.col("row").alias("_row")).distinct()
    return docs.withColumn("_row", row_hash(id_col, text_col)).join(found, "_row", "left_anti").select(*docs.columns)
