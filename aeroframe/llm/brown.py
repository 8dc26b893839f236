"""Language-model scoring with Brown class n-grams.

1. Words of all training texts are counted in Spark (by 64-bit hash).
2. The ``head`` most frequent words are types of their own, and so is each of
   ``endings`` groups of the other words by their last letters. Adjacent types
   are counted over all training texts, and exchange clustering moves each type
   to the class that raises the likelihood most, until nothing moves or
   ``passes`` are done. Classes grow with the words seen often.
3. Every other word seen at least ``least`` times is moved too, in one batch step
   of predictive exchange in Spark: the classes of all words before it are summed,
   and it goes to the class under which they are likeliest, given the classes of
   step 2. Rarer and unseen words belong to the class of their ending. Any word
   thus has a class, known from the counts and the word alone.
4. Class transitions are counted anew over all training texts under these
   classes, and smoothed towards the classes' own shares. Words are emitted from
   their class with absolute discounting; the mass taken is spread evenly over
   the unseen words that the class is expected to have: an estimate of all
   unseen words from the words seen once and twice (n1^2 / 2 n2), dealt to the
   classes by their words seen once. Transitions from a class, and emissions over
   its seen and expected unseen words, each sum to one.

Counts and classes of the ``hot`` most frequent words travel with the scoring
function; all others are joined by hash, so no word is dropped and nothing sent
out grows with the corpus. A text's tokens are its words and one end.

Edge cases: a null or empty text is just the end; rows with a null id count as
id '' when folds are dealt; repeated rows are counted and scored each on their
own; without any training token every word is unseen; an empty input gives no
rows.
"""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.common import bound_batches, materialize

END = b"\n"  # no word holds white space
_FLUSH = 2_000_000


class _Words(dict):
    """word -> its number in this task; hashes and endings by number. A task empties it
    between batches once it holds ``MOST`` words, so its size is bounded."""

    MOST = 600_000

    def __init__(self, endings: int):
        self.endings, self._h, self._e = endings, array("Q"), array("i")

    def __missing__(self, word: bytes) -> int:
        self._h.append(xxhash.xxh3_64_intdigest(word))
        self._e.append(ending_of(word, self.endings))
        self[word] = n = len(self._h) - 1
        return n

    def full(self) -> bool:
        return len(self._h) > self.MOST

    def empty(self) -> None:
        self.clear()
        self._h, self._e = array("Q"), array("i")

    def read(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Tokens a text, and the numbers of all tokens."""
        split = [tokens(t) for t in texts]
        n = np.array([len(ws) for ws in split], np.int64)
        return n, np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))

    def since(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Signed hashes and endings of the words numbered ``at`` and more."""
        return np.array(self._h[at:], np.uint64).view(np.int64), np.array(self._e[at:], np.int32)


def ending_of(word: bytes, endings: int) -> int:
    return xxhash.xxh3_64_intdigest(word.rstrip(b".,;:!?")[-3:]) % endings


def tokens(text: str | None) -> list[bytes]:
    """A-Z lowered words at ASCII white space, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def _place(sorted_h: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in a sorted table, whether it is there)."""
    if not len(sorted_h):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_h, h), len(sorted_h) - 1)
    return at, sorted_h[at] == h


def count_words(texts: DataFrame, endings: int) -> DataFrame:
    """text -> (h, ending, c): counts of all words; ending is the bucket of its last letters."""

    def run(batches):
        words, total = _Words(endings), np.zeros(0, np.int64)

        def told():
            h, e = words.since(0)
            for lo in range(0, len(h), 100_000):
                part = slice(lo, lo + 100_000)
                yield pd.DataFrame({"h": h[part], "ending": e[part], "c": total[part]})

        for b in batches:
            if words.full():
                yield from told()
                words.empty()
                total = np.zeros(0, np.int64)
            c = np.bincount(words.read(b["text"])[1], minlength=len(words))
            c[: len(total)] += total
            total = c
        yield from told()

    return texts.mapInPandas(run, "h long, ending int, c long").groupBy("h").agg(F.any_value("ending").alias("ending"), F.sum("c").alias("c"))


BITS = 24  # size of the filter of words that are moved in Spark, as a power of two
LOW = 12  # a word and the type before it share one number: the type takes the hash's lowest bits


def count_neighbours(texts: DataFrame, head: dict[int, int], endings: int, often: np.ndarray) -> DataFrame:
    """(key, c) of all words whose bit in ``often`` is set and the types before them, and
    (pair, c) of all adjacent types. Texts are whole, each opened by an end."""
    k = len(head) + endings
    if k > 1 << LOW:
        raise ValueError(f"head and endings exceed {1 << LOW} types")
    shared = texts.sparkSession.sparkContext.broadcast((*_sorted_head(head), often))

    def run(batches):
        head_h, head_t, bits = shared.value
        total = np.zeros(k * k, np.int64)
        words, held, size = _Words(endings), [], 0
        types, marked = np.zeros(0, np.int64), np.zeros(0, bool)

        def merged():
            key, c = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"key": (words.since(0)[0][key // k] & -(1 << LOW)) | (key % k), "pair": np.full(len(key), -1), "c": c})

        for b in batches:
            if words.full() or size > _FLUSH:
                if size:
                    yield merged()
                held, size = [], 0
                words.empty()
                types, marked = types[:0], marked[:0]
            end = words[END]
            n, seq = words.read(b["text"])
            h, ending = words.since(len(types))
            at, there = _place(head_h, h)
            types = np.concatenate([types, np.where(there, head_t[at] if len(head_t) else 0, len(head_h) + ending)])
            slot = h.view(np.uint64) & np.uint64((1 << BITS) - 1)
            marked = np.concatenate([marked, ~there & ((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)])
            if not len(seq):
                continue
            after = types[seq]
            # an end stands last in each text, and so before the next one's first word
            before = np.concatenate([[types[end]], after[:-1]])
            total += np.bincount(before * k + after, minlength=k * k)
            mark = marked[seq]
            held.append(seq[mark] * k + before[mark])
            size += len(held[-1])
        if size:
            yield merged()
        own = np.flatnonzero(total)
        for lo in range(0, len(own), 100_000):
            part = own[lo : lo + 100_000]
            yield pd.DataFrame({"key": np.zeros(len(part), np.int64), "pair": part, "c": total[part]})

    return texts.mapInPandas(run, "key long, pair long, c long")


def _sorted_head(head: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Signed hashes of the head in order, and their types."""
    h = np.array(list(head), np.uint64).view(np.int64)
    order = np.argsort(h, kind="stable")
    return h[order], np.array(list(head.values()), np.int64)[order]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int, passes: int = 12) -> np.ndarray:
    """Class of each type, by moving types as long as the class bigram likelihood
    rises. All candidate classes of a type are weighed at once."""
    k = len(pairs)
    mass = pairs.sum(0) + pairs.sum(1)
    own = np.zeros(k, np.int64)
    own[np.argsort(-mass, kind="stable")] = np.arange(k) % classes
    hot = np.zeros((k, classes))
    hot[np.arange(k), own] = 1
    n = hot.T @ pairs @ hot
    order = np.argsort(-mass, kind="stable")
    order = order[mass[order] > 0]
    right, left = pairs @ hot, pairs.T @ hot  # to, from class
    eye = np.arange(classes)
    for _ in range(passes):
        moved = 0
        for w in order:
            a, self_ = own[w], pairs[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= self_
            l[a] -= self_
            # take w out of its class
            n[a, :] -= r
            n[:, a] -= l
            n[a, a] -= self_
            # whichever class takes w, its neighbours' totals count it again
            rows, cols = n.sum(1) + l, n.sum(0) + r
            rt, lt = r.sum() + self_, l.sum() + self_
            base = _xlogx(n)
            # put it into each class c: row c gains r, column c gains l, cell (c, c) also the self pairs
            gain = (_xlogx(n + r[None, :]) - base).sum(1) + (_xlogx(n + l[:, None]) - base).sum(0)
            d = n[eye, eye]
            gain += _xlogx(d + r + l + self_) - _xlogx(d + r) - _xlogx(d + l) + _xlogx(d)
            gain -= _xlogx(rows + rt) - _xlogx(rows) + _xlogx(cols + lt) - _xlogx(cols)
            c = int(gain.argmax())
            if gain[c] <= gain[a] + 1e-9:
                c = a
            n[c, :] += r
            n[:, c] += l
            n[c, c] += self_
            if c != a:
                own[w] = c
                moved += 1
                right[:, a] -= pairs[:, w]
                right[:, c] += pairs[:, w]
                left[:, a] -= pairs[w, :]
                left[:, c] += pairs[w, :]
        if moved < max(1, k // 500):
            break
    return own


class Model:
    """Classes of types and hot words, emissions and (once counted) transitions; its size
    is bounded by head, endings, classes and hot."""

    def __init__(self, endings: int, ending_class: np.ndarray, classes: int, tokens_of, words_of, once_of, twice: float, hot: pd.DataFrame):
        self.endings, self.ending_class, self.classes = endings, ending_class, classes
        self.total, self.types = int(tokens_of.sum()), int(words_of.sum())
        n1 = float(once_of.sum())
        self.discount = min(0.95, max(0.1, n1 / (n1 + 2 * twice))) if n1 else 0.5
        unseen = max(1.0, n1 * n1 / (2 * max(twice, 1.0)))
        # words that a class is expected to have besides those seen, and the mass they share
        self.unseen_words = np.maximum(1.0, unseen * (once_of + 1) / (n1 + classes))
        self.unseen_mass = np.where(tokens_of > 0, self.discount * words_of / np.maximum(tokens_of, 1), 1.0)
        self.unseen = np.log10(self.unseen_mass / self.unseen_words)
        self.norm = np.log10(np.maximum(tokens_of, 1))
        hot = hot.sort_values("h")
        self.hot_h, self.hot_c, self.hot_class = (hot[x].to_numpy(np.int64) for x in ("h", "c", "cls"))
        self.step = None

    def emission(self, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of a word's probability in its class, given its count (0: unseen)."""
        return np.where(c > 0, np.log10(np.maximum(c - self.discount, 1e-9)) - self.norm[cls], self.unseen[cls])

    def set_transitions(self, n: np.ndarray) -> None:
        share = (n.sum(0) + 0.1) / (n.sum(0) + 0.1).sum()
        self.step = np.log10((n + 5.0 * share[None, :]) / (n.sum(1, keepdims=True) + 5.0))


def fit_classes(
    train: DataFrame, text_col: str = "text", head: int = 1500, endings: int = 512, classes: int | None = None, hot: int = 200_000, least: int = 10,
) -> tuple[Model, DataFrame]:
    """-> the model without transitions, and the table of all words (h, c, cls).

    Unless ``classes`` is given, there are a quarter of the root of the number of
    words seen ``least`` times, from 32 to 128."""
    spark = train.sparkSession
    bound_batches(spark)
    texts = train.select(F.col(text_col).alias("text"))
    counts = materialize(count_words(texts, endings))
    tops = counts.orderBy(F.desc("c"), "h").limit(hot).toArrow().to_pandas()
    in_head = {int(np.uint64(np.int64(h))): k for k, h in enumerate(tops["h"][:head])}
    listed = F.broadcast(spark.createDataFrame([(int(h), k) for k, h in enumerate(tops["h"][:head])], "h long, k int"))
    moved = counts.where(F.col("c") >= least).join(listed, "h", "left_anti")
    if classes is None:
        classes = int(min(128, max(32, (moved.count() + len(in_head)) ** 0.5 / 4)))
    low = F.col("h").bitwiseAND((1 << BITS) - 1)
    words = moved.groupBy(F.shiftright(low, 3).alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), low.bitwiseAND(7).cast("int"))).alias("bits")).toArrow().to_pandas()
    often = np.zeros(1 << BITS - 3, np.uint8)
    often[words["byte"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    k = len(in_head) + endings
    near = materialize(count_neighbours(texts, in_head, endings, often))
    got = near.where("pair >= 0").groupBy("pair").agg(F.sum("c").alias("c")).toArrow().to_pandas()
    pairs = np.zeros(k * k)
    pairs[got["pair"].to_numpy(np.int64)] = got["c"]
    pairs = pairs.reshape(k, k)
    own = exchange(pairs, classes)
    member = np.zeros((k, classes))
    member[np.arange(k), own] = 1
    n = member.T @ pairs @ member + 0.1
    # how likely each class is to stand before a word of each class
    table = np.log(n / n.sum(0))

    def likeliest(batches):
        for b in batches:
            x = np.zeros((len(b), classes))
            at = np.repeat(np.arange(len(b)), [len(f) for f in b["f"]])
            np.add.at(x, (at, np.concatenate(b["f"].to_numpy())), np.concatenate(b["c"].to_numpy()))
            yield pd.DataFrame({"top": b["top"], "moved": (x @ table).argmax(axis=1)})

    top = lambda h: h.bitwiseAND(-(1 << LOW))
    class_of = F.get(F.array(*[F.lit(int(c)) for c in own]), F.col("key").bitwiseAND((1 << LOW) - 1).cast("int"))
    features = (
        near.where("pair < 0").select(top(F.col("key")).alias("top"), class_of.alias("f"), "c").repartition("top")
        .groupBy("top", "f").agg(F.sum("c").alias("c")).groupBy("top").agg(F.collect_list("f").alias("f"), F.collect_list("c").alias("c"))
    )
    chosen = features.mapInPandas(likeliest, "top long, moved int")
    by_type = lambda t: F.get(F.array(*[F.lit(int(c)) for c in own]), t.cast("int"))
    plain = by_type(F.coalesce(F.col("k"), F.col("ending") + F.lit(len(in_head))))
    placed = F.when(F.col("k").isNull() & (F.col("c") >= least), F.col("moved"))
    table_of = materialize(counts.withColumn("top", top(F.col("h"))).join(listed, "h", "left").join(chosen, "top", "left").select("h", "c", F.coalesce(placed, plain).cast("int").alias("cls")))
    once = lambda c: F.sum((F.col("c") == c).cast("long"))
    sums = table_of.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v"), once(1).alias("n1"), once(2).alias("n2")).toPandas()
    per = np.zeros((3, classes))
    per[:, sums["cls"]] = sums[["c", "v", "n1"]].to_numpy().T
    hot_rows = table_of.orderBy(F.desc("c"), "h").limit(hot).toArrow().to_pandas()
    return Model(endings, own[len(in_head) :], classes, *per, float(sums["n2"].sum()), hot_rows), table_of


def resolve(df: DataFrame, model: Model, words: DataFrame, text_col: str = "text", *keep: Column) -> DataFrame:
    """Per row: ``keep``, n, known, plain (base score without its norm), emit, and seq, the
    classes of all its tokens."""
    spark = df.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("rid"))
    kept = [f for f in rows.schema if f.name != "_text"]

    def run(batches):
        m = shared.value
        words = _Words(m.endings)
        known, cls, plain, emit = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        for b in batches:
            if words.full():
                words.empty()
                known, cls, plain, emit = known[:0], cls[:0], plain[:0], emit[:0]
            n, seq_of = words.read(b["_text"])
            h, ending = words.since(len(known))
            place, there = _place(m.hot_h, h)
            c = np.where(there, m.hot_c[place] if len(m.hot_h) else 0, 0)
            own = np.where(there, m.hot_class[place] if len(m.hot_h) else 0, m.ending_class[ending]).astype(np.int64)
            known, cls = np.concatenate([known, there]), np.concatenate([cls, own])
            plain, emit = np.concatenate([plain, np.log10(c + 1.0)]), np.concatenate([emit, np.where(there, m.emission(c, own), 0.0)])
            of = np.repeat(np.arange(len(n)), n)
            sums = lambda x: np.bincount(of, x[seq_of], len(n))  # noqa: E731, B023
            out = b.drop(columns="_text")
            out["n"] = n
            out["known"] = sums(known.astype(float)).astype(np.int64)
            out["plain"], out["emit"] = sums(plain), sums(emit)
            cuts = np.concatenate([[0], np.cumsum(n)])
            seq = cls[seq_of].astype(np.int16)
            out["seq"] = [seq[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])]
            asked = np.flatnonzero(~known[seq_of])
            hashes = words.since(0)[0][seq_of[asked]]
            parts = np.searchsorted(asked, cuts)
            out["h"] = [hashes[x:y] for x, y in zip(parts[:-1], parts[1:])]
            out["pos"] = [(asked[x:y] - at).astype(np.int32) for x, y, at in zip(parts[:-1], parts[1:], cuts)]
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    local = materialize(rows.mapInPandas(run, f"{fields}, n long, known long, plain double, emit double, seq binary, h array<long>, pos array<int>"))
    # words of the hot table never come here; of the others, those in the table bring count and class
    asked = local.select("rid", F.explode(F.arrays_zip("h", "pos")).alias("w")).select("rid", "w.h", "w.pos")
    told = asked.join(words, "h").groupBy("rid").agg(F.collect_list("pos").alias("at"), F.collect_list("c").alias("c"), F.collect_list("cls").alias("cls"))

    def fill(batches):
        m = shared.value
        for b in batches:
            known, plain, emit, seqs = [], [], [], []
            for row in b.itertuples(index=False):
                seq = np.frombuffer(row.seq, np.int16).copy()
                pos, here = np.array(row.pos, np.int64), row.at is not None and len(row.at) > 0
                c = np.zeros(len(seq), np.int64)
                if here:
                    c[np.array(row.at)] = row.c
                    seq[np.array(row.at)] = row.cls
                found = c[pos]
                known.append(row.known + int((found > 0).sum()))
                plain.append(row.plain + float(np.log10(found + 1.0).sum()))
                emit.append(row.emit + float(m.emission(found, seq[pos].astype(np.int64)).sum()))
                seqs.append(seq.tobytes())
            yield b.drop(columns=["h", "pos", "at", "c", "cls"]).assign(known=known, plain=plain, emit=emit, seq=seqs)

    joined = local.join(told, "rid", "left").select(*[f.name for f in kept], "n", "known", "plain", "emit", "seq", "h", "pos", "at", "c", "cls")
    return joined.mapInPandas(fill, f"{fields}, n long, known long, plain double, emit double, seq binary")


def count_transitions(rows: DataFrame, classes: int, end_class: int) -> np.ndarray:
    """Adjacent classes of ``seq`` over all rows, each opened by an end."""

    def run(batches):
        total = np.zeros(classes * classes, np.int64)
        for b in batches:
            if len(b):
                seq = np.frombuffer(b"".join(b["seq"]), np.int16).astype(np.int64)
                own, c = np.unique(np.concatenate([[end_class], seq[:-1]]) * classes + seq, return_counts=True)
                total[own] += c
        yield pd.DataFrame({"pair": np.flatnonzero(total), "c": total[total > 0]})

    got = rows.select("seq").mapInPandas(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(classes * classes)
    out[got["pair"]] = got["c"]
    return out.reshape(classes, classes)


def end_class(model: Model) -> int:
    """The class of a text's end, which is a hot word of any training set."""
    place, known = _place(model.hot_h, np.array([xxhash.xxh3_64_intdigest(END)], np.uint64).view(np.int64))
    return int(model.hot_class[place[0]]) if known[0] else int(model.ending_class[ending_of(END, model.endings)])


def score(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Resolved rows -> ``keep``, n_tokens, n_known, base_score (add-one unigrams), score (log10)."""
    step, end = model.step, end_class(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches):
        for b in batches:
            moves = []
            for seq in b["seq"]:
                seq = np.frombuffer(seq, np.int16)
                moves.append(float(step[np.concatenate([[end], seq[:-1]]), seq].sum()))
            yield b[[*keep, "n", "known", "plain", "emit"]].assign(moves=moves)

    floor = float(np.log10(model.total + model.types + 1))
    out = rows.mapInPandas(run, f"{fields}, n long, known long, plain double, emit double, moves double")
    return out.select(*keep, F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
                      (F.col("plain") - F.col("n") * F.lit(floor)).alias("base_score"), (F.col("emit") + F.col("moves")).alias("score"))


def score_documents(df: DataFrame, train: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Fit on the rows for which ``train`` holds and score all rows."""
    model, words = fit_classes(df.where(train), text_col, **options)
    # ids cross to Python as text, since pandas would turn a batch with a null into floats
    rows = materialize(resolve(df, model, words, text_col, F.col(id_col).cast("long").cast("string").alias("_id"),
                               F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(train, F.lit(False)).alias("_train")))
    model.set_transitions(count_transitions(rows.where("_train"), model.classes, end_class(model)))
    return score(rows, model, "_id", "held_out").select(
        F.col("_id").cast("long").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
