"""MinHash near-duplicates with sequential Bayesian verification.

1. Signatures: a document's set of five-word shingles is digested whole (128 bits)
   and into 128 minima. Documents of one digest are copies and form a class; only
   one representative of a class takes part from here on.
2. Bands of four minima give buckets. In each bucket every member is a candidate
   with four centres (smallest and largest class, and first and last by hash), so
   candidates grow with the members and never with their square.
3. Signature batches of 32 minima are compared in turn; a pair is pruned as soon
   as the posterior probability that its similarity reaches the threshold falls
   below ``miss`` (uniform prior). Survivors are verified on full shingle sets.
4. Verified links label the classes. Buckets that still hold several labels are
   open: small ones compare all pairs of different labels, large ones every
   member outside the largest label against all others, in blocks of bounded
   size, pruned and verified inside the block. So each pair that shares a bucket is compared
   or already connected, without any cap. All links give the components.

Edge cases: a null or empty text has no shingles, links with nothing and is its
own component; fewer words than five form one shingle; a null id is kept as
null and counts only if its whole component has no id; rows that share an id
are judged by their own text; an empty input gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.common import bound_batches, connected_components, materialize

HASHES, ROWS, BATCH = 128, 4, 32
_BLOCK, _SMALL = 256, 24
_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lowered, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a whole text."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * _STEP + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(out + np.uint64(n)))


def digest_of(found: np.ndarray) -> bytes | None:
    """128 bits for a shingle set; None for the empty set."""
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def signature(found: np.ndarray) -> bytes:
    low = np.full(HASHES, 2**32 - 1, np.uint64)
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048, None] ^ _FLIP
        np.minimum(low, ((part * _MULT) >> np.uint64(32)).min(axis=0), out=low)
    return low.astype("<u4").tobytes()


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each number of compared minima, the fewest matches that survive.

    With a uniform prior, P(similarity >= t | m of n match) = P(Bin(n+1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _survive(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two signature matrices survive all batches."""
    alive, same = np.arange(len(a)), np.zeros(len(a), int)
    for k, m in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        same[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[same[alive] >= m]
    return alive


def _matrix(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), "<u4").reshape(-1, HASHES)


def _signed(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """docs -> keep columns, n_shingles, digest, sig. Long columns cross to Python as
    text, since pandas would turn a batch with a null into floats."""
    rows = docs.select(*[F.col(c).cast("string") for c in keep], text.alias("_text"))
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")

    def run(batches):
        for b in batches:
            found = [shingles(t) for t in b["_text"]]
            out = b.drop(columns="_text")
            out["n_shingles"] = np.array([len(s) for s in found], np.int64)
            out["digest"] = [digest_of(s) for s in found]
            out["sig"] = [signature(s) if len(s) else None for s in found]
            yield out

    return rows.mapInPandas(run, f"{schema}, n_shingles long, digest binary, sig binary").withColumns({c: F.col(c).cast(types[c]) for c in keep})


def _bayes(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(a, b) pairs of classes -> those that survive the batches."""
    least = least_matches(threshold, miss)
    side = classes.select("cls", "sig", "n_shingles")
    rows = (
        pairs.join(side.toDF("a", "sa", "na"), "a").join(side.toDF("b", "sb", "nb"), "b")
        .where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")).select("a", "b", "sa", "sb")
    )

    def run(batches):
        for p in batches:
            kept = _survive(_matrix(p["sa"]), _matrix(p["sb"]), least)
            yield p.iloc[kept][["a", "b"]]

    return rows.mapInPandas(run, "a long, b long")


def _sets(need: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls) -> (cls, set): full shingle sets, from the texts of the classes' rows."""
    ids = classes.join(need.distinct(), "cls").select(F.col("row").alias("_row"), F.col("cls").alias("_cls"))  # one row a class
    texts = docs.select("_row", "_text").join(ids, "_row")

    def sets(batches):
        for b in batches:
            found = [shingles(t) for t in b["_text"]]
            yield pd.DataFrame({"cls": b["_cls"], "set": [s.tobytes() for s in found]})

    return texts.mapInPandas(sets, "cls long, set binary").dropDuplicates(["cls"])


def _linked(x: bytes, y: bytes, percent: int) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Exact check of surviving pairs on full shingle sets."""
    need = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    full = materialize(_sets(need, docs, classes))
    rows = pairs.join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b")

    def check(batches):
        for p in batches:
            yield p[[_linked(x, y, percent) for x, y in zip(p["sa"], p["sb"])]][["a", "b"]].set_axis(["u", "v"], axis=1)

    return rows.mapInPandas(check, "u long, v long")


def _blocks(members: DataFrame, threshold: float, miss: float, percent: int) -> DataFrame:
    """Large open buckets (band, cls, label, sig, set): every member outside the
    largest label against all members of other labels, in blocks -> links.

    A block compares signatures, verifies survivors on their sets, passes over
    pairs that its own links already connect, and so returns a forest: fewer
    links than it has members."""
    least = least_matches(threshold, miss)
    most = members.groupBy("band", "label").count().groupBy("band").agg(
        F.max_by("label", F.struct("count", "label")).alias("giant"), F.max("count").alias("n_giant"), F.sum("count").alias("n"))
    rows = members.join(most, "band")
    n_block = F.ceil(F.col("n") / _BLOCK).cast("int")
    n_rest = F.ceil((F.col("n") - F.col("n_giant")) / _BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    kept = ["band", "cls", "label", "sig", "set"]
    left = rows.select(*kept, own(n_block).alias("i"), F.explode(F.sequence(F.lit(0), n_rest - 1)).alias("j"), F.lit(False).alias("rest"))
    right = rows.where("label != giant").select(*kept, F.explode(F.sequence(F.lit(0), n_block - 1)).alias("i"), own(n_rest).alias("j"), F.lit(True).alias("rest"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[~pdf["rest"]], pdf[pdf["rest"]]
        out, up = [], {}

        def root(n):
            up.setdefault(n, n)
            while up[n] != n:
                up[n] = up[up[n]]
                n = up[n]
            return n

        sx, lx, cx, full = _matrix(x["sig"]), x["label"].to_numpy(), x["cls"].to_numpy(), x["set"].to_numpy()
        for c, label, sig, mine in zip(y["cls"], y["label"], y["sig"], y["set"]):
            other = np.flatnonzero(lx != label)
            for k in other[_survive(sx[other], np.broadcast_to(_matrix([sig]), (len(other), HASHES)), least)]:
                # members of one label are connected
                a, b = root(int(label)), root(int(lx[k]))
                if a != b and _linked(mine, full[k], percent):
                    up[a] = b
                    out.append((int(c), int(cx[k])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return left.unionByName(right).groupBy("band", "i", "j").applyInPandas(run, "u long, v long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, miss: float = 1e-9,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept; and its row hash
    (of id and text) and component of texts (null without shingles)."""
    spark = df.sparkSession
    bound_batches(spark, 500)
    threshold = percent / 100
    docs = df.select(F.col(id_col).cast("long").alias("_key"), F.col(text_col).alias("_text")).withColumn("_row", row_hash("_key", "_text"))
    base = materialize(_signed(docs, F.col("_text"), "_key", "_row"))
    classes = materialize(
        base.where("digest is not null").groupBy("digest").agg(
            F.min("_key").alias("key"), F.min("_row").alias("row"), F.any_value("sig").alias("sig"), F.any_value("n_shingles").alias("n_shingles"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    starts = F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1))
    banded = classes.select("cls", F.explode(F.transform(
        starts, lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * (4 * ROWS) + 1, F.lit(4 * ROWS))))).alias("band"))
    shared = banded.groupBy("band").agg(
        F.min("cls").alias("low"), F.max("cls").alias("high"), F.min_by("cls", F.xxhash64("cls")).alias("first"),
        F.max_by("cls", F.xxhash64("cls")).alias("last"), F.count("*").alias("size"),
    ).where("low < high")
    # only members of shared buckets go on
    bands = materialize(banded.join(shared, "band"))

    def pair(a: str, b: str):
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    centres = F.explode(F.array_distinct(F.array("low", "high", "first", "last")))
    stars = bands.select("cls", centres.alias("c")).where("cls != c").select(*pair("cls", "c")).distinct()
    links = materialize(_verified(materialize(_bayes(stars, classes, threshold, miss)), docs, classes, percent))

    # a bucket of up to three has had all its pairs compared
    labels = materialize(connected_components(links)).toDF("cls", "label")
    marked = bands.where("size > 3").select("band", "cls", "size").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    open_ = marked.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("band")
    marked = materialize(marked.join(open_, "band"))
    few = marked.where(F.col("size") <= _SMALL).select("band", "cls", "label")
    rest = few.join(few.toDF("band", "cls2", "label2"), "band").where("label < label2").select(*pair("cls", "cls2")).distinct()
    more = _verified(materialize(_bayes(rest, classes, threshold, miss)), docs, classes, percent)
    large = marked.where(F.col("size") > _SMALL).select("band", "cls", "label")
    if not large.isEmpty():
        sets = _sets(large.select("cls"), docs, classes)
        members = materialize(large.join(classes.select("cls", "sig").join(sets, "cls"), "cls"))
        more = more.unionByName(_blocks(members, threshold, miss, percent))
    more = materialize(more)
    # members of a label are connected by its smallest class
    links = labels.select(F.col("cls").alias("u"), F.col("label").alias("v")).unionByName(more)
    labels = connected_components(links).toDF("cls", "label")
    known = classes.select("digest", "cls", "key").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = known.groupBy("label").agg(F.min("key").alias("component_id"))
    named = known.join(smallest, "label").select("digest", "label", "component_id")
    out = base.drop("sig").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("_key")).otherwise(F.col("component_id"))
    return out.select(
        F.col("_key").alias(id_col), "n_shingles", component.alias("component_id"), F.col("_key").eqNullSafe(component).alias("kept"),
        F.col("_row").alias("row"), F.col("label").alias("group"))


def row_hash(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text, nulls apart from empty texts."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("-")), F.when(F.col(text_col).isNull(), "n").otherwise(F.concat(F.lit("t"), F.col(text_col)))))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each group the one with the
    smallest id stays (of equal ids, one), and of rows equal in id and text, one."""
    found = materialize(near_duplicates(df, id_col, text_col, percent).select("kept", "row", "group"))
    chosen = found.where("kept").groupBy(F.coalesce(F.col("group").cast("string"), "row")).agg(F.min("row").alias("_row")).select("_row")
    rows = df.withColumn("_row", row_hash(id_col, text_col)).join(chosen, "_row", "left_semi")
    if not found.groupBy("row").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["_row"])
    return rows.select(*df.columns)
