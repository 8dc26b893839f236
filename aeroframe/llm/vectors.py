"""Embedding near-duplicates by a robust-pruned flat graph.

1. Vectors that are equal to the last bit (of one label, by 128 bits of hash) form
   a class and are handled once, with their number.
2. Cluster centres are fitted on at most ``sample`` classes. The nearest centre is
   a vector's home; it also visits every other shard whose border with its home is
   no more than half the largest linked distance away. Of two linked vectors, at
   least one so visits the home of the other: shards overlap as far as needed for
   no link to be lost, and no further. A shard is held by one task up to 4
   ``block`` vectors at home and 16 ``block`` in all; beyond, it is split by hash
   into cells, one for each part at home and each part of all.
3. In each cell a flat graph of the vectors at home is built (nearest candidates,
   robust pruning), so every vector is indexed once in each cell that holds it.
4. Every member of the cell, at home or visiting, searches the graph: greedy best-first
   search from the medoids of its connected parts, then range expansion along
   nodes near the query. Hits are verified by cosine in double precision.
5. Every query is audited: its hits are held against the exact similarities to all
   nodes, and missing ones are added. ``n_found`` tells what the graph had found
   alone, so recall (the sum of n_found over that of n_links) is measured over all
   rows, not over a sample.
6. A pair whose vectors visit each other's homes counts once for either. A task
   returns counts and a spanning forest of the links it saw; no list of all pairs
   is built.

Disk: in many dimensions a vector visits many shards, so the cells are dealt out in
rounds, each of which exchanges no more than ``share`` times the vectors themselves
(or ``least`` bytes). What a round or a step leaves is deleted before the next one.
Vectors travel as they came (32-bit floats stay so) and are normed in the tasks.

Edge cases: null, empty and zero vectors and vectors with null or non-finite
components link with nothing, as do those without a label; vectors of different
lengths are never compared; a null id is kept as null; rows that share an id
count as separate vectors; an empty input gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from aeroframe.llm.common import connected_components, exchanges_dropped, materialize, settled


def robust_prune(far: np.ndarray, among: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Which candidates (of each node, nearest first) no kept candidate covers.

    ``far`` holds the distances from node to candidate, ``among`` those between
    the candidates of a node.
    """
    alive, kept = np.ones(far.shape, bool), np.zeros(far.shape, bool)
    for k in range(far.shape[1]):
        kept[:, k] = alive[:, k] & (kept.sum(axis=1) < degree)
        alive &= ~kept[:, k, None] | (alpha * among[:, k] > far)
    return kept


def build_graph(vectors: np.ndarray, degree: int = 24, candidates: int = 64, alpha: float = 1.2, most: int = 48) -> np.ndarray:
    """Adjacency rows of one cell, padded with the number of nodes: pruned nearest
    candidates, then back links, nearest first, up to ``most`` links in all."""
    n = len(vectors)
    m = min(candidates, n - 1)
    pairs = [np.empty((3, 0))]
    for lo in range(0, n if m else 0, 256):
        sims = vectors[lo : lo + 256] @ vectors.T
        sims[np.arange(len(sims)), np.arange(lo, lo + len(sims))] = -2
        top = np.argpartition(sims, n - m, axis=1)[:, n - m :]
        near = np.take_along_axis(sims, top, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        top, near = np.take_along_axis(top, order, 1), np.take_along_axis(near, order, 1)
        held = vectors[top]
        among = np.sqrt(np.maximum(2 - 2 * held @ held.transpose(0, 2, 1), 0))
        r, c = np.nonzero(robust_prune(np.sqrt(np.maximum(2 - 2 * near, 0)), among, degree, alpha))
        pairs.append(np.stack([lo + r, top[r, c], near[r, c]]))
    u, v, s = np.hstack(pairs)
    u, v, s = np.r_[u, v].astype(np.int64), np.r_[v, u].astype(np.int64), np.r_[s, s]
    _, first = np.unique(u * n + v, return_index=True)  # of a link both ways, the one chosen by u comes first
    back = first >= len(s) // 2
    first = first[np.lexsort((-s[first], back, u[first]))]
    u, v = u[first], v[first]
    rank = np.arange(len(u)) - np.searchsorted(u, u)
    u, v, rank = u[rank < most], v[rank < most], rank[rank < most]
    table = np.full((n, rank.max(initial=0) + 1), n)
    table[u, rank] = v
    return table


def entry_points(vectors: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The medoid of each connected part of a graph."""
    n = len(vectors)
    near = np.where(table == n, np.arange(n)[:, None], table)
    part = np.arange(n)
    while True:
        low = np.minimum(part, part[near].min(axis=1))
        np.minimum.at(low, near.ravel(), np.repeat(low, near.shape[1]))
        low = low[low]
        if (low == part).all():
            break
        part = low
    names, of = np.unique(part, return_inverse=True)
    means = np.zeros((len(names), vectors.shape[1]))
    np.add.at(means, of, vectors)
    close = np.einsum("nd,nd->n", vectors, means[of])
    order = np.lexsort((-close, of))
    return order[np.searchsorted(of[order], np.arange(len(names)))]


def greedy_search(sims: np.ndarray, table: np.ndarray, starts: np.ndarray, beam: int, patience: int = 5) -> np.ndarray:
    """Best-first search of all queries at once -> nodes met (one row per query, a
    last column for the padding).

    ``sims`` tells the similarity of a query (row) to a node; only nodes met on the
    way are looked up. A query starts from the nearest of ``starts``, a quarter of
    ``beam`` at most, and opens the nearest node it has met but not opened, up to
    twice ``beam`` nodes; it ends early when ``patience`` nodes told of nothing nearer.
    """
    q, n = sims.shape
    met = np.zeros((q, n + 1), bool)
    todo = np.full((q, n + 1), -np.inf, sims.dtype)
    m = min(len(starts), max(1, beam // 4))
    close = sims[:, starts]
    best = np.argpartition(-close, m - 1, axis=1)[:, :m]
    np.put_along_axis(met, starts[best], True, 1)
    np.put_along_axis(todo, starts[best], np.take_along_axis(close, best, 1), 1)
    live, at, top, idle = np.arange(q), np.arange(q), close.max(axis=1), np.zeros(q, int)
    for _ in range(2 * beam):
        pick = todo.argmax(axis=1)
        on = np.flatnonzero((todo[at, pick] > -np.inf) & (idle < patience))
        if len(on) < 0.7 * len(live):  # rows that ended are kept until they are many
            live, pick, todo, top, idle = live[on], pick[on], todo[on], top[on], idle[on]
            at = on = np.arange(len(live))
        if not len(on):
            break
        rows, pick = live[on], pick[on]
        todo[on, pick] = -np.inf
        new = table[pick]
        known = met[rows[:, None], new]
        known |= new == n
        r, c = np.nonzero(~known)
        nodes = new[r, c]
        s = sims[rows[r], nodes]
        met[rows[r], nodes] = True
        todo[on[r], nodes] = s
        rise = np.full(len(on), -np.inf, sims.dtype)
        np.maximum.at(rise, r, s)
        up = rise > top[on]
        idle[on] = np.where(up, 0, idle[on] + 1)
        top[on] = np.maximum(top[on], rise)
    return met


def expand_range(wide: np.ndarray, q: np.ndarray, nodes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """All nodes that queries ``q`` reach from ``nodes`` through nodes that are
    ``wide`` for them (one row per query, a column of False for the padding)."""
    hit = np.zeros(wide.shape, bool)
    while len(q):
        hit[q, nodes] = True
        near = table[nodes].ravel()
        q = np.repeat(q, table.shape[1])
        on = np.flatnonzero(wide[q, near] & ~hit[q, near])
        if not len(on):
            break
        q, nodes = np.divmod(np.unique(q[on] * wide.shape[1] + near[on]), wide.shape[1])
    return hit[:, :-1]


def _united(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of parts after those of ``a`` and ``b`` are united, pair by pair."""
    up = np.arange(len(part))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in np.unique(np.stack([a, b]), axis=1).T:
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    return np.array([root(x) for x in range(len(up))])[part] if len(a) else part


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; by the largest component first, so that no square overflows."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _search(t: pa.Table, cosine: float, beam: int) -> pa.Table:
    """Counts and a spanning forest of the links that a cell's members have with
    the vectors at home in it."""
    cls, n, home, held, asks = (t[c].to_numpy() for c in ("cls", "n", "home", "held", "asks"))
    own = t["shard"][0].as_py()
    at, asks = np.flatnonzero(held), np.flatnonzero(asks)
    if not len(at) or not len(asks):
        return pa.table({k: pa.array([], pa.int64()) for k in ("cls", "links", "found", "other")})
    v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    unit = _unit(v.reshape(len(t), -1))
    short = unit.astype(np.float32)
    slack = (unit.shape[1] + 4) * 2.0**-23  # more than 32-bit similarities can be off
    ids, count, x, xs = cls[at], n[at].astype(np.float64), unit[at], short[at]
    place = np.full(len(t), -1)
    place[at] = np.arange(len(at))
    table = build_graph(xs)
    starts, wide = entry_points(xs, table), 2 * cosine - 1

    # a visitor that has this vector for a visitor too is credited there
    homes = np.unique(home[asks])
    lists = t["shards"].combine_chunks().take(pa.array(at))
    entered = lists.flatten().to_numpy()
    spot = np.minimum(np.searchsorted(homes, entered), len(homes) - 1)
    known = homes[spot] == entered
    credit = np.ones((len(homes), len(at)), bool)
    credit[spot[known], np.repeat(np.arange(len(at)), np.diff(lists.offsets.to_numpy()))[known]] = False

    part, guests = np.arange(len(at)), np.zeros((2, len(at)))
    out = []
    for lo in range(0, len(asks), 256):
        who = asks[lo : lo + 256]
        sims = short[who] @ xs.T
        near = np.zeros((len(who), len(at) + 1), bool)
        np.greater_equal(sims, wide, out=near[:, :-1])
        met = greedy_search(sims, table, starts, beam)
        met &= near
        k = np.flatnonzero(place[who] >= 0)
        near[k, place[who[k]]] = False
        some = np.flatnonzero(near.any(axis=1))  # a row without any has neither hits nor links
        near[k, place[who[k]]] = True
        who, near, sims = who[some], near[some], sims[some]
        hit = expand_range(near, *np.nonzero(met[some]), table)
        exact = sims >= cosine + slack
        k, o = np.nonzero((sims >= cosine - slack) & ~exact)
        exact[k, o] = np.einsum("nd,nd->n", unit[who[k]], x[o]) >= cosine
        k = np.flatnonzero(place[who] >= 0)
        exact[k, place[who[k]]] = False
        some = np.flatnonzero(exact.any(axis=1))
        if not len(some):
            continue
        who, exact, hit = who[some], exact[some], hit[some] & exact[some]
        k, o = np.nonzero(exact)
        begin = np.searchsorted(k, np.arange(len(who)))
        of = part[o]
        low = np.minimum.reduceat(of, begin)[k]
        part = _united(part, of[of != low], low[of != low])
        out.append(np.stack([cls[who], exact @ count, hit @ count, ids[o[begin]]]).astype(np.int64))
        guest = np.flatnonzero(home[who] != own)
        if len(guest):
            ours = credit[np.searchsorted(homes, home[who[guest]])]
            many = n[who[guest]].astype(np.float64)
            guests += many @ (exact[guest] & ours), many @ (hit[guest] & ours)
    seen = np.flatnonzero((guests[0] > 0) | (part != np.arange(len(at))))
    out.append(np.stack([ids[seen], *guests[:, seen].astype(np.int64), ids[part[seen]]]))
    return pa.table(dict(zip(("cls", "links", "found", "other"), np.hstack(out), strict=True)))


def _fit_centres(sample: pd.DataFrame, sizes: dict, shard: int, most: int, seed: int = 11) -> dict:
    """(label, dimension) -> centres, by a few rounds of spherical k-means."""
    rng = np.random.default_rng(seed)
    total, out = max(1, sum(sizes.values())), {}
    for key, part in sample.groupby(["label", "dim"]):
        x = _unit(np.stack(part["v"].to_numpy()))
        k = min(len(x) // 4, -(-sizes.get(key, 0) // shard), max(1, most * sizes.get(key, 0) // total))
        if k < 2:
            continue
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            own = np.concatenate([(x[lo : lo + 1024] @ c.T).argmax(axis=1) for lo in range(0, len(x), 1024)])
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
        out[key] = c
    return out


def _shards(x: np.ndarray, c: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home of each unit vector, and all shards it enters as (row, shard)."""
    homes, rows, entered = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo in range(0, len(x), 256):
        s = x[lo : lo + 256] @ c.T
        home = s.argmax(axis=1)
        apart = np.sqrt(np.maximum(2 - 2 * c[home] @ c.T, 0))
        r, k = np.nonzero(s >= s[np.arange(len(s)), home][:, None] - half * apart)
        homes.append(home)
        rows.append(lo + r)
        entered.append(k)
    return np.concatenate(homes), np.concatenate(rows), np.concatenate(entered)


def _classes(df: DataFrame, most_centres: int, sample: int, shard: int, half: float) -> DataFrame:
    """One row per class with its vector, its home and the shards it enters."""
    classes = materialize(df.where("a is not null").groupBy("a", "b").agg(
        F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.min("key").alias("key"), F.count("*").alias("n"),
    ).select(F.monotonically_increasing_id().alias("cls"), "a", "b", "label", F.size("v").alias("dim"), "v", "key", "n"))
    sizes = {(r["label"], r["dim"]): r["count"] for r in classes.groupBy("label", "dim").count().orderBy(F.desc("count"), "label", "dim").limit(most_centres).collect()}
    picked = classes.orderBy(F.xxhash64("a", "b")).limit(sample).select("label", "dim", "v").toPandas()
    centres = df.sparkSession.sparkContext.broadcast(_fit_centres(picked, sizes, shard, most_centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            v = b["v"].flatten().to_numpy(zero_copy_only=False)
            begin = b["v"].offsets.to_numpy().astype(np.int64) - b["v"].offsets[0].as_py()
            homes, rows, entered = np.zeros(len(b), np.int32), [], []
            for key, at in pd.DataFrame({"label": b["label"].to_pandas(), "dim": b["dim"].to_numpy()}).groupby(["label", "dim"]).indices.items():
                c = centres.value.get(key)
                if c is None:
                    rows.append(at)
                    entered.append(np.zeros(len(at), np.int64))
                    continue
                homes[at], r, k = _shards(_unit(v[begin[at][:, None] + np.arange(key[1])]), c, half)
                rows.append(at[r])
                entered.append(k)
            rows, entered = np.concatenate(rows), np.concatenate(entered)
            ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(b)))].astype(np.int32)
            shards = pa.ListArray.from_arrays(ends, entered[np.argsort(rows, kind="stable")].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, shards, pa.array(homes)], names=[*b.schema.names, "shards", "home"])

    return classes.mapInArrow(assign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", shards array<int>, home int")


def _cells(dealt: DataFrame, block: int, share: float, least: int) -> tuple[DataFrame, int]:
    """(a row for each cell a class enters, with the round it goes in, number of rounds)."""
    keys = ["label", "dim", "shard"]
    here = F.col("home") == F.col("shard")
    bulk = F.greatest(F.lit(1.0), F.col("dim") / 256)
    counts = materialize(
        dealt.select("label", "dim", "home", F.explode("shards").alias("shard")).groupBy(*keys)
        .agg(F.count("*").alias("all"), F.count_if(here).alias("own")).withColumns({
            "parts": F.greatest(F.lit(1), F.ceil(F.col("own") * bulk / (4 * block))).cast("int"),
            "turns": F.greatest(F.lit(1), F.ceil(F.col("all") * bulk / (16 * block))).cast("int"),
        }))
    wide = 4 if isinstance(dealt.schema["v"].dataType.elementType, FloatType) else 8
    size = F.col("dim") * wide + 100
    sent, own = counts.select(F.sum((F.col("all") * F.col("parts") + F.col("own") * (F.col("turns") - 1)) * size), F.sum(F.col("own") * size)).first()
    rounds = max(1, -(-int(sent or 0) // max(least, int(share * (own or 0)))))
    # a list of at most one shard for each 4 * block rows
    split = F.broadcast(counts.where("parts > 1 OR turns > 1").select(*keys, "parts", "turns"))
    one = lambda c: F.coalesce(c, F.lit(1))
    members = dealt.select("cls", "n", "v", "shards", "home", "label", "dim", F.explode("shards").alias("shard")).join(split, keys, "left")
    part, turn = F.pmod(F.xxhash64("cls"), one("parts")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "cls"), one("turns")).cast("int")
    cell = lambda i, j, held, asks: F.struct(i.alias("i"), j.alias("j"), held.alias("held"), F.lit(asks).alias("asks"))
    asked = F.transform(F.sequence(F.lit(0), one("parts") - 1), lambda j: cell(turn, j, here & (j == part), True))
    shown = F.transform(F.filter(F.sequence(F.lit(0), one("turns") - 1), lambda i: here & (i != turn)), lambda i: cell(i, part, F.lit(True), False))
    placed = members.select("cls", "n", "v", "shards", "home", *keys, F.explode(F.concat(asked, shown)).alias("cell")).select("*", "cell.*").drop("cell")
    placed = placed.withColumn("shards", F.when(F.col("held"), F.col("shards")).otherwise(F.array().cast("array<int>")))
    return placed.withColumn("round", F.pmod(F.xxhash64(*keys, "i", "j"), F.lit(rounds))), rounds


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98,
    shard: int = 1500, most_centres: int = 16_384, block: int = 1024, sample: int = 65_536, beam: int = 48, share: float = 1.25, least: int = 1 << 28,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept, n_found."""
    spark, kind = df.sparkSession, df.schema[vector_col].dataType
    kind = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    rows = df.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    good = F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("label", F.col("label").cast("string")).withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumns({"a": F.when(F.col("good"), F.xxhash64("label", "v")), "b": F.when(F.col("good"), F.xxhash64(F.lit(1), "v", "label"))})
    half = (2 - 2 * cosine) ** 0.5 / 2 + 1e-9

    def known() -> DataFrame:
        dealt = settled(spark, lambda: _classes(rows, most_centres, sample, shard, half))
        cells, rounds = _cells(dealt, block, share, least)

        def search(t: pa.Table) -> pa.Table:
            return _search(t, cosine, beam)

        result = None
        for k in range(rounds):
            told = cells.where(F.col("round") == k).drop("round").groupBy("label", "dim", "shard", "i", "j").applyInArrow(search, "cls long, links long, found long, other long")
            told = materialize(told)
            result = told if result is None else result.unionByName(told)
        total = result.groupBy("cls").agg(F.sum("links").alias("links"), F.sum("found").alias("found"))
        edges = result.select(F.col("cls").alias("u"), F.col("other").alias("v"))
        named = dealt.select("cls", "a", "b", "key", "n").join(connected_components(edges).toDF("cls", "part"), "cls", "left").withColumn("part", F.coalesce("part", "cls"))
        smallest = named.groupBy("part").agg(F.min("key").alias("component"))
        more = lambda c: (F.coalesce(c, F.lit(0)) + F.col("n") - 1).alias(c)
        return named.join(smallest, "part").join(total, "cls", "left").select("a", "b", "component", more("links"), more("found"))

    with exchanges_dropped(spark):
        told = settled(spark, known)
    out = rows.select("key", "a", "b").join(told, ["a", "b"], "left")
    component = F.when(F.col("a").isNull(), F.col("key")).otherwise(F.col("component"))
    return out.select(F.col("key").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("key").eqNullSafe(component).alias("kept"), F.coalesce("found", F.lit(0)).cast("long").alias("n_found"))
