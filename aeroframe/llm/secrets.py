"""Secret scans: multipart credential linking in native column expressions.

Strong credentials are reported wherever they stand. Weak candidates (short
assigned values, user or client names, endpoints) are reported only when a
complementary part starts within ``scope`` code points: an identifier or endpoint
near a secret, or a secret near either. The interval join stays inside the row:
complementary parts are sorted and thinned to the first and last of each cell of
``scope`` code points, and a weak part looks at its own cell (any part there is
near), the last one of the cell before and the first one of the cell after. So
nothing is shuffled and no pair of parts is ever built.

Edge cases: a null text counts as empty and has no spans; repeated rows are
scanned each on their own; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns (kind, pattern, group whose length counts, least length).
BASE = (
    ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]{14,}"),
    ("hex", r"[0-9a-f]{16,}"),
)
# Weak parts: identifiers and endpoints that mean nothing on their own.
WEAK_ID = r"""\b(?:[cC]lient_?[iI]d|[uU]ser(?:_?[nN]ame)?|[lL]ogin|[aA]ccount_?[iI]d)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/@-]+"""
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")
ASSIGN_LEAST = 12
WEAK_SECRET_LEAST = 6

_EMPTY = "array<struct<start:int,rank:int,end:int,value:int>>"


def _find(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """All matches as (start, rank, end, value length), code points."""
    pat = F.lit(pattern)
    whole = F.regexp_extract_all(text, pat, F.lit(0))
    values = F.regexp_extract_all(text, pat, F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("b"), whole.alias("w"), values.alias("v"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_EMPTY).alias("out"))

    def step(acc, x):
        at = acc["pos"] + F.length(x["b"])
        end = at + F.length(x["w"])
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.length(x["v"]).alias("value"))
        return F.struct(end.alias("pos"), F.array_append(acc["out"], span).alias("out"))

    found = F.aggregate(steps, start, step, lambda acc: acc["out"])
    # most texts hold no match: one look tells, where splitting and collecting take three
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_EMPTY))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _near(part: Column, others: str, scope: int) -> Column:
    """Whether a part starts within ``scope`` of any of ``others``, maps of a cell to its first and last start."""
    cell = F.floor(part["start"] / scope).cast("int")
    at = lambda name, c: F.try_element_at(F.col(others)[name], c)
    return (
        at("first", cell).isNotNull()
        | F.coalesce(at("last", cell - 1) >= part["start"] - scope, F.lit(False))
        | F.coalesce(at("first", cell + 1) <= part["start"] + scope, F.lit(False))
    )


def _by_cell(parts: Column, scope: int) -> Column:
    """struct(first, last): maps of a cell to the first and the last start in it."""
    starts = F.array_sort(F.transform(parts, lambda s: s["start"]))
    cell = lambda x: F.floor(x / scope).cast("int")
    entry = lambda x: F.struct(cell(x), x)
    first = F.filter(starts, lambda x, i: (i == 0) | (cell(F.get(starts, i - 1)) != cell(x)))
    last = F.filter(starts, lambda x, i: (i == F.size(starts) - 1) | (cell(F.get(starts, i + 1)) != cell(x)))
    return F.struct(F.map_from_entries(F.transform(first, entry)).alias("first"), F.map_from_entries(F.transform(last, entry)).alias("last"))


def find_secrets(df: DataFrame, text_col: str = "text", scope: int = 400) -> DataFrame:
    """Add ``_base`` and ``_spans``: arrays of (start, rank, end, value), sorted.

    ``rank`` indexes KINDS. ``_base`` holds the strong kinds alone.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.select(
        "*",
        _find(text, BASE[0][1], 0, 2).alias("_assign"),
        _find(text, BASE[1][1], 1).alias("_access"),
        _find(text, BASE[2][1], 2).alias("_hex"),
        _find(text, WEAK_ID, 4).alias("_weak_id"),
        _find(text, ENDPOINT, 5).alias("_endpoint"),
    )
    strong = F.filter("_assign", lambda s: s["value"] >= ASSIGN_LEAST)
    short = F.transform(
        F.filter("_assign", lambda s: (s["value"] < ASSIGN_LEAST) & (s["value"] >= WEAK_SECRET_LEAST)),
        lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), s["value"].alias("value")),
    )
    df = df.select("*", strong.alias("_strong"), short.alias("_short"))
    secrets = F.concat("_strong", "_hex", "_short")
    others = F.concat("_access", "_weak_id", "_endpoint")
    weak = F.concat("_short", "_weak_id", "_endpoint")
    df = df.select("*", F.concat("_strong", "_access", "_hex").alias("_found"), weak.alias("_weak"), secrets.alias("_secrets"), others.alias("_others"))
    # maps only where there is something to link
    linked = (F.size("_weak") > 0) & (F.size("_others") > 0) & (F.size("_secrets") > 0)
    df = df.select("*", F.when(linked, _by_cell(F.col("_secrets"), scope)).alias("_of_secrets"), F.when(linked, _by_cell(F.col("_others"), scope)).alias("_of_others"))
    told = F.filter("_weak", lambda s: F.when(s["rank"] == 3, _near(s, "_of_others", scope)).otherwise(_near(s, "_of_secrets", scope)))
    told = F.when(linked, told).otherwise(F.array().cast(_EMPTY))
    df = df.select("*", F.array_sort("_found").alias("_base"), F.array_sort(F.concat("_found", told)).alias("_spans"))
    return df.drop("_assign", "_access", "_weak_id", "_endpoint", "_strong", "_short", "_hex", "_weak", "_found", "_secrets", "_others", "_of_secrets", "_of_others")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """Per row: id, counts of the strong kinds, digest of the strong spans, all spans."""
    found = find_secrets(df.select(id_col, text_col), text_col, scope)
    count = lambda rank: F.size(F.filter("_base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        id_col,
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
    )


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", scope: int = 400) -> DataFrame:
    """The same rows with every reported span replaced by ``mark``.

    Overlapping spans are replaced once; rows without spans keep their text
    (null included) as it is.
    """
    columns = df.columns
    found = find_secrets(df, text_col, scope)
    text = F.col(text_col)

    def step(acc, s):
        gap = F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])
        new = F.concat(acc["out"], gap, F.lit(mark))
        return F.struct(
            F.greatest(acc["pos"], s["end"]).alias("pos"),
            F.when(s["start"] >= acc["pos"], new).otherwise(acc["out"]).alias("out"),
        )

    clean = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))),
    )
    return found.withColumn(text_col, F.when(F.size("_spans") > 0, clean).otherwise(text)).select(*columns)
