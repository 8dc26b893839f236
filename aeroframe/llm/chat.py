"""Chat formatting with budgeted, turn-aligned windows; native expressions only.

A conversation's turns get token estimates; prefix sums of these choose spans:
turns whose prefix falls into one cell of half the fresh budget stand together,
and a turn longer than half a cell stands alone, so that a span never depends
on the one before it. Each window repeats the conversation's system turn (where
its first turn is one) and the turns directly before it that fit whole into the
history budget; repeated turns are never trained on. Only fresh assistant turns
are under the loss mask, so each is a target once.

Control strings inside roles and texts are escaped reversibly: a backslash is
doubled, then ``<|`` becomes ``<\\|`` and, in roles, a line feed ``<\\n``.

Edge cases: null texts and roles count as empty; turns are ordered by (turn,
role, text), nulls first, so ties and repeated rows have one defined order; a
null conversation id is a conversation of its own; an empty input gives no
windows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
TURN_OVERHEAD = 4  # estimated tokens of a turn's marks


def estimate_tokens(text: Column) -> Column:
    """Four bytes a token, plus the turn's marks."""
    return (F.ceil(F.octet_length(text) / 4) + TURN_OVERHEAD).cast("long")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_windows(
    df: DataFrame, budget: int = 1024, history: int = 256,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """-> conv_id, window, formatted, loss (array of start, end in code points), n_repeated.

    ``budget`` bounds history and fresh turns together, as long as no single
    turn is longer; the system turn comes on top. Windows of a conversation are
    numbered by ``window`` in rising order, with gaps.
    """
    half = max((budget - history) // 2, 1)
    turns = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("tokens", estimate_tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.select(
        "*", F.row_number().over(order).alias("rn"),
        F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.first(F.when(F.col("role") == "system", F.struct("role", "text"))).over(order).alias("system"),
    )
    turns = turns.withColumn(
        "window", F.floor(F.col("before") / half).cast("long") * 2 + F.when(F.col("tokens") > half, 1).otherwise(0)
    )
    back = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, -1)
    prior = F.lag("window").over(Window.partitionBy("conv_id").orderBy("before"))
    turns = turns.select("*", (prior.isNull() | (prior != F.col("window"))).alias("opens"),
                         F.collect_list(F.struct("rn", "role", "text")).over(back).alias("near"))
    turns = turns.withColumn("near", F.when(F.col("opens"), F.col("near")))
    windows = turns.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("rn", "role", "text"))).alias("fresh"),
        F.min("rn").alias("first"), F.max("system").alias("system"), F.max("near").alias("near"),
    )
    line = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    kept_system = (F.col("first") > 1) & F.col("system").isNotNull()
    near = F.filter("near", lambda t: ~(F.col("system").isNotNull() & (t["rn"] == 1)))
    repeated = F.concat(
        F.when(kept_system, F.array(F.struct(F.col("system.role").alias("role"), F.col("system.text").alias("text"))))
        .otherwise(F.array().cast("array<struct<role:string,text:string>>")),
        F.transform(near, line),
    )
    windows = windows.select("conv_id", "window", repeated.alias("repeated"), F.transform("fresh", line).alias("fresh"))

    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    shown = lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))
    windows = windows.select(
        "conv_id", "window", F.size("repeated").alias("n_repeated"),
        F.concat_ws("", F.transform("repeated", shown)).alias("lead"),
        F.concat_ws("", F.transform("fresh", shown)).alias("body"),
        F.transform("fresh", lambda t: F.struct(
            F.length(head(t)).alias("head"), F.length(escape(t["text"])).alias("body"), (t["role"] == "assistant").alias("target"))).alias("sizes"),
    )
    spans = "array<struct<start:int,end:int>>"

    def step(acc, s):
        start = acc["pos"] + s["head"]
        end = start + s["body"]
        return F.struct(
            (end + len(END)).alias("pos"),
            F.when(s["target"], F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end")))).otherwise(acc["out"]).alias("out"),
        )

    loss = F.aggregate("sizes", F.struct(F.length("lead").alias("pos"), F.array().cast(spans).alias("out")), step, lambda acc: acc["out"])
    return windows.select("conv_id", "window", F.concat("lead", "body").alias("formatted"), loss.alias("loss"), "n_repeated")


def read_back(windows: DataFrame) -> DataFrame:
    """Parse formatted windows: conv_id, window, turns (role, text), targets, n_chars."""
    marks = F.split("formatted", r"<\|im_start\|>", -1)
    parts = F.slice(marks, F.col("n_repeated") + 2, F.size(marks))
    role = lambda p: F.substring_index(p, "\n", 1)
    turns = F.transform(parts, lambda p: F.struct(
        unescape_role(role(p)).alias("role"),
        unescape(F.substring(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - len(END))).alias("text"),
    ))
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.length("formatted").alias("n_chars"))


def digest(windows: DataFrame) -> DataFrame:
    """Per conversation, what the formatted windows give back (see ``read_back``).

    A digest of a whole conversation needs its whole text in one row; windows
    themselves never do.
    """
    back = read_back(windows).select(
        "conv_id", "window", F.size("turns").alias("n"), "n_chars",
        F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("said"),
        F.concat_ws("", "targets").alias("target"),
    )
    whole = back.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "said", "target"))).alias("all"),
    )
    target = F.concat_ws("", F.col("all.target"))
    return whole.select(
        "conv_id", F.col("n_turns").cast("long"),
        F.sha2(F.concat_ws("", F.col("all.said")), 256).alias("turns_sha256"),
        F.length(target).cast("long").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )
