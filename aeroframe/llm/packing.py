"""Best-fit packing into training sequences by the sum-of-squares rule.

A document becomes its token ids and one end id. Only documents longer than a
sequence are cut: into full pieces, with the shorter one first. Pieces are
dealt at random into shards of about ``shard_docs`` documents; in a shard,
pieces go in falling length, each into the open bin that leaves the sum of squared
counts of open bins per residual gap smallest; ties take the tightest gap, and a
new bin is opened only where no open one has room. Shards are independent, so a
lost executor costs its shards only, and the price is at most a bin or so per shard.

Ids are those of the byte-level BPE file given by its path: its vocabulary is
read from the JSON and applied by a faster encoder with the same merges, which
the tests hold against the file's own library.

Edge cases: a null text counts as empty and is just the end id; null or
repeated ids and repeated rows are packed as rows of their own; an empty input
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.common import bound_batches


def default_tokenizer() -> str:
    """The tokenizer file of the packing contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def encoder(path: str):
    """An encoder for a byte-level BPE tokenizer file; special strings keep their ids."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the format's printable stand-ins for bytes: printable ones as they are, others from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, path: str, end_id: int = 0) -> np.ndarray:
    ids = encoder(path).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, np.uint32(end_id)).astype("<u4")


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than ``size``."""
    head = n % size
    cuts = ([0] if head else []) + list(range(head, n, size))
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], n])]


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(size + 1, np.int64)  # open bins by gap; a full bin is not open
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    held: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        # gap h -> h - s: (1 - 2 N[h]) + (2 N[h-s] + 1), the latter 0 at a perfect fit
        change = 2 - 2 * count[s:size] + 2 * count[: size - s]
        if s < size:
            change[0] = 1 - 2 * count[s]
            change[count[s:size] == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
        if s == size or not count[best + s]:
            gap, b = size, len(held)
            held.append([])
        else:
            gap = best + s
            b = stacks[gap].pop()
            count[gap] -= 1
        held[b].append(int(i))
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
    k = 0
    for h in held:
        if h:
            at = 0
            for i in h:
                bins[i], offsets[i] = k, at
                at += int(lengths[i])
            k += 1
    return bins, offsets


def pack(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    size: int = 2048, end_id: int = 0, shard_docs: int = 8192, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = df.sparkSession
    bound_batches(spark)
    # ids cross to Python as text, since pandas would turn a batch with a null into floats
    docs = df.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    shards = max(1, -(-docs.count() // shard_docs))
    kept = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = token_ids(text, tokenizer_path, end_id)
                for k, (start, n) in enumerate(pieces_of(len(ids), size)):
                    part = ids[start : start + n]
                    rows.append((doc, k, start, n, zlib.crc32(part.tobytes())) + ((part.astype("i4"),) if with_ids else ()))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    cuts = docs.mapInPandas(cut, kept)
    shard = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        bins, at = sum_of_squares(pdf["length"].to_numpy(), size)
        pdf["sequence_id"] = pdf["shard"].to_numpy() * 2**32 + bins
        pdf["offset"] = at
        return pdf.drop(columns="shard")

    placed = cuts.withColumn("shard", shard).groupBy("shard").applyInPandas(place, kept + ", sequence_id long, offset long")
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))
