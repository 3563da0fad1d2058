"""Putting documents into containers of a fixed number of tokens by the sum-of-squares rule.

Documents arrive in order; each goes to the open container, or a new one, that leaves the sum of squared counts of
equally filled open containers smallest (ties: the fullest). The state is one array of counts by fill level, so a placement costs
one pass over the capacity and no search over containers. A document longer than a container is cut into full
containers and a rest that is placed like any other.

Tokens are counted where the text is read; only (key, tokens) is shuffled, into shares of SHARE documents by hash, which are packed
independently. A share's open containers are its only waste: about one in a thousand containers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborlight.session import cut

CAPACITY, SHARE = 2048, 20_000
VOCABULARY = "byte_bpe_50k.tiktoken"
_encoders: dict[tuple[str, str], object] = {}


def tokenizer_path(name: str = VOCABULARY, folder: str = "/opt/tokenizers") -> str:
    return f"{folder}/{name}"


def encoder(path: str):
    """The tokenizer of a ranks file, once in a worker; special tokens are ordinary text."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # Fixed value: the pattern this vocabulary cuts text with.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


class SumOfSquares:
    """The packing of one share. place() returns (container, offset)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.containers = 0

    def place(self, size: int) -> tuple[int, int]:
        c = self.capacity
        if not 0 < size <= c:
            raise ValueError(f"size {size} is not within 1..{c}")
        before, after = self.counts[: c - size + 1], self.counts[size:]
        # 2 (n[after] - n[before]) is by how much the sum grows, up to a constant; full containers leave the sum
        gain = 2 * (after - before) + 2
        gain[-1] = 1 - 2 * before[-1]
        usable = before > 0
        usable[0] = True
        gain[0] = 0 if size == c else 2 * self.counts[size] + 1
        gain[~usable] = np.iinfo(np.int64).max
        level = len(gain) - 1 - int(np.argmin(gain[::-1]))
        if level == 0:
            box = self.containers
            self.containers += 1
        else:
            box = self.open[level].pop()
            self.counts[level] -= 1
        if level + size < c:
            self.open[level + size].append(box)
            self.counts[level + size] += 1
        return box, level


def _count(path: str):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in it:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "n_tokens": np.array(n, np.int64)})

    return run


def pack(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str | None = None, share: int = SHARE) -> DataFrame:
    """(key, piece, token_start, n_tokens, container_id, container_offset): where each piece of each document lies.

    A document of at most `capacity` tokens is one piece. Null and empty texts have no tokens and no piece. Null keys and
    repeated rows are packed like others. The same input gives the same packing.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    base = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    sizes = cut(base.mapInPandas(_count(path or tokenizer_path()), "k long, n_tokens long").where("n_tokens > 0"))
    shares = max(1, -(-sizes.count() // share))
    spread = sizes.withColumn("share", F.pmod(F.xxhash64("k", "n_tokens"), F.lit(shares)))
    # one share a task: the range partitioner would split by samples, so partitions come from the share itself
    keyed = spread.repartition(shares, "share").sortWithinPartitions("share", "k", "n_tokens")
    packed = keyed.mapInPandas(_pack_shares(capacity), "k long, piece int, token_start long, n_tokens long, container_id long, container_offset int")
    return packed.withColumnRenamed("k", key)


def _pack_shares(capacity: int):
    """Several shares may meet in a task; each is packed on its own."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, packing = None, None
        for pdf in it:
            rows = []
            for share, k, n in zip(pdf["share"], pdf["k"], pdf["n_tokens"]):
                if share != held:
                    held, packing = share, SumOfSquares(capacity)
                n = int(n)
                for piece, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    box, offset = packing.place(size)
                    rows.append((k, piece, at, size, (int(share) << 40) | box, offset))
            yield pd.DataFrame(rows, columns=["k", "piece", "token_start", "n_tokens", "container_id", "container_offset"])

    return run


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: (n_pieces, n_tokens, n_containers, fill), fill being tokens over capacity of all containers."""
    by = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    return by.agg(
        F.sum("pieces").alias("n_pieces"), F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_containers"), (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("fill")
    )


def verified(packed: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, in_order, fits, whole) for each packed key, computed from the packing alone.

    in_order: its pieces follow each other from token 0 without gap. fits: in every container it is in, pieces lie side by side from
    offset 0 on, to at most the capacity. whole: it is in one piece unless longer than a container. Repeated keys count as one document, not in order.
    """
    by = Window.partitionBy(key).orderBy("token_start", "piece")
    inside = Window.partitionBy("container_id").orderBy("container_offset", "n_tokens")
    gap = F.coalesce(F.lag(F.col("token_start") + F.col("n_tokens")).over(by), F.lit(0)) != F.col("token_start")
    off = F.coalesce(F.lag(F.col("container_offset") + F.col("n_tokens")).over(inside), F.lit(0)) != F.col("container_offset")
    over = (F.col("container_offset") + F.col("n_tokens")) > capacity
    rows = packed.withColumn("gap", gap).withColumn("bad", off | over)
    boxes = rows.groupBy("container_id").agg(F.max("bad").alias("bad_box"))
    g = rows.join(boxes, "container_id").groupBy(key).agg(F.max("gap").alias("g"), F.max("bad_box").alias("b"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    return g.select(key, (~F.col("g")).alias("in_order"), (~F.col("b")).alias("fits"), (F.col("n") == F.ceil(F.col("t") / capacity)).alias("whole"))
