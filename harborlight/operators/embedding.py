"""Encoding distinct texts to unit vectors, resumably, and the map from records to vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.functions import text as T
from harborlight.operators import ranges


def distinct_texts(texts: DataFrame) -> DataFrame:
    """texts (h, text) -> (row_idx, h, text): each hash once, numbered from 0 in order of the hash, without a task that sees them all."""
    each = texts.where("h is not null").groupBy("h").agg(F.min("text").alias("text"))
    return ranges.ranked(each, [], ["h"], "__r").select((F.col("__r") - 1).alias("row_idx"), "h", "text")


class HashingEncoder:
    """Tokens counted by a hash of each into dim signed places: an encoder without weights, the same on every machine."""

    def __init__(self, dim: int = 64):
        self.dim, self.name, self._seen = dim, f"hashing-{dim}", {}

    def __getstate__(self):
        return {"dim": self.dim, "name": self.name, "_seen": {}}

    def place(self, token: str) -> tuple[int, float]:
        at = self._seen.get(token)
        if at is None:
            h = int(hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()[:8], 16)
            at = self._seen[token] = (h % self.dim, 1.0 if (h // self.dim) % 2 == 0 else -1.0)
        return at

    def encode(self, windows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(windows), self.dim))
        for i, tokens in enumerate(windows):
            for t in tokens:
                at, sign = self.place(t)
                out[i, at] += sign
        return out


def encode(texts: DataFrame, key: str, text: str, encoder: HashingEncoder | None = None) -> DataFrame:
    """(key, v): each text's windows encoded, averaged, then scaled to length 1. A text without tokens has a zero vector; null texts are left out.

    Any object with `encode(list of token lists) -> matrix` and picklable serves as encoder; Arrow batches of windows are handed to it.
    """
    model = encoder or HashingEncoder()
    tokens = F.transform(T.windows(F.col(text)), lambda w: T.tokens(w))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("__k"), tokens.alias("w"))
    kind = rows.schema["__k"].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            windows = [list(w) for each in pdf["w"] for w in each]
            owner = np.repeat(np.arange(len(pdf)), [len(each) for each in pdf["w"]])
            v = model.encode(windows)
            pooled = np.zeros((len(pdf), v.shape[1] if len(v) else 1))
            np.add.at(pooled, owner, v)
            pooled /= np.maximum(np.bincount(owner, minlength=len(pdf)), 1)[:, None]
            pooled /= np.maximum(np.linalg.norm(pooled, axis=1), 1e-300)[:, None]
            yield pd.DataFrame({"__k": pdf["__k"], "v": list(pooled)})

    return rows.mapInPandas(run, f"__k {kind}, v array<double>").withColumnRenamed("__k", key)


def pending(texts: DataFrame, done: DataFrame) -> DataFrame:
    """Of texts (h, ...) those whose hash isn't encoded yet: what a run that was stopped has left to do."""
    return texts.join(done.select("h").distinct(), "h", "left_anti")


def embedding_map(records: DataFrame, rows: DataFrame, model: str, dim: int) -> DataFrame:
    """records (id, h) and rows (row_idx, h) -> (id, row_idx, model, dim)."""
    return records.join(rows.select("h", "row_idx"), "h").select("id", "row_idx", F.lit(model).alias("model"), F.lit(dim).alias("dim"))


def coverage(records: DataFrame, mapped: DataFrame) -> DataFrame:
    """One row (n_records, n_mapped, n_rows, contiguous): are all records mapped, and are the row numbers 0 to n - 1 without gap."""
    m = mapped.agg(F.count_distinct("id").alias("n_mapped"), F.count_distinct("row_idx").alias("n_rows"), F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi"))
    n = records.agg(F.count_distinct("id").alias("n_records"))
    one = m.unionByName(n, True).agg(*(F.max(c).alias(c) for c in ("n_records", "n_mapped", "n_rows", "lo", "hi")))
    return one.select("n_records", "n_mapped", "n_rows", F.coalesce((F.col("lo") == 0) & (F.col("hi") == F.col("n_rows") - 1), F.col("n_rows") == 0).alias("contiguous"))
