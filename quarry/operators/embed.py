"""Embedding of chunks without a trained model: words hashed into signed buckets, length 1."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import core as C

#: Texts to vectors: any function of a list of texts, for instance a trained model's, called with up to BATCH texts.
Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 32


def hashed(rows: DataFrame, dimensions: int = 384, text: str = "content", model: str = "hashed-words") -> DataFrame:
    """``rows`` with ``vector`` array<float>, ``dimensions``, ``model_name``. Null or wordless text: all zeros."""
    words = F.coalesce(C.search_tokens(F.col(text)), F.array().cast("array<string>"))
    sign = lambda w: F.when(F.crc32(w.cast("binary")) % 2 == 0, 1).otherwise(-1)
    signed = F.transform(words, lambda w: ((F.pmod(F.xxhash64(w), F.lit(dimensions)) + 1) * sign(w)).cast("int"))

    @F.pandas_udf("array<float>")
    def summed(places: pd.Series) -> pd.Series:
        def one(p):
            v = np.bincount(np.abs(p) - 1, weights=np.sign(p), minlength=dimensions) if len(p) else np.zeros(dimensions)
            return (v / (np.sqrt((v * v).sum()) or 1.0)).astype(np.float32)

        return places.map(one)

    return rows.withColumn("vector", summed(signed)).withColumn("dimensions", F.lit(dimensions)).withColumn("model_name", F.lit(model))


def embedded(rows: DataFrame, embedder: Embedder, model: str, text: str = "content", instruction: str = "") -> DataFrame:
    """``rows`` with the vectors of an embedder, ``BATCH`` texts a call; ``instruction`` goes before each (for queries).

    A call that fails is halved until single texts; one that fails alone gets a null vector.
    """

    def some(texts: list[str]) -> list:
        try:
            return list(embedder(texts))
        except Exception:  # noqa: BLE001  any failure of a model
            if len(texts) == 1:
                return [None]
            half = len(texts) // 2
            return some(texts[:half]) + some(texts[half:])

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        own = [instruction + (t or "") for t in texts]
        return pd.Series([v for at in range(0, len(own), BATCH) for v in some(own[at : at + BATCH])], dtype=object)

    return rows.withColumn("vector", run(F.col(text))).withColumn("dimensions", F.size("vector")).withColumn("model_name", F.lit(model))
