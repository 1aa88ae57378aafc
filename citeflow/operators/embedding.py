"""Texts to vectors by a model the user brings, in Arrow batches on the executors."""


from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def embed(df: DataFrame, text_col: str, load: Callable[[], Callable], dim: int, out: str = "vec", batch: int = 256) -> DataFrame:
    """Add ``out``, the vector of each text.

    ``load`` runs once per task and returns the encoder: a function from a list of texts to an array (rows, ``dim``).
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import pandas as pd

        encoder = load()
        for texts in batches:
            parts = [encoder(list(texts[i : i + batch])) for i in range(0, len(texts), batch)]
            rows = np.concatenate(parts).astype("float32") if parts else np.zeros((0, dim), "float32")
            yield pd.Series(list(rows))

    # a deterministic function would be run a second time for filters the optimizer derives from its result
    encode = encode.asNondeterministic()
    return df.withColumn(out, encode(F.coalesce(F.col(text_col), F.lit(""))))


def hashing_encoder(dim: int) -> Callable[[], Callable]:
    """Stand-in model for tests: word counts by hashed word, scaled to unit length."""

    def load():
        import hashlib
        from functools import lru_cache

        import numpy as np

        @lru_cache(maxsize=100_000)
        def place(word):
            return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim

        def encoder(texts):
            out = np.zeros((len(texts), dim))
            for i, text in enumerate(texts):
                found = [place(w) for w in text.split()]
                out[i] = np.bincount(found, minlength=dim) if found else 0.0
            return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)

        return encoder

    return load
