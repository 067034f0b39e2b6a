"""Stemming of dictionary words; see ``functions.stem``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagevault.functions.stem import stem


@F.arrow_udf(T.StringType())
def stem_udf(words: pa.Array, languages: pa.Array) -> pa.Array:
    return pa.array([stem(w, x) for w, x in zip(words.to_pylist(), languages.to_pylist(), strict=True)], type=pa.string())
