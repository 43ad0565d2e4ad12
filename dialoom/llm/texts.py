"""Documents as distinct texts: exact copies are joined before any other work."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.blocks import give_back

#: Bytes of text that are scored at a time.
SCORED_BYTES = 1 << 20


def text_key(text: Column) -> Column:
    """16 bytes of the SHA-256 of a text; null stays null."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, text, copies): every non-null text once; copies are counted before the shuffle."""
    return (
        docs.where(F.col(text_col).isNotNull())
        .select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
        .where(F.col("key").isNotNull())  # as joins on the key infer; so all uses have one plan and share its shuffle
        .groupBy("key")
        .agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    )


def score_column(score: Callable[[list[bytes]], np.ndarray], text: str = "text") -> Column:
    """A number for each text, a null one as the empty one; only texts go to the Python worker, so ids and other columns stay as they are."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out, held, size = [np.empty(0)], [], 0
        for t in texts:
            held.append(b"" if t is None else t.encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size >= SCORED_BYTES:
                out.append(score(held))
                held, size = [], 0
        if held:
            out.append(score(held))
        give_back()
        return pd.Series(np.concatenate(out))

    return scored(F.col(text))
