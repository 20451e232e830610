"""BM25 (Robertson and Zaragoza, 2009), k1 = 1.2, b = 0.75, in doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def idf(n_docs: int, df: int) -> float:
    return math.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, average: float, weight: float) -> Column:
    """weight is the idf; 0 where tf is 0. average: the mean length of the field."""
    tf = tf.cast("double")
    return F.lit(weight * (K1 + 1)) * tf / (tf + K1 * (F.lit(1 - B) + F.lit(B) * length.cast("double") / F.lit(average or 1.0)))
