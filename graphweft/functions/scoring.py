"""Scoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the hybrid score and the constants of BM25 (fixed values).
KEYWORD, VECTOR, EXACT, PUBLIC, CALLABLE = 0.65, 0.35, 0.2, 0.05, 0.03
K1, B = 1.5, 0.75


def hybrid(keyword: Column, vector: Column, exact: Column, public: Column, kind: Column) -> Column:
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    total = keyword * KEYWORD + vector * VECTOR + flag(exact, EXACT) + flag(F.coalesce(public, F.lit(False)), PUBLIC) + flag(kind.isin("Function", "Class"), CALLABLE)
    # plain arithmetic: decimal and binary rounding disagree on sums that end in a half
    return F.floor(total * 1e6 + 0.5) / 1e6


def bm25_term(tf: Column, df: Column, n: Column, length: Column, average: Column, times: int) -> Column:
    """What one query term that occurs ``times`` times in the query adds; repeated terms also count in ``df``."""
    d = df * F.lit(times)
    idf = F.log(F.lit(1.0) + (n - d + 0.5) / (d + 0.5))
    share = F.when(average > 0, F.greatest(length, F.lit(1)) / average).otherwise(F.lit(1.0))
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * share))
    return F.when(tf > 0, F.lit(float(times)) * idf * weight).otherwise(F.lit(0.0))
