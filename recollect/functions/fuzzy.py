"""Sequence similarity, which has no built-in form, in Arrow batches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two strings. It is not symmetric: give the earlier one first."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def most_ratio(a: Column, b: Column) -> Column:
    """At least ``ratio`` of the two, without Python: from lengths and edit distance.

    Matching blocks are a common subsequence. What it leaves of both strings can be deleted and inserted, so that
    twice its length is at most the sum of lengths less the edit distance. Two empty strings are alike.
    """
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.floor((both - F.levenshtein(a, b)) / 2) / both)


def most_shared(a: Column, b: str) -> Column:
    """At least ``ratio`` of a column and a text, cheaper and looser: from the characters both hold, however placed."""
    each = [F.struct(F.lit(c).alias("c"), F.lit(b.count(c)).alias("n")) for c in sorted(set(b))]
    both = F.length(a) + len(b)
    if not each:
        return F.when(both == 0, 1.0).otherwise(0.0)
    held = lambda c: F.length(a) - F.length(F.replace(a, c, F.lit("")))
    shared = F.aggregate(F.array(*each), F.lit(0), lambda n, x: n + F.least(x["n"], held(x["c"])))
    return 2.0 * shared / both
