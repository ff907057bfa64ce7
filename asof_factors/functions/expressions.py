"""Scalar expressions on columns.  Missing is always NULL, never NaN."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EULER = 0.5772156649015329


def safe_div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def no_nan(c: Column) -> Column:
    return F.nullif(c, F.lit(float("nan")))


def positive_log(c: Column) -> Column:
    return F.ln(F.when(c > 0, c))


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def number_text(c: Column) -> Column:
    """'1,234' as a double; '-', blanks and other text are missing, never 0."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def share_class_ticker(c: Column) -> Column:
    """Upper case, dots and spaces as one dash: 'brk b' is 'BRK-B'."""
    return F.regexp_replace(F.upper(F.trim(c)), r"[.\s]+", "-")


def account_id(c: Column) -> Column:
    """Account ids without their taxonomy's prefix, in lower case."""
    return F.lower(F.regexp_replace(F.trim(c), "^(ifrs-full_|ifrs-smes_|ifrs_|dart_)", ""))


def same_label(text: Column, label: Column) -> Column:
    """Whether a label occurs in a text, whatever the accents and case."""
    plain = lambda c: F.collate(c, "UNICODE_CI_AI")
    return F.contains(plain(text), plain(label))


def common_share_label(c: Column) -> Column:
    """Label of common (voting) shares, white space aside."""
    bare = F.regexp_replace(c, r"\s+", "")
    return F.contains(bare, F.lit("보통주")) | F.contains(bare, F.lit("의결권")) & F.contains(bare, F.lit("있는"))


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def all_true(conditions: list[Column]) -> Column:
    """AND of conditions in which an unknown one fails."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(True))


def newey_west_lag(n: Column) -> Column:
    return F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))).cast("int")


def best_of_trials(trials: int) -> float:
    """Expected best of ``trials`` skill-less Sharpes, in their standard deviations."""
    if trials <= 1:
        return 0.0
    z = NormalDist().inv_cdf
    return (1 - EULER) * z(1 - 1 / trials) + EULER * z(1 - 1 / (trials * math.e))


def quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def sharpe_spread(sr: Column, skew: Column, kurt: Column) -> Column:
    """Variance of a Sharpe estimate times (T - 1)."""
    return 1 - skew * sr + (kurt - 1) / 4 * sr * sr


@F.pandas_udf(T.DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    """Standard normal distribution function; missing stays missing."""
    return x.map(lambda v: None if v is None or np.isnan(v) else 0.5 * math.erfc(-v / math.sqrt(2))).astype("float64")
