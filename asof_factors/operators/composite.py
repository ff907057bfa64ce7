"""Walk-forward composite: a sparse regression refitted every twelfth date.

Spark aggregates the moments (Gram sums) of each refit and fold; the
three-feature solve then runs on a row of at most ninety numbers for each refit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import exact_ranks
from ..schema import FEATURES, FORWARD_MONTHS, LASSO_ALPHAS, LASSO_CV_SPLITS, MIN_TRAIN_MONTHS

LABEL = "fwd_ret_demeaned"


def labelled(panel: DataFrame) -> DataFrame:
    ok = F.col(LABEL).isNotNull()
    for f in FEATURES:
        ok = ok & F.col(f).isNotNull()
    return panel.filter(ok)


def refit_calendar(panel: DataFrame, every: int = 12, lag_months: int = FORWARD_MONTHS + 1) -> DataFrame:
    """refit_date (every twelfth date) and cutoff, the last date whose label
    is known by then."""
    dates = panel.select("as_of_date").distinct()
    numbered = dates.withColumn("i", F.row_number().over(Window.orderBy("as_of_date")) - 1)  # a row for each date
    return numbered.filter(F.col("i") % every == 0).select(F.col("as_of_date").alias("refit_date"), F.add_months("as_of_date", -lag_months).alias("cutoff"))


def training_rows(panel: DataFrame, refits: DataFrame, splits: int = LASSO_CV_SPLITS, least_months: int = MIN_TRAIN_MONTHS) -> DataFrame:
    """refit_date, segment (0 to ``splits``) and row of every training row.
    Rows are ordered by date, then ticker; a row's place in the whole table is
    its date's offset plus its rank in the date, and is the same for every
    refit; ranks are exact without a task for each date."""
    rows = labelled(panel).select("as_of_date", "ticker", *FEATURES, LABEL)
    counts = rows.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("c"))
    until = F.sum("c").over(Window.orderBy("as_of_date"))  # a row for each date
    offsets = counts.withColumn("before", until - F.col("c"))
    sized = refits.join(offsets, offsets.as_of_date <= refits.cutoff).groupBy("refit_date", "cutoff").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("months"))
    sized = sized.filter(F.col("months") >= least_months)
    ranked = exact_ranks(rows, ["as_of_date"], ["ticker"]).withColumn("rank", F.col("rank") - 1).drop("group_size")
    placed = ranked.join(F.broadcast(offsets.select("as_of_date", "before")), "as_of_date").withColumn("place", F.col("before") + F.col("rank"))
    each = placed.join(F.broadcast(sized), F.col("as_of_date") <= F.col("cutoff"))  # a row for each refit
    test = F.floor(F.col("n") / (splits + 1))
    segment = F.greatest(F.lit(0), F.floor((F.col("place") - (F.col("n") - splits * test)) / test) + 1).cast("int")
    return each.withColumn("segment", segment)


def training_moments(panel: DataFrame, refits: DataFrame, splits: int = LASSO_CV_SPLITS, least_months: int = MIN_TRAIN_MONTHS) -> DataFrame:
    """Sums of products of features and label by refit and segment."""
    rows = training_rows(panel, refits, splits, least_months)
    names = [*FEATURES, LABEL]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(names)]
    cross = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}{j}") for i in range(len(names)) for j in range(i, len(names))]
    return rows.groupBy("refit_date", "segment").agg(F.count(F.lit(1)).alias("n"), *sums, *cross)


def lasso(gram: np.ndarray, moment: np.ndarray, alpha: float, sweeps: int = 50_000, tolerance: float = 1e-12) -> np.ndarray:
    """Minimiser of w'Gw/2 - m'w + alpha |w|_1 by coordinate descent."""
    w = np.zeros(len(moment))
    for _ in range(sweeps):
        moved = 0.0
        for k in range(len(w)):
            if gram[k, k] <= 0:
                continue
            rest = moment[k] - gram[k] @ w + gram[k, k] * w[k]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / gram[k, k]
            moved, w[k] = max(moved, abs(new - w[k])), new
        if moved < tolerance:
            break
    return w


def _centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Gram, moment, feature means and label mean of summed moments
    (n, sums, upper triangle of products)."""
    n, p = m[0], len(FEATURES)
    mean = m[1 : p + 2] / n
    full = np.zeros((p + 1, p + 1))
    full[np.triu_indices(p + 1)] = m[p + 2 :]
    full = full + full.T - np.diag(np.diag(full))
    cov = full / n - np.outer(mean, mean)
    return cov[:p, :p], cov[:p, p], mean[:p], mean[p]


def _mse(m: np.ndarray, w: np.ndarray, b: float) -> float:
    p = len(FEATURES)
    full = np.zeros((p + 1, p + 1))
    full[np.triu_indices(p + 1)] = m[p + 2 :]
    full = full + full.T - np.diag(np.diag(full))
    sx, sy, n = m[1 : p + 1], m[p + 1], m[0]
    return (full[p, p] - 2 * w @ full[:p, p] + w @ full[:p, :p] @ w - 2 * b * sy + 2 * b * w @ sx + n * b * b) / n


def solve(segments: np.ndarray, alphas: tuple[float, ...] = LASSO_ALPHAS) -> tuple[float, np.ndarray, float]:
    """Alpha of the least mean test error over expanding folds (the largest of
    equals), coefficients and intercept fitted on all segments."""
    order = sorted(alphas, reverse=True)
    errors = np.zeros(len(order))
    for k in range(1, len(segments)):
        gram, moment, mx, my = _centred(segments[:k].sum(axis=0))
        for i, a in enumerate(order):
            w = lasso(gram, moment, a)
            errors[i] += _mse(segments[k], w, my - mx @ w)
    alpha = order[int(np.argmin(errors))]
    gram, moment, mx, my = _centred(segments.sum(axis=0))
    w = lasso(gram, moment, alpha)
    return alpha, w, my - mx @ w


def fit(moments: DataFrame) -> DataFrame:
    """refit_date, alpha, coefficients and intercept of each refit."""
    names = [c for c in moments.columns if c not in ("refit_date", "segment")]
    schema = "refit_date date, alpha double, intercept double, " + ", ".join(f"{f} double" for f in FEATURES)

    def work(g: pd.DataFrame) -> pd.DataFrame:
        alpha, w, b = solve(g.sort_values("segment")[names].to_numpy(float))
        return pd.DataFrame([{"refit_date": g["refit_date"].iloc[0], "alpha": alpha, "intercept": b, **dict(zip(FEATURES, w))}])

    return moments.groupBy("refit_date").applyInPandas(work, schema)


def blend(panel: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``composite_score`` by the last refit on or before each date; before the
    first, and where all coefficients are zero, the mean of the features.
    A missing feature leaves the score missing."""
    c = coefficients.select("refit_date", "intercept", *[F.col(f).alias(f"w_{f}") for f in FEATURES])
    c = c.withColumn("until", F.lead("refit_date").over(Window.orderBy("refit_date")))  # a row for each refit
    on = (F.col("refit_date") <= F.col("as_of_date")) & (F.col("until").isNull() | (F.col("as_of_date") < F.col("until")))
    joined = panel.join(F.broadcast(c), on, "left")
    used = sum((F.abs(f"w_{f}") for f in FEATURES), F.lit(0.0)) > 0
    fitted = sum((F.col(f"w_{f}") * F.col(f) for f in FEATURES), F.col("intercept"))
    plain = sum((F.col(f) for f in FEATURES), F.lit(0.0)) / len(FEATURES)
    return joined.withColumn("composite_score", F.when(used, fitted).otherwise(plain)).select(*panel.columns, "composite_score")


def walk_forward(panel: DataFrame, every: int = 12, least_months: int = MIN_TRAIN_MONTHS) -> tuple[DataFrame, DataFrame]:
    """The panel with composite scores, and the coefficient history."""
    coefficients = fit(training_moments(panel, refit_calendar(panel, every), least_months=least_months))
    return blend(panel, coefficients), coefficients
