"""Little's test of data missing completely at random."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.tails import chi2_sf


def missing_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per missing-data pattern: rows, sums and cross products of the observed values.

    Values are centred at their column means first, so that large levels do not cancel in the
    cross products. The pattern text has a 1 for every observed column.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    centre = means.select(F.struct(*columns).alias("m")).scalar()
    x = df.select(
        F.concat(*[F.col(c).isNotNull().cast("int").cast("string") for c in columns])
        .alias("pattern"), *[(F.col(c) - centre[c]).alias(c) for c in columns])
    products = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return x.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in columns],
        *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}__{b}") for a, b in products])


def little_mcar(df: DataFrame, columns: list[str], max_iter: int = 200,
                tol: float = 1e-6) -> DataFrame:
    """Statistic, degrees of freedom, p and number of patterns, as one row.

    p is NULL when the EM steps have not converged; a column without any value is an error.

    Under normality the EM steps need the rows only through the sums of each pattern (the
    conditional mean is linear in the observed part). Those come from one distributed aggregate;
    the iterations run on matrices of size columns x columns, one per pattern.
    """
    p = len(columns)
    groups = []
    # one row per pattern
    for row in missing_patterns(df, columns).collect():
        seen = np.array([c == "1" for c in row["pattern"]])
        total = np.array([row[f"s_{c}"] or 0.0 for c in columns])
        cross = np.zeros((p, p))
        for i, a in enumerate(columns):
            for j in range(i, p):
                cross[i, j] = cross[j, i] = row[f"s_{a}__{columns[j]}"] or 0.0
        groups.append((row["n"], seen, total, cross))
    n = sum(g[0] for g in groups)
    empty = [c for k, c in enumerate(columns) if not any(g[1][k] for g in groups)]
    if empty:
        raise ValueError(f"columns without any value: {', '.join(empty)}")
    count = sum(g[0] * g[1] for g in groups)
    mean = sum(g[2] for g in groups) / count
    cov = np.diag(sum(np.diag(g[3]) for g in groups) / count - mean ** 2)
    done, converged = 0, False
    for done in range(1, max_iter + 1):
        first, second = np.zeros(p), np.zeros((p, p))
        for size, seen, total, cross in groups:
            # completed row = fill @ observed part + shift
            fill, shift = np.eye(p)[:, seen], np.zeros(p)
            spread = np.zeros((p, p))
            gone = ~seen
            if gone.any():
                slope = cov[np.ix_(gone, seen)] @ np.linalg.pinv(cov[np.ix_(seen, seen)])
                fill[gone] = slope
                shift[gone] = mean[gone] - slope @ mean[seen]
                spread[np.ix_(gone, gone)] = (cov[np.ix_(gone, gone)]
                                              - slope @ cov[np.ix_(seen, gone)])
            moved = fill @ total[seen]
            first += moved + size * shift
            second += (fill @ cross[np.ix_(seen, seen)] @ fill.T + np.outer(moved, shift)
                       + np.outer(shift, moved) + size * (np.outer(shift, shift) + spread))
        new_mean = first / n
        new_cov = second / n - np.outer(new_mean, new_mean)
        change = max(np.abs(new_mean - mean).max(), np.abs(new_cov - cov).max())
        mean, cov = new_mean, new_cov
        converged = bool(change < tol * (1 + np.abs(cov).max()))
        if converged:
            break
    statistic, dof = 0.0, -p
    for size, seen, total, _ in groups:
        if seen.any():
            gap = total[seen] / size - mean[seen]
            statistic += size * gap @ np.linalg.pinv(cov[np.ix_(seen, seen)]) @ gap
            dof += int(seen.sum())
    rows = [(float(statistic), dof, len(groups), done, converged)]
    result = df.sparkSession.createDataFrame(
        rows, "statistic double, dof int, patterns int, iterations int, converged boolean")
    p = chi2_sf("statistic", F.col("dof").cast("double"))
    return result.withColumn("p", F.when(F.col("converged"), p))
