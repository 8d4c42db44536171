"""Row-wise column rules: safe casts, text parsing, sentinels, flags, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.spec import FeatureSpec


def to_number(col: Column) -> Column:
    """Text to double; text that is not a number, and NaN, become NULL."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value)


def leading_digits(col: Column) -> Column:
    """First run of digits in a text as a double, NULL when there is none."""
    return F.nullif(F.regexp_extract(col.cast("string"), r"(\d+)", 1), F.lit("")).try_cast("double")


def ordinal_years(col: Column) -> Column:
    """'< 1 year' is 0, '3 years' is 3, '10+ years' is 10, anything without digits is NULL."""
    return leading_digits(F.regexp_replace(col, "< 1", "0"))


def month_date(col: Column, fmt: str | None = "dd-MMM-yyyy") -> Column:
    """Month-year text ('Mar-2016') as the first day of that month; bad text is NULL.

    With ``fmt=None`` the column already is a date or timestamp.
    """
    if fmt is None:
        return col.cast("date")
    return F.try_to_date(F.concat(F.lit("01-"), col), fmt)


def months_between_dates(start: Column, end: Column) -> Column:
    """Whole calendar months from start to end, ignoring the day."""
    years = F.year(end) - F.year(start)
    return (years * 12 + (F.month(end) - F.month(start))).cast("double")


def outside_to_null(col: Column, low: float, high: float) -> Column:
    return F.when(col.between(low, high), col)


def merge_values(col: Column, values: list[str], target: str) -> Column:
    return F.when(col.isin(values), F.lit(target)).otherwise(col)


def outcome(col: Column, outcomes: dict[str, int]) -> Column:
    pairs = [F.lit(x) for kv in outcomes.items() for x in kv]
    return F.create_map(*pairs)[col].cast("int")


def band(col: Column, limits: list[float], labels: list[str]) -> Column:
    """Right-closed bands: values up to limits[0] get labels[0], beyond the last get labels[-1]."""
    expr = F.when(col.isNull(), F.lit(None).cast("string"))
    for limit, label in zip(limits, labels):
        expr = expr.when(col <= limit, label)
    return expr.otherwise(labels[-1])


def effect_band(delta: Column) -> Column:
    """Size of a difference between two AUCs."""
    size = F.abs(delta)
    return (F.when(size.isNull(), F.lit(None).cast("string")).when(size < 0.01, "trivial")
            .when(size < 0.03, "small").when(size < 0.05, "moderate").otherwise("large"))


def percent(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.lit(100.0) * part / whole, digits)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing everywhere in this library, so it is replaced once, at ingest."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else df


def base_table(raw: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Typed, filtered base table: id, target, issue_year, numeric block, categoricals.

    One projection over one filter, so on a columnar source only the named columns are read and
    the status filter is pushed to the scan.
    """
    closed = raw.filter(F.col(spec.status).isin(list(spec.outcomes)))

    def date(name: str) -> Column:
        return month_date(F.col(name), spec.month_format)

    values: dict[str, Column] = {}
    for name in spec.numeric:
        if name in spec.digits:
            values[name] = leading_digits(F.col(name))
        elif name in spec.ordinal:
            values[name] = ordinal_years(F.col(name))
        elif name in spec.month_gaps:
            start, end = spec.month_gaps[name]
            values[name] = months_between_dates(date(start), date(end))
        else:
            values[name] = to_number(F.col(name))
        if name in spec.ranges:
            values[name] = outside_to_null(values[name], *spec.ranges[name])

    def source(name: str) -> Column:
        return values[name] if name in values else to_number(F.col(name))

    flags = {flag: source(c).isNotNull().cast("double") for flag, c in spec.present_flags.items()}
    flags |= {flag: source(c).isNull().cast("double") for flag, c in spec.missing_flags.items()}
    for name in spec.log1p:
        values[name] = F.log1p(values[name])
    texts = {c: F.col(c) for c in spec.categorical}
    for name, rule in spec.merges.items():
        texts[name] = merge_values(F.col(name), rule["from"], rule["to"])
    issue = [F.year(date(spec.issue)).alias("issue_year")] if spec.issue else []
    return closed.select(
        F.col(spec.id).try_cast("long").alias("id"),
        outcome(F.col(spec.status), spec.outcomes).alias("target"),
        *issue,
        *[c.alias(n) for n, c in (values | flags | texts).items()],
    )
