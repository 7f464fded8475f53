"""Column expressions: keys, labels, cleaning, parsing and guarded arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wattline import names as N

# Fixed value: date patterns, tried in this order (single letters also take two digits).
DATE_PATTERNS = ("yyyy-M-d", "d.M.yyyy", "d/M/yyyy", "yyyy/M/d", "yyyy-M-d H:m:s", "d-M-yyyy", "M/d/yyyy",
                 "d MMM yyyy", "d MMMM yyyy")


def require_columns(df: DataFrame, cols, context: str) -> DataFrame:
    """Fail before planning when a column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"Missing columns in {context}: {missing}")
    return df


def month_key(annee=N.ANNEE, mois=N.MOIS) -> Column:
    """Sortable month number ``annee * 12 + mois``."""
    return F.col(annee) * 12 + F.col(mois)


def month_start(annee=N.ANNEE, mois=N.MOIS) -> Column:
    return F.make_date(F.col(annee).cast("int"), F.col(mois).cast("int"), F.lit(1))


def month_label(annee=N.ANNEE, mois=N.MOIS) -> Column:
    """``MM.YYYY``."""
    return F.format_string("%02d.%04d", F.col(annee) * 0 + F.col(mois), F.col(annee))


def label_month(label: Column) -> Column:
    return F.split_part(label, F.lit("."), F.lit(1)).cast("bigint")


def label_year(label: Column) -> Column:
    return F.split_part(label, F.lit("."), F.lit(2)).cast("bigint")


def pad_month_label(label: Column) -> Column:
    """``3.2018`` becomes ``03.2018``."""
    return F.concat_ws(".", F.lpad(F.split_part(label, F.lit("."), F.lit(1)), 2, "0"),
                       F.split_part(label, F.lit("."), F.lit(2)))


def metric_key_parts(key: Column) -> tuple[Column, Column, Column]:
    """``metric__MM.YYYY`` as (metric, month, year)."""
    pattern = r"^(.+?)__(\d{2})\.(\d{4})"
    return (F.trim(F.regexp_extract(key, pattern, 1)),
            F.regexp_extract(key, pattern, 2).cast("bigint"),
            F.regexp_extract(key, pattern, 3).cast("bigint"))


def last_token_after_colon(s: Column) -> Column:
    """Last word of the text behind the last colon."""
    tail = F.trim(F.element_at(F.split(s, ":"), -1))
    return F.element_at(F.split(tail, r"\s+"), -1)


def clean_header(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(s)), " ", "_")


def clean_name(s: Column) -> Column:
    """Replace path-unsafe characters by underscores."""
    return F.translate(s, ":/\\ ", "____")


def to_number(s: Column) -> Column:
    """Text to double; what does not parse counts as 0."""
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


def parse_date(s: Column) -> Column:
    """First matching date pattern, null when none fits."""
    text = F.trim(s)
    return F.to_date(F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS]))


def drop_non_positive(df: DataFrame, cols, strict: bool = False) -> DataFrame:
    """Drop rows where a listed, present column is negative (``strict``: not above zero)."""
    keep = [(F.col(c) > 0) if strict else (F.col(c) >= 0) for c in cols if c in df.columns]
    return df.filter(reduce(lambda a, b: a & b, keep)) if keep else df


def finite_or_null(x: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when((x != inf) & (x != -inf) & ~F.isnan(x), x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def percent_error(pred: Column, actual: Column) -> Column:
    """(pred - actual) / actual in percent; null for a zero actual."""
    return F.try_divide(pred - actual, actual) * 100


def entity_part(entity: Column, prefix: str) -> Column:
    """Id behind a fixed prefix such as ``Contrat_``; null when the prefix is absent."""
    got = F.regexp_extract(entity, f"^{prefix}_(.+)$", 1)
    return F.when(got != "", got)
