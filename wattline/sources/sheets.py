"""Wide raw sheets to long monthly tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattline import names as N
from wattline.functions import columns as C


def month_labels(first_year: int, last_year: int) -> list[str]:
    return [f"{m:02d}.{y:04d}" for y in range(first_year, last_year + 1) for m in N.MONTHS]


def pivot_months(df: DataFrame, keys, measure: str, labels, prefix: str = "") -> DataFrame:
    """Long to wide with a known label list, so no extra pass collects the labels."""
    return (df.withColumn("label", C.month_label()).groupBy(*keys).pivot("label", list(labels))
            .agg(F.sum(measure)).select(*keys, *[F.col(f"`{x}`").alias(f"{prefix}{x}") for x in labels]))


def melt(df: DataFrame, keys, value_cols, key_name: str = "key", value_name: str = "value") -> DataFrame:
    return df.unpivot([F.col(k) for k in keys], [F.col(f"`{c}`") for c in value_cols], key_name, value_name)


def pivot_first(df: DataFrame, keys, names, name_col: str, value_col: str) -> DataFrame:
    """Long to wide keeping one value per cell; ``min`` makes the choice deterministic."""
    return df.groupBy(*keys).pivot(name_col, list(names)).agg(F.min(value_col))


def split_metric_key(df: DataFrame, key: str = "key") -> DataFrame:
    metric, month, year = C.metric_key_parts(F.col(key))
    return df.select(*[c for c in df.columns if c != key], metric.alias("metric"), month.alias(N.MOIS), year.alias(N.ANNEE))


def map_values(df: DataFrame, column: str, mapping: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Translate a column through a mapping table; an unknown key fails the job."""
    m = mapping.select(F.col(key).alias(column), F.col(value).alias("_mapped"))
    joined = df.join(m, column, "left")
    checked = F.when(F.col(column).isNull() | F.col("_mapped").isNotNull(), F.col("_mapped")).otherwise(
        F.raise_error(F.concat(F.lit(f"unmapped {column}: "), F.col(column).cast("string"))).cast("string"))
    return joined.withColumn(out, checked).drop("_mapped")


def sheet_to_monthly(sheet: DataFrame, label_col: str, value_cols, activities: DataFrame, cities: DataFrame,
                     subtotal_prefix: str = "Somme") -> DataFrame:
    """One raw sheet to (region, activite, annee, mois, metrics).

    ``label_col`` holds ``<activity> : <city>``; ``value_cols`` are ``metric__MM.YYYY`` text columns.
    Subtotal rows go, labels are mapped, duplicates are summed before the melt.
    """
    rows = sheet.filter(F.col(label_col).isNotNull() & ~F.col(label_col).startswith(subtotal_prefix)).select(
        C.clean_header(F.split_part(label_col, F.lit(":"), F.lit(1))).alias("raw_activity"),
        C.last_token_after_colon(F.col(label_col)).alias("city"),
        *[C.to_number(F.col(f"`{c}`")).alias(c) for c in value_cols])
    rows = map_values(rows, "raw_activity", activities, "raw_activity", "label", N.ACTIVITE)
    rows = map_values(rows, "city", cities, "city", "label", N.REGION)
    summed = rows.groupBy(N.REGION, N.ACTIVITE).agg(*[F.sum(f"`{c}`").alias(c) for c in value_cols])
    long = split_metric_key(melt(summed, [N.REGION, N.ACTIVITE], value_cols))
    metrics = sorted({c.split("__")[0].strip() for c in value_cols})
    return pivot_first(long, [N.REGION, N.ACTIVITE, N.ANNEE, N.MOIS], metrics, "metric", "value")


def sales_and_use(sales: DataFrame, use: DataFrame, keys, labels) -> DataFrame:
    """Two wide sheets (sales, use) to one long table: use joins sales on key and month.

    The sheets meet as they are, by key; months pair up inside a joined row, so no long table is shuffled.
    """
    when = {x: tuple(int(v) for v in x.split(".")[:2]) for x in labels}
    right = use.select(*keys, *[F.col(f"`{x}`").alias(f"_u{i}") for i, x in enumerate(labels)], F.lit(True).alias("_use"))
    cells = [F.struct(F.lit(when[x][0]).cast("bigint").alias(N.MOIS), F.lit(when[x][1]).cast("bigint").alias(N.ANNEE), C.to_number(F.col(f"`{x}`")).alias("ventes"),
                      F.when(F.col("_use"), C.to_number(F.col(f"_u{i}"))).alias("consommation"))
             for x in labels for i, other in enumerate(labels) if when[x] == when[other]]
    return sales.join(right, list(keys), "left").select(*keys, F.explode(F.array(*cells)).alias("_cell")).select(*keys, "_cell.*")


GROUP_BLOCKS = 10_000


def forward_fill(df: DataFrame, order_col: str, value_cols, block_rows: int = 1_000_000) -> DataFrame:
    """Carry the last non-null value down a sheet ordered by ``order_col``.

    The sheet is cut into blocks of consecutive row numbers, and those into groups. The last value of each block and
    group is found by an aggregate, carried over the blocks of a group and over the groups by windows, and joined back:
    a window holds a block, a group of blocks, or one row for each ``block_rows * GROUP_BLOCKS`` rows of the sheet.
    """
    from pyspark.sql import Window as W

    blocked = df.withColumn("_block", F.floor(F.col(order_col) / block_rows))
    last = blocked.groupBy("_block").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order_col))).alias(f"_last_{c}") for c in value_cols])
    last = last.withColumn("_group", F.floor(F.col("_block") / GROUP_BLOCKS))
    ends = last.groupBy("_group").agg(*[F.max_by(f"_last_{c}", F.when(F.col(f"_last_{c}").isNotNull(), F.col("_block"))).alias(f"_end_{c}") for c in value_cols])
    groups = W.orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("_group", *[F.last(f"_end_{c}", ignorenulls=True).over(groups).alias(f"_from_{c}") for c in value_cols])
    blocks = W.partitionBy("_group").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carry = last.join(ends, "_group").select(
        "_block", *[F.coalesce(F.last(f"_last_{c}", ignorenulls=True).over(blocks), F.col(f"_from_{c}")).alias(f"_carry_{c}") for c in value_cols])
    inside = W.partitionBy("_block").orderBy(order_col).rowsBetween(W.unboundedPreceding, 0)
    filled = blocked.join(carry, "_block", "left")
    for c in value_cols:
        filled = filled.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carry_{c}")))
    return filled.select(*df.columns)
