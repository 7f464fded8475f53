"""Scans, unions and sinks of the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline import names as N
from wattline.functions.columns import require_columns
from wattline.session import materialize

SLICES = 16  # files of a rewritten year


def regional_scan(grd: DataFrame, variable: str = N.CONSO, classes=(N.CLASS_MT, N.CLASS_BT, N.CLASS_TOTAL)) -> DataFrame:
    """Rows of the regional utilities, all regions in one scan."""
    column = N.VARIABLES[variable]["column"]
    return grd.filter((F.col(N.GRD) == N.SRM) & F.col(N.CLASSE).isin(*classes)).select(
        N.REGION, N.CLASSE, N.ANNEE, N.MOIS, N.ACTIVITE, F.col(column).alias(variable))


def distributor_scan(grd: DataFrame, variable: str = N.CONSO) -> DataFrame:
    """Monthly totals per distributor; refused for variables distributors do not report."""
    if not N.VARIABLES[variable]["distributors"]:
        raise ValueError(f"{variable} is not reported by distributors")
    column = N.VARIABLES[variable]["column"]
    return grd.filter(F.col(N.GRD) != N.SRM).groupBy(N.REGION, N.ANNEE, N.MOIS, F.col(N.GRD).alias("distributeur")).agg(
        F.sum(column).alias(variable))


def exogenous_regional(exogenous: DataFrame) -> DataFrame:
    return exogenous.groupBy(N.REGION, N.ANNEE).agg(*[F.avg(c).alias(c) for c in N.GDP])


def exogenous_national(exogenous: DataFrame) -> DataFrame:
    return exogenous.groupBy(N.ANNEE).agg(*[F.sum(c).alias(c) for c in N.GDP])


def contract_scan(contracts: DataFrame) -> DataFrame:
    return contracts.select(N.REGION, N.PARTENAIRE, N.CONTRAT, N.ANNEE, N.MOIS, N.ACTIVITE, N.CONSO, *N.BANDS,
                            N.TENSION, N.PF, N.PA, N.DATE_IN, N.DATE_OUT)


def weather_scan(weather: DataFrame) -> DataFrame:
    return weather.select(
        N.REGION, N.ANNEE, N.MOIS, F.col("apparent_temperature_min").alias("temp_min_latest"),
        F.col("precipitation_sum").alias("precipitation_sum_latest"),
        F.col("et0_fao_evapotranspiration_sum").alias("et0_latest"))


def load_regional(grd: DataFrame, variable: str = N.CONSO) -> DataFrame:
    """BT, MT and Total rows as one activity series: labels set apart, nulls to zero."""
    rows = regional_scan(grd, variable)
    activite = (
        F.when((F.col(N.CLASSE) == N.CLASS_MT) & (F.col(N.ACTIVITE) == N.ADMINISTRATIF), N.ADMINISTRATIF_MT)
        .when((F.col(N.CLASSE) == N.CLASS_TOTAL) & F.col(N.ACTIVITE).isNull(), N.TOTAL)
        .otherwise(F.col(N.ACTIVITE)))
    out = rows.select(N.REGION, N.ANNEE, N.MOIS, N.CLASSE, activite.alias(N.ACTIVITE),
                      F.coalesce(F.col(variable).cast("double"), F.lit(0.0)).alias(variable))
    return require_columns(out, [N.ANNEE, N.MOIS, N.ACTIVITE, variable], "regional table")


def valid_forecast_years(forecasts: DataFrame) -> DataFrame:
    """Earlier forecasts (entity, annee, values array): keep the years that hold 12 values."""
    return forecasts.filter(F.size("valeurs") == 12)


def aggregate_predictions(lookup: DataFrame, target: str, components) -> DataFrame:
    """Add ``target`` as the monthly sum of its components; nothing when it is already there."""
    have = lookup.filter(F.col("entity") == target).select(F.lit(target).alias("entity")).limit(1)
    combined = (
        lookup.filter(F.col("entity").isin(*components))
        .groupBy(N.ANNEE, N.MOIS).agg(F.sum("valeur").alias("valeur"))
        .select(F.lit(target).alias("entity"), N.ANNEE, N.MOIS, "valeur")
        .join(have, "entity", "left_anti"))
    return lookup.select("entity", N.ANNEE, N.MOIS, "valeur").unionByName(combined)


def union_eras(*frames: DataFrame) -> DataFrame:
    """Stack periods of one table; a column one era lacks becomes null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def rename_result(df: DataFrame, header: dict[str, str]) -> DataFrame:
    return require_columns(df, header, "result table").select(*[F.col(k).alias(v) for k, v in header.items()])


def write_csv(df: DataFrame, path: str) -> None:
    """Header row, UTF-8, one part file per partition."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read with an explicit schema, so no pass over the data infers types."""
    return spark.read.option("header", True).option("encoding", "UTF-8").schema(schema).csv(path)


def replace_table(df: DataFrame, table: str) -> None:
    """Replace a managed table."""
    df.write.mode("overwrite").format("parquet").saveAsTable(table)


def replace_parquet(df: DataFrame, path: str, partition_by=()) -> DataFrame:
    """Replace a Parquet folder and return it as a frame."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def append_into_new(history_path: str, new_rows: DataFrame, out_path: str, order_by) -> DataFrame:
    """History plus new rows, sorted, into a new folder (the input is never overwritten in place)."""
    spark = new_rows.sparkSession
    merged = spark.read.parquet(history_path).unionByName(new_rows, allowMissingColumns=True)
    return replace_parquet(merged.orderBy(*order_by), out_path)


def upsert_partitions(path: str, rows: DataFrame, keys, partition: str = N.ANNEE) -> DataFrame:
    """Rows replace those of equal keys in a Parquet folder partitioned by year and extend it elsewhere; returns the folder as a frame.

    ``keys`` hold the partition column. Only years that ``rows`` touch are read and rewritten, in one job that overwrites
    those partitions when it commits; a failed job leaves the folder as it was. The merged years are written to the shared folder first,
    so nothing is read from files being replaced. Columns the folder lacks are dropped, columns the rows lack are null.
    Null keys equal nothing: such rows are added. Repeated keys among ``rows`` are all written. No rows change nothing.
    """
    spark = rows.sparkSession
    stored = spark.read.parquet(path)
    rows = materialize(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored.schema]), "rows")
    years = F.broadcast(rows.select(partition).distinct())  # calendar years: a short list
    kept = stored.join(years, partition, "left_semi").join(rows.select(*keys), list(keys), "left_anti")
    merged = materialize(kept.unionByName(rows), "touched-years")
    merged.repartition(partition, F.pmod(F.xxhash64(*keys), F.lit(SLICES))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return spark.read.schema(stored.schema).parquet(path)


def combine_sheets(sheets: dict[str, DataFrame], label: str = "City") -> DataFrame:
    """Stack named sheets with their name as a column; rows without any value are dropped."""
    frames = [df.dropna("all").withColumn(label, F.lit(name)) for name, df in sheets.items()]
    return union_eras(*frames)


def gather_region_files(spark: SparkSession, root: str, schema, pattern: str) -> DataFrame:
    """Read every CSV under ``root`` whose name matches; the region is the pattern's first group."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -2)
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).schema(schema).csv(root)
    return rows.withColumn(N.REGION, F.regexp_extract(name, pattern, 1)).filter(F.col(N.REGION) != "")
