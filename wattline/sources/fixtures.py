"""The electricity tables, derived from the star-schema Parquet files.

Facts are pre-aggregated on their own key before any other shuffle, so that one order, customer
or supplier holding a large share of the rows is folded map-side and never lands in one task.
Dimension joins carry no broadcast hint: the planner broadcasts a side only when its size is
below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline import names as N
from wattline.session import materialize


def _year(c):
    return F.year(c).cast("bigint")


def _month(c):
    return F.month(c).cast("bigint")


class Tables:
    """Lazily planned views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def places(self) -> DataFrame:
        return self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            "n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias(N.REGION))

    @cached_property
    def customers(self) -> DataFrame:
        return self.raw("customer").join(self.places, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias(N.CONTRAT), F.col("c_mktsegment").alias(N.ACTIVITE), "nation", N.REGION)

    @cached_property
    def suppliers(self) -> DataFrame:
        return self.raw("supplier").join(self.places, F.col("s_nationkey") == F.col("n_nationkey")).select(
            "s_suppkey", N.REGION)

    @cached_property
    def cd(self) -> DataFrame:
        """Contract-month table."""
        price, flag, qty = F.col("l_extendedprice"), F.col("l_returnflag"), F.col("l_quantity")

        def band(code):
            return F.sum(F.when(flag == code, price).otherwise(F.lit(0.0)))

        per_order = self.raw("lineitem").groupBy("l_orderkey").agg(
            F.sum(price).alias(N.CONSO), band("A").alias(N.ZCONHC), band("N").alias(N.ZCONHL),
            band("R").alias(N.ZCONHP), F.sum(qty).alias(N.PF),
            F.sum(qty * (1 - F.col("l_discount"))).alias(N.PA))
        measures = [N.CONSO, *N.BANDS, N.PF, N.PA]
        orders = self.raw("orders").select(
            "o_orderkey", F.col("o_custkey").alias(N.CONTRAT),
            _year("o_orderdate").alias(N.ANNEE), _month("o_orderdate").alias(N.MOIS))
        per_contract = (
            per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(N.CONTRAT, N.ANNEE, N.MOIS).agg(*[F.sum(m).alias(m) for m in measures]))
        return per_contract.join(self.customers, N.CONTRAT).select(
            N.REGION, F.col("nation").alias(N.PARTENAIRE), N.CONTRAT, N.ACTIVITE, N.ANNEE, N.MOIS, *measures,
            F.when(F.col(N.CONTRAT) % 7 == 0, F.lit(None).cast("string"))
            .when(F.col(N.CONTRAT) % 2 == 0, "HT").otherwise("THT").alias(N.TENSION))

    @cached_property
    def grd(self) -> DataFrame:
        """Region / distributor month table; one pass feeds the MT, BT and Total classes."""
        final = F.col("o_orderstatus") == "F"
        price = F.col("o_totalprice")
        per_contract = self.raw("orders").groupBy(
            F.col("o_custkey").alias(N.CONTRAT), _year("o_orderdate").alias(N.ANNEE),
            _month("o_orderdate").alias(N.MOIS)).agg(
            F.sum(F.when(final, price)).alias("mt"), F.sum(F.when(~final, price)).alias("bt"))
        grd = F.when(F.col(N.CONTRAT) % 4 == 0, F.col("nation")).otherwise(N.SRM)
        kwh = F.coalesce("mt", F.lit(0.0)) + F.coalesce("bt", F.lit(0.0))

        def row(keep, classe, activite, value):
            return F.when(keep, F.struct(
                F.lit(classe).alias(N.CLASSE), activite.alias(N.ACTIVITE), value.alias("kwh")))

        classes = F.array(
            row(F.col("mt").isNotNull(), N.CLASS_MT, F.col(N.ACTIVITE), F.col("mt")),
            row(F.col("bt").isNotNull(), N.CLASS_BT, F.col(N.ACTIVITE), F.col("bt")),
            row(F.col(N.CONTRAT) % 4 != 0, N.CLASS_TOTAL, F.lit(None).cast("string"), kwh))
        return (
            per_contract.join(self.customers, N.CONTRAT)
            .select(N.ANNEE, N.MOIS, grd.alias(N.GRD), N.REGION, F.explode(F.array_compact(classes)).alias("x"))
            .groupBy(N.ANNEE, N.MOIS, F.col("x.activite").alias(N.ACTIVITE), N.GRD,
                     F.col("x.classe").alias(N.CLASSE), N.REGION)
            .agg(F.sum("x.kwh").alias(N.CONSO), F.count(F.lit(1)).alias(N.CLIENTS)))

    @cached_property
    def exogenous(self) -> DataFrame:
        """Economic indicators per region and year."""
        price, late = F.col("l_extendedprice"), F.col("l_linestatus") == "O"
        a = F.col("l_returnflag") == "A"

        def part(cond):
            return F.sum(F.when(cond, price).otherwise(F.lit(0.0)))

        per_supplier = self.raw("lineitem").groupBy("l_suppkey", _year("l_shipdate").alias(N.ANNEE)).agg(
            F.sum(price).alias(N.GDP[0]), part(F.col("l_linestatus") == "F").alias(N.GDP[1]),
            part(late & a).alias(N.GDP[2]), part(late & ~a).alias(N.GDP[3]))
        return per_supplier.join(self.suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
            N.REGION, N.ANNEE).agg(*[(F.sum(c) / F.lit(1e6)).alias(c) for c in N.GDP])

    @cached_property
    def weather(self) -> DataFrame:
        """Daily weather per region."""
        per_supplier = self.raw("lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("date_jour")).agg(
            F.min("l_quantity").alias("_min"), F.max("l_quantity").alias("_max"), F.sum("l_quantity").alias("_sum"),
            F.count("l_quantity").alias("_n"), F.sum("l_tax").alias("_tax"), F.sum("l_discount").alias("_discount"))
        return (
            per_supplier.join(self.suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(N.REGION, "date_jour")
            .agg((F.min("_min") - 5).alias("apparent_temperature_min"),
                 (F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("apparent_temperature_mean"),
                 F.max("_max").alias("apparent_temperature_max"),
                 F.sum("_tax").alias("precipitation_sum"),
                 F.sum("_discount").alias("et0_fao_evapotranspiration_sum"))
            .select(N.REGION, "date_jour", _year("date_jour").alias(N.ANNEE), _month("date_jour").alias(N.MOIS),
                    "apparent_temperature_min", "apparent_temperature_mean", "apparent_temperature_max",
                    "precipitation_sum", "et0_fao_evapotranspiration_sum"))

    @cached_property
    def contract_dates(self) -> DataFrame:
        """Move-in and move-out dates as the messy strings the sources hold."""
        span = self.raw("orders").groupBy(F.col("o_custkey").alias(N.CONTRAT)).agg(
            F.min("o_orderdate").alias("d0"), F.max("o_orderdate").alias("d1"))
        c = F.col(N.CONTRAT)
        return span.join(self.raw("customer").select(F.col("c_custkey").alias(N.CONTRAT)), N.CONTRAT, "left_semi").select(
            N.CONTRAT,
            F.when(c % 11 == 0, F.lit(None).cast("string"))
            .when(c % 3 == 0, F.date_format("d0", "dd/MM/yyyy"))
            .when(c % 3 == 1, F.date_format("d0", "yyyy-MM-dd"))
            .otherwise("a verifier").alias(N.DATE_IN),
            F.when(c % 5 == 0, F.concat(F.date_format("d1", "yyyy-MM-dd"), F.lit(" 00:00:00")))
            .when(c % 5 == 1, "9999-12-31 00:00:00").alias(N.DATE_OUT))

    @cached_property
    def contracts(self) -> DataFrame:
        """Contract-months with their date strings."""
        return self.cd.join(self.contract_dates, N.CONTRAT, "left")

    def kept(self) -> Tables:
        """The same views with the contract-months written once, for queries that read them more than once."""
        if "_kept" not in self.__dict__:
            columns = self.cd.columns
            self.__dict__["contracts"] = self.__dict__["_kept"] = materialize(self.contracts, "contract-months")
            self.__dict__["cd"] = self.contracts.select(*columns)
        return self

    @cached_property
    def last_year(self) -> int:
        """Where histories end; ``WholeYears`` reads it from the data."""
        return 2000

    @property
    def history(self) -> DataFrame:
        """Contract-months up to ``last_year``."""
        return self.cd.filter(F.col(N.ANNEE) <= self.last_year)

    @cached_property
    def order_years(self) -> DataFrame:
        return self.raw("orders").select(_year("o_orderdate").alias(N.ANNEE)).distinct()

    @cached_property
    def ev(self) -> DataFrame:
        years = self.order_years.agg(F.collect_set(N.ANNEE).alias("years"))
        since = F.col(N.ANNEE) - 1993
        return (self.raw("region").crossJoin(years)
                .select(F.col("r_name").alias(N.REGION), F.explode("years").alias(N.ANNEE))
                .withColumn("ev", (1000 * since * since).cast("double")))

    @cached_property
    def weather_diff(self) -> DataFrame:
        years = self.order_years.filter(F.col(N.ANNEE) >= 2000).agg(F.collect_set(N.ANNEE).alias("years"))
        y = (F.col(N.ANNEE) - 2000).cast("double")
        return (self.raw("region").crossJoin(years)
                .select(F.col("r_name").alias(N.REGION), F.explode("years").alias(N.ANNEE))
                .select(N.REGION, N.ANNEE, (0.5 * y).alias("temp_min_diff"),
                        (-1.0 * y).alias("precipitation_sum_diff"), (2.0 * y).alias("et0_diff")))


class WholeYears(Tables):
    """The same tables with histories up to the last year that has orders in all twelve months."""

    @cached_property
    def last_year(self) -> int:
        """One number of a map-side folded scan of one column; as a literal it reaches the scans of the facts."""
        months = self.raw("orders").groupBy(_year("o_orderdate").alias(N.ANNEE)).agg(F.size(F.collect_set(_month("o_orderdate"))).alias("_m"))
        found = months.filter(F.col("_m") == 12).agg(F.max(N.ANNEE).alias("y")).first()["y"]
        return -1 if found is None else int(found)
