"""Queries over scans, file round trips and raw-sheet ingestion."""

from pyspark.sql import functions as F

from wattline import names as N
from wattline.catalog.registry import query
from wattline.functions import columns as C
from wattline.session import scratch_path
from wattline.sources import sheets as S, tables as T


def years_of(df) -> list[int]:
    """The years of a table, first to last."""
    lo, hi = df.agg(F.min(N.ANNEE), F.max(N.ANNEE)).first()
    return [] if lo is None else list(range(int(lo), int(hi) + 1))


def labels_of(df) -> list[str]:
    years = years_of(df)
    return S.month_labels(years[0], years[-1]) if years else []


@query("regional_scan_a01", "region:s classe:s annee:i mois:i activite:s consommation_kwh:d",
       "select * from grd where grd = 'SRM' and classe in ('MT', 'BT', 'Total')", "grd", scale=2)
def _(t):
    return T.regional_scan(t.grd)


@query("distributor_scan_a02", "region:s annee:i mois:i distributeur:s consommation_kwh:d",
       "select region, annee, mois, grd as distributeur, sum(consommation_kwh) as consommation_kwh "
       "from grd where grd <> 'SRM' group by 1, 2, 3, 4", "grd", scale=2)
def _(t):
    return T.distributor_scan(t.grd)


_GDP = "pib_mdh:d gdp_primaire:d gdp_secondaire:d gdp_tertiaire:d"


@query("exogenous_regional_a03", f"region:s annee:i {_GDP}",
       "select region, annee, avg(pib_mdh) as pib_mdh, avg(gdp_primaire) as gdp_primaire, "
       "avg(gdp_secondaire) as gdp_secondaire, avg(gdp_tertiaire) as gdp_tertiaire from exogenous group by 1, 2",
       "exogenous", scale=5)
def _(t):
    return T.exogenous_regional(t.exogenous)


@query("exogenous_national_a04", f"annee:i {_GDP}",
       "select annee, sum(pib_mdh) as pib_mdh, sum(gdp_primaire) as gdp_primaire, "
       "sum(gdp_secondaire) as gdp_secondaire, sum(gdp_tertiaire) as gdp_tertiaire from exogenous group by 1",
       "exogenous", scale=5)
def _(t):
    return T.exogenous_national(t.exogenous)


@query("contract_scan_a05", "region:s partenaire:s contrat:i annee:i mois:i activite:s consommation_kwh:d "
       "consommation_zconhc:d consommation_zconhl:d consommation_zconhp:d niveau_tension:s puissance_facturee:d "
       "puissance_appelee:d date_emmenagement:s date_demenagement:s", "select * from contracts", "contracts", scale=2)
def _(t):
    return T.contract_scan(t.contracts)


@query("weather_scan_a06", "region:s annee:i mois:i temp_min_latest:d precipitation_sum_latest:d et0_latest:d",
       "select region, annee, mois, apparent_temperature_min as temp_min_latest, precipitation_sum as "
       "precipitation_sum_latest, et0_fao_evapotranspiration_sum as et0_latest from weather", "weather")
def _(t):
    return T.weather_scan(t.weather)


@query("load_regional_a07", "region:s annee:i mois:i classe:s activite:s consommation_kwh:d",
       "select region, annee, mois, classe, case when classe = 'MT' and activite = 'Administratif' then "
       "'Administratif_mt' when classe = 'Total' and activite is null then 'Total' else activite end as activite, "
       "coalesce(consommation_kwh, 0) as consommation_kwh from grd where grd = 'SRM'", "grd", scale=2)
def _(t):
    return T.load_regional(t.grd)


def client_forecasts(t):
    """Earlier client forecasts per region and activity: here the monthly client counts themselves."""
    return (T.load_regional(t.grd, N.CLIENTS).groupBy(N.REGION, N.ACTIVITE, N.ANNEE, N.MOIS)
            .agg(F.sum(N.CLIENTS).alias("valeur")))


@query("client_prediction_lookup_a08", "region:s activite:s annee:i total:d",
       "select region, activite, annee, sum(v) as total from (select region, coalesce(activite, 'Total') as activite, "
       "annee, mois, sum(nbr_clients) as v from grd where grd = 'SRM' group by 1, 2, 3, 4) s "
       "group by 1, 2, 3 having count(*) = 12", "grd")
def _(t):
    path = scratch_path(t.spark, "client-forecasts")
    packed = client_forecasts(t).groupBy(N.REGION, N.ACTIVITE, N.ANNEE).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(N.MOIS, "valeur"))), lambda x: x["valeur"]).alias("valeurs"))
    stored = T.replace_parquet(packed, path)
    return T.valid_forecast_years(stored).withColumn(
        "total", F.aggregate("valeurs", F.lit(0.0), lambda a, v: a + v))


@query("aggregate_predictions_a09", "entity:s annee:i mois:i valeur:d",
       "select entity, annee, mois, valeur from look union all select 'Menages', annee, mois, sum(valeur) "
       "from look where entity in ('BUILDING', 'HOUSEHOLD') group by 2, 3", "grd",
       ctes="look as (select activite as entity, annee, mois, sum(nbr_clients) as valeur from grd where grd = 'SRM' "
            "and activite is not null group by 1, 2, 3)")
def _(t):
    look = (client_forecasts(t).filter(F.col(N.ACTIVITE) != N.TOTAL)
            .groupBy(F.col(N.ACTIVITE).alias("entity"), N.ANNEE, N.MOIS).agg(F.sum("valeur").alias("valeur")))
    return T.aggregate_predictions(look, "Menages", ["BUILDING", "HOUSEHOLD"])


@query("csv_round_trip_a10", "region:s annee:i mois:i distributeur:s consommation_kwh:d",
       "select region, annee, mois, grd as distributeur, sum(consommation_kwh) as consommation_kwh "
       "from grd where grd <> 'SRM' group by 1, 2, 3, 4", "grd", scale=2)
def _(t):
    df = T.distributor_scan(t.grd)
    path = scratch_path(t.spark, "csv")
    T.write_csv(df, path)
    return T.read_csv(t.spark, path, df.schema)


@query("replace_sink_a11", f"annee:i {_GDP}",
       "select annee, sum(pib_mdh) as pib_mdh, sum(gdp_primaire) as gdp_primaire, "
       "sum(gdp_secondaire) as gdp_secondaire, sum(gdp_tertiaire) as gdp_tertiaire from exogenous group by 1",
       "exogenous", scale=5)
def _(t):
    path = scratch_path(t.spark, "sink")
    T.replace_parquet(t.exogenous, path)
    return T.replace_parquet(T.exogenous_national(t.exogenous), path, [N.ANNEE])


@query("append_then_replace_a12", "region:s annee:i mois:i distributeur:s consommation_kwh:d",
       "select region, annee, mois, grd as distributeur, sum(consommation_kwh) as consommation_kwh "
       "from grd where grd <> 'SRM' group by 1, 2, 3, 4", "grd", scale=2)
def _(t):
    rows = T.distributor_scan(t.grd)
    old, new = scratch_path(t.spark, "history"), scratch_path(t.spark, "history")
    T.replace_parquet(rows.filter(F.col(N.ANNEE) < 2001), old)
    return T.append_into_new(old, rows.filter(F.col(N.ANNEE) >= 2001), new, [N.REGION, N.ANNEE, N.MOIS])


def region_names(t) -> list[str]:
    """The regions, one file or sheet each."""
    return sorted(r[0] for r in t.raw("region").select("r_name").collect())


@query("combine_sheets_a13", "City:s annee:i mois:i apparent_temperature_min:d apparent_temperature_max:d",
       "select region as City, annee, mois, apparent_temperature_min, case when region in ('AFRICA', 'ASIA') then "
       "apparent_temperature_max end as apparent_temperature_max from weather", "weather")
def _(t):
    w = t.weather
    sheets = {}
    for region in region_names(t):
        cols = [N.ANNEE, N.MOIS, "apparent_temperature_min"] + (
            ["apparent_temperature_max"] if region in ("AFRICA", "ASIA") else [])
        sheets[region] = w.filter(F.col(N.REGION) == region).select(*cols)
    return T.combine_sheets(sheets)


@query("gather_region_files_a14", "region:s activite:s annee:i consommation_kwh:d",
       "select k.region, k.activite, y as annee, c.v as consommation_kwh from (select distinct region, activite from cd) k cross join "
       "(select unnest(range(min(annee), max(annee) + 1)) as y from cd) ys left join (select region, activite, annee, sum(consommation_kwh) as v from cd "
       "group by 1, 2, 3) c on c.region = k.region and c.activite = k.activite and c.annee = y", "cd", scale=2)
def _(t):
    years = years_of(t.cd)
    root = scratch_path(t.spark, "regions")
    wide = t.cd.groupBy(N.REGION, N.ACTIVITE).pivot(N.ANNEE, years).agg(F.sum(N.CONSO))
    schema = "activite string, " + ", ".join(f"`{y}` double" for y in years)
    for region in region_names(t):
        T.write_csv(wide.filter(F.col(N.REGION) == region).drop(N.REGION), f"{root}/results_{region.replace(' ', '_')}.csv")
    files = T.gather_region_files(t.spark, root, schema, r"^results_(\w+)\.csv$").withColumn(N.REGION, F.translate(N.REGION, "_", " "))
    return S.melt(files, [N.REGION, N.ACTIVITE], [str(y) for y in years], N.ANNEE, N.CONSO)


_STF = ("Region:s Activity:s Year:i Month:i Consommation:d")


@query("result_renames_stf_srm_a15", _STF,
       "select region as Region, activite as Activity, annee as Year, mois as Month, sum(consommation_kwh) as "
       "Consommation from cd group by 1, 2, 3, 4", "cd", scale=2)
def _(t):
    df = t.cd.groupBy(N.REGION, N.ACTIVITE, N.ANNEE, N.MOIS).agg(F.sum(N.CONSO).alias("consommation"))
    return T.rename_result(df, N.STF_SRM_HEADER)


@query("result_renames_stf_cd_a15", "Region:s Partenaire:s Contrat:i Activity:s Year:i Month:i Consommation_Total:d "
       "Consommation_ZCONHC:d Consommation_ZCONHL:d Consommation_ZCONHP:d Puissance_Facturee:d Niveau_tension:s",
       "select region as Region, partenaire as Partenaire, contrat as Contrat, activite as Activity, annee as Year, "
       "mois as Month, consommation_kwh as Consommation_Total, consommation_zconhc as Consommation_ZCONHC, "
       "consommation_zconhl as Consommation_ZCONHL, consommation_zconhp as Consommation_ZCONHP, "
       "puissance_facturee as Puissance_Facturee, niveau_tension as Niveau_tension from cd", "cd", scale=2)
def _(t):
    return T.rename_result(t.cd.withColumnRenamed(N.CONSO, "consommation"), N.STF_CD_HEADER)


@query("result_renames_ltf_srm_a15", "Region:s Year:i Consommation:d",
       "select region as Region, annee as Year, sum(consommation_kwh) as Consommation from cd group by 1, 2",
       "cd", scale=2)
def _(t):
    return T.rename_result(t.cd.groupBy(N.REGION, N.ANNEE).agg(F.sum(N.CONSO).alias("consommation")), N.LTF_SRM_HEADER)


@query("result_renames_ltf_cd_a15", "Region:s Partenaire:s Contrat:i Activity:s Year:i Consommation_Total:d "
       "Consommation_ZCONHC:d Consommation_ZCONHL:d Consommation_ZCONHP:d Puissance_Facturee:d Niveau_tension:s",
       "select region as Region, partenaire as Partenaire, contrat as Contrat, activite as Activity, annee as Year, "
       "sum(consommation_kwh) as Consommation_Total, sum(consommation_zconhc) as Consommation_ZCONHC, "
       "sum(consommation_zconhl) as Consommation_ZCONHL, sum(consommation_zconhp) as Consommation_ZCONHP, "
       "sum(puissance_facturee) as Puissance_Facturee, niveau_tension as Niveau_tension from cd "
       "group by 1, 2, 3, 4, 5, niveau_tension", "cd", scale=2)
def _(t):
    yearly = t.cd.groupBy(N.REGION, N.PARTENAIRE, N.CONTRAT, N.ACTIVITE, N.ANNEE, N.TENSION).agg(
        F.sum(N.CONSO).alias("consommation"), *[F.sum(c).alias(c) for c in (*N.BANDS, N.PF)])
    return T.rename_result(yearly, N.LTF_CD_HEADER)


def raw_sheet(t):
    """A wide raw sheet: ``<activity> : <city>`` rows, ``metric__MM.YYYY`` columns, subtotal rows."""
    label = F.concat(F.col(N.ACTIVITE), F.lit(" : DR "), F.translate(N.REGION, " ", "_"))
    long = t.grd.filter((F.col(N.GRD) == N.SRM) & F.col(N.ACTIVITE).isNotNull())
    keyed, labels = long.withColumn("site", label), labels_of(t.grd)
    kwh = S.pivot_months(keyed, ["site", N.CLASSE], N.CONSO, labels, "KWh__")
    clients = S.pivot_months(keyed, ["site", N.CLASSE], N.CLIENTS, labels, "NB_CLIENTS__")
    rows = kwh.join(clients, ["site", N.CLASSE])
    subtotal = rows.withColumn("site", F.concat(F.lit("Somme "), F.col("site")))
    return rows.unionByName(subtotal).drop(N.CLASSE)


@query("wide_sheet_to_monthly_a17", "region:s activite:s annee:i mois:i MWh:d nbr_clients:d",
       "select case region when 'AFRICA' then 'Afrique' when 'AMERICA' then 'Amerique' when 'ASIA' then 'Asie' "
       "when 'EUROPE' then 'Europe' else 'Orient' end as region, case activite when 'AUTOMOBILE' then 'Auto' when 'BUILDING' then 'Batiment' "
       "when 'FURNITURE' then 'Meuble' when 'HOUSEHOLD' then 'Menage' else 'Machine' end as activite, y as annee, "
       "m as mois, coalesce(mwh, 0) as MWh, coalesce(n, 0) as nbr_clients from (select distinct region, activite from "
       "grd where activite is not null and grd = 'SRM') k cross join (select unnest(range(min(annee), max(annee) + 1)) as y from grd) "
       "ys cross join range(1, 13) ms(m) left join (select region, activite, annee, mois, sum(consommation_kwh) / "
       "1000 as mwh, sum(nbr_clients) as n from grd where grd = 'SRM' and activite is not null group by 1, 2, 3, 4) g "
       "on g.region = k.region and g.activite = k.activite and g.annee = y and g.mois = m".replace(
           "select case region", "select case k.region").replace("case activite when", "case k.activite when"), "grd", scale=5)
def _(t):
    sheet = raw_sheet(t)
    activities = t.raw("customer").select(F.col("c_mktsegment").alias("a")).distinct().select(
        C.clean_header(F.col("a")).alias("raw_activity"),
        F.when(F.col("a") == "AUTOMOBILE", "Auto").when(F.col("a") == "BUILDING", "Batiment")
        .when(F.col("a") == "FURNITURE", "Meuble").when(F.col("a") == "HOUSEHOLD", "Menage")
        .when(F.col("a") == "MACHINERY", "Machine").alias("label"))
    cities = t.raw("region").select(
        F.translate("r_name", " ", "_").alias("city"),
        F.when(F.col("r_name") == "AFRICA", "Afrique").when(F.col("r_name") == "AMERICA", "Amerique")
        .when(F.col("r_name") == "ASIA", "Asie").when(F.col("r_name") == "EUROPE", "Europe").otherwise("Orient").alias("label"))
    values = [c for c in sheet.columns if "__" in c]
    wide = S.sheet_to_monthly(sheet, "site", values, activities, cities)
    return wide.select(N.REGION, N.ACTIVITE, N.ANNEE, N.MOIS, (F.col("KWh") / 1000).alias("MWh"),
                       F.col("NB_CLIENTS").alias("nbr_clients"))


@query("sales_and_use_a18", "partenaire:s contrat:i activite:s annee:i mois:i ventes:d consommation:d",
       "select c.partenaire, c.contrat, c.activite, y as annee, m as mois, coalesce(ventes, 0) as ventes, "
       "coalesce(consommation, 0) as consommation from (select distinct partenaire, contrat, activite from cd) c "
       "cross join (select unnest(range(min(annee), max(annee) + 1)) as y from cd) ys cross join range(1, 13) ms(m) left join (select contrat, annee, mois, "
       "sum(puissance_facturee) as ventes, sum(consommation_kwh) as consommation from cd group by 1, 2, 3) g "
       "on g.contrat = c.contrat and g.annee = y and g.mois = m", "cd", scale=2)
def _(t):
    t = t.kept()
    keys, labels = [N.PARTENAIRE, N.CONTRAT, N.ACTIVITE], labels_of(t.cd)
    sales = S.pivot_months(t.cd, keys, N.PF, labels)
    use = S.pivot_months(t.cd, keys, N.CONSO, labels)
    return S.sales_and_use(sales, use, keys, labels)


@query("union_of_eras_a19", "region:s annee:i mois:i temperature:d clients:i",
       "select region, annee, mois, null as temperature, nbr_clients as clients from grd where classe = 'Total' and annee <= 1997 "
       "union all select region, annee, mois, consommation_kwh / nbr_clients, nbr_clients from grd where classe = 'Total' "
       "and annee > 1997", "grd")
def _(t):
    total = t.grd.filter(F.col(N.CLASSE) == N.CLASS_TOTAL)
    cols = [N.REGION, N.ANNEE, N.MOIS, F.col(N.CLIENTS).alias("clients")]
    old = total.filter(F.col(N.ANNEE) <= 1997).select(*cols)
    new = total.filter(F.col(N.ANNEE) > 1997).select(*cols, (F.col(N.CONSO) / F.col(N.CLIENTS)).alias("temperature"))
    return T.union_eras(old, new).orderBy(N.ANNEE, N.MOIS)
