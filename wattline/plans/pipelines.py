"""End-to-end runs: short- and long-term forecasts of regions and contracts, and their corrections.

Every run covers all regions or contracts in one plan. Where a second pass needs the first one's
forecasts, the first is written to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattline import names as N
from wattline.functions import series as S
from wattline.models import forest, long_term as LT, short_term as ST
from wattline.operators import adjustments as J, aggregates as A, contracts as K, neighbours as B, rules as R
from wattline.operators.cleaning import non_negative_forecast
from wattline.session import materialize
from wattline.sources import tables as T

V = "consommation"
SRM = [N.REGION, N.ACTIVITE]
GDP = list(N.GDP)
CLIENTS = "previsions_clients"
CD_BLOCK = ["total_active_contrats", f"{N.PF}_total", *K.AGES, "pib_mdh"]


def regional_series(regional: DataFrame, distributors: DataFrame | None, levels=(0, 1), variable: str = N.CONSO) -> DataFrame:
    """Monthly series per region: level 0 the combined total, level 1 the activities too."""
    updated, combined = A.with_distributors(regional, distributors, variable)
    total = combined.select(N.REGION, F.lit(N.TOTAL).alias(N.ACTIVITE), N.ANNEE, N.MOIS, F.col(variable).alias(V))
    if 1 not in levels:
        return total
    parts = updated.filter(F.col(N.ACTIVITE) != N.TOTAL).groupBy(*SRM, N.ANNEE, N.MOIS).agg(F.sum(variable).alias(V))
    return parts.unionByName(total)


def client_lookup(forecasts: DataFrame) -> DataFrame:
    """(region, activite, annee, valeurs): twelve monthly forecasts per entity and year from written contract forecasts.

    ``forecasts`` has version, region, activite, contrat, annee, mois and the forecast. An entity is a region's activity or
    its total. Each takes, year by year, the newest version that has all twelve months for it, so an entity that the
    newest run lacks falls back to an older run alone.
    """
    keys = ["version", *SRM, N.ANNEE]
    parts = forecasts.groupBy(*keys, N.MOIS).agg(F.sum(V).alias("valeur"))
    total = parts.groupBy("version", N.REGION, N.ANNEE, N.MOIS).agg(F.sum("valeur").alias("valeur")).withColumn(N.ACTIVITE, F.lit(N.TOTAL))
    packed = parts.unionByName(total).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(N.MOIS, "valeur"))), lambda x: x["valeur"]).alias("valeurs"))
    newest = T.valid_forecast_years(packed).groupBy(*SRM, N.ANNEE).agg(F.max_by("valeurs", "version").alias("valeurs"), F.max("version").alias("version"))
    return newest.select(*SRM, N.ANNEE, "valeurs", "version")


def _features(exogenous: DataFrame, keys, year: int):
    exogenous = materialize(exogenous, "indicators")  # few rows, read several times
    levels = R.extrapolate_features(exogenous, keys, GDP, year)
    return levels, S.growth_features(levels, keys, GDP, ("lag_lchg",), (1,)), [f"{c}_lchg_lag1" for c in GDP]


def short_term_regional(monthly: DataFrame, exogenous: DataFrame, year: int, grid: dict = ST.REGIONAL_GRID, threshold: float = 0.6,
                        penalty: float = 1.5, favor_overestimation: bool = True, clients: DataFrame | None = None) -> DataFrame:
    """Twelve months of ``year`` per region and activity; the total directly or as a sum, whichever tested better.

    ``clients`` is a lookup of contract forecasts (``client_lookup``) for grids that use them; entities and years without
    one read as zeros.
    """
    rows = R.with_placeholder_year(monthly, SRM, year, V)
    levels, growth, growth_cols = _features(exogenous, [N.REGION], year)
    packed = ST.pack_series(rows, SRM, V, levels, GDP, growth, growth_cols, clients, feature_keys=[N.REGION])
    models = ST.run_short_term(packed, SRM, grid, ST.REGIONAL_ALPHAS, threshold, penalty, favor_overestimation, placeholder_year=year)
    tested = materialize(ST.long_predictions(models, SRM), "tested")
    annual = tested.groupBy(*SRM, N.ANNEE).agg(F.sum("actual").alias("actual"), F.sum("prediction").alias("prediction"))
    ahead = tested.filter(F.col(N.ANNEE) == year).select(*SRM, N.ANNEE, N.MOIS, F.col("prediction").alias(V))
    rebuilt = R.rebuild_total(ahead, R.choose_total_method(annual))
    return non_negative_forecast(rebuilt, monthly.select(*SRM, N.ANNEE, N.MOIS, V), SRM, V)


def _with_clients(levels: DataFrame, clients: DataFrame) -> DataFrame:
    """Yearly features with the contract forecasts of each region's total."""
    yearly = clients.filter(F.col(N.ACTIVITE) == N.TOTAL).select(
        N.REGION, N.ANNEE, F.aggregate("valeurs", F.lit(0.0), lambda s, v: s + v).alias("_known"))
    last = yearly.groupBy(N.REGION).agg(F.max_by("_known", N.ANNEE).alias("_last"), F.max(N.ANNEE).alias("_until"))
    later = F.when(F.col(N.ANNEE) > F.col("_until"), F.col("_last"))
    rows = levels.join(yearly, [N.REGION, N.ANNEE], "left").join(last, N.REGION, "left")
    return rows.withColumn(CLIENTS, F.coalesce("_known", later, F.lit(0.0))).drop("_known", "_last", "_until")


def long_term_regional(monthly: DataFrame, exogenous: DataFrame, last_year: int, horizon: int = 5, grid: dict = LT.REGIONAL_GRID,
                       impute: int | None = None, blocks=((), ("pib_mdh",), tuple(N.GDP[1:]), N.GDP), clients: DataFrame | None = None) -> DataFrame:
    """Five annual totals per region after ``last_year``.

    With ``clients`` (``client_lookup``) the yearly contract forecasts of a region's total are one more feature, alone and
    with the indicators; a region without one reads as zeros, a year after its last one as that one.
    """
    total = monthly.filter((F.col(N.ACTIVITE) == N.TOTAL) & (F.col(N.ANNEE) <= last_year))
    if impute is not None:
        total = R.impute_year(total, [N.REGION], V, impute)
    annual = total.groupBy(N.REGION, N.ANNEE).agg(F.sum(V).alias(V))
    levels = R.extrapolate_features(exogenous, [N.REGION], GDP, last_year + horizon)
    features = GDP
    if clients is not None:
        levels, features = _with_clients(levels, clients), [*GDP, CLIENTS]
        blocks = (*blocks, (CLIENTS,), tuple(features))
    packed, columns = LT.pack_annual(annual, levels, [N.REGION], V, features, horizon=horizon, feature_keys=[N.REGION])
    _, ahead = LT.run_long_term(packed, columns, [list(b) for b in blocks], [N.REGION], grid)
    rows = ahead.select(N.REGION, N.ANNEE, F.col("prediction").alias(V))
    return non_negative_forecast(rows, annual, [N.REGION], V)


def regional_history(regional: DataFrame, distributors: DataFrame | None, exogenous: DataFrame, current_year: int,
                     st_grid: dict = ST.REGIONAL_GRID, clients: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status, corrected, history): the current year of incomplete regions forecast, corrected by its realised months and put
    into the history. Complete and incomplete regions share the plan: the status table decides which rows each branch keeps.
    """
    monthly = materialize(regional_series(regional, distributors), "regional-series")
    status = R.latest_status(monthly.filter(F.col(N.ACTIVITE) == N.TOTAL), [N.REGION])
    # a region whose last year is whole needs no first pass: its rows simply do not enter it
    partial = status.filter(~F.col("complete")).select(N.REGION)
    before = monthly.filter(F.col(N.ANNEE) < current_year).join(partial, N.REGION, "left_semi")
    current = short_term_regional(before, exogenous, current_year, st_grid, clients=clients)
    realised = monthly.filter(F.col(N.ANNEE) == current_year)
    corrected = materialize(R.correct_with_realised(current, realised, SRM, V), "corrected")
    revised = R.upsert(monthly.join(partial, N.REGION, "left_semi"), corrected, [*SRM, N.ANNEE, N.MOIS], V, SRM)
    return status, corrected, materialize(monthly.join(partial, N.REGION, "left_anti").unionByName(revised), "history")


def full_regional_short_term(parts: tuple[DataFrame, DataFrame, DataFrame], exogenous: DataFrame, current_year: int,
                             st_grid: dict = ST.REGIONAL_GRID, clients: DataFrame | None = None) -> DataFrame:
    """The remaining months of the current year and the next year, from ``regional_history``."""
    status, corrected, history = parts
    following = short_term_regional(history, exogenous, current_year + 1, st_grid, clients=clients)
    return T.rename_result(R.remaining_and_next(corrected, following, status, [N.REGION]), N.STF_SRM_HEADER)


def full_regional_long_term(parts: tuple[DataFrame, DataFrame, DataFrame], exogenous: DataFrame, current_year: int, horizon: int = 5,
                            lt_grid: dict = LT.REGIONAL_GRID, clients: DataFrame | None = None) -> DataFrame:
    """The annual totals after the current year, from ``regional_history``."""
    return T.rename_result(long_term_regional(parts[2], exogenous, current_year, horizon, lt_grid, clients=clients), N.LTF_SRM_HEADER)


def full_regional(regional: DataFrame, distributors: DataFrame | None, exogenous: DataFrame, current_year: int, st_grid: dict = ST.REGIONAL_GRID,
                  lt_grid: dict = LT.REGIONAL_GRID, horizon: int = 5) -> tuple[DataFrame, DataFrame]:
    """Short- and long-term results of all regions, with the current year complete or not."""
    parts = regional_history(regional, distributors, exogenous, current_year, st_grid)
    return (full_regional_short_term(parts, exogenous, current_year, st_grid),
            full_regional_long_term(parts, exogenous, current_year, horizon, lt_grid))


def established_forecasts(contracts: DataFrame, spans: DataFrame, exogenous: DataFrame, year: int, grid: dict = ST.CONTRACT_GRID,
                          threshold: float = 0.6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written forecasts of all live established contracts, tested years and ``year``; their history; those with rows the year before."""
    routed = K.contract_class(spans.filter(F.col("finish_year") >= year), year)
    past = contracts.filter(F.col(N.ANNEE) < year)
    key = [N.CONTRAT]
    first = spans.select(N.CONTRAT, (F.col("start_year") - 2).alias("_from"))
    established = past.join(routed.filter("classe_contrat = 'established'").select(N.CONTRAT), N.CONTRAT, "left_semi").join(first, N.CONTRAT).filter(
        F.col(N.ANNEE) >= F.col("_from")).drop("_from")
    last = established.groupBy(N.CONTRAT).agg(F.max(N.ANNEE).alias("_last")).filter(F.col("_last") == year - 1).drop("_last")
    rows = established.join(last, N.CONTRAT, "left_semi").select(N.CONTRAT, N.ANNEE, N.MOIS, F.col(N.CONSO).alias(V), N.PF)
    placed = R.with_placeholder_year(rows, key, year, V, [N.PF])
    levels, growth, growth_cols = _features(T.exogenous_national(exogenous), [], year)
    packed = ST.pack_series(placed, key, V, levels, GDP, growth, growth_cols, power=N.PF, fill_gaps=True)
    models = ST.run_short_term(packed, key, grid, ST.CONTRACT_ALPHAS, threshold, placeholder_year=year)
    return materialize(ST.long_predictions(models, key), "tested-contracts"), rows, last


def young_neighbours(contracts: DataFrame, young: DataFrame, year: int) -> DataFrame:
    """Written nearest contracts, by the billed power of ``year``, of the contracts in ``young``."""
    profiles = materialize(B.with_scope(B.power_profiles(contracts, year), contracts), "profiles")
    return materialize(B.nearest(profiles.join(young, N.CONTRAT, "left_semi"), profiles), "near")


def short_term_contracts(contracts: DataFrame, exogenous: DataFrame, year: int, grid: dict = ST.CONTRACT_GRID, threshold: float = 0.6,
                         forests: dict | None = None) -> DataFrame:
    """Twelve months of ``year`` for every live contract: models for established ones, forests for young ones.

    Young contracts without rows in their first year, or for which there is no sample to learn from, are forecast by their three
    nearest contracts; those without billed power in their first year by the one nearest.
    ``forests`` has options of the forests, such as ``min_start``.

    A contract that cannot be forecast has twelve zeros and a reason in ``motif``: ``no_recent_data`` (established, without rows in
    the year before), ``no_model`` (no back-test or no usable neighbour), ``starts_later``. Live means that the contract does not end
    before ``year``.
    """
    spans = materialize(K.contract_spans(contracts), "spans")
    live = spans.filter(F.col("finish_year") >= year)
    routed = K.contract_class(live, year)
    key = [N.CONTRAT]
    tested, rows, last = established_forecasts(contracts, spans, exogenous, year, grid, threshold)
    ahead = tested.filter(F.col(N.ANNEE) == year).select(N.CONTRAT, N.ANNEE, N.MOIS, F.col("prediction").alias(V))
    ahead = non_negative_forecast(ahead, rows.select(*key, N.ANNEE, N.MOIS, V), key, V)

    young = routed.filter("classe_contrat in ('growth', 'similarity')")
    near = young_neighbours(contracts, young, year)
    cols = [N.CONTRAT, N.ANNEE, N.MOIS, V]
    options = {**(forests or {}), "unlearned": False}
    shapes = materialize(B.neighbour_shapes(near, tested, year), "shapes")
    learned = {"growth": forest.growing_contract_forecast(contracts, spans, shapes, year, **options),
               "similarity": forest.new_contract_forecast(contracts, spans, year, **options)}
    found = ahead.select(*cols)
    powerless = materialize(forest.without_power(contracts, spans), "powerless")
    for name, values in learned.items():
        of_class = young.filter(F.col("classe_contrat") == name)
        values = materialize(values.join(of_class, N.CONTRAT, "left_semi").select(*cols), f"forest-{name}")
        left = near.join(of_class, N.CONTRAT, "left_semi").join(values, N.CONTRAT, "left_anti")
        found = found.unionByName(values)
        for top, those in ((1, left.join(powerless, N.CONTRAT, "left_semi")), (3, left.join(powerless, N.CONTRAT, "left_anti"))):
            by_neighbours = B.growth_forecast(those, tested, contracts, year, top) if name == "growth" else B.similarity_forecast(those, tested, year, top)
            found = found.unionByName(by_neighbours.select(*cols))
    recent = last.withColumn("_recent", F.lit(True))
    why = (F.when(F.col("classe_contrat") == "later", "starts_later")
           .when((F.col("classe_contrat") == "established") & F.col("_recent").isNull(), "no_recent_data").otherwise("no_model"))
    reasons = routed.join(recent, N.CONTRAT, "left").select(N.CONTRAT, why.alias("_why"))
    whole = B.with_empty_results(routed, found, year).join(reasons, N.CONTRAT)
    forecast = materialize(whole.select(N.CONTRAT, N.ANNEE, N.MOIS, F.coalesce(V, F.lit(0.0)).alias(V),
                                        F.when(F.col("sans_resultat"), F.col("_why")).alias("motif")), "contract-forecast")
    attributes = R.first_attributes(contracts, [N.REGION, N.PARTENAIRE, N.ACTIVITE])
    return (R.split_bands(forecast.drop("motif"), contracts).join(attributes, N.CONTRAT, "left")
            .join(forecast.select(N.CONTRAT, N.MOIS, "motif"), [N.CONTRAT, N.MOIS]))


def contract_driver_features(contracts: DataFrame, exogenous: DataFrame, entity: str, end_year: int) -> DataFrame:
    """Contract features and economic indicators of every entity, carried to ``end_year``."""
    feats = K.future_features(contracts, entity, end_year)
    national = R.extrapolate_features(materialize(T.exogenous_national(exogenous), "indicators"), [], GDP, end_year)
    return feats.join(national, N.ANNEE, "left")


def long_term_contracts(contracts: DataFrame, exogenous: DataFrame, last_year: int, entity: str = N.REGION, horizon: int = 5,
                        grid: dict = LT.CONTRACT_GRID) -> DataFrame:
    """Five annual forecasts per entity, allocated to its operating contracts and tariff bands."""
    known = contracts.filter(F.col(N.ANNEE) <= last_year)
    features = materialize(contract_driver_features(known, exogenous, entity, last_year + horizon), "drivers")
    annual = known.groupBy(entity, N.ANNEE).agg(F.sum(N.CONSO).alias(V), F.sum(N.PF).alias(N.PF))
    packed, columns = LT.pack_annual(annual, features, [entity], V, CD_BLOCK, horizon=horizon, driver="total_active_contrats", power=N.PF,
                                     feature_keys=[entity])
    _, ahead = LT.run_long_term(packed, columns, [CD_BLOCK], [entity], grid)
    return R.allocate_to_contracts(ahead.select(entity, N.ANNEE, F.col("prediction").alias(V)), known, K.contract_spans(known), entity, V)


def contract_history(contracts: DataFrame, exogenous: DataFrame, current_year: int, st_grid: dict = ST.CONTRACT_GRID,
                     forests: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status, corrected, revised): the current year forecast and corrected by its realised months, and the history with it."""
    contracts = materialize(contracts, "contracts")
    status = R.latest_status(contracts)
    before = contracts.filter(F.col(N.ANNEE) <= current_year)
    current = short_term_contracts(before, exogenous, current_year, st_grid, forests=forests)
    realised = before.filter(F.col(N.ANNEE) == current_year).withColumnRenamed(N.CONSO, V)
    corrected = materialize(R.correct_with_realised(current, realised, [N.CONTRAT], V, N.BANDS), "corrected-contracts")
    keys = [N.CONTRAT, N.ANNEE, N.MOIS]
    return status, corrected, materialize(R.upsert(contracts, corrected.withColumnRenamed(V, N.CONSO), keys, N.CONSO, [N.CONTRAT]), "history-contracts")


def full_contracts_short_term(parts: tuple[DataFrame, DataFrame, DataFrame], exogenous: DataFrame, current_year: int,
                              st_grid: dict = ST.CONTRACT_GRID, forests: dict | None = None) -> DataFrame:
    """The remaining months of the current year and the next year, from ``contract_history``."""
    status, corrected, revised = parts
    following = short_term_contracts(revised, exogenous, current_year + 1, st_grid, forests=forests)
    flagged = status.withColumn("_k", F.lit(1))
    stf = R.remaining_and_next(corrected.withColumn("_k", F.lit(1)), following.withColumn("_k", F.lit(1)), flagged, ["_k"])
    return T.rename_result(stf, N.STF_CD_HEADER)


def full_contracts_long_term(parts: tuple[DataFrame, DataFrame, DataFrame], exogenous: DataFrame, current_year: int, entity: str = N.REGION,
                             lt_grid: dict = LT.CONTRACT_GRID) -> DataFrame:
    """The annual forecasts after the current year, from ``contract_history``: no second short-term pass."""
    return T.rename_result(long_term_contracts(parts[2], exogenous, current_year, entity, grid=lt_grid), N.LTF_CD_HEADER)


def full_contracts(contracts: DataFrame, exogenous: DataFrame, current_year: int, st_grid: dict = ST.CONTRACT_GRID, lt_grid: dict = LT.CONTRACT_GRID,
                   entity: str = N.REGION, forests: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Short- and long-term results of all contracts; the current year is forecast, corrected by its realised months and reused."""
    parts = contract_history(contracts, exogenous, current_year, st_grid, forests)
    return (full_contracts_short_term(parts, exogenous, current_year, st_grid, forests),
            full_contracts_long_term(parts, exogenous, current_year, entity, lt_grid))


def corrected_forecasts(stf: DataFrame, ltf: DataFrame, weather: DataFrame, weather_diff: DataFrame, coefficients: DataFrame, ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weather and EV corrections of annual forecasts (region, annee) and monthly ones, which share them by month."""
    by_weather = J.weather_correction(weather_diff, A.weather_latest(T.weather_scan(weather)), coefficients)
    by_ev = J.ev_correction(ev, ltf, V)
    annual = J.apply_to_annual(J.apply_to_annual(ltf, by_weather, "meteo", V), by_ev, "ev", V)
    monthly = J.apply_to_monthly(J.apply_to_monthly(stf, by_weather, "meteo", V), by_ev, "ev", V)
    return monthly, annual
