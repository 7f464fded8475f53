"""The queries whose history ends at a fixed year, once more with histories that end where the data do.

Bodies, columns and SQL are those of the queries named; only the last year is read from the orders, on both sides.
"""

from wattline import names as N
from wattline.catalog.registry import DEFINITIONS, query
from wattline.operators import clustering as C, neighbours as B
from wattline.operators.prototypes import k_prototypes
from wattline.sources.fixtures import WholeYears

_NEXT = "(select y from ly)"


def _again(name: str, new_name: str, replaced=(), renamed=()):
    """Register ``name`` on whole years; ``replaced`` are years in its SQL, ``renamed`` columns that carry one in their name."""
    old = DEFINITIONS[name]
    cols, parts = old["cols"], {k: old[k] for k in ("sql", "ctes")}
    for k, text in parts.items():
        if text is not None:
            for a, b in (("cd where annee < 2001", "cw"), *replaced, *renamed):
                text = text.replace(a, b)
            parts[k] = text
    for a, b in renamed:
        cols = cols.replace(a, b)

    def body(t):
        df = old["fn"](t)
        for a, b in renamed:
            df = df.withColumnRenamed(a, b)
        return df

    views = f"{old['views']} cw" if old["sql"] else ""
    query(new_name, cols, parts["sql"], views, parts["ctes"], old["scale"], old["recursive"], WholeYears)(body)


_again("rolling_folds_h01", "rolling_folds_whole_h01")
_again("rolling_folds_window_h01", "rolling_folds_window_whole_h01")
_again("growth_backtest_h08", "growth_backtest_whole_h08")
_again("mean_reverting_growth_h10", "mean_reverting_growth_whole_h10")
_again("growth_horizon_h11", "growth_horizon_whole_h11")
_again("linear_trend_h12", "linear_trend_whole_h12", [("2001 -", f"{_NEXT} + 1 -")], [("forecast_2001", "forecast_next")])
_again("linear_trend_forecast_h12", "linear_trend_forecast_whole_h12", [("2001", f"({_NEXT} + 1)")])
_again("power_trend_h13", "power_trend_whole_h13", [("2003 -", f"{_NEXT} + 3 -")], [("forecast_2003", "forecast_third")])
_again("flat_trends_h14", "flat_trends_whole_h14")
_again("zero_trend_h15", "zero_trend_whole_h15")
_again("consensus_trend_h16", "consensus_trend_whole_h16", [
    ("(y - 2000)", f"(y - {_NEXT})"), ("y - 1995 + 1", "y - (select min(annee) from cd) + 1"), ("annee = 2000", f"annee = {_NEXT}"),
    ("range(2001, 2006) ys(y)", f"(select unnest(range({_NEXT} + 1, {_NEXT} + 6)) as y) ys")])
_again("intensity_forecast_h19", "intensity_forecast_whole_h19")
_again("long_term_search_h20", "long_term_search_whole_h20")
_again("long_term_monthly_h20", "long_term_monthly_whole_h20")
_again("autoregression_orders_h28", "autoregression_orders_whole_h28")
_again("packed_series_h30", "packed_series_whole_h30")
_again("short_term_selection_h30", "short_term_selection_whole_h30")
_again("short_term_intervals_h30", "short_term_intervals_whole_h30")
_again("correlated_pairs_g08", "correlated_pairs_whole_g08")
_again("curve_mean_g16", "curve_mean_whole_g16", [("having count(*) = 6)", "having count(*) = (select count(distinct annee) from cw))")])
_again("curve_components_g16", "curve_components_whole_g16")
_again("component_scores_g16", "component_scores_whole_g16")
_again("short_term_regional_j01", "short_term_regional_whole_j01")


@query("kmeans_sweep_whole_g14", "k:i silhouette:d", tables=WholeYears)
def _(t):
    t = t.kept()
    first = t.history.agg({N.ANNEE: "min"}).first()[0]
    years = range(first, t.last_year + 1)
    return C.kmeans_sweep(C.yearly_columns(t.history, N.CONTRAT, N.CONSO, years), [f"y{y}" for y in years])


@query("prototype_clusters_g15", "contrat:i activite:s cluster:i cost:d", tables=WholeYears)
def _(t):
    return k_prototypes(B.power_profiles(t.history, t.last_year), N.CONTRAT, N.ACTIVITE, B.DIMS)[0]
