"""Queries over weather regressions, clusters and curve components."""

from pyspark.sql import Window as W, functions as F

from wattline import names as N
from wattline.catalog.registry import query
from wattline.catalog.short_term import KEYS, packed_regional, regional_monthly
from wattline.operators import clustering as C, neighbours as B, weather_regression as R

_X = R.X
_ROWS = ("wm as (select region, annee, mois, avg(apparent_temperature_min) as t, sum(precipitation_sum) as p, sum(et0_fao_evapotranspiration_sum) as e from weather "
         "group by 1, 2, 3), ob as (select c.region, c.activite, c.annee, c.mois, v, t, p, e from (select region, activite, annee, mois, sum(consommation_kwh) as v "
         "from cd group by 1, 2, 3, 4) c join wm on wm.region = c.region and wm.annee = c.annee and wm.mois = c.mois), sp as (select *, annee = max(annee) over "
         "(partition by region, activite) as is_test from ob)")


def _fit(source):
    return (f"mo as (select region, activite, count(*) as n, avg(v) as my, stddev_pop(v) as sy, avg(t) as m0, avg(p) as m1, avg(e) as m2, stddev_pop(t) as s0, "
            f"stddev_pop(p) as s1, stddev_pop(e) as s2, corr(t, v) as b0, corr(p, v) as b1, corr(e, v) as b2, corr(t, p) as r01, corr(t, e) as r02, corr(p, e) as "
            f"r12 from {source} group by 1, 2), de as (select *, 1 + 2 * r01 * r02 * r12 - r01 ** 2 - r02 ** 2 - r12 ** 2 as det from mo), so as (select *, ((1 - "
            "r12 ** 2) * b0 + (r02 * r12 - r01) * b1 + (r01 * r12 - r02) * b2) / det as z0, ((r02 * r12 - r01) * b0 + (1 - r02 ** 2) * b1 + (r01 * r02 - r12) * b2) "
            "/ det as z1, ((r01 * r12 - r02) * b0 + (r01 * r02 - r12) * b1 + (1 - r01 ** 2) * b2) / det as z2 from de), fi as (select *, z0 * sy / s0 as c0, z1 * "
            "sy / s1 as c1, z2 * sy / s2 as c2, my - z0 * sy / s0 * m0 - z1 * sy / s1 * m1 - z2 * sy / s2 * m2 as ic, z0 * b0 + z1 * b1 + z2 * b2 as r2 from so)")


def observations(t):
    """Monthly use per region and activity next to the region's monthly weather."""
    w = t.weather.groupBy(N.REGION, N.ANNEE, N.MOIS).agg(F.avg(_X[0]).alias(_X[0]), F.sum(_X[1]).alias(_X[1]), F.sum(_X[2]).alias(_X[2]))
    use = t.cd.groupBy(N.REGION, N.ACTIVITE, N.ANNEE, N.MOIS).agg(F.sum(N.CONSO).alias("v"))
    return use.join(w, [N.REGION, N.ANNEE, N.MOIS])


@query("weather_regression_g10", "region:s activite:s n:i coef_temperature_min:d coef_precipitation:d coef_et0:d implicit_intercept:d rmse:d mae:d r2:d adj_r2:d",
       "select fi.region, fi.activite, n, c0 as coef_temperature_min, c1 as coef_precipitation, c2 as coef_et0, ic as implicit_intercept, sqrt(avg((v - ic - c0 * t "
       "- c1 * p - c2 * e) ** 2)) as rmse, avg(abs(v - ic - c0 * t - c1 * p - c2 * e)) as mae, r2, 1 - n * (1 - r2) / (n - 3) as adj_r2 from fi join sp on "
       "sp.region = fi.region and sp.activite = fi.activite and sp.is_test group by 1, 2, 3, 4, 5, 6, 7, r2", "cd weather",
       _ROWS + ", " + _fit("sp where not is_test").replace("from sp where not is_test group", "from sp where not is_test group"), scale=4)
def _(t):
    return R.weather_regression(observations(t), KEYS, "v")


@query("single_feature_regression_g10", "region:s slope:d intercept:d r2:d",
       "select region, regr_slope(v, t) as slope, regr_intercept(v, t) as intercept, regr_r2(v, t) as r2 from ob group by 1", "cd weather", _ROWS, scale=4)
def _(t):
    o = observations(t)
    return o.groupBy(N.REGION).agg(F.regr_slope("v", _X[0]).alias("slope"), F.regr_intercept("v", _X[0]).alias("intercept"), F.regr_r2("v", _X[0]).alias("r2"))


@query("residual_tests_g11", "region:s activite:s durbin_watson:d skew:d kurtosis:d jarque_bera:d log_likelihood:d aic:d bic:d f_statistic:d",
       "select region, activite, sum(d * d) / sum(e * e) as durbin_watson, m3 as skew, m4 as kurtosis, n / 6 * (m3 ** 2 + (m4 - 3) ** 2 / 4) as jarque_bera, -n / 2 * "
       "(ln(2 * pi()) + 1 + ln(sum(e * e) / n)) as log_likelihood, n * (ln(2 * pi()) + 1 + ln(sum(e * e) / n)) + 6 as aic, n * (ln(2 * pi()) + 1 + ln(sum(e * e) / n)) "
       "+ 3 * ln(n) as bic, r2 / 3 / ((1 - r2) / (n - 3)) as f_statistic from (select *, e - lag(e) over (partition by region, activite order by annee, mois) as d, "
       "avg(c ** 3) over (partition by region, activite) / power(avg(c ** 2) over (partition by region, activite), 1.5) as m3, avg(c ** 4) over (partition by "
       "region, activite) / power(avg(c ** 2) over (partition by region, activite), 2) as m4 from (select *, e - avg(e) over (partition by region, activite) as c "
       "from (select sp.region, sp.activite, sp.annee, sp.mois, n, r2, (v - ic - c0 * t - c1 * p - c2 * sp.e) / sy as e from sp join fi on fi.region = sp.region and "
       "fi.activite = sp.activite where not is_test) a) b) q group by region, activite, n, r2, m3, m4", "cd weather",
       _ROWS + ", " + _fit("sp where not is_test"), scale=5)
def _(t):
    return R.residual_tests(observations(t), KEYS, "v")


for _name, _l1 in (("ridge_regression_g12", 0.0), ("lasso_regression_g12", 1.0), ("elastic_net_regression_g12", 0.5)):
    query(_name, "region:s activite:s scaled_coef_temperature_min:d scaled_coef_precipitation:d scaled_coef_et0:d")(
        lambda t, l1=_l1: R.elastic_net_by_group(observations(t), KEYS, "v", 0.05, l1))


@query("pooled_elastic_net_g12", "coef_temperature_min:d coef_precipitation:d coef_et0:d implicit_intercept:d")
def _(t):
    return R.pooled_elastic_net(observations(t), "v", 0.05, 0.5)


@query("regional_weather_models_g13", "region:s n:i coef_temperature_min:d coef_precipitation:d coef_et0:d",
       "select region, n, c0 as coef_temperature_min, c1 as coef_precipitation, c2 as coef_et0 from fi", "cd weather",
       _ROWS + ", ra as (select region, 'x' as activite, annee, mois, sum(v) as v, max(t) as t, max(p) as p, max(e) as e from ob group by 1, 3, 4), " + _fit("ra"), scale=4)
def _(t):
    o = observations(t).groupBy(N.REGION, N.ANNEE, N.MOIS).agg(F.sum("v").alias("v"), *[F.max(x).alias(x) for x in _X])
    return R.regional_models(o, N.REGION, "v")


@query("kmeans_sweep_g14", "k:i silhouette:d")
def _(t):
    years = range(1995, 2002)
    return C.kmeans_sweep(C.yearly_columns(t.cd, N.CONTRAT, N.CONSO, years), [f"y{y}" for y in years])


@query("mixed_clusters_g15", "contrat:i activite:s cluster:i")
def _(t):
    return C.mixed_clusters(B.power_profiles(t.cd, 2000), N.ACTIVITE, B.DIMS)


@query("curve_mean_g16", "region:s activite:s mois:i valeur:d",
       "select region, activite, mois, avg(v) as valeur from (select region, activite, annee, mois, sum(consommation_kwh) as v from cd where annee < 2001 group by 1, "
       "2, 3, 4 union all select region, 'Total', annee, mois, sum(consommation_kwh) from cd where annee < 2001 group by 1, 3, 4) x where (region, activite) in "
       "(select (region, activite) from (select region, activite, annee from (select distinct region, activite, annee, mois from cd where annee < 2001 union select "
       "distinct region, 'Total', annee, mois from cd where annee < 2001) y group by 1, 2, 3 having count(*) = 12) z group by region, activite having count(*) = 6) "
       "group by 1, 2, 3", "cd", scale=3)
def _(t):
    return C.curve_components(packed_regional(t), KEYS).filter("composante = 'mean'")


@query("curve_components_g16", "region:s activite:s composante:s mois:i valeur:d part_variance:d")
def _(t):
    return C.curve_components(packed_regional(t), KEYS)


@query("component_scores_g16", "region:s activite:s annee:i composante:s score:d")
def _(t):
    w = W.partitionBy(*KEYS, N.MOIS)
    sd = F.stddev_pop("v").over(w)
    z = regional_monthly(t).withColumn("z", (F.col("v") - F.avg("v").over(w)) / F.when(sd == 0, 1.0).otherwise(sd))
    return C.component_scores(z, C.curve_components(packed_regional(t), KEYS), KEYS)


_SENS = _ROWS + ", " + _fit("sp where not is_test")


@query("sensitivity_by_activity_g17", "activite:s coef_temperature_min:d coef_precipitation:d coef_et0:d sensitivity:d r2:d",
       "select activite, avg(c0) as coef_temperature_min, avg(c1) as coef_precipitation, avg(c2) as coef_et0, (avg(abs(c0)) + avg(abs(c1)) + avg(abs(c2))) / 3 as "
       "sensitivity, avg(r2) as r2 from fi group by 1", "cd weather", _SENS, scale=4)
def _(t):
    return R.sensitivity_by(R.weather_regression(observations(t), KEYS, "v"), [N.ACTIVITE])


@query("sensitivity_by_region_g17", "region:s sensitivity:d r2:d",
       "select region, (avg(abs(c0)) + avg(abs(c1)) + avg(abs(c2))) / 3 as sensitivity, avg(r2) as r2 from fi group by 1", "cd weather", _SENS, scale=4)
def _(t):
    return R.sensitivity_by(R.weather_regression(observations(t), KEYS, "v"), [N.REGION])


@query("sensitivity_long_g17", "region:s activite:s feature:s coefficient:d",
       "select region, activite, 'coef_temperature_min' as feature, c0 as coefficient from fi union all select region, activite, 'coef_precipitation', c1 from fi union "
       "all select region, activite, 'coef_et0', c2 from fi", "cd weather", _SENS, scale=4)
def _(t):
    return R.sensitivity_long(R.weather_regression(observations(t), KEYS, "v"), KEYS)


@query("coefficient_correlation_g17", "a:s b:s correlation:d",
       "select 'coef_temperature_min' as a, 'coef_precipitation' as b, corr(c0, c1) as correlation from fi union all select 'coef_temperature_min', 'coef_et0', "
       "corr(c0, c2) from fi union all select 'coef_precipitation', 'coef_et0', corr(c1, c2) from fi", "cd weather", _SENS, scale=6)
def _(t):
    from wattline.operators.correlation import correlation_matrix

    return correlation_matrix(R.weather_regression(observations(t), KEYS, "v"), list(R.COEF.values()))


@query("trimmed_f_statistics_g17", "region:s activite:s f_statistic:d",
       "select region, activite, f as f_statistic from (select region, activite, r2 / 3 / ((1 - r2) / (n - 3)) as f from fi) x where f < (select quantile_cont(r2 / 3 / "
       "((1 - r2) / (n - 3)), 0.95) from fi)", "cd weather", _SENS, scale=5)
def _(t):
    from wattline.operators.quantiles import exact_quantiles

    tests = R.residual_tests(observations(t), KEYS, "v")
    cut = exact_quantiles(tests, [], "f_statistic", [0.95])
    return tests.crossJoin(F.broadcast(cut)).filter(F.col("f_statistic") < F.col("q0"))
