"""Queries over the native trend and growth models."""

from pyspark.sql import functions as F

from wattline import names as N
from wattline.catalog.registry import query
from wattline.functions import series as S
from wattline.models import trend as T
from wattline.operators import metrics as M, rules as R

RY = "ry as (select region, annee, sum(consommation_kwh) as v from cd where annee < 2001 group by 1, 2)"
KEY = [N.REGION]


def regional_annual(t):
    return t.history.groupBy(N.REGION, N.ANNEE).agg(F.sum(N.CONSO).alias("v"))


_FOLD = (", fo as (select te.region, te.annee as test_annee, te.v as actual, tr.annee, tr.v as train, row_number() over (partition by te.region, te.annee "
         "order by tr.annee desc) as r, count(*) over (partition by te.region, te.annee) as n from ry te join ry tr on tr.region = te.region and tr.annee < "
         "te.annee)")


@query("rolling_folds_h01", "region:s test_annee:i actual:d annee:i train:d",
       "select * from fo where n >= 3", "cd", RY + _FOLD, scale=2)
def _(t):
    return T.rolling_folds(regional_annual(t), KEY, "v", min_train=3)


@query("rolling_folds_window_h01", "region:s test_annee:i annee:i train:d",
       "select * from fo where r <= 3 and n >= 3", "cd", RY + _FOLD, scale=2)
def _(t):
    return T.rolling_folds(regional_annual(t), KEY, "v", min_train=3, window=3)


@query("config_grid_h02", "region:s ordinal:i n_lags:i block:s lam:d",
       "select k.region, (i - 1) * 6 + (j - 1) * 3 + (l - 1) as ordinal, i as n_lags, case j when 1 then 'none' else 'gdp' end as block, case l when 1 then 0.5 "
       "when 2 then 0.7 else 0.9 end as lam from (select distinct region from ry) k cross join range(1, 3) a(i) cross join range(1, 3) b(j) cross join "
       "range(1, 4) c(l)", "cd", RY)
def _(t):
    grid = T.config_grid(t.spark, n_lags=[1, 2], block=["none", "gdp"], lam=[0.5, 0.7, 0.9])
    return regional_annual(t).select(N.REGION).distinct().crossJoin(F.broadcast(grid))


_LIN = (", rk as (select *, row_number() over (partition by region order by annee desc) as r, annee - min(annee) over (partition by region) + 1.0 as t from ry)"
        ", lin as (select region, regr_slope(v, annee) as s, avg(v) filter (where r <= 3) as ay, avg(annee) filter (where r <= 3) as ax from rk group by 1)")


@query("linear_trend_h12", "region:s raw_slope:d slope:d intercept:d forecast_2001:d",
       "select region, s as raw_slope, greatest(s, 0.02) as slope, ay - greatest(s, 0.02) * ax as intercept, ay + greatest(s, 0.02) * (2001 - ax) as "
       "forecast_2001 from lin", "cd", RY + _LIN, scale=2)
def _(t):
    fit = T.linear_trend(regional_annual(t), KEY, "v", 0.02, 3)
    return fit.withColumn("forecast_2001", T.trend_at(fit, F.lit(t.last_year + 1)))


_CV = ("mc as (select region, mois, avg(v) / sum(avg(v)) over (partition by region) as part from (select region, annee, mois, sum(consommation_kwh) as v from "
       "cd where annee < 2001 group by 1, 2, 3) m group by 1, 2), bt as (select region, test_annee, max(actual) as actual, avg(train) filter (where r <= 3) + "
       "greatest(regr_slope(train, annee), 0.02) * (test_annee - avg(annee) filter (where r <= 3)) as prediction from fo where n >= 3 group by 1, 2), me as "
       "(select region, avg(abs(actual - prediction)) as annual_mae, avg(abs((actual - prediction) / actual)) * 100 as annual_mape, case when var_pop(actual) "
       "> 0 then 1 - sum((actual - prediction) ** 2) / (count(*) * var_pop(actual)) end as annual_r2 from bt group by 1)")


def linear_forecast(t):
    """Monthly regional series to a back-tested next-year forecast, natively end to end."""
    monthly = t.history.groupBy(N.REGION, N.ANNEE, N.MOIS).agg(F.sum(N.CONSO).alias("v"))
    annual = monthly.groupBy(N.REGION, N.ANNEE).agg(F.sum("v").alias("v"))
    folds = T.rolling_folds(annual, KEY, "v", min_train=3)
    fold_keys = [N.REGION, "test_annee"]
    fits = T.linear_trend(folds, fold_keys, "train", 0.02, 3)
    tested = folds.groupBy(*fold_keys).agg(F.max("actual").alias("actual")).join(fits, fold_keys)
    errors = M.annual_metrics(tested.withColumn("prediction", T.trend_at(tested, F.col("test_annee"))), KEY)
    fit = T.linear_trend(annual, KEY, "v", 0.02, 3)
    nxt = fit.select(N.REGION, (F.col("last_year") + 1).alias(N.ANNEE), T.trend_at(fit, F.col("last_year") + 1).alias("consommation"))
    return R.monthly_from_annual(nxt, S.mean_curve(monthly, KEY, "v"), KEY).join(errors, KEY)


@query("linear_trend_forecast_h12", "region:s annee:i mois:i consommation:d annual_mae:d annual_mape:d annual_r2:d",
       "select lin.region, 2001 as annee, mois, (ay + greatest(s, 0.02) * (2001 - ax)) * part as consommation, annual_mae, annual_mape, annual_r2 from lin join "
       "mc on mc.region = lin.region join me on me.region = lin.region", "cd", RY + _LIN + _FOLD + ", " + _CV, scale=3)
def _(t):
    return linear_forecast(t)


@query("power_trend_h13", "region:s slope:d intercept:d forecast_2003:d",
       "select region, s as slope, ay - s * ax as intercept, ay - s * ax + s * sqrt(2003 - first + 1) as forecast_2003 from (select region, regr_slope(v, "
       "sqrt(t)) as s, avg(v) filter (where r <= 3) as ay, avg(sqrt(t)) filter (where r <= 3) as ax, min(annee) as first from rk group by 1) x", "cd",
       RY + _LIN, scale=2)
def _(t):
    fit = T.power_trend(regional_annual(t), KEY, "v", 0.5, None, 3)
    return fit.withColumn("forecast_2003", T.trend_at(fit, F.lit(t.last_year + 3), power=0.5))


@query("flat_trends_h14", "region:s mean:d median:d last:d mean3:d",
       "select region, avg(v) as mean, median(v) as median, arg_max(v, annee) as last, avg(v) filter (where r <= 3) as mean3 from rk group by 1", "cd", RY + _LIN,
       scale=5)
def _(t):
    a = regional_annual(t)
    out = T.flat_trend(a, KEY, "v", "mean").withColumnRenamed("level", "mean")
    for name, how, window in (("median", "median", None), ("last", "last", None), ("mean3", "mean", 3)):
        out = out.join(T.flat_trend(a, KEY, "v", how, window).withColumnRenamed("level", name), KEY)
    return out


@query("zero_trend_h15", "region:s level:d", "select distinct region, 0.0 as level from ry", "cd", RY)
def _(t):
    return T.zero_trend(regional_annual(t), KEY)


_CONS = (", dr as (select region, annee, count(distinct contrat) as d from cd group by 1, 2), w as (select rk.*, d, power(0.9, r - 1) as w, sqrt(t) as x from rk "
         "join dr on dr.region = rk.region and dr.annee = rk.annee), f as (select region, (sum(w) * sum(w * x * v) - sum(w * x) * sum(w * v)) / (sum(w) * "
         "sum(w * x * x) - sum(w * x) * sum(w * x)) as s, stddev_pop(v) / stddev_pop(d) as k, avg(v) filter (where r <= 3) as ay, avg(x) filter (where r <= 3) "
         "as ax, min(annee) as first from w group by 1), p as (select region, regr_slope(d * (1 + 0.1 * (y - 2000)), sqrt(y - 1995 + 1)) as p from dr cross join "
         "range(2001, 2006) ys(y) where annee = 2000 group by 1)")


def _driver(t):
    d = t.cd.select(N.REGION, N.ANNEE, N.CONTRAT).distinct().groupBy(N.REGION, N.ANNEE).agg(F.count(F.lit(1)).alias("d"))
    years = F.explode(F.sequence(F.lit(t.last_year + 1), F.lit(t.last_year + 5)).cast("array<bigint>"))
    future = d.filter(F.col(N.ANNEE) == t.last_year).select(N.REGION, "d", years.alias(N.ANNEE)).withColumn(
        "d", F.col("d") * (1 + 0.1 * (F.col(N.ANNEE) - t.last_year)))
    return d, future


@query("consensus_trend_h16", "region:s slope_hist:d slope:d intercept:d",
       "select f.region, s as slope_hist, s * 0.7 + p * k * 0.3 as slope, ay - (s * 0.7 + p * k * 0.3) * ax as intercept from f join p on p.region = f.region",
       "cd", RY + _LIN + _CONS, scale=2)
def _(t):
    d, future = _driver(t)
    return T.consensus_trend(regional_annual(t).join(d, [N.REGION, N.ANNEE]), future, KEY, "v", "d", 0.5, 0.9, 0.3)


@query("outlier_flags_h17", "contrat:i annee:i robust_z:d is_outlier:b noise_factor:d",
       "select contrat, annee, case when mad > 0 then 0.6745 * (v - med) / mad end as robust_z, coalesce(case when mad > 0 then abs(0.6745 * (v - med) / mad) > "
       "3.5 end, false) as is_outlier, case when mad > 0 and abs(0.6745 * (v - med) / mad) > 3.5 then 10000 else 1 end as noise_factor from (select contrat, "
       "annee, v, med, median(abs(v - med)) over (partition by contrat) as mad from (select contrat, annee, v, median(v) over (partition by contrat) as med "
       "from (select contrat, annee, sum(consommation_kwh) as v from cd group by 1, 2) a) b) c", "cd", scale=5)
def _(t):
    yearly = t.cd.groupBy(N.CONTRAT, N.ANNEE).agg(F.sum(N.CONSO).alias("v"))
    return T.outlier_flags(yearly, [N.CONTRAT], "v")


GROWTH_SQL = (", g0 as (select contrat, annee, v, ln(v) - ln(lag(v) over (partition by contrat order by annee)) as y from ky), g1 as (select *, lag(y) over "
              "(partition by contrat order by annee) as x from g0), mo as (select contrat, count(*) filter (where x is not null and y is not null) as n, sum(x) "
              "filter (where y is not null) as sx, sum(y) filter (where x is not null) as sy, sum(x * x) filter (where y is not null) as sxx, sum(x * y) as sxy, "
              "sum(y * y) filter (where x is not null) as syy, arg_max(v, annee) as last_y, arg_max(y, annee) as last_growth, max(annee) as last_year from g1 "
              "group by 1), ol as (select *, case when n * sxx - sx * sx <> 0 then (n * sxy - sx * sy) / (n * sxx - sx * sx) end as r from mo where n >= 1), ca as "
              "(select contrat, 0 as o, r as rho, (sy - r * sx) / n as c from ol where n > 1 and r between 0 and 1 and sy - r * sx >= 0 union all select contrat, "
              "1, 0, greatest(0, sy / n) from ol where n > 1 union all select contrat, 2, 1, greatest(0, (sy - sx) / n) from ol where n > 1 union all select "
              "contrat, 3, case when sxx > 0 then greatest(0, least(1, sxy / sxx)) else 0 end, 0 from ol where n > 1 union all select contrat, 4, 0.5, "
              "greatest(0, sy - 0.5 * sx) from ol where n = 1), fit as (select * from (select ol.*, ca.rho, ca.c, row_number() over (partition by ol.contrat order "
              "by round(syy + n * c * c + rho * rho * sxx - 2 * c * sy - 2 * rho * sxy + 2 * c * rho * sx, 14), o) as k from ol join ca on ca.contrat = "
              "ol.contrat) z where k = 1)")
_KY = "ky as (select contrat, annee, sum(consommation_kwh) as v from cd where annee < 2001 group by 1, 2)"


def contract_annual(t):
    return t.history.groupBy(N.CONTRAT, N.ANNEE).agg(F.sum(N.CONSO).alias("v"))


@query("mean_reverting_growth_h10", "contrat:i rho:d drift:d prediction:d",
       "select contrat, rho, c as drift, last_y * exp(c + rho * last_growth) as prediction from fit", "cd", _KY + GROWTH_SQL, scale=3)
def _(t):
    return T.mean_reverting_growth(contract_annual(t), [N.CONTRAT], "v").withColumn("prediction", T.next_level())


# Every pattern of error signs of a contract gives one weighted problem; the least true loss among their solutions is the optimum.
ASYMMETRIC_SQL = (GROWTH_SQL + ", pr as (select contrat, x, y, row_number() over (partition by contrat order by annee) - 1 as i from g1 where x is not null and y is "
                  "not null), pa as (select contrat, unnest(range(cast(pow(2, n) as bigint))) as b from mo where n > 1), wp as (select pa.contrat, b, x, y, case when "
                  "(b >> i) & 1 = 1 then 2.0 else 1.0 end as w from pa join pr on pr.contrat = pa.contrat), ws as (select contrat, b, sum(w) as n, sum(w * x) as sx, "
                  "sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy from wp group by 1, 2), wo as (select *, case when n * sxx - sx * sx <> 0 then "
                  "(n * sxy - sx * sy) / (n * sxx - sx * sx) end as r from ws), wc as (select contrat, r as rho, (sy - r * sx) / n as c from wo where r between 0 and 1 "
                  "and sy - r * sx >= 0 union select contrat, 0, greatest(0, sy / n) from wo union select contrat, 1, greatest(0, (sy - sx) / n) from wo union select "
                  "contrat, case when sxx > 0 then greatest(0, least(1, sxy / sxx)) else 0 end, 0 from wo), wl as (select wc.contrat, rho, c, sum(case when y > c + rho "
                  "* x then 2.0 else 1.0 end * (y - c - rho * x) ** 2) as loss from wc join pr on pr.contrat = wc.contrat group by 1, 2, 3), af as (select contrat, "
                  "arg_min(rho, loss) as rho, arg_min(c, loss) as c from wl group by 1 union all select contrat, 0.5, greatest(0, sy - 0.5 * sx) from mo where n = 1)")


@query("asymmetric_growth_h10", "contrat:i rho:d drift:d log_prediction:d",
       "select af.contrat, af.rho, af.c as drift, ln(last_y) + af.c + af.rho * last_growth as log_prediction from af join mo on mo.contrat = af.contrat", "cd",
       _KY + ASYMMETRIC_SQL, scale=5)
def _(t):
    fit = T.asymmetric_growth(contract_annual(t), [N.CONTRAT], "v", penalty=2.0)
    return fit.withColumn("log_prediction", F.ln("last_y") + T.growth_step(F.col("last_growth")))


@query("growth_horizon_h11", "contrat:i annee:i log_prediction:d",
       "select contrat, annee, ln(y) as log_prediction from st where h > 0", "cd", _KY + GROWTH_SQL + ", st as (select contrat, 0 as h, last_year as annee, last_growth as "
       "g, last_y as y, rho, c from fit union all select contrat, h + 1, annee + 1, c + rho * g, y * exp(c + rho * g), rho, c from st where h < 5)",
       scale=7, recursive=True)
def _(t):
    rows = T.growth_horizon(T.mean_reverting_growth(contract_annual(t), [N.CONTRAT], "v"), [N.CONTRAT], 5)
    return rows.withColumn("log_prediction", F.ln("prediction"))


@query("growth_backtest_h08", "region:s activite:s test_annee:i actual:d prediction:d",
       "select split_part(contrat, '|', 1) as region, split_part(split_part(contrat, '|', 2), '#', 1) as activite, cast(split_part(contrat, '#', 2) as bigint) as "
       "test_annee, actual, last_y * exp(c + rho * last_growth) as prediction from fit join (select distinct k, actual from fd) a on a.k = fit.contrat", "cd",
       "ra as (select region, activite, annee, sum(consommation_kwh) as v from cd where annee < 2001 group by 1, 2, 3), fd as (select te.region || '|' || "
       "te.activite || '#' || te.annee as k, te.v as actual, tr.annee, tr.v, count(*) over (partition by te.region, te.activite, te.annee) as n from ra te join "
       "ra tr on tr.region = te.region and tr.activite = te.activite and tr.annee < te.annee), ky as (select k as contrat, annee, v from fd where n >= 3)"
       + GROWTH_SQL, scale=2)
def _(t):
    keys = [N.REGION, N.ACTIVITE]
    annual = t.history.groupBy(*keys, N.ANNEE).agg(F.sum(N.CONSO).alias("v"))
    folds = T.rolling_folds(annual, keys, "v", min_train=3)
    fits = T.mean_reverting_growth(folds, [*keys, "test_annee"], "train")
    actual = folds.groupBy(*keys, "test_annee").agg(F.max("actual").alias("actual"))
    return actual.join(fits, [*keys, "test_annee"]).withColumn("prediction", T.next_level())
