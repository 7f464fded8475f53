"""Power by tariff rows: optional, super-peak and general tariffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattline import names as N

# Line labels of the source sheet and the weight of each tariff band.
LINE_TYPES = {
    "Puis Sous HP -Tarif Opt": "HP",
    "Puis Sous HPL -Tarif Opt": "HPL",
    "Puis Sous HC -Tarif Opt": "HC",
    "Puis Sous HSP -Tarif Sup pointe": "HSP",
    "Puis Sous -Tarif Gén": "GEN",
}
OPTIONAL = {"HP": 0.4, "HPL": 0.2, "HC": 0.4}
SUPER_PEAK = {"HSP": 0.2, "HP": 0.2, "HPL": 0.2, "HC": 0.4}
OPTIONAL_LABEL, SUPER_PEAK_LABEL, GENERAL_LABEL = "Tarif optionnel", "Tarif super pointe", "Tarif gén"


def line_codes(rows: DataFrame, label: str = "type_ligne") -> DataFrame:
    """Short code of each line label; an unknown label fails the job."""
    code = F.lit(None).cast("string")
    for text, short in LINE_TYPES.items():
        code = F.when(F.col(label) == text, F.lit(short)).otherwise(code)
    checked = F.coalesce(code, F.raise_error(F.concat(F.lit("unknown line type: "), F.coalesce(label, F.lit("null")))).cast("string"))
    return rows.withColumn("ligne", checked)


def _weighted(weights):
    terms = [F.lit(w) * F.col(t) for t, w in weights.items()]
    total = terms[0]
    for x in terms[1:]:
        total = total + x
    return total


def _rising(weights):
    names = list(weights)
    ok = F.lit(True)
    for a, b in zip(names, names[1:]):
        ok = ok & (F.col(a) <= F.col(b))
    return ok


def billed_power(rows: DataFrame, value: str = "valeur") -> DataFrame:
    """Billed power per contract and month from coded rows, with tariff label and warnings.

    The tariff comes from the lines the contract has at all; an unknown set of lines fails the job.
    """
    keys = [N.CONTRAT, N.ANNEE, N.MOIS]
    coded = line_codes(rows)
    tariff = coded.groupBy(N.CONTRAT).agg(F.array_sort(F.collect_set("ligne")).alias("lignes"))
    types = ("HSP", "HP", "HPL", "HC")
    monthly = coded.groupBy(*keys).agg(*[F.max(F.when(F.col("ligne") == x, F.col(value))).alias(x) for x in types],
                                       F.avg(value).alias("moyenne"))

    def has(weights):
        return F.col("lignes") == F.array(*[F.lit(x) for x in sorted(weights)])

    general = F.array_contains("lignes", "GEN")
    label = (F.when(general, GENERAL_LABEL).when(has(OPTIONAL), OPTIONAL_LABEL).when(has(SUPER_PEAK), SUPER_PEAK_LABEL)
             .otherwise(F.raise_error(F.concat(F.lit("invalid line set: "), F.array_join("lignes", ","))).cast("string")))

    def note(weights):
        return F.when(_weighted(weights).isNull(), "missing_band").when(~_rising(weights), "not_rising")

    is_opt, is_sup = F.col("tarif") == OPTIONAL_LABEL, F.col("tarif") == SUPER_PEAK_LABEL
    power = F.when(is_opt, _weighted(OPTIONAL)).when(is_sup, _weighted(SUPER_PEAK)).otherwise(F.col("moyenne"))
    warning = F.when(is_opt, note(OPTIONAL)).when(is_sup, note(SUPER_PEAK)).when(
        F.size("lignes") > 1, "general_line_wins")
    return (monthly.join(tariff, N.CONTRAT).withColumn("tarif", label)
            .select(*keys, "tarif", power.alias(N.PF), F.coalesce(warning, F.lit("")).alias("avertissement")))


def called_power(wide: DataFrame) -> DataFrame:
    """Called power per contract and month from columns HSP, HP, HPL, HC; the fuller band set wins."""
    hsp, hp, hpl, hc = (F.col(x) for x in ("HSP", "HP", "HPL", "HC"))
    optional = hp + 0.6 * (hpl - hp) + 0.4 * (hc - hpl)
    super_peak = hsp + 0.8 * (hp - hsp) + 0.6 * (hpl - hp) + 0.4 * (hc - hpl)
    return wide.withColumn(N.PA, F.coalesce(super_peak, optional))
