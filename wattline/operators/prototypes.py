"""Clusters over a category and numbers at once: means for the numbers, the commonest value for the category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattline.session import materialize

MAX_ROUNDS = 100  # fixed value: the source programs' solver default; runs stop earlier when nothing moves


def standardised(rows: DataFrame, key: str, category: str, cols) -> DataFrame:
    """(key, category, x): numbers as an array of standardised doubles; nulls and constant columns are 0."""
    stats = rows.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("_m", F.avg), ("_s", F.stddev_pop))])
    one = F.broadcast(stats)  # one row

    def scaled(i, c):
        deviation = F.when(F.col(f"_s_{i}") > 0, F.col(f"_s_{i}"))
        return F.coalesce((F.col(c).cast("double") - F.col(f"_m_{i}")) / deviation, F.lit(0.0))

    return rows.crossJoin(one).select(F.col(key), F.col(category), F.array(*[scaled(i, c) for i, c in enumerate(cols)]).alias("x"))


def starting_prototypes(data: DataFrame, key: str, category: str, k: int) -> list[tuple[list[float], str | None]]:
    """Of the distinct (category, numbers) the k with the least hash: k rows on the driver."""
    distinct = data.groupBy(category, "x").agg(F.min(key).alias("_k"))
    rows = distinct.orderBy(F.xxhash64(F.col("_k").cast("string")), "_k").limit(k).collect()
    return [(list(r["x"]), r[category]) for r in rows]


def assigned(data: DataFrame, category: str, prototypes, gamma: float) -> DataFrame:
    """Adds ``cluster`` and ``cost``: the nearest prototype, the first one on ties. A null category equals only null."""
    def cost(numbers, kind) -> Column:
        centre = F.array(*[F.lit(float(v)) for v in numbers])
        squares = F.aggregate(F.zip_with("x", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        return squares + F.when(F.col(category).eqNullSafe(F.lit(kind)), 0.0).otherwise(float(gamma))

    best = F.array_min(F.array(*[F.struct(cost(*p).alias("cost"), F.lit(i).alias("cluster")) for i, p in enumerate(prototypes)]))
    return data.withColumn("_b", best).select(*data.columns, "_b.cluster", "_b.cost")


def k_prototypes(rows: DataFrame, key: str, category: str, cols, k: int = 6, gamma: float = 0.5, rounds: int = MAX_ROUNDS):
    """``(clusters, costs)``: (key, category, cluster, cost) of every row and the total cost of each round.

    Distance: squared difference of the standardised numbers plus ``gamma`` for another category. Each round is one pass that
    assigns and folds counts and sums by (cluster, category) before the shuffle; the driver gets k prototypes. Rounds end when
    the cost no longer falls. A cluster that loses all rows keeps its prototype; with fewer than k distinct rows there are
    fewer clusters; an empty table gives no rows and no costs. Of equally common categories the least one is taken, null first.
    """
    data = materialize(standardised(rows, key, category, cols), "standardised")
    prototypes = starting_prototypes(data, key, category, k)
    if not prototypes:
        return data.select(key, category, F.lit(0).alias("cluster"), F.lit(0.0).alias("cost")), []
    costs: list[float] = []
    for _ in range(rounds):
        sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(len(cols))]
        by_kind = assigned(data, category, prototypes, gamma).groupBy("cluster", category).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), *sums)
        commonest = F.min(F.struct((-F.col("n")).alias("n"), F.col(category).alias("kind")))
        found = by_kind.groupBy("cluster").agg(
            F.sum("cost").alias("cost"), commonest["kind"].alias("kind"),
            F.array(*[F.sum(f"s{i}") / F.sum("n") for i in range(len(cols))]).alias("x")).collect()
        costs.append(sum(r["cost"] for r in found))
        if len(costs) > 1 and costs[-1] >= costs[-2] * (1 - 1e-12):
            break
        last = prototypes
        prototypes = list(last)
        for r in found:
            prototypes[r["cluster"]] = (list(r["x"]), r["kind"])
        if prototypes == last:
            break
    return assigned(data, category, prototypes, gamma).select(key, category, "cluster", "cost"), costs
