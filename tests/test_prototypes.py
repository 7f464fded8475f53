"""k-prototypes against plain loops."""

from collections import Counter

import numpy as np
import pytest

from wattline.operators import prototypes as P

COLS = ["a", "b"]
SCHEMA = "id bigint, kind string, a double, b double"


def rows():
    rng = np.random.default_rng(5)
    made = []
    for i in range(90):
        g = i % 3
        made.append((i, "uvw"[g] if rng.random() < 0.9 else None, float(rng.normal(6 * g, 1)), float(rng.normal(-4 * g, 1))))
    return made


def plain(points, kinds, start, gamma, rounds=100):
    protos, costs = list(start), []

    def nearest(x, c):
        return min((float(((x - np.array(p)) ** 2).sum()) + (0.0 if c == m else gamma), i) for i, (p, m) in enumerate(protos))

    for _ in range(rounds):
        best = [nearest(x, c) for x, c in zip(points, kinds)]
        costs.append(sum(b[0] for b in best))
        if len(costs) > 1 and costs[-1] >= costs[-2] * (1 - 1e-12):
            break
        before = list(protos)
        for i in range(len(protos)):
            mine = [j for j, b in enumerate(best) if b[1] == i]
            if mine:
                tally = Counter(kinds[j] for j in mine)
                mode = min(tally, key=lambda v: (-tally[v], v is not None, v or ""))
                protos[i] = (list(np.mean([points[j] for j in mine], axis=0)), mode)
        if before == protos:
            break
    return [nearest(x, c)[1] for x, c in zip(points, kinds)], costs


@pytest.mark.parametrize("gamma", [0.5, 3.0])
def test_labels_and_costs_match_loops(spark, gamma):
    table = rows()
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    got, costs = P.k_prototypes(df, "id", "kind", COLS, k=3, gamma=gamma)
    x = np.array([[r[2], r[3]] for r in table])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    start = P.starting_prototypes(P.standardised(df, "id", "kind", COLS), "id", "kind", 3)
    labels, plain_costs = plain(z, [r[1] for r in table], start, gamma)
    assert [r.cluster for r in got.orderBy("id").collect()] == labels
    assert costs == pytest.approx(plain_costs, rel=1e-9)
    assert len(costs) > 1 and all(b <= a * (1 + 1e-12) for a, b in zip(costs, costs[1:]))


def test_empty_table(spark):
    got, costs = P.k_prototypes(spark.createDataFrame([], SCHEMA), "id", "kind", COLS)
    assert got.count() == 0 and costs == []


def test_few_distinct_rows_nulls_and_constant_columns(spark):
    table = [(1, "u", 1.0, 7.0), (2, "u", 1.0, 7.0), (3, None, 1.0, 7.0), (4, None, None, None), (4, None, None, None)]
    got, costs = P.k_prototypes(spark.createDataFrame(table, SCHEMA), "id", "kind", COLS, k=6)
    kept = got.collect()
    assert len(kept) == 5 and costs[-1] == 0.0
    by_id = {r.id: r.cluster for r in kept}
    assert by_id[1] == by_id[2] != by_id[3] == by_id[4]
