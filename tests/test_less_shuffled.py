"""Clusters deal squares once, not once for each square they reach."""

import random

from kerbside.operators import radius_clusters as rc
from tests.test_clusters import expected, frame


def spied(monkeypatch, module):
    """Name, columns and plan of each table that a module writes."""
    seen, real = [], module.written

    def spy(df, name):
        seen.append((name, df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(module, "written", spy)
    return seen


def test_squares_meet_their_rivals_after_the_last_shuffle(spark, monkeypatch):
    draw = random.Random(11)
    # several blocks of squares wide and high at zoom 16, with rows at their edges
    points = {i: (draw.uniform(-73.65, -73.60), draw.uniform(45.49, 45.52)) for i in range(900)}
    seen = spied(monkeypatch, rc)
    found = rc.radius_clusters(frame(spark, points), "sign_id", (16, 14)).collect()
    assert sorted(map(tuple, found)) == expected(points, (16, 14))
    plan = next(plan for name, _, plan in seen if name == "centres")
    assert plan[: plan.index("Exchange")].count("Generate ") == 2
    assert {"x", "mark"}.isdisjoint(c for name, columns, _ in seen if name != "centres" for c in columns)


def test_repeated_ids_and_an_id_without_value(spark):
    rows = [(1, -73.60, 45.50), (1, -73.60, 45.50), (2, -73.60, 45.50), (None, -73.5, 45.6), (3, -73.4, 45.5)]
    points = spark.createDataFrame(rows, "sign_id long, longitude double, latitude double")
    found = rc.radius_clusters(points, "sign_id", (16,))
    first = expected({1: (-73.60, 45.50), 2: (-73.60, 45.50)}, (16,))[0]
    copies = 2 if first[1] == 1 else 1
    rest = [tuple(r) for r in found.collect()]
    assert rest.count(first) == copies and (16, 3, -73.4, 45.5, 1, 1) in rest and len(rest) == copies + 1
