import datetime as dt
import random

import numpy as np
import pytest

from caudal.operators import rollforward as R
from caudal.operators.liquidity import cash_rollforward

RULES = R.Rules(0.05, 0.73, 1.1, 0.5, 0.2)
COLUMNS = "entidad string, fecha date, tasa_bcv_usd_ves double, flujo_neto_usd double, " \
          "total_depositos_ves double, total_depositos_usd double"


def days(rng, n):
    return [(rng.uniform(20, 60), rng.gauss(0, 4e5), rng.uniform(1e6, 9e7),
             rng.choice([0.0, rng.uniform(0, 3e6)])) for _ in range(n)]


def folded(rules, cash, steps):
    out = []
    for day in steps:
        out.append(rules.step(cash, *day))
        cash = out[-1][0]
    return out


@pytest.mark.parametrize("rules", [RULES, R.Rules(0.8, 0.73, 1.1, 0.5, 0.2),
                                   R.Rules(0.05, 0.73, 1.0, 1.0, -0.1)])
def test_a_day_is_the_function_it_says(rules):
    rng = random.Random(1)
    for day in days(rng, 300):
        pieces = rules.day(*day)
        assert [p[0] for p in pieces] == sorted(p[0] for p in pieces)
        for cash in [rng.uniform(-1e8, 2e8) for _ in range(20)]:
            assert R.value(pieces, cash) == pytest.approx(rules.step(cash, *day)[0], rel=1e-9)


def test_compositions_equal_the_fold():
    rng = random.Random(2)
    for n in (1, 2, 5, 40, 400):
        steps = days(rng, n)
        reach = 1e12
        now = [(reach, 1.0, 0.0)]
        for day in steps:
            now = R.compose(now, -reach, RULES.day(*day))
        assert len(now) < 200
        for cash in [2e7, *(rng.uniform(-1e8, 1e9) for _ in range(30))]:
            assert R.value(now, cash) == pytest.approx(folded(RULES, cash, steps)[-1][0], rel=1e-9)


@pytest.mark.parametrize("parts", [None, 7])
def test_entities_of_all_lengths_in_any_number_of_slices(spark, parts):
    rng = random.Random(3)
    start = dt.date(2000, 1, 1)
    rows, want = [], {}
    for name, n in {"a": 1, "b": 900, "c": 40, "d": 3, None: 200, "hot": 4000}.items():
        steps = days(rng, n)
        rows += [(name, start + dt.timedelta(k), *day) for k, day in enumerate(steps)]
        for k, made in enumerate(folded(RULES, 500.0, steps)):
            want[name, start + dt.timedelta(k)] = made
    rng.shuffle(rows)
    got = cash_rollforward(spark.createDataFrame(rows, COLUMNS), opening=500.0, parts=parts)
    seen = {(r[0], r[1]): r[2:] for r in got.collect()}
    assert seen.keys() == want.keys()
    for key, made in want.items():
        assert [x is None for x in seen[key]] == [x is None for x in made]
        assert [x or 0 for x in seen[key]] == pytest.approx([x or 0 for x in made], rel=1e-9)
    empty = spark.createDataFrame([], COLUMNS)
    assert cash_rollforward(empty).count() == 0


def test_closed_compositions_go_on(spark, monkeypatch):
    rng = random.Random(4)
    steps = days(rng, 60)
    now, closed = [(1e9, 1.0, 0.0)], []
    for day in steps:
        if len(now) > 2:
            closed.append(now)
            now = [(1e9, 1.0, 0.0)]
        now = R.compose(now, -1e9, RULES.day(*day))
    cash = 2e7
    for f in [*closed, now]:
        cash = R.value(f, cash)
    assert len(closed) > 3
    assert cash == pytest.approx(folded(RULES, 2e7, steps)[-1][0], rel=1e-9)


def test_one_entity_over_a_million_steps(spark):
    n, parts = 1_000_000, 16
    k = spark.range(n).selectExpr(
        "'banco' entidad", "date_add(date'0001-01-01', cast(id as int)) fecha",
        "20 + id % 41 tasa_bcv_usd_ves", "(id * 7919 % 200003 - 100000) * 4.0 flujo_neto_usd",
        "1000000.0 + id * 104729 % 90000001 total_depositos_ves",
        "(id * 31 % 7) * 400000.0 total_depositos_usd",
    )
    got = cash_rollforward(k, parts=parts)
    assert not [line for line in got._jdf.queryExecution().toString().split("\n")
                if "FlatMapGroups" in line]
    mine = got.selectExpr("fecha", "disponible_caja_ves", "fondeo_usd", "inversion_usd")
    table = mine.selectExpr("datediff(fecha, date'0001-01-01') k", "disponible_caja_ves c") \
        .toPandas().sort_values("k")
    ids = np.arange(n)
    rate, flow = 20 + ids % 41, (ids * 7919 % 200003 - 100000) * 4.0
    ves, usd = 1e6 + ids * 104729 % 90000001, (ids * 31 % 7) * 4e5
    cash, want = 20000000.0, []
    for day in zip(rate.astype(float).tolist(), flow.tolist(), ves.tolist(), usd.tolist()):
        cash = RULES.step(cash, *day)[0]
        want.append(cash)
    assert np.allclose(table["c"].to_numpy(), np.array(want), rtol=1e-9, atol=0)
