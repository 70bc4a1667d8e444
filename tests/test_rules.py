import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from caudal.functions import calendar as C
from caudal.functions import numeric as N
from caudal.functions import rules as R
from caudal.functions import text as X
from caudal.operators import liquidity as Q
from caudal.operators import portfolio as P
from tests.conftest import dicts

D = dt.date


def values(spark, rows, schema, expression):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [r[0] for r in df.select(expression).collect()]


def test_score_bands(spark):
    scores = [300, 499, 500, 599, 600, 679, 680, 749, 750, 850]
    got = values(spark, [(s,) for s in scores], "s int", R.score_band(F.col("s")))
    bands = ["300-499", "500-599", "600-679", "680-749", "750+"]
    assert got == [b for b in bands for _ in range(2)]


def test_risk_tier(spark):
    rows = [(701, 1000.01), (700, 5000.0), (499, 5000.0), (750, 199.0), (600, 200.0)]
    got = values(spark, rows, "s int, i double", R.risk_tier(F.col("s"), F.col("i")))
    assert got == ["Bajo", "Medio", "Alto", "Alto", "Medio"]


def test_payment_class_and_serious_mark(spark):
    days = [(d,) for d in (0, 15, 30, 31, 90, 91)]
    got = values(spark, days, "d int", R.payment_class(F.col("d")))
    assert got == ["A Tiempo", "Atrasado", "Atrasado", "No Pagado", "No Pagado", "No Pagado"]
    assert values(spark, days, "d int", R.seriously_late(F.col("d"))) == [0, 0, 0, 0, 0, 1]


def test_paydays(spark):
    days = [(D(2024, 1, 15),), (D(2024, 1, 30),), (D(2024, 1, 31),), (D(2024, 2, 28),),
            (D(2024, 2, 29),)]
    got = values(spark, days, "d date", C.is_payday(F.col("d")))
    assert got == [True, True, False, True, False]


def test_paydays_of_a_month_are_the_paydays(spark):
    months = [(D(2024, m, 1),) for m in range(1, 13)]
    listed = {d for days in values(spark, months, "d date", C.paydays_of(F.col("d"))) for d in days}
    year = spark.createDataFrame([(D(2024, 1, 1), D(2024, 12, 31))], "a date, z date")
    marked = C.day_range(year, "a", "z").filter(C.is_payday(F.col("fecha")))
    assert listed == {r[0] for r in marked.collect()}


def test_week_key_agrees_with_strftime(spark):
    start = D(2022, 12, 25)
    days = [start + dt.timedelta(n) for n in range(1500)]
    got = values(spark, [(d,) for d in days], "d date", C.week_key(F.col("d")))
    assert got == [d.strftime("%Y-%W") for d in days]


def test_season_factor_and_capped_rates(spark):
    days = [(D(2024, 12, 15),), (D(2024, 1, 10),)]  # December Sunday payday; plain Wednesday
    got = values(spark, days, "d date", C.season_factor(F.col("d")))
    assert got == [2.0 * 2.8 * 1.2, 1.0]
    factor = C.season_factor(F.col("d"))
    assert values(spark, days, "d date", C.activity_rate("VES", factor)) == [0.95, 0.22]
    assert values(spark, days, "d date", C.activity_rate("USD", factor)) == [0.40, 0.08]


def test_french_instalment(spark):
    got = values(spark, [(1200.0, 36.0, 12)], "p double, r double, n int",
                 N.french_instalment(F.col("p"), F.col("r"), F.col("n")))
    assert round(got[0], 2) == 120.55


def test_default_probability(spark):
    rows = [(6.0, 550), (1.2, 700), (3.0, 450)]
    got = values(spark, rows, "i double, s int", R.default_probability(F.col("i"), F.col("s")))
    assert got == pytest.approx([0.18, 0.05, 0.25])


def test_rates_are_zero_without_a_base_and_round_up_at_half(spark):
    got = values(spark, [(1, 0), (1, 8), (1, 800)], "a int, b int", N.pct(F.col("a"), F.col("b")))
    assert got == [0.0, 12.5, 0.13]


def test_ratios_without_income(spark):
    row = [(1000.0, 10, 0.0)]
    schema = "a double, n int, i double"
    a, n, i = F.col("a"), F.col("n"), F.col("i")
    assert values(spark, row, schema, N.instalment_to_income(a, n, i)) == [100.0]
    assert values(spark, row, schema, N.debt_to_income(a, n, i)) == [None]
    assert values(spark, row, schema, N.amount_to_income(a, i)) == [None]


def test_haversine(spark):
    # A quarter of a great circle, and no distance at all.
    rows = [(0.0, 0.0, 0.0, 90.0), (10.0, -66.0, 10.0, -66.0)]
    columns = [F.col(c) for c in "abcd"]
    got = values(spark, rows, "a double, b double, c double, d double", N.haversine_km(*columns))
    assert got == pytest.approx([6371.0 * math.pi / 2, 0.0])


def test_texts(spark):
    row = [("Corporación Ana", "Rivas Silva", "J-7")]
    schema = "n string, a string, c string"
    n, a, c = F.col("n"), F.col("a"), F.col("c")
    assert values(spark, row, schema, X.mail_address(n, a)) == ["corporaciónana.rivas@gmail.com"]
    assert values(spark, row, schema, X.is_company(c)) == [True]
    assert values(spark, row, schema, X.document_prefix(c)) == ["J"]
    device = values(spark, row, schema, X.device_number(c))[0]
    assert len(device) == 10 and device.startswith("DEV_")
    assert values(spark, [("x", None)], "n string, a string", X.full_name(n, a)) == [None]


def test_score_clamp(spark):
    got = values(spark, [(200,), (900,), (600,)], "s int", N.clamp(F.col("s"), 300, 850))
    assert got == [300, 850, 600]


def test_maturity_is_thirty_days_a_month(make):
    loans = make("creditos", dict(fecha_otorgamiento=D(2024, 3, 15), plazo_meses=12))
    assert dicts(P.loan_maturity(loans))[0]["fecha_vencimiento"] == D(2025, 3, 10)


def test_liquidity_worked_example(make):
    row = dicts(Q.liquidity_ratios(make("resumen_liquidez_diario", {}),
                                   make("indicadores_macro", {})))[0]
    assert row["encaje_ves"] == 730.0
    assert row["tasa_liquidez"] == 500 / 1001
    assert row["brecha_usd"] == -23.0
    assert row["depositos_utilizables_ves"] == 270.0
    assert row["deficit"] == 1


def test_rollforward_borrows_and_invests(spark):
    flows = spark.createDataFrame(
        [("B", D(2024, 1, 1), 10.0, 0.0, 1000.0, 10.0),
         ("B", D(2024, 1, 2), 10.0, 0.0, 1000.0, 0.0)],
        "entidad string, fecha date, tasa_bcv_usd_ves double, flujo_neto_usd double, "
        "total_depositos_ves double, total_depositos_usd double",
    )
    first, second = sorted(dicts(Q.cash_rollforward(flows, opening=500.0)),
                           key=lambda r: r["fecha"])
    assert first["brecha_liquidez_usd"] == -23.0
    assert first["fondeo_usd"] == pytest.approx(25.30)
    assert first["disponible_caja_ves"] == pytest.approx(753.0)
    assert second["brecha_liquidez_usd"] == pytest.approx(2.3)
    assert second["inversion_usd"] == pytest.approx(1.15)
    macro = spark.createDataFrame(
        [(D(2024, 1, d), 30.0, 10.0) for d in (1, 2)],
        "fecha date, tasa_activa_ves_anual double, tasa_pasiva_ves_anual double",
    )
    ops = sorted(dicts(Q.treasury_operations(Q.cash_rollforward(flows, opening=500.0), macro)),
                 key=lambda r: r["fecha"])
    assert [o["tipo_operacion"] for o in ops] == [
        "Colocacion Interbancaria", "Inversion Corto Plazo"]
    assert [o["tasa_anual"] for o in ops] == pytest.approx([27.0, 12.0])


def test_rounding_has_no_upper_limit(spark):
    import duckdb

    xs = [9.3e16, 1e18, -1e18, 5.0e17, 9.3e16 + 0.5, 1.005, -1.005, 2.5, 45035996273704.96, 0.0]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double")
    for digits in (0, 2, 4):
        got = [r[0] for r in df.orderBy("k").select(N.round_half_up(F.col("x"), digits)).collect()]
        assert got == [
            duckdb.sql(f"select floor(cast({x!r} as double)*1e{digits}+0.5e0)/1e{digits}")
            .fetchall()[0][0] for x in xs
        ]
