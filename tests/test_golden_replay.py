"""Replay the reference's published monthly trend through the window step.

The monthly GMV values below are the reference's published result for its
own data; LAG, month-over-month growth and the running total computed by
``revenue.trend_columns`` from them must reproduce the published columns.
"""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.functions import exprs as X
from basketry.operators.revenue import trend_columns
from basketry.sources.stacked import SERIAL, Section, read_sections

# Published monthly trend (order_month, gmv, prev_month_gmv,
# mom_growth_pct, cumulative_gmv), 24 rows, in month order.
GOLDEN = """
2016-09-01,279.69,,,279.69
2016-10-01,51354.52,279.69,18261.23,51634.21
2016-12-01,19.62,51354.52,-99.96,51653.83
2017-01-01,136943.46,19.62,697878.9,188597.29
2017-02-01,283561.69,136943.46,107.06,472158.98
2017-03-01,425617.96,283561.69,50.1,897776.94
2017-04-01,405848.61,425617.96,-4.64,1303625.55
2017-05-01,582710.83,405848.61,43.58,1886336.38
2017-06-01,499652.24,582710.83,-14.25,2385988.62
2017-07-01,578753.73,499652.24,15.83,2964742.35
2017-08-01,661903.52,578753.73,14.37,3626645.87
2017-09-01,717102.72,661903.52,8.34,4343748.59
2017-10-01,764756.03,717102.72,6.65,5108504.62
2017-11-01,1172191.68,764756.03,53.28,6280696.3
2017-12-01,861526.77,1172191.68,-26.5,7142223.07
2018-01-01,1101920.01,861526.77,27.9,8244143.08
2018-02-01,979486.16,1101920.01,-11.11,9223629.24
2018-03-01,1152656.99,979486.16,17.68,10376286.23
2018-04-01,1156248.89,1152656.99,0.31,11532535.12
2018-05-01,1145686.46,1156248.89,-0.91,12678221.58
2018-06-01,1020381.9,1145686.46,-10.94,13698603.48
2018-07-01,1039783.58,1020381.9,1.9,14738387.06
2018-08-01,996973.51,1039783.58,-4.12,15735360.57
2018-09-01,166.46,996973.51,-99.98,15735527.03
"""


def _rows():
    out = []
    for line in GOLDEN.strip().splitlines():
        m, g, prev, mom, cum = line.split(",")
        out.append((dt.datetime.fromisoformat(m), Decimal(g), float(prev) if prev else None,
                    float(mom) if mom else None, float(cum)))
    return out


def test_window_step_reproduces_published_columns(spark):
    rows = _rows()
    monthly = spark.createDataFrame([(m, g) for m, g, *_ in rows], "order_month timestamp_ntz, _gmv decimal(14,2)")
    got = trend_columns(monthly).orderBy("order_month").collect()
    assert len(got) == 24
    for r, (m, g, prev, mom, cum) in zip(got, rows):
        assert r.order_month == m and r.gmv == float(g)
        assert r.prev_month_gmv == prev
        assert r.mom_growth_pct == mom, m
        assert r.cumulative_gmv == cum, m


def test_published_totals_are_consistent():
    rows = _rows()
    assert sum(g for _, g, *_ in rows) == Decimal("15735527.03")


# The other published results as the file stacks them, one below the other without
# headers: categories (10 rows), payment mix (three of its categories), states (27 rows), quarters
# (9 rows, the year shown as a date) and weekdays (7 rows, the day of the week shown as a date).
STACKED = """
beleza_saude,1255695.13,8800,2430,130.34,14.49,9.31,1
relogios_presentes,1198185.21,5604,1322,200.7,8.35,8.88,2
cama_mesa_banho,1035964.06,9399,3022,93.36,19.73,7.68,3
esporte_lazer,979740.92,7673,2850,114.06,17.1,7.26,4
informatica_acessorios,904322.02,6654,1630,116.22,16.21,6.7,5
moveis_decoracao,727465.05,6425,2641,87.67,23.67,5.39,6
utilidades_domesticas,626825.8,5847,2314,90.65,23.17,4.65,7
cool_stuff,620770.49,3616,783,164.27,13.42,4.6,8
automotivo,586585.73,3872,1882,139.53,15.69,4.35,9
ferramentas_jardim,481009.94,3505,748,111.14,20.48,3.56,10
,credit_card,1113,183509.02,3.1,75.41,,
,boleto,275,57471.12,1,18.63,,
,voucher,61,7215.95,1,4.13,,
,debit_card,27,3424.82,1,1.83,,
agro_industria_e_comercio,credit_card,125,61173.89,4.4,67.2,,
agro_industria_e_comercio,boleto,51,54411.43,1,27.42,,
agro_industria_e_comercio,debit_card,4,1625.04,1,2.15,,
agro_industria_e_comercio,voucher,6,1520.25,1,3.23,,
telefonia_fixa,credit_card,159,147238.67,3.1,72.6,,
telefonia_fixa,boleto,49,55264.49,1,22.37,,
telefonia_fixa,voucher,8,1364.44,1,3.65,,
telefonia_fixa,debit_card,3,1335.9,1,1.37,,
SP,41125,5878132.06,124.66,41125,1,,
RJ,12697,2115667.56,145.82,12697,2,,
MG,11496,1843074.43,141,11496,3,,
RS,5415,877290.59,141.25,5415,4,,
PR,4982,794196.61,138.87,4982,5,,
SC,3599,608023.7,146.12,3599,6,,
BA,3344,606908.66,160.35,3344,7,,
DF,2120,351327.21,146.57,2120,8,,
GO,1998,340544.37,146.6,1998,9,,
ES,2018,323081.03,143.72,2018,10,,
PE,1643,321018.34,178.24,1643,11,,
CE,1323,274522.61,186.24,1323,12,,
PA,969,217480.54,201.56,969,13,,
MT,902,186005.11,176.48,902,14,,
MA,736,150687.96,183.77,736,15,,
PB,531,140523.47,234.21,531,16,,
MS,708,135875.69,166.11,708,17,,
PI,490,107765.47,199.94,490,18,,
RN,482,101895.08,192.62,482,19,,
AL,411,96229.4,216.73,411,20,,
SE,345,73032.32,189.69,345,21,,
TO,278,61103.85,194.6,278,22,,
RO,246,57423.77,207.31,246,23,,
AM,147,27835.73,168.7,147,24,,
AC,81,19669.7,213.8,81,25,,
AP,68,16262.8,198.33,68,26,,
RR,45,9948.97,195.08,45,27,,
1905-07-08,3,279.69,2,41.57,,,
1905-07-08,4,51374.14,291,129.79,,,
1905-07-09,1,846123.11,5122,125.07,,,
1905-07-09,2,1488211.68,9222,124.5,,,
1905-07-09,3,1957759.97,12445,118.53,,,
1905-07-09,4,2798474.48,17586,118.97,,,
1905-07-10,1,3234063.16,20979,115.35,,,
1905-07-10,2,3322317.25,19897,124.36,,,
1905-07-10,3,2036923.55,12655,121.15,,,
1900-01-00,Sunday   ,11831,1844500.7,138.19,,,
1900-01-01,Monday   ,15978,2577565.36,140.94,,,
1900-01-02,Tuesday  ,15758,2521581.8,138.95,,,
1900-01-03,Wednesday,15350,2450969.03,139.94,,,
1900-01-04,Thursday ,14571,2327064.14,139.24,,,
1900-01-05,Friday   ,13948,2270066.01,142.08,,,
1900-01-06,Saturday ,10763,1743779.99,143.95,,,
"""

COUNTED = (("total_orders", "long"),)
SECTIONS = [
    Section("trend", r"^\d{4}-\d{2}-\d{2},[\d.]+,\d+,\d+,[\d.]+,", (("order_month", "timestamp_ntz"), ("gmv", "decimal(14,2)"), *COUNTED, ("unique_customers", "long"),
            ("aov", "double"), ("prev_month_gmv", "double"), ("mom_growth_pct", "double"), ("cumulative_gmv", "double"))),
    Section("quarters", r"^\d{4}-\d{2}-\d{2},[1-4],", (("year", SERIAL), ("quarter", "int"), ("gmv", "decimal(14,2)"), *COUNTED, ("aov", "double"))),
    Section("weekdays", r"^\d{4}-\d{2}-\d{2},[A-Z]", (("day", SERIAL), ("day_name", "string"), *COUNTED, ("gmv", "decimal(14,2)"), ("aov", "double"))),
    Section("states", r"^[A-Z]{2},", (("state", "string"), *COUNTED, ("gmv", "decimal(14,2)"), ("aov", "double"), ("customers", "long"), ("rank", "long"))),
    Section("payments", r"^[a-z0-9_]*,[a-z_]+,", (("category", "string"), ("payment_type", "string"), ("orders", "long"), ("value", "decimal(14,2)"),
            ("installments", "double"), ("pct", "double"))),
    Section("categories", r"^[a-z0-9_]+,[\d.]+,", (("category", "string"), ("revenue", "decimal(14,2)"), *COUNTED, ("products", "long"), ("price", "double"),
            ("freight_pct", "double"), ("share_pct", "double"), ("rank", "long"))),
]


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("published") / "stacked.csv"
    trend = ["order_month,gmv,total_orders,unique_customers,aov,prev_month_gmv,mom_growth_pct,cumulative_gmv"]
    trend += [f"{m},{g},{1},{1},{1.5},{p},{c},{t}" for m, g, p, c, t in (line.split(",") for line in GOLDEN.strip().splitlines())]
    path.write_bytes("\r\n".join([*trend, *STACKED.strip("\n").splitlines()]).encode())
    return read_sections(spark, f"file://{path}", SECTIONS)


def test_every_line_has_its_section(published):
    assert published[""].count() == 0
    assert {k: published[k].count() for k in published if k} == {"trend": 24, "categories": 10, "payments": 12, "states": 27, "quarters": 9, "weekdays": 7}


def test_unknown_lines_are_returned(spark, tmp_path):
    (tmp_path / "x.csv").write_text("h\n,,,\nSP,1,2.5,1,1,1\nwhat is this\n")
    got = read_sections(spark, f"file://{tmp_path}/x.csv", SECTIONS)
    assert [tuple(r) for r in got[""].collect()] == [(3, "what is this")] and got["states"].count() == 1


def test_published_trend_is_read_back(published):
    rows = published["trend"].orderBy("line").collect()
    assert [(r.order_month, r.gmv, r.prev_month_gmv, r.mom_growth_pct, r.cumulative_gmv) for r in rows] == _rows()


def test_quarters_are_the_months_added_up(spark, published):
    months = published["trend"].groupBy(F.year("order_month").alias("year"), F.quarter("order_month").alias("quarter")).agg(F.sum("gmv").alias("gmv"))
    quarters = published["quarters"].select(F.col("year").cast("int").alias("year"), "quarter", "gmv")
    assert sorted(map(tuple, months.collect())) == sorted(map(tuple, quarters.collect()))


def test_weekdays_and_states_add_up_to_the_trend(published):
    total = Decimal("15735527.03")
    days = published["weekdays"].orderBy("day").collect()
    assert [r.day for r in days] == list(range(7))
    # day 0 is a Sunday: the padded names as the library writes them
    week = published["weekdays"].select("day_name", X.day_name(F.date_add(F.lit("2017-01-01").cast("date"), F.col("day").cast("int"))).alias("own"))
    assert all(r.day_name == r.own for r in week.collect())
    assert sum(r.gmv for r in days) == total
    states = published["states"]
    assert sum(r.gmv for r in states.collect()) == total
    ranked = states.withColumn("own", F.rank().over(Window.orderBy(F.col("gmv").desc_nulls_first())))
    assert all(r.rank == r.own for r in ranked.collect())


def test_payment_shares_replay(published):
    per_category = Window.partitionBy("category")
    replayed = published["payments"].withColumn("own", X.pct(F.col("orders"), F.sum("orders").over(per_category), 2))
    assert all(r.pct == r.own for r in replayed.collect())


def test_category_ranks_and_shares_replay(published):
    rows = published["categories"].withColumn("own", F.rank().over(Window.orderBy(F.col("revenue").desc_nulls_first()))).collect()
    assert all(r.rank == r.own for r in rows)
    # one total of all categories explains every published share to its last place
    low = max(float(r.revenue) * 100 / (r.share_pct + 0.005) for r in rows)
    high = min(float(r.revenue) * 100 / (r.share_pct - 0.005) for r in rows)
    assert low < high
