"""Queries on tables that are larger than their caps were, or that hold odd times."""

import pytest

from tellspan import queries, scenarios
from tellspan.operators import alerts, search, services
from tellspan.plans import documents as D
from tellspan.queries import DAY, NOW, START
from tellspan.sources import adapters, storage

_Q, _SQL = queries.QUERIES | scenarios.QUERIES, queries.ORACLES | scenarios.ORACLES


@pytest.fixture(scope="module")
def make(tmp_path_factory):
    """A folder of tables, each made by SQL, and how a query's rows differ from those of SQL over them."""
    import duckdb

    def made(**tables):
        con, path = duckdb.connect(), tmp_path_factory.mktemp("tables")
        for name, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{path}/{name}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
        return con, str(path)

    return made


def _same(spark, made, name, sql=None):
    con, path = made
    mine, theirs = _Q[name](spark, path), con.sql(sql or _SQL[name])
    at = [mine.columns.index(c) for c in theirs.columns]
    got, want = sorted(repr(tuple(r[i] for i in at)) for r in mine.collect()), sorted(map(repr, theirs.fetchall()))
    assert got == want
    return got


def _events(n, start, step_us, kind="purchase"):
    """``n`` events of one service, some at one time."""
    return f"SELECT i AS event_id, make_timestamp({start // 1000} + i // 2 * {step_us}) AS ts, 2 + i % 3 * 5 AS user_id, '{kind}' AS event_type, (1.5 + i)::DOUBLE AS value, concat('{{\"k\": ', i % 50, '}}') AS props FROM range({n}) t(i)"


def test_all_pages_in_few_jobs(spark, make):
    made = make(events=_events(21_000, NOW - 3 * DAY, 7_000_000, "error"))
    sc = spark.sparkContext
    sc.setJobGroup("pages", "pages")
    got = _same(spark, made, "search_pages")
    jobs = len(sc.statusTracker().getJobIdsForGroup("pages"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 31 and jobs < 15  # 21,000 matches fill 30 pages, and an empty one follows
    logs, after, walked = adapters.logs(spark, made[1]), D.Cursor(NOW - 2 * DAY - 9_000_000_000, 0, 0, 5), []
    q = D.Search(limit=4_000, after=after)
    want = [tuple(r) for r in search.pages(logs, q).orderBy("page").collect()]
    while after:
        p = search.page(logs, D.Search(limit=4_000, after=after), stats=True)
        walked.append((len(walked), len(p.rows), p.matched, p.scanned, p.next))
        after = p.next and D.Cursor.parse(p.next)
    assert walked == want and len(want) > 2
    assert [tuple(r) for r in search.pages(logs.limit(0), q).collect()] == [(0, 0, 0, 0, None)]


@pytest.fixture(scope="module")
def orders(make):
    """Orders of one segment and priority, with few lines."""
    n = 150_300
    return make(
        orders=f"SELECT i AS o_orderkey, i % 9 AS o_custkey, CASE WHEN i % 5 = 0 THEN 'P' ELSE 'F' END AS o_orderstatus, (10.5 + i)::DOUBLE AS o_totalprice, make_timestamp(800000000000000 + i * 1000000) AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range({n}) t(i)",
        customer="SELECT i AS c_custkey, 'SHOP' AS c_mktsegment FROM range(9) t(i)",
        lineitem="SELECT i AS l_orderkey, i AS l_partkey, i % 4 AS l_suppkey, 1 AS l_linenumber, (5 + i)::DOUBLE AS l_quantity, 1.5 AS l_extendedprice, 0.0 AS l_discount, 0.0 AS l_tax, 'R' AS l_returnflag, 'O' AS l_linestatus, make_timestamp(800000000000000 + i * 1000000) AS l_shipdate FROM range(90) t(i)",
        supplier="SELECT i AS s_suppkey, (i % 2)::INTEGER AS s_nationkey FROM range(4) t(i)",
        nation="SELECT i::INTEGER AS n_nationkey, concat('N', i) AS n_name FROM range(2) t(i)",
    )


def _wide(name):
    """The SQL of a service map with totals that may need more than 64 bits, which it can't cast to BIGINT."""
    total = "sum(duration_ns)" if name == "service_map_nodes" else "sum(c.duration_ns)"
    cast = f"{total}::BIGINT AS total_ns"
    assert cast in _SQL[name]
    return _SQL[name].replace(cast, f"{total}::DECIMAL(38,0) AS total_ns")


@pytest.mark.parametrize("name", ["service_map_nodes", "service_map_edges"])
def test_totals_beyond_64_bits(spark, orders, name):
    got = _same(spark, orders, name, _wide(name))
    assert any(str(150_300 * 86_400_000_000_000) in r for r in got)


def test_totals_are_exact_whatever_their_sign(spark):
    df = spark.createDataFrame([(1, v) for v in ((1 << 63) - 1, (1 << 63) - 1, -(1 << 63), 7)] + [(2, -5), (2, None), (3, None)], "k int, d long")
    assert {r["k"]: r["t"] for r in df.groupBy("k").agg(services._total("d").alias("t")).collect()} == {1: (1 << 63) + 5, 2: -5, 3: None}


def test_filter_bar_has_no_page_limit(spark, make):
    made = make(events=_events(22_000, NOW - 6 * DAY, 5_000_000).replace("2 + i % 3 * 5", "2").replace("i % 50", "i % 60"))
    assert len(_same(spark, made, "filter_bar_search")) > 10_000


@pytest.mark.parametrize("over", ["6h", "12h"])
def test_rows_a_microsecond_beside_a_tick(spark, make, over):
    hours = "SELECT k, d FROM range(0, 140) t(k), (VALUES (-1), (0), (1), (900), (-1700)) v(d)"
    at = f"make_timestamp({NOW // 1000} - 432000000000 + (k - 12) * 3600000000 + d)"
    made = make(events=f"SELECT row_number() OVER () AS event_id, {at} AS ts, k AS user_id, CASE WHEN k % 2 = 0 THEN 'error' ELSE 'view' END AS event_type, 1.0 AS value, '{{\"k\": 1}}' AS props FROM ({hours})")
    sql = _SQL["alert_ticks"].replace(str(6 * D.HOUR), str(int(over[:-1]) * D.HOUR))
    rule = alerts.rule({"name": "errors", "query": {"where": [{"field": "severity_number", "gte": 17}]}, "of": {}, "when": "ratio > 21%", "over": over, "for": "1h"})
    got = alerts.ticks(adapters.logs(spark, made[1]), rule, NOW - 5 * DAY, NOW, D.HOUR)
    assert sorted(map(tuple, got.collect())) == sorted(made[0].sql(sql).fetchall())
    if over == "6h":
        _same(spark, made, "alert_ticks")


def test_series_have_no_point_limit_in_counts(spark, make):
    made = make(events=_events(100_500, START + DAY, 40_000_000).replace("2 + i % 3 * 5", "2 + i % 3 * 5 - CASE i % 1000 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END"))
    assert any("100298" in r for r in _same(spark, made, "series_capped"))


def test_half_series_has_no_point_limit(spark, orders):
    assert "100200" in _same(spark, orders, "series_half")[0]


def test_stored_window_has_no_page_limit(spark, make):
    made = make(events=_events(11_000, NOW - 6 * DAY, 5_000_000))
    assert len(_same(spark, made, "stored_window")) > 10_000


def test_hours_of_times_a_nanosecond_before_them(spark):
    hour = 1_706_000_000_000_000_000 // storage.HOUR_NS
    df = spark.createDataFrame([(hour * storage.HOUR_NS + d,) for d in (-1, 0, 1)] + [(-1,)], "ts_ns long")
    assert sorted(r["p"] for r in storage.stamped(df).collect()) == [-1, hour - 1, hour, hour]
