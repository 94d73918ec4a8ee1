"""Rows and group sizes that only larger tables have: queries against their SQL, operators against plain Python."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from trailframe.functions import locate
from trailframe.operators import rewards
from trailframe.plans import catalog, scoring, tables, tasks  # noqa: F401
from trailframe.streaming import sessions


def _compared(spark, name, folder, **rows):
    """(the query's rows, its SQL's rows), sorted, over tables made of columns."""
    con = duckdb.connect()
    for table, columns in rows.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    found = catalog.QUERIES[name](spark, str(folder))
    told = con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    key = lambda r: [(x is not None, x) for x in r]
    return sorted(map(tuple, found.collect()), key=key), sorted(told, key=key)


def test_coordinates_at_the_poles(spark, tmp_path):
    """90.005 is no latitude; suppliers 181 and 361 are the first that are told beside a pole."""
    found, told = _compared(spark, "coordinate_scores", tmp_path, supplier={"s_suppkey": list(range(1, 2001))})
    assert found == told
    assert dict(found)[181] == dict(found)[361] == 1.0


def test_references_that_the_sql_keeps(spark, tmp_path):
    """Heads of sf0.1 hold &quot; and references that are cut off; the operator itself decodes them, as a browser does."""
    head = "a &quot;b&quot; &lt;c&gt; &amp;lt; d &#39; & e &am"
    html = f"<html><head><title>{head}</title></head><body><a href='?a=1&b=2'>x</a><article><h1>{head}</h1></article></body></html>"
    found, told = _compared(spark, "located_texts", tmp_path, pages={"page_id": list(range(6)), "html": [html] * 6})
    assert found == told
    assert found[1][1] == "a &quot;b&quot; <c> &lt; d &#39; & e &am"
    assert locate.select(html, "document.querySelector('h1').textContent") == "a \"b\" <c> &lt; d ' & e &am"


def _events(n, users):
    """Events of which a group of samples has users / 25 episodes."""
    return {"event_id": list(range(n)), "user_id": [k * 7919 % users for k in range(n)], "value": [k * 31 % 10_007 / 100 for k in range(n)], "props": ["{}"] * n}


def _plan(spark, name, folder):
    return catalog.QUERIES[name](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()


def test_steps_without_maps_of_large_groups(spark, tmp_path):
    """A map a step made rows that grow with the group: 6,000,000 of 3,600 entries each at 60 times sf0.1."""
    found, told = _compared(spark, "stamped_group_rewards", tmp_path, events=_events(6000, 2500))
    assert len(found) == 6000 and found[0][1] == 100
    assert found == told
    assert "map_from_entries" not in _plan(spark, "stamped_group_rewards", tmp_path)


def test_stored_rewards_an_entry_a_row(spark, tmp_path):
    """Stored maps on every step wrote steps times episodes entries to disk."""
    found, told = _compared(spark, "stored_group_rewards", tmp_path, events=_events(6000, 2500))
    assert len(found) == 2500 and found == told
    plan = _plan(spark, "stored_group_rewards", tmp_path)
    assert "map_from_entries" not in plan and "map_concat" not in plan


def test_stored_entries(spark):
    """As maps do, entries take the place of a group's episodes, and refuse rewards that differ and wrong numbers."""
    samples = spark.createDataFrame([(0, 0, 0, 0.0), (1, 0, 1, 1.0), (2, 1, 2, 3.0)], "ordinal long, group_index long, index long, episode_reward double").selectExpr("*", "CAST(NULL AS DOUBLE) AS final_reward", "CAST(NULL AS DOUBLE) AS sample_reward", "'completed' AS status")
    entries = lambda *rows: spark.createDataFrame(rows, "group_index long, index long, reward double")
    told = rewards.from_stored(samples, std=False, stored=entries((0, 0, 0.0), (0, 1, 1.0), (0, 9, 5.0), (0, 9, 5.0)), expected=3).collect()
    assert {r["index"]: r["normalized"] for r in told} == {0: -2.0, 1: -1.0, 2: 3.0}
    with pytest.raises(Exception, match="stored rewards differ in group 0"):
        rewards.from_stored(samples, stored=entries((0, 0, 0.0), (0, 0, 1.0))).collect()
    with pytest.raises(Exception, match="stored rewards differ in group 0"):
        rewards.from_stored(samples, stored=entries((0, 0, 0.0), (0, 0, None))).collect()
    with pytest.raises(Exception, match="expected 3 stored rewards in group 0 got 2"):
        rewards.from_stored(samples, stored=entries((0, 0, 0.0), (0, 1, 1.0)), expected=3).collect()


def _admitted(requests, most):
    """A plain fold of each pool's requests."""
    live, out = {}, []
    for pool, order, delta in sorted(requests, key=lambda r: (r[0] is not None, *r)):
        n, d = live.get(pool, 0), delta or 0
        ok = d < 0 or n < most
        live[pool] = max(0, n + d) if ok else n
        out.append((pool, order, d, ok))
    return out


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_admission_of_long_pools(spark, batch):
    """Pools are folded by runs of requests, however these are cut, with ties and several limits."""
    rng = random.Random(batch)
    requests = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(1500), rng.choice([1, 1, -1])) for _ in range(1500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for most in (0, 1, 8):
            found = sessions.admitted(spark.createDataFrame(requests, "pool int, at long, delta int"), "pool", "at", most)
            assert sorted(map(tuple, found.collect())) == sorted(_admitted(requests, most))
        wide = [(k % 2 * "a", k, rng.choice([3, 1, -1, -2])) for k in range(400)]
        found = sessions.admitted(spark.createDataFrame(wide, "pool string, at long, delta int"), "pool", "at", 4)
        assert sorted(map(tuple, found.collect())) == sorted(_admitted(wide, 4))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_admission_without_requests_or_pools(spark):
    assert sessions.admitted(spark.createDataFrame([], "pool int, at long, delta int"), "pool", "at", 8).collect() == []
    some = [(None, 1, 1), (None, 2, 1), (None, 3, None), (0, 1, 1)]
    found = sessions.admitted(spark.createDataFrame(some, "pool int, at long, delta int"), "pool", "at", 1)
    assert set(map(tuple, found.collect())) == set(_admitted(some, 1))


def test_admission_equals_its_sql(spark, tmp_path):
    found, told = _compared(spark, "admitted_sessions", tmp_path, events=_events(3000, 2500))
    assert len(found) == 3000 and found == told
