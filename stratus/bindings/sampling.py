"""Ordering, top-k, samples, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratus.bindings import R, query
from stratus.bindings.fixtures import obs, obs_sql, table
from stratus.bindings.profiling import labelled, labelled_sql
from stratus.operators import sampling


@query("sort_by_time", f"SELECT event_id, ts, {R('temp')} AS temp FROM {obs_sql()} o ORDER BY ts NULLS LAST, event_id")
def q_sort_by_time(spark, sf):
    return sampling.sort_by_time(obs(spark, sf).select("event_id", "ts", "temp"), "ts", ["event_id"])


@query("head_n", f"SELECT o_orderkey, o_orderdate, {R('o_totalprice')} AS o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5")
def q_head_n(spark, sf):
    """First five orders by date (the table preview)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return sampling.head_n(o, 5, ["o_orderdate", "o_orderkey"])


@query(
    "top_k",
    f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {R('l_extendedprice')} AS l_extendedprice FROM lineitem "
    "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10",
)
def q_top_k(spark, sf):
    li = table(spark, sf, "lineitem")
    return sampling.top_k(li, "l_extendedprice", 10, tiebreak=["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("sample_n", f"SELECT CAST(least(1000, count(*)) AS BIGINT) AS n_rows, CAST(least(1000, count(*)) AS BIGINT) AS n_distinct, CAST(least(1000, count(*)) AS BIGINT) AS n_unchanged FROM {obs_sql()} o")
def q_sample_n(spark, sf):
    """1000-row reproducible sample: its size, its distinct rows, and those that the table has as they are."""
    rows = obs(spark, sf).select("event_id", "temp", "rain_mm")
    sample = sampling.sample_n(rows, 1000, ["event_id"])
    same = rows.withColumnsRenamed({c: f"own_{c}" for c in rows.columns})
    match = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in rows.columns]
    found = sample.join(same, match, "left")
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_distinct"), F.count("own_event_id").alias("n_unchanged"))


@query(
    "random_split",
    f"""SELECT is_test, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS n_ids FROM (
  SELECT TRUE AS is_test, ceil(0.2 * count(*)) AS n FROM {obs_sql()} o
  UNION ALL SELECT FALSE, count(*) - ceil(0.2 * count(*)) FROM {obs_sql()} o2
  UNION ALL SELECT NULL, count(*) FROM {obs_sql()} o3) t""",
)
def q_random_split(spark, sf):
    """Exact 80/20 split in seeded hash order: rows and distinct ids of each part and (NULL) of both together,
    so the parts share no row and cover the table."""
    s = sampling.random_split(obs(spark, sf), ["event_id"], 0.2, seed=42)
    return s.rollup("is_test").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query(
    "stratified_split",
    f"""SELECT Chuva, is_test, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS n_ids FROM (
  SELECT Chuva, TRUE AS is_test, ceil(0.2 * count(*)) AS n FROM {labelled_sql()} l GROUP BY Chuva
  UNION ALL SELECT Chuva, FALSE, count(*) - ceil(0.2 * count(*)) FROM {labelled_sql()} l2 GROUP BY Chuva
  UNION ALL SELECT Chuva, NULL, count(*) FROM {labelled_sql()} l3 GROUP BY Chuva) t""",
)
def q_stratified_split(spark, sf):
    """20 % of every class in the test part: rows and distinct ids of each part and (NULL) of both together."""
    s = sampling.stratified_split(labelled(spark, sf), ["event_id"], "Chuva", 0.2, seed=42)
    sizes = [F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids")]
    both = s.groupBy("Chuva").agg(*sizes).select("Chuva", F.lit(None).cast("boolean").alias("is_test"), "n", "n_ids")
    return s.groupBy("Chuva", "is_test").agg(*sizes).unionByName(both)


@query(
    "kfold",
    """SELECT event_id, CAST(CASE WHEN g < r * (q + 1) THEN floor(g / (q + 1)) ELSE r + floor((g - r * (q + 1)) / q) END AS BIGINT) AS fold
FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS g, (SELECT count(*) FROM events) // 5 AS q, (SELECT count(*) FROM events) % 5 AS r FROM events) t""",
)
def q_kfold(spark, sf):
    """Five contiguous folds in time order (first n % 5 folds one row longer)."""
    ev = table(spark, sf, "events").select("event_id", "ts")
    return sampling.kfold(ev, 5, order=["ts", "event_id"]).select("event_id", "fold")


@query(
    "kfold_stratified",
    f"""SELECT Chuva, CAST(f AS BIGINT) AS fold, CAST(n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n, CAST(n AS BIGINT) AS n_ids
FROM (SELECT Chuva, count(*) AS n FROM {labelled_sql()} l GROUP BY Chuva) c, range(0, 5) t(f)""",
)
def q_kfold_stratified(spark, sf):
    """Each class dealt round-robin over five folds in hash order: the folds' sizes, and the distinct ids of
    the class over all its folds."""
    k = sampling.kfold(labelled(spark, sf), 5, key=["event_id"], label="Chuva")
    ids = k.groupBy("Chuva").agg(F.count_distinct("event_id").alias("n_ids"))
    return k.groupBy("Chuva", "fold").agg(F.count(F.lit(1)).alias("n")).join(ids, "Chuva")
