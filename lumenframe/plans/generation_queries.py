"""Queries over the driver tables for generations and their items, per-sample features and capped outputs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import generations as G
from lumenframe.session import table

CAP = 500


def _items(spark, sf_dir: str) -> DataFrame:
    """Events as items: a user is a generation, an event a sample, and its value decides the status."""
    status = F.when(F.col("value") < 5, "running").when(F.col("value") < 10, "claimed").when(F.col("value") < 40, "completed").otherwise("pending")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("generation_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("sample_id"), status.alias("status"))
    return G.conform(e, "asset_items")


_ITEMS = "items AS (SELECT user_id::VARCHAR AS generation_id, lpad(event_id::VARCHAR, 12, '0') AS sample_id, CASE WHEN value < 5 THEN 'running' WHEN value < 10 THEN 'claimed' WHEN value < 40 THEN 'completed' ELSE 'pending' END AS status FROM events)"


def generation_feed(spark, sf_dir: str) -> DataFrame:
    """LIM-03, STM-11."""
    now = F.to_timestamp(F.lit("2024-02-01T00:00:00Z"))
    return G.feed(_items(spark, sf_dir), "runner", now, batch=4, max_in_flight=6).select("generation_id", "sample_id", "status", "claimed_by")


def generation_counters(spark, sf_dir: str) -> DataFrame:
    """AGG-02, AGG-18."""
    return G.counters(_items(spark, sf_dir))


def generation_decisions(spark, sf_dir: str) -> DataFrame:
    """STM-12: documents ask; those of an even id are assets, orders give the live generations of some hashes."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("derivation_hash"), "doc_id")
    d = d.withColumn("own", F.format_string("%012d", "doc_id"))
    stamp = lambda day: F.lit(f"2024-01-0{day}T00:00:00Z")
    assets = d.where("doc_id % 3 = 0").select(F.col("own").alias("asset_id"), "dataset_id", F.lit("mask").alias("kind"), "derivation_hash", stamp(1).alias("created_at"))
    live = d.where("doc_id % 3 = 1").select(
        F.col("own").alias("generation_id"), "dataset_id", F.lit("mask").alias("kind"), "derivation_hash", F.lit("o").alias("owner_id"), stamp(1).alias("created_at"),
        F.when(F.col("doc_id") % 2 == 0, stamp(2)).otherwise(stamp(1)).alias("updated_at"),
    )
    out = G.decide(d.select("doc_id", "dataset_id", "derivation_hash"), G.conform(assets, "assets"), G.conform(live, "asset_generations"), F.to_timestamp(F.lit("2024-01-02T01:00:00Z")))
    return out.select("doc_id", "action", "asset_id", "generation_id")


def first_order_features(spark, sf_dir: str) -> DataFrame:
    """AGG-19: first-order features of each event type; the mean is joined back once, as it is one row for each type."""
    e = table(spark, sf_dir, "events").select("event_type", "value").where("value is not null")
    v = F.col("value")
    base = e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(v * v).alias("energy"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"),
        F.percentile(v, F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("q"),
    )
    means = base.select("event_type", F.col("mean").alias("_mean"))
    away = v - F.col("_mean")
    moments = e.join(means, "event_type").groupBy("event_type").agg(F.avg(F.abs(away)).alias("mad"), F.avg(away**3).alias("m3"), F.avg(away**4).alias("m4"))
    r = lambda c: F.round(c, 4)
    return base.join(moments, "event_type").select(
        "event_type", "n", r("energy").alias("energy"), "minimum", "maximum", r("mean").alias("mean"), r("variance").alias("variance"), r(F.col("q")[0]).alias("p10"), r(F.col("q")[2]).alias("median"), r(F.col("q")[4]).alias("p90"),
        r(F.col("q")[3] - F.col("q")[1]).alias("interquartile_range"), r(F.col("maximum") - F.col("minimum")).alias("value_range"), r(F.sqrt(F.col("energy") / F.col("n"))).alias("rms"), r("mad").alias("mad"),
        r(F.col("m3") / F.col("variance") ** 1.5).alias("skewness"), r(F.col("m4") / F.col("variance") ** 2).alias("kurtosis"),
    )


def capped_union_fallback(spark, sf_dir: str) -> DataFrame:
    """LIM-04: the first tiles over all slides (a top-k, not a global window), and one thumbnail row for each slide without one."""
    e = table(spark, sf_dir, "events")
    tiles = e.where("event_type = 'view'").select("user_id", "event_id").orderBy("user_id", "event_id").limit(CAP)
    bare = e.select("user_id").distinct().join(tiles.select("user_id").distinct(), "user_id", "left_anti")
    return tiles.unionByName(bare.withColumn("event_id", F.lit(None).cast("long")))


def queries() -> dict:
    return {f.__name__: f for f in (generation_feed, generation_counters, generation_decisions, first_order_features, capped_union_fallback)}


def oracle_sql() -> dict[str, str]:
    return {
        "generation_feed": f"""WITH {_ITEMS}, active AS (SELECT generation_id, count(*) FILTER (status IN ('claimed', 'running')) AS active FROM items GROUP BY 1),
won AS (SELECT generation_id, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY generation_id ORDER BY sample_id) AS r FROM items WHERE status = 'pending') JOIN active USING (generation_id) WHERE r <= least(4, 6 - active))
SELECT i.generation_id, i.sample_id, CASE WHEN w.sample_id IS NULL THEN status ELSE 'claimed' END AS status, CASE WHEN w.sample_id IS NOT NULL THEN 'runner' END AS claimed_by
FROM items i LEFT JOIN won w ON i.generation_id = w.generation_id AND i.sample_id = w.sample_id""",
        "generation_counters": f"WITH {_ITEMS} SELECT generation_id, count(*) AS n_total, count(*) FILTER (status = 'completed') AS completed_n, count(*) FILTER (status = 'failed') AS failed_n, count(*) FILTER (status = 'skipped') AS skipped_n FROM items GROUP BY 1",
        "generation_decisions": """WITH d AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS h, lpad(doc_id::VARCHAR, 12, '0') AS own FROM documents),
a AS (SELECT source, h, min(own) AS asset_id FROM d WHERE doc_id % 3 = 0 GROUP BY 1, 2), g AS (SELECT source, h, min(own) AS live FROM d WHERE doc_id % 3 = 1 AND doc_id % 2 = 0 GROUP BY 1, 2)
SELECT doc_id, CASE WHEN asset_id IS NOT NULL THEN 'reuse_asset' WHEN live IS NOT NULL THEN 'reuse_generation' ELSE 'run_new' END AS action, asset_id, CASE WHEN asset_id IS NULL THEN live END AS generation_id
FROM d LEFT JOIN a USING (source, h) LEFT JOIN g USING (source, h)""",
        "first_order_features": """WITH b AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1)
SELECT event_type, count(*) AS n, round(sum(value * value), 4) AS energy, min(value) AS minimum, max(value) AS maximum, round(avg(value), 4) AS mean, round(var_pop(value), 4) AS variance,
round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS interquartile_range,
round(max(value) - min(value), 4) AS value_range, round(sqrt(sum(value * value) / count(*)), 4) AS rms, round(avg(abs(value - m)), 4) AS mad, round(avg(pow(value - m, 3)) / pow(var_pop(value), 1.5), 4) AS skewness,
round(avg(pow(value - m, 4)) / pow(var_pop(value), 2), 4) AS kurtosis FROM events JOIN b USING (event_type) WHERE value IS NOT NULL GROUP BY 1""",
        "capped_union_fallback": f"""WITH t AS (SELECT user_id, event_id FROM events WHERE event_type = 'view' ORDER BY 1, 2 LIMIT {CAP})
SELECT * FROM t UNION ALL SELECT DISTINCT user_id, NULL::BIGINT AS event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM t)""",
    }
