"""Queries of the voxel kernels and the streaming operators over the driver tables, with their SQL.

Voxels come from ``lineitem``: a supplier is a sample, line number, part and quantity are the coordinates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import voxels as V
from lumenframe.session import table
from lumenframe.streaming import object_events as E

_VOXELS = "v AS (SELECT DISTINCT l_suppkey AS sample_id, l_linenumber AS z, CAST(l_partkey % 6 AS INT) AS y, CAST(l_quantity AS INT) % 6 AS x FROM lineitem)"
# offsets in a ball of radius 1 (half axes of 1.5): all neighbours but the corners
_BALL = "o AS (SELECT * FROM (SELECT unnest(range(-1, 2)) AS dz), (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx) WHERE abs(dz) + abs(dy) + abs(dx) < 3)"
_DILATED = "d AS (SELECT DISTINCT sample_id, z + dz AS z, y + dy AS y, x + dx AS x FROM v, o)"


def _eroded(of: str) -> str:
    return f"SELECT sample_id, z + dz AS z, y + dy AS y, x + dx AS x FROM {of}, o GROUP BY 1, 2, 3, 4 HAVING count(*) = 19"


def _rows(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    at = [F.col("l_linenumber").alias("z"), (F.col("l_partkey") % 6).cast("int").alias("y"), (F.col("l_quantity").cast("int") % 6).alias("x")]
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample_id"), *at, *more)


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).distinct()


def _sizes(mask: DataFrame) -> DataFrame:
    return mask.groupBy("sample_id").agg(*[(F.max(a) + 1).cast("int").alias(f"n_{a}") for a in V.AXES])


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = _mask(spark, sf_dir).where("(z * 7 + y * 3 + x * 5 + sample_id) % 3 = 0")
    return V.connected_components(sparse, min_voxels=2, max_components=3).select("sample_id", "z", "y", "x", "component", "n_voxels")


def _crop_to_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.crop_to_mask(_mask(spark, sf_dir), _rows(spark, sf_dir, "l_returnflag").where("l_returnflag = 'R' AND z > 1"))


def _center_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = _mask(spark, sf_dir)
    return V.center_crop(mask, _sizes(mask), (4, 3, 5))


def _resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, F.col("l_extendedprice").alias("value")).groupBy(*V.KEY).agg(F.max("value").alias("value"))
    geometry = _sizes(rows).withColumns({f"s_{a}": F.lit(1.0) for a in V.AXES})
    return V.resample_linear(rows, geometry, (2.0, 2.5, 1.5))


def _object_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.md5(F.col("event_id").cast("string"))
    tag = F.when(F.col("event_type") == "view", F.concat(tag, F.lit("-2"))).otherwise(tag)
    key = F.concat(F.lit("u+"), "user_id", F.lit("%20"), "event_id")
    record = F.struct(F.struct(F.struct(F.lit("b").alias("name")).alias("bucket"), F.struct(key.alias("key"), tag.alias("eTag")).alias("object")).alias("s3"))
    payload = F.to_json(F.struct(F.array(record).alias("Records")))
    return E.parse(table(spark, sf_dir, "events").select(payload.alias("value")), F.lit("streamed")).select("resource_name", "content_hash", "source")


def _item_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type")).alias("status")
    return E.item_states(table(spark, sf_dir, "events").select("user_id", status, "ts"), ["user_id"])


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.windowed(_times(spark, sf_dir), "ts", "1 hour", "20 minutes", "10 minutes", "event_type")
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.sessions(_times(spark, sf_dir), "ts", "1 day", "12 hours", "user_id")
    return found.select("user_id", *[F.col(f"session_window.{e}").cast("timestamp_ntz").alias(f"session_{e}") for e in ("start", "end")], "n")


def queries() -> dict:
    return {
        "voxel_dilate": lambda spark, sf_dir: V.dilate(_rows(spark, sf_dir)),
        "voxel_erode": lambda spark, sf_dir: V.erode(_rows(spark, sf_dir)),
        "voxel_closing": lambda spark, sf_dir: V.closing(_rows(spark, sf_dir)),
        "voxel_opening": lambda spark, sf_dir: V.opening(_rows(spark, sf_dir)),
        "voxel_components": _components,
        "voxel_crop_to_mask": _crop_to_mask,
        "voxel_center_crop": _center_crop,
        "voxel_resample_linear": _resample,
        "object_events": _object_events,
        "item_states": _item_states,
        "sliding_windows": _sliding,
        "session_windows": _sessions,
    }


def oracle_sql() -> dict[str, str]:
    box = "b AS (SELECT l_suppkey AS sample_id, min(z) lz, max(z) hz, min(y) ly, max(y) hy, min(x) lx, max(x) hx FROM (SELECT l_suppkey, l_returnflag, l_linenumber z, CAST(l_partkey % 6 AS INT) y, CAST(l_quantity AS INT) % 6 x FROM lineitem) WHERE l_returnflag = 'R' AND z > 1 GROUP BY 1)"
    start = "s AS (SELECT sample_id, greatest(0, (max(z) + 1 - 4) // 2) sz, greatest(0, (max(y) + 1 - 3) // 2) sy, greatest(0, (max(x) + 1 - 5) // 2) sx FROM v GROUP BY 1)"
    return {
        "voxel_components": f"""WITH RECURSIVE {_VOXELS}, s AS (SELECT sample_id, z, y, x, (z * 100 + y) * 100 + x AS id FROM v WHERE (z * 7 + y * 3 + x * 5 + sample_id) % 3 = 0),
e AS (SELECT a.sample_id, a.id AS a, b.id AS b FROM s a JOIN s b ON a.sample_id = b.sample_id AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1),
r AS (SELECT sample_id, id AS a, id AS b FROM s UNION SELECT r.sample_id, r.a, e.b FROM r JOIN e ON r.sample_id = e.sample_id AND r.b = e.a),
l AS (SELECT sample_id, a AS id, min(b) AS root FROM r GROUP BY 1, 2), n AS (SELECT sample_id, root, count(*) AS n_voxels, row_number() OVER (PARTITION BY sample_id ORDER BY count(*) DESC, root) AS component FROM l GROUP BY 1, 2)
SELECT sample_id, z, y, x, component, n_voxels FROM s JOIN l USING (sample_id, id) JOIN n USING (sample_id, root) WHERE n_voxels >= 2 AND component <= 3""",
        "voxel_resample_linear": f"""WITH g AS (SELECT l_suppkey AS sample_id, l_linenumber AS z, CAST(l_partkey % 6 AS INT) AS y, CAST(l_quantity AS INT) % 6 AS x, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3, 4),
n AS (SELECT sample_id, max(z) + 1 AS nz, max(y) + 1 AS ny, max(x) + 1 AS nx FROM g GROUP BY 1),
az AS (SELECT sample_id, unnest(range(greatest(1, CAST(round_even(nz / 2.0::DOUBLE, 0) AS BIGINT)))) AS z, nz FROM n), ay AS (SELECT sample_id, unnest(range(greatest(1, CAST(round_even(ny / 2.5::DOUBLE, 0) AS BIGINT)))) AS y, ny FROM n), ax AS (SELECT sample_id, unnest(range(greatest(1, CAST(round_even(nx / 1.5::DOUBLE, 0) AS BIGINT)))) AS x, nx FROM n),
p AS (SELECT *, least(z * 2.0::DOUBLE, nz - 1) AS pz, least(y * 2.5::DOUBLE, ny - 1) AS py, least(x * 1.5::DOUBLE, nx - 1) AS px, z * 2.0 <= nz - 0.5 AND y * 2.5 <= ny - 0.5 AND x * 1.5 <= nx - 0.5 AS inside FROM az JOIN ay USING (sample_id) JOIN ax USING (sample_id)),
c AS (SELECT p.*, floor(pz) + i AS cz, floor(py) + j AS cy, floor(px) + k AS cx, (CASE WHEN i = 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END) * (CASE WHEN j = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN k = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j), (VALUES (0), (1)) d(k))
SELECT c.sample_id, c.z::INT AS z, c.y::INT AS y, c.x::INT AS x, sum(CASE WHEN inside AND w > 0 THEN w * coalesce(g.value, 0) ELSE 0 END) AS value FROM c LEFT JOIN g ON g.sample_id = c.sample_id AND g.z = cz AND g.y = cy AND g.x = cx GROUP BY 1, 2, 3, 4""",
        "voxel_dilate": f"WITH {_VOXELS}, {_BALL}, {_DILATED} SELECT * FROM d",
        "voxel_erode": f"WITH {_VOXELS}, {_BALL} {_eroded('v')}",
        "voxel_closing": f"WITH {_VOXELS}, {_BALL}, {_DILATED} {_eroded('d')}",
        "voxel_opening": f"WITH {_VOXELS}, {_BALL}, e AS ({_eroded('v')}) SELECT DISTINCT sample_id, z + dz AS z, y + dy AS y, x + dx AS x FROM e, o",
        "voxel_crop_to_mask": f"WITH {_VOXELS}, {box} SELECT sample_id, z - coalesce(lz, 0) AS z, y - coalesce(ly, 0) AS y, x - coalesce(lx, 0) AS x FROM v LEFT JOIN b USING (sample_id) WHERE lz IS NULL OR (z BETWEEN lz AND hz AND y BETWEEN ly AND hy AND x BETWEEN lx AND hx)",
        "voxel_center_crop": f"WITH {_VOXELS}, {start} SELECT sample_id, z - sz AS z, y - sy AS y, x - sx AS x FROM v JOIN s USING (sample_id) WHERE z >= sz AND z < sz + 4 AND y >= sy AND y < sy + 3 AND x >= sx AND x < sx + 5",
        "object_events": "SELECT 's3://b/u+' || user_id || ' ' || event_id AS resource_name, CASE WHEN event_type = 'view' THEN 'streamed' ELSE md5(CAST(event_id AS VARCHAR)) END AS content_hash, CASE WHEN event_type = 'view' THEN 'stream' ELSE 'etag_md5' END AS source FROM events",
        "item_states": "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'completed' ELSE arg_max(event_type, (ts, event_type)) END AS status, count(*) AS n_events, max(ts) AS last_event FROM events GROUP BY 1",
        "sliding_windows": "SELECT time_bucket(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) s(k) GROUP BY 1, 2",
        "session_windows": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM i GROUP BY user_id, k",
    }
