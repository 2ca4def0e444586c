"""

``parse`` and ``item_states`` take batch and streaming frames alike, so the first reconcile and the stream share one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenframe.functions import scalars as S

FIELDS = "resource_name string, content_hash string, source string, bucket string, object_key string, updated_at timestamp"


def listen(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """STM-01: a folder that receives one notification a file, as a stream of (``value``, ``received_at``)."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder, wholetext=True)
    return lines.select("value", F.current_timestamp().alias("received_at"))


def _first(record: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(record, p) for p in paths])


def parse(payloads: DataFrame, stream_hash: Column | None = None, resource: Column | None = None) -> DataFrame:
    """STM-03: one row for each record of the payloads in ``value``; ``error`` is set where bucket or key is missing.

    A payload without ``Records`` is a record itself. Keys are percent-decoded, in which '+' stays. ``stream_hash`` is the
    hash for objects that carry neither a checksum nor a single-part tag; ``resource`` maps bucket and key to a name.
    """
    inner = F.from_json(F.get_json_object("value", "$.Records"), "array<string>")
    rows = payloads.withColumn("_record", F.explode(F.coalesce(inner, F.array("value"))))
    r = F.col("_record")
    bucket = _first(r, "$.s3.bucket.name", "$.bucket", "$.Bucket")
    key = _first(r, "$.s3.object.key", "$.object_key", "$.key", "$.Key")
    tag = _first(r, "$.s3.object.eTag", "$.s3.object.etag", "$.eTag", "$.etag")
    checksum = _first(
        r, "$.s3.object.ChecksumSHA256", "$.s3.object.checksumSHA256", "$.s3.object.checksum_sha256",
        "$.responseElements['x-amz-checksum-sha256']", "$.requestParameters['x-amz-checksum-sha256']",
    )
    decoded = F.try_url_decode(F.regexp_replace(key, r"\+", "%2B"))
    rows = rows.withColumns({"bucket": bucket, "object_key": F.coalesce(decoded, key)})
    value, source = S.content_hash(checksum, tag, stream_hash if stream_hash is not None else F.lit(None).cast("string"))
    name = F.concat(F.lit("s3://"), "bucket", F.lit("/"), "object_key")
    missing = F.col("bucket").isNull() | F.col("object_key").isNull()
    found = rows.withColumns({
        "resource_name": F.coalesce(F.nullif(resource, F.lit("")), name) if resource is not None else name,
        "content_hash": F.when(~missing, value),
        "source": F.when(~missing, source),
        "error": F.when(missing, "event without bucket or object key"),
    })
    return found.drop("_record")


def store(events: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """STM-02, STM-05: runs ``events`` into the index at ``folder``. A batch is a folder of its own, so a replay overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where("error is null").withColumn("updated_at", F.col("received_at"))
        rows.select("resource_name", "content_hash", "source", "bucket", "object_key", "updated_at").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


#: What must differ for a row to be a change.
COMPARED = ("content_hash", "source", "bucket", "object_key")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """UPS-03: the last row of each resource over all batches; ``updated_at`` is that of the first of its last equal rows, so a repeat changes nothing.

    Ties within a batch go to the larger hash.
    """
    rows = spark.read.schema(f"{FIELDS}, batch long").parquet(folder)
    w = Window.partitionBy("resource_name").orderBy("batch", "updated_at", "content_hash")
    # the first row of a resource is a change whatever it holds
    changed = F.row_number().over(w) == 1
    for c in COMPARED:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    rows = rows.withColumn("_since", F.when(changed, F.struct("batch", "updated_at")))
    order = F.struct("batch", "updated_at", "content_hash")
    last = F.max_by(F.struct(*COMPARED), order).alias("_last")
    return rows.groupBy("resource_name").agg(last, F.max("_since").alias("_since")).select("resource_name", *[f"_last.{c}" for c in COMPARED], F.col("_since.updated_at").alias("updated_at"))


def compact(spark: SparkSession, folder: str) -> int:
    """Puts all batches that are there now into one and drops them; returns how many. Readers see the same index before, during and after.

    The new batch gets a number below all others but above earlier ones of its kind, so what arrives meanwhile counts as later.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [p.getPath() for p in fs.listStatus(root) if p.getPath().getName().startswith("batch=")]
    numbers = [int(p.getName().split("=")[1]) for p in old]
    new = max([-(1 << 62), *[n for n in numbers if n < 0]]) + 1
    if not old:
        return 0
    stage = f"{folder}/_compacting"
    index(spark, folder).write.mode("overwrite").parquet(stage)
    fs.rename(jvm.org.apache.hadoop.fs.Path(stage), jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={new}"))
    for p in old:
        fs.delete(p, True)
    return len(old)


def respond(spark: SparkSession, folder: str, method: str, body: str) -> tuple[int, dict]:
    """STM-01: a web hook's answer: 405 for other methods than POST, 400 for what is no event, else 200 with how many records were put for the stream."""
    import json
    import uuid

    from lumenframe.sources.sinks import put_text

    if method != "POST":
        return 405, {"ok": False, "error": "only POST is answered"}
    try:
        payload = json.loads(body)
        records = payload.get("Records") or [payload]
        for r in records:
            s3 = r.get("s3") or {}
            if not ((s3.get("bucket") or {}).get("name") or r.get("bucket") or r.get("Bucket")) or not ((s3.get("object") or {}).get("key") or r.get("key") or r.get("Key")):
                raise ValueError("event without bucket or object key")
    except (ValueError, AttributeError, TypeError) as e:
        return 400, {"ok": False, "error": str(e)}
    put_text(spark, f"{folder.rstrip('/')}/{uuid.uuid4().hex}.json", body)
    return 200, {"ok": True, "processed": len(records)}


def reconcile(index_: DataFrame, objects: DataFrame) -> DataFrame:
    """STM-04: the index after a full listing (same columns): listed objects win, the rest stay."""
    both = index_.withColumn("_new", F.lit(0)).unionByName(objects.select(*index_.columns).withColumn("_new", F.lit(1)))
    newest = Window.partitionBy("resource_name").orderBy(F.desc("_new"), F.desc("updated_at"))
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(*index_.columns)


def item_states(events: DataFrame, keys: list[str], status: str = "status", order: str = "ts") -> DataFrame:
    """STM-07, STM-08: each item's state: completed once is completed for good, else its latest event. Update or complete mode."""
    sticky = F.col(status) == "completed"
    return events.groupBy(*keys).agg(
        F.max_by(status, F.struct(sticky, F.col(order), F.col(status))).alias("status"),
        F.count("*").alias("n_events"),
        F.max(order).alias("last_event"),
    )


def expire(items: DataFrame, now: Column, timeout_s: int = 3600) -> DataFrame:
    """STM-09: claimed or running items whose claim is missing or too old are pending again; a timeout of 0 or less turns it off."""
    if timeout_s <= 0:
        return items
    age = F.unix_timestamp(now) - F.unix_timestamp("claimed_at")
    stale = F.col("status").isin("claimed", "running") & (F.col("claimed_at").isNull() | (age > timeout_s))
    return items.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "claimed_at": F.when(~stale, F.col("claimed_at"))})


def windowed(events: DataFrame, ts: str, late: str, width: str, slide: str | None, *keys: str) -> DataFrame:
    """STM-15: counts in tumbling or sliding windows; rows later than ``late`` are dropped on a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, late: str, gap: str, *keys: str) -> DataFrame:
    """STM-15: counts in sessions that end after ``gap`` without an event."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
