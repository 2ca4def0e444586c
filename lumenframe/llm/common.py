"""What the operators of this sub-package share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space of the word definition, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"
#: The same as single characters.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where it is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    set_already = sc.getCheckpointDir()
    if set_already:
        return set_already
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lumenframe-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir()


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenframe/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """``staged``, in as many buckets of ``key`` as there are shuffle partitions: what is joined on the key then moves to it, and it stays.

    The table is known to the session's catalog under a name of its own; its files are in the shared folder.
    """
    spark = df.sparkSession
    unique = uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/lumenframe/{name}-{unique}", f"lumenframe_{name.replace('-', '_')}_{unique}"
    n = min(partitions_for(spark), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    df.write.bucketBy(n, key).option("path", path).option("compression", "uncompressed").saveAsTable(table, format="parquet")
    return spark.table(table)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def partitions_for(spark: SparkSession, at_least: int = 1) -> int:
    """The number of shuffle partitions that the session is set to."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: What empties the tables that modules keep in a worker.
FORGET: list[Callable[[], object]] = []


def release() -> None:
    """Gives memory that a worker no longer uses back to the system; workers stay alive between tasks and operators."""
    import ctypes

    import pyarrow as pa

    for forget in FORGET:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for one partition; what it has used is released at the end.

    An empty batch comes last, so that the last of ``run``'s, which may hold all of its input's, is let go of before that.
    """

    def whole(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made = None
        for made in run(batches):
            yield made
        if made is not None:
            made = pa.RecordBatch.from_pylist([], made.schema)
            yield made
        release()

    return whole


_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def other_columns(docs: DataFrame, text: str = "text") -> tuple[Column, Callable[[str], Column], dict[str, str]]:
    """All columns but the text as one JSON string, the way back to a struct, and each column's field there.

    Fields have names of their own (``c0`` ...), so that no table's column clashes; ``none`` marks null texts.
    """
    fields = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text}
    columns = [*[F.col(f"`{c}`").alias(f) for c, f in fields.items()], F.col(text).isNull().alias("none")]
    schema = docs.select(*columns).schema
    return F.to_json(F.struct(*columns), _JSON), lambda packed: F.from_json(packed, schema, _JSON), fields
