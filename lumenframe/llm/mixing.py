"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put in a fixed pseudo-random order and cut into blocks of equal bytes. The i-th block of a
source of weight w has the release time floor((i - 1) / w) and the deadline ceil(i / w); at every slot the released block
with the earliest deadline goes next. At any slot every source has had its weight times the slots so far, within less than
one block. Weights are exact fractions and every slot of the mix is scheduled (on the driver, from the sources' sizes alone).

The mix ends when the source that has most bytes for its weight has been used once; the others start over as often as their
weights ask (``epoch`` counts). By then each source has had all its blocks but for one at most that is not due yet: it goes
with the last slot, so no document is lost. Default weights are shares of the bytes to the power ``temperature``, which
lifts small sources.

A hot source is numbered in cells of the documents' hashes with partial sums, so no task holds a source. The number of
sources must be moderate (they are listed on the driver).

Defined results: a null source is a source of its own; null texts weigh one byte; ties of hash are ordered by doc_id, then by a hash of the text; an
empty table gives an empty mix; extra columns stay, but for those with the names of the four new ones, which are replaced.
"""

from __future__ import annotations

from array import array
from fractions import Fraction
from heapq import heappop, heappush
from math import lcm

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, tidy

BLOCK_BYTES = 1 << 17
#: Rows of a schedule or plan that are broadcast; a longer one is joined as Spark chooses. Rows in a cell of a source.
BROADCAST_SLOTS, CELL_ROWS = 1 << 20, 50_000


def quotas(weights: dict) -> dict:
    """The weights as whole numbers: a source's weight is exactly its number over the sum of all."""
    names = sorted((s for s in weights if weights[s] > 0), key=lambda s: (s is not None, s or ""))
    exact = {s: Fraction(str(weights[s])) for s in names}
    unit = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * unit) for s, x in exact.items()}


def schedule(quota: dict, slots: int | None = None) -> list:
    """The source of each slot (of one period, if ``slots`` is not given): earliest deadline first among the released blocks."""
    total, names = sum(quota.values()), list(quota)
    share = list(quota.values())
    coming = [(0, k, 1) for k in range(len(names))]  # release, source and number of each source's next block
    ready: list = []
    out = []
    for t in range(total if slots is None else slots):
        while coming and coming[0][0] <= t:
            _, k, i = heappop(coming)
            # block i may run from floor((i - 1) / w) and must have run by ceil(i / w)
            end = -(-i * total // share[k])
            overlaps = i * total % share[k] != 0  # its window reaches into the next block's: the tie goes to it
            heappush(ready, (end, not overlaps, k))
            heappush(coming, (i * total // share[k], k, i + 1))
        out.append(names[heappop(ready)[2]])
    return out


def mix(docs: DataFrame, weights: dict | None = None, temperature: float = 0.7, block_bytes: int = BLOCK_BYTES, text: str = "text", source: str = "source", doc_id: str = "doc_id", size: str | None = None, n_rows: int | None = None) -> DataFrame:
    """``docs`` once for each use, with ``block``, ``epoch`` and ``slot`` (all from 0) and ``target_weight``.

    ``size``: a column of the documents' bytes, if not those of ``text``. ``n_rows``: how many rows ``docs`` has, if that is known.
    """
    spark = docs.sparkSession
    bytes_ = F.col(size) if size else (F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) + 1).cast("long")
    # own columns have names that no table's column has
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)], bytes_.alias("_size"), F.xxhash64(F.col(doc_id).cast("long"), F.lit(17)).alias("_h"), F.xxhash64(F.col(text), F.lit(18)).alias("_tie"), F.col(doc_id).alias("_id"), F.col(source).cast("string").alias("_src"))
    n = docs.count() if n_rows is None else n_rows
    # cells of about CELL_ROWS rows, if one source had them all
    bits = min(max(8, (n // CELL_ROWS).bit_length()), 20)
    rows = rows.withColumn("_cell", F.shiftrightunsigned("_h", 64 - bits).cast("int"))
    cells = staged(rows.groupBy("_src", "_cell").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_docs")), "mix-cells")
    totals = {r["_src"]: (r["b"], r["n"]) for r in cells.groupBy("_src").agg(F.sum("_bytes").alias("b"), F.sum("_docs").alias("n")).collect()}
    if weights is None:
        weights = {s: b**temperature for s, (b, _) in totals.items()}
    weights = {s: w for s, w in weights.items() if s in totals}
    if not weights:
        return docs.limit(0).drop("block", "epoch", "slot", "target_weight").select("*", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("slot"), F.lit(0.0).alias("target_weight"))
    quota = quotas(weights)
    total = sum(quota.values())
    blocks = {s: max(1, -(-totals[s][0] // block_bytes)) for s in quota}
    # slots until the source that has most bytes for its weight has been used once
    slots = max(1, *(-(-totals[s][0] * total // (quota[s] * block_bytes)) for s in quota))
    number = {s: k for k, s in enumerate(quota)}
    places = {s: array("q") for s in quota}
    for t, s in enumerate(schedule(quota, slots)):
        places[s].append(t)
    for s in quota:
        if len(places[s]) < blocks[s]:  # its last block is not due yet
            places[s].append(slots - 1)
    plan = spark.createDataFrame([(s, number[s], blocks[s], len(places[s]), quota[s] / total) for s in quota], "_src string, _k long, _blocks long, _uses long, target_weight double")
    # bytes of the source before each cell: at most 2 ** bits rows for each source
    before = cells.select("_src", "_cell", (F.sum("_bytes").over(Window.partitionBy("_src").orderBy("_cell")) - F.col("_bytes")).alias("_before"))
    start = before.join(_small(plan, len(quota)), before["_src"].eqNullSafe(plan["_src"])).drop(plan["_src"])
    inside = Window.partitionBy("_src", "_cell").orderBy("_h", "_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_off", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    cell, src = start["_cell"], start["_src"]
    joined = numbered.join(_small(start, len(quota) << bits), numbered["_src"].eqNullSafe(src) & (numbered["_cell"] == cell)).drop(src, cell)
    joined = joined.withColumn("_block", F.expr(f"(_before + _off) div {block_bytes}"))
    use = joined.withColumn("_epoch", F.explode(F.expr("sequence(0L, greatest(0L, (_uses - 1 - _block) div _blocks))")))
    use = use.withColumn("_place", F.shiftleft("_k", 40) + F.col("_block") + F.col("_epoch") * F.col("_blocks"))
    order = _places(spark, [places[s] for s in quota])
    own = {"block": "_block", "epoch": "_epoch", "slot": "slot", "target_weight": "target_weight"}
    kept = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in own]
    return use.join(_small(order, slots), "_place").select(*kept, *[F.col(c).alias(x) for x, c in own.items()])


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for a broadcast if it has few rows; else Spark chooses."""
    return F.broadcast(df) if rows <= BROADCAST_SLOTS else df


def _places(spark: SparkSession, places: list[array]) -> DataFrame:
    """(_place, slot): the slot of each source's i-th block, under the source's number in the high bits and i in the low 40."""
    import numpy as np
    import pyarrow as pa

    keys = np.concatenate([np.arange(len(p), dtype=np.int64) + (k << 40) for k, p in enumerate(places)])
    slots = np.concatenate([np.frombuffer(p, np.int64) for p in places])
    return spark.createDataFrame(pa.table({"_place": keys, "slot": slots}), "_place long, slot long")


def op9(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "source", "block", "epoch", "slot", "target_weight")


def _squeezed(docs: DataFrame, pack: bool) -> DataFrame:
    """Texts as compressed bytes in ``_text``, or back again."""

    def run(batches):
        import pyarrow as pa

        from .blocks import unzip_bytes, zip_bytes

        for b in batches:
            at = b.schema.names.index("_text")
            old = b.column(at).cast(pa.binary()).to_pylist()
            new = [None if x is None else zip_bytes(x, 3) if pack else unzip_bytes(x) for x in old]
            column = pa.array(new, pa.binary()) if pack else pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    kinds = ", ".join(f"`{f.name}` {('binary' if pack else 'string') if f.name == '_text' else f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), kinds)


def stage(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: the mix in the order of its slots, with the columns of documents. Texts are exchanged compressed."""
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest")
    size = (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("_bytes")
    rows = _squeezed(docs.select(rest, F.col("text").alias("_text"), "doc_id", "source", size), True)
    mixed = mix(rows, text="_text", size="_bytes", n_rows=docs.count()).repartitionByRange("slot", "doc_id").sortWithinPartitions("slot", "epoch", "doc_id")
    back = _squeezed(mixed.select("_rest", "_text"), False)
    return back.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])
