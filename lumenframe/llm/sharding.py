"""Sharding into parts of near equal bytes by histogram sort, in built-in functions only.

Rows are ordered by (hash of the text, hash of doc_id and row), so equal texts stand together and part only where a shard's end
falls inside a group, whatever the ids are. Splitters are found as in histogram sort: every round counts the exact bytes below candidate boundaries,
in one pass over the keys with partial sums on each partition, keeps for each splitter the interval that holds its target
and probes that interval more finely, until every splitter is within the tolerance or the interval is a single key.
Intervals of one hash (a large group of copies) are refined on the second hash in the same way. Then rows are exchanged once.

What reaches the driver is one number for each probe (1,024 in the first round, then 64 for each unsettled splitter) and one for
each piece of about ``PIECE_ROWS`` rows (a million at most). Keys (two hashes, id, size) are written to the shared folder once, so that texts are read only once for the search.

Defined results: a null text has size 1 and the crc of the empty text; null, repeated and extreme doc_ids are ids like others;
rows that are equal in every respect are told apart by their place in the written keys; an empty table gives an empty result; extra
columns stay with ``shard_documents``.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: A position in the order: (hash of the text, hash of id and row). Positions are compared as pairs.
LOW, END = -(2**63), 2**63
#: Rows in a piece on average, and the least and most bits of the hash that number the pieces' cells.
PIECE_ROWS, BITS = 50_000, (10, 20)


def keyed_columns(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    body = F.coalesce(F.col(text), F.lit(""))
    return [
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("h"),
        F.xxhash64(F.col(doc_id), F.monotonically_increasing_id()).alias("k"),
    ]


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, h, k); to be written before it is used more than once, as ``k`` numbers the rows."""
    return docs.select(*keyed_columns(text, doc_id))


def _at_or_above(h: int, k: int) -> Column:
    return (F.col("h") > F.lit(h)) | ((F.col("h") == F.lit(h)) & (F.col("k") >= F.lit(k)))


def _cell(bits: int) -> Column:
    """The first ``bits`` bits of the hash as a number from 0."""
    return (F.shiftright("h", 64 - bits) + (1 << (bits - 1))).cast("int")


def _cell_start(cell: int, bits: int) -> tuple[int, int]:
    return ((cell - (1 << (bits - 1))) << (64 - bits), LOW)


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.002, probes: int = 63, bits: int = 10, max_rounds: int = 64) -> list[tuple[int, int]]:
    """``shards - 1`` positions such that the bytes below the i-th are within ``tolerance`` of a shard of ``i / shards`` of all, or one row off.

    The first round counts bytes below ``2 ** bits`` even boundaries of the hash; each later round counts, inside the
    intervals that hold unsettled targets, below ``probes`` even boundaries of the hash or, inside one hash, of the second one.
    """
    known: dict[tuple[int, int], tuple[int, int]] = {(LOW, LOW): (0, 0)}  # (bytes, rows) below a position, exact
    size = rows = 0
    got = {r[0]: (r[1], r[2]) for r in keys.groupBy(_cell(bits).alias("b")).agg(F.sum("size"), F.count("*")).collect()}
    for c in range(1 << bits):
        known[_cell_start(c, bits)] = (size, rows)
        size, rows = size + got.get(c, (0, 0))[0], rows + got.get(c, (0, 0))[1]
    known[END, LOW] = (size, rows)
    total = size
    if not rows:
        return [(LOW, LOW)] * (shards - 1)
    chosen: dict[int, tuple[int, int]] = {}
    for _ in range(max_rounds):
        ordered = sorted(known)
        amounts = [known[p][0] for p in ordered]
        intervals: list[tuple[tuple[int, int], tuple[int, int], int]] = []
        for i in range(1, shards):
            if i in chosen:
                continue
            at = bisect_right(amounts, total * i / shards) - 1
            lo, hi = ordered[at], ordered[min(at + 1, len(ordered) - 1)]
            near = min((lo, hi), key=lambda p: abs(known[p][0] - total * i / shards))
            if abs(known[near][0] - total * i / shards) <= tolerance * total / shards or known[hi][1] - known[lo][1] <= 1:
                chosen[i] = near
            elif hi[0] - lo[0] > 1 and lo[1] == LOW:
                intervals.append((lo, hi, max(1, (hi[0] - lo[0]) // (probes + 1))))
            else:  # one hash: from here on the second one
                top = hi[1] if hi[0] == lo[0] else END
                if top - lo[1] > 1:
                    intervals.append((lo, (lo[0], top), max(1, (top - lo[1]) // (probes + 1))))
                else:
                    chosen[i] = near
        intervals = sorted(set(intervals))
        if not intervals:
            break
        where = F.lit(None).cast("long")
        for j, (lo, hi, step) in reversed(list(enumerate(intervals))):
            axis = "k" if lo[0] == hi[0] else "h"
            a, z = (lo[1], hi[1]) if axis == "k" else (lo[0], hi[0])
            inside = F.col(axis).between(F.lit(a), F.lit(z - 1)) & ((F.col("h") == F.lit(lo[0])) if axis == "k" else F.lit(True))
            # the width of the whole range is too large for a long
            cell = F.expr(f"cast((cast({axis} AS decimal(20,0)) - ({a})) AS decimal(20,0)) div {step}") if z - a > END else F.expr(f"({axis} - ({a}L)) div {step}L")
            where = F.when(inside, cell + F.lit(j * 4 * (probes + 1)).cast("long")).otherwise(where)
        counted = keys.withColumn("b", where).where("b is not null").groupBy("b").agg(F.sum("size"), F.count("*")).collect()
        got = {r[0]: (r[1], r[2]) for r in counted}
        for j, (lo, hi, step) in enumerate(intervals):
            base = lo if lo in known else (lo[0], LOW)
            size, rows = known[base]
            axis = 1 if lo[0] == hi[0] else 0
            known[lo] = (size, rows)
            for c in range(-(-(hi[axis] - lo[axis]) // step)):
                x = lo[axis] + c * step
                known[(lo[0], x) if axis else (x, LOW)] = (size, rows)
                more = got.get(j * 4 * (probes + 1) + c, (0, 0))
                size, rows = size + more[0], rows + more[1]
            known[hi if axis == 0 or hi[1] < END else (lo[0] + 1, LOW)] = (size, rows)
    if len(chosen) < shards - 1:
        raise RuntimeError("splitters did not settle")
    return [chosen[i] for i in range(1, shards)]


def _shard(cuts: list[tuple[int, int]]) -> Column:
    """How many of the splitters are at or below the row."""
    out = F.lit(0)
    for h, k in cuts:
        if h == END:  # no row is there
            continue
        out = out + _at_or_above(h, k).cast("int")
    return out


def assign(keys: DataFrame, shards: int = 16, tolerance: float = 0.002, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``keys`` with ``law``, ``shard``, ``slot`` and ``grown_shard``.

    Rows are numbered in pieces, so that no task holds a whole shard: a piece is a shard's part of one of ``2 ** bits``
    cells of the hash, and a cell whose most frequent hash is far above the mean is parted by the second hash inside that hash. A slot is
    the row's number in its piece plus the rows of the shard's earlier pieces; the pieces' counts are a table of one row for each piece,
    which is broadcast.
    """
    spark = keys.sparkSession
    n = keys.count()
    bits = min(max(BITS[0], (n // piece_rows).bit_length()), BITS[1])
    cuts = splitters(keys, shards, tolerance)
    cells = {r[0]: r[1] for r in keys.groupBy(_cell(bits).alias("c")).count().collect()}
    heavy = [c for c, m in cells.items() if m > max(1000, 4 * n / (1 << bits))]
    placed = keys.withColumn("shard", _shard(cuts)).withColumn("_cell", _cell(bits))
    piece = F.lit(0)
    if heavy:
        hashes = keys.where(_cell(bits).isin(heavy)).groupBy(_cell(bits).alias("c"), "h").count()
        top = hashes.groupBy("c").agg(F.max_by("h", F.struct("count", "h")).alias("h"), F.max("count").alias("m")).collect()
        for c, h, m in top:
            deal = min(16, max(4, (m // piece_rows).bit_length()))  # bits of the second hash
            inside = F.when(F.col("h") < F.lit(h), 0).when(F.col("h") == F.lit(h), (F.shiftright("k", 64 - deal) + (1 << (deal - 1)) + 1).cast("int")).otherwise((1 << deal) + 1)
            piece = F.when(F.col("_cell") == c, inside).otherwise(piece)
    placed = placed.withColumn("_piece", piece)
    key = ["shard", "_cell", "_piece"]
    counts = placed.groupBy(*key).count().orderBy(*key).collect()
    rows, seen = [], {}
    for s, c, p, m in counts:
        rows.append((s, c, p, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + m
    offsets = spark.createDataFrame(rows, "shard int, _cell int, _piece int, _before long")
    # one exchange, by piece
    order = Window.partitionBy(*key).orderBy("h", "k", "size", "text_crc32")
    numbered = placed.withColumn("_n", (F.row_number().over(order) - 1).cast("long"))
    return (
        numbered.join(F.broadcast(offsets), key)
        .withColumn("slot", F.col("_n") + F.col("_before"))
        .withColumn("law", F.lit("bytes"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .drop("_cell", "_piece", "_n", "_before")
    )


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.002, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents themselves, exchanged once by (shard, cell of the hash), with ``shard``, which replaces a column of that name."""
    rows = staged(docs.select(F.struct("*").alias("_row"), *[F.col(c).alias(f"_{c}") for c in {text, doc_id}]).select("_row", *keyed_columns(f"_{text}", f"_{doc_id}")), "shard-rows")
    cuts = splitters(rows, shards, tolerance)
    out = rows.withColumn("_shard", _shard(cuts)).repartition("_shard", _cell(6)).sortWithinPartitions("_shard", "h", "k")
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "shard"]
    return out.select(*kept, F.col("_shard").alias("shard"))


COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def op6(docs: DataFrame) -> DataFrame:
    return assign(staged(keyed(docs.select("doc_id", "text")), "shard-keys")).select(*COLUMNS)
