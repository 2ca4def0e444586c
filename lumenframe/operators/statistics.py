"""

Quantiles are exact without a task that holds a whole image: counts in even cells narrow each rank down to one cell, and only the
values of those cells, counted by value, are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096


def finite(v: Column) -> Column:
    """FLT-15: neither null, NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def quantiles(rows: DataFrame, key: str, value: str, shares: list[float], cells: int = CELLS) -> DataFrame:
    """(key, n, lo, hi, q): for each key its quantiles at ``shares`` by linear interpolation, as an array; null values are left out.

    Orders at most ``cells`` rows of a key, and the distinct values of the cells that hold a wanted rank.
    """
    def met(left: DataFrame, right: DataFrame, *more: Column) -> DataFrame:
        """Rows of equal keys (null is a key too) for which ``more`` holds; ``right`` has its key as ``_r``."""
        on = F.col("_k").eqNullSafe(F.col("_r"))
        for m in more:
            on = on & m
        return left.join(right, on).drop("_r")

    given = rows.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    span = given.groupBy(F.col("_k").alias("_r")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    # of a width of 0 all values are in cell 0
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells), F.lit(cells - 1))).otherwise(0).cast("int")
    placed = met(given, span).select("_k", "_v", cell.alias("_c"))
    order = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_k", "_c").agg(F.count("*").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(order), F.lit(0)))
    counts = counts.select(F.col("_k").alias("_r"), "_c", "_before", (F.col("_before") + F.col("_m")).alias("_end"))
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)])
    ranks = span.select(F.col("_r").alias("_k"), "n", F.explode(asked).alias("a")).withColumn("_at", F.col("a.p") * (F.col("n") - 1))
    ranks = ranks.select("_k", "a.i", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"))
    found = met(ranks, counts, F.col("_rank") >= F.col("_before"), F.col("_rank") < F.col("_end")).select("_k", "i", "_at", "_rank", "_c", "_before")
    wanted = found.select(F.col("_k").alias("_r"), F.col("_c").alias("_w"), "_before").distinct()
    values = met(placed, wanted, F.col("_c") == F.col("_w")).groupBy("_k", "_c", "_v", "_before").agg(F.count("*").alias("_m"))
    up_to = Window.partitionBy("_k", "_c").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("_to", F.col("_before") + F.sum("_m").over(up_to)).select(F.col("_k").alias("_r"), F.col("_c").alias("_w"), "_v", (F.col("_to") - F.col("_m")).alias("_from"), "_to")
    hit = met(found, values, F.col("_c") == F.col("_w"), F.col("_rank") >= F.col("_from"), F.col("_rank") < F.col("_to"))
    each = hit.groupBy("_k", "i").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.first("_at").alias("_at"))
    each = each.withColumn("_q", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at")))
    out = each.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "_q"))), lambda x: x["_q"]).alias("q"))
    return met(out, span).select(F.col("_k").alias(key), "n", "lo", "hi", "q")


def image_metrics(volume: DataFrame, geometry: DataFrame | None = None) -> DataFrame:
    """AGG-08: smallest, largest, mean and population deviation of each image; with ``geometry`` (sample_id, n_x.., s_x..) also ``size`` and ``spacing``."""
    v = F.col("value")
    out = volume.groupBy("sample_id").agg(F.min(v).alias("image_min"), F.max(v).alias("image_max"), F.avg(v).alias("image_mean"), F.stddev_pop(v).alias("image_std"))
    if geometry is None:
        return out
    size = F.concat_ws("x", *[F.col(f"n_{a}").cast("string") for a in "xyz"])
    spacing = F.concat_ws("x", *[general(F.col(f"s_{a}")) for a in "xyz"])
    return out.join(geometry.select("sample_id", size.alias("size"), spacing.alias("spacing")), "sample_id", "left")


def general(v: Column, digits: int = 6) -> Column:
    """A number as C's ``%.6g`` writes it: that many significant digits, without zeros at the end."""
    v = v.cast("double")
    power = F.floor(F.log10(F.abs(v))).cast("int")
    plain = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits + 3}f", F.round(v, digits - 1)), r"0+$", ""), r"\.$", "")
    fixed = [F.when(power == p, F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits - 1 - p}f", v), r"(\.\d*?)0+$", "$1"), r"\.$", "")) for p in range(-4, digits)]
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.format_string(f"%.{digits - 1}e", v), r"^(.*)e", 1), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exponent = F.regexp_extract(F.format_string(f"%.{digits - 1}e", v), "(e.*)$", 1)
    return F.when(v == 0, F.lit("0")).otherwise(F.coalesce(*fixed, F.concat(mantissa, exponent), plain))


def mask_metrics(volume: DataFrame, mask: DataFrame, spacing: DataFrame) -> DataFrame:
    """AGG-09, JN-11: each image's metrics with those of its mask: ``mask_voxels``, ``mask_volume`` and the masked values' mean, deviation, range.

    ``mask`` has sample_id, z, y, x, label; ``spacing`` sample_id and s_z, s_y, s_x. Without a mask all are null; an empty mask has 0
    voxels and null values.
    """
    on = volume.join(mask.where("label > 0").select("sample_id", "z", "y", "x").distinct(), ["sample_id", "z", "y", "x"])
    v = F.col("value")
    inside = on.groupBy("sample_id").agg(F.count("*").alias("_n"), F.avg(v).alias("masked_mean"), F.stddev_pop(v).alias("masked_std"), F.min(v).alias("masked_min"), F.max(v).alias("masked_max"))
    has = mask.select("sample_id", F.lit(True).alias("_has")).distinct()
    out = image_metrics(volume).join(has, "sample_id", "left").join(inside, "sample_id", "left").join(spacing, "sample_id", "left")
    n = F.when(F.col("_has"), F.coalesce("_n", F.lit(0).cast("long")))
    out = out.withColumn("mask_voxels", n).withColumn("mask_volume", F.col("mask_voxels") * F.col("s_x") * F.col("s_y") * F.col("s_z"))
    return out.drop("_has", "_n", "s_z", "s_y", "s_x")


def dose_metrics(dose: DataFrame, masks: DataFrame) -> DataFrame:
    """AGG-10, JN-12: for each dose file the whole grid and every region of equal shape: range, mean, deviation and voxels of the scaled dose.

    ``dose``: dose_file, z, y, x, pixel, scaling; ``masks``: roi, z, y, x (voxels of the region) and n_z, n_y, n_x (its grid). Regions may
    overlap or leave voxels out, so the whole grid is no sum over them. Every dose meets every mask of its shape through the voxels that
    both have, never through a product of tables; a region without a voxel in common has no row.
    """
    scaled = dose.withColumn("value", F.col("pixel") * F.coalesce("scaling", F.lit(1.0)))
    v = F.col("value")
    agg = [F.min(v).alias("dose_min"), F.max(v).alias("dose_max"), F.avg(v).alias("dose_mean"), F.stddev_pop(v).alias("dose_std"), F.count("*").alias("dose_voxels")]
    whole = scaled.groupBy("dose_file").agg(*agg).select("dose_file", F.lit("whole_grid").alias("roi"), "dose_min", "dose_max", "dose_mean", "dose_std", "dose_voxels")
    shape = scaled.groupBy("dose_file").agg(*[(F.max(a) + 1).alias(f"n_{a}") for a in "zyx"])
    grid = scaled.join(shape, "dose_file")
    inside = grid.join(masks.select("roi", "z", "y", "x", "n_z", "n_y", "n_x").distinct(), ["z", "y", "x", "n_z", "n_y", "n_x"])
    return whole.unionByName(inside.groupBy("dose_file", "roi").agg(*agg))


def plan_summary(plans: DataFrame) -> DataFrame:
    """AGG-11: ``plans`` (plan_file, beams array, fractions array of numbers) with counts; a missing number of fractions counts as 0."""
    count = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    total = F.aggregate(F.coalesce("fractions", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return plans.select("plan_file", count("beams").alias("n_beams"), count("fractions").alias("n_fraction_groups"), total.alias("n_fractions"))


def embeddings(volume: DataFrame, bins: int = 32) -> DataFrame:
    """AGG-12, VOX-18: (sample_id, vector): mean, deviation, range, deciles and size of the clipped values and their density histogram, of length 1.

    Values are clipped to their 1st and 99th percentile, or to their range where these are equal; a width of 0 becomes 1. Values that are
    not finite are left out; an image without others counts as one voxel of 0.
    """
    key, v = "sample_id", F.col("value").cast("double")
    every = volume.select(key).distinct()
    good = volume.select(key, v.alias("value")).where(finite(F.col("value")))
    good = good.unionByName(every.join(good.select(key).distinct(), key, "left_anti").withColumn("value", F.lit(0.0)))
    q = quantiles(good, key, "value", [0.01, 0.99])
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    b = q.select(key, "n", F.when(high > low, low).otherwise(F.col("lo")).alias("a"), F.when(high > low, high).otherwise(F.col("hi")).alias("z"))
    b = b.withColumn("z", F.when(F.col("z") > F.col("a"), F.col("z")).otherwise(F.col("a") + 1.0))
    clipped = good.join(b, key).withColumn("value", F.least(F.greatest("value", "a"), "z"))
    deciles = quantiles(clipped, key, "value", [0.1, 0.5, 0.9]).select(key, "q")
    cell = F.least(F.floor((F.col("value") - F.col("a")) / (F.col("z") - F.col("a")) * bins), F.lit(bins - 1)).cast("int")
    counts = [F.count_if(cell == i).cast("double").alias(f"h{i}") for i in range(bins)]
    c = F.col("value")
    stats = clipped.groupBy(key).agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("z").alias("z"), *counts)
    width = (F.col("z") - F.col("a")) / bins
    parts = [F.col("m"), F.col("s"), F.col("lo"), F.col("hi"), *[F.get("q", F.lit(i)) for i in range(3)], F.col("n").cast("double"), *[F.col(f"h{i}") / (F.col("n") * width) for i in range(bins)]]
    out = stats.join(deciles, key).select(key, F.array(*parts).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return out.withColumn("_norm", norm).select(key, F.when(F.col("_norm") > 0, F.transform("_v", lambda x: x / F.col("_norm"))).otherwise(F.col("_v")).alias("vector"))


def widened(vectors: DataFrame, dimensions: int) -> DataFrame:
    """ARR-03: the vector as columns ``emb_000`` ..."""
    return vectors.select(*[c for c in vectors.columns if c != "vector"], *[F.get("vector", F.lit(i)).alias(f"emb_{i:03d}") for i in range(dimensions)])


def middle_slices(volume: DataFrame) -> DataFrame:
    """MTH-05, ARR-04: the middle slice of each image, rescaled to 0..1 between its 1st and 99th percentile (or its range, or a width of 1)."""
    depth = volume.groupBy("sample_id").agg(F.floor((F.max("z") + 1) / 2).cast("int").alias("_mid"))
    rows = volume.join(depth, "sample_id").where("z = _mid").drop("_mid")
    q = quantiles(rows.where(finite(F.col("value"))), "sample_id", "value", [0.01, 0.99])
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    b = q.select("sample_id", F.when(high > low, low).otherwise(F.col("lo")).alias("_a"), F.when(high > low, high).otherwise(F.col("hi")).alias("_z"))
    b = b.withColumn("_z", F.when(F.col("_z") > F.col("_a"), F.col("_z")).otherwise(F.col("_a") + 1.0))
    share = (F.least(F.greatest("value", "_a"), "_z") - F.col("_a")) / (F.col("_z") - F.col("_a"))
    return rows.join(b, "sample_id").withColumn("value", share).drop("_a", "_z")


def tissue_fraction(tiles: DataFrame, *keys: str, darkness: float = 0.08) -> DataFrame:
    """AGG-13: for each tile the share of pixels (r, g, b in 0..255) that are darker than ``darkness``."""
    dark = 1.0 - (F.col("r") + F.col("g") + F.col("b")) / 3.0 / 255.0
    return tiles.groupBy(*keys).agg(F.avg(F.when(dark > darkness, 1.0).otherwise(0.0)).alias("tissue_fraction"))


def tissue_tiles(fractions: DataFrame, least: float = 0.10, most: int = 2048) -> DataFrame:
    """FLT-10, LIM-04: tiles (slide_id, y, x, tissue_fraction) with tissue enough, the first ``most`` over all slides in (slide_id, y, x) order.

    A slide without a tile still has a row, whose y and x are null. Each task sorts its own rows; only ``most`` of each go on.
    """
    kept = fractions.where(F.col("tissue_fraction") >= least).orderBy("slide_id", "y", "x").limit(most)
    bare = fractions.select("slide_id").distinct().join(kept.select("slide_id").distinct(), "slide_id", "left_anti")
    return kept.unionByName(bare, allowMissingColumns=True)
