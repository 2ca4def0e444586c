"""

Masks hold their foreground voxels only, so the grid around them is background without end: closing and opening need no
padding. All but ``connected_components`` are built-in functions; that one gets one volume a group, which is bounded by
the scanner and not by the number of samples.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S

AXES = ("z", "y", "x")
KEY = ("sample_id", *AXES)


#: One radius for all axes, or one each in (z, y, x) order.
Radius = int | tuple[int, int, int]


def ball(radius: Radius) -> list[tuple[int, int, int]]:
    """Offsets in the ellipsoid of half axes ``radius + 0.5``, the voxel itself included: 19 of them for a radius of 1."""
    radii = (radius,) * 3 if isinstance(radius, int) else radius
    inside = lambda o: sum((d / (r + 0.5)) ** 2 for d, r in zip(o, radii, strict=True)) <= 1 + 1e-12
    return [o for o in product(*[range(-r, r + 1) for r in radii]) if inside(o)]


def _neighbours(mask: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    near = F.explode(F.array(*[F.struct(*[(F.col(a) + d).alias(a) for a, d in zip(AXES, o, strict=True)]) for o in offsets])).alias("near")
    return mask.select("sample_id", near).select("sample_id", *[f"near.{a}" for a in AXES])


def _widths(radius: Radius) -> dict[tuple[int, int], int]:
    """How far the ball reaches along x from its middle, by (dz, dy)."""
    out: dict[tuple[int, int], int] = {}
    for dz, dy, dx in ball(radius):
        out[dz, dy] = max(out.get((dz, dy), 0), dx)
    return out


def _words(mask: DataFrame, margin: int) -> DataFrame:
    """(sample_id, z, y, _w, _b): 64 voxels of a line of x as bits, ``margin`` of them at each end shared with the next words; x of null has a word of null."""
    n = 64 - 2 * margin
    x = F.col("x").cast("long") + n // 2  # a narrow grid from 0 on lies in one word
    word = lambda at: F.call_function("div", at - F.pmod(at, F.lit(n)), F.lit(n))
    rows = mask.select("sample_id", "z", "y", x.alias("x"), F.explode_outer(F.sequence(word(x - margin), word(x + margin))).alias("_w"))
    bit = F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("x") - F.col("_w") * n + margin).cast("int")), F.lit(-1).cast("long"))
    return rows.groupBy("sample_id", "z", "y", "_w").agg(F.bit_or(bit).alias("_b"))


def _moved(words: DataFrame, radius: Radius, every: bool) -> DataFrame:
    """The words after a dilation, or with ``every`` an erosion; the outermost bits, as many as the radius along x, are no longer right."""
    widths = _widths(radius)

    def along(width: int) -> Column:
        b = F.col("_b")
        for d in range(1, width + 1):
            for moved in (F.shiftleft("_b", d), F.shiftrightunsigned("_b", d)):
                b = b.bitwiseAND(moved) if every else b.bitwiseOR(moved)
        return b

    lines = [F.struct((F.col("z") + dz).alias("z"), (F.col("y") + dy).alias("y"), along(w).alias("_b")) for (dz, dy), w in widths.items()]
    # lines that lie together meet in one task, so that most of what they send to each other is put together before it is exchanged
    words = words.repartition("sample_id", F.floor(F.col("z") / 16), F.floor(F.col("y") / 64), "_w")
    near = words.select("sample_id", "_w", F.explode(F.array(*lines)).alias("l")).select("sample_id", "l.z", "l.y", "_w", "l._b").where("_b <> 0")
    groups = near.groupBy("sample_id", "z", "y", "_w")
    if not every:
        return groups.agg(F.bit_or("_b").alias("_b"))
    return groups.agg(F.bit_and("_b").alias("_b"), F.count("*").alias("_n")).where((F.col("_n") == len(widths)) & (F.col("_b") != 0)).drop("_n")


def _voxels(words: DataFrame, margin: int, mask: DataFrame) -> DataFrame:
    n = 64 - 2 * margin
    bits = F.filter(F.sequence(F.lit(margin), F.lit(margin + n - 1)), lambda i: F.call_function("shiftright", F.col("_b"), i).bitwiseAND(F.lit(1)) == 1)
    kind = mask.schema["x"].dataType
    at = F.when(F.col("_w").isNull(), F.array(F.lit(None).cast(kind))).otherwise(F.transform(bits, lambda i: (F.col("_w") * n + i - margin - n // 2).cast(kind)))
    return words.select("sample_id", "z", "y", F.explode(at).alias("x"))


def _morphed(mask: DataFrame, radius: Radius, *steps: bool) -> DataFrame:
    """Dilations (False) and erosions (True) one after the other, on words of 64 voxels so that a voxel is no row of its own between them."""
    margin = len(steps) * max(_widths(radius).values())
    if margin > 16:  # the words would mostly be margin
        for every in steps:
            near = _neighbours(mask.select(*KEY).distinct(), ball(radius))
            mask = near.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") == len(ball(radius))).select(*KEY) if every else near.distinct()
        return mask
    words = _words(mask, margin)
    for every in steps:
        words = _moved(words, radius, every)
    return _voxels(words, margin, mask)


def dilate(mask: DataFrame, radius: Radius = 1) -> DataFrame:
    """VOX-04: voxels whose ball meets the mask."""
    return _morphed(mask, radius, False)


def erode(mask: DataFrame, radius: Radius = 1) -> DataFrame:
    """VOX-04: voxels whose whole ball lies in the mask."""
    return _morphed(mask, radius, True)


def closing(mask: DataFrame, radius: Radius = 1) -> DataFrame:
    return _morphed(mask, radius, False, True)


def opening(mask: DataFrame, radius: Radius = 1) -> DataFrame:
    return _morphed(mask, radius, True, False)


def connected_components(mask: DataFrame, min_voxels: int = 1, max_components: int | None = 1, keys: tuple[str, ...] = ("sample_id",), corners: bool = False) -> DataFrame:
    """VOX-03: connected components of each group of ``keys``, numbered from 1 by size; ties go by the first voxel in (z, y, x) order.

    Voxels are joined by faces, with ``corners`` by edges and corners too.
    """
    steps = [o for o in product((0, 1), (-1, 0, 1), (-1, 0, 1)) if o > (0, 0, 0) and (corners or sum(map(abs, o)) == 1)]

    def label(part):
        import numpy as np
        import pandas as pd

        part = part.sort_values(list(AXES)).drop_duplicates(list(AXES))
        at = part[list(AXES)].to_numpy(np.int64)
        at -= at.min(axis=0)
        size = at.max(axis=0) + 2  # one voxel of room, so that a step past the edge meets no voxel of the next line
        code = (at[:, 0] * size[1] + at[:, 1]) * size[2] + at[:, 2]
        edges = []
        for step in ((dz * size[1] + dy) * size[2] + dx for dz, dy, dx in steps):
            to = np.searchsorted(code, code + step)
            found = np.flatnonzero(np.append(code, -1)[to] == code + step)
            edges.append((found, to[found]))
        a, b = (np.concatenate(e) for e in zip(*edges, strict=True))
        root = np.arange(len(code))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        first, inverse, counts = np.unique(root, return_inverse=True, return_counts=True)
        order = np.lexsort((first, -counts))
        rank = np.empty(len(first), np.int64)
        rank[order] = np.arange(1, len(first) + 1)
        label, n = rank[inverse], counts[inverse]
        keep = (n >= min_voxels) & ((label <= max_components) if max_components else True)
        return pd.DataFrame({**{k: part[k] for k in keys}, "z": part["z"], "y": part["y"], "x": part["x"], "component": label, "n_voxels": n})[keep]

    kinds = ", ".join(f"{k} {mask.schema[k].dataType.simpleString()}" for k in keys)
    rows = mask.select(*keys, *[F.col(a).cast("int").alias(a) for a in AXES])
    return rows.groupBy(*keys).applyInPandas(label, f"{kinds}, z int, y int, x int, component long, n_voxels long")


def boxes(mask: DataFrame, *keys: str) -> DataFrame:
    """AGG-14: the bounding box of each group."""
    return mask.groupBy(*(keys or ("sample_id",))).agg(*[f(a).alias(f"{p}_{a}") for a in AXES for p, f in (("lo", F.min), ("hi", F.max))])


def crop_to_mask(volume: DataFrame, mask: DataFrame) -> DataFrame:
    """VOX-09: the volume inside its mask's box, counted from 0 again; a sample with an empty mask stays whole."""
    rows = volume.join(boxes(mask), "sample_id", "left")
    inside = [F.col("lo_z").isNull() | F.col(a).between(F.col(f"lo_{a}"), F.col(f"hi_{a}")) for a in AXES]
    moved = {a: F.col(a) - F.coalesce(F.col(f"lo_{a}"), F.lit(0)) for a in AXES}
    return rows.where(inside[0] & inside[1] & inside[2]).withColumns(moved).select(*volume.columns)


def center_crop(volume: DataFrame, sizes: DataFrame, crop: tuple[int, int, int]) -> DataFrame:
    """VOX-09 and MTH-04: ``crop`` voxels around the centre; ``sizes`` has ``sample_id, n_z, n_y, n_x``."""
    rows = volume.join(sizes, "sample_id")
    start = {a: F.greatest(F.lit(0), F.floor((F.col(f"n_{a}") - c) / 2)).cast("int") for a, c in zip(AXES, crop, strict=True)}
    for a, c in zip(AXES, crop, strict=True):
        rows = rows.where((F.col(a) >= start[a]) & (F.col(a) < start[a] + c))
    return rows.withColumns({a: F.col(a) - start[a] for a in AXES}).select(*volume.columns)


def resample_linear(volume: DataFrame, geometry: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """VOX-07: trilinear values on the grid of ``spacing``; ``geometry`` has ``sample_id, n_z.., s_z..`` (size and spacing).

    Each new voxel asks for its eight corners by key, so no volume is gathered. Beyond half a voxel past the last
    centre the value is 0; within that margin the last centre counts.
    """
    grid = geometry
    for a, s in zip(AXES, spacing, strict=True):
        size = S.resample_size(F.col(f"n_{a}"), F.col(f"s_{a}"), F.lit(s))
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), size - 1)))
        at = F.col(a) * F.lit(s) / F.col(f"s_{a}")
        last = F.col(f"n_{a}") - 1
        grid = grid.withColumn(f"in_{a}", at <= last + 0.5).withColumn(f"at_{a}", F.least(at, last.cast("double")))
    inside = F.col("in_z") & F.col("in_y") & F.col("in_x")

    def corner(bits) -> Column:
        weight = F.lit(1.0)
        for a, up in zip(AXES, bits, strict=True):
            part = F.col(f"at_{a}") - F.floor(f"at_{a}")
            weight = weight * (part if up else 1.0 - part)
        cell = [(F.floor(f"at_{a}") + up).cast("int").alias(f"c_{a}") for a, up in zip(AXES, bits, strict=True)]
        return F.struct(*cell, weight.alias("weight"))

    asked = grid.select(*KEY, inside.alias("inside"), F.explode(F.array(*[corner(b) for b in product((0, 1), repeat=3)])).alias("c"))
    asked = asked.select(*KEY, "inside", *[F.col(f"c.c_{a}") for a in AXES], F.col("c.weight"))
    given = volume.select("sample_id", *[F.col(a).cast("int").alias(f"c_{a}") for a in AXES], F.col("value"))
    met = asked.join(given, ["sample_id", "c_z", "c_y", "c_x"], "left")
    value = F.sum(F.when(F.col("inside") & (F.col("weight") > 0), F.col("weight") * F.coalesce("value", F.lit(0.0))).otherwise(0.0))
    return met.groupBy(*KEY).agg(value.alias("value"))


def preprocess(volume: DataFrame, steps: list[dict]) -> DataFrame:
    """VOX-08: ``steps`` in their order; each has ``op`` (zscore, normalize, clamp, window or float32) and its bounds."""
    image = Window.partitionBy("sample_id")
    for step in steps:
        op, v = str(step.get("op", "")).lower(), F.col("value")
        if op in ("zscore", "normalize"):
            std = F.stddev_pop("value").over(image)
            new = F.when(std > 0, (v - F.avg("value").over(image)) / std).otherwise(v)
        elif op in ("clamp", "window"):
            new = S.clamp(v, float(step.get("lower", -1000)), float(step.get("upper", 1000)))
        elif op == "float32":
            new = v.cast("float")
        else:
            raise ValueError(f"unknown preprocessing operation: {step.get('op')!r}")
        volume = volume.withColumn("value", new)
    return volume


def lung_threshold(volume: DataFrame, sizes: DataFrame, threshold: float = -320.0, min_voxels: int = 1000, keep: int = 2) -> DataFrame:
    """VOX-12: air below the threshold, without components that touch the border (unless all do), the largest ones, closed by two voxels in y and x and one in z.

    A sample in which nothing is found is an error (of the job that reads it).
    """
    found = connected_components(volume.where(F.col("value") < threshold), min_voxels, None).join(sizes, "sample_id")
    edge = F.lit(False)
    for a in AXES:
        edge = edge | (F.col(a) == 0) | (F.col(a) == F.col(f"n_{a}") - 1)
    part, sample = Window.partitionBy("sample_id", "component"), Window.partitionBy("sample_id")
    found = found.withColumn("touches", F.max(edge).over(part)).withColumn("all_touch", F.min("touches").over(sample))
    found = found.where(~F.col("touches") | F.col("all_touch"))
    ranked = found.withColumn("rank", F.dense_rank().over(sample.orderBy("component"))).where(F.col("rank") <= keep)
    inside = [F.col(a).between(0, F.col(f"n_{a}") - 1) for a in AXES]
    out = closing(ranked, (1, 2, 2)).join(sizes, "sample_id").where(inside[0] & inside[1] & inside[2]).select(*KEY)
    nothing = sizes.join(ranked.select("sample_id").distinct(), "sample_id", "left_anti")
    failed = nothing.select(F.raise_error(F.concat(F.lit("no lung found in "), F.col("sample_id").cast("string"))).cast(out.schema["sample_id"].dataType).alias("sample_id"), *[F.lit(0).cast(out.schema[a].dataType).alias(a) for a in AXES])
    return out.unionByName(failed)


def resample_nearest(volume: DataFrame, geometry: DataFrame, target: DataFrame) -> DataFrame:
    """VOX-06: values on another grid in physical space, each taken from the nearest voxel; beyond the volume 0.

    ``geometry`` and ``target``: sample_id, n_z.., s_z.., o_z.. (size, spacing and origin of both grids).
    """
    grid = target.select("sample_id", *[F.col(f"{p}_{a}").alias(f"t{p}_{a}") for p in "nso" for a in AXES]).join(geometry, "sample_id")
    for a in AXES:
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(f"tn_{a}") - 1)))
        at = (F.col(f"to_{a}") + F.col(a) * F.col(f"ts_{a}") - F.col(f"o_{a}")) / F.col(f"s_{a}")
        grid = grid.withColumn(f"c_{a}", F.floor(at + 0.5).cast("int"))
    given = volume.select("sample_id", *[F.col(a).cast("int").alias(f"c_{a}") for a in AXES], F.col("value"))
    met = grid.join(given, ["sample_id", *[f"c_{a}" for a in AXES]], "left")
    return met.select(*KEY, F.coalesce("value", F.lit(0).cast(volume.schema["value"].dataType)).alias("value"))


def series(files: DataFrame) -> DataFrame:
    """VOX-14: the slices of each folder's first series in the order of their places: ``files`` (folder, series, position, path) with ``z``.

    A folder's other series are left out, as only one volume is made of it.
    """
    first = files.groupBy("folder").agg(F.min("series").alias("series"))
    order = Window.partitionBy("folder").orderBy("position", "path")
    return files.join(first, ["folder", "series"]).withColumn("z", (F.row_number().over(order) - 1).cast("int"))


def contours_to_mask(contours: DataFrame, grid: DataFrame, rois: list[str] | None = None) -> DataFrame:
    """VOX-15: (source, roi, z, y, x) of voxels whose centre lies inside an odd number of the slice's contours.

    ``contours``: source, roi, contour, z, points (array of x, y in voxels, in order); ``grid``: source, n_y, n_x. Each edge meets the rows
    of voxels that it crosses; crossings to the left of a voxel are counted, so nothing is a product of voxels and edges.
    """
    if rois:
        contours = contours.where(F.col("roi").isin(rois))
    n = F.size("points")
    edges = contours.where(n > 2).select("source", "roi", "z", F.posexplode("points").alias("i", "a"), "points")
    edges = edges.withColumn("b", F.get("points", F.pmod(F.col("i") + 1, n)))
    low, high = F.least("a.y", "b.y"), F.greatest("a.y", "b.y")
    # rows with a centre in [low, high)
    first, last = F.ceil(low).cast("int"), (F.ceil(high) - 1).cast("int")
    rows = edges.where(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
    cross = F.col("a.x") + (F.col("y") - F.col("a.y")) / (F.col("b.y") - F.col("a.y")) * (F.col("b.x") - F.col("a.x"))
    hits = rows.select("source", "roi", "z", "y", cross.alias("cross")).groupBy("source", "roi", "z", "y").agg(F.array_sort(F.collect_list("cross")).alias("c"))
    # between an odd crossing and the next even one
    spans = hits.join(grid, "source").where("y >= 0 and y < n_y").select("source", "roi", "z", "y", "n_x", F.explode(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1)).alias("k"), "c")
    from_x, to_x = F.greatest(F.ceil(F.get("c", F.col("k") * 2)), F.lit(0)).cast("int"), F.least(F.ceil(F.get("c", F.col("k") * 2 + 1)) - 1, F.col("n_x") - 1).cast("int")
    return spans.where(from_x <= to_x).select("source", "roi", "z", "y", F.explode(F.sequence(from_x, to_x)).alias("x")).distinct()


def segments(frames: DataFrame, segment_names: DataFrame, rois: list[str] | None = None) -> DataFrame:
    """VOX-15, ARR-05: voxels of a segmentation's frames by segment: (source, roi, z, y, x); z counts the segment's own frames.

    ``frames``: source, frame, segment_number (of the frame), y, x, value; ``segment_names``: source, segment_number, label (null: by number).
    A source none of whose frames names a segment gives all of its frames to each segment.
    """
    named = segment_names.withColumn("roi", F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("segment_"), F.col("segment_number").cast("string"))))
    if rois:
        named = named.where(F.col("roi").isin(rois))
    own = frames.select("source", "frame", "segment_number").distinct()
    bare = own.groupBy("source").agg(F.max("segment_number").alias("_any")).where("_any is null").select("source")
    placed = own.where("segment_number is not null").join(named, ["source", "segment_number"]).select("source", "frame", "roi")
    placed = placed.unionByName(own.join(bare, "source").drop("segment_number").join(named, "source").select("source", "frame", "roi"))
    order = Window.partitionBy("source", "roi").orderBy("frame")
    placed = placed.withColumn("z", (F.row_number().over(order) - 1).cast("int"))
    return frames.where("value > 0").select("source", "frame", "y", "x").join(placed, ["source", "frame"]).select("source", "roi", "z", "y", "x")


def tiles(slides: DataFrame, tile: int = 256, stride: int = 256) -> DataFrame:
    """VOX-16, ARR-01: the places of all tiles of ``slides`` (slide_id, width, height): (slide_id, y, x, tile_size)."""
    return slides.select("slide_id", F.explode(S.tile_origins(F.col("height"), tile, stride)).alias("y"), "width").select("slide_id", "y", F.explode(S.tile_origins(F.col("width"), tile, stride)).alias("x"), F.lit(tile).alias("tile_size"))


def overlay(slices: DataFrame, mask: DataFrame) -> DataFrame:
    """VOX-17: (sample_id, y, x, red, green, blue) of rescaled middle slices (value in 0..1), masked pixels (sample_id, y, x) tinted red."""
    gray = F.floor(F.col("value") * 255).cast("int")
    dim = F.floor(gray * F.lit(0.35)).cast("int")
    on = slices.join(mask.select("sample_id", "y", "x").distinct().withColumn("_in", F.lit(True)), ["sample_id", "y", "x"], "left")
    tint = lambda c: F.when(F.col("_in"), c).otherwise(gray)
    return on.select("sample_id", "y", "x", tint(F.lit(255)).alias("red"), tint(dim).alias("green"), tint(dim).alias("blue"))


def visuals(samples: DataFrame, most: int = 24) -> DataFrame:
    """VOX-17, WIN-01: (sample_id, qc_id) of the first samples by id, under names that do not tell who they are."""
    kept = samples.select("sample_id").distinct().orderBy("sample_id").limit(most)
    n = F.row_number().over(Window.orderBy("sample_id"))  # over ``most`` rows
    return kept.select("sample_id", S.public_name(n, F.col("sample_id").cast("string")).alias("qc_id"))


def _with_simpleitk(volume: DataFrame, work) -> DataFrame:
    """``work(sitk, image)`` on each whole image, in a task that has the SimpleITK library; its values in place of the old ones."""
    kind = volume.schema["sample_id"].dataType.simpleString()

    def one(part):
        import numpy as np
        import pandas as pd

        try:
            import SimpleITK as sitk
        except ImportError as e:
            raise RuntimeError("this step needs the SimpleITK library on the executors") from e
        at = part[list(AXES)].to_numpy(np.int64)
        array = np.zeros(at.max(axis=0) + 1, np.float32)
        array[tuple(at.T)] = part["value"]
        out = sitk.GetArrayFromImage(work(sitk, sitk.GetImageFromArray(array)))
        places = np.argwhere(np.ones(out.shape, bool))
        return pd.DataFrame({"sample_id": part["sample_id"].iloc[0], **dict(zip(AXES, places.T.astype("int32"), strict=True)), "value": out.ravel().astype("float64")})

    return volume.groupBy("sample_id").applyInPandas(one, f"sample_id {kind}, z int, y int, x int, value double")


def n4_bias(volume: DataFrame) -> DataFrame:
    """VOX-10: bias field correction inside an Otsu mask."""
    return _with_simpleitk(volume, lambda sitk, image: sitk.N4BiasFieldCorrection(image, sitk.OtsuThreshold(image, 0, 1, 200)))


def register_rigid(volume: DataFrame, reference: list[list[list[float]]], seed: int = 1) -> DataFrame:
    """VOX-11: each image moved onto ``reference`` (one image, sent to every task) by mutual information; seeded, so runs agree."""

    def work(sitk, image):
        import numpy as np

        fixed = sitk.GetImageFromArray(np.asarray(reference, np.float32))
        method = sitk.ImageRegistrationMethod()
        method.SetMetricAsMattesMutualInformation(32)
        method.SetMetricSamplingStrategy(method.RANDOM)
        method.SetMetricSamplingPercentage(0.1, seed)
        method.SetInterpolator(sitk.sitkLinear)
        method.SetOptimizerAsGradientDescent(1.0, 100)
        method.SetOptimizerScalesFromPhysicalShift()
        method.SetInitialTransform(sitk.CenteredTransformInitializer(fixed, image, sitk.Euler3DTransform()), False)
        return sitk.Resample(image, fixed, method.Execute(fixed, image), sitk.sitkLinear, 0.0)

    return _with_simpleitk(volume, work)
