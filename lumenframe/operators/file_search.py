"""

Every rule gives candidates with a rank; the candidate with the smallest (rank, path) wins, so results do not depend on the order
of a listing. "Name holds the sample id" is no cross join: a name is cut into all pieces that are as long as some sample id, and
pieces meet ids by equality.

Defined results: null and empty ids match nothing; a sample without a hit has a null path (it is not dropped).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scalars import base_name

#: Extensions of images, of masks in artifacts, of volumes that a search may fall back to.
IMAGE_EXTENSIONS = (".nii.gz", ".nii", ".nrrd", ".mha", ".dcm")
MASK_EXTENSIONS = (".nii.gz", ".nii", ".nrrd", ".mha", ".mhd", ".dcm")
VOLUME_EXTENSIONS = (".nii.gz", ".nii", ".nrrd", ".mha")
#: What follows the sample id in the names of mask files, in the order in which they are tried.
MASK_SUFFIXES = ("", "_mask", "_seg", "_label", "_GTV-1", "_gtv1")
#: Patterns of names.
KNOWN_EXTENSION = r"(?i)\.(nii\.gz|nii|nrrd|mha|mhd|dcm)$"
ARTIFACT_FILE = r"(?i)\.(nii\.gz|nii|nrrd|mha|png)$"
ARTIFACT_MASK = r"(?i)\.(nii\.gz|nii|nrrd|png)$"


def stem(path: Column) -> Column:
    """The base name without a known image extension; other extensions stay."""
    return F.regexp_replace(base_name(path), KNOWN_EXTENSION, "")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _ends(name: Column, extensions: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(name, F.lit(e)) for e in extensions])


def holding(files: DataFrame, samples: DataFrame, name: Column) -> DataFrame:
    """``files`` with the ``sample_id`` of every sample whose id is part of ``name``.

    At most 255 lengths of ids come to the driver, each with the characters that ids of that length begin and end with; pieces that
    begin or end otherwise are no ids and are not cut out.
    """
    ids = samples.select("sample_id").where("sample_id <> ''").distinct()
    size, first, last = F.length("sample_id").alias("n"), F.substring("sample_id", 1, 1), F.substring("sample_id", -1, 1)
    shapes = samples.where("sample_id <> ''").groupBy(size).agg(F.sort_array(F.collect_set(first)), F.sort_array(F.collect_set(last))).collect()

    def pieces(n: int, firsts: list[str], lasts: list[str]) -> Column:
        at = lambda i, k: F.substr("_name", i, F.lit(k))
        fits = F.filter(F.sequence(F.lit(1), F.length("_name") - n + 1), lambda i: at(i, 1).isin(firsts) & at(i + n - 1, 1).isin(lasts))
        return F.when(F.length("_name") >= n, F.transform(fits, lambda i: at(i, n))).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(*[pieces(*s) for s in sorted(shapes)])) if shapes else F.array().cast("array<string>")
    cut = files.withColumn("_name", name).withColumn("sample_id", F.explode(every)).drop("_name")
    return cut.join(ids, "sample_id")


def first_hits(samples: DataFrame, rules: list[DataFrame]) -> DataFrame:
    """(sample_id, path) for each sample; ``rules`` are tables of (sample_id, rank, path). Ranks are compared before the exchange."""
    hits = reduce(DataFrame.unionByName, [r.select("sample_id", F.col("rank").cast("int"), "path") for r in rules])
    best = hits.groupBy("sample_id").agg(F.min(F.struct("rank", "path")).alias("best"))
    return samples.select("sample_id").distinct().join(best, "sample_id", "left").select("sample_id", "best.path")


def _named(samples: DataFrame, files: DataFrame, root: str, suffixes: tuple[str, ...], extensions: tuple[str, ...], rank: int = 0) -> DataFrame:
    """Files that stand right under ``root`` with a name made of id, suffix and extension; ranked by suffix, then extension.

    Each file is asked which of these endings it has, so a sample is not a row for each of its possible names.
    """
    under = root.rstrip("/") + "/"
    rest = files.where(F.startswith("path", F.lit(under))).select("path", F.substr("path", F.lit(len(under) + 1)).alias("_rest"))
    tails = {s + e: rank + i * len(extensions) + j for i, s in reversed([*enumerate(suffixes)]) for j, e in reversed([*enumerate(extensions)])}
    ways = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(t).alias("tail")) for t, r in tails.items()])
    met = rest.select("path", "_rest", F.explode(F.filter(ways, lambda w: F.endswith("_rest", w["tail"]))).alias("w"))
    own = F.substr("_rest", F.lit(1), F.length("_rest") - F.length("w.tail"))
    return met.select(own.alias("sample_id"), "w.rank", "path").join(samples.select("sample_id").distinct(), "sample_id", "left_semi")


def sample_images(samples: DataFrame, files: DataFrame, root: str, manifests: DataFrame | None = None) -> DataFrame:
    """JN-15: the primary path of the sample's manifest if it is listed or in a store, else a file named after the sample.

    In a store (``s3://``) names are tried with five extensions in their order; elsewhere any file right under ``root`` will do
    whose stem is the id. ``manifests`` has ``sample_id, primary_path``.
    """
    rules = []
    if manifests is not None:
        named = manifests.where("primary_path is not null").select("sample_id", F.lit(0).alias("rank"), F.col("primary_path").alias("path"))
        rules += [named.where(F.startswith("path", F.lit("s3://"))), named.join(files.select("path").distinct(), "path", "left_semi")]
    if root.startswith("s3://"):
        rules.append(_named(samples, files, root, ("",), IMAGE_EXTENSIONS, 1))
    else:
        here = files.where(_folder(F.col("path")) == root.rstrip("/")).select("path", stem(F.col("path")).alias("sample_id"), F.lit(1).alias("rank"))
        rules.append(here.join(samples.select("sample_id").distinct(), "sample_id", "left_semi"))
    return first_hits(samples, rules)


def sample_masks(samples: DataFrame, files: DataFrame, root: str, index: DataFrame | None = None) -> DataFrame:
    """JN-14: the mask of each sample.

    In a store: the hash index's uri, else six stems with six extensions in their order, else a listed file whose stem is the id or the
    id with ``_mask``, else one whose name holds the id and speaks of a mask. Elsewhere: a file whose stem holds the id.
    """
    under = files.where(F.startswith("path", F.lit(root.rstrip("/") + "/"))).select("path")
    if not root.startswith("s3://"):
        return first_hits(samples, [holding(under, samples, stem(F.col("path"))).withColumn("rank", F.lit(0))])
    rules = [_named(samples, files, root, MASK_SUFFIXES, MASK_EXTENSIONS, 1)]
    if index is not None:
        rules.append(index.where("uri <> ''").select("sample_id", F.lit(0).alias("rank"), F.col("uri").alias("path")))
    exact = under.withColumn("sample_id", F.regexp_replace(stem(F.col("path")), "_mask$", "")).unionByName(under.withColumn("sample_id", stem(F.col("path"))))
    rules.append(exact.join(samples.select("sample_id").distinct(), "sample_id", "left_semi").withColumn("rank", F.lit(100)))
    spoken = under.where(base_name(F.col("path")).rlike("(?i)mask|seg|label|gtv"))
    rules.append(holding(spoken, samples, base_name(F.col("path"))).withColumn("rank", F.lit(101)))
    return first_hits(samples, rules)


def worker_masks(samples: DataFrame, files: DataFrame, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """JN-13: the mask of each sample in a step's input folder, from the most to the least explicit sign.

    The manifest's ``primary_mask`` if listed; a file right under ``root`` whose name holds the id and ``mask`` or ``label``; the first
    NIfTI in the folder named after the sample; a volume right under ``root`` whose name holds the id; the only volume there is.
    """
    top = files.where(_folder(F.col("path")) == root.rstrip("/")).select("path")
    name = base_name(F.col("path"))
    volumes = top.where(_ends(name, VOLUME_EXTENSIONS))
    held = holding(top, samples, name)
    inside = files.where(_ends(name, (".nii.gz", ".nii"))).select("path", _folder(F.col("path")).alias("_folder"))
    folders = samples.select("sample_id", F.concat(F.lit(root.rstrip("/") + "/"), "sample_id").alias("_folder")).where("sample_id <> ''").distinct()
    only = volumes.groupBy().agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("path")
    rules = [
        held.where(F.lower(name).rlike("mask|label")).withColumn("rank", F.lit(1)),
        inside.join(folders, "_folder").withColumn("rank", F.lit(2)),
        held.where(_ends(name, VOLUME_EXTENSIONS)).withColumn("rank", F.lit(3)),
        # at most one row, so the product is no larger than the samples
        samples.select("sample_id").distinct().join(F.broadcast(only)).withColumn("rank", F.lit(4)),
    ]
    if manifest is not None:
        listed = manifest.select("sample_id", F.col("primary_mask").alias("path"), F.lit(0).alias("rank"))
        rules.append(listed.join(files.select("path").distinct(), "path", "left_semi"))
    return first_hits(samples, rules)


def _mask_places(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(artifact_path, path): each file that is a mask with itself and the folders above it, as far as some artifact lies that deep."""
    depths = artifacts.agg(F.collect_set(F.size(F.split("artifact_path", "/"))).alias("_depths"))
    parts = F.split("path", "/")
    above = F.transform(F.filter("_depths", lambda n: n < F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    none = F.array().cast("array<string>")
    itself = F.when(F.col("path").rlike(ARTIFACT_FILE) & F.array_contains("_depths", F.size(parts)), F.array("path")).otherwise(none)
    places = F.concat(itself, F.when(F.col("path").rlike(ARTIFACT_MASK), above).otherwise(none))
    # one row of a few numbers
    return files.select("path").crossJoin(F.broadcast(depths)).select("path", F.explode(places).alias("artifact_path"))


def with_mask(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of ``artifacts`` (artifact_path and more) that are a mask file or have one below them, without saying which."""
    return artifacts.join(_mask_places(artifacts, files).select("artifact_path").distinct(), "artifact_path", "left_semi")


def artifact_masks(artifacts: DataFrame, files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """JN-16: (sample_id, path) for ``artifacts`` (sample_id, artifact_path), whose files are ``files`` (path).

    The artifact itself if it is a mask file; the manifest's ``primary_mask`` (artifact_path, sample_id) if listed; a mask file below it
    that says so by its name; the first mask file below it.
    """
    wanted = artifacts.select("sample_id", "artifact_path")
    rank = F.when(F.col("artifact_path") == F.col("path"), 0).when(base_name(F.col("path")).rlike("(?i)mask|seg|label"), 2).otherwise(3)
    # one file a folder goes on from each task, so that a folder of all files is no hot key
    best = _mask_places(wanted, files).groupBy("artifact_path").agg(F.min(F.struct(rank.alias("rank"), "path")).alias("_best"))
    rules = [wanted.join(best, "artifact_path").select("sample_id", "_best.rank", "_best.path")]
    if manifest is not None:
        listed = manifest.join(wanted, ["artifact_path", "sample_id"]).select("sample_id", F.lit(1).alias("rank"), F.col("primary_mask").alias("path"))
        rules.append(listed.join(files.select("path").distinct(), "path", "left_semi"))
    return first_hits(wanted, rules)


def artifact_pick(files: DataFrame) -> DataFrame:
    """SRC-30: one file of each ``artifact``: Parquet, else CSV, else NIfTI, else any; the first by path. ``files`` has ``artifact, path``."""
    rank = F.when(F.col("path").rlike(r"\.parquet$"), 0).when(F.col("path").rlike(r"\.csv$"), 1).when(F.col("path").rlike(r"\.nii(\.gz)?$"), 2).otherwise(3)
    return files.groupBy("artifact").agg(F.min_by("path", F.struct(rank.alias("rank"), F.col("path"))).alias("path"))


def paired(images: DataFrame, masks: DataFrame, how: str = "inner") -> DataFrame:
    """JN-09, JN-10, JN-11: images and masks of equal stem; of images with one stem the last by path counts, masks may repeat."""
    last = images.groupBy(stem(F.col("path")).alias("sample_id")).agg(F.max("path").alias("image"))
    return last.join(masks.select(stem(F.col("path")).alias("sample_id"), F.col("path").alias("mask")), "sample_id", how)


def asset_paths(names: DataFrame, catalog: DataFrame, aliases: DataFrame, manifest: DataFrame) -> DataFrame:
    """SRC-21: (name, path) for ``names`` (name, role, explicit): the explicit path, else the catalog's by id, else by alias, else the manifest's.

    ``catalog``: asset_id, path_or_root, status; ``aliases``: alias, asset_id; ``manifest``: name, role, uri. Only active assets count.
    """
    active = catalog.where("status = 'active'").groupBy("asset_id").agg(F.min("path_or_root").alias("_path"))
    by_alias = aliases.join(active, "asset_id").groupBy("alias").agg(F.min_by("_path", "asset_id").alias("_alias_path"))
    by_name = manifest.groupBy("name").agg(F.min("uri").alias("_uri"))
    by_role = manifest.groupBy("role").agg(F.min_by("uri", "name").alias("_role_uri"))
    out = names.join(active.withColumnRenamed("asset_id", "name"), "name", "left").join(by_alias.withColumnRenamed("alias", "name"), "name", "left")
    out = out.join(by_name, "name", "left").join(by_role, "role", "left")
    return out.select("name", F.coalesce(F.nullif("explicit", F.lit("")), "_path", "_alias_path", "_uri", "_role_uri").alias("path"))
