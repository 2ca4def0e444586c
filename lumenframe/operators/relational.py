
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_metadata(features: DataFrame, metadata: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """JN-01: left join on a null-safe key; metadata columns that features have are dropped, of equal metadata keys the first counts.

    First is the row with the smallest ``order`` columns, all of the row's columns unless given, so the result does not hang on chance.
    """
    for side, name in ((features, "features"), (metadata, "metadata")):
        if key not in side.columns:
            raise ValueError(f"{name} lack {key}")
    extra = [c for c in metadata.columns if c != key and c not in features.columns]
    row = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order or metadata.columns)], *extra)
    right = metadata.groupBy(F.col(key).alias("_key")).agg(F.min(row).alias("_first")).select("_key", *[F.col(f"_first.{c}").alias(c) for c in extra])
    return features.join(right, features[key].eqNullSafe(right["_key"]), "left").drop("_key")


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ-01: the columns in the order asked for; missing ones are an error that names all of them."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def diff_index(current: DataFrame, stored: DataFrame, key: str, value: str, include_deleted: bool = False) -> DataFrame:
    """JN-06: (key, status): new, changed or unchanged against the stored index; optionally deleted."""
    old = stored.select(F.col(key).alias("_key"), F.col(value).alias("_old"))
    how = "full" if include_deleted else "left"
    joined = current.select(key, value).join(old, F.col(key) == F.col("_key"), how)
    status = F.when(F.col(key).isNull(), "deleted").when(F.col("_old").isNull(), "new").when(~F.col("_old").eqNullSafe(F.col(value)), "changed").otherwise("unchanged")
    return joined.select(F.coalesce(key, "_key").alias(key), status.alias("status"))


def extend_index(existing: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """JN-08: rows of ``found`` whose key is not in the index are added."""
    return existing.unionByName(found.join(existing.select(key), key, "left_anti"))


def resolve_id_or_alias(wanted: DataFrame, assets: DataFrame, aliases: DataFrame) -> DataFrame:
    """JN-04: ``wanted`` (name) with asset_id: an id of that name first, else what the alias points to; repeated ids and aliases do not fan out."""
    by_id = assets.select(F.col("asset_id").alias("_id")).distinct()
    by_alias = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.min("asset_id").alias("_target"))
    out = wanted.join(by_id, wanted["name"] == F.col("_id"), "left").join(by_alias, wanted["name"] == F.col("_alias"), "left")
    return out.select("name", F.coalesce("_id", "_target").alias("asset_id"))


def active_aliases(aliases: DataFrame, assets: DataFrame) -> DataFrame:
    """JN-03: (alias, asset_id, path_or_root) of aliases whose asset is active."""
    active = assets.where("status = 'active'").select("asset_id", "path_or_root")
    return aliases.select("alias", "asset_id").join(active, "asset_id").select("alias", "asset_id", "path_or_root")


def lineage(parents: DataFrame, assets: DataFrame) -> DataFrame:
    """JN-02: each asset's parents (asset_id, parent_asset_id, relationship, kind, dataset_id), one step up."""
    up = assets.select(F.col("asset_id").alias("parent_asset_id"), "kind", "dataset_id")
    return parents.join(up, "parent_asset_id").select("asset_id", "parent_asset_id", "relationship", "kind", "dataset_id")


def ancestors(parents: DataFrame) -> DataFrame:
    """JN-02: (asset_id, ancestor, steps): all that an asset derives from, with the fewest steps; a circle ends where it closes.

    Paths double in length each round, so rounds grow with the logarithm of the longest line, and each is one join by key. Only the
    paths of the full length reached so far are carried on, so a pair with one shortest path is made once.
    """
    now = parents.select("asset_id", F.col("parent_asset_id").alias("ancestor"), F.lit(1).cast("long").alias("steps")).distinct().persist()
    last, reached = None, 1
    # a pair further apart than this has one that is just as far apart on its way
    while now.where(F.col("steps") == reached).count():
        on = now.select(F.col("asset_id").alias("ancestor"), F.col("ancestor").alias("_far"), F.col("steps").alias("_more"))
        ends = now.where(F.col("steps") == reached)
        longer = ends.join(on, "ancestor").select("asset_id", F.col("_far").alias("ancestor"), (F.col("steps") + F.col("_more")).alias("steps"))
        new = now.unionByName(longer).groupBy("asset_id", "ancestor").agg(F.min("steps").alias("steps")).persist()
        if last:
            last.unpersist()  # the rounds after it are kept whole
        last, now, reached = now, new, reached * 2
    if last:
        last.unpersist()
    return now


def in_latest(rows: DataFrame, wanted: DataFrame, key: str, *order: Column) -> DataFrame:
    """JN-05: the latest row whose key is in ``wanted``."""
    return rows.join(wanted.select(key), key, "left_semi").orderBy(*order).limit(1)


def upsert_changed(stored: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """UPS-03: rows replaced by key, but for those that are equal in ``compared`` (null-safe), whose stored row stays as it is."""
    old = stored.select(*keys, F.struct(*compared).alias("_old"))
    same = F.col("_old").isNotNull() & reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_old.{c}")) for c in compared])
    return upsert(stored, new.join(old, keys, "left").where(~same).select(*new.columns), keys)


def first_ranked(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """WIN-04: the first row of each key by an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """UPS-01: whole rows replaced by key."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """UPS-02: rows whose key is stored already are left out."""
    return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """SET-02: columns in first-seen order, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sticky_fold(events: DataFrame, key: str, status: Column, order: list[Column]) -> DataFrame:
    """UPS-05 / STM-07: one status for each key; completed is never downgraded, a failure can be upgraded, else the latest counts.

    Depends only on the set of events, so late and repeated events do no harm.
    """
    rank = F.when(status == "completed", 3).when(status == "failed", 2).otherwise(1)
    return events.groupBy(key).agg(F.max_by(status, F.struct(rank, *order)).alias("status"))


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """WIN-02."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
