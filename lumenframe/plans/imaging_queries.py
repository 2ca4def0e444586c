"""Queries of file searches, image statistics, hashes, publication and further voxel kernels over the driver tables, with their SQL.

A supplier's lines are an image (line number, part and quantity are the coordinates, the price is the value); documents stand for samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import hashing as H
from lumenframe.functions import scalars as S
from lumenframe.operators import file_search as FS
from lumenframe.operators import publishing as P
from lumenframe.operators import relational as R
from lumenframe.operators import statistics as ST
from lumenframe.operators import voxels as V
from lumenframe.session import table
from lumenframe.sources import resources as RS

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        _QUERIES[name] = lambda spark, sf_dir: fn(lambda n: table(spark, sf_dir, n))
        if sql:
            _SQL[name] = sql
        return fn

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- file searches: a sample c<id> for each document, whose files depend on the id

_NAMES = {
    "store": "CASE doc_id % 7 WHEN 0 THEN 's3://b/m/c' || doc_id || '_seg.nrrd' WHEN 1 THEN 's3://b/m/c' || doc_id || '.nii.gz' WHEN 2 THEN 's3://b/m/deep/c' || doc_id || '_mask.nii' WHEN 3 THEN 's3://b/m/GTV_c' || doc_id || '_x.nii.gz' WHEN 4 THEN 's3://b/m/c' || doc_id || '_label.mha' ELSE 's3://b/m/other' || doc_id || '.txt' END",
    "local": "CASE doc_id % 7 WHEN 0 THEN '/r/c' || doc_id || '_Mask.png' WHEN 1 THEN '/r/c' || doc_id || '/seg.nii.gz' WHEN 2 THEN '/r/c' || doc_id || '.nii.gz' WHEN 3 THEN '/r/c' || doc_id || '_notes.txt' WHEN 4 THEN '/r/sub/c' || doc_id || '.nii' ELSE '/r/y' || doc_id || '.mha' END",
}
_SAMPLES = "s AS (SELECT DISTINCT 'c' || doc_id AS sample_id FROM documents)"
_BEST = "SELECT s.sample_id, arg_min(h.path, (h.rank, h.path)) AS path FROM s LEFT JOIN h USING (sample_id) GROUP BY 1"


def _files_sql(kind: str) -> str:
    return f"f AS (SELECT {_NAMES[kind]} AS path FROM documents), n AS (SELECT path, split_part(path, '/', -1) AS name, regexp_replace(split_part(path, '/', -1), '\\.(nii\\.gz|nii|nrrd|mha|mhd|dcm)$', '', 'i') AS stem, regexp_replace(path, '/[^/]*$', '') AS folder FROM f)"


def _samples(t) -> DataFrame:
    return t("documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("sample_id"))


def _files(t, kind: str) -> DataFrame:
    return t("documents").select(F.expr(_NAMES[kind]).alias("path"))


@_query("search_masks_in_store", rf"""WITH {_SAMPLES}, {_files_sql("store")}, w AS (SELECT sample_id, i * 6 + j + 1 AS rank, 's3://b/m/' || sample_id || suffix || ext AS path FROM s,
  (SELECT unnest(['', '_mask', '_seg', '_label', '_GTV-1', '_gtv1']) AS suffix, unnest(range(6)) AS i), (SELECT unnest(['.nii.gz', '.nii', '.nrrd', '.mha', '.mhd', '.dcm']) AS ext, unnest(range(6)) AS j)),
h AS (SELECT w.* FROM w SEMI JOIN f USING (path)
  UNION ALL SELECT sample_id, 100, path FROM s JOIN n ON stem = sample_id OR stem = sample_id || '_mask'
  UNION ALL SELECT sample_id, 101, path FROM s JOIN n ON contains(name, sample_id) AND regexp_matches(name, 'mask|seg|label|gtv', 'i')) {_BEST}""")
def _(t):
    return FS.sample_masks(_samples(t), _files(t, "store"), "s3://b/m/")


@_query("search_masks_local", f"WITH {_SAMPLES}, {_files_sql('local')}, h AS (SELECT sample_id, 0 AS rank, path FROM s JOIN n ON contains(stem, sample_id)) {_BEST}")
def _(t):
    return FS.sample_masks(_samples(t), _files(t, "local"), "/r")


@_query("search_images", f"WITH {_SAMPLES}, {_files_sql('local')}, h AS (SELECT stem AS sample_id, 1 AS rank, path FROM n WHERE folder = '/r' UNION ALL SELECT 'c' || doc_id, 0, 's3://x/' || doc_id FROM documents WHERE doc_id % 10 = 0) {_BEST}")
def _(t):
    primary = t("documents").where("doc_id % 5 = 0").select(F.concat(F.lit("c"), "doc_id").alias("sample_id"), F.concat(F.when(F.col("doc_id") % 10 == 0, F.lit("s3://x/")).otherwise(F.lit("/gone/")), "doc_id").alias("primary_path"))
    return FS.sample_images(_samples(t), _files(t, "local"), "/r", primary)


@_query("search_worker_masks", f"""WITH {_SAMPLES}, {_files_sql("local")}, top AS (SELECT * FROM n WHERE folder = '/r'), vol AS (SELECT * FROM top WHERE regexp_matches(name, '\\.(nii\\.gz|nii|nrrd|mha)$')),
h AS (SELECT sample_id, 1 AS rank, path FROM s JOIN top ON contains(name, sample_id) AND regexp_matches(lower(name), 'mask|label')
  UNION ALL SELECT sample_id, 2, path FROM s JOIN n ON folder = '/r/' || sample_id AND regexp_matches(name, '\\.nii(\\.gz)?$')
  UNION ALL SELECT sample_id, 3, path FROM s JOIN vol ON contains(name, sample_id)
  UNION ALL SELECT sample_id, 4, path FROM s, (SELECT min(path) AS path FROM vol HAVING count(*) = 1)) {_BEST}""")
def _(t):
    return FS.worker_masks(_samples(t), _files(t, "local"), "/r")


@_query("search_artifact_masks", f"""WITH a AS (SELECT 'c' || doc_id AS sample_id, '/a/' || doc_id AS dir, CASE WHEN doc_id % 4 = 0 THEN '/a/' || doc_id || '/m.PNG' ELSE '/a/' || doc_id END AS artifact_path FROM documents), s AS (SELECT DISTINCT sample_id FROM a),
f AS (SELECT '/a/' || doc_id || '/' || unnest(CASE doc_id % 4 WHEN 0 THEN ['m.PNG'] WHEN 1 THEN ['a.nii', 'x/my_Seg.nii.gz', 'mask.txt'] WHEN 2 THEN ['b.nrrd', 'a.nii.gz'] ELSE ['a.csv'] END) AS path FROM documents),
h AS (SELECT sample_id, 0 AS rank, path FROM a JOIN f ON path = artifact_path WHERE regexp_matches(path, '\\.(nii\\.gz|nii|nrrd|mha|png)$', 'i')
  UNION ALL SELECT sample_id, CASE WHEN regexp_matches(split_part(path, '/', -1), 'mask|seg|label', 'i') THEN 2 ELSE 3 END, path FROM a JOIN f ON starts_with(path, artifact_path || '/') WHERE regexp_matches(path, '\\.(nii\\.gz|nii|nrrd|png)$', 'i')) {_BEST}""")
def _(t):
    folder = F.concat(F.lit("/a/"), "doc_id")
    names = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("m.PNG"))).when(F.col("doc_id") % 4 == 1, F.array(*map(F.lit, ("a.nii", "x/my_Seg.nii.gz", "mask.txt")))).when(F.col("doc_id") % 4 == 2, F.array(F.lit("b.nrrd"), F.lit("a.nii.gz"))).otherwise(F.array(F.lit("a.csv")))
    files = t("documents").select(folder.alias("d"), F.explode(names).alias("n")).select(F.concat("d", F.lit("/"), "n").alias("path"))
    artifacts = t("documents").select(F.concat(F.lit("c"), "doc_id").alias("sample_id"), F.when(F.col("doc_id") % 4 == 0, F.concat(folder, F.lit("/m.PNG"))).otherwise(folder).alias("artifact_path"))
    return FS.artifact_masks(artifacts, files)


@_query("artifact_pick", "SELECT l_orderkey AS artifact, arg_min(path, (CASE WHEN regexp_matches(path, '\\.parquet$') THEN 0 WHEN regexp_matches(path, '\\.csv$') THEN 1 WHEN regexp_matches(path, '\\.nii(\\.gz)?$') THEN 2 ELSE 3 END, path)) AS path FROM (SELECT l_orderkey, l_linenumber || CASE l_partkey % 5 WHEN 0 THEN '.parquet' WHEN 1 THEN '.csv' WHEN 2 THEN '.nii.gz' ELSE '.json' END AS path FROM lineitem) GROUP BY 1")
def _(t):
    path = F.expr("l_linenumber || CASE l_partkey % 5 WHEN 0 THEN '.parquet' WHEN 1 THEN '.csv' WHEN 2 THEN '.nii.gz' ELSE '.json' END")
    return FS.artifact_pick(t("lineitem").select(F.col("l_orderkey").alias("artifact"), path.alias("path")))


@_query("image_mask_pairs", "SELECT sample_id, image, mask FROM (SELECT 'c' || doc_id % 50 AS sample_id, max('/i/' || source || '/c' || doc_id % 50 || CASE WHEN doc_id % 2 = 0 THEN '.nii' ELSE '.NII.GZ' END) AS image FROM documents GROUP BY 1) JOIN (SELECT 'c' || doc_id % 80 AS sample_id, '/m/c' || doc_id % 80 || '.nrrd' AS mask FROM labels) USING (sample_id)")
def _(t):
    image = F.expr("'/i/' || source || '/c' || doc_id % 50 || CASE WHEN doc_id % 2 = 0 THEN '.nii' ELSE '.NII.GZ' END")
    return FS.paired(t("documents").select(image.alias("path")), t("labels").select(F.expr("'/m/c' || doc_id % 80 || '.nrrd'").alias("path")))


@_query("asset_paths", "SELECT DISTINCT p_brand AS name, coalesce(CASE WHEN p_brand LIKE '%1' THEN '/x/' || p_brand END, CASE WHEN p_brand LIKE '%2' THEN '/id/' || p_brand END, CASE WHEN p_brand LIKE '%3' THEN '/id/Brand#12' END, CASE WHEN p_brand LIKE '%4' THEN '/m/' || p_brand END, '/m/Brand#14') AS path FROM part")
def _(t):
    brands = t("part").select(F.col("p_brand").alias("name")).distinct()
    names = brands.select("name", F.lit("images").alias("role"), F.when(F.col("name").endswith("1"), F.concat(F.lit("/x/"), "name")).otherwise("").alias("explicit"))
    fixed = brands.sparkSession.createDataFrame([("Brand#12", "/id/Brand#12", "active")], "asset_id string, path_or_root string, status string")
    catalog = brands.where("name like '%2'").select(F.col("name").alias("asset_id"), F.concat(F.lit("/id/"), "name").alias("path_or_root"), F.lit("active").alias("status")).union(fixed).distinct()
    catalog = catalog.union(brands.where("name like '%4'").select("name", F.lit("/no"), F.lit("deleted")))
    aliases = brands.where("name like '%3'").select(F.col("name").alias("alias"), F.lit("Brand#12").alias("asset_id"))
    manifest = brands.where("name like '%4'").union(brands.sparkSession.createDataFrame([("Brand#14",)], "name string")).distinct().select("name", F.lit("images").alias("role"), F.concat(F.lit("/m/"), "name").alias("uri"))
    return FS.asset_paths(names, catalog, aliases, manifest)


# -- image statistics

_VOLUME = "v AS (SELECT l_suppkey AS sample_id, l_linenumber - 1 AS z, CAST(l_partkey % 6 AS INT) AS y, CAST(l_quantity AS INT) % 6 AS x, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3, 4)"
_MASK = "m AS (SELECT DISTINCT l_suppkey AS sample_id, l_linenumber - 1 AS z, CAST(l_partkey % 6 AS INT) AS y, CAST(l_quantity AS INT) % 6 AS x FROM lineitem WHERE l_suppkey % 3 <> 0 AND l_returnflag = 'R' AND l_suppkey % 5 <> 0)"


def _voxels(t, *more) -> DataFrame:
    return t("lineitem").select(F.col("l_suppkey").alias("sample_id"), (F.col("l_linenumber") - 1).alias("z"), (F.col("l_partkey") % 6).cast("int").alias("y"), (F.col("l_quantity").cast("int") % 6).alias("x"), *more)


def _volume(t) -> DataFrame:
    return _voxels(t, F.col("l_extendedprice").alias("value")).groupBy(*V.KEY).agg(F.max("value").alias("value"))


@_query("exact_quantiles", "SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1")
def _(t):
    q = ST.quantiles(t("lineitem"), "l_returnflag", "l_extendedprice", [0.01, 0.5, 0.99])
    return q.select("l_returnflag", "n", "lo", "hi", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p01", "p50", "p99"))])


@_query("image_metrics", f"WITH {_VOLUME} SELECT sample_id, min(value) AS image_min, max(value) AS image_max, avg(value) AS image_mean, stddev_pop(value) AS image_std, (max(x) + 1) || 'x' || (max(y) + 1) || 'x' || (max(z) + 1) AS size, '0.5x1.25x' || CASE sample_id % 3 WHEN 0 THEN '3' WHEN 1 THEN '0.333333' ELSE '1e-05' END AS spacing FROM v GROUP BY 1")
def _(t):
    volume = _volume(t)
    sizes = volume.groupBy("sample_id").agg(*[(F.max(a) + 1).alias(f"n_{a}") for a in "xyz"])
    third = F.when(F.col("sample_id") % 3 == 0, 3.0).when(F.col("sample_id") % 3 == 1, 1 / 3).otherwise(0.00001)
    return ST.image_metrics(volume, sizes.withColumns({"s_x": F.lit(0.5), "s_y": F.lit(1.25), "s_z": third}))


@_query("mask_metrics", f"""WITH {_VOLUME}, {_MASK}, h AS (SELECT DISTINCT l_suppkey AS sample_id FROM lineitem WHERE l_suppkey % 3 <> 0), i AS (SELECT sample_id, count(*) AS n, avg(value) AS masked_mean, stddev_pop(value) AS masked_std, min(value) AS masked_min, max(value) AS masked_max FROM v JOIN m USING (sample_id, z, y, x) GROUP BY 1),
w AS (SELECT sample_id, min(value) AS image_min, max(value) AS image_max, avg(value) AS image_mean, stddev_pop(value) AS image_std FROM v GROUP BY 1)
SELECT w.*, masked_mean, masked_std, masked_min, masked_max, CASE WHEN h.sample_id IS NOT NULL THEN coalesce(n, 0) END AS mask_voxels, CASE WHEN h.sample_id IS NOT NULL THEN coalesce(n, 0) END * 2.5::DOUBLE AS mask_volume FROM w LEFT JOIN h USING (sample_id) LEFT JOIN i USING (sample_id)""")
def _(t):
    label = F.when((F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 5 != 0), 1).otherwise(0).alias("label")
    mask = _voxels(t, label).where("sample_id % 3 <> 0")
    volume = _volume(t)
    return ST.mask_metrics(volume, mask, volume.select("sample_id").distinct().withColumns({"s_x": F.lit(1.0), "s_y": F.lit(1.0), "s_z": F.lit(2.5)}))


@_query("dose_metrics", f"""WITH {_VOLUME}, d AS (SELECT *, value * CASE WHEN sample_id % 2 = 0 THEN 0.001::DOUBLE ELSE 1 END AS dose FROM v), g AS (SELECT sample_id, max(z) + 1 AS nz, max(y) + 1 AS ny, max(x) + 1 AS nx FROM v GROUP BY 1),
r AS (SELECT 'heart' AS roi, 7 AS nz, 6 AS ny, 6 AS nx UNION ALL SELECT 'lung', 7, 6, 6 UNION ALL SELECT 'odd', 9, 9, 9), rv AS (SELECT r.*, z, y, x FROM r, (SELECT unnest(range(7)) AS z), (SELECT unnest(range(6)) AS y), (SELECT unnest(range(6)) AS x) WHERE (roi = 'heart' AND z < 3) OR (roi = 'lung' AND x + y > 4) OR roi = 'odd')
SELECT sample_id AS dose_file, 'whole_grid' AS roi, min(dose) AS dose_min, max(dose) AS dose_max, avg(dose) AS dose_mean, stddev_pop(dose) AS dose_std, count(*) AS dose_voxels FROM d GROUP BY 1
UNION ALL SELECT d.sample_id, roi, min(dose), max(dose), avg(dose), stddev_pop(dose), count(*) FROM d JOIN g USING (sample_id) JOIN rv ON rv.nz = g.nz AND rv.ny = g.ny AND rv.nx = g.nx AND rv.z = d.z AND rv.y = d.y AND rv.x = d.x GROUP BY 1, 2""")
def _(t):
    dose = _volume(t).select(F.col("sample_id").alias("dose_file"), "z", "y", "x", F.col("value").alias("pixel"), F.when(F.col("sample_id") % 2 == 0, 0.001).alias("scaling"))
    spark = dose.sparkSession
    box = [(z, y, x) for z in range(7) for y in range(6) for x in range(6)]
    rois = [("heart", *p, 7, 6, 6) for p in box if p[0] < 3] + [("lung", *p, 7, 6, 6) for p in box if p[1] + p[2] > 4] + [("odd", *p, 9, 9, 9) for p in box]
    return ST.dose_metrics(dose, spark.createDataFrame(rois, "roi string, z int, y int, x int, n_z int, n_y int, n_x int"))


@_query("plan_summary", "SELECT o_orderkey AS plan_file, coalesce(count(l_orderkey), 0)::INT AS n_beams, coalesce(count(l_orderkey), 0)::INT AS n_fraction_groups, coalesce(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INT) END), 0)::BIGINT AS n_fractions FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("beams"), F.collect_list(F.struct(F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("int")).alias("n"))).alias("f"))
    plans = t("orders").join(lines, "o_orderkey", "left").select(F.col("o_orderkey").alias("plan_file"), "beams", F.transform("f", lambda x: x["n"]).alias("fractions"))
    return ST.plan_summary(plans)


def _embedding_sql(bins: int) -> str:
    hist = ", ".join(f"count(*) FILTER (least(floor((c - a) / (z - a) * {bins}), {bins - 1}) = {i}) / (count(*) * (any_value(z) - any_value(a)) / {bins})" for i in range(bins))
    return f"""WITH g AS (SELECT user_id AS sample_id, CASE WHEN user_id % 9 = 0 THEN 0.0::DOUBLE WHEN user_id % 7 = 0 THEN 5.0::DOUBLE ELSE value END AS v FROM events),
b AS (SELECT sample_id, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99, min(v) AS lo, max(v) AS hi FROM g GROUP BY 1), e AS (SELECT sample_id, CASE WHEN p99 > p1 THEN p1 ELSE lo END AS a, CASE WHEN p99 > p1 THEN p99 ELSE hi END AS z0 FROM b), w AS (SELECT sample_id, a, CASE WHEN z0 > a THEN z0 ELSE a + 1 END AS z FROM e),
k AS (SELECT sample_id, a, z, least(greatest(v, a), z) AS c FROM g JOIN w USING (sample_id)),
q AS (SELECT sample_id, [avg(c), stddev_pop(c), min(c), max(c), quantile_cont(c, 0.1), quantile_cont(c, 0.5), quantile_cont(c, 0.9), CASE WHEN sample_id % 9 = 0 THEN 1.0::DOUBLE ELSE count(*)::DOUBLE END, {hist}] AS vec FROM k GROUP BY sample_id),
n AS (SELECT sample_id, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS norm FROM q)
SELECT sample_id, {", ".join(f"CASE WHEN norm > 0 THEN vec[{i + 1}] / norm ELSE vec[{i + 1}] END AS emb_{i:03d}" for i in range(8 + bins))} FROM n"""


@_query("image_embeddings", _embedding_sql(6))
def _(t):
    value = F.when(F.col("user_id") % 9 == 0, float("nan")).when(F.col("user_id") % 7 == 0, 5.0).otherwise(F.col("value"))
    return ST.widened(ST.embeddings(t("events").select(F.col("user_id").alias("sample_id"), value.alias("value")), 6), 14)


@_query("middle_slices", f"WITH {_VOLUME}, d AS (SELECT sample_id, (max(z) + 1) // 2 AS mid FROM v GROUP BY 1), r AS (SELECT v.* FROM v JOIN d USING (sample_id) WHERE z = mid), b AS (SELECT sample_id, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99, min(value) AS lo, max(value) AS hi FROM r GROUP BY 1), e AS (SELECT sample_id, CASE WHEN p99 > p1 THEN p1 ELSE lo END AS a, CASE WHEN p99 > p1 THEN p99 ELSE hi END AS z0 FROM b), w AS (SELECT sample_id, a, CASE WHEN z0 > a THEN z0 ELSE a + 1 END AS b FROM e) SELECT sample_id, z, y, x, (least(greatest(value, a), w.b) - a) / (w.b - a) AS value FROM r JOIN w USING (sample_id)")
def _(t):
    return ST.middle_slices(_volume(t))


_PIXELS = "SELECT l_suppkey AS slide_id, CAST(l_partkey % 4 AS INT) * 10 AS y, l_linenumber * 10 AS x, CAST(l_quantity AS INT) * 5 AS r, CAST(l_orderkey % 256 AS INT) AS g, 250 AS b FROM lineitem"


@_query("tissue_tiles", f"WITH p AS ({_PIXELS}), q AS (SELECT slide_id, y, x, avg(CASE WHEN 1.0::DOUBLE - (r + g + b) / 3.0::DOUBLE / 255.0::DOUBLE > 0.3::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS tissue_fraction FROM p GROUP BY 1, 2, 3), k AS (SELECT * FROM q WHERE tissue_fraction >= 0.75::DOUBLE ORDER BY slide_id, y, x LIMIT 100) SELECT * FROM k UNION ALL SELECT DISTINCT slide_id, NULL, NULL, NULL::DOUBLE FROM q WHERE slide_id NOT IN (SELECT slide_id FROM k)")
def _(t):
    pixels = t("lineitem").selectExpr("l_suppkey AS slide_id", "CAST(l_partkey % 4 AS INT) * 10 AS y", "l_linenumber * 10 AS x", "CAST(l_quantity AS INT) * 5 AS r", "CAST(l_orderkey % 256 AS INT) AS g", "250 AS b")
    return ST.tissue_tiles(ST.tissue_fraction(pixels, "slide_id", "y", "x", darkness=0.3), 0.75, 100)


# -- hashes and requests


@_query("derivation_hash", """SELECT p_partkey, sha256('{"bin_width":' || p_size || ',"name":"' || p_brand || '","parent":' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE '"' || p_partkey || '"' END || '}') AS h FROM part""")
def _(t):
    parent = F.when(F.col("p_size") % 2 == 1, F.col("p_partkey").cast("string"))
    return t("part").select("p_partkey", H.derivation_hash_of(name=F.col("p_brand"), parent=parent, bin_width=F.col("p_size")).alias("h"))


@_query("image_derivation_hash", """SELECT doc_id, sha256('{"image_identity":"' || CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE sha256(text) END || '","params":{"n":1},"processor":"lungmask_default"}') AS h FROM documents""")
def _(t):
    strong = F.when(F.col("doc_id") % 3 != 0, F.sha2("text", 256))
    return t("documents").select("doc_id", H.image_derivation_hash(strong, F.md5("text"), F.lit("lungmask_default"), F.struct(F.lit(1).alias("n"))).alias("h"))


@_query("collection_hash", """SELECT source, count(*) AS n, sha256('{"dataset_id":"d","image_hashes":[' || string_agg('"' || h || '"', ',' ORDER BY h) || '],"processor":"p"}') AS collection_hash FROM (SELECT source, sha256(text) AS h FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def _(t):
    return H.collection_hashes(t("documents").select("source", F.sha2("text", 256).alias("h")), "source", "h", {"processor": "p", "dataset_id": "d"})


@_query("paired_mask_hash", "SELECT doc_id, coalesce(md5(CAST(doc_id AS VARCHAR)), '') || ':' || CASE WHEN quality IS NULL THEN '' ELSE md5(CAST(quality AS VARCHAR)) END AS h FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    both = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return both.select("doc_id", H.paired_hash(F.md5(F.col("doc_id").cast("string")), F.md5(F.col("quality").cast("string"))).alias("h"))


@_query("fingerprint_diff", "WITH a AS (SELECT lang AS dataset_id, source || '/' || doc_id AS sample_id, md5(text) AS fingerprint, doc_id FROM documents), b AS (SELECT dataset_id, sample_id, CASE WHEN md5(fingerprint) < '3' THEN 'old' ELSE fingerprint END AS f FROM a WHERE md5(sample_id) < 'c') SELECT a.dataset_id, a.sample_id, a.fingerprint, CASE WHEN f IS NULL THEN 'new' WHEN f <> fingerprint THEN 'changed' ELSE 'unchanged' END AS status FROM a LEFT JOIN b ON a.dataset_id IS NOT DISTINCT FROM b.dataset_id AND a.sample_id = b.sample_id")
def _(t):
    fresh = t("documents").select(F.col("lang").alias("dataset_id"), F.concat("source", F.lit("/"), "doc_id").alias("sample_id"), F.md5("text").alias("fingerprint"))
    stored = fresh.where(F.md5("sample_id") < "c").withColumn("fingerprint", F.when(F.md5("fingerprint") < "3", F.lit("old")).otherwise(F.col("fingerprint")))
    return H.fingerprint_diff(fresh, stored)


@_query("decoded_requests", """SELECT conv_id, turn, '{"role":"' || role || '","n":' || length(text) || '}' AS request FROM conversations""")
def _(t):
    body = F.concat(F.lit('{"role":"'), "role", F.lit('","n":'), F.length("text"), F.lit("}"))
    sent = F.when(F.col("turn") % 2 == 0, body).otherwise(F.concat(F.lit("B64:"), F.rtrim(F.translate(F.base64(body), "+/=", "-_"), F.lit("="))))
    return t("conversations").select("conv_id", "turn", H.decoded(F.regexp_replace(sent, "\\s", "")).alias("request"))


_URL = {
    "d": "CASE page_id % 4 WHEN 0 THEN 'imaging+dataset://ds' || page_id || '?endpoint=http%3A%2F%2Fh%3A9000&bucket=b' || page_id || '&region=' WHEN 1 THEN 'imaging+dataset://10.0.0.1:9000/bk/datasets/c' || page_id WHEN 2 THEN 'imaging+dataset://s3.eu-west-1.amazonaws.com/bk/x/c' || page_id || '@eu-west-1' ELSE 'imaging+dataset://only' || page_id END",
}


@_query("resource_urls", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ds' || page_id WHEN 3 THEN 'only' || page_id ELSE 'c' || page_id END AS dataset_id, CASE page_id % 4 WHEN 0 THEN 'http://h:9000' WHEN 1 THEN 'http://10.0.0.1:9000' WHEN 2 THEN 'https://s3.eu-west-1.amazonaws.com' ELSE '' END AS endpoint, CASE page_id % 4 WHEN 0 THEN 'b' || page_id WHEN 3 THEN '' ELSE 'bk' END AS bucket, CASE page_id % 4 WHEN 0 THEN 'datasets/ds' || page_id WHEN 1 THEN 'datasets/c' || page_id WHEN 2 THEN 'x/c' || page_id ELSE '' END AS prefix, CASE page_id % 4 WHEN 2 THEN 'eu-west-1' ELSE '' END AS region, page_id % 4 <> 3 AS s3 FROM pages")
def _(t):
    return t("pages").select("page_id", RS.parsed_url(F.expr(_URL["d"])).alias("u")).select("page_id", "u.*")


@_query("folder_digests", "SELECT page_id, substr(sha256(url), 1, 16) AS d, upper(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g')) AS e FROM pages")
def _(t):
    return t("pages").select("page_id", H.short_digest(F.col("url")).alias("d"), S.env_name(F.col("url")).alias("e"))


# -- publication

_ITEMS = "i AS (SELECT l_suppkey AS generation_id, l_orderkey || '-' || l_linenumber AS sample_id, CASE WHEN l_suppkey % 4 = 0 THEN 'completed' WHEN l_returnflag = 'N' THEN 'completed' WHEN l_linestatus = 'F' AND l_quantity > 45 THEN 'failed' WHEN l_suppkey % 4 = 1 AND l_quantity < 5 THEN 'running' ELSE 'completed' END AS status FROM lineitem)"
_GENERATIONS = "g AS (SELECT s_suppkey AS generation_id, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN 100000 ELSE 10 END AS expected_n FROM supplier)"
_COUNTS = "c AS (SELECT g.generation_id, expected_n, count(sample_id) AS n_total, count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'running') AS n_running FROM g LEFT JOIN i USING (generation_id) GROUP BY 1, 2)"


def _items(t) -> DataFrame:
    q = F.col("l_quantity")
    status = F.when(F.col("l_suppkey") % 4 == 0, "completed").when(F.col("l_returnflag") == "N", "completed").when((F.col("l_linestatus") == "F") & (q > 45), "failed").when((F.col("l_suppkey") % 4 == 1) & (q < 5), "running").otherwise("completed")
    return t("lineitem").select(F.col("l_suppkey").alias("generation_id"), F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("sample_id"), status.alias("status"), F.col("l_partkey"))


def _generations(t) -> DataFrame:
    n = F.when(F.col("s_suppkey") % 5 == 0, F.lit(None).cast("long")).when(F.col("s_suppkey") % 5 == 1, 100000).otherwise(10)
    return t("supplier").select(F.col("s_suppkey").alias("generation_id"), n.alias("expected_n"))


@_query("collection_status", f"WITH {_ITEMS}, {_GENERATIONS}, {_COUNTS} SELECT generation_id, n_total, n_completed, n_failed, n_running AS not_done, n_running = 0 AND n_total > 0 AND n_total >= coalesce(expected_n, 0) AS is_done FROM c")
def _(t):
    return P.collection_status(_items(t), _generations(t)).select("generation_id", "n_total", "n_completed", "n_failed", "not_done", "is_done")


@_query("publish_decisions", f"WITH {_ITEMS}, {_GENERATIONS}, {_COUNTS} SELECT generation_id, CASE WHEN n_total > 0 AND n_failed / n_total > 0.05::DOUBLE THEN 'blocked' WHEN n_completed < expected_n THEN 'partial' ELSE 'publish' END AS decision, CASE WHEN n_total > 0 THEN round(n_failed / n_total * 100, 1) ELSE 0.0 END AS failed_pct FROM c")
def _(t):
    return P.publish_decisions(P.collection_status(_items(t), _generations(t)))


@_query("mask_validation", f"""WITH {_ITEMS}, a AS (SELECT *, CASE WHEN status = 'completed' AND (generation_id % 4 = 0 OR sample_id LIKE '%-1') THEN 1 ELSE 0 END AS ok FROM i), c AS (SELECT generation_id, count(*) AS total, sum(ok) AS n_valid, count(*) FILTER (status <> 'failed' AND ok = 0) AS n_missing, count(*) FILTER (status = 'failed') AS n_failed FROM a GROUP BY 1)
SELECT generation_id, n_valid = total AS valid, n_missing > 0 AS needs_regeneration, total::BIGINT AS total, n_valid::BIGINT AS n_valid, n_missing::BIGINT AS n_missing, n_failed::BIGINT AS n_failed FROM c""")
def _(t):
    place = F.concat(F.lit("/a/"), "generation_id", F.lit("/"), "sample_id")
    items = _items(t).withColumn("artifact_relpath", place)
    files = items.where("generation_id % 4 = 0 or sample_id like '%-1'").select(F.concat("artifact_relpath", F.lit("/mask.nii.gz")).alias("path"))
    return P.mask_validation(items, files, "sandbox_open")


_JOBS = "j AS (SELECT l_suppkey AS generation_id, l_orderkey || '-' || l_linenumber AS sample_id, CASE WHEN l_partkey % 2 = 0 THEN 'RUNNING' ELSE 'FAILED' END AS job_state FROM lineitem)"


@_query("requeue_orphans", f"WITH {_ITEMS}, {_JOBS} SELECT i.generation_id, i.sample_id, CASE WHEN status = 'running' AND a.sample_id IS NULL THEN 'pending' ELSE status END AS status, CASE WHEN status = 'running' AND a.sample_id IS NULL THEN 'job is gone' END AS error FROM i LEFT JOIN (SELECT DISTINCT generation_id, sample_id FROM j WHERE job_state = 'RUNNING') a USING (generation_id, sample_id)")
def _(t):
    items = _items(t).withColumn("error", F.lit(None).cast("string"))
    jobs = items.select("generation_id", "sample_id", F.when(F.col("l_partkey") % 2 == 0, "RUNNING").otherwise("FAILED").alias("job_state"))
    return P.requeue_orphans(items, _generations(t).withColumn("state", F.lit("PARTIAL")), jobs)[0].drop("l_partkey")


@_query("touched_generations", f"WITH {_ITEMS}, {_JOBS}, l AS (SELECT DISTINCT generation_id FROM i ANTI JOIN (SELECT * FROM j WHERE job_state = 'RUNNING') a USING (generation_id, sample_id) WHERE status = 'running') SELECT s_suppkey AS generation_id, CASE WHEN s_suppkey IN (FROM l) THEN 'RUNNING' ELSE 'PARTIAL' END AS state FROM supplier")
def _(t):
    items = _items(t).withColumn("error", F.lit(None).cast("string"))
    jobs = items.select("generation_id", "sample_id", F.when(F.col("l_partkey") % 2 == 0, "RUNNING").otherwise("FAILED").alias("job_state"))
    return P.requeue_orphans(items, _generations(t).select("generation_id", F.lit("PARTIAL").alias("state")), jobs)[1]


@_query("requeue_invalid", f"WITH {_ITEMS} SELECT generation_id, sample_id, CASE WHEN status = 'completed' AND sample_id LIKE '%-2' THEN 'pending' ELSE status END AS status FROM i")
def _(t):
    items = _items(t)
    missing = items.where("sample_id like '%-2'").select("generation_id", "sample_id", F.array(F.lit("Mean")).alias("missing"))
    return P.requeue_invalid(items.drop("l_partkey"), missing)


@_query("cancelled_items", f"WITH {_ITEMS} SELECT generation_id, sample_id, CASE WHEN generation_id IN (1, 5) AND status = 'running' AND generation_id % 2 = 1 AND generation_id <> 5 THEN 'skipped' ELSE status END AS status FROM i")
def _(t):
    generations = t("supplier").select(F.col("s_suppkey").alias("generation_id"), F.when(F.col("s_suppkey") == 5, "ACTIVE").otherwise("RUNNING").alias("state"))
    return P.cancel(generations, _items(t).drop("l_partkey"), [1, 5], "k", "k")[1]


@_query("feature_contract", "SELECT 'a' || doc_id AS sample_id, n_chars::DOUBLE AS Mean FROM documents UNION ALL SELECT 'b' || doc_id, quality::DOUBLE FROM labels")
def _(t):
    a = t("documents").select(F.concat(F.lit("a"), "doc_id").alias("sample_id"), "lang", F.col("n_chars").cast("double").alias("Mean"))
    b = t("labels").select(F.col("quality").cast("double").alias("Mean"), "toxic", F.concat(F.lit("b"), "doc_id").alias("sample_id"))
    return P.collection_features({"a": a, "b": b}, ["Mean"])


@_query("feature_union", "SELECT 'a' || doc_id AS sample_id, lang, n_chars::DOUBLE AS Mean, NULL::INT AS toxic FROM documents UNION ALL SELECT 'labels', NULL, quality::DOUBLE, toxic FROM labels")
def _(t):
    a = t("documents").select(F.concat(F.lit("a"), "doc_id").alias("sample_id"), "lang", F.col("n_chars").cast("double").alias("Mean"))
    return P.collection_features({"documents": a, "labels": t("labels").select(F.col("quality").cast("double").alias("Mean"), "toxic")})


@_query("column_union", "SELECT string_agg(name, ',' ORDER BY lo) AS columns FROM (SELECT name, min((pos, i)) AS lo FROM (SELECT p_partkey AS pos, unnest(string_split(p_type, ' ')) AS name, generate_subscripts(string_split(p_type, ' '), 1) AS i FROM part) GROUP BY 1)")
def _(t):
    return P.column_union(t("part").select(F.col("p_partkey").alias("position"), F.split("p_type", " ").alias("columns"))).select(F.array_join("columns", ",").alias("columns"))


@_query("tagged_samples", "SELECT o_orderkey AS job_id, CASE WHEN o_orderpriority LIKE '1%' THEN 's1' WHEN o_orderpriority LIKE '2%' THEN 's2' END AS sample_id FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'")
def _(t):
    tags = F.concat(F.lit("extraction, s9,"), F.when(F.col("o_orderpriority").startswith("1"), "s2, s1").when(F.col("o_orderpriority").startswith("2"), " s2 ").otherwise("none"))
    jobs = t("orders").select(F.col("o_orderkey").alias("job_id"), tags.alias("tags"))
    return P.first_tagged(jobs, jobs.sparkSession.createDataFrame([("s1", 0), ("s2", 1)], "sample_id string, position int"))


@_query("masks_listed", "SELECT 'g' || o_orderkey AS alias, CASE WHEN o_orderkey % 2 = 0 THEN 'lungmask' ELSE 'unknown' END AS provider, 'ready' AS status, o_custkey AS n_valid, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders WHERE o_orderstatus = 'F' AND o_custkey >= 20 AND o_orderkey % 3 = 0")
def _(t):
    g = t("orders").select(F.concat(F.lit("g"), "o_orderkey").alias("generation_id"), F.lit("d").alias("dataset_id"), F.when(F.col("o_orderkey") % 3 == 0, "ct_seg").otherwise("features").alias("kind"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").otherwise("RUNNING").alias("state"), F.when(F.col("o_orderkey") % 2 == 0, '{"processor":"lungmask"}').alias("spec_json"), F.lit(20).alias("expected_n"), F.col("o_custkey").alias("completed_n"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    return P.masks_listed(g, "d", "trusted_internal")


@_query("asset_status", "SELECT p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'image_root' WHEN 1 THEN 'feature_table' ELSE 'mask_root' END AS kind, '/d/' || p_partkey || CASE WHEN p_partkey % 3 = 1 THEN '/t.csv' ELSE '/' END AS uri, p_size % 2 = 0 AND p_partkey % 3 <> 2 AS exists FROM part")
def _(t):
    k = F.col("p_partkey") % 3
    assets = t("part").select(F.col("p_partkey").alias("name"), F.when(k == 0, "image_root").when(k == 1, "feature_table").otherwise("mask_root").alias("kind"), F.concat(F.lit("/d/"), "p_partkey", F.when(k == 1, "/t.csv").otherwise("/")).alias("uri"))
    files = t("part").where("p_size % 2 = 0 and p_partkey % 3 <> 2").select(F.concat(F.lit("/d/"), "p_partkey", F.when(k == 1, "/t.csv").otherwise("/deep/i.nii")).alias("path"))
    return P.asset_status(assets, files)


@_query("safe_level_list", "SELECT string_agg(source, ',' ORDER BY source) AS levels FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def _(t):
    return P.safe_levels(t("documents"), "source", 10_000, 1.0).select(F.array_join("levels", ",").alias("levels"))


@_query("catalog_assets", "SELECT p_partkey AS asset_id, 'd' AS dataset_id, 'image_root' AS kind, 'active' AS status, p_retailprice AS created_at FROM part WHERE p_size > 20 AND p_brand LIKE '%1'")
def _(t):
    status = F.when(F.col("p_size") > 20, "active").otherwise("deleted")
    kind = F.when(F.col("p_brand").endswith("1"), "image_root").otherwise("mask_root")
    assets = t("part").select(F.col("p_partkey").alias("asset_id"), F.lit("d").alias("dataset_id"), kind.alias("kind"), status.alias("status"), F.col("p_retailprice").alias("created_at"), F.lit("/x").alias("path_or_root"), F.lit("").alias("description"))
    return P.assets_of(assets, "d", "image_root")


# -- joins


@_query("resolve_ids_and_aliases", "SELECT n AS name, CASE WHEN n LIKE 'Supplier%' AND n IN (SELECT s_name FROM supplier) THEN n ELSE (SELECT min(s_name) FROM supplier WHERE 'nation' || s_nationkey = n) END AS asset_id FROM (SELECT DISTINCT c_name AS n FROM customer UNION SELECT s_name FROM supplier UNION SELECT 'nation' || n_nationkey FROM nation UNION SELECT 'nation' || (n_nationkey + 20) FROM nation)")
def _(t):
    names = t("customer").select(F.col("c_name").alias("name")).union(t("supplier").select("s_name")).union(t("nation").select(F.concat(F.lit("nation"), "n_nationkey"))).union(t("nation").select(F.concat(F.lit("nation"), F.col("n_nationkey") + 20))).distinct()
    aliases = t("supplier").select(F.concat(F.lit("nation"), "s_nationkey").alias("alias"), F.col("s_name").alias("asset_id"))
    # ids are also aliases of another asset: the id counts
    both = aliases.union(t("supplier").select(F.col("s_name").alias("alias"), F.lit("wrong").alias("asset_id")))
    return R.resolve_id_or_alias(names, t("supplier").select(F.col("s_name").alias("asset_id")), both)


@_query("lineage_ancestors", "WITH RECURSIVE p AS (SELECT DISTINCT p_partkey AS a, p_partkey // 3 AS b FROM part WHERE p_partkey >= 3), c AS (SELECT a, b, 1 AS steps FROM p UNION ALL SELECT c.a, p.b, c.steps + 1 FROM c JOIN p ON c.b = p.a) SELECT a AS asset_id, b AS ancestor, min(steps)::BIGINT AS steps FROM c GROUP BY 1, 2")
def _(t):
    return R.ancestors(t("part").where("p_partkey >= 3").select(F.col("p_partkey").alias("asset_id"), F.floor(F.col("p_partkey") / 3).alias("parent_asset_id")))


@_query("metadata_first_match", "SELECT l_orderkey, l_linenumber, first_flag FROM lineitem LEFT JOIN (SELECT o_custkey AS l_orderkey, arg_min(o_orderstatus, (o_orderkey)) AS first_flag FROM orders GROUP BY 1) USING (l_orderkey)")
def _(t):
    meta = t("orders").select(F.col("o_custkey").alias("l_orderkey"), "o_orderkey", F.col("o_orderstatus").alias("first_flag"), F.lit(0).alias("l_linenumber"))
    return R.join_metadata(t("lineitem").select("l_orderkey", "l_linenumber"), meta, "l_orderkey", ["o_orderkey"]).drop("o_orderkey")


@_query("upsert_changed", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'b' ELSE 'a' END AS h, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS updated_at FROM documents")
def _(t):
    stored = t("documents").select("doc_id", F.lit("a").alias("h"), F.lit(1).alias("updated_at"))
    new = t("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "b").otherwise("a").alias("h"), F.lit(2).alias("updated_at"))
    return R.upsert_changed(stored, new, ["doc_id"], ["h"])


@_query("active_aliases", "SELECT s_name AS alias, s_nationkey AS asset_id, n_name AS path_or_root FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2")
def _(t):
    assets = t("nation").select(F.col("n_nationkey").alias("asset_id"), F.col("n_name").alias("path_or_root"), F.when(F.col("n_regionkey") == 2, "deleted").otherwise("active").alias("status"))
    return R.active_aliases(t("supplier").select(F.col("s_name").alias("alias"), F.col("s_nationkey").alias("asset_id")), assets)


# -- voxel kernels


@_query("voxel_resample_nearest", f"WITH {_VOLUME}, s AS (SELECT DISTINCT sample_id FROM v), t AS (SELECT sample_id, tz.z, ty.y, tx.x FROM s, (SELECT unnest(range(4)) AS z) tz, (SELECT unnest(range(5)) AS y) ty, (SELECT unnest(range(9)) AS x) tx) SELECT t.sample_id, t.z, t.y, t.x, coalesce(value, 0) AS value FROM t LEFT JOIN v ON v.sample_id = t.sample_id AND v.z = floor(t.z * 2.0::DOUBLE / 1 + 0.5::DOUBLE) AND v.y = floor((0.5::DOUBLE + t.y * 1.5::DOUBLE) + 0.5::DOUBLE) AND v.x = floor(t.x * 0.7::DOUBLE + 0.5::DOUBLE)")
def _(t):
    volume = _volume(t)
    own = volume.groupBy("sample_id").agg(*[(F.max(a) + 1).alias(f"n_{a}") for a in V.AXES]).withColumns({f"{p}_{a}": F.lit(v) for p, v in (("s", 1.0), ("o", 0.0)) for a in V.AXES})
    target = own.select("sample_id").withColumns({"n_z": F.lit(4), "n_y": F.lit(5), "n_x": F.lit(9), "s_z": F.lit(2.0), "s_y": F.lit(1.5), "s_x": F.lit(0.7), "o_z": F.lit(0.0), "o_y": F.lit(0.5), "o_x": F.lit(0.0)})
    return V.resample_nearest(volume, own, target)


@_query("contour_masks", "WITH b AS (SELECT p_partkey AS source, p_size % 7 + 1 AS h, p_partkey % 5 + 1 AS w FROM part) SELECT source, 'box' AS roi, 0 AS z, y, x FROM (SELECT source, h, w, unnest(range(2, 2 + h)) AS y FROM b), (SELECT unnest(range(12)) AS x) WHERE x BETWEEN 1 AND w AND y < 8")
def _(t):
    part = t("part").select(F.col("p_partkey").alias("source"), (F.col("p_size") % 7 + 1).alias("h"), (F.col("p_partkey") % 5 + 1).alias("w"))
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    lo_x, lo_y, hi_x, hi_y = F.lit(0.5), F.lit(1.5), F.col("w") + 0.5, F.col("h") + 1.5
    contours = part.select("source", F.lit("box").alias("roi"), F.lit(0).alias("contour"), F.lit(0).alias("z"), F.array(at(lo_x, lo_y), at(hi_x, lo_y), at(hi_x, hi_y), at(lo_x, hi_y)).alias("points"))
    return V.contours_to_mask(contours, part.select("source", F.lit(8).alias("n_y"), F.lit(12).alias("n_x")))


@_query("frame_segments", "WITH f AS (SELECT l_suppkey AS source, l_linenumber AS frame, 1 + l_linenumber % 2 AS seg, CAST(l_partkey % 6 AS INT) AS y, CAST(l_quantity AS INT) % 6 AS x FROM lineitem WHERE l_suppkey % 4 <> 0), o AS (SELECT source, seg, frame, row_number() OVER (PARTITION BY source, seg ORDER BY frame) - 1 AS z FROM (SELECT DISTINCT source, seg, frame FROM f)) SELECT DISTINCT source, CASE seg WHEN 1 THEN 'lung' ELSE 'segment_2' END AS roi, z, y, x FROM f JOIN o USING (source, seg, frame)")
def _(t):
    frames = t("lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("frame"), (1 + F.col("l_linenumber") % 2).alias("segment_number"), (F.col("l_partkey") % 6).cast("int").alias("y"), (F.col("l_quantity").cast("int") % 6).alias("x"), F.when(F.col("l_suppkey") % 4 == 0, 0).otherwise(1).alias("value"))
    names = t("supplier").select(F.col("s_suppkey").alias("source"), F.explode(F.array(F.lit(1), F.lit(2))).alias("segment_number")).withColumn("label", F.when(F.col("segment_number") == 1, "lung"))
    return V.segments(frames, names).distinct()


@_query("slide_tiles", "SELECT slide_id, y, x, 256 AS tile_size FROM (SELECT s_suppkey AS slide_id, 300 + s_suppkey % 1000 AS w, 200 + s_suppkey % 900 AS h FROM supplier), LATERAL (SELECT unnest(range(0, greatest(1, h - 256 + 1), 128)) AS y), LATERAL (SELECT unnest(range(0, greatest(1, w - 256 + 1), 128)) AS x)")
def _(t):
    slides = t("supplier").select(F.col("s_suppkey").alias("slide_id"), (300 + F.col("s_suppkey") % 1000).cast("int").alias("width"), (200 + F.col("s_suppkey") % 900).cast("int").alias("height"))
    return V.tiles(slides, 256, 128)


@_query("slice_overlays", f"WITH {_VOLUME}, {_MASK}, p AS (SELECT sample_id, y, x, CAST(floor(value / 1000000 * 255) AS INT) AS g FROM v WHERE z = 2), k AS (SELECT DISTINCT sample_id, y, x FROM m WHERE z = 2) SELECT p.sample_id, p.y, p.x, CASE WHEN k.x IS NULL THEN g ELSE 255 END AS red, CASE WHEN k.x IS NULL THEN g ELSE CAST(floor(g * 0.35::DOUBLE) AS INT) END AS green, CASE WHEN k.x IS NULL THEN g ELSE CAST(floor(g * 0.35::DOUBLE) AS INT) END AS blue FROM p LEFT JOIN k USING (sample_id, y, x)")
def _(t):
    slices = _volume(t).where("z = 2").select("sample_id", "y", "x", (F.col("value") / 1000000).alias("value"))
    mask = _voxels(t, "l_returnflag").where("z = 2 and sample_id % 3 <> 0 and l_returnflag = 'R' and sample_id % 5 <> 0")
    return V.overlay(slices, mask)


@_query("public_names", "SELECT sample_id, printf('case_%04d_', row_number() OVER (ORDER BY sample_id)) || substr(sha256(sample_id), 1, 12) AS qc_id FROM (SELECT DISTINCT c_name AS sample_id FROM customer ORDER BY 1 LIMIT 24)")
def _(t):
    return V.visuals(t("customer").select(F.col("c_name").alias("sample_id")))
