
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S
from lumenframe.operators import disclosure as D
from lumenframe.operators import generations as G
from lumenframe.operators import publishing as P
from lumenframe.operators import relational as R
from lumenframe.operators import statistics as ST
from lumenframe.operators import voxels as V
from lumenframe.session import table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    """Registers ``fn(t)``; ``t(table)`` reads a driver table."""

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


_BUCKET = "CASE WHEN n IS NULL OR n<=0 THEN 0 WHEN n<4 THEN n ELSE CAST(pow(2,round(log2(n))) AS BIGINT) END"


@_query("flagship_label_distribution", "SELECT d.lang, count(*) AS n, count(l.quality) AS n_labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1 HAVING count(*) >= 3")
def _(t):
    joined = R.join_metadata(t("documents").select("doc_id", "lang"), t("labels"), "doc_id")
    out = joined.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("n_labelled"))
    return out.where(F.col("n") >= D.THRESHOLD).orderBy("lang")


@_query("label_dist_suppressed", "SELECT quality, toxic, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1,2 HAVING count(*) >= 3")
def _(t):
    return D.label_distribution(t("labels"), ["quality", "toxic"])


@_query("suppressed_class_count", "SELECT CAST(coalesce(sum(CASE WHEN n<12 THEN 1 ELSE 0 END),0) AS BIGINT) AS suppressed FROM (SELECT source, count(*) n FROM documents GROUP BY 1)")
def _(t):
    return D.suppressed_classes(t("documents"), ["source"], 12)


@_query("safe_count_profiles", f"WITH c AS (SELECT event_type, count(*) n FROM events GROUP BY 1) SELECT event_type, n AS sandbox_open, n AS trusted_internal, {_BUCKET} AS clinical_default, CASE WHEN n<3 THEN NULL ELSE {_BUCKET} END AS clinical_hardened, CASE WHEN n<3 THEN NULL ELSE {_BUCKET} END AS high_sensitivity_dp FROM c")
def _(t):
    n = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", *[D.safe_count(F.col("n"), p).alias(p) for p in D.PROFILES])


@_query("safe_distribution", f"WITH c AS (SELECT user_id, count(*) n FROM events GROUP BY 1) SELECT user_id, n AS open_n, CASE WHEN n>=3 THEN {_BUCKET} END AS default_n, CAST(NULL AS BIGINT) AS hardened_n FROM c")
def _(t):
    n = t("events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", *[D.safe_distribution(F.col("n"), p).alias(a) for p, a in (("sandbox_open", "open_n"), ("clinical_default", "default_n"), ("clinical_hardened", "hardened_n"))])


@_query("safe_levels", "SELECT count(DISTINCT source) AS levels, count(*) AS n, CASE WHEN count(DISTINCT source)>40 OR count(DISTINCT source)*1.0/count(*)>0.33 THEN false ELSE true END AS released FROM documents")
def _(t):
    c = t("documents").agg(F.count_distinct("source").alias("levels"), F.count("*").alias("n"))
    return c.withColumn("released", ~((F.col("levels") > 40) | (F.col("levels") / F.col("n") > 0.33)))


@_query("safe_string", "SELECT doc_id, substr(text,1,80) AS head FROM documents")
def _(t):
    return t("documents").select("doc_id", S.safe_string(F.col("text")).alias("head"))


@_query("min_row_gate", "SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 3")
def _(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n")).where("n >= 3")


@_query("feature_metadata_left_join", "SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    return R.join_metadata(t("documents").select("doc_id", "n_chars"), t("labels"), "doc_id")


@_query("null_safe_left_join", "WITH m AS (SELECT nullif(n_regionkey, 0) AS k, min(n_name) AS n_name FROM nation GROUP BY 1) SELECT s_suppkey, s.k, n_name FROM (SELECT s_suppkey, nullif(s_nationkey % 5, 0) AS k FROM supplier) s LEFT JOIN m ON s.k IS NOT DISTINCT FROM m.k")
def _(t):
    features = t("supplier").select("s_suppkey", F.nullif(F.col("s_nationkey") % 5, F.lit(0)).alias("k"))
    return R.join_metadata(features, t("nation").select(F.nullif("n_regionkey", F.lit(0)).alias("k"), "n_name"), "k", ["n_name"])


@_query("column_projection", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(t):
    return R.project(t("lineitem"), ["l_orderkey", "l_quantity"])


@_query("lineage_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@_query("in_subquery_latest", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING') ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def _(t):
    c = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.in_latest(t("orders"), c, "o_custkey", F.desc("o_orderdate"), F.col("o_orderkey")).select("o_orderkey", "o_custkey")


@_query("hash_diff", "WITH now AS (SELECT doc_id, sha256(text) AS h FROM documents), old AS (SELECT doc_id, sha256(regexp_replace(text, 'e', 'E')) AS h FROM documents WHERE length(text) % 5 <> 0) SELECT now.doc_id, CASE WHEN old.doc_id IS NULL THEN 'new' WHEN now.h IS DISTINCT FROM old.h THEN 'changed' ELSE 'unchanged' END AS status FROM now LEFT JOIN old USING (doc_id)")
def _(t):
    now = t("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    first = F.when(F.instr("text", "e") > 0, F.overlay("text", F.lit("E"), F.instr("text", "e"))).otherwise(F.col("text"))
    stored = t("documents").where("length(text) % 5 <> 0").select("doc_id", F.sha2(first, 256).alias("content_hash"))
    return R.diff_index(now, stored, "doc_id", "content_hash")


@_query("incremental_anti_join", "SELECT doc_id, CASE WHEN doc_id%3=0 THEN 'stored' ELSE 'hashed' END AS origin FROM documents")
def _(t):
    ids = t("documents").select("doc_id")
    return R.extend_index(ids.where("doc_id % 3 = 0").withColumn("origin", F.lit("stored")), ids.withColumn("origin", F.lit("hashed")), "doc_id")


@_query("pairing_inner", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id)")
def _(t):
    return t("documents").join(t("labels"), "doc_id").select("doc_id", "quality")


@_query("optional_pairing", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN d.n_chars END AS masked_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    d, m = t("documents"), t("labels").select("doc_id", F.lit(True).alias("has_mask"))
    return d.join(m, "doc_id", "left").select("doc_id", F.when(F.col("has_mask"), F.col("n_chars")).alias("masked_chars"))


@_query("orphan_anti_join", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey=o.o_orderkey AND l.l_linestatus='O')")
def _(t):
    active = t("lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").join(active, "o_orderkey", "left_anti").select("o_orderkey")


@_query("tag_explode_join", "SELECT r_name, count(*) AS n FROM (SELECT unnest(string_split(p_type,' ')) AS tag FROM part) x, (SELECT DISTINCT upper(r_name) AS r_name FROM region UNION SELECT DISTINCT split_part(p_type,' ',1) FROM part) k WHERE x.tag=k.r_name GROUP BY 1")
def _(t):
    tags = t("part").select(F.explode(F.split("p_type", " ")).alias("tag"))
    keys = t("region").select(F.upper("r_name").alias("r_name")).union(t("part").select(F.substring_index("p_type", " ", 1))).distinct()
    return tags.join(keys, F.col("tag") == F.col("r_name")).groupBy("r_name").agg(F.count("*").alias("n"))


@_query("status_counts", "SELECT l_orderkey, count(*) FILTER (l_linestatus='F') AS completed_n, count(*) FILTER (l_linestatus='O') AS failed_n FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("completed_n"), F.count_if(F.col("l_linestatus") == "O").alias("failed_n"))


@_query("status_pivot", "SELECT user_id, count(*) FILTER (event_type='click') AS click, count(*) FILTER (event_type='error') AS error, count(*) FILTER (event_type='view') AS view FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1))).na.fill(0)


@_query("failure_rate", "SELECT user_id, avg(CASE WHEN event_type='error' THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY 1 HAVING avg(CASE WHEN event_type='error' THEN 1.0 ELSE 0.0 END) > 0.05")
def _(t):
    return t("events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("rate")).where("rate > 0.05")


@_query("qc_metrics", "SELECT user_id AS sample_id, min(value) AS image_min, max(value) AS image_max, avg(value) AS image_mean, stddev_pop(value) AS image_std FROM events GROUP BY 1")
def _(t):
    return ST.image_metrics(t("events").select(F.col("user_id").alias("sample_id"), "value"))


@_query("masked_qc", "SELECT user_id, count(*) FILTER (event_type='purchase') AS mask_voxels, avg(value) FILTER (event_type='purchase') AS masked_mean, stddev_pop(value) FILTER (event_type='purchase') AS masked_std, min(value) FILTER (event_type='purchase') AS masked_min, max(value) FILTER (event_type='purchase') AS masked_max FROM events GROUP BY 1")
def _(t):
    inside = F.when(F.col("event_type") == "purchase", F.col("value"))
    named = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return t("events").groupBy("user_id").agg(F.count(inside).alias("mask_voxels"), *[f(inside).alias(f"masked_{n}") for n, f in named.items()])


@_query("grouping_sets", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag),(l_returnflag,l_linestatus))")
def _(t):
    flag, state = F.col("l_returnflag"), F.col("l_linestatus")
    return t("lineitem").groupingSets([[flag], [flag, state]], flag, state).agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


@_query("rollup_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@_query("embedding_norm", "SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)*CAST(x AS DOUBLE)))) AS norm, CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)*CAST(x AS DOUBLE)))) AS first FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", S.l2_norm(F.col("embedding")).alias("norm"), F.get(S.l2_normalised(F.col("embedding")), F.lit(0)).alias("first"))


@_query("percentile_clip_hist", "WITH p AS (SELECT event_type, quantile_cont(value,0.01) lo, quantile_cont(value,0.99) hi FROM events GROUP BY 1), c AS (SELECT e.event_type, lo, hi, least(greatest(value,lo),hi) v FROM events e JOIN p USING (event_type)) SELECT event_type, CAST(least(floor((v-lo)/(hi-lo)*32),31) AS BIGINT) AS bin, count(*) AS n FROM c GROUP BY 1,2")
def _(t):
    e = t("events")
    p = ST.quantiles(e, "event_type", "value", [0.01, 0.99]).select("event_type", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
    c = e.join(p, "event_type").withColumn("v", F.least(F.greatest("value", "lo"), F.col("hi")))
    return c.withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 32), F.lit(31)).cast("long")).groupBy("event_type", "bin").agg(F.count("*").alias("n"))


@_query("glcm_pairs", "WITH b AS (SELECT user_id, event_id, CAST(floor(value/25) AS BIGINT) g, ts FROM events), p AS (SELECT g AS i, lead(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j FROM b) SELECT i, j, count(*) AS n FROM p WHERE j IS NOT NULL GROUP BY 1,2")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    b = t("events").withColumn("i", F.floor(F.col("value") / 25).cast("long"))
    return b.select("i", F.lead("i").over(w).alias("j")).where("j is not null").groupBy("i", "j").agg(F.count("*").alias("n"))


@_query("glrlm_runs", "WITH b AS (SELECT user_id, CAST(floor(value/100) AS BIGINT) g, row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id) r, row_number() OVER (PARTITION BY user_id, CAST(floor(value/100) AS BIGINT) ORDER BY ts,event_id) q FROM events), runs AS (SELECT user_id, g, r-q AS k, count(*) AS len FROM b GROUP BY 1,2,3) SELECT g AS level, len AS run_length, count(*) AS n FROM runs GROUP BY 1,2")
def _(t):
    b = t("events").withColumn("level", F.floor(F.col("value") / 100).cast("long"))
    order = ["ts", "event_id"]
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - F.row_number().over(Window.partitionBy("user_id", "level").orderBy(*order))
    runs = b.withColumn("k", k).groupBy("user_id", "level", "k").agg(F.count("*").alias("run_length"))
    return runs.groupBy("level", "run_length").agg(F.count("*").alias("n"))


@_query("zscore_window", "SELECT z, y, x, sample_id, CASE WHEN s > 0 THEN (value - m) / s ELSE value END AS value FROM (SELECT event_id AS z, 0 AS y, 0 AS x, k AS sample_id, v AS value, avg(v) OVER (PARTITION BY k) AS m, stddev_pop(v) OVER (PARTITION BY k) AS s FROM (SELECT event_id, user_id % 10 AS k, CASE WHEN user_id % 10 = 3 THEN 7.0 ELSE value END AS v FROM events))")
def _(t):
    value = F.when(F.col("user_id") % 10 == 3, 7.0).otherwise(F.col("value"))
    volume = t("events").select((F.col("user_id") % 10).alias("sample_id"), F.col("event_id").alias("z"), F.lit(0).alias("y"), F.lit(0).alias("x"), value.alias("value"))
    return V.preprocess(volume, [{"op": "zscore"}])


@_query("clamp_cast", "SELECT event_id, least(greatest(value,10.0),50.0) AS v FROM events")
def _(t):
    return t("events").select("event_id", S.clamp(F.col("value"), 10.0, 50.0).alias("v"))


@_query("topk_per_group", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank<=2")
def _(t):
    return R.top_k(t("orders"), ["o_custkey"], 2, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "rank")


@_query("enumerated_topk", "SELECT printf('case_%04d_%s', n, substr(sha256(CAST(doc_id AS VARCHAR)),1,12)) AS qc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 24))")
def _(t):
    top = t("documents").select("doc_id").orderBy("doc_id").limit(24)
    return top.select(S.public_name(F.row_number().over(Window.orderBy("doc_id")), F.col("doc_id").cast("string")).alias("qc_id"))


@_query("claim_topk", "SELECT o_orderkey, o_orderstatus AS status FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND row_number() OVER (PARTITION BY o_orderstatus ORDER BY lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) <= 10 THEN 'claimed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'completed' END AS o_orderstatus FROM orders)")
def _(t):
    status = F.when(F.col("o_orderstatus") == "O", "pending").otherwise("completed")
    items = t("orders").select(F.lit("g").alias("generation_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("sample_id"), "o_orderkey", status.alias("status"), F.lit("").alias("claimed_by"), F.lit("").alias("claimed_at"))
    return G.feed(items, "me", F.lit("2024-01-01 00:00:00").cast("timestamp")).select("o_orderkey", "status")


@_query("last_write_wins", "SELECT user_id, arg_max(event_type, (ts,event_id)) AS event_type FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@_query("insert_or_ignore", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'stored' ELSE 'new' END AS origin FROM events")
def _(t):
    rows = t("events").select("event_id")
    return R.insert_or_ignore(rows.where("event_id % 3 = 0").withColumn("origin", F.lit("stored")), rows.withColumn("origin", F.lit("new")), ["event_id"])


@_query("idempotent_upsert", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts,event_id) p FROM events) WHERE event_type IS DISTINCT FROM p")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").withColumn("p", F.lag("event_type").over(w)).where(~F.col("event_type").eqNullSafe(F.col("p"))).select("event_id")


@_query("sticky_status_fold", "WITH s AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END st FROM events) SELECT user_id, arg_max(st, (CASE st WHEN 'completed' THEN 3 WHEN 'failed' THEN 2 ELSE 1 END, ts, event_id)) AS status FROM s GROUP BY 1")
def _(t):
    st = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return R.sticky_fold(t("events").withColumn("st", st), "user_id", F.col("st"), [F.col("ts"), F.col("event_id")])


@_query("dedup_by_hash", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"))


@_query("hash_precedence", "SELECT doc_id, CASE WHEN doc_id%3=0 THEN sha256(text) WHEN doc_id%3=1 THEN md5(text) ELSE 'stream' END AS content_hash, CASE WHEN doc_id%3=0 THEN 'checksum_sha256' WHEN doc_id%3=1 THEN 'etag_md5' ELSE 'stream' END AS hash_source FROM documents")
def _(t):
    k = F.col("doc_id") % 3
    value, source = S.content_hash(F.when(k == 0, F.sha2("text", 256)), F.when(k == 1, F.concat(F.lit('"'), F.md5("text"), F.lit('"'))).otherwise(F.concat(F.md5("text"), F.lit("-2"))), F.lit("stream"))
    return t("documents").select("doc_id", value.alias("content_hash"), source.alias("hash_source"))


@_query("union_by_name_nulls", "SELECT c_name AS name, c_mktsegment AS segment, NULL::BIGINT AS suppkey FROM customer UNION ALL SELECT s_name, NULL, s_suppkey FROM supplier")
def _(t):
    return R.union_by_name([t("customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), t("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("suppkey"))])


@_query("set_ops", "(SELECT 'both' AS side, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)) UNION ALL (SELECT 'customer', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier))")
def _(t):
    c, s = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).select(F.lit("both").alias("side"), "k").union(c.subtract(s).select(F.lit("customer"), "k"))


@_query("mask_algebra", "SELECT coalesce(a.doc_id,b.doc_id) AS doc_id, a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AS inter, a.doc_id IS NOT NULL AND b.doc_id IS NULL AS diff FROM (SELECT doc_id FROM documents WHERE lang='en') a FULL JOIN (SELECT doc_id FROM labels) b ON a.doc_id=b.doc_id")
def _(t):
    a, b = t("documents").where("lang = 'en'").select("doc_id", F.lit(True).alias("a")), t("labels").select("doc_id", F.lit(True).alias("b"))
    return a.join(b, "doc_id", "full").select("doc_id", (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("inter"), (F.col("a").isNotNull() & F.col("b").isNull()).alias("diff"))


@_query("label_select_binarize", "SELECT vec_id, label IN (1,3) AS selected, label > 0 AS foreground FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", F.col("label").isin(1, 3).alias("selected"), (F.col("label") > 0).alias("foreground"))


@_query("bbox", "SELECT l_suppkey AS sample_id, min(l_linenumber) AS lo_z, max(l_linenumber) AS hi_z, min(l_partkey) AS lo_y, max(l_partkey) AS hi_y, min(CAST(l_quantity AS INT)) AS lo_x, max(CAST(l_quantity AS INT)) AS hi_x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def _(t):
    mask = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("sample_id"), F.col("l_linenumber").alias("z"), F.col("l_partkey").alias("y"), F.col("l_quantity").cast("int").alias("x"))
    return V.boxes(mask)


@_query("tile_grid", "SELECT p_partkey, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM part, unnest(generate_series(0, greatest(0,p_size-16), 16)) a(x), unnest(generate_series(0, greatest(0,p_size-16), 16)) b(y)")
def _(t):
    at = S.tile_origins(F.col("p_size"), 16, 16)
    return t("part").select("p_partkey", "p_size", F.explode(at).alias("x")).select("p_partkey", "x", F.explode(at).alias("y"))


@_query("strip_ext_safe_id", "SELECT page_id, CASE WHEN s='' THEN 'sample' ELSE s END AS sample FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(url,'[^/]*$'),'\\.[^.]+$',''),'[^A-Za-z0-9_.-]+','_','g'),'^[._]+|[._]+$','','g') s FROM pages)")
def _(t):
    return t("pages").select("page_id", S.safe_id(F.col("url")).alias("sample"))


@_query("uri_parse", "SELECT page_id, split_part(substr(url, 9), '/', 1) AS bucket, CASE WHEN contains(substr(url, 9), '/') THEN substr(substr(url, 9), strpos(substr(url, 9), '/') + 1) ELSE '' END AS key FROM pages WHERE url LIKE 'https://%'")
def _(t):
    uri = F.concat(F.lit("s3://"), F.expr("substr(url, 9)"))
    return t("pages").where(F.col("url").like("https://%")).select("page_id", S.s3_bucket(uri).alias("bucket"), S.s3_key(uri).alias("key"))


@_query("json_extract", "SELECT event_id, json_extract_string(props,'$.k') AS k FROM events")
def _(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@_query("stale_claims", "SELECT event_id, round((epoch(TIMESTAMP '2024-02-01')-floor(epoch(ts)))/3600.0,4) AS age FROM events WHERE ts < TIMESTAMP '2024-01-20'")
def _(t):
    e = t("events").where("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    return e.select("event_id", F.round(S.age_hours(F.col("ts").cast("timestamp"), F.lit("2024-02-01 00:00:00").cast("timestamp")), 4).alias("age"))


@_query("iso_timestamp", "SELECT event_id, strftime(ts,'%Y-%m-%dT%H:%M:%S.%g')||'Z' AS iso FROM events")
def _(t):
    return t("events").select("event_id", S.iso_time(F.col("ts").cast("timestamp")).alias("iso"))


@_query("primary_path", "SELECT conv_id, arg_min(text, turn) AS primary_path FROM conversations GROUP BY 1")
def _(t):
    return t("conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("primary_path"))


@_query("catalog_filter_sort", "SELECT o_orderkey AS asset_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus='F' AND o_orderpriority = '1-URGENT'")
def _(t):
    rows = t("orders").select(F.col("o_orderkey").alias("asset_id"), F.col("o_orderdate").alias("created_at"), "o_orderstatus", "o_orderpriority")
    return P.listed(rows, o_orderstatus="F", o_orderpriority="1-URGENT", asset_id="").select("asset_id", "created_at")


@_query("tumbling_windows", "SELECT date_trunc('day',ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1,2")
def _(t):
    return t("events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@_query("approx_distinct", "SELECT true AS near FROM events LIMIT 1")
def _(t):
    # the estimate is within 5 % of the exact count; a sketch of 13 KB takes in each user once, not one sketch for each user
    users = t("events").select("user_id").distinct()
    n = users.agg(F.approx_count_distinct("user_id", 0.01).alias("a"), F.count("user_id").alias("b"), F.count("*").alias("n")).where("n > 0")
    return n.select((F.abs(F.col("a") - F.col("b")) <= 0.05 * F.col("b")).alias("near"))


@_query("as_of_join", "SELECT event_id, max(ts) FILTER (event_type='view') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return t("events").select("event_id", F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(w).alias("last_view"))
