
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: image extensions, longest first.
EXTENSIONS = r"(?i)\.(nii\.gz|nii|nrrd|mha|mhd|dcm)$"
#: Fixed value: messages of submissions worth trying again.
TRANSIENT = "(?i)quota exceeded|database is locked|database is busy|SQLITE_BUSY|locked database"
#: Fixed value: names that speak of a mask.
MASK_NAME = "(?i)mask|seg|label|gtv"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def sample_id(path: Column) -> Column:
    """STR-01: the base name without a known image extension, else without its last extension."""
    name = base_name(path)
    return F.when(name.rlike(EXTENSIONS), F.regexp_replace(name, EXTENSIONS, "")).otherwise(F.regexp_replace(name, r"\.[^.]+$", ""))


def safe_id(value: Column) -> Column:
    """STR-02: characters outside [A-Za-z0-9_.-] become one underscore, dots and underscores at the ends go; empty is 'sample'."""
    clean = F.regexp_replace(F.regexp_replace(sample_id(value), r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("sample"))


def safe_string(value: Column, limit: int = 80) -> Column:
    return F.substring(value, 1, limit)


def public_name(n: Column, value: Column) -> Column:
    """STR-09."""
    return F.format_string("case_%04d_%s", n, F.substring(F.sha2(value, 256), 1, 12))


def normal_etag(tag: Column) -> Column:
    """STR-05."""
    return F.nullif(F.regexp_replace(F.trim(tag), '^"|"$', ""), F.lit(""))


def content_hash(checksum: Column, tag: Column, stream: Column) -> tuple[Column, Column]:
    """HSH-05: (hash, source) by precedence: checksum, single-part etag, stream."""
    etag = normal_etag(tag)
    single = etag.rlike("^[0-9a-fA-F]{32}$")
    given = F.nullif(checksum, F.lit("")).isNotNull()
    value = F.when(given, checksum).when(single, F.lower(etag)).otherwise(stream)
    return value, F.when(given, "checksum_sha256").when(single, "etag_md5").otherwise("stream")


def bucket_count(n: Column) -> Column:
    """MTH-01: null or not positive is 0, below 4 exact, else the nearest power of two (by logarithm)."""
    return F.when(n.isNull() | (n <= 0), 0).when(n < 4, n).otherwise(F.pow(F.lit(2.0), F.round(F.log2(F.greatest(n, F.lit(1)))))).cast("long")


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def resample_size(size: Column, spacing: Column, target: Column) -> Column:
    """MTH-03: rounds half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(size * spacing / target).cast("int"))


def file_time(seconds: Column) -> Column:
    """DT-03: a file's time, given in seconds, without fractions."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_transient(message: Column) -> Column:
    """STR-12."""
    return F.coalesce(message.rlike(TRANSIENT), F.lit(False))


def speaks_of_mask(path: Column, value: Column | None = None) -> Column:
    """STR-11: the base name says that it is a mask, and holds ``value`` as it stands, if given."""
    name = base_name(path)
    return name.rlike(MASK_NAME) if value is None else name.rlike(MASK_NAME) & F.contains(name, value)


def env_name(value: Column) -> Column:
    """STR-10."""
    return F.upper(F.regexp_replace(value, "[^A-Za-z0-9]+", "_"))


def is_profile_name(value: Column) -> Column:
    """STR-13."""
    return value.rlike("^[a-zA-Z0-9_]+$")


def items_of(value: Column, pattern: str = ",") -> Column:
    """STR-08: the trimmed items of a joined list, without empty ones."""
    return F.filter(F.transform(F.split(value, pattern), lambda x: F.trim(x)), lambda x: x != "")


def dose(pixel: Column, scaling: Column) -> Column:
    """MTH-07: a stored dose value in its unit; without a scaling it is 1."""
    return pixel * F.coalesce(scaling, F.lit(1.0))


def flag_of(value: Column, default: bool = False) -> Column:
    """CND-03: 1, true, yes and y are true, null and empty the default, all else false."""
    clean = F.lower(F.trim(value))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit(default)).otherwise(clean.isin("1", "true", "yes", "y"))


def number_of(value: Column, default: float = 0.0) -> Column:
    """CND-03: what is no number is the default."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_hours(ts: Column, now: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(ts)) / 3600.0


def l2_norm(v: Column) -> Column:
    """MTH-06."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column) -> Column:
    norm = l2_norm(v)
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def s3_bucket(uri: Column) -> Column:
    return F.regexp_extract(uri, "^s3a?://([^/]+)/?(.*)$", 1)


def s3_key(uri: Column) -> Column:
    return F.regexp_extract(uri, "^s3a?://([^/]+)/?(.*)$", 2)


def tile_origins(length: Column, tile: int, stride: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.lit(0), length - tile), F.lit(stride))
