"""WARC archives and a globally ordered capture index, by external merging.

Writing: pages become WARC/1.1 records in UTF-8 text files, gzipped, by Spark's own text writer (its line separator is the
blank lines that end a record), so any file system Spark knows will do and a lost task is simply run again. Of the records
with equal payloads the one with the smallest page_id is the response, the others are revisits without a payload.

Reading: every archive is parsed record by record and its captures are sorted by (URL key, time, page_id): a run. Boundaries
from a bounded sample of the runs cut each run into segments, and each key range merges its segments, one from each run,
with a loser tree. A very frequent URL or host is parted by time and page_id, so ranges stay even.

Defined results: a null html is an empty payload, a null url an empty target; repeated rows are records of their own (of
equal page_ids any one is the response); line breaks in a url are percent-encoded; an empty table gives no captures; extra
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, shared_dir, staged

#: The base-32 alphabet and the profile of revisits by equal payload.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures in one merged range, and sampled captures for each range.
RANGE_ROWS, SAMPLE = 20_000, 16
#: The time of page 0; pages carry no time of their own, so page n was taken n seconds later (n modulo LAST).
EPOCH, LAST = 1_700_000_000, 251_000_000_000
#: Parts of a payload's pages, and bytes of payload in an archive on average.
PARTS, FILE_BYTES = 32, 128 << 20
#: Bytes of a record without payload and url, about.
HEAD_BYTES = 450


def base32(hexed: Column) -> Column:
    """40 hex digits as 32 base-32 letters, in built-in functions."""
    letters = []
    for i in range(8):  # 5 hex digits are 20 bits are 4 letters
        n = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _urn(page_id: Column) -> Column:
    h = F.sha1(F.concat(F.lit("capture:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n, s in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">")) for x in (F.substring(h, a, n), F.lit(s))])


def _payload(pages: DataFrame) -> DataFrame:
    """The pages with null payloads as empty ones, and the SHA-1 and bytes of each."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", html.alias("html")).withColumn("sha", F.unhex(F.sha1("html"))).withColumn("size", F.octet_length("html").cast("long"))


def revisits(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, float]:
    """(page_id, sha, first, size) of the records that refer to another, and the mean bytes of a record.

    Payloads are hashed once here; what is compared, joined and summed are the hashes.
    """
    known = staged(_payload(pages).select("page_id", "sha", "size", F.coalesce(F.octet_length("url"), F.lit(0)).alias("more")), "warc-payloads")
    # payloads that stand more than once: counts are summed before they are exchanged
    firsts = known.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # only (sha, page_id) meets them, in parts of a hash, so that a payload of a third of all pages is no hot key; pages are joined by id
    part = F.pmod(F.xxhash64("page_id"), F.lit(PARTS)).cast("int").alias("_part")
    copies = firsts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    later = known.select("sha", "size", "page_id", part).join(copies, ["sha", "size", "_part"]).where("first < page_id").select("page_id", "sha", "first", "size").distinct()
    later = staged(later, "warc-revisits")
    n, total = known.agg(F.count("*"), F.coalesce(F.sum(F.col("size") + F.col("more")), F.lit(0))).first()
    left_out = later.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return later, HEAD_BYTES + (max(0, total - left_out) / n if n else 0)


def records(pages: DataFrame, later: DataFrame) -> DataFrame:
    """One WARC record for each page, without the blank lines at its end; ``later``: the ``revisits``."""
    rows = _payload(pages).join(later.select("page_id", "sha", "first"), ["page_id", "sha"], "left").withColumn("digest", base32(F.hex("sha")))
    # a record refers only to a smaller page_id
    revisit = F.col("first").isNotNull()
    url = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    # dates of four-digit years: ids go round after LAST seconds
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(LAST))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    refers = F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("first"))), line("X-Refers-To-Page", F.col("first").cast("string")))).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", when),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("page_id").isNull(), F.lit("")).otherwise(line("X-Page-Id", F.col("page_id").cast("string"))),
        refers,
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))).cast("string")),
    )
    return rows.select(F.concat(head, F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Archives of about ``file_bytes`` before compression; ``offset`` counts in what is inflated, as a file is one gzip member."""
    later, mean = revisits(pages, min_bytes)
    out = records(pages, later)
    out.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, int(file_bytes / mean))).text(path)


def parse(data: bytes) -> Iterator[tuple[int, dict, bytes]]:
    """(offset in the uncompressed archive, headers, block) of each record; the archive is inflated piece by piece."""
    inflate = zlib.decompressobj(47)
    buf, base, at = b"", 0, 0

    def more(want: int) -> bool:
        nonlocal buf, base, at, data, inflate
        parts, have = [buf[at:]], len(buf) - at
        base, at = base + at, 0
        while have < want and data:
            piece = inflate.decompress(data, 1 << 20)
            data = inflate.unconsumed_tail or inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(47)
            parts.append(piece)
            have += len(piece)
        buf = b"".join(parts)
        return have >= want

    while True:
        while buf[at : at + 2] == b"\r\n" or (len(buf) - at < 2 and more(2) and buf[at : at + 2] == b"\r\n"):
            at += 2
        want = 1024
        while (end := buf.find(b"\r\n\r\n", at)) < 0:
            if not more(want) and buf.find(b"\r\n\r\n", at) < 0:
                return
            want *= 2
        lines = buf[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        offset, size = base + at, int(head["Content-Length"])
        if len(buf) - end - 4 < size:
            skip = end + 4 - at
            more(skip + size)
            end = at + skip - 4
        yield offset, head, buf[end + 4 : end + 4 + size]
        at = end + 4 + size


def url_key(url: str) -> str:
    """A sortable key: host parts reversed, then path and query in lower case."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.lower().split(":")[0].removeprefix("www.").split("."))) + ")" + slash + path.lower()


CAPTURE = "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long"
FIELDS = [x.split()[0] for x in CAPTURE.split(", ")]


def _order(c: tuple) -> tuple:
    return (c[0], c[1], -1 if c[2] is None else c[2], c[7])


def runs(archives: DataFrame) -> DataFrame:
    """(run, seq, captures): the sorted captures of each archive, in rows of at most 1,024."""

    def read(batches: Iterator) -> Iterator:
        import base64
        import hashlib

        import pyarrow as pa

        for b in batches:
            for run, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                found = []
                for offset, head, block in parse(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    ids = [int(head[x]) if x in head else None for x in ("X-Page-Id", "X-Refers-To-Page")]
                    found.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], ids[0], size, digest, kind, ids[1], offset))
                found.sort(key=_order)
                for seq in range(0, len(found), 1024):
                    part = [dict(zip(FIELDS, c, strict=True)) for c in found[seq : seq + 1024]]
                    yield pa.RecordBatch.from_pylist([{"run": run, "seq": seq, "captures": part}], schema=pa.schema([("run", pa.string()), ("seq", pa.int32()), ("captures", pa.list_(CAPTURE_ARROW()))]))

    return archives.select("path", "content").mapInArrow(read, f"run string, seq int, captures array<struct<{CAPTURE.replace(' ', ': ').replace(',: ', ', ')}>>")


def CAPTURE_ARROW():  # noqa: N802
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.struct([(x.split()[0], kinds[x.split()[1]]) for x in CAPTURE.split(", ")])


def loser_tree_merge(segments: list[list[tuple]], key=_order) -> Iterator[tuple]:
    """The sorted segments as one sorted stream: each inner node keeps the loser of its match, the winner moves up."""
    k = len(segments)
    if not k:
        return
    places = [0] * k
    end = (True,)
    head = [(False, key(s[0])) if s else end for s in segments]
    tree = [-1] * k  # tree[0] is the winner

    def enter(leaf: int) -> None:
        winner, node = leaf, (leaf + k) // 2
        while node > 0:
            other = tree[node]
            if other < 0:  # first to come here waits for its match
                tree[node] = winner
                return
            if (head[other], other) < (head[winner], winner):
                tree[node], winner = winner, other
            node //= 2
        tree[0] = winner

    for leaf in range(k):
        enter(leaf)
    while head[tree[0]] != end:
        w = tree[0]
        yield segments[w][places[w]]
        places[w] += 1
        head[w] = (False, key(segments[w][places[w]])) if places[w] < len(segments[w]) else end
        winner, node = w, (w + k) // 2
        while node > 0:
            other = tree[node]
            if (head[other], other) < (head[winner], winner):
                tree[node], winner = winner, other
            node //= 2
        tree[0] = winner


def merged_index(run_rows: DataFrame) -> DataFrame:
    """All captures with their place in the global order, however the ranges were cut; one row for each range comes to the driver."""
    total = run_rows.agg(F.sum(F.size("captures"))).first()[0] or 0
    ranges = max(partitions_for(run_rows.sparkSession), -(-total // RANGE_ROWS))
    keep = min(1.0, SAMPLE * ranges / max(total, 1))
    one = F.explode("captures").alias("c")
    draw = F.pmod(F.xxhash64("c.page_id", "c.offset"), F.lit(1 << 20)) < int(keep * (1 << 20)) + 1
    sample = run_rows.select(one).where(draw).select("c.*").collect()
    keys = sorted(_order(tuple(c)) for c in sample)
    cuts = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.schema([("key_range", pa.int32()), ("run", pa.string()), ("seq", pa.int32()), ("captures", pa.list_(CAPTURE_ARROW()))])
        for b in batches:
            out = []
            for row in b.to_pylist():
                parts: dict[int, list] = {}
                for c in row["captures"]:
                    parts.setdefault(bisect_right(cuts, _order(tuple(c.values()))), []).append(c)
                out += [{"key_range": r, "run": row["run"], "seq": row["seq"], "captures": p} for r, p in parts.items()]
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    def merge(table):
        import pyarrow as pa

        by_run: dict[str, list] = {}
        for row in sorted(table.to_pylist(), key=lambda r: (r["run"], r["seq"])):
            by_run.setdefault(row["run"], []).extend(tuple(c.values()) for c in row["captures"])
        r = table.column("key_range")[0].as_py()
        out = [{"key_range": r, "_n": i} | dict(zip(FIELDS, c, strict=True)) for i, c in enumerate(loser_tree_merge(list(by_run.values())))]
        return pa.Table.from_pylist(out, pa.schema([("key_range", pa.int32()), ("_n", pa.int64()), *[(f.name, f.type) for f in CAPTURE_ARROW()]]))

    segments = run_rows.mapInArrow(cut, f"key_range int, {run_rows.schema['run'].name} string, seq int, captures {run_rows.schema['captures'].dataType.simpleString()}")
    merged = staged(segments.groupBy("key_range").applyInArrow(merge, f"key_range int, _n long, {CAPTURE}"), "warc-index")
    # places in the whole index: a range's captures follow those of all earlier ranges
    rows, before = [], 0
    for r, n in merged.groupBy("key_range").count().orderBy("key_range").collect():
        rows.append((r, before))
        before += n
    offsets = merged.sparkSession.createDataFrame(rows, "key_range int, _before long")
    return merged.join(F.broadcast(offsets), "key_range").withColumn("place", F.col("_n") + F.col("_before")).drop("_n", "_before")


def archive_and_index(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives, reads them back and returns the merged capture history."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/lumenframe/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return merged_index(staged(runs(archives), "warc-runs"))


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "place"]


def op5(pages: DataFrame) -> DataFrame:
    return archive_and_index(pages.select("page_id", "url", "html")).select(*COLUMNS)
