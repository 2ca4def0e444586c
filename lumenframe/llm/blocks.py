"""Blocks of documents, word hashes, and the exchange by which blocks learn corpus-wide facts about their own keys.

Documents are packed into blocks of bounded size, each of several compressed frames, of which a task opens one at a time. For a
corpus-wide question (how often does this key occur, which is the smallest document that holds it) every block sends its own
distinct keys to key buckets, each bucket replies to each block about the keys that others hold too, and the replies meet the
block again. A key that stands in a third of all documents costs one entry a block, so no task grows with a hot key, and
nothing is broadcast or gathered on the driver but a few sums. What is exchanged is proportional to the keys: a row holds those
of one block for one bucket, and blocks and buckets are as large as tasks of an ordinary exchange.

Word hashes are polynomials modulo 2**64 of the words' bytes, scrambled. Ordinary words do not collide; words of over a
thousand bytes can be made up that do.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FORGET, partitions_for, staged_by, tidy

#: Bytes of text in a frame, which a task opens at once; a longer document is a frame of its own.
FRAME_BYTES = 1 << 20
#: Bytes of text in a block. A block and the replies to it are one row, which both sides of the exchange with Python hold more than once.
BLOCK_BYTES = 8 << 20
#: Bytes of text behind a key bucket on average.
BUCKET_BYTES = 32 << 20
#: Bytes hashed at once; each takes 50 bytes of numbers meanwhile.
CHUNK = 1 << 18
#: Rows of documents that are made Python objects at once.
SLICE = 256
#: Odd multipliers of the polynomial hashes modulo 2**64.
BASE_BYTE, BASE_WORD, BASE_WORD_2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Stands for a null doc_id: larger than any other.
NO_ID = 2**63 - 1


def zip_bytes(data: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def unzip_bytes(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; the bytes of wide numbers are put in planes, as their high bytes are much alike."""
    head, parts = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(f"{a.dtype.str}:{len(a)}")
        parts.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes())
    line = ";".join(head).encode()
    return zip_bytes(struct.pack("<I", len(line)) + line + b"".join(parts))


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    raw = unzip_bytes(data)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + n, []
    for item in raw[4:at].decode().split(";"):
        kind, _, count = item.partition(":")
        dtype, m = np.dtype(kind), int(count)
        size = m * dtype.itemsize
        flat = np.frombuffer(raw, np.uint8, size, at)
        out.append(np.ascontiguousarray(flat.reshape(dtype.itemsize, m).T).reshape(-1).view(dtype) if dtype.itemsize > 1 else flat.view(dtype))
        at += size
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
FORGET.append(_POWERS.clear)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` and of its inverse, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(m, base, np.uint64), np.full(m, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of ``values[starts:ends]``; equal runs have equal hashes."""
    up, down = powers(base, len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The same for whole texts.
LOWER_BYTES = bytes(_LOWER.tobytes())


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of the texts, and where each text's words begin (one entry more than texts)."""
    data = b" ".join(texts) + b" "
    ends_of_texts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    buf = np.frombuffer(data, np.uint8)
    found, where, at, n = [], [], 0, len(buf)
    while at < n:
        to = min(n, at + CHUNK)
        while to < n and not _SPACE[buf[to - 1]]:  # a chunk ends after white space
            more = np.flatnonzero(_SPACE[buf[to : to + CHUNK]])
            to = to + int(more[0]) + 1 if len(more) else min(n, to + CHUNK)
        part = buf[at:to]
        space = _SPACE[part]
        starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        ends = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
        values = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
        found.append(run_hashes(values, starts, ends, BASE_BYTE) ^ (ends - starts).astype(np.uint64))
        where.append(starts + at)
        at = to
    hashes, starts = np.concatenate(found), np.concatenate(where)
    return hashes, np.concatenate(([0], np.searchsorted(starts, ends_of_texts)))


def pack(docs: DataFrame, name: str, text: str = "text", doc_id: str = "doc_id", extra: str | None = None, block_bytes: int | None = None) -> DataFrame:
    """(block, n_bytes, n_docs, frames): the documents' ids and texts in blocks, written to the shared folder.

    A block's number is that of its first row; rows are numbered one by one, so every row has a number of its own.
    ``extra``: a column of strings that is carried along with the texts. ``block_bytes``: of text, if not ``BLOCK_BYTES``.
    """

    limit = block_bytes or BLOCK_BYTES

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        ids: list[int] = []
        texts: list[bytes] = []
        extras: list[bytes] = []
        frames: list[bytes] = []
        size = total = n_docs = 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([total], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([frames], pa.list_(pa.binary()))], names=["block", "n_bytes", "n_docs", "frames"])

        for b in slices(batches):
            more = b.column("extra").cast(pa.binary()).to_pylist() if extra else [None] * len(b)
            for i, t, x in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), more, strict=True):
                t = b"" if t is None else t
                if ids and size + len(t) > FRAME_BYTES:
                    frames.append(pack_block(ids, texts, extras))
                    total, n_docs = total + size, n_docs + len(ids)
                    ids, texts, extras, size = [], [], [], 0
                    if total + len(t) > limit:
                        yield block()
                        number, frames, total, n_docs = number + n_docs, [], 0, 0
                ids.append(NO_ID if i is None else i)
                texts.append(t)
                if x is not None:
                    extras.append(x)
                size += len(t)
        if ids:
            frames.append(pack_block(ids, texts, extras))
            total, n_docs = total + size, n_docs + len(ids)
            yield block()

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *([F.col(extra).alias("extra")] if extra else []))
    return staged_by(rows.mapInArrow(tidy(run), "block long, n_bytes long, n_docs long, frames array<binary>"), name, "block")


def pack_block(ids: list[int], texts: list[bytes], extras: list[bytes] | None = None) -> bytes:
    parts = [*texts, *(extras or [])]
    head = np.array(ids, np.int64).tobytes() + np.array([len(t) for t in parts], np.int64).tobytes()
    return zip_bytes(struct.pack("<II", len(ids), len(parts)) + head + b"".join(parts), 3)


def open_parts(body: bytes) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """The ids, texts and extra strings of a block."""
    raw = unzip_bytes(body)
    n, m = struct.unpack_from("<II", raw)
    ids, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, m, 8 + 8 * n)
    ends = np.cumsum(sizes) + 8 + 8 * n + 8 * m
    parts = [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return ids, parts[:n], parts[n:]


def open_block(body: bytes) -> tuple[np.ndarray, list[bytes]]:
    return open_parts(body)[:2]


def slices(batches: Iterator) -> Iterator:
    """Arrow batches in slices of ``SLICE`` rows."""
    for b in batches:
        for at in range(0, len(b), SLICE):
            yield b.slice(at, SLICE)


def rows_of(batches: Iterator) -> Iterator[dict]:
    """The rows of Arrow batches, one at a time."""
    for b in batches:
        for i in range(len(b)):
            yield b.slice(i, 1).to_pylist()[0]


def bucket_count(blocks: DataFrame) -> int:
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(partitions_for(blocks.sparkSession), -(-total // BUCKET_BYTES))


def pack_keys(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted keys and further arrays as one compressed string; steps from key to key have fewer bytes than keys."""
    return pack_arrays(np.diff(keys, prepend=np.uint64(0)), *more)


def unpack_keys(data: bytes) -> list[np.ndarray]:
    steps, *more = unpack_arrays(data)
    return [np.cumsum(steps, dtype=np.uint64), *more]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket is a range of keys: sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def least_of(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The smallest key of each bucket."""
    wide = bucket.astype(np.uint64) << np.uint64(32)
    return (wide + np.uint64(buckets - 1)) // np.uint64(buckets) << np.uint64(32)


def spare_bits(keys: np.ndarray) -> int:
    """How many low bits the sorted distinct keys can lose and still differ."""
    if len(keys) < 2:
        return 0
    return max(0, int((keys[1:] ^ keys[:-1]).min()).bit_length() - 1)


def distinct(columns: list[np.ndarray], *how: np.ufunc) -> list[np.ndarray]:
    """The distinct values of the first column, sorted, and the others put together by ``how`` for each."""
    keys = columns[0]
    if not len(keys):
        return columns
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [keys[starts], *[f.reduceat(c[order], starts) for f, c in zip(how, columns[1:], strict=True)]]


def merged(parts: list[list[np.ndarray]], *how: np.ufunc) -> list[np.ndarray]:
    """``distinct`` over the columns of several parts."""
    return distinct([np.concatenate(c) for c in zip(*parts, strict=True)], *how)


def ask(blocks: DataFrame, fn: Callable, buckets: int) -> DataFrame:
    """``fn(row)`` gives a block's distinct sorted keys (uint64) and further arrays: a row for each bucket that it has keys of."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for row in rows_of(batches):
            keys, *more = fn(row)
            if not len(keys):
                continue
            numbers, starts = np.unique(bucket_of(keys, buckets), return_index=True)
            cuts = [*starts.tolist(), len(keys)]
            blobs = [pack_keys(keys[a:z], *[m[a:z] for m in more]) for a, z in zip(cuts, cuts[1:], strict=False)]
            del keys, more
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([row["block"]] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "block", "keys"])

    return blocks.mapInArrow(tidy(run), "bucket int, block long, keys binary")


def answer(asked: DataFrame, fn: Callable, buckets: int, sums: int = 0, short: bool = False) -> DataFrame:
    """``fn(parts)`` gets the arrays of each asking block, which it may empty, and returns those of each reply, keys first, and sums.

    Each bucket is a partition of its own. The rows with a null block carry the buckets' sums. ``short``: keys lose the low bits
    by which no two keys that the block asked for differ; it may then look up no other keys, and opens them by ``Known(.., buckets)``.
    """
    names = [f"s{i}" for i in range(sums)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary()), *[(x, pa.float64()) for x in names]])

        def reply(bucket: int, blocks: list[int], parts: list[list[np.ndarray]]):
            least = least_of(np.array([bucket]), buckets)[0]
            spares = [np.uint64(spare_bits(p[0] - least)) for p in parts] if short else []
            replies, totals = fn(parts)
            for i, spare in enumerate(spares):
                keys, *more = replies[i]
                replies[i] = [keys - least >> spare, np.array([spare]), *more] if len(keys) else [keys]
            rows = [{"block": k, "bucket": bucket, "answer": pack_keys(*p)} for k, p in zip(blocks, replies, strict=True) if len(p[0])]
            if sums:
                rows.append({"block": None, "bucket": bucket, "answer": None} | dict(zip(names, map(float, totals), strict=True)))
            return pa.RecordBatch.from_pylist([dict.fromkeys(kinds.names) | r for r in rows], kinds)

        now, blocks, parts = None, [], []
        for row in rows_of(batches):
            if row["bucket"] != now and blocks:
                yield reply(now, blocks, parts)
                blocks, parts = [], []
            now = row["bucket"]
            blocks.append(row["block"])
            parts.append(unpack_keys(row["keys"]))
        if blocks:
            yield reply(now, blocks, parts)

    schema = "block long, bucket int, answer binary" + "".join(f", {x} double" for x in names)
    return asked.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(tidy(run), schema)


def meet(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """``blocks`` with the replies to each, as ``a0``, ``a1`` ... (null where there are none)."""
    out = blocks
    for i, a in enumerate(answers):
        mine = a.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias(f"a{i}"))
        out = out.join(mine, "block", "left")
    return out


class Known:
    """The replies to a block: sorted keys and what is known of each; ``buckets``: their number, if the replies' keys are short."""

    def __init__(self, replies: list[dict] | None, buckets: int | None = None):
        self.buckets, replies = buckets, sorted(replies or [], key=lambda r: r["bucket"])
        parts = [unpack_keys(r["answer"]) for r in replies]
        if buckets:
            numbers = np.array([r["bucket"] for r in replies], np.int64)
            self.spare, self.least = np.zeros(buckets, np.uint64), least_of(np.arange(buckets), buckets)
            for i, n in enumerate(numbers.tolist()):
                keys, spare, *more = parts[i]
                self.spare[n] = spare[0]
                parts[i] = [(keys << spare[0]) + self.least[n], *more]
        self.columns = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.zeros(0, np.uint64)]

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key would stand, and whether it stands there."""
        mine = self.columns[0]
        if not len(mine):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if self.buckets:  # a short key stays in its bucket's range
            bucket = bucket_of(keys, self.buckets)
            least, spare = self.least[bucket], self.spare[bucket]
            keys = (keys - least >> spare << spare) + least
        at = np.minimum(np.searchsorted(mine, keys), len(mine) - 1)
        return at, mine[at] == keys

    def of(self, keys: np.ndarray, default: np.ndarray, column: int = 1) -> np.ndarray:
        """What is known of each key, ``default`` where nothing is."""
        at, found = self.places(keys)
        out = default.copy()
        if len(self.columns) > column:
            out[found] = self.columns[column][at[found]]
        return out
