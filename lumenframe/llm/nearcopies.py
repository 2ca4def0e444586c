"""MinHash near-dedup by an inverted join of signature coordinates.

1. Every document's set of shingles gets a signature of ``COORDINATES`` minima; documents with equal sets are one class.
2. A class is posted under its (coordinate, value) pairs. Two classes can only agree in ``MATCHES`` coordinates if they share
   one of their ``COORDINATES - MATCHES + 1`` globally rarest pairs, so only these are posted (prefix), and a class that shares
   fewer than ``MATCHES`` pairs with any other is skipped. Within a posting list agreements are counted against members in
   turn, and members that are already joined are skipped. A list of more than ``LIST`` members is counted against its
   smallest member, and what that leaves open is split by further pairs.
3. Classes joined so are a cluster of candidates. Links are confirmed in each cluster on the full sets of shingles, skipping
   pairs that are connected already; a cluster of more than ``CHUNK`` classes is dealt over several tasks that share pivots,
   and classes outside its largest component then meet all chunks. Pairs of a group are never written out.
4. Components are labelled by distributed star contraction.

A pair of similarity 0.8 agrees in fewer than 34 of 64 coordinates with a probability of about one in a million; more
similar pairs less often.

Defined results: null and empty texts have an empty set, are linked with nothing and kept; a null doc_id counts as larger
than any other; rows of equal doc_ids are told apart by their place, and all rows whose doc_id is the smallest of their component
are ``kept`` in the query (the pipeline's stage keeps one of them); extra columns are ignored by the query, kept by the stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, Known, answer, ask, distinct, meet, mix, open_block, open_parts, pack, pack_arrays, rows_of, run_hashes, unpack_arrays, word_hashes
from .common import other_columns, partitions_for, staged, tidy

COORDINATES, MATCHES = 64, 34
PREFIX = COORDINATES - MATCHES + 1
#: Members of a list that a task counts at once (their signatures are a megabyte), classes of a cluster compared at once, pivots, classes in a block.
LIST, CHUNK, PIVOTS, REPS = 16_384, 512, 16, 8192
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and how many each has."""
    hashes, first = word_hashes(texts, lower=True)
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc]
    length = np.minimum(counts, size)[doc]
    keys = run_hashes(hashes, start, start + length, 0xA24BAED4963EE407) if len(doc) else np.zeros(0, np.uint64)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return keys[new], np.bincount(doc[new], minlength=len(n))


def signatures(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The minima of each non-empty set: rows of COORDINATES 32-bit values."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(((keys * _SEEDS[2 * k] + _SEEDS[2 * k + 1]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _low(sigs: np.ndarray) -> np.ndarray:
    """Four bits of each value of the signatures, two values in a byte: what agrees in whole values agrees here too."""
    bits = (sigs & np.uint32(15)).astype(np.uint8)
    return np.ascontiguousarray(bits[:, ::2] | bits[:, 1::2] << np.uint8(4))


def _agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates rows of ``_low`` agree."""
    x = a ^ b
    return ((x & np.uint8(15)) == 0).sum(1) + (x < 16).sum(1)


def _signed(blocks: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for row in rows_of(batches):
            at_row = row["block"]
            for body in row["frames"]:
                ids, texts = open_block(body)
                keys, counts = shingle_sets(texts, size)
                sig = signatures(keys, counts) if len(keys) else np.zeros((0, COORDINATES), np.uint32)
                digests, sigs, at, j = [], [], 0, 0
                for n in counts.tolist():
                    digests.append(hashlib.blake2b(keys[at : at + n].tobytes(), digest_size=16).digest() if n else None)
                    sigs.append(sig[j].tobytes() if n else None)
                    at, j = at + n, j + (n > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array([row["block"]] * len(ids), pa.int64()), pa.array(np.arange(len(ids)) + at_row)], names=["id", "n_shingles", "digest", "sig", "block", "row"])
                at_row += len(ids)

    return staged(blocks.mapInArrow(tidy(run), "id long, n_shingles long, digest binary, sig binary, block long, row long"), "near-signatures")


def _rep_blocks(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        sigs: list[bytes] = []

        def block():
            body = pack_arrays(np.array(ids, np.int64), np.frombuffer(b"".join(sigs), np.uint32))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([body], pa.binary())], names=["block", "body"])

        for b in batches:
            ids += b.column("rep").to_pylist()
            sigs += b.column("sig").to_pylist()
            if len(ids) >= REPS:
                yield block()
                number, ids, sigs = number + 1, [], []
        if ids:
            yield block()

    return staged(reps.select("rep", "sig").mapInArrow(run, "block long, body binary"), "near-reps", "uncompressed")


def _open_reps(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, flat = unpack_arrays(row["body"])
    sigs = flat.reshape(-1, COORDINATES)
    keys = mix(sigs.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))
    return ids, sigs, keys


def _count(parts):
    """For each block the counts of those of its pairs that another class shares; a block sends (keys, counts)."""
    keys = np.concatenate([p[0] for p in parts])
    every, total = distinct([keys, np.concatenate([p[1] for p in parts])], np.add)
    n = total[np.searchsorted(every, keys)]
    ends = np.cumsum([len(p[0]) for p in parts]).tolist()
    return [[c[z - len(p[0]) : z][n[z - len(p[0]) : z] > 1] for c in (keys, n)] for p, z in zip(parts, ends, strict=True)], []


POSTING = "key long, n long, rep long, pos int, depth int, asking boolean, low binary, pairs binary"
FIELDS = [x.split()[0] for x in POSTING.split(", ")]


def _posting_rows(keys, n, reps, pos, depth, asking, low, pairs):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((keys, n, reps, pos, depth, asking, low, pairs), kinds, strict=True)], names=FIELDS)


def _postings(rep_blocks: DataFrame) -> DataFrame:
    """Each class under those of its globally rarest pairs that another class shares.

    ``n``: classes that hold the pair; ``low``: the signature in four bits a value; ``pairs``: for a list that may be long, all the
    class's shared pairs from the rarest on.
    """
    buckets = 4 * partitions_for(rep_blocks.sparkSession)

    def held(row: dict):
        keys, counts = np.unique(_open_reps(row)[2].ravel(), return_counts=True)
        return keys, counts.astype(np.int64)

    def run(batches: Iterator) -> Iterator:
        for row in rows_of(batches):
            ids, sigs, keys = _open_reps(row)
            n = Known(row["a0"]).of(keys.ravel(), np.ones(keys.size, np.int64)).reshape(keys.shape)
            shared = n > 1
            able = np.flatnonzero(shared.sum(1) >= MATCHES)
            order = np.lexsort((keys[able], np.where(shared[able], n[able], 2**62)), axis=1)
            low = _low(sigs)
            rows = np.repeat(able, PREFIX)
            pos = np.tile(np.arange(PREFIX, dtype=np.int32), len(able))
            at = order[:, :PREFIX].ravel()
            for a in range(0, len(rows), 20_000):
                r, c = rows[a : a + 20_000], at[a : a + 20_000]
                long = (n[r, c] > LIST).tolist()
                whole = [keys[i][order[j]][: shared[i].sum()].tobytes() if x else None for i, j, x in zip(r.tolist(), (np.arange(a, a + len(r)) // PREFIX).tolist(), long, strict=True)]
                yield _posting_rows(keys[r, c].view(np.int64), n[r, c], ids[r], pos[a : a + 20_000], [1] * len(r), [True] * len(r), [x.tobytes() for x in low[r]], whole)

    return meet(rep_blocks, answer(ask(rep_blocks, held, buckets), _count, buckets)).mapInArrow(tidy(run), POSTING)


def _spanning(members: np.ndarray, agree, asking: np.ndarray | None = None, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join members as far as ``agree(i)`` (a mask over all) joins them; joined members are skipped as far as they can be.

    ``asking``: the members whose agreements are looked at, if not all; ``joined``: a mask of those that are joined already.
    """
    n = len(members)
    label = np.arange(n)
    if joined is not None and joined.any():
        label[joined] = np.flatnonzero(joined)[0]
    edges = []
    for i in range(n) if asking is None else asking.tolist():
        if (label == label[0]).all():
            break
        hit = np.flatnonzero(agree(i) & (label != label[i]))
        for j in hit.tolist():
            if label[j] != label[i]:
                edges.append((int(members[i]), int(members[j])))
                label[label == label[j]] = label[i]
    return edges


def _edge_table(edges: list[tuple[int, int]]):
    import pyarrow as pa

    a = np.array(edges, np.int64).reshape(-1, 2)
    return pa.Table.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["u", "v"])


def _bytes_of(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _short_lists(lists: DataFrame) -> DataFrame:
    """Edges that join members of a list that agree, for lists of bounded length; one list at a time is held.

    A list's members are counted against those of them that are ``asking``.
    """

    def edges_of(keys: np.ndarray, reps: np.ndarray, asking: np.ndarray, sigs: np.ndarray):
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        group = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(keys)]))))
        to_first = np.concatenate([_agreements(sigs[a : a + 65_536], sigs[starts[group[a : a + 65_536]]]) >= MATCHES for a in range(0, len(keys), 65_536)])
        hit = to_first.copy()
        hit[starts] = False
        edges = set(zip(reps[hit].tolist(), reps[starts[group[hit]]].tolist(), strict=True))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        for g in np.flatnonzero((np.add.reduceat(to_first.astype(np.int64), starts) < sizes) & (sizes > 2)):
            own = slice(starts[g], starts[g] + sizes[g])
            # those who agree with the first are joined by it; the others are counted against all
            left = np.flatnonzero(asking[own] & ~to_first[own])
            edges.update(_spanning(reps[own], lambda i, s=sigs[own]: _agreements(s, s[i]) >= MATCHES, left, to_first[own]))
        return _edge_table(sorted(edges)).to_batches()

    def run(batches: Iterator) -> Iterator:
        kept: list[np.ndarray] = []
        for b in batches:
            if not len(b):
                continue
            now = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), _bytes_of(b.column(3), COORDINATES // 2)]
            if kept:
                now = [np.concatenate(c) for c in zip(kept, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last list may go on
            kept = [c[cut:].copy() for c in now]
            if cut:
                yield from edges_of(*[c[:cut] for c in now])
        if kept:
            yield from edges_of(*kept)

    return lists.select("key", "rep", "asking", "low").repartition("key").sortWithinPartitions("key", "rep").mapInArrow(tidy(run), "u long, v long")


def _candidates(postings: DataFrame) -> DataFrame:
    """Edges (u, v) that join classes agreeing in ``MATCHES`` coordinates.

    Lists of at most ``LIST`` members are counted as they are. Members of a longer one are counted against its smallest member;
    those that agree are joined, so they need not be counted against each other. Where at most ``LIST`` members are left, the
    list is cut into parts of that length, and those left are counted against each part. Else the list is split by its members'
    next rarer pairs: classes that agree in ``MATCHES`` coordinates and have this pair as their first in common also share a
    second one, within one place more of the prefix. Lists so made are treated alike until none is left; at a depth of
    ``MATCHES`` all members of a list agree.
    """
    found = [_short_lists(postings.where(F.col("n") <= LIST))]
    long = postings.where(F.col("n") > LIST)
    parts = F.ceil(F.col("n") / LIST).cast("int")
    every = F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
    part = F.pmod(F.xxhash64("rep"), parts).cast("int")
    while not long.isEmpty():
        # facts of a whole list go to parts of bounded length
        heads = long.groupBy("key").agg(F.max("n").alias("n"), F.count("*").alias("m"), F.bool_or("asking").alias("open"), F.min(F.struct("rep", "low")).alias("head"))
        heads = heads.where("m > 1 and open").select("key", "m", "head", every)
        dealt = staged(long.withColumn("part", part).join(heads, ["key", "part"]), "near-long-lists")
        found.append(_short_lists(dealt.where(F.col("m") <= LIST)))
        counted = staged(dealt.where(F.col("m") > LIST).mapInArrow(tidy(_against_head), f"{POSTING}, head long"), "near-long-counted")
        found.append(counted.where("not asking and rep <> head").select(F.col("rep").alias("u"), F.col("head").alias("v")))
        left = counted.groupBy("key").agg(F.max("n").alias("n"), F.count_if("asking").alias("left")).where("left > 0").select("key", "left", every)
        rest = staged(counted.drop("head").withColumn("part", part).join(left, ["key", "part"]), "near-long-left")
        few = rest.where(F.col("left") <= LIST)
        copies = few.where("asking").select("key", "rep", "asking", "low", F.col("part").alias("own"), every).where("part <> own").drop("own")
        few = few.select("key", "rep", "asking", "low", "part").unionByName(copies)
        found.append(_short_lists(few.withColumn("key", F.xxhash64("key", "part"))))
        long = staged(rest.where(F.col("left") > LIST).select(*FIELDS).mapInArrow(tidy(_deeper), POSTING), "near-long-postings")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _against_head(batches: Iterator) -> Iterator:
    """Long lists with their length as ``n``; those who do not agree with the smallest member are ``asking``."""
    import pyarrow as pa

    for b in batches:
        head = b.column("head").flatten()
        asking = _agreements(_bytes_of(b.column("low"), COORDINATES // 2), _bytes_of(head[1], COORDINATES // 2)) < MATCHES
        named = {"n": b.column("m"), "asking": pa.array(asking)}
        yield pa.RecordBatch.from_arrays([*[named.get(x, b.column(x)) for x in FIELDS], head[0]], names=[*FIELDS, "head"])


def _deeper(batches: Iterator) -> Iterator:
    """Each member of a list under the list's key and each of its own next pairs."""
    for b in batches:
        for row in b.to_pylist():
            pairs = np.frombuffer(row["pairs"], np.uint64)
            at = np.arange(row["pos"] + 1, min(PREFIX + row["depth"], len(pairs)), dtype=np.int32)
            if len(at) and row["depth"] < MATCHES:
                keys = mix(pairs[at] ^ mix(np.array([row["key"]], np.int64).view(np.uint64))).view(np.int64)
                k = len(at)
                yield _posting_rows(keys, [row["n"]] * k, [row["rep"]] * k, at, [row["depth"] + 1] * k, [row["asking"]] * k, [row["low"]] * k, [row["pairs"]] * k)


#: Rows of a small table that one task handles; tables of a few thousand edges need no hundreds of tasks.
TASK_ROWS = 20_000


#: Edges that a task puts together at once before it sends them on.
FOREST = 1 << 20


def _forest(batches: Iterator) -> Iterator:
    """Edges put together as far as a task sees them: each node with the smallest one that it can reach, if that is another."""
    import pyarrow as pa

    def reduced(parts: list[np.ndarray]):
        nodes, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            for at in (a, b, root[a], root[b]):
                np.minimum.at(new, at, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        far = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far], pa.int64()), pa.array(nodes[root[far]], pa.int64())], names=["u", "v"])

    parts, held = [], 0
    for b in batches:
        parts.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
        held += len(b)
        if held >= FOREST:
            yield reduced(parts)
            parts, held = [], 0
    if held:
        yield reduced(parts)


def components(edges: DataFrame, name: str = "near-components") -> DataFrame:
    """(id, label): the smallest id that each id of an edge can reach; large-star and small-star rounds until only stars are left.

    A hub's edges are joined with a single row; adaptive execution splits such a side.
    """
    now = staged(edges.select("u", "v").mapInArrow(tidy(_forest), "u long, v long").distinct(), name)
    while True:
        tasks = max(1, -(-2 * now.count() // TASK_ROWS))
        few = lambda df, n=tasks: df.coalesce(n)
        # done when every id either points to one id or is pointed to
        sides = now.select("u", F.lit(1).alias("out"), F.lit(0).alias("in")).union(now.select(F.col("v"), F.lit(0), F.lit(1)))
        if few(sides.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in"))).where("out > 1 or (out = 1 and in = 1)").isEmpty():
            break
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        low = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = few(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = staged(few(few(small).where("u <> v").distinct()), name)
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v")).distinct())


class Sets:
    """Sets of one group of classes, for exact comparison of one with all."""

    def __init__(self, sets: list[bytes]):
        arrays = [np.frombuffer(s, np.uint64) for s in sets]
        self.sizes = np.array([len(a) for a in arrays])
        self.starts = np.cumsum(self.sizes) - self.sizes
        _, self.ids = np.unique(np.concatenate(arrays), return_inverse=True)
        self.mark = np.zeros(self.ids.max() + 1, np.int64)

    def links(self, i: int, percent: int) -> np.ndarray:
        mine = self.ids[self.starts[i] : self.starts[i] + self.sizes[i]]
        self.mark[mine] = 1
        common = np.add.reduceat(self.mark[self.ids], self.starts)
        self.mark[mine] = 0
        return 100 * common >= percent * (self.sizes + self.sizes[i] - common)


def _groups(table, names: list[str]):
    columns = [table.column(x).to_numpy(zero_copy_only=False) for x in names]
    order = np.lexsort(columns[::-1])
    rank = np.stack([c[order] for c in columns])
    cuts = np.flatnonzero(np.concatenate(([True], (rank[:, 1:] != rank[:, :-1]).any(0), [True])))
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield table.take(order[a:b])


def _confirm(blocks: DataFrame, clusters: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (u, v) between linked classes that join each component of the links."""
    spark = blocks.sparkSession
    sizes = clusters.groupBy("label").agg(F.count("*").alias("n"))
    placed = clusters.join(sizes, "label").join(reps.select(F.col("rep").alias("id"), "block"), "id")
    chunks = F.ceil(F.col("n") / CHUNK)
    h = F.xxhash64("id", F.lit(5))
    placed = placed.withColumn("chunks", chunks.cast("int")).withColumn("chunk", F.pmod(h, chunks).cast("int"))
    placed = placed.withColumn("pivot", (F.col("chunks") > 1) & (F.pmod(F.xxhash64("id", F.lit(7)), F.col("n")) < PIVOTS))
    wanted = placed.groupBy("block").agg(F.collect_list(F.struct("id", "label", "chunks", "chunk", "pivot")).alias("wanted"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"id": pa.int64(), "label": pa.int64(), "chunks": pa.int32(), "chunk": pa.int32(), "pivot": pa.bool_()}
        for row in rows_of(batches):
            want, at = sorted(row["wanted"], key=lambda w: w["id"]), 0
            first = row["block"]
            for body in row["frames"]:
                ids, texts = open_block(body)
                mine = []
                while at < len(want) and want[at]["id"] < first + len(ids):
                    mine.append(want[at])
                    at += 1
                if mine:
                    keys, counts = shingle_sets([texts[w["id"] - first] for w in mine], size)
                    ends = np.cumsum(counts).tolist()
                    sets = [keys[e - n : e].tobytes() for e, n in zip(ends, counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*[pa.array([w[x] for w in mine], kind) for x, kind in kinds.items()], pa.array(sets, pa.binary())], names=[*kinds, "set"])
                first += len(ids)

    members = staged(blocks.join(wanted, "block").mapInArrow(tidy(run), "id long, label long, chunks int, chunk int, pivot boolean, set binary"), "near-sets")
    buckets = 8 * partitions_for(spark)
    bucket = F.pmod(F.xxhash64("label", "chunk"), F.lit(buckets)).cast("int")
    every = members.withColumn("chunk", F.explode(F.when(F.col("pivot"), F.expr("sequence(0, chunks - 1)")).otherwise(F.array("chunk"))))

    def inside(table):
        edges: list[tuple[int, int]] = []
        for g in _groups(table, ["label", "chunk"]):
            if len(g) > 1:
                s = Sets(g.column("set").to_pylist())
                edges += _spanning(g.column("id").to_numpy(), lambda i, s=s: s.links(i, percent))
        return _edge_table(edges)

    near = staged(every.select("id", "label", "chunk", "set", bucket.alias("bucket")).groupBy("bucket").applyInArrow(inside, "u long, v long"), "near-links")
    large = members.where("chunks > 1")
    if large.isEmpty():
        return near
    # classes of a large cluster outside its largest component meet all of its chunks
    part = large.select("id", "label").join(components(near, "near-parts").select("id", F.col("label").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))
    most = part.groupBy("label", "part").count().groupBy("label").agg(F.max_by("part", F.struct("count", "part")).alias("most"))
    minor = part.join(most, "label").where("part <> most").select("id", "label")
    n_minor = minor.groupBy("label").agg(F.count("*").alias("m"))
    mine = large.join(minor, ["id", "label"], "left_semi").join(n_minor, "label")
    mine = mine.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(9)), F.ceil(F.col("m") / CHUNK)).cast("int")).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    others = large.join(n_minor, "label").withColumn("slice", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / CHUNK).cast("int") - 1)))
    cross_bucket = F.pmod(F.xxhash64("label", "chunk", "slice"), F.lit(buckets)).cast("int").alias("bucket")
    pairs = mine.select("id", "label", "chunk", "slice", "set", F.lit(True).alias("minor"), cross_bucket).unionByName(others.select("id", "label", "chunk", "slice", "set", F.lit(False).alias("minor"), cross_bucket))

    def across(table):
        edges: list[tuple[int, int]] = []
        for g in _groups(table, ["label", "chunk", "slice"]):
            s, ids = Sets(g.column("set").to_pylist()), g.column("id").to_numpy()
            edges += _spanning(ids, lambda i, s=s: s.links(i, percent), np.flatnonzero(g.column("minor").to_numpy(zero_copy_only=False)))
        return _edge_table(edges)

    return near.unionByName(pairs.groupBy("bucket").applyInArrow(across, "u long, v long"))


def _judged(blocks: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(row, block, id, n_shingles, component, first): the smallest id of each row's component, and whether the row is its first one by id."""
    signed = _signed(blocks, shingle)
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min(F.struct("id", "row")).alias("x"), F.min_by(F.struct("sig", "block"), F.struct("id", "row")).alias("y"))
    reps = staged(classes.select("digest", F.col("x.row").alias("rep"), F.col("x.id").alias("id"), "y.sig", "y.block"), "near-classes")
    postings = staged(_postings(_rep_blocks(reps)), "near-postings")
    clusters = components(_candidates(postings), "near-clusters")
    labels = components(_confirm(blocks, clusters, reps, shingle, percent)).withColumnRenamed("id", "rep")
    known = reps.select("digest", "rep", "id").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    firsts = known.groupBy("label").agg(F.min(F.struct(F.col("id").alias("component"), F.col("rep").alias("first"))).alias("f"))
    labelled = known.select("digest", "label").join(firsts, "label").select("digest", "f.component", "f.first")
    out = signed.select("id", "n_shingles", "digest", "block", "row").join(labelled, "digest", "left")
    return out.select("row", "block", "id", "n_shingles", F.coalesce("component", "id").alias("component"), (F.coalesce("first", "row") == F.col("row")).alias("first"))


def near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document."""
    out = _judged(pack(docs, "near-blocks", text, doc_id), shingle, percent)
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(real("id").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("component") == F.col("id")).alias("kept"))


def op4(docs: DataFrame) -> DataFrame:
    return near_copies(docs.select("doc_id", "text"), shingle=2)


def stage(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The pipeline's stage: of each component the row with the smallest id (of equal ids the first read), as it was; five-word shingles.

    Rows are told apart by their place in the blocks, so null and repeated ids do no harm; texts are not exchanged but in blocks.
    """
    rest, back, fields = other_columns(docs)
    blocks = pack(docs.select("doc_id", "text", rest.alias("_rest")), "near-blocks", extra="_rest")
    gone = _judged(blocks, shingle, percent).where("not first").groupBy("block").agg(F.collect_list("row").alias("gone"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for row in rows_of(batches):
            first, gone = row["block"], set(row["gone"] or [])
            for body in row["frames"]:
                _, texts, others = open_parts(body)
                keep = [i for i in range(len(texts)) if first + i not in gone]
                arrays = [pa.array([x[i] for i in keep], pa.binary()).cast(pa.string()) for x in (texts, others)]
                yield pa.RecordBatch.from_arrays(arrays, names=["text", "rest"])
                first += len(texts)

    found = blocks.join(gone, "block", "left").mapInArrow(tidy(run), "text string, rest string").select("text", back("rest").alias("r"))
    return found.select(*[F.when(~F.col("r.none"), F.col("text")).alias(c) if c == "text" else F.col(f"r.{fields[c]}").alias(c) for c in docs.columns])
