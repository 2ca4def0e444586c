"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in built-in functions only.

A paragraph is a line, or a run of at most ``WORDS`` words of a longer line, and is known by its 64-bit digest. A sketch
adds every distinct digest to three cells, which hold a count, the XOR of digests and the XOR of check sums. Two sketches
subtract cell by cell: what both texts share cancels, and peeling (taking out cells that hold a single digest, again and
again) recovers the digests that differ. The fingerprint is a sketch of ``3 * SMALL`` cells. Where it does not peel, the pair
is sketched again, larger: digests are dealt by hash over tables of ``3 * LARGE`` cells, their number taken from the squared
counts of the small sketch (an estimate of how many digests differ) and doubled until every table peels. What is published is
the small sketch; ``near_*`` come from the sketch that peeled.

All of this is within a row. The only exchange brings each document to the next one: documents are ranged by doc_id at
estimated quantiles, and the first document of each range is sent to the range before it too, so no task orders them all.

Defined results: a null text is empty; an empty text has no paragraphs, two such are alike (1.0); repeated paragraphs count
once; rows of equal doc_id follow each other in the order of their texts' hashes, null doc_ids come last; a single document
is its own next one; extra columns are ignored by the query.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, partitions_for

WORDS, SMALL, LARGE, ROUNDS, RETRIES = 24, 4, 16, 16, 12
#: Up to WORDS words in one line, with the spaces after them.
PARAGRAPH = rf"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){{1,{WORDS}}}+"
LOW = -(2**63)


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _entry(key: Column, sign: Column, salt: Column, g: Column) -> Column:
    """A digest with its check sum and the set of its three cells, as bits."""

    def of(h: Column) -> Column:
        at = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(h, 8 * j).bitwiseAND(g.cast("long") - 1) + g * j).cast("int"))
        return F.struct(sign.alias("n"), key.alias("k"), F.shiftrightunsigned(h, 24).alias("h"), at(0).bitwiseOR(at(1)).bitwiseOR(at(2)).alias("m"))

    return let(F.xxhash64(key, salt), of)


def _add(cell: Column, entries: Column, i: Column, sign: int) -> Column:
    """``cell`` (number ``i``) plus or minus the entries that fall into it."""

    def one(acc: Column, x: Column) -> Column:
        return F.when(F.getbit(x["m"], i) == 1, F.struct((acc["n"] + x["n"] * sign).alias("n"), acc["k"].bitwiseXOR(x["k"]).alias("k"), acc["h"].bitwiseXOR(x["h"]).alias("h"))).otherwise(acc)

    return F.aggregate(entries, cell, one)


def _zero() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))


def sketch(keys: Column, salt: Column, g: Column) -> Column:
    """The cells of a set of digests."""
    entries = F.transform(keys, lambda k: _entry(k, F.lit(1), salt, g))
    return let(entries, lambda e: F.transform(F.sequence(F.lit(0), (3 * g - 1).cast("int")), lambda i: _add(_zero(), e, i, 1)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(cells: Column, salt: Column, g: Column) -> Column:
    """How many digests a difference of sketches holds, or null if it does not peel."""
    pure = lambda c: (F.abs(c["n"]) == 1) & (F.shiftrightunsigned(F.xxhash64(c["k"], salt), 24) == c["h"])

    def step(state: Column, _: Column) -> Column:
        found = F.array_distinct(F.transform(F.filter(state["cells"], pure), lambda c: _entry(c["k"], c["n"], salt, g)))
        without = lambda p: F.transform(state["cells"], lambda c, i: _add(c, p, i, -1))
        more = lambda p: F.struct(without(p).alias("cells"), (state["got"] + F.size(p)).alias("got"), (F.size(p) == 0).alias("done"))
        return F.when(state["done"], state).otherwise(let(found, more))

    start = F.struct(cells.alias("cells"), F.lit(0).alias("got"), F.lit(False).alias("done"))
    empty = lambda s: F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(empty(s), s["got"]))


def differing(a: Column, b: Column, small_a: Column, small_b: Column) -> Column:
    """How many digests differ between two sets, by their small sketches or else by larger ones."""
    small = F.lit(SMALL)

    def retry(cells: Column) -> Column:
        # the squared counts of each third of the small difference add up to about d + (gap^2 - d) / SMALL for d digests that differ
        gap = F.abs(F.size(a) - F.size(b))
        squares = F.aggregate(cells, F.lit(0), lambda acc, c: acc + c["n"] * c["n"]) / 3.0
        guess = F.least(F.greatest((squares - gap * gap / SMALL) * (SMALL / (SMALL - 1)), gap), F.size(a) + F.size(b))
        first = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(guess, F.lit(1.0)) / LARGE))).cast("int")

        def attempt(t: Column) -> Column:
            # digests are dealt in two steps, first by the high half of the table's number, so that each is looked at
            # about twice the square root of the tables' number of times
            salt, g, low = t + 1, F.lit(LARGE), F.call_function("shiftright", t, F.lit(1))
            size = lambda bits: F.call_function("shiftleft", F.lit(1), bits)
            number = lambda k: F.shiftrightunsigned(k, 33).bitwiseAND(size(t).cast("long") - 1)
            high_of = lambda k: F.call_function("shiftright", number(k), low)
            low_of = lambda k: number(k).bitwiseAND(size(low).cast("long") - 1)
            dealt = lambda keys, of, s: F.filter(keys, lambda k: of(k) == s)
            table = lambda x, s: peel(subtract(sketch(dealt(x["a"], low_of, s), salt, g), sketch(dealt(x["b"], low_of, s), salt, g)), salt, g)
            numbers = lambda bits: F.sequence(F.lit(0), size(bits) - 1)
            # null if one table does not peel; later tables are then left out
            inside = lambda x, acc: F.aggregate(numbers(low), acc, lambda acc, s: F.when(acc.isNotNull(), acc + table(x, s)))
            half = lambda s: F.struct(dealt(a, high_of, s).alias("a"), dealt(b, high_of, s).alias("b"))
            return F.aggregate(numbers(t - low), F.lit(0), lambda acc, s: F.when(acc.isNotNull(), let(half(s), lambda x: inside(x, acc))))

        tried = F.aggregate(F.sequence(first, first + RETRIES), F.lit(None).cast("int"), lambda acc, t: F.when(acc.isNotNull(), acc).otherwise(attempt(t)))
        # a table of the last attempts holds fewer than one digest on average
        return F.coalesce(tried, F.raise_error(F.lit("a difference of fingerprints does not peel")).cast("int"))

    return let(subtract(small_a, small_b), lambda cells: F.coalesce(peel(cells, F.lit(0), small), retry(cells)))


def likeness(a: Column, b: Column, small_a: Column, small_b: Column) -> Column:
    """Shared digests over all digests of two sets."""

    def share(d: Column) -> Column:
        both = F.size(a) + F.size(b)
        return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))

    return let(differing(a, b, small_a, small_b), share)


def printed(cells: Column, keys: Column) -> Column:
    """A small sketch as text."""
    one = lambda c: F.concat_ws(".", c["n"].cast("string"), F.lower(F.hex(c["k"])), F.lower(F.hex(c["h"])))
    return F.concat(F.size(keys).cast("string"), F.lit(":"), F.array_join(F.transform(cells, one), "|"))


def _range_of(limits: list[tuple[int, int]], at: Column) -> Column:
    """How many of the sorted limits are at or below ``at``, by halving."""
    if not limits:
        return F.lit(0)
    every = F.array(*[F.struct(F.lit(x).cast("long").alias("o"), F.lit(y).cast("long").alias("h")) for x, y in limits])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(limits)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.call_function("shiftright", s["lo"] + s["hi"], F.lit(1))
        below = F.get(every, mid) <= at
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(limits).bit_length())), start, halve, lambda s: s["lo"])


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc_id, ...) with ``next_<column>`` of the next document by descending doc_id; the last one's is the first.

    Ranges are cut at estimated quantiles of doc_id; an id that fills several ranges is cut by the hash of its rows as well.
    """
    n = partitions_for(docs.sparkSession)
    # an order in which larger ids come first and null ids last; the complement of a number never overflows
    rows = docs.withColumn("_o", F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)))).withColumn("_h", F.xxhash64(*columns))
    found = Counter(rows.agg(F.percentile_approx("_o", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or [])
    limits = sorted((o, LOW + j * (2**64 // m)) for o, m in found.items() for j in range(m))
    place = F.struct(F.col("_o").alias("o"), F.col("_h").alias("h"))
    rows = rows.withColumn("_range", _range_of(limits, place))
    heads = sorted(rows.groupBy("_range").agg(F.min(place)).collect())  # at most one row for each range
    if not heads:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    # the first document of a range follows the last one of the range before; the very first follows the very last
    before = [heads[-1][0]] + [r for r, _ in heads[:-1]]
    ghosts = F.create_map(*[x for (r, top), to in zip(heads, before, strict=True) for x in (F.lit(r), F.struct(F.lit(to).alias("to"), F.lit(top[0]).cast("long").alias("o"), F.lit(top[1]).cast("long").alias("h")))])
    ghost = let(F.element_at(ghosts, F.col("_range")), lambda g: F.when((F.col("_o") == g["o"]) & (F.col("_h") == g["h"]), g["to"]))
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("g"))
    places = let(ghost, lambda g: F.when(g.isNull(), F.array(own)).otherwise(F.array(own, F.struct(g.alias("r"), F.lit(1).alias("g")))))
    dealt = rows.withColumn("_p", F.explode(places)).withColumn("_r", F.col("_p.r")).withColumn("_g", F.col("_p.g")).drop("_p", "_range")
    order = Window.partitionBy("_r").orderBy("_g", "_o", "_h", *columns)
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("_g = 0").drop("_o", "_h", "_r", "_g")


def compare(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) its fingerprint, that of its edited text, and how alike they and the next one's are."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(rows, ["text"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        paragraphs(F.col("text")).alias("_a"), paragraphs(F.col("edited")).alias("_e"), paragraphs(F.col("next_text")).alias("_n"),
    )
    small = lambda c: sketch(F.col(c), F.lit(0), F.lit(SMALL))
    rows = rows.withColumn("_sa", small("_a")).withColumn("_se", small("_e")).withColumn("_sn", small("_n"))
    like = lambda x: likeness(F.col("_a"), F.col(f"_{x}"), F.col("_sa"), F.col(f"_s{x}"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        printed(F.col("_sa"), F.col("_a")).alias("fingerprint"), printed(F.col("_se"), F.col("_e")).alias("edited_fingerprint"),
        like("e").alias("near_edited"), like("n").alias("near_next"),
    )


def op1(docs: DataFrame) -> DataFrame:
    return compare(docs.select("doc_id", "text"))
