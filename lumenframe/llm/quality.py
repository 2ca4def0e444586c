"""Line-first quality rules, in built-in functions only.

Every line is judged by itself: punctuation (shares of symbols, shouted marks), navigation (separator bars, menus, lists of
links), boilerplate phrases (by how many words there are to each) and repeated words (by stretches and windows, as the share of different words falls with length in any
prose). Lines that fail are taken out, and a document that loses too much of its text,
or that fails the base rules, is rejected; the others go on without the lines that failed. All work is per row: one scan, no shuffle, so neither a hot source nor a group
of copies matters.

Defined results: a null or empty text has no words, counts of 0, ``base_failed`` true (fewer than ``min_words`` words)
and ``kept`` false; repeated rows and ties are judged alike; extra columns are left alone; very long texts cost
n log n in their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACES, let, words

#: Characters counted as symbols, and the boilerplate phrases (lower case).
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript",
    "lorem ipsum", "click here to", "sign up for our newsletter", "skip to content", "share on facebook",
)
#: A phrase fails a line of at most so many words for each time it stands there.
BOILERPLATE_WORDS = 40
WINDOW = 8
#: Longest stretch of words over which the share of different words is taken.
STRETCH = 200


def _repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """Words inside ``window``-word windows that the same text holds twice or more."""

    def covered(hashes: Column) -> Column:
        # (hash, position) sorted: equal windows are neighbours
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def positions(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
            hit = F.filter(F.sequence(F.lit(0), last), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.sort_array(F.transform(hit, lambda i: F.get(s, i)["p"]))

        def length(p: Column) -> Column:
            # each start covers as far as the next start, the last one a whole window
            return F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))),
                F.lit(0).cast("long"), lambda a, x: a + x,
            )

        repeated = let(let(pairs, positions), length)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(repeated)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    # a text whose words are all different has no equal windows
    none = (F.size(ws) < window + 1) | (F.size(F.array_distinct(ws)) == F.size(ws))
    return F.when(none, F.lit(0).cast("long")).otherwise(let(windows(ws), covered))


def _stretch_words(ws: Column, longest: int = STRETCH) -> Column:
    """Different words of each of the equal stretches that cover a text, added up."""

    def added(length: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ws), length)
        return F.aggregate(F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(ws, i, length)))), F.lit(0), lambda a, x: a + x)

    return let(F.ceil(F.size(ws) / F.ceil(F.size(ws) / longest)).cast("int"), added)


def _count(text: Column, what: str) -> Column:
    """How often a string stands in a text, without overlaps; byte lengths make it cheap."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(what), F.lit("")))) / len(what.encode())


def _symbols(text: Column) -> Column:
    """How many symbols a text holds: its bytes less those that are left without them."""
    return (F.octet_length(text) - F.octet_length(F.translate(text, SYMBOLS, ""))).cast("long")


def line_fails(line: Column, symbols: Column, text: Column, max_symbols: float = 0.1, max_bars: float = 0.2, max_shouts: float = 0.3, max_repeat: float = 0.6, max_links: float = 0.5) -> Column:
    """Whether one line fails a rule. The limits are shares: of characters (symbols), of words (bars, shouted marks, links, words used before).

    ``symbols``: how many the whole ``text`` holds; a text without any needs no count by line, and a text without a phrase or a
    link no search by line.
    """
    n = _count(line, " ") + 1
    phrases = F.array(*[F.lit(p) for p in BOILERPLATE])
    low = lambda x: F.exists(phrases, lambda p: F.contains(x, p))
    # a phrase must make up a good part of the line, however long it is
    much = lambda x: F.aggregate(phrases, F.lit(0.0), lambda a, p: a + F.when(F.contains(x, p), BOILERPLATE_WORDS * (F.octet_length(x) - F.octet_length(F.replace(x, p, F.lit("")))) / F.octet_length(p)).otherwise(0.0)) >= n
    marked = (_symbols(line) > max_symbols * F.length(line)) | ((_count(line, "|") >= 2) & (_count(line, "|") > max_bars * n))
    links = _count(line, "http://") + _count(line, "https://") + _count(line, "www.")
    # menus: several separators between short entries
    menu = _count(line, " > ") + _count(line, " » ") + _count(line, " · ") + _count(line, " • ")
    limit = lambda ws: (1 - max_repeat) * F.size(ws)
    # the stretches say it of a line of any length, the windows of passages that come back after more than a stretch
    again = lambda ws: (_stretch_words(ws) < limit(ws)) | (_repeat_words(ws) > max_repeat * F.size(ws))
    repeats = lambda ws: F.when(F.size(F.array_distinct(ws)) < limit(ws), again(ws)).otherwise(F.lit(False))
    return (
        ((symbols > 0) & marked)
        | (F.contains(line, F.lit("!!")) & (n >= 3) & (_count(line, "!!") > max_shouts * n))
        | (text["links"] & (links >= 2) & (links >= max_links * n))
        | (text["menus"] & (menu >= 3) & (menu > max_bars * n))
        | (text["phrases"] & let(F.lower(line), low) & let(F.lower(line), much))
        | ((n >= 10) & let(F.split(line, " "), repeats))
    )


def text_marks(text: Column) -> Column:
    """What a whole text holds of that by which lines are judged."""
    any_of = lambda x, items: F.exists(F.array(*[F.lit(p) for p in items]), lambda p: F.contains(x, p))
    return F.struct(any_of(text, ("http", "www.")).alias("links"), any_of(text, (" > ", " » ", " · ", " • ")).alias("menus"), let(F.lower(text), lambda x: any_of(x, BOILERPLATE)).alias("phrases"))


def quality(docs: DataFrame, min_words: int = 20, max_repeat_pct: int = 30, min_left: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``clean_text`` (the lines that passed), ``base_failed`` and ``kept``."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_body", body).withColumn("_ws", words(F.col("_body"))).withColumn("_lines", F.split("_body", "\n"))
    has_word = lambda x: F.btrim(x, F.lit(SPACES)) != ""
    out = (
        out.withColumn("n_words", F.size("_ws").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_ws", "")).cast("long"))
        .withColumn("n_symbols", _symbols(F.col("_body")))
        .withColumn("n_dup_lines", let(F.filter("_lines", has_word), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
        .withColumn("n_repeat_words", _repeat_words(F.col("_ws")))
    )
    # bound once: a column that only a lambda names may be inlined and computed again for every line
    out = out.withColumn("_good", let(F.struct(_symbols(F.col("_body")).alias("n"), text_marks(F.col("_body")).alias("m")), lambda s: F.filter("_lines", lambda x: ~line_fails(x, s["n"], s["m"]))))
    out = out.withColumn("clean_text", F.when(F.size("_good") == F.size("_lines"), F.col("_body")).otherwise(F.array_join("_good", "\n")))
    left = F.length(F.translate(F.col("clean_text"), SPACES, ""))
    return (
        out.withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_lines_kept", F.size("_good").cast("long"))
        .withColumn("left_share", F.when(F.col("word_chars") == 0, F.lit(0.0)).when(F.size("_good") == F.size("_lines"), F.lit(1.0)).otherwise(left / F.col("word_chars")))
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("left_share") >= min_left))
        .drop("_body", "_ws", "_lines", "_good")
    )


#: What the query returns.
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op7(docs: DataFrame) -> DataFrame:
    return quality(docs.select("doc_id", "text")).select(*COLUMNS)


def stage(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """The pipeline's stage: documents that pass, without the lines that failed; ``n_chars``, if there is one, follows the text.

    The filter stands on a generated column: one on ``kept`` would be pushed down and its expressions copied.
    """
    judged = quality(docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")), min_words=min_words, text="_text")
    passed = judged.select(F.explode_outer(F.when(F.col("kept"), F.array(F.struct("_row", "clean_text", (F.col("n_lines_kept") < F.col("n_lines")).alias("cut"))))).alias("r")).where("r is not null")
    new = {"text": F.col("r.clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("r.cut"), F.length("r.clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("r._row.n_chars"))
    return passed.select(*[new[c].alias(c) if c in new else F.col(f"r._row.`{c}`").alias(c) for c in docs.columns])
