"""License scans: an exact set-similarity join of license templates with text blocks, in built-in functions only.

The templates are a fixed, bounded list of notices and whole license texts. A block is a run of ``BLOCK`` words, or of one and a half
times the template's words if that is more, and may start at any word. A template is found where a block holds at least
``ceil(threshold * size)`` of the template's distinct tokens. Tokens are ordered by their frequency over all documents, rarest first,
on both sides: templates as lists, texts as the ranks of their words (words of no template have none and can match nothing). A block
that reaches the threshold must hold one of the template's first ``size - need + 1`` tokens (prefix filter), so only blocks around such
words are looked at, and of these only those that start at a token of the template, as the largest share is reached there. The text must
have tokens enough (length filter), and behind the rarest token in common enough tokens must be left in the template and in the block
(positional filter). What passes is verified on the full sets, so no block is lost and none is wrongly found.

The template side is at most ``len(TEMPLATES)`` rows and is written into the plan; the documents are never shuffled. Only
token counts (at most one row for each template token and task) are exchanged.

Defined results: null and empty texts have no words, no places and an empty label list; repeated rows are scanned alike;
extra columns are left alone.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

#: Fixed value: what parts words, after A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices and texts of well-known public licenses, in lower case words, with the method's labels.
TEMPLATES = (
    ("mit-permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "released under the mit license"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0"),
    ("apache-2.0-header", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3.0-notice", "this work is licensed under the gnu general public license version 3"),
    ("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0-notice", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0-notice", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0-notice", "licensed under cc by nc 4 0"),
    ("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc-permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("warranty-disclaimer", "the software is provided as is without warranty of any kind express or implied"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
    ("apache-2.0-header-text", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
)


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def _literal(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


def token_order(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> dict[str, int]:
    """The rank of each template token by the number of documents that hold it, over all documents; rarest first, ties by the token.

    The result has one entry for each distinct template token, however many documents there are.
    """
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    held = docs.select(F.explode(F.array_intersect(_literal(vocabulary), license_words(F.col(text)))).alias("w"))
    counts = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


#: Least words in a block.
BLOCK = 64


def block_words(text: str, least: int = BLOCK) -> int:
    """How many words a template's blocks have."""
    return max(least, -(-3 * len(text.split()) // 2))


def needed(text: str, threshold: float) -> int:
    """How many of its distinct tokens a template's block must hold."""
    return ceil(threshold * len(set(text.split())) - 1e-9)


def _templates(rank: dict[str, int], threshold: float, templates, least: int) -> Column:
    """The templates as a constant: name, the ranks of their tokens rarest first, the prefix, how many tokens are needed, words in a block."""
    rows = []
    for name, text in templates:
        tokens = sorted(rank[w] for w in set(text.split()))
        need = needed(text, threshold)
        rows.append(F.struct(F.lit(name).alias("name"), _literal(tokens).alias("tokens"), _literal(tokens[: len(tokens) - need + 1]).alias("prefix"), F.lit(need).alias("need"), F.lit(block_words(text, least)).alias("words")))
    return F.array(*rows)


def _best(ranks: Column, t: Column) -> Column:
    """The largest share of template ``t`` that any block of the text holds, or null below the threshold; ``ranks`` of its words, from 0."""

    def share(block: Column) -> Column:
        rarest = F.array_min(F.array_intersect(t["prefix"], block))
        size = F.size(t["tokens"])
        left = F.least(size - F.array_position(t["tokens"], rarest), F.size(block) - F.array_position(block, rarest)) + 1
        return F.when(left >= t["need"], let(F.size(F.array_intersect(t["tokens"], block)), lambda n: F.when(n >= t["need"], n / size.cast("double"))))

    def around(hits: Column) -> Column:
        near = lambda i: F.array_contains(t["tokens"], F.get(ranks, i)) & F.exists(hits, lambda p: (p >= i) & (p < i + t["words"]))
        starts = F.filter(F.sequence(F.lit(0), F.size(ranks) - 1), near)
        return F.array_max(F.transform(starts, lambda i: let(F.array_sort(F.array_distinct(F.filter(F.slice(ranks, i + 1, t["words"]), lambda r: r.isNotNull()))), share)))

    hits = F.filter(F.sequence(F.lit(0), F.size(ranks) - 1), lambda i: F.array_contains(t["prefix"], F.get(ranks, i)))
    return let(hits, around)


def scan(docs: DataFrame, threshold: float = 0.9, least_words: int = BLOCK, templates=TEMPLATES, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and ``score``.

    ``score`` is 1 where a base phrase stands, else the largest share of a found template.
    """
    rank = token_order(docs, templates, text)
    vocabulary = sorted(rank, key=rank.get)
    out = docs.withColumn("_ws", license_words(F.col(text)))
    ws = F.col("_ws")
    phrases = F.array(*[F.struct(_literal(p.split()).alias("words"), F.lit(label).alias("label")) for p, label in PHRASES])

    def places(p: Column) -> Column:
        n = F.size(p["words"])
        return F.filter(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.slice(ws, i + 1, n) == p["words"])

    whole = F.filter(phrases, lambda p: (F.size(ws) >= F.size(p["words"])) & F.forall(p["words"], lambda w: F.array_contains(ws, w)))
    found = F.filter(F.transform(whole, lambda p: F.struct(p["label"].alias("label"), places(p).alias("at"))), lambda x: F.size(x["at"]) > 0)
    # length and prefix filters on the whole text, then the blocks
    first = sorted({r for _, x in templates for r in sorted(rank[w] for w in set(x.split()))[: len(set(x.split())) - needed(x, threshold) + 1]})
    ranked = F.transform(ws, lambda w: F.when(w.isin(vocabulary), F.array_position(_literal(vocabulary), w).cast("int") - 1))
    every = _templates(rank, threshold, templates, least_words)
    able = lambda has: F.filter(every, lambda t: F.arrays_overlap(has, t["prefix"]) & (F.size(F.array_intersect(t["tokens"], has)) >= t["need"]))
    found_in = lambda ranks: let(F.array_distinct(F.filter(ranks, lambda r: r.isNotNull())), lambda has: F.filter(F.transform(able(has), lambda t: F.struct(t["name"].alias("name"), _best(ranks, t).alias("share"))), lambda x: x["share"].isNotNull()))
    rare = [vocabulary[r] for r in first]
    hits = F.when(F.exists(ws, lambda w: w.isin(rare)), let(ranked, found_in)).otherwise(F.array().cast("array<struct<name:string,share:double>>"))
    out = out.withColumn("_found", found).withColumn("_hits", hits)
    at = F.flatten(F.col("_found.at"))
    return (
        out.withColumn("n_words", F.size("_ws").cast("long"))
        .withColumn("n_base", F.size(at).cast("long"))
        .withColumn("first_word", F.array_min(at).cast("long"))
        .withColumn("last_word", F.array_max(at).cast("long"))
        .withColumn("base_labels", F.array_join(F.array_sort(F.array_distinct(F.col("_found.label"))), ","))
        .withColumn("labels", F.array_join(F.array_sort(F.array_distinct(F.concat(F.col("_found.label"), F.col("_hits.name")))), ","))
        .withColumn("score", F.when(F.size("_found") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("_hits.share")), F.lit(0.0))))
        .drop("_ws", "_found", "_hits")
    )


COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def op10(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select(*COLUMNS)
