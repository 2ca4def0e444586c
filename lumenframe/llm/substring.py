"""Substring dedup by level-wise doubling over windows of words.

A window of ``size`` words (13) that also starts in a document with a smaller doc_id is removed. Windows of half the length
(7 words; two of them overlap by one word in 13) come first: a long window can only repeat if its half does. Every long
window names one of its half windows, the one with the smallest hash (leftmost on ties), so about a quarter of all half
windows has to be compared. Half windows that one document alone holds end there; the long windows that name a surviving
half are then compared themselves, by hashes of 96 bits made from 64-bit word hashes, and the smallest document of each is found. For longer windows the
doubling has more levels, until no candidates survive.

Both comparisons use the exchange of ``blocks``: a passage in a third of all documents is one entry for each block.

Defined results: null and empty texts have no words and nothing removed; texts with fewer words than a window stay whole;
rows with equal doc_ids do not remove each other's words, a null doc_id counts as larger than any other; repeated windows
inside one document stay; extra columns are ignored by the query and kept by the pipeline's stage.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BASE_WORD, BASE_WORD_2, NO_ID, Known, answer, ask, bucket_count, distinct, merged, open_parts, pack, rows_of, run_hashes, word_hashes
from .common import other_columns, staged, tidy

SIZE = 13


def levels(size: int, least: int = 6) -> list[int]:
    """Window lengths, each at most twice the one before: 13 -> [7, 13], 50 -> [7, 13, 25, 50]."""
    out = [size]
    while -(-out[0] // 2) >= least:
        out.insert(0, -(-out[0] // 2))
    return out


class Windows:
    """A frame's words and its windows."""

    def __init__(self, body: bytes, size: int):
        self.size, (self.ids, self.texts, self.extras) = size, open_parts(body)
        self.hashes, self.first = word_hashes(self.texts)
        counts = np.diff(self.first)
        starts = np.maximum(counts - size + 1, 0)
        self.doc = np.repeat(np.arange(len(counts)), starts)  # of each window
        before = np.concatenate(([0], np.cumsum(starts)))[:-1]
        self.start = np.arange(len(self.doc)) - before[self.doc] + self.first[:-1][self.doc]
        self.id = self.ids[self.doc]

    def grams(self, at: np.ndarray, length: int, base: int = BASE_WORD) -> np.ndarray:
        return run_hashes(self.hashes, at, at + length, base)

    def anchors(self, half: int) -> np.ndarray:
        """For each window the place of its half window with the smallest hash."""
        if not len(self.start):
            return self.start
        last = len(self.hashes) - half
        all_grams = self.grams(np.arange(last + 1), half) & ~np.uint64(63)
        best = np.full(len(self.start), np.uint64(2**64 - 1))
        for s in range(self.size - half + 1):
            np.minimum(best, all_grams[self.start + s] | np.uint64(s), out=best)
        return self.start + (best & np.uint64(63)).astype(np.int64)

    def candidates(self, steps: list[int], known: list[Known]) -> tuple[np.ndarray, np.ndarray]:
        """The windows that survive the levels of ``known``, and where the run starts that the next level compares for each."""
        alive = np.arange(len(self.start))
        anchors = self.anchors(steps[0]) if len(steps) > 1 else self.start
        for k, length in enumerate(steps):
            at = anchors[alive]
            if length == self.size:
                at = self.start[alive]
            elif k:  # the run of this length around the anchor that lies in the window
                at = np.clip(at - (length - steps[0]) // 2, self.start[alive], self.start[alive] + self.size - length)
            if k == len(known):
                return alive, at
            # neighbours often share a run: each is looked up once
            new = np.concatenate(([True], at[1:] != at[:-1])) if len(at) else np.zeros(0, bool)
            _, found = known[k].places(self.grams(at[new], length))
            alive = alive[found[np.cumsum(new) - 1]]
        raise ValueError("more replies than levels")

    def full(self, at: np.ndarray) -> np.ndarray:
        """Whole windows as 96 bits: 64 by which they are dealt, and 32 more."""
        out = np.empty(len(at), WHOLE)
        out["key"] = self.grams(at, self.size)
        out["more"] = self.grams(at, self.size, BASE_WORD_2) >> np.uint64(32)
        return out


WHOLE = np.dtype([("key", np.uint64), ("more", np.uint32)])


def _runs(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of 96-bit hashes, and where in it each distinct one starts."""
    order = np.lexsort((whole["more"], whole["key"]))
    w = whole[order]
    new = np.ones(len(w), bool)
    new[1:] = (w["key"][1:] != w["key"][:-1]) | (w["more"][1:] != w["more"][:-1])
    return order, np.flatnonzero(new)


def _least(whole: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 96-bit hashes with the smallest and largest id of each."""
    if not len(whole):
        return whole, low, high
    order, starts = _runs(whole)
    return whole[order[starts]], np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)


def _columns(parts: list[list[np.ndarray]]) -> tuple[list[int], list[np.ndarray]]:
    """How many entries each part has, and the parts' columns put together; ``parts`` are emptied meanwhile, as a bucket's are large."""
    sizes, columns = [len(p[0]) for p in parts], []
    for i in range(len(parts[0])):
        columns.append(np.concatenate([p[i] for p in parts]))
        for p in parts:
            p[i] = None
    parts.clear()
    return sizes, columns


def _split(sizes: list[int], columns: list[np.ndarray], keep: np.ndarray) -> list[list[np.ndarray]]:
    """For each part, of so many entries, those that are kept."""
    ends = np.cumsum(sizes)
    return [[c[z - n : z][keep[z - n : z]] for c in columns] for n, z in zip(sizes, ends.tolist(), strict=True)]


def _shared(parts: list[list[np.ndarray]]):
    """For each block those of its keys that several ids hold; a block sends (keys, smallest id, largest id)."""
    sizes, (keys, low, high) = _columns(parts)
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    ours = keys[order]
    new[1:] = ours[1:] != ours[:-1]
    del ours
    starts = np.flatnonzero(new)
    several = np.minimum.reduceat(low[order], starts) != np.maximum.reduceat(high[order], starts)
    del low, high
    keep = np.empty(len(keys), bool)
    keep[order] = np.repeat(several, np.diff(starts, append=len(keys)))
    return _split(sizes, [keys], keep), []


def _smallest(parts: list[list[np.ndarray]]):
    """For each block the smallest id of those of its windows that several ids hold; a block sends (keys, 32 more bits, smallest id, largest id)."""
    lengths, (keys, more, low, high) = _columns(parts)
    whole = np.empty(len(keys), WHOLE)
    whole["key"], whole["more"] = keys, more
    del keys, more
    order, starts = _runs(whole)
    sizes = np.diff(starts, append=len(whole))
    least, most = np.empty(len(whole), np.int64), np.empty(len(whole), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], starts), sizes)
    most[order] = np.repeat(np.maximum.reduceat(high[order], starts), sizes)
    return _split(lengths, [whole["key"], whole["more"], least], least != most), []


def repeated(blocks: DataFrame, buckets: int, size: int = SIZE) -> tuple[DataFrame, callable]:
    """Blocks with the replies to them, and ``find(row)``: each frame's (Windows, which windows start in a smaller document too)."""
    steps = levels(size)
    last = len(steps) - 1

    def asks(n: int):
        def part(body: bytes, known: list[Known]) -> list[np.ndarray]:  # a frame's words and windows are gone before the next is opened
            w = Windows(body, size)
            alive, at = w.candidates(steps, known)
            ids = w.id[alive]
            if n == last:
                return _least(w.full(at), ids, ids)
            new = np.concatenate(([True], (at[1:] != at[:-1]) | (ids[1:] != ids[:-1]))) if len(at) else np.zeros(0, bool)
            return distinct([w.grams(at[new], steps[n]), ids[new], ids[new]], np.minimum, np.maximum)

        def fn(row: dict):
            known = [Known(row[f"a{k}"]) for k in range(n)]
            parts = [part(body, known) for body in row["frames"]]
            if n < last:
                return merged(parts, np.minimum, np.maximum)
            whole, low, high = _least(*[np.concatenate(c) for c in zip(*parts, strict=True)])
            return whole["key"], whole["more"], low, high

        return fn

    met = facts = blocks
    for n in range(len(steps)):
        replies = answer(ask(met, asks(n), buckets), _smallest if n == last else _shared, buckets).where("block is not null")
        mine = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias(f"a{n}"))
        # earlier replies are kept beside the blocks, so that each level is asked once
        facts = mine if n == 0 else facts.join(mine, "block", "left")
        if n < last:
            facts = staged(facts, f"substring-level-{steps[n]}", "uncompressed")
        met = blocks.join(facts, "block", "left")

    def find(row: dict):
        known = [Known(row[f"a{k}"]) for k in range(last)]
        whole = Known(row[f"a{last}"])
        mine, least = np.zeros(len(whole.columns[0]), WHOLE), None
        mine["key"] = whole.columns[0]
        if len(mine):
            mine["more"], least = whole.columns[1], whole.columns[2]
        for body in row["frames"]:
            w = Windows(body, size)
            alive, at = w.candidates(steps, known)
            hit = np.zeros(len(w.start), bool)
            if len(at) and len(mine):
                ours = w.full(at)
                # equal keys with other bits stand side by side
                place = np.searchsorted(mine["key"], ours["key"])
                last_place = np.searchsorted(mine["key"], ours["key"], side="right")
                while (place < last_place).any():
                    p = np.minimum(place, len(mine) - 1)
                    hit[alive] |= (place < last_place) & (mine["more"][p] == ours["more"]) & (least[p] < w.id[alive])
                    place = place + 1
            yield w, hit

    return met, find


def removed_words(w: Windows, hit: np.ndarray) -> np.ndarray:
    """Which words of the block lie in a removed window."""
    edge = np.zeros(len(w.hashes) + 1, np.int32)
    at = w.start[hit]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + w.size, -1)
    return np.cumsum(edge[:-1]) > 0


_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def cut_words(text: bytes, gone: list[bool]) -> bytes:
    """The text without the words that are gone, each with the white space after it; all else stays as it was."""
    lead = text[: len(text) - len(text.lstrip())]
    return lead + b"".join([m.group() for m, g in zip(_WORD.finditer(text), gone, strict=True) if not g])


def dedup(docs: DataFrame, size: int = SIZE, text: str = "text", doc_id: str = "doc_id", extra: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each document; with ``extra`` that column and ``cut_text``, the text without the removed words, in place of the hash."""
    blocks = pack(docs, "substring-blocks", text, doc_id, extra=extra)
    met, find = repeated(blocks, bucket_count(blocks), size)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for row in rows_of(batches):
            for w, hit in find(row):
                gone = removed_words(w, hit)
                ids, n, lost, sha, cut = [], [], [], [], []
                first = w.first.tolist()
                for d, t in enumerate(w.texts):
                    out = gone[first[d] : first[d + 1]]
                    k = int(np.count_nonzero(out))
                    ids.append(None if w.ids[d] == NO_ID else int(w.ids[d]))
                    n.append(first[d + 1] - first[d])
                    lost.append(k)
                    if extra:
                        cut.append(cut_words(t, out.tolist()) if k else t)
                        continue
                    words = t.split()
                    if k:
                        words = [x for x, g in zip(words, out.tolist(), strict=True) if not g]
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                arrays = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(lost, pa.int64())]
                if extra:
                    arrays = [*arrays, pa.array(w.extras, pa.binary()).cast(pa.string()), pa.array(cut, pa.binary()).cast(pa.string())]
                else:
                    arrays.append(pa.array(sha, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "n_words", "n_removed", *([extra, "cut_text"] if extra else ["kept_sha256"])]
    return met.mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long" + (f", {extra} string, cut_text string" if extra else ", kept_sha256 string"))


def stage(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: every document, without the words that repeat a passage of a document with a smaller id.

    Texts are carried once, in the blocks; the other columns go beside them. ``n_chars``, if there is one, follows the text.
    """
    rest, back, fields = other_columns(docs)
    found = dedup(docs.select("doc_id", "text", rest.alias("_rest")), extra="_rest").select("n_removed", "cut_text", back("_rest").alias("r"))
    new = {"text": F.when(~F.col("r.none"), F.col("cut_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("cut_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"r.{fields['n_chars']}"))
    return found.select(*[new[c].alias(c) if c in new else F.col(f"r.{fields[c]}").alias(c) for c in docs.columns])


def op3(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text"))
