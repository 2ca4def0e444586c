"""Language-model scoring with a weighted backoff automaton of order 3.

Model, learnt from all training documents: single words with add-one smoothing over the training words and one unknown word;
pairs and triples with Dirichlet smoothing, P(w | h) = (c(h, w) + k * P(w | h')) / (c(h) + k), where h' is h without its first
word. The probabilities of each state sum to 1. As an automaton: the contexts that training texts hold are its states, those of
two words, of one word (or the start of a text) and the empty one (root). A counted continuation is an arc with its whole
probability; any other word takes the failure arc of weight k / (c(h) + k) to the state of h', down to the root, which has an
arc for every word. The state before a word is the longest suffix of the text so far that is a state, at most two words, so the
walk from left to right is taken for all places of a frame at once: each place follows failure arcs until one of its arcs fits.

Counts come through the exchange of ``blocks``: each block asks for the words, pairs and triples that it holds and gets those of
their counts over the corpus that are not plain, so the automaton that a task holds is as large as its block, never as large as
the corpus. Replies leave out what occurs once in the whole corpus (its count is 1 in a training text, else 0), and a pair or
triple with such a part is not asked for, as it occurs once too. Nothing is cut off by its count. A reply names a key by as many
bits as tell it from the others that its block asked for.

Defined results: null and empty texts are one end token; a null doc_id counts as the empty text in the fold; repeated rows
count as often as they stand; without training documents N and V are 0; extra columns are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, Known, answer, ask, bucket_count, distinct, meet, merged, mix, open_block, pack, rows_of, word_hashes
from .common import staged, tidy

#: Hashes of the end of a text and of its start.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
FOLDS, HELD_OUT = 7, 2
#: Bytes of text in a block: the replies to a block, several times its text, are one row.
BLOCK = 8 << 20


class Tokens:
    """A frame's tokens: word hashes with an end after each text, and keys of the pairs and triples that end at each place."""

    def __init__(self, body: bytes):
        self.ids, texts = open_block(body)
        hashes, first = word_hashes(texts, lower=True)
        counts = np.diff(first)
        self.first = np.concatenate(([0], np.cumsum(counts + 1)))[:-1]
        self.sizes = counts + 1
        self.word = np.full(int(self.sizes.sum()), END)
        is_word = np.ones(len(self.word), bool)
        is_word[self.first + counts] = False
        self.word[is_word] = hashes
        self.held_out = np.array([crc32(b"" if i == NO_ID else str(i).encode()) % FOLDS == HELD_OUT for i in self.ids.tolist()], bool)
        self.train = np.repeat(~self.held_out, self.sizes)
        self.begins = np.zeros(len(self.word), bool)
        self.begins[self.first] = True
        self._keys, self._facts = {1: self.word}, {}

    def key(self, order: int) -> np.ndarray:
        """The keys of the words, pairs or triples that end at each place; no triple ends at the first place of a text."""
        if order not in self._keys:
            before = self.shifted(self.key(order - 1), START if order == 2 else np.uint64(0))
            self._keys[order] = mix(before * np.uint64(0x9E3779B97F4A7C15) ^ mix(self.word))
        return self._keys[order]

    def shifted(self, values: np.ndarray, at_start) -> np.ndarray:
        """The value at the place before each, and ``at_start`` where a text begins."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.begins] = at_start
        return out

    def asked(self, order: int, known: list[Known]) -> np.ndarray:
        """Which places ask for a key of the order, given the replies to the lower ones: those whose parts occur more than once."""
        if order == 1:
            return np.ones(len(self.word), bool)
        found, _ = self.facts(order - 1, known)
        return found & self.shifted(found, order == 2)

    def facts(self, order: int, known: list[Known]) -> tuple[np.ndarray, np.ndarray]:
        """Which places have a key of the order that occurs more than once, and the training counts of all."""
        if order not in self._facts:
            places = np.flatnonzero(self.asked(order, known))
            at, hit = known[order - 1].places(self.key(order)[places])
            found, count = np.zeros(len(self.word), bool), self.train.astype(np.int64)  # what is not known of occurs here alone
            found[places] = hit
            if hit.any():
                count[places[hit]] = known[order - 1].columns[1][at[hit]]
            self._facts[order] = found, count
        return self._facts[order]


def _asks(order: int, buckets: int):
    def fn(row: dict):
        known = [Known(row[f"a{k}"], buckets) for k in range(order - 1)]
        parts = []
        for body in row["frames"]:
            t = Tokens(body)
            asked = t.asked(order, known)
            keys, train = t.key(order)[asked], t.train[asked].astype(np.int32)
            if order == 1:
                keys = np.concatenate((keys, np.full(len(t.ids), START)))
                train = np.concatenate((train, ~t.held_out)).astype(np.int32)
            parts.append(distinct([keys, train, np.ones(len(keys), np.int32)], np.add, np.add))
            if len(parts) > 1:
                parts = [merged(parts, np.add, np.add)]
        return parts[0]

    return fn


def _counts(parts: list[list[np.ndarray]]):
    """For each block the training counts of those of its keys that occur more than once; a block sends (keys, training count, count)."""
    keys = np.concatenate([p[0] for p in parts])
    every, train, total = distinct([keys, *[np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2)]], np.add, np.add)
    at = np.searchsorted(every, keys)
    often, sums = (total > 1)[at], train[at]
    ends = np.cumsum([len(p[0]) for p in parts]).tolist()
    replies = [[p[0][often[z - len(p[0]) : z]], sums[z - len(p[0]) : z][often[z - len(p[0]) : z]]] for p, z in zip(parts, ends, strict=True)]
    real = every != START
    return replies, [train[real].sum(), np.count_nonzero(train[real])]


class Automaton:
    """The part of the model that a frame can reach; ``smooth`` are the Dirichlet weights of states of one and of two words."""

    def __init__(self, n: int, v: int, smooth: tuple[float, float]):
        self.n, self.v, self.size, self.smooth = n, v, n + v + 1, smooth

    def counts(self, t: Tokens, known: list[Known]) -> tuple[list[np.ndarray], int]:
        """Training counts of the word, pair and triple that end at each place, and how many training texts there are."""
        out = [t.facts(order, known)[1] for order in (1, 2, 3)]
        out[2][t.begins] = 0
        start = known[0].of(np.array([START]), np.array([np.count_nonzero(~t.held_out)], np.int64))
        return out, int(start[0])

    def walk(self, t: Tokens, counts: list[np.ndarray], starts: int) -> np.ndarray:
        """log10 of the probability of each token: the failure arcs that its place follows, and the arc that fits."""
        one, two, three = counts
        root = (one + 1) / self.size
        contexts = [t.shifted(one, starts), t.shifted(two, 0)]  # how often the state of one and of two words was left
        arcs = [root]
        for c, context, k in zip((two, three), contexts, self.smooth, strict=True):
            # the whole probability of a counted continuation
            arcs.append((c + k * self._through(arcs, contexts)) / (context + k))
        out = np.zeros(len(root))
        waiting = np.ones(len(root), bool)
        for c, context, k, arc in zip((three, two), contexts[::-1], self.smooth[::-1], arcs[:0:-1], strict=True):
            fits = waiting & (c > 0)
            out[fits] += np.log10(arc[fits])
            waiting &= ~fits
            fails = waiting & (context > 0)
            out[fails] += np.log10(k / (context[fails] + k))
        out[waiting] += np.log10(root[waiting])
        return out

    def _through(self, arcs: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """The probability from the state below: its own smoothed value, or that of the root where it is no state."""
        if len(arcs) == 1:
            return arcs[0]
        return np.where(contexts[0] > 0, arcs[1], arcs[0])


def score(docs: DataFrame, smooth: tuple[float, float] = (50.0, 5.0), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document."""
    blocks = pack(docs, "lm-blocks", text, doc_id, block_bytes=BLOCK)
    buckets = bucket_count(blocks)
    replies = [staged(answer(ask(blocks, _asks(1, buckets), buckets), _counts, buckets, 2, short=True), "lm-words", "uncompressed")]
    n, v = replies[0].where("block is null").agg(F.coalesce(F.sum("s0"), F.lit(0.0)), F.coalesce(F.sum("s1"), F.lit(0.0))).first()
    machine = Automaton(int(n), int(v), smooth)
    for order in (2, 3):  # one plan from here: the replies' exchange to the blocks is made once and used again
        replies.append(answer(ask(meet(blocks, *replies), _asks(order, buckets), buckets), _counts, buckets, short=True))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for row in rows_of(batches):
            known = [Known(row[f"a{k}"], buckets) for k in range(3)]
            for body in row["frames"]:
                t = Tokens(body)
                counts, starts = machine.counts(t, known)
                base = np.add.reduceat(np.log10((counts[0] + 1) / machine.size), t.first)
                full = np.add.reduceat(machine.walk(t, counts, starts), t.first)
                seen = np.add.reduceat((counts[0] > 0).astype(np.int64), t.first)
                ids = [None if i == NO_ID else i for i in t.ids.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(t.held_out), pa.array(t.sizes, pa.int64()), pa.array(seen), pa.array([machine.n] * len(ids), pa.int64()), pa.array(base), pa.array(full)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return meet(blocks, *replies).mapInArrow(tidy(run), schema)


def op8(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"))
