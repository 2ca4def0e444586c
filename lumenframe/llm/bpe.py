"""Byte-level BPE by backtracking over longest matches.

A piece's bytes are mapped to Latin-1 characters, so that pyahocorasick's byte-blind automaton can find the longest
vocabulary entry at every position. Encoding goes left to right with the longest match; a token is accepted when the pair
with the token before it is compatible, that is, when merging the two tokens' bytes by ranks would give just these two.
Compatibility depends only on the pair and is memoised. Where no match is compatible, a shorter prefix entry is tried, and
where none is left the last token is taken back and its end is marked as dead, so that no position is tried twice: time is
linear in the piece. The result equals that of merging by ranks.

Memory on an executor is the vocabulary, the pair memo and a memo of pieces, both of a fixed size and dropped at the end of a
partition. Texts are encoded in slices of Arrow batches, and ids are turned into bytes and decimals for a slice at once;
there is no shuffle.

Defined results: null and empty texts have no tokens, and the hashes of the empty string; repeated rows are encoded alike;
extra columns are ignored by the query and kept by ``encode``, unless they have the name of its result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FORGET, tidy

#: Entries of the memos in one Python worker, and the longest piece (in characters) that is kept.
MEMO, LONGEST = 250_000, 256
#: Rows whose ids are held at once, and ids whose strings are put together at once.
SLICE, AT_ONCE = 256, 1 << 17


class Bpe:
    """Encoder and decoder for one table of ranks (bytes -> rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks, self.split = ranks, splitter(pattern)
        self.of = {i: t for t, i in ranks.items()}
        self.strings = Table(self.of)
        self.decimals = Table({i: b"%d " % i for i in self.of})
        self.trie = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.trie.add_word(t.decode("latin-1"), (i, len(t)))
        self.trie.make_automaton()
        # the next shorter entry that begins an entry, and the two parts an entry was merged from
        self.shorter: dict[int, int | None] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}  # by left << 32 | right
        self.length = {i: len(t) for t, i in ranks.items()}
        self.whole = {}
        for t, i in ranks.items():
            try:
                self.whole[t.decode()] = array("i", [i]).tobytes()
            except UnicodeDecodeError:  # part of a character, so never a piece
                pass
        self.pieces = Pieces(self)

    def forget(self) -> None:
        """Drops the memos, so that an idle worker holds the vocabulary only."""
        self.pieces, self.pairs = Pieces(self), {}

    def _prefix(self, token: int) -> int | None:
        if token not in self.shorter:
            t = self.of[token]
            self.shorter[token] = next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), None)
        return self.shorter[token]

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The last merge by which ranks make the token, or None for a single byte."""
        if token not in self.parts:
            parts = [bytes([b]) for b in self.of[token]]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.parts[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.parts[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens, merged by ranks, stay these two tokens."""
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[pair] = self._merges_to(left, right)
        return known

    def _merges_to(self, a: int, b: int) -> bool:
        # undo merges on both sides of the seam, latest first. A merge across the seam wins if it ranks before the merges
        # undone so far; at equal rank the leftmost goes first, so it also wins against one undone on the right.
        limit = 1 << 60
        while True:
            seam = self.ranks.get(self.of[a] + self.of[b])
            if seam is not None and seam < limit:
                return False
            left, right = self._parts(a), self._parts(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, n = data.decode("latin-1"), len(data)
        pairs, length = self.pairs, self.length
        # longest matches that tile the piece are its encoding if all neighbours are compatible
        tiles, last, size = [], -1, 0
        for _, (i, k) in self.trie.iter_long(text):
            if last >= 0:
                ok = pairs.get(last << 32 | i)
                if not (self.compatible(last, i) if ok is None else ok):
                    break
            tiles.append(i)
            last, size = i, size + k
        if size == n:
            return tiles
        # the longest entry that starts at each position: matches come by their end, the longest of an end first
        longest: list[int] = [0] * n
        for end, (i, k) in self.trie.iter(text):
            longest[end - k + 1] = i  # a later end at the same start is a longer entry
        dead: set[int] = set()
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        while True:
            while token is not None:
                end = at + length[token]
                if end not in dead:
                    ok = last < 0 or pairs.get(last << 32 | token)
                    if ok is None:
                        ok = self.compatible(last, token)
                    if ok:
                        break
                token = self._prefix(token)
            if token is not None:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = self._prefix(token)

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers, one after the other."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(self.of[i] for i in ids)


class Pieces(dict):
    """The packed ids of pieces met so far: all that are one token, and up to ``MEMO`` others; then it starts anew."""

    def __init__(self, coder: Bpe):
        super().__init__(coder.whole)
        self.coder, self.room = coder, len(coder.whole) + MEMO

    def __missing__(self, text: str) -> bytes:
        found = array("i", self.coder.piece(text.encode())).tobytes()
        if len(text) <= LONGEST:
            if len(self) >= self.room:
                self.clear()
                self.update(self.coder.whole)
            self[text] = found
        return found


class Table:
    """Byte strings by token id, for putting together many of them at once."""

    def __init__(self, strings: dict[int, bytes]):
        sizes = np.zeros(max(strings) + 1, np.int64)
        sizes[list(strings)] = [len(x) for x in strings.values()]
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.flat = np.frombuffer(b"".join(strings[i] for i in sorted(strings)), np.uint8)

    def join(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """The joined strings of each of consecutive groups of ``counts`` ids."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ids) else 0, np.uint8)
        for a in range(0, len(ids), AT_ONCE):
            z = min(len(ids), a + AT_ONCE)
            first = int(ends[a] - sizes[a])
            places = np.arange(first, int(ends[z - 1])) + np.repeat(self.starts[ids[a:z]] - (ends[a:z] - sizes[a:z]), sizes[a:z])
            out[first : int(ends[z - 1])] = self.flat[places]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        whole = memoryview(out)
        return [whole[a:z] for a, z in zip(bounds, bounds[1:], strict=False)]


def splitter(pattern: str):
    """``findall`` of the pattern, with its classes of letters, numbers and white space written out as ranges.

    The standard library's engine is twice as fast on ranges as one that looks every character's properties up. The ranges
    are taken from the latter, so both agree. A pattern with other properties, and a text with characters above U+FFFF, for
    which the ranges are not written out, go to the latter itself.
    """
    import regex

    slow = regex.compile(pattern).findall
    if re.search(r"\\[pP]\{(?![LN]\})|\\P|\(\?[^!:=]", pattern):
        return slow
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    spans = lambda x: [(m.group()[0], m.group()[-1]) for m in regex.finditer(x + "+", every)]
    written = {x: "".join(re.escape(a) + "-" + re.escape(z) for a, z in spans(x)) for x in (r"\p{L}", r"\p{N}", r"\s")}
    out, in_class = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.DOTALL):
        if part in written:
            part = written[part] if in_class else f"[{written[part]}]"
        elif part == r"\S" and not in_class:
            part = f"[^{written[chr(92) + 's']}]"
        elif part == r"\S":
            return slow
        in_class = part == "[" or (in_class and part != "]")
        out.append(part)
    fast, high = re.compile("".join(out)).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: fast(text) if text.isascii() or not high(text) else slow(text)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    return Bpe(load_ranks(path), pattern)


FORGET.append(bpe.cache_clear)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _coded(coder: Bpe, batches: Iterator, at: int) -> Iterator:
    """Slices of the batches, each with its texts' ids and how many each text has."""
    for whole in batches:
        for start in range(0, len(whole), SLICE):  # ids take more room than texts
            b = whole.slice(start, SLICE)
            packed = [coder.packed(x or "") for x in b.column(at).to_pylist()]
            yield b, np.frombuffer(b"".join(packed), np.int32), np.fromiter(map(len, packed), np.int64, len(packed)) // 4


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each text as an array of ints in ``out``, which replaces a column of that name."""
    path, pat = (vocabulary, pattern) if vocabulary and pattern else default_vocabulary()
    keep = [i for i, c in enumerate(docs.columns) if c != out]
    schema = T.StructType([*[docs.schema.fields[i] for i in keep], T.StructField(out, T.ArrayType(T.IntegerType()))])
    at = docs.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = bpe(path, pat)
        for b, ids, counts in _coded(coder, batches, at):
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], found], names=schema.names)
        coder.forget()

    return docs.mapInArrow(tidy(run), schema)


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): the number of tokens, the hash of the ids and the hash of the decoded bytes."""
    path, pat = (vocabulary, pattern) if vocabulary and pattern else default_vocabulary()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = bpe(path, pat)
        for b, ids, counts in _coded(coder, batches, 1):
            ids_hash = [hashlib.sha256(x[:-1]).hexdigest() for x in coder.decimals.join(ids, counts)]
            decoded_hash = [hashlib.sha256(x).hexdigest() for x in coder.strings.join(ids, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        coder.forget()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), T.StructType([docs.select("doc_id").schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))


def op2(docs: DataFrame) -> DataFrame:
    return round_trip(docs)


def stage(docs: DataFrame) -> DataFrame:
    """The pipeline's last stage: each document with its ids; ``token_ids`` and ``n_tokens`` beside the columns of documents.

    Columns of these two names in ``docs`` are replaced.
    """
    return encode(docs.drop("n_tokens")).withColumn("n_tokens", F.size("token_ids").cast("long"))
