"""What a Python worker holds at once, and after a task."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from lumenframe.llm import blocks, common, substring


def _peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.fixture
def parts():
    rng = np.random.default_rng(7)
    out = []
    for block in range(20):
        keys = np.unique(rng.integers(0, 1 << 20, 40_000, dtype=np.uint64) << np.uint64(40))
        out.append([keys, np.full(len(keys), block, np.int64), np.full(len(keys), block, np.int64)])
    return out


def _held_by_several(parts):
    counts: dict[int, int] = {}
    for p in parts:
        for k in p[0].tolist():
            counts[k] = counts.get(k, 0) + 1
    return [[k for k in p[0].tolist() if counts[k] > 1] for p in parts]


def test_replies_about_shared_keys_hold_less_than_three_times_the_bucket(parts):
    want = _held_by_several(parts)
    size = sum(c.nbytes for p in parts for c in p)
    got = []

    def run():
        copies = [[c.copy() for c in p] for p in parts]
        got.append(substring._shared(copies)[0])

    assert _peak(run) < 3 * size
    assert [r[0].tolist() for r in got[0]] == want


def test_whole_windows_with_equal_keys_and_other_bits_stay_apart():
    u, i = lambda *x: np.array(x, np.uint64), lambda *x: np.array(x, np.int64)
    more = lambda *x: np.array(x, np.uint32)
    replies = substring._smallest([[u(1, 1, 9), more(1, 2, 0), i(5, 5, 5), i(5, 5, 5)], [u(1, 7), more(2, 0), i(3, 3), i(3, 3)]])[0]
    assert [[c.tolist() for c in r] for r in replies] == [[[1], [2], [3]], [[1], [2], [3]]]


def test_words_are_hashed_with_small_tables():
    blocks._POWERS.clear()
    text = b"some words of one frame " * 43_000
    assert _peak(lambda: blocks.word_hashes([text])) < 40 * len(text)
    blocks.powers(blocks.BASE_WORD, 200_000)
    assert sum(a.nbytes for a in blocks._POWERS[blocks.BASE_WORD]) <= 2 * 8 * (1 << 18)


def test_the_last_batch_is_let_go_of_before_the_release(monkeypatch):
    import pyarrow as pa

    held = []
    monkeypatch.setattr(common, "release", lambda: held.append(pa.total_allocated_bytes()))
    before = pa.total_allocated_bytes()

    def columns(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["x"])

    rows = 0
    for batch in common.tidy(columns)(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int64()).cast(pa.float64())], names=["x"]) for n in [1 << 18]])):
        rows += len(batch)
    assert rows == 1 << 18
    assert held[0] - before < 1 << 20
