"""What a task holds at once is bounded: sizes of blocks and frames, and results across blocks."""

import numpy as np
import pytest

from lumenframe.llm import blocks, substring

PASSAGE = " ".join(f"passage{k}" for k in range(20))


@pytest.fixture(scope="module")
def long_texts(spark):
    """20 texts of half a megabyte in one partition; the first and the last share a passage."""
    rng = np.random.default_rng(7)
    texts = [" ".join(map(str, rng.integers(10**8, 10**9, 50_000).tolist())) for _ in range(20)]
    texts[0] += " " + PASSAGE
    texts[19] += " " + PASSAGE
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def test_windows_over_blocks_of_bounded_size(long_texts, monkeypatch):
    seen = []
    monkeypatch.setattr(substring, "pack", lambda *a, **k: seen.append(blocks.pack(*a, **k)) or seen[-1])
    removed = {r.doc_id: r.n_removed for r in substring.op3(long_texts).select("doc_id", "n_removed").collect()}
    assert removed == {i: 20 * (i == 19) for i in range(20)}
    rows = seen[0].collect()
    assert len(rows) > 1 and max(r.n_bytes for r in rows) <= 8 << 20
    assert max(sum(map(len, blocks.open_block(f)[1])) for r in rows for f in r.frames) <= 1 << 20


def test_short_keys_of_replies_are_exact(spark):
    """Each block finds those of its keys that another holds too, and no others, by replies of fewer bytes."""
    rng = np.random.default_rng(3)
    rows = [np.unique(np.concatenate((rng.integers(0, 2**64, 5000, np.uint64), np.arange(9, dtype=np.uint64) + np.uint64(k % 2)))) for k in range(3)]
    rows[1] = np.unique(np.concatenate((rows[1], rows[0][::2])))
    asked = spark.createDataFrame([(k,) for k in range(3)], "block long")
    both = lambda parts: ([[p[0][np.isin(p[0], np.concatenate([q[0] for q in parts if q is not p]))]] for p in parts], [])
    size = {}
    for short in (False, True):
        replies = blocks.meet(asked, blocks.answer(blocks.ask(asked, lambda r: [rows[r["block"]]], 5), both, 5, short=short)).collect()
        size[short] = sum(len(a.answer) for r in replies for a in r.a0)
        for r in replies:
            mine = rows[r.block]
            _, found = blocks.Known([a.asDict() for a in r.a0], 5 if short else None).places(mine)
            assert (found == np.isin(mine, np.concatenate([x for k, x in enumerate(rows) if k != r.block]))).all()
    assert size[True] < 0.75 * size[False]


def test_workers_keep_no_tables_between_tasks(spark):
    from pyspark.sql import functions as F

    from lumenframe.llm import bpe, common

    def kept(batches):
        import pyarrow as pa

        for b in batches:
            blocks.powers(blocks.BASE_WORD, len(b))
            bpe.bpe(*vocabulary)
            yield pa.RecordBatch.from_pylist([{"n": 0}])
        common.release()
        yield pa.RecordBatch.from_pylist([{"n": len(blocks._POWERS) + bpe.bpe.cache_info().currsize}])

    vocabulary = bpe.default_vocabulary()
    assert spark.range(1).mapInArrow(kept, "n long").agg(F.sum("n")).first()[0] == 0
