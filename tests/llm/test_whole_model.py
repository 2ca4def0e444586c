"""op8 with its production parameters against a brute-force backoff model of all pairs and triples."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("lumenframe.llm")
from lumenframe.llm import blocks, lm  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
K2, K3 = 50.0, 5.0


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    out = [(i, " ".join(r.choices(vocabulary, weights, k=r.randrange(1, 60)))) for i in range(150)]
    out += [(200 + i, "once%d and Again once%d" % (i, i)) for i in range(14)] + [(300, None), (301, ""), (302, "new new words"), (None, "w1 w2")]
    return out + [(400 + i, "the same five words again " * 3) for i in range(90)] + [(7, out[7][1])]


class Plain:
    """The model with plain dictionaries."""

    def __init__(self, texts):
        self.one, self.two, self.three, starts = Counter(), Counter(), Counter(), 0
        for i, t in texts:
            if not held(i):
                w = tokens(t)
                self.one.update(w)
                self.two.update(zip([None, *w[:-1]], w, strict=True))
                self.three.update(zip([None, *w[:-2]], w[:-1], w[1:], strict=False))
                starts += 1
        self.starts, self.n, self.v = starts, sum(self.one.values()), len(self.one)

    def p(self, a, b, w):
        """The probability of ``w`` after ``a b``; ``b`` None: at the start, ``a`` is then ignored; ``a`` False: no word but b."""
        p = (self.one[w] + 1) / (self.n + self.v + 1)
        c = self.starts if b is None else self.one[b]
        p = (self.two[b, w] + K2 * p) / (c + K2) if c else p
        if b is None:
            return p
        c = self.two[a, b]
        return (self.three[a, b, w] + K3 * p) / (c + K3) if c else p


def tokens(t):
    return [*WORD.findall((t or "").lower()), ""]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


@pytest.mark.parametrize("frame", [4 << 20, 300])
def test_whole_model(spark, texts, frame, monkeypatch):
    monkeypatch.setattr(blocks, "FRAME_BYTES", frame)  # small frames: several of them in a block
    rows = {}
    for x in lm.op8(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect():
        assert rows.setdefault(x.doc_id, x) == x  # repeated rows have one score
    plain = Plain(texts)
    assert any(map(held, rows)) and not all(map(held, rows)) and set(rows) == {i for i, _ in texts}
    for i, t in texts:
        w = tokens(t)
        want = sum(math.log10(plain.p(a, b, x)) for a, b, x in zip([None, None, *w[:-2]], [None, *w[:-1]], w, strict=False))
        base = sum(math.log10((plain.one[x] + 1) / (plain.n + plain.v + 1)) for x in w)
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(plain.one[x] > 0 for x in w), plain.n)
        assert math.isclose(r.base_score, base, abs_tol=1e-6) and math.isclose(r.score, want, abs_tol=1e-6)
    kept = [r for r in rows.values() if r.held_out and (r.doc_id or 0) >= 400]  # texts with an order of words
    assert kept and sum(r.score for r in kept) > sum(r.base_score for r in kept)


def test_probabilities_of_each_state_sum_to_one(texts):
    plain = Plain(texts)
    every = [*plain.one, "never seen"]
    for a, b in [(None, None), (None, "w0"), ("w0", "w1"), ("the", "same"), ("never", "seen"), ("w0", "never")]:
        assert math.isclose(sum(plain.p(a, b, w) for w in every), 1)


def test_no_training_texts(spark):
    i = next(i for i in range(99) if held(i))
    (r,) = lm.op8(spark.createDataFrame([(i, "a b a")], "doc_id long, text string")).collect()
    assert (r.train_tokens, r.n_known, r.score, r.base_score) == (0, 0, 0.0, 0.0)
