"""op7 on long documents of one line: clean ones stay, repetitive ones go."""

import random

import pytest

pytest.importorskip("lumenframe.llm")
from lumenframe.llm import quality  # noqa: E402


def test_repeats_do_not_depend_on_length(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    weights = [1 / (i + 8) for i in range(3000)]
    clean = r.choices(vocabulary, weights, k=6000)
    passage = r.sample(vocabulary, 300)
    assert len(set(clean)) < 0.4 * len(clean)
    texts = {
        1: " ".join(clean),
        2: " ".join(clean[:300]),
        3: "buy now " * 3000,
        4: " ".join(passage * 20),
        5: " ".join(r.choices(vocabulary[:50], k=5000)),
        6: "\n".join([" ".join(clean), "buy now " * 3000]),
    }
    rows = {x.doc_id: x for x in quality.quality(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i: x.n_lines_kept for i, x in rows.items()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1}
    assert rows[1].kept and rows[1].left_share == 1.0 and rows[2].kept and not (rows[3].kept or rows[4].kept or rows[5].kept)
    assert rows[6].clean_text == texts[1]
    assert {x.doc_id for x in quality.stage(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()} >= {1, 2}
