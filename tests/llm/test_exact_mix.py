"""op9's schedule against the true weights: one hot and many tiny sources."""

from collections import Counter

import pytest

pytest.importorskip("lumenframe.llm")
from lumenframe.llm import mixing  # noqa: E402


def test_true_weights_with_one_hot_and_many_tiny_sources(spark):
    rows = [(i, "hot", "x" * 99) for i in range(4000)] + [(10000 + i, f"tiny{i:02}", "y" * 4) for i in range(50)] + [(20000, None, None)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_bytes=100).collect()
    size = Counter()
    for _, s, t in rows:
        size[s] += len(t or "") + 1
    total = sum(b**0.7 for b in size.values())
    weight = {s: b**0.7 / total for s, b in size.items()}
    assert all(abs(r.target_weight - weight[r.source]) < 1e-12 for r in out) and {r.doc_id for r in out} == {i for i, _, _ in rows}
    slots = max(r.slot for r in out) + 1
    used = {}
    for s, t in {(r.source, r.slot) for r in out}:
        used.setdefault(s, []).append(t)
    for s, places in used.items():
        places.sort()
        for i, t in enumerate(places):
            assert abs(i - weight[s] * t) < 1 + 1e-9 and abs(i + 1 - weight[s] * (t + 1)) < 1 + 1e-9
        assert abs(len(places) - weight[s] * slots) < 1 + 1e-9
    assert max(Counter(r.doc_id for r in out if r.source != "hot").values()) <= max(1, max(weight[s] for s in weight if s != "hot") * slots + 1)


def test_schedule_of_many_blocks_strays_less_than_one():
    quota = mixing.quotas({"a": 1 / 3, "b": 0.2718281828, "c": 0.01234567, None: 1e-5})
    total, had = sum(quota.values()), Counter()
    for t, s in enumerate(mixing.schedule(quota, 50_000), 1):
        had[s] += 1
        assert all(abs(had[x] * total - quota[x] * t) < total for x in quota)
