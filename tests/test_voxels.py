"""Voxel kernels against plain NumPy versions."""

from itertools import product

import numpy as np
import pytest

from lumenframe.operators import voxels as V

SHAPE = (5, 6, 7)


def frame(spark, arrays, value=False):
    rows = [(s, *map(int, p), *([float(a[tuple(p)])] if value else [])) for s, a in arrays.items() for p in (np.argwhere(a) if not value else np.argwhere(np.ones(a.shape, bool)))]
    return spark.createDataFrame(rows, "sample_id string, z int, y int, x int" + (", value double" if value else ""))


def cells(df):
    return {tuple(r) for r in df.select(*V.KEY).collect()}


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(5)
    return {"a": rng.random(SHAPE) < 0.35, "b": rng.random(SHAPE) < 0.8, "one": np.arange(210).reshape(SHAPE) == 100}


def plain_dilate(points, r):
    return {(s, z + a, y + b, x + c) for s, z, y, x in points for a, b, c in V.ball(r)}


def plain_erode(points, r):
    return {p for p in points if all((p[0], p[1] + a, p[2] + b, p[3] + c) in points for a, b, c in V.ball(r))}


def test_morphology(spark, masks):
    df = frame(spark, masks)
    points = cells(df)
    twice = df.unionAll(df)  # repeated voxels count once
    assert cells(V.dilate(twice)) == plain_dilate(points, 1)
    assert cells(V.erode(twice)) == plain_erode(points, 1)
    assert cells(V.closing(df)) == plain_erode(plain_dilate(points, 1), 1)
    assert cells(V.opening(df)) == plain_dilate(plain_erode(points, 1), 1)
    assert cells(V.dilate(df, 2)) == plain_dilate(points, 2)


def test_morphology_across_words(spark):
    rng = np.random.default_rng(7)
    shape = (3, 4, 200)
    points = {("a", *map(int, p)) for p in np.argwhere(rng.random(shape) < 0.7) - (1, 2, 90)}
    df = spark.createDataFrame(sorted(points), "sample_id string, z int, y int, x int")
    for r in (1, (0, 1, 5), (0, 0, 17)):
        assert cells(V.closing(df, r)) == plain_erode(plain_dilate(points, r), r), r
        assert cells(V.opening(df, r)) == plain_dilate(plain_erode(points, r), r), r
    assert V.dilate(df).schema["x"].dataType == df.schema["x"].dataType


def test_morphology_of_missing_coordinates(spark):
    rows = [("a", 0, 0, None), ("a", 0, None, 3), (None, 0, 0, 0)]
    got = cells(V.dilate(spark.createDataFrame(rows, "sample_id string, z int, y int, x int")))
    want = {(s, *(None if c is None else c + d for c, d in zip(p, o, strict=True))) for s, *p in rows for o in V.ball(1)}
    assert got == want


def test_morphology_exchanges_lines_of_voxels(spark):
    """What goes between tasks is a row for 64 voxels of a line and each of the ball's nine lines, not one for each of its 19 voxels."""
    line = spark.range(0, 6000, 1, 4).selectExpr("'a' sample_id", "0 z", "0 y", "cast(id as int) x")
    df = V.dilate(line)
    assert df.count() == 6000 * 9 + 2 * 5
    widest = max((int(m.value()) for m in _written(df)), default=0)
    assert 0 < widest < 6000


def _written(df):
    """The metrics of shuffle records written by the executed plan."""
    df.collect()
    plan, todo, out = df._jdf.queryExecution().executedPlan(), [], []
    todo.append(plan)
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        m = p.metrics().get("shuffleRecordsWritten")
        if m.isDefined():
            out.append(m.get())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def plain_components(points):
    left, out = set(points), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            s, z, y, x = p = todo.pop()
            group.add(p)
            for d, e, f in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)):
                q = (s, z + d, y + e, x + f)
                if q in left:
                    left.discard(q)
                    todo.append(q)
        out.append(group)
    return out


def test_components(spark, masks):
    df = frame(spark, masks)
    expected = {}
    for s in masks:
        groups = sorted(plain_components({p for p in cells(df) if p[0] == s}), key=lambda g: (-len(g), min(g)))
        for i, g in enumerate(groups, 1):
            expected |= {p: (i, len(g)) for p in g}
    got = {tuple(r)[:4]: (r.component, r.n_voxels) for r in V.connected_components(df.unionAll(df), max_components=None).collect()}
    assert got == expected
    few = V.connected_components(df, min_voxels=2, max_components=1)
    assert {tuple(r)[:4] for r in few.collect()} == {p for p, (i, n) in expected.items() if i == 1 and n >= 2}
    assert {r.component for r in V.connected_components(df).collect()} == {1} and V.connected_components(df.limit(0)).count() == 0


def test_crops(spark, masks):
    volume = frame(spark, {s: np.arange(210.0).reshape(SHAPE) for s in ("a", "one", "none")}, True)
    cropped = V.crop_to_mask(volume, frame(spark, masks))
    assert [tuple(r) for r in cropped.where("sample_id = 'one'").collect()] == [("one", 0, 0, 0, 100.0)]
    assert cropped.where("sample_id = 'none'").count() == 210
    sizes = spark.createDataFrame([("a", *SHAPE)], "sample_id string, n_z int, n_y int, n_x int")
    got = {(r.z, r.y, r.x): r.value for r in V.center_crop(volume, sizes, (2, 9, 4)).collect()}
    a = np.arange(210.0).reshape(SHAPE)[1:3, :, 1:5]
    assert got == {p: a[p] for p in product(*map(range, a.shape))}


@pytest.mark.parametrize("spacing", [(1.0, 1.0, 1.0), (2.0, 0.7, 1.5)])
def test_resample(spark, spacing):
    a = np.random.default_rng(1).random(SHAPE)
    geometry = spark.createDataFrame([("a", *SHAPE, 1.0, 1.0, 2.0)], "sample_id string, n_z int, n_y int, n_x int, s_z double, s_y double, s_x double")
    got = {(r.z, r.y, r.x): r.value for r in V.resample_linear(frame(spark, {"a": a}, True), geometry, spacing).collect()}
    old = (1.0, 1.0, 2.0)
    new = [max(1, round(n * o / s)) for n, o, s in zip(SHAPE, old, spacing)]
    assert set(got) == set(product(*map(range, new)))
    for p in got:
        at = [i * s / o for i, s, o in zip(p, spacing, old)]
        expected = 0.0
        if all(c <= n - 0.5 for c, n in zip(at, SHAPE)):
            at = [min(c, n - 1) for c, n in zip(at, SHAPE)]
            for bits in product((0, 1), repeat=3):
                w = np.prod([c % 1 if b else 1 - c % 1 for c, b in zip(at, bits)])
                if w > 0:
                    expected += w * a[tuple(int(c) + b for c, b in zip(at, bits))]
        assert got[p] == pytest.approx(expected)


def test_preprocess(spark):
    a = np.arange(8.0).reshape(2, 2, 2)
    df = frame(spark, {"a": a, "flat": np.ones((1, 1, 2))}, True)
    out = V.preprocess(df, [{"op": "clamp", "lower": 1, "upper": 5}, {"op": "zscore"}, {"op": "float32"}])
    got = {tuple(r)[:4]: r.value for r in out.collect()}
    c = np.clip(a, 1, 5)
    assert got[("a", 1, 1, 1)] == pytest.approx((5 - c.mean()) / c.std(), rel=1e-6)
    assert got[("flat", 0, 0, 0)] == 1.0
    with pytest.raises(ValueError, match="sharpen"):
        V.preprocess(df, [{"op": "sharpen"}])


def test_lung_threshold(spark):
    a = np.zeros((9, 9, 9))
    a[0, :, :] = -1000.0
    a[3:5, 3:5, 3:5] = -900.0
    a[7, 7, 7] = -900.0
    sizes = spark.createDataFrame([("a", 9, 9, 9), ("rim", 2, 2, 2)], "sample_id string, n_z int, n_y int, n_x int")
    df = frame(spark, {"a": a, "rim": np.full((2, 2, 2), -500.0)}, True)
    got = cells(V.lung_threshold(df, sizes, min_voxels=2))
    assert {p[1:] for p in got if p[0] == "a"} == set(product((3, 4), repeat=3))
    assert sum(p[0] == "rim" for p in got) == 8
    none = spark.createDataFrame([("a", 9, 9, 9), ("void", 9, 9, 9)], sizes.schema)
    with pytest.raises(Exception, match="no lung found in void"):
        V.lung_threshold(df, none, min_voxels=2).collect()


def test_lung_gaps_are_closed_by_axis(spark):
    a = np.zeros((9, 13, 13))
    a[3:6, 4:9, 4:9] = -900.0
    a[3:6, 6, 5:8] = 0.0  # a gap of one voxel in y
    sizes = spark.createDataFrame([("a", 9, 13, 13)], "sample_id string, n_z int, n_y int, n_x int")
    got = {p[1:] for p in cells(V.lung_threshold(frame(spark, {"a": a}, True), sizes, min_voxels=2))}
    assert got >= set(product(range(3, 6), range(4, 9), range(4, 9)))
