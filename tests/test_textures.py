"""Radiomics features against plain NumPy versions that count every pair, run, zone and neighbour."""

from itertools import product

import numpy as np
import pytest

from lumenframe.operators import textures as T

SHAPE, WIDTH = (4, 5, 6), 25.0


@pytest.fixture(scope="module")
def volume():
    r = np.random.default_rng(3)
    a = r.integers(0, 120, SHAPE).astype(float)
    inside = r.random(SHAPE) < 0.8
    return a, inside


@pytest.fixture(scope="module")
def region(spark, volume):
    a, inside = volume
    rows = [("s", *map(int, p), float(a[tuple(p)])) for p in np.argwhere(inside)] + [("one", 0, 0, 0, 5.0), ("flat", 0, 0, 0, 5.0), ("flat", 0, 0, 1, 5.0)]
    return spark.createDataFrame(rows, "sample_id string, z int, y int, x int, value double").cache()


def grid(volume):
    a, inside = volume
    low = np.floor(a[inside].min() / WIDTH)
    return {tuple(map(int, p)): int(np.floor(a[tuple(p)] / WIDTH) - low + 1) for p in np.argwhere(inside)}


def add(p, o, k=1):
    return tuple(x + k * d for x, d in zip(p, o, strict=True))


def test_first_order(region, volume):
    v = volume[0][volume[1]]
    got = next(r for r in T.first_order(region).collect() if r.sample_id == "s").asDict()
    q = np.percentile(v, [10, 25, 50, 75, 90])
    k = np.bincount(list(grid(volume).values()))
    p = k[k > 0] / k.sum()
    rob = v[(v >= q[0]) & (v <= q[4])]
    c = v - v.mean()
    want = {"Energy": (v**2).sum(), "Entropy": -(p * np.log2(p)).sum(), "10Percentile": q[0], "InterquartileRange": q[3] - q[1], "MeanAbsoluteDeviation": abs(c).mean(), "RobustMeanAbsoluteDeviation": abs(rob - rob.mean()).mean(), "RootMeanSquared": np.sqrt((v**2).mean()), "Skewness": (c**3).mean() / v.std() ** 3, "Kurtosis": (c**4).mean() / v.var() ** 2, "Variance": v.var(), "Uniformity": (p**2).sum(), "Median": q[2], "Range": np.ptp(v)}
    for name, x in want.items():
        assert got[f"firstorder_{name}"] == pytest.approx(x), name
    assert len(got) == 19


def test_cooccurrence(region, volume):
    g = grid(volume)
    got = {(r.direction, r.i, r.j): r.n for r in T.glcm(T.levels(region)).where("sample_id = 's'").collect()}
    want = {}
    for k, o in enumerate(T.DIRECTIONS):
        for p, a in g.items():
            b = g.get(add(p, o))
            if b:
                for x in ((a, b), (b, a)):
                    want[k, *x] = want.get((k, *x), 0) + 1
    assert got == want
    f = {"Contrast": [], "Correlation": [], "JointEntropy": [], "Imc1": [], "Imc2": [], "SumEntropy": [], "Idn": [], "InverseVariance": [], "ClusterShade": [], "DifferenceVariance": []}
    n = max(g.values())
    i, j = np.meshgrid(np.arange(1, n + 1), np.arange(1, n + 1), indexing="ij")
    ng = len(set(g.values()))
    for k in range(13):
        m = np.zeros((n, n))
        for (d, a, b), c in want.items():
            if d == k:
                m[a - 1, b - 1] = c
        m /= m.sum()
        px = m.sum(1)
        mu = (i * m).sum()
        h = lambda x: -(x[x > 0] * np.log2(x[x > 0])).sum()
        outer = np.outer(px, px)
        hxy1, hxy2 = -(m[outer > 0] * np.log2(outer[outer > 0])).sum(), h(outer)
        diff = np.array([m[abs(i - j) == t].sum() for t in range(n)])
        f["Contrast"].append(((i - j) ** 2 * m).sum())
        f["Correlation"].append(((i - mu) * (j - mu) * m).sum() / ((i - mu) ** 2 * m).sum())
        f["JointEntropy"].append(h(m))
        f["Imc1"].append((h(m) - hxy1) / h(px))
        f["Imc2"].append(np.sqrt(1 - np.exp(-2 * (hxy2 - h(m)))))
        f["SumEntropy"].append(h(np.array([m[i + j == t].sum() for t in range(2, 2 * n + 1)])))
        f["Idn"].append((m / (1 + abs(i - j) / ng)).sum())
        f["InverseVariance"].append((m[i != j] / (i - j)[i != j] ** 2).sum())
        f["ClusterShade"].append(((i + j - 2 * mu) ** 3 * m).sum())
        f["DifferenceVariance"].append((np.arange(n) ** 2 * diff).sum() - (np.arange(n) * diff).sum() ** 2)
    row = next(r for r in T.glcm_features(T.glcm(T.levels(region))).collect() if r.sample_id == "s").asDict()
    for name, x in f.items():
        assert row[f"glcm_{name}"] == pytest.approx(np.mean(x), abs=1e-9), name


def plain_runs(g):
    out = {}
    for k, o in enumerate(T.DIRECTIONS):
        for p, a in g.items():
            if g.get(add(p, o, -1)) != a:
                n = 1
                while g.get(add(p, o, n)) == a:
                    n += 1
                out[k, a, n] = out.get((k, a, n), 0) + 1
    return out


def plain_zones(g):
    left, out = dict(g), {}
    while left:
        p, a = left.popitem()
        todo, n = [p], 0
        while todo:
            q = todo.pop()
            n += 1
            for o in product((-1, 0, 1), repeat=3):
                if left.get(add(q, o)) == a:
                    del left[add(q, o)]
                    todo.append(add(q, o))
        out[0, a, n] = out.get((0, a, n), 0) + 1
    return out


def plain_dependence(g):
    out = {}
    for p, a in g.items():
        n = sum(g.get(add(p, o)) == a for o in product((-1, 0, 1), repeat=3))
        out[0, a, n] = out.get((0, a, n), 0) + 1
    return out


@pytest.mark.parametrize("family,make,plain", [("glrlm", T.glrlm, plain_runs), ("glszm", T.glszm, plain_zones), ("gldm", T.gldm, plain_dependence)])
def test_sizes(region, volume, family, make, plain):
    want = plain(grid(volume))
    matrix = make(T.levels(region)).cache()
    assert {(r.direction, r.level, r["size"]): r.n for r in matrix.where("sample_id = 's'").collect()} == want
    rows = {r.sample_id: r.asDict() for r in T.size_features(matrix, family).collect()}
    names = T.FAMILIES[family]
    found = {n: [] for n in range(16)}
    for d in {k[0] for k in want}:
        c = np.array([(g, s, n) for (k, g, s), n in want.items() if k == d], float)
        g, s, n = c.T
        p = n / n.sum()
        per = lambda x, n=n: np.array([n[x == t].sum() for t in set(x)])
        found[0].append((p / s**2).sum())
        found[2].append((per(g) ** 2).sum() / n.sum())
        found[5].append((per(s) ** 2).sum() / n.sum() ** 2)
        found[6].append(n.sum() / (n * s).sum())
        found[8].append((p * (s - (p * s).sum()) ** 2).sum())
        found[9].append(-(p * np.log2(p)).sum())
        found[14].append((p * s**2 / g**2).sum())
    for i, x in found.items():
        if x and names[i]:
            assert rows["s"][f"{family}_{names[i]}"] == pytest.approx(np.mean(x)), names[i]
    assert len(rows["one"]) == 1 + sum(n is not None for n in names)


def test_tone_differences(region, volume):
    g = grid(volume)
    s, n = {}, {}
    for p, a in g.items():
        near = [g[add(p, o)] for o in product((-1, 0, 1), repeat=3) if any(o) and add(p, o) in g]
        if near:
            s[a] = s.get(a, 0) + abs(a - np.mean(near))
            n[a] = n.get(a, 0) + 1
    nv, p = sum(n.values()), {a: k / sum(n.values()) for a, k in n.items()}
    row = next(r for r in T.ngtdm_features(T.levels(region)).collect() if r.sample_id == "s").asDict()
    ps = sum(p[a] * s[a] for a in p)
    assert row["ngtdm_Coarseness"] == pytest.approx(1 / ps)
    assert row["ngtdm_Busyness"] == pytest.approx(ps / sum(abs(a * p[a] - b * p[b]) for a in p for b in p))
    assert row["ngtdm_Contrast"] == pytest.approx(sum(p[a] * p[b] * (a - b) ** 2 for a in p for b in p) / len(p) / (len(p) - 1) * sum(s.values()) / nv)
    assert row["ngtdm_Strength"] == pytest.approx(sum((p[a] + p[b]) * (a - b) ** 2 for a in p for b in p) / sum(s.values()))


def test_profiles(region):
    from lumenframe.plans.workflows import profile

    out = T.extract(region, {"setting": {"binWidth": 25}, "featureClass": {"firstorder": ["Energy"], "glrlm": ["RunEntropy"], "gldm": None}})
    assert out.columns[:3] == ["sample_id", "firstorder_Energy", "glrlm_RunEntropy"] and out.count() == 3 and len(out.columns) == 17
    with pytest.raises(NotImplementedError, match="shape, Wavelet"):
        T.extract(region, profile("aerts_signature_v1"))
