"""

Matrices of grey levels are counted by joins of voxels with their neighbours and by sorting lines, never by gathering an image; only
zones need connected components. A matrix has a few thousand cells for each image, and features are sums over it.

Levels are ``floor(value / width) - floor(min / width) + 1``. Directions are the 13 of a 3-D grid; features that depend on a direction are
averaged over those that hold a pair. Regions of one voxel or one level have their defined limits (a null where a feature divides by 0).
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.statistics import quantiles
from lumenframe.operators.voxels import AXES, KEY, connected_components

DIRECTIONS = [o for o in product((0, 1), (-1, 0, 1), (-1, 0, 1)) if o > (0, 0, 0)]
#: Keeps a logarithm of 0 away.
EPS = 2.2e-16


def levels(region: DataFrame, width: float = 25.0) -> DataFrame:
    """The region with ``level`` in place of the value."""
    low = region.groupBy("sample_id").agg(F.floor(F.min("value") / width).alias("_low"))
    return region.join(low, "sample_id").select(*KEY, (F.floor(F.col("value") / width) - F.col("_low") + 1).cast("int").alias("level"))


def _shifted(voxels: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Each voxel with each of its neighbours in the region: ``level``, ``other``, ``direction`` (the number of the offset) and the voxel's place."""
    ways = F.explode(F.array(*[F.struct(F.lit(i).alias("direction"), *[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)]) for i, o in enumerate(offsets)])).alias("w")
    asked = voxels.select("*", ways).select("sample_id", *[(F.col(a) + F.col(f"w.d{a}")).alias(a) for a in AXES], *[F.col(a).alias(f"at_{a}") for a in AXES], "level", "w.direction")
    return asked.join(voxels.select(*KEY, F.col("level").alias("other")), list(KEY))


def glcm(voxels: DataFrame) -> DataFrame:
    """(sample_id, direction, i, j, n): symmetric counts of the levels of neighbours."""
    pairs = _shifted(voxels, DIRECTIONS).groupBy("sample_id", "direction", F.col("level").alias("i"), F.col("other").alias("j")).agg(F.count("*").alias("n"))
    return pairs.unionByName(pairs.select("sample_id", "direction", F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy("sample_id", "direction", "i", "j").agg(F.sum("n").alias("n"))


def glcm_features(matrix: DataFrame) -> DataFrame:
    """The 23 features that are sums, and the maximal correlation left out; averaged over directions."""
    w = Window.partitionBy("sample_id", "direction")
    m = matrix.withColumn("p", F.col("n") / F.sum("n").over(w))
    px = F.sum("p").over(Window.partitionBy("sample_id", "direction", "i"))
    m = m.withColumn("px", px).withColumn("mu", F.sum(F.col("i") * F.col("p")).over(w))
    # the matrix is symmetric: columns have the sums of rows
    py = m.select("sample_id", "direction", F.col("i").alias("j"), F.col("px").alias("py")).distinct()
    m = m.join(py, ["sample_id", "direction", "j"])
    ng = m.groupBy("sample_id").agg(F.count_distinct("i").alias("ng"))
    p, i, j, mu = F.col("p"), F.col("i"), F.col("j"), F.col("mu")
    d = F.abs(i - j)
    both = i + j - 2 * mu
    by = ["sample_id", "direction"]
    log = lambda x: F.log2(x + EPS)
    out = m.join(ng, "sample_id").groupBy(*by).agg(
        F.sum(p * i * j).alias("Autocorrelation"), F.first("mu").alias("JointAverage"), F.sum(F.pow(both, 4) * p).alias("ClusterProminence"), F.sum(F.pow(both, 3) * p).alias("ClusterShade"),
        F.sum(both * both * p).alias("ClusterTendency"), F.sum(d * d * p).alias("Contrast"), F.sum(F.pow(i - mu, 2) * p).alias("SumSquares"), F.sum((i - mu) * (j - mu) * p).alias("_cov"),
        F.sum(p * p).alias("JointEnergy"), (-F.sum(p * log(p))).alias("JointEntropy"), (-F.sum(p * log(F.col("px") * F.col("py")))).alias("_hxy1"),
        F.sum(p / (1 + d)).alias("Id"), F.sum(p / (1 + d * d)).alias("Idm"), F.sum(p / (1 + d / F.col("ng"))).alias("Idn"), F.sum(p / (1 + d * d / F.pow("ng", F.lit(2)))).alias("Idmn"),
        F.sum(F.when(d > 0, p / (d * d))).alias("_iv"), F.max(p).alias("MaximumProbability"), F.sum(d * p).alias("DifferenceAverage"), F.sum((i + j) * p).alias("SumAverage"),
    )
    entropy = lambda of, name: m.groupBy(*by, of.alias("_k")).agg(F.sum("p").alias("q")).groupBy(*by).agg((-F.sum(F.col("q") * log(F.col("q")))).alias(name))
    hx = m.select(*by, "i", "px").distinct().groupBy(*by).agg((-F.sum(F.col("px") * log(F.col("px")))).alias("_hx"))
    rows = m.select(*by, "i", "px").distinct()
    cols = rows.select(*by, F.col("i").alias("j"), F.col("px").alias("py"))
    hxy2 = rows.join(cols, by).groupBy(*by).agg((-F.sum(F.col("px") * F.col("py") * log(F.col("px") * F.col("py")))).alias("_hxy2"))
    for part in (entropy(d, "DifferenceEntropy"), entropy(i + j, "SumEntropy"), hx, hxy2):
        out = out.join(part, by)
    out = out.withColumns({
        "Correlation": F.when(F.col("SumSquares") > 0, F.col("_cov") / F.col("SumSquares")).otherwise(1.0),
        "DifferenceVariance": F.col("Contrast") - F.pow("DifferenceAverage", F.lit(2)),
        "InverseVariance": F.coalesce("_iv", F.lit(0.0)),
        "Imc1": F.when(F.col("_hx") > 0, (F.col("JointEntropy") - F.col("_hxy1")) / F.col("_hx")).otherwise(0.0),
        "Imc2": F.sqrt(F.greatest(F.lit(0.0), 1 - F.exp(-2 * (F.col("_hxy2") - F.col("JointEntropy"))))),
    })
    names = [c for c in out.columns if c not in by and not c.startswith("_")]
    return out.groupBy("sample_id").agg(*[F.avg(c).alias(f"glcm_{c}") for c in names])


def glrlm(voxels: DataFrame) -> DataFrame:
    """(sample_id, direction, level, size, n): runs of equal levels along lines; a run ends where the region does.

    A voxel starts a run if the one before it in the direction has another level or is outside; the run's voxels are then numbered
    along their line.
    """
    out = None
    for k, o in enumerate(DIRECTIONS):
        # a line is known by its places minus the steps along it
        lead = next(a for a, d in zip(AXES, o, strict=True) if d)
        t = F.col(lead)
        line = [(F.col(a) - t * d).alias(f"l{a}") for a, d in zip(AXES, o, strict=True)]
        w = Window.partitionBy("sample_id", *[f"l{a}" for a in AXES]).orderBy("t")
        rows = voxels.select("sample_id", "level", *line, t.alias("t"))
        fresh = F.when((F.lag("t").over(w) == F.col("t") - 1) & (F.lag("level").over(w) == F.col("level")), 0).otherwise(1)
        runs = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w)).groupBy("sample_id", *[f"l{a}" for a in AXES], "run").agg(F.first("level").alias("level"), F.count("*").alias("size"))
        runs = runs.groupBy("sample_id", "level", "size").agg(F.count("*").alias("n")).select("sample_id", F.lit(k).alias("direction"), "level", "size", "n")
        out = runs if out is None else out.unionByName(runs)
    return out


def glszm(voxels: DataFrame) -> DataFrame:
    """(sample_id, direction, level, size, n): zones of equal levels, joined by corners too."""
    zones = connected_components(voxels, 1, None, ("sample_id", "level"), corners=True).select("sample_id", "level", "component", F.col("n_voxels").alias("size")).distinct()
    return zones.groupBy("sample_id", "level", "size").agg(F.count("*").alias("n")).withColumn("direction", F.lit(0))


def gldm(voxels: DataFrame, alpha: int = 0) -> DataFrame:
    """(sample_id, direction, level, size, n): how many voxels have so many neighbours within ``alpha`` levels, themselves included."""
    near = _shifted(voxels, [*DIRECTIONS, *[tuple(-d for d in o) for o in DIRECTIONS]]).where(F.abs(F.col("level") - F.col("other")) <= alpha)
    dependent = near.groupBy("sample_id", *[F.col(f"at_{a}").alias(a) for a in AXES]).agg(F.count("*").alias("m"))
    rows = voxels.join(dependent, list(KEY), "left").withColumn("size", F.coalesce("m", F.lit(0)) + 1)
    return rows.groupBy("sample_id", "level", "size").agg(F.count("*").alias("n")).withColumn("direction", F.lit(0))


#: The names of a family's features: run lengths, zones, dependences.
FAMILIES = {
    "glrlm": ("ShortRunEmphasis", "LongRunEmphasis", "GrayLevelNonUniformity", "GrayLevelNonUniformityNormalized", "RunLengthNonUniformity", "RunLengthNonUniformityNormalized", "RunPercentage", "GrayLevelVariance", "RunVariance", "RunEntropy", "LowGrayLevelRunEmphasis", "HighGrayLevelRunEmphasis", "ShortRunLowGrayLevelEmphasis", "ShortRunHighGrayLevelEmphasis", "LongRunLowGrayLevelEmphasis", "LongRunHighGrayLevelEmphasis"),
    "glszm": ("SmallAreaEmphasis", "LargeAreaEmphasis", "GrayLevelNonUniformity", "GrayLevelNonUniformityNormalized", "SizeZoneNonUniformity", "SizeZoneNonUniformityNormalized", "ZonePercentage", "GrayLevelVariance", "ZoneVariance", "ZoneEntropy", "LowGrayLevelZoneEmphasis", "HighGrayLevelZoneEmphasis", "SmallAreaLowGrayLevelEmphasis", "SmallAreaHighGrayLevelEmphasis", "LargeAreaLowGrayLevelEmphasis", "LargeAreaHighGrayLevelEmphasis"),
    "gldm": ("SmallDependenceEmphasis", "LargeDependenceEmphasis", "GrayLevelNonUniformity", None, "DependenceNonUniformity", "DependenceNonUniformityNormalized", None, "GrayLevelVariance", "DependenceVariance", "DependenceEntropy", "LowGrayLevelEmphasis", "HighGrayLevelEmphasis", "SmallDependenceLowGrayLevelEmphasis", "SmallDependenceHighGrayLevelEmphasis", "LargeDependenceLowGrayLevelEmphasis", "LargeDependenceHighGrayLevelEmphasis"),
}


def size_features(matrix: DataFrame, family: str) -> DataFrame:
    """The features of a matrix of (level, size), averaged over its directions; the three families differ in names only."""
    by = ["sample_id", "direction"]
    g, s, n = F.col("level").cast("double"), F.col("size").cast("double"), F.col("n").cast("double")
    total = matrix.groupBy(*by).agg(F.sum(n).alias("z"), F.sum(n * s).alias("voxels"), (F.sum(n * g) / F.sum(n)).alias("mg"), (F.sum(n * s) / F.sum(n)).alias("ms"))
    m = matrix.join(total, by)
    p = n / F.col("z")
    square = lambda key, name: matrix.groupBy(*by, key).agg(F.sum("n").alias("q")).groupBy(*by).agg(F.sum(F.col("q").cast("double") * F.col("q")).alias(name))
    sums = m.groupBy(*by).agg(
        F.first("z").alias("z"), F.first("voxels").alias("voxels"), F.sum(p / (s * s)).alias("f0"), F.sum(p * s * s).alias("f1"), F.sum(p * F.pow(g - F.col("mg"), 2)).alias("f7"), F.sum(p * F.pow(s - F.col("ms"), 2)).alias("f8"),
        (-F.sum(p * F.log2(p + EPS))).alias("f9"), F.sum(p / (g * g)).alias("f10"), F.sum(p * g * g).alias("f11"), F.sum(p / (g * g * s * s)).alias("f12"), F.sum(p * g * g / (s * s)).alias("f13"), F.sum(p * s * s / (g * g)).alias("f14"), F.sum(p * g * g * s * s).alias("f15"),
    )
    sums = sums.join(square("level", "gl"), by).join(square("size", "sz"), by)
    sums = sums.withColumns({"f2": F.col("gl") / F.col("z"), "f3": F.col("gl") / F.pow("z", F.lit(2)), "f4": F.col("sz") / F.col("z"), "f5": F.col("sz") / F.pow("z", F.lit(2)), "f6": F.col("z") / F.col("voxels")})
    return sums.groupBy("sample_id").agg(*[F.avg(f"f{i}").alias(f"{family}_{x}") for i, x in enumerate(FAMILIES[family]) if x])


def ngtdm_features(voxels: DataFrame) -> DataFrame:
    """Coarseness, Contrast, Busyness, Complexity and Strength from each level's distance to the mean of its neighbours."""
    near = _shifted(voxels, [*DIRECTIONS, *[tuple(-d for d in o) for o in DIRECTIONS]])
    mean = near.groupBy("sample_id", *[F.col(f"at_{a}").alias(a) for a in AXES]).agg(F.avg("other").alias("m"))
    rows = voxels.join(mean, list(KEY)).groupBy("sample_id", "level").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("level") - F.col("m"))).alias("s"))
    total = rows.groupBy("sample_id").agg(F.sum("n").alias("nv"), F.count("*").alias("ng"), F.sum("s").alias("ss"))
    rows = rows.join(total, "sample_id").withColumn("p", F.col("n") / F.col("nv"))
    own = rows.groupBy("sample_id").agg(F.first("ng").alias("ng"), F.first("nv").alias("nv"), F.first("ss").alias("ss"), F.sum(F.col("p") * F.col("s")).alias("ps"))
    a = rows.select("sample_id", F.col("level").alias("i"), F.col("p").alias("pi"), F.col("s").alias("si"))
    b = rows.select("sample_id", F.col("level").alias("j"), F.col("p").alias("pj"), F.col("s").alias("sj"))
    i, j, pi, pj = (F.col(c) for c in ("i", "j", "pi", "pj"))
    pairs = a.join(b, "sample_id").groupBy("sample_id").agg(  # pairs of levels, a few thousand for each image
        F.sum(pi * pj * F.pow(i - j, 2)).alias("c"), F.sum(F.abs(i * pi - j * pj)).alias("b"), F.sum(F.abs(i - j) * (pi * F.col("si") + pj * F.col("sj")) / (pi + pj)).alias("x"), F.sum((pi + pj) * F.pow(i - j, 2)).alias("t"))
    f = own.join(pairs, "sample_id")
    div = lambda u, v, other: F.when(v > 0, u / v).otherwise(F.lit(other))
    return f.select(
        "sample_id", div(F.lit(1.0), F.col("ps"), 1e6).alias("ngtdm_Coarseness"), F.when(F.col("ng") > 1, F.col("c") / (F.col("ng") * (F.col("ng") - 1)) * F.col("ss") / F.col("nv")).otherwise(0.0).alias("ngtdm_Contrast"),
        div(F.col("ps"), F.col("b"), 0.0).alias("ngtdm_Busyness"), (F.col("x") / F.col("nv")).alias("ngtdm_Complexity"), div(F.col("t"), F.col("ss"), 0.0).alias("ngtdm_Strength"),
    )


def first_order(region: DataFrame, width: float = 25.0, voxel_volume: float = 1.0, shift: float = 0.0) -> DataFrame:
    """The 18 first-order features of each region; quantiles as ``statistics.quantiles`` makes them."""
    q = quantiles(region, "sample_id", "value", [0.1, 0.25, 0.5, 0.75, 0.9]).select("sample_id", *[F.get("q", F.lit(i)).alias(f"q{i}") for i in range(5)])
    v = F.col("value")
    base = region.groupBy("sample_id").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.sum(F.pow(v + shift, 2)).alias("e")).join(q, "sample_id")
    robust = F.col("value").between(F.col("q0"), F.col("q4"))
    inner = region.join(base.select("sample_id", "q0", "q4"), "sample_id").where(robust).groupBy("sample_id").agg(F.avg("value").alias("rm"))
    rows = region.join(base, "sample_id").join(inner, "sample_id")
    c = v - F.col("mean")
    moments = rows.groupBy("sample_id").agg(F.avg(F.abs(c)).alias("mad"), F.avg(F.pow(c, 3)).alias("m3"), F.avg(F.pow(c, 4)).alias("m4"), F.avg(F.when(robust, F.abs(v - F.col("rm")))).alias("rmad"))
    bins = levels(region, width).groupBy("sample_id", "level").agg(F.count("*").alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy("sample_id"))
    bins = bins.withColumn("p", p).groupBy("sample_id").agg((-F.sum(F.col("p") * F.log2(F.col("p") + EPS))).alias("ent"), F.sum(F.col("p") * F.col("p")).alias("uni"))
    o = base.join(moments, "sample_id").join(bins, "sample_id")
    flat = lambda x: F.when(F.col("var") > 0, x).otherwise(0.0)
    named = {
        "Energy": F.col("e"), "TotalEnergy": F.col("e") * voxel_volume, "Entropy": F.col("ent"), "Minimum": F.col("lo"), "10Percentile": F.col("q0"), "90Percentile": F.col("q4"), "Maximum": F.col("hi"), "Mean": F.col("mean"),
        "Median": F.col("q2"), "InterquartileRange": F.col("q3") - F.col("q1"), "Range": F.col("hi") - F.col("lo"), "MeanAbsoluteDeviation": F.col("mad"), "RobustMeanAbsoluteDeviation": F.col("rmad"), "RootMeanSquared": F.sqrt(F.col("e") / F.col("n")),
        "Skewness": flat(F.col("m3") / F.pow("var", F.lit(1.5))), "Kurtosis": flat(F.col("m4") / F.pow("var", F.lit(2))), "Variance": F.col("var"), "Uniformity": F.col("uni"),
    }
    return o.select("sample_id", *[c.alias(f"firstorder_{n}") for n, c in named.items()])


def extract(region: DataFrame, profile: dict) -> DataFrame:
    """VOX-19, UDF-05: one row for each sample with the features of the profile's classes; a class with a list has those only.

    Shape and filtered images are not made here; a profile that asks for them is an error, not a table without them.
    """
    width = float(profile.get("setting", {}).get("binWidth", 25))
    odd = [*[c for c in profile["featureClass"] if c not in ("firstorder", "glcm", "ngtdm", *FAMILIES)], *[t for t in profile.get("imageType", {}) if t != "Original"]]
    if odd:
        raise NotImplementedError(f"no features of {', '.join(odd)}")
    voxels = levels(region, width)
    made = {"firstorder": lambda: first_order(region, width), "glcm": lambda: glcm_features(glcm(voxels)), "ngtdm": lambda: ngtdm_features(voxels)}
    made |= {f: (lambda f=f: size_features({"glrlm": glrlm, "glszm": glszm, "gldm": gldm}[f](voxels), f)) for f in FAMILIES}
    parts = []
    for name, wanted in profile["featureClass"].items():
        df = made[name]()
        parts.append(df.select("sample_id", *[f"{name}_{w}" for w in wanted]) if wanted else df)
    return reduce(lambda a, b: a.join(b, "sample_id"), parts)


