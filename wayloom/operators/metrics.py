"""Measures of communities and clusterings, in closed form over aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conductance(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, cut, volume, conductance): edges that leave or enter, ends of edges at its members, cut / (cut + volume); NULL without a cut."""
    l1, l2 = labels.select(F.col("cell").alias("src"), F.col("community").alias("c1")), labels.select(F.col("cell").alias("dst"), F.col("community").alias("c2"))
    both = graph.select("src", "dst").join(l1, "src").join(l2, "dst")
    ends = both.select(F.explode(F.array(F.struct(F.col("c1").alias("community"), F.col("c2").alias("o")), F.struct(F.col("c2").alias("community"), F.col("c1").alias("o")))).alias("e")).select("e.*")
    per = ends.groupBy("community").agg(F.sum((F.col("community") != F.col("o")).cast("long")).alias("cut"), F.count("*").alias("volume"))
    return per.withColumn("conductance", F.when(F.col("cut") > 0, F.col("cut") / (F.col("cut") + F.col("volume"))))


def modularity(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """(q): directed modularity, the sum over communities of L / m - K_out K_in / m^2."""
    l1, l2 = labels.select(F.col("cell").alias("src"), F.col("community").alias("c1")), labels.select(F.col("cell").alias("dst"), F.col("community").alias("c2"))
    both = graph.select("src", "dst").join(l1, "src").join(l2, "dst")
    ends = both.select(F.explode(F.array(F.struct(F.col("c1").alias("c"), (F.col("c1") == F.col("c2")).cast("long").alias("l"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("c2").alias("c"), F.lit(0).cast("long").alias("l"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    per = ends.groupBy("c").agg(F.sum("l").alias("l"), F.sum("o").alias("o"), F.sum("i").alias("i"))
    total = per.agg(F.sum("o").alias("m"))
    return per.join(F.broadcast(total)).agg(F.sum(F.col("l") / F.col("m") - F.col("o").cast("double") * F.col("i") / F.col("m") / F.col("m")).alias("q"))


def triangle_participation(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, members, in_triangle, tpr): members on a directed triangle i-j, j-w, i-w inside their community."""
    l1, l2 = labels.select(F.col("cell").alias("src"), F.col("community").alias("c1")), labels.select(F.col("cell").alias("dst"), F.col("community").alias("c2"))
    inner = graph.where("src <> dst").select("src", "dst").distinct().join(l1, "src").join(l2, "dst").where("c1 = c2").select("c1", "src", "dst")
    ij, jw, iw = (inner.select("c1", F.col("src").alias(a), F.col("dst").alias(b)) for a, b in (("i", "j"), ("j", "w"), ("i", "w")))
    tri = ij.join(jw, ["c1", "j"]).where("i <> w").join(iw, ["c1", "i", "w"])
    hit = tri.select(F.col("c1").alias("community"), F.explode(F.array("i", "j", "w")).alias("cell")).distinct().groupBy("community").agg(F.count("*").alias("in_triangle"))
    return labels.groupBy("community").agg(F.count("*").alias("members")).join(hit, "community", "left").select("community", "members", F.coalesce("in_triangle", F.lit(0)).alias("in_triangle")).withColumn("tpr", F.col("in_triangle") / F.col("members"))


def contingency(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """(true, pred, n)."""
    return rows.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def best_matching(table: np.ndarray) -> list[int]:
    """Column for each row of a square table that makes the sum greatest: the Hungarian method with potentials on the negated table."""
    n = len(table)
    cost = -np.asarray(table, float)
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used, back = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while owner[j0]:
            used[j0] = True
            free = np.flatnonzero(~used)
            reduced = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = reduced < least[free]
            least[free[better]], back[free[better]] = reduced[better], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[back[j0]]
            j0 = back[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out


def clustering_scores(rows: DataFrame, true: str, pred: str) -> dict[str, float]:
    """accuracy (best matching), macro_f1 under it, nmi (arithmetic mean) and ari. The driver sees the contingency table, labels by labels."""
    got = contingency(rows, true, pred).collect()
    a, b = sorted({r["true"] for r in got}), sorted({r["pred"] for r in got})
    size = max(len(a), len(b))
    t = np.zeros((size, size))
    for r in got:
        t[a.index(r["true"]), b.index(r["pred"])] = r["n"]
    n, match = t.sum(), best_matching(t)
    hit = t[np.arange(size), match]
    f1 = 2 * hit / np.maximum(t.sum(axis=1) + t.sum(axis=0)[match], 1)
    p, q = t.sum(axis=1) / n, t.sum(axis=0) / n
    joint = t / n
    mask = joint > 0
    mi = (joint[mask] * np.log(joint[mask] / np.outer(p, q)[mask])).sum()
    h = lambda x: -(x[x > 0] * np.log(x[x > 0])).sum()
    pairs = lambda x: (x * (x - 1) / 2).sum()
    index, rows_, cols = pairs(t), pairs(t.sum(axis=1)), pairs(t.sum(axis=0))
    expected = rows_ * cols / max(pairs(np.array([n])), 1)
    top = (rows_ + cols) / 2 - expected
    both = (h(p) + h(q)) / 2
    return {"accuracy": hit.sum() / n, "macro_f1": float(f1[: len(a)].mean()), "nmi": float(mi / both) if both else 1.0, "ari": float((index - expected) / top) if top else 1.0}


def _square(a: Column, b: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def inertia(rows: DataFrame, centres: DataFrame, most: int = 10_000) -> DataFrame:
    """(inertia): sum over rows (feature) of the square distance to the nearest of centres (centre); the centres, at most most, stand in one broadcast row."""
    if centres.count() > most:
        raise ValueError("too many centres for one row")
    one = centres.agg(F.collect_list("centre").alias("centres"))
    near = F.array_min(F.transform("centres", lambda c: _square(F.col("feature"), c)))
    return rows.select("feature").join(F.broadcast(one)).agg(F.sum(near).alias("inertia"))


def silhouette(rows: DataFrame, label: str) -> DataFrame:
    """(silhouette): mean over rows (feature, label) of (b - a) / max(a, b) with squared distances, from each cluster's sums; rows that are alone in their cluster count 0."""
    f = F.col("feature")
    norm = F.aggregate(f, F.lit(0.0), lambda t, x: t + x * x)
    data = rows.select(F.col(label).alias("own"), "feature", norm.alias("norm"))
    dim = F.size("feature")
    long = data.select("own", F.posexplode("feature").alias("k", "x")).groupBy("own", "k").agg(F.sum("x").alias("x"))
    sums = long.groupBy("own").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("total"))
    each = data.groupBy("own").agg(F.count("*").alias("n"), F.sum("norm").alias("norms")).join(sums, "own")
    one = each.agg(F.collect_list(F.struct("own", "n", "norms", "total")).alias("all"))
    dot = lambda t: F.aggregate(F.zip_with("feature", t, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    total = F.transform("all", lambda c: F.struct(c["own"].alias("c"), c["n"].alias("n"), (c["n"] * F.col("norm") + c["norms"] - 2 * dot(c["total"])).alias("d")))
    got = data.where(dim > 0).join(F.broadcast(one)).withColumn("t", total)
    mine = F.filter("t", lambda c: c["c"] == F.col("own"))[0]
    a = F.try_divide(mine["d"], mine["n"] - 1)
    b = F.array_min(F.transform(F.filter("t", lambda c: c["c"] != F.col("own")), lambda c: c["d"] / c["n"]))
    return got.select(F.when(mine["n"] > 1, F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))).otherwise(0.0).alias("s")).agg(F.avg("s").alias("silhouette"))


def scores(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """One row (accuracy, macro_f1, nmi, ari) of clustering_scores."""
    got = clustering_scores(rows, true, pred)
    return rows.sparkSession.createDataFrame([tuple(float(got[k]) for k in ("accuracy", "macro_f1", "nmi", "ari"))], "accuracy double, macro_f1 double, nmi double, ari double")


def mean_over_communities(measured: DataFrame, column: str, noise: int = -1) -> DataFrame:
    """(mean): a measure's mean over communities that have it, noise left out."""
    return measured.where(F.col("community") != noise).agg(F.avg(column).alias("mean"))


def davies_bouldin(rows: DataFrame, label: str, dim: int) -> DataFrame:
    """(davies_bouldin) over feature arrays: mean over clusters of the worst (spread + spread) / distance of centres."""
    centre = rows.groupBy(label).agg(F.array(*[F.avg(F.col("feature")[k]) for k in range(dim)]).alias("centre"))
    dist = lambda a, b: F.sqrt(sum(((F.col(a)[k] - F.col(b)[k]) * (F.col(a)[k] - F.col(b)[k]) for k in range(dim)), F.lit(0.0)))
    spread = rows.join(F.broadcast(centre), label).groupBy(label).agg(F.avg(dist("feature", "centre")).alias("spread"), F.first("centre").alias("centre"))
    other = spread.select(F.col(label).alias("other"), F.col("spread").alias("spread2"), F.col("centre").alias("centre2"))
    worst = spread.join(F.broadcast(other), F.col(label) != F.col("other")).groupBy(label).agg(F.max((F.col("spread") + F.col("spread2")) / dist("centre", "centre2")).alias("worst"))
    return worst.agg(F.avg("worst").alias("davies_bouldin"))


def run_summary(rows: DataFrame, column: str) -> DataFrame:
    """Mean and population standard deviation of a column."""
    return rows.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def parsed_log(lines: DataFrame) -> DataFrame:
    """(metric, value, std) of log lines such as ``acc: 0.63 (0.01)`` or ``acc 0.63``."""
    found = F.regexp_extract_all("value", F.lit(r"([A-Za-z_]+)\s*[:=]?\s+(-?[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?)(?:\s*\((-?[0-9]+\.?[0-9]*)\))?"), F.lit(0))
    part = r"^([A-Za-z_]+)\s*[:=]?\s+(-?[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?)(?:\s*\((-?[0-9]+\.?[0-9]*)\))?$"
    one = lines.select(F.explode(found).alias("m"))
    return one.select(F.regexp_extract("m", part, 1).alias("metric"), F.regexp_extract("m", part, 2).cast("double").alias("value"), F.expr(f"try_cast(regexp_extract(m, '{part.replace(chr(92), chr(92) * 2)}', 3) as double)").alias("std"))
