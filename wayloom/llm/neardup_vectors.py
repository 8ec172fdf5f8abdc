"""Near-duplicate vectors by cosine, with equal labels, by PCA-ordered tiled comparison.

Equal vectors of a label are one class. The classes of a label and length are ordered by their coordinate on the first principal axis, in slabs; vectors whose slabs lie further apart than two vectors at the threshold can are never compared. A slab is dealt by hash into chunks of bounded size, and each pair of chunks of near slabs is one task's tile. There the unit vectors are rotated to the principal axes of all vectors, so that the leading coordinates hold most of the length; dot products accumulate over a few axes at a time, and the norms of what is left bound the rest: pairs that cannot reach the threshold any more are dropped and the comparison stops when none is left. What remains is decided by the cosine of the original vectors in double precision. A tile returns a count of links for each vector and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import connected_components, join_split, remove, written
from wayloom.llm.minhash import _forest

#: Classes of a chunk on average, and the axes after which each step of a tile ends.
CHUNK = 512
STEPS = (8, 16, 32)
#: Slabs that the greatest distance of two linked unit vectors spans.
SLABS = 4
#: Room for rounding in the bounds; what is nearer than this is decided in double precision.
SLACK = 1e-4
#: A code is _SLAB times the slab, plus the chunk.
_SLAB = 1 << 32


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: count and the sum of outer products of unit vectors (dimension 0: none seen)."""
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            v = _matrix(batch.column(0))
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            total, n = (v.T @ v) + (0 if total is None else total), n + len(v)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["n", "total"])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """dim x dim rotation to the principal axes of all vectors, greatest first. The driver gets dim^2 sums for each task, added up in Spark by the entry."""
    sums = vectors.select("v").mapInArrow(_moments, "n long, total array<double>")
    rows = sums.select(F.posexplode("total").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros(dim * dim)
    total[rows["k"].to_numpy(int)] = rows["x"].to_numpy()
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1].copy()


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of a and b whose cosine is at least threshold; of one tile with itself those with i < j. axes is a rotation; None leaves the axes as they are."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ua, ub = ((x / n[:, None] if axes is None else x / n[:, None] @ axes).astype(np.float32) for x, n in ((a, na), (b, nb)))
    rest_a, rest_b = (np.sqrt(np.maximum(np.cumsum(np.square(u)[:, ::-1], axis=1)[:, ::-1], 0)) for u in (ua, ub))
    dim, dot, at = ua.shape[1], np.zeros((len(ua), len(ub)), np.float32), 0
    floor = threshold - SLACK
    i = j = None
    for end in [*(s for s in STEPS if s < dim), dim]:
        if i is None:
            dot += ua[:, at:end] @ ub[:, at:end].T
            alive = dot + np.outer(rest_a[:, end], rest_b[:, end]) >= floor if end < dim else dot >= floor
            if same and end >= min(STEPS[0], dim):
                alive = np.triu(alive, 1)
            if end == dim or np.count_nonzero(alive) * 16 < alive.size:
                i, j = np.nonzero(alive)
                part = dot[i, j]
        elif len(i):
            part = part + np.einsum("ij,ij->i", ua[i, at:end], ub[j, at:end])
            alive = part + (rest_a[i, end] * rest_b[j, end] if end < dim else 0) >= floor
            i, j, part = i[alive], j[alive], part[alive]
        at = end
    if not len(i):
        return i, j
    keep = []
    for k in range(0, len(i), 200_000):
        p, q = i[k : k + 200_000], j[k : k + 200_000]
        keep.append(np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q]) >= threshold)
    keep = np.concatenate(keep)
    return i[keep], j[keep]


def _tiles(axes: np.ndarray, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, doc, n = (table.column(c).to_numpy() for c in ("side", "rep", "n"))
        v = _matrix(table.column("v").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float32())))
        turn = axes if v.shape[1] == len(axes) else None
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        one, two = (np.arange(len(doc)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links, ones, twos = np.zeros(len(doc), np.int64), [], []
        for p in range(0, len(one), 2048):
            for q in range(p if same else 0, len(two), 2048):
                x, y = one[p : p + 2048], two[q : q + 2048]
                i, j = tile_links(v[x], v[y], turn, threshold, same and p == q)
                i, j = x[i], y[j]
                links += np.bincount(i, weights=n[j], minlength=len(doc)).astype(np.int64) + np.bincount(j, weights=n[i], minlength=len(doc)).astype(np.int64)
                ones.append(i), twos.append(j)
        ones, twos = np.concatenate(ones or [np.zeros(0, int)]), np.concatenate(twos or [np.zeros(0, int)])
        keep = _forest({}, doc[ones], doc[twos])
        some = np.flatnonzero(links)
        return pa.table({
            "rep": pa.array(np.concatenate([doc[some], doc[ones[keep]]]), pa.int64()),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(keep), np.int64)]), pa.int64()),
            "other": pa.array([None] * len(some) + doc[twos[keep]].tolist(), pa.int64()),
        })

    return run


def _placed(classes: DataFrame, axes: np.ndarray, threshold: float, chunk: int) -> tuple[DataFrame, DataFrame]:
    """classes with code (slab and chunk) and codes (those of the chunks to meet); and the number of classes and chunks of each slab."""
    width = (math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-5) / SLABS
    direction = F.array(*[F.lit(float(x)) for x in axes[:, 0]])
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, y: t + y)
    v = F.transform("v", lambda x: x.cast("double"))
    along = F.when(F.size("v") == len(axes), total(F.zip_with(v, direction, lambda x, y: x * y))).otherwise(v[0])
    slab = F.floor(along / F.sqrt(total(F.transform(v, lambda x: x * x))) / width).cast("long")
    keyed = classes.select("*", F.col("label").cast("long").alias("of"), F.size("v").cast("long").alias("dim"), slab.alias("slab"))
    sizes = keyed.groupBy("of", "dim", "slab").agg(F.count("*").alias("n"), F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))
    beside = sizes.select("of", "dim", "slab", F.explode(F.sequence(F.col("slab") - SLABS - 1, F.col("slab") + SLABS + 1)).alias("near"))
    beside = beside.join(sizes.select("of", "dim", F.col("slab").alias("near"), F.col("chunks").alias("theirs")), ["of", "dim", "near"])
    codes = F.flatten(F.transform(F.collect_list(F.struct("near", "theirs")), lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["theirs"] - 1), lambda c: x["near"] * _SLAB + c)))
    one = beside.groupBy("of", "dim", "slab").agg(codes.alias("codes")).join(sizes, ["of", "dim", "slab"])
    placed = join_split(keyed, one, ["of", "dim", "slab"], "n", classes.count())
    return placed.withColumn("code", F.col("slab") * _SLAB + F.pmod(F.xxhash64("rep"), F.col("chunks"))), sizes


def compared_share(classes: DataFrame, axes: np.ndarray, threshold: float, chunk: int = CHUNK) -> float:
    """Share of the pairs of classes of a label and length that lie in slabs near enough to be compared."""
    rows = classes.withColumn("rep", F.monotonically_increasing_id())
    sizes = _placed(rows, axes, threshold, chunk)[1]
    other = sizes.select("of", "dim", F.col("slab").alias("near"), F.col("n").alias("m"))
    met = sizes.select("of", "dim", "n", F.explode(F.sequence(F.col("slab") - SLABS - 1, F.col("slab") + SLABS + 1)).alias("near")).join(other, ["of", "dim", "near"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    every = sizes.groupBy("of", "dim").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    return float(met or 0) / float(every or 1)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, chunk: int = CHUNK) -> DataFrame:
    """One row per row of vectors (vec_id long, embedding array<float>, label int): vec_id, n_links, component_id, kept.

    Two rows link if their labels are equal and not null, their vectors have the same length and their cosine in double precision is at least threshold. n_links counts the other rows linked directly; component_id is the least vec_id reachable, the own one included; kept is vec_id = component_id.
    A vector that is null, empty, zero, or holds a null or non-finite component links with nothing; so does one with a null label or vec_id (its component_id is its vec_id). Rows that repeat a vec_id each have their own links, and those of them that may link share a component. Other columns are ignored; an empty table returns no row.
    Rows find their class by two 64-bit hashes of label and vector.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"))
    good = "vec_id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    keyed = rows.withColumn("fit", F.coalesce(F.expr(good), F.lit(False)))
    # -0.0 and 0.0 differ in bytes but not in direction; adding 0 makes them one
    keyed = keyed.withColumn("v", F.when(F.col("fit"), F.transform("v", lambda x: x + F.lit(0.0).cast("float"))))
    keyed = keyed.withColumn("h1", F.when(F.col("fit"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("fit"), F.xxhash64("v", "label", F.lit(1))))
    fit = keyed.where("fit")
    # a class's number is rep from here on
    classes = written(fit.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("h1").alias("h1"), F.first("h2").alias("h2")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    common = classes.groupBy(F.size("v").alias("dim")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes = principal_axes(classes.where(F.size("v") == common["dim"]), common["dim"])
    placed, _ = _placed(classes, axes, threshold, chunk)
    placed = placed.select("of", "dim", "code", F.explode("codes").alias("other"), "rep", "n", "v")
    tiles = placed.select("of", "dim", F.least("code", "other").alias("i"), F.greatest("code", "other").alias("j"), (F.col("code") > F.col("other")).cast("int").alias("side"), "rep", "n", "v")
    found = written(tiles.groupBy("of", "dim", "i", "j").applyInArrow(_tiles(axes, threshold), "rep long, links long, other long"), "links")
    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")).unionByName(_same_vectors(fit, classes))
    parts = written(connected_components(edges), "parts")
    own = classes.select("h1", "h2", "rep", "n", "least").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = own.groupBy("component").agg(F.count("*").alias("classes"), F.min("least").alias("component_id"))
    n_classes, n_rows = classes.agg(F.count("*"), F.sum("n")).first()
    own = own.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n") - 1).select("h1", "h2", "n", "n_links", "component")
    state = written(join_split(own, least, ["component"], "classes", n_classes).drop("component"), "state")
    for table in (classes, found, parts):
        remove(vectors.sparkSession, table.path)
    joined = join_split(keyed.select("vec_id", "h1", "h2"), state, ["h1", "h2"], "n", n_rows)
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _same_vectors(fit: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that rows with the same vec_id belong to; none, as a rule."""
    again = fit.groupBy("vec_id").agg(F.min("h1").alias("p"), F.max("h1").alias("q")).where("p <> q").select("vec_id")
    rows = fit.select("vec_id", "h1", "h2").join(again, "vec_id").distinct().join(classes.select("h1", "h2", "rep"), ["h1", "h2"])
    return rows.join(rows.groupBy("vec_id").agg(F.min("rep").alias("b")), "vec_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
