"""Cutting the lineage of iterative plans, and components of large graphs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Most keys that join_split broadcasts.
HOT_KEYS = 1000
#: Rows that a task of written takes at least, where their number is known.
ROWS_A_FILE = 8192
#: A key that is never treated as hot.
_NO_KEY = -(1 << 62) - 12345


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and the session is local (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wayloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_late(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone by now, and then the cluster's own clean-up has it
        pass


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    rows bounds their number (more for large rows), where it is known: the last stage then has no more tasks, and the table no more files, than one for each ROWS_A_FILE. A file system that is reached through commands starts a few processes for each file.
    The files survive lost executors. They are removed when the driver's Python ends, as lazy results may read them until then; ``.path`` names them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayloom/{name}-{uuid.uuid4().hex}"
    few = df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    few.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove_late, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def join_split(many: DataFrame, one: DataFrame, on: list[str], size: str, total: int, most: str = "true") -> DataFrame:
    """many left-joined with one, whose keys are unique, so that no key makes a task large.

    size names a column of one with the number of rows of many that have the key (or an upper bound), total is their sum. The keys with more than total / HOT_KEYS rows, fewer than HOT_KEYS of them by that, are broadcast, those of them whose payload most (a condition) allows; the rows they reach are dealt by a hash of their own through the shuffle join that serves the others. Key columns are of type long; size is not among the results.
    """
    names = [c for c in one.columns if c not in (*on, size)]
    hot = one.where((F.col(size) > max(total // HOT_KEYS, 1)) & F.expr(most) & (F.col(on[0]) != _NO_KEY))
    by_hand = hot.select(*[F.col(c).alias(f"hot_{c}") for c in (*on, *names)], F.lit(True).alias("hot_there"))
    # a row that leads nowhere keeps the plan the same where no key is hot
    nowhere = one.sparkSession.range(1).select(*[F.lit(_NO_KEY).alias(f"hot_{c}") for c in on], *[F.lit(None).cast(one.schema[c].dataType).alias(f"hot_{c}") for c in names], F.lit(False).alias("hot_there"))
    by_hand = F.broadcast(by_hand.unionByName(nowhere))
    met = many.join(by_hand, [F.col(c) == F.col(f"hot_{c}") for c in on], "left")
    # a reached row, or one without a key, takes part in the shuffle under a key of its own; it takes nothing from there
    alone = F.coalesce("hot_there", F.lit(False)) | F.col(on[0]).isNull()
    own = F.when(alone, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col(on[0]))
    met = met.withColumn("own_key", own)
    rest = one.select(*[F.col(c).alias(f"cold_{c}") for c in (*on, *names)])
    both = met.join(rest, [F.col("own_key") == F.col(f"cold_{on[0]}"), *[F.col(c) == F.col(f"cold_{c}") for c in on[1:]]], "left")
    return both.select(*many.columns, *[F.when(F.col("hot_there"), F.col(f"hot_{c}")).when(F.col(on[0]).isNotNull(), F.col(f"cold_{c}")).alias(c) for c in names])


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them that tells edge sets apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of edges (a, b), at most rows of them if that is known: component is the least node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each a partial aggregate and a join, each written before the next; no edge list ever reaches the driver. Self-loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", rows)
    state = _state(now)
    for _ in range(max_rounds):
        n_edges = state[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_split(both, least, ["u"], "n", 2 * n_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")  # after a large star a node has at most one edge for each of its components' least nodes
        small = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = written(small, "edges", 2 * n_edges)  # a large star has no more edges than before, a small one twice as many at most
        remove(spark, now.path)
        now, before, state = after, state, _state(after)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    # settled: every node points straight at its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def cut(df: DataFrame) -> DataFrame:
    """df from a written table, so that later rounds survive lost executors and plans stay short."""
    return written(df, "cut")
