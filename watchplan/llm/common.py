"""What the operators share: tables, a shared workspace, size-checked broadcasts, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of narrow rows with fewer bytes than this (an estimate from a row count) may be broadcast.  The driver builds each as a hash table of
#: three to five times that, several at once, and keeps old ones until they are cleaned.
BROADCAST_BYTES = 4 << 20
#: The same for the one side of a join whose other side would be shuffled with its texts.
TEXT_JOIN_BYTES = 16 << 20
#: Rows of a few numbers that one task may write.
TASK_ROWS = 250_000
#: Bytes of an Arrow batch where the session sets no bound: documents vary too much in length for a bound in rows.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """A folder of this call's own under spark.checkpoint.dir, which all executors share.

    Where the session names none, a local master (all on one machine) gets a temporary folder; elsewhere it is an
    error, as executors would write where others can't read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="watchplan-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/watchplan-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the cluster's own clean-up takes the folder
        pass


def written(df: DataFrame, folder: str, name: str, rows: int | None = None) -> DataFrame:
    """df as a written table in the shared folder: later reads neither recompute it nor depend on an executor.

    rows: a bound of its rows, narrow ones, if there is one: then it gets a file for each TASK_ROWS of them at most, not one
    for each shuffle partition.
    """
    path = f"{folder}/{name}"
    df = df if rows is None else df.coalesce(max(1, -(-rows // TASK_ROWS)))
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, rows: int | None = None, most: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows fit `most` bytes (BROADCAST_BYTES), else with one for a sorted, shuffled join.

    Left to itself Spark goes by a table's compressed files, of which a few MB can be millions of rows.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= (BROADCAST_BYTES if most is None else most) else df.hint("merge")


#: Groups of more rows than this are known everywhere instead of being gathered by their key.
HEAVY_ROWS = 2_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, row_bytes: int, how: str = "inner") -> DataFrame:
    """rows joined to groups (one row for each key, `_n` its number of rows), without `_n`; how: inner or left.

    Groups are broadcast if they are few.  If not, rows of a large group meet it in a broadcast join (there are at most rows / HEAVY_ROWS such groups, and their size is checked), so
    that no task gets them all; the others are shuffled by key, which holds few of them each.
    """
    groups = groups.withColumnRenamed(key, "_key")
    on = F.col(key) == F.col("_key")
    count = groups.agg(F.count(F.lit(1)), F.count_if(F.col("_n") > HEAVY_ROWS)).first()
    if count[0] * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups.drop("_n")), on, how).drop("_key")
    heavy, n = groups.where(F.col("_n") > HEAVY_ROWS), count[1]
    light = groups.where(F.col("_n") <= HEAVY_ROWS).drop("_n")
    if n == 0:
        return rows.join(light.hint("merge"), on, how).drop("_key")
    known = broadcast_if_small(heavy.drop("_n"), row_bytes, n)
    first = rows.join(known, on).drop("_key")
    rest = rows.join(known.select("_key"), on, "left_anti")
    return first.unionByName(rest.join(light.hint("merge"), on, how).drop("_key"))


def bound_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at once by bytes, unless the session has its own bound.

    It changes the session, so queries and pipeline stages call it, not the operators: a user of those sets
    spark.sql.execution.arrow.maxBytesPerBatch to their own liking.
    """
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty; further columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def forest_roots(parents: DataFrame, folder: str, name: str, most_rounds: int = 60) -> DataFrame:
    """Of parents (node, parent), one smaller parent a node: (node, root) for each node.

    Every round doubles how far each node looks up: the logarithm of the depth, one join each.
    """
    state = written(parents.select("node", F.col("parent").alias("root")), folder, f"{name}-0")
    n = state.count()
    for k in range(1, most_rounds + 1):
        up = broadcast_if_small(state.select(F.col("node").alias("root"), F.col("root").alias("_up")), 32, n)
        state = written(state.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), folder, f"{name}-{k}", n)
        moved, state = state.where("_moved").isEmpty(), state.drop("_moved")
        if moved:
            return state
    raise RuntimeError(f"roots have not settled after {most_rounds} rounds")


def components(edges: DataFrame, folder: str, name: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): a row (node, root) for each node but the roots, root the smallest node.

    Rounds grow with the logarithm of the longest path, twice; should most_rounds not be enough, it is an error.
    Alternating large-star and small-star rounds: each is a pre-aggregated minimum per node and one
    join, a broadcast one while the nodes are few, else one whose skewed keys AQE can split; a round's edges are a
    written table, so lineage stays short.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, before = written(e, folder, f"{name}-0"), None
    n = e.count()
    for k in range(1, most_rounds + 1 if n else 1):
        # the tables of a round's steps are written, so that AQE can split a join where one node has a great part of all edges; where there are
        # few enough edges that all joins are broadcast ones, a round is one job
        step = (lambda df, *_: df) if 2 * n * 32 <= BROADCAST_BYTES else written
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = step(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), folder, f"{name}-{k}-low", 2 * n)
        large = both.where("v > u").join(broadcast_if_small(low, 32, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = step(large, folder, f"{name}-{k}-large", n)
        low = step(large.groupBy("u").agg(F.min("v").alias("m")), folder, f"{name}-{k}-low2", n)
        small = large.join(broadcast_if_small(low, 32, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), folder, f"{name}-{k}", 2 * n)
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
        if now == before or now[0] == 0:
            break
        before, n = now, max(n, now[0])
    else:
        if n:
            raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
