"""Shared helpers: written intermediate tables, importability, components."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, with its scheme: spark.checkpoint.dir, or one of our own where a local session has none."""
    sc = spark.sparkContext
    # Workers started later find this package by path when the driver found it that way.
    sc.environment.setdefault("PYTHONPATH", _ROOT)
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    # file:/x and file:///x are one to Hadoop, but not to other readers.
    return re.sub(r"^file:/+", "file:///", whole).rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone when the interpreter exits
        pass


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh folder under shared_dir(), deleted when the driver exits."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that no live plan reads any more."""
    _forget(spark, path)


def stored(df: DataFrame, what: str = "table") -> tuple[DataFrame, str]:
    """materialise() and the folder, for drop_path() when it has been replaced."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, what: str = "table") -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    A written table survives lost executors, and its real size is known to
    the planner, so that joins with it are broadcast only below
    spark.sql.autoBroadcastJoinThreshold.
    """
    return stored(df, what)[0]


def quoted(name: str) -> Column:
    """The column of this very name, dots and quotes in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores added where df has a column of such a name already."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def seeded_hash(seed: int, *cols: Column) -> Column:
    """A 64-bit hash of the columns that depends only on their values and the seed."""
    return F.xxhash64(F.lit(seed), *cols)


def unit(h: Column) -> Column:
    """A 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is its smallest node.

    Randomised contraction: in each round every node joins the neighbour
    (or itself) with the least seeded hash, and the graph of the joined
    nodes is what the next round works on, so that rounds grow with the
    logarithm of the nodes. A hub is only ever aggregated by partial sums
    or met in a sort-merge join, which AQE can split. Raises RuntimeError if max_rounds do
    not empty the graph. Null ends and loops are dropped; no edges give no rows.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    live, at = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(a < b).distinct(), "edges")
    steps: list[DataFrame] = []
    while not live.isEmpty():
        if len(steps) >= max_rounds:
            raise RuntimeError("connected_components: no convergence")
        rank = lambda x, r=len(steps): F.struct(seeded_hash(r, x).alias("h"), x.alias("x"))
        ends = live.select(F.explode(F.array(F.struct(a.alias("u"), b.alias("v")), F.struct(b.alias("u"), a.alias("v")))).alias("e"))
        head = materialise(
            ends.groupBy(F.col("e.u").alias("u")).agg(F.min(rank(F.col("e.v"))).alias("m"))
            .select("u", F.least(F.col("m"), rank(F.col("u")))["x"].alias("to")),
            "head",
        )
        steps.append(head)
        left = head.select(F.col("u").alias("a"), F.col("to").alias("ta"))
        right = head.select(F.col("u").alias("b"), F.col("to").alias("tb"))
        left_edges = at
        live, at = stored(
            live.join(left, "a").select("ta", "b").join(right, "b").where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(),
            "edges",
        )
        drop_path(spark, left_edges)
    if not steps:
        return spark.createDataFrame([], "node long, component long")
    found = steps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for head in steps[1:]:
        found = (
            found.join(head.select(F.col("u").alias("root"), "to"), "root", "left")
            .select("node", F.coalesce("to", "root").alias("root"))
        )
    found = materialise(found, "roots")
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")
