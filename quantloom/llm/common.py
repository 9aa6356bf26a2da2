"""What several operators share: inputs, lineage cuts, words, and components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words (fixed value of the contracts).
SPACES = r"[\x20\x09-\x0D]+"

#: Rows handed to a Python worker at once; keeps a batch of long texts small.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds: long texts in batches of 10,000 would not fit.

    The session's setting stays lowered, since results are computed after the call; a
    smaller one is left as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it from there.

    The folder is the one the session names in ``spark.checkpoint.dir``. Where it names
    none, a folder of our own is set in local mode, as in tests; on a cluster, whose
    executors would not see it, that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quantloom-checkpoints-"))
    return df.checkpoint()


#: Rows to a task where rows are a few numbers each, and tasks at least.
SLIM_ROWS, SLIM_TASKS = 50_000, 8


def slim(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have about ``rows`` short rows, in as many tasks as these are worth.

    What follows a shuffle of few rows else runs in (and leaves files of) as many tasks as
    the largest shuffle needs. The number grows with the rows; it never merges partitions
    of a large table.
    """
    return df.coalesce(max(SLIM_TASKS, -(-rows // SLIM_ROWS)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        made = f"_{name}"
        while made.lower() in taken:
            made = f"_{made}"
        taken.add(made.lower())
        out.append(made)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Inside a lambda Spark would otherwise inline the expression and evaluate it again
    for every element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, null as none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: ``id``, ``component_id`` (smallest id).

    Alternating large-star and small-star rounds; a round is two aggregations that
    combine before the shuffle and two joins, whatever the size of a component. Only a
    count and a checksum reach the driver. Null ends and loops are left out; vertices
    without an edge are not returned.
    """
    e = cut(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = state(e)
    rows = seen[0]
    while rows:
        e = slim(e, rows)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = slim(slim(large, rows).distinct(), rows)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = slim(small, rows).unionByName(slim(low.select("u", F.col("m").alias("v")), rows)).distinct()
        e = cut(slim(small, rows))
        now = state(e)
        if now == seen:
            break
        seen = now
    low = e.groupBy("v").agg(F.lit(1))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        low.select(F.col("v").alias("id"), F.col("v").alias("component_id"))
    )
