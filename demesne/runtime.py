"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Copies of the unique side in a salted join; a key holding a third of all rows
#: is spread over this many tasks (and adaptive execution splits what is left).
#: Every copy is shuffled, so few are made.
SALTS = 4
#: A key with more than one in ``HOT`` of a side's rows is cut into blocks; so at most ``HOT`` keys a side are hot.
HOT = 500
#: Keys of fewer rows are never cut.
HOT_LEAST = 2_000


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("demesne")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return
    master = sc.master or ""
    if not (master.startswith("local[") or master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="demesne-checkpoint-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(own)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    A checkpoint keeps the planner's estimate of its size.  In a loop of joins
    the estimate is squared every round, and after some thirty rounds its digits
    alone fill the memory; so the rows are taken over without it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    try:
        rows = done._jdf.queryExecution().toRdd()
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)
    except (AttributeError, Py4JError, TypeError):
        return done


def release(spark: SparkSession) -> None:
    """Have the files of shuffles removed that nothing refers to any more; Spark does so only when the driver collects its garbage."""
    gc.collect()
    try:
        spark.sparkContext._jvm.System.gc()
    except (AttributeError, Py4JError):
        return


def spread(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Hash-distribute rows ahead of heavy per-row work (few input splits, many cores).

    Distributed by a hash of the columns, not by the columns: rows that an
    aggregate or join left partitioned by them would otherwise count as placed,
    and adaptive execution would merge them by bytes into few tasks.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, F.xxhash64(*cols))


def hot_join(left: DataFrame, right: DataFrame, on: list[str], least: int = HOT_LEAST) -> DataFrame:
    """Inner many-to-many join with hot keys cut into blocks.

    A key holding more than one in ``HOT`` of a side's rows (and ``least``) has
    its rows of that side dealt over blocks of that size by a hash of their
    content, and every row of the other side meets each block.  At most ``HOT``
    keys of a side can be that frequent, so their list is broadcast.  Both sides
    are read twice: pass materialised tables.
    """
    def hot(df: DataFrame, n: str) -> DataFrame:
        per = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
        # one row
        whole = F.broadcast(per.agg(F.sum("__n").alias("__all")))
        size = F.greatest(F.col("__all") / HOT, F.lit(float(least)))
        return per.where(F.col("__n") > least).join(whole, F.col("__n") > size).select(*on, F.ceil(F.col("__n") / size).cast("int").alias(n))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        for n, side in (("__nl", left), ("__nr", right)):
            # bounded: at most HOT rows
            df = df.join(F.broadcast(hot(side, n)), on, "left").withColumn(n, F.coalesce(n, F.lit(1)))
        mine = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col(own)).cast("int")
        out = df.withColumn(own.replace("n", "b"), mine).withColumn(other.replace("n", "b"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return out.drop("__nl", "__nr")

    return dealt(left, "__nl", "__nr").join(dealt(right, "__nr", "__nl"), [*on, "__bl", "__br"]).drop("__bl", "__br")


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join a large side to a side whose ``on`` columns are unique, safe for hot keys.

    The left row gets a salt from its own content, the right row one copy a
    salt, so a key that holds a third of the left side is spread over ``salts``
    tasks.  Nothing is broadcast.  ``how`` is ``inner`` or ``left``.
    """
    salt = "__salt"
    spice = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    salted = left.withColumn(salt, spice)
    copies = right.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies, [*on, salt], how).drop(salt)


def ws_trim(c: Column) -> Column:
    """Trim every kind of white space (``trim`` alone leaves tabs and line ends)."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
