"""Session helpers: settings, and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: str = "8", app: str = "sylva", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    written parts must outlive the executor that wrote them.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        folder = current
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def spread(df: DataFrame, *keys) -> DataFrame:
    """Hash partition for steps whose cost is in the work, not in the bytes.

    Adaptive coalescing goes by bytes and would run a few heavy groups in one
    task; a partition number given by the user stays. A grouping on the same
    keys that follows uses this exchange."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def meet(left: DataFrame, right: DataFrame, keys, how: str = "inner", unique: bool = False) -> DataFrame:
    """A join of two sides that both grow with the input, always by an exchange.

    Spark takes an array for one element and a generated row for its source's
    row, so it would send such a side to the driver as a broadcast. A right side
    with ``unique`` keys is hashed within its partitions, so the left is not sorted."""
    return left.join(right.hint("shuffle_hash" if unique else "merge"), keys, how)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it back.

    Unlike ``DataFrame.checkpoint`` this computes the plan once, and the read
    side has file sizes, so later joins pick broadcast or shuffle from facts.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize`` with aggregates observed while the rows are written, so no second pass counts them."""
    seen = Observation()
    out = materialize(df.observe(seen, *[v.alias(k) for k, v in metrics.items()]))
    return out, seen.get
