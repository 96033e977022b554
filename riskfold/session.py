"""Session construction and cluster-facing helpers.

The library never mutates the session it is handed (the driver owns it);
``build_session`` is only for tests, benches and command-line use.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Explicit broadcasts are for tables whose row count is
# fixed by the domain (calendar months, nations, regions, parameter lists), not
# by the volume of the fact tables.  Everything else is left to AQE, which
# switches a sort-merge join to a broadcast join only after it has *measured*
# the real shuffle size of the small side (spark.sql.adaptive.autoBroadcastJoinThreshold).


def build_session(master: str | None = None, app: str = "riskfold",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``.  When nothing is configured, a scratch folder is
    set up for local masters (one machine: every task sees it); on a cluster
    it is an error, as no executor would see the driver's folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="riskfold-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that
    functions given to Spark resolve their module from any working folder."""
    sc = spark.sparkContext
    if getattr(sc, "_riskfold_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="riskfold-pkg-"), "riskfold_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._riskfold_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss) into the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast a join side only behind a check of its size: the side is
    materialised once (reliable checkpoint) and its rows measured as JSON
    text; at more than ``max_bytes`` it stays a shuffle join (AQE still splits
    skewed keys)."""
    from pyspark.sql import functions as F
    df = cut_lineage(df)
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df
