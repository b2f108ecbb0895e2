"""Session defaults for tests and the bench, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_local_folder: str | None = None


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session; on a cluster, bring the session you have instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Recording a call site for every column expression dominates wide plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors share one machine, may fall back to a scratch folder.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("launch the session with spark.checkpoint.dir set to a folder shared by all executors")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="plumbline-")
    return _local_folder


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage, survives the loss of executors, fixes anything that is only
    deterministic once computed, and lets later passes prune columns.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: Sequence[tuple | dict | Row], schema: StructType | str) -> DataFrame:
    """A small driver-side table (rules, one row per column) as a local relation.

    Arrow hands it to the optimizer as data, so filters and projections on it fold away
    and no Python worker or extra stage is needed.
    """
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    cells = list(zip(*[tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in rows])) or [()] * len(struct)
    arrow = to_arrow_schema(struct)
    return spark.createDataFrame(
        pa.table([pa.array(list(c), type=f.type) for c, f in zip(cells, arrow)], schema=arrow), struct)
