"""Session-level helpers: checkpoints in the shared folder and size-checked broadcasts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; the count is taken before the hint is given.
BROADCAST_ROWS = 200_000
#: Bytes up to which it may be.
BROADCAST_BYTES = 64 << 20
_shipped: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: the configured shared one. Only a session on one machine may go without; it gets a temporary one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="silvara-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once as a table in the shared checkpoint folder and read it back.

    Unlike a local checkpoint it survives the loss of executors, and unlike a plain one it is columnar and computed once.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/silvara-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._silvara_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more, such as the last round's of a loop. Others are passed over."""
    for df in tables:
        path = getattr(df, "_silvara_path", None)
        if path:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
            df._silvara_path = None


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if ``df`` has at most ``limit`` rows and about ``most_bytes``; beyond that the planner shuffles.

    The probe reads at most ``limit + 1`` rows and adds up the lengths of texts, arrays and the like as written in JSON.
    """
    wide = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide])))), F.lit(0)) if wide else F.lit(0)
    n, texts = df.limit(limit + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if n <= limit and texts + 8 * n * len(df.columns) <= most_bytes else df


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (all if it has fewer), at most a fifth more: those whose hashed key is small.

    The same rows at every run and layout. Only the chosen rows leave their partitions.
    """
    n = df.count()
    if n <= rows:
        return df
    share = F.shiftrightunsigned(F.xxhash64(key), 33) < F.lit(int(rows / n * 2**31))
    return df.where(share).limit(rows + rows // 5)


def ship(df: DataFrame) -> DataFrame:
    """Make this package importable in the Python workers of all executors; returns ``df``. Done once for a session."""
    sc = df.sparkSession.sparkContext
    if _shipped.get("app") != sc.applicationId:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="silvara-code-")
        archive = shutil.make_archive(f"{folder}/silvara-code", "zip", package.parent, package.name)
        sc.addPyFile(archive)
        _shipped["app"] = sc.applicationId
    return df
