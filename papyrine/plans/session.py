"""Session settings and lineage helpers.

``cut_lineage`` uses the reliable checkpoint directory: the one already set, or the one
the cluster names in ``spark.checkpoint.dir``. A session in local mode may name none and
gets a folder of this machine; on a cluster that is an error, since executors share no such folder.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def bound_arrow_batches(spark: SparkSession, rows: int = 1000, mega_bytes: int = 16) -> None:
    """Keep Arrow batches small: documents are long, so rows alone bound nothing."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mega_bytes * 1024 * 1024))


def share_package(spark: SparkSession) -> None:
    """Send this package to all Python workers, once a session; whatever of it is missing on the driver is not sent."""
    sc = spark.sparkContext
    if getattr(sc, "_papyrine_sent", None):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="papyrine-package-")) / "papyrine_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))  # the driver serves it to executors, those that come later too
    sc._papyrine_sent = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only a local session without one gets an own folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="papyrine-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder, so lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
