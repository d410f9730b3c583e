"""Session start-up and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "papyrion", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; ``conf`` wins over the defaults below."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, where it is not installed on them: Python workers import it by name."""
    own = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="papyrion-")) / "papyrion.zip"
    with zipfile.ZipFile(packed, "w") as file:
        for p in sorted(own.rglob("*.py")):
            file.write(p, Path("papyrion") / p.relative_to(own))
    spark.addArtifact(str(packed), pyfile=True) if hasattr(spark, "_client") else spark.sparkContext.addPyFile(str(packed))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a local master, where driver and executors are one machine, may fall
    back to a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="papyrion-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


#: The folders that the running block of work stages in; a thread of its own (such as that of a micro-batch) begins outside of any.
_scratch: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


def staging_path(spark: SparkSession, name: str) -> str:
    return "/".join([shared_dir(spark), "papyrion", *_scratch.get(), f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is staged inside is deleted in the end, but for what is staged with the function that this gives."""
    outer = _scratch.get()
    inner = (*outer, f"scratch-{uuid.uuid4().hex}")
    token = _scratch.set(inner)

    def keep(df: DataFrame, name: str) -> DataFrame:
        return stage(df, name, path="/".join([shared_dir(spark), "papyrion", *outer, f"{name}-{uuid.uuid4().hex}"]))

    try:
        yield keep
    finally:
        _scratch.reset(token)
        _delete(spark, "/".join([shared_dir(spark), "papyrion", *inner]))


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None, path: str | None = None, group: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The written table survives the loss of any executor, and a second use reads
    it instead of computing it again. With ``group``, a row group has so many rows at most, for rows of megabytes: Spark
    would hold 100 of them to write, and read 4096 at once.
    """
    spark = df.sparkSession
    path = path or staging_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if group:
        writer = writer.option("parquet.block.row.count.limit", group)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every table staged in the shared folder; call it when no query runs."""
    _delete(spark, f"{shared_dir(spark)}/papyrion")
