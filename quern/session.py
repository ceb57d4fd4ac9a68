"""Session helpers: durable intermediate results and table access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def _temporary(prefix: str) -> str:
    """A folder of the driver's that goes when it ends."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        home = Path(__file__).resolve().parent
        out = Path(_temporary("quern-code-"))
        shutil.make_archive(str(out / "quern_package"), "zip", home.parent, home.name)
        spark.sparkContext.addPyFile(str(out / "quern_package.zip"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate results.

    The session's ``spark.checkpoint.dir`` is used where it is set, so on a cluster the
    folder is one that all executors reach. Only where nothing is set and the master is
    ``local`` is a temporary folder made.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if wanted is None:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        wanted = _temporary("quern-")
    sc.setCheckpointDir(wanted)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, its lineage cut; survives lost executors."""
    ship(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
