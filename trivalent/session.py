"""Sessions, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the executors' Python path, unless PYTHONPATH has it already."""
    root = Path(__file__).resolve().parent.parent
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in paths or app in _shipped:
        return
    file = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{Path(__file__).parent.name}.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(Path(__file__).parent.rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(file))
    _shipped.add(app)


def local_session(cores: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, with UTC as its time zone."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship(spark)
    return spark
