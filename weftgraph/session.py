"""Sessions, and the package's own code on executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Functions in plans are pickled by name, so workers must be able to import the package even where it is
    not installed.  The archive is served by the driver; no shared path is needed.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = Path(tempfile.mkdtemp(prefix="weftgraph-")).resolve()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves the archive until the end
    path = folder / "weftgraph_code.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(_HERE.rglob("*.py")):
            archive.write(source, source.relative_to(_HERE.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "12g", app: str = "weftgraph", conf: dict[str, str] | None = None) -> SparkSession:
    """A session on one machine, for tests and benchmarks."""
    return (
        SparkSession.builder.config(map=conf or {})
        .master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
