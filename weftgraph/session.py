"""What a Spark session needs before it runs this package's Python functions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that a Python worker is sent at once where the session has Spark's default of 10,000: texts may be long.
BATCH_ROWS = 2_000
_PACKED = "spark.sql.sources.fileCompressionFactor"
#: How many times its files' size a table is taken to have where the session has Spark's default of 1: keys and URLs pack so well that
#: millions of them lie in 10 MB of Parquet, and a join would send them all through the driver.
PACKED_BY = 10.0


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each application, and bound what a worker is sent at once and what is broadcast."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if spark.conf.get(_PACKED) == "1.0":
        spark.conf.set(_PACKED, str(PACKED_BY))
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="weftgraph-")) / "weftgraph.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    return spark
