"""Tables cut out of a job's lineage (see :mod:`tessera.plans.tables`), and the size of what tasks hand to Python."""

from pyspark.sql import SparkSession

from tessera.plans.tables import cut, discard, new_path, shared_dir, small_table

__all__ = ["bound_batches", "cut", "discard", "new_path", "shared_dir", "small_table"]

_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Rows with whole texts go to Python workers in batches of about ``most`` bytes: sets the session's bound if it is larger."""
    now = spark.conf.get(_BYTES, "64m").lower().strip()
    unit = {"k": 10, "m": 20, "g": 30}.get(now.rstrip("b")[-1:], 0)
    size = int(now.rstrip("bkmg") or 0) << unit
    if not 0 < size <= most:
        spark.conf.set(_BYTES, f"{most}b")
