"""Writers: texts and logs as files, audit trails that only grow. All by Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import status


def text_files(df: DataFrame, col: str, path: str) -> None:
    """One text a line record; a failed job leaves the old files."""
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)


def log_csv(log: DataFrame, path: str) -> None:
    rows = status.log_csv(log)
    head = log.sparkSession.createDataFrame([(status.LOG_HEADER,)], "value string").withColumn("entry", F.lit(None).cast(log.schema["entry"].dataType))
    rows.unionByName(head).orderBy(F.col("entry").asc_nulls_first()).select("value").write.mode("overwrite").text(path)


def append_audit(audit: DataFrame, path: str) -> None:
    """Audit rows are added; none is read or written again."""
    audit.write.mode("append").json(path)


def autosave(df: DataFrame, path: str, dirty: bool) -> bool:
    """Writes if anything changed; files appear whole or not at all."""
    if not dirty:
        return False
    df.write.mode("overwrite").parquet(path)
    return True
