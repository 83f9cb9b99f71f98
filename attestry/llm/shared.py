"""What the operators share: column names, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.sources.tables import remover, shared_dir


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of df has (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str):
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


MADE: list[str] = []  # folders of this driver in the shared one, the oldest first


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends, after
    spark.stop() too, or by drop."""
    folder = f"{shared_dir(spark).rstrip('/')}/attestry-{uuid.uuid4().hex}"
    MADE.append(folder)
    atexit.register(remover(spark, folder))
    return f"{folder}/{name}"


def drop(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Removes what was made since (a length of MADE) but the table keep: what it was made
    from is not needed any more."""
    kept = {x.rpartition("/")[0].rpartition("/")[0].rpartition(":")[2].lstrip("/") for x in keep.inputFiles()}
    for folder in MADE[since:]:
        if folder.rpartition(":")[2].lstrip("/") not in kept:
            remover(spark, folder)()
            MADE.remove(folder)


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends here,
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def total_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(col(column))), F.lit(0)).alias("n")).collect()[0][0]
