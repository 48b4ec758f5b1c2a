"""Column and storage helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# The white space of every word and line rule.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def col(name: str) -> Column:
    """The column of exactly this name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_struct(df: DataFrame) -> Column:
    """The whole input row as one struct, so its columns never clash with an operator's."""
    return F.struct(*[col(c).alias(c) for c in df.columns])


def unpack(df: DataFrame, struct: str, names: list[str]) -> list[Column]:
    """The columns packed by :func:`row_struct`, under their own names."""
    return [F.col(struct).getField(n).alias(n) for n in names]


def text_of(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/touchline-llm/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the session's shared checkpoint folder and read it back:
    the lineage ends there, and the data outlives any executor."""
    spark: SparkSession = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}/{name}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def shuffle_tasks(spark: SparkSession, default: int = 200) -> int:
    """The number of shuffle partitions; ``default`` where the platform sets a word instead."""
    n = spark.conf.get("spark.sql.shuffle.partitions")
    return int(n) if n.isdigit() else default


def least_by_hash(df: DataFrame, id_col: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those whose ids have the least hashes: the same ones in every run.
    A threshold on the hash first thins the rows to about twice the limit, so that what meets
    in the last task doesn't grow with the table or its partitions."""
    n, cells = df.count(), 1 << 40
    lot = F.xxhash64(col(id_col))
    if n > 2 * limit:
        df = df.filter(F.pmod(lot, F.lit(cells)) < int(cells * (2 * limit / n)))
    return df.orderBy(F.pmod(lot, F.lit(cells)), lot, col(id_col)).limit(limit)


def with_package(spark: SparkSession) -> None:
    """Put this package's folder on the Python workers' path, which they otherwise get from
    the installation or the session's files."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in known:
        env["PYTHONPATH"] = ":".join([*known, root])


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with this package's folder on the Python workers' path."""
    with_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def drop_stored(spark: SparkSession) -> None:
    """Delete all tables that :func:`stored` has left in the shared folder for this application;
    for its end, when no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
