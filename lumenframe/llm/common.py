"""What several corpus operators share: column names, table reads, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the documents table, which stages of a corpus pipeline keep.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores added where a column (in any case) has them already."""
    have, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def utf8_size(text: Column) -> Column:
    """Bytes of the text in UTF-8; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors all see: below spark.checkpoint.dir, which is set only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lumenframe-checkpoints")
    return f"{base}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again: lineage ends there, and a lost executor costs no recomputing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def dealt(df: DataFrame, keys: list[str], text: str, group: str, least: int = 4 << 20, most: int = 16 << 20) -> tuple[DataFrame, int, int]:
    """The rows with a column ``group``: the hashed keys deal them into groups of about as many bytes of text, 4 to 16 MB, the more the larger the table is. And all bytes, and the number of groups.

    Operators that ask the corpus about a row's content group it like this once and send
    messages between groups; Spark reuses the one exchange of texts in each step.
    """
    total = df.agg(F.sum(utf8_size(quoted(text)))).first()[0] or 0
    per_group = min(max(total // 4096, least), most)
    groups = max(1, -(-total // per_group))
    return df.withColumn(group, F.pmod(F.xxhash64(F.lit(17), *[quoted(k) for k in keys]), F.lit(groups))), total, groups
