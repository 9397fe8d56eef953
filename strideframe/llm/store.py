"""Tables kept in the shared folder of the cluster, and small text expressions.

Intermediate results that several steps read are written as Parquet below ``spark.checkpoint.dir``. They survive the
loss of executors, they cut lineage, and readers prune their columns.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in a single local JVM."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="strideframe-shared-")
    context.setCheckpointDir(folder)
    return folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it from there; the files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes Spark's faster ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores behind it as it takes not to be one of ``taken`` (in any case)."""
    used = {column.lower() for column in taken}
    while name.lower() in used:
        name += "_"
    return name


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with its text replaced and, where the column exists, ``n_chars`` counted anew."""
    kind = dict(docs.dtypes)
    changed = docs.withColumn("text", text)
    if "n_chars" in kind:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(kind["n_chars"]))
    return changed
