"""Sinks: tables, nested documents and model artifacts."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, *, by: str | None = None, skip_empty: bool = True) -> bool:
    """Header CSV under ``path``; nothing for no rows. ``by`` makes one folder per value, and keeps the column in the files."""
    if skip_empty and df.isEmpty():
        return False
    public = df.select(*[c for c in df.columns if not c.startswith("_")])
    writer = public.write.mode("overwrite").option("header", True)
    if by:
        writer = public.withColumn(f"{by}_folder", F.col(by)).write.mode("overwrite").option("header", True).partitionBy(f"{by}_folder")
    writer.csv(path)
    return True


def write_parquet(df: DataFrame, path: str, *, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row, nested structs kept."""
    df.write.mode("overwrite").json(path)


def write_text(text: str, path: str) -> None:
    """A small document through the session's file system: written aside, then renamed over the old one in one step.

    Readers see the old document or the new one, never a part; ``path`` may lie in any store that Spark writes to.
    """
    jvm, conf = _hadoop()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    target = files.makeQualified(target)
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    stream = files.create(aside, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = SparkSession.getActiveSession().sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(aside, target, options)


def read_text(path: str) -> str:
    jvm, conf = _hadoop()
    source = jvm.org.apache.hadoop.fs.Path(path)
    stream = source.getFileSystem(conf).open(source)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _hadoop():
    context = SparkSession.getActiveSession().sparkContext
    return context._jvm, context._jsc.hadoopConfiguration()


def write_manifest(document: dict, path: str) -> None:
    """A small settings-and-totals document, written by the driver."""
    write_text(json.dumps(document, indent=2, ensure_ascii=False), path)


def read_manifest(path: str) -> dict:
    return json.loads(read_text(path))


def write_bundle(model, path: str, features: list[str], **settings) -> None:
    """A fitted model with the features it takes and the settings (window, step, ...) it was trained under.

    The document comes last, so a bundle that has one is whole.
    """
    model.write().overwrite().save(f"{path}/model")
    write_manifest({"features": features, **settings}, f"{path}/bundle.json")


def read_bundle(path: str, load) -> tuple[object, dict]:
    """(model, document); ``load`` is the loader of the model's class, for example ``PipelineModel.load``."""
    document = read_manifest(f"{path}/bundle.json")
    return load(f"{path}/model"), document


def write_lines(lines: list[str], path: str) -> None:
    write_text("".join(f"{line}\n" for line in lines), path)


def portable_path(path: str, root: str) -> str:
    """Path relative to the output root, with forward slashes."""
    return os.path.relpath(path, root).replace(os.sep, "/")
