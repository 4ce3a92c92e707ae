"""Small files next to tables, through the file system that Spark itself uses for a path."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """The name was taken by someone else in the meantime."""


def _handle(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    system, target = _handle(spark, folder)
    return sorted(f.getPath().getName() for f in system.listStatus(target)) if system.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    system, target = _handle(spark, path)
    system.delete(target, True)


def read_json(spark: SparkSession, path: str) -> dict:
    system, target = _handle(spark, path)
    stream = system.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit_json(spark: SparkSession, path: str, content: dict) -> None:
    """Write a new file that others see whole or not at all: it is written under another name and renamed.

    Fails with ``Taken`` if the name exists, so of two writers one wins and the other knows.
    """
    folder, _, name = path.rpartition("/")
    written = f"{folder}/.{name}.{uuid.uuid4().hex}"
    system, source = _handle(spark, written)
    stream = system.create(source, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    rename = getattr(fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE  # do not replace
    target = fs.Path(path)
    try:
        fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, options)
    except Exception as error:
        system.delete(source, False)
        if "FileAlreadyExistsException" in str(error):
            raise Taken(path) from error
        raise
