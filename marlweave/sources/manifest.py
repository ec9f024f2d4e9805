"""Numbered manifests in a folder: a version exists once its manifest does."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

NAME = "manifest-{:012d}.json"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a function that makes its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def commit(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Publishes version ``number`` by renaming a finished file; raises if that version is there already."""
    fs, path = file_system(spark, folder)
    fs.mkdirs(path(folder))
    target, temporary = path(f"{folder}/{NAME.format(number)}"), path(f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(temporary, target):
        fs.delete(temporary, False)
        raise RuntimeError(f"version {number} of {folder} was published by someone else")


def latest(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The highest version and its manifest; None where nothing was published."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path(folder)):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
    numbers = sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))
    if not numbers:
        return None
    stream = fs.open(path(f"{folder}/{NAME.format(numbers[-1])}"))
    try:
        return numbers[-1], json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def remove(spark: SparkSession, where: str) -> None:
    fs, path = file_system(spark, where)
    fs.delete(path(where), True)
