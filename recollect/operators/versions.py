"""Numbered manifests of a folder: small JSON files, each written whole under the next number, so that a reader keeps to one version and of two writers one wins."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has made the next version meanwhile: open it and repeat the change."""


def located(spark: SparkSession, path: str):
    """(file system, path) of a folder or file, wherever it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none where there is no folder."""
    fs, place = located(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, place = located(spark, path)
    fs.delete(place, True)


def newest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """(number, content) of the newest manifest; 0 and None where there is none."""
    numbers = [int(n[:-5]) for n in listed(spark, f"{path}/manifest") if re.fullmatch(r"\d+\.json", n)]
    if not numbers:
        return 0, None
    fs, place = located(spark, f"{path}/manifest/{max(numbers)}.json")
    stream = fs.open(place)
    try:
        return max(numbers), json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def put(spark: SparkSession, path: str, version: int, live: dict) -> int:
    """Writes live as the version after version, if nobody else has; its number."""
    fs, place = located(spark, f"{path}/manifest/{version + 1}.json")
    part = located(spark, f"{path}/manifest/.{uuid.uuid4().hex}")[1]
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(live).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(part, place):
        fs.delete(part, False)
        raise Conflict(f"{path} has a version {version + 1} already")
    return version + 1


def forget(spark: SparkSession, path: str, version: int) -> None:
    """Removes the manifests but that of version."""
    for n in listed(spark, f"{path}/manifest"):
        if n != f"{version}.json":
            remove(spark, f"{path}/manifest/{n}")
