"""Stored versions of a table that changes as a whole.

Each version is a Parquet folder of its own, and a manifest that names it::

    data-<uuid>/part-…parquet
    manifest/<version>.json

A version exists once its manifest does. The manifest is created only if it is
absent, so of two writers that built on the same version one commits and the
other builds again on the newer one: no change is lost. A reader takes the
folder that one manifest names and is not touched by later versions.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

RETRIES = 20


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all versions, from 0."""
    system, place = _files(spark, f"{root}/manifest")
    if not system.exists(place):
        return []
    names = [s.getPath().getName() for s in system.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it is there; whether it was written."""
    system, place = _files(spark, path)
    if system.getScheme() == "file":
        # A link to a whole file: there at once or not at all, also for two writers.
        target = unquote(urlparse(place.toUri().toString()).path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        draft = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    try:
        out = system.create(place, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return True


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    rows = spark.read.text(f"{root}/manifest/{version}.json", wholetext=True).collect()  # one small file
    return json.loads(rows[0][0])


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table of one version (the latest if none is given); it stays the same however many follow."""
    if version is None:
        found = versions(spark, root)
        if not found:
            raise FileNotFoundError(f"no version below {root}")
        version = found[-1]
    return spark.read.parquet(f"{root}/{manifest(spark, root, version)['data']}")


def publish(spark: SparkSession, root: str, build: Callable[[DataFrame | None], DataFrame], retries: int = RETRIES) -> int:
    """Commit ``build(latest version)`` (None before the first) as the next version; its number.

    ``build`` runs again, on the newer version, when another writer was first.
    """
    for _ in range(retries):
        found = versions(spark, root)
        base = found[-1] if found else -1
        folder = f"data-{uuid.uuid4().hex}"
        build(read_version(spark, root, base) if found else None).write.parquet(f"{root}/{folder}")
        if _create_if_absent(spark, f"{root}/manifest/{base + 1}.json", json.dumps({"version": base + 1, "base": base, "data": folder})):
            return base + 1
    raise RuntimeError("other writers were first every time")
