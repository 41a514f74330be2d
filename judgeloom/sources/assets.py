"""Assets by name, and archives unpacked without leaving their folder.

Nothing is fetched here: an asset is looked up, a given archive is unpacked, on
the driver."""

from __future__ import annotations

import os
import shutil
import zipfile
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSET = "name string, repo string, revision string, type string, path string"


def wanted(manifest: Mapping[str, Mapping[str, str]], names: Iterable[str]) -> list[tuple[str, str, str, str, str]]:
    """The assets of these names, each once, in order; an unknown one is an
    error.  Rows have the fields of ``ASSET``."""
    out = []
    for name in dict.fromkeys(names):
        if name not in manifest:
            raise KeyError(f"Unknown asset: {name}")
        asset = manifest[name]
        out.append((name, asset["repo"], asset["revision"], asset.get("type", "model"), asset["path"]))
    return out


def asset_table(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """``wanted`` for tables: manifest(name, repo, revision, type, path) and
    names(position, name), names once, by their first position.  A name that
    the manifest lacks fails when it is read."""
    first = names.groupBy("name").agg(F.min("position").alias("position"))
    found = first.join(manifest.withColumn("_known", F.lit(True)), "name", "left")
    fail = F.raise_error(F.concat(F.lit("Unknown asset: "), F.col("name"))).cast("boolean")
    return found.where(F.coalesce("_known", fail)).drop("_known")


def unpack(archive: str, folder: str, prefix: str = "") -> list[str]:
    """The files under ``prefix`` (cut off) as files under ``folder``; a name
    that would leave it is an error before anything is written."""
    root = os.path.realpath(folder)
    with zipfile.ZipFile(archive) as z:
        plan = []
        for info in z.infolist():
            name = info.filename.removeprefix(prefix)
            if info.is_dir() or not info.filename.startswith(prefix) or not name:
                continue
            target = os.path.realpath(os.path.join(root, name))
            if os.path.commonpath([root, target]) != root or target == root:
                raise ValueError(f"Unsafe path in archive: {info.filename}")
            plan.append((info, target))
        for info, target in plan:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with z.open(info) as source, open(target, "wb") as sink:
                shutil.copyfileobj(source, sink)
    return [target for _, target in plan]
