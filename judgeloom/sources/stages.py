"""Stages that are skipped where they are done.

A stage reads the results of others, makes a DataFrame and has settings.  Its
signature is the digest of its name, its settings, the signatures of the stages
it reads and whatever identifies its inputs (for files: names, sizes and times).
Results are Parquet folders named by the signature, beside a marker ``_done``
that is written last; so a changed setting or input gives another folder, here
and in all that follows, and a run that was killed goes on at the first stage
without a marker.

``plan`` says what a run would do and touches nothing; ``run`` does it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .folders import remove

MARKER = "_done"
#: (session, results of the stages that are read, settings) -> result
Make = Callable[..., DataFrame]


@dataclass(frozen=True)
class Stage:
    """make(spark, *results, **settings) of the stages named in reads."""

    name: str
    make: Make
    reads: Sequence[str] = ()
    settings: Mapping[str, Any] = field(default_factory=dict)
    #: What identifies inputs that aren't stages.
    inputs: Sequence[str] = ()


def ordered(stages: Sequence[Stage]) -> list[Stage]:
    """Every stage after those it reads; names that are missing, there twice or
    read in a circle are an error."""
    by = {s.name: s for s in stages}
    if len(by) < len(stages):
        raise ValueError("two stages have one name")
    out: dict[str, Stage] = {}
    open_: list[str] = []

    def visit(name: str, reader: str) -> None:
        if name in out:
            return
        if name not in by:
            raise ValueError(f"{reader} reads {name}, which isn't there")
        if name in open_:
            raise ValueError(f"stages read one another: {' -> '.join([*open_[open_.index(name) :], name])}")
        open_.append(name)
        for other in by[name].reads:
            visit(other, name)
        open_.pop()
        out[name] = by[name]

    for s in stages:
        visit(s.name, "the graph")
    return list(out.values())


def signatures(stages: Sequence[Stage]) -> dict[str, str]:
    out: dict[str, str] = {}
    for s in ordered(stages):
        told = {"name": s.name, "settings": dict(s.settings), "reads": [out[r] for r in s.reads], "inputs": list(s.inputs)}
        out[s.name] = hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()
    return out


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def identity(spark: SparkSession, path: str) -> list[str]:
    """Names, sizes and times of the files below a path, hidden ones left out."""
    files, top = _files(spark, path)
    if not files.exists(top):
        raise FileNotFoundError(path)
    found, out = files.listFiles(top, True), []
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return sorted(out)


class Graph:
    """Stages over a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, stages: Sequence[Stage]) -> None:
        self.spark, self.folder, self.stages = spark, folder, ordered(stages)
        self.signatures = signatures(stages)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{self.signatures[name][:16]}"

    def done(self, name: str) -> bool:
        files, marker = _files(self.spark, f"{self.path(name)}/{MARKER}")
        return bool(files.exists(marker))

    def needed(self, *wanted: str) -> list[str]:
        """The stages that the wanted ones (all, if none are named) can't do
        without: those that aren't done, and of done ones none that is only read
        by others that are done."""
        by = {s.name: s for s in self.stages}
        todo, seen = list(wanted or by), set()
        while todo:
            name = todo.pop()
            if name not in seen and not self.done(name):
                seen.add(name)
                todo.extend(by[name].reads)
        return [s.name for s in self.stages if s.name in seen]

    def plan(self, *wanted: str) -> list[tuple[str, str]]:
        """(stage, run or skip), in the order of a run."""
        needed = self.needed(*wanted)
        return [(s.name, "run" if s.name in needed else "skip") for s in self.stages]

    def run(self, *wanted: str) -> dict[str, DataFrame]:
        """Runs what is needed; the results of all stages that are done."""
        by = {s.name: s for s in self.stages}
        for name in self.needed(*wanted):
            stage = by[name]
            made = stage.make(self.spark, *(self.result(r) for r in stage.reads), **stage.settings)
            made.write.mode("overwrite").parquet(self.path(name))  # what a killed run has left goes
            files, marker = _files(self.spark, f"{self.path(name)}/{MARKER}")
            files.create(marker, True).close()
        return {s.name: self.result(s.name) for s in self.stages if self.done(s.name)}

    def result(self, name: str) -> DataFrame:
        if not self.done(name):
            raise RuntimeError(f"stage {name} isn't done")
        return self.spark.read.parquet(self.path(name))

    def clean(self) -> list[str]:
        """Removes results of other settings and inputs; says which."""
        files, top = _files(self.spark, self.folder)
        if not files.exists(top):
            return []
        kept = {self.path(s.name).rsplit("/", 1)[1] for s in self.stages}
        names = [f.getPath().getName() for f in files.listStatus(top)]
        own = [n for n in names if n not in kept and n.rpartition("-")[0] in self.signatures]
        remove(self.spark, *(f"{self.folder}/{n}" for n in own))
        return sorted(own)
