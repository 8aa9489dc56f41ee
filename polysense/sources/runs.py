"""Runs that outlive their driver.

A run keeps its tables and its progress in its own folder. After each step a manifest names
the tables that hold the state and whatever else the next step needs; it appears by one
rename, so a step is either done or was never begun. A driver that starts the same run
takes up the last manifest and deletes what an unfinished step left.

Layout: ``<run>/state/<table>-<id>`` (parquet), ``<run>/steps/<number>.json``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from polysense.sources.store import Versions, names_in, remove, write_text_once


def digest(df: DataFrame, *columns: str) -> str:
    """The same text for the same rows, in whatever order and partitions they come."""
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    found = df.agg(F.count("*").alias("n"), F.sum(row).alias("h")).first()
    return f"{found['n']}:{found['h'] or 0}"


class Run(Versions):
    """The tables of a run. Superseded ones stay until the next commit, since the last manifest names them."""

    def __init__(self, spark: SparkSession, path: str, identity: dict):
        super().__init__(spark)
        self.path, self.identity = path, identity
        self.retired: list[str] = []
        self.step: int | None = None

    def fresh_path(self, name: str) -> str:
        return f"{self.path}/state/{name}-{uuid.uuid4().hex}"

    def drop(self, name: str) -> None:
        path = self.paths.pop(name, None)
        if path:
            self.retired.append(path)

    def recover(self) -> dict | None:
        """Take up the last committed step of the same identity and return its facts; without one, clear the folder."""
        folder = f"{self.path}/steps"
        numbers = sorted(int(n.removesuffix(".json")) for n in names_in(self.spark, folder) if n.endswith(".json"))
        found = None
        if numbers:
            text = self.spark.read.text(f"{folder}/{numbers[-1]}.json", wholetext=True).first()["value"]
            found = json.loads(text)
        if not found or found["identity"] != self.identity:
            return self.clear()
        self.step = numbers[-1]
        self.paths = {name: f"{self.path}/state/{folder}" for name, folder in found["tables"].items()}
        kept = set(found["tables"].values())
        for name in names_in(self.spark, f"{self.path}/state"):
            if name not in kept:
                remove(self.spark, f"{self.path}/state/{name}")
        return found["facts"]

    def commit(self, facts: dict, passing: tuple[str, ...] = ()) -> None:
        """The step is done: its tables, but for the ``passing`` ones, and ``facts`` are what a driver takes up.

        Raises if another driver committed the same step.
        """
        for name in passing:
            self.drop(name)
        tables = {name: path.rsplit("/", 1)[1] for name, path in self.paths.items()}
        step = 0 if self.step is None else self.step + 1
        manifest = json.dumps({"identity": self.identity, "tables": tables, "facts": facts})
        if not write_text_once(self.spark, f"{self.path}/steps/{step}.json", manifest):
            raise RuntimeError(f"step {step} of {self.path} was committed by another driver")
        if self.step is not None:
            remove(self.spark, f"{self.path}/steps/{self.step}.json")
        self.step = step
        for path in self.retired:
            remove(self.spark, path)
        self.retired = []

    def clear(self) -> None:
        """Forget the tables, progress and history that a run of this name left; its snapshots stay until they are written anew."""
        for part in ("steps", "state", "history"):
            remove(self.spark, f"{self.path}/{part}")
