"""Numbered versions of a small state, in files that only one writer can create.

A version file holds the whole state (which folders are live, and what else a store must remember), so a reader reads one file
and sees either the state before or after a change. Data are written first, into a folder of the attempt's own; creating the
next version file makes them visible. Who comes second reads the new state and decides again, so nothing committed is lost.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from chronolane.sources import files


class Versions:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        files.make_dir(spark, self.path)

    def read(self) -> tuple[int, dict]:
        """Number and state of the newest version; 0 and an empty state before the first."""
        numbers = [int(n.removesuffix(".json")) for n in files.names(self.spark, self.path) if n.endswith(".json")]
        if not numbers:
            return 0, {}
        return max(numbers), json.loads(files.read_text(self.spark, f"{self.path}/{max(numbers):09d}.json"))

    def commit(self, number: int, state: dict) -> bool:
        """Makes version ``number``; False if another writer made it first."""
        return files.write_new(self.spark, f"{self.path}/{number:09d}.json", json.dumps(state))

    def change(self, how: Callable[[dict], dict | None]) -> int | None:
        """Applies ``how`` to the newest state until its result could be committed; None if ``how`` gives None."""
        while True:
            number, state = self.read()
            new = how(state)
            if new is None:
                return None
            if self.commit(number + 1, new):
                return number + 1

    def prune(self, older_than_s: float) -> None:
        """Deletes version files of that age but the newest."""
        number, before = self.read()[0], time.time() - older_than_s
        for n in files.names(self.spark, self.path):
            if n != f"{number:09d}.json" and files.modified(self.spark, f"{self.path}/{n}") < before:
                files.delete(self.spark, f"{self.path}/{n}")


def fresh_name(what: str) -> str:
    """A folder name no other attempt uses."""
    return f"{what}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession, path: str, live: set[str], older_than_s: float) -> int:
    """Deletes the folders below ``path`` that aren't live and weren't touched for that long (an attempt may be running)."""
    gone, before = 0, time.time() - older_than_s
    for n in files.names(spark, path):
        if n not in live and files.modified(spark, f"{path}/{n}") < before:
            files.delete(spark, f"{path}/{n}")
            gone += 1
    return gone
