"""A Spark data source of pull requests, with one partition for each repository.

Each task asks the hosting service's tool for its own repositories and tries passing errors
again, so the driver holds names alone and a lost executor costs its repositories' calls. The
condition ``created_day >= ...`` is taken into the reader: older rows never leave it.

    register(spark)
    spark.read.format("pull_requests").option("org", "acme").option("repos", '["a", "b"]').load()

The tool must be on the executors. ``register(spark, run)`` makes the source ask another function.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from .tool import PR_FIELDS, PR_LIMIT, Runner, call, run_tool

COLUMNS = "org string, repo string, created_day string, value string"


class Repository(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class PullRequestReader(DataSourceReader):
    def __init__(self, options: dict[str, str], run: Runner) -> None:
        self.org = options["org"]
        self.repos = json.loads(options.get("repos", "[]"))
        self.limit = int(options.get("limit", os.environ.get("GH_PR_LIMIT", PR_LIMIT)))
        self.tries, self.delay = int(options.get("tries", 3)), float(options.get("delay", 2.0))
        self.run = run
        self.days: list[tuple[str, str]] = []  # conditions on created_day

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        kinds = {GreaterThanOrEqual: ">=", GreaterThan: ">", EqualTo: "="}
        for f in filters:
            if type(f) in kinds and f.attribute == ("created_day",) and isinstance(f.value, str):
                self.days.append((kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [Repository(name) for name in self.repos]

    def _wanted(self, day: str) -> bool:
        return all(day >= v if op == ">=" else day > v if op == ">" else day == v for op, v in self.days)

    def read(self, partition: Repository | None):
        if partition is None:  # without repositories Spark makes one partition of nothing
            return
        args = ["pr", "list", "--repo", f"{self.org}/{partition.name}", "--state", "all", "--json", PR_FIELDS, "--limit", str(self.limit)]
        for pr in call(args, self.tries, self.delay, self.run):
            day = (pr.get("createdAt") or "")[:10]
            if self._wanted(day):
                yield self.org, partition.name, day, json.dumps(pr)


class PullRequestSource(DataSource):
    """Options: org, repos (JSON list of names), limit, tries, delay (seconds before the second try)."""

    run: Runner = staticmethod(run_tool)

    @classmethod
    def name(cls) -> str:
        return "pull_requests"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("org"):
            raise ValueError("option org names the organization")
        return PullRequestReader(dict(self.options), type(self).run)


def register(spark: SparkSession, run: Runner = run_tool) -> None:
    """Make the format known, with ``run`` in place of the command-line tool; it is sent to the executors.

    Spark refuses readers that take conditions unless its setting for that is on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(type("PullRequestSource", (PullRequestSource,), {"run": staticmethod(run)}))
