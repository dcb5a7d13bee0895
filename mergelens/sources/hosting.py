"""Collection from the hosting service: which repositories, and their pull requests.

Repository names are asked for on the driver; the pull requests are read by a data source with a
partition a repository.
"""

from __future__ import annotations

import json
import os
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import cutoff
from ..operators.collect import active_repos
from ..schema import RAW_PR
from .pull_requests import register
from .tool import PR_LIMIT, REPO_LIMIT, SEARCH_LIMIT, Runner, call, run_tool


def org_repos(org: str, run: Runner = run_tool) -> list[str]:
    """Repositories that are neither archived nor forks."""
    found = call(["repo", "list", org, "--json", "name", "--no-archived", "--source", "--limit", str(REPO_LIMIT)], run=run)
    return [r["name"] for r in found]


def recent_repos(spark: SparkSession, org: str, days_back: int = 14, as_of: datetime | date | None = None, run: Runner = run_tool) -> list[str]:
    """Repositories with pull requests created in the window; all of them if none is found."""
    since = cutoff(days_back, as_of)
    query = ["search", "prs", "--owner", org, "--json", "repository", "--limit", str(SEARCH_LIMIT)]
    found = call([*query, *(["--created", f">={since}"] if since else [])], run=run)
    if not found:
        return org_repos(org, run)
    frame = spark.createDataFrame([({"name": (x.get("repository") or {}).get("name")},) for x in found], "repository struct<name: string>")
    return [r["name"] for r in active_repos(frame).collect()]


def collect_raw(
    spark: SparkSession, org: str, repos: list[str], days_back: int = 14, as_of: datetime | date | None = None, run: Runner = run_tool, limit: int | None = None
) -> DataFrame:
    """Raw pull requests with ``org`` and ``repo``, as the tool knows them, of all repositories at once.

    GH_PR_LIMIT bounds how many are asked for in each repository. The frame is lazy: what reads
    it twice asks the tool twice, so write or checkpoint it first.
    """
    register(spark, run)
    limit = limit or int(os.environ.get("GH_PR_LIMIT", PR_LIMIT))
    rows = spark.read.format("pull_requests").option("org", org).option("repos", json.dumps(repos)).option("limit", limit).load()
    since = cutoff(days_back, as_of)
    rows = rows.where(F.col("created_day") >= since.isoformat()) if since else rows.where(F.col("created_day") > "")
    return rows.select("org", "repo", F.from_json("value", RAW_PR).alias("p")).select("org", "repo", "p.*")


def resolve_org(given: str | None = None) -> str:
    """The argument or else MERGELENS_ORG."""
    org = given or os.environ.get("MERGELENS_ORG")
    if not org:
        raise ValueError("no organization: pass --org or set MERGELENS_ORG")
    return org
