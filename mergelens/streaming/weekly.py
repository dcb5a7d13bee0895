"""Weekly activity as a stream: deliveries in any order, each counted once, exact authors a week.

A delivered pull request states that it was opened and perhaps that it was merged. Each of these
facts counts once, whatever is delivered again, by state that the watermark bounds; the facts of
a week and author are summed in a second piece of state. Every micro-batch writes the sums that
changed to a folder of its own, which a batch that is run again replaces, so a restart neither
loses nor doubles anything. Reports roll the newest sums up to weeks; authors are rows there, so
their number is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..checkpoints import list_files
from ..functions import expr as E

#: Seven days from a Monday: the epoch was a Thursday, four days before one.
WEEK = ("7 days", "7 days", "4 days")
#: How far deliveries may lag behind the newest creation time seen: longer than a pull request stays open.
LATENESS = "400 days"

#: State has a row a pull request: it is kept on disk, and a batch writes what it changed. A checkpoint begun with another store keeps that.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

KEYS = ["week", "author"]
SUMS = ["opened", "merged", "size", "hours", "timed"]


def weekly_sums(prs: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(week, author, opened, merged, size, hours, timed) of a stream, or a batch, of flat pull requests.

    The size is that of the first delivery; hours to merge are that of the first one that says so.
    Rows without a creation time belong to no week. Rows that are older than the newest
    creation time by more than ``lateness`` are left out by Spark; ``late_rows`` counts them.
    """
    facts = F.array_compact(
        F.array(
            F.struct(F.lit("opened").alias("fact"), F.col("pr_size").alias("size"), F.lit(None).cast("double").alias("hours")),
            F.when(E.is_merged(), F.struct(F.lit("merged").alias("fact"), F.lit(None).cast("long").alias("size"), F.col("time_to_merge_hours").alias("hours"))),
        )
    )
    timed = prs.where("created_at is not null").withWatermark("created_at", lateness)
    each = timed.select("org", "repo", "pr_number", "author", "created_at", F.inline(facts))
    once = each.dropDuplicatesWithinWatermark(["org", "repo", "pr_number", "fact"]) if prs.isStreaming else each.dropDuplicates(["org", "repo", "pr_number", "fact"])
    by = once.groupBy(F.window("created_at", *WEEK).alias("w"), "author").agg(
        F.count(F.when(F.col("fact") == "opened", 1)).alias("opened"),
        F.count(F.when(F.col("fact") == "merged", 1)).alias("merged"),
        F.sum("size").alias("size"),
        F.sum("hours").alias("hours"),
        F.count("hours").alias("timed"),
    )
    return by.select(F.col("w.start").alias("week"), "author", *SUMS)


def start(prs: DataFrame, folder: str, progress: str, lateness: str = LATENESS, available_now: bool = True) -> StreamingQuery:
    """Keep the sums of a stream of flat pull requests under ``folder``; ``progress`` is its checkpoint."""

    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = weekly_sums(prs, lateness).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", progress)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    conf, before = prs.sparkSession.conf, {}
    for key, value in STATE.items():
        before[key] = conf.get(key, None)
        conf.set(key, value)
    try:  # a query keeps the settings of its start
        return writer.start()
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came too late for the query's state, over the progress it still holds."""
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    names = [p.rstrip("/").rsplit("/", 1)[-1] for p in list_files(spark, folder)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit())


def newest_sums(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest sums of each week and author; None before the first batch.

    Batches that a compaction holds are not read.
    """
    schema = "week timestamp, author string, opened long, merged long, size long, hours double, timed long"
    base = _numbers(spark, folder, "upto=")
    after = [n for n in _numbers(spark, folder, "batch=") if not base or n > base[-1]]
    parts = [f"{folder}/upto={n}" for n in base[-1:]] + [f"{folder}/batch={n}" for n in after]
    if not parts:
        return None
    rows = spark.read.schema(schema).parquet(*parts)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:batch|upto)=(\d+)/[^/]*$", 1).cast("long")
    newest = rows.select(*KEYS, F.struct(number.alias("batch"), *SUMS).alias("s")).groupBy(*KEYS).agg(F.max_by("s", "s.batch").alias("s"))
    return newest.select(*KEYS, *[F.col(f"s.{c}").alias(c) for c in SUMS])


def compact(spark: SparkSession, folder: str) -> bool:
    """Write the newest sums as one table in place of all batches so far; readers see either."""
    batches = _numbers(spark, folder, "batch=")
    rows = newest_sums(spark, folder)
    if rows is None or not batches:
        return False
    target = f"{folder}/upto={batches[-1]}"
    rows.write.mode("overwrite").parquet(f"{folder}/.making")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/.making")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path, jvm.org.apache.hadoop.fs.Path(target))


def roll_up(sums: DataFrame) -> DataFrame:
    """The weekly figures of ``metrics.weekly_stats`` from sums of weeks and authors, newest week first."""
    total = sums.groupBy("week").agg(*[F.sum(c).alias(c) for c in SUMS], F.count("author").alias("active_authors"))
    return total.select(
        "week",
        F.col("opened").alias("pr_count"),
        F.col("merged").alias("merged_count"),
        "active_authors",
        F.round(F.col("size") / F.nullif(F.col("opened"), F.lit(0)), 1).alias("avg_pr_size"),
        F.round(F.col("hours") / F.nullif(F.col("timed"), F.lit(0)), 1).alias("avg_merge_time"),
        F.round(E.percent(F.col("merged"), F.col("opened")), 1).alias("merge_rate"),
        F.round(F.col("opened") / F.nullif(F.col("active_authors"), F.lit(0)), 1).alias("prs_per_dev"),
    ).orderBy(F.desc("week"))
