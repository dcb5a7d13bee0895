"""The partitioned Parquet store of flat pull requests, and older single-file snapshots."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.scope import scope
from ..schema import EVENT_KEYS, EVENT_LISTS, FLAT_EVENT, FLAT_PR, PARTITIONS

SNAPSHOT_PREFIX = "pr_data_"


def conform(prs: DataFrame, schema: StructType = FLAT_PR) -> DataFrame:
    """The schema's columns, cast; columns that the frame lacks are null."""
    have = set(prs.columns)
    return prs.select(
        *[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def _replace_partitions(rows: DataFrame, path: str, placed: bool = False) -> None:
    """Spark's rebalancing splits large partitions among tasks and puts small ones together; ``placed`` rows are so already."""
    spread = rows if placed else rows.hint("rebalance", *PARTITIONS)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def _of_partitions(old: DataFrame, keys: list[Row]) -> DataFrame:
    """Rows of these partitions; conditions on single columns keep the others unread, and nothing is shuffled."""
    for c in PARTITIONS:
        values = {k[c] for k in keys}
        found = F.col(c).isin(sorted(values - {None}))
        old = old.where(found | F.col(c).isNull() if None in values else found)
    asked = old.sparkSession.createDataFrame(keys, StructType([FLAT_PR[c] for c in PARTITIONS])).alias("asked")
    same = reduce(Column.__and__, [F.col(f"old.{c}").eqNullSafe(F.col(f"asked.{c}")) for c in PARTITIONS])
    return old.alias("old").join(F.broadcast(asked), same, "left_semi")


def _touched(prs: DataFrame) -> list[Row]:
    """The partitions of the rows: as many as folders, which the driver lists for any scan."""
    return prs.select(*PARTITIONS).distinct().collect()


def write_prs(prs: DataFrame, path: str) -> bool:
    """Replace the partitions (org, repo, year, month) that occur in ``prs``; others stay.

    False, and nothing written, if there is no row.
    """
    prs = conform(prs)
    if prs.isEmpty():
        return False
    _replace_partitions(prs, path)
    return True


def upsert_prs(prs: DataFrame, path: str) -> bool:
    """As write_prs, but keep the affected partitions' other pull requests.

    Of several rows of a pull request the new one holds (of several new ones, one by its merge
    time). The merged rows are written out before the store's partitions are replaced.
    """
    from ..checkpoints import staged

    prs = conform(prs)
    spark = prs.sparkSession
    old = read_store(spark, path)
    if old is None:
        return write_prs(prs, path)
    both = prs.withColumn("__new", F.lit(1)).unionByName(_of_partitions(old, _touched(prs)).withColumn("__new", F.lit(0)))
    latest = W.partitionBy("org", "repo", "pr_number").orderBy(F.desc("__new"), F.desc_nulls_last("merged_at"), F.desc_nulls_last("created_at"))
    kept = both.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "__new")
    return write_prs(staged(kept), path)


def _listed(events: DataFrame) -> DataFrame:
    """Flat events as a list for each pull request, repeated ones once; lists stay as they are."""
    if "events" in events.columns:
        return conform(events, EVENT_LISTS)
    own = [c for c in FLAT_EVENT.names if c not in EVENT_KEYS]
    lists = conform(events, FLAT_EVENT).groupBy(*EVENT_KEYS).agg(F.array_distinct(F.collect_list(F.struct(*own))).alias("events"))
    return conform(lists, EVENT_LISTS)


def write_events(prs: DataFrame, events: DataFrame, path: str, keep_others: bool = False, placed: bool = False) -> bool:
    """Replace the events of the partitions that occur in ``prs``; they need not have any.

    ``events`` are flat or lists (``normalize.event_lists``, one for a pull request); a row of the
    store is a pull request with the list of its events. ``keep_others`` keeps the events of those
    partitions' pull requests that are not in ``prs``. Each partition gets a row without a list,
    which readers leave out: it makes a partition whose last events are gone be replaced as well.
    ``placed`` lists have a row for each of ``prs``, lie together by partition, and are written as
    they lie. Repeated events are one. False, and nothing written, if ``prs`` has no row.
    """
    from ..checkpoints import staged

    prs, rows = conform(prs), _listed(events)
    if prs.isEmpty():
        return False
    if not placed:
        rows = rows.unionByName(prs.select(*PARTITIONS).distinct(), allowMissingColumns=True)
    old = read_event_lists(prs.sparkSession, path) if keep_others else None
    if old is not None:
        keys = ["org", "repo", "pr_number"]
        others = _of_partitions(old, _touched(prs)).join(prs.select(*keys).distinct(), keys, "left_anti")
        rows, placed = staged(rows.unionByName(others)), False
    _replace_partitions(rows, path, placed)
    return True


def write_both(prs: DataFrame, events: DataFrame, folder: str, keep_others: bool = False, placed: bool = False) -> bool:
    """Both tables of a collection, under ``folder``; run again after a failure it gives the same tables.

    Events are written first: a pull request that is in the store has its events there.
    """
    if not write_events(prs, events, f"{folder}/events", keep_others, placed):
        return False
    return (upsert_prs if keep_others else write_prs)(prs, f"{folder}/data")


def read_events(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored events as a lazy frame; None if there are none."""
    lists = read_event_lists(spark, path)
    return None if lists is None else lists.select(*EVENT_KEYS, F.inline("events")).select(*FLAT_EVENT.names)


def read_event_lists(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored events as lists; None if there are none. An event of an older, flat file is a list of its own."""
    own = [f for f in FLAT_EVENT if f.name not in EVENT_KEYS]
    out = _read(spark, path, StructType([*EVENT_LISTS, *own]))
    if out is None:
        return None
    alone = F.when(F.col("kind").isNotNull(), F.array(F.struct(*[f.name for f in own])))
    lists = out.select(*EVENT_KEYS, F.coalesce("events", alone).alias("events"))
    return lists.where("events is not null")


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    try:
        out = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return out.select(*schema.names)


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The store as a lazy frame; None if there is none.

    The schema is explicit, so a repository named 007 keeps its name and fields that older
    files lack are null.
    """
    return _read(spark, path, FLAT_PR)


def file_schemas(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, schema): each Parquet file's physical types, read from its footer in tasks.

    Footers are read through pyarrow, so the files must lie on a file system that it opens.
    """
    import pyarrow as pa

    def footers(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            paths = batch.column("path").to_pylist()
            told = []
            for p in paths:
                system, inner = fs.FileSystem.from_uri(p) if ":/" in p else (fs.LocalFileSystem(), p)
                with system.open_input_file(inner) as f:
                    told.append("\n".join(f"{x.name}: {x.type}" for x in pq.read_schema(f)))
            yield pa.RecordBatch.from_pydict({"path": paths, "schema": told})

    rows = spark.createDataFrame([(p,) for p in files], "path string")
    return rows.repartition(max(1, -(-len(files) // FOOTERS))).mapInArrow(footers, "path string, schema string")


#: Footers that one task reads.
FOOTERS = 64


def read_foreign(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files whose physical types differ (such as all-null columns of another type), as flat rows.

    ``paths`` are Parquet files or folders of them. Files of equal schema are one scan, whatever
    their number; the scans are cast and united by name. The driver holds the file names, as it
    does for any scan.
    """
    from ..checkpoints import list_files

    files = []
    for p in paths:
        inner = [f for f in list_files(spark, p) if f.endswith(".parquet")]
        files += inner or [p]
    found = file_schemas(spark, files).groupBy("schema").agg(F.collect_list("path").alias("paths")).orderBy("schema").collect() if files else []
    out = spark.createDataFrame([], FLAT_PR)
    for i, r in enumerate(found):
        same = conform(spark.read.parquet(*sorted(r["paths"])))
        out = out.unionByName(same) if i else same
    return out


def load_store(
    spark: SparkSession,
    path: str,
    org: str | None = None,
    repo: str | None = None,
    days_back: int | None = None,
    as_of: datetime | date | None = None,
) -> DataFrame | None:
    """The store's rows in scope; None if there is none."""
    prs = read_store(spark, path)
    if prs is None:
        return None
    prs = scope(prs, org=org, repo=repo, days_back=days_back, as_of=as_of)
    return None if prs.isEmpty() else prs


def snapshot_files(spark: SparkSession, folder: str, org: str | None = None) -> list[str]:
    """Snapshots of the org (of any, if None), newest first by name; any file system."""
    from ..checkpoints import list_files

    prefix = SNAPSHOT_PREFIX + (f"{sanitize_org_name(org)}_" if org else "")
    names = [p for p in list_files(spark, folder) if p.rsplit("/", 1)[-1].startswith(prefix) and p.endswith(".parquet")]
    return sorted(names, key=lambda p: p.rsplit("/", 1)[-1], reverse=True)


def load_snapshot(spark: SparkSession, folder: str, org: str | None = None) -> DataFrame | None:
    """The newest snapshot that can be read; None if there is none."""
    for path in snapshot_files(spark, folder, org):
        try:
            out = conform(spark.read.parquet(path))
            out.count()
            return out
        except Exception as e:  # noqa: BLE001  a damaged file shows in many ways
            print(f"Skipping unreadable snapshot {path}: {str(e)[:80]}")
    return None


def load_prs(
    spark: SparkSession,
    path: str,
    snapshots: str | None = None,
    org: str | None = None,
    repo: str | None = None,
    days_back: int | None = None,
    as_of: datetime | date | None = None,
) -> DataFrame | None:
    """The store's rows in scope or else those of the newest snapshot.

    Snapshots are chosen by org and filtered by repo and time alone; such a frame may be empty.
    """
    prs = load_store(spark, path, org, repo, days_back, as_of)
    if prs is not None or snapshots is None:
        return prs
    prs = load_snapshot(spark, snapshots, org)
    return None if prs is None else scope(prs, repo=repo, days_back=days_back, as_of=as_of)


def sanitize_org_name(name: str) -> str:
    """Lower case, with spaces and underscores as hyphens."""
    return name.lower().replace(" ", "-").replace("_", "-")


def write_csv(prs: DataFrame, path: str, single: bool = False) -> None:
    """CSV files with a header, one for each partition; ``single`` merges an export for people in one task."""
    (prs.coalesce(1) if single else prs).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export in the flat schema; empty strings and nulls are not told apart."""
    return spark.read.option("header", True).schema(FLAT_PR).csv(path)
