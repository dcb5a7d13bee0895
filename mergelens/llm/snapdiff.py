"""Difference of two snapshots of a table, pairing rows by key and then moved rows by content.

Rows are reduced to their key and a 32-byte digest of each compared column before anything is
shuffled, so the exchanges are narrow whatever the texts' length. A full outer sort-merge join on
the key pairs rows; those without a partner are numbered within their content, in key order, and
a second, null-safe join on content and number pairs rows whose key changed.

Numbers within a content are found without bringing a content together: the unpaired rows are
sorted by range over (content, key), numbered within each range, and a range's first content is
carried on by the counts of the ranges before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, id_remainder

SAME, UPDATE, REKEY, INSERT, DELETE = "same", "update", "rekey", "insert", "delete"


def _digest(value: Column) -> Column:
    """32 bytes for a value, null for null."""
    return F.unhex(F.sha2(value.cast("string"), 256))


def _null_safe(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[f"a_{n}"].eqNullSafe(b[f"b_{n}"]) for n in names])


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def number_within(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place (from 1) in its group by ``order``; equal rows in any order.

    No task needs a whole group: rows are dealt by range over a hash of the group and the order,
    so a group's ranges follow each other, and few groups have more than one. Rows that are equal
    in both are told apart by their place in ``df``, which is to be checkpointed. Nulls group
    together. What Spark samples to find the ranges is narrow, as are the keys.
    """
    in_range = df.withColumns({"__row": F.monotonically_increasing_id(), "__group": F.xxhash64(*group)})
    in_range = in_range.repartitionByRange("__group", *order, "__row").drop("__group").withColumn("__range", F.spark_partition_id())
    in_range = checkpoint(in_range)  # a range's number must not change between its readers
    order = [*order, F.col("__row")]
    counts = in_range.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    earlier = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carried = counts.withColumn("__before", F.sum("__n").over(earlier)).where("__before is not null").drop("__n")
    local = in_range.withColumn("__place", F.row_number().over(W.partitionBy(*group, "__range").orderBy(*order)))
    a, b = _prefixed(local, "a"), _prefixed(carried, "b")
    both = a.join(b, _null_safe(a, b, [*group, "__range"]), "left")
    place = (F.col("a___place") + F.coalesce("b___before", F.lit(0))).cast("long")
    return both.select(*[F.col(f"a_{c}").alias(c) for c in df.columns], place.alias(name))


def _occurrences(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``nth``: the place of a row among those of its key, by content; 1 where keys are unique."""
    repeated = checkpoint(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    if repeated.isEmpty():  # all places are 1
        return rows.withColumn("nth", F.lit(1).cast("long"))
    a, b = _prefixed(rows, "a"), _prefixed(repeated, "b")
    on = _null_safe(a, b, ["key"])
    back = [F.col(f"a_{c}").alias(c) for c in rows.columns]
    many = a.join(b, on, "left_semi").select(*back)
    once = a.join(b, on, "left_anti").select(*back, F.lit(1).cast("long").alias("nth"))
    return once.unionByName(number_within(checkpoint(many), ["key"], [F.xxhash64(*columns)], "nth"))


def diff_snapshots(
    old: DataFrame,
    new: DataFrame,
    key: str = "doc_id",
    columns: tuple[str, ...] = ("text", "lang", "source"),
    content: tuple[str, ...] = ("text",),
    carry: Column | None = None,
    old_descending: bool = False,
    new_descending: bool = False,
) -> DataFrame:
    """(key, old_key, op, changed, carried): one row for each pair and each unpaired row.

    ``key`` is the later key, else the earlier one; ``old_key`` the earlier, else null. ``op`` is
    same or update for rows of equal keys, rekey for rows of equal ``content`` under different
    keys, else insert or delete; ``changed`` lists a pair's differing ``columns``, empty for other
    rows. ``carried`` is the value of ``carry`` over the later row (its digest, say), null for a
    delete. Among unpaired rows of equal content the i-th earlier pairs with the i-th later row in
    key order; the directions are ascending unless told otherwise.

    Nulls equal only nulls, in keys, contents and compared columns; null keys come first. Where a
    key repeats on a side, its rows pair by their place in order of a hash of the compared columns,
    the rest stay unpaired; rows that repeat wholly are told apart by that place alone. Values
    are compared by the SHA-256 of their text form, so columns must be of atomic types. Other
    columns are not read, so their names cannot clash. An empty or missing side gives inserts or
    deletes alone.
    """
    digests = [f"d{i}" for i in range(len(columns))]
    by = [digests[columns.index(c)] for c in content]

    def reduced(df: DataFrame, carried: Column | None) -> DataFrame:
        out = df.select(
            F.col(f"`{key}`").alias("key"),
            *[_digest(F.col(f"`{c}`")).alias(d) for c, d in zip(columns, digests, strict=True)],
            *([] if carried is None else [carried.alias("carried")]),
        )
        return _occurrences(checkpoint(out), digests)

    later_value = F.lit(None).cast("string") if carry is None else carry
    a, b = _prefixed(reduced(old, None), "a"), _prefixed(reduced(new, later_value), "b")
    a, b = a.withColumn("a_here", F.lit(True)), b.withColumn("b_here", F.lit(True))
    joined = checkpoint(a.hint("merge").join(b.hint("merge"), _null_safe(a, b, ["key", "nth"]), "full"))

    def differing(of: DataFrame) -> Column:
        names = [F.when(~of[f"a_{d}"].eqNullSafe(of[f"b_{d}"]), F.lit(c)) for c, d in zip(columns, digests, strict=True)]
        return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")

    paired = joined.where("a_here and b_here")
    matched = paired.select(
        F.col("b_key").alias("key"), F.col("a_key").alias("old_key"), differing(paired).alias("changed"), F.col("b_carried").alias("carried")
    )
    matched = matched.withColumn("op", F.when(F.size("changed") > 0, UPDATE).otherwise(SAME))

    def left_over(side: str, other: str, descending: bool) -> DataFrame:
        rows = joined.where(F.col(f"{other}_here").isNull())
        kept = [c for c in joined.columns if c.startswith(f"{side}_") and c not in (f"{side}_nth", f"{side}_here")]
        rows = rows.select(*[F.col(c).alias(c[2:]) for c in kept])
        direction = F.desc_nulls_last("key") if descending else F.asc_nulls_first("key")
        # the hash only settles which of a repeated key's rows comes first
        return _prefixed(number_within(rows, by, [direction, F.xxhash64(*digests)], "place"), side)

    gone = left_over("a", "b", old_descending).withColumn("a_here", F.lit(True))
    come = left_over("b", "a", new_descending).withColumn("b_here", F.lit(True))
    moved = gone.hint("merge").join(come.hint("merge"), _null_safe(gone, come, [*by, "place"]), "full")
    both = F.col("a_here") & F.col("b_here")
    moved = moved.select(
        F.when(F.col("b_here"), F.col("b_key")).otherwise(F.col("a_key")).alias("key"),
        F.col("a_key").alias("old_key"),
        F.when(both, differing(moved)).otherwise(F.array().cast("array<string>")).alias("changed"),
        F.col("b_carried").alias("carried"),
        F.when(both, REKEY).when(F.col("b_here"), INSERT).otherwise(DELETE).alias("op"),
    )
    return matched.unionByName(moved).select("key", "old_key", "op", "changed", "carried")


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The later state of (doc_id, text, lang, source) that the contract derives from ``docs``.

    By crc32 of the decimal id modulo 16: 0 drops the row, 1 appends ``+`` to the text, 2 swaps
    lang and source, 3 and 4 change the key to ``-1-key`` (4 also sets source to null), 5 adds a
    copy under that key; a null id has no remainder and stays.
    """
    rest = F.coalesce(id_remainder(F.col("doc_id"), 16), F.lit(-1))
    key = F.col("doc_id").cast("long")
    moved = -1 - key
    keys = F.when(rest.isin(3, 4), F.array(moved)).when(rest == 5, F.array(key, moved)).otherwise(F.array(key))
    return docs.where(rest != 0).select(
        F.explode(keys).alias("doc_id"),
        F.when(rest == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(rest == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(rest == 2, F.col("lang")).when(rest != 4, F.col("source")).alias("source"),
    )


def row_digest(*columns: str) -> Column:
    """Lowercase hex SHA-256 of the columns' text joined by line feeds, null as ``~``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def snapshot_report(docs: DataFrame) -> DataFrame:
    """(key, old_key, op, changed, row_sha256): documents against their later snapshot."""
    earlier = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    found = diff_snapshots(earlier, later_snapshot(docs), carry=row_digest("text", "lang", "source"))
    return found.select("key", "old_key", "op", F.array_join("changed", ",").alias("changed"), F.col("carried").alias("row_sha256"))
