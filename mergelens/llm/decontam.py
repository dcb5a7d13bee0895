"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A seed is a fixed mask over consecutive tokens; the tokens at its marked positions are hashed
and those at the others may differ. Hashes of training documents are joined with those of the
benchmark; each hit fixes a document, an item and a diagonal (position in the document less
position in the item). Along a diagonal the tokens are compared one by one and the best local
stretch is scored, so an overlap survives substitutions: matches count 2, mismatches -3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpoint, free_name

#: Six marked positions each; together they hit 98.9% of the 16-token stretches with 2 to 4
#: random substitutions, the best three found by trying.
MASKS = ("1111011", "1100010111", "1011010011")
#: An overlap counts from this many matching tokens on (or all tokens of a shorter item).
LEAST_MATCHES = 12
MATCH, MISMATCH = 2, -3
#: Or this many consecutive tokens of the item hold that many matches, 0.8 of a shorter item's.
STRETCH, SHARE = 16, 0.8


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits; null text has none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seed_hashes(tokens: Column, size: Column) -> Column:
    """array<struct<pos, seed>>: every mask at every position at which it fits."""
    return F.concat(*[_mask_hashes(tokens, size, number, mask) for number, mask in enumerate(MASKS)])


def _mask_hashes(tokens: Column, size: Column, number: int, mask: str) -> Column:
    marks = [i for i, c in enumerate(mask) if c == "1"]
    starts = F.when(size >= len(mask), F.sequence(F.lit(0), size - len(mask))).otherwise(F.array().cast("array<int>"))

    def seed(i: Column) -> Column:
        return F.struct(i.alias("pos"), F.xxhash64(F.lit(number), *[F.get(tokens, i + j) for j in marks]).alias("seed"))

    return F.transform(starts, seed)


def _fitting(df: DataFrame, rows: int) -> DataFrame:
    """The frame marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_MATCHES) -> DataFrame:
    """(doc_id, item_id, matches, score, doc_start, item_start): the verified overlaps.

    One row for each document and item that overlap, that of the best diagonal; positions are
    in tokens. Null and empty texts and rows of null id have none. Items of equal tokens are
    one, by their smallest id; items shorter than the shortest mask are found by all their
    tokens. An overlap that only STRETCH admits still has its best-scoring part's figures. Rows that
    share a doc_id are one document with the overlaps of any of them.
    """
    items = (
        benchmark.where("item_id is not null")
        .select(F.col("item_id").cast("long").alias("item_id"), token_hashes(F.col("text")).alias("item"))
        .groupBy("item")
        .agg(F.min("item_id").alias("item_id"))
    )
    items = checkpoint(items)
    shortest = min(map(len, MASKS))
    short = items.where((F.size("item") > 0) & (F.size("item") < shortest)).select(F.size("item").alias("n")).distinct()
    short = sorted(r["n"] for r in short.collect())  # a mask's length at most
    whole = lambda c, least: F.concat(
        seed_hashes(F.col(c), F.size(c)),
        *[F.when((F.size(c) == n) | least, _mask_hashes(F.col(c), F.size(c), len(MASKS) + n, "1" * n)).otherwise(F.array().cast("array<struct<pos:int,seed:bigint>>")) for n in short],
    )
    seeds = items.select("item_id", F.explode(whole("item", F.lit(False))).alias("s"))
    seeds = seeds.select("item_id", F.col("s.pos").alias("item_pos"), F.col("s.seed").alias("seed"))
    seeds = checkpoint(seeds)
    n_seeds = seeds.count()

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = docs.select("doc_id", token_hashes(F.col("text")).alias("tokens"))
    at = tokens.select("doc_id", F.explode(whole("tokens", F.lit(True))).alias("s"))
    at = at.select("doc_id", F.col("s.pos").alias("pos"), F.col("s.seed").alias("seed"))
    hits = at.join(_fitting(seeds, n_seeds), "seed")
    diagonals = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.count("*").alias("hits"))
    found = checkpoint(diagonals.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal")).alias("found")))

    n_found, n_items = found.count(), items.count()
    near = found.select(F.col("doc_id").alias("found_id"), "found")
    # few documents have hits as a rule: then the texts need not move to meet them
    near = F.broadcast(near) if n_found <= BROADCAST_ROWS // 10 else near.hint("shuffle_hash")
    again = docs.join(near, F.col("doc_id") == F.col("found_id"))
    again = again.select("doc_id", token_hashes(F.col("text")).alias("tokens"), F.explode("found").alias("f"))
    pairs = again.select("doc_id", "tokens", "f.item_id", "f.diagonal").join(_fitting(items, n_items), "item_id")
    scored = pairs.withColumn("best", _best_stretch(F.col("tokens"), F.col("item"), F.col("diagonal")))
    full = F.least(F.lit(least), F.size("item")) * MATCH
    enough = F.least(F.lit(least), F.ceil(F.size("item") * F.lit(SHARE)))
    kept = scored.where((F.col("best.score") >= full) | (F.col("best.most") >= enough)).select(
        "doc_id",
        "item_id",
        F.struct(F.col("best.score").alias("score"), F.col("best.matches").alias("matches"), (-F.col("best.start")).alias("early"), "diagonal").alias("top"),
    )
    top = kept.groupBy("doc_id", "item_id").agg(F.max("top").alias("top"))
    item_start = -F.col("top.early")
    return top.select(
        "doc_id",
        "item_id",
        F.col("top.matches").cast("long").alias("matches"),
        F.col("top.score").cast("long").alias("score"),
        (item_start + F.col("top.diagonal")).cast("long").alias("doc_start"),
        item_start.cast("long").alias("item_start"),
    )


def _best_stretch(tokens: Column, item: Column, diagonal: Column) -> Column:
    """struct<score, matches, start, most>: the best-scoring stretch of the item along a diagonal,
    and the most matches among STRETCH consecutive tokens."""
    zero = F.struct(*[F.lit(0).alias(c) for c in ("run", "n", "from", "at", "score", "matches", "start", "bits", "most")])

    def step(acc: Column, token: Column) -> Column:
        there = acc["at"] + diagonal
        same = F.coalesce((there >= 0) & (F.get(tokens, F.greatest(there, F.lit(0))) == token), F.lit(False))
        fresh = acc["run"] <= 0
        run = F.when(fresh, 0).otherwise(acc["run"]) + F.when(same, MATCH).otherwise(MISMATCH)
        n = F.when(fresh, 0).otherwise(acc["n"]) + F.when(same, 1).otherwise(0)
        begin = F.when(fresh, acc["at"]).otherwise(acc["from"])
        better = run > acc["score"]
        bits = (acc["bits"] * 2).bitwiseAND(F.lit((1 << STRETCH) - 1)) + F.when(same, 1).otherwise(0)
        return F.struct(
            run.cast("int").alias("run"),
            n.cast("int").alias("n"),
            begin.cast("int").alias("from"),
            (acc["at"] + 1).cast("int").alias("at"),
            F.when(better, run).otherwise(acc["score"]).cast("int").alias("score"),
            F.when(better, n).otherwise(acc["matches"]).cast("int").alias("matches"),
            F.when(better, begin).otherwise(acc["start"]).cast("int").alias("start"),
            bits.cast("int").alias("bits"),
            F.greatest(acc["most"], F.bit_count(bits)).cast("int").alias("most"),
        )

    return F.aggregate(item, zero, step)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_MATCHES) -> DataFrame:
    """The rows, all columns, of documents without a verified overlap; null ids stay."""
    name = free_name(docs, "__gone")
    gone = overlaps(docs.select("doc_id", "text"), benchmark, least).select(F.col("doc_id").alias(name)).distinct()
    gone = checkpoint(gone)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("shuffle_hash")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
