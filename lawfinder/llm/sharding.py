"""Shards by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source; row k of a source of n rows has the fractional rank
(k + 1/2) / n. Sorted by it, every stretch of rows has the sources in their overall proportions, so cutting
the order into equal stretches gives shards that match the mixture, with row counts at most one apart.

Ranks are counted in buckets: a histogram of the hash (then of the fractional rank) gives the number of rows
before each bucket, and only the rows of one bucket meet in a window, so a source with most of the rows is
dealt over thousands of buckets, and more the more rows there are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawfinder.llm.common import table, without

SHARDS = 40
SEED = 17
#: Buckets of the histograms: 2 ** BITS at least, and so many more that each has about BUCKET_ROWS rows.
BITS, BUCKET_ROWS = 12, 20_000
#: Stands for a null source, which forms a stratum of its own.
NO_SOURCE = "\x00none"

_ADDED = ["shard", "slot"]


def interleaved(docs: DataFrame, shards: int = SHARDS, source: str = "source", doc_id: str = "doc_id", seed: int = SEED, bits: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 in each shard) to every row of ``docs``.

    Nulls in ``source`` are one more stratum; a null doc_id hashes like a value of its own. Rows that repeat a
    doc_id are told apart by the columns ``ties``; wholly equal rows take neighbouring ranks in either
    order, which gives equal rows. An empty table gives an empty table. Columns named shard and slot are
    replaced.
    """
    names = without(docs, _ADDED).columns
    if bits is None:
        bits = max(BITS, math.ceil(math.log2(max(1, docs.count() / BUCKET_ROWS))))
    first = docs.select(
        *[F.col(f"`{c}`") for c in names],
        F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("__lf_source"),
        F.xxhash64(F.lit(seed), F.col(doc_id)).alias("__lf_hash"),
    ).withColumn("__lf_bucket", F.shiftrightunsigned("__lf_hash", 64 - bits))
    count = first.groupBy("__lf_source", "__lf_bucket").agg(F.count("*").alias("__lf_n"))
    whole = Window.partitionBy("__lf_source")
    before = count.select(
        "__lf_source",
        "__lf_bucket",
        (F.sum("__lf_n").over(whole.orderBy("__lf_bucket")) - F.col("__lf_n")).alias("__lf_before"),
        F.sum("__lf_n").over(whole).alias("__lf_all"),
    )
    inside = Window.partitionBy("__lf_source", "__lf_bucket").orderBy("__lf_hash", doc_id, *ties)
    ranked = first.withColumn("__lf_k", F.row_number().over(inside)).join(before, ["__lf_source", "__lf_bucket"])
    ranked = ranked.withColumn("__lf_rank", (2 * (F.col("__lf_before") + F.col("__lf_k")) - 1).cast("double") / (2 * F.col("__lf_all")).cast("double"))
    ranked = ranked.withColumn("__lf_cut", F.least(F.floor(F.col("__lf_rank") * (1 << bits)), F.lit((1 << bits) - 1)))
    ranked = ranked.drop("__lf_bucket", "__lf_k", "__lf_before", "__lf_all")
    # where a source's row k falls needs no row: the histogram of the fractional ranks follows from the source sizes
    sizes = count.groupBy("__lf_source").agg(F.sum("__lf_n").alias("__lf_all"))
    # a source gives a row for each cut, or for each of its rows if these are fewer
    upto = lambda c: f"least(__lf_all, greatest(0L, ceil(cast(__lf_all * {c} AS double) / {1 << bits} - 0.5D)))"
    many = f"transform(sequence(0L, {(1 << bits) - 1}L), c -> struct(c AS cut, {upto('(c + 1)')} - {upto('c')} AS n))"
    few = f"transform(sequence(1L, __lf_all), k -> struct(least(floor(cast(2 * k - 1 AS double) / cast(2 * __lf_all AS double) * {1 << bits}), {(1 << bits) - 1}L) AS cut, 1L AS n))"
    cuts = sizes.select(F.explode(F.expr(f"CASE WHEN __lf_all < {1 << bits} THEN {few} ELSE {many} END")).alias("x"))
    cuts = cuts.select(F.col("x.cut").alias("__lf_cut"), F.col("x.n").alias("__lf_n"))
    cuts = cuts.groupBy("__lf_cut").agg(F.sum("__lf_n").alias("__lf_n"))
    order = Window.orderBy("__lf_cut")  # 2 ** bits rows: one for every BUCKET_ROWS of the input
    cuts = cuts.select("__lf_cut", (F.sum("__lf_n").over(order) - F.col("__lf_n")).alias("__lf_ahead"), F.sum("__lf_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__lf_total"))
    among = Window.partitionBy("__lf_cut").orderBy("__lf_rank", F.xxhash64(F.lit(seed), "__lf_source"), "__lf_source", "__lf_hash", doc_id, *ties)
    placed = ranked.withColumn("__lf_k", F.row_number().over(among)).join(cuts, "__lf_cut")
    placed = placed.withColumn("__lf_at", F.col("__lf_ahead") + F.col("__lf_k") - 1).withColumn("shard", F.expr(f"cast(__lf_at * {shards} div __lf_total AS int)"))
    start = F.expr(f"(shard * __lf_total + {shards - 1}) div {shards}")
    return placed.withColumn("slot", F.col("__lf_at") - start).select(*[F.col(f"`{c}`") for c in names], "shard", "slot")


def op9_shard(spark, sf_dir: str) -> DataFrame:
    """Law ``rows``: counts of any two shards are at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return interleaved(slim, ties=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
