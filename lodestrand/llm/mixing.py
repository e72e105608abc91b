"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.llm.tables import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source with its size, words to take, and shards.

    Weighted water-filling: sources stop at most times their size, in the order of that ceiling over their weight; the
    level of the rest is what remains over their weights. It is the fixed point of resharing the excess by weight.
    The table has a row per source, not per document; its windows run over that.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = per.select("*", place.alias("source_no"), weight.cast("double").alias("_w"), (F.lit(most) * F.col("source_size")).alias("_cap"))
    fill = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source_no").asc())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weights_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    levels = ranked.select("*", left.alias("_left"), weights_left.alias("_wl"), F.row_number().over(fill).alias("_k"))
    open_here = F.col("_left") * F.col("_w") < F.col("_cap") * F.col("_wl")
    first = F.min(F.when(open_here, F.struct("_k", "_left", "_wl"))).over(everything)
    at = levels.withColumn("_first", first)
    level = (F.col("_w") * F.col("_first._left")) / F.col("_first._wl")
    target = F.when(F.col("_first").isNull() | (F.col("_k") < F.col("_first._k")), F.col("_cap")).otherwise(level)
    return at.select("source", "source_no", "source_size", "_rows", target.cast("double").alias("target"))


def sainte_lague(votes: DataFrame, keys: list[str], vote: str, seats: F.Column, most: str) -> DataFrame:
    """Integer seats for each row of votes, by the highest quotients vote / (2 s + 1), over the whole table.

    With a divisor slightly too large or too small, rounding gives too few or too many seats, by half a seat a row at
    most. What the larger divisor gives is certain; only the quotients between the two are ranked. Ranking is by
    counts per quotient band first, so that no task sorts more than one band.
    most: column with a row's most seats. A row never gets more.
    """
    votes = materialize(votes)
    totals = votes.agg(F.sum(vote).alias("_v"), F.count(F.lit(1)).alias("_n")).select("_v", "_n", seats.alias("_seats")).first()
    v, n, want = totals["_v"] or 0.0, totals["_n"], totals["_seats"] or 0
    fewer, more = (max(want - n / 2, 0) / v, (want + n / 2) / v) if v > 0 else (0.0, 0.0)
    sure, possible = F.floor(F.col(vote) * fewer + 0.5), F.ceil(F.col(vote) * more + 0.5)
    bounds = votes.select(*keys, vote, F.least(sure, most).cast("long").alias("_sure"), F.least(possible, most).cast("long").alias("_possible"))
    asked = bounds.where("_possible > _sure").select(*keys, vote, F.explode(F.sequence(F.col("_sure") + 1, F.col("_possible"))).alias("_s"))
    quotient = asked.select(*keys, (F.col(vote) / (2 * F.col("_s") - 1)).alias("_q"))
    given = bounds.agg(F.sum("_sure")).first()[0] or 0
    won = rank_in_bands(quotient, "_q", keys).where(F.col("_rank") <= want - given).groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    return bounds.join(won, keys, "left").select(*keys, (F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))).alias("quota"))


def rank_in_bands(df: DataFrame, by: str, ties: list[str], bands: int = 256) -> DataFrame:
    """df with _rank: 1 for the largest by. Bands of by are counted, the bands before are summed, and rows are ranked
    inside their band only."""
    low, high = df.agg(F.min(by), F.max(by)).first()
    band = F.least(F.floor((high - F.col(by)) / (high - low) * bands), F.lit(bands - 1)) if low is not None and high > low else F.lit(0)
    cut = df.withColumn("_band", band.cast("int"))
    counts = cut.groupBy("_band").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_band", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_band").orderBy(F.col(by).desc(), *(F.col(t).asc_nulls_last() for t in ties))
    return cut.join(F.broadcast(starts), "_band").withColumn("_rank", F.row_number().over(inside) + F.col("_before")).drop("_band", "_before")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
    block_words: int = 64, shard_words: int = 1_000_000, seed: int = 17,
) -> DataFrame:
    """How many words of every document the mix takes, repeats counted.

    1. A source's target: weights in turn by code point, null last; the sources share `share` of all words, none more
       than `most` times its size, the excess reshared by weight.
    2. A source is dealt by a hash of the id and the size into shards of about shard_words words, so that a source with a
       third of all rows is many shards, and so are rows without an id. A shard's documents lie in a seeded order and are cut into blocks of block_words words.
    3. Sainte-Laguë gives the shards blocks, by the highest quotients of their share of the target.
    4. A shard takes all its blocks as often as the quota allows, and once more the blocks that come first in a seeded
       order until the quota is used. A document takes the words that it has in the blocks taken.

    No document exceeds `most` times its size (rounded down to whole passes) because a shard's quota is at most that
    many passes over its blocks. A source differs from its target by half a block a shard, and what its last block
    lacks. Everything follows from hashes of the ids, so reruns agree.

    Null and empty texts have size 0 and take 0. Sources without words have target 0. Rows that repeat an id count
    one by one. A null id is hashed like any other. Columns other than id, text and source are not read. An empty
    table gives an empty result.

    Returns doc_id, size, source_size, target, taken, source_no, shard.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sizes = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    )
    targets = materialize(source_targets(sizes, weights, share, most))
    shards_of = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    on = sizes["source"].eqNullSafe(targets["source"])
    placed = sizes.join(targets, on).select(
        "doc_id", "size", "source_no", "source_size", "target", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), shards_of).alias("shard")
    )
    key = ["source_no", "shard"]
    laid = Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size")
    end = F.sum("size").over(laid.rowsBetween(Window.unboundedPreceding, 0))
    lines = placed.select("*", (end - F.col("size")).alias("_start"), F.row_number().over(laid).alias("_line"))
    per_shard = placed.groupBy(*key).agg(F.sum("size").alias("_words"), F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    passes = int(most)
    share_of = F.when(F.col("source_size") > 0, F.col("target") * F.col("_words") / F.col("source_size") / block_words).otherwise(F.lit(0.0))
    blocks = F.ceil(F.col("_words") / block_words).cast("long")
    votes = per_shard.select(*key, blocks.alias("_blocks"), (blocks * passes).alias("_most"), share_of.alias("_vote"))
    quotas = sainte_lague(votes, key, "_vote", F.floor(F.col("_v") + 0.5), "_most")
    shards = votes.join(quotas, key).select(
        *key,
        F.when(F.col("_blocks") > 0, F.floor(F.col("quota") / F.col("_blocks"))).otherwise(F.lit(0)).cast("long").alias("_whole"),
        F.when(F.col("_blocks") > 0, F.col("quota") % F.col("_blocks")).otherwise(F.lit(0)).cast("long").alias("_extra"),
    )
    first, last = F.floor(F.col("_start") / block_words).cast("long"), F.floor((F.col("_start") + F.col("size") - 1) / block_words).cast("long")
    cut = lines.join(shards, key).select("*", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))).alias("_block"))
    drawn = Window.partitionBy(*key).orderBy(F.col("_block") < 0, F.xxhash64(F.lit(seed + 2), *key, "_block"), "_block")
    inside = F.least((F.col("_block") + 1) * block_words, F.col("_start") + F.col("size")) - F.greatest(F.col("_block") * block_words, F.col("_start"))
    here = F.when(F.dense_rank().over(drawn) <= F.col("_extra"), inside).otherwise(F.lit(0))
    pieces = cut.withColumn("_here", F.when(F.col("_block") >= 0, here).otherwise(F.lit(0)))
    return (
        pieces.groupBy("source_no", "shard", "_line", "doc_id")
        .agg(*(F.first(c).alias(c) for c in ("size", "source_size", "target", "_whole")), F.sum("_here").alias("_more"))
        .select("doc_id", "size", "source_size", "target", (F.col("_whole") * F.col("size") + F.col("_more")).cast("long").alias("taken"), "source_no", "shard")
    )


def whole_documents(mixed: DataFrame, most: float = 2.0, seed: int = 17, rounds: int = 4) -> DataFrame:
    """How often each document appears if it can only be taken whole, from what mix_sources() gives.

    1. A shard's quota is what its documents take. All appear once for each pass that the quota holds.
    2. Of the words left, documents in a seeded order take what they fit in. Where the next one does not fit, those
       behind it that do are tried, `rounds` times in all, so one long document does not leave a gap of its length.
    3. What shards still lack is summed over their source, and their shortest documents left over make it up, shard
       by shard, to the nearest. A source of few or long documents in many shards meets its target too.

    A source differs from its quota by less than a document a shard at worst, mostly by far less (0.05% at sf0.1). Rows
    that repeat an id count as one document. An id with rows in several sources takes its own fraction, rounded, and
    the others make up for it. Step 3 has a row for each shard, not for each document.

    Returns doc_id, times: one row per id that has words.
    """
    passes, shard = int(most), ["source_no", "shard"]
    here = mixed.where("size > 0").groupBy("doc_id", *shard).agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    ids = here.groupBy("doc_id").agg(F.collect_list(F.struct(*shard, "size", "taken")).alias("_at"), (F.sum("taken") / F.sum("size")).alias("_part"))
    fixed = F.when(F.size("_at") > 1, F.floor(F.col("_part") + 0.5))
    own, free = Window.partitionBy(*shard), F.col("_fixed").isNull()
    words = F.sum(F.when(free, F.col("size")).otherwise(0)).over(own)
    quota = F.sum(F.col("taken") - F.coalesce(F.col("_fixed") * F.col("size"), F.lit(0))).over(own)
    units = ids.select("doc_id", fixed.alias("_fixed"), F.inline("_at")).withColumn("_words", words)
    units = units.withColumn("_quota", F.greatest(F.lit(0), F.least(quota, F.col("_words") * passes)))
    units = units.withColumn("_whole", F.when(F.col("_words") > 0, F.floor(F.col("_quota") / F.col("_words"))).otherwise(F.lit(0)).cast("long"))
    units = units.withColumn("_lack", F.col("_quota") - F.col("_whole") * F.col("_words")).withColumn("_more", F.lit(False))
    laid = Window.partitionBy(*shard).orderBy(F.xxhash64(F.lit(seed + 3), "doc_id"), "doc_id")
    for _ in range(rounds):
        fits = free & ~F.col("_more") & (F.col("size") <= F.col("_lack"))
        upto = F.sum(F.when(fits, F.col("size")).otherwise(0)).over(laid.rowsBetween(Window.unboundedPreceding, 0))
        units = units.withColumn("_now", fits & (upto <= F.col("_lack")))
        units = units.withColumn("_lack", F.col("_lack") - F.sum(F.when(F.col("_now"), F.col("size")).otherwise(0)).over(own))
        units = units.withColumn("_more", F.col("_more") | F.col("_now"))
    times = F.coalesce("_fixed", F.col("_whole") + F.col("_more").cast("long"))
    units = materialize(units.select("doc_id", *shard, "size", times.alias("times"), (free & ~F.col("_more")).alias("_over"), "_lack"))
    shortest = units.where("_over and _lack > 0").groupBy(*shard).agg(F.min(F.struct("size", "doc_id")).alias("_s"), F.first("_lack").alias("_lack"))
    source = Window.partitionBy("source_no")
    upto = F.sum("_s.size").over(source.orderBy(F.xxhash64(F.lit(seed + 4), *shard), "shard").rowsBetween(Window.unboundedPreceding, 0))
    taken_too = shortest.withColumn("_near", 2 * upto - F.col("_s.size") <= 2 * F.sum("_lack").over(source)).where("_near").select("_s.doc_id", F.lit(1).cast("long").alias("_too"))
    counted = units.select("doc_id", "times", F.lit(0).cast("long").alias("_too")).unionByName(taken_too.withColumn("times", F.lit(0).cast("long")))
    return counted.groupBy("doc_id").agg((F.max("times") + F.sum("_too")).cast("int").alias("times"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
