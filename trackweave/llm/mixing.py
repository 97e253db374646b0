"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .exact_dedup import row_key
from .storage import materialise, whole_row

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_DOCS = 512
MOST_BLOCKS = 65_536
LEAST_SHARDS = 64
SHARD_WORDS = 5_000_000
SEED = 17
LARGEST_TABLE = 16_000_000
GROUP_BLOCKS = 131_072


def target_table(sized: DataFrame) -> DataFrame:
    """Per source: n_docs, source_size and target.

    Sources take the weights in turn, by code point with null last; the targets share SHARE of all sizes, none
    above MOST times its source. With the sources in order of size per weight, those before the first that
    stays below its limit are at theirs, and the others share what is left by weight.
    """
    sources = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    ranked = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = ranked.rowsBetween(W.unboundedPreceding, -1), ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        sources.withColumn("weight", weight)
        .withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST)
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("rate", (F.sum("source_size").over(everything) * SHARE - F.col("full")) / F.col("open"))
        .withColumn("nth", F.row_number().over(ranked))
        .withColumn("fits", F.col("rate") * F.col("weight") <= F.col("source_size") * MOST)
    )
    rate = F.min_by("rate", F.when(F.col("fits"), F.col("nth"))).over(everything)
    return level.withColumn("rate", rate).select(
        "source", "n_docs", "source_size", F.least(F.col("rate") * F.col("weight"), F.col("source_size") * MOST * F.lit(1.0)).alias("target")
    )


def splitting_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources), with exact totals.

    Each node's quotas are split between its halves by a multivariate hypergeometric draw: the left half gets
    the blocks that a random deal without replacement would give it.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(lo: int, hi: int, own: np.ndarray, node: int) -> None:
        if hi - lo == 1:
            out[lo] = own
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, node]))
        left = rng.multivariate_hypergeometric(own, int(own.sum()) * (mid - lo) // (hi - lo), method="marginals")
        split(lo, mid, left, 2 * node)
        split(mid, hi, own - left, 2 * node + 1)

    if len(quotas):
        split(0, shards, np.asarray(quotas, dtype=np.int64), 1)
    return out


def group_shares(quotas: np.ndarray, totals: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per shard with blocks: its number, sources and how many of their blocks; ``totals`` says how many blocks of all sources each shard gets.

    The same draws as in ``splitting_tree``, given what each node of the tree gets in all. A node knows only the sources that have
    blocks there, so the work follows the blocks and not sources x shards.
    """
    cum = np.concatenate(([0], np.cumsum(totals)))
    at = np.flatnonzero(quotas)
    nodes = [(0, len(totals), at, np.asarray(quotas, dtype=np.int64)[at], 1)]
    while nodes:
        lo, hi, at, own, node = nodes.pop()
        if not len(at):
            continue
        if hi - lo == 1:
            yield lo, at, own
            continue
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, node]))
        left = rng.multivariate_hypergeometric(own, int(cum[mid] - cum[lo]), method="marginals")
        for part in ((mid, hi, own - left, 2 * node + 1), (lo, mid, left, 2 * node)):
            some = part[2] > 0
            nodes.append((*part[:2], at[some], part[2][some], part[3]))


def shard_ranges(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """The splitting tree over any number of sources (group, source, n): rows of, shard, first, last; ``of`` has its blocks first..last there.

    The driver knows the number of blocks of groups of sources only. Their tree gives each group's blocks per shard, and in each group's
    task the same tree deals these to its sources; given its sum, a part of a multivariate hypergeometric draw is such a draw again.
    """
    groups = sorted(tuple(r) for r in quotas.groupBy("group").agg(F.sum("n")).collect())
    place = {g: i for i, (g, _) in enumerate(groups)}
    sums = np.array([n for _, n in groups], dtype=np.int64)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", na_position="last", ignore_index=True)
        k = place[int(rows["group"][0])]
        parts = list(group_shares(rows["n"].to_numpy(), splitting_tree(sums, shards, seed)[:, k], (seed << 32) + k + 1))
        at, n = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        shard = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        order = np.argsort(at, kind="stable")
        at, n, shard = at[order], n[order], shard[order]
        end = np.cumsum(n)
        first = end - n - (np.cumsum(rows["n"].to_numpy()) - rows["n"].to_numpy())[at]
        return pd.DataFrame({"of": rows["source"].to_numpy()[at], "shard": shard, "first": first, "last": first + n - 1})

    return quotas.groupBy("group").applyInPandas(run, "of string, shard int, first long, last long")


def row_draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = SEED) -> DataFrame:
    """``mixing_plan`` with the key of each row by its id and text.

    A draw is one time that the mix takes the document, into a shard, at a random place there. Documents of
    a source stand in blocks, in an order that hashes of their ids give; the mix takes them in this order, a second
    time after the first ended, while the middle of a document lies before the target. So a source's taken
    words come within half a document of its target and no document is taken more than MOST times. The
    draws of blocks are dealt to shards by the splitting tree; a shard's blocks of a source are disjoint ranges of
    its permuted blocks. Blocks keep every window bounded: no source is sorted by one task.

    Without a given number of ``shards`` there is one per SHARD_WORDS of the mix, LEAST_SHARDS at least.
    Null text has size 0, a null source is a source of its own. Rows that repeat an id are separate documents
    with the same hash. Groups of sources share the tree's work, about GROUP_BLOCKS blocks each; with so many shards
    that groups times shards would exceed LARGEST_TABLE, the groups are larger.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    sized = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
            key.alias("key"),
            row_key(F.col(id_col), F.col(text_col)).alias("row"),
        ),
        "sizes",
    )
    sources = materialise(target_table(sized), "targets")
    mixed_words = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    shards = shards or max(LEAST_SHARDS, round(mixed_words / SHARD_WORDS))
    s = sources.withColumnRenamed("source", "of")
    number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    blocks = F.least(F.ceil(F.col("n_docs") / BLOCK_DOCS), F.lit(MOST_BLOCKS))
    rows = sized.join(s, sized.source.eqNullSafe(s.of)).withColumn("block", number % blocks).drop("of", "n_docs")
    per_block = rows.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    per_block = per_block.withColumn("begin", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    drawn = per_block.select("source", "block", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("turn"), "begin", "source_size", "target").filter(
        F.col("turn") * F.col("source_size") + F.col("begin") <= F.col("target")
    )
    permuted = F.md5(F.concat_ws("|", F.lit(str(seed)), "turn", "block"))
    drawn = materialise(drawn.withColumn("nth", F.row_number().over(W.partitionBy("source").orderBy(permuted, "turn", "block")) - 1).select("source", "block", "turn", "nth"), "draws")
    groups = max(1, min(-(-drawn.count() // GROUP_BLOCKS), LARGEST_TABLE // shards))
    group = F.pmod(F.xxhash64("source"), F.lit(groups)).alias("group")
    quotas = materialise(drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(group, "source", "n"), "quotas")
    deal = shard_ranges(quotas, shards, seed).select("of", "shard", F.explode(F.sequence("first", "last")).alias("at"))
    dealt = (
        drawn.join(deal, drawn.source.eqNullSafe(deal.of) & (F.col("nth") == F.col("at")))
        .groupBy("source", "block")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "shard"))).alias("turns"))
    )
    d = per_block.select("source", "block", "begin").join(dealt.withColumnsRenamed({"source": "s2", "block": "b2"}), F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")), "left")
    d = d.select(F.col("source").alias("of"), F.col("block").alias("in_block"), "begin", "turns")
    at = F.col("begin") + F.coalesce(F.sum("size").over(W.partitionBy("source", "block").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("size") / 2
    placed = rows.join(d, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in_block"))).withColumn("at", at)
    taken = F.filter(F.coalesce("turns", F.array().cast("array<struct<turn:int,shard:int>>")), lambda t: t.turn * F.col("source_size") + F.col("at") <= F.col("target"))
    draws = F.transform(taken, lambda t: F.struct(t.shard.alias("shard"), F.md5(F.concat_ws("|", "key", t.turn.cast("string"))).alias("place")))
    return placed.select("doc_id", "size", "source_size", "target", draws.alias("draws"), "row")


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, draws array<struct<shard, place>>, as ``row_draws`` tells."""
    return row_draws(docs, id_col, text_col, source_col, shards, seed).drop("row")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixed rows of ``docs``, with all their columns, shard by shard and shuffled inside each.

    Each row comes as often as ``row_draws`` takes it. Rows are told apart by id and text; of rows that repeat both, one is written for each
    draw of any of them. Null text has no words and is taken like any row of size 0; nulls in other columns, and columns of any names, are passed on;
    an empty table gives an empty one.
    """
    drawn = row_draws(docs, id_col, text_col, source_col, shards, seed).filter(F.size("draws") > 0).select(F.col("row").alias("of"), F.explode("draws").alias("draw"))
    rows = docs.select(whole_row(docs), row_key(F.col(id_col), F.col(text_col)).alias("row")).dropDuplicates(["row"])
    mixed = rows.join(drawn, F.col("row") == F.col("of"))
    return mixed.repartition("draw.shard").sortWithinPartitions("draw.shard", "draw.place").select("doc.*")
