"""Texts into containers of fixed capacity, every container mixed to the target token proportions.

Shards of documents are packed independently; a shard is a bounded number of tokens, however many documents or
sources there are, and only ids, sources and sizes travel. In a shard each source has a queue; a window (one
container) is filled by deficit round-robin: each source earns its share of the window's tokens, and of the texts
that fit the one is taken that brings a source nearest to what it has earned. When none does, the window is closed
with the largest texts that fit; what a source lacks or has too much carries over to the next window. What a shard
can't balance is carried to the next shard: its starting credits are the running difference of the shards before it.

Every text gets a place. One larger than a whole container is split, in pieces of full capacity and a rest; no
other is. Null texts and texts without tokens need no place and give no row.

Whole texts set a floor: a text larger than its source's share of a window puts that window off by the rest, wherever
it is placed. mixture() reports this floor beside the distances reached, of single windows and of runs of windows.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread
from .tokens import VOCABULARY, count_tokens, source_name

#: Tokens of a shard, at least this many containers of the largest capacity.
SHARD_TOKENS, SHARD_CONTAINERS = 2_000_000, 100
#: Shards per block of a running sum, and windows per run in the report.
BLOCK, RUN = 2048, 8


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of the texts that have any."""
    rows = spread(documents.where(F.col("text").isNotNull()).select("doc_id", "source", "text"))
    sized = rows.select("doc_id", F.coalesce(source_name("source"), F.lit("")).alias("source"), count_tokens("text", vocabulary).alias("tokens"))
    return sized.where(F.col("tokens") > 0)


class _Queue:
    """A source's texts by size, its pieces that fill a whole window, and what it has earned."""

    def __init__(self, credit: float) -> None:
        self.texts: list[tuple] = []
        self.full: list[tuple] = []
        self.credit = credit

    def nearest(self, left: int) -> list[int]:
        """Places of the texts next below and above the credit among those that fit."""
        fits = bisect_right(self.texts, left, key=lambda x: x[0])
        below = bisect_right(self.texts, self.credit, hi=fits, key=lambda x: x[0]) - 1
        return [k for k in (below, below + 1) if 0 <= k < fits]


def fill(items: list[tuple[int, str, int]], capacity: int, shares: dict[str, float], credit: dict[str, float]):
    """Yield (container, position, doc, piece, first_token, tokens) for items (doc, source, tokens)."""
    queues: dict[str, _Queue] = {}
    for doc, source, tokens in items:
        queue = queues.setdefault(source, _Queue(credit.get(source, 0.0)))
        piece = first = 0
        while tokens - first > capacity:
            queue.full.append((capacity, doc, piece, first))
            piece, first = piece + 1, first + capacity
        queue.texts.append((tokens - first, doc, piece, first))
    for queue in queues.values():
        queue.texts.sort(key=lambda x: x[0])
    window = 0
    while queues:
        for source, queue in queues.items():
            queue.credit += shares.get(source, 0.0) * capacity
        # A piece that fills a window goes when its source has earned half of it, or nothing else is left.
        whole = [s for s, q in queues.items() if q.full]
        due = [s for s in whole if queues[s].credit >= capacity / 2] or ([] if any(q.texts for q in queues.values()) else whole)
        left, position = capacity, 0
        while left:
            if due:
                source, taken = max(due, key=lambda s: (queues[s].credit, s)), None
                taken = queues[source].full.pop()
            else:
                best, source, at = None, None, None
                for s, q in queues.items():
                    for k in q.nearest(left):
                        key = (abs(q.credit) - abs(q.credit - q.texts[k][0]), q.credit, s)
                        if best is None or key > best:
                            best, source, at = key, s, k
                if best is None:
                    break
                if best[0] <= 0:
                    # No text brings a source nearer: the window is closed as full as can be.
                    fits = ((bisect_right(q.texts, left, key=lambda x: x[0]) - 1, s, q) for s, q in queues.items())
                    _, _, source, at = max((q.texts[k][0], q.credit, s, k) for k, s, q in fits if k >= 0)
                taken = queues[source].texts.pop(at)
            tokens, doc, piece, first = taken
            yield window, position, doc, piece, first, tokens
            queue = queues[source]
            queue.credit -= tokens
            left, position = left - tokens, position + 1
            if not queue.texts and not queue.full:
                del queues[source]
        window += 1


PACKED = "container_name string, shard int, container_no bigint, position int, doc_id bigint, piece int, first_token int, tokens int"
#: In the groups ids are text: pandas would make numbers with nulls among them floating.
_GROUP = PACKED.replace("doc_id bigint", "doc_id string")


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    name, shard, capacity = pdf.container_name.iloc[0], int(pdf.shard.iloc[0]), int(pdf.capacity.iloc[0])
    per_source = pdf.groupby("source")[["share", "credit"]].first()
    items = list(zip(pdf.doc_id.tolist(), pdf.source.tolist(), pdf.tokens.tolist()))
    items.sort(key=lambda x: (x[2], x[0] or ""))
    rows = [(name, shard, *r) for r in fill(items, capacity, dict(per_source.share), dict(per_source.credit))]
    return pd.DataFrame(rows, columns=["container_name", "shard", "container_no", "position", "doc_id", "piece", "first_token", "tokens"])


def running_sum(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """value summed over the rows of the key before this one (0 for the first), order being a whole number per row.

    In two levels, blocks of BLOCK numbers and rows inside them, so that no key is summed up in one task.
    """
    blocks = df.withColumn("__block", F.floor(F.col(order) / F.lit(BLOCK)))
    outer = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(key, "__block").agg(F.sum(value).alias("__sum"))
    sums = sums.select(key, "__block", F.coalesce(F.sum("__sum").over(outer), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum(value).over(inner), F.lit(0))
    return blocks.withColumn("__inside", inside).join(sums, [key, "__block"]).withColumn(name, F.col("__base") + F.col("__inside")).drop("__block", "__base", "__inside")


def _shares(by_source: DataFrame, shares: DataFrame | None) -> DataFrame:
    """(source, share) that sum to 1: those wanted, or the corpus' own."""
    if shares is not None:
        wanted = shares.select(source_name("source").alias("source"), F.col("target_share").cast("double").alias("share")).where(F.col("share") > 0)
        by_source = by_source.select("source").join(wanted.groupBy("source").agg(F.sum("share").alias("share")), "source", "left").fillna(0.0, ["share"])
    total = by_source.agg(F.sum("share")).first()[0] or 1.0
    return by_source.select("source", (F.col("share") / F.lit(float(total))).alias("share"))


def pack(documents: DataFrame, containers: DataFrame, shares: DataFrame | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per text or piece and container type; container_no is unique together with container_name and shard.

    shares (source, target_share) are the proportions; without them those of the corpus, which all windows can meet.
    """
    return pack_sized(sizes(documents, vocabulary), containers, shares)


def pack_sized(sized: DataFrame, containers: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """pack() of rows (doc_id, source, tokens), one per use of a text."""
    spark = sized.sparkSession
    # A parameter table: each of its rows asks for a packing of the whole corpus.
    capacities = {r[0]: r[1] for r in containers.select("container_name", "capacity_tokens").where(F.col("capacity_tokens") > 0).collect()}
    if not capacities:
        return spark.createDataFrame([], PACKED)
    sized = cut(sized)
    total = sized.agg(F.sum("tokens").cast("bigint")).first()[0] or 0
    shard_tokens = max(SHARD_TOKENS, SHARD_CONTAINERS * max(capacities.values()))
    shards = max(1, round(total / shard_tokens))
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tokens", F.lit(7)), F.lit(shards)).cast("int"))
    by_shard = sized.groupBy("shard", "source").agg(F.sum("tokens").cast("double").alias("shard_tokens"))
    by_source = _shares(by_shard.groupBy("source").agg(F.sum("shard_tokens").alias("share")), shares)
    shard_total = by_shard.groupBy("shard").agg(F.sum("shard_tokens").alias("all_tokens"))
    # Running difference, over the shards before, of what a source should have had and what it had.
    missed = by_shard.join(by_source, "source").join(shard_total, "shard").withColumn("missed", F.col("all_tokens") * F.col("share") - F.col("shard_tokens"))
    credits = running_sum(missed, "source", "shard", "missed", "credit").select("shard", "source", "share", "credit")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("container_name"), F.lit(c).alias("capacity")) for n, c in capacities.items()])).alias("c")
    placed = sized.join(credits, ["shard", "source"]).select(F.col("doc_id").cast("string").alias("doc_id"), "source", "tokens", "shard", "share", "credit", each)
    packed = placed.select("*", "c.*").drop("c").groupBy("container_name", "shard").applyInPandas(_pack_shard, _GROUP)
    return packed.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def mixture(packed: DataFrame, sources: DataFrame, containers: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Per container type: how far windows are from the proportions, as the share of their tokens that is of another source than it should be.

    sources (doc_id, source) are the packed texts'. mean_distance is over single windows, mean_run_distance over runs
    of RUN consecutive ones, least_distance what no packing of whole texts can go below.
    """
    rows = packed.join(sources.select("doc_id", "source").distinct(), "doc_id")
    wanted = _shares(rows.groupBy("source").agg(F.sum("tokens").cast("double").alias("share")), shares)
    base = rows.groupBy("container_name", "shard", "container_no", "source").agg(F.sum("tokens").alias("t"))

    def distance(parts: DataFrame, keys: list[str], name: str) -> DataFrame:
        # What is over in some sources is missing in others: the overhang alone is the distance.
        per = parts.groupBy(*keys, "source").agg(F.sum("t").alias("t"))
        sums = parts.groupBy(*keys).agg(F.sum("t").alias("all"))
        over = F.greatest(F.col("t") - F.col("share") * F.col("all"), F.lit(0.0))
        each = per.join(sums, keys).join(wanted, "source").groupBy(*keys).agg((F.sum(over) / F.max("all")).alias("d"))
        return each.groupBy("container_name").agg(F.round(F.avg("d"), 4).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    one = distance(base, ["container_name", "shard", "container_no"], "mean_distance")
    runs = distance(base.withColumn("run", F.floor(F.col("container_no") / F.lit(RUN))), ["container_name", "shard", "run"], "mean_run_distance")
    capacity = containers.select("container_name", F.col("capacity_tokens").alias("capacity"))
    over = F.greatest(F.col("tokens") - F.col("share") * F.col("capacity"), F.lit(0.0))
    least = rows.join(wanted, "source").join(capacity, "container_name").groupBy("container_name").agg(F.sum(over).alias("over"), F.max("capacity").alias("capacity"))
    out = one.join(runs, "container_name").join(least, "container_name")
    return out.select(
        "container_name", F.col("n_mean_distance").alias("n_windows"), "mean_distance", "mean_run_distance",
        F.round(F.col("over") / (F.col("n_mean_distance") * F.col("capacity")), 4).alias("least_distance"),
    )


def report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container type: number of containers, tokens, share of the capacity used, texts that were split."""
    used = packed.groupBy("container_name", "shard", "container_no").agg(F.sum("tokens").alias("t"), F.count(F.when(F.col("piece") > 0, 1)).alias("p"))
    summed = used.groupBy("container_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").cast("bigint").alias("n_tokens"), F.sum("p").cast("bigint").alias("n_extra_pieces"))
    return summed.join(containers, "container_name").select(
        "container_name", "capacity_tokens", "n_containers", "n_tokens", "n_extra_pieces",
        F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill"),
    )
