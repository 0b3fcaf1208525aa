"""Sources mixed to target shares, as a minimum-cost flow from texts to source quotas.

Equal texts are one unit, whatever ids and sources they have; units with the same set of sources (membership
pattern) are aggregated to their tokens. On this small graph, patterns send tokens to the quotas of their
sources; a further use of the same tokens costs more with each repetition (convex), so small sources repeat
only where quotas ask for it, and a text of several sources goes where it is needed most. The mix is as large
as the caps on repetition let it be with all shares met, or as large as asked for.

The flows are then made out in texts: a seeded hash lines up the units of a pattern, and each flow takes a
stretch of the line, going round it as often as texts repeat. Places on the line are prefix sums over hash
buckets (blocks of them first) and then inside the small buckets, so no pattern is ever sorted or summed in one task.

Null texts, texts without tokens, and sources without a target take no part. A null cap is one use.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread
from .packing import running_sum
from .tokens import VOCABULARY, count_tokens, source_name

SEED = 20
#: Units per bucket of the hash line, on average.
BUCKET = 2000
#: Most membership patterns and target sources the driver's graph may have.
MAX_PATTERNS, MAX_SOURCES = 20_000, 1000


class FlowGraph:
    """Minimum-cost flow by successive shortest paths; integer capacities and costs."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.at: dict[object, list[int]] = {}
        self.index: dict[object, int] = {}
        self.nodes: list[object] = []

    def node(self, name: object) -> int:
        if name not in self.index:
            self.index[name] = len(self.nodes)
            self.nodes.append(name)
            self.at[self.index[name]] = []
        return self.index[name]

    def arc(self, a: object, b: object, room: int, cost: int = 0) -> int:
        u, v = self.node(a), self.node(b)
        for x, y, r, c in ((u, v, room, cost), (v, u, 0, -cost)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, a: object, b: object, most: int) -> int:
        """Send up to `most` from a to b at least cost; the amount sent."""
        s, t, sent = self.node(a), self.node(b), 0
        while sent < most:
            far = {s: 0}
            by: dict[int, int] = {}
            queue, waiting = deque([s]), {s}
            while queue:
                u = queue.popleft()
                waiting.discard(u)
                for e in self.at[u]:
                    v = self.to[e]
                    if self.room[e] > 0 and far[u] + self.cost[e] < far.get(v, 1 << 62):
                        far[v], by[v] = far[u] + self.cost[e], e
                        if v not in waiting:
                            queue.append(v)
                            waiting.add(v)
            if t not in far:
                break
            push, v = most - sent, t
            while v != s:
                push = min(push, self.room[by[v]])
                v = self.to[by[v] ^ 1]
            v = t
            while v != s:
                self.room[by[v]] -= push
                self.room[by[v] ^ 1] += push
                v = self.to[by[v] ^ 1]
            sent += push
        return sent


@dataclass
class Target:
    share: float
    max_repeats: int


def _graph(patterns: dict[tuple[str, ...], int], targets: dict[str, Target], total: int) -> tuple[FlowGraph, dict[tuple, int], int]:
    """The flow network for a mix of `total` tokens, its pattern-source arcs, and what the quotas sum to."""
    g, arcs, wanted = FlowGraph(), {}, 0
    for s, t in sorted(targets.items()):
        quota = int(t.share * total)
        wanted += quota
        g.arc(("source", s), "end", quota)
    for pattern, tokens in sorted(patterns.items()):
        sources = [s for s in pattern if s in targets]
        # A text may be used as often as its most patient source lets it; each further use costs more.
        for r in range(1, max(targets[s].max_repeats for s in sources) + 1):
            g.arc("start", ("pattern", pattern), tokens, r * r)
        for s in sources:
            arcs[pattern, s] = g.arc(("pattern", pattern), ("source", s), tokens * targets[s].max_repeats)
    return g, arcs, wanted


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, Target], total: int | None = None) -> tuple[dict[tuple, int], int]:
    """({(pattern, source): tokens}, tokens in all) of the largest mix, of at most `total` tokens, with all shares met."""
    patterns = {p: t for p, t in patterns.items() if t > 0 and any(s in targets and targets[s].max_repeats > 0 for s in p)}

    def feasible(size: int) -> tuple[bool, FlowGraph, dict]:
        g, arcs, wanted = _graph(patterns, targets, size)
        return g.run("start", "end", wanted) == wanted, g, arcs

    high = sum(t * max(targets[s].max_repeats for s in p if s in targets) for p, t in patterns.items())
    high = min(high, total) if total is not None else high
    low = 0
    if high and feasible(high)[0]:
        low = high
    while high - low > max(1, high // 1_000_000):
        middle = (low + high) // 2
        low, high = (middle, high) if feasible(middle)[0] else (low, middle)
    _, g, arcs = feasible(low)
    return {k: g.room[e ^ 1] for k, e in arcs.items() if g.room[e ^ 1] > 0}, low


def units(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(unit, tokens, members): distinct texts with the lowest doc_id of each target source that has them."""
    wanted = targets.where(F.col("target_share").isNotNull()).select(source_name("source").alias("source")).distinct()
    docs = documents.where(F.col("text").isNotNull() & F.col("source").isNotNull())
    docs = docs.select("doc_id", source_name("source").alias("source"), "text").join(wanted, "source", "left_semi")
    sized = spread(docs).select("doc_id", "source", F.sha2("text", 256).alias("unit"), count_tokens("text", vocabulary).alias("tokens"))
    per_source = sized.where(F.col("tokens") > 0).groupBy("unit", "source").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"))
    members = F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("members")
    return per_source.groupBy("unit").agg(F.first("tokens").cast("bigint").alias("tokens"), members).withColumn("pattern", F.col("members.source"))


def select(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, uses, tokens): each chosen document, how often it is used and its tokens per use."""
    spark = documents.sparkSession
    found = cut(units(documents, targets, vocabulary))
    grouped = found.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    goals = targets.where((F.col("target_share") > 0) & F.col("source").isNotNull()).select(source_name("source"), "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(grouped) > MAX_PATTERNS or len(goals) > MAX_SOURCES:
        raise ValueError("more membership patterns or sources than the flow graph may have")
    sums: dict[tuple, int] = {tuple(r["pattern"]): r["tokens"] for r in grouped}
    goal = {r[0]: Target(r[1], 1 if r[2] is None else r[2]) for r in goals}
    flows, _ = route(sums, goal, total_tokens)
    # Stretches of each pattern's line, one after another; the line is as long as the pattern's tokens.
    stretches, ends = [], {}
    for (pattern, source), tokens in sorted(flows.items()):
        start = ends.get(pattern, 0)
        stretches.append((list(pattern), source, start, start + tokens, sums[pattern]))
        ends[pattern] = start + tokens
    plan = spark.createDataFrame(stretches, "pattern array<string>, source string, low bigint, high bigint, length bigint")
    buckets = max(1, sum(r["n"] for r in grouped) // BUCKET)
    hashed = found.withColumn("h", F.xxhash64("unit", F.lit(seed))).withColumn(
        "bucket", F.floor((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) * F.lit(buckets)).cast("bigint")
    )
    # Unsigned order of h, as in the bucket.
    order = [(F.col("h") < 0).asc(), F.col("h"), F.col("unit")]
    per_bucket = hashed.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("t"))
    offsets = running_sum(per_bucket, "pattern", "bucket", "t", "offset").select("pattern", "bucket", "offset")
    inside = Window.partitionBy("pattern", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, ["pattern", "bucket"])
    placed = placed.withColumn("place", F.col("offset") + F.col("inside"))
    # Times k at which place + k * length lies in the stretch.
    upto = lambda edge: F.ceil((F.col(edge) - F.col("place")) / F.col("length"))
    uses = F.greatest(upto("high"), F.lit(0)) - F.greatest(upto("low"), F.lit(0))
    chosen = placed.join(plan, "pattern").withColumn("uses", uses.cast("int")).where(F.col("uses") > 0)
    doc = F.filter("members", lambda m: m["source"] == F.col("source")).getItem(0)["doc_id"]
    return chosen.select(doc.alias("doc_id"), "source", "uses", "tokens")


def report(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target and actual share of the tokens, documents, tokens, most uses of one document."""
    sums = selected.groupBy("source").agg(
        F.sum(F.col("uses") * F.col("tokens")).alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("uses").alias("most_uses")
    )
    goals = targets.select(source_name("source").alias("source"), "target_share", "max_repeats")
    everything = Window.partitionBy()
    joined = goals.join(sums, "source", "left").fillna(0, ["n_tokens", "n_documents", "most_uses"])
    total = F.sum("n_tokens").over(everything)
    return joined.withColumn("actual_share", F.when(total > 0, F.round(F.col("n_tokens") / total, 6)).otherwise(0.0))
