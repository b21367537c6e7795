"""Fill containers of fixed capacity with documents, with little unused space.

Large-item matching: documents above a third of the capacity are matched
greedily, at most two to a container; smaller ones go, largest first, where they
leave the smallest gap (best fit). All of it runs on the histogram of item
sizes, which has at most ``capacity`` rows however many documents there are, and
treats runs of equal items and equal gaps at once. The plan says which ranks of
a size go to which containers; documents are ranked within their size in hash
buckets and looked up in the plan.

Defined results: a document of more tokens than the capacity is cut into full
containers and a remainder, which is packed like any item; nothing else is cut.
Null and empty texts have no tokens and take no container. Repeated rows are
items of their own. An empty table gives no containers.
"""

from __future__ import annotations

import bisect
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.operators.ranking import bucketed_rank
from cohortlab.session import materialize


class Plan:
    """Runs (size, first rank, count, first container, items per container)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.runs, self.next_bin = capacity, [], 0
        self.used: dict[int, int] = defaultdict(int)

    def put(self, size: int, count: int, first_bin: int, per_bin: int = 1) -> None:
        self.runs.append((size, self.used[size], count, first_bin, per_bin))
        self.used[size] += count

    def open(self, bins: int) -> int:
        first, self.next_bin = self.next_bin, self.next_bin + bins
        return first


def pack_histogram(counts: dict[int, int], capacity: int) -> Plan:
    """Pack ``counts`` items of each size 1..capacity. The work depends on the number of distinct sizes, not of items."""
    plan = Plan(capacity)
    left = {s: n for s, n in counts.items() if n > 0}
    gaps: dict[int, deque] = defaultdict(deque)  # free space → runs of containers (first, count)
    large = sorted(s for s in left if 3 * s > capacity)
    # greedy matching: the largest item takes the largest one that still fits beside it
    while large:
        size = large[-1]
        n = left[size]
        at = bisect.bisect_right(large, capacity - size) - 1
        if at < 0:
            gaps[capacity - size].append((first := plan.open(n), n))
            plan.put(size, n, first)
            large.pop()
            continue
        other = large[at]
        if other == size:
            pairs = n // 2
            if pairs:
                gaps[capacity - 2 * size].append((first := plan.open(pairs), pairs))
                plan.put(size, 2 * pairs, first, 2)
                left[size] -= 2 * pairs
            if left[size]:  # an odd one: its partner is the next smaller size
                if at == 0:
                    gaps[capacity - size].append((first := plan.open(1), 1))
                    plan.put(size, 1, first)
                    large.pop()
                    continue
                other = large[at - 1]
                pairs = 1
            else:
                large.pop()
                continue
        else:
            pairs = min(n, left[other])
        gaps[capacity - size - other].append((first := plan.open(pairs), pairs))
        plan.put(size, pairs, first)
        plan.put(other, pairs, first)
        for s in (size, other):
            left[s] -= pairs
            if not left[s]:
                large.remove(s)
    levels = sorted(g for g in gaps if g > 0)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[size]
        at = bisect.bisect_left(levels, size)
        while n and at < len(levels):
            gap = levels[at]
            runs = gaps[gap]
            per = gap // size
            while n and runs:
                first, bins = runs.popleft()
                full = min(bins, n // per)
                if full:  # whole containers of the run take as many as fit
                    plan.put(size, full * per, first, per)
                    n -= full * per
                    _give(gaps, levels, gap - per * size, first, full)
                if full < bins:
                    if n:  # the last few items share one container
                        plan.put(size, n, first + full, n)
                        _give(gaps, levels, gap - n * size, first + full, 1)
                        n, full = 0, full + 1
                    if full < bins:
                        runs.appendleft((first + full, bins - full))
            if not runs:
                levels.remove(gap)
                gaps.pop(gap)
            at = bisect.bisect_left(levels, size)
        if n:
            per = capacity // size
            full = n // per
            if full:
                plan.put(size, full * per, first := plan.open(full), per)
                _give(gaps, levels, capacity - per * size, first, full)
            if n - full * per:
                rest = n - full * per
                plan.put(size, rest, first := plan.open(1), rest)
                _give(gaps, levels, capacity - rest * size, first, 1)
    return plan


def _give(gaps: dict[int, deque], levels: list[int], gap: int, first: int, bins: int) -> None:
    if gap > 0:
        if gap not in gaps or not gaps[gap]:
            if gap not in levels:
                bisect.insort(levels, gap)
        gaps[gap].append((first, bins))


def pack(documents: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, n_tokens, piece, piece_tokens, container): where every piece of every document goes.

    ``documents`` has the key and the size. Full pieces of oversized documents
    get containers numbered below zero, by a rank of their own.
    """
    spark = documents.sparkSession
    sized = documents.where(F.col(size) > 0).select(key, size)
    full, rest = F.col(size) / capacity, F.col(size) % capacity
    over = F.col(size) > capacity
    items = materialize(sized.withColumn("item", F.when(over, rest).otherwise(F.col(size)).cast("int")).withColumn("n_full", F.when(over, F.floor(full)).otherwise(0).cast("long")), "items")
    histogram = {r["item"]: r["n"] for r in items.where("item > 0").groupBy("item").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = pack_histogram(histogram, capacity)
    runs = defaultdict(list)
    for s, rank, count, first, per in plan.runs:
        runs[s].append((rank, first, per))
    table = {s: tuple(np.array(column, dtype=np.int64) for column in zip(*sorted(found))) for s, found in runs.items()}
    shared = spark.sparkContext.broadcast(table)  # runs of the plan: bounded by the distinct sizes, not by the documents

    @F.pandas_udf("long")
    def container(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        plan_of = shared.value
        for sizes, ranks in batches:
            out = np.empty(len(sizes), dtype=np.int64)
            size_values, rank_values = sizes.to_numpy(), ranks.to_numpy()
            order = np.argsort(size_values, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(size_values[order]) != 0]) if len(order) else []
            for begin, end in zip(starts, [*starts[1:], len(order)]):
                at = order[begin:end]
                lows, firsts, pers = plan_of[int(size_values[at[0]])]
                run = np.searchsorted(lows, rank_values[at], side="right") - 1
                out[at] = firsts[run] + (rank_values[at] - lows[run]) // pers[run]
            yield pd.Series(out)

    ranked = bucketed_rank(items.where("item > 0"), ["item"], [key], "_rank")
    last = ranked.select(key, size, F.col("n_full").alias("piece"), F.col("item").cast("long").alias("piece_tokens"), container("item", "_rank").alias("container"))
    whole = bucketed_rank(items.where("n_full > 0"), ["n_full"], [key], "_rank")
    # full pieces: containers are numbered -1, -2, ... by size class, rank and piece
    classes = whole.groupBy("n_full").agg(F.count(F.lit(1)).alias("_n"))
    before = classes.select(F.col("n_full").alias("_c"), (F.coalesce(F.expr("sum(_n * n_full) over (order by n_full rows between unbounded preceding and 1 preceding)"), F.lit(0))).alias("_before"))
    pieces = (
        whole.join(before, F.col("n_full") == F.col("_c"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("n_full") - 1)).alias("piece"))
        .select(key, size, "piece", F.lit(capacity).cast("long").alias("piece_tokens"), (-1 - (F.col("_before") + F.col("_rank") * F.col("n_full") + F.col("piece"))).alias("container"))
    )
    return last.unionByName(pieces)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, pieces, tokens and the share of space left unused."""
    bins = packed.groupBy("container").agg(F.sum("piece_tokens").alias("filled"), F.count(F.lit(1)).alias("pieces"))
    return bins.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("pieces").alias("pieces"),
        F.sum("filled").alias("tokens"),
        F.max("filled").alias("fullest"),
        F.try_subtract(F.lit(1.0), F.try_divide(F.sum("filled"), F.count(F.lit(1)) * capacity)).alias("unused_share"),
    )


def divided(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of the documents whose placed pieces lie in more than one container. Every item has a piece 0, so repeated rows of a small document are not taken for pieces."""
    placed = packed.groupBy(key).agg(F.max("piece").alias("_last"), (F.min("container") != F.max("container")).alias("_apart"))
    return placed.where((F.col("_last") > 0) & F.col("_apart")).select(key)


def verdict(packed: DataFrame, documents: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """One row: documents packed, overfull containers, documents not placed whole or placed twice, documents cut without need, and whether at most a tenth more containers than the least possible (and one) are used. Keys must be unique."""
    bins = packed.groupBy("container").agg(F.sum("piece_tokens").alias("_filled"))
    bins = bins.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("_filled"), F.lit(0)).alias("_tokens"), F.count_if(F.col("_filled") > capacity).alias("overfull"))
    whole = packed.groupBy(key).agg(F.sum("piece_tokens").alias("_placed"), F.count(F.lit(1)).alias("_pieces"))
    joined = documents.where(F.col(size) > 0).select(key, size).join(whole, key, "left")
    per = joined.agg(
        F.count("_placed").alias("documents_packed"),
        F.count_if(~F.col("_placed").eqNullSafe(F.col(size))).alias("not_whole"),
        F.count_if((F.col("_pieces") > 1) & (F.col(size) <= capacity)).alias("needlessly_cut"),
    )
    return per.crossJoin(bins).select("documents_packed", "overfull", "not_whole", "needlessly_cut", (F.col("_n") <= 1 + 1.1 * F.ceil(F.col("_tokens") / capacity)).alias("near_least"))
