"""Mix sources to target shares of all tokens by balanced sampling (cube method).

The mixture aims at as many tokens as all documents of listed sources have. Each
source needs its share of them: every document is used ``floor(need / tokens)``
times and once more with the remaining probability, but never more than
``max_repeats`` times. The extra use is drawn by the cube method: probabilities
move along the null space of the balancing constraints (number of documents,
number of tokens) until one of them is 0 or 1. This flight runs in hash blocks
of a source, keeps about ``OPEN`` documents per block undecided, and is repeated
over those left until they fit one block per source; the landing settles the
last ones by the smallest deviation in tokens among all their combinations.

A source that cannot reach its share has all its documents used ``max_repeats``
times, and the others do not make up for it: shares are of the goal. With
``keep_shares`` the goal is the largest total at which every source that has
tokens reaches its share.

Defined results: documents whose source is null or not listed are left out;
null and empty texts have 0 tokens and are drawn without changing any share; a
source without documents has 0 tokens and cannot reach its share; documents are
told apart by key, repeated rows with equal keys count as documents of their
own; an empty table gives a report with shares of null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.session import materialize

#: Documents per block of the flight, and undecided documents a landing takes.
BLOCK = 5000
#: Documents a block keeps undecided for the landing, which tries all 2^n combinations of those left.
OPEN = 14
EDGE = 1e-9


def flight(weights: np.ndarray, chances: np.ndarray, rng: np.random.Generator, keep: int = 0) -> np.ndarray:
    """Flight phase for the constraints (1, weight). Three undecided units at a time move along the null space of their 2 x 3 constraint matrix; ``keep`` random units are left out of it, and at most two others stay undecided."""
    out = chances.astype(float).copy()
    order = rng.permutation(np.flatnonzero((out > EDGE) & (out < 1 - EDGE)))[keep:]
    pool: list[int] = []
    draws = rng.random(2 * len(out) + 4)
    used = 0
    w = weights.astype(float).tolist()
    p = out.tolist()
    for unit in order.tolist():
        if p[unit] <= EDGE or p[unit] >= 1 - EDGE:
            continue
        pool.append(unit)
        while True:
            if len(pool) == 3:
                a, b, c = pool
                u = (w[b] - w[c], w[c] - w[a], w[a] - w[b])
                if u == (0.0, 0.0, 0.0):
                    u = (1.0, -1.0, 0.0)
            elif len(pool) == 2 and w[pool[0]] == w[pool[1]]:
                u = (1.0, -1.0)
            else:
                break
            up = down = float("inf")
            for x, d in zip(pool, u):
                if d > 0:
                    up, down = min(up, (1 - p[x]) / d), min(down, p[x] / d)
                elif d < 0:
                    up, down = min(up, p[x] / -d), min(down, (1 - p[x]) / -d)
            step = up if draws[used % len(draws)] < down / (up + down) else -down
            used += 1
            for x, d in zip(pool, u):
                p[x] += step * d
            left = [x for x in pool if EDGE < p[x] < 1 - EDGE]
            if len(left) == len(pool):  # rounding: settle the unit nearest to an edge
                nearest = min(pool, key=lambda x: min(p[x], 1 - p[x]))
                p[nearest] = float(round(p[nearest]))
                left.remove(nearest)
            pool = left
    out = np.array(p)
    out[out <= EDGE] = 0.0
    out[out >= 1 - EDGE] = 1.0
    return out


def landing(weights: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Settle the few undecided units so that the tokens deviate least, the number of documents second."""
    out = chances.copy()
    open_ = np.flatnonzero((out > EDGE) & (out < 1 - EDGE))
    if len(open_):
        want_w, want_n = (weights[open_] * out[open_]).sum(), out[open_].sum()
        every = (np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_))[None, :]) & 1
        off_w, off_n = np.abs(every @ weights[open_] - want_w), np.abs(every.sum(1) - want_n)
        out[open_] = every[np.lexsort((off_n, np.rint(off_w)))[0]]
    return out


def _step(keep: int, land: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "n_tokens"], kind="stable")
        seed = int(pd.util.hash_pandas_object(frame[["key"]].head(1), index=False).iloc[0]) % 2**32 + len(frame) if len(frame) else 0
        weights, chances = frame["n_tokens"].to_numpy(float), frame["chance"].to_numpy(float)
        moved = flight(weights, chances, np.random.default_rng(seed), keep)
        return frame.assign(chance=landing(weights, moved) if land else moved)

    return run


def needs(documents: DataFrame, targets: DataFrame, keep_shares: bool = False) -> DataFrame:
    """Per listed source: tokens, documents and the tokens it needs of ``all_tokens``."""
    have = documents.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))
    joined = targets.join(have, "source", "left").fillna(0, ["source_tokens", "source_docs"])
    total = F.sum("source_tokens")
    if keep_shares:
        total = F.least(total, F.min(F.when((F.col("source_tokens") > 0) & (F.col("target_pct") > 0), F.col("max_repeats") * F.col("source_tokens") * 100 / F.col("target_pct"))))
    return joined.crossJoin(F.broadcast(joined.agg(total.alias("all_tokens")))).withColumn("need_tokens", F.col("target_pct") * F.col("all_tokens") / 100)


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", keep_shares: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). In the report a source is ``exhausted`` if all its documents are used as often as they may be and its tokens still fall short. ``documents`` has the key, ``source`` and ``n_tokens``; the mixture has key, source, n_tokens and copies ≥ 1."""
    kind = dict(documents.dtypes)[key]
    # the key travels as text: a null would turn whole numbers into floats on the way through Python
    sized = documents.select(F.col(key).cast("string").alias("key"), "source", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
    sized = materialize(sized, "sized")  # else the token counts would be worked out for the needs and again for the draw
    targets = targets.where(F.col("source").isNotNull()).fillna(0, ["target_pct", "max_repeats"])
    need = materialize(needs(sized, targets, keep_shares), "needs")
    # a source whose documents have no tokens uses them all as often as it may
    uses = F.least(F.coalesce(F.try_divide("need_tokens", "source_tokens"), F.lit(float("inf"))), F.col("max_repeats").cast("double"))
    rates = need.select("source", F.floor(uses).alias("whole"), (uses - F.floor(uses)).alias("chance"), F.ceil(F.col("source_docs") / BLOCK).alias("blocks"))
    # one row per listed source: Spark broadcasts it by its measured size
    drawn = sized.join(rates, "source").withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.greatest("blocks", F.lit(1))))
    sure = drawn.where(F.col("chance") <= EDGE).select("key", "source", "n_tokens", F.col("whole").alias("copies"))
    flying = drawn.where(F.col("chance") > EDGE).select("key", "source", "n_tokens", "whole", "chance", "block")
    schema = "key string, source string, n_tokens long, whole long, chance double, block long"
    parts, level = [], 1
    while True:
        moved = materialize(flying.groupBy("source", "block").applyInPandas(_step(OPEN, False), schema), "flight")
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        parts.append(moved.where(~open_))
        rest = moved.where(open_)
        sizes = rest.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        level += 1
        if sizes.where("blocks > 1").isEmpty():
            parts.append(rest.withColumn("block", F.lit(0).cast("long")).groupBy("source").applyInPandas(_step(OPEN, True), schema))
            break
        flying = rest.join(sizes, "source").withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), F.col("blocks"))).drop("blocks")
    mixture = sure
    for part in parts:
        mixture = mixture.unionByName(part.select("key", "source", "n_tokens", (F.col("whole") + F.col("chance").cast("long")).alias("copies")))
    mixture = materialize(mixture.where("copies > 0"), "mixture")
    got = mixture.join(targets.select("source", F.col("max_repeats").alias("_most")), "source").groupBy("source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("actual_tokens"), F.sum("copies").alias("actual_docs"), F.max("copies").alias("most_copies"), F.count_if(F.col("copies") >= F.col("_most")).alias("used_up")
    )
    report = need.join(got, "source", "left").fillna(0, ["actual_tokens", "actual_docs", "most_copies", "used_up"])
    used_up = (F.col("used_up") == F.col("source_docs")) | (F.col("max_repeats") <= 0)
    report = report.withColumn("exhausted", used_up & (F.col("actual_tokens") * 100 < F.col("target_pct") * F.col("all_tokens")))
    everything = F.sum("actual_tokens").over(Window.partitionBy(F.lit(0)))  # over the listed sources only
    report = report.select("source", "target_pct", "max_repeats", "source_docs", "source_tokens", F.col("need_tokens"), "actual_docs", "actual_tokens", "most_copies", (100 * F.try_divide("actual_tokens", "all_tokens")).alias("pct_of_goal"), (100 * F.try_divide("actual_tokens", everything)).alias("actual_pct"), "exhausted")
    return mixture.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key), report
