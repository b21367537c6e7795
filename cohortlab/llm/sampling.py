"""Samples that match target category shares, by swap repair on signature counts.

Records are grouped by category signature, the set of target categories they
have. A sample starts from a random, floor-satisfying choice of signature
counts; then single exchanges (one record of a signature out, one of another
in) are made while they lower the deviation from the targets, until none does.
Only counts are exchanged, so this costs the same for any number of records.
The records themselves are then drawn at random within each signature: hash
buckets are taken whole up to a cut, and only the bucket at the cut is ranked.

Defined results: a record is one distinct non-null key of a batch, however
often it is repeated; rows without a target category make no record available;
a batch without rows gives an empty sample and a report of unmet categories;
a request whose target set is unknown, or without id, gives nothing; a missing
or negative sample size is 0, a missing share or floor is 0; ties among equally
good exchanges go to the lowest signature. Two requests with one id are drawn
as one. A share may be fractional; batches and categories may be of any type.
The report says for each category how many are needed (the larger of the floor
and the share rounded up), available and sampled, whether enough are available,
and whether the need was met, which rounding or the floors of other categories
can prevent even where enough are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.operators.joins import checked_join
from cohortlab.operators.ranking import hash_bucket
from cohortlab.session import materialize

#: Hash buckets of a draw, and records of a group joined in one task.
BUCKETS, TASK_ROWS = 1024, 100_000


def repair(signatures: list[tuple[int, ...]], available: np.ndarray, categories: list[int], pct: np.ndarray, floors: np.ndarray, size: int, seed: int) -> np.ndarray:
    """How many records of each signature to take: at most ``available``, ``size`` in all if there are as many."""
    member = np.array([[c in s for c in categories] for s in signatures], dtype=np.int64).reshape(len(signatures), len(categories))
    available = available.astype(np.int64)
    size = min(size, int(available.sum()))
    floors = np.minimum(floors, available @ member)
    target = pct * size / 100.0
    rng = np.random.default_rng(seed)
    take = np.zeros(len(signatures), dtype=np.int64)

    def draw(mask: np.ndarray, n: int) -> None:
        left = np.where(mask, available - take, 0)
        n = min(n, int(left.sum()))
        if n > 0:
            take[:] += rng.multivariate_hypergeometric(left, n)

    for c in np.argsort(available @ member, kind="stable"):  # rare categories first
        lack = int(floors[c] - take @ member[:, c])
        draw(member[:, c] == 1, min(lack, size - int(take.sum())))
    draw(np.ones(len(signatures), dtype=bool), size - int(take.sum()))

    def cost(counts: np.ndarray) -> np.ndarray:
        # floors weigh more than any deviation from the shares
        return np.abs(counts - target).sum(-1) + 4.0 * size * np.maximum(floors - counts, 0).sum(-1)

    step = member[None, :, :] - member[:, None, :]  # [out, in, category]
    while True:
        counts = take @ member
        best = None
        now = cost(counts)
        # the longest step first: many exchanges at once where they all help
        for many in (1 << k for k in range(max(size, 1).bit_length() - 1, -1, -1)):
            allowed = (take >= many)[:, None] & (available - take >= many)[None, :]
            np.fill_diagonal(allowed, False)
            if not allowed.any():
                continue
            after = np.where(allowed, cost(counts + many * step), np.inf)
            at = int(after.argmin())
            if after.flat[at] < now - 1e-9:
                best = (many, *divmod(at, len(signatures)))
                break
        if best is None:
            return take
        many, out, in_ = best
        take[out] -= many
        take[in_] += many


def sample(requests: DataFrame, records: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    ``requests``: request_id, target_set, batch_id, sample_size. ``records``:
    batch_id, key, category (a row per occurrence). ``targets``: target_set,
    category, target_pct, min_keep. The sample has request_id, batch_id, key;
    the report a row per request and category of its target set.
    """
    signed, counts, solved, kinds = _solved(requests, records, targets)
    quotas = solved.select("request_id", "batch_id", F.explode("quota").alias("_q")).select("request_id", "batch_id", "_q.signature", "_q.take").where("take > 0")
    drawn = draw(signed, quotas, counts)
    return drawn.withColumn("batch_id", F.col("batch_id").cast(kinds["batch_id"])), _report(solved, kinds)


def report(requests: DataFrame, records: DataFrame, targets: DataFrame) -> DataFrame:
    """The report of ``sample`` without drawing the records."""
    _, _, solved, kinds = _solved(requests, records, targets)
    return _report(solved, kinds)


def _solved(requests: DataFrame, records: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, str]]:
    """Records with their signatures, counts per batch and signature, and per request the repaired counts."""
    kinds = {"batch_id": dict(requests.dtypes)["batch_id"], "category": dict(targets.dtypes)["category"]}
    # batches and categories of any type travel as text
    requests, records, targets = (df.withColumns({c: F.col(c).cast("string") for c in kinds if c in df.columns}) for df in (requests, records, targets))
    requests = requests.where(F.col("request_id").isNotNull()).withColumns({"sample_size": F.greatest(F.coalesce("sample_size", F.lit(0)), F.lit(0))})
    targets = targets.where(F.col("category").isNotNull()).fillna(0, ["target_pct", "min_keep"])
    wanted = targets.select("category").distinct()
    # one record per batch and key; the set of a record's categories is no larger than that of all categories
    signed = (
        records.where(F.col("key").isNotNull() & F.col("batch_id").isNotNull())
        .join(requests.select("batch_id").distinct(), "batch_id", "left_semi")
        .join(wanted, "category", "left_semi")
        .groupBy("batch_id", "key")
        .agg(F.array_sort(F.collect_set("category")).alias("signature"))
    )
    signed = materialize(signed, "signed")
    counts = signed.groupBy("batch_id", "signature").agg(F.count(F.lit(1)).alias("n"))
    by_batch = counts.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("signature", "n"))).alias("signatures"))
    sets = targets.groupBy("target_set").agg(F.array_sort(F.collect_list(F.struct("category", "target_pct", "min_keep"))).alias("targets"))
    tasks = requests.select("request_id", "target_set", "batch_id", "sample_size").join(sets, "target_set").join(by_batch, "batch_id", "left")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                found = [] if r.signatures is None else list(r.signatures)
                goal = list(r.targets)
                categories = [t["category"] for t in goal]
                pct, keep = (np.array([t[k] for t in goal], dtype=float) for k in ("target_pct", "min_keep"))
                sets_ = [tuple(c for c in s["signature"] if c in categories) for s in found]
                # signatures with no category of this request's set cannot be sampled for it
                n = np.array([s["n"] if own else 0 for s, own in zip(found, sets_)], dtype=np.int64)
                take = repair(sets_, n, categories, pct, keep, int(r.sample_size), int(r.request_id)) if len(found) else n
                quota = [{"signature": list(s["signature"]), "n": int(a), "take": int(t)} for s, a, t in zip(found, n, take)]
                lines = []
                for t in goal:
                    has = np.array([t["category"] in s for s in sets_], dtype=np.int64)
                    need = max(int(t["min_keep"]), math.ceil(int(r.sample_size) * Fraction(str(t["target_pct"])) / 100))
                    lines.append({"category": t["category"], "need": need, "available": int(n @ has) if len(n) else 0, "sampled": int(take @ has) if len(n) else 0})
                rows.append((r.request_id, r.batch_id, int(take.sum()) if len(n) else 0, quota, lines))
            yield pd.DataFrame(rows, columns=["request_id", "batch_id", "sampled_size", "quota", "lines"])

    schema = "request_id long, batch_id string, sampled_size long, quota array<struct<signature:array<string>,n:bigint,take:bigint>>, lines array<struct<category:string,need:bigint,available:bigint,sampled:bigint>>"
    solved = materialize(tasks.repartition("request_id").mapInPandas(solve, schema), "quotas")
    return signed, counts, solved, kinds


def _report(solved: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return (
        solved.select("request_id", "sampled_size", F.explode("lines").alias("_l"))
        .select("request_id", "sampled_size", "_l.*")
        .withColumn("category", F.col("category").cast(kinds["category"]))
        .withColumn("enough_available", F.col("available") >= F.col("need"))
        .withColumn("met", F.col("sampled") >= F.col("need"))
        .withColumn("short", F.greatest(F.col("need") - F.col("sampled"), F.lit(0)))
        .withColumn("sampled_pct", 100 * F.try_divide("sampled", "sampled_size"))
    )


def draw(signed: DataFrame, quotas: DataFrame, counts: DataFrame) -> DataFrame:
    """``take`` random records of each (request, batch, signature). Groups of more than ``TASK_ROWS`` records are joined in as many salts as their counted size asks for."""
    large = counts.where(F.col("n") > TASK_ROWS).select("batch_id", "signature", F.ceil(F.col("n") / TASK_ROWS).cast("int").alias("_salts"))
    large = materialize(large, "large-groups")
    salted = lambda df: checked_join(df, large, ["batch_id", "signature"], "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    spread = salted(quotas.select("request_id", "batch_id", "signature", "take")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    joined = (
        salted(signed)
        .withColumn("_salt", F.pmod(F.xxhash64("key", F.lit(3)), F.col("_salts")).cast("int"))
        .drop("_salts")
        .join(spread, ["batch_id", "signature", "_salt"])
        .withColumn("_bucket", hash_bucket(F.col("request_id"), F.col("key"), buckets=BUCKETS))
    )
    group = ["request_id", "batch_id", "signature"]
    sizes = joined.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = joined.join(offsets, [*group, "_bucket"]).where(F.col("_before") < F.col("take"))
    rank = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(F.xxhash64("request_id", "key", F.lit(5)), "key"))
    return placed.withColumn("_rank", rank).where(F.col("_rank") + F.col("_before") <= F.col("take")).select("request_id", "batch_id", "key")


def stem(filename):
    """The lower-cased file name without its last suffix; a leading full stop is part of the stem."""
    return F.lower(F.regexp_replace(filename, r"(?s)(?<=.)\.[^.]*+\z", ""))
