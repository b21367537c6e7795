"""Same and near-same pictures across splits, by content-defined chunks.

A picture is normalised to a record: mean removed, scaled to length one,
transformed by a cosine transform, and written as a sequence of symbols, the
signs of its lowest frequencies in several fixed orders (of the grey mean and of
single channels). A rolling hash over the last ``WINDOW`` symbols cuts each order
into chunks between ``SHORTEST`` and ``LONGEST`` + ``SHORTEST`` symbols that cover it
whole; a chunk's digest holds its symbols and no position, and after a changed
symbol the cuts fall into step again. Chunk digests are joined across splits, and
the lengths of shared chunks are summed into the overlap fraction of a pair,
which is 1 for equal pictures. Mirroring a picture only flips known signs, so
the evaluation side is entered in four positions.

Pairs that share at least ``LEAST_OVERLAP`` of their records, by digests that are
not ``POPULAR``, are candidates. A change that spreads over all frequencies (a
patch, noise equal in all channels) can leave a near pair below that. The exact
way for the rest: training pictures lie in boxes of their low frequencies, an
evaluation picture is compared with those boxes that can hold a picture near
enough, by an upper bound of the correlation that cuts nothing off. All
candidates are then checked on all stored values.

Equal pictures are one class, found by a 128-bit content digest, so copies are
chunked, joined and checked once.

Defined results: null pictures, pictures of another size, with a null, NaN or
infinite value, and blank ones (one value within each channel) form no pair;
repeated rows of one id give the pair once; an empty table gives no pairs; a
null origin is reported as null; pairs found by the exact way alone have the
overlap their records have, which may be 0.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from cohortlab.llm.shards import Tree, box, reaches
from cohortlab.operators.joins import checked_join
from cohortlab.session import materialize

#: Channels and side of a picture where none are given, and the least correlation of a near copy.
CHANNELS, SIDE, ALIKE = 3, 16, 0.97
#: Symbols per order, number of orders, shortest and longest chunk, rolling window, and one cut in so many positions.
SIGNS, ORDERS, SHORTEST, LONGEST, WINDOW, CUT = 48, 16, 16, 28, 8, 6
#: The least share of the record that candidates have in common, about two chunks; how many training pictures may share a digest that is used to find them, and among which part of the pictures that is counted.
LEAST_OVERLAP, POPULAR, POPULAR_PART = 2 * SHORTEST / (SIGNS * ORDERS), 1000, 64
#: Values worked on at once within an Arrow batch, which bounds a worker's memory.
PART_VALUES = 1024 * 768
#: Training pictures in a box, the largest sample the boxes are fitted on, sampled pictures per box, and evaluation pictures compared in one task.
BOX_ROWS, SAMPLE, LEAF_SAMPLE, TASK_ROWS = 16_384, 500_000, 12, 16_384
#: Low frequencies compared first, the others for the pairs left; what rounding (to half precision on the way) may take from a bound; rows of a matrix product.
FIRST, SLACK, PART = 16, 2e-3, 1024
MIRRORS = ("as stored", "left-right", "top-bottom", "both")


def _low() -> list[tuple[int, int]]:
    """The lowest frequencies (vertical, horizontal) without the constant one."""
    most = int(SIGNS**0.5) + 8
    return sorted(((u, v) for u in range(most) for v in range(most) if u or v), key=lambda f: (f[0] ** 2 + f[1] ** 2, f))[:SIGNS]


def _cosines(side: int, rows: int) -> np.ndarray:
    n = np.arange(side)
    out = np.sqrt(2 / side) * np.cos(np.pi * (n[None] + 0.5) * np.arange(rows)[:, None] / side)
    out[0] /= np.sqrt(2)
    return out


def _orders(channels: int) -> tuple[np.ndarray, np.ndarray]:
    """(component, frequencies) of each order: component 0 is the grey mean, 1.. are the channels."""
    low, plain = _low(), list(range(SIGNS))
    parts = [0, 1 % (channels + 1), 2 % (channels + 1)]
    orders = [plain, sorted(plain, key=lambda i: low[i]), sorted(plain, key=lambda i: low[i][::-1])]
    rng = np.random.default_rng(5)
    for k in range(ORDERS - len(orders)):
        parts.append(k % (channels + 1))
        orders.append(rng.permutation(SIGNS).tolist())
    return np.array(parts), np.array(orders)


def transform(pictures: np.ndarray, channels: int = CHANNELS, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """[n, 1 + channels, SIGNS] low-frequency coefficients of unit-length pictures (grey mean first), and which pictures are usable."""
    x = pictures.reshape(len(pictures), channels, side, side).astype(np.float64)
    usable = np.isfinite(x).all((1, 2, 3)) & ~(np.ptp(np.where(np.isfinite(x), x, 0), axis=(2, 3)) == 0).all(1)
    x = np.where(usable[:, None, None, None], x, 0)
    x = x - x.mean((1, 2, 3), keepdims=True)
    x /= np.maximum(np.sqrt((x * x).sum((1, 2, 3), keepdims=True)), 1e-30)
    u, v = np.array(_low()).T
    rows = _cosines(side, max(u.max(), v.max()) + 1)
    waves = rows @ x @ rows.T
    of_channels = waves[:, :, u, v]
    return np.concatenate([of_channels.sum(1, keepdims=True) / np.sqrt(channels), of_channels], axis=1), usable


def parity(mirror: int) -> np.ndarray:
    """The factor of each low frequency under a mirroring."""
    u, v = np.array(_low()).T
    return np.where(((v * (mirror & 1) + u * (mirror >> 1)) & 1) == 1, -1.0, 1.0)


def chunks(waves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, length) of every chunk of every record; the chunks of an order cover it whole."""
    parts, orders = _orders(waves.shape[1] - 1)
    signs = waves[:, parts[:, None], orders] >= -1e-6  # what is 0 but for rounding counts as positive
    # a symbol is a component, a frequency and a sign, whatever its place
    symbols = np.random.default_rng(7).integers(1, 2**63, (2, int(parts.max()) + 1, SIGNS), dtype=np.uint64)
    plus, minus = symbols[0][parts[:, None], orders], symbols[1][parts[:, None], orders]
    base, mixer = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15)
    n = len(waves)
    length = np.zeros((n, ORDERS), dtype=np.int64)
    digest = np.zeros((n, ORDERS), dtype=np.uint64)
    rolled = np.zeros((n, ORDERS), dtype=np.uint64)
    seen, out = [], []
    with np.errstate(over="ignore"):
        gone = base ** np.uint64(WINDOW)
        for i in range(SIGNS):
            symbol = np.where(signs[:, :, i], plus[:, i], minus[:, i])
            seen.append(symbol)
            rolled = rolled * base + symbol
            if i >= WINDOW:
                rolled -= seen[i - WINDOW] * gone
            digest = (digest ^ symbol) * mixer
            digest ^= digest >> np.uint64(29)
            length += 1
            wanted = ((length >= SHORTEST) & ((rolled >> np.uint64(33)) % np.uint64(CUT) == 0)) | (length >= LONGEST)
            # the rest of the order must be long enough for a chunk of its own
            cut = np.ones_like(wanted) if i == SIGNS - 1 else wanted & (SIGNS - 1 - i >= SHORTEST)
            rows, cols = np.nonzero(cut)
            out.append((rows, digest[rows, cols], length[rows, cols]))
            length[cut], digest[cut] = 0, 0
    return tuple(np.concatenate(columns) for columns in zip(*out))


def records(table: DataFrame, key: str, picture: str, mirrors: tuple[int, ...], channels: int = CHANNELS, side: int = SIDE) -> DataFrame:
    """(id, content, mirror, low, digests, lengths) of the usable pictures, a row per mirroring; ``content`` tells equal pictures."""
    size = channels * side * side
    schema = "id long, content binary, mirror int, low array<float>, digests array<bigint>, lengths array<int>"
    at_once = max(1, PART_VALUES // size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for begin in range(0, len(frame), at_once):
                yield from part(frame.iloc[begin : begin + at_once])

    def part(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        stored = np.stack(frame["picture"].to_numpy()).astype(np.float32) + np.float32(0)
        waves, usable = transform(stored, channels, side)
        ids = frame["id"].to_numpy()[usable]
        content = [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in stored[usable]]
        for mirror in mirrors:
            turned = waves[usable] * parity(mirror)
            rows, digests, lengths = chunks(turned)
            order = np.argsort(rows, kind="stable")
            ends = np.cumsum(np.bincount(rows, minlength=len(ids)))[:-1]
            yield pd.DataFrame(
                {
                    "id": ids,
                    "content": content,
                    "mirror": np.int32(mirror),
                    "low": list(turned[:, 0].astype(np.float32)),
                    "digests": np.split(digests[order].view(np.int64), ends) if len(ids) else [],
                    "lengths": np.split(lengths[order].astype(np.int32), ends) if len(ids) else [],
                }
            )

    whole = table.where(F.col(key).isNotNull() & (F.size(picture) == size) & ~F.exists(picture, lambda x: x.isNull()))
    return whole.select(F.col(key).alias("id"), F.col(picture).alias("picture")).mapInPandas(run, schema)


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct picture and mirroring: its smallest id speaks for the class."""
    return rows.groupBy("content", "mirror").agg(F.min_by(F.struct("id", "low", "digests", "lengths"), "id").alias("_r")).select("mirror", "_r.*")


def sharing(left: DataFrame, right: DataFrame, least: float = LEAST_OVERLAP, popular: int = POPULAR) -> DataFrame:
    """(t, v, mirror) of the classes that have at least ``least`` of the record in common, by digests that at most ``popular`` training pictures have; no digest is a hot key."""
    ours = left.select(F.col("id").alias("t"), F.explode("digests").alias("digest"))
    theirs = right.select(F.col("id").alias("v"), "mirror", F.explode(F.arrays_zip("digests", "lengths")).alias("_c")).select("v", "mirror", F.col("_c.digests").alias("digest"), F.col("_c.lengths").alias("length"))
    # popularity is counted among one in POPULAR_PART pictures: a digest on either side of the limit costs time or is left to the exact way
    some = ours.where(F.pmod(F.xxhash64("t", F.lit(24)), F.lit(POPULAR_PART)) == 0).groupBy("digest").agg(F.count(F.lit(1)).alias("_n"))
    often = materialize(some.where(F.col("_n") * POPULAR_PART > popular).select("digest"), "popular-digests")
    rare = lambda df: checked_join(df, often, "digest", "left_anti")
    shared = rare(ours).join(rare(theirs), "digest")
    return shared.groupBy("t", "v", "mirror").agg(F.sum("length").alias("_l")).where(F.col("_l") >= least * SIGNS * ORDERS).drop("_l")


def overlap_of(ours: str, theirs: str) -> Column:
    """The share of the record in common chunks, of two (digests, lengths) structs."""
    both = F.filter(F.arrays_zip(F.col(f"{ours}.digests").alias("d"), F.col(f"{ours}.lengths").alias("l")), lambda c: F.array_contains(F.col(f"{theirs}.digests"), c["d"]))
    return F.aggregate(both, F.lit(0).cast("long"), lambda total, c: total + c["l"]) / (SIGNS * ORDERS)


def _length_left(low: Column) -> Column:
    squares = F.aggregate(low, F.lit(0.0), lambda total, x: total + x * x)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - squares))


def _bounded(low: np.ndarray, first: int) -> np.ndarray:
    """The ``first`` low frequencies and the length of all the rest: the product of two such rows is at least their correlation."""
    part = low[:, :first]
    return np.concatenate([part, np.sqrt(np.maximum(0, 1 - (part.astype(np.float64) ** 2).sum(1, keepdims=True)))], axis=1).astype(np.float32)


def likely_in_block(t: np.ndarray, v: np.ndarray, alike: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of t, rows of v) of the pairs of low-frequency rows whose bound reaches ``alike``, but for rounding."""
    some_t, all_t, some_v, all_v = _bounded(t, FIRST), _bounded(t, SIGNS), _bounded(v, FIRST), _bounded(v, SIGNS)
    for begin in range(0, len(v), PART):
        for at in range(0, len(t), PART):
            i, j = np.nonzero(some_t[at : at + PART] @ some_v[begin : begin + PART].T >= alike - SLACK)
            i, j = i + at, j + begin
            kept = np.einsum("ij,ij->i", all_t[i], all_v[j]) >= alike - SLACK
            if kept.any():
                yield i[kept], j[kept]


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float32)


@F.pandas_udf(BinaryType())
def half(low: pd.Series) -> pd.Series:
    """Low frequencies in half precision, which halves what is shuffled."""
    return pd.Series([row.astype(np.float16).tobytes() for row in low])


def _halves(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float16).reshape(len(column), SIGNS).astype(np.float32)


def compared(left: DataFrame, right: DataFrame, alike: float) -> DataFrame:
    """(t, v, mirror) of all classes whose low frequencies allow a correlation of ``alike``. An evaluation picture meets only the boxes of training pictures its ball of that radius reaches; unit vectors that correlate by a are sqrt(2 - 2a) apart."""
    spark = left.sparkSession
    n_t = left.count()
    leaves = max(1, -(-n_t // BOX_ROWS))
    wanted = min(SAMPLE, 2 * leaves * LEAF_SAMPLE)
    chosen = F.shiftrightunsigned(F.xxhash64("id", F.lit(22)), 33) < int(2**31 * min(1.0, wanted / max(n_t, 1)))
    sample = [r["low"] for r in left.where(chosen).select("low").collect()] if leaves > 1 else []
    tree = Tree.fit(_bounded(np.array(sample, dtype=np.float32).reshape(-1, SIGNS), SIGNS), leaves, LEAF_SAMPLE)
    leaves = 2**tree.depth
    shared = spark.sparkContext.broadcast(tree.parts())  # at most 2 * SAMPLE / LEAF_SAMPLE nodes of two numbers

    @F.pandas_udf("int")
    def leaf_of(low: pd.Series) -> pd.Series:
        known = Tree(*shared.value)
        return pd.Series(known.leaf(known.turn(_bounded(_stack(low), SIGNS))) if len(low) else [], dtype="int32")

    ours = materialize(left.select("id", half("low").alias("low"), leaf_of("low").alias("leaf")), "boxed")

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held = Tree(*shared.value), {}
        for frame in batches:
            turned = known.turn(_bounded(_halves(frame["low"]), SIGNS)) if len(frame) else np.zeros((0, SIGNS + 1))
            for leaf, at in frame.groupby("leaf").indices.items():
                now = box(turned[at])
                old = held.get(leaf, now)
                held[leaf] = np.stack([np.minimum(now[0], old[0]), np.maximum(now[1], old[1])])
        yield pd.DataFrame({"leaf": list(held), "box": [b.tobytes() for b in held.values()]})

    boxes = np.full((leaves, 2, SIGNS + 1), np.inf, dtype=np.float32)
    boxes[:, 1] = -np.inf
    # a box per leaf and input partition at most, of two numbers per axis, one at a time
    for r in ours.mapInPandas(bounds, "leaf int, box binary").toLocalIterator():
        held = np.frombuffer(r["box"], dtype=np.float32).reshape(2, SIGNS + 1)
        boxes[r["leaf"]] = np.minimum(boxes[r["leaf"], 0], held[0]), np.maximum(boxes[r["leaf"], 1], held[1])
    held_boxes = spark.sparkContext.broadcast(boxes)  # at most 2 * SAMPLE / LEAF_SAMPLE of them
    radius = float(np.sqrt(2 - 2 * (alike - SLACK)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Tree(*shared.value)
        for whole in batches:
            for begin in range(0, len(whole), PART):
                frame = whole.iloc[begin : begin + PART]
                low, reach = _halves(frame["low"]), np.full(len(frame), radius)
                masks: dict[tuple[int, int], int] = defaultdict(int)
                for mirror in range(len(MIRRORS)):
                    turned = known.turn(_bounded(low * parity(mirror).astype(np.float32), SIGNS))
                    at, leaf = known.within(turned, reach)
                    kept = reaches(turned, at, held_boxes.value[leaf], reach)
                    for place in zip(at[kept].tolist(), leaf[kept].tolist()):
                        masks[place] |= 1 << mirror
                at, leaf = (np.array([place[k] for place in masks], dtype=np.int64) for k in (0, 1))
                yield pd.DataFrame({"id": frame["id"].to_numpy()[at], "low": frame["low"].to_numpy()[at], "leaf": leaf.astype("int32"), "mirrors": np.array(list(masks.values()), dtype="int32")})

    # a picture goes to a box once, with the mirrorings that reach it
    plain = right.where("mirror = 0").select("id", half("low").alias("low"))
    theirs = materialize(plain.mapInPandas(route, "id long, low binary, leaf int, mirrors int"), "routed")
    busy = theirs.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("int").alias("tasks"))
    theirs = theirs.join(busy, "leaf").withColumn("task", F.pmod(F.xxhash64("id", F.lit(23)), F.col("tasks")).cast("int")).drop("tasks")
    copies = ours.join(busy, "leaf").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    parts = max(2 * leaves, spark.sparkContext.defaultParallelism)
    copies, theirs = copies.repartition(parts, "leaf", "task"), theirs.repartition(parts, "leaf", "task")  # a given number: small boxes hold much work, and are not to be merged into one task

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"t": np.zeros(0, dtype=np.int64), "v": np.zeros(0, dtype=np.int64), "mirror": np.zeros(0, dtype=np.int32)})]
        t = _halves(a["low"]) if len(a) else np.zeros((0, SIGNS), dtype=np.float32)
        for mirror in range(len(MIRRORS) if len(a) else 0):
            some = b[(b["mirrors"].to_numpy() >> mirror) & 1 == 1]
            for i, j in likely_in_block(t, _halves(some["low"]) * parity(mirror).astype(np.float32), alike) if len(some) else ():
                parts.append(pd.DataFrame({"t": a["id"].to_numpy()[i], "v": some["id"].to_numpy()[j], "mirror": np.int32(mirror)}))
        return pd.concat(parts, ignore_index=True)

    return copies.groupBy("leaf", "task").cogroup(theirs.groupBy("leaf", "task")).applyInPandas(run, "t long, v long, mirror int")


def cross_split(train: DataFrame, evaluation: DataFrame, key: str = "sample_id", picture: str = "images", alike: float = ALIKE, channels: int = CHANNELS, side: int = SIDE) -> DataFrame:
    """(train_sample_id, validation_sample_id, overlap, correlation): every pair of a training and an evaluation picture whose values correlate by at least ``alike`` in some mirroring."""
    ours, theirs = materialize(records(train, key, picture, (0,), channels, side), "train-records"), materialize(records(evaluation, key, picture, (0, 1, 2, 3), channels, side), "evaluation-records")
    left, right = materialize(_classes(ours), "train-classes"), materialize(_classes(theirs), "evaluation-classes")
    low_t, low_v = left.select(F.col("id").alias("t"), F.col("low").alias("low_t")), right.select(F.col("id").alias("v"), "mirror", F.col("low").alias("low_v"))
    sharing_ = materialize(sharing(left, right), "sharing-pairs")
    inner = F.aggregate(F.zip_with("low_t", "low_v", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda total, x: total + x)
    most = inner + _length_left(F.col("low_t")) * _length_left(F.col("low_v"))
    by_chunks = checked_join(low_v, checked_join(low_t, sharing_, "t"), ["v", "mirror"]).where(most >= alike - SLACK).select("t", "v", "mirror")
    likely = materialize(by_chunks.unionByName(compared(left, right, alike)).distinct(), "likely-pairs")
    size, at_once = channels * side * side, max(1, PART_VALUES // (channels * side * side))

    def stored(table: DataFrame, name: str) -> DataFrame:
        wanted = likely.select(F.col(name).alias(key)).distinct()
        sized = table.where(F.size(picture) == size).select(key, F.col(picture).alias(f"{name}_picture"))
        return checked_join(sized, wanted, key).dropDuplicates([key]).withColumnRenamed(key, name)

    @F.pandas_udf("double")
    def correlation(a: pd.Series, b: pd.Series, mirror: pd.Series) -> pd.Series:
        parts = [pearson(*(c.iloc[begin : begin + at_once] for c in (a, b, mirror))) for begin in range(0, len(a), at_once)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    def pearson(a: pd.Series, b: pd.Series, mirror: pd.Series) -> np.ndarray:
        x = np.stack(a.to_numpy()).astype(np.float64)
        y = np.stack(b.to_numpy()).astype(np.float64).reshape(-1, channels, side, side)
        which = mirror.to_numpy()[:, None, None, None]
        y = np.where(which & 1, y[..., ::-1], y)
        y = np.where(which >> 1, y[:, :, ::-1], y).reshape(len(x), -1)
        x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
        return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))

    near = materialize(
        likely.join(stored(train, "t"), "t")
        .join(stored(evaluation, "v"), "v")
        .withColumn("correlation", correlation.asNondeterministic()("t_picture", "v_picture", "mirror"))  # so that the filter does not run it twice
        .where(F.col("correlation") >= alike)
        .select("t", "v", "mirror", "correlation"),
        "near-pairs",
    )
    chunked = lambda df, name: df.select(F.col("id").alias(name), "mirror", F.struct("digests", "lengths").alias(f"{name}_chunks"))
    with_ours = checked_join(chunked(left, "t").drop("mirror"), near, "t")
    checked = (
        checked_join(chunked(right, "v"), with_ours, ["v", "mirror"])
        .groupBy("t", "v")
        .agg(F.max(overlap_of("t_chunks", "v_chunks")).alias("overlap"), F.max("correlation").alias("correlation"))
    )
    checked = materialize(checked, "checked-pairs")
    # classes back to their members
    members_t = ours.select(F.col("id").alias("train_sample_id"), "content").distinct()
    members_v = theirs.where("mirror = 0").select(F.col("id").alias("validation_sample_id"), F.col("content").alias("v_content")).distinct()
    speak_t = ours.groupBy("content").agg(F.min("id").alias("t"))
    speak_v = theirs.where("mirror = 0").groupBy("content").agg(F.min("id").alias("v")).withColumnRenamed("content", "v_content")
    return (
        checked.join(speak_t, "t")
        .join(speak_v, "v")
        .join(members_t, "content")
        .join(members_v, "v_content")
        .select("train_sample_id", "validation_sample_id", "overlap", "correlation")
    )


def report(pairs: DataFrame, evaluation: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per eval_split and origin of the evaluation sample: samples, samples also in training, those equal but for brightness and contrast, training counterparts, mean of the samples' largest overlap."""
    per_sample = pairs.groupBy(F.col("validation_sample_id").alias(key)).agg(
        F.count(F.lit(1)).alias("counterparts"), F.max("overlap").alias("most"), F.max((F.col("correlation") > 1 - 1e-9).cast("int")).alias("same")
    )
    samples = evaluation.select(key, "eval_split", "origin").join(per_sample, key, "left")
    return samples.groupBy("eval_split", "origin").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count("counterparts").alias("overlapping"),
        F.coalesce(F.sum("same"), F.lit(0)).alias("exact"),
        F.coalesce(F.sum("counterparts"), F.lit(0)).alias("counterparts"),
        F.avg("most").alias("mean_overlap"),
    )
