"""Queries of the training-data problems tagged llm, and their SQL where there is one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import mixing, neighbours, overlap, packing, readability, sampling, tokens
from cohortlab.session import materialize


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _requested(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame, DataFrame, DataFrame]]:
    """(source table, requests, records, targets)."""
    requests, targets = _read(spark, folder, "sample_requests"), _read(spark, folder, "target_shares")
    clinical = _read(spark, folder, "ovarian_patient_data").select(F.col("load_id").alias("batch_id"), F.col("record_id").alias("key"), F.col("risklabel").alias("category"))
    images = _read(spark, folder, "train_cls").select(F.col("list_id").alias("batch_id"), sampling.stem(F.col("filename")).alias("key"), F.col("label").alias("category"))
    own = lambda df, source: df.where(F.col("source_table") == source)
    return [(source, own(requests, source), records, own(targets, source)) for source, records in (("ovarian_patient_data", clinical), ("train_cls", images))]


def _samples(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame, DataFrame]]:
    return [(source, *sampling.sample(*tables)) for source, *tables in _requested(spark, folder)]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_report(spark, folder).where(~F.col("enough_available")).select("request_id", "category")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Need, available, sampled and share of every request and category, and which needs were not met."""
    return reduce(DataFrame.unionByName, [sampling.report(*tables) for _, *tables in _requested(spark, folder)])


def p1_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per request what must hold of any sample: its size, floors kept as far as there are items and the sample has room for them, no item twice."""
    out = []
    for source, drawn, report in _samples(spark, folder):
        floors = _read(spark, folder, "sample_requests").where(F.col("source_table") == source).join(_read(spark, folder, "target_shares"), ["source_table", "target_set"]).select("request_id", "category", "min_keep")
        kept = report.join(floors, ["request_id", "category"]).groupBy("request_id").agg(F.min(F.col("sampled") >= F.least("min_keep", "available")).alias("_kept"), (F.sum(F.least("min_keep", "available")) > F.max("sampled_size")).alias("_too_many"))
        sizes = drawn.groupBy("request_id").agg(F.count(F.lit(1)).alias("sampled_size"), F.countDistinct("key").alias("_keys"))
        out.append(kept.join(sizes, "request_id", "left").fillna(0, ["sampled_size", "_keys"]).select("request_id", (F.col("_kept") | F.col("_too_many")).alias("floors_kept"), "sampled_size", (F.col("sampled_size") - F.col("_keys")).alias("repeated")))
    return reduce(DataFrame.unionByName, out)


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    parts = [drawn.withColumn("source_table", F.lit(source)) for source, drawn, _ in _samples(spark, folder)]
    return parts[0].unionByName(parts[1])


def _near(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbours(_read(spark, folder, "dl_train_data").select("vec_id", "x_train"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.pairs(_near(spark, folder))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder)


def p3_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The true neighbours of every vector whose id is divisible by 50, against all rows."""
    return neighbours.exact(_read(spark, folder, "dl_train_data").select("vec_id", "x_train")).select("vec_id", "rank", "neighbour_id")


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the true neighbours of those vectors the graphs find, and whether that is 99 % of them."""
    truth = materialize(neighbours.exact(_read(spark, folder, "dl_train_data").select("vec_id", "x_train")), "truth")
    measured = neighbours.recall(_near(spark, folder), truth)
    return measured.select("queries", "neighbours", (F.col("found") >= 0.99 * F.col("neighbours")).alias("recall_reached"))


def _across(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    evaluation = _read(spark, folder, "validation_data")
    return overlap.cross_split(_read(spark, folder, "train_augmented2_data"), evaluation), evaluation


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _across(spark, folder)[0].select("train_sample_id", "validation_sample_id")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.report(*_across(spark, folder)).drop("mean_overlap")


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair with the share of its records in common chunks and its correlation."""
    return _across(spark, folder)[0]


def _capacity(spark: SparkSession, folder: str, spec: str = "train_pack") -> int:
    return _read(spark, folder, "container_specs").where(F.col("spec_name") == spec).first()["capacity_tokens"]


def _sized(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return tokens.with_token_counts(_read(spark, folder, "documents").select("doc_id", "text", *columns)).drop("text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.divided(p7_containers(spark, folder))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_sized(spark, folder), _capacity(spark, folder))


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of any packing: all placed whole, none overfull, none cut without need, few containers."""
    sized, capacity = materialize(_sized(spark, folder), "sized"), _capacity(spark, folder)
    return packing.verdict(materialize(packing.pack(sized, capacity), "packed"), sized, capacity)


def _mixed(spark: SparkSession, folder: str, **options) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_sized(spark, folder, "source"), _read(spark, folder, "source_targets"), **options)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_report(spark, folder).where("exhausted").select("source")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Goal and actual tokens, documents and shares of each source."""
    return _mixed(spark, folder)[1]


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per listed source what must hold of any mixture: documents used too often, documents of another source, and whether the tokens are within 1 % of the goal (or the largest document) or all documents used up. Keys are unique."""
    mixture, report = _mixed(spark, folder)
    documents = _read(spark, folder, "documents").select("doc_id", F.col("source").alias("_source"))
    limits = _read(spark, folder, "source_targets").select("source", F.col("max_repeats").alias("_most"))
    per = mixture.join(documents, "doc_id").join(limits, "source").groupBy("source").agg(F.count_if(F.col("copies") > F.col("_most")).alias("over_repeats"), F.count_if(F.col("source") != F.col("_source")).alias("foreign"), F.max("n_tokens").alias("_largest"))
    off = F.abs(F.col("actual_tokens") - F.col("need_tokens"))
    close = F.col("exhausted") | (off <= F.greatest(0.01 * F.col("need_tokens"), F.col("_largest")))
    joined = report.join(per, "source", "left").fillna(0, ["over_repeats", "foreign"])
    return joined.select("source", F.col("source_docs").alias("documents"), close.alias("as_close_as_can_be"), "over_repeats", "foreign")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return readability.english_levels(_read(spark, folder, "documents"), _read(spark, folder, "level_refs"))


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    graded = readability.with_level(_read(spark, folder, "documents").select("doc_id", "source", "text"), _read(spark, folder, "level_refs"))
    return graded.select("doc_id", "source", "is_english", "n_words", "n_sentences", "grade", "level_band")


def p9_references(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out accuracy: each reference passage is graded with limits and a language profile of the passages of other ids (even or odd); whether nine in ten get their band and all are English, per band."""
    refs = _read(spark, folder, "level_refs")
    out = []
    for side in (0, 1):
        held, others = refs.where(F.col("ref_id") % 2 == side), refs.where(F.col("ref_id") % 2 != side)
        graded = readability.with_level(held.select("ref_id", F.col("level_band").alias("band"), "text"), others)
        out.append(graded.select("band", (F.col("level_band") == F.col("band")).cast("int").alias("right"), F.col("is_english").cast("int").alias("english")))
    both = reduce(DataFrame.unionByName, out).groupBy(F.col("band").alias("level_band"))
    return both.agg(F.count(F.lit(1)).alias("passages"), (F.avg("right") >= 0.9).alias("bands_right"), (F.avg("english") == 1).alias("all_english"))


def queries() -> dict:
    return {f.__name__: f for f in (
        p1_found, p1_sample, p1_report, p1_check, p3_found, p3_neighbours, p3_exact, p3_recall, p6_found, p6_report, p6_pairs, p7_found, p7_containers, p7_check,
        p8_found, p8_mixture, p8_report, p8_check, p9_found, p9_levels, p9_references,
    )}


_EXACT = """
    with v as (select distinct vec_id, x_train::double[] as x from dl_train_data where len(x_train) = 32 and len(list_filter(x_train, lambda e: e is null or isnan(e) or isinf(e))) = 0),
    ranked as (
        select a.vec_id as a, b.vec_id as b, row_number() over (partition by a.vec_id order by list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), b.vec_id) as rank
        from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
    )
"""


_TURNS = {"as stored": "v[j]", "left-right": "v[j - 2 * ((j - 1) % 16) + 15]", "top-bottom": "v[j + 16 * (15 - 2 * (((j - 1) % 256) // 16))]", "both": "v[j - 2 * ((j - 1) % 16) + 15 + 16 * (15 - 2 * (((j - 1) % 256) // 16))]"}
_NEAR = """
    with t as (select distinct sample_id as t, images::double[] as v from train_augmented2_data where len(images) = 768 and len(list_distinct(images)) > 1),
    e as (select distinct sample_id as e, images::double[] as v from validation_data where len(images) = 768 and len(list_distinct(images)) > 1),
    plain as (select t, list_transform(v, lambda x: x - list_avg(v)) as v, v as raw from t),
    unit as (select t, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from plain where list_max(list_transform([0, 256, 512], lambda k: list_max(raw[k + 1:k + 256]) - list_min(raw[k + 1:k + 256]))) > 0),
    plain_e as (select e, list_transform(v, lambda x: x - list_avg(v)) as v, v as raw from e),
    unit_e as (select e, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from plain_e where list_max(list_transform([0, 256, 512], lambda k: list_max(raw[k + 1:k + 256]) - list_min(raw[k + 1:k + 256]))) > 0),
    turned as (""" + " union all ".join(f"select e, list_transform(range(1, 769), lambda j: {source}) as v from unit_e" for source in _TURNS.values()) + """),
    near as (select t, e, max(list_dot_product(unit.v, turned.v)) as correlation from unit join turned on list_dot_product(unit.v, turned.v) >= 0.97 group by t, e)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            with item as (
                select distinct 'ovarian_patient_data' as source_table, load_id as batch_id, record_id as item, risklabel as category
                from ovarian_patient_data where record_id is not null and risklabel is not null
                union all
                select distinct 'train_cls', list_id, lower(regexp_replace(filename, '(.)\\.[^.]*$', '\\1')), label
                from train_cls where filename is not null and label is not null
            ),
            available as (select source_table, batch_id, category, count(*) as n from item group by all)
            select r.request_id, t.category
            from sample_requests r
            join target_shares t using (source_table, target_set)
            left join available a on a.source_table = r.source_table and a.batch_id = r.batch_id and a.category = t.category
            where coalesce(a.n, 0) < greatest(t.min_keep, (r.sample_size * t.target_pct + 99) // 100)
        """,
        "p1_check": """
            with item as (
                select distinct 'ovarian_patient_data' as source_table, load_id as batch_id, record_id as item, risklabel as category
                from ovarian_patient_data where record_id is not null and risklabel is not null
                union all
                select distinct 'train_cls', list_id, lower(regexp_replace(filename, '(.)\\.[^.]*$', '\\1')), label
                from train_cls where filename is not null and label is not null
            ),
            have as (
                select r.request_id, count(distinct i.item) as n
                from sample_requests r join target_shares t using (source_table, target_set)
                join item i on i.source_table = r.source_table and i.batch_id = r.batch_id and i.category = t.category group by 1
            )
            select request_id, true as floors_kept, least(sample_size, coalesce(n, 0)) as sampled_size, 0::bigint as repeated from sample_requests left join have using (request_id)
        """,
        "p3_exact": _EXACT + "select a as vec_id, rank::int as rank, b as neighbour_id from ranked where rank <= 5",
        "p3_recall": _EXACT + "select count(distinct a) as queries, count(*) as neighbours, true as recall_reached from ranked where rank <= 5",
        "p6_found": _NEAR + "select t as train_sample_id, e as validation_sample_id from near",
        "p6_report": _NEAR + """,
            per as (select e, count(*) as n, max((correlation > 1 - 1e-9)::int) as same from near group by e)
            select eval_split, origin, count(*) as samples, count(n) as overlapping, coalesce(sum(same), 0)::bigint as exact, coalesce(sum(n), 0)::bigint as counterparts
            from validation_data left join per on e = sample_id group by eval_split, origin""",
        "p9_references": "select level_band, count(*) as passages, true as bands_right, true as all_english from level_refs group by 1",
        "p7_check": "select count(*) filter (length(text) > 0) as documents_packed, 0::bigint as overfull, 0::bigint as not_whole, 0::bigint as needlessly_cut, true as near_least from documents",
        "p8_check": "select t.source, count(d.doc_id) as documents, true as as_close_as_can_be, 0::bigint as over_repeats, 0::bigint as \"foreign\" from source_targets t left join documents d using (source) group by t.source",
    }
