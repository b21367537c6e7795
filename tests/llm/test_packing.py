from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortlab.llm import packing, tokens


def bins_of(plan):
    bins = defaultdict(list)
    for size, rank, count, first, per in plan.runs:
        for i in range(count):
            bins[first + i // per].append(size)
    return bins


def check(sizes, capacity):
    plan = packing.pack_histogram(dict(Counter(sizes)), capacity)
    bins = bins_of(plan)
    assert Counter(s for b in bins.values() for s in b) == Counter(sizes)
    assert all(sum(b) <= capacity for b in bins.values()) and sorted(bins) == list(range(plan.next_bin))
    for b in bins.values():
        assert sum(3 * s > capacity for s in b) <= 2
    # ranks of a size are numbered without gaps
    for size in set(sizes):
        runs = sorted((rank, count) for s, rank, count, *_ in plan.runs if s == size)
        assert [r for r, _ in runs] == list(np.cumsum([0, *[c for _, c in runs[:-1]]]))
    return plan


def test_random_histograms():
    rng = np.random.default_rng(0)
    for trial in range(300):
        capacity = int(rng.integers(3, 60))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(0, 200)))
        if trial % 3 == 0:
            sizes = np.minimum(sizes, max(1, capacity // 2))
        plan = check(sizes.tolist(), capacity)
        assert plan.next_bin <= max(1, 1.35 * np.ceil(sizes.sum() / capacity) + 2) or (2 * sizes > capacity).mean() > 0.2


def test_little_space_is_left():
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.lognormal(5.2, 0.9, 20_000).astype(int), 1, 2048).tolist()
    plan = check(sizes, 2048)
    assert 1 - sum(sizes) / (plan.next_bin * 2048) < 0.01


def test_work_depends_on_sizes_only():
    plan = packing.pack_histogram({700: 10**9, 650: 10**9, 300: 3 * 10**9, 7: 10**10}, 2048)
    assert len(plan.runs) < 100


@pytest.mark.parametrize("hot", [1, 400])
def test_pack(spark, hot):
    sizes = [0, 1, 5, 10, 11, 25, 30, 7, 7, 7, 3, 4] + [6] * hot
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(9000, None, "x")], "doc_id long, n_tokens long, piece string")
    rows = packing.pack(df, 10).collect()
    per = defaultdict(int)
    filled = defaultdict(int)
    for r in rows:
        per[r.doc_id] += r.piece_tokens
        filled[r.container] += r.piece_tokens
    assert per == {i: s for i, s in enumerate(sizes) if s > 0} and max(filled.values()) <= 10
    pieces = Counter(r.doc_id for r in rows)
    assert {i for i, n in pieces.items() if n > 1} == {4, 5, 6} and pieces[6] == 3 and pieces[5] == 3
    assert sorted(r.doc_id for r in packing.divided(packing.pack(df, 10)).collect()) == [4, 5, 6]
    assert len({(r.container) for r in rows if r.container < 0}) == sum(r.container < 0 for r in rows)
    report = packing.fill_report(packing.pack(df, 10), 10).first()
    assert report.tokens == sum(sizes) and report.fullest <= 10


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, 4)] * 5, "doc_id long, n_tokens long")
    assert packing.pack(df, 10).count() == 5 and packing.divided(packing.pack(df, 10)).count() == 0
    two = spark.createDataFrame([(1, 4), (2, 25)], "doc_id long, n_tokens long")
    assert tuple(packing.verdict(packing.pack(two, 10), two, 10).first()) == (2, 0, 0, 0, True)
    crooked = packing.pack(two, 10).where("container < 0 or doc_id = 1")
    assert packing.verdict(crooked, two, 10).first().not_whole == 1
    assert tuple(packing.verdict(packing.pack(two.limit(0), 10), two.limit(0), 10).first()) == (0, 0, 0, 0, True)
    assert packing.pack(df.limit(0), 10).count() == 0


def test_divided_documents_come_from_placed_containers(spark):
    df = spark.createDataFrame([(1, 4), (2, 25), (3, 20)], "doc_id long, n_tokens long")
    plan = packing.divided(packing.pack(df, 10))._jdf.queryExecution().optimizedPlan().toString()
    assert "container" in plan and "Window" in plan


def test_token_counts(spark):
    import os

    texts = [None, "", "a", "The ovary.", "난소 낭종", " " * 50_000 + "x", "a" * 200_000, "<|endoftext|>"]
    if not os.path.exists(tokens.TOKENIZERS):
        pytest.skip("no vocabularies here")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    fast = [r.n_tokens for r in tokens.with_token_counts(df).orderBy("id").collect()]
    slow = [r.n_tokens for r in tokens.with_token_counts(df, vocabulary="byte_bpe_50k.json").orderBy("id").collect()]
    assert fast == slow and fast[:3] == [0, 0, 1]
