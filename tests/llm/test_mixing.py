import numpy as np
import pytest

from cohortlab.llm import mixing

DOCS = "doc_id long, source string, n_tokens long"
TARGETS = "source string, target_pct long, max_repeats long"


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 400):
        w, p = rng.integers(1, 900, n).astype(float), np.full(n, 0.37)
        out = mixing.flight(w, p, rng)
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2 and ((out >= 0) & (out <= 1)).all()
        assert out.sum() == pytest.approx(p.sum(), abs=1e-4) and (w * out).sum() == pytest.approx((w * p).sum(), abs=1e-2)
    equal = mixing.flight(np.ones(50), np.full(50, 0.5), rng)
    assert equal.sum() == pytest.approx(25, abs=1e-4)


def test_flight_has_the_given_chances():
    w, p = np.array([5.0, 9, 2, 7, 30, 11, 4, 8]), np.linspace(0.1, 0.9, 8)
    moved = [mixing.flight(w, p, np.random.default_rng(s)) for s in range(4000)]
    assert np.abs(np.mean(moved, axis=0) - p).max() < 0.03  # the flight keeps every chance; the landing settles at most two
    assert all(set(mixing.landing(w, m)) <= {0.0, 1.0} for m in moved[:50])


def documents(spark, counts, seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for source, n in counts.items():
        for size in np.clip(rng.lognormal(5, 1, n).astype(int), 1, 9000):
            rows.append((i, source, int(size)))
            i += 1
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("block", [5000, 60])
def test_shares(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    docs = documents(spark, {"a": 900, "b": 300, "c": 30, "other": 50}).unionByName(spark.createDataFrame([(9999, None, 50), (9998, "a", 0)], DOCS))
    targets = spark.createDataFrame([("a", 40, 1), ("b", 40, 5), ("c", 15, 2), ("d", 5, 3)], TARGETS)
    mixture, report = mixing.mix(docs, targets)
    rows = mixture.collect()
    lines = {r.source: r for r in report.collect()}
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} <= {"a", "b", "c"}
    for source, most in (("a", 1), ("b", 5), ("c", 2)):
        own = [r for r in rows if r.source == source]
        assert sum(r.copies * r.n_tokens for r in own) == lines[source].actual_tokens and max(r.copies for r in own) <= most
    for source in "ab":
        assert lines[source].actual_tokens == pytest.approx(lines[source].need_tokens, rel=0.001) and not lines[source].exhausted
    assert {s for s, r in lines.items() if r.exhausted} == {"c", "d"} and lines["d"].actual_tokens == 0 and lines["c"].actual_tokens == 2 * lines["c"].source_tokens
    copies = {r.copies for r in rows if r.source == "b"}
    assert max(copies) - min(copies) <= 1
    assert sum(r.actual_pct for r in lines.values()) == pytest.approx(100)


def test_exact_limit_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", 50), (2, "b", 50)], DOCS)
    mixture, report = mixing.mix(docs, spark.createDataFrame([("a", 50, 1), ("b", 50, 1), ("z", 0, 1)], TARGETS))
    assert not any(r.exhausted for r in report.collect()) and mixture.count() == 2
    mixture, report = mixing.mix(docs.limit(0), spark.createDataFrame([("a", 100, 1)], TARGETS))
    assert mixture.count() == 0 and report.first().actual_pct is None


def test_nulls_in_any_column(spark):
    docs = spark.createDataFrame([(None, "a", 50), (2**60 + 1, "a", None), (3, None, 5), (2**60 + 3, "a", 70), (None, "a", 50)], DOCS)
    mixture, report = mixing.mix(docs, spark.createDataFrame([("a", 50, 1), (None, 50, 1), ("b", None, None)], TARGETS))
    assert {r.doc_id for r in mixture.collect()} <= {None, 2**60 + 1, 2**60 + 3}
    assert not any(r.exhausted for r in report.collect())


def test_few_documents_land_near_their_share(spark):
    docs = documents(spark, {"a": 400, "b": 40}, seed=3)
    lines = {r.source: r for r in mixing.mix(docs, spark.createDataFrame([("a", 95, 3), ("b", 5, 3)], TARGETS))[1].collect()}
    assert lines["b"].source_tokens > lines["b"].need_tokens
    assert all(abs(r.actual_tokens - r.need_tokens) <= 0.005 * r.need_tokens for r in lines.values())


def test_kept_shares(spark):
    docs = documents(spark, {"a": 900, "b": 300, "c": 30})
    targets = spark.createDataFrame([("a", 40, 1), ("b", 40, 5), ("c", 20, 2)], TARGETS)
    lines = {r.source: r for r in mixing.mix(docs, targets, keep_shares=True)[1].collect()}
    assert all(abs(r.actual_pct - r.target_pct) < 0.5 and not r.exhausted for r in lines.values())


def test_documents_without_tokens_are_used_up(spark):
    docs = spark.createDataFrame([(1, "a", 100), (2, "b", 0), (3, "b", 0)], DOCS)
    mixture, report = mixing.mix(docs, spark.createDataFrame([("a", 50, 2), ("b", 50, 2)], TARGETS))
    assert {r.doc_id: r.copies for r in mixture.collect()} in ({1: 1, 2: 2, 3: 2}, {2: 2, 3: 2})
    assert {r.source: r.exhausted for r in report.collect()} == {"a": False, "b": True}
