import os
import random

import numpy as np
import pytest

from codeloom.llm.encoding import VOCABULARY
from codeloom.llm.mixing import features_of, fit, fit_rates, mix_sources, sample_threshold

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
WORDS = {"wiki": "page section anchor heading link", "code": "return value index loop error", "log": "added fixed removed release version"}


def docs(n=900, unknown=0.1, seed=1):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        s = rng.choices(list(WORDS), [6, 3, 1])[0]
        truth[i] = s
        text = " ".join(rng.choices(WORDS[s].split(), k=rng.randrange(5, 60)))
        label = None if rng.random() < unknown else rng.choice([s, s.upper(), f" {s}", f"{s} "])
        rows.append((i, text, label))
    return rows, truth


def mix(spark, rows, targets, **more):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    return mix_sources(d, t, **more)


def test_shares_are_reached_within_caps(spark):
    rows, truth = docs()
    rows += [(5000, None, "wiki"), (5001, "", "wiki"), (5002, "page " * 20_000, "wiki"), (5003, "x", "elsewhere")]
    m = mix(spark, rows, [("m", "wiki", 2.0, 3), ("m", "code", 1.0, 2), ("m", "log", 1.0, 4), ("m", "none", 0.5, 9), ("n", "log", 1.0, 1)])
    report = {(r["mix_name"], r["source"]): r for r in m.report.collect()}
    for s, share in (("wiki", 0.5), ("code", 0.25), ("log", 0.25)):
        r = report["m", s]
        assert r["status"] == "reached" and abs(r["wanted_share"] - share) < 1e-9 and abs(r["reached_share"] - share) < 0.01
    assert report["m", "none"]["status"] == "no documents" and report["m", "none"]["reached_share"] == 0
    assert abs(report["m", "wiki"]["target_share"] - 2 / 4.5) < 1e-9
    chosen = m.rows.collect()
    caps = {"wiki": 3, "code": 2, "log": 4}
    assert all(1 <= r["copies"] <= caps.get(r["source"] or truth.get(r["doc_id"]), 9) for r in chosen if r["mix_name"] == "m" and r["source"])
    assert not {5000, 5001, 5003} & {r["doc_id"] for r in chosen}
    assert len({(r["mix_name"], r["doc_id"]) for r in chosen}) == len(chosen)
    assert abs(report["n", "log"]["reached_share"] - 1) < 0.02


def test_empty_tables(spark):
    rows, _ = docs(20)
    assert mix(spark, [], [("m", "wiki", 1.0, 2)]).rows.collect() == []
    assert mix(spark, rows, []).rows.collect() == []
    only = mix(spark, rows, [("m", "absent", 1.0, 2)])
    assert only.rows.collect() == [] and [r["status"] for r in only.report.collect()] == ["no documents"]


def test_held_out_accuracy():
    from codeloom.llm.bpe import Encoder, read_ranks

    with open(VOCABULARY, "rb") as f:
        e = Encoder(read_ranks(f.read()))
    rows, truth = docs(600, 0)
    x = np.stack([features_of(e.encode(t)) for _, t, _ in rows])
    y = [truth[i] for i, _, _ in rows]
    model = fit(x[:400], y[:400])
    guess = [model.labels[k] for k in model.posteriors(x[400:]).argmax(axis=1)]
    assert np.mean([a == b for a, b in zip(guess, y[400:])]) > 0.95


def test_fitted_rates_reach_the_constrained_optimum():
    rng = np.random.default_rng(0)
    cells = np.vstack([np.diag([5000.0, 300.0, 20.0]), rng.dirichlet([1, 1, 1], size=30) * rng.integers(1, 50, size=(30, 1))])
    caps = np.full(33, 3.0)
    wanted = np.array([900.0, 500.0, 55.0])
    rates, done = fit_rates(cells, wanted, caps, np.minimum(3.0, np.full(33, 0.2)))
    assert done and (rates >= 0).all() and (rates <= caps + 1e-12).all() and np.abs(rates @ cells / wanted - 1).max() < 1e-6
    # out of reach: no single rate can be moved for a smaller error
    wanted = np.array([900.0, 5000.0, 55.0])
    rates, done = fit_rates(cells, wanted, caps, np.full(33, 0.2))
    error = lambda r: (((r @ cells - wanted) / wanted) ** 2).sum()
    assert done and rates[1] == 3.0
    for k in range(33):
        for step in (-1e-4, 1e-4):
            other = rates.copy()
            other[k] = np.clip(other[k] + step, 0, 3)
            assert error(other) >= error(rates) - 1e-9
    assert fit_rates(np.zeros((0, 3)), wanted, np.zeros(0), np.zeros(0))[1] and not fit_rates(cells, wanted, caps, np.full(33, 0.2), steps=1)[1]


def test_samples_of_any_number_of_rows():
    for n in (1, 600, 10**6, 10**9, 10**13):
        t = sample_threshold(600, n)
        expected = (t + (1 << 63) + 1) / 2**64 * n
        assert -(1 << 63) <= t < 1 << 63 and abs(expected - min(n, 600)) < 1e-3 * 600
    assert sample_threshold(600, 0) == (1 << 63) - 1


def test_a_share_out_of_reach_is_reported(spark):
    rows, _ = docs(300, 0)
    rows.append((9000, "page " * 60_000, "wiki"))  # no part of this one can be taken
    only = [r for r in rows if r[0] == 9000 or (r[2] or "").strip().lower() != "wiki"]
    report = {r["source"]: r for r in mix(spark, only, [("m", "wiki", 1.0, 1), ("m", "log", 9.0, 2)]).report.collect()}
    assert {r["status"] for r in report.values()} == {"missed"} and abs(report["wiki"]["wanted_share"] - 0.1) < 1e-9


def test_rows_of_cut_buckets_go_by_parts(spark):
    rows, _ = docs()
    one, two = (mix(spark, rows, [("m", "wiki", 2.0, 3), ("m", "code", 1.0, 2)], buckets=1, edge_rows=n) for n in (7, 10**6))
    assert {tuple(r) for r in one.rows.collect()} == {tuple(r) for r in two.rows.collect()}


def test_nulls_in_any_column_and_repeated_rows(spark):
    rows, _ = docs(60, 0)
    rows += [(None, "page link", "wiki"), (None, "page link", "wiki"), (7, None, None), (8, "return value", "")]
    m = mix(spark, rows + rows[:5], [("m", "wiki", 1.0, None), ("m", "code", None, 2), ("m", None, 1.0, 2), (None, "log", 1.0, 2), ("z", "wiki", 0.0, 2), ("y", "wiki", 1.0, 0)])
    report = {(r["mix_name"], r["source"]): r for r in m.report.collect()}
    assert report["m", "wiki"]["status"] == "reached" and abs(report["m", "wiki"]["reached_share"] - 1) < 0.05
    assert report["y", "wiki"]["status"] == "no documents" and ("z", "wiki") not in report
    assert all(r["copies"] == 1 for r in m.rows.collect() if r["mix_name"] == "m" and r["source"])
