"""Batched and distributed fits against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import marquardt as lm
from tessella.plans import estimates

STEPS = lm.Steps()


def alone(model, start, s, value, weight, steps=STEPS, pull=None):
    """One problem, step by step."""
    pull = np.zeros(len(start)) if pull is None else pull
    total = weight.sum() + pull.sum()

    def at(p):
        f, j = model(p[None, :], {k: v[None, :] for k, v in s.items()})
        off = value - f[0]
        return np.sqrt(((weight * off**2).sum() + (pull * p**2).sum()) / total), j[0].T @ (weight[:, None] * j[0]) + np.diag(pull), j[0].T @ (weight * off) - pull * p

    p, lam = np.array(start, float), steps.damping
    rms, a, b = at(p)
    first, n, good = rms, 0, False
    while n < steps.rounds:
        n += 1
        trial = p + np.linalg.solve(a + lam * np.diag(np.diag(a)), b)
        new, ta, tb = at(trial)
        good = new < rms
        if good:
            done = new >= rms * (1 - steps.share)
            p, rms, a, b, lam = trial, new, ta, tb, lam * steps.good
            if done:
                break
        else:
            lam *= steps.bad
            if lam > steps.most:
                break
    return p, rms, n, good or rms < first


def peaks(rng, n, pairs=3):
    """(key, x, y, scale, pair, diagonal, value, weight) rows of planted peaks with noise."""
    rows, planted = [], []
    for k in range(n):
        x0, w, wxy, a = rng.uniform(-1, 1), rng.uniform(4, 6), rng.uniform(-0.5, 0.5), rng.uniform(0.5, 1, pairs)
        planted.append([x0, w, wxy, *a])
        for pair in range(pairs):
            for x in range(-2, 3):
                for y in range(-2, 3):
                    if rng.uniform() < 0.1:
                        continue
                    d = 2**0.5 if pair == 2 else 1.0
                    v = a[pair] * (1 - (d * (x - x0) / (w + wxy)) ** 2 - (d * y / w) ** 2)
                    rows.append((k, float(x), float(y), 1.0, float(pair), float(pair == 2), float(v + 0.002 * rng.standard_normal()), 1.0))
    return rows, np.array(planted)


def test_derivatives():
    rng = np.random.default_rng(0)
    s = {"x": rng.uniform(-2, 2, (4, 9)), "y": rng.uniform(-2, 2, (4, 9)), "z": rng.uniform(-2, 2, (4, 9)), "scale": rng.uniform(0.8, 1.2, (4, 9)), "pair": rng.integers(0, 3, (4, 9)).astype(float), "diagonal": rng.integers(0, 2, (4, 9)).astype(float)}
    s["channel"] = s["pair"]
    for model, p in ((lm.peak_model(3), 6), (lm.focus_model(3), 12)):
        at = rng.uniform(1, 2, (4, p))
        j = model(at, s)[1]
        for k in range(p):
            up, down = at.copy(), at.copy()
            up[:, k] += 1e-6
            down[:, k] -= 1e-6
            assert np.allclose(j[:, :, k], (model(up, s)[0] - model(down, s)[0]) / 2e-6, atol=1e-6)


def test_groups_equal_single_fits(spark):
    rng = np.random.default_rng(1)
    rows, planted = peaks(rng, 60)
    names = "k long, x double, y double, scale double, pair double, diagonal double, value double, weight double"
    df = spark.createDataFrame(rows + [(60, 0.0, 0.0, 1.0, 0.0, 0.0, None, 1.0), (61, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0)], names).repartition(3)
    columns = ["x", "y", "scale", "pair", "diagonal"]
    start = F.array(F.lit(0.0), F.lit(5.0), F.lit(0.0), *(F.max("value") for _ in range(3)))
    got = {r["k"]: r for r in lm.fit_groups(df, ["k"], lm.peak_model(3), columns, start).collect()}
    assert set(got) == set(range(60)) | {61} and not got[61]["success"] and got[61]["steps"] == 0
    for k in range(60):
        mine = sorted(r[1:] for r in rows if r[0] == k)
        s = {c: np.array([r[i] for r in mine]) for i, c in enumerate(columns)}
        value = np.array([r[5] for r in mine])
        p, rms, n, good = alone(lm.peak_model(3), [0, 5, 0, *[value.max()] * 3], s, value, np.ones(len(mine)))
        assert np.allclose(got[k]["parameters"], p, rtol=1e-8) and got[k]["rms"] == pytest.approx(rms)
        assert (got[k]["steps"], got[k]["success"]) == (n, good)
        assert abs(got[k]["parameters"][0] - planted[k, 0]) < 0.02 and got[k]["rms"] < 0.003


def test_hopeless_fits_stop():
    """A problem whose equations are singular fails at once; one at its best stays there and stops at the limit of lambda."""
    flat = lambda at, s: (np.zeros_like(s["x"]), np.zeros((*s["x"].shape, 1)))
    x = np.ones((2, 3))
    got = lm.fitted(flat, np.ones((2, 1)), {"x": x}, x, x)
    assert got["steps"].tolist() == [1, 1] and not got["success"].any()
    line = lambda at, s: (at * s["x"], s["x"][:, :, None])
    got = lm.fitted(line, np.ones((2, 1)), {"x": x}, x, x)
    assert not got["success"].any() and (got["rms"] == 0).all() and (got["steps"] == 4).all()


def test_pull_draws_to_zero():
    line = lambda at, s: (at * s["x"], s["x"][:, :, None])
    x = np.ones((1, 4))
    got = lm.fitted(line, np.zeros((1, 1)), {"x": x}, x, x, lm.Steps(share=1e-9), np.array([4.0]))
    assert got["parameters"][0, 0] == pytest.approx(0.5, abs=1e-4)


@pytest.mark.parametrize("parts", [1, 7])
def test_one_fit_over_all_rows(spark, parts):
    rng = np.random.default_rng(2)
    true = [10.0, 0.3, -0.2, 1.5, 2.0, 0.0, 1.2, 1.0, 0.7]
    n = 3000
    s = {"z": rng.uniform(0, 20, n), "x": rng.uniform(-3, 3, n), "y": rng.uniform(-3, 3, n), "channel": rng.integers(0, 2, n).astype(float)}
    value = lm.focus_model(2)(np.array([true]), {k: v[None, :] for k, v in s.items()})[0][0] + 0.01 * rng.standard_normal(n)
    rows = [(*map(float, r), 1.0) for r in zip(*s.values(), value, strict=True)] + [(None, 1.0, 1.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "z double, x double, y double, channel double, value double, weight double").repartition(parts)
    free = [True] * 5 + [False] + [True] * 3
    start = [9.0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0]
    fit = lm.fit_all(df, list(s), lm.focus_model(2), start, free=free)
    assert fit.success and fit.rms < 0.011 and np.allclose(fit.parameters, true, atol=0.01) and fit.spread[5] == 0
    moves = np.flatnonzero(free)

    def part(at, samples):
        whole = np.array([start] * len(at))
        whole[:, moves] = at
        f, j = lm.focus_model(2)(whole, samples)
        return f, j[:, :, moves]

    p, _, n, good = alone(part, np.array(start)[moves], s, value, np.ones(n))
    assert np.allclose(np.array(fit.parameters)[moves], p, rtol=1e-6) and fit.steps == n and good


def test_nothing_to_fit(spark):
    df = spark.createDataFrame([], "x double, value double, weight double")
    fit = lm.fit_all(df, ["x"], lm.linear_model(["x"]), [1.0, 2.0])
    assert fit.parameters == [1.0, 2.0] and not fit.success and fit.steps == 0
    assert lm.solved(df, ["x"]) == [0.0, 0.0]


def test_linear_solution(spark):
    rng = np.random.default_rng(3)
    x, w = rng.standard_normal((200, 2)), rng.uniform(0, 1, 200)
    y = 3 + x @ [2.0, -1.0] + rng.standard_normal(200)
    df = spark.createDataFrame([(*map(float, r),) for r in np.c_[x, x[:, :1], y, w]], "a double, b double, copy double, value double, weight double")
    want = np.linalg.lstsq(np.c_[np.ones(200), x] * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    assert lm.solved(df, ["a", "b"]) == pytest.approx(want.tolist())
    twice = lm.solved(df, ["a", "b", "copy"])
    assert twice[1] == pytest.approx(twice[3]) and twice[1] + twice[3] == pytest.approx(want[1])
    assert lm.solved(df, ["a", "b"], [True, False, True])[1] == 0


SF = "/root/testdata/sf0.001"


def test_query_of_peaks(spark):
    """Each tile's fit equals one made alone; most succeed."""
    samples = {}
    for r in estimates.peak_samples(spark, SF).collect():
        samples.setdefault((r["ty"], r["tx"]), []).append([r[c] for c in (*estimates.COLUMNS, "value", "weight")])
    got = estimates.peak_fits(spark, SF).collect()
    assert {(r["ty"], r["tx"]) for r in got} == set(samples) and sum(r["success"] for r in got) >= 0.9 * len(got)
    for r in got:
        rows = np.array(sorted(samples[r["ty"], r["tx"]]))
        s = {c: rows[:, k] for k, c in enumerate(estimates.COLUMNS)}
        tops = [rows[s["pair"] == k, 5].max(initial=-1) for k in range(estimates.PAIRS)]
        start = [0.0, 4.0, 0.0, *(v if v > 0 else 0.1 for v in tops)]
        p, rms, n, good = alone(lm.peak_model(estimates.PAIRS), start, s, rows[:, 5], rows[:, 6], pull=np.array(estimates.PULL))
        assert (r["x0"], r["w"], r["wxy"], r["rms"]) == pytest.approx((*p[:3], rms), rel=1e-4, abs=1e-5) and (r["steps"], r["success"]) == (n, good)


def test_query_of_the_field(spark):
    got = estimates.joint_focus(spark, SF).collect()
    assert all(r["success"] for r in got) and got[0]["rms"] < 0.035
    for r, want in zip(got, estimates.FIELD, strict=True):
        assert r["value"] == pytest.approx(want, abs=max(5 * r["spread"], 0.02) + 0.01)
