"""Segment training by packed vectors against a numpy solve of each segment."""

import numpy as np
import pyarrow as pa
import pytest

from relyard.operators import segment_training as seg, training


def solve(x, y, ridge=1.0):
    """Newton steps with halving on the penalised, balanced loss, in plain numpy."""
    scale = x.std(axis=0)
    rows = np.column_stack((np.ones(len(y)), (x - x.mean(axis=0)) / np.where(scale == 0, 1, scale)))
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    penalty = np.full(rows.shape[1], ridge)
    penalty[0] = 0
    loss = lambda b: (w * np.logaddexp(0, np.where(y == 1, -(rows @ b), rows @ b))).sum() + 0.5 * (penalty * b * b).sum()
    b = np.zeros(rows.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(rows @ b)))
        step = np.linalg.solve((rows * (w * p * (1 - p))[:, None]).T @ rows + np.diag(penalty), rows.T @ (w * (y - p)) - penalty * b)
        while loss(b + step) > loss(b) + 1e-12:
            step = step / 2
        b = b + step
        if np.abs(step).max() < 1e-11:
            return b
    return b


def table(spark, groups, names, seed=0):
    rows = []
    for name, (x, y) in groups.items():
        rows += [(name, *map(float, r), None if t is None else int(t)) for r, t in zip(x, y)]
    np.random.default_rng(seed).shuffle(order := list(range(len(rows))))
    schema = "s string, " + ", ".join(f"`{n}` double" for n in names) + ", y int"
    return spark.createDataFrame([rows[i] for i in order], schema).repartition(5)


def groups_of(rng, d, sizes):
    out = {}
    for k, n in enumerate(sizes):
        x = rng.normal(size=(n, d)) * rng.uniform(0.1, 50, d) + rng.normal(size=d) * 10
        y = (x[:, 0] - x[:, 0].mean() + rng.normal(size=n) * x[:, 0].std() > 0).astype(int)
        y[:2] = (0, 1)
        out[None if k == 0 else f"s{k}"] = (x, y)
    return out


@pytest.mark.parametrize("sent", [seg.SENT_BYTES, 0])
def test_equals_numpy(spark, monkeypatch, sent):
    """Also a null segment, a hot one, a constant feature, and states that are joined because they are too large to send."""
    groups = groups_of(np.random.default_rng(2), 3, [40, 900, 12, 60])
    groups["s2"][0][:, 2] = 7.0
    df = table(spark, groups, ["a", "b c", "k"]).withColumnRenamed("k", "key")
    got = {r.s: r for r in seg.train_segments(df, "s", ["a", "b c", "key"], "y", sent_bytes=sent).collect()}
    assert got.keys() == groups.keys()
    for name, (x, y) in groups.items():
        assert got[name].converged and got[name].reason is None
        np.testing.assert_allclose([got[name].intercept, *got[name].coefs], solve(x, y), atol=1e-7)
    old = {r.s: r for r in training.train_per_segment(df.where("s IS NOT NULL"), "s", ["a", "key"], "y").collect()}
    new = {r.s: r for r in seg.train_segments(df.where("s IS NOT NULL"), "s", ["a", "key"], "y").collect()}
    for name, r in old.items():
        np.testing.assert_allclose(new[name].coefs, [r.coef_a, r.coef_key], atol=1e-7)


def test_two_hundred_features(spark):
    groups = groups_of(np.random.default_rng(3), 200, [400, 300])
    names = [f"f{k}" for k in range(200)]
    got = {r.s: r for r in seg.train_segments(table(spark, groups, names), "s", names, "y").collect()}
    for name, (x, y) in groups.items():
        np.testing.assert_allclose([got[name].intercept, *got[name].coefs], solve(x, y), atol=1e-6)


def test_segments_that_cannot_be_fitted_say_why(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 1))
    apart = (np.r_[np.full(15, -1.0), np.full(15, 1.0)].reshape(-1, 1), np.r_[np.zeros(15), np.ones(15)])
    groups = {"one": (x, np.ones(30)), "null label": (x, [None, *([0, 1] * 14), 1]), "gap": (np.r_[x[:29], [[np.nan]]], [0, 1] * 15), "apart": apart, "fine": (x, [0, 1] * 15)}
    df = table(spark, groups, ["a"]).selectExpr("s", "nanvl(a, NULL) AS a", "y")
    fitted = seg.train_segments(df, "s", ["a"], "y", ridge=0.0)
    got = {r.s: (r.reason, r.converged, r.coefs is None) for r in fitted.collect()}
    assert got == {"one": ("one class", False, True), "null label": ("null label", False, True), "gap": ("null feature", False, True), "apart": ("separable", False, True), "fine": (None, True, False)}
    assert {r.s: r.reason for r in seg.train_segments(df.where("s = 'fine'"), "s", ["a"], "y", max_steps=1).collect()} == {"fine": "not converged"}
    assert seg.train_segments(df.where("false"), "s", ["a"], "y").collect() == []


def test_a_step_that_makes_it_worse_is_halved():
    state = {"n": 10.0, "n1": 5.0, "beta": [0.0, 0.0], "candidate": [8.0, -4.0], "loss": 1.0, "steps": 3, "halvings": 0, "converged": False, "reason": None}
    sums = np.array([5.0, 0, 0, 1, 0, 1])
    new = seg._step(state, sums, 1.0, 1e-9)
    assert new["candidate"].tolist() == [4.0, -2.0] and new["beta"] == [0.0, 0.0] and new["halvings"] == 1 and new["reason"] is None
    assert seg._step({**state, "halvings": seg.HALVINGS}, sums, 1.0, 1e-9)["reason"] == "no descent"


@pytest.mark.parametrize(("gathered", "sent"), [(0, seg.SENT_BYTES), (0, 0), (10_000, seg.SENT_BYTES), (seg.GATHERED_BYTES, seg.SENT_BYTES)])
def test_gathered_and_spread_segments_are_the_same(spark, gathered, sent):
    """All spread, with states sent and joined; one large segment among gathered ones; all gathered."""
    groups = groups_of(np.random.default_rng(5), 3, [40, 900, 12, 60])
    groups["s2"][0][:, 2] = 7.0
    rng = np.random.default_rng(6)
    groups |= {"one": (rng.normal(size=(9, 3)), np.zeros(9)), "unlabelled": (rng.normal(size=(4, 3)), [0, 1, None, 1]), "gap": (np.full((4, 3), np.nan), [0, 1, 0, 1])}
    df = table(spark, groups, ["a", "b", "c"]).selectExpr("s", "nanvl(a, NULL) AS a", "b", "c", "y")
    got = {r.s: r for r in seg.train_segments(df, "s", ["a", "b", "c"], "y", sent_bytes=sent, gathered_bytes=gathered).collect()}
    reasons = {"one": "one class", "unlabelled": "null label", "gap": "null feature"}
    assert {s: r.reason for s, r in got.items()} == {s: reasons.get(s) for s in groups}
    for name, (x, y) in groups.items():
        assert got[name].converged == (name not in reasons)
        if name not in reasons:
            np.testing.assert_allclose([got[name].intercept, *got[name].coefs], solve(x, y), atol=1e-7)
        else:
            assert got[name].coefs is None and got[name].intercept is None and got[name].steps == 0
    few = {r.s: r.reason for r in seg.train_segments(df, "s", ["a", "b", "c"], "y", max_steps=2, sent_bytes=sent, gathered_bytes=gathered).collect()}
    assert few == {s: reasons.get(s, "not converged") for s in groups}


def test_small_segments_take_no_pass_per_step(spark, monkeypatch):
    """Thousands of small segments are fitted in one pass; each Newton step was a pass over all rows that paid for every segment."""
    rng = np.random.default_rng(7)
    groups = {f"s{k}": (rng.normal(size=(5, 2)), [0, 1, *rng.integers(0, 2, 3)]) for k in range(2000)}
    df, stored = table(spark, groups, ["a", "b"]).cache(), []
    real = seg._stored
    monkeypatch.setattr(seg, "_stored", lambda df, name: stored.append(name) or real(df, name))
    got = {r.s: r for r in seg.train_segments(df, "s", ["a", "b"], "y").collect()}
    df.unpersist()
    assert len(stored) <= 4 and got.keys() == groups.keys()
    for name in [*groups][:200]:
        x, y = groups[name]
        np.testing.assert_allclose([got[name].intercept, *got[name].coefs], solve(x, np.array(y)), atol=1e-7)


def test_segments_stay_whole_over_batches(monkeypatch):
    """Batches end where the bytes say; a segment that goes over an end waits for its rest."""
    sizes = [1, 7, 30, 2, 2, 55, 3]
    keys = np.repeat([f"k{i}" for i in range(len(sizes))], sizes).tolist()
    rows = pa.RecordBatch.from_pydict({"key": keys, "at": list(range(len(keys)))})
    for held in (0, 40, 300, 1 << 20):
        monkeypatch.setattr(seg, "TAKEN_BYTES", held)
        for step in (1, 4, 100):
            found = [(b, s) for b, s in seg._whole(rows.slice(k, step) for k in range(0, len(keys), step))]
            assert [t for b, _ in found for t in b["at"].to_pylist()] == list(range(len(keys)))
            cut = [b.slice(a, e - a)["key"].to_pylist() for b, s in found for a, e in zip(s, [*s[1:], b.num_rows])]
            assert cut == [[f"k{i}"] * n for i, n in enumerate(sizes)]


def test_steps_of_many_segments_are_those_of_each():
    """Without a ridge, with a segment that has no solution and one that is halved among them; and more coefficients than are paired."""
    rng = np.random.default_rng(9)
    x = np.vstack((rng.normal(size=(20, 2)), np.repeat(rng.normal(size=(20, 1)), 2, axis=1), np.array([[-3.0, 0], [3, 0]] * 5) + rng.normal(size=(10, 2)) / 2, rng.normal(size=(30, 2))))
    y = np.concatenate((rng.integers(0, 2, 40), [0, 1] * 5, rng.integers(0, 2, 30))).astype(float)
    together = seg._fitted(x, y, np.array([0, 20, 40, 50]), 200, 0.0, 1e-9)
    assert together["reason"].tolist() == [None, "singular", "separable", None]
    for k, (a, e) in enumerate(((0, 20), (20, 40), (40, 50), (50, 80))):
        alone = seg._fitted(x[a:e], y[a:e], np.array([0]), 200, 0.0, 1e-9)
        assert alone["reason"][0] == together["reason"][k] and alone["steps"][0] == together["steps"][k]
        if alone["reason"][0] is None:
            np.testing.assert_allclose(alone["beta"][0], together["beta"][k], atol=1e-8)
            np.testing.assert_allclose(alone["beta"][0], solve(x[a:e], y[a:e], 0.0), atol=1e-6)
    columns, candidate = np.vstack((np.ones(80), x.T)), rng.normal(size=(4, 3))
    args = (columns, y == 1, rng.uniform(size=80), candidate, np.array([20, 20, 10, 30]), np.array([0, 20, 40, 50]))
    paired = seg._newton_sums(*args)
    seg.PAIRED, kept = 0, seg.PAIRED
    try:
        for one, other in zip(paired, seg._newton_sums(*args)):
            np.testing.assert_allclose(one, other, rtol=1e-12)
    finally:
        seg.PAIRED = kept
