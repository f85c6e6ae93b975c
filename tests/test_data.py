"""Split, features, fingerprints and training against plain Python and numpy."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relyard.functions.hashing import row_text
from relyard.operators import features, fingerprint, ordered, split, training
from relyard.sources import tables


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 3)) * [1, 5, 100] + [0, 3, -7]
    z = x[:, 0] - 0.3 * (x[:, 1] - 3) + 0.01 * x[:, 2]
    y = (rng.random(700) < 1 / (1 + np.exp(-z))).astype(int)
    seg = np.where(rng.random(700) < 0.5, "hot", np.where(rng.random(700) < 0.5, "b", "c"))
    rows = [(i, str(s), int(t), *map(float, v)) for i, (s, t, v) in enumerate(zip(seg, y, x))]
    return rows, spark.createDataFrame(rows, "id bigint, seg string, y int, f0 double, f1 double, f2 double").persist()


FEATURES = ["f0", "f1", "f2"]


def test_split_is_exact_disjoint_and_repeatable(labelled):
    rows, df = labelled
    parts = split.stratified_split(df, "y", "id")
    side = {r["id"]: r["split"] for r in parts.collect()}
    assert len(side) == 700 and sum(s == "test" for s in side.values()) == math.ceil(0.2 * 700)
    for label in (0, 1):
        ids = [r[0] for r in rows if r[2] == label]
        taken = [i for i in ids if side[i] == "test"]
        assert abs(len(taken) - 0.2 * len(ids)) < 1
        ordered = sorted(ids, key=lambda i: hashlib.sha256(f"42:{i}".encode()).hexdigest())
        assert set(taken) == set(ordered[: len(taken)])
    again = split.stratified_split(df.repartition(7, "f0"), "y", "id")
    assert {r["id"]: r["split"] for r in again.collect()} == side
    cuts = split.split_cuts(df, "y", "id", prefix_digits=1)
    assert sorted(map(tuple, cuts.collect())) == sorted(map(tuple, split.split_cuts(df, "y", "id").collect()))


def test_split_of_many_classes_and_missing_labels(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 5000).alias("y"))
    parts = split.stratified_split(df, "y", "id")
    assert parts.columns == ["id", "y", "split"] and parts.count() == 20_000
    sides = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert sides == {"test": 4_000, "train": 16_000}
    lost = parts.filter("y IS NULL").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in lost} == {"test": 1_000, "train": 4_000}


@pytest.mark.parametrize("counts,n_test", [([10], [2]), ([3, 3, 3], [1, 1, 0]), ([1, 1], [1, 0]), ([4933, 10067], [987, 2013]), ([10**11, 3 * 10**11 + 1], [2 * 10**10, 6 * 10**10 + 1])])
def test_test_sizes(spark, counts, n_test):
    df = spark.createDataFrame(list(enumerate(counts)), "label int, n bigint")
    got = {r["label"]: r["n_test"] for r in split.test_sizes(df, "label", 0.2).collect()}
    assert [got[i] for i in range(len(counts))] == n_test


def test_scaler_and_weights(spark, labelled):
    rows, df = labelled
    const = df.withColumn("c", F.lit(3.0))
    fitted = {r["feature"]: r for r in features.fit_scaler(const, [*FEATURES, "c"]).collect()}
    x = np.array([r[3:] for r in rows])
    assert np.allclose([fitted[f]["std"] for f in FEATURES], x.std(axis=0)) and fitted["c"]["std"] == 0.0
    scaled = features.apply_scaler(const, features.fit_scaler(const, [*FEATURES, "c"]), [*FEATURES, "c"])
    got = np.array([[r[f] for f in (*FEATURES, "c")] for r in scaled.orderBy("id").collect()])
    assert np.allclose(got[:, :3], (x - x.mean(axis=0)) / x.std(axis=0)) and (got[:, 3] == 0).all()
    weights = {r["y"]: r["weight"] for r in features.class_weights(df, "y").collect()}
    n1 = sum(r[2] for r in rows)
    assert math.isclose(weights[1], 700 / (2 * n1)) and math.isclose(weights[0], 700 / (2 * (700 - n1)))


def test_label_cast_truncates_and_rejects_null(spark):
    df = spark.createDataFrame([(1.9,), (-1.9,), (0.0,)], "y double")
    assert [r[0] for r in df.select(features.label_cast(F.col("y"))).collect()] == [1, -1, 0]
    bad = spark.createDataFrame([(None,)], "y double")
    with pytest.raises(Exception, match="null label"):
        bad.select(features.label_cast(F.col("y"))).collect()


def test_feature_stats_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 2.0)], "a double, b double")
    got = {r["feature"]: r for r in features.feature_stats(df, [], ["a", "b"]).collect()}
    assert (got["a"]["mean"], got["a"]["std"], got["a"]["nulls"]) == (2.0, 1.0, 0)
    assert (got["b"]["count"], got["b"]["nulls"]) == (1, 1)


def test_psi_with_missing_values_and_an_empty_side(spark):
    rows = [(float(i), "l") for i in range(10)] + [(0.0, "r")] * 5 + [(None, "r")] * 5
    df = spark.createDataFrame(rows, "a double, s string")
    zeroed = df.fillna(0.0)
    assert features.psi(df, "s", "l", "r", ["a"]).first()["psi"] != features.psi(zeroed, "s", "l", "r", ["a"]).first()["psi"]
    assert features.feature_drift(df.filter("s = 'l'"), "s", "l", "r", ["a"]).first()["psi"] > 1
    assert features.psi(df.limit(0), "s", "l", "r", ["a"]).count() == 0


def test_psi_of_equal_sides_is_zero(spark):
    df = spark.range(200).select((F.col("id") % 100).cast("double").alias("a"), F.when(F.col("id") < 100, "l").otherwise("r").alias("s"))
    assert features.psi(df, "s", "l", "r", ["a"]).first()["psi"] == 0.0


def test_multiset_hash_invariants(labelled):
    _, df = labelled
    h = lambda x: fingerprint.content_hash_multiset(x).first()["content_hash"]
    base = h(df)
    assert h(df.repartition(5, "f1").select("f2", "y", "id", "f0", "seg", "f1")) == base
    assert h(df.unionAll(df.limit(1))) != base
    assert h(df.withColumn("f0", F.when(F.col("id") == 3, F.col("f0") + 1e-12).otherwise(F.col("f0")))) != base
    halves = [fingerprint.content_sums(df.filter(c)) for c in ("id < 300", "id >= 300")]
    joined = fingerprint.combine_sums(halves[0].unionByName(halves[1]))
    assert joined.select(fingerprint.finish_digest().alias("h")).first()["h"] == base


def test_row_text_tells_null_empty_and_separators_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a"), ("~", "a"), ("\x1f", "a"), ("a", "\x1f"), ("\\u", "a"), ("\x1f=a", "")], "p string, q string")
    assert df.select(row_text(df).alias("t")).distinct().count() == 7


def test_ordered_hash(labelled):
    _, df = labelled
    bins = [F.shiftright("id", 8), F.shiftright("id", 4)]
    h = lambda x, order=("id",), b=bins: fingerprint.content_hash_ordered(x, list(order), b).first()["content_hash"]
    base = h(df)
    assert h(df.repartition(3, "f2").select("y", "f2", "f1", "f0", "seg", "id")) == base
    assert h(df, ("f0", "id"), [F.floor("f0")]) != base
    with pytest.raises(ValueError, match="nope"):
        h(df, ("nope",))
    # A key that rows share still gives one hash, however the rows arrive.
    seg = [F.length("seg")]
    assert h(df, ("seg",), seg) == h(df.repartition(5, "f1"), ("seg",), seg) != base


def test_hash_ignores_time_zone_and_map_order(spark):
    def hashed(zone, text):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            df = spark.sql(f"SELECT CAST(s AS TIMESTAMP) AS t, {text} AS m FROM VALUES ('2024-11-03T05:30:00Z'), ('2024-11-03T06:30:00Z') v(s)")
            return fingerprint.content_hash_multiset(df).first()["content_hash"], df.select(row_text(df).alias("t")).distinct().count()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    one = hashed("UTC", "map('a', 1, 'b', 2)")
    assert one == hashed("America/New_York", "map('b', 2, 'a', 1)") and one[1] == 2
    with pytest.raises(ValueError, match="no fixed order"):
        fingerprint.content_hash_multiset(spark.sql("SELECT array(map('a', 1)) AS x"))


def test_ordered_hash_against_python(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "id bigint, v int")
    limbs, mask = [0] * 13, (1 << 20) - 1
    for i in range(50):
        inner = hashlib.sha256(f"={i}\x1f={i % 3}".encode()).hexdigest()
        digest = hashlib.sha256(f"{i}:{inner}".encode()).hexdigest()
        limbs[12] += int(digest[60:], 16)
        for k in range(4):
            piece = int(digest[15 * k : 15 * k + 15], 16)
            for j, limb in enumerate((piece >> 40, (piece >> 20) & mask, piece & mask)):
                limbs[3 * k + j] += limb
    want = hashlib.sha256("|".join(map(str, [50, *limbs])).encode()).hexdigest()
    got = fingerprint.content_hash_ordered(df, ["id"], [F.shiftright("id", 3)]).first()["content_hash"]
    assert got == want


def test_schema_config_and_contract_hashes(spark, labelled):
    _, df = labelled
    got = fingerprint.schema_hash(fingerprint.schema_columns(spark, {"t": df})).first()["schema_hash"]
    pairs = [["id", "int64"], ["seg", "object"], ["y", "int32"], ["f0", "float64"], ["f1", "float64"], ["f2", "float64"]]
    text = json.dumps(pairs, separators=(",", ":"))
    assert got == hashlib.sha256(text.encode()).hexdigest() and fingerprint.schema_text(df) == text
    assert fingerprint.schema_text(df.select("y", "id")) != fingerprint.schema_text(df.select("id", "y"))

    params = {"model_type": "logreg", "max_iter": 2000, "solver": "lbfgs", "class_weight": "balanced", "random_state": 42}
    params |= {"C": 0.5, "flag": True, "none": None, 'quo"te': 'a "b"\\ \n\té', "empty": ""}
    kinds = {int: "number", float: "number", bool: "bool"}
    texts = [("r", k, None if v is None else json.dumps(v) if type(v) in kinds else v, kinds.get(type(v), "text")) for k, v in params.items()]
    long = spark.createDataFrame(texts, "run_id string, key string, value string, value_type string")
    want = hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert fingerprint.config_hash(long).first()["config_hash"] == want

    odd = df.withColumnRenamed("seg", 'se"g é')
    text = json.dumps([[n, "object" if t == "string" else fingerprint.hash_type(t)] for n, t in odd.dtypes], separators=(",", ":"))
    assert fingerprint.schema_text(odd) == text
    assert fingerprint.schema_hash(fingerprint.schema_columns(spark, {"t": odd})).first()["schema_hash"] == hashlib.sha256(text.encode()).hexdigest()

    contract = df.withColumn("part", F.lit("train"))
    row = fingerprint.dataset_fingerprint(contract, "part", 'file:///d "é"', " ")
    values = row.first().asDict()
    assert values["git_sha"] == "unknown" and values["row_count"] == 700
    assert row.select(fingerprint.fingerprint_json().alias("j")).first()["j"] == json.dumps(values, indent=2, sort_keys=True)
    tags = {r["key"]: r["value"] for r in fingerprint.fingerprint_tags(row).collect()}
    assert tags["row_count"] == "700" and "schema_version" not in tags and len(tags) == 5


def newton(x, y, w):
    x = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.eye(x.shape[1])
    ridge[0, 0] = 0
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ b)
    return b


def balanced(rows):
    x, y = np.array([r[3:] for r in rows]), np.array([r[2] for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    n1 = y.sum()
    return x, y, np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))


def test_logistic_regression(labelled):
    rows, df = labelled
    model = training.train_logreg(df, FEATURES, "y").orderBy("feature_pos").collect()
    want = newton(*balanced(rows))
    assert np.allclose([model[0]["intercept"], *[r["coef"] for r in model]], want, atol=1e-5)


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_per_segment_regression(labelled, limit, monkeypatch):
    monkeypatch.setattr(ordered, "MAX_BROADCAST_BYTES", limit)
    rows, df = labelled
    got = {r["seg"]: [r["intercept"], *[r[f"coef_{f}"] for f in FEATURES]] for r in training.train_per_segment(df, "seg", FEATURES, "y").collect()}
    assert set(got) == {"hot", "b", "c"}
    for seg in got:
        assert np.allclose(got[seg], newton(*balanced([r for r in rows if r[1] == seg])), atol=1e-7)


def test_segments_that_cannot_be_fitted_are_reported(spark, labelled):
    _, df = labelled
    odd = df.unionByName(df.limit(3).withColumns({"seg": F.lit("same"), "y": F.lit(1)}))
    odd = odd.unionByName(df.limit(4).withColumns({"seg": F.lit("gap"), "f1": F.lit(None).cast("double")}))
    odd = odd.unionByName(df.limit(4).withColumns({"seg": F.lit("open"), "y": F.lit(None).cast("int")}))
    got = {r["seg"]: r for r in training.train_per_segment(odd, "seg", FEATURES, "y").collect()}
    assert {s: r["reason"] for s, r in got.items() if r["reason"]} == {"same": "one class", "gap": "null feature", "open": "null label"}
    assert got["same"]["intercept"] is None and not got["same"]["converged"]
    assert all(got[s]["converged"] and got[s]["steps"] > 2 for s in ("hot", "b", "c"))
    short = {r["seg"]: r for r in training.train_per_segment(df, "seg", FEATURES, "y", max_steps=2).collect()}
    assert all(r["steps"] == 2 and not r["converged"] and r["intercept"] is not None for r in short.values())


def test_opaque_model(labelled):
    rows, df = labelled

    class Ones:
        def predict(self, frame):
            return [1.0] * len(frame)

    score = training.predictor_udf(Ones())
    assert df.select(score(F.struct(*FEATURES)).alias("p")).filter("p = 1.0").count() == len(rows)


def test_required_columns_and_text_sinks(spark, labelled, location):
    _, df = labelled
    with pytest.raises(ValueError, match="target"):
        tables.require_columns(df, ["target"], "raw")
    assert tables.require_columns(df, ["y"], "raw") is df
    reports = tables.json_report(df.limit(2), ["id"], ["y", "f0"])
    tables.write_json_report(reports, location)
    texts = [r["value"] for r in spark.read.text(location).collect()]
    assert sorted(texts) == sorted(r["report"] for r in reports.collect())
    assert list(json.loads(texts[0])) == ["f0", "y"]
    tables.write_json_report(reports.limit(1), f"{location}-2", indent=2)
    text = "\n".join(r["value"] for r in spark.read.text(f"{location}-2").collect())
    assert text == json.dumps(json.loads(text), indent=2, sort_keys=True) and text.count("\n") == 3
    with pytest.raises(ValueError, match="target"):
        tables.write_raw(df, f"{location}-3", ["target"])


def test_run_log_round_trip(spark, location):
    rows = [("e", "r1", {"step": "train"}, {"c": "1"}, {"auc": 0.5}), ("e", "r2", {}, {}, {}), ("f", "r3", {"a": "x", "b": ""}, {}, {"m": 1.0})]
    runs = spark.createDataFrame(rows, "experiment string, run_id string, tags map<string,string>, params map<string,string>, metrics map<string,double>")
    long = tables.run_log_long(runs)
    tables.append_run_log(long, location)
    tables.append_run_log(long, location)  # a retry leaves copies, which the maps must not repeat
    back = {r["run_id"]: r for r in tables.run_log_maps(spark.read.parquet(location)).collect()}
    assert back["r1"]["tags"] == {"step": "train"} and back["r1"]["metrics"] == {"auc": 0.5}
    assert back["r3"]["tags"] == {"a": "x", "b": ""} and back["r3"]["params"] == {}
    again = long.withColumn("logged_at", F.lit(1)).unionByName(
        long.filter("kind = 'metric'").withColumns({"logged_at": F.lit(2), "metric_value": F.lit(0.25)})
    )
    assert {r["run_id"]: r["metrics"] for r in tables.run_log_maps(again).collect()} == {"r1": {"auc": 0.25}, "r3": {"m": 0.25}}


def test_feature_names_with_spaces(labelled):
    """Real feature names look like 'mean radius'."""
    rows, df = labelled
    names = [f"mean radius {f}" for f in FEATURES]
    spaced = df.select("id", "seg", "y", *[F.col(f).alias(n) for f, n in zip(FEATURES, names)])
    stats = {r["feature"]: r["count"] for r in features.feature_stats(spaced, [], names).collect()}
    assert stats == {n: len(rows) for n in names}
    scaled = features.apply_scaler(spaced, features.fit_scaler(spaced, names), names)
    assert abs(scaled.agg(F.avg(F.col(names[2]))).first()[0]) < 1e-9
    model = training.train_logreg(spaced, names, "y").orderBy("feature_pos").collect()
    assert [r["feature"] for r in model] == names
    assert np.allclose([model[0]["intercept"], *[r["coef"] for r in model]], newton(*balanced(rows)), atol=1e-5)
    assert training.train_per_segment(spaced, "seg", names, "y").count() == 3
    assert fingerprint.content_hash_multiset(spaced).first()["row_count"] == len(rows)
