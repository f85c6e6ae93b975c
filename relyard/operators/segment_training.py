"""The same logistic regression for every segment at once, with any number of features.

Segments of up to some megabytes meet by one shuffle and are fitted where they lie, many at once: a step is one numpy expression over the
rows of all of them, so it costs rows and not segments.

Larger ones are never gathered. Sums over their rows (moments, loss, gradient, packed curvature) are numpy vectors that add up: each task
makes one vector per segment it meets, and the vectors of a segment are added as they stream by. So a step is one pass with one matrix
product per segment and some megabytes, and a segment with a third of all rows is spread over its tasks. Between steps the state of these
segments is a stored table with one row each. No plan grows with the number of features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relyard.operators.split import class_key
from relyard.session import new_location

#: Bytes of vectors that a task holds before it hands them on, and of segment states that are broadcast.
HELD_BYTES, SENT_BYTES = 64 << 20, 64 << 20
#: Bytes of features of a segment that is fitted in one task, and of rows that a task takes at a time.
GATHERED_BYTES, TAKEN_BYTES = 16 << 20, 8 << 20
#: With more coefficients than this the curvature is a matrix product per segment, else one sum per pair of them.
PAIRED = 16
#: A step that makes the loss worse is halved so often at most.
HALVINGS = 40
STATE = (
    "key string, n double, n1 double, mean array<double>, scale array<double>, beta array<double>, candidate array<double>, loss double, "
    "steps int, halvings int, converged boolean, reason string"
)
FITTED = "key string, beta array<double>, steps int, converged boolean, reason string"


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_location(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _count_part(x: np.ndarray, y: np.ndarray, _: dict) -> np.ndarray:
    """Rows, positives, rows without label, rows with a gap, sums of the features."""
    gaps = np.isnan(x).any(axis=1).sum()
    return np.concatenate(([len(y), (y == 1).sum(), np.isnan(y).sum(), gaps], np.nansum(x, axis=0)))


def _spread_part(x: np.ndarray, y: np.ndarray, state: dict) -> np.ndarray:
    return ((x - state["mean"]) ** 2).sum(axis=0)


def _newton_part(x: np.ndarray, y: np.ndarray, state: dict) -> np.ndarray:
    """Weighted loss, gradient and upper triangle of the curvature at the candidate."""
    rows = np.column_stack((np.ones(len(y)), (x - state["mean"]) / state["scale"]))
    z = rows @ state["candidate"]
    weight = np.where(y == 1, state["n"] / (2 * state["n1"]), state["n"] / (2 * (state["n"] - state["n1"])))
    p = 0.5 * (1 + np.tanh(z / 2))
    gram = rows.T @ (rows * (weight * p * (1 - p))[:, None])
    loss = (weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum()
    return np.concatenate(([loss], rows.T @ (weight * ((y == 1) - p)), gram[np.triu_indices(len(gram))]))


def _sums(rows: DataFrame, part: Callable, states: DataFrame | None = None, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(key, sums): ``part`` of every segment added up. With ``states`` only their segments count; they are broadcast while they are small, and
    joined to the rows beyond that."""
    spark, names, sent = rows.sparkSession, ["n", "n1", "mean", "scale", "candidate"], None
    given, joined = rows.select("key", "y", "x"), False
    if states is not None:
        wanted = states.select("key", *names)
        size = wanted.agg(F.sum(8 * (F.size("mean") * 3 + 16))).first()[0] or 0
        if size <= sent_bytes:
            sent = spark.sparkContext.broadcast({r.key: {c: np.array(r[c]) for c in names} for r in wanted.collect()})
        else:
            given, joined = given.join(wanted.select("key", F.struct(*names).alias("state")), "key"), True

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        size = 0
        for batch in _taken(batches):
            coded = batch.column(0).dictionary_encode()
            codes, keys = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(y), -1)
            order = np.argsort(codes, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                key, state = keys[codes[own[0]]], {}
                if sent is not None:
                    if key not in sent.value:
                        continue
                    state = sent.value[key]
                elif joined:
                    state = {c: np.array(v) for c, v in batch.column(3)[int(own[0])].as_py().items()}
                sums = part(x[own], y[own], state)
                size += 0 if key in held else sums.nbytes
                held[key] = held[key] + sums if key in held else sums
            if size > HELD_BYTES:
                yield _vectors(held)
                held, size = {}, 0
        if held:
            yield _vectors(held)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = vector.values.to_numpy()
                if key != now:
                    if now is not None:
                        yield _vectors({now: sums})
                    now, sums = key, values.copy()
                else:
                    sums += values
        if now is not None:
            yield _vectors({now: sums})

    parts = given.mapInArrow(partial, "key string, sums array<double>")
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(total, "key string, sums array<double>")


def _vectors(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["key", "sums"])


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some megabytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > TAKEN_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in order of their keys as batches of whole segments, and where each segment starts."""
    rest = None
    for batch in _taken(batches):
        batch = batch if rest is None else pa.concat_batches([rest, batch])
        starts = _starts(batch)
        rest = batch.slice(starts[-1])
        if len(starts) > 1:
            yield batch.slice(0, starts[-1]), starts[:-1]
    if rest is not None and rest.num_rows:
        yield rest, _starts(rest)


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    codes = batch.column(0).dictionary_encode().indices.to_numpy()
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def _steps(state: dict[str, np.ndarray], loss: np.ndarray, gradient: np.ndarray, gram: np.ndarray, ridge: float, tolerance: float) -> None:
    """One Newton step of every segment from the sums at its candidate, or a shorter step where the candidate is worse than what there was.

    ``state`` holds an array per name with a row per segment, and changes; a loss that is not known yet is NaN.
    """
    candidate, before = state["candidate"].copy(), state["loss"].copy()
    penalty = np.full(candidate.shape[1], ridge)
    penalty[0] = 0.0  # the intercept is not penalised
    now = loss + 0.5 * (penalty * candidate**2).sum(axis=1)
    state["steps"] += 1
    worse = ~np.isnan(before) & ~(now <= before + 1e-12 * np.abs(before))
    best = state["beta"][worse]
    state["candidate"][worse] = best + (candidate[worse] - best) / 2
    state["halvings"][worse] += 1
    state["reason"][worse & (state["halvings"] > HALVINGS)] = "no descent"
    better = ~worse
    state["beta"][better], state["loss"][better], state["halvings"][better] = candidate[better], now[better], 0
    if ridge == 0:
        apart = better & (loss < 1e-6 * state["n"])
        state["reason"][apart] = "separable"
        better &= ~apart
    at = np.flatnonzero(better)
    move = _solved(gram[at] + np.diag(penalty), gradient[at] - penalty * candidate[at])
    finite = np.isfinite(move).all(axis=1)
    state["reason"][at[~finite]] = "singular"
    at, move = at[finite], move[finite]
    state["candidate"][at] = candidate[at] + move
    there = at[np.abs(move).max(axis=1) < tolerance]
    state["beta"][there], state["converged"][there] = state["candidate"][there], True


def _solved(matrices: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Solutions, NaN where there is none."""
    try:
        return np.linalg.solve(matrices, vectors[..., None])[..., 0]
    except np.linalg.LinAlgError:
        if len(matrices) == 1:
            return np.full(vectors.shape, np.nan)
        half = len(matrices) // 2
        return np.concatenate((_solved(matrices[:half], vectors[:half]), _solved(matrices[half:], vectors[half:])))


def _step(state: dict, sums: np.ndarray, ridge: float, tolerance: float) -> dict:
    """The step of one segment, from its packed sums."""
    size = len(state["candidate"])
    gram = np.zeros((size, size))
    gram[np.triu_indices(size)] = sums[1 + size :]
    gram = gram + np.triu(gram, 1).T
    names = ("n", "beta", "candidate", "loss", "steps", "halvings", "converged", "reason")
    one = {c: np.array([np.nan if c == "loss" and state[c] is None else state[c]], object if c == "reason" else None) for c in names}
    _steps(one, sums[:1], sums[None, 1 : 1 + size], gram[None], ridge, tolerance)
    plain = {c: one[c][0].tolist() for c in ("beta", "loss", "steps", "halvings", "converged")}
    return {**state, **plain, "candidate": one["candidate"][0], "reason": one["reason"][0]}


def _fitted(x: np.ndarray, y: np.ndarray, starts: np.ndarray, max_steps: int, ridge: float, tolerance: float) -> dict[str, np.ndarray]:
    """beta, steps, converged and reason of segments whose rows lie one after the other."""
    total = lambda v: np.add.reduceat(v, starts, axis=-1)
    count = np.diff(np.append(starts, len(y)))
    n, n1 = count.astype(float), total((y == 1).astype(float))
    reason = np.full(len(starts), None, object)
    reason[(n1 == 0) | (n1 == n)] = "one class"
    reason[total(np.isnan(x).any(axis=1).astype(int)) > 0] = "null feature"
    reason[total(np.isnan(y).astype(int)) > 0] = "null label"
    state = {
        "n": n, "beta": np.zeros((len(n), x.shape[1] + 1)), "candidate": np.zeros((len(n), x.shape[1] + 1)), "loss": np.full(len(n), np.nan),
        "steps": np.zeros(len(n), np.int32), "halvings": np.zeros(len(n), np.int32), "converged": np.zeros(len(n), bool), "reason": reason,
    }
    moving = np.flatnonzero(np.equal(reason, None))
    if not len(moving):
        return state

    own = np.repeat(np.equal(reason, None), count)
    y, columns, count, n, n1 = y[own] == 1, np.ascontiguousarray(x[own].T), count[moving], n[moving], n1[moving]
    starts = np.append(0, np.cumsum(count)[:-1])
    columns -= np.repeat(total(columns) / n, count, axis=1)
    scale = np.sqrt(total(columns**2) / n)
    columns /= np.repeat(np.where(scale == 0, 1.0, scale), count, axis=1)
    columns = np.vstack((np.ones(len(y)), columns))
    weight = np.where(y, np.repeat(n / (2 * n1), count), np.repeat(n / (2 * (n - n1)), count))
    for _ in range(max_steps):
        now = {c: v[moving] for c, v in state.items()}
        _steps(now, *_newton_sums(columns, y, weight, now["candidate"], count, starts), ridge, tolerance)
        for c, v in now.items():
            state[c][moving] = v
        still = ~now["converged"] & np.equal(now["reason"], None)
        if not still.all():
            own = np.repeat(still, count)
            columns, y, weight, count, moving = columns[:, own], y[own], weight[own], count[still], moving[still]
            starts = np.append(0, np.cumsum(count)[:-1])
        if not len(moving):
            break
    state["reason"][moving] = "not converged"
    return state


def _newton_sums(columns: np.ndarray, y: np.ndarray, weight: np.ndarray, candidate: np.ndarray, count: np.ndarray, starts: np.ndarray) -> tuple:
    """Weighted loss, gradient and curvature at each segment's candidate; ``columns`` has a row per coefficient."""
    size = len(columns)
    z = sum(column * np.repeat(candidate[:, i], count) for i, column in enumerate(columns))
    p = 0.5 * (1 + np.tanh(z / 2))
    loss = np.add.reduceat(weight * np.logaddexp(0, np.where(y, -z, z)), starts)
    gradient = np.add.reduceat(columns * (weight * (y - p)), starts, axis=1).T
    curve = weight * p * (1 - p)
    gram = np.empty((len(starts), size, size))
    if size > PAIRED:
        for k, (a, m) in enumerate(zip(starts, count)):
            gram[k] = (columns[:, a : a + m] * curve[a : a + m]) @ columns[:, a : a + m].T
    else:
        for i in range(size):
            for j in range(i, size):
                gram[:, i, j] = gram[:, j, i] = np.add.reduceat(columns[i] * columns[j] * curve, starts)
    return loss, gradient, gram


def train_segments(
    df: DataFrame,
    segment: str,
    features: Sequence[str],
    label: str,
    max_steps: int = 200,
    tolerance: float = 1e-9,
    ridge: float = 1.0,
    sent_bytes: int = SENT_BYTES,
    gathered_bytes: int = GATHERED_BYTES,
) -> DataFrame:
    """(segment, intercept, coefs, steps, converged, reason): balanced, standardized logistic regression with a ridge, per segment.

    ``coefs`` follow ``features`` and hold for standardized values. Every segment has a row, rows without a segment are one of their own. One
    that cannot be fitted has nulls and a reason: 'null label', 'null feature', 'one class', 'separable' (without a ridge), 'singular',
    'no descent' or 'not converged'.
    """
    vector = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    rows = df.select(class_key(segment).alias("key"), F.col(f"`{segment}`").alias("segment"), F.col(f"`{label}`").cast("double").alias("y"), vector.alias("x"))
    rows = _stored(rows, "segment-rows")
    size = len(features)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole(batches):
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(y), size)
            found = _fitted(x, y, starts, max_steps, ridge, tolerance)
            columns = [batch.column("key").take(pa.array(starts)), pa.array([*found["beta"]], pa.list_(pa.float64())), pa.array(found["steps"]), pa.array(found["converged"]), pa.array(found["reason"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "beta", "steps", "converged", "reason"])

    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 8 * size > gathered_bytes).select("key")
    large = _stored(large, "segment-large")
    given = rows.select("key", "y", "x")
    # Each of these keys has some megabytes of rows, so they are few beside them.
    any_large = not large.isEmpty()
    small = given.join(F.broadcast(large), "key", "left_anti") if any_large else given
    every = _stored(small.repartition("key").sortWithinPartitions("key").mapInArrow(fit, FITTED), "segment-fitted")
    if any_large:
        every = every.unionByName(_spread_fit(given.join(F.broadcast(large), "key", "left_semi"), size, max_steps, tolerance, ridge, sent_bytes))
    fitted = F.col("converged")
    names = rows.groupBy("key").agg(F.any_value("segment").alias(segment))
    return names.join(every, "key").select(
        segment,
        F.when(fitted, F.element_at("beta", 1)).alias("intercept"),
        F.when(fitted, F.slice("beta", 2, size)).alias("coefs"),
        "steps",
        "converged",
        "reason",
    )


def _spread_fit(rows: DataFrame, size: int, max_steps: int, tolerance: float, ridge: float, sent_bytes: int) -> DataFrame:
    """``FITTED`` of segments of any size, a pass over their rows per step."""
    counted = _stored(_sums(rows, _count_part), "segment-sums")
    at = lambda i: F.element_at("sums", i + 1)
    reason = F.when(at(2) > 0, "null label").when(at(3) > 0, "null feature").when((at(1) == 0) | (at(1) == at(0)), "one class")
    mean = F.transform(F.slice("sums", 5, size), lambda s: s / at(0))
    ones, zeros = F.array_repeat(F.lit(1.0), size), F.array_repeat(F.lit(0.0), size + 1)
    states = counted.select(
        "key", at(0).alias("n"), at(1).alias("n1"), mean.alias("mean"), ones.alias("scale"), zeros.alias("beta"), zeros.alias("candidate"),
        F.lit(None).cast("double").alias("loss"), F.lit(0).alias("steps"), F.lit(0).alias("halvings"), F.lit(False).alias("converged"), reason.alias("reason"),
    )
    states = _stored(states, "segment-states")
    moving = states.where("reason IS NULL")
    spread = _sums(rows, _spread_part, moving, sent_bytes)
    deviation = F.transform(F.zip_with("sums", F.array_repeat(F.col("n"), size), lambda s, n: F.sqrt(s / n)), lambda d: F.when(d == 0, 1.0).otherwise(d))
    scaled = moving.join(spread, "key").withColumn("scale", deviation).drop("sums")
    done = [states.where("reason IS NOT NULL")]
    moving = _stored(scaled.select(states.columns), "segment-states")

    def newton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sums = np.array(row.pop("sums"))
                out.append(_step(row, sums, ridge, tolerance))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([f for f in batch.schema if f.name != "sums"]))

    for _ in range(max_steps):
        if moving.isEmpty():
            break
        sums = _sums(rows, _newton_part, moving, sent_bytes)
        stepped = _stored(moving.join(sums, "key").select(*moving.columns, "sums").mapInArrow(newton, STATE), "segment-states")
        done.append(stepped.where("converged OR reason IS NOT NULL"))
        moving = stepped.where("NOT converged AND reason IS NULL")
    done.append(moving.withColumn("reason", F.lit("not converged")))
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every.select("key", "beta", "steps", "converged", "reason")
