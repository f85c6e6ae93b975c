"""Language by hierarchical discrimination: the family first, then one-versus-one linear support vector machines inside it.

Features are frequencies of hashed byte 1-, 2- and 3-grams over the letters of the whole lower-cased text, square-rooted and scaled to length one.
Models are fitted on at most ``PER_LANGUAGE`` documents of each language (those with the smallest hash of their id), taken from documents that are
not held out; every document is predicted. Only that bounded sample comes to the driver.

``predict(docs)`` returns one row per input row: doc_id, held_out, lang_pred, score. Texts that are null or have no letter are ``und`` with score 0,
and so is every text when nothing could be learned. A single known language is predicted everywhere. Null and blank languages are not learned. Ties go to
the language first in the alphabet. Null ids are not held out; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from relyard.llm.common import is_held_out, texts

BINS = 4096
PER_LANGUAGE = 500
NO_LANGUAGE = "und"
LETTER = re.compile(r"[^\W\d_]")

# Language families, fixed values; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
}

_KEEP = np.array([32 if b < 128 and not chr(b).isalpha() else b for b in range(256)], np.uint8)


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang.lower().split("-")[0] in members), lang)


def has_letter(text: str) -> bool:
    return LETTER.search(text) is not None


def features(text: str, bins: int = BINS) -> np.ndarray:
    """Unit vector of square-rooted n-gram frequencies; zero for a text without letters."""
    codes = _KEEP[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    space = codes == 32
    if len(codes) > 1:
        codes = codes[~(space & np.r_[False, space[:-1]])]
    wide = np.r_[np.uint32(32), codes.astype(np.uint32), np.uint32(32)]
    shift = np.uint32(32 - (bins.bit_length() - 1))
    total = np.zeros(bins, np.float64)
    gram = np.zeros(len(wide), np.uint32)
    for n in (1, 2, 3):
        gram = (gram[: len(wide) - n + 1] << np.uint32(8)) | wide[n - 1 :]
        mixed = (gram + np.uint32(n << 28)) * np.uint32(2654435761)  # multiplicative hashing
        total += np.bincount(mixed >> shift, minlength=bins)
    vector = np.sqrt(total)
    return (vector / max(np.linalg.norm(vector), 1e-12)).astype(np.float32)


def train_svm(x: np.ndarray, sign: np.ndarray, cost: float = 10.0, epochs: int = 20) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    weights, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    size = (x * x).sum(axis=1) + 1 / (2 * cost)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(x)):
            gradient = sign[k] * (x[k] @ weights) - 1 + alpha[k] / (2 * cost)
            new = max(alpha[k] - gradient / size[k], 0.0)
            if new != alpha[k]:
                weights += (new - alpha[k]) * sign[k] * x[k]
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < 1e-4:
            break
    return weights


@dataclass
class Hierarchy:
    """Machines in rows: one per pair of families, then one per pair of languages in a family. A positive margin is for the first."""

    families: tuple[str, ...]
    members: dict[str, tuple[str, ...]]
    pairs: tuple[tuple[str, str, str], ...]  # (level, first, second); the level is '' for families, else the family
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1] if len(self.pairs) else np.zeros((len(x), 0))
        found = []
        for row in margins:
            family, sure = self._vote("", self.families, row)
            lang, surer = self._vote(family, self.members[family], row)
            found.append((lang, sure * surer))
        return found

    def _vote(self, level: str, candidates: tuple[str, ...], row: np.ndarray) -> tuple[str, float]:
        if len(candidates) == 1:
            return candidates[0], 1.0
        wins, worst = dict.fromkeys(candidates, 0), dict.fromkeys(candidates, np.inf)
        strength = dict.fromkeys(candidates, 0.0)
        for (at, first, second), margin in zip(self.pairs, row):
            if at == level:
                wins[first if margin >= 0 else second] += 1
                for name, own in ((first, margin), (second, -margin)):
                    worst[name] = min(worst[name], own)
                    strength[name] += own
        best = max(candidates, key=lambda c: (wins[c], strength[c]))  # candidates are sorted, so a tie goes to the first
        return best, float(1 / (1 + np.exp(-2 * np.clip(worst[best], -30, 30))))


def fit(x: np.ndarray, langs: list[str]) -> Hierarchy | None:
    if not langs:
        return None
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(family_of(lang), []).append(lang)
    of = np.array([family_of(lang) for lang in langs])
    own = np.array(langs)
    pairs = [("", a, b) for a, b in combinations(sorted(members), 2)]
    pairs += [(family, a, b) for family in sorted(members) for a, b in combinations(members[family], 2)]
    weights = []
    for level, a, b in pairs:
        names = own if level else of
        rows = (names == a) | (names == b)
        weights.append(train_svm(x[rows], np.where(names[rows] == a, 1.0, -1.0)))
    stacked = np.array(weights, np.float32) if weights else np.zeros((0, x.shape[1] + 1), np.float32)
    return Hierarchy(tuple(sorted(members)), {f: tuple(m) for f, m in members.items()}, tuple(pairs), stacked)


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, list[str]]:
    """Features and languages of the sample: at most ``per_language`` documents of each language, smallest id hash first.

    The ranks are cut in each task before the shuffle, so a language of a third of all documents sends no more than a rare one.
    """
    lang = F.trim(docs["lang"])
    usable = docs.where(lang.isNotNull() & (lang != "") & ~is_held_out(docs["doc_id"]))
    keyed = usable.select(docs["doc_id"].cast("bigint").alias("doc_id"), lang.alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = keyed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select("doc_id", "lang")
    plain = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), lang.alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    sample = plain.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, g, features(t).tobytes()) for d, g, t in zip(*(batch.column(k).to_pylist() for k in range(3))) if has_letter(t)]
            columns = list(zip(*rows)) if rows else [(), (), ()]
            kinds = (pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "lang", "x"])

    rows = sample.mapInArrow(extract, "doc_id bigint, lang string, x binary").collect()
    # In one order whatever the partitions; repeated rows beyond the bound are left out.
    rows = sorted(rows, key=lambda r: (r.lang, -1 if r.doc_id is None else r.doc_id, bytes(r.x)))
    taken: dict[str, int] = {}
    kept = []
    for r in rows:
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= per_language:
            kept.append(r)
    x = np.array([np.frombuffer(r.x, np.float32) for r in kept]) if kept else np.zeros((0, BINS), np.float32)
    return x, [r.lang for r in kept]


def predict(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    model = fit(*training_sample(docs, per_language))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hierarchy = sent.value
        for batch in batches:
            found = [(NO_LANGUAGE, 0.0)] * len(batch)
            if hierarchy is not None:
                column = batch.column(1).to_pylist()
                written = [k for k, t in enumerate(column) if has_letter(t)]
                for first in range(0, len(written), 1000):
                    part = written[first : first + 1000]
                    for k, answer in zip(part, hierarchy.predict(np.array([features(column[k]) for k in part]))):
                        found[k] = answer
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    predicted = texts(docs).mapInArrow(label, "doc_id bigint, lang_pred string, score double")
    return predicted.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
