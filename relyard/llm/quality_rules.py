"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule votes 1 (good), -1 (bad) or 0 (abstains) on the counts of a document. Votes are summed up as one row per vote
pattern over the whole corpus: at most 3 ** rules rows, whatever its size. From that small table the driver estimates the share
of good documents and each rule's accuracies (a vote is right with one probability on good and another on bad documents,
independently of the other rules), and the posterior of every document is again a column expression.

``judge(docs)`` returns one row per input row: doc_id, the counts, base_failed, posterior, kept. Hard limits fail a document before
any vote (``base_failed``). Null or empty text: no words, so base_failed. Repeated rows are judged alike and each counts in
the estimate. An empty table gives no rows. Posterior ties (0.5) are kept. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from relyard.llm.common import free_name, stored
from relyard.llm.text_stats import text_stats, with_counts

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class VoteRule:
    """Compares ``over(count) * value`` style ratios without dividing: bad and good are SQL conditions."""

    name: str
    bad: str
    good: str

    @property
    def vote(self) -> Column:
        return F.expr(f"CASE WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END")


# Every fault is looked for by at least two rules: a single dissenting vote does not make a document bad.
RULES = (
    VoteRule("length", "n_words < 50", "n_words >= 100"),
    VoteRule("word_length", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    VoteRule("symbols", "n_symbols > 0.3 * n_words", "n_symbols <= 0.02 * n_words"),
    VoteRule("symbol_share", "n_symbols > 0.08 * word_chars", "n_symbols <= 0.01 * word_chars"),
    VoteRule("repeats", "n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.1 * n_words"),
    VoteRule("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.05 * n_lines"),
    VoteRule("capitals", "n_upper > 0.4 * n_letters", "n_upper <= 0.2 * n_letters"),
    VoteRule("variety", "n_distinct < 0.15 * n_words AND n_words >= 100", "n_distinct >= 0.35 * n_words"),
    VoteRule("letters", "n_letters < 0.8 * word_chars", "n_letters >= 0.9 * word_chars"),
)


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and for each rule how often its vote is right on good and on bad documents."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """Log-odds that a vote for good and a vote for bad add, rule by rule; abstaining adds nothing."""
        return [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.on_good, self.on_bad)]

    def logit(self, votes: Sequence[Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, (up, down) in zip(votes, self.weights()):
            total = total + F.when(vote == 1, up).when(vote == -1, down).otherwise(0.0)
        return total


def fit_votes(patterns: np.ndarray, counts: np.ndarray, steps: int = 100, tolerance: float = 1e-9) -> VoteModel:
    """Expectation-maximisation over distinct vote patterns, for two hidden classes.

    Each rule looks for one fault, so its vote for bad says much and its vote for good little: it has an accuracy for
    either class. Every rule is held better than chance (the two add up to 1.05 at least), which names the classes.
    """
    n_rules = patterns.shape[1]
    prior, on_good, on_bad = 0.7, np.full(n_rules, 0.95), np.full(n_rules, 0.3)
    up, down = patterns == 1, patterns == -1
    for _ in range(steps if counts.sum() else 0):
        z = math.log(prior / (1 - prior)) + up @ np.log(on_good / (1 - on_bad)) + down @ np.log((1 - on_good) / on_bad)
        good = counts / (1 + np.exp(-z))
        bad = counts - good
        before = np.r_[prior, on_good, on_bad]
        prior = float(np.clip(good.sum() / counts.sum(), 0.05, 0.95))
        # As if 20 votes, right as often as at the start, came first: a rule that hardly votes keeps a mild weight.
        on_good = np.clip((good @ up + 19) / (good @ (up | down) + 20), 0.6, 0.995)
        on_bad = np.clip((bad @ down + 6) / (bad @ (up | down) + 20), np.maximum(0.05, 1.05 - on_good), 0.99)
        if np.abs(np.r_[prior, on_good, on_bad] - before).max() < tolerance:
            break
    return VoteModel(prior, tuple(map(float, on_good)), tuple(map(float, on_bad)))


def vote_patterns(stats: DataFrame, rules: Sequence[VoteRule]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vote patterns of the corpus with their counts, in a fixed order."""
    votes = stats.select(*[r.vote.alias(f"v{k}") for k, r in enumerate(rules)])
    rows = votes.groupBy(*votes.columns).count().collect()
    rows = sorted(tuple(r) for r in rows)
    table = np.array(rows, np.int64).reshape(len(rows), len(rules) + 1)
    return table[:, :-1], table[:, -1].astype(float)


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def judge(docs: DataFrame, rules: Sequence[VoteRule] = RULES) -> DataFrame:
    stats = stored(text_stats(docs), "quality-counts")
    model = fit_votes(*vote_patterns(stats, rules))
    posterior = 1 / (1 + F.exp(-model.logit([r.vote for r in rules])))
    judged = stats.withColumn("base_failed", base_failed()).withColumn("posterior", posterior)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def keep_good(docs: DataFrame, rules: Sequence[VoteRule] = RULES) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose document is kept. Nothing but vote counts is shuffled."""
    name = free_name(docs, "counts")
    counted = stored(with_counts(docs, name), "quality-counted")
    flat = counted.select(f"{name}.*")
    model = fit_votes(*vote_patterns(flat, rules))
    # The rules name plain columns, so the row itself is packed away, where no name of its own can clash.
    packed = counted.select(F.struct(*[counted[c] for c in docs.columns]).alias("row"), f"{name}.*")
    posterior = 1 / (1 + F.exp(-model.logit([r.vote for r in rules])))
    kept = packed.where(~base_failed() & (posterior >= 0.5))
    return kept.select("row.*")
