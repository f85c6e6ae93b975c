"""Quality classifier as a sparse rule ensemble: tree paths as rules, lasso logistic weights, compiled to one column expression.

1. Shallow randomised trees are grown over ratios of text counts. Every path from a root is a conjunctive rule.
2. Logistic regression with a lasso penalty over the rules keeps few of them.
3. The kept rules become a Spark column: the score of every document is computed where its counts are, without Python.

Learning uses at most ``LABELLED`` labelled documents (smallest hash of the id) that are not held out. Only label, id and text take part;
the id decides the hold-out and the sample, nothing else.

``score(docs, labels)`` returns one row per input row: doc_id, held_out, score, predicted. Null and empty texts have zero counts and get the score of those.
Null ids are not held out and carry no label. Labels that are null are ignored; a document labelled both ways counts as good if most of its labels are. With no
labels the score is 0.5, with one class only it is that class. Repeated rows are scored alike. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from relyard.llm.common import is_held_out, stored
from relyard.llm.text_stats import text_stats

LABELLED = 20_000
TREES = 20
DEPTH = 3
PENALTY = 0.001
CUT = 0.7

# Ratios the rules may read, as SQL over the counts; a division by zero counts as 0.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "symbol_share": "n_symbols / word_chars",
    "repeated_words": "n_repeat_words / n_words",
    "repeated_lines": "n_dup_lines / n_lines",
    "capitals": "n_upper / n_letters",
    "letters": "n_letters / word_chars",
    "variety": "n_distinct / n_words",
    "words_per_line": "n_words / n_lines",
}

Condition = tuple[int, str, float]  # feature, '<=' or '>', threshold
Rule = tuple[Condition, ...]


def ratio(expression: str) -> Column:
    if "/" not in expression:
        return F.col(expression).cast("double")
    top, bottom = expression.split(" / ")
    return F.coalesce(F.expr(f"try_divide({top}, {bottom})"), F.lit(0.0)).cast("double")


def with_features(stats: DataFrame) -> DataFrame:
    return stats.select("doc_id", *[ratio(e).alias(name) for name, e in FEATURES.items()])


def simplified(path: Sequence[Condition]) -> Rule:
    """The tightest bound for each feature and direction, in a fixed order."""
    bounds: dict[tuple[int, str], float] = {}
    for feature, sign, threshold in path:
        key = (feature, sign)
        pick = min if sign == "<=" else max
        bounds[key] = pick(bounds[key], threshold) if key in bounds else threshold
    return tuple((f, s, t) for (f, s), t in sorted(bounds.items()))


def tree_rules(debug_string: str) -> set[Rule]:
    """Rules of all paths in the printed form of Spark's trees; indentation gives the depth."""
    line = re.compile(r"^(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-0-9.eE]+)\)")
    rules, path = set(), []
    for text in debug_string.split("\n"):
        found = line.match(text)
        if found:
            depth = len(found[1])
            path = [(d, c) for d, c in path if d < depth]
            path.append((depth, (int(found[2]), found[3], float(found[4]))))
            rules.add(simplified([c for _, c in path]))
    return rules


def compiled(rule: Rule) -> Column:
    names = list(FEATURES)
    holds = F.lit(True)
    for feature, sign, threshold in rule:
        value = F.col(names[feature])
        holds = holds & (value <= threshold if sign == "<=" else value > threshold)
    return holds.cast("double")


def labelled_sample(features: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """Features and label of the bounded sample; its ids are few enough to broadcast (``most`` rows)."""
    usable = labels.where(labels["quality"].isNotNull() & labels["doc_id"].isNotNull() & ~is_held_out(labels["doc_id"]))
    one = usable.groupBy(labels["doc_id"].cast("bigint").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return stored(features.join(F.broadcast(chosen), "doc_id").drop("doc_id").coalesce(4), "labelled-sample")


def fit(sample: DataFrame) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and the rules with a weight."""
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return {(): 0.0, (1.0,): 20.0, (0.0,): -20.0}[tuple(counts)], []
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(sample)
    # A feature subset of a third per split makes the trees differ, so that each of several signs of one fault is found.
    forest = RandomForestClassifier(
        featuresCol="x", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.8, minInstancesPerNode=5, seed=11
    )
    rules = sorted(tree_rules(forest.fit(vectors).toDebugString))
    if not rules:
        return 0.0, []
    design = sample.select("label", *[compiled(r).alias(f"r{k}") for k, r in enumerate(rules)])
    design = VectorAssembler(inputCols=design.columns[1:], outputCol="x").transform(design).select("label", "x")
    lasso = LogisticRegression(featuresCol="x", regParam=PENALTY, elasticNetParam=1.0, standardization=False, maxIter=60)
    model = lasso.fit(design)
    weights = zip(rules, model.coefficients.toArray().tolist())
    return float(model.intercept), [(rule, w) for rule, w in weights if abs(w) > 1e-6]


def score(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    features = with_features(stored(text_stats(docs), "text-counts"))
    intercept, rules = fit(labelled_sample(features, labels, most))
    logit = F.lit(intercept)
    for rule, weight in rules:
        logit = logit + weight * compiled(rule)
    scored = features.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-logit))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
