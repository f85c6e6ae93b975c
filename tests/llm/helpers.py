"""Small document tables with every awkward case."""

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """n different words, unlike those of other seeds."""
    return " ".join(f"{WORDS[(seed * 7 + k * k) % 20]}{seed}x{k}" for k in range(n))


def doc_table(spark, texts):
    """Rows from (doc_id, text) pairs."""
    rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in texts]
    return spark.createDataFrame(rows, DOC_SCHEMA)


AWKWARD = [None, "", " \n\t ", "one", "one two", "A b", "a" * 5000, "word " * 3000, "É é ß", "x\n\n\ny  z ", "<|endoftext|> a<|startoftext|>b", "İ ŉ ² ½ ́"]
