"""Benchmark decontamination by spaced seeds, with built-in functions only.

Words are maximal runs of letters and digits, lower-cased and hashed to 64 bits. **The rule:** a document holds a passage of an item if, at
some alignment, a window of the item's words agrees with the document in at least ``SHARE`` of them; a window is ``WINDOW`` words, or the
whole item where that is shorter. Items under ``LEAST_WORDS`` words are no passages: a document holds one if it has these words and no others.

A seed hashes the words of a window at the fixed positions of a mask and ignores the others, so a substituted word at an ignored
position does not hide a passage. The masks of a window (``masks_of``) are chosen so that every pattern of substitutions which ``SHARE``
allows leaves one of them whole: with s substitutions two of s + 2 neighbouring blocks stay whole, so a mask for each distance of two
blocks is enough. Training seeds are joined with benchmark seeds, and around each hit all windows that hold the seed are compared word by word.
So what is reported follows from the rule alone; masks only find it.

Of the benchmark only distinct seeds (8 bytes each) are broadcast, in blocks of at most ``BLOCK_SEEDS``, each block a pass over the documents; hits
then meet the items' words by a shuffle of the hits. The documents themselves are never shuffled to be searched.

``contaminated(docs, benchmark)`` returns one row per (doc_id, item_id): n_hits (distinct windows that agree, over all alignments), first_word
(place in the document of the first one; below 0 where its own first words lie before the document), matched and compared (words of the
best one). ``drop_contaminated`` returns the rows of ``docs`` without such a window.

Defined cases: null or empty texts and texts without letters or digits have no words and no hits. Null ids are reported as null; a repeated row
counts once, different texts under one id add up. Empty tables give no rows (or ``docs`` as it was). Other columns are ignored and,
where rows are returned, kept.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from relyard.functions.columns import with_once
from relyard.llm.common import KEYS_SENT, row_key, same_row, stored, within_reach

SPLIT = r"[^\p{L}\p{N}]+"

WINDOW = 20
SHARE = 0.8
#: Shortest item that is sought as a passage inside longer text.
LEAST_WORDS = 5
BLOCK_SEEDS = 1_000_000


def word_hashes(text: Column) -> Column:
    parts = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: F.xxhash64(w))
    return F.array_remove(parts, F.xxhash64(F.lit("")))


def _seed(number: int, mask: tuple[int, ...]) -> Column:
    """Seed at word ``at`` of ``words``; null where the window would pass the end."""
    here = F.xxhash64(F.lit(number), *[F.get("words", F.col("at") + o) for o in mask])
    return F.when(F.col("at") + mask[-1] < F.col("n"), here)


def masks_of(size: int) -> list[tuple[int, ...]]:
    """Word offsets of the masks for a window of ``size`` words, one of which is whole in every pattern that ``SHARE`` allows.

    Five words have no blocks that would do: there a mask leaves out any one word. Shorter items are taken as a whole.
    """
    if size < LEAST_WORDS:
        return [tuple(range(size))]
    if size == 5:
        return [(0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)]
    blocks = size - ceil(size * SHARE) + 2
    width = 3 if 3 * blocks <= size else 2
    return [tuple(range(width)) + tuple(range(d * width, d * width + width)) for d in range(1, blocks)]


def _masks(sizes: list[int]) -> dict[int, tuple[tuple[int, ...], list[int]]]:
    """Number to mask and the window sizes it is for. Whole short items have masks of their own, numbered below zero."""
    every = sorted({m for n in sizes if n >= LEAST_WORDS for m in masks_of(n)})
    short = {-n: (masks_of(n)[0], [n]) for n in sizes if n < LEAST_WORDS}
    return short | {k: (m, [n for n in sizes if n >= LEAST_WORDS and m in masks_of(n)]) for k, m in enumerate(every)}


def _with_words(df: DataFrame, *keep: Column) -> DataFrame:
    counted = with_once(df.select(*keep, word_hashes(df["text"]).alias("hashed")), words=F.col("hashed")).drop("hashed")
    return counted.withColumn("n", F.size("words"))


def benchmark_seeds(benchmark: DataFrame) -> tuple[DataFrame, dict[int, tuple[tuple[int, ...], list[int]]]]:
    """(seed, item_id, item_key, q, span, item): every seed of every item with its place and the item's words; and the masks in use."""
    items = _with_words(benchmark, benchmark["item_id"].cast("bigint").alias("item_id")).where("n > 0").withColumn("size", F.least("n", F.lit(WINDOW)))
    items = items.withColumn("item_key", F.xxhash64("words"))
    masks = _masks(sorted(r.size for r in items.select("size").distinct().collect()))
    seeds = [F.struct(F.when(F.col("size").isin(of), _seed(k, m)).alias("seed"), F.lit(m[-1] + 1).alias("span")) for k, (m, of) in masks.items()]
    placed = items.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    if not seeds:
        return placed.select(F.lit(0).cast("bigint").alias("seed"), "item_id", "item_key", F.col("at").alias("q"), F.lit(0).alias("span"), F.col("words").alias("item")), masks
    seeded = placed.select("*", F.inline(F.array(*seeds))).where("seed IS NOT NULL")
    return seeded.select("seed", "item_id", "item_key", F.col("at").alias("q"), "span", F.col("words").alias("item")).distinct(), masks


def agreeing_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row_key, item_id, item_key, diagonal (place of the item's first word in the document), start (of the window in the item), matched,
    compared: every distinct window that agrees."""
    seeds, masks = benchmark_seeds(benchmark)
    seeds = stored(seeds, "benchmark-seeds")
    distinct = stored(seeds.select("seed").distinct(), "distinct-seeds")
    n_blocks = max(1, -(-distinct.count() // BLOCK_SEEDS))
    doc_id = docs["doc_id"].cast("bigint")
    read = _with_words(docs, doc_id.alias("doc_id"), row_key(doc_id, docs["text"]), docs["text"]).drop("text").where("n > 0")
    placed = read.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    # A short item must be all there is.
    of_document = [_seed(k, m) if k >= 0 else F.when((F.col("at") == 0) & (F.col("n") == -k), _seed(k, m)) for k, (m, _) in masks.items()]
    seeded = placed.select("*", F.explode(F.array(*of_document, F.lit(None).cast("bigint"))).alias("seed")).where("seed IS NOT NULL")
    # Words that a window with the seed can reach: the seed lies inside it.
    reach_from = F.greatest(F.lit(0), F.col("at") - F.lit(WINDOW))
    around = F.slice("words", reach_from + 1, F.lit(2 * WINDOW)).alias("around")
    found = []
    for block in range(n_blocks):
        # Up to here everything is one generated loop over the words of a document; only hits leave it, with the words around them.
        part = distinct.where(F.pmod(F.xxhash64("seed"), F.lit(n_blocks)) == block)
        found.append(seeded.join(F.broadcast(part), "seed").select("doc_id", "row_key", "seed", "at", reach_from.alias("reach_from"), around))
    hits = stored(reduce(DataFrame.union, found), "seed-hits")
    size = F.least(F.size("item"), F.lit(WINDOW))
    met = hits.join(seeds, "seed").withColumns({"size": size, "diagonal": F.col("at") - F.col("q")})
    first, last = F.greatest(F.lit(0), F.col("q") + F.col("span") - F.col("size")), F.least(F.col("q"), F.size("item") - F.col("size"))
    met = met.select("*", first.alias("first"), F.sequence(first, last).alias("starts"))
    # Agreement of the item's words from the first window's start to the last one's end, in one array.
    length = F.element_at("starts", -1) + F.col("size") - F.col("first")
    same = F.transform(
        F.sequence(F.col("first"), F.col("first") + length - 1),
        lambda j: F.coalesce(F.when(j + F.col("diagonal") >= F.col("reach_from"), F.get("around", j + F.col("diagonal") - F.col("reach_from"))) == F.get("item", j), F.lit(False)),
    )
    compared = with_once(met, same=same)
    windows = F.transform(
        "starts",
        lambda s: F.struct(s.alias("start"), F.size(F.filter(F.slice("same", s - F.col("first") + 1, F.col("size")), lambda x: x)).alias("matched")),
    )
    least = F.ceil(F.col("size") * SHARE)
    agreed = compared.select("doc_id", "row_key", "item_id", "item_key", "diagonal", "size", F.inline(windows)).where(F.col("matched") >= least)
    return agreed.select("doc_id", "row_key", "item_id", "item_key", "diagonal", "start", "matched", F.col("size").alias("compared")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    best = F.max(F.struct("matched", "compared")).alias("best")
    place = F.col("diagonal") + F.col("start")
    pairs = agreeing_windows(docs, benchmark).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min(place).alias("first_word"), best)
    return pairs.select("doc_id", "item_id", "n_hits", "first_word", "best.matched", "best.compared")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, sent: int = KEYS_SENT) -> DataFrame:
    """Keys of rows that go are sent to the rows while they are at most ``sent``; beyond that they meet by a shuffle."""
    dirty = stored(agreeing_windows(docs, benchmark).select("row_key", "doc_id").distinct(), "contaminated-keys")
    doc_id = docs["doc_id"].cast("bigint")
    packed = docs.select(doc_id.alias("doc_id"), row_key(doc_id, docs["text"]), F.struct("*").alias("row"))
    keys = F.broadcast(dirty) if within_reach(dirty, sent) else dirty
    return packed.join(keys, same_row(packed, keys), "left_anti").select("row.*")


def oracle() -> str:
    """The rule itself: equal words by alignment, and every window of the item counted over them."""

    def words(text: str) -> str:
        return rf"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"

    return f"""
    WITH b AS (SELECT DISTINCT item_id, {words('text')} AS iw FROM benchmark),
    i AS (SELECT item_id, iw, len(iw) AS n, least(len(iw), {WINDOW}) AS size, ceil(least(len(iw), {WINDOW}) * {SHARE}) AS least_same FROM b WHERE len(iw) > 0),
    iw AS (SELECT *, unnest(iw) AS word, generate_subscripts(iw, 1) - 1 AS j FROM i),
    d AS (SELECT row_number() OVER () AS row, doc_id, dw FROM (SELECT DISTINCT doc_id, text, {words('text')} AS dw FROM documents)),
    dw AS (SELECT row, doc_id, len(dw) AS dn, unnest(dw) AS word, generate_subscripts(dw, 1) - 1 AS p FROM d),
    met AS (SELECT row, doc_id, dn, item_id, iw, n, size, least_same, j, p - j AS diagonal FROM dw JOIN iw USING (word)),
    same AS (SELECT row, doc_id, dn, item_id, iw, n, size, least_same, diagonal, list(j) AS js FROM met GROUP BY row, doc_id, dn, item_id, iw, n, size, least_same, diagonal),
    windows AS (SELECT *, unnest(range(n - size + 1)) AS s FROM same WHERE len(js) >= least_same AND (n >= {LEAST_WORDS} OR (dn = n AND diagonal = 0))),
    agreed AS (SELECT doc_id, item_id, diagonal + s AS place, size, least_same, len(list_filter(js, lambda j: j >= s AND j < s + size)) AS matched FROM windows)
    SELECT doc_id, item_id, count(*) AS n_hits, min(place)::int AS first_word, max(matched * 1000 + size)::int // 1000 AS matched,
      (max(matched * 1000 + size) % 1000)::int AS compared
    FROM agreed WHERE matched >= least_same GROUP BY ALL"""
