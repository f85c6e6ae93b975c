"""States that add up: ordered hashes by stretch of the key, and quantile sketches by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from relyard.functions.hashing import sha256_text
from relyard.operators import digest_tree, fingerprint, sequence_hash, sketches
from relyard.plans.catalog import query
from relyard.plans.data_plans import _ROW_TEXT
from relyard.plans.oracle_views import sql
from relyard.session import new_location
from relyard.sources import views
from relyard.sources.tables import table

_ORDER_TEXT = """concat_ws(chr(31), concat('=', o_custkey), concat('=', o_orderdate::VARCHAR), concat('=', o_orderkey),
  concat('=', o_orderpriority), concat('=', o_orderstatus), concat('=', o_totalprice::VARCHAR))"""


def _horner_sql(point: int, start: int, order: str) -> str:
    """One polynomial over digests in order, one multiplication and addition per row."""
    digit = f"('0x' || substr(h, {start}, {sequence_hash.DIGITS}))::HUGEINT"
    return f"list_reduce(list_concat([0::HUGEINT], list({digit} ORDER BY {order})), lambda a, d: (a * {point} + d) % {sequence_hash.PRIME})"


def _sequence_sql(rows: str, order: str, group: str = "") -> str:
    h0, h1 = (_horner_sql(p, 1 + i * sequence_hash.DIGITS, f"{order}, h") for i, p in enumerate(sequence_hash.POINTS))
    group_by, named = (f"GROUP BY {group}", f"{group}, ") if group else ("", "")
    return f"""SELECT {named}row_count, sha256(concat(row_count, '|', h0, '|', h1)) AS content_hash, true AS in_order
    FROM (SELECT {named}count(*) AS row_count, {h0} AS h0, {h1} AS h1 FROM ({rows}) {group_by})"""


def _order_states(orders: DataFrame) -> DataFrame:
    """States of orders by date, one stretch per month."""
    return sequence_hash.sequence_states(orders, ["o_orderdate", "o_orderkey"], F.date_format("o_orderdate", "yyyy-MM"))


def _folded(states: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return sequence_hash.fold_states(states, group).select(*group, "row_count", "content_hash", "in_order")


@query("content_hash_sequence", sql(_sequence_sql(f"SELECT row_id, sha256({_ROW_TEXT}) AS h FROM ds", "row_id"), "ds"))
def content_hash_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered hash without a rank: a state per range of the key, folded in key order."""
    return _folded(sequence_hash.sequence_states(views.dataset(spark, sf), ["row_id"]))


@query("content_hash_sequence_keyed", sql(_sequence_sql(f"SELECT target, f0, sha256({_ROW_TEXT}) AS h FROM ds", "target, f0"), "ds"))
def content_hash_sequence_keyed(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(sequence_hash.sequence_states(views.dataset(spark, sf), ["target", "f0"]))


@query(
    "content_hash_sequence_monthly",
    _sequence_sql(f"SELECT strftime(o_orderdate, '%Y-%m') AS stretch, o_orderdate, o_orderkey, sha256({_ORDER_TEXT}) AS h FROM orders", "o_orderdate, o_orderkey", "stretch"),
)
def content_hash_sequence_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(_order_states(views.orders(spark, sf)), ["stretch"])


@query("content_hash_sequence_appended", _sequence_sql(f"SELECT o_orderdate, o_orderkey, sha256({_ORDER_TEXT}) AS h FROM orders", "o_orderdate, o_orderkey"))
def content_hash_sequence_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Stored states of the first years, one month of them hashed again, and the states of the years appended later: the hash of the whole."""
    orders = views.orders(spark, sf)
    month = F.date_format("o_orderdate", "yyyy-MM")
    path = new_location(spark, "sequence-states")
    _order_states(orders.filter(month < "1999-01")).write.parquet(path)
    appended = _order_states(orders.filter(month >= "1999-01"))
    stored = spark.read.schema(appended.schema).parquet(path)
    repaired = sequence_hash.replace_states(stored, _order_states(orders.filter(month == "1997-06")))
    return _folded(repaired.unionByName(appended))


RANKS = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)
#: Three times the sketch's own 99 % error.
RANK_BOUND = 3 * sketches.rank_error()


def _checked_quantiles(rows: DataFrame, value: str, day: str, group: Sequence[str], name: str) -> DataFrame:
    """Daily states, stored, merged by month; every estimate is checked against the ranks of the rows."""
    path = new_location(rows.sparkSession, name)
    daily = sketches.quantile_states(rows, value, [day, *group])
    daily.write.parquet(path)
    stored = rows.sparkSession.read.schema(daily.schema).parquet(path)
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    merged = sketches.merge_quantile_states(stored.withColumn("month", month(day)), ["month", *group])
    estimates = sketches.quantiles(merged, RANKS)
    return sketches.within_rank_error(estimates, rows.withColumn("month", month(day)), value, ["month", *group], RANK_BOUND).drop("value")


def _quantile_sql(rows: str, group: str) -> str:
    """Counts and ends are exact; that every estimate keeps its bound is the row's claim."""
    ranks = ", ".join(f"({q})" for q in RANKS)
    return f"""SELECT month, {group}, q::DOUBLE AS q, row_count, n, low, high, true AS within
    FROM (SELECT month, {group}, count(*) AS row_count, count(x) AS n, min(x) AS low, max(x) AS high FROM ({rows}) GROUP BY month, {group}), (VALUES {ranks}) r(q)"""


@query(
    "latency_quantile_states",
    sql(_quantile_sql("SELECT strftime(ts, '%Y-%m') AS month, mode, latency_s AS x FROM rq", "mode"), "rq"),
)
def latency_quantile_states(spark: SparkSession, sf: str) -> DataFrame:
    """Latency quantiles per month and mode from daily states."""
    rows = views.requests(spark, sf).select(F.to_date("ts").alias("day"), "mode", "latency_s")
    return _checked_quantiles(rows, "latency_s", "day", ["mode"], "latency-states")


@query(
    "feature_quantile_states",
    _quantile_sql(
        """SELECT strftime(l_shipdate, '%Y-%m') AS month, unnest(['l_discount', 'l_extendedprice', 'l_quantity', 'l_tax']) AS feature,
        unnest([l_discount, l_extendedprice, l_quantity, l_tax]) AS x FROM lineitem""",
        "feature",
    ),
)
def feature_quantile_states(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of four features per month from daily states; features are rows, so any number is one pass."""
    names = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]
    wide = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"), *[F.col(n).cast("double") for n in names])
    return _checked_quantiles(wide.unpivot(["day"], names, "feature", "x"), "x", "day", ["feature"], "feature-states")


# --- which part of a dataset changed ----------------------------------------------------------------

YEARS = (1995, 2001)


def _yearly_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A version of the order set per year: all orders up to then, and from the next year on every 499th price corrected."""
    orders = views.orders(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("_year"))
    year = F.explode(F.sequence(F.greatest("_year", F.lit(YEARS[0])), F.lit(YEARS[1])))
    grown = orders.where(F.col("_year") <= YEARS[1]).select("*", year.alias("year"))
    corrected = (F.col("o_orderkey") % 499 == 0) & (F.col("year") > F.col("_year")) & (F.col("year") % 2 == 0)
    return grown.withColumn("o_totalprice", F.col("o_totalprice") + F.when(corrected, 1).otherwise(0)).drop("_year")


_VERSIONS_SQL = f"""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) <= {YEARS[1]}),
  v AS (SELECT o_orderkey, o_custkey, o_totalprice + CASE WHEN o_orderkey % 499 = 0 AND v > y AND v % 2 = 0 THEN 1 ELSE 0 END AS price, v
    FROM (SELECT *, unnest(range(greatest(y, {YEARS[0]}), {YEARS[1] + 1})) AS v FROM o))"""


def _version_table(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of the yearly versions; a column is added in 1999, and the config changes every third year."""
    rows = _yearly_versions(spark, sf)
    hashed = fingerprint.content_hash_multiset(rows, ["year"])
    schema = F.when(F.col("year") >= 1999, F.lit("with channel")).otherwise(F.lit(fingerprint.schema_text(rows)))
    return hashed.select(
        F.lit("orders").alias("dataset"), "year", "row_count", "content_hash", sha256_text(schema).alias("schema_hash"), F.floor(F.col("year") / 3).cast("string").alias("config_hash")
    )


@query(
    "dataset_drift",
    f"""{_VERSIONS_SQL}, s AS (SELECT v, count(*) AS n FROM v GROUP BY v),
    d AS (SELECT b.v, count(*) FILTER (a.price IS DISTINCT FROM b.price) > 0 AS content FROM v b LEFT JOIN v a ON a.o_orderkey = b.o_orderkey AND a.v = b.v - 1 GROUP BY b.v),
    f AS (SELECT 'orders' AS dataset, lag(s.v) OVER (ORDER BY s.v)::INTEGER AS previous_year, s.v::INTEGER AS year, s.v = 1999 AS schema_changed, d.content AS content_changed,
      s.n <> lag(s.n) OVER (ORDER BY s.v) AS rows_changed, s.v // 3 <> (s.v - 1) // 3 AS config_changed FROM s JOIN d ON d.v = s.v)
    SELECT *, concat_ws(',', CASE WHEN schema_changed THEN 'schema' END, CASE WHEN content_changed THEN 'content' END, CASE WHEN rows_changed THEN 'rows' END,
      CASE WHEN config_changed THEN 'config' END) AS changed FROM f WHERE previous_year IS NOT NULL""",
)
def dataset_drift(spark: SparkSession, sf: str) -> DataFrame:
    return digest_tree.version_drift(_version_table(spark, sf), ["dataset"], "year")


@query(
    "dataset_drift_prefixes",
    f"""{_VERSIONS_SQL}, p AS (SELECT *, substr(sha256(concat('=', o_orderkey)), 1, {digest_tree.LEVELS[-1]}) AS prefix FROM v),
    n AS (SELECT v, prefix, count(*) AS n, string_agg(concat(o_orderkey, ':', price), ',' ORDER BY o_orderkey) AS body FROM p GROUP BY v, prefix)
    SELECT (b.v - 1)::VARCHAR AS previous_version, b.v::VARCHAR AS version, b.prefix, coalesce(a.n, 0) AS rows_before, b.n AS rows_after
    FROM n b LEFT JOIN n a ON a.v = b.v - 1 AND a.prefix = b.prefix WHERE b.v > {YEARS[0]} AND a.body IS DISTINCT FROM b.body""",
)
def dataset_drift_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the key space in which consecutive yearly versions differ, from stored trees."""
    path = new_location(spark, "digest-tree")
    digest_tree.write_tree(digest_tree.tree_nodes(_yearly_versions(spark, sf), ["o_orderkey"], "year"), path)
    pairs = spark.range(YEARS[0] + 1, YEARS[1] + 1).select((F.col("id") - 1).cast("string").alias("previous_version"), F.col("id").cast("string").alias("version"))
    return digest_tree.differing_leaves(digest_tree.read_tree(spark, path), pairs)
