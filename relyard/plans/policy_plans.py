"""Registry, policy and release queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relyard import constants as c
from relyard.functions.text import strip_or_null, tag
from relyard.operators import policy, registry, release
from relyard.plans.catalog import query
from relyard.plans.oracle_views import sql
from relyard.session import shared_root
from relyard.sources import release_table, views
from relyard.sources.tables import table


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return policy.evaluate(
        views.models(spark, sf), views.aliases(spark, sf), views.model_versions(spark, sf), views.runs(spark, sf)
    )


# --- policy -----------------------------------------------------------------------------------------


@query(
    "policy_decision",
    sql(
        """SELECT model_name, CAST(cand AS VARCHAR) AS candidate_version, CAST(cur AS VARCHAR) AS current_prod_version,
        error_codes = '' AS allowed, error_codes, warning_codes FROM pol""",
        "pol",
    ),
)
def policy_decision(spark: SparkSession, sf: str) -> DataFrame:
    return decisions(spark, sf).select(
        "model_name",
        "candidate_version",
        "current_prod_version",
        "allowed",
        policy.codes("errors").alias("error_codes"),
        policy.codes("warnings").alias("warning_codes"),
    )


def _errors(spark: SparkSession, sf: str, code: str, *details: str) -> DataFrame:
    found = policy.violations(decisions(spark, sf)).filter(F.col("code") == code)
    return found.select("model_name", "message", *[F.col(f"details.{d}").alias(d) for d in details])


@query(
    "policy_missing_alias",
    sql(
        """SELECT model_name, 'Promotion blocked: alias ''candidate'' does not exist.' AS message, 'candidate' AS alias
        FROM pol WHERE cand IS NULL""",
        "pol",
    ),
)
def policy_missing_alias(spark: SparkSession, sf: str) -> DataFrame:
    return _errors(spark, sf, "MISSING_ALIAS", "alias")


@query(
    "policy_missing_tags",
    sql(
        """SELECT model_name, 'Promotion blocked: candidate model version is missing required metadata tags.' AS message,
        missing FROM pol WHERE cand IS NOT NULL AND missing <> ''""",
        "pol",
    ),
)
def policy_missing_tags(spark: SparkSession, sf: str) -> DataFrame:
    found = _errors(spark, sf, "MISSING_REQUIRED_TAGS", "missing")
    return found.withColumn("missing", F.array_join("missing", ","))


@query(
    "policy_gate",
    sql(
        """SELECT model_name, 'Promotion blocked: model gate status is not ''passed''.' AS message,
        'passed' AS expected, gate_v AS actual FROM pol WHERE cand IS NOT NULL AND gate_v <> 'passed'""",
        "pol",
    ),
)
def policy_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _errors(spark, sf, "GATE_NOT_PASSED", "expected", "actual")


@query(
    "policy_release_status",
    sql(
        """SELECT model_name, 'Promotion blocked: candidate release_status is not eligible for promotion.' AS message,
        'candidate' AS expected, status_v AS actual FROM pol WHERE cand IS NOT NULL AND status_v <> 'candidate'""",
        "pol",
    ),
)
def policy_release_status(spark: SparkSession, sf: str) -> DataFrame:
    return _errors(spark, sf, "INVALID_RELEASE_STATUS", "expected", "actual")


@query(
    "policy_noop",
    sql(
        """SELECT model_name, 'Promotion blocked: candidate is already the current prod version.' AS message,
        CAST(cand AS VARCHAR) AS candidate_version, CAST(cur AS VARCHAR) AS current_prod_version FROM pol WHERE cand = cur""",
        "pol",
    ),
)
def policy_noop(spark: SparkSession, sf: str) -> DataFrame:
    return _errors(spark, sf, "NOOP_PROMOTION", "candidate_version", "current_prod_version")


@query(
    "policy_warnings",
    sql(
        """SELECT model_name, warning_codes AS code, CASE WHEN run_v <> '' THEN run_v END AS run_id,
        CASE WHEN run_v = '' THEN 'source_run_id' END AS tag,
        CASE WHEN run_v = '' THEN 'Missing source_run_id tag; promotion will be less auditable.'
             ELSE 'source_run_id tag is present but the MLflow run could not be fetched.' END AS message
        FROM pol WHERE warning_codes <> ''""",
        "pol",
    ),
)
def policy_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return policy.violations(decisions(spark, sf), "warnings").select(
        "model_name", "code", "details.run_id", "details.tag", "message"
    )


_JSON_SQL = """
SELECT model_name, concat('{"allowed":', CASE WHEN error_codes = '' THEN 'true' ELSE 'false' END, ',"context":{',
  CASE WHEN cand IS NULL THEN '' ELSE concat('"candidate_tags_subset":{"config_hash":"', config_hash, '","dataset_fingerprint":"', dataset_fingerprint,
    '","gate":"', gate, '","git_sha":"', git_sha, '","release_status":"', release_status, '","source_run_id":"', source_run_id,
    '","training_run_id":"', training_run_id, '"},') END,
  '"candidate_version":', CASE WHEN cand IS NULL THEN 'null' ELSE concat('"', cand, '"') END,
  ',"current_prod_version":', CASE WHEN cur IS NULL THEN 'null' ELSE concat('"', cur, '"') END,
  ',"from_alias":"candidate","model_name":"', model_name, '","to_alias":"prod"},"errors":[',
  CASE WHEN cand IS NULL THEN '{"code":"MISSING_ALIAS","details":{"alias":"candidate"},"message":"Promotion blocked: alias ''candidate'' does not exist."}'
  ELSE concat_ws(',',
    CASE WHEN missing <> '' THEN concat('{"code":"MISSING_REQUIRED_TAGS","details":{"missing":["', replace(missing, ',', '","'), '"]},"message":"Promotion blocked: candidate model version is missing required metadata tags."}') END,
    CASE WHEN gate_v <> 'passed' THEN concat('{"code":"GATE_NOT_PASSED","details":{"actual":"', gate_v, '","expected":"passed"},"message":"Promotion blocked: model gate status is not ''passed''."}') END,
    CASE WHEN status_v <> 'candidate' THEN concat('{"code":"INVALID_RELEASE_STATUS","details":{"actual":"', status_v, '","expected":"candidate"},"message":"Promotion blocked: candidate release_status is not eligible for promotion."}') END,
    CASE WHEN cand = cur THEN concat('{"code":"NOOP_PROMOTION","details":{"candidate_version":"', cand, '","current_prod_version":"', cur, '"},"message":"Promotion blocked: candidate is already the current prod version."}') END) END,
  '],"warnings":[',
  CASE warning_codes WHEN 'MISSING_SOURCE_RUN_ID' THEN '{"code":"MISSING_SOURCE_RUN_ID","details":{"tag":"source_run_id"},"message":"Missing source_run_id tag; promotion will be less auditable."}'
    WHEN 'SOURCE_RUN_ID_NOT_FOUND' THEN concat('{"code":"SOURCE_RUN_ID_NOT_FOUND","details":{"run_id":"', run_v, '"},"message":"source_run_id tag is present but the MLflow run could not be fetched."}') ELSE '' END,
  ']}') AS decision
FROM pol"""


@query("policy_json", sql(_JSON_SQL, "pol"))
def policy_json(spark: SparkSession, sf: str) -> DataFrame:
    return policy.as_json(decisions(spark, sf))


_TEXT_SQL = """
SELECT model_name, CAST(row_number() OVER (PARTITION BY model_name ORDER BY o) - 1 AS INTEGER) AS line_no, line FROM (
  SELECT model_name, 0 AS o, CASE WHEN error_codes = '' THEN 'allowed=True' ELSE 'allowed=False' END AS line FROM pol
  UNION ALL SELECT model_name, 1, 'ERROR MISSING_ALIAS: Promotion blocked: alias ''candidate'' does not exist. {''alias'': ''candidate''}' FROM pol WHERE cand IS NULL
  UNION ALL SELECT model_name, 2, concat('ERROR MISSING_REQUIRED_TAGS: Promotion blocked: candidate model version is missing required metadata tags. {''missing'': [''', replace(missing, ',', ''', '''), ''']}') FROM pol WHERE cand IS NOT NULL AND missing <> ''
  UNION ALL SELECT model_name, 3, concat('ERROR GATE_NOT_PASSED: Promotion blocked: model gate status is not ''passed''. {''expected'': ''passed'', ''actual'': ''', gate_v, '''}') FROM pol WHERE cand IS NOT NULL AND gate_v <> 'passed'
  UNION ALL SELECT model_name, 4, concat('ERROR INVALID_RELEASE_STATUS: Promotion blocked: candidate release_status is not eligible for promotion. {''expected'': ''candidate'', ''actual'': ''', status_v, '''}') FROM pol WHERE cand IS NOT NULL AND status_v <> 'candidate'
  UNION ALL SELECT model_name, 5, concat('ERROR NOOP_PROMOTION: Promotion blocked: candidate is already the current prod version. {''candidate_version'': ''', cand, ''', ''current_prod_version'': ''', cur, '''}') FROM pol WHERE cand = cur
  UNION ALL SELECT model_name, 6, 'WARN  MISSING_SOURCE_RUN_ID: Missing source_run_id tag; promotion will be less auditable. {''tag'': ''source_run_id''}' FROM pol WHERE warning_codes = 'MISSING_SOURCE_RUN_ID'
  UNION ALL SELECT model_name, 7, concat('WARN  SOURCE_RUN_ID_NOT_FOUND: source_run_id tag is present but the MLflow run could not be fetched. {''run_id'': ''', run_v, '''}') FROM pol WHERE warning_codes = 'SOURCE_RUN_ID_NOT_FOUND'
  UNION ALL SELECT model_name, 8, concat('context={''model_name'': ''', model_name, ''', ''from_alias'': ''candidate'', ''to_alias'': ''prod'', ''candidate_version'': ',
    CASE WHEN cand IS NULL THEN 'None' ELSE concat('''', cand, '''') END, ', ''current_prod_version'': ', CASE WHEN cur IS NULL THEN 'None' ELSE concat('''', cur, '''') END,
    CASE WHEN cand IS NULL THEN '' ELSE concat(', ''candidate_tags_subset'': {''gate'': ''', gate, ''', ''release_status'': ''', release_status, ''', ''source_run_id'': ''', source_run_id,
      ''', ''dataset_fingerprint'': ''', dataset_fingerprint, ''', ''git_sha'': ''', git_sha, ''', ''config_hash'': ''', config_hash, ''', ''training_run_id'': ''', training_run_id, '''}') END, '}') FROM pol)"""


@query("policy_text", sql(_TEXT_SQL, "pol"))
def policy_text(spark: SparkSession, sf: str) -> DataFrame:
    return policy.as_text(decisions(spark, sf))


@query(
    "policy_exit_status",
    sql("SELECT model_name, CASE WHEN error_codes = '' THEN 0 ELSE 2 END AS exit_status FROM pol", "pol"),
)
def policy_exit_status(spark: SparkSession, sf: str) -> DataFrame:
    return policy.exit_status(decisions(spark, sf))


@query(
    "policy_block_report",
    sql(
        """SELECT model_group, code, CAST(grouping(model_group) * 2 + grouping(code) AS INTEGER) AS level, count(*) AS models
        FROM (SELECT 'g' || (o_custkey % 10) AS model_group, unnest(string_split(error_codes, ',')) AS code FROM pol WHERE error_codes <> '')
        GROUP BY ROLLUP (model_group, code)""",
        "pol",
    ),
)
def policy_block_report(spark: SparkSession, sf: str) -> DataFrame:
    group = F.concat(F.lit("g"), F.substring("model_name", 2, 18).cast("bigint") % 10)
    return policy.block_report(decisions(spark, sf), group)


# --- tags -------------------------------------------------------------------------------------------


@query(
    "missing_required_tags",
    sql(
        """SELECT model_name, version, concat_ws(',', CASE WHEN trim(dataset_fingerprint) = '' THEN 'dataset_fingerprint' END,
        CASE WHEN trim(git_sha) = '' THEN 'git_sha' END, CASE WHEN config_hash IS NULL THEN 'config_hash' END,
        CASE WHEN trim(training_run_id) = '' THEN 'training_run_id' END) AS missing FROM mv""",
        "mv",
    ),
)
def missing_required_tags(spark: SparkSession, sf: str) -> DataFrame:
    missing = policy.missing_required_tags(F.col("tags"))
    return views.model_versions(spark, sf).select("model_name", "version", F.array_join(missing, ",").alias("missing"))


@query(
    "candidate_tags_subset",
    sql(
        """SELECT al.model_name, gate, release_status, source_run_id, dataset_fingerprint, git_sha,
        coalesce(config_hash, '') AS config_hash, training_run_id
        FROM al JOIN mv ON al.model_name = mv.model_name AND al.version = mv.version WHERE alias = 'candidate'""",
        "al", "mv",
    ),
)
def candidate_tags_subset(spark: SparkSession, sf: str) -> DataFrame:
    candidates = views.aliases(spark, sf).filter(F.col("alias") == c.CANDIDATE)
    versions = views.model_versions(spark, sf).select("model_name", "version", "tags")
    subset = policy.tags_subset(F.col("tags")).alias("s")
    return candidates.join(versions, ["model_name", "version"]).select("model_name", subset).select("model_name", "s.*")


@query(
    "copy_run_tags",
    sql(
        """SELECT model_name, version, t.key, t.value FROM (SELECT mv.model_name, mv.version, unnest([
          {'key': 'git_sha', 'value': trim(tag_git_sha)}, {'key': 'dataset_fingerprint', 'value': trim(tag_dataset_fingerprint)},
          {'key': 'row_count', 'value': tag_row_count}, {'key': 'training_run_id', 'value': tag_training_run_id}]) AS t
        FROM mv JOIN rn ON rn.run_id = trim(mv.source_run_id)) WHERE coalesce(t.value, '') <> ''""",
        "mv", "rn",
    ),
)
def copy_run_tags(spark: SparkSession, sf: str) -> DataFrame:
    versions = views.model_versions(spark, sf).select(
        "model_name", "version", strip_or_null(F.col("source_run_id")).alias("run_id")
    )
    tags = views.runs(spark, sf).select("run_id", "tags")
    joined = versions.filter(F.col("run_id").isNotNull()).join(tags, "run_id")
    return joined.select("model_name", "version", F.explode(registry.copied_tags(F.col("tags"))).alias("key", "value"))


# --- registry ---------------------------------------------------------------------------------------

_EXPERIMENT = "concat(c_mktsegment, '/', c_nationkey)"


@query(
    "ensure_experiments",
    f"""SELECT experiment, bool_and(c_acctbal <= 9800) AS created
    FROM (SELECT {_EXPERIMENT} AS experiment, c_acctbal FROM customer) GROUP BY experiment""",
)
def ensure_experiments(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "customer").select(F.expr(_EXPERIMENT).alias("experiment"), "c_acctbal")
    existing = named.filter(F.col("c_acctbal") > 9800).select("experiment").distinct()
    return registry.ensure_experiments(existing, named)


@query(
    "latest_train_run",
    sql(
        """SELECT experiment, max_by(run_id, (start_time, run_id)) FILTER (step = 'train') AS run_id FROM rn GROUP BY experiment""",
        "rn",
    ),
)
def latest_train_run(spark: SparkSession, sf: str) -> DataFrame:
    return registry.latest_train_run(views.runs(spark, sf))


_REGISTERED_SQL = """
SELECT r.model_name, coalesce(newest, 0) + row_number() OVER (PARTITION BY r.model_name ORDER BY start_time, run_id) AS version,
  run_id AS source_run_id, coalesce(nullif(trim(tag_git_sha), ''), '') AS git_sha, coalesce(tag_dataset_fingerprint, '') AS dataset_fingerprint,
  'passed' AS gate, 'candidate' AS release_status
FROM rn r LEFT JOIN md ON md.model_name = r.model_name
WHERE run_id NOT IN (SELECT trim(source_run_id) FROM mv) AND step = 'train' AND lower(trim(gate_ok, concat(' ', chr(9), chr(10), chr(13)))) = 'true'"""


@query("register_versions", sql(_REGISTERED_SQL, "rn", "md", "mv"))
def register_versions(spark: SparkSession, sf: str) -> DataFrame:
    new = registry.register_versions(views.runs(spark, sf), views.model_versions(spark, sf))
    keys = ("git_sha", "dataset_fingerprint", "gate", "release_status")
    return new.select("model_name", "version", "source_run_id", *[tag(F.col("tags"), k).alias(k) for k in keys])


@query(
    "register_candidate_alias",
    sql(
        f"""SELECT coalesce(a.model_name, n.model_name) AS model_name, coalesce(a.alias, 'candidate') AS alias, coalesce(n.version, a.version) AS version
        FROM al a FULL OUTER JOIN (SELECT model_name, max(version) AS version FROM ({_REGISTERED_SQL}) GROUP BY model_name) n
        ON n.model_name = a.model_name AND a.alias = 'candidate'""",
        "al", "rn", "md", "mv",
    ),
)
def register_candidate_alias(spark: SparkSession, sf: str) -> DataFrame:
    new = registry.register_versions(views.runs(spark, sf), views.model_versions(spark, sf))
    return release.upsert_aliases(views.aliases(spark, sf), registry.candidate_changes(new))


_REF_URI = """CASE o_orderkey % 4 WHEN 0 THEN concat('models:/m', o_custkey, '@candidate') WHEN 1 THEN concat('models:/m', o_custkey, '@prod')
  WHEN 2 THEN concat('models:/m', o_custkey, '/', o_orderkey % 15 + 1) ELSE concat('runs:/run-', o_orderkey, '/model') END"""


@query(
    "resolve_model_refs",
    sql(
        """SELECT f.o_orderkey, f.uri, f.model_name, v.version, coalesce(f.run_id, nullif(trim(v.source_run_id), '')) AS run_id, r.run_id IS NOT NULL AS run_found
        FROM (SELECT o_orderkey, x.uri, CASE WHEN o_orderkey % 4 < 3 THEN x.model_name END AS model_name, CASE WHEN o_orderkey % 4 = 3 THEN concat('run-', o_orderkey) END AS run_id,
                CASE WHEN o_orderkey % 4 < 2 THEN al.version WHEN o_orderkey % 4 = 2 THEN o_orderkey % 15 + 1 END AS version
              FROM (SELECT o_orderkey, concat('m', o_custkey) AS model_name, """ + _REF_URI + """ AS uri FROM orders) x
              LEFT JOIN al ON al.model_name = x.model_name AND al.alias = CASE o_orderkey % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'prod' END) f
        LEFT JOIN mv v ON v.model_name = f.model_name AND v.version = f.version
        LEFT JOIN rn r ON r.run_id = coalesce(f.run_id, nullif(trim(v.source_run_id), ''))""",
        "al", "mv", "rn",
    ),
)
def resolve_model_refs(spark: SparkSession, sf: str) -> DataFrame:
    refs = views.orders(spark, sf).select("o_orderkey", F.expr(_REF_URI).alias("uri"))
    versions = views.model_versions(spark, sf).select("model_name", "version", "source_run_id")
    return registry.resolve_refs(refs, views.aliases(spark, sf), versions, views.runs(spark, sf))


@query(
    "alias_upsert",
    sql(
        """SELECT coalesce(a.model_name, x.model_name) AS model_name, coalesce(a.alias, 'prod') AS alias, coalesce(x.newest, a.version) AS version
        FROM al a FULL OUTER JOIN md x ON x.model_name = a.model_name AND a.alias = 'prod'""",
        "al", "md",
    ),
)
def alias_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Point prod of every model to its newest version."""
    newest = views.models(spark, sf).select("model_name", F.lit(c.PROD).alias("alias"), F.col("newest").alias("version"))
    return release.upsert_aliases(views.aliases(spark, sf), newest)


def alias_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each version becomes candidate when created; versions with a passed gate also become prod."""
    passed = F.btrim(F.col("tags")["gate"]) == c.GATE_PASSED
    names = F.array_compact(F.array(F.lit(c.CANDIDATE), F.when(passed, F.lit(c.PROD))))
    return views.model_versions(spark, sf).select(
        "model_name", F.explode(names).alias("alias"), "version", F.col("created_at").alias("ts"), F.col("o_orderkey").alias("seq")
    )


@query(
    "alias_history",
    sql(
        """SELECT model_name, alias, version, strftime(ts, '%Y-%m-%d') AS valid_from,
        strftime(lead(ts) OVER (PARTITION BY model_name, alias ORDER BY ts, seq), '%Y-%m-%d') AS valid_to FROM ae""",
        "ae",
    ),
)
def alias_history(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda name: F.date_format(name, "yyyy-MM-dd").alias(name)
    spans = registry.alias_intervals(alias_events(spark, sf))
    return spans.select("model_name", "alias", "version", day("valid_from"), day("valid_to"))


@query(
    "alias_as_of",
    sql(
        """SELECT model_name, prod_version, count(*) AS items FROM (
          SELECT p.model_name, e.version AS prod_version
          FROM (SELECT concat('m', o_custkey) AS model_name, l_shipdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey) p
          LEFT JOIN (SELECT *, lead(ts) OVER (PARTITION BY model_name ORDER BY ts, seq) AS till FROM ae WHERE alias = 'prod') e
            ON e.model_name = p.model_name AND p.ts >= e.ts AND (p.ts < e.till OR e.till IS NULL))
        GROUP BY ALL""",
        "ae",
    ),
)
def alias_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Which version was prod when each item shipped, counted per version."""
    shipped = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("ts"))
    owner = views.orders(spark, sf).select("o_orderkey", F.concat(F.lit("m"), F.col("o_custkey")).alias("model_name"))
    # Items of one model and instant get one answer: they are counted first, and the small result is kept, as the as-of
    # operator measures its input before it works on it.
    shared_root(spark)
    counted = shipped.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("model_name", "ts").agg(F.count(F.lit(1)).alias("n"))
    probes = counted.withColumn("alias", F.lit(c.PROD)).checkpoint()
    prod_events = alias_events(spark, sf).filter(F.col("alias") == c.PROD)
    found = registry.alias_as_of(prod_events, probes)
    return found.groupBy("model_name", F.col("as_of_version").alias("prod_version")).agg(F.sum("n").alias("items"))


@query(
    "not_ready_models",
    sql(
        """SELECT md.model_name, p.version AS prod_version, CASE WHEN p.version IS NULL THEN 'prod alias missing' WHEN v.version IS NULL THEN 'version missing'
          ELSE 'run missing' END AS reason
        FROM md LEFT JOIN al p ON p.model_name = md.model_name AND p.alias = 'prod'
        LEFT JOIN mv v ON v.model_name = md.model_name AND v.version = p.version
        LEFT JOIN rn r ON r.run_id = trim(v.source_run_id) WHERE r.run_id IS NULL""",
        "md", "al", "mv", "rn",
    ),
)
def not_ready_models(spark: SparkSession, sf: str) -> DataFrame:
    return registry.not_ready(
        views.models(spark, sf), views.aliases(spark, sf), views.model_versions(spark, sf), views.runs(spark, sf)
    )


@query(
    "lineage_join",
    sql(
        """SELECT mv.model_name, mv.version, nullif(trim(mv.source_run_id), '') AS source_run_id, rn.experiment,
        rn.tag_dataset_fingerprint AS run_fingerprint, nullif(trim(rn.tag_git_sha), '') AS run_git_sha, rn.run_id IS NULL AS orphan
        FROM mv LEFT JOIN rn ON rn.run_id = nullif(trim(mv.source_run_id), '')""",
        "mv", "rn",
    ),
)
def lineage_join(spark: SparkSession, sf: str) -> DataFrame:
    return registry.lineage(views.model_versions(spark, sf), views.runs(spark, sf))


@query(
    "fingerprint_diff",
    sql(
        """SELECT model_name, pv AS previous_version, version, concat_ws(',', CASE WHEN trim(dataset_fingerprint) <> pf THEN 'dataset_fingerprint' END,
          CASE WHEN trim(git_sha) <> pg THEN 'git_sha' END, CASE WHEN coalesce(config_hash, '') <> pc THEN 'config_hash' END) AS changed
        FROM (SELECT *, lag(version) OVER w AS pv, lag(trim(dataset_fingerprint)) OVER w AS pf, lag(trim(git_sha)) OVER w AS pg,
                lag(coalesce(config_hash, '')) OVER w AS pc FROM mv WINDOW w AS (PARTITION BY model_name ORDER BY version)) WHERE pv IS NOT NULL""",
        "mv",
    ),
)
def fingerprint_diff(spark: SparkSession, sf: str) -> DataFrame:
    return registry.fingerprint_diff(views.model_versions(spark, sf))


# --- release state ----------------------------------------------------------------------------------


def _state(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    versions = views.model_versions(spark, sf).select("model_name", "version", "tags")
    return views.models(spark, sf).select("model_name"), views.aliases(spark, sf), versions


def promoted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Models, aliases and versions after promotion."""
    models, aliases, versions = _state(spark, sf)
    decided = policy.evaluate(models, aliases, versions, views.runs(spark, sf))
    return models, *release.apply_promotion(decided, aliases, versions)


def stored_promoted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same, stored once: steps that follow read it several times."""
    models, aliases, versions = promoted(spark, sf)
    return models, *release_table.read(spark, release_table.store(aliases, versions))


@query("apply_promotion_aliases", sql("SELECT * FROM pr", "pr"))
def apply_promotion_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return promoted(spark, sf)[1]


@query(
    "apply_promotion_tags",
    sql(
        """SELECT v.model_name, v.version, CASE WHEN p.cand = v.version THEN 'prod' WHEN p.cur = v.version THEN 'previous_prod' ELSE v.release_status END AS release_status,
          CASE WHEN p.cand = v.version THEN 'candidate' ELSE '' END AS promoted_from_alias,
          CASE WHEN p.cand = v.version THEN coalesce(CAST(p.cur AS VARCHAR), '') ELSE '' END AS previous_prod_version
        FROM mv v LEFT JOIN pol p ON p.model_name = v.model_name AND p.error_codes = ''""",
        "mv", "pol",
    ),
)
def apply_promotion_tags(spark: SparkSession, sf: str) -> DataFrame:
    keys = ("release_status", "promoted_from_alias", "previous_prod_version")
    return promoted(spark, sf)[2].select("model_name", "version", *[tag(F.col("tags"), k).alias(k) for k in keys])


@query(
    "rollback_aliases",
    sql(
        """SELECT pr.model_name, pr.alias, CASE WHEN pr.alias = 'prod' AND p.cur IS NOT NULL THEN p.cur ELSE pr.version END AS version
        FROM pr LEFT JOIN pol p ON p.model_name = pr.model_name AND p.error_codes = ''""",
        "pr", "pol",
    ),
)
def rollback_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return release.rollback(*stored_promoted(spark, sf))[0]


@query(
    "rollback_blocked",
    sql(
        """SELECT pol.model_name, pr.version AS current_version, CASE WHEN pr.version IS NULL THEN 'MISSING_PROD_ALIAS' ELSE 'MISSING_PREVIOUS_PROD_VERSION' END AS reason
        FROM pol LEFT JOIN pr ON pr.model_name = pol.model_name AND pr.alias = 'prod'
        WHERE pr.version IS NULL OR NOT (error_codes = '' AND cur IS NOT NULL)""",
        "pr", "pol",
    ),
)
def rollback_blocked(spark: SparkSession, sf: str) -> DataFrame:
    return release.rollback(*stored_promoted(spark, sf))[2].select("model_name", "current_version", "reason")


@query(
    "rollback_undo",
    sql(
        """SELECT pol.model_name, pr.version AS promoted, CASE WHEN error_codes = '' AND cur IS NOT NULL THEN cur ELSE pr.version END AS rolled_back, pr.version AS undone
        FROM pol JOIN pr ON pr.model_name = pol.model_name AND pr.alias = 'prod'""",
        "pr", "pol",
    ),
)
def rollback_undo(spark: SparkSession, sf: str) -> DataFrame:
    """Prod version after promotion, after rollback, and after rolling back again."""
    models, promoted, versions = stored_promoted(spark, sf)
    once, versions_once = release_table.read(spark, release_table.store(*release.rollback(models, promoted, versions)[:2]))
    twice, _, _ = release.rollback(models, once, versions_once)

    def prod(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col("alias") == c.PROD).select("model_name", F.col("version").alias(name))

    return prod(promoted, "promoted").join(prod(once, "rolled_back"), "model_name").join(prod(twice, "undone"), "model_name")


@query(
    "alias_consistency",
    sql(
        """SELECT * FROM (SELECT a.model_name, a.prod_version, a.champion_version, a.prod_version IS DISTINCT FROM a.champion_version AS champion_differs,
            a.prod_version IS NOT NULL AND coalesce(mv.release_status, '') <> 'prod' AS status_differs
          FROM (SELECT model_name, max(version) FILTER (alias = 'prod') AS prod_version, max(version) FILTER (alias = 'champion') AS champion_version
                FROM al WHERE alias IN ('prod', 'champion') GROUP BY model_name) a
          LEFT JOIN mv ON mv.model_name = a.model_name AND mv.version = a.prod_version) WHERE champion_differs OR status_differs""",
        "al", "mv",
    ),
)
def alias_consistency(spark: SparkSession, sf: str) -> DataFrame:
    _, aliases, versions = _state(spark, sf)
    return release.alias_consistency(aliases, versions)
