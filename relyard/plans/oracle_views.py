"""SQL text of the derived release tables, for the DuckDB side of each query."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "mv": ((), """
SELECT concat('m', o_custkey) AS model_name, o_custkey, o_orderkey,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS version,
       CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN concat('lost-', o_orderkey)
            ELSE concat('run-', o_orderkey) END AS source_run_id,
       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('fp-', o_orderkey) END AS dataset_fingerprint,
       CASE WHEN o_orderkey % 13 = 0 THEN '  ' ELSE concat('sha-', o_orderkey) END AS git_sha,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('cfg-', o_orderkey) END AS config_hash,
       CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE concat('run-', o_orderkey) END AS training_run_id,
       CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN ' passed ' ELSE 'failed' END AS gate,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'prod' WHEN '5-LOW' THEN '' ELSE 'candidate' END AS release_status,
       o_orderdate AS created_at
FROM orders"""),
    "md": ((), """
SELECT concat('m', o_custkey) AS model_name, o_custkey, count(*) AS newest FROM orders GROUP BY o_custkey"""),
    "al": (("md",), """
WITH k AS (SELECT model_name, newest, c_acctbal, c_mktsegment, c_nationkey < 2 AS same,
                  NOT (c_nationkey < 2) AND c_mktsegment <> 'HOUSEHOLD' AND newest > 1 AS behind
           FROM md JOIN customer ON o_custkey = c_custkey)
SELECT model_name, 'candidate' AS alias, newest AS version FROM k WHERE c_acctbal >= 500
UNION ALL SELECT model_name, 'prod', CASE WHEN same THEN newest ELSE newest - 1 END FROM k WHERE same OR behind
UNION ALL SELECT model_name, 'champion', CASE WHEN c_acctbal > 9000 THEN 1 ELSE newest - 1 END FROM k WHERE behind"""),
    "rn": ((), """
SELECT concat('run-', o_orderkey) AS run_id, concat('e', o_custkey % 20) AS experiment, concat('m', o_custkey) AS model_name,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 'evaluate' ELSE 'train' END AS step, o_orderdate AS start_time,
       CASE WHEN o_orderkey % 13 = 0 THEN '  ' ELSE concat(' sha-', o_orderkey) END AS tag_git_sha,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('fp-', o_orderkey) END AS tag_dataset_fingerprint,
       CAST(o_custkey AS VARCHAR) AS tag_row_count, concat('run-', o_orderkey) AS tag_training_run_id,
       CASE WHEN o_orderstatus <> 'P' THEN 'balanced' END AS p_class_weight,
       CAST(1000 + (o_orderkey % 3) * 500 AS VARCHAR) AS p_max_iter,
       o_totalprice / 5e5 AS eval_roc_auc,
       CASE WHEN o_totalprice / 5e5 < 0.95 THEN 'false' WHEN o_orderstatus = 'F' THEN 'true'
            WHEN o_orderstatus = 'O' THEN concat(' TRUE', chr(10)) ELSE 'yes' END AS gate_ok
FROM orders"""),
    "co": (("mv",), """
SELECT model_name, version, (o_orderkey % 7 - 3) / 1e1 AS intercept, (o_orderkey % 11 - 5) / 1e1 AS w_k,
       (o_orderkey % 5 - 2) / 1e1 AS w_v, CASE WHEN o_orderkey % 10 = 0 THEN 1.0e0 ELSE 20.0e0 END AS sd_v
FROM mv"""),
    "rq": ((), """
SELECT event_id, ts, user_id, concat('m', user_id) AS model_name,
       CASE event_id % 3 WHEN 1 THEN concat(' req-', event_id % 4000, ' ') WHEN 2 THEN concat('req-', event_id) END AS client_request_id,
       CASE user_id % 6 WHEN 0 THEN 'prod' WHEN 1 THEN 'candidate' WHEN 2 THEN 'shadow' WHEN 5 THEN 'bogus' ELSE 'canary' END AS mode,
       CASE event_type WHEN 'view' THEN '/health' WHEN 'signup' THEN '/metrics' ELSE '/predict' END AS endpoint,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v,
       event_id % 20 AS kind, CASE WHEN event_id % 20 = 4 THEN 0.5e0 ELSE 0e0 END + CAST(json_extract_string(props, '$.k') AS BIGINT) AS kx, value / 1e2 AS latency_s,
       CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 503 WHEN event_type = 'error' THEN 500 ELSE 200 END AS status
FROM events"""),
    "rp": (("rq",), """
SELECT *, trim(client_request_id) IS NOT NULL AS client_provided,
       coalesce(trim(client_request_id), md5(concat('request:', event_id))) AS request_id,
       CASE kind WHEN 9 THEN 'missing_rows' WHEN 19 THEN 'invalid_json' WHEN 13 THEN 'rows_not_list' WHEN 7 THEN 'row_not_object' END AS body_error,
       CASE WHEN kind IN (9, 19, 13, 7) THEN NULL WHEN kind = 14 THEN '[]' WHEN kind = 3 THEN concat('[{"k":', k, '}]')
            WHEN kind = 4 THEN concat('[{"k":', k, '.5,"v":', v, '.0,"\\u00e9":1e-05},{"k":', k, '.5,"v":', event_id % 50, '.0}]')
            WHEN kind = 6 THEN concat('[{"k":', k, ',"v":', v, ',"x":1e+22},{"k":', k, ',"v":', event_id % 50, ',"\\u00fc":0}]')
            ELSE concat('[{"k":', k, ',"v":', v, '},{"k":', k, ',"v":', event_id % 50, '}]') END AS rows_text
FROM rq WHERE endpoint = '/predict'"""),
    "rb": (("rp",), """
SELECT *, sha256(CASE WHEN client_provided THEN request_id ELSE coalesce(rows_text, request_id) END) AS h,
       CASE WHEN mode = 'canary' THEN CASE WHEN client_provided THEN 'request_id' WHEN rows_text IS NOT NULL THEN 'payload_hash' ELSE 'random' END END AS seed_source
FROM rp"""),
    "rt": (("rb",), """
SELECT *, CASE WHEN mode NOT IN ('prod', 'candidate', 'shadow', 'canary') THEN NULL
               WHEN mode = 'candidate' OR (mode = 'canary' AND bucket < 10) THEN 'candidate' ELSE 'prod' END AS chosen,
       CASE WHEN mode IN ('shadow', 'canary') THEN true WHEN mode IN ('prod', 'candidate') THEN false END AS run_shadow,
       CASE WHEN mode = 'canary' THEN 10 END AS canary_pct
FROM (SELECT * , CASE WHEN mode = 'canary' THEN CAST((76 * (('0x' || substr(h, 1, 4))::BIGINT % 100 + ('0x' || substr(h, 5, 15))::BIGINT % 100
        + ('0x' || substr(h, 20, 15))::BIGINT % 100 + ('0x' || substr(h, 35, 15))::BIGINT % 100) + ('0x' || substr(h, 50, 15))::BIGINT % 100) % 100 AS INTEGER) END AS bucket
      FROM rb)"""),
    "sm": (("al", "co"), """
SELECT p.model_name, pv AS prod_version, cv AS candidate_version,
       a.intercept AS p_i, a.w_k AS p_k, a.w_v AS p_v, a.sd_v AS p_sd, b.intercept AS c_i, b.w_k AS c_k, b.w_v AS c_v, b.sd_v AS c_sd
FROM (SELECT model_name, max(version) FILTER (alias = 'prod') AS pv, max(version) FILTER (alias = 'candidate') AS cv
      FROM al WHERE alias IN ('prod', 'candidate') GROUP BY model_name) p
LEFT JOIN co a ON a.model_name = p.model_name AND a.version = p.pv
LEFT JOIN co b ON b.model_name = p.model_name AND b.version = p.cv"""),
    "sv": (("rt", "sm"), """
SELECT *, CASE WHEN status = 200 AND run_shadow AND other_i IS NOT NULL
               THEN CASE WHEN n = 0 THEN 0.0e0 ELSE (abs(p0 - q0) + abs(p1 - q1)) / 2 END END AS shadow_mae
FROM (SELECT *, CASE WHEN body_error IS NOT NULL OR chosen IS NULL THEN 422 WHEN main_i IS NULL THEN 503 WHEN kind = 3 THEN 500 ELSE 200 END AS status,
        CASE WHEN kind = 14 THEN 0 ELSE 2 END AS n,
        1 / (1 + exp(-(main_i + main_k * ((kx - 50) / 25e0) + main_v * ((v - 25) / main_sd)))) AS p0,
        1 / (1 + exp(-(main_i + main_k * ((kx - 50) / 25e0) + main_v * ((event_id % 50 - 25) / main_sd)))) AS p1,
        1 / (1 + exp(-(other_i + other_k * ((kx - 50) / 25e0) + other_v * ((v - 25) / other_sd)))) AS q0,
        1 / (1 + exp(-(other_i + other_k * ((kx - 50) / 25e0) + other_v * ((event_id % 50 - 25) / other_sd)))) AS q1
      FROM (SELECT rt.* EXCLUDE (status), prod_version, candidate_version,
              CASE WHEN chosen = 'prod' THEN prod_version ELSE candidate_version END AS version,
              CASE WHEN chosen = 'prod' THEN p_i ELSE c_i END AS main_i, CASE WHEN chosen = 'prod' THEN p_k ELSE c_k END AS main_k,
              CASE WHEN chosen = 'prod' THEN p_v ELSE c_v END AS main_v, CASE WHEN chosen = 'prod' THEN p_sd ELSE c_sd END AS main_sd,
              CASE WHEN chosen = 'prod' THEN c_i ELSE p_i END AS other_i, CASE WHEN chosen = 'prod' THEN c_k ELSE p_k END AS other_k,
              CASE WHEN chosen = 'prod' THEN c_v ELSE p_v END AS other_v, CASE WHEN chosen = 'prod' THEN c_sd ELSE p_sd END AS other_sd
            FROM rt LEFT JOIN sm ON rt.model_name = sm.model_name))"""),
    "sc": ((), """
SELECT l.doc_id AS row_id, d.lang AS slice, l.quality AS label, (d.n_chars % 1000) / 1e3 AS score
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""),
    "sb": ((), """
SELECT concat('s', l_suppkey) AS model_name, l_returnflag AS slice,
       CASE WHEN l_suppkey % 10 = 3 AND l_linenumber = 4 THEN NULL WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS label,
       CASE WHEN l_suppkey % 10 = 7 OR (l_suppkey % 10 = 5 AND l_linenumber = 2) THEN NULL ELSE (l_partkey % 1000) / 1e3 END AS score
FROM lineitem"""),
    "ds": ((), """
SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
       o_totalprice AS f0, c_acctbal AS f1, c_nationkey * 1e0 AS f2
FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "sz": (("ds",), """
SELECT target, n, CAST(fl AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY ex - fl DESC, target) <= wanted - sum(fl) OVER () THEN 1 ELSE 0 END AS n_test
FROM (SELECT *, floor(ex) AS fl FROM (SELECT target, n, wanted, n * wanted / total AS ex
      FROM (SELECT target, count(*) AS n, sum(count(*)) OVER () AS total, ceil(round(0.2e0 * sum(count(*)) OVER (), 9)) AS wanted FROM ds GROUP BY target)))"""),
    "sp": (("ds", "sz"), """
SELECT d.*, CASE WHEN row_number() OVER (PARTITION BY d.target ORDER BY sha256(concat('42:', d.row_id)), d.row_id) <= sz.n_test THEN 'test' ELSE 'train' END AS split
FROM ds d JOIN sz ON d.target = sz.target"""),
    "pol": (("mv", "md", "al", "rn"), """
SELECT *, CASE WHEN cand IS NULL THEN 'MISSING_ALIAS' ELSE concat_ws(',',
          CASE WHEN missing <> '' THEN 'MISSING_REQUIRED_TAGS' END, CASE WHEN gate_v <> 'passed' THEN 'GATE_NOT_PASSED' END,
          CASE WHEN status_v <> 'candidate' THEN 'INVALID_RELEASE_STATUS' END, CASE WHEN cand = cur THEN 'NOOP_PROMOTION' END) END AS error_codes,
       CASE WHEN cand IS NULL THEN '' WHEN run_v = '' THEN 'MISSING_SOURCE_RUN_ID' WHEN NOT run_found THEN 'SOURCE_RUN_ID_NOT_FOUND' ELSE '' END AS warning_codes
FROM (SELECT md.model_name, md.o_custkey, c.version AS cand, p.version AS cur, trim(v.gate) AS gate_v, trim(v.release_status) AS status_v,
        trim(v.source_run_id) AS run_v, r.run_id IS NOT NULL AS run_found,
        v.gate, v.release_status, v.source_run_id, v.dataset_fingerprint, v.git_sha, coalesce(v.config_hash, '') AS config_hash, v.training_run_id,
        concat_ws(',', CASE WHEN trim(coalesce(v.dataset_fingerprint, '')) = '' THEN 'dataset_fingerprint' END, CASE WHEN trim(coalesce(v.git_sha, '')) = '' THEN 'git_sha' END,
          CASE WHEN trim(coalesce(v.config_hash, '')) = '' THEN 'config_hash' END, CASE WHEN trim(coalesce(v.training_run_id, '')) = '' THEN 'training_run_id' END) AS missing
      FROM md LEFT JOIN al c ON c.model_name = md.model_name AND c.alias = 'candidate'
      LEFT JOIN al p ON p.model_name = md.model_name AND p.alias = 'prod'
      LEFT JOIN mv v ON v.model_name = md.model_name AND v.version = c.version
      LEFT JOIN rn r ON r.run_id = trim(v.source_run_id))"""),
    "ae": (("mv",), """
SELECT model_name, 'candidate' AS alias, version, created_at AS ts, o_orderkey AS seq FROM mv
UNION ALL SELECT model_name, 'prod', version, created_at, o_orderkey FROM mv WHERE trim(gate) = 'passed'"""),
    "pr": (("al", "pol"), """
SELECT coalesce(a.model_name, x.model_name) AS model_name, coalesce(a.alias, x.alias) AS alias, coalesce(x.version, a.version) AS version
FROM al a FULL OUTER JOIN (SELECT model_name, cand AS version, unnest(['prod', 'champion']) AS alias FROM pol WHERE error_codes = '') x
  ON a.model_name = x.model_name AND a.alias = x.alias"""),
}


def _needed(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needed(VIEWS[name][0], seen)
            if name not in seen:
                seen.append(name)
    return seen


def sql(body: str, *views: str) -> str:
    """Body with the views it uses, and those they use, in front as CTEs."""
    ctes = [f"{name} AS ({VIEWS[name][1].strip()})" for name in _needed(views, [])]
    return f"WITH {', '.join(ctes)}\n{body.strip()}" if ctes else body.strip()
