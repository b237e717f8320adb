"""SQL that answers the same questions, written independently for a single-node engine."""

from __future__ import annotations

NUMERIC = ("amount", "quantity", "n_lines", "discount")
PREDICTION_TOTALS = "P, N"

LINES = """lines AS (SELECT l_orderkey, SUM(l_quantity) AS quantity, CAST(COUNT(*) AS DOUBLE) AS n_lines,
  SUM(l_discount) AS discount FROM lineitem GROUP BY l_orderkey)"""
VISITS = LINES + """, visits AS (SELECT o_custkey AS entity_id, o_orderkey AS visit_id,
  CAST(o_orderdate AS DATE) AS visit_date, o_totalprice AS amount, quantity, n_lines, discount,
  CAST(CASE WHEN n_lines >= 10 THEN 1 ELSE 0 END AS INTEGER) AS event_flag,
  o_orderstatus AS status, o_orderpriority AS priority
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey)"""
SEGMENTED = VISITS + """, segmented AS (SELECT v.*, c_mktsegment AS segment
  FROM visits v LEFT JOIN customer ON c_custkey = entity_id)"""
RANKED = VISITS + """, ranked AS (SELECT *, ROW_NUMBER() OVER w AS rn, COUNT(*) OVER (PARTITION BY entity_id) AS nv
  FROM visits WINDOW w AS (PARTITION BY entity_id ORDER BY visit_date, visit_id))"""
EVENT = "(event_flag = 1 OR amount >= 450000)"


def u(seed: int, *parts: str) -> str:
    """The hash number in [0, 1) of a seed and SQL expressions."""
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return (f"(CAST(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 8) AS UBIGINT) AS DOUBLE)"
            " / 4294967296.0)")


# --- cohorts -----------------------------------------------------------------

COHORT_TAIL = f"""
, summary AS (SELECT entity_id, COUNT(*) FILTER (is_obs) AS n_obs, MAX(visit_date) FILTER (is_obs) AS cutoff,
    BOOL_OR({EVENT}) FILTER (is_obs) AS prior FROM placed GROUP BY entity_id)
, ahead AS (SELECT s.entity_id, COUNT(*) AS n_after,
    COUNT(*) FILTER (p.visit_date <= s.cutoff + 365) AS n_in,
    MAX(CASE WHEN {EVENT} THEN 1 ELSE 0 END) FILTER (p.visit_date <= s.cutoff + 365) AS hit,
    MAX(amount) FILTER (p.visit_date <= s.cutoff + 365) AS max_measure,
    MAX(event_flag) FILTER (p.visit_date <= s.cutoff + 365) AS any_flag
    FROM summary s JOIN placed p ON p.entity_id = s.entity_id AND NOT is_obs AND p.visit_date > s.cutoff
    GROUP BY s.entity_id)
, facts AS (SELECT s.*, COALESCE(n_after, 0) AS n_after, COALESCE(n_in, 0) AS n_in, hit, max_measure, any_flag,
    CASE WHEN n_obs < 3 THEN 'too_few_visits' WHEN COALESCE(n_after, 0) = 0 THEN 'no_followup'
         WHEN prior THEN 'prior_condition' WHEN COALESCE(n_in, 0) = 0 THEN 'none_in_horizon'
         ELSE 'eligible' END AS status
    FROM summary s LEFT JOIN ahead a ON a.entity_id = s.entity_id)"""
POSITIONAL = "WITH " + RANKED + ", placed AS (SELECT *, rn <= 4 AS is_obs FROM ranked)" + COHORT_TAIL
FLAGGED = ("WITH " + VISITS + ", placed AS (SELECT *, visit_date < DATE '1998-07-01' AS is_obs FROM visits)"
           + COHORT_TAIL)
OUTCOME = " SELECT entity_id, status, CASE WHEN status = 'eligible' THEN hit END AS target FROM facts"
AUDIT = """ SELECT entity_id, hit AS target, CAST(LEAST(n_obs, 4) AS INTEGER) AS n_obs,
  CAST(cutoff AS VARCHAR) AS cutoff, CAST(cutoff + 365 AS VARCHAR) AS horizon_end,
  CAST(n_in AS INTEGER) AS n_in_horizon, ROUND(max_measure, 2) AS max_measure, any_flag
  FROM facts WHERE status = 'eligible'"""
VISIT_COLUMNS = """entity_id, visit_id, CAST(visit_date AS VARCHAR) AS visit_date, ROUND(amount, 6) AS amount,
  ROUND(quantity, 6) AS quantity, ROUND(n_lines, 6) AS n_lines, ROUND(discount, 6) AS discount,
  event_flag, status, priority"""
KEPT = """ SELECT {cols} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id
  ORDER BY visit_date DESC, visit_id DESC) AS back FROM placed WHERE is_obs)
  WHERE back <= 4 AND entity_id IN (SELECT entity_id FROM facts WHERE status = 'eligible')"""


def counts(source: str) -> str:
    return f""" SELECT COUNT(*) AS input_entities, COUNT(*) FILTER (status = 'eligible') AS eligible,
  COUNT(*) FILTER (status = 'prior_condition') AS excluded_prior,
  COUNT(*) FILTER (status = 'too_few_visits') AS excluded_visits,
  COUNT(*) FILTER (status IN ('no_followup', 'none_in_horizon', 'no_target')) AS excluded_followup,
  COUNT(*) FILTER (status = 'inconsistent_target') AS excluded_inconsistent,
  COUNT(*) FILTER (target = 1) AS positive, COUNT(*) FILTER (target = 0) AS negative,
  COALESCE(ROUND(COUNT(*) FILTER (target = 1) / NULLIF(COUNT(*) FILTER (target IN (0, 1)), 0), 4), 0.0)
    AS positive_rate FROM ({source})"""


def prelabeled(target: str) -> str:
    return ("WITH " + RANKED + f""", marked AS (SELECT r.*, {target} AS target FROM ranked r
    LEFT JOIN customer ON c_custkey = entity_id)
, facts AS (SELECT entity_id, COUNT(*) AS n, MIN(target) AS low, MAX(target) AS high,
    MAX(event_flag) FILTER (rn <= 4) AS prior, COUNT(*) FILTER (rn <= 4) AS n_obs,
    MAX(visit_date) FILTER (rn <= 4) AS cutoff,
    CASE WHEN COUNT(*) < 3 THEN 'too_few_visits' WHEN MIN(target) <> MAX(target) THEN 'inconsistent_target'
      WHEN MIN(target) IS NULL THEN 'no_target' WHEN MAX(event_flag) FILTER (rn <= 4) = 1 THEN 'prior_condition'
      ELSE 'eligible' END AS status FROM marked GROUP BY entity_id)""")


PRELABELED = prelabeled("CAST(c_acctbal < 0 AS INTEGER)")
PRE_OUTCOME = " SELECT entity_id, status, CASE WHEN status = 'eligible' THEN low END AS target FROM facts"

ORACLE: dict[str, str] = {
    "visits": "WITH " + SEGMENTED + f" SELECT {VISIT_COLUMNS}, segment FROM segmented",
    "cohort_outcome": POSITIONAL + OUTCOME,
    "cohort_status_counts": POSITIONAL + counts(OUTCOME),
    "cohort_audit": POSITIONAL + AUDIT,
    "cohort_observation": POSITIONAL + KEPT.format(cols=VISIT_COLUMNS),
    "cohort_flagged_outcome": FLAGGED + OUTCOME,
    "cohort_flagged_audit": FLAGGED + AUDIT,
    "cohort_flagged_observation": FLAGGED + KEPT.format(cols=VISIT_COLUMNS),
    "cohort_leaked_rows": FLAGGED + """ SELECT COUNT(*) AS n_leaked FROM placed p JOIN facts f
        ON f.entity_id = p.entity_id WHERE f.status = 'eligible' AND is_obs AND p.visit_date > f.cutoff""",
    "cohort_prelabeled": PRELABELED + PRE_OUTCOME,
    "cohort_prelabeled_audit": PRELABELED + """ SELECT entity_id, low AS target, CAST(n_obs AS INTEGER) AS n_obs,
        CAST(cutoff AS VARCHAR) AS cutoff FROM facts WHERE status = 'eligible'""",
    "cohort_prelabeled_observation": PRELABELED + f""" SELECT {VISIT_COLUMNS} FROM marked
        WHERE rn <= 4 AND entity_id IN (SELECT entity_id FROM facts WHERE status = 'eligible')""",
    "cohort_inconsistent_counts": prelabeled("CAST(status = 'F' AS INTEGER)") + counts(PRE_OUTCOME),
}

# --- projections and guards ------------------------------------------------------

UNTIDY = """untidy AS (SELECT o_orderkey AS visit_id, o_custkey, CAST(o_orderdate AS DATE) AS visit_date,
  CASE o_orderkey % 6 WHEN 4 THEN o_orderpriority END AS status,
  o_orderkey % 5 IN (0, 2) AS is_future, o_totalprice AS amount FROM orders)"""
ORACLE |= {
    "strip_leakage": "WITH " + VISITS + """ SELECT entity_id, visit_id, amount, quantity AS "Future_HbA1c_max",
        status AS note FROM visits""",
    "safe_columns": "WITH " + VISITS + """ SELECT entity_id, visit_id, amount, status AS note FROM visits""",
    "observation_rows": "WITH " + VISITS + f" SELECT {VISIT_COLUMNS} FROM visits WHERE visit_date < DATE '1998-07-01'",
    "missing_tokens": "WITH " + UNTIDY + " SELECT visit_id, status FROM untidy",
    "future_flags": "WITH " + UNTIDY + " SELECT visit_id, CAST(is_future AS INTEGER) AS is_future FROM untidy",
    "clean_clinical": """SELECT '  C' || o_custkey || ' ' AS entity_id, o_orderkey AS visit_id,
        CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS visit_date, ROUND(o_totalprice, 6) AS amount,
        CASE o_orderkey % 6 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'None' WHEN 2 THEN '<NA>'
          WHEN 4 THEN ' ' || o_orderpriority END AS status FROM orders""",
    "normalized_ids": "SELECT o_orderkey AS visit_id, 'C' || o_custkey AS entity_id FROM orders",
}

# --- wide features -----------------------------------------------------------------


def waves(c: str) -> list[str]:
    return [f"ROUND(MAX({c}) FILTER (rn = {k}), 6) AS {c}_w{k}" for k in range(1, 5)]


def slope(c: str) -> str:
    x = f"FILTER ({c} IS NOT NULL)"
    return (f"ROUND(CASE WHEN COUNT({c}) >= 2 THEN (COUNT({c}) * SUM((rn - 1) * {c}) - SUM(rn - 1) {x} * SUM({c}))"
            f" / (COUNT({c}) * SUM((rn - 1) * (rn - 1)) {x} - SUM(rn - 1) {x} * SUM(rn - 1) {x}) END, 6) AS {c}_slope")


def summaries(c: str) -> list[str]:
    return [
        f"ROUND(ARG_MAX({c}, rn) FILTER ({c} IS NOT NULL), 6) AS {c}_latest", f"ROUND(AVG({c}), 6) AS {c}_mean",
        f"ROUND(MIN({c}), 6) AS {c}_min", f"ROUND(MAX({c}), 6) AS {c}_max",
        f"ROUND(CASE WHEN COUNT({c}) >= 2 THEN STDDEV_SAMP({c}) END, 6) AS {c}_std",
        f"ROUND(CASE WHEN COUNT({c}) >= 2 THEN ARG_MAX({c}, rn) FILTER ({c} IS NOT NULL)"
        f" - ARG_MIN({c}, rn) FILTER ({c} IS NOT NULL) END, 6) AS {c}_delta"]


def grouped(source: str, *parts: list[str]) -> str:
    return f" SELECT entity_id, {', '.join(x for p in parts for x in p)} FROM {source} GROUP BY entity_id"


COUNT = ["CAST(COUNT(*) AS INTEGER) AS n_obs_visits"]
CATS = [f"ARG_MAX({c}, rn) AS {c}_latest" for c in ("status", "priority")]
ALL_WAVES = [x for c in NUMERIC for x in waves(c)]
ALL_SUMMARIES = [x for c in NUMERIC for x in summaries(c)]
ALL_SLOPES = [slope(c) for c in NUMERIC]
WIDE = grouped("ranked", ALL_WAVES, ALL_SUMMARIES, ALL_SLOPES, CATS, COUNT)
OBSERVED = POSITIONAL + """, kept AS (SELECT * FROM placed
  WHERE is_obs AND entity_id IN (SELECT entity_id FROM facts WHERE status = 'eligible'))"""
SUFFIXES = {"latest": "latest", "mean": "mean", "min": "min", "max": "max", "std": "std",
            "delta": "last_minus_first", "slope": "linear_slope"}
CATALOGUE = (
    [(f"{c}_w{k}", c, str(k), "raw_observation", "numeric_wave") for c in NUMERIC for k in range(1, 5)]
    + [(f"{c}_{s}", c, "NULL", name, "numeric_temporal") for c in NUMERIC for s, name in SUFFIXES.items()]
    + [(f"{c}_latest", c, "NULL", "categorical_latest", "categorical") for c in ("status", "priority")]
    + [("n_obs_visits", "visit_count", "NULL", "count", "meta")])
ORACLE |= {
    "wide_waves": "WITH " + RANKED + grouped("ranked", ALL_WAVES, COUNT),
    "wide_temporal": "WITH " + RANKED + grouped("ranked", ALL_SUMMARIES),
    "wide_slope": "WITH " + RANKED + grouped("ranked", ALL_SLOPES),
    "wide_categorical": "WITH " + RANKED + """ SELECT entity_id, ARG_MAX(status, rn) AS status_latest,
        ARG_MAX(priority, rn) AS priority_latest, ARG_MAX(c_mktsegment, rn) AS segment_latest
        FROM ranked LEFT JOIN customer ON c_custkey = entity_id GROUP BY entity_id""",
    "wide_cohort_features": OBSERVED + grouped("kept", ALL_WAVES, ALL_SUMMARIES, ALL_SLOPES, CATS, COUNT),
    "feature_catalogue": "WITH " + RANKED + ", wide AS (" + WIDE + ") " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, '{s}' AS source, CAST({w} AS INTEGER) AS wave, '{n}' AS transformation,"
        f" '{k}' AS kind, COUNT({f}) AS n_present FROM wide" for f, s, w, n, k in CATALOGUE),
    "wide_statistics": """SELECT COUNT(DISTINCT o_custkey) AS n_entities, 4 * 11 + 3 AS n_features,
        16 AS n_wave_features, 28 AS n_temporal_features, 2 AS n_categorical_features, 4 AS max_waves FROM orders""",
    "wide_labelled": OBSERVED + """ SELECT k.entity_id, ROUND(ARG_MAX(amount, rn), 6) AS amount_latest,
        MAX(hit) AS target FROM kept k JOIN facts f ON f.entity_id = k.entity_id GROUP BY k.entity_id""",
}

# --- sequences ---------------------------------------------------------------------------


def vocab(source: str, columns: tuple[str, ...], where: str = "TRUE") -> str:
    parts = []
    for c in columns:
        parts.append(f"SELECT '{c}' AS feature, 0 AS slot, '<MISSING>' AS label")
        parts.append(f"SELECT '{c}', 1, '<UNK>'")
        parts.append(f"SELECT '{c}', CAST(1 + ROW_NUMBER() OVER (ORDER BY v) AS INTEGER), v"
                     f" FROM (SELECT DISTINCT {c} AS v FROM {source} WHERE {c} IS NOT NULL AND {where})")
    return " UNION ALL ".join(parts)


STEPS = RANKED + """, steps AS (SELECT *, CAST(rn - 1 - GREATEST(nv - 4, 0) AS INTEGER) AS step FROM ranked
  WHERE rn > nv - 4)"""
NUM_CELLS = " UNION ALL ".join(f"SELECT entity_id, step, '{c}' AS feature, {c} AS value FROM steps" for c in NUMERIC)


def one_hot(columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT entity_id, step, '{c}__' || label AS feature, CASE WHEN label = COALESCE((SELECT MAX(w.label)"
        f" FROM vocab w WHERE w.feature = '{c}' AND w.label = {c}), '<UNK>') THEN 1.0 ELSE 0.0 END AS value"
        f" FROM steps JOIN vocab ON feature = '{c}'" for c in columns)


BOTH = ("status", "priority")
SEQ = "WITH " + STEPS + ", vocab AS (" + vocab("visits", BOTH) + ")"
ORACLE |= {
    "seq_vocabulary": "WITH " + SEGMENTED + " " + vocab("segmented", ("status", "priority", "segment")),
    "seq_feature_names": "WITH " + VISITS + ", vocab AS (" + vocab("visits", BOTH) + """) SELECT
        CAST(ROW_NUMBER() OVER (ORDER BY part, slot) - 1 AS INTEGER) AS position, name FROM (
        SELECT 0 AS part, unnest([0, 1, 2, 3]) AS slot, unnest(['amount', 'quantity', 'n_lines', 'discount']) AS name
        UNION ALL SELECT CASE feature WHEN 'status' THEN 1 ELSE 2 END, slot, feature || '__' || label FROM vocab)""",
    "seq_long": SEQ + f" SELECT entity_id, step, feature, ROUND(value, 6) AS value FROM ({NUM_CELLS} UNION ALL {one_hot(BOTH)})",
    "seq_mask_lengths": """WITH n AS (SELECT o_custkey AS entity_id, CAST(LEAST(COUNT(*), 4) AS INTEGER) AS length
        FROM orders GROUP BY o_custkey), s AS (SELECT unnest([0, 1, 2, 3]) AS step)
        SELECT entity_id, length, step, CAST(step < length AS INTEGER) AS mask FROM n CROSS JOIN s""",
    "seq_padding": "WITH " + VISITS + ", vocab AS (" + vocab("visits", BOTH) + """), n AS (SELECT entity_id,
        4 - LEAST(COUNT(*), 4) AS pad FROM visits GROUP BY entity_id)
        SELECT entity_id, CAST(pad * (4 + (SELECT COUNT(*) FROM vocab)) AS BIGINT) AS n_cells, 0.0::DOUBLE AS total
        FROM n WHERE pad > 0""",
    "seq_length_stats": """WITH n AS (SELECT CAST(LEAST(COUNT(*), 4) AS INTEGER) AS length FROM orders
        GROUP BY o_custkey) SELECT COUNT(*) AS n_entities, MIN(length) AS length_min, MAX(length) AS length_max,
        CAST(MEDIAN(length) AS DOUBLE) AS length_median, ROUND(AVG(length), 6) AS length_mean FROM n""",
    "seq_unseen_labels": "WITH " + STEPS + ", vocab AS (" + vocab("visits", ("status",), "status <> 'P'") + ")"
        + f" SELECT entity_id, step, feature, CAST(value AS INTEGER) AS value FROM ({one_hot(('status',))})",
}

# --- splits --------------------------------------------------------------------------------

LABELED = """labeled AS (SELECT c_custkey AS entity_id, CAST(c_acctbal < 0 AS INTEGER) AS target FROM customer
  WHERE c_custkey IN (SELECT o_custkey FROM orders))"""


def shares(source: str, size: str, total: str, column: str, name: str, out: str) -> str:
    """Largest-remainder shares, one row per class."""
    return f""", q_{out} AS (SELECT *, {column} * ({size}) / CAST({total} AS DOUBLE) AS q FROM {source})
, {out} AS (SELECT * EXCLUDE (q), CAST(FLOOR(q) AS BIGINT) + CASE WHEN ROW_NUMBER() OVER (ORDER BY q - FLOOR(q) DESC, cls)
    <= ({size}) - SUM(FLOOR(q)) OVER () THEN 1 ELSE 0 END AS {name} FROM q_{out})"""


def stratified(cls: str) -> str:
    share = 0.15 / (0.70 + 0.15)
    return ("WITH " + LABELED + f""", drawn AS (SELECT *, {cls} AS cls, {u(42, 'entity_id')} AS u FROM labeled)
, sizes AS (SELECT cls, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS n_all FROM drawn GROUP BY cls)"""
            + shares("sizes", "CEIL(n_all * 0.15::DOUBLE)", "n_all", "n", "n_test", "s1")
            + ", s2 AS (SELECT *, n - n_test AS rest, SUM(n - n_test) OVER () AS rest_all FROM s1)"
            + shares("s2", f"CEIL(rest_all * CAST('{share!r}' AS DOUBLE))", "rest_all", "rest", "n_val", "s3")
            + """, placed AS (SELECT d.*, ROW_NUMBER() OVER (PARTITION BY cls ORDER BY u, entity_id) - 1 AS i FROM drawn d)
, split AS (SELECT entity_id, target, CASE WHEN i < n_test THEN 'test' WHEN i < n_test + n_val THEN 'validation'
    ELSE 'train' END AS split FROM placed JOIN s3 USING (cls))""")


STRATIFIED = stratified("target")
ORACLE |= {
    "split_candidates": "WITH " + LABELED + " SELECT * FROM labeled",
    "split_stratified": STRATIFIED + " SELECT * FROM split",
    "split_plain": stratified("0") + " SELECT * FROM split",
    "split_chronological": "WITH " + LABELED + """, f AS (SELECT l.entity_id, target, MIN(CAST(o_orderdate AS DATE)) AS first
        FROM labeled l JOIN orders ON o_custkey = l.entity_id GROUP BY ALL)
        , r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY first, entity_id) - 1 AS i, COUNT(*) OVER () AS n FROM f)
        , z AS (SELECT *, GREATEST(1, ROUND_EVEN(n * 0.7::DOUBLE, 0)) AS a,
            GREATEST(1, ROUND_EVEN(n * 0.15::DOUBLE, 0)) AS b FROM r)
        SELECT entity_id, target, CASE WHEN i < a THEN 'train' WHEN i < a + b THEN 'validation' ELSE 'test' END
        AS split FROM z""",
    "split_internal": "WITH " + LABELED + f""", drawn AS (SELECT *, target AS cls, {u(42, 'entity_id')} AS u FROM labeled)
        , sizes AS (SELECT cls, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS n_all FROM drawn GROUP BY cls)"""
        + shares("sizes", "GREATEST(1, LEAST(n_all - 1, ROUND_EVEN(n_all * 0.2::DOUBLE, 0)))", "n_all", "n", "n_val", "s1")
        + """, placed AS (SELECT d.*, ROW_NUMBER() OVER (PARTITION BY cls ORDER BY u, entity_id) - 1 AS i FROM drawn d)
        SELECT entity_id, target, CASE WHEN i < n_val THEN 'validation' ELSE 'train' END AS split
        FROM placed JOIN s1 USING (cls)""",
    "split_stats": STRATIFIED + """ SELECT split, COUNT(*) AS n_entities,
        ROUND(COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), 4) AS fraction,
        COUNT(*) FILTER (target = 1) AS n_positive, COUNT(*) FILTER (target = 0) AS n_negative,
        ROUND(COUNT(*) FILTER (target = 1) / COUNT(*), 4) AS positive_rate FROM split GROUP BY split""",
    "split_overlap": STRATIFIED + """ SELECT COUNT(*) AS n_overlap FROM (SELECT entity_id FROM split
        GROUP BY entity_id HAVING COUNT(DISTINCT split) > 1)""",
    "split_rows": STRATIFIED + """ SELECT split, COUNT(*) AS n_rows, COUNT(DISTINCT entity_id) AS n_entities
        FROM orders JOIN split ON entity_id = o_custkey GROUP BY split""",
}

# --- preprocessing ----------------------------------------------------------------------------

FEATURES = [f for f, _, _, _, k in CATALOGUE if k != "categorical"]


def fit(source: str, c: str, feature: str | None = None, where: str = "TRUE") -> str:
    return (f"SELECT '{feature or c}' AS feature, COALESCE(QUANTILE_CONT({c}, 0.5), 0.0) AS median,"
            f" COALESCE(AVG({c}), 0.0) AS mean, COALESCE(NULLIF(STDDEV_SAMP({c}), 0), 1.0) AS std"
            f" FROM {source} WHERE {where}")


def stats(body: str) -> str:
    return (" SELECT feature, ROUND(CAST(median AS DOUBLE), 6) AS median, ROUND(mean, 6) AS mean,"
            f" ROUND(std, 6) AS std FROM ({body})")


# unrounded features, so that statistics and scaled values are rounded once
RAW = WIDE
for _c in NUMERIC:
    RAW = RAW.replace(", 6) AS " + _c, ") AS " + _c)
RAW = RAW.replace("ROUND(", "(")
SCALED = ("amount_latest", "discount_std", "quantity_w4", "n_obs_visits")
ORACLE |= {
    "fit_numeric": "WITH " + RANKED + ", wide AS (" + RAW + ")" + stats(
        " UNION ALL ".join(fit("wide", f) for f in FEATURES)),
    "fit_categories": "WITH " + RANKED + """, wide AS (SELECT entity_id, ARG_MAX(status, rn) AS a,
        ARG_MAX(priority, rn) AS b, ARG_MAX(c_mktsegment, rn) AS c FROM ranked
        LEFT JOIN customer ON c_custkey = entity_id GROUP BY entity_id)
        SELECT DISTINCT 'status_latest' AS feature, a AS category FROM wide UNION ALL
        SELECT DISTINCT 'priority_latest', b FROM wide UNION ALL SELECT DISTINCT 'segment_latest', c FROM wide""",
    "transform_wide": STRATIFIED + ", " + RANKED + ", wide AS (" + RAW + ")"
        + ", train AS (SELECT * FROM wide WHERE entity_id IN (SELECT entity_id FROM split WHERE split = 'train'))"
        + "".join(f", f_{c} AS (" + fit("train", c) + ")" for c in SCALED)
        + " SELECT entity_id, " + ", ".join(
            f"ROUND((COALESCE({c}, f_{c}.median) - f_{c}.mean) / f_{c}.std, 6) AS {c}" for c in SCALED)
        + """, CAST(status_latest = 'F' AS DOUBLE) AS status_latest__F, CAST(status_latest = 'O' AS DOUBLE)
        AS status_latest__O, CAST(status_latest = 'P' AS DOUBLE) AS status_latest__P FROM wide"""
        + "".join(f" CROSS JOIN f_{c}" for c in SCALED),
    "transform_wide_full": STRATIFIED + ", " + RANKED + ", wide AS (" + RAW + ")"
        + ", train AS (SELECT * FROM wide WHERE entity_id IN (SELECT entity_id FROM split WHERE split = 'train'))"
        + ", f AS (" + " UNION ALL ".join(fit("train", c) for c in FEATURES) + "), cells AS ("
        + " UNION ALL ".join(f"SELECT entity_id, '{c}' AS name, CAST({c} AS DOUBLE) AS x FROM wide" for c in FEATURES)
        + """), scaled AS (SELECT entity_id, name, ROUND((COALESCE(x, median) - mean) / std, 6) AS value
        FROM cells JOIN f ON f.feature = name) SELECT * FROM scaled WHERE value <> 0"""
        + "".join(f""" UNION ALL SELECT entity_id, '{c}__' || {c}, 1.0::DOUBLE FROM wide
        WHERE {c} IN (SELECT {c} FROM train)""" for c in ("status_latest", "priority_latest")),
    "seq_fit_stats": "WITH " + STEPS + stats(" UNION ALL ".join(fit("steps", c) for c in NUMERIC)),
    "transform_seq_full": SEQ + ", f AS (" + " UNION ALL ".join(fit("steps", c) for c in NUMERIC) + ")"
        + f", cells AS ({NUM_CELLS})"
        + """ SELECT entity_id, step, feature, ROUND((COALESCE(value, median) - mean) / std, 6) AS value
        FROM cells JOIN f USING (feature) UNION ALL SELECT * FROM (""" + one_hot(BOTH) + ")",
    "transform_seq": "WITH " + STEPS + ", f AS (" + " UNION ALL ".join(fit("steps", c) for c in NUMERIC) + ")"
        + f", cells AS ({NUM_CELLS}), n AS (SELECT DISTINCT entity_id, LEAST(nv, 4) AS length FROM ranked)"
        + """ SELECT entity_id, step, 1 AS is_real, feature, ROUND((COALESCE(value, median) - mean) / std, 6) AS value
        FROM cells JOIN f USING (feature) UNION ALL
        SELECT entity_id, step, 0, feature, 0.0 FROM n CROSS JOIN (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS step)
        CROSS JOIN (SELECT feature FROM f) WHERE step >= length""",
}

# --- metrics ------------------------------------------------------------------------------------

PRED = """pred AS (SELECT l.doc_id, lang, source, quality AS y, n_chars / (n_chars + 5000.0::DOUBLE) AS p
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def curve(by: str = "") -> str:
    key, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return "WITH " + PRED + f""", c AS (SELECT {key}p, COUNT(*) FILTER (y = 1) AS pos, COUNT(*) FILTER (y = 0) AS neg
    FROM pred GROUP BY {key}p)
, k AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER ({part}) AS np, SUM(neg) OVER ({part}) AS nn
    FROM c WINDOW w AS ({part} ORDER BY p DESC))
, d AS (SELECT *, tp - pos AS tp0, fp - neg AS fp0 FROM k)"""


ROC = ("CASE WHEN MAX(np) > 0 AND MAX(nn) > 0 THEN SUM(neg * (tp0 + pos / 2.0::DOUBLE))"
       " / (CAST(MAX(np) AS DOUBLE) * CAST(MAX(nn) AS DOUBLE)) END")
PR = ("CASE WHEN MAX(np) > 0 AND MAX(nn) > 0 THEN SUM(pos / CAST(np AS DOUBLE) * (tp / CAST(tp + fp AS DOUBLE)"
      " + CASE WHEN tp0 = 0 THEN 1.0::DOUBLE ELSE tp0 / CAST(tp0 + fp0 AS DOUBLE) END) / 2.0::DOUBLE) END")


def cells(thr: float) -> str:
    return (f"COUNT(*) FILTER (p >= {thr} AND y = 1) AS tp, COUNT(*) FILTER (p >= {thr} AND y = 0) AS fp,"
            f" COUNT(*) FILTER (p < {thr} AND y = 0) AS tn, COUNT(*) FILTER (p < {thr} AND y = 1) AS fn")


def rate_columns(prefix: str = "") -> str:
    return f"""ROUND((tp + tn) / (tp + fp + tn + fn), 6) AS {prefix}accuracy,
    ROUND(tp / NULLIF(tp + fp, 0), 6) AS {prefix}precision, ROUND(tp / NULLIF(tp + fn, 0), 6) AS {prefix}recall,
    ROUND(tn / NULLIF(tn + fp, 0), 6) AS {prefix}specificity, ROUND(CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0
      THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS {prefix}f1"""


F1 = "WITH " + PRED + """, t AS (SELECT CAST(unnest(range(5, 100, 5)) AS DOUBLE) / 100 AS threshold)
, c AS (SELECT {key}threshold, COUNT(*) FILTER (p >= threshold AND y = 1) AS tp,
    COUNT(*) FILTER (p >= threshold AND y = 0) AS fp, COUNT(*) FILTER (p < threshold AND y = 1) AS fn
    FROM pred CROSS JOIN t GROUP BY {key}threshold)
, f AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1 FROM c)"""


def bins(n: int, by: str = "") -> str:
    key = f"{by}, " if by else ""
    groups = f"(SELECT DISTINCT {by} FROM pred) CROSS JOIN " if by else ""
    return "WITH " + PRED + f""", b AS (SELECT {key}CAST(LEAST(FLOOR(p * {n}), {n - 1}) AS INTEGER) AS bin, COUNT(*) AS cnt,
    AVG(p) AS mp, AVG(y) AS oy FROM pred GROUP BY ALL)
, bins AS (SELECT {key}bin, COALESCE(cnt, 0) AS cnt, mp, oy FROM {groups}(SELECT CAST(unnest(range(0, {n})) AS INTEGER) AS bin)
    LEFT JOIN b USING ({key}bin))"""


def bin_columns(n: int) -> str:
    return (f"bin, ROUND(bin / {n}.0::DOUBLE, 6) AS lower, ROUND((bin + 1) / {n}.0::DOUBLE, 6) AS upper,"
            " CAST(cnt AS BIGINT) AS count, ROUND(mp, 6) AS mean_predicted, ROUND(oy, 6) AS observed_frequency")


METRIC_NAMES = ("auroc", "auprc", "accuracy", "precision", "recall", "specificity", "f1", "brier", "TP", "FP",
                "TN", "FN", "threshold", "n_samples", "n_positive", "n_negative")


def metric_rows(prefix: str) -> str:
    return curve("lang") + f""", a AS (SELECT lang, {ROC} AS roc, {PR} AS pr FROM d GROUP BY lang)
, m AS (SELECT lang, {cells(0.3)}, AVG((y - p) * (y - p)) AS brier FROM pred GROUP BY lang)
, result AS (SELECT lang, ROUND(roc, 6) AS {prefix}auroc, ROUND(pr, 6) AS {prefix}auprc, {rate_columns(prefix)},
    ROUND(brier, 6) AS {prefix}brier, tp AS "{prefix}TP", fp AS "{prefix}FP", tn AS "{prefix}TN", fn AS "{prefix}FN",
    0.3::DOUBLE AS {prefix}threshold, tp + fp + tn + fn AS {prefix}n_samples, tp + fn AS {prefix}n_positive,
    tn + fp AS {prefix}n_negative FROM m JOIN a USING (lang))"""


ORACLE |= {
    "roc_points": curve() + """ SELECT p AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
        ROUND(tp / CAST(np AS DOUBLE), 6) AS tpr, ROUND(fp / CAST(nn AS DOUBLE), 6) AS fpr FROM d
        UNION ALL SELECT NULL, 0, 0, 0.0, 0.0""",
    "auroc": curve() + f" SELECT ROUND({ROC}, 6) AS auroc FROM d",
    "auroc_by_source": curve("source") + f" SELECT source, ROUND({ROC}, 6) AS auroc FROM d GROUP BY source",
    "pr_points": curve() + """ SELECT p AS threshold, ROUND(tp / CAST(tp + fp AS DOUBLE), 6) AS precision,
        ROUND(tp / CAST(np AS DOUBLE), 6) AS recall FROM d UNION ALL SELECT NULL, 1.0, 0.0""",
    "auprc": curve() + f" SELECT ROUND({PR}, 6) AS auprc FROM d",
    "confusion": "WITH " + PRED + f', m AS (SELECT lang, {cells(0.3)} FROM pred GROUP BY lang)'
        + ' SELECT lang, tp AS "TP", fp AS "FP", tn AS "TN", fn AS "FN" FROM m',
    "threshold_rates": "WITH " + PRED + f', m AS (SELECT source, {cells(0.3)} FROM pred GROUP BY source)'
        + f' SELECT source, tp AS "TP", fp AS "FP", tn AS "TN", fn AS "FN", {rate_columns()} FROM m',
    "brier": "WITH " + PRED + " SELECT lang, ROUND(AVG((y - p) * (y - p)), 6) AS brier FROM pred GROUP BY lang",
    "metric_row": metric_rows("val_") + " SELECT * FROM result",
    "f1_by_threshold": F1.format(key="") + " SELECT threshold, ROUND(f1, 6) AS f1 FROM f",
    "threshold_f1": F1.format(key="lang, ") + """ SELECT lang, threshold, ROUND(f1, 6) AS f1 FROM (SELECT *,
        ROW_NUMBER() OVER (PARTITION BY lang ORDER BY f1 DESC NULLS LAST, threshold) AS r FROM f) WHERE r = 1""",
    "reliability_bins": bins(10) + f" SELECT {bin_columns(10)} FROM bins",
    "reliability_bins_by_source": bins(5, "source") + f" SELECT source, {bin_columns(5)} FROM bins",
    "calibration_report": bins(10, "lang") + """ SELECT lang, 10 AS n_bins, CAST(SUM(cnt) AS BIGINT) AS n_samples,
        ROUND(SUM(cnt * ABS(oy - mp)) / SUM(cnt), 6) AS ece, ROUND(MAX(ABS(oy - mp)), 6) AS mce,
        CAST(ARG_MAX(bin, ABS(oy - mp)) AS INTEGER) AS mce_bin,
        CAST(ARG_MAX(cnt, ABS(oy - mp)) AS BIGINT) AS mce_bin_count FROM bins GROUP BY lang""",
    "class_weights": "WITH " + LABELED + """ SELECT target AS label, ROUND((SELECT COUNT(*) FROM labeled)
        / (2.0::DOUBLE * COUNT(*)), 6) AS weight, COUNT(*) AS n FROM labeled GROUP BY target""",
    "run_round_trip": "WITH " + VISITS + """, parts AS (SELECT 'timeline' AS part, * FROM visits UNION ALL
        SELECT 'observations', * FROM visits WHERE visit_date < DATE '1998-07-01')
        SELECT part, CAST(SUM(COUNT(*)) OVER (PARTITION BY part) AS BIGINT) AS n_rows, status, COUNT(*) AS n_visits,
        ROUND(MAX(amount), 6) AS highest, ROUND(SUM(n_lines), 6) AS n_lines, CAST(MAX(visit_date) AS VARCHAR) AS latest
        FROM parts GROUP BY part, status""",
    "run_records": metric_rows("") + " " + " UNION ALL ".join(
        f"""SELECT 'run_' || lang AS run_id, '{m}' AS metric, CAST("{m}" AS DOUBLE) AS value FROM result"""
        for m in METRIC_NAMES),
}

# --- explanation stability ---------------------------------------------------------------------------

SCORES = """a AS (SELECT l_partkey AS key, SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END) AS score
  FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_partkey)
, b AS (SELECT l_partkey AS key, SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END) AS score
  FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_partkey)"""


def top(source: str, k: int) -> str:
    return f"(SELECT key FROM {source} ORDER BY ABS(score) DESC, CAST(key AS VARCHAR) LIMIT {k})"


def jaccard(k: int) -> str:
    return (f"(SELECT COUNT(*) FROM (SELECT * FROM {top('a', k)} INTERSECT SELECT * FROM {top('b', k)}))"
            f" / CAST((SELECT COUNT(*) FROM (SELECT * FROM {top('a', k)} UNION SELECT * FROM {top('b', k)})) AS DOUBLE)")


AVG_RANK = "(RANK() OVER (ORDER BY {0}) + (COUNT(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE)"
RHO = "WITH " + SCORES + ", j AS (SELECT a.score AS sa, b.score AS sb FROM a JOIN b ON a.key = b.key)" + (
    f", r AS (SELECT {AVG_RANK.format('sa')} AS ra, {AVG_RANK.format('sb')} AS rb FROM j)")
ORACLE |= {
    "stability_top_k": "WITH " + SCORES + f" SELECT * FROM a WHERE key IN {top('a', 20)}",
    "topk_jaccard": "WITH " + SCORES + f" SELECT ROUND({jaccard(50)}, 6) AS topk_jaccard",
    "average_ranks": "WITH " + SCORES + f" SELECT key, score, {AVG_RANK.format('score')} AS rank FROM a",
    "spearman": RHO + " SELECT COUNT(*) AS shared_keys, ROUND(CORR(ra, rb), 6) AS spearman FROM r",
    "stability_report": RHO + f""" SELECT 25 AS k, COUNT(*) AS shared_keys, ROUND({jaccard(25)}, 6) AS topk_jaccard,
        ROUND(CORR(ra, rb), 6) AS spearman FROM r""",
    "ranking_scores": "WITH " + SCORES + """ SELECT key, CAST(COUNT(*) OVER () - ROW_NUMBER() OVER (ORDER BY score, key)
        + 1 AS DOUBLE) AS score FROM a""",
}

# --- sources, validation, profiles ------------------------------------------------------------------------

CHECKED = VISITS + """, checked AS (SELECT *, CASE WHEN status = 'P' THEN 2 WHEN status = 'F' THEN 1 ELSE 0 END AS target,
  CASE WHEN n_lines >= 7 THEN 'yes' WHEN n_lines >= 3 THEN 'no' WHEN n_lines >= 1 THEN 'few' END AS bulk FROM visits)
, dups AS (SELECT entity_id, visit_date, COUNT(*) AS n_rows FROM checked GROUP BY ALL HAVING COUNT(*) > 1)
, moved AS (SELECT DISTINCT entity_id FROM (SELECT entity_id, visit_date, LAG(visit_date) OVER (PARTITION BY entity_id
    ORDER BY visit_id) AS prev FROM checked) WHERE prev > visit_date)
, mixed AS (SELECT entity_id FROM checked GROUP BY entity_id HAVING COUNT(DISTINCT target) > 1)"""


def sample(source: str, key: str = "entity_id") -> str:
    return (f"(SELECT STRING_AGG(k, ',' ORDER BY k) FROM (SELECT CAST({key} AS VARCHAR) AS k FROM {source}"
            " ORDER BY k LIMIT 10))")


ORACLE |= {
    "load_csv": "WITH " + VISITS + """ SELECT CAST(entity_id AS VARCHAR) AS entity_id, visit_id,
        CAST(visit_date AS VARCHAR) AS visit_date, ROUND(CASE WHEN n_lines IS NOT NULL THEN amount END, 6) AS amount,
        quantity, n_lines, ROUND(discount, 6) AS discount, event_flag, status, priority FROM visits""",
    "trajectories_json": "WITH " + RANKED + """ SELECT CAST(entity_id AS VARCHAR) AS entity_id, visit_id,
        CAST(visit_date AS VARCHAR) AS visit_date, CAST(rn AS INTEGER) AS visit_number, ROUND(amount, 6) AS amount,
        quantity, CAST(NULL AS DOUBLE) AS n_lines, status, CAST(NULL AS VARCHAR) AS priority FROM ranked""",
    "findings": "WITH " + CHECKED + f""" SELECT 'warning' AS level, 'MISSING_EXPECTED_COL' AS code, CAST(2 AS BIGINT) AS n,
        'height,weight' AS details
        UNION ALL SELECT 'warning', 'LEAKAGE_CANDIDATE_COLUMNS', 1, 'target'
        UNION ALL SELECT 'error', 'DUPLICATE_PATIENT_DATE', CAST(SUM(n_rows) AS BIGINT), '' FROM dups
        UNION ALL SELECT 'warning', 'NON_CHRONOLOGICAL_ORDER', COUNT(*), {sample('moved')} FROM moved
        UNION ALL SELECT 'error', 'NON_BINARY_TARGET', 1, '2'
        UNION ALL SELECT 'error', 'INCONSISTENT_TARGET', COUNT(*), {sample('mixed')} FROM mixed
        UNION ALL SELECT 'warning', 'INVALID_BINARY_CATEGORICAL', 1, 'bulk'""",
    "duplicate_visits": "WITH " + CHECKED + " SELECT entity_id, CAST(visit_date AS VARCHAR) AS visit_date, n_rows FROM dups",
    "unordered_entities": "WITH " + CHECKED + " SELECT entity_id FROM moved",
    "inconsistent_targets": "WITH " + CHECKED + " SELECT entity_id FROM mixed",
    "invalid_yes_no": "WITH " + CHECKED + """ SELECT 'bulk' AS "column", bulk AS value, COUNT(*) AS n FROM checked
        WHERE bulk NOT IN ('yes', 'no') GROUP BY bulk""",
    "invalid_targets": "WITH " + CHECKED + """ SELECT CAST(target AS VARCHAR) AS value, COUNT(*) AS n FROM checked
        WHERE target NOT IN (0, 1) GROUP BY target""",
    "profile_counts": """WITH n AS (SELECT o_custkey, COUNT(*) AS k FROM orders GROUP BY o_custkey)
        SELECT (SELECT COUNT(*) FROM orders) AS n_rows, 10 AS n_columns, COUNT(*) AS n_entities, MIN(k) AS visits_min,
        MAX(k) AS visits_max, ROUND(AVG(k), 2) AS visits_mean, MEDIAN(k) AS visits_median,
        (SELECT CAST(CAST(MIN(o_orderdate) AS DATE) AS VARCHAR) FROM orders) AS date_min,
        (SELECT CAST(CAST(MAX(o_orderdate) AS DATE) AS VARCHAR) FROM orders) AS date_max FROM n""",
    "profile_numeric": "WITH " + VISITS + " " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT({c}) AS count, COUNT(*) - COUNT({c}) AS missing,
        ROUND((COUNT(*) - COUNT({c})) / COUNT(*), 4) AS missing_rate, ROUND(AVG({c}), 4) AS mean,
        ROUND(STDDEV_SAMP({c}), 4) AS std, ROUND(MIN({c}), 4) AS min, ROUND(QUANTILE_CONT({c}, 0.25), 4) AS p25,
        ROUND(QUANTILE_CONT({c}, 0.5), 4) AS median, ROUND(QUANTILE_CONT({c}, 0.75), 4) AS p75,
        ROUND(MAX({c}), 4) AS max FROM visits""" for c in NUMERIC),
    "profile_categorical": "WITH " + UNTIDY + """ SELECT 'status' AS "column", COUNT(DISTINCT status) AS n_unique,
        COUNT(*) - COUNT(status) AS missing, ROUND((COUNT(*) - COUNT(status)) / COUNT(*), 4) AS missing_rate FROM untidy""",
    "category_counts": "WITH " + UNTIDY + """ SELECT 'status' AS "column", status AS value, COUNT(*) AS n FROM untidy
        GROUP BY status""",
    "missingness": "WITH " + VISITS + " " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS n_missing,
        ROUND((COUNT(*) - COUNT({c})) / COUNT(*), 4) AS missing_rate FROM visits""" for c in NUMERIC[1:]),
    "target_distribution": """WITH f AS (SELECT o_custkey, ARG_MIN(CAST(o_orderstatus = 'F' AS INTEGER), o_orderkey) AS y
        FROM orders GROUP BY o_custkey) SELECT COUNT(*) FILTER (y = 1) AS n_positive, COUNT(*) FILTER (y = 0) AS n_negative,
        COUNT(*) FILTER (y IS NULL) AS n_unknown, ROUND(COUNT(*) FILTER (y = 1) / COUNT(y), 4) AS positive_rate FROM f""",
    "dataset_metadata": "WITH " + VISITS + ", " + LABELED + """ SELECT (SELECT COUNT(*) FROM labeled) AS n_entities,
        COUNT(*) AS n_visits, (SELECT ROUND(AVG(target), 4) FROM labeled) AS prevalence,
        ROUND((COUNT(*) * 4 - COUNT(amount) - COUNT(quantity) - COUNT(n_lines) - COUNT(discount)) / (COUNT(*) * 4), 4)
        AS missing_rate FROM visits""",
    "duplicate_count": "WITH " + CHECKED + " SELECT CAST(COALESCE(SUM(n_rows - 1), 0) AS BIGINT) AS n_duplicates FROM dups",
    "visits_per_entity": "SELECT o_custkey AS entity_id, COUNT(*) AS n_visits FROM orders GROUP BY o_custkey",
}

# --- perturbations --------------------------------------------------------------------------------------------


def kept(c: str) -> str:
    return f"{u(42, repr('remove_measurements'), 'entity_id', 'visit_date', 'visit_id', repr(c))} >= 0.3"


DROPPED = VISITS + f""", r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id
  ORDER BY {u(42, repr('remove_visits'), 'entity_id', 'visit_date', 'visit_id')}, visit_date, visit_id) - 1 AS i,
  COUNT(*) OVER (PARTITION BY entity_id) AS n FROM visits)
, left_over AS (SELECT * FROM r WHERE i >= LEAST(FLOOR(n * 0.4::DOUBLE), GREATEST(0, n - 2)))"""
FEATURE_COLUMNS = (*NUMERIC, "status", "priority")
ORACLE |= {
    "remove_measurements": "WITH " + VISITS + """ SELECT entity_id, visit_id, CAST(visit_date AS VARCHAR) AS visit_date,
        event_flag, """ + ", ".join(
            f"CASE WHEN {kept(c)} THEN {f'ROUND({c}, 6)' if c in NUMERIC else c} END AS {c}" for c in FEATURE_COLUMNS)
        + " FROM visits",
    "blanked_cells": "WITH " + VISITS + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, COUNT(*) AS cells_total, COUNT(*) FILTER (NOT {kept(c)}) AS cells_blanked FROM visits"
        for c in FEATURE_COLUMNS),
    "remove_visits": "WITH " + DROPPED + """ SELECT entity_id, visit_id, CAST(visit_date AS VARCHAR) AS visit_date
        FROM left_over""",
    "truncate_recent": "WITH " + RANKED + """ SELECT entity_id, visit_id, CAST(visit_date AS VARCHAR) AS visit_date
        FROM ranked WHERE rn > nv - 3""",
    "jitter_timing": "WITH " + VISITS + f""", m AS (SELECT *, LEAST(GREATEST(visit_date + CAST(FLOOR(
        {u(42, repr('jitter_visit_timing'), 'entity_id', 'visit_date', 'visit_id')} * 61) - 30 AS INTEGER),
        MIN(visit_date) OVER (PARTITION BY entity_id)), MAX(visit_date) OVER (PARTITION BY entity_id)) AS d FROM visits)
        SELECT entity_id, visit_id, CAST(MAX(d) OVER (PARTITION BY entity_id ORDER BY visit_date, visit_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR) AS visit_date FROM m""",
    "perturbation_summary": "WITH " + DROPPED + """ SELECT 'remove_visits' AS kind, 0.4::DOUBLE AS strength,
        'min_visits_kept=2;seed=42' AS params, (SELECT COUNT(DISTINCT entity_id) FROM visits) AS entities_before,
        COUNT(DISTINCT entity_id) AS entities_after, (SELECT COUNT(*) FROM visits) AS visits_before,
        COUNT(*) AS visits_after FROM left_over""",
}

# --- the visit table ----------------------------------------------------------------------------------------------

LOG = VISITS + """, log AS (
  SELECT visit_id * 10 AS seq, 'update' AS op, CASE WHEN visit_id % 13 = 0 THEN entity_id + 1 ELSE entity_id END AS entity_id,
    visit_id FROM visits
  UNION ALL SELECT visit_id * 10 + 1, 'delete', entity_id, visit_id FROM visits WHERE visit_id % 11 = 0
  UNION ALL SELECT visit_id * 10 + 2, 'update', entity_id, -visit_id FROM visits WHERE visit_id % 17 = 0)"""
ORACLE |= {
    "register_patients": """WITH known AS (SELECT c_custkey AS id, 'C' || c_custkey AS entity_id FROM customer
        WHERE c_custkey % 5 = 0), fresh AS (SELECT DISTINCT 'C' || o_custkey AS entity_id FROM orders
        WHERE 'C' || o_custkey NOT IN (SELECT entity_id FROM known))
        SELECT * FROM known UNION ALL SELECT (SELECT MAX(id) FROM known) + ROW_NUMBER() OVER (ORDER BY entity_id),
        entity_id FROM fresh""",
    "visit_history": "WITH " + RANKED + """ SELECT entity_id, visit_id, CAST(visit_date AS VARCHAR) AS visit_date,
        ROUND(amount, 6) AS amount, CAST(rn AS INTEGER) AS visit_number FROM ranked
        WHERE entity_id IN (SELECT c_custkey FROM customer)""",
    "apply_visit_changes": "WITH " + VISITS + """, v AS (SELECT *, visit_id % 13 <> 0 AS owned FROM visits
        WHERE visit_id % 11 <> 0)
        SELECT entity_id, visit_id, CAST(visit_date AS VARCHAR) AS visit_date,
        ROUND(CASE WHEN owned AND visit_id % 2 = 0 THEN amount + 1000 ELSE amount END, 6) AS amount,
        CASE WHEN owned AND visit_id % 2 = 1 THEN 'X' ELSE status END AS status,
        CASE WHEN owned AND visit_id % 2 = 0 THEN NULL ELSE priority END AS priority FROM v
        UNION ALL SELECT entity_id, visit_id + 1000000000, '2002-01-01', NULL, 'N', NULL FROM visits
        WHERE visit_id % 19 = 0""",
    "rejected_changes": "WITH " + LOG + """ SELECT seq, op, l.entity_id, l.visit_id,
        CASE WHEN v.visit_id IS NULL THEN 'unknown_visit' WHEN v.entity_id <> l.entity_id THEN 'not_owner'
          ELSE 'unknown_visit' END AS reason
        FROM log l LEFT JOIN visits v ON v.visit_id = l.visit_id
        WHERE v.visit_id IS NULL OR v.entity_id <> l.entity_id
          OR (v.visit_id % 11 = 0 AND l.seq > v.visit_id * 10 + 1)  -- changed after its deletion""",
    "select_visits": "WITH " + VISITS + """, wanted AS (SELECT entity_id, visit_id FROM visits UNION ALL
        SELECT CASE WHEN entity_id % 7 = 0 THEN entity_id ELSE entity_id + 1 END,
          CASE WHEN entity_id % 7 = 0 THEN -MIN(visit_id) ELSE MIN(visit_id) END FROM visits
        WHERE entity_id % 7 = 0 OR entity_id % 5 = 0 GROUP BY entity_id)
        , f AS (SELECT w.*, v.entity_id AS owner, v.visit_date FROM wanted w LEFT JOIN visits v ON v.visit_id = w.visit_id)
        , s AS (SELECT entity_id, CASE WHEN BOOL_OR(owner IS NULL) THEN 'unknown_visit'
            WHEN BOOL_OR(owner <> entity_id) THEN 'not_owner' WHEN COUNT(*) > 10 THEN 'too_many' ELSE 'ok' END AS status
            FROM f GROUP BY entity_id)
        SELECT f.entity_id, visit_id, CAST(visit_date AS VARCHAR) AS visit_date, status FROM f JOIN s USING (entity_id)""",
}


# --- undefined values, and a scorer with fixed coefficients ----------------------------------------

GAPS = "(SELECT * REPLACE (CASE WHEN visit_id % 5 = 0 THEN NULL ELSE amount END AS amount) FROM visits)"
SCORED = OBSERVED + ", w AS (" + grouped("kept", summaries("amount"), summaries("quantity"), COUNT) + """)
, x AS (SELECT w.entity_id, COALESCE(amount_latest / 150000.0::DOUBLE, 0.0) AS x0, COALESCE(amount_std / 80000.0::DOUBLE, 0.0) AS x1,
    COALESCE(quantity_mean / 100.0::DOUBLE, 0.0) AS x2, n_obs_visits / 4.0::DOUBLE AS x3, hit AS label
    FROM w JOIN facts USING (entity_id) WHERE status = 'eligible')
, z AS (SELECT *, -0.4::DOUBLE + 0.9::DOUBLE * x0 - 0.7::DOUBLE * x1 + 0.35::DOUBLE * x2 - 0.25::DOUBLE * x3 AS z FROM x)
, s AS (SELECT *, 1 / (1 + EXP(-z)) AS p FROM z)"""
FIXED_FEATURES = [("amount_latest", "x0", 0.9, "Amount (latest)"), ("amount_std", "x1", -0.7, "Amount (std dev)"),
                  ("quantity_mean", "x2", 0.35, "Quantity (mean)"),
                  ("n_obs_visits", "x3", -0.25, "Number of Observation Visits")]
PARTS = SCORED + ", parts AS (" + " UNION ALL ".join(
    f"SELECT entity_id, '{f}' AS feature, '{name}' AS readable_name, {x} AS value, p,"
    f" p - 1 / (1 + EXP(-(z - {w}::DOUBLE * {x}))) AS contribution FROM s" for f, x, w, name in FIXED_FEATURES) + ")"
NUMERIC_NAMES = {"latest": "(latest)", "mean": "(mean)", "min": "(minimum)", "max": "(maximum)", "std": "(std dev)",
                 "delta": "(change / delta)", "slope": "(trend / slope)",
                 **{f"w{k}": f"at wave {k}" for k in range(1, 5)}}

ORACLE |= {
    "auroc_undefined_scores": curve("lang").replace(
        "FROM pred GROUP", "FROM (SELECT * FROM pred WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 0) GROUP")
        + f" SELECT lang, ROUND({ROC}, 6) AS auroc, ROUND({PR}, 6) AS auprc FROM d GROUP BY lang",
    "undefined_scores": "WITH " + PRED + """ SELECT lang, COUNT(*) AS n_rows,
        COUNT(*) FILTER (doc_id % 10 = 0 OR doc_id % 7 = 0) AS n_no_score,
        COUNT(*) FILTER (y IS NULL OR y NOT IN (0, 1)) AS n_no_label FROM pred GROUP BY lang""",
    "wide_nan_input": "WITH " + RANKED.replace("FROM visits WINDOW", f"FROM {GAPS} WINDOW")
        + grouped("ranked", summaries("amount")),
    "fit_numeric_nan": "WITH " + VISITS + f", gap AS {GAPS}" + stats(
        fit("gap", "amount") + " UNION ALL " + fit("gap", "quantity")),
    "cohort_numeric_flag": FLAGGED + OUTCOME,
    "score_fixed": SCORED + """ SELECT entity_id, ROUND(p, 6) AS p, CAST(p >= 0.5 AS INTEGER) AS prediction, label FROM s""",
    "score_fixed_metrics": SCORED + """
        SELECT ROUND((SELECT SUM(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END)
            / (COUNT(DISTINCT a.entity_id) * COUNT(DISTINCT b.entity_id)) FROM s a, s b
            WHERE a.label = 1 AND b.label = 0), 6) AS auroc,
        ROUND(AVG((label - p) * (label - p)), 6) AS brier,
        ROUND(AVG(CAST(CAST(p >= 0.5 AS INTEGER) = label AS INTEGER)), 6) AS accuracy FROM s""",
    "ablation_fixed": PARTS + """ SELECT entity_id, feature, ROUND(value, 6) AS value,
        ROUND(contribution, 6) AS contribution,
        CASE WHEN contribution > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction FROM parts""",
    "explanation_records_fixed": PARTS + """ SELECT entity_id, ROUND(p, 6) AS probability,
        CAST(p >= 0.5 AS INTEGER) AS predicted_class, 0.5::DOUBLE AS threshold, feature, readable_name,
        ROUND(contribution, 6) AS contribution FROM parts""",
    "feature_names": "WITH " + RANKED + ", cats AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, ARG_MAX({v}, rn) AS v FROM ranked LEFT JOIN customer ON c_custkey = entity_id GROUP BY entity_id"
        for c, v in (("status", "status"), ("priority", "priority"), ("segment", "c_mktsegment"))) + ")"
        + " SELECT DISTINCT c || '_latest__' || v AS feature, upper(c[1]) || c[2:] || ' (most recent) = ' || v"
        " AS readable_name FROM cats UNION ALL SELECT 'n_obs_visits', 'Number of Observation Visits'"
        + "".join(f" UNION ALL SELECT '{c}_{k}', '{c.replace('_', ' ').title()} {text}'"
                  for c in NUMERIC for k, text in NUMERIC_NAMES.items()),
}

# --- the store, the real artifact and undefined scores ----------------------------------------------

WEIGHTS = {"amount_latest": 0.8, "amount_delta": -0.3, "quantity_mean": 0.5, "n_obs_visits": -0.6}
GAPPY = "WITH " + PRED[:-1] + " WHERE l.doc_id % 10 <> 0 AND l.doc_id % 7 <> 0)"


def artifact_score(source: str) -> str:
    """CTEs ``fs`` (statistics of all wide rows) and ``scored`` (entity_id, n, p) of the rows of ``source``."""
    raw = [x.replace("ROUND(", "(").replace(", 6) AS", ") AS") for c in ("amount", "quantity") for x in summaries(c)]
    wide = grouped("{0}", raw, CATS, ["COUNT(*) AS n_obs_visits"])
    return (", base AS (" + wide.format("ranked") + "), fs AS (SELECT * FROM ("
            + " UNION ALL ".join(fit("base", c) for c in WEIGHTS) + ")), own AS (" + wide.format(source) + ")"
            + ", z AS (SELECT entity_id, n_obs_visits, 0.1 " + "".join(
                f" + {w} * (COALESCE({c}, (SELECT median FROM fs WHERE feature = '{c}')) - (SELECT mean FROM fs WHERE"
                f" feature = '{c}')) / (SELECT std FROM fs WHERE feature = '{c}')" for c, w in WEIGHTS.items())
            + """ + CASE status_latest WHEN 'F' THEN 0.4 WHEN 'P' THEN -0.9 ELSE 0.0 END
            + CASE priority_latest WHEN '1-URGENT' THEN 0.25 ELSE 0.0 END AS z FROM own)
            , scored AS (SELECT entity_id, CAST(n_obs_visits AS INTEGER) AS n_visits, 1 / (1 + EXP(-z)) AS p FROM z)""")


ORACLE |= {
    "store_changes": ORACLE["apply_visit_changes"],
    "store_rejected": ORACLE["rejected_changes"],
    "store_history": ORACLE["visit_history"],
    "confusion_undefined_scores": GAPPY + f', m AS (SELECT source, {cells(0.3)} FROM pred GROUP BY source)'
        + f' SELECT source, tp AS "TP", fp AS "FP", tn AS "TN", fn AS "FN", {rate_columns()} FROM m',
    "brier_undefined_scores": GAPPY + " SELECT lang, ROUND(AVG((y - p) * (y - p)), 6) AS brier FROM pred GROUP BY lang",
    "f1_undefined_scores": F1.format(key="lang, ").replace("WITH " + PRED, GAPPY) + """ SELECT lang, threshold, ROUND(f1, 6) AS f1
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY f1 DESC NULLS LAST, threshold) AS r FROM f) WHERE r = 1""",
    "score_batch_fixed": "WITH " + RANKED + artifact_score("ranked") + """ SELECT entity_id, n_visits, ROUND(p, 6) AS p,
        CAST(p >= 0.5 AS INTEGER) AS prediction FROM scored""",
    "score_selection_fixed": "WITH " + RANKED + """, asked AS (SELECT entity_id AS request,
            CASE entity_id % 11 WHEN 3 THEN -entity_id WHEN 4 THEN entity_id + 1 ELSE entity_id END AS who,
            CASE entity_id % 11 WHEN 0 THEN [] WHEN 1 THEN list(-visit_id) WHEN 2 THEN list(visit_id)
              ELSE (list(visit_id ORDER BY visit_id))[1:4] END AS ids FROM visits GROUP BY entity_id)
        , items AS (SELECT request, who, unnest(ids) AS visit_id FROM asked)
        , met AS (SELECT i.request, i.who, i.visit_id AS wanted, v.* FROM items i LEFT JOIN visits v ON v.visit_id = i.visit_id)
        , per AS (SELECT request, BOOL_OR(entity_id IS NULL) AS lost, BOOL_OR(entity_id <> who) AS foreign_ FROM met GROUP BY request)
        , judged AS (SELECT a.request, a.who, len(ids) AS n, CASE WHEN len(ids) = 0 THEN 'empty_selection'
              WHEN who NOT IN (SELECT c_custkey FROM customer) THEN 'unknown_patient' WHEN lost THEN 'unknown_visit'
              WHEN foreign_ THEN 'not_owner' WHEN len(ids) > 4 THEN 'too_many' ELSE 'ok' END AS status
            FROM asked a LEFT JOIN per p ON p.request = a.request)
        , chosen AS (SELECT m.* REPLACE (m.request AS entity_id), ROW_NUMBER() OVER (PARTITION BY m.request
              ORDER BY visit_date, visit_id) AS rn FROM met m JOIN judged j ON j.request = m.request WHERE j.status = 'ok')
        , listed AS (SELECT request, string_agg(visit_id, ',' ORDER BY rn) AS visit_ids,
              string_agg(CAST(visit_date AS VARCHAR), ',' ORDER BY rn) AS dates FROM chosen GROUP BY request)"""
        + artifact_score("chosen") + """ SELECT j.request, CAST(who AS VARCHAR) AS entity_id, CAST(n AS INTEGER) AS n_visits, status,
        visit_ids, dates, ROUND(p, 6) AS p, CAST(p >= 0.5 AS INTEGER) AS prediction
        FROM judged j LEFT JOIN listed l ON l.request = j.request LEFT JOIN scored s ON s.entity_id = j.request""",
}

# --- refused records and untidy tables ----------------------------------------------------------------

UNTIDY_CHECKED = "WITH " + CHECKED[:CHECKED.index(", dups AS")] + """, u AS (SELECT visit_id, target, bulk,
  CASE WHEN visit_id % 37 = 0 THEN ' NaN ' ELSE CAST(entity_id AS VARCHAR) END AS entity_id,
  CASE WHEN visit_id % 41 = 0 THEN 'no date' ELSE CAST(visit_date AS VARCHAR) END AS visit_date FROM checked)
, dups AS (SELECT entity_id, visit_date, COUNT(*) AS n_rows FROM u GROUP BY ALL HAVING COUNT(*) > 1)
, moved AS (SELECT DISTINCT entity_id FROM (SELECT entity_id, TRY_CAST(visit_date AS DATE) AS d,
    MAX(TRY_CAST(visit_date AS DATE)) OVER (PARTITION BY entity_id ORDER BY visit_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM u) WHERE latest > d)
, mixed AS (SELECT entity_id FROM u GROUP BY entity_id HAVING COUNT(DISTINCT target) > 1)"""
BAD_NUMBER = "(o_orderkey % 13 = 0 OR o_orderkey % 29 = 0)"
ORACLE |= {
    "findings_untidy": UNTIDY_CHECKED + f""" SELECT 'warning' AS level, 'MISSING_EXPECTED_COL' AS code,
        CAST(1 AS BIGINT) AS n, 'height' AS details
        UNION ALL SELECT 'warning', 'LEAKAGE_CANDIDATE_COLUMNS', 2, 'target,outcome_later'
        UNION ALL SELECT 'error', 'EMPTY_PATIENT_ID', COUNT(*), '' FROM u WHERE visit_id % 37 = 0
        UNION ALL SELECT 'error', 'INVALID_VISIT_DATE', COUNT(*), '' FROM u WHERE visit_id % 41 = 0
        UNION ALL SELECT 'warning', 'DUPLICATE_PATIENT_DATE', CAST(SUM(n_rows) AS BIGINT), '' FROM dups
        UNION ALL SELECT 'warning', 'NON_CHRONOLOGICAL_ORDER', COUNT(*), {sample('moved')} FROM moved
        UNION ALL SELECT 'error', 'NON_BINARY_TARGET', 1, '2'
        UNION ALL SELECT 'warning', 'INCONSISTENT_TARGET', COUNT(*), {sample('mixed')} FROM mixed
        UNION ALL SELECT 'warning', 'INVALID_BINARY_CATEGORICAL', 1, 'bulk'""",
    "findings_missing_columns": "WITH " + CHECKED + f""" SELECT 'error' AS level, 'MISSING_REQUIRED_COL' AS code,
        CAST(1 AS BIGINT) AS n, 'visit_date' AS details
        UNION ALL SELECT 'warning', 'LEAKAGE_CANDIDATE_COLUMNS', 1, 'target'
        UNION ALL SELECT 'error', 'NON_BINARY_TARGET', 1, '2'
        UNION ALL SELECT 'error', 'INCONSISTENT_TARGET', COUNT(*), {sample('mixed')} FROM mixed
        UNION ALL SELECT 'warning', 'INVALID_BINARY_CATEGORICAL', 1, 'bulk'""",
    "load_csv_rejects": f"""SELECT * FROM (SELECT o_orderkey AS visit_id, concat_ws(',',
            CASE WHEN o_orderkey % 23 = 0 THEN 'malformed' END, CASE WHEN o_orderkey % 17 = 0 THEN 'empty_id' END,
            CASE WHEN o_orderkey % 19 = 0 THEN 'unreadable_date' END,
            CASE WHEN {BAD_NUMBER} THEN 'unreadable_number:amount' END) AS reasons FROM orders) WHERE reasons <> ''""",
    "load_csv_accepted": f"""SELECT o_orderkey AS visit_id, CAST(o_custkey AS VARCHAR) AS entity_id,
        CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS visit_date,
        CASE WHEN NOT {BAD_NUMBER} THEN ROUND(o_totalprice, 6) END AS amount, o_orderstatus AS status FROM orders
        WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0""",
    "trajectory_rejects": """SELECT * FROM (SELECT o_custkey AS entity_id, CASE WHEN o_custkey % 17 = 0 THEN 'no_visits' ELSE
            concat_ws(',', CASE WHEN o_custkey % 7 = 0 AND BOOL_OR(o_orderkey % 2 = 0) THEN 'undated' END,
              CASE WHEN o_custkey % 11 = 0 THEN 'forbidden' WHEN o_custkey % 13 = 0 THEN 'nobody' END) END AS reasons
        FROM orders GROUP BY o_custkey) WHERE reasons <> ''""",
    "trajectories_accepted": """SELECT CAST(o_custkey AS VARCHAR) AS entity_id, o_orderkey AS visit_id,
        CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS visit_date, ROUND(o_totalprice, 6) AS amount, o_orderstatus AS status
        FROM orders WHERE o_custkey % 17 <> 0 AND o_custkey % 11 <> 0 AND o_custkey % 13 <> 0
        AND NOT (o_custkey % 7 = 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0))""",
}

# --- permutation importance of the fixed scorer ---------------------------------------------------------


def area(source: str, key: str) -> str:
    """AUROC per ``key`` of (key, label, p), by average ranks."""
    part = f"PARTITION BY {key} " if key else ""
    return f"""SELECT {key + ', ' if key else ''}(SUM(rk) FILTER (label = 1) - COUNT(*) FILTER (label = 1)
        * (COUNT(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / (COUNT(*) FILTER (label = 1) * COUNT(*) FILTER (label = 0)) AS auc
        FROM (SELECT *, RANK() OVER ({part}ORDER BY p) + (COUNT(*) OVER (PARTITION BY {key + ', ' if key else ''}p) - 1)
          / 2.0::DOUBLE AS rk FROM {source}) {'GROUP BY ' + key if key else ''}"""


TURNED = [f"SELECT r, {j} AS j, label, -0.4 + " + " + ".join(
    f"({w}::DOUBLE * {'y' if i == j else 'x'}{i})" for i, (_, _, w, _) in enumerate(FIXED_FEATURES)) + " AS z FROM met"
    for j in range(4)]
ORACLE["permutation_fixed"] = SCORED + f""", ring AS (SELECT *, ROW_NUMBER() OVER (ORDER BY u, entity_id) - 1 AS i,
    COUNT(*) OVER () AS n FROM (SELECT x.*, {u(42, "'order'", 'entity_id')} AS u FROM x))
, turns AS (SELECT r, 1 + CAST(FLOOR({u(42, "'shift'", 'r')} * GREATEST((SELECT COUNT(*) FROM ring) - 1, 1)) AS BIGINT) AS by_
    FROM (SELECT unnest([1, 2, 3]) AS r))
, met AS (SELECT r, a.label, a.x0, a.x1, a.x2, a.x3, b.x0 AS y0, b.x1 AS y1, b.x2 AS y2, b.x3 AS y3
    FROM turns CROSS JOIN ring b JOIN ring a ON a.i = (b.i + by_) % b.n)
, turned AS (SELECT r, j, label, 1 / (1 + EXP(-z)) AS p FROM ({' UNION ALL '.join(TURNED)}))
, base AS ({area('s', '')}), after AS ({area('turned', 'r, j')})
SELECT (['amount_latest', 'amount_std', 'quantity_mean', 'n_obs_visits'])[j + 1] AS feature,
    ROUND(AVG((SELECT auc FROM base) - auc), 6) AS importance FROM after GROUP BY j"""
