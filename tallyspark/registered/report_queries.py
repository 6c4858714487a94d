"""Term and entity resolution, batch ledger, evaluation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import evalstats as ev
from tallyspark.operators import resolve as rs
from tallyspark.plans.metrics import standard_registry
from tallyspark.registered.base import on_warehouse, register, table
from tallyspark.sources.ledger import batch_state

# terms --------------------------------------------------------------------------------

# said by the user -> (status, metric or None, candidates or None)
_TERMS = {
    " Revenue ": ("resolved", "gross_sales", None),
    "total_orders": ("resolved", "number_of_orders", None),
    "NET   SALES": ("resolved", "net_sales", None),
    "earnings": ("ambiguous", None, ["gross_sales", "net_sales"]),
    "earn": ("ambiguous", None, ["gross_business_margin", "gross_sales", "net_sales"]),
    "income": ("ambiguous", None, ["gross_business_margin", "net_sales"]),
    "cash in": ("resolved", "cash_in", None),
    "money left": ("resolved", "cash_out", None),
    "footfall": ("not_found", None, None),
    "  ": ("invalid", None, None),
    "Total_Returns": ("resolved", "total_returns", None),
}
# what users say stands in the parts: a known phrase, written in several ways, for some, the part's own name for the others
_WRITTEN = "CASE p_size % 4 WHEN 0 THEN upper({0}) WHEN 1 THEN lower({0}) WHEN 2 THEN '  ' || replace({0}, ' ', '_') || ' ' ELSE {0} END"


def _said(terms) -> str:
    phrase = "CASE p_partkey % 13 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(terms)) + " END"
    return f"CASE WHEN p_partkey % 13 < {len(terms)} THEN {_WRITTEN.format(f'({phrase})')} ELSE p_name END"


def _pick(values, otherwise: str = "NULL") -> str:
    cases = " ".join(f"WHEN {i} THEN {v or 'NULL'}" for i, v in enumerate(values))
    return f"CASE p_partkey % 13 {cases} ELSE {otherwise} END"


_SAID = _said(_TERMS)
# two blanks written with underscores are a term that nobody knows, not a missing one
_STATUS = _pick(
    ["CASE WHEN p_size % 4 = 2 THEN 'not_found' ELSE 'invalid' END" if t == "  " else f"'{v[0]}'" for t, v in _TERMS.items()], "'not_found'"
)
register(
    "resolve_metric_terms",
    lambda spark, folder: rs.resolve_metrics(
        table("part")(spark, folder).selectExpr("p_partkey", f"{_SAID} AS term"), "term",
        rs.metric_vocabulary(spark, standard_registry()),
    ).select("p_partkey", "status", "resolved", F.array_join("candidates", ", ").alias("candidates")),
    f"""SELECT p_partkey, {_STATUS} AS status,
  {_pick([f"'{v[1]}'" if v[1] else None for v in _TERMS.values()])} AS resolved,
  {_pick([f"'{', '.join(v[2])}'" if v[2] else None for v in _TERMS.values()])} AS candidates FROM part""",
)

_ALLOWED = ("customer_id", "customer_name", "product_name", "product_category", "location_name")
_DIM_TERMS = {
    "customer": ("resolved", "customer_name"), "Buyer": ("resolved", "customer_name"),
    "Product Category": ("resolved", "product_category"), "branch": ("resolved", "location_name"),
    "vendor": ("invalid", None), "supplier_name": ("invalid", None), "weather": ("not_found", None), "": ("invalid", None),
    "customer_id": ("resolved", "customer_id"), "SKU": ("resolved", "product_name"), "paid_by": ("invalid", None),
}
_DIM_SAID = _said(_DIM_TERMS)
register(
    "resolve_dimension_terms",
    lambda spark, folder: rs.resolve_dimensions(
        table("part")(spark, folder).selectExpr("p_partkey", f"{_DIM_SAID} AS term"), "term",
        rs.dimension_vocabulary(spark, standard_registry()), _ALLOWED,
    ).select("p_partkey", "status", "resolved"),
    f"""SELECT p_partkey, {_pick([f"'{v[0]}'" for v in _DIM_TERMS.values()], "'not_found'")} AS status,
  {_pick([f"'{v[1]}'" if v[1] else None for v in _DIM_TERMS.values()])} AS resolved FROM part""",
)


def _issues(spark, folder):
    said = table("part")(spark, folder).selectExpr("p_partkey", f"{_SAID} AS term", f"{_DIM_SAID} AS dim")
    registry = standard_registry()
    metrics = rs.resolve_metrics(said, "term", rs.metric_vocabulary(spark, registry))
    dims = rs.resolve_dimensions(said, "dim", rs.dimension_vocabulary(spark, registry), _ALLOWED)
    issues = rs.collect_issues(("metric", metrics, "term"), ("dimension", dims, "dim"))
    return issues.groupBy("position", "kind", "status").agg(F.count("*").alias("issues"))


register(
    "resolution_issues",
    _issues,
    f"""SELECT position, kind, status, count(*) AS issues FROM (
SELECT 0 AS position, 'metric' AS kind, {_STATUS} AS status FROM part
UNION ALL SELECT 1, 'dimension', {_pick([f"'{v[0]}'" for v in _DIM_TERMS.values()], "'not_found'")} FROM part)
WHERE status <> 'resolved' GROUP BY position, kind, status""",
)

# entity names ---------------------------------------------------------------------------

# spellings of part names found among the parts: exact, part of a name, longer than a name, unknown
_SPELLING = """CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN 'the ' || p_name || ' one'
WHEN 3 THEN replace(p_name, ' ', '_') ELSE 'no such ' || p_brand END"""


def _product_directory(w):
    """Product names by the smallest part that bears them."""
    return w["part"].groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("string").alias("id"))


register(
    "resolve_entities",
    on_warehouse(
        lambda w: rs.resolve_entities(
            w["part"].selectExpr("p_partkey", f"{_SPELLING} AS said"), "said", _product_directory(w)
        ).select("p_partkey", "status", "resolved", "match_count")
    ),
    f"""WITH d AS (SELECT p_name AS name, CAST(min(p_partkey) AS VARCHAR) AS id, lower(p_name) AS n FROM part GROUP BY p_name),
v AS (SELECT p_partkey, lower(replace({_SPELLING}, '_', ' ')) AS v FROM part),
m AS (SELECT v, count(*) FILTER (v = n) AS exact_n, count(*) AS all_n, min(id) FILTER (v = n) AS exact_id, min(id) AS any_id
  FROM (SELECT DISTINCT v FROM v), d WHERE contains(n, v) OR contains(v, n) GROUP BY v)
SELECT p_partkey, CASE WHEN all_n IS NULL THEN 'not_found' WHEN exact_n = 1 OR (exact_n = 0 AND all_n = 1) THEN 'resolved'
  ELSE 'ambiguous' END AS status,
  CASE WHEN exact_n = 1 THEN exact_id WHEN exact_n = 0 AND all_n = 1 THEN any_id END AS resolved,
  coalesce(CASE WHEN exact_n > 0 THEN exact_n ELSE all_n END, 0) AS match_count
FROM v LEFT JOIN m USING (v)""",
)
# customer names are digits but for their first letters: exact, without leading letters, cut at the end, and unknown
_CALLED = """CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN substr(c_name, 10) WHEN 2 THEN substr(c_name, 1, length(c_name) - 1)
ELSE 'no ' || c_name || '0' END"""
register(
    "resolve_customer_names",
    lambda spark, folder: rs.resolve_entities(
        table("customer")(spark, folder).selectExpr("c_custkey", f"{_CALLED} AS said"), "said",
        table("customer")(spark, folder).select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")),
    ).select("c_custkey", "status", "resolved", "match_count"),
    f"""WITH d AS (SELECT CAST(c_custkey AS VARCHAR) AS id, lower(c_name) AS n FROM customer),
v AS (SELECT c_custkey, lower({_CALLED}) AS v FROM customer),
m AS (SELECT v, count(*) FILTER (v = n) AS exact_n, count(*) AS all_n, min(id) FILTER (v = n) AS exact_id, min(id) AS any_id
  FROM (SELECT DISTINCT v FROM v), d WHERE contains(n, v) OR contains(v, n) GROUP BY v)
SELECT c_custkey, CASE WHEN all_n IS NULL THEN 'not_found' WHEN exact_n = 1 OR (exact_n = 0 AND all_n = 1) THEN 'resolved'
  ELSE 'ambiguous' END AS status,
  CASE WHEN exact_n = 1 THEN exact_id WHEN exact_n = 0 AND all_n = 1 THEN any_id END AS resolved,
  coalesce(CASE WHEN exact_n > 0 THEN exact_n ELSE all_n END, 0) AS match_count
FROM v LEFT JOIN m USING (v)""",
)
register(
    "entity_matches",
    on_warehouse(
        lambda w: rs.entity_matches(
            w["nation"].selectExpr("CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE replace(n_name, 'NATION_', 'in nation ') || ' now' END AS said"),
            "said", w["nation"].select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")),
        ).select("v", "id", "exact")
    ),
    """WITH d AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, lower(replace(n_name, '_', ' ')) AS n FROM nation),
v AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN lower(replace(n_name, '_', ' '))
  ELSE lower(replace(n_name, 'NATION_', 'in nation ') || ' now') END AS v FROM nation)
SELECT v, id, v = n AS exact FROM v, d WHERE contains(n, v) OR contains(v, n)""",
)
register(
    "resolve_value_lists",
    on_warehouse(
        lambda w: rs.resolve_value_list(
            rs.resolve_entities(
                w["customer"].select(
                    (F.col("c_custkey") % 40).alias("list_id"),
                    F.expr("CASE WHEN c_custkey % 40 < 30 THEN 'NATION_' || CAST(c_nationkey AS STRING) ELSE c_mktsegment END").alias("said"),
                ),
                "said", w["nation"].select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")),
            ),
            "list_id",
        )
    ),
    """SELECT c_custkey % 40 AS list_id, c_custkey % 40 < 30 AS all_resolved,
  count(*) FILTER (c_custkey % 40 >= 30) AS open_values FROM customer GROUP BY 1, 2""",
)

# ledger ------------------------------------------------------------------------------------

register(
    "batch_ledger_state",
    lambda spark, folder: batch_state(
        table("events")(spark, folder).select(
            F.col("user_id").alias("batch_id"), F.col("event_type").alias("status"), F.col("event_id").alias("records_received"),
            F.col("ts").alias("event_time"),
        )
    ).select("batch_id", "status", "records_received", F.col("started_at").cast("date").alias("started"),
             F.col("updated_at").cast("date").alias("updated")),
    """SELECT user_id AS batch_id, max_by(event_type, ts) AS status, max_by(event_id, ts) AS records_received,
  CAST(min(ts) AS DATE) AS started, CAST(max(ts) AS DATE) AS updated FROM events GROUP BY user_id""",
)

# evaluation statistics -----------------------------------------------------------------------

_STAGES = [*ev.STAGE_FAILURES, "unexpected_error", "elsewhere"]
_STAGE_CASE = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STAGES)) + " END"


def _results(spark, folder):
    """Labelled documents as evaluation results: language as category, source as difficulty."""
    docs = table("documents")(spark, folder).select("doc_id", "lang", "source", "n_chars")
    labels = table("labels")(spark, folder)
    fields = F.filter(
        F.array(
            *[F.when(F.col("n_chars") % (i + 2) == 0, F.lit(f)) for i, f in enumerate((*ev.COMPARED_FIELDS, "colour"))]
        ),
        lambda x: x.isNotNull(),
    )
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("case_id"),
        F.col("lang").alias("category"),
        F.col("source").alias("difficulty"),
        (F.col("quality") == 1).alias("passed"),
        F.when(F.col("toxic") == 1, "failure").otherwise("success").alias("actual_status"),
        F.expr(_STAGE_CASE).alias("actual_failed_stage"),
        fields.alias("field_diffs"),
    )


register(
    "eval_breakdown",
    lambda spark, folder: ev.evaluation_breakdown(_results(spark, folder)),
    """WITH r AS (SELECT lang, source, quality = 1 AS passed FROM documents JOIN labels USING (doc_id)),
g AS (SELECT 'overall' AS breakdown, NULL AS value, passed FROM r UNION ALL SELECT 'category', lang, passed FROM r
  UNION ALL SELECT 'difficulty', source, passed FROM r)
SELECT breakdown, value, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
  round(count(*) FILTER (passed) * 100.0 / count(*), 2)::DOUBLE AS accuracy FROM g GROUP BY breakdown, value""",
)
register(
    "eval_failed_cases",
    lambda spark, folder: ev.failed_cases(_results(spark, folder)),
    "SELECT doc_id AS case_id FROM documents JOIN labels USING (doc_id) WHERE quality <> 1",
)
_FIELD_LIST = ", ".join(
    f"CASE WHEN n_chars % {i + 2} = 0 THEN '{n}' END" for i, n in enumerate((*ev.FIELD_FAILURES.values(), ev.UNKNOWN))
)
_STAGE_NAME = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(ev.STAGE_FAILURES.values())) + " END"
register(
    "failure_counts",
    lambda spark, folder: ev.failure_counts(_results(spark, folder)),
    f"""WITH f AS (SELECT * FROM documents JOIN labels USING (doc_id) WHERE quality <> 1),
t AS (SELECT doc_id, unnest(CASE WHEN toxic = 1 AND doc_id % 9 = 7 THEN ['unexpected_error']
  WHEN toxic = 1 THEN ['pipeline_failure', {_STAGE_NAME}]
  WHEN concat_ws('', {_FIELD_LIST}) = '' THEN ['unknown_mismatch']
  ELSE [{_FIELD_LIST}] END) AS failure_type FROM f)
SELECT failure_type, count(*) AS failures FROM t WHERE failure_type IS NOT NULL GROUP BY failure_type""",
)


def _compared(spark, folder):
    docs = table("documents")(spark, folder).select("doc_id", "lang", "source", "n_chars")
    key = F.col("doc_id").alias("case_id")
    expected = docs.select(
        key, F.array("lang").alias("metrics"), F.array("source").alias("dimensions"),
        F.array(F.struct(F.lit("lang").alias("field"), F.lit("eq").alias("operator"), F.col("lang").alias("value"))).alias("filters"),
        F.when(F.col("n_chars") % 2 == 0, "monthly").alias("time_grain"),
    )
    value = F.when(F.col("doc_id") % 7 == 0, F.lit("xx")).otherwise(F.col("lang"))
    actual = docs.where("doc_id % 11 <> 0").select(
        key, F.when(F.col("doc_id") % 3 == 0, F.array("lang", "lang")).otherwise(F.array("lang")).alias("metrics"),
        F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("other"))).otherwise(F.array("source")).alias("dimensions"),
        F.array(F.struct(F.lit("lang").alias("field"), F.lit("eq").alias("operator"), value.alias("value"))).alias("filters"),
        F.lit("monthly").alias("time_grain"),
    )
    return ev.compare_cases(expected, actual).select("case_id", F.array_join("field_diffs", ",").alias("field_diffs"), "passed")


register(
    "eval_field_diff",
    _compared,
    """SELECT doc_id AS case_id, field_diffs, field_diffs = '' AS passed FROM (SELECT doc_id, concat_ws(',',
  CASE WHEN doc_id % 3 = 0 OR doc_id % 11 = 0 THEN 'metrics' END, CASE WHEN doc_id % 5 = 0 OR doc_id % 11 = 0 THEN 'dimensions' END,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'filters' END,
  CASE WHEN (doc_id % 11 <> 0 AND n_chars % 2 <> 0) OR (doc_id % 11 = 0 AND n_chars % 2 = 0) THEN 'time_grain' END) AS field_diffs
FROM documents)""",
)


def _cases(spark, folder):
    rows = table("conversations")(spark, folder).select("conv_id", "turn", "role")
    cases = rows.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") % 3).cast("string")).alias("id"),
        "turn",
        F.when(F.col("role") == "assistant", "failure").otherwise("success").alias("expected_status"),
        F.when(F.col("turn") % 2 == 0, F.struct("role")).alias("expected"),
        F.when(F.col("conv_id") % 2 == 0, F.lit("planning")).alias("expected_failed_stage"),
    )
    return ev.case_errors(cases).select("id", "turn", F.array_join("errors", " ").alias("errors"))


register(
    "eval_case_errors",
    _cases,
    """WITH c AS (SELECT *, conv_id || '-' || (turn % 3) AS id, count(*) OVER (PARTITION BY conv_id, turn % 3) AS n FROM conversations),
e AS (SELECT id, turn, concat_ws(' ', CASE WHEN n > 1 THEN 'id is repeated.' END,
  CASE WHEN role <> 'assistant' AND turn % 2 <> 0 THEN 'a success case needs expected.' END,
  CASE WHEN role = 'assistant' AND conv_id % 2 <> 0 THEN 'a failure case needs expected_failed_stage.' END) AS errors FROM c)
SELECT id, turn, errors FROM e WHERE errors <> ''""",
)
register(
    "stage_timings",
    lambda spark, folder: ev.timing_summary(
        table("events")(spark, folder).select(
            F.col("event_type").alias("name"), (F.col("user_id") % 4).alias("label"), F.col("value").cast("decimal(14,2)").alias("ms")
        ),
        ["name", "label"], "ms",
    ).withColumn("average_ms", F.col("average_ms").cast("decimal(14,4)")),
    """SELECT event_type AS name, user_id % 4 AS label, count(*) AS count, CAST(sum(v) AS DOUBLE) AS total_ms,
  CAST(CAST(CAST(sum(v) AS DOUBLE) / count(*) AS DECIMAL(14,4)) AS DOUBLE) AS average_ms, CAST(min(v) AS DOUBLE) AS min_ms,
  CAST(max(v) AS DOUBLE) AS max_ms FROM (SELECT *, CAST(value AS DECIMAL(14,2)) AS v FROM events) GROUP BY 1, 2""",
)
