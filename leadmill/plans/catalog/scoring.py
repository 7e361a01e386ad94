"""Scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.operators import scoring as sc
from leadmill.plans import mart
from leadmill.plans.registry import query

YEAR = 2026
SALES = sc.Profile("sales test", "sales", ("Machinery", "auto"), ("NATION_3", "nation_7"), ("ASIA",),
                   employee_min=50, employee_max=300)
ACQUISITION = sc.Profile("acquisition test", "acquisition", ("build",), (), ("EUROPE", "America"),
                         min_years=20)
OPEN_SIZE = sc.Profile("heavy weights", "sales", ("Machinery", "household"), (), ("AFRICA",), employee_min=100,
                       weights={"industry_match": 70, "hiring": 0, "family_owned": 25,
                                "years_in_business": 15, "site_dead": -60, "no_such_rule": 99})

# ---- the same rules once more, in SQL, for the checks ----
FACTS = """facts AS (
  SELECT c.*, f.pe, f.dmn, f.dmt, f.ph, f.mn, f.rn
  FROM mart_company c LEFT JOIN (
    SELECT company_id,
      arg_min(email, seq) FILTER (email_type = 'personal' AND email_status = 'valid_mx' AND email <> '') AS pe,
      arg_min(full_name, seq) FILTER (is_decision_maker AND full_name <> '') AS dmn,
      arg_min(coalesce(title, ''), seq) FILTER (is_decision_maker AND full_name <> '') AS dmt,
      arg_min(phone_e164, seq) FILTER (phone_valid AND phone_e164 <> '') AS ph,
      count(*) FILTER (email <> '' AND email_status <> 'invalid_syntax') AS mn,
      count(*) FILTER (email <> '' AND email_status <> 'invalid_syntax' AND email_type = 'role') AS rn
    FROM mart_contact GROUP BY company_id) f ON c.id = f.company_id)"""


def rules_sql(name: str, points: dict, industries, places, size, min_years) -> str:
    """Long table (id, pos, rule, points, reason) of fired rules, and the score per lead."""
    ind = " OR ".join(f"contains(lower(industry), '{t}') OR contains('{t}', lower(industry))" for t in industries)
    where = ", ".join(f"'{p}'" for p in places)
    if size is None:
        size_sql = "NULL"
    else:
        lo, hi = size
        fits = " AND ".join([f"employee_count >= {lo}"] * (lo is not None) + [f"employee_count <= {hi}"] * (hi is not None))
        size_sql = f"CASE WHEN {fits} THEN employee_count || ' employees fits the {lo or 0}-{hi or '∞'} range' END"
    reason = {
        "industry_match": f"CASE WHEN industry <> '' AND ({ind}) THEN 'Industry ''' || industry || ''' is in your ICP' END",
        "location_match": f"CASE WHEN lower(country) IN ({where}) THEN 'Located in ' || country WHEN lower(state) IN ({where}) THEN 'Located in ' || state END",
        "size_fit": size_sql,
        "personal_email_valid": "'Verified personal email (' || pe || ')'",
        "decision_maker": "'Found decision maker: ' || dmn || CASE WHEN dmt <> '' THEN ' (' || dmt || ')' ELSE '' END",
        "valid_phone": "'Valid phone ' || ph",
        "site_healthy": "CASE WHEN website_status = 'alive' AND has_ssl THEN 'Website is up with SSL' END",
        "hiring": "CASE WHEN hiring THEN 'Hiring right now' || coalesce(' (' || hiring_evidence || ')', '') END",
        "modern_stack": "CASE WHEN modern_stack THEN 'Uses modern sales/marketing tools' END",
        "years_in_business": f"CASE WHEN {YEAR} - founded_year >= {min_years} THEN 'Operating since ' || founded_year || ' (' || ({YEAR} - founded_year) || ' yrs)' END",
        "stale_website": f"CASE WHEN {YEAR} - copyright_year >= 3 THEN 'Website not updated since ' || copyright_year END",
        "family_owned": "CASE WHEN family_owned THEN coalesce('Says it''s ''' || family_owned_hint || '''', 'Family / owner operated') END",
        "low_confidence_merge": "NULL",
        "role_only_emails": "CASE WHEN mn > 0 AND mn = rn THEN 'Only generic inboxes (info@, sales@...)' END",
        "site_dead": "CASE WHEN website_status IN ('dead', 'timeout') THEN 'Website is ' || website_status END",
    }
    parts = [
        f"SELECT id, {i} AS pos, '{rule}' AS rule, {pts} AS points, CAST({reason[rule]} AS VARCHAR) AS reason FROM facts"
        for i, (rule, pts) in enumerate(points.items())
        if pts
    ]
    return f"""{name}_fired AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE reason IS NOT NULL),
{name} AS (
  SELECT f.id, CAST(coalesce(sum(points), 0) AS INTEGER) AS raw_total,
    CAST(greatest(0, least(100, coalesce(sum(points), 0))) AS INTEGER) AS score,
    coalesce(string_agg(rule || ':' || points || ':' || reason, ' | ' ORDER BY -points, pos) , '') AS breakdown
  FROM facts f LEFT JOIN {name}_fired USING (id) GROUP BY f.id)"""


GRADE = "CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END"
SALES_POINTS = {rule: pts[0] for rule, pts in lx.RULE_POINTS.items()}
ACQ_POINTS = {rule: pts[1] for rule, pts in lx.RULE_POINTS.items()}
HEAVY_POINTS = {**SALES_POINTS, "industry_match": 70, "hiring": 0, "family_owned": 25,
                "years_in_business": 15, "site_dead": -60}
BASE = mart.with_views(mart_company=mart.COMPANY, mart_contact=mart.CONTACT) + ",\n" + FACTS
SQL_SALES = rules_sql("sales", SALES_POINTS, ["machinery", "auto"], ["nation_3", "nation_7", "asia"], (50, 300), 10)
SQL_ACQ = rules_sql("acq", ACQ_POINTS, ["build"], ["europe", "america"], (5, 100), 20)
SQL_HEAVY = rules_sql("heavy", HEAVY_POINTS, ["machinery", "household"], ["africa"], (100, None), 10)


def company(spark, sf):
    return mart.view(spark, sf, mart.COMPANY)


def contact(spark, sf):
    return mart.view(spark, sf, mart.CONTACT)


def facts(spark, sf):
    return sc.lead_facts(company(spark, sf), contact(spark, sf))


def scored(spark, sf, profile=SALES):
    return sc.score_leads(facts(spark, sf), profile, YEAR)


def breakdown_text(c="breakdown"):
    return F.array_join(
        F.transform(c, lambda x: F.concat_ws(":", x["rule"], x["points"].cast("string"), x["reason"])), " | "
    )


def _score_columns(df):
    return df.select("id", "score", "grade", breakdown_text().alias("breakdown"))


@query("lead_score_sales", f"{BASE}, {SQL_SALES} SELECT id, score, {GRADE} AS grade, breakdown FROM sales")
def lead_score_sales(spark, sf):
    return _score_columns(scored(spark, sf, SALES))


@query("lead_score_acquisition", f"{BASE}, {SQL_ACQ} SELECT id, score, {GRADE} AS grade, breakdown FROM acq")
def lead_score_acquisition(spark, sf):
    return _score_columns(scored(spark, sf, ACQUISITION))


@query("score_weight_override", f"{BASE}, {SQL_HEAVY} SELECT id, score, {GRADE} AS grade, breakdown FROM heavy")
def score_weight_override(spark, sf):
    return _score_columns(scored(spark, sf, OPEN_SIZE))


@query("lead_score_multi_profile", f"""{BASE}, {SQL_SALES}, {SQL_ACQ}
SELECT id, 'sales test' AS profile, score, {GRADE} AS grade, breakdown FROM sales
UNION ALL SELECT id, 'acquisition test' AS profile, score, {GRADE} AS grade, breakdown FROM acq""")
def lead_score_multi_profile(spark, sf):
    df = sc.score_under_profiles(facts(spark, sf), [SALES, ACQUISITION], YEAR)
    return df.select("id", "profile", "score", "grade", breakdown_text().alias("breakdown"))


@query("score_breakdown_rows", f"""{BASE}, {SQL_ACQ}
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY -points, pos) - 1 AS INTEGER) AS pos, rule,
  points, reason, abs(points) / CAST(max(abs(points)) OVER (PARTITION BY id) AS DOUBLE) AS share FROM acq_fired""")
def score_breakdown_rows(spark, sf):
    return sc.breakdown_rows(scored(spark, sf, ACQUISITION))


@query("score_clamp_explain", f"{BASE}, {SQL_HEAVY} SELECT id, raw_total, score, raw_total <> score AS clamped FROM heavy")
def score_clamp_explain(spark, sf):
    return sc.clamp_explanation(scored(spark, sf, OPEN_SIZE))


@query("top_reasons", f"""{BASE}, {SQL_SALES}
SELECT f.id, coalesce(string_agg(reason, '; ' ORDER BY k) FILTER (k <= 2), '') AS top2,
  coalesce(string_agg(reason, '; ' ORDER BY k) FILTER (k <= 3), '') AS top3
FROM facts f LEFT JOIN (SELECT id, reason, row_number() OVER (PARTITION BY id ORDER BY -points, pos) AS k
  FROM sales_fired WHERE points > 0) t USING (id) GROUP BY f.id""")
def top_reasons(spark, sf):
    return scored(spark, sf).select(
        "id",
        F.array_join(sc.top_reasons("breakdown", 2), "; ").alias("top2"),
        F.array_join(sc.top_reasons("breakdown", 3), "; ").alias("top3"),
    )


@query("grade_thresholds", f"{BASE}, {SQL_SALES} SELECT score, {GRADE} AS grade, count(*) AS n FROM sales GROUP BY score")
def grade_thresholds(spark, sf):
    return scored(spark, sf).groupBy("score", "grade").agg(F.count("*").alias("n"))


@query("rescore_activated", f"{BASE}, {SQL_ACQ} SELECT {GRADE} AS grade, count(*) AS leads, CAST(sum(score) AS BIGINT) AS points FROM acq GROUP BY 1")
def rescore_activated(spark, sf):
    profiles = sc.profiles_table(spark, [SALES, ACQUISITION])
    _, out = sc.rescore_all(company(spark, sf), contact(spark, sf), profiles, ACQUISITION.name, YEAR)
    return out.groupBy("grade").agg(F.count("*").alias("leads"), F.sum("score").alias("points"))
