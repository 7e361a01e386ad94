"""Lead tables derived from the given tables, one SQL text for Spark and for the checks.

Braces name the given tables; every row of them is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadmill.plans.registry import table

COMPANY = """
SELECT c.c_custkey AS id, c.c_name AS name,
  CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE concat('c', c.c_custkey, '-shop.com') END AS domain,
  c.c_mktsegment AS industry, n.n_name AS country, r.r_name AS state,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL
       ELSE CAST(floor(abs(c.c_acctbal) / 20) AS INT) END AS employee_count,
  CASE WHEN c.c_custkey % 5 = 1 THEN NULL ELSE CAST(1950 + c.c_custkey % 76 AS INT) END AS founded_year,
  CASE WHEN c.c_custkey % 9 = 0 THEN NULL ELSE CAST(2010 + c.c_custkey % 17 AS INT) END AS copyright_year,
  CASE c.c_custkey % 10 WHEN 0 THEN 'dead' WHEN 1 THEN 'timeout' WHEN 2 THEN 'blocked'
       WHEN 3 THEN NULL ELSE 'alive' END AS website_status,
  c.c_custkey % 3 <> 0 AS has_ssl, c.c_custkey % 4 = 0 AS hiring,
  CASE WHEN c.c_custkey % 8 = 0 THEN 'careers page' END AS hiring_evidence,
  c.c_custkey % 6 = 0 AS modern_stack, c.c_custkey % 5 = 0 AS family_owned,
  CASE WHEN c.c_custkey % 10 = 0 THEN 'family-owned' END AS family_owned_hint,
  CASE c.c_custkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'qualified' WHEN 2 THEN 'contacted'
       ELSE 'disqualified' END AS stage,
  c.c_custkey % 20 AS import_id
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

CONTACT = """
SELECT o_orderkey AS contact_id, o_custkey AS company_id, o_orderkey AS seq,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('Pat Buyer', o_orderkey) END AS full_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Owner' WHEN '2-HIGH' THEN 'Vice President'
       WHEN '3-MEDIUM' THEN 'Office Manager' WHEN '5-LOW' THEN 'Assistant to the Owner' END AS title,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL
       WHEN o_orderkey % 3 = 0 THEN concat('info+', o_orderkey, '@c', o_custkey, '-shop.com')
       ELSE concat('pat', o_orderkey, '@c', o_custkey, '-shop.com') END AS email,
  CASE WHEN o_orderkey % 4 = 0 THEN 'unknown'
       ELSE CASE o_orderkey % 5 WHEN 0 THEN 'no_mx' WHEN 1 THEN 'unknown'
            WHEN 2 THEN 'invalid_syntax' ELSE 'valid_mx' END END AS email_status,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'role'
       ELSE 'personal' END AS email_type,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL
       ELSE concat('+1512', lpad(CAST(5550000 + o_orderkey % 10000 AS VARCHAR(10)), 7, '0')) END AS phone_e164,
  o_orderkey % 6 <> 0 AND o_orderkey % 7 <> 0 AS phone_valid,
  coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false) AS is_decision_maker
FROM {orders}
"""

OUTCOME = """
SELECT event_id, user_id AS job_id, ts,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'duplicate'
       ELSE 'processed' END AS outcome,
  CAST(floor(value * 100) AS BIGINT) AS elapsed_ms
FROM {events}
"""

JOB = """
SELECT user_id AS job_id, min(ts) AS created_at, max(ts) AS last_at,
  count(*) AS total_rows,
  count(CASE WHEN event_type = 'signup' THEN 1 END) AS duplicates_removed
FROM {events} GROUP BY user_id
"""

ATTEMPT = """
SELECT event_id AS attempt_id, concat('site', user_id, '.com') AS domain,
  CAST(event_id % 3 AS INT) AS url_pos, ts AS fetched_at,
  CASE event_type WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'blocked_robots'
       WHEN 'purchase' THEN 'http_403' END AS error,
  CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'purchase' THEN 403 END AS http_status,
  event_id % 4 <> 0 AS is_https,
  CAST(floor(value * 1000) AS BIGINT) AS elapsed_ms
FROM {events}
"""

# leads without a website: customers, suppliers and parts as names; some cities missing
NODOMAIN_LEAD = """
SELECT c.c_custkey * 4 AS seq, c.c_name AS name,
  CASE WHEN c.c_acctbal < 0 THEN NULL ELSE n.n_name END AS city, c.c_mktsegment AS industry
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
UNION ALL
SELECT s.s_suppkey * 4 + 1 AS seq, s.s_name AS name, n.n_name AS city, CAST(NULL AS VARCHAR(20)) AS industry
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
UNION ALL
SELECT p_partkey * 4 + 2 AS seq, concat(p_name, ' ', p_type, ' Co.') AS name,
  CASE WHEN p_size < 3 THEN NULL ELSE p_brand END AS city, p_type AS industry
FROM {part}
"""

# raw import rows: one per page, the site's address as website
PAGE_LEAD = """
SELECT page_id AS seq, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name, url AS website,
  regexp_extract(url, '/(en|fr|de|es)/', 1) AS state,
  CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Austin' WHEN 2 THEN 'austin ' ELSE 'Denver' END AS city,
  CASE WHEN page_id % 5 = 0 THEN NULL ELSE CAST(page_id % 300 AS INT) END AS employees
FROM {pages}
"""

# pages with business phrases put in front of the article, one kind per remainder
PAGE = """
SELECT page_id AS seq, url, replace(html, '<article>', concat('<article>',
  CASE page_id % 13
    WHEN 0 THEN concat('<p>Founded in ', 1900 + page_id % 120, ' and serving Austin since 1999.</p>')
    WHEN 1 THEN concat(CASE page_id % 3 WHEN 0 THEN '<p>&copy; 2009-' WHEN 1 THEN '<p>&#169; 2009-' ELSE '<p>&eacute; &copy;2009-' END, 2012 + page_id % 12, ' Tallow Ridge</p>')
    WHEN 2 THEN '<p>We are a Family-Owned shop, second generation.</p>'
    WHEN 3 THEN CASE page_id % 2 WHEN 0 THEN '<p>Great news: we''re hiring! Apply now.</p>' ELSE '<p>Great news: we&#x27;re hiring! Apply now.</p>' END
    WHEN 4 THEN '<a href="https://boards.greenhouse.io/tallow">jobs</a>'
    WHEN 5 THEN '<script src="//js.hs-scripts.com/1.js"></script><link href="/wp-content/a.css">'
    WHEN 6 THEN concat('<a href="https://www.linkedin.com/company/tallow-', page_id, '/">in</a><a href="https://x.com/intent/tweet">t</a><a href="https://x.com/tallow', page_id, '">x</a>')
    WHEN 7 THEN '<a href="https://www.facebook.com/sharer/sharer.php?u=a">share</a><a href="https://facebook.com/TallowRidge.">fb</a>'
    WHEN 8 THEN concat('<p>Mail office [at] ', regexp_extract(url, '([a-z-]+[.]example[.](com|net|org))', 1), ' or <a href="mailto:Jane%2Edoe', page_id, '@', regexp_extract(url, '([a-z-]+[.]example[.](com|net|org))', 1), '?subject=x">us</a>, not test@gmail.com but tallow.', page_id, '@gmail.com</p>')
    WHEN 9 THEN concat('<p>Call <a href="tel:+1-512-555-0', 100 + page_id % 90, '">us</a> or (415) 555-', 2000 + page_id % 7000, ', fax 555-0100</p>')
    WHEN 10 THEN '<ul><li>Orla Quist, Owner</li><li>Petra Venn - Office Manager</li><li>Founder &amp; CEO Tomas Ekdal</li><li>Contact Us, Owner</li></ul>'
    WHEN 11 THEN '<a href="/about-us">About</a><a href="/blog/about-our-winter-sale">sale</a><a href="/team/">Team</a><a href="/files/history.pdf">pdf</a>'
    ELSE '' END)) AS html
FROM {pages}
"""

NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def sql_text(text: str) -> str:
    """The text over the plain table names, as a sub-query."""
    return "(" + text.format(**{n: n for n in NAMES}).strip() + ")"


def view(spark: SparkSession, folder: str, text: str) -> DataFrame:
    used = {n: table(spark, folder, n) for n in NAMES if "{" + n + "}" in text}
    return spark.sql(text, **used)


def with_views(**views: str) -> str:
    """'WITH a AS (...), b AS (...)' for the checks."""
    return "WITH " + ",\n".join(f"{name} AS {sql_text(text)}" for name, text in views.items())
