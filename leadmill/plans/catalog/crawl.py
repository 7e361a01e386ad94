"""Site health, crawl planning, freshness and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill.functions import normalize as nz
from leadmill.operators import crawl as cr
from leadmill.plans import mart
from leadmill.plans.catalog.normalize import domain_sql
from leadmill.plans.registry import query, table

ATTEMPT_SQL = mart.sql_text(mart.ATTEMPT)


def attempts(spark, sf):
    return mart.view(spark, sf, mart.ATTEMPT)


@query("home_candidates", """SELECT domain, CAST(p AS INTEGER) AS url_pos, (['https://', 'https://www.', 'http://'])[p + 1] || domain || '/' AS url
FROM (SELECT DISTINCT concat('site', user_id, '.com') AS domain FROM events), range(3) r(p)""")
def home_candidates(spark, sf):
    return cr.home_candidates(attempts(spark, sf).select("domain").distinct())


HOME_SQL = f"""home AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY
  CASE WHEN error IS NULL OR error = 'blocked_robots' OR http_status IS NOT NULL THEN url_pos ELSE 100 - url_pos END, attempt_id) AS rn
  FROM {ATTEMPT_SQL}) WHERE rn = 1)"""
STATE = """CASE WHEN error IS NULL THEN 'alive' WHEN error = 'timeout' THEN 'timeout'
  WHEN error = 'blocked_robots' OR http_status IN (401, 403, 429) THEN 'blocked' ELSE 'dead' END"""


@query("home_attempt", f"WITH {HOME_SQL} SELECT domain, attempt_id, url_pos, http_status, error FROM home")
def home_attempt(spark, sf):
    return cr.home_attempts(attempts(spark, sf)).drop("is_https")


@query("site_status", f"""WITH {HOME_SQL} SELECT domain, {STATE} AS website_status, error IS NULL AND is_https AS has_ssl FROM home""")
def site_status(spark, sf):
    return cr.site_states(cr.home_attempts(attempts(spark, sf))).select("domain", "website_status", "has_ssl")


TRIES = """SELECT concat('https://site', user_id, '.com/', event_type) AS url, event_id AS try_no,
  CASE event_type WHEN 'view' THEN CASE WHEN value < 40 THEN 200 ELSE 404 END WHEN 'click' THEN CASE WHEN value < 20 THEN 503 ELSE 200 END
    WHEN 'purchase' THEN CASE WHEN value < 30 THEN 429 ELSE 403 END WHEN 'signup' THEN 200 END AS http_status,
  CASE WHEN event_type = 'error' THEN CASE WHEN value < 10 THEN 'connect_error' ELSE 'timeout' END END AS error,
  CASE WHEN event_type = 'signup' THEN 'application/pdf' ELSE 'text/HTML; charset=utf-8' END AS content_type,
  CASE WHEN value > 30 THEN 3000000 ELSE 1000 END AS bytes FROM {events}"""


@query("attempt_outcome", f"""WITH t AS {mart.sql_text(TRIES)}, l AS (SELECT *, count(*) OVER (PARTITION BY url) AS tries,
  row_number() OVER (PARTITION BY url ORDER BY try_no DESC) AS rn FROM t)
SELECT url, tries, CASE WHEN http_status = 429 OR http_status >= 500 THEN NULL ELSE http_status END AS http_status,
  CASE WHEN error IS NOT NULL THEN error WHEN http_status >= 400 THEN 'http_' || http_status
    WHEN NOT contains(lower(content_type), 'html') THEN 'not_html' WHEN bytes > 2097152 THEN 'too_large' END AS error FROM l WHERE rn = 1""")
def attempt_outcome(spark, sf):
    return cr.attempt_outcomes(mart.view(spark, sf, TRIES))


@query("site_health_reason", f"""WITH {HOME_SQL}, s AS (SELECT *, {STATE} AS st, error IS NULL AND is_https AS ssl FROM home WHERE domain <> 'site3.com')
SELECT domain, reason, health, health = 'alive' AND ssl AS healthy FROM (SELECT *, st AS health, CASE st WHEN 'alive' THEN 'Site is up' || CASE WHEN ssl THEN ' over HTTPS' ELSE ' but has no SSL' END
  WHEN 'blocked' THEN 'Site blocked our crawler (robots.txt or 403) - we backed off' WHEN 'timeout' THEN 'Site didn''t respond in time'
  ELSE 'Site looks down (' || error || ')' END AS reason FROM s)
UNION ALL SELECT 'site3.com', 'Site looks down (no response)', 'dead', false WHERE EXISTS (SELECT 1 FROM home WHERE domain = 'site3.com')""")
def site_health_reason(spark, sf):
    s = cr.site_states(cr.home_attempts(attempts(spark, sf)))
    lost = F.col("domain") == "site3.com"
    s = s.withColumns({
        "errors": F.when(F.col("error").isNotNull() & ~lost, F.array(F.lit("meta: x"), F.concat(F.lit("home: "), "error"))),
        "website_status": F.when(~lost, F.col("website_status")), "http_status": F.when(~lost, F.col("http_status")),
        "has_ssl": F.when(~lost, F.col("has_ssl")),
    })
    return cr.site_health(s).select("domain", "health", "reason", "healthy")


@query("lead_timeouts", f"""SELECT domain, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms,
  CASE WHEN sum(elapsed_ms) > 25000 THEN 'timeout' END AS website_status FROM {ATTEMPT_SQL} GROUP BY domain""")
def lead_timeouts(spark, sf):
    return cr.timeout_outcomes(attempts(spark, sf))


HOSTS = """SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host FROM {pages}"""
BODY = r"""CASE WHEN host LIKE 'www.%' THEN concat('User-agent: *', chr(10), 'Disallow: /en/', chr(10), 'Allow: /', chr(10), chr(10), 'User-agent: otherbot', chr(10), 'Disallow: /')
  WHEN host LIKE 'blog.%' THEN concat('# all', chr(10), 'user-agent: other', chr(10), 'User-Agent: MillBot # us', chr(10), 'Allow: /fr/', chr(10), 'Disallow: /', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow:')
  WHEN host LIKE 'm.%' THEN concat('User-agent: *', chr(10), chr(10), 'Disallow: /') ELSE '' END"""
ROBOTS = f"SELECT host, CAST(CASE WHEN host LIKE 'th%' THEN 403 WHEN host LIKE 'spam%' THEN 500 ELSE 200 END AS INT) AS http_status, {BODY} AS body FROM ({HOSTS})"


@query("robots_filter", r"""SELECT page_id, CASE WHEN host LIKE 'www.%' THEN NOT starts_with(path, '/en/') WHEN host LIKE 'blog.%' THEN starts_with(path, '/fr/')
  WHEN host LIKE 'm.%' THEN true WHEN host LIKE 'th%' THEN false ELSE true END AS allowed
FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1) AS path FROM pages)""")
def robots_filter(spark, sf):
    robots = mart.view(spark, sf, ROBOTS)
    return cr.robots_allowed(table(spark, sf, "pages").select("page_id", "url"), robots, "MillBot/1.0").select("page_id", "allowed")


@query("crawl_schedule", """SELECT page_id, CAST(rn AS INTEGER) AS turn, (rn - 1) * CAST(0.5 AS DOUBLE) AS start_s, CAST(ceil(rn / 2) AS INTEGER) AS wave FROM (
  SELECT page_id, row_number() OVER (PARTITION BY lower(regexp_extract(url, '://([^/?#]+)', 1)) ORDER BY page_id) AS rn FROM pages)""")
def crawl_schedule(spark, sf):
    urls = table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("host"))
    return cr.crawl_schedule(urls, "page_id").drop("host")


@query("stale_domains", """SELECT DISTINCT concat('site', c_custkey, '.com') AS domain FROM customer WHERE c_custkey NOT IN (
  SELECT user_id FROM events GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY AND min(value) >= 0.05)""")
def stale_domains(spark, sf):
    site = F.concat(F.lit("site"), F.col("user_id").cast("string"), F.lit(".com")).alias("domain")
    seen = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("stored_at"), F.min("value").alias("low"))
    wanted = table(spark, sf, "customer").select(F.concat(F.lit("site"), F.col("c_custkey").cast("string"), F.lit(".com")).alias("domain")).distinct()
    snap = seen.select(site, "stored_at")
    forced = seen.filter("low < 0.05").select(site)
    return cr.stale(wanted, snap, "domain", "2024-01-20 00:00:00", 7 * 86400, forced)


def site_pages(spark, sf, text=mart.PAGE):
    """Pages with domain and path; a site's pages without a path are its home."""
    p = mart.view(spark, sf, text) if text else table(spark, sf, "pages").withColumnRenamed("page_id", "seq")
    return p.withColumn("domain", nz.canonical_domain("url")).withColumn("path", cr.page_path("url"))


PATH_SQL = "coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/')"


@query("latest_pages", f"SELECT {domain_sql('url')} AS domain, {PATH_SQL} AS path, max(page_id) AS seq FROM pages GROUP BY 1, 2")
def latest_pages(spark, sf):
    return cr.latest_pages(site_pages(spark, sf, None)).select("domain", "path", "seq")


LINK_SQL = f"""{mart.with_views(p=mart.PAGE)}, a AS (
  SELECT seq, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a', 1)) AS href,
    regexp_replace(unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a', 2)), '<[^>]*>', '', 'g') AS label,
    unnest(range(len(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a', 1)))) AS pos FROM p),
u AS (SELECT seq, pos, label, CASE WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href END AS link, url FROM a
  WHERE href <> '' AND NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:)')),
k AS (SELECT seq, link, min(pos) AS pos, min(len(link) - len(replace(link, '/', ''))) AS depth FROM (
    SELECT seq, regexp_replace(link, '#.*$', '') AS link, pos, label, url, regexp_replace(regexp_replace(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '^$', '/') AS path FROM u)
  WHERE path <> '/' AND NOT regexp_matches(lower(path), '[.](pdf|jpg|png|zip)$') AND {domain_sql('link')} = {domain_sql('url')}
    AND regexp_matches(path || ' ' || label, '(?i)(about|contact|team|staff|people|leadership|careers|jobs|join|our-story|who-we-are|history)')
  GROUP BY seq, link)
SELECT seq, CAST(rn AS INTEGER) AS rank, link FROM (SELECT seq, link, row_number() OVER (PARTITION BY seq ORDER BY len(regexp_replace(link, '/+$', '')) - len(replace(regexp_replace(link, '/+$', ''), '/', '')), pos) AS rn FROM k) WHERE rn <= 4"""


@query("subpage_links", LINK_SQL)
def subpage_links(spark, sf):
    out = cr.subpage_links(site_pages(spark, sf))
    return out.select("seq", F.posexplode("links").alias("rank", "link")).withColumn("rank", F.col("rank") + 1)
