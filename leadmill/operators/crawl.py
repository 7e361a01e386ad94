"""Site health, crawl planning and freshness over attempt, page and robots tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.functions.normalize import canonical_domain
from leadmill.functions.text import percent_decode
from leadmill.operators.ranking import ranked

# ---- attempts and site health ---------------------------------------------


def home_candidates(domains: DataFrame) -> DataFrame:
    """(domain, url_pos, url): where a site's home page is looked for, in order."""
    d = F.col("domain")
    urls = F.array(
        F.concat(F.lit("https://"), d, F.lit("/")),
        F.concat(F.lit("https://www."), d, F.lit("/")),
        F.concat(F.lit("http://"), d, F.lit("/")),
    )
    return domains.select("domain", F.posexplode(urls).alias("url_pos", "url"))


def attempt_outcomes(tries: DataFrame) -> DataFrame:
    """One outcome per URL from its tries (url, try_no, http_status, error, content_type, bytes).

    The last try decides. A retryable end (429, 5xx, timeout, connect error) leaves an
    error and no status; otherwise the status stays and the error code is the first that
    applies of http_N, not_html, too_large.
    """
    last = tries.groupBy("url").agg(
        F.max_by(F.struct("http_status", "error", "content_type", "bytes"), "try_no").alias("t"),
        F.count("*").alias("tries"),
    )
    status, error = F.col("t.http_status"), F.col("t.error")
    code = F.concat(F.lit("http_"), status.cast("string"))
    exhausted = error.isin("timeout", "connect_error") | (status == 429) | (status >= 500)
    exhausted = F.coalesce(exhausted, F.lit(False))
    found = (
        F.when(exhausted, F.coalesce(error, code))
        .when(error.isNotNull(), error)
        .otherwise(page_error(status, F.col("t.content_type"), F.col("t.bytes")))
    )
    return last.select(
        "url",
        "tries",
        F.when(~exhausted, status).alias("http_status"),
        found.alias("error"),
    )


def page_error(status: Column, content_type: Column, size: Column) -> Column:
    """Why an answer is not a usable page, NULL if it is."""
    return (
        F.when(status >= 400, F.concat(F.lit("http_"), status.cast("string")))
        .when(~F.coalesce(F.lower(content_type).contains("html"), F.lit(False)), "not_html")
        .when(size > lx.MAX_BODY_BYTES, "too_large")
    )


def home_attempts(attempts: DataFrame) -> DataFrame:
    """The attempt that speaks for the site: the first that is ok, blocked by robots or has
    any HTTP status, else the last candidate."""
    decisive = (
        F.col("error").isNull() | (F.col("error") == "blocked_robots") | F.col("http_status").isNotNull()
    )
    key = F.struct(
        F.when(decisive, F.col("url_pos")).otherwise(F.lit(100) - F.col("url_pos")), "attempt_id"
    )
    fields = F.struct("attempt_id", "url_pos", "http_status", "error", "is_https")
    return attempts.groupBy("domain").agg(F.min_by(fields, key).alias("h")).select("domain", "h.*")


def site_status(http_status: Column | str = "http_status", error: Column | str = "error") -> Column:
    s = F.col(http_status) if isinstance(http_status, str) else http_status
    e = F.col(error) if isinstance(error, str) else error
    return (
        F.when(e.isNull(), "alive")
        .when(e == "timeout", "timeout")
        .when((e == "blocked_robots") | s.isin(401, 403, 429), "blocked")
        .otherwise("dead")
    )


def site_states(homes: DataFrame) -> DataFrame:
    state = site_status()
    return homes.select(
        "domain", "http_status", "error", state.alias("website_status"),
        ((state == "alive") & F.col("is_https")).alias("has_ssl"),
    )


def site_health(sites: DataFrame) -> DataFrame:
    """Verdict with a reason text from (website_status, has_ssl, http_status, errors array)."""
    status = F.coalesce(F.nullif(F.col("website_status"), F.lit("")), F.lit("dead"))
    ssl = F.coalesce("has_ssl", F.lit(False))
    home = F.get(F.filter("errors", lambda e: e.startswith("home:")), F.lit(0))
    why = F.coalesce(
        F.nullif(F.regexp_replace(home, "^home: ", ""), F.lit("")),
        F.nullif(F.col("http_status"), F.lit(0)).cast("string"),
        F.lit("no response"),
    )
    reason = (
        F.when(status == "alive", F.concat(F.lit("Site is up"), F.when(ssl, " over HTTPS").otherwise(" but has no SSL")))
        .when(status == "blocked", "Site blocked our crawler (robots.txt or 403) - we backed off")
        .when(status == "timeout", "Site didn't respond in time")
        .otherwise(F.concat(F.lit("Site looks down ("), why, F.lit(")")))
    )
    return sites.withColumns(
        {"health": status, "reason": reason, "healthy": (status == "alive") & ssl}
    )


def timeout_outcomes(attempts: DataFrame, limit_ms: int = lx.LEAD_TIMEOUT_MS) -> DataFrame:
    """Per domain: total time, and 'timeout' where it went over the limit."""
    return attempts.groupBy("domain").agg(F.sum("elapsed_ms").alias("elapsed_ms")).withColumn(
        "website_status", F.when(F.col("elapsed_ms") > limit_ms, "timeout")
    )


# ---- robots ---------------------------------------------------------------


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, rules): the rules that hold for this crawler, in file order.

    ``robots`` has one row per host (host, http_status, body); bodies are cut at 100 000
    characters by definition, which bounds every group here.
    """
    name = agent.split("/")[0].lower()
    body = F.when(F.col("http_status") == 200, F.substring("body", 1, lx.ROBOTS_CHARS)).when(
        F.col("http_status").isin(401, 403), "User-agent: *\nDisallow: /"
    )
    lines = robots.select("host", F.posexplode(F.split(F.coalesce(body, F.lit("")), "\r\n|\n|\r")).alias("pos", "raw"))
    text = F.trim(F.substring_index("raw", "#", 1))
    lines = lines.select(
        "host",
        "pos",
        (F.col("raw") == "").alias("blank"),
        F.lower(F.trim(F.substring_index(text, ":", 1))).alias("key"),
        F.trim(F.regexp_replace(text, "^[^:]*:", "")).alias("value"),
        text.contains(":").alias("pair"),
    ).filter(
        "blank OR (pair AND key IN ('user-agent', 'allow', 'disallow', 'crawl-delay', 'request-rate'))"
    )
    by_line = Window.partitionBy("host").orderBy("pos")
    agent_line = F.col("key") == "user-agent"
    lines = lines.withColumn(
        "starts", agent_line & ~F.coalesce(F.lag("key").over(by_line) == "user-agent", F.lit(False))
    )
    lines = lines.withColumns(
        {"block": F.count_if("starts").over(by_line), "gap": F.count_if("blank").over(by_line)}
    )
    block = Window.partitionBy("host", "block")
    lines = lines.withColumn("first_gap", F.min(F.when(agent_line, F.col("gap"))).over(block))
    # a rule counts only if no empty line came between it and its user-agent lines
    live = lines.filter((F.col("block") > 0) & ~F.col("blank") & (F.col("gap") == F.col("first_gap")))
    mine = F.lit(name).contains(F.lower("value"))
    rule = F.struct(
        "pos",
        ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"),
        percent_decode("value").alias("path"),
    )
    blocks = live.groupBy("host", "block").agg(
        F.bool_or((F.col("key") == "user-agent") & (F.col("value") == "*")).alias("star"),
        F.bool_or(agent_line & mine).alias("ours"),
        F.bool_or(~agent_line).alias("has_rules"),
        F.sort_array(F.collect_list(F.when(F.col("key").isin("allow", "disallow"), rule))).alias("rules"),
    )
    rank = F.struct(F.col("star"), F.col("block"))  # named blocks first, in file order
    usable = blocks.filter(F.col("has_rules") & (F.col("star") | F.col("ours")))
    return usable.groupBy("host").agg(F.min_by("rules", rank).alias("rules"))


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Adds ``allowed``: the first rule whose path starts the URL's path decides, default yes.

    One row of rules per host is joined, so URLs are never multiplied by rules.
    """
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#]+)", 1)
    rest = F.regexp_replace(F.col("url"), r"^[A-Za-z]+://[^/?#]+", "")
    path = percent_decode(F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    known = robots_rules(robots, agent)
    out = urls.withColumns({"host": host, "_path": path}).join(known, "host", "left")
    first = F.get(
        F.filter("rules", lambda r: (r["path"] == "*") | F.col("_path").startswith(r["path"])), F.lit(0)
    )
    return out.withColumn("allowed", F.coalesce(first["allow"], F.lit(True))).drop("_path", "rules")


# ---- planning -------------------------------------------------------------


def crawl_schedule(urls: DataFrame, order: str, per_host: int = 2,
                   delay: float = lx.HOST_DELAY_SECONDS, **kw) -> DataFrame:
    """Start offset in seconds and wave number per URL, spaced per host; exact for hosts of
    any size (see ranking.ranked)."""
    out = ranked(urls, ["host"], [F.col(order).asc()], "turn", **kw)
    return out.withColumns(
        {
            "start_s": (F.col("turn") - 1) * F.lit(float(delay)),
            "wave": F.ceil(F.col("turn") / F.lit(per_host)).cast("int"),
        }
    )


def stale(wanted: DataFrame, snapshot: DataFrame, key: str, now: str, ttl_seconds: int,
          forced: DataFrame | None = None, time: str = "stored_at") -> DataFrame:
    """Keys to refresh: no stored value younger than the limit, or forced."""
    alive = F.timestamp_seconds(F.unix_timestamp(F.lit(now).cast("timestamp")) - ttl_seconds)
    fresh = snapshot.filter(F.col(time).cast("timestamp") > alive).select(key).distinct()
    if forced is not None:
        fresh = fresh.join(forced.select(key), key, "left_anti")
    return wanted.join(fresh, key, "left_anti")


# ---- pages and links ------------------------------------------------------


def latest_pages(pages: DataFrame) -> DataFrame:
    """A later page with the same (domain, path) replaces the earlier one.

    Page bodies are not aggregated: only the few repeated paths, found on narrow columns,
    are joined back to drop the older rows.
    """
    repeated = (
        pages.groupBy("domain", "path").agg(F.max("seq").alias("last"), F.count("*").alias("n"))
        .filter("n > 1").select("domain", "path", "last")
    )
    p, r = pages.alias("p"), repeated.alias("r")
    older = (
        (F.col("p.domain") == F.col("r.domain")) & (F.col("p.path") == F.col("r.path"))
        & (F.col("p.seq") < F.col("r.last"))
    )
    return p.join(r, older, "left_anti")


def page_path(url: Column | str) -> Column:
    """Path without query, fragment and trailing slashes; '/' for the home page."""
    u = F.col(url) if isinstance(url, str) else url
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    cut = F.regexp_replace(path, "/+$", "")
    return F.when(cut == "", "/").otherwise(cut)


def anchors(html: Column | str) -> Column:
    """array<struct<href, text>> of the page's links in document order."""
    h = F.col(html) if isinstance(html, str) else html
    pattern = F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a""")
    pairs = F.arrays_zip(
        F.regexp_extract_all(h, pattern, F.lit(1)).alias("href"),
        F.regexp_extract_all(h, pattern, F.lit(2)).alias("body"),
    )
    return F.transform(
        pairs,
        lambda x: F.struct(
            F.trim(F.replace(x["href"], F.lit("&amp;"), F.lit("&"))).alias("href"),
            F.trim(F.regexp_replace(x["body"], "<[^>]*>", "")).alias("text"),
        ),
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute URL of a link without its fragment."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    url = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, path, href))
        .otherwise(F.concat(root, folder, href))
    )
    url = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(url, r"(\?.*)$", 1)
    site = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    steps = F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*/([^?]*)", 1), "/")
    up = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    # a last . or .. names the folder
    tail = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(up) > 0), "/").otherwise("")
    clean = F.concat(site, F.lit("/"), F.array_join(up, "/"), tail, query)
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*/[^?]*?(?:^|/)?\.{1,2}(?:/|\?|$)"), clean).otherwise(url)


def subpage_links(homes: DataFrame, domain: str = "domain") -> DataFrame:
    """Adds ``links``: up to four internal about/contact/team/careers links, shallow ones
    first. Works inside each page row, no shuffle."""
    topic = "(?i)(" + "|".join(lx.SUBPAGE_WORDS) + ")"
    looked = homes.withColumn("_anchors", anchors("html")).withColumn(
        "_links",
        F.transform(
            F.filter(
                "_anchors",
                lambda a: (a["href"] != "") & ~a["href"].rlike("^(#|mailto:|tel:|javascript:)"),
            ),
            lambda a: F.struct(resolve_url(F.col("url"), a["href"]).alias("url"), a["text"].alias("text")),
        ),
    )

    def keep(x):
        path = page_path(x["url"])
        return (
            x["url"].rlike("^https?://")
            & (canonical_domain(F.regexp_extract(x["url"], r"^[a-z]+://([^/?#]*)", 1)) == F.col(domain))
            & (path != "/")
            & ~F.lower(path).rlike(r"\.(pdf|jpg|png|zip)$")
            & (path.rlike(topic) | x["text"].rlike(topic))
        )

    urls = F.array_distinct(F.transform(F.filter("_links", keep), lambda x: x["url"]))
    ordered = F.array_sort(
        F.transform(
            urls,
            lambda u, i: F.struct(
                (F.length(page_path(u)) - F.length(F.replace(page_path(u), F.lit("/"), F.lit("")))).alias("depth"),
                i.alias("pos"), u.alias("url"),
            ),
        )
    )
    links = F.transform(F.slice(ordered, 1, lx.MAX_SUBPAGES), lambda x: x["url"])
    return looked.withColumn("links", links).drop("_anchors", "_links")
