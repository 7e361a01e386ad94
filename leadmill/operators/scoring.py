"""Rule-based lead scoring under weighted profiles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadmill import lexicons as lx
from leadmill.functions.normalize import grade_for
from leadmill.session import at_most

MAX_PROFILES = 1000

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField(
            "rules",
            T.StructType(
                [
                    T.StructField("industries", T.ArrayType(T.StringType())),
                    T.StructField("countries", T.ArrayType(T.StringType())),
                    T.StructField("states", T.ArrayType(T.StringType())),
                    T.StructField("employee_min", T.IntegerType()),
                    T.StructField("employee_max", T.IntegerType()),
                    T.StructField("min_years_in_business", T.IntegerType()),
                    T.StructField("weights", T.MapType(T.StringType(), T.IntegerType())),
                ]
            ),
        ),
    ]
)


@dataclass(frozen=True)
class Profile:
    """What a good lead looks like; the defaults are "no profile"."""

    name: str = "none"
    mode: str | None = "sales"
    industries: tuple = ()
    countries: tuple = ()
    states: tuple = ()
    employee_min: int | None = None
    employee_max: int | None = None
    min_years: int | None = None
    weights: dict = field(default_factory=dict)
    is_active: bool = False

    @property
    def strategy(self) -> str:
        mode = (self.mode or "sales").lower()
        return mode if mode in lx.MODES else "sales"

    def points(self) -> dict[str, int]:
        """Rule -> points in strategy order; overrides of unknown rules are ignored."""
        column = lx.MODES.index(self.strategy)
        base = {rule: pts[column] for rule, pts in lx.RULE_POINTS.items()}
        base.update({r: int(p) for r, p in self.weights.items() if r in RULES})
        return {rule: pts for rule, pts in base.items() if pts}


DEFAULT_PROFILES = [
    Profile("Default Sales ICP", "sales", tuple(lx.DEFAULT_INDUSTRIES), ("US",),
            employee_min=5, employee_max=200, is_active=True),
    Profile("Searcher - Acquisition Fit", "acquisition", tuple(lx.DEFAULT_INDUSTRIES), ("US",),
            employee_min=5, employee_max=100, min_years=10),
]


def profiles_table(spark, profiles=None) -> DataFrame:
    rows = [
        (p.name, p.mode, p.is_active,
         (list(p.industries), list(p.countries), list(p.states), p.employee_min,
          p.employee_max, p.min_years, p.weights or None))
        for p in (DEFAULT_PROFILES if profiles is None else profiles)
    ]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def read_profiles(table: DataFrame) -> list[Profile]:
    """Profiles as parameters of the scoring plan; they are configuration, size-checked."""
    if not at_most(table, MAX_PROFILES):
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    out = []
    for row in table.collect():
        r = row.rules.asDict() if row.rules else {}
        out.append(
            Profile(row.name, row.mode, tuple(r.get("industries") or ()),
                    tuple(r.get("countries") or ()), tuple(r.get("states") or ()),
                    r.get("employee_min"), r.get("employee_max"),
                    r.get("min_years_in_business"), dict(r.get("weights") or {}),
                    bool(row.is_active))
        )
    return out


def activate(table: DataFrame, name: str) -> DataFrame:
    """Exactly the named profile becomes active."""
    return table.withColumn("is_active", F.col("name") == name)


def active_profile(table: DataFrame) -> Profile:
    live = read_profiles(table.filter("is_active"))
    return live[0] if live else Profile()


# ---- rules: (profile, as_of_year) -> reason text or NULL, over lead_facts columns ----


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _targets(values) -> list[str]:
    return [str(v).strip().lower() for v in values or () if str(v).strip()]


def _industry_match(p: Profile, year: int) -> Column:
    shown = F.trim("industry")
    ind = F.lower(shown)
    hit = F.lit(False)
    for t in _targets(p.industries):
        hit = hit | ind.contains(t) | F.lit(t).contains(ind)
    return F.when(_filled(shown) & hit, F.concat(F.lit("Industry '"), shown, F.lit("' is in your ICP")))


def _location_match(p: Profile, year: int) -> Column:
    targets = _targets(p.countries) + _targets(p.states)
    if not targets:
        return F.lit(None).cast("string")
    said = [
        F.when(F.lower(F.trim(c)).isin(targets), F.concat(F.lit("Located in "), F.trim(c)))
        for c in ("country", "state")
    ]
    return F.coalesce(*said)


def _size_fit(p: Profile, year: int) -> Column:
    lo, hi = p.employee_min, p.employee_max
    if lo is None and hi is None:
        if p.strategy != "acquisition" or p.mode != "acquisition":
            return F.lit(None).cast("string")
        lo, hi = lx.ACQUISITION_SIZE
    n = F.col("employee_count")
    fits = n.isNotNull()
    fits = fits & (n >= lo) if lo is not None else fits
    fits = fits & (n <= hi) if hi is not None else fits
    return F.when(
        fits, F.concat(n.cast("string"), F.lit(f" employees fits the {lo or 0}-{hi or '∞'} range"))
    )


def _personal_email_valid(p: Profile, year: int) -> Column:
    mail = F.col("ct_personal_email")
    return F.when(
        mail.isNotNull(), F.concat(F.lit("Verified personal email ("), mail, F.lit(")"))
    )


def _decision_maker(p: Profile, year: int) -> Column:
    who = F.col("ct_decision_maker")
    title = F.when(
        _filled(who["title"]), F.concat(F.lit(" ("), who["title"], F.lit(")"))
    ).otherwise("")
    return F.when(
        who.isNotNull(), F.concat(F.lit("Found decision maker: "), who["full_name"], title)
    )


def _valid_phone(p: Profile, year: int) -> Column:
    return F.concat(F.lit("Valid phone "), F.col("ct_phone"))


def _site_healthy(p: Profile, year: int) -> Column:
    ok = (F.col("website_status") == "alive") & F.col("has_ssl")
    return F.when(ok, "Website is up with SSL")


def _hiring(p: Profile, year: int) -> Column:
    why = F.col("hiring_evidence")
    note = F.when(_filled(why), F.concat(F.lit(" ("), why, F.lit(")"))).otherwise("")
    return F.when(F.col("hiring"), F.concat(F.lit("Hiring right now"), note))


def _modern_stack(p: Profile, year: int) -> Column:
    return F.when(F.col("modern_stack"), "Uses modern sales/marketing tools")


def _years_in_business(p: Profile, year: int) -> Column:
    since = F.col("founded_year")
    years = F.lit(year) - since
    return F.when(
        (since != 0) & (years >= (p.min_years or lx.DEFAULT_MIN_YEARS)),
        F.concat(F.lit("Operating since "), since.cast("string"), F.lit(" ("),
                 years.cast("string"), F.lit(" yrs)")),
    )


def _stale_website(p: Profile, year: int) -> Column:
    last = F.col("copyright_year")
    return F.when(
        (last != 0) & (F.lit(year) - last >= lx.STALE_SITE_YEARS),
        F.concat(F.lit("Website not updated since "), last.cast("string")),
    )


def _family_owned(p: Profile, year: int) -> Column:
    hint = F.col("family_owned_hint")
    return F.when(
        F.col("family_owned"),
        F.when(_filled(hint), F.concat(F.lit("Says it's '"), hint, F.lit("'"))).otherwise(
            "Family / owner operated"
        ),
    )


def _low_confidence_merge(p: Profile, year: int) -> Column:
    return F.when(F.col("low_confidence_merge"), "Merged from fuzzy-matched duplicates")


def _role_only_emails(p: Profile, year: int) -> Column:
    only = (F.col("ct_mails") > 0) & (F.col("ct_mails") == F.col("ct_role_mails"))
    return F.when(only, "Only generic inboxes (info@, sales@...)")


def _site_dead(p: Profile, year: int) -> Column:
    state = F.col("website_status")
    return F.when(state.isin("dead", "timeout"), F.concat(F.lit("Website is "), state))


Rule = Callable[[Profile, int], Column]
RULES: dict[str, Rule] = {
    "industry_match": _industry_match,
    "location_match": _location_match,
    "size_fit": _size_fit,
    "personal_email_valid": _personal_email_valid,
    "decision_maker": _decision_maker,
    "valid_phone": _valid_phone,
    "site_healthy": _site_healthy,
    "hiring": _hiring,
    "modern_stack": _modern_stack,
    "years_in_business": _years_in_business,
    "stale_website": _stale_website,
    "family_owned": _family_owned,
    "low_confidence_merge": _low_confidence_merge,
    "role_only_emails": _role_only_emails,
    "site_dead": _site_dead,
}


def register_rule(name: str, rule: Rule) -> None:
    """Plug-in rule; it fires only under profiles that give it a weight."""
    RULES[name] = rule


# ---- facts and scores -----------------------------------------------------


def contact_facts(contacts: DataFrame) -> DataFrame:
    """What the rules need to know about a company's contacts, one row per company.

    Partial aggregation reduces a company of any size before the shuffle; no contact
    list is ever built.
    """
    has_mail = _filled(F.col("email"))
    mail_ok = has_mail & (F.col("email_status") != "invalid_syntax")
    personal = has_mail & (F.col("email_type") == "personal") & (F.col("email_status") == "valid_mx")
    leader = F.col("is_decision_maker") & _filled(F.col("full_name"))
    phone = F.col("phone_valid") & _filled(F.col("phone_e164"))

    def first(value, cond):
        return F.min_by(value, F.when(cond, F.col("seq")))

    facts = contacts.groupBy(F.col("company_id").alias("id")).agg(
        first(F.when(personal, F.col("email")), personal).alias("ct_personal_email"),
        first(F.when(leader, F.struct("full_name", "title")), leader).alias("ct_decision_maker"),
        first(F.when(phone, F.col("phone_e164")), phone).alias("ct_phone"),
        F.count_if(mail_ok).alias("ct_mails"),
        F.count_if(mail_ok & (F.col("email_type") == "role")).alias("ct_role_mails"),
    )
    return facts


_OPTIONAL = {
    "industry": "string", "country": "string", "state": "string", "employee_count": "int",
    "website_status": "string", "has_ssl": "boolean", "hiring": "boolean",
    "hiring_evidence": "string", "modern_stack": "boolean", "founded_year": "int",
    "copyright_year": "int", "family_owned": "boolean", "family_owned_hint": "string",
    "low_confidence_merge": "boolean",
}


def lead_facts(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """Companies with every column the rules read; absent signals are NULL."""
    missing = {c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in companies.columns}
    if "hiring_evidence" in companies.columns and isinstance(
        companies.schema["hiring_evidence"].dataType, T.ArrayType
    ):
        missing["hiring_evidence"] = F.get("hiring_evidence", F.lit(0))
    return companies.withColumns(missing).join(contact_facts(contacts), "id", "left")


def _with_reasons(facts: DataFrame, profile: Profile, year: int, prefix: str) -> DataFrame:
    return facts.withColumns(
        {f"{prefix}{rule}": RULES[rule](profile, year) for rule in profile.points()}
    )


def _total(profile: Profile, prefix: str) -> Column:
    total = F.lit(0)
    for rule, pts in profile.points().items():
        total = total + F.when(F.col(f"{prefix}{rule}").isNotNull(), pts).otherwise(0)
    return total


def _breakdown(profile: Profile, prefix: str) -> Column:
    """Fired rules, most points first, ties in strategy order."""
    items = [
        F.struct(
            F.lit(-pts).alias("down"),
            F.lit(pos).alias("pos"),
            F.lit(rule).alias("rule"),
            F.lit(pts).alias("points"),
            F.col(f"{prefix}{rule}").alias("reason"),
        )
        for pos, (rule, pts) in enumerate(profile.points().items())
    ]
    if not items:
        return F.array().cast("array<struct<rule:string,points:int,reason:string>>")
    fired = F.array_sort(F.filter(F.array(*items), lambda x: x["reason"].isNotNull()))
    return F.transform(fired, lambda x: F.struct(x["rule"], x["points"], x["reason"]))


def score_leads(facts: DataFrame, profile: Profile, as_of_year: int) -> DataFrame:
    """Adds mode, raw_total, score, grade and breakdown; a projection, no shuffle."""
    reasons = _with_reasons(facts, profile, as_of_year, "why_")
    total = _total(profile, "why_")
    score = F.greatest(F.lit(0), F.least(F.lit(100), total))
    return (
        reasons.withColumns(
            {
                "mode": F.lit(profile.strategy),
                "raw_total": total,
                "score": score,
                "breakdown": _breakdown(profile, "why_"),
            }
        )
        .withColumn("grade", grade_for("score"))
        .drop(*[f"why_{rule}" for rule in profile.points()])
    )


def score_under_profiles(facts: DataFrame, profiles: list[Profile], as_of_year: int) -> DataFrame:
    """The same leads under several profiles: one scan, rows multiplied by a literal array."""
    out = facts
    results = []
    for i, p in enumerate(profiles):
        prefix = f"why{i}_"
        out = _with_reasons(out, p, as_of_year, prefix)
        total = _total(p, prefix)
        results.append(
            F.struct(
                F.lit(p.name).alias("profile"),
                F.lit(p.strategy).alias("mode"),
                F.greatest(F.lit(0), F.least(F.lit(100), total)).alias("score"),
                _breakdown(p, prefix).alias("breakdown"),
            )
        )
    return out.select(*facts.columns, F.inline(F.array(*results))).withColumn(
        "grade", grade_for("score")
    )


def rescore_all(companies: DataFrame, contacts: DataFrame, table: DataFrame, name: str,
                as_of_year: int) -> tuple[DataFrame, DataFrame]:
    """Activate a profile and score every company under it: (profiles, scored companies)."""
    switched = activate(table, name)
    scored = score_leads(lead_facts(companies, contacts), active_profile(switched), as_of_year)
    return switched, scored


def top_reasons(breakdown: Column | str, n: int) -> Column:
    b = F.col(breakdown) if isinstance(breakdown, str) else breakdown
    good = F.filter(b, lambda x: x["points"] > 0)
    return F.slice(F.transform(good, lambda x: x["reason"]), 1, n)


def breakdown_rows(scored: DataFrame) -> DataFrame:
    """One row per fired rule, with its bar length relative to the largest."""
    biggest = F.array_max(F.transform("breakdown", lambda x: F.abs(x["points"])))
    return (
        scored.select("id", biggest.alias("biggest"), F.posexplode("breakdown").alias("pos", "item"))
        .select("id", "pos", "item.rule", "item.points", "item.reason",
                (F.abs("item.points") / F.col("biggest")).alias("share"))
    )


def clamp_explanation(scored: DataFrame) -> DataFrame:
    return scored.select(
        "id", "raw_total", "score", (F.col("raw_total") != F.col("score")).alias("clamped")
    )
