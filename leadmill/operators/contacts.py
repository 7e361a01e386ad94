"""Contacts: merge what the site says into what is known, then validate.

Rows are ordered inside a company by (phase, seq): known contacts, people, e-mails, phone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.functions import normalize as nz
from leadmill.functions.phones import region_for, to_e164
from leadmill.operators.ranking import first_k
from leadmill.session import checkpoint

#: Parts that the rows of one mail host are dealt to.
SALTS = 64
FIELDS = ["company_id", "phase", "seq", "full_name", "title", "email", "phone_e164", "is_decision_maker", "source"]


def _empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def merge_people(contacts: DataFrame, people: DataFrame) -> DataFrame:
    """People of the site (company_id, pos, full_name, title, is_decision_maker) join the
    contact of the same name (the last one, if several) or become contacts."""
    known = contacts.select(
        "company_id",
        F.lit(0).alias("phase"),
        F.col("seq").cast("bigint"),
        *[F.col(c).cast("string") for c in ("full_name", "title", "email", "phone_e164")],
        F.coalesce("is_decision_maker", F.lit(False)).alias("is_decision_maker"),
        F.col("source").cast("string") if "source" in contacts.columns else F.lit("csv").alias("source"),
    )
    person = (
        people.withColumn("who", F.lower("full_name")).groupBy("company_id", "who").agg(
            F.min("pos").alias("pos"),
            F.min_by("full_name", "pos").alias("p_name"),
            F.min_by("title", "pos").alias("p_first_title"),
            F.min_by("title", F.when(~_empty("title"), F.col("pos"))).alias("p_title"),
            F.bool_or("is_decision_maker").alias("p_leader"),
        )
    )
    named = known.filter(~_empty("full_name")).groupBy("company_id", F.lower("full_name").alias("who")).agg(
        F.max("seq").alias("seq")
    )
    match = person.join(named, ["company_id", "who"], "left")
    patch = match.filter("seq IS NOT NULL").select("company_id", "seq", "p_title", "p_leader")
    updated = known.join(patch, ["company_id", "seq"], "left").select(
        "company_id", "phase", "seq", "full_name",
        F.when(_empty("title"), F.coalesce("p_title", "title")).otherwise(F.col("title")).alias("title"),
        "email", "phone_e164",
        (F.col("is_decision_maker") | F.coalesce("p_leader", F.lit(False))).alias("is_decision_maker"),
        "source",
    )
    none = F.lit(None).cast("string")
    added = match.filter("seq IS NULL").select(
        "company_id", F.lit(1).alias("phase"), F.col("pos").cast("bigint").alias("seq"),
        F.col("p_name").alias("full_name"), F.coalesce("p_title", "p_first_title").alias("title"),
        none.alias("email"), none.alias("phone_e164"), F.col("p_leader").alias("is_decision_maker"),
        F.lit("website").alias("source"),
    )
    return updated.unionByName(added)


def claim_emails(contacts: DataFrame, emails: DataFrame) -> DataFrame:
    """Each new address (company_id, pos, email) goes to the first contact it fits that has
    no address yet, one address per contact; the others become nameless contacts.

    A company has at most 20 addresses, so of the contacts fitting one mailbox only the
    first 20 can be reached: cutting there is exact, and the greedy choice folds over at
    most 400 pairs per company however many contacts it has.
    """
    have = contacts.filter(~_empty("email")).select("company_id", F.lower("email").alias("email")).distinct()
    new = emails.join(have, ["company_id", "email"], "left_anti").withColumn("box", nz.bare_mailbox("email"))
    wanted = new.select("company_id", "box").distinct()
    free = contacts.filter(~_empty("full_name") & _empty("email")).select(
        "company_id", "phase", "seq", F.explode(nz.person_mailboxes("full_name")).alias("box")
    )
    free = first_k(
        free.join(wanted, ["company_id", "box"], "left_semi"),
        ["company_id", "box"], [F.col("phase"), F.col("seq")], lx.MAX_EMAILS, "turn",
    ).drop("turn")
    pairs = new.join(free, ["company_id", "box"]).groupBy("company_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "phase", "seq", "email"))).alias("pairs")
    )
    taken = F.aggregate(
        "pairs",
        F.array().cast("array<struct<pos:int,phase:int,seq:bigint,email:string>>"),
        lambda acc, x: F.when(
            F.exists(
                acc,
                lambda a: (a["email"] == x["email"]) | ((a["phase"] == x["phase"]) & (a["seq"] == x["seq"])),
            ),
            acc,
        ).otherwise(F.concat(acc, F.array(F.struct(
            x["pos"].cast("int").alias("pos"), x["phase"].cast("int").alias("phase"),
            x["seq"].cast("bigint").alias("seq"), x["email"].alias("email"))))),
    )
    claims = pairs.select("company_id", F.inline(taken)).select(
        "company_id", "phase", "seq", F.col("email").alias("claimed")
    )
    updated = contacts.join(claims, ["company_id", "phase", "seq"], "left").withColumn(
        "email", F.coalesce("claimed", "email")
    ).select(*FIELDS)
    used = claims.select("company_id", F.col("claimed").alias("email"))
    none = F.lit(None).cast("string")
    rest = new.join(used, ["company_id", "email"], "left_anti").select(
        "company_id", F.lit(2).alias("phase"), F.col("pos").cast("bigint").alias("seq"),
        none.alias("full_name"), none.alias("title"), "email", none.alias("phone_e164"),
        F.lit(False).alias("is_decision_maker"), F.lit("website").alias("source"),
    )
    return updated.unionByName(rest)


def assign_phones(contacts: DataFrame, phones: DataFrame) -> DataFrame:
    """The main phone (company_id, phone) goes to the first decision maker without one, else
    the first contact without one; a company without contacts gets a new one."""
    open_key = F.struct((~F.col("is_decision_maker")).alias("a"), F.col("phase").alias("b"), F.col("seq").alias("c"))
    target = contacts.groupBy("company_id").agg(
        F.min(F.when(_empty("phone_e164"), open_key)).alias("t")
    )
    plan = phones.join(target, "company_id", "left")
    gets = plan.filter("t IS NOT NULL").select(
        "company_id", F.col("t.b").alias("phase"), F.col("t.c").alias("seq"), "phone"
    )
    updated = contacts.join(gets, ["company_id", "phase", "seq"], "left").withColumn(
        "phone_e164", F.coalesce("phone", "phone_e164")
    ).select(*FIELDS)
    none = F.lit(None).cast("string")
    known = contacts.select("company_id").distinct()
    added = phones.join(known, "company_id", "left_anti").select(
        "company_id", F.lit(3).alias("phase"), F.lit(0).cast("bigint").alias("seq"), none.alias("full_name"),
        none.alias("title"), none.alias("email"), F.col("phone").alias("phone_e164"),
        F.lit(False).alias("is_decision_maker"), F.lit("website").alias("source"),
    )
    return updated.unionByName(added)


def merge_contacts(contacts: DataFrame, found: DataFrame) -> DataFrame:
    """People, then e-mails, then the main phone; ``found`` has company_id and the arrays
    people, emails and phones of fixed maximum size."""
    people = found.select("company_id", F.posexplode("people").alias("pos", "p")).select("company_id", "pos", "p.*")
    emails = found.select("company_id", F.posexplode("emails").alias("pos", "email"))
    phones = found.filter(F.size("phones") > 0).select("company_id", F.get("phones", F.lit(0)).alias("phone"))
    # each step reads its input several times: written once, not recomputed
    named = checkpoint(merge_people(contacts, people))
    return assign_phones(checkpoint(claim_emails(named, emails)), phones)


def mx_answers(addresses: DataFrame, mx: DataFrame) -> DataFrame:
    """(host, has_mx) for the distinct hosts of the addresses; the MX table is joined to
    hosts, not to rows, so a free-mail host with a third of all rows counts once."""
    hosts = addresses.filter(nz.email_syntax_ok("email")).select(nz.email_host("email").alias("host")).distinct()
    return hosts.join(mx.select(F.col("domain").alias("host"), "has_mx"), "host", "left")


def check_emails(contacts: DataFrame, mx: DataFrame) -> DataFrame:
    """Adds e-mail status and type; rows without an address keep status 'unknown'.

    The MX table is one row per host. Rows are salted towards it so that one very common
    host is spread over many tasks.
    """
    given = contacts.filter(~_empty("email"))
    answers = mx_answers(given, mx).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = given.withColumns(
        {"host": nz.email_host("email"), "salt": F.pmod(F.xxhash64("email"), F.lit(SALTS)).cast("int")}
    )
    both = rows.join(answers, ["host", "salt"], "left").drop("salt", "host")
    checked = both.withColumns(
        {"email_status": nz.email_verdict("email", "has_mx"), "email_type": nz.mailbox_type("email"), "email": nz.email_norm("email")}
    ).drop("has_mx")
    return checked.unionByName(
        contacts.filter(_empty("email")).withColumns({"email_status": F.lit("unknown"), "email_type": F.lit(None).cast("string")})
    )


def validate_contacts(contacts: DataFrame, mx: DataFrame, companies: DataFrame) -> DataFrame:
    """Titles imply decision makers; e-mails and phones are checked (a phone that fails keeps
    its raw text). ``companies`` gives (id, country)."""
    titled = contacts.withColumn(
        "is_decision_maker", F.col("is_decision_maker") | nz.is_decision_maker("title")
    )
    checked = check_emails(titled, mx)
    home = companies.select(F.col("id").alias("company_id"), "country")
    placed = checked.join(home, "company_id", "left")
    e164 = to_e164("phone_e164", region_for("country"))
    return placed.withColumn("_e164", e164).withColumns(
        {
            "phone_valid": F.col("_e164").isNotNull(),
            "phone_e164": F.coalesce("_e164", "phone_e164"),
        }
    ).drop("_e164", "country")
