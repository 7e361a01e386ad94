"""Row normalisation: blanks, numbers, domains, names, e-mail and title tests."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill import lexicons as lx


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_of(c: Column, values) -> Column:
    return c.isin(list(values))


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, NULL for the usual spellings of "no value"."""
    t = F.regexp_replace(_col(c), r"^\s+|\s+$", "")
    return F.when(~one_of(F.lower(t), lx.BLANK_WORDS), t)


def parse_number(c: Column | str) -> Column:
    """First number in the text with an optional k/m/b right behind it, as bigint."""
    t = F.lower(F.replace(_col(c), F.lit(","), F.lit("")))
    pattern = r"(\d+(?:\.\d+)?)\s*([kmb])?"
    unit = F.regexp_extract(t, pattern, 2)
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    return (F.regexp_extract(t, pattern, 1).try_cast("double") * factor).try_cast("bigint")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def host_of(c: Column | str) -> Column:
    """Host of a URL, bare host, address or mailto: text; NULL if there is none."""

    def host(t):
        bare = F.when(t.contains("@") & ~t.contains("/"), F.substring_index(t, "@", -1)).otherwise(t)
        netloc = F.regexp_extract(bare, r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1)
        named = F.regexp_replace(F.substring_index(netloc, "@", -1), r":.*$", "")
        return F.regexp_replace(named, r"^\.+|\.+$", "")

    text = F.lower(F.regexp_replace(_col(c), r"^\s+|\s+$", ""))
    found = let(F.regexp_replace(text, r"^mailto:", ""), host)
    return let(found, lambda h: F.when((h != "") & ~h.rlike(r"\s"), h))


def suffix_labels(labels: Column, rules=tuple(lx.SUFFIX_RULES)) -> Column:
    """How many of the last labels of a host are its public suffix; NULL if none is.

    The longest matching rule wins, an exception beats them all.
    """
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    last, second = F.get(labels, n - 1), F.get(labels, n - 2)
    two = last.rlike("^[a-z]{2}$") & ~one_of(last, lx.DIRECT_CODES) & one_of(second, lx.SECOND_LABELS)
    found = F.when(two, 2).when(last.rlike("^(?:[a-z]{2,}|xn--[a-z0-9-]+)$") & ~one_of(last, lx.NOT_SUFFIXES), 1)
    size = lambda rule: rule.count(".") + 1
    for k in sorted({size(r) for r in rules}):
        plain = [r for r in rules if size(r) == k and r[0] not in "*!"]
        if plain:
            found = F.when((n >= k) & one_of(tail(k), plain), F.greatest(F.lit(k), F.coalesce(found, F.lit(1)))).otherwise(found)
        wild = [r[2:] for r in rules if size(r) == k and r.startswith("*.")]
        if wild:
            found = F.when((n >= k) & one_of(tail(k - 1), wild), F.greatest(F.lit(k), F.coalesce(found, F.lit(1)))).otherwise(found)
    for k in sorted({size(r) for r in rules if r.startswith("!")}):
        except_ = [r[1:] for r in rules if r.startswith("!") and size(r) == k]
        found = F.when((n >= k) & one_of(tail(k), except_), F.lit(k - 1)).otherwise(found)
    return found


def canonical_domain(c: Column | str, rules=tuple(lx.SUFFIX_RULES)) -> Column:
    """Registrable domain: the public suffix plus one label, else NULL."""

    def registrable(labels):
        keep = let(suffix_labels(labels, rules), lambda k: F.when(k < F.size(labels), F.array_join(F.slice(labels, F.size(labels) - k, k + 1), ".")))
        return F.when(~F.array_contains(labels, ""), keep)

    return let(F.split(host_of(c), r"\."), registrable)


def website_url(domain: Column | str) -> Column:
    return F.concat(F.lit("https://"), _col(domain))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Compatibility folding to ASCII, derived from the Unicode tables.

    Returns the one-to-one part as two aligned strings and the rest as a map.
    """
    single_from, single_to, longer = [], [], {}
    ranges = [(0xA0, 0x250), (0x1E00, 0x1F00), (0x2000, 0x2070), (0x2100, 0x2140),
              (0xFB00, 0xFB07), (0xFF01, 0xFF5F)]
    for lo, hi in ranges:
        for code in range(lo, hi):
            ch = chr(code)
            folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
            if len(folded) == 1:
                single_from.append(ch)
                single_to.append(folded)
            elif folded:
                longer[ch] = folded
    return "".join(single_from), "".join(single_to), longer


def fold_ascii(c: Column | str) -> Column:
    """NFKD to ASCII; characters without an ASCII form are dropped."""
    raw = _col(c)
    frm, to, longer = _folding()
    folded = F.translate(raw, frm, to)
    for ch, text in longer.items():
        folded = F.replace(folded, F.lit(ch), F.lit(text))
    folded = F.regexp_replace(folded, r"[^\x00-\x7F]", "")
    return F.when(raw.rlike(r"[^\x00-\x7F]"), folded).otherwise(raw)


def company_name_key(c: Column | str) -> Column:
    """Comparison form of a company name; '' when nothing comparable is left."""
    t = F.lower(fold_ascii(F.regexp_replace(_col(c), "’", "'")))
    t = F.replace(t, F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(t, "'", "")
    t = F.regexp_replace(t, r"[^a-z0-9_\s]", " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    t = F.regexp_replace(t, f"( ({'|'.join(lx.LEGAL_SUFFIXES)}))+$", "")
    t = F.regexp_replace(t, r"(^| )l l c$", "")
    t = F.regexp_replace(t, r"^the (?=.)", "")
    return F.coalesce(t, F.lit(""))


def display_name(c: Column | str) -> Column:
    t = F.regexp_replace(_col(c), r"\s+", " ")
    return F.coalesce(F.regexp_replace(t, r"^[ ,.\-]+|[ ,.\-]+$", ""), F.lit(""))


def sorted_tokens(c: Column | str) -> Column:
    return F.array_join(F.array_sort(F.split(_col(c), " ")), " ")


def lead_domain(website: Column | str, email: Column | str) -> Column:
    """Own domain, else the e-mail's domain unless that is a free-mail host."""
    from_mail = let(canonical_domain(email), lambda d: F.when(~one_of(d, lx.FREE_MAIL), d))
    return F.coalesce(canonical_domain(website), from_mail)


def lead_name(name: Column | str, domain: Column | str) -> Column:
    shown = display_name(name)
    return F.when(shown != "", shown).otherwise(F.coalesce(_col(domain), F.lit("")))


def place_key(city: Column | str) -> Column:
    """Comparable city, NULL (= fits any place) when missing."""
    t = _col(city)
    return F.when(t != "", F.lower(F.trim(t)))


def same_place(a: Column | str, b: Column | str) -> Column:
    pa, pb = place_key(a), place_key(b)
    return pa.isNull() | pb.isNull() | (pa == pb)


def email_norm(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))


def email_host(c: Column | str) -> Column:
    return F.substring_index(email_norm(c), "@", -1)


def email_syntax_ok(c: Column | str) -> Column:
    e = email_norm(c)
    local = F.substring_index(e, "@", 1)
    tld = F.substring_index(e, ".", -1)
    return (
        e.rlike(lx.EMAIL_SYNTAX)
        & (F.length(local) <= 64)
        & (F.length(e) <= 254)
        & ~one_of(tld, lx.RESERVED_TLDS)
    )


def mailbox_type(c: Column | str) -> Column:
    """'role' or 'personal', NULL on bad syntax."""
    local = F.substring_index(F.substring_index(email_norm(c), "@", 1), "+", 1)
    kind = F.when(one_of(local, lx.ROLE_MAILBOXES), "role").otherwise("personal")
    return F.when(email_syntax_ok(c), kind)


def email_verdict(c: Column | str, has_mx: Column | str) -> Column:
    """Syntax, then disposable hosts, then the MX answer (NULL = no answer)."""
    mx = _col(has_mx)
    return (
        F.when(~email_syntax_ok(c), "invalid_syntax")
        .when(one_of(email_host(c), lx.DISPOSABLE_HOSTS), "disposable")
        .when(mx.isNull(), "unknown")
        .when(mx, "valid_mx")
        .otherwise("no_mx")
    )


def person_mailboxes(full_name: Column | str) -> Column:
    """Local parts (dots and underscores removed) that belong to a person; empty if unclear."""
    words = F.filter(
        F.split(F.lower(F.trim(_col(full_name))), r"\s+"), lambda w: w.rlike(r"^\p{L}+$")
    )
    first, last = F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)
    forms = F.array_distinct(
        F.array(
            first,
            F.concat(first, last),
            F.concat(F.substring(first, 1, 1), last),
            F.concat(last, F.substring(first, 1, 1)),
            last,
        )
    )
    return F.when(F.size(words) >= 2, forms).otherwise(F.array().cast("array<string>"))


def bare_mailbox(email: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.substring_index(_col(email), "@", 1)), "[._]", "")


def email_matches_person(email: Column | str, full_name: Column | str) -> Column:
    return F.array_contains(person_mailboxes(full_name), bare_mailbox(email))


def is_decision_maker(title: Column | str) -> Column:
    t = F.lower(_col(title))
    return F.coalesce(
        t.rlike("|".join(re.escape(w) for w in lx.DECISION_TITLES)) & ~t.contains("assistant"),
        F.lit(False),
    )


def grade_for(score: Column | str) -> Column:
    s = _col(score)
    out = F.lit("D")
    for floor, grade in reversed(lx.GRADE_FLOORS):
        out = F.when(s >= floor, grade).otherwise(out)
    return F.when(s.isNotNull(), out)
