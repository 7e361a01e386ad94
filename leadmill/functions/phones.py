"""Phone numbers: region lookup, E.164 form, validity and kind, by numbering-plan rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill import lexicons as lx
from leadmill.functions.normalize import let


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def region_for(country: Column | str) -> Column:
    c = F.trim(_col(country))
    out = F.when(c.rlike(r"^\p{L}{2}$"), F.upper(c)).otherwise("US")
    for name, region in reversed(list(lx.COUNTRY_ALIASES.items())):
        out = F.when(F.lower(c) == name, region).otherwise(out)
    return F.when(c.isNull() | (c == ""), "US").otherwise(out)


def _dialled(raw: Column) -> Column:
    """The number part of the text, '' if other characters are mixed in."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?i)[\s,;]*(ext\.?|extension|x|#)\s*\d{1,7}\s*$", "")
    t = F.regexp_replace(t, r"^[^+0-9]+|[^0-9]+$", "")
    return F.when(t.rlike(r"^\+?[0-9][0-9 ().\-/]*$"), t).otherwise("")


def dialled(raw: Column | str) -> Column:
    """struct<world, digits>: whether it starts with +, and its digits."""
    return let(
        _dialled(_col(raw)),
        lambda t: F.struct(
            t.startswith("+").alias("world"), F.regexp_replace(t, "[^0-9]", "").alias("digits")
        ),
    )


def number_of(parts: Column, region: Column | str, plans: dict | None = None) -> Column:
    """E.164 form of a dialled number that is valid under its numbering plan, else NULL."""
    plans = plans or lx.PHONE_PLANS
    world, digits, reg = parts["world"], parts["digits"], _col(region)
    forms = {}
    for name, (code, trunk, pattern) in plans.items():
        # behind the country code an optional trunk 0; at home an optional trunk prefix,
        # or the country code without a plus
        full = rf"^{code}(?:{trunk if trunk == '0' else ''})?({pattern})$"
        local = rf"^(?:{trunk})?({pattern})$" if trunk else rf"^({pattern})$"
        forms.setdefault(code, [full, []])[1].append((name, local))
    found = []
    for code, (full, homes) in forms.items():
        coded = F.concat(F.lit("+" + code), F.regexp_extract(digits, full, 1))
        found.append(F.when(world & digits.startswith(code) & digits.rlike(full), coded))
        for name, local in homes:
            home = ~world & (reg == name)
            near = F.concat(F.lit("+" + code), F.regexp_extract(digits, local, 1))
            found.append(F.when(home, F.when(digits.rlike(local), near).when(digits.rlike(full), coded)))
    return F.coalesce(*found)


def to_e164(raw: Column | str, region: Column | str, plans: dict | None = None) -> Column:
    """E.164 form of a valid number, else NULL; never a guess."""
    return let(dialled(raw), lambda parts: number_of(parts, region, plans))


def phone_kind(e164: Column | str, plans: dict | None = None) -> Column:
    """toll_free, mobile, voip, fixed_line or fixed_line_or_mobile for a valid number, else NULL.

    No calling code begins with another, so one branch per code decides; within it the first range that fits.
    """
    num = _col(e164)
    found = []
    for code in dict.fromkeys(plan[0] for plan in (plans or lx.PHONE_PLANS).values()):
        nsn = F.substring(num, len(code) + 2, 20)
        kind = F.lit("fixed_line_or_mobile" if code == "1" else "fixed_line")
        for name, ranges in (("mobile", lx.MOBILE), ("voip", lx.VOIP), (None, lx.OTHER_KINDS), ("toll_free", lx.TOLL_FREE)):
            if code in ranges:
                kind = F.when(nsn.rlike(ranges[code]), F.lit(name).cast("string")).otherwise(kind)
        found.append(F.when(num.startswith("+" + code), kind))
    return F.coalesce(*found)
