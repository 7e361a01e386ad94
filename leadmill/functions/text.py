"""Page source to text, and the small text rewrites the extractors need."""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\r\n"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=1)
def _named() -> dict[str, str]:
    """Named character references of HTML 5, from the standard library's table; a no-break space is a space.

    Names that may stand without a semicolon are in it twice. The names of HTML 4 come first, as they are met most.
    """
    names = sorted(html5, key=lambda n: n.rstrip(";") not in name2codepoint)
    return {f"&{n}": html5[n].replace("\u00a0", " ") for n in names}


@lru_cache(maxsize=1)
def _bare() -> str:
    """Pattern of the names that need no semicolon, longest first."""
    return "^&(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"


#: What the numbers 128 to 159 stand for.
WINDOWS = {n: ord(bytes([n]).decode("cp1252")) for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}


def _numbered(ref: Column) -> Column:
    """The character of &#n; or &#xn;, NULL if there is none."""
    digits = F.regexp_replace(F.regexp_extract(ref, "^&#[xX]?([0-9a-fA-F]+);?$", 1), "^0+(?=.)", "")
    hexed = ref.rlike("^&#[xX]")
    code = F.when(F.length(digits) > 8, F.lit(None)).when(hexed, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    windows = F.from_json(F.lit(json.dumps({str(k): v for k, v in WINDOWS.items()})), "map<string,bigint>")
    code = F.when(code == 160, F.lit(32)).when(code.between(128, 159), F.coalesce(F.try_element_at(windows, code.cast("string")), code)).otherwise(code)
    fits = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode_entities(c: Column, attribute: bool = False) -> Column:
    """Character references to characters, each once (what they give is not read again); unknown ones stay.

    Numbers and the names that HTML 5 lists so may lack the semicolon; in an ``attribute`` such a name stays before
    ``=``, a letter or a digit, as HTML 5 has it.
    """
    named = F.from_json(F.lit(json.dumps(_named())), "map<string,string>")

    def value(ref):
        known = F.coalesce(F.when(ref.startswith("&#"), _numbered(ref)), F.try_element_at(named, ref))
        if attribute:
            return F.coalesce(known, ref)
        bare = F.when(~ref.endswith(";"), F.regexp_extract(ref, _bare(), 0))
        return F.coalesce(known, F.concat(F.try_element_at(named, bare), F.substring(ref, F.length(bare) + 1, F.length(ref))), ref)

    end = "(?:;|(?!=))" if attribute else ";?"
    pattern = f"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+{end})"
    refs, parts = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    out = F.concat(F.get(parts, F.lit(0)), F.array_join(F.zip_with(refs, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda r, p: F.concat(value(r), p)), ""))
    return F.when(c.contains("&"), out).otherwise(c)


def html_blocks(html: Column | str) -> Column:
    """Non-empty text pieces of the body in document order; scripts and styles left out."""
    t = F.regexp_replace(_col(html), r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<script\b.*?</script\s*>", "<s>")
    t = F.regexp_replace(t, r"(?is)<style\b.*?</style\s*>", "<s>")
    t = F.regexp_replace(t, r"(?is)<head\b.*?</head\s*>", "")
    t = F.regexp_replace(t, r"(?is)<title\b.*?</title\s*>", "")
    pieces = F.transform(
        F.split(t, r"<[^>]*>"), lambda x: F.trim(decode_entities(x), F.lit(WHITE))
    )
    return F.filter(pieces, lambda x: x != "")


def html_text(html: Column | str) -> Column:
    return F.array_join(html_blocks(html), " ")


def html_lines(html: Column | str) -> Column:
    """One array entry per text line."""
    lines = F.split(F.array_join(html_blocks(html), "\n"), r"\r\n|\n|\r")
    return F.filter(
        F.transform(lines, lambda x: F.trim(x, F.lit(WHITE))), lambda x: x != ""
    )


def deobfuscate(c: Column | str) -> Column:
    """'john [at] acme [dot] com' -> 'john@acme.com'; a bare at only before a bracketed dot."""
    t = F.regexp_replace(
        _col(c),
        r"(?i)\s*[\[\(\{]\s*at\s*[\]\)\}]\s*|\s+at\s+(?=[a-z0-9-]+\s*[\[\(\{]\s*dot)",
        "@",
    )
    return F.regexp_replace(t, r"(?i)\s*[\[\(\{]\s*dot\s*[\]\)\}]\s*", ".")


def percent_decode(c: Column | str) -> Column:
    raw = _col(c)
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def title_case(c: Column | str) -> Column:
    """Capital after every non-letter, the rest lower ('co-owner' -> 'Co-Owner')."""
    letters = F.split(F.lower(_col(c)), "")
    return F.array_join(
        F.transform(
            letters,
            lambda x, i: F.when(
                (i == 0) | ~F.coalesce(F.get(letters, i - 1), F.lit(" ")).rlike(r"\p{L}"), F.upper(x)
            ).otherwise(x),
        ),
        "",
    )


def meta_content(html: Column | str, attribute: str, value: str) -> Column:
    """Raw content of the first <meta attribute="value">, either attribute order, '' if none."""
    h = _col(html)
    q = r"""["']"""
    body = r"""["']([^"'>]*)["']"""
    key = rf"{attribute}\s*=\s*{q}{value}{q}"
    return F.concat(
        F.regexp_extract(h, rf"(?is)<meta\b[^>]*{key}[^>]*content\s*=\s*{body}", 1),
        F.regexp_extract(h, rf"(?is)<meta\b[^>]*content\s*=\s*{body}[^>]*{key}", 1),
    )


def page_title(html: Column | str) -> Column:
    return F.regexp_extract(_col(html), r"(?is)<title\b[^>]*>(.*?)</title", 1)


def head_texts(html: Column | str) -> Column:
    """[title, description, og description, twitter description, site name], decoded; '' if absent."""
    title = decode_entities(page_title(html))
    raw = F.array(
        meta_content(html, "name", "description"),
        meta_content(html, "property", "og:description"),
        meta_content(html, "name", "twitter:description"),
        meta_content(html, "property", "og:site_name"),
    )
    texts = F.concat(F.array(title), F.transform(raw, lambda x: decode_entities(x, attribute=True)))
    return F.transform(texts, lambda x: F.trim(x, F.lit(WHITE)))
