"""Companies and roles as column expressions."""

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .text import (
    FLAGS,
    address_of,
    domain_of_address,
    finds,
    finds_if,
    first_group,
    may_hold,
    strip,
    swap,
    under_any,
)


def _accent_table() -> tuple[str, str]:
    """Every character of the basic plane whose compatibility form is one plain character."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        bare = [c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)]
        if len(bare) == 1 and bare[0] != char and ord(bare[0]) < 0x250:
            source.append(char)
            target.append(bare[0])
    return "".join(source), "".join(target)


def _ligatures() -> dict[str, str]:
    """Latin and letter-like characters whose compatibility form is several characters."""
    found = {}
    for code in (*range(0x80, 0x250), *range(0x2100, 0x2150), *range(0xFB00, 0xFB07)):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char)
        bare = "".join(c for c in plain if not unicodedata.combining(c))
        if len(bare) > 1 and bare.isascii() and bare.isalpha():
            found[char] = bare
    return found


_FROM, _TO = _accent_table()
_LIGATURES = _ligatures()


def fold_accents(text: Column) -> Column:
    """Compatibility letters to plain ones, accents dropped."""
    out = F.translate(text, _FROM, _TO)
    for char, plain in _LIGATURES.items():
        out = F.replace(out, F.lit(char), F.lit(plain))
    return F.regexp_replace(out, r"\p{Mn}+", "")


def _plain(text: Column) -> Column:
    return strip(swap(swap(fold_accents(text), r"[^\w\s.&+-]", " "), r"\s+", " "))


_SUFFIXES = "|".join(re.escape(s) for s in sorted(V.LEGAL_SUFFIXES, key=len, reverse=True))


def normalise_company(name: Column) -> Column:
    """A company name without accents, punctuation and legal forms, stacked or not."""
    bare = swap(_plain(F.lower(name)), rf"(?:(?:^|\s+)(?:{_SUFFIXES}))+\z", "")
    return strip(swap(F.regexp_replace(bare, r"[ .&+-]+$", ""), r"\s+", " "))


def company_key(name: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(normalise_company(name), r"[^\p{L}\p{N}]", "")


def country_of(location: Column) -> Column:
    lowered = F.lower(location)
    out = F.when(location.isNull(), None)
    for places, code in V.COUNTRIES:
        out = out.when(lowered.rlike("|".join(re.escape(p) for p in places)), code)
    return out.otherwise("unknown")


# --- roles ------------------------------------------------------------------------------


def _list(values) -> Column:
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def _map(pairs: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in pairs.items()) + ")")


def _is_place(segment: Column) -> Column:
    s = F.lower(strip(segment))
    words = F.split(s, r"\s+")
    places = _list(V.PLACES)
    return (s != "") & (
        F.array_contains(places, s) | ((F.size(words) <= 3) & F.arrays_overlap(words, places))
    )


_TERMS = "|".join(re.escape(t) for t in V.CONTRACT_TERMS)


def normalise_role(raw: Column) -> dict[str, Column]:
    """role, seniority, location and work mode out of a job title."""
    mode = F.when(raw.isNull(), None)
    for pattern, name in V.WORK_MODES:
        mode = mode.when(finds(raw, pattern), name)
    bracket = V.TITLE_BRACKETS
    inside = F.filter(F.regexp_extract_all(raw, F.lit(bracket), F.lit(1)), _is_place)
    bracket_place = strip(F.try_element_at(inside, F.lit(-1)))
    outside = F.regexp_replace(raw, bracket, " ")
    segments = F.filter(
        F.transform(F.split(outside, FLAGS + V.TITLE_SEGMENTS), strip),
        lambda s: s != "",
    )
    ends = F.array_position(
        F.transform(
            segments,
            lambda s, i: (i > 0) & (_is_place(s) | F.lower(s).rlike(_TERMS)),
        ),
        True,
    ).cast("int")
    last = F.get(segments, ends - 1)
    kept = F.when(ends > 0, F.slice(segments, F.lit(1), F.greatest(ends - 1, F.lit(0)))).otherwise(segments)
    segment_place = F.when((ends > 0) & _is_place(last), last)
    title = _plain(F.lower(swap(F.array_join(kept, " "), rf"\b(?:{_TERMS})\b", " ")))
    words = F.transform(F.split(title, " "), lambda w: F.regexp_replace(w, r"\.+$", ""))
    levels = _map(V.SENIORITY)
    longer = _map(V.EXPANSIONS)
    said = F.filter(F.transform(words, lambda w: levels[w]), lambda x: x.isNotNull())
    rest = F.transform(
        F.filter(words, lambda w: levels[w].isNull()), lambda w: F.coalesce(longer[w], w)
    )
    return {
        "role": strip(swap(F.array_join(rest, " "), r"\s+", " ")),
        "seniority": F.get(said, F.lit(0)),
        "location": F.coalesce(F.nullif(bracket_place, F.lit("")), segment_place),
        "work_mode": mode,
    }


def _clean_role(found: Column) -> Column:
    role = strip(swap(found, r"\s+", " "))
    role = strip(swap(role, V.SENTENCE_RESUMES, ""))
    role = strip(F.regexp_replace(role, "[-–—:;,]+$", ""))
    fits = (
        F.length(role).between(V.ROLE_MIN_CHARS, V.ROLE_MAX_CHARS)
        & ~finds(role, V.NOT_A_TITLE)
        & (F.size(F.split(role, r"\s+")) <= V.ROLE_MAX_WORDS)
        & finds(role, V.ROLE_VOCABULARY)
    )
    return F.when(fits, role)


def role_from_body(text: Column, low: Column) -> Column:
    """The first pattern that yields something that reads like a job title. `low`: the text in lower case, a column of its own."""
    found = F.array(*[
        F.when(may_hold(low, stems), F.regexp_extract(text, FLAGS + p, 1)).otherwise("")
        for p, stems in zip(V.ROLE_PATTERNS, V.ROLE_STEMS, strict=True)
    ])
    return F.get(F.filter(F.transform(found, _clean_role), lambda r: r.isNotNull()), F.lit(0))


# --- company out of a sender ---------------------------------------------------------------


def company_from_domain(address_or_domain: Column, vendor_domains) -> Column:
    """A domain that belongs to an employer, as a name."""
    domain = F.when(
        F.instr(address_or_domain, "@") > 0, domain_of_address(address_or_domain)
    ).otherwise(F.nullif(F.lower(address_or_domain), F.lit("")))
    other = (
        *V.PERSONAL_MAIL, *V.SOCIAL_NOISE, *V.MEETING_HOSTS, *V.LEARNING_PLATFORMS, *vendor_domains,
    )
    labels = F.split(domain, r"\.")
    label = F.get(labels, F.size(labels) - 2)
    words = F.filter(F.split(label, "-"), lambda w: w != "")
    name = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " "
    )
    return F.when(
        domain.isNotNull() & ~under_any(domain, other) & (F.size(labels) >= 2),
        F.nullif(name, F.lit("")),
    )


def company_from_display_name(header: Column) -> Column:
    shown = first_group(header, V.DISPLAY_NAME)
    written = strip(swap(swap(strip(shown), V.VIA_VENDOR, ""), V.RECRUITING_PREFIX, ""))
    stripped = strip(F.regexp_replace(swap(written, V.RECRUITING_SUFFIX, ""), r"[|·–—-]\s*$", ""))
    labels = F.split(domain_of_address(header), r"\.")
    label = F.when(F.size(labels) >= 2, company_key(F.get(labels, F.size(labels) - 2)))
    whole = (
        (F.coalesce(label, F.lit("")) != "")
        & (stripped != written)
        & (company_key(written) == label)
        & (company_key(stripped) != label)
    )
    name = F.nullif(F.when(whole, written).otherwise(stripped), F.lit(""))
    robot = (~F.contains(name, F.lit(" ")) & finds(name, V.ROBOT_FRAGMENT)) | finds(name, V.ROBOT_NAME)
    return F.when(shown.isNotNull() & ~robot, name)


def is_own_name(header: Column) -> Column:
    """A person whose address is their name."""
    shown = first_group(header, V.DISPLAY_NAME)
    address = F.regexp_extract(header, r"<([^<>]+)>\s*$", 1)
    local = F.regexp_replace(F.lower(F.element_at(F.split(address, "@"), 1)), "[^a-z]", "")
    return F.coalesce((local != "") & (company_key(shown) == local), F.lit(False))


def company_from_sender(header: Column, vendor_domains) -> Column:
    relay = F.coalesce(address_of(header).isin(*V.RELAY_ADDRESSES), F.lit(False))
    by_domain = company_from_domain(header, vendor_domains)
    return (
        F.when(relay, None)
        .when(is_own_name(header), by_domain)
        .otherwise(F.coalesce(company_from_display_name(header), by_domain))
    )


def channel_for_vendor(vendor: Column, domain: Column) -> Column:
    """How a case was found. A referral is never inferred."""
    return (
        F.when(vendor.isin("linkedin", "indeed"), vendor)
        .when(F.coalesce(vendor, F.lit("")) != "", "career_page")
        .when((F.coalesce(domain, F.lit("")) != "") & ~under_any(domain, ("gmail.com",)), "recruiter")
    )


def stage_from_title(title: Column) -> Column:
    out = F.when(title.isNull(), None)
    for pattern, stage in V.TITLE_STAGES:
        out = out.when(finds(title, pattern), stage)
    return out


def phrase_index(text: Column, low: Column) -> Column:
    """Which of the phrases a text contains first in their order, counted from one. `low`: the text in lower case."""
    out = None
    for i, ((_, _, _, pattern), stems) in enumerate(zip(V.PHRASES, V.PHRASE_STEMS, strict=True), start=1):
        hit = finds_if(text, low, pattern, stems)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def phrase_facts(index: Column) -> dict[str, Column]:
    at = index - 1
    return {
        "intent": F.get(F.expr("array(" + ", ".join(f"'{p[0]}'" for p in V.PHRASES) + ")"), at),
        "confidence": F.get(F.expr("array(" + ", ".join(f"{p[1]}D" for p in V.PHRASES) + ")"), at),
        "from_audit": F.get(F.expr("array(" + ", ".join(str(p[2]).lower() for p in V.PHRASES) + ")"), at),
    }


def posting_url(text: Column) -> Column:
    return first_group(text, V.POSTING_URL, 0)


# --- posting pages ----------------------------------------------------------------------------


def _meta(html: Column, name: str) -> Column:
    return first_group(
        html,
        rf"""<meta[^>]+(?:property|name)=["']{re.escape(name)}["'][^>]+content=["']([^"']+)["']""",
    )


def parse_posting(url: Column, html: Column) -> dict[str, Column]:
    """Company, role, place, vendor and pay of a posting page. Structured data is asked first."""
    block = first_group(html, V.PAGE_DATA)
    valid = F.get_json_object(block, "$")
    top = F.when(F.ltrim(valid).startswith("["), F.get_json_object(valid, "$[0]")).otherwise(valid)
    data = F.when(F.ltrim(top).startswith("{"), top)
    ask = lambda path: F.nullif(F.get_json_object(data, path), F.lit(""))
    title = strip(first_group(html, V.PAGE_TITLE))
    vendor = None
    for pattern, name in V.POSTING_VENDORS:
        hit = finds(url, pattern) | finds(html, pattern)
        vendor = F.when(hit, name) if vendor is None else vendor.when(hit, name)
    low = ask("$.baseSalary.value.minValue").try_cast("double")
    high = ask("$.baseSalary.value.maxValue").try_cast("double")
    return {
        "company": F.coalesce(ask("$.hiringOrganization.name"), _meta(html, "og:site_name")),
        "role": F.coalesce(ask("$.title"), _meta(html, "og:title"), title),
        "location": ask("$.jobLocation.address.addressLocality"),
        "ats_vendor": vendor,
        "min_minor": F.bround(low * 100).cast("bigint"),
        "max_minor": F.when(low.isNotNull(), F.bround(F.nullif(high, F.lit(0.0)) * 100).cast("bigint")),
        "currency": F.when(low.isNotNull(), F.coalesce(ask("$.baseSalary.currency"), F.lit("EUR"))),
    }


def comp_to_minor(amount: Column) -> Column:
    return F.bround(amount * 100).cast("bigint")


def clean_text(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))
