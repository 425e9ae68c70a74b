"""Redaction, deny lists and pseudonyms, all of them column expressions."""

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

#: An identifier is tried from its first letter only: what a later letter could match, the first one does too. And only
#: where a separator follows it, which one look ahead without backtracking tells.
_AT_START = r"""(?i)(?<![A-Za-z_])(?=[A-Za-z_][A-Za-z0-9_\-]*+\s*+["']?\s*+[:=])"""
_AT_SCHEME = r"(?i)\b(?=[a-z][a-z0-9+.\-]*+://)"


def scrub_text(text: Column) -> Column:
    """Secrets in prose replaced; everything around them stays."""
    out = F.when(F.contains(text, F.lit("://")), F.regexp_replace(text, _AT_SCHEME + V.DSN_PASSWORD, f"$1{V.REDACTED}$3")).otherwise(text)
    out = F.regexp_replace(out, _AT_START + V.SECRET_PAIR, f"$1$2{V.REDACTED}")
    out = F.regexp_replace(out, "(?i)" + V.BEARER, f"$1 {V.REDACTED}")
    return F.regexp_replace(out, V.PROVIDER_SECRET, V.REDACTED)


def redact_values(values: Column) -> Column:
    """A map with the values of secret keys replaced and the others scrubbed."""
    return F.transform_values(
        values,
        lambda k, v: F.when(k.rlike("(?i)" + V.SECRET_KEYS), V.REDACTED).otherwise(scrub_text(v)),
    )


def fence(text: Column) -> Column:
    """Untrusted text between delimiters it can not close."""
    inner = text
    for mark in (V.FENCE_OPEN, V.FENCE_CLOSE):
        inner = F.replace(inner, F.lit(mark), F.lit("[removed]"))
    return F.concat(F.lit(V.FENCE_OPEN + "\n"), inner, F.lit("\n" + V.FENCE_CLOSE))


# --- deny list -------------------------------------------------------------------------------------

#: Strings, brackets and marks, and bare values of JSON, one match each.
_JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{}:,]|[^\s\[\]{}:,"]+'


#: Tokens that are gathered before they are joined.
_GATHERED = 128


def denied_key(name: Column) -> Column:
    """Whether one of the words of a key, or all of them together, name a protected category."""
    spaced = F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", " "))
    parts = F.filter(F.split(spaced, "[^a-z0-9]+"), lambda w: w != "")
    listed = F.array(*[F.lit(k) for k in V.DENIED_KEYS])
    return F.arrays_overlap(parts, listed) | F.array_contains(listed, F.array_join(parts, "_"))


def deny_list(json: Column) -> Column:
    """struct<value, violations>: JSON of any depth without keys of protected categories, and the paths removed.

    One walk over the tokens. It carries the paths of the open brackets, the position in each, and, while a
    denied member is left out, the depth at which that ends. What is put out is gathered in short runs, so that a step
    copies one run and not all that came before it. Null or broken JSON gives a null value.
    """
    tokens = F.regexp_extract_all(json, F.lit(_JSON_TOKEN), F.lit(0))
    texts, no_texts = "array<string>", F.array().cast("array<string>")
    start = F.struct(
        no_texts.alias("open"), F.array().cast("array<int>").alias("seen"), F.lit("").alias("at"),
        F.lit(-1).alias("until"), F.lit(False).alias("comma"), F.lit("").alias("last"),
        no_texts.alias("run"), no_texts.alias("out"), no_texts.alias("few"), F.array().cast("array<array<string>>").alias("found"),
    )

    def step(s: Column, pair: Column) -> Column:
        t, following = pair["token"], pair["next"]
        opens, closes, comma = t.isin("{", "["), t.isin("}", "]"), t == ","
        is_key = F.coalesce(following == ":", F.lit(False)) & t.startswith('"')
        depth = F.size(s["open"])
        # The member left out ends at the comma or bracket that follows it.
        ends = (s["until"] >= 0) & ((comma & (depth == s["until"])) | (closes & (depth == s["until"])))
        out_of_sight = (s["until"] >= 0) & ~ends
        name = F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), texts), F.lit(0))
        parent = F.coalesce(F.try_element_at(s["open"], F.lit(-1)), F.lit(""))
        place = F.coalesce(F.try_element_at(s["seen"], F.lit(-1)), F.lit(-1))
        key_path = F.when(parent == "", name).otherwise(F.concat(parent, F.lit("."), name))
        denied = is_key & ~out_of_sight & denied_key(name)
        # Where a bracket opens: under the key before it, or at its place in a list.
        here = F.when(s["at"] != "", s["at"]).when(place >= 0, F.concat(parent, F.lit("["), place.cast("string"), F.lit("]"))).otherwise(parent)
        open_ = (
            F.when(opens, F.concat(s["open"], F.array(here)))
            .when(closes, F.slice(s["open"], F.lit(1), F.greatest(depth - 1, F.lit(0))))
            .otherwise(s["open"])
        )
        last_seen = F.slice(s["seen"], F.lit(1), F.greatest(depth - 1, F.lit(0)))
        seen = (
            F.when(opens, F.concat(s["seen"], F.array(F.when(t == "[", 0).otherwise(-1))))
            .when(closes, last_seen)
            .when(comma & (place >= 0), F.concat(last_seen, F.array(place + 1)))
            .otherwise(s["seen"])
        )
        after_open = s["last"].isin("{", "[")
        shown = ~out_of_sight & ~denied & ~comma
        full, many = F.size(s["run"]) >= _GATHERED, F.size(s["few"]) >= _GATHERED
        with_comma = F.when(s["comma"] & ~closes & ~after_open, F.array(F.lit(","), t)).otherwise(F.array(t))
        return F.struct(
            open_.alias("open"), seen.alias("seen"),
            F.when(is_key, key_path).when(t == ":", s["at"]).otherwise("").alias("at"),
            F.when(denied, depth).when(ends, -1).otherwise(s["until"]).alias("until"),
            F.when(comma & ~out_of_sight, True).when(shown, False).otherwise(s["comma"]).alias("comma"),
            F.when(shown, t).otherwise(s["last"]).alias("last"),
            F.when(shown, F.concat(F.when(full, no_texts).otherwise(s["run"]), with_comma)).when(full, no_texts).otherwise(s["run"]).alias("run"),
            F.when(full, F.concat(s["out"], F.array(F.array_join(s["run"], "")))).otherwise(s["out"]).alias("out"),
            F.when(denied, F.concat(F.when(many, no_texts).otherwise(s["few"]), F.array(key_path))).when(many, no_texts)
            .otherwise(s["few"]).alias("few"),
            F.when(many, F.concat(s["found"], F.array(s["few"]))).otherwise(s["found"]).alias("found"),
        )

    pairs = F.zip_with(
        tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("token"), b.alias("next")),
    )
    valid = F.try_parse_json(json).isNotNull()
    walked = F.aggregate(
        pairs, start, step, lambda s: F.struct(
            F.concat(F.array_join(s["out"], ""), F.array_join(s["run"], "")).alias("value"),
            F.concat(F.flatten(s["found"]), s["few"]).alias("violations"),
        )
    )
    nothing = F.struct(F.lit(None).cast("string").alias("value"), no_texts.alias("violations"))
    return F.when(valid, walked).otherwise(nothing)


# --- pseudonyms ------------------------------------------------------------------------------------

_NAMED_LINE = r"(?im)^(?:from|to|cc|reply-to)[ \t]*:[ \t]*[^<\n]*[^<\n \t\"][\" \t]*<"
_MAILBOX = r"[\w.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
_WEB = r"""(?i)https?://[^\s<>"')]+"""
#: A boundary is looked for behind the first digit, which few characters are.
_RUN = r"[0-9](?<![0-9A-Za-z_][0-9])[0-9]{5,}+(?![0-9A-Za-z_])"

#: A mailbox from its @ on, which is rare; what stands before it is looked up afterwards. A match that ended at the @ leaves nothing for its name.
_AT_HOST = r"@(?<=[\w.%+-]@)(?<!\G@)(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}"
_BACKWARDS = r"^[\w.%+-]+"


def _letters(value: Column, n: int = 10) -> Column:
    """A pseudonym of letters only, so that later passes find no digits in it."""
    return F.translate(F.substring(F.sha2(F.lower(value), 256), 1, n), "0123456789", "ghijklmnop")


def _once(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is worked out once, however often it stands in there."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _each(text: Column, pattern: str, new: Callable[[Column, Column], Column]) -> Column:
    """Every match, with the text before it, replaced by what is made of the two; the text after the last one stays."""
    def replaced(t: Column) -> Column:
        return _once(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, F.array_join(
            F.zip_with(F.split(t, pattern, -1), found, lambda gap, m: F.when(m.isNull(), gap).otherwise(new(gap, m))), "",
        )).otherwise(t))

    return _once(text, replaced)


def anonymiser(kept_domains: Iterable[str]) -> Callable[[Column], Column]:
    """A function of text columns that puts stable pseudonyms in place of persons.

    Names in header lines, mailboxes, addresses on the web and long numbers are replaced. Listed domains and those
    below them stay, and a number keeps its length.
    """
    listed = [d.lower() for d in kept_domains]
    known = "(?:^|\\.)(?:" + "|".join(d.replace(".", "\\.") for d in listed) + ")$" if listed else "(?!)"

    def host(name: Column, kind: str) -> Column:
        return F.when(F.rlike(name, F.lit(known)), name).otherwise(F.concat(F.lit(f"{kind}-"), _letters(name), F.lit(".invalid")))

    def mailbox(gap: Column, m: Column) -> Column:
        name = F.reverse(F.regexp_extract(F.reverse(gap), _BACKWARDS, 0))
        return _once(name, lambda n: F.concat(
            F.substring(gap, F.lit(1), F.length(gap) - F.length(n)), F.lit("person-"), _letters(n), F.lit("@"),
            _once(F.lower(F.substring(m, 2, 2**31 - 1)), lambda h: host(h, "org")),
        ))

    def web(m: Column) -> Column:
        rest = F.substring_index(m, "://", -1)
        return F.concat(F.lit("https://"), host(F.lower(F.substring_index(rest, "/", 1)), "site"), F.lit("/"), _letters(rest))

    def named(m: Column) -> Column:
        name = F.trim(F.translate(F.regexp_replace(m, "^[^:]*:|<$", ""), '"\t', "  "))
        return F.concat(F.substring_index(m, ":", 1), F.lit(": Person "), _letters(name), F.lit(" <"))

    def number(m: Column) -> Column:
        digits = F.translate(F.sha2(m, 256), "abcdef", "012345")
        return F.substring(F.repeat(digits, F.ceil(F.length(m) / 64).cast("int")), F.lit(1), F.length(m))

    def after(new: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
        return lambda gap, m: F.concat(gap, new(m))

    def anonymise(text: Column) -> Column:
        out = _each(text, _NAMED_LINE, after(named))
        out = _each(out, _AT_HOST, mailbox)
        out = _each(out, _WEB, after(web))
        return _each(out, _RUN, after(number))

    return anonymise
