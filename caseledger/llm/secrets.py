"""Operator 13: secrets, by what precedes them, by their form, and by a battery of randomness tests.

Known forms are found by patterns. Other long tokens are judged: the alphabet of a token is inferred from its characters, and three tests
say whether its symbols may come from that alphabet at random (evenness by chi-squared, runs of the alphabet's halves, correlation of
neighbours). What passes is held against ordinary text, whose letters coincide more often and whose kinds of characters change
more rarely; how many of a length and alphabet may be taken for random by mistake is controlled over the whole table.

Everything is columns: a match lies where the lengths of all gaps and matches before it lead.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the result contract. The second group of the first one is the secret, of six characters or more.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
_SECRET_LENGTH = 6

#: Alphabets in the order in which they are tried: name, characters of a class, all symbols, those of the lower half.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (
    ("decimal", "0-9", _DIGITS, "0-4"),
    ("hex", "0-9a-f", _DIGITS + "abcdef", "0-7"),
    ("upper hex", "0-9A-F", _DIGITS + "ABCDEF", "0-7"),
    ("base32", "A-Z2-7", _UPPER + "234567", "A-P"),
    ("base36", "0-9a-z", _DIGITS + _LOWER, "0-9a-h"),
    ("base62", "0-9A-Za-z", _DIGITS + _UPPER + _LOWER, "0-9A-U"),
    ("base64", "A-Za-z0-9+/", _UPPER + _LOWER + _DIGITS + "+/", "A-Za-f"),
    ("base64url", "A-Za-z0-9_-", _UPPER + _LOWER + _DIGITS + "-_", "A-Za-f"),
)
_LEAST_P = 1e-300
#: Steps of a decade in which chances are counted.
_STEPS = 50


@dataclass(frozen=True)
class Battery:
    #: Characters of a token that is judged, padding aside.
    least_length: int = 20
    #: Tokens whose symbols are this unlikely under their alphabet are not random.
    uneven: float = 1e-3
    #: Expected share of ordinary text among the tokens that are reported.
    discoveries: float = 0.01
    #: Chance that two letters, and that three letters, of ordinary text are equal; the lowest of European languages.
    two_equal: float = 0.065
    three_equal: float = 0.0055
    #: Chance that a character of a name or word is of another kind (upper, lower, digit, sign) than the one before.
    change: float = 0.25


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _token_pattern(least: int) -> str:
    return rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{least},}}"


def found(docs: DataFrame, *, id_col: str, text_col: str, battery: Battery) -> DataFrame:
    """row, id and for each pattern an array of (gap, length, what): what lies between matches, how long they are and what they hold."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": _token_pattern(battery.least_length)}
    for name, pattern in patterns.items():
        rows = rows.withColumn(f"{name}_all", _matches(F.col("text"), pattern))
    rows = rows.withColumn("secret_all", F.when(F.size("assign_all") > 0, _matches(F.col("text"), ASSIGN, 2)))
    columns = []
    for name, pattern in patterns.items():
        whole = F.col(f"{name}_all")
        gaps = F.slice(F.split("text", pattern, -1), F.lit(1), F.size(whole))
        what = {"assign": F.col("secret_all"), "token": whole}.get(name)
        kept = F.arrays_zip(
            F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("length"),
            (whole if what is None else what).alias("what"),
        )
        shape = F.transform(kept, lambda m: F.struct(
            m["gap"].cast("long").alias("gap"), m["length"].cast("long").alias("length"), m["what"].alias("what")
        ))
        columns.append(F.when(F.size(whole) > 0, shape).alias(name))
    return rows.select("row", "id", *columns)


def _placed(matches: DataFrame, name: str) -> DataFrame:
    """row, start, end, what of every match of one pattern."""
    each = matches.filter(F.col(name).isNotNull()).select("row", F.posexplode(name).alias("nth", "m")).select("row", "nth", "m.*")
    upto = W.partitionBy("row").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    return each.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto)).select(
        "row", (F.col("end") - F.col("length")).alias("start"), "end", "what"
    )


def _apart(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """Tokens that share no character with a base span."""
    both = tokens.withColumn("is_token", F.lit(True)).unionByName(
        base.select("row", "start", "end", F.lit(False).alias("is_token")), allowMissingColumns=True
    )
    in_order = W.partitionBy("row").orderBy("start")
    before = F.max(F.when(~F.col("is_token"), F.col("end"))).over(in_order.rangeBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(~F.col("is_token"), F.col("start"))).over(in_order.rangeBetween(0, W.unboundedFollowing))
    seen = both.withColumn("before", before).withColumn("after", after)
    clear = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return seen.filter(F.col("is_token") & clear).drop("is_token", "before", "after")


def upper_tail(z: Column) -> Column:
    """Chance that a standard normal value is z or more, to seven digits at any size (a Chebyshev fit of erfc)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x / 2)
    # Fixed values of the published fit, highest power first.
    fit = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368)
    power = reduce(lambda acc, c: acc * t + c, fit, F.lit(0.0))
    tail = t * F.exp(-x * x - 1.26551223 + t * power) / 2
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(_LEAST_P))


def _both_tails(z: Column) -> Column:
    return F.least(2 * upper_tail(F.abs(z)), F.lit(1.0))


def combined(chances: list[Column]) -> Column:
    """Fisher's combination of independent chances, in closed form."""
    h = reduce(lambda a, b: a + b, [-F.log(F.greatest(p, F.lit(_LEAST_P))) for p in chances])
    terms, term = F.lit(1.0), F.lit(1.0)
    for j in range(1, len(chances)):
        term = term * h / j
        terms = terms + term
    return F.greatest(F.least(F.exp(-h) * terms, F.lit(1.0)), F.lit(_LEAST_P))


def _by_alphabet(values: list[Column]) -> Column:
    out = None
    for (name, *_), value in zip(ALPHABETS, values, strict=True):
        test = F.col("alphabet") == name
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def judged(tokens: DataFrame, battery: Battery = Battery()) -> DataFrame:
    """Tokens (column `what`) with alphabet, n, the chances of the three tests, `even` and `text`.

    even: how likely symbols as uneven, or neighbours as regular, as these are when drawn at random; text: how likely
    ordinary text is to coincide as rarely and to change as often. Tokens of no known alphabet, and those shorter than the least length
    without their padding, are left out.
    """
    alphabet = None
    for name, chars, *_ in ALPHABETS:
        test = F.col("body").rlike(f"^[{chars}]+$")
        alphabet = F.when(test, name) if alphabet is None else alphabet.when(test, name)
    rows = tokens.withColumn("body", F.regexp_replace("what", "=+$", "")).withColumn("n", F.length("body").cast("double"))
    rows = rows.filter(F.col("n") >= battery.least_length).withColumn("alphabet", alphabet).filter("alphabet IS NOT NULL")
    rows = rows.withColumn("symbols", _by_alphabet([F.lit(a[2]) for a in ALPHABETS])).withColumn("k", F.length("symbols").cast("double"))
    rows = rows.withColumn("x", F.expr("transform(filter(split(body, ''), c -> c <> ''), c -> CAST(instr(symbols, c) - 1 AS DOUBLE))"))
    rows = rows.withColumn(
        "counts", F.expr("transform(filter(split(symbols, ''), c -> c <> ''), c -> n - length(replace(body, c, '')))")
    )
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    squares = total(F.transform("counts", lambda c: c * c))
    sum_x = total(F.transform("counts", lambda c, i: c * i))
    sum_xx = total(F.transform("counts", lambda c, i: c * i * i))
    m = F.size("x") - 1
    neighbours = total(F.zip_with(F.slice("x", F.lit(1), m), F.slice("x", F.lit(2), m), lambda a, b: a * b))
    rows = rows.withColumns({
        "squares": squares, "sum_x": sum_x, "sum_xx": sum_xx, "neighbours": neighbours,
        "first": F.element_at("x", 1), "last": F.element_at("x", -1),
        "half_runs": _by_alphabet([F.regexp_count("body", F.lit(f"[{half}]+")) + F.regexp_count("body", F.lit(f"[^{half}]+")) for *_, half in ALPHABETS]),
        "low": _by_alphabet([F.length(F.regexp_replace("body", f"[^{half}]", "")) for *_, half in ALPHABETS]).cast("double"),
        "kind_runs": reduce(lambda a, b: a + b, [F.regexp_count("body", F.lit(c)) for c in ("[A-Z]+", "[a-z]+", "[0-9]+", "[^A-Za-z0-9]+")]),
    })
    n, k, low, high = F.col("n"), F.col("k"), F.col("low"), F.col("n") - F.col("low")
    # Evenness: chi-squared with k - 1 degrees of freedom, its cube root being nearly normal.
    df = k - 1
    chi = k / n * F.col("squares") - n
    chi_z = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # Runs of the halves of the alphabet, given how many symbols are of each half.
    mean_runs = 2 * low * high / n + 1
    spread = F.sqrt(F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9)))
    # Correlation of neighbours.
    mean = F.col("sum_x") / n
    variance = F.col("sum_xx") - n * mean * mean
    together = F.col("neighbours") - mean * (2 * F.col("sum_x") - F.col("first") - F.col("last")) + (n - 1) * mean * mean
    # Ordinary text: pairs of equal letters, and changes between kinds of characters.
    pairs = n * (n - 1) / 2
    equal = (F.col("squares") - n) / 2
    two, three = battery.two_equal, battery.three_equal
    equal_spread = F.sqrt(pairs * two * (1 - two) + n * (n - 1) * (n - 2) * (three - two * two))
    steps, change = n - 1, battery.change
    # Each statistic is a column before its chance is worked out, so that none is evaluated again and again.
    rows = rows.withColumns({
        "z_even": chi_z, "z_runs": (F.col("half_runs") - mean_runs) / spread, "variance": variance,
        "z_serial": (together / F.greatest(variance, F.lit(1e-9)) + 1 / n) * F.sqrt(n),
        "z_rarely": (pairs * two - equal - 0.5) / equal_spread,
        "z_often": (F.col("kind_runs") - 1.5 - steps * change) / F.sqrt(steps * change * (1 - change)),
    })
    one_half = F.greatest(F.pow(F.lit(2.0), 1 - n), F.lit(_LEAST_P))
    rows = rows.withColumns({
        "evenness": upper_tail(F.col("z_even")),
        "runs": F.when((low == 0) | (high == 0), one_half).otherwise(_both_tails(F.col("z_runs"))),
        "serial": F.when(F.col("variance") <= 1e-9, F.lit(_LEAST_P)).otherwise(_both_tails(F.col("z_serial"))),
        "rarely": upper_tail(F.col("z_rarely")), "often": upper_tail(F.col("z_often")),
    })
    rows = rows.withColumn("even", combined([F.col("evenness"), F.col("runs"), F.col("serial")]))
    rows = rows.withColumn("text", combined([F.col("rarely"), F.col("often")]))
    return rows.select(*tokens.columns, "n", "alphabet", "evenness", "runs", "serial", "rarely", "often", "even", "text")


def discovered(tokens: DataFrame, battery: Battery = Battery()) -> DataFrame:
    """The judged tokens that are random, with a controlled share of ordinary text among them.

    Tokens of one alphabet and one octave of lengths are a family of their own, as short ones can never be as sure as long ones. In
    each family, chances are counted in steps of a fiftieth of a decade, and the highest step is taken at which the expected number of
    ordinary tokens is within the wanted share of those reported. A family brings as many rows as it has steps, not tokens.
    """
    # Stored, or the conditions below would take the whole battery along when they are pushed down.
    rows = stored(tokens, "tokens").withColumn("octave", F.floor(F.log2("n")).cast("int")).withColumn(
        "step", F.floor(-_STEPS * F.log10("text")).cast("int")
    )
    family = ["alphabet", "octave"]
    counted = rows.groupBy(*family, "step").agg(F.count("*").alias("c"))
    down = W.partitionBy(*family).orderBy(F.col("step").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = (
        counted.withColumn("reported", F.sum("c").over(down)).withColumn("all", F.sum("c").over(W.partitionBy(*family)))
        .filter(F.col("all") * F.pow(F.lit(10.0), -F.col("step") / _STEPS) <= battery.discoveries * F.col("reported"))
        .groupBy(*family).agg(F.min("step").alias("cut"))
    )
    taken = rows.join(stored(cut, "cuts"), family).filter(F.col("step") >= F.col("cut"))
    return taken.filter(F.col("even") >= battery.uneven).drop("octave", "step", "cut")


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", battery: Battery = Battery()) -> tuple[DataFrame, DataFrame]:
    """(row and id of every document, its spans: row, kind, start, end), counted in code points, ends exclusive.

    Matches of a kind are leftmost and do not overlap. Assignments hold the name, the sign and six or more characters after it.
    Random tokens share no character with a span of another kind. Null and empty texts have no spans; repeated rows, and rows
    with a null id, have spans of their own; an empty table gives nothing. Texts are read whole. Other columns are not read.
    """
    matches = stored(found(docs, id_col=id_col, text_col=text_col, battery=battery), "matches")
    assign = _placed(matches, "assign").filter(F.length("what") >= _SECRET_LENGTH)
    spans = [assign, _placed(matches, "access"), _placed(matches, "hex")]
    base = reduce(DataFrame.unionByName, [s.select("row", F.lit(k).alias("kind"), "start", "end") for k, s in zip(KINDS, spans, strict=False)])
    base = stored(base, "base-spans")
    tokens = judged(_apart(_placed(matches, "token"), base), battery)
    random = discovered(tokens, battery).select("row", F.lit("random").alias("kind"), "start", "end")
    return matches.select("row", "id"), base.unionByName(random)


def secret_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", battery: Battery = Battery()) -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, base_sha256 and spans ("kind:start:end", by start and kind, comma-joined)."""
    rows, spans = secrets(docs, id_col=id_col, text_col=text_col, battery=battery)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    told = spans.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS[:3]],
        F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "end", "kind"))).alias("all"),
    )
    joined = lambda some: F.array_join(
        F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    none = F.lit(0).cast("long")
    return rows.join(told, "row", "left").select(
        F.col("id").alias(id_col), *[F.coalesce(f"n_{k}", none).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.coalesce(joined(F.filter("all", lambda s: s["kind"] != "random")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"),
    )
