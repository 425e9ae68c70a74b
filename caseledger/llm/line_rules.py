"""Operator 9: quality rules, line first.

Every line is judged by rules on punctuation, navigation and boilerplate; failing lines are
removed, and a document that loses too large a share of its words is rejected.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, fresh
from .text_stats import SYMBOLS, count_any, numbered, repeated_words, word_chars

#: Lower-case phrases of page furniture; a line that holds one and is short is boilerplate.
PHRASES = (
    "all rights reserved", "privacy policy", "cookie policy", "terms of use", "terms of service",
    "click here", "sign in", "sign up", "log in", "powered by", "enable javascript", "share this",
    "subscribe to our",
)
ENDS = (".", "!", "?", ":", ";", ",", '"', "'", ")", "]", "»", "”", "’", "…", "。", "！", "？")


@dataclass(frozen=True)
class Rules:
    #: Symbols, or doubled exclamation marks, per hundred words of a line at which it is noise.
    noise_percent: int = 50
    #: Separators per hundred words of a line at which it is navigation.
    separator_percent: int = 20
    #: A line with at most so many words and no end mark is a menu entry or a heading.
    label_words: int = 4
    #: A line with at most so many words and a phrase of page furniture is boilerplate.
    phrase_words: int = 20
    #: Share of its words that a document may lose with its failed lines.
    lost_percent: int = 30
    #: The base rules that hold for the whole document.
    least_words: int = 50
    repeat_percent: int = 50


_PHRASE = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))
_ENDS = tuple(e.encode() for e in ENDS)
_FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
    "n_repeat_words": "long", "n_lost_words": "long", "base_failed": "boolean", "kept": "boolean",
    "clean_text": "string",
}


def line_fails(line: bytes, n_words: int, again: bool, rules: Rules) -> bool:
    """Whether a line with words has to go. `again`: it equals an earlier line."""
    if 100 * count_any(line, SYMBOLS) >= rules.noise_percent * n_words:
        return True
    if 100 * line.count(b"!!") >= rules.noise_percent * n_words:
        return True
    bars = line.count(b"|")
    if bars > 1 and 100 * bars >= rules.separator_percent * n_words:
        return True
    if n_words <= rules.label_words and not line.rstrip().endswith(_ENDS):
        return True
    return again or (n_words <= rules.phrase_words and _PHRASE.search(line.lower()) is not None)


def judge(data: bytes | None, rules: Rules) -> dict:
    data = data or b""
    words = data.split()
    seen: set[bytes] = set()
    kept, lost, repeated = [], 0, 0
    for line in data.split(b"\n"):
        n = len(line.split())
        if n:
            again = line in seen
            repeated += again
            seen.add(line)
            if line_fails(line, n, again, rules):
                lost += n
                continue
        kept.append(line)
    repeats = repeated_words(numbered(words))
    failed = len(words) < rules.least_words or 100 * repeats > rules.repeat_percent * len(words)
    return {
        "n_words": len(words),
        "word_chars": word_chars(data),
        "n_symbols": count_any(data, SYMBOLS),
        "n_dup_lines": repeated,
        "n_repeat_words": repeats,
        "n_lost_words": lost,
        "base_failed": failed,
        "kept": not failed and 100 * lost <= rules.lost_percent * len(words),
        "clean_text": b"\n".join(kept).decode(),
    }


def judged(docs: DataFrame, *, text_col: str = "text", rules: Rules = Rules()) -> tuple[DataFrame, str]:
    """The table with one more struct column, whose name comes second: counts, verdict, clean text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words describe the whole text; n_lost_words
    the words of failed lines; base_failed is true below 50 words or when over half of the words
    repeat; kept is false then and when over `lost_percent` of the words are lost. Null and
    empty texts count zero words and fail. Repeated rows are judged alike, all other columns pass.
    """
    name = fresh(docs, "judged")
    kind = "struct<" + ",".join(f"{k}:{v}" for k, v in _FIELDS.items()) + ">"
    arrow = pa.struct([(k, {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[v]) for k, v in _FIELDS.items()])

    @F.arrow_udf(kind)
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([judge(t, rules) for t in as_bytes(texts)], arrow)

    # A filter on the verdict must not be pushed below it: each text would be judged twice.
    once = verdict.asNondeterministic()
    return docs.withColumn(name, once(F.col(text_col).cast("string"))), name


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """id, counts, verdict and clean text of every row, in place of its other columns."""
    out, name = judged(docs.select(id_col, text_col), text_col=text_col, rules=rules)
    return out.select(id_col, f"{name}.*")


def cleaned(
    docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", rules: Rules = Rules()
) -> DataFrame:
    """The documents that pass, without their failed lines; n_chars follows the new text."""
    out, name = judged(docs, text_col=text_col, rules=rules)
    columns = {text_col: F.col(name)["clean_text"]}
    if chars_col in docs.columns:
        columns[chars_col] = F.length(F.col(name)["clean_text"]).cast(docs.schema[chars_col].dataType)
    return out.filter(F.col(name)["kept"]).withColumns(columns).drop(name)
