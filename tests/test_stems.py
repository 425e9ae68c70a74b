"""Texts without any stem hold no match, so that guarded patterns find what plain ones find."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseledger.functions import names as N
from caseledger.functions import text as X
from caseledger.functions import vocab as V

GUARDED = [(V.STRONG_KEYWORDS, V.STRONG_STEMS), (V.WEAK_KEYWORDS, V.WEAK_STEMS)]
GUARDED += [(p[3], s) for p, s in zip(V.PHRASES, V.PHRASE_STEMS, strict=True)]
GUARDED += list(zip(V.ROLE_PATTERNS, V.ROLE_STEMS, strict=True))


@pytest.mark.parametrize("pattern, stems", GUARDED)
def test_every_match_holds_a_stem(pattern, stems):
    @settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern, re.IGNORECASE | re.ASCII)))
    def holds(text):
        found = re.search(pattern, text, re.IGNORECASE | re.ASCII)
        assert found is None or any(s in found[0].lower() for s in stems)

    holds()


def test_guarded_equals_plain(spark):
    texts = [
        "We are hiring", "HİRİNG now", "recruıt", "talent acquiſition", "ſelezione", "K application", "a role.", "Role", "controle", None, "",
        "Thank you for applying", "thank you for\napplying", "Thanks for taking the time to apply", "OFFERTA", "opportunità di Data Engineer.",
        "Your application for the Data Engineer position at Acme", "candidatura per Analista presso Rossi", "CV", "cvs", "nothing here",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t"))
    for pattern, stems in GUARDED:
        rows = df.select(X.finds(F.col("t"), pattern).alias("a"), X.finds_if(F.col("t"), F.col("low"), pattern, stems).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows], pattern
    plain = F.array(*[F.regexp_extract("t", X.FLAGS + p, 1) for p in V.ROLE_PATTERNS])
    role = F.get(F.filter(F.transform(plain, N._clean_role), lambda r: r.isNotNull()), F.lit(0))
    rows = df.select(role.alias("a"), N.role_from_body(F.col("t"), F.col("low")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and any(r.a for r in rows)
