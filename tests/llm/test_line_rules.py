import check
from conftest import SF
from llm_helpers import awkward, empty, prose

from caseledger.llm.line_rules import Rules, cleaned, judge, line_fails, quality_rules
from caseledger.llm.queries import ORACLES, QUERIES
from caseledger.llm.shared import prepare


def test_query_equals_sql(spark):
    problem, n = check.compare(QUERIES["op9_quality_rules"](spark, SF), check.duck(SF), ORACLES["op9_quality_rules"])
    assert problem is None and n > 0


def test_lines():
    rules = Rules()

    def fails(text, again=False):
        return line_fails(text.encode(), len(text.split()), again, rules)

    assert fails("Home | News | About | Contact") and fails("buy*** now### at&&& once%%%") and fails("WOW!! SO!! GOOD!!")
    assert fails("Read more") and fails("All rights reserved. Imprint.") and fails("A line of prose that was here before.", True)
    assert not fails("A plain sentence of seven words here.") and not fails("A long line that has no end mark at all")


def test_counts():
    text = "a b c d a b c\na b c d a b c\n\n \nend."
    got = judge(text.encode(), Rules())
    assert got["n_words"] == 15 and got["n_dup_lines"] == 1 and got["word_chars"] == 18
    assert got["n_repeat_words"] == 14 and got["base_failed"] and not got["kept"]


def test_a_document_loses_too_much():
    good = "\n".join(prose(k, 20) for k in range(4))
    menu = "\n".join(f"Go | to | page{k} | now | and | more | of | it" for k in range(3))
    assert judge(good.encode(), Rules())["kept"]
    some = judge(f"{good}\n{menu.splitlines()[0]}".encode(), Rules())
    assert some["kept"] and some["clean_text"] == good
    assert not judge(f"{good}\n{menu}".encode(), Rules())["kept"]


def test_awkward_rows(spark):
    df = awkward(prepare(spark)).withColumnRenamed("v", "judged")
    rows = quality_rules(df).collect()
    assert len(rows) == df.count()
    empty_ones = [r for r in rows if r["doc_id"] in (4, 5, 6)]
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in empty_ones)
    out = cleaned(df)
    assert out.columns == df.columns
    left = out.collect()
    assert {9, None} <= {r["doc_id"] for r in left}
    assert all(r["n_chars"] == len(r["text"]) for r in left)


def test_empty(spark):
    assert quality_rules(empty(prepare(spark))).count() == 0 and cleaned(empty(spark)).count() == 0
