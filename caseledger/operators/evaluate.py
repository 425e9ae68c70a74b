"""How good the readings are, and what changed between two sets of them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: gates ---
PRECISION_GATE = 0.97
RECALL_GATE = 0.90
MIN_SCORED = 15
COMPARED = ("score", "outcome", "intent", "company", "role", "rung", "vendor", "stage_hint")


def judged(expected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each expectation (message_id, intent, company, vendor, should_drop) beside its verdict."""
    v = verdicts.select("message_id", *[F.col(c).alias(f"got_{c}") for c in ("outcome", "intent", "company", "vendor")])
    rows = expected.join(v, "message_id")
    wrong = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"got_{c}"))
    failed = F.when(F.col("should_drop"), F.col("got_outcome") != "drop").otherwise(
        (F.col("got_outcome") == "drop") | wrong("intent") | wrong("company") | wrong("vendor"))
    return rows.withColumn("passed", ~failed)


def evaluate_extraction(rows: DataFrame) -> DataFrame:
    """Precision over what was claimed, recall over what should have been, and the gates."""
    should = F.col("intent").isNotNull()
    claimed = should & F.col("got_intent").isNotNull()
    right = claimed & (F.col("intent") == F.col("got_intent"))
    n = rows.agg(
        F.count("*").alias("scored"), F.count_if("passed").alias("passed"), F.count_if(claimed).alias("claimed"),
        F.count_if(right).alias("correct"), F.count_if(should).alias("expected"),
        F.count_if(should & F.col("got_intent").isNull() & (F.col("got_outcome") == "drop")).alias("false_negatives"))
    share = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b))
    out = n.withColumn("precision", share("correct", "claimed")).withColumn("recall", share("correct", "expected"))
    return out.withColumn("gate_met", (F.col("precision") >= PRECISION_GATE) & (F.col("recall") >= RECALL_GATE)
                          & (F.col("scored") >= MIN_SCORED))


def by_intent(rows: DataFrame) -> DataFrame:
    key = F.coalesce("intent", F.when(F.col("should_drop"), "drop").otherwise("other"))
    return rows.groupBy(key.alias("intent")).agg(F.count("*").alias("expected"), F.count_if("passed").alias("correct"))


def diff_against_baseline(before: DataFrame, after: DataFrame, explanations: dict[str, Column]) -> DataFrame:
    """Messages whose verdicts differ, the fields that do, and the first explanation that holds.

    `explanations` are tests over columns named before_* and after_*, in order.
    """
    b = before.select("message_id", *[F.col(c).alias(f"before_{c}") for c in before.columns if c != "message_id"])
    a = after.select("message_id", *[F.col(c).alias(f"after_{c}") for c in after.columns if c != "message_id"])
    rows = b.join(a, "message_id", "full")
    names = F.array_compact(F.array(*[
        F.when(~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}")), F.lit(c)) for c in COMPARED]))
    why = None
    for name, test in explanations.items():
        hit = F.coalesce(test, F.lit(False))
        why = F.when(hit, name) if why is None else why.when(hit, name)
    why = F.lit("unexplained") if why is None else why.otherwise("unexplained")
    return rows.withColumn("fields", F.array_join(names, ",")).filter(F.col("fields") != "").withColumn("explained_by", why)
