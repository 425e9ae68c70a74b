"""Follow-up drafts for every case of a set."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display as D
from ..operators.log import latest_per_case
from ..operators.stages import with_stage

CASE = ["user_id", "case_id"]


def drafts(board_rows: DataFrame, log: DataFrame, stage_defs: DataFrame | None) -> DataFrame:
    """One draft per case, worded after its last event and in the language of that event."""
    last = with_stage(latest_per_case(log), stage_defs, "to_stage", {"label": "_label"}).select(
        *CASE,
        D.event_title(F.col("type"), F.col("to_stage"), F.col("_label")).alias("_last"),
        F.col("payload.language").alias("_language"),
        F.col("payload.thread_id").alias("_thread"),
    )
    parts = D.draft(F.col("company"), F.col("_language"), F.col("_last"), F.col("_thread"))
    rows = board_rows.select(*CASE, "company").join(last, CASE, "left")
    return rows.select(*CASE, *[v.alias(k) for k, v in parts.items()])
