"""Exports and conversations of an account."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import iso_z
from ..operators.skew import top_per_key

INTERNAL = ("role_embedding",)


def _plain(field: T.StructField) -> Column | None:
    c = F.col(field.name)
    if field.name in INTERNAL:
        return None
    if isinstance(field.dataType, T.TimestampType):
        return iso_z(c).alias(field.name)
    if isinstance(field.dataType, T.DateType):
        return c.cast("string").alias(field.name)
    if isinstance(field.dataType, T.BinaryType):
        return F.lower(F.hex(c)).alias(field.name)
    if isinstance(field.dataType, T.DecimalType):
        return c.cast("double").alias(field.name)
    return c


def plain_rows(df: DataFrame) -> DataFrame:
    """Columns as a person reads them: instants with a Z, dates as dates, bytes in hex."""
    return df.select(*[c for c in map(_plain, df.schema.fields) if c is not None])


def export_json(tables: dict[str, DataFrame], user_id=None) -> DataFrame:
    """Every row of every table as (user_id, name, row). Partition by user_id when writing."""
    out = None
    for name, df in tables.items():
        kept = df if user_id is None else df.filter(F.col("user_id") == user_id)
        plain = plain_rows(kept)
        rows = plain.select("user_id", F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def export_csv(cases: DataFrame, companies: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """The cases with the name of their company, all of them or those with a case_id in `selected`."""
    rows = cases.join(
        companies.select("company_id", F.col("canonical_name").alias("company")), "company_id"
    )
    if selected is not None:
        rows = rows.join(selected.select("case_id").distinct(), "case_id", "left_semi")
    return plain_rows(rows)


def conversation_summary(messages: DataFrame) -> DataFrame:
    """Number of messages and the last turn of each conversation."""
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("message_count"), F.max("turn").alias("last_turn")
    )


def history_budget(
    messages: DataFrame, attachments: DataFrame, turns: int = 24, budget: int = 8 * 1024 * 1024
) -> DataFrame:
    """The newest turns of each conversation with the attachments that still fit.

    Attachments are taken newest turn first; one that does not fit is passed over and smaller ones
    after it may still go in. `attachments`: conv_id, turn, attachment_id, size; the turns kept
    bound how many are looked at. A conversation is read in order, a batch at a time, so that it may hold any number of
    attachments; only those that fit are ever held together.
    """
    newest = top_per_key(messages, ["conv_id"], [F.col("turn").desc()], turns, "_rn").drop("_rn")
    # What is larger than the whole budget never fits, whatever came before.
    listed = newest.select("conv_id", "turn").join(attachments, ["conv_id", "turn"]).filter(F.col("size") <= budget)
    in_order = (
        listed.select("conv_id", "turn", "attachment_id", F.col("size").cast("bigint").alias("size"))
        .repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").desc(), "attachment_id")
    )

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, left = None, budget
        for batch in batches:
            kept = []
            for conv, size in zip(batch.column("conv_id").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if conv != conversation:
                    conversation, left = conv, budget
                kept.append(size <= left)
                left -= size if kept[-1] else 0
            yield batch.filter(pa.array(kept, pa.bool_()))

    told = in_order.mapInArrow(fitting, in_order.schema).groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("o"), "attachment_id"))),
            lambda a: a["attachment_id"].cast("string"),
        ).alias("attachments")
    )
    none = F.array().cast("array<string>")
    return newest.join(
        newest.select("conv_id", "turn").join(attachments, ["conv_id", "turn"]).select("conv_id").distinct().join(told, "conv_id", "left")
        .withColumn("attachments", F.coalesce("attachments", none)),
        "conv_id", "left",
    )
