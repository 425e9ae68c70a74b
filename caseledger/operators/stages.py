"""The stage table of a tenant, and lookups in it."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C

_COLUMNS = ("key", "label", "phase", "depth", "stale_after_days")


def _literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def default_rows() -> Column:
    """The default stages as an array of structs."""
    rows = (
        ", ".join(f"'{c}', {_literal(v)}" for c, v in zip(_COLUMNS, row, strict=True))
        for row in C.DEFAULT_STAGES
    )
    return F.expr("array(" + ", ".join(f"named_struct({r})" for r in rows) + ")")


def _default_map(column: str) -> Column:
    at = _COLUMNS.index(column)
    pairs = ", ".join(f"'{row[0]}', {_literal(row[at])}" for row in C.DEFAULT_STAGES)
    return F.expr(f"map({pairs})")


def seed_stage_defs(users: DataFrame, stage_defs: DataFrame) -> DataFrame:
    """Default stages a tenant does not have yet. Existing keys stay as they are."""
    wanted = users.select("user_id", F.explode(default_rows()).alias("s")).select("user_id", "s.*")
    return wanted.join(stage_defs.select("user_id", "key"), ["user_id", "key"], "left_anti")


def defaults(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(default_rows()).alias("s")).select("s.*")


_FALLBACK = {
    "phase": lambda key: F.lit("sent"),
    "depth": lambda key: F.lit(0),
    "label": lambda key: key,
    "stale_after_days": lambda key: F.lit(C.UNKNOWN_STALE_DAYS),
}


def with_stage(
    df: DataFrame, stage_defs: DataFrame | None, key: str, wanted: dict[str, str]
) -> DataFrame:
    """Add stage attributes for the stage in column `key`.

    A tenant with stages of its own is looked up there, one without any in the default table.
    A stage that is unknown there is shallow and `sent`, under its own name.
    `wanted` maps phase, depth, label or stale_after_days to output names.
    """
    k = F.col(key)

    def default(column: str) -> Column:
        return F.coalesce(_default_map(column)[k], _FALLBACK[column](k))

    if stage_defs is None:
        return df.select("*", *[default(c).alias(name) for c, name in wanted.items()])
    own = stage_defs.select(
        "user_id", F.col("key").alias("_sk"), *[F.col(c).alias(f"_s_{c}") for c in wanted]
    )
    has = stage_defs.select("user_id").distinct().withColumn("_own", F.lit(True))
    joined = df.join(has, "user_id", "left").join(
        own.withColumnRenamed("user_id", "_su"),
        (F.col("user_id") == F.col("_su")) & (k == F.col("_sk")),
        "left",
    )
    return joined.select(
        *df.columns,
        *[
            F.when(F.col("_own"), F.coalesce(F.col(f"_s_{c}"), _FALLBACK[c](k)))
            .otherwise(default(c))
            .alias(name)
            for c, name in wanted.items()
        ],
    )


def join_defs(df: DataFrame, stage_defs: DataFrame, key: str, wanted: dict[str, str]) -> DataFrame:
    """A plain outer join to the stored stages, nulls where a tenant has none."""
    own = stage_defs.select(
        F.col("user_id").alias("_su"),
        F.col("key").alias("_sk"),
        *[F.col(c).alias(name) for c, name in wanted.items()],
    )
    return df.join(
        own, (F.col("user_id") == F.col("_su")) & (F.col(key) == F.col("_sk")), "left"
    ).drop("_su", "_sk")


def display_stage(status: Column, label: Column, presumed_closed: Column) -> Column:
    """What a stage column shows: the outcome where there is one, else the stage."""
    return (
        F.when(status == "rejected", "Rejected")
        .when(status == "withdrawn", "Withdrawn")
        .when(status == "accepted", "Accepted")
        .when((status == "dormant") & presumed_closed, "Closed by silence")
        .when(status == "dormant", "Dormant")
        .otherwise(label)
    )
