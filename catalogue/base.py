"""How a query and its SQL twin are registered."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseledger.functions.clock import iso_z
from caseledger.session import tune

NOW = "2024-07-15 12:00:00"
ORDERS_NOW = "2001-12-01 00:00:00"


@dataclass
class Registry:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)
    #: The SQL as it was given, without the common table expressions that it reads.
    plain: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None, *, uses: str = ""):
        """Register a function of a `Tables` under a name, with the SQL it must equal.

        `uses` names the common table expressions the SQL reads.
        """

        def wrap(fn):
            from .shapes import Tables, with_ctes

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(Tables(tune(spark), sf_dir))

            run.__name__ = name
            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = with_ctes(sql, uses.split())
                self.plain[name] = sql
            return fn

        return wrap


def iso(df: DataFrame, *columns: str) -> DataFrame:
    """Show instants as text, the way exports do."""
    return df.select(*[iso_z(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(
        *[F.round(F.col(c), places).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def ziso(column: str) -> str:
    """The SQL twin of iso()."""
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def now_col() -> Column:
    return F.to_timestamp(F.lit(NOW))
