"""Delivery as a stream: a push that falls into the quiet window waits in the state of its tenant until a timer fires."""

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import constants as C
from ..plans.nudges import timed

# The worker that asks for the state's schema is started before packages are sent, so the processor travels whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: What a push that waits leaves in the state: instants in microseconds, days in days since 1970.
_WAITING = "at long, suggestion_key string, rule string, judged long, day int, lands int"
_OUT = (
    "user_id long, suggestion_key string, rule string, outcome string, reason string, delivered_at long, local_day int"
)
_ITEM = ["at", "suggestion_key", "rule", "judged", "day", "lands"]


class Deliverer(StatefulProcessor):
    """One tenant at a time: days already used, and per evening the one push that may still go.

    Of the pushes that come on one local day and may land on one, only the first can ever go: whatever stops
    it stops the others, and if it goes they are over the cap. So the others are answered at once, and a tenant
    with very many pushes keeps a row per day. A day is used from an instant on; what is judged before it stands.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "day int", "since long")
        self.waiting = handle.getMapState("waiting", "day int, overnight boolean", _WAITING)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        # Pushes of earlier days: used whatever comes.
        for day in initialState["day"]:
            self.used.updateValue((int(day),), (0,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used, first, newest = self._days(), self._firsts(), None
        stored = dict(used), dict(first)
        for chunk in rows:
            latest = int(chunk["at"].max())
            newest = latest if newest is None else max(newest, latest)
            told = []
            for *item, bypasses in zip(*[chunk[c].tolist() for c in _ITEM], chunk["bypasses_budget"].tolist(), strict=True):
                item = tuple(item)
                at, _, rule, _, day, lands = item
                if rule == "let_it_go":
                    told.append((item, False, "never pushed"))
                elif bypasses:
                    told.append((item, True, None))
                    used[day] = min(at, used.get(day, at))
                else:
                    group = day, lands > day
                    held = first.get(group)
                    if held is not None and _place(held) <= _place(item):
                        item, held = held, item
                    first[group] = item
                    if held is not None:
                        told.append((held, False, "daily cap"))
            yield _told(key, told)
        if newest is not None:
            yield from self._judge(key, used, first, newest, stored)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        used, first = self._days(), self._firsts()
        yield from self._judge(key, used, first, expiredTimerInfo.getExpiryTimeInMs() * 1000 + 999, (dict(used), dict(first)))

    def _days(self) -> dict[int, int]:
        return {int(day[0]): int(since[0]) for day, since in self.used.iterator()}

    def _firsts(self) -> dict[tuple[int, bool], tuple]:
        return {(int(k[0]), bool(k[1])): tuple(v) for k, v in self.waiting.iterator()}

    def _judge(self, key, used: dict, first: dict, until: int, stored: tuple[dict, dict]) -> Iterator[pd.DataFrame]:
        """Answer what is due, in the order of time, and keep the rest. `stored` is the state as it is: what differs is written."""
        due = sorted((g for g, item in first.items() if item[3] <= until), key=lambda g: _place(first[g]))
        told = []
        for group in due:
            item = first.pop(group)
            at, _, _, judged, day, lands = item
            goes = used.get(day, at) >= at and used.get(lands, judged) >= judged
            if goes:
                # Just before, so that nothing else judged at this instant finds the day unused.
                used[lands] = min(judged - 1, used.get(lands, judged))
            told.append((item, goes, None if goes else "daily cap"))
        if told:
            yield _told(key, told)
        for group in stored[1].keys() - first.keys():
            self.waiting.removeKey(group)
        for group, item in first.items():
            # What waits unchanged has its timer already.
            if stored[1].get(group) != item:
                self.waiting.updateValue(group, item)
                self.handle.registerTimer(-(-item[3] // 1000))
        # A push that waits was made yesterday at the earliest, so older days are never asked for again.
        today = min([until // 86_400_000_000, *(item[4] for item in first.values())])
        for day in stored[0]:
            if day < today - 2:
                self.used.removeKey((day,))
        for day, since in used.items():
            if day >= today - 2 and stored[0].get(day) != since:
                self.used.updateValue((day,), (since,))

    def close(self) -> None:
        pass


def _place(item: tuple) -> tuple:
    return item[3], item[0], item[1]


def _told(key, answers: list[tuple[tuple, bool, str | None]]) -> pd.DataFrame:
    """One table of all answers: what was asked, whether it goes, and why not."""
    items, goes = [a[0] for a in answers], [a[1] for a in answers]
    when = lambda place: [item[place] if go else None for item, go in zip(items, goes, strict=True)]
    text = lambda values: pd.Series(values, dtype=object)
    return pd.DataFrame({
        "user_id": [key[0]] * len(items), "suggestion_key": text([i[1] for i in items]), "rule": text([i[2] for i in items]),
        "outcome": text(["sent" if go else "suppressed" for go in goes]), "reason": text([a[2] for a in answers]),
        "delivered_at": pd.array(when(3), "Int64"), "local_day": pd.array(when(5), "Int32"),
    })


def deliver(
    pending: DataFrame,
    users: DataFrame,
    sent: DataFrame,
    out: str,
    checkpoint: str,
    *,
    quiet: tuple[str, str] = (C.QUIET_FROM, C.QUIET_TO),
    live: bool = True,
    lateness: str = "1 minute",
) -> StreamingQuery:
    """The stream form of `nudges.delivery`: the same columns, each notification answered once, as Parquet in `out`.

    `pending` streams user_id, suggestion_key, rule, at, bypasses_budget. `users` (user_id, tz) is joined batch by batch; `sent`
    (user_id, local_date) holds the days used before the stream began and is read once. What may go at once is answered in its batch.
    What falls into the quiet window is answered when its timer fires, and judged then against the day it lands on.

    A live stream goes by the clock of the machine: timers fire without new input, and no row is late. A replay goes
    by `at`: timers fire when rows that are `lateness` past them have come, and rows that lie further behind the newest one are dropped by
    Spark (and counted in its progress), so `lateness` must cover the disorder of what is replayed.
    Answers are written once: state, timers and files commit together, batch by batch, through restarts.
    """
    spark = pending.sparkSession
    micros, days = lambda c: F.unix_micros(c), lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    rows = pending if live else pending.withWatermark("at", lateness)
    rows = timed(rows, users, quiet=quiet)
    extra = [] if live else [F.col("at").alias("clock")]
    rows = rows.select(
        "user_id", "suggestion_key", "rule", micros(F.col("at")).alias("at"), "bypasses_budget",
        micros(F.col("_judged")).alias("judged"), days(F.col("_day")).alias("day"), days(F.col("_lands")).alias("lands"), *extra,
    )
    before = sent.select("user_id", days(F.col("local_date")).alias("day")).distinct().groupBy("user_id")
    answered = rows.groupBy("user_id").transformWithStateInPandas(
        Deliverer(), _OUT, "Append", "ProcessingTime" if live else "EventTime", initialState=before
    )
    told = answered.select(
        "user_id", "suggestion_key", "rule", "outcome", "reason", F.timestamp_micros("delivered_at").alias("delivered_at"),
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("local_day")).alias("local_date"),
    )
    writer = told.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(processingTime="10 seconds") if live else writer.trigger(availableNow=True)
    # Timers live in the one store that Spark has for them; the session gets its own choice back.
    chosen = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.set(_PROVIDER, chosen)
