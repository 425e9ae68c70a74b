"""Sentences shown beside rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from . import wording as T
from .clock import days_between, hours_exact, local


def quiet_days(now: Column, last: Column) -> Column:
    """Whole days since the last signal, never negative; nothing stays nothing."""
    return F.when(last.isNotNull(), F.greatest(F.lit(0), days_between(last, now)).cast("bigint"))


def quiet_label(days: Column) -> Column:
    return (
        F.when(days.isNull(), "")
        .when(days == 1, "quiet 1 day")
        .otherwise(F.format_string("quiet %d days", days))
    )


def flag_kind(
    now: Column,
    *,
    status: Column,
    deadline_at: Column,
    decide_by: Column,
    last_signal_at: Column,
    quiet_threshold: Column,
) -> Column:
    """The soonest irreversible cost: a deadline, an offer to answer, then silence."""
    hours = hours_exact(now, deadline_at)
    quiet = quiet_days(now, last_signal_at)
    return (
        F.when(status.isin(*C.TERMINAL), "none")
        .when((hours > 0) & (hours <= C.DEADLINE_WINDOW_DAYS * 24), "deadline")
        .when(decide_by.cast("timestamp") > now, "decide")
        .when((status == "dormant") | (quiet > quiet_threshold), "quiet")
        .otherwise("none")
    )


def flag_text(kind: Column, *, deadline_at: Column, decide_by: Column, tz: Column) -> Column:
    due = F.date_format(local(deadline_at, tz), "EEEE HH:mm")
    by = F.date_format(local(decide_by.cast("timestamp"), tz), "d MMM")
    return (
        F.when(kind == "deadline", F.concat(F.lit("Due "), due))
        .when(kind == "decide", F.concat(F.lit("decide by "), by))
        .when(kind == "quiet", "quiet · past your p90")
        .otherwise("")
    )


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _to_the_minute(text: Column) -> Column:
    return F.translate(F.substring(text, 1, 16), "T", " ")


def event_title(kind: Column, to_stage: Column, label: Column) -> Column:
    titles = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in C.EVENT_TITLES.items()) + ")")
    return F.when(
        kind == "stage_advanced", F.when(_filled(to_stage), label).otherwise(T.STAGE_CHANGED)
    ).otherwise(F.coalesce(titles[kind], kind))


def event_detail(p: Column) -> Column:
    """The first part of a payload that has something to say."""
    value = lambda c: F.coalesce(c, F.lit("None"))
    return (
        F.when(p["note"].isNotNull(), p["note"])
        .when(p["text"].isNotNull(), p["text"])
        .when(_filled(p["ats_vendor"]), F.concat(F.lit("Automated reply from "), p["ats_vendor"]))
        .when(_filled(p["starts_at"]), F.concat(F.lit("Invite for "), _to_the_minute(p["starts_at"])))
        .when(_filled(p["due_at"]), F.concat(F.lit("Due "), _to_the_minute(p["due_at"])))
        .when(
            _filled(p["field"]),
            F.concat(p["field"], F.lit(": "), value(p["from"]), F.lit(" → "), value(p["to"])),
        )
        .when(
            F.coalesce(p["days_quiet"], F.lit(0)) != 0,
            F.concat(F.lit(T.NO_SIGNAL_START), p["days_quiet"].cast("string"), F.lit(T.NO_SIGNAL_END)),
        )
        .otherwise("")
    )


def event_provenance(rung: Column, p: Column) -> Column:
    return (
        F.when(rung.isNull() | (rung == C.HUMAN_RUNG), "quick add")
        .when(
            rung == 1,
            F.when(_filled(p["ats_vendor"]), F.concat(F.lit("gmail · "), p["ats_vendor"]))
            .otherwise("gmail · template"),
        )
        .when(
            rung == 2,
            F.when(_filled(p["calendar_event_id"]), "calendar · ics").otherwise("gmail · thread"),
        )
        .otherwise("gmail · model")
    )


def what_happened(
    kind: Column, p: Column, to: Column, to_label: Column, after_label: Column, stage_label: Column
) -> Column:
    """One line for a recent event."""
    return (
        F.when(kind == "offer_received", "Offer received")
        .when(
            kind == "rejected",
            F.when(
                _filled(p["after_stage"]), F.concat(F.lit("Rejected after the "), F.lower(after_label))
            ).otherwise("Rejected"),
        )
        .when(
            kind == "interview_scheduled",
            F.concat(
                F.when(_filled(p["stage"]), stage_label).otherwise("Interview"), F.lit(" scheduled")
            ),
        )
        .when(
            kind == "stage_advanced",
            F.when(_filled(to), F.concat(F.lit(T.MOVED_TO), F.lower(to_label)))
            .otherwise(T.STAGE_CHANGED),
        )
        .when(kind == "acknowledged", T.ACKNOWLEDGED)
        .when(kind == "applied", T.SENT)
        .otherwise(F.translate(kind, "_", " "))
    )


def number_word(n: Column) -> Column:
    words = F.expr("array(" + ", ".join(f"'{w}'" for w in C.NUMBER_WORDS) + ")")
    return F.when(n.between(0, 12), F.get(words, n.cast("int"))).otherwise(n.cast("string"))


def headline(moved: Column, live: Column, suggestions: Column) -> dict[str, Column]:
    kind = (
        F.when(moved > 0, "moved").when(live == 0, "empty").when(suggestions == 0, "clear")
        .otherwise("waiting")
    )
    text = (
        F.when(moved > 0, F.concat(number_word(moved), F.lit(T.HEAD_MOVED)))
        .when(live == 0, T.HEAD_EMPTY)
        .when(suggestions == 0, T.HEAD_CLEAR)
        .otherwise(F.concat(number_word(live), F.lit(T.HEAD_WAITING)))
    )
    return {"headline_kind": kind, "headline": text}


def _percent_encoded(text: Column) -> Column:
    """URL quoting that keeps slashes and writes a space as %20."""
    quoted = F.url_encode(text)
    for wrong, right in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        quoted = F.replace(quoted, F.lit(wrong), F.lit(right))
    return quoted


def draft(company: Column, language: Column, last_event: Column, thread_id: Column) -> dict[str, Column]:
    """A follow-up message, to be sent by a person."""
    italian = F.coalesce(language == "it", F.lit(False))
    subject = F.when(italian, F.concat(F.lit("Re: candidatura "), company)).otherwise(
        F.concat(F.lit("Re: "), company, F.lit(" application"))
    )
    said = F.lower(last_event)
    context = (
        F.when(italian & _filled(last_event), F.concat(F.lit(T.DRAFT_FOR_IT), said, F.lit(".")))
        .when(_filled(last_event), F.concat(F.lit(T.DRAFT_FOR_EN), said, F.lit(".")))
        .when(italian, T.DRAFT_TIME_IT)
        .otherwise(T.DRAFT_TIME_EN)
    )
    body = F.when(
        italian,
        F.concat(
            F.lit(T.DRAFT_OPEN_IT), context,
            F.lit(T.DRAFT_END_IT),
        ),
    ).otherwise(
        F.concat(
            F.lit(T.DRAFT_OPEN_EN), context,
            F.lit(T.DRAFT_END_EN),
        )
    )
    thread = F.concat(F.lit("<"), F.regexp_replace(thread_id, "^[<>]+|[<>]+$", ""), F.lit(">"))
    url = F.concat(
        F.lit("mailto:?subject="), _percent_encoded(subject), F.lit("&body="), _percent_encoded(body),
        F.when(_filled(thread_id), F.concat(F.lit("&In-Reply-To="), _percent_encoded(thread)))
        .otherwise(""),
    )
    return {"subject": subject, "body": body, "mailto_url": url, "can_send": F.lit(False)}
