"""Vendor templates: the built-in ones, and others read from a folder.

A rule says which domains a vendor writes from and, in order, what its subjects and bodies mean.
"""

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .vocab import INTENTS


class RulesError(ValueError):
    """A rule folder that cannot be used."""


@dataclass(frozen=True)
class Pattern:
    intent: str
    confidence: float
    subject: str | None = None
    body: str | None = None
    extract: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Rule:
    vendor: str
    domains: tuple[str, ...]
    company_from: str
    patterns: tuple[Pattern, ...]
    headers: tuple[tuple[str, str | None], ...] = field(default=())


def _p(intent, confidence, subject=None, body=None, **extract):
    return Pattern(intent, confidence, subject, body, tuple(extract.items()))


# --- fixed values: vendor templates, in order ------------------------------------------
BUILT_IN = (
    Rule("allibo", ("allibo.com",), "sender_display_name", (
        _p("acknowledged", 0.97, subject=r"^candidatura ricevuta"),
        _p("acknowledged", 0.95, body=r"confermiamo di aver ricevuto (il tuo cv|la tua candidatura)"),
        _p("rejected", 0.94, body=r"(non (abbiamo|è) (individuato|stata selezionata)|non proseguir(e|emo)|altri candidati)"),
    )),
    Rule("ashby", ("ashbyhq.com", "mail.ashbyhq.com", "notifications.ashbyhq.com"), "sender_display_name", (
        _p("acknowledged", 0.98, subject=r"^thanks for applying to\b"),
        _p("acknowledged", 0.97, subject=r"^your application (?:to|at)\b"),
        _p("acknowledged", 0.97, subject=r"^application at .+? for (?<role>.+)$"),
        _p("rejected", 0.96, subject=r"application update",
           body=r"(not moving forward|not be moving forward|decided to pursue other|other candidates|unfortunately)"),
        _p("interview_invite", 0.93, subject=r"application update",
           body=r"(would like to invite|schedule (?:a|an) (?:call|interview)|next (?:step|round))"),
        _p("interview_invite", 0.93, subject=r"^(?:interview|chat) with\b"),
        _p("take_home", 0.92, body=r"(take[- ]home|coding (?:exercise|challenge)|technical assignment)",
           deadline=r"(?:by|before|due) (?<deadline>[A-Z][a-z]+day[^\.\n]{0,30}|\d{1,2} [A-Z][a-z]+[^\.\n]{0,20})"),
        _p("rejected", 0.96, body=r"(not moving forward|decided to pursue other candidates)"),
    )),
    Rule("bamboohr", ("bamboohr.com", "mail.bamboohr.com"), "subject_capture", (
        _p("acknowledged", 0.98, subject=r"^(?<company>.+?) (?:Application Confirmation|has received your application)$"),
        _p("rejected", 0.95, body=r"(chosen to move forward with other|position has been filled)"),
    )),
    Rule("greenhouse", ("greenhouse-mail.io", "eu.greenhouse-mail.io", "greenhouse.io", "my.greenhouse.io"), "subject_capture", (
        _p("acknowledged", 0.99, subject=r"^Thank you for applying to (?<company>.+?)\s*$",
           body=r"(we have received your application|thanks for (your interest|applying))",
           role=r"application for the (?<role>[^,\.\n]+?) (?:position|role)"),
        _p("acknowledged", 0.97, subject=r"^Your application to (?<company>.+)$"),
        _p("schedule_screening", 0.94, subject=r"^(?<company>.+?)\s*\|\s*Interview availability",
           role=r"for the (?<role>[^,\.]+?) (position|role)"),
        _p("interview_invite", 0.93, subject=r"^(Interview|Your interview) (with|at) (?<company>.+)$",
           role=r"for the (?<role>[^,\.]+?) (position|role)"),
        _p("rejected", 0.97, body=r"(will not be moving forward|decided to move forward with other|not to move forward with your application)"),
        _p("rejected", 0.96, subject=r"^Update for the (?<role>.+?) opportunity\s*$",
           body=r"(we have filled the|no longer be interviewing further applicants)",
           company=r"The (?<company>.+?) Talent Team"),
        _p("offer", 0.9, subject=r"^(Offer|Your offer) (from|at) (?<company>.+)$"),
    )),
    Rule("icims", ("icims.com", "talent.icims.com"), "subject_capture", (
        _p("acknowledged", 0.96, subject=r"^(?:Thank you for your interest in|Application confirmation).*?(?:at (?<company>.+))?$"),
        _p("rejected", 0.95, body=r"(pursuing other candidates|position has been filled)"),
    )),
    Rule("indeed", ("indeed.com", "indeedemail.com", "match.indeed.com"), "subject_capture", (
        _p("applied", 0.97, subject=r"^(?:Indeed Application|Candidatura Indeed):\s*(?<role>.+?)(?:\s*[-–]\s*(?<company>.+))?$"),
        _p("applied", 0.97, subject=r"^(?:You applied to|Ti sei candidato a) (?<role>.+?) (?:at|presso) (?<company>.+)$"),
        _p("acknowledged", 0.88, subject=r"^(?:Your application to|La tua candidatura a) (?<company>.+?) (?:was viewed|è stata visualizzata)"),
    )),
    Rule("lever", ("lever.co", "hire.lever.co", "hire.eu.lever.co", "mail.lever.co"), "sender_display_name", (
        _p("acknowledged", 0.98, subject=r"^(?:.{0,40}?[-–—]\s*)?thank you for your application (?:to|at)\b"),
        _p("acknowledged", 0.97, subject=r"thank you for (?:your )?appl(?:ying|ication)\b"),
        _p("acknowledged", 0.97, subject=r"^thank you from .+?[-–—]\s*regarding your application for (?<role>.+)$"),
        _p("acknowledged", 0.97, subject=r"^thanks for applying to (?<role>.+?)\s*,\s*here is a link to manage your application data$"),
        _p("acknowledged", 0.96, subject=r"^thanks for applying to (?<company_hint>.+?)!?$"),
        _p("interview_invite", 0.95, subject=r"you'?re (?:invited to an )?interview with\b"),
        _p("schedule_screening", 0.88, subject=r"\b(recruitment process|followup|follow[- ]up)\b"),
        _p("rejected", 0.96, body=r"(moving forward with other candidates|not be moving forward|decided not to proceed|will not be progressing|unfortunately, (?:we|after))"),
        _p("other", 0.9, subject=r"\b(webinar|job opportunity|newsletter|event)\b"),
    )),
    Rule("linkedin", ("linkedin.com", "e.linkedin.com", "bounce.linkedin.com"), "subject_capture", (
        _p("applied", 0.98, subject=r"^(?:Your application was sent to|La tua candidatura è stata inviata a) (?<company>.+)$"),
        _p("applied", 0.96, subject=r"^(?:Application sent|Candidatura inviata)",
           company=r"(?:sent to|inviata a) (?<company>[^\n]{2,60})"),
        _p("acknowledged", 0.9, subject=r"^(?:Your application was viewed by|La tua candidatura è stata visualizzata da) (?<company>.+)$"),
    )),
    Rule("recruitee", ("recruitee.com", "mail.recruitee.com"), "subject_capture", (
        _p("acknowledged", 0.98, subject=r"^(?<company>.+?) - (?:Application received|Candidatura ricevuta)$"),
        _p("acknowledged", 0.97, subject=r"^Thanks for applying at (?<company>.+)$"),
        _p("interview_invite", 0.9, subject=r"^(?:Invitation|Invito).*(?<company>)", body=r"(interview|colloquio)"),
        _p("rejected", 0.94, body=r"(we have decided not to|purtroppo non)"),
    )),
    Rule("smartrecruiters", ("smartrecruiters.com", "mail.smartrecruiters.com"), "subject_capture", (
        _p("acknowledged", 0.97, subject=r"^(Thank you for applying|Application received)(?:.*?(?:at|to) (?<company>.+))?$"),
        _p("schedule_screening", 0.9, body=r"(would like to schedule|propose a time|are you available)"),
        _p("rejected", 0.95, body=r"(we will not be proceeding|other applicants|non proseguiremo)"),
    )),
    Rule("taleo", ("taleo.net", "oraclecloud.com", "taleo.com"), "subject_capture", (
        _p("acknowledged", 0.96, subject=r"^(?:Candidatura ricevuta|Application (?:Received|Acknowledgement))(?:\s*[-–]\s*(?<company>.+))?$"),
        _p("rejected", 0.94, body=r"(no longer being considered|non è stato selezionato)"),
    )),
    Rule("workable", ("workablemail.com", "workable.com", "candidates.workablemail.com"), "subject_capture", (
        _p("acknowledged", 0.98, subject=r"^(?:Thank you for applying to|Your application to) (?<company>.+?)(?: has been received)?$",
           role=r"(?:application for|candidatura per) (?:the |la |il )?(?<role>[^,\.\n]{3,60}?)(?:\s+(?:position|role|posizione)|[\.\n])"),
        _p("take_home", 0.93, subject=r"(assignment|assessment|take[- ]home|esercizio)",
           deadline=r"(?:by|before|entro|due) (?<deadline>[^\.\n]{3,40})"),
        _p("rejected", 0.95, body=r"(not to move forward|unsuccessful on this occasion|non è andata a buon fine)"),
    )),
    Rule("workday", ("myworkday.com", "workday.com", "myworkdayjobs.com"), "subject_capture", (
        _p("acknowledged", 0.97, subject=r"^(Thank you for your (interest|application)|Application Received).*?(?:[-–|]\s*(?<company>.+))?$"),
        _p("acknowledged", 0.98, subject=r"^(?<company>.+?): Application Received$"),
        _p("schedule_screening", 0.9, body=r"(schedule (an|your) interview|select a time slot|choose an interview time)"),
        _p("rejected", 0.95, body=r"(no longer under consideration|other candidates whose|not selected for this position)"),
        _p("rejected", 0.94, body=r"(la sua candidatura non|non è stata selezionata|abbiamo deciso di proseguire con altri)"),
    )),
)

_SOURCES = ("sender_display_name", "subject_capture", "sender_domain", "body_capture")
_GROUP = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?:\?<(?P<name>[A-Za-z]\w*)>|(?P<special>\?))?")


def positional(pattern: str) -> tuple[str, dict[str, int]]:
    """A pattern with its named groups made plain, and the number of each name."""
    names: dict[str, int] = {}
    count = 0

    def replace(match: re.Match) -> str:
        nonlocal count
        text = match.group(0)
        if not text.startswith("("):
            return text
        if match.group("special"):
            return text
        count += 1
        if match.group("name"):
            names[match.group("name")] = count
            return "("
        return text

    return _GROUP.sub(replace, pattern), names


def _checked(raw: dict, where: str) -> Rule:
    """A rule file, refused when it has unknown keys or a pattern that matches on nothing."""
    def keys(found, allowed):
        extra = set(found) - set(allowed)
        if extra:
            raise RulesError(f"{where} is invalid: unknown {sorted(extra)}")

    keys(raw, ("vendor", "match", "patterns", "locale", "company_from", "tests"))
    match = raw.get("match") or {}
    keys(match, ("sender_domains", "headers"))
    patterns = []
    for p in raw.get("patterns") or ():
        keys(p, ("intent", "confidence", "subject", "body", "extract", "locale"))
        if not p.get("subject") and not p.get("body"):
            raise RulesError(f"{where} is invalid: a pattern needs a subject or a body to match on")
        if p.get("intent") not in INTENTS or not 0 <= float(p.get("confidence", -1)) <= 1:
            raise RulesError(f"{where} is invalid: intent or confidence")
        for text in (p.get("subject"), p.get("body"), *(p.get("extract") or {}).values()):
            if text:
                re.compile(positional(text)[0])
        patterns.append(
            Pattern(p["intent"], float(p["confidence"]), p.get("subject"), p.get("body"),
                    tuple((p.get("extract") or {}).items()))
        )
    source = raw.get("company_from", "sender_display_name")
    if not raw.get("vendor") or not match.get("sender_domains") or not patterns or source not in _SOURCES:
        raise RulesError(f"{where} is invalid")
    return Rule(raw["vendor"], tuple(match["sender_domains"]), source, tuple(patterns),
                tuple((match.get("headers") or {}).items()))


def load_rules(folder: str) -> tuple[Rule, ...]:
    """Rule files of a folder, sorted by name. A small configuration, read once by the driver."""
    files = sorted(p for p in Path(folder).iterdir() if p.suffix in {".yaml", ".yml", ".json"})
    if not files:
        raise RulesError(f"no rule files in {folder}")
    rules = []
    for path in files:
        text = path.read_text(encoding="utf-8")
        if path.suffix == ".json":
            raw = json.loads(text)
        else:
            try:
                import yaml
            except ImportError as error:
                raise RulesError("YAML rules need the yaml module; JSON works without") from error
            raw = yaml.safe_load(text)
        rules.append(_checked(raw, path.name))
    return tuple(rules)


def vendor_domains(rules: tuple[Rule, ...]) -> list[str]:
    return list(dict.fromkeys(d for r in rules for d in r.domains))


def rule_tables(spark: SparkSession, rules: tuple[Rule, ...] = BUILT_IN) -> tuple[DataFrame, DataFrame]:
    """(vendor, domain, ord) and (vendor, ord, intent, confidence, subject_re, body_re)."""
    domains = [(r.vendor, d, i) for i, r in enumerate(rules) for d in r.domains]
    patterns = [
        (r.vendor, i, p.intent, p.confidence, p.subject, p.body)
        for r in rules for i, p in enumerate(r.patterns)
    ]
    return (
        spark.createDataFrame(domains, "vendor string, domain string, ord int"),
        spark.createDataFrame(
            patterns,
            "vendor string, ord int, intent string, confidence double, subject_re string,"
            " body_re string",
        ),
    )
