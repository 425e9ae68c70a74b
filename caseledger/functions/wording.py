"""Sentences that people, and tests of results, read."""

# --- fixed values: wording that results must carry, in the order of the jobs that use it -------------

# Why a message is read: one reason per test of the screen.
REASON_VENDOR = "sender is a known ATS vendor"
REASON_COMPANY = "direct mail from a company already in the pipeline"
REASON_STRONG = "subject or opening names an application unambiguously"
REASON_WEAK_BACKED = "ambiguous vocabulary, corroborated by another signal"
REASON_WEAK = "ambiguous vocabulary alone — enough to look at, not enough to trust"
REASON_THREAD = "reply on a thread already attached to an application"
REASON_INVITE = "carries a calendar invite"
REASON_MEETING = "meeting link from a business domain"
REASON_BULK = "bulk mail"
REASON_WAIVED = "bulk penalty waived: LinkedIn/Indeed confirmations look exactly like their alerts"
REASON_NOISE = "platform notification, not an application"
REASON_ROBOT = "no-reply sender with no vocabulary hit"
REASON_SOCIAL = "social or developer notification"

# Why two cases stay apart.
APART_OFFER = "an offer or negotiation is open"
APART_ACCEPTED = "one of them was accepted"
APART_BY_HAND = "one of them was declared by hand"
APART_MODE = "different work mode"
APART_COUNTRY = "different country"
APART_SPLIT = "a human split them before"

# Nudges.
DEADLINE_BODY = " email. This is the only alert allowed to interrupt you."
PREPARE_BODY = (
    "The posting, the thread, and everything you have already written about this company, in one place."
)
FOLLOW_UP_PLAIN = "Nothing has come back in %d days. A short nudge is normal here."
FOLLOW_UP_MEDIAN = (
    "You last heard from them %d days ago and your median wait at this stage is %d days. A short nudge is normal here."
)
LET_GO_BODY = (
    "Silent past twice your usual wait. Archiving keeps your ratios honest — they stay in the statistics as ghosted."
)

# Help lines of the gauges.
GAUGE_QUEUES = "Messages waiting per queue"
GAUGE_DEAD = "Messages in a dead-letter queue"
GAUGE_REVIEWS = "Open review items"
GAUGE_FRESHNESS = "Seconds since a mailbox last read successfully"

# Drafts, in Italian and English.
DRAFT_OPEN_IT, DRAFT_OPEN_EN = "Ciao,\n\n", "Hi,\n\n"
DRAFT_FOR_IT, DRAFT_FOR_EN = "grazie ancora per ", "thanks again for the "
DRAFT_TIME_IT, DRAFT_TIME_EN = "grazie ancora per il tempo dedicato.", "thanks again for your time."
DRAFT_END_IT = "\nServe qualcosa da parte mia mentre il team decide?\n\nUn saluto,"
DRAFT_END_EN = "\nIs there anything you need from my side while the team decides?\n\nBest,"

# Gates.
SEASONAL_START, SEASONAL_END = (
    "Seasonal averages need ", " of history before they mean anything, so they are hidden rather than shown noisy."
)

# Questions to a person.
PARKED_QUESTION = "The model was unreachable for this message. Answering it here teaches the rules either way."
CANCELLED_QUESTION = "An interview was cancelled. Is this application still moving?"

# The log and the first screen.
NO_SIGNAL_START, NO_SIGNAL_END = "No inbound signal for ", " days"
GONE_QUIET = " has gone quiet since the "
MOVED_TO, STAGE_CHANGED = "Moved to ", "Stage changed"
ACKNOWLEDGED, SENT = "Application acknowledged", "Application sent"
HEAD_MOVED, HEAD_EMPTY = " moved / forward / this week", "Nothing / to track yet"
HEAD_CLEAR, HEAD_WAITING = "You are / clear today", " applications / waiting"
