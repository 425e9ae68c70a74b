"""Thresholds and vocabularies that decide results.

Everything here is a fixed value: it must stay exactly as it is for the results
to match the published behaviour of the system this package re-expresses.
"""

# --- fixed values: resolution ------------------------------------------------
ATTACH_SINGLE = 0.72
ATTACH_MULTI = 0.82
AMBIGUITY_MARGIN = 0.05
AMBIGUOUS_SHORTLIST = 3
MERGE_COSINE = 0.93
MERGE_WINDOW_DAYS = 14
MERGE_UNDO_DAYS = 14
UNMERGEABLE_STAGES = ("offer", "negotiating")
CONFIDENCE_FLOOR = 0.60
PINNED_CONFIDENCE = 1.0
EMBEDDING_DIMS = 384
NGRAM_WEIGHT = 0.4
NGRAM_SIZE = 4

# --- fixed values: display gates ----------------------------------------------
RATIOS_MIN_CLOSED = 8
SMALL_SAMPLE_MAX = 15
DWELL_MIN_TRANSITIONS = 5
SEASONAL_MIN_QUARTERS = 2
CHANNEL_MIN_APPLICATIONS = 3
MATURITY_DAYS = 21

# --- fixed values: screening ---------------------------------------------------
SCREEN_PASS = 3
SCREEN_CHEAP_ONLY = 1
NEWSLETTER_MIN_DROPS = 5
MODEL_DISCOUNT = 0.9
EXCERPT_CHARS = 280

# --- fixed values: silence, nudges, notifications -------------------------------
PRESUMED_CLOSED_DAYS = 90
NO_REPLY_CLOSED_DAYS = 60
USER_OWES_STAGES = ("negotiating", "offer", "take_home")
UNKNOWN_STALE_DAYS = 21
DEADLINE_WINDOW_DAYS = 7
PREPARE_WINDOW_HOURS = 48
FOLLOW_UP_EXPIRY_DAYS = 14
FOLLOW_UP_STALE_SHARE = 0.6
LET_IT_GO_DAYS = 7
MAX_OPEN_SUGGESTIONS = 3
MAX_PUSH_PER_DAY = 1
QUIET_FROM = "21:00"
QUIET_TO = "08:00"
PARK_MAX_ATTEMPTS = 6
DEAD_LETTER_ATTEMPTS = 5
RETENTION_MAX_DAYS = 7

# --- fixed values: event vocabulary ----------------------------------------------
EVENT_TYPES = (
    "applied", "acknowledged", "stage_advanced", "interview_scheduled", "interview_held",
    "deadline_set", "offer_received", "offer_negotiated", "rejected", "withdrawn", "accepted",
    "went_silent", "human_corrected", "note_added",
)
TERMINAL = ("rejected", "withdrawn", "accepted")
INBOUND = (
    "applied", "acknowledged", "stage_advanced", "interview_scheduled", "interview_held",
    "deadline_set", "offer_received", "offer_negotiated", "rejected",
)
HUMAN_REPLY = (
    "stage_advanced", "interview_scheduled", "interview_held", "offer_received",
    "offer_negotiated", "rejected", "deadline_set",
)
DWELL_TYPES = ("stage_advanced", "applied", "acknowledged", "interview_scheduled", "offer_received")
HUMAN_AUTHORED = ("human_corrected", "note_added", "withdrawn", "accepted")
HUMAN_RUNG = 4
STATUSES = ("live", "dormant", "rejected", "withdrawn", "accepted")
PHASES = ("sent", "screening", "interviewing", "decided")
CHANNELS = ("linkedin", "indeed", "career_page", "referral", "recruiter", "other")
CORRECTABLE = (
    "stage", "status", "role_title", "seniority", "location", "work_mode", "channel",
    "applied_at", "comp_expectation",
)
QUEUES = ("raw_message", "candidate_message", "signal_extracted", "event_pending", "notify_pending")

# --- fixed values: default stage table (key, label, phase, depth, stale_after_days) --
DEFAULT_STAGES = (
    ("applied", "Applied", "sent", 1, 21),
    ("acknowledged", "Acknowledged", "sent", 2, 21),
    ("recruiter_reachout", "Recruiter reach-out", "screening", 4, 10),
    ("hr_call", "HR call", "screening", 5, 10),
    ("take_home", "Take-home", "screening", 6, 14),
    ("interview", "Interview", "interviewing", 7, 12),
    ("technical", "Technical", "interviewing", 8, 12),
    ("system_design", "System design", "interviewing", 9, 12),
    ("onsite_loop", "Onsite loop", "interviewing", 10, 14),
    ("final", "Final", "interviewing", 11, 10),
    ("offer", "Offer", "decided", 12, 7),
    ("negotiating", "Negotiating", "decided", 13, 7),
)
UNSPECIFIED_INTERVIEW = "interview"

# --- fixed values: wording ---------------------------------------------------------
EVENT_TITLES = {
    "applied": "Applied",
    "acknowledged": "Acknowledged",
    "interview_scheduled": "Interview scheduled",
    "interview_held": "Interview held",
    "deadline_set": "Deadline detected",
    "offer_received": "Offer received",
    "offer_negotiated": "Offer revised",
    "rejected": "Rejected",
    "withdrawn": "Withdrawn",
    "accepted": "Accepted",
    "went_silent": "Went quiet",
    "human_corrected": "You corrected this",
    "note_added": "Note",
}
NUMBER_WORDS = (
    "Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten",
    "Eleven", "Twelve",
)
CURRENCY_SYMBOLS = {"EUR": "€", "GBP": "£", "USD": "$", "JPY": "¥"}
RULE_URGENCY = {"deadline": 0, "prepare": 1, "follow_up_due": 2, "let_it_go": 3}
