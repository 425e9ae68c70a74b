"""Word lists and patterns that decide what a message means.

Everything here is a fixed value and must stay exactly as it is for the results to match.
"""

# --- fixed values: domains ---------------------------------------------------------
BULK_WHITELIST = (
    "linkedin.com", "e.linkedin.com", "bounce.linkedin.com", "indeed.com", "match.indeed.com",
    "indeedemail.com",
)
SOCIAL_NOISE = (
    "facebook.com", "facebookmail.com", "twitter.com", "x.com", "instagram.com", "github.com",
    "gitlab.com", "notifications.google.com", "youtube.com", "medium.com", "substack.com",
    "meetup.com", "slack.com", "discord.com", "reddit.com", "quora.com", "pinterest.com",
    "tiktok.com",
)
MEETING_HOSTS = (
    "meet.google.com", "zoom.us", "teams.microsoft.com", "teams.live.com", "whereby.com",
    "meet.jit.si", "webex.com", "gotomeeting.com", "around.co",
)
PERSONAL_MAIL = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "hotmail.it", "live.com",
    "yahoo.com", "yahoo.it", "icloud.com", "me.com", "proton.me", "protonmail.com", "libero.it",
    "virgilio.it", "alice.it", "tiscali.it", "fastwebnet.it", "tin.it", "gmx.de", "web.de",
)
LEARNING_PLATFORMS = (
    "leetcode.com", "hackerrank.com", "codewars.com", "codingame.com", "coursera.org",
    "udemy.com", "udacity.com", "datacamp.com", "educative.io", "algoexpert.io",
    "pluralsight.com", "codecademy.com", "kaggle.com",
)
RELAY_ADDRESSES = (
    "hit-reply@linkedin.com", "inmail-hit-reply@linkedin.com", "messages-noreply@linkedin.com",
)
# Kept as they are by the anonymiser although no rule names them.
ALSO_KEPT_DOMAINS = ("linkedin.com", "indeed.com", "indeedemail.com", "allibo.com")

# --- fixed values: screening vocabulary ----------------------------------------------
STRONG_KEYWORDS = (
    r"candidatur|candidacy|\bapplication\b|applying|colloqui|interview|recruit|assunzione"
    r"|hiring|\bcurriculum\b|\bCV\b|risorse umane|talent acquisition|job offer"
    r"|offerta di lavoro|proposta di assunzione|processo di selezione"
)
WEAK_KEYWORDS = r"posizione|selezione|offerta|\brole\b|vacancy|talent|opportunit"
PLATFORM_NOISE = (
    r"profilo è apparso|appeared in \d+ search|persone ti hanno notato"
    r"|ha accettato il tuo invito|accepted your invitation|inizia una conversazione con"
    r"|hanno aggiornamenti per te|fai le congratulazioni|congratulate"
    r"|ha aggiunto una reazione|vedi i collegamenti|vorrei collegarmi|voglio collegarmi"
    r"|hai \d+ nuov(?:o|i) (?:invito|inviti|messaggi)|nuovo invito|sent you a message"
    r"|ti ha inviato un messaggio|avvisi? di offerte di lavoro|job alert|abbiamo disattivato"
    r"|sblocca informazioni|verifica il tuo nuovo dispositivo|livello di protezione"
    r"|two[- ]factor|autenticazione a due fattori|terms of service|termini di servizio"
    r"|condizioni d'uso|newsletter|webinar|unsubscribe preferences|saldi|in saldo"
    r"|spedizione gratuita|sconto"
)
NO_REPLY = r"^(?:no[-._]?reply|do[-._]?not[-._]?reply|noreply)@"
BULK_PRECEDENCE = r"bulk|list"

# --- fixed values: phrases (intent, confidence, came with the recall audit, pattern) ---
PHRASES = (
    ("rejected", 0.95, True,
     r"\b(?:not\s+(?:be\s+)?mov(?:e|ing)\s+forward|decision\s+to\s+not\s+move\s+forward"
     r"|moving\s+forward\s+with\s+other|other\s+candidates|decided\s+not\s+to\s+proceed"
     r"|will\s+not\s+be\s+progressing|unable\s+to\s+offer\s+you"
     r"|no\s+longer\s+be\s+interviewing|we\s+have\s+filled\s+the\b"
     r"|not\s+(?:been\s+)?select(?:ed)?)\b"),
    ("rejected", 0.95, False,
     r"\b(?:non\s+(?:siamo|sarà|possiamo)\s+(?:in\s+grado\s+)?(?:di\s+)?"
     r"(?:proceder|prosegui|dar\s+seguito)|abbiamo\s+deciso\s+di\s+non\s+proceder"
     r"|non\s+proseguir(?:e|emo)|non\s+è\s+stata\s+selezionata"
     r"|ti\s+terremo\s+in\s+considerazione\s+per\s+future|non\s+abbiamo\s+individuato"
     r"|purtroppo\s+(?:non|la\s+tua))\b"),
    ("acknowledged", 0.94, False,
     r"\b(?:thank\s+you\s+for\s+(?:applying|your\s+application)"
     r"|we\s+(?:have\s+)?received\s+your\s+application"
     r"|appreciate\s+your\s+interest\s+in\s+joining)\b"),
    ("acknowledged", 0.94, False,
     r"\b(?:grazie\s+per\s+(?:la\s+tua\s+candidatura|averci\s+inviato|il\s+tuo\s+interesse)"
     r"|abbiamo\s+ricevuto\s+la\s+tua\s+candidatura)\b"),
    ("acknowledged", 0.94, True,
     r"\b(?:confermiamo\s+di\s+aver\s+ricevuto\s+(?:la\s+tua\s+candidatura|il\s+tuo\s+cv)"
     r"|thanks\s+for\s+taking\s+the\s+time\s+to\s+apply)\b"),
    ("interview_invite", 0.9, True,
     r"\b(?:would\s+like\s+to\s+invite\s+you|invite\s+you\s+to\s+(?:an?\s+)?(?:interview|call)"
     r"|schedule\s+(?:a|an)\s+(?:call|interview|chat)"
     r"|next\s+step\s+in\s+(?:the|our)\s+process"
     r"|you(?:'|’)?re\s+invited\s+to\s+an\s+interview)\b"),
    ("interview_invite", 0.9, True,
     r"\b(?:vorremmo\s+invitarti|fissare\s+un\s+colloquio"
     r"|organizzare\s+un(?:\s+breve)?\s+(?:colloquio|call)"
     r"|disponibilità\s+per\s+un\s+colloquio"
     r"|(?:le|vi|ti)\s+confermiamo\s+il\s+colloquio)\b"),
    ("schedule_screening", 0.9, True,
     r"\b(?:(?:call|colloquio|incontro)\s+conoscitiv[oa]"
     r"|ti\s+confermo\s+(?:allora\s+)?la\s+nostra\s+(?:breve\s+)?(?:chiamata|call)"
     r"|opzioni\s+per\s+programmare|ecco\s+le\s+disponibilit[àa]"
     r"|saresti\s+disponibile\s+per\s+una\s+(?:breve\s+)?(?:chiamata|call))\b"),
    ("schedule_screening", 0.88, True,
     r"(?:ti\s+contatter[òo]|andare\s+bene|sentirci|risentirci|chiamarti)"
     r"[^.\n]{0,60}?\b(?:domani|luned[ìi]|marted[ìi]|mercoled[ìi]|gioved[ìi]|venerd[ìi]"
     r"|\d{1,2}[/.]\d{1,2})\b[^.\n]{0,40}?\bore\s+\d{1,2}"),
    ("schedule_screening", 0.9, True,
     r"\bI\s+just\s+(?:re)?scheduled\s+the\s+"
     r"(?:meeting|call|interview|tech(?:nical)?\s+interview)\b"),
    ("take_home", 0.9, False,
     r"\b(?:take[-\s]home|coding\s+(?:exercise|challenge)|technical\s+assignment"
     r"|prova\s+tecnica|esercizio\s+tecnico)\b"),
)
PHRASE_CEILING = 0.88
INVITE_CONFIDENCE = 0.97
CANCELLED_CONFIDENCE = 0.95

# --- fixed values: stage named by a meeting title, in order -------------------------------
TITLE_STAGES = (
    (r"\b(?:final|exec|leadership|founder|ceo|cto)\b", "final"),
    (r"\b(?:onsite|on-site|loop|super\s*day|assessment centre|full day)\b", "onsite_loop"),
    (r"\b(?:system\s*design|architecture|design (?:round|interview))\b", "system_design"),
    (r"\b(?:technical|coding|live\s*cod|pair\s*program|algorithm|code review)\b", "technical"),
    (r"\b(?:take[- ]home|assignment|exercise|challenge)\b", "take_home"),
    (r"\b(?:hr|people|talent|recruiter|screening|intro|introductory|first call|knowledge)\b",
     "hr_call"),
)
STAGE_FOR_INTENT = {
    "applied": "applied",
    "acknowledged": "acknowledged",
    "schedule_screening": "recruiter_reachout",
    "take_home": "take_home",
    "offer": "offer",
    "negotiation": "negotiating",
}
INTENTS = (
    "applied", "acknowledged", "schedule_screening", "interview_invite", "interview_cancelled",
    "take_home", "rejected", "offer", "negotiation", "other",
)

# --- fixed values: roles named in a body, in order; the first group is the role -------------
ROLE_PATTERNS = (
    r"\bapplication\s+for\s+the\s+(?:position\s+of\s+|role\s+of\s+)?([^.,\n<>|]{3,60}?)"
    r"\s*(?:position|role|opening|vacancy)?\s*(?:[.,\n]|at\b|with\b|$)",
    r"\bapplied\s+(?:to|for)\s+(?:the\s+)?([^.,\n<>|]{3,60}?)\s*(?:position|role|opening)\b",
    r"\bapply(?:ing)?\s+for\s+the\s+(?:position|role)\s+of\s+([^.,\n<>|]{3,60}?)"
    r"\s*(?:[.,\n]|at\b|with\b|$)",
    r"\b(?:position|role)\s+of\s+([^.,\n<>|]{3,60}?)\s*(?:[.,\n]|at\b|presso\b|$)",
    r"\byour\s+(?:candidacy|application)\s+(?:for|as)\s+(?:the\s+)?([^.,\n<>|]{3,60}?)"
    r"\s*(?:[.,\n]|at\b|$)",
    r"(?m)^\s*(?:position|role|job\s+title)\s*:\s*([^\n]{3,60})$",
    r"\binterview\s+for\s+the\s+([^.,\n<>|]{3,60}?)\s*(?:position|role)\b",
    r"\bcandidatura\s+(?:per|come)\s+(?:la\s+posizione\s+di\s+|il\s+ruolo\s+di\s+)?"
    r"([^.,\n<>|]{3,60}?)\s*(?:[.,\n]|presso\b|in\b|$)",
    r"\bposizione\s+di\s+([^.,\n<>|]{3,60}?)\s*(?:[.,\n]|presso\b|$)",
    r"\bposizione\s+([^.,\n<>|]{3,60}?)\s*(?:[.,\n]|[-–—]|presso\b|$)",
    r"\bopportunit[àa]\s+[^\n]{0,40}?[-–—]\s*([^.,\n<>|(]{3,60})",
    r"(?m)^\s*(?:posizione|ruolo)\s*:\s*([^\n]{3,60})$",
    r"\bcolloquio\s+(?:per|come)\s+(?:la\s+posizione\s+di\s+)?([^.,\n<>|]{3,60}?)"
    r"\s*(?:[.,\n]|presso\b|$)",
    r"\bopportunità\s+(?:di|come)\s+([^.,\n<>|]{3,60}?)\s*(?:[.,\n]|presso\b|$)",
)
ROLE_VOCABULARY = (
    r"engineer|developer|scientist|manager|analyst|designer|consultant|architect|specialist"
    r"|researcher|intern|lead|director|programmer|administrator|technician|ingegner|sviluppat"
    r"|analista|consulente|responsabile|stagista|tirocinan|progettista|tecnico|ricercator"
)
NOT_A_TITLE = r"[@]|https?:|\bunsubscribe\b|\bclick\b"
SENTENCE_RESUMES = (
    r"\b(?:was|were|is|are|has|have|been|sent|will|we|you|your|our"
    r"|è|sono|stata|stato|inviata|inviato|abbiamo|tua|tuo)\b.*$"
)
ROLE_MAX_WORDS = 6
ROLE_MIN_CHARS = 3
ROLE_MAX_CHARS = 60

# --- fixed values: sender names -----------------------------------------------------------
DISPLAY_NAME = r"""^\s*"?([^"<]+?)"?\s*<"""
VIA_VENDOR = r"\s*[\[(]?\bvia\s+\w+[\])]?\s*$"
RECRUITING_SUFFIX = (
    r"\s*(?:\b(?:hiring|recruiting|recruitment|talent(?:\s+acquisition)?|careers?|jobs?"
    r"|people(?:\s+ops)?|hr)\b\s*)*(?:\bteam\b)?\s*$"
)
RECRUITING_PREFIX = r"^(?:careers?|jobs?|recruit(?:ing|ment)|talent|hr|people)\s*[@|·:–—-]\s*"
ROBOT_FRAGMENT = r"noreply|donotreply|recruiting|hrteam|talentteam"
ROBOT_NAME = (
    r"^(?:no[-\s._]?reply|do[-\s._]?not[-\s._]?reply|notifications?|support|info|admin)$"
)
POSTING_URL = (
    r"""https?://[^\s<>"')]*/(?:jobs?|careers?|posizioni|vacanc\w*|opportunit\w*)/[^\s<>"')]*"""
)

# --- fixed values: language ------------------------------------------------------------------
ITALIAN_WORDS = r"\b(?:il|la|per|non|che|della|candidatura|colloquio|grazie|cordiali|saluti)\b"
ENGLISH_WORDS = r"\b(?:the|for|your|with|application|interview|thanks|regards|we|have)\b"

# --- fixed values: quoted history ---------------------------------------------------------------
QUOTE_MARKERS = (
    r"^\s*On .{5,120}\s+wrote:\s*$",
    r"^\s*Il .{5,120}\s+ha scritto:\s*$",
    r"^\s*-{2,}\s*Original Message\s*-{2,}\s*$",
    r"^\s*-{2,}\s*Messaggio originale\s*-{2,}\s*$",
    r"^\s*From:\s.+\n\s*Sent:\s",
    r"^\s*Da:\s.+\n\s*Inviato:\s",
    r"^_{10,}\s*$",
)

# --- fixed values: company names --------------------------------------------------------------------
LEGAL_SUFFIXES = (
    "s.r.l.s.", "s.r.l.", "srls", "srl", "s.p.a.", "spa", "s.a.s.", "sas", "s.n.c.", "snc",
    "s.a.p.a.", "sapa", "gmbh", "mbh", "ag", "kg", "ohg", "ug", "inc.", "inc", "llc", "l.l.c.",
    "ltd.", "ltd", "limited", "plc", "corp.", "corp", "corporation", "company", "co.", "b.v.",
    "bv", "n.v.", "nv", "s.a.", "sa", "s.à.r.l.", "sarl", "oy", "oyj", "ab", "a/s", "as", "aps",
    "kft", "zrt", "d.o.o.", "doo", "pte", "pty", "sp. z o.o.", "sp z oo",
)

# --- fixed values: roles --------------------------------------------------------------------------------
SENIORITY = {
    "jr": "junior", "junior": "junior", "grad": "junior", "graduate": "junior", "entry": "junior",
    "intern": "intern", "internship": "intern", "trainee": "intern", "mid": "mid",
    "middle": "mid", "mid-level": "mid", "sr": "senior", "senior": "senior", "snr": "senior",
    "staff": "staff", "principal": "principal", "lead": "lead", "head": "head",
    "director": "director", "vp": "vp", "chief": "chief", "i": "mid", "ii": "mid",
    "iii": "senior", "iv": "senior",
}
EXPANSIONS = {
    "sr": "senior", "jr": "junior", "eng": "engineer", "engr": "engineer",
    "engineering": "engineer", "dev": "developer", "devel": "developer", "be": "backend",
    "back-end": "backend", "fe": "frontend", "front-end": "frontend", "fs": "fullstack",
    "full-stack": "fullstack", "swe": "software engineer", "sde": "software engineer",
    "sre": "site reliability engineer", "ml": "machine learning",
    "ai": "artificial intelligence", "qa": "quality assurance", "pm": "product manager",
    "po": "product owner", "ux": "user experience", "ui": "user interface", "db": "database",
    "k8s": "kubernetes", "infra": "infrastructure", "ops": "operations",
}
CONTRACT_TERMS = (
    "full time", "full-time", "fulltime", "part time", "part-time", "parttime", "permanent",
    "temporary", "contract", "contractor", "freelance", "fixed term", "fixed-term", "internship",
    "apprenticeship", "tempo indeterminato", "tempo determinato", "stage", "tirocinio",
    "unbefristet", "festanstellung", "m/f/d", "f/m/d", "m/w/d", "w/m/d", "m/f/x", "d/f/m", "h/f",
    "m/f",
)
WORK_MODES = (
    (r"\b(fully\s+)?remote\b|\bda\s+remoto\b|\bsmart\s*working\b|\bwfh\b", "remote"),
    (r"\bhybrid\b|\bibrido\b", "hybrid"),
    (r"\bon[-\s]?site\b|\bin[-\s]?office\b|\bin\s+sede\b", "onsite"),
)
PLACES = (
    "milan", "milano", "rome", "roma", "turin", "torino", "naples", "napoli", "bologna",
    "florence", "firenze", "venice", "venezia", "genoa", "genova", "bari", "palermo", "trento",
    "trieste", "padova", "padua", "verona", "brescia", "bergamo", "biassono", "berlin", "munich",
    "münchen", "hamburg", "frankfurt", "cologne", "köln", "stuttgart", "london", "manchester",
    "dublin", "edinburgh", "paris", "lyon", "toulouse", "madrid", "barcelona", "lisbon",
    "lisboa", "porto", "amsterdam", "rotterdam", "brussels", "zurich", "zürich", "geneva",
    "vienna", "wien", "prague", "warsaw", "stockholm", "copenhagen", "oslo", "helsinki",
    "tallinn", "vilnius", "riga", "bucharest", "sofia", "budapest", "athens", "istanbul",
    "krakow", "kraków", "italy", "italia", "germany", "deutschland", "france", "spain", "españa",
    "portugal", "netherlands", "belgium", "switzerland", "austria", "poland", "sweden",
    "denmark", "norway", "finland", "ireland", "uk", "united kingdom", "europe", "eu", "emea",
    "remote", "hybrid", "onsite", "on-site", "anywhere",
)
COUNTRIES = (
    (("milan", "milano", "rome", "roma", "turin", "torino", "napoli", "naples", "bologna",
      "italy", "italia", "trento", "biassono"), "it"),
    (("berlin", "munich", "münchen", "hamburg", "frankfurt", "germany", "deutschland"), "de"),
    (("london", "manchester", "uk", "united kingdom"), "gb"),
    (("paris", "lyon", "france"), "fr"),
    (("madrid", "barcelona", "spain"), "es"),
    (("amsterdam", "netherlands"), "nl"),
)

# --- fixed values: posting pages ----------------------------------------------------------------------
POSTING_VENDORS = (
    (r"greenhouse\.io|greenhouse-mail", "greenhouse"),
    (r"lever\.co", "lever"),
    (r"myworkday|workday", "workday"),
    (r"ashbyhq", "ashby"),
    (r"smartrecruiters", "smartrecruiters"),
    (r"workable", "workable"),
    (r"icims", "icims"),
    (r"taleo|oraclecloud", "taleo"),
    (r"recruitee", "recruitee"),
    (r"bamboohr", "bamboohr"),
)

# --- fixed values: privacy -------------------------------------------------------------------------------
DENIED_KEYS = (
    "health", "health_status", "medical", "medical_condition", "illness", "sick", "disability",
    "disabilities", "accommodation", "accommodations", "impairment", "ethnicity", "ethnic",
    "race", "racial", "nationality_origin", "skin", "religion", "religious", "faith", "belief",
    "beliefs", "union", "union_membership", "trade_union", "political", "politics",
    "sexual_orientation", "orientation", "gender_identity", "transgender", "pregnancy",
    "pregnant", "maternity", "paternity", "family", "family_status", "marital_status",
    "children", "dependents", "biometric", "genetic", "criminal_record", "conviction",
    "other_salary", "colleague_salary", "peer_salary",
)
SECRET_KEYS = r"token|password|secret|authorization|cookie|credential|refresh|access_key"
REDACTED = "[redacted]"
DSN_PASSWORD = r"\b([a-z][a-z0-9+.\-]*://[^\s:/@]+:)([^\s@/]+)(@)"
SECRET_PAIR = (
    r"([A-Za-z_][A-Za-z0-9_\-]*(?:token|password|passwd|secret|authorization|cookie|credential"
    r"|refresh|access_key)[A-Za-z0-9_\-]*)(\s*[\"']?\s*[:=]\s*[\"']?)([^\s,;'\"})\]]+)"
)
BEARER = r"\b(bearer|basic|token)\s+([A-Za-z0-9._~+/=\-]{8,})"
PROVIDER_SECRET = r"\b(1//|ya29\.|4/0)[A-Za-z0-9._~+/=\-]{4,}"
FENCE_OPEN = "<<<MESSAGE_BEGIN>>>"
FENCE_CLOSE = "<<<MESSAGE_END>>>"


# --- fixed values: markup of mails, addresses, titles and pages ---------------------------------------
ANCHOR = r"""(?s)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
HIDDEN_MARKUP = (
    r"(?s)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<head\b[^>]*>.*?</head>|<!--.*?-->"
)
BLOCK_MARKUP = r"</?(?:p|div|br|tr|li|h[1-6]|table|blockquote|section|article)[^>]*>"
WEB_ADDRESS = r"""https?://[^\s<>"')]+"""
MAIL_ADDRESS = r"<?([^<>\s]+)@([A-Za-z0-9.-]+)>?"
TITLE_BRACKETS = r"[(\[{]([^)\]}]*)[)\]}]"
TITLE_SEGMENTS = r"\s+[-–—|·]\s+|\s*[/,]\s*"
PAGE_DATA = r"(?s)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"
PAGE_TITLE = r"<title>([^<]+)</title>"

# --- what every match of the patterns above holds, in lower case: texts without any of these need not be tried ---
STRONG_STEMS = (
    "candida", "appl", "colloqui", "interview", "recruit", "assunzione", "hiring", "curriculum", "cv", "risorse umane",
    "talent acquisition", "job offer", "offerta di lavoro", "processo di selezione",
)
WEAK_STEMS = ("posizione", "selezione", "offerta", "role", "vacancy", "talent", "opportunit")
PHRASE_STEMS = (
    ("forward", "candidates", "proceed", "progressing", "unable", "interviewing", "filled", "select"),
    ("proced", "prosegui", "seguito", "selezionata", "terremo", "individuato", "purtroppo"),
    ("appl", "joining"),
    ("grazie", "candidatura"),
    ("confermiamo", "thanks"),
    ("invite", "schedule", "process"),
    ("invitarti", "colloquio", "organizzare"),
    ("conoscitiv", "confermo", "programmare", "disponibilit", "disponibile"),
    ("contatter", "andare", "sentirci", "chiamarti"),
    ("scheduled",),
    ("home", "coding", "assignment", "tecnic"),
)
ROLE_STEMS = (
    ("application",), ("applied",), ("apply",), ("position", "role"), ("candidacy", "application"), ("position", "role", "title"),
    ("interview",), ("candidatura",), ("posizione",), ("posizione",), ("opportunit",), ("posizione", "ruolo"), ("colloquio",),
    ("opportunit",),
)
