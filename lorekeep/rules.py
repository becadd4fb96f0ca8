"""Rules of a tenant: patterns, lists and thresholds, with merge, diff and validation."""

from __future__ import annotations

import re
from copy import deepcopy

# The patterns and word lists that results depend on.
PLACEHOLDER = r"(?i)^\(?(unassigned|n/?a|none|null|nil|-+|tbd|unknown|no owner|not assigned|\?+|0)\)?$"
CODE_LIST = r"^[A-Z]{1,6}-?\d+[A-Z]?(\s*,\s*[A-Z]{1,6}-?\d+[A-Z]?)+$"
LEGAL_SUFFIXES = ["the", "inc", "llc", "l l c", "co", "corp", "corporation", "company", "ltd", "limited", "lp", "llp", "pllc"]
REPORT_ROW = r"(?i)^(total|grand total|sub ?total|totals|exported\b.*|report (run|generated)\b.*|page \d+( of \d+)?)$"
STRONG_ID_COLUMNS = [(r"^(serial( ?#| no\.?| number)?|s\/n)$", "Serial"), (r"^vin( \(last 6\)|6)?$", "VIN")]
OFFICIAL_PATH = "(?i)(polic|sop|contract|agreement|handbook|pric|rate|terms|memo|procedure|plan|summary|addendum|exhibit|notice|letter)"
SENSITIVE_COLUMN = r"(?i)(rate|pay|salary|wage|bonus|comp(ensation)?|ssn|social|tax|dob|birth|bank|routing|account ?(no|number|#)|iban|garnish|deduction|401k|benefit)"
AUTHORITY = {"system_of_record": 4, "document": 3, "official_document": 3, "email": 2, "interview": 1, "video": 1, "photo": 1}
AUTHORITY_BY_KIND = [
    ("(?i)(balance|owe[sd]?|outstanding|invoice|billed|billing amount|paid|payment(s)?_received|revenue|receivable|aging|credit_limit)", {"system_of_record": 5, "document": 3, "official_document": 3, "email": 2, "interview": 1, "video": 1, "photo": 1}),
    ("(?i)(terms|rate|pric|discount|markup|fee|surcharge|agreement|contract|warranty|renewal|escalator|minimum|sla)", {"official_document": 5, "document": 5, "system_of_record": 3, "email": 2, "interview": 1, "video": 1, "photo": 1}),
    ("(?i)(title|job|role|hire|hired|start_date|termination|employment|salary|wage|pay_rate|reports_to|manager|department|status)", {"system_of_record": 5, "document": 3, "official_document": 3, "email": 2, "interview": 1, "video": 1, "photo": 1}),
    ("(?i)(practice|workaround|habit|actually|unwritten|informal|knows|expert|relationship|depends_on|bypass|calls|prefers|key_person|tribal)", {"interview": 4, "video": 4, "email": 3, "document": 2, "official_document": 2, "photo": 2, "system_of_record": 1}),
]
FAMILY_MARKERS = r"\b(final|use this|signed|scan(ned)?|executed|copy|my copy|draft|latest|new|updated|old|rev\s*[a-z0-9]+|v\s?\d+(\.\d+)?|r\d+)\b"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
FILE_ENDING = r"(?i)\.[a-z0-9]{2,4}$"
FAMILY_NOISE = [
    r"\(\s*\d+\s*\)",
    r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b",
    r"\b\d{4}[./-]\d{1,2}[./-]\d{1,2}\b",
    rf"\b({'|'.join(MONTHS)})[a-z]*\.?\s+(\d{{1,2}},?\s+)?\d{{4}}\b",
    r"\b(19|20)\d{2}\b",
    FAMILY_MARKERS,
    "[^a-z0-9]+",
    r"\b(and|the|of|for)\b",
]
CURRENT_WORDS = r"\b(current(ly)?|now|today|these days|still|latest|in force|right now|at the moment|nowadays|any more|anymore)\b"
CHANGE_WORDS = r"\b(changed?|changes|over (the )?(time|years)|history|histor(ical|y)|evolv\w*|went (up|down)|go up|gone up|raised|increase[ds]?|decrease[ds]?|when did|since when|how long|timeline|used to|before and after|previous(ly)?|originally)\b"
PAST_VERBS = r"\b(was|were|did|had|used to|back then|at the time)\b"
# Words and patterns of time in questions.
TIME_WORDS = {"before": r"\b(before|prior to|until|up to)\b", "after": r"\b(after|since|from)\b", "current": CURRENT_WORDS, "change": CHANGE_WORDS, "past": PAST_VERBS}
TIME_PATTERNS = {
    "day": r"\b((?:19|20)\d{2}-\d{2}-\d{2})\b",
    "month": r"\b(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\.?\s+(?:of\s+)?((?:19|20)\d{2})\b",
    "year": r"\b(in|during|back in|as of|for|before|by|after|since|around|until)?\s*((?:19|20)\d{2})\b",
    "iso_month": r"\b\d{4}-\d",
    "last_year": r"\blast year\b",
    "this_year": r"\bthis year\b",
    "last_month": r"\blast month\b",
    "years_ago": r"\b(\d{1,2}|a|one|two|three|five|ten)\s+years?\s+ago\b",
    "event": r"\b(before|prior to|after|since|until)\s+(?:the\s+|we\s+|they\s+|he\s+|she\s+)?(?!(that|this|then|now|today|it|them|him|her)\b)[a-z][a-z0-9 '&.-]{2,40}?(?=\s*(?:\?|,|\.|$|\band\b|\bor\b|\bwhat\b|\bwho\b))",
    "event_side": r"\b(before|prior to|after|since|until)\s+[a-z]",
}
SIDE_OF_YEAR = {"before": "before", "until": "before", "after": "after", "since": "after"}
COUNT_WORDS = {"a": 1, "one": 1, "two": 2, "three": 3, "five": 5, "ten": 10}
# Prefixes of mail subjects, lists of initials, and what a file's name says of its version.
SUBJECT_PREFIX = r"^((\s*(re|fw|fwd|aw|wg|sv|tr)\s*(\[\d+\])?\s*:\s*)|(\s*\[[^\]]{1,20}\]\s*))+"
INITIALS_LIST = "^[A-Z]{1,4}(/[A-Z]{1,4})+$"
# What counts as personal data.
BANK_NUMBER = r"(?i)\b(routing|aba|account)\s*(number|no\.?|#)?\s*[:#]?\s*\d{6,17}\b"
SSN = r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"
PERSON_COLUMN = r"(?i)(employee|name|first|last|worker|staff|tech(nician)?)"
PAY_COLUMN = r"(?i)^(rate|pay|pay rate|hourly( rate)?|salary|annual salary|wage|base( pay)?|bonus|compensation|comp|current comp|proposed( comp| salary)?|merit|increase)$"
BIRTH_DATE = r"(?i)\b(date of birth|d\.?o\.?b\.?|birth ?date)\b\s*[:\-]?\s*\d{1,4}[/-]\d{1,2}[/-]\d{1,4}"
RRF_K = 60

DEFAULTS = {
    "cleaning": {"placeholder": PLACEHOLDER, "code_list": CODE_LIST, "legal_suffixes": LEGAL_SUFFIXES, "report_rows": REPORT_ROW},
    "resolution": {"strong_systems": ["Serial", "VIN", "Email"], "strong_min_length": 5, "small_type_max": 25, "max_fuzzy": 3000, "max_component": 14},
    "people": {"sensitive_columns": SENSITIVE_COLUMN, "former_min_sent": 3, "former_quiet_days": 120, "old_domain_days": 90},
}


def merge(base: dict, over: dict | None) -> dict:
    """base with the overrides laid over it: sections merge key by key, patterns and lists replace."""
    out = deepcopy(base)
    for section, values in (over or {}).items():
        out[section] = {**out.get(section, {}), **deepcopy(values)}
    return out


def diff(base: dict, rules: dict) -> dict:
    """The overrides that turn base into rules."""
    changed = {s: {k: v for k, v in values.items() if base.get(s, {}).get(k) != v} for s, values in rules.items()}
    return {s: v for s, v in changed.items() if v}


def problems(rules: dict, path: str = "") -> list[str]:
    """Patterns that don't compile and negative numbers, by their path."""
    found = []
    for key, value in rules.items():
        at = f"{path}.{key}".lstrip(".")
        if isinstance(value, dict):
            found += problems(value, at)
        elif isinstance(value, str):
            try:
                re.compile(value)
            except re.error as e:
                found.append(f"{at}: {e}")
        elif isinstance(value, int | float) and value < 0:
            found.append(f"{at}: negative")
    return found

# Delimiters in the order they are tried, dates in paths, and the reader of each format.
DELIMITERS = [",", "\t", ";", "|"]
DAY_IN_PATH = r"(20\d\d-\d\d-\d\d)"
ROUTES = {
    "document": ["pdf", "docx", "pptx"],
    "table": ["csv", "xlsx"],
    "text": ["text", "markdown", "html", "rtf", "ics"],
    "mailbox": ["mbox"],
    "email": ["eml"],
    "image": ["jpeg", "png", "gif", "heic"],
    "audio": ["mp3", "wav"],
    "video": ["mp4", "quicktime"],
}
# Abbreviations written either way, words that ask nothing, and what a compound question's next part begins with.
ABBREVIATIONS = {
    "ot": "overtime",
    "pm": "preventive maintenance",
    "ap": "accounts payable",
    "ar": "accounts receivable",
    "hr": "human resources",
    "wo": "work order",
    "po": "purchase order",
    "qc": "quality control",
    "loto": "lockout tagout",
}
ASKING_STOP_WORDS = (
    "what when where which whose there their about does have this that with from were will would should could today right still company"
).split()
QUESTION_JOINERS = "and|also|plus|then"
QUESTION_OPENERS = "what|who|whom|whose|when|where|why|how|which|is|are|was|were|does|did|do|can|could|should|has|have"
# Column names of message logs.
LOG_TEXT = "^(text|message|body|content|message text)$"
LOG_SENDER = "^(sender_name|sender|from|author|sender name|name)$"
LOG_TIME = "(date|time|timestamp|sent)"
# What a procedure and a training plan hold, with the most facts of each section, and words that tell no fact apart.
RULE_WORDS = r"(?i)(must|required|never|no .* without|two-person|before|always)"
PROCEDURE_LIMITS = {"rules": 12, "practice": 10, "exceptions": 6, "outdated": 8}
TRAINING_SECTIONS = {"safety": (["policy"], 8), "work": (["practice", "policy"], 10), "quirks": (["practice", "policy", "exception"], 8), "people": (["key_person"], 8)}
FACT_STOP_WORDS = "the and for with from that this are was not has have its per all any into now since valid status accepted current".split()
# Types that are not looked for in texts, everyday words, short codes, and kinds of aliases that are set phrases.
UNLINKED_TYPES = ["GL Account", "Fixed Asset", "Vehicle", "Labor Rate"]
EVERYDAY_WORDS = (
    "the and for with from that this have will your about office shop service parts sales team board cage plan rate terms notes note main north south east west hot job jobs pump pumps "
    "company customer customers site sites contract policy safety billing dispatch on-call oncall call calls price pricing quote quotes invoice invoices payment payments vendor vendors new old"
).split()
CODE_PHRASE = r"^[a-z]{1,6} ?\d+[a-z]?$"
SET_PHRASE_KINDS = ["jargon", "nickname", "abbreviation", "former_name"]
LEGAL_TAIL = r"(?i)\b(llc|inc|co|corp|ltd|company)\.?$"
PEOPLE_TYPES, ORGANISATION_TYPES = ["Person", "Customer Contact"], ["Customer", "Vendor", "Site"]
LONGEST_PHRASE = 8
