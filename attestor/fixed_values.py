"""Patterns, enumerations, limits and texts that define the results.

Everything here is plain data. Patterns are Java regular expressions that RE2 also
accepts, so the same text can be used on both sides of a correctness check.
"""

from __future__ import annotations

import unicodedata

# --- white space as Unicode knows it, also stripped from blank texts (fixed values) ---
SPACE_CLASS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same characters, one by one.
SPACES = "".join(c for c in map(chr, range(0x110000)) if c.isspace())

# --- personal data: patterns and tags (fixed values, in the order they apply) ---
# Digits and white space are those of Unicode: PDF text is full of no-break spaces.
EMAIL = r"[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9.\-]+"
CARD = r"\b(?:\p{Nd}[ \-]?){13,18}\p{Nd}\b"
AADHAAR = rf"\b\p{{Nd}}{{4}}[{SPACE_CLASS}\-]?\p{{Nd}}{{4}}[{SPACE_CLASS}\-]?\p{{Nd}}{{4}}\b"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
GSTIN = r"\b\p{Nd}{2}[A-Z]{5}\p{Nd}{4}[A-Z][A-Z\p{Nd}]Z[A-Z\p{Nd}]\b"
PHONE = (
    rf"\+?\p{{Nd}}{{1,4}}[{SPACE_CLASS}.\-]?\(?\p{{Nd}}{{1,4}}\)?[{SPACE_CLASS}.\-]?"
    rf"\p{{Nd}}{{3,4}}[{SPACE_CLASS}.\-]?\p{{Nd}}{{4,9}}\b"
)
# The same addresses in linear time: a local part is tried once per run of its characters,
# from the run's start or from where the last match ended, and never given back.
EMAIL_LINEAR = r"(?:(?<![a-zA-Z0-9_.+\-])|\G)[a-zA-Z0-9_.+\-]++@[a-zA-Z0-9\-]++\.[a-zA-Z0-9.\-]+"

EMAIL_TAG = "[REDACTED_EMAIL]"
CARD_TAG = "[REDACTED_CREDIT_CARD]"
AADHAAR_TAG = "[REDACTED_AADHAAR]"
PAN_TAG = "[REDACTED_PAN]"
GSTIN_TAG = "[REDACTED_GSTIN]"
PHONE_TAG = "[REDACTED_PHONE]"
ANY_TAG = r"\[REDACTED_\w+\]"
LONG_DIGIT_RUN = r"^\p{Nd}{13,}$"

# Decimal digits beyond ASCII and their values, from the Unicode database, for check sums.
OTHER_DIGITS = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd")
OTHER_DIGIT_VALUES = "".join(str(unicodedata.digit(c)) for c in OTHER_DIGITS)

# Our own shortcut: every card, Aadhaar, PAN, GSTIN and phone match contains one of
# these, so a text without them needs none of the five passes.
NUMBER_HINT = rf"\p{{Nd}}(?:[{SPACE_CLASS}.\-()]{{0,2}}\p{{Nd}}){{8}}|[A-Z]{{5}}\p{{Nd}}{{4}}[A-Z]"

# --- upload gate (fixed values) ---
MIME_BY_EXTENSION = {
    ".txt": "text/plain",
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
}
ALLOWED_EXTENSIONS = (".jpeg", ".jpg", ".pdf", ".png", ".txt")
ALLOWED_TEXT = "['.jpeg', '.jpg', '.pdf', '.png', '.txt']"
BYTES_PER_MB = 1048576
MAX_FILE_MB = 5

# --- enumerations (fixed values) ---
DOC_TYPES = ("invoice", "certificate", "contract", "report")
UNKNOWN = "unknown"
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
REVIEW_SEVERITIES = ("HIGH", "CRITICAL")
COMPLIANT = "COMPLIANT"
NON_COMPLIANT = "NON_COMPLIANT"
REVIEW_NEEDED = "REVIEW_NEEDED"
AWAITING_REVIEW = "AWAITING_HUMAN_REVIEW"
TRIAGE_AUTHOR = "TriageAgent"
AUDITOR_AUTHOR = "AuditorAgent"

# --- sizes (fixed values) ---
PREVIEW_CHARS = 500
CONTEXT_CHARS = 3000
PREVIEW_VIOLATIONS = 3
LOG_LIMIT_DEFAULT, LOG_LIMIT_MIN, LOG_LIMIT_MAX = 10, 1, 100

# --- texts (fixed values) ---
MASKER_NAME, MASKER_VERSION = "attestor-masking", "1.0.0"
DEFAULT_OVERRIDE_NOTE = "Status overridden by human compliance auditor."
BAD_OVERRIDE = "override_status must be either 'COMPLIANT' or 'NON_COMPLIANT'."
NO_SESSION = "Session not found. It may have already been approved or expired."
NO_FILE = "File does not exist"
NO_RULE = "Rule not found"
PII_FOUND_LABEL, PII_NONE_LABEL = "Redacted / Masked (Safe)", "No PII Detected"
NO_VIOLATIONS_BANNER = (
    "[OK] No compliance violations detected. Document satisfies all checked rules."
)
DEFAULT_VERSION, DEFAULT_JURISDICTION = "1.0.0", "India / General"

# --- wording of summaries, model inputs, listings and notices (fixed values) ---
SUMMARY_TITLE, SUMMARY_SECTIONS = "## Compliance Audit Report", ("### Executive Summary", "### Key Violations", "### Recommendations")
SUMMARY_LABELS = ("**Document Type:** ", "**Audit Status:** ", "**Risk Severity:** ", "**Compliance Score:** ")
MODEL_INPUT_TITLE, MODEL_INPUT_RULE = "DOCUMENT FOR COMPLIANCE AUDIT", "=============================="
MODEL_INPUT_LABELS = ("Filename: ", "Characters: ", "PII Detected & Redacted: ", "DOCUMENT CONTENT (PII-Scrubbed):")
CATEGORY_MARK, RULE_MARK = "📁 ", "   • ["
NOTICE_MARK = "🚨 "
NOTICE_PARTS = (" critical violation(s) detected. Human approval required. Approve session ", " to proceed.")

# Characters mapped when a report text is reduced to Latin-1 (fixed values).
PLAIN_CHARS = {
    "“": '"', "”": '"', "‘": "'", "’": "'",
    "–": "-", "—": "-", "•": "*",
}
PLAIN_WORDS = {
    "✅": "[OK]", "❌": "[FAIL]", "⚠": "[WARN]",
    "\U0001f6a8": "[ALERT]", "✔": "[OK]",
}

# --- our own names for what produced a result ---
RULE_SOURCE = "rule catalogue"
STAGES = "mask > triage > audit > report"

NOT_SCORED = "not scored"

# --- our own triage cues: whole words of the lower-cased masked text, one point each ---
TRIAGE_CUES = {
    "invoice": ("invoices?", "amount due", "bills?", "purchase orders?"),
    "certificate": ("certificates?", "fssai", "iso", "registration", "valid until"),
    "contract": ("agreements?", "contracts?", "nda", "parties", "clauses?"),
    "report": ("reports?", "reporting period", "summary", "audits?"),
}
