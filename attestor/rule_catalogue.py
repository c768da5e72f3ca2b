"""The built-in rule catalogue and the predicates that decide each rule."""

from __future__ import annotations

# Rule ids, descriptions, severities and regulations.
CATALOGUE = {
    "_metadata": {
        "version": "2.0.0",
        "jurisdiction": "India / General International",
    },
    "general": [
        {"id": "GEN-01", "description": "Document must not contain raw credit card numbers (PII violation).", "severity": "CRITICAL", "regulation": "PCI-DSS"},
        {"id": "GEN-02", "description": "Document must not expose unmasked Aadhaar numbers.", "severity": "CRITICAL", "regulation": "India IT Act 2000, UIDAI Guidelines"},
        {"id": "GEN-03", "description": "Document must have a clearly identifiable issuing party or organization.", "severity": "MEDIUM", "regulation": "General Best Practice"},
        {"id": "GEN-04", "description": "Document must include a date of issuance or effective date.", "severity": "LOW", "regulation": "General Best Practice"},
    ],
    "invoice": [
        {"id": "INV-01", "description": "Must contain a valid 15-digit GSTIN (Goods & Services Tax ID).", "severity": "HIGH", "regulation": "India GST Act 2017"},
        {"id": "INV-02", "description": "Must display a clear 'Total Amount Due' with currency.", "severity": "HIGH", "regulation": "India GST Invoice Rules"},
        {"id": "INV-03", "description": "Must include an invoice number for audit trail purposes.", "severity": "MEDIUM", "regulation": "India GST Invoice Rules"},
        {"id": "INV-04", "description": "Must specify HSN/SAC codes for all line items.", "severity": "MEDIUM", "regulation": "India GST Act 2017"},
        {"id": "INV-05", "description": "Must include both buyer and seller PAN or GSTIN details.", "severity": "HIGH", "regulation": "India Income Tax Act"},
    ],
    "certificate": [
        {"id": "CERT-01", "description": "Must mention 'FSSAI' and a valid FSSAI registration number.", "severity": "CRITICAL", "regulation": "India FSSAI Act 2006"},
        {"id": "CERT-02", "description": "Must specify the certificate validity period (start and expiry dates).", "severity": "HIGH", "regulation": "General Regulatory Best Practice"},
        {"id": "CERT-03", "description": "Must be signed or stamped by an authorized regulatory body.", "severity": "HIGH", "regulation": "General Regulatory Best Practice"},
        {"id": "CERT-04", "description": "Must include the name and address of the certified entity.", "severity": "MEDIUM", "regulation": "General Best Practice"},
    ],
    "contract": [
        {"id": "CON-01", "description": "Must include names and signatures of all contracting parties.", "severity": "CRITICAL", "regulation": "Indian Contract Act 1872"},
        {"id": "CON-02", "description": "Must specify the contract duration or effective/expiry dates.", "severity": "HIGH", "regulation": "Indian Contract Act 1872"},
        {"id": "CON-03", "description": "Must include a dispute resolution or jurisdiction clause.", "severity": "MEDIUM", "regulation": "Indian Contract Act 1872"},
        {"id": "CON-04", "description": "Must define the scope of work or deliverables clearly.", "severity": "HIGH", "regulation": "General Contract Law Best Practice"},
    ],
    "report": [
        {"id": "REP-01", "description": "Must include the reporting period covered by the report.", "severity": "HIGH", "regulation": "General Financial Reporting Standards"},
        {"id": "REP-02", "description": "Must be signed or approved by an authorized signatory.", "severity": "HIGH", "regulation": "General Corporate Governance"},
        {"id": "REP-03", "description": "Financial reports must follow applicable accounting standards (Ind AS / GAAP).", "severity": "MEDIUM", "regulation": "India Companies Act 2013"},
    ],
}

# Patterns that look for one thing after another, anchored so that a text is read twice at most
# instead of once per first match. Same outcome as the plain form.
LINEAR = {
    r"(?i)total amount due[^\n]*(INR|Rs|₹|USD|\$|EUR)": r"(?dim)^(?>[^\n]*?total amount due)[^\n]*(?:INR|Rs|₹|USD|\$|EUR)",
    r"(?i)fssai[^\n]*number is missing": r"(?dim)^(?>[^\n]*?fssai)[^\n]*number is missing",
    r"(?i)signed by[^\n]*(_{4,}|\(blank\))": r"(?dim)^(?>[^\n]*?signed by)[^\n]*(?:_{4,}|\(blank\))",
    r"(?is)valid from.*valid (until|to)": r"(?is)\A(?>.*?valid from).*valid (?:until|to)",
    r"(?is)(entity|certif(y|ies) that).*address": r"(?is)\A(?>.*?(?:entity|certif(?:y|ies) that)).*address",
}

# Our own definition: a rule passes when ``must`` matches the masked text at least
# ``n`` times and ``must_not`` does not match. (must, must_not, n)
PREDICATES = {
    "GEN-01": (None, r"\[REDACTED_CREDIT_CARD\]", 1),
    "GEN-02": (None, r"\[REDACTED_AADHAAR\]", 1),
    "GEN-03": (r"(?i)\b(from|seller|issued by|issuing organi[sz]ation|client|part(y|ies)|authority|entity|m/s|ltd|inc)\b", None, 1),
    "GEN-04": (r"(?i)\b(date|valid from|effective)\b|\d{4}-\d{2}-\d{2}", None, 1),
    "INV-01": (r"\[REDACTED_GSTIN\]", None, 1),
    "INV-02": (r"(?i)total amount due[^\n]*(INR|Rs|₹|USD|\$|EUR)", None, 1),
    "INV-03": (r"(?i)invoice\s*(no|number|#)\W*\w+", None, 1),
    "INV-04": (r"(?i)\b(HSN|SAC)\b[^\n]{0,12}?\d{4,8}", None, 1),
    "INV-05": (r"\[REDACTED_(GSTIN|PAN)\]", None, 2),
    "CERT-01": (r"(?i)FSSAI[^\n]{0,40}\d", r"(?i)fssai[^\n]*number is missing", 1),
    "CERT-02": (r"(?is)valid from.*valid (until|to)", None, 1),
    "CERT-03": (r"(?i)\b(signed|stamped|signatory|signature|authorized officer)\b", r"(?i)no authorized sign", 1),
    "CERT-04": (r"(?is)(entity|certif(y|ies) that).*address", None, 1),
    "CON-01": (r"(?i)signed by", r"(?i)signed by[^\n]*(_{4,}|\(blank\))", 1),
    "CON-02": (r"(?i)effective date|expiry date|duration|term of", r"(?i)no effective (or expiry )?date", 1),
    "CON-03": (r"(?i)dispute|jurisdiction|arbitration", r"(?i)lacks a (dispute|jurisdiction)", 1),
    "CON-04": (r"(?i)scope|deliverable", None, 1),
    "REP-01": (r"(?i)reporting period\s*:", None, 1),
    "REP-02": (r"(?i)\b(signed|approved|signature)\b", r"(?i)no authorized sign", 1),
    "REP-03": (r"(?i)Ind AS|Indian Accounting Standards|GAAP", None, 1),
}
