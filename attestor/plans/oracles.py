"""SQL checks: for each registered query the same result in DuckDB SQL.

The SQL is written on its own, set-based and in join form; it shares only the fixed values
and the derived inputs with the Spark side.
"""

from __future__ import annotations

from attestor import fixed_values as V
from attestor.plans import inputs as I
from attestor.rule_catalogue import CATALOGUE, PREDICATES


def q(value: str | None) -> str:
    """A SQL text literal."""
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def ctes(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in parts) + "\n"


# --- scalar pieces -----------------------------------------------------------------------

EXT = r"lower(regexp_extract(filename, '[^/.][^/]*(\.[^/.]*)$', 1))"
NO_BLANK = f"'[^{V.SPACE_CLASS}]'"


def blank(x: str) -> str:
    return f"({x} IS NULL OR NOT regexp_matches({x}, {NO_BLANK}))"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A[{V.SPACE_CLASS}]+', ''), '[{V.SPACE_CLASS}]+\z', '')"


def luhn(h: str) -> str:
    digits = f"list_reverse(list_transform(regexp_extract_all({h}, '[0-9]'), lambda c: CAST(c AS INT)))"
    return (
        f"(len({digits}) > 0 AND list_sum(list_transform({digits}, lambda v, i: CASE WHEN i % 2 = 1 THEN v"
        f" WHEN v > 4 THEN 2*v - 9 ELSE 2*v END)) % 10 = 0)"
    )


def replace_where(x: str, pattern: str, tag: str, wanted) -> str:
    p = q(pattern)
    return f"""string_split_regex({x}, {p})[1] || coalesce(array_to_string(list_transform(
      list_zip(regexp_extract_all({x}, {p}), string_split_regex({x}, {p})[2:]),
      lambda z: (CASE WHEN {wanted('z[1]')} THEN '{tag}' ELSE z[1] END) || z[2]), ''), '')"""


def replace_all(x: str, pattern: str, tag: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, '{tag}', 'g')"


def long_run(h: str) -> str:
    return f"NOT regexp_matches({h}, {q(V.LONG_DIGIT_RUN)})"


PASSES = {
    "mask_email": lambda x: replace_all(x, V.EMAIL, V.EMAIL_TAG),
    "mask_card": lambda x: replace_where(x, V.CARD, V.CARD_TAG, luhn),
    "mask_aadhaar": lambda x: replace_all(x, V.AADHAAR, V.AADHAAR_TAG),
    "mask_pan": lambda x: replace_all(x, V.PAN, V.PAN_TAG),
    "mask_gstin": lambda x: replace_all(x, V.GSTIN, V.GSTIN_TAG),
    "mask_phone": lambda x: replace_where(x, V.PHONE, V.PHONE_TAG, long_run),
}


def masking(source: str) -> list[tuple[str, str]]:
    """The six passes as one table each; the last is ``masked`` with raw text and ``t``."""
    steps, before = [("m0", f"SELECT *, text AS t FROM {source}")], "m0"
    for number, one in enumerate(PASSES.values(), start=1):
        name = "masked" if number == len(PASSES) else f"m{number}"
        steps.append((
            name,
            f"SELECT * EXCLUDE (t, u), CASE WHEN t <> u THEN length(t) - length(u) END AS cut{number}, u AS t"
            f" FROM (SELECT *, CASE WHEN t = '' THEN t ELSE {one('t')} END AS u FROM {before})",
        ))
        before = name
    return steps


TAGS = rf"list_sort(list_distinct(regexp_extract_all(t, '{V.ANY_TAG}')))"
BUSINESS = ("b", I.duck_sql(I.BUSINESS_DOCUMENTS))
TEXTS = [
    BUSINESS,
    ("texts", "SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL"
              " SELECT 'page', page_id, html FROM pages UNION ALL SELECT 'business', doc_id, text FROM b"),
]
REVIEWS = ("reviews", I.duck_sql(I.REVIEWS))
VIOLATIONS = ("viol", I.duck_sql(I.VIOLATIONS))
TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"

# --- gate ----------------------------------------------------------------------------------

MB = "CAST(round_even(CAST(size_bytes AS DOUBLE) * 100 / 1048576, 0) AS BIGINT)"
MB_TEXT = f"CAST({MB} // 100 AS VARCHAR) || '.' || lpad(CAST({MB} % 100 AS VARCHAR), 2, '0')"
ALLOWED = f"{EXT} IN ({', '.join(q(e) for e in V.ALLOWED_EXTENSIONS)})"
EXPECTED = f"CASE {EXT} " + " ".join(f"WHEN {q(e)} THEN {q(m)}" for e, m in V.MIME_BY_EXTENSION.items()) + " END"
MISMATCH = f"coalesce(declared_mime <> '' AND ({EXPECTED}) <> declared_mime, FALSE)"
CODE = f"""CASE WHEN NOT {ALLOWED} THEN 'extension' WHEN {MISMATCH} THEN 'mime' WHEN size_bytes IS NULL THEN 'missing'
  WHEN size_bytes > 5242880 THEN 'size' WHEN size_bytes = 0 THEN 'empty' END"""
DETAIL = f"""CASE WHEN NOT {ALLOWED} THEN 'Unsupported file type: ''' || {EXT} || '''. Allowed types: ' || {q(V.ALLOWED_TEXT)}
  WHEN {MISMATCH} THEN 'File type mismatch: ''' || filename || ''' claims to be ''' || {EXT} || ''' but content suggests ''' || declared_mime || '''. Possible spoofing attempt.'
  WHEN size_bytes IS NULL THEN 'File does not exist'
  WHEN size_bytes > 5242880 THEN 'File too large: ' || {MB_TEXT} || 'MB. Maximum allowed size is 5MB.'
  WHEN size_bytes = 0 THEN 'Uploaded file ''' || filename || ''' is empty (0 bytes). Please upload a valid document.' END"""
NO_TEXT = "'No text could be extracted from ''' || filename || '''.'"
_BARE = f"{blank('text')} AND {EXT} = '.txt'"
GATED = (
    "g",
    f"SELECT *, coalesce({CODE}, CASE WHEN {_BARE} THEN 'no_text' END) AS reject_code,"
    f" coalesce({DETAIL}, CASE WHEN {_BARE} THEN {NO_TEXT} END) AS reject_detail,"
    f" {CODE} IS NULL AND {blank('text')} AND {EXT} <> '.txt' AS ocr FROM b",
)
OK = ("ok", "SELECT * FROM g WHERE reject_code IS NULL AND NOT ocr")
MASKED = [BUSINESS, GATED, OK, *masking("ok")]

# --- triage, rules, verdict ----------------------------------------------------------------

_SCORES = ", ".join(
    " + ".join(f"CAST(regexp_matches(lower(t), {q(rf'\b(?:{c})\b')}) AS INT)" for c in cues) + f" AS s_{name}"
    for name, cues in V.TRIAGE_CUES.items()
)
_BEST = "greatest(" + ", ".join(f"s_{n}" for n in V.TRIAGE_CUES) + ")"
_TOTAL = "(" + " + ".join(f"s_{n}" for n in V.TRIAGE_CUES) + ")"
_TYPE = "CASE " + " ".join(f"WHEN s_{n} = best THEN '{n}'" for n in V.TRIAGE_CUES) + " END"
TYPED = [
    *MASKED,
    ("scored", f"SELECT *, {_SCORES} FROM masked"),
    ("totals", f"SELECT *, {_BEST} AS best, {_TOTAL} AS total FROM scored"),
    ("typed", f"SELECT *, CASE WHEN total = 0 THEN 'unknown' ELSE {_TYPE} END AS doc_type,"
              " CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE CAST(best AS DOUBLE) / total END AS confidence FROM totals"),
]


def _rule_rows() -> str:
    rows = []
    for number, (category, listed) in enumerate(CATALOGUE.items()):
        if category.startswith("_"):
            continue
        for seq, r in enumerate(listed):
            rows.append(
                f"({number}, {q(category)}, {seq}, {q(r['id'])}, {q(r['description'])}, {q(r['severity'])}, {q(r['regulation'])})"
            )
    return (
        "SELECT * FROM (VALUES " + ",\n".join(rows)
        + ") r(category_no, category, seq, id, description, severity, regulation)"
    )


def _predicate(rule_id: str) -> str:
    must, must_not, n = PREDICATES[rule_id]
    tests = []
    if must:
        tests.append(f"regexp_matches(t, {q(must)})" if n == 1 else f"len(regexp_extract_all(t, {q(must)})) >= {n}")
    if must_not:
        tests.append(f"NOT regexp_matches(t, {q(must_not)})")
    return " AND ".join(tests)


RULES = ("rules", _rule_rows())
LOOKUPS = ("lookups", "SELECT * FROM (VALUES (0), (1)) l(lookup_no)")
_WANTED = "CASE l.lookup_no WHEN 0 THEN 'general' ELSE lower(d.doc_type) END"
_PASSED = "CASE id " + " ".join(f"WHEN {q(r)} THEN {_predicate(r)}" for r in PREDICATES) + " END"
EVALS = [
    *TYPED, RULES, LOOKUPS,
    ("evals", f"SELECT d.*, l.lookup_no, r.*, {_PASSED} AS passed"
              f" FROM typed d CROSS JOIN lookups l JOIN rules r ON r.category = {_WANTED}"),
]
_RANK = "CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 END"
_ORDER = "ORDER BY lookup_no, seq"
VERDICTS = [
    *EVALS,
    ("rolled", f"""SELECT doc_id, count(*) AS n, count(*) FILTER (passed) AS good, max({_RANK}) FILTER (NOT passed) AS worst,
      coalesce(list(id || ': ' || description {_ORDER}) FILTER (NOT passed), []) AS violations,
      coalesce(list('Correct the document to meet ' || id || ' (' || regulation || ').' {_ORDER}) FILTER (NOT passed), []) AS recommendations
      FROM evals GROUP BY doc_id"""),
    ("verdicts", """SELECT doc_id, CASE WHEN good = n THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS status,
      CASE coalesce(worst, 1) WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
      CAST(floor(100 * good / n) AS INT) AS compliance_score, violations, recommendations FROM rolled"""),
]


def _bullets(items: str, none: str) -> str:
    return f"CASE WHEN len({items}) = 0 THEN {q(none)} ELSE array_to_string(list_transform({items}, lambda i: '- ' || i), chr(10)) END"


_SUMMARY = f"""concat_ws(chr(10), '## Compliance Audit Report', '', '**Document Type:** ' || doc_type,
  '**Audit Status:** ' || CASE WHEN status = 'COMPLIANT' THEN 'COMPLIANT ✅' ELSE 'NON_COMPLIANT ❌' END,
  '**Risk Severity:** ' || severity, '**Compliance Score:** ' || CAST(compliance_score AS VARCHAR) || '/100', '',
  '### Executive Summary', CASE WHEN len(violations) = 0 THEN 'The document satisfies every applicable rule.'
    ELSE 'The document breaks ' || CAST(len(violations) AS VARCHAR) || ' applicable rule(s).' END, '',
  '### Key Violations', {_bullets('violations', 'No violations found')}, '',
  '### Recommendations', {_bullets('recommendations', 'No action needed')})"""
AUDITED = [
    *VERDICTS,
    ("judged", "SELECT d.*, v.* EXCLUDE (doc_id) FROM typed d JOIN verdicts v USING (doc_id)"),
    ("audited", f"""SELECT *, {_SUMMARY} AS executive_summary, md5(CAST(doc_id AS VARCHAR)) AS session_id,
      t IS DISTINCT FROM text AS pii_detected,
      CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 'pending' ELSE 'auto' END AS route FROM judged"""),
]
PENDING = [*AUDITED, ("pending", "SELECT * FROM audited WHERE route = 'pending'"), REVIEWS]
FIRSTS = (
    "firsts",
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY review_ts, review_no) AS rn"
    " FROM reviews) WHERE rn = 1",
)
_OVERRIDE = "CASE WHEN override_status IS NULL OR override_status = '' THEN NULL ELSE upper(override_status) END"
_REFUSED = "(override IS NOT NULL AND override NOT IN ('COMPLIANT', 'NON_COMPLIANT'))"


def iso(ts: str) -> str:
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({ts}, '%f') = '000000' THEN ''"
        f" ELSE '.' || strftime({ts}, '%f') END"
    )


APPROVED = [
    *PENDING, FIRSTS,
    ("reviewed", f"SELECT p.*, f.* EXCLUDE (session_id), {_OVERRIDE} AS override FROM pending p JOIN firsts f USING (session_id)"),
    ("approved", f"""SELECT *, coalesce(override, status) AS final_status,
      CASE WHEN override = 'COMPLIANT' THEN 'LOW' ELSE coalesce(severity, 'HIGH') END AS final_severity,
      override_status IS NOT NULL AS overridden,
      (override IS NOT NULL OR coalesce(reviewer_notes, '') <> '') AS changed,
      CASE WHEN coalesce(reviewer_notes, '') <> '' THEN reviewer_notes
           WHEN override IS NOT NULL THEN {q(V.DEFAULT_OVERRIDE_NOTE)} END AS note
      FROM reviewed WHERE NOT {_REFUSED}"""),
]
LEDGER = [
    *APPROVED,
    ("entries", """SELECT 0 AS batch, received_at AS ts, doc_id, filename, doc_type, status, severity, compliance_score,
        status AS report_status, violations, recommendations, executive_summary, pii_detected, CAST(NULL AS VARCHAR) AS note
        FROM audited WHERE route = 'auto'
      UNION ALL SELECT 1, review_ts, doc_id, filename, doc_type, final_status, final_severity, compliance_score,
        CASE WHEN changed THEN final_status ELSE status END, violations, recommendations, executive_summary, pii_detected, note
        FROM approved"""),
    ("ledger", "SELECT row_number() OVER (ORDER BY batch, ts, doc_id) AS id, * FROM entries"),
]

# --- model answers -------------------------------------------------------------------------

EVENTS = [("t", I.duck_sql(I.AGENT_EVENTS_BASE)), ("e", I.duck_sql(I.AGENT_EVENTS))]
_PEELED = strip(
    r"regexp_replace(regexp_replace({0}, '\A```[^\n]*\n', chr(10)), '```\z', '')"
)


def found_json(x: str) -> str:
    """JSON text of the object in a model answer, or NULL."""
    s = strip(x)
    t = f"CASE WHEN starts_with({s}, '```') THEN {_PEELED.replace('{0}', s)} ELSE {s} END"
    part = rf"regexp_extract({t}, '(?s)\{{.*\}}')"
    return (
        f"CASE WHEN starts_with({t}, '{{') AND json_valid({t}) THEN {t}"
        f" WHEN {part} <> '' AND json_valid({part}) THEN {part} END"
    )


LATEST = [
    *EVENTS,
    ("latest", """SELECT doc_id,
      coalesce(arg_max(text, seq) FILTER (author = 'TriageAgent' AND length(text) > 0), '') AS triage_raw,
      coalesce(arg_max(text, seq) FILTER (author = 'AuditorAgent' AND length(text) > 0), '') AS audit_raw,
      arg_max_null(text, seq) FILTER (is_final) AS final_text FROM e GROUP BY doc_id"""),
]
ANSWERS = [
    *LATEST,
    ("parsed", f"SELECT doc_id, {found_json('triage_raw')} AS tj, {found_json('audit_raw')} AS aj FROM latest"),
    ("answers", """SELECT doc_id, tj->>'$.doc_type' AS doc_type, CAST(tj->>'$.confidence' AS DOUBLE) AS confidence,
      tj->>'$.reasoning' AS reasoning, aj->>'$.status' AS status, aj->>'$.severity' AS severity,
      CAST(aj->>'$.compliance_score' AS INT) AS compliance_score,
      CAST(aj->'$.violations' AS VARCHAR[]) AS violations, CAST(aj->'$.recommendations' AS VARCHAR[]) AS recommendations
      FROM parsed"""),
]

# --- reports -------------------------------------------------------------------------------

VIOL_ID = r"nullif(regexp_extract(v, '^([A-Z]+-[0-9]+):\s*([^\n]*)\n?\z', 1), '')"
VIOL_TEXT = r"CASE WHEN regexp_matches(v, '^([A-Z]+-[0-9]+):\s*([^\n]*)\n?\z') THEN regexp_extract(v, '^([A-Z]+-[0-9]+):\s*([^\n]*)\n?\z', 2) ELSE v END"


def clean(x: str) -> str:
    t = f"coalesce({x}, '')"
    t = f"regexp_replace({t}, '#+[{V.SPACE_CLASS}]*', '', 'g')"
    t = rf"regexp_replace({t}, '\*\*([^*]+)\*\*', '\1', 'g')"
    t = rf"regexp_replace({t}, '\*([^*]+)\*', '\1', 'g')"
    t = f"replace({t}, '`', '')"
    for mark, plain in {**V.PLAIN_CHARS, **V.PLAIN_WORDS}.items():
        t = f"replace({t}, {q(mark)}, {q(plain)})"
    return strip(rf"regexp_replace({t}, '[^\x{{00}}-\x{{FF}}]', '', 'g')")


def capital(x: str) -> str:
    return f"upper({x}[1:1]) || lower({x}[2:])"


def pii_label(x: str) -> str:
    return f"CASE WHEN {x} THEN {q(V.PII_FOUND_LABEL)} ELSE {q(V.PII_NONE_LABEL)} END"


def verdict_label(x: str) -> str:
    return f"CASE WHEN upper({x}) = 'COMPLIANT' THEN 'COMPLIANT' ELSE 'NON-COMPLIANT' END"


def band(x: str) -> str:
    return f"CASE WHEN upper({x}) IN ('LOW', 'MEDIUM', 'HIGH') THEN upper({x}) ELSE 'CRITICAL' END"


LINES = [
    *LEDGER,
    ("vlist", f"SELECT id, i, {VIOL_ID} AS vid, {VIOL_TEXT} AS vtext FROM (SELECT id, unnest(violations) AS v, generate_subscripts(violations, 1) AS i"
              " FROM ledger WHERE upper(status) <> 'COMPLIANT')"),
    ("rlist", "SELECT id, unnest(recommendations) AS r, generate_subscripts(recommendations, 1) AS i FROM ledger"),
    ("lines", f"""
      SELECT id AS log_id, 1 AS section_no, 1 AS line_no, 'Document Audit Report' AS text FROM ledger
      UNION ALL SELECT id, 2, 1, 'Audit ID: #' || CAST(id AS VARCHAR) FROM ledger
      UNION ALL SELECT id, 2, 2, 'Audit Date: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' FROM ledger
      UNION ALL SELECT id, 2, 3, 'Document Category: ' || {capital('doc_type')} FROM ledger
      UNION ALL SELECT id, 2, 4, 'PII Status: ' || {pii_label('pii_detected')} FROM ledger
      UNION ALL SELECT id, 3, 1, 'VERDICT STATUS: ' || {verdict_label('status')} FROM ledger
      UNION ALL SELECT id, 3, 2, 'RISK SEVERITY: ' || upper(severity) FROM ledger
      UNION ALL SELECT id, 3, 3, 'COMPLIANCE SCORE: ' || CAST(compliance_score AS VARCHAR) || '/100' FROM ledger
      UNION ALL SELECT id, 4, 1, 'Executive Summary' FROM ledger
      UNION ALL SELECT id, 4, 2, {clean('executive_summary')} FROM ledger
      UNION ALL SELECT id, 5, 1, 'Detected Compliance Violations' FROM ledger
      UNION ALL SELECT id, 5, 1 + i, coalesce(vid, 'VIOL-' || CAST(i AS VARCHAR)) || ' | ' || vtext FROM vlist
      UNION ALL SELECT id, 5, 2, {q(V.NO_VIOLATIONS_BANNER)} FROM ledger WHERE id NOT IN (SELECT id FROM vlist)
      UNION ALL SELECT DISTINCT id, 6, 1, 'Actionable Recommendations' FROM rlist
      UNION ALL SELECT id, 6, 1 + i, '-> ' || {clean('r')} FROM rlist
      UNION ALL SELECT id, 7, 1, 'Regulatory Standards Applied' FROM ledger
      UNION ALL SELECT id, 7, 2, 'Rules applied are sourced from: {V.RULE_SOURCE}' FROM ledger"""),
]

SUPPLIED = [
    *TYPED,
    ("h", """SELECT doc_id, filename, doc_type,
      NOT regexp_matches(t, '(?i)\\bdate\\b') AS f1, contains(t, '[REDACTED_EMAIL]') AS f2, contains(t, '[REDACTED_AADHAAR]') AS f3,
      doc_type = 'invoice' AND len(regexp_extract_all(t, '[0-9]{3}')) < 2 AS f5, doc_type = 'certificate' AS open FROM typed"""),
    ("n", "SELECT *, f1::INT + f2::INT + f3::INT + f5::INT AS bad, 3 + (doc_type = 'invoice')::INT AS n FROM h"),
    ("supplied", """SELECT *, CASE WHEN bad > 0 THEN 'NON_COMPLIANT' WHEN open THEN 'REVIEW_NEEDED' ELSE 'COMPLIANT' END AS status,
      CASE WHEN f3 THEN 'CRITICAL' WHEN f2 THEN 'HIGH' WHEN f5 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CAST(floor(100 * (n - bad) / n) AS INT) AS compliance_score,
      concat_ws('|', CASE WHEN f1 THEN 'H-01: Must state a date.' END, CASE WHEN f2 THEN 'H-02: Must hold no address.' END,
        CASE WHEN f3 THEN 'GEN-02: No identity numbers.' END, CASE WHEN f5 THEN 'H-05: Must name two numbers.' END) AS violations,
      CASE WHEN open THEN 'H-09' ELSE '' END AS not_evaluated FROM n"""),
]
MANY = [
    *TYPED,
    ("firms", r"SELECT doc_id, CAST(nullif(regexp_extract(t, '(?i)\bfirm ([0-9]+)\b', 1), '') AS BIGINT) AS firm FROM typed"),
    ("barred", "SELECT doc_id, firm, coalesce(firm % 3 = 0 AND firm < 6000, FALSE) AS bad FROM firms"),
]
TYPES = [*TYPED, ("types", "SELECT doc_type, count(*) AS documents FROM typed GROUP BY 1"), RULES, LOOKUPS]
_DEMAND = f"""SELECT r.id AS rule_id, sum(d.documents) AS documents FROM types d CROSS JOIN lookups l
  JOIN rules r ON r.category = {_WANTED} GROUP BY 1"""

_FULL = """SELECT b.doc_id, b.filename, CASE WHEN g.reject_code IS NOT NULL THEN 'rejected' WHEN g.ocr THEN 'ocr' ELSE a.route END AS route,
  g.reject_code, a.doc_type, a.status, a.severity, a.compliance_score, a.pii_detected,
  array_to_string(a.violations, '|') AS violations, md5(a.executive_summary) AS summary_md5, a.session_id
  FROM b JOIN g USING (doc_id) LEFT JOIN audited a USING (doc_id)"""
_VERDICT = "array_to_string(violations, '|') AS violations, array_to_string(recommendations, '|') AS recommendations"
_REVIEW = "session_id, review_no, override_status, reviewer_notes"
_GONE = q(V.NO_SESSION)


def _masked_text(name: str) -> str:
    return ctes(*TEXTS, ("x", f"SELECT kind, id, {PASSES[name]('text')} AS t FROM texts")) + (
        "SELECT kind, id, CAST(length(t) AS INT) AS masked_length, md5(t) AS masked_md5 FROM x"
    )


def all_checks() -> dict[str, str]:
    all_masked = ctes(*TEXTS, *masking("texts"))
    is_blank = blank("text")
    checks = {name: _masked_text(name) for name in PASSES}
    checks |= {
        "full_audit": ctes(*AUDITED) + _FULL,
        "mask_all": all_masked + "SELECT kind, id, CAST(length(t) AS INT) AS masked_length, md5(t) AS masked_md5 FROM masked",
        "sql_masking": all_masked + "SELECT kind, id, md5(t) AS masked_md5 FROM masked",
        "pii_detected": all_masked + "SELECT kind, id, t IS DISTINCT FROM text AS pii_detected FROM masked",
        "redaction_tags": all_masked + f"SELECT kind, id, array_to_string({TAGS}, ',') AS tags FROM masked",
        "luhn_candidates": ctes(
            *TEXTS,
            ("c", f"SELECT kind, id, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS candidate FROM (SELECT kind, id, regexp_extract_all(text, {q(V.CARD)}) AS h FROM texts)"),
        ) + f"SELECT kind, id, CAST(pos AS INT) AS pos, candidate, {luhn('candidate')} AS luhn_valid FROM c",
        "mask_reports": all_masked + f"""SELECT kind, id, md5(CASE WHEN {is_blank} THEN text ELSE t END) AS masked_md5,
          CASE WHEN {is_blank} THEN FALSE ELSE t IS DISTINCT FROM text END AS pii_detected,
          CAST(CASE WHEN {is_blank} THEN 0 ELSE length(text) END AS INT) AS original_length,
          CAST(CASE WHEN {is_blank} THEN 0 ELSE length(t) END AS INT) AS scrubbed_length,
          {q(V.MASKER_NAME)} AS skill, {q(V.MASKER_VERSION)} AS version,
          CASE WHEN {is_blank} THEN '' ELSE array_to_string({TAGS}, ',') END AS tags FROM masked""",
        "redaction_profile": all_masked + f"""SELECT tag, count(*) AS documents, CAST(sum(removed) AS BIGINT) AS chars_removed FROM
          (""" + " UNION ALL ".join(
            f"SELECT {q(tag)} AS tag, cut{n} AS removed FROM masked WHERE cut{n} IS NOT NULL AND NOT {is_blank}"
            for n, tag in enumerate((V.EMAIL_TAG, V.CARD_TAG, V.AADHAAR_TAG, V.PAN_TAG, V.GSTIN_TAG, V.PHONE_TAG), start=1)
        ) + ") GROUP BY tag",
        "decoded_files": ctes(("l", I.duck_sql(I.LANDED))) + """SELECT doc_id,
          CAST(strlen(crlf_text) + CASE WHEN broken THEN 1 ELSE 0 END AS INT) AS length, NOT broken AS is_valid,
          CASE WHEN NOT broken THEN md5(replace(replace(crlf_text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) END AS text_md5 FROM l""",
        "upload_manifest": ctes(BUSINESS) + "SELECT doc_id, filename, CAST(size_bytes AS BIGINT) AS size_bytes, declared_mime FROM b",
        "extraction_routes": ctes(BUSINESS, ("r", f"SELECT doc_id, filename, CASE WHEN {CODE} IS NOT NULL THEN NULL WHEN {EXT} = '.txt' THEN 'text' WHEN {EXT} = '.pdf' AND NOT {is_blank} THEN 'pdf_text' ELSE 'ocr' END AS route FROM b"))
        + "SELECT doc_id, filename, route, coalesce(route = 'ocr', false) AS needs_ocr FROM r",
        "assembled_conversations": "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (length(text) > 0), '') AS text, CAST(NULL AS VARCHAR) AS reject_code FROM conversations GROUP BY conv_id",
        "file_extensions": ctes(BUSINESS) + f"SELECT doc_id, filename, {EXT} AS ext FROM b",
        "allowed_extensions": ctes(BUSINESS) + f"SELECT doc_id, filename, {ALLOWED} AS allowed FROM b",
        "mime_mismatches": ctes(BUSINESS) + f"SELECT doc_id, filename, {MISMATCH} AS mismatch FROM b",
        "oversized_uploads": ctes(BUSINESS) + f"SELECT doc_id, filename, size_bytes > 5242880 AS too_large, {MB_TEXT} AS megabytes FROM b",
        "empty_uploads": ctes(BUSINESS) + "SELECT doc_id, filename, size_bytes = 0 AS is_empty FROM b",
        "session_keys": ctes(BUSINESS) + "SELECT doc_id, filename, 'audit_' || replace(filename, '.', '_') AS session_key FROM b",
        "gate_reasons": ctes(BUSINESS) + f"SELECT doc_id, filename, {CODE} AS reject_code, {DETAIL} AS reject_detail FROM b",
        "gate_split": ctes(BUSINESS) + f"SELECT doc_id, CASE WHEN {CODE} IS NULL THEN 'accepted' ELSE 'rejected' END AS side FROM b",
        "text_guard": ctes(BUSINESS) + f"SELECT doc_id, filename, CASE WHEN {is_blank} THEN 'no_text' END AS reject_code, CASE WHEN {is_blank} THEN {NO_TEXT} END AS reject_detail FROM b",
        "text_previews": "SELECT doc_id, CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS preview FROM documents",
        "context_cuts": "SELECT doc_id, CAST(length(text[1:3000]) AS INT) AS cut_length, md5(text[1:3000]) AS cut_md5 FROM documents",
        "catalogue_rules": ctes(*TYPES, ("demand", _DEMAND)) + "SELECT category_no, category, seq, id, description, severity, regulation, CAST(coalesce(documents, 0) AS BIGINT) AS documents FROM rules LEFT JOIN demand ON id = rule_id",
        "exported_rules": ctes(*TYPES, ("demand", _DEMAND)) + "SELECT category, seq, id, description, severity, regulation, CAST(coalesce(documents, 0) AS BIGINT) AS documents FROM rules LEFT JOIN demand ON id = rule_id",
        "rules_response": ctes(*TYPES) + f"""SELECT doc_type, documents, string_agg(r.id, ',' ORDER BY l.lookup_no, r.seq) AS rule_ids,
          CAST(count(*) AS INT) AS rule_count, {q(CATALOGUE['_metadata']['version'])} AS version, {q(CATALOGUE['_metadata']['jurisdiction'])} AS jurisdiction
          FROM types d CROSS JOIN lookups l JOIN rules r ON r.category = {_WANTED} GROUP BY doc_type, documents""",
        "applicable_rules": ctes(*TYPED, RULES, LOOKUPS) + f"SELECT d.doc_id, d.doc_type, l.lookup_no, r.seq, r.id AS rule_id, r.severity, r.regulation FROM typed d CROSS JOIN lookups l JOIN rules r ON r.category = {_WANTED}",
        "combined_rules": ctes(*TYPES) + "SELECT doc_type, documents, 0 AS lookup_no, category, seq, id AS rule_id FROM types, rules WHERE category = 'general' UNION ALL SELECT doc_type, documents, 1, category, seq, id FROM types JOIN rules ON category = lower(doc_type)",
        "rule_counts": ctes(*TYPES) + "SELECT doc_type, documents, CAST((SELECT count(*) FROM rules WHERE category = 'general') + (SELECT count(*) FROM rules WHERE category = lower(doc_type)) AS BIGINT) AS rule_count FROM types",
        "supported_types": ctes(*TYPES) + "SELECT category, min(category_no) AS category_no, count(*) AS rule_count, (SELECT CAST(count(DISTINCT category) AS INT) FROM rules) AS type_count, coalesce(max(documents), 0) AS documents FROM rules LEFT JOIN types ON category = doc_type GROUP BY category",
        "rules_summary": ctes(*TYPES) + "SELECT category_no, category, count(*) AS rule_count, '📁 ' || upper(category) || ': ' || CAST(count(*) AS VARCHAR) || ' rule(s)' || chr(10) || string_agg('   • [' || id || '] ' || description, chr(10) ORDER BY seq) AS block, coalesce(max(documents), 0) AS documents FROM rules LEFT JOIN types ON category = doc_type GROUP BY category_no, category",
        "rules_json": ctes(*TYPES) + f"""SELECT doc_type, documents, '[' || string_agg(CAST(to_json({{'id': r.id, 'description': r.description, 'severity': r.severity, 'regulation': r.regulation}}) AS VARCHAR), ',' ORDER BY l.lookup_no, r.seq) || ']' AS rules_text
          FROM types d CROSS JOIN lookups l JOIN rules r ON r.category = {_WANTED} GROUP BY doc_type, documents""",
        "sql_rules": ctes(*TYPES) + f"SELECT doc_type, documents, l.lookup_no, r.category, r.seq, r.id AS rule_id FROM types d CROSS JOIN lookups l JOIN rules r ON r.category = {_WANTED}",
        "rule_lookup": ctes(VIOLATIONS, RULES, ("ids", f"SELECT *, coalesce({VIOL_ID.replace('(v,', '(violation,')}, 'none') AS rule_id FROM viol"))
        + f"SELECT doc_id, line_no, violation, rule_id, id IS NOT NULL AS found, category, severity, CASE WHEN id IS NULL THEN {q(V.NO_RULE)} END AS error FROM ids LEFT JOIN rules ON id = rule_id",
        "triaged_documents": ctes(*TYPED) + "SELECT doc_id, doc_type, confidence, CASE WHEN total = 0 THEN 'no cue found' ELSE CAST(best AS VARCHAR) || ' of ' || CAST(total AS VARCHAR) || ' cue(s) found point to ' || doc_type END AS reasoning FROM typed",
        "rule_evaluations": ctes(*EVALS) + "SELECT doc_id, doc_type, id AS rule_id, severity, passed FROM evals",
        "tag_evidence": ctes(*EVALS) + f"SELECT doc_id, array_to_string({TAGS}, ',') AS tags, id AS rule_id, passed FROM evals WHERE id IN ('INV-01', 'INV-05')",
        "audit_verdicts": ctes(*VERDICTS) + f"SELECT doc_id, status, severity, compliance_score, {_VERDICT} FROM verdicts",
        "executive_summaries": ctes(*AUDITED) + "SELECT doc_id, executive_summary FROM audited",
        "packaged_results": ctes(*AUDITED) + f"""SELECT doc_id, filename, doc_type, status, severity, compliance_score, pii_detected AS pii_was_detected,
          array_to_string(violations, '|') AS violations, {q(V.RULE_SOURCE)} AS rule_source, md5(executive_summary) AS summary_md5,
          CASE WHEN length(t) > 500 THEN t[1:500] || '...' ELSE t END AS scrubbed_text_preview, {q(V.STAGES)} AS pipeline FROM audited""",
        "model_inputs": ctes(*MASKED) + """SELECT doc_id, concat_ws(chr(10), 'DOCUMENT FOR COMPLIANCE AUDIT', repeat('=', 30), 'Filename: ' || filename,
          'Characters: ' || CAST(length(t) AS VARCHAR), 'PII Detected & Redacted: ' || CASE WHEN t IS DISTINCT FROM text THEN 'True' ELSE 'False' END, '',
          'DOCUMENT CONTENT (PII-Scrubbed):', t, repeat('=', 30), '', 'Classify the document, audit it against its rules, then summarise the verdict.') AS model_input FROM masked""",
        "latest_agent_output": ctes(*LATEST) + "SELECT * FROM latest",
        "latest_role_messages": """SELECT conv_id AS doc_id, coalesce(arg_max(text, turn) FILTER (role = 'user' AND length(text) > 0), '') AS triage_raw,
          coalesce(arg_max(text, turn) FILTER (role <> 'user' AND length(text) > 0), '') AS audit_raw,
          arg_max_null(text, turn) FILTER (role = 'assistant') AS final_text FROM conversations GROUP BY conv_id""",
        "extracted_json": ctes(*EVENTS, ("x", f"SELECT doc_id, seq, {found_json('text')} AS j FROM e"))
        + "SELECT doc_id, seq, j IS NOT NULL AS found, j->>'$.doc_type' AS doc_type, j->>'$.status' AS status FROM x",
        "triage_fields": ctes(*ANSWERS) + "SELECT doc_id, doc_type, confidence, reasoning FROM answers",
        "audit_fields": ctes(*ANSWERS) + f"SELECT doc_id, status, severity, compliance_score, {_VERDICT} FROM answers",
        "merged_verdicts": ctes(*ANSWERS, ("fb", I.duck_sql(I.FALLBACKS)), (
            "j",
            """SELECT a.*, f.doc_id IS NOT NULL AS used_fallback, f.doc_type AS f_type, f.status AS f_status, f.severity AS f_severity,
              f.compliance_score AS f_score, CASE WHEN f.doc_id IS NULL THEN NULL WHEN f.violation = '' THEN [] ELSE [f.violation] END AS f_viol,
              CASE WHEN f.doc_id IS NOT NULL THEN [f.recommendation] END AS f_rec
              FROM answers a LEFT JOIN fb f ON f.doc_id = a.doc_id AND (coalesce(a.doc_type, '') = '' OR coalesce(a.status, '') = '' OR coalesce(a.severity, '') = '')""",
        )) + """SELECT doc_id,
          coalesce(nullif(doc_type, ''), nullif(f_type, ''), 'unknown') AS doc_type,
          coalesce(nullif(status, ''), nullif(f_status, ''), 'REVIEW_NEEDED') AS status,
          coalesce(nullif(severity, ''), nullif(f_severity, ''), 'MEDIUM') AS severity,
          CASE WHEN used_fallback AND coalesce(compliance_score, 0) = 0 THEN coalesce(f_score, 0) ELSE coalesce(compliance_score, 0) END AS compliance_score,
          array_to_string(CASE WHEN used_fallback AND len(coalesce(violations, [])) = 0 THEN f_viol ELSE coalesce(violations, []) END, '|') AS violations,
          array_to_string(CASE WHEN used_fallback AND len(coalesce(recommendations, [])) = 0 THEN f_rec ELSE coalesce(recommendations, []) END, '|') AS recommendations,
          used_fallback FROM j""",
        "routed_results": ctes(*AUDITED) + "SELECT doc_id, severity, CASE WHEN route = 'pending' AND NOT suffix(filename, '.PDF') THEN 'pending' ELSE 'auto' END AS side FROM audited",
        "review_notices": ctes(*AUDITED) + f"""SELECT doc_id, session_id, {q(V.AWAITING_REVIEW)} AS status, severity, CAST(len(violations) AS INT) AS violation_count,
          '🚨 ' || CAST(len(violations) AS VARCHAR) || ' critical violation(s) detected. Human approval required. Approve session ' || session_id || ' to proceed.' AS message,
          array_to_string(violations[1:3], '|') AS preview_violations FROM audited WHERE route = 'pending'""",
        "violation_previews": ctes(*AUDITED) + "SELECT doc_id, array_to_string(violations[1:3], '|') AS preview_violations FROM audited",
        "first_reviews": ctes(REVIEWS, FIRSTS) + f"SELECT {_REVIEW}, {TS.format('review_ts')} AS review_ts FROM firsts",
        "repeated_reviews": ctes(*PENDING, FIRSTS) + f"SELECT {_REVIEW}, {_GONE} AS error FROM reviews r WHERE session_id IN (SELECT session_id FROM pending) AND review_no NOT IN (SELECT review_no FROM firsts)",
        "reviewed_sessions": ctes(*PENDING, FIRSTS) + f"SELECT doc_id, {_REVIEW}, status, severity FROM pending JOIN firsts USING (session_id)",
        "unknown_sessions": ctes(*PENDING) + f"SELECT {_REVIEW}, {_GONE} AS error FROM reviews WHERE session_id NOT IN (SELECT session_id FROM pending)",
        "remaining_pending": ctes(*PENDING) + "SELECT doc_id, session_id, severity FROM pending WHERE session_id NOT IN (SELECT session_id FROM reviews)",
        "override_checks": ctes(REVIEWS, ("o", f"SELECT *, {_OVERRIDE} AS override FROM reviews")) + f"SELECT {_REVIEW}, override, CASE WHEN {_REFUSED} THEN {q(V.BAD_OVERRIDE)} END AS override_error FROM o",
        "applied_overrides": ctes(*APPROVED) + f"""SELECT doc_id, session_id, final_status, final_severity, overridden,
          CASE WHEN changed THEN final_status ELSE status END AS report_status, CASE WHEN changed THEN final_severity ELSE severity END AS report_severity,
          CASE WHEN changed THEN override IS NOT NULL END AS status_overridden, CASE WHEN override IS NOT NULL THEN status END AS original_status,
          override AS new_status, note AS reviewer_notes, CASE WHEN changed THEN {iso('review_ts')} END AS timestamp FROM approved""",
        "review_timestamps": ctes(REVIEWS) + f"SELECT review_no, {iso('review_ts')} AS iso FROM reviews",
        "ledger_entries": ctes(*LEDGER) + f"SELECT doc_id, filename, doc_type, status, severity, {TS.format('ts')} AS timestamp FROM ledger",
        "ledger_ids": "SELECT 100 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey FROM orders",
        "stored_ledger": ctes(*LEDGER) + f"""SELECT id, {TS.format('ts')} AS timestamp, filename, doc_type, status, severity, compliance_score, report_status,
          compliance_score AS report_score, array_to_string(violations, '|') AS violations, note AS reviewer_notes FROM ledger""",
        "ledger_lookup": ctes(*LEDGER) + "SELECT id, filename, status, severity FROM ledger WHERE id = 42",
        "latest_logs": ctes(*LEDGER) + f"SELECT id, {TS.format('ts')} AS timestamp, filename, doc_type, status, severity FROM ledger ORDER BY ts DESC, id DESC LIMIT 10",
        "compliance_trend": ctes(*LEDGER) + "SELECT strftime(ts, '%Y-%m-%d') AS day, doc_type, status, severity, count(*) AS audits, avg(compliance_score) AS avg_score FROM ledger GROUP BY 1, 2, 3, 4",
        "cleaned_markdown": ctes(("p", I.duck_sql(I.MARKDOWN)), ("c", f"SELECT doc_id, {clean('text')} AS clean FROM p"))
        + "SELECT doc_id, CAST(length(clean) AS INT) AS clean_length, md5(clean) AS clean_md5, array_to_string(string_split(clean, chr(10))[1:2], chr(10)) AS first_lines FROM c",
        "split_violations": ctes(VIOLATIONS, ("s", "SELECT doc_id, line_no, violation AS v FROM viol")) + f"SELECT doc_id, line_no, v AS violation, {VIOL_ID} AS violation_id, {VIOL_TEXT} AS description FROM s",
        "numbered_violations": ctes(*AUDITED, ("n", "SELECT doc_id, unnest(violations) AS w, generate_subscripts(violations, 1) AS i FROM audited"), ("s", "SELECT doc_id, i, CASE WHEN i = 1 THEN split_part(w, ': ', 2) ELSE w END AS v FROM n"))
        + f"SELECT doc_id, CAST(i AS INT) AS violation_no, coalesce({VIOL_ID}, 'VIOL-' || CAST(i AS VARCHAR)) AS violation_id, {VIOL_TEXT} AS description FROM s",
        "enriched_violations": ctes(VIOLATIONS, RULES, ("s", f"SELECT doc_id, line_no, v, {VIOL_ID} AS vid FROM (SELECT doc_id, line_no, violation AS v FROM viol)"))
        + "SELECT doc_id, line_no, v AS violation, vid AS violation_id, category, severity, regulation FROM s LEFT JOIN rules ON id = vid",
        "report_labels": ctes(*AUDITED) + f"SELECT doc_id, {capital('doc_type')} AS category, {pii_label('pii_detected')} AS pii, {verdict_label('status')} AS verdict, {band('severity')} AS band FROM audited",
        "capitalized_texts": f"SELECT o_orderkey, {capital('o_orderpriority')} AS priority, {capital('o_orderstatus')} AS status FROM orders",
        "event_bands": ctes(("x", "SELECT event_id, CASE event_type WHEN 'view' THEN 'Compliant' WHEN 'click' THEN 'REVIEW_NEEDED' ELSE event_type END AS s, CASE event_type WHEN 'error' THEN 'high' WHEN 'view' THEN 'Low' ELSE event_type END AS l FROM events"))
        + f"SELECT event_id, {verdict_label('s')} AS verdict, {band('l')} AS band FROM x",
        "report_defaults": ctes(*LEDGER) + f"""SELECT id AS log_id, filename, CASE WHEN severity = 'MEDIUM' THEN 'unknown' ELSE doc_type END AS doc_type,
          CASE WHEN severity = 'MEDIUM' THEN 'NON_COMPLIANT' ELSE status END AS status, severity,
          CASE WHEN severity = 'MEDIUM' THEN 0 ELSE compliance_score END AS compliance_score,
          CASE WHEN severity = 'MEDIUM' THEN FALSE ELSE pii_detected END AS pii_detected,
          CASE WHEN severity = 'MEDIUM' THEN '' ELSE array_to_string(violations, '|') END AS violations,
          md5(CASE WHEN severity = 'MEDIUM' THEN '' ELSE executive_summary END) AS summary_md5, {q(V.RULE_SOURCE)} AS rule_source FROM ledger""",
        "report_lines": ctes(*LINES) + "SELECT log_id, section_no, CAST(line_no AS INT) AS line_no, text FROM lines",
        "report_texts": ctes(*LINES, ("r", "SELECT log_id, string_agg(text, chr(10) ORDER BY section_no, line_no) AS body FROM lines GROUP BY log_id"))
        + "SELECT log_id, filename, md5(body) AS report_md5, CAST(length(body) AS INT) AS report_length FROM r JOIN ledger ON id = log_id",
        "report_timestamps": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS shown FROM events",
        "streamed_approvals": ctes(*APPROVED) + f"""SELECT session_id, doc_id, 'approved' AS outcome, final_status AS status, final_severity AS severity,
          note AS reviewer_notes, CASE WHEN changed THEN {iso('review_ts')} END AS decided FROM approved
          UNION ALL SELECT session_id, doc_id, 'refused', status, severity, reviewer_notes, {q(V.BAD_OVERRIDE)} FROM reviewed WHERE {_REFUSED}""",
        "refused_overrides": ctes(*APPROVED) + f"SELECT doc_id, {_REVIEW}, {q(V.BAD_OVERRIDE)} AS override_error FROM reviewed WHERE {_REFUSED}",
        "scanned_files": ctes(("l", I.duck_sql(I.LANDED))) + """SELECT folder, CAST(sum(strlen(crlf_text) + 2 + CASE WHEN folder % 7 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS length,
          folder % 7 <> 3 AS is_valid, CASE WHEN folder % 7 = 3 THEN 'encoding' END AS reject_code,
          CASE WHEN folder % 7 <> 3 THEN md5(replace(replace(string_agg(crlf_text || chr(13) || chr(10), '' ORDER BY doc_id), chr(13) || chr(10), chr(10)), chr(13), chr(10))) END AS text_md5
          FROM (SELECT *, doc_id // 50 AS folder FROM l) GROUP BY folder""",
        "ocr_work": ctes(BUSINESS, GATED) + "SELECT doc_id, filename, declared_mime FROM g WHERE ocr",
        "reentered_audit": ctes(("b0", I.duck_sql(I.BUSINESS_DOCUMENTS)), ("pages_", "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (length(text) > 0), '') AS back FROM conversations GROUP BY conv_id"),
          ("b", f"SELECT b0.* REPLACE (CASE WHEN doc_id % 47 = 0 AND {blank('text')} THEN coalesce(back, text) ELSE text END AS text) FROM b0 LEFT JOIN pages_ ON conv_id = doc_id % 40"), *AUDITED[1:])
          + f"SELECT doc_id, route, reject_code, doc_type, status, severity, pii_detected FROM ({_FULL})",
        "supplied_catalogue": ctes(*SUPPLIED) + "SELECT doc_id, status, severity, compliance_score, violations, not_evaluated FROM supplied",
        "many_rules": ctes(*MANY) + """SELECT doc_id, CASE WHEN bad THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END AS status,
          CASE WHEN bad THEN ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][(firm // 3) % 4 + 1] ELSE 'LOW' END AS severity,
          CAST(CASE WHEN bad THEN 99 ELSE 100 END AS INT) AS compliance_score,
          CASE WHEN bad THEN 'W-' || lpad(CAST(firm // 3 AS VARCHAR), 4, '0') || ': Must not concern firm ' || firm || '.' ELSE '' END AS violations FROM barred""",
        "review_needed_reports": ctes(*SUPPLIED) + """SELECT filename, status, not_evaluated, not_evaluated AS shown_rules, CAST(compliance_score AS VARCHAR) || '/100' AS shown_score,
          CASE status WHEN 'COMPLIANT' THEN 'COMPLIANT ✅' WHEN 'REVIEW_NEEDED' THEN 'REVIEW_NEEDED ⚠' ELSE 'NON_COMPLIANT ❌' END AS shown_status,
          CASE WHEN bad > 0 AND open THEN 'The document breaks ' || bad || ' applicable rule(s). 1 applicable rule(s) could not be evaluated: H-09.'
            WHEN bad > 0 THEN 'The document breaks ' || bad || ' applicable rule(s).'
            WHEN open THEN 'The document breaks no rule that was evaluated. 1 applicable rule(s) could not be evaluated: H-09.'
            ELSE 'The document satisfies every applicable rule.' END AS finding
          FROM supplied WHERE severity NOT IN ('HIGH', 'CRITICAL')""",
    }
    merged = checks["merged_verdicts"]
    checks["model_audit"] = ctes(*MASKED, *LATEST, ("v", merged), ("r", """SELECT m.doc_id, m.filename, m.received_at, v.* EXCLUDE (doc_id), coalesce(l.final_text, '') AS summary,
      CASE WHEN v.severity IN ('HIGH', 'CRITICAL') THEN 'pending' ELSE 'auto' END AS route FROM masked m JOIN v USING (doc_id) JOIN latest l USING (doc_id)"""),
      ("i", "SELECT doc_id, row_number() OVER (ORDER BY received_at, doc_id) AS id FROM r WHERE route = 'auto'")) + """SELECT doc_id, filename, route, doc_type, status, severity, compliance_score, violations,
      md5(summary) AS summary_md5, md5(CAST(doc_id AS VARCHAR)) AS session_id, id, CASE WHEN route = 'auto' THEN status END AS report_status FROM r LEFT JOIN i USING (doc_id)"""
    checks["rule_evaluations_by_join"] = checks["rule_evaluations"]
    checks["audit_verdicts_by_group"] = checks["audit_verdicts"]
    checks["streamed_audit"] = checks["full_audit"]
    checks["streamed_sessions"] = checks["streamed_approvals"]
    checks["shared_ledger"] = ctes(*LEDGER) + f"SELECT id, {TS.format('ts')} AS timestamp, filename, doc_type, status, severity, compliance_score FROM ledger"
    status = """SELECT b.doc_id, b.filename, coalesce(a.status, 'UNKNOWN') AS status, coalesce(a.severity, 'UNKNOWN') AS severity,
      CAST(coalesce(len(a.violations), 0) AS INT) AS violation_count,
      CASE WHEN b.size_bytes IS NULL THEN 'File does not exist' WHEN g.reject_detail IS NOT NULL THEN 'Error: ' || g.reject_detail[1:40] END AS message, g.reject_detail AS error
      FROM b JOIN g USING (doc_id) LEFT JOIN audited a USING (doc_id)"""
    checks["batch_status"] = ctes(*AUDITED) + status
    checks["batch_summary"] = ctes(*AUDITED, ("s", status)) + "SELECT status, severity, message, count(*) AS files, CAST(sum(violation_count) AS BIGINT) AS violations FROM s GROUP BY 1, 2, 3"
    return checks
