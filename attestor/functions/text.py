"""Text functions: blanks, previews, report clean-up, labels and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.session import bind, column

VIOLATION = r"(?d)^([A-Z]+-\d+):\s*(.*)$"


def sql_literal(text: str | None) -> str:
    if text is None:
        return "NULL"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def blank_sql(text: str) -> str:
    return f"({text} IS NULL OR NOT {text} RLIKE r'[^{V.SPACE_CLASS}]')"


def is_blank(text: Column | str) -> Column:
    """Null or nothing but white space. Looks only for the first other character."""
    text = column(text)
    return text.isNull() | ~text.rlike(f"[^{V.SPACE_CLASS}]")


def strip(text: Column | str) -> Column:
    return F.btrim(column(text), F.lit(V.SPACES))


def missing(value: Column | str) -> Column:
    """Null or the empty string."""
    value = column(value)
    return value.isNull() | (value == "")


def text_preview(text: Column | str, size: int = V.PREVIEW_CHARS) -> Column:
    text = column(text)
    return F.when(
        F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))
    ).otherwise(text)


def context_cut(text: Column | str, size: int = V.CONTEXT_CHARS) -> Column:
    return F.substring(column(text), 1, size)


def clean_markdown(text: Column | str) -> Column:
    """Markdown marks removed, known characters mapped, the rest reduced to Latin-1.

    A text without a mark or a character beyond Latin-1 costs one scan.
    """
    mapped = "".join(V.PLAIN_CHARS) + "`"

    def plain(t: Column) -> Column:
        return F.when(t.rlike(f"[{mapped}]"), F.translate(t, mapped, "".join(V.PLAIN_CHARS.values()))).otherwise(t)

    def cleaned(text: Column) -> Column:
        t = F.regexp_replace(text, rf"#+[{V.SPACE_CLASS}]*", "")
        t = F.regexp_replace(t, r"\*\*([^*]+)\*\*", "$1")
        t = bind(F.regexp_replace(t, r"\*([^*]+)\*", "$1"), plain)
        for mark, word in V.PLAIN_WORDS.items():
            t = F.replace(t, F.lit(mark), F.lit(word))
        t = F.regexp_replace(t, r"[^\x{00}-\x{FF}]", "")
        return F.when(text.rlike(r"[#*`]|[^\x{00}-\x{FF}]"), t).otherwise(text)

    return F.btrim(bind(F.coalesce(column(text), F.lit("")), cleaned), F.lit(V.SPACES))


def violation_id(violation: Column | str) -> Column:
    """The leading rule id, or null where the text does not have the labelled one-line form."""
    return F.nullif(F.regexp_extract(column(violation), VIOLATION, 1), F.lit(""))


def violation_text(violation: Column | str) -> Column:
    violation = column(violation)
    return F.when(
        violation.rlike(VIOLATION), F.regexp_extract(violation, VIOLATION, 2)
    ).otherwise(violation)


def capitalize(text: Column | str) -> Column:
    text = column(text)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647)))


def pii_label(detected: Column | str) -> Column:
    return F.when(column(detected), F.lit(V.PII_FOUND_LABEL)).otherwise(F.lit(V.PII_NONE_LABEL))


def verdict_label(status: Column | str) -> Column:
    """Anything but COMPLIANT, also a status still open for review, is NON-COMPLIANT."""
    return F.when(F.upper(column(status)) == V.COMPLIANT, F.lit("COMPLIANT")).otherwise(
        F.lit("NON-COMPLIANT")
    )


def severity_band(severity: Column | str) -> Column:
    upper = F.upper(column(severity))
    return F.when(upper.isin("LOW", "MEDIUM", "HIGH"), upper).otherwise(F.lit("CRITICAL"))


def severity_rank(severity: Column | str) -> Column:
    """1 for LOW up to 4 for CRITICAL; null for anything else."""
    ranks = F.array(*[F.lit(s) for s in V.SEVERITIES])
    return F.nullif(F.array_position(ranks, column(severity)).cast("int"), F.lit(0))


def bullet_list(items: Column | str, none_text: str) -> Column:
    items = column(items)
    lines = F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")
    return F.when(F.size(items) > 0, lines).otherwise(F.lit(none_text))


def score_text(score: Column | str) -> Column:
    return F.coalesce(F.concat(column(score).cast("string"), F.lit("/100")), F.lit(V.NOT_SCORED))


def executive_summary(
    doc_type: Column, status: Column, severity: Column, score: Column,
    violations: Column, recommendations: Column, not_evaluated: Column,
) -> Column:
    """The Markdown summary of one verdict, from integers and texts only.

    Rules that could not be evaluated are named; a document that has such rules and breaks none is
    neither compliant nor the contrary, and without any evaluated rule it has no score.
    """
    count = F.size(violations).cast("string")
    mark = F.when(status == V.COMPLIANT, F.lit("COMPLIANT ✅")).when(
        status == V.REVIEW_NEEDED, F.lit(f"{V.REVIEW_NEEDED} ⚠")
    ).otherwise(F.lit("NON_COMPLIANT ❌"))
    open_rules = F.size(not_evaluated) > 0
    unknown = F.concat(
        F.size(not_evaluated).cast("string"), F.lit(" applicable rule(s) could not be evaluated: "),
        F.array_join(not_evaluated, ", "), F.lit("."),
    )
    broken = F.concat(F.lit("The document breaks "), count, F.lit(" applicable rule(s)."))
    finding = (
        F.when((F.size(violations) > 0) & open_rules, F.concat(broken, F.lit(" "), unknown))
        .when(F.size(violations) > 0, broken)
        .when(open_rules, F.concat(F.lit("The document breaks no rule that was evaluated. "), unknown))
        .otherwise(F.lit("The document satisfies every applicable rule."))
    )
    return F.concat_ws(
        "\n",
        F.lit(V.SUMMARY_TITLE),
        F.lit(""),
        F.concat(F.lit(V.SUMMARY_LABELS[0]), doc_type),
        F.concat(F.lit(V.SUMMARY_LABELS[1]), mark),
        F.concat(F.lit(V.SUMMARY_LABELS[2]), severity),
        F.concat(F.lit(V.SUMMARY_LABELS[3]), score_text(score)),
        F.lit(""),
        F.lit(V.SUMMARY_SECTIONS[0]),
        finding,
        F.lit(""),
        F.lit(V.SUMMARY_SECTIONS[1]),
        bullet_list(violations, "No violations found"),
        F.lit(""),
        F.lit(V.SUMMARY_SECTIONS[2]),
        bullet_list(recommendations, "No action needed"),
    )


def session_key(filename: Column | str) -> Column:
    return F.concat(F.lit("audit_"), F.replace(column(filename), F.lit("."), F.lit("_")))


def model_input(filename: Column, masked: Column, detected: Column) -> Column:
    """The text handed to an external model for one document, header first."""
    rule = F.lit(V.MODEL_INPUT_RULE)
    return F.concat_ws(
        "\n",
        F.lit(V.MODEL_INPUT_TITLE),
        rule,
        F.concat(F.lit(V.MODEL_INPUT_LABELS[0]), filename),
        F.concat(F.lit(V.MODEL_INPUT_LABELS[1]), F.length(masked).cast("string")),
        F.concat(F.lit(V.MODEL_INPUT_LABELS[2]), F.when(detected, F.lit("True")).otherwise(F.lit("False"))),
        F.lit(""),
        F.lit(V.MODEL_INPUT_LABELS[3]),
        masked,
        rule,
        F.lit(""),
        F.lit("Classify the document, audit it against its rules, then summarise the verdict."),
    )


def iso_timestamp(ts: Column | str) -> Column:
    """ISO text; the fraction appears only where there is one, six digits long."""
    ts = column(ts)
    micros = F.date_format(ts, "SSSSSS")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def report_timestamp(ts: Column | str) -> Column:
    return F.concat(F.date_format(column(ts), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def utc_now() -> Column:
    """The current UTC time without a zone."""
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())
