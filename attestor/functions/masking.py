"""Personal-data masking as native SQL expressions; no Python runs per row.

Each pass is one SQL text over the name of a text column, so the same expression serves
the DataFrame API (``F.expr``) and the SQL function, and builds in one call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.functions.text import blank_sql
from attestor.session import column


def _raw(text: str) -> str:
    """A raw SQL string literal; the patterns hold no quotes."""
    return f"r'{text}'"


def bind_sql(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once per row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def luhn_sql(value: str) -> str:
    plain = f"translate({value}, '{V.OTHER_DIGITS}', '{V.OTHER_DIGIT_VALUES}')"
    digits = f"regexp_replace({plain}, '[^0-9]', '')"
    return f"({digits} <> '' AND luhn_check({digits}))"


def _replace_all(text: str, pattern: str, tag: str) -> str:
    return f"regexp_replace({text}, {_raw(pattern)}, '{tag}')"


def _replace_where(text: str, pattern: str, tag: str, wanted: str) -> str:
    """Replace only the matches ``m`` of the pattern for which ``wanted`` holds.

    The text is cut at the matches; the pieces and the matches, kept or replaced, are put
    together again. A text without a match costs one scan.
    """
    p = _raw(pattern)
    tail = (
        f"zip_with(regexp_extract_all(t, {p}, 0), slice(pieces, 2, size(pieces)),"
        f" (m, piece) -> concat(CASE WHEN {wanted} THEN '{tag}' ELSE m END, piece))"
    )
    rebuilt = bind_sql(f"split(t, {p}, -1)", "pieces", f"concat(pieces[0], array_join({tail}, ''))")
    return bind_sql(text, "t", f"CASE WHEN t RLIKE {p} THEN {rebuilt} ELSE t END")


def email_sql(text: str) -> str:
    masked = _replace_all(text, V.EMAIL_LINEAR, V.EMAIL_TAG)
    return f"CASE WHEN contains({text}, '@') THEN {masked} ELSE {text} END"


def card_sql(text: str) -> str:
    return _replace_where(text, V.CARD, V.CARD_TAG, luhn_sql("m"))


def aadhaar_sql(text: str) -> str:
    return _replace_all(text, V.AADHAAR, V.AADHAAR_TAG)


def pan_sql(text: str) -> str:
    return _replace_all(text, V.PAN, V.PAN_TAG)


def gstin_sql(text: str) -> str:
    return _replace_all(text, V.GSTIN, V.GSTIN_TAG)


def phone_sql(text: str) -> str:
    """Bare runs of 13 digits and more are registration numbers and stay."""
    return _replace_where(text, V.PHONE, V.PHONE_TAG, f"NOT m RLIKE {_raw(V.LONG_DIGIT_RUN)}")


def mask_all_sql(text: str) -> str:
    """All six passes in their fixed order; later passes see the earlier tags.

    One cheap scan decides whether any number pass can match, so a text without
    number-like content costs one regular expression and not seven.
    """
    numbers = phone_sql(gstin_sql(pan_sql(aadhaar_sql(card_sql("n")))))
    return bind_sql(
        email_sql(text), "n", f"CASE WHEN n RLIKE {_raw(V.NUMBER_HINT)} THEN {numbers} ELSE n END"
    )


PASSES = (
    (V.EMAIL_TAG, email_sql), (V.CARD_TAG, card_sql), (V.AADHAAR_TAG, aadhaar_sql),
    (V.PAN_TAG, pan_sql), (V.GSTIN_TAG, gstin_sql), (V.PHONE_TAG, phone_sql),
)


def removed_sql(text: str) -> str:
    """Array of (tag, chars_removed) of the passes that changed the text, each on its own."""
    rows = ", ".join(
        f"CASE WHEN s{i} <> s{i + 1} THEN named_struct('tag', '{tag}', 'removed', length(s{i}) - length(s{i + 1})) END"
        for i, (tag, _) in enumerate(PASSES)
    )
    body = f"array_compact(array({rows}))"
    for i in reversed(range(len(PASSES))):
        body = bind_sql(PASSES[i][1](f"s{i}"), f"s{i + 1}", body)
    return bind_sql(text, "s0", body)


def tags_sql(masked: str) -> str:
    return f"array_sort(array_distinct(regexp_extract_all({masked}, {_raw(V.ANY_TAG)}, 0)))"


# --- the same as columns, over the name of a text column -----------------------------------


def luhn_valid(text: str) -> Column:
    """True if the digits of the value pass the Luhn check; no digits at all is false."""
    return F.expr(luhn_sql(text))


def mask_email(text: str) -> Column:
    return F.expr(email_sql(text))


def mask_card(text: str) -> Column:
    return F.expr(card_sql(text))


def mask_aadhaar(text: str) -> Column:
    return F.expr(aadhaar_sql(text))


def mask_pan(text: str) -> Column:
    return F.expr(pan_sql(text))


def mask_gstin(text: str) -> Column:
    return F.expr(gstin_sql(text))


def mask_phone(text: str) -> Column:
    return F.expr(phone_sql(text))


def mask_all(text: str) -> Column:
    return F.expr(mask_all_sql(text))


def tags_used(masked: Column | str) -> Column:
    found = F.regexp_extract_all(column(masked), F.lit(V.ANY_TAG), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def pii_detected(raw: Column | str, masked: Column | str) -> Column:
    return ~column(raw).eqNullSafe(column(masked))


def mask_report(text: str) -> Column:
    """Struct of masked text, lengths and tags; blank text reports zero lengths and no tags."""

    def report(scrubbed: str, detected: str, before: str, after: str, tags: str) -> str:
        return (
            f"named_struct('scrubbed_text', {scrubbed}, 'pii_detected', {detected},"
            f" 'original_length', {before}, 'scrubbed_length', {after},"
            f" 'skill', '{V.MASKER_NAME}', 'version', '{V.MASKER_VERSION}',"
            f" 'redaction_tags_used', {tags})"
        )

    blank = report(text, "false", "0", "0", "cast(array() AS array<string>)")
    after = "masked_once"
    filled = report(
        after, f"NOT {after} <=> {text}", f"length({text})", f"length({after})", tags_sql(after)
    )
    masked = bind_sql(mask_all_sql(text), after, filled)
    return F.expr(f"CASE WHEN {blank_sql(text)} THEN {blank} ELSE {masked} END")
