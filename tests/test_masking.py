import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestor import fixed_values as V
from attestor.functions import masking, sql_functions
from attestor.operators.redaction import mask_documents, redaction_profile

SF = "/root/testdata/sf0.001"

CASES = [
    ("Write to billing@company.co.in for help", "Write to [REDACTED_EMAIL] for help"),
    ("card 4111 1111 1111 1111.", "card [REDACTED_CREDIT_CARD]."),
    ("5500 0000 0000 0004", "[REDACTED_CREDIT_CARD]"),
    ("+91-9876543210", "[REDACTED_PHONE]"),
    ("PAN: ABCDE1234F", "PAN: [REDACTED_PAN]"),
    ("This invoice covers services rendered in Q2 2026.", "This invoice covers services rendered in Q2 2026."),
    # Luhn fails, so the Aadhaar pass takes twelve of the digits.
    ("1234-5678-9012-3456", "[REDACTED_AADHAAR]-3456"),
    ("1234 5678 9012", "[REDACTED_AADHAAR]"),
    # Fourteen bare digits that fail Luhn are a registration number and stay.
    ("FSSAI 10020042000015", "FSSAI 10020042000015"),
    ("22AAAAA0000A1Z5", "[REDACTED_GSTIN]"),
    ("(022) 2345-6789", "([REDACTED_PHONE]"),
    ("mail a@b.com. Next", "mail [REDACTED_EMAIL] Next"),
    ("x4111111111111111", "x4111111111111111"),
    # No-break spaces, as PDF text has them, and digits of other scripts.
    ("1234\u00a05678\u00a09012", "[REDACTED_AADHAAR]"),
    ("\u0967\u0968\u0969\u096a \u096b\u096c\u096d\u096e \u096f\u0966\u0967\u0968", "[REDACTED_AADHAAR]"),
    ("+91\u00a098765\u00a043210", "[REDACTED_PHONE]"),
    ("\u096a\u0967\u0967\u0967 1111 1111 1111", "[REDACTED_CREDIT_CARD]"),
    ("\u0968\u0968AAAAA0000A1Z5", "[REDACTED_GSTIN]"),
    ("a@b.c_x@d.e", "[REDACTED_EMAIL][REDACTED_EMAIL]"),
    ("", ""),
    (None, None),
]


def test_literal_cases(value_of):
    assert value_of(masking.mask_all, [c[0] for c in CASES]) == [c[1] for c in CASES]


def test_column_named_like_an_inner_variable(spark):
    for name in ("t", "m", "n", "s", "pieces", "piece", "masked_twice"):
        df = spark.createDataFrame([("a@b.com 4111 1111 1111 1111",)], f"{name} string")
        row = df.select(masking.mask_all(name).alias("x"), masking.mask_report(name).alias("r")).first()
        assert row.x == "[REDACTED_EMAIL] [REDACTED_CREDIT_CARD]"
        assert row.r.pii_detected and row.r.original_length == 27


def test_single_passes_leave_other_data(value_of):
    text = "a@b.com 4111 1111 1111 1111 ABCDE1234F"
    assert value_of(masking.mask_email, [text]) == ["[REDACTED_EMAIL] 4111 1111 1111 1111 ABCDE1234F"]
    assert value_of(masking.mask_card, [text]) == ["a@b.com [REDACTED_CREDIT_CARD] ABCDE1234F"]
    assert value_of(masking.mask_pan, [text]) == ["a@b.com 4111 1111 1111 1111 [REDACTED_PAN]"]


def test_several_cards_keep_the_invalid_one(value_of):
    text = "4111111111111111, 4111111111111112, 5500000000000004"
    assert value_of(masking.mask_card, [text]) == [
        "[REDACTED_CREDIT_CARD], 4111111111111112, [REDACTED_CREDIT_CARD]"
    ]


def _luhn(text):
    digits = [int(c) for c in text if c in "0123456789"]
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return bool(digits) and total % 10 == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("0123456789- a", max_size=24), min_size=40, max_size=80))
def test_luhn_against_brute_force(value_of, texts):
    assert value_of(masking.luhn_valid, texts) == [_luhn(t) for t in texts]


def test_report_of_blank_text_has_zero_lengths(spark):
    df = spark.createDataFrame([("   ",), ("\n ",), (None,), ("call +91-9876543210",)], "text string")
    rows = mask_documents(df).collect()
    for row in rows[:3]:
        assert (row.pii_detected, row.original_length, row.scrubbed_length, row.redaction_tags_used) == (False, 0, 0, [])
    assert rows[0].scrubbed_text == "   "
    assert rows[3].redaction_tags_used == ["[REDACTED_PHONE]"]
    assert (rows[3].original_length, rows[3].scrubbed_length) == (19, 21)


def test_tags_already_in_the_text_are_listed_once(value_of):
    tags = value_of(masking.tags_used, ["[REDACTED_PAN] [REDACTED_PAN] [REDACTED_ABC]", "none"])
    assert tags == [["[REDACTED_ABC]", "[REDACTED_PAN]"], []]


def test_sql_function_equals_column(spark):
    name = sql_functions.register_redact_pii(spark)
    df = spark.createDataFrame([(c[0],) for c in CASES], "text string")
    both = df.select(F.expr(f"{name}(text)").alias("a"), masking.mask_all("text").alias("b")).collect()
    assert all(r.a == r.b for r in both)


@pytest.mark.parametrize("table,column", [("documents", "text"), ("pages", "html")])
def test_masking_twice_changes_nothing_and_no_card_is_left(spark, table, column):
    df = spark.read.parquet(f"{SF}/{table}.parquet").select(F.col(column).alias("text"))
    once = df.select(masking.mask_all("text").alias("once")).cache()
    assert once.where(masking.mask_all("once") != F.col("once")).count() == 0
    left = once.select(F.explode(F.regexp_extract_all("once", F.lit(V.CARD), F.lit(0))).alias("card"))
    assert left.where(masking.luhn_valid("card")).count() == 0


def test_shortcut_never_skips_a_match(spark):
    """The six passes one after the other give what the guarded expression gives."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    steps = df
    for function in (masking.mask_email, masking.mask_card, masking.mask_aadhaar,
                     masking.mask_pan, masking.mask_gstin, masking.mask_phone):
        steps = steps.select(function("text").alias("text"))
    guarded = df.select(masking.mask_all("text").alias("text"))
    assert guarded.exceptAll(steps).count() == 0 and steps.exceptAll(guarded).count() == 0


def test_no_python_in_the_masking_plan(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    plan = df.select(masking.mask_report("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_profile_counts_documents_per_tag(spark):
    df = spark.createDataFrame([("a@b.com c@d.org",), ("a@b.com",), ("nothing",)], "text string")
    rows = {r.tag: r for r in redaction_profile(df).collect()}
    assert set(rows) == {"[REDACTED_EMAIL]"}
    assert rows["[REDACTED_EMAIL]"].documents == 2


def test_profile_adds_up_to_what_masking_removed(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES] + [("a@b.com 4111 1111 1111 1111 and +91-9876543210",), ("  ",)], "text string")
    per_tag = redaction_profile(df).agg(F.sum("chars_removed")).first()[0]
    masked = mask_documents(df).agg(F.sum(F.col("original_length") - F.col("scrubbed_length"))).first()[0]
    assert per_tag == masked != 0


def test_profile_masks_every_text_once(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    spark.conf.set("spark.sql.maxPlanStringLength", "1000000")
    once = mask_documents(df)._jdf.queryExecution().executedPlan().toString()
    profile = redaction_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert profile.count("{13,18}") == once.count("{13,18}") > 0
