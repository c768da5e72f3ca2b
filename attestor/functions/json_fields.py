"""JSON in model output: find the object, then read its fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.text import strip
from attestor.session import bind, column


def _one_object(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON object, else null.

    The parser stops at the end of the first value; wrapping the text in an array inside
    an object turns trailing content into a syntax error or a second element.
    """
    def only_element(v: Column) -> Column:
        return F.when(
            F.try_variant_get(v, "$.v[1]", "variant").isNull(),
            F.try_variant_get(v, "$.v[0]", "variant"),
        )

    wrapped = F.try_parse_json(F.concat(F.lit('{"v":['), text, F.lit("]}")))
    return F.when(text.startswith("{") & text.endswith("}"), bind(wrapped, only_element))


def unfenced(text: Column | str) -> Column:
    """Stripped text without the opening code-fence line and the closing fence."""

    def peel(t: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(t, r"\A```[^\n]*\n", "\n"), r"```\z", "")
        return F.when(t.startswith("```"), strip(body)).otherwise(t)

    return bind(strip(text), peel)


def _braced(text: Column) -> Column:
    """The part from the first ``{`` to the last ``}``, or an empty text; one look from either end."""
    first = F.locate("{", text)
    behind = F.length(F.substring_index(text, "}", -1))
    return F.when(first > 0, text.substr(first, F.length(text) - behind - first + 1)).otherwise(F.lit(""))


def extract_json(text: Column | str) -> Column:
    """VARIANT of the JSON object in a model answer: the whole answer, or else the part from
    the first ``{`` to the last ``}``; null where neither parses. A whole answer that is an object
    is that part, so it is parsed once also where it is broken."""
    return bind(bind(unfenced(column(text)), _braced), _one_object)


def _fields(answer: Column | str, kinds: dict[str, str]) -> Column:
    """Struct of typed fields; the answer is parsed once, not once per field. Fields of an answer that
    is given as a column's name are read only if they are used."""

    def fields(v: Column) -> Column:
        return F.struct(*[F.try_variant_get(v, f"$.{n}", k).alias(n) for n, k in kinds.items()])

    return fields(F.col(answer)) if isinstance(answer, str) else bind(answer, fields)


def triage_fields(answer: Column | str) -> Column:
    return _fields(answer, {"doc_type": "string", "confidence": "double", "reasoning": "string"})


def audit_fields(answer: Column | str) -> Column:
    return _fields(answer, {
        "status": "string",
        "severity": "string",
        "compliance_score": "int",
        "violations": "array<string>",
        "recommendations": "array<string>",
    })
