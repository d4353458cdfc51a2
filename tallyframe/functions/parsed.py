"""Answers of models and nested metadata read with error codes (survey C19, C27), and strict
forms of scores (D01, D05, D06, D11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import scores as S

#: A fence of code around an answer. Fixed value.
FENCE = r"^\s*```(?:json)?\s*|\s*```\s*$"


def strip_code_fence(text: Column) -> Column:
    """The text inside a fence, without white space at its edges."""
    return F.btrim(F.regexp_replace(text, FENCE, ""), F.lit(" \t\n\r\x0b\x0c"))


def parse_object(text: Column, fields: dict[str, str]) -> Column:
    """(value, errors) of an answer that should be a JSON object with ``fields`` (name to
    type): ``invalid_json``, ``schema_types`` if it is no object, ``missing:<field>``,
    ``type:<field>``. The value is a struct, null with any error."""
    clean = strip_code_fence(text)
    # The parser stops after a value; what may follow it fits neither of two wrappers.
    alone = F.try_parse_json(F.concat(F.lit("["), clean, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), clean, F.lit("}"))).isNotNull() & (clean != "")
    v = F.when(alone, F.try_parse_json(clean))
    kind = F.schema_of_variant(v)
    no_object = ~F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    value = {n: F.try_variant_get(v, f"$.{n}", t) for n, t in fields.items()}
    there = {n: F.coalesce(F.try_variant_get(v, f"$.{n}", "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(v, f"$.{n}", "variant")), F.lit(False)) for n in fields}
    of_fields = [F.when(~there[n], F.lit(f"missing:{n}")).when(value[n].isNull(), F.lit(f"type:{n}")) for n in fields]
    errors = F.when(v.isNull(), F.array(F.lit("invalid_json"))).when(no_object, F.array(F.lit("schema_types"))).otherwise(F.array_compact(F.array(*of_fields)))
    return F.struct(F.when(F.size(errors) == 0, F.struct(*(x.alias(n) for n, x in value.items()))).alias("value"), errors.alias("errors"))


def unwrap(text: Column, name: str) -> Column:
    """A JSON text taken out of objects that hold it under ``name``, however many are
    nested; as it is where none does."""
    wrap = F.lit(f'"{name}"')
    most = F.floor((F.length(text) - F.length(F.replace(text, wrap, F.lit("")))) / F.length(wrap)).cast("int")
    inner = lambda s: F.coalesce(F.get_json_object(s, f"$['{name}']"), s)
    return F.when(most > 0, F.aggregate(F.sequence(F.lit(1), most), text, lambda s, _: inner(s))).otherwise(text)


def strict_iou(a: Column, b: Column) -> Column:
    """As ``box_iou``, but boxes without any area between them fail the query."""
    area = lambda c: (F.element_at(c, 3) - F.element_at(c, 1)) * (F.element_at(c, 4) - F.element_at(c, 2))
    return F.when(area(a) + area(b) > 0, S.box_iou(a, b)).otherwise(F.raise_error(F.lit("boxes without area")))


def _unit(values: Column) -> Column:
    ok = (F.size(values) > 0) & F.forall(values, lambda x: F.coalesce(x.between(0, 1), F.lit(False)))
    return F.when(ok, values).otherwise(F.raise_error(F.lit("scores have to lie in [0, 1], one or more")))


def strict_softmin(values: Column, beta: float) -> Column:
    """As ``softmin``; no values, or one outside [0, 1], fails the query."""
    return S.softmin(_unit(values), beta)


def hard_min(values: Column) -> Column:
    """The least value, under the same condition."""
    return F.array_min(_unit(values))


def strict_cosine(a: Column, b: Column) -> Column:
    """As ``cosine``; a vector without length, or of another size, fails the query."""
    ok = (F.size(a) == F.size(b)) & (S.dot(a, a) > 0) & (S.dot(b, b) > 0)
    return F.when(ok, S.cosine(a, b)).otherwise(F.raise_error(F.lit("vectors have to be of one size and not zero")))


def pixel_threshold(height: Column, width: Column) -> Column:
    """Six pixels of a shorter side of 256."""
    return 6 * F.least(height, width) / 256.0


def effective_needed_frames(n: Column) -> Column:
    """``needed_frames``, one at least."""
    return F.greatest(F.lit(1), S.needed_frames(n))
