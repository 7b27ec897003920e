"""Typed contracts of JSON documents: what each field has to be, as data, and one evaluator over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetlens.functions.text import concat_all, no_strings

#: Kinds of a field: a text, a text or null, a list of texts, or a list of objects with fields of their own.
TEXT, TEXT_OR_NULL, TEXTS = "string", "string or null", "list of strings"


def items(required: dict[str, str], optional: dict[str, str] | None = None) -> tuple:
    """A list of objects."""
    return required, optional or {}


#: What an external model has to return. Further fields are ignored.
ONBOARDING = (
    ("project_overview", TEXT),
    ("tech_stack", items({"name": TEXT, "role": TEXT}, {"category": TEXT_OR_NULL})),
    ("architecture", TEXT),
    ("important_files", items({"path": TEXT, "purpose": TEXT})),
    ("dependencies", items({"name": TEXT, "purpose": TEXT})),
    ("setup_guide", TEXTS),
    ("development_workflow", TEXTS),
    ("starter_tasks", TEXTS),
    ("data_completeness_notes", TEXTS),
)


def kind(v: Column) -> Column:
    """JSON kind of a VARIANT that is there: STRING, BIGINT, ARRAY…, OBJECT…; VOID for a null."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _members(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _reason(where, what: str) -> Column:
    return F.concat(where if isinstance(where, Column) else F.lit(where), F.lit(f": {what}"))


def _text_problem(v: Column, where, wanted: str) -> Column:
    """Why ``v`` isn't ``wanted``, NULL when it is; a VARIANT that is absent is SQL NULL."""
    ok = kind(v) == "STRING"
    return F.when(~((ok | (kind(v) == "VOID")) if wanted == TEXT_OR_NULL else ok), _reason(where, "not a string"))


def _list_problems(v: Column, where: str, member) -> Column:
    """Problems of a list: that it is none, or those that ``member(element, place)`` lists for every element."""
    listed = F.startswith(kind(v), F.lit("ARRAY"))
    inner = F.flatten(F.transform(_members(v), lambda e, i: member(
        e, F.concat(F.lit(f"{where}["), i.cast("string"), F.lit("]")))))
    return F.when(listed, inner).otherwise(F.array(_reason(where, "not a list")))


def _object_problems(e: Column, place: Column, fields) -> Column:
    required, optional = fields
    checks = []
    for name, wanted in {**required, **optional}.items():
        v, where = _field(e, name), F.concat(place, F.lit(f".{name}"))
        absent = F.when(F.lit(name in required), _reason(where, "missing"))
        checks.append(F.when(v.isNull(), absent).otherwise(_text_problem(v, where, wanted)))
    return F.when(F.startswith(kind(e), F.lit("OBJECT")), F.array(*checks)).otherwise(F.array(_reason(place, "not an object")))


def problems(document: Column, contract=ONBOARDING) -> Column:
    """``ARRAY<STRING>``: every way in which a VARIANT document breaks the contract; empty when it keeps it."""
    found = []
    for name, wanted in contract:
        v = _field(document, name)
        if wanted in (TEXT, TEXT_OR_NULL):
            own = F.array(_text_problem(v, name, wanted))
        elif wanted == TEXTS:
            own = _list_problems(v, name, lambda e, place: F.array(_text_problem(e, place, TEXT)))
        else:
            own = _objects(v, name, wanted)
        found.append(F.when(v.isNull(), F.array(F.lit(f"{name}: missing"))).otherwise(own))
    every = F.filter(concat_all(*found), lambda p: p.isNotNull())
    return F.when(F.startswith(kind(document), F.lit("OBJECT")), F.coalesce(every, no_strings())) \
        .otherwise(F.array(F.lit("not a JSON object")))


def _objects(v: Column, name: str, fields) -> Column:
    def member(e, place):
        return _object_problems(e, place, fields)

    return _list_problems(v, name, member)
