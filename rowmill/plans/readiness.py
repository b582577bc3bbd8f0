"""What keeps a pipeline from running, all of it at once, before a plan is built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from rowmill.functions import dates, numbers
from rowmill.functions.locales import locale
from rowmill.operators import mapping, schema
from rowmill.operators.transformations import constant
from rowmill.operators.validations import broken
from rowmill.plans.spec import Pipeline, Transformation, Validation

# The components' names and the messages are fixed values.
Problem = tuple[str, str]


def problems(pipeline: Pipeline, source_fields: schema.Schema | None = None, target_columns: list[str] | None = None, key_problems: list[str] | None = None) -> list[Problem]:
    """(component, message) of everything that is wrong with the pipeline, its source's fields and its destination.

    key_problems: what sinks.upsert.key_problems finds wrong with the destination's key.
    """
    found: list[Problem] = []

    def tried(component: str, check: Callable[[], object]) -> bool:
        try:
            check()
        except (ValueError, OverflowError) as error:
            found.append((component, str(error)))
            return False
        return True

    names = [n for n, _ in pipeline.schema]
    if not names:
        found.append(("Schema", "The expected schema has no fields."))
    found += [("Schema", f"The expected source schema contains duplicate field '{n}'.") for n in sorted({n for n in names if names.count(n) > 1})]
    if source_fields is not None:
        tried("Source", lambda: schema.guard(list(pipeline.schema), source_fields, pipeline.mappings))
    targets: list[str] = []
    if tried("Mapping", lambda: mapping.active(pipeline.mappings, names)):
        targets = [m.target for m in mapping.active(pipeline.mappings, names)]
    if pipeline.options.date_format:
        tried("Source", lambda: dates.formats_of(pipeline.options.date_format, locale(pipeline.options.culture)))
    for rule in pipeline.steps():
        for field in rule.config["Fields"] if rule.type == "Deduplicate" else [rule.field]:
            if field not in targets:
                found.append(("Transformations", f"The rule field '{field}' of rule {rule.order} is not a mapped field."))
    for rule in pipeline.validations:
        if rule.field not in targets:
            found.append(("Validations", f"The rule field '{rule.field}' is not a mapped field."))
        if rule.type == "UpsertKeyRequired" and rule.field.strip() and rule.field != pipeline.upsert_key:
            found.append(("Validations", "The upsert-key validation rule must target the current pipeline upsert-key field."))
        tried("Validations", lambda rule=rule: _bounds(rule, pipeline))
    ids = [r.id for r in (*pipeline.transformations, *pipeline.validations) if r.id is not None]
    found += [("Transformations" if any(t.id == i for t in pipeline.transformations) else "Validations", f"The rule id '{i}' is used more than once.") for i in sorted({i for i in ids if ids.count(i) > 1})]
    for rule in pipeline.steps():
        tried("Transformations", lambda rule=rule: _configured(rule, pipeline))
    if not pipeline.options.header:
        found.append(("Source", "Sources without a header are not supported."))
    if pipeline.upsert_key not in targets:
        found.append(("UpsertKey", f"The upsert key field '{pipeline.upsert_key}' is not a mapped field."))
    if target_columns is not None:
        found += [("Destination", f"The destination has no column '{t}'.") for t in targets if t not in target_columns]
    found += [("Destination", p) for p in key_problems or ()]
    return found


def _configured(rule: Transformation, pipeline: Pipeline) -> None:
    """ValueError if a rule's configuration values can't be used. A filter's constant may be of any of the types that its field can have by then."""
    if rule.type in ("FilterRow", "SetDefaultValue") and (rule.config["Value"] is None or rule.type == "FilterRow" and not str(rule.config["Value"]).strip()):
        raise ValueError(f"The {rule.type} rule {rule.order} requires a non-empty 'Value' configuration value.")
    if rule.type == "FindAndReplace" and rule.config["Replace"] is None:
        raise ValueError(f"The {rule.type} rule {rule.order} requires a 'Replace' configuration value.")
    before = [r.type for r in pipeline.steps() if r.order < rule.order and r.field == rule.field and r.type.startswith("ConvertTo")]
    if rule.type == "FilterRow" and before[-1:] in (["ConvertToInteger"], ["ConvertToDecimal"]):
        try:
            numbers.parse(str(rule.config["Value"]), locale(pipeline.options.culture))
        except (ValueError, OverflowError):
            raise ValueError(f"The conditional filter comparison value of rule {rule.order} is not a valid number for culture '{locale(pipeline.options.culture).name}'.") from None
    if rule.type == "SetDefaultValue" and pipeline.carrier == "typed" and before:
        kind = {"ConvertToInteger": "bigint", "ConvertToDecimal": f"decimal(38,{pipeline.decimal_scale})", "ConvertToDate": "timestamp_ntz"}.get(before[-1])
        if kind:
            constant(str(rule.config["Value"]), kind)


def _bounds(rule: Validation, pipeline: Pipeline) -> None:
    kinds = {"NumericRange": "bigint", "TextLengthRange": "string", "DateRange": "timestamp_ntz"}
    broken(rule, F.lit(None).cast(kinds.get(rule.type, "string")), kinds.get(rule.type, "string"), pipeline.options)
