"""The definition of a pipeline, as frozen dataclasses with a JSON form."""

from __future__ import annotations

import json
import dataclasses
from dataclasses import asdict, dataclass

from rowmill.functions.locales import locale

# fixed values: names of rules, operators and configuration keys
TRANSFORMATIONS = ("Trim", "ToUpper", "ToLower", "ConvertToString", "ConvertToInteger", "ConvertToDecimal", "ConvertToDate", "SetDefaultValue", "FilterRow", "FindAndReplace", "Deduplicate")
VALIDATIONS = ("Required", "EmailFormat", "NumericRange", "TextLengthRange", "DateRange", "UpsertKeyRequired")
OPERATORS = ("Equals", "NotEquals", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual")
#: Configuration keys that a rule needs, and those it may have.
NEEDED = {"FilterRow": ("Operator", "Value"), "FindAndReplace": ("Find", "Replace"), "SetDefaultValue": ("Value",), "Deduplicate": ("Fields",)}
BOUNDS = ("NumericRange", "TextLengthRange", "DateRange")


@dataclass(frozen=True)
class SourceOptions:
    culture: str = ""
    date_format: str | None = None
    delimiter: str = ","
    worksheet: str | None = None
    header: bool = True

    def __post_init__(self):
        locale(self.culture)
        if self.delimiter not in (",", ";", "\t"):
            raise ValueError("The delimiter must be a comma, a semicolon or a tab.")


@dataclass(frozen=True)
class FieldMapping:
    source: str
    target: str
    included: bool = True


@dataclass(frozen=True)
class Transformation:
    type: str
    order: int
    field: str | None = None
    config: dict[str, object] = dataclasses.field(default_factory=dict)
    id: str | None = None

    def __post_init__(self):
        if self.type not in TRANSFORMATIONS:
            raise ValueError(f"The transformation type '{self.type}' is not supported.")
        if (self.type == "Deduplicate") == bool(self.field):
            raise ValueError(f"A {self.type} rule {'takes its fields from Fields' if self.field else 'needs a field'}.")
        for key in NEEDED.get(self.type, ()):
            if key not in self.config:
                raise ValueError(f"A {self.type} rule needs the configuration value '{key}'.")
        if self.type == "FilterRow" and self.config["Operator"] not in OPERATORS:
            raise ValueError(f"The filter operator '{self.config['Operator']}' is not supported.")
        if self.type == "FindAndReplace" and not self.config["Find"]:
            raise ValueError("A FindAndReplace rule needs a text to find.")
        if self.type == "Deduplicate":
            fields = list(self.config["Fields"])
            if not fields or len(set(fields)) < len(fields):
                raise ValueError("A Deduplicate rule needs one field or more, each once.")


@dataclass(frozen=True)
class Validation:
    type: str
    field: str
    config: dict[str, object] = dataclasses.field(default_factory=dict)
    message: str | None = None
    id: str | None = None

    def __post_init__(self):
        if self.type not in VALIDATIONS:
            raise ValueError(f"The validation type '{self.type}' is not supported.")
        if self.type in BOUNDS and not {"Minimum", "Maximum"} & set(self.config):
            raise ValueError(f"A {self.type} rule needs 'Minimum' or 'Maximum'.")


@dataclass(frozen=True)
class Pipeline:
    name: str
    schema: tuple[tuple[str, str], ...]
    mappings: tuple[FieldMapping, ...]
    upsert_key: str
    transformations: tuple[Transformation, ...] = ()
    validations: tuple[Validation, ...] = ()
    options: SourceOptions = SourceOptions()
    decimal_scale: int = 10
    #: "typed": a field has one type at each step. "variant": each value has its own, decimals their own scale, and a row that fails keeps its values as they were.
    carrier: str = "typed"

    def __post_init__(self):
        if self.carrier not in ("typed", "variant"):
            raise ValueError("The carrier must be 'typed' or 'variant'.")
        orders = [t.order for t in self.transformations]
        if len(set(orders)) < len(orders):
            raise ValueError("Transformation rules need unique orders.")

    def steps(self) -> list[Transformation]:
        return sorted(self.transformations, key=lambda t: t.order)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Pipeline:
        d = json.loads(text)
        return Pipeline(
            name=d["name"],
            schema=tuple((a, b) for a, b in d["schema"]),
            mappings=tuple(FieldMapping(**m) for m in d["mappings"]),
            upsert_key=d["upsert_key"],
            transformations=tuple(Transformation(**t) for t in d["transformations"]),
            validations=tuple(Validation(**v) for v in d["validations"]),
            options=SourceOptions(**d["options"]),
            decimal_scale=d["decimal_scale"],
            carrier=d.get("carrier", "typed"),
        )


def reordered(rules: tuple[Transformation, ...], orders: list[int]) -> tuple[Transformation, ...]:
    """The rules with the orders 1..n in the given sequence of their present orders."""
    by = {t.order: t for t in rules}
    if sorted(orders) != sorted(by):
        raise ValueError("A new order must name every rule once.")
    return tuple(Transformation(by[o].type, i, by[o].field, by[o].config, by[o].id) for i, o in enumerate(orders, 1))
