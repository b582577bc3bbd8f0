"""Compiles a pipeline and a source DataFrame to one plan in which every source row ends with one status.

Rules run in order on all rows at once. A row's first event (an error or a filter) ends it: later steps leave its
fields as they were. Duplicates depend on which earlier rows ended valid, so they are found last, from the keys
as they stood at each Deduplicate step.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions import variants
from rowmill.functions.text import has_value
from rowmill.operators import deduplicate, mapping
from rowmill.operators.transformations import transform
from rowmill.operators.validations import broken
from rowmill.plans.spec import Pipeline
from rowmill.plans.state import cut

ERROR = "struct<stage:string,field:string,message:string,rule_id:string,transformation_type:string>"
EVENT = "struct<step:int,status:string,error:" + ERROR + ">"
ROW = "__n"
#: Keys (rule, key) that are taken, or a function of the keys at hand that gives them.
Taken = DataFrame | Callable[[DataFrame], DataFrame | None] | None


def _error(stage: str, field: str, message: Column, rule_id: str | None, kind: str | None) -> Column:
    return F.struct(F.lit(stage).alias("stage"), F.lit(field).alias("field"), message.alias("message"), F.lit(rule_id).cast("string").alias("rule_id"), F.lit(kind).cast("string").alias("transformation_type"))


class Compiler:
    """One compilation; `rows` is the DataFrame built so far, `columns` and `kinds` the fields' columns and types in it."""

    def __init__(self, source: DataFrame, pipeline: Pipeline, row_number: str):
        self.pipeline = pipeline
        used = mapping.active(pipeline.mappings, [name for name, _ in pipeline.schema])
        missing = [name for name, _ in pipeline.schema if name not in source.columns]
        if missing:
            raise ValueError(f"The source lacks the fields {missing}.")
        self.fields = [m.target for m in used]
        if pipeline.upsert_key not in self.fields:
            raise ValueError(f"The upsert key field '{pipeline.upsert_key}' is not a mapped field.")
        kinds = dict(source.dtypes)
        own = pipeline.carrier == "variant"
        self.kinds = {m.target: "variant" if own else kinds[m.source] for m in used}
        self.columns = {m.target: f"__f{i}" for i, m in enumerate(used)}
        self.rows = source.select(
            mapping.quoted(row_number).cast("long").alias(ROW),
            F.struct(*(mapping.quoted(name).alias(name) for name, _ in pipeline.schema)).alias("__source"),
            *((variants.carried(mapping.quoted(m.source), kinds[m.source]) if own else mapping.quoted(m.source)).alias(self.columns[m.target]) for m in used),
            F.lit(None).cast(EVENT).alias("__event"),
        )
        #: Columns of expressions that a step uses more than once.
        self.kept: list[str] = []
        #: Of each Deduplicate rule: its step, key column, and the fields as they were (by columns of their own if they change later).
        self.keys: list[tuple[int, str, dict[str, tuple[str, str]]]] = []

    def run_steps(self) -> None:
        live = F.col("__event").isNull()
        for step, rule in enumerate(self.pipeline.steps()):
            if rule.type == "Deduplicate":
                for name in rule.config["Fields"]:
                    self._known(name)
                key = f"__k{len(self.keys)}"
                self.rows = self.rows.withColumn(key, F.when(live, F.struct(*(self._part(n).alias(f"v{i}") for i, n in enumerate(rule.config["Fields"])))))
                self.keys.append((step, key, {n: (self.columns[n], self.kinds[n]) for n in self.fields}))
                continue
            self._known(rule.field)
            column, kind = self.columns[rule.field], self.kinds[rule.field]
            out = transform(rule, F.col(column), kind, self.pipeline.options, self.pipeline.decimal_scale, self._keep)
            event = F.lit(None).cast(EVENT)
            if out.drop is not None:
                event = F.when(F.coalesce(out.drop, F.lit(False)), F.struct(F.lit(step).alias("step"), F.lit("Filtered").alias("status"), F.lit(None).cast(ERROR).alias("error")))
            where = F.concat(F.lit(f"{out.subject} '{rule.field}' in row "), F.col(ROW).cast("string"))
            for bad, message in reversed(out.errors):
                failed = F.struct(F.lit(step).alias("step"), F.lit("Invalid").alias("status"), _error("Transformation", rule.field, F.concat(where, F.lit(message)), rule.id, rule.type).alias("error"))
                event = F.when(bad, failed).otherwise(event)
            changes = rule.type != "FilterRow"
            new = f"__v{step}"
            if changes:
                old = F.col(column) if out.kind == kind else F.lit(None).cast(out.kind)
                self.rows = self.rows.withColumn("__step", F.when(live, event)).withColumn(new, F.when(live & F.col("__step").isNull(), out.value).otherwise(old))
                self.columns[rule.field], self.kinds[rule.field] = new, out.kind
            else:
                self.rows = self.rows.withColumn("__step", F.when(live, event))
            self.rows = self.rows.withColumn("__event", F.coalesce("__event", "__step")).drop("__step", *self.kept)

    def _keep(self, expression: Column) -> Column:
        name = f"__x{len(self.kept)}"
        self.kept.append(name)
        self.rows = self.rows.withColumn(name, F.when(F.col("__event").isNull(), expression))
        return F.col(name)

    def _part(self, name: str) -> Column:
        """A field's value as part of a key."""
        c = F.col(self.columns[name])
        return variants.identity(c, by_value=False) if self.kinds[name] == "variant" else c

    def _known(self, name: str | None) -> None:
        if name not in self.columns:
            raise ValueError(f"The rule field '{name}' is not a mapped field.")

    def validate(self) -> None:
        """Adds __errors (in rule order, then that of a missing key) and __key (null: unusable)."""
        checks = []
        for rule in self.pipeline.validations:
            self._known(rule.field)
            bad, message = broken(rule, F.col(self.columns[rule.field]), self.kinds[rule.field], self.pipeline.options)
            checks.append(F.when(bad, _error("Validation", rule.field, message, rule.id, None)))
        found = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast(f"array<{ERROR}>")
        key = self.pipeline.upsert_key
        c, kind = F.col(self.columns[key]), self.kinds[key]
        present = has_value(c, kind == "string") if kind != "variant" else c.isNotNull() & F.coalesce(has_value(variants.as_type(c, "string"), True), ~variants.is_type(c, "string"))
        identity = F.when(present, deduplicate.upsert_identity(c, kind))
        self.rows = self.rows.withColumns({"__found": found, "__key": identity})
        missing = _error("Validation", key, F.lit(f"Upsert key field '{key}' is required."), None, None)
        odd = _error("Validation", key, F.concat(F.lit(f"Upsert key field '{key}' in row "), F.col(ROW).cast("string"), F.lit(f" has unsupported value type '{kind}'.")), None, None)
        lone = F.when(~present, F.array(missing)).when(F.col("__key").isNull(), F.array(odd)).otherwise(F.array().cast(f"array<{ERROR}>"))
        self.rows = self.rows.withColumn("__errors", F.when(F.col("__event").isNotNull(), F.array(F.col("__event.error"))).when(F.size("__found") > 0, F.col("__found")).otherwise(lone)).drop("__found")

    def finish(self, taken: Taken = None, with_keys: bool = False, with_source: bool = True) -> DataFrame:
        # Owners and statuses both read the judged rows, so these are written once; the table also keeps the optimiser
        # from pushing the filter for candidates down through all steps, which would repeat each step's expression in the next.
        rows = self.rows
        names = [key for _, key, _ in self.keys] + ["__key"]
        met = F.lit(False)
        needed = [ROW, *(["__source"] if with_source else []), "__event", "__errors", "__key", *(key for _, key, _ in self.keys)]
        needed += sorted({*self.columns.values(), *(column for _, _, kept in self.keys for column, _ in kept.values())})
        if callable(taken):
            # what is taken is looked up by the batch's own keys, which are written first
            rows = cut(rows.select(*needed), "keyed")
            own = [rows.select(F.lit(i).alias("rule"), key_text(F.col(name)).alias("key")) for i, name in enumerate(names)]
            taken = taken(reduce(DataFrame.union, own))
        if taken is not None:
            # keys that earlier batches accepted: rows that meet one are duplicates where they meet it, and take no key themselves
            for i, name in enumerate(names):
                known = taken.where(F.col("rule") == i).select(F.col("key").alias("__own"), F.lit(True).alias(f"__met{name}")).distinct()
                rows = rows.join(known, key_text(F.col(name)) == known["__own"], "left").drop("__own")
                met = met | F.coalesce(F.col(f"__met{name}"), F.lit(False))
        needed += [c for c in rows.columns if c.startswith("__met")]
        rows = cut(rows.select(*needed).withColumn("__candidate", F.col("__event").isNull() & (F.size("__errors") == 0) & ~met), "judged")
        candidates = rows.where("__candidate")
        same_as_key = all(set(kept) and self._is_upsert_key(step, kept) for step, _, kept in self.keys)
        if all(self._is_upsert_key(step, kept) for step, _, kept in self.keys):
            # one key: the same text at every step, so one aggregate and one join serve all of them
            raw = self.columns[self.pipeline.upsert_key] if self.keys else "__key"
            rows = self._with_owner(rows, raw, deduplicate.owners_of_one(rows, raw, ROW, "__candidate").withColumnRenamed("key", "__key"), "__key")
            rows = rows.withColumns({f"__o{key}": F.when(F.col(key).isNotNull(), F.col("__o__key")) for _, key, _ in self.keys})
        else:
            for name, owner in zip(names, deduplicate.owners_of_many(candidates, names, ROW)):
                rows = self._with_owner(rows, name, owner, name)
        if taken is not None:
            rows = rows.withColumns({f"__o{n}": F.when(F.col(f"__met{n}"), F.lit(-(2**63))).otherwise(F.col(f"__o{n}")) for n in names})
        event_step = F.coalesce(F.col("__event.step"), F.lit(1 << 30))
        duplicate_at = F.lit(None).cast("int")
        for step, key, _ in reversed(self.keys):
            duplicate_at = F.when((F.col(f"__o{key}") < F.col(ROW)) & (event_step > step), F.lit(step)).otherwise(duplicate_at)
        rows = rows.withColumn("__duplicate_at", duplicate_at)
        is_duplicate = F.col("__duplicate_at").isNotNull()
        status = (
            F.when(is_duplicate, "Duplicate")
            .when(F.col("__event").isNotNull(), F.col("__event.status"))
            .when(F.size("__errors") > 0, "Invalid")
            .when(F.col("__o__key") < F.col(ROW), "Duplicate")
            .otherwise("Valid")
        )
        values = []
        for name in self.fields:
            value = F.col(self.columns[name])
            for step, _, kept in self.keys:
                column, kind = kept[name]
                if column != self.columns[name]:
                    as_it_was = F.col(column) if kind == self.kinds[name] else F.lit(None).cast(self.kinds[name])
                    value = F.when(F.col("__duplicate_at") == step, as_it_was).otherwise(value)
            values.append(value.alias(name))
        none = F.array().cast(f"array<{ERROR}>")
        errors = F.when(F.col("_status") == "Invalid", F.col("__errors")).otherwise(none)
        return rows.withColumn("_status", status).select(F.col(ROW).alias("_row_number"), "_status", errors.alias("_errors"), *([F.col("__source").alias("_source")] if with_source else []), *values, *([F.array(*(key_text(F.col(n)) for n in names)).alias("_keys")] if with_keys else []))

    def _is_upsert_key(self, step: int, kept: dict[str, tuple[str, str]]) -> bool:
        rule = self.pipeline.steps()[step]
        key = self.pipeline.upsert_key
        return list(rule.config["Fields"]) == [key] and kept[key][0] == self.columns[key] and self.kinds[key] == "string"

    def _with_owner(self, rows: DataFrame, on: str, owner: DataFrame, name: str) -> DataFrame:
        by = owner.select(F.col(name).alias("__own"), F.col("owner").alias(f"__o{name}"))
        return rows.join(by, rows[on] == by["__own"], "left").drop("__own")


def key_text(key: Column) -> Column:
    """A key as text that equal keys, and no others, share; null for none."""
    return F.when(key.isNotNull(), F.to_json(F.struct(key.alias("k")), {"ignoreNullFields": "false"}))


def compile_rows(source: DataFrame, pipeline: Pipeline, row_number: str, taken: Taken = None, with_keys: bool = False, with_source: bool = True) -> DataFrame:
    """The rows of a source with _row_number, _status, _errors, _source and the output fields.

    `row_number` names a column of unique numbers in source order. Statuses are Valid, Invalid, Filtered and
    Duplicate. Output fields hold the values as of the step that ended the row; a field whose type has changed by
    then is null in rows that failed before, unless the pipeline's carrier is "variant": then output fields are VARIANT, and each
    value has the type that it had (sinks.typing gives them the types of a target). `taken` has the keys that earlier batches of the run accepted (rule: number of
    the Deduplicate rule in order, then that of the upsert key; key: text), or is a function that gives those which the rows' own keys may meet; with_keys adds this batch's as _keys. with_source=False
    leaves out _source, which only error reports need, and so a second copy of all fields in what is written.
    """
    compiler = Compiler(source, pipeline, row_number)
    compiler.run_steps()
    compiler.validate()
    return compiler.finish(taken, with_keys, with_source)
