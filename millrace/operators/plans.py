"""Checks of plans and artifacts as joins and reason columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Predicates that artifacts may be checked by, by name: a column in, a reason or null out.
VALIDATORS: dict[str, Callable[[], Column]] = {}


def validator(name: str):
    """Register a function that returns a reason column: null where the row is valid."""

    def add(f: Callable[[], Column]):
        VALIDATORS[name] = f
        return f

    return add


def schema_reasons(schema: dict[str, dict]) -> Column:
    """An array of reasons why a row breaks ``schema``, by column name.

    A column's rules are of a JSON Schema: required, minimum, maximum, minLength, enum and pattern. A null breaks only
    ``required``, and then it is the column's only reason.
    """
    reasons = []
    for name, rules in sorted(schema.items()):
        c = F.col(name)
        if rules.get("required"):
            reasons.append(F.when(c.isNull(), f"{name}: missing"))
        if "minimum" in rules:
            reasons.append(F.when(c < rules["minimum"], f"{name}: less than {rules['minimum']}"))
        if "maximum" in rules:
            reasons.append(F.when(c > rules["maximum"], f"{name}: more than {rules['maximum']}"))
        if "minLength" in rules:
            reasons.append(F.when(F.length(c) < rules["minLength"], f"{name}: shorter than {rules['minLength']}"))
        if "enum" in rules:
            reasons.append(F.when(~c.isin(*rules["enum"]), f"{name}: not one of {', '.join(map(str, rules['enum']))}"))
        if "pattern" in rules:
            reasons.append(F.when(~c.rlike(rules["pattern"]), f"{name}: does not match"))
    return F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")


def validated(artifacts: DataFrame, key: str, schema: dict[str, dict], validators: tuple[str, ...] = (), present: Column | None = None) -> DataFrame:
    """key, ok and the reasons why not: a missing artifact has only that reason; otherwise the schema's come by column,
    then the named validators' in the given order. A validator that nobody registered is an error.
    """
    extra = F.array_compact(F.array(*[VALIDATORS[v]() for v in validators])) if validators else F.array().cast("array<string>")
    reasons = F.concat(schema_reasons(schema), extra)
    if present is not None:
        reasons = F.when(present, reasons).otherwise(F.array(F.lit("missing")))
    return artifacts.select(key, (F.size(reasons) == 0).alias("ok"), F.array_join(reasons, "; ").alias("reasons"))


def revalidated(nodes: DataFrame, produces: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every artifact of a finished step, judged anew: run_id, artifact, ok, reasons, exit_code of its run.

    ``nodes`` holds (run_id, step, status), ``produces`` (step, artifact), ``verdicts`` (run_id, artifact, ok, reasons);
    an artifact without a verdict is missing. A run's exit code is 3 if one fails, else 0.
    """
    due = nodes.filter("status = 'done'").join(produces, "step").select("run_id", "artifact")
    rows = due.join(verdicts, ["run_id", "artifact"], "left")
    rows = rows.withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("reasons", F.coalesce("reasons", F.lit("missing")))
    codes = rows.groupBy("run_id").agg(F.max(F.when(~F.col("ok"), 3).otherwise(0)).alias("exit_code"))
    return rows.join(codes, "run_id")


def unmet_needs(steps: DataFrame) -> DataFrame:
    """Needs (pipeline, step, needs) that nothing earlier produces; steps of one group run side by side, so a sibling is
    not earlier. A name's first group is an aggregate, so the join is by name alone.
    """
    first = steps.groupBy("pipeline", F.col("produces").alias("needs")).agg(F.min("grp").alias("_first"))
    rows = steps.join(first, ["pipeline", "needs"], "left")
    return rows.filter(F.col("_first").isNull() | (F.col("_first") >= F.col("grp"))).select("pipeline", "step", "needs")


def clashing_products(steps: DataFrame) -> DataFrame:
    """Names that more than one step of a group produces."""
    rows = steps.groupBy("pipeline", "grp", "produces").agg(F.count_distinct("step").alias("steps"))
    return rows.filter("steps > 1")


def with_dims(rows: DataFrame, presets: DataFrame, key: str) -> DataFrame:
    """``rows`` with their preset's columns; a key without preset ends the job and is named."""
    found = rows.join(presets.withColumn("_found", F.lit(True)), key, "left")
    known = F.when(F.col("_found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no preset for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(rows.schema[key].dataType))
    return found.withColumn(key, known).drop("_found")


def idempotent_runs(runs: DataFrame) -> DataFrame:
    """Of the runs with one key the one that counts: a completed run beats others, then the first name (key, run_id, status)."""
    order = F.struct((F.col("status") != "done").cast("int"), F.col("run_id"))
    best = runs.filter("key IS NOT NULL").groupBy("key").agg(F.min_by(F.struct("run_id", "status"), order).alias("b"))
    return best.select("key", "b.run_id", "b.status")

