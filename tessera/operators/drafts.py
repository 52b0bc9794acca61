"""Drafts of edits from bound models and given inputs, and what follows from requirement rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

FINITE = r"^[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"


def forward_chain(facts: DataFrame, needs: DataFrame, gives: DataFrame, by: str, max_rounds: int = 1_000) -> DataFrame:
    """``(by, fact, round)``: all that follows from ``facts (by, fact)``; given facts have round 0.

    A rule of ``needs (rule, need)`` gives its facts of ``gives (rule, fact)``
    once all its needs hold.  Each round looks only at rules that one of the
    last round's new facts touches, and keeps for each how many needs are met.
    """
    wanted = needs.distinct()
    size = wanted.groupBy("rule").agg(F.count("*").alias("_size"))
    fresh = cut(facts.select(by, "fact").where("fact is not null").distinct().withColumn("round", F.lit(0)), "facts")
    known, met = [fresh], None
    for k in range(1, max_rounds + 1):
        now = fresh.join(wanted.withColumnRenamed("need", "fact"), "fact").groupBy(by, "rule").agg(F.count("*").alias("_met"))
        if met is not None:
            old = met.join(now.select(by, "rule"), [by, "rule"], "left_semi")
            rest = met.join(now.select(by, "rule"), [by, "rule"], "left_anti")
            now = now.unionByName(old).groupBy(by, "rule").agg(F.sum("_met").alias("_met"))
            met = cut(now.withColumn("_new", F.lit(True)).unionByName(rest.withColumn("_new", F.lit(False))), "met")
        else:
            met = cut(now.withColumn("_new", F.lit(True)), "met")
        fired = met.where("_new").join(size, "rule").where("_met = _size").select(by, "rule")
        met = met.drop("_new")
        every = reduce(DataFrame.unionByName, known)
        fresh = cut(fired.join(gives, "rule").select(by, "fact").distinct().join(every, [by, "fact"], "left_anti").withColumn("round", F.lit(k)), "facts")
        if fresh.isEmpty():
            return every
        known.append(fresh)
    raise RuntimeError(f"facts go on after {max_rounds} rounds")


def missing_inputs(goals: DataFrame, known: DataFrame, needs: DataFrame, gives: DataFrame, by: str, max_rounds: int = 1_000) -> DataFrame:
    """``(by, goal, missing)``: facts that no rule gives and that a goal which does not hold would need, by any of its rules."""
    holds = known.select(by, "fact").distinct()
    front = cut(goals.select(by, F.col("fact").alias("goal"), "fact").distinct().join(holds, [by, "fact"], "left_anti"), "missing")
    seen, out = front, []
    for _ in range(max_rounds):
        out.append(front.join(gives.select("fact").distinct(), "fact", "left_anti").select(by, "goal", F.col("fact").alias("missing")))
        nxt = front.join(gives, "fact").join(needs, "rule").select(by, "goal", F.col("need").alias("fact")).distinct()
        front = cut(nxt.join(holds, [by, "fact"], "left_anti").join(seen, [by, "goal", "fact"], "left_anti"), "missing")
        if front.isEmpty():
            return reduce(DataFrame.unionByName, out).distinct()
        seen = cut(seen.unionByName(front), "missing-seen")
    raise RuntimeError(f"needs go on after {max_rounds} rounds")


def edit_drafts(bindings: DataFrame, inputs: DataFrame, values: DataFrame, existing: DataFrame, removals: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """``(by, status)`` of each request, and ``(by, place, path, entry, value)``: its edits where the status is ``draft_requires_review``.

    ``bindings (by, model, selector_path, selector_entry, path, scope, complete)``
    are the models that a request's selector may be bound to, ``path`` and
    ``scope`` where its coefficients stand; ``inputs (model, input, requirement,
    kind)`` what a model reads: ``required``, ``optional`` or ``conditional``, of a
    kind that is ``scalar`` or not; ``values (by, input, value)`` what was given;
    ``existing (path, entry)`` and ``removals (by, input)``.

    The edits are the selector, then the given inputs of the model by name, then
    removals, whose value is null.  The first reason that holds is the status:
    no binding or several, a schema that is not complete, an input with a
    condition, an input of another kind, an input without a value, a value that is
    no finite number, a removal of what is also set, a removal of what isn't there.
    Nothing is guessed: optional inputs without a value are left out.
    """
    one = bindings.groupBy(by).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in bindings.columns if c != by])).alias("_b"))
    bound = one.where("_n = 1").select(by, "_b.*")
    reads = bound.select(by, "model", "path", "scope").join(inputs, "model").join(values.select(by, "input", "value"), [by, "input"], "left")
    reads = cut(reads, "reads")
    gone = removals.select(by, "input").distinct().join(bound.select(by, "path", "scope"), by).withColumn("entry", F.concat_ws("/", "scope", "input"))
    there = existing.select("path", "entry", F.lit(True).alias("_there")).distinct()
    gone = cut(gone.join(there, ["path", "entry"], "left").join(reads.where("value is not null").select(by, "input", F.lit(True).alias("_set")), [by, "input"], "left"), "removals")
    required = F.col("requirement") == "required"
    used = F.col("value").isNotNull()
    found = reads.groupBy(by).agg(
        F.bool_or(F.col("requirement") == "conditional").alias("conditional"),
        F.bool_or((required | used) & ~F.col("kind").eqNullSafe("scalar")).alias("kind"),
        F.bool_or(required & ~used).alias("missing"),
        F.bool_or(used & ~F.col("value").rlike(FINITE)).alias("invalid"),
    )
    dropped = gone.groupBy(by).agg(F.bool_or(F.coalesce("_set", F.lit(False))).alias("conflict"), F.bool_or(F.col("_there").isNull()).alias("unbound"))
    asked = bindings.select(by).unionByName(values.select(by)).unionByName(removals.select(by)).distinct()
    all_ = asked.join(bound.select(by, "complete"), by, "left").join(found, by, "left").join(dropped, by, "left").join(one.select(by, "_n"), by, "left")
    status = (
        F.when(~F.col("_n").eqNullSafe(1), "ambiguous_or_missing_model_binding")
        .when(~F.coalesce("complete", F.lit(False)), "incomplete_source_schema")
        .when(F.col("conditional"), "unresolved_input_condition")
        .when(F.col("kind"), "unsupported_input_type")
        .when(F.col("missing"), "missing_inputs")
        .when(F.col("invalid"), "invalid_scalar_input")
        .when(F.col("conflict"), "conflicting_model_edits")
        .when(F.col("unbound"), "unbound_removal")
        .otherwise("draft_requires_review")
    )
    said = cut(all_.select(by, status.alias("status")), "drafts")
    fine = said.where("status = 'draft_requires_review'").select(by)
    first = bound.select(by, F.lit(0).alias("_kind"), F.col("selector_path").alias("path"), F.col("selector_entry").alias("entry"), F.col("model").alias("value"))
    sets = reads.where(used).select(by, F.lit(1).alias("_kind"), "path", F.concat_ws("/", "scope", "input").alias("entry"), "value")
    ends = gone.select(by, F.lit(2).alias("_kind"), "path", "entry", F.lit(None).cast("string").alias("value"))
    edits = first.unionByName(sets).unionByName(ends).join(fine, by)
    ranked = edits.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_kind", "entry", "path", "value"))).alias("_e"))
    return said, ranked.select(by, F.posexplode("_e").alias("place", "e")).select(by, "place", "e.path", "e.entry", "e.value")
