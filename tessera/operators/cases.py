"""Parameter tables, states and targets of cases, requirements, reviewed routes, pages and groups under a cap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import bound
from tessera.operators.choice import greedy_under_cap
from tessera.operators.ranges import numbered
from tessera.operators.structure import fenced
from tessera.session import cut

NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"


def parameter_rows(df: DataFrame, id: str, text: str = "text", named: tuple[str, ...] = ("variable", "entry")) -> DataFrame:
    """``(id, section, line, identifiers, defaults, requirements, raw)``: rows of Markdown tables of parameters, outside fences.

    Such a table has a name column (one of ``named``) first, a description, and a
    valid separator.  Names are those in back quotes, a plain word, or a symbol of one letter with an
    index; defaults and requirements are only those that the row itself states.
    """
    w = Window.partitionBy(id).orderBy("line")
    lines = df.select(id, F.explode(fenced(F.col(text))).alias("e")).select(id, "e.*")
    bar = ~F.col("code") & F.ltrim("text").startswith("|")
    heading = F.when(~F.col("code"), F.nullif(F.regexp_extract("text", r"^#{1,6}\s+(.*?)\s*#*\s*$", 1), F.lit("")))
    placed = lines.withColumns({"_bar": bar, "section": F.last(heading, ignorenulls=True).over(w), "_t": F.sum((~bar).cast("int")).over(w)}).where("_bar")
    t = Window.partitionBy(id, "_t").orderBy("line")
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"(?<!\\)\|", -1), lambda c: F.trim(c))
    rows = placed.withColumns({"_k": F.row_number().over(t), "_cells": cells})
    head = F.transform(F.first("_cells").over(t), F.lower)
    valid = F.max((F.col("_k") == 2) & F.forall("_cells", lambda c: c.rlike(r"^:?-+:?$"))).over(Window.partitionBy(id, "_t"))
    rows = rows.withColumns({"_head": head, "_valid": valid}).where(F.col("_valid") & (F.col("_k") > 2) & F.get("_head", F.lit(0)).isin(*named) & F.array_contains("_head", "description"))
    cell = lambda name: F.get("_cells", (F.array_position("_head", name) - 1).cast("int"))
    own, said = F.get("_cells", F.lit(0)), F.coalesce(cell("description"), F.lit(""))
    quoted = F.regexp_extract_all(own, F.lit(r"`([A-Za-z_][A-Za-z0-9_]*)`"), F.lit(1))
    symbol = r"^\$([A-Za-z])_(?:\{([A-Za-z0-9]+)\}|([A-Za-z0-9]))\$$"
    names = F.when(F.size(quoted) > 0, quoted).when(own.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.array(own)).when(own.rlike(symbol), F.array(F.regexp_replace(own, symbol, "$1$2$3")))
    column = lambda name, label: F.when((F.array_position("_head", name) > 0) & ~F.coalesce(cell(name), F.lit("")).isin("", "-"), F.array(F.concat(F.lit(label), cell(name))))
    none = F.array().cast("array<string>")
    defaults = F.concat(F.regexp_extract_all(said, F.lit(r"(?i)\(([^()]*\bdefault\b[^()]*)\)"), F.lit(1)), F.coalesce(column("default", "Default: "), none))
    required = F.concat(F.when(said.rlike(r"(?i)^required\b"), F.array(said)).otherwise(none), F.coalesce(column("required", "Required: "), none))
    return rows.select(id, "section", "line", F.coalesce(names, none).alias("identifiers"), defaults.alias("defaults"), required.alias("requirements"), F.col("text").alias("raw"))


def constant_state(observed: DataFrame, by: str, kind: str = "kind", value: str = "value") -> DataFrame:
    """``(by, n, state)`` of the constants of each case: one that isn't a constant or no finite number leaves all unknown.

    Otherwise ``positive_const_input`` where any is positive, ``negative_const_input`` where any is negative, else ``all_const_zero``.
    """
    number = F.when((F.col(kind) == "const") & F.trim(value).rlike(rf"^{NUMBER}$"), F.col(value).try_cast("double"))
    known = F.every(F.coalesce(number.isNotNull() & (F.abs(number) < float("inf")), F.lit(False)))
    state = F.when(~known, "unknown").when(F.bool_or(number > 0), "positive_const_input").when(F.bool_or(number < 0), "negative_const_input").otherwise("all_const_zero")
    return observed.groupBy(by).agg(F.count("*").alias("n"), state.alias("state"))


def attribute_targets(requests: DataFrame, observed: DataFrame, request: str, by: str, aliases: list[str], target: str = "target", value: str = "value") -> DataFrame:
    """``(request, status, target)``: which of a case's objects a request means by the value of an attribute.

    ``requests`` is ``(request, by, text)``, ``observed`` ``(by, target, value)``.  Requests that don't
    name the attribute, or only want it kept, have no row.  A comparison or two different values are
    ``unsupported_or_conflicting_predicate``; then a value that can't be read is
    ``unresolved_source``, and equal decimals, however spelt, decide between the rest.
    """
    name = "(?:" + "|".join(sorted((f"\\Q{a}\\E" for a in aliases), key=len, reverse=True)) + ")"
    said = rf"(?i){name}(?:\s*\(\s*{name}\s*\))?"
    clauses = F.split(F.coalesce("text", F.lit("")), r"[;；。，\n]|\.(?!\d)", -1)
    kept = lambda c: c.rlike(r"(?i)unchanged|保持") & ~c.rlike(r"(?i)\d|[<>=]|不是|大|小|高|低|\b(?:higher|lower|greater|less|not)\b")
    asks = F.array_join(F.filter(clauses, lambda c: ~kept(c)), ";")
    values = F.transform(F.regexp_extract_all("_a", F.lit(rf"{said}\s*(?:=|\bis\b|\bof\b|为)?\s*({NUMBER})"), F.lit(1)), lambda v: v.try_cast("decimal(38,18)"))
    asked = requests.withColumn("_a", asks).withColumns({"_n": F.regexp_count("_a", F.lit(said)), "_v": values}).where("_n > 0")
    clear = (F.size("_v") == F.col("_n")) & (F.size(F.array_distinct("_v")) == 1) & F.get("_v", F.lit(0)).isNotNull()
    asked = asked.select(request, by, F.when(clear, F.get("_v", F.lit(0))).alias("_w"))
    number = observed.select(by, F.col(target).alias("_t"), F.col(value).try_cast("decimal(38,18)").alias("_o"), F.lit(True).alias("_h"))
    met = asked.join(number, by, "left").groupBy(request, "_w").agg(
        F.bool_or(F.col("_h") & F.col("_o").isNull()).alias("_u"), F.count_if(F.col("_o") == F.col("_w")).alias("_n"), F.min(F.when(F.col("_o") == F.col("_w"), F.col("_t"))).alias("_t")
    )
    status = F.when(F.col("_w").isNull(), "unsupported_or_conflicting_predicate").when(F.col("_u"), "unresolved_source").when(F.col("_n") == 0, "no_match").when(F.col("_n") == 1, "unique").otherwise("ambiguous")
    return met.select(request, status.alias("status"), F.when(status == "unique", F.col("_t")).alias(target))


def requirements(asked: DataFrame, rules: DataFrame, files: DataFrame, by: str) -> DataFrame:
    """``(by, rule, n_required, n_present, met)``: what accepted rules ask of each case's files.

    ``asked`` is ``(by, rule)``, ``rules`` ``(rule, files, any, review)``, ``files`` ``(by, path)``.  With ``any``
    one file is enough.  Rules that no review accepted don't count; a rule without files is met.
    """
    wanted = asked.select(by, "rule").distinct().join(rules.where("review = 'accept'").select("rule", "files", "any"), "rule")
    each = wanted.select(by, "rule", "any", F.explode_outer("files").alias("path"))
    met = each.join(files.select(by, "path").distinct().withColumn("_p", F.lit(True)), [by, "path"], "left").groupBy(by, "rule", "any")
    n, p = F.count("path"), F.count("_p")
    return met.agg(n.alias("n_required"), p.alias("n_present")).select(by, "rule", "n_required", "n_present", F.when(F.col("any"), (F.col("n_present") > 0) | (F.col("n_required") == 0)).otherwise(F.col("n_present") == F.col("n_required")).alias("met"))


def reviewed_paths(starts: DataFrame, edges: DataFrame, relations: list[str] | None = None, max_depth: int = 30) -> DataFrame:
    """``(source, target, hops, path)``: the shortest way from each start to all it reaches over accepted edges.

    ``starts`` is ``(source)``, ``edges`` ``(source, target, relation, review)``; of equally short ways the least by its
    nodes counts.  Each round writes what it found, so plans don't grow; cycles end
    since a node is reached once.
    """
    steps = edges.where("review = 'accept'")
    steps = cut((steps if relations is None else steps.where(F.col("relation").isin(*relations))).select(F.col("source").alias("_from"), F.col("target").alias("_to")).distinct())
    front = cut(starts.select("source").distinct().select("source", F.col("source").alias("target"), F.lit(0).alias("hops"), F.array("source").alias("path")))
    done = [front]
    for hop in range(1, max_depth + 1):
        reached = reduce(DataFrame.unionByName, done).select("source", "target")
        ways = front.join(steps, F.col("target") == F.col("_from")).groupBy("source", "_to").agg(F.min("path").alias("path"))
        fresh = ways.select("source", F.col("_to").alias("target"), F.lit(hop).alias("hops"), F.concat("path", F.array("_to")).alias("path"))
        front = cut(fresh.join(reached, ["source", "target"], "left_anti"))
        if front.isEmpty():
            return reduce(DataFrame.unionByName, done)
        done.append(front)
    raise RuntimeError(f"ways go on after {max_depth} hops")


def page(items: DataFrame, by: str, place: str, size: str, offset: Column, cap: int) -> DataFrame:
    """``(by, n_items, chars, next_offset, status)``: the items from ``offset`` (0 is the first place) that fit ``cap`` in order.

    No item is skipped: where the first doesn't fit the page is empty, ``next_offset`` stays and the status says so.
    """
    rest = items.where(F.col(place) >= offset).withColumn("_o", offset)
    w = Window.partitionBy(by).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    spent = rest.withColumn("_s", F.sum(size).over(w))
    fits = F.col("_s") <= cap
    page_ = spent.groupBy(by).agg(F.count_if(fits).alias("n_items"), F.coalesce(F.max(F.when(fits, F.col("_s"))), F.lit(0)).alias("chars"), F.min(F.when(~fits, F.col(place))).alias("next_offset"))
    return page_.withColumn("status", F.when(F.col("n_items") == 0, "budget_too_small_for_first_item").otherwise("ok"))


def atomic_groups(groups: DataFrame, by: str, group: str, rank: str, size: str, cap: int, protected: Column | None = None, seen: DataFrame | None = None) -> DataFrame:
    """``(by, group, chars)``: whole groups taken greedily, protected ones first, then by rank, while they fit ``cap``.

    A group that doesn't fit is passed over; what follows is still tried, however
    many groups a request has.  Groups of ``seen (by, group)`` are left out.
    """
    fresh = groups if seen is None else groups.join(seen.select(by, group), [by, group], "left_anti")
    first = F.lit(0) if protected is None else F.when(F.coalesce(protected, F.lit(False)), 0).otherwise(1)
    rows = fresh.select(by, group, F.col(size).cast("long").alias("chars"), first.alias("_later"), F.col(rank).alias("_rank"))
    placed = numbered(rows, ["_later", "_rank", group], [by], "_place")
    return greedy_under_cap(placed, [by], "_place", "chars", cap).select(by, group, "chars")


def selected_coefficients(entries: DataFrame, by: str, suffix: str = "Coeffs") -> DataFrame:
    """``(by, selector, coefficient)``: entries of the block that a selector in the same scope names by its value.

    ``entries`` is ``(by, path, value)`` with paths of keys joined by ``/``.
    """
    scope = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    selectors = entries.select(by, F.col("path").alias("selector"), F.concat(scope, "value", F.lit(f"{suffix}/")).alias("_b"))
    return entries.select(by, F.col("path").alias("coefficient"), scope.alias("_b")).join(selectors, [by, "_b"]).select(by, "selector", "coefficient")


def closed(edges: DataFrame, nodes: DataFrame, node: str, source: str = "source", target: str = "target") -> DataFrame:
    """Edges of which both ends are among ``nodes``."""
    ends = lambda name: nodes.select(F.col(node).alias(name)).distinct()
    return edges.join(ends(source), source, "left_semi").join(ends(target), target, "left_semi").select(*edges.columns)


def binding(bound_: DataFrame, found: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """``(key, issue)``: where what was found departs from what a protocol is bound to: ``missing``, ``unbound`` or ``changed``."""
    a, b = bound_.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_l")), found.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_r"))
    issue = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "unbound").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full").select(key, issue.alias("issue")).where("issue is not null")


def benchmark_totals(runs: DataFrame, passed: Column, *by: str) -> DataFrame:
    """The counts of a benchmark's report and its pass rate, for each of ``by``.

    ``runs`` has ``dry_run, exit_code, timed_out, physics_report, execution_report, execution_status``; nulls count as false.
    """
    n = F.count_if
    held = n(F.coalesce(passed, F.lit(False)))
    return runs.groupBy(*by).agg(
        F.count("*").alias("cases_total"),
        n(~F.coalesce("dry_run", F.lit(False))).alias("cases_executed"),
        n(F.col("exit_code") == 0).alias("exit_code_zero"),
        n(F.col("timed_out")).alias("timed_out"),
        n(F.col("physics_report")).alias("physics_reports"),
        n(F.col("execution_report")).alias("execution_reports"),
        n(F.col("execution_status")).alias("execution_status_files"),
        held.alias("benchmark_passed"),
        F.coalesce(F.round(held / F.nullif(F.count("*"), F.lit(0)), 6), F.lit(0.0)).alias("benchmark_pass_rate"),
    )


def usage_totals(sessions: DataFrame, usage: str, *by: str) -> DataFrame:
    """``(by, key, n, total, cost)``: numbers of JSON maps summed by key; booleans and texts don't count, and no price is assumed."""
    members = sessions.select(*by, F.explode(F.from_json(usage, "map<string,string>")).alias("key", "_v"))
    number = bound(F.col("_v"), lambda v: F.when(v.rlike(rf"^{NUMBER}$"), v.try_cast("double")))
    return members.withColumn("_n", number).where("_n is not null").groupBy(*by, "key").agg(F.count("*").alias("n"), F.sum("_n").alias("total")).withColumn("cost", F.lit(None).cast("double"))
