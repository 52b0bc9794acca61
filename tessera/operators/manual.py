"""Manuals: blocks that belong together, references between them, and which case entries they document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.structure import fenced

HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
NUMBER = r"[A-Z]?[0-9]+(?:\.[0-9]+)*"
#: How sections and formulas are referred to; what follows are one or several numbers.
TO_SECTION = rf"(?i)\b(?:sections?|sec\.|see)\s+({NUMBER}(?:\s*(?:,|and|&)\s*{NUMBER})*)"
TO_FORMULA = rf"(?i)\b(?:eqs?\.|equations?)\s*(\(?{NUMBER}\)?(?:\s*(?:,|and|&)\s*\(?{NUMBER}\)?)*)"
YEAR = r"^(?:19|20)[0-9]{2}$"


def manual_lines(df: DataFrame, id: str, text: str = "text") -> DataFrame:
    """``(id, line, text, kind, section)`` of lines that are not blank.

    Kinds are code (fences included), formula (between lines of ``$$``, these
    included, or a line that has both), heading, table, quote and text; ``section``
    counts the headings so far, 0 before the first.
    """
    each = df.select(id, F.explode(fenced(F.col(text))).alias("e")).select(id, "e.line", "e.text", "e.code")
    upto = Window.partitionBy(id).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    bare = F.regexp_replace("text", r"^\s+|\s+$", "")
    each = each.withColumns({"bare": bare, "mark": ~F.col("code") & (bare == "$$")})
    inside = F.sum(F.col("mark").cast("int")).over(upto) % 2 == 1
    whole = bare.startswith("$$") & bare.endswith("$$") & (F.length(bare) > 4)
    kind = (
        F.when(F.col("code"), "code")
        .when(F.col("mark") | inside | whole, "formula")
        .when(bare == "", None)
        .when(F.col("text").rlike(HEADING), "heading")
        .when(bare.startswith("|"), "table")
        .when(bare.startswith(">"), "quote")
        .otherwise("text")
    )
    told = each.withColumn("kind", kind)
    # the mark that ends a formula is even in number
    told = told.withColumn("opens", F.col("mark") & inside)
    section = F.sum(F.coalesce((F.col("kind") == "heading").cast("int"), F.lit(0))).over(upto)
    before = Window.partitionBy(id).orderBy("line")
    new = F.lag("kind").over(before).isNull() | (F.lag("kind").over(before) != F.col("kind")) | (F.col("kind") == "heading") | F.col("opens") | whole
    told = told.withColumns({"section": section, "new": new}).where("kind is not null")
    return told.withColumn("block", F.sum(F.col("new").cast("int")).over(upto)).select(id, "line", "text", "kind", "section", "block")


def manual_units(df: DataFrame, id: str, text: str = "text") -> DataFrame:
    """``(id, section, unit, start, end, kinds, number, text)``: what must be read together, as it stands in the text.

    A block is a run of lines of one kind.  A formula, its number ``(1.2)`` in a
    line of its own and the text that begins with "where" after it are one unit,
    with blank lines between them; all other blocks are units of their own.
    """
    lines_ = manual_lines(df, id, text)
    body = F.array_sort(F.collect_list(F.struct("line", "text")))
    blocks = lines_.where("kind <> 'heading'").groupBy(id, "section", "block").agg(F.min("line").alias("start"), F.max("line").alias("end"), F.first("kind").alias("kind"), body.alias("body"))
    only = F.when((F.size("body") == 1) & (F.col("kind") == "text"), F.regexp_extract(F.col("body")[0]["text"], rf"^\s*\(({NUMBER}[a-z]?)\)\s*$", 1)).otherwise("")
    blocks = blocks.withColumns({"no": only, "where": (F.col("kind") == "text") & F.col("body")[0]["text"].rlike(r"(?i)^\s*(?:where\b|其中)")})
    order = Window.partitionBy(id, "section").orderBy("block")
    formula = lambda k: F.coalesce(F.lag("kind", k).over(order) == "formula", F.lit(False))
    numbered = (F.col("no") != "") & formula(1)
    after_number = (F.lag("no").over(order) != "") & formula(2)
    bound = numbered | F.col("where") & (formula(1) | F.coalesce(after_number, F.lit(False)))
    named = blocks.withColumn("bound", bound)
    named = named.withColumn("unit", F.sum((~F.col("bound")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    units = named.groupBy(id, "section", "unit").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("start", "kind"))).alias("k"), F.max(F.when(F.col("bound") & (F.col("no") != ""), F.col("no"))).alias("number")
    )
    held = df.select(id, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("_l"))
    exact = F.array_join(F.slice("_l", F.col("start"), F.col("end") - F.col("start") + 1), "\n")
    return units.join(held, id).select(id, "section", "unit", "start", "end", F.transform("k", lambda x: x["kind"]).alias("kinds"), "number", exact.alias("text"))


def unclosed(df: DataFrame, id: str, text: str = "text") -> DataFrame:
    """``(id, what)``: texts in which a formula or a fence begins and does not end."""
    each = df.select(id, F.explode(fenced(F.col(text))).alias("e")).select(id, "e.line", "e.text", "e.code")
    marks = each.groupBy(id).agg((F.count_if(~F.col("code") & (F.trim("text") == "$$")) % 2 == 1).alias("odd"))
    run = F.col("line") - F.row_number().over(Window.partitionBy(id).orderBy("line"))
    fences = each.where("code").withColumn("run", run).groupBy(id, "run").agg(F.count("*").alias("n"), F.max_by("text", "line").alias("last"))
    open_ = fences.where((F.col("n") < 2) | ~F.col("last").rlike(r"^\s{0,3}(```|~~~)")).select(id, F.lit("code").alias("what")).distinct()
    return marks.where("odd").select(id, F.lit("formula").alias("what")).unionByName(open_)


def section_numbers(df: DataFrame, id: str, text: str = "text") -> DataFrame:
    """``(id, section, line, level, title, number)``: numbers stand before titles; a chapter without one has that of its file's name."""
    heads = manual_lines(df, id, text).where("kind = 'heading'")
    title = F.regexp_extract("text", HEADING, 2)
    level = F.length(F.regexp_extract("text", HEADING, 1))
    own = F.regexp_extract(title, rf"^({NUMBER})(?:\s|$)", 1)
    of_file = F.regexp_extract(F.col(id).cast("string"), r"(?:^|/)0*([0-9]+)_[^/]*$", 1)
    number = F.when(own != "", own).when((level == 1) & (of_file != ""), of_file)
    return heads.select(id, "section", "line", level.alias("level"), title.alias("title"), number.alias("number"))


def manual_links(df: DataFrame, id: str, text: str = "text") -> DataFrame:
    """``(id, line, relation, number, quote, to_id, to_line)``: references of texts to sections and numbered formulas; ``to_id`` is null where none has the number.

    Code, formulas, what stands between backquotes or dollars, and years are no references.
    """
    lines_ = manual_lines(df, id, text).where("kind in ('text', 'quote', 'table')")
    plain = F.regexp_replace("text", r"`[^`]*`|\$[^$]*\$", " ")
    found = []
    for relation, pattern in (("REFERS_TO_SECTION", TO_SECTION), ("REFERS_TO_FORMULA", TO_FORMULA)):
        quoted = lines_.select(id, "line", F.lit(relation).alias("relation"), F.explode(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))).alias("quote"))
        found.append(quoted.withColumn("number", F.explode(F.array_distinct(F.regexp_extract_all("quote", F.lit(rf"\b{NUMBER}"), F.lit(0))))))
    refs = found[0].unionByName(found[1]).where(~F.col("number").rlike(YEAR)).distinct()
    heads = section_numbers(df, id, text).where("number is not null").select(F.lit("REFERS_TO_SECTION").alias("relation"), "number", F.col(id).alias("to_id"), F.col("line").alias("to_line"))
    formulas = manual_units(df, id, text).where("number is not null").select(F.lit("REFERS_TO_FORMULA").alias("relation"), "number", F.col(id).alias("to_id"), F.col("start").alias("to_line"))
    return refs.join(heads.unionByName(formulas), ["relation", "number"], "left").select(id, "line", "relation", "number", "quote", "to_id", "to_line")


def cross_source(entries: DataFrame, definitions: DataFrame, parameters: DataFrame, by: str, selector: str = "type") -> tuple[DataFrame, DataFrame]:
    """Relations of case entries to what a manual says of them, and candidates with the reason why they are none.

    ``entries (by, path, key, value, status)`` are those of dictionaries; an
    instance is the block in which the entry ``selector`` stands.  ``definitions
    (definition, name, alias, conditions)`` are the manual's sections, ``parameters
    (definition, parameter, description)`` their tables.  Relations are ``(by,
    instance, relation, parameter, definition, conditions, description)``: the
    selector's, and one for each entry right in the instance that its
    definition's table has.  Conditions and descriptions are the manual's words.

    An instance is related only if its selector stands in it once and is resolved,
    no directive stands in a block around it, and exactly one definition has its
    value as the primary name; an alias or a homonym gives a candidate.
    """
    parent = F.regexp_replace("path", r"(?:^|/)[^/]*$", "")
    placed = entries.withColumn("instance", parent)
    chosen = placed.where(F.regexp_replace("key", r"@[0-9]+$", "") == selector)
    once = chosen.groupBy(by, "instance").agg(F.count("*").alias("n"), F.first("value").alias("value"), F.bool_and(F.col("status") == "ok").alias("sound"))
    # a directive spoils its block and all below it
    spoilt = entries.where("key like '#%'").select(by, F.col("path").alias("up")).distinct()
    parts = F.split("instance", "/")
    ups = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    under = once.select(by, "instance", F.explode(F.array_distinct(ups)).alias("up")).join(spoilt, [by, "up"], "left_semi").select(by, "instance", F.lit(True).alias("directive")).distinct()
    primary = definitions.groupBy("name").agg(F.count("*").alias("homonyms"), F.first(F.struct("definition", "conditions")).alias("d")).withColumnRenamed("name", "value")
    told = once.join(under, [by, "instance"], "left").join(primary, "value", "left")
    reason = (
        F.when((F.col("n") > 1) | ~F.col("sound"), "unresolved_selector_or_ancestor")
        .when(F.col("directive"), "ancestor_scope_contains_unevaluated_directive_or_statement")
        .when(F.col("homonyms").isNull(), "no_exact_primary_manual_definition")
        .when(F.col("homonyms") > 1, "several_definitions_of_one_name")
    )
    told = told.withColumn("reason", reason)
    good = told.where("reason is null").select(by, "instance", "value", "d.definition", "d.conditions")
    nothing = F.lit(None).cast("string")
    selectors = good.select(by, "instance", F.lit("SELECTOR_DOCUMENTED_BY").alias("relation"), nothing.alias("parameter"), "definition", "conditions", nothing.alias("description"))
    own = placed.where((F.col("key") != selector) & ~F.col("key").startswith("#")).select(by, "instance", F.col("key").alias("parameter")).distinct()
    documented = own.join(good, [by, "instance"]).join(parameters, ["definition", "parameter"])
    documented = documented.select(by, "instance", F.lit("PARAMETER_DOCUMENTED_BY").alias("relation"), "parameter", "definition", "conditions", "description")
    return selectors.unionByName(documented), told.where("reason is not null").select(by, "instance", "value", "reason")
