"""Scores by literal identity: what a request names, found in texts, files, cases and headings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import identity_fold, literals
from tessera.session import cut

WORD = r"[A-Za-z_][A-Za-z0-9_]*"


def request_identifiers(requests: DataFrame, by: str, text: str, stop: tuple[str, ...]) -> DataFrame:
    """``(by, word, n)``: distinct folded identifiers of a request, without ``stop``, and how many it has."""
    words = F.array_except(F.array_distinct(F.regexp_extract_all(identity_fold(F.col(text)), F.lit(WORD), F.lit(0))), F.array(*map(F.lit, stop)).cast("array<string>"))
    return requests.select(by, words.alias("_w")).select(by, F.size("_w").alias("n"), F.explode("_w").alias("word"))


def higher_of(passes: list[DataFrame], by: list[str], score: str = "score") -> DataFrame:
    """Rows of several passes, each key once with its higher score."""
    every = passes[0].select(*by, score)
    for p in passes[1:]:
        every = every.unionByName(p.select(*by, score))
    return every.groupBy(*by).agg(F.max(score).alias(score))


def identity_scores(seeds: DataFrame, requests: DataFrame, units: DataFrame, declared: DataFrame, by: str, stop: tuple[str, ...] = (), default: str = "default") -> DataFrame:
    """``(by, unit, score)``: seed scores renewed by what of a request's identifiers the unit itself has.

    0.45 of the seed's score; 24 for the share of identifiers in the text; 24 where
    the file's name is one; 12 where the unit's case is named; 12 for the share among
    the keys that the file declares, of two or more; 8 for each in the heading; 6
    where the request asks for a ``default`` that the text of a manual has.
    Identifiers are compared folded, without marks.  Units that a file name, case
    or heading names come in without a seed.

    ``units (unit, path, case, heading, manual, text)``, ``declared (path, key)``,
    ``seeds (by, unit, score)``; words meet in equi-joins.
    """
    asked = cut(request_identifiers(requests, by, "text", stop), "identifiers")
    wanted = asked.select("word").distinct()
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(identity_fold(F.col(c)), F.lit(WORD), F.lit(0))))
    text = units.select("unit", words("text").alias("word")).join(wanted, "word", "left_semi")
    text = cut(text, "identity-words")
    heading = units.select("unit", words("heading").alias("word"))
    file = units.select("unit", name.alias("word"))
    case = units.where(F.col("case").isNotNull()).select("unit", F.lower("case").alias("word"))
    key = declared.select("path", identity_fold(F.col("key")).alias("word")).distinct().join(units.select("path", "unit"), "path").select("unit", "word")
    met = lambda side, out: side.distinct().join(asked, "word").groupBy(by, "unit").agg(F.count("*").alias(out))
    named = met(file, "_file").join(met(case, "_case"), [by, "unit"], "full").join(met(heading, "_head"), [by, "unit"], "full")
    rows = seeds.select(by, "unit", F.col("score").alias("_seed")).join(named, [by, "unit"], "full")
    rows = rows.join(met(text, "_exact"), [by, "unit"], "left").join(met(key, "_keys"), [by, "unit"], "left")
    size = asked.groupBy(by).agg(F.first("n").alias("_n"), F.bool_or(F.col("word") == default).alias("_default"))
    has = text.where(F.col("word") == default).select("unit", F.lit(True).alias("_has")).join(units.where("manual").select("unit"), "unit", "left_semi")
    rows = rows.join(size, by, "left").join(has, "unit", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = F.greatest(F.lit(1), zero("_n"))
    flag = lambda c, w: F.when(zero(F.col(c)) > 0, w).otherwise(0)
    joint = F.when(zero(F.col("_keys")) >= 2, 12 * F.col("_keys") / n).otherwise(0.0)
    score = 0.45 * zero(F.col("_seed")) + 24 * zero(F.col("_exact")) / n + flag("_file", 24) + flag("_case", 12) + joint + 8 * zero(F.col("_head")) + F.when(F.col("_default") & F.col("_has"), 6).otherwise(0)
    return rows.select(by, "unit", F.round(score, 6).alias("score"))


def source_allowed(question: Column, path: Column, named: Column) -> Column:
    """Whether a question leaves room for a path: one that speaks of manuals and not of tutorials, and names no case, has no tutorials; one for tutorials only has no manuals."""
    text = F.coalesce(question, F.lit(""))
    says = lambda *words: reduce(or_, [F.contains(text, F.lit(w)) for w in words])
    manuals = says("手册") & ~says("教程") & ~F.coalesce(named, F.lit(False))
    return ~(manuals & path.startswith("tutorials/")) & ~(says("只查教程", "仅查教程") & path.startswith("manual/"))


def source_terms(text: Column) -> Column:
    """Distinct lower-cased identifiers, numbers with their parts, and CJK bigrams (single signs where they stand alone)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"[a-z_][a-z0-9_]*|[0-9]+(?:\.[0-9]+)*"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"[\x{3400}-\x{9fff}]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))


def lexical_seeds(nodes: DataFrame, questions: DataFrame, by: str, node: str = "node") -> DataFrame:
    """``(by, node, score)`` of nodes that a question's words or literals meet.

    ``nodes`` is ``(node, text, dictionary, key, path, model, conditions, case, fact)``,
    ``questions`` ``(by, question, cases array<string>)``.  12 for the share of the
    question's terms that the text has, 4 for the share of the text's; 30 where a literal
    is the dictionary's path, 16 where a part of one is the key, 24 where one is the
    end of the path or its file's name, 20 where one is the model; up to 4 for
    terms of the conditions, 8 for a case that is named, 1 for a ``fact``.  Where cases
    are named, nodes of others are left out, as are sources that the question excludes.
    """
    asked = questions.select(by, "question", F.coalesce("cases", F.array().cast("array<string>")).alias("cases"), source_terms(F.col("question")).alias("_q"), F.transform(literals(F.col("question")), F.lower).alias("_l"))
    asked = cut(asked, "asked")
    term = asked.select(by, F.explode("_q").alias("word"))
    piece = asked.select(by, F.explode(F.array_distinct(F.flatten(F.transform("_l", lambda v: F.split(v, "/"))))).alias("word"))
    slashed = asked.select(by, F.explode(F.array_distinct(F.filter("_l", lambda v: F.contains(v, F.lit("/"))))).alias("word"))
    field = slashed.where(~F.startswith("word", F.lit("manual/")) & ~F.startswith("word", F.lit("tutorials/")))
    own = nodes.where(~F.coalesce(F.startswith("dictionary", F.lit("FoamFile")), F.lit(False))).withColumn("_t", source_terms(F.col("text")))
    parts = F.split(F.lower("path"), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))
    met = lambda side, words, channel: side.where("word <> ''").join(words, "word").groupBy(by, node).agg(F.count_distinct("word").alias("n")).withColumn("channel", F.lit(channel))
    low = lambda c: own.select(node, F.lower(c).alias("word"))
    found = [
        met(own.select(node, F.explode("_t").alias("word")), term, "text"),
        met(low("dictionary"), field, "full"),
        met(low("key"), piece, "key"),
        met(own.select(node, F.explode(ends).alias("word")), slashed, "file"),
        met(own.select(node, F.element_at(parts, -1).alias("word")), piece, "file"),
        met(low("model"), piece, "model"),
    ]
    every = reduce(DataFrame.unionByName, found).groupBy(by, node)
    has = lambda c: F.bool_or(F.col("channel") == c).alias(f"_{c}")
    seen = every.agg(F.coalesce(F.max(F.when(F.col("channel") == "text", F.col("n"))), F.lit(0)).alias("_n"), *map(has, ("full", "key", "file", "model")))
    facts = own.select(node, "path", "case", F.coalesce("fact", F.lit(False)).alias("fact"), F.size("_t").alias("_size"))
    named = asked.select(by, "question", "cases", F.size("_q").alias("_all"))
    limits = met(own.select(node, F.explode(source_terms(F.col("conditions"))).alias("word")), term, "c").select(by, node, F.col("n").alias("_c"))
    rows = seen.join(facts, node).join(named, by).join(limits, [by, node], "left")
    inside = F.coalesce(F.array_contains("cases", F.col("case")), F.lit(False))
    open_ = (F.size("cases") == 0) | F.col("case").isNull() | inside
    rows = rows.where(open_ & source_allowed(F.col("question"), F.col("path"), F.size("cases") > 0))
    one = lambda c, w: F.when(F.col(c), w).otherwise(0)
    score = 12 * F.col("_n") / F.greatest(F.lit(1), "_all") + 4 * F.col("_n") / F.greatest(F.lit(1), "_size") + one("_full", 30) + one("_key", 16) + one("_file", 24) + one("_model", 20)
    score = score + F.least(F.lit(4), F.coalesce("_c", F.lit(0))) + F.when(inside, 8).otherwise(0) + one("fact", 1)
    return rows.select(by, node, F.round(score, 6).alias("score"))
