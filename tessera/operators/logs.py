"""Solver logs: windows of context, classification by a table of rules, statuses and series."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Holds where all ``phrases`` stand in the lower-cased message and the subject is one of ``subjects`` (any, if that is empty)."""

    category: str
    severity: str
    phrases: tuple[str, ...] = ()
    subject: bool = False
    subjects: tuple[str, ...] = ()


@dataclass(frozen=True)
class Kind:
    """Lines that match ``trigger``: ``width`` lines after them belong to the message; the first of ``rules`` that holds counts."""

    trigger: str
    width: int
    rules: tuple[Rule, ...]
    blocking: bool = False
    cut_first: bool = False
    subject: str | None = field(default=None)


def diagnose(log: DataFrame, kinds: list[Kind], source: str, line: str = "line", text: str = "text", cut: int = 1200) -> DataFrame:
    """One row for each line of a kind: ``(source, line, severity, category, blocking, message)``.

    The first kind whose trigger matches counts.  The message is the line
    before, the line and the kind's number of lines after it, stripped, without
    blank ones.  Rules see the whole message (of a ``cut_first`` kind, what is
    returned: ``cut`` characters).  Null text is a blank line.  A kind whose
    rules all fail gives no row.
    """
    near = Window.partitionBy(source).orderBy(line)
    stripped = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    number = F.coalesce(*[F.when(F.col(text).rlike(k.trigger), F.lit(i)) for i, k in enumerate(kinds)])
    # neighbours are single values of each line; only lines of a kind make a list of them
    reach = max(k.width for k in kinds)
    beside = {"_b": F.lag("_s").over(near)} | {f"_a{i}": F.lead("_s", i).over(near) for i in range(1, reach + 1)}
    held = log.select(source, line, number.alias("_k"), stripped.alias("_s")).withColumns(beside)
    width = F.element_at(F.array(*[F.lit(k.width) for k in kinds]), F.col("_k") + 1)
    cut_first = F.element_at(F.array(*[F.lit(k.cut_first) for k in kinds]), F.col("_k") + 1)
    around = F.slice(F.array("_b", "_s", *[f"_a{i}" for i in range(1, reach + 1)]), F.lit(1), width + 2)
    whole = F.array_join(F.filter(around, lambda x: x.isNotNull() & (x != "")), "\n")
    marked = held.where("_k is not null").withColumn("_whole", whole)
    marked = marked.withColumn("message", F.substring("_whole", 1, cut)).withColumn("_seen", F.lower(F.when(cut_first, F.col("message")).otherwise(F.col("_whole"))))
    verdict = F.coalesce(*[F.when((F.col("_k") == i) & _holds(k, r), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.lit(k.blocking).alias("blocking"))) for i, k in enumerate(kinds) for r in k.rules])
    return marked.withColumn("_v", verdict).where("_v is not null").select(source, line, "_v.*", "message")


def _holds(kind: Kind, rule: Rule) -> Column:
    out = F.lit(True)
    for p in rule.phrases:
        out = out & F.contains("_seen", F.lit(p))
    if rule.subject or rule.subjects:
        name = F.regexp_extract("_seen", kind.subject, 1)
        out = out & (name.isin(*rule.subjects) if rule.subjects else name != "")
    return out


def severity_counts(found: DataFrame, by: str, severities: tuple[str, ...] = ("fatal", "error", "warning", "nonblocking_warning")) -> DataFrame:
    """Of each source the rows of each severity, zeros included, the blocking ones, and a map of the rows of each category."""
    each = found.groupBy(by, "category").agg(F.count("*").alias("n"), F.count_if("blocking").alias("b"), *[F.count_if(F.col("severity") == s).alias(s) for s in severities])
    return each.groupBy(by).agg(
        *[F.sum(s).alias(f"n_{s}") for s in severities],
        F.sum("b").alias("n_blocking"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("category", F.lit("unknown")), "n")))).alias("categories"),
    )


def run_status(log: DataFrame, by: str, fatal: str, text: str = "text", line: str = "line") -> DataFrame:
    """``completed``, ``failed`` (a line that matches ``fatal``), ``incomplete`` or ``empty`` for each log."""
    last = F.max_by(text, F.when(F.trim(text) != "", F.col(line)))
    return log.groupBy(by).agg(F.count_if(F.col(text).rlike(fatal)).alias("n_fatal"), last.alias("last")).select(
        by,
        "n_fatal",
        F.when(F.col("n_fatal") > 0, "failed").when(F.col("last").isNull(), "empty").when(F.rtrim("last").endswith("End"), "completed").otherwise("incomplete").alias("status"),
    )


def impulse(series: DataFrame, by: str, t: str = "t", p: str = "p") -> DataFrame:
    """Peak, its time (the least) and the trapezoid sum of the positive part of each series."""
    w = Window.partitionBy(by).orderBy(t)
    plus = F.greatest(F.col(p), F.lit(0.0))
    area = (plus + F.lag(plus).over(w)) / 2 * (F.col(t) - F.lag(t).over(w))
    parts = series.withColumn("area", area)
    return parts.groupBy(by).agg(F.max(p).alias("peak"), F.max_by(t, F.struct(F.col(p), -F.col(t))).alias("t_peak"), F.round(F.coalesce(F.sum("area"), F.lit(0.0)), 6).alias("impulse"))


def health(values: DataFrame, by: list[str], value: str, share: tuple[str, ...] = (), name: str = "field") -> DataFrame:
    """``(by, least, greatest, nonpositive, outside)`` of each field; ``outside`` is for fields named in ``share`` that leave 0 to 1."""
    found = values.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("greatest"))
    bounded = F.col(name).isin(*share) if share else F.lit(False)
    return found.withColumns({"nonpositive": F.col("least") <= 0, "outside": bounded & ((F.col("least") < 0) | (F.col("greatest") > 1))})
