"""Delivery of source lines under a cap of serialised JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The parts of a packet whose characters count.
OPEN, CLOSE = '{"evidence":[', '],"truncated":true}'
UNIT = '{"path":,"start":,"end":,"rank":,"lines":[]}'
LINE, NEXT = '{"number":,"text":}', ',"next_line":'


def json_chars(c: Column) -> Column:
    """Characters of a text as a JSON string, quotes included."""
    return F.length(F.to_json(F.struct(c.alias("x")))) - len('{"x":}')


def deliver_json(lines: DataFrame, by: str, cap: int) -> DataFrame:
    """Units of the longest prefix of lines whose packet has ``cap`` characters at most: ``(by, rank, path, start, end, next_line, truncated)``.

    ``lines`` is ``(by, rank, path, start, last, number, text)``: the lines of each
    ranked range.  A packet is ``{"evidence":[{"path","start","end","rank","lines":
    [{"number","text"}],"next_line"}],"truncated"}``.  A line is taken if the packet that ends
    with it, with ``next_line`` where its range goes on, keeps to the cap; the first
    that doesn't ends the delivery.  A packet that is complete but a character
    too long (``false`` for ``true``) delivers nothing.  Windows are over one request's lines.
    """
    digits = lambda c: F.length(c.cast("string"))
    order = Window.partitionBy(by).orderBy("rank", "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first_unit = F.col("rank") == F.min("rank").over(Window.partitionBy(by))
    unit = len(UNIT) + json_chars(F.col("path")) + digits(F.col("start")) + digits(F.col("rank")) + F.when(first_unit, 0).otherwise(1)
    own = len(LINE) + digits(F.col("number")) + json_chars(F.col("text")) + F.when(F.col("number") > F.col("start"), 1).otherwise(0)
    sized = lines.withColumns({"_unit": unit, "_own": own})
    whole = F.col("_own") + F.when(F.col("number") == F.col("last"), F.col("_unit") + digits(F.col("last"))).otherwise(0)
    goes_on = F.when(F.col("number") < F.col("last"), len(NEXT) + digits(F.col("number") + 1)).otherwise(0)
    trial = len(OPEN + CLOSE) + F.coalesce(F.sum(whole).over(before), F.lit(0)) + F.col("_own") + F.col("_unit") + digits(F.col("number")) + goes_on
    tried = sized.withColumn("_trial", trial).withColumn("_over", F.max((F.col("_trial") > cap).cast("int")).over(order))
    all_of = Window.partitionBy(by)
    kept = tried.withColumns({"truncated": F.max("_over").over(all_of) == 1, "_most": F.max("_trial").over(all_of)})
    fits = F.col("truncated") | (F.col("_most") + 1 <= cap)
    units = kept.where((F.col("_over") == 0) & fits).groupBy(by, "rank", "path", "start", "last", "truncated").agg(F.max("number").alias("end"))
    return units.select(by, "rank", "path", "start", "end", F.when(F.col("end") < F.col("last"), F.col("end") + 1).alias("next_line"), "truncated")
