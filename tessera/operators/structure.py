"""Parsers of structured texts: dictionaries with braces, and Markdown blocks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.functions.text import lines, masked, without_comments

ENTRY = "array<struct<path:string,key:string,value:string,kind:string,status:string,line:int,end_line:int>>"
_LEX = re.compile(r'\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*"|[{};]|[^\s{};"(/]+\((?:[^\s{};"()]|\([^\s{};"()]*\))*\)|(?:[^\s{};"(/]|/(?![/*]))+|[(]|/', re.S)


def parse_dictionary(text: str) -> list[dict]:
    """Entries of a text of nested blocks, ``key value;`` pairs and ``#`` directives.

    Paths join keys with ``/`` (``~1`` for a slash in a key); a key that
    repeats in its block is ``key@n`` from the second on and all its entries
    are ``unresolved``, as are values with a ``$``.  Values keep their text.  A
    value that a closing brace or the end cuts short is ``missing_semicolon``;
    a block without its end is ``unclosed``.
    """
    out: list[dict] = []
    stack: list[tuple[str, int | None, dict]] = [("", None, {})]
    held: list[tuple[str, int]] = []
    depth, pos, line = 0, 0, 1

    def key_path(key: str) -> tuple[str, bool]:
        seen = stack[-1][2]
        seen[key] = n = seen.get(key, 0) + 1
        safe = key.strip('"').replace("~", "~0").replace("/", "~1")
        base = f"{stack[-1][0]}/{safe}" if stack[-1][0] else safe
        if n > 1:
            for e in out:
                if e["path"] == base or e["path"].startswith(base + "@"):
                    e["status"] = "unresolved" if e["status"] == "ok" else e["status"]
        return (base if n == 1 else f"{base}@{n}"), n > 1

    def flush(end: int, status: str) -> None:
        if not held:
            return
        (key, at), value = held[0], text[held[1][1] : held[-1][1] + len(held[-1][0])] if len(held) > 1 else ""
        start = line_at(at)
        if key.startswith("#"):
            out.append(dict(path=stack[-1][0], key=key, value=text[at:end].strip(), kind="directive", status="ok", line=start, end_line=line))
        else:
            path, again = key_path(key)
            kind = "list" if value.startswith("(") else "dimensions" if value.startswith("[") else "string" if value.startswith('"') else "value"
            state = status if status != "ok" else "unresolved" if again or "$" in value else "ok"
            out.append(dict(path=path, key=key.strip('"'), value=value, kind=kind, status=state, line=start, end_line=line))
        held.clear()

    breaks = [m.start() for m in re.finditer("\n", text)]

    def line_at(at: int) -> int:
        from bisect import bisect_left

        return bisect_left(breaks, at) + 1

    for m in _LEX.finditer(text):
        token, pos = m.group(), m.start()
        line = line_at(pos)
        if token[0].isspace() or token.startswith(("//", "/*")):
            if held and held[0][0].startswith("#") and "\n" in token and depth == 0:
                flush(pos, "ok")
            continue
        if token == "(":
            depth += 1
            held.append((token, pos)) if held else held.append(("(", pos))
            continue
        if depth:
            depth += token.count("(") - token.count(")")
            depth = max(0, depth)
            held.append((token, pos))
            continue
        if token == "{":
            key = held[0][0] if held else ""
            at = line_at(held[0][1]) if held else line
            path, again = key_path(key)
            out.append(dict(path=path, key=key.strip('"'), value="", kind="block", status="unresolved" if again else "ok", line=at, end_line=0))
            held.clear()
            stack.append((path, len(out) - 1, {}))
        elif token == "}":
            flush(pos, "missing_semicolon")
            if len(stack) > 1:
                out[stack.pop()[1]]["end_line"] = line
        elif token == ";":
            flush(pos, "ok")
        else:
            held.append((token, pos))
            depth = max(0, token.count("(") - token.count(")")) if "(" in token else 0
    line = len(breaks) + 1
    flush(len(text), "missing_semicolon" if held and not held[0][0].startswith("#") else "ok")
    for _, at, _ in stack[1:]:
        out[at].update(end_line=line, status="unclosed")
    return out


def dictionary_entries(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with one row for each entry of each text; ``keep`` names the columns that stay."""

    @arrow_udf(ENTRY)
    def parse(texts: pa.Array) -> pa.Array:
        kind = pa.struct([(n, pa.int32() if n in ("line", "end_line") else pa.string()) for n in ("path", "key", "value", "kind", "status", "line", "end_line")])
        return pa.array([parse_dictionary(x.as_py() or "") for x in texts], pa.list_(kind))

    return df.select(*keep, F.explode(parse(F.col(text))).alias("_e")).select(*keep, "_e.*")


def fenced(text: Column) -> Column:
    """Lines as ``struct(line, text, code)``: ``code`` tells lines within fences, the fences included."""
    lines_ = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    @arrow_udf("array<boolean>")
    def inside(marks: pa.Array) -> pa.Array:
        out = []
        for row in marks.to_pylist():
            fence, code = "", []
            for mark in row:
                code.append(bool(fence or mark))
                fence = mark if not fence else "" if mark == fence else fence
            out.append(code)
        return pa.array(out, pa.list_(pa.bool_()))

    code = inside(F.transform(lines_, lambda x: F.regexp_extract(x, r"^\s{0,3}(```|~~~)", 1)))
    return F.zip_with(F.transform(lines_, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), code, lambda a, c: F.struct(a["line"].alias("line"), a["text"].alias("text"), c.alias("code")))


def markdown_headings(df: DataFrame, id: str, text: str = "text") -> DataFrame:
    """``(id, line, level, title)`` of ``#`` headings outside fences."""
    each = df.select(id, F.explode(fenced(F.col(text))).alias("e")).select(id, "e.*").where("not code")
    pattern = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
    return each.where(F.col("text").rlike(pattern)).select(id, "line", F.length(F.regexp_extract("text", pattern, 1)).alias("level"), F.regexp_extract("text", pattern, 2).alias("title"))


def brace_ranges(df: DataFrame, id: str, text: str = "text") -> DataFrame:
    """``(id, start, end)``: lines from each brace that opens to the one that closes it, outside comments and strings.

    A range begins a line earlier where its first line holds nothing but
    braces that open, as its name then stands above.  Braces that close nothing
    are passed over; those that never close give no range.  At one depth opening
    and closing braces alternate, so each closing one's partner is the brace
    before it at its depth.
    """
    both = F.arrays_zip(lines(masked(F.col(text))).alias("m"), lines(F.col(text)).alias("t"))
    each = df.select(id, F.posexplode(both).alias("line", "x")).where(F.contains("x.m", F.lit("{")) | F.contains("x.m", F.lit("}")))
    bare = F.trim(F.regexp_replace("x.t", r"^\s+|\s+$", "")).rlike(r"^\{*$")
    marks = each.select(id, F.col("line") + 1, bare.alias("bare"), F.posexplode(F.regexp_extract_all("x.m", F.lit(r"[{}]"), F.lit(0))).alias("k", "mark")).toDF(id, "line", "bare", "k", "mark")
    upto = Window.partitionBy(id).orderBy("line", "k").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("mark") == "{"
    summed = marks.withColumn("s", F.sum(F.when(opens, 1).otherwise(-1)).over(upto)).withColumn("low", F.least(F.lit(0), F.min("s").over(upto)))
    before = F.least(F.lit(0), F.coalesce(F.min("s").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a brace that closes nothing brings the sum to a new low
    real = summed.withColumn("lost", ~opens & (F.col("s") < before)).where("not lost")
    depth = F.col("s") - F.col("low") + F.when(opens, 0).otherwise(1)
    same = Window.partitionBy(id, "depth").orderBy("line", "k")
    paired = real.withColumn("depth", depth).withColumns({"start": F.lag("line").over(same), "above": F.lag("bare").over(same)}).where("mark = '}'")
    return paired.select(id, F.when(F.col("above"), F.greatest(F.lit(1), F.col("start") - 1)).otherwise(F.col("start")).alias("start"), F.col("line").alias("end"))


def include_edges(df: DataFrame, id: str, text: str = "text") -> DataFrame:
    """``(source, target)`` of literal ``#include "name"`` lines; comments and names with macros don't count."""
    bare = without_comments(F.col(text))
    found = F.regexp_extract_all(bare, F.lit(r'(?m)^\s*#include\s+"([^"$\n]+)"'), F.lit(1))
    return df.select(F.col(id).alias("source"), F.explode(found).alias("target")).where(~F.col("target").rlike(r"(^/|(^|/)\.\.(/|$))")).distinct()
