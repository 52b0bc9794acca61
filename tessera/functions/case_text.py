"""Text of case files as Column expressions: blocks, their children, entries, applications, numbers, aliases."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bound, lines, report_reasons, tokens, without_comments

#: Programs of a script that are no solvers.
UTILITIES = (
    "addEmptyPatch blastToVTK blockMesh calculateImpulse changeDictionary checkMesh createPatch decomposePar foamDictionary foamToVTK mapFields postProcess "
    "reconstructPar renumberMesh redistributePar rotateFields sample setExprFields setFields setRefinedFields snappyHexMesh surfaceFeatures topoSet transformPoints"
).split()
#: Fixed value: the line that closes a case file.
CLOSING = "// ************************************************************************* //"

#: What a failed impulse step says, and the reason that is given.
IMPULSE_ERROR = r"(?i)(could not dete?rmine a pressure field|valid probe fields are|was not found in .*postProcessing)"
IMPULSE_REASON = "calculateImpulse reported an invalid or missing pressure field"


def impulse_issues(output: Column, fields: Column, name: str = "report", least: int = 0, probes: str = "pressureProbes", field: str = "p") -> Column:
    """Reasons for which the output of post-processing isn't valid, given the probe ``fields`` of its case; none for a valid one."""
    text, held = F.coalesce(output, F.lit("")), F.array_sort(F.coalesce(fields, F.array().cast("array<string>")))
    said = F.contains(text, F.lit("calculateImpulse"))
    listed = F.when(F.size(held) > 0, F.array_join(held, ", ")).otherwise("none")
    missing = F.concat(F.lit(f"calculateImpulse requires {probes}/{field}, but available probe fields are: "), listed)
    more = F.array(F.when(said & text.rlike(IMPULSE_ERROR), F.lit(IMPULSE_REASON)), F.when(said & ~F.array_contains(held, field), missing))
    return F.concat(report_reasons(output, name, least), F.filter(more, lambda r: r.isNotNull()))


def ten_digits(value: Column) -> Column:
    """A number with at most ten significant digits, as ``%.10g`` writes it; a last digit that is tied goes up."""
    exact = F.format_string("%.9e", F.abs(value))
    digits, power = F.replace(F.substring(exact, 1, 11), F.lit("."), F.lit("")), F.regexp_extract(exact, r"e([+-]\d+)$", 1).try_cast("int")
    bare = lambda c: F.regexp_replace(c, r"(\.\d*?)0+$", "$1")
    ended = lambda c: F.regexp_replace(bare(c), r"\.$", "")
    inner = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(10)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    wide = F.concat(ended(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 9))), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    text = F.when((power < -4) | (power >= 10), wide).when(power < 0, ended(small)).otherwise(ended(inner))
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, text))


def with_entry(text: Column, key: str, value: Column) -> Column:
    """``text`` with the first entry of ``key`` set; without one it is added before the closing line, or at the end."""
    own = rf"(?ms)\A(.*?^\s*{re.escape(key)}\s+)[^;]+(;.*)\z"
    added = F.concat(F.lit(f"{key:<16}"), value, F.lit(";\n"))
    place = F.instr(text, CLOSING)
    return (
        F.when(text.rlike(own), F.concat(F.regexp_extract(text, own, 1), value, F.regexp_extract(text, own, 2)))
        .when(place > 0, F.concat(F.substring(text, F.lit(1), place - 1), added, F.lit("\n"), F.substring(text, place, F.length(text))))
        .otherwise(F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n\n"), added))
    )


def block(text: Column, name: str, cap: int = 1_800, marker: str = "\n... [block truncated]\n") -> Column:
    """The first block whose ``name`` begins a line, with its name and braces; empty without one.

    Blank lines before the name belong to it.  Where the braces don't close it is what stands
    before them.  More than ``cap`` characters end in ``marker``.
    """
    begins = rf"(?m)^\s*{re.escape(name)}\s*\{{"
    text = F.coalesce(text, F.lit(""))
    head = F.regexp_extract(text, begins, 0)
    parts = F.split(F.substring(text, F.regexp_instr(text, F.lit(begins)) + F.length(head), F.length(text)), r"\}", -1)
    opened = lambda p: F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit("")))

    def step(s: Column, p: Column) -> Column:
        depth = s["depth"] + opened(p) - 1
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), (s["n"] + 1).alias("n"), (depth == 0).alias("done")))

    # what stands after the last closing brace closes nothing
    def body(p: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))
        closed = F.aggregate(F.slice(p, F.lit(1), F.size(p) - 1), start, step)
        return F.when(closed["done"], F.concat(head, F.array_join(F.slice(p, F.lit(1), closed["n"]), "}"), F.lit("}"))).otherwise(F.left(head, F.length(head) - 1))

    whole = F.when(head == "", F.lit("")).otherwise(bound(parts, body))
    return bound(whole, lambda w: F.when(F.length(w) > cap, F.concat(F.substring(w, F.lit(1), F.lit(cap)), F.lit(marker))).otherwise(w))


def function_names(control: Column) -> Column:
    """Distinct names in the block ``functions``, in order: indented, alone on a line, with an indented brace on the next."""
    held = block(control, "functions", 5_000)
    return F.array_distinct(F.regexp_extract_all(held, F.lit(r"(?m)^\s{4,}([A-Za-z_][A-Za-z0-9_.-]*)\s*$\n\s{4,}\{"), F.lit(1)))


def boundary_types(field: Column, most: int = 16) -> Column:
    """``patch: type`` for each indented patch of a field's or a mesh's boundary: the first type within 500 characters, or the patch alone."""
    own = block(field, "boundaryField", 6_000)
    found = F.when(own == "", block(field, "boundary", 6_000)).otherwise(own)
    pattern = r"(?m)^\s{4,}([A-Za-z_][A-Za-z0-9_.-]*)\s*\{(?=([\s\S]{0,500}))"
    both = bound(found, lambda b: F.arrays_zip(F.regexp_extract_all(b, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(b, F.lit(pattern), F.lit(2)).alias("tail")))
    kind = lambda c: F.regexp_extract(c["tail"], r"(?m)^\s*type\s+([^;]+);", 1)
    stripped = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    named = F.transform(both, lambda c: F.when(kind(c) == "", c["name"]).otherwise(F.concat(c["name"], F.lit(": "), stripped(kind(c)))))
    return F.slice(named, 1, most)


def probe_locations(text: Column, most: int = 8) -> Column:
    """Distinct points of all ``probeLocations`` lists, their blanks made single."""
    lists = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)probeLocations\s*\((.*?)\)\s*;"), F.lit(1))
    points = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"\([^()]*\)"), F.lit(0))))
    return F.slice(F.array_distinct(F.transform(points, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))), 1, most)


def application(control: Column, script: Column, utilities: list[str] | None = None) -> Column:
    """The solver of a case: the last program that its script runs and is no utility, else what the control file names.

    A script that asks for the control file's application gets it; names with
    variables or commands in them are unknown.
    """
    asked = r"^(\$\(getApplication\)|`getApplication`)$"
    plain = lambda c: F.nullif(F.regexp_extract(F.when(~F.regexp_replace(c, asked, "$").rlike(r"[$`]"), c), r"^[\s'\"]*(?:[^\s'\";]*/)?([^\s'\";/]+)", 1), F.lit(""))
    named = plain(F.regexp_extract(without_comments(control), r"(?m)^\s*application\s+([^;]+);", 1))
    runs = F.filter(lines(without_comments(script)), lambda x: x.rlike(r"\brun(?:Application|Parallel)\s"))
    words = F.transform(runs, lambda x: F.regexp_extract(x, r"\brun(?:Application|Parallel)\s+(?:-s\s+\S+\s+|-\S+\s+)*(\S+)", 1))
    programs = F.transform(words, lambda w: F.when(w.rlike(asked), named).otherwise(plain(w)))
    solvers = F.filter(programs, lambda p: p.isNotNull() & ~p.isin(*(UTILITIES if utilities is None else utilities)))
    return F.coalesce(F.get(solvers, F.size(solvers) - 1), named)


def alias_relevance(query: Column, aliases: Column) -> Column:
    """How well a query names one of ``aliases`` by CJK text: 1 for a whole phrase of three signs or more, else 0.7 of the share of its bigrams.

    A share counts only from two bigrams and half of the alias on.
    """
    foreign = lambda c: F.array_distinct(F.filter(tokens(c), lambda t: t.rlike(r"[^\x00-\x7F]")))

    def score(alias: Column, asked: Column) -> Column:
        def of(words: Column) -> Column:
            n = F.size(F.array_intersect(words, asked))
            whole = alias.rlike(r"[\x{4e00}-\x{9fff}]{3,}") & F.contains(query, alias)
            share = n / F.greatest(F.size(words), F.lit(1))
            return F.when(n == 0, 0.0).when(whole, 1.0).when((n >= 2) & (share >= 0.5), 0.7 * share).otherwise(0.0)

        return bound(foreign(alias), of)

    best = bound(foreign(query), lambda asked: F.array_max(F.transform(aliases, lambda a: score(a, asked))))
    return F.coalesce(best, F.lit(0.0))
