"""Text functions as Column expressions; null text counts as empty unless said otherwise."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Words that carry no evidence.  Fixed values.
STOP = ("a", "an", "the", "of", "to", "and", "in", "for", "is", "on", "with", "as", "from")
_STOPS = r"(?<![^ ])(?:" + "|".join(STOP) + r")(?![^ ])"
REDACTED = "<REDACTED>"
#: Patterns of keys and values that may be secrets.  Fixed values.
SENSITIVE_KEY = r"(?i)(?:api[_-]?key|secret|token|password|passwd|private[_-]?key|access[_-]?key|auth)"
ASSIGNMENT = r"^([+\- ]?\s*(?:export\s+)?)([A-Za-z_][A-Za-z0-9_.-]*)(\s*[:=]\s*)(.*)$"
BEARER = r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{12,}"
TOKEN_PREFIX = r"\b(?:sk|pk|rk|ak|xox[baprs]|gh[pousr])-[A-Za-z0-9._~+/=-]{12,}"
_JSON_WORD = r"(?:[A-Za-z0-9_.-]*(?:api[_-]?key|secret|token|password|passwd|private[_-]?key|access[_-]?key)[A-Za-z0-9_.-]*|auth)"
JSON_KEY = rf"(?i)((?:\"{_JSON_WORD}\"|'{_JSON_WORD}'|{_JSON_WORD})\s*:\s*)"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for a row, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines(text: Column) -> Column:
    """Lines as an array; a final line break ends the last line and begins none."""
    return F.split(F.regexp_replace(_text(text), r"\n\z", ""), "\n", -1)


def tokens(text: Column) -> Column:
    """Identifiers, their camel-case and digit pieces, and CJK bigrams, lower-cased, without stop words.

    Repeats stay.  In a run of capitals that is not last in the text the final letter belongs to what follows.
    """
    cjk = r"[\x{4e00}-\x{9fff}]"

    def latin(joined: Column) -> Column:
        pieces = F.regexp_extract_all(joined, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|\z)|[0-9]+"), F.lit(0))
        # one string lower-cased and freed of stop words at once costs far less than a lambda for each token
        held = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", joined, F.array_join(pieces, " "))), _STOPS, ""))
        return bound(held, lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, " +")))

    def of(x: Column) -> Column:
        own = bound(F.array_join(F.regexp_extract_all(x, F.lit(r"[A-Za-z_][A-Za-z_0-9]*"), F.lit(0)), " "), latin)
        runs = F.regexp_extract_all(x, F.lit(cjk + "+"), F.lit(0))
        pairs = F.flatten(
            F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substring(r, i, F.lit(2))))
        )
        return F.when(x.rlike(cjk), F.concat(own, pairs)).otherwise(own)

    return bound(_text(text), of)


def terms(text: Column) -> Column:
    """Distinct identifiers, numbers and CJK runs of the folded text."""
    folded = F.replace(F.lower(_text(text)), F.lit("ß"), F.lit("ss"))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(folded, F.lit(r"[a-z_][a-z_0-9]*|[0-9]+|[\x{3400}-\x{9fff}]+"), F.lit(0))))


def present(text: Column, name: str) -> Column:
    """Whether ``name`` stands in the text between identifier boundaries, in any case."""
    return F.coalesce(text.rlike(r"(?i)(?<![A-Za-z0-9_])" + re.escape(name) + r"(?![A-Za-z0-9_])"), F.lit(False))


def normalized(text: Column) -> Column:
    """Camel case, hyphens and underscores to blanks; only a-z, digits, dots, slashes and CJK stay; blanks squeezed."""
    spaced = F.regexp_replace(F.regexp_replace(_text(text), r"([a-z0-9])([A-Z])", "$1 $2"), "[-_]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(spaced), r"[^a-z0-9./\x{4e00}-\x{9fff}]", " "), " +", " "))


def glob_regex(pattern: str) -> str:
    """An anchored regex: ``*`` and ``?`` within one component, ``[seq]`` and ``[!seq]`` one character of it, ``**`` any
    number of components; without a slash, the last component.

    An open bracket that is not closed stands for itself.  Absolute patterns, backslashes, colons and ``..`` are errors.
    """
    if not pattern or pattern.startswith("/") or "\\" in pattern or ":" in pattern or ".." in pattern.split("/"):
        raise ValueError("a relative pattern is needed")

    def part(p: str) -> str:
        out, k = "", 0
        while k < len(p):
            # a bracket right after the opening belongs to the sequence
            close = p.find("]", k + 2 + (p[k + 1 : k + 2] == "!")) if p[k] == "[" else -1
            if close > 0:
                negated = p[k + 1] == "!"
                inside = re.sub(r"([\\\[\]^&~])", r"\\\1", p[k + 1 + negated : close])
                out += f"(?!/)[{'^' if negated else ''}{inside}]"
                k = close + 1
                continue
            out += {"*": "[^/]*", "?": "[^/]"}.get(p[k]) or re.escape(p[k])
            k += 1
        return out

    if "/" not in pattern:
        return f"^(?:.*/)?{part(pattern)}$"
    parts, out = pattern.split("/"), ""
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        if p == "**":
            out += "(?:[^/]+(?:/[^/]+)*)?" if last else "(?:[^/]+/)*"
        else:
            out += part(p) + ("" if last else "(?:/|$)" if parts[k + 1 :] == ["**"] else "/")
    return f"^{out}$"


def sensitive_path(path: Column) -> Column:
    """Environment and credential files by the last component of a path; null is not sensitive."""
    clean = F.regexp_replace(F.replace(_text(path), F.lit("\\"), F.lit("/")), r"^[\s'\"]+|[\s'\"]+$", "")
    name = F.lower(F.element_at(F.split(F.regexp_replace(F.regexp_replace(clean, r"^[ab]/", ""), r"/+$", ""), "/"), -1))
    return (name == ".env") | name.startswith(".env.") | name.isin("credentials", "credentials.json", "secrets.json")


def redact(text: Column) -> Column:
    """Values of secret assignments, bearer tokens, secret JSON members and tokens of known prefixes replaced."""

    def line(x: Column) -> Column:
        key = F.regexp_extract(x, ASSIGNMENT, 2)
        secret = (key != "") & (F.lower(key) != "authorization") & key.rlike(SENSITIVE_KEY)
        return F.when(secret, F.regexp_replace(x, ASSIGNMENT, f"$1$2$3{REDACTED}")).otherwise(x)

    out = F.array_join(F.transform(F.split(_text(text), "\n", -1), line), "\n")
    out = F.regexp_replace(out, BEARER, f"$1{REDACTED}")
    out = F.regexp_replace(out, JSON_KEY + r'"[^"\r\n]*"', f'$1"{REDACTED}"')
    out = F.regexp_replace(out, JSON_KEY + r"'[^'\r\n]*'", f"$1'{REDACTED}'")
    out = F.regexp_replace(out, JSON_KEY + r"[^\s,}\]\"'][^\s,}\]]*", f"$1{REDACTED}")
    return F.regexp_replace(out, TOKEN_PREFIX, REDACTED)


#: What a text of code falls into: comments, strings, and what lies between; a mark that opens and never closes stands alone.
LEXEME = r'(?s)/\*.*?\*/|//[^\n]*|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^/"]+|.'


def _lexemes(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(LEXEME), F.lit(0))


def _comment(x: Column) -> Column:
    return x.startswith("/*") | x.startswith("//")


def without_comments(text: Column) -> Column:
    """Block and line comments removed; what looks like one within a string stays."""
    return F.array_join(F.filter(_lexemes(text), lambda x: ~_comment(x)), "")


def masked(text: Column) -> Column:
    """Comments and strings as blanks of the same length; line breaks stay, so places and lines do."""
    hidden = lambda x: _comment(x) | x.startswith('"') & (F.length(x) > 1)
    return F.array_join(F.transform(_lexemes(text), lambda x: F.when(hidden(x), F.regexp_replace(x, r"[^\n]", " ")).otherwise(x)), "")


def identity_fold(text: Column) -> Column:
    """Case-folded text in compatibility decomposition without combining marks; Spark has no such function, so Arrow batches are folded."""

    @arrow_udf("string")
    def fold(texts: pa.Array) -> pa.Array:
        return pa.array(["".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c)) for x in texts.to_pylist()], pa.string())

    return fold(_text(text))


def entry(text: Column, key: str) -> Column:
    """The value of the first line ``key value;``, trimmed; null without one."""
    got = F.regexp_extract(_text(text), rf"(?m)^\s*{re.escape(key)}\s+([^;]+);", 1)
    return F.when(got != "", F.trim(got))


def number_after(text: Column, key: str) -> Column:
    """The first number within 80 characters that are no digits after ``key``; null without one."""
    return F.regexp_extract(_text(text), rf"(?i){re.escape(key)}[^0-9+\-]{{0,80}}([-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")


def clean_end(text: Column) -> Column:
    """Whether a log ended as it should."""
    return F.contains(_text(text), F.lit("\nEnd\n")) | F.rtrim(_text(text)).endswith("End")


def compacted(text: Column, head: int, tail: int, marker: str = "\n...\n") -> Column:
    """The first ``head`` and last ``tail`` characters where the text has more than both."""
    n = F.length(_text(text))
    return F.when(n <= head + tail, _text(text)).otherwise(F.concat(F.substring(_text(text), 1, head), F.lit(marker), F.right(_text(text), F.lit(tail))))


def safe_name(text: Column) -> Column:
    """Runs of characters other than letters, digits, dots, hyphens and underscores to one underscore, trimmed of these."""
    return F.btrim(F.regexp_replace(_text(text), r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def anomaly(line: Column) -> Column:
    """``nonfinite_or_fatal``, ``nonpositive_temperature`` or null, by one line of a log."""
    low = F.regexp_extract(line, r"min\(T\):\s*([-+0-9.eE]+)", 1).try_cast("double")
    return F.when(line.rlike(r"(?i)\b(?:nan|[+-]?inf(?:inity)?)\b|FOAM FATAL|segmentation fault"), F.lit("nonfinite_or_fatal")).when(
        low <= 0, F.lit("nonpositive_temperature")
    )


def canonical_hash(*columns: Column) -> Column:
    """SHA-256 of compact JSON of the columns, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def literals(text: Column) -> Column:
    """Distinct names with the signs that paths and types have in them, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_text(text), F.lit(r"[A-Za-z_][A-Za-z0-9_./<>+-]*"), F.lit(0))))


def identifiers(text: Column, without: list[str]) -> Column:
    """Distinct lower-cased identifiers, sorted, but for the words of ``without``."""
    found = F.transform(F.regexp_extract_all(_text(text), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), F.lower)
    return F.array_sort(F.array_except(found, F.array(*map(F.lit, without)).cast("array<string>")))


def alternation(question: Column) -> Column:
    """A pattern for any of a question's literal terms; the question itself, escaped, where it has none."""
    escaped = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_\x{4e00}-\x{9fff}]", r"\\$0")
    terms = F.regexp_extract_all(_text(question), F.lit(r"[A-Za-z_][A-Za-z0-9_.-]*|[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    return F.when(F.size(terms) > 0, F.array_join(F.transform(terms, escaped), "|")).otherwise(escaped(_text(question)))


def case_directory(path: Column, root: str, folders: list[str], files: list[str], depth: int = 3) -> Column:
    """The case that a path below ``root`` belongs to; null without one.

    It ends before the first component of ``folders`` that has at least ``depth``
    components before it, or is the folder of a file named in ``files``.
    """
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    marks = F.filter(F.transform(parts, lambda p, i: F.when(p.isin(*folders) & (i >= depth), i)), lambda i: i.isNotNull())
    upto = F.when(F.size(marks) > 0, F.get(marks, F.lit(0))).when(F.element_at(parts, -1).isin(*files), F.size(parts) - 1)
    return F.when(F.get(parts, F.lit(0)) == root, F.array_join(F.slice(parts, F.lit(1), upto), "/"))


#: What a report must not hold, and the reason that is given.
REPORT_ERRORS = [
    (r"(?i)(error executing agent|connection error|api connection error|agent timeout|no output generated)", False, "report contains an agent/tool connection error"),
    (
        r"(?i)^\s*(?:sorry[,\s]*)?(?:i\s+)?(?:need|require|would need)\s+(?:more|additional)\s+(?:steps|time|information|context)\b"
        r"|^\s*(?:sorry[,\s]*)?(?:i\s+)?(?:cannot|can't|can not)\s+(?:complete|process|finish)\s+this\s+request\b|^\s*(?:please\s+)?(?:continue|provide more context)\b",
        True,
        "report is a placeholder continuation response",
    ),
    (r"(?i)^\s*(?:---\s*)?Retrieved Documentation Information(?:\s*---)?|^\s*Observation:\s*|^\s*Tool output:\s*", True, "report appears to be raw tool/retrieval output instead of an analysis report"),
]
REPORT_EMPTY, REPORT_SHORT = "report is empty", "is shorter than the minimum content contract"


def report_reasons(text: Column, name: str, least: int = 80) -> Column:
    """Reasons for which a report is not valid, in a fixed order; none for a valid one."""
    bare = F.regexp_replace(_text(text), r"\A\s+|\s+\z", "")
    checks = [F.when(bare == "", F.lit(REPORT_EMPTY)), *[F.when((bare if stripped else _text(text)).rlike(p), F.lit(why)) for p, stripped, why in REPORT_ERRORS], F.when(F.length(bare) < least, F.lit(f"{name} {REPORT_SHORT}"))]
    return F.filter(F.array(*checks), lambda r: r.isNotNull())


def short_id(*parts: Column) -> Column:
    """Sixteen hexadecimal digits of the SHA-1 of parts joined by line breaks."""
    return F.substring(F.sha1(F.concat_ws("\n", *parts).cast("binary")), 1, 16)


def balanced(text: Column) -> Column:
    """Whether round, square and curly brackets each close as often as they open and never before."""
    signs = F.regexp_extract_all(_text(text), F.lit(r"[()\[\]{}]"), F.lit(0))
    step = lambda open, close: lambda s, c: F.struct(
        (s["n"] + F.when(c == open, 1).when(c == close, -1).otherwise(0)).alias("n"), (s["ok"] & ((c != close) | (s["n"] > 0))).alias("ok")
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("ok"))
    done = [F.aggregate(signs, start, step(a, b), lambda s: s["ok"] & (s["n"] == 0)) for a, b in ("()", "[]", "{}")]
    return done[0] & done[1] & done[2]


def important_lines(text: Column, pattern: str, cap: int = 1600, marker: str = "\n... [excerpt truncated]") -> Column:
    """Distinct lines that match, up to ``cap`` characters; the text's beginning where none does."""
    found = F.array_distinct(F.filter(F.transform(F.filter(lines(_text(text)), lambda x: x.rlike(pattern)), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != ""))

    def excerpt(joined: Column) -> Column:
        whole = F.when(joined != "", joined).otherwise(F.regexp_replace(F.substring(_text(text), 1, cap), r"\A\s+|\s+\z", ""))
        ends = F.substring(joined, cap + 1, 1).isin("", "\n")
        return F.when((F.length(joined) > cap) & ~ends, F.concat(F.regexp_replace(F.substring(joined, 1, cap), r"\s+$", ""), F.lit(marker))).otherwise(F.substring(whole, 1, cap))

    return bound(F.regexp_replace(F.array_join(found, "\n"), r"\A\s+|\s+\z", ""), excerpt)
