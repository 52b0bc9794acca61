"""Frozen text corpora: manifests, lines, listings and what can be told from paths."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import glob_regex, lines
from tessera.session import cut

#: Case directories that are sent to all tasks.
BROADCAST_CASES = 1_000_000


def read_frozen(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """``(path, status, text)`` for each row of ``manifest (path, sha256)``.

    ``status`` is ``ok``, ``missing``, ``changed`` (another digest), ``binary``
    (a NUL byte or no valid UTF-8) or ``outside`` (a path that is absolute or
    climbs).  Text is null unless ``ok``.  ``root`` is any URI that Spark reads.
    Spark's reader doesn't show files of no bytes, so these count as missing.
    """
    inside = ~(F.col("path").rlike(r"(^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$))"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # the listing gives qualified paths: what follows the qualified root is the corpus path
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")
    tail = F.substring(F.col("path"), len(top) + 2, 2**31 - 1)
    found = files.select(tail.alias("path"), "content")
    joined = manifest.join(found, "path", "left")
    valid = F.expr("is_valid_utf8(cast(content as string))")
    nul = F.position(F.lit(b"\0"), F.col("content")) > 0
    status = (
        F.when(~inside, "outside")
        .when(F.col("content").isNull(), "missing")
        .when(F.sha2("content", 256) != F.col("sha256"), "changed")
        .when(~valid | nul, "binary")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).select("path", "status", F.when(F.col("status") == "ok", F.decode("content", "utf-8")).alias("text"))


def numbered_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, line, text)``, lines from 1; null and empty texts have none."""
    return docs.where(F.length(text) > 0).select(F.col(id), F.posexplode(lines(F.col(text))).alias("line", "text")).withColumn("line", F.col("line") + 1)


def map_ranges(ranges: DataFrame, docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """``ranges (id, start, end, suffix)`` with ``mapping_status`` and ``excerpt``; unmappable rows stay in place."""
    held = docs.select(F.col(id), lines(F.col("text")).alias("_l"))
    ok = F.col("_l").isNotNull() & ~F.col("suffix").isin("png", "jpg", "gif", "svg") & (F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.size("_l"))
    return (
        ranges.join(held, id, "left")
        .withColumn("mapping_status", F.when(F.coalesce(ok, F.lit(False)), "mapped").otherwise("unmappable"))
        .withColumn("excerpt", F.when(F.col("mapping_status") == "mapped", F.array_join(F.slice("_l", F.col("start"), F.col("end") - F.col("start") + 1), "\n")))
        .drop("_l")
    )


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def above(path: Column) -> Column:
    """All directories above a path, nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def complete_cases(files: DataFrame, markers: tuple[str, ...] = ("Allrun", "Allclean")) -> DataFrame:
    """``(case)``: directories of ``files (path)`` that hold all markers and lie in no other such directory."""
    held = files.where(name(F.col("path")).isin(*markers)).select(parent(F.col("path")).alias("case"), name(F.col("path")).alias("m"))
    cases = held.groupBy("case").agg(F.countDistinct("m").alias("n")).where(F.col("n") == len(markers)).select("case")
    nested = cases.select("case", F.explode(above(F.col("case"))).alias("up")).where("up <> case").join(cases.select(F.col("case").alias("up")), "up", "left_semi")
    return cases.join(nested.select("case").distinct(), "case", "left_anti")


def first_readme(files: DataFrame, spellings: tuple[str, ...] = ("README.md", "README", "readme.md", "Readme.md", "README.txt")) -> DataFrame:
    """``(case, readme)``: of each directory the file whose spelling comes first."""
    place = F.array_position(F.array(*map(F.lit, spellings)), name(F.col("path")))
    return files.where(place > 0).groupBy(parent(F.col("path")).alias("case")).agg(F.min_by("path", place).alias("readme"))


def longest_owner(paths: DataFrame, cases: DataFrame) -> DataFrame:
    """``(path, owner)``: the longest case that is a directory above the path, else null; an equi-join on prefixes.

    Up to ``BROADCAST_CASES`` cases are sent to all tasks, so what stands above
    paths is not shuffled, only what is a case.
    """
    known = cut(cases.select("case").distinct(), "cases")
    sent = F.broadcast(known) if known.count() <= BROADCAST_CASES else known
    up = paths.select("path", F.explode(above(F.col("path"))).alias("case"))
    best = up.join(sent, "case").groupBy("path").agg(F.max_by("case", F.length("case")).alias("owner"))
    return paths.select("path").join(best, "path", "left")


def time_values(names: DataFrame, by: str, column: str = "name", cap: int = 240) -> DataFrame:
    """Names that are numbers, the first ``cap`` by text, numbered by value: ``(by, name, value, place)``."""
    ok = names.where(F.col(column).rlike(r"^[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")).select(by, F.col(column).alias("name")).distinct()
    capped = ok.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("name"))).where(F.col("_r") <= cap).drop("_r")
    value = capped.withColumn("value", F.col("name").cast("double"))
    return value.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("value", "name")))


def case_logs(files: DataFrame) -> DataFrame:
    """``log.*`` files with no directory named ``processor*`` or with a dot first above them."""
    hidden = F.exists(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), lambda p: p.startswith("processor") | p.startswith("."))
    return files.where(name(F.col("path")).rlike(r"^log\..") & ~hidden).select("path").distinct()


def probe_fields(files: DataFrame, probes: str) -> DataFrame:
    """``(case, field)``: names of files with bytes at ``<case>/postProcessing/<probes>/<time>/<field>``."""
    pattern = rf"^(.*)/postProcessing/{probes}/[^/]+/([^/]+)$"
    return files.where((F.col("size") > 0) & F.col("path").rlike(pattern)).select(F.regexp_extract("path", pattern, 1).alias("case"), F.regexp_extract("path", pattern, 2).alias("field")).distinct()


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line, event)`` of zstandard-packed JSON lines, of any number of frames in a file."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for name_, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                reader = zstandard.ZstdDecompressor().stream_reader(pa.BufferReader(content.as_buffer()), read_across_frames=True)
                held: list[tuple[int, str]] = []
                for k, line in enumerate(io.TextIOWrapper(reader, "utf-8", errors="replace"), 1):
                    if line.strip():
                        held.append((k, line.rstrip("\n")))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_pydict({"path": [name_] * len(held), "line": [a for a, _ in held], "event": [b for _, b in held]})
                        held = []
                yield pa.RecordBatch.from_pydict({"path": pa.array([name_] * len(held), pa.string()), "line": pa.array([a for a, _ in held], pa.int64()), "event": pa.array([b for _, b in held], pa.string())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, "path string, line long, event string")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases ``(id, body)`` of JSON files: an array, or an object with ``cases`` or ``tasks``.

    A missing id is ``case_id`` or ``case_<place>``; ids that repeat are an error.
    """
    raw = spark.read.text(path, wholetext=True)
    body = F.coalesce(F.get_json_object("value", "$.cases"), F.get_json_object("value", "$.tasks"), F.col("value"))
    each = raw.select(F.posexplode(F.from_json(body, "array<string>")).alias("k", "body"))
    own = F.coalesce(F.get_json_object("body", "$.id"), F.get_json_object("body", "$.case_id"), F.concat(F.lit("case_"), (F.col("k") + 1).cast("string")))
    cases = each.select(own.alias("id"), "body")
    again = F.count("*").over(Window.partitionBy("id"))
    return cases.withColumn("id", F.when(again == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("case id repeats: "), F.col("id")))))


def read_records(spark: SparkSession, path: str, schema: str, id: str) -> DataFrame:
    """Rows of JSON files that hold one array of objects each: questions, annotations, evidence.  An ``id`` that is null or repeats is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)
    once = (F.count("*").over(Window.partitionBy(id)) == 1) & F.col(id).isNotNull()
    return rows.withColumn(id, F.when(once, F.col(id)).otherwise(F.raise_error(F.concat(F.lit("id is missing or repeats: "), F.coalesce(F.col(id).cast("string"), F.lit("null"))))))


def read_vectors(spark: SparkSession, path: str, manifest: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """A vector index whose ``manifest`` (one row ``rows, dim``) must hold of it: another count of rows or distinct keys, or a vector of another size or with a null or NaN, is an error."""
    vectors, said = spark.read.parquet(path), manifest.select("rows", "dim").first()
    wrong = F.col(vector).isNull() | (F.size(vector) != said["dim"]) | F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    found = vectors.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(wrong).alias("wrong")).first()
    if found["wrong"] or found["rows"] != said["rows"] or found["keys"] != said["rows"]:
        raise ValueError(f"the index has {found['rows']} rows, {found['keys']} keys and {found['wrong']} vectors that don't fit; its manifest says {said['rows']} of {said['dim']}")
    return vectors


def read_npy(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """``(file, row, embedding)`` of the ``.npy`` matrices below ``path``, each with the digest and shape that ``manifest (file, sha256, rows, dim)`` says.

    A file that is missing, changed or of another shape is an error; the files
    of an index are parts of one matrix, ``row`` counts within a file.
    """
    import numpy as np

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name_, content, rows, dim in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                matrix = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                if matrix.shape != (rows, dim):
                    raise ValueError(f"{name_} is {matrix.shape}, its manifest says {(rows, dim)}")
                for lo in range(0, rows, 4096):
                    part = matrix[lo : lo + 4096].astype(np.float64)
                    ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * dim)
                    yield pa.RecordBatch.from_arrays([pa.array([name_] * len(part)), pa.array(np.arange(lo, lo + len(part))), pa.ListArray.from_arrays(ends, pa.array(part.reshape(-1)))], ["file", "row", "embedding"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select(name(F.col("path")).alias("file"), "content")
    held = manifest.join(files, "file", "left")
    right = F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False))
    content = F.when(right, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("missing or changed: "), "file")).cast("binary"))
    return held.select("file", content.alias("content"), F.col("rows").cast("long"), F.col("dim").cast("long")).mapInArrow(load, "file string, row long, embedding array<double>")


def read_graph(spark: SparkSession, path: str, node: str, edge: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of JSON files ``{"nodes": [..], "edges": [..]}`` by their schemas, which have ``id`` and ``source, target``.

    An id that is null or repeats, or an edge whose end is no node, is an error.
    """
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<nodes:array<struct<{node}>>,edges:array<struct<{edge}>>>", {"mode": "FAILFAST"}).alias("g"))
    nodes, edges = raw.select(F.explode("g.nodes").alias("n")).select("n.*"), raw.select(F.explode("g.edges").alias("e")).select("e.*")
    once = F.col("id").isNotNull() & (F.count("*").over(Window.partitionBy("id")) == 1)
    nodes = nodes.withColumn("id", F.when(once, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("node id is missing or repeats: "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))))
    known = nodes.select(F.col("id").alias("_id"), F.lit(True).alias("_known"))
    for end in ("source", "target"):
        checked = edges.join(known, F.col(end) == F.col("_id"), "left")
        edges = checked.withColumn(end, F.when(F.col("_known"), F.col(end)).otherwise(F.raise_error(F.concat(F.lit(f"edge {end} is no node: "), F.coalesce(F.col(end).cast("string"), F.lit("null")))))).drop("_id", "_known")
    return nodes, edges


def grep(docs: DataFrame, pattern: str, include: str | None = None, id: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """``(id, line, text)`` of lines that match ``pattern``, of texts whose ``path`` the glob ``include`` matches, all without one."""
    some = docs if include is None else docs.where(F.col(path).rlike(glob_regex(include)))
    return numbered_lines(some, id, text).where(F.col("text").rlike(pattern))


def manifest_of(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, sha256, bytes)`` of each row."""
    return df.select(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes"))


def to_json_text(value) -> str:
    """Canonical JSON: sorted keys, no blanks."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
