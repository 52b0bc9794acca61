"""Language identification by compression.

For each language a raw-content zstandard dictionary is made from labelled
texts.  Texts are lower-cased and ASCII characters other than letters become
blanks.  A whole text is cut into blocks of 2,000 bytes at most, each block is
compressed with each language's dictionary, and the language with the smallest
sum over all blocks wins.  The margin is the share by which the second smallest
sum exceeds the smallest.  Where it is narrow the text is compressed again at a
higher level; texts whose margin is still below ``min_margin`` are rejected.

The dictionaries are the only thing learned.  They come from a bounded sample:
of each language the ``sample_docs`` labelled texts with the least hash of
their id, up to ``dictionary_bytes`` bytes in that order.  More than
``max_languages`` languages are an error.

Null texts and texts without a letter are ``und``, with score 0 and not
accepted; so is every text when nothing was learned.  The score is
``margin / (margin + 0.02)``, from 0 to 1.  Ties go to the language with most
labelled texts.  Long texts are compressed block by block.  Repeated rows are
judged each; labelled rows that repeat an id and language count once, with the
least text.  An empty table gives an empty table.  Other columns pass through;
those named like an output are replaced.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import held

BLOCK_BYTES = 2_000
#: Compression level; and that of the second try, below that margin.
LEVEL, LEVEL_AGAIN, NARROW = 6, 12, 0.01
#: ASCII other than letters to blanks.
_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 or 65 <= c <= 90 else 32 for c in range(256))


def learn_languages(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    id: str = "doc_id",
    sample_docs: int = 64,
    dictionary_bytes: int = 65_536,
    max_languages: int = 200,
) -> dict[str, bytes]:
    """A raw dictionary for each language; rows with a null language or text are left out."""
    rows = labelled.select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        "lang is not null and text is not null"
    )
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()
    if len(most) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string")), "id")
    # ids are ranked first (each task keeps its own best), then their texts are fetched
    best = rows.select("id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample_docs)
    best = best.groupBy("id", "lang").agg(F.min("place").alias("place"))
    found = rows.join(F.broadcast(best), ["id", "lang"]).groupBy("lang", "place").agg(F.min(F.substring("text", 1, dictionary_bytes)).alias("text"))
    texts: dict[str, list] = {}
    for r in found.collect():  # at most sample_docs * max_languages rows
        texts.setdefault(r["lang"], []).append((r["place"], r["text"]))
    counts = {r["lang"]: r["count"] for r in most}
    return {
        k: normal("\n".join(t for _, t in sorted(v)))[:dictionary_bytes]
        for k, v in sorted(texts.items(), key=lambda x: (-counts[x[0]], x[0]))
    }


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())


class CompressionClassifier:
    """``dictionaries`` in the order in which ties are decided."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.tools = [[self._tool(d, level) for d in dictionaries.values()] for level in (LEVEL, LEVEL_AGAIN)]

    @staticmethod
    def _tool(data: bytes, level: int) -> zstandard.ZstdCompressor:
        own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)

    def classify(self, text: str | None) -> tuple[str | None, float]:
        """The language and the margin; none for texts without a letter."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return None, 0.0
        data = normal(text)
        if len(self.names) == 1:
            return self.names[0], 1.0
        n = max(1, -(-len(data) // BLOCK_BYTES))
        step = max(1, -(-len(data) // n))
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        for tools in self.tools:
            sizes = sorted((sum(len(tool.compress(b)) for b in blocks), k) for k, tool in enumerate(tools))
            margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if sizes[1][0] else 0.0
            if margin >= NARROW:
                break
        return self.names[sizes[0][1]], margin


def identify_language(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = 0.004) -> DataFrame:
    """``df`` with ``lang_pred string, score double, accepted boolean``."""
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)
    name = uuid.uuid4().hex

    @arrow_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def classify(texts: pa.Array) -> pa.Array:
        own = held(("languages", name), lambda: CompressionClassifier(shared.value))
        found = [own.classify(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays(
            [
                pa.array([lang or "und" for lang, _ in found], pa.string()),
                pa.array([m / (m + 0.02) for _, m in found], pa.float64()),
                pa.array([lang is not None and m >= min_margin for lang, m in found], pa.bool_()),
            ],
            ["lang_pred", "score", "accepted"],
        )

    return df.drop("lang_pred", "score", "accepted").withColumn("_l", classify(F.col(text))).select("*", "_l.*").drop("_l")
