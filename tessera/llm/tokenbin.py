"""Token-id files in Simple-8b words.

A file holds the ids of consecutive documents:

    b"S8BT" u32 version
    blocks: u64 words, one block after another
    footer: i64 doc_id[n_docs], u64 n_tokens[n_docs],
            u64 block_word[n_blocks + 1], u64 block_id[n_blocks + 1]
    u64 n_docs, u64 n_blocks, b"S8BE" u32 version

A word's top four bits select how many ids of how many bits its other sixty
hold.  Selector 15 is the escape: the whole next word is one id, for ids of
more than 60 bits.  A block has at most ``BLOCK`` ids and can be decoded
alone, by its offsets in words and ids.

Files are written by tasks that each hold one range of the order, under a name
of the attempt, and moved to their final name when whole, so a task that is run
again leaves the same files.  Null text counts as empty and still gets its end
id.  Rows that repeat a ``doc_id`` are each kept, ordered by a hash of the text.
Null ids come first; a file holds the least long for them.  An empty table gives
no file.  Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held

#: Ids in a word and bits of each, by selector 0 to 14; fixed values of the format.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
BLOCK = 65_536
MAGIC, END, VERSION = b"S8BT", b"S8BE", 1
#: Runs that a worker's table holds, and bits that tell whether a run was met before.
CACHE, MET = 400_000, 1 << 24
SCHEMA = "part int, file int, n_docs long, n_ids long"
#: Bytes of runs that go to the library as one text; longer ones outgrow the processor's caches.
JOINED = 16_384
#: ASCII marks that the pattern never joins to a letter or digit before them, and which bytes are ASCII letters and digits.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
#: Rows and bytes of text that are encoded at once.
ROWS, TEXT = 10_000, 8_000_000
#: White space, and a blank inside of it, at which runs are not cut; for Arrow, whose ``\s`` is that of ASCII.
_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_GLUED = rf"[{_SPACE}] (?:[{_SPACE}]|\z)"
#: The id that stands for null in a file.
NO_ID = -(2**63)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, as int8."""
    if not len(ids) or int(ids.max()) < 1 << 53:
        return np.frexp(ids.astype(np.float64))[1].astype(np.int8)
    # above 53 bits a float would round
    high = np.frexp((ids >> np.uint64(32)).astype(np.float64))[1]
    low = np.frexp((ids & np.uint64(2**32 - 1)).astype(np.float64))[1]
    return np.where(high > 0, high + 32, low).astype(np.int8)


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned ids; each word takes as many as fit."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    # the first selector whose whole run fits, at each place: the widest id of
    # runs of c ids is the wider one of two shorter runs that cover them
    most, wide, pick = 1, _widths(ids), np.full(n, ESCAPE, np.int8)
    for s in range(len(COUNTS) - 1, -1, -1):
        c = COUNTS[s]
        if c > n:
            break
        while most < c:
            step = min(most, c - most)
            wide = np.maximum(wide[:-step], wide[step:])
            most += step
        pick[: n + 1 - c][wide <= WIDTHS[s]] = s
    step = np.array([*COUNTS, 1, 1], np.int64)[pick].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, np.int64)
    sel = pick[starts]
    place = np.cumsum(1 + (sel == ESCAPE)) - 1 - (sel == ESCAPE)
    words = np.zeros(int(len(starts) + (sel == ESCAPE).sum()), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        at, to = starts[sel == s], place[sel == s]
        if s == ESCAPE:
            words[to + 1] = ids[at]
            continue
        for k in range(COUNTS[s]):
            words[to] |= ids[at + k] << np.uint64(k * WIDTHS[s])
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """Ids of Simple-8b words."""
    words = np.asarray(words, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    marks = np.flatnonzero(sel == ESCAPE)
    raw = np.zeros(len(words), bool)
    for i in marks.tolist():  # a raw word may itself look like an escape
        if not raw[i]:
            raw[i + 1] = True
    counts = np.array([*COUNTS, 0, 0], np.int64)[sel]
    counts[raw] = 1
    counts[(sel == ESCAPE) & ~raw] = 0
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    out[first[raw]] = words[raw]
    for s in np.unique(sel[~raw]):
        if s == ESCAPE:
            continue
        at = np.flatnonzero((sel == s) & ~raw)
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s]):
            out[first[at] + k] = (words[at] >> np.uint64(k * WIDTHS[s])) & mask
    return out


class FileWriter:
    """Writes one file, holding one block of ids and the footer's columns."""

    def __init__(self, sink):
        self.sink, self.n_ids = sink, 0
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.words_at, self.ids_at = [0], [0]
        self.held: list[np.ndarray] = []
        self.n_held = 0
        sink.write(MAGIC + struct.pack("<I", VERSION))

    def add(self, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.asarray(doc_ids, np.int64))
        self.sizes.append(np.asarray(sizes, np.uint64))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK:
            ids = np.concatenate(self.held)
            whole = len(ids) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(ids[i : i + BLOCK])
            self.held, self.n_held = [ids[whole:].copy()], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        words = pack(ids)
        self.sink.write(words.astype("<u8").tobytes())
        self.words_at.append(self.words_at[-1] + len(words))
        self.ids_at.append(self.ids_at[-1] + len(ids))

    def close(self) -> tuple[int, int]:
        if self.n_held:
            self._block(np.concatenate(self.held))
        docs = np.concatenate([np.empty(0, np.int64), *self.docs])
        sizes = np.concatenate([np.empty(0, np.uint64), *self.sizes])
        self.sink.write(docs.astype("<i8").tobytes() + sizes.astype("<u8").tobytes())
        self.sink.write(np.array(self.words_at + self.ids_at, "<u8").tobytes())
        self.sink.write(struct.pack("<QQ", len(docs), len(self.words_at) - 1) + END + struct.pack("<I", VERSION))
        return len(docs), self.ids_at[-1]


def read_documents(source) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Runs of (doc_ids, starts in the file, ids of each) of an open file, block after block.

    One block is held at a time, and the ids of a document that goes on in the next.
    """
    size = source.size()
    if size < 32 or source.read_at(4, 0) != MAGIC or source.read_at(4, size - 8) != END:
        raise ValueError("not a token-id file")
    n_docs, n_blocks = struct.unpack("<QQ", source.read_at(16, size - 24))
    at = size - 24 - 16 * n_docs - 16 * (n_blocks + 1)
    footer = source.read_at(size - 24 - at, at)
    docs = np.frombuffer(footer, "<i8", n_docs)
    sizes = np.frombuffer(footer, "<u8", n_docs, 8 * n_docs).astype(np.int64)
    words_at, ids_at = np.frombuffer(footer, "<u8", 2 * (n_blocks + 1), 16 * n_docs).astype(np.int64).reshape(2, -1)
    ends = np.cumsum(sizes)
    held: list[np.ndarray] = []
    held_at, d = 0, 0
    for b in range(n_blocks):
        first = int(words_at[b])
        words = np.frombuffer(source.read_at(8 * (int(words_at[b + 1]) - first), 8 + 8 * first), "<u8")
        held.append(unpack(words).astype(np.uint32))
        upto = int(np.searchsorted(ends, ids_at[b + 1], "right"))
        if upto > d:
            ids = np.concatenate(held)
            starts = ends[d:upto] - sizes[d:upto]
            yield docs[d:upto], starts, [ids[s - held_at : e - held_at] for s, e in zip(starts, ends[d:upto])]
            held = [ids[int(ends[upto - 1]) - held_at :].copy()]
            held_at, d = int(ends[upto - 1]), upto


def _words_and_marks(runs: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
    """Each run as a word and the marks behind its last letter or digit; runs that don't end so are words whole."""
    runs = runs.cast(pa.large_string())
    _, ends, data = runs.buffers()
    ends = np.frombuffer(ends, np.int64, len(runs) + 1, 8 * runs.offset)
    cuts = ends[:-1] + pc.binary_length(pc.ascii_rtrim(runs, MARKS)).to_numpy()
    some = np.flatnonzero((cuts > ends[:-1]) & (cuts < ends[1:]))
    some = some[_ALNUM[np.frombuffer(data, np.uint8)[cuts[some] - 1]]] if len(some) else some
    # a word and its marks lie side by side in the bytes as they are
    bounds = np.empty(2 * len(runs) + 1, np.int64)
    bounds[::2], bounds[1::2] = ends, ends[1:]
    bounds[2 * some + 1] = cuts[some]
    parts = pa.Array.from_buffers(pa.large_string(), 2 * len(runs), [None, pa.py_buffer(bounds), data])
    at = np.arange(0, 2 * len(runs), 2)
    return parts.take(pa.array(at)).dictionary_encode(), parts.take(pa.array(at + 1)).dictionary_encode()


class LibraryEncoder:
    """Whole texts to ids by the tokenizers library, frequent runs of characters once.

    Runs are cut before blanks that don't stand inside white space; the
    pattern of a byte-level tokenizer never joins across such a cut, nor a letter
    or digit to marks behind it.  Arrow cuts the texts, then the distinct runs
    into words and marks, and finds the distinct words.  Those that
    are not in the table go to the library joined, many at once, and their ids
    are told apart by the bytes that each id stands for; runs with white space
    at their ends go there each on its own.  Texts with other
    white space, and those that hold an added token of the tokenizer, go to the
    library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        names = self.tok.get_vocab(with_added_tokens=False)
        # a byte-level entry has a character for each byte
        self.bytes_of = np.zeros(max([*names.values(), 0]) + 1, np.int64)
        self.bytes_of[list(names.values())] = list(map(len, names))
        # an added token with white space could arise where runs meet
        self.joins = not any(c.isspace() for x in self.added for c in x)
        #: ids of runs by what follows their blank
        self.known: dict[str, bytes] = {}
        self.met = bytearray(MET // 8)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _apart(self, text: str, ends: np.ndarray) -> list[bytes] | None:
        """Ids of the parts of a text that end at these bytes; None if some token reaches over an end."""
        ids = self._library(text)
        if ids.max() >= len(self.bytes_of):  # an added token
            return None
        upto = np.cumsum(self.bytes_of[ids])
        cuts = np.searchsorted(upto, ends)
        if cuts[-1] >= len(ids) or (upto[cuts] != ends).any():
            return None
        data, cuts = ids.tobytes(), (4 * cuts + 4).tolist()
        return [data[i:j] for i, j in zip([0, *cuts], cuts)]

    def _runs(self, runs: list[str], mark: str) -> list[bytes]:
        """Ids of runs that each follow a blank, which counts as theirs, or a line break, which doesn't.

        Where no white space can join a run to its neighbours, many are
        encoded as one text; a line break before a run that begins with no
        white space is a match of its own.
        """
        out: list[bytes | None] = [None] * len(runs)
        at = [k for k, r in enumerate(runs) if r and r.strip() == r] if self.joins else []
        sizes = np.array([1 + (len(r) if r.isascii() else len(r.encode())) for r in map(runs.__getitem__, at)], np.int64)
        groups = np.flatnonzero(np.diff(np.cumsum(sizes) // JOINED)) + 1
        for lo, hi in zip([0, *groups.tolist()], [*groups.tolist(), len(at)]):
            if lo == hi:
                continue
            ends = np.cumsum(sizes[lo:hi])
            if mark != " ":
                ends = np.stack([ends - sizes[lo:hi] + 1, ends], 1).ravel()
            coded = self._apart(mark + mark.join([runs[k] for k in at[lo:hi]]), ends)
            if coded is not None:
                for k, ids in zip(at[lo:hi], coded if mark == " " else coded[1::2]):
                    out[k] = ids
        before = " " if mark == " " else ""
        return [self._library(before + r).tobytes() if ids is None else ids for r, ids in zip(runs, out)]

    def _remember(self, runs: list[str], coded: list[bytes]) -> None:
        """From the second time on that a run is met; a full table keeps what it has."""
        known, met = self.known, self.met
        for run, ids in zip(runs, coded):
            slot = hash(run) % MET
            if met[slot >> 3] & 1 << (slot & 7):
                if len(known) < CACHE and len(run) < 48:
                    known[run] = ids
            else:
                met[slot >> 3] |= 1 << (slot & 7)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids of all, one text after another."""
        if not len(texts):
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _GLUED)
        for x in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, x))
        cells = pc.split_pattern(pc.if_else(whole, pa.scalar("", texts.type), texts), " ")
        at, flat = cells.offsets.to_numpy(), cells.values
        later = np.ones(len(flat), bool)
        later[at[:-1]] = False
        # runs after a blank, each distinct one once
        rest = flat.filter(pa.array(later)).dictionary_encode()
        words, marks = _words_and_marks(rest.dictionary)
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        coded = list(map(self.known.get, names))
        if None in coded:
            holes = [k for k, ids in enumerate(coded) if ids is None]
            missed = [names[k] for k in holes]
            new = self._runs(missed, " ")
            for k, ids in zip(holes, new):
                coded[k] = ids
            self._remember(missed, new)
        after = [self._library(x).tobytes() for x in marks.dictionary.to_pylist()]
        # the beginning of each text up to its first blank, or the text itself
        first = flat.take(pa.array(at[:-1])).dictionary_encode()
        heads, begins = self._runs(first.dictionary.to_pylist(), "\n"), first.indices.to_numpy().copy()
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            begins[k] = len(heads)
            heads.append(self._library(texts[k].as_py()).tobytes())
        # two places for each run; the second one is empty where no marks are
        values = [b"", *coded, *after, *heads]
        order, place = np.zeros((len(flat), 2), np.int32), rest.indices.to_numpy()
        order[later, 0] = 1 + words.indices.to_numpy()[place]
        order[later, 1] = 1 + len(coded) + marks.indices.to_numpy()[place]
        order[at[:-1], 0] = 1 + len(coded) + len(after) + begins
        joined = pa.array(values, pa.large_binary()).take(pa.array(order.ravel()))
        _, ends, data = joined.buffers()
        ends = np.frombuffer(ends, np.int64, len(joined) + 1, 8 * joined.offset)
        ids = np.frombuffer(data, "<u4", int(ends[-1] - ends[0]) // 4, int(ends[0])) if ends[-1] > ends[0] else np.empty(0, np.uint32)
        return np.diff(ends[2 * at]) // 4, ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit."""
        sizes, ids = self.encode_array(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes)
        return [ids[i:j].tobytes() for i, j in zip(ends - sizes, ends)]


def _place(folder: str):
    """The file system and path of a folder's URI."""
    from pyarrow.fs import FileSystem

    # the file:/path of Hadoop is file:///path to Arrow
    return FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``ROWS`` rows and about ``TEXT`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > lo and (held + n > TEXT or k - lo == ROWS):
            yield batch.slice(lo, k - lo)
            lo, held = k, 0
        held += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def write_token_files(
    df: DataFrame, folder: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", file_ids: int = 64_000_000
) -> DataFrame:
    """Write the ids of ``df`` to ``folder`` in ascending ``doc_id``; returns one row for each file.

    Runs when the result does.  ``folder`` is a URI that all executors reach.
    A file is closed after the document with which it reaches ``file_ids`` ids.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()
        own = held(("tokens", tokenizer), lambda: LibraryEncoder(tokenizer))
        fs, base = _place(folder)
        writer = sink = temp = None
        made = 0

        def closed() -> pa.RecordBatch:
            n_docs, n_ids = writer.close()
            sink.close()
            final = f"{base}/part-{part:06d}-{made:06d}.s8b"
            if fs.get_file_info(final).type:  # another attempt of this task has written the same
                fs.delete_file(temp)
            else:
                fs.move(temp, final)
            row = [part, made, n_docs, n_ids]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if k < 2 else pa.int64()) for k, x in enumerate(row)], ["part", "file", "n_docs", "n_ids"])

        for batch in batches:
            for rows in _parts(batch):
                docs = pc.fill_null(rows.column(0), NO_ID).to_numpy(zero_copy_only=False)
                sizes, ids = own.encode_array(rows.column(1))
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                ends = np.cumsum(sizes)
                lo = 0
                while lo < len(sizes):
                    if writer is None:
                        temp = f"{base}/.part-{part:06d}-{uuid.uuid4().hex}"
                        sink = fs.open_output_stream(temp)
                        writer = FileWriter(sink)
                    hi = min(len(sizes), int(np.searchsorted(ends, ends[lo] - sizes[lo] + file_ids - writer.n_ids)) + 1)
                    writer.add(docs[lo:hi], sizes[lo:hi], ids[ends[lo] - sizes[lo] : ends[hi - 1]])
                    lo = hi
                    if writer.n_ids >= file_ids:
                        yield closed()
                        writer, made = None, made + 1
        if writer is not None:
            yield closed()

    rows = df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    # rows of one id may lie in several ranges; rows that are wholly alike can change places
    placed = rows.withColumns({"h": F.xxhash64("t"), "m": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("d"), F.col("h"), F.col("m")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("d", "t").mapInArrow(write, SCHEMA)


def read_token_files(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """``(doc_id long, start long, ids binary)`` of the files in ``folder``.

    ``ids`` are little-endian unsigned 32-bit; ``start`` counts the ids of all
    documents before.  ``manifest`` has a row for each file, not for each
    document.  A task reads a file block by block.
    """
    before, rows = 0, []
    for m in sorted(manifest, key=lambda r: (r["part"], r["file"])):
        rows.append((f"part-{m['part']:06d}-{m['file']:06d}.s8b", before))
        before += m["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _place(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{base}/{name}") as source:
                    for docs, starts, lists in read_documents(source):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs, mask=docs == NO_ID), pa.array(starts + before), pa.array([x.astype("<u4").tobytes() for x in lists], pa.binary())],
                            ["doc_id", "start", "ids"],
                        )

    files = spark.createDataFrame(rows, "name string, before long").repartition(max(1, len(rows)))
    return files.mapInArrow(read, "doc_id long, start long, ids binary")
