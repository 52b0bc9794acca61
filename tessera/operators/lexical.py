"""Postings of units, a row for each, and the best units of each query, kept by each task.

Nothing here is dealt out by term or by pair of query and unit: a task counts the asked terms of its own units, weighs
its own postings, and passes on the best units of each query only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tessera.functions.text import STOP

#: Bytes of texts that are taken at once, products of a posting and a query that are, and rows that a task holds.
TEXT_BYTES, PRODUCTS, HELD = 4_000_000, 500_000, 200_000
#: Words that a worker remembers.
REMEMBERED = 200_000

_WORD = np.zeros(256, bool)
_WORD[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")] = True
_DIGITS = "0123456789"
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|\Z)|[0-9]+")
_CJK = re.compile("[一-鿿]+")
_STOPS = frozenset(STOP)


def word_tokens(word: str, last: bool) -> list[str]:
    """What ``tokens()`` makes of a run of letters, digits and underscores; ``last`` if no other identifier follows in its text."""
    word = word.lstrip(_DIGITS)
    if not word:
        return []
    # a blank keeps the end of the text away, as the next identifier's would
    return [x for x in map(str.lower, [word, *_PIECE.findall(word if last else word + " ")]) if x not in _STOPS]


def cjk_tokens(text: str) -> list[str]:
    return [run[i : i + 2] for run in _CJK.findall(text) for i in range(max(1, len(run) - 1))]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each range, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` in all, or of one row."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def runs(texts: pa.StringArray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Bytes of all texts, where each text ends, and of each run of bytes of ``kinds`` its text and its place among the distinct runs, which come last."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    inside = kinds[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = ends[:-1][ends[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    where = np.flatnonzero(begins)
    if not len(where):
        return data, ends, where, where, []
    kept = data[inside]
    bounds = np.append((np.cumsum(inside) - 1)[where], len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(where), pa.py_buffer(bounds), pa.py_buffer(kept)).dictionary_encode()
    return data, ends, np.searchsorted(ends, where, "right") - 1, words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()


class Counter:
    """Counts the terms that are asked for in texts, as ``tokens()`` finds them."""

    def __init__(self, terms: dict[str, int]):
        self.terms, self.known = terms, {}

    def of(self, word: str, last: bool) -> tuple[int, list[int]]:
        """How many tokens a word gives, and the ids of those that are asked for."""
        key = (word, last)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            made = word_tokens(word, last)
            found = self.known[key] = (len(made), [self.terms[x] for x in made if x in self.terms])
        return found

    def count(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The number of tokens of each text; and text, term and count of each posting, in order."""
        data, ends, text, word, distinct = runs(texts, _WORD)
        n, at, ids = len(texts), [], []
        lengths = np.zeros(n, np.int64)
        if distinct:
            found = [self.of(x, False) for x in distinct]
            named = np.array([not x.isdigit() for x in distinct])[word]  # digits alone are no identifier
            word, text = word[named], text[named]
            capital = np.array(["A" <= x[-1] <= "Z" for x in distinct])
            last = np.flatnonzero(np.append(text[1:] != text[:-1], True)) if len(text) else np.zeros(0, np.int64)
            for k in last[capital[word[last]]]:
                found.append(self.of(distinct[word[k]], True))
                word[k] = len(found) - 1
            lengths += np.bincount(text, np.array([x[0] for x in found], float)[word], n).astype(np.int64)
            counts = np.array([len(x[1]) for x in found], np.int64)
            flat = np.array([i for x in found for i in x[1]], np.int64)
            at.append(np.repeat(text, counts[word]))
            ids.append(flat[ranges((np.cumsum(counts) - counts)[word], counts[word])])
        wide = np.flatnonzero((data >= 0xE4) & (data <= 0xE9))
        for k in np.unique(np.searchsorted(ends, wide, "right") - 1) if len(wide) else ():
            made = cjk_tokens(data[ends[k] : ends[k + 1]].tobytes().decode("utf-8", "replace"))
            lengths[k] += len(made)
            ids.append(np.array([self.terms[x] for x in made if x in self.terms], np.int64))
            at.append(np.full(len(ids[-1]), k))
        size = max(1, len(self.terms))
        key, count = np.unique(np.concatenate(at) * size + np.concatenate(ids), return_counts=True) if at else (np.zeros(0, np.int64),) * 2
        return lengths, key // size, key % size, count


def postings(units: DataFrame, terms: dict[str, int], asked_by: np.ndarray, key: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``(key, *keep, length, visits, ids, tfs)``: a row for each unit; ``visits`` counts postings by the queries that ask for each."""
    shared = units.sparkSession.sparkContext.broadcast((terms, asked_by))
    kinds = {f.name: f for f in units.schema.fields}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asking = shared.value
        counter = Counter(known)
        for batch in batches:
            whole = batch.column(batch.num_columns - 1)
            whole = pc.fill_null(whole, "").cast(pa.string())
            for a, b in slices(pc.binary_length(whole).to_numpy(zero_copy_only=False), TEXT_BYTES):
                lengths, at, ids, tfs = counter.count(whole.slice(a, b - a))
                bounds = pa.array(np.searchsorted(at, np.arange(b - a + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (ids, tfs)]
                visits = np.bincount(at, asking[ids], b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], pa.array(lengths, pa.int32()), pa.array(visits), *lists], names)

    made = [StructField("length", IntegerType()), StructField("visits", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("tfs", ArrayType(IntegerType()))]
    schema = StructType([kinds[key], *(kinds[c] for c in keep), *made])
    names = schema.names
    return units.select(key, *keep, text).mapInArrow(count, schema)


#: As words of literals go: all other characters of words are written as this one, and the rest that isn't ASCII as blanks.
LETTER = "é"
_LETTERED = _WORD.copy()
_LETTERED[list(LETTER.encode())] = True
_INSIDE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_" + LETTER)


def stands(literal: str, text: str) -> bool:
    """Whether a text has ``literal`` between characters of no word."""
    k = text.find(literal)
    while k >= 0:
        if (k == 0 or text[k - 1] not in _INSIDE) and text[k + len(literal) : k + len(literal) + 1] not in _INSIDE:
            return True
        k = text.find(literal, k + 1)
    return False


class Literals:
    """Finds the literals that are asked for in texts and paths."""

    def __init__(self, literals: dict[str, int]):
        self.size, self.alone, self.longer, self.starts, self.known = max(1, len(literals)), {}, {}, {}, {}
        for x, i in literals.items():
            word = re.match(r"[A-Za-z_0-9]+", x)[0]
            if word == x:
                self.alone[x] = i
            else:
                self.longer.setdefault(word, []).append((x, i))
            self.starts.setdefault(x[:3], []).append((x, i))

    def below(self, path: str | None) -> list[int]:
        """Those that a path holds."""
        if path not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            p = path or ""
            grams = {p[k : k + n] for k in range(len(p)) for n in (1, 2, 3)}
            self.known[path] = [i for g in grams for x, i in self.starts.get(g, ()) if x in p]
        return self.known[path]

    def find(self, texts: pa.StringArray, paths: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, literal and weight of each find, in order: 4 in a path, else 1."""
        _, _, text, word, distinct = runs(texts, _LETTERED)
        alone, longer = np.array([self.alone.get(x, -1) for x in distinct], np.int64), [self.longer.get(x) for x in distinct]
        ids = alone[word] if distinct else word
        found = [(text * self.size + ids)[ids >= 0]]
        some = np.flatnonzero(np.array([x is not None for x in longer], bool)[word]) if distinct else word
        more, held, whole = [], -1, ""
        for key in np.unique(text[some] * max(1, len(distinct)) + word[some]):
            k, w = divmod(int(key), len(distinct))
            if k != held:
                held, whole = k, texts[k].as_py()
            more += [k * self.size + i for x, i in longer[w] if stands(x, whole)]
        found.append(np.array(more, np.int64))
        above = np.array([k * self.size + i for k, p in enumerate(paths) for i in self.below(p)], np.int64)
        key = np.unique(np.concatenate([*found, above]))
        return key // self.size, key % self.size, np.where(np.isin(key, above), 4, 1)


def literal_postings(units: DataFrame, literals: dict[str, int], key: str, text: str, path: str | None) -> DataFrame:
    """``(key, ids, weights)``: a row for each unit; of ``text`` each character of a word that isn't ASCII is ``LETTER``."""
    shared = units.sparkSession.sparkContext.broadcast(literals)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Literals(shared.value)
        for batch in batches:
            whole, paths = pc.fill_null(batch.column(1), "").cast(pa.string()), batch.column(2).to_pylist() if path else []
            for a, b in slices(pc.binary_length(whole).to_numpy(zero_copy_only=False), TEXT_BYTES):
                at, ids, weights = known.find(whole.slice(a, b - a), paths[a:b])
                bounds = pa.array(np.searchsorted(at, np.arange(b - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (ids, weights))], names)

    schema = StructType([units.schema[key], StructField("ids", ArrayType(IntegerType())), StructField("weights", ArrayType(IntegerType()))])
    names = schema.names
    return units.select(key, text, *[path] * bool(path)).mapInArrow(find, schema)


class Best:
    """The best ``limit`` rows of each query so far, by score and then by key; rows that can't be among them go at once."""

    def __init__(self, limit: int, queries: int, key: str):
        self.limit, self.floor, self.held, self.rows, self.after = limit, np.zeros(queries), [], 0, HELD // 4
        self.order = [("_q", "ascending"), ("score", "descending"), (key, "ascending")]

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        """Takes on the scores above zero of ``rows``; gives those that there is no room for."""
        some = np.flatnonzero((score > 0) & (score >= self.floor[query]))
        if not len(some):
            return
        taken = rows.take(pa.array(row[some]))
        self.held.append(pa.table([pa.array(query[some]), pa.array(score[some]), *taken.columns], ["_q", "score", *taken.schema.names]))
        self.rows += len(some)
        if self.rows > self.after:
            kept = self.reduced()
            if len(kept) > HELD:
                yield kept
                self.held, self.rows = [], 0
            self.after = max(HELD // 4, 2 * self.rows)

    def reduced(self) -> pa.Table:
        table = pa.concat_tables(self.held)
        table = table.take(pc.sort_indices(table, sort_keys=self.order, null_placement="at_start"))
        query = table.column("_q").to_numpy()
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        full = place == self.limit - 1
        # what was passed on before counts too, so a floor never falls
        self.floor[query[full]] = np.maximum(self.floor[query[full]], table.column("score").to_numpy()[full])
        table = table.filter(pa.array(place < self.limit))
        self.held, self.rows = [table], len(table)
        return table

    def rest(self) -> Iterator[pa.Table]:
        if self.rows:
            yield self.reduced()


def summed(key: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur, below ``size``, and the sums of their values."""
    if size <= 8 * len(key):
        occurs = np.bincount(key, minlength=size)
        some = np.flatnonzero(occurs)
        return some, np.bincount(key, value, size)[some]
    some, at = np.unique(key, return_inverse=True)
    return some, np.bincount(at, value, len(some))


def ranked(
    rows: DataFrame,
    weigh: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]],
    asked: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray],
    key: StructField,
    query: StructField,
    keep: list[StructField],
    limit: int,
) -> DataFrame:
    """``(query, key, *keep, score)``: of each task the best ``limit`` rows of each query; the first columns of ``rows`` are ``key`` and ``keep``.

    ``weigh`` gives row, term and weight of the postings of a batch, by rows.
    ``asked`` has the queries, where the askers of each term begin, which they
    are, and how often they ask.
    """
    shared = rows.sparkSession.sparkContext.broadcast(asked)
    names = [key.name, *(f.name for f in keep)]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, bounds, asker, often = shared.value
        asking, found = np.diff(bounds), Best(limit, len(queries), key.name)

        def out(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
            for t in tables:
                columns = [queries.take(t.column("_q").combine_chunks()), *(t.column(c) for c in names), t.column("score")]
                yield from pa.table(columns, [query.name, *names, "score"]).to_batches(max_chunksize=10_000)

        for batch in batches:
            known = pa.RecordBatch.from_arrays(batch.columns[: len(names)], names)
            row, term, weight = weigh(batch)
            visits = np.bincount(row, asking[term], batch.num_rows).astype(np.int64)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for a, b in slices(visits, PRODUCTS):
                own = slice(edges[a], edges[b])
                t, n = term[own], asking[term[own]]
                at = ranges(bounds[:-1][t], n)
                pair, score = summed(np.repeat(row[own] - a, n) * len(queries) + asker[at], np.repeat(weight[own], n) * often[at], (b - a) * len(queries))
                if len(pair):
                    yield from out(found.add(pair % len(queries), np.round(score, 6), pair // len(queries) + a, known))
        yield from out(found.rest())

    return rows.mapInArrow(best, StructType([query, key, *keep, StructField("score", DoubleType())]))


def lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The row of each entry of a column of lists, and the entries."""
    column = batch.column(batch.schema.get_field_index(name))
    return np.repeat(np.arange(batch.num_rows), pc.list_value_length(column).to_numpy(zero_copy_only=False)), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def by_term(asked: pa.Table, query: str, term: str, often: str) -> tuple[dict[str, int], tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """The ids of the terms that are asked for, and ``asked`` as :func:`ranked` takes it."""
    coded = pc.dictionary_encode(asked.column(query).combine_chunks(), null_encoding="encode")
    names = pc.dictionary_encode(asked.column(term).combine_chunks())
    coded, names = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (coded, names))
    term_id = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(term_id, kind="stable")
    bounds = np.searchsorted(term_id[order], np.arange(len(names.dictionary) + 1))
    return {x: i for i, x in enumerate(names.dictionary.to_pylist())}, (coded.dictionary, bounds, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order], asked.column(often).to_numpy().astype(float)[order])
