"""Byte-level BPE of whole texts by a trie of distinct words.

A text is split into words as the tokenizer's pattern does.  The distinct words of a
batch that a worker does not know yet are inserted into a trie of bytes, which
is walked depth first, each word once.  The state of a node is the last token of the encoding
of its prefix.  A prefix p ends in token t exactly if t is a suffix of p and
the state s at the node ``len(t)`` bytes above goes with t, that is, if the
bytes of s and t together encode to (s, t): a row of tokens of which every two
neighbours go together is the encoding of its bytes, and the encoding is one,
so each node has one state.  It follows from states above it, so a prefix that
words share is encoded once.  A word's ids are read from its node upwards.

An entry that merging does not reach is never a state.  Added tokens of the
tokenizer are found in the text first, leftmost and longest, and are not split.

Null text counts as empty and yields no ids; very long words are taken whole,
in time that grows with their length.  Empty tables give empty tables, repeated
rows are encoded each, other columns pass through, and an input column with the
output's name is replaced.  A worker keeps the ids of up to ``KNOWN`` words.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.bpe import gathered, lists_of_ids
from tessera.llm.common import held

#: Words that a worker keeps the ids of, longest such word, and pairs of tokens that it keeps verdicts on.
KNOWN, LONGEST, PAIRS = 400_000, 48, 2_000_000
#: Bits that tell whether a word was met before; words are kept from their second time on.
MET = 1 << 23
#: New words for which a trie is built within a batch at the latest.
TRIE_WORDS = 50_000
#: Characters up to which the split is made here; a text with others is split by the tokenizer's own splitter,
#: as libraries may know different versions of Unicode.
PLAIN = 0x530
_OTHER = re.compile(f"[^\0-{chr(PLAIN - 1)}]")
#: White space among these characters.  A fixed value.
SPACE = r"\t-\r \x85\xa0"


def _of_kind(kind: str) -> str:
    """The characters below ``PLAIN`` of a general category, as ranges of a pattern's class."""
    codes = [c for c in range(PLAIN) if unicodedata.category(chr(c)).startswith(kind)]
    starts = [c for c in codes if c - 1 not in set(codes)]
    ends = [c for c in codes if c + 1 not in set(codes)]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends))


def splitter() -> re.Pattern:
    """The pattern of byte-level tokenizers, for texts of characters below ``PLAIN``."""
    letters, digits = _of_kind("L"), _of_kind("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{SPACE}{letters}{digits}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TrieCodec:
    """Encoder and decoder of one tokenizer file (byte-level BPE, no normalizer)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, split = made["model"], made["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("not a byte-level BPE tokenizer that splits by its pattern")
        if made["normalizer"] or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("the tokenizer changes texts or words before merging")
        of = byte_characters()
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.pieces = splitter().findall
        vocab = {bytes(map(of.__getitem__, k)): v for k, v in model["vocab"].items() if all(c in of for c in k)}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.bytes_of = {v: k for k, v in vocab.items()}
        ids = model["vocab"]
        #: rank of merging two tokens, and the rank and parts by which a token is made
        self.merges = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = {ids[a + b]: (rank, ids[a], ids[b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        if any(rank <= self.made.get(x, (-1,))[0] for rank, *parts in self.made.values() for x in parts):
            raise ValueError("a merge comes before those that make its parts")
        self.added = {x["content"]: x["id"] for x in made["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in made["added_tokens"]):
            raise ValueError("added tokens that take more than their content are not supported")
        self.bytes_of |= {v: k.encode() for k, v in self.added.items()}
        self.special = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        #: entries that merging reaches, and all prefixes of them
        self.entries = {data: token for data, token in vocab.items() if token not in self.added.values() and self.reached(token)}
        self.prefixes = {data[:k] for data in self.entries for k in range(1, len(data) + 1)}
        #: bytes of each, and the longest entry that is a shorter suffix of it
        self.size = {token: len(data) for data, token in self.entries.items()}
        self.shorter = {token: self._longest(data[1:]) for data, token in self.entries.items()}
        self.ends: list[bytes] = [b""]  # suffixes that begin an entry, by number
        self.end_of: dict[bytes, int] = {b"": 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.goes: dict[tuple[int, int], bool] = {}
        self.met = bytearray(MET // 8)
        #: ids of added tokens, which stand for themselves among a text's parts
        self.marks: dict = {x: x.to_bytes(4, "little") for x in self.added.values()}
        self.known: dict[str | int, bytes] = dict(self.marks)
        self.missed = 0

    def reached(self, token: int) -> bool:
        """Whether merging an entry's bytes gives the entry."""
        made = self.made.get(token)
        return len(self.bytes_of[token]) == 1 or made is not None and self._apart(made[1], made[2], made[0])

    def go_together(self, a: int, b: int) -> bool:
        known = self.goes.get((a, b))
        if known is None:
            if len(self.goes) >= PAIRS:
                self.goes.clear()
            known = self.goes[a, b] = self._apart(a, b, 1 << 60)
        return known

    def _apart(self, a: int, b: int, until: int) -> bool:
        """Whether no merge of a rank below ``until`` joins a part of ``a`` to one of ``b``.

        The tokens at the boundary are taken apart, the one made last first.  Two
        that met there would have been joined if their merge ranks before those
        that made both grow; of two merges of one rank the left one comes first.
        """
        merges, made, none = self.merges, self.made, (-1, -1, -1)
        grow_a = grow_b = until
        made_a, made_b = made.get(a, none), made.get(b, none)
        while True:
            rank = merges.get((a, b))
            if rank is not None and rank < grow_a and (rank <= grow_b if grow_b < until else rank < until):
                return False
            if made_a[0] > made_b[0]:
                grow_a, _, a = made_a
                made_a = made.get(a, none)
            elif made_b[0] >= 0:
                grow_b, b, _ = made_b
                made_b = made.get(b, none)
            else:
                return True

    def _longest(self, data: bytes) -> int:
        """The longest entry that is a suffix; -1 if none is."""
        return next((t for k in range(len(data)) if (t := self.entries.get(data[k:])) is not None), -1)

    def _step(self, end: int, b: int) -> tuple[int, int]:
        """After one more byte: the longest suffix that begins an entry, and the longest entry that is a suffix."""
        data = self.ends[end] + bytes([b])
        while data and data not in self.prefixes:
            data = data[1:]
        if (nxt := self.end_of.get(data)) is None:
            nxt = self.end_of[data] = len(self.ends)
            self.ends.append(data)
        got = self.steps[end << 8 | b] = nxt, self._longest(data)
        return got

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, as int32, through one trie.

        The trie is held as the words in order, each with the length of the
        prefix that it shares with the one before, and so is walked depth
        first from word to word; a stack has the states of the present path.
        """
        out = [b""] * len(words)
        steps, goes, size, shorter = self.steps.get, self.goes.get, self.size, self.shorter
        ends, states, before = [0], [-1], b""
        for n in sorted(range(len(words)), key=words.__getitem__):
            word = words[n]
            depth, most = 0, min(len(word), len(before))
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del ends[depth + 1 :], states[depth + 1 :]
            end = ends[depth]
            for b in word[depth:]:
                end, token = steps(end << 8 | b) or self._step(end, b)
                depth += 1
                # the longest entry that goes with the state where it begins
                while token >= 0:
                    at = depth - size[token]
                    if not at:
                        break
                    pair = states[at], token
                    known = goes(pair)
                    if known or known is None and self.go_together(*pair):
                        break
                    token = shorter[token]
                else:
                    raise ValueError("bytes that no entry stands for")
                ends.append(end)
                states.append(token)
            ids, at = [], len(word)
            while at:
                ids.append(states[at])
                at -= size[states[at]]
            out[n] = array("i", ids[::-1]).tobytes()
            before = word
        return out

    def words(self, text: str) -> list[str]:
        if _OTHER.search(text):
            return [text[a:b] for _, (a, b) in self.split(text)]
        return self.pieces(text)

    def parts(self, text: str) -> list:
        """Words of a text, and ids of the added tokens in it."""
        if not self.special or not self.special.search(text):
            return self.words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.words(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self.words(text[at:])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text, as int32."""
        out: list = []
        fresh: dict[str, bytes] = {}
        waiting: list[tuple[int, list, list, list]] = []

        def resolve() -> None:
            new = list(fresh)
            fresh.update(zip(new, self.encode_words([x.encode("utf-8", "surrogatepass") for x in new])))
            for at, parts, got, holes in waiting:
                for k in holes:
                    got[k] = fresh[parts[k]]
                out[at] = b"".join(got)
            self._remember(fresh)
            fresh.clear()
            waiting.clear()

        for text in texts:
            parts = self.parts(text) if text else []
            got = list(map(self.known.get, parts))
            if None in got:
                holes = [k for k, ids in enumerate(got) if ids is None]
                fresh.update((parts[k], b"") for k in holes)
                waiting.append((len(out), parts, got, holes))
                out.append(b"")
                if len(fresh) >= TRIE_WORDS:
                    resolve()
            else:
                out.append(b"".join(got))
        resolve()
        return out

    def _remember(self, coded: dict[str, bytes]) -> None:
        """Words from their second time on; a full table starts anew after eight times as many misses."""
        for word, ids in coded.items():
            slot = hash(word) % MET
            at, bit = slot >> 3, 1 << (slot & 7)
            if not self.met[at] & bit:
                self.met[at] |= bit
            elif len(word) <= LONGEST:
                if len(self.known) < KNOWN:
                    self.known[word] = ids
                else:
                    self.missed += 1
        if self.missed > 8 * KNOWN:
            self.known = dict(self.marks)
            self.missed = 0

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> TrieCodec:
    """The codec that this worker holds."""
    return held(("trie", path), lambda: TrieCodec(path))


def encode_column(text: Column, path: str) -> Column:
    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        own = codec(path)
        return lists_of_ids(chain.from_iterable(own.encode(texts.slice(lo, 512).to_pylist()) for lo in range(0, len(texts), 512)))

    return encode(text)


def decode_column(ids: Column, path: str) -> Column:
    @arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        own = codec(path)
        ends, held = gathered(own.decode(x.values.to_numpy().tolist()).encode() if x.is_valid else b"" for x in lists)
        known = np.packbits(np.array(lists.is_valid()), bitorder="little")
        return pa.Array.from_buffers(pa.string(), len(lists), [pa.py_buffer(known), pa.py_buffer(ends.astype(np.int32)), held])

    return decode(ids)


def trie_encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text as ``array<int>``; null text gives an empty array."""
    return df.withColumn(out, encode_column(F.col(text), path))


def trie_decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each list of ids; a null list gives null, an unknown id fails."""
    return df.withColumn(out, decode_column(F.col(ids), path))
