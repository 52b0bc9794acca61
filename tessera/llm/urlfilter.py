"""URL filtering with a sorted array of digests.

A list of rules (host, path prefix, verdict) is stored as one file: the sorted
64-bit xxhash keys of ``host + path``, the offsets of the rule strings, and the
strings.  The file lies in the shared folder; Spark fetches it for every executor, where tasks memory-map it, so
worker processes of a machine share its pages.  A URL's candidates are its host
and the domains above it, each with the path's prefixes of the lengths that
rules have; their keys are probed by one vectorised binary search for a batch of URLs,
and every equal key is confirmed on the stored string, so a
collision of keys changes nothing.

The longest rule that fits wins; of rules of one length the one with the longer
host.  Two rules with the same host and path, or an unknown verdict, are an
error.  Domains longer than the longest rule's host need no probe, so a URL of any
length has few candidates.  Repeated rows are judged each.  A null URL, and one without ``://``, has an empty host and path and
fits no rule.  URLs that fit none get the ``default`` verdict.  Other columns
pass through; those named like an output are replaced; an empty table gives an
empty table.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import shared_file

VERDICTS = ("allow", "block")
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def write_rules(rules: Iterable[tuple[str, str, str]], path: str) -> None:
    """The digest file of ``(verdict, host, path)`` rules."""
    rows = []
    for verdict, host, prefix in rules:
        name = (host + prefix).encode()
        rows.append((xxhash.xxh64_intdigest(name), name, len(host.encode()), VERDICTS.index(verdict)))
    rows.sort()
    if any(a[1] == b[1] for a, b in zip(rows, rows[1:])):
        raise ValueError("two rules have the same host and path")
    ends = np.cumsum([0, *[len(r[1]) for r in rows]])
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(rows)))
        f.write(np.array([r[0] for r in rows], "<u8").tobytes())
        f.write(ends.astype("<u8").tobytes())
        f.write(np.array([r[2] for r in rows], "<u4").tobytes())
        f.write(np.array([r[3] for r in rows], "u1").tobytes())
        f.write(b"".join(r[1] for r in rows))


class DigestRules:
    """A memory-mapped digest file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            (n,) = struct.unpack("<Q", f.read(8))
        at = 8
        if n:
            self.keys = np.memmap(path, "<u8", "r", at, (n,))
            self.ends = np.memmap(path, "<u8", "r", at + 8 * n, (n + 1,))
            self.hosts = np.memmap(path, "<u4", "r", at + 16 * n + 8, (n,))
            self.verdicts = np.memmap(path, "u1", "r", at + 20 * n + 8, (n,))
            self.strings = np.memmap(path, "u1", "r", at + 21 * n + 8)
            sizes = np.diff(self.ends.astype(np.int64)) - self.hosts
            self.lengths, self.longest = np.unique(sizes).tolist(), int(self.hosts.max())
        else:
            self.keys, self.lengths, self.longest = np.empty(0, "<u8"), [], 0

    def name(self, i: int) -> bytes:
        return self.strings[int(self.ends[i]) : int(self.ends[i + 1])].tobytes()

    def candidates(self, host: bytes, path: bytes) -> list[tuple[bytes, int]]:
        """Names that rules which fit may have, longest first."""
        # no rule's host is longer; the first part of a longer domain may be cut off
        out, domain = [], host
        if len(host) > self.longest:
            domain = host[-self.longest - 1 :].partition(b".")[2] if self.longest else b""
        while domain:
            out += [(domain + path[:k], len(domain)) for k in self.lengths if k <= len(path)]
            domain = domain.partition(b".")[2]
        return sorted(out, key=lambda x: (-len(x[0]), -x[1]))

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """Of each URL the winning rule and its verdict."""
        names: list[tuple[bytes, int]] = []
        starts = [0]
        for host, path in zip(hosts, paths):
            names += self.candidates(host.encode(), path.encode())
            starts.append(len(names))
        probes = np.fromiter((xxhash.xxh64_intdigest(x) for x, _ in names), np.uint64, len(names))
        first = np.searchsorted(self.keys, probes)
        hit = first < len(self.keys)
        hit[hit] = self.keys[first[hit]] == probes[hit]
        at = np.flatnonzero(hit)
        out: list[tuple[str, str] | None] = [None] * len(hosts)
        rows = np.searchsorted(starts, at, "right") - 1
        for row, c in zip(rows.tolist(), at.tolist()):
            if out[row] is not None:
                continue
            (name, host_len), i = names[c], int(first[c])
            while i < len(self.keys) and self.keys[i] == probes[c]:
                if self.name(i) == name and self.hosts[i] == host_len:
                    out[row] = (name.decode(), VERDICTS[self.verdicts[i]])
                    break
                i += 1
        return out


@lru_cache(maxsize=4)
def _mapped(name: str) -> DigestRules:
    return DigestRules(SparkFiles.get(name))


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), *_AZ)


def url_path(url: Column) -> Column:
    """After the host, up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host, path, rule, verdict``; ``rules`` are (verdict, host, path prefix)."""
    name = f"rules-{uuid.uuid4().hex}.digests"
    with tempfile.TemporaryDirectory() as own:
        file = os.path.join(own, name)
        write_rules(rules, file)
        df.sparkSession.sparkContext.addFile(shared_file(df.sparkSession, file, "rules"))

    @arrow_udf("struct<rule:string,verdict:string>")
    def judge(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = _mapped(name).judge(hosts.to_pylist(), paths.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array([x and x[0] for x in found], pa.string()), pa.array([x[1] if x else default for x in found], pa.string())],
            ["rule", "verdict"],
        )

    return (
        df.drop("host", "path", "rule", "verdict")
        .withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
        .withColumn("_r", judge("host", "path"))
        .select("*", "_r.*")
        .drop("_r")
    )
