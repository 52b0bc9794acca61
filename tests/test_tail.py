"""Appended lines as a stream, and releases behind a pointer."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import releases
from tessera.streaming import streams


def put(path, text, mode="ab"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as f:
        f.write(text.encode())


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_half_lines_wait_and_nothing_is_lost_or_doubled(spark, tmp_path, chunk):
    root, out = tmp_path / "events", tmp_path / "out"
    rows = []

    def run():
        stream = streams.tail_lines(spark, f"file://{root}", "*.jsonl", chunk)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(str(out))
        query.awaitTermination()
        got = sorted((r.path, r.position, r.value) for r in spark.read.parquet(str(out)).collect())
        assert got == sorted(rows)

    def line(name, at, value):
        rows.append((name, at, value))

    put(root / "a.jsonl", '{"k":1}\n{"k":2')
    put(root / "b/c.jsonl", "é\n\nlast without end")
    put(root / "other.txt", "not read\n")
    put(root / "_hidden.jsonl", "not read\n")
    line("a.jsonl", 0, '{"k":1}')
    line("b/c.jsonl", 0, "é")
    line("b/c.jsonl", 3, "")
    run()
    run()  # nothing new
    put(root / "a.jsonl", "}\r\n" + "x" * 40 + "\nhalf")
    put(root / "d.jsonl", "new\n")
    line("a.jsonl", 8, '{"k":2}')
    line("a.jsonl", 17, "x" * 40)
    line("d.jsonl", 0, "new")
    run()
    put(root / "a.jsonl", "\n")
    line("a.jsonl", 58, "half")
    run()


def test_tailed_events_are_parsed(spark, tmp_path):
    put(tmp_path / "e/x.jsonl", '{"task":"a","n":1}\nno json\n{"task":"b"}\n')
    events = streams.tail_events(spark, f"file://{tmp_path}/e", "task string, n long")
    query = streams.progress(events, ["task"]).writeStream.format("memory").queryName("tailed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.task, r.n) for r in spark.table("tailed").collect()} == {("a", 1), ("b", 1), (None, 1)}


def test_a_release_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    one = lambda v: spark.createDataFrame([(v,)], "v int")
    assert releases.pointer(spark, root) is None
    releases.publish_release({"a": one(1), "b": one(2)}, root, None)
    first = releases.pointer(spark, root)
    seen = lambda t: releases.read_release(spark, root, t).first().v

    def wrong(tables):
        assert set(tables) == {"a", "b"}
        raise ValueError("injected")

    with pytest.raises(ValueError, match="injected"):
        releases.publish_release({"a": one(3), "b": one(4)}, root, first, wrong)
    with pytest.raises(releases.Conflict, match="meanwhile"):
        releases.publish_release({"a": one(5)}, root, None)
    (tmp_path / "r" / releases.LOCK).touch()
    with pytest.raises(releases.Conflict, match="holds"):
        releases.publish_release({"a": one(5)}, root, first)
    (tmp_path / "r" / releases.LOCK).unlink()
    assert releases.pointer(spark, root) == first and (seen("a"), seen("b")) == (1, 2)
    assert len(list((tmp_path / "r/releases").iterdir())) == 1
    releases.publish_release({"a": one(7)}, root, first)
    assert seen("a") == 7
    with pytest.raises(ValueError, match="no release"):
        releases.read_release(spark, root, "b")


def test_rebuild_parses_only_what_differs(spark, tmp_path):
    src, root, calls = tmp_path / "src", f"file://{tmp_path}/r", []
    parse = lambda files: files.select("path", F.length(F.decode("content", "utf-8")).alias("n"))
    build = lambda check=None: releases.rebuild(spark, root, f"file://{src}", parse, check)
    rows = lambda: sorted((r.path.rpartition("/")[2], r.n) for r in releases.read_release(spark, root, "rows").collect())
    for name in "abc":
        put(src / name, name * 3)
    assert build() == {"status": "published", "parsed": 3, "reused": 0, "removed": 0}
    assert build() == {"status": "unchanged", "parsed": 0, "reused": 3, "removed": 0}
    put(src / "a", "more")
    (src / "c").unlink()
    put(src / "d", "new")
    before = json.loads((tmp_path / "r" / releases.POINTER).read_text())

    def late(tables):  # a source changes while the release is checked
        calls.append(sorted(tables))
        put(src / "b", "late")

    with pytest.raises(releases.Conflict, match="source"):
        build(late)
    assert json.loads((tmp_path / "r" / releases.POINTER).read_text()) == before and rows() == [("a", 3), ("b", 3), ("c", 3)]
    assert build() == {"status": "published", "parsed": 3, "reused": 0, "removed": 1}
    assert rows() == [("a", 7), ("b", 7), ("d", 3)]
