"""File readers and sinks on small files."""

import hashlib
import json

import pytest

from tessera.sources import corpus, sinks


def test_frozen_files_and_their_status(spark, tmp_path):
    root = tmp_path / "root"
    (root / "a").mkdir(parents=True)
    held = {"a/ok.md": "Größe\nzwei\n".encode(), "nul.txt": b"x\0y", "bad.txt": b"\xff\xfe", "changed.txt": b"new", "empty.txt": b""}
    for path, data in held.items():
        (root / path).write_bytes(data)
    rows = [(p, hashlib.sha256(b"old" if p == "changed.txt" else d).hexdigest()) for p, d in held.items()]
    rows += [("gone.txt", "0"), ("../root/a/ok.md", "0"), ("/etc/hosts", "0")]
    got = {r.path: (r.status, r.text) for r in corpus.read_frozen(spark, f"file://{root}", spark.createDataFrame(rows, "path string, sha256 string")).collect()}
    assert got["a/ok.md"] == ("ok", "Größe\nzwei\n") and got["empty.txt"] == ("missing", None)
    assert got["nul.txt"] == got["bad.txt"] == ("binary", None)
    assert got["changed.txt"] == ("changed", None) and got["gone.txt"] == ("missing", None)
    assert got["../root/a/ok.md"] == got["/etc/hosts"] == ("outside", None)


def test_sessions_of_several_frames(spark, tmp_path):
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    (tmp_path / "s.zst").write_bytes(pack(b'{"a":1}\n\n{"a"') + pack(b":2}\n"))
    got = corpus.read_sessions(spark, f"file://{tmp_path}/s.zst").orderBy("line").collect()
    assert [(r.line, r.event) for r in got] == [(1, '{"a":1}'), (3, '{"a":2}')]


def test_cases_and_repeated_ids(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"cases": [{"id": "x", "q": 1}, {"case_id": "y"}, {"q": 3}]}))
    assert sorted(r.id for r in corpus.read_cases(spark, f"file://{tmp_path}/c.json").collect()) == ["case_3", "x", "y"]
    (tmp_path / "d.json").write_text(json.dumps([{"id": "x"}, {"id": "x"}]))
    with pytest.raises(Exception, match="repeats"):
        corpus.read_cases(spark, f"file://{tmp_path}/d.json").collect()


def test_sinks(spark, tmp_path):
    path, one = f"file://{tmp_path}/t", spark.createDataFrame([(1, "a|b")], "k long, v string")
    sinks.create(one, path)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.create(one, path)
    sinks.replace(spark.createDataFrame([(2, None)], "k long, v string"), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(2, None)]
    assert not [p.name for p in tmp_path.iterdir() if ".old-" in p.name or ".new-" in p.name]
    sinks.append_events(one, f"file://{tmp_path}/e")
    sinks.append_events(one, f"file://{tmp_path}/e")
    assert spark.read.json(f"file://{tmp_path}/e").count() == 2
    assert sinks.report(one, "T", "k", ["v"]).first().report == "# T\n\n| v |\n|---|\n| a\\|b |"
    assert sinks.manifest(spark, path).where("length(sha256) = 64").count() >= 1


def test_records_and_vectors(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "a", "q": "x"}, {"id": "b"}]))
    read = lambda f: sorted(map(tuple, corpus.read_records(spark, f"file://{tmp_path}/{f}", "id string, q string", "id").collect()), key=str)
    assert read("q.json") == [("a", "x"), ("b", None)]
    for bad in ([{"id": "a"}, {"id": "a"}], [{"q": "x"}]):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="missing or repeats"):
            read("bad.json")
    path = f"file://{tmp_path}/v"
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "k long, embedding array<float>").write.parquet(path)
    said = lambda rows, dim: spark.createDataFrame([(rows, dim)], "rows long, dim int")
    assert corpus.read_vectors(spark, path, said(2, 2), "k").count() == 2
    for rows, dim in ((3, 2), (2, 3)):
        with pytest.raises(ValueError, match="manifest"):
            corpus.read_vectors(spark, path, said(rows, dim), "k")


def test_tables_are_published_together(spark, tmp_path):
    one = lambda v: spark.createDataFrame([(v,)], "v int")
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    sinks.publish({a: one(1), b: one(2)})
    with pytest.raises(Exception):
        sinks.publish({a: one(3), b: one(4).select("v", one(4).v.alias("v"))})  # two columns of one name can't be written
    (tmp_path / "held").write_text("a file, no folder")
    with pytest.raises(Exception):
        sinks.publish({a: one(5), f"file://{tmp_path}/held/c": one(6)})
    assert [spark.read.parquet(p).first().v for p in (a, b)] == [1, 2]
    sinks.publish({a: one(7), b: one(8)})
    assert [spark.read.parquet(p).first().v for p in (a, b)] == [7, 8]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "held"]


def test_matrices_and_graphs(spark, tmp_path):
    import numpy as np

    root = tmp_path / "index"
    root.mkdir()
    parts = {"a.npy": np.arange(12, dtype=np.float32).reshape(4, 3), "b.npy": np.ones((5000, 3), np.float32)}
    rows = []
    for n, m in parts.items():
        np.save(root / n, m)
        rows.append((n, hashlib.sha256((root / n).read_bytes()).hexdigest(), *m.shape))
    said = lambda rows: spark.createDataFrame(rows, "file string, sha256 string, rows int, dim int")
    got = corpus.read_npy(spark, f"file://{root}", said(rows)).collect()
    assert len(got) == 5004 and {r.row: r.embedding for r in got if r.file == "a.npy"} == {k: parts["a.npy"][k].tolist() for k in range(4)}
    for wrong in ([("a.npy", "0", 4, 3)], [("c.npy", "0", 4, 3)], [(*rows[0][:2], 3, 4)]):
        with pytest.raises(Exception, match="missing or changed|its manifest says"):
            corpus.read_npy(spark, f"file://{root}", said(wrong)).collect()

    def graph(nodes, edges):
        (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": n} for n in nodes], "edges": [{"source": a, "target": b, "relation": "r"} for a, b in edges]}))
        n, e = corpus.read_graph(spark, f"file://{tmp_path}/g.json", "id string", "source string, target string, relation string")
        return sorted(r.id for r in n.collect()), sorted((r.source, r.target) for r in e.collect())

    assert graph("ab", ["ab", "ba"]) == (["a", "b"], [("a", "b"), ("b", "a")])
    for nodes, edges in (("aa", []), ("ab", ["ac"]), ("ab", ["cb"])):
        with pytest.raises(Exception, match="repeats|is no node"):
            graph(nodes, edges)


def test_grep_with_a_glob(spark):
    docs = spark.createDataFrame([(1, "a/x.c", "one\ntwo"), (2, "a/x.h", "two"), (3, "b/y.c", None)], "doc_id int, path string, text string")
    assert [(r.doc_id, r.line) for r in corpus.grep(docs, "tw.", "*.c").collect()] == [(1, 2)]
    assert sorted(r.doc_id for r in corpus.grep(docs, "tw.").collect()) == [1, 2]
