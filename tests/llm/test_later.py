"""Vector codes, Merkle manifest and trie BPE against brute force and the library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, queries, triebpe, vectorcodes

SF = "/root/testdata/sf0.001"


def put(spark, tmp_path, name, rows, schema, parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{tmp_path}/{name}.parquet")


# -- vector codes -------------------------------------------------------


def nearest(entry_lists, part):
    return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(entry_lists))


def brute_codes(rows):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    w = len(kept[0][1]) // 16
    cut = lambda v: [v[k * w : k * w + w] for k in range(16)]
    books = list(zip(*[cut(v) for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]]))
    books = [list(map(list, b)) for b in books]
    for _ in range(2):
        for p in range(16):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[nearest(books[p], cut(v)[p])[1]].append(cut(v)[p])
            for k, parts in own.items():
                books[p][k] = [sum(c) // len(parts) for c in zip(*parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    done = [(i, [nearest(books[p], x) for p, x in enumerate(cut(v))], y) for i, v, y in kept]
    by = Counter()
    for _, found, y in done:
        by[y] += sum(d for d, _ in found)
    return Counter((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), by[y], digest) for i, found, y in done)


def test_vector_codes_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()[:150]]
    copies = [(1000 + k, rows[0][1], 7) for k in range(60)]
    odd = [(5000, None, 1), (5001, [None] + rows[1][1][1:], 1), (5002, [float("nan")] + rows[1][1][1:], 1), (5003, [float("-inf")] + rows[1][1][1:], 1), (None, rows[2][1], None), (0, rows[3][1], None)]
    grid = [(6000 + k, [rng.choice([-0.5, -0.001, 0.0, 0.25]) for _ in range(64)], None) for k in range(80)]
    for n, every in enumerate((rows + copies + odd + grid, odd[:4], rows[:5])):
        folder = tmp_path / str(n)
        put(spark, folder, "embeddings", every, "vec_id long, embedding array<float>, label int")
        stored = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
        found = queries.op11_vector_codes(spark, str(folder))
        assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert Counter(map(tuple, found.collect())) == brute_codes(stored)


def test_entry_tree_is_exact():
    rng = np.random.default_rng(3)
    for width, span in ((1, 3), (4, 2), (4, 300), (7, 2**28)):
        for size in (1, 8, 9, 64, 150):
            entries = rng.integers(-span, span, (size, width))
            parts = np.concatenate([rng.integers(-span, span, (500, width)), entries])
            squares = ((parts[:, None] - entries[None]) ** 2).sum(2)
            code, least = vectorcodes.EntryTree(entries).nearest(parts)
            assert (code == squares.argmin(1)).all() and (least == squares.min(1)).all()


def test_codes_keep_other_columns_and_decode(spark):
    rows = [(k, [float(k % 5), 0.5, -1.0, float(k)], "x", k, "old") for k in range(9)] + [(9, [1.0], "short", 0, "old")]
    df = spark.createDataFrame(rows, "id long, v array<double>, name string, error long, code string")
    books = vectorcodes.learn_codebooks(df, "id", "v", parts=2, entries=16)
    got = vectorcodes.decode_codes(vectorcodes.assign_codes(df, books, "v"), books).collect()
    assert len(got) == 9 and all(r.error == 0 and r.name == "x" and np.allclose(r.decoded, np.array(r.v) + 0.5 / 256) for r in got)
    with pytest.raises(ValueError):
        vectorcodes.learn_codebooks(df, "id", "v", parts=3)
    with pytest.raises(Exception, match="components must lie within"):
        vectorcodes.assign_codes(df.withColumn("v", F.array(*[F.lit(1e30)] * 4)), books, "v").collect()


@pytest.mark.parametrize("most", [0, 10])
def test_label_totals_by_join(spark, monkeypatch, most):
    from tessera.llm import common

    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    monkeypatch.setattr(vectorcodes, "HOT", 3)
    df = common.written(spark.createDataFrame([(k, None if k < 40 else k % 30, k) for k in range(100)], "id long, label int, error long"), "t")
    by = Counter()
    for k in range(100):
        by[None if k < 40 else k % 30] += k
    assert {r.id: r.total for r in vectorcodes.with_key_total(df, "label", "error", "total").collect()} == {k: by[None if k < 40 else k % 30] for k in range(100)}


# -- Merkle manifest ----------------------------------------------------


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def climbed(nodes, arity):
    """Root, and the siblings of each node from level to level with its place among them."""
    at, ways = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[k : k + arity] for k in range(0, len(nodes), arity)]
        for k, way in enumerate(ways):
            run, place = runs[at[k] // arity], at[k] % arity
            way.append((place, run[:place] + run[place + 1 :]))
            at[k] //= arity
        nodes = [h(*r) for r in runs]
    return nodes[0], ways


def brute_manifest(rows, arity=2):
    def leaf(r, more=0):
        cells = [r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4]]
        return h("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), leaf(r, 1)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climbed([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in order}
    if not rows:
        return Counter()
    root, above = climbed([trees[g][0] for g in order], arity)
    out = Counter()
    for g, up in zip(order, above):
        for (known, doc, own, other), way in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            way = way + up
            digest = other if known and zlib.crc32(str(doc).encode()) % 7 == 0 else own
            for place, beside in way:
                digest = h(*beside[:place], digest, *beside[place:])
            out[(doc if known else None, own, trees[g][0], root, h(*[s for _, x in way for s in x]), digest, digest == root)] += 1
    return out


DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("stride", [2, 10])
def test_merkle_equals_brute_force(spark, tmp_path, monkeypatch, stride):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    rng = random.Random(stride)
    rows = [(k, f"s{k % 3}", rng.choice(["en", "en", "en", "de", "é", None, "Z"]), k, "t" * k) for k in range(0, 300, 2)]
    rows += [(None, None, None, None, None), (None, "", "", None, ""), (3, "a", "en", None, "é"), (3, "b", "en", None, "é"), (3, "b", "en", None, "é"), (7, "x", "fr", 1, "漢" * 5000)]
    for n, every in enumerate((rows, [], rows[:1], rows[-1:] * 6, [(k, "s", "en", 1, "x") for k in range(65)])):
        folder = tmp_path / str(n)
        put(spark, folder, "documents", every, DOCUMENTS)
        found = queries.op12_merkle(spark, str(folder))
        assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert Counter(map(tuple, found.collect())) == brute_manifest(every)


def test_merkle_of_other_arity_and_columns(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STRIDE", 2)
    rows = [(k, "p" if k < 40 else "q" if k < 41 else None) for k in range(70)]
    df = spark.createDataFrame(rows, "at long, g string").withColumn("root", F.lit(1)).repartition(5)
    found = merkle.merkle_manifest(df, merkle.leaf_digest([F.col("at")]), "g", "at", arity=3)
    again = merkle.folded(F.col("leaf"), *[F.col(c) for c in ("at", "n", "group_at", "groups", "path")], arity=3)
    got = found.withColumn("again", again).collect()
    trees = [[h(f"{len(str(k))}:{k}") for k, g in rows if g == x] for x in (None, "p", "q")]
    assert {r.root.hex() for r in got} == {r.again.hex() for r in got} == {climbed([climbed(t, 3)[0] for t in trees], 3)[0]}
    assert len(got) == 70


# -- trie BPE -----------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(9)
    some = "ab \t\n\xa0　é漢'tsx19!՘\U00012550́\0"
    texts = ["", None, "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftext|", "a" * 20_000, " " * 3_000 + "x", "!" * 700, "it's  we'll\n\n ok ", "foo \xa0", "w \xa0\tq"]
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    texts += ["".join(rng.choice(["<|endoftext|>", " ", "it's", "don't ", "\xa0"]) for _ in range(9)) for _ in range(60)]
    return texts + ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(1, 0xD7FF), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(300)]


def test_trie_bpe_equals_library(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    texts = odd_texts() + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    put(spark, tmp_path, "documents", [(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_trie_bpe(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for k, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[k] == (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))), repr(t)[:200]


def test_split_of_each_plain_character():
    own = triebpe.TrieCodec(PATH)
    for c in map(chr, range(1, triebpe.PLAIN)):
        text = f"a{c}1{c} {c}!{c}  {c}{c} \n{c}"
        assert own.words(text) == [text[a:b] for _, (a, b) in own.split(text)], repr(c)


def test_trie_bpe_with_small_tables(monkeypatch):
    """Tables that fill up and start anew change nothing."""
    from tokenizers import Tokenizer

    for name, value in (("KNOWN", 20), ("PAIRS", 50), ("TRIE_WORDS", 7)):
        monkeypatch.setattr(triebpe, name, value)
    tok, own, texts = Tokenizer.from_file(PATH), triebpe.TrieCodec(PATH), [t or "" for t in odd_texts()]
    for _ in range(2):
        for k in range(0, len(texts), 40):
            for t, ids in zip(texts[k : k + 40], own.encode(texts[k : k + 40])):
                assert np.frombuffer(ids, "<i4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_trie_bpe_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", "mine", 5)], "doc_id long, text string, ids string, decoded int")
    got = triebpe.trie_decode(triebpe.trie_encode(df, PATH), PATH)
    assert got.columns == ["doc_id", "text", "ids", "decoded"] and got.first().decoded == "a b"
    assert triebpe.trie_decode(triebpe.trie_encode(df.limit(0), PATH), PATH).count() == 0
    incomplete = spark.createDataFrame([(None,), ([25, 255],)], "ids array<int>")  # a null list, and bytes that may be no UTF-8
    assert triebpe.trie_decode(incomplete, PATH).collect()[0].decoded is None
