"""Manifests, whitening and byte-level BPE against brute force and the tokenizers library, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from codicil.llm import bpe, bpe_codec, entries, merkle, setsketch, whitening

LONG = "lange Wörter und 日本語 " * 3000


# 11: manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by plain lists."""

    def leaf(r, text):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def tree(nodes):
        """The root, and for each node the (left, right) of every level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for i, place in enumerate(at):
                run, slot = runs[place // 16], place % 16
                paths[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
                at[i] = place // 16
            nodes = [sha(*run) for run in runs]
        return (nodes or [None])[0], paths

    lower = {i: i + 32 for i in range(65, 91)}
    by_source = {}
    for r in rows:
        altered = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        by_source.setdefault(r.source, []).append((r.doc_id, leaf(r, r.text), leaf(r, r.text.translate(lower) if altered else r.text)))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in names:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        done[s] = tree([x[1] for x in by_source[s]])
    root, upper = tree([done[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        for (doc, own, given), path in zip(by_source[s], done[s][1], strict=True):
            node = given
            for left, right in path + above:
                node = sha(left, node, right)
            out.append((doc, own, done[s][0], root, sha(*(x for pair in path + above for x in pair)), node, node == root))
    return out


def manifest_rows(df):
    return [tuple(r) for r in merkle.verify(df, merkle.lowered_fifth()).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def test_manifest_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got, want = manifest_rows(docs), brute_manifest(docs.collect())
    assert sorted(got) == sorted(want) and {r[-1] for r in got} == {True, False}


def test_manifest_of_awkward_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["Aa b", "ÄÖ X", "", None]), "de", f"s{rng.choice([1, 1, 1, 2])}", 3, "x") for i in range(700)]
    rows += [(1, "A", None, None, None, "y"), (None, "B", "en", None, 1, "y"), (None, None, None, None, None, None), (7, "same Row", "en", "dup", 2, "z"), (7, "same Row", "en", "dup", 2, "z"), (7, "other", "en", "dup", 2, "z")]
    rows += [(10_000 + i, LONG if i == 3 else "T", "en", f"lone {i} é", 1, "q") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string")
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(manifest_rows(df), key=key) == sorted(brute_manifest(df.collect()), key=key)
    assert manifest_rows(df.limit(0)) == []
    one = df.where("source = 's2'").limit(1)
    (doc, own, sub, root, proof, _, _) = manifest_rows(one)[0]
    assert own == sub == root and proof == sha("")


def test_manifest_does_not_depend_on_partitions(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = sorted(manifest_rows(docs))
    monkeypatch.setattr(merkle, "TASK_ROWS", 20)
    assert sorted(manifest_rows(docs.repartition(7))) == first


# 12: whitening


def fitted_by_numpy(vectors):
    x = np.floor(np.array(vectors, float) * 256).astype(np.int64)
    points = np.unique(x, axis=0)
    centred = points - points.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(points))
    return x, points, values[::-1], axes[:, ::-1]


def test_whitening_of_embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    given = {r.vec_id: r.embedding for r in df.collect()}
    x, points, values, axes = fitted_by_numpy(list(given.values()))
    projected = (x - points.mean(0)) @ axes[:, :4] / np.sqrt(values[:4])
    rows = entries.op12_embedding_whitening(spark, sf_dir).collect()
    assert len(rows) == 4 * len(given)
    got = {(r.vec_id, r.component): r for r in rows}
    sums = points.sum(0)
    for i, v in enumerate(given):
        for k in range(1, 5):
            r = got[v, k]
            sign = np.sign(got[next(iter(given)), k].whitened * projected[0, k - 1])
            assert abs(r.whitened * sign - projected[i, k - 1]) < 1e-9
            assert (r.n, r.deviation) == (len(points), int(((len(points) * x[i] - sums) ** 2).sum()))
            assert abs(r.explained / (values[k - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_factor_and_rotations():
    rng = np.random.default_rng(2)
    for d, r in ((1, 1), (6, 6), (12, 5), (20, 1)):
        a = rng.normal(size=(d, r)) * np.geomspace(1, 1e-3, r)
        scatter = a @ a.T
        factor, order = whitening.pivoted_cholesky(scatter)
        assert factor.shape == (d, r) and np.allclose(factor @ factor.T, scatter[order][:, order], atol=1e-12)
        assert np.allclose(np.triu(factor, 1), 0)
        values, axes = whitening.eigen(scatter, 1)
        assert np.allclose(values, np.linalg.eigvalsh(scatter)[::-1][:r], rtol=1e-8) and np.allclose(axes.T @ axes, np.eye(r), atol=1e-9)
        assert np.allclose(scatter @ axes, axes * values, atol=1e-9)
    assert whitening.pivoted_cholesky(np.zeros((3, 3)))[0].shape == (3, 0)


def test_whitening_of_awkward_rows(spark):
    good = [(i, [float(i % 5), float(i * i % 7), 1.0], 9) for i in range(60)]
    bad = [(100, None, 1), (101, [], 1), (102, [1.0, None, 2.0], 1), (103, [float("nan")] * 3, 1), (104, [1.0, float("inf"), 0.0], 1), (105, [1.0, 2.0], 1), (None, [0.0, 0.0, 1.0], 1), (1, [1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, component int")
    rows = whitening.whiten(df).collect()
    assert {r.vec_id for r in rows} == {*range(60), None} and {r.component for r in rows} == {1, 2}  # the last dimension never varies
    assert len(rows) == 2 * 62 and {r.n for r in rows} == {len({tuple(v) for _, v, _ in good} | {(0.0, 0.0, 1.0)})}
    for nothing in (df.limit(0), df.where("vec_id = 3"), df.where("vec_id between 100 and 104")):
        assert whitening.whiten(nothing).count() == 0 and whitening.whiten(nothing).columns == whitening.whiten(df).columns
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}
    assert whitening.deviations(np.array([[2**31, 0]]), 2, [2**31, 5]) == [2**62 + 25]


# 13: byte-level BPE


@pytest.fixture(scope="module")
def coders():
    path = bpe.default_path()
    return bpe_codec.Encoder(path), bpe_codec.Decoder(path), Tokenizer.from_file(path)


def texts():
    rng = random.Random(11)
    spaces = [chr(c) for c in (9, 10, 11, 12, 13, 28, 31, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x200B, 0x202F, 0x3000, 0xFEFF)]
    kinds = (
        lambda: "".join(rng.choice("ab '\n stredlmv.,!1") for _ in range(rng.randint(1, 60))),
        lambda: "".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(1, 30))),
        lambda: "".join(rng.choice([*spaces, *"ab1."]) for _ in range(rng.randint(1, 40))),
        lambda: rng.choice("ae 0-=_/") * rng.randint(1, 300),
        lambda: "".join(rng.choice(["<|endoftext|>", "<|endof", " the", "ing", "tion", "é", " ", "ß", "日本"]) for _ in range(rng.randint(1, 30))),
    )
    return [kinds[i % len(kinds)]() for i in range(4000)] + ["", LONG, "a" * 50_000, "\U00032fff1", "it's we'll'd"]


def test_ids_are_the_librarys(coders):
    encoder, decoder, library = coders
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids, repr(text)
        assert decoder.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_any_ids_decode_as_the_librarys(coders):
    _, decoder, library = coders
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.randrange(50_300) for _ in range(9)]
        assert decoder.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_tokens_encode_to_themselves(coders):
    encoder, _, _ = coders
    found = dict(encoder.words)
    encoder.words.clear()  # so that each is put together from shorter ones
    shorter = encoder.shorter
    try:
        for word, i in random.Random(1).sample(sorted(found.items()), 3000):
            assert encoder.piece(word) == [i]
    finally:
        encoder.words.update(found)
    assert sum(s >= 0 for s in shorter) == len(found) - 256


def test_small_tables_change_no_id(coders, monkeypatch):
    encoder, _, library = coders
    monkeypatch.setattr(bpe_codec, "KEPT", 3)
    monkeypatch.setattr(bpe_codec, "KEPT_PAIRS", 2)
    for text in texts()[:300]:
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_codec_query(spark, sf_dir, coders):
    library = coders[2]
    got = {r.doc_id: r for r in entries.op13_bpe_codec(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids, own = library.encode(r.text or "", add_special_tokens=False).ids, got[r.doc_id]
        assert (own.n_tokens, own.ids_sha256, own.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_codec_of_awkward_rows(spark):
    rows = [(1, None, "x", [3]), (1, "", "y", None), (None, "a<|endoftext|>b ", "z", [None, 5, 99_999_999]), (2, LONG, None, [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, IDS array<int>")
    got = [(r.doc_id, r.decoded) for r in bpe_codec.round_trip(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, ""), (1, ""), (None, "a<|endoftext|>b "), (2, LONG)], key=repr)
    assert sorted((r.decoded is None, r.decoded or "") for r in bpe_codec.decode(df, "IDS").collect()) == [(False, ""), (False, "$"), (False, "&"), (True, "")]
    assert bpe_codec.encode(df).columns == ["doc_id", "text", "decoded", "ids"]
    assert bpe_codec.digests(bpe_codec.round_trip(df.limit(0))).count() == 0


def test_other_files_are_refused(tmp_path):
    spec = '{"model": {"type": "BPE", "vocab": {}, "merges": [], "unk_token": "?"}, "pre_tokenizer": null, "decoder": null}'
    (tmp_path / "t.json").write_text(spec)
    with pytest.raises(ValueError, match="byte-level"):
        bpe_codec.Encoder(str(tmp_path / "t.json"))


def test_offset_table():
    table = bpe_codec.OffsetTable([b"ab", b"", b"c"])
    assert table.gather(np.array([2, 0, 1, -1, 7, 0])) == b"cabab" and table.gather(np.array([], int)) == b""


def test_dropping_near_copies_moves_no_whole_rows(spark):
    """Beyond Spark's own bound of a broadcast, too: ids that go are counted, and documents are filtered where they are."""
    rows = [(i, f"{' '.join(f'w{i // 2}x{j}' for j in range(30))}") for i in range(60)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = setsketch.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 2))
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
