"""Operators on single texts: language id, toxicity, token planes, BPE."""

import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taskloom.llm import bpe_tree, langid, token_planes, toxicity

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = st.lists(st.sampled_from(list(" \n\t a'sé1!x漢😀_\u00a0") + ["  ", "'ll", " the", "tion"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(ODD, st.integers(1, 9))
def test_tree_equals_library(text, leaf):
    codec = bpe_tree.codec(RANKS, P.PATTERN, leaf)
    ids = codec.encode(text)
    assert ids == codec._leaf(text)
    assert codec.decode(ids).decode() == text


def test_tree_without_anchors():
    codec = bpe_tree.codec(RANKS, P.PATTERN, 16)
    for text in ("x" * 3000, "漢字" * 700, " " * 2000, "\n \n" * 500, "a1" * 900):
        assert codec.encode(text) == codec._leaf(text)


def test_join_is_associative():
    codec = bpe_tree.codec(RANKS, P.PATTERN, 8)
    a, b, c = "don", "'t stop  the", "re  tion\n x"
    e = codec.encode
    assert codec.join(codec.join(e(a), e(b)), e(c)) == codec.join(e(a), codec.join(e(b), e(c))) == e(a + b + c)
    assert codec.join([], e(a)) == codec.join(e(a), []) == e(a)


EDGE = [(1, "Hello  wörld 漢字\n\n x", 1), (2, None, 2), (None, "", 3), (3, "a " * 30000, 4), (3, "a " * 30000, 4), (3, "b", 5)]
EDGE_SCHEMA = "doc_id long, text string, ids int"


def test_round_trip_edges(spark):
    df = spark.createDataFrame(EDGE, EDGE_SCHEMA)
    rows = bpe_tree.round_trip(df, RANKS, P.PATTERN).collect()
    assert sorted((r.id is None, r.id or 0, bytes(r.decoded)) for r in rows) == sorted((i is None, i or 0, (t or "").encode()) for i, t, _ in EDGE)
    assert bpe_tree.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0
    assert bpe_tree.with_tokens(df, RANKS, P.PATTERN).where("round_trip").count() == len(EDGE)


def library_ids(texts):
    """Expected ids, from a tokenizer of the library as it is loaded."""
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]


def encoded(enc, texts):
    ids, sizes = enc.encode(pa.array(texts, pa.string()))
    assert len(ids) == sizes.sum()
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


BREAKS = st.lists(st.sampled_from(list(" \n\t.,;:!?a'sé1x漢_\u00a0\x1c\x01") + ["  ", " a", "b.", "c,d", "a\nb", "\r\n", "<|endoftext|>", "<|endoftext", "é.\nA", "3,5", "...", "\u0301."]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(BREAKS, max_size=6))
def test_pieces_equal_library(texts):
    assert encoded(token_planes.encoder(P.path("byte_bpe_50k.json")), texts) == library_ids(texts)


def test_added_tokens_equal_fresh_library():
    texts = ["x <|endoftext|> y", "<|endoftext|>", "vor <|endoftext|> nach", "a<|endoftext|>  <|endoftext|>b c", "<|endoftext |>", "ohne Zeichen"]
    want = library_ids(texts)
    assert encoded(token_planes.PieceEncoder(P.path("byte_bpe_50k.json")), texts) == want and want[:2] == [[87, 220, 50256, 331], [50256]]


def test_other_tokenizers_are_not_cut(tmp_path):
    import json

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "Lowercase"}
    (path := tmp_path / "lower.json").write_text(json.dumps(spec), encoding="utf-8")
    enc = token_planes.PieceEncoder(str(path))
    texts = ["Ein Text, der GROSS ist.\nZwei", ""]
    assert encoded(enc, texts) == library_ids([t.lower() for t in texts])


def test_plane_file_round_trip():
    rng = np.random.default_rng(1)
    docs = [(i if i % 3 else None, rng.integers(0, 60000, n).astype(np.uint32)) for i, n in enumerate([0, 5, 1, 0, 300, 64, 7])]
    sink = io.BytesIO()
    w = token_planes.PlaneWriter(sink, block=64)
    for part in (docs[:3], docs[3:]):
        w.add(pa.array([n for n, _ in part]), np.array([len(x) for _, x in part]), np.concatenate([x for _, x in part]))
    total = w.close()
    r = token_planes.PlaneReader(sink, len(sink.getvalue()))
    assert r.names.to_pylist() == [n for n, _ in docs]
    assert all(np.array_equal(a, b) for a, (_, b) in zip(r.documents(), docs))
    flat = np.concatenate([x for _, x in docs])
    assert total == len(flat)
    for a, b in ((0, 0), (0, total), (63, 65), (200, 260), (total - 1, total + 9)):
        assert np.array_equal(r.range(a, b), flat[a:b])
    empty = io.BytesIO()
    assert token_planes.PlaneWriter(empty).close() == 0
    assert list(token_planes.PlaneReader(empty, len(empty.getvalue())).documents()) == []


@pytest.mark.parametrize("options", [{}, {"file_ids": 40, "block": 64}, {"file_docs": 1, "partitions": 2}])
def test_planes_edges(spark, options):
    df = spark.createDataFrame(EDGE, EDGE_SCHEMA)
    path = P.path("byte_bpe_50k.json")
    rows = sorted(token_planes.token_planes(df, path, 2, **options).collect(), key=lambda r: r.start)
    at = 0
    want = []
    for (i, t, _), ids in zip(EDGE, library_ids([t or "" for _, t, _ in EDGE])):
        ids = ids + [2]
        want.append((i is not None, i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r.id is not None, r.id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted(want)
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert [r.id for r in rows] == sorted((r.id for r in rows), key=lambda i: (i is not None, i or 0)) and len(rows) == len(EDGE) and token_planes.token_planes(df.limit(0), path, 2).count() == 0


LANG_WORDS = {"en": "the and of to in that is was for with".split(), "de": "der die und das ist nicht ein mit auf für".split(), "fr": "le la les et est dans que pour une avec".split()}


def _lang_texts(n, seed):
    rng = random.Random(seed)
    return [(lang, " ".join(rng.choice(w) for _ in range(rng.randint(5, 40)))) for _ in range(n) for lang, w in LANG_WORDS.items()]


def plain_subwords(text, buckets):
    """Byte n-grams of the folded text, by plain integers; single bytes and pairs do not begin with a blank."""
    t = [32] + [(b | 0x20) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text] + [32]
    out = []
    for n in range(1, 5):
        for i in range(len(t) - n + 1):
            if n <= 2 and t[i] == 32:
                continue
            h = 0
            for k, b in enumerate(t[i : i + n], 1):
                h = (h * 0x01000193 + b + k) % 2**32
            h ^= h >> 15
            h = h * 0x85EBCA6B % 2**32
            h ^= h >> 13
            out.append(h % buckets)
    return out


def test_language_scores_equal_mean_then_layer():
    """The folded table against embeddings that are averaged first and then go through layer and softmax."""
    train = _lang_texts(20, 5)
    names, buckets = sorted(LANG_WORDS), 1 << 10
    hashed = [np.unique(plain_subwords(t.encode(), buckets), return_counts=True) for _, t in train]
    y = np.array([names.index(x) for x, _ in train])
    emb, layer, bias = langid._sgd([(r, c.astype(float)) for r, c in hashed], y, 3, buckets, 8, 3, 1.0, 7)
    model = langid.LanguageModel(names, emb @ layer, bias, temperature=0.7, buckets=buckets)
    texts = ["der die das", "The  ÉTÉ 12", "x", "漢字 und", "a" * 300]
    for t, p in zip(texts, model.scores([t.encode() for t in texts])):
        z = (np.mean([emb[h] for h in plain_subwords(t.encode(), buckets)], axis=0) @ layer + bias) / 0.7
        assert np.allclose(p, np.exp(z) / np.exp(z).sum())
    fitted = langid.fit([t for _, t in train], [x for x, _ in train], buckets=buckets)
    assert set(fitted.languages) == set(names)


def test_language_accuracy_on_held_out():
    train, test = _lang_texts(60, 1), _lang_texts(30, 2)
    m = langid.fit([t for _, t in train], [x for x, _ in train])
    p = m.scores([t.encode() for _, t in test])
    assert np.mean([m.languages[i] == x for i, (x, _) in zip(p.argmax(1), test)]) >= 0.98
    assert np.allclose(p.sum(1), 1) and 0 <= m.threshold <= 1


def test_language_edges(spark):
    train = _lang_texts(40, 3)
    df = spark.createDataFrame([(i, t, x, 0.0) for i, (x, t) in enumerate(train)], "doc_id long, text string, lang string, score double")
    model = langid.fit_sample(df, "text", "lang", "doc_id")
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (None, "und das ist"), (5, "x" * 50000), (5, "x" * 50000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    rows = langid.identify(edge, model).collect()
    assert len(rows) == 6
    und = {r.id: (r.score, r.rejected) for r in rows if r.lang_pred == "und"}
    assert und == {1: (0, True), 2: (0, True), 3: (0, True)}
    assert [r.lang_pred for r in rows if r.id is None] == ["de"]
    none = langid.fit_sample(df.limit(0), "text", "lang", "doc_id")
    assert {r.lang_pred for r in langid.identify(edge, none).collect()} == {"und"}
    out = langid.op1_langid(df)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == len(train)


def test_language_sample_is_not_filled_by_one_id(spark):
    ids = [r.id for r in spark.range(40).orderBy(F.xxhash64("id")).collect()]
    rows = [(ids[0], f"the and of {i}", "en") for i in range(60)] + [(i, None, "fr") for i in ids[1:11]] + [(i, "der die und das", "de") for i in ids[11:]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(langid.fit_sample(df, "text", "lang", "doc_id", 10).languages) == ["de", "en"]


def _toxic_texts(n, seed):
    rng = random.Random(seed)
    plain = [f"wort{i}" for i in range(200)]
    out = []
    for _ in range(n):
        toxic = rng.random() < 0.25
        words = [rng.choice(plain) for _ in range(rng.randint(8, 60))]
        if toxic:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(["scheusal", "trottelhaft", "trottelig", "v3rdammt"]))
        out.append((" ".join(words), int(toxic)))
    return out


def test_toxicity_on_held_out():
    train, test = _toxic_texts(700, 1), _toxic_texts(300, 2)
    m = toxicity.fit([t for t, _ in train], [y for _, y in train])
    s = m.scores([t.encode() for t, _ in test] + [b""])
    y = np.array([y for _, y in test], bool)
    assert ((s[:-1] >= 0.5) == y).mean() >= 0.97 and (s >= 0).all() and (s <= 1).all() and s[-1] < 0.5


def test_isotonic_against_minmax():
    """Pooled means against the largest of least means over all ranges, with ties."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        score, y = rng.integers(0, 9, 25) / 8, rng.integers(0, 2, 25).astype(float)
        at, of, w = np.unique(score, return_inverse=True, return_counts=True)
        total = np.bincount(of, y)
        mean = lambda a, b: total[a : b + 1].sum() / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
        blocks = toxicity.pooled(score, y)
        got = [next(v / c for v, c, lo, hi in blocks if lo <= s <= hi) for s in at]
        assert np.allclose(got, want)
        x, p = toxicity.isotonic(score, y)
        assert (np.diff(x) >= 0).all() and (np.diff(p) >= 0).all()


def test_trees_against_a_walk():
    """Scores of boosted trees, node by node and without bins."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 5)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=300) * 0.3 > 0.4).astype(float)
    forest = toxicity.boost(x, y, rounds=12)
    new = np.concatenate([x[:40], np.round(rng.normal(size=(40, 5)) * 2, 1)])

    def walk(row):
        out = forest.base
        for feature, bound, leaf in forest.trees:
            node = 0
            while node < len(feature):
                cuts = forest.cuts[feature[node]]
                right = bound[node] < len(cuts) and row[feature[node]] > cuts[bound[node]]
                node = 2 * node + (2 if right else 1)
            out += leaf[node - len(feature)]
        return out

    assert np.allclose(forest.raw(new), [walk(r) for r in new])
    assert ((forest.raw(x) > 0) == y).mean() > 0.8


def test_long_words_are_told_apart():
    """Words that begin alike are different words, however long."""
    a, b = "x" * 40 + "a", "x" * 40 + "b"
    w = toxicity.Words([a.encode(), b.encode(), (a + " " + b).encode(), ("y" * 5000).encode()])
    assert w.whole[0] != w.whole[1] and w.whole[0] == w.whole[2] and w.whole[1] == w.whole[3] and len(set(w.whole.tolist())) == 3


def test_clashing_labels_count_as_toxic(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.labelled(docs, labels, 10).collect()}
    assert {i: t for i, t in got.items()} == {i: t for i, t in {1: 1, 2: 0}.items() if zlib.crc32(str(i).encode()) % 5}


def test_sample_bytes(spark):
    from taskloom.llm.common import first_rows

    df = spark.createDataFrame([(i, "x" * 10) for i in range(20)] + [(-1, "y" * 1000)], "o int, t string")
    assert [r.o for r in first_rows(df, ["o"], "t", 50, 35).collect()] == [-1]
    assert [r.o for r in first_rows(df.where("o >= 0"), ["o"], "t", 50, 35).collect()] == [0, 1, 2]
    assert first_rows(df, ["o"], "t", 4, 10**9).count() == 4


def test_digests_of_tree_query(spark):
    """Digests of the query from ids of the library itself."""
    import hashlib

    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    library = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={})
    docs = [(i, t) for i, (_, t, _) in enumerate(EDGE)] + [(9, "don't STOP 12345 <|endoftext|> \u00a0 x\n\n  y 😀")]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_tree.encode_decode_digests(spark.createDataFrame(docs, "doc_id long, text string"), RANKS, P.PATTERN).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in docs:
        ids = library.encode_ordinary(t or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))


def test_result_names_that_clash(spark):
    df = spark.createDataFrame([(1, "ein Text")], "doc_id long, text string").withColumns({n: F.lit("own") for n in ("token_ids", "Round_Trip", "toxicity", "score", "decoded")})
    out = bpe_tree.with_tokens(df, RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "text", "toxicity", "score", "decoded", "token_ids", "round_trip"] and out.first().round_trip
    scored = toxicity.score(df, toxicity.ToxicityModel(None, None, None, 0.25), out_col="Score")
    assert scored.columns == ["doc_id", "text", "token_ids", "Round_Trip", "toxicity", "decoded", "Score"] and scored.first().Score == 0.25


def test_toxicity_edges(spark):
    train = _toxic_texts(300, 3)
    docs = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(train)] + [(None, None, ""), (900, "", ""), (900, "", ""), (901, "scheusal " * 20000, "")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(train)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = toxicity.op7_toxicity(docs, labels)
    rows = out.collect()
    assert len(rows) == len(train) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert next(r for r in rows if r.doc_id == 901).predicted == 1
    assert {r.score for r in toxicity.op7_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.op7_toxicity(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("rows", [1, 3])
def test_sample_bound(spark, rows):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert toxicity.labelled(docs, labels, rows).count() == rows
