"""Lempel-Ziv fingerprints, prefix tries and whitening, against brute force."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from taskloom.llm import lz_fingerprint as lz
from taskloom.llm import prefix_trie, queries, whitening

DIR = "/root/testdata/sf0.001"

# Lempel-Ziv fingerprints


def plain_phrases(text):
    known, piece = set(), ""
    for c in text:
        piece += c
        if piece not in known:
            known.add(piece)
            piece = ""
    return known


def plain_signature(text):
    """By phrases as strings, one after the other."""
    out = set()
    for p in plain_phrases(text):
        h = sum((ord(c) + 1) * pow(int(lz._ODD), i, 1 << 64) for i, c in enumerate(p)) % (1 << 64)
        h ^= len(p) * int(lz._M2) % (1 << 64)
        for m in (lz._M1, lz._M2):
            h = (h ^ h >> 33) * int(m) % (1 << 64)
        out.add((h ^ h >> 33) >> 32)
    return sorted(out)[: lz.KEPT]


TEXTS = [None, "", "a", "aaaa", "ab" * 500, "Ein Satz. 𝒳 und é\n" * 40, "x" * 3000, "".join(random.Random(3).choices("abcde ", k=9000))]


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_signature_is_that_of_the_phrase_set(monkeypatch, block):
    monkeypatch.setattr(lz, "BLOCK", block)
    for t in TEXTS:
        assert lz.signature(t).tolist() == plain_signature(t or "")
        for u in TEXTS:
            own, other = lz.signatures(t or "", u or "")
            assert own.tolist() == plain_signature(t or "") and other.tolist() == plain_signature(lz.edited(t or "", u or ""))


def test_a_new_dictionary_begins_when_one_is_full(monkeypatch):
    monkeypatch.setattr(lz, "DICTIONARY", 16)
    text = TEXTS[-1]
    for cut in (text, text[:500], text[:37]):
        own, other = lz.signatures(cut, text[::-1])
        assert own.tolist() == lz.signature(cut).tolist() and other.tolist() == lz.signature(lz.edited(cut, text[::-1])).tolist()
    assert len(lz.signature(text)) == lz.KEPT


def test_likeness():
    a, b = ("".join(random.Random(s).choices("etaoin shrdlu", k=60000)) for s in (1, 2))
    for x, y in ((a, b), (a, a[:40000] + b[:20000]), (a, a)):
        p, q = plain_phrases(x), plain_phrases(y)
        assert abs(lz.likeness(lz.signature(x), lz.signature(y)) - len(p & q) / len(p | q)) < 0.15
    p, q = plain_phrases("abcabcd"), plain_phrases("abcabce")
    assert lz.likeness(lz.signature("abcabcd"), lz.signature("abcabce")) == len(p & q) / len(p | q)  # exact for small sets
    assert lz.likeness(lz.signature(""), lz.signature("")) == 1.0 and lz.likeness(lz.signature(""), lz.signature("a")) == 0.0
    assert lz.from_text(lz.as_text(lz.signature(a))).tolist() == lz.signature(a).tolist()


def plain_edits(rows):
    """rows: (id, text) in order."""
    out = []
    for k, (i, t) in enumerate(rows):
        t, u = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = lz.edited(t, u)
        s, x, y = lz.signature(t), lz.signature(e), lz.signature(u)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), lz.as_text(s), lz.as_text(x), lz.likeness(s, x), lz.likeness(s, y)))
    return out


@pytest.mark.parametrize("ids", ["even", "few", "one"])
def test_edits_against_plain_order(spark, ids):
    rng = random.Random(8)
    if ids == "even":
        rows = [(i * 3 - 100, rng.choice([None, "", "kurz", "Wort " * rng.randint(1, 300), str(rng.random()) * 20])) for i in range(150)]
    else:
        rows = [(5, "allein " * 9)] if ids == "one" else [(7, "zwei Texte " * 4), (-2, "sind hier"), (9, None)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").withColumnRenamed("nothing", "x").repartition(3)
    got = [tuple(r) for r in lz.op11_lz_fingerprint(df).collect()]
    assert sorted(got) == plain_edits(sorted(rows, key=lambda r: r[0]))


def test_edits_with_repeated_and_null_ids(spark):
    from pyspark.sql import functions as F

    rows = [(None, "a b c d " * 20), (None, None), (4, "x y z " * 9), (4, "x y z " * 9), (4, "other words " * 9), (4, ""), *((i, f"text {i} " * 5) for i in range(5, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [(r.doc_id, r.text) for r in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in lz.op11_lz_fingerprint(df).collect()), key=key) == sorted(plain_edits(order), key=key)


def test_fingerprints_of_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lz.op11_lz_fingerprint(empty).count() == 0 and lz.fingerprints(empty).count() == 0
    df = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (3, "Text " * 50_000, "old")], "doc_id long, text string, Fingerprint string")
    got = lz.fingerprints(df)
    assert got.columns == ["doc_id", "text", "fingerprint"]
    assert {r.doc_id: r.fingerprint for r in got.collect()} == {1: "", 2: "", 3: lz.as_text(lz.signature("Text " * 50_000))}
    pairs = spark.createDataFrame([("", ""), ("0000000100000002", "00000002"), (None, "")], "a string, b string")
    assert [r.likeness for r in lz.similar(pairs, "a", "b").collect()] == [1.0, 0.5, None]


def test_op11_over_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()]
    got = [tuple(r) for r in queries.op11_lz_fingerprint(spark, DIR).collect()]
    assert sorted(got) == plain_edits(rows)
    by_text = collections.defaultdict(set)
    for (_, t), r in zip(rows, sorted(got)):
        by_text[t].add(r[3])
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(r[5] > r[6] for r in got) > 0.98 * len(got)


# Prefix tries


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    ends = {p: ",".join(str(c) for c in cs if whole[c] == p) for p, cs in members.items()}
    key = lambda r: (r[0], r[1])
    return sorted(((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, cs in members.items()), key=key)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: (r[0], r[1]))


def talk(rng, n_convs, longest, words):
    rows = []
    for c in rng.sample(range(-150, 700), n_convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = talk(rng, 150, 7, ["a", "b", None, "ä𝒳", "a longer text"][: seed + 2])
    rows += [(c, t, "user", "same") for c in (900, 901, 950, 999) for t in range(8)] + [(None, 1, "user", "a")]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "conv_id long, turn long, role string, text string").repartition(3)
    assert rows_of(prefix_trie.op12_prefix_trie(df)) == plain_trie(rows)


def test_long_and_hot_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "ROWS", 10)
    rng = random.Random(4)
    rows = [(c, t, "user", "ab"[t * t % 7 == c % 2]) for c in (100, 105, 106, 107) for t in range(60)]  # all blocks of one conversation end somewhere else
    rows += [(c, t, "u", "x") for c in range(200, 260) for t in range(9)]  # a group of copies
    rows += [(300, t, "u", "y" * (t % 5)) for t in range(700)]  # a conversation with a third of all turns
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "conv_id long, turn long, role string, text string").repartition(4)
    steps = prefix_trie.steps(df)
    whole = prefix_trie.rebuilt(steps)
    assert rows_of(prefix_trie.trie(whole)) == plain_trie(rows)


def test_trie_edge_tables(spark):
    schema = "conv_id long, turn long, role string, text string, node string, part long"
    assert prefix_trie.op12_prefix_trie(spark.createDataFrame([], schema)).count() == 0
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)  # its shared turns come from conversation 0, which is not there
    rows = [(turnless, 0, "user", "gone")]
    got = rows_of(prefix_trie.op12_prefix_trie(spark.createDataFrame([(*r, "z", 1) for r in rows], schema)))
    assert got == plain_trie(rows) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    long = [(7, t, None, "w" * 100_000) for t in range(8)]
    assert rows_of(prefix_trie.op12_prefix_trie(spark.createDataFrame([(*r, "z", 1) for r in long], schema))) == plain_trie(long)


def test_op12_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{DIR}/conversations.parquet')")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.ORACLE})").fetchall()
    got = rows_of(queries.op12_prefix_trie(spark, DIR))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == plain_trie(rows)


# Whitening


def plain_whitening(rows):
    kept = [(i, [int(np.floor(256.0 * float(c))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - t / n for c, t in zip(x, s)] for x in fit])
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, x in kept:
        for k in range(min(4, len(s))):
            w = float(np.array([c - t / n for c, t in zip(x, s)]) @ v[:, k]) / np.sqrt(e[k])
            out.setdefault((i, k + 1), []).append((n, sum((n * c - t) ** 2 for c, t in zip(x, s)), w, e[k] / np.trace(cov)))
    return out


def check_whitening(got, want):
    found = collections.defaultdict(list)
    for r in got:
        found[(r[0], r.component)].append(r)
    assert found.keys() == want.keys() and all(len(found[k]) == len(want[k]) for k in want)
    for comp in sorted({k[1] for k in want}):
        pairs = [(found[k][0], want[k][0]) for k in want if k[1] == comp]
        big = max(pairs, key=lambda p: abs(p[1][2]))
        sign = np.sign(big[0].whitened * big[1][2])
        for g, w in pairs:
            assert (g.n, g.deviation) == w[:2]
            assert abs(g.whitened * sign - w[2]) < 1e-7 and abs(g.explained / w[3] - 1) < 1e-6
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_eigenvectors_by_symmetric_qr():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64):
        a = rng.normal(size=(n, n))
        a = a @ a.T * 1e6
        for m in (a, np.diag(np.diag(a)), np.ones((n, n)), np.zeros((n, n))):
            e, v = whitening.eigen(m)
            top = np.abs(e).max() or 1.0
            assert np.allclose(e, np.linalg.eigvalsh(m)[::-1], atol=1e-12 * top)
            assert np.allclose(v.T @ v, np.eye(n), atol=1e-12) and np.allclose(m @ v, v * e, atol=1e-11 * top)


def test_states_merge_to_the_state_of_all():
    rng = np.random.default_rng(3)
    xs = rng.integers(-(2**40), 2**40, (200, 5))
    parts = []
    for own in np.split(xs, [3, 4, 120]):
        s = whitening.State(5)
        for x in own:
            s.add(x)
        parts.append(s)
    s = whitening.State(5)
    for p in parts:
        s.merge(p.n, p.mean, p.moments, p.high, p.low)
    assert [(h << 32) + int(low) for h, low in zip(s.high.tolist(), s.low)] == xs.sum(axis=0).tolist()
    assert np.allclose(s.moments / s.n, np.cov(xs.T, bias=True), rtol=1e-10) and np.allclose(s.mean, xs.mean(axis=0))


@pytest.mark.parametrize("fan_in", [32, 2])
def test_whitening_equals_brute_force(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.1] + 1000).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(100)]  # a third of all rows are copies
    rows += [(2000, None), (2001, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (2002, [float("nan")] * 6), (2003, [float("inf"), *[0.0] * 5]), (2004, []), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = whitening.op13_whitening(df).collect()
    check_whitening(got, plain_whitening(rows))


def test_whitening_edge_tables(spark):
    schema = "vec_id long, embedding array<float>, n long, whitened double"
    assert whitening.op13_whitening(spark.createDataFrame([], schema)).count() == 0
    assert whitening.op13_whitening(spark.createDataFrame([(1, None, 1, 1.0), (2, [], 1, 1.0)], schema)).count() == 0
    one = whitening.op13_whitening(spark.createDataFrame([(1, [0.5, 2.0], 1, 1.0)], schema)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 1, 0, None, None, 0.0), (1, 2, 1, 0, None, None, 0.0)]
    flat = whitening.op13_whitening(spark.createDataFrame([(i, [float(i), 2.0, -1.0], 1, 1.0) for i in range(9)], schema)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in flat) and all(r.explained == (r.component == 1) for r in flat)
    lengths = spark.createDataFrame([(i, [float(i * i % 7), float(i)][: 1 + i % 2], 1, 1.0) for i in range(20)], schema)
    assert {(r.vec_id % 2, r.component, r.n) for r in whitening.op13_whitening(lengths).collect()} == {(0, 1, 4), (1, 1, 10), (1, 2, 10)}
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.op13_whitening(huge).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id < 3)


def test_op13_over_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    check_whitening(queries.op13_whitening(spark, DIR).collect(), plain_whitening(rows))
