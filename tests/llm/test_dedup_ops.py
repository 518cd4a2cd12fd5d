"""Near copies, components, repeats, embeddings, against brute force."""

import collections
import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from taskloom.llm import components as cc
from taskloom.llm import multi_index, simhash, suffix_dedup


def union(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("task_edges", [0, 10**6])
def test_components_of_chains_and_stars(spark, task_edges):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (100, 101), (None, 3)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long"), task_edges=task_edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert cc.components(spark.createDataFrame([], "a long, b long"), task_edges=task_edges).count() == 0
    chain = list(range(500))
    rng.shuffle(chain)
    df = spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long")
    assert {r.component for r in cc.components(df, task_edges=task_edges).collect()} == {0}


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in (None, "", " \n", "Ein", "zwei Wörter", "A b\tC d\nE Ä", "a b c " * 9):
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain_fingerprint(t)


def planted(rng, n, families):
    """Even fingerprints, and families of some bits apart from their first one."""
    fp = rng.integers(0, 1 << 64, n, np.uint64)
    for _ in range(families):
        base = rng.integers(0, 1 << 64, 1, np.uint64)
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (40, 4)).astype(np.uint64), axis=1)
        fp = np.concatenate([fp, base, base ^ flips])
    return np.unique(fp)


def test_vantage_point_nodes_keep_close_pairs_together():
    fp = planted(np.random.default_rng(1), 1500, 12)
    found, nodes = simhash.leaves(fp, 3, simhash.NODE_LEAF)
    assert len(nodes) > 20  # the nodes do the dividing
    near = {(i, j) for i in range(len(fp)) for j in (np.nonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3)[0] + i + 1).tolist()}
    met = {(a, b) for own in map(sorted, (x.tolist() for x in found)) for k, a in enumerate(own) for b in own[k + 1 :]}
    assert len(near) > 50 and near <= met
    every = len(fp) * (len(fp) - 1) // 2
    assert len(met) < 0.9 * every  # pairs on different sides are never compared
    boundary = sum(inner + outer - n for n, inner, outer in nodes) / sum(n for n, _, _ in nodes)
    assert 0 < boundary < 0.4  # copies of rows near a boundary, which visit both sides


@pytest.mark.parametrize("leaf", [4, 64])
def test_links_through_nodes_within_a_task(spark, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "NODE_LEAF", leaf)
    fp = planted(np.random.default_rng(2), 300, 8)
    at = np.zeros(len(fp), np.int64)
    name, own = simhash._in_leaves(at, fp, 3, leaf)
    i, j = simhash.forest(own, name, 3)
    place = {int(x): k for k, x in enumerate(fp)}
    got = union(len(fp), [(place[int(own[a])], place[int(own[b])]) for a, b in zip(i, j)])
    want = union(len(fp), [(a, b) for a in range(len(fp)) for b in (np.nonzero(np.bitwise_count(fp[a + 1 :] ^ fp[a]) <= 3)[0] + a + 1).tolist()])
    assert got == want


@pytest.mark.parametrize("limit, blocks", [(4096, None), (8, None), (20, 5)])
def test_links_connect_all_close_pairs(spark, limit, blocks):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(12):
        base = x = rng.getrandbits(64)
        for _ in range(25):  # chains and balls of near copies
            fps.add(x)
            x = (x if rng.random() < 0.5 else base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 3])
    pairs = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), limit=limit, blocks=blocks).collect()
    at = {f: i for i, f in enumerate(fps)}
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in pairs)
    assert union(len(fps), [(at[r.a], at[r.b]) for r in pairs]) == want


def test_division_of_even_and_dense_shards(spark):
    """Shards far over the limit: spread fingerprints that agree on a block, and a ball that no vantage point divides."""
    rng = random.Random(9)
    spread = {(5 << 48) | rng.getrandbits(48) for _ in range(260)}
    spread |= {x ^ (1 << rng.randrange(48)) for x in list(spread)[:60]}
    centre = rng.getrandbits(48) | (9 << 48)
    ball = {centre ^ sum(1 << b for b in rng.sample(range(20), rng.randint(2, 9))) for _ in range(200)}
    fps = sorted(spread | ball)
    near = lambda x, y: (x ^ y).bit_count() <= 3
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if near(fps[i], fps[j])])
    rows = spark.createDataFrame([(f,) for f in fps], "fp long")
    parts, _ = simhash.divided(simhash.shards(rows, 4, 3), 16, 3)
    assert parts.groupBy("shard").count().agg(F.max("count")).first()[0] <= 40
    at = {f: i for i, f in enumerate(fps)}
    assert union(len(fps), [(at[r.a], at[r.b]) for r in simhash.links(rows, limit=16).collect()]) == want


def test_block_count_grows_with_the_corpus():
    assert [simhash.block_count(n, 3) for n in (0, 10**6, 10**8, 10**11)] == [4, 4, 5, 6]


def test_simhash_query_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", " \n", "Eins", "eins", "zwei Wörter"]
    for _ in range(25):
        t = [rng.choice(words) for _ in range(rng.randint(40, 90))]
        texts += [" ".join(t), " ".join(t).upper().replace(" ", "\t"), " ".join(t + ["x"]), " ".join(t[:-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [plain_fingerprint(t) for t in texts]
    comp = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(df).collect()}
    assert got == {i: (f"{f:016x}", comp[i]) for i, f in enumerate(fps)}


def test_near_duplicates_edges(spark):
    rows = [(5, "eins zwei drei vier"), (3, "Eins  zwei drei\nvier"), (9, None), (8, ""), (None, "eins zwei drei vier"), (3, "Eins  zwei drei\nvier"), (None, "nur hier steht das"), (7, "x " * 40000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = collections.Counter((r.id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == collections.Counter({(5, 3): 1, (3, 3): 2, (9, 8): 1, (8, 8): 1, (None, 3): 1, (None, None): 1, (7, 7): 1})
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 7), (False, 8), (True, 0)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.one_of_each(df.limit(0)).count() == 0


def plain_repeats(docs, n):
    docs = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    seen = collections.defaultdict(list)
    for r, (_, t) in enumerate(docs):
        w = (t or "").split()
        for p in range(len(w) - n + 1):
            seen[tuple(w[p : p + n])].append((r, p))
    first, later = collections.defaultdict(set), collections.defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            f = min(places)
            for r, p in places:
                (first if r == f[0] and p < f[1] + n else later)[r].update(range(p, p + n))
    return {(docs[r][0], x, False) for r in later for x in later[r]} | {(docs[r][0], x, True) for r in first for x in first[r] - later[r]}


@pytest.mark.parametrize("seed, n", [(1, 24), (2, 50)])
def test_repeats_against_brute_force(spark, seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages = [words(rng.randint(n - 5, 2 * n)) for _ in range(8)]
    docs = []
    for i in range(120):
        t = words(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            t += p[rng.randint(0, 4) : len(p) - rng.randint(0, 3)] + words(rng.randint(0, 8))
        docs.append((i, " ".join(t)))
    x, y = words(80), words(80)  # a passage across two that are known by themselves
    docs += [(500, " ".join(x)), (501, " ".join(y)), (502, " ".join(x + y)), (503, " ".join(words(9) + x[-25:] + y[:25]))]
    docs += [(600, docs[3][1]), (600, docs[3][1]), (None, docs[5][1]), (601, None), (602, ""), (603, "a " * 200), (604, " ".join(vocab[:100] * 3))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("near", F.lit(1))
    got = {(r.id, w, r["first"]) for r in suffix_dedup.repeats(df, min_words=n).collect() for w in range(r.start, r.end)}
    assert got == plain_repeats(docs, n)
    cut = suffix_dedup.cut_repeats(df, min_words=n)
    assert cut.columns == df.columns and suffix_dedup.repeats(cut, min_words=n).where("not first").count() == 0
    lost = {i for i, *_ in docs} - {r.doc_id for r in cut.collect()}
    assert {i for i, t in docs if not (t or "").split()}.isdisjoint(lost)


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_unequal_words_never_repeat(spark):
    """Long words, and sequences of words, that differ in every place of a Thue-Morse pattern."""
    bits = thue_morse(4096)
    letters = ["".join("ab"[x ^ flip] for x in bits) for flip in (0, 1)]
    fill = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(fill[:30] + [w] + fill[30:])) for i, w in enumerate(letters)]
    docs += [(10 + flip, " ".join("xy"[x ^ flip] for x in bits[:2048])) for flip in (0, 1)]
    df = spark.createDataFrame(docs[:2], "doc_id long, text string")
    assert suffix_dedup.repeats(df, min_words=50).count() == 0
    df = spark.createDataFrame(docs[2:], "doc_id long, text string")
    got = {(r.id, w, r["first"]) for r in suffix_dedup.repeats(df, min_words=1200).collect() for w in range(r.start, r.end)}
    assert got == plain_repeats(docs[2:], 1200)


@pytest.mark.parametrize("n", [130, 500])
def test_repeats_of_many_words(spark, n):
    rng = random.Random(n)
    vocab = [f"w{i}" for i in range(400)]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages = [words(rng.randint(n - 9, n + 60)) for _ in range(4)]
    docs = [(i, " ".join(words(rng.randint(0, 30)) + (p := rng.choice(passages))[rng.randint(0, 9) :] + words(7) + rng.choice(passages))) for i in range(14)]
    docs += [(20, "x " * (2 * n)), (21, "x " * (n + 3))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.id, w, r["first"]) for r in suffix_dedup.repeats(df, min_words=n).collect() for w in range(r.start, r.end)}
    assert got == plain_repeats(docs, n)


def test_repeats_of_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.repeats(df).count() == 0 and suffix_dedup.cut_repeats(df).count() == 0
    text = " ".join(f"w{i}" for i in range(70))
    names = ["_own", "_key", "_digest", "_cuts", "__own", "start", "end", "first", "id"]
    df = spark.createDataFrame([(1, text), (2, "y " + text + " z"), (None, text), (3, None), (4, "")], "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    rows = {r.doc_id: r.asDict() for r in suffix_dedup.cut_repeats(df).collect()}
    assert {k: r["text"] for k, r in rows.items()} == {1: text, 2: "y z", 3: None, 4: ""}
    assert all(r[n] == n for r in rows.values() for n in names)


def test_cut_words():
    assert suffix_dedup.cut_words("a  b c\nd e", [(1, 3)]) == "a  d e"
    assert suffix_dedup.cut_words("a b", [(0, 2)]) == ""


def plain_embeddings(rows, cosine):
    ok = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v:
            x = np.array(v, float)
            if np.isfinite(x).all() and x.any():
                ok[k] = x / np.linalg.norm(x)
    edges = [(i, j) for i in ok for j in ok if i != j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine]
    return collections.Counter(i for i, _ in edges), edges


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_against_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        if i % 4 == 0 or not rows:
            v = rng.normal(size=16)
        else:
            v = np.array(rows[i - i % 4][1]) + rng.normal(size=16) * 0.09
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i // 4 % 3)))
    hot = rng.normal(size=16)
    rows += [(1000 + i, [float(x) for x in (hot + rng.normal(size=16) * 0.05).astype(np.float32)], 1) for i in range(60)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1.0], [3.0], [-1.0], [0.5]]
    rows += [(2000 + i, v, 1) for i, v in enumerate(bad)] + [(3000, rows[0][1], None), (3001, rows[0][1], 0), (3001, rows[0][1], 0), (None, rows[8][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("entry", F.lit("clash")).withColumn("n", F.lit(0))
    got = multi_index.near_duplicates(df, block=block, cell_rows=4).collect()
    degree, edges = plain_embeddings(rows, 0.98)
    assert len(got) == len(rows)
    found, all_links = sum(r.n_links for r in got), sum(degree.values())
    assert found <= all_links and found >= 0.9 * all_links
    by_id = {r.id: r for r in got if r.id is not None}
    for k, (i, _, _) in enumerate(rows):
        if i is not None and i != 3001:
            assert by_id[i].n_links <= degree[k]
    assert all(by_id[2000 + i].n_links == 0 and by_id[2000 + i].component_id == 2000 + i for i in range(6)) and by_id[2006].n_links == 1
    assert [by_id[2000 + i].n_links for i in (8, 9, 10, 11)] == [2, 2, 0, 2] and by_id[2011].component_id == 2008
    assert by_id[3000].kept and by_id[3001].component_id == 0
    comp = union(len(rows), edges)
    whole = collections.defaultdict(set)
    for k, (i, _, _) in enumerate(rows):
        whole[comp[k]].add(i)
    for r in by_id.values():  # never across components
        k = next(k for k, (i, _, _) in enumerate(rows) if i == r.id)
        assert r.component_id in whole[comp[k]] and r.kept == (r.component_id == r.id)
    assert multi_index.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_on_the_table(spark):
    """Links of every row whose id is divisible by 20 against all rows, by brute force in double precision.

    The table has few neighbours, so each of these rows gets some, at cosines around the bound.
    """
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "label", "embedding").toPandas()
    fine = rows[rows.label.notna() & rows.embedding.map(lambda v: v is not None and len(v) > 1 and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float)))]
    rng = np.random.default_rng(6)
    added = []
    for r in fine[fine.vec_id % 20 == 0].itertuples():
        v = np.asarray(r.embedding, float)
        for scale in (0.1, 0.16, 0.19, 0.21, 0.3):
            side = rng.normal(size=len(v))
            added.append((10**6 + len(added), r.label, (v + side * np.linalg.norm(v) * scale / np.linalg.norm(side)).astype(np.float32)))
    fine = pd.concat([fine, pd.DataFrame(added, columns=["vec_id", "label", "embedding"])])
    df = spark.createDataFrame([(int(r.vec_id), int(r.label), [float(x) for x in r.embedding]) for r in fine.itertuples()], "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: r.n_links for r in multi_index.op9_multi_index(df).collect()}
    assert len(got) == len(fine)
    found = all_links = 0
    for _, group in fine.groupby("label"):
        x = multi_index.unit(np.stack(group.embedding.to_numpy()))
        for i in np.nonzero(group.vec_id.to_numpy() % 20 == 0)[0]:
            n = int((x @ x[i] >= 0.98).sum()) - 1
            all_links += n
            found += got[int(group.vec_id.iloc[i])]
            assert got[int(group.vec_id.iloc[i])] <= n
    print(f"recall {found / all_links:.4f} of {all_links}")
    assert all_links > 100 and found >= 0.95 * all_links


def test_lengths_that_a_sample_lacks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(40)]
    base = rng.normal(size=5)
    rows += [(100 + i, [float(x) for x in base + rng.normal(size=5) * 0.01], 0) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.id: r.n_links for r in multi_index.near_duplicates(df, sample_rows=1).collect()}
    assert [got[100 + i] for i in range(6)] == [5] * 6 and sum(got.values()) == 30


def five_words(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_prefix_pairs_lose_nothing(spark):
    """Nodes of one bucket whose centres leave most apart: a family just under and just over the bound."""
    from taskloom.llm import near_copies

    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        t = list(base)
        for at in rng.sample(range(0, 120, 6), rng.randint(1, 4)):  # edits that never touch a common shingle
            t[at] = f"e{i % 12}x{at}" if i % 3 else f"e{i}y{at}"
        docs.append(" ".join(t))
    sets = [near_copies.shingles(t) for t in docs]
    df = spark.createDataFrame([(i, len(s), i, s.tobytes()) for i, s in enumerate(sets)], "node long, n long, g long, shingles binary")
    pairs = {tuple(sorted((r.a, r.b))) for r in near_copies.prefix_pairs(df.drop("shingles"), df.select("node", "shingles")).collect()}
    near = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert near <= pairs and 0 < len(near) < 60 * 59 // 2


def test_pipeline_drops_near_copies_at_08(spark):
    """Groups of the near-copy stage are those of all pairs with a five-word Jaccard similarity of 0.8 or more."""
    import corpus_pipeline

    rng = random.Random(3)
    docs = ["", None, " ", "eins zwei", "Eins  zwei", "eins zwei drei"]
    for _ in range(30):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randint(60, 200))]
        docs.append(" ".join(base))
        for _ in range(4):
            for at in sorted(rng.sample(range(len(base)), rng.randint(1, 4))):
                base = base[:at] + ["neu"] + base[at + 1 :]
            docs.append(" ".join(base))
    sets = [five_words(t or "") for t in docs]
    edges = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    docs.append(docs[9] + " zusatz")
    sets.append(five_words(docs[-1]))
    edges += [(len(docs) - 1, j) for j in range(len(docs) - 1) if 5 * len(sets[-1] & sets[j]) >= 4 * len(sets[-1] | sets[j])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert kept == set(union(len(docs), edges)) and len(kept) < len(docs) - 30


@pytest.mark.parametrize("keys", [["k"], ["k", "m"]])
def test_hot_keys_are_looked_up_without_a_shuffle(spark, keys, monkeypatch):
    """One key has a third of all rows; with two hot keys allowed it and no rare one is broadcast."""
    from taskloom.llm import common

    monkeypatch.setattr(common, "HOT_PART", 4)
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 100).alias("k"), F.lit(5).alias("m"), "id").withColumn("name", F.col("id"))
    named = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("k != 7").withColumn("found", F.col("k") * 2)
    got = common.look_up(rows.drop("name"), named, keys, "n")
    assert sorted((r.id, r.k, r.found) for r in got.collect()) == sorted((r.id, r.k, r.k * 2) for r in rows.collect() if r.k != 7)
    assert got.columns == [*keys, *[c for c in ("k", "m", "id") if c not in keys], "found"]
    assert common.look_up(rows.limit(0), named.limit(0), keys, "n").count() == 0
    assert common.look_up(rows, named.limit(0), keys, "n").count() == 0


def test_a_third_of_all_texts_is_empty(spark):
    """Empty texts share one fingerprint, and unusable vectors have no key: both keep a row each."""
    docs = [(i, "" if i % 3 == 0 else f"wort{i} b{i * 7} c{i * 11} d{i}", "x") for i in range(90)]
    got = {r.id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, fp string")).collect()}
    assert len(got) == 90 and all(got[i] == 0 for i in range(0, 90, 3))
    rows = [(i, [0.0, 0.0] if i % 3 == 0 else [float(i), 1.0], 1) for i in range(30)]
    got = multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 30 and all(r.kept and r.n_links == 0 and r.component_id == r.id for r in got if r.id % 3 == 0)


def test_pipeline_links_near_copies_by_the_forest_first(spark, monkeypatch):
    import random

    from taskloom.llm import near_copies, simhash

    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(500)}"
    base = [" ".join(word() for _ in range(400)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate([*base, *(f"{t} ende" for t in base), "", None])), "doc_id long, text string")
    asked, plain = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: asked.append(1) or plain(*a, **k))
    kept = {r.doc_id for r in near_copies.one_of_each(docs).collect()}
    assert asked and kept == {*range(30), 60}
    nodes = docs.select(F.xxhash64("text").alias("node"), "text").where("doc_id < 60").rdd.map(lambda r: (r.node, simhash.fingerprint(r.text, 5))).toDF("node long, fp long")
    found = {frozenset((r.a, r.b)) for r in near_copies.forest_pairs(nodes).collect()}
    ids = {r.n: r.doc_id % 30 for r in docs.where("doc_id < 60").select("doc_id", F.xxhash64("text").alias("n")).collect()}
    assert len(found) >= 20 and all(len({ids[n] for n in p}) == 1 for p in found)
