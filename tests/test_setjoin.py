"""Set-similarity joins and the bounded duplicate search against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from taskloom.operators import setjoin, similarity


def jaccard(a, b):
    a, b = set(a or []), set(b or [])
    return len(a & b) / len(a | b) if a | b else 1.0


def dice(a, b):
    a, b = set(a or []), set(b or [])
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def random_sets(seed, n):
    rng = random.Random(seed)
    words = ["und", "der", "die"] + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.1:
            rows.append((i, rng.choice([None, [], ["und"], ["und", "und"]])))
        elif kind < 0.45 and rows:  # near copies and copies
            base = list(rng.choice(rows)[1] or ["x"])
            rows.append((i, base[: len(base) - rng.randint(0, 2)] + rng.sample(words, rng.randint(0, 2))))
        else:
            rows.append((i, ["und", *rng.sample(words, rng.randint(1, 14))]))
    return rows


@pytest.mark.parametrize("measure, of", [("jaccard", jaccard), ("dice", dice)])
@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_similar_equals_all_pairs(spark, measure, of, least):
    rows, others = random_sets(1, 120), random_sets(2, 60)
    a, b = (spark.createDataFrame(x, "id long, tokens array<string>") for x in (rows, others))
    got = {(r.a, r.b): r.similarity for r in setjoin.similar(a, None, least, measure).collect()}
    want = {(i, j): of(x, y) for i, x in rows for j, y in rows if i < j and of(x, y) >= least}
    assert got == pytest.approx(want)
    got = {(r.a, r.b): r.similarity for r in setjoin.similar(a, b, least, measure).collect()}
    assert got == pytest.approx({(i, j): of(x, y) for i, x in rows for j, y in others if of(x, y) >= least})


@pytest.mark.parametrize("measure, of", [("jaccard", jaccard), ("dice", dice)])
def test_sharing_gives_every_pair_with_a_common_token(spark, measure, of):
    rows, others = random_sets(1, 60), random_sets(2, 40)
    a, b = (spark.createDataFrame(x, "id long, tokens array<string>") for x in (rows, others))
    got = {(r.a, r.b): r.similarity for r in setjoin.sharing(a, None, measure).collect()}
    assert got == pytest.approx({(i, j): of(x, y) for i, x in rows for j, y in rows if i < j and of(x, y) > 0})
    got = {(r.a, r.b): r.similarity for r in setjoin.sharing(a, b, measure).collect()}
    assert got == pytest.approx({(i, j): of(x, y) for i, x in rows for j, y in others if of(x, y) > 0})


def test_a_word_of_all_sets_makes_no_pairs(spark):
    rows = [(i, ["und", "der", *(f"w{i}-{k}" for k in range(8))]) for i in range(300)]
    sets = spark.createDataFrame(rows, "key long, tokens array<string>").withColumn("least", F.lit(0.5))
    own = setjoin.index(sets, setjoin.counted(sets))
    assert setjoin.meetings(own, own, other=True).count() == 0 and own.where("token in ('und', 'der')").count() == 0


TEXTS = ["Berechne die Summe von 3 und 4.", "Berechne die Summe von 3 und 5!", "Löse die Gleichung x + 2 = 7.", "Zeichne ein Dreieck mit drei Seiten.", "Verdopple die Zahl und addiere 3.", "Multipliziere 2 die Zahl und add 3.", "a) 3+4\nb) 5+6\nc) 7+8", "", "7", "!!!", "Formuliere einen Term zur Aufgabe", "Bestimme den Umfang des Rechtecks mit den Seiten 3 cm und 4 cm und zeichne es."]


@pytest.mark.parametrize("seed", [1, 2])
def test_bounded_search_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    topics = ["A", "B", "C", "D"]

    def task():
        t = rng.choice(TEXTS)
        return t if rng.random() < 0.4 else " ".join(rng.sample(t.split(" ") + rng.choice(TEXTS).split(" "), len(t.split(" "))))

    drafts = [(i, rng.choice(["", "Summe", "Aufgabe 3"]), task(), rng.choice(["7", "8", None, ""]), rng.sample(topics, rng.randint(0, 4))) for i in range(30)]
    pool = [(i % 70, rng.choice(["", "Summe", "Terme"]), task(), rng.choice(["7", "8"]), rng.choice(topics), i) for i in range(100)]  # tasks of several topics and texts
    d = spark.createDataFrame(drafts, "draft_id long, title string, question_text string, class_level string, topics array<string>")
    p = spark.createDataFrame(pool, "task_id long, title string, question_text string, class_level string, topic string, scan_ord long")
    a = similarity.features(d, "question_text", "title").select("draft_id", "class_level", "topics", F.col("f").alias("fa"))
    b = similarity.features(p, "question_text", "title").select("task_id", "class_level", "topic", "scan_ord", F.col("f").alias("fb"))
    every = {(r.draft_id, r.scan_ord): r.score for r in similarity.with_score(a.join(b, "class_level")).select("draft_id", "scan_ord", "score").collect()}
    want = set()
    for i, _, _, level, own in drafts:
        seen, best = set(), 0.0
        for rank, topic in enumerate(own if level else []):
            for task_id, _, _, its_level, its_topic, at in pool:
                if (its_level, its_topic) == (level, topic) and task_id not in seen:
                    seen.add(task_id)
                    if every[i, at] >= 0.46:
                        want.add((i, task_id, rank, at, round(every[i, at], 9)))
                        best = max(best, every[i, at])
            if best >= 0.84:
                break
    counts = []
    got = {(r.draft_id, r.task_id, r.topic_rank, r.scan_ord, round(r.score, 9)) for r in similarity.candidates(d, p, counts=counts).collect()}
    assert got == want and len(want) > 10
    assert sum(n for _, n in counts) < len(every)


def test_drafts_with_a_strong_match_form_no_more_pairs(spark):
    text = "Bestimme den Umfang des Rechtecks mit den Seiten 3 cm und 4 cm."
    d = spark.createDataFrame([(1, "", text, "7", ["A", "B", "C"]), (2, "", text, "7", ["C", "B", "A"])], "draft_id long, title string, question_text string, class_level string, topics array<string>")
    p = spark.createDataFrame([(i, "", text, "7", topic, i) for i, topic in enumerate("AAB")], "task_id long, title string, question_text string, class_level string, topic string, scan_ord long")
    counts = []
    got = similarity.candidates(d, p, counts=counts).collect()
    assert counts == [(0, 2), (1, 3)]  # the first draft stops after its first topic; the second one's round holds B and A
    assert {(r.draft_id, r.task_id) for r in got} == {(1, 0), (1, 1), (2, 2)}


def test_searches_of_nothing(spark):
    d = spark.createDataFrame([], "draft_id long, title string, question_text string, class_level string, topics array<string>")
    p = spark.createDataFrame([], "task_id long, title string, question_text string, class_level string, topic string, scan_ord long")
    assert similarity.candidates(d, p).count() == 0


def test_alike_sets_take_no_shuffle_of_pairs(spark):
    rows = spark.createDataFrame([(i, [f"w{i}-{k}" for k in range(30)] + [f"v{k}" for k in range(20)]) for i in range(200)], "id long, tokens array<string>")
    found = setjoin.similar(rows, None, 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 0 and "CartesianProduct" in plan and "token#" not in plan


def test_texts_are_compared_by_their_trigrams(spark):
    texts = {1: "aaaa bbbb cccc", 2: "aaaa bbbb cccd", 3: "zzz", 4: "aaaa bbbb cccc", 5: None, 6: ""}
    rows = spark.createDataFrame(list(texts.items()), "id long, tokens string")
    got = {(r.a, r.b): r.similarity for r in setjoin.similar(rows, None, 0.6, "dice", similarity.numbered).collect()}
    grams = {k: similarity.numbered(t or "").tolist() for k, t in texts.items()}
    assert got == pytest.approx({(i, j): dice(x, y) for i, x in grams.items() for j, y in grams.items() if i < j and dice(x, y) >= 0.6})


def test_buckets_that_tokens_share_are_told_apart():
    from taskloom.operators import blocks

    rng = random.Random(3)
    sets = [sorted(rng.sample([b << 44 | t for b in range(4) for t in range(12)], rng.randint(0, 30))) for _ in range(60)]
    sets.sort(key=len)
    one = blocks.Block([bytes([i]) for i in range(60)], [len(s) for s in sets], [b"".join(t.to_bytes(8, "little") for t in s) for s in sets], None)
    got = {(i, int(j)): int(c) for i, js, common in blocks.alike(one, one, True, 0.3) for j, c in zip(js, common)}
    assert got == {(i, j): len(set(x) & set(y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and x and jaccard(x, y) >= 0.3}


def test_features_of_the_pool_are_not_written(spark, monkeypatch):
    kept, write = [], similarity.scratch.written
    monkeypatch.setattr(similarity.scratch, "written", lambda df, tag="core": (kept.append((tag, df.schema.simpleString())), write(df, tag))[1])
    text = "Bestimme den Umfang des Rechtecks mit den Seiten 3 cm und 4 cm."
    d = spark.createDataFrame([(1, "", text, "7", ["A"])], "draft_id long, title string, question_text string, class_level string, topics array<string>")
    p = spark.createDataFrame([(1, "", text, "7", "A", 1), (2, "", "etwas ganz anderes", "7", "A", 2)], "task_id long, title string, question_text string, class_level string, topic string, scan_ord long")
    assert [(r.task_id, r.score) for r in similarity.candidates(d, p).collect()] == [(1, 1.0)]
    assert [tag for tag, schema in kept if "chars:array" in schema] == ["drafts"]


@pytest.mark.parametrize("wide", [64, 1 << 16])
def test_many_candidates_are_counted_by_bits(monkeypatch, wide):
    import numpy as np

    from taskloom.operators import blocks

    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    sets = [np.sort(rng.choice(words, rng.integers(300, 700), replace=False)) for _ in range(60)]
    block = lambda own, at: blocks.Block([str(at + i).encode() for i in range(len(own))], [len(s) for s in own], [s.tobytes() for s in own], None)
    x, y = block(sets[:30], 0), block(sets[30:], 30)
    used = []
    monkeypatch.setattr(blocks, "WIDE", wide)
    monkeypatch.setattr(blocks, "_common_bits", lambda *a, f=blocks._common_bits: (used.append(1), f(*a))[1])
    monkeypatch.setattr(blocks, "_common", None)
    for p, q, first, second in ((x, y, sets[:30], sets[30:]), (x, x, sets[:30], sets[:30])):
        common = [[len(np.intersect1d(a, b)) for b in second] for a in first]
        want = {(i, j): n for i, row in enumerate(common) for j, n in enumerate(row) if (p is q) <= (i < j) and n / (len(first[i]) + len(second[j]) - n) >= 0.35}
        got = {(i, int(j)): int(n) for i, js, ns in blocks.alike(p, q, p is q, 0.35) for j, n in zip(js, ns)}
        assert got == want and want
    assert used == [1, 1]


def test_trigrams_of_a_batch_come_in_pieces(spark, monkeypatch):
    import pandas as pd

    texts = ["ab" * 40, "", None, "c" * 300, "d", "efg" * 20]
    monkeypatch.setattr(similarity, "TRIGRAMS_OF", 100)
    out = list(similarity.trigrams.func(iter([pd.Series(texts), pd.Series([], dtype=object)])))
    assert [len(x) for x in out] == [3, 1, 2, 0]
    assert [list(t) for x in out for t in x] == [list(similarity.numbered(t or "")) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    got = {r.id: r.g for r in rows.select("id", similarity.trigrams("t").alias("g")).collect()}
    assert got == {i: list(similarity.numbered(t or "")) for i, t in enumerate(texts)}
