import hashlib

from pyspark.sql import functions as F

from taskloom.functions import classify, documents, guard, textual
from taskloom.operators import segment
from taskloom.operators import similarity as sim


def test_text_primitives(ev):
    assert ev(textual.trim(F.lit(" \u00a0\n a \ufeff"))) == "a"
    assert ev(textual.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1
    assert ev(textual.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0
    assert abs(ev(textual.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) - 1 / 3) < 1e-12
    assert ev(F.transform(textual.chunks(F.lit("x" * 4000)), F.length)) == [1900, 1900, 200]
    assert ev(textual.chunks(F.lit(""))) == []
    assert ev(textual.circled(F.lit("①⑩"), ".")) == "1.10."


def test_similarity_pieces(ev):
    stem = sim.stem
    assert ev(sim.prose_tokens(sim.word_tokens(F.lit("die gleichungen der aufgaben")))) == ["gleich", "aufgab"] and ev(sim.prose_tokens(sim.word_tokens(F.lit("")))) == []
    assert stem("gleichungen") == "gleich" and stem("aufgaben") == "aufgab"
    assert ev(sim.number_tokens(F.lit("x12 -3,5 +2"))) == ["2", "-3.5", "+2"]
    assert ev(sim.math_tokens(F.lit("möglich x"))) == ["m", "x"]
    tri = lambda t: sim.trigrams(F.lit(t))
    assert ev(sim.dice(tri("ab"), tri("ac"))) == 0.25 and ev(sim.dice(tri(""), tri(""))) == 1


def plain_dice(a, b):
    from collections import Counter

    grams = lambda t: Counter(f"  {t}  "[i : i + 3] for i in range(len(t) + 2))
    x, y = grams(a), grams(b)
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def test_dice_is_a_multiset(ev):
    for a, b in (("aaaa", "aaaaaa"), ("abcabc", "abc"), ("x y x y", "y x")):
        assert abs(ev(sim.dice(sim.trigrams(F.lit(a)), sim.trigrams(F.lit(b)))) - plain_dice(a, b)) < 1e-12


def _scores(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    rows = sim.features(rows, "a").withColumnRenamed("f", "fa")
    rows = sim.features(rows, "b").withColumnRenamed("f", "fb")
    return [r.score for r in sim.with_score(rows).orderBy("i").select("score").collect()]


def test_score_bounds_and_symmetry(spark):
    a, b, c = "Drücke die Summe aus 3 und x mit einem Term aus.", "Stelle die Summe aus 4 und y als Term dar.", "Zeichne ein Dreieck mit drei Winkeln."
    s = _scores(spark, [(a, a.upper()), (a, ""), (a, b), (b, a), (a, c), (c, c)])
    assert s[0] == 1 and s[1] == 0 and s[5] == 1
    assert abs(s[2] - s[3]) < 1e-12 and s[4] < s[2] <= 1


def test_topic_order(ev):
    order = lambda t: ev(sim.topic_order(F.lit(t), sim.class_topics(F.lit("7")), sim.related_topics(F.lit(t))))
    assert order("Terme") == ["Terme", "Gleichungen", "Rationale Zahlen", "Prozentrechnung", "Zuordnung"]
    assert order("Statistik") == ["Terme", "Rationale Zahlen", "Gleichungen", "Prozentrechnung", "Zuordnung"]


def test_candidates_against_loop(spark):
    words = "rechne den term mit zahlen aus und zeichne eine gerade durch zwei punkte der ebene".split()
    text = lambda k: " ".join(words[(k * j) % len(words)] for j in range(1, 12))
    topics = ["t0", "t1", "t2"]
    pool = [(k, f"titel {k % 4}", text(k % 7 + 1), "7", f"t{k % 3}", k) for k in range(24)]
    drafts = [(k, f"titel {k}", text(k + 1), "7", topics[k % 3 :] + topics[: k % 3]) for k in range(5)] + [(9, "x", text(1), None, topics)]
    p = spark.createDataFrame(pool, "task_id int, title string, question_text string, class_level string, topic string, scan_ord int")
    d = spark.createDataFrame(drafts, "draft_id int, title string, question_text string, class_level string, topics array<string>")
    cross = d.where("class_level is not null").select("draft_id", F.col("question_text").alias("qa"), F.col("title").alias("ta")).join(p.select("task_id", F.col("question_text").alias("qb"), F.col("title").alias("tb")))
    cross = sim.features(cross, "qa", "ta").withColumnRenamed("f", "fa")
    cross = sim.features(cross, "qb", "tb").withColumnRenamed("f", "fb")
    score = {(r.draft_id, r.task_id): r.score for r in sim.with_score(cross).select("draft_id", "task_id", "score").collect()}
    want = []
    for i, _, _, level, order in drafts:
        got = []
        for rank, t in enumerate(order if level else []):
            got += [(-score[i, k], rank, k) for k, _, _, _, topic, _ in pool if topic == t and score[i, k] >= 0.46]
            if got and -min(got)[0] >= 0.84:
                break
        want += [(i, n + 1, k, -s) for n, (s, _, k) in enumerate(sorted(x for x in got if -x[0] >= 0.5)[:5])]
    top = sorted(map(tuple, sim.top_duplicates(sim.candidates(d, p)).collect()))
    assert top == sorted(want) and want


def test_include_is_switched_off(spark):
    d = spark.createDataFrame([(1, "a", "Rechne 3 plus 4", "7", ["t"], True), (2, "a", "Etwas ganz anderes", "7", ["t"], True)], "draft_id int, title string, question_text string, class_level string, topics array<string>, include boolean")
    p = spark.createDataFrame([(5, "a", "rechne  3 plus 4", "7", "t", 0)], "task_id int, title string, question_text string, class_level string, topic string, scan_ord int")
    rows = {r.draft_id: r for r in sim.add_duplicates(d, p).collect()}
    assert not rows[1].include and rows[1].duplicate.id == 5 and rows[2].include


def test_segments(spark):
    text = "Kopf\n1. Drücke aus\na) x\n[[PAGE:2]]\n2. Berechne\n4. Klassenarbeit\n25.02.2019"
    rows = segment.task_chunks(spark.createDataFrame([(1, text), (2, "nichts"), (3, None)], "d int, t string"), "d", "t").orderBy("segment").collect()
    assert [(r.doc, r.text, r.pages) for r in rows] == [(1, "1. Drücke aus\na) x", []), (1, "2. Berechne\n4. Klassenarbeit\n25.02.2019", [2])]


def test_drafts(spark):
    chunks = spark.createDataFrame([(1, 1, "Aufgabe 3 (4 P.) Boxplot\nZeichne den Graph. [[IMG:0]]", [1])], "doc int, segment int, text string, pages array<int>")
    r = segment.drafts(chunks, F.lit("Blatt Klasse 8")).first()
    assert (r.title, r.class_level, r.points_raw, r.points_source, r.competence, r.images) == ("Boxplot", "8", "4", "document", "Darstellungen", [0])


def test_first_match(spark):
    d = spark.createDataFrame([(1, "Terme ordnen"), (2, "xyz"), (3, "Terme"), (4, None)], "draft_id int, title string")
    e = spark.createDataFrame([(0, "Ordnen"), (1, "terme  ordnen!"), (2, "TERME ordnen")], "ord int, title string")
    assert {r.draft_id: r.ord for r in segment.first_match(d, e).collect()} == {1: 0, 2: None, 3: 1, 4: None}


def test_documents(ev):
    x = "<p>a&amp;lt;b</p><br/>c"
    assert ev(documents.simplify_html(F.lit(x))) == "a<b\n\nc"
    assert ev(documents.decode_entities(F.lit("&#x41;&#66;&nbsp;c"))) == "AB c"
    assert documents.repair_fractions("d) 4\n3 x = 7") == "d) \\frac{3}{4} x = 7"
    assert documents.repair_fractions("x = - 5 2\n1\ny") == "x = - 5 \\frac{1}{2}\ny"
    r = ev(documents.data_url(F.lit("data:image/png;base64,QUI=")))
    assert r.mime == "image/png" and bytes(r.bytes) == b"AB"
    assert ev(documents.data_url(F.lit("nope"))) is None
    assert ev(documents.clean_heading(F.lit("Aufgabe 3: (4 P.) Rechne  aus (2 BE)"))) == "Rechne aus"
    assert ev(documents.task_number(F.lit("⑦ Rechne"))) == "7"
    long = "Ein " + "sehr " * 30 + "langer Satz"
    assert ev(documents.title(F.lit(long), F.lit(long), F.lit("1"))).endswith("…")


def test_guesses(ev):
    assert ev(classify.guess_competence(F.lit("Begründe und zeichne"))) == "Argumentieren"
    assert ev(classify.guess_afb(F.lit("Vergleiche"))) == "AFB 2"
    assert ev(classify.guess_class(F.lit("Klasse: 9"))) == "9" and ev(classify.guess_class(F.lit("x"))) == "7"
    assert ev(classify.guess_topic(F.lit("Grundwert und Rabatt"), F.lit("7"))) == "Prozentrechnung"
    assert ev(classify.guess_topic(F.lit("nichts"), F.lit("7"))) == "Terme" and ev(classify.guess_topic(F.lit("x"), F.lit("11"))) == ""
    assert ev(classify.parse_competence(F.lit("Problem lösen"))) == "Problemlösen" and ev(classify.parse_competence(F.lit(""))) == "Mathematik"


def test_guard(ev):
    check = lambda a, b: ev(guard.check_correction(F.lit(a), F.lit(b)))
    assert check("1. Berechne 3 4", "1. Berechne \\frac{3}{4}").ok
    assert check("1. Berechne 3 4", "1. Berechne \\frac{3}{5}").reason.startswith("Zahleninhalt")
    assert check("", "x").reason == "leerer Text"
    assert check("1. x", "2. x").reason.startswith("Aufgabennummern")
    assert check("a) x", "b) x").reason.startswith("Teilaufgaben")
    assert check("eins zwei drei vier", "ganz andere worte hier").reason.startswith("zu große")


def test_page_outcomes(spark):
    pages = spark.createDataFrame([(1, 1, "1. Berechne 3 4"), (1, 2, "1. Berechne 3 4"), (1, 3, "x")], "doc int, page int, text string")
    fixes = spark.createDataFrame([(1, 1, "1. Berechne \\frac{3}{4}"), (1, 2, "1. Berechne 9")], "doc int, page int, text string")
    out = guard.apply_corrections(pages, fixes)
    assert tuple(guard.page_outcomes(out).first()) == (1, [1], [2], [3])
    assert {r.page: r.text for r in out.collect()}[1] == "1. Berechne \\frac{3}{4}"


def test_pairs_need_no_common_first_word(spark):
    from taskloom.operators import setjoin
    from taskloom.plans import catalogue

    rows = lambda *t: spark.createDataFrame(list(enumerate(t)), "id long, tokens array<string>")
    a, b = rows(["neu", "kopie", "text"], []), rows(["alt", "kopie", "text", "text"], [], ["fremd"])
    assert {(r.a, r.b): r.similarity for r in setjoin.similar(a, b, 0.1).collect()} == {(0, 0): 0.5, (1, 1): 1.0}
    # the query's pairs are all pairs that share a trigram, however little
    items = sim.features(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"), "text").select("item_id", "f.chars").collect()
    grams = {r.item_id: set(r.chars) for r in items}
    want = {(i, j): round(2 * len(x & y) / (len(x) + len(y)), 9) for i, x in grams.items() for j, y in grams.items() if i < j and x & y}
    assert want and {(r.item_id, r.other_id): r.dice for r in catalogue.QUERIES["trigram_dice"](spark, "/root/testdata/sf0.001").collect()} == want


def test_entity_decode_reads_pages(spark, tmp_path):
    from taskloom.plans import catalogue

    rows = [(1, "<b>&amp;lt; x &#39;y&#39;</b>"), (2, "&quot;z&quot;")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: r.decoded for r in catalogue.QUERIES["entity_decode"](spark, str(tmp_path)).collect()}
    assert found == {i: hashlib.md5(t.encode()).hexdigest() for i, t in [(1, "<b>< x 'y'</b>é€<"), (2, '"z"é€<')]}


def test_rules_after_a_broken_one_are_not_worked_out(ev, monkeypatch):
    monkeypatch.setattr(guard, "prose_words", lambda c: F.raise_error(F.lit("worked out")).cast("array<string>"))
    check = lambda a, b: ev(guard.check_correction(F.lit(a), F.lit(b))).reason
    assert check("Nenne 3 Zahlen", "Nenne 4 Zahlen").startswith("Zahleninhalt")
    assert check("1. Nenne Zahlen", "2. Nenne Zahlen").startswith("Aufgabennummern")
    assert check(" Nenne 3 Zahlen", "Nenne 3 Zahlen ") == ""


def test_alternatives_are_found_as_their_pattern_finds_them(spark):
    from taskloom.functions import classify, documents, points, textual

    own = [r"ab?c|d", r"x{2}y|a.c", r"a\|b", r"[|a]b|cd+", "(a|b)c|é", r"(a)\1", "(?i)AB|C", "", "a|", r"\d+a|b*c"]
    patterns = own + [points.HARD, points.HARD_WHOLE, points.DRAW] + [p for _, p in classify.COMPETENCE_RULES + classify.AFB_RULES] + [p for some, _ in documents.SPECIAL_TITLES for p in some]
    words = ["ab", "ac", "c", "d", "xxy", "xy", "a|b", "|b", "cdd", "bc", "é", "aa", "AB", "1a", "", "begrund", "begründe", "erklart", "real situation", "reale situation", "reales situation", "finde alle", "finde", "analysiere\nx aussage", "analysiere x aussage", "magischen  quadrat", "magisch", "boxplot"]
    rows = spark.createDataFrame([(f"{x}{y}",) for x in words for y in words], "t string")
    both = rows.select(*[F.struct(textual.mentions(F.col("t"), p).alias("a"), F.col("t").rlike(p).alias("b")).alias(f"p{i}") for i, p in enumerate(patterns)])
    assert all(c.a == c.b for r in both.collect() for c in r)


def test_squeeze_leaves_single_blanks(spark):
    import random
    import re

    from taskloom.functions import textual

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  \t\n  　﻿") for _ in range(rng.randrange(12))) for _ in range(2000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", textual.squeeze(F.col("t")).alias("s")).collect()
    assert all(r.s == re.sub(f"[{textual.WHITE}]+", " ", texts[r.i]).strip(" ") for r in got)


def test_words_of_texts_are_those_of_any_case():
    import re

    signs = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert sim._LETTERS.findall(signs) == re.findall("[a-zäöüß]+", signs, re.I) and sim._WORDS.findall(signs) == re.findall("[a-zäöüß0-9_]+", signs, re.I)
    assert not (sim._LETTERS.flags | sim._WORDS.flags) & re.I  # a flag folded each letter of a text before
    assert list(sim._meaning("Berechnungen und x1 die 7 terme " * 2)) == ["Berech", "x1", "terme"] * 2


def test_words_met_are_bounded():
    kept = sim._Kept(3)
    for i in range(200_010):
        assert kept[f"w{i}x"] == f"w{i}x"
    assert len(kept) <= 200_000 and kept["und"] == "" and kept["ab"] == ""
