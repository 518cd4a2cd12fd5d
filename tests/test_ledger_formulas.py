"""Ledgers of calls, and formulas as nodes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from taskloom.functions import latex
from taskloom.operators import ledger, sink


def counting(path):
    """A callable that leaves a mark for each call; requests with ``bad`` fail until the file ``open`` is there."""

    def call(request):
        import uuid

        with open(f"{path}/{uuid.uuid4().hex}.call", "w") as f:
            f.write(request)
        if "bad" in request and not os.path.exists(f"{path}/open"):
            raise RuntimeError("refused")
        return request.upper()

    return call


def calls(path):
    return sorted((path / f).read_text() for f in os.listdir(path) if f.endswith(".call"))


def test_requests_are_made_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "a", "b", None, "bad", "a"])], "id long, p string").repartition(3)
    path = f"{tmp_path}/ledger"
    (tmp_path / "calls").mkdir()
    call = counting(str(tmp_path / "calls"))
    out = ledger.called(rows, "p", call, path)
    want = {0: ("A", None), 1: ("A", None), 2: ("B", None), 3: (None, None), 4: (None, "refused"), 5: ("A", None)}
    for _ in range(2):
        assert {r.id: (r.answer, r.answer_error) for r in out.collect()} == want
    assert calls(tmp_path / "calls") == ["a", "b", "bad"]
    (tmp_path / "calls" / "open").write_text("")
    got = ledger.called(rows.unionByName(spark.createDataFrame([(9, "new")], "id long, p string")), "p", call, path)
    assert {r.id: (r.answer, r.answer_error) for r in got.collect()} == want | {4: ("BAD", None), 9: ("NEW", None)}
    assert calls(tmp_path / "calls") == ["a", "b", "bad", "bad", "new"]


def test_busy_services_and_loose_forms(spark, tmp_path):
    def ask(prompt, strict):
        mark = f"{tmp_path}/{prompt[:4]}"
        if prompt.startswith("busy") and not os.path.exists(mark):
            open(mark, "w").close()
            raise ledger.Busy(retry_after="0.01")
        if prompt.startswith("full"):
            raise ledger.Busy("still busy", reset="1ms")
        if strict and prompt.startswith("loose"):
            raise ledger.Unparsed("no")
        return json.dumps([prompt, strict])

    rows = spark.createDataFrame([("busy",), ("loose",), ("plain",)], "p string")
    got = {r.p: r.answer for r in ledger.answered(rows, "p", ask, f"{tmp_path}/l", again=" as JSON").collect()}
    assert got == {"busy": '["busy", true]', "loose": '["loose as JSON", false]', "plain": '["plain", true]'}
    full = ledger.answered(spark.createDataFrame([("full",)], "p string"), "p", ask, f"{tmp_path}/m", tries=2).first()
    assert (full.answer, full.answer_error) == (None, "still busy")


@pytest.mark.parametrize("after, reset, want", [("3", "", 3.0), ("", "1.5s", 1.5), ("", "80ms", 1.0), ("-1", "9s", 9.0), ("x", "", 8.0), ("", "0.2s", 1.0)])
def test_waits(ev, after, reset, want):
    from taskloom.functions import guard

    assert ledger.wait_seconds(after, reset) == ev(guard.retry_seconds(F.lit(after), F.lit(reset))) == want


def test_a_repeated_transaction_sends_what_failed(spark, tmp_path):
    d = spark.createDataFrame([(i, t, "q", "7", "T", c, True) for i, (t, c) in enumerate([("eins", "M"), ("bad", "M"), ("", "M"), ("drei", "?")])], "id long, title string, question_text string, class_level string, topic string, competence string, include boolean")
    known = spark.createDataFrame([("7", "T", "M")], "class_level string, topic string, competence string")
    (tmp_path / "calls").mkdir()
    call = counting(str(tmp_path / "calls"))
    send = lambda t: {r.title: (r.ok, r.error) for r in sink.send(d, known, call, f"{tmp_path}/l", t).collect()}
    first = {"eins": (True, None), "bad": (False, "refused"), "": (False, "title is empty"), "drei": (False, "partition is unknown")}
    assert send("t1") == first and len(calls(tmp_path / "calls")) == 2
    (tmp_path / "calls" / "open").write_text("")
    assert send("t1") == first | {"bad": (True, None)} and len(calls(tmp_path / "calls")) == 3
    assert send("t2") == first | {"bad": (True, None)} and len(calls(tmp_path / "calls")) == 5


def shown(t):
    return [(p, k, v) for _, p, _, k, v in latex.formula_nodes(t)]


def test_nodes_in_preorder():
    assert latex.formula_nodes("a+\\frac{x^2}{\\sqrt 3}b") == [
        (0, None, "", "run", "a+"), (1, None, "", "frac", None), (2, 1, "above", "sup", None), (3, 2, "base", "run", "x"), (4, 2, "script", "run", "2"),
        (5, 1, "below", "root", None), (6, 5, "under", "run", "3"), (7, None, "", "run", "b"),
    ]
    assert shown("") == [(None, "run", "")] and shown("{}") == [(None, "run", "{}")] and shown("\\frac{}{ }") == [(None, "frac", None), (0, "run", ""), (0, "run", "")]
    assert shown("^2") == [(None, "sup", None), (0, "run", " "), (0, "run", "2")]
    assert shown("\\frac{a}{b") == [(None, "frac", None), (0, "run", "a"), (0, "run", "b")] and shown("\\sqrt") == [(None, "root", None), (0, "run", "")]
    assert shown("\\sin x") == [(None, "run", "sin"), (None, "run", " x")]


def test_nesting_of_any_depth():
    import time

    for opening in ("\\sqrt{", "x^{", "\\frac{1}{"):
        begin = time.time()
        n = latex.formula_nodes(opening * 100_000 + "y" + "}" * 100_000)
        assert n[-1][3:] == ("run", "y") and len(n) > 100_000 and time.time() - begin < 20
        assert latex.formula_tree(opening * 100_000 + "y" + "}" * 100_000) is None
    assert latex.formula_tree("\\sqrt{" * 50 + "y" + "}" * 50)


@pytest.mark.parametrize("line, want", [
    ("", [("text", "")]),
    ("a $x$ b $$y$$", [("text", "a "), ("math", "x"), ("text", " b "), ("math", "y")]),
    ("\\(a\\) oder \\[b\\]", [("math", "a"), ("text", " oder "), ("math", "b")]),
    ("nimm 3x^2 und \\pi", [("text", "nimm "), ("math", "3x^2"), ("text", " und "), ("math", "\\pi")]),
    ("$ offen x^2", [("text", "$ offen "), ("math", "x^2")]),
])
def test_lines_in_pieces(ev, line, want):
    assert [tuple(p) for p in ev(latex.inline(F.col("t")), t=line)] == want
