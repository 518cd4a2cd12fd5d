"""LaTeX in task texts: pieces of text and formula, symbols, and a formula's tree."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textual import B, found, let, sub, text

# What counts as a formula, in order of preference, and the marks around it.
FORMULA = rf"(?s)\$\$.+?\$\$|\$[^$\n]+?\$|\\\(.+?\\\)|\\\[.+?\\\]|\\frac\{{[^}}]+\}}\{{[^}}]+\}}|{B}[0-9A-Za-z]+(?:\^[0-9A-Za-z]+)+{B}|\\[a-zA-Z]+(?:\[[^\]]*\])?(?:\{{[^}}]*\}})*"
MARKS = [("$$", "$$"), ("$", "$"), (r"\(", r"\)"), (r"\[", r"\]")]
DISPLAYED = ["$$", r"\["]
# Commands and their signs, in the order in which they are replaced.
SYMBOLS = [
    (r"\cdot", "·"), (r"\times", "×"), (r"\div", "÷"), (r"\pm", "±"), (r"\mp", "∓"), (r"\le", "≤"), (r"\leq", "≤"), (r"\ge", "≥"), (r"\geq", "≥"), (r"\neq", "≠"),
    (r"\approx", "≈"), (r"\infty", "∞"), (r"\pi", "π"), (r"\alpha", "α"), (r"\beta", "β"), (r"\gamma", "γ"), (r"\delta", "δ"), (r"\theta", "θ"), (r"\lambda", "λ"),
    (r"\mu", "μ"), (r"\sigma", "σ"), (r"\omega", "ω"), (r"\rightarrow", "→"), (r"\Rightarrow", "⇒"),
]
# Spacing and sizing commands, and what stands for them.
SPACING = [(r"\\[,;]", " "), (r"\\!", ""), (r"\\left|\\right", ""), (r"\\text\{([^}]*)\}", "$1")]

PIECE = "array<struct<kind:string,value:string,display:boolean>>"


def pieces(c: Column) -> Column:
    """array<struct<kind, value, display>>: a text's pieces in order, formulas without their marks."""
    c = text(c)

    def formula(m: Column) -> Column:
        inner = m
        for left, right in reversed(MARKS):
            inner = F.when(m.startswith(left) & m.endswith(right), F.substring(m, F.lit(len(left) + 1), F.length(m) - len(left) - len(right))).otherwise(inner)
        shown = m.startswith(DISPLAYED[0]) | m.startswith(DISPLAYED[1])
        return F.struct(F.lit("math").alias("kind"), inner.alias("value"), shown.alias("display"))

    def plain(t: Column) -> Column:
        return F.struct(F.lit("text").alias("kind"), t.alias("value"), F.lit(False).alias("display"))

    def woven(both: Column) -> Column:  # a text, a formula, a text, ...
        pairs = F.transform(both["texts"], lambda t, i: F.array(plain(t), let(F.get(both["formulas"], i), lambda m: F.when(m.isNotNull(), formula(m)))))
        some = F.filter(F.flatten(pairs), lambda p: p.isNotNull() & ((p["kind"] == "math") | (p["value"] != "")))
        return F.when(F.size(some) > 0, some).otherwise(F.array(plain(F.lit(""))))

    return let(F.struct(F.split(c, FORMULA, -1).alias("texts"), found(c, FORMULA).alias("formulas")), woven).cast(PIECE)


def symbols(c: Column) -> Column:
    """Commands as signs, in their fixed order; ``\\leq`` so becomes the sign of ``\\le`` and a q."""
    c = text(c)
    for command, sign in SYMBOLS:
        c = F.replace(c, F.lit(command), F.lit(sign))
    for pattern, to in SPACING:
        c = sub(c, pattern, to)
    return c


_LEXEME = re.compile(r"(?P<frac>\\frac) *|(?P<root>\\sqrt) *|(?P<script>[\^_])|\\(?P<name>[A-Za-z]+)|(?P<brace>[{}])|(?P<char>.)", re.S)
_BRACE = re.compile("[{}]")


def plain_symbols(t: str) -> str:
    """:func:`symbols` of one text."""
    for command, sign in SYMBOLS:
        t = t.replace(command, sign)
    for pattern, to in SPACING:
        t = re.sub(pattern, to.replace("$", "\\"), t)
    return t


def _partners(source: str) -> dict[int, int]:
    """Where each closed group ends: the place of its closing brace by that of its opening one."""
    found, opened = {}, []
    for m in _BRACE.finditer(source):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            found[opened.pop()] = m.start()
    return found


#: What a node's children are in it: a formula's own nodes, above and below a fraction's line, under a root, base and script.
WHOLE, ABOVE, BELOW, UNDER, BASE, SCRIPT = "", "above", "below", "under", "base", "script"
NODE = "array<struct<node:int,parent:int,part:string,kind:string,value:string>>"


def formula_nodes(source: str) -> list[tuple[int, int | None, str, str, str | None]]:
    """A formula's nodes in pre-order: (node, parent, part, kind, value), kind being run, frac, root, sup or sub.

    An argument is a group in braces or a single character; a group that is not closed ends with the text. Groups wait on
    a stack of their own, so nesting may be of any depth and each group is read once.
    """
    source = plain_symbols(source.strip())
    out: list[tuple] = []

    def add(parent: int | None, part: str, kind: str, value: str | None = None) -> int:
        out.append((len(out), parent, part, kind, value))
        return len(out) - 1

    # a frame: text, its groups, begin, place, end, parent, part, and the nodes that were there before its own
    frames = [[source, _partners(source), 0, 0, len(source), None, WHOLE, None]]
    stable = plain_symbols(source) == source

    def inner(t: str, groups: dict[int, int], begin: int, end: int, parent: int, part: str) -> list:
        if not stable:  # signs that the first pass has put together become signs themselves
            own = plain_symbols(t[begin:end].strip())
            return [own, _partners(own), 0, 0, len(own), parent, part, None]
        while begin < end and t[begin].isspace():
            begin += 1
        while end > begin and t[end - 1].isspace():
            end -= 1
        return [t, groups, begin, begin, end, parent, part, None]

    while frames:
        frame = frames[-1]
        t, groups, begin, at, end, parent, part, before = frame
        if before is None:
            before = frame[7] = len(out)
        run: list[str] = []

        def argument(at: int) -> tuple[int, int, int]:
            """Begin and end of an argument, and where the text goes on."""
            if at >= end or t[at] != "{":
                return at, min(at + 1, end), at + 1
            close = groups.get(at, end)
            return at + 1, min(close, end), min(close, end - 1) + 1

        waiting: list[list] = []
        while at < end and not waiting:
            m = _LEXEME.match(t, at, end)
            at = m.end()
            match m.lastgroup:
                case "frac":
                    if run:
                        add(parent, part, "run", "".join(run))
                        run = []
                    a, b, at = argument(at)
                    while at < end and t[at] == " ":
                        at += 1
                    c, d, at = argument(at)
                    node = add(parent, part, "frac")
                    waiting = [inner(t, groups, c, d, node, BELOW), inner(t, groups, a, b, node, ABOVE)]
                case "root":
                    if run:
                        add(parent, part, "run", "".join(run))
                        run = []
                    a, b, at = argument(at)
                    waiting = [inner(t, groups, a, b, add(parent, part, "root"), UNDER)]
                case "script":
                    base = run.pop() if run else " "
                    if run:
                        add(parent, part, "run", "".join(run))
                        run = []
                    a, b, at = argument(at)
                    node = add(parent, part, {"^": "sup", "_": "sub"}[m[0]])
                    add(node, BASE, "run", base)
                    waiting = [inner(t, groups, a, b, node, SCRIPT)]
                case "name":
                    if run:
                        add(parent, part, "run", "".join(run))
                        run = []
                    add(parent, part, "run", m["name"])
                case "char":
                    run.append(m[0])
        if run:
            add(parent, part, "run", "".join(run))
        if waiting:
            frame[3] = at
            frames.extend(waiting)
            continue
        frames.pop()
        if len(out) == before:
            add(parent, part, "run", t[begin:end])
    return out


#: Nesting up to which a formula is shown as JSON, whose readers are recursive.
MOST_NESTED = 200


def formula_tree(source: str) -> list[dict] | None:
    """A formula as nested nodes: run, frac (above, below), root, sup and sub (base, script); null if nested deeper than ``MOST_NESTED``."""
    whole: list[dict] = []
    parts: dict[tuple[int | None, str], list] = {(None, WHOLE): whole}
    depth: dict[int | None, int] = {None: 0}
    for node, parent, part, kind, value in formula_nodes(source):
        depth[node] = depth[parent] + 1
        if depth[node] > MOST_NESTED:
            return None
        if part == BASE:
            parts[parent, BASE][0] = value
            continue
        own: dict = {"run": value}
        if kind == "frac":
            own = {kind: [parts.setdefault((node, ABOVE), []), parts.setdefault((node, BELOW), [])]}
        elif kind == "root":
            own = {kind: parts.setdefault((node, UNDER), [])}
        elif kind != "run":
            own = {kind: [None, parts.setdefault((node, SCRIPT), [])]}
            parts[node, BASE] = own[kind]
        parts[parent, part].append(own)
    return whole


@F.pandas_udf(T.StringType())
def tree(c: pd.Series) -> pd.Series:
    """:func:`formula_tree` as JSON."""

    def shown(t: str | None) -> str | None:
        made = None if t is None else formula_tree(t)
        return None if made is None else json.dumps(made, ensure_ascii=False, separators=(",", ":"))

    return c.map(shown)


_NODE = T.ArrayType(T.StructType([T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("part", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


@F.pandas_udf(_NODE)
def nodes(c: pd.Series) -> pd.Series:
    """:func:`formula_nodes`; a stack of groups is no column function."""
    names = ("node", "parent", "part", "kind", "value")
    return c.map(lambda t: None if t is None else [dict(zip(names, n)) for n in formula_nodes(t)])


# Formulas within a line by their marks, those that stand without, and the marks that go.
MARKED = r"\$\$[^$]+?\$\$|\$[^$]+?\$|\\\([^)]*?\\\)|\\\[[^\]]*?\\\]"
UNMARKED = rf"\\frac\{{[^}}]+\}}\{{[^}}]+\}}|\\sqrt\{{[^}}]+\}}|\\[A-Za-z]+|{B}(?:\d+)?[A-Za-z]\^\{{?[-+A-Za-z0-9]+\}}?"
UNWRAPPED = [r"^\$\$|\$\$\z", r"^\$|\$\z", r"^\\\(|\\\)\z", r"^\\\[|\\\]\z"]


def inline(c: Column) -> Column:
    """array<struct<kind, value>>: a line's pieces in order, formulas without their marks.

    Formulas with marks count; only in a line without any, those that are told by their form do.
    """

    def cut(pattern: str):
        def woven(both: Column) -> Column:
            def formula(m: Column) -> Column:
                for mark in UNWRAPPED:
                    m = sub(m, mark)
                return F.struct(F.lit("math").alias("kind"), m.alias("value"))

            pairs = F.transform(both["texts"], lambda t, i: F.array(F.struct(F.lit("text").alias("kind"), t.alias("value")), F.when(F.get(both["formulas"], i).isNotNull(), formula(F.get(both["formulas"], i)))))
            return F.filter(F.flatten(pairs), lambda p: p.isNotNull() & ((p["kind"] == "math") | (p["value"] != "")))

        return let(F.struct(F.split(c, pattern, -1).alias("texts"), found(c, pattern).alias("formulas")), woven)

    c = text(c)
    plain = F.array(F.struct(F.lit("text").alias("kind"), c.alias("value")))
    return F.when(c.rlike(MARKED), cut(MARKED)).when(c.rlike(UNMARKED), cut(UNMARKED)).otherwise(plain)
