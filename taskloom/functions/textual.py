"""Text primitives with ECMAScript semantics, as column expressions.

The model's text rules are stated for a language whose ``\\s`` and trim are Unicode, whose ``\\b`` is
ASCII and whose rounding goes up at .5; Java's differ, so those are spelled out here.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Inside of a character class: Unicode white space.
SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The same without line ends: with it a pattern for line beginnings tries each blank line once.
BLANKS = r"\t\x0B\f \u00A0\u1680\u2000-\u200A\u202F\u205F\u3000\uFEFF"
#: White space as characters.
WHITE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The range in front rules almost all other characters out at once.
S = rf"[\t\n\x0B\f\r \u00A0\u1680-\uFEFF&&[{SPACES}]]"
NOT_S = f"[^{SPACES}]"
#: ASCII word boundary.
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"


def text(c: Column | str) -> Column:
    """The column's text, '' for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def sub_where(c: Column, needed: str, pattern: str, to: str = "") -> Column:
    """:func:`sub`, which runs only where ``needed`` occurs: a text without which the pattern can't match."""
    return let(c, lambda x: F.when(x.contains(needed), sub(x, pattern, to)).otherwise(x))


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern; the whole one if it begins with flags or names a group's number."""
    if re.match(r"\(\?[a-zA-Z]", pattern) or re.search(r"\\[1-9kQ]", pattern):
        return [pattern]
    out, depth = [""], 0
    for part in re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", pattern, re.S):
        depth += (part == "(") - (part == ")")
        if part == "|" and not depth:
            out.append("")
        else:
            out[-1] += part
    return out


def mentions(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs in a text, which is bound by the caller.

    An alternative without special signs is looked for as a text, and another only where the plain text of its
    beginning occurs, since a pattern tries all its alternatives at each character.
    """

    def one(p: str) -> Column:
        plain = re.match(r"[^\\()\[\]{}?*+.|^$]*", p)[0]
        if plain == p:
            return c.contains(p)
        if p[len(plain)] in "?*{":
            plain = plain[:-1]
        return c.contains(plain) & c.rlike(p) if plain else c.rlike(p)

    return reduce(or_, map(one, _alternatives(pattern)))


def trim(c: Column) -> Column:
    """Without white space at both ends; linear in the text, as a pattern that ends in an anchor is not."""
    return F.btrim(c, F.lit(WHITE))


def trim_lines(c: Column) -> Column:
    """Without blanks and tabs at line ends. A run of them is tried from its beginning alone."""
    return sub(c, r"(?<![ \t])[ \t]++\n", "\n")


def squeeze(c: Column) -> Column:
    """White-space runs as one blank, trimmed. What is one blank is not replaced by another."""
    return F.trim(sub(c, rf"(?={S})(?: {S}|[^ ]){S}*+", " "))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a group, in order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first_of(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def or_else(c: Column, other: Column) -> Column:
    """``c`` unless it is null or empty."""
    return F.coalesce(F.when(c != "", c), other)


def number(c: Column) -> Column:
    """A number with comma or point; null if it is none."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def js_round(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def js_number(c: Column) -> Column:
    """Shortest text of a number: 2 for 2.0."""
    return sub(c.cast("string"), r"\.0$")


def circled(c: Column, after: str = "") -> Column:
    """Circled numbers as digits, each followed by ``after``."""
    if not after:  # one character each, but for the last
        digits = lambda x: F.replace(F.translate(x, CIRCLED[:9], "123456789"), F.lit(CIRCLED[9]), F.lit("10"))
        return let(c, lambda x: F.when(x.rlike(f"[{CIRCLED[0]}-{CIRCLED[9]}]"), digits(x)).otherwise(x))
    for i, ch in enumerate(CIRCLED, 1):
        c = F.replace(c, F.lit(ch), F.lit(f"{i}{after}"))
    return c


def lines(c: Column) -> Column:
    return F.split(F.replace(c, F.lit("\r"), F.lit("")), "\n", -1)


@F.pandas_udf(T.StringType())
def _nfkc(c: pd.Series) -> pd.Series:
    import unicodedata

    return c.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Unicode NFKC; Spark has no such function."""
    return _nfkc(c)


def chunks(c: Column, size: int = 1900) -> Column:
    """Pieces of ``size`` characters; none for an empty text."""
    n = F.length(c)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda i: F.substring(c, i + 1, F.lit(size)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays: 1 if both are empty, 0 if one is."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / F.when(any_ == 0, F.lit(1)).otherwise(any_))
