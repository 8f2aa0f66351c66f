"""State-machine scanners over text, as Arrow-batched functions.

Each scanner is one regular expression that splits a text into the few kinds of token that
matter to it; the decisions are then made on tokens, never character by character.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

_TERMINATORS = "\n\r\u2028\u2029"
_URL = re.compile(r"[@#]\s*sourceMappingURL=(\S*?)\s*$", re.M)
_JS_COMMENTS = re.compile(rf"//(?P<line>[^{_TERMINATORS}]*)|/\*(?P<block>.*?)(?:\*/|\Z)|(?P<blank>\s+)|(?P<code>[^\s/]+|/)", re.S)
_CSS_COMMENTS = re.compile(r"/\*(?P<block>.*?)(?:\*/|\Z)|(?P<blank>\s+)|(?P<code>[^\s/]+|/)", re.S)
_JS_TOKENS = re.compile(
    r"""(?P<comment>//[^\n\r]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<template>`(?:[^`\\]|\\.)*`)|(?P<word>[A-Za-z_$][\w$]*)|(?P<other>\S)""",
    re.S,
)
_KEEP = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|//[^\n]*|/\*.*?(?:\*/|\Z)""", re.S)
_SRCSET = re.compile(r"\s*(?:(?P<data>data:.*?(?:\s+\d+(?:\.\d+)?[wx]\s*(?:,|\Z)|\Z))|(?P<url>[^\s,]+)\s*(?:[\d.]+[wx]?)?[\s,]*|,)", re.S | re.I)


def map_url_in_comments(text: str, kind: str = "js") -> str | None:
    """P-02: the source map that trailing comments name: the last one that no code follows."""
    found = None
    for m in (_CSS_COMMENTS if kind == "css" else _JS_COMMENTS).finditer(text):
        if m.lastgroup == "code":
            found = None
        elif m.lastgroup != "blank" and (url := _URL.search(m[m.lastgroup])) and url[1]:
            found = url[1]
    return found


def strip_comments(text: str) -> str:
    """C-28: the text without comments; strings and templates are left as they are."""
    return _KEEP.sub(lambda m: m[1] or "", text)


def srcset_urls(text: str) -> list[str]:
    """P-13: the URLs of a srcset, in order; data URLs, commas and all, are passed over."""
    return [m["url"] for m in _SRCSET.finditer(text) if m["url"]]


def _tokens(code: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m[0]) for m in _JS_TOKENS.finditer(code) if m.lastgroup != "comment"]


def import_sources(code: str) -> list[str]:
    """P-24: sources of imports, re-exports, dynamic imports and require calls, in order, repeats and all."""
    out, tokens = [], _tokens(code)
    kinds = [k for k, _ in tokens] + [""] * 3
    words = [w for _, w in tokens] + [""] * 3
    declares = False  # whether what is being read began with import or export
    for i, (kind, word) in enumerate(tokens):
        if word in ("import", "export"):
            declares = True
        elif word in (";", "=", "("):
            declares = False
        if kind != "word" or (i and words[i - 1] == "."):
            continue
        called = words[i + 1] == "(" and kinds[i + 2] == "string" and words[i + 3] == ")"
        if word in ("import", "require") and called:
            out.append(words[i + 2][1:-1])
        elif word == "import" and kinds[i + 1] == "string":
            out.append(words[i + 1][1:-1])
        elif word == "from" and kinds[i + 1] == "string" and declares:
            out.append(words[i + 1][1:-1])
    return out


def exported_names(code: str) -> list[str]:
    """P-26: names that a module exports itself, ``default`` among them, each once in order of first mention;
    re-exports from other modules are passed over."""
    tokens = _tokens(code)
    words = [w for _, w in tokens] + [""] * 4
    out: list[str] = []
    closing, ends = None, [None] * len(words)  # the next closing brace from each place on
    for i in range(len(words) - 1, -1, -1):
        closing = i if words[i] == "}" else closing
        ends[i] = closing
    for i, word in enumerate(words[: len(tokens)]):
        if word != "export" or (i and words[i - 1] == "."):
            continue
        after = words[i + 1]
        if after == "default":
            out.append("default")
        elif after == "{" and (end := ends[i]) is not None:
            if words[end + 1] != "from":
                for part in " ".join(words[i + 2 : end]).split(","):
                    if part.split():
                        out.append(part.split()[-1])
        elif after in ("const", "let", "var", "function", "class", "interface", "type", "enum", "async", "abstract"):
            skip = i + 2
            while words[skip] in ("function", "class", "*", "enum"):
                skip += 1
            out.append(words[skip])
    return list(dict.fromkeys(out))


def rewrite_css(css: str, places: dict[str, str]) -> str:
    """P-22: url() and @import targets by the table of ``places``; quotes stay, unknown targets too."""

    def swap(m: re.Match) -> str:
        return m["head"] + places.get(m["target"].strip(), m["target"]) + m["tail"]

    return re.sub(r"""(?P<head>url\(\s*(?P<q>['"]?))(?P<target>[^'")]+)(?P<tail>(?P=q)\s*\))|(?!)""", swap, re.sub(r"""(?P<head>@import\s+(?P<q>['"]))(?P<target>[^'"]+)(?P<tail>(?P=q))""", swap, css))


def _column(function, shape: str):
    """``function`` of one text as a column function; null gives null."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else function(t) for t in texts], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, shape)


def comments_map_url(column, kind: str = "js"):
    return _column(lambda t: map_url_in_comments(t, kind), "string")(column)


def without_comments(column):
    return _column(strip_comments, "string")(column)


def srcset(column):
    return _column(srcset_urls, "array<string>")(column)


def imports(column):
    return _column(import_sources, "array<string>")(column)


def exports(column):
    return _column(exported_names, "array<string>")(column)


def css_rewritten(column, places: dict[str, str]):
    return _column(lambda t: rewrite_css(t, places), "string")(column)
