"""Import declarations and member accesses of code, read from tokens in Arrow batches.

A declaration is the run of tokens from ``import`` to its source; the run is cut at commas
and braces, so no tree of the whole file is built.
"""

from __future__ import annotations

import re

from webloom.functions.scanners import _column, _tokens

DECLARATION = "array<struct<source:string,kind:string,imported:string,local:string,type_only:boolean>>"
# Members that every object has and no class of a style sheet is.
OBJECT_MEMBERS = ("toString", "valueOf", "hasOwnProperty")
_EXTENSION = re.compile(r"\.(tsx?|jsx?)$")


def _specifiers(words: list[str], source: str, whole_type: bool) -> list[dict]:
    """What a declaration's words between ``import`` and ``from`` bring in, in order."""
    out: list[dict] = []
    add = lambda kind, imported, local, only: out.append({"source": source, "kind": kind, "imported": imported, "local": local, "type_only": only})
    inside, part = False, []

    def flush() -> None:
        names = [w for w in part if w]
        part.clear()
        if not names:
            return
        if not inside:
            if names[0] == "*":
                add("namespace", "*", names[-1], whole_type)
            else:
                add("default", "default", names[-1], whole_type)
            return
        only = names[0] == "type" and len(names) > 1 and names[1] != "as"
        names = names[1:] if only else names
        add("named", names[0].strip("'\""), names[-1].strip("'\""), whole_type or only)

    for word in words:
        if word == "{":
            flush()
            inside = True
        elif word == "}":
            flush()
            inside = False
        elif word == ",":
            flush()
        else:
            part.append(word)
    flush()
    return out


def import_declarations(code: str) -> list[dict]:
    """P-25: what a file's import declarations bring in: source, kind (default, namespace, named, or side_effect
    without names), the name there, the name here, and whether it is a type only. An empty list of names counts as
    a side effect, too."""
    tokens = _tokens(code)
    words, kinds = [w for _, w in tokens], [k for k, _ in tokens]
    out: list[dict] = []
    i = 0
    while i < len(words):
        begins = words[i] == "import" and kinds[i] == "word" and not (i and words[i - 1] == ".")
        if not begins or i + 1 >= len(words) or words[i + 1] in ("(", "."):
            i += 1
            continue
        if kinds[i + 1] == "string":
            out.append({"source": words[i + 1][1:-1], "kind": "side_effect", "imported": None, "local": None, "type_only": False})
            i += 2
            continue
        end = i + 1
        while end < len(words) and not (words[end] == "from" and end + 1 < len(words) and kinds[end + 1] == "string") and words[end] not in (";", "="):
            end += 1
        if end >= len(words) or words[end] != "from":
            i += 1
            continue
        held = words[i + 1 : end]
        # ``import type from 'x'`` brings in a default named type.
        whole_type = len(held) > 1 and held[0] == "type" and held[1] != ","
        found = _specifiers(held[1:] if whole_type else held, words[end + 1][1:-1], whole_type)
        out += found or [{"source": words[end + 1][1:-1], "kind": "side_effect", "imported": None, "local": None, "type_only": whole_type}]
        i = end + 2
    return out


def names_from(code: str, source: str) -> list[str]:
    """P-28: the names that a file imports from ``source``, told with or without a code extension, or as the end
    of a longer path; default and * stand for themselves."""
    bare = _EXTENSION.sub("", source)
    meant = lambda s: s in (source, bare) or _EXTENSION.sub("", s) == bare or s.endswith(("/" + source, "/" + bare))
    return [d["imported"] for d in import_declarations(code) if d["imported"] and meant(d["source"])]


def member_accesses(code: str, name: str) -> list[str]:
    """P-29: the property paths that are read off ``name``, in order: dotted names, and quoted ones in brackets."""
    tokens = _tokens(code)
    words, kinds = [w for _, w in tokens] + [""] * 3, [k for k, _ in tokens] + [""] * 3
    out = []
    for i in range(len(tokens)):
        if words[i] != name or kinds[i] != "word" or (i and words[i - 1] == "."):
            continue
        path, at = [], i + 1
        while True:
            if words[at] == "?" and words[at + 1] == ".":
                at += 1
            if words[at] == "." and kinds[at + 1] == "word":
                path.append(words[at + 1])
                at += 2
            elif words[at] == "[" and kinds[at + 1] == "string" and words[at + 2] == "]":
                path.append(words[at + 1][1:-1])
                at += 3
            else:
                break
        if path:
            out.append(".".join(path))
    return out


def style_usage(code: str) -> list[dict]:
    """P-35: the classes that a file takes from each style module it imports as a whole: (source, class), each once."""
    out = {}
    for d in import_declarations(code):
        if d["kind"] in ("default", "namespace") and re.search(r"\.module\.(css|scss|sass|less)$", d["source"]):
            for path in member_accesses(code, d["local"]):
                first = path.split(".")[0]
                if first not in OBJECT_MEMBERS:
                    out[(d["source"], first)] = None
    return [{"source": s, "class": c} for s, c in out]


def declared_imports(column):
    return _column(import_declarations, DECLARATION)(column)


def imported_names(column, source: str):
    return _column(lambda t: names_from(t, source), "array<string>")(column)


def accessed_members(column, name: str):
    return _column(lambda t: member_accesses(t, name), "array<string>")(column)


def used_classes(column):
    return _column(style_usage, "array<struct<source:string,class:string>>")(column)
