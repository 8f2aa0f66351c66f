"""Validation of source maps and index maps, in Arrow batches: what is wrong, and where.

A map's JSON nests maps in sections and has to be walked; each rule below names the field it
looks at and yields (code, field) pairs in the order of the checks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from webloom.functions.scanners import _column

VERSION = 3
_DIGIT = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}
_MISSING = object()
Found = Iterator[tuple[str, str]]


def _whole(x) -> bool:
    """Whether a JSON value is an integer that is not negative; 2.0 is one, true is not."""
    return not isinstance(x, bool) and isinstance(x, (int, float)) and x >= 0 and float(x).is_integer()


def _list_of(x, *kinds) -> bool:
    return isinstance(x, list) and all(isinstance(y, kinds) for y in x)


def _version(m: dict) -> Found:
    value = m.get("version", _MISSING)
    if value is _MISSING:
        yield "MISSING_VERSION", "version"
    elif isinstance(value, bool) or value != VERSION:
        yield "INVALID_VERSION", "version"


def _optional_text(m: dict, field: str, code: str) -> Found:
    if not isinstance(m.get(field, ""), str):
        yield code, field


def _ignored(m: dict) -> Found:
    held = m.get("ignoreList", [])
    sources = m.get("sources")
    fine = isinstance(held, list) and all(map(_whole, held)) and not (isinstance(sources, list) and any(i >= len(sources) for i in held))
    if not fine:
        yield "INVALID_IGNORE_LIST", "ignoreList"


def _numbers(segment: str) -> list[int] | None:
    """The VLQ numbers of a segment of known digits, or None if the last one is open."""
    out, value, shift = [], 0, 0
    for c in segment:
        digit = _DIGIT[c]
        value |= (digit & 31) << shift
        shift += 5
        if not digit & 32:
            out.append(-(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    return None if shift else out


def _mappings(text: str, n_sources: int, n_names: int) -> Found:
    """Faults of a mappings string. A digit out of the alphabet ends the walk; other faults do not."""
    at = [0, 0, 0, 0, 0]  # column, source, line, column in the source, name: sums of what has been read
    bounds = {1: (n_sources, "MAPPING_SOURCE_INDEX_OUT_OF_BOUNDS"), 4: (n_names, "MAPPING_NAME_INDEX_OUT_OF_BOUNDS")}
    for line in text.split(";"):
        at[0] = 0
        segments, begun = line.split(","), False
        for k, segment in enumerate(segments):
            if not segment:
                if begun or k + 1 < len(segments):
                    yield "INVALID_MAPPING_SEGMENT", "mappings"
                continue
            begun = True
            if any(c not in _DIGIT for c in segment):
                yield "INVALID_VLQ", "mappings"
                return
            numbers = _numbers(segment)
            if numbers is None:
                yield "INVALID_VLQ", "mappings"
                continue
            if len(numbers) not in (1, 4, 5):
                yield "INVALID_MAPPING_SEGMENT", "mappings"
                continue
            for x in numbers:
                if not -(1 << 31) <= x < 1 << 31:
                    yield "MAPPING_VALUE_EXCEEDS_32_BITS", "mappings"
            for i, x in enumerate(numbers):
                at[i] += x
                if at[i] < 0:
                    yield "MAPPING_NEGATIVE_VALUE", "mappings"
                elif i in bounds and at[i] >= bounds[i][0]:
                    yield bounds[i][1], "mappings"


def _regular(m: dict) -> Found:
    """P-06, P-07: faults of a map without sections."""
    yield from _version(m)
    sources, mappings, names = m.get("sources", _MISSING), m.get("mappings", _MISSING), m.get("names", [])
    if sources is _MISSING:
        yield "MISSING_SOURCES", "sources"
    elif not _list_of(sources, str, type(None)):
        yield "SOURCES_NOT_ARRAY", "sources"
    if not isinstance(mappings, str):
        yield "MISSING_MAPPINGS", "mappings"
    if not _list_of(m.get("sourcesContent", []), str, type(None)):
        yield "INVALID_SOURCES_CONTENT", "sourcesContent"
    yield from _optional_text(m, "sourceRoot", "INVALID_SOURCE_ROOT")
    if not _list_of(names, str):
        yield "INVALID_NAMES", "names"
    yield from _optional_text(m, "file", "INVALID_FILE")
    yield from _ignored(m)
    if isinstance(mappings, str) and isinstance(sources, list):
        yield from _mappings(mappings, len(sources), len(names) if isinstance(names, list) else 0)


def _offset(section: dict, place: str) -> Iterator[tuple[str, str] | tuple[int, int]]:
    """P-09: faults of a section's offset, or the one (line, column) it holds."""
    offset = section.get("offset", _MISSING)
    if not isinstance(offset, (dict, list)):
        yield "INVALID_INDEX_MAP_OFFSET", f"{place}.offset"
        return
    held = offset if isinstance(offset, dict) else {}
    wrong = [f for f in ("line", "column") if not _whole(held.get(f))]
    for f in wrong:
        yield "INVALID_INDEX_MAP_OFFSET", f"{place}.offset.{f}"
    if not wrong:
        yield int(held["line"]), int(held["column"])


def _section_map(section: dict, place: str) -> Found:
    """P-09: faults of a section's map."""
    held = section.get("map", _MISSING)
    if not isinstance(held, (dict, list)):
        yield "INVALID_INDEX_MAP_SECTION_MAP", f"{place}.map"
    elif isinstance(held, dict) and "sections" in held:
        yield "INDEX_MAP_NESTED", f"{place}.map"
    else:
        for code, field in _regular(held if isinstance(held, dict) else {}):
            yield code, f"{place}.map.{field}"


def _index(m: dict) -> Found:
    """P-08: faults of a map with sections."""
    yield from _version(m)
    yield from _optional_text(m, "file", "INVALID_FILE")
    if "mappings" in m:
        yield "INDEX_MAP_WITH_MAPPINGS", "mappings"
    if not isinstance(m["sections"], list):
        yield "INVALID_INDEX_MAP_SECTIONS", "sections"
        return
    before = None
    for i, section in enumerate(m["sections"]):
        place = f"sections[{i}]"
        if not isinstance(section, (dict, list)):
            yield "INVALID_INDEX_MAP_SECTIONS", place
            continue
        section = section if isinstance(section, dict) else {}
        for found in _offset(section, place):
            if isinstance(found[0], str):
                yield found
                continue
            if before is not None and found <= before:
                yield "INDEX_MAP_OVERLAP" if found == before else "INDEX_MAP_INVALID_ORDER", f"{place}.offset"
            before = found
        yield from _section_map(section, place)


def faults(text: str | None) -> list[tuple[str, str]]:
    """P-05 to P-09: (code, field) of all that is wrong with a map's JSON; text that is no JSON object is one fault."""
    try:
        m = json.loads(text or "")
    except ValueError:
        return [("INVALID_JSON", "")]
    if not isinstance(m, dict):
        return [("INVALID_JSON", "")]
    return list(_index(m) if "sections" in m else _regular(m))


def map_faults(column):
    """``faults`` of each text, as an array of (code, field)."""
    return _column(lambda t: [{"code": c, "field": f} for c, f in faults(t)], "array<struct<code:string,field:string>>")(column)
