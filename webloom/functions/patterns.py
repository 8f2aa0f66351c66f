"""URL patterns: which path segments are parameters, what they are called, and how specific a pattern is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a parameter segment looks like.
DYNAMIC = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^\d+$",
    r"^[0-9a-fA-F]{24}$",
    r"^[a-zA-Z0-9]{6,12}$",
    r"^[A-Za-z0-9_-]{20,}$",
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{10,13}$",
)
# Resources that give a parameter its name, in the singular.
RESOURCES = (
    "user account profile member post article comment page document doc product order item cart category invoice payment "
    "transaction team company group project workspace repo branch commit pull issue release server node cluster container "
    "pod service deployment env image file asset video photo attachment upload message notification conversation chat "
    "thread channel email event calendar appointment meeting schedule task job workflow run build pipeline role permission "
    "token session key tag label report dashboard metric alert log ticket case incident subscription plan feature webhook "
    "integration connection database table collection record entry endpoint route version api location address region "
    "country city state zone campsite campground park trail permit reservation booking facility amenity tour pass entrance "
    "course lesson module quiz question answer review rating feedback form submission response field template layout theme "
    "style app application plugin extension addon search query filter result setting config preference option step stage "
    "phase action activity object entity instance snapshot backup export import org"
).split()
# Long names of resources that have a short one.
ALIASES = {"organization": "org", "repository": "repo", "environment": "env"}


def _plural(word: str) -> str:
    if word.endswith("y") and word[-2] not in "aeiou":
        return word[:-1] + "ies"
    if word.endswith("z"):
        return word + "zes"
    return word + ("es" if word.endswith(("s", "x", "ch", "sh")) else "s")


def parameter_names() -> dict[str, str]:
    """C-21: parameter name by lower-case resource segment, singular and plural."""
    short = {w: w for w in RESOURCES} | ALIASES
    return {form: f"{name}Id" for word, name in short.items() for form in (word, _plural(word))} | {"media": "mediaId"}


def _names() -> Column:
    return F.create_map(*[F.lit(x) for kv in parameter_names().items() for x in kv])


def is_dynamic(segment: Column) -> Column:
    """Whether a segment looks like a value; one expression with all patterns, so a segment is looked at once."""
    return segment.rlike("|".join(f"(?:{p})" for p in DYNAMIC))


def segments(path: Column) -> Column:
    return F.filter(F.split(F.split_part(path, F.lit("?"), F.lit(1)), "/"), lambda s: s != "")


def url_pattern(path: Column) -> Column:
    """C-19: struct (pattern, params, priority) of a request path.

    A dynamic segment is named after the segment before it, else after itself, else by the
    number of dynamic segments before it.
    """
    own = segments(path)
    names = _names()
    flags = F.transform(own, is_dynamic)

    def render(segment: Column, i: Column) -> Column:
        before = F.when(i > 0, F.try_element_at(names, F.lower(F.get(own, i - 1))))
        nth = F.size(F.filter(F.slice(flags, 1, i), lambda x: x))
        name = F.coalesce(before, F.try_element_at(names, F.lower(segment)), F.concat(F.lit("param"), nth.cast("string")))
        return F.when(F.get(flags, i), F.concat(F.lit(":"), name)).otherwise(segment)

    shown = F.transform(own, render)
    params = F.transform(F.filter(F.transform(shown, lambda s, i: F.when(F.get(flags, i), s)), lambda s: s.isNotNull()), lambda s: F.substr(s, F.lit(2)))
    return F.struct(F.concat(F.lit("/"), F.array_join(shown, "/")).alias("pattern"), params.alias("params"), priority_of(shown, F.size(params)).alias("priority"))


def priority_of(shown: Column, n_params: Column) -> Column:
    """C-20: ten a segment, five if static or one if dynamic, less two a parameter."""
    dynamic = F.size(F.filter(shown, lambda s: s.startswith(":")))
    return 10 * F.size(shown) + 5 * (F.size(shown) - dynamic) + dynamic - 2 * n_params


def sort_priority(pattern: Column) -> Column:
    """T-01: a pattern's own priority; its parameters are segments here and cost nothing more."""
    return priority_of(segments(pattern), F.lit(0))


def fixture_filename(method: Column, pattern: Column) -> Column:
    """C-23: a file name for a method and pattern."""
    p = F.replace(F.replace(F.regexp_replace(pattern, "^/", ""), F.lit("/"), F.lit("_")), F.lit(":"), F.lit(""))
    return F.concat(method, F.lit("_"), F.regexp_replace(p, r"[^a-zA-Z0-9_-]", "_"), F.lit(".json"))


def fixture_id(method: Column, pattern: Column, index: Column) -> Column:
    """C-23: a running number of four digits at least, the method and the pattern."""
    p = F.replace(F.replace(F.regexp_replace(pattern, "^/", ""), F.lit("/"), F.lit("-")), F.lit(":"), F.lit(""))
    number = F.when(F.length(index.cast("string")) < 4, F.lpad(index.cast("string"), 4, "0")).otherwise(index.cast("string"))
    return F.concat_ws("_", number, method, F.regexp_replace(p, r"[^a-zA-Z0-9-]", "-"))


def glob(pattern: str) -> str:
    """F-03, F-04: a glob as a regular expression; ``**`` crosses folders, ``*`` does not."""
    out = ""
    i = 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + ("\\" + pattern[i] if pattern[i] in ".+^$(){}|[]\\?" else pattern[i]), i + 1
    return out


def request_regex(pattern: Column) -> Column:
    """C-36: a pattern column as an anchored regular expression; ``:name`` matches one segment."""
    escaped = F.regexp_replace(pattern, r"([.+*?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(escaped, r":[A-Za-z0-9_]+", "([^/]+)"), F.lit("$"))
