"""Path expressions: native columns only, so they stay inside code generation and push down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EMPTY = "array<string>"


def _fold(parts: Column, keep_unresolved: bool) -> Column:
    """Resolve dot segments of ``parts``; a ``..`` with nothing to leave is kept or dropped."""

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        can_pop = (F.size(done) > 0) & (last != "..") if keep_unresolved else F.size(done) > 0
        pushed = F.concat(done, F.array(part))
        up = F.when(can_pop, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(pushed if keep_unresolved else done)
        return F.when(part == "..", up).when(part.isin(".", ""), done).otherwise(pushed)

    return F.aggregate(parts, F.array().cast(_EMPTY), step)


def source_path(path: Column, root: Column | None = None) -> Column:
    """C-01: a source map's path without its bundler scheme, under ``root``, dot segments resolved."""
    p = F.regexp_replace(path, r"^webpack://[^/]*/", "")
    p = F.when(p.startswith("\0"), F.substr(p, F.lit(2))).otherwise(p)
    if root is not None:
        joined = F.concat(root, F.when(root.endswith("/"), "").otherwise("/"), p)
        p = F.when((root != "") & ~p.startswith("/") & ~p.startswith("."), joined).otherwise(p)
    return F.array_join(_fold(F.split(F.regexp_replace(p, r"^\./", ""), "/"), True), "/")


def clean_filename(path: Column) -> Column:
    """C-02: the last segment in front of any query."""
    return F.element_at(F.split(F.split_part(path, F.lit("?"), F.lit(1)), "/"), -1)


def safe_path(path: Column) -> Column:
    """C-03: a path that stays below its folder, or null if nothing is left of it."""
    p = F.regexp_replace(F.replace(path, F.lit("\0"), F.lit("")), r"^[./\\]+", "")
    parts = F.transform(_fold(F.split(p, r"[/\\]"), False), lambda s: F.regexp_replace(s, r'[<>:"|?*]', "_"))
    return F.nullif(F.array_join(parts, "/"), F.lit(""))


def bundle_rooted_path(path: Column) -> Column:
    """C-04: dot segments resolved below the first segment, which always stays."""
    parts = F.split(path, "/")
    rest = _fold(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), False)
    return F.concat_ws("/", F.concat(F.slice(parts, 1, 1), rest))


def relative_path(base: Column, relative: Column) -> Column:
    """C-05: ``relative`` as seen from the file ``base``."""
    folder = F.regexp_replace(base, r"[^/]*$", "")
    joined = F.array_join(_fold(F.split(F.concat(folder, relative), "/"), True), "/")
    return F.when(F.concat(folder, relative).startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def posix_path(path: Column) -> Column:
    """C-06: backslashes as slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def bundle_name(url_path: Column) -> Column:
    """C-07: parent folder and file name of a bundle, without script, style and map endings."""
    parts = F.filter(F.split(url_path, "/"), lambda s: s != "")
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("bundle"))
    for ending in (r"\.js\.map$", r"\.css\.map$", r"\.js$", r"\.css$"):
        name = F.regexp_replace(name, ending, "")
    return F.when(F.size(parts) > 1, F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), name)).otherwise(name)


def package_of_specifier(spec: Column) -> Column:
    """C-08: the package of an import: two segments if scoped, else one."""
    parts = F.split(spec, "/")
    return F.when(spec.startswith("@") & (F.size(parts) > 1), F.concat_ws("/", parts[0], F.try_element_at(parts, F.lit(2)))).otherwise(parts[0])


def package_of_path(path: Column) -> Column:
    """C-09: the package of the first folder below node_modules, scoped names first; null without one."""
    scoped = F.regexp_extract(path, r"node_modules/(@[^/]+/[^/]+)", 1)
    plain = F.regexp_extract(path, r"node_modules/([^@/][^/]*)", 1)
    return F.coalesce(F.nullif(scoped, F.lit("")), F.nullif(plain, F.lit("")))


def package_of_filename(name: Column) -> Column:
    """C-10: the package that a bundle's file name suggests, or null."""
    base = F.regexp_replace(name, r"\.js(\?.*)?$", "")
    base = F.regexp_replace(base, r"^(chunk[-_]?|vendor[-_~]?|lib[-_]?)", "")
    base = F.regexp_replace(base, r"[-_.][a-zA-Z0-9]{6,12}$", "")
    dashes = F.split(base, "-")
    scoped = F.concat_ws("/", dashes[0], F.array_join(F.slice(dashes, 2, F.greatest(F.size(dashes) - 1, F.lit(1))), "-"))
    listed = F.filter(F.split(base, "~"), lambda s: (s != "") & ~s.startswith("chunk"))
    return (
        F.when(base.startswith("@") & (F.size(dashes) >= 2), scoped)
        .when(base.contains("~") & (F.size(listed) > 0), F.try_element_at(listed, F.lit(1)))
        .when(base.rlike(r"^[@a-zA-Z][\w\-./]*$"), F.lower(base))
    )


def css_base_name(name: Column) -> Column:
    """C-33: a style sheet's name without ending, module mark, hash and min mark, taken off in this order."""
    for pattern in (r"(?i)\.(css|scss|sass|less)$", r"\.module$", r"-[A-Za-z0-9_-]{6,}$", r"\.[a-f0-9]{8,}$", r"\.min$"):
        name = F.regexp_replace(name, pattern, "")
    return name


def extension(path: Column) -> Column:
    """The last segment's ending with its dot, in lower case; empty for none and for dot files."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))
