"""Tests and small extractions on paths, headers, code and mark-up, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import html as H

# Extensions of code that is analysed, and of media.
CODE_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
MEDIA_EXTENSIONS = (".mp4", ".webm", ".ogg", ".ogv", ".mp3", ".wav", ".flac", ".aac", ".m4a", ".m4v", ".mov", ".avi", ".mkv")
# Resource types that fetch data, and that are files.
API_TYPES = ("xhr", "fetch")
STATIC_TYPES = ("document", "stylesheet", "image", "media", "font", "script", "manifest")
# What before a number tells that it is no version: addresses, query parameters, paths of addresses, options.
NO_VERSION_BEFORE = (r"https?://[^\s]*$", r"[?&][\w-]*=?\s*$", r"\[[\w.]*version", r"\[options\.")
PATH_BEFORE, PARAM_AROUND = r"/[\w.-]+/[\w.-]+$", r"@param\s+\{"
CONTEXT = 100
# How application entries mount, and how many lines of their own make a file one.
MOUNT_CALL = r"createRoot\s*\(|ReactDOM\.render\s*\(|\.render\s*\(\s*<|document\.getElementById\s*\("
COMPONENT = r"<[A-Z][a-zA-Z0-9]*[\s/>]"
ENTRY_LINES = 10
# Fixed value: bytes of a style bundle worth injecting.
SIGNIFICANT_STYLE = 1000


def extension(path: Column) -> Column:
    """The lower-case extension of a path's last part, with its dot; a leading dot begins none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def is_code(path: Column) -> Column:
    """F-09: whether a file is analysed for imports."""
    return extension(path).isin(list(CODE_EXTENSIONS))


def is_media(url: Column) -> Column:
    """F-09: whether an absolute URL's path ends like a video's or a sound's; false for what is no URL."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1))
    out = F.lit(False)
    for e in MEDIA_EXTENSIONS:
        out = out | path.endswith(e)
    return out


def is_api_type(kind: Column) -> Column:
    """F-10."""
    return kind.isin(list(API_TYPES))


def is_static_type(kind: Column) -> Column:
    """F-10."""
    return kind.isin(list(STATIC_TYPES))


def passes_size(content_length: Column, most: int) -> Column:
    """F-11: whether a response may be read by its Content-Length; one that is absent, 0 or no number passes."""
    n = F.coalesce(F.regexp_extract(F.coalesce(content_length, F.lit("")), r"^\s*([+-]?[0-9]+)", 1).try_cast("decimal(38,0)"), F.lit(0))
    return (n <= 0) | (n <= most)


def version_context(text: Column, at: Column) -> Column:
    """F-18: whether a match at ``at`` (from 0) of ``text`` can be a version, by the hundred characters around it."""
    start = F.greatest(at - CONTEXT, F.lit(0))
    before, around = F.substr(text, start + 1, at - start), F.substr(text, start + 1, at + CONTEXT - start)
    wrong = around.rlike(PARAM_AROUND) | (before.rlike(PATH_BEFORE) & before.contains("://"))
    for pattern in NO_VERSION_BEFORE:
        wrong = wrong | before.rlike(pattern)
    return ~wrong


def extractable(contents: Column) -> Column:
    """F-22: whether a map holds any source's content."""
    return F.coalesce(F.exists(contents, lambda c: c.isNotNull()), F.lit(False))


def is_entry(text: Column) -> Column:
    """F-23: whether a file is an application's entry: component tags and a mount call, or many lines of its own."""
    own = F.filter(F.split(text, "\n"), lambda line: ~F.trim(line).rlike(r"^(import |export |//|/\*|\*|$)"))
    return text.rlike(COMPONENT) & (text.rlike(MOUNT_CALL) | (F.size(own) > ENTRY_LINES))


def imports_stub(text: Column, stub: Column) -> Column:
    """F-23: whether a style sheet imports or uses the stub file."""
    base = F.regexp_replace(F.regexp_extract(stub, r"([^/]*)$", 1), r"(?<=.)\.scss$", "")
    out = F.lit(False)
    for word in ("@import", "@use"):
        for quote in ("'", '"'):
            out = out | text.contains(F.concat(F.lit(f"{word} {quote}"), base, F.lit(quote)))
    return out


def needs_injection(unmatched: Column, unused: Column) -> Column:
    """F-23: whether unused style bundles (an array of contents) must be injected for unmatched stubs (an array)."""
    return (F.size(unmatched) > 0) & F.exists(unused, lambda c: F.length(c) >= SIGNIFICANT_STYLE)


def style_map_url(text: Column) -> Column:
    """P-36: the map that the first marked comment of a style sheet names, or null."""
    return F.nullif(F.regexp_extract(text, r"/\*#\s*sourceMappingURL=([^\s*]+)\s*\*/", 1), F.lit(""))


def style_imports(text: Column) -> Column:
    """P-34: relative targets of @import rules, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"""(?i)@import\s+(?:url\s*\(\s*)?['"]?([^'");\s]+)['"]?\s*\)?"""), F.lit(1))
    return relative(found)


def relative(paths: Column) -> Column:
    """P-34: the paths of an array that begin with ./ or ../, each once, in order."""
    return F.array_distinct(F.filter(paths, lambda p: p.startswith("./") | p.startswith("../")))


def all_imports(dynamic: Column, static: Column) -> Column:
    """U-01: dynamic imports, then static ones, each path once."""
    return F.array_union(dynamic, static)


def original_bundles(html: Column) -> Column:
    """P-18: array of (path, type) of a captured page's own scripts, then style sheets: root-relative, styles by rel=stylesheet."""
    local = lambda u: u.startswith("/") & ~u.startswith("//")
    scripts = F.regexp_extract_all(html, F.lit(r"""(?i)<script[^>]*\ssrc=["']([^"']+)["'][^>]*>"""), F.lit(1))
    links = F.filter(H.tags(html, "link"), lambda t: F.lower(t).contains('rel="stylesheet"') | F.lower(t).contains("rel='stylesheet'"))
    styles = F.transform(links, lambda t: F.regexp_extract(t, r"""(?i)\shref=["']([^"']+\.css(?:\?[^"']*)?)["']""", 1))
    of = lambda paths, kind: F.transform(F.filter(paths, local), lambda u: F.struct(u.alias("path"), F.lit(kind).alias("type")))
    return F.concat(of(scripts, "script"), of(styles, "stylesheet"))


def progress(phases: Column, counts: Column) -> Column:
    """G-07: where a run stands: its first phase that is not completed, with counts where they are known.

    ``phases``: status by phase name; ``counts``: numbers by name (extracted, bundles, captured, pages).
    """
    # The phases in their order, what is said of each, and the counts it may tell.
    said = (
        ("scrape", "Scraping bundles", None), ("extract", "Extracting sources", ("extracted", "bundles", "bundles extracted")),
        ("dependencies", "Analyzing dependencies", None), ("capture", "Capturing API calls", ("captured", "pages", "pages captured")),
        ("rebuild", "Rebuilding project", None),
    )
    out = F.lit("All phases completed")
    for name, plain, known in reversed(said):
        text = F.lit(plain)
        if known:
            done, all_of = (F.try_element_at(counts, F.lit(k)).cast("string") for k in known[:2])
            text = F.coalesce(F.concat(done, F.lit("/"), all_of, F.lit(f" {known[2]}")), text)
        out = F.when(~F.coalesce(F.try_element_at(phases, F.lit(name)) == "completed", F.lit(False)), text).otherwise(out)
    return out
