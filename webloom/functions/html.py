"""HTML expressions: links, bundles, metadata and assets by native regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shells of pages that a script fills in.
SHELL = r"(?is)^\s*(<noscript>.*?</noscript>)?\s*(<div\s+id=[\"'](root|app|__next|__nuxt)[\"'][^>]*>\s*</div>)?\s*$"


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, quoted or bare; null without it."""
    found = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    value = F.regexp_replace(F.regexp_replace(found, rf"(?is)^{name}\s*=\s*", ""), r"""^["']|["']$""", "")
    return F.when(found != "", value)


def tags(html: Column, name: str) -> Column:
    """All opening tags of an element, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def hrefs(html: Column) -> Column:
    """P-17: the targets of a page's anchors, in order; anchors without a target are left out."""
    found = F.transform(tags(html, "a"), lambda t: F.trim(attribute(t, "href")))
    return F.filter(found, lambda h: h.isNotNull() & (h != "") & ~F.lower(h).rlike(r"^(javascript:|mailto:|tel:|data:|#)"))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def language(html: Column) -> Column:
    return attribute(F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0), "lang")


def metas(html: Column) -> Column:
    """P-19: a page's meta tags but for charset, viewport and compatibility."""
    return F.filter(tags(html, "meta"), lambda t: ~F.lower(t).rlike(r"charset=|viewport|x-ua-compatible"))


def body_without_scripts(html: Column) -> Column:
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    return F.regexp_replace(body, r"(?is)<script\b[^>]*>.*?</script>", "")


def server_rendered(html: Column) -> Column:
    """F-14: whether the page's body holds text of its own, rather than a shell for scripts."""
    body = F.trim(body_without_scripts(html))
    return ~body.rlike(SHELL) & (F.length(body) > 50)


def bundle_urls(html: Column) -> Column:
    """S-01: array of (kind, url): scripts, preloaded modules not seen yet, style sheets."""
    named = lambda url, kind: F.struct(F.lit(kind).alias("kind"), url.alias("url"))
    scripts = F.filter(F.transform(tags(html, "script"), lambda t: attribute(t, "src")), lambda u: u.isNotNull() & (u.endswith(".js") | u.contains(".js?")))
    links = tags(html, "link")
    rel = lambda t, r: F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))) == r
    modules = F.array_distinct(F.filter(F.transform(F.filter(links, lambda t: rel(t, "modulepreload")), lambda t: attribute(t, "href")), lambda u: u.isNotNull()))
    modules = F.array_except(modules, scripts)
    sheets = F.filter(F.transform(F.filter(links, lambda t: rel(t, "stylesheet")), lambda t: attribute(t, "href")), lambda u: u.isNotNull() & (u.endswith(".css") | u.contains(".css?")))
    return F.concat(F.transform(scripts, lambda u: named(u, "script")), F.transform(modules, lambda u: named(u, "script")), F.transform(sheets, lambda u: named(u, "stylesheet")))


def css_urls(css: Column) -> Column:
    """P-16: targets of url() and @import in a style sheet, in order, without data, blob and fragments."""
    found = F.concat(
        F.regexp_extract_all(css, F.lit(r"""(?i)url\(\s*(['"]?)([^'")]+)\1\s*\)"""), F.lit(2)),
        F.regexp_extract_all(css, F.lit(r"""(?i)@import\s+(['"])([^'"]+)\1"""), F.lit(2)),
    )
    return F.array_distinct(F.filter(F.transform(found, F.trim), lambda u: (u != "") & ~F.lower(u).rlike(r"^(data:|blob:|#)")))


def image_set_urls(value: Column) -> Column:
    """P-14: targets in an image-set(): of url() first, then bare strings with a density."""
    inner = F.regexp_extract_all(value, F.lit(r"""(?i)url\(\s*['"]?([^'")\s]+)['"]?\s*\)"""), F.lit(1))
    bare = F.regexp_extract_all(value, F.lit(r"""(?:^|[,(]\s*)["']([^"']+\.[a-zA-Z0-9]+)["']\s+[\d.]+x"""), F.lit(1))
    return F.array_union(inner, bare)


def hashed_class_names(css: Column) -> Column:
    """P-38: class names that carry a module hash, with their base name: array of (base, hashed)."""
    pattern = F.lit(r"\.(_?([a-zA-Z][a-zA-Z0-9-]*)_[a-zA-Z0-9]{4,}(?:_\d+)?)(?![\w-])")
    pairs = F.arrays_zip(F.regexp_extract_all(css, pattern, F.lit(2)).alias("base"), F.regexp_extract_all(css, pattern, F.lit(1)).alias("hashed"))
    return F.array_distinct(pairs)
