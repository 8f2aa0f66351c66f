"""URL expressions for http(s) URLs: native columns; anything else passes through unchanged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.paths import _fold, extension

_PARTS = r"^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_EXACT = "(?i)" + _PARTS

# Content types by ending.
MIME = {
    ".html": "text/html", ".htm": "text/html", ".css": "text/css", ".js": "application/javascript", ".mjs": "application/javascript",
    ".json": "application/json", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif",
    ".svg": "image/svg+xml", ".webp": "image/webp", ".ico": "image/x-icon", ".woff": "font/woff", ".woff2": "font/woff2",
    ".ttf": "font/ttf", ".eot": "application/vnd.ms-fontobject", ".otf": "font/otf", ".mp4": "video/mp4", ".webm": "video/webm",
    ".mp3": "audio/mpeg", ".wav": "audio/wav", ".ogg": "audio/ogg",
}
# Resource types by ending.
RESOURCE_TYPES = {
    "image": (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".avif", ".bmp", ".tiff"),
    "font": (".woff", ".woff2", ".ttf", ".otf", ".eot"),
    "stylesheet": (".css",),
    "script": (".js", ".mjs"),
    "media": (".mp4", ".webm", ".mp3", ".wav", ".ogg", ".m4a"),
}
# Endings that a crawl passes over.
SKIPPED = (
    ".pdf .zip .tar .gz .rar .7z .exe .dmg .pkg .deb .rpm .msi .doc .docx .xls .xlsx .ppt .pptx .jpg .jpeg .png .gif "
    ".svg .webp .ico .bmp .mp3 .mp4 .wav .avi .mov .webm .woff .woff2 .ttf .eot .otf .css .js .json .xml"
).split()


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _EXACT, group)


def is_http(url: Column) -> Column:
    return url.rlike(_EXACT) & (_part(url, 2) != "")


def host(url: Column) -> Column:
    """Lower-case host and port, without the scheme's default port."""
    h = F.lower(F.regexp_replace(_part(url, 2), r"^[^@]*@", ""))
    return F.when(F.lower(_part(url, 1)) == "https", F.regexp_replace(h, r":443$", "")).otherwise(F.regexp_replace(h, r":80$", ""))


def origin(url: Column) -> Column:
    return F.when(is_http(url), F.concat(F.lower(_part(url, 1)), F.lit("://"), host(url)))


def percent_encoded(text: Column, kept: str) -> Column:
    """``text`` with every character outside the class ``kept`` as percent-encoded UTF-8."""
    one = lambda c: F.when(c.rlike(f"^[{kept}]?$"), c).when(c == " ", "%20").otherwise(F.url_encode(c))
    return F.when(text.rlike(f"^[{kept}]*$"), text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


# Characters that stay as they are in a path and in a query.
_PATH_KEPT = r"!$-;=@-_a-z|~"
_QUERY_KEPT = r"!$-;=?-~"


def url_path(url: Column) -> Column:
    """The path, percent-encoded, with dot segments resolved; ``/`` if empty."""
    raw = percent_encoded(_part(url, 3), _PATH_KEPT)
    parts = F.split(raw, "/")
    folded = F.array_join(_fold(parts, False), "/")
    tail = F.when((folded != "") & raw.rlike(r"(/|/\.|/\.\.)$"), "/").otherwise("")
    dotted = raw.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(raw == "", "/").when(dotted, F.concat(F.lit("/"), folded, tail)).otherwise(raw)


def query(url: Column) -> Column:
    """The query with its question mark, or empty."""
    return percent_encoded(F.coalesce(_part(url, 4), F.lit("")), _QUERY_KEPT)


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, resolved path; query and fragment kept."""
    whole = F.concat(origin(url), url_path(url), query(url), F.coalesce(_part(url, 5), F.lit("")))
    return F.when(is_http(url), whole).otherwise(url)


def base_parts(base: Column) -> dict[str, Column]:
    """What ``resolve`` needs of a base, to be computed once where many references share it."""
    path = url_path(base)
    return {"is_http": is_http(base), "scheme": F.lower(_part(base, 1)), "origin": origin(base), "path": path, "folder": F.regexp_replace(path, r"[^/]*$", ""), "query": query(base)}


def resolve(base: Column, ref: Column, parts: dict[str, Column] | None = None) -> Column:
    """C-11, C-12: ``ref`` as seen from the page ``base``; absolute and data URLs as they are,
    a bad base gives ``ref``. ``parts`` are the base's, if they are known."""
    of = parts or base_parts(base)
    ref_path = F.regexp_extract(ref, r"^[^?#]*", 0)
    rest = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    return (
        F.when(ref.rlike(r"^(?i:https?://|data:)") | ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
        .when(~of["is_http"], ref)
        .when(ref.startswith("//"), F.concat(of["scheme"], F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(of["origin"], ref))
        .when(ref == "", F.concat(of["origin"], of["path"], of["query"]))
        .when(ref_path == "", F.concat(of["origin"], of["path"], F.when(ref.startswith("#"), of["query"]).otherwise(""), ref))
        .otherwise(canonical(F.concat(of["origin"], of["folder"], ref_path, rest)))
    )


def resolve_link(base: Column, ref: Column) -> Column:
    """C-12, rewriter's variant: null for what is no fetchable reference."""
    r = F.trim(ref)
    return F.when((r != "") & ~F.lower(r).rlike(r"^(#|data:|javascript:|mailto:|tel:|blob:)"), resolve(base, r))


def crawl_url(url: Column) -> Column:
    """C-13: no fragment, and one trailing slash less unless the path is the root."""
    path = url_path(url)
    trimmed = F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.when(is_http(url), F.concat(origin(url), trimmed, query(url))).otherwise(url)


def request_path(path: Column) -> Column:
    """C-14: a leading slash, and one trailing slash less."""
    p = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when((F.length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)


def with_scheme(url: Column) -> Column:
    """C-15: https if no scheme is given."""
    return F.when(url.rlike(r"^(?i)https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def local_path(url: Column, base: Column) -> Column:
    """C-16: where a fetched URL is kept: its own path for the site's origin, else a hashed name."""
    path = F.when(url_path(url) == "/", F.lit("/index.html")).otherwise(url_path(url))
    own = F.when((extension(path) == "") & ~path.contains("."), F.concat(path, F.lit("/index.html"))).otherwise(path)
    raw = F.coalesce(F.nullif(F.element_at(F.split(url_path(url), "/"), -1), F.lit("")), F.lit("file"))
    named = F.concat(F.substring(F.md5(url), 1, 12), F.lit("_"), F.regexp_replace(raw, r"[^a-zA-Z0-9._-]", "_"))
    return F.when(origin(url) == origin(base), F.regexp_replace(own, "^/", "")).otherwise(F.concat(F.lit("_external/"), named))


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def content_type(header: Column, url: Column, avif: bool = False) -> Column:
    """C-17: the header's type, else the ending's, else a stream of bytes."""
    known = MIME | ({".avif": "image/avif"} if avif else {})
    said = F.nullif(F.trim(F.split_part(header, F.lit(";"), F.lit(1))), F.lit(""))
    return F.coalesce(said, _lookup(extension(url_path(url)), known), F.lit("application/octet-stream"))


def resource_type(url: Column) -> Column:
    """C-18: the kind of resource that the ending suggests."""
    return F.coalesce(_lookup(extension(url_path(url)), {e: k for k, es in RESOURCE_TYPES.items() for e in es}), F.lit("other"))


def skipped(url: Column) -> Column:
    """F-02: whether a crawl passes the URL over."""
    endings = "|".join(e.lstrip(".") for e in SKIPPED)
    return ~is_http(url) | F.lower(url_path(url)).rlike(rf"\.({endings})$")


def query_params(url: Column) -> Column:
    """C-24: the query's parameters, decoded; the last of equal names wins."""
    pairs = F.filter(F.split(F.regexp_replace(query(url), r"^\?", ""), "&"), lambda s: s != "")
    decode = lambda s: F.url_decode(s)
    entries = F.transform(pairs, lambda s: F.struct(decode(F.split_part(s, F.lit("="), F.lit(1))).alias("key"), decode(F.regexp_replace(s, r"^[^=]*=?", "")).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)
