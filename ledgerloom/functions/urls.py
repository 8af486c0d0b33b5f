"""URL expressions for crawls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Files that a crawl leaves out.
SKIP_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".bmp", ".webp", ".css", ".js", ".pdf", ".zip", ".rar", ".doc", ".docx",
    ".xls", ".xlsx", ".ppt", ".pptx", ".ico", ".xml",
)


def normalize_url(url: Column) -> Column:
    """Without fragment, query and trailing slashes; the url itself where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[#?].*$", ""), "/+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), url)


def net_location(url: Column) -> Column:
    """Host and port, lower case, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def admitted(url: Column, home: Column) -> Column:
    """http or https, on the home's domain, and not a skipped file."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    skipped = F.lit(False)
    for extension in SKIP_EXTENSIONS:
        skipped = skipped | path.endswith(extension)
    return F.lower(url).rlike("^https?://") & (net_location(url) == net_location(home)) & ~skipped


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme with authority, path, and query and fragment with their marks."""
    root = r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?)?"
    return F.regexp_extract(url, root, 1), F.regexp_extract(url, root + "([^?#]*)", 2), F.regexp_extract(url, r"^[^?#]*(.*)$", 1)


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments and doubled slashes."""
    raw = F.split(path, "/")
    inner = F.filter(F.slice(raw, 2, F.greatest(F.size(raw) - 2, F.lit(0))), lambda s: s != "")
    segments = F.when(F.size(raw) > 1, F.concat(F.slice(raw, 1, 1), inner, F.slice(raw, -1, 1))).otherwise(raw)
    none = F.array().cast("array<string>")
    step = lambda kept, s: F.when(s == "..", F.when(F.size(kept) > 0, F.slice(kept, 1, F.size(kept) - 1)).otherwise(none)).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))
    found = F.array_join(F.concat(F.aggregate(segments, none, step), F.when(F.element_at(raw, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)), "/")
    return F.when(found.startswith("/"), found).otherwise(F.concat(F.lit("/"), found))


def resolve(link: Column, base: Column) -> Column:
    """A link seen on ``base``: absolute, scheme-relative, root-relative, relative to the folder, a query or a fragment."""
    root, path, _ = _parts(base)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    _, own, tail = _parts(link)
    folder = F.regexp_replace(path, "[^/]*$", "")
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link == "", base)
        .when(link.startswith("#"), F.concat(root, path, query, link))
        .when(link.startswith("?"), F.concat(root, path, link))
        .when(link.startswith("/"), F.concat(root, without_dots(own), tail))
        .otherwise(F.concat(root, without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), own)), tail))
    )


def page_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*?href=["']([^"']+)["']"""), F.lit(1))
