"""Text expressions: cleaning, tokens, sentences, chunks, ids, hashing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines with one of these are page furniture.
NOISE = (
    "skip to content", "powered by", "copyright", "all rights reserved", "quick links", "facebook", "twitter", "instagram", "youtube",
    "privacy policy", "terms and conditions", "sitemap", "sharearticle",
)
# Question words left out of directory queries.
STOP_WORDS = (
    "is", "the", "a", "an", "of", "as", "with", "in", "on", "for", "to", "and", "does", "do", "list", "show", "find", "all", "entries", "related", "mention",
    "registered", "registration", "details", "available", "information", "search", "companies", "containing", "word", "name", "names", "match", "matching",
    "nbfc", "nbfcs", "arc", "arcs", "rbi", "bank", "listed", "entity", "entities", "active", "cancelled", "or", "status", "what", "which", "are", "any",
)
# Company suffixes, too common to tell names apart.
COMPANY_SUFFIXES = (
    "finance", "financial", "capital", "services", "service", "limited", "ltd", "private", "pvt", "company", "co", "corporation", "india", "holdings",
    "investment", "investments", "fin", "leasing", "credit",
)
# The characters of Windows-1252 at bytes 0x80 to 0x9F, and those bytes as Latin-1.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
#: The name space of URL-based ids (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def collapse(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """Without white space, line ends too, at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def slug(text: Column, ampersand: bool = True) -> Column:
    """Lower case with underscores; ``ampersand`` spells & as and."""
    t = F.lower(text)
    t = F.replace(t, F.lit("&"), F.lit(" and ")) if ampersand else t
    return F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def collection_name(text: Column, prefix: str = "reg_") -> Column:
    name = slug(text, ampersand=False)
    return F.when(name.startswith(prefix), name).otherwise(F.concat(F.lit(prefix), name))


def file_part(path: Column) -> Column:
    """The last segment of a path with either slash."""
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def source_name(*keys: Column) -> Column:
    """The file name of the first of several source keys that isn't blank."""
    return file_part(F.coalesce(*[F.nullif(k, F.lit("")) for k in keys]))


def repaired(line: Column) -> Column:
    """UTF-8 that was read as Windows-1252, read again; a line for which that fails stays."""
    encodable = rf"^[\x00-\x7F\x{{A0}}-\x{{FF}}{CP1252}]*$"
    text = F.encode(F.translate(line, CP1252, CP1252_BYTES), "ISO-8859-1").cast("string")
    return F.when(line.rlike(rf"[\x{{C2}}-\x{{F4}}][\x{{A0}}-\x{{BF}}{CP1252}]") & line.rlike(encodable), F.coalesce(F.try_validate_utf8(text), line)).otherwise(line)


# What clean_line removes or rewrites, in this order, before bold marks and white space.
LINE_REWRITES = ((r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[\]\([^)]+\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"<[^>]+>", ""), (r"^[#*\-\d.\s|]+", ""))


def clean_line(line: Column) -> Column:
    """Repaired; Markdown images, links, tags and leading marks removed, white space collapsed."""
    t = repaired(line)
    for pattern, meant in LINE_REWRITES:
        t = F.regexp_replace(t, pattern, meant)
    return collapse(F.replace(t, F.lit("**"), F.lit("")))


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first, the rest lower."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 1 << 30)))), "")


def stem_label(file_name: Column) -> Column:
    """A label from a file's stem: underscores and hyphens as spaces, in title case."""
    return title_case(F.translate(F.regexp_replace(file_name, r"\.[^.]*$", ""), "_-", "  "))


def strip_marks(text: Column, marks: str = " :.-") -> Column:
    return F.btrim(text, F.lit(marks))


def is_noise(line: Column, noise: Sequence[str] = NOISE) -> Column:
    """URL lines, lines under four characters, and those with a noise pattern."""
    low = F.lower(line)
    found = low.startswith("url:") | low.startswith("http://") | low.startswith("https://") | (F.length(line) < 4)
    for pattern in noise:
        found = found | low.contains(pattern)
    return found


def tokens(text: Column, pattern: str = "[a-zA-Z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def directory_terms(query: Column) -> Column:
    """Query words longer than one character that aren't question words."""
    return F.filter(tokens(query, "[a-zA-Z0-9&.]+"), lambda t: ~t.isin(*STOP_WORDS) & (F.length(t) > 1))


def core_terms(terms: Column) -> Column:
    """Terms that aren't company suffixes; all of them where nothing is left."""
    core = F.filter(terms, lambda t: ~t.isin(*COMPANY_SUFFIXES))
    return F.when(F.size(core) > 0, core).otherwise(terms)


def sentences(text: Column, longer_than: int, most: int) -> Column:
    """The first ``most`` sentences longer than ``longer_than`` characters, trimmed."""
    parts = F.transform(F.split(collapse(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.slice(F.filter(parts, lambda s: F.length(s) > longer_than), 1, most)


def bullets(text: Column, most: int = 5) -> Column:
    """Lines that begin with ``- ``, without bold marks."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^- (.+)$"), F.lit(1))
    return F.slice(F.transform(found, lambda s: F.regexp_replace(s, r"\*\*", "")), 1, most)


def key_points(text: Column, most: int = 5) -> Column:
    """Bullets, or sentences over 40 characters where there are none."""
    found = bullets(text, most)
    return F.when(F.size(found) > 0, found).otherwise(sentences(text, 40, most))


def word_chunks(text: Column, words: int = 500, overlap: int = 50) -> Column:
    """Windows of words with an overlap; the last one reaches the end."""
    parts = F.filter(F.split(collapse(text), " "), lambda w: w != "")
    step = max(1, words - overlap)
    n = F.size(parts)
    count = F.when(n == 0, 0).when(n <= words, 1).otherwise(F.ceil((n - words) / step) + 1).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(parts, i * step + 1, words), " "))


def char_chunks(text: Column, size: int = 1800, overlap: int = 250) -> Column:
    """Windows of characters of the collapsed text; the last one reaches the end."""
    t = collapse(text)
    n, step = F.length(t), max(1, size - overlap)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.trim(F.substring(t, i * step + 1, size)))


def paragraph_chunks(text: Column, size: int = 1800, overlap: int = 250, least: int = 400) -> Column:
    """Windows whose end snaps back to the last blank line, if that is over ``least`` characters in.

    Each start depends on the end before it, so (start, end) are folded over a
    sequence long enough for the smallest step, and then cut out.
    """

    def whole(x: Column) -> Column:
        t, n = x["t"], x["n"]
        rounds = F.sequence(F.lit(0), (n / max(1, least - overlap) + 1).cast("int"))

        def step(state: Column, _: Column) -> Column:
            start = state["start"]
            snapped = bound(cut_of(F.substring(t, start + 1, size)), lambda cut: F.when(cut > least, start + cut).otherwise(start + size))
            last = start + size >= n
            moved = bound(F.when(last, n).otherwise(snapped), lambda end: F.struct(F.when(last, n).otherwise(F.greatest(end - overlap, start + 1)).cast("int").alias("start"), F.concat(state["found"], F.array(F.struct(start.alias("start"), end.cast("int").alias("end")))).alias("found")))
            return F.when(start >= n, state).otherwise(moved)

        first = F.struct(F.lit(0).alias("start"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))
        found = F.aggregate(rounds, first, step, lambda s: s["found"])
        return F.filter(F.transform(found, lambda w: strip(F.substring(t, w["start"] + 1, w["end"] - w["start"]))), lambda piece: piece != "")

    def cut_of(window: Column) -> Column:
        return bound(window, lambda w: F.length(w) - F.length(F.substring_index(w, "\n\n", -1)) - 2)

    return bound(strip(collapse_newlines(text)), lambda t: bound(F.struct(t.alias("t"), F.length(t).alias("n")), whole))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: what stands in a lambda is worked out at each call, and at each place where it stands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sections(text: Column) -> Column:
    """(section, body) of each ``## heading``; a text without one is a single Document; what precedes the first goes."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=##\s)"), lambda p: p.rlike(r"^##\s+\S"))
    split = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^##\s+([^\n]+)", 1)).alias("section"), strip(F.regexp_replace(p, r"^##[^\n]*\n?", "")).alias("body")))
    whole = F.array(F.struct(F.lit("Document").alias("section"), strip(text).alias("body")))
    return F.when(F.size(split) > 0, split).otherwise(whole)


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("long")


def hash_bucket(token: Column, size: int) -> Column:
    """The first four bytes of the token's SHA-256, modulo ``size``."""
    return F.pmod(F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def uuid_text(hexes: Column) -> Column:
    return F.regexp_replace(F.substring(hexes, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def content_id(*parts: Column) -> Column:
    """An id from the SHA-1 of the parts joined by colons."""
    return uuid_text(F.sha1(F.concat_ws(":", *parts)))


def url_id(name: Column) -> Column:
    """Version-5 id of a name in the URL name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + 8).cast("long")))
    return uuid_text(F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15)))


def excerpt(text: Column, at: Column, before: int = 120, length: int = 480) -> Column:
    """Text around a 1-based place (0: from the start), with ellipses."""
    start = F.greatest(at - 1 - before, F.lit(0))
    return F.concat(F.when(start > 0, "…").otherwise(""), F.trim(F.substring(text, start + 1, F.lit(length))), F.lit("…"))


def safe_file_name(path: Column) -> Column:
    """A Markdown file name for a page's path; ``index`` where nothing is left."""
    t = F.replace(F.btrim(path, F.lit("/")), F.lit("/"), F.lit("_"))
    for extension in (".html", ".aspx"):
        t = F.replace(t, F.lit(extension), F.lit(""))
    t = F.btrim(F.substring(F.regexp_replace(t, r'[\\/*?:"<>|]', "_"), 1, 150), F.lit("._"))
    return F.concat(F.coalesce(F.nullif(t, F.lit("")), F.lit("index")), F.lit(".md"))
