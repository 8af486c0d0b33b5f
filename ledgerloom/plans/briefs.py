"""Briefs: retrieval with a pluggable embedder and generator, extractive summaries, profiles, card texts.

Models are plug-ins: without one, summaries are extractive and embeddings are
hashes.  Nothing here calls a service.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators.relational import union_all
from ledgerloom.plans import documents as D
from ledgerloom.plans import returns as R
from ledgerloom.plans.domain import table, view
from ledgerloom.plans.registry import ORACLES, register, sql_lakhs
from ledgerloom.storage import materialize


class Embedder(Protocol):
    """Unit vectors of a batch of texts; runs in the tasks, a model loaded once a worker."""

    def __call__(self, texts: pd.Series) -> pd.Series: ...


class Generator(Protocol):
    """A text from a prompt; on the driver, once a request."""

    def __call__(self, prompt: str, context: str) -> str: ...


def embed(chunks: DataFrame, embedder: Embedder, column: str = "text") -> DataFrame:
    """``chunks`` with an embedding by the plug-in, in Arrow batches."""
    model = F.pandas_udf(lambda texts: embedder(texts), "array<double>")
    return chunks.withColumn("embedding", model(F.col(column)))


def ask(hits: DataFrame, question: str, generator: Generator | None = None, least: float = 0.4, budget: int = 9000, extra: DataFrame | Sequence[str] = (), degraded: str | None = None, nothing: str | None = None) -> dict[str, str]:
    """An answer from the hits (source, text, score, maybe page) over the threshold; without a generator, their first sentences.

    ``extra`` comes before the hits: texts, or the rows (row_no, text, source)
    of registry_context.  Where the generator fails, ``degraded`` is the answer;
    without it the error is raised.  Where no hit is good enough and there is
    nothing extra, ``nothing`` is the answer; without it LookupError is raised.
    """
    from ledgerloom.plans.retrieval import context

    if isinstance(extra, DataFrame):  # two rows
        extra = [f"[{r.source}]\n{r.text}" for r in extra.orderBy("row_no").collect()]
    good = hits.where(F.col("score") >= least).withColumn("_g", F.lit(1))
    row = context(good, ["_g"], budget, F.desc("score"), F.asc("source")).first()
    if row is None and not extra:
        if nothing is None:
            raise LookupError("nothing found")
        return {"answer": nothing, "context": ""}
    packed = "\n\n".join([*extra, *([row.context] if row else [])])
    if generator:
        try:
            return {"answer": generator(question, packed), "context": packed}
        except Exception:
            if degraded is None:
                raise
            return {"answer": degraded, "context": packed}
    first = good.orderBy(F.desc("score"), "source").limit(1).select(F.array_join(T.sentences(F.col("text"), 60, 4), " ").alias("s")).first()
    return {"answer": first.s if first else "", "context": packed}


def summary(text: Column, most: int = 4) -> Column:
    """An extractive summary: the first long sentences, or the text's beginning."""
    found = T.sentences(text, 60, most)
    return F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(F.left(T.collapse(text), F.lit(900)))


def profile(extracted: DataFrame, sections: Sequence[str], fallback: str = "not found in the pages.") -> DataFrame:
    """One Markdown text of the extracted lines (category, line_no, line): every section, with a fallback where it is empty."""
    lines = extracted.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: F.concat(F.lit("- "), s["line"])), "\n").alias("body"))
    names = extracted.sparkSession.createDataFrame([(i, s) for i, s in enumerate(sections)], "section_no int, category string")
    filled = names.join(lines, "category", "left").select("section_no", F.concat(F.lit("## "), F.col("category"), F.lit("\n"), F.coalesce("body", F.lit(f"- {fallback}"))).alias("part"))
    return filled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "part"))), lambda s: s["part"]), "\n\n").alias("profile"))


@register("profile_markdown", f"WITH l AS ({ORACLES['extract_lines']}), b AS (SELECT category, string_agg('- ' || line, chr(10) ORDER BY line_no) AS body FROM l GROUP BY category), n(section_no, category) AS (VALUES {', '.join(f'({i}, {c!r})' for i, c in enumerate([*D.CATEGORIES, 'highlights']))}) SELECT string_agg('## ' || n.category || chr(10) || coalesce(body, '- not found in the pages.'), chr(10) || chr(10) ORDER BY section_no) AS profile FROM n LEFT JOIN b ON n.category = b.category")
def profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(D.extracted_lines(table(spark, sf_dir, "documents"), D.CATEGORIES), [*D.CATEGORIES, "highlights"])


#: Points of a rule-based brief: quadrant, a pattern over the extracted lines (none: always), whether it must be found, and the point.
POINTS = (
    ("Strengths", None, True, "The institution publishes pages that can be read."), ("Strengths", "license|version", True, "Licences are named in the pages."), ("Strengths", "thing|entre", True, "Local presence shows in the pages."),
    ("Weaknesses", None, True, "What the pages say needs a second source."), ("Weaknesses", "loan|credit", False, "No credit product is named."),
    ("Opportunities", None, True, "Products can be described more fully."), ("Threats", None, True, "Others offer the same."),
)


def points(lines: DataFrame, rules: Sequence[tuple[str, str | None, bool, str]] = POINTS) -> DataFrame:
    """(quadrant, place, point): the rules that hold over all ``lines`` (line), in their order."""
    found = [F.lit(True) if p is None else F.coalesce(F.bool_or(F.lower("line").rlike(p)), F.lit(False)) for _, p, _, _ in rules]
    said = [F.when(f == F.lit(wanted), F.struct(F.lit(q).alias("quadrant"), F.lit(i).alias("place"), F.lit(point).alias("point"))) for i, (f, (q, _, wanted, point)) in enumerate(zip(found, rules))]
    return lines.agg(F.count(F.lit(1)).alias("_n"), F.array_compact(F.array(*said)).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def _joined(rows: DataFrame, order: str, text: Column) -> DataFrame:
    """One row: the texts of a report's rows as lines."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda s: s["t"]), "\n").alias("body"))


#: Sections of a full profile from extracted lines: title, category, and what stands for none.
SECTIONS = (("Institution profile", "profile", "Not found."), ("Products", "products", "Not found."), ("MSME focus", "focus", "No explicit focus found."), ("Public highlights", "highlights", "Not found."), ("Geographic presence", "presence", "Not found."))
OBSERVATIONS = ("This is a first extraction; check it before it is published.", "Read the pages again when new reports appear.")


def full_profile(name: str, url: str, extracted: DataFrame, links: DataFrame, rules: Sequence[tuple] = POINTS, observations: Sequence[str] = OBSERVATIONS, sections: Sequence[tuple[str, str, str]] = SECTIONS) -> DataFrame:
    """One Markdown text of eight sections: extracted lines (category, line_no, line), points by quadrant, observations, and links (link_no, label, url).

    A corpus without lines and links gives the same sections with their
    fallbacks, and no points.  The lines, at most a dozen a category, are
    written once for all sections.
    """
    spark = extracted.sparkSession
    extracted = materialize(extracted, "profile-lines")
    own = [(extracted.where(F.col("category") == category), "line_no", F.concat(F.lit("- "), F.col("line")), title, f"- {none}") for title, category, none in sections]
    marks = points(extracted, rules)
    heads = [q for q in dict.fromkeys(r[0] for r in rules)]
    some = marks.join(extracted.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1)), F.col("_k") == 1).where("_n > 0").drop("_k", "_n")
    parts = [_joined(rows, order, text).select(F.concat(F.lit(f"## {title}\n\n"), F.coalesce(F.nullif("body", F.lit("")), F.lit(none))).alias("part")) for rows, order, text, title, none in own]
    quadrants = [_joined(some.where(F.col("quadrant") == q), "place", F.concat(F.lit("- "), F.col("point"))).select(F.concat(F.lit(("## SWOT\n\n" if i == 0 else "") + f"### {q}\n"), F.coalesce(F.nullif("body", F.lit("")), F.lit("- Not generated."))).alias("part")) for i, q in enumerate(heads)]
    said = spark.range(1).select(F.lit("## Strategic observations\n\n" + "\n".join(f"- {o}" for o in observations)).alias("part"))
    seen = _joined(links, "link_no", F.concat(F.lit("- "), F.col("label"), F.lit(": "), F.col("url"))).select(F.concat(F.lit("## Links to source documents\n\n"), F.coalesce(F.nullif("body", F.lit("")), F.lit(f"- Start: {url}"))).alias("part"))
    head = spark.range(1).select(F.lit(f"# {name}\n\nStart: {url}").alias("part"))
    whole = union_all(*[p.withColumn("n", F.lit(i)) for i, p in enumerate([head, *parts, *quadrants, said, seen])])
    return whole.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda s: s["part"]), "\n\n").alias("profile"))


def _sql_holds(pattern: str | None) -> str:
    return "TRUE" if pattern is None else f"(SELECT coalesce(bool_or(regexp_matches(lower(line), '{pattern}')), FALSE) FROM l)"


SQL_POINTS = ", ".join(f"({i}, '{q}', {_sql_holds(p)} = {wanted}, '{point}')" for i, (q, p, wanted, point) in enumerate(POINTS))
SQL_OBSERVED = " || chr(10) || ".join(f"'- {o}'" for o in OBSERVATIONS)
SQL_QUADRANTS = " || chr(10) || chr(10) || ".join(f"'### {q}' || chr(10) || coalesce((SELECT string_agg('- ' || point, chr(10) ORDER BY place) FROM p WHERE quadrant = '{q}' AND holds AND EXISTS (SELECT 1 FROM l)), '- Not generated.')" for q in dict.fromkeys(r[0] for r in POINTS))
SQL_SECTIONS = " || chr(10) || chr(10) || ".join(f"'## {t}' || chr(10) || chr(10) || coalesce((SELECT string_agg('- ' || line, chr(10) ORDER BY line_no) FROM l WHERE category = '{c}'), '- {none}')" for t, c, none in SECTIONS)


@register("full_profile", f"WITH l AS MATERIALIZED ({ORACLES['extract_lines']}), k AS ({ORACLES['page_links']}), p AS (SELECT * FROM (VALUES {SQL_POINTS}) v(place, quadrant, holds, point)) SELECT '# Bank' || chr(10) || chr(10) || 'Start: https://b.example' || chr(10) || chr(10) || {SQL_SECTIONS} || chr(10) || chr(10) || '## SWOT' || chr(10) || chr(10) || {SQL_QUADRANTS} || chr(10) || chr(10) || '## Strategic observations' || chr(10) || chr(10) || {SQL_OBSERVED} || chr(10) || chr(10) || '## Links to source documents' || chr(10) || chr(10) || coalesce((SELECT string_agg('- ' || label || ': ' || url, chr(10) ORDER BY link_no) FROM k), '- Start: https://b.example') AS profile")
def full_profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return full_profile("Bank", "https://b.example", D.extracted_lines(documents, D.CATEGORIES), D.document_links(D._page_documents(spark, sf_dir), D.CATEGORIES))


def preview(text: Column) -> Column:
    """A card's text: citations, labels and Markdown marks removed."""
    t = F.regexp_replace(text, r"\([^()]*p\.\s*\d+\)", "")
    t = F.regexp_replace(t, r"\[(FACT|AI INTERPRETATION)\]", "")
    return T.collapse(F.regexp_replace(t, r"[#*_`>|]", ""))


def labelled(line: Column) -> Column:
    """(label, rest) of a line that begins with [FACT] or [AI INTERPRETATION]."""
    return F.struct(F.nullif(F.regexp_extract(line, r"^\[(FACT|AI INTERPRETATION)\]", 1), F.lit("")).alias("label"), F.trim(F.regexp_replace(line, r"^\[(FACT|AI INTERPRETATION)\]\s*", "")).alias("rest"))


def initials(name: Column, most: int = 2) -> Column:
    """The first letters of all words in upper case, cut to ``most`` characters; U where there is none."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    letters = F.left(F.upper(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")), F.lit(most))
    return F.coalesce(F.nullif(letters, F.lit("")), F.lit("U"))


def ask_key(question: Column) -> Column:
    return F.concat(F.lit("ask:"), F.lower(T.collapse(question)))


def policy_key(ids: Column, focus: Column) -> Column:
    return F.concat(F.lit("policy:"), F.array_join(F.array_sort(ids), ","), F.lit(":"), F.coalesce(focus, F.lit("")))


def amount(text: Column) -> Column:
    """The number in a money or percentage text; null where there is none."""
    return F.regexp_replace(text, r"[^\d.]", "").try_cast("double")


@register("card_texts", r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\([^()]*p\.\s*\d+\)', '', 'g'), '\[(FACT|AI INTERPRETATION)\]', '', 'g'), '[#*_`>|]', '', 'g'), '\s+', ' ', 'g')) AS preview,
'ask:' || lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS ask_key, coalesce(nullif(left(upper(replace(array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: left(w, 1)), ''), 'ß', 'SS')), 2), ''), 'U') AS initials FROM conversations""")
def cards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", preview(text).alias("preview"), ask_key(text).alias("ask_key"), initials(text).alias("initials"))


@register("document_summaries", r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), s AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 60)[1:4] AS s FROM c)
SELECT doc_id, CASE WHEN len(s) > 0 THEN array_to_string(s, ' ') ELSE left(t, 900) END AS summary FROM s""")
def summaries_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", summary(F.col("text")).alias("summary"))


def derived_lines(totals: DataFrame, factors: Mapping[str, tuple[str | None, str | None]]) -> DataFrame:
    """(line, amount_lakhs): each line a share of the loan book or a flat amount; factors are the caller's data."""
    rows = totals.sparkSession.createDataFrame([(k, a, b, 1) for k, (a, b) in factors.items()], "line string, factor string, flat string, _k int")
    book = totals.select(F.col("total_loan_book").cast("decimal(18,2)").alias("book"), F.lit(1).alias("_k"))
    value = F.coalesce(F.col("book") * F.col("factor").cast("decimal(6,3)"), F.col("flat").cast("decimal(12,2)"))
    return rows.join(book, "_k").select("line", F.round(value, 2).cast("double").alias("amount_lakhs"))


#: Capital and sensitive-exposure lines of the registered query: a share of the book, or flat lakhs.
LINES = {"capital": (None, "2500.00"), "reserves": (None, "1200.00"), "capital market": (None, "420.00"), "real estate": (None, "430.00"), "priority sector": ("0.650", None)}


@register("derived_capital_lines", f"""WITH t AS (SELECT CAST({sql_lakhs(f'coalesce(sum({R.OUTSTANDING}), 0)')} AS DECIMAL(18,2)) AS book FROM v_loans WHERE {R.IN_BOOK}), f(line, factor, flat) AS (VALUES {', '.join(f"('{k}', {a or 'NULL'}, {b or 'NULL'})" for k, (a, b) in LINES.items())})
SELECT line, CAST(round(CAST(coalesce(book * CAST(factor AS DECIMAL(6,3)), CAST(flat AS DECIMAL(12,2))) AS DECIMAL(28,5)), 2) AS DOUBLE) AS amount_lakhs FROM f, t""", ("v_loans",))
def lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_lines(R.portfolio_totals(view(spark, sf_dir, "v_loans"), R.AS_OF), LINES)


def cached(state: DataFrame, key: str, produce: Callable[[], str | None], now: str, refresh: bool = False, ttl_hours: int = 12) -> tuple[str | None, DataFrame]:
    """A fresh payload of ``key`` or a newly produced one, and the state after it; nothing is stored for None."""
    from ledgerloom.plans.state import cache_lookup

    full = f"v3:{key}"
    if not refresh:
        row = cache_lookup(state.where(F.col("cache_key") == full), now, ttl_hours).select("payload").first()
        if row is not None:
            return row.payload, state
    made = produce()
    if made is None:
        return None, state
    new = state.sparkSession.createDataFrame([(full, made)], "cache_key string, payload string").withColumn("generated_at", F.lit(now).cast("timestamp_ntz"))
    return made, union_all(state.where(F.col("cache_key") != full), new)
