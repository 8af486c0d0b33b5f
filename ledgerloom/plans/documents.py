"""Document work: cleaning, statistics, category ranking, extraction, chunking, hashing embeddings, links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import urls as U
from ledgerloom.operators.relational import first_seen, top_k, top_k_per_group, union_all
from ledgerloom.plans.domain import table
from ledgerloom.plans.registry import register
from ledgerloom.storage import materialize

#: Categories of the registered queries, by words that occur in the test texts: keyword -> weight follows from its spaces.
CATEGORIES: Mapping[str, Sequence[str]] = {
    "profile": ["license", "version", "general public"],
    "products": ["disgusting", "worthless", "stupid"],
    "presence": ["thing", "tion on", "entre"],
}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _sql_clean(line: str) -> str:
    """clean_line in DuckDB: text is read again as UTF-8 by way of the bytes of its characters."""
    byte = "CASE WHEN ord(x) < 256 THEN ord(x) ELSE CASE x " + " ".join(f"WHEN '{c}' THEN {ord(b)}" for c, b in zip(T.CP1252, T.CP1252_BYTES)) + " END END"
    able = f"regexp_full_match({line}, '[\\x00-\\x7F\\x{{A0}}-\\x{{FF}}{T.CP1252}]*') AND regexp_matches({line}, '[\\x{{C2}}-\\x{{F4}}][\\x{{A0}}-\\x{{BF}}{T.CP1252}]')"
    t = f"CASE WHEN {able} THEN coalesce(TRY(decode(unhex(array_to_string(list_transform(string_split({line}, ''), lambda x: printf('%02X', {byte})), '')))), {line}) ELSE {line} END"
    for pattern, meant in (("!\\[[^\\]]*\\]\\([^)]+\\)", ""), ("\\[\\]\\([^)]+\\)", ""), ("\\[([^\\]]+)\\]\\([^)]+\\)", "\\1"), ("<[^>]+>", "")):
        t = f"regexp_replace({t}, '{pattern}', '{meant}', 'g')"
    t = f"regexp_replace({t}, '^[#*\\-\\d.\\s|]+', '')"
    return f"trim(regexp_replace(replace({t}, '**', ''), '\\s+', ' ', 'g'))"


SQL_NOISE = "(lower(line) LIKE 'url:%' OR lower(line) LIKE 'http://%' OR lower(line) LIKE 'https://%' OR length(line) < 4 OR " + " OR ".join(f"contains(lower(line), '{p}')" for p in T.NOISE) + ")"


@register("clean_lines", rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents), c AS (SELECT doc_id, {_sql_clean("raw")} AS line FROM l), k AS (SELECT * FROM c WHERE NOT {SQL_NOISE})
SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, count(DISTINCT line) AS distinct_lines FROM k GROUP BY doc_id""")
def clean_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted in each document's array of lines: nothing is shuffled."""
    kept = _docs(spark, sf_dir).select("doc_id", kept_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda n, line: n + F.length(line))
    return kept.select("doc_id", F.size("lines").cast("long").alias("lines"), chars.alias("chars"), F.size(F.array_distinct("lines")).cast("long").alias("distinct_lines"))


def kept_lines(text: Column) -> Column:
    """Cleaned lines that aren't noise, in order."""
    return F.filter(F.transform(F.split(text, "\n"), T.clean_line), lambda line: ~T.is_noise(line))


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, line): cleaned lines that aren't noise, in order; cleaned inside the array, so once a line."""
    return documents.select("doc_id", F.posexplode(kept_lines(F.col("text"))).alias("pos", "line"))


@register("doc_token_stats", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z0-9]+') AS t FROM documents)
SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, CAST(len(list_distinct(t)) AS BIGINT) AS distinct_tokens, CAST(len(list_intersect(list_distinct(t), ['the', 'of', 'thing', 'version', 'de'])) AS BIGINT) AS overlap FROM t""")
def token_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"))
    wanted = F.array(*[F.lit(x) for x in ("the", "of", "thing", "version", "de")])
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"), F.size(F.array_intersect("t", wanted)).cast("long").alias("overlap"))


def category_scores(documents: DataFrame, categories: Mapping[str, Sequence[str]], hints: Mapping[str, Sequence[str]] | None = None, name: str = "source") -> DataFrame:
    """(doc_id, category, score): keyword occurrences, four times for phrases, plus 100 where the name has a hint.

    Keywords are few, so each document's scores are one array of columns: no join.
    A text is lower-cased once for all of them.
    """
    documents = documents.select("doc_id", F.lower("text").alias("_low"), *([name] if hints else []))
    low = F.col("_low")
    rows = []
    for category, words in categories.items():
        score = sum((T.occurrences(low, F.lit(w)) * (4 if " " in w else 1) for w in words), F.lit(0).cast("long"))
        for hint in (hints or {}).get(category, ()):
            score = score + F.when(F.lower(name).contains(hint), 100).otherwise(0)
        rows.append(F.struct(F.lit(category).alias("category"), score.alias("score")))
    return documents.select("doc_id", F.explode(F.array(*rows)).alias("s")).select("doc_id", "s.*").where("score > 0")


def ranked_documents(documents: DataFrame, categories: Mapping[str, Sequence[str]], k: int = 8, hints: Mapping[str, Sequence[str]] | None = None, name: str = "source") -> DataFrame:
    return top_k_per_group(category_scores(documents, categories, hints, name), ["category"], k, F.desc("score"), F.asc("doc_id"), rank="place")


def _sql_score(words: Sequence[str]) -> str:
    return " + ".join(f"((length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}) * {4 if ' ' in w else 1}" for w in words)


SQL_RANK = " UNION ALL ".join(f"SELECT doc_id, text, '{c}' AS category, {_sql_score(w)} AS score FROM documents" for c, w in CATEGORIES.items())
SQL_RANKED = f"s AS ({SQL_RANK}), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0 QUALIFY place <= 8)"


@register("category_doc_rank", f"WITH {SQL_RANKED} SELECT doc_id, category, CAST(score AS BIGINT) AS score, CAST(place AS INTEGER) AS place FROM r")
def rank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(_docs(spark, sf_dir), CATEGORIES)


#: Words in the sources' names that put their documents first.
HINTS: Mapping[str, Sequence[str]] = {"profile": ("src1",), "presence": ("src7", "src9")}
SQL_HINTED = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, {_sql_score(w)}" + "".join(f" + CASE WHEN contains(lower(source), '{h}') THEN 100 ELSE 0 END" for h in HINTS.get(c, ())) + " AS score FROM documents" for c, w in CATEGORIES.items())


@register("category_doc_rank_hinted", f"WITH s AS ({SQL_HINTED}) SELECT doc_id, category, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, doc_id) AS INTEGER) AS place FROM s WHERE score > 0 QUALIFY place <= 8")
def hinted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(_docs(spark, sf_dir), CATEGORIES, hints=HINTS)


def extracted_lines(documents: DataFrame, categories: Mapping[str, Sequence[str]], shortest: int = 20, longest: int = 260, most: int = 12) -> DataFrame:
    """(category, line_no, line): lines with a keyword of the category's best documents, in their order, each once.

    The best are eight a category, so they pick the texts before any line is
    cleaned.  The outer explode keeps it so: for the inner one Spark adds a
    filter on the array's size and pushes it below the join, to all documents.
    """
    best = ranked_documents(documents, categories).select("doc_id", "category", "place")
    found = documents.join(F.broadcast(best), "doc_id").select("category", "place", "doc_id", F.posexplode_outer(kept_lines(F.col("text"))).alias("pos", "line"))
    low = F.lower("line")
    hit = F.lit(False)
    for category, words in categories.items():
        some = F.lit(False)
        for w in words:
            some = some | low.contains(w)
        hit = hit | ((F.col("category") == category) & some)
    found = found.where(hit & F.length("line").between(shortest, longest))
    once = first_seen(found, ["category", low], F.asc("place"), F.asc("pos"))
    return top_k_per_group(once, ["category"], most, F.asc("place"), F.asc("pos"), rank="line_no").select("category", "line_no", "doc_id", "line")


SQL_HIT = " OR ".join("(category = '%s' AND (%s))" % (c, " OR ".join(f"contains(lower(line), '{x}')" for x in w)) for c, w in CATEGORIES.items())


@register("extract_lines", rf"""WITH {SQL_RANKED},
l AS (SELECT doc_id, category, place, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM r),
c AS (SELECT doc_id, category, place, pos, {_sql_clean("raw")} AS line FROM l),
h AS (SELECT * FROM c WHERE ({SQL_HIT}) AND length(line) BETWEEN 20 AND 260 AND NOT (lower(line) LIKE 'url:%' OR lower(line) LIKE 'http://%' OR lower(line) LIKE 'https://%' OR {" OR ".join(f"contains(lower(line), '{p}')" for p in T.NOISE)})),
o AS (SELECT *, row_number() OVER (PARTITION BY category, lower(line) ORDER BY place, pos) AS f FROM h QUALIFY f = 1)
SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY place, pos) AS INTEGER) AS line_no, doc_id, line FROM o QUALIFY line_no <= 12""")
def extract_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted_lines(_docs(spark, sf_dir), CATEGORIES)


def products(documents: DataFrame, words: Sequence[str], shortest: int = 5, longest: int = 120, most: int = 30) -> DataFrame:
    """(line_no, doc_id, line): short lines with a keyword of the best documents, each once, without marks at the ends."""
    found = extracted_lines(documents, {"products": words}, shortest, longest, most)
    return found.select("line_no", "doc_id", T.strip_marks(F.col("line")).alias("line"))


SQL_PRODUCT = " OR ".join(f"contains(lower(line), '{x}')" for x in CATEGORIES["presence"])


@register("product_lines", rf"""WITH {SQL_RANKED},
l AS (SELECT doc_id, place, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM r WHERE category = 'presence'), c AS (SELECT doc_id, place, pos, {_sql_clean("raw")} AS line FROM l),
h AS (SELECT * FROM c WHERE ({SQL_PRODUCT}) AND length(line) BETWEEN 5 AND 120 AND NOT {SQL_NOISE}), o AS (SELECT *, row_number() OVER (PARTITION BY lower(line) ORDER BY place, pos) AS f FROM h QUALIFY f = 1)
SELECT CAST(row_number() OVER (ORDER BY place, pos) AS INTEGER) AS line_no, doc_id, trim(line, ' :.-') AS line FROM o QUALIFY line_no <= 30""")
def products_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(_docs(spark, sf_dir), CATEGORIES["presence"])


def document_links(documents: DataFrame, categories: Mapping[str, Sequence[str]], most: int = 30) -> DataFrame:
    """(link_no, label, url) of documents (doc_id, file_name, url, text): those the categories used come first, each url once.

    Urls are reduced to their first place by a partial aggregation; texts are only scored.
    """
    used = ranked_documents(documents.withColumn("source", F.col("file_name")), categories)
    order = F.create_map(*[F.lit(x) for pair in zip(categories, range(len(categories))) for x in pair])
    at = F.struct(F.coalesce(order[F.col("category")], F.lit(len(categories))).alias("part"), F.coalesce("place", F.lit(0)).alias("place"), "doc_id")
    both = documents.select("doc_id", "file_name", "url").join(F.broadcast(used.select("doc_id", "category", "place")), "doc_id", "left").where(F.coalesce("url", F.lit("")) != "")
    first = both.groupBy("url").agg(F.min(F.struct(at.alias("at"), "file_name")).alias("m"))
    best = top_k(first.select("url", "m.*"), most, F.asc("at"))
    return best.select(F.row_number().over(Window.orderBy("at")).alias("link_no"), T.stem_label(F.col("file_name")).alias("label"), "url")


def _page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), T.safe_file_name(path).alias("file_name"), "url", F.col("html").alias("text"))


SQL_FILE = r"""coalesce(nullif(trim(substr(regexp_replace(replace(replace(replace(trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), '/', '_'), '.html', ''), '.aspx', ''), '[\\/*?:"<>|]', '_', 'g'), 1, 150), '._'), ''), 'index') || '.md'"""


@register("page_links", f"""WITH documents AS MATERIALIZED (SELECT page_id AS doc_id, {SQL_FILE} AS file_name, url, html AS text FROM pages), {SQL_RANKED},
b AS (SELECT doc_id, url, file_name, CASE category WHEN 'profile' THEN 0 WHEN 'products' THEN 1 WHEN 'presence' THEN 2 ELSE 3 END AS part, coalesce(place, 0) AS place FROM documents LEFT JOIN (SELECT doc_id, category, place FROM r) r USING (doc_id) WHERE url <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY part, place, doc_id) AS n FROM b QUALIFY n = 1), t AS (SELECT *, row_number() OVER (ORDER BY part, place, doc_id) AS link_no FROM f QUALIFY link_no <= 30)
SELECT CAST(link_no AS INTEGER) AS link_no, array_to_string(list_transform(regexp_extract_all(translate(regexp_replace(file_name, '\\.[^.]*$', ''), '_-', '  '), '\\pL+|\\PL+'), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), '') AS label, url FROM t""")
def links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_links(_page_documents(spark, sf_dir), CATEGORIES)


def observations(documents: DataFrame, by: str, rules: Mapping[str, str]) -> DataFrame:
    """Per group a flag for each pattern, and the remarks that apply, joined by semicolons."""
    flags = documents.groupBy(by).agg(*[F.coalesce(F.bool_or(F.lower("text").rlike(p)), F.lit(False)).alias(f"has_{n}") for n, p in rules.items()])
    said = F.array_compact(F.array(F.lit("Public pages exist."), *[F.when(F.col(f"has_{n}"), F.lit(f"{n} is mentioned.")) for n in rules], F.when(~F.col(f"has_{next(iter(rules))}"), F.lit("The first topic is missing."))))
    return flags.withColumn("remarks", F.array_join(said, "; "))


TOPICS = {"license": "license|licence", "insults": "stupid|worthless|idiot", "versions": "version [0-9]"}


@register("keyword_flags_swot", "WITH f AS (SELECT source, " + ", ".join(f"bool_or(regexp_matches(lower(text), '{p}')) AS has_{n}" for n, p in TOPICS.items()) + " FROM documents GROUP BY source) SELECT *, array_to_string(list_filter(['Public pages exist.', " + ", ".join(f"CASE WHEN has_{n} THEN '{n} is mentioned.' END" for n in TOPICS) + ", CASE WHEN NOT has_license THEN 'The first topic is missing.' END], lambda x: x IS NOT NULL), '; ') AS remarks FROM f")
def observations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(_docs(spark, sf_dir), "source", TOPICS)


@register("sentences_extract", r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 60)[1:4] AS s FROM c)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n, array_to_string(s, ' ') AS summary FROM s""")
def sentences_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text"), 60, 4).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.array_join("s", " ").alias("summary"))


@register("key_points", r"""WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?m)^- (.+)$', 1)[1:5], lambda x: replace(x, '**', '')) AS b, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(b) > 0 THEN b ELSE list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 40)[1:5] END AS p FROM b) SELECT doc_id, array_to_string(p, '|') AS points FROM s""")
def key_points_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.key_points(F.col("text")), "|").alias("points"))


def chunks(documents: DataFrame, column) -> DataFrame:
    """(doc_id, chunk_index, text) of an array of chunks."""
    return documents.select("doc_id", F.posexplode(column).alias("chunk_index", "text"))


def _digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "chunk_index", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@register("chunk_words", r"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents), n AS (SELECT *, len(w) AS n, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 500 THEN 1 ELSE CAST(ceil((len(w) - 500) / 450.0) AS BIGINT) + 1 END AS k FROM w),
c AS (SELECT doc_id, w, unnest(range(k)) AS i FROM n), t AS (SELECT doc_id, i, array_to_string(w[i * 450 + 1 : i * 450 + 500], ' ') AS t FROM c) SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, length(t) AS chars, md5(t) AS digest FROM t""")
def chunk_words_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(chunks(_docs(spark, sf_dir), T.word_chunks(F.col("text"))))


@register("chunk_chars", r"""WITH w AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), n AS (SELECT *, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 1800 THEN 1 ELSE CAST(ceil((length(t) - 1800) / 1550.0) AS BIGINT) + 1 END AS k FROM w),
c AS (SELECT doc_id, t, unnest(range(k)) AS i FROM n), x AS (SELECT doc_id, i, trim(substr(t, i * 1550 + 1, 1800)) AS t FROM c) SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, length(t) AS chars, md5(t) AS digest FROM x""")
def chunk_chars_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(chunks(_docs(spark, sf_dir), T.char_chunks(F.col("text"))))


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _sql_paragraphs(keys: str, source: str) -> str:
    """CTEs of the paragraph windows of ``source`` (keys, text): each window's start follows from the one before it."""
    return f"""t AS (SELECT {keys}, {_sql_strip("regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM {source}),
r AS (SELECT {keys}, t, length(t) AS n, 0 AS start FROM t WHERE length(t) > 0
  UNION ALL SELECT {keys}, t, n, CASE WHEN start + 1800 >= n THEN n ELSE greatest(start + CASE WHEN cut > 400 THEN cut ELSE 1800 END - 250, start + 1) END
  FROM (SELECT *, length(substr(t, start + 1, 1800)) - length(string_split(substr(t, start + 1, 1800), chr(10) || chr(10))[-1]) - 2 AS cut FROM r WHERE start < n) w),
e AS (SELECT *, length(substr(t, start + 1, 1800)) - length(string_split(substr(t, start + 1, 1800), chr(10) || chr(10))[-1]) - 2 AS cut FROM r WHERE start < n),
p AS (SELECT {keys}, start, {_sql_strip("substr(t, start + 1, CASE WHEN start + 1800 >= n THEN n - start WHEN cut > 400 THEN cut ELSE 1800 END)")} AS piece FROM e)"""


@register("chunk_paragraphs", f"WITH RECURSIVE {_sql_paragraphs('doc_id', 'documents')} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_index, length(piece) AS chars, md5(piece) AS digest FROM p WHERE piece <> ''")
def chunk_paragraphs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(chunks(_docs(spark, sf_dir), T.paragraph_chunks(F.col("text"))))


def section_chunks(documents: DataFrame) -> DataFrame:
    """(doc_id, section, chunk_index, text): paragraph chunks of each section, numbered through the document."""
    parts = documents.select("doc_id", F.posexplode(T.sections(F.col("text"))).alias("section_no", "s")).select("doc_id", "section_no", "s.*")
    found = parts.select("doc_id", "section", "section_no", F.posexplode(T.paragraph_chunks(F.col("body"))).alias("pos", "text"))
    order = Window.partitionBy("doc_id").orderBy("section_no", "pos")
    return found.select("doc_id", "section", (F.row_number().over(order) - 1).alias("chunk_index"), "text")


@register("split_sections", f"WITH RECURSIVE s AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), {_sql_paragraphs('conv_id, turn', 's')} SELECT conv_id AS doc_id, 'turn ' || lpad(CAST(turn AS VARCHAR), 6, '0') AS section, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, start) - 1 AS INTEGER) AS chunk_index, md5(piece) AS digest FROM p WHERE piece <> ''")
def sections_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: a heading for each turn."""
    turn = F.concat(F.lit("## turn "), F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit("\n"), F.coalesce("text", F.lit("")))
    whole = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(turn)), "\n").alias("text"))
    return section_chunks(whole).select("doc_id", "section", "chunk_index", F.md5("text").alias("digest"))


#: Tokens that hash_embedding encodes at once: some 20 MB of arrays.
SLICE_TOKENS = 1 << 18


def _token_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``SLICE_TOKENS`` in their second column, or one longer row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
            yield batch.slice(at, to - at)
            at = to


def hash_embedding(documents: DataFrame, size: int = 1024) -> DataFrame:
    """Sparse (doc_id, bucket, weight): token counts by hash bucket, at unit length; a row is a document.

    Arrow encodes the tokens of some documents at once (about ``SLICE_TOKENS``,
    or one longer document), so each distinct one is hashed once, and a
    document's counts never leave its task.
    """

    def embed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _token_slices(batches):
            n = batch.num_rows
            coded = batch.column(1).flatten().dictionary_encode()
            bucket = np.array([int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "big") % size for t in coded.dictionary.to_pylist()], np.int64)
            document = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())
            keys, counts = np.unique(document * size + bucket[coded.indices.to_numpy()], return_counts=True)
            of = keys // size
            norm = np.sqrt(np.bincount(of, weights=counts.astype(np.float64) ** 2, minlength=n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array((keys % size).astype(np.int32)), pa.array(counts / norm[of])], names=["doc_id", "bucket", "weight"])
        pa.default_memory_pool().release_unused()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", T.tokens(F.col("text")).alias("tokens")).mapInArrow(embed, f"doc_id {kind}, bucket int, weight double")


@register("hash_embedding", """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9]+')) AS t FROM documents), c AS (SELECT doc_id, CAST(CAST('0x' || substr(sha256(t), 1, 8) AS BIGINT) % 1024 AS INTEGER) AS bucket, count(*) AS n FROM t GROUP BY 1, 2)
SELECT doc_id, bucket, CAST(round(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY doc_id) AS DOUBLE)), 6) AS DECIMAL(9,6))::VARCHAR AS weight FROM c""")
def embedding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_embedding(_docs(spark, sf_dir)).withColumn("weight", F.round("weight", 6).cast("decimal(9,6)").cast("string"))


@register("point_ids", """SELECT doc_id, regexp_replace(substr(sha1(source || ':' || lang || ':' || CAST(n_chars AS VARCHAR) || ':' || text), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS content_id FROM documents""")
def point_ids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.content_id(F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), F.col("text")).alias("content_id"))


@register("slugs_and_files", rf"""WITH s AS (SELECT page_id, url, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t FROM pages)
SELECT page_id, regexp_replace(regexp_replace(replace(t, '&', ' and '), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, {SQL_FILE} AS file_name FROM s""")
def slugs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"), T.safe_file_name(path).alias("file_name"))


@register("normalize_urls", r"""WITH n AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[#?].*$', ''), '/+$', '') AS b, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS p FROM pages)
SELECT page_id, CASE WHEN b = '' THEN url ELSE b END AS normal, host, regexp_matches(lower(url), '^https?://') AND host = 'ththth.example.com' AND NOT (""" + " OR ".join(f"p LIKE '%{x}'" for x in U.SKIP_EXTENSIONS) + """) AS admitted FROM n""")
def urls_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_url(url).alias("normal"), U.net_location(url).alias("host"), U.admitted(url, F.lit("https://www.ththth.example.com/")).alias("admitted"))


def frontier(edges: DataFrame, seeds: DataFrame, most_rounds: int | None = None, most_pages: int | None = None, site: Column | None = None) -> DataFrame:
    """(id, depth): pages reached from the seeds over (src, dst) links, breadth first.

    Each round joins the newest pages to the links and drops those seen, and is
    written to the shared folder; it ends when nothing new is found, or after
    ``most_rounds`` where that is given.  ``most_pages`` keeps the first by
    depth and id, of each ``site`` (a column of id) or of all.
    """
    parts = [materialize(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "frontier")]
    for depth in count(1) if most_rounds is None else range(1, most_rounds + 1):
        found = edges.join(parts[-1].select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        newest = materialize(found.join(union_all(*parts).select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if newest.isEmpty():
            break
        parts.append(newest)
        if len(parts) > 32:  # a long chain of rounds becomes one table again
            parts = [materialize(union_all(*parts[:-1]), "frontier"), newest]
    seen = union_all(*parts)
    if most_pages and site is not None:
        return top_k_per_group(seen.withColumn("_site", site), ["_site"], most_pages, F.asc("depth"), F.asc("id")).drop("_site")
    return seen.orderBy("depth", "id").limit(most_pages) if most_pages else seen


@register("page_links_frontier", r"""WITH p AS (SELECT regexp_replace(regexp_replace(url, '[#?].*$', ''), '/+$', '') AS src, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS root, html FROM pages),
e AS (SELECT DISTINCT src, regexp_replace(regexp_replace(root || unnest(list_filter(regexp_extract_all(html, '<a\s[^>]*?href=["'']([^"'']+)["'']', 1), lambda x: x LIKE '/%')), '[#?].*$', ''), '/+$', '') AS dst FROM p),
s AS (SELECT min(src) AS id FROM p GROUP BY regexp_replace(lower(regexp_extract(root, '://(.*)', 1)), '^www\.', '')),
n AS (SELECT DISTINCT dst AS id FROM e JOIN s ON src = id WHERE dst NOT IN (SELECT id FROM s))
SELECT id, 0 AS depth FROM s UNION ALL SELECT id, 1 FROM n UNION ALL SELECT DISTINCT dst, 2 FROM e JOIN n ON src = id WHERE dst NOT IN (SELECT id FROM s UNION SELECT id FROM n)""")
def frontier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one page of each site; the pages' links are all below their own root."""
    pages = table(spark, sf_dir, "pages").select(U.normalize_url(F.col("url")).alias("src"), "url", "html")
    links = pages.select("src", F.explode(U.page_links(F.col("html"))).alias("link"), "url").select("src", U.normalize_url(U.resolve(F.col("link"), F.col("url"))).alias("dst")).distinct()
    return frontier(links, pages.groupBy(U.net_location(F.col("src"))).agg(F.min("src").alias("id")))


# Inline labels, section headings in capitals or Markdown, interpretive sections, and citations of a page.
LABELS = r"\s*\[(?:FACT|AI INTERPRETATION)\]\s*"
CAPITAL_HEADING = r"^(?:\*\*)?([A-Z][A-Z0-9 &/'()\-]{2,48})(?:\*\*)?\s*:?\s*(?:\*\*)?\s*(.*)$"
MARKED_HEADING = r"^(?:#{1,4}\s+|\*\*)(.+?)(?:\*\*)?\s*$"
INTERPRETIVE = r"\b(SO WHAT|MOVES FOR|STRATEGIC|RECOMMEND|IMPLICATION|OUTLOOK|OBSERVATION|TAKEAWAY|WHAT THIS MEANS)\b"
CITATION = r"\((?:Source:\s*)?([^()\n]{2,90}?,\s*(?:p\.|page\s+)[\w?]+)\)"
BULLET = r"^(?:[-*•]|\d{1,2}\.)\s+(.*)$"


def brief_blocks(documents: DataFrame) -> DataFrame:
    """(doc_id, block, kind, text, interpretive, citations): a brief's headings, paragraphs and runs of bullets, in order.

    Inline labels go; what follows a heading in capitals is a paragraph of its
    own; a blank line ends a run of bullets.  Everything happens inside the
    array of a document's lines.
    """

    def blocks_of(raw: Column) -> Column:
        line = F.trim(raw)
        item = F.regexp_extract(line, BULLET, 1)
        title = F.trim(F.regexp_extract(line, CAPITAL_HEADING, 1))
        marked = line.rlike(MARKED_HEADING) & (F.length(line) < 60) & ~line.contains(":") & (line.startswith("#") | (line.startswith("**") & line.endswith("**")))
        one = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
        rest = F.trim(F.regexp_extract(line, CAPITAL_HEADING, 2))
        heading = F.when(rest != "", F.array(one("heading", title), one("paragraph", rest))).otherwise(F.array(one("heading", title)))
        return (
            F.when(line == "", F.array(one("gap", line)))
            .when(line.rlike(BULLET), F.array(one("bullets", item)))
            .when(line.rlike(CAPITAL_HEADING) & (F.length(F.regexp_extract(line, CAPITAL_HEADING, 1)) >= 4), heading)
            .when(marked, F.array(one("heading", F.trim(F.regexp_extract(line, MARKED_HEADING, 1)))))
            .otherwise(F.array(one("paragraph", line)))
        )

    plain = F.regexp_replace("text", LABELS, " ")
    rows = documents.select("doc_id", F.flatten(F.transform(F.split(plain, "\n"), blocks_of)).alias("b")).withColumn("n", F.size("b"))
    places = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (F.get("b", i - 1)["kind"] != "bullets") | (i == 1) | (F.coalesce(F.get("b", i - 2)["kind"], F.lit("")) != "bullets"))
    starts = rows.where("n > 0").withColumn("starts", places)
    end = lambda j: F.coalesce(F.get("starts", j + 1), F.col("n") + 1)
    run = lambda s, j: F.struct(F.get("b", s - 1)["kind"].alias("kind"), F.array_join(F.transform(F.slice("b", s, end(j) - s), lambda x: x["text"]), "\n").alias("text"))
    made = F.filter(F.transform("starts", run), lambda x: x["kind"] != "gap")
    found = starts.select("doc_id", F.posexplode(made).alias("block", "m")).select("doc_id", "block", "m.*")
    return found.withColumn("interpretive", (F.col("kind") == "heading") & F.col("text").rlike(INTERPRETIVE)).withColumn("citations", F.regexp_extract_all("text", F.lit(CITATION), F.lit(1)))


@register("brief_blocks", rf"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '{LABELS}', ' ', 'g'), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(text, '{LABELS}', ' ', 'g'), chr(10)), 1) AS pos FROM documents),
t AS (SELECT doc_id, pos, trim(raw) AS line FROM l),
k AS (SELECT *, CASE WHEN line = '' THEN 'gap' WHEN regexp_matches(line, '{BULLET}') THEN 'bullets' WHEN length(regexp_extract(line, '{CAPITAL_HEADING.replace("'", "''")}', 1)) >= 4 THEN 'capitals'
  WHEN regexp_matches(line, '{MARKED_HEADING}') AND length(line) < 60 AND NOT contains(line, ':') AND (line LIKE '#%' OR line LIKE '**%**') THEN 'marked' ELSE 'paragraph' END AS kind FROM t),
x AS (SELECT doc_id, pos, 0 AS part, CASE kind WHEN 'capitals' THEN 'heading' WHEN 'marked' THEN 'heading' ELSE kind END AS kind, CASE kind WHEN 'bullets' THEN regexp_extract(line, '{BULLET}', 1) WHEN 'capitals' THEN trim(regexp_extract(line, '{CAPITAL_HEADING.replace("'", "''")}', 1)) WHEN 'marked' THEN trim(regexp_extract(line, '{MARKED_HEADING}', 1)) ELSE line END AS text FROM k
  UNION ALL SELECT doc_id, pos, 1, 'paragraph', trim(regexp_extract(line, '{CAPITAL_HEADING.replace("'", "''")}', 2)) FROM k WHERE kind = 'capitals' AND trim(regexp_extract(line, '{CAPITAL_HEADING.replace("'", "''")}', 2)) <> ''),
s AS (SELECT *, CASE WHEN kind = 'bullets' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY pos, part) = 'bullets' THEN 0 ELSE 1 END AS start FROM x), g AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY pos, part) AS run FROM s WHERE TRUE),
b AS (SELECT doc_id, run, any_value(kind) AS kind, string_agg(text, chr(10) ORDER BY pos, part) AS text FROM g GROUP BY doc_id, run)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INTEGER) AS block, kind, md5(text) AS digest, kind = 'heading' AND regexp_matches(text, '{INTERPRETIVE}') AS interpretive, CAST(len(regexp_extract_all(text, '{CITATION}')) AS INTEGER) AS citations FROM b WHERE kind <> 'gap'""")
def brief_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brief_blocks(_docs(spark, sf_dir)).select("doc_id", "block", "kind", F.md5("text").alias("digest"), "interpretive", F.size("citations").alias("citations"))


HEADINGS = ("Strengths", "Weaknesses", "Opportunities", "Threats")
#: The heading of the part that is running text instead of points.
OBSERVATION = "Strategic observation"


def _parts_of(text: Column, headings: Sequence[str]) -> Column:
    """(name, lines) of each heading's part, in order; ``rest`` is what follows the heading on its line."""
    low = "|".join(h.lower() for h in headings)

    def parts(lines: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.lower(F.element_at(lines, i)).rlike(f"^[#*\\s]*({low})\\b"))
        return T.bound(at, lambda at: F.transform(at, lambda s, j: part(lines, s, F.coalesce(F.get(at, j + 1), F.size(lines) + 1))))

    def part(lines: Column, start: Column, end: Column) -> Column:
        return F.struct(
            F.regexp_extract(F.lower(F.element_at(lines, start)), f"^[#*\\s]*({low})\\b", 1).alias("name"),
            F.trim(F.regexp_replace(F.element_at(lines, start), f"(?i)^[#*\\s]*({low})\\b\\s*\\**:?\\s*", "")).alias("rest"),
            F.slice(lines, start + 1, end - start - 1).alias("lines"),
        )

    return T.bound(F.split(text, "\n"), parts)


def quadrants(documents: DataFrame, headings: Sequence[str] = HEADINGS) -> DataFrame:
    """(doc_id, quadrant, items): bullets under the last heading before them, found inside the array of lines."""
    parts = documents.select("doc_id", _parts_of(F.col("text"), [*headings, OBSERVATION]).alias("parts"))
    mark = r"^\s*[-*•]\s+"
    items = lambda name: F.flatten(F.transform(F.filter("parts", lambda p: p["name"] == name), lambda p: F.transform(F.filter(p["lines"], lambda x: x.rlike(mark)), lambda x: F.regexp_replace(x, mark, ""))))
    each = F.array(*[F.struct(F.lit(h.lower()).alias("quadrant"), items(h.lower()).alias("items")) for h in headings])
    return parts.select("doc_id", F.explode(each).alias("q")).select("doc_id", "q.*").where(F.size("items") > 0)


def observation(text: Column) -> Column:
    """The running text under the observation's heading, lines joined by spaces."""
    parts = F.filter(_parts_of(text, [*HEADINGS, OBSERVATION]), lambda p: p["name"] == OBSERVATION.lower())
    said = F.flatten(F.transform(parts, lambda p: F.concat(F.array(p["rest"]), F.transform(p["lines"], lambda x: F.trim(x)))))
    return F.array_join(F.filter(said, lambda x: x != ""), " ")


def four_part_brief(text: Column, headings: Sequence[str] = HEADINGS) -> Column:
    """A text's lines as bullets under the headings: the first share of the lines under the first one, and so on."""
    parts = len(headings)

    def brief(lines: Column) -> Column:
        blocks = []
        for i, heading in enumerate(headings):
            start, end = (F.floor(F.size(lines) * j / parts).cast("int") for j in (i, i + 1))
            blocks += [F.array(F.lit(f"### {heading}")), F.transform(F.slice(lines, start + 1, end - start), lambda line: F.concat(F.lit("- "), line))]
        return F.array_join(F.concat(*blocks), "\n")

    return T.bound(F.split(text, "\n"), brief)


@register("swot_quadrants", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), q AS (SELECT doc_id, l, len(l) AS n, unnest(['strengths', 'weaknesses', 'opportunities', 'threats']) AS quadrant, unnest([0, 1, 2, 3]) AS i FROM l),
s AS (SELECT doc_id, quadrant, list_transform(l[n * i // 4 + 1 : n * (i + 1) // 4], lambda x: regexp_replace('- ' || x, '^\s*[-*•]\s+', '')) AS items FROM q) SELECT doc_id, quadrant, CAST(len(items) AS INTEGER) AS n, md5(array_to_string(items, '|')) AS digest FROM s WHERE len(items) > 0""")
def quadrants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of each document as a four-part brief, then parsed again."""
    docs = _docs(spark, sf_dir).select("doc_id", four_part_brief(F.col("text")).alias("text"))
    return quadrants(docs).select("doc_id", "quadrant", F.size("items").alias("n"), F.md5(F.array_join("items", "|")).alias("digest"))
