"""Queries over the driver's tables, one per operator, with DuckDB SQL for the same rows.

A document stands for a unit where an operator takes units and segmentation is not what is shown:
unit_id is the doc_id as text, document_name the source. Questions are the benchmark items, answers
are the assistants' turns, samples are the events.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cleaning
from ..functions import text as T
from ..functions import words as W
from ..operators import context, contract, evaluate, lifecycle, metrics, prompt, retrieval, segment, validate
from ..sources import corpus
from ..streaming import sessions, telemetry
from . import ask as ask_plan
from .keep import keep, shared_dir

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select(
        "doc_id", F.col("doc_id").cast("string").alias("unit_id"), F.lit(0).alias("ordinal"), F.col("source").alias("document_name"), F.lit("paragraph").alias("kind"), "text",
        F.array().cast("array<string>").alias("section_path"), T.token_count(F.col("text")).alias("token_estimate"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), F.lit(0).alias("heading_level"),
    )


# -- SQL building blocks -----------------------------------------------------------------


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_any(text: str, markers) -> str:
    return "(" + " OR ".join(f"contains({text}, '{m.replace(chr(39), chr(39) * 2)}')" for m in markers) + ")"


def sql_words(text: str) -> str:
    bare = f"regexp_replace(lower({text}), '(^|[^\\p{{L}}\\p{{N}}_])([cdjlmnstqu]|qu|jusqu|lorsqu|puisqu)[''’]', '\\1 ', 'g')"
    return f"regexp_extract_all(strip_accents({bare}), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_''’-]*')"


def sql_content(text: str) -> str:
    cases = " ".join(f"WHEN ends_with(w, '{e}') AND length(w) > {len(e) + 2} THEN left(w, length(w) - {len(e)})" for e in W.ENCLITICS)
    return f"list_filter(list_transform({sql_words(text)}, lambda w: CASE {cases} ELSE w END), lambda w: length(w) > 1 AND NOT list_contains({sql_list(W.STOP_WORDS)}, w))"


def sql_tokens(text: str) -> str:
    words = f"len(regexp_extract_all({text}, '[^\\s\\v]+'))"
    return f"CASE WHEN length({text}) = 0 THEN 0 ELSE greatest(1, CAST(ceil(greatest(length({text}) / 3.6::DOUBLE, {words} * 1.32::DOUBLE)) AS INTEGER)) END"


def sql_grams(w: str, n: int) -> str:
    runs = f"list_transform(range(0, greatest(len({w}) - {n - 1}, 1)), lambda i: array_to_string(list_slice({w}, i + 1, i + {n}), chr(31)))"
    return f"CASE WHEN len({w}) = 0 THEN []::VARCHAR[] WHEN len({w}) < {n} THEN [array_to_string({w}, chr(31))] ELSE list_distinct({runs}) END"


def sql_sentences(text: str) -> str:
    marked = f"regexp_replace(regexp_replace({text}, '([.!?;:])\\s+', '\\1' || chr(30), 'g'), '\\n{{2,}}', chr(30), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(30)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


def sql_truncate(limit: int) -> str:
    """CTEs from docs_(doc_id, text) to truncated(doc_id, head). A sentence costs two tokens at
    least, so no more than limit / 2 can be kept."""
    head = f"left(text, greatest(1, floor(length(text) * ({limit} / greatest(1, n)::DOUBLE))::INT))"
    return f"""
    parted_ AS (SELECT doc_id, text, {sql_tokens('text')} AS n, list_slice({sql_sentences('text')}, 1, {limit}) AS s FROM docs_),
    priced_ AS (SELECT *, list_transform(s, lambda x: {sql_tokens('x')} + 1) AS c FROM parted_),
    fitted_ AS (SELECT *, len(list_filter(range(1, len(c) + 1), lambda i: list_sum(list_slice(c, 1, i)) <= {limit})) AS fit FROM priced_),
    truncated AS (SELECT doc_id, CASE WHEN n <= {limit} THEN text WHEN fit > 0 THEN array_to_string(list_slice(s, 1, fit), ' ') ELSE regexp_replace({head}, ' [^ ]*$', '') END AS head FROM fitted_)
    """


def sql_jaccard(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 "
        f"ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    )


BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
TERMS = f"terms AS MATERIALIZED (SELECT doc_id, source, text, {sql_content('text')} AS w FROM documents)"
ASKED = f"asked AS MATERIALIZED (SELECT item_id AS question_id, text AS question, list_distinct({sql_content('text')}) AS terms FROM benchmark)"
BM25 = f"""
    {TERMS}, {ASKED},
    post AS MATERIALIZED (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM terms) GROUP BY doc_id, term),
    freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    size AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM terms),
    lexical AS MATERIALIZED (
      SELECT q.question_id, p.doc_id::VARCHAR AS unit_id, p.doc_id,
             sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (1 - 0.72 + 0.72 * dl / avgdl))) AS lexical
      FROM (SELECT question_id, unnest(terms) AS term FROM asked) q JOIN post p USING (term) JOIN freq USING (term) CROSS JOIN size
      GROUP BY 1, 2, 3)
"""
PHRASES = "list_filter(regexp_split_to_array(lower(question), '[^\\p{L}\\p{N}_]+'), lambda t: t <> '')"
NUMERIC = W.NUMERIC_QUESTION.replace("(?i)", "(?i)")
TOTALS = f"""
    {BM25},
    phrased AS (SELECT question_id, question, terms, {PHRASES} AS p FROM asked),
    boosted AS MATERIALIZED (
      SELECT l.question_id, l.unit_id, l.lexical,
             round((CASE WHEN len(list_intersect({sql_content("replace(t.source, '_', ' ')")}, q.terms)) > 0 THEN 0.10 ELSE 0 END)
             + (CASE WHEN len(q.p) >= 3 AND len(list_filter(list_transform(range(0, greatest(len(q.p) - 2, 1)), lambda i: array_to_string(list_slice(q.p, i + 1, i + 3), ' ')), lambda x: contains(lower(t.text), x))) > 0 THEN 0.18 ELSE 0 END)
             + (CASE WHEN regexp_matches(q.question, '{NUMERIC}') AND regexp_matches(t.text, '[0-9]') THEN 0.12 ELSE 0 END), 6)::DOUBLE AS boost
      FROM lexical l JOIN terms t USING (doc_id) JOIN phrased q USING (question_id))
"""


# -- T: text ----------------------------------------------------------------------------


@query(
    "text_normalize",
    r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' '), chr(65279), ''),
        '[\x00-\x08\x0e-\x1f\x7f]', '', 'g'), '[ \t\v\f]+', ' ', 'g'), ' +(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))) AS normal_sha FROM documents""",
)
def text_normalize(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.sha(T.normalize(F.col("text"))).alias("normal_sha"))


@query("text_fold", "SELECT doc_id, sha256(strip_accents(text)) AS folded_sha FROM documents")
def text_fold(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.sha(T.fold(F.col("text"))).alias("folded_sha"))


@query("text_words", f"WITH t AS (SELECT doc_id, {sql_words('text')} AS w FROM documents) SELECT doc_id, len(w) AS n_words, sha256(array_to_string(w, ' ')) AS words_sha FROM t")
def text_words(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").alias("n_words"), T.sha(F.array_join("w", " ")).alias("words_sha"))


@query("text_content_words", f"WITH {TERMS} SELECT doc_id, len(w) AS n_words, sha256(array_to_string(w, ' ')) AS words_sha FROM terms")
def text_content_words(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", T.content_words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").alias("n_words"), T.sha(F.array_join("w", " ")).alias("words_sha"))


@query("text_sentences", f"WITH t AS (SELECT doc_id, {sql_sentences('text')} AS s FROM documents) SELECT doc_id, len(s) AS n_sentences, sha256(array_to_string(s, '|')) AS sentences_sha FROM t")
def text_sentences(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("n_sentences"), T.sha(F.array_join("s", "|")).alias("sentences_sha"))


@query("text_shingles", f"WITH {TERMS}, g AS (SELECT doc_id, {sql_grams('w', 4)} AS g FROM terms) SELECT doc_id, len(g) AS n_shingles, sha256(array_to_string(list_sort(g), '|')) AS shingles_sha FROM g")
def text_shingles(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", T.shingles(F.col("text")).alias("g"))
    return d.select("doc_id", F.size("g").alias("n_shingles"), T.sha(F.array_join(F.sort_array("g"), "|")).alias("shingles_sha"))


@query(
    "text_jaccard",
    f"""WITH {TERMS}, g AS (SELECT doc_id, {sql_grams('w', 4)} AS g FROM terms)
        SELECT a.doc_id, round({sql_jaccard('a.g', 'b.g')}, 6)::DOUBLE AS jaccard FROM g a JOIN g b ON b.doc_id = a.doc_id + 1""",
)
def text_jaccard(spark, sf_dir):
    g = documents(spark, sf_dir).select("doc_id", T.shingles(F.col("text")).alias("g"))
    b = g.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h"))
    return g.join(b, "doc_id").select("doc_id", F.round(T.jaccard(F.col("g"), F.col("h")), 6).alias("jaccard"))


@query("text_token_count", f"SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents")
def text_token_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("text_truncate", f"WITH docs_ AS (SELECT doc_id, text FROM documents), {sql_truncate(60)} SELECT doc_id, head FROM truncated")
def text_truncate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.truncate_to_tokens(F.col("text"), 60).alias("head"))


@query(
    "text_numeric_signature",
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[0-9][0-9\s.,%]*'), lambda x: trim(x, ' .,') <> ''),
        lambda x: replace(rtrim(replace(x, ' ', ''), '.,'), ',', '.')))), '|') AS figures FROM documents""",
)
def text_numeric_signature(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.numeric_signature(F.col("text")), "|").alias("figures"))


@query(
    "text_language",
    f"""WITH t AS (SELECT doc_id, {sql_words('left(text, 4000)')} AS w FROM documents),
        c AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains({sql_list(W.FRENCH_MARKERS)}, x))) AS fr, len(list_filter(w, lambda x: list_contains({sql_list(W.ENGLISH_MARKERS)}, x))) AS en FROM t)
        SELECT doc_id, CASE WHEN fr = en THEN 'und' WHEN fr > en THEN 'fr' ELSE 'en' END AS language FROM c""",
)
def text_language(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query(
    "text_identity",
    """SELECT doc_id, left(sha256(text), 12) AS short_sha, 'unit_' || left(sha256(array_to_string(['SemanticUnit', doc_id::VARCHAR, source], chr(31))), 16) AS artifact_id,
       left(sha256(doc_id::VARCHAR || ':' || source), 24) AS document_id, '{"lang":"' || lang || '","source":"' || source || '"}' AS canonical FROM documents""",
)
def text_identity(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    return documents(spark, sf_dir).select(
        "doc_id",
        T.sha(F.col("text"), 12).alias("short_sha"),
        T.artifact_id("unit", "SemanticUnit", key, F.col("source")).alias("artifact_id"),
        T.document_id(key, F.col("source")).alias("document_id"),
        T.canonical_json({"source": F.col("source"), "lang": F.col("lang")}).alias("canonical"),
    )


@query(
    "text_phrases",
    f"WITH p AS (SELECT item_id, {PHRASES.replace('question', 'text')} AS p FROM benchmark) SELECT item_id, CASE WHEN len(p) < 3 THEN '' ELSE array_to_string(list_transform(range(0, greatest(len(p) - 2, 1)), lambda i: array_to_string(list_slice(p, i + 1, i + 3), ' ')), '|') END AS phrases FROM p",
)
def text_phrases(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.phrases(F.col("text")), "|").alias("phrases"))


CITED = "text || CASE WHEN turn % 2 = 1 THEN ' [S2] and [S10], again [S2].' ELSE '' END"


@query(
    "text_answer_marks",
    f"""WITH t AS (SELECT conv_id, turn, {CITED} AS a FROM conversations)
        SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(a, '\\[(S[0-9]+)\\]', 1))), ',') AS cited, length(regexp_replace(a, '\\[(S[0-9]+)\\]', '', 'g')) AS bare_chars,
               {sql_any('lower(a)', W.INSUFFICIENT_MARKERS)} AS declined, {sql_any('lower(a)', W.HEDGE_MARKERS)} AS hedged, {sql_any("(' ' || lower(a) || ' ')", W.FRENCH_QUESTION)} AS french,
               (trim(a) <> '' AND NOT regexp_matches(trim(a), '[.!?"'')\\]}}»’]$')) AS cut_off FROM t""",
)
def text_answer_marks(spark, sf_dir):
    a = F.concat("text", F.when(F.col("turn") % 2 == 1, " [S2] and [S10], again [S2].").otherwise(""))
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", a.alias("a"))
    x = F.col("a")
    return c.select(
        "conv_id", "turn", F.array_join(T.citations(x), ",").alias("cited"), F.length(T.strip_citations(x)).alias("bare_chars"), T.declares_insufficient(x).alias("declined"),
        T.hedges(x).alias("hedged"), T.looks_french(x).alias("french"), cleaning.looks_truncated(x).alias("cut_off"),
    )


def _cleaned_sql() -> str:
    banners = "|".join(re.escape(b).replace("\\ ", " ").replace("/", "/") for b in cleaning.BANNERS)
    blocks = "t2"
    for opener, closer in cleaning.REASONING:
        blocks = f"regexp_replace({blocks}, '(?ims){opener}(.*?({closer})|.*)', '', 'g')"
    final = cleaning.FINAL.replace("(?:", "(")
    return f"""
    WITH raw AS (SELECT conv_id, turn, 'Loading model...' || chr(10) || chr(10) || '> ' || CASE WHEN turn % 3 = 1 THEN '<think>a thought</think>' || chr(10) ELSE '' END || text || chr(10) || 'Exiting...' AS t FROM conversations WHERE role = 'assistant'),
    a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '(?is)^.*({banners})[^\\n]*\\n?', ''), '^([ \\t]*(/[^\\n]*)?\\n)+', ''), '^[ \\t]*>+[ \\t]*', '') AS t1 FROM raw),
    c AS (SELECT *, trim(regexp_replace(t1, '{cleaning.NOISE}', '', 'g'), {BLANKS}) AS t2 FROM a),
    d AS (SELECT *, trim({blocks}, {BLANKS}) AS t3 FROM c),
    e AS (SELECT *, trim(regexp_extract(t3, '(?is)^.*{final}(.*)$', 4), {BLANKS}) AS tail FROM d),
    f AS (SELECT *, CASE WHEN length(tail) >= 8 THEN tail ELSE t3 END AS answer FROM e)
    SELECT conv_id, turn, answer, array_to_string(list_filter(['scaffolding', CASE WHEN t2 <> t3 THEN 'reasoning' END, CASE WHEN t2 <> t3 AND t3 = '' THEN 'only reasoning' END, CASE WHEN answer <> t3 THEN 'final answer' END,
           CASE WHEN answer <> '' AND NOT regexp_matches(answer, '[.!?"'')\\]}}»’]$') THEN 'truncated' END], lambda x: x IS NOT NULL), ',') AS notes FROM f
    """


@query("text_clean_generation", _cleaned_sql())
def text_clean_generation(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    raw = F.concat(F.lit("Loading model...\n\n> "), F.when(F.col("turn") % 3 == 1, "<think>a thought</think>\n").otherwise(""), "text", F.lit("\nExiting..."))
    return c.select("conv_id", "turn", cleaning.clean_generation(raw).alias("c")).select("conv_id", "turn", F.col("c.text").alias("answer"), F.array_join("c.notes", ",").alias("notes"))


@query(
    "parameter_estimates",
    """SELECT p_partkey, round(p_size::BIGINT * 100000000 / (CASE p_size % 3 WHEN 0 THEN 0.58 WHEN 1 THEN 1.06 ELSE NULL END)::DOUBLE / 1e9, 2)::DOUBLE AS implied FROM part""",
)
def parameter_estimates(spark, sf_dir):
    kind = F.when(F.col("p_size") % 3 == 0, "q4_0").when(F.col("p_size") % 3 == 1, "Q8").otherwise("zz")
    return read(spark, sf_dir, "part").select("p_partkey", cleaning.estimated_parameters(F.col("p_size").cast("long") * 100000000, kind).alias("implied"))


# -- S, D: sources and segmentation ------------------------------------------------------


@query("corpus_profile", f"SELECT lang, count(*) AS documents, sum({sql_tokens('text')})::BIGINT AS tokens, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def corpus_profile(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("documents"), F.sum(T.token_count(F.col("text"))).alias("tokens"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("min_text_filter", "SELECT doc_id FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10))) >= 40")
def min_text_filter(spark, sf_dir):
    return documents(spark, sf_dir).where(F.length(T.strip(F.col("text"))) >= 40).select("doc_id")


@query("latest_by_key", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_by_key(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return corpus.latest_by(e, "user_id", "at").select("user_id", "event_id")


def stored(spark, sf_dir) -> corpus.CorpusStore:
    """A store in the shared folder, written, upserted and deleted from as `upsert_documents` says."""
    store = corpus.CorpusStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=16)
    d = documents(spark, sf_dir).select("doc_id", "source")
    u = document_units(spark, sf_dir).select("doc_id", "ordinal", "unit_id", "token_estimate", T.sha(F.col("text")).alias("checksum"))
    store.upsert(d, u, "doc_id")
    fifth = d.where("doc_id % 5 = 0").withColumn("source", F.upper("source"))
    store.upsert(fifth, u.join(fifth, "doc_id", "left_semi").withColumn("token_estimate", F.col("token_estimate") + 1), "doc_id")
    store.delete(d.where("doc_id % 7 = 3"), "doc_id")
    return store


@query("upsert_documents", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(source) ELSE source END AS source FROM documents WHERE doc_id % 7 <> 3")
def upsert_documents(spark, sf_dir):
    """Fresh rows replace old ones by id, deleted ids go."""
    return stored(spark, sf_dir).documents("doc_id")


@query("store_units", f"SELECT doc_id, 0 AS ordinal, doc_id::VARCHAR AS unit_id, {sql_tokens('text')} + (doc_id % 5 = 0)::INTEGER AS token_estimate, sha256(text) AS checksum FROM documents WHERE doc_id % 7 <> 3")
def store_units(spark, sf_dir):
    """The units follow their documents."""
    return stored(spark, sf_dir).units(key="doc_id")


@query("source_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(spark, sf_dir):
    """From a store of all documents."""
    store = corpus.CorpusStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    d = documents(spark, sf_dir).select("doc_id", "source")
    store.upsert(d, d.withColumn("ordinal", F.lit(0)), "doc_id")
    return store.documents("doc_id").groupBy("source").agg(F.count("*").alias("n"))


@query("store_counts", "SELECT 0 AS step, count(*) AS documents, count(*) AS units FROM documents WHERE doc_id % 7 <> 3 UNION ALL SELECT 1, 0, 0")
def store_counts(spark, sf_dir):
    """Before and after the store is cleared."""
    store = stored(spark, sf_dir)
    before = keep(store.counts().withColumn("step", F.lit(0)))
    store.clear()
    return before.unionByName(store.counts().withColumn("step", F.lit(1)))


@query(
    "store_snapshot",
    f"SELECT count(*) AS documents, count(*) AS units, sum({sql_tokens('text')} + (doc_id % 5 = 0)::INTEGER)::BIGINT AS tokens, sha256(string_agg(sha256(text), '|' ORDER BY doc_id)) AS corpus_checksum FROM documents WHERE doc_id % 7 <> 3",
)
def store_snapshot(spark, sf_dir):
    """The snapshot of the store's state; the second call reads what the first one wrote."""
    store = stored(spark, sf_dir)
    store.snapshot("doc_id")
    return store.snapshot("doc_id").select("documents", F.col("units").cast("long"), F.col("tokens").cast("long"), "corpus_checksum")


@query(
    "session_log",
    """WITH e AS (SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY user_id)
       SELECT user_id AS session_id, CASE WHEN user_id % 5 = 0 THEN 'again' ELSE 'first' END AS profile_id, CASE WHEN user_id % 5 = 0 THEN last ELSE first END AS created_at,
              CASE WHEN bought AND user_id % 5 <> 0 THEN last END AS closed_at, CASE WHEN bought AND user_id % 5 <> 0 THEN n END AS requests FROM e""",
)
def session_log(spark, sf_dir):
    """Sessions opened, closed, and some of them opened anew; one log is compacted in between."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    e = keep(e.withColumnRenamed("user_id", "session_id").withColumns({c: F.col(c).cast("timestamp") for c in ("first", "last")}))
    store = corpus.CorpusStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.open_sessions(e.select("session_id", F.lit("first").alias("profile_id"), F.col("first").alias("created_at")))
    store.close_sessions(e.where("bought").select("session_id", F.col("last").alias("closed_at"), F.col("n").alias("requests")))
    store.compact_sessions()
    store.open_sessions(e.where("session_id % 5 = 0").select("session_id", F.lit("again").alias("profile_id"), F.col("last").alias("created_at")))
    out = store.sessions()
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "closed_at")})


@query("corpus_snapshot", f"""SELECT count(*) AS documents, count(*) AS units, sum({sql_tokens('text')})::BIGINT AS tokens, sha256(string_agg(sha256(text), '|' ORDER BY doc_id)) AS corpus_checksum FROM documents""")
def corpus_snapshot(spark, sf_dir):
    u = document_units(spark, sf_dir).withColumn("checksum", T.sha(F.col("text"))).withColumn("document_id", F.col("doc_id"))
    return corpus.snapshot(u).select("documents", F.col("units").cast("long"), F.col("tokens").cast("long"), "corpus_checksum")


def headed(spark, sf_dir) -> DataFrame:
    """Whole documents with headings, tables and blank lines added by line number; no line is cut."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 7 == 3, F.array(F.concat(F.lit("## "), F.substring(x, 1, 30)), x))
        .when(i % 11 == 5, F.array(F.concat(F.lit("| "), F.substring(x, 1, 40), F.lit(" |")), x))
        .when(i % 13 == 8, F.array(F.concat(F.lit("- "), x)))
        .when(i % 17 == 9, F.array(F.lit(""), x))
        .otherwise(F.array(x)),
    )
    return documents(spark, sf_dir).withColumn("text", F.array_join(F.flatten(lines), "\n"))


_LINES = r"""
    added AS (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN (i - 1) % 7 = 3 THEN ['## ' || left(l, 30), l] WHEN (i - 1) % 11 = 5 THEN ['| ' || left(l, 40) || ' |', l]
              WHEN (i - 1) % 13 = 8 THEN ['- ' || l] WHEN (i - 1) % 17 = 9 THEN ['', l] ELSE [l] END)) AS ls FROM documents),
    lined AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n FROM added),
    parted AS (SELECT *, trim(line) AS body, coalesce(lead(line) OVER w, '') AS following,
               coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
               lead(n) OVER w IS NULL AS last FROM lined WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    kinds AS (SELECT *, CASE WHEN body = '' THEN 'blank'
                WHEN regexp_matches(line, '^#{1,6}\s+.*\S\s*$') THEN 'heading'
                WHEN regexp_matches(body, '^((\d+\.){1,4}|\d+\))\s+(\S.{0,110})$') AND length(body) <= 110 AND NOT regexp_matches(body, '[.;,]$') AND (trim(following) <> '' OR len(regexp_extract_all(body, '\S+')) <= 12) THEN 'heading'
                WHEN length(body) BETWEEN 3 AND 90 AND NOT ends_with(body, '.') AND len(regexp_extract_all(body, '\p{L}')) >= 3 AND NOT regexp_matches(regexp_replace(body, '[^\p{L}]', '', 'g'), '[^\p{Lu}]') AND len(regexp_extract_all(body, '\S+')) <= 10 THEN 'heading'
                WHEN regexp_matches(line, '^\s*\|.*\|\s*$') THEN 'table'
                WHEN regexp_matches(line, '^\s{0,6}([-*•‣●]|\d+[.)])\s+\S') THEN 'list' ELSE 'paragraph' END AS kind FROM parted),
    marked AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR kind = 'heading' OR kind <> lag(kind) OVER w THEN 1 ELSE 0 END AS fresh, lead(start) OVER w AS next_start FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM marked)
"""


@query(
    "segment_blocks",
    f"""WITH {_LINES},
        b AS (SELECT doc_id, g, any_value(kind) AS kind, min(start)::INTEGER AS char_start,
              trim(string_agg(CASE WHEN kind = 'heading' AND starts_with(line, '#') THEN regexp_extract(line, '^#{{1,6}}\\s+(.*\\S)\\s*$', 1) WHEN kind = 'heading' THEN body ELSE line END, chr(10) ORDER BY n), ' ' || chr(10)) AS text,
              arg_max(CASE WHEN kind = 'heading' OR last THEN start + length(line) ELSE next_start END, n)::INTEGER AS char_end
              FROM runs WHERE kind <> 'blank' GROUP BY doc_id, g)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS block, kind, sha256(text) AS text_sha, char_start, char_end FROM b WHERE text <> ''""",
)
def segment_blocks(spark, sf_dir):
    b = segment.blocks(headed(spark, sf_dir))
    return b.select("doc_id", F.col("block").cast("long").alias("block"), "kind", T.sha(F.col("text")).alias("text_sha"), "char_start", "char_end")


def fenced(spark, sf_dir) -> DataFrame:
    """Whole documents with code fences (one of them never closed), underlined and numbered headings added by line number."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 9 == 4, F.array(F.lit("```"), x, F.lit("# no heading"), F.lit("  ```")))
        .when(i % 14 == 6, F.array(F.substring(x, 1, 30), F.lit("====="), x))
        .when(i % 14 == 9, F.array(F.substring(x, 1, 30), F.lit("---"), F.lit("---"), x))
        .when(i % 23 == 10, F.array(F.concat(F.lit("1.2. "), F.substring(x, 1, 20)), x))
        .when(i == 40, F.array(F.lit("~~~"), x))
        .otherwise(F.array(x)),
    )
    return documents(spark, sf_dir).withColumn("text", F.array_join(F.flatten(lines), "\n"))


@query(
    "segment_fenced",
    r"""WITH added AS (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN (i - 1) % 9 = 4 THEN ['```', l, '# no heading', '  ```'] WHEN (i - 1) % 14 = 6 THEN [left(l, 30), '=====', l]
              WHEN (i - 1) % 14 = 9 THEN [left(l, 30), '---', '---', l] WHEN (i - 1) % 23 = 10 THEN ['1.2. ' || left(l, 20), l] WHEN i = 41 THEN ['~~~', l] ELSE [l] END)) AS ls FROM documents),
        lined AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n, length(array_to_string(ls, chr(10))) AS text_end FROM added),
        a AS (SELECT *, trim(line) AS body, coalesce(lead(line) OVER w, '') AS following, regexp_matches(line, '^\s*(```|~~~)')::INT AS fence, regexp_matches(line, '^#{1,6}\s+.*\S\s*$') AS atx,
              coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lined WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
        b AS (SELECT *, sum(fence) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM a),
        c AS (SELECT *, fences % 2 = 1 OR fence = 1 AS code FROM b),
        d AS (SELECT *, NOT code AND body <> '' AND NOT atx AND length(body) <= 120 AND regexp_matches(following, '^(=+|-+)\s*$') AS may FROM c),
        e AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, may ORDER BY n) AS stretch FROM d),
        f AS (SELECT *, may AND row_number() OVER (PARTITION BY doc_id, may, stretch ORDER BY n) % 2 = 1 AS under FROM e),
        g AS (SELECT *, coalesce(lag(under) OVER (PARTITION BY doc_id ORDER BY n), false) AS consumed,
              regexp_matches(body, '^((\d+\.){1,4}|\d+\))\s+(\S.{0,110})$') AND length(body) <= 110 AND NOT regexp_matches(body, '[.;,]$') AND (trim(following) <> '' OR len(regexp_extract_all(body, '\S+')) <= 12) AS numbered,
              length(body) BETWEEN 3 AND 90 AND NOT ends_with(body, '.') AND len(regexp_extract_all(body, '\p{L}')) >= 3 AND NOT regexp_matches(regexp_replace(body, '[^\p{L}]', '', 'g'), '[^\p{Lu}]') AND len(regexp_extract_all(body, '\S+')) <= 10 AS caps FROM f),
        h AS (SELECT *, CASE WHEN code THEN 'code' WHEN body = '' THEN 'blank' WHEN atx OR under OR numbered OR caps THEN 'heading' WHEN regexp_matches(line, '^\s*\|.*\|\s*$') THEN 'table'
              WHEN regexp_matches(line, '^\s{0,6}([-*•‣●]|\d+[.)])\s+\S') THEN 'list' ELSE 'paragraph' END AS kind, CASE WHEN code THEN (fences + 1) // 2 END AS region FROM g WHERE NOT consumed),
        i AS (SELECT *, CASE WHEN kind <> 'heading' THEN 0 WHEN atx THEN length(regexp_extract(line, '^(#{1,6})', 1)) WHEN under THEN CASE WHEN starts_with(trim(following), '=') THEN 1 ELSE 2 END
              WHEN numbered THEN least(6, 1 + len(regexp_extract_all(regexp_extract(body, '^\S+'), '\.'))) ELSE 2 END AS level,
              (lag(kind) OVER w IS NULL OR kind = 'heading' OR kind <> lag(kind) OVER w OR region IS DISTINCT FROM lag(region) OVER w)::INT AS fresh, lead(start) OVER w AS next_start FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
        j AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM i),
        k AS (SELECT doc_id, grp, any_value(kind) AS kind, max(level) AS level, min(start)::INTEGER AS char_start,
              trim(string_agg(CASE WHEN kind = 'heading' AND atx THEN regexp_extract(line, '^#{1,6}\s+(.*\S)\s*$', 1) WHEN kind = 'heading' THEN body ELSE line END, chr(10) ORDER BY n), ' ' || chr(10)) AS text,
              arg_max(CASE WHEN kind = 'heading' OR (fence = 1 AND fences % 2 = 0) THEN start + length(line) WHEN next_start IS NULL THEN text_end ELSE next_start END, n)::INTEGER AS char_end FROM j WHERE kind <> 'blank' GROUP BY doc_id, grp)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS block, kind, level::INTEGER AS level, sha256(text) AS text_sha, char_start, char_end FROM k WHERE text <> ''""",
)
def segment_fenced(spark, sf_dir):
    b = segment.blocks(fenced(spark, sf_dir))
    return b.select("doc_id", F.col("block").cast("long").alias("block"), "kind", "level", T.sha(F.col("text")).alias("text_sha"), "char_start", "char_end")


# packing block by block: a stack of headings, runs of blocks, pieces of long runs, small pieces folded
_PACKED = f"""
    {_LINES},
    levels AS (SELECT *, CASE WHEN kind <> 'heading' THEN 0 WHEN starts_with(line, '#') THEN length(regexp_extract(line, '^(#{{1,6}})\\s', 1))
               WHEN regexp_matches(body, '^((\\d+\\.){{1,4}}|\\d+\\))\\s+(\\S.{{0,110}})$') THEN least(6, 1 + len(regexp_extract_all(regexp_extract(body, '^\\S+'), '\\.'))) ELSE 2 END AS level FROM runs),
    grouped AS (SELECT doc_id, g, any_value(kind) AS kind, min(start)::INTEGER AS char_start, max(level) AS level,
              trim(string_agg(CASE WHEN kind = 'heading' AND starts_with(line, '#') THEN regexp_extract(line, '^#{{1,6}}\\s+(.*\\S)\\s*$', 1) WHEN kind = 'heading' THEN body ELSE line END, chr(10) ORDER BY n), ' ' || chr(10)) AS text,
              arg_max(CASE WHEN kind = 'heading' OR last THEN start + length(line) ELSE next_start END, n)::INTEGER AS char_end
              FROM levels WHERE kind <> 'blank' GROUP BY doc_id, g),
    b AS MATERIALIZED (SELECT *, row_number() OVER w AS block, sum((kind = 'heading')::INT) OVER w AS section FROM grouped WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY g)),
    stack AS (SELECT doc_id, section, [text] AS path FROM b WHERE kind = 'heading' AND section = 1 UNION ALL
              SELECT b.doc_id, b.section, list_append(list_slice(path, 1, greatest(1, b.level) - 1), b.text) FROM stack s JOIN b ON b.doc_id = s.doc_id AND b.section = s.section + 1 AND b.kind = 'heading'),
    bodies AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS i, length(text) AS c, len(regexp_extract_all(text, '[^\\s\\v]+')) AS w FROM b WHERE kind <> 'heading'),
    gathered AS (SELECT doc_id, i, section, c::BIGINT AS chars, w::BIGINT AS words, 1 AS run FROM bodies WHERE i = 1 UNION ALL
              SELECT doc_id, i, section, CASE WHEN j THEN chars + 2 + c ELSE c END, CASE WHEN j THEN words + w ELSE w END, run + (NOT j)::INT
              FROM (SELECT x.*, chars, words, run, x.section = g.section AND ceil(greatest(chars / 3.6::DOUBLE, words * 1.32::DOUBLE)) < 90 AS j FROM gathered g JOIN bodies x ON x.doc_id = g.doc_id AND x.i = g.i + 1)),
    whole AS MATERIALIZED (SELECT doc_id, run, any_value(section) AS section, min(block) AS block, arg_min(kind, block) AS kind, arg_min(char_start, block) AS char_start, arg_min(char_end, block) AS char_end,
              trim(string_agg(text, chr(10) || chr(10) ORDER BY block), {BLANKS}) AS text FROM gathered JOIN bodies USING (doc_id, i, section) GROUP BY doc_id, run),
    long AS MATERIALIZED (SELECT doc_id, run, {sql_sentences('text')} AS s FROM whole WHERE {sql_tokens('text')} > 320),
    priced AS MATERIALIZED (SELECT doc_id, run, unnest(s) AS s, unnest(list_transform(s, lambda x: {sql_tokens('x')})) AS cost, generate_subscripts(s, 1) AS k FROM long),
    halved AS (SELECT doc_id, run, k, cost::BIGINT AS used, 1 AS piece FROM priced WHERE k = 1 UNION ALL
              SELECT p.doc_id, p.run, p.k, CASE WHEN used + cost > 180 THEN cost ELSE used + cost END, piece + (used + cost > 180)::INT FROM halved h JOIN priced p ON p.doc_id = h.doc_id AND p.run = h.run AND p.k = h.k + 1),
    pieces AS (SELECT doc_id, run, piece, string_agg(s, ' ' ORDER BY k) AS text FROM halved JOIN priced USING (doc_id, run, k) GROUP BY 1, 2, 3 UNION ALL
              SELECT doc_id, run, 1, text FROM whole WHERE NOT ({sql_tokens('text')} > 320)),
    placed AS (SELECT p.*, w.kind, w.char_start, w.char_end, coalesce(path, []) AS path, lag(coalesce(path, [])) OVER (PARTITION BY p.doc_id ORDER BY p.run, piece) AS before
              FROM pieces p JOIN whole w USING (doc_id, run) LEFT JOIN stack s ON s.doc_id = p.doc_id AND s.section = w.section),
    folded AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND before = path AND {sql_tokens('text')} < 24 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY run, piece) - 1 AS ordinal FROM placed),
    units_ AS MATERIALIZED (SELECT doc_id, ordinal::INTEGER AS ordinal, doc_id || '#' || CASE WHEN ordinal < 10000 THEN lpad(ordinal::INTEGER::VARCHAR, 4, '0') ELSE ordinal::INTEGER::VARCHAR END AS unit_id, arg_min(kind, run * 10000 + piece) AS kind,
              arg_min(path, run * 10000 + piece) AS path, string_agg(text, chr(10) ORDER BY run, piece) AS text, arg_min(char_start, run * 10000 + piece) AS char_start, arg_max(char_end, run * 10000 + piece) AS char_end FROM folded GROUP BY doc_id, ordinal)
"""


@query(
    "segment_units",
    f"""WITH RECURSIVE {_PACKED} SELECT doc_id, unit_id, ordinal, kind, array_to_string(path, ' > ') AS section_path, {sql_tokens('text')} AS token_estimate, char_start, char_end, sha256(text) AS text_sha FROM units_""",
)
def segment_units(spark, sf_dir):
    return segment.units(headed(spark, sf_dir)).select("doc_id", "unit_id", "ordinal", "kind", F.array_join("section_path", " > ").alias("section_path"), "token_estimate", "char_start", "char_end", T.sha(F.col("text")).alias("text_sha"))


@query(
    "document_facts",
    f"""WITH RECURSIVE {_PACKED},
        w AS (SELECT doc_id, source, {sql_words('left(text, 4000)')} AS w FROM (SELECT d.doc_id, d.source, array_to_string(ls, chr(10)) AS text FROM documents d JOIN added USING (doc_id))),
        m AS (SELECT *, len(list_filter(w, lambda x: list_contains({sql_list(W.FRENCH_MARKERS)}, x))) AS fr, len(list_filter(w, lambda x: list_contains({sql_list(W.ENGLISH_MARKERS)}, x))) AS en FROM w),
        h AS (SELECT doc_id, arg_min(text, block) AS title, count(*) AS n FROM b WHERE kind = 'heading' GROUP BY doc_id),
        t AS (SELECT doc_id, sum({sql_tokens('text')})::BIGINT AS tokens, count(*) AS units FROM units_ GROUP BY doc_id)
        SELECT m.doc_id, source AS filename, coalesce(title, replace(regexp_replace(source, '\\.[^.]*$', ''), '_', ' ')) AS title, coalesce(n, 0)::INTEGER AS section_titles,
               coalesce(tokens, 0) AS token_estimate, coalesce(units, 0) AS unit_count, CASE WHEN fr = en THEN 'und' WHEN fr > en THEN 'fr' ELSE 'en' END AS language
        FROM m LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def document_facts(spark, sf_dir):
    d = headed(spark, sf_dir)
    b = keep(segment.blocks(d))  # read for headings and for units
    return segment.document_facts(d, b, segment.units(d, block_rows=b)).withColumn("section_titles", F.size("section_titles"))


# -- B, C: intent, budget, compaction ----------------------------------------------------


def _intent_sql() -> str:
    hits = {k: "list_sort(list_filter(" + sql_list(m) + ", lambda m: contains(p, ' ' || m) OR contains(p, m || ' ')))" for k, m in sorted(W.INTENT_MARKERS.items())}
    lists = ", ".join(f"{v} AS {k}" for k, v in hits.items())
    best = "greatest(" + ", ".join(f"len({k})" for k in hits) + ")"
    first = "CASE " + " ".join(f"WHEN best > 0 AND len({k}) = best THEN '{k}'" for k in hits) + " ELSE 'factual' END"
    signals = "CASE " + " ".join(f"WHEN best > 0 AND len({k}) = best THEN array_to_string({k}, ',')" for k in hits) + " ELSE '' END"
    winners = " + ".join(f"(len({k}) = best)::INT" for k in hits)
    return f"""WITH q AS (SELECT conv_id, turn, text, ' ' || trim(lower(text)) || ' ' AS p FROM conversations WHERE role = 'user'), h AS (SELECT *, {lists} FROM q), b AS (SELECT *, {best} AS best FROM h)
        SELECT conv_id, turn, {first} AS intent, CASE WHEN best = 0 THEN 'medium' WHEN best >= 2 OR ({winners}) = 1 THEN 'high' ELSE 'low' END AS confidence, {signals} AS signals,
               array_to_string(list_slice({sql_content('text')}, 1, 24), ' ') AS keywords FROM b"""


@query("intent_classify", _intent_sql())
def intent_classify(spark, sf_dir):
    q = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return context.classify_intent(q).select("conv_id", "turn", "intent", "confidence", F.array_join("signals", ",").alias("signals"), F.array_join("keywords", " ").alias("keywords"))


@query(
    "budget_compute",
    f"""WITH o AS (SELECT event_id, value * 20 AS ram_mb, 60 + value % 40 AS c, value % 110 AS cpu, CASE event_id % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'factual' ELSE 'comparison' END AS intent FROM events),
        f AS (SELECT *, CASE WHEN ram_mb <= 0 THEN 1.0 WHEN ram_mb - 512 <= 0 THEN 0.35 WHEN ram_mb - 512 >= 900 THEN 1.0 ELSE round(greatest(0.35::DOUBLE, 0.35::DOUBLE + 0.65::DOUBLE * ((ram_mb - 512) / 900)), 4) END::DOUBLE AS ram,
              CASE WHEN c < 78 THEN 1.0 WHEN c >= 92 THEN 0.4 ELSE round(greatest(0.4::DOUBLE, 1.0::DOUBLE - 0.6::DOUBLE * ((c - 78) / 14)), 4) END::DOUBLE AS thermal,
              CASE WHEN cpu < 85 THEN 1.0 ELSE round(greatest(0.6::DOUBLE, 1.0::DOUBLE - 0.4::DOUBLE * least(1.0::DOUBLE, (cpu - 85) / 15)), 4) END::DOUBLE AS busy,
              (CASE intent WHEN 'summary' THEN 1.0 WHEN 'factual' THEN 0.55 ELSE 0.9 END)::DOUBLE AS fi, CASE intent WHEN 'summary' THEN 10 WHEN 'factual' THEN 4 ELSE 8 END AS np FROM o),
        b AS (SELECT *, greatest(256, 4096 - 512 - (160 + {sql_tokens("'how many days'")})) AS base, least(ram, thermal, busy) * fi AS mult FROM f)
        SELECT event_id, ram, thermal, busy AS cpu, greatest(256, least(base, floor(base * mult)::INT)) AS evidence_tokens, CASE WHEN mult < 0.5 THEN greatest(2, np // 2) ELSE np END AS max_passages,
               CASE WHEN least(ram, thermal, busy) >= 1 THEN 'model_context' WHEN ram = least(ram, thermal, busy) THEN 'ram' WHEN thermal = least(ram, thermal, busy) THEN 'thermal' ELSE 'cpu' END AS limiting_factor FROM b""",
)
def budget_compute(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "summary").when(F.col("event_id") % 3 == 1, "factual").otherwise("comparison")
    seen = e.select("event_id", F.lit("how many days").alias("question"), (F.col("value") * 20).alias("available_ram_mb"), (60 + F.col("value") % 40).alias("temperature_c"), (F.col("value") % 110).alias("cpu_percent"), kind.alias("intent"))
    return context.budget(seen).select("event_id", "ram", "thermal", "cpu", "evidence_tokens", "max_passages", "limiting_factor")


NOISE_SQL = " OR ".join(f"regexp_matches(trim(text), '(?i){p}')" for p in W.BOILERPLATE)


@query("drop_noise", f"WITH {TERMS} SELECT doc_id FROM terms WHERE NOT ({NOISE_SQL}) AND len(w) >= 4")
def drop_noise(spark, sf_dir):
    return context.drop_noise(document_units(spark, sf_dir)).select("doc_id")


@query("exact_dedup_units", f"WITH {TERMS} SELECT min(doc_id) AS doc_id FROM terms GROUP BY array_to_string(w, ' ')")
def exact_dedup_units(spark, sf_dir):
    return context.drop_exact(document_units(spark, sf_dir)).select("doc_id")


PAIRS = f"""
    {TERMS}, g AS MATERIALIZED (
      SELECT doc_id, {sql_grams('w', 4)} AS g, list_sort(list_transform(w, lambda t: {{'l': length(t), 't': t}}))[1].t AS bucket,
             array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[0-9][0-9\\s.,%]*'), lambda x: trim(x, ' .,') <> ''), lambda x: replace(rtrim(replace(x, ' ', ''), '.,'), ',', '.')))), '|') AS figures
      FROM terms WHERE len(w) > 0)
"""


@query(
    "near_dup_pairs",
    f"""WITH {PAIRS} SELECT a.doc_id AS first_id, b.doc_id AS second_id, round({sql_jaccard('a.g', 'b.g')}, 6)::DOUBLE AS jaccard
        FROM g a JOIN g b ON a.bucket = b.bucket AND a.figures = b.figures AND a.doc_id < b.doc_id WHERE {sql_jaccard('a.g', 'b.g')} >= 0.92""",
)
def near_dup_pairs(spark, sf_dir):
    p = context.near_pairs(document_units(spark, sf_dir))
    return p.select(F.col("a_doc_id").alias("first_id"), F.col("b_doc_id").alias("second_id"), F.round("jaccard", 6).alias("jaccard"))


# the rule unit by unit over terms(doc_id, text, w): a step's state is the list of those gone so far
_ONE_BY_ONE = f"""
    {PAIRS.replace(TERMS + ",", "")},
    tokens AS (SELECT doc_id, {sql_tokens('text')} AS t FROM terms),
    alike AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, x.t AS ta, y.t AS tb FROM g a JOIN g b ON a.bucket = b.bucket AND a.figures = b.figures AND a.doc_id < b.doc_id
              JOIN tokens x ON x.doc_id = a.doc_id JOIN tokens y ON y.doc_id = b.doc_id WHERE {sql_jaccard('a.g', 'b.g')} >= 0.92),
    turns AS MATERIALIZED (SELECT b, row_number() OVER (ORDER BY b) AS i, list({{'a': a, 'ta': ta, 'tb': tb}} ORDER BY a) AS before FROM alike GROUP BY b),
    steps AS (SELECT 0 AS i, []::BIGINT[] AS gone UNION ALL
              SELECT t.i, CASE WHEN m IS NULL THEN gone WHEN m.tb <= m.ta THEN list_append(gone, b) ELSE list_append(gone, m.a) END
              FROM (SELECT t.i, b, gone, list_filter(before, lambda x: NOT list_contains(gone, x.a))[1] AS m FROM steps s JOIN turns t ON t.i = s.i + 1) t),
    left_ AS (SELECT doc_id FROM terms WHERE NOT list_contains((SELECT gone FROM steps ORDER BY i DESC LIMIT 1), doc_id))
"""
_FIRSTS = TERMS.replace("FROM documents", "FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM (SELECT doc_id, " + sql_content("text") + " AS w FROM documents) GROUP BY array_to_string(w, ' '))")
_SEQUENTIAL = f"WITH RECURSIVE {_FIRSTS}, {_ONE_BY_ONE} SELECT doc_id FROM left_"


@query("near_dedup_units", _SEQUENTIAL)
def near_dedup_units(spark, sf_dir):
    return context.drop_near(context.drop_exact(document_units(spark, sf_dir))).select("doc_id")


@query(
    "merge_fragments",
    f"""WITH RECURSIVE {_PACKED},
        sized AS MATERIALIZED (SELECT *, {sql_tokens('text')} AS t FROM units_),
        joined AS (SELECT doc_id, ordinal, unit_id, path, text, t FROM sized WHERE ordinal = 0 UNION ALL
                   SELECT doc_id, ordinal, CASE WHEN j THEN before ELSE unit_id END, path, CASE WHEN j THEN so_far || chr(10) || text ELSE text END, CASE WHEN j THEN ({sql_tokens("(so_far || chr(10) || text)")}) ELSE t END
                   FROM (SELECT u.*, j.unit_id AS before, j.text AS so_far, u.path = j.path AND greatest(u.t, j.t) < 70 AS j FROM joined j JOIN sized u ON u.doc_id = j.doc_id AND u.ordinal = j.ordinal + 1))
        SELECT doc_id, unit_id, t AS token_estimate, sha256(text) AS text_sha FROM joined QUALIFY row_number() OVER (PARTITION BY doc_id, unit_id ORDER BY ordinal DESC) = 1""",
)
def merge_fragments(spark, sf_dir):
    return context.merge_fragments(segment.units(headed(spark, sf_dir))).select("doc_id", "unit_id", "token_estimate", T.sha(F.col("text")).alias("text_sha"))


@query(
    "compaction_report",
    f"""WITH RECURSIVE {_PACKED},
        u AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, ordinal) AS id, doc_id AS doc, ordinal, path, kind, text, {sql_tokens('text')} AS t, {sql_content('text')} AS w FROM units_),
        terms AS MATERIALIZED (SELECT id AS doc_id, doc, ordinal, path, text, t, w FROM u WHERE NOT ({NOISE_SQL}) AND (len(w) >= 4 OR kind = 'table') QUALIFY row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY id) = 1),
        {_ONE_BY_ONE},
        kept AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ordinal) AS n FROM terms WHERE doc_id IN (SELECT doc_id FROM left_)),
        joined AS (SELECT doc, n, doc_id, path, text, t FROM kept WHERE n = 1 UNION ALL
                   SELECT doc, n, CASE WHEN j THEN before ELSE doc_id END, path, CASE WHEN j THEN so_far || chr(10) || text ELSE text END, CASE WHEN j THEN ({sql_tokens("(so_far || chr(10) || text)")}) ELSE t END
                   FROM (SELECT k.*, j.doc_id AS before, j.text AS so_far, k.path = j.path AND greatest(k.t, j.t) < 70 AS j FROM joined j JOIN kept k ON k.doc = j.doc AND k.n = j.n + 1)),
        merged AS (SELECT doc, doc_id, t FROM joined QUALIFY row_number() OVER (PARTITION BY doc, doc_id ORDER BY n DESC) = 1),
        s AS (SELECT 0 AS step, 'input' AS stage, count(*) AS units, sum(t)::BIGINT AS tokens FROM u UNION ALL SELECT 1, 'exact', count(*), sum(t)::BIGINT FROM terms UNION ALL SELECT 2, 'merged', count(*), sum(t)::BIGINT FROM merged)
        SELECT step, stage, units, tokens, round(1 - tokens / (SELECT tokens FROM s WHERE step = 0)::DOUBLE, 4) AS compression_ratio, tokens > (SELECT tokens FROM s WHERE step = 0) AS grown FROM s""",
)
def compaction_report(spark, sf_dir):
    return context.compaction_report(ask_plan.sizes(headed(spark, sf_dir)))


# -- R: retrieval -----------------------------------------------------------------------


@query("bm25_df", f"WITH {BM25} SELECT term, df FROM freq")
def bm25_df(spark, sf_dir):
    return retrieval.document_frequency(retrieval.postings(document_units(spark, sf_dir)))


@query("bm25_scores", f"WITH {BM25} SELECT question_id, unit_id, round(lexical, 6) AS lexical FROM lexical")
def bm25_scores(spark, sf_dir):
    return retrieval.bm25(document_units(spark, sf_dir), questions(spark, sf_dir)).withColumn("lexical", F.round("lexical", 6))


def _topk(rows: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("lexical", 6)), "unit_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("question_id", "unit_id", F.col("rank").cast("long").alias("rank"), F.round("lexical", 6).alias("lexical"))


@query(
    "bm25_topk",
    f"WITH {BM25} SELECT question_id, unit_id, rank, lexical FROM (SELECT question_id, unit_id, round(lexical, 6) AS lexical, row_number() OVER (PARTITION BY question_id ORDER BY round(lexical, 6) DESC, unit_id) AS rank FROM lexical) WHERE rank <= 10",
)
def bm25_topk(spark, sf_dir):
    return _topk(retrieval.bm25_best(document_units(spark, sf_dir), questions(spark, sf_dir), 10))


def other_questions(spark, sf_dir) -> DataFrame:
    """Users' turns: questions whose words the documents may lack."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))


GATE = f"""
    {TERMS}, vocab AS MATERIALIZED (SELECT DISTINCT unnest(w) AS term FROM terms),
    prefixes AS (SELECT DISTINCT left(term, 7) AS p FROM vocab WHERE length(term) >= 7),
    q AS (SELECT conv_id * 1000 + turn AS question_id, unnest(list_distinct({sql_content('text')})) AS term FROM conversations WHERE role = 'user'),
    missing AS (SELECT q.* FROM q WHERE term NOT IN (SELECT term FROM vocab) AND NOT (length(term) >= 7 AND left(term, 7) IN (SELECT p FROM prefixes)))
"""


@query("unsupported_terms", f"WITH {GATE} SELECT question_id, term FROM missing")
def unsupported_terms(spark, sf_dir):
    u = document_units(spark, sf_dir)
    return retrieval.unsupported_terms(other_questions(spark, sf_dir), retrieval.vocabulary(u, retrieval.postings(u)))


@query(
    "off_topic_gate",
    f"""WITH {GATE}, a AS (SELECT conv_id * 1000 + turn AS question_id FROM conversations WHERE role = 'user'),
        n AS (SELECT question_id, count(*) AS topical FROM q WHERE NOT list_contains({sql_list(W.GENERIC_TERMS)}, term) GROUP BY 1),
        m AS (SELECT question_id, count(*) AS unsupported FROM missing WHERE NOT list_contains({sql_list(W.GENERIC_TERMS)}, term) GROUP BY 1)
        SELECT question_id, coalesce(topical, 0) AS topical, coalesce(unsupported, 0) AS unsupported, coalesce(topical > 0 AND unsupported::DOUBLE / topical >= 0.4, false) AS off_topic FROM a LEFT JOIN n USING (question_id) LEFT JOIN m USING (question_id)""",
)
def off_topic_gate(spark, sf_dir):
    u = document_units(spark, sf_dir)
    return retrieval.off_topic(other_questions(spark, sf_dir), retrieval.vocabulary(u, retrieval.postings(u)))


@query("structural_boost", f"WITH {TOTALS} SELECT question_id, unit_id, boost FROM boosted")
def structural_boost(spark, sf_dir):
    return retrieval.boosted(document_units(spark, sf_dir), questions(spark, sf_dir)).select("question_id", "unit_id", "boost")


@query(
    "section_boost",
    f"""WITH RECURSIVE {_PACKED},
        held AS MATERIALIZED (SELECT unit_id, u.doc_id, u.text, u.kind, d.source, list_distinct({sql_content("array_to_string(path, ' ')")}) AS sections, {sql_content('u.text')} AS w FROM units_ u JOIN documents d USING (doc_id)),
        {ASKED}, phrased AS (SELECT question_id, question, terms, {PHRASES} AS p FROM asked),
        met AS (SELECT DISTINCT question_id, unit_id FROM (SELECT question_id, unnest(terms) AS term FROM asked) JOIN (SELECT unit_id, unnest(w) AS term FROM held) USING (term))
        SELECT question_id, unit_id, round((CASE WHEN len(list_intersect(sections, terms)) > 0 THEN 0.22::DOUBLE * least(1.0::DOUBLE, 2.0::DOUBLE * len(list_intersect(sections, terms)) / greatest(1, len(terms))) ELSE 0 END)
               + (CASE WHEN len(list_intersect({sql_content("replace(source, '_', ' ')")}, terms)) > 0 THEN 0.10 ELSE 0 END) + (CASE WHEN kind = 'table' THEN 0.06 ELSE 0 END)
               + (CASE WHEN len(p) >= 3 AND len(list_filter(list_transform(range(0, greatest(len(p) - 2, 1)), lambda i: array_to_string(list_slice(p, i + 1, i + 3), ' ')), lambda x: contains(lower(text), x))) > 0 THEN 0.18 ELSE 0 END)
               + (CASE WHEN regexp_matches(question, '{NUMERIC}') AND regexp_matches(text, '[0-9]') THEN 0.12 ELSE 0 END), 6)::DOUBLE AS boost
        FROM met JOIN held USING (unit_id) JOIN phrased USING (question_id)""",
)
def section_boost(spark, sf_dir):
    """R8 over packed units, whose section paths and tables it weighs."""
    return retrieval.boosted(segment.units(headed(spark, sf_dir)), questions(spark, sf_dir)).select("question_id", "unit_id", "boost")


@query(
    "score_floor",
    f"""WITH {TOTALS}, r AS (SELECT *, lexical * (1 + boost) AS total, row_number() OVER (PARTITION BY question_id ORDER BY round(lexical * (1 + boost), 9) DESC, unit_id) AS rank FROM boosted),
        f AS (SELECT *, max(total) OVER (PARTITION BY question_id) AS best FROM r)
        SELECT question_id, unit_id, rank, round(total, 6) AS total FROM f WHERE rank <= 40 AND total >= greatest(0.02, 0.15 * best)""",
)
def score_floor(spark, sf_dir):
    r = retrieval.ranked(document_units(spark, sf_dir), questions(spark, sf_dir), gate=False)
    return r.select("question_id", "unit_id", F.col("rank").cast("long").alias("rank"), F.round("total", 6).alias("total"))


def _evidence(spark, sf_dir):
    q = questions(spark, sf_dir)
    asked = context.budget(context.classify_intent(ask_plan.observe(q)))
    pool = retrieval.ranked(document_units(spark, sf_dir), q, gate=False)
    return q, asked, ask_plan.keep(retrieval.select_diverse(pool, asked))


def _picked_sql() -> str:
    """picks(question_id, turn, unit_id, score, penalty): each turn takes the pool's worthiest passage that fits."""
    hits = {k: "list_filter(" + sql_list(m) + ", lambda m: contains(p, ' ' || m) OR contains(p, m || ' '))" for k, m in sorted(W.INTENT_MARKERS.items())}
    counts = ", ".join(f"len({v}) AS {k}" for k, v in hits.items())
    best = "greatest(" + ", ".join(hits) + ")"
    policy = context.BudgetPolicy()
    first = lambda values, other: "CASE " + " ".join(f"WHEN best > 0 AND {k} = best THEN {values.get(k, other)}" for k in hits) + f" ELSE {values['factual']} END"
    return f"""
    {TOTALS.strip()},
    ranks AS (SELECT *, lexical * (1 + boost) AS total, row_number() OVER (PARTITION BY question_id ORDER BY round(lexical * (1 + boost), 9) DESC, unit_id) AS rank FROM boosted),
    floored AS (SELECT *, max(total) OVER (PARTITION BY question_id) AS best FROM ranks QUALIFY rank <= 40),
    pool AS MATERIALIZED (SELECT question_id, unit_id, total, text, w, {sql_tokens('text')} AS cost, list_transform({sql_grams('w', 4)}, lambda x: hash(x)) AS g FROM floored f JOIN terms t ON t.doc_id::VARCHAR = f.unit_id WHERE total >= greatest(0.02, 0.15 * best)),
    held_grams AS (SELECT question_id, unit_id, len(g) AS n, unnest(g) AS x FROM pool),
    shared_grams AS (SELECT question_id, a.unit_id AS a, b.unit_id AS b, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM held_grams a JOIN held_grams b USING (question_id, x) GROUP BY 1, 2, 3),
    sims AS (SELECT question_id, a AS unit_id, map(list(b), list(j)) AS like_ FROM shared_grams GROUP BY 1, 2),
    cand AS MATERIALIZED (SELECT question_id, unit_id, total, cost, like_ FROM pool JOIN sims USING (question_id, unit_id)),
    intents AS (SELECT *, {best} AS best FROM (SELECT question_id, question, {counts} FROM (SELECT question_id, question, ' ' || trim(lower(question)) || ' ' AS p FROM asked))),
    budgets AS MATERIALIZED (SELECT question_id, {first(policy.passages, 5)} AS most, ({first(policy.factors, 0.8)})::DOUBLE AS f, greatest(256, 4096 - 512 - 160 - ({sql_tokens('question')})) AS base FROM intents),
    picks AS (SELECT question_id, 0 AS turn, greatest(256, least(base, floor(base * f)::INTEGER)) AS room, []::VARCHAR[] AS picked, NULL::VARCHAR AS unit_id, 0::DOUBLE AS score, 0::DOUBLE AS penalty FROM budgets UNION ALL
              SELECT question_id, turn + 1, room - b.cost, list_append(picked, b.unit_id), b.unit_id, b.total, b.penalty
              FROM (SELECT question_id, any_value(turn) AS turn, any_value(room) AS room, any_value(picked) AS picked,
                           list({{'unit_id': unit_id, 'cost': cost, 'total': total, 'penalty': 0.35::DOUBLE * near_}} ORDER BY round(total - 0.35::DOUBLE * near_, 9) DESC, unit_id)[1] AS b
                    FROM (SELECT p.question_id, turn, room, picked, c.unit_id, cost, total, coalesce(list_max(list_transform(picked, lambda x: coalesce(c.like_[x], 0))), 0)::DOUBLE AS near_
                          FROM picks p JOIN cand c ON c.question_id = p.question_id JOIN budgets d ON d.question_id = p.question_id
                          WHERE turn < most AND NOT list_contains(picked, c.unit_id) AND (turn = 0 OR cost <= room)) GROUP BY question_id))
    """


_PICKED = _picked_sql()


@query("mmr_select", f"WITH RECURSIVE {_PICKED} SELECT question_id, turn AS pick, 'S' || turn AS label, unit_id, round(score, 6) AS score, round(penalty, 6) AS penalty FROM picks WHERE turn > 0")
def mmr_select(spark, sf_dir):
    return _evidence(spark, sf_dir)[2].select("question_id", "pick", "label", "unit_id", "score", "penalty")


@query(
    "retrieval_precision",
    f"WITH RECURSIVE {_PICKED} SELECT question_id, round(avg((len(list_intersect(w, a.terms)) > 0)::INT), 4) AS precision FROM picks JOIN pool USING (question_id, unit_id) JOIN asked a USING (question_id) WHERE turn > 0 GROUP BY 1",
)
def retrieval_precision(spark, sf_dir):
    q, _, e = _evidence(spark, sf_dir)
    return retrieval.precision(e, q)


# -- P, V: prompts and validation --------------------------------------------------------


def retrieved(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each benchmark item with the two documents that BM25 ranks first among all, as evidence."""
    q, d = questions(spark, sf_dir), documents(spark, sf_dir)
    best = _topk(retrieval.bm25_best(document_units(spark, sf_dir), q, 2), 2)
    # the few ids go to the texts
    rows = d.join(retrieval.sized(ask_plan.keep(best.select("question_id", F.col("rank").cast("int").alias("pick"), F.col("unit_id").cast("long").alias("doc_id")))), "doc_id")
    evidence = rows.select("question_id", "pick", F.concat(F.lit("S"), "pick").alias("label"), "doc_id", F.col("source").alias("document_name"), F.array().cast("array<string>").alias("section_path"), "text", T.token_count(F.col("text")).alias("token_estimate"))
    # a few rows, which prompts, answers and checks read: texts are read once for all of them
    return q, ask_plan.keep(evidence)


EVIDENCE = f"""
    {BM25},
    top_two AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY round(lexical, 6) DESC, unit_id) AS pick FROM lexical),
    evidence AS MATERIALIZED (SELECT question_id, pick, 'S' || pick AS label, source, d.text FROM top_two JOIN documents d USING (doc_id) WHERE pick <= 2)
"""
REFUSED = f"CASE WHEN {sql_any("(' ' || lower(question) || ' ')", W.FRENCH_QUESTION)} THEN '{prompt.REFUSAL_FR}' ELSE '{prompt.REFUSAL}' END"


@query(
    "prompt_render",
    f"""WITH {EVIDENCE}, b AS (SELECT question_id, pick, '[' || label || '] ' || source || chr(10) || trim(text, {BLANKS}) AS block FROM evidence),
        r AS (SELECT *, sum(length(block)) OVER (PARTITION BY question_id ORDER BY pick) AS used FROM b),
        j AS (SELECT question_id, string_agg(block, chr(10) || chr(10) ORDER BY pick) AS excerpts FROM r WHERE used <= 20000 GROUP BY 1),
        q AS (SELECT item_id AS question_id, text AS question, coalesce(excerpts, '{prompt.NO_EVIDENCE}') AS excerpts FROM benchmark LEFT JOIN j ON j.question_id = item_id),
        p AS (SELECT *, replace('{prompt.SYSTEM}', '{{refusal}}', {REFUSED}) || chr(10) || '### Excerpts' || chr(10) || excerpts || chr(10) || chr(10) || '### Question' || chr(10) || trim(question, {BLANKS}) || chr(10) || chr(10) || '### Answer' || chr(10) AS prompt FROM q)
        SELECT question_id, sha256(prompt) AS prompt_sha, {sql_tokens('prompt')} AS prompt_tokens, round({sql_tokens('excerpts')}::DOUBLE / ({sql_tokens('prompt')}), 4)::DOUBLE AS efficiency, ({sql_tokens('prompt')}) > 3584 AS overflows FROM p""",
)
def prompt_render(spark, sf_dir):
    q, e = retrieved(spark, sf_dir)
    p = prompt.build_prompt(prompt.render_evidence(e, q))
    return p.select("question_id", T.sha(F.col("prompt")).alias("prompt_sha"), "prompt_tokens", "efficiency", "overflows")


FIRST_THREE = f"array_to_string(list_slice(list_filter(list_transform(string_split(regexp_replace(trim(text, {BLANKS}), '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda s: trim(s, {BLANKS})), lambda s: s <> ''), 1, 3), ' ')"


@query(
    "simulated_answer",
    f"""WITH {EVIDENCE} SELECT item_id AS question_id, coalesce({FIRST_THREE.replace('text', 'e.text')} || ' [' || label || ']', {REFUSED.replace('question', 'b.text')}) AS answer
        FROM benchmark b LEFT JOIN (SELECT * FROM evidence WHERE pick = 1) e ON e.question_id = item_id""",
)
def simulated_answer(spark, sf_dir):
    q, e = retrieved(spark, sf_dir)
    p = prompt.build_prompt(prompt.render_evidence(e, q))
    return prompt.extractive_answer(p, e).select("question_id", "answer")


_DECLINED = f"CASE WHEN contains(lower(text), 'les extraits') OR contains(lower(text), 'la question') THEN '{prompt.REFUSAL_FR}' ELSE '{prompt.REFUSAL}' END"


@query(
    "unlabelled_answer",
    f"""WITH RECURSIVE {_PICKED},
        said AS MATERIALIZED (SELECT question_id, a.terms, text, list_filter(list_transform(string_split(replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(10), chr(30)), chr(30)), lambda s: trim(s, {BLANKS})), lambda s: length(s) > 25) AS ps
                 FROM picks JOIN pool USING (question_id, unit_id) JOIN asked a USING (question_id) WHERE turn = 1),
        each_ AS (SELECT question_id, terms, ps, unnest(ps) AS s FROM said),
        scored AS (SELECT question_id, s, len(list_intersect(terms, {sql_content('s')})) AS o, list_position(ps, s) AS i FROM each_),
        best AS (SELECT question_id, max(o) AS o, array_to_string(list(s ORDER BY o DESC, i, s)[1:2], ' ') AS top FROM scored GROUP BY 1)
        SELECT question_id, CASE WHEN trim(text, {BLANKS}) = '' OR contains(text, 'no excerpt matched') THEN {_DECLINED} WHEN len(ps) = 0 THEN '{prompt.REFUSAL_FR}' WHEN len(terms) = 0 THEN array_to_string(ps[1:2], ' ')
               WHEN o = 0 THEN {_DECLINED} ELSE top END AS answer FROM said LEFT JOIN best USING (question_id)""",
)
def unlabelled_answer(spark, sf_dir):
    q, _, e = _evidence(spark, sf_dir)
    rows = q.join(e.where("pick = 1").select("question_id", "text"), "question_id")
    return rows.select("question_id", prompt.unlabelled_answer(F.col("question"), F.col("text")).alias("answer"))


def mixed_answers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Answers that quote their best document whole, with foreign sentences and wrong labels mixed in."""
    q, e = retrieved(spark, sf_dir)
    first = e.where("pick = 1").select("question_id", F.col("text").alias("quoted"))
    rest = F.when(F.col("question_id") % 3 == 0, F.concat(F.lit(" "), "question", F.lit(" [S7]."))).when(F.col("question_id") % 3 == 1, " [S1]").otherwise(" It seems so. Les documents fournis ne permettent pas de conclure.")
    return q.join(first, "question_id", "left").select("question_id", "question", F.concat(F.coalesce("quoted", F.lit("")), rest).alias("answer")), e


GROUND = f"""
    {EVIDENCE},
    answers AS (SELECT item_id AS question_id, b.text AS question, coalesce(e.text, '') || CASE item_id % 3 WHEN 0 THEN ' ' || b.text || ' [S7].' WHEN 1 THEN ' [S1]' ELSE ' It seems so. Les documents fournis ne permettent pas de conclure.' END AS answer
                FROM benchmark b LEFT JOIN (SELECT * FROM evidence WHERE pick = 1) e ON e.question_id = item_id),
    split_ AS (SELECT question_id, {sql_sentences("regexp_replace(trim(answer, " + BLANKS + "), '\\[(S[0-9]+)\\]', '', 'g')")} AS s FROM answers),
    each_ AS (SELECT question_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS n FROM split_),
    judged AS MATERIALIZED (SELECT *, {sql_content('sentence')} AS w FROM each_),
    grams AS MATERIALIZED (SELECT question_id, n, sentence, {sql_grams('w', 3)} AS g FROM judged WHERE len(w) >= 3 AND question_id IN (SELECT question_id FROM evidence)),
    held_ AS MATERIALIZED (SELECT question_id, pick, label, {sql_content('text')} AS w FROM evidence),
    held AS MATERIALIZED (SELECT question_id, pick, label, {sql_grams('w', 3)} AS g FROM held_),
    both_ AS (SELECT question_id, n, pick, count(*) AS k FROM (SELECT question_id, n, unnest(g) AS x FROM grams) JOIN (SELECT question_id, pick, unnest(g) AS x FROM held) USING (question_id, x) GROUP BY ALL),
    shared AS (SELECT a.question_id, a.n, h.pick, label, coalesce(k, 0)::DOUBLE / len(a.g) AS o FROM grams a JOIN held h USING (question_id) LEFT JOIN both_ b ON b.question_id = a.question_id AND b.n = a.n AND b.pick = h.pick),
    best AS (SELECT question_id, n, max(o) AS o, arg_max(label, o - pick * 1e-9) AS label FROM shared GROUP BY 1, 2),
    verdicts AS (SELECT g.question_id, g.n, g.sentence, CASE WHEN o > 0 THEN label ELSE '' END AS label, o FROM grams g JOIN best USING (question_id, n))
"""


@query("grounding_sentences", f"WITH {GROUND} SELECT question_id, n::INTEGER AS n, sentence, label, round(o, 4) AS overlap, o >= 0.34 AS grounded FROM verdicts")
def grounding_sentences(spark, sf_dir):
    return validate.ground_sentences(*mixed_answers(spark, sf_dir))


@query(
    "validation_report",
    f"""WITH {GROUND},
        rates AS (SELECT question_id, round(avg((o >= 0.34)::INT), 4) AS rate, count(*) FILTER (o < 0.34) AS lost FROM verdicts GROUP BY 1),
        have AS (SELECT question_id, list_distinct(list(label)) AS labels FROM evidence GROUP BY 1),
        r AS (SELECT a.question_id, trim(answer, {BLANKS}) AS answer, list_sort(list_distinct(regexp_extract_all(answer, '\\[(S[0-9]+)\\]', 1))) AS cited, coalesce(labels, []::VARCHAR[]) AS labels, coalesce(rate, 0)::DOUBLE AS rate, coalesce(lost, 0) AS lost,
              {sql_any('lower(answer)', W.INSUFFICIENT_MARKERS)} AS declared, list_distinct({sql_content('question')}) AS asked, list_distinct({sql_content('answer')}) AS told FROM answers a LEFT JOIN rates USING (question_id) LEFT JOIN have USING (question_id)),
        c AS (SELECT *, len(list_filter(cited, lambda x: NOT list_contains(labels, x))) AS invalid, CASE WHEN len(labels) = 0 THEN 0 ELSE round(len(list_intersect(cited, labels))::DOUBLE / len(labels), 4) END::DOUBLE AS cover,
              CASE WHEN len(asked) = 0 THEN 0 ELSE round(len(list_intersect(asked, told))::DOUBLE / len(asked), 4) END::DOUBLE AS qcover FROM r)
        SELECT question_id, CASE WHEN len(labels) = 0 THEN declared ELSE length(answer) >= 2 AND invalid = 0 AND rate >= 0.6 AND (len(cited) > 0 OR declared) END AS passed,
               CASE WHEN len(labels) = 0 OR declared THEN 'insufficient' WHEN rate >= 0.85 AND len(cited) > 0 AND cover >= 0.3 AND qcover > 0 THEN 'high' WHEN rate >= 0.6 AND (len(cited) > 0 OR cover > 0) THEN 'medium' WHEN rate > 0 THEN 'low' ELSE 'insufficient' END AS confidence,
               rate AS grounding_rate, cover AS evidence_coverage, qcover AS question_coverage, array_to_string(cited, ',') AS cited_labels, declared AS uncertainty_declared, least(5, lost) AS unsupported,
               (invalid > 0)::INT + (len(labels) = 0 AND NOT declared)::INT + (len(labels) > 0 AND qcover = 0 AND NOT declared)::INT + ({sql_any('lower(answer)', W.HEDGE_MARKERS)})::INT + (lost > 0)::INT AS warnings FROM c""",
)
def validation_report(spark, sf_dir):
    v = validate.validate(*mixed_answers(spark, sf_dir))
    return v.select("question_id", "passed", "confidence", "grounding_rate", "evidence_coverage", "question_coverage", F.array_join("cited_labels", ",").alias("cited_labels"), "uncertainty_declared", F.size("unsupported").cast("long").alias("unsupported"), F.size("warnings").alias("warnings"))


# -- M, E: metrics and evaluation --------------------------------------------------------


def samples(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value")


@query(
    "stats_aggregate",
    """SELECT event_type AS metric, count(value) AS samples, round(avg(value), 4) AS mean, round(min(value), 4) AS minimum, round(max(value), 4) AS maximum, round(stddev_pop(value), 4) AS stdev,
       round(median(value), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95, round(round(stddev_pop(value), 4) / round(avg(value), 4), 4) AS cv, count(value) >= 3 AND round(round(stddev_pop(value), 4) / round(avg(value), 4), 4) <= 0.15 AS stable
       FROM events GROUP BY event_type""",
)
def stats_aggregate(spark, sf_dir):
    return metrics.aggregate(samples(spark, sf_dir))


@query("stage_share", "SELECT l_orderkey AS request_id, l_linenumber AS stage, round(l_quantity::DOUBLE / sum(l_quantity::DOUBLE) OVER (PARTITION BY l_orderkey), 4) AS share FROM lineitem")
def stage_share(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("stage"), F.col("l_quantity").cast("double").alias("ms"))
    return metrics.stage_share(d).drop("ms")


def campaigns(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two campaigns of the tracked metrics, from events by halves of the month."""
    names = list(dict.fromkeys([*metrics.TRACKED, *metrics.NAIVE_METRICS]))
    name = F.array(*map(F.lit, names))[(F.col("event_id") % len(names)).cast("int")]
    e = read(spark, sf_dir, "events").select(name.alias("metric"), "value", (F.col("event_id") % 2 == 0).alias("before"))
    mean = lambda c: e.where(c).groupBy("metric").agg(F.round(F.avg("value"), 4).alias("value"))
    return mean("NOT before"), mean("before")


_NAMES = sql_list(list(dict.fromkeys([*metrics.TRACKED, *metrics.NAIVE_METRICS])))
_CAMPAIGNS = f"c AS (SELECT {_NAMES}[event_id % len({_NAMES}) + 1] AS metric, round(avg(value) FILTER (event_id % 2 = 0), 4) AS before, round(avg(value) FILTER (event_id % 2 = 1), 4) AS after FROM events GROUP BY 1)"
_MORE = ", ".join(f"('{m}', {str(up).lower()}, {t})" for m, (up, t) in metrics.TRACKED.items())


@query(
    "regression_compare",
    f"""WITH {_CAMPAIGNS}, r AS (SELECT metric, before AS baseline, after AS current, round((after - before) * 100 / abs(before), 2) AS delta_pct, more, allowed FROM c JOIN (VALUES {_MORE}) t(metric, more, allowed) USING (metric) WHERE before <> 0 AND after IS NOT NULL),
        i AS (SELECT *, CASE WHEN more THEN delta_pct > 0 ELSE delta_pct < 0 END AS improved FROM r)
        SELECT metric, baseline, current, delta_pct, improved, NOT improved AND abs(delta_pct) > allowed AS regression FROM i""",
)
def regression_compare(spark, sf_dir):
    return metrics.compare_regression(*campaigns(spark, sf_dir))


_NAIVE = ", ".join(f"('{m}', {str(up).lower()})" for m, up in metrics.NAIVE_METRICS.items())


@query(
    "naive_compare",
    f"""WITH {_CAMPAIGNS} SELECT metric, before AS "without", after AS "with", round((after - before) * 100 / abs(before), 2) AS delta_pct, CASE WHEN more THEN after > before ELSE after < before END AS favours_pipeline,
        NOT (list_contains({sql_list(metrics.ZERO_IS_MISSING)}, metric) AND (before = 0 OR after = 0)) AS measured FROM c JOIN (VALUES {_NAIVE}) t(metric, more) USING (metric) WHERE before IS NOT NULL AND after IS NOT NULL""",
)
def naive_compare(spark, sf_dir):
    return metrics.compare_naive(*campaigns(spark, sf_dir))


@query(
    "resource_peaks",
    """SELECT user_id AS session_id, max(value) AS peak_rss_mb, min(value * 2) AS least_ram_mb, max(value % 100) AS peak_cpu, max(60 + value % 40) AS peak_c,
       array_to_string(list_filter([CASE WHEN max(60 + value % 40) >= 92 THEN 'critical temperature' WHEN max(60 + value % 40) >= 78 THEN 'high temperature' END, CASE WHEN max(value % 100) >= 88 THEN 'memory nearly full' END], lambda x: x IS NOT NULL), ',') AS warnings FROM events GROUP BY user_id""",
)
def resource_peaks(spark, sf_dir):
    v = F.col("value")
    s = read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), v.alias("rss_mb"), (v * 2).alias("available_ram_mb"), (v % 100).alias("cpu_percent"), (60 + v % 40).alias("temperature_c"))
    return metrics.peaks(s).withColumn("warnings", F.array_join(metrics.resource_warnings(F.col("peak_c"), F.col("peak_cpu")), ","))


def probes(spark, sf_dir) -> DataFrame:
    """Assistants' turns as answers to probes that ask for their own first word."""
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    word = F.regexp_extract("text", r"^(\S+)", 1)
    n = F.col("conv_id") + F.col("turn")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.array(word, F.when(n % 5 == 0, "zzqx").otherwise(word)).alias("must_contain"), F.array(F.when(n % 7 == 0, word).otherwise("zzqx")).alias("must_not_contain"),
        F.when(n % 2 == 0, "any").otherwise("all").alias("match"), F.when(n % 3 == 0, "src1").alias("expected_source"), (n % 6 == 5).alias("unanswerable"), F.when(n % 11 == 10, "").otherwise(F.col("text")).alias("answer"),
        F.when(n % 23 == 22, "boom").alias("error"), (n % 13 == 12).alias("truncated"), F.when(n % 4 == 1, "insufficient").otherwise("high").alias("confidence"), F.array(F.when(n % 9 == 0, "src1").otherwise("src2")).alias("sources"),
    )


OUTCOMES = r"""
    p AS (SELECT conv_id || '-' || turn AS id, conv_id + turn AS n, regexp_extract(text, '^(\S+)', 1) AS w, text FROM conversations WHERE role = 'assistant'),
    o AS (SELECT *, CASE WHEN n % 23 = 22 THEN 'crash' WHEN n % 13 = 12 THEN 'truncated' WHEN n % 11 = 10 OR trim(text) = '' THEN 'empty' WHEN n % 6 = 5 THEN 'unanswerable' ELSE 'checked' END AS outcome,
          (contains(lower(text), lower(w)) AND (n % 2 = 0 OR n % 5 <> 0 OR contains(lower(text), 'zzqx'))) AND NOT contains(lower(text), CASE WHEN n % 7 = 0 THEN lower(w) ELSE 'zzqx' END) AS held, n % 4 = 1 AS refused, n % 6 = 5 AS unanswerable FROM p),
    r AS (SELECT id, outcome, unanswerable, outcome IN ('unanswerable', 'checked') AND NOT refused AS answered, CASE outcome WHEN 'checked' THEN held WHEN 'unanswerable' THEN refused ELSE false END AS correct,
          CASE WHEN outcome = 'checked' AND n % 3 = 0 THEN n % 9 = 0 END AS source_correct, outcome IN ('unanswerable', 'checked') AND refused AS declined, outcome = 'unanswerable' AND NOT refused AS hallucinated FROM o)
"""


@query("probe_outcomes", f"WITH {OUTCOMES} SELECT * FROM r")
def probe_outcomes(spark, sf_dir):
    return evaluate.probe_outcomes(probes(spark, sf_dir)).select("id", "outcome", "unanswerable", "answered", "correct", "source_correct", "declined", "hallucinated")


@query(
    "accuracy_summary",
    f"""WITH {OUTCOMES}, s AS (SELECT count(*) AS probes, count(*) FILTER (NOT unanswerable) AS answerable, count(*) FILTER (unanswerable) AS unanswerable_probes, count(*) FILTER (NOT unanswerable AND correct) AS ok, count(*) FILTER (NOT unanswerable AND source_correct) AS src,
        count(*) FILTER (unanswerable AND declined) AS ref, count(*) FILTER (hallucinated) AS hal, count(*) FILTER (outcome = 'truncated') AS tr FROM r)
        SELECT probes, answerable, unanswerable_probes, round(ok::DOUBLE / answerable, 4) AS accuracy, round(src::DOUBLE / answerable, 4) AS source_accuracy, round(ref::DOUBLE / unanswerable_probes, 4) AS refusal_accuracy,
               round((ok + ref)::DOUBLE / probes, 4) AS overall_accuracy, round(hal::DOUBLE / probes, 4) AS hallucination_rate, round(tr::DOUBLE / probes, 4) AS truncated FROM s""",
)
def accuracy_summary(spark, sf_dir):
    return evaluate.accuracy_summary(evaluate.probe_outcomes(probes(spark, sf_dir)))


@query("probe_failures", f"WITH {OUTCOMES} SELECT id FROM r WHERE NOT (CASE WHEN unanswerable THEN declined ELSE correct AND coalesce(source_correct, true) END)")
def probe_failures(spark, sf_dir):
    return evaluate.failures(evaluate.probe_outcomes(probes(spark, sf_dir))).select("id")


def candidates(spark, sf_dir) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        F.concat(F.lit("m"), k.cast("string")).alias("model"), ((k % 101) / 100.0).alias("accuracy"), ((k % 37) * 0.5).alias("tokens_per_second"), ((k % 80) * 100.0).alias("peak_rss_mb"),
        ((k % 50) * 40.0).alias("available_ram_mb"), F.when(k % 4 != 0, 60.0 + k % 40).alias("temperature_c"), (k % 17 == 0).alias("crashed"), (k % 19 == 0).alias("throttled"),
    )


SCORED = """
    k AS (SELECT 'm' || p_partkey AS model, p_partkey AS k, ((p_partkey % 101) / 100.0)::DOUBLE AS acc, ((p_partkey % 37) * 0.5)::DOUBLE AS tps, ((p_partkey % 80) * 100.0)::DOUBLE AS rss, ((p_partkey % 50) * 40.0)::DOUBLE AS ram, CASE WHEN p_partkey % 4 <> 0 THEN 60.0 + p_partkey % 40 END AS c FROM part),
    s AS (SELECT *, k % 17 = 0 OR (ram > 0 AND rss > 0 AND ram < 256) OR rss > 7168 AS disqualified, round(acc * 0.5, 4) AS a, round(least(1.0::DOUBLE, tps / 15) * 0.3, 4) AS t, round(CASE WHEN rss > 0 THEN greatest(0.0::DOUBLE, (7 - rss / 1024) / 7) ELSE 0 END * 0.2, 4) AS e,
          CASE WHEN k % 19 = 0 OR coalesce(c > 85, false) THEN 0.1 ELSE 0 END::DOUBLE AS p FROM k)
"""


@query("score_candidates", f"WITH {SCORED} SELECT model, disqualified, a AS accuracy_part, t AS throughput_part, e AS efficiency_part, p AS thermal_penalty, CASE WHEN disqualified THEN 0 ELSE round(greatest(0.0::DOUBLE, a + t + e - p), 4) END::DOUBLE AS total FROM s")
def score_candidates(spark, sf_dir):
    return evaluate.rank_candidates(candidates(spark, sf_dir)).select("model", "disqualified", "accuracy_part", "throughput_part", "efficiency_part", "thermal_penalty", "total")


@query(
    "hardware_dependence",
    f"""WITH {SCORED}, f AS (SELECT model, CASE WHEN disqualified THEN 0 ELSE round(greatest(0.0::DOUBLE, a + t + e - p), 4) END::DOUBLE AS now, CASE WHEN disqualified THEN 0 ELSE round(greatest(0.0::DOUBLE, a + 0.3 + e - p), 4) END::DOUBLE AS fast FROM s),
        m AS (SELECT arg_max(model, {{'total': now, 'model': model}}) AS measured, arg_max(model, {{'total': fast, 'model': model}}) AS saturated FROM f) SELECT measured, saturated, measured <> saturated AS depends_on_hardware FROM m""",
)
def hardware_dependence(spark, sf_dir):
    return evaluate.hardware_dependence(candidates(spark, sf_dir))


@query("scenario_verdicts", "SELECT event_type AS scenario, count(*) AS runs, count(*) FILTER (value < 1) AS errors, CASE WHEN count(*) FILTER (value < 1) > 0 THEN 'fail' WHEN bool_and(user_id % 2 = 0) THEN 'inconclusive' ELSE 'pass' END AS verdict FROM events GROUP BY 1")
def scenario_verdicts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return evaluate.scenario_verdicts(e.select(F.col("event_type").alias("scenario"), (F.col("value") >= 1).alias("ok"), F.when(F.col("user_id") % 2 == 0, "insufficient").otherwise("high").alias("confidence"), F.lit(False).alias("expect_insufficient")))


@query(
    "campaign_runs",
    """WITH r AS (SELECT 'S' || item_id AS scenario, item_id % 5 = 0 AS cold, unnest(range(0, CASE WHEN item_id % 5 = 0 THEN 1 ELSE 6 END)) AS iteration FROM benchmark)
       SELECT scenario, 0 AS q, iteration::INTEGER AS iteration, iteration < 1 AND NOT cold AS warm_up FROM r""",
)
def campaign_runs(spark, sf_dir):
    s = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("S"), "item_id").alias("id"), (F.col("item_id") % 5 == 0).alias("cold_start"), F.lit(1).alias("repeat_question"), F.array("text").alias("questions"))
    return evaluate.campaign_runs(s).drop("question")


@query(
    "campaign_summary",
    """WITH r AS (SELECT event_type AS scenario, value FROM events WHERE event_id % 10 <> 0 AND event_id % 6 <> 0), b AS (SELECT scenario, value FROM r UNION ALL SELECT 'all', value FROM r)
       SELECT scenario, 'value' AS metric, count(value) AS samples, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.95), 4) AS p95 FROM b GROUP BY scenario""",
)
def campaign_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("scenario"), (F.col("event_id") % 10 != 0).alias("ok"), (F.col("event_id") % 6 == 0).alias("warm_up"), "value")
    return evaluate.campaign_summary(e, ["value"]).select("scenario", "metric", "samples", "mean", "p95")


@query("first_documents", "SELECT doc_id FROM documents ORDER BY source, doc_id LIMIT 50")
def first_documents(spark, sf_dir):
    return evaluate.first_documents(documents(spark, sf_dir), 50).select("doc_id")


@query(
    "naive_context",
    f"""WITH docs_ AS (SELECT 0 AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY source, doc_id) AS text FROM documents), {sql_truncate(3520)},
        c AS (SELECT head AS context, {sql_tokens('text')} AS corpus_tokens, {sql_tokens('head')} AS context_tokens FROM truncated JOIN docs_ USING (doc_id))
        SELECT *, round(least(1.0::DOUBLE, context_tokens / corpus_tokens::DOUBLE), 4) AS coverage, greatest(0, corpus_tokens - context_tokens) AS dropped_tokens FROM c""",
)
def naive_context(spark, sf_dir):
    return evaluate.naive_context(document_units(spark, sf_dir), 3520)


@query(
    "parse_speed",
    "SELECT p_partkey, m AS model, 'tg128' AS test, ((p_partkey % 40) + 0.25)::DOUBLE AS speed, 0.5::DOUBLE AS stdev FROM (SELECT p_partkey, 'model ' || p_brand AS m FROM part)",
)
def parse_speed(spark, sf_dir):
    k = F.col("p_partkey")
    row = F.concat(F.lit("| model | size | test | t/s |\n|---|---|---|---|\n| model "), "p_brand", F.lit(" | 1.1 GiB | tg128 | "), (k % 40).cast("string"), F.lit(".25 ± 0.50 |\n"))
    return evaluate.parse_speed(read(spark, sf_dir, "part").select("p_partkey", row.alias("text")))


# -- X and the whole plan ----------------------------------------------------------------


@query(
    "illegal_transitions",
    """SELECT user_id, event_id, event_type, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
       WHERE before IS NOT NULL AND NOT (before || '>' || event_type) IN ('view>click', 'click>view', 'view>view')""",
)
def illegal_transitions(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    legal = [("view", "click"), ("click", "view"), ("view", "view")]
    return ask_plan.illegal_transitions(e, legal, "user_id", "event_type", "at").select("user_id", "event_id", "event_type", "before")


def session_moves(spark, sf_dir) -> DataFrame:
    """Events as moves of their users' sessions: mostly along the lifecycle, some astray."""
    e = read(spark, sf_dir, "events")
    names = F.array(*map(F.lit, lifecycle.STATES))
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("at"), F.get(names, ((F.col("event_id") * 7 + F.col("user_id")) % 10).cast("int")).alias("state"))


_MOVES_SQL = f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, {sql_list(lifecycle.STATES)}[(event_id * 7 + user_id) % 10 + 1] AS state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    walk AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS state, NULL::VARCHAR AS before, false AS legal, 'idle' AS now FROM e WHERE n = 1 UNION ALL
             SELECT user_id, n, event_id, state, now, legal, CASE WHEN legal THEN state ELSE now END
             FROM (SELECT e.*, w.now, list_contains({sql_list(f"{a}>{b}" for a, bs in lifecycle.MOVES.items() for b in bs)}, w.now || '>' || e.state) AS legal FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
    SELECT user_id AS session_id, event_id AS at, state, before, legal FROM walk WHERE n > 0
"""


@query("session_lifecycle", _MOVES_SQL)
def session_lifecycle(spark, sf_dir):
    return lifecycle.replay(session_moves(spark, sf_dir))


@query("stream_lifecycle", _MOVES_SQL)
def stream_lifecycle(spark, sf_dir):
    """The same moves from a stream of files, judged under a checkpoint and written by a file sink."""
    root = f"{shared_dir(spark)}/lifecycle-{uuid.uuid4().hex}"
    events = telemetry.read_events(spark, sf_dir, schema=read(spark, sf_dir, "events").schema)
    names = F.array(*map(F.lit, lifecycle.STATES))
    moves = events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("at"), F.get(names, ((F.col("event_id") * 7 + F.col("user_id")) % 10).cast("int")).alias("state"))
    out = sessions.judged(moves)
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{root}/moves")
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/moves").drop("depth")


@query(
    "run_contract",
    f"""WITH l AS (SELECT user_id::VARCHAR AS request_id, event_id AS n, {sql_list([*contract.STAGES, 'unlisted'])}[event_id % 11 + 1] AS stage, event_id % 11 AS place, event_type = 'error' AS failed, event_id % 2 = 0 AS told FROM events),
        o AS (SELECT *, lag(stage) OVER w AS before, lag(place) OVER w AS last_place FROM l WHERE place < 10 WINDOW w AS (PARTITION BY request_id ORDER BY n)),
        r AS (SELECT user_id, count(*) * 10 AS tokens FROM events GROUP BY user_id)
        SELECT request_id, 'order' AS rule, stage || ' after ' || before AS detail FROM o WHERE place < last_place
        UNION ALL SELECT request_id, 'unknown stage', stage FROM l WHERE place = 10 UNION ALL SELECT request_id, 'silent failure', stage FROM l WHERE failed AND NOT told
        UNION ALL SELECT user_id::VARCHAR, 'profile', 'none recorded' FROM r WHERE user_id % 7 = 0 UNION ALL SELECT user_id::VARCHAR, 'metrics', 'peak_rss_mb' FROM r WHERE user_id % 11 = 0
        UNION ALL SELECT user_id::VARCHAR, 'budget', tokens || ' of 150' FROM r WHERE tokens > 150
        UNION ALL SELECT user_id::VARCHAR, 'traceability', 'S' || event_id FROM events WHERE event_type = 'click' AND event_id % 13 = 0""",
)
def run_contract(spark, sf_dir):
    """Events as a log of stages, their users as runs, clicks as evidence."""
    e = read(spark, sf_dir, "events").withColumn("request_id", F.col("user_id").cast("string"))
    names = F.array(*map(F.lit, [*contract.STAGES, "unlisted"]))
    errors = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("E"))).otherwise(F.array().cast("array<string>"))
    log = e.select("request_id", F.col("event_id").alias("n"), F.get(names, (F.col("event_id") % 11).cast("int")).alias("stage"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), errors.alias("errors"))
    runs = e.groupBy("request_id", "user_id").agg(F.sum("value").alias("total_ms"), (F.count("*") * 10).alias("prompt_tokens"))
    runs = runs.withColumns({"profile_id": F.when(F.col("user_id") % 7 != 0, "p"), "peak_rss_mb": F.when(F.col("user_id") % 11 != 0, 1.0), "usable_tokens": F.lit(150)})
    clicks = e.where("event_type = 'click'").select("request_id", F.concat(F.lit("S"), "event_id").alias("label"), F.when(F.col("event_id") % 13 != 0, "u").alias("unit_id"), F.col("event_type").alias("document_name"))
    return contract.violations(log, runs, clicks)


@query("ask_batch")
def ask_batch(spark, sf_dir):
    """Ingest to metrics in one job: all benchmark items against all documents."""
    docs = headed(spark, sf_dir).withColumn("text", T.normalize(F.col("text")))
    return ask_plan.ask(ask_plan.prepare(docs), questions(spark, sf_dir)).metrics


@query(
    "stream_statistics",
    """WITH d AS (SELECT date_trunc('day', ts) AS start, event_type, value FROM events), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
       SELECT start, event_type, count(value) AS samples, round(sum(value), 4) AS total, round(min(value), 4) AS minimum, round(max(value), 4) AS maximum
       FROM d, m WHERE start + INTERVAL 1 DAY <= mark GROUP BY 1, 2""",
)
def stream_statistics(spark, sf_dir):
    """The stream's closed windows, by one available-now trigger over the events table."""
    root = f"{shared_dir(spark)}/statistics-{uuid.uuid4().hex}"
    events = telemetry.read_events(spark, sf_dir, schema=read(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = telemetry.windowed_statistics(events)
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{root}/windows")
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/windows").drop("p95", "mean", "stdev").withColumn("start", F.col("start").cast("timestamp_ntz"))
