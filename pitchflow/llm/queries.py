"""Queries that apply each operator to its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read
from .decontaminate import find_benchmark
from .lang_id import held_out, identify_languages, train_language_id
from .lattice import score_texts
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .mixing import mix_sources
from .quality_classifier import classify_quality
from .quality_rules import judge_quality
from .search import JAVA_TERM, build_index, search
from .token_output import write_training_order
from .url_filter import filter_urls
from .warc import page_captures
from .whitening import whiten

URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MIX_SEED = 7
#: Weights of the mixture by path (domain, language, source); what isn't named weighs 1 among its siblings.
MIX_WEIGHTS = {("crawl",): 0.3, ("forum",): 0.35, ("books",): 0.35, ("crawl", "en"): 4.0, ("forum", "en"): 4.0, ("books", "en"): 4.0}
MIX_FRACTION, MIX_EPOCHS = 0.8, 2
ORDER_KEY = 20_240_601


def _rules(spark: SparkSession) -> DataFrame:
    return spark.sql("VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(host, path, verdict)")


def mix_domain():
    """The domain of a source: one crawl, nine forums, the rest books."""
    return F.when(F.col("source") == "src0", "crawl").when(F.col("source").rlike("^src[1-9]$"), "forum").otherwise("books")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), _rules(spark))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train_language_id(docs.filter(~held_out()))
    return identify_languages(docs.select("doc_id", "text", held_out().alias("held_out")), net).drop("text")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix_sources(docs, mix_domain(), MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED).select("doc_id", "mix.domain", "lang", "source", "mix.n_tokens", "mix.epoch", "mix.taken")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_training_order(read(spark, sf_dir, "documents"), key=ORDER_KEY)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_captures(read(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"), min_documents=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(read(spark, sf_dir, "embeddings"), components=8)
    each = out.select("vec_id", "n", F.col("deviation").cast("bigint").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"), "explained", "identity_error")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"), k=20)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score_texts(read(spark, sf_dir, "documents"), apart)


def queries() -> dict:
    ops = (op1_url_filters, op2_language_id, op3_source_mixing, op4_token_output, op5_quality_rules, op6_warc, op7_quality_classifier, op8_decontamination, op9_line_dedup, op10_minhash, op11_whitening, op12_lexical_search, op13_lm_scoring)
    return {f.__name__: f for f in ops}


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rh, rp, rv) AS (VALUES {", ".join(map(str, URL_RULES))}),
fits AS (SELECT k, rh || rp AS rule, rv, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC, length(rh) DESC) AS rn
         FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM urls LEFT JOIN (SELECT * FROM fits WHERE rn = 1) USING (k)
"""

_DIGIT = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(hex, {1 + 5 * g}, 5))::BIGINT >> {s}) & 31 AS INTEGER), 1)" for g in range(8) for s in (15, 10, 5, 0))
OP6_SQL = f"""
WITH raw AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
told AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_DIGIT} AS payload_digest, min(page_id) OVER (PARTITION BY hex) AS first_id FROM raw)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM told
"""

OP9_SQL = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keys AS (SELECT *, translate(trim(line, {_SPACES}), {_LOWER}) AS k FROM lines),
common AS (SELECT k FROM keys WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM keys LEFT JOIN common c ON keys.k = c.k GROUP BY doc_id
"""

OP10_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_both FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * n_both >= 85 * (na + nb - n_both)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT sym.b, reach.c FROM reach JOIN sym ON sym.a = reach.doc_id),
least_id AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_id USING (doc_id)
"""

OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{JAVA_TERM}') AS t FROM documents),
every AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM docs WHERE len(t) > 0),
ms AS (SELECT d, doc_id, 75 + (25 * len(t) * n_docs) // n_terms AS m FROM docs, every WHERE len(t) > 0),
tfs AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(t) AS term FROM docs) GROUP BY ALL),
ws AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, every GROUP BY term),
asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{JAVA_TERM}')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT q, item_id, d, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM asked JOIN ws USING (term) JOIN tfs USING (term) JOIN ms USING (d) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op6_warc": OP6_SQL, "op9_line_dedup": OP9_SQL, "op10_minhash": OP10_SQL, "op12_lexical_search": OP12_SQL}


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language or with a doubtful one; fills in a missing language.

    Documents without a letter or text go. A row is judged by its own text, repeats alike; a null id is in the training part.
    Without a labelled text there is no network and every document goes. All columns but a null ``lang`` come
    back as they were, whatever their names; an empty table gives an empty result.
    """
    net = train_language_id(docs.filter(~held_out()))
    apart = {c: free_name(docs.columns, f"kept_{c}") for c in docs.columns if c.lower() in ("lang_pred", "score")}
    judged = identify_languages(docs.withColumnsRenamed(apart), net).filter("lang_pred <> 'und' AND score >= 0.3")
    filled = judged.withColumn("lang", F.coalesce("lang", "lang_pred")).drop("lang_pred", "score")
    return filled.withColumnsRenamed({v: k for k, v in apart.items()}).select(*docs.columns)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mixture takes, whole or in part, as often as it takes them.

    A null source is of the domain books; null sources and languages are leaves of their own. A document without words is
    never taken. Ties of the seeded order go by the row, repeats count each. All columns come back as they were, whatever
    their names; an empty table gives an empty result.
    """
    name = free_name(docs.columns, "own_mix")
    held = docs.withColumnRenamed("mix", name) if "mix" in docs.columns else docs
    out = mix_sources(held, mix_domain(), MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED).drop("mix")
    return out.withColumnRenamed(name, "mix").select(*docs.columns)


