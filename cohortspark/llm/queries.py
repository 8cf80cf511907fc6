"""Registered queries of this subpackage: each applies its operator to the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.llm import (automaton_dedup, backoff_automaton, boosted_rules, byte_bpe, edit_leaks, kneser_ney, middle_fill, noisy_or,
                             run_merge, shingle_join, suffix_dedup, template_dedup, token_alignment)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return keep


#: Words of a text in SQL.
WORDS = r"regexp_extract_all(%s, '[^\x20\x09-\x0D]+')"

# Windows by their digests; runs of places that overlap or touch are one span, and what lies between spans is kept.
REPEATED_WORDS = f"""
WITH d AS (SELECT doc_id, {WORDS % "coalesce(text, '')"} AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n FROM d),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, n - 48)) AS i FROM n WHERE n >= 50)),
hit AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS first FROM win GROUP BY h) USING (h) WHERE first < doc_id),
edge AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -99) + 50 AS fresh FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edge) GROUP BY doc_id, k),
gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS lo, a AS hi, z - a AS cut FROM span
  UNION ALL SELECT n.doc_id, coalesce(max(z), 1), n.n + 1, 0 FROM n LEFT JOIN span USING (doc_id) GROUP BY n.doc_id, n.n)
SELECT doc_id, any_value(n) AS n_words, sum(cut)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(array_to_string(w[lo:hi - 1], ' '), ' ' ORDER BY lo) FILTER (hi > lo), '')) AS kept_sha256
FROM gap JOIN n USING (doc_id) GROUP BY doc_id"""

# The bytes as hexadecimal text, in parts that overlap by a window, as cutting a long text from its start takes long.
REPEATED_BYTES = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS x FROM documents),
n AS (SELECT doc_id, x, strlen(x) // 2 AS n FROM d),
part AS (SELECT doc_id, s, x[2 * s + 1:2 * s + 1822] AS y, least(512, n - 399 - s) AS k FROM (SELECT *, unnest(range(0, n - 399, 512)) AS s FROM n WHERE n >= 400)),
win AS (SELECT doc_id, s + i AS i, md5(y[2 * i + 1:2 * i + 800]) AS h FROM (SELECT *, unnest(range(0, k)) AS i FROM part)),
hit AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
edge AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -999) + 400 AS fresh FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edge) GROUP BY doc_id, k),
gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi, z - a AS cut, 1 AS one FROM span
  UNION ALL SELECT n.doc_id, coalesce(max(z), 0), n.n, 0, 0 FROM n LEFT JOIN span USING (doc_id) GROUP BY n.doc_id, n.n)
SELECT doc_id, any_value(n) AS n_bytes, sum(cut)::BIGINT AS n_removed, sum(one)::BIGINT AS n_spans,
       sha256(unhex(string_agg(x[2 * lo + 1:2 * hi], '' ORDER BY lo))) AS kept_sha256
FROM gap JOIN n USING (doc_id) GROUP BY doc_id"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SIMILAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS % LOWER} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT link.b, c FROM reach JOIN link ON link.a = doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, (SELECT count(*) FROM link WHERE a = d.doc_id) AS n_links
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id"""


@register("op1_automaton_dedup", REPEATED_WORDS)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = automaton_dedup.remove_repeated_words(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.PATTERN)


@register("op7_suffix_dedup", REPEATED_BYTES)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"), length=400, keep="none")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op9_template_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_dedup.drop_recurring(table(spark, sf_dir, "documents"))


@register("op10_boosted_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return boosted_rules.rules(docs, boosted_rules.train(docs, table(spark, sf_dir, "labels")))


@register("op4_shingle_join", SIMILAR)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join(table(spark, sf_dir, "documents"), size=5, percent=80)


@register("op2_noisy_or")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = noisy_or.scored(docs, noisy_or.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").cast("bigint").alias("n_offending"))


@register("op5_edit_leaks")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edit_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_matches", "contaminated",
                        F.array_join(F.array_sort(F.transform("matches", lambda m: m["item_id"])), " ").alias("item_ids"))


@register("op8_backoff_automaton")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_automaton.scores(table(spark, sf_dir, "documents"))


@register("op3_kneser_ney")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


@register("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.scores(token_alignment.corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                                         public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")))


@register("op12_run_merge", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_merge.copies(table(spark, sf_dir, "documents"), keep="largest")


@register("op13_middle_fill", """
    WITH units AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
             regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
      FROM documents),
    hashes AS (
      SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
             ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM units),
    cuts AS (
      SELECT *, least(h1 % (n + 1)::UBIGINT, h2 % (n + 1)::UBIGINT)::BIGINT AS a, greatest(h1 % (n + 1)::UBIGINT, h2 % (n + 1)::UBIGINT)::BIGINT AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
                  THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM hashes),
    parts AS (
      SELECT *, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m,
             array_to_string(list_slice(u, b + 1, n), '') AS s FROM cuts)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(text) AS restored_sha256 FROM parts""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_fill.digests(table(spark, sf_dir, "documents"))


# The counted columns of two operators whose verdicts and scores SQL cannot state.
QUALITY_BASE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS % "coalesce(text, '')"} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
hit AS (SELECT doc_id, i FROM win JOIN (SELECT doc_id, h FROM win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, h)),
again AS (SELECT doc_id, sum(least(8, i - coalesce(before, -99)))::BIGINT AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
every AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(line.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words FROM d LEFT JOIN line USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM every"""


@register("quality_base", QUALITY_BASE)
def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


# CRC-32 of the decimal id, bit by bit.
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda x, b: list_reduce(list_concat([xor(x, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT)"""
BACKOFF_BASE = f"""
WITH d AS (SELECT doc_id, {CRC} % 5 = 1 AS held_out, list_append({WORDS % LOWER}, chr(10)) AS w FROM documents),
token AS (SELECT doc_id, held_out, unnest(w) AS t FROM d),
known AS (SELECT t, count(*) AS c FROM token WHERE NOT held_out GROUP BY t),
size AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM known)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens,
       round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 5) + 0.0 AS base_score
FROM token LEFT JOIN known USING (t), size GROUP BY doc_id, held_out"""


@register("backoff_base", BACKOFF_BASE)
def backoff_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", (F.round("base_score", 5) + F.lit(0.0)).alias("base_score"))
