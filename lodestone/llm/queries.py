"""The registered queries of this folder, ``opN_<name>(spark, sf_dir)``, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, fill_middle, html_extract, line_dedup, merkle, mixing, ngrams, packing, quality, secrets, simhash, spelling, substring_dedup

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.remove_repeated_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(_documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return done.select("doc_id", *quality.COUNTS, "base_failed", "kept", "good")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(_documents(spark, sf_dir))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir)).drop("found")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_documents(spark, sf_dir))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(_documents(spark, sf_dir))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.transform(_documents(spark, sf_dir))
    back = fill_middle.restored(done.output, done.form)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op1_quality_rules``."""
    return op1_quality_rules(spark, sf_dir).select("doc_id", *quality.COUNTS, "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op8_source_mixing``: sizes, and targets to six places."""
    return op8_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op10_secret_scan``."""
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Query] = {"op1_quality_rules": op1_quality_rules, "op3_line_dedup": op3_line_dedup, "op4_substring_dedup": op4_substring_dedup, "op2_document_fingerprints": op2_document_fingerprints, "op9_simhash_near_dedup": op9_simhash_near_dedup, "op5_lm_scoring": op5_lm_scoring, "op6_packing": op6_packing, "op7_html_extraction": op7_html_extraction, "op8_source_mixing": op8_source_mixing, "op10_secret_scan": op10_secret_scan, "op11_fill_middle": op11_fill_middle, "op12_exact_dedup": op12_exact_dedup, "op13_spelling_variants": op13_spelling_variants, "quality_counts": quality_counts, "mixing_targets": mixing_targets, "secret_counts": secret_counts}


def _crc_sql(text: str) -> str:
    """The crc32 of a text of ASCII and of U+00C0 to U+00FF, by a table that is made from its rule."""
    table = []
    for state in range(256):
        for _ in range(8):
            state = state >> 1 ^ 0xEDB88320 if state & 1 else state >> 1
        table.append(state)
    of_bytes = f"flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64] END FOR c IN string_split({text}, '')])"
    return f"xor(4294967295, list_reduce({of_bytes}, lambda a, b: xor(a >> 8, {table}[xor(a & 255, b) + 1]), 4294967295))"


SQL: dict[str, str] = {
    "op11_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l, sha256('7:' || doc_id) AS x FROM documents),
        c AS (SELECT *, len(l) - (l[len(l)] = '')::BIGINT AS n, [('0x' || substr(x, 8 * k + 1, 8))::UBIGINT::BIGINT FOR k IN range(4)] AS h FROM d),
        r AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS i, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS j,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
        p AS (SELECT *, CASE WHEN i < len(l) THEN length(array_to_string(l[1:i] || [''], chr(10))) ELSE length(t) END AS a, CASE WHEN j < len(l) THEN length(array_to_string(l[1:j] || [''], chr(10))) ELSE length(t) END AS b FROM r),
        o AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM p)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM o""",
    "op12_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)""",
    "op13_spelling_variants": rf"""
        WITH RECURSIVE r AS MATERIALIZED (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
        c AS (SELECT run, n, {_crc_sql("doc_id || ':' || run")} AS h FROM r WHERE length(run) >= 6),
        v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM c) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
        near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
            UNION SELECT x.word, v.word, v.n FROM x JOIN v ON v.word = x.less UNION SELECT v.word, x.word, x.n FROM x JOIN v ON v.word = x.less),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
        f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
        walk AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT w.word, w.next, f.form FROM walk w JOIN f ON f.word = w.next)
        SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL""",
    "op3_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        w AS (SELECT doc_id, n, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
        late AS (SELECT doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, n) AS r FROM w WHERE c IS NOT NULL) WHERE r > 1),
        gone AS (SELECT DISTINCT s.doc_id, s.pos FROM (SELECT doc_id, n + unnest([0, 1, 2]) AS n FROM late) x JOIN s USING (doc_id, n))
        SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
               sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id""",
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE doc_id > least),
        gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS pos FROM late),
        t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
        k AS (SELECT t.doc_id, count(g.pos) AS n_removed, string_agg(t.word, ' ' ORDER BY t.pos) FILTER (WHERE g.pos IS NULL) AS kept
              FROM t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.pos = g.pos GROUP BY t.doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "quality_counts": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
        win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d))),
        r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, i + unnest(range(0, 8)) AS pos FROM win WHERE n > 1) GROUP BY doc_id),
        c AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
              FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c""",
    "mixing_targets": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
        o AS (SELECT *, 3.0::DOUBLE * source_size / weight AS most, row_number() OVER w AS n, sum(3 * source_size) OVER w - 3 * source_size AS held, sum(weight) OVER () - sum(weight) OVER w + weight AS free
              FROM s WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
        v AS (SELECT arg_min(level, n) AS level FROM (SELECT n, most, ((SELECT sum(source_size) FROM s) - held)::DOUBLE / free AS level FROM o) WHERE level <= most * 1.000000001 + 1e-9)
        SELECT doc_id, size, source_size, round(least(3.0::DOUBLE * source_size, weight * level), 6) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, v""",
    "secret_counts": r"""
        SELECT doc_id, len([x FOR x IN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) IF length(x) >= 6]) AS n_assign,
               len(regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}')) AS n_access, len(regexp_extract_all(t, '[0-9a-f]{24,}')) AS n_hex
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
}
