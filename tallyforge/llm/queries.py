"""The numbered queries: each applies its operator to a whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, lm, main_text, mixing, neardup, quality, repair, repeats, rules, secrets, spelling, token_files, warc, work

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded(table(spark, sf_dir, "documents"), tokenizer_path()).drop("shard")


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of a SHA-1: 32 digits of five bits each, from the 160 bits.
OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT page_id, html, h, list_aggregate(list_transform(range(1, 41), lambda i:
             substr('0000000100100011010001010110011110001001101010111100110111101111', (instr('0123456789abcdef', substr(h, i, 1)) - 1) * 4 + 1, 4)), 'string_agg', '') AS b FROM p),
d AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS last,
             list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + list_sum(list_transform(range(1, 6), lambda j: CAST(substr(b, k * 5 + j, 1) AS INTEGER) * CAST(power(2, 5 - j) AS INTEGER)))::INTEGER, 1)), 'string_agg', '') AS digest FROM bits)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM d
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    measured = work.written(quality.with_statistics(docs, keep=["doc_id"]), "statistics")
    known = quality.labelled(table(spark, sf_dir, "labels"))
    model = quality.fit(quality.in_order(measured.join(known, "doc_id")))
    scored = measured.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.col("item_ids")
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH upper_lower AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents, upper_lower),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark, upper_lower WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS g
        FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
              FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS g
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT r, i, n, item FROM grams JOIN win USING (n, g)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    spans = F.coalesce("found", F.expr("cast(array() as array<struct<start:int,rank:bigint,kind:string,end:int>>)"))
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["rank"] <= len(secrets.BASE))
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.learned_and_scored(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.repaired(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


#: Table of CRC-32 by byte, and the checksum of a key's bytes; two fixed polynomial constants.
CRC_SQL = r"""
crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([n::UBIGINT], list_transform(range(0, 8), lambda k: k::UBIGINT)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
sums AS (SELECT key, xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(0, strlen(key)),
            lambda i: (16 * (instr('0123456789ABCDEF', substr(hex(key), 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(key), 2 * i + 2, 1)) - 1)::UBIGINT)),
            lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) AS h
         FROM keys, crc)
"""

#: The best (cost, audit, text so far) for each last role, row by row; two insertions in a row are the most that can pay.
OP12_SQL = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                              coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
keys AS (SELECT DISTINCT key FROM raw),
{CRC_SQL},
kinds AS (SELECT raw.*, h % 20 AS kind FROM raw JOIN sums USING (key)),
rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(role || chr(0) || text), copy) AS k FROM rows),
faulty AS (SELECT conv_id, turn, role, text, k, left(role, 1) AS i,
                  CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
                       WHEN right(bare, 1) IN ('.', '!', '?') THEN '.' ELSE 't' END AS f FROM placed),
convs AS (SELECT DISTINCT conv_id FROM conversations),
counts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (f = 'b') AS blank,
                  count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (p || i NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
           FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS p FROM faulty) GROUP BY conv_id),
-- edges out of each last role by what a row is; done: rows so far; s: '' nothing, else the last initial
closed AS (SELECT * FROM (VALUES ('', '', 0, '', ''), ('', 'u', 5, 'I', 'user:'), ('', 'a', 10, 'II', 'user:' || chr(10) || 'assistant:'), ('s', 's', 0, '', ''), ('s', 'u', 5, 'I', 'user:'),
              ('s', 'a', 10, 'II', 'user:' || chr(10) || 'assistant:'), ('u', 'u', 0, '', ''), ('u', 'a', 5, 'I', 'assistant:'), ('a', 'a', 0, '', ''), ('a', 'u', 5, 'I', 'user:')) AS c(s, z, price, letters, said)),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS done, z AS s, CAST(price AS BIGINT) AS cost, letters AS audit, said FROM convs, closed WHERE s = ''
  UNION ALL
  SELECT conv_id, done, s, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) AS r FROM (
      SELECT e.conv_id, e.done, c.z AS s, e.cost + c.price AS cost, e.audit || c.letters AS audit, e.said || CASE WHEN e.said <> '' AND c.said <> '' THEN chr(10) ELSE '' END || c.said AS said FROM (
        SELECT p.conv_id, p.done + 1 AS done, x.z AS s, p.cost + x.price + CASE WHEN x.letter <> 'D' AND f.f = 't' THEN 5 ELSE 0 END AS cost, p.audit || x.letter AS audit,
               p.said || CASE x.letter WHEN 'D' THEN '' ELSE CASE WHEN p.said <> '' THEN chr(10) ELSE '' END || coalesce(x.name, f.role) || ':' || f.text END AS said
        FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.k = p.done + 1
        JOIN (SELECT s, s AS z, 'D' AS letter, 2 AS price, NULL AS name, '' AS i FROM (VALUES (''), ('s'), ('u'), ('a')) AS d(s)
              UNION ALL SELECT * FROM (VALUES ('', 'u', 'R', 1, 'user', ''), ('s', 'u', 'R', 1, 'user', ''), ('a', 'u', 'R', 1, 'user', ''), ('u', 'a', 'R', 1, 'assistant', '')) AS g(s, z, letter, price, name, i)
              UNION ALL SELECT s, i, 'K', 0, NULL, i FROM (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')) AS h(s, i)) x
          ON x.s = p.s AND (x.letter = 'D' OR f.f IN ('.', 't')) AND (x.letter <> 'K' OR x.i = f.i)) e
      JOIN closed c ON c.s = e.s)) WHERE r = 1),
best AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.conv_id ORDER BY cost, audit) AS r FROM paths p LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id
                        WHERE done = coalesce(n, 0) AND s IN ('', 'a')) WHERE r = 1)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cost, audit, sha256(said) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


OP13_SQL = rf"""
WITH RECURSIVE runs AS (SELECT doc, word, count(*) AS times FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS word FROM documents) GROUP BY ALL),
keys AS (SELECT doc || ':' || word AS key FROM runs),
{CRC_SQL},
kept AS (SELECT CASE WHEN h % 97 = 0 THEN substr(word, 1, CAST(h % length(word) AS BIGINT)) || substr(word, CAST(h % length(word) AS BIGINT) + 2) ELSE word END AS word, times
         FROM runs JOIN sums ON key = doc || ':' || word),
w AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
shorter AS (SELECT DISTINCT w.word AS short, w.n AS short_n, less.word AS long, less.n AS long_n FROM less JOIN w ON w.word = less.a || less.b),
near AS (SELECT x.word, y.word AS near, y.n AS near_n FROM less x JOIN less y USING (a, b) WHERE x.word <> y.word
         UNION ALL SELECT short, long, long_n FROM shorter UNION ALL SELECT long, short, short_n FROM shorter),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT chain.word, form FROM chain JOIN forms ON forms.word = root WHERE form IS NOT NULL)
SELECT word, form, root, forms.n, n_near, form_n FROM forms
JOIN (SELECT chain.word, root FROM chain JOIN forms ON forms.word = root WHERE form IS NULL) USING (word)
"""


QUERIES: dict[str, Query] = {
    "op1_token_files": op1_token_files,
    "op2_repeated_strings": op2_repeated_strings,
    "op3_warc_segments": op3_warc_segments,
    "op4_quality_rules": op4_quality_rules,
    "op5_contamination": op5_contamination,
    "op6_secrets": op6_secrets,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_mixing": op8_mixing,
    "op9_quality_bands": op9_quality_bands,
    "op10_language_model": op10_language_model,
    "op11_main_text": op11_main_text,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op3_warc_segments": OP3_SQL,
    "op5_contamination": OP5_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
