"""The queries of this folder, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, language, licenses, mixing, packing, prefix_trie, revisits, secret_scan, simhash, tokens, vectors, whitening
from .common import table, words

VOCABULARY = "word_bpe_49k.json"


def op1_budgeted_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
    return chat.digest(chat.windows(turns.unionByName(said), tokens.vocabulary_path(VOCABULARY)))


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents"), tokens.vocabulary_path(VOCABULARY)))


def op3_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op4_projection_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.digest(revisits.resolve(revisits.captures(table(spark, sf_dir, "pages"))))


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = secret_scan.dictionary(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "benchmark"))
    return secret_scan.digest(secret_scan.scan(docs, words, path="source"))


def op7_byte_network_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = language.learn(docs.where(~language.held_out()))
    return language.identify(docs.select("doc_id", "text"), network).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op8_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.vocabulary_path(VOCABULARY))


def op10_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op12_sequence_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")))


def op13_quality_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents"), mixing.qualities(table(spark, sf_dir, "labels"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_budgeted_chat_windows, op2_cost_balanced_packing, op3_license_set_join, op4_projection_collisions, op5_revisit_resolution,
        op6_secret_forest, op7_byte_network_language, op8_simhash_balls, op9_token_counts, op10_winnowing_decontamination,
        op11_qd_whitening, op12_sequence_collapse, op13_quality_sampling)
}

#: Words of op10 in SQL.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sql_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def sql_list(found: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in found) + "]"


#: Templates as sets of words, block size and stride for the SQL of op3.
SQL_TEMPLATES = ", ".join(f"('{label}', {sql_list(sorted(set(words(text))))}, " + ", ".join(f"{sql_list(words(d))}::VARCHAR[]" for d in licenses.DISTINGUISHING[label]) + ")" for label, text in licenses.TEMPLATES.items())
SQL_BLOCK = 2 * max(len(words(text)) for text in licenses.TEMPLATES.values())

ORACLES: dict[str, str] = {
    "op3_license_set_join": f"""
WITH d AS (SELECT doc_id, {sql_words("text")} AS w FROM documents),
t(label, t, must, bar) AS (VALUES {SQL_TEMPLATES}),
b AS (SELECT doc_id, list_distinct(list_slice(w, s + 1, s + {SQL_BLOCK})) AS b
      FROM (SELECT doc_id, w, unnest(range(0, len(w), {SQL_BLOCK // 2})) AS s FROM d)),
m AS (SELECT doc_id, label, max(n / len_t) AS share
      FROM (SELECT doc_id, label, len(list_intersect(b, t)) AS n, len(t) AS len_t FROM b, t WHERE list_has_all(b, must) AND NOT list_has_any(b, bar)) WHERE n >= ceil(0.8 * len_t - 1e-9) GROUP BY ALL),
p(label, p) AS (VALUES ('gpl', ['gnu', 'general', 'public', 'license']), ('apache', ['apache', 'license']), ('cc-by', ['cc', 'by']), ('mit', ['mit', 'license'])),
h AS (SELECT doc_id, label, i FROM (SELECT doc_id, label, p, w, unnest(range(0, len(w) - len(p) + 1)) AS i FROM d, p WHERE len(w) >= len(p))
      WHERE list_slice(w, i + 1, i + len(p)) = p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM (SELECT doc_id, label FROM h UNION ALL SELECT doc_id, label FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::double ELSE coalesce(share, 0)::double END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op5_revisit_resolution": r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare, coalesce(html, '') AS html FROM pages),
k AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS q FROM a),
c AS (SELECT page_id, html, '"' || substr(md5(html), 1, 16) || '"' AS etag,
        regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '')
        || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '(\.html?|/)$', '')
        || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM k),
r AS (SELECT url_key, page_id * 10 AS ts, page_id * 2 AS record_id, etag, sha256(html) AS digest, octet_length(encode(html)) AS size FROM c),
v AS (SELECT url_key, page_id * 10 + (page_id * 7919) % 50000 AS ts, page_id * 2 + 1 AS record_id, page_id % 60 AS age,
        CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"other"' ELSE etag END AS etag FROM c),
j AS (SELECT v.record_id, v.url_key, v.ts, v.age, v.etag, arg_max(r, {'ts': r.ts, 'id': r.record_id}) AS r
      FROM v LEFT JOIN r ON r.url_key = v.url_key AND (r.ts < v.ts OR (r.ts = v.ts AND r.record_id < v.record_id)) GROUP BY ALL),
s AS (SELECT *, CASE WHEN r.record_id IS NULL THEN 'orphan' WHEN etag IS NULL THEN 'unproven' WHEN etag = r.etag THEN 'resolved' ELSE 'changed' END AS status FROM j)
SELECT record_id, url_key, status, r.record_id AS response_id, CASE WHEN status = 'resolved' THEN r.digest END AS digest,
  CASE WHEN status = 'resolved' THEN 'age: ' || age || chr(10) || 'content-length: ' || r.size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || r.etag END AS headers
FROM s""",
    "op10_winnowing_decontamination": f"""
WITH d AS (SELECT doc_id, {sql_words("text")} AS w FROM documents),
b AS (SELECT item_id, {sql_words("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(g) AS n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
      FROM (SELECT DISTINCT doc_id, item_id::varchar AS s FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op12_sequence_collapse": r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS q FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, list({'role': role, 'text': text} ORDER BY q) AS s FROM t GROUP BY c),
h AS (SELECT c, s, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT), lambda a, b:
               list_reduce([xor(a, b), 0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END), 4294967295::UBIGINT),
             4294967295::UBIGINT) % 4 AS h FROM s),
r AS (SELECT h.c, list_slice(coalesce(b.s, []), 1, h.h) || list_slice(h.s, h.h + 1, len(h.s)) AS s FROM h LEFT JOIN s AS b ON b.c = h.c - h.c % 20),
m AS (SELECT c, s, d, list_slice(s, 1, d) AS p FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, coalesce(len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')), 0) AS w,
        coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '') AS ends FROM m GROUP BY d, p),
k AS (SELECT d - 1 AS d, list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
u AS (SELECT v.conv_id, v.d AS d, unnest(range(0, v.d + 1)) AS a, p, (n_convs - 1) * w AS saved, n_children IS NULL AS leaf FROM n AS v LEFT JOIN k USING (d, p)),
g AS (SELECT a AS d, list_slice(p, 1, a) AS p, sum(saved) AS saved_tokens, sum(leaf::INT) AS n_leaves FROM u GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, g.n_leaves::BIGINT AS n_leaves, g.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN g USING (d, p) LEFT JOIN k ON k.d = n.d AND k.p = n.p LEFT JOIN n AS up ON up.d = n.d - 1 AND up.p = list_slice(n.p, 1, n.d - 1)""",
    "op13_quality_sampling": r"""
WITH q AS (SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0 ELSE 0.5 END::DOUBLE AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(text, '') AS text,
        -ln((('0x' || md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / coalesce(quality, 1.0::DOUBLE) AS key
      FROM documents AS d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS i, sum(source_size) OVER () AS t FROM s),
l AS (SELECT *, t - coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
f AS (SELECT min(i) AS first FROM l WHERE rest * w <= 3 * source_size * open),
e AS (SELECT rest::DOUBLE / open::DOUBLE AS share FROM l, f WHERE i = first),
p AS (SELECT l.source, source_size, CASE WHEN i < first THEN (3 * source_size)::DOUBLE ELSE least((3 * source_size)::DOUBLE, share * w) END AS target FROM l, f, e),
x AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
        sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
      FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, floor(target - epochs * source_size + 0.5)::BIGINT - before)))::BIGINT AS taken FROM x""",
}
