"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, decontaminate, exact_dedup, licenses, lm_score, near_dup, packing, quality, sharding, token_file, tokens, url_rules

#: (verdict, host, path)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def trusted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("trusted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.placed(common.table(spark, sf_dir, "documents"))
    return quality.classify(docs, trusted_labels(spark, sf_dir)).drop("place")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "token-file")
    docs = common.table(spark, sf_dir, "documents")
    token_file.write_token_file(docs, path, tokens.public_path("word_bpe_49k.json"), end_id=2)
    return token_file.with_ids_crc32(token_file.read_token_file(spark, path), ["doc_id", "start", "n_tokens"])


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return url_rules.judge_urls(common.table(spark, sf_dir, "pages"), URL_RULES, labels)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (common.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.decontaminate(common.placed(docs), benchmark).drop("place", "spans")


def op5_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = trusted_labels(spark, sf_dir).filter("trusted").select("doc_id")
    scored = lm_score.cross_entropy_difference(common.table(spark, sf_dir, "documents"), target)
    return scored.select("doc_id", "n_tokens", *(F.round(c, 4).alias(c) for c in ("target_loss", "background_loss", "score")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(common.table(spark, sf_dir, "documents")).drop("found")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(common.table(spark, sf_dir, "documents"))
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, tokens.public_path("byte_bpe_50k.json"), end_id=1)
    return packed.drop("bucket", "ids")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.jaccard_components(common.table(spark, sf_dir, "documents"))


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = common.text_or_empty()
    docs = common.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return sharding.histogram_shards(docs, 24, tolerance=0.0).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_token_file,
        op3_url_rules,
        op4_decontaminate,
        op5_cross_entropy_difference,
        op6_license_scan,
        op7_exact_dedup,
        op8_packing,
        op9_jaccard_join,
        op10_histogram_shards,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x + "'" for x in row) + ")" for row in rows)


def _starts(notice: str, phrase: str) -> int:
    listed, must = notice.split(), phrase.split()
    return next(i for i in range(len(listed)) if listed[i : i + len(must)] == must)


_TEMPLATES = _values((n, label, notice, phrase, _starts(notice, phrase)) for n, (label, phrase, notice) in enumerate(licenses.TEMPLATES))

_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in URL_RULES)

SQL = {
    "op3_url_rules": rf"""
WITH p AS (SELECT row_number() OVER () AS id, page_id, coalesce(url, '') AS u FROM pages),
h AS (SELECT id, page_id, u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
             regexp_replace(regexp_extract(u, '(?s)^[^?#]*\?([^#]*)', 1), '=[^&]*', '', 'g') AS query FROM p),
t AS (SELECT id, page_id, host, path, list_distinct(list_concat(
        ['scheme:' || split_part(u, '://', 1)],
        [('host:' || regexp_replace(x, '[0-9]+', '#', 'g')) FOR x IN string_split(host, '.') IF x <> ''],
        [('path:' || regexp_replace(x, '[0-9]+', '#', 'g')) FOR x IN regexp_split_to_array(path, '[/._-]+') IF x <> ''],
        [('query:' || regexp_replace(x, '[0-9]+', '#', 'g')) FOR x IN string_split(query, '&') IF x <> ''],
        CASE WHEN contains(u, '#') THEN ['fragment:'] ELSE [] END)) AS tokens FROM h),
known AS (SELECT doc_id AS page_id, bool_or(quality = 0) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT id, tokens, bad FROM t JOIN known USING (page_id)),
tokens AS (SELECT id, bad, unnest(tokens) AS item FROM labelled),
covers AS (SELECT item, count(*) AS n, count(*) FILTER (bad) AS n_bad, list(id ORDER BY id) AS cover FROM tokens GROUP BY item),
kept AS (SELECT min(item) AS item FROM covers WHERE n_bad >= 5 AND n < (SELECT count(*) FROM labelled) GROUP BY cover),
items AS (SELECT id, bad, list(item ORDER BY item) AS items FROM tokens JOIN kept USING (item) GROUP BY id, bad),
masks AS (SELECT items, unnest(range(1, CAST(2 ** len(items) AS BIGINT))) AS mask FROM items WHERE bad),
sets AS (SELECT [x FOR x, i IN items IF (mask >> (i - 1)) & 1 = 1] AS items, count(*) AS support FROM masks GROUP BY 1 HAVING count(*) >= 5),
counted AS (SELECT s.items, support, count(*) AS n FROM sets s JOIN items i ON list_has_all(i.items, s.items) GROUP BY s.items, support),
sure AS (SELECT items, support, support / n AS confidence FROM counted WHERE support / n >= 0.9),
fewer AS (SELECT items, confidence, [x FOR x IN items IF x <> item] AS less FROM (SELECT items, confidence, unnest(items) AS item FROM sure) x),
mined AS (SELECT * FROM sure WHERE items NOT IN (SELECT f.items FROM fewer f JOIN sure s ON s.items = f.less AND s.confidence >= f.confidence)),
by_rule AS (SELECT id, items, support, confidence, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, support DESC, items DESC) AS nth
            FROM t JOIN mined ON list_has_all(tokens, items)),
rules(verdict, rule_host, rule_path) AS (VALUES {_RULES}),
by_list AS (SELECT id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY id ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path DESC, verdict DESC) AS nth
            FROM t JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, l.rule, coalesce(l.verdict, CASE WHEN r.id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       array_to_string(r.items, ' ') AS mined_rule, r.support, r.confidence
FROM t LEFT JOIN by_list l ON l.id = t.id AND l.nth = 1 LEFT JOIN by_rule r ON r.id = t.id AND r.nth = 1""",
    "op5_cross_entropy_difference": f"""
WITH d AS (SELECT doc_id, {_words("text", _WORDS)} AS ws FROM documents),
target AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
e AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM target) AS mine, unnest(list_prepend('<', ws)) AS v, unnest(list_append(ws, '>')) AS w FROM d WHERE len(ws) > 0),
pairs AS (SELECT v, w, count(*) AS n_b, count(*) FILTER (mine) AS n_t FROM e GROUP BY v, w),
contexts AS (SELECT v, sum(n_b) AS all_b, sum(n_t) AS all_t FROM pairs GROUP BY v),
size AS (SELECT count(DISTINCT w) AS kinds FROM pairs),
priced AS (SELECT v, w, -ln(n_b / (all_b + 1)) AS b, -ln(CASE WHEN n_t > 0 THEN n_t ELSE 1.0 / kinds END / (all_t + 1)) AS t
           FROM pairs JOIN contexts USING (v), size),
losses AS (SELECT doc_id, avg(t) AS t, avg(b) AS b FROM e JOIN priced USING (v, w) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, round(t, 4) AS target_loss, round(b, 4) AS background_loss, round(t - b, 4) AS score
FROM d LEFT JOIN losses USING (doc_id)""",
    "op6_license_scan": f"""
WITH d AS (SELECT doc_id, {_words("text", _WORDS)} AS ws FROM documents),
templates(template, label, notice, phrase, start) AS (VALUES {_TEMPLATES}),
phrases(phrase, base_label) AS (VALUES {_values(licenses.BASE)}),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
looked(phrase, words) AS (SELECT phrase, string_split(phrase, ' ') FROM (SELECT phrase FROM templates UNION SELECT phrase FROM phrases) x),
places AS (SELECT u.doc_id, phrase, pos FROM u JOIN looked ON u.word = words[1] JOIN d ON d.doc_id = u.doc_id AND ws[pos + 1:pos + len(words)] = words),
base AS (SELECT doc_id, pos, base_label FROM places JOIN phrases USING (phrase)),
candidates AS (SELECT doc_id, template, label, pos - start AS offs, len(string_split(notice, ' ')) AS size,
                      unnest(string_split(notice, ' ')) AS word, unnest(range(len(string_split(notice, ' ')))) + pos - start AS pos
               FROM places JOIN templates USING (phrase)),
found AS (SELECT doc_id, template, label, offs, count(*) / size AS share FROM candidates JOIN u USING (doc_id, pos, word)
          GROUP BY doc_id, template, label, offs, size HAVING count(*) >= {licenses.COVERAGE} * size),
b AS (SELECT doc_id, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word FROM base GROUP BY doc_id),
named AS (SELECT doc_id, base_label AS label, true AS is_base FROM base UNION SELECT doc_id, label, false FROM found),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels
      FROM named GROUP BY doc_id),
f AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "op4_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_words("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS ws FROM documents),
i AS (SELECT item_id, {_words("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS ws FROM benchmark),
s AS (SELECT item_id, ws, least(len(ws), 13) AS size FROM i WHERE len(ws) > 0),
t AS (SELECT item_id, size, ws, unnest(range(1, len(ws) - size + 2)) AS pos FROM s),
w AS (SELECT DISTINCT item_id, size, array_to_string(ws[pos:pos + size - 1], ' ') AS win FROM t),
p AS (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS pos FROM d, (SELECT DISTINCT size FROM w) z WHERE len(ws) >= size),
h AS (SELECT p.doc_id, p.pos, p.size, w.item_id FROM p JOIN w ON w.size = p.size AND w.win = array_to_string(p.ws[p.pos:p.pos + p.size - 1], ' ')),
e AS (SELECT DISTINCT doc_id, pos, size FROM h),
c AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM e) x GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) y GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id""",
    "op10_histogram_shards": """
WITH steps AS (SELECT i AS byte, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS value
               FROM range(256) r(i)),
crcs AS (SELECT list(value ORDER BY byte) AS crc FROM steps),
b AS (SELECT doc_id, [CAST('0x' || p AS BIGINT) FOR p IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS bytes FROM documents),
d AS (SELECT doc_id, len(bytes) + 8 AS size,
             xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, crc[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) AS text_crc32 FROM b, crcs),
s AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id) AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY doc_id) - 1 AS nth FROM d),
targets AS (SELECT k, (SELECT max(total) FROM s) * k // 24 AS target FROM range(1, 24) r(k)),
cuts AS (SELECT k, CASE WHEN upto - target < target - (upto - size) THEN nth + 1 ELSE nth END AS cut FROM targets JOIN s ON upto - size < target AND target <= upto),
placed AS (SELECT doc_id, size, text_crc32, (SELECT count(*) FROM cuts WHERE cut <= nth) AS shard FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed""",
    "op9_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", r"[^\x20\x09-\x0D]+")} AS ws FROM documents),
l AS (SELECT doc_id, ws, least(len(ws), 5) AS size FROM d WHERE len(ws) > 0),
u AS (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS pos FROM l),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[pos:pos + size - 1], ' ') AS shingle FROM u),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, links.y FROM reach r JOIN links ON links.x = r.y),
least_reached AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM d JOIN least_reached ON x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op7_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS full_text FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(full_text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY full_text)""",
}
