"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import (
    bpe, centroids, decontaminate, jaccard, language_id, lexical, license_scan, personal_data, quality, repetition, sharding, simhash, token_count
)
from assayer.llm.base import load
from assayer.llm.vocabulary import read_vocabulary


def tokenizer_path(name: str) -> str:
    """Place of a published tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learnt from labelled rows outside the held-out fold; ``und`` for null texts and those without a letter."""
    docs = load(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text by the published word vocabulary; a null text is empty."""
    vocabulary = read_vocabulary(tokenizer_path("word_bpe_49k.json"))
    return token_count.count_tokens(load(spark, sf_dir, "documents"), vocabulary, limit=2048)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the published byte vocabulary and decoded again, both as digests; a null text is empty."""
    vocabulary = read_vocabulary(tokenizer_path("byte_bpe_50k.json"))
    return bpe.round_trip(load(spark, sf_dir, "documents"), vocabulary)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows met in every whole text; null texts and those without words are not contaminated."""
    judged = decontaminate.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256")
    return judged.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and disclosing terms of every whole text; a null text is empty."""
    found = personal_data.find_spans(load(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in personal_data.KINDS[:-1]]
    base = F.sha2(personal_data.written(personal_data.KINDS[:-1]).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, personal_data.written(personal_data.KINDS).alias("spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text; null, empty and blank texts have fingerprint zero and link like others."""
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and the shard after one more was added, of every row, repeated ones included; a null text has size 1."""
    return sharding.shards(load(spark, sf_dir, "documents"), sharding.balanced())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learnt from labels outside the held-out fold; empty texts are scored too."""
    docs = load(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, load(spark, sf_dir, "labels")))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures, repeats and the verdict of every whole text; a null text has no word and fails."""
    return repetition.repetition_rules(load(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and the score of every whole text; null and empty texts name none."""
    return license_scan.scan_licenses(load(spark, sf_dir, "documents"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every whole text; null and empty texts are linked with nothing."""
    return jaccard.near_duplicates(load(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every whole vector after three rounds from the first sixteen by hash, with inertias and the digest of its centroid."""
    return centroids.clustering(load(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item; documents without terms count nowhere."""
    return lexical.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_token_count, op3_bpe, op4_decontaminate, op5_personal_data,
        op6_simhash, op7_sharding, op8_quality, op9_repetition, op10_licenses,
        op11_jaccard_join, op12_centroids, op13_lexical_search,
    )
}
WORDS_OF = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every document is compared as text; the operator's prefixes play no part.
DECONTAMINATE_SQL = f"""WITH d AS (SELECT doc_id, {WORDS_OF} AS w FROM documents),
  i AS (SELECT item_id, {WORDS_OF} AS w FROM benchmark WHERE item_id IS NOT NULL),
  win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s + 1 : s + least(13, len(w))], ' ') AS t FROM i, unnest(range(0, len(w) - least(13, len(w)) + 1)) u(s) WHERE len(w) > 0),
  dw AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS t FROM d, (SELECT DISTINCT n FROM win), unnest(range(0, len(w) - n + 1)) u(s)),
  hit AS (SELECT doc_id, s, n, item_id FROM dw JOIN win USING (n, t)),
  struck AS (SELECT doc_id, count(DISTINCT s + k) AS n_hit FROM hit, unnest(range(0, n)) u(k) GROUP BY doc_id),
  met AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN struck USING (doc_id) LEFT JOIN met USING (doc_id)"""

#: The tree is a table of its nodes here; checksums go byte by byte through a table made from the polynomial.
SHARDING_SQL = """WITH leaf AS (SELECT s, s // 8 AS r, (s // 4) % 2 AS k, g FROM range(0, 17) x(s), (VALUES (0), (1)) y(g) WHERE s < 16 OR g = 1),
  node AS (SELECT g, CASE WHEN s = 16 THEN 2 ELSE r END AS r, CASE WHEN s = 16 THEN 0 ELSE k END AS k, s FROM leaf),
  key AS (SELECT DISTINCT doc_id AS id, coalesce(CAST(doc_id AS VARCHAR), '') AS t FROM documents),
  region AS (SELECT id, t, g, arg_min(r, -ln((CAST('0x' || substr(md5(t || '|r' || r), 1, 13) AS BIGINT) + 0.5) / 4503599627370496) / w) AS r
    FROM key, (SELECT g, r, CAST(count(*) AS DOUBLE) AS w FROM node GROUP BY g, r) GROUP BY id, t, g),
  rack AS (SELECT id, t, g, r, arg_min(k, -ln((CAST('0x' || substr(md5(t || '|r' || r || 'k' || k), 1, 13) AS BIGINT) + 0.5) / 4503599627370496) / w) AS k
    FROM region JOIN (SELECT g, r, k, CAST(count(*) AS DOUBLE) AS w FROM node GROUP BY g, r, k) USING (g, r) GROUP BY id, t, g, r),
  shard AS (SELECT id, g, arg_min(s, -ln((CAST('0x' || substr(md5(t || '|s' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)) AS s
    FROM rack JOIN node USING (g, r, k) GROUP BY id, g),
  crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS c),
  bytes AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
  row AS (SELECT doc_id, n + 1 AS size, xor(4294967295, list_reduce(list_transform(range(n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
    lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1]), 4294967295)) AS text_crc32 FROM bytes, crc)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(a.s AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY a.s ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(text_crc32 AS BIGINT) || '|' || piece), 1, 3),
    doc_id NULLS FIRST, text_crc32, size, piece) - 1 AS slot, CAST(b.s AS INTEGER) AS grown_shard
FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id, text_crc32, size) - 1) // 65536 AS piece FROM row) row JOIN shard a ON a.id IS NOT DISTINCT FROM doc_id AND a.g = 0 JOIN shard b ON b.id IS NOT DISTINCT FROM doc_id AND b.g = 1"""



def _places(text: str, pattern: str) -> str:
    """SQL for the matches in a text as a list of s, e, v; pieces between matches give their places."""
    found, gaps = f"regexp_extract_all({text}, '{pattern}')", f"string_split_regex({text}, '{pattern}')"
    size = lambda held, to: f"coalesce(list_sum(list_transform({held}[1:{to}], lambda x: length(x))), 0)"
    start = f"CAST({size(gaps, 'i')} + {size(found, 'i - 1')} AS BIGINT)"
    return f"list_transform(range(1, len({found}) + 1), lambda i: {{'s': {start}, 'e': {start} + length({found}[i]), 'v': {found}[i]}})"


_DIGITS = "regexp_replace(x.v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda j: CASE WHEN j % 2 = 0 THEN 1 ELSE 2 END * CAST(reverse({_DIGITS})[j + 1] AS INT) - CASE WHEN j % 2 = 1 AND CAST(reverse({_DIGITS})[j + 1] AS INT) > 4 THEN 9 ELSE 0 END)) % 10 = 0"
_SMALL = "len(list_filter(string_split(x.v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(nullif(ltrim(p, '0'), '') AS INT), 0) > 255)) = 0"
_NO = "CAST([] AS STRUCT(s BIGINT, e BIGINT, v VARCHAR)[])"
_TERM = r"\p{L}[\p{L}\p{M}''’-]*"
_SHOW = lambda kind: f"list_transform({kind}, lambda x: '{kind}:' || x.s || ':' || x.e)"

#: The rule of the operator over the plain patterns of the contract: whole documents, every place of a disclosing term, contexts by their set of words.
PERSONAL_DATA_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
  email AS (SELECT n, {_places('t', r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")} AS email FROM d WHERE contains(t, '@')),
  ip AS (SELECT n, list_filter({_places('t', r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")}, lambda x: {_SMALL}) AS ip FROM d WHERE regexp_matches(t, '[0-9]\.[0-9]')),
  card AS (SELECT n, list_filter({_places('t', r"[0-9]([ -]?[0-9])+")}, lambda x: length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}) AS card FROM d WHERE regexp_matches(t, '[0-9][ -]?[0-9]')),
  phone AS (SELECT n, list_filter({_places('t', r"\+[0-9][ ().0-9-]+[0-9]")}, lambda x: length({_DIGITS}) BETWEEN 8 AND 15) AS phone FROM d WHERE contains(t, '+')),
  b AS (SELECT n, doc_id, t, length(t) AS size, coalesce(email, {_NO}) AS email, coalesce(ip, {_NO}) AS ip, coalesce(card, {_NO}) AS card, coalesce(phone, {_NO}) AS phone
    FROM d LEFT JOIN email USING (n) LEFT JOIN ip USING (n) LEFT JOIN card USING (n) LEFT JOIN phone USING (n)),
  m AS (SELECT n, doc_id, t, size, base, unnest(base) AS x FROM (SELECT *, email || ip || card || phone AS base FROM b)),
  word AS (SELECT n, lower(v) AS term, length(v) AS size, CAST(sum(length(g) + length(v)) OVER (PARTITION BY n ORDER BY k) AS BIGINT) AS e
    FROM (SELECT n, unnest(range(len(vs))) AS k, unnest(vs) AS v, unnest(gs[1:len(vs)]) AS g FROM
      (SELECT n, regexp_extract_all(t, '{_TERM}') AS vs, string_split_regex(t, '{_TERM}') AS gs FROM d))),
  free AS (SELECT n, term, e - size AS s, e FROM word WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.n = word.n AND m.x.s < word.e AND m.x.e > word.e - word.size)),
  one AS (SELECT min(n) AS n FROM d GROUP BY doc_id, t),
  holds AS (SELECT DISTINCT n, term FROM free JOIN one USING (n)),
  whole AS (SELECT entity, term, count(DISTINCT sign) AS apart, count(*) AS n_te FROM (SELECT DISTINCT n, x.v AS entity FROM m JOIN one USING (n)) JOIN holds USING (n)
    JOIN (SELECT n, string_agg(term, ' ' ORDER BY term) AS sign FROM holds GROUP BY n) USING (n) GROUP BY ALL),
  side AS (SELECT n, size, base, x.v AS entity, x.s AS xs, t, greatest(0, x.s - 60) AS a, x.s AS z, true AS l FROM m UNION ALL SELECT n, size, base, x.v, x.s, t, x.e, least(size, x.e + 60), false FROM m),
  part AS (SELECT n, size, base, entity, xs, a, z, l, substr(t, a + 1, z - a) AS p FROM side),
  near AS (SELECT n, size, base, entity, xs, a, z, l, unnest({_places('p', _TERM)}) AS w FROM part),
  beside AS (SELECT DISTINCT n, entity, xs, lower(w.v) AS term FROM near
    WHERE (w.s > 0 OR a = 0 OR NOT l) AND (w.e < z - a OR z = size OR l) AND len(list_filter(base, lambda y: y.s < w.e + a AND y.e > w.s + a)) = 0),
  close AS (SELECT entity, term, count(DISTINCT sign) AS contexts FROM beside
    JOIN (SELECT n, entity, xs, string_agg(term, ' ' ORDER BY term) AS sign FROM beside GROUP BY ALL) USING (n, entity, xs) GROUP BY ALL),
  pair AS (SELECT entity, term, n_te FROM whole LEFT JOIN close USING (entity, term) WHERE greatest(apart, coalesce(contexts, 0)) >= 3),
  n_e AS (SELECT x.v AS entity, count(DISTINCT n) AS n_e FROM m JOIN one USING (n) GROUP BY 1),
  n_t AS (SELECT term, count(*) AS n_t FROM (SELECT n, unnest(list_distinct(regexp_extract_all(lower(t), '{_TERM}'))) AS term FROM d JOIN one USING (n)) WHERE term IN (SELECT term FROM pair) GROUP BY 1),
  told AS (SELECT DISTINCT term FROM pair JOIN n_e USING (entity) JOIN n_t USING (term), (SELECT CAST(count(*) AS DOUBLE) AS total FROM one)
    WHERE n_e < total AND ln(n_te * total / (n_t * n_e)) >= 0.95 * ln(total / n_e)),
  term AS (SELECT n, list_sort(list(DISTINCT {{'s': s, 'e': e}})) AS term FROM free JOIN told USING (term) GROUP BY n)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len(ip) AS BIGINT) AS n_ip, CAST(len(card) AS BIGINT) AS n_card, CAST(len(phone) AS BIGINT) AS n_phone,
  sha256(array_to_string({_SHOW('email')} || {_SHOW('ip')} || {_SHOW('card')} || {_SHOW('phone')}, ',')) AS base_sha256,
  array_to_string({_SHOW('email')} || {_SHOW('ip')} || {_SHOW('card')} || {_SHOW('phone')} || coalesce({_SHOW('term')}, []), ',') AS spans
FROM b LEFT JOIN term USING (n)"""

#: Every round in turn; each vector meets every centroid.
_SQUARE = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT)"
_NEAREST = lambda old: f"(SELECT n, vec_id, v, arg_min(k, ({_SQUARE}, k)) AS k, min({_SQUARE}) AS d FROM v, {old} GROUP BY n, vec_id, v)"
_MEANS = lambda old, now: f"""(SELECT k, coalesce(m, c) AS c FROM {old} LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m
    FROM (SELECT k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM {now}, range(1, 65) r(i) GROUP BY k, i) GROUP BY k) USING (k))"""  # noqa: E731
CENTROIDS_SQL = f"""WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT 16)),
  a1 AS {_NEAREST("c0")}, c1 AS {_MEANS("c0", "a1")}, a2 AS {_NEAREST("c1")}, c2 AS {_MEANS("c1", "a2")}, a3 AS {_NEAREST("c2")}, c3 AS {_MEANS("c2", "a3")}, a AS {_NEAREST("c3")}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a JOIN c3 USING (k)"""

#: Every match of every item is scored.
LEXICAL_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_OF} AS w FROM documents),
  p AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT *, unnest(w) AS term FROM d) GROUP BY r, doc_id, w, term),
  whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
  weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), whole),
  i AS (SELECT DISTINCT item_id, unnest({WORDS_OF}) AS term FROM benchmark WHERE item_id IS NOT NULL),
  s AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
    FROM i JOIN weight USING (term) JOIN p USING (term), whole GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place FROM s WHERE score > 0) WHERE place <= 10"""

ORACLES: dict[str, str] = {"op12_centroids": CENTROIDS_SQL, "op13_lexical_search": LEXICAL_SQL, "op4_decontaminate": DECONTAMINATE_SQL, "op5_personal_data": PERSONAL_DATA_SQL, "op7_sharding": SHARDING_SQL}
