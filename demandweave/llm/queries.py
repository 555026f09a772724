"""Queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandweave.session import stored

from . import (
    bpe,
    collocations,
    decontaminate,
    filter_audit,
    jaccard_join,
    labelled,
    minhash,
    quality_classifier,
    quality_rules,
    secrets,
    sharding,
    toxicity,
    url_filters,
    warc,
)

SHARDS = 40

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_bpe(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), path).drop("text"), path)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op2_jaccard_join(spark, sf):
    return jaccard_join.JaccardJoin().groups(table(spark, sf, "documents"))


ORACLES["op2_jaccard_join"] = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle
  FROM d, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS g(i) WHERE len(w) > 0
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other
)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query
def op3_quality_rules(spark, sf):
    counted = quality_rules.with_counts(table(spark, sf, "documents").select("doc_id", "text")).drop("text")
    judged = quality_rules.judged(stored(counted, "op3"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "quality")


def classified(spark, sf, label, module, model, modulus, rest, least):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    known = labelled.sample(docs, table(spark, sf, "labels"), label, modulus, rest, module.PER_CLASS)
    return labelled.scored(docs, model(known)).select(
        "doc_id",
        labelled.held_out("doc_id", modulus, rest).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


@query
def op4_quality_classifier(spark, sf):
    return classified(spark, sf, "quality", quality_classifier, quality_classifier.QualityModel, 3, 1, 0.5)


@query
def op5_url_filters(spark, sf):
    return url_filters.judge(table(spark, sf, "pages").select("page_id", "url")).drop("url")


@query
def op6_sharding(spark, sf):
    return sharding.into_shards(table(spark, sf, "documents").select("doc_id", "text"), SHARDS)


@query
def op7_secret_scans(spark, sf):
    found = secrets.scan(table(spark, sf, "documents"))
    shown = F.concat(F.substring("value", 1, 4), F.lit("..."))
    return found.withColumns({"value": shown, "value_sha256": F.sha2("value", 256)}).drop("text_hash")


@query
def op8_decontamination(spark, sf):
    docs, benchmark = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    found = decontaminate.find(docs, benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


ORACLES["op8_decontamination"] = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), h AS (
  SELECT DISTINCT doc_id, item, i, z.n FROM d, (SELECT DISTINCT n FROM p) z, unnest(generate_series(1, len(w))) AS g(i)
  JOIN p ON p.n = z.n AND p.phrase = array_to_string(w[i:i + z.n - 1], ' ') WHERE i + z.n - 1 <= len(w)
), k AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(generate_series(i, i + n - 1)) AS g(j) GROUP BY doc_id
), s AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query
def op9_toxicity(spark, sf):
    return classified(spark, sf, "toxic", toxicity, toxicity.ToxicityModel, 4, 2, 0.3)


@query
def op10_warc(spark, sf):
    index = warc.archive(table(spark, sf, "pages").select("page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")


ORACLES["op10_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
       array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path AS urlkey,
       strftime(make_timestamp(page_id % 1000000000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM f JOIN (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)
      ELSE '' END AS path
  FROM pages) u USING (page_id)
"""

ORACLES["op5_url_filters"] = """
WITH u AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)
      ELSE '' END AS path
  FROM pages
), r(rule, said, h, p) AS (
  VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
         ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'),
         ('com/de/', 'block', 'com', '/de/')
), g(part) AS (
  VALUES ('%spam%'), ('%casino%'), ('%-bets.%'), ('%.bets.%'), ('%porn%'), ('%adult-%'), ('%-pills.%'),
         ('%ads-track%'), ('%malware%')
), best AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(said, length(rule)) AS said
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT u.page_id, host, path, rule,
       coalesce(said, CASE WHEN EXISTS (SELECT 1 FROM g WHERE '.' || host LIKE part) THEN 'block' ELSE 'allow' END)
         AS verdict
FROM u LEFT JOIN best USING (page_id)
"""


@query
def op11_minhash_dedup(spark, sf):
    return minhash.MinMaxDedup().groups(table(spark, sf, "documents"))


ORACLES["op11_minhash_dedup"] = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS shingle
  FROM d, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS g(i) WHERE len(w) > 0
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  WHERE 100 * p.n >= 80 * q.n AND 100 * q.n >= 80 * p.n
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other
)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query
def op12_filter_audit(spark, sf):
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f(x, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[:k - 1]), 0)::INT AS seen
  FROM o, unnest([1, 2, 3, 4, 5]) AS g(k)
), r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & bit = 0 AND mask & seen = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & seen = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & seen <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & seen = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & seen = 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""


@query
def op13_collocations(spark, sf):
    return collocations.Collocations().top_phrases(table(spark, sf, "documents"))


ORACLES["op13_collocations"] = r"""
WITH p AS MATERIALIZED (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(body, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS body FROM documents)
), t AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), x AS (
  SELECT lang, piece, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM p WHERE len(w) > 0
), g AS MATERIALIZED (
  SELECT lang, x AS a, lead(x, 1) OVER s AS b, lead(x, 2) OVER s AS c, lead(x, 3) OVER s AS d
  FROM x WINDOW s AS (PARTITION BY piece ORDER BY i)
), f AS MATERIALIZED (
  SELECT lang, q, count(*) AS a, string_split(q, ' ') AS w, len(string_split(q, ' ')) AS k FROM (
    SELECT lang, a AS q FROM g UNION ALL
    SELECT lang, a || ' ' || b FROM g WHERE b IS NOT NULL UNION ALL
    SELECT lang, a || ' ' || b || ' ' || c FROM g WHERE c IS NOT NULL UNION ALL
    SELECT lang, a || ' ' || b || ' ' || c || ' ' || d FROM g WHERE d IS NOT NULL
  ) GROUP BY lang, q HAVING count(*) >= 30
), half AS (
  SELECT lang, q, a, c, array_to_string(w[:c], ' ') AS first, array_to_string(w[c + 1:], ' ') AS rest
  FROM f, unnest([1, 2, 3]) AS z(c) WHERE c < k
), cut AS (
  SELECT h.lang, h.q, h.a, c, x.a AS l, y.a AS r, (2000000::HUGEINT * h.a // (x.a + y.a))::BIGINT AS score
  FROM half h JOIN f x ON x.lang = h.lang AND x.q = h.first JOIN f y ON y.lang = h.lang AND y.q = h.rest
), low AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, q ORDER BY score, c) = 1
), part AS (
  SELECT lang, a, array_to_string(w[i:i + j - 1], ' ') AS q
  FROM f, unnest([2, 3]) AS z(j), unnest([1, 2, 3]) AS y(i) WHERE j < k AND i + j - 1 <= k
), inside AS (
  SELECT DISTINCT lang, q FROM part JOIN f USING (lang, q) WHERE 100 * part.a >= 80 * f.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, q) AS rank, q AS phrase, a, l, r, score
  FROM low ANTI JOIN inside USING (lang, q)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""
