"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_dedup, decontam, embed_dedup, minhash, mixing, quality, sharding, suffix_dedup, toxicity, warc
from .scratch import fresh_path

#: Bytes of a shard: in the pipeline, and in ``op8_sharding``, where even the smallest table at hand then splits.
SHARD_BYTES = 32 << 20
OP8_BYTES = 256 << 10


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.detect(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "spans")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.roundtrip(_read(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact phrases, and beside them ``n_near``: items whose four rarest terms lie within 30 words of each other's rarest."""
    docs, items = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    index = decontam.index_of(docs, "doc_id", "text")
    out = decontam.phrase_matches(docs, items, index=index)
    near = decontam.proximity_matches(docs, items, index=index).groupBy("segment", "ord").agg(F.count_distinct("item_id").alias("n_near"))
    out = out.join(near, ["segment", "ord"], "left")
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontam.contaminated().alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_lines", "good_lines")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.classes(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op7_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cover_dedup.substring_dedup(_read(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard(docs, "doc_id", "text", OP8_BYTES)
    return out.select("doc_id", "row_bytes", "shard_depth", "shard_id")


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(_read(spark, sf_dir, "embeddings"), cosine=0.95)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.assign(docs, "text", "source", "doc_id")
    return out.select("doc_id", "size", "source_size", "target", "taken", F.size("shards").cast("long").alias("n_copies"))


def queries() -> dict:
    return {"op1_toxicity": op1_toxicity, "op2_suffix_dedup": op2_suffix_dedup, "op3_warc": op3_warc, "op4_decontam": op4_decontam, "op5_quality": op5_quality, "op6_minhash": op6_minhash, "op7_cover_dedup": op7_cover_dedup, "op8_sharding": op8_sharding, "op9_embed_dedup": op9_embed_dedup, "op10_mixing": op10_mixing}


#: Runs of non-blank characters; letters, digits and non-ASCII.
_SPACED, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _repeats(size: int) -> str:
    """Words of every document (d), and the places covered by windows that begin elsewhere too (gone)."""
    return f"""d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '{_SPACED}'), []) AS w FROM documents),
      win AS MATERIALIZED (SELECT r, i, md5(array_to_string(w[i : i + {size - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {size - 2})) AS i FROM d)),
      dup AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
      gone AS MATERIALIZED (SELECT DISTINCT r, unnest(range(i, i + {size})) AS p FROM win JOIN dup USING (h))"""


OP2_SQL = f"""
WITH {_repeats(50)},
runs AS (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS g FROM gone)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(min(p) - 1 AS BIGINT) AS span_start, count(*) AS span_words
FROM runs JOIN d USING (r) GROUP BY r, g, d.doc_id, d.w
"""

OP3_SQL = """
WITH b AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (j // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (j % 8) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS digest FROM b),
o AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS first FROM t WINDOW w AS (PARTITION BY digest ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to FROM o
"""

OP4_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_ALNUM}'), []) AS w FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS ir, item_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_ALNUM}'), []) AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS k FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
hits AS MATERIALIZED (SELECT r, i, size, item_id FROM dw JOIN iw USING (size, k)),
covered AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r),
terms AS (SELECT ir, item_id, term, min(p) AS first FROM (SELECT ir, item_id, unnest(w) AS term, unnest(range(len(w))) AS p FROM b) GROUP BY ALL),
places AS MATERIALIZED (SELECT r, p, term FROM (SELECT r, unnest(w) AS term, unnest(range(len(w))) AS p FROM d) WHERE term IN (SELECT term FROM terms)),
df AS (SELECT term, count(DISTINCT r) AS n FROM places GROUP BY term),
rare AS MATERIALIZED (SELECT ir, item_id, term, row_number() OVER (PARTITION BY ir ORDER BY coalesce(n, 0), first) AS k FROM terms LEFT JOIN df USING (term) QUALIFY k <= 4),
lead AS (SELECT ir, item_id, r, p FROM rare JOIN places USING (term) WHERE k = 1),
beside AS (SELECT l.ir, l.r, l.p, count(DISTINCT o.k) AS m FROM lead l JOIN rare o ON o.ir = l.ir AND o.k > 1 JOIN places x ON x.r = l.r AND x.term = o.term AND x.p BETWEEN l.p - 30 AND l.p + 30 GROUP BY ALL),
near AS (SELECT r, count(DISTINCT item_id) AS n FROM lead l LEFT JOIN beside s USING (ir, r, p) WHERE coalesce(m, 0) = (SELECT max(k) - 1 FROM rare o WHERE o.ir = l.ir) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
  coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated, coalesce(e.n, 0) AS n_near FROM d LEFT JOIN covered c USING (r) LEFT JOIN found f USING (r) LEFT JOIN near e USING (r)
"""

OP7_SQL = f"""
WITH {_repeats(35)},
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
pos AS (SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(l.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN lost l USING (r) LEFT JOIN kept k USING (r)
"""

OP9_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a), c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.m, vec_id)) AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

def oracle_sql() -> dict[str, str]:
    """Learned scores (1, 5) and sampled signatures (6) are beyond SQL; tests hold them against brute force."""
    return {"op10_mixing": OP10_SQL, "op2_suffix_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op4_decontam": OP4_SQL, "op7_cover_dedup": OP7_SQL, "op8_sharding": OP8_SQL, "op9_embed_dedup": OP9_SQL}


#: Levels 0 to 24 of the directory over md5 prefixes; enough for the tables that the SQL is run on.
OP8_SQL = f"""
WITH r AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS row_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\\N')), 1, 15) AS BIGINT) AS h FROM documents),
lv AS (SELECT CAST(range AS INTEGER) AS d FROM range(25)),
b AS (SELECT d, h >> (60 - d) AS p, sum(row_bytes) AS bytes, count(*) AS n FROM r, lv GROUP BY ALL),
f AS (SELECT doc_id, row_bytes, h, min(b.d) AS depth FROM r, b WHERE b.p = h >> (60 - b.d) AND (bytes <= {OP8_BYTES} OR n <= 1) GROUP BY ALL)
SELECT doc_id, row_bytes, depth AS shard_depth,
  CAST(depth AS VARCHAR) || ':' || CAST(h >> (60 - depth) AS VARCHAR) AS shard_id FROM f
"""

#: Blocks of a source in the order of their hashes; whole rounds, then a prefix; the block in which the quota ends is cut in hash order.
OP10_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(coalesce(regexp_extract_all(text, '{_SPACED}'), [])) AS BIGINT) AS size,
  CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, greatest(8, CAST(ceil(count(*) / 1000) AS BIGINT)) AS nb FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w, 2.0::DOUBLE * source_size AS top FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - coalesce(sum(top) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER o AS k FROM w WINDOW o AS (ORDER BY top / w, source IS NULL, source)),
g AS (SELECT source, source_size, nb, CASE WHEN top <= w * level THEN top ELSE w * (SELECT arg_min(level, k) FROM l WHERE NOT top <= w * level) END AS target FROM l),
q AS (SELECT *, CAST(round(target) AS BIGINT) AS words FROM g),
r AS MATERIALIZED (SELECT d.*, source_size, target, words, h % nb AS blk FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
b AS (SELECT source, blk, sum(size)::BIGINT AS bsize, any_value(source_size) AS ss, any_value(words) AS words FROM r GROUP BY source, blk),
f AS (SELECT source, blk, CASE WHEN ss > 0 THEN words // ss ELSE 0 END AS passes, CASE WHEN ss > 0 THEN words % ss ELSE 0 END AS rest,
  bsize, coalesce(sum(bsize) OVER (PARTITION BY source ORDER BY md5('19|' || blk), blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM b),
e AS (SELECT source, blk, passes, bsize, least(bsize, greatest(0, rest - ahead)) AS extra FROM f),
t AS (SELECT r.*, passes, CASE WHEN extra = 0 THEN 0 WHEN extra = bsize THEN size
  ELSE least(size, greatest(0, extra - coalesce(sum(size) OVER (PARTITION BY r.source, r.blk ORDER BY h, doc_id, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS part
  FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source AND r.blk = e.blk)
SELECT doc_id, size, source_size, target, CAST(passes * size + part AS BIGINT) AS taken, CASE WHEN size = 0 THEN 0 ELSE CAST(passes + CAST(part > 0 AS INTEGER) AS BIGINT) END AS n_copies FROM t
"""
