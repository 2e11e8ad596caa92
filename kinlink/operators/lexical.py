"""BM25 retrieval over names and addresses, and TF-IDF vectors.

The index is a table of (field, token, target, weight); a query's score is a sum over equal (field, token), made slice against
slice (``slices``).  The weight of a posting already holds term frequency and length, so a hit adds one number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.functions import alt_text as A
from kinlink.sources.shared import cut

from . import slices

#: Scores equal to so many places tie.
TIES = 9


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    name_weight: float = 2.0
    addr_weight: float = 1.0


def _tokens(entities: DataFrame) -> DataFrame:
    """(entity_id, country, alike, field, token), one row for each occurrence; ``alike``: a hash of the country and the name's first words."""
    # normalized first: the token functions name their text many times, and as one expression each would normalize anew
    clean = entities.select("entity_id", F.lower(F.trim(F.coalesce("country", F.lit("")))).alias("country"), A.normalize_business_name(F.col("business_name")).alias("name"), A.normalize_address(F.col("business_address")).alias("addr"))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), A.lexical_tokens(F.col(c)).alias("tokens")) for c in ("name", "addr")])
    own = ["entity_id", "country", F.xxhash64("country", F.substring_index("name", " ", 3)).alias("alike")]
    one = clean.select(*own, F.explode_outer(fields).alias("f"))
    # outer explodes: before inner ones Spark would build the lists once more to test them for emptiness
    return one.select("entity_id", "country", "alike", "f.field", F.explode_outer("f.tokens").alias("token")).where("token is not null")


def fit(targets: DataFrame, p: Bm25 = Bm25()) -> DataFrame:
    """Postings (field, token, target_id, country, weight) of the target records.

    A token in more than half of the records has a negative inverse frequency; it gets ``epsilon`` times the field's mean.
    """
    tok = _tokens(targets)
    tf = tok.groupBy("field", "entity_id", "country", "token").agg(F.count(F.lit(1)).alias("tf"))
    length = tok.groupBy("field", "entity_id").agg(F.count(F.lit(1)).alias("len"))
    n = targets.agg(F.count(F.lit(1)).cast("double").alias("n"))
    df = tf.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    means = raw.groupBy("field").agg(F.avg("raw").alias("mean"))
    sizes = length.groupBy("field").agg(F.sum("len").alias("total")).crossJoin(F.broadcast(n)).select("field", (F.col("total") / F.col("n")).alias("avg_len"))
    # one row for each field
    idf = raw.join(F.broadcast(means), "field").select("field", "token", F.when(F.col("raw") < 0, p.epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("len") / F.col("avg_len")))
    out = tf.join(length, ["field", "entity_id"]).join(F.broadcast(sizes), "field").join(idf, ["field", "token"])
    return out.select("field", "token", F.col("entity_id").alias("target_id"), "country", weight.alias("weight"))


def retrieve(queries: DataFrame, index: DataFrame, k: int = 20, p: Bm25 = Bm25(), by_country: bool = True) -> DataFrame:
    """(s1_id, target_id, score, rank): the best k targets with a positive score, ties by id.

    A query whose country occurs among the targets sees that country's targets only; others see all.
    """
    index = cut(index)
    scale = F.when(F.col("field") == "name", p.name_weight).otherwise(p.addr_weight)
    # a token that a query repeats counts as often; one row carries it
    tok = _tokens(queries).groupBy(F.col("entity_id").alias("q"), "country", "alike", "field", "token").agg((F.count(F.lit(1)) * F.first(scale)).alias("weight"))
    token, inside = F.xxhash64("field", "token").alias("h"), F.xxhash64("country", "field", "token").alias("h")
    if by_country:
        known = index.select("country").distinct().withColumn("known", F.lit(True))
        tok = cut(tok.join(known, "country", "left"))
        asked = tok.select("q", "alike", F.when(F.col("known"), inside).otherwise(token).alias("h"), "weight")
        outside = tok.where("known is null").select("field", "token").distinct()
        pool = index.select(F.col("target_id").alias("t"), inside, "weight").unionByName(index.join(outside, ["field", "token"], "left_semi").select(F.col("target_id").alias("t"), token, "weight"))
    else:
        asked, pool = tok.select("q", "alike", token, "weight"), index.select(F.col("target_id").alias("t"), token, "weight")
    return slices.best(asked, pool, k, TIES, alike="alike").toDF("s1_id", "target_id", "score", "rank")


def ranked(scored: DataFrame, k: int, digits: int = TIES) -> DataFrame:
    """The best k of each query; scores equal to ``digits`` places tie and go by id."""
    order = Window.partitionBy("s1_id").orderBy(F.round("score", digits).desc(), "target_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _term_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf): words of at least two characters of the lower-cased text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return texts.select(F.col(key).alias("key"), F.explode(words).alias("token")).groupBy("key", "token").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_fit(texts: DataFrame, key: str, text: str, vocabulary: int = 5000) -> DataFrame:
    """(token, idf) of the most frequent tokens, at most ``vocabulary`` rows; idf = ln((1 + n) / (1 + df)) + 1."""
    per = _term_counts(texts, key, text).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    n = texts.agg(F.count(F.lit(1)).cast("double").alias("n"))
    kept = per.orderBy(F.col("total").desc(), "token").limit(vocabulary)
    return kept.crossJoin(F.broadcast(n)).select("token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(texts: DataFrame, key: str, text: str, idf: DataFrame) -> DataFrame:
    """(key, token, weight): vectors of length 1 over the tokens of ``idf`` (bounded by its vocabulary, so broadcast)."""
    w = _term_counts(texts, key, text).join(F.broadcast(idf), "token").select("key", "token", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "key").select("key", "token", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_top(queries: DataFrame, targets: DataFrame, k: int = 15) -> DataFrame:
    """(s1_id, target_id, score, rank) by cosine of tf-idf vectors (key, token, weight), joined on tokens."""
    h = F.xxhash64("token").alias("h")
    asked, pool = queries.select(F.col("key").alias("q"), h, "weight"), targets.select(F.col("key").alias("t"), h, "weight")
    return slices.best(asked, pool, k, TIES).toDF("s1_id", "target_id", "score", "rank")


def interleave(first: DataFrame, second: DataFrame, limit: int = 25) -> DataFrame:
    """Two ranked lists (s1_id, target_id, rank) in turn, the first leading; a target counts at its first place."""
    place = lambda df, c: df.select("s1_id", "target_id", (2 * F.col("rank") + c).alias("place"))
    once = place(first, 0).unionByName(place(second, 1)).groupBy("s1_id", "target_id").agg(F.min("place").alias("place"))
    order = Window.partitionBy("s1_id").orderBy("place")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("s1_id", "target_id", "rank")


def text_of(entities: DataFrame) -> DataFrame:
    """entity_id and its text for embeddings."""
    text: Column = A.composite_representation(F.col("business_name"), F.col("business_address"), F.col("country"))
    return entities.select("entity_id", text.alias("text"))
