"""Queries over the driver's tables.  ``oracle`` holds the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.functions import alt_text as A
from kinlink.functions import similarity as S
from kinlink.functions import text as X
from kinlink.operators import blocking as B
from kinlink.operators import decision, dense, features, keys, labels, lexical, metrics, prepare, ranker, validate
from kinlink.sources import tsv
from kinlink.sources.shared import cut, shared_dir

from . import fixtures, oracle
from .fixtures import document_entities, part_entities, part_truth, table

Query = Callable[[SparkSession, str], DataFrame]


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_entities(spark, sf_dir).unionByName(document_entities(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.spread(prepare.prepare(part_entities(spark, sf_dir)))


#: No bound on a record's tokens and keys.
WHOLE = B.Blocking(max_tokens=None, max_keys=None)


def _whole_blocked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records with whole texts, and candidates by all their tokens and keys."""
    r = prepare.spread(prepare.prepare(part_entities(spark, sf_dir), whole=True))
    return r, B.block(r, WHOLE)


def _queries(records: DataFrame) -> DataFrame:
    return records.where("source = 'S1'").select(F.col("entity_id").alias("s1_id"))


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir)


def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities written as TSV sources and read back, with the source read off the files' names."""
    return tsv.read_entities(spark, tsv.write_entities(part_entities(spark, sf_dir), _fresh(spark, "tsv")))


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each written TSV source."""
    files = tsv.write_entities(part_entities(spark, sf_dir), _fresh(spark, "tsv"))
    return spark.createDataFrame([(f"S{i}", tsv.count_rows(spark, path)) for i, path in enumerate(files, 1)], "source string, n long")


def kept_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities kept as a table by parameters; the second call finds it whole and does not write its own, empty rows."""
    path, e = _fresh(spark, "kept"), part_entities(spark, sf_dir)
    tsv.cached(spark, e, path, {"files": 3})
    return tsv.cached(spark, e.limit(0), path, {"files": 3})


def country_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv.country_counts(_both(spark, sf_dir))


def base_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).select("entity_id", X.base_clean(F.col("business_name")).alias("name_clean"), X.base_clean(F.col("business_address")).alias("addr_clean"))


def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("business_name")
    return _both(spark, sf_dir).select("entity_id", X.normalize_name(name).alias("name_norm"), X.normalize_name_core(name).alias("name_core"))


def normalize_addr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).select("entity_id", X.normalize_addr(F.col("business_address")).alias("addr_norm"))


def composite_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).select("entity_id", X.composite(F.col("business_name"), F.col("business_address")).alias("composite"))


def id_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).select("entity_id", X.id_hash(F.col("entity_id")).alias("id_hash"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    addr = X.normalize_addr(F.col("business_address"))
    return part_entities(spark, sf_dir).select("entity_id", F.array_join(X.all_numbers(addr), " ").alias("all_numbers"), F.array_join(X.postal_codes(addr), " ").alias("postal_codes"))


def char_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = X.char_ngrams(F.col("name_norm"), 3)
    return _records(spark, sf_dir).select("entity_id", F.size(grams).alias("n_grams"), F.array_join(F.array_sort(F.array_distinct(grams)), "/").alias("grams"))


def record_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.tokens(_records(spark, sf_dir)).select("entity_id", "ns", "pos", "token")


def alt_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part_entities(spark, sf_dir)
    name, addr = F.col("business_name"), F.col("business_address")
    return e.select(
        "entity_id",
        A.clean_text_basic(name).alias("clean"),
        A.normalize_business_name(name).alias("name_alt"),
        A.normalize_business_name(name, remove_legal=True).alias("name_alt_core"),
        A.normalize_address(addr).alias("addr_alt"),
        F.array_join(A.extract_numbers(addr), " ").alias("alt_numbers"),
        A.extract_postal_code(addr).alias("alt_postal"),
        A.composite_representation(name, addr, F.col("country")).alias("composite"),
    )


def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.token_counts(prepare.tokens(prepare.targets(_records(spark, sf_dir))))


def rare_doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = prepare.tokens(prepare.targets(_records(spark, sf_dir)))
    return B.rare_doc_tokens(tok, B.token_counts(tok)).select("entity_id", "ns", "token", "df", "rank")


def rare_query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    counts = B.token_counts(prepare.tokens(prepare.targets(r)))
    out = B.rare_query_tokens(prepare.tokens(prepare.queries(r)), counts)
    return out.select("entity_id", "ns", "token", "df", "rank", F.round("weight", 6).alias("weight"))


def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.key_table(_records(spark, sf_dir)).select("entity_id", "ord", "family", "key", "weight")


def key_posting_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.posting_stats(keys.key_table(prepare.targets(_records(spark, sf_dir))))


def rare_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = B.rare_hits(_records(spark, sf_dir))
    return hits.groupBy("s1_id", "target_id", "channel").agg(F.count(F.lit(1)).alias("hits"), F.round(F.sum("weight"), 6).alias("weight"))


def composite_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 30 targets of each query by composite keys alone."""
    out = B.block(_records(spark, sf_dir), rare=False)
    return out.select("s1_id", "target_id", "rank", F.round(F.col("score").cast("double"), 4).alias("score"))


def exact_name_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skew case: repeated first lines of documents block each other; targets of the same whole name for each query."""
    return B.key_counts(prepare.prepare(document_entities(spark, sf_dir)), "FULL_NAME")


def _blocked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = _records(spark, sf_dir)
    return r, B.block(r)


def blocked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = _whole_blocked(spark, sf_dir)
    return c.select("s1_id", "target_id", "rank", F.round(F.col("score").cast("double"), 4).alias("score"))


def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth through the file form: lists per S1 record, then exploded and resolved."""
    lists = part_truth(spark, sf_dir).groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list("target_id")), ", ").alias("ids"))
    return labels.resolve_truth(tsv.explode_truth(lists), part_entities(spark, sf_dir))


def truth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.resolution_stats(part_truth(spark, sf_dir), part_entities(spark, sf_dir))


def label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = _blocked(spark, sf_dir)
    return labels.label(c, part_truth(spark, sf_dir)).select("s1_id", "target_id", "label")


def pair_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = _whole_blocked(spark, sf_dir)
    n = prepare.targets(r).agg(F.count(F.lit(1)).alias("n_targets"))
    return metrics.blocking_quality(_queries(r), part_truth(spark, sf_dir), c, n)


def blocking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = _whole_blocked(spark, sf_dir)
    return metrics.blocking_report(_queries(r), part_truth(spark, sf_dir), c)


def _probabilities(c: DataFrame) -> DataFrame:
    """A fixed probability of a candidate: its score by 100, one at most."""
    return c.select("s1_id", "target_id", "rank", F.least(F.lit(1.0), F.round(F.col("score").cast("double"), 4) / 100).alias("prob"))


def _matches(c: DataFrame) -> DataFrame:
    """Matches of the two-stage policy over the fixed probabilities."""
    return decision.decide(_probabilities(c), t_match=0.62, t_singleton=0.7)


def macro_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = _whole_blocked(spark, sf_dir)
    return metrics.macro(_queries(r), part_truth(spark, sf_dir), _matches(c))


def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = _whole_blocked(spark, sf_dir)
    s = metrics.entity_scores(_queries(r), part_truth(spark, sf_dir), _matches(c))
    return s.select("s1_id", "n_true", "n_found", "n_hit", F.round("f_beta", 6).alias("f_beta"))


def singleton_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    n = metrics.truth_counts(_queries(r), part_truth(spark, sf_dir))
    return n.groupBy("n_true").agg(F.count(F.lit(1)).alias("n_queries"))


def missed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = _blocked(spark, sf_dir)
    return metrics.missed_pairs(part_truth(spark, sf_dir), c, 2, 15)


def key_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of true pairs that each family of keys finds alone."""
    t = keys.key_table(prepare.prepare(part_entities(spark, sf_dir), whole=True), most=None)
    one = t.where("source = 'S1'").select("family", "key", F.col("entity_id").alias("s1_id"))
    two = t.where("source <> 'S1'").select("family", "key", F.col("entity_id").alias("target_id"))
    truth = part_truth(spark, sf_dir)
    # from the true pairs to their keys: joined on keys first, a frequent key would pair all its records
    both = truth.distinct().join(one, "s1_id").join(two, ["target_id", "family", "key"])
    hit = both.select("family", "s1_id", "target_id").distinct().groupBy("family").agg(F.count(F.lit(1)).alias("hit"))
    n = truth.agg(F.count(F.lit(1)).alias("n"))
    return hit.crossJoin(F.broadcast(n)).select("family", "hit", F.round(F.col("hit") / F.col("n"), 6).alias("recall"))


def _set_features(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    r, c = (_whole_blocked if whole else _blocked)(spark, sf_dir)
    return features.with_attributes(c, r)


def token_overlap_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.set_features()
    made.pop("first_word_soundex")
    return features.with_sets(_set_features(spark, sf_dir)).select("s1_id", "target_id", *[F.round(c, 6).alias(n) for n, c in made.items()])


def soundex_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_sets(_set_features(spark, sf_dir)).select("s1_id", "target_id", features.set_features()["first_word_soundex"].alias("first_word_soundex"))


def jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _set_features(spark, sf_dir, whole=True)
    jw = lambda a, b: F.round(S.similarity("jaro_winkler", F.col(a), F.col(b)), 6)
    return p.select("s1_id", "target_id", jw("name1", "name2").alias("name_jw"), jw("addr1", "addr2").alias("addr_jw"))


def fuzz_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _set_features(spark, sf_dir, whole=True)
    names = [n for n in S.KERNELS if n not in ("jaro_winkler", "wratio")]
    p = p.withColumns({"_n": S.similarities(names, F.col("name1"), F.col("name2")), "_a": S.similarities(names, F.col("addr1"), F.col("addr2"))})
    return p.select("s1_id", "target_id", *[F.round(F.col(x)[n], 6).alias(f"{y}_{n}") for x, y in (("_n", "name"), ("_a", "addr")) for n in names])


def wratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set_features(spark, sf_dir).select("s1_id", "target_id", F.round(S.similarity("wratio", F.col("name1"), F.col("name2")), 6).alias("name_wratio"))


def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = _whole_blocked(spark, sf_dir)
    return features.features(c, r).select("s1_id", "target_id", *[F.round(F.col(f).cast("double"), 6).alias(f) for f in features.FEATURES])


def single_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One threshold for all candidates: no test of the best one."""
    r, c = _blocked(spark, sf_dir)
    return decision.sweep(_probabilities(c), _queries(r), part_truth(spark, sf_dir), decision.grid(spark, [0.0], decision.SINGLE))


def wide_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = _blocked(spark, sf_dir)
    return decision.sweep(_probabilities(c), _queries(r), part_truth(spark, sf_dir), decision.grid(spark, *decision.TWO_STAGE_WIDE))


def query_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by their rows: the first four fifths train, the rest validate."""
    q = part_entities(spark, sf_dir).where("source = 'S1'").select(F.col("entity_id").alias("s1_id"))
    part = lambda lo, hi, name: labels.query_slice(q, lo, hi).withColumn("part", F.lit(name))
    return part(0.0, 0.8, "train").unionByName(part(0.8, 1.0, "validate"))


def query_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 100 queries."""
    q = part_entities(spark, sf_dir).where("source = 'S1'").select(F.col("entity_id").alias("s1_id"))
    return labels.sample_queries(q, 100)


def two_stage_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = _blocked(spark, sf_dir)
    return _matches(c).select("s1_id", "target_id")


def _swept(spark: SparkSession, sf_dir: str, r: DataFrame, c: DataFrame) -> DataFrame:
    points = decision.grid(spark, *decision.TWO_STAGE)
    return decision.sweep(_probabilities(c), _queries(r), part_truth(spark, sf_dir), points)


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _swept(spark, sf_dir, *_blocked(spark, sf_dir))


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.best_point(_swept(spark, sf_dir, *_whole_blocked(spark, sf_dir))).select("t_singleton", "t_match", "macro_f")


def probability_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = _whole_blocked(spark, sf_dir)
    best = _probabilities(c).groupBy("s1_id").agg(F.max("prob").alias("max_p"))
    return metrics.probability_profile(best)


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = _blocked(spark, sf_dir)
    scored = labels.label(c, part_truth(spark, sf_dir)).select(F.round(F.col("score").cast("double"), 4).alias("score"), "label")
    return metrics.roc_auc(scored)


def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all candidates under a small model of the first four fifths of the queries."""
    r, c = _blocked(spark, sf_dir)
    pairs = cut(labels.label(features.features(c, r), part_truth(spark, sf_dir)))
    first = labels.query_slice(_queries(r), 0.0, 0.8)
    model = ranker.train(labels.of_queries(pairs, first), ranker.Trees(rounds=10, rate=0.3, depth=4))
    return ranker.predict(model, pairs).select("s1_id", "target_id", "label", F.round("prob", 6).alias("prob"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part_entities(spark, sf_dir)
    out = lexical.retrieve(e.where("source = 'S1'"), lexical.fit(e.where("source <> 'S1'")), k=5)
    return out.select("s1_id", "target_id", "rank", F.round("score", 4).alias("score"))


def _tfidf(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = part_entities(spark, sf_dir)
    one, two = (lexical.text_of(e.where(c)) for c in ("source = 'S1'", "source <> 'S1'"))
    idf = lexical.tfidf_fit(two, "entity_id", "text")
    return lexical.tfidf_top(lexical.tfidf(one, "entity_id", "text", idf), lexical.tfidf(two, "entity_id", "text", idf), k)


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tfidf(spark, sf_dir, 5).select("s1_id", "target_id", "rank", F.round("score", 6).alias("score"))


def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 50 ask for the five nearest of all others."""
    e = table(spark, sf_dir, "embeddings")
    out = dense.top_cosine(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", k=5, others=True)
    return out.select("s1_id", "target_id", "rank", F.round("score", 6).alias("score"))


def hybrid_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.interleave(bm25_topk(spark, sf_dir), _tfidf(spark, sf_dir, 5), limit=8)


def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = _blocked(spark, sf_dir)
    return tsv.id_lists(_queries(r), _matches(c), "matched_entity_ids")


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = _whole_blocked(spark, sf_dir)
    return tsv.id_lists(_queries(r), c, "candidate_entity_ids")


def outside_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose true matches, written as a match file, are not all in the candidate file."""
    r, c = _whole_blocked(spark, sf_dir)
    truth = part_truth(spark, sf_dir).withColumn("rank", F.lit(1))
    lines = lambda pairs: validate.parse(tsv.id_lists(_queries(r), pairs, "ids").select(F.concat_ws("\t", "source1_entity_id", "ids").alias("value")))
    return validate.outside_candidates(lines(truth), lines(c))


def _match_file(spark: SparkSession, records: DataFrame, c: DataFrame) -> tuple[str, dict[str, float]]:
    """The written match file and what was counted on the way."""
    path = _fresh(spark, "matches")
    lists = tsv.id_lists(_queries(records), _matches(c), "matched_entity_ids")
    return path, metrics.counted(lists, "matched_entity_ids", lambda rows: tsv.write_lists(rows, path))


def match_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the run that writes the match file, and the statistics of the file read back."""
    path, n = _match_file(spark, *_blocked(spark, sf_dir))
    read = validate.row_stats(validate.read_rows(spark, path))
    return read.select(*[F.lit(n[k]).cast("long").alias(k) for k in ("queries", "ids", "non_empty")], F.col("rows").alias("rows_read"), F.col("empty").alias("empty_read"), F.col("non_empty").alias("non_empty_read"))


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, warnings and exit code for whole, unchecked, swapped, missing, empty and comma-separated result files."""
    r, c = _blocked(spark, sf_dir)
    c = cut(c)
    good, _ = _match_file(spark, r, c)
    listed, absent, blank, commas = (_fresh(spark, n) for n in ("candidates", "absent", "blank", "commas"))
    tsv.write_lists(tsv.id_lists(_queries(r), c, "candidate_entity_ids"), listed, single_file=True)
    spark.createDataFrame([], "value string").write.text(blank)
    spark.createDataFrame([("source1_entity_id,matched_entity_ids",)], "value string").write.text(commas)
    known = prepare.targets(r).select(F.col("entity_id").alias("target_id"))
    cases = {"whole": (good, listed, True), "unchecked": (good, listed, False), "swapped": (listed, good, True), "missing": (absent, f"{absent}-too", True), "blank": (blank, listed, True), "commas": (commas, listed, True)}
    rows = []
    for name, (one, two, check) in cases.items():
        errors, warnings = validate.validate(spark, one, two, _queries(r), known, check)
        rows.append((name, len(errors), len(warnings), validate.exit_code(errors)))
    return spark.createDataFrame(rows, "file string, errors long, warnings long, exit_code long")


def validate_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in a deliberately broken result file."""
    lines = table(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey % 50 = 1 THEN concat('S1-', p_partkey) WHEN p_partkey % 50 = 2 THEN concat('S1-', p_partkey, '\tS1-9,S2-', p_partkey) "
        "WHEN p_partkey % 50 = 3 THEN concat('S1-', p_partkey, '\tX-1,S2-1') WHEN p_partkey % 50 = 4 THEN concat('S1-', p_partkey, '\tS2-1,S2-1') "
        "WHEN p_partkey % 50 = 5 THEN concat('S1-', p_partkey + 1, '\tS3-777777') ELSE concat('S1-', p_partkey, '\t') END AS value"
    )
    e = part_entities(spark, sf_dir)
    known = e.where("source <> 'S1'").select(F.col("entity_id").alias("target_id"))
    found = validate.violations(validate.parse(lines), e.where("source = 'S1'").select(F.col("entity_id").alias("s1_id")), known)
    return validate.summary(found)


_ALL = [
    source_scan, tsv_scan, row_counts, kept_entities, country_counts, base_clean, normalize_name, normalize_addr, composite_text, id_hashes, numbers, char_trigrams, record_tokens, alt_normalize, token_df,
    rare_doc_tokens, rare_query_tokens, composite_keys, key_posting_stats, rare_candidates, composite_candidates, exact_name_blocks, blocked_topk,
    truth_pairs, truth_stats, label_candidates, pair_completeness, blocking_report, macro_f05, entity_scores, singleton_stats, missed_pairs, key_recall,
    token_overlap_features, soundex_match, jaro_winkler, fuzz_ratios, wratio, pair_features, two_stage_decision, single_threshold_grid, threshold_grid, wide_threshold_grid, best_threshold, query_slices, query_sample,
    probability_profile, roc_auc, gbt_scores, bm25_topk, tfidf_topk, embedding_topk, hybrid_interleave, submission_rows, candidate_rows, outside_candidates, match_counters, result_files, validate_submission,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _ALL}


def oracle_sql() -> dict[str, str]:
    return oracle.sql(fixtures)
