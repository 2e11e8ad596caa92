"""Checks of a result file's format and content.

Errors forbid the file, warnings do not.  Each check is a filter, a group-by or an anti-join; only the five examples of each
finding reach the driver.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.sources import tsv

EXAMPLES = 5
ERRORS = {
    "no_tab": "row without a tab",
    "duplicate_row": "more than one row for an S1 id",
    "repeated_id": "an id twice in a list",
    "self_match": "an S1 id in a list",
    "wrong_prefix": "an id that begins neither with S2- nor with S3-",
    "unknown_id": "an id that is in no target file",
    "missing_s1": "no row for a required S1 id",
    "extra_s1": "a row for an S1 id that is not required",
}


def parse(lines: DataFrame) -> DataFrame:
    """Lines (value) of a file's body -> s1_id, ids (array), has_tab; ids are split at commas and not trimmed."""
    has = F.instr("value", "\t") > 0
    rest = F.expr("substring(value, instr(value, '\t') + 1)")
    empty = F.trim(F.regexp_replace(rest, r"\s", "")) == ""
    ids = F.when(empty, F.array().cast("array<string>")).otherwise(F.split(rest, ",", -1))
    return lines.where(has | (F.trim("value") != "")).select(F.when(has, F.split_part("value", F.lit("\t"), F.lit(1))).alias("s1_id"), F.when(has, ids).alias("ids"), has.alias("has_tab"), "value")


def violations(rows: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, item): every distinct offender; ``required`` has s1_id, ``known`` (for unknown ids) target_id."""
    good = rows.where("has_tab")
    rule = lambda name, df, col: df.select(F.lit(name).alias("rule"), F.col(col).alias("item"))
    ids = good.select(F.explode("ids").alias("id")).distinct()
    # at most one rule for an id, so that ids are read once
    broken = F.when(F.col("id").startswith("S1-"), "self_match").when(~F.col("id").rlike("^S[123]-"), "wrong_prefix")
    if known is not None:
        ids = ids.join(known.select(F.col("target_id").alias("id")).distinct().withColumn("_known", F.lit(True)), "id", "left")
        broken = broken.when(F.col("_known").isNull(), "unknown_id")
    found = [
        rule("no_tab", rows.where("not has_tab"), "value"),
        rule("duplicate_row", good.groupBy("s1_id").count().where("count > 1"), "s1_id"),
        rule("repeated_id", good.where(F.size("ids") != F.size(F.array_distinct("ids"))), "s1_id"),
        ids.select(broken.alias("rule"), F.col("id").alias("item")).where("rule is not null"),
        rule("missing_s1", required.select("s1_id").join(good.select("s1_id"), "s1_id", "left_anti"), "s1_id"),
        rule("extra_s1", good.select("s1_id").join(required.select("s1_id"), "s1_id", "left_anti"), "s1_id"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def summary(found: DataFrame) -> DataFrame:
    """Per rule: number of offenders and the first examples in order."""
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("rule").orderBy("item"))).where(F.col("k") <= EXAMPLES)
    examples = first.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("item")), ", ").alias("examples"))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).join(examples, "rule")


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """S1 ids with a match that is not among their candidates."""
    # lists meet lists, an S1 id's lines together: exploded, every candidate would be dealt and sorted
    known = candidates.where("has_tab").groupBy("s1_id").agg(F.flatten(F.collect_list("ids")).alias("known"))
    some = matches.where(F.col("has_tab") & (F.size("ids") > 0)).select("s1_id", "ids").join(known, "s1_id", "left")
    return some.where(F.col("known").isNull() | (F.size(F.array_except("ids", "known")) > 0)).select("s1_id").distinct()


def row_stats(rows: DataFrame) -> DataFrame:
    """One row: rows with a tab, and how many of them are empty and not."""
    good = rows.where("has_tab")
    return good.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("ids") == 0).alias("empty"), F.count_if(F.size("ids") > 0).alias("non_empty"))


def _header(spark: SparkSession, path: str, expected: list[str]) -> str | None:
    """What is wrong with the file's existence and header, if anything."""
    try:
        first = spark.read.text(path).limit(1).collect()
    except Exception as e:  # the reader names missing files, bad encodings and access errors differently
        return f"{path}: not readable ({type(e).__name__})"
    if not first:
        return f"{path} is empty"
    line = first[0][0]
    if "\t" not in line and "," in line:
        return f"{path}: the header has commas and no tab; the file must be tab-separated"
    if [c.strip().lower() for c in line.split("\t")] != expected:
        return f"{path}: the header is {line!r}, expected {expected}"
    return None


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a result file, as ``parse`` has them; the first line of each part is the header."""
    reader = spark.read.schema("value string").option("header", True).option("enforceSchema", True).option("sep", "\x01").option("quote", "").option("escape", "")
    return parse(reader.csv(path).where("value is not null"))


def validate(spark: SparkSession, matches: str, candidates: str | None, required: DataFrame, known: DataFrame | None = None, check_ids: bool = False) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a match file and, if there is one, a candidate file."""
    errors, warnings, bodies = [], [], {}
    if not check_ids:
        warnings.append("ids are not checked for existence")
    elif known is None:
        warnings.append("no target files: ids are not checked for existence")
    for path, column in ((matches, "matched_entity_ids"), (candidates, "candidate_entity_ids")):
        if not path:
            continue
        wrong = _header(spark, path, ["source1_entity_id", column])
        if wrong:
            (errors if path == matches or "not readable" not in wrong else warnings).append(wrong)
            continue
        bodies[column] = read_rows(spark, path)
        # kept meanwhile: the summary reads offenders twice, the files once
        found = violations(bodies[column], required, known if check_ids else None).persist()
        for r in summary(found).orderBy("rule").collect():
            errors.append(f"{path}: {ERRORS[r['rule']]}: {r['n']}, e.g. {r['examples']}")
        found.unpersist()
    if len(bodies) == 2:
        n = outside_candidates(bodies["matched_entity_ids"], bodies["candidate_entity_ids"]).count()
        if n:
            warnings.append(f"{n} S1 ids have matches that are not among their candidates")
    return errors, warnings


def exit_code(errors: list[str]) -> int:
    return 1 if errors else 0


def main(arguments: list[str] | None = None) -> int:
    """``python -m kinlink.operators.validate``: prints findings; 0 if there is no error, else 1."""
    parser = argparse.ArgumentParser(description="Check the format and content of result files.")
    parser.add_argument("--matching", "-m", default="output/matching_results.tsv")
    parser.add_argument("--candidate", "-c", default=None, help="by default output/candidate_pairs.tsv, if there is one")
    parser.add_argument("--test-dir", "-t", default="dataset/test", help="folder of test_source1.tsv, test_source2.tsv, test_source3.tsv")
    parser.add_argument("--check-ids", action="store_true", help="also look for ids that no target file has")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    try:
        source = lambda i: tsv.read_entities(spark, f"{a.test_dir}/test_source{i}.tsv", f"S{i}")
        required = source(1).select(F.col("entity_id").alias("s1_id"))
        known = source(2).unionByName(source(3)).select(F.col("entity_id").alias("target_id")) if a.check_ids else None
        errors, warnings = validate(spark, a.matching, a.candidate or "output/candidate_pairs.tsv", required, known, a.check_ids)
    except Exception as e:  # missing sources and unreadable files come as Spark's own errors
        errors, warnings = [f"could not read a file: {str(e).splitlines()[0]}"], []
    for x in warnings:
        print(f"WARNING: {x}")
    for k, x in enumerate(errors, 1):
        print(f"{k}. {x}")
    print(f"FAIL: {len(errors)} error(s)" if errors else "PASS")
    return exit_code(errors)


if __name__ == "__main__":
    sys.exit(main())
