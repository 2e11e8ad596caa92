"""Result files: lists are made in many tasks also for a single file, and each id is judged in one reading."""

import glob

from pyspark.sql import functions as F

from kinlink.operators import validate
from kinlink.sources import tsv


def test_single_file_is_written_by_one_task_and_made_by_many(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        seen.add(1)
        yield from batches

    lists = spark.range(0, 40, 1, 4).selectExpr("concat('S1-', id) AS source1_entity_id", "'' AS ids").mapInArrow(run, "source1_entity_id string, ids string")
    tsv.write_lists(lists, str(tmp_path / "one"), single_file=True)
    assert len(glob.glob(str(tmp_path / "one" / "part-*"))) == 1 and seen.value == 4


def test_every_id_has_its_rule(spark):
    lines = spark.createDataFrame([("S1-1\tS2-1,S1-9,X-1,S3-7,S2-7",), ("S1-2\tS2-1,S4-1, S2-1",)], "value string")
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    known = spark.createDataFrame([("S2-1",), ("S2-1",), ("S3-1",)], "target_id string")
    got = lambda k: sorted(map(tuple, validate.violations(validate.parse(lines), required, k).collect()))
    want = [("self_match", "S1-9"), ("wrong_prefix", " S2-1"), ("wrong_prefix", "S4-1"), ("wrong_prefix", "X-1")]
    assert got(None) == want
    assert got(known) == sorted([*want, ("unknown_id", "S2-7"), ("unknown_id", "S3-7")])


def test_ids_are_read_once(spark):
    rows = validate.parse(spark.createDataFrame([("S1-1\tS2-1",)], "value string")).where(F.col("has_tab"))
    found = validate.violations(rows, spark.createDataFrame([("S1-1",)], "s1_id string"), spark.createDataFrame([("S2-1",)], "target_id string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(ids") == 1
