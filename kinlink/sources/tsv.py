"""Tab-separated sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("s1_id", "ids")])
MATCH_HEADER = ["source1_entity_id", "matched_entity_ids"]
CANDIDATE_HEADER = ["source1_entity_id", "candidate_entity_ids"]


def _read(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", True)
    # a record is a line, also inside quotes, so that files can be split
    return reader.option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def source_tag(file: str = "source") -> str:
    """Pattern of the number in ``..._source<N>.tsv``, a file or a folder of parts."""
    return rf"{file}(\d)\.tsv"


def read_entities(spark: SparkSession, path: str | list[str], source: str | None = None) -> DataFrame:
    """Records of one or more source files: missing fields are empty; ``source`` (S1, S2, S3) is given or read off the file's name."""
    df = _read(spark, path, ENTITY)
    tag = F.lit(source) if source else F.concat(F.lit("S"), F.regexp_extract(F.col("_metadata.file_path"), source_tag(), 1))
    return df.select(tag.alias("source"), *[F.coalesce(c, F.lit("")).alias(c) for c in ENTITY.names])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, target_id) in long form; rows without a second field are skipped, singletons give no row."""
    return explode_truth(_read(spark, path, TRUTH))


def explode_truth(lists: DataFrame) -> DataFrame:
    """(s1_id, ids as comma-joined text) -> distinct (s1_id, target_id)."""
    ids = F.filter(F.transform(F.split("ids", ","), lambda x: F.trim(x)), lambda x: x != "")
    return lists.where("s1_id is not null and ids is not null").select(F.trim("s1_id").alias("s1_id"), F.explode(ids).alias("target_id")).where("s1_id <> ''").distinct()


def count_rows(spark: SparkSession, path: str) -> int:
    """Records of a file without its header, also where the last line has no line end."""
    return _read(spark, path, ENTITY).count()


def country_counts(entities: DataFrame) -> DataFrame:
    """(source, country, n): labels of each source; blank is unknown."""
    return entities.groupBy("source", F.trim(F.coalesce("country", F.lit(""))).alias("country")).agg(F.count(F.lit(1)).alias("n"))


def id_lists(queries: DataFrame, pairs: DataFrame, column: str, order: str = "rank") -> DataFrame:
    """One row for each query: its targets in the order of ``order``, without repeats, comma-joined (none: empty)."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("target_id").alias("id"))))
    ids = F.array_join(F.array_distinct(F.transform(listed, lambda x: x["id"])), ",")
    per = pairs.groupBy("s1_id").agg(ids.alias("_ids"))
    return queries.select("s1_id").distinct().join(per, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("_ids", F.lit("")).alias(column))


def write_entities(entities: DataFrame, path: str) -> list[str]:
    """TSV sources below ``path``, a folder of parts for each of S1, S2 and S3; returns their paths."""
    out = [f"{path.rstrip('/')}/entities_source{i}.tsv" for i in (1, 2, 3)]
    for i, x in enumerate(out):
        rows = entities.where(F.col("source") == f"S{i + 1}").select(ENTITY.names)
        rows.write.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(x)
    return out


def write_lists(lists: DataFrame, path: str, single_file: bool = False) -> None:
    """TSV with a header; one part for each partition, or a single file."""
    # dealt to the one writer: coalesced, the lists would also be made in its task
    out = lists.repartition(1) if single_file else lists
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("quoteAll", False).option("emptyValue", "").option("nullValue", "").csv(path)


def is_complete(spark: SparkSession, path: str, rows: int | None = None) -> bool:
    """Whether a table was written whole: its success mark, and its number of rows if given."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        return False
    return rows is None or spark.read.parquet(path).count() == rows


def cached(spark: SparkSession, df: DataFrame, path: str, parameters: dict | None = None) -> DataFrame:
    """``df`` kept as a table below ``path``, in a folder of its own for each set of parameters; an earlier complete one is reused."""
    key = "-".join(f"{k}={v}" for k, v in sorted((parameters or {}).items())) or "default"
    full = f"{path.rstrip('/')}/{key}"
    if not is_complete(spark, full):
        df.write.mode("overwrite").parquet(full)
    return spark.read.parquet(full)
