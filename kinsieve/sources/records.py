"""Reading and writing person records, result documents and metric tables."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PERSON = StructType(
    [
        StructField("first_name", StringType(), True),
        StructField("last_name", StringType(), True),
        StructField("date_of_birth", StringType(), True),
        StructField("address", StringType(), True),
        StructField("email", StringType(), True),
    ]
)
FIELDS = PERSON.fieldNames()


def to_person(df: DataFrame) -> DataFrame:
    """The five person columns; ValueError for a missing or an unknown column, as a typed record would refuse it."""
    missing, extra = [c for c in FIELDS[:3] if c not in df.columns], [c for c in df.columns if c not in FIELDS]
    if missing or extra:
        raise ValueError(f"not person records: missing {missing}, unknown {extra}")
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in FIELDS])


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """People from a JSON list, a JSON object with a ``people`` list, JSON lines, or a CSV with a header; empty cells are null."""
    if path.endswith(".csv"):
        raw = spark.read.option("header", True).option("nullValue", "").csv(path)
        return to_person(raw.select([c for c in raw.columns if c in FIELDS]))
    nested = StructType([*PERSON.fields, StructField("people", _list(PERSON), True)])
    raw = spark.read.schema(nested).option("multiLine", not path.endswith(".jsonl")).json(path)
    listed = raw.where("people is not null").select(F.inline("people"))
    return raw.where("people is null").drop("people").unionByName(listed)


def _list(kind: StructType):
    from pyspark.sql.types import ArrayType

    return ArrayType(kind, True)


def query_frame(spark: SparkSession, record: dict) -> DataFrame:
    """One query as a table; names and birth date are required."""
    if absent := [f for f in FIELDS[:3] if not record.get(f)]:
        raise ValueError(f"missing fields: {', '.join(absent)}")
    return spark.createDataFrame([tuple(record.get(f) for f in FIELDS)], PERSON)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_document(result: dict, path: str) -> None:
    """A result document (parameters, timing and results, all small) as JSON."""
    Path(path).write_text(json.dumps(result, indent=2, sort_keys=True, default=str), encoding="utf-8")


def write_metrics(tables: list[DataFrame], path: str) -> DataFrame:
    """Tables of different metric columns as one CSV whose columns stand by name; absent values are empty."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    both = both.select(*sorted(both.columns))
    write_csv(both, path)
    return both


def with_row_number(df: DataFrame, name: str = "row_no") -> DataFrame:
    """A dense number in the order in which the rows are read, without bringing them to one task: offsets of the partitions are summed on the driver.

    The rows must come in the same partitions each time they are read, as from files; of a sorted table use ``compact`` on its key.
    """
    spark = df.sparkSession
    tagged = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33).cast("int"))
    sizes = sorted((r["_part"], r["count"]) for r in tagged.groupBy("_part").count().collect())  # a row for each partition
    base, rows = 0, []
    for part, n in sizes:
        rows.append((part, base))
        base += n
    start = spark.createDataFrame(rows, "_part int, _base bigint")
    number = F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.join(F.broadcast(start), "_part").withColumn(name, number).drop("_id", "_part", "_base")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores dealt to all of them: what joins make of a small file's rows would otherwise be one task. A larger scan stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def compact(df: DataFrame, name: str = "position") -> DataFrame:
    """Numbers with gaps made dense, in their order: how far a row moves up is the sum of the rows in earlier blocks of numbers, so no task sorts all rows."""
    size = 1 << 16
    rows = df.withColumn("_block", F.expr(f"`{name}` div {size}"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_block").agg(F.count("*").alias("n")).select("_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))  # a row for 65,536 numbers
    place = F.row_number().over(Window.partitionBy("_block").orderBy(name)) - 1
    return rows.withColumn("_place", place).join(base, "_block").withColumn(name, F.col("_base") + F.col("_place")).select(df.columns)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))
