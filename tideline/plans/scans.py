"""Scans and sinks as queries: tables are written as text files to the shared folder and read back with the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..sources import readers, sinks
from ..sources.checkpoint import shared_folder
from .catalog import query, table


def _written(df: DataFrame, fmt: str, **options: str) -> str:
    """A new folder of files in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/scan-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(path)
    return path


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, k) for c, k in kinds.items()])


@query("csv_scan", "o_orderkey i, o_orderdate d, o_totalprice f6, priority s", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, nullif(o_orderpriority, '5-LOW') AS priority FROM orders")
def _csv_scan(spark, sf):
    """CSV with dates, missing numbers written as NaN, exact prices and missing text."""
    o = table(spark, sf, "orders")
    price = F.when(F.col("o_orderkey") % 11 == 0, F.lit("NaN")).otherwise(F.col("o_totalprice").cast("string"))
    path = _written(o.select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), price.alias("o_totalprice"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority")), "csv", header="true")
    return readers.read_csv(spark, path, _schema(o_orderkey=T.LongType(), o_orderdate=T.DateType(), o_totalprice=T.DoubleType(), priority=T.StringType()))


@query("csv_pruned", "o_orderdate d, n i", "SELECT CAST(o_orderdate AS DATE) AS o_orderdate, count(*) AS n FROM orders GROUP BY 1")
def _csv_pruned(spark, sf):
    """One column of a CSV file; the scan parses no other."""
    path = _written(table(spark, sf, "orders").withColumn("o_orderdate", F.to_date("o_orderdate")), "csv", header="true")
    schema = _schema(o_orderkey=T.LongType(), o_custkey=T.LongType(), o_orderstatus=T.StringType(), o_totalprice=T.DoubleType(), o_orderdate=T.DateType(), o_orderpriority=T.StringType())
    return readers.read_csv(spark, path, schema).groupBy("o_orderdate").agg(F.count("*").alias("n"))


@query("csv_as_strings", "n_nationkey s, n_name s, remark s", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'NA' ELSE 'null' END AS remark FROM nation")
def _csv_as_strings(spark, sf):
    """Every column as text: neither an empty field nor NA nor null is a missing value."""
    n = table(spark, sf, "nation")
    remark = F.when(F.col("n_nationkey") % 3 == 0, "").when(F.col("n_nationkey") % 3 == 1, "NA").otherwise("null")
    path = _written(n.select("n_nationkey", "n_name", remark.alias("remark")), "csv", header="true", emptyValue="")
    return readers.read_strings(spark, path, ["n_nationkey", "n_name", "remark"])


@query("tsv_scan", "s_suppkey i, s_name s, s_acctbal f6", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _tsv_scan(spark, sf):
    path = _written(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "csv", header="true", sep="\t")
    return readers.read_csv(spark, path, _schema(s_suppkey=T.LongType(), s_name=T.StringType(), s_acctbal=T.DoubleType()), sep="\t")


@query("many_files", "key i, name s, n_files i", "SELECT key, name, CAST(2 AS BIGINT) AS n_files FROM (SELECT r_regionkey AS key, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation)")
def _many_files(spark, sf):
    """Files of one schema, one of them absent and one empty, as one table."""
    schema = _schema(key=T.LongType(), name=T.StringType())
    one = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name")).coalesce(1)
    two = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")).coalesce(1)
    paths = [_written(x, "csv", header="true") for x in (one, two, one.limit(0))]
    rows = readers.read_many(spark, [*paths, f"{paths[0]}-absent"], schema)
    return rows.crossJoin(rows.agg(F.count_distinct("source_file").alias("n_files"))).select("key", "name", "n_files")  # one row on the right


@query("json_scan", "c_custkey i, c_name s, c_acctbal f6", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _json_scan(spark, sf):
    path = _written(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), "json")
    return spark.read.schema(_schema(c_custkey=T.LongType(), c_name=T.StringType(), c_acctbal=T.DoubleType())).json(path)


@query("sink_tables", "segment s, n i, total f2, refused b", "SELECT c_mktsegment AS segment, count(*) AS n, sum(c_acctbal) AS total, true AS refused FROM customer GROUP BY 1")
def _sink_tables(spark, sf):
    """A partitioned table that is written once: a second write is refused, and new keys alone are appended."""
    c = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "segment")
    path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    half = c.where("c_custkey % 2 = 0")
    sinks.write_table(half, path)
    try:
        sinks.write_table(half, path)
        refused = False
    except AnalysisException:
        refused = True
    sinks.append_new(c, path, ["c_custkey"])
    return spark.read.parquet(path).groupBy("segment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total")).withColumn("refused", F.lit(refused))


@query("file_manifest", "n_rows i, n_changed i, same b", "SELECT count(*) AS n_rows, CAST(1 AS BIGINT) AS n_changed, true AS same FROM region")
def _file_manifest(spark, sf):
    """Hashes of a folder's files against those that a manifest has, one of them otherwise."""
    path = _written(table(spark, sf, "region").repartition(5, "r_regionkey").select("r_name"), "json")
    names = [r["path"] for r in sinks.file_hashes(spark, path).select("path").collect()]  # a handful of files
    m = sinks.manifest(spark, path, {"table": "region"})
    same = sinks.changed_files(spark, path, m) == []
    part = [n for n in names if "part-" in n]
    m["inputs"][part[0]] = "otherwise"
    n_rows = spark.read.json(path).count()
    return spark.createDataFrame([(n_rows, len(sinks.changed_files(spark, path, m)), same)], "n_rows long, n_changed long, same boolean")
