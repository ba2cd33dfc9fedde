"""File sources and sinks, and layouts that stand for secondary indexes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json")
OTHERS = ("text", "jdbc")  # one text column; a database, with its address and table as options
FILE_ROWS = 1 << 22  # of narrow rows, that one task sorts and writes


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options: str) -> str:
    if kind not in FORMATS + OTHERS:
        raise ValueError(f"unknown format {kind}")
    out = df.write.mode(mode).format(kind).options(**({"header": "true"} if kind == "csv" else {}), **options)
    out = out.partitionBy(*partition_by) if partition_by else out
    out.save() if kind == "jdbc" else out.save(path)
    return path


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options: str) -> DataFrame:
    """CSV and JSON need a schema: it is never inferred by a second pass."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}), **options)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.load() if kind == "jdbc" else reader.load(path)


def write_sorted(df: DataFrame, path: str, columns: list[str], files: int | None = None, **options: str) -> str:
    """Range-partitioned and sorted, so row-group statistics prune equality and ranges."""
    spread = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    return write(spread.sortWithinPartitions(*columns), path, mode="overwrite", **options)


def write_bloom(df: DataFrame, path: str, columns: list[str], distinct: int = 1_000_000) -> str:
    """With Parquet bloom filters, so absent keys skip whole row groups."""
    options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns} | {f"parquet.bloom.filter.expected.ndv#{c}": str(distinct) for c in columns}
    return write(df, path, mode="overwrite", **options)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, columns: list[str]) -> str:
    """A table whose buckets co-locate joins and groups on ``columns``: equal numbers of buckets need no shuffle."""
    df.repartition(buckets, *columns).write.mode("overwrite").bucketBy(buckets, *columns).sortBy(*columns).option("path", path).saveAsTable(table)
    return table


def column_chunks(spark: SparkSession, path: str) -> DataFrame:
    """column, codec, encodings, values, compressed and plain bytes of each column chunk, from the files' footers."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where, hadoop = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.parquet.hadoop
    rows = []
    for status in where.getFileSystem(conf).listStatus(where):
        if status.getPath().getName().endswith(".parquet"):
            reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromStatus(status, conf))
            for block in reader.getFooter().getBlocks():
                for c in block.getColumns():
                    rows.append((c.getPath().toDotString(), c.getCodec().name().lower(), sorted(e.name() for e in c.getEncodings()), c.getValueCount(), c.getTotalSize(), c.getTotalUncompressedSize()))
            reader.close()
    return spark.createDataFrame(rows, "column string, codec string, encodings array<string>, n long, bytes long, plain_bytes long")


def bitmap_index(df: DataFrame, value: str, row: str) -> DataFrame:
    """A bitmap of row numbers for each value and 32,768-row bucket."""
    return df.groupBy(F.col(value).alias("value"), F.bitmap_bucket_number(row).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("bitmap"))


def bitmap_count(index: DataFrame, values: list) -> DataFrame:
    """Rows of each value, and of any of them together: OR of bitmaps, bucket by bucket."""
    merged = index.where(F.col("value").isin(values)).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return merged.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("long").alias("n"))


def bitmap_and_count(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that both bitmaps have: AND, bucket by bucket."""
    one = lambda df: df.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), F.lit(1).alias("side"))
    both = one(left).unionByName(one(right)).groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("sides")).where("sides = 2")
    return both.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("long").alias("n"))


def bitmap_xor_count(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one of two bitmaps has: what each has, less twice what both have."""
    count = lambda df: df.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("long").alias("n"))
    parts = count(left).select("n").unionByName(count(right)).unionByName(bitmap_and_count(left, right).select((F.col("n") * -2).alias("n")))
    return parts.agg(F.sum("n").alias("n"))


def bitmap_rows(index: DataFrame) -> DataFrame:
    """value and row number of every bit: the bitmaps as lists."""
    byte = index.select("value", "bucket", "bitmap", F.explode(F.sequence(F.lit(0), F.octet_length("bitmap") - 1)).alias("at"))
    byte = byte.select("value", "bucket", "at", F.conv(F.hex(F.substring("bitmap", F.col("at") + 1, F.lit(1))), 16, 10).cast("int").alias("b")).where("b > 0")
    bit = byte.select("value", "bucket", "at", "b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).where("(b & shiftleft(1, k)) > 0")
    return bit.select("value", F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + F.col("at") * 8 + F.col("k") + 1).otherwise(F.col("bucket") * 32768 - F.col("at") * 8 - F.col("k")).alias("row"))


def bloom_bits(rows: int, hashes: int = 5, errors: float = 0.005) -> int:
    """Bits for filters of up to ``rows`` values so that the share of errors stays below ``errors``: whole bitmaps, 2 ** 20 at least."""
    need = math.ceil(-hashes * rows / math.log(1 - errors ** (1 / hashes)))
    return max(1 << 20, -(-need // 32768) * 32768)


def bloom_index(df: DataFrame, column: str, bits: int = 1 << 20, hashes: int = 5) -> DataFrame:
    """A bloom filter as bitmaps of its bits: (bucket, bitmap); made by partial aggregation, nothing of it on the driver."""
    return _bloom_places(df.select(F.col(column).alias("v")).where("v is not null"), bits, hashes).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))


def _bloom_places(df: DataFrame, bits: int, hashes: int) -> DataFrame:
    place = F.transform(F.sequence(F.lit(1), F.lit(hashes)), lambda k: F.pmod(F.xxhash64(k, F.col("v").cast("string")), F.lit(bits)))
    return df.select("*", F.explode(place).alias("place"))


def bloom_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bloom_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bits of both: may hold what neither input has in common, never lacks what both have."""
    both = a.unionByName(b).groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("sides"))
    return both.where("sides = 2").drop("sides")


def bloom_contains(index: DataFrame, values: DataFrame, column: str, bits: int = 1 << 20, hashes: int = 5) -> DataFrame:
    """The rows of ``values`` that the filter may hold: all of their bits are set."""
    asked = _bloom_places(values.select(F.col(column).alias("v")).where("v is not null").distinct(), bits, hashes).withColumn("bucket", F.bitmap_bucket_number("place")).withColumn("bit", F.bitmap_bit_position("place"))
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = asked.join(index, "bucket").where((byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))"))) > 0)
    found = met.groupBy("v").agg(F.countDistinct("place").alias("met")).join(asked.groupBy("v").agg(F.countDistinct("place").alias("all")), "v").where("met = all")
    return values.join(found.select("v"), values[column] == found["v"], "left_semi")


def bloom_false_positives(index: DataFrame, bits: int = 1 << 20, hashes: int = 5) -> DataFrame:
    """fpr: the share of set bits to the number of hashes."""
    return index.agg(F.pow(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)) / bits, F.lit(hashes)).alias("fpr"))


def inverted_index(df: DataFrame, row: str, text: str) -> DataFrame:
    """(term, row, n): lower-case words of letters and digits, and how often each row has them."""
    words = F.explode(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))
    return df.select(F.col(row).alias("row"), words.alias("term")).groupBy("term", "row").agg(F.count("*").alias("n"))


def search_all(index: DataFrame, terms: list[str]) -> DataFrame:
    """Rows that have every term."""
    want = sorted(set(terms))
    return index.where(F.col("term").isin(want)).groupBy("row").agg(F.count("*").alias("met")).where(F.col("met") == len(want)).select("row")


def latest_version(df: DataFrame, key: str, order: list[str], deleted: str | None = None) -> DataFrame:
    """Last write wins: the newest row of each key, unless it is a tombstone; one aggregation, no window."""
    newest = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")
    return newest.where(~F.coalesce(F.expr(deleted), F.lit(False))) if deleted else newest


def compact(spark: SparkSession, source: str, target: str, file_bytes: int = 256 << 20) -> int:
    """Rewrite small Parquet files into about ``file_bytes`` each; returns the number of files asked for."""
    df = spark.read.parquet(source)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(1, -(-size // file_bytes))
    write(df.repartition(n), target, mode="overwrite")
    return n
