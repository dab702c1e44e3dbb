"""Raw vector files, their hashes, artifacts and JSON reports."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import Corrupt


def raw_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``row_id, v`` from a headerless file of little-endian floats; the row id is the position in the file.

    Records are read in parallel splits. A length that is not a whole number of rows is refused by the reader.
    """
    width = 4 * dim
    indexed = spark.sparkContext.binaryRecords(path, width).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))
    packed = spark.createDataFrame(indexed, T.StructType([T.StructField("row_id", T.LongType()), T.StructField("b", T.BinaryType())]))

    def run(batches):
        for part in batches:
            x = np.frombuffer(b"".join(part.b), "<f4").reshape(-1, dim)
            yield pd.DataFrame({"row_id": part.row_id, "v": list(x)})

    return packed.mapInPandas(run, "row_id long, v array<float>")


def corpus_hash(rows: DataFrame) -> str:
    """A hash of all rows ``row_id, v`` that does not depend on their order or partitions."""
    h = F.sha2(F.concat_ws(",", F.col("row_id").cast("string"), F.transform("v", lambda x: F.hex(x.cast("double").cast("string")))), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)"))
    sums = rows.select(*(part(i).alias(f"s{i}") for i in range(8)), F.count("*").alias("n")).first()
    return hashlib.sha256(repr(tuple(str(x) for x in sums)).encode()).hexdigest()


def descriptor(path: str, check: bool = True) -> dict:
    """A JSON descriptor of a raw file: ``path, dimension, row_count, sha256``; refused if the file is another."""
    with open(path) as f:
        d = json.load(f)
    if missing := {"path", "dimension", "row_count", "sha256"} - d.keys():
        raise Corrupt(f"descriptor without {sorted(missing)}")
    if check:
        h, size = hashlib.sha256(), 0
        with open(d["path"], "rb") as f:
            while chunk := f.read(1 << 20):
                h.update(chunk)
                size += len(chunk)
        if size != 4 * d["dimension"] * d["row_count"] or h.hexdigest() != d["sha256"]:
            raise Corrupt(f"{d['path']} is not the file described")
    return d


def write_lists(lists: DataFrame, path: str, rows: int, k: int) -> None:
    """Exact lists ``query_id, rank, row_id, score`` as Parquet, with a header that says of how many rows they are the
    best ``k`` and how many of them there are."""
    lists.select("query_id", F.col("rank").cast("int"), "row_id", "score").write.parquet(f"{path}/lists")
    spark = lists.sparkSession
    count = spark.read.parquet(f"{path}/lists").count()
    spark.createDataFrame([(rows, k, count)], "rows long, k int, hits long").coalesce(1).write.json(f"{path}/header")


def read_lists(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """Such lists, the number of rows and k; refused unless whole, ranked, of distinct rows and within the rows."""
    header = spark.read.schema("rows long, k int, hits long").json(f"{path}/header").collect()
    if len(header) != 1 or None in header[0]:
        raise Corrupt(f"no header in {path}")
    rows, k, hits = header[0]
    lists = spark.read.schema("query_id long, rank int, row_id long, score double").parquet(f"{path}/lists")
    before = Window.partitionBy("query_id").orderBy("rank")
    last, row = F.lag("score").over(before), F.lag("row_id").over(before)
    wrong = F.col("query_id").isNull() | F.col("row_id").isNull() | F.isnan("score") | F.col("score").isNull() | (F.col("row_id") < 0) | (F.col("row_id") >= rows)
    out_of_order = (F.col("rank") != F.row_number().over(before)) | (F.col("score") > last) | ((F.col("score") == last) & (F.col("row_id") <= row))
    each = lists.withColumn("_bad", wrong | F.coalesce(out_of_order, F.lit(False))).groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("d"), F.bool_or("_bad").alias("bad"))
    said = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bool_or(F.col("bad") | (F.col("d") != F.col("n")) | (F.col("n") != min(k, rows))), F.lit(False)).alias("bad")).first()
    if said["bad"] or said["n"] != hits:
        raise Corrupt(f"the lists in {path} are not whole and ranked")
    return lists, rows, k


def validate(value, schema: dict, where: str = "$") -> None:
    """Check a JSON value against the common keywords of a schema; unknown keywords are refused."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}
    known = {"type", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "minLength", "maxLength", "pattern", "$schema", "title", "description"}
    if unknown := schema.keys() - known:
        raise ValueError(f"{where}: unknown keywords {sorted(unknown)}")
    wanted = schema.get("type")
    if wanted is not None:
        names = wanted if isinstance(wanted, list) else [wanted]
        if not any(isinstance(value, kinds[n]) and not (n in ("number", "integer") and isinstance(value, bool)) for n in names):
            raise ValueError(f"{where}: not {wanted}")
    if "const" in schema and value != schema["const"] or "enum" in schema and value not in schema["enum"]:
        raise ValueError(f"{where}: {value!r} is not allowed")
    if isinstance(value, dict):
        if lost := set(schema.get("required", ())) - value.keys():
            raise ValueError(f"{where}: without {sorted(lost)}")
        for name, v in value.items():
            if name in schema.get("properties", {}):
                validate(v, schema["properties"][name], f"{where}.{name}")
            elif schema.get("additionalProperties", True) is False:
                raise ValueError(f"{where}: {name} is not expected")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            raise ValueError(f"{where}: {len(value)} items")
        for i, v in enumerate(value):
            validate(v, schema.get("items", {}), f"{where}[{i}]")
    if isinstance(value, str):
        import re

        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)) or "pattern" in schema and not re.search(schema["pattern"], value):
            raise ValueError(f"{where}: {value!r} does not fit")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value) or "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
            raise ValueError(f"{where}: {value} is out of range")


def write_report(path: str, report: dict, schema: dict) -> None:
    """Write a report that keeps to its schema, else raise and write nothing."""
    validate(report, schema)
    with open(path, "w") as f:
        json.dump(report, f, indent=2, sort_keys=True, allow_nan=False)
