"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

SAMPLE_STORE = T.StructType([
    T.StructField("sample_id", T.LongType(), False),
    T.StructField("original_text", T.StringType(), False),
    T.StructField("normalized_text", T.StringType(), False),
    T.StructField("text_hash", T.StringType(), False),
    T.StructField("codes", T.StringType(), False),
    T.StructField("vector_data", T.BinaryType(), False),
    T.StructField("vector_dim", T.IntegerType(), False),
    T.StructField("source_file", T.StringType(), True),
    T.StructField("enabled", T.IntegerType(), False),
    T.StructField("create_time", T.TimestampType(), False),
    T.StructField("model_version", T.StringType(), False),
])

SHEET = T.StructType([
    T.StructField("row_no", T.IntegerType(), False),
    T.StructField("paragraph", T.StringType(), True),
    T.StructField("raw_codes", T.StringType(), True),
])

IMPORT_ERROR = T.StructType([T.StructField("row_no", T.LongType()), T.StructField("message", T.StringType())])
