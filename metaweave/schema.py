"""Schemas of the engine's tables: ids are strings, an edge is (n1, n2, w)."""

from __future__ import annotations

from pyspark.sql import types as T

EDGE = T.StructType([T.StructField("n1", T.StringType()), T.StructField("n2", T.StringType()), T.StructField("w", T.DoubleType())])
HIERARCHY = T.StructType([T.StructField("child", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("otgy", T.StringType())])
NODE = T.StructType([T.StructField("code", T.StringType()), T.StructField("mnd", T.StringType()), T.StructField("vocabulary", T.StringType()), T.StructField("is_reference", T.BooleanType())])
VECTOR = T.StructType([T.StructField("nd", T.StringType()), T.StructField("mnd", T.StringType()), T.StructField("v", T.ArrayType(T.FloatType()))])
