"""Fixed schemas: the gazetteer and the token tables."""

from pyspark.sql import types as T

# The 19 columns of the public gazetteer dump, in file order.
GEONAMES_FIELDS = [
    ("geonameid", T.LongType()),
    ("main_name", T.StringType()),
    ("asciiname", T.StringType()),
    ("alternatenames", T.StringType()),
    ("latitude", T.DoubleType()),
    ("longitude", T.DoubleType()),
    ("feature_class", T.StringType()),
    ("feature_code", T.StringType()),
    ("country_code", T.StringType()),
    ("cc2", T.StringType()),
    ("admin1_code", T.StringType()),
    ("admin2_code", T.StringType()),
    ("admin3_code", T.StringType()),
    ("admin4_code", T.StringType()),
    ("population", T.LongType()),
    ("elevation", T.IntegerType()),
    ("dem", T.IntegerType()),
    ("timezone", T.StringType()),
    ("modification_date", T.StringType()),
]
GEONAMES = T.StructType([T.StructField(n, t) for n, t in GEONAMES_FIELDS])

TOKEN_STRUCT = T.StructType([T.StructField("chars", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("length", T.IntegerType())])
