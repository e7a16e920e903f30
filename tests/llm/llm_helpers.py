from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ha", "ti", "en"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")
