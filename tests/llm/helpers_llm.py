"""Small document tables with the awkward cases, and the test tables."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

AWKWARD = [
    "",
    " ",
    "\n",
    "a",
    "two words",
    "a\n\nb c\n d",
    "  lead  and trail \t\r\n",
    "x　y  z  w",
    "<|endoftext|> it's we'll DON'T 123 4567",
    "café über 你好 \U0001f600\U0001f600 İ",
    "a\x1cb \x1c c\x85d\x00e",
    "same words same words same words same words",
    " " * 300 + "q",
    "word " * 3000,
]


def documents(spark, texts, extra=True):
    """A table of the texts with ids 0, 1, ...; with columns named as the operators' own."""
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        clashing = ("ids", "shard", "start", "rest", "block", "share", "kept", "words", "label")
        docs = docs.withColumns({c: F.lit(c) for c in clashing})
    return docs


def awkward(spark):
    docs = documents(spark, [*AWKWARD, None, AWKWARD[4], AWKWARD[4]])
    nameless = documents(spark, ["no id here", None]).selectExpr("cast(null as long) doc_id", "* except(doc_id)")
    return docs.unionByName(nameless).unionByName(docs.where("doc_id = 4")).repartition(3)


def sf_documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
