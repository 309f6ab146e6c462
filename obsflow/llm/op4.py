"""Query op4: fingerprints of documents and of their edited texts."""

from obsflow.llm import fingerprint, query


@query("op4_fingerprints")
def op4(spark, sf):
    return fingerprint.fingerprints(spark.read.parquet(f"{sf}/documents.parquet"))
