"""Query op8: toxicity of every document."""

from obsflow.llm import query, toxicity


@query("op8_toxicity")
def op8(spark, sf):
    return toxicity.scored(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
