"""Query op11: token counts of every document."""

import public_tokenizers

from obsflow.llm import query, tokens


@query("op11_token_counts")
def op11(spark, sf):
    return tokens.token_counts(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
