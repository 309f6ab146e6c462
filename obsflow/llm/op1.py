"""Query op1: byte-level BPE of every document, and back."""

import public_tokenizers

from obsflow.llm import bpe, query


@query("op1_byte_bpe")
def op1(spark, sf):
    return bpe.round_trip(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
