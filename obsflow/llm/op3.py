"""Query op3: documents with format-preserving pseudonyms."""

import secrets

from obsflow.llm import pii, query

# Set this to a secret of the corpus, so that its values have the same pseudonyms in every session.
KEY = "spark.obsflow.pseudonym.key"

# "true": 05/12/2024 is the 5th of December.
DAY_FIRST = "spark.obsflow.pseudonym.dayfirst"


def key(spark) -> str:
    """The key of the session's setting; where there is none, one is drawn and set, so nobody else can reverse the pseudonyms."""
    if not spark.conf.get(KEY, ""):
        spark.conf.set(KEY, secrets.token_hex(32))
    return spark.conf.get(KEY)


def day_first(spark) -> bool:
    return spark.conf.get(DAY_FIRST, "false").lower() == "true"


@query("op3_pseudonyms")
def op3(spark, sf):
    return pii.pseudonymised(spark.read.parquet(f"{sf}/documents.parquet"), key(spark), day_first=day_first(spark))
