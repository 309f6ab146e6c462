"""Query op2: main text of every page."""

from obsflow.llm import html_text, query


@query("op2_html_text")
def op2(spark, sf):
    return html_text.extracted(spark.read.parquet(f"{sf}/pages.parquet"))
