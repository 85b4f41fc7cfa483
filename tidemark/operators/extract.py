"""Article extraction from stored HTML."""

from __future__ import annotations

from collections.abc import Sequence
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.operators.article import scored_articles
from tidemark.operators.markup import TextParser, tidy

NO_ARTICLE = "Readability could not parse article"

def article_texts(pages: Sequence[str | None]) -> list[str | None]:
    """Text of each page's article element, else of its best scored elements, else of its body."""
    out: list[str | None] = []
    rest: list[int] = []
    for html in pages:
        parser = TextParser()
        parser.feed(html or "")
        parser.close()
        article = tidy(parser.article)
        body = tidy(parser.body)
        if body and not article:
            rest.append(len(out))
        out.append(article or body or None)
    for i, text in zip(rest, scored_articles([pages[i] for i in rest]), strict=True):
        out[i] = text or out[i]
    return out


def article_text(html: str | None) -> str | None:
    """The article of one page; None when it has no text."""
    return article_texts([html])[0]


@F.pandas_udf(StringType())
def _decoded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unescape(t))


@F.pandas_udf(StringType())
def _article(html: pd.Series) -> pd.Series:
    return pd.Series(article_texts(html.tolist()), index=html.index, dtype=object)


def page_title(html: Column | str) -> Column:
    """Title element with its character references decoded, in Arrow batches."""
    h = F.col(html) if isinstance(html, str) else html
    return F.nullif(F.trim(_decoded(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def extract_article(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds title, text_content and error in Arrow batches; the HTML is dropped."""
    return (
        pages.withColumn("title", page_title(html))
        .withColumn("text_content", _article(F.col(html)))
        .withColumn("error", F.when(F.col("text_content").isNull(), F.lit(NO_ARTICLE)))
        .drop(html)
    )
