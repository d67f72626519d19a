"""Title and visible text of HTML pages, and passages around words.

Markup is taken apart by regular expressions inside the JVM; only character
references are resolved in Python, for the texts that hold any.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Elements whose contents a reader never sees.  A head needs no entry: but for these and its title it holds empty elements only, and its end tag may be left out.
UNSEEN = ("script", "style", "noscript", "template", "svg")
#: Elements that begin and end a line.
LINES = ("address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h[1-6]", "header", "hr", "li", "main", "nav", "ol", "option", "p", "pre", "section", "table", "td", "th", "tr", "ul")
_INSIDE = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
_COMMENT = r"(?s)<!--.*?(?:-->|$)"
_HIDDEN = rf"(?is)<({'|'.join(UNSEEN)})\b{_INSIDE}>.*?(?:</\1\s*>|$)"
_TITLE = rf"(?is)<title\b{_INSIDE}>(.*?)(?:</title\s*>|$)"
_LINE = rf"(?i)</?(?:{'|'.join(LINES)})\b{_INSIDE}>"
#: The second form takes tags whose quotes never close.
_TAGS = (rf"(?s)<[/!?]?[a-zA-Z]{_INSIDE}>", r"(?s)<[/!?]?[a-zA-Z][^>]*>")


@pandas_udf(StringType())
def _resolved(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def _bare(text: Column) -> Column:
    for tag in _TAGS:
        text = F.regexp_replace(text, tag, "")
    return text


def _squeezed(text: Column) -> Column:
    """White space squeezed inside lines, empty lines dropped."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"\r\n?|[\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", "\n"), r"(?U)[\s&&[^\n]]+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def page_text(pages: DataFrame, most: int | None = None) -> DataFrame:
    """pages (page_id, html) -> page_id, title, text; most cuts each text, by default none is cut.

    A page's title is that of all its title elements.  A null page has an empty title and text.
    """
    seen = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), _COMMENT, ""), _HIDDEN, "")
    title = F.array_join(F.regexp_extract_all("seen", F.lit(_TITLE), F.lit(1)), "")
    text = _bare(F.regexp_replace(F.regexp_replace("seen", _TITLE, ""), _LINE, "\n"))
    parts = pages.select("page_id", seen.alias("seen")).select("page_id", title.alias("title"), text.alias("text"))
    # a reference may stand for white space, so lines are squeezed after
    whole = parts.select("page_id", *(F.when(F.contains(c, F.lit("&")), _resolved(c)).otherwise(F.col(c)).alias(c) for c in ("title", "text")))
    found = whole.select("page_id", F.trim(F.regexp_replace("title", r"(?U)\s+", " ")).alias("title"), _squeezed(F.col("text")).alias("text"))
    return found if most is None else found.withColumn("text", F.left("text", F.lit(most)))


def passages(pages: DataFrame, words: list[str], around: int = 200, most: int = 5) -> DataFrame:
    """pages (page_id, text) -> page_id, passages: text around the first word, where all words stand."""
    first, rest = words[0].lower(), [w.lower() for w in words[1:]]

    def run(batches):
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = []
                for hit in re.finditer(re.escape(first), (text or "").lower()):
                    part = text[max(0, hit.start() - around) : hit.end() + around]
                    if all(w in part.lower() for w in rest):
                        found.append(part)
                    if len(found) == most:
                        break
                out.append(found)
            yield pd.DataFrame({"page_id": batch["page_id"], "passages": out})

    return pages.select("page_id", F.col("text")).mapInPandas(run, "page_id long, passages array<string>")
