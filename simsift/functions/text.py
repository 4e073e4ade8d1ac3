"""Cleaning and tokenizing, as column expressions."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import bind

# English stop words. Words with an apostrophe are left out: cleaning deletes it, so they never match.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being have "
    "has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will "
    "just don should now cannot could ought would"
).split()

#: Tokens of a title that count, and characters for each token that are looked at before the rest of a long text.
SENTENCE, START = 16, 32
#: ASCII characters that cleaning deletes.
_OTHER = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c not in " \n")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def strip_tags(html: str | None, compat: bool = False) -> str | None:
    """Text nodes of html, script and style included, entities decoded. compat leaves the parser open, which loses a
    last text that has an unfinished entity or tag."""
    if not html:
        return html
    parser = _Text()
    parser.feed(html)
    if not compat:
        parser.close()
    return "".join(parser.parts)


def strip_html(html: Column, compat: bool = False) -> Column:
    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: strip_tags(x, compat))

    return strip(html)


def clean(text: Column) -> Column:
    """Delete all but ASCII letters, digits, spaces and newlines; lower case. Null and '' stay."""
    plain = F.length(text) == F.octet_length(text)  # ASCII: its other characters are known, and no pattern is matched
    return F.lower(F.when(plain, F.translate(text, _OTHER, "")).otherwise(F.regexp_replace(text, "[^a-zA-Z0-9 \n]+", "")))


def clean_string(html: Column, compat: bool = False) -> Column:
    return clean(strip_html(html, compat))


def words(cleaned: Column) -> Column:
    return F.filter(F.split(F.coalesce(cleaned, F.lit("")), "[ \n]+"), lambda w: w != "")


def clean_query(text: Column) -> Column:
    """Words of a query without stop words, in order; null gives an empty array."""
    return F.filter(F.split(F.coalesce(clean(text), F.lit("")), "[ \n]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def words_array(cleaned_title: Column, limit: int = SENTENCE) -> Column:
    """The first `limit` words of a cleaned title that are no stop words; null gives an empty array."""
    split = F.split(F.coalesce(cleaned_title, F.lit("")), "[ \n]+")
    return F.slice(F.filter(split, lambda w: (w != "") & ~w.isin(STOP_WORDS)), 1, limit)


def tokens(text: Column, limit: int = SENTENCE) -> Column:
    """The first `limit` words of a text that are no stop words. Cleaning goes by characters, so where the text's start
    has so many whole words they are those of all of it; other texts are cleaned to their end."""
    start = F.split(F.coalesce(clean(F.substring(text, 1, START * limit)), F.lit("")), "[ \n]+")
    whole = bind(start, lambda ws: F.slice(ws, F.lit(1), F.size(ws) - 1))  # the last word may be cut
    found = F.slice(F.filter(whole, lambda w: (w != "") & ~w.isin(STOP_WORDS)), 1, limit)
    return bind(found, lambda ws: F.when(F.size(ws) == limit, ws).otherwise(words_array(clean(text), limit)))
