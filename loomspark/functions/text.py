"""Text functions as Column builders; all but the markup walkers stay in the JVM."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_once(c: Column, at: str = ":") -> Column:
    """The text before and after the first separator; one element if there is none."""
    return F.split(c, re.escape(at), 2)


def year_of(c: Column) -> Column:
    """Year of a yyyymmdd text."""
    return F.substring(c, 1, 4).cast("int")


def render_series(series: Column, *fields: str) -> Column:
    """array<struct> as [(a,b),(a,b)]."""
    one = lambda x: F.concat(F.lit("("), F.concat_ws(",", *[F.coalesce(x[f].cast("string"), F.lit("NaN")) for f in fields]), F.lit(")"))
    return F.concat(F.lit("["), F.array_join(F.transform(series, one), ","), F.lit("]"))


def id_form(c: Column) -> Column:
    """A-Z in lower case, spaces as underscores; other characters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ ", "abcdefghijklmnopqrstuvwxyz_")


def plain_letters(c: Column) -> Column:
    """Lower case, white space as single spaces, all but a-z and spaces gone, no space at either end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), "[^a-z ]", ""))


def char_tokens(c: Column) -> Column:
    """One token a character, a space as <space>."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.when(x == " ", "<space>").otherwise(x))


def tokens(c: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")


def arcs(tokens_: Column) -> Column:
    """A linear acceptor's arcs: array<struct<state, next, symbol>>."""
    return F.transform(tokens_, lambda x, i: F.struct(i.alias("state"), (i + 1).alias("next"), x.alias("symbol")))


_LETTER = r"\p{L}\p{N}"
#: Runs of letters and digits of any script, joined by single inner hyphens, underscores and apostrophes; an
#: apostrophe before one of the endings of English contractions joins nothing, if another character follows the ending.
WORD = rf"(?i)([{_LETTER}]+(?:(?:[-_]|'(?!(?:d|ll|m|re|s|ve)[^{_LETTER}_]))[{_LETTER}]+)*)"


def word_set(c: Column) -> Column:
    """Distinct lower-case words of plain text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(1)), F.lower))


def prefixed(c: Column, mark: str) -> Column:
    return F.transform(c, lambda x: F.concat(F.lit(mark), x))


def url_decoded(c: Column) -> Column:
    """Percent-decoded, or as it is where that fails."""
    return F.coalesce(F.try_url_decode(c), c)


#: Fixed value: the page name of a relative link to a saved page.
PAGE_LINK = r"^\..*/([^~]+)\.html$"


def page_of(href: Column, pattern: str = PAGE_LINK) -> Column:
    """The page that a link leads to; null for other links."""
    found = F.regexp_extract(url_decoded(href), pattern, 1)
    return F.when(found != "", found)


class _Links(HTMLParser):
    """href of anchors, inside the container only if one is asked for."""

    def __init__(self, container: tuple[str, str] | None):
        super().__init__(convert_charrefs=True)
        self.container, self.depth, self.found = container, 0, []

    def handle_starttag(self, tag, attrs):
        own = {k.lower(): v or "" for k, v in attrs}
        if self.container:
            if self.depth:
                self.depth += tag == self.container[0]
            elif tag == self.container[0] and own.get("id", "").lower() == self.container[1].lower():
                self.depth = 1
        if tag == "a" and "href" in own and (self.depth or not self.container):
            self.found.append(own["href"])

    def handle_endtag(self, tag):
        if self.depth and tag == self.container[0]:
            self.depth -= 1


def well_formed(page: str) -> bool:
    """Whether an XML parser takes the page to its end; names of HTML's entities are known to it."""
    from xml.parsers import expat

    parser = expat.ParserCreate()
    parser.UseForeignDTD(True)  # entities that aren't declared are skipped
    try:
        parser.Parse(page, True)
    except expat.ExpatError:
        return False
    return True


def links_in(container: tuple[str, str] | None = ("div", "bodyContent"), strict: bool = False):
    """Arrow UDF: hrefs of a page in order; null for null, and for pages that aren't well-formed if strict. State never outlives a page."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def walk(pages: pd.Series) -> pd.Series:
        def one(page):
            if page is None or strict and not well_formed(page):
                return None
            p = _Links(container)
            p.feed(page)
            p.close()
            return p.found

        return pages.map(one)

    return walk


def anchors(page: Column) -> Column:
    """hrefs of all anchors by pattern, inside the JVM: for pages where no container matters."""
    return F.regexp_extract_all(page, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


#: A closing tag is a slash and anything, an opening one a name and perhaps a value after an equals sign.
_TAG = re.compile(r"\[(/[^\]]+|[^\]=/][^\]=]*(?:=[^\]]+)?)\]")
_MENTIONS = ("nation", "region")


def strip_bbcode(raw: str | None) -> str:
    """Text without BBCode tags and opening brackets, entities resolved twice.

    A mention, [nation=x] or [region=x], stands for x unless the next tag closes a mention, which then holds its own text.
    """
    pieces = _TAG.split(html.unescape(html.unescape(raw or "")))
    tags = [tag.lower() for tag in pieces[1::2]]
    shown = [""]  # before each piece of text: the name of a mention that isn't closed by the tag after it
    for i, own in enumerate(pieces[1::2]):
        closed = tags[i + 1 : i + 2] in [[f"/{m}"] for m in _MENTIONS]
        shown.append(own.partition("=")[2] if tags[i].partition("=")[0] in _MENTIONS and not closed else "")
    return "".join(mention + text.replace("[", "") for mention, text in zip(shown, pieces[::2], strict=True))


def bbcode_stripped():
    """Arrow UDF of strip_bbcode."""
    @F.pandas_udf(T.StringType())
    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(strip_bbcode)

    return walk


def http_date(c: Column) -> Column:
    """Date of an HTTP date such as 'Sun, 06 Nov 1994 08:49:37 GMT'."""
    return F.to_date(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, "^[A-Za-z]+, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")))
