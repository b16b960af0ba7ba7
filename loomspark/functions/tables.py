"""Table functions: a line becomes no row, one or several."""

from __future__ import annotations

import re

from pyspark.sql.functions import udtf


@udtf(returnType="name string, html string")
class NamedPages:
    """Pages of lines `name:html`; a line without a colon, or whose name holds a tilde, gives none."""

    def eval(self, line: str):
        name, colon, page = (line or "").partition(":")
        if colon and name and "~" not in name:
            yield name, page


@udtf(returnType="at int, word string")
class Words:
    """Words between white space with their places from 0."""

    def eval(self, text: str):
        yield from enumerate(re.findall(r"\S+", text or ""))


def register(spark) -> None:
    """Make the table functions callable from SQL: `SELECT t.* FROM lines, LATERAL named_pages(value) t`."""
    spark.udtf.register("named_pages", NamedPages)
    spark.udtf.register("words_of", Words)
