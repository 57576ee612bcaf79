"""Table functions for SQL: SELECT ... FROM pages, LATERAL parse_dom(html, 'body')."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessella.functions.htmltree import Tree

NODES = "node_id int, parent_id int, subtree_end int, depth int, sibling_idx int, elem_idx int, node_type int, tag string, attrs map<string,string>, text string, in_template boolean, quirks boolean"


class ParseDom:
    """The nodes of one page, or with a context those of a fragment that is read inside an element of that tag."""

    def eval(self, html: str, context: str) -> Iterator[tuple]:
        for row in (Tree(html) if context is None else Tree.fragment(html, context)).rows():
            yield (*row[:8], dict(row[8] or ()) if row[8] is not None else None, *row[9:])


def register(spark: SparkSession) -> None:
    """Makes parse_dom(html, context) known to a session's SQL; a null context reads whole pages. Rows travel by Arrow."""
    spark.udtf.register("parse_dom", udtf(ParseDom, returnType=NODES, useArrow=True))
