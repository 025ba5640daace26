"""Connected components of a table of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.groups import groups


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another; the component is its smallest node."""
    return groups(links, a, b, group="component")
