"""Connected components of a link table, by alternating stars on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import cut, discard


class _Forest(dict):
    """Union-find: each node's parent; roots are the smallest nodes."""

    def root(self, x: int) -> int:
        top = x
        while (up := self.setdefault(top, top)) != top:
            top = up
        while self[x] != top:
            self[x], x = top, self[x]
        return top

    def link(self, batch: pd.DataFrame) -> None:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            x, y = self.root(a), self.root(b)
            if x != y:
                self[max(x, y)] = min(x, y)

    def pairs(self) -> pd.DataFrame:
        return pd.DataFrame([(r, x) for x in list(self) if (r := self.root(x)) != x], columns=["a", "b"], dtype="int64")


def _thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of one task, batch by batch: each node with its smallest companion."""
    for batch in batches:
        forest = _Forest()
        forest.link(batch)
        yield forest.pairs()


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest = _Forest()
    for batch in batches:
        forest.link(batch)
    yield forest.pairs()


def components(links: DataFrame, few: int = 200_000) -> DataFrame:
    """``(node, component)`` for each node of ``links(a, b)`` but components' own; component is the smallest node reachable.

    Links of null ends are ignored, repeated links and loops do no harm, and an empty table gives an
    empty one. Union-find inside each task first thins the links to forests. If a count shows
    that no more than ``few`` links are left, one task joins them; else every round
    points each node's larger neighbours at its smallest neighbour (large star) and its smaller
    ones likewise (small star), until nothing changes: about log(longest path) rounds, each one
    aggregation with map-side minima and one join, whose table is written so that no round is repeated.
    """
    links = links.where("a is not null and b is not null and a <> b").selectExpr("cast(least(a, b) as bigint) a", "cast(greatest(a, b) as bigint) b")
    edges = cut(links.mapInPandas(_thin, "a bigint, b bigint").distinct(), "edges")
    if edges.count() <= few:
        whole = cut(edges.coalesce(1).mapInPandas(_whole, "a bigint, b bigint"), "components")
        discard(edges)
        return whole.select(F.col("b").alias("node"), F.col("a").alias("component"))
    before = None
    while True:
        both = edges.selectExpr("a as u", "b as v").union(edges.selectExpr("b as u", "a as v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        new = cut(small.where("a <> b").distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = new
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before = state
