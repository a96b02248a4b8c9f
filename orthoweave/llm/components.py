"""Connected components of a link table, as DataFrame rounds of min-label contraction.

Defined results: links with a null end and links of a node to itself are left out; repeated and reversed links count once; an
empty table gives an empty result. The links of a hub lie in one partition of the joins that relabel them, which adaptive execution
splits (a skewed inner join); their least label is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (a, b long); root is the smallest node of its component.

    A round labels each node with the least of itself and its neighbours (a map-side combined min) and contracts the links
    to labels; labels of labels compose. Rounds end when no link joins two labels.
    """
    links = stash(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mapping = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        label = stash(label, "labels")
        if mapping is None:
            mapping = label
        else:
            up = label.select(F.col("node").alias("root"), F.col("root").alias("next"))
            new = stash(mapping.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "mapping")
            discard(mapping)
            mapping = new
        la = label.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        lb = label.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = stash(links.join(la, "a").join(lb, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        discard(links)
        if mapping is not label:
            discard(label)
        links = rest
        if not links.take(1):
            discard(links)
            return mapping
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
