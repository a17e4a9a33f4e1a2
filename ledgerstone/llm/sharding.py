"""Op 6 [native]: hierarchical weighted hash tree.

A topology is a list of (region, rack, shard, weight).  A row descends region, rack and shard:
at each level every child draws -ln(u)/weight, u being the first 52 bits of the SHA-256 of
"key|child's name" (a null key is empty), and the smallest draw wins, so a child is chosen in proportion to its weight.  A draw
depends on nothing but the key, the child and its own weight, hence a change of weights moves
rows only from or into the subtrees whose weight changed.

Law `key`: the key and the shard count decide.  `grow` hangs the new shard into a region of its
own, so the draws of all old regions stand and it takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm.common import number_within

Topology = list[tuple[str, str, int, float]]


def topology(shards: int = 16, regions: int = 2, racks: int = 2) -> Topology:
    """Shards dealt evenly over regions and racks, all of weight 1."""
    return [(f"g{s * regions // shards}", f"r{s * regions * racks // shards % racks}", s, 1.0) for s in range(shards)]


def grow(tree: Topology, weight: float = 1.0) -> Topology:
    """One more shard, in a region of its own."""
    new = 1 + max(s for _, _, s, _ in tree)
    return [*tree, (f"g+{new}", "r0", new, weight)]


def _levels(tree: Topology) -> list[dict[str, dict[str, float]]]:
    """For each level: parent -> child -> weight of all leaves below; names are paths."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for region, rack, shard, weight in tree:
        if not weight > 0:
            continue
        path = ["", region, f"{region}/{rack}", f"{region}/{rack}/{shard}"]
        for k in range(3):
            below = levels[k].setdefault(path[k], {})
            below[path[k + 1]] = below.get(path[k + 1], 0.0) + weight
    return levels


def _hashed(*cols: Column) -> Column:
    """The first 52 bits of the SHA-256 of the values, null as empty, with bars between them."""
    name = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.sha2(name, 256), 1, 13), 16, 10).cast("long")


def shard_of(key: Column, tree: Topology) -> Column:
    """The shard that the descent ends in; plain built-in functions only."""
    node: Column = F.lit("")
    for level in _levels(tree):
        children = F.create_map(*[x for parent, below in level.items() for x in (F.lit(parent), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("w")) for c, w in below.items()]))])
        draws = F.transform(
            F.element_at(children, node),
            lambda c: F.struct((-F.log((_hashed(key, c["name"]).cast("double") + 0.5) / float(1 << 52)) / c["w"]).alias("draw"), c["name"].alias("name")),
        )
        node = F.array_min(draws)["name"]
    return F.element_at(F.split(node, "/"), -1).cast("int")


def assign(docs: DataFrame, tree: Topology | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per input row.

    Only doc_id, text length and CRC are shuffled, once, by (shard, sub-bucket).  A null text has
    size 1 and the CRC of no bytes; a null doc_id is one key like any other; repeated rows keep a
    slot each; equal texts may part, since only the key decides.  Other columns are ignored.
    """
    tree = tree or topology()
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.count()
    d = docs.select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    d = d.select("*", F.lit("key").alias("law"), shard_of(F.col("doc_id"), tree).alias("shard"), shard_of(F.col("doc_id"), grow(tree)).alias("grown_shard"))
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    d = number_within(d, ["shard"], _hashed(*order), order, "slot", rows)
    return d.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
