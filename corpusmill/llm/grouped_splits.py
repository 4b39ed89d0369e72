"""Problem 5: splits that keep related records together.

Records are linked by what they share; linked records are one component. Components are found by breadth-first search
from many seeds at once: nodes become seeds in waves of growing rate, labels spread along hash-partitioned adjacency
lists, and where two labels meet an edge of a smaller graph of labels is left. That graph is solved in the same way,
until one is left that one task can hold, which joins its edges one after another.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut

#: Share of the nodes not yet reached that become seeds in each wave; in a last wave all that are left are labelled.
WAVES = (1 / 16, 1 / 4)
#: Edges, and characters of their ends, up to which a graph is solved by one task.
EDGES_OF_A_TASK, CHARACTERS_OF_A_TASK = 2_000_000, 128_000_000
#: Ranges of hash order whose sizes are summed up first.
RANGES = 1024
#: A component of at least this share of all records is placed by itself; there are at most ``1 / LARGE`` of them.
LARGE = 1 / 200


def _searched(adjacent: DataFrame, salt: int) -> DataFrame:
    """(node, label) of every node of the symmetric edges ``adjacent`` (src, dst).

    Only the frontier meets the adjacency lists: the nodes that the wave before has reached, and the new seeds. What was
    reached earlier has no unlabelled neighbour left.
    """
    nodes = adjacent.select(F.col("src").alias("node")).distinct()
    labels = None
    for wave, rate in enumerate(WAVES):
        chance = F.pmod(F.xxhash64("node", F.lit(f"{salt}/{wave}")), F.lit(1 << 20)) < int(rate * (1 << 20))
        fresh = nodes if labels is None else nodes.join(labels, "node", "left_anti")
        seeds = fresh.where(chance).select("node", F.col("node").alias("label"), F.lit(-1).alias("wave"))
        frontier = seeds if labels is None else labels.where(F.col("wave") == wave - 1).unionByName(seeds)
        labels = seeds if labels is None else labels.unionByName(seeds)
        met = _met(adjacent, frontier)
        labels = cut(labels.unionByName(met.select(F.col("src").alias("node"), F.col("near").alias("label"), F.lit(wave).alias("wave")).join(labels, "node", "left_anti")))
    # What no seed has reached takes the least of itself and its neighbours, so that every edge brings its ends nearer.
    left = nodes.join(labels, "node", "left_anti")
    near = _met(adjacent, labels.where(F.col("wave") == len(WAVES) - 1))
    least = adjacent.join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").groupBy("src").agg(F.min("dst").alias("least"))
    rest = left.withColumnRenamed("node", "src").join(near, "src", "left").join(least, "src", "left").select(F.col("src").alias("node"), F.coalesce("near", F.least("src", "least")).alias("label"))
    return cut(labels.select("node", "label").unionByName(rest))


def _met(adjacent: DataFrame, frontier: DataFrame) -> DataFrame:
    """(src, near): neighbours of the frontier's nodes (node, label), with the least label that reaches each."""
    labels = frontier.select(F.col("node").alias("dst"), "label")
    return adjacent.join(labels, "dst").groupBy("src").agg(F.min("label").alias("near"))


def _joined(batches):
    """(node, label) of every node of all edges (src, dst) of a task: the least node, by code points, that is linked to it."""
    ends = [c.cast(pa.large_string()) for batch in batches for c in batch.columns]
    if not ends:
        return
    coded = pa.concat_arrays(ends).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    names = coded.dictionary.take(order)
    # The place of each end in the order of names.
    places = pc.sort_indices(order).take(coded.indices).to_numpy()
    parent, at = list(range(len(names))), 0
    for src, dst in zip(ends[::2], ends[1::2], strict=True):
        middle, upto = at + len(src), at + len(src) + len(dst)
        for one, two in zip(places[at:middle].tolist(), places[middle:upto].tolist(), strict=True):
            while parent[one] != one:
                parent[one] = one = parent[parent[one]]
            while parent[two] != two:
                parent[two] = two = parent[parent[two]]
            parent[max(one, two)] = min(one, two)
        at = upto
    # A parent comes before its children, so one pass in order finds every root.
    for k, above in enumerate(parent):
        parent[k] = parent[above]
    labels = names.take(pa.array(parent, pa.int64()))
    for at in range(0, len(names), 10_000):
        yield pa.RecordBatch.from_arrays([x.slice(at, 10_000).cast(pa.string()) for x in (names, labels)], names=["node", "label"])


def components(edges: DataFrame, most_edges: int = EDGES_OF_A_TASK) -> DataFrame:
    """(node, component) of every node in ``edges`` (src, dst: strings); a component is named by one of its nodes.

    A graph of more than ``most_edges`` is searched over all tasks until what is left of it has no more. Loops and repeated
    edges change nothing; edges with a null end are left out; no edges give no rows.
    """
    left = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    found, salt = None, 0
    while True:
        n, characters = left.agg(F.count("*"), F.coalesce(F.sum(F.length("src") + F.length("dst")), F.lit(0))).first()
        searched = n > most_edges or characters > CHARACTERS_OF_A_TASK
        if searched:
            adjacent = cut(left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
            labels = _searched(adjacent, salt)
        else:
            labels = left.coalesce(1).mapInArrow(_joined, "node string, label string")
        if found is None:
            found = labels.select("node", F.col("label").alias("component"))
        elif n:
            up = labels.select(F.col("node").alias("component"), "label")
            found = cut(found.join(up, "component", "left").select("node", F.coalesce("label", "component").alias("component")))
        if not searched:
            return found
        one, two = (labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")) for end in ("src", "dst"))
        collided = adjacent.join(one, "src").join(two, "dst").where("src_label < dst_label")
        left = cut(collided.select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst")).distinct())
        salt += 1


def nodes_of(df: DataFrame, links: dict[str, Column], key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_node``, edges): each record's first non-null link is its node, and its further ones are edges of it.

    ``links`` are string columns by name; null links nothing. A record without any link is a node of its own by ``key``,
    and one without a key too shares a node with its like.
    """
    named = [F.concat(F.lit(f"{name}|"), value) for name, value in links.items()]
    present = F.filter(F.array(*named), lambda x: x.isNotNull())
    rows = df.withColumn("_links", present).withColumn("_node", F.coalesce(F.try_element_at("_links", F.lit(1)), F.concat(F.lit("|"), F.col(f"`{key}`").cast("string")), F.lit("|")))
    pairs = rows.where(F.size("_links") > 1).select("_node", "_links").distinct()
    edges = pairs.select(F.col("_node").alias("src"), F.explode(F.slice("_links", 2, len(named))).alias("dst")).distinct()
    return rows.drop("_links"), edges


def grouped(df: DataFrame, links: dict[str, Column], key: str) -> DataFrame:
    """``df`` with ``_group``, the component of each record. Empty tables give no rows."""
    rows, edges = nodes_of(df, links, key)
    found = components(edges).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return rows.join(found, "_node", "left").withColumn("_group", F.coalesce("_component", "_node")).drop("_component", "_node")


def torn(df: DataFrame, links: dict[str, Column], key: str, split: str, by: list[str]) -> DataFrame:
    """Distinct non-null ``by`` of the groups whose records have more than one ``split``; a null split counts as none."""
    rows, edges = nodes_of(df.select(*by, key, split, *(v.alias(f"_link_{k}") for k, v in links.items())), {k: F.col(f"_link_{k}") for k in links}, key)
    least = rows.groupBy("_node", *by).agg(F.min(split).alias("_low"), F.max(split).alias("_high"))
    found = components(edges).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    least = least.join(found, "_node", "left").withColumn("_group", F.coalesce("_component", "_node"))
    bad = least.groupBy("_group").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high")).where("_low <> _high").select("_group")
    out = least.join(bad, "_group", "left_semi").select(*by)
    return out.dropna().distinct()


def assigned(df: DataFrame, links: dict[str, Column], key: str, quota: dict[str, float]) -> DataFrame:
    """(``key``, ``split``) of each distinct key: groups whole, shares near ``quota``.

    Groups of at least ``LARGE`` of all records go, largest first, to the split that lacks most; the others follow in
    the order of their hashes, each to the split in whose remaining stretch its middle falls. Shares are scaled to sum 1;
    an empty table gives no rows.
    """
    total_share = sum(quota.values())
    rows = cut(grouped(df.select(key, *(v.alias(f"_link_{k}") for k, v in links.items())), {k: F.col(f"_link_{k}") for k in links}, key).select(key, "_group").distinct())
    sizes = cut(rows.groupBy("_group").agg(F.count("*").alias("_n")))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    lacks = {name: share / total_share * total for name, share in quota.items()}
    # At most 1 / LARGE rows.
    large = sizes.where(F.col("_n") >= max(1, total * LARGE)).orderBy(F.desc("_n"), "_group").collect() if total else []
    placed = {}
    for group in large:
        placed[group["_group"]] = name = max(lacks, key=lambda k: (lacks[k], k))
        lacks[name] -= group["_n"]
    spark = df.sparkSession
    fixed = spark.createDataFrame(list(placed.items()), "_group string, split string")
    rest = sizes.join(F.broadcast(fixed), "_group", "left_anti").withColumn("_hash", F.xxhash64("_group")).withColumn("_range", F.pmod(F.shiftright("_hash", 20), F.lit(RANGES)))
    before = rest.groupBy("_range").agg(F.sum("_n").alias("_sum")).withColumn("_begin", F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum"))
    inside = Window.partitionBy("_range").orderBy("_hash", "_group")
    middle = rest.join(F.broadcast(before.select("_range", "_begin")), "_range").withColumn("_middle", F.col("_begin") + F.sum("_n").over(inside) - F.col("_n") / 2)
    open_ = {k: max(0.0, v) for k, v in lacks.items()}
    scale = (total - sum(g["_n"] for g in large)) / (sum(open_.values()) or 1)
    choice, upto = F.lit(max(quota, key=lambda k: quota[k])), sum(open_.values()) * scale
    for name, share in reversed(open_.items()):
        choice = F.when(F.col("_middle") <= upto, F.lit(name)).otherwise(choice) if share else choice
        upto -= share * scale
    groups = middle.select("_group", choice.alias("split")).unionByName(fixed)
    return rows.join(groups, "_group").select(key, "split")
