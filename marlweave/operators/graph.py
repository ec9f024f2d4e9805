"""Graph operators over node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, ISA, Config
from ..sources.scratch import kept
from . import lexical
from .containment import only


def is_a(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("p").isin(*ISA))


def derive_nodes(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Nodes of all subjects and objects in order of first sight; objects of is-a edges are classes."""
    ends = edges.select(F.explode(F.array(F.struct((2 * F.col("pos")).alias("pos"), F.col("s").alias("id"), F.lit(False).alias("c")), F.struct((2 * F.col("pos") + 1).alias("pos"), F.col("o").alias("id"), F.col("p").isin(*ISA).alias("c")))).alias("x")).select("x.*")
    nodes = ends.groupBy(F.col("id").alias("node_id")).agg(F.min("pos").alias("pos"), F.max("c").alias("c"))
    if labels is not None:
        nodes = nodes.join(labels.select("node_id", "label"), "node_id", "left")
    else:
        nodes = nodes.withColumn("label", F.lit(None).cast("string"))
    return nodes.select("node_id", F.coalesce("label", "node_id").alias("label"), F.when(F.col("c"), "class").otherwise("instance").alias("kind"), "pos")


def get_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(node_id, label, kind) of the ids asked for (node_id); label and kind are null for what is no node."""
    return ids.select("node_id").distinct().join(nodes.select("node_id", "label", "kind"), "node_id", "left")


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pos, s, p, o, s_label, o_label); what is no node stands for itself."""
    name = lambda end: nodes.select(F.col("node_id").alias(end), F.col("label").alias(f"{end}_label"))
    out = edges.join(name("s"), "s", "left").join(name("o"), "o", "left")
    return out.select("pos", "s", "p", "o", F.coalesce("s_label", "s").alias("s_label"), F.coalesce("o_label", "o").alias("o_label"))


def sides(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(node, other, pos) of all ways to go from a node; loops lead nowhere."""
    if direction not in ("out", "in", "both"):
        raise ValueError("direction must be out, in or both")
    out = edges.select(F.col("s").alias("node"), F.col("o").alias("other"), "pos")
    into = edges.select(F.col("o").alias("node"), F.col("s").alias("other"), "pos")
    ways = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    return ways.where("node <> other")


def neighbor_ids(edges: DataFrame, seeds: DataFrame, limit: int = DEFAULT.neighbor_limit, direction: str = "both") -> DataFrame:
    """(node, other, pos): at most ``limit`` distinct neighbours of each seed, in order of edges. seeds: node."""
    found = seeds.select("node").distinct().join(sides(edges, direction), "node").groupBy("node", "other").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("node").orderBy("pos", "other")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")


def neighbors(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, hops: int = 1, limit: int = DEFAULT.neighbor_limit) -> DataFrame:
    """(seed, pos, s_label, p, o_label, hop): edges met in breadth-first order, each once, at most ``limit`` a seed."""
    frontier = seeds.select(F.col("node").alias("seed"), F.col("node")).distinct()
    seen = frontier
    met = None
    for hop in range(1, hops + 1):
        touch = edges.select("pos", "s", "p", "o", F.explode(F.array_distinct(F.array("s", "o"))).alias("node")).join(frontier, "node")
        step = touch.select("seed", "pos", "s", "p", "o").distinct().withColumn("hop", F.lit(hop))
        met = step if met is None else met.unionByName(step)
        if hop < hops:
            frontier = step.select("seed", F.explode(F.array("s", "o")).alias("node")).distinct().join(seen, ["seed", "node"], "left_anti")
            seen = seen.unionByName(frontier)
    first = met.groupBy("seed", "pos", "s", "p", "o").agg(F.min("hop").alias("hop"))
    w = Window.partitionBy("seed").orderBy("hop", "pos")
    first = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
    named = labelled(first.select("pos", "s", "p", "o").distinct(), nodes).select("pos", "s", "p", "o", "s_label", "o_label")
    return first.join(named, ["pos", "s", "p", "o"]).select("seed", "pos", "s_label", "p", "o_label", "hop")


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hop) of all nodes within ``hops`` steps either way."""
    both = sides(edges).select("node", "other").distinct()
    found = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop")).distinct()
    front = found
    for hop in range(1, hops + 1):
        front = front.join(both, "node").select("seed", F.col("other").alias("node")).distinct().join(found, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        found = found.unionByName(front)
    return found


def class_instances(edges: DataFrame, nodes: DataFrame, limit: int = DEFAULT.instance_limit) -> DataFrame:
    """(class_id, instance_id, label, r): the first members of each class in order of edges, then those that are nodes."""
    w = Window.partitionBy("o").orderBy("pos")
    first = is_a(edges).withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
    return first.join(nodes.select(F.col("node_id").alias("s"), "label"), "s").select(F.col("o").alias("class_id"), F.col("s").alias("instance_id"), "label", "r")


def class_counts(edges: DataFrame) -> DataFrame:
    return is_a(edges).groupBy(F.col("o").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))


def label_texts(nodes: DataFrame) -> DataFrame:
    """The labels of nodes as texts of chunks; their places are the slots."""
    return lexical.texts(nodes.select(F.col("pos").alias("slot"), F.lit("").alias("title"), F.col("label").alias("text")))


def search_labels(nodes: DataFrame, queries: DataFrame, limit: int = DEFAULT.seed_label_limit, config: Config = DEFAULT, index: lexical.Index | DataFrame | None = None) -> DataFrame:
    """(query_id, node_id, label, kind, score, rank): BM25 over node labels."""
    hits = kept(lexical.best(label_texts(nodes) if index is None else index, queries, limit, config, fielded=False, coordinated=True, recover=False), "label-hits")
    return hits.join(only(nodes.select(F.col("pos").alias("slot"), "node_id", "label", "kind"), hits, "slot"), "slot").select("query_id", "node_id", "label", "kind", "score", "rank")


def class_seed(edges: DataFrame, nodes: DataFrame, label_hits: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(query_id, class_seed): the first class among the label hits, if it has two members or more, with its members' names."""
    w = Window.partitionBy("query_id").orderBy("rank")
    first = label_hits.where("kind = 'class'").withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", F.col("node_id").alias("class_id"), F.col("label").alias("class_label"))
    members = class_instances(edges, nodes, config.instance_limit).join(first.select("class_id").distinct(), "class_id")
    lists = members.groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("names")).where(F.size("names") >= 2)
    n, cap = F.size("names"), config.class_list_cap
    more = F.when(n > cap, F.concat(F.lit(" (+"), (n - cap).cast("string"), F.lit(" more)"))).otherwise("")
    text = F.concat(F.lit("[CLASS '"), "class_label", F.lit("' has "), n.cast("string"), F.lit(" instances: "), F.array_join(F.slice("names", 1, cap), " | "), more, F.lit(". List all only" + " if asked to enumerate/count; " + "otherwise pick" + " the relevant ones.]"))
    return first.join(lists, "class_id").select("query_id", text.alias("class_seed"))
