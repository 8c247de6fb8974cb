"""Property graphs as vertex and edge tables, and bounded walks over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demesne.runtime import cut

MAX_STEPS = 100


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component): least vertex reachable, by min-label spreading with pointer jumping.

    Raises an error rather than returning unfinished labels.
    """
    e = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")))
    for _ in range(MAX_STEPS):
        seen = e.join(labels.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        new = labels.join(seen, "u").select("u", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        jump = new.select(F.col("u").alias("l"), F.col("l").alias("j"))
        new = cut(new.join(jump, "l", "left").select("u", F.coalesce("j", "l").alias("l"), "was"))
        changed = new.where("l <> was").limit(1).count()
        labels = new.select("u", "l")
        if not changed:
            break
    else:
        raise RuntimeError(f"no end after {MAX_STEPS} steps")
    return labels.select(F.col("u").alias("vertex"), F.col("l").alias("component"))


def k_hops(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(node, hop): nodes within ``k`` undirected steps of the seeds, with the least number of steps.

    ``edges``: src, dst; ``seeds``: node.
    """
    edges = cut(edges.select("src", "dst").distinct())
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    reached = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    front = reached
    for h in range(1, k + 1):
        step = front.select(F.col("node").alias("src")).join(both, "src").select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(reached, "node", "left_anti").withColumn("hop", F.lit(h)))
        reached = reached.unionByName(front)
    return reached


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def prune(edges: DataFrame, priority: F.Column, most: int) -> DataFrame:
    """The ``most`` best edges by priority, then by their names."""
    return edges.withColumn("priority", priority).orderBy(F.desc("priority"), "src", "rel", "dst").limit(most)


def prune_nodes(nodes: DataFrame, edges: DataFrame, priority: F.Column, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` best nodes by priority, then by name, and the edges between them."""
    kept = nodes.withColumn("priority", priority).orderBy(F.desc("priority"), "node").limit(most)
    return kept, induced(edges, kept)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(ends, "node", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node, each once."""
    n = nodes.select("node").distinct()
    a = edges.join(n.withColumnRenamed("node", "src"), "src", "left_anti")
    b = edges.join(n.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return a.select("src", "dst", "rel").unionByName(b.select("src", "dst", "rel")).distinct()


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): each round a node takes the commonest label around it (ties: the least)."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("k"), "community")).alias("m"))
        labels = cut(best.select(F.col("src").alias("node"), F.col("m.community").alias("community")))
    return labels


def louvain(edges: DataFrame, levels: int = 3, rounds: int = 8, seed: int = 42) -> DataFrame:
    """(node, community): communities by modularity, in the manner of Louvain.

    Each round half of the nodes (by a seeded hash) may move to the neighbouring
    community that gains most modularity (ties: the least name); a level ends
    when none moves or after ``rounds``, its communities become the nodes of the
    next, with summed weights, and the levels end when nothing merges.  Loops
    and directions of ``edges`` (src, dst) are ignored, repeated edges weigh more.
    """
    e = edges.where("src is not null and dst is not null and src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    # both directions; a community's inner weight is a loop of the next level, which counts in degrees only
    both = cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    two_m = both.agg(F.sum("w")).first()[0] or 0.0
    mapping = cut(both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    if not two_m:
        return mapping
    for level in range(levels):
        degree = cut(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
        links = both.where("src <> dst")
        state = cut(degree.withColumn("community", F.col("node")))
        not_moved = False
        for rnd in range(rounds):
            total = state.groupBy("community").agg(F.sum("k").alias("tot"))
            near = links.join(state.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("inside"))
            # a node's own community always stands for choice
            own = state.select("node", "community", F.lit(0.0).alias("inside"))
            choice = near.unionByName(own).groupBy("node", "community").agg(F.sum("inside").alias("inside")).join(total, "community").join(state.select("node", "k", F.col("community").alias("was")), "node")
            rest = F.col("tot") - F.when(F.col("community") == F.col("was"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("inside") - F.col("k") * rest / two_m, 9)
            best = choice.groupBy("node").agg(F.min(F.struct((-gain).alias("g"), "community")).alias("m"), F.max(F.when(F.col("community") == F.col("was"), gain)).alias("stay"), F.first("was").alias("was"), F.first("k").alias("k"))
            may = F.pmod(F.xxhash64(F.lit(seed + 101 * level + rnd), F.col("node")), F.lit(2)) == 0
            moves = may & (-F.col("m.g") > F.col("stay"))
            new = cut(best.select("node", "k", F.when(moves, F.col("m.community")).otherwise(F.col("was")).alias("community"), moves.alias("moved")))
            state = new.select("node", "k", "community")
            # one round moves half of the nodes: only two quiet ones end the level
            quiet = new.where("moved").isEmpty()
            if quiet and not_moved:
                break
            not_moved = quiet
        mapping = cut(mapping.join(state.select(F.col("node").alias("community"), F.col("community").alias("up")), "community").select("node", F.col("up").alias("community")))
        if state.where("node <> community").isEmpty():
            break
        to = state.select("node", "community")
        merged = both.join(to.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(to.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
        both = cut(merged.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    least = mapping.groupBy("community").agg(F.min("node").alias("least"))
    return mapping.join(least, "community").select("node", F.col("least").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Share of the edges inside communities, less what chance would put there."""
    e = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    c = communities.select("node", "community")
    met = both.join(c.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    per = met.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("inside"))
    r = per.agg(F.sum("k").alias("m2"), F.sum("inside").alias("i"), F.sum(F.col("k").cast("double") * F.col("k")).alias("sq")).first()
    return r["i"] / r["m2"] - r["sq"] / r["m2"] ** 2 if r["m2"] else 0.0


def match_pattern(triples: DataFrame, *patterns: tuple[str, str, str], optional: tuple[tuple[str, str, str], ...] = (), where: F.Column | None = None) -> DataFrame:
    """Graph pattern over (s, p, o): terms starting with ``?`` are variables, shared ones join.

    ``optional`` patterns keep the matches they add nothing to (variables null);
    ``where`` filters the matches at the end.
    """
    out = None
    for s, p, o in (*patterns, *optional):
        part, names = triples, {}
        for column, term in (("s", s), ("p", p), ("o", o)):
            if term.startswith("?"):
                if term[1:] in names:
                    part = part.where(F.col(names[term[1:]]) == F.col(column))
                else:
                    names[term[1:]] = column
            else:
                part = part.where(F.col(column) == term)
        part = part.select(*[F.col(c).alias(v) for v, c in names.items()])
        if out is None:
            out = part
            continue
        shared = [v for v in names if v in out.columns]
        if not shared:
            raise ValueError("a pattern must share a variable with those before it")
        out = out.join(part, shared, "left" if (s, p, o) in optional else "inner")
    return out if where is None else out.where(where)


def triples_of(df: DataFrame, subject: F.Column, predicates: dict[str, F.Column]) -> DataFrame:
    """(s, p, o) of every filled property."""
    props = F.array(*[F.struct(F.lit(p).alias("p"), c.cast("string").alias("o")) for p, c in predicates.items()])
    return df.select(subject.alias("s"), F.explode(props).alias("x")).select("s", "x.p", "x.o").where("s is not null and o is not null")


def ranked_siblings(df: DataFrame, group: str, item: str, most: int) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(group).orderBy(item))).where(F.col("__rn") <= most).drop("__rn")
