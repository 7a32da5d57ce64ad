"""Graph retrieval by iterated joins: neighbourhoods, paths, ranking, components and communities.

Frontiers, visited sets and ranks stay distributed; a round's result is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schema import FAN_OUT
from graphloom.session import NARROW_ROWS, materialize, small


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to) moves along edges: down, up or both."""
    down = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"))
    up = edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("to"))
    return {"down": down, "up": up, "both": down.union(up)}[direction]


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(id, depth) of nodes within ``depth`` steps of the seeds; unknown seeds are ignored."""
    moves = materialize(steps(edges, direction))  # built once, not once a level
    visited = materialize(nodes.join(seeds.select("id"), "id", "left_semi").select("id", F.lit(0).alias("depth")).distinct())
    frontier = visited
    for level in range(1, depth + 1):
        found = moves.join(frontier.select(F.col("id").alias("at")), "at").select(F.col("to").alias("id")).distinct()
        frontier = materialize(found.join(visited.select("id"), "id", "left_anti").select("id", F.lit(level).alias("depth")))
        if not frontier.limit(1).count():
            break
        visited = visited.union(frontier)
    return visited


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def fan_out_bfs(edges: DataFrame, seeds: DataFrame, depth: int, fan_out: int = FAN_OUT, directed: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges walked from the seeds, at most ``fan_out`` per node and side in adjacency order (seq).

    With ``directed``, a branch keeps the side it was first reached by; a node's first visit wins, upstream after
    downstream. Columns: source_id, target_id, relation_type, level. Seeds that differ in their ``by`` columns are walked
    each on its own, and those columns come first. Edges are read once a level, and only those at the level's nodes are
    ranked, so what is sorted and kept grows with the walk and not with the graph."""
    rows = edges.select("source_id", "target_id", "relation_type", "seq")

    def moves(ids: DataFrame) -> DataFrame:
        """Of the edges at the frontier's nodes, ``fan_out`` a node and side: no other edge is ranked or kept."""
        found = None
        for side, (at, to) in {"down": ("source_id", "target_id"), "up": ("target_id", "source_id")}.items():
            near = rows.join(ids.select(F.col("id").alias(at)), at, "left_semi")
            near = near.withColumn("_n", F.row_number().over(Window.partitionBy(at).orderBy("seq"))).where(F.col("_n") <= fan_out)
            part = near.select(F.col(at).alias("at"), F.col(to).alias("to"), "source_id", "target_id", "relation_type", "seq", F.lit(side).alias("side"))
            found = part if found is None else found.union(part)
        return found

    visited = materialize(seeds.select(*by, "id", F.lit(None).cast("string").alias("via")).distinct())
    frontier, walked = visited, None
    for level in range(1, depth + 1):
        here = moves(small(materialize(frontier.select("id").distinct()), NARROW_ROWS)).join(frontier.select(*by, F.col("id").alias("at"), "via"), "at")
        if directed:
            here = here.where(F.col("via").isNull() | (F.col("via") == F.col("side")))
        taken = materialize(here.select(*by, "source_id", "target_id", "relation_type", "side", "to", "seq", F.lit(level).alias("level")))
        walked = taken if walked is None else walked.union(taken)
        reached = taken.groupBy(*by, F.col("to").alias("id")).agg(F.min("side").alias("via"))
        frontier = materialize(reached.join(visited.select(*by, "id"), [*by, "id"], "left_anti").select(*by, "id", "via"))
        visited = visited.union(frontier)
    return walked.groupBy(*by, "source_id", "target_id", "relation_type").agg(F.min("level").alias("level"))


def simple_paths(edges: DataFrame, source: DataFrame, target: DataFrame, longest: int) -> DataFrame:
    """All directed paths without repeated nodes from the source to the target, as arrays of ids."""
    moves = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("to")).distinct()
    goal = target.select(F.col("id").alias("goal")).distinct()
    paths, done = source.select(F.array("id").alias("path")), None
    for _ in range(longest):
        grown = paths.withColumn("at", F.element_at("path", -1)).join(moves, "at").where(~F.array_contains("path", F.col("to")))
        grown = materialize(grown.select(F.concat("path", F.array("to")).alias("path"), F.col("to").alias("last")))
        ended = grown.join(goal, grown["last"] == goal["goal"], "left_semi").select("path")
        done = ended if done is None else done.union(ended)
        paths = grown.join(goal, grown["last"] == goal["goal"], "left_anti").select("path")
    return done


def personalised_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, iterations: int = 100, alpha: float = 0.85, undirected: bool = False, tolerance: float = 1e-6, every: int = 5) -> DataFrame:
    """(id, rank); mass of nodes without out-edges returns to the seeds.

    Rounds end when ranks change by less than ``tolerance`` a node in all, or after ``iterations``; tolerance 0 runs them
    all. Lost mass is summed inside the round's own job; whether ranks have settled is asked every few rounds. Only nodes
    that have rank to give away meet their moves: while these are few, a round reads the moves and does not shuffle them."""
    moves = steps(edges, "both" if undirected else "down").repartition("at").distinct()
    moves = materialize(moves.join(moves.groupBy("at").agg(F.count("*").alias("n")), "at"))
    out = moves.select("at").distinct()
    start = seeds.select("id").distinct().join(nodes.select("id"), "id", "left_semi")
    total = start.count()
    leaves = nodes.select("id").distinct().join(out.select(F.col("at").alias("id"), F.lit(False).alias("_leaf")), "id", "left")
    base = materialize(leaves.join(start.withColumn("_s", F.lit(1.0 / max(1, total))), "id", "left").select("id", F.coalesce("_s", F.lit(0.0)).alias("start"), F.coalesce("_leaf", F.lit(True)).alias("leaf")))
    n = base.count()
    few = F.broadcast if n <= NARROW_ROWS else lambda df: df  # flow and ranks have n rows of two numbers at most
    rank = base.select("id", F.col("start").alias("rank"), "leaf")
    for i in range(iterations):
        giving = rank.where("rank > 0 AND NOT leaf")
        giving = few(giving) if n <= NARROW_ROWS else small(giving, NARROW_ROWS)
        flow = moves.join(giving, moves["at"] == giving["id"]).groupBy("to").agg(F.sum(F.col("rank") / F.col("n")).alias("flow"))
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("leaf"), F.col("rank"))), F.lit(0.0)).alias("loose"))
        joined = base.join(few(flow.withColumnRenamed("to", "id")), "id", "left").join(F.broadcast(loose))  # one row
        new = materialize(joined.select("id", (alpha * (F.coalesce("flow", F.lit(0.0)) + F.col("loose") * F.col("start")) + (1 - alpha) * F.col("start")).alias("rank"), "leaf"))
        if tolerance and (i + 1) % every == 0:
            change = new.join(few(rank.select("id", F.col("rank").alias("old"))), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
            if change < n * tolerance:
                return new.select("id", "rank")
        rank = new
    return rank.select("id", "rank")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable. Neighbours' minima and pointer jumps, until nothing moves."""
    moves = materialize(steps(edges, "both").distinct())
    labels = materialize(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = moves.join(labels.select(F.col("id").alias("to"), "component"), "to").groupBy(F.col("at").alias("id")).agg(F.min("component").alias("_near"))
        lower = labels.join(near, "id", "left").select("id", F.col("component").alias("_old"), F.least("component", F.coalesce("_near", "component")).alias("component"))
        jump = lower.select(F.col("id").alias("_at"), F.col("component").alias("_jump"))
        moved = materialize(lower.join(jump, lower["component"] == jump["_at"], "left").select("id", "_old", F.least("component", F.coalesce("_jump", "component")).alias("component")))
        if not moved.where("_old <> component").limit(1).count():
            return moved.select("id", "component")
        labels = moved.select("id", "component")


def communities(nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """(id, community, size, community_id) by modularity, over edge tables at every size; community_id ranks by size.

    Every node starts alone. In a round each community chooses the neighbour whose union gains most modularity. Two that
    choose each other become one, named by the lesser, and take in those that chose either of them; if that lowers the
    modularity of the whole, only the pairs are joined, which never does. Rounds end when no union gains, however many that
    takes: each joins two communities at least. Nodes without
    edges are alone. All tables are joined and grouped, so a giant component is no one task."""
    moves = edges.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    links = materialize(moves.select("a", "b", F.lit(1).cast("bigint").alias("w")))
    total = 2.0 * links.count()
    of = materialize(nodes.select("id", F.col("id").alias("community")).distinct())
    degree = materialize(links.select(F.explode(F.array("a", "b")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("d")))
    few = F.broadcast if of.count() <= NARROW_ROWS else lambda df: df  # a row a node at most: degrees, choices and unions

    def renamed(df: DataFrame, into: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.join(few(into.select(F.col("c").alias(c), "into")), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")
        return df

    def united(into: DataFrame) -> tuple[DataFrame, DataFrame, float]:
        """Links and degrees after a union, and what is left of modularity: 1 - links between - expected links inside."""
        new_links = renamed(links, into, "a", "b").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))
        new_degree = materialize(renamed(degree, into, "c").groupBy("c").agg(F.sum("d").alias("d")))
        new_links = materialize(new_links)
        between = new_links.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        inside = new_degree.agg(F.coalesce(F.sum(F.col("d").cast("double") * F.col("d")), F.lit(0.0))).first()[0]
        return new_links, new_degree, 1 - 2 * between / total - inside / total**2

    value = -float("inf")
    while total:
        both = links.select("a", "b", "w").union(links.select("b", "a", "w"))
        near = both.join(few(degree.select(F.col("c").alias("a"), F.col("d").alias("da"))), "a").join(few(degree.select(F.col("c").alias("b"), F.col("d").alias("db"))), "b")
        gaining = near.select("a", "b", (F.col("w") / total - F.col("da") * F.col("db") / (total * total)).alias("g")).where("g > 1e-12")
        best = materialize(gaining.groupBy("a").agg(F.min_by("b", F.struct(-F.col("g"), F.least("a", "b"), F.greatest("a", "b"))).alias("b")))
        back = best.select(F.col("a").alias("b"), F.col("b").alias("back"))
        pairs = materialize(best.join(few(back), "b").where("a = back AND a < b").select("a", "b"))
        if not pairs.limit(1).count():
            break
        root = pairs.select(F.col("a").alias("c"), F.col("a").alias("into")).union(pairs.select("b", "a"))
        led = best.join(few(root.select(F.col("c").alias("b"), "into")), "b").join(few(root.select(F.col("c").alias("a"))), "a", "left_anti").select(F.col("a").alias("c"), "into")
        into = materialize(root.where("c <> into").union(led))
        after = united(into)
        if after[2] <= value:
            into = root.where("c <> into")
            after = united(into)
        links, degree, value = after
        of = materialize(renamed(of, into, "community").select("id", "community"))
    counted = of.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    ranked = counted.withColumn("community_id", F.row_number().over(Window.orderBy(F.desc("size"), "community")))  # one row a community
    return of.join(ranked, "community")


def community_summary(members: DataFrame, nodes: DataFrame, most: int = 30) -> DataFrame:
    """Fallback title and summary of each community: its first three and fifteen names."""
    named = members.join(nodes.select("id", "name"), "id")
    top = named.withColumn("_n", F.row_number().over(Window.partitionBy("community_id").orderBy("name", "id"))).where(F.col("_n") <= most)
    names = F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"])
    return top.groupBy("community_id", "size").agg(names.alias("names")).select("community_id", "size", F.array_join(F.slice("names", 1, 3), ", ").alias("title"), F.array_join(F.slice("names", 1, 15), ", ").alias("summary"))


def community_relations(members: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 40) -> DataFrame:
    """(community_id, number, line) of at most ``most`` edges inside each community, for its summary; edges: seq."""
    name = members.select("community_id", "id").join(nodes.select("id", "name"), "id")
    s = name.select(F.col("id").alias("source_id"), "community_id", F.col("name").alias("s"))
    t = name.select(F.col("id").alias("target_id"), F.col("community_id").alias("_c"), F.col("name").alias("t"))
    inside = edges.join(s, "source_id").join(t, "target_id").where("community_id = _c")
    place = F.row_number().over(Window.partitionBy("community_id").orderBy("seq"))
    line = F.concat("s", F.lit(" --("), "relation_type", F.lit(")--> "), "t")
    return inside.select("community_id", place.alias("number"), line.alias("line")).where(F.col("number") <= most)


def walked_chunks(walked: DataFrame, nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct chunk ids of the nodes and edges that a walk has met, the seeds among them."""
    met = walked.select(F.col("source_id").alias("id")).union(walked.select("target_id")).union(seeds.select("id")).distinct()
    of = nodes.join(met, "id", "left_semi").select(F.explode("source_chunk_ids").alias("chunk_id"))
    same = ["source_id", "target_id", "relation_type"]
    return of.union(edges.join(walked.select(*same).distinct(), same, "left_semi").select(F.explode("source_chunk_ids"))).distinct()
