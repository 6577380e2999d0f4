"""Knowledge graph from entity mentions: edges, hops, centrality, communities.

The graph is kept in two forms. *Incidence* rows ``(chunk, node)`` say which
entity a chunk mentions; neighbours and hops walk over them in linear work. *Edges*
``(u, v)`` with u < v are built only where an operator needs the pairs themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.session import durable

CO_OCCURS = "co_occurs_with"
HOT_CHUNK = 256


def incidence(mentions: DataFrame, chunk: str, node: str) -> DataFrame:
    """Distinct (chunk, node) rows."""
    return mentions.select(F.col(chunk).alias("chunk"), F.col(node).alias("node")).distinct()


def upsert_nodes(mentions: DataFrame, node: str, order: Column, props: list[str]) -> DataFrame:
    """One row per node with the properties of its latest mention."""
    row = F.max_by(F.struct(*props), order).alias("_p")
    return mentions.groupBy(node).agg(row).select(node, *[F.col(f"_p.{p}").alias(p) for p in props])


def _hot_chunks(inc: DataFrame) -> DataFrame:
    return inc.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_CHUNK)


def pairs(inc: DataFrame) -> DataFrame:
    """Node pairs of each chunk: ``(chunk, u, v)`` with u < v.

    A chunk with many entities is cut into blocks of about ``HOT_CHUNK`` nodes and
    joined block against block, so its pairs are made by many tasks.
    """
    hot = _hot_chunks(inc)
    if hot.isEmpty():
        a = inc.select("chunk", F.col("node").alias("u"))
        b = inc.select("chunk", F.col("node").alias("v"))
        return a.join(b, "chunk").filter(F.col("u") < F.col("v"))
    cut = hot.select("chunk", F.ceil(F.col("n") / HOT_CHUNK).alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    tagged = inc.join(cut, "chunk", "left").select(
        "chunk", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("b"))
    cells = tagged.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "chunk", "node", "b", F.least("b", "x").alias("ci"), F.greatest("b", "x").alias("cj"))
    a = cells.select("chunk", "ci", "cj", F.col("node").alias("u"), F.col("b").alias("bu"))
    b = cells.select("chunk", "ci", "cj", F.col("node").alias("v"), F.col("b").alias("bv"))
    same_cell = (F.col("ci") == F.col("cj")) | (F.col("bu") != F.col("bv"))
    return (
        a.join(b, ["chunk", "ci", "cj"]).filter((F.col("u") < F.col("v")) & same_cell)
        .select("chunk", "u", "v")
    )


def undirected(inc: DataFrame) -> DataFrame:
    """Co-occurrence edges ``(u, v, n_chunks, last_chunk)``, u < v; the latest chunk is the evidence."""
    return pairs(inc).groupBy("u", "v").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max("chunk").alias("last_chunk"))


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """Each undirected edge as two directed rows ``(src, dst, ...)``."""
    ends = F.explode(F.array(
        F.struct(F.col("u").alias("src"), F.col("v").alias("dst")),
        F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("e")
    return edges.select(ends, *keep).select("e.src", "e.dst", *keep)


def degrees(inc: DataFrame) -> DataFrame:
    """Distinct neighbours per node.

    A node inside a hot chunk is adjacent to all of that chunk, so its largest hot
    chunk is counted by size; only its other chunks are expanded, minus the nodes
    already counted. The pairs of the hot chunk itself are never made for it.
    """
    hot = _hot_chunks(inc)
    if hot.isEmpty():
        ends = both_ways(pairs(inc).select("u", "v").distinct())
        return ends.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("src", "node")
    homes = (
        inc.join(hot, "chunk").groupBy("node")
        .agg(F.max(F.struct("n", "chunk")).alias("h"))
        .select("node", F.col("h.chunk").alias("home"), F.col("h.n").alias("home_n"))
    )
    mine = inc.join(homes, "node", "left").filter(
        F.col("home").isNull() | (F.col("chunk") != F.col("home")))
    others = (
        mine.select("chunk", "node", "home")
        .join(inc.select("chunk", F.col("node").alias("other")), "chunk")
        .filter(F.col("node") != F.col("other")).select("node", "home", "other").distinct()
    )
    fresh = others.join(
        inc.select(F.col("chunk").alias("home"), F.col("node").alias("other")), ["home", "other"], "left_anti")
    extra = fresh.groupBy("node").agg(F.count(F.lit(1)).alias("extra"))
    return (
        inc.select("node").distinct().join(homes, "node", "left").join(extra, "node", "left")
        .select("node", (F.coalesce(F.col("home_n") - 1, F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("degree"))
        .filter("degree > 0")
    )


def step(inc: DataFrame, frontier: DataFrame) -> DataFrame:
    """Nodes that share a chunk with the frontier (the frontier itself included)."""
    chunks = inc.join(frontier, "node", "left_semi").select("chunk").distinct()
    return inc.join(chunks, "chunk", "left_semi").select("node").distinct()


def hops(inc: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Breadth-first distance from the seeds up to ``depth``: ``(node, hop)``."""
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = seen.select("node")
    for level in range(1, depth + 1):
        fresh = step(inc, frontier).join(seen.select("node"), "node", "left_anti")
        if depth > 2:
            fresh = durable(fresh)
        seen = seen.unionByName(fresh.withColumn("hop", F.lit(level)))
        frontier = fresh
    return seen


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Modularity of the partition ``member(node, cid)`` on unweighted edges ``(u, v)``."""
    m = edges.count()
    a = member.select(F.col("node").alias("u"), F.col("cid").alias("cu"))
    b = member.select(F.col("node").alias("v"), F.col("cid").alias("cv"))
    tagged = edges.select("u", "v").join(a, "u").join(b, "v")
    halves = tagged.select(F.explode(F.array(
        F.struct(F.col("cu").alias("cid"), (F.col("cu") == F.col("cv")).cast("int").alias("inner")),
        F.struct(F.col("cv").alias("cid"), F.lit(0).alias("inner")))).alias("h"))
    per = halves.groupBy("h.cid").agg(F.count(F.lit(1)).alias("deg"), F.sum("h.inner").alias("inner"))
    share = F.col("deg") / F.lit(2.0 * max(m, 1))
    return per.agg(F.sum(F.col("inner") / F.lit(float(max(m, 1))) - share * share).alias("modularity"))


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Communities by majority label: ``(node, cid)``.

    Every round a node takes the most frequent label around it (its own label and
    smaller labels win ties). Half of the nodes move per round, which keeps
    two-sided structures from swapping labels forever.
    """
    links = durable(both_ways(edges))
    state = durable(links.select(F.col("src").alias("node")).distinct().withColumn("cid", F.col("node")))
    for r in range(rounds):
        votes = (
            links.join(state.withColumnRenamed("node", "dst"), "dst")
            .groupBy(F.col("src").alias("node"), "cid").agg(F.count(F.lit(1)).alias("n"))
        )
        old = state.withColumnRenamed("cid", "old")
        best = (
            votes.join(old, "node")
            .withColumn("own", (F.col("cid") == F.col("old")).cast("int"))
            .groupBy("node", "old").agg(F.min_by("cid", F.struct(-F.col("n"), -F.col("own"), "cid")).alias("best"))
        )
        moves = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
        new = durable(best.select("node", F.when(moves, F.col("best")).otherwise(F.col("old")).alias("cid"),
                                  (moves & (F.col("best") != F.col("old"))).alias("moved"),
                                  (F.col("best") != F.col("old")).alias("wants")))
        state = new.select("node", "cid")
        if new.filter("wants").isEmpty():
            break
    return state


def communities(edges: DataFrame, max_levels: int = 4, max_sweeps: int = 8) -> DataFrame:
    """Modularity communities by repeated local moves and contraction: ``(node, cid)``.

    Each sweep scores, for half of the nodes, every neighbouring community with
    weighted aggregates and moves the node where modularity gains most; a level ends
    when few nodes move, its communities become the nodes of the next level. Fewer
    than three nodes give no community.
    """
    links = durable(both_ways(edges.select("u", "v")).withColumn("w", F.lit(1.0)))
    nodes = durable(links.select(F.col("src").alias("node")).distinct())
    n = nodes.count()
    if n < 3:
        return nodes.filter(F.lit(False)).withColumn("cid", F.col("node"))
    two_m = float(links.count())
    member = nodes.withColumn("cid", F.col("node"))
    for _ in range(max_levels):
        local, moved_any = _local_moves(links, two_m, max_sweeps)
        if not moved_any:
            break
        renamed = local.select(F.col("node").alias("cid"), F.col("cid").alias("up"))
        member = durable(member.join(renamed, "cid").select("node", F.col("up").alias("cid")))
        a = local.select(F.col("node").alias("src"), F.col("cid").alias("cs"))
        b = local.select(F.col("node").alias("dst"), F.col("cid").alias("cd"))
        links = durable(
            links.join(a, "src").join(b, "dst")
            .groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("w").alias("w")))
    return member


def _local_moves(links: DataFrame, two_m: float, max_sweeps: int) -> tuple[DataFrame, bool]:
    strength = durable(links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    state = durable(strength.withColumn("cid", F.col("node")))
    count = state.count()
    moved_any = False
    idle = 0
    for sweep in range(max_sweeps):
        total = state.groupBy("cid").agg(F.sum("k").alias("tot"))
        placed = durable(state.join(total, "cid").withColumn("turn", F.pmod(F.xxhash64("node", F.lit(sweep // 2)), F.lit(2)) == sweep % 2))
        mine = placed.filter("turn").select("node", "k", F.col("cid").alias("old"))
        # Only nodes whose turn it is are scored; a neighbour brings the total of its community along.
        waits = F.pmod(F.xxhash64("src", F.lit(sweep // 2)), F.lit(2)) != sweep % 2
        around = (
            links.filter((F.col("src") != F.col("dst")) & ~waits)
            .join(placed.select(F.col("node").alias("dst"), "cid", "tot"), "dst").select(F.col("src").alias("node"), "cid", "tot", "w"))
        home = placed.filter("turn").select("node", "cid", "tot").withColumn("w", F.lit(0.0))
        # Dealt by node once: the sums, the join and the choice all stay where the node is.
        options = around.unionByName(home).repartition("node").groupBy("node", "cid").agg(F.sum("w").alias("w"), F.max("tot").alias("tot"))
        stay = F.col("cid") == F.col("old")
        gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(stay, F.col("k")).otherwise(0.0)) / two_m
        best = (
            options.join(mine, "node").withColumn("gain", F.round(gain, 9))
            .groupBy("node", "k", "old")
            .agg(F.min_by("cid", F.struct(-F.col("gain"), (~stay).cast("int"), "cid")).alias("best")))
        kept = placed.filter("not turn").select("node", "k", "cid", F.lit(False).alias("moved"))
        new = durable(best.select("node", "k", F.col("best").alias("cid"), (F.col("best") != F.col("old")).alias("moved")).unionByName(kept))
        moved = new.filter("moved").count()
        state = new.select("node", "k", "cid")
        moved_any = moved_any or moved > 0
        idle = idle + 1 if moved <= count * 0.002 else 0
        if idle >= 2:
            break
    return state.select("node", "cid"), moved_any


def betweenness(edges: DataFrame, normalised: bool = True, batch: int = 4096) -> DataFrame:
    """Exact betweenness of an undirected graph ``(u, v)``: ``(node, betweenness)``.

    Shortest-path counting from bounded batches of about ``batch`` sources. Forward levels
    of a batch hold ``(source, node, paths)``; dependencies then flow back one level at a
    time, and the batch leaves one sum for each node. So what is kept at a time grows with
    the graph and not with its square; the work is that of all sources, as it must be.
    Nodes with one neighbour lie on no shortest path between others, and what starts at
    one is what starts at its neighbour: they are sources only through that neighbour,
    which counts once more for each of them.
    """
    links = durable(both_ways(edges.select("u", "v").distinct()))
    degree = durable(links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.min("dst").alias("only")))
    n = degree.count()
    leaves = degree.filter("degree = 1")
    # Paths that start at a leaf pass through its neighbour to all nodes but the two.
    hung = leaves.groupBy(F.col("only").alias("node")).agg(F.count(F.lit(1)).alias("leaves"))
    sources = durable(
        degree.filter("degree > 1").join(hung, "node", "left")
        .select("node", (F.coalesce("leaves", F.lit(0)) + 1).cast("double").alias("times"), F.coalesce("leaves", F.lit(0)).alias("leaves")))
    parts = max(1, -(-sources.count() // batch))
    sums = []
    for k in range(parts):
        mine = sources if parts == 1 else sources.filter(F.pmod(F.xxhash64("node"), F.lit(parts)) == k)
        sums.append(_dependencies(links, mine))
    total = sums[0]
    for part in sums[1:]:
        total = total.unionByName(part)
    scale = 1.0 / ((n - 1) * (n - 2)) if normalised and n > 2 else 0.5
    summed = total.groupBy("node").agg((F.sum("dep") * scale).alias("betweenness"))
    return degree.select("node").join(summed, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _dependencies(links: DataFrame, sources: DataFrame) -> DataFrame:
    """``node, dep``: what the paths from these sources (and the leaves they stand for) add to each node."""
    levels = [durable(sources.select(F.col("node").alias("source"), "node").withColumn("paths", F.lit(1.0)))]
    seen = levels[0].select("source", "node")
    while True:
        grown = durable(
            levels[-1].join(links, F.col("node") == F.col("src"))
            .groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
            .join(seen, ["source", "node"], "left_anti"))
        if grown.isEmpty():
            break
        levels.append(grown)
        # Only the last two levels can be met again in an undirected graph.
        seen = levels[-2].select("source", "node").unionByName(grown.select("source", "node"))
    below = levels[-1].withColumn("dep", F.lit(0.0))
    parts = []
    for upper in reversed(levels[:-1]):
        parts.append(below.select("source", "node", "dep"))
        lifted = (
            below.join(links, F.col("node") == F.col("src"))
            .select("source", F.col("dst").alias("node"), ((1.0 + F.col("dep")) / F.col("paths")).alias("share"))
            .groupBy("source", "node").agg(F.sum("share").alias("share")))
        below = durable(
            upper.join(lifted, ["source", "node"], "left")
            .withColumn("dep", F.col("paths") * F.coalesce("share", F.lit(0.0))).drop("share"))
    times = sources.select(F.col("node").alias("source"), "times", "leaves")
    # What a source's own paths reach, itself left out, is what its leaves' paths pass through it to reach, less the leaf.
    own = below.select("source", F.col("source").alias("node"), "dep").join(times, "source").select(
        "node", (F.col("leaves") * (F.col("dep") - 1.0)).alias("dep"))
    if not parts:
        return durable(own)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    weighed = whole.join(times, "source").groupBy("node").agg(F.sum(F.col("dep") * F.col("times")).alias("dep"))
    return durable(weighed.unionByName(own).groupBy("node").agg(F.sum("dep").alias("dep")))


def community_digest(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per community: size, first ten papers by name, entity types, number of papers.

    ``nodes`` has ``(node, node_type, source_paper)``. Papers are folded to distinct
    rows first; only ten per community are put into a list.
    """
    joined = member.join(nodes, "node")
    size = joined.groupBy("cid").agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.array_join(F.array_sort(F.collect_set("node_type")), ", ").alias("entity_types"))
    papers = joined.filter(F.coalesce("source_paper", F.lit("")) != "").select("cid", "source_paper").distinct()
    top = (
        papers.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("source_paper")))
        .filter("r <= 10").groupBy("cid")
        .agg(F.array_join(F.array_sort(F.collect_list("source_paper")), ", ").alias("top_papers"))
    )
    counts = papers.groupBy("cid").agg(F.count(F.lit(1)).alias("n_papers"))
    return size.join(top, "cid", "left").join(counts, "cid", "left").select(
        "cid", "n_entities", F.coalesce("n_papers", F.lit(0)).alias("n_papers"), "entity_types",
        F.coalesce("top_papers", F.lit("")).alias("top_papers"))


def matching(nodes: DataFrame, label: str, evidence: str, question: str) -> DataFrame:
    """Nodes whose label or evidence contains a question word of four or more letters."""
    terms = [t for t in question.lower().split() if len(t) > 3]
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(F.lower(label), F.lit(t)) | F.contains(F.lower(evidence), F.lit(t))
    return nodes.filter(hit)
