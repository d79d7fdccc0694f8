"""Graph operators over edge tables (src, dst): degrees, walks, expansion with decay, PageRank, impact, hotspots, clusters."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

DAMPING = 0.85
SMALL_EDGES, SMALL_SEEDS = 1_000_000, 1_000  # up to here walks and ranks run on the driver, in arrays of a few megabytes
WALKS = 4  # rounds in which all walks of a graph must end for its ranks to be sums over them


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session may go without: a temporary folder is named there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table to the shared folder, so that loops keep short lineages."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class SmallGraph:
    """The edges of a graph of bounded size on the driver. Gives what the loops of joins give, without a job for each round."""

    def __init__(self, table: pa.Table) -> None:
        both = pa.chunked_array([*table.column("src").chunks, *table.column("dst").chunks], table.schema.field("src").type).combine_chunks()
        coded = both.dictionary_encode()
        self.nodes, codes = coded.dictionary, coded.indices.to_numpy()
        self.src, self.dst = codes[: table.num_rows].astype(np.int64), codes[table.num_rows :].astype(np.int64)
        order = np.argsort(self.src, kind="stable")
        self.targets, self.start = self.dst[order], np.searchsorted(self.src[order], np.arange(len(self.nodes) + 1))

    @staticmethod
    def of(edges: DataFrame) -> SmallGraph | None:
        """None for a graph of more than SMALL_EDGES edges, of which nothing is sent to the driver."""
        return SmallGraph(edges.select("src", "dst").toArrow()) if edges.count() <= SMALL_EDGES else None

    def reach(self, seed: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, hops) within a number of hops of a node, without itself."""
        hop = np.full(len(self.nodes), -1)
        hop[seed], last = 0, np.array([seed])
        for k in range(1, depth + 1):
            n = self.start[last + 1] - self.start[last]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[last] - (ends - n), n)
            last = np.unique(self.targets[at])
            last = last[hop[last] < 0]
            if not len(last):
                break
            hop[last] = k
        found = np.flatnonzero(hop > 0)
        return found, hop[found]

    def bfs(self, seeds: pa.Array) -> np.ndarray:
        """The numbers of seeds, -1 for those outside the graph."""
        return np.array(pa.compute.index_in(seeds, self.nodes).fill_null(-1))

    def ranks(self, jump: np.ndarray, iterations: int, tolerance: float | None, every: int) -> np.ndarray:
        n = len(self.nodes)
        outs = np.bincount(self.src, minlength=n)
        rank, lost = np.full(n, 1.0 / n), outs == 0
        for i in range(1, iterations + 1):
            share = rank / np.maximum(outs, 1)
            new = (1 - DAMPING) * jump + DAMPING * rank[lost].sum() * jump + DAMPING * np.bincount(self.dst, share[self.src], n)
            change, rank = np.abs(new - rank).sum(), new
            if tolerance and (i % every == 0 or i == iterations) and change < tolerance:
                break
        return rank / rank.sum()


def edges_of(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct edges; parallel ones collapse."""
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degrees(df: DataFrame) -> DataFrame:
    """node, fan_in, fan_out, counting parallel edges."""
    ends = df.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(df.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").cast("long").alias("fan_in"), F.sum("o").cast("long").alias("fan_out"))


def neighbors(edges: DataFrame, node: object, k: int) -> DataFrame:
    """kind (in, out), neighbor: sorted, at most k of each kind."""
    near = edges.where(F.col("src") == F.lit(node)).select(F.lit("out").alias("kind"), F.col("dst").alias("neighbor")).union(edges.where(F.col("dst") == F.lit(node)).select(F.lit("in"), "src"))
    return near.distinct().withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("neighbor"))).where(F.col("r") <= k).drop("r")


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, hop: the nodes each seed reaches within a number of hops, at their smallest hop; seeds have hop 0."""
    spark = edges.sparkSession
    starts = seeds.select("node").limit(SMALL_SEEDS + 1).toArrow().column("node").combine_chunks()
    small = SmallGraph.of(edges) if len(starts) <= SMALL_SEEDS else None
    if small is not None:
        starts = starts.cast(small.nodes.type) if len(small.nodes) else starts
        parts = [(starts, starts, pa.array(np.zeros(len(starts), np.int32)))]
        for k, code in enumerate(small.bfs(starts) if len(small.nodes) else []):
            if code >= 0:
                found, hops = small.reach(int(code), depth)
                parts.append((starts.take(pa.array(np.full(len(found), k))), small.nodes.take(pa.array(found)), pa.array(hops.astype(np.int32))))
        table = pa.table({name: pa.concat_arrays([p[i] for p in parts]) for i, name in enumerate(("seed", "node", "hop"))})
        kind = edges.schema["dst"].dataType.simpleString()
        return spark.createDataFrame(table, f"seed {kind}, node {kind}, hop int")
    found = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"))
    frontier = found
    for hop in range(1, depth + 1):
        step = frontier.join(edges, frontier.node == edges.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = kept(step.join(found, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)), "bfs")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        if hop % 8 == 0:  # else the plan grows by a branch with each hop
            found = kept(found, "bfs-found")
    return found


def expand(edges: DataFrame, seeds: DataFrame, depth: int, decay: float = 0.7) -> DataFrame:
    """node, score, hop, via: what seeds (node, score) reach forwards and backwards, decayed by hop, the best path each.

    Seeds themselves are neither entered nor returned.
    """
    start = seeds.select(F.col("node").alias("seed"), "node", F.col("score").alias("seed_score"))
    parts = None
    for via, directed in (("forward", edges), ("reverse", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))):
        open_edges = directed.join(seeds.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        reached = bfs(open_edges, start.select("node"), depth).where("hop > 0")
        part = reached.join(start.select("seed", "seed_score"), "seed").select("node", (F.col("seed_score") * F.pow(F.lit(decay), F.col("hop"))).alias("score"), "hop", F.lit(via).alias("via"))
        parts = part if parts is None else parts.unionByName(part)
    best = parts.groupBy("node").agg(F.max("score").alias("score"), F.min("hop").alias("hop"), F.collect_set("via").alias("ways"))
    return best.select("node", F.round("score", 6).alias("score"), "hop", F.when(F.size("ways") > 1, "both").otherwise(F.element_at("ways", 1)).alias("via"))


def pagerank(edges: DataFrame, iterations: int = 100, tolerance: float | None = 1e-8, teleport: DataFrame | None = None, every: int = 5) -> DataFrame:
    """node, rank: power iteration with dangling mass sent where a random jump goes; ranks sum to 1.

    teleport: (node, weight), restricted to nodes of the graph; without positive weights jumps are uniform. With a tolerance
    the loop ends when the total change falls below it, which is looked at every few rounds. Large graphs without longer
    walks take a few joins in all, others a join for each round. Edges are read several times, so they should be stored.
    """
    small = SmallGraph.of(edges)
    if small is not None:
        return _small_ranks(small, edges, iterations, tolerance, teleport, every)
    out = edges.groupBy("src").agg(F.count("*").alias("outs"))
    all_nodes = edges.select(F.col("dst").alias("node")).distinct().join(out.withColumnRenamed("src", "node"), "node", "full")
    if teleport is None:
        wanted = all_nodes.withColumn("weight", F.lit(1.0))
    else:
        wanted = all_nodes.join(teleport.groupBy("node").agg(F.sum("weight").alias("weight")), "node", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    wanted = kept(wanted, "pagerank-weights")
    sums = wanted.agg(F.sum("weight").alias("total"), F.count("*").alias("n")).first()
    if not sums["n"]:
        return wanted.select("node", F.lit(0.0).alias("rank"))
    jump = F.col("weight") / F.lit(float(sums["total"])) if sums["total"] else F.lit(1.0 / sums["n"])
    base = wanted.select("node", "outs", jump.alias("jump"))
    steps = _walks(base, edges, 1.0 / sums["n"])
    if steps is not None:
        return _walked_ranks(steps, iterations, tolerance, every)
    return _joined_ranks(base, edges, 1.0 / sums["n"], iterations, tolerance, every)


def _walks(base: DataFrame, edges: DataFrame, start: float) -> list[DataFrame] | None:
    """What k steps along the edges make of the jumps (u) and of the even start (v): (node, outs, u, v) for k = 0, 1, ..., until
    no step is left. None for graphs with longer walks or cycles."""
    steps = [base.select("node", "outs", F.col("jump").alias("u"), F.lit(start).alias("v"))]
    while not (going := steps[-1].where("outs is not null")).isEmpty():
        if len(steps) > WALKS:
            return None
        sent = going.select(F.col("node").alias("src"), *((F.col(c) / F.col("outs")).alias(c) for c in "uv")).join(edges, "src")
        sent = sent.groupBy(F.col("dst").alias("node")).agg(F.sum("u").alias("u"), F.sum("v").alias("v"))
        steps.append(kept(sent.join(base.select("node", "outs"), "node").select("node", "outs", "u", "v"), "pagerank-walk"))
    return steps


def _walked_ranks(steps: list[DataFrame], iterations: int, tolerance: float | None, every: int) -> DataFrame:
    """The ranks of the rounds of a power iteration as sums over walks.

    Round i is c(i) u0 + d c(i-1) u1 + d^2 c(i-2) u2 ... + d^i vi with c(i) = 1 - d + d lost(i-1): only the numbers c change from
    round to round, and lost mass is such a sum too. So one pass gives the change of every round that is looked at.
    """
    deep = len(steps) - 1
    each = [step.select("node", "outs", F.lit(k).alias("k"), "u", "v") for k, step in enumerate(steps)]
    rows = each[0]
    for step in each[1:]:
        rows = rows.unionByName(step)
    names = [f"{c}{k}" for k in range(deep + 1) for c in "uv"]
    at = lambda name: F.coalesce(F.sum(F.when(F.col("k") == int(name[1:]), F.col(name[0]))), F.lit(0.0)).alias(name)
    table = kept(rows.groupBy("node").agg(F.max("outs").alias("outs"), *map(at, names)), "pagerank-walks")
    sums = table.agg(*(F.sum(c).alias(c) for c in names), *(F.coalesce(F.sum(F.when(F.col("outs").isNull(), F.col(c))), F.lit(0.0)).alias(f"lost_{c}") for c in names)).first()
    rounds, lost, c = [{"v0": 1.0}], sums["lost_v0"], [0.0]
    for i in range(1, iterations + 1):
        c.append(1 - DAMPING + DAMPING * lost)
        shares = {f"u{k}": DAMPING**k * c[i - k] for k in range(min(i - 1, deep) + 1)} | ({f"v{i}": DAMPING**i} if i <= deep else {})
        lost = sum(share * sums[f"lost_{x}"] for x, share in shares.items())
        rounds.append(shares)

    def total(shares: dict[str, float]) -> Column:
        out = F.lit(0.0)
        for x, share in shares.items():
            out = out + F.lit(share) * F.col(x)
        return out

    last = iterations
    if tolerance:
        looked = [i for i in range(1, iterations + 1) if i % every == 0 or i == iterations]
        change = lambda i: {x: rounds[i].get(x, 0.0) - rounds[i - 1].get(x, 0.0) for x in {**rounds[i - 1], **rounds[i]}}
        changes = table.agg(F.lit(0), *(F.sum(F.abs(total(change(i)))) for i in looked)).first()[1:]
        last = next((i for i, x in zip(looked, changes) if x < tolerance), iterations)
    whole = sum(share * sums[x] for x, share in rounds[last].items())
    return table.select("node", (total(rounds[last]) / F.lit(whole)).alias("rank"))


def _joined_ranks(base: DataFrame, edges: DataFrame, start: float, iterations: int, tolerance: float | None, every: int) -> DataFrame:
    """The rounds one by one: each is one join and one grouping, written in turn to one of two folders, from which the next one reads."""
    edges = kept(edges.select("src", "dst"), "pagerank-edges")
    spark, folder = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/pagerank-{uuid.uuid4().hex[:12]}"
    ranks = base.withColumn("rank", F.lit(start))
    lost = base.agg(F.coalesce(F.sum(F.when(F.col("outs").isNull(), start)), F.lit(0.0))).first()[0]
    whole = 1.0
    for i in range(1, iterations + 1):
        sent = ranks.where("outs is not null").select(F.col("node").alias("src"), (F.col("rank") / F.col("outs")).alias("got")).join(edges, "src").select(F.col("dst").alias("node"), "got")
        met = ranks.unionByName(sent, allowMissingColumns=True).groupBy("node").agg(F.max("outs").alias("outs"), F.max("jump").alias("jump"), F.max("rank").alias("old"), F.coalesce(F.sum("got"), F.lit(0.0)).alias("got"))
        new = met.select("node", "outs", "jump", (F.lit(1 - DAMPING + DAMPING * lost) * F.col("jump") + DAMPING * F.col("got")).alias("rank"), "old")
        seen = Observation()
        sums = F.sum(F.when(F.col("outs").isNull(), F.col("rank"))).alias("lost"), F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change"), F.sum("rank").alias("whole")
        new.observe(seen, *sums).drop("old").write.mode("overwrite").parquet(f"{folder}/{i % 2}")
        ranks = spark.read.schema(ranks.schema).parquet(f"{folder}/{i % 2}")
        lost, whole = seen.get["lost"] or 0.0, seen.get["whole"]
        if tolerance and (i % every == 0 or i == iterations) and seen.get["change"] < tolerance:
            break
    return ranks.select("node", (F.col("rank") / F.lit(whole)).alias("rank"))


def _small_ranks(small: SmallGraph, edges: DataFrame, iterations: int, tolerance: float | None, teleport: DataFrame | None, every: int) -> DataFrame:
    spark, n, kind = edges.sparkSession, len(small.nodes), edges.schema["src"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"node {kind}, rank double")
    weight = np.ones(n)
    if teleport is not None:
        own = teleport.join(nodes(edges), "node", "left_semi").select("node", F.col("weight").cast("double")).toArrow()
        weight = np.zeros(n)
        np.add.at(weight, small.bfs(own.column("node").combine_chunks().cast(small.nodes.type)), own.column("weight").fill_null(0.0).to_numpy())
    jump = weight / weight.sum() if weight.sum() else np.full(n, 1.0 / n)
    return spark.createDataFrame(pa.table({"node": small.nodes, "rank": small.ranks(jump, iterations, tolerance, every)}), f"node {kind}, rank double")


def file_dependencies(relations: DataFrame) -> DataFrame:
    """src (importer), dst (definer): files joined through the symbols one defines and the other imports."""
    defines = relations.where("relation_type = 'defines'").groupBy(F.col("dst_ref").alias("symbol")).agg(F.max("src_ref").alias("dst"))
    imports = relations.where("relation_type = 'imports'").select(F.col("dst_ref").alias("symbol"), F.col("src_ref").alias("src")).distinct()
    return imports.join(defines, "symbol").where("src <> dst").select("src", "dst").distinct()


def dependents(dependencies: DataFrame, target: object, depth: int = 4) -> DataFrame:
    """node, hop: direct (hop 1) and transitive dependents of a target; hop counts up to `depth`."""
    back = dependencies.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seed = dependencies.sparkSession.range(1).select(F.lit(target).cast(dependencies.schema["dst"].dataType).alias("node"))
    return bfs(back, seed, depth).where("hop > 0").select("node", "hop").where(F.col("node") != F.lit(target))


def risk(fan_in, fan_out, churn):
    return fan_in * F.greatest(F.lit(1), fan_out) * (1 + churn / 10.0)


def hotspots(nodes_: DataFrame, k: int = 10) -> DataFrame:
    """Adds score = fan_in (1 + churn), doubled without tests, and keeps the best k; ties by node."""
    score = F.col("fan_in") * (1 + F.col("churn")) * F.when(F.col("tested"), 1).otherwise(2)
    return nodes_.withColumn("score", score.cast("double")).orderBy(F.desc("score"), "node").limit(k)


def clusters(members: DataFrame, edges: DataFrame, k: int, files: int) -> DataFrame:
    """cluster, size, dominant, degree, outgoing, top: the largest k clusters of (node, cluster, role).

    dominant: the most frequent role, ties by name; degree: edge ends in the cluster; outgoing: distinct clusters it points
    to; top: its `files` nodes of highest degree, joined by commas.
    """
    degree = degrees(edges)
    known = members.join(degree, "node", "left").withColumn("degree", F.coalesce(F.col("fan_in") + F.col("fan_out"), F.lit(0)))
    roles = known.groupBy("cluster", "role").count().groupBy("cluster").agg(F.min_by("role", F.struct(-F.col("count"), F.col("role"))).alias("dominant"))
    ranked = known.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), "node"))).where(F.col("r") <= files)
    top = ranked.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "node"))), lambda x: x["node"].cast("string")), ",").alias("top"))
    place = members.select("node", "cluster")
    crossing = edges.join(place.withColumnsRenamed({"node": "src", "cluster": "a"}), "src").join(place.withColumnsRenamed({"node": "dst", "cluster": "b"}), "dst").where("a <> b").groupBy(F.col("a").alias("cluster")).agg(F.countDistinct("b").alias("outgoing"))
    sums = known.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("degree").alias("degree"))
    out = sums.join(roles, "cluster").join(top, "cluster").join(crossing, "cluster", "left").withColumn("outgoing", F.coalesce("outgoing", F.lit(0)))
    return out.orderBy(F.desc("size"), "cluster").limit(k).select("cluster", "size", "dominant", "degree", "outgoing", "top")
