"""Near duplicates among embeddings, by a robust-pruned flat graph.

Equal vectors are one node. Nodes join the shards of their nearest cluster centres; the nearest is
their home. Centres that lie close together are one, so that a dense group isn't torn apart. On each
shard, a graph is built from nearest candidates by robust pruning: a candidate is dropped if a kept one
is closer to it, by a factor, than the node is. A node's lists from all its shards are united. So that
the united graph can be searched, a node also becomes a guest of every shard of which some member leads
to it by a link that may lie between two nodes in range of one query. Then every node searches from its
home shard's medoid and its own place, greedily with a bounded beam, and from then on through every
node within range (and some slack) until no new one turns up. Found pairs are verified in double
precision on the original vectors.

The recall is audited against brute force after every pass, at any size, each audited node counting the
same: for a bounded sample of all nodes, and for one of those nodes that links were found for. Below the
target, nodes join more shards and the search is repeated, and where all shards aren't enough, all nodes
are compared exactly, in blocks that meet each other. Large shards are cut into blocks that meet each
other, so no task holds more than a block of either kind.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
without id, link with nothing; vectors of different length don't link; every row is a vector of its own
and has a row in the result, rows that repeat an id included; an empty table gives an empty result;
columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, written
from .graph import components, forest
from .vectors import clean, embeddings, matrix, units, usable

THRESHOLD = 0.9
SHARD = 1000  # nodes with the same home, on average
CENTRES = 4096  # at most; they are 2 MB for 64 dimensions
SAMPLE = 40_000  # vectors that the centres are fitted on, at most
OVERLAP = 4  # shards that a node joins at first
HOMES, MEMBERS = 2000, 6000  # nodes in a block
CANDIDATES, DEGREE, ALPHA = 48, 16, 1.2
BACK = 4  # of a node's links, the nearest also lead back to it, so that it can be reached
BEAM, STEPS = 48, 64
SLACK = 0.15  # of cosine, below the threshold, for nodes that are still expanded
EXPANDED = 2_000_000  # neighbours looked at together
GUEST = 0.62  # cosine of the widest angle between two nodes that are both in range of a third
MERGED = 0.8  # cosine from which two centres are one
AUDIT, TARGET = 2048, 0.999  # nodes in either sample of an audit
BLOCK = 4000  # nodes in a block that are compared exactly


def centres_of(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(1)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(6):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        long = np.linalg.norm(sums, axis=1) > 1e-9
        c[long] = sums[long] / np.linalg.norm(sums[long], axis=1)[:, None]
    alone = np.ones(len(c), bool)
    for i in range(1, len(c)):
        alone[i] = not (alone[:i] & (c[:i] @ c[i] > MERGED)).any()
    return c[alone]


def pruned(u: np.ndarray) -> np.ndarray:
    """Adjacency lists (-1: none) of unit vectors: nearest candidates, pruned robustly."""
    n = len(u)
    k = min(CANDIDATES, n - 1)
    out = np.full((n, DEGREE), -1, "i4")
    if k <= 0:
        return out
    v = u.astype("f4")
    for lo in range(0, n, 512):
        sims = v[lo : lo + 512] @ v.T
        own = np.arange(len(sims))
        sims[own, lo + own] = -2
        cand = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(sims, cand, axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, order, axis=1), np.take_along_axis(near, order, axis=1)
        far = np.sqrt(np.maximum(0, 2 - 2 * near))  # distance of the node to each candidate
        among = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("qid,qjd->qij", v[cand], v[cand])))
        alive = np.ones(cand.shape, bool)
        for d in range(DEGREE):
            some = alive.any(axis=1)
            first = alive.argmax(axis=1)
            out[lo + own[some], d] = cand[own[some], first[some]]
            alive &= ALPHA * among[own, first] > far  # also drops the candidate itself, at distance 0
            alive[own, first] = False
    return both_ways(out)


def both_ways(links: np.ndarray) -> np.ndarray:
    """The lists, and the way back along the first links of each."""
    back = links[:, :BACK]
    to, at = back[back >= 0], np.nonzero(back >= 0)[0]
    order = np.argsort(to, kind="stable")
    to, at = to[order], at[order]
    nth = np.arange(len(to)) - np.searchsorted(to, to)
    more = np.full((len(links), int(nth.max()) + 1 if len(nth) else 0), -1, "i4")
    more[to, nth] = at
    return np.hstack([links, more])


def search(q: np.ndarray, self_at: np.ndarray, u: np.ndarray, links: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with cosine of ``least`` at any rate, found on the graph ``links`` over unit vectors ``u``."""
    n = len(u)
    v, qs = u.astype("f4"), q.astype("f4")
    medoid = int((v @ v.sum(axis=0)).argmax())
    entries = np.unique(np.r_[medoid, np.linspace(0, n - 1, 9).astype(int)])
    found_q, found_n = [], []
    for lo in range(0, len(q), 256):
        part = qs[lo : lo + 256]
        rows = np.arange(len(part))
        seen = np.zeros((len(part), n), bool)
        own = self_at[lo : lo + 256]
        start = np.hstack([np.broadcast_to(entries, (len(part), len(entries))), np.where(own >= 0, own, medoid)[:, None]])
        beam_n = start.copy()
        beam_s = np.einsum("qd,qkd->qk", part, v[start])
        np.put_along_axis(seen, start, True, axis=1)
        open_ = np.ones(beam_n.shape, bool)
        pairs = [(np.repeat(rows, start.shape[1]), start.ravel(), beam_s.ravel())]
        for _ in range(STEPS):
            pick = np.where(open_, beam_s, -9).argmax(axis=1)  # the nearest open node of each query
            going = open_[rows, pick]
            if not going.any():
                break
            open_[rows, pick] = False
            near = links[beam_n[rows, pick]]
            fresh = (near >= 0) & going[:, None]
            near = np.maximum(near, 0)
            fresh &= ~np.take_along_axis(seen, near, axis=1)
            r, c = np.nonzero(fresh)
            seen[r, near[r, c]] = True
            s = np.full(near.shape, -9, "f4")
            s[r, c] = np.einsum("kd,kd->k", part[r], v[near[r, c]])
            pairs.append((r, near[r, c], s[r, c]))
            beam_n, beam_s, open_ = np.hstack([beam_n, near]), np.hstack([beam_s, s]), np.hstack([open_, fresh])
            best = np.argsort(-beam_s, axis=1, kind="stable")[:, :BEAM]
            beam_n, beam_s, open_ = (np.take_along_axis(x, best, axis=1) for x in (beam_n, beam_s, open_))
        at_q, at_n, sims = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while len(at_q):  # range expansion
            inside = sims >= least - SLACK
            at_q, at_n, sims = at_q[inside], at_n[inside], sims[inside]
            hit = sims >= least - 1e-4
            found_q.append(at_q[hit] + lo)
            found_n.append(at_n[hit])
            keys, step = [], max(1, EXPANDED // links.shape[1])
            for i in range(0, len(at_q), step):  # so many pairs at once that dense groups stay in memory
                near = links[at_n[i : i + step]]
                go_q, go_n = np.repeat(at_q[i : i + step], near.shape[1]), near.ravel()
                new = (go_n >= 0) & ~seen[go_q, go_n]
                key = np.unique(go_q[new].astype("i8") * n + go_n[new])
                seen[key // n, key % n] = True
                keys.append(key)
            key = np.concatenate(keys) if keys else np.zeros(0, "i8")
            at_q, at_n = key // n, key % n
            sims = np.concatenate([np.einsum("kd,kd->k", part[at_q[i : i + 100_000]], v[at_n[i : i + 100_000]]) for i in range(0, len(key), 100_000)] or [np.zeros(0, "f4")])
    once = np.unique(np.concatenate(found_q or [np.zeros(0, "i8")]).astype("i8") * n + np.concatenate(found_n or [np.zeros(0, "i8")]))
    return once // n, once % n


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, in double precision."""
    with np.errstate(all="ignore"):
        got = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
    odd = ~np.isfinite(got)
    if odd.any():
        got[odd] = np.einsum("ij,ij->i", units(a[odd]), units(b[odd]))
    return got


def link_pass(nodes: DataFrame, n: int, overlap: int, threshold: float) -> DataFrame:
    """Rows kind 'n' (id, n: links counted) and 'e' (id, other: an edge of a spanning forest of links)."""
    spark = nodes.sparkSession
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, max(64, n // 10))).select("v").toPandas()  # SAMPLE rows at most
    units_of = units(matrix(sample["v"]))
    k = min(CENTRES, max(1, n // SHARD), len(units_of))
    centres = centres_of(units_of, k)
    m = min(overlap, len(centres))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                sims = units(matrix(b["v"])) @ centres.T
                top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, axis=1), axis=1), axis=1)
                yield pd.DataFrame({"id": b["id"], "v": b["v"], "copies": b["copies"], "shards": list(top.astype("i4"))})

    placed = written(nodes.mapInPandas(place, "id long, v array<double>, copies long, shards array<int>"), "placed")
    homes = placed.select(F.col("shards")[0].alias("shard")).groupBy("shard").agg(F.count("*").alias("homes"))

    def blocked(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows for each node in each of its shards, with the blocks of the shard's queries (hb) and members (mb); the shards' blocks."""
        joined = df.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count("*").alias("members"))
        sizes = joined.join(homes, "shard", "left").select("shard", F.ceil(F.coalesce("homes", F.lit(0)) / HOMES).cast("int").alias("hb"), F.ceil(F.col("members") / MEMBERS).cast("int").alias("mb"))
        sizes = F.broadcast(sizes)  # CENTRES rows at most
        return df.withColumn("shard", F.explode("shards")).join(sizes, "shard").withColumn("block", F.expr("cast(pmod(xxhash64(id), mb) as int)")), sizes

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        u, ids = units(matrix(pdf["v"])), pdf["id"].to_numpy()
        links = pruned(u)
        close = [x[x >= 0][(u[x[x >= 0]] @ v) >= GUEST] for x, v in zip(links, u, strict=True)]
        return pd.DataFrame({"id": ids, "near": [ids[x[x >= 0]] for x in links], "close": [ids[x] for x in close]})

    lists = blocked(placed)[0].select("shard", "block", "id", "v").groupBy("shard", "block").applyInPandas(build, "id long, near array<long>, close array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.array_distinct(F.flatten(F.collect_list("close"))).alias("close"))  # overlap lists a node
    graph_table = graph = written(placed.join(united, "id"), "graph")
    led = graph.where("size(close) > 0").select(F.explode("close").alias("id"), "shards").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("shards"))).alias("led"))
    everywhere = F.when(F.col("led").isNull(), F.col("shards")).otherwise(F.array_union("shards", "led"))  # the home stays first
    graph = graph.drop("close").join(led, "id", "left").withColumn("shards", everywhere).drop("led")
    members, sizes = blocked(graph)
    members = written(members, "members")
    queries = graph.withColumn("shard", F.col("shards")[0]).join(sizes, "shard").withColumn("part", F.expr("cast(pmod(xxhash64(id, 1), hb) as int)")).withColumn("block", F.expr("explode(sequence(0, mb - 1))"))
    nodes_at = members.where("hb > 0").withColumn("part", F.expr("explode(sequence(0, hb - 1))"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"kind": [], "id": [], "other": []}).astype({"kind": "str", "id": "i8", "other": "i8"})
        if not len(left) or not len(right):
            return none
        ids, order = right["id"].to_numpy(), np.argsort(right["id"].to_numpy())
        right, ids = right.iloc[order], ids[order]
        m_n, m_q, q_ids = matrix(right["v"]), matrix(left["v"]), left["id"].to_numpy()

        def local(keys: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
            return np.where(ids[at] == keys, at, -1)

        lengths = np.fromiter(map(len, right["near"]), "i8", len(right))
        links = np.full((len(ids), max(1, int(lengths.max()))), -1, "i4")
        links[np.repeat(np.arange(len(ids)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = local(np.concatenate(list(right["near"])).astype("i8"))
        q, node = search(units(m_q), local(q_ids), units(m_n), links, threshold)
        other = q_ids[q] != ids[node]
        q, node = q[other], node[other]
        true = np.concatenate([exact(m_q[q[i : i + 50_000]], m_n[node[i : i + 50_000]]) >= threshold for i in range(0, len(q), 50_000)] or [np.zeros(0, bool)])
        q, node = q[true], node[true]
        home = int(left["shard"].iloc[0])
        widest = max(map(len, left["shards"]))
        shards_q = np.stack([np.r_[x, np.full(widest - len(x), -1)] for x in left["shards"]])
        home_n = np.array([x[0] for x in right["shards"]])
        copies_q, copies_n = left["copies"].to_numpy(), right["copies"].to_numpy()
        # The pair is met again, from the other side, if the query is in the node's home shard; else it is counted for both here.
        again = (shards_q[q] == home_n[node][:, None]).any(axis=1) & (home_n[node] != home)
        both_home = home_n[node] == home  # each of them is a query of this shard
        once = ~again & ~both_home
        counts = np.bincount(q, copies_n[node], len(q_ids)).astype("i8")
        back = np.bincount(node[once], copies_q[q[once]], len(ids)).astype("i8")
        a, b = forest(q_ids[q], ids[node])
        parts = [("n", q_ids[counts > 0], counts[counts > 0]), ("n", ids[back > 0], back[back > 0]), ("e", a, b)]
        return pd.concat([none, *(pd.DataFrame({"kind": kind, "id": x, "other": y}) for kind, x, y in parts)])

    by = ["shard", "part", "block"]
    met = queries.select(*by, "id", "v", "copies", "shards").groupBy(*by).cogroup(nodes_at.select(*by, "id", "v", "copies", "shards", "near").groupBy(*by)).applyInPandas(meet, "kind string, id long, other long")
    out = written(met, "links")
    dropped(placed, members, graph_table)
    return out


def exact_pass(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """The rows of ``link_pass``, by comparing all nodes with each other."""
    blocks = -(-n // BLOCK)
    placed = nodes.withColumn("block", F.expr(f"cast(pmod(xxhash64(id, 2), {blocks}) as int)"))
    left = placed.withColumnRenamed("block", "lb").withColumn("rb", F.expr(f"explode(sequence(lb, {blocks - 1}))"))
    right = placed.withColumnRenamed("block", "rb").withColumn("lb", F.expr("explode(sequence(0, rb))"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"kind": [], "id": [], "other": []}).astype({"kind": "str", "id": "i8", "other": "i8"})
        if not len(left) or not len(right):
            return none
        same = int(left["lb"].iloc[0]) == int(left["rb"].iloc[0])
        a, b, ids_a, ids_b = matrix(left["v"]), matrix(right["v"]), left["id"].to_numpy(), right["id"].to_numpy()
        u_a, u_b = units(a), units(b)
        copies_a, copies_b = left["copies"].to_numpy(), right["copies"].to_numpy()
        counts, back, edges = np.zeros(len(a), "i8"), np.zeros(len(b), "i8"), []
        for lo in range(0, len(a), 256):
            i, j = np.nonzero(u_a[lo : lo + 256] @ u_b.T >= threshold - 1e-9)
            i += lo
            other = ids_a[i] != ids_b[j]
            i, j = i[other], j[other]
            true = np.concatenate([exact(a[i[k : k + 50_000]], b[j[k : k + 50_000]]) >= threshold for k in range(0, len(i), 50_000)] or [np.zeros(0, bool)])
            i, j = i[true], j[true]
            counts += np.bincount(i, copies_b[j], len(a)).astype("i8")
            back += np.bincount(j, copies_a[i], len(b)).astype("i8")
            edges.append(forest(ids_a[i], ids_b[j]))
        e_a, e_b = forest(*map(np.concatenate, zip(*edges, strict=True)))
        parts = [("n", ids_a[counts > 0], counts[counts > 0]), ("e", e_a, e_b)]
        if not same:
            parts.append(("n", ids_b[back > 0], back[back > 0]))
        return pd.concat([none, *(pd.DataFrame({"kind": kind, "id": x, "other": y}) for kind, x, y in parts)])

    met = left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInPandas(meet, "kind string, id long, other long")
    return written(met, "links")


def audit(nodes: DataFrame, links: DataFrame, threshold: float) -> float:
    """The share of a node's links, by brute force, that were counted: the lesser of the means over a sample of the nodes that have any, and over one of those that some were found for."""
    spark = nodes.sparkSession
    order = [F.xxhash64("id", F.lit(9)), F.col("id")]
    counted = links.where("kind = 'n'").groupBy("id").agg(F.sum("other").alias("got"))
    linked = nodes.join(counted.select("id"), "id").orderBy(*order).limit(AUDIT).select("id", "v", F.lit(1).alias("found"))
    sample = nodes.orderBy(*order).limit(AUDIT).select("id", "v", F.lit(0).alias("found")).unionByName(linked).toPandas()  # 2 x AUDIT rows
    if not len(sample):
        return 1.0
    ids, u = sample["id"].to_numpy(), units(matrix(sample["v"]))
    shared = spark.sparkContext.broadcast((ids, u))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, u = shared.value
        total = np.zeros(len(ids), "i8")
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.iloc[i : i + 2000]
                hit = (units(matrix(part["v"])) @ u.T >= threshold) & (part["id"].to_numpy()[:, None] != ids)
                total += part["copies"].to_numpy() @ hit
        yield pd.DataFrame({"place": np.arange(len(ids)), "n": total})

    true = nodes.mapInPandas(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).where("n > 0").toPandas()  # 2 x AUDIT rows
    if not len(true):
        return 1.0
    true["id"], true["found"] = ids[true["place"]], sample["found"].to_numpy()[true["place"]]
    table = F.broadcast(spark.createDataFrame(true[["id", "found", "n"]], "id long, found int, n long"))
    share = F.least(F.lit(1.0), F.coalesce("got", F.lit(0)) / F.col("n"))
    return min(r["share"] for r in table.join(counted, "id", "left").groupBy("found").agg(F.avg(share).alias("share")).collect())


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", col: str = "embedding", overlap: int = OVERLAP) -> DataFrame:
    """id, n_links, component (the smallest id reached) of every row of ``vectors``."""
    same = ["dim", "h1", "h2"]
    rows = written(clean(vectors, key, col).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "vectors")
    equal = rows.groupBy(*same).agg(F.first("v").alias("v"), F.min("id").alias("low"), F.count("*").alias("copies"))
    nodes = written(equal.withColumn("id", F.monotonically_increasing_id()), "nodes")
    found = None
    for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect():  # a row for each length
        part, shards = nodes.where(F.col("dim") == r["dim"]).select("id", "v", "copies"), overlap
        while True:
            links = link_pass(part, r["n"], shards, threshold)
            most = min(CENTRES, max(1, r["n"] // SHARD))
            if audit(part, links, threshold) >= TARGET:
                break
            dropped(links)
            if shards >= most:
                links = exact_pass(part, r["n"], threshold)
                break
            shards *= 2
        found = links if found is None else found.unionByName(links)
    unfit = vectors.where(~F.coalesce(F.col(key).isNotNull() & usable(col), F.lit(False))).select(F.col(key).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component"))
    if found is None:
        return unfit
    counts = found.where("kind = 'n'").groupBy("id").agg(F.sum("other").alias("n"))
    joined = components(found.where("kind = 'e'").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("component", "group")
    of_node = nodes.drop("v").join(counts, "id", "left").join(joined, "id", "left").withColumn("group", F.coalesce("group", "id"))
    of_node = written(of_node.withColumn("n_links", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long")), "of_node")
    least = of_node.groupBy("group").agg(F.min("low").alias("component"))
    of_node = of_node.join(least, "group").select(*same, "n_links", "component")
    return rows.select("id", *same).join(of_node, same).select("id", "n_links", "component").unionByName(unfit)


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, by cosine of 0.9 or more, and components of all embeddings."""
    got = near_duplicates(embeddings(spark, sf_dir))
    return got.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
