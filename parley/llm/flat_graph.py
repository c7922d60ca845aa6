"""Near-duplicate vectors by searching a robust-pruned flat graph that is built in shards.

Vectors with the same label are dealt to clusters, each to its nearest and to the next ones, until
no cluster has many of its own. In every shard a graph is built: near and random candidates of a
vector are pruned so that no kept neighbour is closer to another kept one than to the vector
(Jayaram Subramanya et al. 2019). The adjacency lists of a vector from all its shards are united.
Every vector then searches: greedily from the medoid with a beam, and from whatever is in range on
through all neighbours in range. What is found is verified in double precision. Samples of all
vectors and of the largest components are held against all others, and a graph that finds too little
is built again with more overlap at every split.

Where a good share of all pairs is linked, or no split makes a shard smaller, all pairs are compared
in blocks instead: the work is then in proportion to the links.

Vectors of equal direction are one node. A shard tells only sums and a spanning forest of the links, never the
pairs; each pair is counted in one shard only, the least that both vectors are in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import components, let, staged, unit

THRESHOLD = 0.98
#: How far below the threshold the search still walks on.
SLACK = 0.04
#: Vectors of its own that a shard is meant to have, and has at most.
TARGET, MOST = 1000, 1500
FANOUT = 64
OVERLAP = 2
#: Vectors that the centres of a split are fitted on.
FITTED = 2048
NEAREST, RANDOM, DEGREE, SPREAD = 40, 12, 24, 1.2
BEAM = 24
#: Share of linked pairs from which vectors are compared in blocks of about so many rows, not split further.
DENSE, BLOCK = 0.05, 1500
#: A split that leaves a child with more than this share is none.
STUCK = 0.9
AUDITED, RECALL, TRIES = 256, 0.9, 3
#: Largest components that are audited too, and vectors of each.
LARGEST, EACH = 16, 32
SEED = 11
_ROWS = 512


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite and not NULL, and is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def direction(vector: Column) -> Column:
    """A vector in double precision, divided by its largest component: equal for exact multiples of one vector."""
    doubles = vector.cast("array<double>")
    largest = F.array_max(F.transform(doubles, lambda x: F.abs(x)))
    return F.when(usable(vector), let(largest, lambda top: F.transform(doubles, lambda x: x / top)))


def matrix(vectors: pd.Series, dtype=np.float64) -> np.ndarray:
    """Unit vectors as rows; scaled by the largest component first, so that squares neither over- nor underflow."""
    rows = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    if not len(rows):
        return np.zeros((0, 1), dtype=dtype)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(dtype)


def centres(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    pick = np.random.default_rng(SEED).permutation(len(vectors))[:k]
    found = vectors[pick]
    for _ in range(rounds):
        near = np.argmax(vectors @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), found)
    return found


def division(vectors: np.ndarray, k: int, dense: float = DENSE) -> tuple[np.ndarray, np.ndarray, bool]:
    """Centres for a split, the child of each, and whether the vectors are not to be split at all.

    Centres whose vectors are linked with each other in a share of ``dense`` or more of the pairs cut
    through one group and get one child. Vectors are not split where that holds for all of them, or
    where nearly all would go to one child.
    """
    found = centres(vectors, k)
    near = np.argmax(vectors @ found.T, axis=1)
    used, near = np.unique(near, return_inverse=True)
    found = found[used]
    links = (vectors @ vectors.T >= THRESHOLD).astype(np.float32)
    np.fill_diagonal(links, 0)
    member = np.eye(len(found), dtype=np.float32)[near]
    rows = member.sum(axis=0)
    across = (member.T @ links @ member) / np.outer(rows, rows)
    a, b = np.nonzero(np.triu(across >= dense, 1))
    child = np.unique(_roots(len(found), a, b), return_inverse=True)[1]
    n = len(vectors)
    whole = links.sum() >= dense * n * (n - 1) or np.bincount(child[near]).max() > STUCK * n
    return found, child, bool(whole)


def shards(nodes: DataFrame, overlap: int = OVERLAP, dense: float = DENSE) -> DataFrame:
    """(grp, shard, node, vec, home, dense): nodes in their own shard (home) and in overlapping ones.

    Shards with too many own nodes are split again and again; a split is fitted on a bounded sample
    and applied in salted groups of bounded size, so a label with most of the vectors is no hot key.
    Shards that are dense, or that no split makes smaller, stay whole whatever their size.
    """
    members = nodes.select("grp", F.lit(0).cast("long").alias("shard"), "node", "vec", F.lit(True).alias("home"))
    members = members.withColumn("dense", F.lit(False))
    while True:
        members = staged(members, "graph-members")
        sizes = members.filter("not dense").groupBy("grp", "shard").agg(F.count("*").alias("rows"), F.count_if("home").alias("own"))
        large = staged(sizes.filter(F.col("own") > MOST), "graph-large")
        if not large.limit(1).count():
            return members
        own = large.withColumns(
            {
                "k": F.least(F.lit(FANOUT), F.ceil(F.col("own") / TARGET)).cast("int"),
                "salts": F.ceil(F.col("rows") / 8192).cast("int"),
            }
        )
        split = members.join(own, ["grp", "shard"])
        sample = split.filter(F.col("home") & (unit(F.col("node"), seed=SEED) * F.col("own") < FITTED))

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            found, child, whole = division(matrix(group["vec"], np.float32), int(group["k"].iloc[0]), dense)
            head = group.iloc[0]
            return pd.DataFrame(
                [(head["grp"], head["shard"], int(head["salts"]), found.ravel().tolist(), child.tolist(), whole)],
                columns=["grp", "shard", "salts", "centres", "children", "whole"],
            )

        fitted = sample.groupBy("grp", "shard").applyInPandas(
            fit, "grp string, shard long, salts int, centres array<float>, children array<int>, whole boolean"
        )
        salted = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

        def deal(rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
            if fitted["whole"].iloc[0]:
                return rows[["grp", "shard", "node", "vec", "home"]].assign(dense=True, child=0)
            vectors = matrix(rows["vec"], np.float32)
            found = np.array(fitted["centres"].iloc[0], dtype=np.float32).reshape(-1, vectors.shape[1])
            likeness, child = vectors @ found.T, np.asarray(fitted["children"].iloc[0])
            likeness = np.stack([likeness[:, child == c].max(axis=1) for c in range(child.max() + 1)], axis=1)
            order = np.argsort(-likeness, axis=1, kind="stable")[:, : overlap + 1]
            parts = []
            for place in range(order.shape[1]):
                part = rows[["grp", "shard", "node", "vec", "home"]].assign(dense=False)
                part["child"] = order[:, place]
                if place:
                    part = part[part["home"]]
                    part["home"] = False
                parts.append(part)
            return pd.concat(parts)

        dealt = (
            split.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
            .select("grp", "shard", "salt", "node", "vec", "home")
            .groupBy("grp", "shard", "salt")
            .cogroup(salted.groupBy("grp", "shard", "salt"))
            .applyInPandas(
                deal, "grp string, shard long, node long, vec array<double>, home boolean, dense boolean, child int"
            )
        )
        moved = dealt.groupBy("grp", "node", F.xxhash64("shard", "child").alias("shard")).agg(
            F.first("vec").alias("vec"), F.max("home").alias("home"), F.max("dense").alias("dense")
        )
        still = members.join(large.select("grp", "shard"), ["grp", "shard"], "left_anti")
        members = still.unionByName(moved)


def prune(vectors: np.ndarray, pool: np.ndarray, degree: int = DEGREE, spread: float = SPREAD) -> np.ndarray:
    """Robust pruning of candidate lists (n x c, nearest first, -1 for none), all vectors at once."""
    kept = np.full((len(vectors), degree), -1, dtype=np.int64)
    for at in range(0, len(vectors), _ROWS):
        part = pool[at : at + _ROWS]
        rows = np.arange(len(part))
        candidates = vectors[part]
        own = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,ncd->nc", vectors[at : at + _ROWS], candidates), 0))
        alive = part >= 0
        for place in range(degree):
            has = alive.any(axis=1)
            if not has.any():
                break
            best = np.argmax(alive, axis=1)
            kept[at + rows[has], place] = part[rows, best][has]
            chosen = candidates[rows, best]
            apart = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,ncd->nc", chosen, candidates), 0))
            alive &= (spread * apart > own) & (part != part[rows, best][:, None])
    return kept


def build(vectors: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists of a shard: pruned near and random candidates, and the same edges backwards."""
    n = len(vectors)
    near = min(NEAREST, n - 1)
    if near < 1:
        return [np.empty(0, dtype=np.int64) for _ in range(n)]
    chance = np.random.default_rng(SEED)
    pool = np.empty((n, near + RANDOM), dtype=np.int64)
    for at in range(0, n, _ROWS):
        likeness = vectors[at : at + _ROWS] @ vectors.T
        rows = np.arange(len(likeness))
        likeness[rows, at + rows] = -2
        best = np.argpartition(-likeness, near - 1, axis=1)[:, :near]
        other = chance.integers(0, n, (len(likeness), RANDOM))
        both = np.concatenate([best, other], axis=1)
        both = np.take_along_axis(both, np.argsort(-np.take_along_axis(likeness, both, 1), axis=1, kind="stable"), 1)
        pool[at : at + _ROWS] = np.where(both == (at + rows)[:, None], -1, both)
    kept = prune(vectors, pool)
    source = np.repeat(np.arange(n), kept.shape[1])[kept.ravel() >= 0]
    target = kept.ravel()[kept.ravel() >= 0]
    pairs = np.unique(np.concatenate([source * n + target, target * n + source]))
    return np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))


def search(vectors: np.ndarray, lists: list[np.ndarray], start: int, reach: float, beam: int = BEAM) -> np.ndarray:
    """Which vectors each vector comes upon within ``reach``: greedy from ``start``, then by range."""
    n, degree = len(vectors), max([len(x) for x in lists] + [1])
    graph = np.full((n, degree), -1, dtype=np.int64)
    for i, x in enumerate(lists):
        graph[i, : len(x)] = x
    found = np.zeros((n, n), dtype=bool)
    for at in range(0, n, _ROWS):
        mine = vectors[at : at + _ROWS]
        rows = np.arange(len(mine))
        seen = np.zeros((len(mine), n), dtype=bool)
        seen[:, start] = True
        ids = np.full((len(mine), beam), -1, dtype=np.int64)
        likeness = np.full((len(mine), beam), -3.0, dtype=np.float32)
        done = np.zeros((len(mine), beam), dtype=bool)
        ids[:, 0], likeness[:, 0] = start, mine @ vectors[start]
        near_q, near_v = [rows[likeness[:, 0] >= reach]], [ids[likeness[:, 0] >= reach, 0]]
        active = rows
        while len(active):
            open_ = np.where(done[active] | (ids[active] < 0), -4.0, likeness[active])
            best = np.argmax(open_, axis=1)
            going = open_[np.arange(len(active)), best] > -4
            active, best = active[going], best[going]
            if not len(active):
                break
            done[active, best] = True
            next_ = graph[ids[active, best]]
            fresh = (next_ >= 0) & ~seen[active[:, None], next_]
            q, v = np.repeat(active, fresh.sum(axis=1)), next_[fresh]
            seen[q, v] = True
            like = np.full(next_.shape, -3.0, dtype=np.float32)
            like[fresh] = np.einsum("nd,nd->n", mine[q], vectors[v])
            hit = like[fresh] >= reach
            near_q.append(q[hit])
            near_v.append(v[hit])
            all_like = np.concatenate([likeness[active], like], axis=1)
            top = np.argpartition(-all_like, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, next_, -1)], 1), top, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], 1), top, 1)
            likeness[active] = np.take_along_axis(all_like, top, 1)
        q, v = np.concatenate(near_q), np.concatenate(near_v)
        while len(q):  # on through all that is in range
            found[at + q, v] = True
            step_q, step_v = [], []
            for part in range(0, len(q), 20_000):
                next_ = graph[v[part : part + 20_000]]
                owner = np.repeat(q[part : part + 20_000], degree)
                next_ = next_.ravel()
                fresh = next_ >= 0
                owner, next_ = owner[fresh], next_[fresh]
                fresh = ~seen[owner, next_]
                pair = np.unique(owner[fresh] * n + next_[fresh])
                owner, next_ = pair // n, pair % n
                seen[owner, next_] = True
                hit = np.einsum("nd,nd->n", mine[owner], vectors[next_]) >= reach
                step_q.append(owner[hit])
                step_v.append(next_[hit])
            q, v = np.concatenate(step_q), np.concatenate(step_v)
    return found


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each index is connected with."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (before == root).all():
            break
    return root


def lower_shards(lists: pd.Series, shard: int) -> np.ndarray:
    """Which shards below ``shard`` (columns) each vector is in too: a pair is counted in the least one it shares."""
    sizes = [len(x) for x in lists]
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists])
    rows = np.repeat(np.arange(len(lists)), sizes)[flat < shard]
    below, column = np.unique(flat[flat < shard], return_inverse=True)
    known = np.zeros((len(lists), len(below)), dtype=bool)
    known[rows, column] = True
    return known


def crowded(vectors: np.ndarray, dense: float, sample: int = 512) -> bool:
    """Whether so many pairs of a shard are linked that comparing all is less work than walking a graph."""
    some = vectors[:: -(-len(vectors) // sample)]
    n = len(some)
    return n > 1 and (some @ some.T >= THRESHOLD).sum() - n >= dense * n * (n - 1)


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, links, root) of dense shards: parts by hash, every part compared with every other, exactly."""
    keys = ["grp", "shard"]
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"one": F.least("part", "_other"), "two": F.greatest("part", "_other")})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node").reset_index(drop=True)
        names, part = group["node"].to_numpy(), group["part"].to_numpy()
        one, two = np.flatnonzero(part == group["one"].iloc[0]), np.flatnonzero(part == group["two"].iloc[0])
        same = group["one"].iloc[0] == group["two"].iloc[0]
        vectors, copies = matrix(group["vec"]), group["copies"].to_numpy(dtype=np.int64)
        lower = lower_shards(group["shards"], group["shard"].iloc[0]).astype(np.float32)
        links, ends = np.zeros(len(names), dtype=np.int64), [np.zeros((2, 0), dtype=np.int64)]
        for at in range(0, len(one), _ROWS):
            mine = one[at : at + _ROWS]
            near = vectors[mine] @ vectors[two].T >= THRESHOLD
            if same:
                near &= mine[:, None] < two[None, :]
            a, b = np.nonzero(near)
            ends.append(np.stack([mine[a], two[b]]))
            near &= lower[mine] @ lower[two].T == 0
            links[mine] += near @ copies[two]
            links[two] += near.T @ copies[mine]
        root = names[_roots(len(names), *np.concatenate(ends, axis=1))]
        return pd.DataFrame({"node": names, "links": links, "root": root})

    return (
        dealt.select("grp", "shard", "one", "two", "part", "node", "vec", "shards", "copies")
        .groupBy("grp", "shard", "one", "two")
        .applyInPandas(compare, "node long, links long, root long")
    )


def linked(nodes: DataFrame, overlap: int, beam: int, dense: float = DENSE) -> DataFrame:
    """(node, links, root) from every shard: copies linked there, and a node it is connected with."""
    members = shards(nodes.select("grp", "node", F.col("vec").cast("array<double>")), overlap, dense)
    keys = ["grp", "shard"]

    def lists(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        names = group["node"].to_numpy()
        found = build(matrix(group["vec"], np.float32))
        return pd.DataFrame({"node": names, "next": [names[x].tolist() for x in found]})

    sparse = members.filter("not dense")
    graph = (
        sparse.groupBy(*keys)
        .applyInPandas(lists, "node long, next array<long>")
        .groupBy("node")
        .agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
    )
    places = members.groupBy("node").agg(F.collect_list("shard").alias("shards"))
    placed = places.join(nodes.select("node", "copies"), "node")
    whole = sparse.join(graph, "node").join(placed, "node")

    def find(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node").reset_index(drop=True)
        names, shard = group["node"].to_numpy(), group["shard"].iloc[0]
        vectors = matrix(group["vec"])
        rough = vectors.astype(np.float32)
        if crowded(rough, dense):
            reach = THRESHOLD - 1e-4  # float32
            found = np.concatenate([rough[k : k + _ROWS] @ rough.T >= reach for k in range(0, len(rough), _ROWS)])
        else:
            place = pd.Series(np.arange(len(names)), index=names)
            local = [place.reindex(x).dropna().to_numpy(dtype=np.int64) for x in group["next"]]
            medoid = int(np.argmax(rough @ rough.mean(axis=0)))
            found = search(rough, local, medoid, THRESHOLD - SLACK, beam)
        a, b = np.nonzero(np.triu(found | found.T, 1))
        exact = np.concatenate(
            [
                np.einsum("nd,nd->n", vectors[a[k : k + 100_000]], vectors[b[k : k + 100_000]])
                for k in range(0, len(a), 100_000)
            ]
            or [np.empty(0)]
        )
        a, b = a[exact >= THRESHOLD], b[exact >= THRESHOLD]
        lower = lower_shards(group["shards"], shard)
        counted = ~(lower[a] & lower[b]).any(axis=1)
        root = names[_roots(len(names), a, b)]
        a, b = a[counted], b[counted]
        copies = group["copies"].to_numpy(dtype=np.int64)
        links = np.bincount(a, weights=copies[b], minlength=len(names))
        links += np.bincount(b, weights=copies[a], minlength=len(names))
        return pd.DataFrame({"node": names, "links": links.astype(np.int64), "root": root})

    walked = whole.groupBy(*keys).applyInPandas(find, "node long, links long, root long")
    compared = blocks(members.filter("dense").join(placed, "node"))
    return staged(walked.unionByName(compared), "graph-links")


def audit(nodes: DataFrame, links: DataFrame, joined: DataFrame, seed: int = SEED, sample: int = AUDITED) -> float:
    """Share of the links of two bounded samples of nodes that were found, by comparing them with all nodes.

    One sample is drawn from all nodes, one from the largest components of ``joined`` (node,
    component), which hold little of a large table but most of its links; the lower share counts.
    """
    total = nodes.count()
    sizes = joined.groupBy("component").agg(F.count("*").alias("_size"))
    largest = sizes.orderBy(F.desc("_size"), "component").limit(LARGEST)
    drawn = unit(F.col("node"), seed=seed + 1)
    inside = joined.join(F.broadcast(largest), "component").filter(drawn * F.col("_size") < EACH)
    chosen = nodes.filter(drawn * max(total, 1) < sample).select("node", F.lit(False).alias("large"))
    chosen = chosen.unionByName(inside.select("node", F.lit(True).alias("large")))
    chosen = nodes.join(chosen, "node").join(
        links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left"
    )
    asked = chosen.select("grp", "node", "vec", "large", F.coalesce("links", F.lit(0)).alias("links")).toPandas()
    once = asked.drop_duplicates("node")
    queries = nodes.sparkSession.sparkContext.broadcast(
        {name: (part["node"].to_numpy(), matrix(part["vec"])) for name, part in once.groupby("grp")}
    )

    def compare(frames):
        for frame in frames:
            for name, part in frame.groupby("grp"):
                if name not in queries.value:
                    continue
                ids, vectors = queries.value[name]
                near = vectors @ matrix(part["vec"]).T >= THRESHOLD
                near &= ids[:, None] != part["node"].to_numpy()[None, :]
                counts = near @ part["copies"].to_numpy(dtype=np.int64)
                yield pd.DataFrame({"node": ids, "n": counts})

    truth = (
        nodes.select("grp", "node", "vec", "copies")
        .mapInPandas(compare, "node long, n long")
        .groupBy("node")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    both = asked.merge(truth, on="node", how="left").fillna({"n": 0})
    both["met"] = np.minimum(both["links"], both["n"])
    sums = both.groupby("large")[["met", "n"]].sum()
    sums = sums[sums["n"] > 0]
    return float((sums["met"] / sums["n"]).min()) if len(sums) else 1.0


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", overlap: int = OVERLAP
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``.

    Only vectors of equal label and length are compared; NULL labels, and vectors that are NULL,
    empty, zero or hold NULL or non-finite components, link with nothing and are components of their
    own. Equal vectors are linked with each other. Rows with equal keys stay apart. An empty table
    gives no rows; other columns are not looked at. Raises if the audited recall stays too low.
    """
    rows = vectors.select(
        F.col(key).alias("key"),
        F.when(
            F.col(label).isNotNull() & usable(F.col(vector)),
            F.concat_ws("|", F.col(label).cast("string"), F.size(vector).cast("string")),
        ).alias("grp"),
        direction(F.col(vector)).alias("vec"),
    )
    good = rows.filter("grp is not null")
    nodes = staged(
        good.groupBy("grp", "vec")
        .agg(F.min("key").alias("least"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "graph-nodes",
    )
    for attempt in range(TRIES):
        found = linked(nodes, overlap << attempt, BEAM << attempt, DENSE / 8**attempt)
        joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        recall = audit(nodes, found, joined)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"recall {recall:.3f} is below {RECALL}")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        nodes.join(links, "node", "left")
        .join(joined.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        .select("grp", "vec", "least", "copies", "links", F.coalesce("component", "node").alias("component"))
    )
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(smallest, "component").select(
        F.col("grp").alias("_grp"),
        F.col("vec").alias("_vec"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id",
    )
    done = good.join(known, (F.col("grp") == F.col("_grp")) & (F.col("vec") == F.col("_vec")))
    alone = rows.filter("grp is null").select(
        "key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")
    )
    return (
        done.select("key", "n_links", "component_id")
        .unionByName(alone)
        .select(
            F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
        )
    )
