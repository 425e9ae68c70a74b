"""Operator 4: near duplicates among embeddings by navigable small-world graphs per shard.

Vectors of a label are dealt into shards of bounded size and every shard gets a graph. Each shard is
queried by every vector of its label, a pair of shards per task. A task widens its beams until an audit against
brute force passes, verifies each pair by cosine and returns counts and a spanning forest, not pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hnsw import Graph
from .shared import stored

#: What rounding may take from a similarity of unit vectors before the exact check.
_SLACK = 1e-9
#: Nearest nodes that the audit looks for per query. In its own shard a vector is the first of them.
_NEAREST = 4


def linked(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.93,
    shard_rows: int = 2048,
    degree: int = 16,
    beam: int = 32,
    audit_rows: int = 48,
    recall: float = 0.995,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors are linked when their labels are equal and not null and their cosine, in double precision, is
    `least` or more. n_links counts the other vectors linked directly, component_id is the smallest id
    reachable over links, kept is id = component_id.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different length. Equal vectors of a label are searched once and all counted. Rows that
    repeat id and vector are one vector; rows that share only the id share their links. A null id links with
    nothing and is kept with a null component. Other columns are not read.
    """
    rows = stored(
        vectors.select(
            F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
            F.col(vector_col).cast("array<double>").alias("v"),
        ),
        "vectors",
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    nodes = (
        usable.groupBy("label", F.size("v").alias("dim"), "v")
        .agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
    )
    nodes = stored(nodes, "nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(sizes, ["label", "dim"]).withColumn(
        "shard", F.pmod(F.xxhash64("rep", "v"), F.col("shards")).cast("int")
    )

    def build(key: tuple, table: pa.Table) -> pa.Table:
        return _built(table, degree)

    index = stored(
        dealt.groupBy("label", "dim", "shard").applyInArrow(
            build,
            "label string, dim int, shard int, shards int, pos int, rep long, copies long, v array<double>,"
            " level int, links array<int>",
        ),
        "index",
    )
    asked = index.select("*", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("i"), F.col("shard").alias("j"))
    asking = index.filter("shard < shards - 1").select(
        "*", F.lit(True).alias("asks"), F.col("shard").alias("i"),
        F.explode(F.sequence(F.col("shard") + 1, F.col("shards") - 1)).alias("j"),
    )

    def search(key: tuple, table: pa.Table) -> pa.Table:
        return _searched(table, least=least, degree=degree, beam=beam, audit_rows=audit_rows, recall=recall)

    found = stored(
        asked.unionByName(asking)
        .select("label", "dim", "i", "j", "asks", "pos", "rep", "copies", "v", "level", "links")
        .groupBy("label", "dim", "i", "j")
        .applyInArrow(search, "label string, dim int, rep long, part long, root long"),
        "links",
    )
    members = stored(usable.select("id", "label", F.size("v").alias("dim"), "v").distinct().join(
        nodes.withColumnRenamed("rep", "rep_"), ["label", "dim", "v"]
    ).select("id", "label", F.col("rep_").alias("rep"), "copies"), "members")
    edges = members.select(F.col("id").alias("a"), F.col("rep").alias("b")).unionByName(
        found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    )
    whole = components(edges)
    counted = found.groupBy("label", "rep").agg(F.sum("part").alias("others"))
    per_id = members.join(counted, ["label", "rep"], "left").groupBy("id").agg(
        F.sum(F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n")
    )
    out = rows.select("id").join(per_id, "id", "left").join(whole, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table["v"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _built(table: pa.Table, degree: int) -> pa.Table:
    table = table.sort_by([("rep", "ascending")])
    reps = table["rep"].to_numpy()
    # Ids are no direction in space, but copies may lie side by side in them.
    order = np.random.default_rng(len(reps)).permutation(len(reps))
    table = table.take(pa.array(order))
    graph = Graph.built(_unit(_matrix(table)), reps[order], degree=degree)
    links = [
        np.concatenate([graph.links[level][i] for level in range(graph.levels[i] + 1)]) for i in range(len(order))
    ]
    return table.select(["label", "dim", "shard", "shards"]).append_column(
        "pos", pa.array(np.arange(len(order)), pa.int32())
    ).append_column("rep", table["rep"]).append_column("copies", table["copies"]).append_column(
        "v", table["v"]
    ).append_column("level", pa.array(graph.levels, pa.int32())).append_column(
        "links", pa.array(links, pa.list_(pa.int32()))
    )


def _graph(nodes: pa.Table, degree: int) -> Graph:
    levels = nodes["level"].to_numpy()
    graph = Graph(_unit(_matrix(nodes)), levels, degree)
    for i, flat in enumerate(nodes["links"].to_pylist()):
        at = 0
        for level in range(levels[i] + 1):
            width = graph.links[level].shape[1]
            graph.links[level][i] = flat[at : at + width]
            at += width
    graph.entry = int(np.argmax(levels))
    return graph


def _searched(
    table: pa.Table, *, least: float, degree: int, beam: int, audit_rows: int, recall: float
) -> pa.Table:
    asks = table["asks"].to_numpy()
    nodes = table.filter(pa.array(~asks)).sort_by([("pos", "ascending")])
    same = not asks.any()
    queries = nodes if same else table.filter(pa.array(asks)).sort_by([("rep", "ascending")])
    empty = pa.table({k: pa.array([], t) for k, t in _FOUND})
    if not nodes.num_rows:
        return empty
    graph, raw = _graph(nodes, degree), _matrix(nodes)
    asked = graph.vectors if same else _unit(_matrix(queries))
    found = _audited(graph, asked, least - _SLACK, beam, audit_rows, recall)
    q = np.repeat(np.arange(len(found)), [len(f) for f in found])
    t = np.concatenate(found) if found else np.empty(0, np.int64)
    if same:
        # Either end may have found the pair.
        q, t = np.concatenate([q, t]), np.concatenate([t, q])
        pairs = np.unique(q[q < t] * len(raw) + t[q < t])
        q, t = pairs // len(raw), pairs % len(raw)
    exact = _cosines(raw if same else _matrix(queries), raw, q, t) >= least
    q, t = q[exact], t[exact]
    if not len(q):
        return empty
    left, right = queries["rep"].to_numpy(), nodes["rep"].to_numpy()
    left_copies, right_copies = queries["copies"].to_numpy(), nodes["copies"].to_numpy()
    ids = np.concatenate([left[q], right[t]])
    weights = np.concatenate([right_copies[t], left_copies[q]])
    unique, at = np.unique(ids, return_inverse=True)
    at = at.reshape(-1)
    parts = np.bincount(at, weights=weights).astype(np.int64)
    roots = unique[_roots(at[: len(q)], at[len(q) :], len(unique))]
    n = len(unique)
    return pa.table({
        "label": pa.array([table["label"][0].as_py()] * n, pa.string()),
        "dim": pa.array([table["dim"][0].as_py()] * n, pa.int32()),
        "rep": pa.array(unique, pa.int64()), "part": pa.array(parts, pa.int64()), "root": pa.array(roots, pa.int64()),
    })


_FOUND = [("label", pa.string()), ("dim", pa.int32()), ("rep", pa.int64()), ("part", pa.int64()), ("root", pa.int64())]


def _audited(
    graph: Graph, queries: np.ndarray, least: float, beam: int, audit_rows: int, recall: float
) -> list[np.ndarray]:
    """Widen the beam until the audited queries find their links and their nearest nodes, then ask all.

    The nearest count whatever their cosine, so that a shard without links is audited too. Lost nodes
    are compared with all queries and need no audit.
    """
    picked = np.random.default_rng(len(queries)).permutation(len(queries))[:audit_rows]
    truth = queries[picked] @ graph.vectors.T
    links = int((truth >= least).sum())
    truth[:, graph.lost] = -np.inf
    k = min(_NEAREST, len(graph.vectors) - len(graph.lost))
    floor = np.partition(truth, -k, axis=1)[:, -k:].min(axis=1, keepdims=True) - _SLACK
    # From half of the shard on it is read whole.
    while 2 * beam < len(graph.vectors):
        near = int((graph.search(queries[picked], beam)[1][:, :k] >= floor).sum())
        if near >= recall * k * len(picked) and sum(map(len, graph.within(queries[picked], least, beam))) >= recall * links:
            break
        beam *= 2
    return graph.within(queries, least, beam)


def _cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    big_a, big_b = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    a, b = a / big_a, b / big_b
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    for s in range(0, len(i), 65536):
        x, y = i[s : s + 65536], j[s : s + 65536]
        out[s : s + 65536] = np.einsum("kd,kd->k", a[x], b[y]) / (norm_a[x] * norm_b[y])
    return out


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each node's component, by passing minima along and jumping."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root
