"""Exact cosine near-duplicates by dual traversal of cover trees.

On unit vectors cosine >= c means distance <= t = sqrt(2 - 2c).  The top level
of the tree is a net of centres from a bounded sample (``centres``); every
distinct vector goes to its nearest centre, and large nodes are cut into blocks
of about ``block`` rows.  A row is sent to a pair of blocks only when the covering
radius of the other block allows a partner (distance to its centre <= radius +
t).  One task then holds one pair of blocks, builds nested levels with halving
radii on both sides and walks them together, dropping node pairs whose centres
are further apart than the sum of their covering radii plus t.  Leaves are
compared exactly in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import components, stored

LEAF = 64


def _tree(v: np.ndarray, rows: np.ndarray, radius: float, floor: float):
    """(centre, covering radius, rows, children); children cover with half the radius until ``floor``."""
    centre = v[rows[0]]
    far = np.sqrt(np.maximum(0, 2 - 2 * (v[rows] @ centre)))
    cover = float(far.max()) + 1e-9
    if len(rows) <= LEAF or cover <= floor:
        return centre, cover, rows, []
    half, left, children = min(radius, cover) / 2, rows, []
    while len(left):
        d = np.sqrt(np.maximum(0, 2 - 2 * (v[left] @ v[left[0]])))
        near = d <= half
        near[0] = True
        children.append(left[near])
        left = left[~near]
        if len(children) > 32 and len(children) * 4 > len(rows) - len(left):
            children.extend(left[i : i + LEAF] for i in range(0, len(left), LEAF))  # no structure at this scale
            break
    return centre, cover, rows, [_tree(v, c, half, floor) for c in children] if len(children) > 1 else []


def _dual(a, b, cosine_of, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of both sides with the matrix of links, for every pair of leaves that the bounds leave."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if float(np.linalg.norm(x[0] - y[0])) > x[1] + y[1] + t + 1e-6:
            continue
        if x[3] and (not y[3] or x[1] >= y[1]):
            stack.extend((c, y) for c in x[3])
        elif y[3]:
            stack.extend((x, c) for c in y[3])
        else:
            for i in range(0, len(x[2]), 256):
                hits = cosine_of(x[2][i : i + 256], y[2])
                if hits.any():
                    yield x[2][i : i + 256], y[2], hits


def _merge(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of ``roots`` (smallest member) that the pairs ``i``, ``j`` connect."""
    p, q = roots[i], roots[j]
    apart = p != q
    for x, y in np.unique(np.stack([p[apart], q[apart]], 1), axis=0).tolist():
        x, y = roots[x], roots[y]
        if x != y:
            roots[roots == max(x, y)] = min(x, y)


def near_vectors(rows: DataFrame, cosine: float = 0.95, centres: int = 64, block: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row (vec_id, embedding).

    Null and zero vectors, and vectors with null or non-finite components, link
    with nothing.  Equal vectors are one class; only vectors of equal length are
    compared.  Rows that repeat a vec_id each count as a vector.  Null vec_ids
    take no part and are their own component.
    """
    t = float(np.sqrt(2 - 2 * cosine))
    e = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    base = rows.select("vec_id", F.transform(e, lambda x: x + F.lit(0.0)).alias("e"), F.coalesce(ok, F.lit(False)).alias("ok"))
    base = stored(base.withColumn("key", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.transform("e", lambda x: x.cast("string"))), 256))), "vectors")
    classes = stored(base.where("ok").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("e").alias("e")), "classes")
    sample = classes.select("e").orderBy(F.xxhash64("key")).limit(centres).collect()  # bounded by the parameter
    net: dict[int, np.ndarray] = {}
    for r in sample:
        net.setdefault(len(r["e"]), []).append(np.asarray(r["e"]) / np.linalg.norm(r["e"]))
    net = {d: np.array(c) for d, c in net.items()}

    def unit(e) -> np.ndarray:
        x = np.asarray(e, float)
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rep, copies, e in zip(batch["rep"], batch["copies"], batch["e"], strict=True):
                x = unit(e)
                c = net.get(len(x), np.zeros((1, len(x))))
                cos = c @ x
                k = int(cos.argmax())
                out.append((rep, copies, x, len(x), k, float(np.sqrt(max(0.0, 2 - 2 * cos[k])))))
            yield pd.DataFrame(out, columns=["rep", "copies", "v", "dim", "cell", "far"])

    placed = stored(classes.mapInPandas(home, "rep long, copies long, v array<double>, dim int, cell int, far double"), "placed")
    sizes = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    cut = placed.join(F.broadcast(sizes), ["dim", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / block)).cast("int")
    ).drop("n", "radius", "far")
    # block list: rows / block entries plus at most one per centre and length
    heads = sizes.select("dim", "cell", F.col("radius"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))).alias("part"))
    blocks = [(r["dim"], r["cell"], r["part"], r["radius"]) for r in heads.orderBy("dim", "cell", "part").collect()]
    place = {b[:3]: i for i, b in enumerate(blocks)}

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_dim = {d: [i for i, b in enumerate(blocks) if b[0] == d] for d in {b[0] for b in blocks}}
        for batch in batches:
            for dim, frame in batch.groupby("dim"):
                others = np.array(by_dim[dim])
                v = np.stack(frame["v"].to_numpy())
                me = np.array([place[dim, c, p] for c, p in zip(frame["cell"], frame["part"], strict=True)])
                cells, radii = np.array([blocks[i][1] for i in others]), np.array([blocks[i][3] for i in others])
                far = np.sqrt(np.maximum(0, 2 - 2 * (v @ net[dim].T))) if dim in net else np.zeros((len(v), 1))
                r, j = np.nonzero((far[:, cells] <= radii + t + 1e-6) | (others[None, :] == me[:, None]))
                for i in range(0, len(r), 8192):
                    x, y = r[i : i + 8192], others[j[i : i + 8192]]
                    yield pd.DataFrame({
                        "lo": np.minimum(me[x], y), "hi": np.maximum(me[x], y), "rep": frame["rep"].to_numpy()[x],
                        "copies": frame["copies"].to_numpy()[x], "left": me[x] <= y, "v": list(v[x]),
                    })

    def match(key, frame: pd.DataFrame) -> pd.DataFrame:
        """Degree of every vector and its set among the rows of one pair of blocks, not the pairs themselves."""
        same = key[0] == key[1]
        frame = frame.sort_values("rep", ignore_index=True)
        v, rep, copies = np.stack(frame["v"].to_numpy()), frame["rep"].to_numpy(), frame["copies"].to_numpy()
        every = np.arange(len(v))
        left = every if same else every[frame["left"].to_numpy(bool)]
        right = every if same else every[~frame["left"].to_numpy(bool)]
        degree, roots = np.zeros(len(v), np.int64), every.copy()
        if len(left) and len(right):
            ta = _tree(v, left, 2.0, t / 2)
            tb = ta if same else _tree(v, right, 2.0, t / 2)
            alike = lambda x, y: (v[x] @ v[y].T >= cosine) & (x[:, None] != y[None, :])
            for x, y, hits in _dual(ta, tb, alike, t):
                degree[x] += hits @ copies[y]
                if not same:  # a block against itself meets every pair in both orders
                    degree[y] += copies[x] @ hits
                i, j = np.nonzero(hits)
                _merge(roots, x[i], y[j])
        out = pd.DataFrame({"a": rep, "b": rep[roots], "n": degree})
        return out[out["n"] > 0]

    shipped = cut.mapInPandas(send, "lo int, hi int, rep long, copies long, left boolean, v array<double>")
    degree = stored(shipped.groupBy("lo", "hi").applyInPandas(match, "a long, b long, n long"), "degrees")
    links = degree.groupBy("a").agg(F.sum("n").alias("n"))
    found = components(degree.select("a", "b"))
    copies = classes.select("key", "rep", "copies")
    return (
        base.select("vec_id", "key").join(copies, "key", "left")
        .join(links.withColumnRenamed("a", "rep"), "rep", "left")
        .join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select(
            "vec_id",
            (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
