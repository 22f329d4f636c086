"""Communities: modularity moves with refinement and aggregation, overlapping propagation, ranks and descriptions.

Every step is a join or an aggregate by node or community, or a pass over blocks
of edges, written to the shared folder; no step holds a community or the graph in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.components import connected_components
from sedimenta.session import scratch_dir, settle, unsettle


#: Turns in which nodes may join parts of their community.
REFINE = 4


def _moved(e: DataFrame, part: DataFrame, m: float, gamma: float, turn: int) -> DataFrame:
    """Nodes whose turn it is go to the neighbouring community of the largest gain in modularity, others stay; ``moved`` marks those that went.

    Only a half of the nodes, by a hash of node and turn, moves at once: two
    neighbours that would swap for ever do not move together each time. This
    says a turn in joins that shuffle all edges twice; ``_turned`` gives the
    same over ``Blocks``.
    """
    total = part.groupBy("c").agg(F.sum("k").alias("kc"))
    at = part.join(total, "c").select(F.col("node").alias("a"), "c", "k", "kc")  # a row a node; edges get the community's weight with its name
    near = e.join(at.select(F.col("a").alias("b"), "c", "kc"), "b").select("a", "c", "w", "kc")
    # A node's own community is an option even without a neighbour in it.
    dealt = near.union(at.select("a", "c", F.lit(0.0), "kc")).repartition("a")  # once by node, for all three steps below
    options = dealt.groupBy("a", "c").agg(F.sum("w").alias("w"), F.first("kc").alias("kc"))
    s = options.join(part.select(F.col("node").alias("a"), F.col("c").alias("own"), "k"), "a")
    rest = F.when(F.col("c") == F.col("own"), F.col("kc") - F.col("k")).otherwise(F.col("kc"))
    gain = F.round(F.col("w") / m - gamma * F.col("k") * rest / (2 * m * m), 12)
    best = s.groupBy("a").agg(F.min_by("c", F.struct(-gain, (F.col("c") != F.col("own")).cast("int"), F.col("c"))).alias("best"), F.first("own").alias("own"), F.first("k").alias("k"))
    goes = (F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(2)) == 0) & (F.col("best") != F.col("own"))
    return best.select(F.col("a").alias("node"), F.when(goes, F.col("best")).otherwise(F.col("own")).alias("c"), "k", goes.alias("moved"))


#: Edges of a block on average, at most; so few that a block is not cut smaller to have as many tasks as the session asks for; entries of a row.
EDGES, FEW, PIECE = 4_000_000, 100_000, 200_000
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Blocks:
    """Edges (``a``, ``b``, ``w``, in both directions) as a table in blocks of ``a``, and the blocks that each node is in.

    Edges of the same ends add up. A pass sends what is known of a node once to every block
    that has it, as arrays; edges stay where they are. All edges of a node are in one block,
    in memory at about 16 bytes an edge, so sums by node and community are whole there.
    """

    def __init__(self, level: DataFrame) -> None:
        self.spark, rows = level.sparkSession, level.count()
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        n = max(1, min(least, -(-rows // FEW)), -(-rows // EDGES))
        # a key for each partition, so that each has one block
        part = F.pmod(F.hash("id"), F.lit(n)).alias("part")
        keys = [r["key"] for r in self.spark.range(30 * n).groupBy(part).agg(F.min("id").alias("key")).orderBy("part").collect()]
        key = F.element_at(F.array(*[F.lit(k) for k in keys]).cast("array<bigint>"), F.pmod(F.xxhash64("a", F.lit(11)), F.lit(len(keys))).cast("int") + 1)
        dealt = level.select(key.alias("key"), "a", "b", "w").repartition(n, "key")
        cut = dealt.groupBy("key").applyInArrow(_cut, "key long, piece int, ids array<long>, a array<int>, b array<int>, w array<double>")
        self.n, self.names = n, []
        self.edges = self._bucketed(cut, n, "key")
        at = self.edges.select("key", "piece", F.posexplode("ids").alias("at", "node")).select("node", F.struct("key", (F.col("piece") * PIECE + F.col("at")).alias("at")).alias("to"))
        routes = at.repartition(max(least, n), "node").groupBy("node").agg(F.collect_list("to").alias("to"))
        self.routes = self._bucketed(routes.select("node", F.col("to.key").alias("keys"), F.col("to.at").alias("ats")), max(least, n), "node")

    def _bucketed(self, df: DataFrame, n: int, by: str) -> DataFrame:
        name = f"blocks_{uuid.uuid4().hex}"
        path = f"{scratch_dir(self.spark).rstrip('/')}/{name}"
        df.write.bucketBy(n, by).option("path", path).saveAsTable(name)
        self.names.append(name)
        back = self.spark.table(name)
        back._settled_at = path
        return back

    def told(self, state: DataFrame, run: Callable[[Block, dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
        """What ``run`` tells of all blocks: it gets the ids of a block's nodes and neighbours, edges by places among these (in order of ``a``), and the columns of ``state`` (``node``, others without nulls) for the ids."""
        kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields if f.name != "node"}
        said = self.routes.join(state.hint("shuffle_hash"), "node").select("keys", "ats", *kinds)
        said = said.mapInArrow(_said, f"key long, at array<int>, {', '.join(f'{c} array<{k}>' for c, k in kinds.items())}").repartition(self.n, "key")

        def met(block: pa.Table, known: pa.Table) -> pa.Table:
            block = block.sort_by("piece")
            ids, a, b, w = (_flat(block, c) for c in ("ids", "a", "b", "w"))
            at, by_id = _flat(known, "at"), {}
            for c in kinds:
                values = _flat(known, c)
                by_id[c] = np.zeros(len(ids), values.dtype)
                by_id[c][at] = values
            return pa.table(run((ids, a, b, w), by_id))

        return self.edges.groupBy("key").cogroup(said.groupBy("key")).applyInArrow(met, schema)

    def drop(self) -> None:
        """Remove the tables; no plan may read them any more."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")
        unsettle(self.edges, self.routes)


def _flat(t: pa.Table, name: str) -> np.ndarray:
    return pa.concat_arrays([c.flatten() for c in t[name].chunks] or [pa.array([], t.schema.field(name).type.value_type)]).to_numpy(zero_copy_only=False)


def _cut(edges: pa.Table) -> pa.Table:
    """A block's ids in order, and its edges by their places, in order of ``a``."""
    a, b, w = (edges[c].to_numpy() for c in ("a", "b", "w"))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)].astype(np.int32), at[len(a) :].astype(np.int32)
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    n = -(-max(len(a), len(ids)) // PIECE)
    lists = lambda x: pa.array([x[i * PIECE : (i + 1) * PIECE] for i in range(n)])
    return pa.table({"key": pa.array([edges["key"][0].as_py()] * n, pa.int64()), "piece": pa.array(range(n), pa.int32()), "ids": lists(ids), "a": lists(a), "b": lists(b), "w": lists(w)})


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block with all that some nodes say to it."""
    for batch in batches:
        sizes = batch.column("keys").value_lengths().to_numpy()
        key, at = batch.column("keys").flatten().to_numpy(), batch.column("ats").flatten().to_numpy()
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, np.int64)
        ends = pa.array(np.r_[starts, len(key)], pa.int32())
        cols = {"key": pa.array(key[order][starts]), "at": pa.ListArray.from_arrays(ends, pa.array(at[order]))}
        from_row = pa.array(np.repeat(np.arange(batch.num_rows), sizes)[order])
        for c in batch.schema.names[2:]:
            cols[c] = pa.ListArray.from_arrays(ends, batch.column(c).take(from_row))
        yield pa.RecordBatch.from_pydict(cols)


def _hashed(*parts: np.ndarray | int) -> np.ndarray:
    """``F.xxhash64`` of columns of 64 bits and literals, as unsigned numbers."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))
    h = np.full(1, 42, np.uint64)
    for x in parts:
        if isinstance(x, int) and -(1 << 31) <= x < 1 << 31:
            h = turn((h + p5 + np.uint64(4)) ^ (np.full(1, x & 0xFFFFFFFF, np.uint64) * p1), 23) * p2 + p3
        else:
            x = np.full(1, x, np.int64) if isinstance(x, int) else x.astype(np.int64)
            h = turn((h + p5 + np.uint64(8)) ^ (turn(x.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _summed(a: np.ndarray, code: np.ndarray, w: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``w`` added up by ``a`` and ``code``, in their order."""
    key = a.astype(np.int64) * codes + code
    order = np.argsort(key)
    key = key[order]
    first = _starts(key)
    key = key[first]
    return key // max(codes, 1), key % max(codes, 1), np.add.reduceat(w[order], first) if len(first) else np.zeros(0)


def _turned(blocks: Blocks, part: DataFrame, m: float, gamma: float, turn: int) -> DataFrame:
    """As ``_moved``, over all edges of the blocks."""

    def run(block: Block, known: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        ids, a, b, w = block
        own, c = a[_starts(a)], known["c"]
        k = np.bincount(a, w, len(ids))
        names, code = np.unique(c, return_inverse=True)
        kc = np.zeros(len(names))
        kc[code] = known["kc"]
        may = np.zeros(len(ids), bool)
        may[own] = _hashed(ids[own], turn) & np.uint64(1) == 0
        goers, some = own[may[own]], may[a] & (a != b)
        # a node's own community is an option even without a neighbour in it
        x, y, s = _summed(np.r_[a[some], goers], np.r_[code[b[some]], code[goers]], np.r_[w[some], np.zeros(len(goers))], len(names))
        stays = y == code[x]
        gain = np.round(s / m - gamma * k[x] * np.where(stays, kc[y] - k[x], kc[y]) / (2 * m * m), 12)
        to = c.copy()
        if len(x):
            first = _starts(x)
            top = gain == np.repeat(np.maximum.reduceat(gain, first), np.diff(np.r_[first, len(x)]))
            best = np.minimum.reduceat(np.where(top, np.where(stays, -1, y), len(names)), first)
            to[goers] = np.where(best < 0, c[goers], names[np.maximum(best, 0)])
        return {"node": ids[own], "c": to[own], "k": k[own], "moved": to[own] != c[own]}

    total = part.groupBy("c").agg(F.sum("k").alias("kc"))
    return blocks.told(part.join(total, "c").select("node", "c", "kc"), run, "node long, c long, k double, moved boolean")


def _quality(inside: float, part: DataFrame, m: float, gamma: float) -> float:
    """Modularity of a partition (``node``, ``c``, ``k``) with that weight inside its communities, each edge twice."""
    by_chance = part.groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum((F.col("k") / (2 * m)) ** 2)).first()[0] or 0.0
    return inside / (2 * m) - gamma * by_chance


def _parts(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches by the links."""
    root = np.arange(n)
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return root
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != root[root]).any():
            root = root[root]


def _connected(blocks: Blocks, part: DataFrame) -> tuple[DataFrame, float]:
    """The partition with each community cut into its connected parts, which never lowers its modularity, and the weight inside communities.

    A pass gives all nodes that a community's edges join within a block the
    least label among them. What two passes leave apart is joined as a graph of labels.
    """

    def lowest(block: Block, known: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        ids, a, b, w = block
        own, c, label = a[_starts(a)], known["c"], known["label"]
        inside = c[a] == c[b]
        root = _parts(len(ids), a[inside], b[inside])
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, root, label)
        low = low[root]
        return {"node": ids[own], "c": c[own], "label": low[own], "k": np.bincount(a, w, len(ids))[own], "inside": np.bincount(a[inside], w[inside], len(ids))[own], "fell": low[own] != label[own]}

    def apart(block: Block, known: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        _, a, b, _ = block
        c, label = known["c"], known["label"]
        link = (c[a] == c[b]) & (label[a] < label[b])
        pairs = np.unique(np.stack([label[a[link]], label[b[link]]]), axis=1)
        return {"src": pairs[0], "dst": pairs[1]}

    kinds = "node long, c long, label long, k double, inside double, fell boolean"
    at = settle(blocks.told(part.select("node", "c", F.col("node").alias("label")), lowest, kinds), "labels")
    inside = at.agg(F.sum("inside")).first()[0] or 0.0
    before, at = at, settle(blocks.told(at.select("node", "c", "label"), lowest, kinds), "labels")
    unsettle(before)
    out = at.select("node", F.col("label").alias("c"), "k")
    if at.where("fell").head(1):
        links = settle(blocks.told(at.select("node", "c", "label"), apart, "src long, dst long"), "links")
        if links.head(1):
            cc = connected_components(links).withColumnRenamed("node", "c")
            out = out.join(cc, "c", "left").select("node", F.coalesce("component", "c").alias("c"), "k")
    return out, inside


def _refined(level: DataFrame, part: DataFrame, m: float, gamma: float, turns: int, seed: int, randomness: float, blocks: Blocks | None = None) -> DataFrame:
    """``node``, ``r``: parts of each community that grow from single nodes.

    A node that is still alone, and has at least as much weight to the rest of
    its community as chance would give, joins a part of the community with
    such weight to the rest of it that it has an edge to, if that loses no
    modularity. Which one is drawn, the likelier the larger the gain. Those
    that may move in a turn and those that may be joined are told apart by a
    hash, so nobody joins a node that leaves; a part that has grown never
    moves, so it stays connected. ``blocks``: those of the level, if there are any.
    """

    def cut(block: Block, known: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        ids, a, b, w = block
        c, r = known["c"], known["r"]
        some = (c[a] == c[b]) & (r[a] != r[b])
        x = a[some]
        x, s = x[_starts(x)], np.bincount(x, w[some], len(ids))
        return {"node": ids[x], "r": r[x], "cut": s[x]}

    def drawn(t: int) -> Callable[[Block, dict[str, np.ndarray]], dict[str, np.ndarray]]:
        def run(block: Block, known: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            ids, a, b, w = block
            c, r, kr, opened = (known[x] for x in ("c", "r", "kr", "opened"))
            some = known["mover"][a] & (a != b) & (c[a] == c[b]) & opened[b]
            names, code = np.unique(r, return_inverse=True)
            by_name = np.zeros(len(names))
            by_name[code] = kr
            k = np.bincount(a, w, len(ids))
            x, y, s = _summed(a[some], code[b[some]], w[some], len(names))
            gain = s - gamma * k[x] * by_name[y] / (2 * m)
            x, y, gain = x[gain >= 0], y[gain >= 0], gain[gain >= 0]
            if not len(x):
                return {"node": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)}
            u = ((_hashed(ids[x], names[y], seed, t) & np.uint64((1 << 30) - 1)).astype(np.float64) + 0.5) / (1 << 30)
            rated = gain / np.maximum(k[x] * randomness, 1e-300) - np.log(-np.log(u))  # the largest of these is a draw with chances by exp(gain)
            first = _starts(x)
            top = rated == np.repeat(np.maximum.reduceat(rated, first), np.diff(np.r_[first, len(x)]))
            return {"node": ids[x[first]], "to": names[np.maximum.reduceat(np.where(top, y, -1), first)]}

        return run

    mine = blocks or Blocks(level)
    whole = part.groupBy("c").agg(F.sum("k").alias("kc"))
    enough = lambda w, k: F.col(w) >= gamma * F.col(k) * (F.col("kc") - F.col(k)) / (2 * m) - 1e-12
    each = part.join(whole, "c").select("node", F.col("node").alias("r"), "c", F.col("k").cast("double").alias("k"), "kc").withColumns({"c": F.col("c").cast("long"), "kc": F.col("kc").cast("double")})
    each = settle(each, "refined")
    cuts = settle(mine.told(each.select("node", "c", "r"), cut, "node long, r long, cut double"), "cut")
    state = each.join(cuts.select("node", F.col("cut").alias("wc")), "node", "left").withColumn("wc", F.coalesce("wc", F.lit(0.0)))
    state = settle(state.select("node", "r", "c", "k", "kc", enough("wc", "k").alias("bound")), "refined")
    unsettle(each)
    for t in range(turns):
        if t:
            cuts = settle(mine.told(state.select("node", "c", "r"), cut, "node long, r long, cut double"), "cut")
        parts = state.groupBy("r").agg(F.sum("k").alias("kr"), F.first("kc").alias("kc"), F.count("*").alias("n"))
        leaves = lambda c: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(t)), F.lit(2)) == 0  # noqa: B023, E731
        parts = parts.join(cuts.groupBy("r").agg(F.sum("cut").alias("cut")), "r").withColumn("alone", F.col("n") == 1)
        parts = parts.select("r", "kr", "alone", ((~F.col("alone") | ~leaves("r")) & enough("cut", "kr")).alias("opened"))
        who = state.join(parts, "r", "left").select("node", "c", "r", F.coalesce("kr", F.lit(0.0)).alias("kr"), F.coalesce("opened", F.lit(False)).alias("opened"), (F.coalesce("alone", F.lit(False)) & F.col("bound") & leaves("node")).alias("mover"))
        goes = mine.told(who, drawn(t), "node long, to long")
        before, state = state, settle(state.join(goes, "node", "left").withColumn("r", F.coalesce("to", "r")).drop("to"), "refined")
        unsettle(before, cuts)
    if blocks is None:
        mine.drop()
    return state.select("node", "r")


def _merged(blocks: Blocks, fine: DataFrame) -> DataFrame:
    """``a``, ``b``, ``w``: the edges between parts (``node``, ``r``), loops among them."""

    def run(block: Block, known: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        _, a, b, w = block
        names, code = np.unique(known["r"], return_inverse=True)
        x, y, s = _summed(code[a], code[b], w, len(names))
        return {"a": names[x], "b": names[y], "w": s}

    return blocks.told(fine, run, "a long, b long, w double").groupBy("a", "b").agg(F.sum("w").alias("w"))


def leiden(edges: DataFrame, gamma: float = 1.0, levels: int = 3, turns: int = 8, tolerance: float = 1e-4, seed: int = 0, randomness: float = 0.05) -> DataFrame:
    """``node``, ``level``, ``community`` of a hierarchy; needs ``src``, ``dst``, ``weight``.

    A level moves nodes for ``turns`` turns or until none moves, and cuts
    communities into connected parts; if it ended under the modularity that it
    began with, its beginning stands. Then every community is refined into
    well-connected parts, which become the nodes of the next level; that one
    starts from the communities, not from the parts. It ends after ``levels``
    levels, or with the first that gains less than ``tolerance``. So every community
    is connected and no level has less modularity than the one before.

    Directions and repeated edges add up, loops keep weight inside a
    community, edges with a null end are left out. The same seed gives the
    same result. An empty table gives an empty result.
    """
    given = edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.coalesce(F.sum("weight").cast("double"), F.lit(0.0)).alias("w"))
    given = settle(given, "leiden")
    names = given.select(F.col("src").alias("name")).union(given.select("dst")).distinct()
    base = settle(names.select("name", F.xxhash64("name").alias("id")), "leiden")
    e = given.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"), "w")
    level = e.union(e.select("b", "a", "w"))  # a pair may be there twice, blocks add it up
    m = (level.agg(F.sum("w")).first()[0] or 0.0) / 2
    place = base.select("name", F.col("id").alias("node"))
    part = settle(level.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).select("node", F.col("node").alias("c"), "k"), "leiden")
    out, before = None, -1.0
    for n in range(levels):
        start, quiet = part, 0
        # the parts of communities have these communities' modularity
        began = before if n else _quality(level.where("a = b").agg(F.sum("w")).first()[0] or 0.0, start, m, gamma) if m else 0.0
        now = began
        if m:
            blocks = Blocks(level)
            unsettle(level if n else given)
            for t in range(turns):
                last, part = part, settle(_turned(blocks, part.select("node", "c", "k"), m, gamma, seed + n * turns + t), "leiden")
                if last is not start:
                    unsettle(last)
                quiet = 0 if part.where("moved").head(1) else quiet + 1
                if quiet == 3:  # each time another half of the nodes could have moved
                    break
            cut, inside = _connected(blocks, part)
            part = settle(cut, "leiden")
            now = _quality(inside, part, m, gamma)
        if now < began:
            part, now = start, began
        gained, before = now - before, now
        one = place.join(part.select("node", "c"), "node").select(F.col("name").alias("node"), F.lit(n).alias("level"), F.col("c").alias("community"))
        out = one if out is None else out.unionByName(one)
        if n + 1 == levels or not m or gained < tolerance:
            break
        fine = settle(_refined(level, part, m, gamma, REFINE, seed + n, randomness, blocks), "leiden")
        place = settle(place.join(fine, "node").select("name", F.col("r").alias("node")), "leiden")
        up = settle(part.join(fine, "node").groupBy(F.col("r").alias("node")).agg(F.first("c").alias("c"), F.sum("k").alias("k")), "leiden")
        level = settle(_merged(blocks, fine), "leiden")
        blocks.drop()
        part = up
    if m:
        blocks.drop()
    return out


def modularity(edges: DataFrame, members: DataFrame, gamma: float = 1.0) -> DataFrame:
    """``level``, ``communities``, ``modularity`` of every level of ``members`` (``node``, ``level``, ``community``) over ``src``, ``dst``, ``weight``.

    Loops count as weight inside their community; edges with an end that a level does not hold are left out of it.
    """
    at = [members.select(F.col("node").alias(end), F.col("level"), F.col("community").alias(f"c_{end}")) for end in ("src", "dst")]
    e = edges.where("src is not null and dst is not null").select("src", "dst", F.col("weight").cast("double").alias("w")).join(at[0], "src").join(at[1], ["dst", "level"])
    both = e.select("level", F.explode(F.array("c_src", "c_dst")).alias("c"), "w", F.when(F.col("c_src") == F.col("c_dst"), F.col("w")).otherwise(0.0).alias("inside"))
    one = both.groupBy("level", "c").agg(F.sum("w").alias("d"), F.sum("inside").alias("inside"))  # each edge twice
    all_ = one.groupBy("level").agg(F.count("*").alias("communities"), F.sum("d").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("d") ** 2).alias("d2"))
    return all_.select("level", "communities", F.round(F.try_divide("inside", "m2") - gamma * F.try_divide("d2", F.col("m2") ** 2), 9).alias("modularity"))


#: Edges of one bucket, if the session asks for fewer buckets.
BUCKET = 1_000_000


def numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id``, ``name`` of all ends, numbered in the order of their names, and ``pairs`` (``x``, ``y``) with numbers for names."""
    ends = pairs.select(F.col("x").alias("name")).union(pairs.select("y")).distinct()
    names = settle(ends.orderBy("name").select(F.monotonically_increasing_id().alias("id"), "name"), "names")  # written, so numbers stay
    for end in ("x", "y"):
        pairs = pairs.join(names.select(F.col("id").alias("_id"), F.col("name").alias(end)), end).drop(end).withColumnRenamed("_id", end)
    return names, pairs


class Bucketed:
    """Directed edges (``a``, ``b``) as a table in buckets of ``b``: what nodes say meets them each turn without a shuffle of edges."""

    def __init__(self, edges: DataFrame, rows: int) -> None:
        self.spark, self.name = edges.sparkSession, f"edges_{uuid.uuid4().hex}"
        self.n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET))
        path = f"{scratch_dir(self.spark).rstrip('/')}/{self.name}"
        edges.repartition(self.n, "b").write.bucketBy(self.n, "b").option("path", path).saveAsTable(self.name)
        self.edges = self.spark.table(self.name)
        self.edges._settled_at = path

    def said(self, nodes: DataFrame) -> DataFrame:
        """Edges with the columns of the node (``b``) that speaks; nodes are few against edges."""
        return self.edges.join(nodes.hint("shuffle_hash"), "b")

    def drop(self) -> None:
        """Remove the table; no plan may read it any more."""
        self.spark.sql(f"DROP TABLE {self.name}")
        unsettle(self.edges)


def overlapping(edges: DataFrame, turns: int = 10, least: float = 0.2) -> DataFrame:
    """``node``, ``label``, ``share``: labels that speaker-listener propagation leaves a node with at least ``least`` of the time.

    Each turn every neighbour says one label of its memory, drawn by a hash of
    speaker, listener and turn, and the listener keeps the one it heard most.
    A memory has one label more each turn, so all draws are made before the
    first one, and edges hold numbers only. A turn shuffles what was said, by listener.
    """
    given = edges.where("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    given = settle(given, "sllpa")
    draw = lambda a, b, t: (F.pmod(F.xxhash64(a, b, F.lit(t)), F.lit(t + 1)) + 1).cast("short")
    draws = [draw("x", "y", t).alias(f"p{t}") for t in range(turns)] + [draw("y", "x", t).alias(f"q{t}") for t in range(turns)]
    rows = given.count()
    names, pairs = numbered(given.select("x", "y", *draws))
    pairs = settle(pairs, "sllpa")
    one = lambda a, b, p: pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), *[F.col(f"{p}{t}").alias(f"d{t}") for t in range(turns)])
    table = Bucketed(one("x", "y", "p").union(one("y", "x", "q")), 2 * rows)
    unsettle(given, pairs)
    memory = settle(names.select(F.col("id").alias("b"), F.array(F.struct("id", "name")).alias("memory")), "sllpa")
    for t in range(turns):
        # labels go by their hash of the turn first, as ties do
        known = memory.select("b", F.transform("memory", lambda x: F.struct(F.xxhash64(x["name"], F.lit(t)).alias("h"), x["id"].alias("id"))).alias("labels"))  # noqa: B023
        said = table.said(known).select("a", F.element_at("labels", F.col(f"d{t}").cast("int")).alias("s")).select("a", "s.h", "s.id")
        counts = said.repartition(table.n, "a").groupBy("a", "h", "id").agg(F.count("*").alias("n"))  # once by listener, for both aggregates
        heard = counts.groupBy("a").agg(F.min(F.struct(-F.col("n"), "h", "id"))["id"].alias("id"))
        heard = heard.join(names, "id").select(F.col("a").alias("b"), F.struct("id", "name").alias("label"))
        before, memory = memory, settle(memory.join(heard, "b").select("b", F.array_append("memory", F.col("label")).alias("memory")), "sllpa")
        unsettle(before)
    table.drop()
    one = memory.select(F.col("b").alias("id"), F.size("memory").alias("n"), F.explode("memory.name").alias("label")).groupBy("id", "label").agg((F.count("*") / F.first("n")).alias("share"))
    return one.where(F.col("share") >= least).join(names, "id").select(F.col("name").alias("node"), "label", "share")


def ranked(membership: DataFrame, mentions: DataFrame) -> DataFrame:
    """``community``, ``community_rank``: distinct chunks that mention a member (``node``)."""
    j = membership.select(F.col("node").alias("entity_id"), "community").join(mentions, "entity_id")
    return j.groupBy("community").agg(F.count_distinct("chunk_id").alias("community_rank"))
