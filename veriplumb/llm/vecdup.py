"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors of a label are one node. Nodes of a label with more than ``WHOLE`` are first told apart by sketches, the sides
of random planes that they lie on: nodes that share a sketch and are in range are of one group, groups are united, and
nodes of a group of their own, which link with nothing, go no further. Groups, several small ones together, take the
label's place in what follows. A node's home is the shard of its nearest centre, and it visits every earlier shard
that could be home to a vector in its range, so each pair in range meets in the earlier of its two homes and counts there.
Centres that would make nodes visit more shards than they save are left out; a group of near copies has one.
Each shard builds a flat graph: nodes are inserted by a greedy search from the medoid, and their neighbours pruned
robustly, so that some links stay long. The shards' adjacency lists are united per node. Then each node searches greedily
from the medoid, and the search expands through all it finds in range. Every pair in range is verified in double
precision, and an exact check of each shard's pairs follows, which adds links that the graph has missed; a shard whose
nodes have more links than a beam holds, by a sample, is compared in blocks only. Labels told apart by sketches audit a sample against all
their nodes; a label that missed a link is compared in blocks as a whole.

A shard over ``SHARD`` nodes is split into blocks, and each two blocks are one graph: no task holds more than two blocks,
and no pair is lost. Pairs never leave a task, just the number of each node's links and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import record, small_side, staged

SHARD = 3000
#: Nodes of a label from which on it has centres, nodes per centre, vectors that centres are fitted on (over all labels,
#: chosen by hash), and centres of a label, at most.
WHOLE, PER_CENTRE, FITTED, CENTRES = 1500, 750, 20_000, 4096
#: Vectors of a label that the number of its centres is chosen by.
WEIGHED = 2000
DEGREE, BEAM, ALPHA = 16, 32, 1.2
#: Nodes that tell whether a shard is crowded, and that a label audits which is apart by sketches (about as many, by hash; fewer
#: if all labels' would be over ``ASKED``, but one).
AUDITED, ASKED = 64, 20_000
#: Chance that a pair at the limit shares no sketch, numbers that the vectors of a block hold, and nodes that share a sketch
#: from which on they are compared by matrix products.
LOST, HELD, RUN = 1e-6, 1 << 22, 32


def in_reach(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Boolean a x b: unit vectors whose cosine is ``least`` or more. A matrix product decides but for pairs at the limit;
    these are summed one by one, so that a pair is judged alike in any block, and either way round."""
    s = a @ b.T
    hit = s >= least
    u, v = np.nonzero(np.abs(s - least) < 1e-9)
    hit[u, v] = np.einsum("pd,pd->p", a[u], b[v]) >= least
    return hit


def beam_search(x: np.ndarray, near: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of all queries at once: ids and cosines of the best ``beam`` nodes of each."""
    q = len(queries)
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -np.inf, np.float32)
    done = np.zeros((q, beam), bool)
    seen = np.zeros((q, len(x)), bool)
    ids[:, 0], sims[:, 0], seen[:, start] = start, queries @ x[start], True
    while True:
        open_ = np.where(done | (ids < 0), -np.inf, sims)
        best = open_.argmax(axis=1)
        active = np.flatnonzero(open_[np.arange(q), best] > -np.inf)
        if not len(active):
            return ids, sims
        done[active, best[active]] = True
        around = near[ids[active, best[active]]]
        fresh = (around >= 0) & ~seen[active[:, None], around]
        seen[np.repeat(active, fresh.sum(1)), around[fresh]] = True
        found = np.matmul(x[around], queries[active][:, :, None])[:, :, 0]
        found[~fresh] = -np.inf
        all_sims = np.concatenate([sims[active], found], axis=1)
        all_ids = np.concatenate([ids[active], np.where(fresh, around, -1)], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        rows = np.arange(len(active))[:, None]
        ids[active], sims[active], done[active] = all_ids[rows, order], all_sims[rows, order], all_done[rows, order]


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours for each node: the nearest candidate, then the next that no chosen one covers by ``alpha``, and so on."""
    vectors = x[candidates]
    own = 2 - 2 * np.matmul(vectors, x[nodes][:, :, None])[:, :, 0]
    alive = (candidates >= 0) & (candidates != nodes[:, None])
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        left = np.where(alive, own, np.inf)
        best = left.argmin(axis=1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        out[some, k] = candidates[rows, best][some]
        between = 2 - 2 * np.matmul(vectors, vectors[rows, best][:, :, None])[:, :, 0]
        alive &= ~(alpha * alpha * between <= own)
        alive &= candidates != out[:, k][:, None]
    return out


def _add_reverse(x: np.ndarray, near: np.ndarray, to: np.ndarray, frm: np.ndarray) -> None:
    """Adds ``frm`` to the lists of ``to``, and prunes lists that get too long."""
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    nodes, starts, counts = np.unique(to, return_index=True, return_counts=True)
    for least, most in ((1, 8), (9, 32), (33, len(to))):  # lists of like length together
        own = np.flatnonzero((counts >= least) & (counts <= most))
        if not len(own):
            continue
        place = np.arange(counts[own].max())[None]
        new = np.where(place < counts[own][:, None], frm[np.minimum(starts[own][:, None] + place, len(frm) - 1)], -1)
        had = near[nodes[own]]
        new[(new[:, :, None] == had[:, None, :]).any(axis=2)] = -1
        both = np.concatenate([had, new], axis=1)
        short = (both >= 0).sum(axis=1) <= near.shape[1]
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, : near.shape[1]]
        near[nodes[own[short]]] = packed[short]
        if not short.all():
            near[nodes[own[~short]]] = robust_prune(x, nodes[own[~short]], both[~short])


def build(x: np.ndarray, seed: int = 5) -> tuple[np.ndarray, int]:
    """Adjacency (nodes x DEGREE, -1 for none) and medoid."""
    n = len(x)
    rng = np.random.default_rng(seed)
    near = np.full((n, DEGREE), -1, np.int64)
    medoid = int((x @ x.mean(axis=0)).argmax())
    if n > 1:
        start = min(DEGREE // 2, n - 1)
        near[:, :start] = (np.arange(n)[:, None] + rng.integers(1, n, (n, start))) % n
    order = rng.permutation(n)
    for a in range(0, n, 128):
        batch = order[a : a + 128]
        ids, _ = beam_search(x, near, medoid, x[batch], BEAM)
        near[batch] = robust_prune(x, batch, np.concatenate([ids, near[batch]], axis=1))
        to, frm = near[batch], np.repeat(batch, DEGREE).reshape(-1, DEGREE)
        to, frm = to[to >= 0], frm[to >= 0]
        _add_reverse(x, near, to, frm)
    return near, medoid


def in_range(x: np.ndarray, exact: np.ndarray, near: np.ndarray, medoid: int, least: float, slack: float = 0.01) -> np.ndarray:
    """Boolean nodes x nodes: pairs that the range-expanding search has found, verified in double precision."""
    n = len(x)
    found = np.zeros((n, n), bool)
    for a in range(0, n, 128):
        q = np.arange(a, min(n, a + 128))
        ids, sims = beam_search(x, near, medoid, x[q], BEAM)
        close = (sims >= least - slack) & (ids >= 0)
        seen = np.zeros((len(q), n), bool)  # nodes that fell off the beam are looked at again
        seen[np.nonzero(close)[0], ids[close]] = True
        owner, node = np.nonzero(close)[0], ids[close]
        while len(owner):
            found[q[owner], node] = True
            around = near[node]
            keys = (owner[:, None] * n + around)[around >= 0]
            keys = np.unique(keys)
            keys = keys[~seen.ravel()[keys]]
            seen.ravel()[keys] = True
            owner, node = keys // n, keys % n
            near_enough = np.concatenate([np.einsum("pd,pd->p", x[q[owner[b : b + 50_000]]], x[node[b : b + 50_000]]) for b in range(0, len(owner), 50_000)] or [np.zeros(0)]) >= least - slack
            owner, node = owner[near_enough], node[near_enough]
    for a in range(0, n, 256):
        found[a : a + 256] &= in_reach(exact[a : a + 256], exact, least)
    np.fill_diagonal(found, False)
    return found | found.T


def _forest(links: np.ndarray) -> np.ndarray:
    """Least node of each node's component."""
    root = np.full(len(links), -1)
    for first in range(len(links)):
        front = np.array([first] if root[first] < 0 else [], int)
        while len(front):
            root[front] = first
            front = np.flatnonzero(links[front].any(axis=0) & (root < 0))
    return root


def _all_pairs(exact: np.ndarray, least: float) -> np.ndarray:
    """Boolean nodes x nodes: all pairs in range, compared in blocks."""
    links = np.empty((len(exact), len(exact)), bool)
    for a in range(0, len(exact), 256):
        links[a : a + 256] = in_reach(exact[a : a + 256], exact, least)
    np.fill_diagonal(links, False)
    return links


def _audit(exact: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A seeded sample of nodes, and boolean sample x nodes: their true links."""
    sample = np.random.default_rng(9).permutation(len(exact))[:AUDITED]
    true = in_reach(exact[sample], exact, least)
    true[np.arange(len(sample)), sample] = False
    return sample, true


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one. The largest component goes first, so that no square is out of range."""
    x = raw / np.abs(raw).max(axis=1, keepdims=True, initial=0) + 0.0
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def sketch_size(n: int, d: int, least: float) -> tuple[int, int]:
    """Planes of a sketch, and sketches: the cheapest by which a pair at ``least`` shares none with a chance of ``LOST`` at
    most. No sketches where comparing all ``n`` nodes costs less. Costs are measured nanoseconds a node."""
    same = 1 - np.arccos(np.clip(least, -1, 1)) / np.pi
    best = (0.033 * d * n, 0, 0)
    for bits in range(1, 25):
        share = min(same**bits, 1 - 1e-9)
        tables = max(1, int(np.ceil(np.log(LOST) / np.log1p(-share)))) if share > 1e-6 else 1 << 30
        best = min(best, (tables * (0.05 * d * bits + 150 + 100 * n * 0.5**bits), bits, tables))
    return best[1:]


def _joined(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``group``, the least node of each node's group, after linking ``a`` with ``b``."""
    while True:
        u, v = group[a], group[b]
        apart = u != v
        if not apart.any():
            return group
        np.minimum.at(group, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while not np.array_equal(up := group[group], group):
            group = up


def _compared(x: np.ndarray, nodes: np.ndarray, group: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """``group`` after comparing all of ``nodes`` that are not of one group already, and the number of products."""
    left, y, work = nodes, x[nodes], 0
    while True:
        kinds, counts = np.unique(group[nodes], return_counts=True)
        left = left[group[left] != kinds[counts.argmax()]]  # those of the largest meet the rest as the rest's partners
        if not len(left):
            return group, work
        some, left = left[:256], left[256:]
        i, j = np.nonzero((x[some] @ y.T >= least) & (group[some][:, None] != group[nodes]))
        group, work = _joined(group, some[i], nodes[j]), work + len(some) * len(nodes)


def close_groups(x: np.ndarray, least: float, seed: int = 11) -> np.ndarray:
    """Least node of each node's group: nodes of unit vectors (single precision) that chains of pairs in range connect.

    Pairs that share a sketch are compared, all of them, but for those that others have put into one group. If sketches
    save nothing, as where all vectors point one way, all nodes are compared.
    """
    n, d = x.shape
    group, least, spent = np.arange(n), least - 1e-4, 0
    bits, tables = sketch_size(n, d, least)
    rng = np.random.default_rng(seed)
    for _ in range(tables):
        sides = x @ rng.standard_normal((d, bits)).astype(np.float32) > 0
        code = np.zeros(n, np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits):
            code |= sides[:, k].astype(code.dtype) << code.dtype.type(k)
        order = np.argsort(code, kind="stable")
        code = code[order]
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        sizes = np.diff(np.append(starts, n))
        place = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= RUN), sizes))
        for gap in range(1, RUN):
            place = place[place + gap < n]
            place = place[code[place + gap] == code[place]]
            if not len(place):
                break
            a, b = order[place], order[place + gap]
            apart = group[a] != group[b]
            a, b = a[apart], b[apart]
            hit = np.concatenate([np.einsum("pd,pd->p", x[a[c : c + 50_000]], x[b[c : c + 50_000]]) for c in range(0, len(a), 50_000)] or [np.zeros(0)]) >= least
            group, spent = _joined(group, a[hit], b[hit]), spent + 32 * len(a)
        for k in np.flatnonzero(sizes > RUN):
            group, work = _compared(x, order[starts[k] : starts[k] + sizes[k]], group, least)
            spent += work
        if spent > n * n:
            break
    else:
        if tables:
            return group
    return _compared(x, np.arange(n), group, least)[0]


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = t.column("vector").combine_chunks().flatten().to_numpy().astype(np.float64)
    return t.column("node").to_numpy(), unit(flat.reshape(t.num_rows, -1))


GRAPH = pa.schema([("node", pa.int64()), ("neighbours", pa.list_(pa.int64()))])
LINKS = pa.schema([("label", pa.int64()), ("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("way", pa.string()), ("audited", pa.int64()), ("missed", pa.int64())])
TRUE = pa.schema([("label", pa.int64()), ("node", pa.int64()), ("true", pa.int64())])
ROOTS = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def _build(least: float):
    def build_graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        if t.num_rows:
            node, exact = _columns(t := t.sort_by("node"))
            crowded = _audit(exact, least)[1].sum() > BEAM * min(AUDITED, len(node))
            near = np.zeros((len(node), 0), np.int64) if crowded else build(exact.astype(np.float32))[0]
            yield record(GRAPH, node, [node[r[r >= 0]].tolist() for r in near])

    return build_graph


def _search(least: float, whole: bool = False):
    """Links of a shard's two blocks; ``whole`` compares them without a graph."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        if not t.num_rows:
            return
        node, exact = _columns(t := t.sort_by("node"))
        sample, true = _audit(exact, least)
        way, missed = "blocks", 0
        if whole or true.sum() > BEAM * len(sample):  # crowded: a search would look at most pairs anyway
            links = _all_pairs(exact, least)
        else:
            x = exact.astype(np.float32)
            at = {k: i for i, k in enumerate(node.tolist())}
            lists = [[at[k] for k in ks if k in at] for ks in t.column("neighbours").to_pylist()]
            near = np.full((len(node), max(1, max(map(len, lists)))), -1, np.int64)
            for i, ks in enumerate(lists):
                near[i, : len(ks)] = ks
            found = in_range(x, exact, near, int((x @ x.mean(axis=0)).argmax()), least)
            way, links = "graph", _all_pairs(exact, least)  # a sample alone leaves links of other nodes missed
            true, missed = links, int((links & ~found).sum())
        root = _forest(links)
        label, shard, low, high = (t.column(c)[0].as_py() for c in ("label", "shard", "low", "high"))
        home, side, copies = (t.column(c).to_numpy() for c in ("home", "side", "copies"))
        count = np.zeros(len(node), np.int64)
        for a in range(0, len(node), 256):
            s = slice(a, a + 256)
            own = links[s] & (np.minimum(home[s, None], home) == shard)
            own &= (np.minimum(side[s, None], side) == low) & (np.maximum(side[s, None], side) == high)
            count[s] = np.where(own, copies, 0).sum(axis=1)
        first = np.arange(len(node)) == 0  # a block's figures are told once
        yield record(LINKS, np.full(len(node), label), node, count, node[root], [way, *[None] * (len(node) - 1)], first * int(true.sum()), first * missed)

    return search


def _truth(asked, least: float):
    """Links that the nodes asked for, by label, have with the nodes of a task."""

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true = {label: np.zeros(len(node), np.int64) for label, (node, _) in asked.value.items()}
        for b in batches:
            labels = b.column("label").to_numpy()
            for label in set(labels.tolist()) & set(true):
                t = pa.Table.from_batches([b.filter(pa.array(labels == label))])
                (node, x), copies = _columns(t), t.column("copies").to_numpy()
                found = in_reach(asked.value[label][1], x, least) & (asked.value[label][0][:, None] != node)
                true[label] += np.where(found, copies, 0).sum(axis=1)
        for label, n in true.items():
            yield record(TRUE, np.full(len(n), label), asked.value[label][0], n)

    return truth


def _sketched(least: float):
    """``node, root`` of the nodes of two blocks that have others in their group."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        if t.num_rows:
            node, x = _columns(t.sort_by("node"))
            del t
            group = close_groups(x.astype(np.float32), least)
            some = np.bincount(group, minlength=len(node))[group] > 1
            yield record(ROOTS, node[some], node[group[some]])

    return sketched


def groups_of(nodes: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """``node, root`` for the nodes of labels in ``sizes`` (``label, n, d``) that have others in their group."""
    cut = F.ceil(F.col("n") * F.col("d") / HELD).cast("int")
    own = nodes.select("label", "node", "vector").join(small_side(sizes.select("label", cut.alias("sides"))), "label")
    own = own.withColumn("side", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("sides")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    own = own.select("label", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "node", "vector")
    roots = staged(own.groupBy("label", "low", "high").applyInArrow(_sketched(least), "node long, root long"))
    if sizes.filter(cut > 1).isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))


def cells(x: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each unit vector, its nearest centre, and boolean vectors x centres: the shards it goes to.

    Let u in range of v, an angle of at most arccos(least) away, and v nearest to the centre c. Then v lies on c's side of
    the plane halfway to u's home h, and u at most that angle beyond it: u (h - c) <= sqrt(1 - least^2) |h - c|. So u
    goes to each such c before h. If v's home is later than u's, v comes to u's.
    """
    reach = np.sqrt(max(0.0, 1 - least * least)) if least > 0 else 1.0
    s = x @ c.T
    home = s.argmax(axis=1)
    square = (c * c).sum(axis=1)
    gap = np.sqrt(np.maximum(0, square[home][:, None] + square - 2 * (c @ c.T)[home]))
    goes = s[np.arange(len(x)), home][:, None] - s <= reach * gap + 1e-6
    return home, goes & (np.arange(len(c)) <= home[:, None])


def thinned(x: np.ndarray, c: np.ndarray, n: int, least: float) -> np.ndarray:
    """Those of a label's centres that leave its ``n`` nodes the fewest places in tasks, judged by the vectors ``x``.

    Centres are taken farthest first, so that those of one group of near copies come last but for one. The shard with
    the most homes becomes the first, whose nodes go nowhere else.
    """
    x = x[:: -(-len(x) // WEIGHED)]
    order = [int(np.bincount(np.einsum("nd,cd->nc", x, c).argmax(axis=1)).argmax())]
    near = np.full(len(c), -np.inf)
    while len(order) < len(c):
        near = np.maximum(near, np.einsum("cd,d->c", c, c[order[-1]]))
        near[order[-1]] = np.inf
        order.append(int(near.argmin()))
    best, least_cost, k = c[order[:1]], np.inf, 1
    while True:
        some = c[order[:k]]
        some = some[np.argsort(-np.bincount(np.einsum("nd,cd->nc", x, some).argmax(axis=1), minlength=k), kind="stable")]
        size = cells(x, some, least)[1].sum(axis=0) * (n / len(x))
        cost = (size * np.maximum(1, size / SHARD)).sum()
        if cost < least_cost:
            best, least_cost = some, cost
        if k == len(c):
            return best
        k = min(len(c), max(k + 1, int(k * 1.3)))


def centres_of(nodes: DataFrame, least: float) -> dict[int, np.ndarray]:
    """Centres of each label with more than ``WHOLE`` nodes, by a few rounds of k-means on a sample chosen by hash,
    if more than one is worth it."""
    big = {r["label"]: r["n"] for r in nodes.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > WHOLE).collect()}
    if not big:
        return {}
    total = sum(big.values())
    share = min(1.0, FITTED / total)
    rows = nodes.filter(F.col("label").isin(list(big)) & (F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)).select("label", "node", "vector").limit(2 * FITTED).collect()
    out = {}
    for label, n in big.items():
        x = np.array([r["vector"] for r in sorted(rows, key=lambda r: r["node"]) if r["label"] == label], float)
        if not len(x):
            continue
        x = unit(x)
        c = x[:: max(1, len(x) // min(CENTRES, -(-n // PER_CENTRE)))][: min(CENTRES, -(-n // PER_CENTRE))].copy()
        for _ in range(5):
            home = np.einsum("nd,cd->nc", x, c).argmax(axis=1)
            for k in range(len(c)):
                if (home == k).any() and (s := x[home == k].mean(axis=0)).any():
                    c[k] = s / np.sqrt((s * s).sum())
        c = thinned(x, c, n, least)
        if len(c) > 1:
            out[label] = c
    return out


def _deal(centres, least: float):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                b = whole.slice(a, 500)
                labels = np.array(b.column("label").to_pylist())
                homes, shards = np.zeros(b.num_rows, np.int64), [[0]] * b.num_rows
                for label in set(labels.tolist()) & set(centres.value):
                    rows = np.flatnonzero(labels == label)
                    x = unit(np.array(b.column("vector").take(pa.array(rows)).to_pylist(), float))
                    homes[rows], goes = cells(x, centres.value[label], least)
                    for i, g in zip(rows.tolist(), goes, strict=True):
                        shards[i] = np.flatnonzero(g).tolist()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(homes), pa.array(shards, pa.list_(pa.int64()))], names=[*b.schema.names, "home", "shards"])

    return deal


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` of shards with ``side, low, high``: shards over ``SHARD`` nodes are cut, and each two cuts meet once."""
    sizes = small_side(members.groupBy("label", "shard").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("sides")))
    members = members.join(sizes, ["label", "shard"]).withColumn("side", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("sides")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    return members.select("label", "shard", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "copies", "home", "vector")


def short_of_links(nodes: DataFrame, links: DataFrame, sizes: DataFrame, least: float) -> list[int]:
    """Those labels in ``sizes`` with a node, of a sample by hash, that has more links among all the label's than in ``links``."""
    labels = sizes.count()
    own = nodes.join(small_side(sizes.select("label", "n")), "label")
    some = own.filter(F.pmod(F.xxhash64(F.lit(6), "node"), F.col("n")) < max(1, min(AUDITED, ASKED // labels))).select("label", "node", "vector").collect()
    asked = {}
    for r in some:
        asked.setdefault(r["label"], []).append((r["node"], r["vector"]))
    asked = {k: (np.array([n for n, _ in v]), unit(np.array([x for _, x in v], float))) for k, v in asked.items()}
    true = own.select("label", "node", "copies", "vector").mapInArrow(_truth(nodes.sparkSession.sparkContext.broadcast(asked), least), "label long, node long, true long")
    true = small_side(true.groupBy("label", "node").agg(F.sum("true").alias("true")))
    have = links.join(true, "node").groupBy("node").agg(F.max("links").alias("links"))
    return [r["label"] for r in true.join(have, "node", "left").filter(F.col("true") > F.coalesce("links", F.lit(0))).select("label").distinct().collect()]


def near_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", audit: list | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``.

    Vectors link if their labels are equal and not null, and their cosine is ``least`` or more. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing; vectors of other dimensions than their
    label's link among their own. Repeated rows are vectors of their own, linked to one another; null ids link, but a
    component's id is its least id, null only if it has none; no rows give no rows; other columns are ignored.

    To the list ``audit`` go a row for each way in which groups were searched (``graph``, ``blocks`` for crowded ones):
    groups, true links of checked nodes, and links that the graph had missed of them; and one of labels that were
    compared in blocks as a whole.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    vector = F.col(f"`{vector_col}`").cast(kind if kind == "array<float>" else "array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label0"), vector.alias("vector"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()))
    whole = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0) & F.col("label0").isNotNull()
    sound = rows.filter(whole).withColumn("label", F.xxhash64(F.struct(F.col("label0").cast("string"), F.size("vector").cast("string"))))
    largest = F.array_max(F.transform("vector", lambda c: F.abs(c).cast("double")))
    scaled = F.transform(F.array(largest), lambda m: F.transform("vector", lambda c: c / m + 0.0))  # in a list, so as to be computed once
    digest = F.transform(scaled, lambda v: F.struct(F.xxhash64(F.lit(1), v), F.xxhash64(F.lit(2), v)))
    keyed = staged(sound.select("row", "vec_id", "label", F.size("vector").alias("d"), digest.alias("digest")).withColumn("digest", F.col("digest")[0]))
    same = ["label", "digest"]
    equal = staged(keyed.groupBy(*same).agg(F.min("row").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("d").alias("d")))
    repeated = small_side(keyed.join(small_side(equal.filter("copies > 1")), same).select("row", "node", "copies"))
    nodes = sound.join(repeated, "row", "left").filter("node is null or node = row").select("label", F.col("row").alias("node"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "vector")
    nodes = staged(nodes)
    sizes = staged(equal.groupBy("label").agg(F.count("*").alias("n"), F.first("d").alias("d")).filter(F.col("n") > WHOLE))
    some, sketched = nodes, not sizes.isEmpty()
    if sketched:
        roots = groups_of(nodes, sizes, least)
        per = small_side(roots.join(equal.select("label", "node"), "node").groupBy("label").agg(F.ceil(F.count("*") / WHOLE).alias("parts")))
        close = nodes.join(small_side(roots), "node").join(per, "label")
        close = close.select(F.xxhash64("label", F.pmod(F.xxhash64(F.lit(2), "root"), "parts")).alias("label"), "node", "copies", "vector")
        some = staged(nodes.join(small_side(sizes.select("label")), "label", "left_anti").select(*close.columns).unionByName(close))
    fitted = centres_of(some, least)
    centres = nodes.sparkSession.sparkContext.broadcast(fitted)
    dealt = staged(some.select("label", "vector", "node", "copies").mapInArrow(_deal(centres, least), f"label long, vector {rows.schema['vector'].dataType.simpleString()}, node long, copies long, home long, shards array<long>"))
    members = _blocks(dealt.withColumn("shard", F.explode("shards")))
    group, schema = ["label", "shard", "low", "high"], "label long, node long, links long, root long, way string, audited long, missed long"
    graphs = staged(members.groupBy(*group).applyInArrow(_build(least), "node long, neighbours array<long>"))
    united = graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    found = staged(members.join(united, "node").groupBy(*group).applyInArrow(_search(least), schema))
    if audit is not None:
        audit += [r.asDict() for r in found.filter("way is not null").groupBy("way").agg(F.count("*").alias("groups"), F.sum("audited").alias("audited"), F.sum("missed").alias("missed")).orderBy("way").collect()]
    short = short_of_links(nodes, found.groupBy("node").agg(F.sum("links").alias("links")), sizes, least) if sketched else []
    if audit is not None:
        audit.append({"way": "labels compared whole", "groups": len(short), "audited": sizes.count(), "missed": 0})
    if short:
        whole_label = nodes.filter(F.col("label").isin(short))
        again = _blocks(whole_label.withColumn("shard", F.lit(0).cast("long")).withColumn("home", F.lit(0).cast("long")))
        again = again.groupBy(*group).applyInArrow(_search(least, whole=True), schema)
        found = staged(found.join(whole_label.select("node"), "node", "left_anti").select(*found.columns).unionByName(again))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    comps = equal.select(*same, "node", "least", "copies").join(small_side(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    comps = staged(comps.join(small_side(links), "node", "left"))
    ids = comps.groupBy("root").agg(F.min("least").alias("component_id"))
    known = comps.join(ids, "root").select(*same, "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    per_row = keyed.join(known, same).select("row", "component_id", "n_links", F.lit(True).alias("sound"))
    out = rows.select("vec_id", "row").join(per_row, "row", "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
