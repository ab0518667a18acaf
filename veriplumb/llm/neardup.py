"""Near-duplicates by MinHash and an inverted join on signature coordinates.

Documents are sets of word shingles. Equal sets are one class at once. The signature of a class has ``COORDINATES``
minima; a class is posted under each pair of coordinate and value. Two classes are candidates if they collide in at least
``MATCHES`` coordinates. Such a pair shares a posting among the ``COORDINATES - MATCHES + 1`` rarest of either, in one
order of all postings by frequency: only those prefixes are merged; the most frequent postings are skipped, and their
collisions counted from the signatures of pairs found. Each candidate is confirmed on its full sets.

Postings of large groups give no squares of pairs: each posting first links its members to its hub, the member whose
values are the most common. Confirmed links are contracted to components. A second pass compares, in blocks, just the
members of one posting that are in different components; of the pairs with enough collisions a spanning forest leaves the
task. Its trees are clusters, whose full sets are then compared exactly, again only between components.

Of pairs with a similarity of exactly 0.8, about one in 2,800 has too few collisions, of pairs at 0.85 one in 400,000;
that is the method's only loss, and a group loses no member whose other links hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import blocks, record, scramble, small_batches, small_side, staged, text_bytes, word_hashes

COORDINATES, MATCHES = 64, 40
PREFIX = COORDINATES - MATCHES + 1
#: Members of a posting, or of a cluster, that are compared with one another at a time in the second pass.
SIDE = 1024
#: Shingles of a cluster's members that a task holds on either side, on average; a larger set is alone there.
SHINGLES = 2_000_000
#: Rows of three numbers that are broadcast, at most (about 10 MB); beyond, texts are shuffled to them.
NARROW = 400_000
_FACTOR = scramble(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFT = scramble(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than a shingle has, the whole sequence is one."""
    hashes, counts = word_hashes(*text_bytes(column))
    ends = np.cumsum(counts)
    mixed = np.zeros(len(hashes), np.uint64)
    for i in range(words):  # of a shingle that starts here, as far as the block goes
        part = hashes[i:] if i else hashes
        mixed[: len(part)] += part * (_FACTOR[i] + np.uint64(2))
    mixed = scramble(mixed)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(mixed[end - n : end - words + 1]))
        elif n:
            whole = (hashes[end - n : end] * (_FACTOR[:n] + np.uint64(2))).sum(dtype=np.uint64) + np.uint64(n)
            out.append(scramble(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    return ((shingles[:, None] ^ _SHIFT) * _FACTOR >> np.uint64(33)).min(axis=0).astype(np.int32)


SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sig", pa.list_(pa.int32()))])


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 1 << 20):
            found = shingle_sets(b.column("text"), words)
            node = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True) if len(s) else None for s in found]
            flat = np.concatenate([signature(s) for s in found if len(s)] or [np.zeros(0, np.int32)])
            sizes = np.array([COORDINATES if len(s) else 0 for s in found], np.int32)
            sig = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))
            yield record(SETS, b.column("doc_id"), b.column("text_hash"), [len(s) for s in found], node, sig)

    return sets


def _confirm(words: int, percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}  # sets of hubs, whose rows come together
        for whole in batches:
            for b in blocks([whole], "text_a", 1 << 20):
                u, v = b.column("u").to_pylist(), b.column("v").to_pylist()
                kept = {k: kept[k] for k in set(u) & set(kept)}
                first = {k: i for i, k in reversed(list(enumerate(u))) if k not in kept}
                kept |= dict(zip(first, shingle_sets(b.column("text_a").take(pa.array(list(first.values()), pa.int64())), words), strict=True))
                links = []
                for x, y, s in zip(u, v, shingle_sets(b.column("text_b"), words), strict=True):
                    common = len(np.intersect1d(kept[x], s, assume_unique=True))
                    if 100 * common >= percent * (len(kept[x]) + len(s) - common):
                        links.append((x, y))
                if links:
                    yield record(LINKS, *(list(c) for c in zip(*links, strict=True)))

    return confirm


class Forest:
    """Union-find over a few numbers; ``join`` says whether its two were apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _outside(comp: np.ndarray) -> np.ndarray:
    """Places whose component isn't the largest: one end of every pair of different components."""
    kinds, where, counts = np.unique(comp, return_inverse=True, return_counts=True)
    return np.flatnonzero(where != counts.argmax())


def _compare(matches: int):
    """For one posting, or two blocks of one: a spanning forest of the pairs of different components that collide enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        if not t.num_rows:
            return
        node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
        sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        forest, links = Forest(len(node)), []
        for i in _outside(comp).tolist():
            for j in np.flatnonzero((comp != comp[i]) & ((sig == sig[i]).sum(axis=1) >= matches)).tolist():
                if forest.join(i, j):
                    links.append((node[i], node[j]))
        if links:
            yield record(LINKS, *(list(c) for c in zip(*links, strict=True)))

    return compare


def _settle(words: int, percent: int):
    """For one cluster, or two blocks of one: links of different components by their full sets, each two components once."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        if not t.num_rows:
            return
        node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
        sets = [x for b in blocks(t.select(["text"]).to_batches(), "text", 1 << 20) for x in shingle_sets(b.column("text"), words)]
        size = np.array([len(x) for x in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(ids, kind="stable")
        by_id, starts = owner[order], np.append(0, np.cumsum(np.bincount(ids)))
        ends = np.cumsum(size)
        kinds, where = np.unique(comp, return_inverse=True)
        forest, links = Forest(len(kinds)), []
        for i in _outside(comp).tolist():
            own = ids[ends[i] - size[i] : ends[i]]
            common = np.bincount(np.concatenate([by_id[starts[x] : starts[x + 1]] for x in own.tolist()]), minlength=len(sets))
            for j in np.flatnonzero((comp != comp[i]) & (100 * common >= percent * (size + size[i] - common))).tolist():
                if forest.join(int(where[i]), int(where[j])):
                    links.append((node[i], node[j]))
        if links:
            yield record(LINKS, *(list(c) for c in zip(*links, strict=True)))

    return settle


def _sides(rows: DataFrame, group: list[str], size: str | None = None) -> DataFrame:
    """Staged ``rows`` of groups with several components (``comp``), with ``low, high`` of the block that each is dealt to.

    Groups of more than ``SIDE`` rows, or ``SHINGLES`` of the column ``size``, are cut. Cuts of the group's largest component
    meet those of all other rows, which also meet one another, each two once; they don't meet among themselves, where no
    pair is of different components. A large group with few rows outside its largest component so grows in proportion.
    """
    load = F.count("*") / SIDE if size is None else F.greatest(F.count("*") / SIDE, F.sum(size) / SHINGLES)
    kinds = rows.groupBy(*group, "comp").agg(load.alias("load"))
    most = F.max(F.struct("load", "comp"))
    large = kinds.groupBy(*group).agg(most["comp"].alias("main"), most["load"].alias("inside"), F.sum("load").alias("load")).filter("load > 1")
    large = large.select(*group, "main", F.ceil("inside").cast("int").alias("inside"), F.greatest(F.ceil(F.col("load") - F.col("inside")), F.lit(1)).cast("int").alias("outside"))
    cut = rows.join(small_side(large), group, "left")
    draw, outer = F.xxhash64(F.lit(17), "node"), F.col("comp") != F.col("main")
    side = F.when(F.col("main").isNull(), F.lit(0)).when(outer, F.pmod(draw, F.col("outside"))).otherwise(F.col("outside") + F.pmod(draw, F.col("inside")))
    last = F.when(F.col("main").isNull(), F.lit(0)).when(outer, F.col("outside") + F.col("inside") - 1).otherwise(F.col("outside") - 1)
    cut = cut.withColumn("side", side.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return cut.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("side", "other", "main", "inside", "outside")


def _texts_of(wanted: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, text`` of classes, staged: the text of one document of each."""
    one = classes.join(small_side(wanted, NARROW), "node", "left_semi").select("node", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"))
    found = texts.join(small_side(one, NARROW), texts["doc_id"].eqNullSafe(F.col("id")) & (texts["text_hash"] == F.col("hash"))).select("node", "text")
    return staged(found.groupBy("node").agg(F.first("text").alias("text")))


def _confirmed(pairs: DataFrame, texts: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets are similar enough. Texts are dealt to the pairs they are in."""
    found = _texts_of(pairs.select("u").unionAll(pairs.select("v")).distinct().withColumnRenamed("u", "node"), texts, classes)
    heads = pairs.groupBy("u").agg(F.ceil(F.count("*") / 64).cast("int").alias("parts"))  # a hub's text goes to several tasks
    dealt = pairs.join(heads, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    first = heads.join(found.select(F.col("node").alias("u"), F.col("text").alias("text_a")), "u").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("u", "part", "text_a")
    both = dealt.join(found.select(F.col("node").alias("v"), F.col("text").alias("text_b")), "v").join(first, ["u", "part"])
    return staged(both.select("u", "v", "text_a", "text_b").mapInArrow(_confirm(words, percent), "u long, v long"))


def _candidates(pairs: DataFrame, sigs: DataFrame, matches: int) -> DataFrame:
    """Distinct pairs with at least ``matches`` equal coordinates."""
    pairs = pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    a, b = sigs.select(F.col("node").alias("u"), F.col("sig").alias("a")), sigs.select(F.col("node").alias("v"), F.col("sig").alias("b"))
    equal = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda same: same))
    return staged(pairs.join(a, "u").join(b, "v").filter(equal >= matches).select("u", "v"))


def _classes(sets: DataFrame) -> DataFrame:
    """One row a digest of a set; where its sets differ in size or signature, so do ``check_least`` and ``check_most``."""
    check = F.xxhash64("n_shingles", "sig")
    grouped = sets.filter("node is not null").groupBy("node")
    return staged(grouped.agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("sig").alias("sig"), F.count("*").alias("copies"),
        F.max("n_shingles").alias("n_shingles"), F.min(check).alias("check_least"), F.max(check).alias("check_most"),
    ))


def _grouped(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_hash, n_shingles, node`` of each row, and ``node, root, component_id`` of nodes with copies or links."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sets = staged(texts.mapInArrow(_sets(words), "doc_id long, text_hash long, n_shingles long, node long, sig array<int>"))
    classes = _classes(sets)
    clashing = classes.filter("check_least <> check_most").select("node")
    if not clashing.isEmpty():  # sets of one digest that aren't equal: of 10^10 sets, two or three
        marked = sets.join(small_side(clashing).withColumn("clash", F.lit(True)), "node", "left")
        sets = staged(marked.withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "n_shingles", "sig")).otherwise(F.col("node"))).drop("clash"))
        classes = _classes(sets)
    sigs = classes.select("node", "sig")
    posted = sigs.select("node", F.posexplode("sig").alias("coordinate", "value"))
    # staged, so that the join has two plain sides and Spark can split a hot posting
    often = staged(posted.groupBy("coordinate", "value").agg(F.count("*").alias("df")).filter("df > 1"))
    ranked = posted.join(often, ["coordinate", "value"]).groupBy("node").agg(F.array_sort(F.array_agg(F.struct("df", "coordinate", "value"))).alias("p"))
    # postings of one document alone come first in the order: they fill the prefix and give no pair
    short = F.greatest(F.lit(0), F.lit(PREFIX) - (F.lit(COORDINATES) - F.size("p")))
    centre = F.aggregate("p", F.lit(0.0), lambda s, x: s + F.log(x["df"].cast("double")))
    prefix = ranked.select("node", centre.alias("centre"), F.slice("p", F.lit(1), short).alias("p")).select("node", "centre", F.explode("p").alias("p"))
    prefix = staged(prefix.select("p.coordinate", "p.value", "node", "centre"))
    hubs = prefix.groupBy("coordinate", "value").agg(F.max(F.struct("centre", "node"))["node"].alias("hub"), F.count("*").alias("members")).filter("members > 1")
    hubs = staged(hubs)
    stars = prefix.join(hubs, ["coordinate", "value"]).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    first = _confirmed(_candidates(stars, sigs, MATCHES), texts, classes, words, percent)
    joined = components(first)
    # second pass: postings of three or more members that the stars have left in several components
    members = prefix.join(hubs.filter("members > 2").select("coordinate", "value"), ["coordinate", "value"]).join(small_side(joined), "node", "left")
    members = staged(members.select("coordinate", "value", "node", F.coalesce("root", "node").alias("comp")))
    open_ = members.groupBy("coordinate", "value").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("coordinate", "value")
    rest = _sides(staged(members.join(small_side(open_), ["coordinate", "value"])), ["coordinate", "value"]).join(sigs, "node")
    rest = rest.select("coordinate", "value", "low", "high", "node", "comp", "sig")
    trees = components(rest.groupBy("coordinate", "value", "low", "high").applyInArrow(_compare(MATCHES), "u long, v long"))
    trees = trees.withColumnRenamed("root", "cluster")
    if not trees.isEmpty():
        parts = trees.join(small_side(joined), "node", "left").select("cluster", "node", F.coalesce("root", "node").alias("comp"))
        parts = parts.join(classes.select("node", "n_shingles"), "node")
        parts = _sides(staged(parts), ["cluster"], "n_shingles").join(_texts_of(trees.select("node"), texts, classes), "node")
        more = parts.select("cluster", "low", "high", "node", "comp", "text").groupBy("cluster", "low", "high").applyInArrow(_settle(words, percent), "u long, v long")
        joined = components(first.unionByName(staged(more)))
    # classes that have copies or links get their component's least id
    known = classes.join(joined, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked")).filter("linked or copies > 1")
    known = staged(known)
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return sets, small_side(known.select("node", "root").join(ids, "root").select("node", "root", "component_id"))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Documents are linked if 100 * common shingles >= ``percent`` * all shingles of both. The component's id is its least
    doc_id; the document that has it is kept. Null text, and text without words, has no shingles, no links and is kept.
    Null ids link others, but are never a component's id unless it has no other; then their component is null and all
    are kept. Rows that repeat are judged alike; no rows give no rows; other columns are ignored.
    """
    sets, final = _grouped(docs, words, percent, id_col, text_col)
    out = sets.select("doc_id", "n_shingles", "node").join(final.select("node", "component_id").withColumn("grouped", F.lit(True)), "node", "left")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """Rows of ``docs`` that are kept: of each component the least id, null last, and of texts that share it one.

    A row is known by id and text: rows that repeat both stay or go together, and a text whose id another text has too
    stays if its own component has none before it. Without ``repeats``, one of the rows that repeat id and text stays,
    that of the least hash of all its columns; texts without words are not near-duplicates, but repeat like others.
    Only ids and hashes of texts that go are joined to the texts, and only rows that repeat are shuffled.
    """
    sets, final = _grouped(docs, words, percent, id_col, text_col)
    rows = staged(sets.join(final.select("node", "root"), "node").select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("own")).distinct())
    first = rows.groupBy("root").agg(F.min("own").alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = rows.join(first, "root").filter("own <> first").select(F.col("own.doc_id").alias("__id"), F.col("own.text_hash").alias("__hash"))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("__hash"))
    kept = docs.join(small_side(gone, 200_000), same, "left_anti")
    if repeats:
        return kept
    again = staged(sets.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    if again.isEmpty():
        return kept
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("__hash"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alike = kept.join(small_side(again, 200_000), same).select(F.struct(*columns).alias("__row"), "__id", "__hash")
    one = alike.groupBy("__id", "__hash").agg(F.min_by("__row", F.xxhash64(*(F.col(f"__row.`{c}`") for c in docs.columns))).alias("__row"))
    return kept.join(small_side(again, 200_000), same, "left_anti").unionByName(one.select("__row.*"))
