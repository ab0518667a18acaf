"""Quality by hierarchical empirical Bayes.

A logistic regression on the shape of the text gives each document's evidence: a likelihood ratio of good to bad. The
rate of good documents of a path is spread around its host's rate, and those of hosts around a global one, as beta
distributions. Documents are counted per path and evidence, which gives each path the likelihood of every rate on a grid;
summed over paths, of every host's rate; summed over hosts, of every global rate and strength of shrinkage, of which the
likeliest are taken. Sparse sites so fall back to their host's rate and sparse hosts to the global one, by as much as the
documents' evidence, uncertain as it is, leaves open. Labelled documents count by their label at their site. A document's
posterior joins its evidence with all rates that its path may have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, blocks, inverted, small_batches, small_side, staged, text_bytes, word_hashes

#: Labelled documents that the classifier is fitted on, at most.
TAUGHT = 20_000
#: Labels that are broadcast, at most; more are shuffled to the documents.
LABELS = 400_000
#: Rates that a site may have, evenly spaced in log-odds, and strengths of shrinkage, in documents.
GRID = 1 / (1 + np.exp(-np.linspace(-6, 6, 65)))
STRENGTHS = (2.0, 8.0, 32.0, 128.0, 512.0)
#: Documents of a path are counted by evidence to a quarter; the mean of each count is kept. Labels count as CERTAIN.
PER_UNIT, CERTAIN = 4, 30.0
SYMBOL = np.zeros(256, bool)
SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
FEATURES = ("symbols", "upper", "digits", "repeats", "word_length", "words")


def shape(column: pa.Array) -> np.ndarray:
    """Features of each text, rows x FEATURES; a last column holds the number of words."""
    raw, at = text_bytes(column)
    hashes, counts = word_hashes(raw, at)
    n = len(counts)
    total = lambda mask: np.diff(np.append(0, np.cumsum(mask))[at])
    size = np.maximum(np.diff(at), 1)
    words = np.maximum(counts, 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    ends = np.cumsum(counts)
    starts = ends - counts
    same[starts[counts > 0]] = False
    repeats = np.diff(np.append(0, np.cumsum(same))[np.append(starts, len(hashes))]) if n else np.zeros(0)
    letters = size - total(SPACE[raw])
    return np.column_stack([np.sqrt(total(SYMBOL[raw]) / size), np.sqrt(total(UPPER[raw]) / size), np.sqrt(total(DIGIT[raw]) / size), np.sqrt(repeats / words), np.log(np.maximum(letters, 1) / words), np.log(words), counts]).astype(float)


@dataclass
class Classifier:
    """``offset``: log-odds of good among the examples, which the evidence contains."""

    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    offset: float = 0.0

    def evidence(self, features: np.ndarray) -> np.ndarray:
        """Log-odds of good."""
        z = (features[:, : len(self.centre)] - self.centre) / self.scale
        return np.clip((np.column_stack([np.ones(len(z)), z, np.maximum(z, 0) ** 2]) * self.weights).sum(axis=1), -30, 30)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Classifier:
    """Newton's method with a ridge; without examples, or of one kind only, the evidence is the smoothed base rate."""
    x = x[:, : len(FEATURES)] if len(x) else np.zeros((0, len(FEATURES)))
    centre = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = x.std(0) + 1e-3 if len(x) else np.ones(x.shape[1])
    z = (x - centre) / scale
    z = np.column_stack([np.ones(len(z)), z, np.maximum(z, 0) ** 2])
    w = np.zeros(z.shape[1])
    w[0] = offset = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if 0 < y.sum() < len(y):
        keep = np.full(len(w), ridge)
        keep[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip((z * w).sum(axis=1), -30, 30)))
            curve = np.einsum("ni,nj->ij", z * (p * (1 - p))[:, None], z) + np.diag(keep)
            step = (inverted(curve) * ((z * (y - p)[:, None]).sum(axis=0) - keep * w)).sum(axis=1)
            w += step
            if np.abs(step).max() < 1e-8:
                break
    return Classifier(w, centre, scale, offset)


def _shape_udf():
    @F.arrow_udf("array<double>")
    def shaped(text: pa.Array) -> pa.Array:
        rows = [shape(b.column("text")) for b in blocks([pa.RecordBatch.from_arrays([text], names=["text"])], "text", 1 << 20)]
        return pa.array([r.tolist() for m in rows for r in m], pa.list_(pa.float64()))

    return shaped


def _evidence_udf(model: Classifier):
    @F.arrow_udf("double")
    def evidence(text: pa.Array) -> pa.Array:
        rows = [(m := shape(b.column("text")), model.evidence(m)) for b in blocks([pa.RecordBatch.from_arrays([text], names=["text"])], "text", 1 << 20)]
        none = np.concatenate([m[:, -1] == 0 for m, _ in rows]) if rows else np.zeros(0, bool)
        return pa.array(np.concatenate([e for _, e in rows]) if rows else np.zeros(0), mask=none)

    return evidence


def fit(docs: DataFrame, labels: DataFrame, taught: int = TAUGHT, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """A classifier from ``labels`` (id, good 0/1), on the ``taught`` ids of least hash; conflicting labels count as bad."""
    said = labels.filter("good is not null and id is not null").groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(taught)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(said), "id")
    got = rows.select("good", _shape_udf()(F.col("text")).alias("f")).limit(2 * taught).collect()  # ids can repeat
    return logistic(np.array([r["f"] for r in got]), np.array([r["good"] for r in got], float))


def evidence(text: Column, model: Classifier) -> Column:
    """Log-odds of good from the text alone; null without a word."""
    return _evidence_udf(model)(F.coalesce(text.cast("string"), F.lit("")))


def _key(*names: str) -> Column:
    return F.concat(*(F.coalesce(F.concat(F.lit("s"), F.length(F.col(f"`{c}`").cast("string")), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in names))


def spread(strength: float) -> np.ndarray:
    """Weight of each rate of the grid (columns) around each rate above it (rows): a beta distribution in log-odds."""
    log = strength * (np.outer(GRID, np.log(GRID)) + np.outer(1 - GRID, np.log(1 - GRID)))
    weight = np.exp(log - log.max(axis=1, keepdims=True))
    return weight / weight.sum(axis=1, keepdims=True)


SPREADS = np.stack([spread(s) for s in STRENGTHS])


def likelihood(evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-likelihood of each rate of the grid, from ``n`` documents of each evidence (log of the likelihood ratio)."""
    return (np.log(GRID * np.exp(np.clip(evidence, -CERTAIN, CERTAIN))[:, None] + 1 - GRID) * n[:, None]).sum(axis=0)


def raised(below: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-likelihoods (rows x grid) of rates, as those of the rate above, one strength's ``weights`` between them."""
    top = below.max(axis=1, keepdims=True)
    return np.log((np.exp(below - top)[:, None, :] * weights).sum(axis=2).clip(1e-300)) + top


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.array(list(matrix), pa.list_(pa.float64()))


def _path_likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [likelihood(np.array([x["e"] for x in counts]), np.array([x["n"] for x in counts], float)) for counts in b.column("counts").to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([b.column("host_key"), b.column("path_key"), _lists(np.array(rows))], names=["host_key", "path_key", "own"])


def _host_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch, the sums over a host's paths: log-likelihoods of its rate under each strength, end to end."""
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            b = whole.slice(a, 256)
            hosts, where = np.unique(np.array(b.column("host_key").to_pylist(), object), return_inverse=True)
            own = _vectors(b.column("own"))
            sums = np.zeros((len(hosts), len(STRENGTHS) * len(GRID)))
            np.add.at(sums, where, np.concatenate([raised(own, w) for w in SPREADS], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(hosts.tolist(), pa.string()), _lists(sums)], names=["host_key", "all"])


def _host_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, total = None, None
    for b in batches:
        if b.num_rows:
            key, part = b.column("host_key")[0], _vectors(b.column("all")).sum(axis=0)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), _lists(total[None])], names=["host_key", "all"])


def _global_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of hosts, log-likelihoods of strength between paths, strength between hosts, and global rate."""
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            hosts = _vectors(whole.slice(a, 256).column("all")).reshape(-1, len(STRENGTHS), len(GRID))
            sums = np.array([[raised(hosts[:, i], w).sum(axis=0) for w in SPREADS] for i in range(len(STRENGTHS))])
            yield pa.RecordBatch.from_arrays([_lists(sums.reshape(1, -1))], names=["all"])


def _posteriors(below: int, above: int, rate: int):
    """Per path: mean rate of its host, its own mean rate, and the weight of each rate of the grid, given all documents."""

    def posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                own, hosts = _vectors(b.column("own")), _vectors(b.column("all")).reshape(-1, len(STRENGTHS), len(GRID))[:, below]
                host = np.log(SPREADS[above][rate].clip(1e-300)) + hosts
                others = host - raised(own, SPREADS[below])  # what is known of the host but for this path
                host, others = (np.exp(x - x.max(axis=1, keepdims=True)) for x in (host, others))
                path = np.log(np.einsum("nj,ji->ni", others, SPREADS[below]).clip(1e-300)) + own
                path = np.exp(path - path.max(axis=1, keepdims=True))
                host, path = host / host.sum(axis=1, keepdims=True), path / path.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([b.column("path_key"), pa.array((host * GRID).sum(axis=1)), pa.array((path * GRID).sum(axis=1)), _lists(path)], names=["path_key", "host_rate", "path_rate", "weights"])

    return posteriors


def site_rates(scored: DataFrame) -> DataFrame:
    """``host_key, path_key, evidence`` of all documents -> ``path_key, host_rate, path_rate, weights``, one row a path.

    ``evidence`` is the log of a likelihood ratio; documents without say nothing about their site, and a site of such
    alone has the rate of the level above. Rows meet in counts per path and evidence, summed per task first; paths meet
    in sums of grids. Only one grid per pair of strengths comes to the driver. No rows give no rows.
    """
    bin_ = F.round(F.col("evidence") * PER_UNIT).cast("int")
    counted = scored.groupBy("host_key", "path_key", bin_.alias("bin")).agg(F.count("evidence").alias("n"), F.avg("evidence").alias("e"))
    counts = F.filter(F.collect_list(F.struct("e", "n")), lambda x: x["n"] > 0)  # at most one entry for each quarter
    vector = "array<double>"
    paths = staged(counted.groupBy("host_key", "path_key").agg(counts.alias("counts")).mapInArrow(_path_likelihoods, f"host_key string, path_key string, own {vector}"))
    hosts = staged(paths.mapInArrow(_host_parts, f"host_key string, all {vector}").groupBy("host_key").applyInArrow(_host_sum, f"host_key string, all {vector}"))
    sums = hosts.mapInArrow(_global_parts, f"all {vector}").select(F.posexplode("all")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    total = np.zeros(len(STRENGTHS) ** 2 * len(GRID))
    for r in sums:
        total[r["pos"]] = r["s"]
    # of equals, the strongest shrinkage
    below, above, rate = np.unravel_index(len(total) - 1 - int((total >= total.max() - 1e-9)[::-1].argmax()), (len(STRENGTHS), len(STRENGTHS), len(GRID))) if sums else (0, 0, 0)
    both = paths.join(hosts, "host_key").select("path_key", "own", "all")
    return both.mapInArrow(_posteriors(int(below), int(above), int(rate)), f"path_key string, host_rate double, path_rate double, weights {vector}")


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5, carry: bool = False) -> DataFrame:
    """``doc_id, evidence, host_rate, path_rate, posterior, kept`` for each row; with ``carry`` the columns of ``docs`` and ``kept``.

    ``labels``: id, good (0/1, null says nothing, of several the worst counts). ``evidence`` is the log-odds of good
    from the text alone, at the rate of the labels. A text without a word, or null, has none: posterior 0, and it is
    rejected. Null hosts and paths are groups of their own; null ids and repeated rows are judged like others; without
    labels the evidence is a constant, and documents with words stay. Rates cover all rows.
    With ``carry`` the columns are staged beside the evidence: each text is read for its features once.
    Documents carry no URL: unless other columns are named, ``source`` stands for the host, and ``lang`` within it for the path.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    keys = {"host_key": _key(host_col), "path_key": _key(host_col, path_col)}
    text, own_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    held = {c: f"__{i}" for i, c in enumerate(docs.columns)} if carry else {}  # under other names, so that none clashes
    carried = (F.col(f"`{c}`").alias(n) for c, n in held.items())
    scored = staged(docs.select(*carried, own_id.alias("doc_id"), *(v.alias(k) for k, v in keys.items()), evidence(text, model).alias("evidence")))
    ratio = F.col("evidence") - F.lit(model.offset)
    said = labels.filter("good is not null and id is not null").groupBy("id").agg(F.min("good").alias("good"))
    taught = scored.join(small_side(said.withColumnRenamed("id", "said_id"), LABELS), F.col("doc_id") == F.col("said_id"), "left")
    known = F.when(F.col("evidence").isNull(), F.lit(None)).when(F.col("good") == 1, F.lit(CERTAIN)).when(F.col("good") == 0, F.lit(-CERTAIN)).otherwise(ratio)
    sites = small_side(site_rates(taught.select("host_key", "path_key", known.cast("double").alias("evidence"))))
    inner = scored.drop("host_key")
    odds = F.when(ratio.isNotNull(), F.exp(F.least(F.greatest(ratio, F.lit(-CERTAIN)), F.lit(CERTAIN))))
    grid = F.array(*(F.lit(float(g)) for g in GRID))
    posterior = F.aggregate(F.zip_with("weights", grid, lambda w, t: w * t * F.col("odds") / (t * F.col("odds") + 1 - t)), F.lit(0.0), lambda x, y: x + y)
    joined = inner.join(sites, "path_key", "left").withColumn("odds", odds).withColumn("posterior", F.coalesce(posterior, F.lit(0.0)))
    joined = joined.withColumn("kept", F.col("posterior") >= threshold)
    if carry:
        return joined.select(*(F.col(n).alias(c) for c, n in held.items() if c != "kept"), "kept")
    return joined.select("doc_id", "evidence", "host_rate", "path_rate", "posterior", "kept")
