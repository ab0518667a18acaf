"""The pipeline's stages, each on its own input, against plain versions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline

from .cases import SF, clashing, documents, empty
from .test_neardup import brute
from .test_packing import check
from .test_sharding_mixing import plain_targets

WORD = re.compile("[^\x20\x09-\x0d]+")
SPACES = " \t\n\v\f\r"


def plain_features(text):
    raw = (text or "").encode()
    words = WORD.findall(text or "")
    low = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words]
    n, w = max(len(raw), 1), max(len(words), 1)
    symbols = sum(33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"()-" for b in raw)
    letters = n - sum(chr(b) in SPACES for b in raw)
    repeats = sum(a == b for a, b in zip(low, low[1:], strict=False))
    return [math.sqrt(symbols / n), math.sqrt(sum(65 <= b < 91 for b in raw) / n), math.sqrt(sum(48 <= b < 58 for b in raw) / n), math.sqrt(repeats / w), math.log(max(letters, 1) / w), math.log(w)], len(words)


def plain_logistic(x, y):
    """Log-odds of good as a function of features: ridge of 1 on standardised features and the squares of their positive parts."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3

    def design(f):
        z = (np.atleast_2d(f) - centre) / scale
        return np.hstack([np.ones((len(z), 1)), z, np.maximum(z, 0) ** 2])

    z, w = design(x), np.zeros(1 + 2 * x.shape[1])
    pull = np.diag([1e-6] + [1.0] * (len(w) - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.linalg.solve((z.T * (p * (1 - p))) @ z + pull, z.T @ (y - p) - pull @ w)
    return lambda f: float(np.clip(design(f) @ w, -30, 30)[0])


def beta_weights(strength, mean, grid):
    """A beta distribution on the grid, in log-odds."""
    log = [strength * (mean * math.log(t) + (1 - mean) * math.log(1 - t)) for t in grid]
    w = [math.exp(x - max(log)) for x in log]
    return np.array(w) / sum(w)


def plain_quality(docs, labels):
    """Places of kept rows: evidence, then rates of hosts and paths summed over every rate and strength, by loops."""
    said = {}
    for r in labels:
        said[r["doc_id"]] = min(said.get(r["doc_id"], 1), r["quality"])
    got = [(plain_features(r["text"])[0], said[r["doc_id"]]) for r in docs if r["doc_id"] in said]
    y = np.array([y for _, y in got], float)
    model, offset = plain_logistic(np.array([f for f, _ in got]), y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    ratio = [math.exp(model(f) - offset) if n else None for f, n in (plain_features(r["text"]) for r in docs)]
    grid = [1 / (1 + math.exp(-6 + 12 * i / 64)) for i in range(65)][::-1]
    at_site = lambda r, k: None if k is None else {1: math.exp(30), 0: math.exp(-30)}.get(said.get(r["doc_id"]), k)
    paths = defaultdict(lambda: np.zeros(65))
    for r, k in zip(docs, ratio, strict=True):
        own = at_site(r, k)
        paths[r["source"], r["lang"]] += np.array([math.log(t * own + 1 - t) if own is not None else 0.0 for t in grid])
    best = None
    for below in (2, 8, 32, 128, 512):
        spread = [beta_weights(below, t, grid) for t in grid]
        hosts = defaultdict(lambda: np.zeros(65))
        raised = {}
        for (host, lang), like in paths.items():
            raised[host, lang] = np.array([math.log(float(w @ np.exp(like - like.max()))) + like.max() for w in spread])
            hosts[host] += raised[host, lang]
        for above in (2, 8, 32, 128, 512):
            for j, t in enumerate(grid):
                w = beta_weights(above, t, grid)
                total = sum(math.log(max(float(w @ np.exp(h - h.max())), 1e-300)) + h.max() for h in hosts.values())
                if best is None or (total, below, above, j) > best[:4] and total > best[0] - 1e-9:
                    best = (total, below, above, j, hosts, raised, spread, w)
    *_, hosts, raised, spread, top = best
    out = []
    for i, (r, k) in enumerate(zip(docs, ratio, strict=True)):
        if k is not None:
            key = (r["source"], r["lang"])
            host = np.log(np.maximum(top, 1e-300)) + hosts[key[0]] - raised[key]
            host = np.exp(host - host.max())
            rates = sum(h * w for h, w in zip(host, spread, strict=True)) * np.exp(paths[key] - paths[key].max())
            if sum(w * t * k / (t * k + 1 - t) for w, t in zip(rates / rates.sum(), grid, strict=True)) >= 0.5:
                out.append(i)
    return out


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    kept = corpus_pipeline.staged(stages["quality"](spark, docs, SF))
    every = docs.collect()
    assert ids(kept) == {every[i]["doc_id"] for i in plain_quality(every, spark.read.parquet(f"{SF}/labels.parquet").collect())}
    assert sorted(map(tuple, kept.select(docs.columns).collect())) == sorted(tuple(r) for r in docs.collect() if r["doc_id"] in ids(kept))

    spoken = corpus_pipeline.staged(stages["language"](spark, kept, SF))
    assert ids(spoken) == {r["doc_id"] for r in kept.collect() if any(c.isalpha() for c in r["text"] or "")}

    single = corpus_pipeline.staged(stages["near_duplicates"](spark, spoken, SF))
    assert ids(single) == {r[0] for r in brute([(r["doc_id"], r["text"]) for r in spoken.collect()], 5) if r[3]}

    mix = corpus_pipeline.staged(stages["mixing"](spark, single, SF))
    words = lambda t: WORD.findall(t or "")
    text, sizes, taken = {r["doc_id"]: r["text"] for r in single.collect()}, Counter(), Counter()
    for r in single.collect():
        sizes[r["source"]] += len(words(r["text"]))
    cut = Counter()
    for r in mix.collect():
        taken[r["source"]] += len(words(r["text"]))
        if r["text"] != text[r["doc_id"]]:
            cut[r["source"]] += 1
            assert words(r["text"]) == words(text[r["doc_id"]])[: len(words(r["text"]))]
    assert all(abs(taken[s] - t) <= 1 for s, t in plain_targets(sizes).items()) and max(cut.values(), default=0) <= 1

    packed = stages["packing"](spark, mix, SF).collect()
    assert check(packed, mix.collect()) > 0.95
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_exact_rows_of_cases(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns through every stage."""
    stages = dict(corpus_pipeline.STAGES)
    docs = corpus_pipeline.staged(clashing(documents(spark)))
    rows = lambda df: Counter(tuple(r) for r in df.select(docs.columns).collect())

    every = docs.collect()
    kept = corpus_pipeline.staged(stages["quality"](spark, docs, SF))
    want = plain_quality(every, spark.read.parquet(f"{SF}/labels.parquet").collect())
    assert kept.columns == docs.columns and rows(kept) == Counter(tuple(every[i]) for i in want)

    spoken = corpus_pipeline.staged(stages["language"](spark, docs, SF))
    lettered = [r for r in every if any(c.isalpha() for c in r["text"] or "")]
    bare = lambda r: tuple(v for c, v in r.asDict().items() if c != "lang")
    got = spoken.select(docs.columns).collect()
    assert spoken.columns == docs.columns and Counter(map(bare, got)) == Counter(map(bare, lettered))
    assert all(r["lang"] in ("en", "de", "fr") for r in got) and {r["doc_id"] for r in got if r["lang"] == "de"} >= {8, 9}

    single = corpus_pipeline.staged(stages["near_duplicates"](spark, docs, SF))
    gone = [(2, "the quick"), (7, "one"), (9, "word0")]
    left = Counter(tuple(r) for r in every if not any(r["doc_id"] == i and (r["text"] or "").startswith(t) for i, t in gone))
    assert single.columns == docs.columns and rows(single) == Counter(list(left)) and sum(left.values()) == sum(Counter(list(left)).values()) + 1

    mix = corpus_pipeline.staged(stages["mixing"](spark, docs, SF))
    sizes, taken = Counter(), Counter()
    for r in every:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in mix.collect():
        taken[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert mix.columns == docs.columns and all(abs(taken[s] - t) <= 1 for s, t in plain_targets(sizes).items())
    assert check(stages["packing"](spark, docs, SF).collect(), every) >= 0


def test_stages_of_nothing(spark):
    docs = clashing(empty(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and out.columns == docs.columns, name
    assert corpus_pipeline.packed(spark, docs, SF).count() == 0


def test_near_duplicates_keep_one_row_and_lose_no_text(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "some other words that nobody else has said"
    rows = [(1, a), (2, a), (2, b), (6, c), (6, c), (6, c), (None, a), (None, None), (None, None), (3, ""), (3, "")]
    df = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, __row string, nth int")
    for docs in (df, df.withColumn("nth", F.lit(1))):
        kept = corpus_pipeline.distinct(spark, docs, SF)
        assert kept.columns == docs.columns
        assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (2, b), (6, c), (None, None), (3, "")])


def test_untaught_language_rejects_nothing(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.in_a_language(spark, docs, SF).count() == docs.count()


def test_a_text_is_parsed_once_for_its_language(spark):
    said = corpus_pipeline.in_a_language(spark, documents(spark), SF)
    assert said._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
