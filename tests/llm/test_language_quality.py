from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veriplumb.llm import langid, quality
from veriplumb.llm.queries import op8_language, op9_quality

from .cases import SF, clashing, documents, empty


def plain_phrases(text, sample):
    """Longest matches by searching the sample itself."""
    letters, corpus = " ".join(langid.letters_of(text).split()), " ".join(langid.letters_of(sample).split())
    letters += " " if text and not text[-1].isalpha() and letters else ""
    n = 0
    for a in range(0, len(letters), langid.BLOCK):
        block, at = letters[a : a + langid.BLOCK], 0
        while at < len(block):
            end = at + 1
            while end <= len(block) and block[at:end] in corpus:
                end += 1
            at = max(at + 1, end - 1)
            n += 1
    return n


def test_automaton_accepts_just_the_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2]
    moves = langid.suffix_automaton(text)

    def accepts(word):
        s = 0
        for c in word:
            if c not in moves[s]:
                return False
            s = moves[s][c]
        return True

    subs = {tuple(text[i:j]) for i in range(8) for j in range(i + 1, 9)}
    import itertools

    assert all(accepts(w) == (w in subs) for n in (1, 2, 3, 4) for w in itertools.product((1, 2, 3), repeat=n))


@pytest.mark.parametrize("text", ["the cat sat on the mat", "der Hund und die Katze!", "zzz 123 qqq", "x", "The!! dog ... " * 90])
def test_parse_against_search(text):
    samples = {"de": "der hund liegt auf der matte und die katze schläft", "en": "the dog lies on the mat and the cat sleeps there"}
    model = langid.Model(samples)
    said, score = model.predict([text])
    counts = {k: plain_phrases(text, v) for k, v in samples.items()}
    best = min(sorted(counts), key=counts.get)
    assert said == [best] and abs(score[0] - (1 - min(counts.values()) / max(counts.values()))) < 1e-9


def test_no_letters_and_no_model():
    assert langid.Model({"en": "abc"}).predict([None, "", "12 %%", "abc"])[0] == ["und", "und", "und", "en"]
    assert langid.Model({}).predict(["abc", None]) == (["und", "und"], [0.0, 0.0])


def test_language_cases(spark):
    docs = documents(spark)
    model = langid.fit(clashing(docs))
    rows = langid.identify(clashing(docs), model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    assert all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (3, 4, 5)) and {r["lang_pred"] for r in rows if r["doc_id"] in (8, 9)} == {"de"}
    more = langid.with_language(clashing(docs), model)
    assert set(more.columns) >= set(docs.columns) and more.count() == docs.count()
    assert langid.identify(empty(spark), langid.fit(empty(spark))).count() == 0


def test_held_out_accuracy(spark):
    import zlib

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_language(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out) >= 0.97 * len(out)


def plain_shape(text):
    words = text.split()
    lower = [w.lower() for w in words]
    return sum(a == b for a, b in zip(lower, lower[1:], strict=False)), len(words)


def test_features():
    texts = ["a a b B b", "", None, "ONE two", "%%% ### x", "é é"]
    m = quality.shape(pa.array(texts))
    for row, t in zip(m, texts, strict=True):
        repeats, words = plain_shape(t or "")
        assert row[-1] == words and abs(row[3] ** 2 * max(words, 1) - repeats) < 1e-9
    assert m[4, 0] > m[3, 0] and m[3, 1] > 0.5


def test_logistic_separates_and_degenerates():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(400, 6)), np.repeat([0.0, 1.0], 200)
    x[200:, 2] += 4
    model = quality.logistic(x, y)
    assert ((model.evidence(x) > 0) == (y == 1)).mean() > 0.95
    assert abs(quality.logistic(np.zeros((0, 7)), np.zeros(0)).evidence(np.zeros((1, 7)))[0]) < 1e-9
    assert quality.logistic(np.zeros((5, 6)), np.ones(5)).evidence(np.zeros((1, 6)))[0] > 0


def test_held_out_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    taught = labels.filter("doc_id % 2 = 0").selectExpr("doc_id as id", "quality as good")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, taught).collect()}
    rest = labels.filter("doc_id % 2 = 1").collect()
    assert sum(got[r["doc_id"]] == (r["quality"] == 1) for r in rest) >= 0.9 * len(rest)
    rows = op9_quality(spark, SF).collect()
    assert len(rows) == docs.count()


def test_quality_cases(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (8, 0), (9, 0), (6, 1), (6, 0), (None, 1), (3, None)], "id long, good int")
    rows = quality.judge(clashing(docs), labels).collect()
    assert len(rows) == docs.count()
    assert all(r["posterior"] == 0 and not r["kept"] for r in rows if r["doc_id"] in (3, 4, 5))
    assert quality.judge(clashing(docs), labels, carry=True).count() == docs.count()
    none = spark.createDataFrame([], "id long, good int")
    assert quality.judge(empty(spark), none).count() == 0 and quality.judge(docs, none).filter("kept").count() == docs.filter("trim(text) rlike '\\\\S'").count()


def test_shrinkage_of_sparse_sites(spark):
    rows = [("h1", "p1", 3.0)] * 400 + [("h2", "p2", -3.0)] * 400 + [("h1", "p3", -3.0)] + [(f"h{i}", f"p{i}", 3.0 if i % 3 else -3.0) for i in range(10, 60)]
    scored = spark.createDataFrame(rows, "host_key string, path_key string, evidence double")
    rate = {r["path_key"]: r for r in quality.site_rates(scored).collect()}
    assert rate["p1"]["path_rate"] > 0.9 > 0.1 > rate["p2"]["path_rate"]
    good = 1 / (1 + np.exp(3.0))
    assert good < rate["p3"]["path_rate"] < rate["p3"]["host_rate"]


def test_parse_of_whole_documents_against_search(spark, monkeypatch):
    """The model that a fit gives, on whole documents, against longest matches in what it was taught; with and without
    moves laid out in full."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held, samples = [], {}
    own = langid.Model
    monkeypatch.setattr(langid, "Model", lambda taught: samples.update(taught) or own(taught))
    model = langid.fit(docs, docs_per_language=6, letters=3000)
    texts = [r["text"] for r in docs.sort("doc_id").collect() if 0 < len(r["text"] or "") < 3000][:25]
    for dense in (langid.DENSE, 0):
        monkeypatch.setattr(langid, "DENSE", dense)
        model.table = None
        for text, said, score in zip(texts, *model.predict(texts), strict=True):
            counts = {k: plain_phrases(text, v) for k, v in samples.items()}
            ranked = sorted(counts.values())
            held.append(said)
            assert said == min(sorted(counts), key=counts.get) and abs(score - (1 - ranked[0] / ranked[1])) < 1e-9
    assert held[:25] == held[25:] and all(len(v) <= 3000 + 60 for v in samples.values())
    whole = {r["text"] for r in docs.collect()}
    assert all(any(t and t in v for t in whole) for v in samples.values())


def test_model_grows_with_arcs_not_alphabets():
    rng = np.random.default_rng(0)
    wide = "".join(chr(0x4E00 + int(i)) for i in rng.integers(0, 2800, 12_000))
    model = langid.Model({"zh": wide, "en": "the cat sat on the mat " * 200, "none": ""})
    import pickle

    assert len(pickle.dumps(model.moves)) < 60 * 12_000 and model.predict([wide[500:900], "cat on the mat"])[0] == ["zh", "en"]


def test_languages_of_most_rows_are_taught(spark, caplog):
    rows = [(i, f"{w} text number {w} {i}", w) for w, n in (("zz", 40), ("mm", 20), ("aa", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df, languages=2).languages == ["mm", "zz"] and "fewest" in caplog.text
    long = spark.createDataFrame([(1, "only long " * 500, "xx"), (2, "even longer " * 900, "xx")], "doc_id long, text string, lang string")
    assert langid.fit(long, letters=100).predict(["only long"])[0] == ["xx"]


def test_rates_of_simulated_sites(spark):
    """True rates of 0.5 and 0.9 from weak evidence; sparse hosts lie between their own rate and the global one."""
    rng = np.random.default_rng(1)
    rows = []
    for h in range(20):
        good = rng.random(2000) < (0.5 if h % 2 else 0.9)
        for i, e in enumerate(rng.normal(np.where(good, 0.75, -0.75), 1.2247).tolist()):
            rows.append((f"h{h}", f"h{h}p{i % 2}", e))
    rows += [("few", "few1", -2.0)]
    got = {r["path_key"]: r for r in quality.site_rates(spark.createDataFrame(rows, "host_key string, path_key string, evidence double")).collect()}
    for h in range(20):
        assert abs(got[f"h{h}p0"]["host_rate"] - (0.5 if h % 2 else 0.9)) < 0.06 and abs(got[f"h{h}p0"]["path_rate"] - (0.5 if h % 2 else 0.9)) < 0.08
    assert abs(np.mean([got[f"h{h}p0"]["host_rate"] for h in range(0, 20, 2)]) - 0.9) < 0.02 and abs(np.mean([got[f"h{h}p0"]["host_rate"] for h in range(1, 20, 2)]) - 0.5) < 0.02
    assert 0.5 < got["few1"]["path_rate"] < 0.75


def test_sites_decide_where_texts_do_not(spark):
    """Texts alike everywhere; labels say that one host is good and one bad: unlabelled documents follow their host."""
    rows, labels = [], []
    for i in range(400):
        host = "ab"[i % 2]
        rows.append((i, f"some plain words of no great note {i % 7}", host, "en"))
        if i < 200:
            labels.append((i, int(host == "a") if i % 20 > 1 else int(host == "b")))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r for r in quality.judge(df, spark.createDataFrame(labels, "id long, good int")).collect()}
    assert all(got[i]["kept"] == (i % 2 == 0) for i in range(200, 400))
    assert sum(got[i]["kept"] != (got[i]["evidence"] >= 0) for i in range(200, 400)) >= 90


def test_no_path_and_no_evidence(spark):
    scored = spark.createDataFrame([("h", "p", None), ("h", "q", 1.0)], "host_key string, path_key string, evidence double")
    rates = {r["path_key"]: r for r in quality.site_rates(scored).collect()}
    assert rates["p"]["path_rate"] < rates["q"]["path_rate"] and quality.site_rates(scored.limit(0)).count() == 0
