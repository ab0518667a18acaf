import base64
import gzip
import hashlib
import itertools

import pytest

from veriplumb.llm import urlfilter, warc
from veriplumb.llm.queries import URL_RULES, op6_url_filter, op7_warc

from .cases import SF

URLS = [
    "https://www.Example.COM/en/712?x=1", "http://example.com/en/1", "http://com/en/", "http://xcom/en/", "https://a.example.net/de/8/9#t", "https://a.example.net/de/1", "http://org/es/?q", "nothing", None, "", "://", "x://y://z/en/", "http://h.com",
    "HTTP://USER@Ümlaut.com/en/ü?a#b", "http://a.com#f/en/", "http://b.org\n/es/x",
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rest = rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for verdict, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    for r in urlfilter.judge(pages, URL_RULES).collect():
        host, path, best = plain(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0]), URLS[r["page_id"]]
        if best:
            assert r["verdict"] == best[1]


def test_query(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op6_url_filter(spark, SF).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        host, path, best = plain(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0]) and r["verdict"] in ("allow", "block")


def test_mined_rules_block_and_are_pruned(spark):
    spam = [(i, f"http://shop{i % 7}.spam.test/casino/{i}") for i in range(60)]
    fine = [(100 + i, f"http://news{i % 9}.good.test/{'casino' if i % 10 == 0 else 'story'}/{i}") for i in range(140)]
    pages = spark.createDataFrame([*spam, *fine, (None, "http://s.spam.test/x"), (900, "http://new.spam.test/casino/5"), (900, "http://new.spam.test/casino/5")], "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 60) for i in range(240)] + [(3, None)], "page_id long, bad boolean")
    rows = urlfilter.judge(pages, [], labels, min_confidence=0.95).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] < 60 or r["page_id"] == 900) for r in rows if r["page_id"] is not None)
    assert sum(r["page_id"] == 900 for r in rows) == 2 and sum(r["page_id"] is None for r in rows) == 1
    base = pages.join(labels, "page_id").select(urlfilter.tokens_of(urlfilter.host_of(pages["url"]), urlfilter.path_of(pages["url"])).alias("tokens"), "bad")
    rules = [(set(r["tokens"]), r["confidence"], r["support"]) for r in urlfilter.mine(base).collect()]
    assert rules and all(c >= 0.8 and s >= 0.01 for _, c, s in rules)
    assert not any(a < b and ca >= cb for a, ca, _ in rules for b, cb, _ in rules)


def test_mined_rules_of_any_length(spark):
    words = ["ant", "bee", "cat", "dog", "elk"]
    rows = [(w := [x for i, x in enumerate(words) if k >> i & 1], len(w) >= 4) for k in range(1, 32)] * 3
    support, sure = 0.01, 0.9
    want = {}
    for k in range(1, 6):
        for own in itertools.combinations(words, k):
            having = [bad for tokens, bad in rows if set(own) <= set(tokens)]
            confidence = sum(having) / len(having)
            if sum(having) >= support * len(rows) and confidence >= sure and not any(set(o) < set(own) and c >= confidence for o, c in want.items()):
                want[own] = confidence
    assert {len(w) for w in want} == {4}
    mined = urlfilter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), support, sure).collect()
    assert {tuple(r["tokens"]): r["confidence"] for r in mined} == want
    pages = spark.createDataFrame([(i, "http:///" + "/".join(t)) for i, (t, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, bad) for i, (_, bad) in enumerate(rows)], "page_id long, bad boolean")
    assert all((r["verdict"] == "block") == rows[r["page_id"]][1] for r in urlfilter.judge(pages, [], labels, support, sure).collect())


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlfilter.judge(none, URL_RULES).count() == 0 and warc.round_trip(none).count() == 0


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[digest(h)] = min(first.get(digest(h), i), i)
    out = []
    for i, _, h in rows:
        f = first.get(digest(h))
        again = f is not None and i != f
        out.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = [(5, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (9, "u", "x" * 3_000_000), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (None, None, "<p>é</p>"), (None, None, "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=repr) == expected(rows)
    full = warc.read_archives(warc.to_archives(pages)).collect()
    assert {bytes(r["payload"]) for r in full if r["record_type"] == "response"} == {(h or "").encode() for _, _, h in rows}
    kept = warc.round_trip(pages, min_bytes=10).collect()
    assert all(r["record_type"] == "response" for r in kept if r["payload_bytes"] < 10)


def test_query_warc(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in op7_warc(spark, SF).collect()), key=repr) == expected(rows)


def test_reader_takes_gzip_streams_and_finds_damage():
    a = warc.write_record("response", {"WARC-Payload-Digest": f"sha1:{warc.digest32(b'abc')}"}, b"abc")
    b = warc.write_record("revisit", {"WARC-Refers-To": "<urn:page:1>"}, b"")
    assert [(k, block) for k, _, block in warc.read_records(a + b)] == [("response", b"abc"), ("revisit", b"")]
    assert gzip.decompress(a + b).startswith(b"WARC/1.1\r\n")
    wrong = gzip.compress(gzip.decompress(a).replace(b"abc\r\n", b"abd\r\n"))
    short = gzip.compress(gzip.decompress(a).replace(b"abc\r\n", b"ab\r\n"))
    for bad in (a[:-9], wrong, short, gzip.compress(b"no header"), a[:20] + bytes([a[20] ^ 255]) + a[21:]):
        with pytest.raises(ValueError):
            list(warc.read_records(bad))


def test_files(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder = tmp_path.as_uri() + "/warc"
    files = warc.write_files(warc.to_archives(pages), folder).collect()
    assert sum(f["records"] for f in files) == pages.count() and all(gzip.open(f["path"]).read(8) == b"WARC/1.1" for f in files)
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in warc.read_files(spark, folder, payloads=False).collect()), key=repr) == expected(rows)


def member(version, kind, headers, block):
    """A record written by hand, as crawlers write them."""
    head = [f"WARC/{version}", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n")


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_standard_records(spark, tmp_path):
    body = "<p>über</p>".encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\n" + body[:4] + b"\r\n" + f"{len(body) - 4:x};x=1\r\n".encode() + body[4:] + b"\r\n0\r\n\r\n"
    ids = [f"<urn:uuid:00000000-0000-0000-0000-00000000000{i}>" for i in range(7)]
    date = ("WARC-Date", "2020-01-02T03:04:05Z")
    records = [
        member("1.0", "warcinfo", [("WARC-Record-ID", ids[0]), date, ("Content-Type", "application/warc-fields")], b"software: x\r\n"),
        member("1.0", "request", [("WARC-Record-ID", ids[1]), date, ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        member("1.0", "response", [("WARC-Record-ID", ids[2]), date, ("WARC-Target-URI", "http://a/"), ("Content-Type", "application/http;"), (" msgtype", "response"), ("WARC-Payload-Digest", sha1(body)), ("WARC-Block-Digest", sha1(http))], http),
        member("1.1", "response", [("WARC-Record-ID", ids[3]), date, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(body).hexdigest())], chunked),
        member("1.1", "revisit", [("WARC-Record-ID", ids[4]), date, ("WARC-Refers-To", ids[2]), ("WARC-Payload-Digest", sha1(body)), ("WARC-Profile", warc.IDENTICAL), ("Content-Type", "application/http")], b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        member("1.1", "resource", [("WARC-Record-ID", ids[5]), date, ("Content-Type", "text/plain"), ("WARC-Payload-Digest", "blake3:zz")], b"plain"),
        member("1.1", "metadata", [("WARC-Record-ID", ids[6]), date], b""),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    rows = {r["record_id"]: r for r in warc.read_files(spark, tmp_path.as_uri()).collect()}
    assert [rows[i]["record_type"] for i in ids] == ["warcinfo", "request", "response", "response", "revisit", "resource", "metadata"]
    assert all(r["page_id"] is None and r["date"] == "2020-01-02T03:04:05Z" for r in rows.values())
    for i in ids[2:4]:
        assert (bytes(rows[i]["payload"]), rows[i]["payload_bytes"], rows[i]["payload_digest"]) == (body, len(body), sha1(body)[5:])
    assert (rows[ids[4]]["refers_to_id"], rows[ids[4]]["payload_bytes"], rows[ids[4]]["payload_digest"]) == (ids[2], None, sha1(body)[5:])
    assert rows[ids[2]]["url"] == "http://a/" and rows[ids[5]]["payload_bytes"] == 5 and rows[ids[6]]["payload_bytes"] == 0
    for bad in ([("Content-Type", "application/http"), ("WARC-Payload-Digest", sha1(b"other"))], [("WARC-Block-Digest", sha1(b"other"))]):
        with pytest.raises(ValueError):
            list(warc.read_records(member("1.0", "response", bad, http)))
    with pytest.raises(ValueError):
        list(warc.read_records(gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n\r\n\r\n")))


def test_own_records_are_standard(spark):
    pages = spark.createDataFrame([(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (None, "u", "y"), (None, "u", "y")], "page_id long, url string, html string")
    records = [r for a in warc.to_archives(pages).collect() for r in warc.read_records(bytes(a["archive"]))]
    assert len(records) == 4 and all({"warc-record-id", "warc-date", "content-type", "content-length"} <= set(h) for _, h, _ in records)
    for kind, h, block in records:
        assert kind == "revisit" and h["warc-profile"] == warc.IDENTICAL and block == b"" or warc.payload_of(h, block)[0] in (b"<p>x</p>", b"y") and block.startswith(b"HTTP/1.1 200 OK\r\n")
    assert sum("urn:uuid:" in h["warc-record-id"] for _, h, _ in records) == 2


def test_clashing_columns_and_long_urls(spark):
    from .cases import clashing

    long = "http://" + "a" * 300 + ".com/" + "/".join(f"seg{i}" for i in range(5000))
    rows = [(1, long, "x"), (2, "http://com/en/" + "z" * 100_000, None), (2, None, ""), (None, "", "x")]
    plain_pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for pages in (plain_pages, clashing(plain_pages).selectExpr("*", "1 as host", "2 as path", "3 as rule", "4 as verdict", "5 as tokens", "6 as fit", "7 as sha", "8 as refers_to", "9 as archive")):
        found = urlfilter.judge(pages, URL_RULES, spark.createDataFrame([(1, True), (2, False)], "page_id long, bad boolean")).collect()
        assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in found), key=repr) == sorted(((i, plain(u)[0], plain(u)[1], plain(u)[2] and plain(u)[2][0]) for i, u, _ in rows), key=repr)
        assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=repr) == expected(rows)
