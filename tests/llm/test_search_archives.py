import hashlib
import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import ann, queries, skew, warc

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string, q string")


def exact(rows, k, every):
    good = {i: np.array(v, np.float64) for i, v, *_ in rows if v and i is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            scored = sorted(((float(good[q] @ v), i) for i, v in good.items() if i != q), key=lambda x: (-x[0], x[1]))
            out[q] = scored[:k]
    return out


def test_whole_share_is_exact(spark):
    """With everything visited and reranked the search is exact, ties, copies and all."""
    rng = np.random.default_rng(1)
    rows = [(i, np.round(rng.normal(size=8), 1).tolist(), 0, "a", "b") for i in range(150)]
    rows += [(200 + i, rows[3][1], 0, "a", "b") for i in range(60)] + [(300, None, 0, "", ""), (301, [], 0, "", ""), (302, [0.0] * 8, 0, "", ""), (303, [1.0, NAN] + [0.0] * 6, 0, "", ""), (304, [INF] + [0.0] * 7, 0, "", ""), (305, [None] + [1.0] * 7, 0, "", ""), (340, [-0.0, 5.0] + [0.0] * 6, 0, "", "")]
    rows = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, *r) for i, v, *r in rows]
    settings = ann.Settings(pivots=16, posted=16, visited=16, reranked=1.0, piece=64, block=2)
    got = {}
    for r in ann.search(vectors(spark, rows + [(400, [1.0, 2.0], 0, "", ""), (None, rows[0][1], 0, "", "")]), F.col("vec_id") % 20 == 0, 20, settings).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = exact(rows, 20, 20)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [got[q][n + 1][0] for n in range(len(best))] == [i for _, i in best]
        assert np.allclose([got[q][n + 1][1] for n in range(len(best))], [s for s, _ in best])


def test_few_and_none(spark):
    assert ann.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(vectors(spark, [(0, None, 0, "", "")]), F.col("vec_id") % 20 == 0).count() == 0
    got = ann.search(vectors(spark, [(0, [1.0, 0.0], 0, "", ""), (1, [0.5, 1.0], 0, "", ""), (0, [1.0, 0.0], 0, "", "")]), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5)]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = exact(rows, 20, 20)
    found = {}
    for r in queries.op3_ann(spark, f"/root/testdata/{sf}").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & {i for _, i in best}) / len(best) for q, best in want.items()]) >= 0.9


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.mark.parametrize("share", [1, 4, 1000])
def test_archive_round_trip(spark, monkeypatch, share):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhttp://x 0.0.0.0 20240101000000 text/html 3\nabc\n"
    pages = [(1, "http://a/ b", "same"), (2, None, "same"), (3, "", "same"), (4, "u", None), (5, "u\r\nInjected: x", ""), (6, "u", tricky), (7, "ü", "übermäßig 日本"), (None, "n", "same"), (8, "u", "only"), (8, "u", "only"), (9, "big", "x" * 300_000), (None, "m", "lonely")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, type string")
    monkeypatch.setattr(warc, "FILE_BYTES", 60_000)
    monkeypatch.setattr(skew, "SHARE", share)
    got = warc.round_trip(df).collect()
    most = {}
    for i, _, h in pages:
        if i is not None:
            most[h or ""] = max(i, most.get(h or "", i))
    want = []
    for i, _, h in pages:
        kept = most.get(h or "")
        again = kept is not None and i != kept
        want.append((str(i), len((h or "").encode()), sha(h or ""), "revisit" if again else "response", str(kept if again else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert warc.round_trip(df.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(df.filter("page_id < 4"), least_bytes=5).collect()} == {"response"}


def test_converter():
    one = warc.arc_version_block("1", "f", "20000101000000") + b"\n" + b"dns:a 1.2.3.4 2001 text/dns 3\nabc\n" + warc.arc_record("1", "http://b", "20010203040506", b"HTTP/1.0 200 OK\r\n\r\nhi", 9, "f") + b"\n"
    got = list(warc.arc_records(memoryview(one)))
    assert [(v, f["URL"], b) for v, f, b in got] == [("1", "dns:a", b"abc"), ("1", "http://b", b"HTTP/1.0 200 OK\r\n\r\nhi")]
    assert warc.warc_type("dns:a", b"abc")[0] == "resource" and warc.warc_type("http://b", got[1][2])[0] == "response"
    assert warc.warc_date("2001") == "2001-01-01T00:00:00Z" and warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    two = warc.arc_version_block("2", "f", "20000101000000") + b"\n" + warc.arc_record("2", "u", "20000101000000", b"x", 0, "f")
    assert next(warc.arc_records(memoryview(two)))[1]["Checksum"] == warc.digest(b"x")
    with pytest.raises(ValueError):
        list(warc.arc_records(memoryview(b"http://b 1.2.3.4 2001 text/html 3\nabc")))
