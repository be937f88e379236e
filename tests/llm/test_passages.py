import hashlib
import re

import duckdb
import pytest

from siltstone.llm import decontamination, queries, substring

from .common import DATA, frame, stored, words

SPACED, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LAST = (1 << 63) - 1


def brute_repeats(rows, window):
    cut = [SPACED.findall(t or "") for _, t in rows]
    ids = [LAST if i is None else i for i, _ in rows]
    first = {}
    for i, w in zip(ids, cut, strict=True):
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(i, first.get(s, i))
    out = []
    for (doc, _), i, w in zip(rows, ids, cut, strict=True):
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((doc is None, doc or 0, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def passages():
    shared, other = words(80, 1), words(55, 2)
    rows = [(i, " ".join(words(40, 10 + i) + shared[i % 5 :] + words(30, 50 + i))) for i in range(12)]
    rows += [(20 + i, " \n".join(other)) for i in range(4)]
    rows += [(40, " ".join(shared[:50])), (41, " ".join(shared[:49])), (42, None), (43, ""), (44, " \t "), (45, "é ü " * 60), (46, "é ü " * 61)]
    rows += [(50, "b " * 3000), (51, "c d " * 900), (52, "d c " * 700 + "b " * 400)]
    rows += [(47, "a " * 200), (48, "a " * 120), (None, " ".join(other)), (3, rows[3][1]), (49, " ".join(words(30_000, 99, 100_000) + shared))]
    return rows


@pytest.mark.parametrize("window, hot", [(50, 2000), (50, 2), (12, 5)])
def test_repeats_against_brute_force(spark, tmp_path, window, hot):
    rows = passages()
    got = substring.repeated_windows(stored(spark, tmp_path, rows), window, hot).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows, window)


def test_repeats_empty(spark):
    assert substring.repeated_windows(frame(spark, [])).count() == 0


def test_without_repeats_keeps_columns(spark, tmp_path):
    rows = passages()
    docs = stored(spark, tmp_path, rows).select("doc_id", "text", "lang", "source", "n_chars")
    got = substring.without_repeats(docs)
    assert got.columns == docs.columns
    # rows one by one, as the brute force judges each on its own
    text_of = {}
    for d, t in rows:
        text_of.setdefault((d is None, d or 0, hashlib.sha256(" ".join(SPACED.findall(t or "")).encode()).hexdigest()), t)
    want = []
    for null, d, n, removed, h in brute_repeats(rows, 50):
        if removed and removed == n:
            continue  # a document that loses all its words goes
        text = None if removed else text_of[null, d, h]
        want.append((null, d, h, removed > 0, text))
    found = [(r.doc_id is None, r.doc_id or 0, hashlib.sha256(" ".join(SPACED.findall(r.text or "")).encode()).hexdigest(), r) for r in got.collect()]
    assert sorted(x[:3] for x in found) == sorted(x[:3] for x in want)
    changed = {x[:3] for x in want if x[3]}
    for null, d, h, r in found:
        assert r.n_chars == len(r.text or "") and ((null, d, h) in changed or r.text == text_of[null, d, h])


def brute_hits(rows, items, window):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    wanted = {}
    for item, t in items:
        w = PLAIN.findall(low(t))
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size and item is not None else 0):
            wanted.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = []
    for doc, t in rows:
        w, hit, ids = PLAIN.findall(low(t)), set(), set()
        for size in {len(x) for x in wanted}:
            for k in range(len(w) - size + 1):
                if who := wanted.get(tuple(w[k : k + size])):
                    ids |= who
                    hit |= set(range(k, k + size))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc is None, doc or 0, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("filter_most", [decontamination.FILTER_MOST, 3])
def test_contamination_against_brute_force(spark, filter_most):
    item = words(60, 1)
    items = [(1, " ".join(item)), (2, " ".join(item[:13]).upper()), (3, "short one, here"), (4, "solo"), (10, " ".join(item[20:40])), (5, None), (6, "--"), (None, "null id words"), (7, "ein Übermaß"), (2, "again twice"), (8, "rep rep rep rep")]
    rows = [(1, " ".join(words(100, 2) + item[5:18] + words(300, 3))), (2, " ".join(item[5:17])), (3, "A short ONE here; solo."), (4, None), (5, ""), (6, "null id words"), (7, "x ein Übermaß y"), (8, "rep " * 9), (None, " ".join(item)), (1, "solo"), (9, " ".join(words(20_000, 5) + item[:30])), (10, "AGAIN-twice")]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, fp string")
    found = decontamination.hits(frame(spark, rows), bench, filter_most=filter_most)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, len(r.item_ids)) for r in found.collect()) == sorted(x[:5] for x in brute_hits(rows, items, 13))
    got = decontamination.contamination(frame(spark, rows), bench).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_hits(rows, items, 13)
    kept = decontamination.clean(frame(spark, rows), bench)
    bad = {(x[0], x[1]) for x in brute_hits(rows, items, 13) if x[-1]}
    assert {(r.doc_id is None, r.doc_id or 0) for r in kept.collect()} == {(i is None, i or 0) for i, _ in rows} - bad and "key" in kept.columns


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(frame(spark, []), none).count() == 0
    assert [r.n_hit for r in decontamination.contamination(frame(spark, [(1, "a b")]), none).collect()] == [0]


def test_every_shared_span_is_found(spark):
    """Winnowing's guarantee, for spans of exactly a window at every place."""
    item = words(40, 7)
    rows = [(i, " ".join(words(9, 100 + i) + item[i : i + 13] + words(9, 200 + i))) for i in range(28)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert all(r.n_hit >= 13 for r in decontamination.hits(frame(spark, rows), bench).collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    twin = c.sql(queries.oracle_sql()[name])
    at = [list(twin.columns).index(x) for x in columns]
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=str) == sorted((tuple(x[i] for i in at) for x in twin.fetchall()), key=str)
