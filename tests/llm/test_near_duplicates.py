import numpy as np
import pytest
import xxhash

from siltstone.llm import simhash
from siltstone.llm.components import components

from .common import frame, stored, words


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute(rows, distance=4):
    """Fingerprint and component of each row, over all pairs."""
    f = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= distance):
            a, b = label[i], label[int(j)]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label, strict=True):
        if doc is not None:
            least[x] = min(doc, least.get(x, doc))
    return sorted(((r[0] is None, r[0] or 0), f"{int(v):016x}", least.get(x, -1)) for r, v, x in zip(rows, f, label, strict=True))


def test_against_brute_force(spark):
    base = words(120, 1)
    rows = [(i, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for i, k in enumerate(range(20, 60))]
    rows += [(100 + i, " ".join(words(30, i))) for i in range(30)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "oNE"), (205, "é É"), (206, "a b c"), (None, "One"), (7, rows[7][1]), (300, "x " * 20_000)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got) == brute(rows)


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("cell", [8, 64, 8192])
def test_large_groups_keep_every_link(spark, cell):
    """Hundreds of fingerprints around a few centres, dealt in cells smaller than the groups."""
    rng = np.random.default_rng(5)
    values = []
    for centre in rng.integers(0, 1 << 63, 4, dtype=np.uint64):
        for _ in range(120):
            bits = rng.choice(64, rng.integers(0, 4), replace=False)
            values.append(int(centre) ^ sum(1 << int(b) for b in bits))
    values = np.unique(np.array(values, np.uint64))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = simhash.links(nodes, cell=cell)
    label = {r.node: r.root for r in components(edges).collect()}
    want = list(range(len(values)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4):
            a, b = want[i], want[int(j)]
            if a != b:
                want = [min(a, b) if x in (a, b) else x for x in want]
    signed = values.view(np.int64).tolist()
    same = lambda f: {frozenset(i for i in range(len(values)) if f(i) == f(k)) for k in range(len(values))}
    assert same(lambda i: want[i]) == same(lambda i: label.get(signed[i], signed[i]))


def test_pigeonhole_masks():
    masks = simhash.block_masks()
    assert len(masks) == 35
    rng = np.random.default_rng(0)
    for _ in range(500):
        flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flip & (m & (1 << 64) - 1) == 0 for m in masks)


def test_keep_one(spark, tmp_path):
    rows = [(5, "a b c d e"), (2, "a b c d e"), (9, "q r s t u v"), (None, "a b c d e"), (2, "a b c d e"), (None, "lone words here to stay")]
    kept = simhash.keep_one(stored(spark, tmp_path, rows).select("doc_id", "text")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 2), (False, 9), (True, 0)]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95), (95, 95)] + [(200, i) for i in range(201, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[90], got[95], got[100]} == {90} and {got[i] for i in range(200, 400)} == {200}
    assert len(got) == 60 + 3 + 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
