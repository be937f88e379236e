import pyarrow as pa
import pytest

import corpus_pipeline
from siltstone.llm import decontamination, substring

from .common import DATA, stored, words


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A small corpus with one case for every stage."""
    root = tmp_path_factory.mktemp("world")
    item, passage = words(40, 1), words(70, 2)
    text = {i: " ".join(words(150, 100 + i)) for i in range(40)}
    text[100] = text[5]
    text[101] = text[6].upper().replace(" ", "\n")
    text[102] = "12 34 --- 56"
    text[103] = None
    text[104] = " ".join(words(60, 3) + passage)
    text[105] = " ".join(words(60, 4) + passage + words(20, 5))
    text[106] = " ".join(words(60, 6) + item + words(20, 7))
    text[107] = " ".join(passage)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in text.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root), text, item, passage


def test_stages(spark, world, tmp_path):
    root, text, item, passage = world
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        if name != "best_fit_packing":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(40))
    assert set(kept["language_id"]) == set(text) - {102, 103}
    assert set(kept["near_duplicates"]) == set(kept["language_id"]) - {100, 101}
    assert set(kept["substring_dedup"]) == set(kept["near_duplicates"]) - {107}
    assert passage[30] in kept["substring_dedup"][104].text.split() and kept["substring_dedup"][105].text.split() == words(60, 4) + words(20, 5)
    assert set(kept["benchmark_decontamination"]) == set(kept["substring_dedup"]) - {106}
    assert clean <= set(kept["best_fit_packing"]) and all(kept["benchmark_decontamination"][i].text == text[i] for i in clean)


def test_run_equals_stages(spark, world):
    root = world[0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, root)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() >= 42


def test_on_test_data(spark):
    out = corpus_pipeline.run(spark, DATA).toArrow()
    per = {}
    for s, o, n in zip(*(out.column(c).to_pylist() for c in ("sequence_id", "offset", "length")), strict=True):
        per.setdefault(s, []).append((o, n))
    for items in per.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 1024
    bad = {r.doc_id for r in decontamination.contamination(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")).filter("contaminated").collect()}
    assert isinstance(out, pa.Table) and out.num_rows and bad  # what is left of a contaminated text after stage 3 may be clean
    left = spark.read.parquet(f"{DATA}/documents.parquet").join(spark.createDataFrame([(i,) for i in set(out.column("doc_id").to_pylist())], "doc_id long"), "doc_id", "left_semi")
    whole = {r.doc_id for r in left.collect()}
    untouched = untouched_by_stage_3(spark)
    assert not bad & whole & untouched


def untouched_by_stage_3(spark):
    """Documents of the test data that lose nothing to earlier ones, even with all of them there."""
    found = substring.repeated_windows(spark.read.parquet(f"{DATA}/documents.parquet"))
    return {r.doc_id for r in found.filter("n_removed = 0").collect()}


def test_edge_cases(spark, tmp_path):
    """Repeated rows, null ids and texts, ties, very long texts, and columns whose names the operators use inside."""
    long_text = " ".join(words(60_000, 9, 30_000))
    prose = [" ".join(words(80, 50 + i)) for i in range(6)]
    rows = [(1, prose[0]), (1, prose[0]), (1, prose[1]), (2, None), (3, ""), (4, "12 ..."), (None, prose[2]), (None, prose[3]), (5, long_text), (6, prose[4] + " " + prose[5]), (7, prose[5])]
    stored(spark, tmp_path, [(i, t, "en") for i, t in rows], "documents.parquet")
    spark.createDataFrame([(1, "not in any", "x")], "item_id long, text string, row_ string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert {"row_", "fp", "key"} <= set(docs.columns)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted((r.doc_id or 0, r.text or "") for r in docs.collect()) if "text" in docs.columns else docs.collect()
    language = sorted((i or 0, t) for i, t in rows if i not in (2, 3, 4))
    assert kept["language_id"] == language
    once = sorted(set(language))  # the repeated row has an equal, and goes
    assert kept["near_duplicates"] == once
    assert kept["substring_dedup"] == [x for x in once if x[0] != 7] == kept["benchmark_decontamination"]  # all of 7 is in 6
    pieces = kept["best_fit_packing"]
    assert {r.doc_id for r in pieces} == {1, None, 5, 6} and max(r.length for r in pieces) <= 1024
    assert sum(r.length for r in pieces if r.doc_id == 5) > 60_000


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
