"""Rules and edge cases of operators on literal rows."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import classify, policy, text
from siltstone.operators import chunking, code, evaluation, fusion, governance, graph, lexical, maintenance, repository, selection, validators, vectors
from siltstone.plans import extensions, planner
from siltstone.sources import files
from siltstone.streaming import events

HITS = "query_id string, lane string, status string, rank int, evidence_id long, version int, dup_cluster long, kind string, raw_score long, arrival int"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_identities(spark):
    assert planner.query_id("") == 0xCBF29CE484222325
    assert planner.query_id("a") == 0xAF63DC4C8601EC8C
    assert value(spark, text.version_id(F.lit("x"))) == int("2d711642b726b044", 16)
    assert value(spark, text.chunk_id(F.lit(2), F.lit(3))) == 2 * 1_000_003 + 4
    assert planner.source_digest([2, 1]) == planner.source_digest([1, 2, 2])


def test_excerpt_never_cuts_a_word(spark):
    assert value(spark, text.excerpt(F.lit("one  two\nthree"), 9)) == "one two"
    assert value(spark, text.excerpt(F.lit("toolongword"), 4)) == ""


@pytest.mark.parametrize("query, intent", [("", "ExactLookup"), ('"a b"', "ExactLookup"), ("foo-bar", "ExactLookup"), ("what do they disagree on", "ContradictionAudit"), ("latest tables", "CurrentWeb"), ("a and b where c", "CompositionalConstraints"), ("plain question", "FactualLocal")])
def test_intent(spark, query, intent):
    assert value(spark, classify.intent(F.lit(query))) == intent


def test_rewrites(spark):
    assert value(spark, classify.rewrites(F.lit("PR #12 on 2024-01-02"))) == ["Pull Request #12 on 2024-01-02", "PR #12 on 2024_01_02", "PR Issue 12 on 2024-01-02", "PR #12 on date 2024-01-02"]


def test_denial_order(spark):
    base = dict(read_allowed=True, trust_zone="Verified", review_status="Approved", integrity="Verified", sensitivity="Public", scope_id=1, prompt_injection_risk=False, poisoning_flags=[])
    rows = [base, base | dict(read_allowed=False, integrity="Compromised"), base | dict(trust_zone="Quarantined"), base | dict(sensitivity="Restricted"), base | dict(scope_id=9), base | dict(scope_id=None), base | dict(prompt_injection_risk=True, poisoning_flags=["x"]), base | dict(poisoning_flags=["x"])]
    schema = "read_allowed boolean, trust_zone string, review_status string, integrity string, sensitivity string, scope_id long, prompt_injection_risk boolean, poisoning_flags array<string>"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    auth = policy.Authorization(max_sensitivity="Internal", scopes=(1, 2), allow_unscoped=False)
    got = [r.d for r in df.select(policy.denial(auth).alias("d")).collect()]
    assert got == [None, "Read not allowed by ACL", "Item is quarantined or rejected", "Sensitivity too high: Restricted", "Scope mismatch: item scope 9 is outside request scope", "Item has no scope_id", "Prompt injection risk detected", "Poisoning flags detected"]


def test_scopes(spark):
    a, b, none = F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)), F.lit(None).cast("array<int>")
    assert value(spark, policy.effective_scopes(none, a, b)) == [2]
    assert value(spark, policy.effective_scopes(none, none)) is None


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "pre\n# A\nx\n\n## B\ny"), (2, "p\n \nq\nr\n"), (3, ""), (4, "#no heading")], "doc_id long, text string")
    got = {(r.doc_id, r.ord): (r.start_line, r.end_line, r.text) for r in chunking.markdown_chunks(docs).collect()}
    assert got == {(1, 0): (1, 1, "pre"), (1, 1): (2, 4, "# A\nx"), (1, 2): (5, 6, "## B\ny"), (2, 0): (1, 1, "p"), (2, 1): (3, 4, "q\nr"), (4, 0): (1, 1, "#no heading")}


def test_filtered_scores_equal_unfiltered(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a"), (3, "d"), (4, "")], "doc_id long, text string")
    every = {r.id: r.score for r in lexical.bm25(docs, ["a", "b", "a"]).collect()}
    some = {r.id: r.score for r in lexical.bm25(docs, ["a", "b"], docs.filter("doc_id = 2").select("doc_id")).collect()}
    assert set(every) == {1, 2} and some == {2: every[2]}


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.id, r.score_micros) for r in vectors.cosine_top_k(v, [2.0, 0.0], 3).orderBy("rank").collect()]
    assert got == [(1, 1_000_000), (4, 1_000_000), (2, 0)]
    assert value(spark, text.micros(F.lit(float("nan")))) == 0


def test_rrf_clusters_and_failed_lanes(spark):
    rows = [("q", "a", "Succeeded", 1, 10, 1, 5, "lexical", 9, 1), ("q", "a", "Succeeded", 2, 11, 1, 5, "lexical", 8, 2), ("q", "a", "Succeeded", 3, 12, 1, None, "lexical", 7, 3), ("q", "b", "Succeeded", 1, 10, 1, None, "dense", 3, 4), ("q", "c", "Failed", 1, 99, 1, None, "x", 1, 5)]
    hits = spark.createDataFrame(rows, HITS)
    got = [(r.id_kind, r.identity, r.score, r.fused_rank) for r in fusion.rrf(hits).orderBy("fused_rank").collect()]
    assert got == [(0, 5, 2 * (10_000_000 // 61), 0), (1, 12, 10_000_000 // 62, 1)]
    with pytest.raises(ValueError):
        fusion.rrf(hits, 0)
    best = fusion.representatives(hits).filter("identity = 5").first()
    assert best.evidence_id == 10 and best.scores == "dense=3,lexical=9"
    assert [r.score for r in fusion.blend(hits, 1.0, ["dense"]).filter("identity = 12").collect()] == [0]


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id string, rank int, evidence_id long, dup_cluster long, source string, document string, section string, freshness string, coverage_keys array<string>")


def test_selection_stops_at_zero_gain(spark):
    rows = [("q", 0, 1, None, "s", "d", "x", "Current", []), ("q", 1, 2, None, "s", "d", "x", "Current", []), ("q", 2, 3, None, "t", "e", "y", "Current", [])]
    got = selection.select(candidates(spark, rows)).collect()
    assert [(r.evidence_id, r.placement, r.stop_reason, r.status) for r in got] == [(1, "Selected", "LowMarginalGain", "Answerable")]


def test_selection_goes_on_until_requirements_hold(spark):
    rows = [("q", 0, 1, 7, "s", "d", "x", "Stale", ["k"]), ("q", 1, 2, 7, "u", "d", "x", "Stale", []), ("q", 2, 3, None, "t", "e", "y", "Stale", [])]
    got = selection.select(candidates(spark, rows), selection.Requirements(minimum_sources=2, required_keys=("k", "l"))).orderBy("original_rank").collect()
    assert [r.placement for r in got] == ["Selected", "Duplicate", "Selected"]
    assert got[0].percent_covered == 50 and got[0].status == "StaleEvidenceOnly" and got[0].stop_reason == "RequirementsUnmet"


def test_graph_cycles(spark):
    edges = spark.createDataFrame([(1, "a", "k", "b", 500), (2, "b", "k", "a", 500), (3, "b", "k", "c", 500), (4, "c", "k", "c", 500)], "id long, src string, kind string, dst string, confidence_milli int")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.expand(edges, seeds, 4).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.node, r.depth) for r in graph.expand(edges, seeds, 1).collect()} == {("a", 0), ("b", 1)}


def test_code_index(spark):
    rows = [("a.py", "class A:\n    def f(self):\n        return g()\n\n\ndef g():\n    pass\n"), ("b.py", "def (:"), ("c.rs", "pub fn h() {\n    let x = 1;\n}\n"), ("d.ts", "export class K {\n}\n"), ("e.txt", "def no(): pass"), ("f.py", None)]
    found = code.symbols(spark.createDataFrame(rows, "path string, text string"))
    assert {(r.file_path, r.name, r.start_line, r.end_line) for r in found.filter("kind <> 'module'").collect()} == {("a.py", "A", 1, 3), ("a.py", "f", 2, 3), ("a.py", "g", 6, 7), ("c.rs", "h", 1, 3), ("d.ts", "K", 1, 2)}
    kinds = {(r.kind, r.target_record_id.split("#")[1].split("@")[0]) for r in code.relations(found).collect()}
    assert ("Calls", "a.g") in kinds and ("Defines", "a.A") in kinds
    assert code.regex_error("(") and planner.Engine(spark, symbols=found).code_search("regex", "(").count() == 0


def test_metrics_without_relevant_or_hits(spark):
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 1, 2), ("q", 2, 3)], "query_id string, evidence_id long, rank int")
    marks = spark.createDataFrame([("q", 2, 1), ("r", 5, 0)], "query_id string, evidence_id long, grade int")
    got = {r.query_id: (r.recall, r.mrr, r.ndcg) for r in evaluation.golden_metrics(ranked, marks, 1).collect()}
    assert got == {"q": (0, 5000, 0), "r": (10_000, 0, 10_000)}


def test_upsert_and_versions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d"), (3, None)], "k int, v string")
    assert {r.k: r.action for r in maintenance.upsert_changed(old, new, "k").collect()} == {1: "same", 2: "update", 3: "same", 4: "insert"}
    log = [(1, "s", "ParserStarted", 1, "h"), (2, "s", "SourceBecameStale", 1, "other"), (3, "t", "ParserStarted", 1, "h"), (4, "t", "SourceBecameStale", 1, "h")]
    rows = spark.createDataFrame(log, "id long, source string, kind string, artifact long, hash string")
    assert [r.source for r in maintenance.active_versions(rows).collect()] == ["s"]


def test_files(spark, tmp_path):
    for name, data in (("a.md", b"# x"), ("src/b.rs", b"fn a() {}"), ("src/c.exe", b"x"), ("node_modules/d.md", b"x"), ("e.txt", b"a\x00b")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r.text for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# x", "src/b.rs": "fn a() {}", "e.txt": None}
    (tmp_path / ".gitignore").write_text("src/\n!src/b.rs\n*.txt\n")
    assert [r.path for r in files.scan(spark, str(tmp_path)).collect()] == ["a.md"]  # below an excluded folder nothing comes back
    assert files.normalize("/r", "a/../b") == "/r/b" and files.normalize("/r", "../x") is None


@pytest.mark.parametrize("change", [dict(query=" "), dict(queries=("x",)), dict(lanes=()), dict(lanes=("lexical", "lexical")), dict(lanes=("web",)), dict(budget=planner.Budget(max_results=0)), dict(stages=("fuse",)), dict(rrf_k=0), dict(authorization=policy.Authorization(scopes=()))])
def test_broken_plans(change):
    good = planner.SearchPlan("q", "FactualLocal", ("q",), ("lexical",))
    planner.validate(good)
    with pytest.raises(planner.PlanError):
        planner.validate(planner.replace(good, **change))


def test_denied_documents_are_never_found(spark):
    rows = [(1, "apache license", "Verified"), (2, "apache license", "Quarantined")]
    df = spark.createDataFrame(rows, "doc_id long, text string, trust_zone string").withColumns({"path": F.concat(F.lit("p"), "doc_id"), "version_id": F.col("doc_id"), "review_status": F.lit("Approved"), "integrity": F.lit("Verified"), "sensitivity": F.lit("Public"), "read_allowed": F.lit(True), "scope_id": F.lit(1), "prompt_injection_risk": F.lit(False), "poisoning_flags": F.array().cast("array<string>")})
    engine = planner.Engine(spark).index(df)
    made = planner.plan(spark, "apache license")
    assert {r.evidence_id for r in engine.search(made).collect()} == {1}
    assert made.trace_id() == planner.plan(spark, "apache license").trace_id()


def test_watch_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("x")
    seen = []
    for expected in (1, 2):
        events.watch(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, i: seen.extend(r.path for r in df.select("path").collect())).awaitTermination(60)
        assert len(seen) == expected
        (tmp_path / "in" / "b.md").write_text("y")


def test_streamed_windows_equal_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = events.windowed_counts(stream).writeStream.format("memory").queryName("streamed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = lambda df: sorted((str(r.window_start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("streamed")) == key(events.windowed_counts(e))
    assert events.sessions(e).agg(F.sum("n").alias("n")).first().n == e.count()


def test_structural_chunks_keep_attributes(spark):
    source = "use a;\n#[derive(Debug)]\n// note\n\npub struct P;\n\n#[x]\nlet y;\nfn f() {\n}\n"
    docs = spark.createDataFrame([(1, source), (2, "no items\n\nhere")], "doc_id long, text string")
    got = [(r.doc_id, r.start_line, r.text.split("\n")[0]) for r in chunking.structural_chunks(docs, *chunking.language_rules("rust")).orderBy("doc_id", "ord").collect()]
    assert got == [(1, 1, "use a;"), (1, 2, "#[derive(Debug)]"), (1, 9, "fn f() {"), (2, 1, "no items"), (2, 3, "here")]


def test_gates(spark):
    assert value(spark, governance.approval(F.lit("Other"), F.lit("Low"))) == "Deny"
    assert value(spark, governance.approval(F.lit("Assisted"), F.lit("Medium"))) == "RequireApproval"
    rows = spark.createDataFrame([("q", 1, 50, True), ("q", 2, 40, False), ("q", 3, 30, False), ("r", 1, 99, False)], "query_id string, ord int, bytes long, is_seed boolean")
    assert {(r.query_id, r.ord) for r in governance.within_budget(rows, 5, 60).collect()} == {("q", 1), ("q", 2)}
    counters = spark.createDataFrame([("a", 3), ("b", 1)], "name string, next_id long")
    assert {(r.name, r.next_id) for r in governance.advanced_counters(counters, spark.createDataFrame([("a", 2), ("c", 9)], "name string, next_id long")).collect()} == {("a", 3), ("b", 1), ("c", 9)}


def test_meta_tags_in_any_form(spark):
    pages = [
        "<META CONTENT='2026-07-20' PROPERTY = 'ARTICLE:PUBLISHED_TIME'>\n<meta CONTENT=\"2026-07-21\" name = 'dateModified'>\n<meta name='dateEffective' content='2026-07-22'>",
        "<meta name=datePublished content=2026-07-23>",
        "<meta name='datePublished' content='open>",
        "<meta name='article:published_time' content=' '><meta name='datePublished' content='b'>",
        None,
    ]
    got = files.web_metadata(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).orderBy("page_id").collect()
    assert [(r.published_at, r.updated_at, r.effective_at) for r in got] == [("2026-07-20", "2026-07-21", "2026-07-22"), ("2026-07-23", None, None), (None, None, None), ("b", None, None), (None, None, None)]


@pytest.mark.parametrize("ref, fine", [("a" * 40, True), ("A1B2C3D", True), ("HEAD", True), ("HEAD~", True), ("HEAD~2", True), ("HEAD^1", True), ("HEAD^2", True), ("", False), ("not-a-commit", False), ("a" * 6, False), ("g" * 40, False), ("HEAD~x", False), ("HEAD~1~1", False), ("a" * 41, False), ("HEAD\n", False)])
def test_commit_references(spark, ref, fine):
    assert value(spark, text.plausible_commit(F.lit(ref))) is fine


def test_taint_inherits_a_scope_that_only_one_has(spark):
    base = dict(k=1, trust_zone="Verified", authority="User", integrity="Verified", sensitivity="Public", review_status="Approved", scope_id=5, prompt_injection_risk=False, poisoning_flags=["a"], read_allowed=True, write_allowed=True)
    rows = [base, base | dict(scope_id=None, write_allowed=False, review_status="Rejected"), base | dict(k=2), base | dict(k=2, scope_id=6), base | dict(k=3, scope_id=None)]
    schema = "k int, trust_zone string, authority string, integrity string, sensitivity string, review_status string, scope_id long, prompt_injection_risk boolean, poisoning_flags array<string>, read_allowed boolean, write_allowed boolean"
    got = {r.k: r for r in policy.taint(spark.createDataFrame([tuple(r.values()) for r in rows], schema), "k").collect()}
    assert [got[k].scope_id for k in (1, 2, 3)] == [5, None, None]
    assert got[1].write_allowed is False and got[1].review_status == "Rejected" and got[2].write_allowed is True


def test_sniff(spark):
    rows = [(0, b"\x0b\x0c\x7f" * 100), (1, b"\x01" * 5 + b"a" * 95), (2, b"\x01" * 6 + b"a" * 94), (3, b"a\x00b"), (4, b"a" * 8192 + b"\x00"), (5, b""), (6, "größe".encode()), (7, b"\xff\xfe\x80" * 9), (8, b"a" * ((2 << 20) + 1))]
    got = spark.createDataFrame(rows, "i int, content binary").select("i", files.looks_like_text(F.col("content")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [True, True, False, False, True, True, True, True, False]


def chain(spark, n):
    return spark.createDataFrame([(i, f"n{i:04d}", "next", f"n{i + 1:04d}", 500) for i in range(n)], "id long, src string, kind string, dst string, confidence_milli int")


def test_deep_walks_stay_linear(spark):
    seeds = spark.createDataFrame([("n0000",)], "node string")
    got = graph.expand(chain(spark, 30), seeds, 16)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert sorted((r.depth, r.node) for r in got.collect()) == [(i, f"n{i:04d}") for i in range(17)]
    assert {r.node: r.depth for r in graph.lineage(chain(spark, 5), seeds, 9).collect()} == {f"n{i:04d}": i for i in range(6)}


def test_context_respects_depth_and_node_caps(spark):
    rows = [(1, "a", "Calls", "b"), (2, "a", "Calls", "c"), (3, "b", "Imports", "d"), (4, "c", "Calls", "d"), (5, "d", "Calls", "a"), (6, "x", "Calls", "c")]
    edges = spark.createDataFrame(rows, "id long, src string, kind string, dst string")
    seeds = spark.createDataFrame([("a",), ("x",)], "node string")

    def run(**kw):
        nodes, relations, cut_off = graph.context(edges, seeds, **kw)
        return {r.node: (r.depth, r.seeds) for r in nodes.collect()}, {r.id: r.depth for r in relations.collect()}, cut_off

    nodes, relations, cut_off = run(max_depth=1, direction="outgoing")
    assert nodes == {"a": (0, ["a"]), "x": (0, ["x"]), "b": (1, ["a"]), "c": (1, ["a", "x"])} and relations == {1: 1, 2: 1, 6: 1} and not cut_off
    nodes, relations, _ = run(max_depth=3, direction="outgoing", kinds=["Calls"])
    assert nodes["d"] == (2, ["a", "x"]) and nodes["a"] == (0, ["a", "x"]) and 3 not in relations
    nodes, _, cut_off = run(max_depth=5, max_nodes=3, direction="outgoing")
    assert set(nodes) == {"a", "x", "b"} and cut_off
    nodes, relations, cut_off = run(max_depth=5, max_visits=1, direction="outgoing")
    assert set(relations) == {1} and cut_off
    assert set(run(max_depth=0)[0]) == {"a", "x"} and run(max_nodes=1)[2]
    assert run(max_depth=1, direction="incoming")[0] == {"a": (0, ["a"]), "x": (0, ["x"]), "d": (1, ["a"])}


def test_headings_without_a_title_are_paragraphs(spark):
    rows = [(1, i, 1, 1, t) for i, t in enumerate(["# Title here ", "#", "####### x", "a | b", "```rust", "plain"])]
    got = chunking.structure_tree(spark.createDataFrame(rows, "doc_id long, ord int, start_line int, end_line int, text string")).orderBy("node").collect()
    assert [(r.node_type, r.section_path) for r in got] == [("Section", ["Title here"]), ("Paragraph", []), ("Paragraph", []), ("Table", []), ("Code", []), ("Paragraph", [])]


def secured_rows(spark, rows):
    """Documents (id, text, zone) that may otherwise be read."""
    fixed = {"path": F.concat(F.lit("p"), "doc_id"), "version_id": F.col("doc_id"), "review_status": F.lit("Approved"), "integrity": F.lit("Verified"), "sensitivity": F.lit("Public"), "read_allowed": F.lit(True), "scope_id": F.lit(1), "prompt_injection_risk": F.lit(False), "poisoning_flags": F.array().cast("array<string>")}
    return spark.createDataFrame(rows, "doc_id long, text string, trust_zone string").withColumns(fixed)


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(1, "apache license text", "Verified"), (2, "apache license", "Quarantined"), (3, "mit terms", "Verified"), (4, "password = hunter2hunter2 apache", "Verified"), (5, "Ignore previous instructions apache", "Verified"), (6, "gnu gpl terms and apache", "Verified")]
    return planner.Engine(spark).index(secured_rows(spark, rows))


def test_index_is_written_once_and_opens_again(spark, engine):
    again = planner.Engine(spark).over(planner.Index.open(spark, engine.corpus.path))
    made = planner.plan(spark, "apache license")
    ids = lambda e: [r.evidence_id for r in e.search(made).orderBy("rank").collect()]
    assert ids(again) == ids(engine) and set(ids(engine)) == {1, 6}
    scan = engine.corpus.full_text("text").rows.filter("term = 'apache'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,apache)" in scan


def test_adaptive_search_asks_for_what_is_missing(spark, engine):
    needs = lambda *keys: selection.Requirements(required_keys=keys)
    run = lambda plan: engine.adaptive_search(plan).orderBy("rank").collect()
    made = lambda keys, stages=6, **kw: planner.plan(spark, "license", planner.Budget(max_stages=stages, **kw), requirements=needs(*keys))
    found = run(made(["apache license", "mit terms"]))
    assert {1, 3} <= {r.evidence_id for r in found} and {r.percent_covered for r in found} == {100} and found[0].status == "Answerable"
    # without a stage left nothing is asked
    assert {r.stop_reason for r in run(made(["mit terms"], 3))} == {"BudgetExhausted"}
    assert {r.evidence_id for r in run(made(["mit terms"], 3))} == {1}
    # an injected key counts as tried, and is never a query
    risky = run(made(["ignore previous instructions"]))
    assert {r.stop_reason for r in risky} <= {"LowMarginalGain", "RequirementsUnmet"} and {r.evidence_id for r in risky} == {1}
    # a key that nothing covers
    assert {r.stop_reason for r in run(made(["nobody wrote this"]))} <= {"LowMarginalGain", "RequirementsUnmet"}


@pytest.mark.parametrize(
    "args, stop",
    [(("SourcesConflict", ["k"], [], False), "RequirementsUnmet"), (("DeniedByPolicy", ["k"], [], False), "PolicyDenied"), (("Abstained", ["k"], [], False), "Abstained"), (("Answerable", [], [], True), "EvidenceComplete"), (("EvidenceIncomplete", ["k"], [], True), "BudgetExhausted"), (("EvidenceIncomplete", ["k"], ["k"], False), "RequirementsUnmet"), (("EvidenceIncomplete", ["k", "l"], ["k"], False), None), ((None, ["k"], [], False), None)],
)
def test_adaptive_stops(args, stop):
    assert planner.adaptive_stop(*args) == stop


def test_lanes_of_an_engine(spark, engine):
    vectors_ = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, embedding array<float>")
    dense = extensions.DenseLane(engine.corpus, vectors_)
    encoder = extensions.HashedTerms()
    sparse = extensions.SparseLane(engine.corpus, encoder.encode(engine.corpus.documents.select("doc_id", "text")), encoder)
    symbols = spark.createDataFrame([("p3", "m.MitTerms"), ("p2", "m.MitTerms")], "file_path string, qualified_name string")
    code_lane = extensions.CodeLane(engine.corpus, symbols)
    request = extensions.Request(("mit terms",), policy.Authorization(), 10, {0: [0.0, 1.0]})
    assert {(r.q, r.id) for r in dense.retrieve(request).collect() if r.score > 0} == {(0, 3)}
    assert {r.id for r in sparse.retrieve(request).collect()} == {3, 6}
    assert {r.id for r in code_lane.retrieve(request).collect()} == {3}  # the quarantined file is never scored
    assert {r.id for r in extensions.VisualLane(engine.corpus, vectors_).retrieve(request).collect()} == {1, 3}
    shut = planner.replace(engine, retrievers=(*engine.retrievers, dense, sparse, code_lane))
    made = planner.plan(spark, "mit terms")
    assert [r.descriptor.id for r in shut.active(made)] == ["lexical", "substring", "cards"] and [r.descriptor.id for r in shut.shadows(made)] == ["learned_sparse"]
    assert shut.shadow(made).count() == 2
    opened = planner.replace(shut, eligibility=extensions.Eligibility(frozenset({"DomainTerminology"}), True, True, True))
    assert [r.descriptor.id for r in opened.active(made)] == ["lexical", "substring", "cards", "dense", "learned_sparse", "code"]
    assert {r.evidence_id for r in opened.search(made).collect()} == {3, 6} and opened.shadow(made) is None
    assert opened.explain(made)["lanes"] == [r.descriptor.id for r in opened.active(made)]


def test_parts_take_each_other_s_place(spark, engine):
    class Backwards:
        def fuse(self, hits):
            return fusion.rrf(hits).withColumn("fused_rank", 100 - F.col("identity"))

    class ById:
        def score(self, candidates):
            return F.when(F.col("identity") != 6, F.col("identity"))

    made = planner.plan(spark, "apache license")
    order = lambda e: [r.evidence_id for r in e.search(made).orderBy("rank").collect()]
    assert order(engine) == [1, 6] and order(planner.replace(engine, fusion=Backwards())) == [6, 1]
    assert order(planner.replace(engine, reranker=extensions.BoundedReranker(ById()))) == [1, 6]
    edges = spark.createDataFrame([(1, "document:1", "cites", "document:3", 900), (2, "document:1", "cites", "document:2", 900)], "id long, src string, kind string, dst string, confidence_milli int")
    assert order(planner.replace(engine, expander=extensions.Neighbours(edges))) == [1, 6, 3]  # and not the quarantined one


def test_event_log(spark, tmp_path):
    log = events.EventLog(spark, str(tmp_path / "log"))
    rows = lambda *ids: spark.createDataFrame([(i, i % 2) for i in ids], "id long, artifact_id long")
    assert log.last_id() == 0
    log.append(rows(2, 1))
    log.append(rows(3))
    assert [r.id for r in log.scan().collect()] == [1, 2, 3] and [r.id for r in log.scan(1).collect()] == [1, 3] and log.last_id() == 3
    for bad in (rows(3), rows(5, 5), rows(1, 9)):
        with pytest.raises(ValueError):
            log.append(bad)


def test_folder_keeps_what_is_pending(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in "abc":
        (tmp_path / "in" / f"{n}.md").write_text(n)
    folder = events.Folder(spark, str(tmp_path / "in"), str(tmp_path / "state"), most=2)
    name = lambda rows: [(r.path.rsplit("/", 1)[1], r.change) for r in rows.collect()]
    first = folder.poll()
    assert name(first) == [("a.md", "added"), ("b.md", "added")] == name(folder.poll())  # not handled yet
    folder.commit(first)
    (tmp_path / "in" / "a.md").unlink()
    (tmp_path / "in" / "b.md").write_text("new")
    second = folder.poll()
    assert name(second) == [("a.md", "removed"), ("b.md", "changed")]
    folder.commit(second)
    third = events.Folder(spark, str(tmp_path / "in"), str(tmp_path / "state")).poll()
    assert name(third) == [("c.md", "added")]
    folder.commit(third)
    assert folder.poll().count() == 0


def test_manifests_that_cannot_be_read():
    assert repository.package("a/b/pyproject.toml", "[project")["warning"] == "a/b/pyproject.toml: TOMLDecodeError"
    assert repository.package("a/b/pyproject.toml", None) | {"warning": None} == {"manifest": "a/b/pyproject.toml", "ecosystem": "python", "name": "b", "version": "0.0.0", "dependencies": [], "warning": None}
    assert repository.package("package.json", "[1]")["warning"] and repository.package("setup.cfg", "no section")["warning"]
    assert repository.package("Cargo.toml", "[workspace]") is None


def test_comment_markers_know_strings():
    rust = 'let a = "// TODO no"; // TODO: yes\nlet b = r#"/* FIXME no */"#; /* FIXME(x)\n more */\nlet c = \'"\'; // hack\nfn f<\'a>() {} //! TODO x\n// TODOLIST\n//TODO'
    assert repository.comment_markers(rust, "rust") == [("todo", 1, 1), ("fixme", 2, 3), ("hack", 4, 4), ("todo", 5, 5), ("todo", 7, 7)]
    python = 'x = "# TODO no"\n"""\n# FIXME no\n"""\n# FIXME yes\ny = \'\'  # hack [1]\n'
    assert repository.comment_markers(python, "python") == [("fixme", 5, 5), ("hack", 6, 6)]


def test_ignore_rules(spark):
    rules = files.ignore_rules("*.log\n!keep.log\n/only/\nsub/**/x\n", "base")
    paths = {"a.log": False, "base/a.log": True, "base/d/a.log": True, "base/keep.log": False, "base/only/f": True, "base/d/only/f": False, "base/sub/x": True, "base/sub/1/2/x": True, "base/y": False}
    got = {r.path: r.x for r in spark.createDataFrame([(p,) for p in paths], "path string").select("path", files.ignored(F.col("path"), rules).alias("x")).collect()}
    assert got == paths


def test_validators_run(spark):
    claims = spark.createDataFrame([(1, [1]), (2, [])], "claim_id long, evidence_ids array<long>")
    made = [validators.Failing("citation", validators.uncited_claims), validators.Failing("none", lambda c: c.limit(0))]
    passed, checks = validators.run_all(made, claims)
    assert not passed and [(c.name, c.passed) for c in checks] == [("citation", False), ("none", True)]


def test_a_query_has_a_bounded_number_of_tokens(spark):
    tokens = spark.createDataFrame([(i, [1.0]) for i in range(vectors.MOST_QUERY_TOKENS + 1)], "q int, qv array<float>")
    docs = spark.createDataFrame([(1, [2.0]), (1, [3.0])], "doc_id long, dv array<float>")
    with pytest.raises(ValueError):
        vectors.max_sim(tokens, docs)
    assert vectors.max_sim(tokens.filter("q < 2"), docs).first().score == 6.0


def test_sparse_vectors_from_postings(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, "")], "doc_id long, text string")
    rows = lambda df: sorted((r.id, r.term_id, round(r.weight, 9)) for r in df.collect())
    assert rows(vectors.sparse_vectors(lexical.postings(docs))) == rows(vectors.hashed_terms(docs, text.tokens(F.col("text"))))
