"""Registered queries of the code index, over source files made from the parts table, with their twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import chunking, code, repository
from siltstone.queries import query
from siltstone.plans import extensions, planner
from siltstone.session import table
from siltstone.sources import files
from siltstone.streaming import events as streams

#: One source file a part, in three languages; {k} is the part's key, {b} its base class, {n} its name.
PYTHON = 'import json\nfrom pkg.base import Base\n\n\nclass Item{k}({b}):\n    """Sells {n}."""\n\n    def price(self):\n        # TODO: taxes, "# FIXME no"\n        return helper{k}(self.amount)\n\n\ndef helper{k}(x):\n    return "# HACK no"\n\n\ndef test_item{k}():\n    assert helper{k}(1)\n'
RUST = 'use std::fmt;\n\n/// Holds {n}.\npub struct Point{k} {\n    x: i32,\n}\n\nimpl Point{k} {\n    pub fn norm(&self) -> i32 {\n        // FIXME later\n        unsafe { helper{k}(self.x, "// TODO no") }\n    }\n}\n\nfn helper{k}(x: i32) -> i32 {\n    x\n}\n\n#[test]\nfn test_norm{k}() {\n    helper{k}(1);\n}\n'
SCRIPT = "import { api } from './api';\n\nexport class Cart{k} extends Basket {\n  total() {\n    return sum{k}(1);\n  }\n}\n\nexport const sum{k} = (x: number) => {\n  return x;\n};\n"


def _filled(template: str) -> Column:
    k = F.col("p_partkey")
    base = F.when((k % 9 == 0), F.concat(F.lit("Item"), (k - 3).cast("string"))).otherwise("Base")
    return F.replace(F.replace(F.replace(F.lit(template), F.lit("{k}"), k.cast("string")), F.lit("{b}"), base), F.lit("{n}"), F.col("p_name"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p_partkey, path, text``."""
    k = F.col("p_partkey")
    name, folder = k.cast("string"), (k % 20).cast("string")
    path = F.when(k % 3 == 0, F.concat(F.lit("pkg"), folder, F.lit("/mod"), name, F.lit(".py"))).when(k % 3 == 1, F.concat(F.lit("crate"), folder, F.lit("/src/m"), name, F.lit(".rs")))
    text = F.when(k % 3 == 0, _filled(PYTHON)).when(k % 3 == 1, _filled(RUST)).otherwise(_filled(SCRIPT))
    return table(spark, sf_dir, "part").select("p_partkey", path.otherwise(F.concat(F.lit("web/c"), name, F.lit(".ts"))).alias("path"), text.alias("text"))


_PATH = "CASE k % 3 WHEN 0 THEN 'pkg' || k % 20 || '/mod' || k || '.py' WHEN 1 THEN 'crate' || k % 20 || '/src/m' || k || '.rs' ELSE 'web/c' || k || '.ts' END"
#: (remainder, kind, name, qualified name, first line, last line), in SQL over k and path.
_SHAPES = [
    (0, "module", "'mod' || k", "'pkg' || k % 20 || '.mod' || k", 1, 19),
    (0, "class", "'Item' || k", "'pkg' || k % 20 || '.mod' || k || '.Item' || k", 5, 10),
    (0, "function", "'price'", "'pkg' || k % 20 || '.mod' || k || '.Item' || k || '.price'", 8, 10),
    (0, "function", "'helper' || k", "'pkg' || k % 20 || '.mod' || k || '.helper' || k", 13, 14),
    (0, "function", "'test_item' || k", "'pkg' || k % 20 || '.mod' || k || '.test_item' || k", 17, 18),
    (1, "struct", "'Point' || k", "'Point' || k", 4, 6),
    (1, "impl", "'Point' || k", "'Point' || k", 8, 13),
    (1, "fn", "'norm'", "'Point' || k || '::norm'", 9, 12),
    (1, "fn", "'helper' || k", "'helper' || k", 15, 17),
    (1, "fn", "'test_norm' || k", "'test_norm' || k", 20, 22),
    (2, "class", "'Cart' || k", "path || '::Cart' || k", 3, 7),
    (2, "method", "'total'", "path || '::Cart' || k || '::total'", 4, 6),
    (2, "function", "'sum' || k", "path || '::sum' || k", 9, 11),
]
_SYMBOLS = f"src AS (SELECT p_partkey AS k, p_name AS n, {_PATH.replace('k ', 'p_partkey ').replace('|| k', '|| p_partkey')} AS path FROM part),\n  sym AS (" + " UNION ALL ".join(
    f"SELECT k, n, path AS file_path, '{kind}' AS kind, {name} AS name, {qualified} AS qualified_name, {a} AS start_line, {b} AS end_line FROM src WHERE k % 3 = {r}" for r, kind, name, qualified, a, b in _SHAPES
) + ")"
_SHOWN = "file_path, start_line, end_line, qualified_name, kind"


_TABLES: dict[tuple[str, str], DataFrame] = {}


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written code index of these files: extracted once a session, and read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = planner.Engine(spark).index_code(source_files(spark, sf_dir)).symbols
    return _TABLES[key]


def _found(spark: SparkSession, sf_dir: str, kind: str, value: str | None) -> DataFrame:
    return code.query(symbols(spark, sf_dir), code.matches(kind, value), 20).select("file_path", "start_line", "end_line", "qualified_name", "kind", "matched", "truncated")


def _twin(condition: str) -> str:
    return f"WITH {_SYMBOLS}, hit AS (SELECT * FROM sym WHERE {condition}) SELECT {_SHOWN}, (SELECT count(*) FROM hit) AS matched, (SELECT count(*) FROM hit) > 20 AS truncated FROM hit ORDER BY file_path, start_line, qualified_name LIMIT 20"


@query(_twin("contains(name, 'per1') OR contains(qualified_name, 'per1')"))
def code_symbol(spark, sf_dir):
    return _found(spark, sf_dir, "symbol", "per1")


@query(_twin("contains(file_path, 'crate7/src')"))
def code_path(spark, sf_dir):
    return _found(spark, sf_dir, "path", "crate7/src")


@query(_twin("regexp_matches(name, '^(test_item|Cart)[0-9]*5$')"))
def code_regex(spark, sf_dir):
    return _found(spark, sf_dir, "regex", "^(test_item|Cart)[0-9]*5$")


@query(_twin("(kind = 'class' AND k % 3 = 0 AND contains('Sells ' || n || '.', 'Sells a')) OR (kind = 'struct' AND contains('Holds ' || n || '.', 'Sells a'))"))
def code_doc(spark, sf_dir):
    return _found(spark, sf_dir, "doc", "Sells a")


@query(_twin("kind IN ('impl', 'fn') AND start_line IN (8, 9)"))
def code_markers(spark, sf_dir):
    return _found(spark, sf_dir, "marker", "unsafe")


@query(_twin("true"))
def code_all(spark, sf_dir):
    return _found(spark, sf_dir, "all", None)


@query(f"WITH {_SYMBOLS} SELECT file_path, qualified_name, start_line FROM sym WHERE k % 10 = 0")
def code_changed(spark, sf_dir):
    touched = source_files(spark, sf_dir).filter("p_partkey % 10 = 0").select(F.col("path").alias("file_path"))
    return code.changed(symbols(spark, sf_dir), touched).select("file_path", "qualified_name", "start_line")


@query(f"WITH {_SYMBOLS} SELECT file_path, start_line, CASE WHEN k % 3 = 0 THEN 'todo' ELSE 'fixme' END AS kind FROM sym WHERE (k % 3 = 0 AND start_line IN (5, 8)) OR (k % 3 = 1 AND start_line IN (8, 9))")
def code_marker_kinds(spark, sf_dir):
    """Marked symbols by kind: what strings hold is no comment."""
    s = symbols(spark, sf_dir)
    out = None
    for kind in ("todo", "fixme", "hack"):
        one = s.filter(code.has_marker(F.col("markers"), F.col("is_unsafe"), kind)).select("file_path", "start_line", F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_SYMBOLS} SELECT DISTINCT file_path AS path, CASE WHEN k % 3 = 0 THEN 'todo' ELSE 'fixme' END AS kind, CASE WHEN k % 3 = 0 THEN 9 ELSE 10 END AS start_line, CASE WHEN k % 3 = 0 THEN 9 ELSE 10 END AS end_line FROM sym WHERE k % 3 <> 2")
def comment_markers(spark, sf_dir):
    return repository.markers(source_files(spark, sf_dir))


_ID = "s.file_path || '#' || s.qualified_name || '@' || s.start_line"
_EDGES = f"""ids AS (SELECT *, file_path || '#' || qualified_name || '@' || start_line AS id FROM sym), uniq AS (SELECT name, any_value(id) AS id FROM ids GROUP BY 1 HAVING count(*) = 1),
  calls AS (SELECT i.id AS src, i.name AS sname, u.id AS dst FROM ids i JOIN uniq u ON u.name = CASE k % 3 WHEN 2 THEN 'sum' || k ELSE 'helper' || k END WHERE (k % 3 = 0 AND start_line IN (5, 8, 17)) OR (k % 3 = 1 AND start_line IN (9, 20)) OR (k % 3 = 2 AND start_line IN (3, 4))
    UNION ALL SELECT i.id, i.name, u.id FROM ids i JOIN uniq u ON u.name = 'total' WHERE k % 3 = 2 AND start_line = 3),
  edges AS (SELECT 'Defines' AS kind, o.id AS source_record_id, i.id AS target_record_id, 1000 AS confidence_milli FROM ids o JOIN ids i ON o.file_path = i.file_path AND o.id <> i.id AND o.qualified_name = regexp_replace(i.qualified_name, '(\\.|::)[^.:]+$', '')
    UNION SELECT 'Calls', src, dst, 800 FROM calls WHERE src <> dst UNION SELECT 'Tests', src, dst, 800 FROM calls WHERE starts_with(sname, 'test_') AND src <> dst
    UNION SELECT 'Implements', i.id, u.id, 900 FROM ids i JOIN uniq u ON u.name = 'Item' || (k - 3) WHERE k % 9 = 0 AND i.kind = 'class')"""


@query(f"WITH {_SYMBOLS}, {_EDGES} SELECT * FROM edges")
def code_relations(spark, sf_dir):
    return code.relations(symbols(spark, sf_dir))


@query(f"WITH {_SYMBOLS}, {_EDGES} SELECT i.qualified_name, i.file_path, i.start_line, e.kind FROM edges e JOIN ids i ON i.id = e.source_record_id JOIN ids t ON t.id = e.target_record_id WHERE t.name IN ('helper3', 'helper7', 'Item6')")
def code_references(spark, sf_dir):
    found = symbols(spark, sf_dir)
    seeds = found.filter(F.col("name").isin("helper3", "helper7", "Item6"))
    return code.references(found, code.relations(found), seeds).select("qualified_name", "file_path", "start_line", "kind")


_SPANS = {0: [(1, 4), (5, 7), (8, 12), (13, 16), (17, 19)], 1: [(1, 3), (4, 7), (8, 8), (9, 14), (15, 18), (19, 23)], 2: [(1, 2), (3, 12)]}
_CHUNKED = " UNION ALL ".join(f"SELECT p_partkey AS doc_id, {i} AS ord, {a} AS start_line, {b} AS end_line FROM part WHERE p_partkey % 3 = {r}" for r, spans in _SPANS.items() for i, (a, b) in enumerate(spans))


@query(_CHUNKED)
def source_chunks(spark, sf_dir):
    rows = source_files(spark, sf_dir).withColumnRenamed("p_partkey", "doc_id")
    out = None
    for ending, name in ((".py", "python"), (".rs", "rust"), (".ts", "typescript")):
        one = chunking.structural_chunks(rows.filter(F.col("path").endswith(ending)), *chunking.language_rules(name))
        out = one if out is None else out.unionByName(one)
    return out.select("doc_id", "ord", "start_line", "end_line")


#: A manifest a part: kinds by key, with a name, a version and two dependencies.
MANIFESTS = [
    ("Cargo.toml", '[package]\nname = "crate{k}"\nversion = "0.{k}.1"\n\n[dependencies]\nserde = "1"\n\n[dev-dependencies]\ndep{k} = { version = "2" }\n'),
    ("pyproject.toml", '[project]\nname = "py{k}"\nversion = "1.{k}"\ndependencies = ["requests>=2", "dep{k}[x]; python_version > \'3\'"]\n'),
    ("setup.cfg", "[metadata]\nname = cfg{k}\n\n[options]\ninstall_requires =\n    dep{k}>1\n    attrs\n"),
    ("setup.py", "from setuptools import setup\nsetup(name='old{k}', version=\"{k}.0\", install_requires=['dep{k}', 'six'])\n"),
    ("package.json", '{"name": "js{k}", "version": "{k}.2.3", "dependencies": {"react": "18", "dep{k}": "1"}}'),
    ("package.json", '{"version": '),
    ("Cargo.toml", '[workspace]\nmembers = ["a"]\n'),
]


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = k % len(MANIFESTS)
    pick = lambda at: F.element_at(F.array(*[F.lit(m[at]) for m in MANIFESTS]), (kind + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("m"), k.cast("string"), F.lit("/"), pick(0)).alias("path"), F.replace(pick(1), F.lit("{k}"), k.cast("string")).alias("text"))


@query(
    """WITH m AS (SELECT p_partkey AS k, p_partkey % 7 AS t FROM part)
  SELECT 'm' || k || '/' || ['Cargo.toml', 'pyproject.toml', 'setup.cfg', 'setup.py', 'package.json', 'package.json'][t + 1] AS manifest, ['cargo', 'python', 'python', 'python', 'javascript', 'javascript'][t + 1] AS ecosystem,
    CASE t WHEN 0 THEN 'crate' || k WHEN 1 THEN 'py' || k WHEN 2 THEN 'cfg' || k WHEN 3 THEN 'old' || k WHEN 4 THEN 'js' || k ELSE 'm' || k END AS name, CASE t WHEN 0 THEN '0.' || k || '.1' WHEN 1 THEN '1.' || k WHEN 3 THEN k || '.0' WHEN 4 THEN k || '.2.3' ELSE '0.0.0' END AS version,
    CASE t WHEN 0 THEN 'dep' || k || ',serde' WHEN 1 THEN 'dep' || k || ',requests' WHEN 2 THEN 'attrs,dep' || k WHEN 3 THEN 'dep' || k || ',six' WHEN 4 THEN 'dep' || k || ',react' ELSE '' END AS dependencies, t = 5 AS warned FROM m WHERE t <> 6"""
)
def packages(spark, sf_dir):
    found = repository.packages(manifests(spark, sf_dir))
    return found.select("manifest", "ecosystem", "name", "version", F.array_join("dependencies", ",").alias("dependencies"), F.col("warning").isNotNull().alias("warned"))


@query(
    """WITH p AS (SELECT p_partkey AS k FROM part), c AS (SELECT k, k % 3 AS t, 's' AS f FROM p UNION ALL SELECT k, k % 7, 'm' FROM p)
  SELECT CASE WHEN f = 's' THEN ['python', 'rust', 'typescript'][t + 1] WHEN t IN (0, 6) THEN 'cargo_toml' WHEN t = 3 THEN 'python' ELSE 'generic_text' END AS parser, count(*) AS files,
    sum(CASE WHEN f = 's' THEN [5, 6, 2][t + 1] ELSE [3, 1, 2, 1, 1, 1, 1][t + 1] END)::BIGINT AS chunks FROM c GROUP BY 1"""
)
def parsed_files(spark, sf_dir):
    """Chunks by the parser that takes a file: sources and manifests of every part."""
    k = F.col("p_partkey")
    sources = source_files(spark, sf_dir).select((k * 2).alias("doc_id"), "path", "text")
    joined = table(spark, sf_dir, "part").select(k, F.concat(F.lit("m"), k.cast("string"), F.lit("/")).alias("folder"))
    named = manifests(spark, sf_dir).withColumn("folder", F.regexp_extract("path", "^(m[0-9]+/)", 1)).join(joined, "folder")
    chunks = extensions.parse(sources.unionByName(named.select((k * 2 + 1).alias("doc_id"), "path", "text")))
    return chunks.groupBy("parser").agg(F.count_distinct("doc_id").alias("files"), F.count("*").alias("chunks"))


#: Rust files with what tells web routes, queries, build scripts and generated code.
FRAMED = [("build.rs", 'println!("cargo:rerun-if-changed=x");'), ("a.pb.rs", "fn a() {}"), ("r.rs", '#[axum::get("/")]\nfn h() {}\nlet app = Router::new().route("/x", post(h));'), ("q.rs", 'sqlx::query_as!(T, "select 1").fetch_all(&db);\nlet x = requery(1);'), ("g.rs", "// Do not EDIT\nfn b() {}"), ("p.rs", "fn plain() {}")]


@query(
    """WITH m AS (SELECT p_partkey AS k, p_partkey % 6 AS t FROM part) SELECT k || '/' || ['build.rs', 'a.pb.rs', 'r.rs', 'q.rs', 'g.rs', 'p.rs'][t + 1] AS path, t = 0 AS build_script, t IN (1, 4) AS generated_code,
    CASE t WHEN 2 THEN 'get,route' ELSE '' END AS routes, CASE t WHEN 3 THEN 'fetch_all,query_as' ELSE '' END AS queries FROM m"""
)
def framework_markers(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda at: F.element_at(F.array(*[F.lit(m[at]) for m in FRAMED]), (k % len(FRAMED) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.concat(k.cast("string"), F.lit("/"), pick(0)).alias("path"), pick(1).alias("text"))
    found = repository.framework_markers(F.col("path"), F.col("text"))
    return rows.select("path", *[(F.array_join(c, ",") if n in ("routes", "queries") else c).alias(n) for n, c in found.items()])


@query(
    f"""WITH {_SYMBOLS}, c AS (SELECT CASE WHEN k % 10 = 0 THEN 'fresh' ELSE 'kept' END AS origin, count(*) AS n FROM sym GROUP BY 1) SELECT origin, n + CASE WHEN origin = 'fresh' THEN (SELECT count(*) FROM part WHERE p_partkey % 30 = 0) ELSE 0 END AS n FROM c
  UNION ALL SELECT 'only in the full rebuild', 0 UNION ALL SELECT 'only in this one', 0 UNION ALL SELECT 'mode incremental', 1"""
)
def incremental_rebuild(spark, sf_dir):
    """A tenth of the files change (Python ones gain a function): rows that are kept, those extracted anew, and how they
    differ from a full rebuild."""
    old = source_files(spark, sf_dir)
    gained = F.when(F.col("p_partkey") % 30 == 0, "\n\ndef added():\n    pass\n").when(F.col("p_partkey") % 10 == 0, "\n").otherwise("")
    new = old.withColumn("text", F.concat("text", gained))
    hashed = lambda df: df.select("path", F.md5("text").alias("hash"))
    delta = streams.snapshot_delta(hashed(old), hashed(new))
    mode = repository.rebuild_mode(code.symbols(old), delta)
    shown = lambda df: df.select("file_path", "qualified_name", "start_line", F.array_join("calls", ",").alias("calls"))
    made = repository.rebuild(code.symbols(old), new.select("path", "text"), delta, code.symbols)
    full, part = shown(code.symbols(new)), shown(made)
    kept = made.join(delta.select(F.col("path").alias("file_path")), "file_path", "left_anti").agg(F.count("*").alias("n"))
    fresh = made.join(delta.select(F.col("path").alias("file_path")), "file_path", "left_semi").agg(F.count("*").alias("n"))
    counts = [("fresh", fresh), ("kept", kept), ("only in the full rebuild", full.exceptAll(part).agg(F.count("*").alias("n"))), ("only in this one", part.exceptAll(full).agg(F.count("*").alias("n")))]
    out = spark.createDataFrame([(f"mode {mode}", 1)], "origin string, n long")
    for name, df in counts:
        out = out.unionByName(df.select(F.lit(name).alias("origin"), "n"))
    return out


@query(
    """SELECT 'same' AS what, 'Current' AS freshness UNION ALL SELECT 'edited', 'Stale' UNION ALL SELECT 'edited elsewhere', 'Current' UNION ALL SELECT 'other commit', 'Stale' UNION ALL SELECT 'reordered', 'Current' UNION ALL SELECT 'swapped', 'Stale'"""
)
def worktree_freshness(spark, sf_dir):
    """Identity of the files below two folders, against itself, edited copies and other commits."""
    rows = source_files(spark, sf_dir).select("path", F.md5("text").alias("hash"))
    selected = ["pkg0", "pkg3", "crate7"]
    identity = lambda df: repository.worktree_identity(df, selected).first().identity
    first = identity(rows)
    edited = identity(rows.withColumn("hash", F.when(F.col("path").startswith("crate7/"), "x").otherwise(F.col("hash"))))
    elsewhere = identity(rows.withColumn("hash", F.when(F.col("path").startswith("web/"), "x").otherwise(F.col("hash"))))
    swapped = identity(rows.withColumn("path", F.when(F.col("path").startswith("pkg3/"), F.concat("path", F.lit("~"))).otherwise(F.col("path"))))
    cases = [("same", "c", first), ("edited", "c", edited), ("edited elsewhere", "c", elsewhere), ("other commit", "d", first), ("reordered", "c", identity(rows.orderBy(F.desc("path")))), ("swapped", "c", swapped)]
    told = spark.createDataFrame([(w, "c", first, c, i) for w, c, i in cases], "what string, a string, b string, c string, d string")
    return told.select("what", repository.freshness(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("freshness"))


IGNORE = "*.tmp\n/build/\ndocs/*.txt\n!docs/keep.txt\nlog?[0-9]/\n# comment\n**/cache/**\n"
_TREE = ["src/a.rs", "src/.hidden/b.rs", "node_modules/x.js", "docs/c.txt", "docs/keep.txt", "out/d.tmp", "build/e.rs", "sub/build/f.rs", "logs1/g.md", "my.egg-info/h.md", "a/cache/i/j.md", "secrets/k.md", "README.md", "id.pem"]


@query(f"SELECT p_partkey || '/' || f AS path FROM part, (SELECT unnest({_TREE}) AS f) WHERE f IN ('src/a.rs', 'docs/c.txt', 'docs/keep.txt', 'README.md')")
def repository_scan(spark, sf_dir):
    """Files that a repository scan takes of a tree below each part; ignore rules are those of the root."""
    names = F.explode(F.array(*[F.lit(x) for x in _TREE])).alias("f")
    rows = table(spark, sf_dir, "part").select("p_partkey", names).select(F.concat_ws("/", F.col("p_partkey").cast("string"), "f").alias("path"))
    return repository.repository_files(rows, files.ignore_rules(IGNORE))


@query(
    f"""WITH src AS (SELECT p_partkey AS k, {_PATH.replace('k ', 'p_partkey ').replace('|| k', '|| p_partkey')} AS path, p_size::BIGINT AS b FROM part),
  parts AS (SELECT string_split(path, '/') AS p, b FROM src), up AS (SELECT array_to_string(p[1:i], '/') AS directory, lower(regexp_extract(p[len(p)], '\\.([^.]*)$', 1)) AS e, b FROM (SELECT p, b, unnest(range(0, len(p))) AS i FROM parts)),
  d AS (SELECT directory, count(*) AS file_count, sum(b)::BIGINT AS total_bytes, count(*) FILTER (e IN ('rs', 'py', 'ts')) * 10000 // count(*) AS code FROM up GROUP BY 1)
  SELECT directory, file_count, total_bytes, CASE WHEN directory = '' THEN 'Recommended' WHEN code >= 2000 AND file_count <= 2000 THEN 'Recommended' ELSE 'Maybe' END AS class FROM d"""
)
def candidate_tree(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("bytes"))
    rows = source_files(spark, sf_dir).join(sizes, "p_partkey").select("path", "bytes", F.lit(False).alias("minified"))
    return repository.candidate_tree(rows).select("directory", "file_count", "total_bytes", "class")


@query(
    f"""WITH src AS (SELECT p_partkey AS k, {_PATH.replace('k ', 'p_partkey ').replace('|| k', '|| p_partkey')} AS path, p_size::BIGINT AS b FROM part),
  parts AS (SELECT string_split(path, '/') AS p, b FROM src), up AS (SELECT p[1:i] AS d, b FROM (SELECT p, b, unnest(range(0, len(p))) AS i FROM parts)),
  g AS (SELECT array_to_string(d, '/') AS directory, len(d) AS depth, array_to_string(d[1:len(d) - 1], '/') AS parent, count(*) AS n, sum(b) AS b FROM up GROUP BY d),
  r AS (SELECT *, CASE WHEN depth > 0 THEN row_number() OVER (PARTITION BY depth = 0, parent ORDER BY n DESC, b DESC, directory) ELSE 1 END AS nth FROM g WHERE depth <= 2),
  one AS (SELECT * FROM r WHERE depth <= 1 AND nth <= 12) SELECT directory, depth FROM one UNION ALL SELECT directory, depth FROM r WHERE depth = 2 AND nth <= 12 AND parent IN (SELECT directory FROM one)"""
)
def bounded_tree(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("bytes"))
    rows = source_files(spark, sf_dir).join(sizes, "p_partkey").select("path", "bytes", F.lit(False).alias("minified"))
    return repository.bounded_tree(repository.candidate_tree(rows)).select("directory", "depth")


@query(
    """SELECT p_partkey, ref, CASE WHEN regexp_full_match(ref, '[0-9A-Fa-f]+') THEN length(ref) BETWEEN 7 AND 40 ELSE ref IN ('HEAD', 'HEAD~', 'HEAD^', 'HEAD~2', 'HEAD^1') OR regexp_full_match(ref, 'HEAD~[0-9]+') END AS plausible FROM (SELECT p_partkey,
    CASE p_partkey % 9 WHEN 0 THEN substr(md5(p_name), 1, 5 + p_partkey % 30) WHEN 1 THEN upper(md5(p_name)) WHEN 2 THEN 'HEAD' WHEN 3 THEN 'HEAD~' || p_partkey WHEN 4 THEN 'HEAD^1' WHEN 5 THEN 'HEAD~1~1' WHEN 6 THEN 'HEAD~x' WHEN 7 THEN 'main' ELSE md5(p_name) || md5(p_brand) END AS ref FROM part)"""
)
def commit_references(spark, sf_dir):
    k, h = F.col("p_partkey"), F.md5("p_name")
    ref = F.when(k % 9 == 0, F.substring(h, F.lit(1), (5 + k % 30).cast("int"))).when(k % 9 == 1, F.upper(h)).when(k % 9 == 2, "HEAD").when(k % 9 == 3, F.concat(F.lit("HEAD~"), k.cast("string"))).when(k % 9 == 4, "HEAD^1")
    ref = ref.when(k % 9 == 5, "HEAD~1~1").when(k % 9 == 6, "HEAD~x").when(k % 9 == 7, "main").otherwise(F.concat(h, F.md5("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", ref.alias("ref")).withColumn("plausible", text.plausible_commit(F.col("ref")))
