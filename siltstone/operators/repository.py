"""Repositories as tables of files: packages, framework and comment markers, identity, freshness, candidate trees.

Files are ``path, text`` or ``path, hash`` rows; nothing is executed and no version control
is asked: content hashes tell what changed.
"""

from __future__ import annotations

import configparser
import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.sources import files as sources

# ---- packages -----------------------------------------------------------------------------------

PACKAGES = "manifest string, ecosystem string, name string, version string, dependencies array<string>, warning string"
MANIFESTS = ("Cargo.toml", "pyproject.toml", "setup.cfg", "setup.py", "package.json")
_REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)")
_KEYWORD = r"""\b{}\s*=\s*(['"])([^'"]*)\1"""


def _names(requirements: list) -> list[str]:
    found = (_REQUIREMENT.match(r) for r in requirements if isinstance(r, str))
    return sorted({m[1] for m in found if m})


def package(path: str, text: str | None) -> dict | None:
    """Name, version and dependencies of a manifest. Without a name the folder's is taken, without a version 0.0.0; a
    manifest that can't be read gives a warning, never an error. Cargo workspaces without a package give none."""
    folder, _, file = path.rpartition("/")
    name, version, needs, warning = None, None, [], None
    try:
        if file == "Cargo.toml":
            spec = tomllib.loads(text or "")
            if "package" not in spec:
                return None
            ecosystem, own = "cargo", spec["package"]
            name, version = own.get("name"), own.get("version")
            needs = sorted({n for section in ("dependencies", "dev-dependencies", "build-dependencies") for n in spec.get(section, {})})
        elif file == "pyproject.toml":
            ecosystem, own = "python", tomllib.loads(text or "").get("project") or {}
            name, version, needs = own.get("name"), own.get("version"), _names(own.get("dependencies", []))
        elif file == "setup.cfg":
            ecosystem, spec = "python", configparser.ConfigParser(interpolation=None)
            spec.read_string(text or "")
            if spec.has_section("metadata"):
                name, version = spec["metadata"].get("name"), spec["metadata"].get("version")
            if spec.has_section("options"):
                needs = _names(spec["options"].get("install_requires", "").splitlines())
        elif file == "setup.py":
            ecosystem = "python"
            name, version = (m[2] if (m := re.search(_KEYWORD.format(k), text or "")) else None for k in ("name", "version"))
            listed = re.search(r"install_requires\s*=\s*\[([^\]]*)\]", text or "")
            needs = _names(re.findall(r"['\"]([^'\"]+)['\"]", listed[1])) if listed else []
        else:
            ecosystem, spec = "javascript", json.loads(text or "{}")
            name, version = spec.get("name"), spec.get("version")
            needs = sorted({n for section in ("dependencies", "devDependencies", "peerDependencies") for n in spec.get(section) or {}})
    except (ValueError, TypeError, AttributeError, configparser.Error) as e:
        ecosystem, warning = {"Cargo.toml": "cargo", "package.json": "javascript"}.get(file, "python"), f"{path}: {type(e).__name__}"
    fallback = folder.rpartition("/")[2] or "repository"
    return {"manifest": path, "ecosystem": ecosystem, "name": name or fallback, "version": version or "0.0.0", "dependencies": needs, "warning": warning}


def packages(files: DataFrame) -> DataFrame:
    """Packages of the manifests among ``files (path, text)``, whose parsers are Python's own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [p for path, text in zip(batch["path"], batch["text"], strict=True) if (p := package(path, text))]
            yield pd.DataFrame(found, columns=[c.split(" ")[0] for c in PACKAGES.split(", ")])

    return files.filter(sources.file_name(F.col("path")).isin(*MANIFESTS)).select("path", "text").mapInPandas(run, PACKAGES)


# ---- markers ------------------------------------------------------------------------------------

# Names by which web routes and database queries are told.
ROUTE_NAMES = ["get", "post", "put", "delete", "patch", "head", "options", "trace", "route", "any", "connect", "fallback", "router"]
QUERY_NAMES = ["query", "query_as", "query_scalar", "query_file", "query_one", "fetch", "fetch_optional", "fetch_all"]


def framework_markers(path: Column, text: Column) -> dict[str, Column]:
    """``build_script, generated_code, routes, queries`` of a Rust file: by its name and text, route attributes and
    methods, and calls or macros whose names begin like a query's."""
    name, lower = F.lower(sources.file_name(path)), F.lower(text)
    names = "|".join(ROUTE_NAMES)
    routes = F.array_union(F.regexp_extract_all(text, F.lit(rf"#\[(?:\w+::)*({names})\b"), 1), F.regexp_extract_all(text, F.lit(rf"\.({names})\s*\("), 1))
    queries = F.regexp_extract_all(text, F.lit(rf"\b((?:{'|'.join(QUERY_NAMES)})\w*)\s*(?:::<[^>]*>)?\s*!?\s*\("), 1)
    return {
        "build_script": (name == "build.rs") | lower.contains("cargo:rerun-if-changed"),
        "generated_code": name.endswith(".generated.rs") | name.endswith(".pb.rs") | lower.contains("generated") | lower.contains("do not edit"),
        "routes": F.array_sort(F.array_distinct(routes)),
        "queries": F.array_sort(F.array_distinct(queries)),
    }


_MARK = re.compile(r"^[!*]?\s*(TODO|FIXME|HACK)(?=[\s(\[:]|$)", re.I)
# what a scanner of code steps over: raw strings, strings, characters, then comments
_TOKENS = {
    "c": re.compile(r"""b?r(?P<h>\#*)".*?"(?P=h)|"(?:\\.|[^"\\])*"?|'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'|`(?:\\.|[^`\\])*`?|//(?P<line>[^\n]*)|/\*(?P<block>.*?)(?:\*/|\Z)""", re.S),
    "python": re.compile(r"""[rbuf]{0,2}(?:\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|\#(?P<line>[^\n]*)""", re.S | re.I),
}


def comment_markers(text: str, language: str) -> list[tuple[str, int, int]]:
    """(kind, first line, last line) of comments that open with TODO, FIXME or HACK, in any case; what is inside a string
    or character is no comment. ``language`` is python, or anything with comments like C's."""
    out = []
    for m in _TOKENS["python" if language == "python" else "c"].finditer(text):
        parts = m.groupdict()
        comment = parts.get("line") if parts.get("line") is not None else parts.get("block")
        if comment is not None and (found := _MARK.match(comment)):
            first = text.count("\n", 0, m.start()) + 1
            out.append((found[1].lower(), first, first + m[0].count("\n")))
    return out


def markers(files: DataFrame) -> DataFrame:
    """``path, kind, start_line, end_line`` of the comment markers in ``files (path, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *m) for p, t in zip(batch["path"], batch["text"], strict=True) if t for m in comment_markers(t, "python" if p.endswith(".py") else "c")]
            yield pd.DataFrame(rows, columns=["path", "kind", "start_line", "end_line"])

    return files.select("path", "text").mapInPandas(run, "path string, kind string, start_line int, end_line int")


# ---- identity -----------------------------------------------------------------------------------


def worktree_identity(files: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """One row ``files, identity`` of ``files (path, hash)`` below the selected paths (none: all). Equal sets of paths
    and contents have equal identities, in whatever order: sums of hashes combine on the map side."""
    inside = F.lit(True)
    if selected:
        inside = F.lit(False)
        for s in selected:
            inside = inside | (F.col("path") == s) | F.col("path").startswith(s + "/")
    digest = F.sha2(F.concat_ws("\n", F.length("path").cast("string"), "path", "hash"), 256)
    part = lambda i: F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")
    sums = files.filter(inside).agg(F.count("*").alias("files"), *[F.coalesce(F.sum(part(i)), F.lit(0).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)])
    return sums.select("files", F.sha2(F.concat_ws(":", F.col("files").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("identity"))


def freshness(indexed_commit: Column, indexed_identity: Column, commit: Column, identity: Column) -> Column:
    """Current only if both the commit and the worktree are those that were indexed."""
    return F.when(indexed_commit.eqNullSafe(commit) & indexed_identity.eqNullSafe(identity), "Current").otherwise("Stale")


def rebuild_mode(indexed: DataFrame | None, delta: DataFrame) -> str:
    """What a rebuild has to do: everything without an index, nothing without changes."""
    if indexed is None:
        return "full"
    return "noop" if delta.isEmpty() else "incremental"


def rebuild(indexed: DataFrame, files: DataFrame, delta: DataFrame, extract) -> DataFrame:
    """The symbol table after a change: rows of untouched files, and ``extract`` of added and changed ones."""
    touched = delta.select(F.col("path").alias("file_path"))
    fresh = files.join(delta.filter("change <> 'removed'").select("path"), "path", "left_semi")
    return indexed.join(touched, "file_path", "left_anti").unionByName(extract(fresh))


# ---- trees --------------------------------------------------------------------------------------


def repository_files(files: DataFrame, rules: list[tuple[str, bool]] | None = None) -> DataFrame:
    """Files of a repository scan among ``files (path, ...)``, sorted: no hidden ones, none of private names or below
    output folders, none that ignore rules exclude."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda x: x.startswith("."))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = F.exists(folders, lambda x: x.isin(*sources.REPOSITORY_SKIPPED) | x.endswith(".egg-info"))
    return files.filter(~hidden & ~skipped & ~sources.is_excluded(F.col("path")) & ~sources.ignored(F.col("path"), rules or [])).orderBy("path")


def candidate_tree(files: DataFrame, documents: list[str] = sources.REPOSITORY_DOC_EXTENSIONS, code: list[str] = sources.REPOSITORY_CODE_EXTENSIONS) -> DataFrame:
    """Every directory of ``files (path, bytes, minified)`` with its features and class; the root (empty) is recommended.

    A file counts for each folder above it, so rows grow with the paths' depth.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = files.select(F.explode(above).alias("directory"), sources.extension(F.col("path")).alias("extension"), "bytes", "minified")
    made = sources.directory_features(rows, documents, code)
    found = F.when(F.col("directory") == "", "Recommended").otherwise(sources.directory_class(F.lit(False)))
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))
    return made.withColumn("class", found).withColumn("depth", depth).withColumn("parent", F.when(F.col("depth") > 0, F.regexp_replace("directory", "/?[^/]*$", "")))


def bounded_tree(tree: DataFrame, max_depth: int = 2, max_children: int = 12) -> DataFrame:
    """The tree for display: down to ``max_depth``, of each directory the ``max_children`` largest by files, then bytes."""
    order = Window.partitionBy("parent").orderBy(F.desc("file_count"), F.desc("total_bytes"), "directory")
    ranked = tree.filter(F.col("depth") <= max_depth).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max_children)
    kept = ranked.filter("depth <= 1")
    for depth in range(2, max_depth + 1):
        below = ranked.filter(F.col("depth") == depth)
        kept = kept.unionByName(below.join(kept.select(F.col("directory").alias("parent")), "parent", "left_semi").select(*ranked.columns))
    return kept.drop("nth")
