"""File sources: scans, eligibility, exclusions, content-addressed blobs, web metadata."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that are read, and names and extensions that never are.
SOURCE_EXTENSIONS = ["md", "markdown", "txt", "text", "rs", "toml", "json", "yaml", "yml", "pdf"]
EXCLUDED_NAMES = [
    ".ssh", ".gnupg", "node_modules", "target", "dist", "build", ".env", ".git", ".svn", ".hg", "credentials", "credential",
    "secrets", "secret", "tokens", "token", "passwords", "password", "private_key", "secret_key", "authorized_keys", "id_rsa",
    "id_ed25519", "id_ecdsa", ".cache", ".config", ".cargo", ".rustup", ".nvm", ".var", "vendor", ".venv", "__pycache__",
]
EXCLUDED_EXTENSIONS = ["pem", "key", "pfx", "p12", "jks", "keystore", "env"]
DOC_EXTENSIONS = ["md", "markdown", "txt", "text", "pdf"]
CODE_EXTENSIONS = ["rs", "py", "ts", "tsx"]
REPOSITORY_DOC_EXTENSIONS = ["md", "markdown", "txt"]
REPOSITORY_CODE_EXTENSIONS = ["rs", "py", "ts", "tsx", "js", "jsx", "mjs", "cjs"]
REPOSITORY_SKIPPED = [".git", "target", "node_modules", "dist", "build", "__pycache__"]
MINIFIED_BYTES, PROBE_BYTES = 256 * 1024, 64 * 1024


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension of the file name; empty for none and for dot files."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def is_source(path: Column) -> Column:
    return (file_name(path) == "Cargo.toml") | extension(path).isin(*SOURCE_EXTENSIONS)


def is_excluded(path: Column) -> Column:
    """Purely lexical: a component of an excluded name or beginning with ``.env.``, or an excluded extension."""
    parts = F.split(path, "/")
    return F.exists(parts, lambda x: x.isin(*EXCLUDED_NAMES) | x.startswith(".env.") | (x == ".env")) | F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1).isin(*EXCLUDED_EXTENSIONS)


def parser_for(path: Column) -> Column:
    """First parser that takes a path; the generic one comes last."""
    kind = extension(path)
    return (
        F.when(file_name(path) == "Cargo.toml", "cargo_toml")
        .when(kind == "rs", "rust")
        .when(kind == "py", "python")
        .when(kind.isin("ts", "tsx", "js", "jsx", "mjs", "cjs"), "typescript")
        .when(kind.isin("md", "markdown"), "markdown")
        .when(kind == "pdf", "pdf")
        .when(kind.isin("txt", "text"), "plain_text")
        .otherwise("generic_text")
    )


def ignore_rules(gitignore: str, base: str = "") -> list[tuple[str, bool]]:
    """(pattern over ``/``-separated paths, whether it re-includes) of a gitignore file below ``base``."""
    out = []
    for line in gitignore.splitlines():
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        again = rule.startswith("!")
        rule = rule[1:] if again else rule.removeprefix("\\")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        anchored, rule = "/" in rule, rule.lstrip("/")
        made, at = "", 0
        while at < len(rule):
            if rule.startswith("**/", at):
                made, at = made + "(?:.*/)?", at + 3
            elif rule.startswith("**", at):
                made, at = made + ".*", at + 2
            elif rule[at] == "*":
                made, at = made + "[^/]*", at + 1
            elif rule[at] == "?":
                made, at = made + "[^/]", at + 1
            elif rule[at] == "[" and (end := rule.find("]", at + 2)) > 0:
                made, at = made + "[" + rule[at + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
            else:
                made, at = made + re.escape(rule[at]), at + 1
        prefix = re.escape(base.rstrip("/") + "/") if base else ""
        out.append((f"^{prefix}{'' if anchored else '(?:.*/)?'}{made}{'/' if folder else '/?'}$", again))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that fits a path or one of its folders excludes it; what is below an excluded folder stays
    excluded."""
    parts = F.split(path, "/")
    n = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i < n, "/").otherwise("")))

    def excluded(p: Column) -> Column:
        found = F.lit(False)
        for pattern, again in rules:
            found = F.when(p.rlike(pattern), F.lit(not again)).otherwise(found)
        return found

    return F.exists(prefixes, excluded) if rules else F.lit(False)


def small_file(spark: SparkSession, path: str) -> str:
    """Text of one small file of any store, hidden ones included; empty if it isn't there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return ""
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def scan(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path, length, text`` of eligible files below ``root``, sorted; none of private names, hidden, or excluded by the
    root's ``.gitignore`` and ``.ignore``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    below = F.regexp_replace(F.regexp_replace("path", "^file:", ""), f"^{posixpath.normpath(root)}/", "")
    rows = files.select(below.alias("path"), "length", "content")
    rules = [r for name in (".gitignore", ".ignore") for r in ignore_rules(small_file(spark, f"{root.rstrip('/')}/{name}"))]
    hidden = F.exists(F.split("path", "/"), lambda x: x.startswith("."))
    rows = rows.filter(is_source(F.col("path")) & ~is_excluded(F.col("path")) & ~hidden & ~ignored(F.col("path"), rules))
    rows = rows.withColumn("is_text", looks_like_text(F.col("content")))
    return rows.withColumn("text", F.when(F.col("is_text"), F.decode("content", "UTF-8"))).orderBy("path")


def looks_like_text(content: Column) -> Column:
    """No NUL in the first 8192 bytes and at most a twentieth of other controls (below 0x20, but for tab, line feed,
    vertical tab, form feed and carriage return); 2 MiB at most."""
    probe = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")  # a character a byte
    odd = F.length(F.regexp_replace(probe, r"[^\x01-\x08\x0E-\x1F]+", ""))
    return (F.length(content) <= 2 * 1024 * 1024) & (F.instr(probe, "\0") == 0) & (odd * 100 <= F.length(probe) * 5)


def selection(length: Column, probe: Column, max_bytes: int = 0, skip_minified: bool = True) -> Column:
    """Whether a source is indexed, or why not: ``large``, then ``minified`` (no line break in the probe)."""
    found = F.when(F.lit(max_bytes > 0) & (length > max_bytes), "large")
    return found.when(F.lit(skip_minified) & (length >= MINIFIED_BYTES) & (F.instr(F.substring(probe, 1, PROBE_BYTES), "\n") == 0), "minified").otherwise("index")


def directory_features(files: DataFrame, documents: list[str] = DOC_EXTENSIONS, code: list[str] = CODE_EXTENSIONS) -> DataFrame:
    """Per ``directory`` of ``files (directory, extension, bytes, minified)``: counts, sizes and shares in ten-thousandths.
    Files without an extension (empty) are no kind of their own."""
    by_kind = files.groupBy("directory", "extension").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.max("bytes").alias("most"), F.sum(F.col("minified").cast("int")).alias("min"))
    total = by_kind.groupBy("directory").agg(
        F.sum("n").alias("file_count"),
        F.sum("b").alias("total_bytes"),
        F.max("most").alias("max_bytes"),
        F.coalesce(F.max(F.when(F.col("extension") != "", F.col("n"))), F.lit(0)).alias("most_of_one"),
        F.sum(F.when(F.col("extension").isin(*documents), F.col("n")).otherwise(0)).alias("docs"),
        F.sum(F.when(F.col("extension").isin(*code), F.col("n")).otherwise(0)).alias("code"),
        F.sum("min").alias("minified"),
    )
    share = {"single_ext_share": "most_of_one", "doc_share": "docs", "code_share": "code", "minified_share": "minified"}
    return total.select(
        "directory", "file_count", "total_bytes", "max_bytes", F.expr("total_bytes div file_count").alias("mean_bytes"), *[F.expr(f"{c} * 10000 div file_count").alias(n) for n, c in share.items()]
    )


def directory_class(home_noise: Column) -> Column:
    """Noise, Recommended or Maybe over the columns of ``directory_features``."""
    c = F.col
    dump = (c("file_count") >= 200) & (c("single_ext_share") >= 9000) & (c("mean_bytes") < 64 * 1024) & (c("doc_share") + c("code_share") < 500)
    packed = (c("minified_share") >= 5000) & (c("total_bytes") >= 5 * 1024 * 1024)
    good = ((c("doc_share") >= 5000) & (c("file_count") <= 500)) | ((c("code_share") >= 2000) & (c("file_count") <= 2000))
    return F.when(home_noise | dump | packed, "Noise").when(good, "Recommended").otherwise("Maybe")


def normalize(root: str, path: str) -> str | None:
    """Lexical containment: the normalised path below root, or null if it escapes."""
    full = posixpath.normpath(posixpath.join(root, path))
    base = posixpath.normpath(root)
    return full if full == base or full.startswith(base.rstrip("/") + "/") else None


def blobs(files: DataFrame) -> DataFrame:
    """Content-addressed view of ``files (path, content)``: one row a digest with its place and how many paths hold it."""
    keyed = files.select(F.sha2("content", 256).alias("digest"), F.length("content").alias("bytes"))
    return keyed.groupBy("digest").agg(F.first("bytes").alias("bytes"), F.count("*").alias("paths")).withColumn("place", F.concat_ws("/", F.substring("digest", 1, 2), "digest"))


#: An attribute of a tag: its name, then a quoted value (to the tag's end if the quote stays open) or a bare one.
_ATTRIBUTE = r"""([A-Za-z:_][A-Za-z0-9:_-]*)[ \t\n\f\r]*=[ \t\n\f\r]*("[^"]*(?:"|$)|'[^']*(?:'|$)|[^ \t\n\f\r>"'][^ \t\n\f\r>]*|)"""


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's first attribute of a name, in any case and place; null if there is none, or its quote stays open."""
    pairs = F.arrays_zip(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 1).alias("k"), F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 2).alias("v"))
    value = F.get(F.filter(pairs, lambda x: F.lower(x["k"]) == name), F.lit(0))["v"]
    quote = F.substring(value, 1, 1)
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    closed = (F.length(value) > 1) & value.endswith(quote)
    return F.when(quote.isin('"', "'"), F.when(closed, inner)).otherwise(value)


def metas(html: Column) -> Column:
    """``(name, content)`` of all meta tags in order; the name in lower case, from ``name`` or else ``property``."""
    tags = F.regexp_extract_all(html, F.lit("(?i)(<meta[^>]*>)"), 1)
    return F.transform(tags, lambda t: F.struct(F.lower(F.coalesce(attribute(t, "name"), attribute(t, "property"))).alias("name"), attribute(t, "content").alias("content")))


def meta_content(found: Column, name: str) -> Column:
    """Trimmed content of the first of ``metas`` with a name; null if it is empty or there is none."""
    content = F.get(F.filter(found, lambda m: m["name"] == name.lower()), F.lit(0))["content"]
    return F.nullif(F.regexp_replace(content, r"(?U)^\s+|\s+$", ""), F.lit(""))


# Texts by which a page is taken as rendered by scripts or behind a paywall.
DYNAMIC_MARKERS = ["__next_data__", "data-reactroot"]
PAYWALL_MARKERS = ["subscribe to continue", "subscription required", "sign in to read", "paywall"]


def web_metadata(pages: DataFrame) -> DataFrame:
    """``page_id``, the dates that a page's meta tags give (the first name that has one), and its flags."""
    html = F.lower("html")
    dynamic = html.contains("<script") & html.contains("enable javascript")
    for marker in DYNAMIC_MARKERS:
        dynamic = dynamic | html.contains(marker)
    paywalled = F.lit(False)
    for marker in PAYWALL_MARKERS:
        paywalled = paywalled | html.contains(marker)
    found = pages.select("page_id", metas(F.col("html")).alias("metas"), dynamic.alias("is_dynamic"), paywalled.alias("is_paywalled"))
    m = F.col("metas")
    return found.select(
        "page_id",
        F.coalesce(meta_content(m, "article:published_time"), meta_content(m, "datePublished")).alias("published_at"),
        F.coalesce(meta_content(m, "article:modified_time"), meta_content(m, "dateModified")).alias("updated_at"),
        meta_content(m, "dateEffective").alias("effective_at"),
        "is_dynamic",
        "is_paywalled",
    )
