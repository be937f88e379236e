"""Documents to chunks, structure trees and summary cards.

A document's lines are one array of its row, and chunks are slices of it, so nothing is
shuffled: texts stay where they were read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEADING = r"^#{1,6}(?:[ \t]|$)"
#: What a rule says of one line (for structures: of its code, without what it is indented by).
Rule = Callable[[Column], Column]


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_no`` (from 1), ``line``."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def _split(docs: DataFrame) -> DataFrame:
    """``doc_id, lines, places``: an array of the lines, and of their numbers from 1."""
    rows = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    return rows.withColumn("places", F.sequence(F.lit(1), F.size("lines"))).filter("lines IS NOT NULL")


def _pieces(rows: DataFrame, spans: Column) -> DataFrame:
    """Chunks from ``spans`` (structs of first and last line): trimmed text, 1-based inclusive span, order from 0; blank
    ones go."""

    def cut_out(x: Column) -> Column:
        joined = F.array_join(F.slice("lines", x["first"], x["last"] - x["first"] + 1), "\n")
        return F.struct(x["first"].alias("start_line"), x["last"].alias("end_line"), F.regexp_replace(joined, r"^\s+|\s+$", "").alias("text"))

    found = F.filter(F.transform(spans, cut_out), lambda x: x["text"] != "")
    return rows.select("doc_id", F.posexplode(found).alias("ord", "x")).select("doc_id", "ord", "x.start_line", "x.end_line", "x.text")


def _between(starts: Column) -> Column:
    """Spans from each of some ascending line numbers to the line before the next; what is before the first as well."""
    every = F.array_union(F.array(F.lit(1)), starts)
    return F.transform(every, lambda first, i: F.struct(first.alias("first"), F.coalesce(F.get(every, i + 1) - 1, F.size("lines")).alias("last")))


def paragraph_chunks(docs: DataFrame) -> DataFrame:
    """Runs of lines that aren't blank."""
    rows = _split(docs).withColumn("blank", F.transform("lines", lambda x: F.regexp_replace(x, r"\s", "") == ""))
    blank = lambda i: F.coalesce(F.get("blank", i), F.lit(True))  # noqa: E731 (beyond the ends as well)
    firsts = F.filter("places", lambda i: ~blank(i - 1) & blank(i - 2))
    lasts = F.filter("places", lambda i: ~blank(i - 1) & blank(i))
    return _pieces(rows, F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last"))))


def starts_chunks(docs: DataFrame, starts: Rule) -> DataFrame:
    """Segments between lines where ``starts`` holds, the preamble first."""
    rows = _split(docs).withColumn("marks", F.transform("lines", lambda x: F.coalesce(starts(x), F.lit(False))))
    return _pieces(rows, _between(F.filter("places", lambda i: F.get("marks", i - 1))))


def _structures(pending: Rule, start: Rule, comment: Rule) -> Column:
    """Line numbers where structures begin, over ``lines`` and ``places``.

    A start takes the first pending line (attribute, decorator) since the last line that
    was neither blank, comment nor pending: a fold over the lines.
    """
    begin = F.struct(F.lit(0).alias("held"), F.array().cast("array<int>").alias("found"))

    def read(acc: Column, i: Column) -> Column:
        code = F.regexp_replace(F.get("lines", i - 1), r"^\s+", "")
        begins = ~pending(code) & start(code)
        inside = pending(code) | (code == "") | comment(code)
        held = F.when(begins, 0).when(pending(code) & (acc["held"] == 0), i).when(inside, acc["held"]).otherwise(0)
        at = F.when(acc["held"] > 0, acc["held"]).otherwise(i)
        found = F.when(begins, F.concat(acc["found"], F.array(at))).otherwise(acc["found"])
        return F.struct(held.alias("held"), found.alias("found"))

    return F.aggregate("places", begin, read, lambda acc: acc["found"])


def structural_starts(docs: DataFrame, pending: Rule, start: Rule, comment: Rule) -> DataFrame:
    """``doc_id, line_no`` where structures begin."""
    return _split(docs).select("doc_id", F.explode(_structures(pending, start, comment)).alias("line_no"))


def structural_chunks(docs: DataFrame, pending: Rule, start: Rule, comment: Rule) -> DataFrame:
    """Chunks at structural starts with what belongs to them above; documents without one by paragraphs."""
    rows = _split(docs).withColumn("starts", _structures(pending, start, comment))
    found = _pieces(rows.filter(F.size("starts") > 0), _between(F.col("starts")))
    rest = rows.filter(F.size("starts") == 0).select("doc_id", F.array_join("lines", "\n").alias("text"))
    return found.unionByName(paragraph_chunks(rest))


def language_rules(language: str) -> tuple[Rule, Rule, Rule]:
    """(pending, start, comment) over the code of a line of a source language."""
    begins = lambda prefix: lambda code: code.startswith(prefix)
    like = lambda pattern: lambda code: code.rlike(pattern)
    if language == "rust":
        return begins("#["), like(r"^(?:pub )?(?:async )?(?:fn|struct|enum|trait) |^(?:pub )?impl"), begins("//")
    if language == "python":
        return begins("@"), like("^(?:class|def|async def) "), begins("#")
    if language == "typescript":
        return begins("@"), like(r"^(?:export )?(?:default )?(?:abstract )?(?:async )?(?:class|function|interface|enum|type) "), begins("//")
    if language == "cargo_toml":
        return lambda code: F.lit(False), begins("["), begins("#")
    raise ValueError(f"no rules for {language}")


def markdown_chunks(docs: DataFrame) -> DataFrame:
    """Sections before ATX headings; documents without a heading by paragraphs."""
    headed = F.concat(F.lit("\n"), F.col("text")).rlike("\n#{1,6}(?:[ \t]|\n|$)")
    return starts_chunks(docs.filter(headed), lambda line: line.rlike(HEADING)).unionByName(paragraph_chunks(docs.filter(~headed)))


def line_ranges(starts: DataFrame) -> DataFrame:
    """``doc_id, start_line, end_line`` between given start lines (``doc_id, start_line, n_lines``), preamble included."""
    first = starts.groupBy("doc_id").agg(F.min("start_line").alias("start_line"), F.first("n_lines").alias("n_lines")).filter("start_line > 1")
    every = starts.unionByName(first.withColumn("start_line", F.lit(1).cast("int")))
    after = F.lead("start_line").over(Window.partitionBy("doc_id").orderBy("start_line"))
    return every.select("doc_id", "start_line", F.coalesce(after - 1, F.col("n_lines")).alias("end_line")).filter("end_line >= start_line")


def node_type(text: Column) -> Column:
    """By the first line, trimmed: a heading with a title, a code fence, a row of a table, or else a paragraph."""
    first = F.regexp_replace(F.split(F.ltrim(text), "\n")[0], r"\s+$", "")
    return F.when(first.rlike(r"^#{1,6}\s"), "Section").when(first.startswith("```"), "Code").when(first.contains("|"), "Table").otherwise("Paragraph")


def structure_tree(chunks: DataFrame) -> DataFrame:
    """One node per chunk below the document's root (node 0) with its next sibling; a section's path is its heading."""
    kind = node_type(F.col("text"))
    heading = F.trim(F.regexp_replace(F.split(F.ltrim("text"), "\n")[0], r"^#{1,6}|\s+$", ""))
    path = F.when(kind == "Section", F.array(heading)).otherwise(F.array().cast("array<string>"))
    light = chunks.select("doc_id", "ord", kind.alias("node_type"), path.alias("section_path"), "start_line", "end_line")  # texts stay out of the window
    order = Window.partitionBy("doc_id").orderBy("ord")
    return light.select("doc_id", (F.col("ord") + 1).alias("node"), F.lit(0).alias("parent"), (F.lead("ord").over(order) + 1).alias("next_sibling"), "node_type", "section_path", "start_line", "end_line")


def summary_cards(docs: DataFrame, chunks: DataFrame, path: Column) -> DataFrame:
    """``doc_id, title, body``: the first line that isn't blank without its ``#`` (96 characters), else the file name."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    titles = F.filter(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "")
    cleaned = F.substring(F.trim(F.regexp_replace(F.trim(F.get(titles, F.lit(0))), "^#+", "")), 1, 96)
    title = F.when(F.coalesce(cleaned, F.lit("")) != "", cleaned).otherwise(F.element_at(F.split(path, "/"), -1))
    joined = docs.select("doc_id", title.alias("title"), path.alias("path")).join(counts, "doc_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("string")
    return joined.select("doc_id", "title", F.concat(F.lit("Parsed "), n, F.lit(" textual chunk(s) from "), "path", F.lit(".")).alias("body"))
