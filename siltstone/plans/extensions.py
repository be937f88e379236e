"""What a search engine is put together from, as protocols, and the lanes and parts that come with it.

Each part is a plain object that builds DataFrames; the engine only knows the protocols,
so another lane, fusion, reranker, expander, evaluator, parser, index or validator takes
the place of one of these by being passed to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import policy, text
from siltstone.operators import chunking, fusion, graph, lexical, vectors
from siltstone.sources import files

SPARSE_REPRESENTATION = "learned-sparse-v1"


@dataclass(frozen=True)
class Descriptor:
    """What a lane is: its id, modality and representation decide whether a query may use it."""

    id: str
    modality: str = "text"
    representation: str = ""

    @property
    def is_dense(self) -> bool:
        return self.modality == "dense"

    @property
    def is_code(self) -> bool:
        return self.modality == "code"

    @property
    def is_visual(self) -> bool:
        return self.modality.lower() == "image" or self.id.lower() == "visual_page_regions"

    @property
    def is_sparse(self) -> bool:
        return self.modality.lower().startswith("sparse") or "learned_sparse" in self.id.lower() or self.representation == SPARSE_REPRESENTATION


@dataclass(frozen=True)
class Eligibility:
    """Which specialised lanes a query's classes let in. Dense lanes serve the query classes of a promotion record
    (none: they only run in the shadow); the others are let in one by one."""

    dense_classes: frozenset[str] = frozenset()
    code: bool = False
    visual: bool = False
    sparse: bool = False

    def admits(self, lane: Descriptor, query_class: str) -> bool:
        if lane.is_visual and not self.visual:
            return False
        if lane.is_sparse and (not self.sparse or lane.modality.lower() == "sparse-shadow"):
            return False
        if lane.is_dense and query_class not in self.dense_classes:
            return False
        return self.code or not lane.is_code


@dataclass(frozen=True)
class Request:
    """What a lane is asked: the queries of a plan in order, who asks, how many hits a query may bring, and the text
    vectors of queries where a lane needs them."""

    queries: tuple[str, ...]
    authorization: policy.Authorization
    max_candidates: int
    vectors: dict[int, list[float]] = field(default_factory=dict)


@runtime_checkable
class CandidateRetriever(Protocol):
    """A lane. It is a security boundary: nothing that the request may not read is scored."""

    descriptor: Descriptor

    def retrieve(self, request: Request) -> DataFrame:
        """``q, id, score``: number of the query, evidence, and a score of which larger is better."""


class RankFusion(Protocol):
    def fuse(self, hits: DataFrame) -> DataFrame:
        """``query_id, id_kind, identity, score, fused_rank`` of lane hits."""


class RerankScorer(Protocol):
    def score(self, candidates: DataFrame) -> Column:
        """An integer relevance, or null where it can't be told."""


class CandidateReranker(Protocol):
    def rerank(self, fused: DataFrame) -> DataFrame:
        """``fused`` in a new order (``fused_rank``)."""


class ContextExpander(Protocol):
    def expand(self, candidates: DataFrame) -> DataFrame:
        """More ``query_id, identity, score`` that belong to the candidates, first the candidates themselves."""


class RetrievalEvaluator(Protocol):
    def evaluate(self, selected: DataFrame) -> DataFrame:
        """One row a query: ``status``, coverage, counts of sources, documents and sections."""


class Parser(Protocol):
    name: str

    def accepts(self, path: Column) -> Column: ...

    def chunks(self, docs: DataFrame) -> DataFrame:
        """``doc_id, ord, start_line, end_line, text``."""


class EmbeddingProvider(Protocol):
    def embed(self, texts: DataFrame) -> DataFrame:
        """``id, embedding`` of ``id, text``."""


class VectorIndex(Protocol):
    def search(self, query: list[float], k: int) -> DataFrame: ...


class LearnedSparseProvider(Protocol):
    def encode(self, texts: DataFrame) -> DataFrame:
        """``id, term_id, weight`` of ``doc_id, text``."""


class LearnedSparseIndex(Protocol):
    def search(self, query: DataFrame) -> DataFrame:
        """``id, score_micros`` for ``query (term_id, weight)``."""


class GraphIndex(Protocol):
    def relations_for(self, node: str, most: int) -> DataFrame:
        """The first relations of a node by id, with ``complete``."""


class FullTextIndex(Protocol):
    def search(self, terms: dict[int, list[str]]) -> DataFrame:
        """``q, id, score``."""


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool
    message: str


class Validator(Protocol):
    name: str

    def validate(self, context: object) -> Check: ...


class BenchmarkExecutor(Protocol):
    def execute(self, cases: DataFrame, route: str) -> DataFrame:
        """One observation a case."""


# ---- lanes over a corpus ------------------------------------------------------------------------


class Corpus(Protocol):
    """What the lanes below read; ``planner.Index`` is one."""

    spark: SparkSession
    documents: DataFrame

    def allowed(self, authorization: policy.Authorization) -> DataFrame: ...

    def full_text(self, field: str) -> lexical.Postings: ...


@dataclass
class LexicalLane:
    """BM25 over whole texts: one scan of postings for all queries."""

    corpus: Corpus
    descriptor: Descriptor = Descriptor("lexical")

    def retrieve(self, request: Request) -> DataFrame:
        terms = _terms(self.corpus.spark, request.queries)
        return self.corpus.full_text("text").search(terms, self.corpus.allowed(request.authorization).select("doc_id"))


@dataclass
class CardLane:
    """BM25 over the fields of summary cards, summed."""

    corpus: Corpus
    descriptor: Descriptor = Descriptor("cards")

    def retrieve(self, request: Request) -> DataFrame:
        terms, allowed = _terms(self.corpus.spark, request.queries), self.corpus.allowed(request.authorization).select("doc_id")
        fields = self.corpus.full_text("title").search(terms, allowed).unionByName(self.corpus.full_text("body").search(terms, allowed))
        return fields.groupBy("q", "id").agg(F.sum("score").alias("score"))


@dataclass
class SubstringLane:
    """Texts that hold a query literally, in any case: one scan for all queries."""

    corpus: Corpus
    descriptor: Descriptor = Descriptor("substring")

    def retrieve(self, request: Request) -> DataFrame:
        lower = F.lower("text")
        found = F.array_compact(F.array(*[F.when(F.contains(lower, F.lit(q.lower())), F.lit(i)) for i, q in enumerate(request.queries)]))
        rows = self.corpus.allowed(request.authorization).select("doc_id", F.octet_length("text").cast("double").alias("score"), found.alias("found"))
        return rows.select(F.explode("found").alias("q"), F.col("doc_id").alias("id"), "score")


@dataclass
class DenseLane:
    """Exact cosine over ``vectors (id, embedding)``, for queries that come with a vector."""

    corpus: Corpus
    vectors: DataFrame
    descriptor: Descriptor = Descriptor("dense", "dense")

    def retrieve(self, request: Request) -> DataFrame:
        rows = self.vectors.join(self.corpus.allowed(request.authorization).select(F.col("doc_id").alias("id")), "id", "left_semi")
        return _nearest(rows, request)


@dataclass
class VisualLane:
    """Late interaction over page regions ``(id, embedding)``: for each query vector the best region of a page, summed."""

    corpus: Corpus
    regions: DataFrame
    descriptor: Descriptor = Descriptor("visual_page_regions", "image")

    def retrieve(self, request: Request) -> DataFrame:
        rows = self.regions.join(self.corpus.allowed(request.authorization).select(F.col("doc_id").alias("id")), "id", "left_semi")
        return _nearest(rows, request).groupBy("q", "id").agg(F.max("score").alias("score"))


@dataclass
class SparseLane:
    """Inner products of learned-sparse vectors ``(id, term_id, weight)``."""

    corpus: Corpus
    vectors: DataFrame
    encoder: LearnedSparseProvider
    descriptor: Descriptor = Descriptor("learned_sparse", "sparse", SPARSE_REPRESENTATION)

    def retrieve(self, request: Request) -> DataFrame:
        asked = self.corpus.spark.createDataFrame(list(enumerate(request.queries)), "doc_id int, text string")
        query = self.encoder.encode(asked).select(F.col("id").alias("q"), "term_id", F.col("weight").alias("qw"))
        rows = self.vectors.join(self.corpus.allowed(request.authorization).select(F.col("doc_id").alias("id")), "id", "left_semi")
        # the terms of a plan's queries: some hundreds of rows
        return rows.join(F.broadcast(query), "term_id").groupBy("q", "id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 9).alias("score")).filter("score > 0")


@dataclass
class CodeLane:
    """Symbols whose names the words of a query name, as evidence of the files that hold them."""

    corpus: Corpus
    symbols: DataFrame
    descriptor: Descriptor = Descriptor("code", "code")

    def retrieve(self, request: Request) -> DataFrame:
        terms = _terms(self.corpus.spark, request.queries)
        pairs = [(i, w) for i, ws in terms.items() for w in sorted(set(ws))]
        asked = self.corpus.spark.createDataFrame(pairs, "q int, word string")
        words = F.array_distinct(text.tokens(F.regexp_replace("qualified_name", "([a-z0-9])([A-Z])", "$1 $2")))
        named = self.symbols.select("file_path", F.explode(words).alias("word")).join(F.broadcast(asked), "word")  # the words of a plan's queries
        paths = self.corpus.allowed(request.authorization).select(F.col("doc_id").alias("id"), F.col("path").alias("file_path"))
        return named.join(paths, "file_path").groupBy("q", "id").agg(F.count("*").cast("double").alias("score"))


def _nearest(rows: DataFrame, request: Request) -> DataFrame:
    asked = [F.struct(F.lit(i).alias("q"), F.round(vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in v])), 9).alias("score")) for i, v in sorted(request.vectors.items())]
    if not asked:
        return rows.select(F.lit(0).alias("q"), "id", F.lit(0.0).alias("score")).limit(0)
    return rows.select("id", F.explode(F.array(*asked)).alias("x")).select("x.q", "id", "x.score")


def _terms(spark: SparkSession, queries: tuple[str, ...]) -> dict[int, list[str]]:
    """Words of each query, by the same tokenizer as the texts'."""
    rows = spark.createDataFrame(list(enumerate(queries)), "q int, text string").select("q", text.tokens(F.col("text")).alias("words")).collect()
    return {r.q: list(r.words) for r in rows}


# ---- the parts that come with the engine --------------------------------------------------------


@dataclass(frozen=True)
class ReciprocalRanks:
    k: int = 60

    def fuse(self, hits: DataFrame) -> DataFrame:
        return fusion.rrf(hits, self.k)


@dataclass(frozen=True)
class NormalizedBlend:
    lexical_weight: float
    kinds: tuple[str, ...]

    def fuse(self, hits: DataFrame) -> DataFrame:
        return fusion.blend(hits, self.lexical_weight, list(self.kinds))


@dataclass(frozen=True)
class BoundedReranker:
    """Scores the first candidates and reorders them; the caps are part of the plan."""

    scorer: RerankScorer
    input_cap: int = 100
    score_cap: int = 50
    output_cap: int = 100

    def rerank(self, fused: DataFrame) -> DataFrame:
        done = fusion.rerank(fused, self.scorer.score(fused), F.lit(0), self.input_cap, self.score_cap, self.output_cap)
        return done.withColumn("fused_rank", F.col("final_rank") - 1).select(*fused.columns)


@dataclass(frozen=True)
class VisualScorer:
    """Relevance of page regions: the clamped cosine with the query's vector, in millionths; null without a vector."""

    query: tuple[float, ...]
    vector_col: str = "embedding"

    def score(self, candidates: DataFrame) -> Column:
        v = F.col(self.vector_col)
        fits = v.isNotNull() & (F.size(v) == len(self.query))
        return F.when(fits, F.floor((vectors.clamped_cosine(v, F.array(*[F.lit(float(x)) for x in self.query])) + 1) * 500_000).cast("long"))


@dataclass(frozen=True)
class Neighbours:
    """Expansion along relations ``(id, src, kind, dst, confidence_milli)`` of nodes ``prefix + identity``."""

    edges: DataFrame
    prefix: str = "document:"
    max_relations: int = 64

    def expand(self, candidates: DataFrame) -> DataFrame:
        seeds = candidates.select("query_id", F.concat(F.lit(self.prefix), F.col("identity").cast("string")).alias("node"), (F.col("fused_rank") + 1).alias("seed_rank"))
        met = graph.neighbours(self.edges, seeds).filter(F.col("other").startswith(self.prefix))
        nth = F.row_number().over(Window.partitionBy("query_id", "node").orderBy("id"))
        near = met.withColumn("nth", nth).filter(F.col("nth") <= self.max_relations)
        score = graph.graph_score(F.col("confidence_milli"), F.col("seed_rank"), F.lit(1))
        found = near.groupBy("query_id", F.substring("other", len(self.prefix) + 1, 40).cast("long").alias("identity")).agg(F.max(score).alias("score"))
        own = candidates.select("query_id", "identity", "score")
        return own.unionByName(found.join(own.select("query_id", "identity"), ["query_id", "identity"], "left_anti"))


@dataclass(frozen=True)
class TextParser:
    """A parser by extension: ``split`` turns documents into chunks."""

    name: str
    split: object
    rules: tuple = ()

    def accepts(self, path: Column) -> Column:
        return files.parser_for(path) == self.name

    def chunks(self, docs: DataFrame) -> DataFrame:
        return self.split(docs, *self.rules)


def parsers() -> list[Parser]:
    """In order: the first that accepts a path takes it; the last takes all."""
    made: list[Parser] = [TextParser(n, chunking.structural_chunks, chunking.language_rules(r)) for n, r in (("cargo_toml", "cargo_toml"), ("rust", "rust"), ("python", "python"), ("typescript", "typescript"))]
    return [*made, TextParser("markdown", chunking.markdown_chunks), TextParser("plain_text", chunking.paragraph_chunks), TextParser("generic_text", chunking.paragraph_chunks)]


def parse(docs: DataFrame, registry: list[Parser] | None = None) -> DataFrame:
    """Chunks of ``docs (doc_id, path, text)`` with the parser that made them; PDFs, which none reads, give none."""
    out, left = None, F.lit(True)
    for p in registry or parsers():
        mine = F.coalesce(p.accepts(F.col("path")), F.lit(False))
        part = p.chunks(docs.filter(left & mine).select("doc_id", "text")).withColumn("parser", F.lit(p.name))
        left = left & ~mine
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class HashedTerms:
    """A deterministic learned-sparse encoder for tests."""

    terms: int = 4096

    def encode(self, texts: DataFrame) -> DataFrame:
        return vectors.hashed_terms(texts, text.tokens(F.col("text")), self.terms)


@dataclass(frozen=True)
class HashedEmbedding:
    """A deterministic text embedding for tests: hashed words, signed, at unit length."""

    size: int = 64

    def embed(self, texts: DataFrame) -> DataFrame:
        words = texts.select("id", F.explode(text.tokens(F.col("text"))).alias("word"))
        h = F.xxhash64("word")
        sums = words.groupBy("id", F.pmod(h, F.lit(self.size)).cast("int").alias("at")).agg(F.sum(F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("x"))
        made = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        places = F.sequence(F.lit(0), F.lit(self.size - 1))
        return made.select("id", F.transform(places, lambda i: (F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.greatest("norm", F.lit(1e-9))).cast("float")).alias("embedding"))


@dataclass(frozen=True)
class Relations:
    """Relations as an index: the first ones of a node, by id."""

    edges: DataFrame

    def relations_for(self, node: str, most: int) -> DataFrame:
        from siltstone.operators import governance

        mine = self.edges.filter((F.col("src") == node) | (F.col("dst") == node))
        return governance.page(mine, [F.col("id")], most)
