"""Retrieval from question to passages, as one lazy plan up to the last few rows.

Stages: variants of the question, dense and hybrid search for each, graph lookup, rank
fusion, graph boost, the best chunk of each parent, reranking of the first candidates, compression,
formatting. Optional stages that fail are left out, and named in ``failed``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import blank, citation, filled, not_relevant, preview, relevance
from ledgerlens.operators import entities, graph, vector
from ledgerlens.operators.entities import Recogniser
from ledgerlens.providers import HashedTerms, RuleAnalyst, compressed, overlap_score

#: Below this length a text isn't compressed, below this relevance a question is out of scope.
SHORT, IN_SCOPE = 400, 3
#: Results asked for by default, and candidates of a dense search at most; each result has so many candidates.
RESULTS, DENSE_MOST, TIMES = 5, 40, 3
#: What a service or a table that is down raises. A plan that can't be analysed (a column that isn't there) and other errors are faults of the program, and go on.
DOWN = (PySparkException, Py4JError, OSError)
FAULTS = (AnalysisException, ParseException)


@dataclass
class Corpus:
    """Chunks (id, parent_id, document_id, values, text, parent_text, start_page, metadata columns), their sparse index, the graph, and the patterns of entities in questions."""

    chunks: DataFrame
    sparse: DataFrame
    entities: DataFrame | None = None
    mentions: DataFrame | None = None
    patterns: DataFrame | None = None


@dataclass
class Retriever:
    corpus: Corpus
    embedder: HashedTerms = field(default_factory=HashedTerms)
    analyst: RuleAnalyst = field(default_factory=RuleAnalyst)
    failed: list[str] = field(default_factory=list)
    #: The models of the last stages: relevance of a text to a question, and what of it to keep.
    reranker: Callable[[str, Column], Column] = overlap_score
    compressor: Callable[[str, Column], Column] = compressed
    #: Finds entities in questions besides the patterns.
    recogniser: Recogniser | None = None

    def _optional(self, name: str, make: Callable[[], DataFrame | None]) -> DataFrame | None:
        try:
            return make()
        except FAULTS:
            raise
        except DOWN:  # a stage that is down must not take the answer with it
            self.failed.append(name)
            return None

    def asked(self, question: str, names: list[str] | None = None) -> DataFrame | None:
        """The question's entities (seq, text, type), each text once: those named, or those that patterns and the recogniser find in it."""
        spark = self.corpus.chunks.sparkSession
        if names:
            return spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "seq int, text string, type string")
        if self.corpus.patterns is None:
            return None
        page = spark.createDataFrame([("question", 0, question)], "document_id string, page int, text string")
        found = entities.found_entities(page, self.corpus.patterns, self.recogniser)
        once = found.groupBy(F.lower("text").alias("_k")).agg(F.min_by(F.struct("text", "type"), "begin").alias("e"), F.min("begin").alias("seq"))
        return once.select("seq", "e.text", "e.type")

    def evidence(self, question: str, names: list[str] | None, complex_: bool) -> DataFrame | None:
        """What the graph knows of the question's entities, and if ``complex_`` of entities near them: documents with pages and evidence."""
        nodes, mentions = self.corpus.entities, self.corpus.mentions
        asked = None if nodes is None or mentions is None else self.asked(question, names)
        return None if asked is None else graph.evidence_of(nodes, mentions, asked, complex_)

    def fused(self, question: str, filters: dict[str, object] | None = None, names: list[str] | None = None, use_graph: bool = True) -> DataFrame:
        """The chunks of all lists with (rrf_score, sources, pos), one for each parent."""
        analysis = self.analyst.analyse(question)
        c = self.corpus
        vectors = [self.embedder.embed(v) for v in analysis.variants]
        dense = vector.multi_variant_dense(c.chunks, vectors, vector.DENSE_TOP, filters)
        lists = dense.select(F.lit("dense").alias("label"), F.lit(0).alias("list"), F.col("pos").alias("rank"), "id")

        def hybrid() -> DataFrame:
            asked = [F.struct(F.lit(i).alias("variant"), vector.term_weights(F.lit(text)).alias("terms")) for i, text in enumerate(analysis.variants)]
            terms = c.chunks.sparkSession.range(1).select(F.explode(F.array(*asked)).alias("v")).select("v.variant", F.explode("v.terms").alias("t")).select("variant", "t.*")
            return vector.multi_variant_hybrid(c.chunks, c.sparse, vectors, terms, vector.SPARSE_TOP, filters)

        sparse = self._optional("bm25", hybrid)
        if sparse is not None:
            lists = lists.union(sparse.select(F.lit("bm25"), F.lit(1), F.col("pos"), "id"))
        fused = vector.rrf(lists).join(c.chunks.drop("values"), "id")
        evidence = self._optional("kg", lambda: self.evidence(question, names, analysis.complex)) if use_graph else None
        if evidence is not None:
            fused = vector.graph_boost(fused, evidence)
        return vector.best_of_parent(fused)

    def retrieve(self, question: str, top_k: int = 5, filters: dict[str, object] | None = None, names: list[str] | None = None, use_graph: bool = True, rerank: bool = True, compress: bool = True) -> DataFrame:
        """The ``top_k`` passages; models see no more than the first ``CANDIDATES``."""
        rows = self.fused(question, filters, names, use_graph).orderBy(F.col("rrf_score").desc(), "pos").limit(vector.CANDIDATES if rerank else top_k)
        if rerank:
            rows = rows.withColumn("relevance_score", self.reranker(question, filled(F.col("parent_text"), F.col("text"))))
            rows = rows.orderBy(F.col("relevance_score").desc(), F.col("rrf_score").desc(), "pos").limit(top_k)
        else:
            rows = rows.withColumn("relevance_score", F.lit(None).cast("double"))
        return with_compression(rows, question, self.compressor) if compress else rows.withColumns({"compressed_text": F.lit(None).cast("string"), "compression_skipped": F.lit(False)})


    def dense(self, question: str, top_k: int = RESULTS, filters: dict[str, object] | None = None) -> DataFrame:
        """The ``top_k`` passages by vectors alone: the best of each parent among the nearest chunks."""
        c = self.corpus.chunks
        near = vector.dense_top_k(c, self.embedder.embed(question), min(TIMES * top_k, DENSE_MOST), filters)
        return vector.best_of_parent(near, "score", "id").orderBy(F.col("score").desc(), "id").limit(top_k)

    def search(self, question: str, top_k: int = RESULTS, hybrid: bool = True, filters: dict[str, object] | None = None, names: list[str] | None = None) -> Answer:
        """The passages as rows. If hybrid search fails, as it is planned or as it runs, dense search takes its place, and a notice says so."""
        notice = None
        if hybrid:
            try:
                rows = [r.asDict(recursive=True) for r in self.retrieve(question, min(TIMES * top_k, vector.CANDIDATES), filters, names).collect()]
                scope = any((r["relevance_score"] or 0.0) >= IN_SCOPE or not r["compression_skipped"] for r in rows)
                return Answer(rows[:top_k], None if scope or not rows else "No passage is relevant to the question.")
            except FAULTS:
                raise
            except DOWN as e:
                notice = f"Dense search only; hybrid search failed: {type(e).__name__}"
        return Answer([r.asDict(recursive=True) for r in self.dense(question, top_k, filters).collect()], notice)


@dataclass
class Answer:
    """The few passages of an answer, best first, and what the reader should know of them."""

    rows: list[dict]
    notice: str | None = None


def with_compression(rows: DataFrame, question: str, compressor: Callable[[str, Column], Column] = compressed) -> DataFrame:
    """Adds ``compressed_text`` and ``compression_skipped``: short texts stay, texts without a relevant part stay and are marked."""
    text = filled(F.col("parent_text"), F.col("text"))
    answer = compressor(question, text)
    none = not_relevant(answer) & (F.length(text) >= SHORT)
    return rows.withColumns({"compressed_text": F.when(F.length(text) < SHORT, text).when(none, text).otherwise(answer), "compression_skipped": none})


def out_of_scope(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(out_of_scope), one row, or one for each question (columns ``by``): no result is relevant, and none could be compressed."""
    return results.groupBy(*by).agg(F.coalesce((F.max("relevance_score") < IN_SCOPE) & F.bool_and("compression_skipped"), F.lit(False)).alias("out_of_scope"))


def formatted(results: DataFrame) -> DataFrame:
    """(pos, shown): source, relevance, text and a preview of what matched, for each result."""
    c = {n: F.col(n) if n in results.columns else F.lit(None).cast("string") for n in ("ticker", "document_type", "section", "fiscal_year", "start_page", "end_page", "source_name", "headline", "compressed_text", "parent_text", "text", "text_raw", "relevance_score", "score")}
    names = ("ticker", "document_type", "section", "fiscal_year", "start_page", "end_page", "source_name", "headline")
    source = citation(*(c[n] for n in names))
    body = F.coalesce(filled(c["compressed_text"], c["parent_text"], c["text"]), F.lit("[No content available]"))
    seen = filled(c["text_raw"], c["text"])
    return results.select("pos", F.concat(F.lit("Source: "), source, F.lit(" (Relevance: "), relevance(c["relevance_score"], F.coalesce(c["score"].cast("double"), F.lit(0.0))), F.lit(")\n"), body, F.when(blank(seen), "").otherwise(F.concat(F.lit("\nMatched: "), preview(seen)))).alias("shown"))


def expected_source(results: DataFrame, document: str, top: int = 3, least: float = 0.6) -> DataFrame:
    """One row (verdict): PASS if a result of the document is among the first with a good score, WEAK with a lower one, else FAIL."""
    best = results.orderBy(F.col("score").desc()).limit(top).where(F.col("document_id") == document).agg(F.max("score").alias("s"))
    return best.select(F.when(F.col("s") >= least, "PASS").when(F.col("s").isNotNull(), "WEAK").otherwise("FAIL").alias("verdict"))
