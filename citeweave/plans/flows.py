"""End-to-end question answering: deep, survey and sectioned modes.

Stages exchange DataFrames. Where a language model would act, a deterministic
offline rule stands in: the draft is the best evidence with citation keys, the
critic lists ungrounded claims, the arbiter removes them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.functions import redact
from citeweave.functions import text as T
from citeweave.operators import anchoring, dense, hybrid, ledger, themes
from citeweave.session import durable

# Distance and score thresholds of the modes.
DEEP_DISTANCE, SURVEY_DISTANCE = 1.0, 1.5
DEEP_CHUNKS, SURVEY_CHUNKS = 20, 50
KEEP_DRAFT, PASS_SCORE = 0.50, 0.85
NO_CRITIQUE = "NO_CRITIQUE: All claims are evidence-grounded."
SECTIONS = ["Introduction", "Methods", "Results", "Discussion"]  # in the order in which they are written


@dataclass
class Corpus:
    """Handles to the indexed corpus; ``corpus`` names the partition (public or secure)."""

    chunks: DataFrame  # doc_id, text, source, kind, corpus
    vectors: DataFrame  # vec_id, embedding


@dataclass
class Answer:
    """Draft lines, their scores, the overall score and the redaction count if any."""

    lines: DataFrame
    scores: DataFrame
    text: DataFrame


def guard(scope: str, provider: str) -> None:
    """Secure text may not leave for a remote model."""
    if scope == "secure" and provider == "cloud":
        raise PermissionError("secure scope requires a local provider")


def scoped(corpus: Corpus, scope: str) -> DataFrame:
    """Scope is a partition filter; ``both`` reads everything."""
    if scope not in ("public", "secure", "both"):
        raise ValueError(f"unknown scope {scope!r}")
    return corpus.chunks if scope == "both" else corpus.chunks.filter(F.col("corpus") == scope)


def context(corpus: Corpus, questions: DataFrame, scope: str, distance: float, size: int) -> DataFrame:
    """Fused context rows per question with text and source.

    The scope and unknown sources are cut before anything is ranked, so a question
    gets ``size`` rows whenever the scope has that many.
    """
    docs = scoped(corpus, scope).filter(~F.coalesce("source", F.lit("")).isin("", "unknown"))
    # Written first, so that the planner sees how few they are and texts are not shuffled to meet them.
    hits = durable(hybrid.retrieve(
        docs, "doc_id", "text", "kind", corpus.vectors, "vec_id", "embedding",
        questions, "item_id", "text", "qvec", max_chunks=size, max_distance=distance))
    return durable(hits.join(docs.select("doc_id", "text", "source"), "doc_id"))


def draft(rows: DataFrame, group: list[str]) -> DataFrame:
    """The claims of a group's context, one line each, with the citation key of their paper."""
    claims = rows.select(*group, "out_rank", "doc_id", "source", F.posexplode(T.claims(T.ascii_fold(F.col("text")))).alias("pos", "claim"))
    order = Window.partitionBy(*group).orderBy("out_rank", "doc_id", "pos")
    return claims.withColumn("line_no", F.row_number().over(order)).withColumn(
        "line", F.concat(T.squash(F.col("claim")), F.lit(" @"), F.regexp_replace("source", r"[^\w-]", "")))


def check(lines: DataFrame, rows: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """Similarity per draft line and score per owner, against the retrieved context."""
    name = F.concat_ws(":", F.col(owner).cast("string"), F.col("line_no").cast("string"))
    claims = durable(lines.select(owner, "line_no", "line", name.alias("cid"), F.col("claim").alias("c")))
    proof = durable(anchoring.numbered(
        rows.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id",
        T.sentences(T.ascii_fold(F.col("text"))), "sid", "s").select("sid", "s"))
    best = anchoring.best_evidence(claims.select("cid", "c"), "cid", "c", proof, "sid", "s")
    scored = durable(claims.join(best, "cid"))
    return scored, anchoring.score(scored, claims.select(owner).distinct(), owner)


def critique(scored: DataFrame, owner: str) -> DataFrame:
    """Ungrounded claims per owner, or the fixed all-clear."""
    weak = F.col("similarity") < anchoring.GROUNDED_MIN
    return scored.groupBy(owner).agg(F.count_if(weak).alias("n_weak")).withColumn(
        "critique", F.when(F.col("n_weak") == 0, NO_CRITIQUE).otherwise(F.concat(F.col("n_weak").cast("string"), F.lit(" ungrounded claims"))))


def revise(scored: DataFrame) -> DataFrame:
    """Remove ungrounded lines."""
    return scored.filter(F.col("similarity") >= anchoring.GROUNDED_MIN)


def write_up(lines: DataFrame, owner: str, secure: bool) -> DataFrame:
    """Final text per owner; drafts are short, so joining their lines is bounded."""
    joined = lines.groupBy(owner).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("raw"))
    clean = joined.withColumn("raw", T.final_scrub(F.col("raw")))
    if secure:
        return redact.redact(clean, "raw", redact.BOUNDARY + redact.SITE, "text", "n_redactions").drop("raw")
    return clean.select(owner, F.col("raw").alias("text"), F.lit(0).alias("n_redactions"))


def deep(corpus: Corpus, questions: DataFrame, scope: str = "public", provider: str = "local") -> Answer:
    """Retrieve, draft, check; weak drafts are revised once. Scope ``both`` is redacted."""
    guard(scope, provider)
    rows = context(corpus, questions, scope, DEEP_DISTANCE, DEEP_CHUNKS)
    scored, scores = check(draft(rows, ["item_id"]), rows, "item_id")
    weak = scores.filter(F.col("score") < PASS_SCORE).select("item_id")
    final = scored.join(weak, "item_id", "left_anti").unionByName(revise(scored.join(weak, "item_id", "left_semi")))
    return Answer(scored, scores, write_up(final, "item_id", scope == "both"))


def survey(corpus: Corpus, questions: DataFrame, theme_vectors: DataFrame, scope: str = "public", provider: str = "local") -> Answer:
    """Retrieve once, assign papers to themes, draft and check per theme."""
    guard(scope, provider)
    rows = context(corpus, questions, scope, SURVEY_DISTANCE, SURVEY_CHUNKS)
    papers = corpus.vectors.join(rows.select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    links = themes.assign(papers, "vec_id", "embedding", theme_vectors, "theme", "centroid")
    themed = rows.join(links.select(F.col("vec_id").alias("doc_id"), "theme"), "doc_id") \
        .groupBy("theme", "doc_id").agg(F.min("out_rank").alias("out_rank"), F.first("text").alias("text"), F.first("source").alias("source"))
    scored, scores = check(draft(themed, ["theme"]), themed, "theme")
    weak = scores.filter(F.col("score") < KEEP_DRAFT).select("theme")
    final = scored.join(weak, "theme", "left_anti").unionByName(revise(scored.join(weak, "theme", "left_semi")))
    return Answer(scored, scores, write_up(final, "theme", scope == "both"))


def section_order(section: str):
    """Place of a section in the document; others follow in order of their name."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SECTIONS)), F.col(section)).cast("int"), F.lit(0))


def sectioned(
    corpus: Corpus, questions: DataFrame, section: str = "section", scope: str = "public", provider: str = "local",
) -> tuple[Answer, DataFrame]:
    """One draft per section; claims already made by an earlier section are dropped. Adds ledger warnings."""
    guard(scope, provider)
    rows = context(corpus, questions, scope, SURVEY_DISTANCE, DEEP_CHUNKS).join(questions.select("item_id", section), "item_id")
    lines = draft(rows, [section, "item_id"]).withColumn("claim_id", T.claim_id(F.col("claim")))
    place = section_order(section)
    lines = lines.withColumn("place", F.struct(F.when(place == 0, len(SECTIONS) + 1).otherwise(place).alias("nth"), section, "item_id", "line_no"))
    first = lines.groupBy("claim_id").agg(F.min("place").alias("f"))
    kept = lines.join(first, "claim_id").filter(F.col("place") == F.col("f")).drop("place", "f")
    scored, scores = check(kept, rows, "item_id")
    book = kept.join(scored.select("item_id", "line_no", "similarity"), ["item_id", "line_no"]).select(
        "item_id", F.col("line_no").alias("pos"), F.col(section).alias("section"), "claim_id",
        T.citations(F.col("line")).alias("citations"),
        (F.col("line").rlike(r"@[\w-]+") | (F.col("similarity") >= anchoring.GROUNDED_MIN)).alias("grounded"))
    return Answer(scored, scores, write_up(scored, "item_id", scope == "both")), ledger.warnings(book, ["item_id"])


def from_tables(spark: SparkSession, base: str) -> tuple[Corpus, DataFrame, DataFrame]:
    """Corpus, questions and themes over the supplied tables."""
    from citeweave.sources.tables import table

    docs = table(spark, base, "documents", spread="doc_id").select(
        "doc_id", "text", "source", F.lit("text").alias("kind"),
        F.when(F.col("lang") == "en", "public").otherwise("secure").alias("corpus"))
    vecs = table(spark, base, "embeddings")
    qs = table(spark, base, "benchmark").join(
        vecs.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("qvec")), "item_id", "left")
    th = dense.centroids(vecs, "label", "embedding").withColumnRenamed("label", "theme")
    return Corpus(docs, vecs), qs, th
