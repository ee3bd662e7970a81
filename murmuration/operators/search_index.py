"""A saved index of TF-IDF postings that answers many keyword searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.operators.search import query_weights
from murmuration.operators.vocab import pinned_stats, tfidf_smooth
from murmuration.session import cut_lineage

BLOCK_DOCS = 4096  # documents of a block, about
BUCKETS = 256  # folders of terms
FILE_POSTINGS = 4_000_000  # postings of a file, about
FIRST_BLOCKS = 8  # blocks scored before any bound is known
SLACK = 1e-8  # similarities are compared at nine digits


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, path: str, block_docs: int = BLOCK_DOCS, buckets: int = BUCKETS) -> None:
    """Write postings of ``(doc_id, tokens)``: a row for each term and block of documents, with the largest weight in it.

    Blocks hold documents of like size, whose weights are alike, so that their maxima tell blocks apart. Rows lie in folders
    by term; a folder has as many files as its postings need, so a term that most documents share is many rows in many files.
    """
    spark = docs.sparkSession
    stats = pinned_stats(docs)
    words = F.greatest(F.size(F.array_distinct("tokens")), F.lit(1))
    sized = cut_lineage(docs.select("doc_id", F.floor(F.log2(words)).cast("int").alias("class")), "sizes")
    classes = sized.groupBy("class").agg(F.count(F.lit(1)).alias("n"))  # at most 31 rows
    n_docs = cut_lineage(classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "document-count")
    parts = classes.select("class", F.ceil(F.col("n") / block_docs).alias("parts"))
    block = F.shiftleft(F.col("class").cast("long"), 40) + F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    # rows carry their block through the weighing, so that postings are shuffled once; rows that share an id carry the blocks of all
    placed = sized.join(F.broadcast(parts), "class").select("doc_id", block.alias("block"))
    shared = placed.groupBy("doc_id").agg(F.collect_list("block").alias("blocks")).where(F.size("blocks") > 1)
    shared = cut_lineage(shared.select("doc_id", F.array_sort("blocks").alias("blocks")), "repeated-ids")
    one = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "tokens", F.floor(F.log2(words)).cast("int").alias("class")).join(F.broadcast(parts), "class")
    if shared.isEmpty():
        carried = one.select(F.struct("doc_id", block.alias("block")).alias("doc_id"), "tokens")
        of = F.col("doc_id.block")
    else:
        blocks = F.coalesce("blocks", F.array(block)).alias("blocks")
        carried = one.join(shared, "doc_id", "left").select(F.struct("doc_id", blocks).alias("doc_id"), "tokens")
        of = F.explode("doc_id.blocks")
    weights = tfidf_smooth(carried, stats=stats, n_docs=n_docs).select("term", "doc_id.doc_id", "tfidf", of.alias("block"))
    terms = stats.select("term", "df", _bucket("term", buckets).alias("bucket"))
    files = terms.groupBy("bucket").agg(F.ceil(F.sum("df") / FILE_POSTINGS).alias("files"))  # a row a folder
    spread = weights.withColumn("bucket", _bucket("term", buckets)).join(F.broadcast(files), "bucket")
    spread = spread.withColumn("file", F.pmod(F.xxhash64("block"), F.col("files")).cast("int")).drop("files").repartition("bucket", "file")
    postings = spread.groupBy("bucket", "file", "term", "block").agg(  # where they lie already
        F.max("tfidf").alias("most"), F.collect_list(F.struct("doc_id", "tfidf")).alias("docs")
    )
    ordered = postings.select("term", "block", "most", "docs", "bucket").sortWithinPartitions("bucket", "term", "block")
    ordered.write.partitionBy("bucket").parquet(f"{path}/postings")
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_docs.withColumn("buckets", F.lit(buckets)).withColumn("kind", F.lit(kind)).coalesce(1).write.parquet(f"{path}/meta")


class SearchIndex:
    """An index written by ``build_index``, open for searches. A search reads the folders of its own terms alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.schema("n long, buckets int, kind string").parquet(f"{path}/meta")
        _, self.buckets, kind = meta.first()
        self.n_docs = meta.select("n")
        posting = f"term string, block long, most double, docs array<struct<doc_id:{kind},tfidf:double>>, bucket int"
        self.postings = spark.read.schema(posting).parquet(f"{path}/postings")
        self.terms = spark.read.schema("term string, df long, bucket int").parquet(f"{path}/terms")

    def of_terms(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        """The rows of some terms; the conditions reach the folders and the files' statistics."""
        folders = [_bucket(F.lit(t), self.buckets) for t in terms]
        return rows.where(F.col("bucket").isin(folders) & F.col("term").isin(terms))

    def weights(self, terms: list[str]) -> DataFrame:
        """The search as a unit vector; a row for each of its terms that the corpus knows."""
        known = self.of_terms(self.terms, list(dict.fromkeys(terms)))
        rows = query_weights(terms, known, self.n_docs).collect()
        return self.spark.createDataFrame(rows, "term string, query_weight double")

    def bounds(self, query: DataFrame, terms: list[str]) -> DataFrame:
        """``(block, bound)``: no document of a block comes closer than its bound. Reads no document."""
        met = self.of_terms(self.postings, terms).select("term", "block", "most").join(F.broadcast(query), "term")
        return met.groupBy("block").agg(F.sum(F.col("most") * F.col("query_weight")).alias("bound"))

    def best(self, blocks: DataFrame, query: DataFrame, terms: list[str], top_n: int) -> DataFrame:
        """The closest documents of some blocks."""
        met = self.of_terms(self.postings, terms).join(blocks.select("block"), "block", "left_semi").join(F.broadcast(query), "term")
        each = met.select(F.explode("docs").alias("d"), "query_weight")
        scores = each.groupBy("d.doc_id").agg(F.sum(F.col("d.tfidf") * F.col("query_weight")).alias("similarity"))
        return scores.orderBy(F.desc(F.round("similarity", 9)), "doc_id").limit(top_n)

    def open_blocks(self, terms: list[str], top_n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``(query, bounds, open)``: the blocks that may hold one of the closest documents, by what the first blocks hold."""
        wanted = list(dict.fromkeys(terms))
        query = self.weights(terms)
        bounds = cut_lineage(self.bounds(query, wanted), "bounds")
        first = bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS)
        found = self.best(first, query, wanted, top_n).collect()  # top_n rows
        least = found[-1]["similarity"] - SLACK if found and len(found) == top_n else float("-inf")
        return query, bounds, bounds.where(F.col("bound") >= least)

    def search(self, terms: list[str], top_n: int = 3) -> DataFrame:
        """``(doc_id, similarity)`` of the ``top_n`` closest documents, ties by ``doc_id``; the same as ``document_search``.

        Documents that share no term are never among them; unknown terms count for nothing.
        """
        query, _, blocks = self.open_blocks(terms, top_n)
        return self.best(blocks, query, list(dict.fromkeys(terms)), top_n)
