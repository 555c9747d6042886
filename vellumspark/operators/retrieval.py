"""Ranking: BM25 over an inverted index, TF-IDF, exact cosine neighbours, fusion and reranking.

Statistics and postings are grouped before they meet the queries, so that only postings of query terms reach the scoring join. Queries are a fixed
dictionary, joined as a local relation whose size Spark knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dictionaries import query_rows


def query_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(query_rows(), "query_id int, slot_id int, query string")


def postings(docs: DataFrame, key: str, text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, doc_len), with ``only`` for its terms alone, which then never reach the shuffle."""
    t = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), T.tokens(F.col(text)).alias("terms"))
    rows = t.select("key", F.size("terms").alias("doc_len"), F.explode("terms").alias("term"))
    rows = rows if only is None else rows.join(only, "term", "left_semi")
    return rows.groupBy("key", "term").agg(F.count("*").alias("tf"), F.max("doc_len").alias("doc_len"))


def term_stats(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, df, cf) of the whole corpus."""
    return postings(docs, key, text).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of texts and their mean length in terms."""
    n = F.size(T.tokens(F.col(text)))
    return docs.filter(F.col(text).isNotNull()).agg(F.count("*").alias("n_docs"), F.avg(n).alias("avg_len"))


def bm25(spark: SparkSession, docs: DataFrame, key: str, text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, key, score) of all texts that share a term with a query; a repeated query term counts as often as it stands."""
    q = query_table(spark).select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    terms = q.select("term").distinct()
    hits = postings(docs, key, text, terms)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    one = corpus_stats(docs, text)
    weighted = hits.join(df, "term").crossJoin(F.broadcast(one))  # one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    return weighted.select("key", "term", part.alias("part")).join(q, "term").groupBy("query_id", "key").agg(F.sum(F.col("part") * F.col("qf")).alias("score"))


def top_k(df: DataFrame, k: int, group: str, score: Column, *ties: str) -> DataFrame:
    """The k best rows of each group with their ``rank``; Spark limits each group before the shuffle."""
    w = Window.partitionBy(group).orderBy(score.desc(), *ties)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_top(spark: SparkSession, docs: DataFrame, key: str, k: int = 10, text: str = "text") -> DataFrame:
    hits = bm25(spark, docs, key, text).withColumn("score", F.round("score", 6))
    return top_k(hits, k, "query_id", F.col("score"), "key")


def grams(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf) of words and pairs of words."""
    t = T.tokens(F.col(text))
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.size(t)), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(F.concat(t, pairs)).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))


def tfidf(docs: DataFrame, key: str, text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(key, term, weight): (1 + ln tf) (ln((1+N)/(1+df)) + 1), each text scaled to length 1; terms of more than 95 % of the texts are left out.

    only: terms, of which alone the weights are given. Terms that stand in one text alone, most of all, aren't in the table that is joined; Spark chooses the
    join by its size, and where it is a shuffle, adaptive execution splits hot terms. The length of a text is a sum over the partitioning by key.
    """
    g = grams(docs, key, text)
    df = g.groupBy("term").agg(F.count("*").alias("df")).filter("df > 1")
    one = docs.filter(F.col(text).isNotNull()).agg(F.count("*").alias("n_docs"))
    w = g.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(1))).crossJoin(F.broadcast(one)).filter("df <= 0.95 * n_docs")  # one row
    w = w.withColumn("raw", (1 + F.log("tf")) * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    if only is not None:
        hit = w.join(only.select("term", F.lit(True).alias("wanted")), "term", "left")
        norm = hit.groupBy("key").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), F.collect_list(F.when(F.col("wanted"), F.struct("term", "raw"))).alias("terms"))
        return norm.select("key", "norm", F.explode("terms").alias("x")).select("key", "x.term", (F.col("x.raw") / F.col("norm")).alias("weight"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("key")))
    return w.select("key", "term", (F.col("raw") / norm).alias("weight"))


def cosine_neighbours(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, vec_id, score, rank): for each vector whose id is divisible by ``every`` its k nearest of all others by cosine.

    All rows are compared, in blocks of about 1,000 queries and 20,000 vectors whatever the number of rows, and only the k best of each query
    and block are kept. Vectors without numbers give no row; a vector of zeros is 0 from all.
    """
    import numpy as np
    import pandas as pd

    vectors = vectors.filter("embedding is not null")
    queries = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    n = vectors.count()
    n_blocks, n_salts = -(-n // (every * 1000)) or 1, -(-n // 20000) or 1
    # Query blocks are copied to the groups of vectors, of which there are a fiftieth as many rows, and no vector is.
    blocks = queries.groupBy(F.pmod(F.hash("query_id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "q")).alias("queries"))
    blocks = blocks.select("queries", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_salts - 1).cast("bigint"))).alias("salt"))
    groups = vectors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_salts)).alias("salt")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("vecs"))
    parts = groups.join(blocks, "salt")

    def best(frames):
        for f in frames:
            out = []
            for qs, vs in zip(f["queries"], f["vecs"]):
                a, b = np.array([x["q"] for x in qs], float), np.array([x["embedding"] for x in vs], float)
                qi, vi = np.array([x["query_id"] for x in qs]), np.array([x["vec_id"] for x in vs])
                unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                s = np.round(unit(a) @ unit(b).T, 5)
                s[qi[:, None] == vi[None, :]] = -2
                order = np.lexsort((np.broadcast_to(vi, s.shape), -s))[:, : k]
                for r, cols in enumerate(order):
                    out += [(int(qi[r]), int(vi[c]), float(s[r, c])) for c in cols if s[r, c] > -2]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return top_k(parts.select("queries", "vecs").mapInPandas(best, "query_id long, vec_id long, score double"), k, "query_id", F.col("score"), "vec_id")


def fusion(spark: SparkSession, docs: DataFrame, key: str, alpha: float = 0.7, k: int = 20, text: str = "text") -> DataFrame:
    """(slot_id, key, score, rank): alpha x TF-IDF cosine + (1 - alpha) x BM25 over its best, summed over the queries of a slot."""
    q = query_table(spark)
    lexical = top_k(bm25(spark, docs, key, text).withColumn("score", F.round("score", 6)), k, "query_id", F.col("score"), "key")
    lexical = lexical.select("query_id", "key", (F.col("score") / F.coalesce(F.nullif(F.max("score").over(Window.partitionBy("query_id")), F.lit(0.0)), F.lit(1.0)) * (1 - alpha)).alias("part"))
    qt = q.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    qn = qt.groupBy("query_id").agg(F.sqrt(F.sum((1 + F.log("qf")) * (1 + F.log("qf")))).alias("qnorm"))
    cosine = tfidf(docs, key, text, qt.select("term").distinct()).join(qt, "term").join(qn, "query_id").groupBy("query_id", "key").agg(F.sum(F.col("weight") * (1 + F.log("qf")) / F.col("qnorm")).alias("score"))
    dense = top_k(cosine.withColumn("score", F.round("score", 6)), k, "query_id", F.col("score"), "key").select("query_id", "key", (F.col("score") * alpha).alias("part"))
    total = lexical.unionByName(dense).join(q.select("query_id", "slot_id"), "query_id").groupBy("slot_id", "key").agg(F.round(F.sum("part"), 4).alias("score"))
    return top_k(total, 5, "slot_id", F.col("score"), "key")


def rerank(spark: SparkSession, docs: DataFrame, key: str, k: int = 5, pool: int = 20, text: str = "text") -> DataFrame:
    """(query_id, key, jaccard, rank): the BM25 pool of each query by the overlap of its token set with the query's."""
    candidates = bm25_top(spark, docs, key, pool, text).select("query_id", "key").join(query_table(spark), "query_id").join(docs.select(F.col(key).alias("key"), F.col(text).alias("_t")), "key")
    a, b = F.array_distinct(T.tokens(F.col("query"))), F.array_distinct(T.tokens(F.col("_t")))
    scored = candidates.select("query_id", "key", F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6).alias("jaccard"))
    return top_k(scored, k, "query_id", F.col("jaccard"), "key")
