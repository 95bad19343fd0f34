"""Ranked lexical search by NRA: sequential reads in order of impact, with score intervals.

Every query term has lists of postings (document, contribution to the score), one for each class of documents of like length,
as equally long documents get like contributions from a term and so leave tight bounds. A contribution depends on the term and
the document only, so all lists are read together from the largest contribution down, in ``SHARES`` steps. A document that was
met has a score interval for a query: what its read postings sum up to, and that plus, for each of the query's terms not met
in it yet, the largest contribution its list still has unread. These largest contributions are known for all steps from one
pass over the lists, so a document only keeps their sums over the terms met in it.

* A class stays open for a query while a document of it that was never met could reach the query's k-th lower bound.
  Afterwards only its candidates are looked up in what is read.
* A candidate whose upper bound is below the k-th lower bound goes. Ties stay, so equal scores are decided by id.
* Reading ends when every query is closed and the intervals of all its candidates are points: members, order and scores are
  final then, and equal to those of full sums. After the last step all intervals are points.

No random access is made, nothing is capped, and documents that were ruled out are never summed up.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flickpulse.operators.scale import shared_root, stage

#: The same code points as ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``; Java matches a plain union ten times as fast.
TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shares of the postings that have been read after each step.
SHARES = (1 / 256, 1 / 32, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1)
#: Classes of documents for each doubling of the length.
CLASSES = 6


def terms(text: str) -> Column:
    """The terms of a text in order, with repeats."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


def _postings(docs: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, int, int]:
    """``doc_, t, tf, n`` of the vocabulary's terms, and the counts N and L of the whole table."""
    rows = docs.select("doc_", F.regexp_count("text_", F.lit(TERM)).cast("long").alias("n")).filter("n > 0")
    lengths = stage(rows.groupBy("doc_").agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("rows")))
    n_docs, n_terms = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_all"), F.lit(0))).first()
    split = docs.select("doc_", terms("text_").alias("all_")).select("doc_", F.size("all_").cast("long").alias("n"), "all_")
    # all postings of a document lie in one file, so that later sums are almost complete before they are shuffled
    found = stage(split.select("doc_", "n", F.explode("all_").alias("term")).join(vocabulary, "term").select("doc_", "n", "t")
                  .repartition("doc_", "n").groupBy("doc_", "n", "t").agg(F.count(F.lit(1)).alias("tf")))
    # rows that repeat an id are one document
    several = stage(lengths.filter("rows > 1").select("doc_", "n_all"))
    merged = found.join(several, "doc_").groupBy("doc_", "t", F.col("n_all").alias("n")).agg(F.sum("tf").alias("tf"))
    single = found.join(several, "doc_", "left_anti").select("doc_", "t", "n", "tf")
    return single.unionByName(merged), n_docs, n_terms


def _contributions(postings: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``s, doc_, t, c``: the document's class, and what a term adds to a document's score; terms in all documents add nothing and are left out."""
    weight = stage(postings.groupBy("t").agg(F.count(F.lit(1)).alias("df")).select(
        "t", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")))
    m = f"(10L + ((90L * n * {n_docs}L) div {max(n_terms, 1)}L))"
    return postings.join(weight, "t").select(
        F.expr(f"int({CLASSES} * log2({m}))").alias("s"), "doc_", "t", F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 8L * {m}))").alias("c")).filter("c > 0")


def _in_steps(contributions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists cut into steps of falling contributions, one folder a step; and ``t, s, f0, ...``: of every step, the
    largest contribution that each list has after it."""
    cuts = contributions.agg(F.percentile_approx("c", [1 - s for s in SHARES[:-1]], 10_000)).first()[0] or []
    step = F.lit(0)
    for cut in cuts:
        step = step + F.when(F.col("c") < F.lit(cut), 1).otherwise(0)
    spark = contributions.sparkSession
    path = f"{shared_root(spark)}/lists-{uuid.uuid4().hex}"
    contributions.withColumn("step", step).write.partitionBy("step").parquet(path)
    lists = spark.read.schema("s int, doc_ long, t long, c long, step int").parquet(path)
    left = [F.coalesce(F.max(F.when(F.col("step") > i, F.col("c"))), F.lit(0)).alias(f"f{i}") for i in range(len(SHARES))]
    return lists, stage(lists.groupBy("t", "s").agg(*left))


def _kth(candidates: DataFrame, k: int) -> DataFrame:
    """``q, b``: the k-th largest lower bound of every query that has k candidates."""
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("low"), "doc_"))
    return candidates.select("q", "low", "doc_", rank.alias("r")).filter(F.col("r") <= k).filter(F.col("r") == k).select("q", F.col("low").alias("b"))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``query_id, rank, doc_id, score``: each query's ``k`` best documents with a score above 0, equal scores by ascending id.

    Defined cases: null, empty and term-less texts of documents and queries take no part (they count neither in N nor in L, and
    such a query has no rows). Rows that repeat a document's id are one document of all their terms, rows that repeat a query's
    id one query of all its terms. Rows with null ids take no part. A query with fewer than ``k`` scoring documents gets those.
    Other columns are not read. Empty tables give an empty result.
    """
    q_terms = queries.select(F.col(query_id).cast("long").alias("q"), F.explode(terms(query_text)).alias("term")).filter("q is not null").distinct()
    q_terms = stage(q_terms.repartition("q"))
    vocabulary = stage(q_terms.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_"), F.col(text_col).alias("text_")).filter("doc_ is not null")
    lists, frontier = _in_steps(_contributions(*_postings(texts, vocabulary)))
    edges = [f"f{i}" for i in range(len(SHARES))]
    q_lists = stage(q_terms.join(vocabulary, "term").join(frontier, "t").select("q", "s", "t", *edges))
    rests = stage(q_lists.groupBy("q", "s").agg(*[F.sum(f).alias(f) for f in edges]))

    done, candidates = None, None  # done: final rows of the classes that need no more reads
    state = rests.select("q", "s", F.lit(True).alias("open"))
    for i, edge in enumerate(edges):
        later = edges[i:-1]  # nothing is unread after the last step
        now = lists.filter(F.col("step") == i).select("s", "doc_", "t", F.col("c").alias("low"))
        own = q_lists.select("q", "s", "t", *later).join(state, ["q", "s"])
        met = now.join(own.filter("open"), ["t", "s"]).select("q", "s", "doc_", "low", *later)
        if candidates is not None:
            closed = candidates.filter("not open").select("q", "s", "doc_")
            looked_up = closed.join(now.drop("s"), "doc_").join(own, ["q", "s", "t"])
            met = met.unionByName(looked_up.select(*met.columns)).unionByName(candidates.select(*met.columns))
        summed = stage(met.groupBy("q", "s", "doc_").agg(*[F.sum(c).alias(c) for c in ("low", *later)]))
        known = summed.select("q", "doc_", "low")
        known = known if done is None else known.unionByName(done)
        bounds = stage(rests.select("q", "s", F.col(edge).alias("rest")).join(state, ["q", "s"]).join(_kth(known, k), "q", "left")
                       .withColumn("b", F.coalesce("b", F.lit(0))))
        high = F.col("low") + (F.col("rest") - F.col(edge) if later else 0)
        kept = summed.join(bounds.drop("open"), ["q", "s"]).withColumn("high", high).filter("high >= b")
        wide = kept.groupBy("q", "s").agg(F.max(F.col("high") > F.col("low")).alias("wide"))
        now_open = F.col("open") & (F.col("rest") >= F.greatest("b", F.lit(1)))
        state = stage(bounds.join(wide, ["q", "s"], "left")
                      .select("q", "s", now_open.alias("open"), F.coalesce("wide", F.lit(False)).alias("wide")))
        # both kinds of rows in one table, so that the next step reads its candidates instead of joining for them twice
        judged = stage(kept.join(state, ["q", "s"]).select("q", "s", "doc_", "low", *later, "open", "wide"))
        ready = judged.filter("not open and not wide").select("q", "doc_", "low")
        done = ready if done is None else done.unionByName(ready)
        candidates = judged.filter("open or wide")
        state = state.filter("open or wide").select("q", "s", "open")
        if state.isEmpty():
            break
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("low"), "doc_"))
    return done.select("q", "doc_", "low", rank.alias("rank")).filter((F.col("rank") <= k) & (F.col("low") > 0)).select(
        F.col("q").alias("query_id"), "rank", F.col("doc_").alias("doc_id"), F.col("low").alias("score"))
