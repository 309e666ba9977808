"""Ranking: BM25, candidate files, vectors, rank fusion, and measures of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import concept_pattern, concept_tokens, scan_tokens
from lexforge.operators.lines import lines, scope
from lexforge.operators.selection import with_medians

#: BM25, fusion and candidate selection.
K1, B, FUSION_K, CANDIDATE_FILES, LINES_PER_FILE = 1.2, 0.75, 60, 400, 2048

#: Pairs of a query and one of its tokens up to which they are broadcast.
MOST_ASKED = 100_000


#: Stands once in every chunk's postings: it carries the chunk's length into the corpus figures.
_CHUNK = "\0"


def _tokens(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """doc, tokens: made once a row, whatever is asked of them later."""
    return chunks.select(F.col(key).alias("doc"), concept_tokens(F.col(text)).alias("tokens"))


def postings(chunks: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """doc, token, tf."""
    tokens = _tokens(chunks, key, text).select("doc", F.explode("tokens").alias("token"))
    return tokens.groupBy("doc", "token").agg(F.count(F.lit(1)).alias("tf"))


def token_frequency(chunks: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """token, df (chunks that hold it), cf (times it stands in them): shuffled by token alone."""
    one, none = F.lit(1), F.lit(0)
    told = F.concat(
        F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("token"), none.alias("c"), one.alias("d"))),
        F.transform(F.col("tokens"), lambda t: F.struct(t.alias("token"), one.alias("c"), none.alias("d"))),
    )
    # an outer explode: the plain one would test the arrays' sizes first, and make the tokens twice for it
    rows = _tokens(chunks, key, text).select(F.explode_outer(told).alias("t")).select("t.*").where("token IS NOT NULL")
    return rows.groupBy("token").agg(F.sum("d").alias("df"), F.sum("c").alias("cf"))


def bm25(chunks: DataFrame, queries: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """query_id, doc, score of every chunk that shares a token with a query.

    ``queries``: query_id, text; its distinct tokens count.  Chunks without tokens aren't in the corpus.
    One pass makes the tokens; frequencies, lengths and postings come from one exchange of those asked for.
    Scores number about as many as queries times chunks: postings are dealt by chunk, so that few queries' tokens come to them and
    the scores are added up where they arise.  Of more queries than that all postings meet by token, and partial scores move.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(concept_tokens(F.col("text")))).alias("token"))
    few = asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED
    wanted = asked.select("token").union(asked.sparkSession.range(1).select(F.lit(_CHUNK))).distinct()
    told = _tokens(chunks, key, text).select("doc", F.size("tokens").alias("len"), F.concat("tokens", F.array(F.lit(_CHUNK))).alias("tokens"))
    post = told.select("doc", "len", F.explode_outer("tokens").alias("token")).join(F.broadcast(wanted) if few else wanted, "token", "left_semi")
    post = post.groupBy("token", "doc", "len").agg(F.count(F.lit(1)).alias("tf"))
    # all three read the same columns of the same exchange, so that it is made once
    chunk = (F.col("token") == _CHUNK) & (F.col("len") > 0)
    n = F.sum(F.when(chunk, F.col("tf")))
    corpus = post.agg(n.alias("n"), (F.sum(F.when(chunk, F.col("len") * F.col("tf"))) / n).alias("avg_len"))
    df = post.groupBy("token").agg(F.sum(F.when(F.col("len") > 0, F.least("tf", F.lit(1)))).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    if few:
        rarity = asked.join(df, "token").join(F.broadcast(corpus)).select("query_id", "token", "n", "df", "avg_len")
        scored = post.repartition("doc").join(F.broadcast(rarity), "token").withColumn("weight", weight)
        return scored.groupBy("query_id", "doc").agg(F.sum("weight").alias("score"))
    scored = post.join(df, "token").join(F.broadcast(corpus)).withColumn("weight", weight)  # corpus is one row
    return scored.join(asked, "token").groupBy("query_id", "doc").agg(F.sum("weight").alias("score"))


def top_k(scored: DataFrame, k: int, by: str | None = "query_id", ties: list[Column] | None = None) -> DataFrame:
    """Best rows by score (largest first), with their rank; ties by the given columns."""
    window = Window.partitionBy(*([by] if by else [])).orderBy(F.desc("score"), *(ties or [F.col("doc")]))
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def token_lines(files: DataFrame, tokens: list[str]) -> DataFrame:
    """path, token of tokens on lines that any of them opens: such a line counts for each token it holds anywhere."""
    pattern = "|".join(concept_pattern(t).removeprefix("(?iu)") for t in tokens)
    hit = lines(files.where(F.lower("text").rlike("|".join(map(_quoted, tokens))))).where(F.col("text").rlike("(?iu)" + pattern))
    place = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    hit = hit.withColumn("place", place).where(F.col("place") <= LINES_PER_FILE)
    low = F.lower("text")
    held = F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in tokens]), lambda x: x.isNotNull())
    return hit.select("path", F.explode(held).alias("token")).distinct()


def _quoted(token: str) -> str:
    import re

    return re.escape(token)


def candidate_files(files: DataFrame, query: str, wanted: int = CANDIDATE_FILES) -> DataFrame:
    """path, score of the files that hold the rarest tokens of a query: best first, at most ``wanted``."""
    tokens = scan_tokens(query)
    if not tokens:
        raise ValueError("the query has no token of three bytes")
    found = token_lines(files, tokens)
    eligible = files.agg(F.count(F.lit(1)).alias("eligible"))
    weight = found.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(eligible))
    weight = weight.select("token", F.log(1 + F.col("eligible") / F.greatest("df", F.lit(1))).alias("w"))
    scored = found.join(F.broadcast(weight), "token").groupBy("path").agg(F.sum("w").alias("score"))  # 64 tokens at most
    return scored.orderBy(F.desc(F.round("score", 9)), "path").limit(wanted)


def two_stage(files: DataFrame, chunks: DataFrame, query: str, path: str | None = None, k: int = 10, wanted: int = CANDIDATE_FILES) -> DataFrame:
    """Ranked chunks of the candidate files: statistics are theirs alone, the scope applies afterwards."""
    near = chunks.join(F.broadcast(candidate_files(files, query, wanted).select("path")), "path", "left_semi")
    spark = files.sparkSession
    one = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("text"))
    scored = bm25(near, one, key="doc").join(near.select("doc", "path"), "doc").where(scope(path))
    return top_k(scored, k, by=None)


def window_chunks(files: DataFrame, size: int = 32, step: int = 24) -> DataFrame:
    """path, start_line, end_line, text of windows of lines; the last one ends with the file."""
    from lexforge.functions.text import split_lines

    cut = files.select("path", split_lines(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(step))
    # a window that only repeats the end of the one before isn't a new one
    starts = F.filter(starts, lambda s: (s == 0) | (s + size - step < F.size("all")))
    return cut.select("path", "all", F.explode(starts).alias("s")).select(
        "path",
        (F.col("s") + 1).alias("start_line"),
        F.least(F.col("s") + size, F.size("all")).alias("end_line"),
        F.array_join(F.slice("all", F.col("s") + 1, F.lit(size)), "\n").alias("text"),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for unequal lengths, zero vectors and components that aren't finite."""
    fine = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine &= F.forall(b, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & fine & (norms > 0), dot(a, b) / F.nullif(norms, F.lit(0.0)))


def dense_top_k(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Best rows by cosine with one query vector, over all rows: doc, score, rank."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(key).alias("doc"), cosine(F.col(vector), q).alias("score")).where("score IS NOT NULL")
    best = scored.orderBy(F.desc("score"), "doc").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc")))


def fuse(first: DataFrame, second: DataFrame, key: list[str], k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings (columns ``key`` and rank from 1): key, score, rank.

    Ties keep the order in which rows turn up: the first list's before the second's, by rank.
    """
    both = first.select(*key, (1.0 / (k + F.col("rank"))).alias("part"), F.col("rank").alias("seen")).unionByName(
        second.select(*key, (1.0 / (k + F.col("rank"))).alias("part"), (F.col("rank") + F.lit(1 << 40)).alias("seen"))
    )
    merged = both.groupBy(*key).agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))
    return merged.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "seen"))).drop("seen")


def to_embed(chunks: DataFrame, cached: DataFrame, key: str = "key") -> DataFrame:
    """Chunks with the vector that was kept for the same content; null vectors are to be made."""
    return chunks.join(cached.select(key, "embedding"), key, "left")


def first_relevant(ranked: DataFrame, relevant: DataFrame, tasks: DataFrame | None = None, task: str = "task_id", item: str = "doc") -> DataFrame:
    """task, rank of the first relevant item (null if none is found) for every task: those given, or those that have relevant items."""
    if tasks is None:  # relevant items, which may be dear, are asked for once
        return relevant.select(task, item).join(ranked.select(task, item, "rank"), [task, item], "left").groupBy(task).agg(F.min("rank").alias("rank"))
    hit = ranked.join(relevant.select(task, item), [task, item], "left_semi").groupBy(task).agg(F.min("rank").alias("rank"))
    return tasks.select(*tasks.columns).join(hit, task, "left")


def ranking_measures(ranks: DataFrame, by: list[str], cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Mean reciprocal rank and counts of hits within each cut, overall and by the given columns."""
    measures = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        *[F.count_if(F.col("rank") <= k).alias(f"recall_{k}") for k in cuts],
    ]
    return ranks.rollup(*by).agg(*measures) if by else ranks.agg(*measures)


def overlap(a: DataFrame, b: DataFrame, task: str = "task_id", item: str = "doc", k: int = 5) -> DataFrame:
    """Per task: sizes of intersection and union of the first k items, and their quotient."""

    def head(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("rank") <= k).groupBy(task).agg(F.collect_set(item).alias(name))

    both = head(a, "x").join(head(b, "y"), task, "full")
    none = F.array().cast(both.schema["x"].dataType)
    both = both.select(task, F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))
    common, union = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    return both.select(task, common.alias("common"), union.alias("either"), (common / F.nullif(union, F.lit(0))).alias("jaccard"))


def tiers(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Counts of tasks by how far down the first relevant item is."""
    tier = (
        F.when(F.col("rank") == 1, "first")
        .when(F.col("rank") <= 5, "top five")
        .when(F.col("rank") <= 10, "top ten")
        .when(F.col("rank").isNotNull(), "further down")
        .otherwise("missed")
    )
    return ranks.groupBy(*by, tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def rung_summary(cells: DataFrame, rung: str = "rung") -> DataFrame:
    """Per rung of a scale ladder: tasks, found, median and mean rank, bytes and latency."""
    out = cells.groupBy(rung).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("rank").alias("found"),
        F.avg("rank").alias("mean_rank"),
        F.sum("bytes").alias("bytes"),
    )
    return with_medians(out, cells, [rung], {"median_rank": "rank", "median_latency_ms": "latency_ms"})


def cold_and_warm(calls: DataFrame, by: str, order: list[Column], latency: str = "latency_ms") -> DataFrame:
    """Per group: the first call's latency, and median and largest of the others'."""
    first = F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1
    marked = calls.withColumn("first", first)
    out = marked.groupBy(by).agg(
        F.max(F.when(F.col("first"), F.col(latency))).alias("cold"),
        F.max(F.when(~F.col("first"), F.col(latency))).alias("warm_max"),
        F.count(F.lit(1)).alias("calls"),
    )
    return with_medians(out, marked.where(~F.col("first")), [by], {"warm_median": latency})
