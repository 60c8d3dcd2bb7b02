"""A kept lexical index: postings by scope, of which a refresh rebuilds stale scopes only, and a log of scope statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.operators.retrieval import SCOPE, term_counts
from heronlake.sources.staging import written

_SCHEMAS = {
    "postings": "chunk_id string, chunk_type string, len int, n long, terms array<string>, tfs array<bigint>, scope string",
    "stats": "scope string, class string, subject string, docs long, avgdl double, cache_key string, version long",
}
_READ = ("chunk_id", "chunk_type", "text", "chapter", "section", "source_hash")


def scope_key() -> Column:
    """One safe folder name for each class and subject, nulls told apart from empty names."""
    return F.md5(F.to_json(F.struct(*SCOPE), {"ignoreNullFields": "false"}))


def content_keys(chunks: DataFrame) -> DataFrame:
    """scope, class, subject, cache_key: the number of a scope's chunks and the sum of the hashes of all that the index reads.

    A sum is pre-aggregated in each task, so a scope with most of the rows is no hot one; nulls count as themselves.
    """
    row = F.xxhash64(*_READ, *[F.col(c).isNull() for c in _READ]).cast("decimal(20,0)")
    return chunks.groupBy(scope_key().alias("scope"), *SCOPE).agg(F.concat_ws("-", F.count("*"), F.sum(row)).alias("cache_key"))


def open_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """postings and stats, one row a scope: the last of its log. Before the first refresh both are empty.

    A file row holds a chunk's terms and counts as two arrays; reading them gives one row for each term of a chunk.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/stats")
    there = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files)
    out = {name: spark.read.schema(schema).parquet(f"{path}/{name}") if there else spark.createDataFrame([], schema) for name, schema in _SCHEMAS.items()}
    last = out["stats"].groupBy("scope").agg(F.max_by(F.struct(*SCOPE, "docs", "avgdl", "cache_key"), "version").alias("s"), F.max("version").alias("version"))
    pairs = F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("p")
    postings = out["postings"].select("chunk_id", "chunk_type", "len", "scope", pairs).select("p.term", "chunk_id", "chunk_type", "len", "p.tf", "scope")
    return {"postings": postings, "stats": last.select("scope", "s.*", "version")}


def _counts(chunks: DataFrame) -> DataFrame:
    """chunk_id, chunk_type, len, n, terms, tfs, scope, where n is the number of rows that a chunk stands for.

    Rows of one scope, id, type and length become one, with their counts added; only rows whose id repeats move for that.
    """
    keys, chunk = ["scope", "chunk_id", "chunk_type", "len"], ["scope", "chunk_id"]
    repeated = chunks.groupBy(*chunk).agg(F.count("*").alias("times")).where("times > 1").select(*[F.col(k).alias(f"_{k}") for k in chunk])
    repeated = written(repeated, "repeated-chunks")
    counted = lambda df: term_counts(df, ["scope", "chunk_id", "chunk_type"]).select(*keys, F.lit(1).cast("long").alias("n"), "terms", "tfs")
    if repeated.isEmpty():
        return counted(chunks)
    same = lambda names: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names]
    some = counted(chunks.join(repeated, same(chunk), "left_semi"))
    terms = some.select(*keys, F.explode(F.arrays_zip("terms", "tfs")).alias("p")).groupBy(*keys, F.col("p.terms").alias("term")).agg(F.sum("p.tfs").alias("tf"))
    lists = terms.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("l")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("l.term").alias("terms"), F.col("l.tf").alias("tfs"))
    rows = some.groupBy(*keys).agg(F.sum("n").alias("n")).join(lists, same(keys), "left")
    merged = rows.select(*keys, "n", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("tfs", F.array().cast("array<bigint>")).alias("tfs"))
    return counted(chunks.join(repeated, same(chunk), "left_anti")).unionByName(merged)


def refresh(chunks: DataFrame, path: str) -> DataFrame:
    """Bring the index at ``path`` up to date and return what was rebuilt: scope, class, subject, cache_key.

    Scopes whose key is the stored one are not read again. Statistics, which hold the key, are appended to their log last:
    a refresh that dies leaves its scopes stale, and the next rebuilds them. A scope that lost all its chunks gets a row
    with no chunks and a null key, which no search meets. One refresh at a time; repeated chunk ids count together.
    """
    spark = chunks.sparkSession
    stored = open_index(spark, path)["stats"]
    now = written(content_keys(chunks), "scope-keys")
    changed = now.join(stored.select("scope", "cache_key"), ["scope", "cache_key"], "left_anti").select("scope", *SCOPE, "cache_key")
    gone = stored.where("docs > 0").join(now.select("scope"), "scope", "left_anti").select("scope", *SCOPE)
    changed = written(changed, "stale-scopes")
    log = gone.select("*", F.lit(0).cast("long").alias("docs"), F.lit(None).cast("double").alias("avgdl"), F.lit(None).cast("string").alias("cache_key"))
    if not changed.isEmpty():
        stale = chunks.withColumn("scope", scope_key()).join(changed.select("scope"), "scope", "left_semi")
        counts = _counts(stale)
        # one row a chunk moves, not one a posting; files hold few scopes, and a large scope is several files
        even = spark.sql("SELECT /*+ REBALANCE(scope) */ chunk_id, chunk_type, len, n, terms, tfs, scope FROM {c}", c=counts).sortWithinPartitions("scope")
        even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope").parquet(f"{path}/postings")
        lens = spark.read.schema(_SCHEMAS["postings"]).parquet(f"{path}/postings").select("scope", "len", "n").join(changed, "scope")
        stats = lens.groupBy("scope", *SCOPE, "cache_key").agg(F.sum("n").alias("docs"), (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("avgdl"))
        log = log.unionByName(stats.select("scope", *SCOPE, "docs", "avgdl", "cache_key"))
    elif gone.isEmpty():
        return changed
    version = (stored.agg(F.max("version")).first()[0] or 0) + 1
    log = written(log.withColumn("version", F.lit(version).cast("long")), "scope-stats")  # it reads the log that it goes to
    log.coalesce(1).write.mode("append").parquet(f"{path}/stats")
    return changed
