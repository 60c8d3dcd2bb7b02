"""The opN_ queries: each applies one operator of this subpackage to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_format_preserving_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronlake.llm.pii import pseudonymise_documents

    # the key belongs in a secret store; this one only makes results repeatable
    return pseudonymise_documents(_table(spark, sf_dir, "documents"), key="repeatable-example-key").select("doc_id", "text", "pii")


def op2_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from heronlake.llm.collision_search import search

    rows = _table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from heronlake.llm.language_id import fit, predict, remainder

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder("doc_id") != 2))
    held_out = F.coalesce(remainder("doc_id") == 2, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held_out, "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronlake.llm.jaccard_join import linked_groups

    return linked_groups(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from heronlake.llm.chat import as_transcripts, fit, held_out, parse, render

    lines = as_transcripts(_table(spark, sf_dir, "conversations"))
    turns = render(parse(lines.drop("role"), fit(lines.where(~held_out(F.col("conv_id")))), ["turn", "idx"]))
    return turns.withColumn("held_out", held_out(F.col("conv_id")))


def op6_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronlake.llm.licences import classify, fit

    docs = _table(spark, sf_dir, "documents")
    return classify(docs, fit(spark, docs.where("text IS NOT NULL")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from heronlake.llm.packing import pack_documents

    packed = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from heronlake.llm.chunk_store import read_documents, write_store

    path = write_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_documents(spark, path)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronlake.llm.exact_dedup import groups

    return groups(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from heronlake.llm.sentencepiece_lattice import encode_documents

    coded = encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "round_trip", "ids")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heronlake.llm.phrases import mine

    return mine(_table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from heronlake.llm.alignment import align_documents

    return align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from heronlake.llm.bpe_chunks import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_format_preserving_pii, op2_collision_search, op3_language_id, op4_jaccard_join, op5_chat_format, op6_licence_classifier, op7_best_fit_packing, op8_token_store, op9_exact_dedup, op10_sentencepiece, op11_phrase_mining, op12_token_alignment, op13_bpe_chunks)}

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_AZ} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g ON d.norm = g.norm
    """,
    "op11_phrase_mining": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_AZ}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
        f1 AS (SELECT lang, w[i] AS p, count(*) AS f FROM places GROUP BY ALL),
        f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM places WHERE i < len(w) GROUP BY ALL),
        f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM places WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
        covers AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
        cut AS (
            SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
            FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.p = c.x JOIN f1 r ON r.lang = c.lang AND r.p = c.y
            LEFT JOIN covers v ON v.lang = c.lang AND v.x = c.x AND v.y = c.y
            WHERE c.f >= 10 AND NOT coalesce(100 * v.f >= 50 * c.f, FALSE)
            UNION ALL
            SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 1, l.f, r.f
            FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.p = c.x JOIN f2 r ON r.lang = c.lang AND r.x = c.y AND r.y = c.z
            UNION ALL
            SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 2, l.f, r.f
            FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.x = c.x AND l.y = c.y JOIN f1 r ON r.lang = c.lang AND r.p = c.z
        ), scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cut),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
