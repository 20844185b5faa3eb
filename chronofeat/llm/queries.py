"""Registered queries of the operators, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (arc_warc, decontaminate, exact_dedup, langid, mixing, quality_knn,
               sentencepiece_spans, simhash_dedup, spelling, superkmer, token_counts,
               toxicity, vector_codes)
from .common import table


def q_op1(spark, sf_dir):
    return arc_warc.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def q_op2(spark, sf_dir):
    done = quality_knn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", quality_knn.held_out().alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def q_op3(spark, sf_dir):
    done = superkmer.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed",
                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def q_op4(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def q_op5(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def q_op6(spark, sf_dir):
    done = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                       (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                       F.size("offending").alias("n_offending"))


def q_op7(spark, sf_dir):
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"))


def q_op8(spark, sf_dir):
    return simhash_dedup.near_groups(table(spark, sf_dir, "documents"))


def q_op9(spark, sf_dir):
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc_key").alias("doc_id"), F.col("item").alias("item_id"),
                        F.round("similarity", 6).alias("similarity"), "window_start",
                        "window_words", "differing_bits")


def q_op10(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def q_op11(spark, sf_dir):
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


def q_op12(spark, sf_dir):
    import public_tokenizers

    done = sentencepiece_spans.encode_documents(table(spark, sf_dir, "documents"),
                                                public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                       F.element_at("ends", -1).alias("n_bytes"))


def q_op13(spark, sf_dir):
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                        F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES = {
    "op1_arc_to_warc": q_op1,
    "op2_quality_knn": q_op2,
    "op3_superkmer_dedup": q_op3,
    "op4_mixing": q_op4,
    "op5_language_id": q_op5,
    "op6_toxicity_mil": q_op6,
    "op7_token_counts": q_op7,
    "op8_simhash_dedup": q_op8,
    "op9_decontamination": q_op9,
    "op10_exact_dedup": q_op10,
    "op11_spelling_variants": q_op11,
    "op12_sentencepiece": q_op12,
    "op13_vector_codes": q_op13,
}

def _vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The codes in plain SQL: every part against every entry, round by round."""
    nearest = """near{r} AS (
            SELECT row, part, min(struct_pack(d := d, entry := entry)) AS best FROM (
                SELECT x.row, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d
                FROM x JOIN book{r} b ON b.part = x.part AND b.pos = x.pos
                GROUP BY x.row, x.part, b.entry) GROUP BY row, part)"""
    move = """mean{r} AS (
            SELECT n.part, n.best.entry AS entry, x.pos,
                   sum(x.v)::HUGEINT AS s, count(*)::HUGEINT AS c
            FROM near{q} n JOIN x ON x.row = n.row AND x.part = n.part GROUP BY ALL),
        book{r} AS (
            SELECT b.part, b.entry, b.pos, coalesce(
                (m.s - ((m.s % m.c) + m.c) % m.c) // m.c, b.v)::BIGINT AS v
            FROM book{q} b LEFT JOIN mean{r} m
              ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""
    steps = [nearest.format(r=0)]
    for r in range(1, rounds + 1):
        steps += [move.format(q=r - 1, r=r), nearest.format(r=r)]
    return f"""
        WITH kept AS (
            SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS row
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding,
                  lambda z: z IS NULL OR NOT isfinite(z))) = 0),
        x AS (
            SELECT row, (i - 1) // (n // {parts}) AS part, (i - 1) % (n // {parts}) AS pos,
                   floor(256 * z::DOUBLE)::BIGINT AS v
            FROM (SELECT row, len(embedding) AS n, unnest(embedding) AS z,
                         generate_subscripts(embedding, 1) AS i FROM kept)),
        book0 AS (SELECT part, (row - 1)::BIGINT AS entry, pos, v FROM x WHERE row <= {entries}),
        {", ".join(steps)},
        coded AS (
            SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code,
                   sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY row),
        said AS (
            SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS h
            FROM book{rounds})
        SELECT k.vec_id, c.code, c.error,
               (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
               said.h AS codebooks_sha256
        FROM kept k JOIN coded c ON c.row = k.row CROSS JOIN said"""


ORACLE_SQL = {
    "op1_arc_to_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
                   sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, payload_bytes, h AS payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit'
                    ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM g""",
    "op10_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
            FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d""",
    "op13_vector_codes": _vector_codes_sql(),
}
