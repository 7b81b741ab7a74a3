"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.llm.common import read, tables


def scoped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after which only those of its tables stay that its result is read from."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with tables(spark) as keep:
            return keep(query(spark, sf_dir))

    return run


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portolan.llm.nearest import nearest

    return nearest(read(spark, sf_dir, "embeddings"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portolan.llm.fingerprints import edited_pairs

    return edited_pairs(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from portolan.llm.token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from portolan.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_subword_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from portolan.llm.subword_lm import score_documents

    return score_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portolan.llm.language_id import identify

    return identify(read(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portolan.llm.near_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85, matches=16, hub_rounds=2).select("doc_id", "n_shingles", "component_id", "kept")


#: Exact links between shingle sets, and the smallest id that each text reaches over them.
NEAR_DEDUP_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
d AS (SELECT doc_id, len(s) AS n, s FROM g),
i AS (SELECT doc_id, n, unnest(s) AS t FROM d),
c AS (SELECT a.doc_id AS a, b.doc_id AS b FROM i a JOIN i b ON a.t = b.t AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 100 >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM c UNION SELECT b, a FROM c),
r AS (SELECT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT doc_id, min(seen) AS low FROM r GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, coalesce(m.low, d.doc_id) AS component_id, d.doc_id = coalesce(m.low, d.doc_id) AS kept FROM d LEFT JOIN m USING (doc_id)
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portolan.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portolan.llm.toxicity import score_toxicity

    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans")
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", spans)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portolan.llm.personal_data import span_report

    return span_report(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portolan.llm.vector_codes import coded_vectors

    return coded_vectors(read(spark, sf_dir, "embeddings"))


def _lloyd_sql(rounds: int) -> str:
    """Every part against every entry in whole numbers, so often."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT row, p.part, min(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 64 + entry) AS best FROM p JOIN b{i} b ON p.part = b.part GROUP BY row, p.part)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT p.part, best % 64 AS entry, unnest(p.v) AS c, generate_subscripts(p.v, 1) AS pos FROM p JOIN a{i} a ON p.row = a.row AND p.part = a.part),
m{i} AS (SELECT part, entry, pos, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS c FROM s{i} GROUP BY ALL), n{i} AS (SELECT part, entry, list(c::BIGINT ORDER BY pos) AS v FROM m{i} GROUP BY ALL),
b{i + 1} AS (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{i} b LEFT JOIN n{i} n ON b.part = n.part AND b.entry = n.entry)""")
    return ",\n".join(steps)


VECTOR_CODES_SQL = f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS (SELECT row, x, unnest(range(16)) AS part FROM k), p AS (SELECT row, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS v FROM e), b0 AS (SELECT part, row - 1 AS entry, v FROM p WHERE row <= 64),
{_lloyd_sql(2)},
c AS (SELECT row, string_agg(lower(lpad(to_hex((best % 64)::BIGINT), 2, '0')), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (row), h"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portolan.llm.whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from portolan.llm.bpe import round_trip

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_nearest, op2_fingerprints, op3_token_counts, op4_packing, op5_subword_lm, op6_language_id, op7_near_dedup, op8_mixing, op9_toxicity, op10_personal_data,
        op11_vector_codes, op12_whitening, op13_bpe,
    ]
    return {f.__name__: scoped(f) for f in found}


def oracle_sql() -> dict[str, str]:
    """The others depend on tokenizers, hashes, fitted models or eigenvectors, and are tested against brute force."""
    return {"op7_near_dedup": NEAR_DEDUP_SQL, "op11_vector_codes": VECTOR_CODES_SQL}
