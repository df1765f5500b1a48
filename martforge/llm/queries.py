"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch_path, ship_package
from . import (centroids, chat_format, decontaminate, jaccard_join, license_scan, mixing, packing, quality_gam, substring_dedup, token_count,
               token_files, topk_search, whitening)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_quality_gam")
def op1(spark, sf_dir):
    """Quality score of every document by the additive model."""
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op2_token_files")
def op2(spark, sf_dir):
    """Token files of all documents, written and read back."""
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, VOCABULARY, END_ID)
    return token_files.digest(spark, folder)


@register("op7_token_count")
def op7(spark, sf_dir):
    """Token count of every document by the compiled transducer."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


@register("op8_chat_format")
def op8(spark, sf_dir):
    """All conversations and the planted one, formatted and read back."""
    planted = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), "
                        "(-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.digest(chat_format.format_conversations(turns))


def _chat_sql() -> str:
    t = chat_format.TEMPLATE
    marks = " ".join(f"WHEN role = '{r}' THEN {len(m[0]) + len(m[1])}" for r, m in t.roles.items())
    loss = ", ".join(f"'{r}'" for r, m in t.roles.items() if m[2])
    esc = "text"
    for plain, coded in chat_format.ESCAPES:
        esc = f"replace({esc}, '{plain}', '{coded}')"
    role_esc = esc.replace("text", "role")
    return f"""
WITH planted(conv_id, turn, role, text) AS (VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'),
                                                   (-7::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
          FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM planted)),
coded AS (SELECT conv_id, turn, role, text, CASE {marks} ELSE {len(t.other_open) + 1 + len(t.other_close)} + length({role_esc}) END
                 + length({esc}) AS chars,
                 CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END AS letter FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role IN ({loss})), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role IN ({loss})), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       regexp_full_match(string_agg(letter, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS valid
FROM coded GROUP BY conv_id"""


ORACLES["op8_chat_format"] = _chat_sql()


@register("op4_decontaminate")
def op4(spark, sf_dir):
    """Benchmark passages in every document, by winnowing."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op4_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS w FROM benchmark),
lengths AS (SELECT DISTINCT least(10, len(w)) AS t FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, t, array_to_string(w[p:p + t - 1], ' ') AS run
       FROM (SELECT item_id, w, least(10, len(w)) AS t, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT r, t, p, array_to_string(w[p:p + t - 1], ' ') AS run
       FROM (SELECT r, w, t, unnest(range(1, len(w) - t + 2)) AS p FROM d, lengths WHERE len(w) >= t)),
hits AS (SELECT r, p, dw.t, item_id FROM dw JOIN iw ON dw.run = iw.run AND dw.t = iw.t),
hit_words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + t)) AS q FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)"""


@register("op9_topk_search")
def op9(spark, sf_dir):
    """Five best other vectors of each query vector, exactly."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op9_topk_search"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@register("op10_jaccard_join")
def op10(spark, sf_dir):
    """Components of documents with nearly equal 3-word shingle sets."""
    return jaccard_join.join(table(spark, sf_dir, "documents"))


ORACLES["op10_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[p:p + 2], ' ') AS shingle
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS MATERIALIZED (SELECT a.r AS x, b.r AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.r < b.r GROUP BY a.r, b.r
  HAVING 100 * count(*) >= 90 * ((SELECT n FROM n WHERE r = a.r) + (SELECT n FROM n WHERE r = b.r) - count(*))),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT r, r AS y FROM w UNION SELECT reached.r, b.y FROM reached JOIN both_ways b ON reached.y = b.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(v.doc_id)::BIGINT AS component_id
FROM reached JOIN w USING (r) JOIN w v ON v.r = reached.y LEFT JOIN n ON n.r = w.r GROUP BY w.r, w.doc_id"""


@register("op6_mixing")
def op6(spark, sf_dir):
    """Every document's probability under the raked mix, and its draw."""
    return mixing.sample(table(spark, sf_dir, "documents"))


def _mix_sql(mix: mixing.Mix) -> str:
    topics = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in mixing.TOPICS)
    parts = [rf"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {topics} ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents)""",
             "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS raked FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"]
    for m in mixing.MARGINS:
        parts.append(f"n_{m} AS (SELECT {m}, sum(tokens) AS n FROM c0 GROUP BY {m})")
        parts.append(f"t_{m} AS MATERIALIZED (SELECT {m}, sum(n) OVER () * pow(n, {mix.power[m]}) / sum(pow(n, {mix.power[m]})) OVER () AS target FROM n_{m})")
    n = 0
    for _ in range(mix.sweeps):
        for m in mixing.MARGINS:
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, raked * target / sum(raked) OVER (PARTITION BY {m}) AS raked FROM c{n} JOIN t_{m} USING ({m}))")
            n += 1
    parts.append(f"r0 AS MATERIALIZED (SELECT {mix.keep}::DOUBLE AS rate)")
    for i in range(mix.steps):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT any_value(rate) * {mix.keep} * sum(tokens) / sum(least(1.0, raked / tokens * rate) * tokens) AS rate FROM c{n}, r{i})")
    parts.append(f"p AS (SELECT source, lang, topic, round(least(1.0, raked / tokens * rate), 6) AS p FROM c{n}, r{mix.steps})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, coalesce(p, 1.0)::DOUBLE AS p,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{mix.seed}'), 1, 12))::UBIGINT / {16 ** 12}::DOUBLE < coalesce(p, 1.0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)"""


ORACLES["op6_mixing"] = _mix_sql(mixing.Mix())


@register("op3_license_scan")
def op3(spark, sf_dir):
    """Licenses declared in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@register("op5_substring_dedup")
def op5(spark, sf_dir):
    """Documents with passages that other documents hold too."""
    return substring_dedup.repeated(table(spark, sf_dir, "documents"))


PACK_END_ID = 1


@register("op11_packing")
def op11(spark, sf_dir):
    """All documents packed into sequences of 2,048 tokens."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, PACK_END_ID))


@register("op12_whitening")
def op12(spark, sf_dir):
    """Whitened embeddings, 16 components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


@register("op13_centroids")
def op13(spark, sf_dir):
    """Embeddings clustered around 8 centroids, 10 rounds."""
    return centroids.digest(centroids.cluster(table(spark, sf_dir, "embeddings")))


def _centroid_sql(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c
  FROM (SELECT sha256('{seed}:' || vec_id::VARCHAR) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT r, k,
  list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM v, c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
  SELECT k, list(q ORDER BY j) AS c FROM (SELECT k, j, floor(sum(x[j]) / count(*)) AS q
    FROM a{i} JOIN v USING (r), range(1, {dims + 1}) AS t(j) GROUP BY k, j) GROUP BY k) m USING (k))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c, lambda e: e::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (k)"""


ORACLES["op13_centroids"] = _centroid_sql()
