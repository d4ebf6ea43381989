"""Queries of the corpus operators, with production settings, and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moralens.llm import chat_format, decontaminate, mixing, near_dups, periodic_runs, pii, quality, search, secret_scan, spelling
from moralens.llm import substring_dups, token_counts, url_filter

Query = Callable[[SparkSession, str], DataFrame]


#: Rows and bytes that go to Python at once: texts are long, so the usual 10,000 rows take much memory.
BATCH_ROWS, BATCH_BYTES = 1_000, 1 << 23


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of ``sf_dir``; the session's Arrow batches are set for tables of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(read(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(read(spark, sf_dir, "documents"))
    draws = [F.round(F.try_element_at("positions", F.lit(k)), 6).alias(n) for k, n in ((1, "position"), (2, "second_position"))]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", *draws)


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50 searches all documents by its whole text."""
    documents = read(spark, sf_dir, "documents")
    queries = documents.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.top_documents(documents, queries).withColumn("score", F.round("score", 4))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_verdicts(pages, url_filter.crawled_twice(pages))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dups.repeated_bytes(read(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_digest(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"), spelling.TYPO_RATE)


#: Texts full of another template's control strings, formatted with the table's conversations.
CONTROL_CONVERSATION = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id bigint, turn bigint, role string, text string")
    return chat_format.read_back(chat_format.chat_examples(conversations.unionByName(more)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_secrets,
        op3_mix,
        op4_search,
        op5_near_duplicates,
        op6_url_filter,
        op7_repeated_bytes,
        op8_personal_data,
        op9_token_counts,
        op10_quality,
        op11_spelling_variants,
        op12_chat_format,
        op13_periodic_runs,
    )
}

ORACLES: dict[str, str] = {
    "op4_search": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+')) AS term FROM documents
), postings AS (
  SELECT doc_id, term, count(*)::DOUBLE AS tf FROM words GROUP BY ALL
), lengths AS (
  SELECT doc_id, count(*)::DOUBLE AS words FROM words GROUP BY ALL
), corpus AS (
  SELECT count(*)::DOUBLE AS n, (SELECT sum(words) FROM lengths) / count(*) AS mean FROM documents
), idf AS (
  SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS weight
  FROM (SELECT term, count(*)::DOUBLE AS df FROM postings GROUP BY ALL), corpus
), scored AS (
  SELECT q.doc_id AS query_id, p.doc_id, sum(weight * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * words / mean))) AS score
  FROM postings q JOIN postings p USING (term) JOIN idf USING (term) JOIN lengths l ON l.doc_id = p.doc_id, corpus
  WHERE q.doc_id % 50 = 0 GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM scored
)
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM ranked WHERE rank <= 10
""",
    "op3_mix": r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS nr
  FROM sized GROUP BY source
), caps AS (
  SELECT *, 2.0::DOUBLE * source_size::DOUBLE AS cap,
         CASE (nr - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM totals
), filled AS (
  SELECT *, cap / weight::DOUBLE AS ratio FROM caps
), levels AS (
  SELECT *,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY ratio, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
         / (sum(weight) OVER (ORDER BY ratio, nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM filled
), targets AS (
  SELECT *, CASE WHEN ratio <= level THEN cap
                 ELSE weight::DOUBLE * max(CASE WHEN ratio > level THEN level END) OVER () END AS target
  FROM levels
), queued AS (
  SELECT s.doc_id, s.size, t.nr, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY t.nr ORDER BY md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), s.size
                           ROWS UNBOUNDED PRECEDING) - s.size AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), drawn AS (
  SELECT *, (ahead + size / 2.0::DOUBLE <= target)::INT AS once,
         (source_size + ahead + size / 2.0::DOUBLE <= target)::INT AS twice,
         ahead::DOUBLE / target AS q, (source_size + ahead)::DOUBLE / target AS q2
  FROM queued
)
SELECT doc_id, size, source_size, target, (size * (once + twice))::BIGINT AS taken,
       CASE WHEN size > 0 AND once = 1 THEN round(CASE (nr - 1) % 3
         WHEN 0 THEN q
         WHEN 1 THEN CASE WHEN q * 0.75 <= 0.25 THEN 2 * (q * 0.75) / (0.5 + sqrt(0.25))
                          ELSE 0.5 + 2 * (q * 0.75 - 0.25) / (0.5 + sqrt(0.25 + 4 * (q * 0.75 - 0.25))) END
         ELSE CASE WHEN q * 0.75 <= 0.5 THEN 2 * (q * 0.75) / (1.5 + sqrt(2.25 - 4 * (q * 0.75)))
                   ELSE 0.5 + 2 * (q * 0.75 - 0.5) / (0.5 + sqrt(0.25)) END
       END, 6) END AS position,
       CASE WHEN size > 0 AND twice = 1 THEN round(CASE (nr - 1) % 3
         WHEN 0 THEN q2
         WHEN 1 THEN CASE WHEN q2 * 0.75 <= 0.25 THEN 2 * (q2 * 0.75) / (0.5 + sqrt(0.25))
                          ELSE 0.5 + 2 * (q2 * 0.75 - 0.25) / (0.5 + sqrt(0.25 + 4 * (q2 * 0.75 - 0.25))) END
         ELSE CASE WHEN q2 * 0.75 <= 0.5 THEN 2 * (q2 * 0.75) / (1.5 + sqrt(2.25 - 4 * (q2 * 0.75)))
                   ELSE 0.5 + 2 * (q2 * 0.75 - 0.5) / (0.5 + sqrt(0.25)) END
       END, 6) END AS second_position
FROM drawn
""",
    "op6_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1),
                        '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS query
  FROM cut
), named AS (
  SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN
              regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
              || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical
  FROM split
), ruled AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
    coalesce(canonical IS NOT NULL AND count(canonical) OVER (PARTITION BY canonical) > 1, false) AS listed
  FROM named
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
       canonical, listed
FROM ruled
""",
    "op12_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), pieces AS (
  SELECT *, greatest(floor(coalesce(turn, 0) / 32), 0)::BIGINT AS block,
         length('<|im_start|>' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), control, '\1\\\2\3', 'g') || chr(10)
                || regexp_replace(text, control, '\1\\\2\3', 'g') || '<|im_end|>' || chr(10)) AS chars
  FROM turns, (SELECT '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)' AS control)
), placed AS (
  SELECT *, row_number() OVER turns - 1 AS nr, coalesce(sum(chars) OVER (turns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM pieces WINDOW turns AS (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)
), parts AS (
  SELECT *, before + chars - min(before) OVER part AS held, nr = max(nr) OVER part AS is_last
  FROM placed WINDOW part AS (PARTITION BY conv_id, block, nr // 32, before // 65536)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY block, nr)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY block, nr) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR is_last THEN held ELSE 0 END)::BIGINT AS formatted_chars
FROM parts GROUP BY conv_id
""",
}
