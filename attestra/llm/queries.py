"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestra.llm.clusters import clustered
from attestra.llm.common import read
from attestra.llm.decontamination import contaminated
from attestra.llm.exact_dedup import exact_duplicates
from attestra.llm.language import predicted_languages
from attestra.llm.line_dedup import without_boilerplate
from attestra.llm.mixing import mix_counts
from attestra.llm.packing import packed_digests
from attestra.llm.quality import resampled
from attestra.llm.sharding import shard_by_splitters
from attestra.llm.simhash import near_duplicates
from attestra.llm.spelling import spelling_groups
from attestra.llm.substring_dedup import without_repeats
from attestra.llm.url_filter import judged_urls


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_splitters(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_boilerplate(read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted_languages(read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(read(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read(spark, sf_dir, "documents"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # needed by this query alone

    return packed_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_sharding,
        op3_line_dedup,
        op4_quality,
        op5_substring_dedup,
        op6_exact_dedup,
        op7_language_id,
        op8_simhash,
        op9_url_filter,
        op10_mixing,
        op11_spelling_variants,
        op12_clustering,
        op13_packing,
    )
}


def kmeans_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds, one after another. Whole numbers throughout: a mean's floor is taken from sum and count."""
    placed = "placed{i} AS MATERIALIZED (SELECT rid, vec_id, v, cluster, distance FROM (SELECT rid, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS distance FROM q, centre{i}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)"
    mean = "mean{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM (SELECT cluster, p, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM placed{i}) GROUP BY cluster, p) GROUP BY cluster), centre{j} AS MATERIALIZED (SELECT o.cluster, coalesce(CAST(m.c AS BIGINT[]), o.c) AS c FROM centre{i} o LEFT JOIN mean{i} m USING (cluster))"
    steps = ",\n".join(f"{placed.format(i=i)},\n{mean.format(i=i, j=i + 1)}" for i in range(rounds))
    return f"""
WITH q AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
centre0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT v, sha256('2:' || vec_id) AS h FROM q ORDER BY h NULLS LAST, v LIMIT {k})),
{steps},
{placed.format(i=rounds)}
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM placed{rounds} JOIN centre{rounds} USING (cluster)
"""


ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": r"""
WITH d AS (
  SELECT doc_id, string_split_regex(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-/:-@\[-`{-\x7f]+', ' ', 'g')), ' ') AS w
  FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT item_id, string_split_regex(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-/:-@\[-`{-\x7f]+', ' ', 'g')), ' ') AS w
  FROM benchmark WHERE text IS NOT NULL),
i AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[p : p + least(5, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS r(p) WHERE w[1] <> ''),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
s AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM d, (SELECT DISTINCT k FROM i) AS widths, unnest(range(1, len(w) - k + 2)) AS r(p)),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM s JOIN i USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
FROM m JOIN n USING (item_id) WHERE shared * 5 >= item_shingles * 4
""".replace("\\\\", "\\"),
    "op3_line_dedup": """
WITH l AS (
  SELECT doc_id, source, text, pos, part, trim(part, ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '-')) >= 10)
SELECT doc_id, count(*) AS n_lines, count(b.line) AS n_removed,
       coalesce(string_agg(part, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL), '') AS text
FROM l LEFT JOIN b USING (line) GROUP BY doc_id
""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS r(p)),
f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
c AS (
  SELECT DISTINCT doc_id, p + k AS p FROM g JOIN f USING (s), unnest(range(0, 13)) AS r(k) WHERE least < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (
  SELECT doc_id, count(c.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE c.p IS NULL), '') AS kept
  FROM x LEFT JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
    "op6_exact_dedup": """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, text_sha256
FROM t WINDOW same AS (PARTITION BY text_sha256)
""",
    "op11_spelling_variants": """
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc FROM range(256) AS t(i)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, CAST(unicode(ch) - 64 AS BIGINT)] END)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295)) AS h
  FROM runs, bits),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM words, unnest(range(0, length(word))) AS t(i)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)),
best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM near JOIN words ON other = words.word GROUP BY near.word),
found AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM found
  UNION ALL SELECT chain.word, found.form FROM chain JOIN found ON chain.root = found.word WHERE found.form IS NOT NULL)
SELECT found.word, form, chain.root, n, n_near, form_n
FROM found JOIN chain USING (word) WHERE chain.root IN (SELECT word FROM found WHERE form IS NULL)
""",
    "op12_clustering": kmeans_sql(),
}
