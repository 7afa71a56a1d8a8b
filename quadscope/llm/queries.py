"""The training-data queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, licenses, quality, sentencepiece_bpe, token_counts, toxicity, urls, winnow
from ._common import fold, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _verdicts(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return _verdicts(quality.score(docs, model), fold("doc_id", 5) == 0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return _verdicts(toxicity.score(docs, lexicon), fold("doc_id", 4) == 2)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_next(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.learn(pages))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_chat_rotation": op1_chat_rotation,
        "op2_quality": op2_quality,
        "op3_token_counts": op3_token_counts,
        "op4_toxicity": op4_toxicity,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_fingerprints": op6_fingerprints,
        "op7_license_scan": op7_license_scan,
        "op8_decontamination": op8_decontamination,
        "op9_url_filter": op9_url_filter,
        "op10_jaccard_join": op10_jaccard_join,
    }


#: Windows of eight words by SQL.
OP8 = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), tests AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), grams AS (
  SELECT DISTINCT item, least(8, len(w)) AS n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 6))) AS i FROM tests WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM grams
), spots AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM lowered, sizes WHERE len(w) >= n)
), hits AS (
  SELECT r, i, s.n, item FROM spots s JOIN grams g ON g.n = s.n AND g.gram = s.gram
), words AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM lowered LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


#: Sets of 5-word shingles, their links, and the least doc_id that links reach.
OP10 = r"""
WITH RECURSIVE lowered AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM lowered WHERE len(w) > 0)
), sizes AS (
  SELECT r, count(*) AS n FROM grams GROUP BY r
), common AS (
  SELECT a.r AS x, b.r AS y, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.r < b.r GROUP BY a.r, b.r
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT r, r AS other FROM lowered
  UNION
  SELECT reach.r, l.y FROM reach JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) l ON l.x = reach.other
)
SELECT a.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id
FROM reach JOIN lowered a ON a.r = reach.r JOIN lowered b ON b.r = reach.other LEFT JOIN sizes ON sizes.r = a.r
GROUP BY a.r, a.doc_id
"""


#: The dialogue as each speaker's, with running character offsets inside every part.
OP1 = rf"""
WITH turns AS (
  SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), counted AS (
  SELECT *, row_number() OVER w - 1 AS n, sum(length(text)) OVER w - length(text) AS c
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text, id ROWS UNBOUNDED PRECEDING)
), parts AS (
  SELECT *, CAST(n // {chat.MAX_TURNS} + c // {chat.MAX_CHARS} AS BIGINT) AS part FROM counted
), speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'
), pieces AS (
  SELECT s.conv_id, perspective, part, n, role, text, '<|' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || '|>' || chr(10) AS head
  FROM speakers s JOIN parts t ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, head || text || chr(10) || '<|end|>' || chr(10) AS piece,
    sum(length(head) + length(text) + 9) OVER (PARTITION BY conv_id, perspective, part ORDER BY n ROWS UNBOUNDED PRECEDING) AS stop
  FROM pieces
)
SELECT conv_id, perspective, part, CAST(count(*) AS BIGINT) AS n_turns,
  string_agg(piece, '' ORDER BY n) AS text,
  coalesce(string_agg(CAST(stop - length(text) - 9 AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY n) FILTER (WHERE role = perspective), '') AS mask_spans,
  CAST(coalesce(sum(length(text) + 9) FILTER (WHERE role = perspective), 0) AS BIGINT) AS n_masked
FROM placed GROUP BY conv_id, perspective, part
"""


def op7_sql() -> str:
    """Shares of every template in every window, without MinHash."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(licenses.TEMPLATES.items()))
    return rf"""
WITH templates(license, text) AS (VALUES {rows}),
lowered AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), wanted AS (
  SELECT license, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM templates
), parts AS (
  SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT license, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM wanted)
), sizes AS (
  SELECT license, m, span, greatest(1, span // 4) AS stride FROM (SELECT license, count(*) AS m FROM parts GROUP BY license) JOIN (SELECT license, greatest(1, len(w) - 4) AS span FROM wanted) USING (license)
), grams AS (
  SELECT r, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM lowered WHERE len(w) > 0)
), hits AS (
  SELECT g.r, p.license, g.gram, g.pos, z.m, z.span, z.stride FROM grams g JOIN parts p ON p.gram = g.gram JOIN sizes z ON z.license = p.license
), spread AS (
  SELECT r, license, gram, m, span, stride * unnest(range(CAST(greatest(0, floor((pos - span - stride + 2) / stride)) AS BIGINT), CAST(floor(pos / stride) + 1 AS BIGINT))) AS start, pos, stride FROM hits
), shares AS (
  SELECT r, license, start, count(DISTINCT gram) / any_value(m) AS share FROM spread WHERE start <= pos AND pos <= start + span + stride - 2 GROUP BY r, license, start
)
SELECT doc_id, license, max(share) AS containment, CAST(count(*) AS BIGINT) AS n_windows, CAST(min(start) AS BIGINT) AS first_word
FROM shares JOIN lowered USING (r) WHERE share >= 0.8 GROUP BY r, doc_id, license
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_rotation": OP1, "op7_license_scan": op7_sql(), "op8_decontamination": OP8, "op10_jaccard_join": OP10}
