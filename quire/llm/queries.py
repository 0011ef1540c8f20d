"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.collocations import PhraseParams, collocations
from quire.llm.common import read_table
from quire.llm.decontamination import OverlapParams, overlap_report
from quire.llm.exact_dedup import exact_duplicates
from quire.llm.importance import DrawParams, importance_sample
from quire.llm.language_id import language_report
from quire.llm.lm_scoring import score_documents
from quire.llm.near_dedup import NearParams, near_duplicates
from quire.llm.packing import pack_documents
from quire.llm.secrets import ASSIGN_LEAST, KINDS, PATTERNS, labelled_samples, secret_report, train
from quire.llm.sentencepiece_codec import codec_report
from quire.llm.token_files import token_file_report
from quire.llm.topk_search import top_k_of_sample
from quire.llm.toxicity import toxicity_report

#: A-Z and nothing else is lower-cased.
_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The word tokenizer of operators 3 and 10, and its end id.
WORD_TOKENIZER, END_ID = "word_bpe_49k.json", 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The model of operator 1.
PIECE_MODEL = "piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_report(read_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL), threads=2)


def secret_model(spark: SparkSession):
    return train(labelled_samples(spark, seed=11), labelled_samples(spark, seed=23))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read_table(spark, sf_dir, "documents"), secret_model(spark))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 2's result that SQL can express: the base spans."""
    return op2_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _placed_sql(kind: str, pattern: str) -> str:
    """SQL for (doc_id, kind, start, end, hit) of a pattern's matches: pieces between them and matches in turn."""
    return f"""
  SELECT doc_id, row_id, '{kind}' AS kind, {list(KINDS).index(kind)} AS rank, hits[i] AS hit,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, row_id, regexp_extract_all(text, {pattern}) AS hits, string_split_regex(text, {pattern}) AS gaps FROM texts) AS m,
       unnest(range(1, len(hits) + 1)) AS n(i)"""


SECRET_BASE_SQL = rf"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents),
placed AS ({" UNION ALL ".join(_placed_sql(k, "'" + PATTERNS[k].replace("'", "''") + "'") for k in KINDS)}
), spans AS (
  SELECT row_id, kind, rank, CAST(start AS BIGINT) AS start, CAST(start + length(hit) AS BIGINT) AS stop FROM placed
  WHERE kind <> 'assign' OR length(regexp_extract(hit, '{PATTERNS["assign"].replace("'", "''")}', 2)) >= {ASSIGN_LEAST}
), listed AS (
  SELECT row_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS joined
  FROM spans GROUP BY row_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(joined, '')) AS base_sha256
FROM texts LEFT JOIN listed USING (row_id)
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, tokenizer_path(WORD_TOKENIZER), window=2048, end_id=END_ID)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(read_table(spark, sf_dir, "documents"), folds=4, held=2)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), folds=7, held=2)


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 6's result that SQL can express: counts and the base score, rounded as sums differ in order."""
    scored = op6_lm_scoring(spark, sf_dir)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


#: crc32 isn't a function of this SQL, so the training documents are found by the bits of its polynomial.
LM_BASE_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS UBIGINT) AS c FROM documents
  UNION ALL
  SELECT doc_id, s, i + 1, list_reduce([xor(c, CAST(ord(substr(s, i + 1, 1)) AS UBIGINT)), 1, 2, 3, 4, 5, 6, 7, 8],
      lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END))
  FROM crc WHERE i < length(s)
), fold AS (
  SELECT doc_id, xor(c, CAST(4294967295 AS UBIGINT)) % 7 = 2 AS held_out FROM crc WHERE i = length(s)
), tokens AS (
  SELECT doc_id, unnest(list_append(regexp_extract_all(lowered, '[^\x20\x09-\x0D]+'), chr(10))) AS token
  FROM (SELECT doc_id, {_LOWER_SQL} AS lowered FROM documents) AS t
), counted AS (
  SELECT token, count(*) AS c FROM tokens JOIN fold USING (doc_id) WHERE NOT held_out GROUP BY token
), totals AS (
  SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM counted
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens,
       round(sum(log10((coalesce(c, 0) + 1) / (n + 1 * (v + 1)))), 4) AS base_score
FROM tokens JOIN fold USING (doc_id) LEFT JOIN counted USING (token), totals GROUP BY doc_id, held_out
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), NearParams(words=3, percent=85))


OP8_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER_SQL}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS n(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION
  SELECT r.doc_id, l.seen FROM reach r JOIN (SELECT a, b AS seen FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.seen
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(seen) AS component_id, doc_id = min(seen) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_of_sample(read_table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


OP9_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS terms
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row_id AS query, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.terms, c.terms) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.row_id <> c.row_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_file_report(docs, tokenizer_path(WORD_TOKENIZER), end_id=END_ID)


OP5_SQL = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM normal
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM best
"""


#: Words of operators 11 and 13.
_ALNUM_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), OverlapParams(words=10))


OP11_SQL = rf"""
WITH items AS (
  SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, regexp_extract_all({_LOWER_SQL}, '{_ALNUM_SQL}') AS w FROM benchmark) AS t WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM items, unnest(range(1, len(w) - k + 2)) AS n(i)
), docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({_LOWER_SQL}, '{_ALNUM_SQL}') AS w FROM documents
), spots AS (
  SELECT row_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT * FROM docs, (SELECT DISTINCT k FROM windows) AS lengths) AS d, unnest(range(1, len(w) - k + 2)) AS n(i)
), found AS (
  SELECT row_id, i, k, item FROM spots JOIN windows USING (k, s)
), hit AS (
  SELECT row_id, count(DISTINCT place) AS n FROM (SELECT DISTINCT row_id, i, k FROM found) AS f, unnest(range(i, i + k)) AS p(place) GROUP BY row_id
), named AS (
  SELECT row_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT row_id, item FROM found WHERE item IS NOT NULL) AS f GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (row_id) LEFT JOIN named USING (row_id)
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"), PhraseParams(words=3, least=10, top=2000))


OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER_SQL}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), counted AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT * FROM words, range(1, 4) AS sizes(k)) AS t, unnest(range(1, len(w) - k + 2)) AS n(i) GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang
), often AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE f >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, cut, x.f AS l, y.f AS r,
         CAST(CAST(1000000 AS HUGEINT) * c.f * c.f // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM often WHERE k > 1) AS c
  JOIN counted AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:cut], ' ')
  JOIN counted AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts
), longer AS (
  SELECT lang, unnest([array_to_string(w[:k - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase, f FROM often WHERE k = 3
), dropped AS (
  SELECT DISTINCT o.lang, o.phrase FROM often AS o JOIN longer AS g USING (lang, phrase) WHERE 100 * g.f >= 50 * o.f
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest WHERE place = 1 AND (lang, phrase) NOT IN (SELECT (lang, phrase) FROM dropped)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return importance_sample(docs, target, DrawParams(buckets=10_000, runs=2, least_words=20, percent=25, seed=7))


#: crc32 isn't a function of this SQL either: it is taken of each distinct feature, a byte at a time.
OP13_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({_LOWER_SQL}, '{_ALNUM_SQL}') AS w FROM documents
), features AS (
  SELECT row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM docs
), wanted AS (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature
  FROM (SELECT regexp_extract_all({_LOWER_SQL}, '{_ALNUM_SQL}') AS w FROM benchmark) AS t
), crc_table AS (
  SELECT list(list_reduce([CAST(n AS UBIGINT), 1, 2, 3, 4, 5, 6, 7, 8],
      lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END)) ORDER BY n) AS step
  FROM range(256) AS t(n)
), plain AS (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT feature FROM features UNION SELECT feature FROM wanted) AS f
), hashed AS (
  SELECT feature, xor(list_reduce(
      list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, len(h), 2), lambda i: CAST(CAST('0x' || h[i:i + 1] AS INT) AS UBIGINT))),
      lambda c, b: xor(c >> 8, step[CAST(xor(c, b) & 255 AS INT) + 1])), CAST(4294967295 AS UBIGINT)) % 10000 AS bucket
  FROM plain, crc_table
), bucketed AS (
  SELECT row_id, bucket FROM features JOIN hashed USING (feature)
), s AS (SELECT bucket, count(*) AS s FROM bucketed GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (feature) GROUP BY bucket
), sizes AS (
  SELECT coalesce((SELECT sum(s) FROM s), 0) AS big_s, coalesce((SELECT sum(t) FROM t), 0) AS big_t
), gains AS (
  SELECT bucket, CAST(floor(1000.0::DOUBLE * ln(((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (big_t + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), sizes
), summed AS (
  SELECT row_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM bucketed JOIN gains USING (bucket) GROUP BY row_id
), scored AS (
  SELECT doc_id, len(w) >= 20 AS fit, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM docs LEFT JOIN summed USING (row_id)
), noisy AS (
  SELECT doc_id, fit, n_features, weight, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE fit) OVER () AS n_fit FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * n_fit // 100 THEN place END AS rank FROM placed
"""


def queries() -> dict:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_secret_scan": op2_secret_scan,
        "secret_base": secret_base,
        "op3_packing": op3_packing,
        "op4_language_id": op4_language_id,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_lm_scoring": op6_lm_scoring,
        "lm_base": lm_base,
        "op7_toxicity": op7_toxicity,
        "op8_near_dedup": op8_near_dedup,
        "op9_topk_search": op9_topk_search,
        "op10_token_files": op10_token_files,
        "op11_decontamination": op11_decontamination,
        "op12_collocations": op12_collocations,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "secret_base": SECRET_BASE_SQL,
        "op5_exact_dedup": OP5_SQL,
        "lm_base": LM_BASE_SQL,
        "op8_near_dedup": OP8_SQL,
        "op9_topk_search": OP9_SQL,
        "op11_decontamination": OP11_SQL,
        "op12_collocations": OP12_SQL,
        "op13_importance": OP13_SQL,
    }
