"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from obol.llm.common import documents

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def pii_key(spark: SparkSession) -> bytes:
    """Key of the pseudonyms: the setting spark.obol.pii.key, else a fixed one for trials (32 bytes of its SHA-256)."""
    return hashlib.sha256(spark.conf.get("spark.obol.pii.key", "obol trial key").encode()).digest()


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and context-mixing score of every document."""
    from obol.llm.lm_scoring import score
    return score(documents(spark, sf_dir))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document (five words, Jaccard >= 0.75)."""
    from obol.llm.near_dedup import near_duplicates
    return near_duplicates(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences, rules and licences of every document."""
    from obol.llm.license_scan import scan
    return scan(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of 2048 tokens."""
    from obol.llm.packing import pack
    return pack(documents(spark, sf_dir), tokenizer_path())


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with format-preserving pseudonyms, and how many values it had."""
    from pyspark.sql import functions as F

    from obol.llm.pii import pseudonymise
    out = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), pii_key(spark))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                      F.aggregate(F.map_values("pii"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_values"),
                      F.array_join(F.array_sort(F.map_keys("pii")), ",").alias("kinds"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document so that sources meet weights 5, 2, 1."""
    from obol.llm.source_mixing import mix
    return mix(documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses."""
    from obol.llm.fingerprints import fingerprints
    return fingerprints(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every whole text, through a digest cache that starts empty."""
    from obol.llm.token_counts import count_tokens
    return count_tokens(documents(spark, sf_dir), tokenizer_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, log-likelihood ratio and verdict of every document."""
    from obol.llm.quality import measure
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return measure(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a 100-byte string seen earlier covers."""
    from obol.llm.substring_dedup import remove_repeats
    return remove_repeats(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired turns of every damaged conversation."""
    from obol.llm.conversation_repair import damaged_and_repaired
    return damaged_and_repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the documents that are not held out."""
    from obol.llm.language_id import identify
    return identify(documents(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document towards the benchmark texts, and the tenth drawn."""
    from obol.llm.importance_resampling import resample
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_near_duplicates, op3_license_scan, op4_packing, op5_pii_pseudonyms, op6_source_mixing,
    op7_fingerprints, op8_token_counts, op9_quality_rules, op10_substring_dedup, op11_conversation_repair, op12_language_id,
    op13_importance_resampling)}


def _license_sql() -> str:
    """The licence scan in DuckDB SQL: sentence ids are places in one list, rules are tested on the id string."""
    from obol.llm.license_scan import BREAK, RULES, SENTENCES
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    known = ", ".join(norm.format(quote(s)) for _, s in SENTENCES)
    rules = ", ".join(f"CASE WHEN contains(line, ',{','.join(map(str, seq))},') THEN {r} END" for r, _, seq in RULES)
    names = ", ".join(f"CASE WHEN contains(line, ',{','.join(map(str, seq))},') THEN {quote(lic)} END" for _, lic, seq in RULES)
    return f"""
WITH parts AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), E'{BREAK.replace(chr(92), chr(92) * 2)}'),
                 lambda x: {norm.format('x')}), lambda x: x <> '') AS sentences FROM documents),
known AS (SELECT [{known}] AS list),
marked AS (SELECT doc_id, list_transform(sentences, lambda s: coalesce(list_position(list, s), 0)) AS marks FROM parts, known),
lined AS (SELECT doc_id, list_filter(marks, lambda i: i > 0) AS ids, ',' || array_to_string(marks, ',') || ',' AS line FROM marked)
SELECT doc_id::BIGINT AS doc_id, len(ids)::BIGINT AS n_known, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_filter([{rules}], lambda r: r IS NOT NULL), ',') AS rules,
  array_to_string(list_sort(list_distinct(list_filter([{names}], lambda r: r IS NOT NULL))), ',') AS licenses
FROM lined"""


def _resampling_sql() -> str:
    """Importance resampling in DuckDB SQL over whole texts, without lines; CRC-32 by its table of 256 entries."""
    from obol.llm.importance_resampling import BUCKETS, LOWER, MIN_WORDS, PERCENT, SEED, UPPER
    word = r"[0-9a-z\x{80}-\x{10FFFF}]+"
    return f"""
WITH entry AS (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS i)),
crc AS (SELECT list(c ORDER BY i) AS tab FROM entry),
docs AS (SELECT doc_id::BIGINT AS doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{word}') AS ws FROM documents),
bench AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{word}') AS ws FROM benchmark),
uses AS (SELECT doc_id, unnest(ws) AS w FROM docs),
per_doc AS (SELECT doc_id, w, count(*) AS n FROM uses GROUP BY ALL),
raw AS (SELECT w, sum(n) AS s FROM per_doc GROUP BY w),
aim AS (SELECT w, count(*) AS t FROM (SELECT unnest(ws) AS w FROM bench) GROUP BY w),
vocabulary AS (SELECT w, encode(w) AS b FROM (SELECT w FROM raw UNION SELECT w FROM aim)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM vocabulary, crc),
counts AS (SELECT bucket, sum(coalesce(s, 0)) AS s, sum(coalesce(t, 0)) AS t FROM hashed LEFT JOIN raw USING (w) LEFT JOIN aim USING (w) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM counts),
gain AS (SELECT w, floor(1000 * ln((t + 1)::DOUBLE * (ss + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (tt + {BUCKETS})::DOUBLE)))::BIGINT AS g
    FROM hashed JOIN counts USING (bucket), sums),
weight AS (SELECT doc_id, sum(n * g)::BIGINT AS weight FROM per_doc JOIN gain USING (w) GROUP BY doc_id),
scored AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(ws)::BIGINT AS n_words,
    ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM docs LEFT JOIN weight USING (doc_id)),
final AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM final WHERE n_words >= {MIN_WORDS})
SELECT f.doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * able // 100 THEN rank END::BIGINT AS rank, n_words
FROM final f LEFT JOIN ranked r ON f.doc_id = r.doc_id"""


ORACLE: dict[str, str] = {"op3_license_scan": _license_sql(), "op13_importance_resampling": _resampling_sql()}
