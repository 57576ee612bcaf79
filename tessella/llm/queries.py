"""The registered queries of the corpus operators: each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import langid, mixing, quality, toxicity
from tessella.llm.alignment import align_tokenizers, read_tokenizers
from tessella.llm.common import crc_fold, materialize, word_count
from tessella.llm.decontamination import contained_items
from tessella.llm.licenses import scan_licenses
from tessella.llm.lm_scoring import score_cross_entropy
from tessella.llm.mixing import mix, symbol_quality
from tessella.llm.neardup import near_duplicates
from tessella.llm.quality import score_quality
from tessella.llm.quotes import link_quotes
from tessella.llm.repeats import remove_repeats
from tessella.llm.tokens import count_tokens, read_ranks
from tessella.llm.whitening import fit_whitening, whiten
from tessella.sources.captures import spread


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), symbol_quality(F.col("text")).alias("quality")))
    out = mix(sized.withColumn("text", F.lit(None).cast("string")), size=F.col("size"), quality=F.col("quality"))
    return out.select("doc_id", *(F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "taken")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_read(spark, sf_dir, "documents"), ngram=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(_read(spark, sf_dir, "conversations"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def _held_out(folds: int, fold: int):
    return F.coalesce(crc_fold("doc_id", folds) == fold, F.lit(False)).alias("held_out")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, crc_fold("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return score_cross_entropy(docs, labels.where("quality = 1"), keep=["doc_id"])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pieces = _read(spark, sf_dir, "documents"), langid.vocabulary()
    model = langid.learn(docs, crc_fold("doc_id", 4) != 2, pieces)
    return langid.predict_language(docs, model, pieces, keep=["doc_id"]).select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"), read_ranks())


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_tokenizers(_read(spark, sf_dir, "documents"), read_tokenizers())
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return whiten(vectors, fit_whitening(vectors, components=16)).withColumn("deviation", F.col("deviation").cast("long"))


def op13_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_read(spark, sf_dir, "documents"), least=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_mix_sources, op2_quality_rules, op3_minhash_near_dedup, op4_quotation_linking, op5_benchmark_decontamination, op6_toxicity,
        op7_cross_entropy_difference, op8_language_id, op9_license_scan, op10_token_attribution, op11_tokenizer_alignment, op12_embedding_whitening, op13_repeated_strings,
    )
    return {f.__name__: f for f in every}


_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

_QUALITY = rf"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS.format('text')} AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
twice AS (SELECT doc_id, i FROM win JOIN (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1) USING (doc_id, g)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '[!?]')) AS n_marks FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
k AS (SELECT * REPLACE (coalesce(word_chars, 0) AS word_chars) FROM c),
r AS (SELECT doc_id, lang, source, u.rate AS rate, u.low AS floor, least(1000, coalesce(floor(1000 * u.n / nullif(u.d, 0)), 0))::INT AS step FROM (SELECT doc_id, lang, source, unnest([
{', '.join(f"{{'rate': '{rate}', 'n': {n}, 'd': {d}, 'low': {quality.FLOOR[rate]}}}" for rate, (n, d) in {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"), "marks": ("n_marks", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "30 * n_words")}.items())}]) AS u FROM k)),
own AS (SELECT lang, source, rate, floor, count(*) AS n, quantile_disc(step, 0.25) AS low, quantile_disc(step, 0.75) AS high FROM r GROUP BY ALL),
wide AS (SELECT lang, rate, quantile_disc(step, 0.25) AS low, quantile_disc(step, 0.75) AS high FROM r GROUP BY ALL),
edge AS (SELECT own.lang, source, rate, (n * own.low + {quality.PRIOR} * wide.low) / (n + {quality.PRIOR}) AS low, (n * own.high + {quality.PRIOR} * wide.high) / (n + {quality.PRIOR}) AS high, floor FROM own JOIN wide USING (rate) WHERE own.lang IS NOT DISTINCT FROM wide.lang),
bad AS (SELECT DISTINCT doc_id FROM r JOIN edge USING (rate) WHERE r.lang IS NOT DISTINCT FROM edge.lang AND r.source IS NOT DISTINCT FROM edge.source
AND (step > high + {quality.FENCE} * greatest(high - low, edge.floor) OR rate = 'word_length' AND step < low - {quality.FENCE} * greatest(high - low, edge.floor)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM k"""

_NEAR = rf"""WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(_AZ.format('text'))} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id"""

_TERMS = r"regexp_extract_all(" + _AZ.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_LEAKS = rf"""WITH i AS (SELECT item_id, {_TERMS} AS w FROM benchmark), d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
size AS (SELECT DISTINCT least(5, len(w)) AS k FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, k, g FROM (SELECT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda j: array_to_string(w[j:j + least(5, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0)),
dg AS (SELECT DISTINCT doc_id, k, g FROM (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g FROM d, size WHERE len(w) >= k)),
n AS (SELECT item_id, count(*) AS n_item FROM ig GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_held, n_item FROM dg JOIN ig USING (k, g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item"""


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL for the same rows. The quadratic ones are for the smaller tables; op3's counts all pairs that share a shingle."""
    return {"op1_mix_sources": mixing.ORACLE, "op2_quality_rules": _QUALITY, "op3_minhash_near_dedup": _NEAR, "op5_benchmark_decontamination": _LEAKS}
