"""The registered queries of this subpackage and their SQL.

Each query is a thin layer: it applies an operator to a whole table and derives the contracted columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffloom.llm import bpe, classifier, collocations, licenses, packing, quality, secrets, sharding, simhash, sketches, spelling, toxicity, warc
from staffloom.llm.shared import table, written


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.measured(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", "_m", "_md5", "_base_failed")
    found = written(docs, "op1-measures")
    kept = quality.apply_cutoffs(found, quality.fit_cutoffs(found, table(spark, sf_dir, "labels")))
    return kept.select("doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words", F.col("_base_failed").alias("base_failed"), "kept")


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.place(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_equal")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return licenses.scan(docs).select("doc_id", "path", "license", F.round("license_score", 6).alias("license_score"), "n_license_lines", "n_license_blocks", "is_license_file", "effective_license", "inherited_from")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_tokens=False)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.span_text(F.col("_base")), 256).alias("base_sha256"), secrets.span_text(F.col("_spans")).alias("spans"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = sketches.with_next(docs, "doc_id", ["text"])
    rows = rows.withColumn("sketch", sketches.sketch(F.col("text"))).withColumn("next_sketch", sketches.sketch(F.col("next_text")))
    rows = rows.withColumn("edited", sketches.edited(F.col("text"), F.col("next_text"))).withColumn("edited_sketch", sketches.sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        sketches.text_of(F.col("sketch")).alias("fingerprint"),
        sketches.text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        sketches.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
        sketches.distinct_shingles(F.col("sketch")).alias("n_distinct_shingles"),
    )


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classifier.scored(docs, classifier.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(classifier.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted_words(table(spark, sf_dir, "documents"), thinned=199))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_shards, op3_license_scan, op4_byte_bpe, op5_warc_round_trip, op6_toxicity, op7_best_fit_packing, op8_simhash_components, op9_secret_scan, op10_fingerprints, op11_quality_classifier, op12_collocations, op13_spelling_variants)}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT rid, i, w, CASE WHEN lead(w, 4) OVER x IS NOT NULL THEN concat_ws(chr(32), w, lead(w, 1) OVER x, lead(w, 2) OVER x, lead(w, 3) OVER x, lead(w, 4) OVER x) END AS gram FROM w WINDOW x AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, w, gram IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram) > 1 AS twice FROM g),
c AS (SELECT rid, w, bool_or(twice) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM r),
words AS (SELECT rid, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars, count(*) FILTER (covered) AS n_repeat FROM c GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.rid, doc_id, lang, t, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
 length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN words USING (rid) LEFT JOIN lines USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
s AS (SELECT rid, doc_id, lang, t, base_failed, unnest(['symbols', 'duplicate_lines', 'repeated_words', 'upper_case', 'long_words']) AS rule,
 unnest([CAST(ceil(n_symbols / greatest(word_chars, 1) * 100) AS INT), CAST(ceil(n_dup_lines / greatest(n_lines, 1) * 100) AS INT), CAST(ceil(n_repeat_words / greatest(n_words, 1) * 100) AS INT), CAST(ceil(n_upper / greatest(word_chars, 1) * 100) AS INT), CAST(ceil(least(word_chars / greatest(n_words, 1) / 40, 1.0) * 100) AS INT)]) AS step FROM b),
y AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT lang, md5(t) AS h, rule, max(step) AS step, min(q) AS q FROM s JOIN y USING (doc_id) WHERE NOT base_failed AND q IN (0, 1) GROUP BY ALL),
strata AS (SELECT greatest(1, count(*)) AS n FROM (SELECT DISTINCT lang FROM k)),
path AS (SELECT unnest(range(13)) AS place, unnest([30, 20, 10, 5, 0, 5, 10, 20, 30, 40, 50, 75, 100]) AS v),
design AS (SELECT lang, rule, step, q FROM k WHERE h < '8'),
tot AS (SELECT lang, rule, count(*) FILTER (q = 1) AS good, count(*) FILTER (q = 0) AS bad, max(step) FILTER (q = 1) AS most FROM design GROUP BY ALL),
grid AS (SELECT lang, rule, c AS cut, good, bad, most, (SELECT count(*) FROM design e WHERE e.lang IS NOT DISTINCT FROM tot.lang AND e.rule = tot.rule AND q = 1 AND step > c) AS lost, (SELECT count(*) FROM design e WHERE e.lang IS NOT DISTINCT FROM tot.lang AND e.rule = tot.rule AND q = 0 AND step > c) AS caught FROM tot, (SELECT unnest(range(101)) AS c)),
cuts AS (SELECT lang, rule, place, min(cut) AS cut FROM grid, path WHERE good > 0 AND CASE WHEN place < 5 THEN cut = least(100, most + v) ELSE 1000 * lost <= v * good END GROUP BY ALL),
sets AS (SELECT c.lang, c.rule, c.place, CASE WHEN caught / greatest(bad, 1) - lost / good > 0.01 THEN c.cut ELSE 100 END AS cut FROM cuts c JOIN grid ON grid.lang IS NOT DISTINCT FROM c.lang AND grid.rule = c.rule AND grid.cut = c.cut),
held AS (SELECT k.lang, place, h, min(q) AS q, bool_or(step > cut) AS goes FROM k JOIN sets ON sets.lang IS NOT DISTINCT FROM k.lang AND sets.rule = k.rule WHERE h >= '8' GROUP BY k.lang, place, h),
tested AS (SELECT lang, place, count(*) FILTER (goes AND q = 1) AS lost, count(*) FILTER (goes AND q = 0) AS caught, count(*) FILTER (q = 1) AS good, count(*) FILTER (q = 0) AS bad FROM held GROUP BY ALL),
p AS (SELECT *, CASE WHEN good = 0 OR lost >= good THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln(0.05) + (good - i) * ln(1 - 0.05))))) END AS pv FROM tested),
ok AS (SELECT *, caught / greatest(bad, 1) - lost / greatest(good, 1) AS gain, bool_and(pv <= 0.05 / (SELECT n FROM strata)) OVER (PARTITION BY lang ORDER BY place) AS safe FROM p),
best AS (SELECT *, max(gain) OVER (PARTITION BY lang) AS top FROM ok WHERE safe),
taken AS (SELECT lang, min(place) AS place FROM best WHERE top > 0.01 AND gain >= top - 0.01 GROUP BY lang),
chosen AS (SELECT sets.lang, sets.rule, sets.cut FROM sets JOIN taken ON taken.lang IS NOT DISTINCT FROM sets.lang AND taken.place = sets.place),
verdict AS (SELECT rid, bool_or(coalesce(step > cut, false)) AS rejected FROM s LEFT JOIN chosen c ON c.lang IS NOT DISTINCT FROM s.lang AND c.rule = s.rule GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM b JOIN verdict USING (rid)"""

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
first AS (SELECT digest, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM q LEFT JOIN first USING (digest)"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 30),
inner_ AS (SELECT lang, array_to_string(ws[i : i + j - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c)) GROUP BY ALL),
cuts AS (SELECT lang, phrase, a, i, array_to_string(ws[1 : i], ' ') AS head, array_to_string(ws[i + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
s AS (SELECT c.lang, c.phrase, c.a, i, h.a AS l, t.a AS r, CAST((2000000::HUGEINT * c.a) // (h.a::HUGEINT + t.a) AS BIGINT) AS score FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
weakest AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
kept AS (SELECT w.* FROM weakest w LEFT JOIN inner_ x ON x.lang = w.lang AND x.phrase = w.phrase WHERE x.longer IS NULL OR 100::HUGEINT * x.longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; the others are fitted models, searches or encodings and are tested against brute force."""
    return {"op1_quality_rules": OP1_SQL, "op5_warc_round_trip": OP5_SQL, "op12_collocations": OP12_SQL}
