"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convan.llm import alignment, binpack, exact_dedup, licences, near_dedup, neighbours, packing, pieces, quality, resampling, toxicity, warc, wavelet
from convan.llm.common import crc_of_id, new_path, saved, table

PIECE_MODEL, WORD_TOKENIZER, BYTE_TOKENIZER = "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_of_id() % 4 == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and crc of the ids of its whole text, and whether decoding them gives the text back."""
    path = public_tokenizers.path(PIECE_MODEL)
    coded = table(spark, sf_dir, "documents").select("doc_id", "text", pieces.encode_and_decode(F.col("text"), path).alias("coded"))
    same = F.col("coded.text").eqNullSafe(F.replace("text", F.lit(pieces.BLANK), F.lit(" ")))
    return coded.select("doc_id", (F.octet_length("coded.ids") / 4).cast("long").alias("n_ids"), F.crc32("coded.ids").alias("ids_crc32"), same.alias("round_trip"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_of_id() % 5 == 0
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(docs, lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = binpack.shard(table(spark, sf_dir, "documents"), binpack.SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    out = warc.resolved(saved(warc.read_archives(spark, path).drop("payload", "url"), "records"))
    return out.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    wavelet.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_TOKENIZER))
    return wavelet.read(spark, path)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_MODEL))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_pieces, op3_licences, op4_toxicity, op5_shards, op6_warc, op7_near_dedup, op8_neighbours, op9_exact_dedup, op10_packing, op11_token_files, op12_alignment, op13_resample)}

_text = lambda x: "'" + x.replace("'", "''") + "'"
_map = lambda entries: "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in entries.items()) + "}"
_rules = ", ".join(f"{{'ids': {_text(f' {" ".join(rule)} ')}, 'name': {_text(name)}}}" for name, some in licences.RULES.items() for rule in some)
_cuts = "translate(replace(lower(coalesce(text, '')), chr(13) || chr(10), chr(10)), chr(13) || '|/', chr(10) || '--')"
for _found, _by in licences.CUTS:
    _cuts = f"regexp_replace({_cuts}, {_text(_found)}, {_text(_by)}, 'g')"
_digits = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {10 * k + 1}, 10) AS BIGINT) >> {5 * (7 - j)}) & 31 AS INT) + 1, 1)" for k in range(4) for j in range(8))

ORACLE_SQL = {
    # Cuts are doubled, as RE2 has no look-around: each of two sentences that meet has its own.
    "op3_licences": f"""
        WITH known AS (SELECT {_map(licences.SENTENCES | licences.TITLES)} AS m, {_map(licences.NAMES)} AS n, {_map(licences.SPDX)} AS tags, [{_rules}] AS rules),
        cut AS (SELECT doc_id, lower(coalesce(text, '')) AS low, CASE WHEN regexp_matches(lower(coalesce(text, '')), {_text('|'.join(licences.HINTS))}) THEN '||' || replace(replace(trim({_cuts}), '|', '||'), '/', '//') || '||' ELSE '' END AS t FROM documents),
        found AS (SELECT doc_id, low, list_transform(regexp_extract_all(t, {_text(rf"[|/](?:(?:[0-9]{{1,2}}|[a-z]) )?({licences.whole_sentences('//')})[|/]")}, 1), lambda s: replace(s, '//', ' ')) AS s FROM cut),
        tagged AS (SELECT doc_id, s, string_split_regex(array_to_string(CASE WHEN contains(low, 'spdx') THEN regexp_extract_all(low, {_text(licences.TAG)}, 1) ELSE [] END, ' '), '[() \\t]+') AS e FROM found),
        ids AS (SELECT doc_id, array_to_string(list_concat(list_transform(s, lambda x: coalesce(m[x], n[regexp_extract(x, {_text(f"^{licences.REFERENCE}$")}, 1)])), list_transform(list_filter(e, lambda x: map_contains(tags, x)), lambda x: 'spdx:' || tags[x])), ' ') AS sentence_ids FROM tagged, known),
        met AS (SELECT doc_id, sentence_ids, list_filter(rules, lambda r: contains(' ' || sentence_ids || ' ', r.ids)) AS r FROM ids, known),
        named AS (SELECT doc_id, sentence_ids, array_to_string(list_transform(list_filter(r, lambda x, i: i = 1 OR r[i - 1].name <> x.name), lambda x: x.name), ',') AS licences FROM met)
        SELECT *, CASE WHEN licences = '' THEN 0 ELSE len(string_split(licences, ',')) END AS n_licences FROM named""",
    "op6_warc": f"""
        WITH heads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages),
        best AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM heads)
        SELECT page_id, payload_bytes, concat({_digits}) AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM best""",
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY text)""",
    # CRC-32 byte by byte over a table of 256 numbers, on distinct words alone.
    "op13_resample": """
        WITH crcs AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t FROM range(256) r(b)),
        texts AS (SELECT true AS corpus, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark),
        split AS (SELECT corpus, doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts),
        long AS (SELECT corpus, k, unnest(words) AS w FROM split),
        bytes AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM long)),
        known AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) // 2 + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crcs),
        counts AS (SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM long JOIN known USING (w) GROUP BY bucket),
        gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS g FROM counts),
        sums AS (SELECT k, sum(g) AS g FROM long JOIN known USING (w) JOIN gains USING (bucket) WHERE corpus GROUP BY k),
        weighed AS (SELECT doc_id, k, len(words) AS n_features, CASE WHEN len(words) = 0 THEN 0 ELSE CAST(floor(g::DOUBLE / len(words)) AS BIGINT) END AS weight, (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296 AS u FROM split LEFT JOIN sums USING (k) WHERE corpus),
        scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM weighed),
        drawn AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20 QUALIFY rank <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100)
        SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (k)""",
}
