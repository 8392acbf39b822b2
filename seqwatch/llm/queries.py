"""The queries of this package, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwatch.llm import bpe, chat, classifier, decontaminate, filter_audit, html_text, jaccard, langid, phrases, quality_rules, sharding, suffix_dedup, token_files
from seqwatch.llm.shared import id_bucket, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame(chat.TURN_TOOLS, "name string, argument string, type string, required boolean")
    return chat.format_chat(chat.turn_events(table(spark, sf_dir, "conversations")), schemas)


def op2_contiguous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.contiguous_shards(table(spark, sf_dir, "documents"), shards=40)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_simhash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit(classifier.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = classifier.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    read = token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_mask_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_suffix_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_tool_linking, op2_contiguous_shards, op3_byte_bpe, op4_simhash_leaks, op5_count_rtree, op6_divergence_rules, op7_language_id, op8_nb_svm, op9_token_files, op10_tag_paths, op11_mask_matrices, op12_suffix_groups, op13_suffix_sigma)}


def oracle_sql() -> dict[str, str]:
    return {"op1_tool_linking": OP1_SQL, "op2_contiguous_shards": OP2_SQL, "op6_divergence_rules": op6_sql(), "op11_mask_matrices": OP11_SQL, "op13_suffix_sigma": OP13_SQL}


OP1_SQL = """
WITH RECURSIVE asked AS (
  SELECT *, coalesce(length(text), 0) AS n, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS of_turn
  FROM conversations
), kinds AS (
  SELECT *, CASE WHEN role = 'user' THEN 'call' WHEN role = 'assistant' AND of_turn IS NOT NULL THEN 'result' ELSE 'message' END AS kind,
    CASE turn % 3 WHEN 1 THEN 'lookup' WHEN 2 THEN 'measure' ELSE 'reply' END AS tool, to_json(text)::VARCHAR AS quoted
  FROM asked
), ids AS (
  SELECT *, CASE kind WHEN 'call' THEN 'turn-' || turn WHEN 'result' THEN 'turn-' || of_turn END AS call_id FROM kinds
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, kind, call_id ORDER BY turn) AS nth,
    min(CASE WHEN kind = 'result' THEN turn END) OVER (PARTITION BY conv_id, call_id) AS answer
  FROM ids
), calls AS (
  SELECT conv_id, turn, call_id, answer, CASE WHEN n % 4 <> 3 THEN 'turn-' || of_turn END AS needs FROM ranked WHERE kind = 'call' AND nth = 1 AND n % 13 <> 7
), levels AS (
  SELECT conv_id, call_id, 0 AS level, turn AS place, greatest(turn, answer) AS ready FROM calls WHERE needs IS NULL
  UNION ALL
  SELECT c.conv_id, c.call_id, l.level + 1, greatest(c.turn, l.ready), greatest(c.turn, l.ready, c.answer) FROM calls c JOIN levels l ON l.conv_id = c.conv_id AND l.call_id = c.needs
)
SELECT r.conv_id, r.turn, 0 AS seq, kind, r.call_id,
  CASE WHEN kind = 'message' THEN 'message' WHEN nth > 1 THEN 'duplicate' WHEN kind = 'result' THEN 'result' WHEN answer IS NULL THEN 'unanswered' ELSE 'call' END AS link,
  CASE WHEN kind = 'result' THEN of_turn WHEN kind = 'call' AND nth = 1 THEN answer END AS linked_turn,
  CASE WHEN kind = 'message' OR nth > 1 THEN r.turn WHEN kind = 'call' THEN coalesce(place, r.turn) ELSE greatest(r.turn, coalesce(place, of_turn)) END AS place,
  CASE WHEN kind = 'message' OR nth > 1 THEN 0 WHEN kind = 'call' THEN 2 * level ELSE 2 * level + 1 END AS level,
  CASE WHEN kind <> 'call' THEN ''
    WHEN tool = 'reply' THEN CASE WHEN text IS NULL THEN 'type:prompt' ELSE '' END
    WHEN tool = 'lookup' THEN concat_ws(';', CASE n % 5 WHEN 0 THEN 'missing:limit' WHEN 1 THEN 'type:limit' END, CASE WHEN text IS NULL THEN 'type:query' END)
    ELSE CASE n % 5 WHEN 3 THEN 'unknown:extra' WHEN 4 THEN 'type:exact' ELSE '' END END AS errors,
  CASE kind
    WHEN 'call' THEN '{"arguments":' || CASE tool
        WHEN 'reply' THEN '{"prompt":' || quoted || '}'
        WHEN 'lookup' THEN '{' || CASE n % 5 WHEN 0 THEN '' WHEN 1 THEN '"limit":"' || r.turn || '",' ELSE '"limit":' || r.turn || ',' END || '"query":' || quoted || '}'
        ELSE '{"chars":' || n || CASE n % 5 WHEN 2 THEN '.5,"exact":true}' WHEN 3 THEN ',"extra":[1]}' WHEN 4 THEN ',"exact":"yes"}' ELSE '}' END END
      || ',"id":"' || r.call_id || '","name":"' || tool || '","role":"user"}'
    WHEN 'result' THEN '{"content":' || quoted || ',"role":"assistant","tool_call_id":"' || r.call_id || '"}'
    ELSE '{"content":' || quoted || ',"role":' || to_json(role)::VARCHAR || '}'
  END AS json
FROM ranked r LEFT JOIN levels l ON l.conv_id = r.conv_id AND l.call_id = r.call_id
"""

OP2_SQL = """
WITH crcs AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc_of
), rows_in AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(crc_of[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
  FROM documents, crcs
), places AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER () AS total,
    row_number() OVER (ORDER BY doc_id, text_crc32, size) AS place
  FROM rows_in
), shards AS (
  SELECT *, least(39, ((2 * upto - size) * 40) // (2 * total))::INTEGER AS shard FROM places
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard
FROM shards
"""

OP11_SQL = """
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f) JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), steps AS (
  SELECT filter_order, unnest(range(1, 6))::INTEGER AS step, bits FROM orders
), rules AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[:step - 1]), 0)::INTEGER AS earlier FROM steps
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask
  FROM texts t LEFT JOIN known k ON k.doc_id = t.doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL
), counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (earlier | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & earlier > 0 AND mask & own > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells CROSS JOIN rules GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM counted
"""

OP13_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), lengths AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), counts AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m AS words, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words) JOIN (SELECT unnest([1, 2, 3, 4]) AS m) ON i + m - 1 <= len(w)
  GROUP BY ALL HAVING count(*) >= 30
), candidates AS (
  SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM candidates JOIN (SELECT unnest([1, 2, 3]) AS k) ON k < words
), scored AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = x JOIN counts r ON r.lang = c.lang AND r.phrase = y
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), around AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates JOIN (SELECT unnest([2, 3]) AS m) ON m < words JOIN (SELECT unnest([1, 2, 3]) AS s) ON s + m - 1 <= words GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN lengths USING (lang) WHERE rank <= 2000
"""


def op6_sql() -> str:
    """The quality rules over the same word lists; lists become tables of rows."""
    from seqwatch.llm.quality_rules import COMMON_WORDS, EXPECTED_HITS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS, WORDLESS_PART

    listed = ", ".join(f"('{lang}', '{w}')" for lang, ws in COMMON_WORDS.items() for w in ws)
    only = {
        "words": r"[\x20\x09-\x0D]+",
        "symbols": r"[^#*$%&|<>]+",
        "upper": r"[^\p{Lu}]+",
        "digit": r"[^\p{Nd}]+",
        "stop": r"""[^.,;:!?''"()\-]+""",
        "symbol": r"""[\p{L}\p{M}\p{Nd}\s.,;:!?''"()\-]+""",
    }
    n = {k: f"length(regexp_replace(body, '{v}', '', 'g'))" for k, v in only.items()}
    space, word = only["words"], r"[^\x20\x09-\x0D]"
    term = lambda x, y: f"(CASE WHEN {x} > 0 THEN {x} * ln(2 * {x} / ({x} + {y})) ELSE 0 END + CASE WHEN {y} > 0 THEN {y} * ln(2 * {y} / ({x} + {y})) ELSE 0 END)"
    return f"""
WITH common(lang, w) AS (VALUES {listed}),
docs AS (SELECT doc_id, lang, coalesce(text, '') AS body, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}'), lambda w: w <> '') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '{word}')) AS lines FROM documents),
counts AS (SELECT doc_id, lang, len(words) AS n_words, {n['words']} AS word_chars, {n['symbols']} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  length(body) AS chars, {n['upper']} AS upper, {n['digit']} AS digit, {n['stop']} AS stop, {n['symbol']} AS symbol FROM docs),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM docs, unnest(range(1, len(words) - 3)) AS u(i)),
repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, sum(gap) AS n_repeat_words FROM (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS gap FROM repeated) GROUP BY doc_id),
base AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed FROM counts c LEFT JOIN covered USING (doc_id)),
classes AS (SELECT doc_id, lang, base_failed, unnest(['upper', 'digit', 'space', 'stop', 'symbol', 'letter']) AS class,
  unnest([upper, digit, chars - word_chars, stop, symbol, greatest(chars - upper - digit - (chars - word_chars) - stop - symbol, 0)]) AS n FROM base),
class_shares AS (SELECT doc_id, class, n / nullif(sum(n) OVER (PARTITION BY doc_id), 0) AS x, sum(n) OVER (PARTITION BY doc_id) AS total FROM classes),
class_refs AS (SELECT lang, class, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS y FROM classes WHERE NOT base_failed AND lang IN (SELECT lang FROM common) GROUP BY lang, class),
class_js AS (SELECT doc_id, total, min(d) AS class_distance FROM (SELECT doc_id, lang, total, sqrt(greatest(sum({term('x', 'y')}), 0) / (2 * ln(2))) AS d FROM class_shares JOIN class_refs USING (class) WHERE total > 0 GROUP BY ALL) GROUP BY ALL),
hits AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, lower(unnest(words)) AS w FROM docs) WHERE w IN (SELECT w FROM common) GROUP BY ALL),
lang_words AS (SELECT lang, sum(n_words) AS total FROM base WHERE NOT base_failed AND lang IN (SELECT lang FROM common) GROUP BY lang),
word_refs AS (SELECT c.lang, c.w, coalesce(sum(h.n) FILTER (b.doc_id IS NOT NULL), 0) / max(total) AS y FROM common c JOIN lang_words USING (lang) LEFT JOIN hits h ON h.w = c.w LEFT JOIN base b ON b.doc_id = h.doc_id AND b.lang = c.lang AND NOT b.base_failed GROUP BY ALL),
rests AS (SELECT lang, 1 - sum(y) AS y, sum(y) * ln(2) AS none FROM word_refs GROUP BY lang),
bounds AS (SELECT least({MAX_WORD_DISTANCE}, {WORDLESS_PART} * min(sqrt(greatest(none + ln(2 / (1 + y)) + CASE WHEN y > 0 THEN y * ln(2 * y / (1 + y)) ELSE 0 END, 0) / (2 * ln(2))))) AS bound,
  CASE WHEN min(1 - y) > 0 THEN {EXPECTED_HITS} / min(1 - y) END AS enough FROM rests),
own AS (SELECT b.doc_id, r.lang, r.w, h.n / b.n_words AS x, r.y FROM hits h JOIN base b USING (doc_id) JOIN word_refs r USING (w)),
sums AS (SELECT doc_id, lang, sum(x) AS x, sum({term('x', 'y')} - y * ln(2)) AS more FROM own GROUP BY ALL),
word_js AS (SELECT b.doc_id, min(sqrt(greatest(none + coalesce(more, 0) + {term('(1 - coalesce(x, 0))', 'r.y')}, 0) / (2 * ln(2)))) AS word_distance FROM (SELECT doc_id FROM base WHERE n_words > 0) b CROSS JOIN rests r LEFT JOIN sums s ON s.doc_id = b.doc_id AND s.lang = r.lang GROUP BY b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(class_distance, 0) > {MAX_CLASS_DISTANCE} AND chars >= {MIN_CHARS}) AND NOT (coalesce(word_distance, 0) > bound AND enough IS NOT NULL AND (lang IS NULL OR lang IN (SELECT lang FROM rests)) AND n_words >= greatest({MIN_WORDS}, enough)) AS kept,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM base CROSS JOIN bounds LEFT JOIN class_js USING (doc_id) LEFT JOIN word_js USING (doc_id)
"""
