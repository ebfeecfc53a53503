"""The thin queries of this subpackage: each reads its whole table, applies one operator with production parameters, and names its columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.quality_rules import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents"), clean=False)


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.separator_scan import token_counts

    return token_counts(spark, _read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), 50256)


def op3_ranked_varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.ranked_varint import digest

    return digest(spark, _read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), 0)


def op4_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.toxicity import toxicity

    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_license_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.license_scan import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents"))


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.line_crf import quality

    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.piece_bpe import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op8_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.exact_dedup import deduplicate

    return deduplicate(_read(spark, sf_dir, "documents"))


def op9_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), words=4, distance=4)


def op10_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), 1, 2048)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.merkle import document_manifest

    return document_manifest(_read(spark, sf_dir, "documents"))


def op12_repeat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.repeats import without_repeats

    return without_repeats(_read(spark, sf_dir, "documents")).drop("kept")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.alignment import align

    return align(_read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_frequency": op1_line_frequency,
    "op2_separator_scan": op2_separator_scan,
    "op3_ranked_varint": op3_ranked_varint,
    "op4_boosted_toxicity": op4_boosted_toxicity,
    "op5_license_bands": op5_license_bands,
    "op6_line_crf": op6_line_crf,
    "op7_merge_rounds": op7_merge_rounds,
    "op8_chunk_recipes": op8_chunk_recipes,
    "op9_simhash_links": op9_simhash_links,
    "op10_min_slack_packing": op10_min_slack_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_repeat_groups": op12_repeat_groups,
    "op13_token_alignment": op13_token_alignment,
}

OP8_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body ORDER BY n_points DESC, doc_id NULLS LAST)
"""

OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(str_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM d
),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
coverage AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM repeats) GROUP BY doc_id),
line AS (
  SELECT doc_id, host, text, length(l) AS n, lower(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS k
  FROM (SELECT doc_id, host, text, unnest(lines) AS l FROM w)
),
hosts AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host),
frequent AS (
  SELECT host, k FROM (SELECT host, k, count(DISTINCT text) AS n FROM line GROUP BY host, k) JOIN hosts USING (host)
  WHERE n > 10 AND (100 * n > 2 * texts OR length(k) >= 30 AND n > 1000)
),
judged AS (
  SELECT doc_id, count(*) AS n_lines, sum(n) AS line_chars,
         count(*) FILTER (f.k IS NOT NULL) AS n_removed_lines, coalesce(sum(n) FILTER (f.k IS NOT NULL), 0) AS removed_chars
  FROM line LEFT JOIN frequent f USING (host, k) GROUP BY doc_id
),
base AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(coverage.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN coverage USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * coalesce(removed_chars, 0) <= 70 * coalesce(line_chars, 0) AS kept,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines,
       CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars
FROM base LEFT JOIN judged USING (doc_id)
"""


def _op5_sql() -> str:
    from folio.llm.license_scan import CONTAINED, DISTINCT, SHINGLE, SPEAKS, notice_templates
    from folio.llm.license_texts import AFTER, GRANT, NAMES, REFUSED, SPDX, TEXTS

    plain = lambda body: f"list_filter(regexp_split_to_array(lower({body}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    # DuckDB's patterns don't look behind, so ends of sentences become line ends first
    units = lambda body: f"list_filter(str_split(regexp_replace(lower({body}), '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)), lambda u: contains(u, '{SPEAKS}'))"
    marked = lambda body: f"flatten(list_transform({units(body)}, lambda u: list_concat(['^'], list_concat({plain('u')}, ['$']))))"

    def part(kind: str, rows: list[tuple[str, str]], words) -> str:
        values = ", ".join("({}, '{}', '{}')".format(i, k, v.replace("'", "''")) for i, (k, v) in enumerate(rows))
        shingled = lambda key, body, table: f"""SELECT {key}, i - 1 AS i, array_to_string(words[i:i + {SHINGLE - 1}], ' ') AS s
FROM (SELECT {key}, words, unnest(range(1, len(words) - {SHINGLE - 2})) AS i FROM (SELECT {key}, {words(body)} AS words FROM {table}))"""  # noqa: E731
        return f"""
{kind}_list(template, license, body) AS (VALUES {values}),
{kind}_t AS (SELECT DISTINCT template, license, s FROM ({shingled("template, license", "body", kind + "_list")})),
{kind}_sizes AS (SELECT template, license, n, CAST(pow(2, greatest(1, ceil(log2(greatest(n - 1, 1))))) AS BIGINT) AS stride FROM (SELECT template, license, count(*) AS n FROM {kind}_t GROUP BY ALL)),
{kind}_both AS (SELECT DISTINCT a.template, b.license AS other, s FROM {kind}_t a JOIN {kind}_t b USING (s) WHERE a.license <> b.license),
{kind}_apart AS (SELECT template, other, s FROM {kind}_t JOIN (SELECT DISTINCT template, other FROM {kind}_both) USING (template) ANTI JOIN {kind}_both USING (template, other, s)),
{kind}_needed AS (SELECT template, other, count(*) AS n_apart FROM {kind}_apart GROUP BY ALL),
{kind}_d AS ({shingled("doc_id", "coalesce(text, '')", "documents")}),
{kind}_placed AS (SELECT DISTINCT doc_id, template, s, unnest([i // stride, greatest(i // stride - 1, 0)]) AS number FROM {kind}_d JOIN {kind}_t USING (s) JOIN {kind}_sizes USING (template)),
{kind}_shares AS (SELECT doc_id, template, license, stride, number, round(count(*) / n, 4) AS containment FROM {kind}_placed JOIN {kind}_sizes USING (template) GROUP BY doc_id, template, license, stride, number, n),
{kind}_shown AS (SELECT doc_id, template, number, other, count(*) AS c FROM {kind}_placed JOIN {kind}_apart USING (template, s) GROUP BY ALL),
{kind}_mistaken AS (SELECT DISTINCT doc_id, template, number FROM {kind}_shares JOIN {kind}_needed USING (template) LEFT JOIN {kind}_shown USING (doc_id, template, number, other) WHERE coalesce(c, 0) < {DISTINCT} * n_apart),
{kind}_found AS (SELECT doc_id, license, '{kind}' AS kind, containment, number * stride AS first_word, 2 * stride + {SHINGLE - 1} AS n_words
  FROM {kind}_shares ANTI JOIN {kind}_mistaken USING (doc_id, template, number) WHERE containment >= {CONTAINED}
  QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, number, template) = 1)"""

    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    names = ", ".join(f"({quoted(k)}, {quoted(GRANT + '(?:' + v + ')' + AFTER)})" for k, v in NAMES.items())
    named = f"""
name_list(license, pattern) AS (VALUES {names}),
name_units AS (SELECT doc_id, unnest(str_split(regexp_replace(lower(coalesce(text, '')), '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) AS u FROM documents WHERE contains(lower(text), 'under ')),
name_granted AS MATERIALIZED (SELECT * FROM name_units WHERE contains(u, 'under ') AND regexp_matches(u, {quoted(GRANT)}) AND NOT regexp_matches(u, {quoted(REFUSED)})),
name_found AS (
  SELECT DISTINCT doc_id, license FROM name_granted JOIN name_list ON regexp_matches(u, pattern)
  UNION SELECT doc_id, license FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(lower(coalesce(text, '')), {quoted(SPDX)}, 1)), '(?:-only|-or-later|\\+)?[.+-]*$', '') AS license FROM documents) WHERE license <> '')"""
    return f"""WITH {part('text', list(TEXTS.items()), plain)}, {part('notice', notice_templates(), marked)}, {named}
SELECT * FROM text_found UNION ALL SELECT * FROM notice_found UNION ALL SELECT doc_id, license, 'name', 1.0, -1, 0 FROM name_found"""


# a path has for each level L and the left digest, R and the right one, or R alone where a node is alone in its run
OP11_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
),
d AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS f1, coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS f2,
         coalesce(strlen(text) || ':' || text, '-') AS f4,
         coalesce(xor(list_reduce(list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 7 = 0, false) AS tampered
  FROM documents, crc_table
),
leaves AS (
  SELECT doc_id, lang, sha256(f1 || f2 || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || f4) AS leaf,
         sha256(f1 || f2 || coalesce(strlen(CAST(n_chars + CAST(tampered AS INT) AS VARCHAR)) || ':' || (n_chars + CAST(tampered AS INT)), '-') || f4) AS given
  FROM d
),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
tree AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM tree WHERE len(nodes) > 1
),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE len(nodes) = 1),
whole AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots HAVING count(*) > 0
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM whole WHERE len(nodes) > 1
),
below AS (
  SELECT lang, pos, list(CASE WHEN spot % 2 = 1 THEN 'L' || nodes[spot] ELSE 'R' || coalesce(nodes[spot + 2], '') END ORDER BY level) AS path
  FROM (SELECT p.lang, p.pos, level, nodes, p.pos >> level AS spot FROM placed p JOIN tree t ON p.lang IS NOT DISTINCT FROM t.lang WHERE len(nodes) > 1) GROUP BY lang, pos
),
above AS (
  SELECT lang, list(CASE WHEN spot % 2 = 1 THEN 'L' || nodes[spot] ELSE 'R' || coalesce(nodes[spot + 2], '') END ORDER BY level) AS path
  FROM (SELECT lang, level, nodes, pos >> level AS spot FROM subroots, whole WHERE len(nodes) > 1) GROUP BY lang
),
shown AS (
  SELECT p.doc_id, leaf, given, subroot, (SELECT nodes[1] FROM whole WHERE len(nodes) = 1) AS root, list_concat(coalesce(below.path, []), coalesce(above.path, [])) AS path
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN below ON p.lang IS NOT DISTINCT FROM below.lang AND p.pos = below.pos LEFT JOIN above ON p.lang IS NOT DISTINCT FROM above.lang
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: substr(x, 2)), '')) AS proof_sha256,
       list_reduce(path, lambda made, x: CASE WHEN x[1] = 'L' THEN sha256(substr(x, 2) || made) ELSE sha256(made || substr(x, 2)) END, given) AS folded_root,
       folded_root = root AS verified
FROM shown
"""


ORACLES: dict[str, str] = {
    "op1_line_frequency": OP1_SQL,
    "op5_license_bands": _op5_sql(),
    "op8_chunk_recipes": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
}
