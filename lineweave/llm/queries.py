"""Registered queries of the training-data operators, and their oracle SQL where SQL can express them."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import (
    conversation_trie,
    decontaminate,
    exact_dedup,
    filter_audit,
    html_extract,
    license_scan,
    line_dedup,
    near_dedup,
    packing,
    quality,
    substring_dedup,
    suffix_dedup,
    toxicity,
)
from lineweave.llm.license_values import RULES

QUERIES, ORACLES = {}, {}


def registered(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered("op2_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


@registered("op7_line_dedup", f"""
    WITH lines AS (
      SELECT doc_id, text, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    spread AS (
      SELECT trim(line, ' ' || chr(9) || chr(13)) AS line, min(doc_id) AS first FROM lines
      GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
    marked AS (
      SELECT l.doc_id, l.pos, l.line, trim(l.line, ' ' || chr(9) || chr(13)) <> '' AS filled,
             s.line IS NOT NULL AND s.line <> '' AND s.first <> l.doc_id AS gone
      FROM lines l LEFT JOIN spread s ON trim(l.line, ' ' || chr(9) || chr(13)) = s.line)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
           CAST(count(*) FILTER (filled) AS INT) AS n_lines, CAST(count(*) FILTER (gone) AS INT) AS n_removed
    FROM marked GROUP BY doc_id""")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def _license_sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({text(k)}, {n})" for k, n in license_scan.KNOWN.items())
    rules = ", ".join(f"({text(','.join(map(str, ids)))}, {text(name)}, {text(kind)})" for name, kind, ids in RULES)
    end = {"line": license_scan.LINE_END, "wrapped": license_scan.WRAPPED_END}
    pieces = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS reading, unnest(regexp_split_to_array(text, '{v}')) AS s, "
        f"generate_subscripts(regexp_split_to_array(text, '{v}'), 1) - 1 AS n FROM documents" for k, v in end.items())
    return f"""
    WITH known(k, id) AS (VALUES {known}), rules(sentence_ids, license, kind) AS (VALUES {rules}),
    pieces AS ({pieces}),
    normal AS (SELECT *, lower(trim(regexp_replace(s, '{license_scan.OTHER}', ' ', 'g'))) AS plain,
                      length(regexp_replace(s, '{license_scan.OTHER}', '', 'g')) AS letters FROM pieces),
    numbered AS (SELECT p.*, coalesce(k.id, 0) AS id, CAST(coalesce(sum(letters) OVER (PARTITION BY doc_id, reading ORDER BY n
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS since
                 FROM normal p LEFT JOIN known k ON k = regexp_replace(plain, {text(license_scan.HOLDERS[0])}, {text(license_scan.HOLDERS[1])})),
    seq AS (SELECT doc_id, reading, string_agg(id || '@' || n, ' ' ORDER BY n) AS seq FROM numbered GROUP BY 1, 2),
    hits AS (SELECT doc_id, reading, unnest(regexp_extract_all(seq, '{license_scan.rule_pattern()}')) AS m FROM seq),
    named AS (SELECT *, replace(regexp_replace(m, ' 0@[0-9]+|@[0-9]+', '', 'g'), ' ', ',') AS sentence_ids,
                     CAST(regexp_extract(m, '@([0-9]+)', 1) AS INT) AS first_sentence,
                     CAST(regexp_extract(m, '@([0-9]+)$', 1) AS INT) AS last_sentence FROM hits),
    placed AS (SELECT h.*, a.since AS low, b.since + b.letters AS high FROM named h
               JOIN numbered a ON a.doc_id = h.doc_id AND a.reading = h.reading AND a.n = h.first_sentence
               JOIN numbered b ON b.doc_id = h.doc_id AND b.reading = h.reading AND b.n = h.last_sentence)
    SELECT doc_id, license, kind, reading, first_sentence, last_sentence, sentence_ids
    FROM placed n JOIN rules USING (sentence_ids)
    WHERE reading = 'line' OR NOT EXISTS (SELECT 1 FROM placed o WHERE o.reading = 'line' AND o.doc_id = n.doc_id
                                          AND o.sentence_ids = n.sentence_ids AND o.low < n.high AND n.low < o.high)"""


@registered("op4_license_scan", _license_sql())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_matches(table(spark, sf_dir, "documents"))


@registered("op9_decontaminate", """
    WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS size,
                       array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM windows),
    grams AS (SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win FROM (
        SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
    found AS (SELECT doc_id, item_id, g.size, i FROM grams g JOIN windows v ON g.win = v.win AND g.size = v.size),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY 1),
    named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(items_sha256, sha256('')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


@registered("op5_near_dedup")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).drop("text_sha")


@registered("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.segments(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("segment_text")
    return packing.pack(cut)


def labels(spark: SparkSession, sf_dir: str, column: str, folds: int, held_out: int) -> DataFrame:
    """``id, label`` of the rows that may be learned from."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("bigint").alias("id"), F.col(column).cast("int").alias("label")).filter(
        quality.fold(F.col("id"), folds) != held_out)


def scored(found: DataFrame, folds: int, held_out: int, threshold: float) -> DataFrame:
    return found.withColumns({
        "held_out": F.coalesce(quality.fold(F.col("doc_id"), folds) == held_out, F.lit(False)),
        "predicted": (F.col("score") >= threshold).cast("int")})


@registered("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(table(spark, sf_dir, "documents"), labels(spark, sf_dir, "quality", 5, 0))
    return scored(found, 5, 0, quality.KEEP_SCORE).select("doc_id", "held_out", "score", "predicted")


@registered("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxic_spans(table(spark, sf_dir, "documents"), labels(spark, sf_dir, "toxic", 3, 1))
    return scored(found, 3, 1, toxicity.TOXIC_SCORE).select("doc_id", "held_out", "score", "predicted", "spans")


@registered("op3_html_extract")
def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


@registered("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


_PERMUTED = " UNION ALL ".join(
    f"SELECT '{''.join(order)}' AS filter_order" for order in itertools.permutations(filter_audit.FILTERS))


@registered("op12_filter_audit", f"""
    WITH docs AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY 1),
    marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                     max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
    flags AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
             CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
             || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * length(d.text) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN f.first < d.doc_id THEN 'E' ELSE '' END AS failed
      FROM docs d JOIN firsts f ON f.text = d.text LEFT JOIN marks m ON m.doc_id = d.doc_id),
    cells AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM flags GROUP BY 1, 2),
    steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
              FROM ({_PERMUTED}), (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    seen AS (
      SELECT *, contains(failed, own) AS fails,
             length(before) > 0 AND regexp_matches(failed, '[' || before || '_]') AS gone FROM cells, steps),
    found AS (
      SELECT part, filter_order, CAST(step AS INT) AS step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept,
             coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
             coalesce(sum(n) FILTER (failed = own), 0) AS unique_fails,
             coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost,
             coalesce(sum(bad) FILTER (fails AND NOT gone), 0) AS toxic_lost FROM seen GROUP BY ALL)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM found""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered("op13_conversation_trie", """
    WITH turns AS (
      SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
             len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
      FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(words ORDER BY turn NULLS FIRST, k) AS ws,
                   list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(
                     string_split(CAST(c AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
                     lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))) AS crc
            FROM turns GROUP BY c),
    headed AS (SELECT *, CAST(xor(crc, 4294967295) % 4 AS BIGINT) AS h FROM own),
    whole AS (
      SELECT a.c, list_concat(list_slice(coalesce(b.ks, []), 1, a.h), list_slice(a.ks, a.h + 1, len(a.ks))) AS ks,
             list_concat(list_slice(coalesce(b.ws, []), 1, a.h), list_slice(a.ws, a.h + 1, len(a.ws))) AS ws
      FROM headed a LEFT JOIN own b ON b.c = a.c - ((a.c % 20) + 20) % 20),
    steps AS (SELECT c, ks, ws, unnest(range(0, len(ks) + 1)) AS d FROM whole),
    members AS (SELECT c, d, d = len(ks) AS ended, array_to_string(list_slice(ks, 1, d), '') AS p,
                       array_to_string(list_slice(ks, 1, d - 1), '') AS up, coalesce(ws[d], 0) AS w FROM steps),
    nodes AS (SELECT p, any_value(d) AS d, any_value(CASE WHEN d > 0 THEN up END) AS up, min(c) AS c, count(*) AS n, any_value(w) AS w,
                     sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ended), '')) AS ends FROM members GROUP BY p),
    kids AS (SELECT up, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
    full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.up = n.p),
    sums AS (SELECT a.p, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.w) AS saved
             FROM full_nodes a JOIN full_nodes b ON starts_with(b.p, a.p) GROUP BY a.p)
    SELECT f.c AS conv_id, f.d AS depth, u.c AS parent_conv_id, f.n AS n_convs, f.n_children, s.n_leaves,
           CAST(s.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
    FROM full_nodes f JOIN sums s ON s.p = f.p LEFT JOIN nodes u ON u.p = f.up""")
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@registered("op11_suffix_dedup", """
    WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    windows AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS k
                FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS p FROM docs WHERE n >= 200)),
    again AS (SELECT doc_id, p FROM windows SEMI JOIN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1) USING (k)),
    cut AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200, true) AS fresh FROM again),
    numbered AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM cut),
    spans AS (SELECT doc_id, run, min(p) AS b, max(p) + 200 AS e FROM numbered GROUP BY ALL),
    edges AS (SELECT doc_id, b, e FROM spans UNION ALL SELECT doc_id, n, n FROM docs),
    gaps AS (SELECT doc_id, b, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b, e), 0) AS since FROM edges),
    kept AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (b - since)), '' ORDER BY b) AS h FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
    sums AS (SELECT doc_id, count(*) AS n_spans, sum(e - b) AS n_removed FROM spans GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(kept.h)) AS kept_sha256
    FROM docs JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)""")
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
