"""The training-data queries: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.llm.common import table
from gaugeworks.llm.conversations import damage_and_repair
from gaugeworks.llm.embedding_join import near_vectors
from gaugeworks.llm.exact_dedup import exact_dedup
from gaugeworks.llm.fingerprints import compare_with_next
from gaugeworks.llm.hard_negatives import hard_negatives
from gaugeworks.llm.html_text import extract_text
from gaugeworks.llm.language import held_out, identify, train_model
from gaugeworks.llm.licenses import scan_licenses, summary
from gaugeworks.llm.mixing import mix
from gaugeworks.llm.near_dedup import near_dedup
from gaugeworks.llm.packing import pack
from gaugeworks.llm.pseudonyms import mask_personal_data
from gaugeworks.llm.url_filter import GLOBS, RULES, glob_regex, judge_urls

#: The key of the registered query; a production run passes a secret of its own.
PSEUDONYM_KEY = "gaugeworks example key"


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    judged = identify(docs.select("doc_id", "text"), train_model(docs))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op2_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op3_pii_pseudonyms(spark, sf_dir):
    masked = mask_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PSEUDONYM_KEY)
    return masked.select("doc_id", "text", F.size("pii").alias("n_pii"), F.to_json("pii").alias("pii"))


def op4_url_filter(spark, sf_dir):
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_license_scan(spark, sf_dir):
    return summary(scan_licenses(table(spark, sf_dir, "documents")))


def op8_minhash_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark, sf_dir):
    pages = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_source_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_conversation_repair(spark, sf_dir):
    return damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_document_fingerprints(spark, sf_dir):
    return compare_with_next(table(spark, sf_dir, "documents"))


def _url_oracle() -> str:
    """Base rules as conditions, longest first; globs as regular expressions on .host/path."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in ordered]
    rule = " ".join(f"WHEN {test} THEN '{name}'" for test, name, _ in fits)
    verdict = " ".join(f"WHEN {test} THEN '{v}'" for test, _, v in fits)
    globs = " OR ".join(f"regexp_matches('.' || host || path, '{glob_regex(g)}')" for g in GLOBS)
    return rf"""
        WITH r AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict FROM p"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_pii_pseudonyms": op3_pii_pseudonyms,
    "op4_url_filter": op4_url_filter,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_source_mixing": op10_source_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_document_fingerprints": op13_document_fingerprints,
}

ORACLES = {
    "op4_url_filter": _url_oracle(),
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op6_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings),
        good AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v
                 WHERE label IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(e, e) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b USING (label)
                  WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        near AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN near USING (vec_id)""",
    "op10_source_mixing": r"""
        WITH d AS (SELECT doc_id, coalesce('s' || source, 'z') AS source, md5(CAST(doc_id AS VARCHAR)) AS key,
                          CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source) AS k FROM g),
        w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(k - 1) % 3 + 1] AS weight, [0.5::DOUBLE, 0.0, -0.5][(k - 1) % 3 + 1] AS slope,
                     source_size * 2.0::DOUBLE AS room FROM r),
        l AS (SELECT *, room / weight AS fills, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS asked,
                     coalesce(sum(room) OVER (ORDER BY room / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
                     sum(weight) OVER (ORDER BY room / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
        v AS (SELECT (asked - filled) / rest AS level FROM l WHERE (asked - filled) / rest <= fills ORDER BY fills, source LIMIT 1),
        t AS (SELECT source, source_size, slope, least(room, (SELECT level FROM v) * weight) AS target FROM l),
        p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
                     CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
              FROM d JOIN t USING (source)),
        q AS (SELECT *, CASE WHEN 2 * start + size <= 2 * words THEN size ELSE 0 END AS one,
                     CASE WHEN 2 * (start + source_size) + size <= 2 * words THEN size ELSE 0 END AS two,
                     start / words::DOUBLE AS x, (start + source_size) / words::DOUBLE AS y FROM p)
        SELECT doc_id, size, source_size, target, one + two AS taken, two AS taken_again,
               CASE WHEN one > 0 THEN round(2 * x / (1 + slope + sqrt(pow(1 + slope, 2) - 4 * slope * x)), 9) END AS position,
               CASE WHEN two > 0 THEN round(2 * y / (1 + slope + sqrt(pow(1 + slope, 2) - 4 * slope * y)), 9) END AS position_again
        FROM q""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS e
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
                   FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
        positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
               n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
        QUALIFY rank <= 5""",
    "op12_conversation_repair": r"""
        WITH RECURSIVE powers AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                       lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
        fated AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                           string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''),
                           lambda s: CAST(ord(s) AS BIGINT))),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS fate
            FROM conversations, powers),
        hurt AS (
            SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                   CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM fated, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt),
        told AS (
            SELECT *, role[1] AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
                   lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
        rows AS (
            SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
            FROM told),
        sums AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM rows GROUP BY conv_id),
        added(state, enters, price, letters, lines) AS (VALUES
            (0, 0, 0, '', ''), (0, 2, 5, 'I', e'\nuser:'), (0, 3, 10, 'II', e'\nuser:\nassistant:'),
            (1, 1, 0, '', ''), (1, 2, 5, 'I', e'\nuser:'), (1, 3, 10, 'II', e'\nuser:\nassistant:'),
            (2, 2, 0, '', ''), (2, 3, 5, 'I', e'\nassistant:'), (3, 3, 0, '', ''), (3, 2, 5, 'I', e'\nuser:'), (3, 3, 10, 'II', e'\nuser:\nassistant:')),
        kept(state, initial, leads) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        steps AS (
            SELECT a.*, e.letter, r.conv_id, r.i,
                   CASE e.letter WHEN 'D' THEN a.enters WHEN 'K' THEN k.leads ELSE CASE a.enters WHEN 2 THEN 3 ELSE 2 END END AS leads,
                   a.price + CASE e.letter WHEN 'D' THEN 2 ELSE CASE e.letter WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END END AS total,
                   a.lines || CASE e.letter WHEN 'D' THEN '' ELSE e'\n' || CASE e.letter WHEN 'K' THEN r.role WHEN 'R' THEN CASE a.enters WHEN 2 THEN 'assistant' ELSE 'user' END END || ':' || r.text END AS line
            FROM rows r, added a, (VALUES ('D'), ('K'), ('R')) AS e(letter) LEFT JOIN kept k ON k.state = a.enters AND k.initial = r.initial AND e.letter = 'K'
            WHERE e.letter = 'D' OR (coalesce(fault, '') NOT IN ('blank', 'duplicate') AND (e.letter = 'R' OR k.leads IS NOT NULL))),
        paths AS (
            SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, '' AS said FROM sums
            UNION ALL
            SELECT conv_id, i, state, cost, audit, said FROM (
                SELECT p.conv_id, s.i, s.leads AS state, p.cost + s.total AS cost, p.audit || s.letters || s.letter AS audit, p.said || s.line AS said,
                       row_number() OVER (PARTITION BY p.conv_id, s.leads ORDER BY p.cost + s.total, p.audit || s.letters || s.letter) AS best
                FROM paths p JOIN steps s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.i = p.i + 1 AND s.state = p.state) WHERE best = 1),
        done AS (
            SELECT p.conv_id, p.cost + a.price AS cost, p.audit || a.letters AS audit, p.said || a.lines AS said,
                   row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + a.price, p.audit || a.letters) AS best
            FROM paths p JOIN sums s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.n = p.i JOIN added a ON a.state = p.state AND a.enters IN (0, 3))
        SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
               coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, CAST(coalesce(d.cost, 0) AS BIGINT) AS cost,
               coalesce(d.audit, '') AS audit, sha256(coalesce(substr(d.said, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN (SELECT * FROM done WHERE best = 1) d ON d.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
