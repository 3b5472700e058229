"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelwork.llm.chat import op4_chat_reply_trees
from reelwork.llm.decontaminate import op7_template_decontamination
from reelwork.llm.divergence import op11_source_divergence_audit
from reelwork.llm.filters import op12_filter_interaction_audit
from reelwork.llm.language import op6_language_id
from reelwork.llm.lines import op8_fuzzy_line_dedup
from reelwork.llm.mixing import op1_mix_sources
from reelwork.llm.neardup import op10_minhash_near_dedup
from reelwork.llm.quality import op9_quality_rules
from reelwork.llm.sharding import op5_virtual_slot_shards
from reelwork.llm.substrings import op2_suffix_array_dedup
from reelwork.llm.tokens import op3_prefix_token_counts
from reelwork.llm.warc import op13_warc_boundary_chain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_suffix_array_dedup, op3_prefix_token_counts, op4_chat_reply_trees, op5_virtual_slot_shards, op6_language_id, op7_template_decontamination, op8_fuzzy_line_dedup, op9_quality_rules, op10_minhash_near_dedup, op11_source_divergence_audit, op12_filter_interaction_audit, op13_warc_boundary_chain)
}

_CONTROLS = ("<|turn|>", "<|body|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for mark in _CONTROLS:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


ORACLE: dict[str, str] = {
    "op4_chat_reply_trees": f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(length('<|turn|>' || {_escaped('role')} || '<|body|>' || {_escaped('text')} || '<|end|>'))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op12_filter_interaction_audit": """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS (
    SELECT doc_id, part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
        + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS cell
    FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, cell, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, cell),
p(k, x) AS (VALUES (1, 'A'), (2, 'B'), (4, 'C'), (8, 'D'), (16, 'E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks FROM p a, p b, p c, p d, p e WHERE a.k + b.k + c.k + d.k + e.k = 31 AND (a.k | b.k | c.k | d.k | e.k) = 31),
s AS (SELECT filter_order, step::INT AS step, ks[step] AS k, coalesce(list_sum(ks[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) AS r(step)),
r AS (
    SELECT part, filter_order, step, k, sum(CASE WHEN cell & (before | k) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN cell & before = 0 AND cell & k > 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN cell & before > 0 AND cell & k > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN cell = k THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN cell & before = 0 AND cell & k > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN cell & before = 0 AND cell & k > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, k)::BIGINT AS shapley FROM r""",
    "op13_warc_boundary_chain": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
m AS (SELECT *, CASE WHEN octet_length(body) >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS latest FROM p)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
    CASE WHEN latest IS DISTINCT FROM page_id AND latest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN latest IS DISTINCT FROM page_id THEN latest END AS refers_to
FROM m""",
    "op11_source_divergence_audit": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_count FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
l AS (SELECT lang, count(*) AS v, sum(lang_count) AS lang_n FROM k GROUP BY lang),
o AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT lang, source, sum(n) AS total FROM o GROUP BY ALL),
x AS (
    SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 5) // (coalesce(m.total, 0) + 5 * l.v))::BIGINT AS p,
        (1 + 1000000000::HUGEINT * (k.lang_count + 5) // (l.lang_n + 5 * l.v))::BIGINT AS q
    FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN m ON m.lang = g.lang AND m.source = g.source LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM x WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r
QUALIFY part = 'pair' OR rank <= 50""",
}
