"""DuckDB SQL of the operator queries that SQL can express.

op1 needs a checksum that DuckDB lacks, op2 the guess costs, op6 greedy tiling, op8 the trained network: tests/llm holds those against
brute force.
"""

from __future__ import annotations

from . import chat, licences, mixing

_B32 = "||".join(
    f"(SELECT string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[{5 * g + 1}:{5 * g + 5}])::BIGINT >> s) & 31) + 1], '' ORDER BY s DESC) FROM (SELECT unnest([0,5,10,15]) AS s))" for g in range(8)
)

OP3 = f"""WITH p AS (SELECT page_id, coalesce(html,'') AS html FROM pages), d AS (SELECT page_id, strlen(html)::BIGINT AS n, sha1(html) AS h FROM p),
g AS (SELECT h, n, max(page_id) AS keeper FROM d GROUP BY 1,2)
SELECT page_id, n AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM d JOIN g USING (h, n)"""

_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w,' ')] ELSE list_distinct(list_transform(range(1, len(w)-3), lambda i: array_to_string(w[i:i+4],' '))) END AS s FROM w),
c AS (SELECT doc_id, md5(array_to_string(list_sort(s), chr(10))) AS c, len(s) AS n FROM s), k AS (SELECT c, n, min(doc_id) AS rep, count(*) AS copies FROM c WHERE n > 0 GROUP BY 1,2),
e AS (SELECT rep, copies, n, unnest(s) AS g FROM k JOIN s ON s.doc_id = rep), pairs AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(a.copies) AS ca, any_value(b.copies) AS cb, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY 1,2),
l AS (SELECT a, b, ca, cb FROM pairs WHERE shared >= 0.8 * (na + nb - shared) - 1e-9), u AS (SELECT a, b, cb AS c FROM l UNION ALL SELECT b, a, ca FROM l), x AS (SELECT a AS rep, sum(c) AS n FROM u GROUP BY 1),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b), m AS (SELECT a AS rep, min(b) AS low FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(k.rep, c.doc_id)::BIGINT AS class_id, coalesce(k.copies - 1 + coalesce(x.n, 0), 0)::BIGINT AS n_links, coalesce(least(k.rep, m.low), c.doc_id)::BIGINT AS component_id, c.doc_id = coalesce(least(k.rep, m.low), c.doc_id) AS kept
FROM c LEFT JOIN k ON k.c = c.c AND k.n = c.n LEFT JOIN x ON x.rep = k.rep LEFT JOIN m ON m.rep = k.rep"""

OP5 = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR,'')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5,2,1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS weight, (sum(source_size) OVER ())::DOUBLE AS total, 3.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap/weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (ORDER BY cap/weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing FROM w),
g AS (SELECT *, cap * sharing <= rest * weight AS stops FROM f),
t AS (SELECT *, CASE WHEN stops THEN cap ELSE weight * (total - sum(CASE WHEN stops THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN stops THEN 0 ELSE weight END) OVER (), 0) END AS target FROM g),
i AS (SELECT *, sum(target) OVER (ORDER BY source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM t),
z AS (SELECT (i.range * {mixing.STEP} % 4294967296) / 4294967296.0::DOUBLE AS u FROM range(0, (SELECT ceil(sum(size)/128.0)::BIGINT FROM d)) i),
k AS (SELECT source, count(*) * 128 AS words FROM z JOIN i ON u >= (upto - target) / total AND u < upto / total GROUP BY 1),
m AS (SELECT i.source, source_size, target, least(coalesce(words, 0), 3 * source_size)::BIGINT AS words FROM i LEFT JOIN k ON k.source IS NOT DISTINCT FROM i.source),
p AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS place FROM d)
SELECT doc_id, size, source_size, target, ((words // greatest(source_size, 1)) * size + greatest(0, least(place + size, words % greatest(source_size, 1)) - place))::BIGINT AS taken FROM p JOIN m ON m.source IS NOT DISTINCT FROM p.source"""


def _template_rows() -> str:
    rows = []
    for i, (text, label, base) in enumerate([*((t, x, "true") for t, x in licences.PHRASES.items()), *((t, x, "false") for t, x in licences.NOTICES.items())]):
        parts = text.split()
        rows += [f"('{a} {b}',{i},'{label}',{base},{len(parts) - 1},{at})" for at, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
    return ",".join(rows)


OP7 = rf"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), t(gram, tpl, label, base, grams, place) AS (VALUES {_template_rows()}),
e AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS pos, w FROM w), g AS (SELECT r, pos, a || ' ' || w[pos+2] AS gram FROM e WHERE pos + 2 <= len(w)),
v AS (SELECT r, tpl, label, base, grams, pos - place AS d, count(DISTINCT place) AS votes, list(DISTINCT place) AS ats FROM g JOIN t USING (gram) GROUP BY ALL),
c AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, tpl ORDER BY d) <= 2 THEN 0 ELSE 1 END AS cut FROM v), b AS (SELECT *, sum(cut) OVER (PARTITION BY r, tpl ORDER BY d) AS band FROM c),
f AS (SELECT r, tpl, label, base, sum((base AND votes = grams)::INT) AS places, min(CASE WHEN base AND votes = grams THEN d END) AS first, max(CASE WHEN base AND votes = grams THEN d END) AS last, len(list_distinct(flatten(list(ats)))) / any_value(grams) AS coverage FROM b GROUP BY r, tpl, label, base, band),
s AS (SELECT *, CASE WHEN base THEN (places > 0)::INT::DOUBLE ELSE coverage END AS cover FROM f),
x AS (SELECT r, sum(places) AS n, min(first) AS first, max(last) AS last, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0 OR cover >= 0.6) AS al, max(cover) AS score FROM s GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n,0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word, coalesce(bl,'') AS base_labels, coalesce(al,'') AS labels, coalesce(score,0)::DOUBLE AS score FROM w LEFT JOIN x USING (r)"""

OP9 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), m AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(least(vec_id, low), vec_id)::BIGINT AS component_id, vec_id = coalesce(least(vec_id, low), vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id"""

_T = chat.Template()
_CONTROLS = "|".join("".join(f"\\{c}" if c in "[]/<>" else c for c in x) for x in _T.controls())
_ESCAPED = rf"(length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '{_CONTROLS}')))"
_MARKS = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(_T.open[r]) + len(_T.close[r])}" for r in _T.open) + f" ELSE {sum(map(len, _T.other))} + length(role) END"
_LEGAL = " OR ".join(f"(before = '{a}' AND role IN ({','.join(repr(b) for b in bs)}))" for a, bs in _T.after.items())

OP10 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS before FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, ({len(_T.begin)} + sum({_MARKS} + {_ESCAPED}))::BIGINT AS formatted_chars,
 bool_and({_LEGAL}) AND arg_max(role, (turn, role, text)) IN ({','.join(map(repr, _T.final))}) AS legal FROM o GROUP BY conv_id"""

ORACLES = {"op3_warc_zip": OP3, "op4_ngram_jaccard": OP4, "op5_source_mix": OP5, "op7_license_scan": OP7, "op9_embedding_dedup": OP9, "op10_chat_format": OP10}
