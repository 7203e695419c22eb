"""DuckDB SQL for the operators that SQL expresses at a bearable cost, over whole tables."""

from __future__ import annotations

from tributary.llm.quality_rules import CONTENT_SHARE, STAY, WEIGHTS

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ESCAPED = r"length(regexp_replace({x}, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g'))"

OP5 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum({_ESCAPED.format(x="role")} + {_ESCAPED.format(x="text")} + {len("<|start|><|text|><|end|>")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS words FROM documents),
b AS (SELECT item_id, {_ALNUM} AS words FROM benchmark),
bw AS (SELECT item_id, words, least(len(words), 13) AS n, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS i FROM b WHERE len(words) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS w FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS w FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, lens WHERE len(words) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON win.w = dw.w AND win.n = dw.n),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
p AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
r AS (SELECT w FROM p GROUP BY w HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM p JOIN r USING (w)),
g AS (SELECT doc_id, list(k) AS ks, count(*) AS n_removed FROM gone GROUP BY doc_id),
w AS (SELECT d.doc_id, words, n_removed, unnest(range(1, len(words) + 1)) AS k FROM d JOIN g USING (doc_id)),
kept AS (SELECT doc_id, string_agg(words[k], ' ' ORDER BY k) AS text FROM w ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(CASE WHEN n_removed IS NULL THEN array_to_string(words, ' ') ELSE coalesce(kept.text, '') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_FOLD)} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
  UNION ALL SELECT doc_id, 'short ' || array_to_string(words, ' ') FROM d WHERE len(words) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM sym UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON sym.a = reach.other),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)"""

OP4 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
b AS (SELECT doc_id, n, h, unnest(range(1, n + 1)) AS i FROM d WHERE n > 0),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS c, CASE WHEN i + 99 <= n THEN md5(substr(h, 2 * i - 1, 200)) END AS x FROM b),
f AS (SELECT x, min({'d': doc_id, 'i': i}) AS lead FROM w WHERE x IS NOT NULL GROUP BY x HAVING count(*) > 1),
m AS (SELECT w.doc_id, w.i, w.c, coalesce(lead.d <> w.doc_id OR lead.i <> w.i, false) AS later FROM w LEFT JOIN f USING (x)),
g AS (SELECT doc_id, i, c, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM m),
s AS (SELECT doc_id, i, c, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(c, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

# The field's best path by its recursion: forwards the clipped difference of the two states' scores, then labels backwards.
_W = dict(zip(("bias", "symbols", "upper", "pipes", "echo", "duplicate", "stop", "length", "distinct"), WEIGHTS.tolist(), strict=True))
OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM d),
l1 AS (SELECT doc_id, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, regexp_replace(line, '[^A-Za-z]', '', 'g') AS letters FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again FROM l1),
l3 AS (SELECT doc_id, k, n, again, len(w) AS size, {_W["bias"]!r} + {_W["symbols"]!r} * least(length(regexp_replace(line, '[^#*$%&|<>!]', '', 'g')) / len(w), 2)
  + {_W["upper"]!r} * CASE WHEN length(letters) >= 10 THEN length(regexp_replace(letters, '[^A-Z]', '', 'g')) / length(letters) ELSE 0 END
  + {_W["pipes"]!r} * len(list_filter(w, lambda x: x = '|')) / len(w) + {_W["echo"]!r} * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) / len(w)
  + {_W["duplicate"]!r} * CAST(again AS INTEGER) + {_W["stop"]!r} * CAST(regexp_matches(w[-1], '[.?!:;"\x27)]$') AS INTEGER) + {_W["length"]!r} * ln(1 + len(w)) / 4 + {_W["distinct"]!r} * len(list_distinct(w)) / len(w) AS e FROM l2),
go(doc_id, k, n, size, diff) AS (SELECT doc_id, k, n, size, CAST(e AS DOUBLE) FROM l3 WHERE k = 1
  UNION ALL SELECT l3.doc_id, l3.k, l3.n, l3.size, l3.e + greatest(least(go.diff, {2 * STAY!r}), {-2 * STAY!r}) FROM go JOIN l3 ON l3.doc_id = go.doc_id AND l3.k = go.k + 1),
back(doc_id, k, size, content) AS (SELECT doc_id, k, size, diff > 0 FROM go WHERE k = n
  UNION ALL SELECT go.doc_id, go.k, go.size, go.diff >= CASE WHEN back.content THEN {-2 * STAY!r} ELSE {2 * STAY!r} END FROM back JOIN go ON go.doc_id = back.doc_id AND go.k = back.k - 1),
share AS (SELECT doc_id, CAST(coalesce(sum(size) FILTER (content), 0) AS BIGINT) AS held FROM back GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines FROM l2 GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 2], ' ') AS x FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)),
t AS (SELECT doc_id, x FROM g GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g SEMI JOIN t USING (doc_id, x)) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words) AS base_failed, coalesce(held, 0) AS held
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN share USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND held / n_words >= {CONTENT_SHARE!r} AS kept FROM c"""

# Every page of the tables has one article of headings and paragraphs, so its blocks are what lies between these tags.
OP7 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(replace(body, '<br>', ' '), '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS blocks FROM a),
c AS (SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '&#x27;', chr(39)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM b),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t"""

_GOOD = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op11() -> str:
    """The rounds one after the other; every part is compared with every entry."""
    ctes = [
        f"k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_GOOD})",
        "e AS (SELECT part, vec_id, label, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS v FROM k, range(4) r(part))",
        "b0 AS (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS BIGINT) AS entry, v FROM e QUALIFY entry < 256)",
    ]
    near = "(SELECT e.part, vec_id, label, e.v, min({{'d': CAST(list_sum(list_transform(range(1, len(e.v) + 1), lambda i: (e.v[i] - b.v[i]) * (e.v[i] - b.v[i]))) AS BIGINT), 'entry': entry}}) AS best FROM e JOIN b{0} b ON b.part = e.part GROUP BY ALL)"
    for k in range(4):
        ctes.append(f"a{k} AS {near.format(k)}")
        ctes.append(f"s{k} AS (SELECT part, best.entry AS entry, pos, CAST(floor(sum(v[pos]) / count(*)) AS BIGINT) AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS pos FROM a{k}) GROUP BY ALL)")
        ctes.append(f"b{k + 1} AS (SELECT part, entry, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT part, entry, list(x ORDER BY pos) AS v FROM s{k} GROUP BY ALL) n USING (part, entry))")
    ctes.append(f"a4 AS {near.format(4)}")
    ctes.append("f AS (SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 GROUP BY ALL)")
    ctes.append("h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4)")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, h"


OP11 = _op11()

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_FOLD}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT lang, source, doc, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(all_n, 0) AS all_n, coalesce((SELECT sum(n) FROM n WHERE n.lang = x.lang AND n.source = x.source), 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l USING (lang)),
s AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 5) // (group_n + 5 * v) AS p, 1 + 1000000000::HUGEINT * (total + 5) // (all_n + 5 * v) AS q
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""

OP13 = f"""
WITH RECURSIVE k AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {_GOOD} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM k a JOIN k b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT a AS vec_id, a AS other FROM link UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other),
low AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)"""

ORACLES = {"op4_suffix_dedup": OP4, "op5_chat_format": OP5, "op6_quality_rules": OP6, "op7_html_text": OP7, "op8_decontaminate": OP8, "op9_substring_index": OP9, "op10_near_dups": OP10, "op11_vector_codes": OP11, "op12_source_audit": OP12, "op13_vector_links": OP13}
