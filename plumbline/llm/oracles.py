"""DuckDB SQL for the queries that it can express: the same rows from plain definitions."""

import re

from plumbline.llm.licenses import PHRASES, TEMPLATES

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(8, len(w)) AS n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS phrase
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
found AS (SELECT p.doc_id, p.i, x.n, x.item FROM places p JOIN sizes s ON p.i + s.n - 1 <= len(p.w)
          JOIN windows x ON x.n = s.n AND x.phrase = array_to_string(p.w[p.i:p.i + s.n - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.list, '')) AS items_sha256, coalesce(t.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""

OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
c AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""



def _pattern(template: str) -> str:
    """A template as a regular expression over words that each have a space after them."""
    parts = re.findall(r"\[\[|\]\]|\{\d+-\d+\}|[^\s\[\]{}]+", template)
    return " " + "".join("(" if p == "[[" else ")?" if p == "]]" else f"([^ ]+ ){{{p[1:-1].replace('-', ',')}}}" if p[0] == "{" else f"{p} " for p in parts)


def _license_sql() -> str:
    words = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()!r}) AS b{k}" for k, (p, _) in enumerate(PHRASES))
    places = " || ".join(f"b{k}" for k in range(len(PHRASES)))
    base = ", ".join(f"CASE WHEN len(b{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))
    more = ", ".join(f"CASE WHEN regexp_matches(joined, '{_pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES)
    joined = lambda labels: f"array_to_string(list_sort(list_distinct(list_filter({labels}, lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined, {words} FROM d),
l AS (SELECT doc_id, w, {places} AS places, [{base}] AS base, [{more}] AS more FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       {joined("base")} AS base_labels, {joined("base || more")} AS labels,
       CAST(CASE WHEN len(list_filter(more, lambda x: x IS NOT NULL)) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
FROM l
"""


OP9 = _license_sql()

#: What was stored is what is read.
OP5 = "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents"

ORACLES = {"op5_sharding": OP5, "op9_licenses": OP9, "op4_decontamination": OP4, "op8_embedding_dedup": OP8}
