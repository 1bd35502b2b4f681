"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import licenses

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RANKED = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
item AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
wanted AS (SELECT i, t, count(*) AS times FROM (SELECT i, unnest(terms) AS t FROM item) GROUP BY ALL),
held AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM doc) GROUP BY ALL),
total AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM doc),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM held GROUP BY t), total),
long AS (SELECT r, doc_id, 25 + (75 * len(terms) * n_docs) // n_terms AS m FROM doc, total WHERE len(terms) > 0),
scored AS (SELECT i, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM wanted JOIN held USING (t) JOIN weight USING (t) JOIN long USING (r) GROUP BY ALL),
ranked AS (SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored JOIN item USING (i) JOIN doc USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

COLLOCATIONS = rf"""
WITH piece AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
place AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM piece),
gram AS (SELECT lang, array_to_string(words[pos:pos + k - 1], ' ') AS phrase, k, count(*) AS f FROM place, (SELECT unnest(range(1, 6)) AS k) WHERE pos + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100),
size AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM piece GROUP BY lang),
word AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM gram),
cut AS (SELECT c.lang, c.phrase, c.f AS a, n, l.f AS l, r.f AS r, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score, j
    FROM word c JOIN size USING (lang), (SELECT unnest(range(1, 5)) AS j) JOIN gram l ON true JOIN gram r ON true
    WHERE j < c.k AND l.lang = c.lang AND r.lang = c.lang AND l.phrase = array_to_string(w[1:j], ' ') AND r.phrase = array_to_string(w[j + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT DISTINCT x.lang, x.part AS phrase, x.f FROM (
    SELECT lang, f, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:], ' ')]) AS part FROM word WHERE k > 2) x),
kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND i.f >= b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS INT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in rows)


_TEMPLATES = _values([(t, label, wording, len(keys)) for t, (label, wording, keys) in enumerate(licenses.NOTICES)])
_KEYS = _values([(t, k, licenses._place(wording.split(), k.split())) for t, (_, wording, keys) in enumerate(licenses.NOTICES) for k in keys])

LICENSES = rf"""
WITH template(t, label, wording, n_keys) AS (VALUES {_TEMPLATES}),
key(t, said, place) AS (VALUES {_KEYS}),
phrase(label, said) AS (VALUES {_values(licenses.PHRASES)}),
doc AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({LOWER.format("text")}, '{licenses.WORD}') AS words FROM documents),
spoken AS (SELECT said, string_split(said, ' ') AS ws FROM (SELECT said FROM phrase UNION SELECT said FROM key)),
indexed AS (SELECT t, unnest(string_split(wording, ' ')) AS w, unnest(range(len(string_split(wording, ' ')))) AS place FROM template),
word AS MATERIALIZED (SELECT * FROM (SELECT d, unnest(words) AS w, unnest(range(len(words))) AS pos FROM doc) WHERE w IN (SELECT w FROM indexed UNION SELECT unnest(ws) FROM spoken)),
df AS (SELECT w, count(DISTINCT d) AS df FROM word GROUP BY w),
weighed AS (SELECT i.*, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * coalesce(df, 0) + 1)::DOUBLE)) AS BIGINT) AS weight FROM indexed i LEFT JOIN df USING (w), (SELECT count(*) AS n FROM doc)),
rare AS (SELECT * FROM weighed WHERE weight < (SELECT CAST(floor(1000 * ln((2 * count(*) + 2)::DOUBLE)) AS BIGINT) FROM doc) QUALIFY row_number() OVER (PARTITION BY t ORDER BY weight DESC, place) <= {licenses.INDEXED}),
total AS (SELECT t, greatest(1, sum(weight)) AS total FROM rare GROUP BY t),
stands AS MATERIALIZED (SELECT d, said, pos FROM word JOIN spoken ON w = ws[1] JOIN doc USING (d) WHERE words[pos + 1:pos + len(ws)] = ws),
hit AS (SELECT d, t, pos - place AS begin, place, weight, 0 AS key FROM word JOIN rare USING (w) WHERE d IN (SELECT d FROM stands)
    UNION ALL SELECT d, t, pos - place, -1 - place, 0, 1 FROM stands JOIN key USING (said)),
binned AS (SELECT DISTINCT d, t, CAST(floor(begin / {licenses.SLACK}) AS BIGINT) + unnest([0, 1]) AS bin, place, weight, key FROM hit),
agreed AS (SELECT d, t, bin, sum(weight) AS weight, sum(key) AS keys FROM binned GROUP BY ALL),
notice AS (SELECT d, t, max(weight)::DOUBLE / any_value(total) AS share FROM agreed JOIN template USING (t) JOIN total USING (t) WHERE keys = n_keys GROUP BY d, t),
found AS (SELECT d, label, share FROM notice JOIN template USING (t) WHERE share >= {licenses.LEAST}),
base AS (SELECT d, label, pos FROM stands JOIN phrase USING (said)),
b AS (SELECT d, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY d),
n AS (SELECT d, max(share) AS share FROM found GROUP BY d),
a AS (SELECT d, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT d, label FROM base UNION SELECT d, label FROM found) GROUP BY d)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM doc LEFT JOIN b USING (d) LEFT JOIN n USING (d) LEFT JOIN a USING (d)
"""
