"""DuckDB SQL that registered queries must agree with."""

from __future__ import annotations

#: Weighted Jaccard similarity of every window that shares a shingle with an item of its length.
DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, w, len(w) AS n, CASE WHEN len(w) < 5 THEN len(w) ELSE 5 END AS k FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT item_id, n, k, n - k + 1 AS m, j, array_to_string(w[j : j + k - 1], ' ') AS s FROM b, LATERAL (SELECT unnest(range(1, n - k + 2)) AS j)),
ks AS (SELECT DISTINCT k FROM b),
ds AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS s FROM d, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS p)),
hit AS (SELECT DISTINCT ds.doc_id, ds.k, ds.p, bs.item_id, bs.m FROM ds JOIN bs ON ds.k = bs.k AND ds.s = bs.s),
most AS (SELECT doc_id, k, max(p) AS top FROM ds GROUP BY ALL),
starts AS (SELECT DISTINCT hit.doc_id, hit.k, item_id, m, unnest(range(greatest(p - m + 1, 1), least(p, top - m + 1) + 1)) AS pos FROM hit JOIN most ON hit.doc_id = most.doc_id AND hit.k = most.k),
inside AS (SELECT starts.doc_id, item_id, m, pos, s, count(*) AS c FROM starts JOIN ds ON starts.doc_id = ds.doc_id AND starts.k = ds.k AND ds.p BETWEEN pos AND pos + m - 1 GROUP BY ALL),
own AS (SELECT item_id, s, count(*) AS c FROM bs GROUP BY ALL),
shared AS (SELECT doc_id, inside.item_id, m, pos, sum(least(inside.c, own.c)) AS i FROM inside JOIN own ON inside.item_id = own.item_id AND inside.s = own.s GROUP BY ALL),
best AS (SELECT doc_id, item_id, i / (2 * m - i) AS similarity, pos - 1 AS word FROM shared WHERE i / (2 * m - i) >= 0.8)
SELECT doc_id, item_id, similarity, CAST(word AS INTEGER) AS word FROM best QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, word) = 1
"""
