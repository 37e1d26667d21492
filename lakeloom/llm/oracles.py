"""SQL for the operators that SQL can express, over the given tables."""

from __future__ import annotations

# Payload digests in base32, five hex digits being four letters.
OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, upper(sha1(html)) AS hex FROM p),
e AS (SELECT page_id, payload_bytes, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1), '' ORDER BY i) AS payload_digest
      FROM (SELECT *, unnest(range(32)) AS i FROM d) GROUP BY page_id, payload_bytes, hex),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

# All pairs by cosine, and what links can reach.
OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM
  (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) JOIN
  (SELECT e.vec_id, count(p.b)::BIGINT AS n_links FROM embeddings e LEFT JOIN pairs p ON p.a = e.vec_id GROUP BY e.vec_id) USING (vec_id)
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
# Every window of every text against those of the benchmark.
OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[k : k + size - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM i)),
dw AS (SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS s
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
m AS (SELECT doc_id, item_id, k, size FROM dw JOIN iw USING (size, s)),
h AS (SELECT doc_id, count(DISTINCT spot)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS spot FROM m) GROUP BY 1),
n AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _hash(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


# CRC-32 by its table, worked out bit by bit; ranks and cuts by plain windows.
OP10 = f"""
WITH RECURSIVE crc(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS tab FROM crc WHERE k = 8),
b AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS stratum FROM documents),
c AS (SELECT doc_id, stratum, octet_length(encode(text)) + 16 AS size,
        xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
          lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1]), 4294967295)) AS text_crc32 FROM b, t),
s AS (SELECT *, {_hash("'0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32 || ':' || size")} AS drawn, {_hash("'0|' || stratum")} AS mixed FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY drawn, doc_id, text_crc32, size) - 1 AS rank,
        count(*) OVER (PARTITION BY stratum) AS n FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY (rank + mixed / 1152921504606846976.0::DOUBLE) / n::DOUBLE, mixed, stratum, drawn, doc_id, text_crc32, size) - 1 AS place,
        count(*) OVER () AS total FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * 40 // total)::INTEGER AS shard,
       place - ((place * 40 // total) * total + 39) // 40 AS slot, NULL::INTEGER AS grown_shard, stratum FROM o
"""


# Every document's score for every item, then the ten best.
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(len(w)) AS terms FROM d WHERE len(w) > 0),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
s AS (SELECT item_id, row, doc_id, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
        * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * docs) // terms::BIGINT)))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), total GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""

# Every string of 200 bytes as hex digits; the gaps between the spans of those met twice are put together again.
OP13 = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT row, k, md5(substr(h, (2 * k + 1)::BIGINT, 400)) AS s FROM (SELECT row, h, unnest(range(0, len(h) // 2 - 199)) AS k FROM d WHERE len(h) >= 400)),
hit AS (SELECT w.row, w.k FROM w JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) USING (s)),
edge AS (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY row ORDER BY k) + 200 THEN 0 ELSE 1 END AS opens FROM hit),
span AS (SELECT row, min(k) AS a, max(k) + 200 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY row ORDER BY k) AS island FROM edge) GROUP BY row, island),
gap AS (SELECT row, b AS a, coalesce(lead(a) OVER (PARTITION BY row ORDER BY a), len(h) // 2) AS b, h FROM span JOIN d USING (row)
  UNION ALL SELECT row, 0, coalesce(first, len(h) // 2), h FROM d LEFT JOIN (SELECT row, min(a) AS first FROM span GROUP BY row) USING (row)),
kept AS (SELECT row, sha256(unhex(string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a))) AS kept_sha256 FROM gap GROUP BY row),
total AS (SELECT row, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM span GROUP BY row)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d JOIN kept USING (row) LEFT JOIN total USING (row)
"""
