"""The same results in SQL, where SQL can state them over the whole tables."""

from __future__ import annotations

import unicodedata

from .glyphs import fold_character

P1_POOL = r"""
  WITH names AS (SELECT lower(trim(regexp_replace(top_name, '\s+', ' ', 'g'))) AS k, min(top_name) AS top FROM category_dim GROUP BY 1),
  codes AS (SELECT lower(trim(sub_code)) AS k, min(top_name) AS top FROM category_dim GROUP BY 1),
  pool AS (SELECT coalesce(n.top, c.top) AS top_name FROM papers p
    LEFT JOIN names n ON n.k = lower(trim(regexp_replace(p.top_category_name, '\s+', ' ', 'g')))
    LEFT JOIN codes c ON c.k = lower(trim(regexp_replace(p.primary_category, '\s+', ' ', 'g')))
    WHERE coalesce(n.top, c.top) IS NOT NULL),
  have AS (SELECT top_name, count(*) AS n FROM pool GROUP BY 1),
  size AS (SELECT count(*) // 4 AS m FROM pool)
"""

P3 = r"""
  WITH rows AS (SELECT record_id, CASE WHEN split = 'train' THEN 0 WHEN split IN ('val', 'test') THEN 1 END AS side, nullif(regexp_extract(lower(arxiv_id), '([0-9]+\.[0-9]+)(?:v[0-9]+)?[^0-9a-z]*$', 1), '') AS paper,
      list_distinct(regexp_extract_all(lower(abstract), '[a-z0-9]+')) AS words FROM papers),
  a AS (SELECT * FROM rows WHERE side = 0), b AS (SELECT * FROM rows WHERE side = 1),
  pairs AS (SELECT a.record_id AS x, b.record_id AS y FROM a JOIN b ON a.paper = b.paper
    UNION SELECT x, y FROM (SELECT a.record_id AS x, b.record_id AS y, len(a.words) AS n, len(b.words) AS m, len(list_intersect(a.words, b.words)) AS i FROM a JOIN b ON len(a.words) > 0 AND least(len(a.words), len(b.words)) >= 0.7 * greatest(len(a.words), len(b.words))) WHERE i >= 0.7 * (n + m - i))
  SELECT least(x, y) AS record_id_a, greatest(x, y) AS record_id_b FROM pairs
"""

P3_REPORT = f"""
  WITH found AS ({P3}),
  held AS (SELECT record_id, split, feed FROM papers WHERE split IN ('val', 'test')),
  n AS (SELECT record_id, count(*) AS pairs FROM held JOIN found ON record_id IN (record_id_a, record_id_b) GROUP BY 1)
  SELECT split, feed, count(*) AS rows, count(pairs) AS overlapping_rows, coalesce(sum(pairs), 0)::BIGINT AS pairs FROM held LEFT JOIN n USING (record_id) GROUP BY ALL
"""

P3_LINKS = r"""
  WITH rows AS (SELECT record_id, CASE WHEN split = 'train' THEN 0 WHEN split IN ('val', 'test') THEN 1 END AS side, nullif(regexp_extract(lower(arxiv_id), '([0-9]+\.[0-9]+)(?:v[0-9]+)?[^0-9a-z]*$', 1), '') AS paper,
      trim(regexp_replace(lower(abstract), '[^a-z0-9]+', ' ', 'g')) AS form, list_distinct(regexp_extract_all(lower(abstract), '[a-z0-9]+')) AS words FROM papers),
  a AS (SELECT * FROM rows WHERE side = 0), b AS (SELECT * FROM rows WHERE side = 1),
  t AS (SELECT y, count(*) AS text_links FROM (SELECT b.record_id AS y, len(a.words) AS n, len(b.words) AS m, len(list_intersect(a.words, b.words)) AS i FROM a JOIN b ON len(a.words) > 0 AND least(len(a.words), len(b.words)) >= 0.7 * greatest(len(a.words), len(b.words))) WHERE i >= 0.7 * (n + m - i) GROUP BY 1),
  p AS (SELECT b.record_id AS y, count(*) AS paper_links FROM a JOIN b ON a.paper = b.paper GROUP BY 1),
  c AS (SELECT form, min(record_id) AS class_id FROM b WHERE form IS NOT NULL GROUP BY 1)
  SELECT record_id, coalesce(class_id, record_id) AS class_id, coalesce(text_links, 0) AS text_links, coalesce(paper_links, 0) AS paper_links FROM b LEFT JOIN c USING (form) LEFT JOIN t ON t.y = record_id LEFT JOIN p ON p.y = record_id WHERE text_links IS NOT NULL OR paper_links IS NOT NULL
"""

P4 = """
  WITH v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM faiss_metadata WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  s AS (SELECT a.vec_id AS q, b.vec_id AS n, round(array_cosine_similarity(a.e, b.e), 9) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, n) AS k FROM s WHERE c >= 0.85)
  SELECT DISTINCT least(q, n) AS vec_id_a, greatest(q, n) AS vec_id_b FROM r WHERE k <= 5
"""

P5 = r"""
  WITH rows AS (SELECT row_id, regexp_replace(trim(arxiv_id), 'v[0-9]+$', '') AS paper, text FROM chunked_database WHERE length(text) >= 200 AND arxiv_id IS NOT NULL),
  grams AS (SELECT row_id, paper, md5_number(substr(text, i, 200)) AS g FROM (SELECT *, unnest(range(1, length(text) - 198)) AS i FROM rows)),
  shared AS (SELECT g FROM grams GROUP BY g HAVING min(paper) <> max(paper)),
  hits AS (SELECT DISTINCT row_id, paper, g FROM grams JOIN shared USING (g))
  SELECT DISTINCT a.row_id AS row_id_a, b.row_id AS row_id_b FROM hits a JOIN hits b USING (g) WHERE a.row_id < b.row_id AND a.paper <> b.paper
"""

P5_STARTS = r"""
  WITH rows AS (SELECT row_id, regexp_replace(trim(arxiv_id), 'v[0-9]+$', '') AS paper, text FROM chunked_database WHERE length(text) >= 200 AND arxiv_id IS NOT NULL),
  grams AS MATERIALIZED (SELECT row_id, paper, i, md5_number(substr(text, i, 200)) AS g FROM (SELECT *, unnest(range(1, length(text) - 198)) AS i FROM rows)),
  shared AS (SELECT g, min(row_id) AS least FROM grams GROUP BY g HAVING min(paper) <> max(paper)),
  starts AS MATERIALIZED (SELECT DISTINCT row_id, i, g, least FROM grams JOIN shared USING (g)),
  places AS (SELECT DISTINCT row_id, i FROM starts)
"""
P5_SPANS = P5_STARTS + """, marked AS (SELECT row_id, i, i - row_number() OVER (PARTITION BY row_id ORDER BY i) AS island FROM places)
  SELECT row_id, (min(i) - 1)::INT AS start, (max(i) - min(i) + 200)::INT AS length FROM marked GROUP BY row_id, island"""
P5_SHARES = P5_STARTS + """, gaps AS (SELECT row_id, lead(i) OVER (PARTITION BY row_id ORDER BY i) - i AS step FROM places),
  n AS (SELECT row_id, sum(least(200, coalesce(step, 200)))::BIGINT AS shared_chars FROM gaps GROUP BY 1)
  SELECT row_id, coalesce(length(text), 0) AS n_chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0) / length(text) ELSE 0 END AS share FROM chunked_database LEFT JOIN n USING (row_id)"""
P5_CLUSTERS = P5_STARTS.replace("WITH rows", "WITH RECURSIVE rows") + """, links AS MATERIALIZED (SELECT DISTINCT row_id AS a, least AS b FROM starts WHERE row_id <> least),
  both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT a AS row_id, a AS other FROM both_ways UNION SELECT r.row_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
  SELECT row_id, min(other) AS cluster_id, row_id = min(other) AS kept FROM reach GROUP BY row_id"""

P5_NEAR = r"""
  WITH RECURSIVE named AS (SELECT row_id, lower(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'))) AS t FROM chunked_database WHERE text IS NOT NULL),
  texts AS MATERIALIZED (SELECT t, min(row_id) AS low, string_split(t, ' ') AS w FROM named WHERE t <> '' GROUP BY t),
  runs AS MATERIALIZED (SELECT DISTINCT low, unnest(CASE WHEN len(w) < 5 THEN [t] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS r FROM texts),
  n AS (SELECT low, count(*) AS n FROM runs GROUP BY 1),
  meet AS (SELECT a.low AS a, b.low AS b, count(*) AS c FROM runs a JOIN runs b ON a.r = b.r AND a.low < b.low GROUP BY ALL),
  links AS MATERIALIZED (SELECT a, b FROM meet JOIN n x ON x.low = a JOIN n y ON y.low = b WHERE c >= 0.8 * (x.n + y.n - c)),
  ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT low, low AS other FROM texts UNION SELECT r.low, e.b FROM reach r JOIN ways e ON e.a = r.other),
  clusters AS (SELECT low, min(other) AS cluster_id FROM reach GROUP BY 1),
  m AS (SELECT a AS low, count(*) AS links FROM ways GROUP BY 1)
  SELECT row_id, cluster_id, coalesce(links, 0) AS links FROM named JOIN texts USING (t) JOIN clusters USING (low) LEFT JOIN m USING (low)
"""

P8 = r"""
  WITH t AS (SELECT source, sum(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')))::DOUBLE AS n FROM documents WHERE source IN (SELECT source FROM source_targets) GROUP BY 1)
  SELECT s.source FROM source_targets s LEFT JOIN t USING (source) WHERE s.max_repeats * coalesce(t.n, 0) < s.target_share * (SELECT sum(n) FROM t)
"""


def p6_forms() -> str:
    """Texts folded by one table, without tries: a table f (row_id, text, form)."""
    single, several, gone = {}, {}, []
    for code in range(0x80, 0x20000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or unicodedata.category(c) == "Cn":
            continue
        into = fold_character(code)
        if into == c:
            continue
        if not into:
            gone.append(code)
        elif len(into) == 1:
            single[c] = into
        else:
            several[c] = into
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    x = f"regexp_replace(text, '[{''.join(f'\\x{{{c:x}}}' for c in gone)}]', '', 'g')"
    for c, into in several.items():
        x = f"replace({x}, {lit(c)}, {lit(into)})"
    x = f"nfc_normalize(translate({x}, {lit(''.join(single))}, {lit(''.join(single.values()))}))"
    x = rf"trim(regexp_replace({x}, '[\s\x0b\x1c-\x1f]+', ' ', 'g'))"
    return f"WITH f AS (SELECT row_id, text, {x} AS form FROM chunked_database WHERE text IS NOT NULL)"


def p6() -> str:
    """Pairs that read the same."""
    return p6_forms() + " SELECT DISTINCT a.row_id AS row_id_a, b.row_id AS row_id_b FROM f a JOIN f b USING (form) WHERE form <> '' AND a.row_id < b.row_id AND a.text <> b.text"


P6_CLASSES = " , c AS (SELECT form, min(row_id) AS class_id, count(DISTINCT text) AS spellings, count(*) AS rows FROM f WHERE form <> '' GROUP BY 1) SELECT row_id, class_id, spellings, rows FROM f JOIN c USING (form)"
P6_TEXTS = " SELECT row_id, form AS canonical_text FROM f UNION ALL SELECT row_id, NULL FROM chunked_database WHERE text IS NULL"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_POOL + "SELECT t.top_name FROM category_targets t CROSS JOIN size LEFT JOIN have h USING (top_name) WHERE coalesce(h.n, 0) < greatest(t.min_rows, t.target_share * size.m)",
        "p1_size": P1_POOL + """, known AS (SELECT greatest(least(any_value(m), coalesce(sum(n), 0)), coalesce(sum(least(min_rows, n)), 0))::BIGINT AS k FROM category_targets JOIN have USING (top_name), size)
          SELECT k AS sampled, k AS different, 0 AS strangers FROM known""",
        "p2_rejoined": "SELECT row_id, md5(text) AS digest, true AS fits, true AS overlaps FROM chunked_database WHERE length(text) > 1200",
        "p2_found": "SELECT row_id FROM chunked_database WHERE length(text) > 1200",
        "p3_found": P3,
        "p3_links": P3_LINKS,
        "p3_report": P3_REPORT,
        "p4_counts": "WITH v AS (SELECT vec_id FROM faiss_metadata WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) SELECT vec_id, least(5, (SELECT count(*) FROM v) - 1) AS neighbours, least(5, (SELECT count(*) FROM v) - 1) AS different, 0 AS own FROM v",
        "p4_found": P4,
        "p5_found": P5,
        "p5_spans": P5_SPANS,
        "p5_shares": P5_SHARES,
        "p5_clusters": P5_CLUSTERS,
        "p5_near": P5_NEAR,
        "p6_found": p6(),
        "p6_classes": p6_forms() + P6_CLASSES,
        "p6_texts": p6_forms() + P6_TEXTS,
        "p8_found": P8,
    }
