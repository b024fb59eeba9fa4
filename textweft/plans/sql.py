"""The catalogue's queries in SQL for a single-node engine, over the same whole tables."""

from __future__ import annotations

from ..functions import text as tx
from . import literals

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, into: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(into)}, '{flags}')"


def collapse(x: str) -> str:
    return f"trim({sub(x, SPACE, ' ')})"


def normalise(x: str) -> str:
    for name in tx.GREEK_NAMES:
        x = sub(x, rf"\\{name}\b", name.upper())
    for name, letter in zip(tx.GREEK_NAMES, tx.GREEK_LETTERS, strict=True):
        x = f"replace({x}, {q(letter)}, {q(name.upper())})"
    x = sub(x, r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"FRAC(\1,\2)")
    x = sub(x, r"\\sqrt\{([^{}]*)\}", r"SQRT(\1)")
    x = sub(x, r"\^\{([^{}]*)\}", r"^(\1)")
    x = sub(x, r"_\{([^{}]*)\}", r"_(\1)")
    for group in tx.NAMED_OPERATORS:
        x = sub(x, rf"\\({'|'.join(group)})\b", r"\1")
    for name, word in tx.SYMBOLS.items():
        x = sub(x, rf"\\{name}\b", word.upper())
    for plain, dotted in tx.UMLAUTS.items():
        x = f"replace({x}, {q(chr(92) + chr(34) + plain)}, {q(dotted)})"
    x = sub(x, r"\\[a-zA-Z]+\*?[\s\x0b\x1c-\x1f\x85\p{Z}]*", " ")
    x = sub(x, r"[{}\[\]$]", " ")
    return collapse(f"lower({x})")


def strip_structure(x: str) -> str:
    x = sub(x, r"%[^\n]*", " ")
    x = sub(x, r"^.*?\\begin\{document\}", "", "s")
    x = sub(x, r"\\begin\{thebibliography\}.*$", "", "si")
    for name in tx.UNWRAPPED:
        x = sub(x, rf"\\{name}\*?\{{([^{{}}]*)\}}", r"\1")
    return sub(x, r"\\(begin|end)\{[^}]*\}", " ")


def cut_references(x: str) -> str:
    head = f"regexp_extract({x}, '^(.*?)\\b(?:References|Bibliography)\\b', 1, 'si')"
    return f"CASE WHEN regexp_matches({x}, '\\b(?:References|Bibliography)\\b', 'i') AND length({head}) > length({x}) * 0.75 THEN {head} ELSE {x} END"


def chunked(name: str, key: str, out: str) -> str:
    """A common table expression ``out`` (doc, chunk_id, chunk_text, n_words)."""
    return f"""{out}_n AS MATERIALIZED (SELECT {key} AS doc, {normalise('text')} AS norm FROM {name} WHERE text IS NOT NULL),
  {out}_w AS (SELECT doc, CASE WHEN norm = '' THEN []::VARCHAR[] ELSE string_split(norm, ' ') END AS w FROM {out}_n),
  {out}_s AS (SELECT doc, w, unnest(range(0, len(w), 70)) AS s FROM {out}_w),
  {out} AS MATERIALIZED (SELECT doc, (s // 70)::INT AS chunk_id, array_to_string(w[s + 1:s + 100], ' ') AS chunk_text, len(w[s + 1:s + 100])::INT AS n_words FROM {out}_s WHERE len(w[s + 1:s + 100]) >= 20)"""


def term_counts(name: str) -> str:
    return f"""{name}_t AS MATERIALIZED (SELECT doc, chunk_id, t, count(*) AS f FROM (SELECT doc, chunk_id, unnest(string_split(chunk_text, ' ')) AS t FROM {name}) GROUP BY ALL),
  {name}_l AS MATERIALIZED (SELECT doc, chunk_id, sum(f * f)::BIGINT AS n FROM {name}_t GROUP BY ALL)"""


def matches(where: str = "", least: float = 0.5, left: str = "eval_items", key: str = "item_id") -> str:
    """Common table expressions up to ``m``: the ranked matches at or above the threshold."""
    return f"""WITH {chunked(left, key, 'q')},
  {chunked('documents', 'doc_id', 'c')},
  {term_counts('c')},
  q1 AS (SELECT * FROM q {where}), {term_counts('q1')},
  dots AS (SELECT a.doc AS q_doc, a.chunk_id AS q_chunk, b.doc, b.chunk_id AS chunk, sum(a.f * b.f)::BIGINT AS dot FROM q1_t a JOIN c_t b USING (t) GROUP BY ALL),
  sims AS (SELECT d.*, dot::DOUBLE / sqrt(x.n::DOUBLE * y.n::DOUBLE) AS cosine FROM dots d JOIN q1_l x ON x.doc = q_doc AND x.chunk_id = q_chunk JOIN c_l y ON y.doc = d.doc AND y.chunk_id = d.chunk),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY q_doc, q_chunk ORDER BY cosine DESC, doc, chunk) AS rank FROM sims WHERE cosine >= {least}),
  m AS MATERIALIZED (SELECT q_doc, q_chunk, doc, chunk, rank, greatest(0, least(1, cosine)) AS cosine, round(greatest(0, least(1, cosine)), 4) AS score, round(greatest(0, least(1, cosine)) * 100, 2) AS match_percentage FROM ranked WHERE rank <= 5)"""




def grams(x: str) -> str:
    w = f"string_split({x}, ' ')"
    return f"list_distinct(list_transform(range(1, len({w}) - 4), lambda i: array_to_string(({w})[i:i + 5], ' ')))"


TEXTS = "JOIN q ON q.doc = m.q_doc AND q.chunk_id = m.q_chunk JOIN c ON c.doc = m.doc AND c.chunk_id = m.chunk"
SCORES = """size AS (SELECT doc AS q_doc, sum(n_words)::BIGINT AS total_words, count(*) AS total_chunks FROM q GROUP BY 1),
  flags AS (SELECT q_doc, q_chunk, max(cosine) AS best FROM m GROUP BY ALL),
  weight AS (SELECT q_doc, sum(best * n_words) AS w, count(*) AS flagged FROM flags JOIN q ON q.doc = q_doc AND q.chunk_id = q_chunk GROUP BY 1),
  sources AS (SELECT q_doc, count(DISTINCT doc) AS suspicious FROM m GROUP BY 1),
  scores AS (SELECT q_doc, total_words, total_chunks, coalesce(flagged, 0) AS total_flagged_chunks, coalesce(suspicious, 0) AS total_suspicious_sources, round(coalesce(w / total_words * 100, 0), 2) AS global_score FROM size LEFT JOIN weight USING (q_doc) LEFT JOIN sources USING (q_doc))"""
RANKED = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY q_doc, doc ORDER BY score DESC, q_chunk, rank) AS place FROM m),
  top AS (SELECT p.*, len(list_intersect({grams('q.chunk_text')}, {grams('c.chunk_text')})) > 0 AS exact FROM placed p JOIN q ON q.doc = p.q_doc AND q.chunk_id = p.q_chunk JOIN c ON c.doc = p.doc AND c.chunk_id = p.chunk WHERE place <= 5),
  src AS (SELECT q_doc, doc, count(*) AS match_count, floor((sum(round(match_percentage * 100)::BIGINT) * 2 + count(*)) / (count(*) * 2)) / 100 AS average_similarity, bool_or(exact) AS has_exact FROM top GROUP BY ALL),
  first AS (SELECT q_doc, doc, min(q_chunk * 100000 + rank) AS f FROM m GROUP BY ALL),
  preferred AS (SELECT * FROM (SELECT *, bool_or(has_exact) OVER (PARTITION BY q_doc) AS a FROM src) WHERE has_exact OR NOT a),
  final AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY q_doc ORDER BY match_count DESC, f) AS position FROM preferred p JOIN first USING (q_doc, doc)) WHERE position <= 10)"""


def knn(table: str, queries: str, extra: str = "") -> str:
    return f"""WITH good AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM {table}
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
  v AS (SELECT * FROM good WHERE n > 0),
  s AS (SELECT a.vec_id, b.vec_id AS neighbour, least(1, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.n * b.n)) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE {queries}),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, neighbour) AS rank FROM s {extra})"""


def hashed(name: str) -> str:
    """Counts of the chunks ``name`` by hashed column, and their squared norms."""
    return f"""{name}_h AS MATERIALIZED (SELECT doc, chunk_id, b, count(*) AS f FROM (SELECT doc, chunk_id, ('0x' || substr(md5(unnest(string_split(chunk_text, ' '))), 1, 4))::INT % 256 AS b FROM {name}) GROUP BY ALL),
  {name}_l AS MATERIALIZED (SELECT doc, chunk_id, sum(f * f)::BIGINT AS n, sum(f)::BIGINT AS terms FROM {name}_h GROUP BY ALL)"""


def file_matches() -> str:
    """Like :func:`matches`, for items as files against the index of hashed counts."""
    strip = strip_structure("text")
    return f"""WITH raw AS (SELECT '/in/item-' || item_id || CASE WHEN item_id % 3 = 0 THEN '.tex' ELSE '.txt' END AS path, CASE WHEN item_id % 3 = 0 AND trim({strip}) <> '' THEN {strip} ELSE {collapse('text')} END AS text FROM eval_items),
  {chunked('raw', 'path', 'q')},
  docs AS (SELECT doc_id::VARCHAR AS doc, text FROM documents),
  {chunked('docs', 'doc', 'c')},
  {hashed('q')}, {hashed('c')},
  dots AS (SELECT a.doc AS q_doc, a.chunk_id AS q_chunk, b.doc, b.chunk_id AS chunk, sum(a.f * b.f)::BIGINT AS dot FROM q_h a JOIN c_h b USING (b) GROUP BY ALL),
  sims AS (SELECT d.*, round(dot::DOUBLE / sqrt(x.n::DOUBLE * y.n::DOUBLE), 12) AS cosine FROM dots d JOIN q_l x ON x.doc = q_doc AND x.chunk_id = q_chunk JOIN c_l y ON y.doc = d.doc AND y.chunk_id = d.chunk),
  m AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_doc, q_chunk ORDER BY cosine DESC, doc, chunk) AS rank FROM sims) WHERE rank <= 5 AND cosine >= 0.85)"""


def paper_chunks() -> str:
    strip, pdf = strip_structure("text"), collapse(sub("text", r"[\x00-\x1F\x7F-\x{9F}]", " "))
    return f"""WITH read AS (SELECT doc_id, {strip} AS latex, {pdf} AS page FROM documents WHERE text IS NOT NULL),
  best AS (SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN {cut_references('page')} WHEN {collapse('latex')} <> '' AND len(string_split({collapse('latex')}, ' ')) >= 20 THEN latex END AS text FROM read),
  {chunked('best', 'doc_id', 'c')},
  rows AS (SELECT doc::VARCHAR AS arxiv_id, chunk_id, chunk_text AS text, CASE WHEN doc % 3 = 2 THEN 'pdf' ELSE 'latex' END AS source_type FROM c)"""


KEY = "md5(record_id || '|42')"
PAPER_KEY = "md5(arxiv_id || '|42')"
LABELLED = "labelled AS (SELECT record_id, trim(top_category_name) AS label FROM papers WHERE trim(top_category_name) <> '')"
SPLIT = f"""WITH {LABELLED}, placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr({KEY}, 1, 2))::INT % 256, {KEY}, record_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM labelled),
  split AS (SELECT record_id, label, CASE WHEN i <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM placed)"""
PROFILES = """profiles AS (SELECT google_id, email FROM users WHERE id % 3 = 1 AND google_id IS NOT NULL
    UNION ALL SELECT 'n-' || id, upper(email) FROM users WHERE id % 3 = 2 UNION ALL SELECT 'm-' || id, 'new.' || trim(email) FROM users WHERE id % 3 = 0),
  by_id AS (SELECT google_id, min(id) AS a FROM users WHERE google_id IS NOT NULL GROUP BY 1),
  by_mail AS (SELECT lower(trim(email)) AS mail, min(id) AS b FROM users WHERE NOT is_deleted AND email IS NOT NULL GROUP BY 1),
  plan AS (SELECT p.google_id, p.email, coalesce(a, b) AS user_id, CASE WHEN a IS NOT NULL THEN 'known' WHEN b IS NOT NULL THEN 'linked' ELSE 'created' END AS action
    FROM profiles p LEFT JOIN by_id USING (google_id) LEFT JOIN by_mail ON mail = lower(trim(p.email)))"""


def statements() -> dict[str, str]:
    latex = literals.values([(k, t) for k, t in literals.LATEX], "k, raw")
    structure = literals.values(literals.STRUCTURE, "k, raw")
    clean = collapse(sub("raw", r"[\x00-\x1F\x7F-\x{9F}]", " "))
    layout = literals.values(literals.LAYOUT, "k, raw")
    words = lambda c: f"len(string_split({collapse(c)}, ' '))"
    ok = lambda c, n: f"CASE WHEN {collapse(c)} <> '' AND {words(c)} >= {n} THEN {c} END"
    return {
        "norm_text": f"SELECT doc_id, {normalise('text')} AS norm FROM documents",
        "norm_latex_literals": f"SELECT k, {normalise('raw')} AS norm FROM {latex}",
        "strip_latex_literals": f"SELECT k, {strip_structure('raw')} AS stripped FROM {structure}",
        "strip_latex_documents": f"SELECT doc_id, {strip_structure('text')} AS stripped FROM documents",
        "pdf_clean_refcut": f"WITH rows AS (SELECT k::BIGINT AS k, raw FROM {layout} UNION ALL SELECT doc_id, text FROM documents), cleaned AS (SELECT k, {clean} AS x FROM rows) SELECT k, {cut_references('x')} AS clean FROM cleaned",
        "source_priority_coalesce": f"SELECT k, coalesce({ok('latex', 4)}, {ok('pdf', 1)}, {ok('plain', 1)}) AS chosen FROM {literals.values(literals.PRIORITY, 'k, latex, pdf, plain')}",
        "tokenize": f"WITH t AS (SELECT row_id, {collapse('text')} AS x FROM chunked_database WHERE text IS NOT NULL), w AS (SELECT row_id, CASE WHEN x = '' THEN []::VARCHAR[] ELSE string_split(x, ' ') END AS w FROM t) SELECT row_id, len(w)::BIGINT AS n_words, coalesce(w[1], '') AS first_word, coalesce(w[-1], '') AS last_word FROM w",
        "last_segment": r"SELECT id, regexp_extract(file_path, '[^/]*$') AS segment, lower(regexp_extract(file_path, '\.[^./]+$')) AS suffix FROM uploads",
        "chunk_documents": f"WITH {chunked('documents', 'doc_id', 'c')} SELECT doc AS doc_id, chunk_id, chunk_text, n_words FROM c",
        "chunk_stats": f"WITH {chunked('documents', 'doc_id', 'c')}, d AS (SELECT doc, count(*) AS n, sum(n_words) AS w FROM c GROUP BY 1) SELECT coalesce(source, 'unknown') AS source, count(*) AS papers, sum(n)::BIGINT AS chunks, sum(w)::BIGINT AS words FROM documents JOIN d ON d.doc = doc_id GROUP BY 1",
        "extraction_counts": "SELECT coalesce(source_type, 'unknown') AS source_type, count(*) AS chunks, count(DISTINCT arxiv_id) AS papers FROM chunked_database GROUP BY 1",
        "knn_embeddings_topk": knn("embeddings", "true") + " SELECT vec_id, neighbour, round(cosine, 4) AS cosine, rank FROM r WHERE rank <= 5",
        "knn_index_topk": knn("faiss_metadata", "a.vec_id % 50 = 0") + " SELECT r.vec_id, neighbour, round(greatest(0, least(1, cosine)), 4) AS cosine, rank, f.arxiv_id, f.chunk_id FROM r JOIN faiss_metadata f ON f.vec_id = neighbour WHERE rank <= 5",
        "knn_threshold": knn("embeddings", "true", "WHERE cosine >= 0.4") + " SELECT vec_id, count(*) AS near, round(max(cosine), 4) AS best FROM r WHERE rank <= 5 GROUP BY 1",
        "l2_normalize": "SELECT vec_id, len(embedding)::BIGINT AS width, round(n, 4) AS norm, CASE WHEN n > 0 THEN round(embedding[1]::DOUBLE / n, 4) END AS first FROM (SELECT *, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM faiss_metadata WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0)",
        "sparse_cosine_topk": matches() + " SELECT q_doc AS item_id, q_chunk, doc AS doc_id, chunk, score, match_percentage, rank FROM m",
        "near_duplicates_self": matches("WHERE doc % 50 = 0", 0.8, "documents", "doc_id") + " SELECT q_doc AS doc_id, q_chunk, doc AS other_doc, chunk, score FROM m",
        "near_duplicates_all": matches("WHERE doc % 50 = 0", 0.8, "documents", "doc_id") + " SELECT q_doc AS doc_id, q_chunk, doc AS other_doc, chunk, round(greatest(0, least(1, cosine)), 4) AS score FROM ranked WHERE NOT (q_doc = doc AND q_chunk = chunk)",
        "flagged_chunks": matches() + " SELECT q_doc AS item_id, q_chunk, round(max(cosine), 4) AS best FROM m GROUP BY ALL",
        "global_score": matches() + f", {SCORES} SELECT q_doc AS item_id, * EXCLUDE (q_doc) FROM scores",
        "shared_word_6grams": matches() + f" SELECT q_doc AS item_id, q_chunk, m.doc AS doc_id, chunk, len(list_intersect({grams('q.chunk_text')}, {grams('c.chunk_text')}))::BIGINT AS shared FROM m {TEXTS}",
        "rank_sources": matches() + f", {RANKED} SELECT q_doc AS item_id, doc AS doc_id, match_count, average_similarity, has_exact, position FROM final",
        "analyze_report": matches() + f", {SCORES}, {RANKED}, n AS (SELECT q_doc, count(*) AS reported FROM final GROUP BY 1) SELECT q_doc AS item_id, total_words, total_chunks, global_score, total_suspicious_sources, coalesce(reported, 0) AS total_reported_sources, total_flagged_chunks FROM scores LEFT JOIN n USING (q_doc)",
        "hierarchy_flatten": """SELECT * FROM (VALUES ('zz.A','zz','Zed Studies','Alpha'), ('yy.B','yy','Why Studies','Beta two'), ('yy','yy','Why Studies','Why itself'), ('zz','zz','Zed Studies','Zed Studies'), ('solo','solo','Solo','Solo'), ('bare','bare','bare','bare')) AS v(sub_code, top_code, top_name, sub_name)
            UNION ALL SELECT sub_code, top_code, top_name, sub_name FROM category_dim""",
        "label_map_fallback": """WITH tried AS (SELECT record_id, list_concat([primary_category], coalesce(all_categories, [])) AS l FROM papers), o AS (SELECT record_id, unnest(l) AS sub_code, generate_subscripts(l, 1) AS i FROM tried),
            hit AS (SELECT record_id, top_code, top_name, sub_name, row_number() OVER (PARTITION BY record_id ORDER BY i) AS r FROM o JOIN category_dim USING (sub_code)) SELECT record_id, top_code, top_name, sub_name FROM hit WHERE r = 1""",
        "source_predicate": "SELECT record_id, arxiv_id FROM papers WHERE list_contains(all_categories, 'cmp.DB')",
        "dedupe_first_wins": "SELECT arxiv_id, record_id, feed FROM (SELECT trim(arxiv_id) AS arxiv_id, record_id, feed, row_number() OVER (PARTITION BY trim(arxiv_id) ORDER BY feed NULLS FIRST, ingested_at NULLS FIRST, record_id) AS r FROM papers WHERE trim(arxiv_id) <> '') WHERE r = 1",
        "balance_classes": f"WITH {LABELLED} SELECT record_id, label FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY {KEY}, record_id) AS r FROM labelled) WHERE n >= 30 AND r <= 100",
        "stratified_split": SPLIT + " SELECT * FROM split",
        "split_sizes": SPLIT + " SELECT label, split, count(*) AS n FROM split GROUP BY ALL",
        "per_category_quota": "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 50",
        "newest_papers_by_category": "SELECT category, record_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY published DESC NULLS LAST, record_id) AS r FROM (SELECT record_id, published, unnest(list_distinct(all_categories)) AS category FROM papers) WHERE category IS NOT NULL) WHERE r <= 20",
        "jsonl_roundtrip": "SELECT doc_id, md5(coalesce(text, '<null>')) AS digest, lang, source FROM documents",
        "json_fields": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
        "atom_parse": "SELECT * FROM (VALUES ('2101.00001v2', 'A title', 'Some text', 'cs.LG', 'cs.LG,stat.ML'), ('9901001v1', 'B', '', '', 'hep-th')) AS v(arxiv_id, title, abstract, primary_category, categories)",
        "largest_member": f"SELECT archive, member FROM (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY size DESC, place) AS r FROM {literals.values(literals.MEMBERS, 'archive, member, size, place')} WHERE suffix(member, '.tex')) WHERE r = 1",
        "chunk_lines": "SELECT coalesce(source_type, 'unknown') AS source_type, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM chunked_database WHERE text IS NOT NULL AND arxiv_id IS NOT NULL AND title IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1",
        "chunk_texts": "SELECT md5(text) AS digest, count(*) AS n FROM chunked_database WHERE text IS NOT NULL GROUP BY 1",
        "paged_scan": "SELECT 'a' AS category, unnest(range(7))::INT AS i UNION ALL SELECT 'd', unnest(range(10))::INT",
        "source_urls": "SELECT record_id, 'https://papers.example/source/' || trim(arxiv_id) AS url, replace(url_encode(title), '%20', '+') AS quoted FROM papers",
        "schema_upgrade": "SELECT id, first_name, last_name, email, hashed_password, NULL::VARCHAR AS google_id, created_at, is_deleted, deleted_at FROM users",
        "user_insert": """WITH new AS (SELECT DISTINCT CASE WHEN id % 2 = 0 THEN 'reg.' || trim(email) ELSE email END AS email FROM users), fresh AS (SELECT email FROM new WHERE email IS NOT NULL AND email NOT IN (SELECT email FROM users WHERE email IS NOT NULL))
            SELECT id, email, is_deleted FROM users UNION ALL SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY email), email, false FROM fresh""",
        "upload_insert": "SELECT id, user_id, filename, file_path, status, added_to_corpus FROM uploads UNION ALL SELECT (SELECT max(id) FROM uploads) + row_number() OVER (ORDER BY user_id NULLS FIRST, filename NULLS FIRST), user_id, 'again-' || filename, 'uploads/again-' || filename, 'PENDING', false FROM uploads",
        "upload_files": "SELECT filename, max(id) AS upload_id, arg_max(md5(concat_ws('|', id, file_path)), id) AS content FROM uploads WHERE filename IS NOT NULL GROUP BY 1",
        "report_insert": """WITH fresh AS (SELECT id + 5 AS document_id FROM uploads WHERE id + 5 IN (SELECT id FROM uploads) AND id + 5 NOT IN (SELECT document_id FROM plagiarism_reports WHERE document_id IS NOT NULL))
            SELECT id, document_id, global_score FROM plagiarism_reports UNION ALL SELECT (SELECT max(id) FROM plagiarism_reports) + row_number() OVER (ORDER BY document_id), document_id, 0.5 FROM fresh""",
        "report_expiry": "SELECT id, created_at + INTERVAL 30 MINUTE AS expires_at FROM plagiarism_reports",
        "input_valid": "SELECT id, coalesce(trim(first_name), '') <> '' AS named, coalesce(length(hashed_password) >= 8, false) AS password, coalesce(first_name, last_name, '') AS shown FROM users",
        "corpus_build": f"""WITH named AS (SELECT trim(arxiv_id) AS arxiv_id, record_id, primary_category, all_categories FROM papers WHERE trim(arxiv_id) <> ''),
            once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY primary_category NULLS FIRST, record_id) AS r FROM named) WHERE r = 1),
            o AS (SELECT arxiv_id, unnest(list_concat([primary_category], coalesce(all_categories, []))) AS sub_code, generate_subscripts(list_concat([primary_category], coalesce(all_categories, [])), 1) AS i FROM once),
            hit AS (SELECT * FROM (SELECT arxiv_id, top_name, sub_name, row_number() OVER (PARTITION BY arxiv_id ORDER BY i) AS r FROM o JOIN category_dim USING (sub_code)) WHERE r = 1),
            kept AS (SELECT * FROM (SELECT arxiv_id, top_name, sub_name, count(*) OVER (PARTITION BY top_name) AS n, row_number() OVER (PARTITION BY top_name ORDER BY {PAPER_KEY}, arxiv_id) AS i FROM hit) WHERE n >= 30 AND i <= 100),
            sized AS (SELECT *, least(n, 100) AS m FROM kept)
            SELECT arxiv_id, record_id, top_name, sub_name, CASE WHEN i <= floor(m * 0.8::DOUBLE) THEN 'train' WHEN i <= floor(m * 0.8::DOUBLE) + floor(m * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM sized JOIN once USING (arxiv_id)""",
        "paper_chunks": paper_chunks() + " SELECT * FROM rows",
        "paper_chunk_counts": paper_chunks() + " SELECT source_type, count(*) AS chunks, count(DISTINCT arxiv_id) AS papers FROM rows GROUP BY 1",
        "index_build": f"WITH docs AS (SELECT doc_id::VARCHAR AS doc, coalesce(source, 'unknown') AS source_type, text FROM documents), {chunked('docs', 'doc', 'c')}, {hashed('c')} SELECT row_number() OVER (ORDER BY c_l.doc, chunk_id) - 1 AS vec_id, c_l.doc AS arxiv_id, chunk_id, source_type, terms, n AS squares, 256 AS width FROM c_l JOIN docs USING (doc)",
        "analyze_file": file_matches() + f", {SCORES} SELECT path, CASE WHEN total_words IS NOT NULL THEN regexp_extract(path, '[^/]*$') END AS file_name, total_words IS NULL AS failed, total_words, total_chunks, global_score, total_suspicious_sources, total_flagged_chunks FROM raw LEFT JOIN scores ON q_doc = path",
        "chunk_vectors": "WITH t AS (SELECT arxiv_id, chunk_id, arg_min(coalesce(text, chr(0)), row_id) AS x FROM chunked_database WHERE arxiv_id IS NOT NULL GROUP BY ALL) SELECT vec_id, arxiv_id, chunk_id, length(CASE WHEN x IS NULL OR x = chr(0) THEN 'Text not available.' ELSE x END) AS n_chars FROM faiss_metadata LEFT JOIN t USING (arxiv_id, chunk_id)",
        "user_lookup": "SELECT id, first_name, last_name, email, created_at FROM users WHERE id = 7 AND NOT is_deleted LIMIT 1",
        "user_by_email": "SELECT lower(trim(email)) AS mail, min(id) AS user_id, count(*) AS accounts FROM users WHERE NOT is_deleted GROUP BY 1",
        "doc_with_report": "SELECT u.id, u.user_id, u.filename, u.status, r.id AS report_id, r.global_score FROM uploads u LEFT JOIN plagiarism_reports r ON r.document_id = u.id WHERE NOT u.is_deleted",
        "user_documents": "SELECT user_id, count(*) AS uploads, sum(word_count)::BIGINT AS words, max(uploaded_at) AS last_upload FROM uploads d JOIN users u ON u.id = user_id WHERE NOT d.is_deleted AND NOT u.is_deleted GROUP BY 1",
        "report_of_document": "SELECT id, document_id, global_score, ai_model_used FROM plagiarism_reports WHERE document_id = 2 LIMIT 1",
        "report_insert_valid": "SELECT id + 5 AS document_id, id, 0.0::DOUBLE AS global_score FROM uploads WHERE id + 5 IN (SELECT id FROM uploads) AND id + 5 NOT IN (SELECT document_id FROM plagiarism_reports WHERE document_id IS NOT NULL)",
        "report_fields": "SELECT id, json_extract(report_data, '$.document_stats.total_words')::BIGINT AS total_words, json_extract(report_data, '$.total_flagged_chunks')::BIGINT AS flagged, coalesce(json_array_length(report_data, '$.sources'), 0)::BIGINT AS sources, json_extract_string(report_data, '$.error') AS error FROM plagiarism_reports",
        "account_merge": f"WITH {PROFILES} SELECT google_id, user_id, action FROM plan",
        "accounts_after_merge": f"""WITH {PROFILES}, linked AS (SELECT user_id, min(google_id) AS g FROM plan WHERE action = 'linked' GROUP BY 1), made AS (SELECT DISTINCT google_id, email FROM plan WHERE action = 'created')
            SELECT id, email, coalesce(g, google_id) AS google_id, is_deleted FROM users LEFT JOIN linked ON user_id = id
            UNION ALL SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY google_id), email, google_id, false FROM made""",
        "initials": "SELECT id, CASE WHEN trim(first_name) <> '' AND trim(last_name) <> '' THEN upper(left(trim(first_name), 1)) || upper(left(trim(last_name), 1)) WHEN trim(first_name) <> '' THEN upper(left(trim(first_name), 1)) WHEN trim(email) <> '' THEN upper(left(trim(email), 1)) ELSE '?' END AS initials FROM users",
        "email_valid": r"SELECT id, coalesce(regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$'), false) AS valid FROM users",
        "email_norm": "SELECT id, lower(trim(email)) AS email FROM users",
        "status_counts": "SELECT status, is_deleted, count(*) AS n FROM uploads GROUP BY ALL",
        "classification_report": f"""WITH p AS (SELECT {collapse('top_category_name')} AS l0, split_part(trim(primary_category), '.', 1) AS c FROM papers),
            pairs AS (SELECT array_to_string(list_transform(string_split(lower(l0), ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') AS label, d.top_name AS prediction FROM p JOIN category_dim d ON d.sub_code = d.top_code AND d.top_code = c WHERE l0 <> ''),
            classes AS (SELECT label AS class FROM pairs UNION SELECT prediction FROM pairs),
            n AS (SELECT class, (SELECT count(*) FROM pairs WHERE label = class) AS support, (SELECT count(*) FROM pairs WHERE prediction = class) AS said, (SELECT count(*) FROM pairs WHERE label = class AND prediction = class) AS hit FROM classes),
            r AS (SELECT class, support, hit, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM n),
            f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)
            SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM f
            UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 4), round(sum(hit) / sum(support), 4), round(sum(hit) / sum(support), 4), sum(support)::BIGINT FROM f
            UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support)::BIGINT FROM f
            UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4), sum(support)::BIGINT FROM f""",
        "label_list": "SELECT row_number() OVER (ORDER BY label) - 1 AS position, label FROM (SELECT DISTINCT top_category_name AS label FROM papers WHERE top_category_name IS NOT NULL)",
        "train_text": "SELECT record_id, trim(trim(coalesce(title, '')) || '. ' || trim(coalesce(abstract, ''))) AS text, trim(top_category_name) AS label FROM papers WHERE trim(top_category_name) <> ''",
        "stream_filedrop": f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN {normalise('text')} = '' THEN 0 ELSE len(string_split({normalise('text')}, ' ')) END::INT AS n_words FROM documents",
    }
