"""DuckDB SQL for the registered queries, written independently of the Spark code."""

from __future__ import annotations

from checks.tables import EDGE_ANSWERS

TWINS: dict[str, str] = {}

_WS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
       "        　")


def strip(x: str) -> str:
    return f"trim({x}, '{_WS}')"


def words(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), "
            f"lambda w: w <> '')")


def words4(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: regexp_full_match(w, '[a-z0-9]{{4,}}'))"


# ---- sources, change detection, index maintenance

_CORPUS = """
corpus AS (SELECT '/corpus/' || doc_id || '.pdf' AS source, text AS content, doc_id AS seq,
                  md5(text) AS file_hash FROM documents),
stored AS (SELECT '/corpus/' || doc_id || '.pdf' AS source, doc_id AS seq,
                  CASE WHEN quality = 1 THEN text ELSE text || ' (old)' END AS content
           FROM documents JOIN labels USING (doc_id)),
old AS (SELECT 'doc_' || substr(md5(content), 1, 8) || '_p1_c0' AS id, source,
               md5(content) AS file_hash, seq FROM stored
        QUALIFY row_number() OVER (PARTITION BY substr(md5(content), 1, 8) ORDER BY seq DESC) = 1),
statuses AS (SELECT c.source, c.file_hash, c.seq,
                    CASE WHEN o.file_hash IS NULL THEN 'NEW' WHEN o.file_hash = c.file_hash
                         THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status
             FROM corpus c LEFT JOIN old o USING (source))"""

TWINS["scan_sources"] = """
WITH l AS (SELECT '/corpus/' || source || '/' || doc_id || CASE lang WHEN 'en' THEN '.pdf'
             WHEN 'de' THEN '.PDF' WHEN 'fr' THEN '.Pdf' ELSE '.txt' END AS source FROM documents)
SELECT source, regexp_extract(source, '[^/]+$', 0) AS filename, source LIKE '%.pdf' AS upload_ok
FROM l WHERE source ILIKE '%.pdf'"""

TWINS["content_fingerprint"] = f"""
WITH {_CORPUS} SELECT source, file_hash, substr(file_hash, 1, 8) AS doc_hash FROM corpus"""

TWINS["index_status"] = f"WITH {_CORPUS} SELECT source, file_hash, status FROM statuses"
TWINS["work_list"] = f"WITH {_CORPUS} SELECT source, status FROM statuses WHERE status <> 'UNCHANGED'"

TWINS["settled_files"] = """
WITH o AS (SELECT user_id::VARCHAR AS path, epoch_us(ts) AS t, floor(value / 20)::BIGINT AS size,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS poll FROM events),
p AS (SELECT b.path, b.poll, b.t, b.size FROM o a JOIN o b ON a.path = b.path AND b.poll = a.poll + 1
      WHERE b.poll <= 15 AND b.size > 0 AND b.size = a.size)
SELECT path, poll::INT AS poll, t, size FROM p
QUALIFY row_number() OVER (PARTITION BY path ORDER BY poll) = 1"""

_DEDUP = """
ev AS (SELECT {key} AS key, event_id AS id, epoch_us(ts) AS t, value, event_type,
              row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT key, id, t, rn, TRUE AS miss, CASE WHEN {valid} THEN t END AS set_t FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.key, e.id, e.t, e.rn, (set_t IS NULL OR e.t - set_t >= {ttl}::BIGINT * 1000000),
         CASE WHEN (set_t IS NULL OR e.t - set_t >= {ttl}::BIGINT * 1000000) AND {valid} THEN e.t
              ELSE set_t END
  FROM walk w JOIN ev e ON e.key = w.key AND e.rn = w.rn + 1)"""

TWINS["dedup_events"] = f"""
WITH RECURSIVE {_DEDUP.format(key="user_id::VARCHAR", ttl=172800, valid="TRUE")}
SELECT key, t, id FROM walk WHERE miss"""

_CHANGES = """
fe AS (SELECT event_id, epoch_us(ts) AS t, '/corpus/' || user_id || '.pdf' AS src,
              '/corpus/' || regexp_extract(props, '[0-9]+') || CASE WHEN value < 10 THEN '.txt' ELSE '.pdf' END AS dest,
              CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted'
                   WHEN 'click' THEN 'moved' ELSE 'modified' END AS action FROM events),
steps AS (SELECT src AS source, t, event_id, 0 AS seq,
                 CASE WHEN action IN ('created', 'modified') THEN 'ingest' ELSE 'delete' END AS change FROM fe
          UNION ALL
          SELECT dest, t, event_id, 1, 'ingest' FROM fe WHERE action = 'moved' AND dest LIKE '%.pdf'),
changes AS (SELECT source, change, event_id FROM steps
            QUALIFY row_number() OVER (PARTITION BY source ORDER BY t DESC, event_id DESC, seq DESC) = 1)"""

TWINS["file_changes"] = f"WITH {_CHANGES} SELECT source, change, event_id FROM changes"

_NEW_ROWS = """
fresh AS (SELECT 'doc_' || substr(file_hash, 1, 8) || '_p1_c0' AS id, source, file_hash FROM corpus
          WHERE source IN ({todo}) AND {chunks}
          QUALIFY row_number() OVER (PARTITION BY substr(file_hash, 1, 8) ORDER BY seq DESC) = 1)
SELECT id, source, file_hash FROM old
WHERE source NOT IN ({gone}) AND source NOT IN ({todo}) AND id NOT IN (SELECT id FROM fresh)
UNION ALL SELECT id, source, file_hash FROM fresh"""

TWINS["apply_file_events"] = f"WITH {_CORPUS}, {_CHANGES}, " + _NEW_ROWS.format(
    todo="SELECT source FROM changes JOIN statuses USING (source) WHERE change = 'ingest' AND status <> 'UNCHANGED'",
    gone="SELECT source FROM changes WHERE change = 'delete'", chunks=f"length({strip('content')}) >= 20")

TWINS["upsert_index"] = f"WITH {_CORPUS}, " + _NEW_ROWS.format(
    todo="SELECT source FROM statuses WHERE status <> 'UNCHANGED'", gone="SELECT 'none'", chunks="TRUE")

TWINS["delete_source"] = f"""
WITH {_CORPUS} SELECT id, source, file_hash FROM old
WHERE source NOT IN (SELECT '/corpus/' || doc_id || '.pdf' FROM labels WHERE toxic = 1)"""

TWINS["index_lookup"] = f"""
WITH {_CORPUS} SELECT id, file_hash FROM old WHERE source = '/corpus/10.pdf' ORDER BY id LIMIT 1"""

_HTML = "html"
for _pattern, _new in [
    (r"(?is)<!--.*?-->", " "), (r"(?is)<script[^>]*>.*?</script>", " "),
    (r"(?is)<style[^>]*>.*?</style>", " "), (r"(?i)<(?:/p|br|/h[1-6]|/li|/div)[^>]*>", "\n"),
    (r"<[^>]*>", " "),
]:
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', '{_new}', 'g')"
for _pattern, _new in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                       ("&copy;", "©"), ("&amp;", "&")]:
    _HTML = f"replace({_HTML}, '{_pattern}', '{_new}')"
_HTML = strip(f"regexp_replace(regexp_replace({_HTML}, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', '\n', 'g')")

_PAGES = f"""
whole AS (SELECT 'page-' || page_id AS source, {_HTML} AS content FROM pages
          UNION ALL SELECT '/corpus/' || doc_id || '.pdf', text FROM documents),
parts AS (SELECT source, string_split(content, chr(12)) AS p FROM whole),
paged AS (SELECT source, unnest(generate_series(1, len(p)))::INT AS page, unnest(p) AS text FROM parts)"""

TWINS["extract_pages"] = f"WITH {_PAGES} SELECT source, page, text FROM paged"
TWINS["drop_short_pages"] = f"""
WITH {_PAGES} SELECT source, page, length(text)::INT AS chars FROM paged WHERE length({strip('text')}) >= 20"""


def chunk_ctes(pages: str) -> str:
    """CTEs from ``pages(doc, text)`` to ``chunked(doc, chunk_idx, text)``: leaves, islands, pointers
    to the end and the next start of a chunk from every leaf, and a walk along the pointers."""
    sep = "CASE lvl WHEN 1 THEN chr(10) || chr(10) WHEN 2 THEN chr(10) ELSE ' ' END"

    def stage(k: int, source: str) -> str:
        path = {1: "i AS o1, 0 AS o2, 0 AS o3", 2: "o1, i AS o2, 0 AS o3", 3: "o1, o2, i AS o3"}[k]
        return f"""
n{k} AS (SELECT *, CASE WHEN low <= 1 AND contains(text, chr(10) || chr(10)) THEN 1
                        WHEN low <= 2 AND contains(text, chr(10)) THEN 2
                        WHEN low <= 3 AND contains(text, ' ') THEN 3 ELSE 4 END AS lvl FROM {source}),
u{k} AS (SELECT doc, o1, o2, o3, grp, lvl, unnest(generate_series(1, len(s)))::INT AS i, unnest(s) AS piece
         FROM (SELECT *, string_split(text, {sep}) AS s FROM n{k} WHERE lvl < 4)),
c{k} AS (SELECT doc, {path}, grp, lvl, i, CASE WHEN i > 1 THEN {sep} || piece ELSE piece END AS text
         FROM u{k} WHERE i > 1 OR piece <> ''),
more{k} AS (SELECT doc, o1, o2, o3, grp || '.' || i AS grp, text, lvl + 1 AS low FROM c{k} WHERE length(text) >= 1000),
leaf{k} AS (SELECT doc, o1, o2, o3, grp, text FROM c{k} WHERE length(text) < 1000
            UNION ALL SELECT doc, o1, o2, o3, grp || '!', text FROM n{k} WHERE lvl = 4)"""

    return f"""
top AS (SELECT doc, 0 AS o1, 0 AS o2, 0 AS o3, '0' AS grp, text, 1 AS low FROM {pages}),
{stage(1, 'top')},
{stage(2, 'more1')},
{stage(3, 'more2')},
leaves AS (SELECT * FROM leaf1 UNION ALL SELECT * FROM leaf2 UNION ALL SELECT * FROM leaf3
           UNION ALL SELECT doc, o1, o2, o3, grp || '!', text FROM more3),
marked AS (SELECT *, grp IS DISTINCT FROM lag(grp) OVER w AS first FROM leaves
           WINDOW w AS (PARTITION BY doc ORDER BY o1, o2, o3)),
isled AS (SELECT *, sum(first::INT) OVER (PARTITION BY doc ORDER BY o1, o2, o3)::INT AS isl FROM marked),
lf AS MATERIALIZED (
  SELECT doc, isl, text, length(text) AS n, row_number() OVER w AS i,
         sum(length(text)) OVER w::BIGINT AS upto, sum(length(text)) OVER w::BIGINT - length(text) AS before
  FROM isled WINDOW w AS (PARTITION BY doc, isl ORDER BY o1, o2, o3)),
ends AS (SELECT l.doc, l.isl, l.i AS s, coalesce(r.i, l.i) AS e
         FROM lf l ASOF LEFT JOIN lf r ON l.doc = r.doc AND l.isl = r.isl AND l.before + 1000 >= r.upto),
goals AS (SELECT x.doc, x.isl, x.s, x.e, greatest(b.before - 150, b.upto - 1000) AS goal
          FROM ends x LEFT JOIN lf b ON b.doc = x.doc AND b.isl = x.isl AND b.i = x.e + 1),
ptr AS MATERIALIZED (
  SELECT g.doc, g.isl, g.s, g.e, j.i AS nxt
  FROM goals g ASOF LEFT JOIN lf j ON g.doc = j.doc AND g.isl = j.isl AND g.goal <= j.before),
trail AS (SELECT doc, isl, s, e, nxt FROM ptr WHERE s = 1
          UNION ALL
          SELECT p.doc, p.isl, p.s, p.e, p.nxt FROM trail t JOIN ptr p ON p.doc = t.doc AND p.isl = t.isl AND p.s = t.nxt),
joined AS (SELECT t.doc, t.isl, t.s, {strip("string_agg(l.text, '' ORDER BY l.i)")} AS text
           FROM trail t JOIN lf l ON l.doc = t.doc AND l.isl = t.isl AND l.i BETWEEN t.s AND t.e
           GROUP BY t.doc, t.isl, t.s),
chunked AS (SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY isl, s) - 1)::INT AS chunk_idx, text
            FROM joined WHERE text <> '')"""


TWINS["chunk_text"] = f"""
WITH RECURSIVE pg AS (SELECT doc_id AS doc, text FROM documents), {chunk_ctes('pg')}
SELECT doc AS doc_id, chunk_idx, text FROM chunked"""


def _rows_ctes(sources: str) -> str:
    """From ``sources(source, content, seq)`` to ``made``: one row per chunk, before ids are resolved."""
    return f"""
paged AS (SELECT source, seq, md5(content) AS file_hash, unnest(generate_series(1, len(p)))::INT AS page, unnest(p) AS text
          FROM (SELECT *, string_split(content, chr(12)) AS p FROM {sources})),
pg AS (SELECT source || '|' || page || '|' || seq || '|' || file_hash AS doc, * FROM paged WHERE length({strip('text')}) >= 20),
{chunk_ctes('pg')},
made AS (SELECT 'doc_' || substr(file_hash, 1, 8) || '_p' || page || '_c' || chunk_idx AS id, source,
                regexp_extract(source, '[^/]+$', 0) AS filename, page, chunk_idx, c.text, file_hash, seq
         FROM chunked c JOIN pg USING (doc))"""


TWINS["chunk_rows"] = f"""
WITH RECURSIVE {_CORPUS}, {_rows_ctes('corpus')}
SELECT id, source, filename, page, chunk_idx, text, file_hash FROM made"""

TWINS["ingest_documents"] = f"""
WITH RECURSIVE {_CORPUS},
both_ AS (SELECT source, content, seq FROM stored UNION SELECT source, content, seq FROM corpus),
{_rows_ctes('both_')},
was AS (SELECT m.* FROM made m JOIN stored s ON s.source = m.source AND md5(s.content) = m.file_hash
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY m.seq DESC) = 1),
known AS (SELECT source, min_by(file_hash, id) AS h FROM was GROUP BY source),
todo AS (SELECT c.source, c.file_hash FROM corpus c LEFT JOIN known k USING (source)
         WHERE k.h IS NULL OR k.h <> c.file_hash),
came AS (SELECT m.* FROM made m JOIN todo t ON t.source = m.source AND t.file_hash = m.file_hash),
last_ AS (SELECT * FROM came QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT id, source, filename, page, chunk_idx, text, file_hash FROM was
WHERE source NOT IN (SELECT source FROM came) AND id NOT IN (SELECT id FROM last_)
UNION ALL SELECT id, source, filename, page, chunk_idx, text, file_hash FROM last_"""


# ---- retrieval

def sparse_ctes(name: str, texts: str) -> str:
    """``{name}(id, dim, w)`` from ``texts(id, text)``: non-zero weights of the hashed bag of words."""
    return f"""
{name}_c AS (SELECT id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 256)::INT AS dim, count(*)::DOUBLE AS n
             FROM (SELECT id, unnest({words('text')}) AS w FROM {texts}) GROUP BY 1, 2),
{name} AS (SELECT id, dim, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS w FROM {name}_c)"""


TWINS["embed_text"] = f"""
WITH t AS (SELECT 'doc-' || doc_id AS id, text FROM documents UNION ALL SELECT 'item-' || item_id, text FROM benchmark),
{sparse_ctes('v', 't')}
SELECT id, dim, round(w, 6) AS weight FROM v"""

TWINS["vector_topk"] = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.vec_id AS req_id, c.vec_id AS id, round(1 - list_cosine_similarity(q.v, c.v), 9) AS distance FROM e q, e c)
SELECT req_id, id, distance, row_number() OVER (PARTITION BY req_id ORDER BY distance, id)::INT AS rank FROM d
QUALIFY rank <= 10"""

TWINS["vector_topk_lsh"] = """
WITH u AS (SELECT vec_id, e / sqrt(sum(e * e) OVER (PARTITION BY vec_id)) AS e, d
           FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(generate_series(0, 63)) AS d FROM embeddings)),
planes AS (SELECT p, d, CASE WHEN substr(md5('7:' || p || ':' || d), 1, 1) < '8' THEN 1 ELSE -1 END AS s
           FROM generate_series(0, 63) a(p), generate_series(0, 63) b(d)),
sides AS (SELECT vec_id, p, sum(e * s) >= 0 AS side FROM u JOIN planes USING (d) GROUP BY 1, 2),
buckets AS (SELECT vec_id, p // 4 AS tab, sum(CASE WHEN side THEN 1 << (p % 4)::INT ELSE 0 END) AS code
            FROM sides GROUP BY 1, 2),
pairs AS (SELECT DISTINCT a.vec_id AS req_id, b.vec_id AS id FROM buckets a JOIN buckets b USING (tab, code)),
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
dist AS (SELECT req_id, id, round(1 - list_cosine_similarity(q.v, c.v), 9) AS distance
         FROM pairs JOIN e q ON q.vec_id = req_id JOIN e c ON c.vec_id = id)
SELECT req_id, id, distance, row_number() OVER (PARTITION BY req_id ORDER BY distance, id)::INT AS rank FROM dist
QUALIFY rank <= 10"""

_ASKED = "asked AS (SELECT item_id AS id, text FROM benchmark)"
_TOPK = f"""
{_CORPUS}, {_rows_ctes('corpus')},
ix AS MATERIALIZED (SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
{_ASKED},
{sparse_ctes('qv', 'asked')}, {sparse_ctes('cv', 'ix')},
ql AS (SELECT id, sqrt(sum(w * w)) AS len FROM qv GROUP BY id),
cl AS (SELECT id, sqrt(sum(w * w)) AS len FROM cv GROUP BY id),
dots AS (SELECT q.id AS req_id, c.id, sum(q.w * c.w) AS dot FROM qv q JOIN cv c USING (dim) GROUP BY 1, 2),
near AS (SELECT a.id AS req_id, i.id, round(1 - coalesce(dot, 0) / coalesce(ql.len * cl.len, 1), 9) AS distance
         FROM asked a CROSS JOIN ix i LEFT JOIN dots d ON d.req_id = a.id AND d.id = i.id
         LEFT JOIN ql ON ql.id = a.id LEFT JOIN cl ON cl.id = i.id),
topk AS MATERIALIZED (
  SELECT req_id, id, distance, row_number() OVER (PARTITION BY req_id ORDER BY distance, id)::INT AS rank FROM near
  QUALIFY rank <= 10)"""

TWINS["text_topk"] = f"WITH RECURSIVE {_TOPK} SELECT req_id, id, rank, distance FROM topk"

_SCORED = f"""
{_TOPK},
bags AS MATERIALIZED (SELECT id, filename, page, text, {words('text')} AS bag FROM ix),
stats AS (SELECT count(*) AS n_docs, avg(len(bag)) AS avg_len FROM bags),
terms AS (SELECT DISTINCT id AS req_id, unnest({words('text')}) AS term FROM asked),
dfs AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(bag) AS term FROM bags) GROUP BY term),
scored AS MATERIALIZED (
  SELECT k.req_id, k.id, k.rank, b.filename, b.page, b.text,
         coalesce(round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
                            / (tf + 1.2 * (1 - 0.75 + 0.75 * len(b.bag) / avg_len))), 9), 0) AS score
  FROM topk k JOIN bags b USING (id) CROSS JOIN stats
  LEFT JOIN (SELECT k2.req_id, k2.id, t.term, len(list_filter(b2.bag, lambda w: w = t.term)) AS tf
             FROM topk k2 JOIN bags b2 USING (id) JOIN terms t ON t.req_id = k2.req_id) f
         ON f.req_id = k.req_id AND f.id = k.id
  LEFT JOIN dfs ON dfs.term = f.term
  GROUP BY ALL)"""

TWINS["rerank_score"] = f"""
WITH RECURSIVE {_SCORED} SELECT req_id, id, rank, round(score, 6) AS rerank_score FROM scored"""
TWINS["rerank_score_kept"] = TWINS["rerank_score"]

_KEPT = f"""
{_SCORED},
kept AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, rank)::INT AS pos FROM scored
         WHERE score >= 20 QUALIFY pos <= 3),
ctx AS (SELECT a.id AS req_id, a.text AS query, count(k.id) AS n_chunks,
               coalesce(string_agg('Source: ' || filename || ' (Page ' || page || ')' || chr(10) || k.text,
                                   chr(10) || chr(10) ORDER BY pos), '') AS context,
               coalesce(string_agg(filename, ',' ORDER BY pos), '') AS sources,
               min_by(k.text, pos) AS best,
               coalesce(array_agg(k.text ORDER BY pos) FILTER (k.id IS NOT NULL), []) AS texts
        FROM asked a LEFT JOIN kept k ON k.req_id = a.id GROUP BY 1, 2)"""

_FALLBACK = "I could not find any relevant information in the knowledge base to answer your query."
TWINS["rerank_topn"] = f"WITH RECURSIVE {_KEPT} SELECT req_id, id, rank, pos FROM kept"
TWINS["assemble_context"] = f"WITH RECURSIVE {_KEPT} SELECT req_id, context FROM ctx"
TWINS["build_prompt"] = f"""
WITH RECURSIVE {_KEPT} SELECT req_id,
  'Use nothing but the context to answer. Say that you do not know when it lacks the answer.' || chr(10) || chr(10)
  || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query || chr(10) || 'Answer:' AS prompt
FROM ctx"""
TWINS["no_hit_answer"] = f"""
WITH RECURSIVE {_KEPT} SELECT req_id, CASE WHEN n_chunks = 0 THEN '{_FALLBACK}' ELSE best END AS answer,
  n_chunks::INT AS n_chunks FROM ctx"""
TWINS["answer_sources"] = f"WITH RECURSIVE {_KEPT} SELECT req_id, sources FROM ctx"
TWINS["cache_payload"] = f"WITH RECURSIVE {_KEPT} SELECT req_id, query, context AS answer, sources FROM ctx"


# ---- cache

def cache_key(q: str, user: str = "'global'", doc: str = "'all'") -> str:
    return f"'rag_response:' || sha256({user} || ':' || {doc} || ':' || lower({strip(q)}))"


_USER = "CASE WHEN role = 'system' THEN 'global' ELSE conv_id::VARCHAR END"
TWINS["cache_key"] = f"""
SELECT conv_id, turn, {cache_key('text')} AS shared_key, {cache_key('text', _USER)} AS user_key,
       {cache_key('text', _USER, 'md5(text)')} AS doc_key FROM conversations"""

TWINS["cache_replay"] = f"""
WITH RECURSIVE {_DEDUP.format(key="user_id || ':' || event_type", ttl=86400, valid="TRUE")}
SELECT key, t, id, CASE WHEN miss THEN 'MISS' ELSE 'HIT' END AS outcome FROM walk"""

TWINS["cache_write_gate"] = f"""
WITH RECURSIVE {_DEDUP.format(key="user_id::VARCHAR", ttl=172800, valid="value >= 30").replace("AND value >= 30", "AND e.value >= 30")}
SELECT w.key, w.t, w.id, v.value >= 30 AS valid, CASE WHEN miss THEN 'MISS' ELSE 'HIT' END AS outcome
FROM walk w JOIN events v ON v.event_id = w.id"""

TWINS["cache_replay_ops"] = """
WITH o AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS t, event_id AS id,
                  CASE event_type WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'delete' ELSE 'get' END AS op,
                  CASE WHEN event_type = 'purchase' THEN floor(value)::INT * 3600 END AS ttl_s,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT *, max(CASE WHEN op <> 'get' THEN rn END) OVER (PARTITION BY key ORDER BY rn) AS last FROM o)
SELECT w.key, w.t, w.id, w.op, w.ttl_s,
       CASE WHEN w.op = 'get' THEN CASE WHEN s.op = 'set' AND w.t - s.t < s.ttl_s::BIGINT * 1000000
                                        THEN 'HIT' ELSE 'MISS' END END AS outcome
FROM w LEFT JOIN o s ON s.key = w.key AND s.rn = w.last"""


# ---- throttling

def bucket_ctes(log: str, cap: str, rate: str, idle: str) -> str:
    """``log(key, id, t)`` -> ``bucket``: tokens counted one event after the other."""
    return f"""
ordered AS (SELECT key, id, t, row_number() OVER (PARTITION BY key ORDER BY t, id) AS rn FROM {log}),
bucket AS (
  SELECT key, id, t, rn, {cap} - 1.0::DOUBLE AS tokens, t AS updated, TRUE AS allowed, {cap}::DOUBLE AS had
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT key, id, t, rn, CASE WHEN had >= 1 THEN had - 1 ELSE tokens END, CASE WHEN had >= 1 THEN t ELSE updated END,
         had >= 1, had
  FROM (SELECT e.key, e.id, e.t, e.rn, b.tokens, b.updated,
               CASE WHEN e.t - b.t >= {idle} THEN {cap}
                    ELSE least({cap}::DOUBLE, b.tokens + (e.t - b.updated) / 1e6 * {rate}) END AS had
        FROM bucket b JOIN ordered e ON e.key = b.key AND e.rn = b.rn + 1))"""


_BUCKET_OUT = """key, t, id, allowed, CASE WHEN allowed THEN floor(tokens) ELSE 0 END::BIGINT AS remaining,
       CASE WHEN NOT allowed THEN ceil((1 - had) / ({rate}))::BIGINT END AS retry_after_s"""
_LOG = "log AS (SELECT user_id::VARCHAR AS key, event_id AS id, epoch_us(ts) AS t FROM events)"

TWINS["token_bucket"] = f"""
WITH RECURSIVE {_LOG}, {bucket_ctes('log', '3', '(1/7200.0)', '9e18')}
SELECT {_BUCKET_OUT.format(rate='1/7200.0')} FROM bucket"""
TWINS["token_bucket_idle_reset"] = f"""
WITH RECURSIVE {_LOG}, {bucket_ctes('log', '5', '(1/432000.0)', '86400000000')}
SELECT {_BUCKET_OUT.format(rate='1/432000.0')} FROM bucket"""


# ---- input guard

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_CARD = r"\b(?:[0-9][ -]?){12,18}[0-9]\b"
_IP = rf"\b{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\b"
_SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
_TEL = r"(?:\+[0-9]{1,3}[ .-]?)?\(?\b[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}\b"


def luhn(v: str) -> str:
    digits = f"list_reverse(string_split(regexp_replace({v}, '[ -]', '', 'g'), ''))"
    return (f"(list_sum(list_transform({digits}, lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT "
            f"WHEN d::INT > 4 THEN 2 * d::INT - 9 ELSE 2 * d::INT END)) % 10 = 0)")


def hits(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


TWINS["pii_detect"] = "WITH " + ", ".join(
    f"h{i} AS (SELECT doc_id, '{name}' AS entity, unnest({hits('text', pattern)}) AS value, {score}::DOUBLE AS score FROM documents)"
    for i, (name, pattern, score) in enumerate([
        ("EMAIL_ADDRESS", _EMAIL, 1.0), ("CREDIT_CARD", _CARD, 1.0), ("IP_ADDRESS", _IP, 0.6),
        ("US_SSN", _SSN, 0.85), ("PHONE_NUMBER", _TEL, 0.75)])
) + f"""
SELECT * FROM h0 UNION ALL SELECT * FROM h1 WHERE {luhn('value')} UNION ALL SELECT * FROM h2
UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4"""


def anonymize_ctes(name: str, source: str, key: str) -> str:
    """``{name}(key, raw, clean)``: the text between card numbers and the numbers, put together again."""
    return f"""
{name}_m AS (SELECT {key}, text AS raw, regexp_replace(text, '{_EMAIL}', '<EMAIL_ADDRESS>', 'g') AS t FROM {source}),
{name}_x AS (SELECT {key}, raw, string_split_regex(t, '{_CARD}') AS out_, {hits('t', _CARD)} AS in_ FROM {name}_m),
{name}_c AS (SELECT {key}, raw, array_to_string(list_transform(out_, lambda o, i: o || CASE WHEN i > len(in_) THEN ''
               WHEN {luhn('in_[i]')} THEN '<CREDIT_CARD>' ELSE in_[i] END), '') AS t FROM {name}_x),
{name} AS (SELECT {key}, raw, regexp_replace(regexp_replace(regexp_replace(t, '{_IP}', '<IP_ADDRESS>', 'g'),
               '{_SSN}', '<US_SSN>', 'g'), '{_TEL}', '<PHONE_NUMBER>', 'g') AS clean FROM {name}_c)"""


TWINS["pii_anonymize"] = f"""
WITH {anonymize_ctes('a', 'documents', 'doc_id')}
SELECT doc_id, clean AS sanitized, clean <> raw AS pii_found FROM a"""

_TOXIC = "'Content flagged for toxicity (Confidence: 1.00).'"
TWINS["validate_input"] = f"""
WITH {anonymize_ctes('a', 'documents', 'doc_id')}
SELECT doc_id, CASE WHEN toxic = 1 THEN 'REJECTED' ELSE 'ACCEPTED' END AS status,
       CASE WHEN toxic = 1 THEN {_TOXIC} WHEN clean <> raw THEN 'PII detected and redacted.'
            ELSE 'Clean prompt.' END AS reason,
       CASE WHEN toxic IS DISTINCT FROM 1 THEN clean END AS sanitized
FROM a LEFT JOIN labels USING (doc_id)"""


# ---- output guard

_ANSWERS = f"""
answers AS (
  SELECT c.conv_id, c.turn, c.text AS answer, CASE WHEN p.text IS NULL THEN [] ELSE [p.text] END AS context
  FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
  WHERE c.role = 'assistant'
  UNION ALL SELECT conv_id::BIGINT, turn::BIGINT, answer, [answer, 'graphs index vectors']
  FROM (VALUES {EDGE_ANSWERS.replace('STRING', 'VARCHAR')}) v(conv_id, turn, answer)),
wordy AS (SELECT *, list_distinct({words4('answer')}) AS aw,
                 list_distinct({words4("array_to_string(context, ' ')")}) AS cw FROM answers)"""
_LEAK = " OR ".join(f"contains(lower(answer), '{s}')" for s in [
    "as an ai language model", "as an ai", "my system instructions", "ignore previous instructions"])
_EMPTY = f"coalesce({strip('answer')}, '') = ''"


def grounded(threshold: float) -> str:
    return (f"CASE WHEN len(context) = 0 OR len(cw) = 0 THEN FALSE WHEN len(aw) = 0 THEN TRUE "
            f"ELSE len(list_intersect(aw, cw)) / len(aw) >= {threshold} END")


def masked(x: str) -> str:
    for kind, pattern in [
        ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
        ("PHONE", r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
        ("CREDIT_CARD", r"\b(?:\d[ -]*?){13,16}\b"),
        ("API_KEY", r"\b(?:sk-[a-zA-Z0-9]{32,}|AKIA[0-9A-Z]{16})\b"),
        ("SSN_AADHAAR", r"\b\d{3}-\d{2}-\d{4}\b|\b\d{4}\s?\d{4}\s?\d{4}\b"),
    ]:
        x = f"regexp_replace({x}, '{pattern}', '[REDACTED_{kind}]', 'g')"
    return x


TWINS["empty_answer"] = f"WITH {_ANSWERS} SELECT conv_id, turn, {_EMPTY} AS is_empty FROM answers"
TWINS["leak_signature"] = f"WITH {_ANSWERS} SELECT conv_id, turn, coalesce({_LEAK}, FALSE) AS leak FROM answers"
TWINS["groundedness"] = f"""
WITH {_ANSWERS} SELECT conv_id, turn,
  CASE WHEN len(aw) > 0 THEN round(len(list_intersect(aw, cw)) / len(aw), 6) END AS ratio,
  coalesce({grounded(0.25)}, FALSE) AS grounded FROM wordy"""
TWINS["mask_pii"] = f"""
WITH {_ANSWERS}, t AS (SELECT 'doc-' || doc_id AS id, text FROM documents
                       UNION ALL SELECT conv_id || '-' || turn, answer FROM answers)
SELECT id, {masked('text')} AS masked FROM t"""

_BLOCKED_TEXT = {
    "EMPTY_RESPONSE": "Unable to generate a valid response from the knowledge base.",
    "META_LEAK_BLOCKED": "Response blocked due to meta-prompting leak or system violation.",
    "HALLUCINATION_RISK": "The system generated a response that could not be confidently verified "
                          "against the retrieved source documents.",
}


def verdict_ctes(source: str) -> str:
    """``source(answer, context, aw, cw, ...)`` -> ``judged`` with ``text`` and ``reason``."""
    texts = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _BLOCKED_TEXT.items())
    return f"""
reasons AS (SELECT *, CASE WHEN {_EMPTY} THEN 'EMPTY_RESPONSE' WHEN {_LEAK} THEN 'META_LEAK_BLOCKED'
                           WHEN NOT {grounded(0.10)} THEN 'HALLUCINATION_RISK' ELSE 'PASSED' END AS reason FROM {source}),
judged AS (SELECT *, CASE reason {texts} ELSE {masked('answer')} END AS verdict_text FROM reasons)"""


TWINS["validate_output"] = f"""
WITH {_ANSWERS}, {verdict_ctes('wordy')}
SELECT conv_id, turn, verdict_text AS text, reason = 'PASSED' AS valid, reason FROM judged"""


# ---- whole pipeline and scalars

_REQUESTS = f"""
reqs AS (SELECT event_id AS req_id, user_id::VARCHAR AS user_id, epoch_us(ts) AS t, toxic,
                CASE WHEN event_type = 'signup' THEN b.text || ' Reply to user' || user_id || '@mail.example.com'
                     ELSE b.text END AS text
         FROM events JOIN benchmark b
           ON b.item_id = regexp_extract(props, '[0-9]+')::BIGINT % (SELECT count(*) FROM benchmark)
         LEFT JOIN labels l ON l.doc_id = event_id),
okay AS (SELECT * FROM reqs WHERE toxic IS DISTINCT FROM 1),
{anonymize_ctes('san', 'okay', 'req_id')},
log AS (SELECT user_id AS key, req_id AS id, t FROM okay),
{bucket_ctes('log', '3', '(1/7200.0)', '9e18')},
passed AS MATERIALIZED (SELECT b.key AS user_id, b.id, b.t, {cache_key('clean')} AS k, lower({strip('clean')}) AS q
                        FROM bucket b JOIN san ON san.req_id = b.id WHERE allowed),
asked AS MATERIALIZED (SELECT k AS id, min(q) AS text FROM passed GROUP BY k)"""

_JUDGED = f"""
said AS (SELECT req_id AS k, sources, texts AS context, CASE WHEN n_chunks = 0 THEN '{_FALLBACK}' ELSE best END AS answer
         FROM ctx),
worded AS (SELECT *, list_distinct({words4('answer')}) AS aw,
                  list_distinct({words4("array_to_string(context, ' ')")}) AS cw FROM said),
{verdict_ctes('worded')}, told AS MATERIALIZED (SELECT * FROM judged)"""

TWINS["answer_requests"] = f"""
WITH RECURSIVE {_REQUESTS}, {_KEPT.replace(_ASKED + ",", "")}, {_JUDGED},
lined AS (SELECT p.*, reason = 'PASSED' AS valid, row_number() OVER (PARTITION BY p.k ORDER BY t, p.id) AS rn
          FROM passed p JOIN told USING (k)),
served AS (
  SELECT k, id, user_id, t, rn, valid, TRUE AS miss, CASE WHEN valid THEN t END AS set_t FROM lined WHERE rn = 1
  UNION ALL
  SELECT l.k, l.id, l.user_id, l.t, l.rn, l.valid, (s.set_t IS NULL OR l.t - s.set_t >= 86400000000),
         CASE WHEN l.valid AND (s.set_t IS NULL OR l.t - s.set_t >= 86400000000) THEN l.t ELSE s.set_t END
  FROM served s JOIN lined l ON l.k = s.k AND l.rn = s.rn + 1)
SELECT req_id, user_id, 'INPUT_BLOCKED' AS outcome, 400 AS code, {_TOXIC} AS reason,
       NULL::VARCHAR AS answer, NULL::VARCHAR AS sources FROM reqs WHERE toxic = 1
UNION ALL
SELECT id, key, 'RATE_LIMITED', 429, 'Retry after ' || ceil((1 - had) * 7200)::BIGINT || ' s', NULL, NULL
FROM bucket WHERE NOT allowed
UNION ALL
SELECT id, user_id, CASE WHEN NOT miss THEN 'CACHE_HIT' WHEN valid THEN 'RAG_PIPELINE' ELSE 'OUTPUT_BLOCKED' END,
       CASE WHEN NOT miss OR valid THEN 200 ELSE 422 END, reason, verdict_text, CASE WHEN valid THEN sources END
FROM served JOIN told USING (k)"""

TWINS["words4"] = f"SELECT doc_id, array_to_string({words4('text')}, ' ') AS words FROM documents"
TWINS["strip_ws"] = f"""
SELECT doc_id, {strip("' ' || chr(9) || chr(10) || ' ' || text || '  ' || chr(13) || chr(10)")} AS stripped FROM documents"""


# ---- streams: the same results as their batch forms

for _live, _batch in [("token_bucket_stream", "token_bucket"), ("cache_stream", "cache_replay"),
                      ("dedup_events_stream", "dedup_events")]:
    TWINS[_live] = TWINS[_batch]

TWINS["stream_ingest"] = f"""
WITH RECURSIVE {_CORPUS}, {_rows_ctes('corpus')}
SELECT id, source, filename, page, chunk_idx, text, file_hash FROM made
QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"""

TWINS["replay_file_events"] = f"""
WITH {_CHANGES}, docs AS (
  SELECT '/corpus/' || doc_id || '.pdf' AS source, '/corpus/' || doc_id || '.pdf ' || text AS content FROM documents)
SELECT source, md5(content) AS file_hash FROM docs JOIN changes USING (source)
WHERE change = 'ingest' AND length({strip('content')}) >= 20"""

TWINS["daily_quota"] = """
WITH e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS t, event_id AS id,
                  epoch_us(ts) + 19800000000 AS local FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY key, local // 86400000000 ORDER BY t, id) AS n FROM e)
SELECT key, t, id, n <= 2 AS allowed, greatest(2 - n, 0)::BIGINT AS remaining,
       CASE WHEN n > 2 THEN ceil((86400000000 - local % 86400000000) / 1000000.0)::BIGINT END AS retry_after_s
FROM r"""
TWINS["daily_quota_stream"] = TWINS["daily_quota"]
