"""DuckDB SQL for the queries of the catalogue, written from the contracts and not from the Spark plans."""

from __future__ import annotations

_FP = r"""md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce({0}, ''), '\r\n?', chr(10), 'g'), chr(10)),
  lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10)))"""
_CFG = "md5({0} || '_' || (round_even({1} / 100.0, 0) * 100)::BIGINT || '_' || (round_even({2} / 25.0, 0) * 25)::BIGINT || '_85')"
_TITLE = "CASE WHEN length({0}) > 30 THEN left({0}, 30) || '...' ELSE {0} END"


def _fixed(source: str, size: int = 1000, overlap: int = 100) -> str:
    """CTEs from ``source`` (key, text) to ``chunk`` (key, piece, start_index, text); for texts without blank lines."""
    return rf"""
line AS (SELECT key, i, CASE WHEN i > 1 THEN chr(10) ELSE '' END || part AS t
         FROM (SELECT key, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source})),
lined AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
                 sum(CASE WHEN length(t) >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS big FROM line WHERE t <> ''),
word AS (SELECT key, i, w, b AS base, CASE WHEN w > 1 THEN ' ' ELSE '' END || part AS t
         FROM (SELECT key, i, b, unnest(string_split(t, ' ')) AS part, generate_subscripts(string_split(t, ' '), 1) AS w FROM lined WHERE length(t) >= {size})),
worded AS (SELECT *, base + coalesce(sum(length(t)) OVER (PARTITION BY key, i ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
                  sum(CASE WHEN length(t) >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY key, i ORDER BY w) AS big FROM word WHERE t <> ''),
atom AS (SELECT key, 'l' || big AS run, b, b + length(t) AS e FROM lined WHERE length(t) < {size}
         UNION ALL SELECT key, 'w' || i || '_' || big, b, b + length(t) FROM worded WHERE length(t) < {size}),
reach AS (SELECT *, max(e) OVER (PARTITION BY key, run ORDER BY e RANGE BETWEEN CURRENT ROW AND ({size} - (e - b)) FOLLOWING) AS till FROM atom),
nxt AS (SELECT r.key, r.run, r.b, r.till, CASE WHEN a.b IS NOT NULL THEN greatest(r.till - {overlap}, a.e - {size}) END AS least
        FROM reach r LEFT JOIN atom a ON a.key = r.key AND a.run = r.run AND a.b = r.till),
hop AS (SELECT n.key, n.run, n.b, n.till, a.b AS after FROM nxt n ASOF LEFT JOIN atom a ON n.key = a.key AND n.run = a.run AND n.least <= a.b),
walk AS (SELECT h.* FROM hop h JOIN (SELECT key, run, min(b) AS b FROM atom GROUP BY key, run) f ON h.key = f.key AND h.run = f.run AND h.b = f.b
         UNION ALL SELECT h.* FROM walk w JOIN hop h ON h.key = w.key AND h.run = w.run AND h.b = w.after),
wide AS (SELECT key, b, length(t) AS n FROM worded WHERE length(t) >= {size}),
span AS (SELECT key, b, till AS e FROM walk
         UNION ALL SELECT key, b + k * {size - overlap}, least(b + k * {size - overlap} + {size}, b + n)
         FROM (SELECT *, unnest(range(0, greatest(1, ceil((n - {overlap}) / {size - overlap}.0))::BIGINT)) AS k FROM wide)),
raw AS (SELECT s.key, s.b, substr(d.text, s.b::BIGINT + 1, (s.e - s.b)::BIGINT) AS t FROM span s JOIN {source} d ON d.key = s.key),
chunk AS (SELECT key, (row_number() OVER (PARTITION BY key ORDER BY b) - 1)::BIGINT AS piece,
                 (b + length(t) - length(ltrim(t, ' ' || chr(10))))::BIGINT AS start_index, trim(t, ' ' || chr(10)) AS text
          FROM raw WHERE trim(t, ' ' || chr(10)) <> '')"""


def _overlap(chunks: str, n: int = 100) -> str:
    """CTE ``lapped`` from ``chunks`` (batch_id, ord, text)."""
    before = f"right(lag(text) OVER w, {n})" if n else "lag(text) OVER w"
    return f"""lapped AS (SELECT * EXCLUDE (text), count(*) OVER (PARTITION BY batch_id) AS total,
  CASE WHEN lag(ord) OVER w IS NULL THEN '' ELSE {before} || chr(10) END || text
  || CASE WHEN lead(ord) OVER w IS NULL THEN '' ELSE chr(10) || left(lead(text) OVER w, {n}) END AS text
  FROM {chunks} WINDOW w AS (PARTITION BY batch_id ORDER BY ord))"""


def _fold(units: str, most: int = 1500) -> str:
    """CTEs to ``folded`` from ``units`` (batch_id, k from 1, ord, sub, small, text)."""
    return f"""
fold AS (SELECT batch_id, k, 1 AS grp, length(text)::BIGINT AS n FROM {units} WHERE k = 1
         UNION ALL SELECT u.batch_id, u.k, CASE WHEN u.small AND f.n + 1 + length(u.text) <= {most} THEN f.grp ELSE f.grp + 1 END,
                          CASE WHEN u.small AND f.n + 1 + length(u.text) <= {most} THEN f.n + 1 + length(u.text) ELSE length(u.text) END
                   FROM fold f JOIN {units} u ON u.batch_id = f.batch_id AND u.k = f.k + 1),
folded AS (SELECT u.batch_id, arg_min(u.ord, u.k)::BIGINT AS ord, arg_min(u.sub, u.k)::BIGINT AS sub, string_agg(u.text, chr(10) ORDER BY u.k) AS text
           FROM fold f JOIN {units} u ON u.batch_id = f.batch_id AND u.k = f.k GROUP BY u.batch_id, f.grp)"""


_DOC = "doc AS (SELECT doc_id AS key, coalesce(text, '') AS text FROM documents)"


def _pipeline(batch: str) -> str:
    """Fixed chunks are at most 1202 long with their context, so none is split again."""
    return f"""WITH RECURSIVE {_DOC}, {_fixed("doc")},
placed AS MATERIALIZED (SELECT d.{batch} AS batch_id, row_number() OVER (PARTITION BY d.{batch} ORDER BY c.key, c.piece) - 1 AS ord, c.text
           FROM chunk c JOIN documents d ON d.doc_id = c.key),
{_overlap("placed")},
unit AS MATERIALIZED (SELECT batch_id, ord + 1 AS k, ord, 0 AS sub, length(text) < 200 AS small, text FROM lapped), {_fold("unit")}"""


_KINDS = "CASE event_type WHEN 'click' THEN 'message' WHEN 'purchase' THEN 'save' WHEN 'view' THEN 'load' WHEN 'signup' THEN '{0}' WHEN 'error' THEN 'error' END"


def _log(signup: str = "delete") -> str:
    return f"""log AS (SELECT user_id AS session_id, event_id AS seq, {_KINDS.format(signup)} AS kind, (props->>'$.k')::BIGINT AS conv_id FROM events),
done AS (
  SELECT *, lag(seq) OVER w AS set_seq, lag(conv_id) OVER w AS now FROM log l
  WHERE kind = 'save' OR kind = 'load' AND EXISTS (
    SELECT 1 FROM log s WHERE s.session_id = l.session_id AND s.conv_id = l.conv_id AND s.kind = 'save' AND s.seq < l.seq AND NOT EXISTS (
      SELECT 1 FROM log x WHERE x.session_id = l.session_id AND x.seq > s.seq AND x.seq < l.seq AND (x.kind = 'clear' OR x.kind = 'delete' AND x.conv_id = s.conv_id)))
  WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
put AS (
  SELECT session_id, conv_id, seq FROM log WHERE kind = 'save' UNION ALL
  SELECT session_id, now, seq FROM done d WHERE kind = 'load' AND set_seq IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM log x WHERE x.session_id = d.session_id AND x.seq > d.set_seq AND x.seq < d.seq AND (x.kind = 'clear' OR x.kind = 'delete' AND x.conv_id = d.now))),
history AS (
  SELECT s.session_id, s.conv_id, min(s.seq) AS first_seq, max(s.seq) AS last_seq FROM put s
  WHERE NOT EXISTS (SELECT 1 FROM log x WHERE x.session_id = s.session_id AND x.seq > s.seq
                    AND (x.kind = 'clear' OR x.kind = 'delete' AND x.conv_id = s.conv_id))
  GROUP BY s.session_id, s.conv_id)"""


# Of sessions in which new chats and new files save the conversation that they end.
_RESETS = """log AS (SELECT ts, user_id AS session_id, event_id AS seq, (props->>'$.k')::BIGINT AS conv_id,
  CASE event_type WHEN 'click' THEN 'message' WHEN 'purchase' THEN 'save' WHEN 'view' THEN 'ingest' WHEN 'signup' THEN 'discard' WHEN 'error' THEN 'new' END AS kind FROM events),
put AS (SELECT session_id, conv_id, max(seq) AS last_seq FROM log WHERE kind = 'save' OR kind IN ('new', 'ingest') AND conv_id IS NOT NULL GROUP BY session_id, conv_id)"""

_NEAR = """near AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)), 9) AS d
  FROM v q JOIN v ON q.vec_id % 100 = 0),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM near) WHERE rank <= 5)"""
_ALL = f"WITH v AS (SELECT * FROM embeddings), {_NEAR}"
_WITH_DOC = f"WITH v AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)), {_NEAR}"
_CONTEXT = "context AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM ranked JOIN documents ON doc_id = vec_id GROUP BY query_id)"
_KEYS = f"WITH k AS (SELECT doc_id, lang, {_FP.format('text')} AS content_fp FROM documents)"
_BUCKET = "(ascii(substr(md5(token), 1, 1)) * 16 + ascii(substr(md5(token), 2, 1))) % 64"
_REPORT = f"""{_pipeline("doc_id")}, n AS (SELECT batch_id, count(*) AS num_chunks FROM folded GROUP BY batch_id),
report AS (SELECT doc_id AS batch_id, 'fixed' AS strategy, coalesce(num_chunks, 0) AS num_chunks, 1250::BIGINT AS took_ms, false AS cache_hit, left({_FP.format('text')}, 8) AS content_hash,
       left({_CFG.format("'fixed'", "1000", "100")}, 8) AS config_hash, 1000::BIGINT AS chunk_size, 100::BIGINT AS overlap, 200::BIGINT AS min_size, 1500::BIGINT AS max_size, NULL::VARCHAR AS error
FROM documents LEFT JOIN n ON batch_id = doc_id)"""

_SEMANTIC = rf"""WITH RECURSIVE
s AS (SELECT key, t, i FROM (SELECT doc_id AS key, unnest(string_split(regexp_replace(coalesce(text, ''), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1))) AS t,
      generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM documents)),
tok AS (SELECT key, i, {_BUCKET} AS bucket, count(*) AS n FROM (SELECT key, i, unnest(regexp_split_to_array(t, '\s+')) AS token FROM s) WHERE token <> '' GROUP BY ALL),
win AS (SELECT key, j AS i, bucket, sum(n)::BIGINT AS n FROM (SELECT key, unnest([i - 1, i, i + 1]) AS j, bucket, n FROM tok) GROUP BY ALL),
sq AS (SELECT key, i, sum(n * n) AS q FROM win GROUP BY ALL),
dot AS (SELECT a.key, a.i, sum(a.n * b.n) AS p FROM win a JOIN win b ON a.key = b.key AND b.i = a.i + 1 AND a.bucket = b.bucket GROUP BY ALL),
pairs AS (SELECT x.key, x.i FROM s x JOIN s y ON x.key = y.key AND y.i = x.i + 1),
dist AS (SELECT p.key, p.i, CASE WHEN a.q * b.q > 0 THEN round(1 - coalesce(dot.p, 0) / sqrt((a.q * b.q)::DOUBLE), 9) ELSE 1 END AS d
         FROM pairs p LEFT JOIN sq a ON a.key = p.key AND a.i = p.i LEFT JOIN sq b ON b.key = p.key AND b.i = p.i + 1
         LEFT JOIN dot ON dot.key = p.key AND dot.i = p.i),
cut AS (SELECT key, i FROM (SELECT *, quantile_cont(d, 0.85) OVER (PARTITION BY key) AS limit_ FROM dist) WHERE d > limit_),
g AS (SELECT s.key, s.i, s.t, (SELECT count(*) FROM cut WHERE cut.key = s.key AND cut.i < s.i) + 1 AS g FROM s),
grp AS MATERIALIZED (SELECT key, g, string_agg(t, ' ' ORDER BY i) AS t FROM g GROUP BY key, g),
fold AS (SELECT key, g, 1 AS c, length(t)::BIGINT AS n FROM grp WHERE g = 1
         UNION ALL SELECT x.key, x.g, CASE WHEN f.n >= 200 THEN f.c + 1 ELSE f.c END, CASE WHEN f.n >= 200 THEN length(x.t) ELSE f.n + 1 + length(x.t) END
                   FROM fold f JOIN grp x ON x.key = f.key AND x.g = f.g + 1),
made AS (SELECT f.key, f.c, string_agg(x.t, ' ' ORDER BY x.g) AS text FROM fold f JOIN grp x ON x.key = f.key AND x.g = f.g GROUP BY f.key, f.c)
SELECT key AS doc_id, (c - 1)::BIGINT AS piece,
       coalesce(sum(length(text)) OVER (PARTITION BY key ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_index, text FROM made"""


def _answers(scope: str) -> str:
    """Answers from the documents that fit ``scope``."""
    return rf"""WITH tok AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS token, false AS asked FROM documents
          UNION ALL SELECT doc_id, unnest(regexp_split_to_array({_TITLE.format('text')}, '\s+')), true FROM documents WHERE doc_id % 100 = 0),
        b AS (SELECT doc_id, asked, {_BUCKET} AS bucket, count(*) AS n FROM tok WHERE token <> '' GROUP BY ALL),
        v AS (SELECT doc_id, text, source, coalesce((SELECT sum(n * n) FROM b WHERE b.doc_id = documents.doc_id AND NOT asked), 0) AS sq FROM documents),
        dot AS (SELECT q.doc_id AS query_id, b.doc_id, sum(q.n * b.n) AS p FROM b q JOIN b USING (bucket) WHERE q.asked AND NOT b.asked GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS rank FROM (
          SELECT q.doc_id AS query_id, v.doc_id, v.text, v.sq - 2 * coalesce(p, 0) AS d FROM (SELECT doc_id, source FROM documents WHERE doc_id % 100 = 0) q JOIN v ON {scope}
          LEFT JOIN dot ON dot.query_id = q.doc_id AND dot.doc_id = v.doc_id)),
        context AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM ranked WHERE rank <= 5 GROUP BY query_id),
        c AS (SELECT query_id, context, {_TITLE.format('text')} AS question FROM context JOIN documents ON doc_id = query_id)
        SELECT query_id, question, context, (length('Use only the passages below. If they do not hold the answer, say that you do not know.') + 12 + length(context) + 12 + length(question) + 9) || ' characters.' AS answer FROM c"""


ORACLES = {
    "scan_pages": "SELECT source AS batch_id, doc_id AS page_no, length(text)::BIGINT AS n_chars FROM documents",
    "batch_text": "SELECT doc_id AS batch_id, len(string_split(text, chr(10)))::BIGINT AS n_pages, text FROM documents",
    "content_fingerprint": f"SELECT doc_id, {_FP.format('text')} AS content_fp FROM documents",
    "config_fingerprint": f"""SELECT l_orderkey, l_linenumber, md5(['hybrid', 'semantic', 'fixed'][l_linenumber % 3 + 1] || '_' || (round_even((500 + l_partkey % 1501) / 100.0, 0) * 100)::BIGINT
        || '_' || (round_even((l_suppkey % 301) / 25.0, 0) * 25)::BIGINT || '_' || (50 + l_orderkey % 50)) AS config_fp FROM lineitem""",
    "empty_batches": f"""SELECT doc_id, content_fp FROM (SELECT doc_id, text, {_FP.format("CASE WHEN doc_id % 10 > 0 THEN text END")} AS content_fp FROM documents)
        WHERE content_fp = md5('')""",
    "chunk_sizes": "SELECT doc_id, length(text)::BIGINT AS n_chars FROM documents",
    "fixed_chunks": f"WITH RECURSIVE {_DOC}, {_fixed('doc')} SELECT key AS doc_id, piece, start_index, text FROM chunk",
    "fixed_chunks_sql": f"WITH RECURSIVE {_DOC}, {_fixed('doc')} SELECT key AS doc_id, piece, start_index, text FROM chunk",
    "semantic_chunks": _SEMANTIC,
    "semantic_chunks_by_sentence": _SEMANTIC,
    "semantic_fallback": f"""SELECT * FROM ({_SEMANTIC}) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE text LIKE '%ß%' AND regexp_matches(text, '[.?!]\\s'))
        UNION ALL SELECT * FROM (WITH RECURSIVE {_DOC}, {_fixed('doc')} SELECT key AS doc_id, piece, start_index, text FROM chunk)
        WHERE doc_id IN (SELECT doc_id FROM documents WHERE text LIKE '%ß%' AND regexp_matches(text, '[.?!]\\s'))""",
    "emergency_chunks": f"WITH RECURSIVE {_DOC}, {_fixed('doc')} SELECT key AS doc_id, piece, text, 'RuntimeError: no chunks today' AS error FROM chunk",
    "scan_uploads": "SELECT source, length(text)::BIGINT AS n_chars, md5(text) AS text_md5, NULL::VARCHAR AS error FROM documents WHERE text <> ''",
    "scan_uploads_sql": "SELECT source, length(text)::BIGINT AS n_chars, md5(text) AS text_md5, NULL::VARCHAR AS error FROM documents WHERE text <> ''",
    "hybrid_route": """SELECT doc_id, 'hybrid' AS strategy_requested, s AS strategy_executed, s AS strategy_reported, n AS n_pages
        FROM (SELECT doc_id, n, CASE WHEN n <= 5 THEN 'semantic' ELSE 'fixed' END AS s FROM (SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n FROM documents))""",
    **{
        name: f"""WITH p AS (SELECT source AS batch_id, doc_id AS page_no, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ord, text FROM documents),
        {_overlap('p', n)} SELECT batch_id, page_no, CASE WHEN total > 1 THEN ord END AS chunk_index, CASE WHEN total > 1 THEN total END AS total_chunks, text FROM lapped"""
        for name, n in (("overlap_context", 100), ("overlap_zero_compat", 0))
    },
    "size_merge": f"""WITH RECURSIVE unit AS MATERIALIZED (
        SELECT batch_id, k, k - 1 AS ord, 0 AS sub, length(text) < 200 AS small, text FROM (
          SELECT doc_id AS batch_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)),
        {_fold('unit', 100_000)} SELECT batch_id, ord AS page_no, sub, text FROM folded""",
    "size_filter_full": f"""WITH RECURSIVE doc AS (SELECT doc_id AS key, text FROM documents WHERE length(text) > 1500), {_fixed('doc')},
        part AS (SELECT doc_id, source, 0 AS sub, length(text) < 200 AS small, text FROM documents WHERE length(text) <= 1500
                 UNION ALL SELECT key, source, piece, false, chunk.text FROM chunk JOIN documents ON doc_id = key),
        unit AS MATERIALIZED (SELECT source AS batch_id, row_number() OVER (PARTITION BY source ORDER BY doc_id, sub) AS k, doc_id AS ord, sub, small, text FROM part),
        {_fold('unit')} SELECT batch_id, ord AS page_no, sub, text FROM folded""",
    "chunk_pipeline": f"{_pipeline('source')} SELECT batch_id, ord, sub, text FROM folded",
    "chunk_stats": f"""{_pipeline('doc_id')} SELECT batch_id AS doc_id, count(*) AS n_chunks, min(length(text))::BIGINT AS least,
        max(length(text))::BIGINT AS most, sum(length(text))::BIGINT AS total FROM folded GROUP BY batch_id""",
    "run_measured": f"""{_pipeline('doc_id')}, single AS (SELECT key FROM chunk GROUP BY key HAVING count(*) = 1)
        SELECT count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars, min(length(text))::BIGINT AS least, max(length(text))::BIGINT AS most,
        count(*) FILTER (batch_id NOT IN (SELECT key FROM single)) AS n_enhanced, true AS took_time FROM folded""",
    "run_report": f"{_REPORT} SELECT * FROM report",
    "run_report_cached": f"""{_REPORT}, hit AS (SELECT a.doc_id FROM documents a WHERE {_FP.format('a.text')} IN (SELECT {_FP.format('text')} FROM documents WHERE lang = 'en'))
        SELECT batch_id, CASE WHEN h THEN 'cached' ELSE strategy END AS strategy, num_chunks, CASE WHEN h THEN 100 ELSE took_ms END::BIGINT AS took_ms, h AS cache_hit, content_hash, config_hash,
        CASE WHEN NOT h THEN chunk_size END AS chunk_size, CASE WHEN NOT h THEN overlap END AS overlap, CASE WHEN NOT h THEN min_size END AS min_size,
        CASE WHEN NOT h THEN max_size END AS max_size, error FROM (SELECT *, batch_id IN (SELECT doc_id FROM hit) AS h FROM report)""",
    "run_report_emergency": f"""WITH RECURSIVE {_DOC}, {_fixed('doc')}, n AS (SELECT key, count(*) AS num_chunks FROM chunk GROUP BY key)
        SELECT doc_id AS batch_id, 'emergency_fallback' AS strategy, coalesce(num_chunks, 0) AS num_chunks, 1250::BIGINT AS took_ms, false AS cache_hit,
        left({_FP.format('text')}, 8) AS content_hash, left({_CFG.format("'fixed'", "1000", "100")}, 8) AS config_hash, NULL::BIGINT AS chunk_size, NULL::BIGINT AS overlap,
        NULL::BIGINT AS min_size, NULL::BIGINT AS max_size, 'RuntimeError: no chunks today' AS error FROM documents LEFT JOIN n ON key = doc_id""",
    "run_report_text": f"""{_REPORT} SELECT batch_id, array_to_string(['Strategy: ' || strategy, 'Chunks: ' || num_chunks, 'Time: 1.3s', 'Cache: miss', 'Content: ' || content_hash,
        'Config: ' || config_hash, 'Size: 1000', 'Overlap: 100'], chr(10)) AS text FROM report""",
    "cache_key": f"{_KEYS} SELECT doc_id, content_fp, {_CFG.format(chr(39) + 'fixed' + chr(39), '1000', '100')} AS config_fp FROM k",
    "cache_hits": f"{_KEYS} SELECT doc_id, content_fp FROM k SEMI JOIN (SELECT content_fp FROM k WHERE lang = 'en') c USING (content_fp)",
    "cache_misses": f"{_KEYS} SELECT doc_id, content_fp FROM k ANTI JOIN (SELECT content_fp FROM k WHERE lang = 'en') c USING (content_fp)",
    "cache_info": f"""SELECT count(*) AS cache_files, round(sum(n) / 1048576, 6) AS total_size_mb
        FROM (SELECT {_FP.format('text')} AS fp, arg_min(octet_length(encode(text)), doc_id) AS n FROM documents GROUP BY fp)""",
    "cache_clear": f"""WITH held AS (SELECT count(*) AS cache_files, round(sum(n) / 1048576, 6) AS total_size_mb
          FROM (SELECT {_FP.format('text')} AS fp, arg_min(octet_length(encode(text)), doc_id) AS n FROM documents GROUP BY fp))
        SELECT step, CASE WHEN step IN (1, 2) THEN cache_files ELSE 0 END AS cache_files, CASE WHEN step IN (1, 2) THEN total_size_mb ELSE 0 END AS total_size_mb, true AS same_dir FROM held, range(0, 4) a(step)""",
    "cache_evicted": f"""WITH k AS (SELECT doc_id, lang, text, {_FP.format('text')} AS fp FROM documents),
        put AS (SELECT fp, CASE lang WHEN 'de' THEN 1000 WHEN 'en' THEN 2000 WHEN 'es' THEN 3000 WHEN 'fr' THEN 4000 END AS made, octet_length(encode(arg_min(text, doc_id)))::BIGINT AS n
                FROM k WHERE lang IN ('de', 'en', 'es', 'fr') GROUP BY fp, lang),
        entry AS (SELECT fp, min(made) AS made, arg_min(n, made) AS n FROM put GROUP BY fp),
        used AS (SELECT entry.*, greatest(made, CASE WHEN fp IN (SELECT fp FROM k WHERE doc_id % 10 = 0) THEN 5000 ELSE 0 END) AS last_used FROM entry),
        summed AS (SELECT *, last_used < 2500 AS old, sum(CASE WHEN last_used < 2500 THEN 0 ELSE n END) OVER (ORDER BY last_used DESC, fp) AS total FROM used)
        SELECT fp AS content_fp, n AS bytes, last_used::BIGINT AS last_used, CASE WHEN old THEN 'age' ELSE 'size' END AS reason FROM summed WHERE old OR total > 1000000""",
    "size_labels": """SELECT doc_id, ((37 * n * 10 + 524288) // 1048576 // 10) || '.' || ((37 * n * 10 + 524288) // 1048576 % 10) || ' MB' AS size,
        ((n + 50) // 100 // 10) || '.' || ((n + 50) // 100 % 10) || 's' AS time FROM (SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents)""",
    "hash_embed": rf"""SELECT doc_id, {_BUCKET}::BIGINT AS bucket, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents) WHERE token <> '' GROUP BY doc_id, bucket""",
    "embed_chunks": rf"""WITH RECURSIVE {_DOC}, {_fixed('doc')},
        b AS (SELECT key, start_index, {_BUCKET} AS bucket, count(*) AS n
              FROM (SELECT key, start_index, unnest(regexp_split_to_array(text, '\s+')) AS token FROM chunk) WHERE token <> '' GROUP BY ALL)
        SELECT key AS doc_id, start_index, sum(n)::BIGINT AS n_tokens, sum(n * n)::BIGINT AS norm_sq FROM b GROUP BY key, start_index""",
    "vector_topk": """SELECT vec_id, round(d, 6) AS distance FROM (
        SELECT v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)), 9) AS d
        FROM embeddings v, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY d, v.vec_id LIMIT 5)""",
    "vector_topk_batch": f"{_ALL} SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM ranked",
    "vector_topk_indexed": f"{_ALL} SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM ranked",
    "vector_topk_in_batch": """WITH near AS (
        SELECT q.label, q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)), 9) AS d
        FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.label IS NOT DISTINCT FROM v.label)
        SELECT label::BIGINT AS label, query_id, rank, vec_id, round(d, 6) AS distance
        FROM (SELECT *, row_number() OVER (PARTITION BY label, query_id ORDER BY d, vec_id) AS rank FROM near) WHERE rank <= 5""",
    "retrieve_context": f"{_WITH_DOC} SELECT query_id, rank, vec_id, text FROM ranked JOIN documents ON doc_id = vec_id",
    "build_context": f"{_WITH_DOC}, {_CONTEXT} SELECT query_id, context FROM context",
    "build_prompt": f"""{_WITH_DOC}, {_CONTEXT} SELECT query_id,
        'Use only the passages below. If they do not hold the answer, say that you do not know.' || chr(10) || chr(10) || 'Passages:' || chr(10) || context
        || chr(10) || chr(10) || 'Question: ' || {_TITLE.format('text')} || chr(10) || chr(10) || 'Answer:' AS prompt FROM context JOIN documents ON doc_id = query_id""",
    "answers": _answers("true"),
    "answers_in_batch": _answers("q.source IS NOT DISTINCT FROM v.source"),
    "extract_answer": """SELECT conv_id, turn, trim(string_split(CASE WHEN role = 'assistant' THEN 'Answer: no. Answer: ' || chr(10) || text || ' ' || chr(10) ELSE text END, 'Answer:')[-1],
        ' ' || chr(10) || chr(9) || chr(13)) AS answer FROM conversations""",
    "conversation_messages": "SELECT conv_id, turn, role, text AS content, role = 'assistant' AND coalesce(starts_with(text, 'Error:'), false) AS is_error FROM conversations",
    "chat_titles": f"""SELECT conv_id, {_TITLE.format('t')} AS title, {_TITLE.format('u')} AS user_title, left(t, 30) || '...' AS error_title
        FROM (SELECT conv_id, arg_min(text, turn) AS t, arg_min(text, turn) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id)""",
    "conversation_snapshot": f"""SELECT conv_id, n_messages, {_TITLE.format('t')} AS title, last_role, n_chars FROM (SELECT conv_id, count(*) AS n_messages,
        arg_min(text, turn) AS t, arg_max(role, turn) AS last_role, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id)""",
    "load_conversation": f"""WITH {_log()} SELECT conv_id, turn, role, text AS content, role = 'assistant' AND coalesce(starts_with(text, 'Error:'), false) AS is_error
        FROM conversations WHERE conv_id IN (SELECT conv_id FROM history)""",
    "conversation_state": f"""WITH {_log('clear')},
        cur AS (SELECT session_id, arg_max(conv_id, seq) AS conv_id, max(seq) AS seq FROM done GROUP BY session_id),
        m AS (SELECT session_id, count(*) FILTER (kind = 'message') AS n_messages, max(seq) FILTER (kind = 'clear') AS cleared FROM log GROUP BY session_id)
        SELECT m.session_id, n_messages, (SELECT count(*) FROM history h WHERE h.session_id = m.session_id) AS n_saved,
               CASE WHEN cur.seq > coalesce(cleared, -1) THEN cur.conv_id END AS conv_id FROM m LEFT JOIN cur ON cur.session_id = m.session_id""",
    "delete_conversation": f"""WITH {_log()} SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_seq) - 1 AS position,
        count(*) OVER (PARTITION BY session_id) AS n_saved FROM history""",
    "clear_history": f"WITH {_log('clear')} SELECT * FROM history",
    "recent_conversations": f"""WITH {_log()}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_seq) AS pos, count(*) OVER (PARTITION BY session_id) AS n_saved FROM history),
        cur AS (SELECT session_id, arg_max(conv_id, seq) AS conv_id, max(seq) AS seq FROM done GROUP BY session_id)
        SELECT p.session_id, p.conv_id, pos - greatest(n_saved - 5, 0) AS shown, n_saved, coalesce(cur.conv_id = p.conv_id AND NOT EXISTS (
          SELECT 1 FROM log x WHERE x.session_id = p.session_id AND x.conv_id = p.conv_id AND x.kind = 'delete' AND x.seq > cur.seq), false) AS is_current
        FROM p LEFT JOIN cur ON cur.session_id = p.session_id WHERE pos > n_saved - 5""",
    "session_resets": f"""WITH {_RESETS}, cur AS (SELECT session_id, arg_max(conv_id, seq) AS conv_id, max(seq) AS seq FROM log WHERE kind = 'save' GROUP BY session_id),
        m AS (SELECT session_id, count(*) FILTER (kind = 'message') AS n_messages, max(seq) FILTER (kind IN ('new', 'ingest', 'discard')) AS ended FROM log GROUP BY session_id)
        SELECT m.session_id, n_messages, (SELECT count(*) FROM put WHERE put.session_id = m.session_id) AS n_saved, CASE WHEN cur.seq > coalesce(ended, -1) THEN cur.conv_id END AS conv_id
        FROM m LEFT JOIN cur ON cur.session_id = m.session_id""",
    "saved_conversations": f"""WITH {_RESETS}, c AS (SELECT conv_id, {_TITLE.format('arg_min(text, turn)')} AS title, count(*) AS n_messages,
          string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)
        SELECT put.session_id, put.conv_id, strftime(log.ts, '%H:%M %d/%m') AS saved_at, title, n_messages, messages
        FROM put JOIN log ON log.seq = put.last_seq JOIN c ON c.conv_id = put.conv_id""",
    "error_turns": f"""WITH {_log()} SELECT session_id, count(*) AS n_errors, count(*) FILTER (seq > coalesce(saved, -1)) AS n_unsaved
        FROM (SELECT *, max(CASE WHEN kind = 'save' THEN seq END) OVER (PARTITION BY session_id) AS saved FROM log) WHERE kind = 'error' GROUP BY session_id""",
    "event_time_label": "SELECT event_id, strftime(ts, '%H:%M %d/%m') AS label FROM events",
    "safe_label": "SELECT event_id, translate(strftime(ts, '%H:%M %d/%m'), '/ :', '___') AS label FROM events",
}
