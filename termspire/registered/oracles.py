"""For each registered query, SQL over the given tables that returns the same rows.

The given tables hold no index, so each statement starts from the derivation of one.
"""

from __future__ import annotations

from termspire.registered.fixtures import (
    ABSENT_WORDS,
    BUCKET_BYTES,
    MAX_BUCKETS,
    PROBE_QUERIES,
    PROBE_TERMS,
    SAMPLE_QUERIES,
    SAMPLE_SEED,
    SAMPLE_SIZE,
)

# Fixed value: the separators of functions.text, the quote doubled for SQL.
_SEPARATORS = r"""'[0-9!@#$%^&*()_+={}\[\]:;<>,.?~\\/|''"`-]+'"""


def _normalised(text: str) -> str:
    cleaned = f"regexp_replace(lower(strip_accents({text})), {_SEPARATORS}, ' ', 'g')"
    return rf"string_split_regex({cleaned}, '\s+')"


def _whitespace(text: str) -> str:
    return rf"string_split_regex({text}, '[ \t\n\f\r]+')"


def _index(table: str = "documents", docid: str = "doc_id", name: str = "'d' || doc_id") -> str:
    """CTEs cap, tok, post, dict, docs, stats, postings. Each row of the table is one capture."""
    return f"""
    cap AS MATERIALIZED (
      SELECT row_number() OVER () AS cap, {docid} AS docid, {name} AS name, text FROM {table}),
    tok AS MATERIALIZED (
      SELECT cap, docid, term
      FROM (SELECT cap, docid, unnest({_normalised('text')}) AS term FROM cap) WHERE term <> ''),
    post AS MATERIALIZED (
      SELECT cap, docid, term, count(*) AS tf FROM tok GROUP BY cap, docid, term),
    dict AS MATERIALIZED (
      SELECT term, row_number() OVER (ORDER BY term) - 1 AS termid, count(*) AS df,
             (ascii(term[1]) // 10)::BIGINT AS crange
      FROM post GROUP BY term),
    docs AS MATERIALIZED (
      SELECT cap.docid, cap.name, coalesce(n, 0) AS len
      FROM cap LEFT JOIN (SELECT cap, count(*) AS n FROM tok GROUP BY cap) USING (cap)),
    stats AS MATERIALIZED (SELECT count(*) AS num_docs, avg(len) AS avgdl FROM docs),
    postings AS MATERIALIZED (
      SELECT d.termid, p.docid, p.tf FROM post p JOIN dict d USING (term))"""


_DOCUMENTS = _index()
_TURNS = _index("conversations", "conv_id", "'c' || conv_id || '-' || turn")
_CORRECTED = """
    cpostings AS MATERIALIZED (
      SELECT termid, docid, max(tf) AS tf FROM postings GROUP BY termid, docid),
    cdict AS MATERIALIZED (
      SELECT d.term, d.termid, c.df
      FROM dict d JOIN (SELECT termid, count(*) AS df FROM cpostings GROUP BY termid) c USING (termid)),
    cdocs AS MATERIALIZED (
      SELECT d.docid, d.name, coalesce(c.len, 0)::BIGINT AS len
      FROM (SELECT docid, min(name) AS name FROM docs GROUP BY docid) d
      LEFT JOIN (SELECT docid, sum(tf) AS len FROM cpostings GROUP BY docid) c USING (docid)),
    cstats AS MATERIALIZED (SELECT count(*) AS num_docs, avg(len) AS avgdl FROM cdocs)"""


# How many documents each term loses by the correction.
_LOSS = """
    loss AS (
      SELECT after.term, after.df, before.df - after.df AS lost
      FROM cdict AS after INNER JOIN dict AS before USING (termid))"""
_SHIFT = f"""
    sized AS (
      SELECT (SELECT min(m) FROM (SELECT unnest(range(0, 62)) AS m)
              WHERE (1::BIGINT << m) >
                    top // greatest(least((16 * n) // {BUCKET_BYTES}, {MAX_BUCKETS}), 1)) AS s
      FROM (SELECT count(*) AS n, max(termid) AS top FROM postings))"""


def _values(queries: list[list[str]]) -> str:
    rows = [f"({qno}::BIGINT, '{term}')" for qno, terms in enumerate(queries) for term in terms]
    return f"q(qno, qterm) AS (VALUES {', '.join(rows)})"


_PROBES = _values(PROBE_QUERIES)
_BENCHMARK = f"""
    q AS MATERIALIZED (
      SELECT qno, qterm FROM (
        SELECT item_id AS qno, unnest({_normalised('text')}) AS qterm FROM benchmark)
      WHERE qterm <> '')"""
_TURN_WORDS = f"""
    q AS MATERIALIZED (
      SELECT qno, qterm FROM (
        SELECT conv_id * 1000 + turn AS qno, unnest({_whitespace('text')}) AS qterm
        FROM conversations) WHERE qterm <> '')"""
_LOG = r"""
    log AS (SELECT DISTINCT trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g')) AS QueryText
            FROM conversations)"""
_SAMPLE = f"""{_LOG},
    drawn AS (SELECT QueryText FROM log
              ORDER BY md5(QueryText || '{SAMPLE_SEED}'), QueryText LIMIT {SAMPLE_SIZE})"""
_SAMPLE_TERMS = f"""{_SAMPLE},
    q AS MATERIALIZED (
      SELECT qno, qterm FROM (
        SELECT row_number() OVER (ORDER BY QueryText) - 1 AS qno,
               unnest({_normalised('QueryText')}) AS qterm
        FROM drawn) WHERE qterm <> '')"""


def _hits(bag: bool = False, prefix: str = "") -> str:
    """CTEs wanted (qno, termid, df, idf) and hits: every posting of a wanted term, in every copy of
    its document, with the points it earns."""
    terms = "q" if bag else "(SELECT DISTINCT qno, qterm FROM q)"
    return f"""
    wanted AS MATERIALIZED (
      SELECT a.qno, t.termid, t.df, log(s.num_docs / (1 + t.df)) AS idf
      FROM {terms} a JOIN {prefix}dict t ON t.term = a.qterm, {prefix}stats s),
    hits AS MATERIALIZED (
      SELECT w.qno, e.docid, e.termid, w.idf * (e.tf * 2.5::DOUBLE) / (
               e.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (c.len / s.avgdl))) AS points
      FROM wanted w JOIN {prefix}postings e USING (termid) JOIN {prefix}docs c USING (docid),
           {prefix}stats s)"""


_SUMS = "totals AS (SELECT qno, docid, sum(points) AS score FROM hits GROUP BY ALL)"
_COLLAPSED_SUMS = """
    totals AS (
      SELECT qno, docid, sum(points) AS score
      FROM (SELECT DISTINCT qno, docid, points FROM hits) GROUP BY ALL)"""
_PER_TERM = """
    totals AS (
      SELECT DISTINCT qno, docid, score FROM (
        SELECT qno, docid, termid, sum(points) AS score FROM hits GROUP BY ALL))"""


def _named(k: int | None, prefix: str) -> str:
    if k is None:
        return f"""SELECT qno, docid, round(score, 6) AS bm25score, name
            FROM totals JOIN {prefix}docs USING (docid)"""
    return f"""SELECT qno, docid, round(score, 6) AS bm25score, name, row_number() OVER (
              PARTITION BY qno ORDER BY floor(score * 1e9 + 0.5) DESC, docid, name) AS rank
            FROM totals JOIN {prefix}docs USING (docid) QUALIFY rank <= {k}"""


def _ranking(k, queries=_PROBES, bag=False, sums=_SUMS, index=_DOCUMENTS, prefix=""):
    return f"WITH {index}, {queries}, {_hits(bag, prefix)}, {sums} {_named(k, prefix)}"


def _two_versions() -> str:
    """CTEs terms and entries: the dictionaries and the postings of documents and turns, side by side."""
    change = "CASE WHEN {0} IS NULL THEN 'gained' WHEN {1} IS NULL THEN 'lost' WHEN {0} = {1} THEN 'same' ELSE 'changed' END"
    sides = []
    for name, table, docid in (("before", "documents", "doc_id"), ("after", "conversations", "conv_id")):
        sides.append(f"""
    {name}_tok AS MATERIALIZED (
      SELECT cap, docid, term FROM (
        SELECT cap, docid, unnest({_normalised('text')}) AS term
        FROM (SELECT row_number() OVER () AS cap, {docid} AS docid, text FROM {table})) WHERE term <> ''),
    {name}_dict AS MATERIALIZED (
      SELECT term, count(*) AS df_{name} FROM (SELECT DISTINCT cap, term FROM {name}_tok) GROUP BY term),
    {name}_entry AS MATERIALIZED (
      SELECT term, docid, count(*) AS tf_{name} FROM {name}_tok GROUP BY term, docid)""")
    return f"""{", ".join(sides)},
    terms AS (
      SELECT term, df_before, df_after, {change.format('df_before', 'df_after')} AS change
      FROM before_dict FULL JOIN after_dict USING (term)),
    entries AS (
      SELECT term, docid, {change.format('tf_before', 'tf_after')} AS change
      FROM before_entry FULL JOIN after_entry USING (term, docid))"""


def oracle_sql() -> dict[str, str]:
    terms = ", ".join(f"'{t}'" for t in PROBE_TERMS)
    words = ", ".join(f"('{w}')" for w in [*ABSENT_WORDS, *PROBE_TERMS])
    two = _two_versions()
    docs, turns = f"WITH {_DOCUMENTS}", f"WITH {_TURNS}"
    fixed = f"{turns}, {_CORRECTED}"
    lookup = f"{docs} SELECT termid, df FROM dict WHERE term IN ({terms})"
    top20 = _ranking(20)
    web = [text.split() for text in SAMPLE_QUERIES]
    shift = """
      SELECT size::BIGINT AS bucket_bytes, (
        SELECT min(m) FROM (SELECT unnest(range(0, 20)) AS m)
        WHERE (1::BIGINT << m) > top // greatest((16 * n) // size, 1))::BIGINT AS shift
      FROM (VALUES (65536), (262144), (104857600)) sizes(size),
           (SELECT count(*) AS n, max(termid) AS top FROM postings)"""
    host = "regexp_extract(url, '^https?://([^/]+)/', 1)"
    language = "regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1)"
    return {
        "index_dict": f"{docs} SELECT term, termid, df, crange FROM dict",
        "index_postings": f"{docs} SELECT termid, docid, tf FROM postings",
        "index_docs": f"{docs} SELECT docid, name, len FROM docs",
        "index_stats": f"{docs} SELECT num_docs, round(avgdl, 6) AS avgdl FROM stats",
        "postings_with_lengths": f"""{docs} SELECT p.termid, p.docid, d.len
            FROM postings p JOIN docs d USING (docid)""",
        "shift_layout": f"""{docs} SELECT termid >> 12 AS thash, count(*) AS rows,
            min(termid) AS first_termid, max(termid) AS last_termid FROM postings GROUP BY 1""",
        "hash_layout": f"{docs} SELECT termid, 1::BIGINT AS buckets, df AS rows FROM dict",
        "shift_choice": f"{docs} {shift}",
        "shift_choice_by_dict": f"{docs} {shift}",
        "bucket_scan": f"""{docs} SELECT docid FROM postings
            WHERE termid = (SELECT termid FROM dict WHERE term = 'the')""",
        "shift_bucket_scan": f"""{docs}, {_SHIFT}
            SELECT count(*) AS rows, sum(tf)::BIGINT AS tokens FROM postings, sized
            WHERE (termid // (1::BIGINT << s)) =
                  (SELECT termid FROM dict WHERE term = 'the') // (1::BIGINT << s)""",
        "posting_bytes": f"{docs} SELECT count(*) AS postings, true AS packed FROM postings",
        "bucket_rows": f"""{docs}, {_SHIFT}
            SELECT termid // (1::BIGINT << s) AS thash, count(*) AS rows
            FROM postings, sized GROUP BY 1""",
        "file_layout": f"""{docs}, {_SHIFT}
            SELECT termid // (1::BIGINT << s) AS thash, count(*) AS rows,
                true AS has_files, true AS has_bytes
            FROM postings, sized GROUP BY 1""",
        "folder_scan": f"""SELECT 2024::INTEGER AS year, (page_id % 2 + 1)::INTEGER AS month,
            (page_id % 3 + 1)::INTEGER AS day, {language} AS language, count(*) AS records,
            count(DISTINCT {host}) AS ids FROM pages GROUP BY ALL""",
        "captures": f"""SELECT {host} AS id, page_id::VARCHAR AS record_id,
              regexp_extract(html, '<title>([^<]*)</title>', 1) AS title
            FROM pages WHERE page_id % 2 = 1 AND {language} = 'en' AND {host} = (
              SELECT {host} AS h FROM pages GROUP BY h ORDER BY count(*) DESC, h LIMIT 1)""",
        "catalog_ranking": top20,
        "catalog_raw_ranking": _ranking(20, index=_TURNS),
        "sql_ranking": f"""WITH {_DOCUMENTS}, {_PROBES}, {_hits()}, {_SUMS}
            SELECT qno, docid, round(score, 6) AS bm25score FROM totals""",
        "export_tables": f"""{docs}
            SELECT 'dict' AS table_name, count(*) AS rows, sum(df)::BIGINT AS total FROM dict
            UNION ALL SELECT 'docs', count(*), sum(len)::BIGINT FROM docs""",
        "tokenize_normalised": f"""SELECT qno, qterm FROM (
              SELECT qno, unnest({_normalised('text')}) AS qterm FROM (
                SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS qno, text
                FROM conversations)) WHERE qterm <> ''""",
        "tokenize_whitespace": f"""SELECT qno, qterm FROM (
              SELECT item_id AS qno, unnest({_whitespace('text')}) AS qterm FROM benchmark)
            WHERE qterm <> ''""",
        "tokenize_without_apostrophes": f"""SELECT qno, qterm FROM (
              SELECT page_id AS qno, unnest({_whitespace("replace(html, '''', '')")}) AS qterm
              FROM pages) WHERE qterm <> ''""",
        "token_lists": f"""SELECT count(term) AS terms,
              md5(coalesce(string_agg(term, ' ' ORDER BY i), '')) AS digest
            FROM (SELECT doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS i
                  FROM (SELECT doc_id, {_normalised('text')} AS ts FROM documents))
            WHERE term <> '' GROUP BY doc_id""",
        "query_log": f"WITH {_LOG} SELECT QueryText FROM log",
        "query_sample": f"WITH {_SAMPLE} SELECT QueryText FROM drawn",
        "sample_terms": f"WITH {_SAMPLE_TERMS} SELECT qno, qterm FROM q",
        "sql_tokenize": f"WITH {_SAMPLE_TERMS} SELECT qno, qterm FROM q",
        "sample_ranking": _ranking(1, _SAMPLE_TERMS),
        "lookup_batch": f"""WITH {_DOCUMENTS}, {_BENCHMARK}
            SELECT q.qno, d.term, d.termid, d.df, count(*) AS n
            FROM q JOIN dict d ON d.term = q.qterm GROUP BY ALL""",
        "lookup_in": lookup,
        "lookup_in_keyed": lookup,
        "lookup_or_keyed": lookup,
        "lookup_union": lookup,
        "lookup_union_keyed": lookup,
        "term_ids": f"""{docs}
            SELECT word, termid IS NOT NULL AS known, coalesce(termid, -1) AS termid
            FROM (SELECT DISTINCT word FROM (
                    SELECT unnest({_whitespace('text')}) AS word FROM benchmark) WHERE word <> '')
            LEFT JOIN dict ON term = word""",
        "docs_for_terms": f"""WITH {_PROBES}, word AS (SELECT DISTINCT qterm AS word FROM q)
            SELECT DISTINCT word.word, found.docid
            FROM (SELECT doc_id AS docid, unnest({_normalised('text')}) AS term FROM documents) AS found
            JOIN word ON word.word = found.term""",
        "unknown_queries": f"""{docs}, words AS (
              SELECT DISTINCT qterm FROM (
                SELECT unnest({_whitespace('text')}) AS qterm FROM conversations)
              WHERE qterm <> ''),
            numbered AS (
              SELECT row_number() OVER (ORDER BY qterm) - 1 AS qno, qterm FROM words)
            SELECT qno FROM numbered WHERE qterm NOT IN (SELECT term FROM dict)""",
        "bm25_all": _ranking(None),
        "bm25_top20": top20,
        "bm25_top15": _ranking(15, _values([["playing", "the", "on", "and"]])),
        "bm25_sorted": _ranking(None),
        "bm25_web_queries": _ranking(20, _values(web)),
        "bm25_benchmark": _ranking(20, _BENCHMARK),
        "bm25_benchmark_repeated": _ranking(20, _BENCHMARK, bag=True),
        "bm25_repeated_terms": _ranking(20, bag=True),
        "bm25_joined_buckets": top20,
        "bm25_all_buckets": top20,
        "bm25_hash_buckets": top20,
        "bm25_docs_join": top20,
        "term_scores": f"""WITH {_DOCUMENTS}, {_PROBES}, {_hits()}
            SELECT qno, docid, termid, round(points, 6) AS bm25termscore FROM hits""",
        "bm25_late_grouping": top20,
        "bm25_term_lists": _ranking(None, sums=_COLLAPSED_SUMS),
        "filtered_postings": f"""WITH {_DOCUMENTS}, {_PROBES}, {_hits()}
            SELECT DISTINCT qno, termid, docid, df, tf FROM wanted JOIN postings USING (termid)""",
        "bm25_filtered_postings": f"""WITH {_DOCUMENTS}, {_PROBES}, {_hits()}, {_SUMS}
            SELECT qno, docid, round(score, 6) AS bm25score FROM totals""",
        "bm25_per_term": _ranking(20, sums=_PER_TERM),
        "batch_best": _ranking(1, _BENCHMARK),
        "batch_report": f"""WITH {_DOCUMENTS}, {_TURN_WORDS},
            found AS (SELECT DISTINCT qno FROM q JOIN dict ON term = qterm)
            SELECT count(*) AS asked, count(f.qno) AS answered, count(*) - count(f.qno) AS skipped
            FROM (SELECT DISTINCT conv_id * 1000 + turn AS qno FROM conversations) a
            LEFT JOIN found f USING (qno)""",
        "batch_means": f"""WITH {_DOCUMENTS}, {_BENCHMARK}, {_hits()}, {_SUMS},
            placed AS (
              SELECT qno, score, row_number() OVER (PARTITION BY qno ORDER BY floor(score * 1e9 + 0.5) DESC, docid) AS rank
              FROM totals),
            each AS (SELECT qno, count(*) AS hits, max(score) AS best FROM placed WHERE rank <= 5 GROUP BY qno)
            SELECT (SELECT count(DISTINCT item_id) FROM benchmark) AS asked, count(*) AS answered,
              (SELECT count(DISTINCT item_id) FROM benchmark) - count(*) AS skipped, sum(hits)::BIGINT AS hits,
              round(avg(hits), 6) AS mean_hits, round(avg(best), 6) AS mean_best
            FROM each""",
        "duplicate_ids": f"""{turns}, per_id AS (SELECT docid, count(*) AS captures FROM docs GROUP BY docid)
            SELECT count(*) FILTER (captures > 1) AS ndup FROM per_id""",
        "corrected_dict": f"{fixed} SELECT term, termid, df FROM cdict",
        "corrected_docs": f"{fixed} SELECT docid, name, len FROM cdocs",
        "corrected_postings": f"{fixed} SELECT termid, docid, tf FROM cpostings",
        "corrected_stats": f"{fixed} SELECT num_docs, round(avgdl, 6) AS avgdl FROM cstats",
        "changed_lengths": f"""{fixed}
            SELECT docid, before.name, before.len,
                after.name AS corrected_name, after.len AS corrected_len
            FROM docs AS before INNER JOIN cdocs AS after USING (docid)
            WHERE after.len IS DISTINCT FROM before.len""",
        "changed_df": f"""{fixed}, {_LOSS}
            SELECT count(*) FILTER (lost <> 0) AS terms FROM loss""",
        "shrunk_count": f"""{fixed}, {_LOSS}
            SELECT count(*) FILTER (lost > 2) AS terms FROM loss""",
        "shrunk_terms": f"""{fixed}, {_LOSS}
            SELECT term, df FROM loss WHERE lost > 2""",
        "bm25_raw": _ranking(None, index=_TURNS),
        "bm25_raw_top20": _ranking(20, index=_TURNS),
        "bm25_corrected": _ranking(20, index=f"{_TURNS}, {_CORRECTED}", prefix="c"),
        "row_counts": f"""{docs} SELECT 'postings' AS table_name, count(*) AS row_count FROM postings
            UNION ALL SELECT 'dict', count(*) FROM dict
            UNION ALL SELECT 'docs', count(*) FROM docs
            UNION ALL SELECT 'stats', count(*) FROM stats""",
        "scan_report": f"""{docs}, {_SHIFT},
            hit AS (SELECT df FROM dict WHERE term = 'the'),
            many AS (SELECT count(DISTINCT termid // (1::BIGINT << s)) > 1 AS several FROM postings, sized)
            SELECT pruned_by, coalesce((SELECT df FROM hit), 0)::BIGINT AS found,
                several AND pruned_by <> 'none' AS fewer_files,
                several AND pruned_by <> 'none' AS fewer_bytes, several AND pruned_by <> 'none' AS fewer_rows
            FROM many, (VALUES ('constants'), ('join'), ('none')) kinds(pruned_by)""",
        "absent_words": f"""{docs}
            SELECT word, term IS NOT NULL AS known, term IS NOT NULL AS reads_rows
            FROM (VALUES {words}) given(word) LEFT JOIN dict ON term = word""",
        "segments": f"""{docs},
            part AS (
              SELECT doc_id AS docid, CASE WHEN lang = 'en' THEN 0 WHEN lang IS NULL THEN 2 ELSE 1 END AS segment
              FROM documents),
            entry AS (SELECT segment, termid FROM postings JOIN part USING (docid)),
            born AS (SELECT termid, min(segment) AS segment FROM entry GROUP BY termid)
            SELECT n::BIGINT AS segment, (SELECT count(*) FROM part WHERE segment = n) AS documents,
                (SELECT count(*) FROM entry WHERE segment = n) AS postings,
                (SELECT count(DISTINCT termid) FROM entry WHERE segment = n) AS terms,
                (SELECT count(*) FROM born WHERE segment = n) AS new_terms
            FROM (VALUES (0), (1), (2)) numbers(n)""",
        "bm25_block_max": _ranking(20, _BENCHMARK),
        "block_max_report": f"""WITH {_DOCUMENTS}, {_BENCHMARK}
            SELECT qno, sum(df)::BIGINT AS postings, true AS no_more, true AS fewer
            FROM (SELECT DISTINCT qno, qterm FROM q) JOIN dict ON term = qterm GROUP BY qno""",
        "changed_terms": f"""WITH {two}
            SELECT term, df_before, df_after, change FROM terms WHERE change <> 'same'""",
        "change_report": f"""WITH {two}
            SELECT 'dict' AS table_name, change, count(*) AS rows FROM terms GROUP BY change
            UNION ALL SELECT 'postings', change, count(*) FROM entries GROUP BY change""",
        "renumbered_postings": f"""{docs} SELECT term, 'same' AS change, count(*) AS postings, sum(tf)::BIGINT AS tokens
            FROM postings JOIN dict USING (termid) GROUP BY term""",
        "bm25_segments": _ranking(20, _BENCHMARK),
        "published_terms": f"""{docs} SELECT term, df, count(*) AS postings, sum(tf)::BIGINT AS tokens
            FROM postings JOIN dict USING (termid) GROUP BY ALL""",
        "compacted_postings": f"""{docs} SELECT term, df, count(*) AS postings, sum(tf)::BIGINT AS tokens,
              sum(docid)::BIGINT AS docids
            FROM postings JOIN dict USING (termid) GROUP BY ALL""",
        "store_row_counts": f"""{docs}
            SELECT 'postings' AS table_name, count(*) AS row_count, 'viewfs' AS scheme FROM postings
            UNION ALL SELECT 'dict', count(*), 'viewfs' FROM dict
            UNION ALL SELECT 'docs', count(*), 'viewfs' FROM docs
            UNION ALL SELECT 'stats', count(*), 'viewfs' FROM stats""",
        "sample_rows": f"{docs} SELECT docid, name, len FROM docs ORDER BY docid LIMIT 5",
    }
