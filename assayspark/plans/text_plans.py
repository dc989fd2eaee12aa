"""Search, text structure and caches over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayspark.functions import chem
from assayspark.functions import text as T
from assayspark.operators import evidence as E
from assayspark.operators import relational as R
from assayspark.operators import search as S
from assayspark.operators import sections as X

from .registry import Tables, query

QUERY = "the license of the that"
#: SQL of a count of a substring without overlap.
_COUNT = "(length(low) - length(replace(low, '{0}', ''))) // {1}"
_HITS = " + ".join(_COUNT.format(t, len(t)) for t in sorted(set(QUERY.split())))
_SEARCH = f"""
WITH d AS (SELECT doc_id, source, text, lower(text) AS low FROM documents), h AS (SELECT *, ({_HITS})::BIGINT AS hits FROM d)
SELECT doc_id, coalesce(trim(substr(list_filter(string_split(text, chr(10))[1:10], lambda x: starts_with(x, '# '))[1], 3)), '') AS title, hits,
       least(hits / 40.0::DOUBLE, 1.0::DOUBLE) AS score,
       try_cast(nullif(regexp_extract(text, '(?i)pages?[ \\t\\n\\r]*([0-9]+)(?:[ \\t\\n\\r]*[-–][ \\t\\n\\r]*([0-9]+))?', 1), '') AS INT) AS page_start,
       try_cast(coalesce(nullif(regexp_extract(text, '(?i)pages?[ \\t\\n\\r]*([0-9]+)(?:[ \\t\\n\\r]*[-–][ \\t\\n\\r]*([0-9]+))?', 2), ''),
                nullif(regexp_extract(text, '(?i)pages?[ \\t\\n\\r]*([0-9]+)(?:[ \\t\\n\\r]*[-–][ \\t\\n\\r]*([0-9]+))?', 1), '')) AS INT) AS page_end,
       substr(text, 1, 2000) AS snippet FROM h WHERE hits > 0"""


@query(_SEARCH)
def kb_keyword_search(t: Tables) -> DataFrame:
    return S.keyword_search(t.documents, QUERY)


@query(f"SELECT doc_id, score FROM ({_SEARCH}) ORDER BY score DESC, doc_id LIMIT 20")
def kb_search_top_k(t: Tables) -> DataFrame:
    return S.keyword_search(t.documents, QUERY, k=20).select("doc_id", "score")


@query(f"SELECT doc_id, title, hits FROM ({_SEARCH}) WHERE doc_id IN (1, 5, 8, 13, 21, 34)")
def kb_search_doc_filter(t: Tables) -> DataFrame:
    return S.keyword_search(t.documents, QUERY, only=[1, 5, 8, 13, 21, 34]).select("doc_id", "title", "hits")


@query(f"""
SELECT doc_id, ((row_number() OVER (ORDER BY hits DESC, doc_id) - 1) // 3)::INT AS batch FROM ({_SEARCH})""")
def result_micro_batches(t: Tables) -> DataFrame:
    from assayspark.streaming import logs

    found = S.keyword_search(t.documents, QUERY)
    return R.ranked(found, [F.desc("hits"), F.asc("doc_id")], "place").select("doc_id", logs.batch_no(F.col("place")).alias("batch"))


@query("""
SELECT p_partkey FROM part WHERE list_contains(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), 'ring')
   AND list_contains(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), 'small')""")
def molecule_text_search(t: Tables) -> DataFrame:
    return S.index_search(S.inverted_index(t.part, "p_partkey", ["p_name", "p_type"]), "p_partkey", "Small ring")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
m AS (SELECT *, CASE WHEN length(line) < 40 THEN line END AS head FROM l)
SELECT doc_id, line_no::INT AS line_no, md5(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no)) AS section FROM m""")
def section_carry_forward(t: Tables) -> DataFrame:
    rows = X.lines(t.documents)
    head = F.when(F.length("line") < 40, F.col("line"))
    return X.carried(rows, head).select("doc_id", "line_no", F.md5(F.col("carried").cast("binary")).alias("section"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
m AS (SELECT *, contains(line, '|') AS o, coalesce(lag(contains(line, '|')) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS p FROM l),
r AS (SELECT *, sum(CASE WHEN o AND NOT p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM m)
SELECT doc_id, run::BIGINT AS run, count(*) AS n_lines FROM r WHERE o GROUP BY 1, 2""")
def line_runs(t: Tables) -> DataFrame:
    return X.runs(X.lines(t.documents), F.contains("line", F.lit("|"))).groupBy("doc_id", "run").agg(F.count("*").alias("n_lines"))


@query("""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS b FROM documents),
s AS (SELECT doc_id, list_transform(range(1, (length(b) - 8 + 1)::BIGINT, 4), lambda i: b[i:i + 7]) AS s FROM d WHERE length(b) >= 200)
SELECT doc_id, len(list_distinct(s))::DOUBLE / len(s) AS ratio, len(list_distinct(s))::DOUBLE / len(s) < 0.25 AS degenerate FROM s""")
def degenerate_shingles(t: Tables) -> DataFrame:
    # A generator keeps the filter and both columns from computing the ratio again.
    d = t.documents.select("doc_id", F.explode(F.array(T.shingle_ratio(F.col("text")))).alias("ratio")).where("ratio IS NOT NULL")
    return d.select("doc_id", "ratio", (F.col("ratio") < 0.25).alias("degenerate"))


@query("""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10))[1:30], lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS l FROM documents),
u AS (SELECT doc_id, list_filter(l, lambda x: length(x) > 3 AND length(x) < 200 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT regexp_matches(x, '^\\([0-9]{1,3}\\)[ ]+')) AS u FROM l)
SELECT doc_id, coalesce(list_filter(u, lambda x: NOT regexp_matches(x, '^[A-Z][A-Z \\t&\\-,/]{4,}$'))[1], u[1]) AS title FROM u""")
def title_extract(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.title(F.col("text")).alias("title"))


@query("""
SELECT page_id, try_cast(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS INT) AS start,
       try_cast(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS INT) AS "end" FROM pages""")
def page_range_extract(t: Tables) -> DataFrame:
    r = T.page_range(F.replace("url", F.lit("page="), F.lit("page ")))
    return t.pages.select("page_id", r["start"].alias("start"), r["end"].alias("end"))


#: Lines of which some are headings: names in capitals with a dash or a sign, section names, plain names, blocked capitals.
_HEADS = ("upper(p_name)", "upper(replace(p_name, ' ', '-')) || ' & ' || upper(p_type)", "'Claims of ' || p_name", "p_name", "'BACKGROUND OF THE DISCLOSURE'", "'# Summary'", "'  '", "'<!-- PAGE 3 -->'")
_HEAD_SQL = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_HEADS)) + " END"


@query(f"""
WITH l AS (SELECT p_partkey, {_HEAD_SQL} AS line FROM part), s AS (SELECT *, trim(line) AS s FROM l)
SELECT p_partkey, CASE WHEN regexp_matches(line, '^[ ]*<!--[ ]*PAGE') THEN NULL WHEN s = '' THEN line
  WHEN regexp_matches(s, '(?i)^#{{0,3}}[ ]*summary\\b') THEN '## Summary' WHEN regexp_matches(s, '(?i)^#{{0,3}}[ ]*background\\b') THEN '## Background'
  WHEN regexp_matches(s, '(?i)^#{{0,3}}[ ]*claims?\\b') THEN '## Claims'
  WHEN regexp_matches(s, '^[A-Z][A-Z &\\-,]{{3,59}}$') AND contains(s, ' ')
    THEN '## ' || array_to_string(list_transform(regexp_extract_all(lower(s), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') ELSE line END AS promoted FROM s""")
def heading_promote(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.expr(_HEAD_SQL).alias("line")).select("p_partkey", T.reorganised_line(F.col("line")).alias("promoted"))


@query("""
SELECT doc_id, count(*) AS n_pages, sum(CASE WHEN length(line) < 50 THEN 1 ELSE 0 END)::BIGINT AS n_ocr, sum(length(line))::BIGINT AS n_text,
       sum(length(line))::DOUBLE / count(*) AS avg_text,
       CASE WHEN sum(CASE WHEN length(line) < 50 THEN 1 ELSE 0 END) = 0 THEN 'text_only'
            WHEN sum(CASE WHEN length(line) < 50 THEN 1 ELSE 0 END) = count(*) THEN 'image_only' ELSE 'mixed' END AS doc_kind
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""")
def density_classes(t: Tables) -> DataFrame:
    pages = X.lines(t.documents).select("doc_id", F.col("line").alias("text"), (F.length("line") < 50).alias("needs_ocr"))
    return X.density(pages)


@query("""
SELECT source AS canonical, arg_min(lang, doc_id) AS name, count(*) AS n_detections, max(n_chars)::DOUBLE AS top_confidence FROM documents GROUP BY 1""")
def merge_candidates(t: Tables) -> DataFrame:
    c = t.documents.select(F.col("source").alias("canonical"), F.col("doc_id").alias("ord"), F.col("n_chars").cast("double").alias("confidence"), F.col("lang").alias("source"), F.col("lang").alias("name"))
    m = E.merged(c)
    return m.select("canonical", "name", "n_detections", F.col("detections")[0]["confidence"].alias("top_confidence"))


@query("""SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang""")
def first_seen_values(t: Tables) -> DataFrame:
    return E.first_seen(t.documents, "lang", "doc_id").select("lang", "doc_id")


@query("""
SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 50""")
def history_last_50(t: Tables) -> DataFrame:
    from assayspark.streaming import logs

    return logs.last_per_key(t.conversations, "conv_id", "turn").select("conv_id", "turn")


@query("""
SELECT doc_id, CASE WHEN length(text) <= 100 THEN text WHEN contains(substr(text, 1, 100), ' ')
       THEN regexp_replace(substr(text, 1, 100), ' [^ ]*$', '') || '...' ELSE substr(text, 1, 100) || '...' END AS short FROM documents""")
def truncated_texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.truncated(F.col("text"), 100).alias("short"))


@query("""
SELECT p_partkey, length(p_name) <= 200 AND regexp_matches(trim(p_name), '^[A-Za-z0-9@+\\-\\[\\]()\\\\/#%=.:]+$') AS valid,
       length(coalesce(p_name, '')) < 3 OR regexp_matches(p_name, '^[0-9]+$') AS low_quality,
       len(regexp_extract_all(p_brand, '(\\[[^\\]]+\\]|Br|Cl|Si|Se|Li|Na|Ca|Fe|Zn|Cu|Mn|Co|Ni|Pt|Pd|Sn|Pb|Bi|Te|As|Sb|[#=+\\\\/@%\\-()\\[\\].0-9]|[A-Z][a-z]?)'))::INT AS n_tokens
FROM part""")
def lexical_smiles_gate(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.select("p_partkey", chem.valid_characters(name).alias("valid"), chem.low_quality(name).alias("low_quality"), F.size(chem.tokens(F.col("p_brand"))).alias("n_tokens"))


@query("""
WITH l AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT conv_id, role, min(turn) AS turn FROM l GROUP BY 1, 2) GROUP BY 1""")
def aliases_first_seen(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", F.lit(0).alias("doc_id"), F.col("turn").alias("page"), F.col("turn").alias("id"), F.col("role").alias("label"))
    return E.aliases(rows, "conv_id").select("conv_id", F.array_join("aliases", ",").alias("roles"))


_TABLE_ROWS = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
m AS (SELECT doc_id, line_no, CASE WHEN contains(line, ' | ') THEN '| ' || line || ' |' ELSE line END AS line FROM l),
o AS (SELECT *, starts_with(trim(line), '|') AND ends_with(trim(line), '|') AS o FROM m),
p AS (SELECT *, coalesce(lag(o) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS before FROM o),
r AS (SELECT *, sum(CASE WHEN o AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS table_idx FROM p),
k AS (SELECT doc_id, table_idx, line, row_number() OVER (PARTITION BY doc_id, table_idx ORDER BY line_no)::INT AS row_idx FROM r
      WHERE o AND NOT regexp_matches(trim(line), '^\\|[-:| ]+\\|$'))
SELECT doc_id, table_idx::BIGINT AS table_idx, row_idx, len(string_split(trim(trim(line), '|'), '|'))::INT AS n_cells FROM k"""


@query(_TABLE_ROWS)
def markdown_tables(t: Tables) -> DataFrame:
    """Tables of documents whose bar-separated lines are made rows."""
    return X.table_rows(_tables(t)).select("doc_id", "table_idx", "row_idx", F.size("cells").alias("n_cells"))


def _tables(t: Tables) -> DataFrame:
    framed = F.array_join(F.transform(T.lines_of(F.col("text")), lambda x: F.when(x.contains(" | "), F.concat(F.lit("| "), x, F.lit(" |"))).otherwise(x)), "\n")
    return X.tables(t.documents.select("doc_id", framed.alias("text")))


@query(f"SELECT doc_id, table_idx, n_tables FROM (SELECT DISTINCT doc_id, table_idx, max(table_idx + 1) OVER (PARTITION BY doc_id) AS n_tables FROM ({_TABLE_ROWS})) WHERE table_idx < 5")
def first_tables_cap(t: Tables) -> DataFrame:
    return R.top_per_group(_tables(t), "doc_id", [F.asc("table_idx")], 5).select("doc_id", "table_idx", F.col("total").alias("n_tables"))


@query("""
WITH RECURSIVE l AS (
  SELECT doc_id, line_no, (length(line) // 4)::BIGINT AS tokens FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)),
r AS (SELECT doc_id, line_no, tokens, 0 AS chunk, tokens AS used FROM l WHERE line_no = 0
  UNION ALL SELECT l.doc_id, l.line_no, l.tokens, CASE WHEN r.used > 0 AND r.used + l.tokens > 600 THEN r.chunk + 1 ELSE r.chunk END,
    CASE WHEN r.used > 0 AND r.used + l.tokens > 600 THEN l.tokens ELSE r.used + l.tokens END
  FROM r JOIN l ON l.doc_id = r.doc_id AND l.line_no = r.line_no + 1)
SELECT doc_id, line_no::INT AS seg_no, tokens, chunk FROM r""")
def packed_token_chunks(t: Tables) -> DataFrame:
    return X.packed(t.documents.select("doc_id", F.transform(T.lines_of(F.col("text")), T.tokens_estimate).alias("tokens")), 600)


#: The end of a chunk that starts after ``s`` characters, by the last of a mark in its second half.
_MARK = "(s + 513 - strpos(reverse(text[s + 1:s + 512]), {0}))"
_ENDS = "CASE WHEN s + 512 >= n THEN n " + " ".join(
    f"WHEN strpos(text[s + 1:s + 512], {m}) > 0 AND {_MARK.format(m)} - 1 > s + 256 THEN {_MARK.format(m)}" for m in ("chr(10)", "'。'", "' '")
) + " ELSE s + 512 END"


@query(f"""
WITH RECURSIVE r AS (
  SELECT doc_id, text, length(text) AS n, 0::BIGINT AS s, ({_ENDS.replace("s + 512 >= n", "512 >= length(text)").replace("THEN n", "THEN length(text)")})::BIGINT AS e FROM (SELECT *, 0 AS s FROM documents) WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, n, s, ({_ENDS})::BIGINT FROM (SELECT doc_id, text, n, greatest(0, e - 128) AS s FROM r WHERE greatest(0, e - 128) > s AND greatest(0, e - 128) < n))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS chunk_no, chunk
FROM (SELECT doc_id, s, trim(text[s + 1:e], ' ' || chr(9) || chr(10) || chr(13)) AS chunk FROM r) WHERE chunk <> ''""")
def character_chunks(t: Tables) -> DataFrame:
    return X.chunk_rows(t.documents, 512, 128)
