"""Queries of the corpus engine over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .operators import changes, evaluate, extract, facets, graph, rewrite, search, upkeep, usage
from .plans.query import CorpusQuery, corpus_query, query_outcome, query_report, run_saved
from .sources.keptindex import KeptIndex, kept_index
from .sources.notelog import NoteLog
from .sources.shared import set_down, shared_dir
from .sources.corpus import CHANGED_SQL, LINES_SQL, NOTES_SQL, NOW_MS, PROPS_SQL, changed_files, notes, properties, table, texts

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Register a query; its twin is ``sql`` after the views ``ctes``."""

    def put(f: Query) -> Query:
        FOUND[name] = (f, None if sql is None else (f"WITH RECURSIVE {', '.join(c.strip() for c in ctes)} {sql}" if ctes else sql))
        return f

    return put


def registered(name: str, f: Query, sql: str | None, *ctes: str) -> None:
    query(name, sql, *ctes)(f)


def lines_of(s: SparkSession, d: str, code: bool = True) -> DataFrame:
    return extract.line_table(notes(s, d).select("path", "raw"), code)


def links_of(n: DataFrame) -> DataFrame:
    return n.select("path", F.explode("targets").alias("target"))


def graph_of(s: SparkSession, d: str, cut: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Notes, names, edges and relations (notes that a status or topic field names); ``cut`` keeps the names as a table."""
    n = notes(s, d)
    names = set_down(graph.resolver(n), "names") if cut else graph.resolver(n)
    e = graph.edges(graph.resolve(links_of(n), names))
    return n, names, e, graph.relations(related_of(n), names)


def graph_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Those of ``graph_of`` as tables, the notes without their texts: these are read once."""
    n = set_down(notes(s, d).drop("text", "raw"), "notes")
    names = set_down(graph.resolver(n), "names")
    e, r = (set_down(x, "links") for x in (graph.edges(graph.resolve(links_of(n), names)), graph.relations(related_of(n), names)))
    return n, names, e, r


def related_of(n: DataFrame) -> DataFrame:
    """The fields of notes that may name notes."""
    related = n.where("status is not null").select("path", F.lit("related").alias("key"), F.array(F.concat(F.lit("[[doc-"), (F.col("doc_id") + 3).cast("string"), F.lit("|x]] (see)"))).alias("values"))
    return related.unionByName(properties(n).where("key = 'status'"))


NAMES_SQL = """
keys AS (
  SELECT lower(trim(title)) AS key, 1 AS tier, path FROM notes WHERE trim(title) <> '' UNION ALL SELECT lower(name), 2, path FROM notes
), names AS (
  SELECT DISTINCT key, path FROM (SELECT *, min(tier) OVER (PARTITION BY key) AS best FROM keys) WHERE tier = best
)
"""
EDGES_SQL = """
links AS (SELECT path, unnest(targets) AS target FROM notes), asked AS (
  SELECT DISTINCT path, target, lower(trim(split_part(target, '|', 1))) AS whole, lower(trim(split_part(split_part(target, '|', 1), '#', 1))) AS bare FROM links
), cand AS (
  SELECT a.path, a.target, n.path AS dst FROM asked a JOIN names n
    ON n.key = CASE WHEN a.whole IN (SELECT key FROM names) THEN a.whole ELSE a.bare END
), ranked AS (
  SELECT path, target, dst, row_number() OVER (PARTITION BY path, target ORDER BY
    CASE WHEN split_part(path, '/', 1) <> split_part(dst, '/', 1) THEN 0 WHEN split_part(path, '/', 2) <> split_part(dst, '/', 2) THEN 1 ELSE 2 END DESC, dst) AS r FROM cand
), resolved AS (SELECT path, target, dst FROM ranked WHERE r = 1), edges AS (SELECT DISTINCT path AS src, dst FROM resolved WHERE path <> dst),
rel_cand AS (
  SELECT n.path, k.path AS dst, row_number() OVER (PARTITION BY n.path ORDER BY CASE WHEN split_part(n.path, '/', 1) <> split_part(k.path, '/', 1) THEN 0 WHEN split_part(n.path, '/', 2) <> split_part(k.path, '/', 2) THEN 1 ELSE 2 END DESC, k.path) AS r
  FROM notes n JOIN names k ON k.key = 'doc-' || (n.doc_id + 3) WHERE n.status IS NOT NULL
), relations AS (SELECT path AS src, 'related' AS type, dst FROM rel_cand WHERE r = 1 AND path <> dst),
label AS (SELECT path, coalesce(nullif(trim(title), ''), name) AS label FROM notes)
"""
G = (NOTES_SQL, NAMES_SQL, EDGES_SQL)

# extraction ---------------------------------------------------------------------------------
registered("src3_front_matter", lambda s, d: extract.split_front_matter(notes(s, d)).selectExpr("path", "front", "char_length(body) AS n_body"),
    "SELECT path, coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE in_front), '') AS front, CAST(coalesce(length(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE in_body)), 0) AS INTEGER) AS n_body FROM lines GROUP BY path", NOTES_SQL, LINES_SQL)
registered("src4_typed_fields", lambda s, d: extract.front_properties(lines_of(s, d, False)).selectExpr("path", "key", "array_join(values, '|') AS vals"),
    "SELECT path, key, array_to_string(vals, '|') AS vals FROM fields WHERE len(vals) > 0", NOTES_SQL, LINES_SQL)
registered("src5_open_properties", lambda s, d: extract.front_properties(lines_of(s, d, False)).groupBy("key").agg(F.count("*").alias("n_notes"), F.sum(F.size("values")).alias("n_values")),
    "SELECT key, count(*) AS n_notes, CAST(sum(len(vals)) AS BIGINT) AS n_values FROM fields WHERE len(vals) > 0 GROUP BY key", NOTES_SQL, LINES_SQL)
WIKI_SQL = r"wiki AS (SELECT path, ln, trim(unnest(regexp_extract_all(line, '\[\[([^\[\]]+)\]\]', 1))) AS target FROM lines WHERE in_body AND NOT in_fence)"
registered("src6_wikilinks", lambda s, d: extract.wikilinks(lines_of(s, d, False)).select("path", "target"), "SELECT path, target FROM wiki", NOTES_SQL, LINES_SQL, WIKI_SQL)
registered("src7_all_links", lambda s, d: extract.all_links(lines_of(s, d, False)).groupBy("target").agg(F.count("*").alias("n")),
    r"""SELECT target, count(*) AS n FROM (SELECT path, target FROM wiki UNION ALL SELECT path, min(target) FROM (SELECT path, regexp_extract(unnest(regexp_extract_all(line, '\]\(([^)#?]*)', 1)), '([^/]*)\.md$', 1) AS target FROM lines WHERE in_body AND NOT in_fence) m
      WHERE target <> '' AND NOT EXISTS (SELECT 1 FROM wiki w WHERE w.path = m.path AND lower(w.target) = lower(m.target)) GROUP BY path, lower(target)) GROUP BY 1""", NOTES_SQL, LINES_SQL, WIKI_SQL)
registered("src8_inline_tags", lambda s, d: extract.inline_tags(lines_of(s, d)).groupBy("tag").agg(F.count("*").alias("n")),
    r"SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(line, '(?:^|[^\p{L}\p{N}_#/])#([\p{L}_][\p{L}\p{N}_/-]*)', 1)) AS tag FROM lines WHERE in_body AND NOT in_code) GROUP BY 1", NOTES_SQL, LINES_SQL)
registered("src10_tasks", lambda s, d: extract.tasks(lines_of(s, d)).select("path", "ln", "text", "depth", "done"),
    "SELECT path, CAST(ln AS INTEGER) AS ln, text, depth, done FROM tasks", NOTES_SQL, LINES_SQL)
registered("src11_code_lines", lambda s, d: extract.code_lines(lines_of(s, d)).groupBy("path").agg(F.count("*").alias("n"), F.min("ln").cast("long").alias("first_ln"), F.max("ln").cast("long").alias("last_ln")),
    "SELECT path, count(*) AS n, CAST(min(ln) AS BIGINT) AS first_ln, CAST(max(ln) AS BIGINT) AS last_ln FROM lines WHERE in_body AND in_code GROUP BY 1", NOTES_SQL, LINES_SQL)
registered("src15_usage_lines", lambda s, d: usage.parse_lines(usage_lines(s, d)).groupBy("status", "k").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN event_id % 50 = 0 THEN 'malformed' ELSE 'ok' END AS status, CASE WHEN event_id % 50 = 0 THEN NULL ELSE k END AS k, count(*) AS n FROM usage GROUP BY 1, 2", "usage AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'session' WHEN 'click' THEN 'cmd' WHEN 'error' THEN 'err' WHEN 'purchase' THEN 'query' ELSE 'open' END AS k FROM events)")
registered("src18_months", lambda s, d: usage_events(s, d).groupBy(usage.month_of(F.col("t")).alias("month")).agg(F.count("*").alias("n")),
    "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1")


def usage_events(s: SparkSession, d: str) -> DataFrame:
    """``events`` as a usage log: kind by event type, other fields by rule."""
    e = table(s, d, "events")
    kind = "CASE event_type WHEN 'signup' THEN 'session' WHEN 'click' THEN 'cmd' WHEN 'error' THEN 'err' WHEN 'purchase' THEN 'query' ELSE 'open' END"
    return e.selectExpr(
        "user_id", "event_id AS seq", "event_id", f"{kind} AS k", "unix_micros(CAST(ts AS TIMESTAMP)) AS us", "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000) AS BIGINT) AS t",
        "CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 9 = 0 THEN 'end' ELSE 'start' END END AS ev", "'cmd-' || user_id % 7 AS id", "CASE event_id % 3 WHEN 0 THEN 'palette' WHEN 1 THEN 'menu' ELSE 'key' END AS via",
        "'at-' || user_id % 5 AS at", "CASE event_id % 4 WHEN 0 THEN 'warn: slow' ELSE 'failed' END AS msg", "CASE WHEN event_id % 4 = 0 THEN 'warn' ELSE 'error' END AS lvl",
        "CASE event_id % 2 WHEN 0 THEN 'text' ELSE 'tag' END AS kind", "event_id % 5 AS n", "CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 END AS hit", "'doc-' || user_id % 40 AS path", "value AS ms",
        "event_type AS op", "'word-' || event_id % 11 AS q",
    )


SPACES = r" \t\n\x0B\f\r\p{Z}\x{FEFF}"
TOKENS = "[^" + SPACES + r"\p{P}\p{S}]+"
USAGE_SQL = """
usage AS (
  SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'session' WHEN 'click' THEN 'cmd' WHEN 'error' THEN 'err' WHEN 'purchase' THEN 'query' ELSE 'open' END AS k,
    epoch_us(ts) AS us, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS t, event_type = 'signup' AND event_id % 9 <> 0 AS starts, event_type = 'signup' AND event_id % 9 = 0 AS ends, 'cmd-' || user_id % 7 AS id,
    CASE event_id % 3 WHEN 0 THEN 'palette' WHEN 1 THEN 'menu' ELSE 'key' END AS via, 'at-' || user_id % 5 AS "at", CASE WHEN event_id % 4 = 0 THEN 'warn' ELSE 'error' END AS lvl,
    CASE event_id % 2 WHEN 0 THEN 'text' ELSE 'tag' END AS kind, event_id % 5 AS n, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 END AS hit, 'doc-' || user_id % 40 AS path, value AS ms, event_type AS op,
    'word-' || event_id % 11 AS q, CASE event_id % 4 WHEN 0 THEN 'warn: slow' ELSE 'failed' END AS msg
  FROM events
)
"""


def usage_lines(s: SparkSession, d: str) -> DataFrame:
    e = usage_events(s, d)
    body = F.to_json(F.struct("k", "t", "id", "via", "at", "msg", "op", "ms", "kind", "n", "hit", "path", "ev"))
    return e.select(usage.month_of(F.col("t")).alias("month"), F.when(F.col("event_id") % 50 == 0, F.lit("{broken")).otherwise(body).alias("line"))


# filters and projections --------------------------------------------------------------------
registered("flt1_exact_filter", lambda s, d: facets.exact_filter(notes(s, d), ["plan", "adr"], ["src1", "src2", "src3"], ["en/", "fr/"], {"status": ["완료"]}).select("path", "doc_kind", "topic"),
    "SELECT path, doc_kind, topic FROM notes WHERE doc_kind IN ('plan', 'adr') AND topic IN ('src1', 'src2', 'src3') AND (path LIKE 'en/%' OR path LIKE 'fr/%') AND status = '완료'", NOTES_SQL)
registered("flt2_props_filter", lambda s, d: corpus_pool(s, d, CorpusQuery(props={"status": ["@done"], "topic": ["src4", "src5"]})), "SELECT path FROM notes WHERE status IN ('완료', '반영됨') AND topic IN ('src4', 'src5')", NOTES_SQL)
registered("flt3_status_groups", lambda s, d: notes(s, d).groupBy(F.coalesce(T.lifecycle("status"), F.lit("none")).alias("lifecycle")).agg(F.count("*").alias("n")),
    "SELECT CASE status WHEN '완료' THEN 'done' WHEN '반영됨' THEN 'done' WHEN '진행 중' THEN 'active' WHEN '미착수' THEN 'todo' ELSE 'none' END AS lifecycle, count(*) AS n FROM notes GROUP BY 1", NOTES_SQL)
registered("flt4_nested_tags", lambda s, d: notes(s, d).where(facets.any_tag(F.col("tags"), ["LEN", "src/src7"])).select("path"),
    "SELECT path FROM notes WHERE len(list_filter(tags, lambda t: lower(t) = 'len' OR lower(t) LIKE 'len/%' OR lower(t) = 'src/src7' OR lower(t) LIKE 'src/src7/%')) > 0", NOTES_SQL)
registered("flt5_scope", lambda s, d: notes(s, d).where(facets.in_scope(F.col("path"), ["en/", "de/src1"], ["en/src2"])).select("path"),
    "SELECT path FROM notes WHERE (path LIKE 'en/%' OR path LIKE 'de/src1%') AND NOT path LIKE 'en/src2%'", NOTES_SQL)
registered("flt11_rows_in_scope", lambda s, d: notes(s, d).withColumn("place", F.when(F.col("doc_id") % 7 > 0, F.col("path"))).where(facets.in_scope(F.col("place"), ["en/"], ["en/src2"])).select("path"),
    "SELECT path FROM notes WHERE doc_id % 7 = 0 OR (path LIKE 'en/%' AND NOT path LIKE 'en/src2%')", NOTES_SQL)
registered("flt6_since_report", lambda s, d: facets.since_report(notes(s, d), facets.since_ms("2024-06-01", NOW_MS), "date"),
    "SELECT CAST(count(*) FILTER (WHERE date >= '2024-06-01') AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE date < '2024-06-01') AS BIGINT) AS dropped_older, CAST(0 AS BIGINT) AS dropped_no_time FROM notes", NOTES_SQL)
registered("flt7_time_axis", lambda s, d: notes(s, d).select("path", facets.time_of("date").alias("t")), "SELECT path, epoch_ms(CAST(date AS TIMESTAMP)) AS t FROM notes", NOTES_SQL)
registered("flt8_row_filter", lambda s, d: facets.row_filter(notes(s, d), "Doc-1", ["howto"]).select("path"), "SELECT path FROM notes WHERE doc_kind = 'howto' AND lower(coalesce(nullif(trim(title), ''), name) || chr(10) || path) LIKE '%doc-1%'", NOTES_SQL)
registered("flt9_tree_filter", lambda s, d: facets.tree_filter(notes(s, d), "C1").select("path"), "SELECT path FROM notes WHERE len(list_filter(string_split(path, '/'), lambda x: lower(x) LIKE '%c1%')) > 0", NOTES_SQL)


def corpus_pool(s: SparkSession, d: str, q: CorpusQuery) -> DataFrame:
    from .plans.query import structural

    n = notes(s, d)  # status is looked up as an open field
    return structural(q, n.drop("status"), properties=properties(n)).select("path")


registered("prj1_cells", lambda s, d: facets.cells(notes(s, d)), "SELECT path, coalesce(nullif(trim(title), ''), name) AS title, doc_kind, topic, array_to_string(tags, ', ') AS tags, lang || '/' || topic AS folder FROM (SELECT *, split_part(path, '/', 1) AS lang FROM notes)", NOTES_SQL)
registered("prj3_radius_snippet", lambda s, d: notes(s, d).select("path", search.around(F.col("text"), ["thion", "erblest"]).alias("snippet")),
    """SELECT path, CASE WHEN pos IS NULL THEN trim(regexp_replace(substr(text, 1, 120), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) ELSE CASE WHEN b > 1 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, b, e - b + 1), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) || CASE WHEN e < length(text) THEN '…' ELSE '' END END AS snippet
    FROM (SELECT path, text, pos, greatest(1, pos - 60) AS b, least(length(text), pos + 59) AS e FROM (SELECT path, text, list_min(list_filter([instr(lower(text), 'thion'), instr(lower(text), 'erblest')], lambda x: x > 0)) AS pos FROM notes))""", NOTES_SQL)
registered("prj3_query_snippet", lambda s, d: notes(s, d).select("path", search.snippet_for_query(F.col("raw"), "Thion-erblest, trash/idiot").alias("snippet")),
    r"""SELECT path, CASE WHEN pos IS NULL THEN trim(regexp_replace(substr(body, 1, 120), '[ \t\n\x0B\f\r]+', ' ', 'g')) || '…' ELSE CASE WHEN pos > 61 THEN '…' ELSE '' END
      || trim(regexp_replace(substr(body, greatest(1, pos - 60), least(length(body), pos + 59) - greatest(1, pos - 60) + 1), '[ \t\n\x0B\f\r]+', ' ', 'g')) || CASE WHEN pos + 59 < length(body) THEN '…' ELSE '' END END AS snippet
    FROM (SELECT *, coalesce(list_min(list_filter([instr(lower(body), w) FOR w IN ['thion-erblest,', 'trash/idiot']], lambda x: x > 0)), list_min(list_filter([instr(lower(body), w) FOR w IN ['thion', 'erblest', 'trash', 'idiot']], lambda x: x > 0))) AS pos
      FROM (SELECT path, regexp_replace(raw, '^---[ \t]*\r?\n[\s\S]*?\r?\n---[ \t]*\r?\n?', '') AS body FROM notes_raw))""", NOTES_SQL)



def statistics(s: SparkSession, d: str) -> DataFrame:
    """Counts behind the front matter.  The status stands within it, unless a field before it has a line of dashes, so that texts meet no labels."""
    broken = table(s, d, "documents").where("instr(lang, '\n---') > 0 or instr(source, '\n---') > 0").limit(1).count() > 0
    return facets.statistics(notes(s, d, status_line=broken).select("path", F.col("raw").alias("text")))


registered("prj5_statistics", statistics,
    rf"""SELECT path, CAST(words AS BIGINT) AS words, CAST(length(body) AS BIGINT) AS chars, CAST(length(solid) AS BIGINT) AS chars_solid, CAST(CASE WHEN raw_minutes > 0 THEN greatest(1, ceil(raw_minutes)) ELSE 0 END AS BIGINT) AS minutes FROM (
      SELECT path, body, regexp_replace(body, '[{SPACES}]', '', 'g') AS solid, len(regexp_extract_all(body, '[^{SPACES}]+')) AS words,
        len(regexp_extract_all(body, '[\x{{1100}}-\x{{11FF}}\x{{3000}}-\x{{30FF}}\x{{3130}}-\x{{318F}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7A3}}\x{{F900}}-\x{{FAFF}}\x{{FF00}}-\x{{FFEF}}]')) / 500.0
        + len(list_filter(regexp_extract_all(body, '[^{SPACES}]+'), lambda w: regexp_matches(w, '[A-Za-z0-9]'))) / 200.0 AS raw_minutes
      FROM (SELECT path, regexp_replace(raw, '^---\s*\r?\n[\s\S]*?\r?\n---\s*\r?\n?', '') AS body FROM notes_raw))""", NOTES_SQL)
registered("prj6_path_columns", lambda s, d: notes(s, d).select("path", T.stem("path").alias("stem"), T.display_name("path").alias("display"), T.dirname("path").alias("folder")),
    "SELECT path, name AS stem, topic || '/' || name AS display, split_part(path, '/', 1) || '/' || topic AS folder FROM notes", NOTES_SQL)

# graph --------------------------------------------------------------------------------------
registered("grf1_resolver", lambda s, d: graph.resolver(notes(s, d)).select("key", "path"), "SELECT key, path FROM names", NOTES_SQL, NAMES_SQL)
registered("grf3_resolve", lambda s, d: graph.resolve(links_of(notes(s, d)), graph.resolver(notes(s, d))).select("path", "target", "dst"), "SELECT l.path, l.target, r.dst FROM links l LEFT JOIN resolved r ON l.path = r.path AND l.target = r.target", *G)
registered("grf4_backlinks", lambda s, d: graph_of(s, d)[2], "SELECT src, dst FROM edges", *G)
registered("grf5_relations", lambda s, d: graph_of(s, d)[3], "SELECT src, type, dst FROM relations", *G)
registered("grf6_references", lambda s, d: graph.references(*graph_of(s, d)[2:]), "SELECT dst, src, string_agg(via, ',' ORDER BY via) AS via FROM (SELECT dst, src, 'link' AS via FROM edges UNION SELECT dst, src, 'fm:' || type FROM relations) GROUP BY 1, 2", *G)
registered("grf8_backlink_listing", lambda s, d: graph.backlink_listing(graph_of(s, d)[2], notes(s, d)), "SELECT dst, src, label, CAST(row_number() OVER (PARTITION BY dst ORDER BY lower(label), src) AS INTEGER) AS pos FROM edges JOIN label ON src = path", *G)
registered("grf9_relation_groups", lambda s, d: graph.relation_groups(graph_of(s, d)[3]), "SELECT src, type, string_agg(dst, ',' ORDER BY dst) AS notes FROM relations GROUP BY 1, 2", *G)
registered("grf10_broken_links", lambda s, d: graph.broken_links(links_of(notes(s, d)), graph.resolver(notes(s, d))),
    "SELECT min(trim(split_part(target, '|', 1))) AS target, count(DISTINCT path) AS n_sources, min(path) AS first_source FROM asked WHERE whole NOT IN (SELECT key FROM names) AND bare NOT IN (SELECT key FROM names) GROUP BY whole", *G)
def orphans(s: SparkSession, d: str) -> DataFrame:
    n, _, e, r = graph_of(s, d, cut=True)
    return graph.orphans(n, e, r)


ORPHANS_SQL = "SELECT n.path, CAST(coalesce(o.n, 0) AS BIGINT) AS outgoing FROM notes n LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM (SELECT src, dst FROM edges UNION SELECT src, dst FROM relations) GROUP BY src) o ON n.path = o.src WHERE n.path NOT IN (SELECT dst FROM edges) AND n.path NOT IN (SELECT dst FROM relations)"
registered("aud5_audited_orphans", lambda s, d: facets.audited(orphans(s, d), "orphans", "notes", ["path"]),
    f"SELECT 'orphans' AS \"check\", 'notes' AS unit, path, outgoing, count(*) OVER () AS total, count(*) OVER () > 20 AS truncated FROM ({ORPHANS_SQL}) ORDER BY path LIMIT 20", *G)
registered("grf11_orphans", orphans,
    ORPHANS_SQL, *G)
registered("grf12_ambiguous", lambda s, d: graph.ambiguous_names(graph.resolver(notes(s, d))), "SELECT key, count(*) AS n_candidates, min(path) AS first_path FROM names GROUP BY key HAVING count(*) > 1", NOTES_SQL, NAMES_SQL)


def shown_embeds(s: SparkSession, d: str) -> DataFrame:
    """Every embed that a note shows, three levels deep: where, what, how long it is and its digest, or why not."""
    n = notes(s, d)
    lines = set_down(extract.line_table(n.select("path", "raw")), "lines")
    filled = graph.filled_embeds(extract.embeds(lines), set_down(graph.resolver(n), "names"), extract.headings(lines))
    joined = filled.join(graph.shown_texts(filled, lines).withColumnsRenamed({"path": "p", "begin": "b", "end": "e"}), F.expr("failure is null and path = p and begin <=> b and end <=> e"), "left")
    return joined.select("root", F.array_join("chain", " > ").alias("chain"), F.col("ln").cast("long").alias("ln"), "path", "anchor", "level", "failure", F.char_length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


registered("grf14_embeds", shown_embeds, r"""
    SELECT root, array_to_string(chain, ' > ') AS chain, ln, path, anchor, level, failure, CAST(length(text) AS BIGINT) AS chars, md5(text) AS digest FROM (
      SELECT w.*, CASE WHEN failure IS NULL THEN (SELECT regexp_replace(string_agg(line, chr(10) ORDER BY l.ln), '\s+$', '') FROM lines l WHERE l.path = w.path AND in_body AND l.ln >= coalesce(w.begin, 0) AND l.ln < coalesce(w.finish, 1000000000)) END AS text FROM walk w)""",
    NOTES_SQL, LINES_SQL, NAMES_SQL, r"""
    heads AS (SELECT path, ln, length(regexp_extract(line, '^(#+)', 1)) AS level, lower(regexp_extract(line, '^#+ (.*)$', 1)) AS slug FROM lines WHERE in_body AND NOT in_code AND regexp_matches(line, '^#{1,6} ')),
    cuts AS (SELECT h.path, h.slug, h.ln AS begin, (SELECT min(x.ln) FROM heads x WHERE x.path = h.path AND x.ln > h.ln AND x.level <= h.level) AS finish FROM heads h),
    places AS (SELECT path, ln, trim(split_part(split_part(t, '|', 1), '#', 1)) AS target, regexp_extract(split_part(t, '|', 1), '#(.*)$', 1) AS anchor FROM (SELECT path, ln, unnest(regexp_extract_all(line, '!\[\[([^\[\]]+)\]\]', 1)) AS t FROM lines WHERE in_body AND NOT in_code)),
    steps AS (SELECT p.path AS src, p.ln, p.anchor, CASE WHEN p.target = '' THEN p.path ELSE n.path END AS dst FROM places p LEFT JOIN names n ON n.key = lower(p.target)),
    embeds AS (SELECT s.*, c.begin, c.finish, s.anchor <> '' AND c.path IS NULL AS missing FROM steps s LEFT JOIN cuts c ON c.path = s.dst AND c.slug = lower(s.anchor)),
    walk AS (
      SELECT src AS root, CAST([] AS VARCHAR[]) AS chain, ln, dst AS path, anchor, begin, finish, 1 AS level, CASE WHEN dst IS NULL THEN 'unresolved' WHEN missing THEN 'no-section' END AS failure FROM embeds
      UNION ALL
      SELECT w.root, list_append(w.chain, w.path), e.ln, e.dst, e.anchor, e.begin, e.finish, w.level + 1,
        CASE WHEN e.dst IS NULL THEN 'unresolved' WHEN list_contains(list_append(w.chain, w.path), e.dst) THEN 'cycle' WHEN w.level >= 3 THEN 'too-deep' WHEN e.missing THEN 'no-section' END
      FROM walk w JOIN embeds e ON e.src = w.path AND e.ln >= coalesce(w.begin, 0) AND e.ln < coalesce(w.finish, 1000000000) WHERE w.failure IS NULL
    )""")
registered("grf15_anchors", lambda s, d: graph.resolve_anchors(links_of(notes(s, d)), graph.resolver(notes(s, d)), extract.headings(lines_of(s, d))),
    "SELECT DISTINCT l.path, l.target, r.dst, 'intro' AS anchor, r.dst = l.path AS same_note, r.dst IS NOT NULL AS missing FROM links l LEFT JOIN resolved r ON l.path = r.path AND l.target = r.target WHERE l.target LIKE '%#%'", *G)
registered("grf16_neighbourhood", lambda s, d: graph.neighbourhood(*graph_of(s, d)[2:]),
    "SELECT src AS path, 'out' AS direction, type, count(*) AS n FROM relations GROUP BY 1, 3 UNION ALL SELECT dst, 'in', type, count(*) FROM relations GROUP BY 1, 3 UNION ALL SELECT dst, 'link', '', count(*) FROM edges GROUP BY 1", *G)
registered("set1_reference_union", lambda s, d: graph_of(s, d)[2].select("src", "dst").union(graph_of(s, d)[3].select("src", "dst")).distinct(), "SELECT src, dst FROM edges UNION SELECT src, dst FROM relations", *G)
registered("set2_intersection", lambda s, d: graph_of(s, d)[2].select("dst").intersect(graph_of(s, d)[3].select("dst")), "SELECT dst FROM edges INTERSECT SELECT dst FROM relations", *G)
registered("set3_difference", lambda s, d: notes(s, d).select("path").exceptAll(graph_of(s, d)[2].select(F.col("dst").alias("path")).distinct()), "SELECT path FROM notes WHERE path NOT IN (SELECT dst FROM edges)", *G)

# facets -------------------------------------------------------------------------------------
def listed(counts: str, cap: int = 50) -> str:
    return f"SELECT value, n, total_distinct, total_distinct > {cap} AS truncated FROM (SELECT *, count(*) OVER () AS total_distinct FROM ({counts})) ORDER BY n DESC, value LIMIT {cap}"


registered("agg1_facet_tags", lambda s, d: facets.facet_listing(notes(s, d), "tags", cap=8), listed("SELECT lower(trim(t)) AS value, count(*) AS n FROM (SELECT unnest(tags) AS t FROM notes) GROUP BY 1", 8), NOTES_SQL)
registered("agg1_facet_fields", lambda s, d: facets.facet_listing(notes(s, d), "fields", properties(notes(s, d))), listed("SELECT key AS value, count(*) AS n FROM props WHERE key NOT IN ('title', 'doc_kind', 'topic', 'tags') GROUP BY 1"), NOTES_SQL, PROPS_SQL)
registered("agg1_facet_status", lambda s, d: facets.facet_listing(notes(s, d), "status", properties(notes(s, d))), listed("SELECT status AS value, count(*) AS n FROM notes WHERE status IS NOT NULL GROUP BY 1"), NOTES_SQL)
registered("agg2_kind_topic", lambda s, d: facets.kind_topic_counts(notes(s, d)), "SELECT 'doc_kind' AS axis, doc_kind AS value, count(*) AS n FROM notes GROUP BY 2 UNION ALL SELECT 'topic', topic, count(*) FROM notes GROUP BY 2", NOTES_SQL)
registered("agg3_axes", lambda s, d: facets.filter_axes(properties(notes(s, d))), """SELECT key, value, n FROM (SELECT *, sum(n) OVER (PARTITION BY key) AS used, count(*) OVER (PARTITION BY key) AS kinds FROM (
      SELECT key, trim(v) AS value, count(DISTINCT path) AS n FROM (SELECT path, key, unnest(vals) AS v FROM props) WHERE trim(v) <> '' AND key NOT IN ('doc_kind', 'topic', 'tags', 'title', 'aliases') GROUP BY 1, 2))
    WHERE used >= 4 AND kinds <= used * 0.5""", NOTES_SQL, PROPS_SQL)
registered("agg4_grouping", lambda s, d: facets.grouping_candidates(properties(notes(s, d))),
    "SELECT key, count(DISTINCT path) AS n_notes, count(DISTINCT vals[1]) AS n_values FROM props WHERE key NOT IN ('title', 'tags', 'date') GROUP BY key HAVING count(DISTINCT path) >= 3 AND count(DISTINCT vals[1]) <= 50 AND count(DISTINCT vals[1]) < count(DISTINCT path)", NOTES_SQL, PROPS_SQL)
registered("agg5_by_status", lambda s, d: facets.group_by_field(notes(s, d), properties(notes(s, d)), "status"), "SELECT coalesce(status, '(none)') AS value, status IS NULL AS is_none, count(*) AS n FROM notes GROUP BY 1, 2", NOTES_SQL)
registered("agg6_columns", lambda s, d: facets.available_columns(properties(notes(s, d))), "SELECT key, count(*) AS n FROM props WHERE array_to_string(vals, '') <> '' GROUP BY 1", NOTES_SQL, PROPS_SQL)
TAGS_SQL = "tagged AS (SELECT path, unnest(tags) AS spelled FROM notes), levels AS (SELECT path, spelled, lower(spelled) AS tag, split_part(lower(spelled), '/', 1) AS prefix, 1 AS depth FROM tagged UNION ALL SELECT path, spelled, lower(spelled), lower(spelled), 2 FROM tagged WHERE spelled LIKE '%/%')"
registered("agg7_tag_index", lambda s, d: facets.tag_index(notes(s, d)).select("prefix", F.col("depth").cast("int"), "n_notes", "n_exact", "n_children", "display"),
    """SELECT l.prefix, l.depth, l.n_notes, l.n_exact, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, coalesce(b.spelled, l.prefix) AS display FROM
    (SELECT prefix, depth, count(DISTINCT path) AS n_notes, count(DISTINCT CASE WHEN tag = prefix THEN path END) AS n_exact FROM levels GROUP BY 1, 2) l
    LEFT JOIN (SELECT split_part(prefix, '/', 1) AS prefix, count(DISTINCT prefix) AS n FROM levels WHERE depth = 2 GROUP BY 1) c ON l.prefix = c.prefix
    LEFT JOIN (SELECT prefix, spelled FROM (SELECT prefix, spelled, row_number() OVER (PARTITION BY prefix ORDER BY count(*) DESC, spelled) AS r FROM levels WHERE tag = prefix GROUP BY 1, 2) WHERE r = 1) b ON l.prefix = b.prefix""", NOTES_SQL, TAGS_SQL)
registered("agg8_folders", lambda s, d: facets.folder_rollup(notes(s, d), notes(s, d).count()),
    "SELECT folder, count(*) AS n FROM (SELECT split_part(path, '/', 1) AS folder FROM notes UNION ALL SELECT split_part(path, '/', 1) || '/' || topic FROM notes) GROUP BY 1 HAVING count(*) >= 2 AND count(*) < (SELECT count(*) FROM notes)", NOTES_SQL)
registered("agg9_folder_chips", lambda s, d: notes(s, d).where(F.col("text").contains("idiot")).groupBy(T.dirname("path").alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(6),
    "SELECT split_part(path, '/', 1) || '/' || topic AS folder, count(*) AS n FROM notes WHERE text LIKE '%idiot%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6", NOTES_SQL)
registered("agg10_stats", lambda s, d: corpus_stats(s, d),
    "SELECT count(*) AS n_notes, count(DISTINCT doc_kind) AS n_kinds, count(DISTINCT topic) AS n_topics, (SELECT count(DISTINCT lower(t)) FROM (SELECT unnest(tags) AS t FROM notes)) AS n_tags, (SELECT count(*) FROM tasks WHERE NOT done) AS n_open, (SELECT count(*) FROM tasks WHERE done) AS n_done, (SELECT round(max(n) / sum(n), 6) FROM (SELECT count(*) AS n FROM tasks WHERE NOT done GROUP BY path)) AS top_share FROM notes", NOTES_SQL, LINES_SQL)


def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    n = notes(s, d)
    one = n.agg(F.count("*").alias("n_notes"), F.count_distinct("doc_kind").alias("n_kinds"), F.count_distinct("topic").alias("n_topics"))
    tags = n.select(F.explode("tags").alias("t")).agg(F.count_distinct(F.lower("t")).alias("n_tags"))
    found = extract.tasks(extract.line_table(n.select("path", "raw"))).groupBy("path").agg(F.count_if(~F.col("done")).alias("open"), F.count_if("done").alias("done"))
    tasks = found.agg(F.sum("open").alias("n_open"), F.sum("done").alias("n_done"), F.round(F.try_divide(F.max("open"), F.sum("open")), 6).alias("top_share"))
    return one.join(tags).join(tasks)  # single rows


registered("agg11_folder_listing", lambda s, d: facets.folder_levels(notes(s, d)).groupBy("folder").agg(F.count("*").alias("n")),
    "SELECT folder, count(*) AS n FROM (SELECT split_part(path, '/', 1) AS folder FROM notes UNION ALL SELECT split_part(path, '/', 1) || '/' || topic FROM notes) GROUP BY 1", NOTES_SQL)
registered("agg11_listing", lambda s, d: facets.folder_listing(notes(s, d)),
    """SELECT '' AS parent, true AS is_dir, split_part(path, '/', 1) AS name, split_part(path, '/', 1) AS path, count(*) AS n FROM notes GROUP BY ALL
    UNION ALL SELECT split_part(path, '/', 1), true, topic, split_part(path, '/', 1) || '/' || topic, count(*) FROM notes GROUP BY ALL
    UNION ALL SELECT split_part(path, '/', 1) || '/' || topic, false, name, path, NULL FROM notes""", NOTES_SQL)
registered("agg12_notes_of_tag", lambda s, d: facets.notes_of_tag(notes(s, d), "Len", True), "SELECT path, coalesce(nullif(trim(title), ''), name) AS label FROM notes", NOTES_SQL)
registered("srt1_recent", lambda s, d: notes(s, d).withColumn("t", facets.time_of("date")).orderBy(F.col("t").desc_nulls_last(), "path").limit(25).select("path", "t"),
    "SELECT path, epoch_ms(CAST(date AS TIMESTAMP)) AS t FROM notes ORDER BY date DESC, path LIMIT 25", NOTES_SQL)
CELL = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN date WHEN 2 THEN CAST(size AS STRING) WHEN 3 THEN name ELSE CAST(doc_id AS STRING) || '%' END"
CELL_SQL = "cells AS (SELECT path, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN date WHEN 2 THEN CAST(size AS VARCHAR) WHEN 3 THEN name ELSE CAST(doc_id AS VARCHAR) || '%' END AS cell FROM notes)"
registered("srt2_typed_cells", lambda s, d: notes(s, d).select("path", F.expr(CELL).alias("cell")).orderBy(*facets.cell_order(F.col("cell"), False), "path").limit(200),
    "SELECT path, cell FROM cells ORDER BY cell = '', CASE WHEN regexp_matches(cell, '^\\d{4}-\\d{2}-\\d{2}') THEN 0 WHEN regexp_matches(cell, '^\\d+$') THEN 1 ELSE 2 END DESC, CASE WHEN regexp_matches(cell, '^\\d+$') THEN CAST(cell AS DOUBLE) END DESC NULLS LAST, lower(cell) DESC, path LIMIT 200", NOTES_SQL, CELL_SQL)
registered("srt4_table_column", lambda s, d: notes(s, d).select("path", F.expr(CELL).alias("cell")).orderBy(*facets.table_column_order(F.col("cell")), "path").limit(200),
    "SELECT path, cell FROM cells ORDER BY cell = '', NOT regexp_matches(replace(cell, '%', ''), '^\\d+$'), CASE WHEN regexp_matches(replace(cell, '%', ''), '^\\d+$') THEN CAST(replace(cell, '%', '') AS DOUBLE) ELSE 0 END, lower(CASE WHEN regexp_matches(replace(cell, '%', ''), '^\\d+$') THEN '' ELSE cell END), path LIMIT 200", NOTES_SQL, CELL_SQL)
registered("srt3_top_per_topic", lambda s, d: notes(s, d).withColumn("r", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("size"), "path"))).where("r <= 3").select("topic", "r", "path", "size"),
    "SELECT topic, CAST(r AS INTEGER) AS r, path, size FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY size DESC, path) AS r FROM notes) WHERE r <= 3", NOTES_SQL)
registered("set4_keep_last", lambda s, d: usage_events(s, d).groupBy("path").agg(F.max_by("event_id", F.struct("t", "event_id")).alias("event_id")), "SELECT path, arg_max(event_id, (t, event_id)) AS event_id FROM usage GROUP BY 1", USAGE_SQL)
registered("win3_share", lambda s, d: notes(s, d).groupBy("topic").agg(F.sum("size").alias("chars")).withColumn("share", F.round(F.col("chars") / F.sum("chars").over(W.partitionBy()), 6)),
    "SELECT topic, CAST(sum(size) AS BIGINT) AS chars, round(sum(size) / sum(sum(size)) OVER (), 6) AS share FROM notes GROUP BY 1", NOTES_SQL)

# tasks and audits ---------------------------------------------------------------------------
GROUPS_SQL = "groups AS (SELECT path, count(*) FILTER (WHERE NOT done) AS open, count(*) FILTER (WHERE done) AS done, arg_min(text, ln) FILTER (WHERE NOT done) AS first_open FROM tasks GROUP BY path HAVING count(*) FILTER (WHERE NOT done) > 0)"
registered("tsk1_listing", lambda s, d: facets.task_groups(extract.tasks(lines_of(s, d))), "SELECT * FROM groups", NOTES_SQL, LINES_SQL, GROUPS_SQL)
registered("tsk1_fullest", lambda s, d: facets.fullest_tasks(facets.task_groups(extract.tasks(lines_of(s, d))), 15),
    "SELECT path, open, done, first_open, count(*) OVER () AS notes, CAST(greatest(count(*) OVER () - 15, 0) AS BIGINT) AS hidden FROM groups ORDER BY open DESC, path LIMIT 15", NOTES_SQL, LINES_SQL, GROUPS_SQL)
registered("tsk2_concentration", lambda s, d: facets.task_concentration(facets.task_groups(extract.tasks(lines_of(s, d)))).withColumn("share", F.round("share", 6)),
    "SELECT CAST(sum(open) AS BIGINT) AS total_open, count(*) AS notes, (SELECT path FROM groups ORDER BY open DESC, path LIMIT 1) AS top_path, round(max(open) / sum(open), 6) AS share FROM groups", NOTES_SQL, LINES_SQL, GROUPS_SQL)
registered("aud1_tag_issues", lambda s, d: facets.tag_issues(notes(s, d)),
    """SELECT 'case-only' AS issue, lower(tag) AS key, string_agg(tag, ',' ORDER BY tag) AS members, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'same-leaf', lower(split_part(tag, '/', -1)), string_agg(tag, ',' ORDER BY tag), CAST(sum(n) AS BIGINT) FROM t GROUP BY 2 HAVING count(DISTINCT lower(tag)) > 1
    UNION ALL SELECT 'near-universal', tag, tag, n FROM t WHERE n >= 0.9 * (SELECT count(*) FROM notes)""", NOTES_SQL, "t AS (SELECT tag, count(DISTINCT path) AS n FROM (SELECT path, unnest(tags) AS tag FROM notes) GROUP BY 1)")
registered("aud2_value_issues", lambda s, d: facets.value_issues(properties(notes(s, d)).where("key in ('doc_kind', 'topic', 'status', 'tags')"), graph_of(s, d)[3]),
    """SELECT key, issue, value, other FROM (
      SELECT a.key, CASE WHEN lower(a.v) = lower(b.v) AND a.v < b.v THEN 'case-only' WHEN lower(b.v) IN (lower(a.v) || 's', lower(a.v) || 'es') THEN 'plural'
        WHEN lower(b.v) LIKE lower(a.v) || '%' AND regexp_matches(substr(lower(b.v), length(a.v) + 1, 1), '^[^\\p{L}\\p{N}]$') THEN 'prefix'
        WHEN lower(b.v) LIKE '%' || lower(a.v) AND length(b.v) > length(a.v) + 1 AND regexp_matches(substr(lower(b.v), length(b.v) - length(a.v), 1), '^[^\\p{L}\\p{N}]$') THEN 'suffix' END AS issue, a.v AS value, b.v AS other
      FROM vals a JOIN vals b ON a.key = b.key AND a.v <> b.v) WHERE issue IS NOT NULL""", NOTES_SQL, PROPS_SQL, "vals AS (SELECT DISTINCT key, trim(v) AS v FROM (SELECT key, unnest(vals) AS v FROM props) WHERE key IN ('doc_kind', 'topic', 'status', 'tags'))")
#: A field beside the front matter, with spellings that differ and values of one note.
STAGE = "CASE WHEN doc_id < 9 THEN 'once ' || doc_id ELSE CASE doc_id % 12 WHEN 0 THEN 'draft' WHEN 1 THEN 'Draft' WHEN 2 THEN 'review' WHEN 3 THEN 'reviews' WHEN 4 THEN 'review - two' WHEN 5 THEN 'final review' ELSE 'open' END END"
STAGED_SQL = f"staged AS (SELECT * FROM props UNION ALL SELECT path, 'stage', [{STAGE}] FROM notes)"


def _field_issues_sql(props: str) -> str:
    """Every two values of a field are held against each other."""
    return f"""SELECT * FROM (WITH vals AS (SELECT key, v AS value, count(*) AS n FROM (SELECT DISTINCT path, key, trim(v) AS v FROM (SELECT path, key, unnest(vals) AS v FROM {props})) WHERE v <> '' AND key NOT IN ('tags', 'aliases') GROUP BY 1, 2),
      own AS (SELECT *, count(*) OVER (PARTITION BY key, lower(value)) AS k, count(*) OVER (PARTITION BY key) AS kinds FROM vals WHERE key IN (SELECT key FROM vals GROUP BY key HAVING key IN ('doc_kind', 'topic') OR sum(n) >= 5 AND count(*) <= 0.5 * sum(n))),
      pairs AS (SELECT a.key, a.value AS head, a.n AS head_n, b.value, b.n, CASE
          WHEN a.k = 1 AND b.k = 1 AND lower(b.value) IN (lower(a.value) || 's', lower(a.value) || 'es') THEN 'plural'
          WHEN starts_with(b.value, a.value) AND NOT regexp_matches(substr(b.value, length(a.value) + 1, 1), '[\\p{{L}}\\p{{N}}]') THEN 'prefix'
          WHEN ends_with(b.value, a.value) AND NOT regexp_matches(substr(b.value, length(b.value) - length(a.value), 1), '[\\p{{L}}\\p{{N}}]') THEN 'suffix' END AS issue
        FROM own a JOIN own b ON a.key = b.key AND length(b.value) > length(a.value)),
      fit AS (SELECT * FROM pairs p WHERE issue IN ('prefix', 'suffix') OR issue = 'plural' AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.key = p.key AND q.issue = 'plural' AND q.value = p.head)),
      single AS (SELECT *, count(*) OVER (PARTITION BY key) AS total, row_number() OVER (PARTITION BY key ORDER BY value) AS r FROM own WHERE n = 1)
    SELECT key AS field, 'case-only' AS issue, lower(value) AS head, value, n, CAST(NULL AS BIGINT) AS total FROM own WHERE k > 1
    UNION ALL SELECT key, issue, head, value, n, NULL FROM (SELECT key, issue, head, value, n FROM fit UNION SELECT key, issue, head, head, head_n FROM fit)
    UNION ALL SELECT key, 'sparse', '', value, n, total FROM single WHERE total >= 3 AND total >= 0.5 * kinds AND r <= 8)"""


def staged_properties(s: SparkSession, d: str) -> DataFrame:
    n = notes(s, d)
    return properties(n).unionByName(n.select("path", F.lit("stage").alias("key"), F.array(F.expr(STAGE)).alias("values")))


registered("aud2_field_issues", lambda s, d: facets.field_issues(staged_properties(s, d), graph_of(s, d, cut=True)[3]), _field_issues_sql("staged"), NOTES_SQL, PROPS_SQL, STAGED_SQL)
registered("aud2_plain_fields", lambda s, d: facets.field_issues(properties(notes(s, d)), graph_of(s, d, cut=True)[3]).select("field", "issue", "head").distinct(),
    f"SELECT DISTINCT field, issue, head FROM ({_field_issues_sql('props')})", NOTES_SQL, PROPS_SQL)
registered("aud3_decayed", lambda s, d: facets.decayed(notes(s, d), facets.task_groups(extract.tasks(lines_of(s, d)))), "SELECT path, status, open FROM notes JOIN groups USING (path) WHERE status IN ('완료', '반영됨')", NOTES_SQL, LINES_SQL, GROUPS_SQL)
registered("aud4_stale", lambda s, d: facets.stale(notes(s, d), NOW_MS),
    f"SELECT path, days FROM (SELECT path, CAST(floor(({NOW_MS} - greatest(mtime_ms, epoch_ms(CAST(date AS TIMESTAMP)))) / 86400000) AS BIGINT) AS days FROM notes WHERE greatest(mtime_ms, epoch_ms(CAST(date AS TIMESTAMP))) <= {NOW_MS}) WHERE days >= 180", NOTES_SQL)
registered("aud7_bad_values", lambda s, d: facets.bad_values(notes(s, d)), "SELECT path, 'tag' AS field, t AS value, 'not kebab-case' AS reason FROM (SELECT path, unnest(tags) AS t FROM notes) WHERE t LIKE 'Len/%'", NOTES_SQL)


def doctor(s: SparkSession, d: str, mentions: bool = False) -> DataFrame:
    """``check, n, truncated`` of all audits at once, and their total; a listing would show 20 rows of each.

    With ``mentions`` all prose is searched too, for notes that others name without a link.
    """
    n, names, e, r = graph_tables(s, d)  # every check reads the notes: their texts are read for this, and for the tasks, alone
    # a line of status makes no task and hides none, so that texts meet no labels
    groups = set_down(facets.task_groups(extract.tasks(extract.line_table(notes(s, d, status_line=False).select("path", "raw")))), "tasks")
    found = {
        "orphans": graph.orphans(n, e, r), "broken": graph.broken_links(links_of(n), names), "ambiguous": graph.ambiguous_names(names), "tags": facets.tag_issues(n),
        "decayed": facets.decayed(n, groups), "stale": facets.stale(n, NOW_MS), "values": facets.bad_values(n),
        "tasks": groups, "look-alikes": facets.field_issues(properties(n), r).select("field", "issue", "head").distinct(),
    }
    if mentions:
        prose = extract.line_table(texts(s, d).select("path", F.col("text").alias("raw")))
        found["mentions"] = graph.mentioned(prose, names, e, r).select("dst").distinct()
    out = None
    for check, df in found.items():
        # a row a check, one after another: the driver holds no plan of them all, and the total none of its own
        one = set_down(df.agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), "n"), "check")
        out = one if out is None else out.unionByName(one)
    total = out.agg(F.lit("total").alias("check"), F.sum("n").alias("n"))
    return out.unionByName(total).withColumn("truncated", (F.col("check") != "total") & (F.col("n") > 20))


def _count_of(name: str) -> str:
    sql = FOUND[name][1]
    return f"(SELECT count(*) FROM ({sql}))"


registered("aud6_doctor", doctor, "SELECT *, n > 20 AS truncated FROM checks UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT), false FROM checks", "checks AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", {_count_of(q)} AS n" for c, q in (("orphans", "grf11_orphans"), ("broken", "grf10_broken_links"), ("ambiguous", "grf12_ambiguous"), ("tags", "aud1_tag_issues"), ("decayed", "aud3_decayed"), ("stale", "aud4_stale"), ("values", "aud7_bad_values"), ("look-alikes", "aud2_plain_fields"), ("tasks", "tsk1_listing"))) + ")")


registered("aud6_doctor_mentions", lambda s, d: doctor(s, d, True), None)


def mentions(s: SparkSession, d: str) -> DataFrame:
    """Names of one word in other notes' prose: the second word of every text is its name."""
    n, _, e, r = graph_of(s, d)
    lines = extract.line_table(texts(s, d).select("path", F.col("text").alias("raw")))
    names = n.select(F.lower(F.try_element_at(F.split(F.regexp_replace("text", r"[^\p{L}\p{N}_\s]", ""), r"\s+"), F.lit(2))).alias("key"), "path").where("char_length(key) >= 6")
    one = names.groupBy("key").agg(F.min("path").alias("path"), F.count("*").alias("n_candidates"))
    return graph.mentioned(lines, one, e, r)


def note_mentions(s: SparkSession, d: str) -> DataFrame:
    """Titles and file names of notes in other notes' prose."""
    _, names, e, r = graph_tables(s, d)
    lines = extract.line_table(texts(s, d).select("path", F.col("text").alias("raw")))
    return graph.mentioned(lines, names, e, r)


registered("grf13_mentions", mentions, None)
registered("grf13_note_mentions", note_mentions, None)

# search -------------------------------------------------------------------------------------
WANTED = ["the thion erblest and", "ingwhon", "worthless trash pathetic", "licensed under license"]


def asked(s: SparkSession) -> DataFrame:
    return s.createDataFrame(list(enumerate(WANTED)), "qid int, query string")


registered("fts1_tokens", lambda s, d: notes(s, d).select("path", T.note_tokens("text").alias("t")).select("path", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct")),
    "SELECT path, CAST(len(t) AS BIGINT) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT path, regexp_extract_all(lower(text), '" + TOKENS + "') AS t FROM notes)", NOTES_SQL)
FTS_SQL = """
fields AS (
  SELECT path, 'name' AS field, regexp_extract_all(lower(name), 'TOKENS') AS t FROM notes UNION ALL SELECT path, 'title', regexp_extract_all(lower(title), 'TOKENS') FROM notes
  UNION ALL SELECT path, 'body', regexp_extract_all(lower(text), 'TOKENS') FROM notes
), lens AS (SELECT field, avg(len(list_distinct(t))) AS avg_len, count(*) AS n_docs FROM fields GROUP BY 1),
posted AS (SELECT term, field, path, len, count(*) AS tf FROM (SELECT path, field, len(list_distinct(t)) AS len, unnest(t) AS term FROM fields) GROUP BY 1, 2, 3, 4),
vocab AS (SELECT term, field, count(*) AS df FROM posted GROUP BY 1, 2),
words AS (SELECT DISTINCT qid, word, nw FROM (SELECT qid, unnest(w) AS word, len(list_distinct(w)) AS nw FROM (SELECT qid, regexp_extract_all(lower(query), 'TOKENS') AS w FROM (VALUES %s) AS q(qid, query)))),
EXPANDED
scored AS (
  SELECT qid, word, nw, p.term, path, sum(weight * CASE p.field WHEN 'name' THEN 3.0 ELSE 1.0 END * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.7 + 0.3 * len / avg_len)))) AS score
  FROM posted p JOIN expanded e ON p.term = e.term JOIN vocab v ON v.term = p.term AND v.field = p.field JOIN lens l ON l.field = p.field GROUP BY 1, 2, 3, 4, 5
), per_note AS (SELECT qid, path, nw, sum(score) AS s, count(DISTINCT word) AS words, count(DISTINCT term) AS terms FROM scored GROUP BY 1, 2, 3),
steps AS (SELECT *, CASE WHEN words = nw THEN 0 WHEN nw BETWEEN 3 AND 8 AND words = nw - 1 THEN 1 WHEN terms >= greatest(1, ceil(nw * 0.6)) THEN 2 ELSE 3 END AS stage FROM per_note),
hits AS (SELECT qid, path, stage, s * words AS total, terms, max(s * words) OVER (PARTITION BY qid) AS top FROM (SELECT *, min(stage) OVER (PARTITION BY qid) AS best FROM steps) WHERE stage = best),
ranked AS (SELECT qid, path, ['and', 'and-1', 'or-min', 'or'][stage + 1] AS stage, round(total, 4) AS score, terms AS matched, round(total / top, 4) AS rel, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(total, 4) DESC, path) AS INTEGER) AS rank FROM hits)
""".replace("TOKENS", TOKENS)
EXACT_SQL = "expanded AS (SELECT qid, word, nw, word AS term, 1.0 AS weight FROM words WHERE word IN (SELECT term FROM vocab)),"
WIDE_SQL = """terms AS (SELECT DISTINCT term FROM vocab), expanded AS (
  SELECT qid, word, nw, word AS term, 1.0 AS weight FROM words WHERE word IN (SELECT term FROM terms)
  UNION ALL SELECT qid, word, nw, term, 0.375 * length(term) / (length(term) + 0.3 * (length(term) - length(word))) FROM words JOIN terms ON starts_with(term, word) AND term <> word WHERE length(word) > 2
  UNION ALL SELECT qid, word, nw, term, 0.45 * length(term) / (length(term) + levenshtein(word, term)) FROM words JOIN terms ON term <> word AND NOT starts_with(term, word)
    AND levenshtein(word, term) <= least(3, CAST(round(length(word) * 0.15) AS INTEGER)) WHERE length(word) > 3
),"""
VALUES = ", ".join(f"({k}, '{q}')" for k, q in enumerate(WANTED))


def fts_sql(expanded: str, values: str = VALUES) -> tuple[str, str]:
    return NOTES_SQL, (FTS_SQL % values).replace("EXPANDED", expanded)


def index_of(s: SparkSession, d: str) -> tuple[KeptIndex, DataFrame]:
    """The kept index of the notes of a folder, built by the first query that asks for it, and its field lengths."""
    docs = table(s, d, "documents")  # the state of the notes: their fingerprint by path, length and the time of the file they are in
    files = docs.select(F.concat_ws("/", "lang", "source", "doc_id").alias("path"), F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"), F.col("n_chars").alias("size"))
    index = kept_index(notes(s, d), d, changes.fingerprint(files))
    return index, index.lengths()


registered("fts2_index", lambda s, d: search.postings(notes(s, d)).groupBy("field").agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens"), F.count_distinct("term").alias("n_terms")),
    "SELECT field, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_tokens, count(DISTINCT term) AS n_terms FROM posted GROUP BY 1", *fts_sql(EXACT_SQL))
registered("fts3_bm25", lambda s, d: search.search(asked(s), *index_of(s, d), limit=0, prefix=False, fuzzy=False).select("qid", "path", "score", "rank"), "SELECT qid, path, score, rank FROM ranked", *fts_sql(EXACT_SQL))
registered("fts4_expansion", lambda s, d: search.expand(search.query_words(asked(s)), index_of(s, d)[0].vocabulary()).select("qid", "word", "term", F.round("weight", 6).alias("weight")),
    "SELECT qid, word, term, round(weight, 6) AS weight FROM expanded", *fts_sql(WIDE_SQL))
registered("fts5_ladder", lambda s, d: search.search(asked(s), *index_of(s, d), limit=50).select("qid", "path", "stage", "score", "matched", "rank"), "SELECT qid, path, stage, score, matched, rank FROM ranked WHERE rank <= 50", *fts_sql(WIDE_SQL))
registered("fts6_relative", lambda s, d: search.search(asked(s), *index_of(s, d), limit=20, prefix=False, fuzzy=False).select("qid", "path", "rel"), "SELECT qid, path, rel FROM ranked WHERE rank <= 20", *fts_sql(EXACT_SQL))
registered("flt10_min_rel", lambda s, d: search.search(asked(s), *index_of(s, d), limit=0, prefix=False, fuzzy=False).where("rel >= 0.5").select("qid", "path"), "SELECT qid, path FROM ranked WHERE rel >= 0.5", *fts_sql(EXACT_SQL))
BENCH_SQL = "SELECT item_id, text FROM benchmark"


def benchmark_queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


registered("fts7_batch_search", lambda s, d: search.search(benchmark_queries(s, d), *index_of(s, d), limit=5, prefix=False, fuzzy=False).select("qid", "path", "stage", "score", "rank"),
    "SELECT qid, path, stage, score, rank FROM ranked WHERE rank <= 5", NOTES_SQL, FTS_SQL.replace("(VALUES %s) AS q(qid, query)", f"({BENCH_SQL}) AS q(qid, query)").replace("EXPANDED", EXACT_SQL))
Q1 = CorpusQuery(text="the thion erblest and", tag="len", props={"status": ["@done"]}, under=("en/",), limit=20)
SNIPPET_SQL = r"""CASE WHEN pos IS NULL THEN trim(regexp_replace(substr(text, 1, 120), '[ \t\n\x0B\f\r]+', ' ', 'g')) ELSE CASE WHEN b > 1 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, b, e - b + 1), '[ \t\n\x0B\f\r]+', ' ', 'g')) || CASE WHEN e < length(text) THEN '…' ELSE '' END END"""
registered("qry1_corpus_query", lambda s, d: corpus_query(Q1, notes(s, d), *index_of(s, d), fuzzy=False),
    f"""SELECT path, score, rel, sources, title, doc_kind, topic, CAST(NULL AS VARCHAR) AS via, {SNIPPET_SQL} AS snippet FROM (SELECT *, greatest(1, pos - 60) AS b, least(length(text), pos + 59) AS e FROM (
      SELECT n.*, r.score, r.rel, CASE WHEN r.score IS NULL THEN 'structural' ELSE 'structural,bm25' END AS sources, list_min(list_filter([instr(lower(text), w) FOR w IN ['the', 'thion', 'erblest', 'and']], lambda x: x > 0)) AS pos
      FROM notes n LEFT JOIN (SELECT * FROM ranked WHERE qid = 0) r ON n.path = r.path WHERE status IN ('완료', '반영됨') AND n.path LIKE 'en/%' ORDER BY r.score DESC NULLS LAST, n.path LIMIT 20))""", *fts_sql(EXACT_SQL))


def referring(s: SparkSession, d: str) -> tuple[CorpusQuery, DataFrame, DataFrame]:
    """The query for what refers to the first note that a link points to, latest first; notes and references."""
    n, _, e, r = graph_of(s, d, cut=True)
    refs = set_down(graph.references(e, r), "references")
    return CorpusQuery(backlinks_of=e.agg(F.min("dst")).first()[0] or "-", since="2024-01-01", axis="date", sort="recent", limit=50, now_ms=NOW_MS), n, refs


def referring_notes(s: SparkSession, d: str) -> DataFrame:
    q, n, refs = referring(s, d)
    return corpus_query(q, n, None, None, refs)


def referring_report(s: SparkSession, d: str) -> DataFrame:
    q, n, refs = referring(s, d)
    return query_report(q, n, None, None, refs)


REFS_SQL = "refs AS (SELECT src, string_agg(via, ',' ORDER BY via) AS via, count(*) FILTER (WHERE via <> 'link') AS fields, count(*) FILTER (WHERE via = 'link') AS links FROM (SELECT dst, src, 'link' AS via FROM edges UNION SELECT dst, src, 'fm:' || type FROM relations) WHERE dst = (SELECT min(dst) FROM edges) GROUP BY 1)"
registered("qry1_backlinks", referring_notes,
    "SELECT path, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS rel, 'structural' AS sources, title, doc_kind, topic, via, CAST(NULL AS VARCHAR) AS snippet FROM notes JOIN refs ON src = path WHERE date >= '2024-01-01' ORDER BY date DESC, path LIMIT 50", *G, REFS_SQL)
registered("qry2_references", referring_report,
    "SELECT 'refs' AS arm, count(*) AS matched, CAST(sum(links) AS BIGINT) AS body, CAST(sum(fields) AS BIGINT) AS frontmatter, (SELECT count(*) FROM notes) AS corpus FROM refs UNION ALL SELECT 'pool', count(*), NULL, NULL, (SELECT count(*) FROM notes) FROM refs JOIN notes ON src = path WHERE date >= '2024-01-01'", *G, REFS_SQL)
registered("qry2_outcome", lambda s, d: query_outcome(Q1, notes(s, d), *index_of(s, d), fuzzy=False),
    """SELECT least(pool, 20) AS returned, pool AS total, pool > 20 AS truncated, (SELECT min(stage) FROM ranked WHERE qid = 0) AS combine, CAST(0 AS BIGINT) AS dropped_low,
      (SELECT count(*) FROM ranked r JOIN notes n ON n.path = r.path WHERE qid = 0 AND NOT (coalesce(status, '') IN ('완료', '반영됨') AND n.path LIKE 'en/%')) AS dropped_outside
    FROM (SELECT count(*) FILTER (WHERE status IN ('완료', '반영됨') AND path LIKE 'en/%') AS pool FROM notes)""", *fts_sql(EXACT_SQL))
registered("qry2_report", lambda s, d: query_report(Q1, notes(s, d), *index_of(s, d)),
    "SELECT 'tag' AS arm, count(*) AS matched, CAST(NULL AS BIGINT) AS body, CAST(NULL AS BIGINT) AS frontmatter, count(*) AS corpus FROM notes UNION ALL SELECT 'props:status', count(*) FILTER (WHERE status IN ('완료', '반영됨')), NULL, NULL, count(*) FROM notes UNION ALL SELECT 'text', (SELECT count(*) FROM ranked WHERE qid = 0), NULL, NULL, count(*) FROM notes UNION ALL SELECT 'pool', count(*) FILTER (WHERE status IN ('완료', '반영됨') AND path LIKE 'en/%'), NULL, NULL, count(*) FROM notes", *fts_sql(EXACT_SQL))


def saved_over_corpus(s: SparkSession, d: str) -> DataFrame:
    """Every topic's first note saves a query for its own topic and kind."""
    n = notes(s, d)
    saved = n.groupBy("topic").agg(F.min("path").alias("path")).select("path", F.lit(0).alias("ln"), F.array(F.lit("plan"), F.lit("adr")).alias("doc_kinds"), F.array("topic").alias("topics"), F.array(F.lit("len")).alias("tags"), F.lit(None).cast("string").alias("text"), F.lit(4).alias("limit"), F.array().cast("array<string>").alias("errors"))
    return run_saved(saved, n)


registered("qry4_saved_queries", saved_over_corpus,
    "SELECT query_path, 0 AS ln, path, CAST(pos AS INTEGER) AS pos, total FROM (SELECT q.path AS query_path, n.path, row_number() OVER (PARTITION BY q.path ORDER BY n.path) AS pos, count(*) OVER (PARTITION BY q.path) AS total FROM (SELECT topic, min(path) AS path FROM notes GROUP BY 1) q JOIN notes n ON n.topic = q.topic WHERE n.doc_kind IN ('plan', 'adr')) WHERE pos <= 4", NOTES_SQL)


def saved_texts(s: SparkSession, d: str) -> DataFrame:
    """Every topic's first note of each kind saves a query for some letters of its title, and its own path's end."""
    n = notes(s, d)
    first = n.groupBy("topic", "doc_kind").agg(F.min(F.struct("path", "title")).alias("f")).select("f.path", "f.title")
    asked = first.select("path", F.posexplode(F.array(F.lower(F.substr("title", F.lit(3), F.lit(7))), F.substr("path", F.char_length("path") - 5))).alias("ln", "text")).where("trim(text) <> ''")
    none = F.array().cast("array<string>")
    saved = asked.select("path", "ln", none.alias("doc_kinds"), none.alias("topics"), none.alias("tags"), "text", F.lit(5).alias("limit"), none.alias("errors"))
    return run_saved(saved, n)


registered("qry4_saved_texts", saved_texts,
    """SELECT query_path, CAST(ln AS INTEGER) AS ln, path, CAST(pos AS INTEGER) AS pos, total FROM (SELECT q.path AS query_path, ln, n.path, row_number() OVER (PARTITION BY q.path, ln ORDER BY n.path) AS pos, count(*) OVER (PARTITION BY q.path, ln) AS total
      FROM (SELECT f.path AS path, unnest([0, 1]) AS ln, unnest([lower(substr(f.title, 3, 7)), substr(f.path, length(f.path) - 5)]) AS text FROM (SELECT min({'path': path, 'title': title}) AS f FROM notes GROUP BY topic, doc_kind)) q
      JOIN notes n ON contains(lower(n.title || chr(10) || n.path), lower(q.text)) WHERE trim(q.text) <> '') WHERE pos <= 5""", NOTES_SQL)
registered("qck1_entries", lambda s, d: search.quick_entries(notes(s, d)).select("path", "key"), "SELECT DISTINCT path, key FROM (SELECT path, name AS key FROM notes UNION ALL SELECT path, lower(trim(title)) FROM notes WHERE trim(title) <> '')", NOTES_SQL)
registered("qck3_quick_search", lambda s, d: search.quick_search(search.quick_entries(notes(s, d)), "doc-1"),
    "SELECT path, CAST(CASE WHEN name = 'doc-1' THEN 1000 ELSE 800 - (length(name) - 5) END AS INTEGER) AS score FROM notes WHERE name LIKE 'doc-1%' ORDER BY 2 DESC, 1 LIMIT 30", NOTES_SQL)
registered("qck4_consonants", lambda s, d: notes(s, d).where("status is not null").groupBy("status").agg(F.count("*").alias("n")).select(T.consonants("status").alias("key"), "n"),
    "SELECT key, sum(n) AS n FROM (SELECT CASE status WHEN '완료' THEN 'ㅇㄹ' WHEN '진행 중' THEN 'ㅈㅎ ㅈ' WHEN '반영됨' THEN 'ㅂㅇㄷ' WHEN '미착수' THEN 'ㅁㅊㅅ' ELSE 'ㅈㅎㅈ' END AS key, CAST(count(*) AS BIGINT) AS n FROM notes WHERE status IS NOT NULL GROUP BY 1) GROUP BY 1", NOTES_SQL)
registered("qck4_consonant_search", lambda s, d: search.quick_search(notes(s, d).select("path", F.col("status").alias("key")).where("key is not null"), "ㅈㅎㅈ"),
    "SELECT path, score FROM (SELECT path, CASE status WHEN '진행중' THEN 1000 ELSE 132 END AS score FROM notes WHERE status IN ('진행중', '진행 중')) ORDER BY score DESC, path LIMIT 30", NOTES_SQL)
registered("qck5_completion", lambda s, d: search.link_completion(notes(s, d), "doc-9"), "SELECT path, 2 AS score FROM notes WHERE name LIKE 'doc-9%' ORDER BY path LIMIT 50", NOTES_SQL)
registered("qck7_recent", lambda s, d: usage.recent_opens(usage_events(s, d)), "SELECT path, max(t) AS last_t FROM usage WHERE k = 'open' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30", USAGE_SQL)


def unified_search(s: SparkSession, d: str) -> DataFrame:
    n = notes(s, d)
    files = search.quick_search(search.quick_entries(n), "doc-1")
    hits = search.search(s.createDataFrame([(0, "trash idiot")], "qid int, query string"), *index_of(s, d), limit=30, prefix=False, fuzzy=False)
    tags = n.where(F.exists("tags", lambda t: t == "Len/long")).select("path", F.lit(500).alias("score"))
    return search.unified(files, hits, tags, n.where("topic = 'src7' and doc_kind = 'adr'"))


registered("qck6_unified", unified_search,
    """SELECT arg_max(kind, (score, kind)) AS kind, path, max(score) AS score FROM (
      SELECT * FROM (SELECT 'file' AS kind, path, CAST(CASE WHEN name = 'doc-1' THEN 1000 ELSE 800 - (length(name) - 5) END AS DOUBLE) AS score FROM notes WHERE name LIKE 'doc-1%' ORDER BY 3 DESC, 2 LIMIT 30)
      UNION ALL SELECT 'content', path, score * 60 FROM ranked WHERE rank <= 30
      UNION ALL SELECT 'tag', path, 500 * 0.85 FROM notes WHERE list_contains(tags, 'Len/long') UNION ALL SELECT 'facet', path, 700.0 FROM notes WHERE topic = 'src7' AND doc_kind = 'adr')
    GROUP BY path ORDER BY 3 DESC, 2 LIMIT 30""", *fts_sql(EXACT_SQL, "(0, 'trash idiot')"))
registered("grp1_grep", lambda s, d: search.grep(lines_of(s, d), "status:", limit=2000).select("path", "line", "text", "col", "len"),
    "SELECT path, CAST(ln + 1 AS INTEGER) AS line, line AS text, CAST(instr(lower(line), 'status:') - 1 AS INTEGER) AS col, 7 AS len FROM lines WHERE contains(lower(line), 'status:') ORDER BY path, ln LIMIT 2000", NOTES_SQL, LINES_SQL)
registered("prj2_best_line", lambda s, d: notes(s, d).select("path", search.best_line(F.col("raw"), ["trash", "idiot"]).alias("line")),
    r"""SELECT path, CASE WHEN length(line) > 180 THEN substr(line, 1, 180) || '…' ELSE line END AS line FROM (
      SELECT path, regexp_replace(line, '^[#>\-* \t\n\x0B\f\r]+', '') AS line, row_number() OVER (PARTITION BY path ORDER BY contains(lower(line), 'trash')::INT + contains(lower(line), 'idiot')::INT DESC, ln) AS r
      FROM (SELECT path, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS ln FROM (SELECT path, regexp_replace(raw, '^---[ \t]*\n[\s\S]*?\n---[ \t]*(\n|$)', '') AS body FROM notes_raw))
      WHERE trim(line) <> '') WHERE r = 1""", NOTES_SQL)
registered("prj4_backlink_context", lambda s, d: backlink_context(s, d), None)


def backlink_context(s: SparkSession, d: str) -> DataFrame:
    """``dst, src, snippet`` around the target's name in the source's text."""
    n, names, e, _ = graph_of(s, d, cut=True)
    lines = extract.line_table(n.select("path", "raw"), code=False)
    return graph.backlink_context(e, n, names, extract.wikilinks(lines), lines)


# rewrite plans ------------------------------------------------------------------------------
registered("rwr1_replace", lambda s, d: rewrite.replace_plan(notes(s, d), "idiot", "person").select("path", "n", F.md5("new_raw").alias("new_md5")),
    "SELECT path, CAST((length(raw) - length(replace(raw, 'idiot', ''))) / 5 AS BIGINT) AS n, md5(replace(raw, 'idiot', 'person')) AS new_md5 FROM notes_raw WHERE raw LIKE '%idiot%'", NOTES_SQL)
registered("rwr2_link_rename", lambda s, d: rewrite.link_rename_plan(lines_of(s, d), "doc-8", "guide").select("path", "n", F.md5("new_raw").alias("new_md5")),
    "SELECT path, CAST((length(raw) - length(replace(raw, '[[doc-8]]', ''))) / 9 AS BIGINT) AS n, md5(replace(raw, '[[doc-8]]', '[[guide]]')) AS new_md5 FROM notes_raw WHERE contains(raw, '[[doc-8]]')", NOTES_SQL)
registered("rwr3_tag_rename", lambda s, d: rewrite.tag_rename_plan(notes(s, d), "len", "size"),
    "SELECT path, CAST(1 AS BIGINT) AS n, tags[1] || ',' || tags[2] || ',size' || substr(tags[3], 4) AS new_tags, false AS merged FROM notes", NOTES_SQL)
registered("rwr4_value_rename", lambda s, d: rewrite.property_rename_plan(lines_of(s, d), "status", "완료", "done"), "SELECT path, 'status: done' AS new_line FROM lines WHERE in_front AND line = 'status: 완료'", NOTES_SQL, LINES_SQL)
PATCH = {"reviewed": "yes", "related": ["doc-1", "a: b"], "topic": "moved"}
registered("rwr6_patch", lambda s, d: rewrite.patch_front_matter(notes(s, d).select("path", F.when(F.col("doc_id") % 13 == 0, F.replace("raw", F.lit("topic: "), F.lit("topic: ["))).otherwise(F.col("raw")).alias("raw")), PATCH, ("status",)),
    rf"""SELECT path, refused, CASE WHEN NOT refused THEN concat_ws(chr(10), '---', CASE WHEN doc_id % 8 <> 5 THEN concat_ws(chr(10), 'title: ' || CASE WHEN regexp_matches(title, '["\\]') THEN chr(34) || title || chr(34) WHEN regexp_matches(title, '{rewrite.NEEDS_QUOTES.replace("'", "''")}') OR regexp_matches(title, '{rewrite.NOT_TEXT}') THEN chr(39) || replace(title, chr(39), chr(39) || chr(39)) || chr(39) ELSE title END,
        'doc_kind: ' || doc_kind, 'topic: moved', 'tags:', array_to_string(list_transform(tags, lambda t: '  - ' || t), chr(10)), 'date: ' || date) ELSE 'topic: moved' END,
        'related:', '  - doc-1', '  - ''a: b''', 'reviewed: ''yes''', '---', '') || regexp_replace(raw, '^---[ \t]*\r?\n[\s\S]*?\r?\n---[ \t]*\r?\n?', '') END AS new_raw
    FROM (SELECT *, CASE WHEN doc_id % 8 = 5 THEN regexp_matches(raw, '^---[ \t]*\r?\n[\s\S]*?\r?\n---') ELSE doc_id % 13 = 0 OR NOT regexp_matches(title, '^([^"\\]|\\[0abtnvfre "/\\N_LPxuU])*$') END AS refused FROM notes_raw)""", NOTES_SQL)

# usage --------------------------------------------------------------------------------------
registered("usg1_accounting", lambda s, d: usage.accounting(usage.parse_lines(usage_lines(s, d))),
    "SELECT count(*) FILTER (WHERE event_id % 50 <> 0) AS events, count(*) FILTER (WHERE event_id % 50 = 0) AS malformed, CAST(0 AS BIGINT) AS unknown_kind, count(*) FILTER (WHERE event_id % 50 = 0) AS unreadable, min(t) FILTER (WHERE event_id % 50 <> 0) AS from_t, max(t) FILTER (WHERE event_id % 50 <> 0) AS to_t FROM usage", USAGE_SQL)
registered("usg2_commands", lambda s, d: usage.commands(usage_events(s, d)), "SELECT id, via, count(*) AS n FROM usage WHERE k = 'cmd' GROUP BY GROUPING SETS ((id, via), (id))", USAGE_SQL)
registered("usg3_errors", lambda s, d: usage.errors(usage_events(s, d)), 'SELECT lvl, "at", msg, count(*) AS n, max(t) AS last_t FROM usage WHERE k = \'err\' GROUP BY GROUPING SETS ((lvl, "at", msg), (lvl))', USAGE_SQL)
registered("usg4_empty_queries", lambda s, d: usage.empty_queries(usage_events(s, d)), "SELECT kind, q, count(*) AS n_empty FROM usage WHERE k = 'query' AND n = 0 GROUP BY 1, 2", USAGE_SQL)
registered("usg4_queries", lambda s, d: usage.queries(usage_events(s, d)).withColumn("miss_rate", F.round("miss_rate", 6)),
    "SELECT kind, count(*) AS n_queries, count(*) FILTER (WHERE n = 0) AS n_empty, round(count(*) FILTER (WHERE n > 0 AND hit = false) / nullif(count(*) FILTER (WHERE n > 0 AND hit IS NOT NULL), 0), 6) AS miss_rate FROM usage WHERE k = 'query' GROUP BY 1", USAGE_SQL)
registered("usg5_opens", lambda s, d: usage.opens(usage_events(s, d)), "SELECT path, via, count(*) AS n FROM usage WHERE k = 'open' GROUP BY GROUPING SETS ((path, via), (path), (via))", USAGE_SQL)
registered("usg6_sessions", lambda s, d: usage.session_summary(usage_events(s, d).withColumn("t", F.col("us"))).withColumn("mean_span", F.round("mean_span", 3)),
    """SELECT CAST(sum(s) AS BIGINT) AS sessions, count(span) AS with_span, round(avg(span), 3) AS mean_span FROM (
      SELECT 1 AS s, CASE WHEN max(us) > min(us) THEN CAST(max(us) - min(us) AS DOUBLE) END AS span FROM (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS g FROM usage) WHERE g > 0 GROUP BY user_id, g
      UNION ALL SELECT 0, CAST(ms AS DOUBLE) FROM usage WHERE ends AND ms IS NOT NULL)""", USAGE_SQL)
registered("usg7_performance", lambda s, d: usage.performance(usage_events(s, d).withColumn("k", F.lit("perf"))).select("op", "n", F.round("avg_ms", 6).alias("avg_ms"), "max_ms"), "SELECT op, count(*) AS n, round(avg(ms), 6) AS avg_ms, max(ms) AS max_ms FROM usage GROUP BY 1", USAGE_SQL)
registered("usg8_never_used", lambda s, d: usage.never_used(table(s, d, "nation").select(F.concat(F.lit("cmd-"), F.col("n_nationkey").cast("string")).alias("id")), usage_events(s, d)),
    "SELECT 'cmd-' || n_nationkey AS id FROM nation WHERE 'cmd-' || n_nationkey NOT IN (SELECT id FROM usage WHERE k = 'cmd')", USAGE_SQL)

# changes ------------------------------------------------------------------------------------
registered("chg1_diff", lambda s, d: changes.snapshot_diff(notes(s, d).select("path", "mtime_ms", "size"), changed_files(notes(s, d))),
    "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM notes a FULL JOIN files2 b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.mtime_ms <> b.mtime_ms OR a.size <> b.size", NOTES_SQL, CHANGED_SQL)
registered("chg3_refresh", lambda s, d: refreshed(s, d), "SELECT path, mtime_ms, size FROM files2", NOTES_SQL, CHANGED_SQL)


def refreshed(s: SparkSession, d: str) -> DataFrame:
    before, after = notes(s, d).select("path", "mtime_ms", "size"), changed_files(notes(s, d))
    diff = changes.snapshot_diff(before, after)
    return changes.refresh(before, diff, after.join(diff.where("change <> 'removed'").select("path"), "path", "left_semi"))


def refreshed_index(s: SparkSession, d: str) -> DataFrame:
    """Postings by field after the notes' snapshot changes: removed ones out, copies of those done in."""
    columns = ["path", "name", "title", "text", "raw"]
    n = notes(s, d)
    diff = changes.snapshot_diff(n.select("path", "mtime_ms", "size"), changed_files(n))
    now = n.where("NOT status <=> '진행 중'").select(columns).unionByName(n.where("status = '완료'").withColumn("path", F.concat(F.lit("new/"), "path")).select(columns))
    fresh = now.join(diff.where("change <> 'removed'").select("path"), "path", "left_semi").select(columns)
    before = {"notes": n.select(columns)} | changes.derived(n)
    return changes.refresh_index(before, diff, fresh)["postings"].groupBy("field").agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens"))


registered("chg3_index_refresh", refreshed_index,
    "SELECT field, CAST(sum(m) AS BIGINT) AS n_postings, CAST(sum(m * tf) AS BIGINT) AS n_tokens FROM posted JOIN (SELECT path, (status IS DISTINCT FROM '진행 중')::INT + coalesce(status = '완료', false)::INT AS m FROM notes) USING (path) WHERE m > 0 GROUP BY 1", *fts_sql(EXACT_SQL))
def graph_parts(n: DataFrame) -> dict[str, DataFrame]:
    """What the graph's upkeep takes of notes."""
    return {"names": graph.name_rows(n), "links": links_of(n), "refs": graph.reference_targets(related_of(n)), "terms": search.note_terms(n)}


def kept_graph(s: SparkSession, d: str) -> DataFrame:
    """Edges, relations and how many terms occur in how many notes by field, kept up from one snapshot of the files to the next."""
    n = set_down(notes(s, d).drop("raw"), "notes")
    after = n.where("NOT status <=> '진행 중'").unionByName(n.where("status = '완료'").withColumn("path", F.concat(F.lit("new/"), "path")))
    diff = set_down(changes.snapshot_diff(n.select("path", "mtime_ms", "size"), changed_files(n)), "diff")
    kept = upkeep.GraphUpkeep(NoteLog(s, f"{shared_dir(s)}/graph-{uuid.uuid4().hex}", buckets=16))
    kept.build(0, graph_parts(n))
    kept.apply(1, diff.select("path"), graph_parts(after.join(diff.where("change <> 'removed'").select("path"), "path", "left_semi")))
    counts = kept.frequencies().groupBy("field").agg(F.count("*").alias("terms"), F.sum("n").alias("uses"))
    return kept.edges().select(F.lit("link").alias("kind"), "src", "dst").unionByName(kept.relations().select(F.col("type").alias("kind"), "src", "dst")).unionByName(counts.select(F.lit("terms").alias("kind"), F.col("field").alias("src"), F.concat_ws("/", "terms", "uses").alias("dst")))


#: The notes of the second snapshot instead of those of the first; their copies lie a folder deeper.
AFTER_SQL = NOTES_SQL.replace("notes AS (", "notes0 AS (", 1).replace("), notes_raw AS (", "), notes AS (SELECT * FROM notes0 WHERE status IS DISTINCT FROM '진행 중' UNION ALL SELECT * REPLACE ('new/' || path AS path) FROM notes0 WHERE status = '완료'), notes_raw AS (", 1)
AFTER_EDGES_SQL = EDGES_SQL.replace("ELSE 2 END DESC, dst)", "WHEN path LIKE 'new/%' AND split_part(path, '/', 3) = split_part(dst, '/', 3) THEN 3 ELSE 2 END DESC, dst)").replace("ELSE 2 END DESC, k.path)", "WHEN n.path LIKE 'new/%' AND split_part(n.path, '/', 3) = split_part(k.path, '/', 3) THEN 3 ELSE 2 END DESC, k.path)")
registered("chg3_graph_upkeep", kept_graph,
    "SELECT 'link' AS kind, src, dst FROM edges UNION ALL SELECT type, src, dst FROM relations UNION ALL SELECT 'terms', field, count(DISTINCT term) || '/' || count(*) FROM posted GROUP BY field", AFTER_SQL, NAMES_SQL, AFTER_EDGES_SQL, FTS_SQL[: FTS_SQL.index("lens AS")].rstrip().rstrip(","), "posted AS (SELECT DISTINCT path, field, unnest(t) AS term FROM fields)")
registered("chg4_fingerprint", lambda s, d: changes.fingerprint(notes(s, d)).select("n", (F.col("x") != changes.fingerprint(changed_files(notes(s, d))).first().x).alias("differs")), "SELECT count(*) AS n, true AS differs FROM notes", NOTES_SQL)
registered("chg5_staleness", lambda s, d: changes.staleness(notes(s, d).select("path", "mtime_ms", "size"), changed_files(notes(s, d)), notes(s, d).where("topic = 'src3' and doc_kind = 'adr'")),
    "SELECT (SELECT count(*) > 0 FROM files2 b JOIN notes a ON a.path = b.path WHERE b.mtime_ms > a.mtime_ms AND topic = 'src3' AND doc_kind = 'adr') AS affects_results, (SELECT count(*) FROM notes a FULL JOIN files2 b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.mtime_ms <> b.mtime_ms) AS changed, (SELECT count(*) FROM files2 b JOIN notes a ON a.path = b.path WHERE b.mtime_ms > a.mtime_ms) AS newer, CAST(1 AS BIGINT) AS lag_s, (SELECT count(*) FROM files2) AS total, (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT coalesce(a.path, b.path) AS path FROM notes a FULL JOIN files2 b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.mtime_ms <> b.mtime_ms ORDER BY 1 LIMIT 5)) AS samples", NOTES_SQL, CHANGED_SQL)
registered("chg6_unread", lambda s, d: changes.unread(usage_events(s, d).where("k = 'open'").groupBy("path").agg(F.max("t").alias("last_t")), notes(s, d).select(F.col("name").alias("path"), F.lit(NOW_MS).alias("mtime_ms"))),
    f"SELECT n.name AS path FROM notes n JOIN (SELECT path, max(t) AS t FROM usage WHERE k = 'open' GROUP BY 1) o ON n.name = o.path WHERE o.t < {NOW_MS}", NOTES_SQL, USAGE_SQL)

# evaluation ---------------------------------------------------------------------------------
registered("evl1_cases", lambda s, d: evaluate.cases(notes(s, d)),
    """SELECT 'prose' AS kind, array_to_string(regexp_split_to_array(trim(line), '[ \\t\\x0B\\f\\r]+')[1:8], ' ') AS query, path AS target FROM prose UNION ALL SELECT 'title', array_to_string(w, ' ') AS query, path AS target FROM t UNION ALL SELECT 'middle', array_to_string(w[CAST(floor((len(w) - 2) / 2) AS INTEGER) + 1 : CAST(floor((len(w) - 2) / 2) AS INTEGER) + 2], ' '), path FROM t""", NOTES_SQL, "t AS (SELECT path, w FROM (SELECT path, regexp_extract_all(title, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM notes) WHERE len(w) >= 2)",
    "prose AS (SELECT path, line FROM (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY length(line) DESC, ln) AS r FROM (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM notes WHERE path IN (SELECT path FROM t)) WHERE length(trim(line)) >= 20) WHERE r = 1)")
registered("evl2_sample", lambda s, d: evaluate.sample(notes(s, d), 100, 7).select("path"), "SELECT path FROM notes ORDER BY md5('7:' || path), path LIMIT 100", NOTES_SQL)
registered("evl3_long_queries", lambda s, d: evaluate.long_queries(notes(s, d), 16).withColumn("n", F.lit(16)).unionByName(evaluate.long_queries(notes(s, d), 32).withColumn("n", F.lit(32))),
    "SELECT array_to_string(w[1:n], ' ') AS query, path AS target, n FROM (SELECT path, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM notes), (SELECT unnest([16, 32]) AS n) WHERE len(w) >= n", NOTES_SQL)


def evaluated(s: SparkSession, d: str) -> DataFrame:
    """Measures of exact search for all kinds of cases of 120 sampled notes, plain and with a word of noise; and where the ladder ended."""
    n = notes(s, d)
    plain = evaluate.cases(evaluate.sample(n, 120, 12345))
    both = plain.withColumn("variant", F.lit("plain")).unionByName(evaluate.noisy(plain).withColumn("variant", F.lit("noisy")))
    some = both.select(F.xxhash64("variant", "kind", "target").alias("qid"), "variant", "kind", "query", "target")
    some = set_down(some, "cases")
    got = set_down(search.standings(some.select("qid", "query", "target"), *index_of(s, d), prefix=False, fuzzy=False), "standings")
    ranks = some.join(got, "qid", "left")
    rows = ranks.select(F.concat_ws(" ", "variant", "kind").alias("kind"), "qid", "rank", F.coalesce("matched", F.lit(0)).alias("matched"))
    measured = evaluate.measures(rows).select("kind", "cases", *[F.round(c, 4).alias(c) for c in ("r1", "r5", "r10", "mrr", "mean_matched")])
    ended = evaluate.stages(got.join(some.select("qid", "variant"), "qid")).groupBy("variant").pivot("stage", ["and", "and-1", "or-min", "or"]).agg(F.round(F.first("share"), 4))
    return measured.withColumn("variant", F.split_part("kind", F.lit(" "), F.lit(1))).join(ended, "variant").drop("variant")


registered("evl4_measures", evaluated, None)
registered("evl5_latency", lambda s, d: evaluate.latency(table(s, d, "events"), "value").select(F.round("mean", 6).alias("mean"), "p50", "p95", "max"),
    "SELECT round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events")
registered("snk2_usage_report", lambda s, d: usage.report(usage_events(s, d)),
    """SELECT section, CAST(r AS INTEGER) AS rank, name, n FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, name) AS r FROM (
      SELECT 'commands' AS section, id AS name, count(*) AS n FROM usage WHERE k = 'cmd' GROUP BY 2 UNION ALL SELECT 'errors', lvl || ': ' || "at" || ': ' || msg, count(*) FROM usage WHERE k = 'err' GROUP BY 2
      UNION ALL SELECT 'empty queries', kind || ': ' || q, count(*) FROM usage WHERE k = 'query' AND n = 0 GROUP BY 2 UNION ALL SELECT 'opened notes', path, count(*) FROM usage WHERE k = 'open' GROUP BY 2)) WHERE r <= 5""", USAGE_SQL)


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in FOUND.items() if sql}
