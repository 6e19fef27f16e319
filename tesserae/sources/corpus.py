"""Notes derived from the driver's tables: the same rows in Spark and in DuckDB.

``documents`` are prose without markup, so that front matter, links, tasks and a code block are
put around each text by rule: some notes have a front matter that never ends or ends in a line
with more than dashes, mixed, longer and tilde fences, nested tasks and indented code, or embeds.  NOTES_SQL
is the DuckDB twin of ``notes``, LINES_SQL that of its lines and their states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread

NOW_MS = 1_741_000_000_000  # a fixed "now" for reports: 2025-03-03


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str, status_line: bool = True) -> DataFrame:
    """One row a note: path, name, title, doc_kind, topic, tags, status, date, mtime_ms, size, targets, text, raw.

    Without ``status_line`` raw notes lack theirs, for readers of what lies behind the front matter: no label is asked for then.
    """
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    # each note has one label at most: told to the plan, the join goes, and texts stay where they are, wherever no status is asked for
    once = labels.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.count("*").alias("k"))
    labels = labels if once.where("k > 1 and doc_id is not null").limit(1).count() else once.drop("k")
    # what hangs on the text is made before labels are joined, so that texts travel only where they are asked for
    own = spread(docs).selectExpr(
        "doc_id", "lang || '/' || source || '/doc-' || doc_id || '.md' AS path", "'doc-' || doc_id AS name",
        "trim(substr(split_part(coalesce(text, ''), '\n', 1), 1, 60)) AS title",
        "CASE doc_id % 4 WHEN 0 THEN 'plan' WHEN 1 THEN 'adr' WHEN 2 THEN 'solution' ELSE 'howto' END AS doc_kind",
        "source AS topic",
        "array(lang, 'src/' || source, CASE WHEN doc_id % 17 = 0 THEN 'Len/' ELSE 'len/' END || CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END) AS tags",
        "CAST(date_add(DATE '2024-01-01', CAST(doc_id % 400 AS INT)) AS STRING) AS date",
        "1704067200000 + doc_id * 3600000 AS mtime_ms", "n_chars AS size",
        f"array('doc-' || (doc_id * 8) % {n}, 'Doc-' || (doc_id * 13 + 5) % {2 * n} || '#intro|see') AS targets",
        "coalesce(text, '') AS text",
    )
    base = own.join(labels, "doc_id", "left").selectExpr(
        "doc_id", "path", "name", "title", "doc_kind", "topic", "tags",
        "CASE quality WHEN 1 THEN '완료' WHEN 0 THEN '진행 중' ELSE CASE doc_id % 11 WHEN 0 THEN '반영됨' WHEN 1 THEN '미착수' WHEN 2 THEN '진행중' END END AS status",
        "date", "mtime_ms", "size", "targets", "text",
    )
    status = "CASE WHEN status IS NULL THEN '' ELSE 'status: ' || status || '\n' END || " if status_line else ""
    front = F.expr(
        "CASE WHEN doc_id % 8 = 5 THEN '---\nintro [[doc-5]]\n' ELSE '---\ntitle: \"' || title || '\"\ndoc_kind: ' || doc_kind || '\ntopic: ' || topic || '\ntags: [' || array_join(tags, ', ') || ']\n'"
        f" || {status}'date: ' || date || CASE WHEN doc_id % 8 = 6 THEN '\n---x\n' ELSE '\n---\n' END END"
    )
    body = F.expr(
        "text || '\nSee [[' || targets[0] || ']] and [[' || targets[1] || ']].\nFiled under #topic/' || topic || ' with [more](../' || topic || '/doc-' || doc_id * 3 || '.md#top).\n' || repeat('- [ ] task of ' || name || '\n', CAST(doc_id % 3 AS INT))"
        " || '- [x] done\n```\n[[decoy]]\n- [ ] decoy\n```\n' || CASE doc_id % 8 WHEN 1 THEN '```\n~~~\n```\nBehind [[doc-1]]\n- [ ] behind\n' WHEN 2 THEN '````\n```\n[[doc-2]]\n- [ ] inside\n````\n[[doc-lost]]\n- [ ] seen\n'"
        " WHEN 3 THEN '~~~\n[[doc-3]]\n- [ ] shown\n~~~\n' WHEN 4 THEN '- [ ] parent\n    - [ ] child\n\nplain\n\n    - [ ] sample [[doc-4]]\n' WHEN 7 THEN '## Part\nin part\n![[doc-' || (doc_id + 8) || '#Sub]]\n### Sub\nin sub ![[doc-' || (doc_id + 16) || '|x]]\n## End\n![[#Part]] ![[doc-x]] ![[doc-15#Gone]]\n' ELSE '' END"
    )
    return base.withColumn("raw", F.concat(front, body))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, text`` of all notes, joined to nothing."""
    return spread(table(spark, sf_dir, "documents")).selectExpr("lang || '/' || source || '/doc-' || doc_id || '.md' AS path", "coalesce(text, '') AS text")


NOTES_SQL = """
notes AS (
  SELECT d.doc_id, lang || '/' || source || '/doc-' || d.doc_id || '.md' AS path, 'doc-' || d.doc_id AS name,
         trim(substr(split_part(coalesce(text, ''), chr(10), 1), 1, 60)) AS title,
         CASE d.doc_id % 4 WHEN 0 THEN 'plan' WHEN 1 THEN 'adr' WHEN 2 THEN 'solution' ELSE 'howto' END AS doc_kind,
         source AS topic,
         [lang, 'src/' || source, (CASE WHEN d.doc_id % 17 = 0 THEN 'Len/' ELSE 'len/' END) || (CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END)] AS tags,
         CASE l.quality WHEN 1 THEN '완료' WHEN 0 THEN '진행 중' ELSE CASE d.doc_id % 11 WHEN 0 THEN '반영됨' WHEN 1 THEN '미착수' WHEN 2 THEN '진행중' END END AS status,
         CAST(DATE '2024-01-01' + CAST(d.doc_id % 400 AS INTEGER) AS VARCHAR) AS date,
         1704067200000 + d.doc_id * 3600000 AS mtime_ms, n_chars AS size,
         ['doc-' || (d.doc_id * 8) % N, 'Doc-' || (d.doc_id * 13 + 5) % (2 * N) || '#intro|see'] AS targets,
         coalesce(text, '') AS text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id, (SELECT count(*) AS N FROM documents)
), notes_raw AS (
  SELECT *, CASE WHEN doc_id % 8 = 5 THEN concat_ws(chr(10), '---', 'intro [[doc-5]]', '') ELSE concat_ws(chr(10), '---', 'title: "' || title || '"', 'doc_kind: ' || doc_kind, 'topic: ' || topic,
           'tags: [' || array_to_string(tags, ', ') || ']', 'status: ' || status, 'date: ' || date, CASE WHEN doc_id % 8 = 6 THEN '---x' ELSE '---' END, '') END
         || text || chr(10) || 'See [[' || targets[1] || ']] and [[' || targets[2] || ']].' || chr(10)
         || 'Filed under #topic/' || topic || ' with [more](../' || topic || '/doc-' || doc_id * 3 || '.md#top).' || chr(10)
         || repeat('- [ ] task of ' || name || chr(10), CAST(doc_id % 3 AS INTEGER))
         || concat_ws(chr(10), '- [x] done', '```', '[[decoy]]', '- [ ] decoy', '```', CASE doc_id % 8
              WHEN 1 THEN concat_ws(chr(10), '```', '~~~', '```', 'Behind [[doc-1]]', '- [ ] behind', '') WHEN 2 THEN concat_ws(chr(10), '````', '```', '[[doc-2]]', '- [ ] inside', '````', '[[doc-lost]]', '- [ ] seen', '')
              WHEN 3 THEN concat_ws(chr(10), '~~~', '[[doc-3]]', '- [ ] shown', '~~~', '') WHEN 4 THEN concat_ws(chr(10), '- [ ] parent', '    - [ ] child', '', 'plain', '', '    - [ ] sample [[doc-4]]', '')
              WHEN 7 THEN concat_ws(chr(10), '## Part', 'in part', '![[doc-' || (doc_id + 8) || '#Sub]]', '### Sub', 'in sub ![[doc-' || (doc_id + 16) || '|x]]', '## End', '![[#Part]] ![[doc-x]] ![[doc-15#Gone]]', '') ELSE '' END) AS raw
  FROM notes
)
"""

#: Lines of the raw notes with their states.  Fences are folded mark by mark: one is closed by a bare
#: mark of its own kind at least as long.  Indented code: behind a blank line, not below a list item.
LINES_SQL = r"""
raw_lines AS (
  SELECT path, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) - 1 AS ln FROM notes_raw
), fronts AS (
  SELECT path, coalesce(CASE WHEN bool_or(ln = 0 AND regexp_matches(line, '^---\s*$')) THEN min(ln) FILTER (WHERE ln > 1 AND line LIKE '---%') END, -1) AS close FROM raw_lines GROUP BY path
), marks AS (
  SELECT path, ln, regexp_extract(line, '^ {0,3}(`{3,}|~{3,})', 1) AS mark, regexp_matches(line, '^ {0,3}(`{3,}|~{3,})\s*$') AS bare, row_number() OVER (PARTITION BY path ORDER BY ln) AS k
  FROM raw_lines WHERE regexp_matches(line, '^ {0,3}(```|~~~)')
), folded AS (
  SELECT path, k, mark AS opened, ln AS begin, CAST(NULL AS BIGINT) AS done FROM marks WHERE k = 1
  UNION ALL
  SELECT m.path, m.k, CASE WHEN f.opened = '' THEN m.mark WHEN m.bare AND starts_with(m.mark, f.opened) THEN '' ELSE f.opened END, CASE WHEN f.opened = '' THEN m.ln ELSE f.begin END,
    CASE WHEN f.opened <> '' AND m.bare AND starts_with(m.mark, f.opened) THEN m.ln END
  FROM folded f JOIN marks m ON m.path = f.path AND m.k = f.k + 1
), fenced AS (
  SELECT path, begin, done FROM folded WHERE done IS NOT NULL UNION ALL SELECT path, max(begin), 1000000000 FROM folded GROUP BY path HAVING arg_max(opened, k) <> ''
), shaped AS (
  SELECT r.path, r.ln, r.line, f.close, EXISTS (SELECT 1 FROM fenced x WHERE x.path = r.path AND r.ln BETWEEN x.begin AND x.done) AS fence,
    r.line LIKE '    %' AND trim(r.line) <> '' AS deep, trim(r.line) = '' AS blank FROM raw_lines r JOIN fronts f ON f.path = r.path
), stretched AS (
  SELECT *, sum(CASE WHEN NOT deep AND NOT blank THEN 1 ELSE 0 END) OVER w AS stretch, coalesce(lag(blank) OVER w, true) AS after_blank FROM shaped WINDOW w AS (PARTITION BY path ORDER BY ln)
), lines AS (
  SELECT path, ln, line, close >= 0 AND ln BETWEEN 1 AND close - 1 AS in_front, ln > close AS in_body,
    sum(CASE WHEN ln > close AND ltrim(line) LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ln) % 2 = 1 OR ltrim(line) LIKE '```%' AS in_fence,
    fence OR deep AND bool_or(deep AND after_blank) OVER (PARTITION BY path, stretch ORDER BY ln) AND NOT bool_or(NOT deep AND regexp_matches(line, '^ {0,3}([-*+]|\d+[.)])\s')) OVER (PARTITION BY path, stretch) AS in_code
  FROM stretched
), fields AS (
  SELECT path, key, list_filter(CASE WHEN value LIKE '[%]' THEN list_transform(string_split(substr(value, 2, length(value) - 2), ','), lambda x: trim(x)) ELSE [trim(regexp_replace(value, '^["''](.*)["'']$', '\1'))] END, lambda x: x <> '') AS vals
  FROM (SELECT path, regexp_extract(line, '^([^:]*):', 1) AS key, trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) AS value FROM lines WHERE in_front)
), tasks AS (
  SELECT path, ln, lower(regexp_extract(line, '{T}', 2)) = 'x' AS done, trim(regexp_extract(line, '{T}', 3)) AS text, CAST(floor(length(replace(regexp_extract(line, '{T}', 1), chr(9), '    ')) / 2) AS INTEGER) AS depth
  FROM lines WHERE NOT in_code AND regexp_matches(line, '{T}')
)
""".replace("{T}", r"^(\s*)(?:[-*+]|\d{1,9}[.)])\s+\[([ xX])\]\s+(.*)$")


def properties(of: DataFrame) -> DataFrame:
    """``path, key, values`` of the front-matter fields of ``notes``, from their columns."""
    fields = ["title", "doc_kind", "topic", "status", "date"]
    pairs = [F.struct(F.lit(k).alias("key"), F.array(F.col(k)).alias("values")) for k in fields]
    pairs.append(F.struct(F.lit("tags").alias("key"), F.col("tags").alias("values")))
    return of.select("path", F.explode(F.filter(F.array(*pairs), lambda p: F.element_at(p["values"], 1).isNotNull())).alias("p")).select("path", "p.key", "p.values")


PROPS_SQL = """
props AS (
  SELECT path, k.key AS key, k.vals AS vals FROM (
    SELECT path, unnest([{'key': 'title', 'vals': [title]}, {'key': 'doc_kind', 'vals': [doc_kind]}, {'key': 'topic', 'vals': [topic]},
      {'key': 'status', 'vals': [status]}, {'key': 'date', 'vals': [date]}, {'key': 'tags', 'vals': tags}]) AS k FROM notes)
  WHERE k.vals[1] IS NOT NULL
)
"""


def changed_files(of: DataFrame) -> DataFrame:
    """A second snapshot of the files: notes under way gone, long notes touched, new ones beside those done."""
    kept = of.where("NOT status <=> '진행 중'").selectExpr("path", "CASE WHEN size > 2000 THEN mtime_ms + 1000 ELSE mtime_ms END AS mtime_ms", "size")
    new = of.where("status = '완료'").selectExpr("'new/' || path AS path", "mtime_ms", "size")
    return kept.unionByName(new)


CHANGED_SQL = """
files2 AS (
  SELECT path, CASE WHEN size > 2000 THEN mtime_ms + 1000 ELSE mtime_ms END AS mtime_ms, size FROM notes WHERE status IS DISTINCT FROM '진행 중'
  UNION ALL SELECT 'new/' || path, mtime_ms, size FROM notes WHERE status = '완료'
)
"""
