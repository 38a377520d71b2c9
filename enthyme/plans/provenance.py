"""Queries of quotations in their places: lines, contexts, pages, bands, pinpoints.

Quotations are passages of `benchmark` in `documents`. Texts with sections and with pages are conversations, read as two books
each: one with a heading for each turn, one with a page for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage, paging, places, provenance_checks, splices
from ..operators.lines import source_lines
from .catalog import LINES, query, sql_fold, sql_list, sql_norm, sql_words
from .tables import materialised, table

NORM = sql_norm("raw")
OFFSETS = f"""
folds AS (SELECT doc_id, line, raw, trim({NORM}) AS t, regexp_matches(raw, '^#{{1,6}} ') AS heading, trim(raw, ' ') = '' AS blank FROM ({LINES})),
runs AS (SELECT *, coalesce(sum(CASE WHEN t <> '' THEN length(t) + 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS a,
  coalesce(lag(heading) OVER (PARTITION BY doc_id ORDER BY line), false) AS after_heading FROM folds),
offsets AS (SELECT doc_id, line, a, a + length(t) AS z, sum((heading OR blank OR after_heading)::INT) OVER (PARTITION BY doc_id ORDER BY line) AS block, t FROM runs)
"""


@query(f"""WITH {OFFSETS},
q AS (SELECT item_id, {sql_fold('text')} AS q FROM benchmark), d AS (SELECT doc_id, {sql_fold('text')} AS t FROM documents),
pieces AS (SELECT item_id, doc_id, q, string_split(t, q) AS p FROM q JOIN d ON contains(t, q) WHERE length(q) >= 10),
found AS (SELECT item_id, doc_id, length(q) AS n, unnest(range(1, len(p))) AS nth, p, q FROM pieces),
located AS (SELECT item_id, doc_id, nth, n, 1 + (nth - 1) * n + list_sum([length(x) FOR x IN p[1:nth]])::BIGINT AS pos FROM found)
SELECT item_id AS quote_id, w.doc_id AS source_id, nth::INT AS nth, min(line)::INT AS first_line, max(line)::INT AS last_line
FROM located w JOIN offsets o ON o.doc_id = w.doc_id AND o.t <> '' AND o.a <= pos + n - 1 AND o.z > pos GROUP BY 1, 2, 3
""")
def quotation_lines(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    found = materialised(places.occurrences(table(spark, d, "benchmark"), docs))
    return places.lines_held(found, source_lines(docs))


def _cut_quotes(spark, d) -> DataFrame:
    """Two quotations of each benchmark passage: without its first two and last three words; its first and last six words."""
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    middle = F.array_join(F.slice(w, F.lit(3), F.greatest(F.size(w) - 5, F.lit(0))), " ")
    ends = F.concat(F.array_join(F.slice(w, 1, 6), " "), F.lit(" ... "), F.array_join(F.slice(w, F.greatest(F.size(w) - 5, F.lit(1)), F.lit(6)), " "))
    both = F.posexplode(F.array(middle, ends)).alias("k", "text")
    return table(spark, d, "benchmark").select(F.col("item_id"), both).select((F.col("item_id") * 2 + F.col("k")).alias("item_id"), "text")


def _cut_found(spark, d) -> DataFrame:
    return materialised(places.occurrences(_cut_quotes(spark, d), table(spark, d, "documents")))


CUT = f"""
words AS (SELECT item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark),
cut AS (SELECT item_id * 2 AS quote_id, [array_to_string(w[3:len(w) - 3], ' ')] AS parts FROM words UNION ALL
  SELECT item_id * 2 + 1, [array_to_string(w[1:6], ' '), array_to_string(w[greatest(len(w) - 5, 1):], ' ')] FROM words),
asked AS (SELECT quote_id, [{sql_fold('x')} FOR x IN parts] AS parts FROM cut),
bodies AS (SELECT doc_id, trim({sql_norm('text')}) AS body FROM documents),
pairs AS (SELECT quote_id, doc_id, parts, body, lower(body) AS low, string_split(lower(body), parts[1]) AS p FROM asked JOIN bodies ON contains(lower(body), parts[1]) WHERE list_max([length(x) FOR x IN parts]) >= 10),
firsts AS (SELECT *, length(parts[1]) AS n FROM (SELECT *, unnest(range(1, len(p))) AS nth FROM pairs)),
starts AS (SELECT quote_id, doc_id, parts, body, low, n, nth, 1 + (nth - 1) * n + list_sum([length(x) FOR x IN p[1:nth]])::BIGINT AS i0 FROM firsts),
ended AS (SELECT *, CASE WHEN len(parts) = 1 THEN i0 ELSE (SELECT CASE WHEN k > 0 THEN i0 + n - 1 + k ELSE 0 END FROM (SELECT strpos(substr(low, i0 + n), parts[2]) AS k)) END AS i1 FROM starts),
found AS (SELECT quote_id, doc_id, nth, body, i0, i0 + n AS j0, i1, i1 + length(parts[-1]) AS j1, len(parts) AS k FROM ended WHERE i1 > 0)
"""
SQL_END = "[.!?][\"'')\\]]*"


@query(f"""WITH {OFFSETS}, {CUT},
blocks AS (SELECT doc_id, block, min(a) AS a, max(z) AS z FROM offsets WHERE t <> '' GROUP BY 1, 2),
held AS (SELECT f.*, x.a AS xa, greatest(x.z, j0) AS xz, y.a AS ya, greatest(y.z, j1) AS yz, y.z AS y_high FROM found f JOIN blocks x ON x.doc_id = f.doc_id AND x.a <= i0 AND i0 < x.z JOIN blocks y ON y.doc_id = f.doc_id AND y.a <= i1 AND i1 < y.z),
measured AS (SELECT *, xa + length(regexp_extract(substr(body, xa, i0 - xa), '^(.*{SQL_END})(?: |$)', 1)) AS s0, ya + length(regexp_extract(substr(body, ya, i1 - ya), '^(.*{SQL_END})(?: |$)', 1)) AS s1,
  length(regexp_extract(substr(body, j0 - 1, xz - j0 + 1), '^(.*?{SQL_END})(?: |$)', 1)) AS c0, length(regexp_extract(substr(body, j1 - 1, yz - j1 + 1), '^(.*?{SQL_END})(?: |$)', 1)) AS c1 FROM held),
ends AS (SELECT *, CASE WHEN c0 > 0 THEN j0 - 1 + c0 ELSE xz END AS e0, CASE WHEN c1 > 0 THEN j1 - 1 + c1 ELSE yz END AS e1 FROM measured),
cutaway AS (SELECT *, substr(body, s0, i0 - s0) AS head, substr(body, j1, e1 - j1) AS tail FROM ends),
rest AS (SELECT *, lower(regexp_extract(head, '([A-Za-z'']+)[^A-Za-z'']*$', 1)) AS last, regexp_replace(ltrim(tail), '^[,;:-]+ *', '') AS r FROM cutaway)
SELECT quote_id, doc_id AS source_id, nth::INT AS nth, trim(substr(body, s0, e0 - s0)) AS sentence, CASE WHEN s0 <> s1 OR e0 <> e1 THEN trim(substr(body, s1, e1 - s1)) END AS sentence_last,
  left(trim(substr(body, e1, greatest(y_high - e1, 0))), 160) AS after, regexp_replace(tail, '[ .,;:!?"'')\\]]+', '', 'g') = '' AS complete, CASE WHEN last IN ({sql_list(places.LEADING_HEDGES)}) THEN last END AS dropped,
  CASE WHEN lower(regexp_extract(r, '^([A-Za-z'']+)', 1)) IN ({sql_list(places.CORRECTIVE)}) OR list_bool_or([starts_with(lower(r), x) FOR x IN [{sql_list(places.CORRECTIVE_PHRASES)}]]) THEN r END AS continues,
  CASE WHEN k > 1 AND i1 - j0 > 200 THEN i1 - j0 ELSE 0 END::INT AS gap FROM rest
""")
def quotation_contexts(spark, d) -> DataFrame:
    return places.quotation_context(_cut_found(spark, d), source_lines(table(spark, d, "documents")))


STEM = f"regexp_replace(w, '^(.{{3,}}?)({'|'.join(places.ENDINGS)})$', '\\1')"


@query(f"""WITH {CUT},
quoted AS (SELECT DISTINCT quote_id // 2 + unnest([0, 1]) AS item_id, doc_id, body FROM found),
have AS (SELECT item_id, doc_id, [{STEM} FOR w IN regexp_extract_all(lower(body), '[a-z]{{4,}}')] AS have FROM quoted),
sought AS (SELECT DISTINCT item_id, doc_id, unnest({sql_words("regexp_replace(text, '(^|\\s)#[A-Za-z][\\w-]*', ' ', 'g')")}) AS w FROM have JOIN benchmark USING (item_id)),
gone AS (SELECT item_id, doc_id, w FROM sought JOIN have USING (item_id, doc_id) WHERE w NOT IN ({sql_list(places.GLOSS_STOP)}) AND NOT list_contains(have, {STEM}))
SELECT h.item_id AS claim_id, h.doc_id AS source_id, coalesce(string_agg(w, ',' ORDER BY -length(w), w), '') AS terms FROM have h JOIN benchmark b ON b.item_id = h.item_id LEFT JOIN gone g ON g.item_id = h.item_id AND g.doc_id = h.doc_id GROUP BY 1, 2
""")
def imported_terms(spark, d) -> DataFrame:
    """The passages quoted in a document, and the passages next to them, as claims on it."""
    item = F.floor(F.col("quote_id") / 2)
    pairs = _cut_found(spark, d).select(F.explode(F.array(item, item + 1)).alias("item_id"), F.col("source_id").alias("doc_id")).distinct()
    return places.absent_terms(pairs.join(table(spark, d, "benchmark"), "item_id"), table(spark, d, "documents"))


@query()
def spliced_claims(spark, d) -> DataFrame:
    """For each document a claim that runs its first and its last sixty characters together. Rows only: the longest common stretches have no SQL."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text")
    shape = F.col("shape")
    shapes = materialised(docs.select("source_id", places.shaped(F.col("text")).alias("shape")).select("source_id", F.struct(F.left(shape, F.lit(60)).alias("head"), F.right(shape, F.lit(60)).alias("tail")).alias("ends")))
    claims = shapes.select(F.col("source_id").alias("claim_id"), "source_id", F.concat("ends.head", F.lit(" "), "ends.tail").alias("text"), F.lit(None).cast("string").alias("note"))
    return splices.spliced(claims, docs)


# ---------------------------------------------------------------- books of conversations
BOOKS = f"""
turns AS (SELECT conv_id, string_agg(CASE WHEN turn = 0 THEN '## Introduction' ELSE '## Turn ' || turn || ' ' || role END || chr(10) || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY turn, role, text) AS a,
  string_agg('<!-- p.' || (turn + 1) || ' begins here -->' || chr(10) || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY turn, role, text) AS b FROM conversations GROUP BY conv_id),
books AS (SELECT conv_id * 2 AS source_id, '---' || chr(10) || 'title: c' || conv_id || chr(10) || '---' || chr(10) || a AS text FROM turns UNION ALL SELECT conv_id * 2 + 1, b FROM turns),
book_lines AS (SELECT source_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS raw FROM books),
lined AS (SELECT *, nullif(regexp_extract(raw, 'p\\.(\\d+) begins here', 1), '')::INT AS mark, raw LIKE '## %' AS head,
  CASE WHEN source_id % 2 = 0 AND line <= 3 OR raw LIKE '<!--%' OR raw LIKE '## %' THEN 0 ELSE len([x FOR x IN string_split_regex(raw, '\\s+') IF regexp_matches(x, '[A-Za-z0-9]')]) END AS words FROM book_lines),
totals AS (SELECT source_id, max(line) AS n_lines FROM lined GROUP BY 1),
opens AS (SELECT source_id, line, CASE WHEN head THEN trim(raw[3:]) ELSE 'p. ' || mark END AS heading, head FROM lined WHERE head OR mark IS NOT NULL),
spans AS (SELECT o.source_id, o.line, o.heading, o.head, coalesce(lead(o.line) OVER (PARTITION BY o.source_id ORDER BY o.line) - 1, n_lines) AS "end" FROM opens o JOIN totals USING (source_id)),
sized AS (SELECT s.*, (SELECT sum(words) FROM lined l WHERE l.source_id = s.source_id AND l.line BETWEEN s.line AND s."end") AS words FROM spans s),
dividing AS (SELECT source_id FROM sized WHERE head AND words >= 50 GROUP BY 1 HAVING count(*) > 1),
several AS (SELECT source_id FROM opens WHERE NOT head GROUP BY 1 HAVING count(*) > 1),
bands AS (SELECT * FROM sized WHERE head AND words > 0 AND source_id IN (FROM dividing) OR NOT head AND source_id IN (FROM several)),
bounded AS (SELECT source_id, line, heading, head, coalesce(lead(line) OVER (PARTITION BY source_id ORDER BY line) - 1, n_lines) AS "end" FROM bands JOIN totals USING (source_id)),
banded AS (SELECT b.*, (SELECT sum(words) FROM lined l WHERE l.source_id = b.source_id AND l.line BETWEEN b.line AND b."end") AS words FROM bounded b)
"""


def _books(spark, d) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    number = lambda x: x["turn"].cast("string")
    heading = lambda x: F.when(x["turn"] == 0, "## Introduction").otherwise(F.concat(F.lit("## Turn "), number(x), F.lit(" "), x["role"]))
    marker = lambda x: F.concat(F.lit("<!-- p."), (x["turn"] + 1).cast("string"), F.lit(" begins here -->"))
    book = lambda head: F.array_join(F.transform("turns", lambda x: F.concat(head(x), F.lit("\n\n"), x["text"], F.lit("\n"))), "\n")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    front = F.concat(F.lit("---\ntitle: c"), F.col("conv_id").cast("string"), F.lit("\n---\n"))
    both = F.posexplode(F.array(F.concat(front, book(heading)), book(marker))).alias("k", "text")
    return rows.select("conv_id", both).select((F.col("conv_id") * 2 + F.col("k")).alias("source_id"), "text")


def _book_lines(books: DataFrame) -> DataFrame:
    return source_lines(books, "source_id")


def _claims(spark, d) -> DataFrame:
    """A claim for each turn, placed in one way or another: by its quotation, its own words, a declared line, the words of a section, its heading."""
    t = table(spark, d, "conversations")
    k = F.col("turn") % 5
    clause = F.regexp_extract(F.coalesce("text", F.lit("")), r"^([^.\n]*)", 1)
    section = F.when(F.col("turn") == 0, "Introduction").otherwise(F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(" "), F.col("role")))
    return t.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("claim_id"),
        (F.col("conv_id") * 2 + (F.col("conv_id") + F.col("turn")) % 2).alias("source_id"),
        F.when(k == 1, clause).when(k == 4, "nothing of the kind").otherwise(F.array_join(F.reverse(F.split(F.coalesce("text", F.lit("")), " ")), " ")).alias("text"),
        F.when(k == 0, clause).alias("quote"),
        F.when(k == 2, (F.col("turn") + 1).cast("int")).alias("declared"),
        F.when(k >= 3, section).alias("section"),
        F.concat(F.lit("p. "), (F.col("turn") + 1 + F.col("conv_id") % 3).cast("string")).alias("pinpoint"),
    )


def _resolved(spark, d) -> tuple[DataFrame, DataFrame]:
    books = materialised(_books(spark, d))
    lines = materialised(_book_lines(books))
    return materialised(paging.resolved(_claims(spark, d), books, lines)), lines


@query(f"""WITH {BOOKS} SELECT source_id, line::INT AS line, "end"::INT AS "end", heading, false AS back, NOT head AS page, words::BIGINT AS words FROM banded""")
def text_bands(spark, d) -> DataFrame:
    return paging.bands(paging.worded(paging.zoned(_book_lines(_books(spark, d)))))


PAGES = """
solid AS (SELECT *, NOT regexp_matches(raw, '^\\s*($|<!--.*-->)') AS solid FROM lined),
paged AS (SELECT *, max(mark) OVER (PARTITION BY source_id ORDER BY line) AS page, max(CASE WHEN solid THEN line END) OVER (PARTITION BY source_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  min(CASE WHEN solid THEN line END) OVER (PARTITION BY source_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM solid),
ranged AS (SELECT p.source_id, p.line, p.page, CASE WHEN page IS NULL OR NOT solid THEN page ELSE least(page, (SELECT min(mark) - 1 FROM lined l WHERE l.source_id = p.source_id AND l.line < p.line AND l.line > coalesce(p.prev, 0))) END AS page_lo,
  CASE WHEN page IS NULL OR NOT solid THEN page ELSE greatest(page, (SELECT max(mark) FROM lined l WHERE l.source_id = p.source_id AND l.line > p.line AND l.line < coalesce(p.next, 1000000000))) END AS page_hi FROM paged p)
"""


@query(f"WITH {BOOKS}, {PAGES} SELECT source_id, line::INT AS line, page_lo::INT AS page_lo, page_hi::INT AS page_hi FROM ranged")
def line_pages(spark, d) -> DataFrame:
    return paging.page_ranges(_book_lines(_books(spark, d))).select("source_id", "line", "page_lo", "page_hi")


RESOLVED = f"""
claims AS (SELECT conv_id || '-' || turn AS claim_id, conv_id * 2 + (conv_id + turn) % 2 AS source_id, turn % 5 AS k, 'p. ' || (turn + 1 + conv_id % 3) AS pinpoint, turn + 1 + conv_id % 3 AS pin,
  CASE WHEN turn = 0 THEN 'Introduction' ELSE 'Turn ' || turn || ' ' || role END AS section, regexp_extract(coalesce(text, ''), '^([^.\\n]*)', 1) AS clause, turn, coalesce(text, '') AS whole FROM conversations),
book_folds AS (SELECT source_id, line, trim({NORM}) AS t FROM book_lines),
book_offsets AS (SELECT source_id, line, t, coalesce(sum(CASE WHEN t <> '' THEN length(t) + 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS a FROM book_folds),
book_bodies AS (SELECT source_id, lower(string_agg(t, ' ' ORDER BY line)) AS body FROM book_folds WHERE t <> '' GROUP BY 1),
sought AS (SELECT claim_id, source_id, k, pin, {sql_fold('clause')} AS q FROM claims WHERE k = 0 OR k = 1 AND length(clause) >= 30),
sought_in AS (SELECT claim_id, source_id, k, pin, q, string_split(body, q) AS p FROM sought JOIN book_bodies USING (source_id) WHERE length(q) >= 4 AND contains(body, q)),
sought_at AS (SELECT claim_id, source_id, k, pin, 1 + (nth - 1) * length(q) + list_sum([length(x) FOR x IN p[1:nth]])::BIGINT AS pos FROM (SELECT *, unnest(range(1, len(p))) AS nth FROM sought_in)),
sought_lines AS (SELECT s.claim_id, s.k, o.line, CASE WHEN r.page_lo IS NOT NULL AND pin BETWEEN r.page_lo AND r.page_hi THEN 0 ELSE 1 END AS off, CASE WHEN s.source_id % 2 = 0 AND o.line <= 3 THEN 1 ELSE 0 END AS hidden
  FROM sought_at s JOIN book_offsets o ON o.source_id = s.source_id AND o.t <> '' AND o.a <= s.pos AND s.pos < o.a + length(o.t) JOIN ranged r ON r.source_id = o.source_id AND r.line = o.line),
exact AS (SELECT claim_id, arg_min(line, (hidden, off, line)) AS line FROM sought_lines GROUP BY 1),
tops AS (SELECT c.claim_id, c.source_id, c.k, c.whole, min(s.line) AS top, arg_min(s."end", s.line) AS "end" FROM claims c JOIN spans s ON s.source_id = c.source_id AND s.head AND s.heading = c.section WHERE c.k >= 3 GROUP BY 1, 2, 3, 4),
wanted AS (SELECT claim_id, source_id, top, "end", unnest({sql_words('whole')}) AS w FROM tops WHERE k = 3),
totals_w AS (SELECT claim_id, count(*) AS total FROM wanted GROUP BY 1),
para AS (SELECT DISTINCT source_id, line, unnest({sql_words("trim(raw, ' ')")}) AS w FROM book_lines WHERE length(trim(raw, ' ')) >= 120 AND NOT starts_with(trim(raw, ' '), '#')),
scores AS (SELECT claim_id, line, count(*) / any_value(total) AS score FROM wanted JOIN para p USING (source_id, w) JOIN totals_w USING (claim_id) WHERE p.line BETWEEN top AND "end" GROUP BY 1, 2),
best AS (SELECT claim_id, arg_min(line, (-score, line)) AS line, max(score) AS score FROM scores GROUP BY 1 HAVING max(score) >= 0.3),
resolved AS (SELECT c.claim_id, c.source_id, c.pinpoint, c.pin, coalesce(e.line, CASE WHEN c.k = 2 THEN c.turn + 1 END, b.line, t.top) AS line,
  CASE WHEN e.line IS NOT NULL THEN CASE WHEN c.k = 0 THEN 'quotation' ELSE 'own words' END WHEN c.k = 2 THEN 'declared' WHEN b.line IS NOT NULL THEN 'paragraph' WHEN t.top IS NOT NULL THEN 'section' ELSE 'chapter-only' END AS via
  FROM claims c LEFT JOIN exact e USING (claim_id) LEFT JOIN best b USING (claim_id) LEFT JOIN tops t USING (claim_id))
"""


@query(f"WITH {BOOKS}, {PAGES}, {RESOLVED} SELECT claim_id, source_id, pinpoint, line::INT AS line, via FROM resolved")
def resolved_claims(spark, d) -> DataFrame:
    return _resolved(spark, d)[0]


EXPOSED = """
marks AS (SELECT source_id, line AS mark_line FROM resolved WHERE line IS NOT NULL),
hit AS (SELECT b.*, (SELECT count(*) FROM marks m WHERE m.source_id = b.source_id AND m.mark_line BETWEEN b.line AND b."end") AS mapped FROM banded b WHERE b.source_id IN (SELECT source_id FROM marks)),
density AS (SELECT source_id, sum(words) AS words, sum(mapped) AS mapped, min(line) AS start FROM hit GROUP BY 1),
stepped AS (SELECT *, CASE WHEN mapped = 0 AND NOT head AND lag(mapped = 0 AND NOT head, 1, false) OVER (PARTITION BY source_id ORDER BY line) THEN 0 ELSE 1 END AS step FROM hit),
numbered AS (SELECT *, sum(step) OVER (PARTITION BY source_id ORDER BY line) AS run FROM stepped),
gaps AS (SELECT source_id, min(line) AS line, max("end") AS "end", sum(words) AS words, CASE WHEN count(*) > 1 THEN 'pp. ' || replace(arg_min(heading, line), 'p. ', '') || '-' || replace(arg_max(heading, line), 'p. ', '') ELSE min(heading) END AS heading FROM numbered WHERE mapped = 0 GROUP BY source_id, run),
kept AS (SELECT g.* FROM gaps g JOIN density x USING (source_id) WHERE g.words >= 50 AND (g.heading = 'Introduction' OR g.words * x.mapped >= 2 * x.words)),
firsts AS (SELECT k.source_id, k.line, arg_min(trim(raw, ' '), l.line) AS t FROM kept k JOIN book_lines l ON l.source_id = k.source_id AND l.line > k.line AND l.line <= k."end" WHERE trim(raw, ' ') <> '' AND NOT regexp_matches(raw, '^\\s*(#|<!--|\\[\\^)') GROUP BY 1, 2),
said AS (SELECT *, coalesce(nullif(regexp_extract(t, '^(.+?[.?!])(?:\\s|$)', 1), ''), t) AS s FROM firsts)
"""


@query(f"""WITH {BOOKS}, {PAGES}, {RESOLVED}, {EXPOSED}
SELECT source_id, 'gap' AS kind, heading, line::INT AS line, "end"::INT AS "end", words::BIGINT AS words, 0::BIGINT AS mapped, CASE WHEN length(s) <= 150 THEN s ELSE rtrim(left(s, 147)) || '...' END AS "first" FROM kept JOIN said USING (source_id, line)
UNION ALL SELECT source_id, 'body', NULL, NULL, NULL, words::BIGINT, mapped::BIGINT, NULL FROM density
UNION ALL SELECT source_id, 'opening', NULL, NULL, NULL, coalesce((SELECT sum(l.words) FROM lined l WHERE l.source_id = x.source_id AND l.line < start), 0)::BIGINT, (SELECT count(*) FROM marks m WHERE m.source_id = x.source_id AND mark_line < start), NULL FROM density x
""")
def exposition_coverage(spark, d) -> DataFrame:
    placed, lines = _resolved(spark, d)
    return paging.exposition(lines, placed.filter("line IS NOT NULL"))


CHECKED = """
carried AS (SELECT source_id, list(mark) AS marks FROM lined WHERE mark IS NOT NULL GROUP BY 1),
pinned AS (SELECT r.*, list_contains(marks, r.pin) AS paged, x.page_lo, x.page_hi FROM resolved r JOIN carried USING (source_id) JOIN ranged x ON x.source_id = r.source_id AND x.line = r.line WHERE via IN ('quotation', 'own words')),
on_source AS (SELECT source_id, bool_or(paged) AS any_paged FROM pinned GROUP BY 1),
verdicts AS (SELECT claim_id, source_id, pinpoint, line, CASE WHEN NOT paged THEN 'unpaged' WHEN pin BETWEEN page_lo AND page_hi THEN 'ok' ELSE 'off' END AS verdict, CASE WHEN page_lo > pin THEN page_lo - pin ELSE page_hi - pin END AS d FROM pinned JOIN on_source USING (source_id) WHERE paged OR NOT any_paged)
"""


@query(f"WITH {BOOKS}, {PAGES}, {RESOLVED}, {CHECKED} SELECT claim_id, source_id, pinpoint, line::INT AS line, verdict, CASE WHEN verdict = 'off' THEN d END::INT AS off FROM verdicts")
def pinpoint_verdicts(spark, d) -> DataFrame:
    return paging.pinpoints(*_resolved(spark, d))


@query(f"""WITH {BOOKS}, {PAGES}, {RESOLVED}, {CHECKED},
modes AS (SELECT source_id, d, count(*) AS n FROM verdicts WHERE verdict = 'off' GROUP BY 1, 2),
moded AS (SELECT source_id, arg_min(d, (-n, abs(d), d)) AS shift, max(n) AS at_shift, min(d) AS low, max(d) AS high FROM modes GROUP BY 1),
counts AS (SELECT source_id, count(*) FILTER (verdict <> 'unpaged') AS checked, count(*) FILTER (verdict = 'off') AS wrong FROM verdicts GROUP BY 1)
SELECT source_id, checked, wrong, low::INT AS low, high::INT AS high, shift::INT AS shift, at_shift, CASE WHEN checked = 0 THEN 'unpaged' WHEN wrong = 0 THEN 'fine' WHEN wrong < 3 THEN 'slips' WHEN at_shift * 2 > wrong THEN 'shifted' ELSE 'scattered' END AS verdict
FROM counts LEFT JOIN moded USING (source_id)
""")
def pinpoint_patterns(spark, d) -> DataFrame:
    return paging.pinpoint_patterns(paging.pinpoints(*_resolved(spark, d)))


# ---------------------------------------------------------------- the talk of a text that its quotations cover
#: The tables' invented prose has no causal words; these stand for them.
SIGNAL = "(^| )(that|which|que|und|los)[ ,.]"

TALK = f"""
q AS (SELECT item_id, {sql_fold('text')} AS q FROM benchmark), d AS (SELECT doc_id, lower(trim({sql_norm('text')})) AS low, trim({sql_norm('text')}) AS body FROM documents),
pieces AS (SELECT item_id, doc_id, q, string_split(low, q) AS p FROM q JOIN d ON contains(low, q) WHERE length(q) >= 10),
nths AS (SELECT item_id, doc_id, q, p, unnest(range(1, len(p))) AS nth FROM pieces),
at_q AS (SELECT item_id, doc_id, q, (1 + (nth - 1) * length(q) + list_sum([length(x) FOR x IN p[1:nth]]))::BIGINT AS a FROM nths),
quoted AS (SELECT doc_id, item_id % 2 = 0 AS of_step, a, a + length(q) - length(ltrim(q, ' ."')) AS q0, a + length(rtrim(q, ' ."')) AS q1 FROM at_q),
classed AS (SELECT *, CASE WHEN trim(raw, ' ') = '' THEN 'blank' WHEN regexp_matches(trim(raw, ' '), '^(#|\\[\\^|===|\\|)') THEN 'out' ELSE 'text' END AS kind FROM runs),
stepped AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY line) = 'text', false) AS goes_on FROM classed),
numbered AS (SELECT *, sum(CASE WHEN kind = 'text' AND NOT goes_on THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS par FROM stepped),
pars AS (SELECT doc_id, par, min(line) AS line, min(a) AS a, max(a + length(t)) AS z FROM (SELECT *, min(line) OVER (PARTITION BY doc_id, par) AS first FROM numbered WHERE kind = 'text') WHERE t <> '' GROUP BY 1, 2),
following AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS next_line FROM pars),
cut_up AS (SELECT doc_id, line, next_line, a, string_split(regexp_replace(substr(body, a, z - a), '([.!?]["'')]?) +([A-Z"(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM following JOIN d USING (doc_id)),
each AS (SELECT doc_id, line, next_line, a, parts, unnest(range(1, len(parts) + 1)) AS k FROM cut_up),
sents AS (SELECT doc_id, line, next_line, parts[k] AS s, (a + coalesce(list_sum([length(x) + 1 FOR x IN parts[1:k - 1]]), 0))::BIGINT AS b FROM each),
talk AS (SELECT *, b + length(s) - length(ltrim(s, ' ."')) AS s0, b + length(rtrim(s, ' ."')) AS s1 FROM sents WHERE len(string_split_regex(trim(s, ' '), ' +')) >= 5 AND regexp_matches(lower(s), '{SIGNAL}')),
hits AS (SELECT t.doc_id, t.b, bool_or(of_step) AS covered FROM talk t JOIN quoted q ON q.doc_id = t.doc_id AND (s0 <= q0 AND q1 <= s1 OR q0 <= s0 AND s1 <= q1 AND s1 - s0 > 20
  OR q1 - q0 >= 30 AND (s0 <= q0 AND q1 >= s1 AND s1 - q0 >= greatest(30, (s1 - s0) // 2) OR q0 <= s0 AND q1 <= s1 AND q1 - s0 >= greatest(30, (s1 - s0) // 2))) GROUP BY 1, 2),
placed AS (SELECT q.doc_id, min(o.line) AS line FROM quoted q JOIN offsets o ON o.doc_id = q.doc_id AND o.t <> '' AND o.a <= q.a AND q.a < o.z WHERE of_step GROUP BY q.doc_id, q.a),
statuses AS (SELECT t.doc_id AS source_id, t.line::INT AS line, t.b::INT AS "begin", s AS sentence, CASE WHEN covered THEN 'covered' WHEN NOT covered THEN 'argued' WHEN EXISTS (SELECT 1 FROM placed p WHERE p.doc_id = t.doc_id AND p.line >= t.line AND (t.next_line IS NULL OR p.line < t.next_line)) THEN 'near' ELSE 'open' END AS status
  FROM talk t LEFT JOIN hits h ON h.doc_id = t.doc_id AND h.b = t.b)
"""


def _talk(spark, d) -> DataFrame:
    """Passages of even numbers are steps of a chain, the others are quoted by arguments."""
    docs = table(spark, d, "documents")
    found = materialised(places.occurrences(table(spark, d, "benchmark"), docs))
    span = F.col("spans")[0]
    words = F.substring(F.col("body"), span["begin"], span["end"] - span["begin"])
    quoted = found.select("source_id", "quote_id", "nth", span["begin"].alias("begin"), span["end"].alias("end"), words.alias("words"), (F.col("quote_id") % 2 == 0).alias("of_step"))
    lines = source_lines(docs)
    placed = places.lines_held(found, lines).filter(F.col("quote_id") % 2 == 0).select("source_id", F.col("first_line").alias("line"))
    return coverage.causal_coverage(docs.select(F.col("doc_id").alias("source_id"), "text"), lines, quoted, placed, SIGNAL)


@query(f"WITH {OFFSETS}, {TALK} SELECT * FROM statuses")
def covered_sentences(spark, d) -> DataFrame:
    return _talk(spark, d)


@query(f"""WITH {OFFSETS}, {TALK} SELECT source_id, count(*) AS sentences, count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'argued') AS argued, count(*) FILTER (status = 'near') AS near,
  count(*) FILTER (status IN ('near', 'open')) AS uncovered FROM statuses GROUP BY 1""")
def coverage_by_text(spark, d) -> DataFrame:
    return coverage.coverage_census(_talk(spark, d))


CHECKS = f"""
book_classed AS (SELECT l.source_id, l.line, o.t, o.a, l.head, trim(l.raw, ' ') = '' AS blank, coalesce(lag(l.head) OVER (PARTITION BY l.source_id ORDER BY l.line), false) AS after_head FROM lined l JOIN book_offsets o USING (source_id, line)),
book_blocked AS (SELECT *, sum((head OR blank OR after_head)::INT) OVER (PARTITION BY source_id ORDER BY line) AS block FROM book_classed),
book_blocks AS (SELECT source_id, min(a)::BIGINT AS lo, max(a + length(t))::BIGINT AS hi FROM book_blocked WHERE t <> '' GROUP BY source_id, block),
shaped_bodies AS (SELECT source_id, string_agg(t, ' ' ORDER BY line) AS body FROM book_folds WHERE t <> '' GROUP BY 1),
quote_spans AS (SELECT s.claim_id, s.source_id, s.at::BIGINT AS i, (s.at + length(q.q))::BIGINT AS j FROM (SELECT claim_id, source_id, k, pos AS at FROM sought_at) s JOIN sought q USING (claim_id) WHERE s.k = 0),
around AS (SELECT q.*, b.lo, greatest(b.hi, j) AS hi, body FROM quote_spans q JOIN book_blocks b ON b.source_id = q.source_id AND b.lo <= i AND i < b.hi JOIN shaped_bodies s ON s.source_id = q.source_id),
bounds AS (SELECT *, lo + length(regexp_extract(substr(body, lo, i - lo), '^(.*{SQL_END})(?: |$)', 1)) AS s0, length(regexp_extract(substr(body, j - 1, hi - j + 1), '^(.*?{SQL_END})(?: |$)', 1)) AS c FROM around),
cut_off AS (SELECT claim_id, source_id, lower(regexp_extract(substr(body, s0, i - s0), '([A-Za-z'']+)[^A-Za-z'']*$', 1)) AS last, regexp_replace(ltrim(substr(body, j, CASE WHEN c > 0 THEN j - 1 + c ELSE hi END - j)), '^[,;:-]+ *', '') AS r FROM bounds),
wrongs AS (SELECT source_id, count(*) AS n, min(d) AS low, max(d) AS high FROM verdicts WHERE verdict = 'off' GROUP BY 1),
announced AS (SELECT source_id, string_agg(left(heading, 40) || ' (' || words || ' words)', '; ' ORDER BY line) AS m FROM kept WHERE heading = 'Introduction' GROUP BY 1),
openings AS (SELECT source_id, mapped, coalesce((SELECT sum(l.words) FROM lined l WHERE l.source_id = x.source_id AND l.line < start), 0) AS words, (SELECT count(*) FROM marks m WHERE m.source_id = x.source_id AND mark_line < start) AS above FROM density x)
"""


@query(f"""WITH {BOOKS}, {PAGES}, {RESOLVED}, {EXPOSED}, {CHECKED}, {CHECKS}
SELECT source_id, 'quotation' AS "check", '!' AS severity, claim_id AS title, clause AS message FROM claims JOIN resolved USING (claim_id, source_id) WHERE k = 0 AND via <> 'quotation' AND length({sql_fold('clause')}) >= 4
UNION ALL SELECT source_id, 'quotation-context', '?', claim_id, 'drops ' || last FROM cut_off WHERE last IN ({sql_list(places.LEADING_HEDGES)})
UNION ALL SELECT source_id, 'quotation-context', '?', claim_id, 'stops before ' || r FROM cut_off WHERE lower(regexp_extract(r, '^([A-Za-z'']+)', 1)) IN ({sql_list(places.CORRECTIVE)}) OR list_bool_or([starts_with(lower(r), x) FOR x IN [{sql_list(places.CORRECTIVE_PHRASES)}]])
UNION ALL SELECT source_id, 'pinpoint', '?', claim_id, 'cites ' || pinpoint || ', off by ' || coalesce(d::VARCHAR, '?') || ', line ' || line FROM verdicts WHERE verdict = 'off'
UNION ALL SELECT source_id, 'pinpoint', '?', NULL, n || ' off by ' || low || ' to ' || high FROM wrongs WHERE n >= 3
UNION ALL SELECT source_id, 'pinpoint-pages', '?', NULL, 'no pinpoint cites a page that the text carries' FROM verdicts GROUP BY 1 HAVING bool_and(verdict = 'unpaged')
UNION ALL SELECT source_id, 'exposition-gap', '?', NULL, m FROM announced
UNION ALL SELECT source_id, 'exposition-opening', '?', NULL, words || ' words before the first section' FROM openings WHERE words >= 100 AND above <= 1 AND mapped > 0
UNION ALL SELECT source_id, 'provenance-coverage', '?', NULL, count(*) || ' claims without a place' FROM resolved WHERE line IS NULL GROUP BY 1
""")
def provenance_findings(spark, d) -> DataFrame:
    """All checks of the claims on the books of conversations. None of these claims is a splice, which SQL could not tell."""
    books = materialised(_books(spark, d))
    return provenance_checks.provenance_findings(_claims(spark, d), books, materialised(_book_lines(books)))
