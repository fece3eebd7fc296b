"""Queries over laid-out pages, chapters, chunks and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chapters as C
from ..operators import chunking as K
from ..operators import layout as L
from ..operators import review as R
from ..operators import synthesis as S
from ..sources.layout import cut_pages, from_lines, range_problems, synthetic_layout
from .text_queries import SQUEEZE, WS, cleaned_sql, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


def _layout_sql(columns: int = 1) -> str:
    """CTEs raw_pages and raw_blocks (with page size, page count and median font) as synthetic_layout has them."""
    per = 4 * columns
    left, right = ("50.0", "550.0") if columns == 1 else (f"CASE WHEN i % {per} % 2 = 0 THEN 50.0 ELSE 320.0 END", f"CASE WHEN i % {per} % 2 = 0 THEN 280.0 ELSE 550.0 END")
    extras = [("true", "source || ' · ' || page", 10, 20), ("page % 4 = 0", "page::VARCHAR", 10, 770), ("page % 2 = 0", "chr(2) || ' caption'", 9, 640), ("page % 5 = 0", "'1160 - 1170'", 9, 660), ("page % 3 = 0", "'1. note'", 9, 680)]
    unions = "".join(f" UNION ALL SELECT book_id, page, {per + k}, {text}, {size}.0, 50.0, {top}.0, 550.0 FROM raw_pages WHERE {when}" for k, (when, text, size, top) in enumerate(extras))
    return f"""WITH lines AS (SELECT doc_id AS book_id, source, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS ls FROM documents),
body AS (SELECT book_id, source, unnest(ls) AS text, unnest(range(len(ls))) AS i FROM lines),
raw_pages AS (SELECT book_id, source, unnest(range(1, (len(ls) + {per - 1}) // {per} + 1)) AS page FROM lines WHERE len(ls) > 0),
raw AS (SELECT book_id, i // {per} + 1 AS page, i % {per} AS seq, text, CASE WHEN i % {per} = 0 AND length(text) <= 120 THEN 16.0 ELSE 12.0 END AS font, {left} AS x0, 110.0 + 140 * (i % {per} // {columns}) AS y0, {right} AS x1 FROM body{unions}),
weights AS (SELECT book_id, font, sum(length(text)) AS w FROM raw GROUP BY ALL),
ranks AS (SELECT book_id, font, sum(w) OVER (PARTITION BY book_id ORDER BY font) AS hi, sum(w) OVER (PARTITION BY book_id ORDER BY font) - w AS lo, sum(w) OVER (PARTITION BY book_id) AS n FROM weights),
medians AS (SELECT book_id, avg(font)::DOUBLE AS median FROM (SELECT book_id, font FROM ranks WHERE lo < (n + 1) // 2 AND hi >= (n + 1) // 2 UNION ALL SELECT book_id, font FROM ranks WHERE lo < n // 2 + 1 AND hi >= n // 2 + 1) GROUP BY book_id),
counts AS (SELECT book_id, count(*) AS n_pages FROM raw_pages GROUP BY book_id),
raw_blocks AS (SELECT raw.*, median, n_pages, y0 < 96 OR y0 > 704 AS edge, lower(trim(regexp_replace(text, '[0-9]+', '#', 'g'))) AS form, length(regexp_replace(text, '[\\p{{L}}\\s\\x1c-\\x1f]', '', 'g'))::DOUBLE / length(text) AS noise
  FROM raw JOIN medians USING (book_id) JOIN counts USING (book_id))"""


def _rules_sql() -> str:
    """CTEs s0 .. s6: raw_blocks with dropped_by after each rule and its guard."""
    small = "font < median * 0.92::DOUBLE"
    conditions = {
        "running_heads": "edge AND (book_id, form) IN (SELECT (book_id, form) FROM running)",
        "page_numbers": "edge AND regexp_full_match(trim(text), '[0-9ivxlcdmIVXLCDM.\\s–—-]+')",
        "figure_captions": "regexp_matches(text, '^[\\x00-\\x1f]')",
        "listings": "length(text) >= 40 AND noise > 0.30::DOUBLE",
        "numeric_captions": f"{small} AND noise > 0.6::DOUBLE",
        "footnotes": f"{small} AND y0 > 600 AND regexp_matches(text, '^[0-9]{{1,3}}[\\s.)]')",
    }
    sql = ", running AS (SELECT book_id, form FROM raw_blocks WHERE edge GROUP BY book_id, form, n_pages HAVING count(DISTINCT page) >= greatest(2, n_pages * 0.3::DOUBLE)), s0 AS (SELECT *, NULL::VARCHAR AS dropped_by FROM raw_blocks)"
    for k, (name, condition) in enumerate(conditions.items()):
        sql += f""", d{k} AS (SELECT *, dropped_by IS NULL AND ({condition}) AS hit FROM s{k}),
s{k + 1} AS (SELECT * EXCLUDE (hit, dropped_by), CASE WHEN hit AND NOT (count(*) FILTER (dropped_by IS NULL AND NOT hit) OVER w < count(*) FILTER (dropped_by IS NULL) OVER w * (1 - 0.6::DOUBLE)) THEN '{name}' ELSE dropped_by END AS dropped_by FROM d{k} WINDOW w AS (PARTITION BY book_id, page))"""
    return sql


def _layout(spark: SparkSession, sf_dir: str, columns: int = 1) -> tuple[DataFrame, DataFrame]:
    return synthetic_layout(table(spark, sf_dir, "documents"), columns)


@query(f"{_layout_sql()} SELECT book_id, median AS median_font FROM medians")
def weighted_median_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.weighted_median(_layout(spark, sf_dir)[0])


@query(f"{_layout_sql()} SELECT book_id, n_pages, sum(length(text))::DOUBLE / n_pages AS chars_per_page, sum(length(text))::DOUBLE / n_pages >= 100 AS has_text_layer FROM raw_blocks GROUP BY book_id, n_pages")
def text_layer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.text_layer(*_layout(spark, sf_dir))


@query(f"{_layout_sql()}{_rules_sql()} SELECT book_id, page, seq, dropped_by FROM s6")
def rules_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = L.tag_dropped(*_layout(spark, sf_dir))
    return tagged.select("book_id", F.col("page").cast("long").alias("page"), F.col("seq").cast("long").alias("seq"), "dropped_by")


@query(f"{_layout_sql()}{_rules_sql()} SELECT dropped_by AS rule, count(*) AS n_blocks, count(DISTINCT book_id) AS n_books FROM s6 WHERE dropped_by IS NOT NULL GROUP BY dropped_by")
def dropped_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = L.tag_dropped(*_layout(spark, sf_dir)).where("dropped_by is not null")
    return tagged.groupBy(F.col("dropped_by").alias("rule")).agg(F.count(F.lit(1)).alias("n_blocks"), F.countDistinct("book_id").alias("n_books"))


@query(f"""{_layout_sql(2)}, sides AS (SELECT *, count(*) FILTER (x1 - x0 < 420 AND x1 <= 324) OVER w AS l, count(*) FILTER (x1 - x0 < 420 AND x1 > 324 AND x0 >= 276) OVER w AS r FROM raw_blocks WINDOW w AS (PARTITION BY book_id, page))
SELECT book_id, page, seq, CASE WHEN l >= 3 AND r >= 3 THEN 2 ELSE 1 END::BIGINT AS n_columns, row_number() OVER (PARTITION BY book_id, page ORDER BY CASE WHEN l >= 3 AND r >= 3 AND x1 - x0 < 420 AND x0 >= 276 THEN 1 ELSE 0 END, round_even(y0, 1), x0, seq) AS order_no FROM sides""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, pages = _layout(spark, sf_dir, 2)
    found = L.reading_order(L.with_pages(blocks, pages))
    return found.select("book_id", *(F.col(c).cast("long").alias(c) for c in ("page", "seq", "n_columns", "order_no")))


_MERGED_SQL = f"""{_layout_sql()}{_rules_sql()}, books AS (SELECT book_id, list([{{'text': text, 'page': page::BIGINT, 'font': font::DOUBLE}}] ORDER BY page, round_even(y0, 1), x0, seq) AS items FROM s6 WHERE dropped_by IS NULL GROUP BY book_id),
folded AS (SELECT book_id, list_reduce(items, lambda a, b: CASE WHEN NOT regexp_matches(a[-1].text, '[.!?…:;»"”’]{WS}*$') AND abs(a[-1].font - b[1].font) <= 0.6::DOUBLE AND length(a[-1].text) + 1 + length(b[1].text) <= 5000
  THEN a[1 : len(a) - 1] || [{{'text': a[-1].text || ' ' || b[1].text, 'page': a[-1].page, 'font': a[-1].font}}] ELSE a || b END) AS paragraphs FROM books),
merged AS (SELECT book_id, block_no, {cleaned_sql("p.text")} AS text, p.page AS page, p.font AS font_size FROM (SELECT book_id, unnest(paragraphs) AS p, unnest(range(len(paragraphs))) AS block_no FROM folded))"""


@query(f"{_MERGED_SQL} SELECT * FROM merged WHERE length(text) > 0")
def merged_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.cleaned_blocks(*_layout(spark, sf_dir))
    return found.select("book_id", F.col("block_no").cast("long").alias("block_no"), "text", F.col("page").cast("long").alias("page"), "font_size")


_COUNTS_SQL = ", ".join(f"count(*) FILTER (dropped_by = '{r}') AS {r}" for r in L.RULES)
_SAID_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {r} > 0 THEN '{L.RULE_LABELS[r]} ' || {r} END" for r in L.RULES) + "], lambda x: x IS NOT NULL), ', ')"


@query(f"""{_MERGED_SQL}, by_rule AS (SELECT book_id, {_COUNTS_SQL}, sum(length(text))::BIGINT AS chars_before FROM s6 GROUP BY book_id),
after AS (SELECT book_id, count(*) AS kept, sum(length(text))::BIGINT AS chars_after FROM merged WHERE length(text) > 0 GROUP BY book_id),
joined AS (SELECT by_rule.*, coalesce(kept, 0) AS kept, coalesce(chars_after, 0) AS chars_after, {_SAID_SQL} AS said FROM by_rule LEFT JOIN after USING (book_id))
SELECT * EXCLUDE (said), CASE WHEN chars_before = 0 THEN 'nothing to clean' ELSE 'cleaning removed ' || format('{{:.1f}}%', (1 - chars_after / chars_before) * 100) || ' of the characters' || CASE WHEN length(said) > 0 THEN ': ' || said ELSE '' END END AS summary FROM joined""")
def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clean_report(*_layout(spark, sf_dir))


def _numbered(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("block_no", F.row_number().over(Window.partitionBy("book_id").orderBy("page", "seq")) - 1)


@query(f"""{_layout_sql()}, body_blocks AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page, seq) - 1 AS block_no FROM raw_blocks),
bw AS (SELECT book_id, font, sum(length(text)) AS w FROM body_blocks GROUP BY ALL),
br AS (SELECT book_id, font, sum(w) OVER (PARTITION BY book_id ORDER BY font) AS hi, sum(w) OVER (PARTITION BY book_id ORDER BY font) - w AS lo, sum(w) OVER (PARTITION BY book_id) AS n FROM bw),
bm AS (SELECT book_id, avg(font)::DOUBLE AS m FROM (SELECT book_id, font FROM br WHERE lo < (n + 1) // 2 AND hi >= (n + 1) // 2 UNION ALL SELECT book_id, font FROM br WHERE lo < n // 2 + 1 AND hi >= n // 2 + 1) GROUP BY book_id),
h AS (SELECT *, font >= m * 1.15::DOUBLE AND length(text) <= 120 AS head FROM body_blocks JOIN bm USING (book_id)),
runs AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY book_id ORDER BY block_no) AS run FROM h)
SELECT book_id, block_no, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS kind, run - min(run) OVER (PARTITION BY book_id) AS chapter_idx,
  coalesce(max(CASE WHEN head THEN text END) OVER (PARTITION BY book_id, run), 'Untitled') AS chapter_title FROM runs""")
def font_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.by_font(_numbered(_layout(spark, sf_dir)[0]))
    return found.select("book_id", F.col("block_no").cast("long").alias("block_no"), "kind", F.col("chapter_idx").cast("long").alias("chapter_idx"), "chapter_title")


@query("""SELECT conv_id AS book_id, turn AS block_no, CASE WHEN mark THEN 'heading' ELSE 'paragraph' END AS kind, run - min(run) OVER (PARTITION BY conv_id) AS chapter_idx,
  coalesce(max(CASE WHEN mark THEN left(text, 60) END) OVER (PARTITION BY conv_id, run), 'Beginning') AS chapter_title
  FROM (SELECT *, role = 'user' AND turn > 0 AS mark, count(*) FILTER (role = 'user' AND turn > 0) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations)""")
def chapters_at_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("block_no"), "text", "role")
    marks = turns.where("role = 'user' and block_no > 0").select("book_id", "block_no", F.substring("text", 1, 60).alias("title"), F.lit(True).alias("is_heading"))
    found = C.cut_at_marks(turns, marks)
    return found.select("book_id", "block_no", "kind", F.col("chapter_idx").cast("long").alias("chapter_idx"), "chapter_title")


@query(f"""{_layout_sql()}, numbered AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page, seq) - 1 AS block_no FROM raw_blocks),
toc AS (SELECT book_id, page, text AS title, trim({cleaned_sql("text")}) AS key FROM raw_blocks WHERE seq = 0),
marks AS (SELECT book_id, title, coalesce(min(block_no) FILTER (trim(text) = key), min(block_no)) AS block_no, count(*) FILTER (trim(text) = key) > 0 AS exact FROM numbered JOIN toc USING (book_id, page) GROUP BY book_id, page, title, key)
SELECT book_id, block_no, page::BIGINT AS page, text, CASE WHEN coalesce(exact, false) THEN 'heading' ELSE 'paragraph' END AS kind, count(title) OVER w - 1 AS chapter_idx, last_value(title IGNORE NULLS) OVER w AS chapter_title
  FROM numbered LEFT JOIN marks USING (book_id, block_no) WINDOW w AS (PARTITION BY book_id ORDER BY block_no)""")
def bookmark_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters cut at a bookmark for each page, whose title is the page's first line."""
    blocks = _numbered(_layout(spark, sf_dir)[0])
    toc = blocks.where("seq = 0").select("book_id", F.col("page").alias("toc_idx"), F.col("text").alias("title"), "page")
    found = C.cut_at_marks(blocks.select("book_id", "block_no", "text", "page"), C.bookmark_marks(blocks, toc))
    return found.select("book_id", *(F.col(c).cast("long").alias(c) for c in ("block_no", "page", "chapter_idx")), "text", "kind", "chapter_title")


@query(f"{_layout_sql()} SELECT book_id, (page - 1)::BIGINT AS page, text AS title, n_pages, n_pages < 3 AS short FROM raw_blocks WHERE seq = 0 AND page BETWEEN 2 AND 3")
def clipped_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks of pages 2 to 3, numbered as the clipping is, and whether the book is too short for it."""
    blocks, pages = _layout(spark, sf_dir)
    toc = blocks.where("seq = 0").select("book_id", F.col("page").alias("toc_idx"), F.col("text").alias("title"), "page")
    cut = cut_pages(blocks, pages, toc, 2, 3)[2]
    return cut.join(range_problems(pages, 3), "book_id").select("book_id", F.col("page").cast("long").alias("page"), "title", "n_pages", F.col("problem").isNotNull().alias("short"))


_SPANS = "list_transform(string_split(l, ','), lambda x: {'text': x, 'size': 10.0 + length(x) % 5, 'flags': 8 * (length(x) % 2)})"


@query(f"""SELECT doc_id AS book_id, {SQUEEZE.format("replace(replace(text, ',', ''), chr(10), ' ')")} AS text, list_max(list_transform(pieces, lambda x: 10 + length(x) % 5))::DOUBLE AS font_size, len(list_filter(pieces, lambda x: length(x) % 2 = 0)) = 0 AS is_mono
  FROM (SELECT doc_id, text, flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, ','))) AS pieces FROM documents) WHERE length({SQUEEZE.format("replace(replace(text, ',', ''), chr(10), ' ')")}) > 0""")
def blocks_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, font size and monospace of blocks that hold lines of spans."""
    span = lambda x: F.struct(x.alias("text"), (F.lit(10.0) + F.length(x) % 5).alias("size"), (F.length(x) % 2 * 8).alias("flags"))
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.struct(F.transform(F.split(line, ",", -1), span).alias("spans")))
    return from_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), lines.alias("lines")))


@query("""SELECT book_id, block_no, document, text FROM (SELECT source AS book_id, doc_id AS document, place AS block_no, CASE WHEN place = 0 AND doc_id % 5 = 0 THEN (doc_id % 500)::VARCHAR ELSE l END AS text
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents)) WHERE document % 2 = 0 OR document % 5 <> 0""")
def endnotes_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents outside the contents that begin with a bare number are left out."""
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\n", -1)).alias("block_no", "l"))
    pieces = lines.select("book_id", "document", F.col("block_no").cast("long").alias("block_no"), F.when((F.col("block_no") == 0) & (F.col("document") % 5 == 0), (F.col("document") % 500).cast("string")).otherwise(F.col("l")).alias("text"))
    toc = pieces.where("document % 2 = 0").select("book_id", "document")
    return C.without_endnotes(pieces, toc).select("book_id", "block_no", "document", "text")


@query("""SELECT conv_id AS book_id, turn AS block_no, count(*) FILTER (mark) OVER w - min(CASE WHEN mark THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 0 - 1 AS chapter_idx
  FROM (SELECT conv_id, turn, (turn // 4 % 2 = 0 AND turn % 4 = 0) OR (turn // 4 % 2 = 1 AND turn % 4 = 2) AS mark FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def anchored_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of documents of four turns: even ones are listed whole, odd ones by an anchor inside."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("block_no"), F.floor(F.col("turn") / 4).cast("string").alias("document"), F.array(F.concat(F.lit("a"), F.col("turn").cast("string"))).alias("anchors"), "text")
    k = F.floor(F.col("block_no") / 4)
    anchor = F.when(k % 2 == 1, F.concat(F.lit("a"), (4 * k + 2).cast("string")))
    toc = turns.where("block_no % 4 = 0").select("book_id", k.cast("int").alias("toc_idx"), F.concat(F.lit("part "), "document").alias("title"), "document", anchor.alias("anchor"))
    found = C.cut_at_marks(turns.select("book_id", "block_no", "text"), C.anchor_marks(turns, toc))
    return found.select("book_id", "block_no", F.col("chapter_idx").cast("long").alias("chapter_idx"))


@query("SELECT conv_id AS book_id, text, CASE turn WHEN 2 THEN 0 WHEN 0 THEN 1 END::BIGINT AS chapter_idx FROM conversations WHERE turn IN (0, 2)")
def chapters_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), "text", F.col("turn").cast("int").alias("chapter_idx"))
    return C.select_chapters(turns, [2, 0, 999]).select("book_id", "text", F.col("chapter_idx").cast("long").alias("chapter_idx"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("book_id"), F.lit(0).alias("chapter_idx"), F.posexplode(F.split("text", "\n", -1)).alias("block_idx", "text"))


def _pack_sql(pieces: str, limit: int = 800) -> str:
    """Greedy packing of a non-empty list to limit characters, lines divided by chr(30)."""
    return f"string_split(list_reduce({pieces}, lambda a, x: CASE WHEN length(split_part(a, chr(30), -1)) = 0 THEN a || x WHEN length(split_part(a, chr(30), -1)) + 1 + length(x) > {limit} THEN a || chr(30) || x ELSE a || ' ' || x END), chr(30))"


def _split_sql(s: str, depth: int = 0, limit: int = 800) -> str:
    separator, mark = (("; ", ";"), (", ", ","), (" ", ""))[depth] if depth < 3 else ("", "")
    if depth == 3:
        return f"list_transform(range(0, greatest(length({s}), 1), {limit}), lambda i{depth}: substring({s}, i{depth} + 1, {limit}))"
    further = _split_sql(f"y{depth}", depth + 1, limit)
    parts = f"list_transform(string_split({s}, '{separator}'), lambda p{depth}, k{depth}: CASE WHEN k{depth} < len(string_split({s}, '{separator}')) THEN p{depth} || '{mark}' ELSE p{depth} END)"
    return f"CASE WHEN length({s}) <= {limit} THEN [{s}] WHEN contains({s}, '{separator}') THEN flatten(list_transform({_pack_sql(parts, limit)}, lambda y{depth}: {further})) ELSE {_split_sql(s, depth + 1, limit)} END"


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])[\\s\\x{00a0}]+', '\\1' || chr(31), 'g'), chr(31)), lambda z: trim(z)), lambda z: length(z) > 0)"
_CHUNKS_SQL = f"""WITH t AS (SELECT doc_id AS book_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS block_idx FROM documents),
spoken AS (SELECT *, lead(block_idx) OVER (PARTITION BY book_id ORDER BY block_idx) IS NULL AS last, {_SENTENCES} AS s FROM t WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
cut AS (SELECT *, CASE WHEN length(text) <= 800 THEN [array_to_string(s, ' ')] ELSE {_pack_sql(f"flatten(list_transform(s, lambda q: {_split_sql('q')}))")} END AS pieces FROM spoken),
pieces AS (SELECT book_id, block_idx, last, len(pieces) AS n, unnest(range(len(pieces))) AS piece_idx, unnest(pieces) AS text FROM cut),
chunks AS (SELECT book_id, block_idx, piece_idx, text, CASE WHEN piece_idx < n - 1 THEN 0.25 WHEN last THEN 1.5 ELSE 0.7 END::DOUBLE AS pause_after FROM pieces WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]'))"""


@query(f"{_CHUNKS_SQL} SELECT * FROM chunks")
def speech_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.chunks(_texts(table(spark, sf_dir, "documents")))
    return found.select("book_id", F.col("block_idx").cast("long").alias("block_idx"), F.col("piece_idx").cast("long").alias("piece_idx"), "text", "pause_after")


@query(f"""{_CHUNKS_SQL} SELECT book_id AS doc_id, count(*) AS n_chunks, round(sum(floor(24000 * length(text) / 15) / 24000 + pause_after), 6) AS seconds,
  round_even(sum(length(text)) / 15 / 60 / 60.0, 1) AS synth_minutes FROM chunks GROUP BY book_id""")
def speech_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: chunks, seconds of speech with pauses, and minutes to synthesise them."""
    found = K.chunks(_texts(table(spark, sf_dir, "documents")))
    per = found.groupBy(F.col("book_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.sum(S.T.speech_seconds(F.length("text")) + F.col("pause_after")), 6).alias("seconds"), F.sum(F.length("text")).alias("_chars"))
    return per.withColumn("synth_minutes", F.bround(F.col("_chars") / 15 / 60 / S.StubEngine.realtime, 1)).drop("_chars")


@query(f"""WITH p AS (SELECT doc_id, text, {_SENTENCES} AS s FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) >= 200)[1] AS text FROM documents) WHERE text IS NOT NULL),
cut AS (SELECT doc_id, CASE WHEN length(text) <= 600 THEN [array_to_string(s, ' ')] ELSE {_pack_sql(f"flatten(list_transform(s, lambda q: {_split_sql('q', 0, 600)}))", 600)} END AS pieces FROM p)
SELECT doc_id, list_filter(pieces, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))[1] AS text FROM cut WHERE list_filter(pieces, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))[1] IS NOT NULL""")
def sample_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of each document's first long paragraph."""
    return table(spark, sf_dir, "documents").select("doc_id", K.sample_chunk(F.col("text")).alias("text")).where("text is not null")


@query(f"{_CHUNKS_SQL} SELECT book_id, block_idx, piece_idx, row_number() OVER (PARTITION BY book_id ORDER BY block_idx, piece_idx) AS done, count(*) OVER (PARTITION BY book_id) AS total FROM chunks")
def chunk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.progress_of(K.chunks(_texts(table(spark, sf_dir, "documents"))), "book_id", ["block_idx", "piece_idx"])
    return found.select("book_id", *(F.col(c).cast("long").alias(c) for c in ("block_idx", "piece_idx", "done", "total")))


_ANNOUNCED_SQL = _CHUNKS_SQL.replace("""SELECT doc_id AS book_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS block_idx FROM documents)""", """SELECT book_id, chapter_idx, block_idx, text FROM blocks UNION ALL
  SELECT book_id, chapter_idx, -1, any_value(chapter_title) FROM blocks GROUP BY book_id, chapter_idx HAVING NOT bool_or(block_idx = 0 AND kind = 'heading' AND text = chapter_title))""").replace("WITH t AS", """WITH blocks AS (SELECT conv_id AS book_id, turn AS chapter_idx, CASE WHEN turn % 2 = 0 THEN string_split(text, chr(10))[1] ELSE 'Turn ' || turn END AS chapter_title, CASE WHEN k = 0 THEN 'heading' ELSE 'paragraph' END AS kind, k AS block_idx, l AS text
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS k FROM conversations)), t AS""").replace("PARTITION BY book_id ORDER BY block_idx", "PARTITION BY book_id, chapter_idx ORDER BY block_idx").replace("SELECT book_id, block_idx", "SELECT book_id, chapter_idx, block_idx")


@query(f"{_ANNOUNCED_SQL} SELECT * FROM chunks")
def announced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of chapters whose titles are read out first, unless the first block is the title."""
    turns = table(spark, sf_dir, "conversations")
    title = F.when(F.col("turn") % 2 == 0, F.get(F.split("text", "\n", -1), F.lit(0))).otherwise(F.concat(F.lit("Turn "), F.col("turn").cast("string")))
    blocks = turns.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chapter_idx"), title.alias("chapter_title"), F.posexplode(F.split("text", "\n", -1)).alias("block_idx", "text"))
    found = K.chunks(blocks.withColumn("kind", F.when(F.col("block_idx") == 0, "heading").otherwise("paragraph")))
    return found.select("book_id", *(F.col(c).cast("long").alias(c) for c in ("chapter_idx", "block_idx", "piece_idx")), "text", "pause_after")


_TURNS = "SELECT conv_id AS book_id, turn AS chapter_idx, left(text, 40) AS title, floor(24000 * length(text) / 15) / 24000 + 1.5 AS seconds FROM conversations"
_TIMES = f"SELECT *, sum(round_even(seconds * 1000, 0)::BIGINT) OVER (PARTITION BY book_id ORDER BY chapter_idx)::BIGINT AS end_ms, round_even(seconds * 1000, 0)::BIGINT AS ms FROM ({_TURNS})"


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chapter_idx"), "text", F.lit(K.AFTER_CHAPTER).alias("pause_after"))
    seconds = S.chapter_seconds(turns)
    titles = turns.select("book_id", "chapter_idx", F.substring("text", 1, 40).alias("title"))
    return S.timeline(seconds.join(titles, ["book_id", "chapter_idx"]))


@query(f"SELECT book_id, chapter_idx, title, seconds, end_ms - ms AS start_ms, end_ms FROM ({_TIMES})")
def chapter_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir).select("book_id", "chapter_idx", "title", "seconds", "start_ms", "end_ms")


def _escape_sql(c: str) -> str:
    return f"regexp_replace({c}, '([=;#\\\\\\n])', '\\\\\\1', 'g')"


@query(f"""SELECT book_id, ';FFMETADATA1' || chr(10) || 'title=book ' || book_id || chr(10) || CASE WHEN book_id % 2 = 0 THEN 'artist=a\\;b' || chr(10) ELSE '' END || 'genre=Audiobook' || chr(10) ||
  string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (end_ms - ms) || chr(10) || 'END=' || end_ms || chr(10) || 'title=' || {_escape_sql('title')}, chr(10) ORDER BY chapter_idx) || chr(10) AS metadata FROM ({_TIMES}) GROUP BY book_id""")
def chapter_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = _timeline(spark, sf_dir)
    books = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id")).distinct()
    books = books.select("book_id", F.concat(F.lit("book "), F.col("book_id").cast("string")).alias("title"), F.when(F.col("book_id") % 2 == 0, "a;b").alias("author"))
    return S.chapter_metadata(chapters, books)


@query("""SELECT conv_id AS book_id, row_number() OVER w AS number, CASE WHEN row_number() OVER w < 10 THEN '0' ELSE '' END || row_number() OVER w || ' ' ||
  coalesce(nullif(trim(regexp_replace(regexp_replace(left(text, 40), '[<>:"/\\\\|?*\\x00-\\x1f]', ' ', 'g'), '\\s+', ' ', 'g')), ''), 'chapter') || '.mp3' AS file_name FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def file_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chapter_idx"), F.substring("text", 1, 40).alias("title"))
    return S.file_plan(turns).select("book_id", F.col("number").cast("long").alias("number"), "file_name")


@query("""SELECT conv_id AS book_id, sum(CASE WHEN turn % 3 <> 2 THEN length(text)::DOUBLE END) AS seconds, count(*) FILTER (turn % 3 = 2) AS missing, coalesce(array_to_string(list_sort(list(lpad(turn::VARCHAR, 4, '0')) FILTER (turn % 3 = 2))[1:5], ','), '') AS first_missing FROM conversations GROUP BY conv_id""")
def parts_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    parts = turns.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("part_idx"), key.alias("key"))
    have = turns.where("turn % 3 <> 2").select(key.alias("key"), F.length("text").cast("double").alias("seconds"))
    return S.joined_parts(parts, have).select("book_id", "seconds", "missing", F.array_join(F.transform("first_missing", lambda k: F.split_part(k, F.lit("/"), F.lit(2))), ",").alias("first_missing"))


@query("SELECT conv_id AS book_id, turn AS chapter_idx, role AS title, text FROM conversations")
def review_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns cut at line ends and put together again as review entries."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chapter_idx"), F.col("role").alias("chapter_title"), F.posexplode(F.split("text", "\n", -1)).alias("block_idx", "text"))
    return R.review_entries(turns).select("book_id", "chapter_idx", "title", F.replace("text", F.lit("\n\n"), F.lit("\n")).alias("text"))


@query("""SELECT conv_id AS book_id, chapter_idx, role AS chapter_title, row_number() OVER (PARTITION BY conv_id, chapter_idx ORDER BY k) - 1 AS block_idx, l AS text FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chapter_idx, role, text, turn FROM conversations),
  LATERAL (SELECT unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS k) WHERE length(trim(l)) > 0""")
def review_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chapter_idx"), F.col("role").alias("chapter_title"), F.posexplode(F.split("text", "\n", -1)).alias("block_idx", "text"))
    found = R.document_from_review(R.review_json(R.review_entries(turns)))
    return found.select("book_id", F.col("chapter_idx").cast("long").alias("chapter_idx"), "chapter_title", F.col("block_idx").cast("long").alias("block_idx"), "text")


@query(None)
def page_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.markup import page_pieces

    return page_pieces(table(spark, sf_dir, "pages"))
