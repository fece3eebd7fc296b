"""Queries over documents and conversations: text repair, estimates, keys, voices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.translit import spelled_acronym
from ..operators import chapters as C
from ..operators import review as R
from ..operators import synthesis as S
from ..sources import intake as I

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


# Pieces of DuckDB SQL that several oracles share.
WS = "[\\s\\x{00a0}\\x{0085}\\x1c-\\x1f\\x0b\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
SQUEEZE = "regexp_replace(regexp_replace({0}, '[ \\t\\x{{00a0}}\\x{{2007}}\\x{{202f}}\\r\\n]+', ' ', 'g'), '^" + WS.replace("{", "{{").replace("}", "}}") + "+|" + WS.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')"
QUOTES = "array_to_string(list_transform(string_split_regex(regexp_replace({0}, '[’‛ʼ`]', '''', 'g'), '[\"“„‟«”‘»]'), lambda p, i: CASE WHEN i = 1 THEN '' WHEN i % 2 = 0 THEN '«' ELSE '»' END || p), '')"
HYPHENS = "regexp_replace(regexp_replace({0}, '([\\p{{L}}\\p{{N}}_])-\\s+([a-zа-яё])', '\\1\\2', 'g'), '([\\p{{L}}\\p{{N}}_])-\\s+([A-ZА-ЯЁ])', '\\1-\\2', 'g')"
BIG_O = "regexp_replace({0}, '0\\(\\s*([A-Za-z0-9])', 'O(\\1', 'g')"


def cleaned_sql(c: str) -> str:
    return SQUEEZE.format(QUOTES.format(HYPHENS.format(BIG_O.format(c))))


@query("""SELECT lang, sum(n)::BIGINT AS chars, round_even(sum(n) / 15 / 60, 1) AS speech_minutes, round_even(sum(n) / 15 / 60 / 32.0, 1) AS synth_minutes,
  floor(sum(n) / 15 * 48000 * 2.5)::BIGINT AS disk_bytes FROM (SELECT lang, CASE WHEN coalesce(quality, 1) = 1 THEN n_chars ELSE 0 END::DOUBLE AS n FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang""")
def review_estimates_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return R.estimates(docs.withColumn("include", F.col("quality") == 1), ["lang"], 32.0)


@query("""SELECT conv_id AS book_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, left(text, 60) AS title, length(text)::BIGINT AS chars,
  round_even(length(text) / 15 / 60, 1) AS minutes FROM conversations""")
def chapter_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chapter_idx"), F.col("text").alias("chapter_title"), "text")
    return C.char_counts(turns).withColumn("number", F.col("number").cast("long"))


@query("SELECT source, count(*) AS n_docs, sum(length(text))::BIGINT AS chars FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND trim(text) <> '' GROUP BY source")
def book_char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return docs.where(F.trim("text") != "").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT doc_id, {SQUEEZE.format(QUOTES.format('text'))} AS text FROM documents")
def squeeze_and_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.squeeze_spaces(T.normalize_quotes(F.col("text"))).alias("text"))


@query(f"SELECT doc_id, {cleaned_sql('text')} AS text FROM documents")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


_BROKEN = "replace(replace(text, 'tion', 'ti-\n on'), ' ', '  ')"


@query(f"SELECT doc_id, {HYPHENS.format(_BROKEN)} AS text FROM documents")
def hyphen_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.replace(F.replace("text", F.lit("tion"), F.lit("ti-\n on")), F.lit(" "), F.lit("  "))
    return table(spark, sf_dir, "documents").select("doc_id", T.join_hyphenated(broken).alias("text"))


@query(f"SELECT doc_id, {BIG_O.format("replace(text, ' of ', ' 0( n) ')")} AS text FROM documents")
def big_o_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.restore_big_o(F.replace("text", F.lit(" of "), F.lit(" 0( n) "))).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '\\b(?:https?://|www\\.)\\S+|[\\p{L}\\p{N}_][\\p{L}\\p{N}_.+-]*@[\\p{L}\\p{N}_-]+\\.[\\p{L}\\p{N}_.]*[\\p{L}\\p{N}_]', 'link', 'g') AS text FROM documents")
def strip_contact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_urls(F.col("text")).alias("text"))


def _expanded_sql(c: str) -> str:
    for short, full in T.ABBREVIATIONS["en"].items():
        c = f"regexp_replace({c}, '(^|[^\\p{{L}}\\p{{N}}_]){short.replace('.', '[.]')}', '\\1{full}', 'g')"
    return c


@query(f"SELECT doc_id, {_expanded_sql("replace(text, ' the ', ' e.g. vs. etc. Fig. 7 ')")} AS text FROM documents")
def abbreviations_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.expand_abbreviations(F.replace("text", F.lit(" the "), F.lit(" e.g. vs. etc. Fig. 7 "))).alias("text"))


@query("""SELECT doc_id, share, share > 0.25 AS warned, CASE WHEN share > 0.25 THEN 'en' END AS found FROM (SELECT doc_id,
  CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) END AS share FROM documents)""")
def foreign_letter_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.foreign_share(text, "ru").alias("share"), T.language_warning(text, "ru").isNotNull().alias("warned"), T.language_warning(text, "ru")["found"].alias("found"))


@query("""SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(l, '[\\p{L}\\p{N}]')) AS speakable,
  count(*) FILTER (NOT regexp_matches(l, '[.!?…:;»"”’]\\s*$')) AS open_lines, count(*) FILTER (regexp_matches(trim(l), '^[0-9]{1,4}$')) AS bare_numbers
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id""")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(T.is_speakable(line)).alias("speakable"), F.count_if(T.is_open(line)).alias("open_lines"), F.count_if(T.is_bare_number(line)).alias("bare_numbers"))


@query("""SELECT doc_id, length(l) >= 40 AND noise / length(l) > 0.30::DOUBLE AS non_prose, round(noise / greatest(length(l), 1), 6) AS share, place FROM (SELECT doc_id, l, place,
  length(regexp_replace(l, '[\\p{L}\\s]', '', 'g'))::DOUBLE AS noise FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents))""")
def non_prose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "l"))
    share = T.non_alpha_share(F.col("l"))
    return lines.select("doc_id", ((F.length("l") >= 40) & (share > 0.30)).alias("non_prose"), F.round(share, 6).alias("share"), F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, sha256(text || chr(0) || 'kseniya' || chr(0) || 'silero' || chr(0) || 'v5_5_ru') AS key FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_keys(table(spark, sf_dir, "documents"), "kseniya", "silero", "v5_5_ru").select("doc_id", "key")


_CHUNK_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents"
_STORED = "SELECT DISTINCT unnest(string_split(text, chr(10))) AS text FROM benchmark"


def _lines(docs: DataFrame) -> DataFrame:
    return S.with_keys(docs.select(F.explode(F.split("text", "\n", -1)).alias("text")), "af_nova", "fake", "1")


@query(f"SELECT DISTINCT sha256(text || chr(0) || 'af_nova' || chr(0) || 'fake' || chr(0) || '1') AS key, text FROM ({_CHUNK_LINES}) WHERE text NOT IN ({_STORED})")
def synth_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.misses(_lines(table(spark, sf_dir, "documents")), _lines(table(spark, sf_dir, "benchmark"))).select("key", "text")


@query(f"""SELECT count(*) AS chunks, count(DISTINCT text) AS distinct_chunks, count(DISTINCT text) FILTER (text NOT IN ({_STORED})) AS misses,
  count(*) - count(DISTINCT text) FILTER (text NOT IN ({_STORED})) AS hits FROM ({_CHUNK_LINES})""")
def cache_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cache_report(_lines(table(spark, sf_dir, "documents")), _lines(table(spark, sf_dir, "benchmark")))


@query(f"SELECT DISTINCT sha256(text || chr(0) || 'af_nova' || chr(0) || 'fake' || chr(0) || '1') AS key, text, floor(24000 * length(text) / 15) / 24000 AS seconds, 'done' AS status FROM ({_CHUNK_LINES}) WHERE text NOT IN ({_STORED})")
def synthesized_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.synthesize(S.misses(_lines(table(spark, sf_dir, "documents")), _lines(table(spark, sf_dir, "benchmark"))))


@query("""SELECT word, array_to_string(list_transform(regexp_extract_all(lower(word), '[a-z]'), lambda c: CASE c WHEN 'a' THEN 'эй' WHEN 'b' THEN 'би' WHEN 'c' THEN 'си' WHEN 'd' THEN 'ди' WHEN 'e' THEN 'и'
  WHEN 'f' THEN 'эф' WHEN 'g' THEN 'джи' WHEN 'h' THEN 'эйч' WHEN 'i' THEN 'ай' WHEN 'j' THEN 'джей' WHEN 'k' THEN 'кей' WHEN 'l' THEN 'эл' WHEN 'm' THEN 'эм' WHEN 'n' THEN 'эн' WHEN 'o' THEN 'оу'
  WHEN 'p' THEN 'пи' WHEN 'q' THEN 'кью' WHEN 'r' THEN 'ар' WHEN 's' THEN 'эс' WHEN 't' THEN 'ти' WHEN 'u' THEN 'ю' WHEN 'v' THEN 'ви' WHEN 'w' THEN 'дабл-ю' WHEN 'x' THEN 'экс' WHEN 'y' THEN 'уай' ELSE 'зед' END), '-') AS spoken
  FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) WHERE regexp_full_match(word, '[A-Z]{2,6}')""")
def acronym_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))).alias("word")).where(F.regexp_like("word", F.lit("^[A-Z]{2,6}$"))).distinct()
    return words.select("word", spelled_acronym(F.col("word")).alias("spoken"))


@query("""SELECT doc_id, CASE WHEN lang IN ('ru', 'en') THEN lang ELSE 'ru' END AS language, CASE WHEN doc_id % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
  CASE WHEN lang = 'en' THEN CASE WHEN doc_id % 2 = 0 THEN 'af_nova' ELSE 'am_michael' END ELSE CASE WHEN doc_id % 2 = 0 THEN 'kseniya' ELSE 'eugene' END END AS voice FROM documents""")
def default_voice_for_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.select("doc_id", T.resolved_language(F.lit(None).cast("string"), F.col("lang")).alias("language"), F.when(F.col("doc_id") % 2 == 0, "female").otherwise("male").alias("gender"))
    return S.with_default_voice(asked).select("doc_id", "language", "gender", "voice")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'xenia' WHEN doc_id % 4 = 3 THEN 'aidar' WHEN doc_id % 4 = 1 THEN 'eugene' ELSE 'kseniya' END AS chosen FROM documents""")
def voices_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = spark.createDataFrame([("silero", i, v, g) for i, (v, g) in enumerate(S.GENDERS.items())], "engine string, voice_idx int, id string, gender string")
    k = F.col("doc_id") % 4
    jobs = table(spark, sf_dir, "documents").select("doc_id", F.lit("silero").alias("engine"), F.lit("ru").alias("language"), F.when(k == 3, "other").when(k == 1, "male").otherwise("female").alias("gender"), F.when(k == 0, "xenia").when(k == 2, "nobody").alias("voice"))
    return S.pick_voice(jobs, voices).select("doc_id", "chosen")


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'ru' END AS language, CASE WHEN lang = 'en' THEN 'kokoro' ELSE 'silero' END AS engine, CASE WHEN lang = 'en' THEN 800 ELSE 900 END::INTEGER AS max_chars,
  CASE WHEN lang = 'en' THEN 5.8 ELSE 32.0 END::DOUBLE AS realtime FROM documents""")
def engines_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select("doc_id", T.resolved_language(F.lit(None).cast("string"), F.col("lang")).alias("language"))
    return S.engine_of(asked).select("doc_id", "language", "engine", "max_chars", "realtime")


_REQUESTS = """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'notes' ELSE repeat('b', (doc_id % 70)::BIGINT + 1) || CASE doc_id % 4 WHEN 0 THEN '.EPUB' WHEN 1 THEN '.pdf' WHEN 2 THEN '.fb2' ELSE '.txt' END END AS name, lang AS language,
  CASE WHEN doc_id % 13 = 0 THEN 'robot' WHEN doc_id % 2 = 0 THEN 'male' ELSE 'female' END AS gender, CASE WHEN doc_id % 5 = 0 THEN '3-1' WHEN doc_id % 3 = 0 THEN ' 2 - 7 ' ELSE ' ' END AS pages FROM documents"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    suffix = F.when(d % 4 == 0, ".EPUB").when(d % 4 == 1, ".pdf").when(d % 4 == 2, ".fb2").otherwise(".txt")
    name = F.when(d % 11 == 0, "notes").otherwise(F.concat(F.repeat(F.lit("b"), (d % 70 + 1).cast("int")), suffix))
    gender = F.when(d % 13 == 0, "robot").when(d % 2 == 0, "male").otherwise("female")
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.col("lang").alias("language"), gender.alias("gender"), F.when(d % 5 == 0, "3-1").when(d % 3 == 0, " 2 - 7 ").otherwise(" ").alias("pages"))


@query(f"""SELECT doc_id, CASE WHEN suffix NOT IN ('.epub', '.fb2', '.pdf') THEN 'format ' || suffix || ' is not supported, known are: .epub, .fb2, .pdf' WHEN language NOT IN ('ru', 'en') THEN 'language ' || language || ' is not supported'
  WHEN gender = 'robot' THEN 'gender robot is not supported' WHEN trim(pages) <> '' AND suffix <> '.pdf' THEN suffix || ' has no pages, pick chapters after parsing' WHEN trim(pages) = '3-1' THEN 'bad page range: 3-1' END AS problem
  FROM (SELECT *, lower(CASE WHEN contains(name, '.') THEN '.' || split_part(name, '.', 2) ELSE '' END) AS suffix FROM ({_REQUESTS}))""")
def requests_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.validated(_requests(spark, sf_dir)).select("doc_id", "problem")


@query(f"""SELECT doc_id, stem || CASE WHEN k > 1 THEN '-' || (k - 1) ELSE '' END || suffix AS stored_name FROM (SELECT *, row_number() OVER (PARTITION BY stem, suffix ORDER BY doc_id) AS k
  FROM (SELECT doc_id, left(split_part(name, '.', 1), 60) AS stem, lower(CASE WHEN contains(name, '.') THEN '.' || split_part(name, '.', 2) ELSE '' END) AS suffix FROM ({_REQUESTS})))""")
def names_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.stored_names(_requests(spark, sf_dir), "doc_id").select("doc_id", "stored_name")


@query("""SELECT CASE WHEN lang = 'en' THEN 'en' ELSE 'ru' END || '_' || lpad(k::VARCHAR, 2, '0') AS label, lang AS language, engine, id, text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY engine, voice_idx) AS k FROM
  (VALUES ('ru', 'silero', 0, 'aidar'), ('ru', 'silero', 1, 'baya'), ('en', 'kokoro', 1, 'am_michael'), ('en', 'kokoro', 0, 'af_nova')) v(lang, engine, voice_idx, id)) JOIN
  (SELECT lang, min(text) AS text FROM documents WHERE lang IN ('ru', 'en') GROUP BY lang) USING (lang)""")
def voices_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = spark.createDataFrame([("ru", "silero", 0, "aidar"), ("ru", "silero", 1, "baya"), ("en", "kokoro", 1, "am_michael"), ("en", "kokoro", 0, "af_nova")], "language string, engine string, voice_idx int, id string")
    texts = table(spark, sf_dir, "documents").where("lang in ('ru', 'en')").groupBy(F.col("lang").alias("language")).agg(F.min("text").alias("text"))
    return S.trial_plan(voices, texts)


@query("""SELECT doc_id, array_to_string(list_sort(list_filter(['ffmpeg', 'ffprobe', 'espeak-ng'], lambda x: NOT (x = 'ffmpeg' AND doc_id % 2 = 0) AND NOT (x = 'espeak-ng' AND doc_id % 3 = 0))), ',') AS missing,
  CASE WHEN doc_id % 3 = 0 THEN '/books/' || doc_id WHEN doc_id % 3 = 1 THEN '/shared' END AS destination FROM documents""")
def tools_and_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    present = F.filter(F.array(F.when(d % 2 == 0, "ffmpeg"), F.when(d % 3 == 0, "espeak-ng")), lambda x: x.isNotNull())
    missing = S.missing_items(F.array(F.lit("ffmpeg"), F.lit("ffprobe"), F.lit("espeak-ng")), present)
    explicit = F.when(d % 3 == 0, F.concat(F.lit("/books/"), d.cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(missing, ",").alias("missing"), S.destination(explicit, F.when(d % 3 == 1, " /shared ").otherwise("  ")).alias("destination"))


@query("SELECT count(*) AS failed, array_to_string(list_sort(list(left(text, 200))), chr(10)) AS chunks FROM documents WHERE doc_id % 7 = 0 HAVING count(*) > 0")
def failures_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "documents").select("text", F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("done").alias("status"))
    return S.failure_report(done).select("failed", F.array_join("chunks", "\n").alias("chunks"))


_TITLE = "left(replace(text, ' ', '  '), (doc_id % 300)::BIGINT)"
_NAME = f"trim(regexp_replace(regexp_replace({_TITLE}, '[<>:\"/\\\\|?*\\x00-\\x1f]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""SELECT doc_id, CASE WHEN name = '' THEN 'chapter' ELSE name END AS name FROM (SELECT doc_id, CASE WHEN length(n) <= 90 THEN n ELSE regexp_replace(
  CASE WHEN contains(left(n, 90), ' ') AND 90 - strpos(reverse(left(n, 90)), ' ') > 45 THEN left(n, 90 - strpos(reverse(left(n, 90)), ' ')) ELSE left(n, 90) END, '[ ,.;:-]+$', '') END AS name
  FROM (SELECT doc_id, {_NAME} AS n FROM documents))""")
def safe_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substring(F.replace("text", F.lit(" "), F.lit("  ")), F.lit(1), (F.col("doc_id") % 300).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.safe_filename(title).alias("name"))


@query("SELECT doc_id, regexp_replace(replace(text, 'the', '=;#\\'), '([=;#\\\\\\n])', '\\\\\\1', 'g') AS text FROM documents")
def escaped_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_metadata(F.replace("text", F.lit("the"), F.lit("=;#\\"))).alias("text"))


@query("""SELECT doc_id, CASE WHEN a >= 1 AND a <= b THEN a END AS first, CASE WHEN a >= 1 AND a <= b THEN b END AS last, CASE WHEN a >= 1 AND a <= b THEN b - a + 1 END AS n_chapters
  FROM (SELECT doc_id, doc_id % 30 AS a, CASE WHEN doc_id % 3 = 0 THEN doc_id % 30 ELSE doc_id % 50 END AS b FROM documents)""")
def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = (F.col("doc_id") % 30).cast("string")
    spec = F.when(F.col("doc_id") % 3 == 0, first).otherwise(F.concat(first, F.lit(" - "), (F.col("doc_id") % 50).cast("string")))
    found = table(spark, sf_dir, "documents").select("doc_id", T.page_range(spec).alias("r"), F.size(T.chapter_indexes(spec)).alias("n"))
    return found.select("doc_id", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"), F.when(F.col("r").isNotNull(), F.col("n").cast("long")).alias("n_chapters"))


@query("""SELECT doc_id, floor(24000 * length(text) / 15) / 24000 AS speech_s, round_even(length(text) / 15 * 24000, 0) / 24000 AS gap_s, floor(length(text) / 15 * 48000 * 2.5::DOUBLE)::BIGINT AS disk_bytes,
  (floor(24000 * length(text) / 15) / 24000) / 1.25::DOUBLE AS faster_s FROM documents""")
def speech_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.speech_seconds(n).alias("speech_s"), T.gap_seconds(n).alias("gap_s"), T.wav_bytes(n).alias("disk_bytes"), T.changed_speed(T.speech_seconds(n), 1.25).alias("faster_s"))


@query("SELECT doc_id, doc_id % 3999 + 1 AS value FROM documents")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals made by rule from numbers, read back."""
    n = F.col("doc_id") % 3999 + 1
    ones = lambda one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    digit = lambda table, d: F.element_at(F.array(*map(F.lit, table)), (d % 10 + 1).cast("int"))
    parts = [F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(ones("C", "D", "M"), F.floor(n / 100)), digit(ones("X", "L", "C"), F.floor(n / 10)), digit(ones("I", "V", "X"), n)]
    return table(spark, sf_dir, "documents").select("doc_id", T.roman_value(F.concat(*parts)).cast("long").alias("value"))


@query("SELECT event_id, trunc(greatest(-1.0, least(1.0, value / 50 - 1)) * 32767)::BIGINT AS sample FROM events")
def pcm_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.pcm16(F.array(F.col("value") / 50 - 1))[0].cast("long").alias("sample"))


@query("""SELECT doc_id, l AS text FROM (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
  unnest(range(len(string_split(text, chr(10))))) AS place FROM documents) WHERE length(l) >= 200) WHERE k = 1""")
def sample_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get(F.filter(F.split("text", "\n", -1), lambda x: F.length(x) >= 200), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", first.alias("text")).where("text is not null")


@query(None)
def speech_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.speech import normalize_for_speech

    return table(spark, sf_dir, "documents").select("doc_id", normalize_for_speech(F.col("text"), "en").alias("text"))


@query(None)
def latin_in_cyrillic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.translit import latin_to_cyrillic

    return table(spark, sf_dir, "documents").select("doc_id", latin_to_cyrillic(F.col("text")).alias("text"))
