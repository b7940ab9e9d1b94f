"""Queries over references, hypotheses, seams and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe.functions.align import alignment, char_errors, word_errors
from speechframe.functions.text import FILLERS, SPELLED, wer_text
from speechframe.operators import evaluation
from speechframe.plans.bindings import EVENTS_SQL, event_rows, load, load_texts, sql_tokens
from speechframe.plans.transcripts import _PACKED_SQL, packed_chunks

QUERIES = {}
ORACLES = {}

TOLERANCE_US = 3_600_000_000
END_US = 1_706_832_000_000_000


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def _sql_wer(x: str) -> str:
    """The words-only form in SQL; digits before a comma are handled twice for lack of
    look-behind."""
    text = rf"regexp_replace(lower({x}), '\[[^\]]*\]|\([^)]*\)|<[^>]*>', ' ', 'g')"
    text = f"strip_accents({text})"
    text = f"regexp_replace({text}, '[''‘’ʼ]', '', 'g')"
    for _ in range(2):
        text = rf"regexp_replace({text}, '(\d),(\d)', '\1\2', 'g')"
    text = rf"regexp_replace({text}, '[\p{{P}}\p{{S}}]', ' ', 'g')"
    fillers = ", ".join(f"'{f}'" for f in FILLERS)
    names = ", ".join(f"'{n}'" for n in SPELLED)
    words = ", ".join(f"'{w}'" for w in SPELLED.values())
    return (
        f"coalesce(array_to_string(list_transform(list_filter({sql_tokens(text)}, "
        f"lambda t: t NOT IN ({fillers})), "
        f"lambda t: coalesce(map([{names}], [{words}])[t], t)), ' '), '')"
    )


@query(
    f"""WITH texts AS (SELECT 'benchmark' AS origin, item_id AS id, text FROM benchmark
  UNION ALL SELECT 'documents', doc_id, text FROM documents)
SELECT origin, id, {_sql_wer('text')} AS words FROM texts"""
)
def wer_normalise(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark").select(
        F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text"
    )
    docs = load_texts(spark, sf_dir, "documents", "doc_id").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text"
    )
    return items.unionByName(docs).select("origin", "id", wer_text(F.col("text")).alias("words"))


def _pairs(spark, sf_dir) -> DataFrame:
    """Each benchmark item as reference, the next one as hypothesis."""
    items = load(spark, sf_dir, "benchmark").select("item_id", wer_text(F.col("text")).alias("w"))
    following = items.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("hyp"))
    return items.withColumnRenamed("w", "ref").join(following, "item_id")


_PAIRS_SQL = f"""words AS (SELECT item_id, {_sql_wer('text')} AS w FROM benchmark),
pairs AS (SELECT a.item_id, a.w AS ref, b.w AS hyp
          FROM words a JOIN words b ON b.item_id = a.item_id + 1)"""


def _one_byte(x: str) -> str:
    """DuckDB's distance counts bytes; letters that survive normalisation get one each."""
    return f"translate({x}, 'ßœæøłđðþ', 'ABCDEFGH')"


@query(
    f"""WITH {_PAIRS_SQL} SELECT item_id, length(ref) AS ref_chars,
CASE WHEN ref = '' THEN 0 ELSE levenshtein({_one_byte('ref')}, {_one_byte('hyp')}) END::BIGINT
AS char_errors FROM pairs"""
)
def cer(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "item_id",
        F.length("ref").cast("bigint").alias("ref_chars"),
        char_errors(F.col("ref"), F.col("hyp")).alias("char_errors"),
    )


# One row of the edit-distance table per step; the running minimum along the row is taken over
# the values less their position.
_DISTANCE_SQL = f"""RECURSIVE {_PAIRS_SQL},
lists AS (SELECT item_id, list_filter(string_split(ref, ' '), lambda t: t <> '') AS r,
                 list_filter(string_split(hyp, ' '), lambda t: t <> '') AS h FROM pairs),
dp AS (
  SELECT item_id, 0 AS i, range(len(h) + 1) AS row FROM lists
  UNION ALL
  SELECT item_id, i + 1, list_transform(range(1, len(best) + 1), lambda j:
      list_min(list_transform(range(1, j + 1), lambda q: best[q] - q)) + j)
  FROM (SELECT dp.item_id, dp.i, list_transform(range(1, len(l.h) + 2), lambda j:
          CASE WHEN j = 1 THEN dp.i + 1 ELSE least(dp.row[j] + 1,
            dp.row[j - 1] + CASE WHEN l.h[j - 1] = l.r[dp.i + 1] THEN 0 ELSE 1 END) END) AS best
        FROM dp JOIN lists l ON l.item_id = dp.item_id AND dp.i < len(l.r))),
totals AS (SELECT l.item_id, len(l.r) AS ref_words, len(l.h) AS hyp_words,
             dp.row[len(dp.row)]::BIGINT AS errors
           FROM dp JOIN lists l ON l.item_id = dp.item_id AND dp.i = len(l.r))"""


def _token_pairs(spark, sf_dir) -> DataFrame:
    return _pairs(spark, sf_dir).select(
        "item_id",
        F.filter(F.split("ref", " "), lambda t: t != "").alias("ref"),
        F.filter(F.split("hyp", " "), lambda t: t != "").alias("hyp"),
    )


@query(f"WITH {_DISTANCE_SQL} SELECT item_id, ref_words, hyp_words, errors FROM totals")
def wer_total(spark, sf_dir):
    return _token_pairs(spark, sf_dir).select(
        "item_id",
        F.size("ref").cast("bigint").alias("ref_words"),
        F.size("hyp").cast("bigint").alias("hyp_words"),
        word_errors(F.col("ref"), F.col("hyp")).alias("errors"),
    )


@query(
    f"""WITH {_DISTANCE_SQL} SELECT item_id, errors, ref_words - hyp_words AS net_deletions,
true AS complete FROM totals"""
)
def wer_ops(spark, sf_dir):
    """Totals of the operations. Which of several shortest alignments is taken is free, so the
    check compares what all of them share."""
    ops = _token_pairs(spark, sf_dir).withColumn("_o", alignment("ref", "hyp"))

    def count(*names: str):
        return F.size(F.filter("_o", lambda o: o["op"].isin(*names))).cast("bigint")

    return ops.select(
        "item_id",
        count("substitute", "delete", "insert").alias("errors"),
        (count("delete") - count("insert")).alias("net_deletions"),
        (count("equal", "substitute", "delete") == F.size("ref")).alias("complete"),
    )


@query(
    f"""WITH {EVENTS_SQL}, t AS (SELECT event_id, us, value, {_sql_wer("event_type || ' 42 ' || k")} AS w
  FROM ev)
SELECT event_id, sub, text, us / 1e6::DOUBLE + 2.5 AS start,
       us / 1e6::DOUBLE + value + 2.5 AS "end"
FROM (SELECT event_id, us, value, unnest(string_split(w, ' ')) AS text,
             generate_subscripts(string_split(w, ' '), 1) - 1 AS sub FROM t)"""
)
def timed_tokens(spark, sf_dir):
    start = F.col("us") / 1e6
    segments = event_rows(spark, sf_dir).select(
        "event_id",
        F.lit(0).alias("ord"),
        start.alias("start"),
        (start + F.col("value")).alias("end"),
        F.concat("event_type", F.lit(" 42 "), F.col("k").cast("string")).alias("text"),
        F.lit(None)
        .cast("array<struct<start:double,end:double,text:string,probability:double>>")
        .alias("words"),
    )
    found = evaluation.timed_tokens(segments, ["event_id"], F.lit(2.5))
    return found.select("event_id", F.col("sub").cast("bigint").alias("sub"), "text", "start", "end")


_SEAMS_SQL = f"""{_PACKED_SQL},
nexts AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS next FROM packed),
seams AS (SELECT DISTINCT user_id, unnest(["end", next]) AS t FROM nexts WHERE next IS NOT NULL)"""


def _seams(spark, sf_dir):
    packed, _, hot = packed_chunks(spark, sf_dir)
    return evaluation.boundaries(packed, ["user_id"], ["start"], hot_rows=hot), hot


@query(f"WITH {_SEAMS_SQL} SELECT user_id, t FROM seams")
def seams(spark, sf_dir):
    return _seams(spark, sf_dir)[0]


@query(
    f"""WITH {_SEAMS_SQL}, spans AS (SELECT event_id, user_id, us AS start,
  us + floor(value * 10000000.0::DOUBLE)::BIGINT AS "end" FROM ev WHERE event_type = 'error')
SELECT event_id, EXISTS (SELECT 1 FROM seams s WHERE s.user_id = spans.user_id
  AND s.t - {TOLERANCE_US} <= spans."end" AND spans.start <= s.t + {TOLERANCE_US}) AS near
FROM spans"""
)
def near_seam_errors(spark, sf_dir):
    spans = event_rows(spark, sf_dir).where(F.col("event_type") == "error").select(
        "event_id",
        "user_id",
        F.col("us").alias("start"),
        (F.col("us") + F.floor(F.col("value") * 1e7).cast("bigint")).alias("end"),
    )
    marks, hot = _seams(spark, sf_dir)
    near = evaluation.near_seams(spans, marks, ["user_id"], float(TOLERANCE_US), hot_rows=hot)
    return near.select("event_id", "near")


@query(
    f"""WITH {_SEAMS_SQL}, w AS (SELECT user_id, t, least(t + {TOLERANCE_US}, {END_US}) AS until,
  max(least(t + {TOLERANCE_US}, {END_US})) OVER (PARTITION BY user_id ORDER BY t
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seams)
SELECT user_id, sum(greatest(0, until - greatest(t - {TOLERANCE_US}, coalesce(reach, 0), 0)))::DOUBLE
  AS near_seam_s FROM w GROUP BY user_id"""
)
def seam_coverage(spark, sf_dir):
    marks, hot = _seams(spark, sf_dir)
    timed = marks.withColumn("duration", F.lit(float(END_US)))
    return evaluation.seam_coverage(timed, ["user_id"], float(TOLERANCE_US), hot_rows=hot)


def _scores(spark, sf_dir) -> DataFrame:
    doc, n = F.col("doc_id"), F.col("n_chars")
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    quality = F.when(F.col("quality").isNotNull(), F.concat(F.lit("quality"), F.col("quality")))
    return docs.select(
        doc.cast("string").alias("clip_id"),
        F.col("source").alias("config"),
        F.array_compact(F.array(F.col("lang"), quality)).alias("tags"),
        n.cast("double").alias("audio_s"),
        (doc % 60 + 1).cast("double").alias("seconds"),
        (n % 50).alias("ref_words"),
        (n % 43).alias("hyp_words"),
        (doc % 5).alias("substitutions"),
        (doc % 3).alias("deletions"),
        (doc % 4).alias("insertions"),
        (n % 50 * 6).alias("ref_chars"),
        (doc % 11).alias("char_errors"),
        (doc % 6).alias("seams"),
        (doc % 2).alias("seam_errors"),
        (n % 7).cast("double").alias("near_seam_s"),
    )


_SCORES_SQL = """
scores AS (SELECT doc_id::VARCHAR AS clip_id, source AS config,
  list_filter([lang, CASE WHEN quality IS NOT NULL THEN 'quality' || quality END],
              lambda x: x IS NOT NULL) AS tags,
  n_chars::DOUBLE AS audio_s, (doc_id % 60 + 1)::DOUBLE AS seconds,
  n_chars % 50 AS ref_words, n_chars % 43 AS hyp_words,
  doc_id % 5 AS substitutions, doc_id % 3 AS deletions, doc_id % 4 AS insertions,
  n_chars % 50 * 6 AS ref_chars, doc_id % 11 AS char_errors, doc_id % 6 AS seams,
  doc_id % 2 AS seam_errors, (n_chars % 7)::DOUBLE AS near_seam_s
  FROM documents LEFT JOIN labels USING (doc_id)),
tagged AS (SELECT *, NULL AS tag FROM scores
  UNION ALL SELECT *, unnest(tags) AS tag FROM scores),
parts AS (SELECT *, CASE WHEN ref_words > 0 THEN 1 ELSE 0 END AS sp,
  substitutions + deletions + insertions AS errs FROM tagged),
rates AS (SELECT config, tag, count(*) AS clips,
  sum(errs * sp) / nullif(sum(ref_words * sp), 0) AS wer,
  sum(char_errors * sp) / nullif(sum(ref_chars * sp), 0) AS cer,
  sum(substitutions * sp)::BIGINT AS substitutions, sum(deletions * sp)::BIGINT AS deletions,
  sum(insertions * sp)::BIGINT AS insertions, sum(ref_words * sp)::BIGINT AS ref_words,
  sum(hyp_words) FILTER (WHERE sp = 0)::BIGINT AS hallucinated_words,
  sum(seams * sp)::BIGINT AS seams, sum(seam_errors * sp)::BIGINT AS seam_errors,
  sum(seam_errors * sp) / nullif(sum(errs * sp), 0) AS seam_error_share,
  sum(near_seam_s * sp) / nullif(sum(audio_s * sp), 0) AS near_seam_audio_share,
  sum(audio_s) / nullif(sum(seconds), 0) AS x_realtime
  FROM parts GROUP BY config, tag)"""


@query(f"WITH {_SCORES_SQL} SELECT * FROM rates")
def corpus_rollup(spark, sf_dir):
    return evaluation.rollup_with_tags(_scores(spark, sf_dir))


def _sql_pct(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'n/a' ELSE printf('%.1f%%', 100 * {x}) END"


@query(
    f"""WITH {_SCORES_SQL}, cells AS (SELECT *, concat_ws('; ',
  CASE WHEN wer IS NOT NULL THEN {_sql_pct('wer')} END,
  CASE WHEN hallucinated_words IS NOT NULL THEN hallucinated_words || ' words on no-speech' END)
  AS cell FROM rates)
SELECT config, tag, CASE WHEN tag IS NULL THEN printf('| %s | %s | %s | %d / %d / %d | %s | %d | %d | %s | %s | %s |',
  config, {_sql_pct('wer')}, {_sql_pct('cer')}, substitutions, deletions, insertions,
  coalesce(hallucinated_words::VARCHAR, 'n/a'), seams, seam_errors, {_sql_pct('seam_error_share')},
  {_sql_pct('near_seam_audio_share')},
  CASE WHEN x_realtime IS NULL THEN 'n/a' ELSE printf('%.1f', x_realtime) END)
  ELSE printf('| %s | %d | %s | %s |', tag, clips, config, cell) END AS line FROM cells"""
)
def report_lines(spark, sf_dir):
    return evaluation.report_lines(evaluation.rollup_with_tags(_scores(spark, sf_dir))).drop("clips")


# The table of edit distances is kept by row, and the way back follows the documented preference.
_GRID_SQL = f"""RECURSIVE clips AS (SELECT item_id AS clip_id, text, {_sql_wer('text')} AS ref,
  length(text) / 16.0::DOUBLE AS audio_s FROM benchmark),
turns AS (SELECT item_id - 1 AS clip_id, unnest(string_split(text, '. ')) AS text,
  generate_subscripts(string_split(text, '. '), 1) - 1 AS ord FROM benchmark),
said AS (SELECT t.clip_id, t.ord, {_sql_wer('t.text')} AS w FROM turns t JOIN clips USING (clip_id)),
tok AS (SELECT clip_id, 'shifted' AS config, ord, unnest(string_split(w, ' ')) AS text,
    generate_subscripts(string_split(w, ' '), 1) AS sub, ord * 4.0::DOUBLE AS s, ord * 4.0::DOUBLE + 3.5 AS e
    FROM said WHERE w <> ''
  UNION ALL SELECT clip_id, 'whole', 0, unnest(string_split(ref, ' ')),
    generate_subscripts(string_split(ref, ' '), 1), 0.0::DOUBLE, audio_s FROM clips WHERE ref <> ''),
heard AS (SELECT clip_id, config, list(text ORDER BY ord, sub) AS h, list(s ORDER BY ord, sub) AS hs,
  list(e ORDER BY ord, sub) AS he FROM tok GROUP BY clip_id, config),
lists AS (SELECT c.clip_id, g.config, audio_s, ref, list_filter(string_split(ref, ' '), lambda t: t <> '') AS r,
    coalesce(h, []) AS h, coalesce(hs, []) AS hs, coalesce(he, []) AS he
  FROM clips c CROSS JOIN (SELECT unnest(['shifted', 'whole']) AS config) g
  LEFT JOIN heard USING (clip_id, config)),
marks AS (SELECT t.clip_id, 'shifted' AS config, t.ord * 4.0::DOUBLE AS t FROM turns t
    JOIN clips USING (clip_id) WHERE t.ord > 0
  UNION ALL SELECT clip_id, 'whole', i * 30.0::DOUBLE FROM (SELECT clip_id, audio_s,
    unnest(range(1, greatest(1, floor(audio_s / 30)::BIGINT) + 1)) AS i FROM clips) WHERE i * 30.0 < audio_s),
dp AS (SELECT clip_id, config, 0 AS i, range(len(h) + 1) AS row FROM lists WHERE ref <> ''
  UNION ALL SELECT clip_id, config, i + 1, list_transform(range(1, len(best) + 1), lambda j:
      list_min(list_transform(range(1, j + 1), lambda q: best[q] - q)) + j)
  FROM (SELECT dp.clip_id, dp.config, dp.i, list_transform(range(1, len(l.h) + 2), lambda j:
          CASE WHEN j = 1 THEN dp.i + 1 ELSE least(dp.row[j] + 1,
            dp.row[j - 1] + CASE WHEN l.h[j - 1] = l.r[dp.i + 1] THEN 0 ELSE 1 END) END) AS best
        FROM dp JOIN lists l ON l.clip_id = dp.clip_id AND l.config = dp.config AND dp.i < len(l.r))),
ways AS (SELECT clip_id, config, NULL::VARCHAR AS op, NULL::BIGINT AS spot, len(r) AS i, len(h) AS j
    FROM lists WHERE ref <> ''
  UNION ALL SELECT clip_id, config, op, j,
    CASE WHEN op = 'insert' THEN i ELSE i - 1 END, CASE WHEN op = 'delete' THEN j ELSE j - 1 END
  FROM (SELECT b.clip_id, b.config, b.i, b.j,
      CASE WHEN b.i > 0 AND b.j > 0 AND l.r[b.i] = l.h[b.j] AND d.row[b.j + 1] = p.row[b.j] THEN 'equal'
           WHEN b.i > 0 AND b.j > 0 AND d.row[b.j + 1] = p.row[b.j] + 1 THEN 'substitute'
           WHEN b.i > 0 AND d.row[b.j + 1] = p.row[b.j + 1] + 1 THEN 'delete' ELSE 'insert' END AS op
    FROM ways b JOIN lists l ON l.clip_id = b.clip_id AND l.config = b.config AND b.i + b.j > 0
    JOIN dp d ON d.clip_id = b.clip_id AND d.config = b.config AND d.i = b.i
    LEFT JOIN dp p ON p.clip_id = b.clip_id AND p.config = b.config AND p.i = b.i - 1)),
spans AS (SELECT w.clip_id, w.config, op,
    CASE WHEN op = 'delete' THEN CASE WHEN spot > 0 THEN l.he[spot] ELSE 0.0 END ELSE l.hs[spot] END AS s,
    CASE WHEN op = 'delete' THEN coalesce(l.hs[spot + 1], l.audio_s) ELSE l.he[spot] END AS e
  FROM ways w JOIN lists l ON l.clip_id = w.clip_id AND l.config = w.config
  WHERE op IS NOT NULL AND op <> 'equal'),
counted AS (SELECT clip_id, config, count(*) FILTER (WHERE op = 'substitute') AS substitutions,
    count(*) FILTER (WHERE op = 'delete') AS deletions, count(*) FILTER (WHERE op = 'insert') AS insertions,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM marks m WHERE m.clip_id = spans.clip_id
      AND m.config = spans.config AND m.t - 1.0 <= spans.e AND spans.s <= m.t + 1.0)) AS seam_errors
  FROM spans GROUP BY clip_id, config),
reach AS (SELECT m.*, least(t + 1.0, audio_s) AS until, max(least(t + 1.0, audio_s)) OVER (
    PARTITION BY m.clip_id, m.config ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM marks m JOIN clips USING (clip_id)),
covered AS (SELECT clip_id, config, count(*) AS seams,
    sum(greatest(0.0, until - greatest(t - 1.0, coalesce(reach, 0.0), 0.0)))::DOUBLE AS near_seam_s
  FROM reach GROUP BY clip_id, config)"""


@query(
    f"""WITH {_GRID_SQL} SELECT l.clip_id, l.config, audio_s, 0.0::DOUBLE AS seconds,
  len(r)::BIGINT AS ref_words, len(h)::BIGINT AS hyp_words, coalesce(substitutions, 0) AS substitutions,
  coalesce(deletions, 0) AS deletions,
  CASE WHEN ref = '' THEN len(h) ELSE coalesce(insertions, 0) END::BIGINT AS insertions,
  length(ref)::BIGINT AS ref_chars, CASE WHEN ref = '' THEN 0 ELSE
    levenshtein({_one_byte('ref')}, {_one_byte("array_to_string(h, ' ')")}) END::BIGINT AS char_errors,
  coalesce(seams, 0) AS seams, coalesce(seam_errors, 0) AS seam_errors,
  coalesce(near_seam_s, 0.0)::DOUBLE AS near_seam_s, array_to_string(h, ' ') AS hypothesis
FROM lists l LEFT JOIN counted USING (clip_id, config) LEFT JOIN covered USING (clip_id, config)"""
)
def score_grid(spark, sf_dir):
    """Full scoring of benchmark items against two front ends (the reference shifted by one
    item, and cut in windows), through tokens, seams and alignment."""
    items = load(spark, sf_dir, "benchmark")
    clips = items.select(
        F.col("item_id").alias("clip_id"),
        F.col("text").alias("reference"),
        (F.length("text") / F.lit(16.0)).alias("audio_s"),
    )
    turns = items.select(
        (F.col("item_id") - 1).alias("clip_id"), F.posexplode(F.split("text", r"\. ")).alias("ord", "text")
    )

    def shifted(clips: DataFrame):
        spans = turns.join(clips.select("clip_id"), "clip_id", "left_semi").select(
            "clip_id", "ord", (F.col("ord") * 4.0).alias("start"), (F.col("ord") * 4.0 + 3.5).alias("end"),
            "text",
            F.lit(None).cast("array<struct<start:double,end:double,text:string,probability:double>>")
            .alias("words"),
        )
        marks = spans.where(F.col("ord") > 0).select("clip_id", F.col("start").alias("t"))
        return evaluation.timed_tokens(spans, ["clip_id"]), marks

    def whole(clips: DataFrame):
        spans = clips.select(
            "clip_id", F.lit(0).alias("ord"), F.lit(0.0).alias("start"), F.col("audio_s").alias("end"),
            F.col("reference").alias("text"),
            F.lit(None).cast("array<struct<start:double,end:double,text:string,probability:double>>")
            .alias("words"),
        )
        marks = clips.select(
            "clip_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("audio_s") / 30))))
            .alias("i"), "audio_s",
        ).where(F.col("i") * 30.0 < F.col("audio_s")).select("clip_id", (F.col("i") * 30.0).alias("t"))
        return evaluation.timed_tokens(spans, ["clip_id"]), marks

    tokens, marks, runs = evaluation.run_grid(clips, {"shifted": shifted, "whole": whole})
    return evaluation.score(clips, tokens, marks, runs)
