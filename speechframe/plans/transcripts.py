"""Queries over segments, words, captions, regions, chunk plans and audio frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.functions.language import CANONICAL, normalise_language
from speechframe.functions.text import BOILERPLATE
from speechframe.functions.timing import cue_start_ms
from speechframe.operators import (
    assemble,
    audio,
    captions,
    chunks,
    engine,
    guards,
    regions,
    words,
)
from speechframe.operators.ordered import Hot, measure
from speechframe.plans.bindings import (
    EVENTS_SQL,
    INTERVALS_SQL,
    LINES_SQL,
    TURNS_SQL,
    event_intervals,
    event_rows,
    line_segments,
    load,
    sql_squeeze,
    sql_strip,
    sql_tokens,
    turn_segments,
)

MAX_CHUNK_US = 2 * 86_400_000_000
MAX_GAP_US = 3 * 3_600_000_000

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


# --- guards ---------------------------------------------------------------------------------

_KEY = sql_squeeze(r"regexp_replace(lower(text), '[\p{P}\p{S}]', '', 'g')")


def _guard_sql(scored: bool) -> str:
    pre = (
        """CASE WHEN text = '' THEN 'empty'
         WHEN no_speech_prob > 0.6 AND avg_logprob < -1.0 THEN 'silence_hallucination'
         WHEN compression_ratio > 2.4 THEN 'repetition' END"""
        if scored
        else "CASE WHEN text = '' THEN 'empty' END"
    )
    suspect = "(avg_logprob < -0.7 OR no_speech_prob > 0.3)" if scored else "false"
    return f"""{LINES_SQL},
keyed AS (SELECT *, {_KEY} AS key, {pre} AS pre FROM segments),
known AS (SELECT *, {suspect} AND (key = '' OR regexp_full_match(key, '(?:{BOILERPLATE})')) AS known
          FROM keyed),
cand AS (SELECT *, pre IS NULL AND NOT known AS cand,
           CASE WHEN pre IS NULL AND NOT known THEN key END AS ckey FROM known),
prev AS (SELECT *, last_value(ckey IGNORE NULLS) OVER (PARTITION BY doc_id, chunk ORDER BY ord
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM cand),
runs AS (SELECT *, sum(CASE WHEN cand AND key IS DISTINCT FROM prev THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id, chunk ORDER BY ord) AS run FROM prev),
same AS (SELECT *, count(ckey) OVER (PARTITION BY doc_id, chunk, run ORDER BY ord
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same FROM runs),
reasons AS (SELECT doc_id, chunk, ord, text, start,
  CASE WHEN pre IS NOT NULL THEN pre
       WHEN key IS NOT DISTINCT FROM prev AND same >= 2 THEN 'repetition'
       WHEN known THEN 'known_hallucination' END AS reason,
  avg_logprob < -0.7 AS low_confidence FROM same)"""


def _reasons(spark, sf_dir) -> DataFrame:
    return guards.guard_reasons(line_segments(spark, sf_dir), ["doc_id", "chunk"])


@query(
    f"WITH {_guard_sql(True)} SELECT doc_id, ord, coalesce(reason, 'kept') AS reason FROM reasons"
)
def guard_reasons(spark, sf_dir):
    return _reasons(spark, sf_dir).select(
        "doc_id", "ord", F.coalesce("reason", F.lit("kept")).alias("reason")
    )


@query(
    f"""WITH {_guard_sql(False)}
SELECT doc_id, count(*) FILTER (WHERE reason IS NULL) AS kept,
       count(*) FILTER (WHERE reason = 'repetition') AS repeated FROM reasons GROUP BY doc_id"""
)
def repetition_guard(spark, sf_dir):
    score = F.lit(None).cast("double")
    bare = line_segments(spark, sf_dir).withColumns(
        {
            "avg_logprob": score,
            "no_speech_prob": score,
            "compression_ratio": score,
            "low_confidence": F.lit(False),
        }
    )
    return (
        guards.guard_reasons(bare, ["doc_id", "chunk"])
        .groupBy("doc_id")
        .agg(
            F.count_if(F.col("reason").isNull()).alias("kept"),
            F.count_if(F.col("reason") == "repetition").alias("repeated"),
        )
    )


@query(
    f"""WITH {_guard_sql(True)} SELECT doc_id, reason, count(*) AS dropped FROM reasons
WHERE reason IS NOT NULL GROUP BY doc_id, reason"""
)
def dropped_by_reason(spark, sf_dir):
    return guards.dropped_by_reason(_reasons(spark, sf_dir), ["doc_id"])


@query(
    f"""WITH {_guard_sql(True)} SELECT doc_id,
count(*) FILTER (WHERE reason IS NULL AND low_confidence) AS low_confidence_segments
FROM reasons GROUP BY doc_id"""
)
def low_confidence(spark, sf_dir):
    kept = F.col("reason").isNull() & F.col("low_confidence")
    return (
        _reasons(spark, sf_dir)
        .groupBy("doc_id")
        .agg(F.count_if(kept).alias("low_confidence_segments"))
    )


@query(
    f"""WITH {_guard_sql(True)} SELECT doc_id,
coalesce(string_agg(text, ' ' ORDER BY start, chunk, ord) FILTER (WHERE reason IS NULL), '') AS text,
count(*) FILTER (WHERE reason IS NULL) AS kept,
count(*) FILTER (WHERE reason IS NOT NULL) AS dropped FROM reasons GROUP BY doc_id"""
)
def guarded_transcript(spark, sf_dir):
    """Raw segments to guarded transcripts: the flagship query."""
    reasons = _reasons(spark, sf_dir).withColumn("channel", F.lit(None).cast("int"))
    kept = F.col("reason").isNull()
    return assemble.assemble_text(
        reasons,
        ["doc_id"],
        keep=kept,
        counts={"kept": F.count_if(kept), "dropped": F.count_if(~kept)},
    ).select("doc_id", "text", "kept", "dropped")


# --- assembly and captions ------------------------------------------------------------------


@query(
    f"""WITH {TURNS_SQL}
SELECT conv_id, 0::BIGINT AS part, count(*) AS segments,
       string_agg(text, ' ' ORDER BY start, coalesce(channel, 0), ord) AS text
FROM turns GROUP BY conv_id"""
)
def assemble_text(spark, sf_dir):
    return assemble.assemble_text(turn_segments(spark, sf_dir), ["conv_id"]).select(
        "conv_id", "part", F.size("segments").cast("bigint").alias("segments"), "text"
    )


@query(
    f"""WITH {EVENTS_SQL}
SELECT user_id, event_type AS engine, count(*) AS chunks FROM ev GROUP BY user_id, event_type"""
)
def engine_counts(spark, sf_dir):
    counts = assemble.name_counts(
        event_rows(spark, sf_dir).withColumnRenamed("event_type", "engine"), "user_id", "engine"
    )
    return counts.select("user_id", F.explode("counts").alias("engine", "chunks"))


_CUES_SQL = f"""{TURNS_SQL},
tok AS (SELECT *, {sql_tokens('text')} AS tokens FROM turns),
wrapped AS (
  SELECT *, string_split(list_reduce(tokens, lambda acc, w:
    CASE WHEN length(regexp_extract(acc, '[^\\n]*$')) + 1 + length(w) <= 42
         THEN acc || ' ' || w ELSE acc || chr(10) || w END), chr(10)) AS lines
  FROM tok WHERE len(tokens) > 0),
line AS (
  SELECT conv_id, ord, channel, start, "end", unnest(lines) AS line,
         generate_subscripts(lines, 1) - 1 AS i FROM wrapped),
sized AS (SELECT *, i // 2 AS cue, length(replace(line, ' ', '')) AS c FROM line),
grouped AS (
  SELECT conv_id, ord, channel, start, "end", cue, sum(c)::BIGINT AS c,
         string_agg(line, chr(10) ORDER BY i) AS body
  FROM sized GROUP BY conv_id, ord, channel, start, "end", cue),
placed AS (
  SELECT *, sum(c) OVER (PARTITION BY conv_id, ord ORDER BY cue) - c AS c0,
         sum(c) OVER (PARTITION BY conv_id, ord ORDER BY cue) AS c1,
         sum(c) OVER (PARTITION BY conv_id, ord) AS total,
         count(*) OVER (PARTITION BY conv_id, ord) AS n FROM grouped),
timed AS (
  SELECT *, CASE WHEN n = 1 THEN start ELSE start + ("end" - start) * c0 / total END AS b,
         CASE WHEN n = 1 THEN "end" ELSE start + ("end" - start) * c1 / total END AS f
  FROM placed),
ms AS (SELECT *, greatest(0, round_even(b * 1000, 0)::BIGINT) AS start_ms FROM timed),
cues AS (SELECT conv_id, ord, channel, cue, body, start_ms,
         greatest(round_even(f * 1000, 0)::BIGINT, start_ms + 1) AS end_ms FROM ms)"""


@query(
    f"""WITH {_CUES_SQL} SELECT conv_id, ord, cue, start_ms, end_ms, body,
row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, ord, cue) AS number FROM cues"""
)
def caption_cues(spark, sf_dir):
    turns = turn_segments(spark, sf_dir)
    starts = turns.withColumn("start_ms", cue_start_ms(F.col("start")))
    hot = measure(starts, ["conv_id"], "start_ms")
    cues = captions.number_cues(
        captions.caption_cues(turns, ["conv_id"]), ["conv_id"], hot_rows=hot
    )
    return cues.select(
        "conv_id",
        "ord",
        F.col("cue").cast("bigint").alias("cue"),
        "start_ms",
        "end_ms",
        F.array_join("lines", "\n").alias("body"),
        "number",
    )


def _stamp(ms: str, sep: str) -> str:
    return (
        f"printf('%02d:%02d:%02d{sep}%03d', {ms} // 3600000, {ms} // 60000 % 60, "
        f"{ms} // 1000 % 60, {ms} % 1000)"
    )


_LABEL = "CASE WHEN channel IS NULL THEN '' ELSE '[Speaker ' || (channel + 1) || '] ' END"
_VOICE = "CASE WHEN channel IS NULL THEN '' ELSE '<v Speaker ' || (channel + 1) || '>' END"


@query(
    f"""WITH {_CUES_SQL}, numbered AS (SELECT *,
  row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, ord, cue) AS n FROM cues)
SELECT conv_id, 0::BIGINT AS part, string_agg(n || chr(10) || {_stamp('start_ms', ',')} || ' --> ' ||
  {_stamp('end_ms', ',')} || chr(10) || {_LABEL} || body || chr(10) || chr(10), '' ORDER BY n) AS body
FROM numbered GROUP BY conv_id"""
)
def srt_render(spark, sf_dir):
    return captions.render_srt(turn_segments(spark, sf_dir), ["conv_id"])


_ESCAPED = "replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    f"""WITH {_CUES_SQL}, numbered AS (SELECT *,
  row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, ord, cue) AS n FROM cues),
docs AS (SELECT conv_id, string_agg({_stamp('start_ms', '.')} || ' --> ' ||
  {_stamp('end_ms', '.')} || chr(10) || {_VOICE} || {_ESCAPED} || chr(10) || chr(10), '' ORDER BY n)
  AS body FROM numbered GROUP BY conv_id)
SELECT r.conv_id, 0::BIGINT AS part, 'WEBVTT' || chr(10) || chr(10) || coalesce(body, '') AS body
FROM (SELECT DISTINCT conv_id FROM conversations) r LEFT JOIN docs USING (conv_id)"""
)
def vtt_render(spark, sf_dir):
    turns = turn_segments(spark, sf_dir)
    return captions.render_vtt(turns, ["conv_id"], recordings=turns)


@query(
    f"""WITH {TURNS_SQL}
SELECT conv_id, 0::BIGINT AS part,
  string_agg({_LABEL} || text || chr(10), '' ORDER BY start, coalesce(channel, 0), ord) AS body
FROM turns WHERE text <> '' GROUP BY conv_id"""
)
def text_render(spark, sf_dir):
    return captions.render_text(turn_segments(spark, sf_dir), ["conv_id"])


# --- regions and chunk plans ----------------------------------------------------------------

_MERGED_SQL = f"""{INTERVALS_SQL},
reach AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end"
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
flag AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island
         FROM reach),
merged AS (SELECT user_id, min(start) AS start, max("end") AS "end"
           FROM flag GROUP BY user_id, island)"""


def _merged(spark, sf_dir) -> DataFrame:
    return merged_and_hot(spark, sf_dir)[0]


def merged_and_hot(spark, sf_dir) -> tuple[DataFrame, Hot]:
    """Merged regions, and the hot users found once for all steps that follow."""
    intervals = event_intervals(spark, sf_dir)
    hot = measure(intervals, ["user_id"], "start")
    return regions.merge_regions(intervals, ["user_id"], hot_rows=hot), hot


@query(f'WITH {_MERGED_SQL} SELECT user_id, start, "end" FROM merged')
def merge_regions(spark, sf_dir):
    return _merged(spark, sf_dir)


_PACKED_SQL = f"""RECURSIVE {_MERGED_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) AS rn FROM merged),
fold AS (
  SELECT user_id, rn, start AS s, "end" AS e FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.user_id, r.rn,
    CASE WHEN r."end" - f.s <= {MAX_CHUNK_US} AND r.start - f.e <= {MAX_GAP_US} THEN f.s
         ELSE r.start END, r."end"
  FROM fold f JOIN ranked r ON r.user_id = f.user_id AND r.rn = f.rn + 1),
packed AS (SELECT user_id, s AS start, max(e) AS "end" FROM fold GROUP BY user_id, s)"""


def packed_chunks(spark, sf_dir) -> tuple[DataFrame, DataFrame, Hot]:
    """Chunks, the regions they pack, and the hot users."""
    merged, hot = merged_and_hot(spark, sf_dir)
    packed = chunks.pack_chunks(
        merged, ["user_id"], max_chunk=MAX_CHUNK_US, max_gap=MAX_GAP_US, hot_rows=hot
    )
    return packed, merged, hot


@query(
    f"""WITH {_PACKED_SQL} SELECT user_id, start, "end",
row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS idx FROM packed"""
)
def pack_chunks(spark, sf_dir):
    packed, _, hot = packed_chunks(spark, sf_dir)
    numbered = chunks.number_chunks(
        packed.withColumn("channel", F.lit(None).cast("int")), "user_id", hot_rows=hot
    )
    return numbered.select("user_id", "start", "end", F.col("index").cast("bigint").alias("idx"))


@query(
    f"""WITH {_PACKED_SQL},
speech AS (SELECT user_id, sum("end" - start)::BIGINT AS speech FROM merged GROUP BY user_id),
plan AS (SELECT user_id, count(*) AS chunks, sum("end" - start)::BIGINT AS transcribed
         FROM packed GROUP BY user_id)
SELECT user_id, chunks, transcribed, speech, speech / transcribed AS speech_ratio
FROM plan JOIN speech USING (user_id)"""
)
def plan_stats(spark, sf_dir):
    packed, merged, _ = packed_chunks(spark, sf_dir)
    speech = regions.region_totals(merged, ["user_id"])
    plan = chunks.plan_stats(packed, ["user_id"])
    return plan.join(speech, "user_id").select(
        "user_id",
        "chunks",
        F.col("transcribed_samples").alias("transcribed"),
        F.col("speech_samples").alias("speech"),
        F.try_divide("speech_samples", "transcribed_samples").alias("speech_ratio"),
    )


@query(
    f"""WITH {_PACKED_SQL} SELECT m.user_id, m.start, p.start AS chunk_start
FROM merged m JOIN packed p ON m.user_id = p.user_id AND p.start <= m.start AND m."end" <= p."end" """
)
def chunk_coverage(spark, sf_dir):
    packed, merged, hot = packed_chunks(spark, sf_dir)
    covered = chunks.covering_chunks(merged, packed, ["user_id"], hot_rows=hot)
    return covered.where("covered").select("user_id", "start", "chunk_start")


@query(
    f"""WITH {_PACKED_SQL}, n AS (SELECT *, lead(start) OVER w AS ns, lead("end") OVER w AS ne FROM packed
  WINDOW w AS (PARTITION BY user_id ORDER BY start)),
r AS (SELECT user_id, start, CASE WHEN "end" <= start THEN 'empty'
  WHEN "end" - start > {MAX_CHUNK_US // 2} THEN 'too_long' WHEN ns < "end" THEN 'overlap'
  WHEN ne - start <= {MAX_CHUNK_US // 2} AND ns - "end" <= {2 * MAX_GAP_US} THEN 'mergeable' END AS rule FROM n)
SELECT * FROM r WHERE rule IS NOT NULL"""
)
def plan_violations(spark, sf_dir):
    """The packed plan held against stricter limits than it was made for."""
    packed, _, hot = packed_chunks(spark, sf_dir)
    broken = chunks.plan_violations(
        packed, ["user_id"], max_chunk=MAX_CHUNK_US // 2, max_gap=2 * MAX_GAP_US, hot_rows=hot
    )
    return broken.select("user_id", "start", "rule")


@query(
    """SELECT doc_id, s AS start, least(s + 500, n_chars) AS "end"
FROM (SELECT doc_id, n_chars, unnest(generate_series(0::BIGINT, n_chars - 1, 500)) AS s
      FROM documents WHERE n_chars > 0)"""
)
def naive_windows(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return chunks.fixed_windows(docs, "n_chars", 500).select("doc_id", "start", "end")


@query(
    """SELECT o_orderkey AS job_id, idx FROM
(SELECT o_orderkey, unnest(generate_series(0::BIGINT, o_orderkey % 7)) AS idx FROM orders) p
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = p.o_orderkey
                  AND l.l_linenumber = p.idx)"""
)
def pending_chunks(spark, sf_dir):
    plan = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("o_orderkey") % 7)).alias("idx"),
    )
    done = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("bigint").alias("idx")
    )
    return chunks.pending_chunks(plan, done, ["job_id", "idx"])


@query(
    """SELECT l_orderkey AS job_id, l_linenumber::BIGINT AS idx, l_partkey AS part,
  nullif(l_suppkey % 3, 0) AS channel
FROM lineitem l WHERE EXISTS (
  SELECT 1 FROM (SELECT o_orderkey, unnest(generate_series(0::BIGINT, o_orderkey % 7)) AS idx
                 FROM orders) p
  WHERE p.o_orderkey = l.l_orderkey AND p.idx = l.l_linenumber
    AND nullif(p.idx % 3, 0) IS NOT DISTINCT FROM nullif(l.l_suppkey % 3, 0))"""
)
def reusable_results(spark, sf_dir):
    third = F.lit(0).cast("bigint")
    plan = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("o_orderkey") % 7)).alias("idx"),
    ).withColumn("channel", F.nullif(F.col("idx") % 3, third))
    results = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").cast("bigint").alias("idx"),
        F.col("l_partkey").alias("part"),
        F.nullif(F.col("l_suppkey") % 3, third).alias("channel"),
    )
    return chunks.reusable_results(results, plan, ["job_id", "idx"], ["channel"])


# --- audio frames ---------------------------------------------------------------------------


def _samples() -> Column:
    return F.transform(
        "embedding", lambda x: F.floor(x.cast("double") * 32768.0).cast("smallint")
    )


_FRAMES_SQL = """
pcm AS (SELECT vec_id, label,
          list_transform(embedding, lambda x: floor(x::DOUBLE * 32768.0)::BIGINT) AS s
        FROM embeddings),
frames AS (
  SELECT vec_id, label, i AS frame_idx, i * 8 AS frame_start,
         list_sum(list_transform(s[i * 8 + 1 : i * 8 + 8], lambda x: x * x))::DOUBLE AS energy
  FROM (SELECT *, unnest(range(8)) AS i FROM pcm))"""


def _frames(spark, sf_dir) -> DataFrame:
    pcm = load(spark, sf_dir, "embeddings").select("vec_id", "label", _samples().alias("samples"))
    return audio.frames_of(pcm, ["vec_id", "label"], "samples", 8)


@query(
    f"""WITH {_FRAMES_SQL} SELECT vec_id, frame_idx, frame_start + 4 AS cut, energy FROM (
SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY energy, frame_idx) AS rn FROM frames)
WHERE rn = 1"""
)
def quietest_frame(spark, sf_dir):
    return chunks.quietest_frame(_frames(spark, sf_dir), ["vec_id"]).select(
        "vec_id",
        F.col("frame_idx").cast("bigint").alias("frame_idx"),
        (F.col("frame_start") + 4).cast("bigint").alias("cut"),
        "energy",
    )


@query(f"WITH {_FRAMES_SQL} SELECT vec_id, frame_idx, energy / 8 AS power FROM frames")
def frame_power(spark, sf_dir):
    return _frames(spark, sf_dir).select(
        "vec_id", F.col("frame_idx").cast("bigint").alias("frame_idx"),
        (F.col("energy") / 8).alias("power"),
    )


@query(
    f"""WITH {_FRAMES_SQL}, p AS (SELECT vec_id, energy / 8 AS power FROM frames),
m AS (SELECT vec_id, max(power) AS loudest FROM p GROUP BY vec_id)
SELECT vec_id, avg(power) FILTER (WHERE power > loudest * 1e-4) AS active_power,
       sqrt(avg(power)) AS rms FROM p JOIN m USING (vec_id) GROUP BY vec_id"""
)
def active_power(spark, sf_dir):
    return audio.active_power(_frames(spark, sf_dir), ["vec_id"], 8)


class _Loudness:
    """Deterministic engine: says whether a chunk is loud; refuses chunks that begin at zero."""

    name = "loudness"

    def transcribe(self, audio, *, language, prompt, word_timestamps):
        if audio[0] == 0:
            raise engine.EngineFailure("invalid_input", retryable=False)
        power = float(((audio.astype("float64") * 32768) ** 2).sum())
        row = {"start": 0.0, "end": len(audio) / 16000, "text": "loud" if power > 1.073e9 else "quiet"}
        return {"segments": [row], "language": language or "eng", "language_probability": 0.5}


@query(
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 32768.0)::BIGINT) AS s
  FROM embeddings)
SELECT vec_id, CASE WHEN s[1] = 0 THEN NULL
  WHEN list_sum(list_transform(s, lambda x: x * x)) > 1.073e9 THEN 'loud' ELSE 'quiet' END AS text,
  CASE WHEN s[1] = 0 THEN 'invalid_input' END AS error_code, 1 AS attempts FROM s"""
)
def engine_chunks(spark, sf_dir):
    """Vectors as chunks of audio through the engine seam."""
    pcm = load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("recording_id"), F.lit(0).alias("index"),
        _samples().alias("samples"),
    )
    raw = engine.transcribe_chunks(pcm, _Loudness)
    return raw.select(
        F.col("recording_id").cast("bigint").alias("vec_id"),
        F.try_element_at("segments", F.lit(1))["text"].alias("text"), "error_code", "attempts",
    )


# --- words and languages --------------------------------------------------------------------


def _event_words(spark, sf_dir) -> DataFrame:
    ev = event_rows(spark, sf_dir)
    k = F.col("k")
    start = F.col("us") / 1e6
    return ev.select(
        "user_id",
        F.col("us").alias("ord"),
        F.when(F.col("event_type") == "view", " ")
        .when(k % 5 == 0, F.concat("event_type", F.lit(". ")))
        .otherwise(F.col("event_type"))
        .alias("text"),
        start.alias("start"),
        (start + F.col("value") / 100).alias("end"),
        F.when(F.col("event_type") == "view", "spacing")
        .when(F.col("event_type") == "signup", "audio_event")
        .otherwise("word")
        .alias("type"),
        F.when(k % 7 != 0, -(k % 20) / F.lit(16.0)).alias("logprob"),
    )


#: Events as words, with the number of their segment: ``g``.
GROUPED_SQL = f"""WITH {EVENTS_SQL},
w AS (SELECT user_id, us AS ord,
    CASE WHEN event_type = 'view' THEN ' ' WHEN k % 5 = 0 THEN event_type || '. '
         ELSE event_type END AS text,
    us / 1e6::DOUBLE AS start, us / 1e6::DOUBLE + value / 100 AS "end",
    event_type <> 'view' AS is_word,
    CASE WHEN k % 7 <> 0 THEN -(k % 20) / 16.0::DOUBLE END AS logprob
  FROM ev WHERE event_type <> 'signup'),
p AS (SELECT *, last_value(CASE WHEN is_word THEN "end" END IGNORE NULLS) OVER win AS prev_end,
    last_value(CASE WHEN is_word THEN regexp_matches(text, '[.?!…。？！]\\s*$') END IGNORE NULLS)
      OVER win AS prev_ends
  FROM w WINDOW win AS (PARTITION BY user_id ORDER BY ord
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(CASE WHEN is_word AND (prev_end IS NULL OR prev_ends OR start - prev_end > 7200)
                         THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ord) AS grp FROM p)
"""


@query(
    f"""{GROUPED_SQL}
SELECT user_id, grp::BIGINT AS grp, arg_min(start, ord) FILTER (WHERE is_word) AS start,
  arg_max("end", ord) FILTER (WHERE is_word) AS "end",
  trim(string_agg(text, '' ORDER BY ord)) AS text, avg(logprob) FILTER (WHERE is_word) AS avg_logprob,
  count(*) FILTER (WHERE is_word) AS words
FROM g WHERE is_word OR NOT coalesce(prev_ends, true) GROUP BY user_id, grp"""
)
def group_words(spark, sf_dir):
    grouped = words.group_words(_event_words(spark, sf_dir), ["user_id"], pause=7200.0)
    return grouped.select(
        "user_id",
        F.col("group").alias("grp"),
        "start",
        "end",
        "text",
        "avg_logprob",
        F.size("words").cast("bigint").alias("words"),
    )


def _grouped_events(spark, sf_dir) -> DataFrame:
    return words.grouped_words(_event_words(spark, sf_dir), ["user_id"], pause=7200.0)


@query(
    f"""{GROUPED_SQL}
SELECT user_id, grp::BIGINT AS grp, arg_min(start, ord) FILTER (WHERE is_word) AS start,
  arg_max("end", ord) FILTER (WHERE is_word) AS "end", count(*) FILTER (WHERE is_word) AS words,
  avg(logprob) FILTER (WHERE is_word) AS avg_logprob, round(min(exp(logprob)) FILTER (WHERE is_word), 9) AS least
FROM g WHERE is_word OR NOT coalesce(prev_ends, true) GROUP BY user_id, grp"""
)
def segment_spans(spark, sf_dir):
    """Bounds, counts and probabilities of segments of any length, from partial aggregates alone."""
    spans = words.segment_spans(_grouped_events(spark, sf_dir), ["user_id"])
    least = F.round("least_probability", 9).alias("least")
    return spans.select("user_id", F.col("group").alias("grp"), "start", "end", "words", "avg_logprob", least)


@query(
    f"""{GROUPED_SQL},
numbered AS (SELECT user_id, grp, ord, text,
    (row_number() OVER (PARTITION BY user_id, grp ORDER BY ord) - 1) // 3 AS part
  FROM g WHERE is_word OR NOT coalesce(prev_ends, true))
SELECT user_id, grp::BIGINT AS grp, part, string_agg(text, '' ORDER BY ord) AS text
FROM numbered GROUP BY user_id, grp, part"""
)
def segment_texts(spark, sf_dir):
    """Texts of segments in parts of three words or spacings."""
    parts = words.segment_texts(_grouped_events(spark, sf_dir), ["user_id"], part_rows=3)
    return parts.withColumnRenamed("group", "grp")


def _code() -> Column:
    v = F.col("doc_id") % 7
    return (
        F.when(v == 0, F.col("lang"))
        .when(v == 1, F.concat(F.upper("lang"), F.lit("-XX")))
        .when(v == 2, F.concat(F.lit(" "), "lang", F.lit("_yy ")))
        .when(v == 3, F.lit("eng"))
        .when(v == 4, F.lit("yue-HK"))
        .when(v == 5, F.lit("-US"))
    )


_CODE_SQL = """CASE doc_id % 7 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '-XX'
  WHEN 2 THEN ' ' || lang || '_yy ' WHEN 3 THEN 'eng' WHEN 4 THEN 'yue-HK' WHEN 5 THEN '-US' END"""
_CANON_SQL = ", ".join(f"('{a}', '{c}')" for a, c in CANONICAL.items())
_LANG_SQL = f"""
canon(alias, canonical) AS (VALUES {_CANON_SQL}),
coded AS (SELECT doc_id, source, {_CODE_SQL} AS code FROM documents),
prim AS (SELECT *, nullif(string_split(replace(lower({sql_strip('code')}), '_', '-'), '-')[1], '')
         AS p FROM coded),
normed AS (SELECT doc_id, source, code, coalesce(canonical, p) AS language
           FROM prim LEFT JOIN canon ON alias = p)"""


@query(f"WITH {_LANG_SQL} SELECT doc_id, code, language FROM normed")
def language_normalise(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", _code().alias("code"))
    return docs.withColumn("language", normalise_language(F.col("code")))


@query(
    f"""WITH {_LANG_SQL}, firsts AS (SELECT source, min(doc_id) AS doc_id FROM normed
  WHERE language IS NOT NULL GROUP BY source)
SELECT s.source, n.language, n.doc_id / 1024.0::DOUBLE AS probability
FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN firsts f USING (source)
LEFT JOIN normed n ON n.doc_id = f.doc_id"""
)
def language_pin(spark, sf_dir):
    results = load(spark, sf_dir, "documents").select(
        "source",
        F.col("doc_id").alias("chunk"),
        _code().alias("language"),
        (F.col("doc_id") / F.lit(1024.0)).alias("language_probability"),
    )
    return assemble.pin_language(results, key="source")
