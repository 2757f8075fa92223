"""The whole cascade over ``documents`` as sessions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vellum.operators import cascade, intervals
from vellum.operators.storage import kept
from vellum.plans import transcripts as plan
from vellum.sources import transcripts as source

#: What the stand-in model takes for a name, and for something it can't judge.
NAMED, DOUBTFUL = "esth", "edtion"
ANSWER = StructType([StructField("answer", StringType()), StructField("failure", StringType())])


@F.pandas_udf(ANSWER)
def stand_in_model(prompts: pd.Series) -> pd.DataFrame:
    """Answers as a model does: a span for each word that it takes for a name."""
    answers = []
    for prompt in prompts:
        words = [line.split(":", 1) for line in prompt.split("\n")]
        spans = [{"start_word_id": int(i), "end_word_id_exclusive": int(i) + 1, "category": "contact", "action": "drop_words"} for i, w in words if w == NAMED]
        answers.append(json.dumps({"spans": spans[:64], "uncertain": len(spans) > 64 or any(w == DOUBTFUL for _, w in words)}))
    return pd.DataFrame({"answer": answers, "failure": pd.Series([None] * len(answers), dtype=object)})


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, sessions, speech): speech is heard where a word has letters or digits."""
    words = kept(plan._words(spark, sf_dir).where("session_id IS NOT NULL"))
    ends = source.session_ends(words)
    docs = plan.read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("session_id"), F.col("lang").alias("language"))
    sessions = docs.join(ends.select("session_id", F.col("high").alias("samples")), "session_id", "left").select("session_id", "language", F.col("samples").alias("total_samples"), "samples")
    return words, kept(sessions), kept(intervals.merge(words.where("text <> ''").select("session_id", "start", "end"), ["session_id"]))


def _outcomes(spark: SparkSession, sf_dir: str, find) -> DataFrame:
    words, sessions, speech = _sessions(spark, sf_dir)
    analysis, spans = cascade.analysed(words, stand_in_model, find=find)
    out = cascade.training_copies(words, sessions, speech, kept(analysis), kept(spans), recheck=cascade.analysis_recheck(stand_in_model, find=find))
    rounded = [F.round(F.col(c).cast("double"), 3).alias(c) for c in ("mean_confidence", "speech_ratio")]
    return out.select(F.col("session_id").alias("doc_id"), "reason", "clips", "words", "duration_ms", "removed_intervals", "removed_ms", *rounded, "content_hash")


def session_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's way through all exits, with all detectors and a stand-in model before and after the cuts."""
    return _outcomes(spark, sf_dir, None)


def session_outcomes_by_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the detectors of single words, which SQL can state."""

    def find(sessions: DataFrame) -> DataFrame:
        return plan.word_hits(sessions).select("session_id", "start", "stop", "category", "detector", F.lit("rules").alias("source"))

    return _outcomes(spark, sf_dir, find)


QUERIES = (session_outcomes, session_outcomes_by_word)

_SPOKEN = r"lower(regexp_replace(regexp_replace(display, '^[^\pL\pM\pN]+', ''), '[^\pL\pM\pN]+$', ''))"
_HITS = plan._HITS.replace("hits AS (", "found AS (", 1)
_CLIPS = plan._CLIPS.replace("coalesce(sum(g.e - g.s), 0) AS aligned", f"coalesce(sum(g.e - g.s) FILTER ({_SPOKEN.replace('display', 'g.display')} <> ''), 0) AS aligned")
SQL = {
    "session_outcomes_by_word": f"""WITH {plan._WORDS}, {_HITS},
hits AS (SELECT * FROM found UNION ALL SELECT doc_id, word_id::BIGINT, word_id::BIGINT + 1, 'model', 'contact' FROM flat WHERE {_SPOKEN} = '{NAMED}'), {plan._REMOVED}, {_CLIPS},
good AS (SELECT doc_id, count(*) AS clips, sum(n)::BIGINT AS words, sum(ms)::BIGINT AS ms, sha256(string_agg(text || chr(0), '' ORDER BY ix)) AS h, sum(conf::DOUBLE * n) / nullif(sum(n), 0) AS conf, sum(ratio::DOUBLE * ms) / nullif(sum(ms), 0) AS ratio FROM judged WHERE reason IS NULL GROUP BY doc_id),
told AS (SELECT doc_id, bool_or({_SPOKEN} = '{DOUBTFUL}') AS unsure, sum(CASE WHEN {_SPOKEN} <> '' THEN 6400 ELSE 0 END) AS heard, bool_or({_SPOKEN} = '') AS empty FROM flat GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS removed, (sum(e - s) * 1000 + 8000) // 16000 AS removed_ms FROM cuts GROUP BY doc_id),
early AS (
  SELECT t.doc_id, clips, words, ms, h, conf, ratio, removed, removed_ms, CASE WHEN len(toks) = 0 THEN 'empty_transcript' WHEN unsure THEN 'uncertain_analysis' WHEN lang IS DISTINCT FROM 'en' THEN 'language_not_validated' WHEN (heard / high)::FLOAT < 0.08::FLOAT THEN 'session_silent' WHEN empty THEN 'alignment_unusable'
    WHEN NOT EXISTS (SELECT 1 FROM clips c WHERE c.doc_id = t.doc_id) THEN 'fully_redacted' WHEN clips IS NULL THEN 'no_retained_clips' WHEN ms < 1500 THEN 'retained_audio_too_short' WHEN ms > 600000 THEN 'retained_audio_too_long' END AS reason
  FROM tok t LEFT JOIN good USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN bounds USING (doc_id) LEFT JOIN cut USING (doc_id)
),
last AS (SELECT *, CASE WHEN reason IS NULL AND doc_id <> min(doc_id) FILTER (reason IS NULL) OVER (PARTITION BY h) THEN 'duplicate_example' ELSE reason END AS why FROM early)
SELECT doc_id, why AS reason, CASE WHEN why IS NULL THEN clips ELSE 0 END AS clips, CASE WHEN why IS NULL THEN words ELSE 0 END AS words, CASE WHEN why IS NULL THEN ms ELSE 0 END AS duration_ms,
  CASE WHEN why IS NULL THEN coalesce(removed, 0) ELSE 0 END AS removed_intervals, (CASE WHEN why IS NULL THEN coalesce(removed_ms, 0) ELSE 0 END)::BIGINT AS removed_ms,
  round(CASE WHEN why IS NULL THEN conf ELSE 0 END::FLOAT::DOUBLE, 3) AS mean_confidence, round(CASE WHEN why IS NULL THEN ratio ELSE 0 END::FLOAT::DOUBLE, 3) AS speech_ratio, CASE WHEN why IS NULL THEN h END AS content_hash FROM last""",
}
