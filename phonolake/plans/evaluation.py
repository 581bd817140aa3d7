"""The flagship plan: shards are merged, normalized with an audit, projected, aligned, and summed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ipa import normalize_predictions
from ..operators import merge, scoring
from ..sources import kaldi, predictions


def scoring_input(rows: DataFrame, gt_field: str = "masked_phones", canonical: DataFrame | None = None) -> DataFrame:
    """(language, utt_id, prediction, transcription, canonical) of normalized predictions.

    ``gt_field`` masked_phones joins the phones that are no noise; any other names a field of the passthrough.  A
    canonical file overrides the field.  A row without a language is of ``combined``; of equal utterances one wins."""
    own = F.col("passthrough")
    truth = F.array_join(F.array_remove(own["masked_phones"], "[NOISE]"), "") if gt_field == "masked_phones" else own[gt_field]
    out = rows.select(
        F.coalesce(own["lang_sym"], F.lit("combined")).alias("language"), F.coalesce(own["utt_id"], own["key"], F.col("sample_key")).alias("utt_id"),
        merge.first_prediction(F.col("pred")).alias("prediction"), F.coalesce(truth, F.lit("")).alias("transcription"), own["canonical_ipa"].alias("canonical"), "sample_key",
    )
    if canonical is not None:
        out = merge.override(out, canonical.withColumnRenamed("text", "canonical"), "utt_id", "canonical")
    return merge.last_wins(out, ["language", "utt_id"], ["sample_key"]).drop("sample_key")


def check_folder(spark: SparkSession, folder: str) -> None:
    """Raises unless every logged error is in the shards as an empty prediction."""
    own = F.col("passthrough")
    key = F.coalesce(own["utt_id"], own["key"], own["metadata_idx"].cast("string"), F.col("sample_key"))
    rows = predictions.read_shards(spark, folder).select(
        key.alias("key"), merge.first_prediction(F.col("pred")).alias("processed_transcript"), merge.first_prediction(F.col("pred"), "predicted_transcript").alias("predicted_transcript")
    )
    merge.check_errors_represented(predictions.read_error_keys(spark, folder), rows)


def evaluate_folder(spark: SparkSession, folder: str, canonical_file: str | None = None, gt_field: str = "target", joint: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored utterances, summary by language, audit) of a run's folder."""
    rows, audit = normalize_predictions(predictions.read_shards(spark, folder))
    canonical = kaldi.read_canonical(spark, canonical_file) if canonical_file else None
    scored = scoring.score_utterances(scoring_input(rows, gt_field, canonical), joint)
    return scored, scoring.summarize(scored, ["language"]), audit
