"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

PREDICTION = (
    "processed_transcript: string, predicted_transcript: string, raw_model_response: string, thought: string,"
    " error: struct<type: string, code: string, status: string, message: string>"
)
PASSTHROUGH = (
    "utt_id: string, key: string, metadata_idx: long, split: string, lang_sym: string, canonical_ipa: string,"
    " masked_phones: array<string>, target: string, audio_path: string"
)
RECORD = f"struct<pred: array<struct<{PREDICTION}>>, passthrough: struct<{PASSTHROUGH}>>"
KALDI_TEXT = "utt_id string, text string"
MANIFEST = "key string, idx long, utt_id string, audio_path string, passthrough struct<target: string, utt_id: string, lang_sym: string, canonical_ipa: string>"
BATCH_RESULT = "key string, response struct<text: string, output_text: string, candidates: array<struct<content: struct<parts: array<struct<text: string>>>>>>, error struct<message: string>"
SCORING = "language string, utt_id string, prediction string, transcription string, canonical string"
AUDIT = "utt_id string, field string, raw string, normalized string, profile string, changed boolean, rule_ids string"
SPEAKER_META = "speaker string, sex string, severity int, label int, split string"
WORD_LIST = "WORD string, FILE_NAME string"
TIME_ALIGNED = (
    "segment_id string, text string, speaker_id string, phones array<string>, phone_timestamps array<struct<start: double, end: double>>,"
    " start_time double, end_time double, duration double"
)
