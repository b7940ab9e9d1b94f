"""Schemas of the speech-corpus tables. Always given to readers, never inferred."""

from __future__ import annotations

SAMPLE_RATE = 16_000

WORD = "struct<start:double,end:double,text:string,probability:double>"
SEGMENT = (
    "struct<start:double,end:double,text:string,channel:int,avg_logprob:double,"
    "no_speech_prob:double,compression_ratio:double,"
    f"words:array<{WORD}>,low_confidence:boolean>"
)

PCM_BLOCKS = (
    "recording_id string, channel int, block_idx int, start_sample bigint, samples array<smallint>"
)
REGIONS = "recording_id string, channel int, start bigint, end bigint"
CHUNKS = (
    "recording_id string, index int, channel int, start bigint, end bigint, forced_cut boolean"
)
RAW_SEGMENTS = (
    "recording_id string, chunk int, ord int, start double, end double, text string, "
    "avg_logprob double, no_speech_prob double, compression_ratio double, "
    f"words array<{WORD}>"
)
RAW_CHUNKS = (
    "recording_id string, chunk int, engine string, language string, "
    f"language_probability double, segments array<{SEGMENT}>, error_code string, attempts int"
)
CLIPS = "id string, audio string, reference string, tags array<string>"
RESPONSE = (
    "struct<language_code:string,language_probability:double,"
    "words:array<struct<text:string,start:double,end:double,type:string,logprob:double>>>"
)
PROBE = (
    "struct<format:struct<format_name:string,duration:string>,"
    "streams:array<struct<codec_type:string,codec_name:string,channels:int,sample_rate:string>>>"
)
OPTIONS = (
    "struct<language:string,prompt:string,split_channels:boolean,word_timestamps:boolean>"
)
AUDIO_INFO = (
    "struct<container:string,codec:string,channels:int,sample_rate:int,header_duration_s:double>"
)
API_KEYS = (
    "id string, name string, key_prefix string, key_hash string, webhook_secret string, "
    "rate_limit_per_minute int, created_at timestamp, revoked_at timestamp"
)
JOBS = (
    "id string, api_key_id string, status string, idempotency_key string, "
    "request_fingerprint string, audio_key string, audio_bytes bigint, audio_sha256 string, "
    f"options {OPTIONS}, webhook_url string, duration_s double, language string, "
    "language_probability double, chunks_total int, chunks_done int, attempts int, "
    "worker_id string, lease_expires_at timestamp, error_code string, error_status int, "
    "error_message string, webhook_status string, webhook_attempts int, "
    "webhook_next_at timestamp, webhook_last_error string, created_at timestamp, "
    "updated_at timestamp, started_at timestamp, finished_at timestamp, "
    f"audio_deleted_at timestamp, audio_info {AUDIO_INFO}"
)
CHUNK_RESULTS = (
    "job_id string, idx int, channel int, start bigint, end bigint, engine string, "
    f"language string, segments array<{SEGMENT}>, dropped map<string,int>, ts timestamp"
)
JOB_EVENTS = (
    "job_id string, ts timestamp, seq bigint, event string, worker_id string, payload string"
)
REQUESTS = (
    "request_id string, ts timestamp, api_key string, bucket string, cost int, "
    "idempotency_key string, fingerprint string, size bigint, container string"
)
ATTEMPTS = "engine string, ts timestamp, seq bigint, outcome string"
DELIVERIES = (
    "job_id string, ts timestamp, seq bigint, event string, http_status int, error string"
)
LOGS = "ts timestamp, level string, logger string, msg string, rest variant"
DLQ = "id string, job_id string, reason string, raw string"

# Error code -> (HTTP status, retryable).
ERROR_CODES = {
    "internal_error": (500, False),
    "invalid_input": (422, False),
    "unsupported_media_type": (415, False),
    "no_audio_stream": (422, False),
    "undecodable_audio": (422, False),
    "payload_too_large": (413, False),
    "audio_too_long": (413, False),
    "asr_engine_error": (502, True),
    "asr_engine_unavailable": (503, True),
    "lease_lost": (500, True),
    "max_attempts_exceeded": (500, False),
    "unauthorized": (401, False),
    "not_found": (404, False),
    "conflict": (409, False),
    "idempotency_key_reused": (409, False),
    "not_ready": (409, False),
    "rate_limited": (429, False),
    "queue_full": (429, False),
    "bad_request": (400, False),
    "dependency_unavailable": (503, True),
}

# Histogram upper bounds.
BUCKETS = {
    "job_processing_seconds": (1, 5, 15, 30, 60, 120, 300, 600, 1800, 3600, 7200),
    "job_realtime_factor": (0.25, 0.5, 1, 2, 4, 8, 16, 32, 64, 128),
    "speech_ratio": (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0),
    "chunk_transcribe_seconds": (0.25, 0.5, 1, 2, 4, 8, 16, 32, 64),
    "http_request_seconds": (
        0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
    ),
}
