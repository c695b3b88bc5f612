"""Fixed values. Results only match when these stay as they are."""

# Sampling and gate
SAMPLES_PER_SECOND = 2.0
RECOGNITION_INTERVAL_S = 1.0
MAX_MEDIA_TIME_S = 7 * 24 * 60 * 60
THUMB_WIDTH = 320
THUMB_HEIGHT = 160
PIXEL_DELTA = 32
CUT_PIXEL_SHARE = 0.35
CUT_MEAN_SHIFT = 28
# Bands of writing in a thumbnail: heights, widths and movement, as shares of the picture or grey levels.
BAND_HEIGHT_SHARE = 0.22
BAND_ENERGY_WIDTH = 6
BAND_ENERGY_SHARE = 0.06
BAND_COLUMN_LEAST = 32
BAND_COLUMN_DEPTH = 8
BAND_WIDE_SHARE = 0.18
BAND_FULL_SHARE = 0.96
GLYPH_WIDTH_SHARE = 0.025
GLYPH_PIXEL_SHARE = 0.008

# Recognition
SHORT_TEXT_CHARS = 2
SHORT_TEXT_CONFIDENCE = 0.78
TEXT_CONFIDENCE = 0.45
LINE_BAND_SHARE = 0.06
BOX_GROWTH = 1.6
BOX_MIN_AREA = 8
BOX_MIN_SIDE = 3
BOX_MIN_SCORE = 0.25
SCORE_SUM_LOW = 0.98
SCORE_SUM_HIGH = 1.02
CROP_HEIGHT = 48
WIDTH_STEP = 8
MIN_WIDTH = 32
MAX_WIDTH = 2048
BATCH_SIZE = 8
BATCH_WIDTH_RATIO = 1.25
FRAMES_PER_BATCH = 4
CROPS_PER_BATCH = 32

# Cues
MERGE_GAP_MS = 750
MIN_CUE_MS = 100

# Regions: name, then top, bottom, left, right; vertical values count from the bottom
REGION_PROFILES = [
    ("bottom", "0.42", "0.02", "0.03", "0.97"),
    ("lower-half", "0.55", "0", "0.02", "0.98"),
    ("full", "1", "0", "0", "1"),
]
REGION_MIN_SPAN = 0.08

# Files
VIDEO_EXTENSIONS = ["mp4", "mkv", "avi", "mov", "webm", "ts", "m2ts", "wmv", "m4v"]
EXPORT_EXTENSIONS = ["srt", "ttml", "txt", "md"]
MAX_CUE_FILE_BYTES = 20 * 1024 * 1024
ARROW = " --> "

# Cleanup and translation work
CLEAN_CHUNK = 12
TRANSLATE_CHUNK = 8
CONTEXT_CUES = 4
SAMPLE_CUES = 24
PROMPT_SAMPLES = 8
SAMPLE_MIN_LETTERS = 3
MAX_GUIDANCE_CHARS = 4000
MAX_LANGUAGE_BYTES = 64
AUTO_LANGUAGE = "Auto detect"
STRENGTHS = ["light", "balanced", "strong"]
MODES = ["clean", "translate"]
REMOVE_MARK = "[[REMOVE]]"
LOG_EXCERPT_CHARS = 32000
LOG_EXCERPT_MARK = "\n[truncated]\n"

# Where an answer begins in a transcript
ASSISTANT_MARKERS = ["\r\nAssistant:\r\n", "\nAssistant:\n", "Assistant:\r\n", "Assistant:\n"]

# Messages that other rules test by prefix or by equality
MODEL_ERROR_PREFIX = "The model "
TRANSPORT_ERROR_PREFIXES = [
    "Local AI request failed:",
    "Local AI engine returned",
    "Local AI response",
    "Could not read local AI response:",
]
CANCELLED_MESSAGE = "Processing was cancelled."
PROGRESS_PREFIX = "OCRProgress="
ENGINE_MARKER = "1/2 Native engine"
RESULT_START = "RESULT START"
RESULT_END = "RESULT END ---"
COMPLETE_LINE = "Pipeline=COMPLETE"
ERROR_PREFIX = "ERROR:"

# Stages of a run's output lines
STAGE_LABELS = {
    "ocr": "Scanning and recognizing subtitles",
    "engine": "Scanning subtitles with the native OCR engine",
    "finalize": "Preparing results",
    "complete": "Subtitles ready",
}

# Run metrics: stages whose seconds are attributed, then every field with its type
ATTRIBUTED_STAGES = [
    "detector_preprocess_seconds",
    "detector_forward_seconds",
    "detector_postprocess_seconds",
    "recognizer_preprocess_seconds",
    "recognizer_forward_seconds",
    "recognizer_postprocess_seconds",
]
METRIC_FIELDS = [
    ("mode", "string"),
    ("inference_backend", "string"),
    ("compute_requested", "string"),
    ("onnxruntime_version", "string"),
    ("compute_effective", "string"),
    ("recognizer_provider_calibration_status", "string"),
    ("recognizer_provider_calibration_seconds", "double"),
    ("recognizer_provider_baseline_seconds", "double"),
    ("recognizer_provider_candidate_seconds", "double"),
    ("cuda_primary_all", "boolean"),
    ("dml_primary_all", "boolean"),
    ("directml_device_preference", "string"),
    ("sample_fps", "double"),
    ("video_prefetch_enabled", "boolean"),
    ("video_prefetch_queue_capacity", "bigint"),
    ("video_prefetch_max_depth", "bigint"),
    ("mixed_detector_overlap_enabled", "boolean"),
    ("mixed_detector_pending_capacity", "bigint"),
    ("mixed_cpu_decode_gate_overlap_enabled", "boolean"),
    ("mixed_gpu_detector_worker_enabled", "boolean"),
    ("mixed_detector_submitted", "bigint"),
    ("mixed_detector_max_pending", "bigint"),
    ("mixed_detector_elapsed_seconds", "double"),
    ("mixed_detector_wait_seconds", "double"),
    ("opencv_threads", "bigint"),
    ("frame_rate", "double"),
    ("frame_count", "bigint"),
    ("sample_count", "bigint"),
    ("sampled_frames", "bigint"),
    ("ocr_count", "bigint"),
    ("stable_samples_skipped", "bigint"),
    ("change_gate_checks", "bigint"),
    ("change_gate_ocr_triggers", "bigint"),
    ("forced_ocr_checks", "bigint"),
    ("forced_only_ocr_calls", "bigint"),
    ("ocr_transition_backdates", "bigint"),
    ("sample_period_seconds", "double"),
    ("cue_count", "bigint"),
    ("duration_seconds", "double"),
    ("last_decoded_timestamp_seconds", "double"),
    ("video_decode_seconds", "double"),
    ("video_sampling_seconds", "double"),
    ("ocr_total_seconds", "double"),
    ("ocr_unattributed_seconds", "double"),
    ("recognizer_batch_size", "bigint"),
    ("recognizer_batch_calibration", "string"),
    ("recognizer_batch_calibration_seconds", "double"),
    ("recognizer_frame_batch_size", "bigint"),
    ("elapsed_seconds", "double"),
]
METRIC_NESTED = [
    "available_providers",
    "session_providers",
    "model_session_providers",
    "cuda_runtime_packages",
    "ocr_stage_seconds",
    "recognizer_batch_histogram",
]

# Files: a time, the two lines that open a cue, and the frame of a TTML file
CUE_TIME = r"\d{2,}:\d{2}:\d{2},\d{3}"
TTML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<tt xmlns="http://www.w3.org/ns/ttml"><body><div>\n'
TTML_TAIL = "</div></body></tt>\n"
