"""Fixed values that results depend on."""

from __future__ import annotations

# Fusion, sections, gate.
RRF_K = 60
VECTOR_WEIGHT, KEYWORD_WEIGHT, SECTION_WEIGHT, OVERVIEW_WEIGHT = 1.0, 1.0, 2.0, 1.5
SECTION_DISTINCT_MARGIN, SECTION_TIE_MARGIN = 0.015, 0.005
CANDIDATES, SECTION_CANDIDATES, OVERVIEW_CANDIDATES = 40, 8, 3
TOP_K = 8
KEYWORD_COVERAGE, SIMILARITY_SLACK = 0.75, 0.08
MIN_SIMILARITY = {"multilingual-e5-small": 0.835, "bge-m3": 0.45}
DIMENSIONS = {"multilingual-e5-small": 384, "bge-m3": 1024}
MODEL_MAX_TOKENS = {"multilingual-e5-small": 512, "bge-m3": 8192}
RELATED_SIMILARITY = 0.3

# Segments and chunks.
CHUNK_TOKENS, OVERLAP_TOKENS, MODEL_RESERVE = 450, 50, 64
LONG_PARAGRAPH = 600
LINES_PER_SEGMENT = 60
MIN_LETTERS = 3
MAX_TOP_SECTION, MAX_HEADING_WORDS = 40, 8
TOC_DOTS = 5
SECTION_SEPARATOR = " › "

# Prompt budget and cards.
ANSWER_RESERVE_TOKENS, SOURCE_OVERHEAD, PROMPT_SLACK, CHARS_PER_TOKEN = 1024, 8, 50, 3.5
SNIPPET_CHARS, TITLE_CHARS, RECENT_CONVERSATIONS = 260, 80, 30
NOT_FOUND = "I could not find anything about this in the selected document folders."

# Answer checks.
REASSIGN_RATIO, MIN_BEST, MIN_WORDS, MIN_SUPPORTED = 0.6, 0.5, 3, 0.5
STOP_WORDS = tuple(
    "the and for are but not you your with this that from have has was were will can its into than then "
    "there their they them what when where which who how why also any all may must should would could does did done "
    "our out use used using via per such only just more most other some each both very about above below over under "
    "please here these those been being after before while".split()
)
QUESTION_WORDS = tuple(
    "what how why when where which who does need want show give tell explain example examples "
    "sample samples code way ways step steps work works mean means difference between used make get set can".split()
)
MAX_EXCERPT_LINES, SAMPLE_BONUS, MIN_STATEMENTS = 80, 30, 2

# Files.
KIND_BY_EXT = {
    ".pdf": "pdf",
    ".docx": "office", ".doc": "office", ".odt": "office", ".rtf": "office",
    ".pptx": "office", ".ppt": "office", ".odp": "office",
    ".txt": "text", ".md": "text", ".markdown": "text",
}
SLIDE_EXTS = (".pptx", ".ppt", ".odp")
TYPE_GROUPS = {
    "pdf": [".pdf"],
    "word": [".docx", ".doc", ".odt", ".rtf"],
    "powerpoint": [".pptx", ".ppt", ".odp"],
    "text": [".txt", ".md", ".markdown"],
}
IGNORED_PREFIXES, IGNORED_SUFFIXES = ("~$", ".~lock", "."), (".tmp", ".crdownload", ".part")
HIDDEN_DIR_PREFIXES = (".", "$", "~")
SECONDS_PER_FILE = {"pdf": 3.0, "office": 8.0, "text": 0.5}
SECONDS_PER_MB = {"pdf": 2.5, "office": 4.0, "text": 1.0}
OTHER_SECONDS = 2.0
PREVIEW_MAX_ENTRIES = 200_000
SESSION_DAYS = 14
LANE_WIDTHS = {"doc": 2, "media": 1, "system": 1}
PROGRESS_SECONDS = 1

# Queue.
STALE_SECONDS, STARTUP_STALE_SECONDS, RETRY_SECONDS, MAX_ATTEMPTS = 120, 60, 30, 3
ALIVE_SECONDS, RESCAN_SECONDS, STABILITY_SECONDS, POLL_SECONDS, DEBOUNCE_SECONDS = 45, 300, 10, 20, 2
BACKLOG_PRIORITY, NEW_PRIORITY, REINDEX_PRIORITY = 0, 5, 20
KIND_PRIORITY = {"text": 2, "pdf": 1, "office": 0}
LANES = ("doc", "media", "system")
FILE_STATUSES = ("indexed", "queued", "processing", "failed")
LOST_WORKER = "worker stopped while running this job"
INDEX_VERSION = 5

# Settings and what they begin with.
SETTING_DEFAULTS = {"setup_completed": "false", "rescan_interval_seconds": None, "whisper_model": "small", "index_embedding_model": None}
SPEECH_SIZES = ("tiny", "base", "small", "medium")
