"""Tunables and fixed values.

Every operator takes these as keyword arguments; the defaults below are the
service's documented settings.
"""

# --- fixed values (must equal the service's settings for equal results) ---
CONFIDENCE_THRESHOLD = 0.65
CACHE_SIM_THRESHOLD = 0.92
CACHE_TTL_SECONDS = 3600
SESSION_TTL_SECONDS = 1800
SESSION_MAX_TURNS = 10
TOP_K = 5
BM25_WEIGHT = 0.4
VECTOR_WEIGHT = 0.6
DOMAINS = ("billing", "returns", "escalation")
CHUNK_SIZE = 512
CHUNK_OVERLAP = 64
CONFIDENCE_WEIGHTS = (0.3, 0.4, 0.3)  # router, retrieval, llm self-rating
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
TFIDF_MAX_FEATURES = 512
MAX_UPLOAD_BYTES = 5 * 1024 * 1024
ALLOWED_DOC_EXTENSIONS = (".txt", ".md")
AUDIT_READ_LIMIT = 100
KPI_DAYS = 7
KPI_PER_DAY = 500
KPI_SAMPLE = 50
OPTIMIZER_TAIL = 200
OPTIMIZER_SAMPLES = 20
EVAL_MIN_CONFIDENCE = 0.60
EVAL_MAX_LATENCY_MS = 8000
SESSION_ID_MAX = 128
QUERY_MAX = 2000
LLM_FAILURE_TEXT = "I'm unable to process your request at the moment. Please try again."
