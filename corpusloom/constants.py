"""Fixed values shared by the operators.

Each of these must keep its exact value for results to stay comparable, so they are
written out plainly and kept together.
"""

# Fixed value: the characters removed by a Unicode-aware strip, as a regex class body.
WS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Fixed value: the same class without the line feed.
WS_INLINE = (
    r"\t\x0b-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Fixed value: characters that end a line in a Unicode-aware line split.
LINE_BREAKS = r"\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}"

# Fixed value: the strip characters themselves, for the built-in trim functions.
WS_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
# The same set as Java regex class bodies that compile to fast matchers.
WS_JAVA = r"\s\x1c-\x1f"
WS_JAVA_INLINE = r"\s\x1c-\x1f&&[^\n]"

# Truncation markers.
ELLIPSIS = "…"
LOG_TRUNCATION_SUFFIX = "...<truncated>"

# Chunking defaults and separator priority.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
CHUNK_SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
UNIT_SEPARATOR_LENGTH = 2

# Context packing limits.
TOTAL_CONTEXT_CHARS = 24_000
CHUNK_CONTEXT_CHARS = 6_000
EXCERPT_CHARS = 500
CHUNKS_PER_DOCUMENT = 3

# Request limits.
MAX_TOP_K = 20
MAX_REFERENCE_FILES = 20
MAX_QUERY_CHARS = 4096
EMBEDDING_BATCH = 32

# Generation budget per request.
MAX_CALLS = 21
MAX_INPUT_TOKENS = 400_000
MAX_OUTPUT_TOKENS = 64_000

# Fixed value: the answer text that means "not enough evidence".
INSUFFICIENT_ANSWER = "제공된 문서 근거만으로는 답변할 수 없습니다."

# Query wordings that ask for a synthesis over several documents.
SYNTHESIS_PATTERNS = (
    r"(?:비교|대조|차이점?|공통점|유사점|상충|모순)",
    r"(?:종합|통합|취합|한데\s*모아)",
    r"(?:문서|pdf|docx|pptx|xlsx|txt|파일)\s*별",
    r"각(?:각의)?\s*(?:문서|pdf|docx|pptx|xlsx|txt|파일)",
    r"(?:모든|전체|여러|복수의?|두|세)\s*(?:참조\s*)?(?:문서|pdf|docx|pptx|xlsx|txt|파일).*(?:요약|정리|분석)",
    r"(?:요약|정리|분석).*(?:모든|전체|여러|복수의?|각(?:각의)?|두|세)\s*(?:참조\s*)?(?:문서|pdf|docx|pptx|xlsx|txt|파일)",
    r"\b(?:compare|contrast|differences?|similarities?|synthesize|synthesis|aggregate|consolidate)\b",
    r"\b(?:all|multiple|each|two|three)\b.*\b(?:documents?|pdfs?|docx|pptx|xlsx|txt|files?)\b.*\b(?:summari[sz]e|summary|analy[sz]e|analysis)\b",
    r"\b(?:summari[sz]e|summary|analy[sz]e|analysis)\b.*\b(?:all|multiple|each|two|three)\b.*\b(?:documents?|pdfs?|docx|pptx|xlsx|txt|files?)\b",
)

# The stage events kept from a service log.
STAGE_EVENTS = (
    "file_download_completed",
    "document_parsing_ocr_completed",
    "document_chunking_completed",
    "document_embedding_completed",
    "file_indexing_completed",
    "file_processing_completed",
)

# Log markers, with the failure category and condition each one means.
LOG_MARKERS = (
    ("cuda out of memory", "oom", "cuda_oom"),
    ("outofmemoryerror", "oom", "process_oom"),
    ("memoryerror", "oom", "python_memory_error"),
    ("timed out", "timeout", "target_timeout"),
    ("connection refused", "external_service", "connection_refused"),
)

# Tokens that classify a failed request, tried in this order.
FAILURE_TOKENS = (
    ("timeout", "request_timeout", ("timeout", "timed out")),
    ("oom", "oom", ("out of memory", "outofmemory", "memoryerror", "cuda oom")),
    (
        "external_service",
        "external_service_failure",
        ("connecterror", "connection refused", "remoteprotocolerror", "service unavailable"),
    ),
)

# Media types.
GENERIC_MEDIA_TYPES = ("application/octet-stream", "binary/octet-stream")
PDF_MEDIA_TYPES = ("application/pdf", "application/x-pdf")
OOXML_MEDIA_TYPES = (
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
)
TEXT_MEDIA_TYPES = ("text/plain", "application/text")

# Byte prefixes that mark a file as binary, as hex.
BINARY_PREFIXES_HEX = (
    "255044462D",
    "504B0304",
    "504B0506",
    "89504E470D0A1A0A",
    "FFD8FF",
    "474946383761",
    "474946383961",
    "7F454C46",
    "4D5A",
)
# Byte order marks as hex, in detection order.
BYTE_ORDER_MARKS_HEX = (
    ("FFFE0000", "utf-32"),
    ("0000FEFF", "utf-32"),
    ("EFBBBF", "utf-8-sig"),
    ("FFFE", "utf-16"),
    ("FEFF", "utf-16"),
)
CONTROL_RATIO_LIMIT = 0.05

# Size units.
BYTES_BY_UNIT = {
    "B": 1,
    "KB": 10**3,
    "MB": 10**6,
    "GB": 10**9,
    "TB": 10**12,
    "KIB": 2**10,
    "MIB": 2**20,
    "GIB": 2**30,
    "TIB": 2**40,
}
