"""Fixed values.

Results have to carry exactly these patterns, sizes, messages and templates, so
they are stated here as plain text and nowhere else.
"""

# Patterns ---------------------------------------------------------------------
HTML_TAG = r"<[^>]+>"
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
# The 29 code points that Unicode-aware whitespace matching covers. The JVM's own
# \s matches six of them.
WHITESPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WHITESPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Files and events -------------------------------------------------------------
SCAN_GLOB = "*.tif"
OCR_EXTENSIONS = ("png", "jpg", "jpeg", "pdf")
DEFAULT_BUCKET = "documents"
STATUS_UPLOADED = "UPLOADED"
STATUS_PENDING_OCR = "PENDING_OCR"
STATUS_PENDING = "Pending"
DEFAULT_UPLOADER = "Guest"
DEFAULT_SESSION = "default"
DEFAULT_PROVIDER = "local"
UPLOADED_TOPIC = "document-uploaded"
EXTRACTED_TOPIC = "text-extracted"
LOG_INDEX_PREFIX = "document-system-logs-"
ERROR_PREFIX = "ERROR: "

# Sizes ------------------------------------------------------------------------
CHUNK_SIZE = 800
CHUNK_OVERLAP = 120
CHUNK_MINIMUM = 60
PLAIN_CHUNK_SIZE = 512
PLAIN_CHUNK_OVERLAP = 50
FILENAME_LIMIT = 255
TEXT_LIMIT = 65535
PREVIEW_LIMIT = 300
CONTEXT_LIMIT = 3000
SHORT_ID_LENGTH = 8
NLIST = 128
NPROBE = 10
TOP_K = 5
EMBED_BATCH = 32
HISTORY_MESSAGES = 24

# Roles and intents ------------------------------------------------------------
ROLES = ("user", "assistant")
COUNT_KEYWORDS = ("thống kê", "bao nhiêu")
STATUS_KEYWORDS = ("trạng thái",)

# Messages ---------------------------------------------------------------------
EMPTY_QUESTION = "No message provided"
COUNT_SENTENCE = "Hiện tại hệ thống đã nạp được %s tài liệu vào kho lưu trữ."
STATUS_SENTENCE = "Trạng thái hệ thống: "
BLANK_ANSWER = "Mình chưa tìm được câu trả lời rõ ràng từ dữ liệu."
BASIC_MODE = "Mình chưa truy xuất được RAG cục bộ, hiện đang trả lời ở chế độ cơ bản."
NO_CONTEXT = "Không tìm thấy ngữ cảnh phù hợp từ Milvus cho câu hỏi này."
RETRIEVE_ONLY = "Discovery Mode: Tìm thấy %d đoạn trích liên quan từ tài liệu của bạn."
RETRIEVAL_FAILED = "[Error] Milvus retrieval failed: "
MISSING_KEY = "[Error] Gemini API Key is missing. Please provide it in settings."
NO_MODEL_ANSWER = "Không có câu trả lời từ AI."
GENERATION_FAILED = "[Error] {provider} LLM inference failed: {error}"
ENGINE_FAILED = "[Error] AI Engine communication failed: "
NO_REPLY = "No response"

# Templates --------------------------------------------------------------------
PROMPT_VI = (
    "Bạn là trợ lý AI cho kho tài liệu. "
    "Chỉ trả lời dựa trên CONTEXT đã cho. "
    "Nếu thiếu dữ liệu trong CONTEXT thì nói rõ là không đủ thông tin từ tài liệu.\n\n"
    "CONTEXT:\n{context}\n\n"
    "QUESTION: {question}\n\n"
    "ANSWER (in Vietnamese):"
)
PROMPT_EN = (
    "\nYou are an AI assistant for a large document repository. \n"
    "Answer the following question based ONLY on the provided context.\n"
    'If you don\'t know the answer, say "I don\'t have enough information from the documents."\n'
    "\nCONTEXT:\n{context}\n"
    "\nQUESTION: {question}\n"
    "\nANSWER:\n"
)
