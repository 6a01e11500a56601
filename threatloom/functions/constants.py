"""Values that must be exactly these for results to be right.

Everything in this module is a fixed value: word lists, patterns, weights,
lookup tables and limits that define the scoring rules.  No logic lives here.
"""

# --- fixed values: spam layer -------------------------------------------------

SPAM_KEYWORD_GROUPS = [
    r"\b(?:viagra|cialis|pharmacy|pills)\b",
    r"\b(?:winner|congratulations|prize|lottery)\b",
    r"\b(?:urgent|immediate|action required|act now)\b",
    r"\b(?:click here|click now|limited time)\b",
    r"\b(?:free money|make money|earn cash)\b",
    r"\b(?:nigerian prince|inheritance|beneficiary)\b",
    r"\b(?:enlarge|enhancement|weight loss)\b",
    r"\b(?:casino|poker|gambling)\b",
]

URL_PATTERN = r'https?://[^\s<>"]+'
MONEY_PATTERN = r"\$\d+|\d+\s*(dollar|usd|euro)"
HIDDEN_TEXT_PATTERN = r"font-size:\s*[0-2]px|color:\s*#fff.{0,100}background.{0,100}#fff"
ADDRESS_PATTERN = r"[\w\.-]+@[\w\.-]+"
ADDRESS_DOMAIN_PATTERN = r"[\w\.-]+@([\w\.-]+)"

SUSPICIOUS_HOST_PATTERNS = [
    r"bit\.ly",
    r"tinyurl",
    r"t\.co",
    r"goo\.gl",
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    r"[a-z0-9\-]{30,}",
]

FREEMAIL_DOMAINS = [
    "gmail.com",
    "yahoo.com",
    "hotmail.com",
    "outlook.com",
    "aol.com",
    "mail.com",
    "protonmail.com",
]

CORPORATE_TITLES = ["ceo", "president", "director", "manager"]

REQUIRED_HEADERS = ["From", "To", "Date", "Message-ID"]

SHORT_BODY_CHARS = 50
EXCESSIVE_LINKS = 10
EXCESSIVE_HOPS = 10

# --- fixed values: language layer ---------------------------------------------
# (pattern, description); one ordered scan over all four lists.

SOCIAL_PATTERNS = [
    (
        r"\b(verify|confirm|update|validate)\s+(your\s+)?(account|password|information|details|credentials)\b",
        "Account verification request",
    ),
    (r"\b(suspended|locked|disabled|restricted|blocked)\s+(account|access)\b", "Account suspension threat"),
    (
        r"\b(unusual|suspicious|unauthorized)\s+(activity|login|access|transaction)\b",
        "Suspicious activity claim",
    ),
    (r"\b(security\s+)(alert|warning|notice|breach|threat)\b", "Security alert"),
    (r"\b(reset|change|update)\s+your\s+password\b", "Password reset request"),
]

URGENCY_PATTERNS = [
    (r"\b(urgent|immediate|asap|emergency|critical|time[-\s]sensitive)\b", "Urgency keyword"),
    (r"\b(within\s+\d+\s+(hours?|minutes?|days?))\b", "Time pressure"),
    (r"\b(expire[sd]?|expiring|expiration)\b", "Expiration warning"),
    (r"\b(act\s+now|respond\s+immediately|don\'t\s+delay)\b", "Action pressure"),
    (r"\b(limited\s+time|last\s+chance|final\s+(warning|notice))\b", "Scarcity tactic"),
]

AUTHORITY_PATTERNS = [
    (r"\b(bank|paypal|amazon|microsoft|apple|google|irs|fbi|police)\b", "Authority entity mention"),
    (r"\b(ceo|president|director|manager|supervisor|administrator)\b", "Authority title"),
    (r"\b(official|authorized|legitimate|certified)\b", "Authority claim"),
    (r"\b(government|federal|national|department of)\b", "Government entity"),
    (r"\b(court|legal|lawsuit|subpoena|warrant)\b", "Legal threat"),
]

PSYCHOLOGICAL_PATTERNS = [
    (r"\b(free|bonus|gift|reward|prize|win|won|winner)\b", "Reward temptation"),
    (r"\b(fear|worry|concern|risk|danger|threat)\b", "Fear appeal"),
    (r"\b(opportunity|exclusive|special|limited)\b", "Exclusivity appeal"),
    (r"\b(guarantee|certified|approved|verified)\b", "Trust signal"),
    (r"\b(secret|confidential|private|insider)\b", "Secrecy appeal"),
]

CAPS_WORD_PATTERN = r"\b[A-Z]{4,}\b"
SENDER_DOMAIN_PATTERN = r"@([\w\.-]+)"

# --- fixed values: attachment layer -------------------------------------------

DANGEROUS_EXTENSIONS = [
    "exe", "bat", "cmd", "com", "pif", "scr", "vbs", "js", "jar", "msi", "dll",
    "hta", "wsf", "ps1", "sh", "bash", "app", "php", "php3", "php4", "php5",
    "phtml", "pl", "py", "rb", "asp", "aspx", "jsp", "jspx", "cgi", "vbe", "jse",
    "wsh", "scf", "lnk", "inf", "reg", "iso", "img", "vhd", "vhdx",
]

SUSPICIOUS_SUFFIXES = [
    "pdf.exe", "doc.exe", "jpg.exe", "zip.exe", "docm", "xlsm", "pptm", "dotm",
    "html", "htm", "svg",
]

MEDIA_EXTENSIONS = [
    "mp4", "avi", "mov", "wmv", "flv", "mkv", "mp3", "wav", "aac", "flac", "ogg",
    "m4a",
]

SMALL_VIDEO_EXTENSIONS = ["mp4", "avi", "mov"]

ARCHIVE_EXTENSIONS = ["zip", "rar", "7z", "tar", "gz", "iso", "img", "vhd", "vhdx"]
LISTABLE_NESTED_EXTENSIONS = ["zip", "tar", "tgz", "gz"]

# hexadecimal prefix at byte 0 -> type, first match wins
MAGIC_PREFIXES = [
    ("25504446", "pdf"),
    ("504B0304", "zip"),
    ("FFD8FF", "jpeg"),
    ("89504E47", "png"),
    ("47494638", "gif"),
    ("4D5A", "exe"),
    ("D0CF11E0", "doc"),
    ("1A45DFA3", "mkv"),
    ("494433", "mp3"),
    ("FFFB", "mp3"),
    ("FFF3", "mp3"),
    ("FFF2", "mp3"),
    ("3026B2758E66CF11", "wmv"),
    ("464C56", "flv"),
    ("4F676753", "ogg"),
    ("664C6143", "flac"),
]
RIFF_HEX = "52494646"
RIFF_FORMS = [("41564920", "avi"), ("57415645", "wav"), ("57454250", "webp")]
FTYP_HEX = "66747970"

EXPECTED_EXTENSIONS = {
    "pdf": ["pdf"],
    "zip": ["zip", "docx", "xlsx", "pptx", "jar"],
    "jpeg": ["jpg", "jpeg"],
    "png": ["png"],
    "gif": ["gif"],
    "doc": ["doc", "xls", "ppt", "msi"],
    "exe": ["exe"],
    "mp4": ["mp4", "mov", "m4a", "3gp"],
    "avi": ["avi"],
    "wav": ["wav"],
    "mp3": ["mp3"],
    "mkv": ["mkv", "webm"],
    "webp": ["webp"],
    "wmv": ["wmv"],
    "flv": ["flv"],
    "ogg": ["ogg", "oga", "ogv", "ogx"],
    "flac": ["flac"],
}

STRICT_SIGNATURES = [
    ("exe", "executable"),
    ("dll", "executable"),
    ("zip", "archive"),
    ("pdf", "PDF"),
    ("png", "PNG image"),
    ("jpg", "JPEG image"),
    ("jpeg", "JPEG image"),
    ("gif", "GIF image"),
    ("mp4", "MP4 video"),
    ("avi", "AVI video"),
    ("mkv", "MKV video"),
    ("wav", "WAV audio"),
    ("mov", "QuickTime video"),
    ("wmv", "WMV video"),
    ("flv", "FLV video"),
    ("ogg", "Ogg audio/video"),
    ("flac", "FLAC audio"),
    ("m4a", "M4A audio"),
]

MIB = 1024 * 1024
LARGE_ATTACHMENT_BYTES = 25 * MIB
TINY_MEDIA_BYTES = 1024
SMALL_VIDEO_BYTES = 100 * 1024
MAX_ARCHIVE_MEMBERS = 1000
MAX_NESTED_BYTES = 10 * MIB
MAX_ARCHIVE_DEPTH = 2
STOP_SCORE = 5.0

# --- fixed values: shaping limits ---------------------------------------------

MAX_SUBJECT_CHARS = 1024
MAX_MIME_PARTS = 100
MESSAGE_OVERHEAD_BYTES = 5 * MIB
UNLIMITED_MESSAGE_BYTES = 500 * MIB
UNNAMED_FILE = "unnamed_attachment"
RESERVED_FILE_NAMES = [
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
]

# content type -> extension for generated file names; anything else is ".bin"
TYPE_EXTENSIONS = {
    "text/plain": ".txt",
    "text/html": ".html",
    "text/csv": ".csv",
    "application/pdf": ".pdf",
    "application/zip": ".zip",
    "application/json": ".json",
    "application/msword": ".doc",
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/gif": ".gif",
    "video/mp4": ".mp4",
    "audio/mpeg": ".mp3",
}

# --- fixed values: report text ------------------------------------------------

REC_SPAM = "⚠️ HIGH RISK: Move to spam folder immediately"
REC_PHISHING = "\U0001f3a3 Potential phishing: Do not click links or provide credentials"
REC_ATTACHMENT = "\U0001f4ce Dangerous attachment detected: Do not open attachments"
REC_URLS = "\U0001f517 Suspicious URLs detected: Verify links before clicking"
REC_AUTHORITY = "\U0001f464 Authority impersonation suspected: Verify sender identity"
REC_URGENCY = "⏰ Urgency tactics detected: Take time to verify before acting"
REC_CLEAN = "✅ No issues detected"
REC_PREFIXES = ["⚠️ ", "\U0001f3a3 ", "\U0001f517 ", "⏰ ", "\U0001f4ce ", "\U0001f464 "]
REC_RED_PATTERN = "HIGH RISK|DANGEROUS|PHISHING"
REC_YELLOW_PATTERN = "SUSPICIOUS|VERIFY|URGENCY|IMPERSONATION"

RISK_COLORS = {"low": "#36a64f", "medium": "#ff9900", "high": "#ff0000"}
OTHER_COLOR = "#808080"
RISK_SYMBOLS = {"high": "\U0001f534", "medium": "\U0001f7e1", "low": "\U0001f7e2"}
OTHER_SYMBOL = "⚪"

# --- fixed values: redaction --------------------------------------------------

REDACTED = "[REDACTED]"
REDACTED_ENCODED = "%5BREDACTED%5D"
SENSITIVE_URL_KEYS = [
    "password", "token", "secret", "key", "apikey", "api_key", "access_token",
    "auth", "authorization", "sig", "signature",
]
SENSITIVE_FIELD_PARTS = [
    "password", "token", "api_key", "secret", "credential", "app_password",
    "webhook_url", "slack_webhook",
]
TEXT_URL_PATTERN = r'(?:https?://[^\s<>"]+|www\.[^\s<>"]+|/[^\s<>"]+)'
ANSI_PATTERN = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-zA-Z]{2,}$"
MAX_EMAIL_CHARS = 254

# patterns that contain one of these literal texts may backtrack without bound
BACKTRACKING_FORMS = [r"(\w+)*", r"(\d+)+", r"(\s+)*", r"(a+)+", r"([a-zA-Z]+)*"]
