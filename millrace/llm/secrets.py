"""Secret scans: fixed patterns, and novelty under dictionary-primed zstandard.

A candidate is a long run of token characters near a sensitive word. Its novelty is what it
adds to the compressed size of the text around it, the compressor being primed with dictionaries of
code and identifiers: names that the dictionaries or the surroundings hold cost few
bytes, random strings cost nearly their length. Words that no dictionary holds cost as much, so a candidate
of letters alone must also change between small and capital letters as no name does.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = re.compile(
    r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "novel"]

# Words that make what follows them sensitive, and the identifiers that prime the compressor.
SENSITIVE = [
    "api", "auth", "bearer", "credential", "key", "passphrase", "passwd", "password", "private", "secret", "signature",
    "token",
]
CODE_NAMES = """
AbstractFactory AccessDenied ArgumentParser AssertionError AttributeError Authentication Authorization BadRequest BaseException
BlockingIOError BrokenPipeError BufferedReader ByteArrayOutputStream CertificateError ConfigParser ConnectionError ConnectionRefusedError
ConnectionResetError ContextManager DataFrame DateTimeFormatter DefaultHandler Deprecated DeprecationWarning EnvironmentError Exception
FileHandler FileNotFoundError Formatter Forbidden GatewayTimeout HTTPConnection HTTPSHandler HashMap HttpServletRequest IllegalArgumentException
ImportError IndexError InputStream Interceptor InternalServerError InterruptedError Iterator JSONDecodeError JSONEncoder KeyError
KeyboardInterrupt LinkedHashMap Listener LoggerAdapter LookupError ManagerFactory MemoryError Middleware ModuleNotFoundError NameError
NotFoundError NotImplementedError NullPointerException ObjectMapper OverflowError PASSWORD_HASHERS PermissionError PreparedStatement
ProcessLookupError Properties Provider RecursionError ReferenceError RepositoryImpl RequestHandler ResponseEntity Runnable RuntimeException
SECRET_KEY SecurityConfiguration SecurityContext Serializable ServiceUnavailable SessionFactory SimpleNamespace StackTraceElement
StringBuilder SubprocessError SyntaxError SystemExit TemporaryDirectory ThreadPoolExecutor TimeoutError TokenProvider TooManyRequests
TransactionManager TypeError UnicodeDecodeError Unauthorized UserDetailsService UserGroupInformation ValueError WebApplicationContext
__init__ abstractmethod acquire addEventListener appendChild application arguments asynchronous attribute authenticate backward_compatible
basename callback certificate checksum classmethod collections component configuration connection constructor container controller
createElement credentials dataclass datetime decorator default_factory delete dependencies description deserialize dictionary directory
document.getElementById encode endpoint environment_variables exception expired expression extension filename finally function generator
getAttribute getLogger getUserName github.com handler hashlib hostname identifier implements import include inheritance initialize
instance interface interval_seconds javascript keyword_arguments lambda library localhost manager maximum message metadata middleware
module namespace notification org/apache/hadoop/security package parameter permission placeholder postgresql production protected
provider public static void readonly reference refresh_interval_seconds repository requests.get response return reset_token schema
serialize service session setTimeout setattr signature src/main/java/com/example src/test/java staticmethod subprocess synchronized
temporary threading timestamp transaction translation undefined update urllib.parse username validator variable version virtual
websocket window.location v1beta1 vnd.api+json 2024-01-01T00:00:00Z 2024_01_01 -----BEGIN PUBLIC KEY-----
"""
IDENTIFIERS = """
access_key access_token accessToken api_key apikey api_secret application/json application/x-www-form-urlencoded
auth_token authorization Authorization: Bearer base64 client_id client_secret config.get("password") connection_string
Content-Type credentials csrf_token current_user database_url DATABASE_PASSWORD encrypted_password environment
export SECRET_KEY= github_token id_rsa_pub jwt_secret localhost:8080 my-secret-token-here os.environ.get("API_KEY")
password_confirmation password_hash placeholder private_key process.env.ACCESS_TOKEN public_key refresh_token
request.headers["Authorization"] secret_key session_token signature_version ssh-rsa string token_type username
your-api-key-here your_access_token_here YOUR_SECRET_KEY_HERE xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 0000000000000000
1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ changeme example.com https://www.example.com/
"""

#: Characters of context before and after a candidate, and how far before and after it the sensitive word may be.
AROUND, REACH, BEHIND = 400, 80, 24
#: Letters alone are a candidate if they change between small and capital letters at least once in so many.
CHANGES = 3.0
#: Added compressed bytes for each byte, from which a candidate is reported; of letters of one case with digits, which need fewer bits, the second.
NOVELTY, NOVELTY_ONE_CASE = 0.8, 0.7
#: Digits and letters that a candidate of both has at least.
LEAST_OF_EACH = 2, 4
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_NEAR = re.compile("(?ai:" + "|".join(SENSITIVE) + ")")
_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())])
)
SPANS = "array<struct<kind:string,start:int,end:int,novelty:double>>"
_packer: zstandard.ZstdCompressor | None = None


def _packed(text: str) -> int:
    global _packer
    if _packer is None:
        # What lies last is nearest for the compressor.
        known = CODE_NAMES + IDENTIFIERS
        words = zstandard.ZstdCompressionDict(known.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=9)
        _packer = zstandard.ZstdCompressor(
            level=9, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False
        )
    return len(_packer.compress(text.encode("utf-8", "replace")))


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes per byte of text[start:end] within its surroundings."""
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    added = _packed(before + text[start:end] + after) - _packed(before + after)
    return added / (end - start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of its kind in KINDS, end) of what the base patterns find."""
    lower = text.lower()
    spans = []
    if "pass" in lower or "secret" in lower or "token" in lower or "key" in lower:
        # A match whose value is too short still takes up its characters.
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _odd(token: str) -> bool:
    """Letters with digits, or letters that change case as names don't. Numbers alone are none, nor are words in capitals or joined by signs."""
    letters = [c for c in token if c.isalpha()]
    if not letters:
        return False
    digits = sum(c.isdigit() for c in token)
    if digits >= LEAST_OF_EACH[0]:
        return len(letters) >= LEAST_OF_EACH[1]
    changes = sum(a.isupper() != b.isupper() for a, b in zip(letters, letters[1:]))
    return changes * CHANGES >= len(letters)


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """Incompressible strings in sensitive context that no base span touches."""
    lower = text.lower()
    if not any(w in lower for w in SENSITIVE):
        return []
    taken: list[list[int]] = []
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    found, k = [], 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        if not _odd(m[0]):
            continue
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        near = _NEAR.search(text, max(0, start - REACH), start) or _NEAR.search(text, end, end + BEHIND)
        least = NOVELTY_ONE_CASE if m[0].lower() == m[0] or m[0].upper() == m[0] else NOVELTY
        if near and (score := novelty(text, start, end)) >= least:
            found.append((start, 3, end, score))
    return found


def spans_of(text: str) -> list[dict]:
    """All spans of a text by start, then kind as listed."""
    base = base_spans(text)
    found = [(s, k, e, None) for s, k, e in base] + novel_spans(text, base)
    return [{"kind": KINDS[k], "start": s, "end": e, "novelty": x} for s, k, e, x in sorted(found, key=lambda f: f[:3])]


def secret_spans(text: Column) -> Column:
    """array<struct<kind, start, end, novelty>>; code points, end exclusive. Null text: empty array."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([spans_of(t.as_py() or "") for t in texts], type=_SPANS)

    return spans(text)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        new = span.start >= state.at
        kept = F.concat(state.out, F.substr(text, state.at + 1, span.start - state.at), F.lit(mark))
        return F.struct(
            F.when(new, kept).otherwise(state.out).alias("out"), F.greatest(state.at, span.end).alias("at")
        )

    done = F.aggregate(spans, first, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done.out, F.substr(text, done.at + 1)))


def scan_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans and all spans as text, for every document.

    Null or empty text has no span. Rows are taken one by one, whole texts however long, so repeated rows
    repeat in the result; extra columns are not read; an empty table gives no rows.
    """
    found = documents.select("doc_id", secret_spans(F.col("text")).alias("found"))

    def shown(spans: Column) -> Column:
        parts = F.transform(
            spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
        )
        return F.array_join(parts, ",")

    count = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(shown(F.filter("found", lambda s: s.kind != "novel")), 256).alias("base_sha256"),
        shown(F.col("found")).alias("spans"),
        count("novel").alias("n_novel"),
    )
