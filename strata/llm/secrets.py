"""Secret scans with structural confirmation.

Three base patterns give spans as they match.  Beyond them, nothing is reported for its
looks: a base64 or hex candidate is decoded, and it is a finding only if what it holds
parses as a secret, with every nested length in agreement:

* ``pem``: an armoured private key whose body parses as one of the next two,
* ``der``: a DER private key (PKCS#1, PKCS#8, encrypted PKCS#8, SEC 1, DSA), in base64 or hex,
* ``openssh``: an OpenSSH private key in base64,
* ``jwt``: a signed token whose header names an algorithm that fits the signature's length
  and whose payload is a JSON object.

Candidates may be wrapped over lines and may begin anywhere in a run of letters; how far one goes
follows from the length that its encoding states, so what stands before and after it does no
harm.  Texts of any length are scanned whole, in time that grows with their length: a candidate is
first held against the few bytes that its kind must begin with.  Null text counts as empty (no spans); rows are independent of each other, so equal rows, null ids and
extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 24 or more is a match of one or more that is long enough: runs are matched whole.
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
LEAST_VALUE, LEAST_ACCESS = 6, 20

MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*+)-----")
#: Where a key can begin: a DER sequence of 16 bytes or more, OpenSSH's magic, armour encoded once more.
BASE64 = re.compile(r"M[B-I](?=[A-Za-z0-9+/_-]{14})|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi")
HEX_HEAD = re.compile(r"(?=(30(?:[1-7][0-9a-f]|81[0-9a-f]{2}|82[0-9a-f]{4})(?:02010[01]|30)|6f70656e7373682d6b65792d763100|2d2d2d2d2d424547494e20))", re.I)
IN_BASE64, IN_HEX = re.compile(r"[A-Za-z0-9+/_-]++"), re.compile(r"[0-9A-Fa-f]++")
BREAK = re.compile(r"[\x20\t]*+\r?\n[\x20\t]*+")
#: Three parts of a token; its header is a JSON object, so it begins with a brace and white space or a quote.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+))")
HEADER = re.compile(r"(?=e(?:y[A-DI-L]|w[0-3k-r]))")
OBJECT = re.compile(rb'\{\s*"[^"\\\x00-\x1f\x80-\xff]*+(?:"\s*(?::|\Z)|\Z)')
MOST_HEADER, MOST_KEY = 1 << 14, 1 << 15  # characters of a token's header, bytes of a key
#: What a text with any finding must contain; all patterns above need one of these.
TRACE = r"(?i:password|passwd|secret|token|api_?key|[0-9a-f]{24})|AKIA|-----BEGIN|M[B-I][A-Za-z0-9+/_-]{14}|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi|e(?:y[A-DI-L]|w[0-3k-r])[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\."
#: Bytes of the signature (or hash) for each signing algorithm; 0: any length over 127.
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "RS256": 0, "RS384": 0, "RS512": 0, "PS256": 0, "PS384": 0, "PS512": 0}


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Tag, first and last place of the contents of the DER value at ``at``."""
    if at + 2 > end:
        raise ValueError
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            raise ValueError
        n = int.from_bytes(data[at : at + k], "big")
        if n < 128:
            raise ValueError
        at += k
    if at + n > end:
        raise ValueError
    return tag, at, at + n


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while at < end:
        out.append(_tlv(data, at, end))
        at = out[-1][2]
    return out


def der_size(data: bytes) -> int:
    """Bytes that a DER sequence says it takes, from its first bytes; 0 if it is none."""
    if len(data) < 6 or data[0] != 0x30:
        return 0
    n = data[1]
    if n < 128:
        return 2 + n
    k = n & 0x7F
    return 2 + k + int.from_bytes(data[2 : 2 + k], "big") if k in (1, 2, 3) else 0


def is_private_der(data: bytes) -> bool:
    """Whether ``data`` is, whole and with all nested lengths right, a private key."""
    try:
        tag, a, b = _tlv(data, 0, len(data))
        if tag != 0x30 or b != len(data):
            return False
        parts = _children(data, a, b)
        tags = [t for t, _, _ in parts]
        if tags[:2] == [0x30, 0x04] and len(parts) == 2:  # encrypted PKCS#8
            inner = _children(data, *parts[0][1:])
            return [t for t, _, _ in inner] == [0x06, 0x30] and (parts[1][2] - parts[1][1]) % 8 == 0
        if not tags or tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1:
            return False
        version = data[parts[0][1]]
        if tags[1:3] == [0x30, 0x04]:  # PKCS#8
            inner = _children(data, *parts[1][1:])
            octets = data[parts[2][1] : parts[2][2]]
            return version in (0, 1) and bool(inner) and inner[0][0] == 0x06 and set(tags[3:]) <= {0xA0, 0x81, 0xA1} and len(octets) >= 32
        if tags[1:2] == [0x04]:  # SEC 1
            return version == 1 and parts[1][2] - parts[1][1] in (28, 32, 48, 66) and set(tags[2:]) <= {0xA0, 0xA1}
        if set(tags) == {0x02} and len(parts) == 9:  # PKCS#1: the modulus is twice as long as each prime
            size = [e - s for _, s, e in parts]
            return version == 0 and size[1] >= 64 and abs(size[4] + size[5] - size[1]) <= 2
        return set(tags) == {0x02} and len(parts) == 6 and version == 0  # DSA
    except (ValueError, IndexError):
        return False


OPENSSH = b"openssh-key-v1\0"


def openssh_size(data: bytes) -> int:
    """Bytes of the OpenSSH private key that ``data`` begins with, from its nested lengths; 0 if none, -1 if
    ``data`` ends before that can be told."""
    if not data.startswith(OPENSSH):
        return 0
    at = len(OPENSSH)

    def block(most: int) -> bytes:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if n > most:
            raise ValueError
        if at + 4 + n > len(data):
            raise EOFError
        at += 4 + n
        return data[at - n : at]

    try:
        cipher, kdf, options = block(64), block(64), block(1 << 10)
        keys = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if not 1 <= keys <= 16 or not cipher or not kdf or (kdf == b"none") != (options == b""):
            return 0
        for _ in range(keys):
            public = block(MOST_KEY)
            n = int.from_bytes(public[:4], "big")
            if not 3 <= n <= len(public) - 4:
                return 0
        secret = block(MOST_KEY)
        plain = cipher == b"none"
        if len(secret) < 16 or len(secret) % 8 or plain and secret[:4] != secret[4:8]:
            return 0
        return at
    except ValueError:
        return 0
    except EOFError:
        return -1


def _unbase64(s: str) -> bytes:
    s = s.translate({45: 43, 95: 47})
    return base64.b64decode(s[: len(s) // 4 * 4] + (s[len(s) // 4 * 4 :] + "==")[: 4 if len(s) % 4 > 1 else 0])


def _taken(text: str, at: int, n: int, run: re.Pattern) -> tuple[str, int]:
    """Up to n characters that ``run`` matches from ``at`` on, over line breaks, and where they end."""
    out, end = [], at
    while n and (m := run.match(text, at, at + n)):
        out.append(m.group())
        n -= m.end() - at
        at = end = m.end()
        if n and (w := BREAK.match(text, at)):
            at = w.end()
    return "".join(out), end


def _private(data: bytes) -> str:
    if (n := der_size(data)) and n <= len(data) and is_private_der(data[:n]):
        return "der"
    return "openssh" if openssh_size(data) > 0 else ""


def _armours(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and body of armoured private keys: each end mark with the begin mark just before it."""
    begun = None
    for m in MARK.finditer(text):
        if m[1] == "END" and begun and begun[2] == m[2]:
            yield begun.start(), m.end(), text[begun.end() : m.start()]
        begun = m if m[1] == "BEGIN" and f" {m[2]}".endswith(" PRIVATE KEY") else None


def _decoded_at(text: str, start: int, letters: int, size: int, run: re.Pattern, decode: Callable[[str], bytes]) -> tuple[str, int] | None:
    """Kind and end of the key whose encoding begins at ``start``: ``letters`` of it stand for ``size`` bytes."""

    def taken(n: int) -> tuple[bytes, int]:
        got, end = _taken(text, start, -(-n * letters // size), run)
        return decode(got), end

    head, _ = taken(48)
    if n := der_size(head):
        inner = head[2 + (head[1] & 0x7F if head[1] & 0x80 else 0) :]
        if 16 <= n <= MOST_KEY and inner.startswith((b"\x02\x01\x00", b"\x02\x01\x01", b"\x30")):
            data, end = taken(n)
            if len(data) >= n and is_private_der(data[:n]):
                return "der", end
    elif head.startswith(OPENSSH):
        for most in (1 << 8, 1 << 12, 4 * MOST_KEY):
            n = openssh_size(taken(most)[0])
            if n >= 0:
                return ("openssh", taken(n)[1]) if n else None
    elif head.startswith(b"-----BEGIN "):  # armour encoded once more
        inner = next(_armours(taken(4 * MOST_KEY)[0].decode("latin-1")), None)
        if inner and inner[0] == 0 and _armoured(inner[2]):
            return "pem", taken(inner[1])[1]
    return None


def _armoured(body: str) -> bool:
    lines = [x for x in re.split(r"\r?\n|\\n", body) if ":" not in x]  # without RFC 1421 headers
    letters = re.sub(r"[\s=]", "", "".join(lines))
    if "ENCRYPTED" in body and "DEK-Info" in body:
        return bool(re.fullmatch(r"[A-Za-z0-9+/]{64,}", letters))
    try:
        return bool(re.fullmatch(r"[A-Za-z0-9+/]+", letters)) and bool(_private(_unbase64(letters)))
    except (ValueError, binascii.Error):
        return False


def _header_at(head: str, body: str, signature: str) -> int:
    """Where in ``head`` the header of a signed token with this body and signature begins; -1 if nowhere."""
    try:
        if body[0] != "e" or not isinstance(json.loads(_unbase64(body)), dict):
            return -1
    except (ValueError, binascii.Error, RecursionError):
        return -1
    n = len(signature) * 3 // 4
    for m in HEADER.finditer(head, max(0, len(head) - MOST_HEADER)):
        try:
            if not OBJECT.match(_unbase64(head[m.start() : m.start() + 96])):
                continue
            fields = json.loads(_unbase64(head[m.start() :]))
            size = SIGNATURES.get(fields.get("alg"))
        except (ValueError, binascii.Error, RecursionError, TypeError, AttributeError):
            continue
        if size is not None and (n == size if size else n > 127):
            return m.start()
    return -1


def _unhex(s: str) -> bytes:
    return bytes.fromhex(s[: len(s) // 2 * 2])


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base patterns."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int, int]]:
    """The same of what decoding and parsing confirms."""
    out = [(a, 3, b, a) for a, b, body in _armours(text) if _armoured(body)]
    armoured = [(a, b) for a, _, b, _ in out]
    for heads, letters, size, run, decode in ((BASE64, 4, 3, IN_BASE64, _unbase64), (HEX_HEAD, 2, 1, IN_HEX, _unhex)):
        upto, k = 0, 0
        for m in heads.finditer(text):
            while k < len(armoured) and armoured[k][1] <= m.start():
                k += 1
            if m.start() < upto or k < len(armoured) and armoured[k][0] <= m.start():
                continue
            try:
                got = _decoded_at(text, m.start(), letters, size, run, decode)
            except (ValueError, binascii.Error):
                continue
            if got:
                kind, upto = got
                while letters == 4 and text.startswith("=", upto):
                    upto += 1
                out.append((m.start(), KINDS.index(kind), upto, m.start()))
    for m in TOKEN.finditer(text):
        if (at := _header_at(*m.groups())) >= 0:
            at += m.start()
            out.append((at, 6, m.end(3), at))
    return sorted(out)


def _joined(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def _suspects(texts: pa.Array) -> list[str | None]:
    """Texts with a trace of anything, by a linear automaton over the column; None for the others."""
    mask = pc.match_substring_regex(texts, TRACE).fill_null(False)
    return pc.if_else(mask, texts, None).to_pylist()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end; code points, end exclusive) and base (how many of each base kind
    and the hash of the base spans) of every row."""

    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in _suspects(batch.column(1)):
                if t is None:
                    rows.append((0, 0, 0, none, ""))
                    continue
                base = base_spans(t)
                kinds = [k for _, k, _, _ in base]
                rows.append((*map(kinds.count, range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + confirmed_spans(t)))))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with each secret replaced; of an assignment, the value."""
    out, at = [], 0
    for a, b in sorted((v, b) for _, _, b, v in base_spans(text) + confirmed_spans(text)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in their texts replaced; n_chars, where there is one, follows the text."""
    cols, schema = docs.columns, docs.schema
    at, n_at = cols.index("text"), cols.index("n_chars") if "n_chars" in cols else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            changed = {}
            for i, t in enumerate(_suspects(batch.column(at))):
                if t is not None and (new := redacted(t)) != t:
                    texts[i] = changed[i] = new
            out = list(batch.columns)
            if changed:
                out[at] = pa.array(texts, out[at].type)
                if n_at is not None:
                    out[n_at] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(out[n_at].to_pylist())], out[n_at].type)
            yield pa.RecordBatch.from_arrays(out, cols)

    return docs.mapInArrow(run, schema)


def op1_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scratch.documents(spark, sf_dir))
