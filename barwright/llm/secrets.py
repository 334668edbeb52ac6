"""Secret scans with structural confirmation.

Patterns give the base findings. Beyond them, base64 and hex candidates are decoded and their contents parsed: private keys in DER (nested lengths), OpenSSH keys (length-prefixed fields), PEM blocks around either, base64 of such blocks, and the header of a signed token. A key's own lengths say where it ends. Only what parses is reported.

A null text is an empty one and has no findings. Rows are independent, so repeated rows repeat their findings, and an empty table gives no rows. Findings with the same start stand in the order of their kinds; columns other than the id and the text take no part. Texts are scanned whole, in time in proportion to their length."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barwright.llm.common import per_batch, table, texts_of

#: Kinds in the order in which findings with the same start stand.
KINDS = ("assign", "access", "hex", "pem", "token", "der", "openssh")
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
PEM_EDGE = re.compile(r"-----(BEGIN|END) ([A-Z ]*PRIVATE KEY)-----")
#: Line ends of a PEM body as they are and as JSON escapes them; header lines, then base64 signs.
PEM_END = re.compile(r"\\r\\n|\\n|\\r|\r\n|\r|\n")
PEM_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:[^\r\n]*")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s]+")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+){2,}")
#: Where a key in base64 may begin: the sign of a DER sequence, or OpenSSH's name; and a base64 text that may hold PEM lines.
BASE64_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-Za-z0-9+/_-]{39,}|b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/_-]{40,})")
BASE64_TEXT = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{60,}")
#: Base64 goes on over line ends (as they are, or as JSON escapes them) and through indentation.
SIGNS = re.compile(r"[A-Za-z0-9+/_-]+")
LINE = re.compile(r"[ \t]*(?:\r\n|\r|\n|\\r\\n|\\n)[ \t]*")
PADDING = re.compile(r"={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30[0-9A-Fa-f]{58,}|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]7631[0-9A-Fa-f]{60,})")
OPENSSH = b"openssh-key-v1\x00"


def decoded(text: str) -> bytes | None:
    """Base64 in either alphabet, with or without padding."""
    body = text.rstrip("=").translate({45: "+", 95: "/"})
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of each value in data[start:end], if their lengths fill it."""
    out, at = [], start
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n == 0x80:
            return None
        if n > 0x80:
            size = n & 0x7F
            if size > 4 or at + size > end:
                return None
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def is_private_der(data: bytes) -> bool:
    """A private key of PKCS#1, PKCS#8, SEC 1 or DSA, by the tags and lengths of its fields."""
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(data, *outer[0][1:])
    if not items or len(items) < 2 or items[0][0] != 0x02 or items[0][2] - items[0][1] != 1 or data[items[0][1]] > 1:
        return False
    tags = [t for t, _, _ in items]
    if tags[1] == 0x30 and len(tags) > 2 and tags[2] == 0x04:  # PKCS#8: an algorithm, then the wrapped key
        inner = der_items(data, *items[1][1:])
        return bool(inner) and inner[0][0] == 0x06
    if tags[1] == 0x04:  # SEC 1
        return items[1][2] - items[1][1] >= 16
    return (len(tags) >= 9 or len(tags) == 6) and all(t == 0x02 for t in tags[:6])


def is_openssh(data: bytes) -> bool:
    """Cipher, derivation and its options, the number of keys, then that many public keys and the private part, each with its length."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    cipher, kdf, options = field(), field(), field()
    if not cipher or not kdf or options is None or not cipher.isascii():
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= keys <= 64 and all(field() for _ in range(keys + 1)) and at <= len(data)


def is_encrypted_der(data: bytes | None) -> bool:
    """PKCS#8's encrypted form: an algorithm, then the cipher text, which fill the whole."""
    outer = der_items(data, 0, len(data)) if data else None
    items = der_items(data, *outer[0][1:]) if outer and len(outer) == 1 and outer[0][0] == 0x30 else None
    if not items or [t for t, _, _ in items] != [0x30, 0x04] or items[1][1] == items[1][2]:
        return False
    inner = der_items(data, *items[0][1:])
    return bool(inner) and inner[0][0] == 0x06


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Three parts with dots between, the first from its first eyJ on, from left to right."""
    for run in DOTTED.finditer(text):
        parts = run[0].split(".")
        at, i = run.start(), 0
        while i + 2 < len(parts):
            first = parts[i].find("eyJ")
            if first >= 0 and len(parts[i]) > first + 3:
                end = at + sum(map(len, parts[i : i + 3])) + 2
                yield at + first, end
                at, i = end + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1


def is_signed_token(text: str) -> bool:
    head = decoded(text.split(".", 1)[0])
    try:
        got = json.loads(head or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(got, dict) and isinstance(got.get("alg"), str)


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "openssh" if is_openssh(data) else "der" if is_private_der(data) else None


def signs(text: str, start: int, most: int | None = None) -> tuple[str, int]:
    """Up to `most` base64 signs from start on, over lines, and where they end."""
    parts, have, at = [], 0, start
    while (m := SIGNS.match(text, at)) and (most is None or have < most):
        part = m[0] if most is None else m[0][: most - have]
        parts.append(part)
        have, end = have + len(part), m.start() + len(part)
        line = LINE.match(text, m.end())
        if not line or (have == most):
            return "".join(parts), end
        at = line.end()
    return "".join(parts), end if parts else start


def der_length(head: bytes) -> tuple[int, int] | None:
    """Of a sequence, by its first bytes: where its contents start, and its length with them."""
    if len(head) < 2 or head[0] != 0x30:
        return None
    n = head[1]
    if n < 0x80:
        return 2, 2 + n
    size = n & 0x7F
    if not 1 <= size <= 4 or len(head) < 2 + size:
        return None
    return 2 + size, 2 + size + int.from_bytes(head[2 : 2 + size], "big")


def openssh_length(first: Callable[[int], bytes]) -> int | None:
    """Length by the fields' lengths; first(n) gives the first n bytes, or as many as there are."""
    at = len(OPENSSH)
    fields = 3
    for _ in range(2):
        for _ in range(fields):
            head = first(at + 4)
            if len(head) < at + 4:
                return None
            at += 4 + int.from_bytes(head[at : at + 4], "big")
        if fields == 3:
            head = first(at + 4)
            fields, at = int.from_bytes(head[at : at + 4], "big") + 1, at + 4
            if len(head) < at or not 2 <= fields <= 65:
                return None
    return at


def key_at(text: str, start: int) -> tuple[str, int] | None:
    """Kind and end of the key in base64 that begins at start. Its own lengths say where it ends, so that what follows, on the same line or the next ones, has no part; but no base64 sign may follow at once."""

    def first(n: int) -> bytes:
        return (decoded(signs(text, start, (n * 8 + 5) // 6)[0]) or b"")[:n]

    head = first(9)
    if head.startswith(OPENSSH[:9]):
        n = openssh_length(first)
    else:
        found = der_length(head)
        if not found or head[found[0] : found[0] + 2] != b"\x02\x01":
            return None
        n = found[1]
    if n is None:
        return None
    body, end = signs(text, start, (n * 8 + 5) // 6)
    data = decoded(body)
    kind = key_kind(data[:n]) if data and len(data) >= n else None
    end = PADDING.match(text, end).end()
    return (kind, end) if kind and not SIGNS.match(text, end) else None


def keys_in_base64(text: str) -> list[tuple[int, int, int]]:
    out, at = [], 0
    while m := BASE64_KEY.search(text, at):
        found = key_at(text, m.start())
        if found:
            out.append((m.start(), KINDS.index(found[0]), found[1]))
        at = found[1] if found else m.end()
    return out


def wrapped_pem(text: str) -> list[tuple[int, int, int]]:
    """Base64 texts whose contents hold PEM keys, up to the last one's end."""
    out, at = [], 0
    while m := BASE64_TEXT.search(text, at):
        body, at = signs(text, m.start())
        data = decoded(body[: len(body) - (len(body) % 4 == 1)])
        if data and b"-----BEGIN " in data and (found := pem_spans(data.decode("latin-1"))):
            body, end = signs(text, m.start(), (found[-1][2] * 8 + 5) // 6)
            out.append((m.start(), KINDS.index("pem"), PADDING.match(text, end).end()))
    return out


def is_pem(label: str, body: str) -> bool:
    """Base64, after header lines if there are any, that parses as a key, as an encrypted key if the label says so, or is a cipher text by its header."""
    lines = PEM_END.sub("\n", body).strip().split("\n")
    n = 0
    while n < len(lines) and (PEM_HEADER.fullmatch(lines[n].strip()) or (n and lines[n].startswith((" ", "\t")))):
        n += 1
    rest = "\n".join(lines[n:])
    data = decoded("".join(rest.split())) if PEM_BODY.fullmatch(rest) else None
    if any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in map(str.strip, lines[:n])):
        return bool(data)  # cipher text has no structure beyond that
    return is_encrypted_der(data) if label.startswith("ENCRYPTED") else key_kind(data) is not None


def pem_spans(text: str) -> list[tuple[int, int, int]]:
    """Each BEGIN with the END that comes next, if that has its label."""
    out, open_ = [], None
    for m in PEM_EDGE.finditer(text):
        if m[1] == "BEGIN":
            open_ = m
        else:
            if open_ and open_[2] == m[2] and is_pem(m[2], text[open_.end() : m.start()]):
                out.append((open_.start(), 3, m.end()))
            open_ = None
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of what the patterns alone find."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """What decodes and parses as a key or a signed token."""
    out = []
    if "-----BEGIN " in text:
        out += pem_spans(text)
    if "eyJ" in text:
        out += [(a, 4, b) for a, b in signed_tokens(text) if is_signed_token(text[a:b])]
    out += keys_in_base64(text) + wrapped_pem(text)
    out += [(m.start(), KINDS.index(kind), m.end()) for m in HEX_KEY.finditer(text) if (kind := key_kind(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])))]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds and of confirmed findings, digest of the base findings, and all findings as text and as structs (code points, end exclusive)."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, every = [], []
            for text in texts_of(batch):
                found = base_spans(text)
                base.append(found)
                every.append(sorted(found + confirmed_spans(text)))
            columns = [batch.column(0)]
            columns += [pa.array([sum(k == kind for _, k, _ in x) for x in base], pa.int64()) for kind in range(3)]
            columns += [pa.array([len(e) - len(b) for b, e in zip(base, every, strict=True)], pa.int64()), pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()), pa.array([joined(x) for x in every], pa.string())]
            columns += [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in every], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans", "findings"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS text").mapInArrow(per_batch(make), f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_confirmed bigint, base_sha256 string, spans string, findings array<struct<kind:string,start:int,end:int>>")


def masked(text: str) -> str:
    """The text with each finding, overlapping ones as one, replaced by its kind in angle brackets."""
    spans = sorted(base_spans(text) + confirmed_spans(text))
    if not spans:
        return text
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text, and n_chars, if there is one, as the new text has. Rows and other columns stay; a null text stays null."""
    names = docs.columns

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x if x is None else masked(x) for x in batch.column(names.index("text")).to_pylist()]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in names:
                n = batch.column(names.index("n_chars")).to_pylist()
                columns[names.index("n_chars")] = pa.array([m if x is None else len(x) for x, m in zip(texts, n, strict=True)], batch.schema.field("n_chars").type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return work

    return docs.mapInArrow(per_batch(make), docs.schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("findings")
