"""Spans that a sum over powers cannot tell apart, pieces whose hashes collide, and keys by their own lengths."""

import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from barwright.llm import bpe, packing, passages, secrets, setjoin, textcodes, tokens

SCHEMA = "doc_id BIGINT, text STRING"


def thue_morse(n, a, b):
    x = [0]
    while len(x) < n:
        x += [1 - v for v in x]
    return [(a, b)[v] for v in x]


A, B = ("".join(thue_morse(2048, *p)) for p in ("ab", "ba"))
#: The same in words, so that shingles and passages meet it.
WORDS_A, WORDS_B = (" ".join(thue_morse(2048, *p)) for p in (("some", "other"), ("other", "some")))


def test_spans_of_equal_sums_differ():
    code, at = textcodes.codes([A, B, A])
    h = textcodes.span_hash(code, at[:-1], at[1:] - 1)
    assert h[0] != h[1] and h[0] == h[2]
    short, at = textcodes.codes([A[:200], B[:200], "x" + A[:200]])
    h = textcodes.span_hash(short, at[:-1] + [0, 0, 1], at[1:] - 1)
    assert h[0] != h[1] and h[0] == h[2]


def test_hash_is_of_the_content_alone():
    g = np.random.default_rng(1)
    values = g.integers(0, 3, 5000)
    starts = g.integers(0, 4000, 800)
    ends = starts + g.integers(0, 600, 800)
    by = {}
    for h, s, e in zip(textcodes.span_hash(values, starts, ends).tolist(), starts.tolist(), ends.tolist()):
        by.setdefault(values[s:e].tobytes(), set()).add(h)
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


def test_op6_op10_op3_ids_of_such_words(spark):
    df = spark.createDataFrame([(1, A), (2, B), (3, A + " " + B)], SCHEMA).coalesce(1)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(str(P.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    for r in bpe.encode_decode(df, str(P.path("byte_bpe_50k.tiktoken"))).collect():
        text = {1: A, 2: B, 3: A + " " + B}[r["doc_id"]]
        assert list(r["ids"]) == enc.encode_ordinary(text) and bytes(r["decoded"]).decode() == text
    tk = Tokenizer.from_file(packing.default_tokenizer())
    for r in packing.token_output(df, capacity=8192).collect():
        flat = np.frombuffer(bytes(r["ids"]), dtype="<u4")
        for doc, a, b in zip(r["doc_ids"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert flat[a : b - 1].tolist() == tk.encode({1: A, 2: B, 3: A + " " + B}[doc], add_special_tokens=False).ids
    crc = {r["doc_id"]: r["ids_crc32"] for r in packing.best_fit_packing(df, capacity=8192).collect()}
    assert len(set(crc.values())) == 3


def test_op1_op9_keep_such_texts_apart(spark):
    df = spark.createDataFrame([(1, A), (2, B), (3, A)], SCHEMA)
    assert {r["doc_id"]: r["copy_id"] for r in setjoin.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}
    lists = passages.shingle_lists([WORDS_A, WORDS_B, WORDS_A], 5)
    h, at = lists
    assert (h[at[0] : at[1]] != h[at[1] : at[2]]).any() and (h[at[0] : at[1]] == h[at[2] : at[3]]).all()


def test_pieces_are_told_by_content_if_hashes_collide():
    whole = tokens.library_ids(packing.default_tokenizer())
    bad = tokens.PieceCache(whole.cache.encode, hash_of=lambda v, s, e: (e - s).astype(np.uint64) % np.uint64(3))
    g = random.Random(3)
    for _ in range(4):
        texts = [" ".join("".join(g.choice("abcdef") for _ in range(g.randint(1, 6))) for _ in range(50)) for _ in range(5)]
        ids, at = bad(texts)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == whole.whole.encode(t, add_special_tokens=False).ids


def tlv(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def some_bytes(g, n):
    return bytes([1]) + bytes(g.randrange(256) for _ in range(n - 1))


@pytest.fixture(scope="module")
def rsa():
    g = random.Random(3)
    return tlv(0x30, tlv(2, b"\0") + b"".join(tlv(2, some_bytes(g, n)) for n in (256, 3, 256, 128, 128, 128, 128, 128)))


def spans(text):
    return [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.confirmed_spans(text)]


def wrapped(text, n, by="\n"):
    return by.join(text[i : i + n] for i in range(0, len(text), n))


def test_unpadded_key_then_words(rsa):
    key = wrapped(base64.b64encode(rsa).decode(), 64).rstrip("=")
    assert spans(f"key:\n{key}\nRegards from me") == [("der", key)]


@pytest.mark.parametrize("by", ["\n", "\r\n", "\n    ", "\n\t"])
def test_key_lines(rsa, by):
    key = wrapped(base64.b64encode(rsa).decode(), 64, by)
    assert spans(f"key:\n    {key}\n    more words") == [("der", key)]


def test_two_keys_in_a_row(rsa):
    key = wrapped(base64.b64encode(rsa).decode().rstrip("="), 64)
    assert spans(f"{key}\n{key}\n") == [("der", key)] * 2


def test_base64_of_pem(rsa):
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + wrapped(base64.b64encode(rsa).decode(), 64) + "\n-----END RSA PRIVATE KEY-----\n"
    for by, text in (("", base64.b64encode(pem.encode()).decode()), ("\n  ", wrapped(base64.b64encode(pem.encode()).decode(), 76, "\n  "))):
        found = spans(f"data: {text}\n  other words")
        assert len(found) == 1 and found[0][0] == "pem" and found[0][1].startswith("LS0tLS1CRUdJTi") and text.startswith(found[0][1]), by


def test_openssh_ends_by_its_fields():
    g = random.Random(5)
    field = lambda x: struct.pack(">I", len(x)) + x
    body = secrets.OPENSSH + field(b"none") * 2 + field(b"") + struct.pack(">I", 1) + field(some_bytes(g, 51)) + field(some_bytes(g, 136))
    key = wrapped(base64.b64encode(body).decode(), 70)
    assert spans(f"k {key}\nthanks a lot") == [("openssh", key)]


def test_what_is_no_key(rsa):
    cut = base64.b64encode(rsa).decode()[:600]
    blob = base64.b64encode(hashlib.sha512(b"x").digest() * 20).decode()
    assert spans("M" * 200) == spans(cut) == spans(blob) == [] and spans("\n".join(["MII" + "A" * 61] * 500)) == []
