"""Each operator on cases with nulls, empty and long texts, repeats, no rows and clashing columns, and against brute force."""

import base64
import hashlib
import json
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from barwright.llm import bitsliced, bpe, common, forest, langid, packing, passages, secrets, setjoin, textcodes, tokens, toxicity

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score DOUBLE, rank INT, spans STRING, n BIGINT, `_id` INT"
WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi", "nu") for b in ("ra", "te", "so", "vi", "du") for c in ("n", "s", "l", "")]


def prose(seed, n):
    g = random.Random(seed)
    return " ".join(g.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(2, 70)
    out = [base, base, " ".join(near), base.upper(), "", None, "  \n ", "one", "12345 !!!", prose(3, 80) + " " + passage, passage + " " + prose(4, 60), prose(5, 300), prose(6, 20_000), "aaaa " * 3000, "é" * 5000, "x" * 3000 + " " + base]
    return out + [prose(100 + i, 100) for i in range(20)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], "s", None if t is None else len(t), 0.5, 1, "x", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


# ---- texts


def test_pieces_are_the_pattern():
    pattern, g = regex.compile(P.PATTERN), random.Random(1)
    parts = ["a", "b", " ", " ", "\n", "'", "s", "re", "ll", "1", "²", "!", "é", "\t", "　", "'t", "'ve", "中", "  ", "\x00", "😀"]
    every = ["", "a's b'll x'res 'tis", "  ", "a \n"] + ["".join(g.choice(parts) for _ in range(g.randrange(40))) for _ in range(3000)]
    _, starts, ends, first = textcodes.pieces(every)
    whole = "".join(t + "\x00" for t in every)
    for i, t in enumerate(every):
        assert [whole[a:b] for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] == pattern.findall(t)


def test_words_are_split():
    every = ["", "a  b\nc", " x ", "İstanbul ßA"]
    h, which, starts, ends = textcodes.words(every)
    assert [every[k][a:b] for k, a, b in zip(which, starts, ends, strict=True)] == [w for t in every for w in t.split()]
    assert len(set(h.tolist())) == len({w.lower() for t in every for w in t.split()})


# ---- 1 and 9


def test_jaccard_join_is_brute_force(docs, texts):
    got = by_id(setjoin.near_duplicates(docs), "class_id", "copy_id", "n_links")
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    links, root = Counter(), {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert {i: (g[0], g[2]) for i, g in got.items()} == {i: (root[i], links[i]) for i in sets}
    assert got[1][1] == 0 and got[3][1] == 0 and got[2][1] == 2


def test_jaccard_join_splits_large_buckets_and_blocks(spark):
    g, base = random.Random(9), prose(11, 200).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(2):
            w[g.randrange(len(w))] = f"w{g.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    sets = {i: shingle_set(t) for i, t in rows}
    want = Counter()
    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want[i] += 1
                want[j] += 1
    for options in ({"limit": 1000, "block": 32}, {"limit": 40, "block": 16, "depth": 2, "runs": 16}):
        got = by_id(setjoin.near_duplicates(df, **options), "n_links")
        assert sum(got.values()) >= 0.97 * sum(want.values()) and all(got[i] <= want[i] for i in sets)


def test_jaccard_join_keeps_template_families_above_the_limit(spark):
    rows = [(100 * f + i, f"{prose(1000 + f, 76)} id{f} no{i} row{i} end{i}") for f in range(16) for i in range(40)]
    got = by_id(setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), limit=16, block=16), "class_id", "n_links")
    assert got == {i: (i // 100 * 100, 39) for i, _ in rows}


def test_one_of_each(docs):
    left = {r.doc_id for r in setjoin.one_of_each(docs).collect()}
    assert 0 in left and not {1, 2, 3} & left and {4, 5, 6, 7, 8} <= left


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (20, 21), (5, 5)], "a BIGINT, b BIGINT")
    assert {(r.node, r.root) for r in setjoin.components(edges).collect()} == {(2, 1), (3, 1), (9, 1), (21, 20)}


def test_tree_windows_cover_each_subsequence_once():
    g = np.random.default_rng(3)
    v, at, least = g.integers(0, 1000, 80).astype(np.uint64), np.array([0, 50, 80]), 6
    l, c, r = passages.tree_windows(v, at, least)
    for a, b in zip(at, at[1:], strict=False):
        for i in range(a, b):
            for j in range(i + least - 1, b):
                m = i + int(np.argmin(v[i : j + 1]))
                assert ((l <= i) & (i <= c) & (c <= j) & (j <= r)).sum() == 1 and m in c


def test_passages_cover_exact_repeats(docs, texts):
    got = defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        got[r.doc_id].update(range(r.start, r.end))
    where = defaultdict(set)
    split = {i: (t or "").lower().split() for i, t in enumerate(texts)}
    for i, w in split.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    want = defaultdict(set)
    for i, w in split.items():
        for k in range(len(w) - 49):
            if len(where[tuple(w[k : k + 50])]) > 1:
                want[i].update(range(k, k + 50))
    assert all(want[i] <= got[i] for i in want)
    assert not set(got) & {4, 5, 6, 7, 8, 11, 12, 14}


def test_passages_of_interleaved_families_share_a_hot_line(spark):
    n, hot = 40, prose(2000, 34)
    family = [f"{hot} {prose(2100 + f, 22)}" for f in range(n)]
    rows = [(i, f"{prose(3000 + i, 60)} {family[i % n]} {prose(4000 + i, 60)}") for i in range(3 * n)]
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert len(got) >= 0.95 * len(rows)
    assert all((r.start, r.end, r.class_id) == (60, 116, i % n) for i, r in got.items() if r.class_id != i)


def longest_stretch(same, miss):
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -miss))])
    best = (0, 0)
    for i in range(len(same)):
        j = max((j for j in range(i, len(total)) if total[j] >= total[i]), default=i)
        if j - i > best[1] - best[0]:
            best = (i, j)
    hit = np.flatnonzero(same[best[0] : best[1]])
    return (best[0] + int(hit[0]), best[0] + int(hit[-1]) + 1) if len(hit) else (best[0], best[0])


def stretches(x, y, least, threshold):
    miss, out, open_ = 4.0, [], [(0, len(x), 4.0)]
    known = np.isin(x, y)
    while open_:
        lo, hi, cost = open_.pop()
        a, b = (lo + z for z in longest_stretch(known[lo:hi], cost))
        if b - a < least:
            continue
        found, u = None, set(x[a:b].tolist())
        for other in (miss, 2 * miss, 4 * miss):
            c, d = longest_stretch(np.isin(y, x[a:b]), other)
            v = set(y[c:d].tolist())
            if d - c >= least and len(u & v) >= threshold * len(u | v) - 1e-9:
                found = (a, b, c, d)
                break
        if found:
            out.append(found)
        elif cost <= b - a:
            open_.append((a, b, 2 * cost))
        open_ += [(lo, a, miss), (b, hi, miss)]
    return sorted(out)


def verified(xs, ys):
    at = [np.cumsum([0, *map(len, z)]) for z in (xs, ys)]
    got = defaultdict(list)
    for i, *found in passages.verified_pairs(np.concatenate(xs), at[0], np.concatenate(ys), at[1], 46, 0.8).tolist():
        got[i].append(tuple(found))
    return [sorted(got[i]) for i in range(len(xs))]


def test_one_sided_edits_are_near_duplicates():
    shingled = lambda w: passages.shingle_lists([" ".join(w)], 5)[0].astype(np.uint32)
    for n, gone in ((60, 3), (100, 8)):
        w, a, b = ([f"{x}{i}" for i in range(m)] for x, m in (("w", n), ("a", 30), ("b", 30)))
        cut = w[: n // 2] + w[n // 2 + gone :]
        for one, two in ((w, cut), (cut, w)):
            got = verified([shingled(a + one + a)], [shingled(b + two + b)])[0]
            assert got == [(30, 30 + len(one) - 4, 30, 30 + len(two) - 4)]


def test_pairs_are_verified_alike_in_batches():
    g = np.random.default_rng(8)
    xs, ys = [], []
    for _ in range(300):
        x = g.integers(0, 2**32, int(g.integers(0, 200)), dtype=np.uint32)
        y = x.copy()
        for _ in range(int(g.integers(0, 12))):
            if len(y):
                y[g.integers(len(y))] = g.integers(0, 2**32)
        a, b = sorted(g.integers(0, len(y) + 1, 2))
        ys.append(np.concatenate([g.integers(0, 2**32, int(g.integers(0, 90)), dtype=np.uint32), y[a:b] if g.random() < 0.5 else y, x[: g.integers(0, 80)]]))
        xs.append(np.concatenate([x, x[:60]]) if g.random() < 0.2 else x)
    got = verified(xs, ys)
    assert got == [stretches(x, y, 46, 0.8) for x, y in zip(xs, ys, strict=True)]
    assert sum(map(bool, got)) > 100


def test_near_copies_of_passages_are_found(spark):
    """Recall on planted passages of a similarity of 0.8 or more, in keys of two texts and in keys that many unrelated texts share."""
    g, hot = random.Random(12), prose(900, 30)
    rows, want = [], []
    for i in range(150):
        w = (f"{prose(5000 + i, 45)} {hot} {prose(6000 + i, 45)}" if i % 2 else prose(5000 + i, 90)).split()
        e = list(w)
        for _ in range(g.randrange(1, 3)):
            at = g.randrange(len(e))
            e[at : at + 1] = g.choice([[], ["changed"], [e[at], "more"]])
        a, b = shingle_set(" ".join(w)), shingle_set(" ".join(e))
        rows += [(2 * i, f"{prose(7000 + i, 40)} {' '.join(w)} {prose(8000 + i, 40)}"), (2 * i + 1, f"{prose(9000 + i, 30)} {' '.join(e)} {prose(10000 + i, 30)}")]
        if len(a & b) >= 0.8 * len(a | b):
            want += [2 * i, 2 * i + 1]
    got = defaultdict(int)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect():
        got[r.doc_id] += r.n_words
    assert len(want) > 200 and sum(got[i] >= 50 for i in want) >= 0.99 * len(want)
    assert all(n <= (124 if i // 2 % 2 else 94) for i, n in got.items())


def test_repeats_go_from_later_texts(docs, texts):
    left = {r.doc_id: r.text for r in passages.without_repeats(docs).collect()}
    assert left[9] == texts[9] and left[10].split() == texts[10].split()[70:] and left[11] == texts[11] and left[5] is None
    assert 1 not in left and left[0] == texts[0]


# ---- 2 and 4


def vectors(spark, n=400, seed=1):
    g = np.random.default_rng(seed)
    v = g.normal(size=(n, 8)).round(2) / 3
    v[50:120] = v[50]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(n, None), (n + 1, [float("nan")] * 8), (n + 2, [None] * 8), (n + 3, []), (n + 4, [1.0]), (None, [0.1] * 8), (n + 5, [0.0] * 8)]
    return v, spark.createDataFrame(rows + bad, "vec_id BIGINT, embedding ARRAY<DOUBLE>")


def test_bitsliced_top_k_is_exact(spark):
    v, df = vectors(spark)
    q = np.floor(256 * np.vstack([v, np.zeros((6, 8))])).astype(int)
    ids = [*range(400), 405]
    got = defaultdict(list)
    for r in bitsliced.top_k(df, lambda i: i % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for i in range(0, 400, 50):
        want = sorted(((-int(q[i] @ q[j]), j) for j in ids if j != i))[:5]
        assert got[i] == [(j, -s) for s, j in want]


def test_bit_sums():
    g = np.random.default_rng(2)
    v, q = g.integers(-200, 200, (1000, 7)), g.integers(-200, 200, 7)
    low = v.min(axis=0)
    block = bitsliced.Block(bitsliced.slices_of(v - low, int((v - low).max()).bit_length()), 1000, low)
    rows, score = block.best(q, 20)
    s = v @ q
    assert (s[rows] == score).all() and set(np.argsort(-s)[:20]) <= set(rows.tolist())


def test_forest_finds_most_neighbours(spark):
    v, df = vectors(spark, 1500, 4)
    got = defaultdict(list)
    for r in forest.nearest(df, lambda i: i % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    found = 0
    for i in range(0, 1500, 20):
        s = v @ v[i]
        s[i] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        assert len(got[i]) == 20 and all(abs(s[j] - x) < 1e-12 for j, x in got[i]) and [x for _, x in got[i]] == sorted((x for _, x in got[i]), reverse=True)
        found += len({j for j, _ in got[i]} & set(best.tolist()))
    assert found >= 0.9 * 20 * 75


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert bitsliced.top_k(df, lambda i: i % 50 == 0).count() == 0 and forest.nearest(df, lambda i: i % 20 == 0).count() == 0


# ---- 3 and 10


def test_packing_is_a_lossless_round_trip(spark, docs, texts):
    library = Tokenizer.from_file(packing.default_tokenizer())
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    rows = packing.best_fit_packing(docs, 256).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32 and 1 <= r.length == len(piece) <= 256
    for i, pieces in by.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(want[i])
        assert all(r.length == 256 for r in pieces[1:]) and [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces[:-1])]).tolist()
    assert set(by) == set(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    for r in packing.token_output(docs, 256).collect():
        flat = np.frombuffer(r.ids, "<u4")
        position = np.frombuffer(r.positions, "<u4")
        assert len(flat) == 256 and r.cu_seqlens[-1] == r.n_tokens and not flat[r.n_tokens :].any()
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            start = by[d][p].start
            assert flat[a:b].tolist() == want[d][start : start + b - a] and position[a:b].tolist() == list(range(b - a))


def test_ids_are_those_of_the_library():
    own, library, g = tokens.library_ids(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer()), random.Random(1)
    parts = ["a", "b", " ", " ", "\n", "'", "s", "re", "1", "²", "!", "é", "\t", "　", "'t", "中", "  ", "😀", "<|endoftext|>", "hello", " world", "<|", "|>", "endoftext"]
    every = ["", "hello <|endoftext|> world"] + ["".join(g.choice(parts) for _ in range(g.randrange(40))) for _ in range(3000)]
    for cache in (own.cache.most, 100):
        own.cache.most, before = cache, own.cache.most
        for at in range(0, len(every), 500):
            ids, cut = own(every[at : at + 500])
            assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)] == [library.encode(t, add_special_tokens=False).ids for t in every[at : at + 500]]
        own.cache.most = before


@pytest.mark.parametrize("planner", [packing.best_fit_decreasing, packing.large_item_matching])
def test_plans_place_every_item_once(planner):
    g = random.Random(5)
    for _ in range(60):
        capacity = g.choice([10, 64, 100])
        counts = Counter(g.randrange(1, capacity + 1) for _ in range(g.randrange(1, 300)))
        plan = planner(dict(counts), capacity)
        used, seen = defaultdict(list), Counter()
        for length, a, b, first, each, offset in plan.rows:
            for k in range(b - a):
                used[first + k // each].append((offset + k % each * length, length))
                seen[length] += 1
        assert seen == counts and set(used) == set(range(plan.bins))
        for items in used.values():
            at = 0
            for o, n in sorted(items):
                assert o == at
                at += n
            assert at <= capacity
        total = sum(k * n for k, n in counts.items())
        assert plan.bins <= 1.3 * -(-total // capacity) + sum(n for k, n in counts.items() if 2 * k > capacity) * 0.3 + 1


# ---- 5


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def test_secrets_are_parsed_before_they_are_reported(docs, spark):
    number = lambda n: der(2, b"\x01" * n)
    rsa = der(0x30, der(2, b"\x00") + b"".join(number(n) for n in (64, 3, 64, 32, 32, 32, 32, 32)))
    wrapped = der(0x30, der(2, b"\x00") + der(0x30, der(6, b"\x2a\x86\x48")) + der(4, rsa))
    field = lambda b: struct.pack(">I", len(b)) + b
    ssh = b"openssh-key-v1\x00" + field(b"none") * 2 + field(b"") + struct.pack(">I", 1) + field(b"k" * 40) + field(b"p" * 80)
    b64 = lambda b: base64.b64encode(b).decode()
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    good = {b64(rsa): "der", b64(wrapped): "der", rsa.hex().upper(): "der", b64(ssh): "openssh", f"{head}.{head}.sig_1": "token", f"-----BEGIN RSA PRIVATE KEY-----\n{b64(rsa)}\n-----END RSA PRIVATE KEY-----": "pem"}
    bad = [b64(rsa[:-1]), b64(b"0" + rsa[1:] + b"x"), "M" + "A" * 60, "eyJhbGciOi.eyJh.x", b64(der(0x30, number(64) + number(3)))]
    rows = [(i, f"see {x} now") for i, x in enumerate([*good, *bad])]
    found = {r.doc_id: [f.kind for f in r.findings if f.kind in secrets.KINDS[3:]] for r in secrets.scan(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert all(kind in found[i] for i, kind in enumerate(good.values()))
    assert all(not found[i] for i in range(len(good), len(rows)))
    base = by_id(secrets.scan(docs), "n_assign", "base_sha256", "spans")
    assert base[5] == base[4] == (0, hashlib.sha256(b"").hexdigest(), "")


def test_pem_with_headers_and_escaped_line_ends():
    rsa = lambda k: der(0x30, der(2, b"\x00") + b"".join(der(2, b"\x01" * n) for n in (64, 3, 64, 32, 32, 32, 32, k)))
    lines = lambda b: [base64.b64encode(b).decode()[i : i + 64] for i in range(0, len(b) * 4 // 3 + 4, 64)]
    block = lambda body, end: f"-----BEGIN RSA PRIVATE KEY-----{end}{end.join(body)}{end}-----END RSA PRIVATE KEY-----"
    head = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF", ""]
    for end in ("\n", "\r\n", "\\n", "\\r\\n"):
        for body in (lines(rsa(32)), head + lines(b"any cipher text" * 9)):
            text = block(body, end)
            assert (4, 3, 4 + len(text)) in secrets.confirmed_spans(f"see {text} now")
    assert not secrets.confirmed_spans(block(lines(b"no key at all" * 9), "\n")) and not secrets.confirmed_spans(block(["Proc-Type: 4,ENCRYPTED", "", "not base64!"], "\n"))


def test_encrypted_and_wrapped_keys_and_long_keys():
    rsa = lambda k: der(0x30, der(2, b"\x00") + b"".join(der(2, b"\x01" * n) for n in (64, 3, 64, 32, 32, 32, 32, k)))
    block = lambda b, label="ENCRYPTED PRIVATE KEY": f"-----BEGIN {label}-----\n" + base64.encodebytes(b).decode() + f"-----END {label}-----"
    sealed = der(0x30, der(0x30, der(6, b"\x2a\x86\x48") + der(0x30, b"")) + der(4, b"cipher text" * 20))
    assert [k for _, k, _ in secrets.confirmed_spans(block(sealed))] == [3]
    assert not secrets.confirmed_spans(block(b"AAAA")) and not secrets.confirmed_spans(block(sealed[:-1]))
    number = lambda n: b"\x02\x83" + n.to_bytes(3, "big") + b"\x01" * n
    body = der(2, b"\x00") + b"".join(number(n) for n in (50_000, 3, 50_000, 9_000, 9_000, 9_000, 9_000, 9_000))
    long = block(b"\x30\x83" + len(body).to_bytes(3, "big") + body, "RSA PRIVATE KEY")
    assert len(long) > 150_000 and (0, 3, len(long)) in secrets.confirmed_spans(long)
    wrapped = base64.encodebytes(rsa(32)).decode().strip()
    assert secrets.confirmed_spans(f"key:\n{wrapped}\nand words") == [(5, 5, 5 + len(wrapped))]
    line = base64.b64encode(rsa(32)).decode()
    assert secrets.confirmed_spans(f"{line}\nwords") == [(0, 5, len(line))]


def test_signed_tokens_are_the_pattern():
    pattern, g = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), random.Random(4)
    for _ in range(3000):
        text = "".join(g.choice(["eyJ", "a", ".", ".", "-", " ", "ey", "eyJx.b.c"]) for _ in range(g.randrange(30)))
        assert list(secrets.signed_tokens(text)) == [m.span() for m in pattern.finditer(text)]
    at = time.time()
    secrets.confirmed_spans("eyJ" * 400_000)
    assert time.time() - at < 20


def test_base_findings(spark):
    every = ['Token = "abcdefghijkl0123"', "api_key:short password=aaaaaaaaaaaa", "AKIA" + "A" * 14 + " AKIA123", "deadbeefdeadbeef 0123456789abcde", "secret = token = abcdefghijklmnop", "é token: 0123456789abcdef"]
    got = [r.spans for r in secrets.scan(spark.createDataFrame(list(enumerate(every)), "doc_id BIGINT, text STRING")).orderBy("doc_id").collect()]
    for text, spans in zip(every, got, strict=True):
        want = []
        for k, (p, ok) in enumerate([(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), (r"[0-9a-f]+", lambda m: len(m[0]) >= 16)]):
            want += [(m.start(), k, m.end()) for m in re.finditer(p, text) if ok(m)]
        assert spans == secrets.joined(sorted(want))


def test_redaction_keeps_clean_texts(spark, docs, texts):
    assert by_id(secrets.redacted(docs), "text") == dict(enumerate(texts))
    assert secrets.masked('a token = "abcdefghijkl0123" b') == 'a <assign>" b'


def moved_bytes(spark, run):
    """Bytes that run shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    run()
    return total() - before


def test_sets_outside_split_buckets_do_not_move(spark):
    g = np.random.default_rng(3)
    rows = [(i, bytearray(textcodes.to_move(g.integers(0, 1 << 62, 2000).astype(np.uint64)).tobytes())) for i in range(200)]
    members = setjoin.stored(spark.createDataFrame(rows, "rep bigint, tokens binary"), "test-sets")
    big = spark.createDataFrame([(i, 77) for i in range(0, 200, 20)], "rep bigint, path bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = []
        assert moved_bytes(spark, lambda: found.extend(setjoin.deeper(big, members, 0.8).collect())) < 400_000  # all are 2.4 million
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["rep"] for r in found} <= set(range(0, 200, 20)) and found
    for rep in {r["rep"] for r in found}:
        t = textcodes.moved(bytes(rows[rep][1]))
        want = setjoin.chosen(t, np.array(len(t)), np.uint64(77), 0.8 / setjoin.DEEPER)[1].view(np.int64)
        assert sorted(r["path"] for r in found if r["rep"] == rep) == sorted(want.tolist())


def test_sets_stored_by_key_are_joined_where_they_are(spark):
    g = np.random.default_rng(4)
    rows = [(i, bytearray(g.bytes(12_000))) for i in range(200)]
    members, name = common.stored_by(spark.createDataFrame(rows, "rep bigint, tokens binary"), "test-sets", "rep")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = []
        keys = spark.range(0, 200, 2).withColumnRenamed("id", "rep")
        assert moved_bytes(spark, lambda: found.extend(members.join(keys, "rep").collect())) < 400_000  # all are 2.4 million
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")
    assert sorted((r["rep"], bytes(r["tokens"])) for r in found) == [(i, bytes(t)) for i, t in rows[::2]]


def test_near_duplicates_leave_no_table(spark):
    df = spark.createDataFrame([(i, "one two three four five six seven") for i in range(3)] + [(3, "one two three four five six seven eight"), (4, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in setjoin.near_duplicates(df, threshold=0.7).collect()}
    assert got[1] == got[2] == 0 and got[4] == 4
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sets_")]


# ---- 6


def test_bpe_is_the_library(docs, texts):
    path = str(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = by_id(bpe.encode_decode(docs, path), "ids", "decoded", "n_tokens", "ids_sha256")
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i][0] == ids and bytes(got[i][1]) == (t or "").encode() and got[i][2] == len(ids)
        assert got[i][3] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_long_pieces_contract_alike():
    path, g = str(P.path("byte_bpe_50k.tiktoken")), random.Random(2)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    every = ["".join(g.choice(s) for _ in range(n)) for s in ("a", "ab", "abcdeinrst", "=-", "é中a", "the rin") for n in (20, 49, 400, 3000)]
    pieces = [p for t in every for p in regex.findall(P.PATTERN, t)]
    assert bpe.engine(path).encode(pieces) == [enc.encode_ordinary(p) for p in pieces]


def test_words_of_common_length_are_contracted_without_sorting_places(monkeypatch):
    path, g = str(P.path("byte_bpe_50k.tiktoken")), random.Random(5)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    every = [" " + "".join(g.choice(s) for _ in range(g.randint(1, n))) for s in ("a", "ab", "ththeinerés", "=-") for n in (12, 31, 63) for _ in range(40)]
    edge = ["a" * n for n in (bpe.SHORT - 1, bpe.SHORT, bpe.SHORT + 1)]
    pieces = [p for t in every + edge for p in regex.findall(P.PATTERN, t)]
    with monkeypatch.context() as m:
        long, seen = bpe.Engine._by_places, []
        m.setattr(bpe.Engine, "_by_places", lambda self, words: seen.extend(words) or long(self, words))
        assert bpe.engine(path).encode(pieces) == [enc.encode_ordinary(p) for p in pieces]
    assert seen and min(map(len, seen)) > bpe.SHORT


def test_vocabularies_that_their_merges_do_not_make_are_refused(tmp_path):
    odd = {bytes([b]): b for b in range(256)} | {b"aba": 256, b"ab": 257}
    (tmp_path / "odd.tiktoken").write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in odd.items()))
    with pytest.raises(ValueError, match="do not make"):
        bpe.checked(str(tmp_path / "odd.tiktoken"))


# ---- 7 and 8


def test_toxicity_on_held_out_documents(spark):
    g = random.Random(7)
    rows, marks = [], []
    for i in range(1200):
        bad = g.random() < 0.2
        s = [prose(i * 31 + k, 8).capitalize() for k in range(g.randrange(1, 12))]
        if bad:
            s[g.randrange(len(s))] += f" you {g.choice(['zorgle', 'blarkish'])}"
        rows.append((i, ". ".join(s) + ".", "en"))
        marks.append((i, int(bad)))
    rows += [(1200, None, "en"), (1201, "", None)]
    docs, labels = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"), spark.createDataFrame(marks + [(1, None), (None, 1)], "doc_id BIGINT, toxic INT")
    model = toxicity.fit(docs, labels)
    got = by_id(toxicity.scored(docs, model), "score", "worst_sentence")
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i][0] >= 0.3) == bool(marks[i][1]) for i in held)
    assert right >= 0.97 * len(held) and got[1200][0] < 0.3 and got[1201][0] == got[1200][0]
    for i in [i for i in held if marks[i][1]][:20]:
        assert re.search("zorgle|blarkish", rows[i][1].split(".")[got[i][1]])
    nothing = toxicity.fit(docs, labels.where("toxic = 0"))
    assert set(by_id(toxicity.scored(docs, nothing), "score").values()) == {0.0}


def test_languages(spark, docs):
    a, b = ["der und die nicht", "sch ein auf mit"], ["the and of with", "that for was this"]
    g = random.Random(3)
    rows = [(i, " ".join(g.choice(" ".join([a, b][i % 2]).split()) for _ in range(30)), ["de", "en"][i % 2]) for i in range(200)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "123 !?", "en"), (203, "the and that was", None)]
    got = by_id(langid.identify(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")), "lang_pred", "score", "held_out")
    assert all(got[i][0] == rows[i][2] and 0 < got[i][1] <= 1 and got[i][2] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200))
    assert got[200][:2] == got[201][:2] == got[202][:2] == ("und", 0.0) and got[203][0] == "en"
    assert set(by_id(langid.identify(docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")), "lang_pred").values()) == {"und"}


def test_gram_keys_are_the_n_grams():
    for text in ["the cat", " a", "b ", "x1y", "", "Été!"]:
        keys, _ = langid.gram_keys([text])
        want = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            p = f"\x01{w}\x01"
            want.update([c for c in w])
            want.update(p[i : i + 2] for i in range(len(p) - 1))
            want.update(p[i : i + 3] for i in range(len(p) - 2))
        got = Counter()
        for k in keys.tolist():
            got["".join(chr(x) for x in (k & 0x1FFFFF, k >> 21 & 0x1FFFFF, k >> 42) if x)] += 1
        assert got == want, text


# ---- no rows, and the pipeline


def test_no_documents(none, spark):
    assert setjoin.near_duplicates(none).count() == passages.repeated_passages(none).count() == packing.best_fit_packing(none).count() == packing.token_output(none).count() == 0
    assert secrets.scan(none).count() == langid.identify(none).count() == 0
    assert bpe.encode_decode(none, str(P.path("byte_bpe_50k.tiktoken"))).count() == 0
    labels = spark.createDataFrame([], "doc_id BIGINT, toxic INT")
    assert toxicity.scored(none, toxicity.fit(none, labels)).count() == 0


def test_rows_without_ids(spark):
    df = spark.createDataFrame([(None, prose(1, 80), "en"), (None, prose(1, 80), "en"), (1, prose(1, 80), "en"), (1, prose(1, 80), "en")], "doc_id BIGINT, text STRING, lang STRING")
    assert sorted((r.doc_id or -1, r.n_links) for r in setjoin.near_duplicates(df).collect()) == [(-1, 0), (-1, 0), (1, 1), (1, 1)]
    assert setjoin.one_of_each(df).count() == 3
    assert passages.repeated_passages(df).count() == 0 and packing.best_fit_packing(df).count() == 4 and langid.identify(df).count() == 4


def test_pipeline_stages_take_effect(spark, docs, texts, tmp_path):
    import corpus_pipeline

    extra = spark.createDataFrame([(900, "the token = 0123456789abcdef0123 " + prose(77, 90), "en", "s", 1, 0.0, 0, "", 0, 0)], SCHEMA)
    docs.union(extra).write.parquet(f"{tmp_path}/documents.parquet")
    at = docs.union(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, str(tmp_path))
        assert after.columns == docs.columns, name
        at = after
    left = {r.doc_id: r.text for r in at.collect()}
    assert not {1, 2, 3, 4, 5, 6, 8} & set(left) and left[0] == texts[0] and {20 + i for i in range(16)} <= set(left)
    assert "<assign>" in left[900] and "0123456789abcdef0123" not in left[900]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(left)
    library = Tokenizer.from_file(packing.default_tokenizer())
    assert out.groupBy().sum("length").first()[0] == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in left.values())
