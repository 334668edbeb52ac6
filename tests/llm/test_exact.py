"""Grace deduplication against a dictionary of whole texts: hot groups, small tables that spill, nulls, clashing columns."""

import hashlib
import re

import pytest

from barwright.llm import exact

SCHEMA = "doc_id BIGINT, text STRING, keep_id STRING, part INT, `hash` STRING, bucket INT"


def want(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        spare = 1
        for i in ids:
            kept = bool(spare) and i == keep
            spare -= kept
            out.append((i, keep, len(ids), kept, sha))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


ROWS = [(i, f"text {i % 7}") for i in range(40)] + [(100, None), (101, ""), (102, " "), (103, "\t\n "), (104, "a  b"), (105, "a\tb"), (106, "a b"), (107, "x" * 300_000), (108, "x" * 300_000), (None, "text 1"), (None, "alone"), (5, "text 5"), (5, "text 6")] + [(1000 + i, "hot") for i in range(500)]


def frame(spark, rows, parts=6):
    return spark.createDataFrame([(i, t, "k", 1, "h", 2) for i, t in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("options", [{}, {"room": 400, "bucket": 300, "most_partitions": 4}])
def test_groups(spark, options):
    assert got(exact.exact_groups(frame(spark, ROWS), **options)) == want(ROWS)


def test_no_rows(spark):
    assert exact.exact_groups(frame(spark, [(1, "a")]).where("doc_id > 1")).count() == 0


def test_full_tables_spill_and_end(spark):
    rows = [(i, f"{i % 300:0100d}") for i in range(900)]
    assert got(exact.exact_groups(frame(spark, rows), room=1000, bucket=100_000, most_partitions=4)) == want(rows)


def test_contents_not_hashes_decide():
    class Same(bytes):
        __hash__ = lambda self: 7

    t = exact.ContentTable(10_000)
    assert [t.place(Same(x))[0] for x in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1]


def test_table_grows_and_refuses():
    t = exact.ContentTable(exact.ENTRY * 2000)
    assert [t.place(str(i).encode())[0] for i in range(1500)] == list(range(1500))
    assert [t.place(str(i).encode()) for i in range(1500)] == [(i, False) for i in range(1500)]
    full = exact.ContentTable(1)
    assert full.place(b"any length") == (0, True) and full.place(b"more") == (-1, False) and full.place(b"any length") == (0, False)
