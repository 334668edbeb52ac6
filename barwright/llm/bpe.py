"""Byte-level BPE by recursive queries: each partition's new pieces are contracted in DuckDB, which also decodes.

`encode_decode` gives ids and decoded bytes of every whole text. A null or empty text has no ids and decodes to nothing. Each row stands alone, so that repeated rows and extra columns are of no consequence, columns of the names that are added take no part, and an empty table gives no rows. Of pairs with one rank the leftmost goes first. A text of any length is encoded whole; one unbroken word of more than SHORT bytes takes as many steps as it has different merges, each over the whole word."""

from __future__ import annotations

import base64
import functools
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barwright.llm.common import per_batch, table, texts_of
from barwright.llm.tokens import PieceCache

#: Characters whose new pieces are contracted by one query, as a query takes a while to start and to go round.
BATCH_CHARS = 1_000_000
#: Words of more bytes are contracted by STEP.
SHORT = 64
#: A step contracts, in every word, the leftmost pair of least rank, as the library does. Only words with such a pair go round again, and nothing is sorted: a word is a row with its ids, its pairs meet the merges, and the least of rank and place is one aggregate a word.
SHORT_STEP = """
WITH RECURSIVE s(w, ids) USING KEY (w) AS (
  SELECT w, ids FROM words
  UNION ALL
  SELECT s.w, list_concat(list_concat(ids[:(best & 65535) - 1], [CAST(best >> 16 AS INTEGER)]), ids[(best & 65535) + 2:])
  FROM s JOIN (
    SELECT w, min((CAST(rank AS BIGINT) << 16) | i) AS best
    FROM (SELECT w, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, generate_subscripts(ids[2:], 1) AS i FROM s) JOIN merges USING (l, r)
    GROUP BY w) b ON b.w = s.w)
SELECT w, ids FROM s ORDER BY w
"""
#: A step contracts, in every word, all occurrences of its pair of least rank, from the left and without overlap (run: how many occurrences stand right before a place): the ids are those of one pair at a time, the leftmost first, whatever the word's length. For a contraction makes no lesser pair that another occurrence is needed for: a token of lower rank that spans both would have been contracted from its own bytes by then. That holds where pairs of no greater rank make every token from its own bytes, which Engine.check makes sure of.
STEP = """
WITH RECURSIVE s(w, pos, id) USING KEY (w, pos) AS (
  SELECT w, pos, id FROM start
  UNION ALL
  SELECT w, pos, CASE WHEN rank = least AND run % 2 = 0 THEN least WHEN run % 2 = 1 THEN CAST(-1 AS INTEGER) ELSE id END
  FROM (
    SELECT *, n - 1 - coalesce(max(CASE WHEN rank = least THEN NULL ELSE n END) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
    FROM (
      SELECT x.*, m.rank, min(m.rank) OVER (PARTITION BY w) AS least
      FROM (SELECT *, lead(id) OVER p AS nxt, row_number() OVER p AS n FROM s WHERE id >= 0 WINDOW p AS (PARTITION BY w ORDER BY pos)) x
      LEFT JOIN merges m ON m.l = x.id AND m.r = x.nxt)
    WHERE least IS NOT NULL))
SELECT w, pos, id FROM s WHERE id >= 0 ORDER BY w, pos
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_rows(ranks: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """Each pair of tokens whose bytes together are a token, and its rank."""
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                yield a, b, rank


class Engine:
    """One in-memory database a Python worker, with a bound on its memory."""

    def __init__(self, path: str) -> None:
        import duckdb

        ranks = read_ranks(path)
        self.whole = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": tempfile.mkdtemp(prefix="barwright-bpe-")})
        l, r, rank = (pa.array(x, pa.int32()) for x in zip(*merge_rows(ranks), strict=True))
        self._put("merges", pa.table({"l": l, "r": r, "rank": rank}))
        self._put("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int64()), "token": pa.array(ranks.keys(), pa.binary())}))
        self.cache = PieceCache(self.encode)

    def _put(self, name: str, rows: pa.Table) -> None:
        self.db.register("_rows", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM _rows")
        self.db.unregister("_rows")

    def encode(self, pieces: list[str]) -> list:
        """Ids of each piece. A piece that is a token as a whole is that token, as in the library."""
        raw = [x.encode("utf-8", "replace") for x in pieces]
        out: list = [[self.whole[x]] if x in self.whole else None for x in raw]
        which = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(which, self.contracted([raw[i] for i in which]), strict=True):
            out[i] = ids
        return out

    def _start(self, words: list[bytes], numbers: np.ndarray) -> None:
        size = np.array(list(map(len, words)), dtype=np.int64)
        pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self._put("start", pa.table({"w": np.repeat(numbers, size).astype(np.int32), "pos": pos.astype(np.int32), "id": self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]}))

    def contracted(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        short = [i for i, x in enumerate(words) if len(x) <= SHORT]
        long = [i for i, x in enumerate(words) if len(x) > SHORT]
        for which, by in ((short, self._by_lists), (long, self._by_places)):
            for i, ids in zip(which, by([words[i] for i in which]), strict=True):
                out[i] = ids
        return out

    def _by_lists(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        at = np.cumsum([0, *map(len, words)]).astype(np.int32)
        ids = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        self._put("words", pa.table({"w": np.arange(len(words), dtype=np.int32), "ids": pa.ListArray.from_arrays(at, ids)}))
        found = self.db.sql(SHORT_STEP).to_arrow_table().column("ids").combine_chunks()
        cuts = found.offsets.tolist()
        flat = found.values.tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _by_places(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        self._start(words, np.arange(len(words)))
        found = self.db.execute(STEP).fetchnumpy()
        cuts = np.searchsorted(found["w"], np.arange(len(words) + 1)).tolist()
        ids = found["id"].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def check(self) -> None:
        """Every token's bytes are contracted to that token by pairs of no greater rank; a token's rank is its word's number here."""
        self._start(list(self.whole), np.array(list(self.whole.values()), dtype=np.int64))
        found = self.db.execute(STEP.replace("m.r = x.nxt", "m.r = x.nxt AND m.rank <= x.w")).fetchnumpy()
        if len(found["id"]) != len(self.whole) or (found["id"] != found["w"]).any():
            raise ValueError("the vocabulary has tokens that lesser merges do not make")

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids, put together in the order of their places."""
        n = len(at) - 1
        doc = np.repeat(np.arange(n), np.diff(at))
        self.db.register("_ids", pa.table({"doc": doc, "pos": np.arange(len(ids)), "id": ids.astype(np.int64)}))
        rows = self.db.sql("SELECT doc, list(token ORDER BY pos) AS tokens FROM _ids JOIN vocabulary USING (id) GROUP BY doc").to_arrow_table()
        self.db.unregister("_ids")
        out = [b""] * n
        tokens = rows.column("tokens").combine_chunks()
        flat = tokens.values
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        bounds = np.frombuffer(flat.buffers()[1], dtype=np.int32 if pa.types.is_binary(flat.type) else np.int64)[flat.offset : flat.offset + len(flat) + 1]
        data, offsets = flat.buffers()[2], tokens.offsets.to_numpy()
        for k, d in enumerate(rows.column("doc").to_pylist()):
            a, b = (int(bounds[x]) for x in (offsets[k], offsets[k + 1]))
            out[d] = data.slice(a, b - a).to_pybytes()
        return out


@functools.lru_cache(maxsize=2)
def engine(path: str) -> Engine:
    return Engine(path)


@functools.lru_cache(maxsize=8)
def checked(path: str) -> str:
    Engine(path).check()
    return path


def encode_decode(docs: DataFrame, vocabulary: str, keep: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_tokens, ids_sha256, decoded_sha256 and, with keep, ids (array of int) and decoded (binary)."""
    fields = [(id_col, docs.schema[id_col].dataType.simpleString()), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    fields += [("ids", "array<int>"), ("decoded", "binary")] if keep else []

    path = checked(vocabulary)

    def make():
        db = engine(path)

        def work(batch: pa.RecordBatch) -> pa.Table:
            ids, at = db.cache(texts_of(batch))
            decoded = db.decode(ids, at)
            raw = ids.astype("<u4")
            cut = at.tolist()
            columns = {
                id_col: batch.column(0),
                "n_tokens": pa.array(np.diff(at)),
                "ids_sha256": pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
            }
            if keep:
                columns |= {"ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))), "decoded": pa.array(decoded, pa.binary())}
            return pa.table(columns)

        return work

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS text").mapInArrow(per_batch(make, BATCH_CHARS), ", ".join(f"`{n}` {t}" for n, t in fields))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), keep=False)
