"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each Spark partition.

A text is cut into runs that no merge crosses (white space with the word after it). Each distinct run of a
partition is split by the vocabulary's pattern; each distinct word that is no token itself becomes rows of
(word, position, token), which join the merge table again and again, the leftmost pair of the lowest rank being
contracted, until nothing changes. Decoding joins the ids with the vocabulary and concatenates in order.

Null and empty texts have no ids and decode to nothing. Repeated rows are encoded once each. Columns besides
id and text are ignored. Memory is bounded by the piece of text at hand, the cache of runs (cleared when full)
and DuckDB's own limit, all of which end with the task.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.batches import give_back, pieces, small_batches

#: Unicode white space, as the pattern's \s has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Runs kept with their ids, words encoded at once, bytes from which a word counts as long, ids decoded at once.
CACHE_RUNS = 250_000
WORDS_AT_ONCE = 20_000
LONG_WORD = 200
IDS_AT_ONCE = 300_000

#: All words at once, one merge per word and round; a word without a merge is done. Each row knows the token and the
#: place that follow it, so that a round needs joins by word only and sorts nothing.
SHORT_WORDS = """
WITH RECURSIVE state(word, pos, tok, nxtpos, nxt, done) AS (
  SELECT word, pos, tok, nxtpos, nxt, false FROM seed
  UNION ALL
  (WITH best AS (
     SELECT s.word, min(m.made::BIGINT * 4294967296 + s.pos * 65536 + s.nxtpos) AS k
     FROM state s JOIN merges m ON m.a = s.tok AND m.b = s.nxt WHERE NOT s.done GROUP BY s.word),
   places AS (
     SELECT word, (k >> 32)::INTEGER AS made, (k >> 16 & 65535)::INTEGER AS first, (k & 65535)::INTEGER AS second FROM best),
   hits AS (SELECT p.*, s.nxtpos, s.nxt FROM places p JOIN state s ON s.word = p.word AND s.pos = p.second)
   SELECT s.word, s.pos, CASE WHEN s.pos = h.first THEN h.made ELSE s.tok END,
     CASE WHEN s.pos = h.first THEN h.nxtpos ELSE s.nxtpos END,
     CASE WHEN s.pos = h.first THEN h.nxt WHEN s.nxtpos = h.first THEN h.made ELSE s.nxt END, h.word IS NULL
   FROM state s LEFT JOIN hits h ON h.word = s.word WHERE NOT s.done AND s.pos IS DISTINCT FROM h.second))
SELECT word, pos, tok FROM state WHERE done ORDER BY word, pos
"""

#: For long words, whose rows are updated in place. Where no pair with the made token can have a lower rank
#: (plain), all places of the lowest pair are contracted in one round, every other one where they overlap.
LONG_WORDS = """
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
  SELECT word, pos, tok FROM seed
  UNION
  (WITH live AS (
     SELECT word, pos, tok, lead(tok) OVER w AS nxt, lead(pos) OVER w AS nxtpos
     FROM recurring.state WHERE tok >= 0 AND word IN (SELECT word FROM state)
     WINDOW w AS (PARTITION BY word ORDER BY pos)),
   pairs AS (
     SELECT l.*, m.made, m.plain, min(m.made) OVER (PARTITION BY l.word) AS low
     FROM live l LEFT JOIN merges m ON m.a = l.tok AND m.b = l.nxt),
   firsts AS (
     SELECT *, min(CASE WHEN made = low THEN pos END) OVER (PARTITION BY word) AS first FROM pairs WHERE low IS NOT NULL),
   hits AS (SELECT *, coalesce(made = low AND (plain OR pos = first), false)::INTEGER AS hit FROM firsts),
   islands AS (SELECT *, sum(1 - hit) OVER (PARTITION BY word ORDER BY pos) AS island FROM hits),
   turns AS (SELECT *, sum(hit) OVER (PARTITION BY word, island ORDER BY pos) AS turn FROM islands),
   chosen AS (SELECT * FROM turns WHERE hit = 1 AND turn % 2 = 1)
   SELECT word, pos, made FROM chosen UNION ALL SELECT word, nxtpos, -1 FROM chosen))
SELECT word, pos, tok FROM state WHERE tok >= 0 ORDER BY word, pos
"""

DECODE = """
SELECT doc, string_agg(v.text, '' ORDER BY idx) AS text FROM ids JOIN vocabulary v USING (id) GROUP BY doc
"""


class Codec:
    """A vocabulary of ranks with its merge table in DuckDB, and the ids of the runs met so far."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.words = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "128MB"})
        made = [
            (a, b, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None
        ]
        lower = {part for a, b, rank in made for part in (a, b) if rank < part}
        a, b, rank = zip(*made) if made else ((), (), ())
        merges = pa.table({
            "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "made": pa.array(rank, pa.int32()),
            "plain": pa.array([x not in lower for x in rank], pa.bool_()),
        })
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "text": [t.decode("latin-1") for t in self.ranks]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.byte_ids = np.array([self.ranks.get(bytes([x]), -1) for x in range(256)], np.int32)
        self.runs: dict[str, bytes] = {}

    def _contract(self, words: list[bytes], query: str) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(word)) - np.repeat(ends - lengths, lengths)).astype(np.int32)
        tok = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        if (tok < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        nxt = np.append(tok[1:], np.int32(-1))
        nxt[ends - 1] = -1  # which no merge has
        self.db.register("seed", pa.table({"word": word, "pos": pos, "tok": tok, "nxtpos": pos + 1, "nxt": nxt}))
        done = self.db.sql(query).to_arrow_table()
        ids = done.column("tok").to_numpy().astype("<u4").tobytes()
        cuts = np.searchsorted(done.column("word").to_numpy(), np.arange(len(words) + 1)) * 4
        return [ids[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _learn(self, runs: set[str]) -> None:
        """Add the ids of new runs to the cache."""
        split = {run: [w.encode() for w in self.words.findall(run)] for run in runs}
        ids: dict[bytes, bytes] = {}
        short, long = [], []
        for word in {w for words in split.values() for w in words}:
            if (rank := self.ranks.get(word)) is not None:
                ids[word] = rank.to_bytes(4, "little")
            else:
                (short if len(word) < LONG_WORD else long).append(word)
        for start in range(0, len(short), WORDS_AT_ONCE):
            some = short[start : start + WORDS_AT_ONCE]
            ids.update(zip(some, self._contract(some, SHORT_WORDS)))
        for word in long:
            ids[word] = self._contract([word], LONG_WORDS)[0]
        for run, words in split.items():
            self.runs[run] = b"".join([ids[w] for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [RUNS.findall(text) for text in texts]
        if len(self.runs) > CACHE_RUNS:
            self.runs.clear()
        known = self.runs
        if new := {run for runs in found for run in runs if run not in known}:
            self._learn(new)
        return [b"".join([known[run] for run in runs]) for runs in found]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        start = 0
        while start < len(encoded):
            stop, size = start, 0
            while stop < len(encoded) and (stop == start or size + len(encoded[stop]) <= 4 * IDS_AT_ONCE):
                size += len(encoded[stop])
                stop += 1
            lengths = [len(x) // 4 for x in encoded[start:stop]]
            ids = np.frombuffer(b"".join(encoded[start:stop]), "<u4").astype(np.int32)
            doc = np.repeat(np.arange(stop - start, dtype=np.int32), lengths)
            self.db.register("ids", pa.table({"doc": doc, "idx": np.arange(len(ids), dtype=np.int32), "id": ids}))
            done = self.db.sql(DECODE).to_arrow_table()
            texts = dict(zip(done.column("doc").to_pylist(), done.column("text").to_pylist()))
            out += [texts.get(i, "").encode("latin-1") for i in range(stop - start)]
            start = stop
        return out

    def close(self) -> None:
        self.db.close()
        self.runs.clear()
        self.ranks.clear()


@contextmanager
def codec(path: str, pattern: str) -> Iterator[Codec]:
    """A codec for one task; worker processes outlive tasks and give its memory back here."""
    own = Codec(path, pattern)
    try:
        yield own
    finally:
        own.close()
        give_back()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): the ids as little-endian unsigned 32-bit integers, each row of ``docs`` once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as own:
            for batch in pieces(batches):
                ids = own.encode([text or "" for text in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    small_batches(docs.sparkSession)
    picked = docs.select(id_col, F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"{id_col} {picked.schema[0].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) of rows whose ids are packed as ``encode`` packs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as own:
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    some = batch.slice(start, 500)
                    texts = own.decode([ids or b"" for ids in some.column(1).to_pylist()])
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.binary())], names=[id_col, "bytes"])

    picked = encoded.select(id_col, ids_col)
    return picked.mapInArrow(run, f"{id_col} {picked.schema[0].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): texts encoded, and what their ids decode to, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as own:
            for batch in pieces(batches):
                ids = own.encode([text or "" for text in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(ids)]),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    small_batches(docs.sparkSession)
    picked = docs.select(id_col, F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"{id_col} {picked.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
