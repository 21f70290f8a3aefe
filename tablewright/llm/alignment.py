"""Alignment of two tokenizers' tokens over the same bytes, and how widely their pairs of tokens are linked.

A is a byte-level tokenizer file, B a SentencePiece model; both encode a space and the text. Divide and conquer finds the
byte offsets at which a token of both ends: in an interval of tokens between two such cuts, the end of the middle A token
is looked up among B's ends by bisection, then the next B end among A's and so on, first upwards, then downwards, until
both agree; the interval is divided there and both halves go on. An interval without a cut inside is a leaf group. All
intervals of a level are worked on together. Where no piece of B holds a space after something else, a lone space between
two words is a cut of both, so documents fall apart there and a word with its signs is encoded and divided once a
task; its groups and links are added up over the documents.

Links are the pairs of overlapping A and B tokens of a group. A chunk of documents (``CHUNK_BYTES`` of text; a longer
document is a chunk of its own) lists its distinct pairs once, with the documents that hold them; these lists are summed
over all chunks, which is the only shuffle of pairs, and each chunk gets the sums of its own list back. Documents keep
their links as places in the list of their chunk.

Null and empty texts, and those whose tokens do not spell the space and the text, have no tokens and zeros everywhere.
Rows with equal or null ids are documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.batches import pieces, small_batches
from tablewright.llm.runs import shared_encoder
from tablewright.session import keep

CHUNK_BYTES = 1 << 24
#: Parts kept with their groups, and bytes of parts that are aligned at once.
CACHE_PARTS, AT_ONCE = 500_000, 1 << 20
#: A lone space between two words: B puts a space before each segment, and no piece holds a space after something else.
LONE_SPACE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")

STATS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _bytes_of(ids: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes of a row of ids, joined."""
    lengths = offsets[ids + 1] - offsets[ids]
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - offsets[ids], lengths)]


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])


def cuts(a: np.ndarray, b: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into the sorted token ends ``a`` and ``b`` of the last tokens of every group.

    ``a_stop`` and ``b_stop``: where the tokens of each document stop, at one end in both.
    """
    a0, b0 = np.r_[0, a_stop[:-1]], np.r_[0, b_stop[:-1]]
    a1, b1 = a_stop, b_stop
    found_a, found_b = [a1 - 1], [b1 - 1]
    while len(a0):
        wide = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[wide], a1[wide], b0[wide], b1[wide]
        at_a, at_b = np.full(len(a0), -1), np.full(len(a0), -1)
        middle = (a0 + a1 - 2) // 2
        # upwards: an end of A, the first end of B not below it, the first end of A not below that, ...
        todo, i = np.arange(len(a0)), middle
        while len(todo):
            j = np.searchsorted(b, a[i])
            met = b[j] == a[i]
            at_a[todo[met]], at_b[todo[met]] = i[met], j[met]
            todo, j = todo[~met], j[~met]
            i = np.searchsorted(a, b[j])
            inside = i < a1[todo] - 1
            todo, i = todo[inside], i[inside]
        # downwards, where nothing above the middle is shared
        todo = np.flatnonzero(at_a < 0)
        i = middle[todo] - 1
        while True:
            inside = i >= a0[todo]
            todo, i = todo[inside], i[inside]
            if not len(todo):
                break
            j = np.searchsorted(b, a[i], side="right") - 1
            inside = j >= b0[todo]
            todo, i, j = todo[inside], i[inside], j[inside]
            met = b[j] == a[i]
            at_a[todo[met]], at_b[todo[met]] = i[met], j[met]
            todo, j = todo[~met], j[~met]
            i = np.searchsorted(a, b[j], side="right") - 1
        cut = at_a >= 0
        a0, a1, b0, b1, at_a, at_b = a0[cut], a1[cut], b0[cut], b1[cut], at_a[cut] + 1, at_b[cut] + 1
        found_a.append(at_a - 1)
        found_b.append(at_b - 1)
        a0, a1, b0, b1 = np.r_[a0, at_a], np.r_[at_a, a1], np.r_[b0, at_b], np.r_[at_b, b1]
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.a = shared_encoder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.IdToPiece(i) for i in range(self.b.GetPieceSize())]
        spelled = [bytes([int(n[3:5], 16)]) if self.b.IsByte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.segments_apart = not any(re.search("[^▁]▁", n) for n in names)
        self.a_bytes, self.b_bytes = _table(self.a.token_bytes()), _table(spelled)
        self.b_size = len(names)
        n_a = len(self.a_bytes[1]) - 1
        self.words = [f"{i}{end}" for i in range(n_a) for end in ",|"] + [f"{i}{end}" for i in range(self.b_size) for end in (",", ";", "")]
        self.b_first = 2 * n_a
        self.pairs = n_a * self.b_size  # codes of pairs are below
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.spelled: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)
        self.valid = np.zeros(0, bool)
        self.codes, self.code_stop = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _parts(self, text: str) -> list[str]:
        """What lies between lone spaces."""
        return LONE_SPACE.split(text) if self.segments_apart else [text]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of a space and each text by A and by B, as little-endian 32-bit integers."""
        return self.a.encode([" " + text for text in texts]), [array("I", ids).tobytes() for ids in self.b.encode(texts, num_threads=1)]

    def _learn(self, parts: list[str]) -> None:
        sizes, valid, spelled, stop, codes = self._divided(parts)
        self.place.update(zip(parts, range(len(self.spelled), len(self.spelled) + len(parts))))
        self.spelled += spelled
        self.sizes, self.valid, self.codes = np.r_[self.sizes, sizes], np.r_[self.valid, valid], np.r_[self.codes, codes]
        self.code_stop = np.r_[self.code_stop, stop + self.code_stop[-1]]

    def align(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups_sha256) of each text; of its distinct pairs: text, code, occurrences."""
        if len(self.place) > CACHE_PARTS:
            self._forget()
        parts = [self._parts(text) if text else [] for text in texts]
        known = self.place
        new, held = [], 0
        for part in dict.fromkeys(p for some in parts for p in some if p not in known):
            new.append(part)
            held += len(part)
            if held > AT_ONCE:
                self._learn(new)
                new, held = [], 0
        if new:
            self._learn(new)
        at = np.array([known[p] for some in parts for p in some], np.int64)
        counts = np.array([len(some) for some in parts], np.int64)
        text = np.repeat(np.arange(len(texts)), counts)
        whole = (np.bincount(text, ~self.valid[at], minlength=len(texts)) == 0) & (counts > 0)
        kept = whole[text]
        text, at = text[kept], at[kept]
        sums = np.zeros((len(texts), 4), np.int64)
        np.add.at(sums, text, self.sizes[at])
        stats: list[tuple] = [(0, 0, 0, 0, "")] * len(texts)
        stops = np.searchsorted(text, np.arange(len(texts)), side="right").tolist()
        places = at.tolist()
        for i in np.flatnonzero(whole).tolist():
            spelled = ";".join([self.spelled[k] for k in places[stops[i - 1] if i else 0 : stops[i]]])
            stats[i] = (*sums[i].tolist(), hashlib.sha256(spelled.encode()).hexdigest())
        count = self.code_stop[at + 1] - self.code_stop[at]
        ends = np.cumsum(count)
        codes = self.codes[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - self.code_stop[at], count)]
        keys, occurrences = np.unique(np.repeat(text, count) * self.pairs + codes, return_counts=True)
        return stats, keys // self.pairs, keys % self.pairs, occurrences

    def _divided(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text: (n_a, n_b, n_groups, n_links), whether both spell it, its groups in writing; where the codes of its links stop, the codes."""
        ids_a, ids_b = self.encode(texts)
        whole = [(" " + text).encode() for text in texts]
        a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (ids_a, ids_b))
        a_stop, b_stop = (np.cumsum([len(x) // 4 for x in ids]) for ids in (ids_a, ids_b))
        byte_stop = np.cumsum([len(x) for x in whole])
        text_bytes = np.frombuffer(b"".join(whole), np.uint8)
        valid = np.ones(len(texts), bool)
        for ids, stop, (flat, offsets) in ((a, a_stop, self.a_bytes), (b, b_stop, self.b_bytes)):
            spelled = _bytes_of(ids, flat, offsets)
            upto = np.r_[0, np.cumsum(offsets[ids + 1] - offsets[ids])][stop]
            same = np.diff(upto, prepend=0) == np.diff(byte_stop, prepend=0)
            if len(spelled) == len(text_bytes) and same.all():
                wrong = np.flatnonzero(spelled != text_bytes)
                same[np.searchsorted(byte_stop, wrong, side="right")] = False
            else:
                for i in np.flatnonzero(same):
                    start = upto[i - 1] if i else 0
                    same[i] = spelled[start : upto[i]].tobytes() == whole[i]
            valid &= same
        kept = np.flatnonzero(valid)
        if len(kept) < len(texts):
            a, b = (np.concatenate([np.zeros(0, np.int64), *(x[s[i - 1] if i else 0 : s[i]] for i in kept)]) for x, s in ((a, a_stop), (b, b_stop)))
            a_stop, b_stop = (np.cumsum(np.diff(s, prepend=0)[kept]) for s in (a_stop, b_stop))
        sizes, spelled, stop = np.zeros((len(texts), 4), np.int64), [""] * len(texts), np.zeros(len(texts), np.int64)
        if not len(kept):
            return sizes, valid, spelled, stop, np.zeros(0, np.int64)
        a_ends, b_ends = (np.cumsum(offsets[ids + 1] - offsets[ids]) for ids, (_, offsets) in ((a, self.a_bytes), (b, self.b_bytes)))
        last_a, last_b = cuts(a_ends, b_ends, a_stop, b_stop)
        group_stop = np.searchsorted(last_a, a_stop - 1) + 1
        # ids in the order of the groups, each with the sign after it
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[last_a], end_b[last_b] = 1, 1
        end_b[b_stop - 1] = 2
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        signs = np.empty(len(a) + len(b), np.int64)
        signs[np.arange(len(a)) + np.repeat(last_b + 1 - in_b, in_a)] = 2 * a + end_a
        signs[np.arange(len(b)) + np.repeat(last_a + 1, in_b)] = self.b_first + 3 * b + end_b
        # tokens of A with the first and the last token of B over their bytes
        first = np.searchsorted(b_ends, np.r_[0, a_ends[:-1]], side="right")
        count = np.searchsorted(b_ends, a_ends) + 1 - first
        ends = np.cumsum(count)
        other = np.arange(ends[-1]) + np.repeat(first - ends + count, count)
        sizes[kept] = np.stack([np.diff(x, prepend=0) for x in (a_stop, b_stop, group_stop, ends[a_stop - 1])], axis=1)
        start = 0
        for i, (n_a, n_b) in zip(kept.tolist(), sizes[kept, :2].tolist()):
            spelled[i] = "".join([self.words[k] for k in signs[start : start + n_a + n_b].tolist()])
            start += n_a + n_b
        return sizes, valid, spelled, np.cumsum(sizes[:, 3]), np.repeat(a * self.b_size, count) + b[other]


def _chunk(number: int, ids: list[pa.Array], stats: list[tuple], owner: list[np.ndarray], code: list[np.ndarray], count: list[np.ndarray]) -> pa.RecordBatch:
    """A row a document; the first also holds the pairs of the chunk and the documents that hold each."""
    codes, where = np.unique(np.concatenate(code), return_inverse=True)
    links = np.stack([where, np.concatenate(count)], axis=1).astype("<u4")
    stop = np.searchsorted(np.concatenate(owner), np.arange(len(stats)), side="right").tolist()
    n_a, n_b, n_groups, n_links, sha = zip(*stats)
    empty = [None] * (len(stats) - 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number] * len(stats), pa.int64()), pa.concat_arrays(ids),
            *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)), pa.array(sha),
            pa.array([links[i:j].tobytes() for i, j in zip([0, *stop], stop)], pa.binary()),
            pa.array([codes, *empty], pa.list_(pa.int64())),
            pa.array([np.bincount(where, minlength=len(codes)), *empty], pa.list_(pa.int64())),
        ],
        names=["chunk", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "codes", "held"],
    )


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, id, n_a, n_b, n_groups, n_links, groups_sha256, links, codes, held): documents in chunks.

    ``links`` are pairs of 32-bit numbers, the place in the chunk's list and the occurrences; ``codes`` and ``held`` are that
    list, on one row of the chunk; a code is A's id times the size of B's vocabulary plus B's id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = Aligner(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        parts: tuple[list, ...] = ([], [], [], [], [])
        held = 0
        for batch in pieces(batches):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            stats, owner, code, count = aligner.align(texts)
            new = (batch.column(0), stats, owner + len(parts[1]), code, count)
            for part, more in zip(parts, new):
                part.extend(more) if part is parts[1] else part.append(more)
            held += sum(map(len, texts))
            if held >= CHUNK_BYTES:
                yield _chunk(number, *parts)
                number, held, parts = number + 1, 0, ([], [], [], [], [])
        if parts[1]:
            yield _chunk(number, *parts)

    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    id_type = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"chunk long, id {id_type}, {STATS}, links binary, codes array<long>, held array<long>")


def pair_counts(chunks: DataFrame, b_size: int) -> DataFrame:
    """(code, count, best): the documents that hold each linked pair, and whether it is among the highest of its A id.

    An A id has at most as many pairs as B has ids, so the window is bounded by the vocabulary.
    """
    counts = chunks.where("codes IS NOT NULL").select(F.explode(F.arrays_zip("codes", "held")).alias("p"))
    counts = counts.groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.held").alias("count"))
    of_a = Window.partitionBy(F.floor(F.col("code") / b_size))
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_a))


def summary(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).GetPieceSize()
    chunks = keep(aligned(docs, a_path, b_path, id_col, text_col))
    listed = chunks.where("codes IS NOT NULL").select("chunk", F.posexplode("codes").alias("place", "code"))
    counted = listed.join(pair_counts(chunks, b_size).hint("shuffle_hash"), "code").select(F.col("chunk").alias("of_chunk"), "place", "count", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy().astype(np.int64)
        sums, bests = [], []
        for links in left.column("links").to_pylist():
            at, n = np.frombuffer(links, "<u4").reshape(-1, 2).T.astype(np.int64)
            sums.append(int((count[at] * n).sum()))
            bests.append(int((best[at] * n).sum()))
        columns = {id_col: left.column("id"), **{name: left.column(name) for name in ("n_a", "n_b", "n_groups", "n_links")}}
        return pa.table({**columns, "n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups_sha256": left.column("groups_sha256")})

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    own = chunks.drop("codes", "held")
    return own.groupBy("chunk").cogroup(counted.groupBy("of_chunk")).applyInArrow(run, schema)
