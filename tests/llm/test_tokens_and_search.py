"""Brute-force versions of lexical search, token alignment and token files, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablewright.llm import alignment, lexical, runs, token_files
from tablewright.llm.queries import BYTE_LEVEL, PIECE_MODEL

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "A b c " * 40), (6, LONG), (7, LONG), (7, LONG), (None, "no id word"), (None, None),
    (8, "x" * 5000), (9, "é日本😀\x00  z"), (10, "a ▁ b"), (11, "<|endoftext|> <s> </s>"), (12, "  two  spaces "), (13, "word Word, WORD!"),
]
CLASH = "doc_id long, text string, id string, row long, score double, n long, term string, chunk long, start string, part string, codes int"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2.0, 3, "y", 4, "z", "p", 5) for i, t in EDGES], CLASH)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(BYTE_LEVEL)
    tokenizer.encode_special_tokens = True
    return tokenizer


def odd_texts(count, seed):
    rng = random.Random(seed)
    signs = [chr(c) for c in (*range(0, 127), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x3000, 0xC0, 0xD7, 0xE9, 0x4E00, 0x1F600, 0x2581, 0x180E)]
    return ["".join(rng.choice(signs) for _ in range(60)) for _ in range(count)] + ["".join(rng.choice("ab  é\n.,'") for _ in range(60)) for _ in range(count)]


def test_runs_equal_the_library(library):
    encoder = runs.RunEncoder(BYTE_LEVEL)
    texts = [t or "" for _, t in EDGES] + odd_texts(400, 3)
    assert encoder.by_runs
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    names = encoder.token_bytes()
    assert b"".join(names[i] for i in library.encode("é日 a\n\x00").ids) == "é日 a\n\x00".encode()


# ---- search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranking(docs, items, top):
    """{row of items: [(id, score)]} by scoring every document."""
    split = [words_of(t) for _, t in docs]
    n_docs, n_terms = sum(map(bool, split)), sum(map(len, split))
    df = Counter(w for words in split for w in set(words))
    out = []
    for key, text in items:
        scored = []
        for (doc, _), words in zip(docs, split):
            tf = Counter(words)
            m = 50 + 50 * len(words) * n_docs // n_terms if n_terms else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m)) for w in set(words_of(text)) if tf[w]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out.append((key, [(None if none else doc, -score) for score, none, doc in sorted(scored)[:top]]))
    return out


def answer(found, item_col="item_id", id_col="doc_id"):
    rows = sorted(found.collect(), key=lambda r: (repr(r[item_col]), r["rank"]))
    out = []
    for r in rows:
        if r["rank"] == 1 or not out or out[-1][0] != r[item_col]:
            out.append((r[item_col], []))
        out[-1][1].append((r[id_col], r["score"]))
    return sorted(out, key=repr)


def some_docs(rng, count, vocabulary):
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))) for i in range(count)]


@pytest.mark.parametrize("block_terms", [8, 1 << 15])
def test_search_equals_scoring_everything(spark, monkeypatch, block_terms):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block_terms)
    rng = random.Random(1)
    vocabulary = [f"t{i}" for i in range(60)] + ["É", "日本"]
    docs = some_docs(rng, 600, vocabulary) + EDGES
    docs += [(1000 + i, "t1 t5 t30 t31") for i in range(130)] + [(None, "t1 t5 t30 t31")] * 3  # equal scores, more than asked for
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 15)))) for i in range(6)]
    items += [(100, "T1, t5-t30!"), (101, ""), (102, None), (103, "unknown"), (None, "word w5")]
    given = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    want = sorted(((k, rows) for k, rows in ranking(docs, items, 50) if rows), key=repr)
    assert answer(lexical.ranked(given, asked)) == want


def test_search_edges(spark, edges):
    items = spark.createDataFrame([(1, "word", 0), (2, "WORD spaces", 0)], "item_id long, text string, rank int")
    assert answer(lexical.ranked(edges, items, top=3)) == sorted(ranking(EDGES, [(1, "word"), (2, "WORD spaces")], 3), key=repr)
    assert lexical.ranked(edges.where("false"), items).count() == 0
    for no_items in (items.where("false"), items.where("text = 'none'"), spark.createDataFrame([(1, "...")], "item_id long, text string")):
        empty = lexical.ranked(edges, no_items)
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0
    twice = spark.createDataFrame([(1, "word"), (1, "word")], "item_id long, text string")
    assert lexical.ranked(edges, twice, top=2).count() == 4


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_tree_bounds_hold_and_prune(monkeypatch, leaf):
    monkeypatch.setattr(lexical, "LEAF_DOCS", leaf)
    rng = np.random.default_rng(leaf)
    n, v = 500, 40
    rows = [np.sort(rng.choice(v, rng.integers(1, 12), replace=False)) for _ in range(n - 60)] + [np.arange(5)] * 60
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])]
    term = np.concatenate(rows)
    tf, m, rank = rng.integers(1, 9, len(term)), rng.integers(50, 90, n), rng.permutation(v)
    tree = lexical.Tree(offsets, term, tf, m, rank)
    assert sorted(tree.rows.tolist()) == list(range(n))
    gain = 10**9 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(offsets)))
    matrix = np.zeros((n, v), np.int64)
    matrix[np.repeat(np.arange(n), np.diff(offsets)), term] = gain
    leaves = 0
    for node, below in enumerate(tree.children):
        lo, hi = tree.lo[node], tree.hi[node]
        assert (tree.reach[node] >= matrix[tree.rows[lo:hi]].max(axis=0)).all()
        if below:
            assert [tree.lo[below[0]], tree.hi[below[-1]]] == [lo, hi] and all(tree.hi[a] == tree.lo[b] for a, b in zip(below, below[1:]))
        else:
            leaves += 1
            assert hi - lo <= leaf or len(set(tree.paths[lo:hi])) == 1
    item, weight = np.array([3, 7, 11]), np.array([500, 900, 1200])
    scores, seen, best = matrix[:, item] @ weight, [], []

    def found(at, some):
        seen.append(len(at))
        best.extend(some.tolist())
        best.sort(reverse=True)
        del best[10:]
        return best[-1] if len(best) == 10 else 1

    tree.search(item, weight, 1, found)
    assert best == sorted(scores.tolist(), reverse=True)[:10]
    if leaf < 32:
        assert len(seen) < leaves / 2  # whole subtrees were left out


# ---- alignment


def spelled(library, pieces, text):
    """Tokens (id, start, stop) of both tokenizers over a space and the text; none if they do not spell it."""
    names = runs.RunEncoder(BYTE_LEVEL).token_bytes() if not hasattr(spelled, "names") else spelled.names
    spelled.names = names
    if not text:
        return [], []
    whole, out = (" " + text).encode(), []
    piece = lambda i: bytes([int(pieces.IdToPiece(i)[3:5], 16)]) if pieces.IsByte(i) else pieces.IdToPiece(i).replace("▁", " ").encode()
    for ids, name in ((library.encode(" " + text, add_special_tokens=False).ids, names.__getitem__), (pieces.encode(text), piece)):
        tokens, at = [], 0
        for i in ids:
            tokens.append((i, at, at + len(name(i))))
            at = tokens[-1][2]
        if b"".join(name(i) for i in ids) != whole:
            return [], []
        out.append(tokens)
    return out


def linked(a, b):
    """All overlapping pairs, without looking at every pair of tokens."""
    out, j = Counter(), 0
    for i, start, stop in a:
        while b[j][2] <= start:
            j += 1
        k = j
        while k < len(b) and b[k][1] < stop:
            out[i, b[k][0]] += 1
            k += 1
    return out


def grouped(a, b):
    shared = sorted({x[2] for x in a} & {x[2] for x in b})
    side = lambda tokens: np.split([x[0] for x in tokens], np.searchsorted([x[2] for x in tokens], shared, side="right")[:-1])
    parts = [",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in zip(side(a), side(b))]
    return len(shared), hashlib.sha256(";".join(parts).encode()).hexdigest()


def test_alignment_equals_brute_force(spark, edges, library):
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    docs = EDGES + [(100 + i, t) for i, t in enumerate(odd_texts(60, 8))] + [(500 + i, "the theory of tokens, and words") for i in range(5)]
    tokens = [spelled(library, pieces, t) for _, t in docs]
    links = [linked(a, b) if a else Counter() for a, b in tokens]
    count = Counter(pair for some in links for pair in some)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    want = []
    for (key, _), (a, b), some in zip(docs, tokens, links):
        groups, sha = grouped(a, b) if a else (0, "")
        n_best = sum(n for (x, y), n in some.items() if count[x, y] == best[x])
        want.append((key, len(a), len(b), groups, sum(some.values()), n_best, sum(n * count[p] for p, n in some.items()), sha))
    more = spark.createDataFrame(docs[len(EDGES) :], "doc_id long, text string")
    given = edges.select("doc_id", "text").union(more).repartition(3).selectExpr("*", "1 AS chunk", "'x' AS id", "2 AS links")
    got = [tuple(r) for r in alignment.summary(given, BYTE_LEVEL, PIECE_MODEL).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] == 0 for r in want) > 10  # texts that B does not spell
    assert alignment.summary(edges.where("false"), BYTE_LEVEL, PIECE_MODEL).count() == 0


def test_parts_change_nothing(monkeypatch):
    texts = odd_texts(200, 5) + ["a b  c   d e f ", LONG[:3000], "", "a b  c"]
    apart, whole = (alignment.Aligner(BYTE_LEVEL, PIECE_MODEL) for _ in range(2))
    whole.segments_apart = False
    assert apart.segments_apart and len(apart._parts(LONG[:3000])) > 100
    monkeypatch.setattr(alignment, "AT_ONCE", 50)
    monkeypatch.setattr(alignment, "CACHE_PARTS", 20)
    one, other = apart.align(texts), whole.align(texts)
    assert one[0] == other[0] and all(np.array_equal(x, y) for x, y in zip(one[1:], other[1:]))
    again = apart.align(texts[::-1])
    assert again[0] == one[0][::-1]


def test_cuts_of_random_ends():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 60, 400):
        for _ in range(40):
            docs = [(np.unique(np.r_[rng.integers(1, size + 1, rng.integers(1, size + 1)), size]), np.unique(np.r_[rng.integers(1, size + 1, rng.integers(1, size + 1)), size])) for _ in range(4)]
            a, b = (np.concatenate([d[k] + size * i for i, d in enumerate(docs)]) for k in (0, 1))
            stops = [np.cumsum([len(d[k]) for d in docs]) for k in (0, 1)]
            last_a, last_b = alignment.cuts(a, b, *stops)
            assert a[last_a].tolist() == b[last_b].tolist() == np.intersect1d(a, b).tolist()


# ---- token files


@pytest.mark.parametrize("length", [8, 2048])
def test_token_files_equal_the_library(edges, library, length):
    got = token_files.round_trip(edges, BYTE_LEVEL, length=length).collect()
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((i for i, _ in EDGES), key=lambda i: (i is not None, i))
    want = Counter()
    for key, text in EDGES:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[key, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    sizes = [r.n_tokens for r in order]
    assert [r.start for r in order] == [sum(sizes[:i]) for i in range(len(sizes))]
    assert token_files.round_trip(edges.where("false"), BYTE_LEVEL).count() == 0


def test_sequences_are_views_of_the_file(spark, edges, library, tmp_path):
    texts = spark.createDataFrame([(f"k{i:03d}", "word " * i) for i in range(400)], "key string, body string").repartition(3)
    manifest = token_files.write(texts, BYTE_LEVEL, str(tmp_path), length=16, id_col="key", text_col="body").orderBy("part").collect()
    assert sum(r.n_docs for r in manifest) == 400 and [r.start for r in manifest] == [sum(x.n_tokens for x in manifest[:i]) for i in range(len(manifest))]
    assert not [f for f in tmp_path.iterdir() if not f.name.endswith(".arrow")]  # no drafts
    ids = []
    for row in manifest:
        file = token_files.TokenFile(row.file)
        assert len(file) == -(-row.n_tokens // 16)
        before = pa.total_allocated_bytes()
        some = [file[i] for i in range(len(file))]
        assert pa.total_allocated_bytes() == before  # nothing was copied
        assert not some[0][0].flags.owndata and some[0][0].dtype == np.uint16
        mask = np.concatenate([m.to_numpy(zero_copy_only=False) for _, m in some])
        assert mask.sum() == row.n_tokens and mask[: row.n_tokens].all()
        ids += np.concatenate([x for x, _ in some])[mask].tolist()
        with pytest.raises(IndexError):
            file[len(file)]
    want = [x for i in range(400) for x in (*library.encode("word " * i, add_special_tokens=False).ids, 0)]
    assert ids == want
