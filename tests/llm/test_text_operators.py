"""Brute-force versions, round trips and edge cases of the text operators."""

import hashlib
import random
import re
import struct
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tablewright.llm import byte_bpe, chat_format, decontaminate, license_scan, near_copies, pseudonyms, quality_bayes, repetition, sharding, simhash_dedup, url_filter
from tablewright.llm.queries import KEY, RANKS, RULES

#: Null, empty, blank, one word, repeated, very long and control-laden texts; ids with a null and a repeat.
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "a b c " * 40), (6, LONG), (7, LONG), (7, LONG), (None, "no id"), (8, "x" * 5000), (9, "é日本😀\x00 \u2003z")]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, 1, "en", "s") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, fp long, lang string, source string")


@pytest.fixture(scope="module")
def nothing(edges):
    return edges.where("false")


def test_bpe_equals_the_library(spark, edges, nothing):
    codec = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(5)
    signs = [chr(c) for c in (*range(9, 14), *range(28, 127), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x3000, 0xE9, 0x4E00, 0x1F600)]
    texts = [t or "" for _, t in EDGES] + ["".join(rng.choice(signs) for _ in range(80)) for _ in range(300)] + ["ab" * 600, "a" * 777]
    ids = codec.encode(texts)
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in ids] == [own.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]
    got = byte_bpe.round_trip(edges, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in EDGES)
    again = byte_bpe.decode(byte_bpe.encode(edges, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.bytes) for r in again.collect()) == sorted((t or "").encode() for _, t in EDGES)
    assert byte_bpe.round_trip(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def linked(values):
    """Smallest index of each value's component of values within two bits."""
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("node_rows", [16, 1024])
def test_simhash_links_are_complete(spark, monkeypatch, node_rows):
    monkeypatch.setattr(simhash_dedup, "NODE_ROWS", node_rows)
    rng, values = random.Random(2), []
    centre = rng.getrandbits(64)
    for _ in range(150):  # a dense ball, chains and strangers
        x = centre
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        y = rng.getrandbits(64)
        values += [x, y, y ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))]
    values = list(dict.fromkeys(values))
    frame = spark.createDataFrame([(simhash_dedup._signed(x),) for x in values], "fp long")
    roots = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.links(frame)).collect()}
    mine = [roots.get(simhash_dedup._signed(x), simhash_dedup._signed(x)) for x in values]
    assert len(set(zip(mine, linked(values)))) == len(set(mine)) == len(set(linked(values)))


def test_simhash_links_hook_roots_only():
    def parts(values):
        a, b = simhash_dedup.links_within(np.zeros(len(values), np.int64), np.array(values, np.uint64))
        label = list(range(len(values)))
        for x, y in zip(a.tolist(), b.tolist()):
            low, high = sorted((label[x], label[y]))
            label = [low if z == high else z for z in label]
        return label

    def gray(x):
        for shift in (1, 2, 4, 8, 16, 32):
            x ^= x >> shift
        return x

    chain = [sum(3 << 2 * i for i in range(k)) for k in range(9)]  # neighbours two bits apart, others four or more
    assert parts([chain[(1, 3, 5, 7, 2, 8, 6, 4, 0).index(place)] for place in range(9)]) == [0] * 9
    rng = random.Random(8)
    for turn in range(600):
        values = []
        for _ in range(rng.randrange(1, 4)):
            x, bits = rng.getrandbits(64), rng.sample(range(64), 64)
            values.append(x)
            for i in range(rng.randrange(32)):
                x ^= (1 << bits[2 * i]) | (1 << bits[2 * i + 1])
                values.append(x)
        values = list(dict.fromkeys(values))
        values.sort(key=gray) if turn % 2 else rng.shuffle(values)
        assert parts(values) == linked(values)


def test_simhash_edges(edges, nothing):
    got = {(r.doc_id, r.component_id) for r in simhash_dedup.groups(edges).collect()}
    assert {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)} <= got
    assert simhash_dedup.groups(nothing).count() == 0


def test_repetition_against_counting(edges, nothing):
    rng = random.Random(1)
    docs, words = [], []
    for d in range(40):
        own = [rng.randrange(4) for _ in range(rng.randrange(60))]
        docs += [d] * len(own)
        words += own
    repeats = repetition.longest_repeats(np.array(docs), np.array(words))
    for i, d in enumerate(docs):
        stop = max(j for j, e in enumerate(docs) if e == d) + 1
        best = 0
        for j in (j for j, e in enumerate(docs) if e == d and j != i):
            n = 0
            while max(i, j) + n < stop and words[i + n] == words[j + n]:
                n += 1
            best = max(best, n)
        assert repeats[i] == best
    got = {(r.doc_id, r.n_words, r.n_repeat_words, r.base_failed) for r in repetition.judge(edges).collect()}
    assert {(1, 0, 0, True), (5, 120, 120, True), (6, 60_000, 60_000, True), (8, 1, 0, True)} <= got
    assert repetition.judge(nothing).count() == 0


def test_license_scan(spark, edges, nothing):
    texts = ["All rights reserved, ALL RIGHTS RESERVED", "x CC-BY-NC 4.0 y", "Licensed under the Apache License, Version 2.0.", "gnu general public", "all all rights reserved"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(edges.select("doc_id", "text"))
    got = {r.doc_id: r for r in license_scan.summary(license_scan.scan(frame)).where("doc_id < 5").collect() if r.n_words}
    phrases = {tuple(p.split()): label for p, label in license_scan.PHRASES.items()}
    for i, text in enumerate(texts[:4]):
        words = re.findall(r"[0-9a-z]+", text.lower())
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        if i in got and i != 4:
            r = got[i]
            assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
    assert got[2].labels == "apache-2.0" and got[2].score == 1.0
    assert license_scan.scan(nothing).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(3)
    parts = ["\\", "#", "###", "### ", "</turn>", " </turn>\n", ": ", ":", "\n", "x", " "]
    turns = [("".join(rng.choice(parts) for _ in range(rng.randrange(6))), "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for _ in range(2000)]
    assert chat_format.read_turns("".join(chat_format.marked(*t)[0] for t in turns)) == turns
    for role, text in turns:
        whole, start, end = chat_format.marked(role, text)
        assert chat_format.unescape(whole[start:end]) == text
    rows = spark.createDataFrame([(None, None, None, None), (1, 1, "assistant", None), (1, 0, "user", "u"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = {r.conv: (r.n_turns, r.loss_chars) for r in chat_format.digests(chat_format.format_turns(rows)).collect()}
    assert got == {None: (1, 0), 1: (3, 0)}
    assert chat_format.digests(chat_format.format_turns(rows.where("false"))).count() == 0


def test_chat_layouts(spark):
    frame = spark.createDataFrame(
        [
            (1, "p", "r", None, None, None, [("x", "y")]), (2, None, None, "i", "more", "o", None), (3, None, None, None, None, None, [("human", "hi"), ("gpt", None)]),
            (4, None, None, None, None, None, [("human", "hi"), ("gpt", "yo")]), (5, "p", None, None, None, None, None),
        ],
        "id int, prompt string, response string, instruction string, input string, output string, conversations array<struct<from: string, value: string>>",
    )
    got = {r.id: (r._mapping, [tuple(t) for t in r._turns]) for r in chat_format.canonical_turns(frame).collect()}
    assert got[2] == ("instruction", [("user", "i\nmore"), ("assistant", "o")])
    assert got[4] == ("from and value", [("user", "hi"), ("assistant", "yo")])
    assert got[1] == (None, []) and got[5] == (None, [])


def test_url_rules_and_list(spark):
    urls = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12", None, "no scheme", "http://x.com/fr/", "http://notcom/fr/", "http://www.bad.net/a/?utm_x=1&b=2&a=1#f", "x://com"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(6, urls[6])], "page_id long, url string")
    listed = spark.createDataFrame([("bad.net/a?a=1&b=2",), (None,)], "canonical string")
    got = [(r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, listed, RULES).collect()]
    assert Counter(got) == Counter(
        [(0, "example.org/es/", "block"), (1, "example.org/en/1", "block"), (2, None, "allow"), (3, None, "allow"), (4, "com/fr/", "allow"), (5, None, "allow"), (7, None, "allow")] + 2 * [(6, None, "block")]
    )
    # a filter of one block lets everything through; the exact join still decides
    assert Counter(r.verdict for r in url_filter.judge(pages, listed, RULES, blocks=1).collect()) == Counter(v for _, _, v in got)
    assert url_filter.judge(pages, listed.where("false"), []).where("verdict = 'block'").count() == 0


def test_shards(spark, edges, nothing):
    rows = [(i, "x" * (i % 50)) for i in range(3000)] + [(-1, "y" * 5000)] + [(-2, "z" * 90)] * 40
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=1000).collect()
    assert len(got) == len(rows)
    sums, n = Counter(), Counter()
    for r in got:
        sums[r.depth, r.bucket, r.page] += r.bytes
        n[r.depth, r.bucket, r.page] += 1
    assert all(size <= 1000 or n[shard] == 1 for shard, size in sums.items())
    assert all(r.shard_bytes == sums[r.depth, r.bucket, r.page] for r in got)
    assert sharding.shards(edges).count() == len(EDGES) and sharding.shards(nothing).count() == 0


def test_pseudonyms(edges, nothing):
    for size in (1, 2, 10, 255, 1000):
        assert sorted(pseudonyms.permute(v, size, KEY, "t") for v in range(size)) == list(range(size))
    text = "mail ab.12@mail8.example.com, 10.0.0.1 +1 (456) 555-2186 4279055890764913 2024-02-29 2023-02-29 999.1.1.1 4279055890764914"
    hidden, n = pseudonyms.hide(text, KEY)
    assert n == 5 and len(re.findall("2023-02-29|999.1.1.1|4279055890764914", hidden)) == 3
    assert not re.search(r"ab\.12@|10\.0\.0\.1|555-2186|4279055890764913|2024-02-29", hidden)
    card = re.search(r"\b\d{16}\b", hidden)[0]
    assert pseudonyms.luhn_digit(card[:-1]) == card[-1] and pseudonyms.hide(text, KEY) == (hidden, n) and pseudonyms.hide(text, b"other")[0] != hidden
    out = pseudonyms.pseudonymise(edges, KEY)
    assert out.columns == edges.columns and Counter(map(tuple, out.collect())) == Counter(map(tuple, edges.collect()))
    assert pseudonyms.pseudonymise(nothing, KEY).count() == 0


def test_pseudonyms_of_cards_among_other_digits():
    card = "4111111111111111"
    new = pseudonyms.hide(card, KEY)[0]
    assert new != card and len(new) == 16 and pseudonyms.luhn_digit(new[:-1]) == new[-1]
    for before in ("", "no 7 ", "7-", "12 34 56 ", "1234 5678 ", "1111-"):
        for after in ("", " 12/27", "-123", " 123 4", " 12 27 2024", " 1111 2222 3333 4444 5555"):
            assert new in pseudonyms.hide(before + card + after, KEY)[0], (before, after)
    spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
    for text in ("7 {} 12 1", "{} 123", "1234 5678 {} 99", "5-{}-5"):
        assert text.format(" ".join(new[i : i + 4] for i in range(0, 16, 4))) == pseudonyms.hide(text.format(spaced), KEY)[0]
    assert pseudonyms.hide(f"{card} {card}-{card}", KEY) == (f"{new} {new}-{new}", 3)
    assert pseudonyms.hide(f"{card} 031-12-2024", KEY)[0].startswith(new + " ") and "031-12-2024" not in pseudonyms.hide(f"{card} 031-12-2024", KEY)[0]
    # other forms within, or from, a run of digits
    for value in ("2024-12-31", "31.12.2024", "12/31/2024", "456 555 2186", "0123456789" * 4, "1234567890123@x.com"):
        got, n = pseudonyms.hide(f"7 {card} {value} 8", KEY)
        assert n == 2 and new in got and value not in got and pseudonyms.hide(value, KEY)[0] in got, value
    assert pseudonyms.hide("12345678901234 " * 3, KEY)[1] == 0


def test_pseudonyms_of_month_first_dates():
    values = [f"{m:02}/{d:02}/{y}" for y in (1999, 2024) for m in range(1, 13) for d in range(1, 32)]
    values += [f"{d:02}/{m:02}/{y}" for y in (1999, 2024) for m in range(1, 13) for d in range(13, 32)]
    hidden = {v: pseudonyms.hide(v, KEY) for v in set(values)}
    assert hidden["12/31/2024"][1] == 1 and hidden["02/30/2024"] == ("02/30/2024", 0) and hidden["31/12/2024"][1] == 1
    assert len({new for new, _ in hidden.values()}) == len(hidden)
    month, day, _ = hidden["12/31/2024"][0].split("/")
    assert 1 <= int(month) <= 12 < int(day) <= 31
    assert pseudonyms.hide("12.31.2024", KEY)[0] == hidden["12/31/2024"][0].replace("/", ".")


def test_quality(spark, edges, nothing):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(40)) + "." for _ in range(150)]
    bad = ["BUY!! " * 30 + str(i) for i in range(50)]
    docs = spark.createDataFrame([(i, t, "s%d" % (i % 7), "en") for i, t in enumerate(good + bad)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 200, 2)] + [(0, None), (None, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r.kept for r in quality_bayes.scored(docs, labels).collect()}
    held_out = [rows[i] == (i < 150) for i in range(1, 200, 2)]
    assert sum(held_out) >= 98
    assert {r.doc_id for r in quality_bayes.drop_poor(docs, labels).collect()} == {i for i, k in rows.items() if k}
    assert quality_bayes.scored(edges, labels.where("false")).count() == len(EDGES)
    assert quality_bayes.drop_poor(edges, labels).columns == edges.columns
    assert quality_bayes.scored(nothing, labels).count() == 0 and quality_bayes.drop_poor(nothing, labels).count() == 0


def test_quality_measures_a_text_once_a_pass_in_little_memory(spark):
    texts = [f"{'plain words of some length' if i % 2 else '!! $$ || ##'} {i} " * 9 for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    kept = quality_bayes.drop_poor(docs, labels)
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.doc_id for r in kept.collect()} == set(range(1, 40, 2))
    large = pa.array([text * 100 for text in texts] * 4)
    quality_bayes.features(large[:1])
    tracemalloc.start()
    together = quality_bayes.features(large)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert large.nbytes > 2_000_000 and peak < 24_000_000
    assert (together == np.concatenate([quality_bayes.features(large[i : i + 1]) for i in range(len(large))])).all()


def best_windows(docs, items, similarity=0.8):
    grams = lambda words, k: [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    out = {}
    for i, item in items:
        words = re.findall(r"[^\W_]+", (item or "").lower())
        if not words:
            continue
        k = min(5, len(words))
        theirs = Counter(grams(words, k))
        m = sum(theirs.values())
        for d, text in docs:
            own = grams(re.findall(r"[^\W_]+", (text or "").lower()), k)
            for start in range(max(1, len(own) - m + 1)):
                window = Counter(own[start : start + m])
                both = sum((window & theirs).values())
                if both and both / (sum(window.values()) + m - both) >= similarity:
                    out[d, i] = max(out.get((d, i), 0), round(both / (sum(window.values()) + m - both), 6))
    return out


def test_decontamination(spark, edges, nothing):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([30, 40, 120, 7, 3])] + [(5, None), (6, "")]
    docs = []
    for d in range(30):
        text = [rng.choice(words) for _ in range(100)]
        copied = items[d % 5][1].split()
        for _ in range(d // 10):
            copied[rng.randrange(len(copied))] = "new"
        docs.append((d, " ".join(text[:50]) + ". " + " ".join(copied).upper() + ", " + " ".join(text[50:])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(frame, benchmark).collect()}
    assert got == best_windows(docs, items)
    kept = {r.doc_id for r in decontaminate.drop_contaminated(frame, benchmark).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.matches(edges, benchmark).count() == 0 and decontaminate.matches(nothing, benchmark).count() == 0
    assert decontaminate.matches(edges, benchmark.where("false")).count() == 0
    assert decontaminate.drop_contaminated(edges, benchmark).count() == len(EDGES)


def test_decontamination_of_parts_in_another_order(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(4000)]
    items = [(i, " ".join(rng.sample(words, n))) for i, n in enumerate([60, 60, 45, 150])]
    docs = []
    for d in range(40):
        text, copied = [rng.choice(words) for _ in range(120)], items[d % 4][1].split()
        cut = rng.randrange(1, len(copied)) if d >= 4 else len(copied) // 2
        copied = copied[cut:] + copied[:cut]
        for _ in range(d // 20):
            copied[rng.randrange(len(copied))] = "new"
        place = (0, 60, 120)[d % 3]
        docs.append((d, " ".join(text[:place] + copied + text[place:])))
    parts = items[3][1].split()
    docs.append((40, " ".join(parts[100:] + parts[50:100] + parts[:50] + words[:99])))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == best_windows(docs, items) and {(d, d % 4) for d in range(4)} <= set(got)


def test_chat_rows_survive_any_extra_column(spark):
    rows = spark.createDataFrame([(1, 0, "human", "hi"), (1, 1, "gpt", "ho"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    want = {r.conv: tuple(r) for r in chat_format.digests(chat_format.format_turns(rows)).collect()}
    assert want[1][1] == 2 and want[1][2] == hashlib.sha256(b"human\nhi\ngpt\nho\n").hexdigest() and want[2][1] == 1
    for name in ("input", "system", "prompt", "response", "instruction", "output", "messages", "conversations"):
        more = rows.selectExpr("*", f"'x' AS {name}")
        assert {r.conv: tuple(r) for r in chat_format.digests(chat_format.format_turns(more)).collect()} == want, name
    nested = rows.selectExpr("*", "array(named_struct('role', 'user', 'content', cast(null AS string))) AS messages")
    assert {r.conv: tuple(r) for r in chat_format.digests(chat_format.format_turns(nested)).collect()} == want
    pinned = rows.selectExpr("*", "'p' AS prompt", "'r' AS response")
    found = chat_format.digests(chat_format.format_turns(pinned, mappings=chat_format.MAPPINGS[:1])).collect()
    assert {r.conv: tuple(r) for r in found} == want
    own = spark.sql("SELECT 1 AS id, array(named_struct('from', 'human', 'value', 'q'), named_struct('from', 'gpt', 'value', 'a')) AS conversations")
    assert [tuple(t) for t in chat_format.canonical_turns(own).first()._turns] == [("user", "q"), ("assistant", "a")]


def test_rows_without_id_and_with_equal_ids(spark):
    rng = random.Random(10)
    passage, clean, other, second = (" ".join(rng.choice([f"{c}{i}" for i in range(300)]) for _ in range(60)) for c in "pcox")
    docs = spark.createDataFrame([(None, passage), (None, clean), (1, passage), (1, other), (2, "a " + second), (2, clean + " end")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, passage), (7, second), (7, "q1 q2 q3 q4 q5 q6 q7 q8")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.similarity) for r in decontaminate.matches(docs, benchmark).collect()} == {(None, None, 1.0), (1, None, 1.0), (2, 7, 1.0)}
    kept = [tuple(r) for r in decontaminate.drop_contaminated(docs, benchmark).collect()]
    assert Counter(kept) == Counter([(None, clean), (1, other), (2, clean + " end")])
    rows = [(1, passage), (1, other), (2, passage), (2, second), (None, clean), (None, clean), (None, other)]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, passage), (1, other), (2, second), (None, clean)])


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, folder))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < docs.count() <= before, name
        before = docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
