"""Near copies against all pairs, fingerprints against counting, rows picked by key."""

import random
import re
from collections import Counter

import numpy as np
import xxhash

from tablewright.llm import near_copies, rowkeys, simhash_dedup


def bag(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)])


def alike(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def components(count, pairs):
    label = list(range(count))
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    return label


def copies(rng):
    vocabulary = [f"{a}{b}{c}" for a in "bdfk" for b in "aeiou" for c in "lmnrst"]
    texts = []
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.randint(30, 300))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            edited = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 45))):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", " | ", ", "]).join(edited).upper() if rng.random() < 0.3 else " ".join(edited))
    rng.shuffle(texts)
    return texts


def test_near_copies_against_all_pairs(spark):
    texts = copies(random.Random(3)) + ["", None, " .. ", "one two", "One, two!", "three"]
    bags = [bag(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if alike(bags[i], bags[j]) >= 0.8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "7 AS _key", "8 AS file", "9 AS `row`").repartition(3)
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert all((r._key, r.file, r["row"]) == (7, 8, 9) for r in rows)
    left = {r.doc_id for r in rows}
    found = sum(not (i in left and j in left) for i, j in near)
    assert len(near) > 40 and found >= 0.9 * len(near)
    groups = components(len(texts), near)
    assert {min(i for i, g in enumerate(groups) if g == own) for own in groups} <= left  # nothing else goes


def test_near_copies_of_a_file(spark, tmp_path):
    """Rows keep their keys over several reads, and ids decide, null ids last."""
    rows = [(5, "a b c d e f"), (None, "A b c d e f"), (3, "a, b c d e f"), (None, "other words"), (9, "x y z"), (9, "u v w")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    kept = near_copies.drop_near_copies(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert Counter(map(tuple, kept)) == Counter([(3, "a, b c d e f"), (None, "other words"), (9, "x y z"), (9, "u v w")])
    empty = spark.read.parquet(str(tmp_path / "d")).where("false")
    assert near_copies.drop_near_copies(empty).count() == 0


def test_picked_rows(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id AS string) AS text").repartition(3).write.parquet(str(tmp_path / "d"))
    keyed = rowkeys.with_key(spark.read.parquet(str(tmp_path / "d")), "k")
    keys = keyed.where("id % 7 = 0").select("k.file", "k.row")
    assert sorted(r.id for r in rowkeys.picked(keyed, "k", keys).collect()) == list(range(0, 1000, 7))
    assert rowkeys.picked(keyed, "k", keys, listed=False).count() == 1000 - 143
    assert rowkeys.picked(keyed, "k", keys.where("false")).count() == 0
    assert rowkeys.free_name(spark.createDataFrame([(1, 2)], "K int, _k int"), "k") == "__k"


def test_fingerprints_by_counting():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ab", "Cd", "é", "日本", "x,"]) for _ in range(rng.randrange(9))) for _ in range(60)] + ["a\tb\x0bc\nd", "A\xa0b", None]
    for text in texts:
        words = [w for w in re.split(r"[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert simhash_dedup.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_edges_are_real_pairs():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))) for _ in range(3000)]
    fp = np.array([centre ^ f for f in flips], np.uint64)
    group = np.zeros(len(fp), np.int64)
    a, b = simhash_dedup.links_within(group, fp, 11)
    assert (np.bitwise_count(fp[a] ^ fp[b]) <= 11).all() and len(a) < len(fp)
    assert len(set(components(len(fp), zip(a.tolist(), b.tolist())))) == len(fp) - len(a)


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in near_copies.drop_near_copies(docs).collect()}


def lowest_ids(texts):
    bags = [bag(t) for t in texts]
    groups = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(bags[i], bags[j]) >= 0.8])
    return {groups.index(own) for own in groups}


def test_near_copies_beyond_the_radius(spark):
    """Every pair of a similarity of 0.8 counts, however far its fingerprints lie apart."""
    rng = random.Random(6)
    texts = []
    for i in range(250):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(14, 40))]
        texts += [" ".join(words), " ".join([*words[:-1], f"x{i}"])]
    fp = [simhash_dedup.bits_of(near_copies.shingles(near_copies.words(t), near_copies.FINGERPRINT_WORDS)) for t in texts]
    assert any((fp[i] ^ fp[i + 1]).bit_count() > near_copies.RADIUS for i in range(0, 500, 2))
    expected = lowest_ids(texts)
    assert len(expected) == 250 and kept_ids(spark, texts) == expected


def test_near_copies_in_a_large_group(spark):
    """Chains of edits of one text, shared passages and repeated words: the groups of all pairs, and nothing else goes."""
    rng = random.Random(7)
    letters = [f"{a}{b}" for a in "bdfk" for b in "aeiou"]
    passage = [rng.choice(letters) for _ in range(30)]
    texts = []
    for size in (12, 40, 90):
        words = rng.choices(letters, k=size)
        for _ in range(60):
            words[rng.randrange(size)] = rng.choice(letters)
            texts.append(" ".join(words))
    texts += [" ".join([*rng.choices(letters, k=n), *passage]) for n in range(5, 45) for _ in range(2)]
    texts += [" ".join(["la"] * n) for n in range(1, 30)]
    rng.shuffle(texts)
    expected = lowest_ids(texts)
    assert 50 < len(expected) < len(texts) - 50 and kept_ids(spark, texts) == expected
