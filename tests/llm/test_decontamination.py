"""Benchmark decontamination against a plain search, and its edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from srcgraph.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def brute(docs, items, window):
    held = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            held.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in held}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in held:
                    hit |= set(range(i, i + n))
                    found |= held[tuple(w[i : i + n])]
        found = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest()))
    return sorted(out, key=str)


def answer(spark, docs, items, window=10, shingle=5):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("runs", F.lit(1))
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    found = decontamination.contamination(docs, items, window, shingle)
    rows = found.select("doc_id", "n_words", "n_hit", F.size("item_ids"), F.sha2(F.array_join("item_ids", ","), 256)).collect()
    return sorted([tuple(r) for r in rows], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_search(spark, seed):
    random.seed(seed)
    vocabulary = ["A", "b", "Cé", "d9", "ß", "日本", "f", "gg"][: 4 + seed * 2]
    text = lambda n: "".join(random.choice(vocabulary) + random.choice([" ", ", ", "\n", "\x0b-"]) for _ in range(n))
    items = [(i, text(random.choice([1, 2, 4, 5, 7, 10, 12, 30]))) for i in range(12)]
    docs = [(i, text(random.randrange(40))) for i in range(60)] + [(i, text(5) + items[i % 12][1] + text(3)) for i in range(60, 90)]
    assert answer(spark, docs, items, 6 + 2 * seed, 3) == brute(docs, items, 6 + 2 * seed)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 9_973}" for i in range(120_000))
    items = [
        (1, " ".join(f"w{i}" for i in range(500, 530))), (2, "Only Four words here"), (2, "second text of two that has more than ten words in it, really"), (3, None), (4, " -- "),
        (None, "an item without an id that is still a leak of many words"), (5, "only four words here"),
    ]
    docs = [
        (1, None), (2, ""), (3, "...!"), (4, long), (4, long), (None, "no id, but only FOUR words-here and more"), (6, "an item without an id that is still a leak of many words, yes"),
        (7, "z" * 2_000_000 + " only four words here"), (8, "second text of two that has more than ten words in it, really"),
    ]
    found = answer(spark, docs, items)
    assert found == brute(docs, items, 10)
    by_id = {r[0]: r for r in found}
    assert by_id[4][2] > 0 and by_id[6][2] == 13 and by_id[6][3] == 0 and by_id[1][1:4] == (0, 0, 0)


def test_empty_tables(spark):
    assert answer(spark, [], [(1, "a b c")]) == []
    assert [r[:4] for r in answer(spark, [(1, "a b c")], [])] == [(1, 3, 0, 0)]


def test_full_bit_table_changes_nothing(spark, monkeypatch):
    random.seed(7)
    docs = [(i, " ".join(random.choice("abcd") for _ in range(30))) for i in range(40)]
    items = [(i, " ".join(random.choice("abcd") for _ in range(8))) for i in range(20)]
    monkeypatch.setattr(decontamination, "BITS_PER_SHINGLE", 0)
    monkeypatch.setattr(decontamination, "MOST_BITS", 6)
    assert answer(spark, docs, items, 5, 3) == brute(docs, items, 5)
