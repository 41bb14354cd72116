"""Brute-force, round-trip and held-out checks of the training-data operators, and their edge cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from srcgraph.llm import (
    components, extraction, language, licenses, lm_scoring, mixing, ngram_join, packing, quality, spotsigs, toxicity,
)

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: Nulls, empty and white texts, ties, copies, one very long text.
ODD = [
    (1, "", "a"), (2, None, "a"), (3, " \n\t ", None), (4, "one two", "a"), (5, "one two", "b"), (6, "one two", "b"),
    (7, LONG, "a"), (8, LONG + " end", "c"), (None, "no id here at all", None), (9, "*** ### 123", ""), (9, "*** ### 123", ""),
    (10, "the cat sat on the mat and the dog sat on the rug", "b"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i and i % 2 else None, s, 0, "x", 1.0, "y") for i, t, s in ODD]
    names = "doc_id long, text string, lang string, source string, n_chars long, size string, toxicity double, lang_pred string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def grams(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(rows, n, percent):
    sets = [grams(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)].append(doc)
    return Counter((doc, len(sets[k]), min(least[find(k)], default=None) if sets[k] else doc) for k, (doc, _) in enumerate(rows))


def variants():
    """Groups of texts that share most words, around the threshold."""
    rng = np.random.default_rng(5)
    rows, k = [], 100
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(120)]
        for _ in range(40):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 6)):
                words[at] = f"x{rng.integers(0, 50)}"
            rows.append((k, " ".join(words)))
            k += 1
    return rows


@pytest.mark.parametrize("long_list,tile", [(64, 128), (3, 8)])
def test_ngram_join_is_exact(spark, monkeypatch, long_list, tile):
    monkeypatch.setattr(ngram_join, "LONG_LIST", long_list)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = variants() + [(i, t) for i, t, _ in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(docs, n=4, percent=85).collect())
    assert got == brute_components(rows, 4, 85)


def test_ngram_join_edges(odd, empty):
    assert ngram_join.near_duplicates(empty).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 9, 10]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(90, 80)], "a long, b long")
    labels = {r.node: r.label for r in components.components(edges).collect()}
    assert labels == {**{i: 1 for i in range(1, 41)}, 80: 80, 90: 80}


def test_lm_scores_edges(odd, empty):
    assert lm_scoring.scores(empty).count() == 0
    rows = {r.doc_id: r for r in lm_scoring.scores(odd).collect()}
    assert rows[1].n_words == rows[2].n_words == rows[3].n_words == 0 and rows[1].log_score == 0
    # "one two" stands in two other documents: two against the words outside this one, then two of two.
    total = sum(len((t or "").split()) for _, t, _ in ODD)
    assert rows[4].log_score == pytest.approx(math.log(2 / (total - 2)))


def test_lm_keys_carry_the_whole_hash(spark, monkeypatch):
    # Hashes of a block that differ in their lowest bit only are two n-grams.
    monkeypatch.setattr(lm_scoring, "_ngrams", lambda words, doc, order: (np.arange(len(words)), np.arange(len(words), dtype=np.uint64) % 5 + np.uint64(2**61)))
    docs = spark.createDataFrame([(1, "a b c d e a b c d e"), (2, "a b c")], "doc_id long, text string").coalesce(1)
    for blocks in (2, 64, 8192):
        rows = lm_scoring.packed(docs, 1, blocks, texts=False).collect()
        keys = [int(k) for r in rows for k in lm_scoring._unkeys(r.a, lm_scoring.key_bytes(blocks))]
        counts = [int(c) for r in rows for c in lm_scoring._unplanes(r.b, 4)]
        assert [k % 8 for k in keys] == [0, 1, 2, 3, 4] and counts == [3, 3, 3, 2, 2]
        assert sorted(lm_scoring._ngrams("x" * 5, None, 1)[1].tolist()) == [(rows[0].block << (64 - blocks.bit_length() + 1)) + k for k in keys]


def unpacked(pieces, docs, window):
    tokenizer = __import__("tokenizers").Tokenizer.from_file(packing.tokenizer_path())
    encode = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
    want = Counter(zlib.crc32(encode(t).tobytes()) for _, t in docs)
    by_id = defaultdict(list)
    for i, t in docs:
        by_id[i].append(encode(t))
    for p in pieces:
        assert any(len(e) == p.doc_tokens and zlib.crc32(e[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for e in by_id[p.doc_id])
    assert sum(p.length for p in pieces) == sum(len(e) for es in by_id.values() for e in es) and want
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    for at, spans in windows.items():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end == window or at == max(windows)
    assert sorted(windows) == list(range(len(windows)))


@pytest.mark.parametrize("window", [64, 4096])
def test_packing_round_trip(spark, documents, odd, window):
    for docs in (documents, odd):
        pieces = packing.pack(docs, window=window).collect()
        unpacked(pieces, [(r.doc_id, r.text) for r in docs.collect()], window)
        if docs is documents:
            share = defaultdict(Counter)
            for p in pieces:
                share[p.sequence_id][p.source] += p.length
            total = Counter(s for p in pieces for s in [p.source] * p.length)
            every = sum(total.values())
            taken = Counter()
            for k in sorted(share)[:-1]:
                taken += share[k]
                assert all(abs(taken[s] - total[s] * (k + 1) * window / every) <= 6 for s in total)


def test_packing_runs_equal_whole_text(odd):
    ids = packing._Ids(packing.tokenizer_path())
    tokenizer = __import__("tokenizers").Tokenizer.from_file(packing.tokenizer_path())
    for text in ("It's  DON'T x", "áb ç   d", "<|endoftext|> <|startoftext|>x", "ΣΑΣ İ 12ab\x1c3", "日本 語\n\x0b!"):
        assert np.frombuffer(ids.text(text), "<u4").tolist()[:-1] == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


def test_toxicity_on_held_out_rows(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(documents, labels.filter("doc_id % 2 = 0"))
    rows = toxicity.score(documents.select("doc_id", "text"), model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    mean = lambda side: np.mean([r.toxicity for r in rows if r.toxic == side])
    assert mean(1) > mean(0) + 0.2


def test_toxicity_edges(spark, odd, empty):
    none = toxicity.fit(odd, spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int"))
    assert none is None and {r.score for r in toxicity.score(odd, none, "score").collect()} == {0.0}
    rude = [(i, f"such a moron and idiot clown number {i} in this text", 1) for i in range(20)]
    kind = [(i + 50, f"what a lovely day number {i} we have in this town", 0) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rude + kind], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rude + kind], "doc_id long, toxic int"))
    got = toxicity.score(odd, model, "mine").collect()
    assert len(got) == len(ODD) and all(0 <= r.mine <= 1 for r in got)
    assert toxicity.score(empty, model, "mine").count() == 0
    sides = {r.doc_id: r.mine for r in toxicity.score(docs, model, "mine").collect()}
    assert min(sides[i] for i in range(20)) > max(sides[i + 50] for i in range(20))


def test_language_forward_sums_all_segmentations():
    words = {"a": Counter({b"hello": 3, b"world": 2}), "b": Counter({b"bonjour": 3})}
    vocabulary = sorted({"h", "e", "l", "o", "he", "ll", "llo", "w", "or", "ld", "▁", "▁h", "▁he", "b", "on", "j", "our", "▁b", "r"})
    model = language.fit_counts(words, vocabulary)
    known = language._Words((*model, np.zeros(2)))
    known.learn({b"hello", b"zq", b"bonjour"})

    def every(unit, k):
        if not unit:
            return 1.0
        total = 0.0
        for j in range(1, len(unit) + 1):
            p = model[1][unit[:j]][k] if unit[:j] in model[1] else language.UNKNOWN if j == 1 else 0.0
            total += p * every(unit[j:], k) if p else 0.0
        return total

    for word in (b"hello", b"zq", b"bonjour"):
        assert known.rows[known[word]] == pytest.approx([math.log(every("▁" + word.decode(), k)) for k in (0, 1)])


def test_language_on_held_out_rows(documents):
    rows = language.predict(documents, language.fit(documents.filter("doc_id % 2 = 0"))).filter("doc_id % 2 = 1").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_language_edges(documents, odd, empty):
    model = language.fit(documents)
    assert language.fit(empty) is None
    names = ("guess", "how")
    assert {r.guess for r in language.predict(odd, None, names).collect()} == {"und"}
    got = language.predict(odd, model, names).collect()
    assert {r.doc_id for r in got if r.guess == "und"} == {1, 2, 3, 9} and len(got) == len(ODD)
    assert language.predict(empty, model, names).count() == 0


def test_mixing_targets_and_bounds(spark, documents, odd, empty):
    assert mixing.mix(empty).count() == 0
    for docs in (documents, odd):
        rows = mixing.mix(docs).collect()
        assert sum(r.n for r in rows) == docs.count()
        sizes, targets, taken, largest = Counter(), {}, Counter(), Counter()
        for r in rows:
            sizes[r.source] += r.size * r.n
            targets[r.source] = r.target
            taken[r.source] += r.size * r.copies * r.n
            largest[r.source] = max(largest[r.source], r.size)
            assert 0 <= r.copies <= 3
        # Brute force: hand out the words by weight, cap, share the excess again.
        order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        want, full = {}, set()
        while True:
            left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
            free = [s for s in order if s not in full]
            want = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in order}
            over = {s for s in free if want[s] > 3 * sizes[s]}
            if not over:
                break
            full |= over
        assert {s: pytest.approx(v, abs=1e-6) for s, v in want.items()} == targets
        for s in order:
            assert abs(taken[s] - targets[s]) <= largest[s]
    assert sorted(map(tuple, mixing.mix(documents).collect())) == sorted(map(tuple, mixing.mix(documents.repartition(5)).collect()))


def test_mixed_rows_repeat(odd):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    want = {(r.doc_id, r.source, r.size): r.copies * r.n for r in mixing.mix(odd).collect()}
    assert out.count() == sum(want.values())


def test_pivotal_rounding_keeps_expectations(spark):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 37 + 1).cast("int")), " ").alias("text"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"),
    )
    rows = mixing.mix(docs, weights=(3, 2), block=8).collect()
    for source in "ab":
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= 37
        rate = mine[0].target / mine[0].source_size
        assert {r.copies for r in mine} <= {math.floor(rate), math.floor(rate) + 1}


def test_spotsigs_against_plain_python(documents, odd, empty):
    assert spotsigs.compared(empty).count() == 0
    words = spotsigs._Words()
    for docs in (documents, odd.dropDuplicates(["doc_id"])):
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0]))
        got = {r.doc_id: r for r in spotsigs.compared(docs).collect()}
        assert len(got) == len(rows)
        for k, (doc, text) in enumerate(rows):
            following = rows[(k + 1) % len(rows)][1]
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            mine, other, after = (set(spotsigs.signatures(t, words).tolist()) for t in (text, edited, following))
            r = got[doc]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.near_edited == pytest.approx(len(mine & other) / len(mine | other) if mine | other else 1.0)
            assert r.near_next == pytest.approx(len(mine & after) / len(mine | after) if mine | after else 1.0)


def plain_signatures(text):
    """Chains as tuples of words, from the rule as it is written."""
    words = [w for w in ("".join(c for c in t if c.isalnum() or ord(c) > 126) for t in text.lower().split()) if w]
    found = set()
    for k, word in enumerate(words):
        sampled = xxhash.xxh3_64_intdigest(word.encode()) // 4 % spotsigs.EVERY == 0
        if word in spotsigs.SPOTS or sampled or k < spotsigs.HEAD:
            chain = [w for w in words[k + 1 :] if w not in spotsigs.SPOTS][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                found.add((word, *chain))
    return found


def test_spotsigs_likeness_is_that_of_plain_signatures(documents):
    words, texts = spotsigs._Words(), [r.text or "" for r in documents.orderBy("doc_id").collect()]
    for a, b in zip(texts, texts[1:]):
        changed = a[: len(a) // 2] + b[: len(a) // 4]
        first, second = plain_signatures(a), plain_signatures(changed)
        if first and second:
            got = spotsigs.likeness(spotsigs.signatures(a, words), spotsigs.signatures(changed, words))
            assert got == pytest.approx(len(first & second) / len(first | second), abs=1e-3)


def test_spotsigs_of_one_more_word_are_alike_at_every_length():
    words = spotsigs._Words()
    with_common = [f"w{k * k % 97}" if k % 3 else "the" for k in range(400)]
    without = [f"x{k * k % 89}" for k in range(400)]
    for source in (with_common, without):
        for n in range(20, 80):
            one, two = (spotsigs.signatures(" ".join(source[:m]), words) for m in (n, n + 1))
            assert spotsigs.likeness(one, two) >= 0.7, n
            front = spotsigs.signatures("zeta " + " ".join(source[:n]), words)
            assert spotsigs.likeness(one, front) >= 0.7, n
    assert len(spotsigs.signatures("a b", words)) == 1 and len(spotsigs.signatures("", words)) == 0


def test_spotsigs_of_repeated_ids_follow_each_other(spark):
    rows = [(7, "one two three"), (7, "one two three"), (7, "four five six seven"), (None, None), (None, "x y z"), (9, "last of all the words")]
    got = spotsigs.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    assert sum(r.near_next == 1.0 for r in got) >= 1


def test_spotsigs_groups(spark):
    rows = variants()
    text = {i: " the ".join(t.split()) for i, t in rows}
    words = spotsigs._Words()
    sets = {i: set(spotsigs.signatures(t, words).tolist()) for i, t in text.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in spotsigs.near_duplicates(docs).collect()} == {i: find(i) for i in sets}


def test_quality_edges_and_order(odd, empty):
    assert quality.judge(empty).count() == 0
    rows = {r.doc_id: r for r in quality.judge(odd).collect()}
    assert not rows[1]._kept and rows[2]._base_failed and rows[7]._n_words == 30_000
    assert rows[7]._n_repeat_words == 30_000
    names = {r.name for r in quality.ordered(odd, quality.rules())}
    assert names == {r.name for r in quality.rules()}


def test_license_inheritance(spark):
    files = spark.createDataFrame(
        [
            (1, "LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", "nothing"), (3, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
            (4, "d/e.txt", None), (5, "a/x.txt", "words\n# Licensed under CC BY-NC 4.0.\nmore"), (6, None, ""), (7, "ab/y.txt", ""), (7, "ab/y.txt", ""),
        ],
        "file long, path string, text string",
    )
    got = Counter((r.file, r.license, r.origin) for r in licenses.scan(files).collect())
    assert got == Counter(
        [
            (1, "MIT", "LICENSE"), (2, "Apache-2.0", "a/LICENSE"), (3, "Apache-2.0", "a/LICENSE"), (4, "MIT", "LICENSE"),
            (5, "CC-BY-NC-4.0", "a/x.txt"), (6, None, None), (7, "MIT", "LICENSE"), (7, "MIT", "LICENSE"),
        ]
    )
    assert licenses.scan(files.limit(0)).count() == 0


def test_license_versions(spark):
    texts = {
        "SPDX-License-Identifier: GPL-2.0": "GPL-2.0", "// SPDX-License-Identifier: GPL-3.0": "GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
        "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
        "This program is licensed under the GNU General Public License, version 3": "GPL-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "3 files of 2019\n10 more\nThis program is licensed under the GNU General Public License, version 3.0": "GPL-3.0",
        "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY 3.0": None, "Released under the MIT License, 2 of 3": "MIT",
        "To the extent possible under law the author has waived all copyright, CC0 Universal Public Domain Dedication": "CC0-1.0",
        "Licensed under the GNU Lesser General Public License, version 2.1": None,
    }
    files = spark.createDataFrame([(i, f"{i}/LICENSE", t) for i, t in enumerate(texts)] + [(99, "1/a.txt", "x")], "file long, path string, text string")
    got = {r.file: r.license for r in licenses.scan(files).collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == texts
    assert got[99] == "GPL-3.0"
    for name, notice in licenses.TEMPLATES:
        if name[-1].isdigit() and name[-2] == ".":
            assert licenses._template_version(notice) == "=" + name.rsplit("-", 1)[1].removesuffix(".0"), notice


def page_text(source):
    return "\n\n".join(t for t, _ in extraction._Page(source).content())


def test_page_markup():
    assert page_text(
        '<html><head><title>x</title></head><body><header>H</header><div class="cookie-notice">c</div><div><p>One <b>two</b>\n three&nbsp;four &amp; five'
        '<p>six<br>seven<ul><li>a<li>b</ul><form>x</form><div id="comments">no</div></div><footer>f</footer>'
    ) == "One two three four & five\n\nsix seven\n\na\n\nb"
    assert page_text("<body><article><header><h1>T</h1></header><p>a</p><aside>s</aside></article><p>outside</p></body>") == "T\n\na"
    assert page_text('<p>a<script>var x="</p>"</script>b') == "ab"
    assert page_text("<p>cut <b") == "cut" and page_text("") == "" and page_text("plain &lt;text&gt;") == "plain <text>"


def test_site_template_goes(spark):
    page = lambda i: f"<body><div><span>Best site</span><div>Follow us</div></div><div><p>Story {i} of many</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(50, "http://other.example/", page(1)), (51, None, None), (52, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    assert all(got[i] == f"Story {i} of many" for i in range(12))
    assert got[50] == "Best site\n\nFollow us\n\nStory 1 of many" and got[51] == got[52] == ""
    assert extraction.extract(pages.limit(0)).count() == 0


def test_templates_match_a_plain_count_of_places(spark):
    """Flat pages: an element's place is its number among the elements of its class, from either end."""
    rows, plain = [], {}
    for i in range(40):
        parts = [("top", "Best site"), ("story", f"Story {i}"), ("story", "Shared passage" if i % 3 else f"Own {i}")]
        parts += [("box", "Join us")] * (i < 12) + [("end", "Bye" if i % 4 else "Good bye")]
        html = "".join(f'<p class="{c}">{t}</p>' for c, t in parts)
        rows.append((i, f"http://h{i % 2}.example/{i}", f"<body>{html}</body>"))
        plain[i] = parts
    placed, fills = {}, {}
    for i, parts in plain.items():
        for k, (name, text) in enumerate(parts):
            front = sum(c == name for c, _ in parts[:k])
            for place in (front, front - sum(c == name for c, _ in parts)):
                placed.setdefault((i % 2, name, place), set()).add(i)
                fills.setdefault((i % 2, name, place, text), set()).add(i)
    gone = {(h, c, t) for (h, c, p, t), at in fills.items() if len(at) >= 5 and 2 * len(at) >= len(placed[h, c, p])}
    expected = {i: "\n\n".join(t for c, t in parts if (i % 2, c, t) not in gone) for i, parts in plain.items()}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extraction.extract(pages).collect()} == expected
    assert {t for _, _, t in gone} >= {"Best site", "Join us", "Bye"}
    found = extraction.templates(pages)
    assert found.filter("2 * n < pages or n < 5").count() == 0
    assert found.select("host", "subtree").distinct().count() == sum(
        len(at) >= 5 and 2 * len(at) >= len(placed[key[:3]]) for key, at in fills.items()
    )


def test_a_box_in_few_articles_goes_and_a_repeated_passage_stays(spark):
    def page(i):
        box = '<div class="lead">Read our letter</div>' if i % 3 == 0 else ""
        return f"<article>{box}<p>Story {i}</p><p>{'Under the licence.' if i % 2 else f'End {i}'}</p></article>"

    rows = [(i, "http://h.example/", page(i)) for i in range(60)]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}\n\n" + ("Under the licence." if i % 2 else f"End {i}") for i in range(60)}


def test_article_parts_with_common_class_names_stay_and_hidden_ones_go():
    assert page_text(
        '<article><div class="post side">a</div><section class="article header">b</section><div class="search">c</div><p hidden>d</p>'
        '<p aria-hidden="false" title="a hidden id=comments">e</p><div class="comments-list">f</div><div class="ad">g</div></article>'
    ) == "a\n\nb\n\nc\n\ne"


def test_deep_long_and_repeated_pages(spark):
    deep = "<div>" * 60_000 + "<p>deep" + "<b>" * 20_000 + "<p></p>" * 20_000 + "</i>" * 20_000 + "end"
    long = "<p>" + "word " * 400_000 + "</p>"
    rows = [(1, "u", deep, "x", 1), (2, "u", long, "y", 2), (2, "u", long, "y", 2), (2, "u", "<p>other", None, 3), (None, None, "<p>n", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, n long")
    got = sorted((r.page_id or 0, len(r.text), r.text[:5]) for r in extraction.extract(pages).collect())
    assert got == [(0, 1, "n"), (1, 9, "deep\n"), (2, 5, "other"), (2, 1_999_999, "word "), (2, 1_999_999, "word ")]


def test_copies_of_an_article_are_no_template(spark):
    page = "<body><article><p>The same story</p></article></body>"
    pages = spark.createDataFrame([(i, "http://h.example/", page) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in extraction.extract(pages).collect()} == {"The same story"}


def test_query_shapes(spark):
    from srcgraph.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark, odd):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == want, name
        assert stage(spark, odd, FOLDER).columns == odd.columns
        stage(spark, odd, FOLDER).count()
        assert stage(spark, odd.limit(0), FOLDER).count() == 0
    assert len(pipeline.STAGES) == 5


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = pipeline.without_copies(spark, docs, FOLDER)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {doc for doc, _, least in brute_components(rows, 5, 80) if doc == least}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want
    pieces = pipeline.run(spark, FOLDER).collect()
    assert pieces and all(p.length > 0 for p in pieces)


def test_pipeline_keeps_what_is_no_copy(spark):
    import corpus_pipeline as pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (None, c), (None, c + " end"), (3, ""), (3, ""), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in pipeline.without_copies(spark, docs, FOLDER).collect())
    assert kept in [Counter([(1, a), (1, b), (None, x), (3, ""), (4, None), (None, "")]) for x in (c, c + " end")]


def test_pipeline_language_drops_no_clean_text(spark, monkeypatch):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(1, "one two", None), (2, "three", None)], "doc_id long, text string, lang string")
    assert pipeline.with_language(spark, docs, FOLDER).count() == 2
    predict = lambda docs, model, names: docs.withColumns({names[0]: F.expr("if(doc_id = 1, 'en', 'und')"), names[1]: F.lit(0.3)})
    monkeypatch.setattr(language, "fit", lambda docs: ())
    monkeypatch.setattr(language, "predict", predict)
    assert [r.doc_id for r in pipeline.with_language(spark, docs, FOLDER).collect()] == [1]


def test_rows_of_a_stored_table_need_no_second_copy(spark, odd, tmp_path):
    """Numbers by file and place choose the same rows as numbers that are written, over several files."""
    odd.unionByName(odd.withColumn("source", F.lit("later"))).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    plain, stored = ngram_join.one_of_each(docs), ngram_join.one_of_each(docs, stored=True)
    key = lambda rows: sorted([(r.doc_id, r.text) for r in rows.collect()], key=str)
    assert stored.columns == docs.columns and key(stored) == key(plain)
    assert key(ngram_join.one_of_each(odd, stored=True)) == key(ngram_join.one_of_each(odd))


def test_packing_encodes_words_of_letters_together():
    import pytest
    from srcgraph.llm import packing

    pytest.importorskip("tokenizers")
    ids = packing._Ids(packing.tokenizer_path())
    tokenizer = __import__("tokenizers").Tokenizer.from_file(packing.tokenizer_path())
    texts = [
        "Grün grün, grün!! größe's don't 'save \"so\" a.b a1b2 x_y ÀÉ àé\u0301 \u0130x ﬁn K\u212a µm ªº \u00a0x\u2003y",
        " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}é." for i in range(5_000)),
        "new words, of letters; only (here) and### there&&&", "", None,
    ]
    for text in texts:
        assert np.frombuffer(ids.text(text), "<u4").tolist()[:-1] == tokenizer.encode(text or "", add_special_tokens=False).ids
    calls = []
    encode = ids.encode
    ids.encode = lambda given, **options: calls.append(given[0]) or encode(given, **options)
    ids.text("unerhört unerhört. unerhört, ungesehen!")
    # Each word once, whatever signs follow it, with spaces between.
    assert sorted(calls[0].split(" ")) == ["unerhört", "ungesehen"]


def test_lm_scoring_sends_a_batch_of_one_and_a_half_million_words_as_one(spark):
    from srcgraph.llm import lm_scoring

    docs = spark.createDataFrame([(i, "a b c d e f g h i j " * 50_000) for i in range(3)], "doc_id long, text string").coalesce(1)
    rows = lm_scoring.packed(docs, 3, 2, texts=True).select("batch", "ids").collect()
    assert [row.ids for row in rows] == [[0, 1, 2]]
