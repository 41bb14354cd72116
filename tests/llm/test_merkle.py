"""Merkle manifest against a plain tree, and its edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from srcgraph.llm import merkle

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """The root of a list of digests, and for each of them its (place, siblings) by level."""
    proofs, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        runs = [leaves[i : i + 16] for i in range(0, len(leaves), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            proofs[k].append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
        leaves, at = [h(*r) for r in runs], [i // 16 for i in at]
    return leaves[0], proofs


def brute(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for s in order:
        members = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built.append((members, *tree([leaf(r) for r in members])))
    root, tops = tree([b[1] for b in built])
    out = []
    for (members, subroot, proofs), top in zip(built, tops):
        for row, proof in zip(members, proofs):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            f = leaf((*row[:4], row[4].translate(SMALL))) if changed else leaf(row)
            for place, others in proof + top:
                f = h(*others[:place], f, *others[place:])
            out.append((row[0], leaf(row), subroot, root, h(*[d for _, others in proof + top for d in others]), f, f == root))
    return sorted(out, key=str)


def answer(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    frame.withColumn("tree", F.lit("x")).withColumn("proof", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted([tuple(r) for r in merkle.op13(spark, str(tmp_path)).collect()], key=str)


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1], [300, 40, 16, 2], [1] * 40])
def test_equals_plain_tree(spark, tmp_path, sizes):
    rows, i = [], 0
    for k, size in enumerate(sizes):
        for _ in range(size):
            rows.append((i * 7 % 1_009, f"s{k}" if k else None, "en" if i % 3 else None, i, f"Text {i} É"))
            i += 1
    assert answer(spark, tmp_path, rows) == brute(rows)


def test_several_rounds_of_blocks(spark, tmp_path):
    rows = [(i, "hot" if i % 9 else "cold", "en", i, "Aa") for i in range(9_300)]
    assert answer(spark, tmp_path, rows) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [
        (None, "a", None, None, None), (None, "a", None, None, None), (5, "a", "en", 3, "ABC"), (5, "a", "en", 3, "ABC"), (5, "a", "de", 3, "abc"), (7, "", "en", 0, ""),
        (-3, None, None, 1, "-"), (10, "é", "x", 2, "Long " * 200_000), (11, "z", "x", None, None),
    ]
    assert answer(spark, tmp_path, rows) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert answer(spark, tmp_path, []) == []


def test_forward_and_backward_agree_for_every_block_size():
    for count in (1, 2, 15, 16, 17, 255, 256, 257, 300, 4_095, 4_096):
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(count)]
        height = next(k for k in range(4) if 16**k >= count)
        nodes, top = merkle.forward(leaves, height)
        assert top.hex() == tree([x.hex() for x in leaves])[0]
        proofs = merkle.backward(nodes, count, height, b"")
        assert all(merkle.fold(x, p) == top for x, p in zip(leaves, proofs))
