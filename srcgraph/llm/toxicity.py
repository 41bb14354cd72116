"""Toxicity by compression distance.

A word becomes a 16-byte code, so that a dictionary matches whole words and not syllables. Two
zstandard dictionaries are trained on labelled text: one on ordinary windows, one on what toxic windows
hold beyond them (words several toxic documents share and ordinary ones rarely have), laid over the
same ordinary content. Every window of a text is compressed with both; the bytes that the toxic
dictionary saves, as mean, maximum and share of windows over a calibrated threshold, go through a
logistic function fitted on labelled rows that trained no dictionary.

Model fitting uses at most ``SAMPLE`` labelled documents of each class (of at most ``SAMPLE_CHARS``
characters each, longer ones train nothing); scoring reads every whole text.

Defined results: null, empty and word-less texts have no windows and score like a text without any
saving; without labelled rows of both classes every score is 0; a null doc_id is scored, not held out
and trains nothing; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import fold, release, table

SAMPLE = 1500
SAMPLE_CHARS = 20_000
WINDOW = 32
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 4_096
LEVEL = 3
RATIO = 8
SAVED = 8
THRESHOLD = 0.7
MEMO = 200_000

#: Matched by both dictionaries at the start of every window, so that one more match always pays.
_LEAD = b"".join(xxhash.xxh128_digest(b"lead %d" % i) for i in range(4))
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha() and chr(c) not in " \t\n\x0b\x0c\r")


class _Codes(dict):
    """Word to code, with a bounded memory."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        code = self[word] = xxhash.xxh128_digest(word)
        return code


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().translate(None, _NOT_LETTERS).split()


def _windows(codes: list[bytes]) -> list[bytes]:
    return [_LEAD + b"".join(codes[i : i + WINDOW]) for i in range(0, len(codes), WINDOW)]


class _Scorer:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.codes, self.sides = _Codes(), []
        for content in (ordinary + _LEAD, toxic + ordinary + _LEAD):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            self.sides.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False
                ).compress
            )

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Of a text's windows: mean and largest saving, share and number with a clear saving."""
        without, with_toxic = self.sides
        codes = self.codes
        saved = [len(without(w)) - len(with_toxic(w)) for w in _windows([codes[w] for w in _words(text)])]
        if not saved:
            return 0.0, 0.0, 0.0, 0.0
        clear = sum(s >= SAVED for s in saved)
        return sum(saved) / len(saved), min(max(saved), 60), clear / len(saved), float(np.log1p(clear))


def _dictionaries(ordinary: list[list[bytes]], toxic: list[list[bytes]]) -> tuple[bytes, bytes]:
    """Contents of the two dictionaries."""
    def train(size: int, windows: list[bytes]) -> bytes:
        # The trainer wants many samples; few ones are repeated.
        try:
            trained = zstandard.train_dictionary(size, windows * (1 + 3000 // len(windows)), k=64, d=8)
        except zstandard.ZstdError:
            return b"".join(windows)[-size:]
        return trained.as_bytes()[-size:]

    codes = _Codes()
    content = train(ORDINARY_BYTES, [x for d in ordinary for x in _windows([codes[w] for w in d])])
    in_toxic = Counter(w for d in toxic for w in set(d))
    in_ordinary = Counter(w for d in ordinary for w in set(d))
    telling = {
        w for w, n in in_toxic.items() if n >= 3 and n * len(ordinary) > RATIO * (in_ordinary[w] + 1) * len(toxic)
    }
    left = [[codes[w] for w in d if w in telling] for d in toxic]
    windows = [x for d in left for x in _windows(d)]
    return content, train(TOXIC_BYTES, windows) if windows else b""


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (constant last), Newton's method with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + 0.5 * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w)), gradient)
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple | None:
    """Model from labelled rows; None without rows of both classes."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = labels.filter(F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    picked = [known.filter(F.col("toxic") == side).orderBy(*order).limit(sample) for side in (0, 1)]
    rows = (
        docs.filter(F.length("text") <= SAMPLE_CHARS)
        .select("doc_id", "text")
        .join(F.broadcast(picked[0].union(picked[1])), "doc_id")  # at most two samples of ids
        .orderBy(*order)
        .limit(3 * sample)
        .collect()
    )
    texts: dict[int, list[list[bytes]]] = {0: [], 1: []}
    for text, side in dict.fromkeys((r.text, r.toxic) for r in rows):
        texts[side].append(_words(text))
    ordinary, toxic = texts[0], texts[1]
    if len(ordinary) < 4 or len(toxic) < 4:
        return None
    contents = _dictionaries(ordinary[::2], toxic[::2])
    scorer = _Scorer(*contents)
    rest = [(d, 0.0) for d in ordinary[1::2]] + [(d, 1.0) for d in toxic[1::2]]
    x = np.array([scorer.features(b" ".join(d).decode("utf-8", "replace")) for d, _ in rest])
    return *contents, *_logistic(x, np.array([y for _, y in rest]))


def score(docs: DataFrame, model: tuple | None, name: str = "toxicity") -> DataFrame:
    """The rows with their toxicity from 0 to 1 as column ``name``, which they must not have; needs a column text."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    ordinary, toxic, mean, scale, weights = model
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = _Scorer(ordinary, toxic)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.array([scorer.features(t) for t in texts]).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> tuple | None:
    """Model of the labels outside the held-out third."""
    return fit(docs, labels.filter(~fold(1, 3)))


def op5(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels"))
    return score(docs, model).select(
        "doc_id",
        fold(1, 3).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )
