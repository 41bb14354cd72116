"""Language identification by segmentation-marginalised unigrams.

Pieces are those of a fixed public vocabulary. For each language their probabilities are fitted by
expectation maximisation over all segmentations of the training words. A text is scored word by word:
the forward algorithm sums the probabilities of all segmentations of a word under every language; the
sum of their logarithms and the prior is compared. A word is a run of letters (lower case, at most
``LONGEST`` characters at a time); other ASCII characters separate words.

Fitting uses at most ``SAMPLE`` documents of each language, of at most ``SAMPLE_CHARS`` characters;
prediction reads every whole text.

Defined results: null texts, empty ones and those without a letter are ``und`` with score 0; without
training rows every text is; a null lang trains nothing; ties go to the language that sorts first;
repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.llm.common import fold, release, table

SAMPLE = 300
SAMPLE_CHARS = 20_000
ROUNDS = 2
LONGEST = 30
PIECE = 7
SMOOTHING = 200.0
UNKNOWN = 1e-9
MEMO = 300_000
START = "▁"
_BASE = np.uint64(1_000_003)

_TABLE = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> list[str]:
    """Pieces of letters, in lower case and at most ``PIECE`` characters: the vocabulary of the model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return sorted({p.lower() for p in found if len(p) <= PIECE and re.fullmatch(f"{START}?[^\\W\\d_]+", p)} | {START})


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c)) % 2**64
    return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()


def _units(word: bytes) -> list[str]:
    """The word as strings to segment, the first one marked as a word's start."""
    text = word.decode("utf-8", "replace")
    return [(START if i == 0 else "") + text[i : i + LONGEST] for i in range(0, len(text), LONGEST)]


def _expected(unit: str, n: float, probs: dict[str, float], longest: int, counts: dict[str, float]) -> None:
    """Add the expected number of uses of each piece in ``n`` occurrences of the unit."""
    size = len(unit)
    get = probs.get
    arcs = [
        (i, j, unit[i:j], p)
        for i in range(size)
        for j in range(i + 1, min(size, i + longest) + 1)
        if (p := get(unit[i:j]) or (UNKNOWN if j == i + 1 else None)) is not None
    ]
    ahead = [1.0] + [0.0] * size
    for i, j, _, p in arcs:
        ahead[j] += ahead[i] * p
    back = [0.0] * size + [1.0]
    for i, j, _, p in reversed(arcs):
        back[i] += p * back[j]
    if ahead[size] <= 0:
        return
    for i, j, piece, p in arcs:
        counts[piece] += n * ahead[i] * p * back[j] / ahead[size]


def fit_counts(words: dict[str, Counter], vocabulary: list[str], rounds: int = ROUNDS) -> tuple[list[str], dict, int]:
    """Languages, piece to probability per language, longest piece."""
    longest = max(map(len, vocabulary))
    langs = sorted(words)
    fitted: list[dict[str, float]] = []
    for lang in langs:
        units = Counter()
        for word, n in words[lang].items():
            for unit in _units(word):
                units[unit] += n
        # Before the first round a piece is likelier the longer it is.
        probs = {p: 0.02 / 4.0 ** max(0, 6 - len(p)) for p in vocabulary}
        for _ in range(rounds):
            counts: dict[str, float] = defaultdict(float)
            for unit, n in units.items():
                _expected(unit, n, probs, longest, counts)
            total = sum(counts.values()) + SMOOTHING
            probs = {p: (counts.get(p, 0.0) + SMOOTHING / len(vocabulary)) / total for p in vocabulary}
        fitted.append(probs)
    return langs, {p: tuple(f[p] for f in fitted) for p in vocabulary}, longest


def fit(docs: DataFrame, sample: int = SAMPLE, path: str | None = None) -> tuple | None:
    """Model from rows with a language; None without any."""
    rows = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").filter(F.length("text") <= SAMPLE_CHARS)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(2**40))
    # A language's draw lets about twice the sample through; the window then keeps exactly so many.
    share = {r["lang"]: 2 * sample / r["count"] for r in rows.groupBy("lang").count().collect()}
    if not share:
        return None
    bounds = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(min(2**40, int(v * 2**40)))) for k, v in share.items()]))
    picked = (
        rows.select("doc_id", "lang", draw.alias("draw"))
        .filter(F.col("draw") < bounds[F.col("lang")])
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id")))
        .filter(F.col("rank") <= sample)
        .select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
        .distinct()
    )
    # Broadcast: at most ``sample`` ids of each language.
    rows = (
        docs.select("doc_id", "text", "lang")
        .join(F.broadcast(picked), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
        .filter("text IS NOT NULL")
        .select("text", "lang")
        .collect()
    )
    words: dict[str, Counter] = defaultdict(Counter)
    documents = Counter(r.lang for r in rows)
    for text, lang in rows:
        words[lang].update(words_of(text))
    words = {lang: c for lang, c in words.items() if c}
    if not words:
        return None
    langs, table_, longest = fit_counts(words, pieces(path or vocabulary_path()))
    prior = np.log([documents[lang] for lang in langs])
    return langs, table_, longest, prior - np.log(np.exp(prior).sum())


class _Words(dict):
    """Word to row of the matrix of log probabilities; forgets everything when it is full."""

    def __init__(self, model: tuple):
        langs, table, self.longest, _ = model
        hashes = np.array([_hash(p) for p in table], dtype=np.uint64)
        order = np.argsort(hashes)
        self.pieces, self.probs = hashes[order], np.array(list(table.values()))[order]
        self.rows = np.zeros((MEMO + 1, len(langs)))
        self.letter = np.zeros(MEMO + 1, dtype=bool)

    def _sums(self, units: list[str]) -> np.ndarray:
        """Forward algorithm over many units at once: log of the sum over all segmentations, per language.

        A character outside the vocabulary stands alone, with the same small probability everywhere.
        """
        size = max(map(len, units))
        text = np.array(units, dtype=f"<U{size}").view(np.uint32).reshape(len(units), size).astype(np.uint64)
        sums = np.zeros((size + 1, len(units), self.probs.shape[1]))
        sums[0] = 1.0
        for start in range(size):
            h = np.zeros(len(units), dtype=np.uint64)
            for end in range(start + 1, min(size, start + self.longest) + 1):
                h = h * _BASE + text[:, end - 1]
                at = np.searchsorted(self.pieces, h)
                at[at == len(self.pieces)] = 0
                known = self.pieces[at] == h
                if end == start + 1:
                    p = np.where(known[:, None], self.probs[at], UNKNOWN)
                    sums[end] += sums[start] * p
                else:
                    (some,) = np.nonzero(known)
                    sums[end, some] += sums[start, some] * self.probs[at[some]]
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        return np.log(np.maximum(sums[lengths, np.arange(len(units))], 1e-300))

    def learn(self, words: set[bytes]) -> None:
        """Score the words not yet known, those of like length together."""
        fresh = [w for w in words if w not in self]
        if len(self) + len(fresh) > MEMO:
            self.clear()
            fresh = list(words)
        first = len(self)
        units, owners = [], []
        for k, word in enumerate(fresh):
            self[word] = first + k
            self.letter[first + k] = any(c.isalpha() for c in word.decode("utf-8", "replace"))
            for unit in _units(word):
                units.append(unit)
                owners.append(first + k)
        self.rows[first : first + len(fresh)] = 0
        order = sorted(range(len(units)), key=lambda k: len(units[k]))
        for i in range(0, len(order), 4096):
            part = order[i : i + 4096]
            np.add.at(self.rows, [owners[k] for k in part], self._sums([units[k] for k in part]))

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log probability of each text per language, None if it has no letter."""
        out: list[np.ndarray | None] = []
        totals, letters = np.zeros((len(texts), self.rows.shape[1])), np.zeros(len(texts), dtype=bool)
        waiting: list[tuple[int, list[bytes]]] = []
        held = 0

        def settle() -> None:
            self.learn({w for _, words in waiting for w in words})
            for k, words in waiting:
                at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
                totals[k] += self.rows[at].sum(0)
                letters[k] |= bool(self.letter[at].any())
            waiting.clear()

        for k, text in enumerate(texts):
            words = words_of(text)
            for i in range(0, len(words), 50_000):
                waiting.append((k, words[i : i + 50_000]))
                held += len(waiting[-1][1])
                if held >= 100_000:
                    settle()
                    held = 0
        settle()
        for k in range(len(texts)):
            out.append(totals[k] if letters[k] else None)
        return out


def predict(docs: DataFrame, model: tuple | None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The rows with the predicted language and its score as columns ``names``, which they must not have."""
    schema = docs.withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0)}).schema
    if model is None:
        return docs.withColumns({names[0]: F.lit("und"), names[1]: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by vocabulary and languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = _Words(shared.value)
        langs, prior = shared.value[0], shared.value[3]
        for batch in batches:
            best, scores = [], []
            for total in known.texts(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                if total is None:
                    best.append("und")
                    scores.append(0.0)
                    continue
                total = total + prior
                k = int(np.argmax(total))
                best.append(langs[k])
                scores.append(float(1 / np.exp(total - total[k]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, *names],
            )

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame) -> tuple | None:
    """Model of the four fifths that may train."""
    return fit(docs.filter(~fold(0, 5)))


def op8(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(docs)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", fold(0, 5).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
