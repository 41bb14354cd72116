"""Mixture-controlled packing into fixed windows by deficit round-robin.

Each source is a queue of the tokens of its documents. Every window of ``WINDOW`` tokens takes from
each queue its target share, the queue's part of all tokens, so that all queues end together. What a
queue is owed beyond whole tokens is its deficit, carried to the next window. The carried deficit is
kept in closed form: sources are the leaves of a binary tree, and of the first m tokens of a node
floor(m * left / node) go to its left child. So any task can say, for any window, how many tokens of
a queue came before it, without walking the windows: deficits cross windows and partitions. After
every window each source is within a few tokens (at most the depth of the tree) of its share.

Only the last window can be short. A document is cut wherever a window ends its source's turn; each
piece is one row.

Defined results: null text is empty and has only the end token; a null source is a queue of its own;
repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.llm.common import held, release, staged, table

WINDOW = 4096
END = 2
MEMO = 300_000
TOKENIZER = "word_bpe_49k.json"
#: Latin letters and signs after them: the vocabulary takes each of the two as one word, so their ids can be joined.
_LETTERS = re.compile("([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
_END_OF_WORD = "</w>"

PIECES = (
    "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Ids:
    """Ids of runs without white space. This vocabulary drops white space and case and never joins across
    white space, so the ids of a text are those of its runs in lower case.

    Runs seen so far are kept: ``known`` has the newest, ``old`` those before, each up to a bound, so
    that frequent runs stay. New runs are encoded many at a time, with a special token between them
    that no run contains. That token makes the tokenizer start anew for each run. Runs of letters, with or
    without signs after them, are most: their letters are encoded with spaces between, and the ids are cut
    after those that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids are kept as 16-bit integers")
        self.encode = tokenizer.encode_batch_fast
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.ends = np.zeros(65_536, dtype=bool)
        self.ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith(_END_OF_WORD)]] = True

    def _learn(self, runs: list[bytes]) -> None:
        """Make new runs known: those of letters and signs by these parts, the others whole."""
        words: set[bytes] = set()
        split: list[tuple[bytes, bytes, bytes]] = []
        whole: list[bytes] = []
        for run in runs:
            found = _LETTERS.fullmatch(run.decode("utf-8", "replace"))
            if found is None:
                whole.append(run)
                continue
            signs = found[2].encode()
            word = run[: len(run) - len(signs)]
            words.add(word)
            if signs:
                split.append((run, word, signs))
        for word in words:
            if word not in self.known and word in self.old:
                self.known[word] = self.old[word]
        whole += self._learn_words([w for w in words if w not in self.known])
        whole += {signs for _, _, signs in split if signs not in self.known}
        self._learn_whole(whole)
        for run, word, signs in split:
            self.known[run] = self.known[word] + self.known[signs]

    def _learn_words(self, words: list[bytes]) -> list[bytes]:
        """Make words of letters known; those that could not be told apart in the ids are returned."""
        left: list[bytes] = []
        for i in range(0, len(words), 2_000):
            part = words[i : i + 2_000]
            (found,) = self.encode([b" ".join(part).decode()], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                left += part
                continue
            data, start = ids.tobytes(), 0
            for word, end in zip(part, (4 * cuts).tolist()):
                self.known[word] = data[start:end]
                start = end
        return left

    def _learn_whole(self, runs: list[bytes]) -> None:
        between = min(self.special)
        for i in range(0, len(runs), 2_000):
            part = runs[i : i + 2_000]
            text = between.join([r.decode("utf-8", "replace") for r in part])
            if text.count(between) >= len(part) or any(s in text for s in self.special if s != between):
                for run in part:
                    (found,) = self.encode([run.decode("utf-8", "replace")], add_special_tokens=False)
                    self.known[run] = np.array(found.ids, dtype="<u4").tobytes()
                continue
            (found,) = self.encode([text], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            data, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.special[between])).tolist()
            start = 0
            for run, end in zip(part, [*cuts, len(data)], strict=True):
                self.known[run] = data[start:end]
                start = end + 4

    def _meet(self, fresh: set[bytes]) -> None:
        """Make runs known that are not."""
        if len(self.known) + len(fresh) > MEMO:
            self.old, self.known = self.known, {}
        again = {r: self.old[r] for r in fresh if r in self.old}
        self.known.update(again)
        self._learn([r for r in fresh if r not in again])

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, the end token last."""
        out: list[list[bytes]] = []
        waiting: list[tuple[int, list[bytes]]] = []
        held = 0

        def settle() -> None:
            found = [list(map(self.known.get, runs)) for _, runs in waiting]
            gaps = [[i for i, x in enumerate(ids) if x is None] for ids in found]
            self._meet({runs[i] for (_, runs), places in zip(waiting, gaps) for i in places})
            for (k, runs), ids, places in zip(waiting, found, gaps):
                for i in places:
                    ids[i] = self.known[runs[i]]
                out[k].append(b"".join(ids))
            waiting.clear()

        for k, text in enumerate(texts):
            out.append([])
            data = (text or "").encode("utf-8", "surrogatepass")
            # A special token's name counts only as it is written.
            runs = (data if b"<|" in data else data.lower()).split()
            for i in range(0, len(runs), 50_000):
                waiting.append((k, runs[i : i + 50_000]))
                held += len(waiting[-1][1])
                if held >= 100_000:
                    settle()
                    held = 0
        settle()
        return [b"".join([*parts, _END]) for parts in out]

    def text(self, text: str | None) -> bytes:
        return self.texts([text])[0]


_END = np.array([END], dtype="<u4").tobytes()


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(row, part, doc_id, source, tokens, ids): ids as 16-bit integers; a larger vocabulary is refused."""
    schema = "row long, part int, doc_id long, source string, tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, row = held(("ids", path), lambda: _Ids(path)), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                found = [np.frombuffer(t, dtype="<u4") for t in ids.texts(piece.column(1).to_pylist())]
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n, dtype=np.int64) + (part << 33)),
                        pa.array(np.full(n, part, dtype=np.int32)),
                        piece.column(0).cast(pa.int64()),
                        piece.column(2).cast(pa.string()),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([f.astype("<u2").tobytes() for f in found], pa.binary()),
                    ],
                    names=["row", "part", "doc_id", "source", "tokens", "ids"],
                )
                row += n

    return docs.select("doc_id", "text", "source").mapInArrow(run, schema)


def queues(lengths: DataFrame) -> DataFrame:
    """Per source: all tokens, and the path from the root of the tree to its leaf.

    A step of the path is (tokens of the node, tokens of its left child, whether the leaf is right).
    """
    totals = lengths.groupBy("source").agg(F.sum("tokens").alias("queue"))
    leaves = totals.withColumn(
        "leaf", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("depth", F.ceil(F.log2(F.count("*").over(Window.partitionBy()).cast("double"))).cast("int"))
    levels = F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level")
    # Node k of level v covers leaves k * 2^v to (k + 1) * 2^v - 1.
    node = F.expr("cast(floor(leaf / pow(2, level)) as bigint)")
    nodes = leaves.select(levels, "leaf", "queue").groupBy("level", node.alias("node")).agg(F.sum("queue").alias("of_node"))
    steps = leaves.select("source", "leaf", "queue", "depth", F.explode(F.expr("IF(depth = 0, array(), sequence(1, depth))")).alias("level"))
    steps = steps.withColumn("node", node).withColumn("left", F.col("node") * 2).withColumn("below", F.col("level") - 1)
    left = nodes.select(F.col("level").alias("below"), F.col("node").alias("left"), F.col("of_node").alias("of_left"))
    paths = (
        steps.join(nodes, ["level", "node"])
        .join(left, ["below", "left"])
        .groupBy("leaf")
        .agg(
            F.reverse(
                F.array_sort(
                    F.collect_list(
                        F.struct(
                            "level", "of_node", "of_left",
                            (F.expr("cast(floor(leaf / pow(2, level - 1)) as bigint) % 2 = 1")).alias("right"),
                        )
                    )
                )
            ).alias("path")
        )
    )
    return leaves.join(paths, "leaf", "left").select(
        "source", "queue", F.sum("queue").over(Window.partitionBy()).alias("all_tokens"), "path"
    )


def positions(lengths: DataFrame) -> DataFrame:
    """(row, source, at): tokens before each document in its source's queue, in row order.

    Running sums are taken per task of the scan and over the tasks' sums, so that a queue of any
    length is no single group.
    """
    inside = Window.partitionBy("source", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = lengths.groupBy("source", "part").agg(F.sum("tokens").alias("sum")).select(
        F.col("source").alias("_source"), F.col("part").alias("_part"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("_before"),
    )
    return (
        lengths.withColumn("_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
        .select("row", "source", (F.col("_inside") + F.col("_before")).alias("at"))
    )


def taken(m: int, path: list[tuple[int, int, bool]]) -> tuple[int, int]:
    """Of the first ``m`` tokens of all windows: those of earlier leaves, and those of the path's leaf."""
    earlier = 0
    for node, left, right in path:
        to_left = m * left // node
        if right:
            earlier += to_left
            m -= to_left
        else:
            m = to_left
    return earlier, m


def _window_at(x: int, first: int, last: int, guess: int, own) -> int:
    """The first window from ``first`` on after which more than ``x`` tokens of the queue are taken."""
    low = high = max(first, min(last, guess))
    step = 1
    while high < last and own(high + 1)[1] <= x:
        low, high, step = high + 1, min(last, high + step), step * 2
    step = 1
    while low > first and own(low)[1] > x:
        low, high, step = max(first, low - step), low, step * 2
    while low < high:
        middle = (low + high) // 2
        if own(middle + 1)[1] > x:
            high = middle
        else:
            low = middle + 1
    return low


def _pieces(at: int, n: int, queue: int, total: int, path: list, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of each piece of a document that begins at ``at``."""
    last = (total - 1) // window
    own = lambda w: taken(min(w * window, total), path)
    w = _window_at(at, 0, last, at * total // (queue * window), own)
    here, after = own(w), own(w + 1)
    start = 0
    while True:
        length = min(n - start, after[1] - at - start)
        yield start, length, w, after[0] - here[0] + at + start - here[1]
        start += length
        if start == n:
            return
        w, here, after = w + 1, after, own(w + 2)
        if after[1] <= at + start:  # a small queue has no turn in most windows
            w = _window_at(at + start, w, last, w, own)
            here, after = own(w), own(w + 1)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row of ``PIECES`` per piece of a document in a window."""
    tokens = staged(tokenised(docs, path or tokenizer_path()))
    lengths = tokens.select("row", "part", "source", "tokens")
    known = queues(lengths).withColumnRenamed("source", "_source")
    placed = (
        positions(lengths)
        .join(known, F.col("source").eqNullSafe(F.col("_source")))
        .select("row", "at", "queue", "all_tokens", "path")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        paths: dict[str | None, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                docs_, sources, data, ats, queues_, totals = (part.column(k).to_pylist() for k in range(1, 7))
                out: list[list] = [[] for _ in range(8)]
                for k, source in enumerate(sources):
                    if source not in paths:
                        paths[source] = [(s["of_node"], s["of_left"], s["right"]) for s in part.column(7)[k].as_py() or ()]
                    ids = np.frombuffer(data[k], dtype="<u2").astype("<u4")
                    raw, n = ids.tobytes(), len(ids)
                    for start, length, sequence, offset in _pieces(ats[k], n, queues_[k], totals[k], paths[source], window):
                        crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                        for column, value in zip(out, (docs_[k], source, start, length, crc, n, sequence, offset)):
                            column.append(value)
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds)],
                    names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    return (
        tokens.select("row", "doc_id", "source", "ids")
        .join(placed, "row")
        .select("row", "doc_id", "source", "ids", "at", "queue", "all_tokens", "path")
        .mapInArrow(run, PIECES)
    )


def op3(spark, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
