"""Encoding of a whole corpus with a public byte-level BPE tokenizer by merge replay.

Texts are split into words by Spark's own regular expressions. A task takes the different words of a batch that it has
not met before together: an inverted index leads from each pair of neighbouring tokens to all positions in all words where it stands,
and the merges are applied in rank order, each to all its positions at once, after which only the touched neighbours
are entered anew. A word that the task has seen before keeps its ids, so frequent words cost one lookup. Words are
independent of each other, so parts of the corpus can be replayed apart without changing any result, and nothing is
shuffled or sent to the driver.

Defined results: a null or empty text gives an empty list; every row gives one row, repeated rows too; special tokens
in a text are ordinary text; a text of any length is encoded whole; an empty table gives an empty table; other columns
are dropped, so their names can't clash.
"""

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
# Fixed value: how the byte-level tokenizers split a text into words. (?U) gives \s, \p{L} and \p{N} their Unicode sense.
WORDS = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a task remembers; beyond that it forgets all and starts again, which changes no result.
REMEMBERED = 1_000_000


class Merges:
    """The vocabulary: ids of single bytes, and for each pair of tokens its rank and the token that it becomes."""

    def __init__(self, path: str | None = None, arrays: dict | None = None) -> None:
        """Read from the file of a tokenizer, or taken from the arrays of another one."""
        if arrays is not None:
            self.__dict__.update(arrays)
            return
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        parts = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in parts], dtype=np.int64) for i in (0, 1))
        self.left, self.right = left, right
        self.result = np.array([vocab[a + b] for a, b in parts], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges or either side is none (-1)."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, number of ids of each word)."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    total = int(sizes.sum())
    # One position for each byte, and an empty one (-1) behind each word, so that neighbours never cross words.
    token = np.full(total + len(words) + 1, -1, dtype=np.int64)
    place = np.arange(total) + np.repeat(np.arange(len(words)), sizes)
    token[place] = merges.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
    after, before = np.arange(1, len(token) + 1), np.arange(-1, len(token) - 1)
    after[-1] = len(token) - 1
    ranks = merges.rank(token[:-1], token[1:])
    at = np.flatnonzero(ranks >= 0)
    at = at[np.argsort(ranks[at], kind="stable")]
    index: dict[int, list[np.ndarray]] = {}
    if len(at):
        cuts = np.flatnonzero(np.diff(ranks[at])) + 1
        index = {int(ranks[group[0]]): [group] for group in np.split(at, cuts)}
    waiting = list(index)
    heapq.heapify(waiting)
    while waiting:
        rank = heapq.heappop(waiting)
        found = index.pop(rank)
        left, right, new = merges.left[rank], merges.right[rank], merges.result[rank]
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        gone = after[at]
        alive = (token[at] == left) & (token[gone] == right)
        if not alive.all():
            at, gone = at[alive], gone[alive]
        if left == right and len(at) > 1:  # of overlapping pairs the leftmost merge
            keep, last = np.ones(len(at), dtype=bool), -1
            for i, (a, g) in enumerate(zip(at.tolist(), gone.tolist())):
                keep[i] = a != last
                last = g if keep[i] else -1
            at, gone = at[keep], gone[keep]
        if not len(at):
            continue
        token[at], token[gone] = new, -2
        beyond = after[gone]
        after[at], before[beyond] = beyond, at
        previous = before[at]
        start = np.concatenate((previous, at))
        touched = merges.rank(np.concatenate((token[previous], token[at])), np.concatenate((token[at], token[beyond])))
        start, touched = start[touched >= 0], touched[touched >= 0]
        if len(start):
            order = np.argsort(touched, kind="stable")
            start, touched = start[order], touched[order]
            for group in np.split(np.arange(len(start)), np.flatnonzero(np.diff(touched)) + 1):
                r = int(touched[group[0]])
                if r not in index:
                    index[r] = []
                    heapq.heappush(waiting, r)
                index[r].append(start[group])
    lengths = np.add.reduceat((token >= 0).astype(np.int64), np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))) if len(words) else np.zeros(0, np.int64)
    return token[token >= 0], lengths


class Memory:
    """Ids of the words that a task has met."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.number = merges, {}
        self.ids, self.start, self.length = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.total = 0

    def lookup(self, words: list[str]) -> np.ndarray:
        """A number for each word; the unknown ones are replayed together."""
        if len(self.number) > REMEMBERED:
            self.__init__(self.merges)
        new = [w for w in words if w not in self.number]
        if new:
            ids, lengths = replay([w.encode() for w in new], self.merges)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.ids.append(ids.astype(np.int32))
            self.start.append(self.total + np.cumsum(lengths) - lengths)
            self.length.append(lengths)
            self.total += len(ids)
            self.ids, self.start, self.length = [np.concatenate(self.ids)], [np.concatenate(self.start)], [np.concatenate(self.length)]
        return np.array([self.number[w] for w in words], dtype=np.int64)


def _encoder(vocabulary: Broadcast, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(Merges(arrays=vocabulary.value))
        for batch in batches:
            *kept, lists = batch.columns
            flat, bounds = lists.flatten(), np.concatenate(([0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
            coded = flat.dictionary_encode()
            number = memory.lookup(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(flat) else np.zeros(0, np.int64)
            length = memory.length[0][number]
            ends = np.concatenate(([0], np.cumsum(length)))
            offsets = ends[bounds]
            if counts:
                out = pa.array(np.diff(offsets), type=pa.int64())
            else:
                within = np.arange(ends[-1]) - np.repeat(ends[:-1], length)
                ids = memory.ids[0][np.repeat(memory.start[0][number], length) + within]
                out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept, out], [*batch.schema.names[:-1], "out"])

    return run


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def _run(df: DataFrame, keep: tuple[str, ...], text: str, path: str, counts: bool, name: str) -> DataFrame:
    kept = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    words = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], _words(F.col(text)).alias("words"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema), f"out {'long' if counts else 'array<int>'}"])
    # The file is read on the driver only; its arrays, some megabytes whatever the corpus, are sent to the machines once.
    vocabulary = df.sparkSession.sparkContext.broadcast(vars(Merges(path)))
    return words.mapInArrow(_encoder(vocabulary, counts), schema).toDF(*keep, name)


def encode(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, ids): the token ids of every text."""
    return _run(df, (key,), text, f"{folder}/{tokenizer}.json", False, "ids")


def count_tokens(df: DataFrame, keep: tuple[str, ...], text: str, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(*keep, tokens): the number of token ids of every text."""
    return _run(df, keep, text, f"{folder}/{tokenizer}.json", True, "tokens")
