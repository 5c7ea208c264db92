"""Sum-of-squares online packing of tokenised documents into windows.

A document becomes ids and a closing id. Full windows are cut off its front; the rest is placed by the sum-of-squares rule: with n[h] open
windows filled to level h, an item of size s goes to the level (or a new window) that makes the sum of n[h]^2 smallest. The array n is
all the state; a window at capacity leaves at once. When a task ends, or holds ``max_open`` open windows, the least filled windows are
cut up to fill the fullest, so a task pads one window.

Every task packs the rows of its own input split, so nothing is shuffled and memory is max_open windows. Sequence ids are task number x 2^32 + count.

* null or empty text: the closing id alone. Very long texts fill windows of their own and leave one rest.
* null ids, repeated rows: packed like any other; ties between levels go to the fuller one. Extra columns are ignored; an empty table packs nothing.
* text that spells a special token is encoded as the tokenizer encodes it by default.

Words are split at single blanks between non-blank characters, where this kind of tokenizer always starts a new word; each distinct word, without the
marks behind it, is encoded once while it stays in the worker's caches, whose sizes are fixed. Texts with other white-space runs are cut only where the rule holds.
"""
from __future__ import annotations

import string
import struct
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Marks that form one run behind a word; an apostrophe may begin a word of the tokenizer.
MARKS = string.punctuation.replace("'", "")


class _Recent(dict):
    """What ``make`` gives for a key, made on first use. When half of ``limit`` is full it becomes the older half, and what was the older one goes; keys still in
    use come back from there."""

    def __init__(self, limit: int, make: Callable[[str], bytes | None]):
        super().__init__()
        self.half, self.make, self.older = max(limit // 2, 1), make, {}

    def __missing__(self, key: str) -> bytes | None:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if ids is None:
            return None
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = ids
        return ids


class _Letters(dict):
    """A character as the tokenizer's letters for its bytes."""

    def __init__(self, letters: dict[int, int]):
        super().__init__()
        self.letters = letters

    def __missing__(self, c: str) -> str:
        self[c] = out = c.encode().decode("latin-1").translate(self.letters)
        return out


def _gathered(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries that lie one behind the other those of ``codes``, in that order, and their sizes."""
    start, n = np.cumsum(sizes) - sizes, sizes[codes]
    return ids[np.repeat(start[codes] - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def _pooled(entries: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    entries = [x or b"" for x in entries]
    return np.frombuffer(b"".join(entries), "<u4"), np.fromiter(map(len, entries), np.int64, len(entries)) // 4


class Encoder:
    """Ids of texts as little-endian 32-bit numbers."""

    def __init__(self, path: str, cache_words: int = 500_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tok = Tokenizer.from_file(path)
        self.merged = self.tok.model.tokenize
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # the tokenizer's letters for bytes: printable Latin-1 stands for itself, the rest follows from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [x for x in range(256) if x not in own]
        letters = {x: 256 + i for i, x in enumerate(other)}
        self.letters, self.blank = _Letters(letters), chr(letters[32])
        self.newline = self.whole("\n")
        self.plain = {chr(x) for x in [*own, *letters.values()]} == set(ByteLevel.alphabet()) and self.whole("a.\nb") == self.whole("a.") + self.newline + self.whole("b")
        # letters behind a blank, letters behind a line end, marks behind letters, and all other words behind a blank
        self.cores = _Recent(cache_words, lambda x: self.word(x) if self.plain and x.isalpha() else None)
        self.lines = _Recent(cache_words // 4, lambda x: self._spelled(x, "") if self.plain and x.isalpha() else None)
        self.marks = _Recent(20_000, lambda x: self.whole(x))
        self.words = _Recent(cache_words // 4, lambda x: self.word(x))

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _spelled(self, core: str, before: str) -> bytes:
        """Letters are what the tokenizer takes as one word: straight to its merges."""
        letters = core if core.isascii() else "".join(map(self.letters.__getitem__, core))
        pieces = [t.id for t in self.merged(before + letters)]
        return struct.pack(f"<{len(pieces)}I", *pieces)

    def _marked(self, word: str, cores: _Recent) -> bytes | None:
        """Letters and perhaps a run of marks behind them, which the tokenizer takes as one more word."""
        core = word.rstrip(MARKS)
        ids = cores[core]
        return ids if ids is None or len(core) == len(word) else ids + self.marks[word[len(core):]]

    def word(self, word: str) -> bytes | None:
        """Behind a blank. Nothing where white space other than a single blank is between words."""
        if self.plain and word.isalpha():
            return self._spelled(word, self.blank)
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if "\n" in word and self.plain:
            first, *rest = word.split("\n")
            if all(rest) and not any(x[0].isspace() or x[-1].isspace() for x in (first, *rest)):
                # a line end is a word of its own where no blank is near
                lines = [self.newline + (self._marked(x, self.lines) or self.whole(x)) for x in rest]
                return (self._marked(first, self.cores) or self.whole(" " + first)) + b"".join(lines)
        return self.whole(" " + word)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0].tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Each distinct word of the texts is looked up once, without the marks behind it; the ids of all are then gathered."""
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        at, coded = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        trimmed = pc.ascii_rtrim(words, characters=MARKS)
        cores = trimmed.dictionary_encode()
        head, marks = cores.indices.to_numpy().astype(np.int64), pc.subtract(pc.binary_length(words), pc.binary_length(trimmed)).to_numpy().copy()
        entries = list(map(self.cores.__getitem__, cores.dictionary.to_numpy(zero_copy_only=False)))
        odd = np.asarray([x is None for x in entries])[head]
        head[odd], marks[odd] = len(entries) + np.arange(odd.sum()), 0
        entries += map(self.words.__getitem__, words.filter(pa.array(odd)).to_numpy(zero_copy_only=False))
        unsafe = np.asarray([x is None for x in entries])[head]
        marked = marks > 0
        runs = [w[-n:] for w, n in zip(words.filter(pa.array(marked)).to_numpy(zero_copy_only=False), marks[marked].tolist())]
        place = {x: len(entries) + i for i, x in enumerate(dict.fromkeys(runs))}
        tail = np.full(len(head), len(entries) + len(place))
        tail[marked] = [place[x] for x in runs]
        ids, n = _gathered(*_pooled([*entries, *map(self.marks.__getitem__, place), b""]), np.stack([head, tail], 1).ravel())
        # the first word has no blank before it: each text has an entry of its own, for all of it where it is not cut at blanks
        codes[at[:-1]] = len(head) + np.arange(len(texts))
        uncut, own = np.logical_or.reduceat(np.append(unsafe, [False] * len(texts))[codes], at[:-1]), []
        for i, text in enumerate(texts):
            first = text.partition(" ")[0]
            special = any(s in text for s in self.special)
            if special or uncut[i] or first[-1:].isspace():
                codes[at[i] + 1:at[i + 1]] = len(head) + len(texts)
                own.append(self.whole(text) if special else b"".join(map(self.whole, self.parts(text))))
            else:
                own.append(self.whole(first) if first else b"")
        own, sizes = _pooled([*own, b""])
        ids, n = _gathered(np.concatenate([ids, own]), np.concatenate([n.reshape(-1, 2).sum(1), sizes]), codes)
        return np.split(ids, np.cumsum(n)[at[1:-1] - 1])

    @staticmethod
    def parts(text: str) -> list[str]:
        """Cut only before a single blank between two non-blank characters; runs of other white space stay inside a part."""
        out, start, at = [], 0, text.find(" ")
        while at >= 0:
            if at and at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
                out.append(text[start:at])
                start = at
            at = text.find(" ", at + 1)
        out.append(text[start:])
        return [x for x in out if x]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker: its cache of words lasts from task to task."""
    return Encoder(path)


class Windows:
    """Open windows by level. An item is (document, start, ids, document tokens)."""

    def __init__(self, capacity: int, first_id: int, max_open: int):
        self.capacity, self.next_id, self.max_open = capacity, first_id, max_open
        self.n = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.count = 0

    def level(self, size: int) -> int:
        """The level h to place on: moving a window from h to h + size changes the sum by 2 (n[h + size] - n[h]) + 2."""
        h = self.capacity - size
        change = 2 * (self.n[size:] - self.n[:h + 1]) + 2
        change[0] = 2 * self.n[size] + 1
        change[h] = 0 if h == 0 else 1 - 2 * self.n[h]
        change[1:][self.n[1:h + 1] == 0] = np.iinfo(np.int64).max
        return int(h - np.argmin(change[::-1]))

    def add(self, item) -> Iterator[list]:
        size = len(item[2])
        h = self.level(size) if size < self.capacity else 0
        if h:
            window = self.open[h].pop()
            self.n[h] -= 1
            self.count -= 1
        else:
            window = []
        window.append(item)
        if h + size == self.capacity:
            yield window
            return
        self.open[h + size].append(window)
        self.n[h + size] += 1
        self.count += 1
        if self.count >= self.max_open:
            yield from self.close()

    def close(self) -> Iterator[list]:
        """Fullest windows first, filled with pieces of the least filled ones."""
        left = deque(w for level in self.open[::-1] for w in level)
        self.open = [[] for _ in range(self.capacity + 1)]
        self.n[:], self.count = 0, 0
        loose: list = []
        while left:
            window = left.popleft()
            room = self.capacity - sum(len(i[2]) for i in window)
            while room and (loose or left):
                if not loose:
                    loose = left.pop()
                doc, start, ids, total = loose.pop()
                take, rest = ids[:room], ids[room:]
                window.append((doc, start, take, total))
                room -= len(take)
                if len(rest):
                    loose.append((doc, start + len(take), rest, total))
            yield window
        if loose:
            yield loose


def spans(texts: list[str], most: int, chars: int) -> Iterator[tuple[int, int]]:
    """Neighbours, at most ``most``, together at most ``chars`` characters unless it is one text."""
    a = size = 0
    for i, text in enumerate(texts):
        if i > a and (i - a >= most or size + len(text) > chars):
            yield a, i
            a, size = i, 0
        size += len(text)
    if texts:
        yield a, len(texts)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, close_id: int = 0, max_open: int = 4096, id_col: str = "doc_id", text_col: str = "text", batch: int = 1000, batch_chars: int = 4_000_000) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``tokenizer`` is the path of its file. Texts are encoded ``batch`` at a time,
    fewer where they are long."""

    def rows(windows: Windows, done: Iterator[list]):
        for w in done:
            seq, at = windows.next_id, 0
            windows.next_id += 1
            for doc, start, ids, total in w:
                yield doc, start, len(ids), zlib.crc32(ids.tobytes()), total, seq, at
                at += len(ids)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_all = encoder(tokenizer).encode_all
        windows = Windows(capacity, TaskContext.get().partitionId() << 32, max_open)
        names = [c.split()[0] for c in PIECES.split(", ")]
        end = np.asarray([close_id], "<u4")

        def frame(out):
            return pd.DataFrame(out, columns=names).astype({"doc_id": object})

        for pdf in it:
            texts = [t or "" for t in pdf["text"]]
            for a, b in spans(texts, batch, batch_chars):
                out = []
                for doc, ids in zip(pdf["id"].iloc[a:b], encode_all(texts[a:b])):
                    ids, doc = np.append(ids, end), None if pd.isna(doc) else doc
                    for start in range(0, len(ids), capacity):
                        out.extend(rows(windows, windows.add((doc, start, ids[start:start + capacity], len(ids)))))
                yield frame(out)
        yield frame(list(rows(windows, windows.close())))

    # ids as text, so that a null among them does not turn all into doubles
    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, PIECES.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def sequences(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """The windows themselves: sequence_id, length, and its pieces in order."""
    pieces = pack(docs, tokenizer, **kw)
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length"))).alias("pieces"))
