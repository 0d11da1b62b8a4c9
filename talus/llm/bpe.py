"""Byte-level BPE encoding and decoding of whole texts.

Encoding keeps the symbols of one word in a doubly linked list and the candidate merges in a priority queue of
(merge rank, position). An entry whose pair has changed since it was queued is stale and skipped. Decoding
concatenates vocabulary strings. Words repeat, so each Python worker remembers the ids of recent words; that
memory has a fixed bound and does not change a result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from talus.llm.common import map_batches, table

#: The pre-tokenisation of byte-level BPE vocabularies of this kind (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that one worker remembers, at most, in each of two generations.
REMEMBERED = 450_000
#: Longer words are encoded anew each time.
LONGEST_REMEMBERED = 64
#: Longer words are merged by the queue even where the library is given.
LONGEST_MERGED = 4096


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable letter: itself, or the next free one from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Remembering(dict):
    """A dict that computes what it lacks. When it is full it becomes the old generation and starts anew; what is
    used again comes back from there."""

    def __init__(self, compute: Callable[[str], bytes], most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= LONGEST_REMEMBERED and "\n" not in key:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class BytePairCodec:
    """Encoder and decoder over a vocabulary file of the ``tokenizers`` library.

    ``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes, equal to that library's ids with
    ``add_special_tokens=False``: special tokens written out in a text become their id, all else is merged.
    """

    def __init__(self, path: str, ranks: str | None = None, most: int = REMEMBERED):
        """``ranks``: the same vocabulary as a tiktoken file; words are then merged by that library."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.letter = [letters[b] for b in range(256)]
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        # Symbols are ids; a merge is looked up by its two ids.
        self.merge = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.byte_id = [self.vocab[c] for c in self.letter]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for s, i in self.vocab.items():
            self.strings[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            merged = tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=pieces, special_tokens={}).encode_ordinary
            # That library's own splitting overflows its stack on very long runs, so these are merged here.
            by_queue = self.encode_word
            self.encode_word = lambda word: np.array(merged(word), "<u4").tobytes() if len(word) <= LONGEST_MERGED else by_queue(word)
        self.by_word = _Remembering(self.encode_word, most)
        # A chunk is what stands between single spaces; it is kept without its leading space.
        self.by_chunk = _Remembering(self.encode_chunk, most)

    def encode_word(self, word: str) -> bytes:
        """Merge the bytes of one word by rank."""
        ids = [self.byte_id[b] for b in word.encode()]
        n = len(ids)
        if n > 1:
            merge = self.merge
            after = [*range(1, n), -1]
            before = [-1, *range(n - 1)]
            queue = []
            for i in range(n - 1):
                found = merge.get((ids[i], ids[i + 1]))
                if found:
                    queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
            heapq.heapify(queue)
            while queue:
                _, i, left, right, made = heapq.heappop(queue)
                j = after[i]
                if ids[i] != left or j < 0 or ids[j] != right:
                    continue  # stale
                ids[i] = made
                ids[j] = -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    found = merge.get((made, ids[k]))
                    if found:
                        heapq.heappush(queue, (found[0], i, made, ids[k], found[1]))
                h = before[i]
                if h >= 0:
                    found = merge.get((ids[h], made))
                    if found:
                        heapq.heappush(queue, (found[0], h, ids[h], made, found[1]))
            ids = [x for x in ids if x >= 0]
        return np.array(ids, "<u4").tobytes()

    def encode_words(self, text: str) -> bytes:
        return b"".join(map(self.by_word.__getitem__, self.words.findall(text)))

    def encode_chunk(self, chunk: str) -> bytes:
        """What follows a single space, with that space."""
        if chunk.isalpha():
            return self.encode_word(" " + chunk)
        words = self.words.findall(" " + chunk)
        if len(words) == 1:
            return self.encode_word(words[0])
        return b"".join([self.by_chunk[w[1:]] if w[0] == " " and len(w) > 1 else self.by_word[w] for w in words])

    def encode_plain(self, text: str) -> bytes:
        """A space before a non-space always starts a word, so the text may be cut there first."""
        if regex.search(r" \s| $|^\s", text):
            chunks = re.split(r" (?=\S)", text)
        else:
            chunks = text.split(" ")
        return self.encode_words(chunks[0]) + b"".join(map(self.by_chunk.__getitem__, chunks[1:]))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.encode_plain(text)
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out.append(self.encode_plain(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Concatenate vocabulary strings; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.cache
def codec(path: str, ranks: str | None = None, most: int = REMEMBERED) -> BytePairCodec:
    """One codec for each vocabulary and Python worker."""
    return BytePairCodec(path, ranks, most)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs``, in a narrow stage.

    A null or empty text has no ids. Repeated rows each give a row. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        c = codec(vocabulary)
        for b in batches:
            ids = [np.frombuffer(c.encode(t), "<u4").astype(np.int32) for t in b.column(1).to_pylist()]
            yield {"doc_id": b.column(0), "ids": ids}

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from rows of ids; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        c = codec(vocabulary)
        for b in batches:
            texts = [c.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield {"doc_id": b.column(0), "text": texts}

    return map_batches(encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")), run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode, every text: its number of tokens and SHA-256 of the ids and of the decoded text.

    Null and empty texts have 0 tokens and the digests of an empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        c = codec(vocabulary)
        decimals = [str(i) for i in range(len(c.strings))]
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for value in b.column(1):
                ids = c.encode(value.as_py())
                numbers = np.frombuffer(ids, "<u4").tolist()
                n.append(len(numbers))
                ids_sha.append(hashlib.sha256(",".join(map(decimals.__getitem__, numbers)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield {"doc_id": b.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return map_batches(
        docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")),
        run,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_vocabulary())
