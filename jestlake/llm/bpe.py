"""Problem 8: encoding of a whole corpus with a public byte-pair tokenizer.

Method: prefix-sharing trie traversal. The distinct words of a batch are walked depth first in byte order; the state kept
for each byte prefix is the last token of its encoding, and a word takes over the states of the prefix it shares with the
word before it, so that a shared prefix is encoded once. A token is the last one of a prefix when its bytes end the prefix
and it may follow the last token of what is before it, which is decided by undoing merges across the border.

Defined results: null and empty texts both give an empty list; strings that look like special tokens are ordinary text;
rows are encoded whole whatever their length; repeated rows give equal lists; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into words before merging; part of the tokenizer's public definition.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_WORDS = 400_000  # words a worker remembers between batches
KEPT_BYTES = 40  # longer words are encoded but not remembered


class TrieBpe:
    """Byte-pair encoder over a rank file."""

    def __init__(self, vocab_path: str = VOCAB):
        with open(vocab_path, "rb") as file:
            self.rank = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in file if line.strip())}
        self.bytes_of = {rank: word for word, rank in self.rank.items()}
        self.begins = {word[:k] for word in self.rank for k in range(1, len(word) + 1)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.known: dict[str, np.ndarray] = {}
        self.words = regex.compile(PATTERN)

    def _parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge gives this one; a single byte is its own two parts."""
        made = self.parts.get(token)
        if made is None:
            word = self.bytes_of[token]
            pieces = [word[i : i + 1] for i in range(len(word))]
            while len(pieces) > 2:
                best = min((self.rank.get(pieces[i] + pieces[i + 1], 1 << 30), i) for i in range(len(pieces) - 1))
                if best[0] >= token:
                    break
                pieces[best[1] : best[1] + 2] = [pieces[best[1]] + pieces[best[1] + 1]]
            made = (token, token) if len(pieces) == 1 else (self.rank[pieces[0]], self.rank[b"".join(pieces[1:])])
            self.parts[token] = made
        return made

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of the joined bytes keeps the border between the two tokens."""
        answer = self.follows.get((left, right))
        if answer is None:
            answer = self.follows[(left, right)] = self._border_holds(left, right)
            if len(self.follows) > 2_000_000:
                self.follows.clear()
        return answer

    def _border_holds(self, left: int, right: int) -> bool:
        limit = 1 << 30  # merges of this rank or later are already undone
        while True:
            joined = self.rank.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < limit and self._joins(left, right, joined):
                return False
            l_parts, r_parts = self._parts(left), self._parts(right)
            l_whole, r_whole = l_parts[0] == l_parts[1] == left, r_parts[0] == r_parts[1] == right
            if l_whole and r_whole:
                return True
            # the later of the two merges is undone; at equal rank the one on the left happened first
            if r_whole or (not l_whole and left > right):
                limit, left = left, l_parts[1]
            else:
                limit, right = right + 1, r_parts[0]

    def _joins(self, left: int, right: int, joined: int) -> bool:
        return self._parts(joined) == (left, right)

    def walk(self, words: list[bytes]) -> list[np.ndarray]:
        """Encodings of words in byte order, in that order."""
        out: list[np.ndarray] = []
        last: list[int] = []  # last[d]: last token of the prefix of d + 1 bytes
        open_at: list[list[int]] = []  # open_at[d]: starts of byte runs ending at d that begin some token
        before = b""
        rank, begins, may_follow = self.rank, self.begins, self._may_follow
        for word in words:
            same = 0
            top = min(len(word), len(before))
            while same < top and word[same] == before[same]:
                same += 1
            del last[same:], open_at[same:]
            for d in range(same, len(word)):
                starts = [s for s in (open_at[d - 1] if d else ()) if word[s : d + 1] in begins]
                starts.append(d)
                open_at.append(starts)
                for s in starts:  # the longest first
                    token = rank.get(word[s : d + 1])
                    if token is not None and (s == 0 or may_follow(last[s - 1], token)):
                        last.append(token)
                        break
            before = word
            ids, at = [], len(word)
            while at:
                token = last[at - 1]
                ids.append(token)
                at -= len(self.bytes_of[token])
            out.append(np.array(ids[::-1], np.int32))
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        split = [self.words.findall(t) if t else [] for t in texts]
        known = self.known
        fresh = {w for ws in split for w in ws if w not in known}
        order = sorted((w.encode("utf-8", "replace"), w) for w in fresh)
        made = dict(zip((w for _, w in order), self.walk([b for b, _ in order])))
        empty = np.empty(0, np.int32)
        out = [np.concatenate([made[w] if w in made else known[w] for w in ws]) if ws else empty for ws in split]
        if len(known) + len(made) > KEPT_WORDS:
            known.clear()
        known.update((w, ids) for w, ids in made.items() if len(w) <= KEPT_BYTES)
        return out


_encoders: dict[str, TrieBpe] = {}


def encoder(vocab_path: str = VOCAB) -> TrieBpe:
    """The worker's encoder, made once per process."""
    if vocab_path not in _encoders:
        _encoders[vocab_path] = TrieBpe(vocab_path)
    return _encoders[vocab_path]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def encode(df: DataFrame, key: str, text: str, vocab_path: str = VOCAB) -> DataFrame:
    """(key, ids): token ids of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocab_path)
        for batch in _slices(batches):
            ids = bpe.encode_batch(batch.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))], names=["_k", "ids"])

    source = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return source.mapInArrow(run, f"_k {source.schema['_k'].dataType.simpleString()}, ids array<int>").withColumnRenamed("_k", key)


def count_tokens(df: DataFrame, text: str, vocab_path: str = VOCAB, into: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of its text column in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocab_path)
        for batch in _slices(batches):
            at = batch.schema.names.index(text)
            sizes = pa.array([len(i) for i in bpe.encode_batch(batch.column(at).to_pylist())], pa.int64())
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), sizes], names=[*(batch.schema.names[i] for i in keep), into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)
    return df.mapInArrow(run, f"{fields}, `{into}` bigint")


_libraries: dict[str, object] = {}


def _library(path: str):
    """Encoder of a tokenizer file by its library: .json by tokenizers, .model by sentencepiece; made once per process."""
    if path not in _libraries:
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _libraries[path] = lambda texts: pieces.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True  # their strings in a text are ordinary text
            own.no_truncation()
            _libraries[path] = lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    return _libraries[path]


def encode_by_library(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids) by a tokenizer that isn't byte-level merging over ranks; nulls and empty texts give an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _library(path)
        for batch in _slices(batches, 200):
            ids = own([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["_k", "ids"])

    source = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return source.mapInArrow(run, f"_k {source.schema['_k'].dataType.simpleString()}, ids array<int>").withColumnRenamed("_k", key)
