"""Byte pair encoding of whole texts with a public vocabulary, and decoding.

Each pre-token is a doubly linked list of symbols; a heap holds the mergeable neighbours by merge rank, and an entry
that no longer fits the list when it is taken out is skipped. Results are kept per distinct pre-token in a bounded
cache of the Python worker, so that a frequent word is merged once and not once per occurrence. Decoding joins the
vocabulary's strings.

Texts are read in Arrow batches and worked through in slices of about ``SLICE_CHARS`` characters, so memory depends
neither on the length of the table nor on how texts are spread over its rows. No shuffle.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct pre-tokens that a worker keeps; then it starts anew.
CACHE = 300_000
#: Characters that are worked on at a time.
SLICE_CHARS = 2_000_000


def byte_symbols() -> list[str]:
    """A visible character for each byte: itself where it is one, else the next free one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class _Cache(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, word):
        self[word] = out = self.make(word)
        return out


class WordEncoder:
    """Encoder for vocabularies with word ends (``</w>``), lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max(self.vocab.values()) + 1)
        for s, i in self.vocab.items():
            self.strings[i] = s
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.bytes = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.cache = _Cache(self.merge)

    def merge(self, word: str) -> tuple[int, ...]:
        symbols = [self.bytes[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        n, ranks = len(symbols), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = left + right, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return tuple(self.vocab[s] for s in symbols if s and s in self.vocab)

    def split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words.findall(text.lower())

    def encode(self, text: str) -> np.ndarray:
        if "<|" in text and (found := list(self.cut.finditer(text))):
            parts, at = [], 0
            for m in found:
                parts += [self.encode_plain(text[at : m.start()]), np.array([self.special[m.group()]], np.int32)]
                at = m.end()
            return np.concatenate([*parts, self.encode_plain(text[at:])])
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.cache.__getitem__, self.split(text))), np.int32)

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids.tolist()))

    def trim(self) -> None:
        if len(self.cache) > CACHE:
            self.cache.clear()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def slices(texts: pa.Array, most: int = SLICE_CHARS):
    """(start, stop) of runs of rows with about ``most`` characters; a longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + most, "right")))
        yield at, to
        at = to


def encode_column(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of ``text`` (array of int) and what they decode to.

    Null and empty texts give an empty array and an empty string. Repeated rows are encoded each. Columns that already
    have the names ``ids`` and ``decoded`` are replaced; all others are kept as they are.
    """
    kept = docs.drop(ids, decoded)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    place = kept.columns.index(text)

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            for a, b in slices(batch.column(place)):
                part = batch.slice(a, b - a)
                found = [bpe.encode(t or "") for t in part.column(place).to_pylist()]
                flat = np.concatenate(found)
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([bpe.decode(x) for x in found], pa.string())], names=[*part.schema.names, ids, decoded])
                bpe.trim()

    return kept.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    out = encode_column(docs.select("doc_id", "text"), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
