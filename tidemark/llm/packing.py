"""Harmonic packing of tokenised documents into fixed-capacity sequences.

A length L belongs to the class k = capacity // L, and each bin of class k takes exactly k
pieces, so a worker fills its bins alone and needs no knowledge of any other worker's. Documents
may be cut, which is used to avoid padding: a piece is kept whole where the slot of its class is
nearly full, else it is cut at the largest slot that it fills.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
_UNUSUAL = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "\u0130", "<|")
#: Texts by which a cache finds out whether a tokenizer works chunk by chunk.
_PROBES = ("Hello, World. It's 42!", "a.b c.. d,,", "école ÉCOLE straße", "tab\tand\nline", "x-y_z 3.14 (ok)", "你好 world", "ﬁne ½ ²", "don't  stop...", "e\u0301 \u200b q", "12345 ab12cd3 a1.5b (716)555-8176 x!!y?.. a_b$c@d.ef, été., straße...")


def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level vocabularies: printable Latin-1
    stands for itself, the other bytes take the letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class WordCache(dict):
    """Ids of white-space separated chunks as little-endian bytes; asks the tokenizer once for each.

    A chunk of letters alone in small, composed form passes the tokenizer's normalizer and splitter
    unchanged, so its model is asked directly, if it gives the same ids for a few probes. A chunk of words,
    digits and signs has the ids of these pieces, one after the other; it is kept itself only if its first
    piece was known, so that a rare word takes one place. A tokenizer for which this fails on a probe gets
    chunks whole, and one that gives other ids for chunks than for whole probes encodes every text whole.
    ``limit`` bounds the bytes of the chunks and their ids: half for those met of late, half for those before.
    """

    def __init__(self, tokenizer, limit: int = 64 << 20):
        super().__init__()
        self.tokenizer, self.limit, self.letters, self.before, self.held = tokenizer, limit, byte_letters(), {}, 0
        self.direct, self.whole, self.split = False, False, True
        self.split = self._probed()
        if not self.split:
            self.clear()
            self.before, self.held = {}, 0
            self.whole = not self._probed()
        self.direct = not self.whole and all(self._whole(w) == self._word(w) for w in ("a", "thehouse", "écoleß", "straße", "ñandú", "слово", "語"))

    def _probed(self) -> bool:
        return all(self.ids(p).tolist() == self._whole(p) for p in _PROBES)

    def _whole(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def _word(self, chunk: str) -> list[int]:
        seen = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(seen)]

    def _pieces(self, chunk: str) -> list[str]:
        """Words, digits and runs of signs of a chunk; of one with an apostrophe or beyond ASCII only the full stops
        and commas after its last letter come off."""
        first = chunk.rstrip(".,")
        if first.isalpha():
            return [first, chunk[len(first) :]]
        if chunk.isascii() and "'" not in chunk:
            return _PIECES.findall(chunk)
        return [first, chunk[len(first) :]] if first != chunk and first[-1:].isalpha() else [chunk]

    def __missing__(self, chunk: str) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            alpha = chunk.isalpha()
            if self.split and not alpha and len(pieces := self._pieces(chunk)) > 1:
                known = pieces[0] in self or pieces[0] in self.before
                ids = b"".join([self[p] for p in pieces])
                if not known:
                    return ids
            else:
                word = alpha and self.direct and (chunk.isascii() or unicodedata.is_normalized("NFC", chunk))
                found = self._word(chunk) if word else self._whole(chunk)
                ids = struct.pack(f"<{len(found)}I", *found)
        self.held += len(ids) + len(chunk) + 120  # the last for the two objects and their place
        if self.held >= self.limit // 2:  # forget the chunks that were not met since the last time
            self.before, self.held = dict(self), 0
            self.clear()
        self[chunk] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        """Equal to encoding the whole text: a tokenizer that works chunk by chunk drops white space,
        lower-cases composed letters, and never joins letters with punctuation. Texts where Python's
        idea of a space or of lower case differs from the tokenizer's, and texts whose small letters
        compose with marks after them, are encoded whole."""
        low = text.lower()
        if self.whole or any(c in text for c in _UNUSUAL) or not unicodedata.is_normalized("NFC", low):
            return np.asarray(self._whole(text), dtype="<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, low.split())), dtype="<u4")


def cuts(n: int, capacity: int, slack: float, whole: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        slot = capacity // (capacity // rest)  # the slot that holds it uncut
        if rest <= whole or slot - rest <= slack * slot:
            out.append(rest)
            break
        piece = capacity // -(-capacity // rest)  # the largest slot that it fills
        out.append(piece)
        rest -= piece
    return out


class HarmonicBins:
    """Open bins of one worker, one for each class; closed bins come out as lists of pieces."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[list]] = {}

    def _close(self, pieces: list[list]) -> list[list]:
        offset = 0
        for p in pieces:
            p += [self.next_id, offset]
            offset += p[2]
        self.next_id += 1
        return pieces

    def add(self, piece: list) -> list[list]:
        k = self.capacity // piece[2]
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) < k:
            return []
        del self.open[k]
        return self._close(pieces)

    def rest(self) -> list[list]:
        """What is left in bins of too few pieces: at most one for each class, joined by first fit."""
        joined: list[tuple[int, list[list]]] = []
        for pieces in sorted(self.open.values(), key=lambda x: -sum(p[2] for p in x)):
            size = sum(p[2] for p in pieces)
            for i, (used, held) in enumerate(joined):
                if used + size <= self.capacity:
                    joined[i] = (used + size, held + pieces)
                    break
            else:
                joined.append((size, pieces))
        self.open = {}
        return [p for _, pieces in joined for p in self._close(pieces)]


#: One cache for each tokenizer file in a worker process, kept from task to task.
_CACHES: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    if path not in _CACHES:
        from tokenizers import Tokenizer

        _CACHES[path] = WordCache(Tokenizer.from_file(path))
    return _CACHES[path]


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, slack: float = 0.02, whole: int = 64) -> DataFrame:
    """One row per piece: which tokens of which document lie where in which sequence.

    Null text is empty, so such a document has the end token alone. Documents with a null or a
    repeated id are packed like any other, each row by itself. An empty table gives no rows;
    columns other than the two named are ignored. Workers share nothing: a lost task is run again
    over the same input split and gives the same pieces and sequence ids.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = word_cache(tokenizer_path)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 33)

        def frame(rows: list[list]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

        for batch in batches:
            done: list[list] = []
            for doc, text in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                ids = np.append(cache.ids(text or ""), np.uint32(end_id)).astype("<u4")
                doc = None if pd.isna(doc) else int(doc)
                start = 0
                for n in cuts(len(ids), capacity, slack, whole):
                    done += bins.add([doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)])
                    start += n
            yield frame(done)
        yield frame(bins.rest())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences of 2,048 tokens; odd rows as ``pack`` says."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
