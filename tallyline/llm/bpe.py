"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut by a pattern, each match is encoded by itself: its bytes stand in a linked list, every
adjacent pair that has a rank waits in the bucket of that rank, and a two-level bitmap of non-empty
buckets gives the next rank by find-first-set. Entries whose pair has changed are skipped when they
are met. A match of n bytes takes about n log n steps however long it is.

Each worker keeps the ids of short matches it has met, up to a fixed number; longer ones are encoded
each time. Texts are whole; null counts as empty and gives no ids.
"""

import base64
import hashlib
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import functions as F

from tallyline.llm.common import filled, ship_package

WORD_BITS = 256
SHORT = 64
CACHED, CACHED_BYTES = 450_000, 48  # matches in each half of the cache, and their length


def read_ranks(path):
    """Ranks of byte strings from a file of base64 texts and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    def __init__(self, ranks, pattern):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.known, self.older = {}, {}

    def merge(self, data):
        """Ids of one match's bytes.

        `top` marks the words of ranks that wait, `words` the ranks in them, and `buckets` the
        positions of a rank: as bits if the match is short, else in a heap.
        """
        rank_of, size = self.ranks.get, len(data)
        whole = rank_of(data)
        if whole is not None:
            return [whole]
        short = size <= SHORT
        parts = [data[i:i + 1] for i in range(size)]
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        wanted, buckets, words, top = [None] * size, {}, {}, 0
        waiting = [(rank, i) for i in range(size - 1) if (rank := rank_of(data[i:i + 2])) is not None]
        while True:
            for rank, i in waiting:
                wanted[i] = rank
                bucket = buckets.get(rank)
                if not bucket:
                    word = rank // WORD_BITS
                    words[word] = words.get(word, 0) | 1 << rank % WORD_BITS
                    top |= 1 << word
                    buckets[rank] = 1 << i if short else [i]
                elif short:
                    buckets[rank] = bucket | 1 << i
                else:
                    heappush(bucket, i)
            if not top:
                return [self.ranks[p] for p in parts if p is not None]
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = word * WORD_BITS + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if short:
                i = (bucket & -bucket).bit_length() - 1
                buckets[rank] = bucket = bucket & bucket - 1
            else:
                i = heappop(bucket)
            if not bucket:
                words[word] = bits = bits & bits - 1
                if not bits:
                    top &= top - 1
            waiting = []
            if wanted[i] != rank:
                continue
            gone = after[i]
            parts[i] = merged = parts[i] + parts[gone]
            parts[gone] = wanted[gone] = wanted[i] = None
            after[i] = right = after[gone]
            if right < size:
                before[right] = i
                if (rank := rank_of(merged + parts[right])) is not None:
                    waiting.append((rank, i))
            left = before[i]
            if left >= 0:
                wanted[left] = None
                if (rank := rank_of(parts[left] + merged)) is not None:
                    waiting.append((rank, left))

    def match_ids(self, match):
        """The ids of a match, packed."""
        packed = self.older.get(match)
        if packed is None:
            data = match.encode("utf-8")
            packed = array("I", self.merge(data)).tobytes()
            if len(data) > CACHED_BYTES:
                return packed
        if len(self.known) >= CACHED:
            self.known, self.older = {}, self.known
        self.known[match] = packed
        return packed

    def encode(self, text):
        """The ids of a text, packed as little-endian unsigned 32-bit integers."""
        known, ids, out = self.known, self.match_ids, []
        for match in self.find(text):
            packed = known.get(match)
            if packed is None:
                packed = ids(match)
                known = self.known
            out.append(packed)
        return b"".join(out)

    def decode(self, packed):
        """The bytes of packed ids."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path, pattern):
    """One encoder for each worker process."""
    return Encoder(read_ranks(path), pattern)


def encode_column(text, path, pattern):
    """Packed ids of a text column."""
    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        own = encoder(path, pattern)
        return texts.map(lambda t: own.encode(t or ""))

    return encode(text)


def decode_column(ids, path, pattern):
    """Bytes of a column of packed ids."""
    @F.pandas_udf("binary")
    def decode(packed: pd.Series) -> pd.Series:
        own = encoder(path, pattern)
        return packed.map(lambda p: own.decode(p or b""))

    return decode(ids)


def tokenised(docs, path, pattern, id_col="doc_id", text_col="text"):
    """`id_col` and the packed `ids` of each row's text."""
    ship_package(docs.sparkSession)
    return docs.select(id_col, encode_column(filled(text_col), path, pattern).alias("ids"))


def round_trip(docs, path, pattern, id_col="doc_id", text_col="text"):
    """Digests of each text's ids and of the bytes they decode to, in one pass over the texts.

    Ids are encoded and decoded a text at a time, so a task holds one text's ids and no batch of them.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        own, rows = encoder(path, pattern), []
        for text in texts:
            packed = own.encode(text or "")
            rows.append((
                len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(own.decode(packed)).hexdigest()
            ))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, digests(filled(text_col)).alias("out")).select(id_col, "out.*")
