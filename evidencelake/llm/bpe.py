"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue keeps one bucket of linked-list positions for each merge rank and a three-level bitmap
over the ranks, 64 to a word. Finding the first set bit on each level gives the lowest rank that
has entries; these are taken from left to right, and an entry is stale when its position was
merged away or its pair has changed, and is skipped. Merges of different pre-tokens don't touch,
so one queue serves all the new pre-tokens of a stretch of texts: a bucket is sorted once however
many they are. A pre-token of n bytes takes O(n log n) time, so one of a million bytes takes
seconds, not hours.

Cases: a null text counts as empty (0 tokens, digests of nothing); repeated rows each get a
row; other columns of the input are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from evidencelake.llm.common import occupy, only

#: Characters of chunks that Chunks remembers; beyond it, it starts afresh.
CACHE = 2_000_000
#: Characters of pre-tokens and chunks in a codec's generation; it remembers the running one and the one before.
GENERATION = 6_000_000
#: Characters of texts that are encoded together, unless one text is longer.
STRETCH = 500_000
#: Characters of a pre-token or chunk that is remembered.
SHORT = 64


class Irregular(Exception):
    """White space that a text can't be cut at."""


class Chunks(dict):
    """What encode gives for a space and a chunk, remembered by chunk.

    A space between two characters that aren't white space always starts a pre-token under this
    family of patterns, so a text with only such spaces is the sum of its chunks.
    """

    def __init__(self, encode):
        self.encode = encode
        self.held = 0

    def __missing__(self, chunk: str):
        if irregular(chunk):
            raise Irregular
        ids = self.encode(" " + chunk)
        if len(chunk) <= SHORT:
            self.held += len(chunk)
            if self.held > CACHE:
                self.clear()
                self.held = len(chunk)
            self[chunk] = ids
        return ids


def irregular(chunk: str) -> bool:
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


class Codec:
    """Encodes and decodes by the ranks of a vocabulary file, as lines of base64 token and rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.digits = {rank: str(rank) for rank in self.tokens}
        self.pattern = regex.compile(pattern)
        self.first = np.array([self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)])
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...] | None] = {}
        self.older: tuple[dict, dict] = {}, {}  # pieces and chunks of the generation before
        self.held = 0

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each pre-token: always the lowest rank next, and there the leftmost pair.

        buckets: the positions of each rank; low, mid and top: the bitmap over ranks, 64 to a
        word. The queue is written out in place, as calls would cost more than its work.
        """
        get = self.ranks.get
        data = b"".join(pieces)
        n = len(data)
        if not n:
            return [() for _ in pieces]
        sizes = np.array([len(p) for p in pieces])
        borders = np.cumsum(sizes)
        codes = np.frombuffer(data, np.uint8).astype(np.int64)
        joins = np.append(self.first[codes[:-1] << 8 | codes[1:]], -1)
        joins[borders[sizes > 0] - 1] = -1
        links = np.arange(-1, n - 1)
        links[(borders - sizes)[sizes > 0]] = -1
        stop = np.repeat(borders, sizes).tolist()  # of the pre-token at each position
        ends = list(range(1, n + 1))  # of the part that starts at each position
        before = links.tolist()  # the start of the part on the left
        pair = joins.tolist()  # the rank that joins a part with the next
        order = np.argsort(joins, kind="stable")
        order = order[joins[order] >= 0]
        found, at = np.unique(joins[order], return_index=True)
        buckets: dict[int, list[int]] = {rank: part.tolist() for rank, part in zip(found.tolist(), np.split(order, at[1:]), strict=False)}
        low = [0] * (len(self.first) // 64 + max(self.tokens, default=0) // 64 + 1)
        mid = [0] * (len(low) // 64 + 1)
        top = 0
        for rank in buckets:
            low[rank >> 6] |= 1 << (rank & 63)
            mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            top |= 1 << (rank >> 12)
        while top:
            b = (top & -top).bit_length() - 1
            word = mid[b]
            a = b << 6 | (word & -word).bit_length() - 1
            word = low[a]
            rank = a << 6 | (word & -word).bit_length() - 1
            low[a] = word & (word - 1)
            if not low[a]:
                mid[b] &= mid[b] - 1
                if not mid[b]:
                    top &= top - 1
            bucket = buckets.pop(rank)
            bucket.sort()
            lowest = rank
            for place, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale: merged away, or its pair has changed
                j = ends[i]
                end = ends[i] = ends[j]
                pair[j] = -1
                new = -1
                if end < stop[i]:
                    before[end] = i
                    new = get(data[i : ends[end]], -1)
                pair[i] = new
                if new >= 0:
                    if own := buckets.get(new):
                        own.append(i)
                    else:
                        buckets[new] = [i]
                        w = low[new >> 6]
                        low[new >> 6] = w | 1 << (new & 63)
                        if not w:
                            mid[new >> 12] |= 1 << (new >> 6 & 63)
                            top |= 1 << (new >> 12)
                        if new < lowest:
                            lowest = new
                if (left := before[i]) >= 0:
                    pair[left] = new = get(data[left:end], -1)
                    if new >= 0:
                        if own := buckets.get(new):
                            own.append(left)
                        else:
                            buckets[new] = [left]
                            w = low[new >> 6]
                            low[new >> 6] = w | 1 << (new & 63)
                            if not w:
                                mid[new >> 12] |= 1 << (new >> 6 & 63)
                                top |= 1 << (new >> 12)
                            if new < lowest:
                                lowest = new
                if lowest < rank:  # a lower rank has come up: the rest of this bucket waits
                    if rest := bucket[place + 1 :]:
                        buckets[rank] = rest
                        w = low[a]
                        low[a] = w | 1 << (rank & 63)
                        if not w:
                            mid[b] |= 1 << (a & 63)
                            top |= 1 << b
                    break
        ranks, out, i = self.ranks, [], 0
        for border in borders.tolist():
            ids = []
            while i < border:
                end = ends[i]
                ids.append(ranks[data[i:end]])
                i = end
            out.append(tuple(ids))
        return out

    def _learn_pieces(self, wanted: set[str]) -> None:
        ranks, pieces, new = self.ranks, self.pieces, []
        for p in wanted - self._recalled(wanted, pieces, self.older[0]):
            rank = ranks.get(p.encode())
            if rank is None:
                new.append(p)
            else:
                pieces[p] = (rank,)
        for p, ids in zip(new, self.merge([p.encode() for p in new]), strict=True):
            pieces[p] = ids

    @staticmethod
    def _recalled(wanted: set[str], held: dict, older: dict) -> set[str]:
        """Those wanted that the generation before holds; they are taken over."""
        known = wanted & older.keys()
        for x in known:
            held[x] = older[x]
        return known

    def _learn(self, split: list[list[str]]) -> tuple[set[str], set[str]]:
        """Encodes and remembers the chunks, and so the pre-tokens, that are new in texts split at spaces; gives both."""
        chunks, pieces, find = self.chunks, self.pieces, self.pattern.findall
        spaced = set(chain.from_iterable(own[1:] for own in split))
        spaced.difference_update(chunks)
        fresh = spaced - self._recalled(spaced, chunks, self.older[1])
        regular = [c for c in fresh if not irregular(c)]
        chunks.update(dict.fromkeys(fresh))
        found = find(" " + " ".join(regular)) if regular else []  # each chunk begins where a pre-token begins with a space
        wanted = set(found)
        wanted.update(chain.from_iterable(find(own[0]) for own in split))
        wanted.difference_update(pieces)
        self._learn_pieces(wanted)
        starts = [i for i, p in enumerate(found) if p[0] == " "]
        for c, i, j in zip(regular, starts, [*starts, len(found)][1:], strict=True):
            chunks[c] = pieces[found[i]] if j == i + 1 else tuple(chain.from_iterable(map(pieces.__getitem__, found[i:j])))
        return wanted, spaced

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= STRETCH):
                size += len(texts[end])
                end += 1
            yield from self._encode(texts[at:end])
            at = end

    def _encode(self, texts: list[str]) -> Iterator[list[int]]:
        split = [t.split(" ") for t in texts]
        wanted, spaced = self._learn(split)
        piece, chunk, find = self.pieces.__getitem__, self.chunks.__getitem__, self.pattern.findall
        for text, own in zip(texts, split, strict=True):
            head = own[0]
            parts = list(map(chunk, own[1:]))
            if head[-1:].isspace() or None in parts:  # can't be cut at its spaces
                found = find(text)
                new = set(found).difference(self.pieces)
                self._learn_pieces(new)
                wanted |= new
                yield list(chain.from_iterable(map(piece, found)))
            else:
                yield list(chain(chain.from_iterable(map(piece, find(head))), chain.from_iterable(parts)))
        for held, new in ((self.pieces, wanted), (self.chunks, spaced)):
            for x in new:
                if len(x) > SHORT:
                    del held[x]
            self.held += sum(map(len, new))
        if self.held > GENERATION:
            self.older = self.pieces, self.chunks
            self.pieces, self.chunks, self.held = {}, {}, 0

    def encode(self, text: str) -> list[int]:
        [ids] = self.encode_all([text])
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, the ids.

    The ids are decoded again, and decoded_sha256 is the digest of those bytes.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        gc.disable()  # tuples of numbers make no cycles, and going through all that is remembered costs a sixth of the time
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches):
        occupy("bpe", codec.cache_clear)
        bpe = codec(vocabulary, pattern)
        digits = bpe.digits
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            texts = [t or "" for t in batch["text"].to_pylist()]
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), bpe.encode_all(texts), strict=True):
                row = [doc_id, len(ids), hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()]
                for column, value in zip(rows, row + [ids] * with_ids, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return only(docs, doc_id="long", text="string").mapInArrow(run, kinds)
