"""Byte-level BPE: merges chosen by a segment tree over byte positions."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from seqwatch.llm.shared import map_columns

NONE = 1 << 62
#: Pieces that a worker remembers beside the tokens, and the longest of them. Workers keep them, and the room that a step has
#: taken, while they serve other queries.
REMEMBERED, REMEMBERED_CHARS = 1 << 16, 64
#: Bytes of a piece that is merged together with others, leaves of such trees at a time, and characters of texts at a time.
MOST_TOGETHER, LEAVES, CHARS = 64, 1 << 17, 1 << 20


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece.

    Leaf i of the tree holds the rank of the pair that starts at byte i, with i in the low bits, so that the root
    is the leftmost of the lowest ranks. A merge changes the leaves of the pair, of its right half and of its left
    neighbour, each in a logarithmic number of steps.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    bits = max(1, (n - 1).bit_length())
    size, low = 1 << bits, (1 << bits) - 1
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << bits | i
    for p in range(size - 1, 0, -1):
        left, right = tree[2 * p], tree[2 * p + 1]
        tree[p] = left if left < right else right
    after, before = list(range(1, n + 2)), list(range(-1, n))

    def put(i: int, key: int) -> None:
        p = size + i
        tree[p] = key
        while p > 1:
            key = tree[p] if tree[p] < tree[p ^ 1] else tree[p ^ 1]
            p >>= 1
            if tree[p] == key:
                return
            tree[p] = key

    def pair(i: int) -> int:
        middle = after[i]
        rank = ranks.get(piece[i : after[middle]]) if middle < n else None
        return NONE if rank is None else rank << bits | i

    while tree[1] != NONE:
        i = tree[1] & low
        gone = after[i]
        after[i] = after[gone]
        before[after[i]] = i
        put(gone, NONE)
        put(i, pair(i))
        if i:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


@lru_cache(maxsize=4)
def load_ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


@lru_cache(maxsize=4)
def load_pairs(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the single bytes, and of all pairs of tokens that make one: sorted left << 32 | right, and the rank."""
    ranks, _ = load_ranks(path)
    keys, found = [], []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                found.append(rank)
    keys_at = np.array([*keys, NONE], np.int64)
    order = np.argsort(keys_at)
    return np.array([ranks[bytes([k])] for k in range(256)], np.int64), keys_at[order], np.array([*found, NONE], np.int64)[order]


def merge_together(pieces: list[bytes], path: str) -> list[bytes]:
    """The ids, as little-endian unsigned 32-bit integers, of pieces that are no tokens, of up to MOST_TOGETHER bytes.

    The same trees as in `merge_piece`, those of pieces with equally many leaves side by side: each round makes one merge
    in every piece that has one left.
    """
    out: list[bytes] = [b""] * len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    kinds = np.array([max(1, n - 1).bit_length() for n in range(MOST_TOGETHER + 1)])[lengths]
    for bits in np.unique(kinds).tolist():
        same = np.flatnonzero(kinds == bits)
        for at in range(0, len(same), LEAVES >> bits):
            rows = same[at : at + (LEAVES >> bits)]
            for k, ids in zip(rows.tolist(), _merged([pieces[k] for k in rows], lengths[rows], bits, path), strict=True):
                out[k] = ids
    return out


def _merged(pieces: list[bytes], n: np.ndarray, bits: int, path: str) -> list[bytes]:
    byte_ids, keys, ranks = load_pairs(path)
    size, low, count = 1 << bits, (1 << bits) - 1, len(pieces)

    def pair(left: np.ndarray, right: np.ndarray, i: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(keys, key)
        return np.where(keys[at] == key, ranks[at] << bits | i, NONE)

    raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(count, size)
    ids = byte_ids[raw]
    tree = np.full((count, 2 * size), NONE)
    row, i = np.nonzero(np.arange(1, size) < n[:, None])
    tree[row, size + i] = pair(ids[row, i], ids[row, i + 1], i)
    level = size
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    after, before = np.tile(np.arange(1, size + 2), (count, 1)), np.tile(np.arange(-1, size), (count, 1))
    flat, live = tree.ravel(), np.arange(count)
    while True:
        top = tree[live, 1]
        left = top != NONE
        live, top = live[left], top[left]
        if not len(live):
            break
        i, rank = top & low, top >> bits
        gone = after[live, i]
        further = after[live, gone]
        ids[live, i], ids[live, gone] = rank, -1
        after[live, i], before[live, further] = further, i
        right, back = np.flatnonzero(further < n[live]), before[live, i]
        to_left = np.flatnonzero(back >= 0)
        own = np.full(len(live), NONE)
        own[right] = pair(rank[right], ids[live[right], further[right]], i[right])
        kept = back[to_left]
        put = np.concatenate([live * 2 * size, live * 2 * size, live[to_left] * 2 * size])
        p = np.concatenate([gone, i, kept]) + size
        flat[put + p] = np.concatenate([np.full(len(live), NONE), own, pair(ids[live[to_left], kept], rank[to_left], kept)])
        for _ in range(bits):
            p >>= 1
            flat[put + p] = np.minimum(flat[put + 2 * p], flat[put + 2 * p + 1])
    stays = (ids >= 0) & (np.arange(size) < n[:, None])
    packed = ids[stays].astype("<u4").tobytes()
    ends = (4 * np.cumsum(stays.sum(1))).tolist()
    return [packed[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encodes and decodes texts with one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.path = path
        self.ranks, self.tokens = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def _new(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces; short ones that are no tokens are remembered."""
        found, waiting, tokens = {}, [], {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                tokens[piece] = whole.to_bytes(4, "little")
            elif len(raw) <= MOST_TOGETHER:
                waiting.append((piece, raw))
            else:
                found[piece] = np.array(merge_piece(raw, self.ranks), "<u4").tobytes()
        found.update(zip([piece for piece, _ in waiting], merge_together([raw for _, raw in waiting], self.path), strict=True))
        short = {piece: ids for piece, ids in found.items() if len(piece) <= REMEMBERED_CHARS}
        if len(self.known) + len(short) > REMEMBERED:
            self.known.clear()
        if len(short) <= REMEMBERED:
            self.known.update(short)
        return found | tokens

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; few characters are in pieces at a time."""
        out, held, chars = [], [], 0
        for text in texts:
            if held and chars + len(text or "") > CHARS:
                out += self._encode(held)
                held, chars = [], 0
            held.append(text or "")
            chars += len(text or "")
        return out + self._encode(held)

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        distinct = set().union(*split)
        ids = {p: self.known[p] for p in distinct if p in self.known}
        ids |= self._new(distinct - ids.keys())
        return [b"".join(map(ids.__getitem__, pieces)) for pieces in split]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, `ids` (little-endian unsigned 32-bit integers) and `decoded` (the bytes of those ids) of every text.

    Each match of `pattern` is merged separately, without special tokens. A map over rows: nothing is shuffled. New
    short pieces of about a million characters of texts are merged together. A worker keeps the ids of short pieces
    that it has met and that are no tokens, up to a fixed number; very long pieces cost n log n. Null and empty texts
    have no ids and decode to no bytes; a null doc_id stays null. Of pairs of equal rank the leftmost merges first. Rows, repeated ones included, keep their ids; an empty table gives no rows. Other columns are
    ignored, those named ids or decoded too.
    """

    def encode(rows):
        c = codec(path, pattern)
        ids = c.encode_all(rows["text"])
        return {"doc_id": rows["doc_id"], "ids": ids, "decoded": [c.decode(x) for x in ids]}

    return map_columns(docs, encode, "doc_id long, ids binary, decoded binary", ["doc_id", "text"])
