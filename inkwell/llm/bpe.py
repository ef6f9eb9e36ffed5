"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A piece is a row of byte tokens.  Each leaf of its tree belongs to a byte
position and holds the rank of the pair that starts there, the inner nodes the
leftmost least one.  A merge takes the root's pair and updates three leaves: the
merged position, its dead right half and the live neighbour on the left.

Pieces of like size are merged together as numpy rows (one merge of every piece
a step); longer pieces run the same tree one by one.  Texts are cut into chunks
that no match of the pattern crosses and the ids of a chunk are remembered, so a
repeated word costs one lookup.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .chunks import ChunkTable, packed_learner
from .common import small_batches, text_bytes
from .words import batched, stretches

NONE = np.int64(1) << 62
#: Pieces whose ids a worker remembers; at this many it starts afresh.
REMEMBERED = 150_000
#: Longer pieces are not remembered.
LONGEST_REMEMBERED = 64

_INNER_SPACE = re.compile(r".\s", re.DOTALL)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBPE:
    """Ids of pieces and bytes of ids for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            bytes_of[rank] = token
        self.token_bytes = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)
        self.token_sizes = np.array([len(b) for b in bytes_of], dtype=np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int64)
        self._pairs: dict[int, int] = {}
        self.pieces: dict[str, bytes] = {}
        self.table = ChunkTable(packed_learner(self._learn))

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def _merge_rows(self, rows: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces of 2 to ``width`` bytes (a power of two), all together."""
        count = len(rows)
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(count, width)
        size = np.array([len(r) for r in rows], dtype=np.int64)
        places = np.arange(width, dtype=np.int64)
        token = np.where(places < size[:, None], self.byte_ids[raw], -1)
        after = np.tile(places + 1, (count, 1))
        before = np.tile(places - 1, (count, 1))
        tree = np.full((count, 2 * width), NONE, dtype=np.int64)
        valid = places[:-1] + 1 < size[:, None]
        rank = np.full((count, width - 1), NONE, dtype=np.int64)
        rank[valid] = self._pair(token[:, :-1][valid], token[:, 1:][valid])
        tree[:, width : 2 * width - 1] = np.where(rank < NONE, rank * width + places[:-1], NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half

        def put(r: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
            node = leaf + width
            tree[r, node] = key
            while node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        live = np.nonzero(tree[:, 1] < NONE)[0]
        while len(live):
            root = tree[live, 1]
            at, made = root % width, root // width
            token[live, at] = made
            gone = after[live, at]
            nxt = after[live, gone]
            after[live, at] = nxt
            token[live, gone] = -1
            inside = nxt < size[live]
            r, p, q = live[inside], at[inside], nxt[inside]
            before[r, q] = p
            put(live, gone, np.full(len(live), NONE))
            key = np.full(len(live), NONE)
            if len(r):
                found = self._pair(token[r, p], token[r, q])
                key[inside] = np.where(found < NONE, found * width + p, NONE)
            put(live, at, key)
            prev = before[live, at]
            has = prev >= 0
            r, p = live[has], prev[has]
            if len(r):
                found = self._pair(token[r, p], token[r, at[has]])
                put(r, p, np.where(found < NONE, found * width + p, NONE))
            live = live[tree[live, 1] < NONE]
        kept = token >= 0
        packed = token[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same tree for one piece of any length, n log n."""
        if not self._pairs:  # only long pieces need it
            self._pairs = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))
        n, size, pairs = len(piece), self.size, self._pairs
        width = 1 << (n - 1).bit_length()
        token = [int(self.byte_ids[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = int(NONE)
        tree = [none] * (2 * width)

        def key(i: int, j: int) -> int:
            rank = pairs.get(token[i] * size + token[j]) if j < n else None
            return none if rank is None else rank * width + i

        for i in range(n - 1):
            tree[width + i] = key(i, i + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < none:
            made, at = divmod(tree[1], width)
            gone = after[at]
            nxt = after[gone]
            token[at], token[gone], after[at] = made, -1, nxt
            if nxt < n:
                before[nxt] = at
            put(gone, none)
            put(at, key(at, nxt))
            if before[at] >= 0:
                put(before[at], key(before[at], at))
        return [t for t in token if t >= 0]

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out, groups = {}, {}
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            if whole is not None:
                out[piece] = np.uint32(whole).tobytes()
            elif len(raw) > 64:
                out[piece] = np.array(self._merge_long(raw), dtype="<u4").tobytes()
            else:
                groups.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, some in groups.items():
            for at in range(0, len(some), 8_000):
                part = some[at : at + 8_000]
                out.update(zip([p for p, _ in part], self._merge_rows([r for _, r in part], width)))
        return out

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """Packed ids of chunks (see ``chunks``)."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        split: list[list[str]] = [[] for _ in texts]
        plain = [i for i, t in enumerate(texts) if t[0] == " " and not _INNER_SPACE.search(t)]
        # no inner space: a piece that starts with one starts the next chunk
        turn = iter(plain)
        for piece in self.pattern.findall("".join([texts[i] for i in plain])):
            if piece[0] == " ":
                now = split[next(turn)]
            now.append(piece)
        for i, t in enumerate(texts):
            if not split[i]:
                split[i] = self.pattern.findall(t)
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        known = self.pieces
        made = self.encode_pieces({p for ps in split for p in ps if p not in known})
        known.update((p, i) for p, i in made.items() if len(p) <= LONGEST_REMEMBERED)
        get = known.get
        return [b"".join([get(p) or made[p] for p in ps]) for ps in split]

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts (UTF-8) as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for _, some in batched(texts):
            out += self.table.encode(some)
        return out

    def decode_batch(self, packed: list[bytes]) -> list[bytes]:
        """The bytes of each text's ids."""
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        sizes = self.token_sizes[ids]
        joined = self.token_bytes[stretches(self.token_starts[ids], sizes)].tobytes()
        ends = np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)
        cuts = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends))].tolist()
        return [joined[a:b] for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: bytes) -> bytes:
        return self.decode_batch([ids])[0]


def load(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    import public_tokenizers

    return ByteBPE(read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), pattern or public_tokenizers.PATTERN)


_loaded: dict[tuple, ByteBPE] = {}


def _once(path: str | None, pattern: str | None) -> ByteBPE:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = load(path, pattern)
    return _loaded[path, pattern]


def _texts(column: pd.Series) -> list[bytes]:
    return [x or b"" for x in column]


DIGESTS = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def digest_udf(path: str | None = None, pattern: str | None = None) -> Callable:
    """A column function: binary text to token count, digest of the ids and digest
    of what the ids decode to."""

    @F.pandas_udf(DIGESTS)
    def digests(texts: pd.Series) -> pd.DataFrame:
        bpe = _once(path, pattern)
        rows = []
        for at in range(0, len(texts), 1024):
            for _, part in batched(_texts(texts.iloc[at : at + 1024])):
                coded = bpe.encode_batch(part)
                rows += [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(t).hexdigest()) for i, t in zip(coded, bpe.decode_batch(coded))]
        return pd.DataFrame(rows, columns=DIGESTS.names)

    return digests


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) with the ids of each whole text as packed unsigned 32-bit
    integers; ``decode`` turns them back.

    Null and empty texts have no ids (an empty value).  Repeated rows give repeated
    rows, doc_id may be null, an empty table gives no rows and other columns are
    not read.
    """

    @F.pandas_udf(BinaryType())
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(_once(path, None).encode_batch(_texts(texts)))

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), ids(text_bytes(F.col(text_col))).alias("ids"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of what ``encode`` returned; null ids give a null text, and
    bytes that are no UTF-8 become U+FFFD."""

    @F.pandas_udf(StringType())
    def text(packed: pd.Series) -> pd.Series:
        bpe = _once(path, None)
        return pd.Series([None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in packed])

    return encoded.select("doc_id", text("ids").alias("text"))


def encoding_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each row of ``docs``.

    Null and empty texts have no tokens and the digest of nothing.  Repeated rows
    give repeated rows, ids may be null, an empty table gives no rows and other
    columns are not read.  A piece of any length is merged whole.
    """
    small_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), digest_udf(path)(text_bytes(F.col(text_col))).alias("d"))
    return found.select("doc_id", "d.*")
