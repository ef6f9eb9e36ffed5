"""Token-id shards compressed by Re-Pair grammars.

Documents are dealt to shards by ranges of their id, sorted, encoded with the
tokenizers library and cut into blocks of whole documents.  In each block Re-Pair
replaces the most frequent id pairs by nonterminals until no pair is left that
would repay its rule; the block keeps its rules, the expansion length of each one
and where every document's symbols start, so one document, or a stretch of one,
is decoded without the others.

A block is one row of a Parquet file in the shared folder; see ``BLOCK``.
Spark's own writer makes the files, so a lost task leaves none behind.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkTable
from .common import partitions, small_batches, stored, text_bytes
from .words import batched, stretches

END_ID = 0
#: Ids of a block, about; a longer document is a block of its own.
BLOCK_TOKENS = 250_000
#: Bytes of input, as the scan estimates them, for a shard.
SHARD_BYTES = 256 << 20
#: More shards are not made, so that their starts can be sent to every executor.
MOST_SHARDS = 500_000
#: A pair repays its rule from this many occurrences on: a rule takes the room of three
#: to four symbols (two sides and a length), and what Parquet's own compression saves on
#: rare pairs anyway doubles that.
LEAST_COUNT = 8
#: Pairs at least 1 / STEP as frequent as the most frequent one are replaced together.
STEP = 4
#: New chunks that go to the library as one text.
JOINED = 500
MAGIC = b"RPG2"
HEAD = "<4sBIIIQI"
DEAD = 0xFFFFFFFF

#: shard and block order the blocks; before counts the ids of the shard's earlier
#: blocks; n_tokens is what the block expands to;
#: payload is MAGIC, counts, rules by step, expansion lengths, symbols and document ends.
BLOCK = "shard int, block int, before long, n_tokens long, doc_ids array<string>, payload binary"


class Encoder:
    """The tokenizers library over chunks that no token crosses, remembered.

    New chunks go to the library many at a time as one text.  Those that hold one
    space, their first character, follow each other directly: no token but the
    first one of a chunk begins with a space.  Those without white space are parted
    by line ends, each of which is a token of its own there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.base = self.library.get_vocab_size(with_added_tokens=True)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.opens = np.zeros(self.base, dtype=bool)  # ids of tokens that begin with a space
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.line_end = vocabulary.get("Ċ", -1)
        self.table = ChunkTable(self._learn)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, ids: np.ndarray) -> np.ndarray:
        """Ids from each one that begins with a space to the next."""
        opens = np.nonzero(self.opens[ids])[0]
        return np.diff(opens, append=len(ids)) if len(opens) and opens[0] == 0 else opens[:0]

    def _lines(self, ids: np.ndarray) -> np.ndarray:
        """Ids before each line end."""
        return np.diff(np.nonzero(ids == self.line_end)[0], prepend=-1) - 1

    def _grouped(self, text: np.ndarray, ends: np.ndarray, parts: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(ids, ids of each chunk) of ``JOINED`` chunks at a time that end before
        ``ends``; ``parts`` finds where they part, and where it finds another
        number of them the second is missing."""
        cuts = [0, *ends[JOINED - 1 : -1 : JOINED].tolist(), len(text)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            ids = self._library([text[a:b].tobytes().decode("utf-8", "replace")])[0]
            sizes = parts(ids)
            yield ids, sizes if len(sizes) == min(JOINED, len(ends) - k * JOINED) else None

    def _learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for chunks (see ``chunks``)."""
        text = data[stretches(starts, sizes)]
        ends = np.cumsum(sizes)
        spaces, others = np.concatenate(([0], np.cumsum(text == 32))), np.concatenate(([0], np.cumsum((text < 33) | (text > 126))))
        first = ends - sizes
        single = (text[first] == 32) & (sizes > 1) & (spaces[ends] - spaces[first] == 1)
        black = others[ends] == others[first]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def keep(some: np.ndarray, groups: Iterator) -> None:
            for at, (ids, counts) in zip(range(0, len(some), JOINED), groups):
                if counts is not None:
                    found.append((some[at : at + JOINED], ids, counts))

        some = np.nonzero(single)[0]
        if len(some):
            keep(some, self._grouped(text[stretches(first[some], sizes[some])], np.cumsum(sizes[some]), self._spaced))
        some = np.nonzero(black)[0]
        if len(some):
            at = np.cumsum(sizes[some] + 1)
            lines = np.full(int(at[-1]), 10, dtype=np.uint8)
            lines[stretches(at - 1 - sizes[some], sizes[some])] = text[stretches(first[some], sizes[some])]
            # the line end after each chunk is a token that is left out again
            keep(some, ((ids[ids != self.line_end], counts) for ids, counts in self._grouped(lines, at, self._lines)))
        known = np.zeros(len(starts), dtype=bool)
        for chunks, _, _ in found:
            known[chunks] = True
        odd = np.nonzero(~known)[0]
        for i, ids in zip(odd.tolist(), self._library([text[first[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in odd.tolist()])):
            found.append((np.array([i]), ids, np.array([len(ids)])))
        order, flat, counts = (np.concatenate([f[k] for f in found]) for k in range(3))
        back = np.argsort(order)
        return flat[stretches((np.cumsum(counts) - counts)[back], counts[back])], counts[back]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts (UTF-8) as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for _, some in batched(texts):
            whole = {i for i, t in enumerate(some) if any(s in t for s in self.special)}
            coded = self.table.encode([b"" if i in whole else t for i, t in enumerate(some)])
            for i in whole:
                coded[i] = self._library([some[i].decode("utf-8", "replace")])[0].tobytes()
            out += coded
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for each worker, whatever number of tasks it runs."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Grammar:
    """Re-Pair over one block: the symbols as a linked list, and the places of every
    pair that occurs often enough, in groups that were found together.

    A group is [pairs, first entries, counts, places]; counts are those of the time
    when the group was made and places are checked when their pair's turn comes.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray, base: int, least: int):
        n = len(ids)
        self.n, self.base, self.made, self.least = n, base, base, least
        kind = np.int32 if n < 1 << 30 else np.int64
        self.place_bits = max(1, n.bit_length())
        self.bits = min(int(base + n).bit_length(), (64 - self.place_bits) // 2)
        self.symbols = np.full(n + 1, DEAD, dtype=np.uint32)
        self.symbols[:n] = ids
        self.after = np.arange(1, n + 2, dtype=kind)
        self.before = np.arange(-1, n, dtype=kind)
        inner = ends[(ends > 0) & (ends <= n)]
        self.after[inner - 1] = n  # no pair crosses the end of a document
        self.before[inner] = -1
        self.rules: list[np.ndarray] = []
        self.groups: list[list[np.ndarray]] = []
        self._collect(np.nonzero(self.after[:n] < n)[0])

    def _keys(self, at: np.ndarray) -> np.ndarray:
        """The pairs that start at the places ``at``."""
        return (self.symbols[at].astype(np.uint64) << np.uint64(self.bits)) | self.symbols[self.after[at]]

    def _collect(self, at: np.ndarray) -> None:
        """A group of the pairs that start at the places ``at``."""
        if len(at) < self.least:
            return
        keys = self._keys(at)
        if len(at) > 4096:  # most pairs are rare: leave them out before the sort
            width = min(22, len(at).bit_length())
            slots = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - width)).astype(np.int64)
            often = (np.bincount(slots, minlength=1 << width) >= self.least)[slots]
            at, keys = at[often], keys[often]
        both = np.sort((keys << np.uint64(self.place_bits)) | at.astype(np.uint64))
        keys = both >> np.uint64(self.place_bits)
        self._grouped(keys, (both & np.uint64((1 << self.place_bits) - 1)).astype(np.int64))

    def _grouped(self, keys: np.ndarray, at: np.ndarray) -> None:
        if not len(at):
            return
        first = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0]
        counts = np.diff(np.append(first, len(keys)))
        own = counts >= self.least
        if own.any():
            self.groups.append([keys[first[own]], first[own], counts[own], at])

    def step(self) -> bool:
        """Replace the pairs that are most frequent now; false when none is left."""
        best = max((int(g[2].max()) for g in self.groups), default=0)
        if best < self.least or self.made >= (1 << self.bits) - 1:
            return False
        floor = max(self.least, -(-best // STEP))
        keys, sizes, places = [], [], []
        for pairs, first, counts, at in self.groups:
            turn = np.nonzero(counts >= floor)[0]
            if len(turn):
                keys.append(pairs[turn])
                sizes.append(counts[turn])
                places.append(at[stretches(first[turn], sizes[-1])])
                counts[turn] = 0
        self.groups = [g for g in self.groups if g[2].any()]
        keys, sizes, at = np.concatenate(keys), np.concatenate(sizes), np.concatenate(places)
        owner = np.repeat(np.arange(len(keys), dtype=np.uint32), sizes)
        live = self._keys(at) == np.repeat(keys, sizes)
        at, owner = at[live], owner[live]
        few = np.bincount(owner, minlength=len(keys)) < floor
        if few.any():
            later = few[owner]
            self._grouped(keys[owner[later]], at[later])
            at, owner = at[~later], owner[~later]
        if not len(at):
            return True
        both = np.sort((at.astype(np.uint64) << np.uint64(32)) | owner)
        at, owner = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # where places follow each other every second one is taken, left to right
        order = np.arange(len(at))
        gone = self.after[at]
        chained = np.concatenate(([False], gone[:-1] == at[1:]))
        taken = (order - np.maximum.accumulate(np.where(chained, 0, order))) % 2 == 0
        kept = np.bincount(owner[taken], minlength=len(keys)) >= self.least
        if self.made + int(kept.sum()) >= 1 << self.bits:
            return False
        own = kept[owner]
        taken &= own
        if not taken.any():
            return True
        if not kept.all():
            # places passed over for a pair that is too rare now: no two of them meet
            beside = np.concatenate(([False], taken[:-1] & chained[1:])) | np.concatenate((taken[1:] & chained[1:], [False]))
            taken |= own & ~beside
            rest = np.argsort(owner[~own], kind="stable")
            self._grouped(keys[owner[~own][rest]], at[~own][rest])
        at, gone = at[taken], gone[taken]
        beyond = self.after[gone]
        left, right = (keys[kept] >> np.uint64(self.bits)).astype(np.uint32), (keys[kept] & np.uint64((1 << self.bits) - 1)).astype(np.uint32)
        self.symbols[at] = (self.made + np.cumsum(kept) - 1)[owner[taken]]
        self.symbols[gone] = DEAD
        self.after[at] = beyond
        self.before[beyond] = at
        self.rules.append(np.stack([left, right], axis=1))
        self.made += int(kept.sum())
        earlier = self.before[at]
        starts = np.sort(np.concatenate((earlier[earlier >= 0], at)))
        starts = starts[np.concatenate(([True], starts[1:] != starts[:-1]))]
        self._collect(starts[self.after[starts] < self.n])
        return True


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(symbols, ends, rules by step): Re-Pair over ``ids``, whose documents end
    before ``ends``, until no pair occurs ``least`` times without overlap.

    Rules are numbered from ``base`` on; a rule's two symbols are ids or rules of
    earlier steps, and no pair crosses the end of a document.
    """
    grammar = _Grammar(ids, ends, base, max(2, least))
    while grammar.step():
        pass
    alive = grammar.symbols[: len(ids)] != DEAD
    return grammar.symbols[: len(ids)][alive].astype(np.uint32), np.concatenate(([0], np.cumsum(alive)))[ends], grammar.rules


def _narrow(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers of ``width`` bytes, little-endian."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def _widened(payload: bytes, width: int, count: int, at: int) -> np.ndarray:
    out = np.zeros((count, 4), dtype=np.uint8)
    out[:, :width] = np.frombuffer(payload, dtype=np.uint8, count=count * width, offset=at).reshape(-1, width)
    return out.view("<u4").ravel()


def expansion_lengths(rules: list[np.ndarray], base: int) -> np.ndarray:
    lengths = np.ones(base, dtype=np.int64)
    for pairs in rules:
        lengths = np.concatenate((lengths, lengths[pairs[:, 0]] + lengths[pairs[:, 1]]))
    return lengths


def pack(symbols: np.ndarray, ends: np.ndarray, rules: list[np.ndarray], base: int) -> bytes:
    made = base + sum(map(len, rules))
    top = max(made - 1, int(symbols.max()) if len(symbols) else 0)
    width = 2 if top < 1 << 16 else 3 if top < 1 << 24 else 4
    flat = np.concatenate(rules).ravel() if rules else np.zeros(0, dtype=np.uint32)
    head = struct.pack(HEAD, MAGIC, width, base, len(rules), made - base, len(symbols), len(ends))
    steps = np.array([len(r) for r in rules], dtype="<u4").tobytes()
    return head + steps + _narrow(flat, width) + expansion_lengths(rules, base)[base:].astype("<u4").tobytes() + _narrow(symbols, width) + ends.astype("<u8").tobytes()


class Block:
    """Random access to the documents of one payload."""

    def __init__(self, payload: bytes):
        magic, width, self.base, steps, rules, symbols, docs = struct.unpack_from(HEAD, payload)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = struct.calcsize(HEAD)
        self.steps = np.frombuffer(payload, dtype="<u4", count=steps, offset=at).astype(np.int64)
        at += 4 * steps
        self.rules = _widened(payload, width, 2 * rules, at).reshape(-1, 2)
        at += 2 * rules * width
        self.lengths = np.concatenate((np.ones(self.base, dtype=np.int64), np.frombuffer(payload, dtype="<u4", count=rules, offset=at).astype(np.int64)))
        at += 4 * rules
        self.symbols = _widened(payload, width, symbols, at).astype(np.int64)
        at += symbols * width
        self.ends = np.frombuffer(payload, dtype="<u8", count=docs, offset=at).astype(np.int64)

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of some symbols, by replacing rules until none is left."""
        while len(symbols) and symbols.max() >= self.base:
            rule = symbols >= self.base
            size = 1 + rule
            first = np.cumsum(size) - size
            out = np.repeat(symbols, size)
            pairs = self.rules[symbols[rule] - self.base]
            out[first[rule]], out[first[rule] + 1] = pairs[:, 0], pairs[:, 1]
            symbols = out
        return symbols.astype("<u4")

    def _symbols_of(self, i: int) -> np.ndarray:
        return self.symbols[(self.ends[i - 1] if i else 0) : self.ends[i]]

    def document(self, i: int) -> np.ndarray:
        """The ids of document ``i`` of the block, others not expanded."""
        return self._expanded(self._symbols_of(i))

    def stretch(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (exclusive) of document ``i``; the expansion
        lengths tell which symbols hold them, and only those are expanded."""
        some = self._symbols_of(i)
        ends = np.cumsum(self.lengths[some])
        start, stop = max(0, start), min(stop, int(ends[-1]) if len(ends) else 0)
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        skipped = start - (int(ends[a - 1]) if a else 0)
        return self._expanded(some[a:b])[skipped : skipped + stop - start]

    def documents(self) -> list[bytes]:
        """The packed ids of every document; each rule is expanded once."""
        starts = np.concatenate((np.arange(self.base, dtype=np.int64), self.base + np.cumsum(self.lengths[self.base :]) - self.lengths[self.base :]))
        flat = np.empty(self.base + int(self.lengths[self.base :].sum()), dtype="<u4")
        flat[: self.base] = np.arange(self.base)
        at = 0
        for size in self.steps.tolist():
            pairs = self.rules[at : at + size].ravel()
            to = int(starts[self.base + at])
            own = flat[stretches(starts[pairs], self.lengths[pairs])]
            flat[to : to + len(own)] = own
            at += size
        lengths = self.lengths[self.symbols]
        packed = flat[stretches(starts[self.symbols], lengths)].tobytes()
        ends = np.concatenate(([0], np.cumsum(lengths)))[self.ends]
        cuts = (4 * np.concatenate(([0], ends))).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]


def _blocks(path: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        shard, number, before, held, ids, size = 0, 0, 0, [], [], 0

        def flush() -> pd.DataFrame:
            flat = np.frombuffer(b"".join(held), dtype="<u4")
            symbols, cut_at, rules = compress(flat, np.cumsum([len(h) // 4 for h in held]), encoder.base)
            return pd.DataFrame({"shard": [shard], "block": [number], "before": [before], "n_tokens": [len(flat)], "doc_ids": [ids], "payload": [pack(symbols, cut_at, rules, encoder.base)]})

        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                coded = encoder.encode([x or b"" for x in part["text"]])
                for s, i, own in zip(part["shard"].tolist(), part["doc_id"], coded):
                    if held and (s != shard or size + len(own) // 4 + 1 > block_tokens):
                        yield flush()
                        number, before = (number + 1, before + size) if s == shard else (0, 0)
                        held, ids, size = [], [], 0
                    shard = s
                    held.append(own + end)
                    ids.append(i)
                    size += len(own) // 4 + 1
        if held:
            yield flush()

    return run


def _shards_for(docs: DataFrame, spark: SparkSession) -> int:
    """Shards by the size that the scan expects; it changes files, not rows."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(spark), min(size // SHARD_BYTES, MOST_SHARDS) if size < 1 << 62 else 0)


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, shards: int | None = None) -> DataFrame:
    """The written blocks (columns of ``BLOCK``), read back from the shared folder.

    Shards are ranges of ids, so an id is in one shard only and shards follow each
    other in ascending id; rows without an id come first.  Ids are integers of at
    most 64 bits (``ValueError`` for a column of another type).
    """
    import public_tokenizers

    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids of type {kind} have no ascending order as numbers; number the documents first")
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("text"))
    shards = shards or _shards_for(rows, docs.sparkSession)
    dealt = rows.repartitionByRange(shards, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    # as text, since pandas would turn ids beside a null into floats
    dealt = dealt.select(F.spark_partition_id().alias("shard"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    blocks = dealt.mapInPandas(_blocks(path, end_id, block_tokens), BLOCK)
    return stored(blocks, "token-blocks")


def read_shards(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, ids) decoded from blocks; start counts the ids of all
    documents before, ids are packed unsigned 32-bit integers."""
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row a shard, of which there are at most MOST_SHARDS
    shards = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_ids, payload, start in zip(batch["doc_ids"], batch["payload"], batch["start"]):
                ids = Block(payload).documents()
                starts = start + np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
                for at in range(0, len(ids), 2000):
                    part = slice(at, at + 2000)
                    yield pd.DataFrame({"doc_id": pd.array([None if d is None else int(d) for d in doc_ids[part]], dtype="Int64"), "start": starts[:-1][part], "ids": ids[part]})

    placed = blocks.join(F.broadcast(shards), "shard").select("doc_ids", "payload", (F.col("before") + F.col("shard_start")).alias("start"))
    return placed.mapInPandas(run, "doc_id long, start long, ids binary")


def shard_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what was written and read back.

    Null and empty texts are one end id.  Repeated ids keep one row each, in no
    set order among themselves; rows without an id come before all others; an
    empty table writes no block and gives no rows; other columns are not read.
    A document of any length is a block of its own beside shorter ones.
    """
    ids = F.col("ids")
    return read_shards(write_shards(docs, id_col, text_col, **options)).select("doc_id", "start", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))
