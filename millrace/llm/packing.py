"""Packing token sequences by swap-based local search.

Documents become pieces of at most `capacity` tokens. Pieces are dealt by a hash into shards of
about SHARD_PIECES, so no source or group of copies makes a shard larger. Within a shard, pieces are put
into bins as they come, unsorted, and local search packs them: a piece moves to a fuller bin, or changes places with
one shorter piece or with two, or two pieces change places with one longer, whenever that raises the sum of
squared fills, until bins run empty or nothing improves. Pieces of bins that are still far from full
are dealt anew into fewer shards, so shards leave no row of half-empty bins behind; dealing stops when more than
half of the pieces are left, since pieces of a kind that fills no bin won't in another deal either.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, slices
from millrace.llm.token_counts import byte_alphabet

#: Pieces a shard holds on average; one task packs one shard in memory.
SHARD_PIECES = 16_384
#: Bins filled less than this share of the capacity are dealt anew.
REOPEN = 0.95
#: Bins of a room that are tried for an exchange of one piece for two, and shortest pieces of a full bin that form pairs.
TRIED_BINS = 4
PAIRED_PIECES = 5
#: Words and other chunks whose ids a task remembers before it keeps only short ones, and bytes of text handled at once.
REMEMBERED = 1_000_000
BATCH_BYTES = 16 << 20
SHORT = 8
#: Words that go to the library's model in one call.
LINE_WORDS = 200
#: Marks that form one pre-token of their own behind letters.
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
LATIN_WORD = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$"
#: A word with such marks. Letters that lower case or NFC takes apart, some from U+0130, U+0900 and U+FB1D on, may leave a mark
#: at its end, which forms one pre-token with those behind it.
WORD_AND_MARKS = rf"^(?P<word>[^\PL\x{{130}}\x{{900}}-\x{{fff}}\x{{fb1d}}-\x{{fb4f}}]+)(?P<marks>[{re.escape(MARKS)}]+)$"


PIECES = "doc_id {id}, piece int, start long, length long, ids array<int>, ids_crc32 long"


# Tokens

#: Character that byte-level vocabularies show for each byte; a blank stays one.
_SHOWN = "".join(" " if b == 32 else c for b, c in enumerate(byte_alphabet()))


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _model_alone(path: str):
    """The library's model for words between blanks, which are neither normalised nor split."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    out = Tokenizer.from_file(path)
    out.normalizer = normalizers.Sequence([])
    out.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
    return out


class Ids:
    """Ids of whole texts by the library, remembered by words and by other chunks between blanks.

    White space separates pre-tokens in vocabularies that drop it, so chunks are independent; letters and the
    marks behind them are two pre-tokens, each with ids of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        self.library, self.model = _library(path), _model_alone(path)
        self.names, self.ids = pa.array([""]), pa.array([b""], pa.large_binary())

    def _encode_words(self, words: pa.Array) -> pa.Array:
        """A word of Latin-1 letters is one pre-token: it goes to the library's model as it is, many in a line."""
        names = words.to_pylist()
        ids, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for start in range(0, len(names), LINE_WORDS):
            raw = " ".join(names[start : start + LINE_WORDS]).lower().encode()
            line = self.model.encode(codecs.charmap_decode(raw, "strict", _SHOWN)[0], add_special_tokens=False)
            ids.append(np.array(line.ids, "<u4"))
            sizes.append(np.bincount(line.word_ids))
        ends = 4 * np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        if len(ends) != len(names) + 1:
            raise ValueError("this operator takes vocabularies that give every word a token")
        return pa.Array.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(ids))])

    def _encode(self, chunk: str) -> bytes:
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: pa.Array) -> None:
        """Chunks that aren't words of Latin-1 letters go through the library's whole chain."""
        plain = pc.match_substring_regex(chunks, LATIN_WORD)
        others = pa.array(map(self._encode, chunks.filter(pc.invert(plain)).to_pylist()), pa.large_binary())
        ids = pa.concat_arrays([self._encode_words(chunks.filter(plain)), others])
        place = np.argsort(np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable"))
        self.names = pa.concat_arrays([self.names, chunks])
        self.ids = pa.concat_arrays([self.ids, ids.take(pa.array(place))])

    def _forget(self) -> None:
        """Keep short chunks, which come back most often; all go if these alone are too many."""
        short = pc.less_equal(pc.utf8_length(self.names), SHORT)
        if pc.sum(short).as_py() >= REMEMBERED // 2:
            short = pc.equal(self.names, "")
        self.names, self.ids = self.names.filter(short), self.ids.filter(short)

    def _of_chunks(self, chunks: pa.Array) -> pa.Array:
        """Ids of each distinct chunk, as bytes."""
        word, marks = pc.extract_regex(chunks, WORD_AND_MARKS).flatten()  # nulls where a chunk is anything else
        parts = pa.concat_arrays([pc.coalesce(word, chunks), pc.fill_null(marks, "")]).dictionary_encode()
        at = pc.index_in(parts.dictionary, value_set=self.names)
        if at.null_count:
            new, first = at.is_null(), len(self.names)
            self._learn(parts.dictionary.filter(new))
            at = pc.replace_with_mask(at, new, pa.array(np.arange(first, len(self.names)), at.type))
        ids = self.ids.take(at.take(parts.indices))
        return pc.binary_join_element_wise(ids[: len(chunks)], ids[len(chunks) :], pa.scalar(b"", pa.large_binary()))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each one has."""
        if len(self.names) > REMEMBERED:
            self._forget()
        split = pc.split_pattern(_folded(texts.cast(pa.string())), " ")
        chunks = split.flatten().dictionary_encode()
        ids = self._of_chunks(chunks.dictionary).take(chunks.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy() // 4)])
        n = int(ends[-1])
        flat = np.frombuffer(ids.buffers()[2], "<u4", n) if n else np.empty(0, "<u4")
        return flat, np.diff(ends[split.offsets.to_numpy()])


@lru_cache(maxsize=1)
def _ids(path: str) -> Ids:
    """One memory per Python worker: what a task has learned serves the worker's next one."""
    return Ids(path)


def _folded(texts: pa.Array) -> pa.Array:
    """Line ends as blanks; lower case where that can't change an id: Latin-1 without special strings."""
    kept = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, r"[^\x00-\x{ff}]"))
    return pc.replace_substring(pc.if_else(kept, texts, pc.utf8_lower(texts)), "\n", " ")


def tokenised(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of all `docs` (doc_id, text): ids by the library, then `end_id`, cut after every `capacity` ids.

    Stored once in the shared folder, so ids are computed once and `piece_key` is stable. A null or empty
    text is `end_id` alone; repeated rows are documents of their own; an empty table has no pieces.
    The vocabulary must drop white space, as those with word ends do; special strings in a text are
    handled as the library does by default.
    """
    schema = PIECES.format(id=docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ids(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                flat, sizes = ids_of(pc.fill_null(part.column("text"), ""))
                flat = np.insert(flat, np.cumsum(sizes), end_id)
                sizes = sizes + 1
                cuts = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                starts = piece * capacity
                lengths = np.minimum(sizes[doc] - starts, capacity)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                raw, at = memoryview(flat).cast("B"), (4 * offsets).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)),
                        pa.array(piece, pa.int32()), pa.array(starts), pa.array(lengths),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32))),
                        pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids", "ids_crc32"],
                )

    cut = docs.select("doc_id", "text").mapInArrow(run, schema)
    return materialise(cut.withColumn("piece_key", F.monotonically_increasing_id()), "pieces")


# Bins

def as_they_come(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Pieces in the order of the deal, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for i, size in enumerate(lengths.tolist()):
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class Search:
    """Local search over the underfull bins of a shard.

    The emptiest bin gives to fuller ones: a piece moves to where it fits best, or it, or it and the bin's shortest piece, changes
    places with a shorter one, or it with two that are shorter together. Every change raises the sum of squared fills, until bins
    are empty. Bins are found by room, and pieces by the room of their bin and their length, as bits of whole numbers, so
    a change is a look-up; full bins leave the index.
    """

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.length = lengths.tolist()
        self.capacity = capacity
        self.bins = as_they_come(lengths, capacity)
        self.room = [capacity - sum(self.length[i] for i in b) for b in self.bins]
        self.least = -(-sum(self.length) // capacity)
        self.used = len(self.bins)
        self.changes = {"move": 0, "one for one": 0, "two for one": 0, "split": 0}
        self.members: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.fresh: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.rooms = self.fresh_rooms = 0
        self.lengths_at = [0] * (capacity + 1)
        self.holders: dict[int, set[int]] = {}
        self.pairs: dict[int, list[int]] = {}  # full bins by sums of two of their shortest pieces
        self.short: dict[int, list[tuple[int, int, int]]] = {}  # what _short_pairs found, until the bin changes
        for b in range(len(self.bins)):
            self._enter(b)

    def squared_fill(self) -> int:
        return sum((self.capacity - r) ** 2 for r in self.room)

    def _enter(self, b: int) -> None:
        r = self.room[b]
        if not self.bins[b]:
            return
        if not r:
            for total, _, _ in self._short_pairs(b):
                self.pairs.setdefault(total, []).append(b)
            return
        self.members[r].add(b)
        self.fresh[r].add(b)
        self.rooms |= 1 << r
        self.fresh_rooms |= 1 << r
        for size in {self.length[i] for i in self.bins[b]}:
            self.holders.setdefault(r << 32 | size, set()).add(b)
            self.lengths_at[r] |= 1 << size

    def _leave(self, b: int) -> None:
        r = self.room[b]
        if b not in self.members[r]:
            return
        self.members[r].remove(b)
        self._tried(b)
        if not self.members[r]:
            self.rooms &= ~(1 << r)
        for size in {self.length[i] for i in self.bins[b]}:
            held = self.holders[r << 32 | size]
            held.remove(b)
            if not held:
                self.lengths_at[r] &= ~(1 << size)

    def _tried(self, b: int) -> None:
        r = self.room[b]
        self.fresh[r].discard(b)
        if not self.fresh[r]:
            self.fresh_rooms &= ~(1 << r)

    def _exchange(self, out: list[int], back: list[int], source: int, target: int) -> None:
        if self.room[target]:
            self._leave(target)
        for i in out:
            self.bins[source].remove(i)
        for j in back:
            self.bins[target].remove(j)
        self.bins[target] += out
        self.bins[source] += back
        self.short.pop(source, None)
        self.short.pop(target, None)
        moved = sum(self.length[i] for i in out) - sum(self.length[j] for j in back)
        self.room[source] += moved
        self.room[target] -= moved
        self._enter(target)

    def _one_back(self, size: int, room: int) -> tuple[int, int] | None:
        """(room, length) of a piece shorter than `size` whose bin takes `size` in its place, with the most gain."""
        rooms = self.rooms & ((1 << min(size, self.capacity + 1)) - 1)
        best, where = 0, 0
        while rooms:
            r = rooms.bit_length() - 1
            if r <= best:
                break
            rooms ^= 1 << r
            found = self.lengths_at[r] >> (size - r)
            if found:
                gain = r + 1 - (found & -found).bit_length()
                if gain > best and gain + room > r:  # squared fill must rise
                    best, where = gain, r
        return (where, size - best) if best else None

    def _two_back(self, size: int, room: int) -> tuple[int, list[int]] | None:
        """(bin, two of its shortest pieces) that are shorter together than `size` and leave room for it."""
        for r in _bits(self.rooms & ((1 << min(size, self.capacity + 1)) - 1)):
            for b in islice(self.members[r], TRIED_BINS):
                for total, x, y in self._short_pairs(b):
                    gain = size - total
                    if 0 < gain <= r and gain + room > r:
                        return b, [x, y]
        return None

    def _give(self, source: int) -> bool:
        """One change that takes tokens out of `source`, which has left the index."""
        own = sorted(self.bins[source], key=self.length.__getitem__, reverse=True)
        room = self.room[source]
        seen = set()
        for i in own:
            size = self.length[i]
            if size in seen:
                continue
            seen.add(size)
            above = self.rooms >> size
            if above:
                r = size + (above & -above).bit_length() - 1
                if r < room + size:
                    self._exchange([i], [], source, next(iter(self.members[r])))
                    self.changes["move"] += 1
                    return True
            outs = [[i]] if i == own[-1] else [[i], [i, own[-1]]]
            for out in outs:
                found = self._one_back(sum(self.length[k] for k in out), room)
                if found:
                    r, wanted = found
                    target = next(iter(self.holders[r << 32 | wanted]))
                    back = next(j for j in self.bins[target] if self.length[j] == wanted)
                    self._exchange(out, [back], source, target)
                    self.changes["one for one" if len(out) == 1 else "two for one"] += 1
                    return True
            pair = self._two_back(size, room)
            if pair:
                self._exchange([i], pair[1], source, pair[0])
                self.changes["two for one"] += 1
                return True
        return False

    def _short_pairs(self, b: int) -> list[tuple[int, int, int]]:
        """(length together, piece, piece) of any two of the bin's shortest pieces."""
        found = self.short.get(b)
        if found is None:
            length = self.length
            shortest = sorted(self.bins[b], key=length.__getitem__)[:PAIRED_PIECES]
            found = self.short[b] = [(length[x] + length[y], x, y) for x, y in combinations(shortest, 2)]
        return found

    def _split(self, source: int) -> bool:
        """Change a piece for two of a full bin that are as long together: shorter pieces fit elsewhere."""
        for i in sorted(self.bins[source], key=self.length.__getitem__, reverse=True):
            size = self.length[i]
            full = self.pairs.get(size, [])
            while full:
                target = full.pop()
                back = next(([x, y] for total, x, y in self._short_pairs(target) if total == size), None)
                if back:  # the bin may have changed since it was noted
                    self._exchange([i], back, source, target)
                    self.changes["split"] += 1
                    return True
        return False

    def _again(self) -> None:
        """All open bins may try again: what they exchange with has changed."""
        self.fresh = [set(m) for m in self.members]
        self.fresh_rooms = self.rooms

    def run(self) -> np.ndarray:
        before = None
        while self.used > self.least and self.used != before:
            before = self.used
            while self.used > self.least and self.fresh_rooms:
                source = next(iter(self.fresh[self.fresh_rooms.bit_length() - 1]))
                self._leave(source)
                while self.bins[source] and (self._give(source) or self._split(source)):
                    pass
                if self.bins[source]:
                    self._enter(source)
                    self._tried(source)
                else:
                    self.used -= 1
            self._again()
        out = np.empty(len(self.length), np.int64)
        for b, pieces in enumerate(self.bins):
            out[pieces] = b
        return out


def pack_lengths(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each piece, from 0 without gaps."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    search = Search(lengths, capacity)
    bins = search.run()
    if search.used > search.least:  # a second start, longest pieces first, may end elsewhere
        order = np.argsort(-lengths, kind="stable")
        other = Search(lengths[order], capacity)
        found = other.run()
        if other.used < search.used:
            bins[order] = found
    return np.unique(bins, return_inverse=True)[1]


def _pack_shard(capacity: int, level: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "piece_key")])
        lengths = rows["length"].to_numpy()
        bins = pack_lengths(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.ones(len(order), bool)
        first[1:] = bins[order][1:] != bins[order][:-1]
        base = np.maximum.accumulate(np.where(first, before, 0))
        offset = np.empty(len(order), np.int64)
        offset[order] = before - base
        fill = np.bincount(bins, lengths).astype(np.int64)
        shard = key[0].as_py()
        return rows.drop_columns(["_shard"]).append_column(
            "sequence_id", pa.array((level << 56) + (shard << 32) + bins, pa.int64())
        ).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill[bins]))

    return run


def packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """Place of each piece: sequence_id (any number), offset in it (gapless from 0) and the sequence's fill.

    Takes the pieces of `tokenised`; the ids themselves aren't moved. Equal pieces are interchangeable, so
    ties change nothing but which copy stands where.
    """
    narrow = pieces.select("piece_key", "doc_id", "piece", "start", "length", "ids_crc32")
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"piece_key long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"
    done: list[DataFrame] = []
    count, level = narrow.count(), 0
    while True:
        shards = max(1, -(-count // SHARD_PIECES))
        dealt = narrow.withColumn(
            "_shard", F.pmod(F.xxhash64("piece_key", "ids_crc32", F.lit(level)), F.lit(shards)).cast("long")
        )
        placed = dealt.groupBy("_shard").applyInArrow(_pack_shard(capacity, level), schema)
        if shards == 1:
            done.append(placed)
            break
        placed = materialise(placed, "packed")
        slack = F.col("fill") < REOPEN * capacity
        left = placed.where(slack).count()
        if left == 0 or left > count // 2:  # pieces of a kind that fills no bin: another deal won't either
            done.append(placed)
            break
        done.append(placed.where(~slack))
        narrow, count, level = placed.where(slack).drop("sequence_id", "offset", "fill"), left, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """One row per sequence with its ids, at most `capacity` of them, and the documents in it."""
    parts = pieces.select("piece_key", "ids").join(places.drop("ids"), "piece_key")
    return (
        parts.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("parts"))
        .select(
            "sequence_id", F.flatten("parts.ids").alias("ids"),
            F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"),
        )
    )
