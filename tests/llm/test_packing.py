import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece, longest pieces first, each into the fullest bin that takes it."""
    bins = np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = n = 0  # rooms: bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
        bins[i] = b
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_bins_hold_every_piece(lengths):
    bins = packing.pack_lengths(np.array(lengths, np.int64), 40)
    assert len(bins) == len(lengths)
    if lengths:
        fill = np.bincount(bins, lengths)
        assert fill.max() <= 40 and fill.min() > 0
        assert len(fill) <= best_fit(np.array(lengths), 40).max() + 1


def test_search_improves_the_start():
    lengths = np.random.default_rng(0).integers(650, 720, 900)
    start = best_fit(lengths, 2048)
    found = packing.pack_lengths(lengths, 2048)
    assert found.max() < start.max()
    squares = [(np.bincount(b, lengths) ** 2.0).sum() for b in (start, found)]
    assert squares[1] > squares[0]


@pytest.mark.parametrize("low, high", [(1, 2049), (200, 900), (300, 2049)])
def test_changes_pack_the_pieces(low, high):
    """The start is unsorted; exchanges of every kind happen, each raises the squared fill or keeps it, and bins run empty."""
    lengths = np.random.default_rng(7).integers(low, high, 4000)
    search = packing.Search(lengths, 2048)
    bins, fill = search.used, [search.squared_fill()]
    exchange = search._exchange

    def watched(*args):
        exchange(*args)
        fill.append(search.squared_fill())

    search._exchange = watched
    found = search.run()
    assert min(search.changes.values()) > 0 and (np.diff(fill) >= 0).all() and fill[-1] > fill[0]
    assert search.used == len(np.unique(found)) < bins
    assert search.used <= 1.01 * (best_fit(lengths, 2048).max() + 1)


def test_given_documents_reach_the_bound(spark):
    """As few sequences as the tokens need, on all documents of the small tables."""
    for folder, most in (("sf0.01", 442),):
        docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
        got = packing.packed(packing.tokenised(docs, PATH, 2048), 2048).select("sequence_id").distinct().count()
        assert got <= most


def test_a_shard_of_equal_pieces_is_quick():
    start = time.time()
    assert packing.pack_lengths(np.full(16_384, 1100), 2048).max() + 1 == 16_384
    assert time.time() - start < 10


def test_small_case_reaches_the_bound():
    # best fit pairs 6 with 4 and leaves 5 bins; 6+2+2, 5+5, 4+3+3 are 3
    assert packing.pack_lengths(np.array([6, 5, 5, 4, 3, 3, 2, 2]), 10).max() + 1 == 3


def _expected(rows, capacity):
    library = Tokenizer.from_file(PATH)
    out = []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for a in range(0, len(ids), capacity):
            part = np.array(ids[a : a + capacity], "<u4")
            out.append((doc_id, a // capacity, a, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 16)
    rows = [(k, f"word{k} " * (k * 7 % 50)) for k in range(60)] + [(7, "same"), (7, "same"), (None, None), (99, ""), (100, "very long " * 9000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, piece int, sequence_id int")
    pieces = packing.tokenised(docs, PATH, 256)
    got = packing.packed(pieces, 256).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == _expected(rows, 256)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert len(by) <= -(-sum(r["length"] for r in got) // 256) + 2
    sequences = packing.sequences(pieces, packing.packed(pieces, 256)).collect()
    assert sum(len(r["ids"]) for r in sequences) == sum(r["length"] for r in got)
    assert max(len(r["ids"]) for r in sequences) <= 256


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(packing.tokenised(docs, PATH, 64), 64).count() == 0


ODD_TEXTS = [
    "", "\n", " ", "a  b \n c", "a<|endoftext|>B <|endoftext|>,", "<|StartOfText|>X", "ÄÖÜ, ß µ ª º ÿ Ÿ.", "Слово, слово. СЛОВО!", "it's we'll I'd 'tis a.'",
    "a\tb\xa0c\x85d", "e\u0301, \u00e9, a\u0338,", "word,. word,<x> <y> a<b", "數據，數據, 数。", "x²³ ½ 1,000.50", "İ, Bİ. İstanbul,", "क़, ग़. בּ,", "ΟΔΟΣ. Å, ſ.",
    "a\x00b, \x00,", "ﬁ, ŉ.", "🙂 a🙂, ",
]


@pytest.mark.parametrize("remembered", [0, 1_000])
def test_ids_are_the_librarys(monkeypatch, remembered):
    """Also for letters that lower case or NFC takes apart into a letter and a mark, with marks behind them."""
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    texts = ODD_TEXTS + [c + tail for c in map(chr, range(0x250)) for tail in ("", ",", "A.", " b")]
    library, ids_of = Tokenizer.from_file(PATH), packing.Ids(PATH)
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        flat, sizes = ids_of(pa.array(part, pa.large_string()))
        expected = [library.encode(t, add_special_tokens=False).ids for t in part]
        assert sizes.tolist() == list(map(len, expected))
        assert flat.tolist() == [i for ids in expected for i in ids]


def test_words_go_to_the_library_many_at_a_time(monkeypatch):
    """Words the task has not seen are what ids cost: one call for LINE_WORDS of them, none for known ones with other marks."""
    monkeypatch.setattr(packing, "LINE_WORDS", 50)
    ids_of = packing.Ids(PATH)
    calls = []

    class Counted:
        def __init__(self, encoder):
            self.encoder = encoder

        def encode(self, text, **more):
            calls.append(text)
            return self.encoder.encode(text, **more)

    ids_of.model, ids_of.library = Counted(ids_of.model), Counted(ids_of.library)
    words = [f"{a}{b}word" for a in "abcdefghij" for b in "klmnopqrst"]
    first = ids_of(pa.array([" ".join(words[:60]), " ".join(words[40:])]))
    assert len(calls) == 2
    again = ids_of(pa.array([" ".join(f"{w.upper()}," for w in words)]))
    assert calls[2:] == [","]
    assert first[1].sum() + sum(again[1]) == len(first[0]) + len(again[0])
