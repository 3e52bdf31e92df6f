"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch lie in one ragged numpy array of symbols. In each round every
pre-token finds its pair of lowest rank and merges it, all pre-tokens at once; pre-tokens without a
mergeable pair leave the array. The surviving symbols are the tokens.

A pair is merged at all its places in one round if no pair with the product ranks lower than the
pair itself. Otherwise only its leftmost place is merged, because the product's pairs go first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, slices

#: Distinct space-separated chunks a task remembers before it starts anew.
REMEMBERED = 500_000
#: Bytes of text handled at once.
BATCH_BYTES = 2 << 20
_NONE = np.int64(1 << 40)
#: Characters for which this module splits by itself; chunks with others go through the library's normaliser and splitter.
_PLAIN = regex.compile(r"[!-~¡-¬®-ÿ]+")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class RankMerger:
    """Merge tables of a tokenizer file with byte-level symbols, word ends and dropped white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        split = next((p for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"), None)
        if not suffix or model.get("ignore_merges") or split is None or split["behavior"] != "Removed":
            raise ValueError("this operator takes vocabularies with word ends that drop white space")
        vocab = model["vocab"]
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        letters = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        keys = ids[:, 0] * self.width + ids[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.product = ids[:, 2]
        lowest = np.full(self.width, _NONE)
        np.minimum.at(lowest, ids[:, 0], np.arange(len(ids)))
        np.minimum.at(lowest, ids[:, 1], np.arange(len(ids)))
        self.at_once = lowest[self.product] >= np.arange(len(ids))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        place = np.searchsorted(self.keys, key)
        place[place == len(self.keys)] = 0
        return np.where(self.keys[place] == key, self.ranks[place], _NONE)

    def merge(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pre-tokens one after the other, and the number of each one's tokens."""
        counts = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        data = np.frombuffer(b"".join(pretokens), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(counts) - 1
        symbols[ends] = self.final[data[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.arange(len(pretokens))  # of the pre-tokens still in the array
        sizes = counts.copy()
        owner = np.repeat(rows, sizes)
        ranks = np.full(len(symbols), _NONE)
        if len(symbols) > 1:
            ranks[:-1] = np.where(owner[:-1] == owner[1:], self._rank(symbols[:-1], symbols[1:]), _NONE)
        while len(rows):
            heads = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(ranks, heads)
            open_ = best < _NONE
            if not open_.all():
                stay = np.repeat(open_, sizes)
                closed = rows[~open_]
                done.append((np.repeat(closed, sizes[~open_]), symbols[~stay]))
                counts[closed] = sizes[~open_]
                symbols, ranks, rows, sizes, best = symbols[stay], ranks[stay], rows[open_], sizes[open_], best[open_]
                if not len(rows):
                    break
            where = np.repeat(np.arange(len(rows)), sizes)
            at = np.flatnonzero(ranks == best[where])
            new_run = np.ones(len(at), bool)
            new_run[1:] = at[1:] != at[:-1] + 1
            number = np.arange(len(at))
            in_run = number - np.maximum.accumulate(np.where(new_run, number, 0))
            leftmost = np.ones(len(at), bool)
            leftmost[1:] = where[at[1:]] != where[at[:-1]]
            at = at[np.where(self.at_once[best[where[at]]], in_run % 2 == 0, leftmost)]
            symbols[at] = self.product[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            sizes = sizes - np.bincount(where[at], minlength=len(rows))
            merged = at - np.arange(len(at))
            symbols, ranks, where = symbols[keep], ranks[keep], where[keep]
            near = np.zeros(len(symbols) + 1, bool)
            near[merged] = True
            near[merged - 1] = True  # -1 is the spare last place
            touched = np.flatnonzero(near[:-1])
            inside = touched[touched + 1 < len(symbols)]
            ranks[touched] = _NONE
            inside = inside[where[inside] == where[inside + 1]]
            ranks[inside] = self._rank(symbols[inside], symbols[inside + 1])
        if not done:
            return symbols, counts
        order = np.argsort(np.concatenate([r for r, _ in done]), kind="stable")
        return np.concatenate([s for _, s in done])[order], counts

    def pretokens(self, chunk: str) -> tuple[list[bytes], int]:
        """Pre-tokens of a chunk without spaces, and how many special tokens stand in it."""
        if self.special is not None and "<" in chunk and (found := self.special.findall(chunk)):
            parts = [self.pretokens(x)[0] for x in self.special.split(chunk) if x]
            return [p for part in parts for p in part], len(found)
        if _PLAIN.fullmatch(chunk):
            return [chunk.lower().encode()] if chunk.isalpha() else [x.encode() for x in self.pattern.findall(chunk.lower())], 0
        text = self.library.normalizer.normalize_str(chunk)
        split = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(self.byte_of[c] for c in x) for x, _ in split], 0

    def count_chunks(self, chunks: list[str], known: dict[bytes, int]) -> list[int]:
        """Tokens in each chunk; `known` holds counts of pre-tokens and gets those of new ones."""
        split = list(map(self.pretokens, chunks))
        new = [p for p in {p for pre, _ in split for p in pre} if p not in known]
        if new:
            known.update(zip(new, self.merge(new)[1].tolist()))
        return [n + sum([known[p] for p in pre]) for pre, n in split]


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


class Counter:
    """Token counts of whole texts, with a memory of chunks and pre-tokens that is emptied when it is full."""

    def __init__(self, path: str):
        self.merger = merger(path)
        self.known: dict[str, int] = {"": 0}
        self.parts: dict[bytes, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.parts = {"": 0}, {}
        new = [c for c in set().union(*split) if c not in self.known]
        self.known.update(zip(new, self.merger.count_chunks(new, self.parts)))
        get = self.known.__getitem__
        return [sum(map(get, chunks)) for chunks in split]


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One memory per Python worker: what a task has learned serves the worker's next one."""
    return Counter(path)


def with_token_counts(docs: DataFrame, tokenizer: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """`docs` with the number of tokens of each whole text, all other columns as they are.

    tokenizer: path of the vocabulary file, the same on all executors. A null or empty text has no
    tokens. Special strings inside a text count as one token each, as the library does by default.
    Every row is counted on its own, so ties, repeated rows and clashing columns change nothing; an
    empty table gives an empty table. Only one batch of texts is in memory; a longer text is alone.
    """
    (out,) = fresh(docs.drop(name), name)
    kept = docs.drop(out)
    schema = kept.withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, text, BATCH_BYTES):
                texts = [t or "" for t in part.column(text).to_pylist()]
                counts = pa.array(count(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, counts], [*part.schema.names, out])

    return kept.mapInArrow(run, schema)
