"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

Items and texts are normalised alike: ASCII lower case, words of digits, lower-case letters and non-ASCII characters.
The automaton of all items reads a document's words, tracks the longest suffix that occurs in any item, and reports the
windows that end there: ``window`` consecutive item words, or a whole item that is shorter. Only runs of item words that are
long enough for a window are read, as no window crosses any other word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .scratch import fresh, small_batches

WINDOW = 10
#: Bytes of item text in one automaton (about 200 bytes of memory a word). More items make several blocks, which read the documents in turn.
ITEM_BYTES = 4_000_000


class SuffixAutomaton:
    """Of several word sequences; states are numbers, ``node[s]`` maps a word to the next state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The part of state q that p reaches with a word, as a state of its own where it is shorter than q."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word, self.next[last][word])
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            last = new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The state and length of the longest known suffix after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(word, 0)
        return (to, length + 1) if to else (0, 0)

    def suffix(self, state: int, wide: int) -> int:
        """The state of the last ``wide`` words of what ``state`` has read."""
        while self.length[self.link[state]] >= wide:
            state = self.link[state]
        return state


class Items:
    """A block of test items: words by number, the automaton, and the items of each window."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int):
        self.window = window
        column = pa.array([text for _, text in rows], pa.large_string())
        hashed = [words[at[i] : at[i + 1]] for _, _, words, at in tk.hashed_words(column, tk.SYMBOLS) for i in range(len(at) - 1)]
        self.words = np.unique(np.concatenate([*hashed, np.zeros(0, np.uint64)]))
        numbered = [np.searchsorted(self.words, h).tolist() for h in hashed]
        self.automaton = SuffixAutomaton()
        for words in numbered:
            self.automaton.add(words)
        self.widths = sorted({min(window, len(w)) for w in numbered if w})
        self.owners: dict[tuple[int, int], set[str]] = {}
        for (item, _), words in zip(rows, numbered, strict=True):
            state = length = 0
            wide = min(window, len(words))
            for word in words:
                state, length = self.automaton.step(state, length, word)
                if wide and length >= wide:
                    self.owners.setdefault((self.automaton.suffix(state, wide), wide), set()).add(item)

    def scan(self, words: np.ndarray, at: np.ndarray) -> tuple[list[tuple[int, int]], dict[int, set[str]]]:
        """Hit word ranges over a block of documents, and the items by document."""
        hits: list[tuple[int, int]] = []
        items: dict[int, set[str]] = {}
        if not self.widths or not len(words):
            return hits, items
        place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[place] == words
        # Runs of item words, cut at the documents' edges.
        start = known.copy()
        start[1:] &= ~known[:-1]
        inner = at[:-1][at[:-1] < len(words)]
        start[inner] = known[inner]
        first = np.flatnonzero(start)
        stop = known.copy()
        stop[:-1] &= ~known[1:]
        last = inner[inner > 0] - 1
        stop[last] = known[last]
        end = np.flatnonzero(stop) + 1
        wide = end - first >= self.widths[0]
        step, suffix = self.automaton.step, self.automaton.suffix
        for a, b in zip(first[wide].tolist(), end[wide].tolist(), strict=True):
            state = length = 0
            doc = -1
            for i, word in enumerate(place[a:b].tolist(), a + 1):
                state, length = step(state, length, word)
                for w in self.widths:
                    if w > length:
                        break
                    owners = self.owners.get((suffix(state, w), w))
                    if owners:
                        if doc < 0:
                            doc = int(np.searchsorted(at, a, "right")) - 1
                        items.setdefault(doc, set()).update(owners)
                        hits.append((i - w, i))
        return hits, items


@dataclass(frozen=True)
class Block:
    """Items whose automaton each worker makes when it first needs it; only the texts travel."""

    rows: tuple[tuple[str, str], ...]
    window: int

    def items(self) -> Items:
        if self not in _made:
            _made.clear()
            _made[self] = Items([*self.rows], self.window)
        return _made[self]


_made: dict[Block, Items] = {}


def item_blocks(benchmark: DataFrame, window: int) -> list[Block]:
    """Blocks of at most about ITEM_BYTES of item text (or one item), one at least."""
    small_batches(benchmark.sparkSession)
    known = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item_id is not null and text is not null")
    total = known.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = max(1, -(-total // ITEM_BYTES))
    return [Block(tuple((r.item, r.text) for r in known.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k).orderBy("item", "text").collect()), window) for k in range(n)]


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
NAMES = pa.list_(pa.string())


@dataclass
class Read:
    """What an automaton has found in a block of documents, and their words."""

    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    base: np.ndarray  # the documents' first bytes
    hits: list[tuple[int, int]]
    items: dict[int, set[str]]


def read(texts: pa.Array, block: Block) -> Iterator[tuple[int, int, Read]]:
    items = block.items()
    data, offsets = tk.text_bytes(texts)
    for a, b in tk.blocks(offsets):
        part = tk.LOWER[data[offsets[a] : offsets[b]]]
        base = offsets[a : b + 1] - offsets[a]
        starts, ends, at = tk.word_spans(part, base, tk.SYMBOLS)
        yield a, b, Read(starts, ends, at, base, *items.scan(tk.span_hashes(part, starts, ends), at))


def mark_batches(batches: Iterator[pa.RecordBatch], block: Block, text_at: int) -> Iterator[pa.RecordBatch]:
    """The batches with what a block has found added to their last two columns: word ranges and items."""
    for batch in batches:
        hits, names = (c.to_pylist() for c in batch.columns[-2:])
        for a, _, r in read(batch.column(text_at), block):
            for x, y in r.hits:
                doc = int(np.searchsorted(r.at, x, "right")) - 1
                hits[a + doc].append({"start": x - int(r.at[doc]), "end": y - int(r.at[doc])})
            for doc, ids in r.items.items():
                names[a + doc] = sorted({*names[a + doc], *ids})
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(hits, RANGES), pa.array(names, NAMES)], schema=batch.schema)


def marked(docs: DataFrame, blocks: list[Block]) -> DataFrame:
    """``docs`` after all blocks but the last have read them, one after the other; with one block, ``docs`` as they are."""
    if len(blocks) > 1:
        text_at = docs.columns.index("text")
        hits, items = fresh(docs, "block_hits"), fresh(docs, "block_items")
        docs = docs.withColumns({hits: F.array().cast("array<struct<start: long, end: long>>"), items: F.array().cast("array<string>")})
        for block in blocks[:-1]:
            docs = docs.mapInArrow(lambda it, block=block: mark_batches(it, block, text_at), docs.schema)
    return docs


def scan_batches(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """The last block's reading of doc_id, text and what the others have found, if there are others."""
    for batch in batches:
        before = [c.to_pylist() for c in batch.columns[2:]] or None
        for a, b, r in read(batch.column(1), block):
            edge = np.zeros(len(r.starts) + 1, np.int64)
            found = [*r.hits]
            if before:
                found += [(int(r.at[i]) + h["start"], int(r.at[i]) + h["end"]) for i in range(b - a) for h in before[0][a + i]]
            if found:
                where = np.array(found)
                np.add.at(edge, where[:, 0], 1)
                np.add.at(edge, where[:, 1], -1)
            hit = np.cumsum(edge[:-1]) > 0
            upto = np.concatenate([[0], np.cumsum(hit)])
            spans: list[list[dict]] = []
            for i in range(b - a):
                lo, hi = r.at[i], r.at[i + 1]
                mine = []
                if upto[hi] > upto[lo]:
                    flags = np.concatenate([[False], hit[lo:hi], [False]])
                    turn = np.flatnonzero(flags[1:] != flags[:-1]) + lo
                    mine = [{"start": int(r.starts[x] - r.base[i]), "end": int(r.ends[y - 1] - r.base[i]), "words": int(y - x)} for x, y in zip(turn[::2], turn[1::2], strict=True)]
                spans.append(mine)
            ids = [sorted({*r.items.get(i, ()), *(before[1][a + i] if before else ())}) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(r.at), pa.int64()),
                    pa.array(upto[r.at[1:]] - upto[r.at[:-1]], pa.int64()),
                    pa.array(ids, NAMES),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_hit", "items", "items_sha256", "spans"],
            )


SCAN = "doc_id long, n_words long, n_hit long, items array<string>, items_sha256 string, spans array<struct<start: long, end: long, words: long>>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: its words, the words inside any occurrence of an item's window, the items (ids as
    sorted strings), the SHA-256 of their comma-joined ids, and the hit byte ranges of the text.

    Null and empty texts have no words and no hits. Items without an id or without words match nothing; equal items all
    count. An empty benchmark hits nothing. Repeated rows give repeated results. Other columns are not read.
    """
    blocks = item_blocks(benchmark, window)
    slim = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), blocks)
    return slim.mapInArrow(lambda it: scan_batches(it, blocks[-1]), SCAN)


def clean_batches(batches: Iterator[pa.RecordBatch], block: Block, text_at: int, id_at: int, width: int, min_words: int, max_share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(text_at)
        new: list[str | None] = []
        keep: list[bool] = []
        before = batch.columns[width:]
        slim = pa.RecordBatch.from_arrays([batch.column(id_at), texts, *before], [str(i) for i in range(2 + len(before))])
        for found in scan_batches(iter([slim]), block):
            for n, hit, spans in zip(found.column(1).to_pylist(), found.column(2).to_pylist(), found.column(5).to_pylist(), strict=True):
                text = texts[len(new)].as_py()
                keep.append(not hit or hit <= max_share * n)
                cut = [s for s in spans if s["words"] >= min_words]
                if cut:
                    raw, at, left = text.encode(), 0, []
                    for s in cut:
                        left.append(raw[at : s["start"]])
                        at = s["end"]
                    text = b"".join([*left, raw[at:]]).decode()
                new.append(text)
        columns = [pa.array(new, texts.type) if i == text_at else c for i, c in enumerate(batch.columns[:width])]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(columns)]).filter(pa.array(keep, pa.bool_()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = 1, max_share: float = 0.5) -> DataFrame:
    """``docs`` with all columns, without the hit spans of ``min_words`` words or more, and without documents of whose
    words more than ``max_share`` are hit. Other rows, null and empty texts included, stay as they are.
    Very long texts are read whole; columns can have any names."""
    blocks = item_blocks(benchmark, window)
    text_at, id_at, width = docs.columns.index("text"), docs.columns.index("doc_id"), len(docs.columns)
    return marked(docs, blocks).mapInArrow(lambda it: clean_batches(it, blocks[-1], text_at, id_at, width, min_words, max_share), docs.schema)
