"""Benchmark decontamination with an Aho-Corasick automaton.

Holding every window of ten words would take some sixty nodes of the automaton for each
word of the benchmark. Every window of ten holds eight runs of three words, and the
automaton holds the one of these that is rarest among all items, so phrases that many items
share are hardly ever in it. Where a run is met, the windows that were represented by it are
looked up whole, as words, at their places around it; equal windows of all items are one entry, so
a text meets a phrase once however many items hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import release_memory, window_hashes

#: Bytes of benchmark text that an automaton is made for (some 100 bytes of memory each in every worker).
MOST_BYTES = 16 << 20
#: Words of a run that the automaton holds.
RUN_WORDS = 3
#: Windows of which the rarest run is looked for at once.
SLICE = 1 << 18

#: Per byte: A-Z as a-z, other ASCII but letters and digits as a blank. Lengths stay.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def normalised_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Windows:
    """All different windows of ``length`` words among the items, by hash, each with the items that hold it."""

    def __init__(self, length: int, flat: np.ndarray, begins: np.ndarray, owners: np.ndarray) -> None:
        """A window begins at each of ``begins`` in the words ``flat``; ``owners`` are its items."""
        self.length, self.flat = length, flat
        hashes = window_hashes(flat.astype(np.uint64), length)[begins]
        order = np.lexsort((owners, hashes))
        begins, owners, hashes = begins[order], owners[order], hashes[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        self.hashes, self.begin, self.group = hashes[new], begins[new], np.append(np.flatnonzero(new), len(hashes))
        self.owners = owners
        # a hash of two windows would hide one of them
        for k in range(0, len(begins), SLICE):
            own = begins[k : k + SLICE]
            first = self.begin[np.searchsorted(self.hashes, hashes[k : k + SLICE])]
            if (self.words(flat, own) != self.words(flat, first)).any():
                raise ValueError("two windows of the benchmark share a hash of 64 bits")

    def words(self, line: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return line[begins[:, None] + np.arange(self.length)]

    def met(self, line: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of places in a text's words those where a window stands, and the numbers of all items that hold one."""
        begins = np.unique(begins[(begins >= 0) & (begins + self.length <= len(line))])
        own = self.words(line, begins)
        hashes = window_hashes(own.ravel().astype(np.uint64), self.length)[:: self.length]
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = (self.hashes[k] == hashes) & (own == self.words(self.flat, self.begin[k])).all(axis=1)
        found = np.unique(k[same])
        items = [self.owners[self.group[w] : self.group[w + 1]] for w in found.tolist()]
        return begins[same], np.unique(np.concatenate(items)) if items else np.empty(0, np.int64)


class Scanner:
    """Finds items' windows in texts; ``items`` is [(name, text)]."""

    def __init__(self, items: list[tuple[str, bytes]], size: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.names: list[str] = []
        lists, seen = [], set()
        for name, text in items:
            own = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in normalised_words(text)], np.uint32)
            if len(own) and (name, own.tobytes()) not in seen:
                seen.add((name, own.tobytes()))
                self.names.append(name)
                lists.append(own)
        self.tables: dict[int, Windows] = {}
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        places: dict[bytes, set[tuple[int, int]]] = {}
        lengths = np.array([len(x) for x in lists], np.int64)
        flat = np.concatenate(lists) if lists else np.empty(0, np.uint32)
        offsets = np.append(0, np.cumsum(lengths))
        words = list(self.numbers)
        for length in sorted({min(size, n) for n in lengths.tolist()}):
            run, own = min(RUN_WORDS, length), np.flatnonzero(np.minimum(lengths, size) == length)
            counts = lengths[own] - length + 1
            owners = np.repeat(own, counts)
            begins = np.repeat(offsets[own] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(len(owners))
            self.tables[length] = Windows(length, flat, begins, owners)
            for first, offset in _rarest(flat, begins, length, run):
                key = b" " + b" ".join(words[n - 1] for n in flat[first : first + run].tolist()) + b" "
                places.setdefault(key, set()).add((length, offset))
        for key, own in places.items():
            # latin-1 gives each byte a character, so offsets are offsets in bytes
            self.found.add_word(key.decode("latin-1"), (key.count(b" ") - 1, tuple(sorted(own))))
        self.empty = not places
        if places:
            self.found.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit runs [(first word, past the last)], and the items found."""
        words = normalised_words(text)
        if self.empty or not words:
            return len(words), [], set()
        joined = b" " + b" ".join(words) + b" "
        met = list(self.found.iter(joined.decode("latin-1")))
        if not met:
            return len(words), [], set()
        known = self.numbers.get
        line = np.fromiter((known(w, 0) for w in words), np.uint32, len(words))
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        past = np.searchsorted(blanks, [end for end, _ in met]).tolist()  # the blank after word k - 1 is number k
        asked: dict[int, list[int]] = {}
        for last, (_, (run, places)) in zip(past, met, strict=True):
            for length, offset in places:
                asked.setdefault(length, []).append(last - run - offset)
        runs, names = [], set()
        for length, begins in asked.items():
            at, items = self.tables[length].met(line, np.array(begins))
            runs += [(k, k + length) for k in at.tolist()]
            names.update(self.names[k] for k in items.tolist())
        return len(words), merged(runs), names


def _rarest(flat: np.ndarray, begins: np.ndarray, length: int, run: int) -> list[tuple[int, int]]:
    """(place, offset): for each window its rarest run of ``run`` words, and where in the window that is; equal ones once."""
    hashes = window_hashes(flat.astype(np.uint64), run)
    steps = np.arange(length - run + 1)
    inside = np.unique((begins[:, None] + steps).ravel()) if len(begins) < SLICE else np.flatnonzero(_covered(len(flat), begins, len(steps)))
    _, back, counts = np.unique(hashes[inside], return_inverse=True, return_counts=True)
    rank = np.zeros(len(flat), np.uint64)
    rank[inside] = (counts[back].astype(np.uint64) << np.uint64(32)) | (hashes[inside] >> np.uint64(32))  # equal runs have equal ranks
    found = []
    for k in range(0, len(begins), SLICE):
        own = begins[k : k + SLICE]
        offset = rank[own[:, None] + steps].argmin(axis=1)
        found.append(np.stack([own + offset, offset]))
    place, offset = np.concatenate(found, axis=1)
    _, first = np.unique(hashes[place] * np.uint64(64) + offset.astype(np.uint64), return_index=True)
    return list(zip(place[first].tolist(), offset[first].tolist(), strict=True))


def _covered(n: int, begins: np.ndarray, steps: int) -> np.ndarray:
    edges = np.zeros(n + steps + 1, np.int64)
    np.add.at(edges, begins, 1)
    np.add.at(edges, begins + steps, -1)
    return np.cumsum(edges)[:n] > 0


_SCANNERS: dict[str, Scanner] = {}


def _scanner(key: str, items, size: int) -> Scanner:
    """A worker builds an automaton once and keeps it for the tasks that follow."""
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(items.value, size)
    return _SCANNERS[key]


def word_offsets(text: bytes) -> np.ndarray:
    """(begin, end) of each normalised word in the bytes of the original text."""
    inside = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return edges.reshape(-1, 2)


def _pass(rows: DataFrame, items: list[tuple[str, bytes]], size: int) -> DataFrame:
    """Scan column ``text`` for the items; fills n_words, hit_words, hit_bytes and items."""
    shared, key = rows.sparkSession.sparkContext.broadcast(items), uuid4().hex
    schema, names = rows.schema, rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # that of another stage in this worker
        scanner = _scanner(key, shared, size)
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            counts, hits, places, found = [], [], [], []
            for text in column["text"]:
                body = text.as_py() or b""
                n, runs, own = scanner.scan(body)
                counts.append(n)
                hits.append([{"first": a, "past": b} for a, b in runs])
                at = word_offsets(body) if runs else None
                places.append([{"begin": int(at[a, 0]), "end": int(at[b - 1, 1])} for a, b in runs])
                found.append(sorted(own))
            column |= {
                "n_words": pa.array(counts, pa.int64()),
                "hit_words": pa.array(hits, batch.schema.field("hit_words").type),
                "hit_bytes": pa.array(places, batch.schema.field("hit_bytes").type),
                "items": pa.array(found, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([column[n] for n in names], names)

    return rows.mapInArrow(run, schema)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(runs):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window_words: int = 10,
    most_bytes: int = MOST_BYTES,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Find items' windows in the documents.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII,
    with A-Z as a-z. A window is ``window_words`` consecutive words of an item; an item
    of fewer words is one window, one without words has none.

    Returns for every row of ``docs``: row (the whole row as a struct, so other
    columns may have any names), text (binary), n_words, hit_words (runs of words
    inside occurrences, as [first, past) word numbers), hit_bytes (the same runs as
    [begin, end) bytes of the original text) and items (names of items with occurring
    windows, sorted as strings). A null text has no words. Repeated rows and null
    ids are scanned like others; items that share an id count as one, and a null id
    is the string "null". Without items, or documents, nothing is found.

    Documents are not shuffled and read once. The items, whose size is measured first, are
    broadcast and made one automaton by each worker; more than ``most_bytes`` of their text is an error
    (a larger benchmark is a job for each part of it). A very long text is scanned by one task
    in time that grows with its length.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    none, nowhere = "array<struct<first:long,past:long>>", "array<struct<begin:long,end:long>>"
    rows = docs.select(
        whole, F.col(text_col).cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast(none).alias("hit_words"), F.array().cast(nowhere).alias("hit_bytes"), F.array().cast("array<string>").alias("items"),
    )
    own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"), F.col(item_text).cast("binary").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the items hold {size} bytes of text; an automaton is made for {most_bytes} at most")
    return _pass(rows, [(r.name, bytes(r.text or b"")) for r in own.collect()], window_words)


def clean_rows(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item's window occurs."""
    return decontaminate(docs, items, **options).filter(F.size("hit_words") == 0).select("row.*")
