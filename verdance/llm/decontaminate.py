"""Benchmark decontamination: CGK embedding, bit sampling, exact edit distance.

Texts and items are compared as characters. From the places at which an item's copy may be in step with a text (the starts of words; every
character in scripts without spaces) a random walk runs over the characters: at each step it emits the character under it and, by a random bit of
step and character, stays or goes on (the CGK embedding). Two strings of small edit distance are emitted alike in most steps, so their images
are close in Hamming distance. Coordinates of the images are sampled, several samples for each of several walks; windows of a text that agree with
a window of an item in all coordinates of a sample, and then in enough of all steps, are candidates. What a candidate covers is verified by
the exact edit distance between the item and the best fitting piece of the text around it.

A window has the item's size, up to ``STEPS`` steps; longer items have a window at each of their words, so the longer an item, the more chances
its copies have. The samples repeat until the measured recall at the limit is reached: a test holds it against brute force by size of item and share of
characters changed. Items below ``SHORT`` characters have too few steps to sample from: their runs of characters are looked up at all
places of the text, with as many votes asked for as no allowed edits can take away (the q-gram lemma), so nothing is missed.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, ship_by_value, text_slices
from .textkernel import ALNUM

#: Items below this many characters are searched without loss by runs of characters, longest first.
SHORT, SHORT_RUNS = 32, (4, 3, 2, 1)
#: Steps of a walk, independent walks, half samples drawn of each walk (each two make a sample).
STEPS, WALKS, HALVES = 56, 4, 6
#: For items of so many characters at least: steps sampled from, coordinates in half a sample, walks, the share of steps in which
#: a candidate must agree, and how many of its walks or places must.
CLASSES = ((32, 32, 3, 4, 0.4, 1), (64, 48, 5, 3, 0.6, 1), (112, 56, 6, 3, 0.65, 2))
#: Windows embedded at once, and candidates compared at once.
WINDOWS, PAIRS = 1 << 15, 1 << 16
#: Words longer than this hold window starts of their own; scripts from this character on have a start at each character.
LONG_WORD, UNSPACED = 24, 0x0E00
#: Items below four words are searched from this many characters on: scripts without spaces have few words.
LEAST_CHARS = 10
#: Bits of a run's hash; runs of items looked up at once; votes held at once.
BITS, PART_RUNS, VOTES = 20, 1 << 17, 4_000_000
#: Characters of the runs that a piece of text must share with an item before their edit distance is taken.
GRAM = 3
#: Items and their characters sent to the executors at once; bytes of text worked on at once.
BLOCK_ITEMS, BLOCK_CHARS, SLICE = 4096, 400_000, 1 << 20

#: Bytes of words as they are, all others as spaces.
_SPACED = np.where(ALNUM, np.arange(256), 0x20).astype(np.uint8)


def allowed(n: int, similarity: float) -> int:
    """Edits within which a piece of text counts as an item of ``n`` characters."""
    return int((1 - similarity) * n + 1e-9)


def short_plan(n: int, similarity: float) -> tuple[int, int]:
    """Characters in a run, and runs that any copy of an item of ``n`` characters keeps."""
    edits = allowed(n, similarity)
    for q in SHORT_RUNS:
        votes = n - q + 1 - edits * q
        if votes >= max(1, n // 8):
            break
    return q, max(votes, 1)


def normalised(data: np.ndarray, offsets: np.ndarray) -> str:
    """The texts ``data[offsets[i]:offsets[i + 1]]`` as small words with one space between, and a line feed after each text."""
    if not len(data):
        return "\n" * (len(offsets) - 1)
    keep = ALNUM[data]
    keep[1:] |= keep[:-1].copy()
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets[1:]]
    return np.insert(_SPACED[data[keep]], ends, 0x0A).tobytes().decode("utf-8", "replace").lower()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Of all runs of ``q`` characters."""
    n = max(len(codes) - q + 1, 0)
    h = np.zeros(n, np.uint32)
    for k in range(q):
        h *= np.uint32(0x01000193)
        h += codes[k : k + n]
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return h >> np.uint32(32 - BITS)


@dataclass
class Item:
    item_id: int
    text: str
    edits: int
    votes: int
    masks: dict[str, int]
    grams: list[str]
    shared: int


class Part:
    """The runs of some items, all of ``q`` characters, by hash."""

    def __init__(self, items: list[tuple[int, Item]], q: int):
        self.q = q
        found = [_hashes(_codes(x.text), q) for _, x in items]
        hashes = np.concatenate(found)
        order = np.argsort(hashes, kind="stable")
        self.counts = np.bincount(hashes, minlength=1 << BITS).astype(np.int32)
        self.first = np.cumsum(self.counts) - self.counts
        self.owners = np.repeat(np.arange(len(items)), [len(x) for x in found])[order]
        self.offsets = np.concatenate([np.arange(len(x)) for x in found])[order]
        self.numbers = np.array([k for k, _ in items])
        self.votes = np.array([x.votes for _, x in items])
        self.edits = np.array([x.edits for _, x in items])
        self.chars = np.array([len(x.text) for _, x in items])
        #: Starts are counted in bins at least as wide as the drift, so two bins side by side hold all votes of a copy.
        self.shift = np.array([max(x.edits, 4).bit_length() for _, x in items])
        self.span = int((self.chars + 2 * self.edits).max()) + q

    def spans(self, codes: np.ndarray, at: int = 0) -> list[np.ndarray]:
        """``(item, first, last)``: pieces of ``codes``, which starts at place ``at``, that may hold an item."""
        hashes = _hashes(codes, self.q)
        counts = self.counts[hashes]
        total = int(counts.sum())
        if total > VOTES and len(codes) > 4 * self.span:
            middle = len(codes) // 2
            return self.spans(codes[: middle + self.span], at) + self.spans(codes[middle:], at + middle)
        hit = np.flatnonzero(counts)
        counts = counts[hit]
        which = np.repeat(self.first[hashes[hit]] - (np.cumsum(counts) - counts), counts) + np.arange(total)
        owner = self.owners[which]
        # Places before the text make no negative bins.
        start = np.repeat(hit + (1 << 20), counts) - self.offsets[which]
        key = np.sort((owner << 40) | (start >> self.shift[owner]))
        new = np.flatnonzero(np.diff(key, prepend=-1))
        votes, key = np.diff(new, append=len(key)), key[new]
        both = votes.copy()
        both[:-1] += np.where(key[1:] == key[:-1] + 1, votes[1:], 0)
        key = key[both >= self.votes[key >> 40]]
        if not len(key):
            return []
        runs = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1] + 1]))
        a, b = key[runs], key[np.append(runs[1:], len(key)) - 1]
        owner, mask = a >> 40, (1 << 40) - 1
        first = ((a & mask) << self.shift[owner]) - (1 << 20) - self.edits[owner]
        last = (((b & mask) + 2) << self.shift[owner]) - (1 << 20) + self.chars[owner] + self.edits[owner]
        return [np.stack([self.numbers[owner], first + at, last + at])]


@lru_cache(maxsize=1)
def _walks() -> tuple[np.ndarray, list[np.ndarray]]:
    """For each walk 64 random bits of every class of characters, and for each class of items the coordinates of the half samples."""
    rng = np.random.default_rng(2017)
    bits = rng.integers(0, 1 << 32, (WALKS, -(-STEPS // 32), 256), np.uint32)
    return bits, [np.sort(np.array([[rng.choice(steps, half, replace=False) for _ in range(HALVES)] for _ in range(WALKS)]), axis=2) for _, steps, half, *_ in CLASSES]


def window_starts(codes: np.ndarray) -> np.ndarray:
    """Places at which windows start: of words, of characters without spaces between, and some within long words, by their characters alone.

    A word of one or two characters after a longer one is no start: the longer one is near.
    """
    word = codes > 0x20
    at = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    lengths = np.flatnonzero(word & ~np.append(word[1:], False)) + 1 - at
    marked = codes >= UNSPACED
    marked[at[(lengths > 2) | (np.concatenate([[0], lengths[:-1]]) <= 2)]] = True
    long = lengths > LONG_WORD
    if long.any():
        inside = np.zeros(len(codes) + 1, np.int32)
        inside[at[long]] += 1
        inside[(at + lengths)[long]] -= 1
        pairs = (codes * np.uint32(0x01000193) + np.append(codes[1:], np.uint32(0))) * np.uint32(0x9E3779B1)
        marked |= (inside[:-1].cumsum() > 0) & (pairs >> np.uint32(29) == 0)
    return np.flatnonzero(marked)


def embed(kinds: np.ndarray, starts: np.ndarray, walk: int, steps: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What the walk emits from each start (a row for each step), and with ``ends`` the steps before each walk is past its end.

    ``kinds`` goes on for ``steps`` characters after the last start.
    """
    bits = _walks()[0][walk]
    at = starts.astype(np.intp)
    out = np.empty((steps, len(starts)), np.uint32)
    within = np.full(len(starts), steps)
    values, move = None, np.empty(len(starts), np.uint32)
    for s in range(steps):
        if s % 32 == 0:
            values = bits[s // 32][kinds]
        if ends is not None:
            within = np.where((at >= ends) & (within == steps), s, within)
        np.take(values, at, out=out[s], mode="clip")
        np.right_shift(out[s], np.uint32(s % 32), out=move)
        np.bitwise_and(move, np.uint32(1), out=move)
        np.add(at, move, out=at, casting="unsafe")
    return out, within


def halves(emitted: np.ndarray, coordinates: np.ndarray) -> list[np.ndarray]:
    """The hashes of each half sample."""
    out = []
    for places in coordinates:
        h = emitted[places[0]].copy()
        for k in places[1:]:
            h *= np.uint32(0x01000193)
            h += emitted[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        out.append(h)
    return out


def samples(parts: list[np.ndarray], coordinates: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The last coordinate and the hashes of each sample, a sample being two of the halves."""
    for i in range(HALVES):
        for j in range(i):
            h = parts[i] * np.uint32(0x9E3779B1) + parts[j]
            yield int(max(coordinates[i][-1], coordinates[j][-1])), h ^ (h >> np.uint32(16))


def _kinds(codes: np.ndarray, more: int) -> np.ndarray:
    """A class below 256 for each character, with ``more`` empty ones after them."""
    return np.append((codes * np.uint32(0x9E3779B1)) >> np.uint32(24), np.zeros(more, np.uint32)).astype(np.uint8)


class Windows:
    """The embedded windows of items of one class."""

    def __init__(self, items: list[tuple[int, Item]], which: int):
        _, self.steps, _, self.walks, self.agree, self.votes = CLASSES[which]
        self.coordinates = _walks()[1][which]
        codes = [_codes(x.text) for _, x in items]
        first = np.cumsum([0] + [len(c) + self.steps for c in codes])
        kinds = np.concatenate([_kinds(c, self.steps) for c in codes])
        places = [window_starts(c) for c in codes]
        number = np.repeat(np.arange(len(items)), [len(p) for p in places])
        self.offsets = np.concatenate(places)
        self.numbers = np.array([k for k, _ in items])[number]
        self.edits = np.array([x.edits for _, x in items])[number]
        self.chars = np.array([len(x.text) for _, x in items])[number]
        starts = first[number] + self.offsets
        self.emitted: list[np.ndarray] = []
        self.within: list[np.ndarray] = []
        #: Of the hashes of a text, all but one in thirty or so that are none of the items' are ruled out by their first bits.
        self.bits = min(max(int(starts.size * 32).bit_length(), 12), 20)
        self.tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        #: A window agrees in a sample only if both its halves are some item's: small tables of halves rule out most windows before any sample is made.
        self.half_bits = min(max(int(starts.size * 16).bit_length(), 12), 18)
        self.sieves: list[list[np.ndarray]] = []
        for w in range(self.walks):
            emitted, within = embed(kinds, starts, w, self.steps, starts - self.offsets + self.chars)
            self.emitted.append((emitted >> np.uint32(24)).astype(np.uint8))
            self.within.append(within)
            tables, sieves = [], []
            parts = halves(emitted, self.coordinates[w])
            for places, h in zip(self.coordinates[w], parts, strict=True):
                sieve = np.zeros(1 << self.half_bits, np.uint8)
                sieve[h[within > places[-1]] >> np.uint32(32 - self.half_bits)] = 1
                sieves.append(sieve)
            self.sieves.append(sieves)
            for last, h in samples(parts, self.coordinates[w]):
                whole = np.flatnonzero(within > last)
                order = whole[np.argsort(h[whole], kind="stable")]
                maybe = np.zeros(1 << self.bits, bool)
                maybe[h[order] >> np.uint32(32 - self.bits)] = True
                tables.append((h[order], order, maybe))
            self.tables.append(tables)

    def agreeing(self, emitted: np.ndarray, walk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(window, entry)``: windows of a text, by what the walk emits from them, that are candidates for windows of items."""
        parts = halves(emitted, self.coordinates[walk])
        known = np.zeros(emitted.shape[1], np.uint8)
        for h, sieve in zip(parts, self.sieves[walk], strict=True):
            known += sieve.take(h >> np.uint32(32 - self.half_bits))
        left = np.flatnonzero(known > 1)
        parts = [h[left] for h in parts]
        for (_, h), (hashes, entries, maybe) in zip(samples(parts, self.coordinates[walk]), self.tables[walk], strict=True):
            hit = np.flatnonzero(maybe.take(h >> np.uint32(32 - self.bits)))
            if not len(hit):
                continue
            low, high = np.searchsorted(hashes, h[hit]), np.searchsorted(hashes, h[hit], "right")
            found = np.flatnonzero(high > low)
            hit, low, counts = left[hit[found]], low[found], (high - low)[found]
            done = np.cumsum(counts)
            a = 0
            while a < len(hit):  # bounded pieces, whatever is repeated
                b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + PAIRS, "right")))
                n = counts[a:b]
                window = np.repeat(hit[a:b], n)
                entry = entries[np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                same = (emitted[: self.steps, window] >> np.uint32(24)).astype(np.uint8) == self.emitted[walk][:, entry]
                within = self.within[walk][entry]
                same &= np.arange(self.steps)[:, None] < within
                near = same.sum(axis=0) >= self.agree * within
                yield window[near], entry[near]
                a = b


class ItemIndex:
    """A block of items: windows of each class, and the runs of the short ones in parts of bounded size."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        self.items: list[Item] = []
        plans: dict[int, list[list[tuple[int, Item]]]] = {}
        sizes: dict[int, int] = {}
        classes: list[list[tuple[int, Item]]] = [[] for _ in CLASSES]
        for i, t in items:
            raw = np.frombuffer(t.encode(), np.uint8)
            text = normalised(raw, np.array([0, len(raw)])).strip()
            n = len(text)
            if not n or n < LEAST_CHARS and len(text.split()) < 4:
                continue
            q, votes = short_plan(n, similarity)
            item = Item(i, text, edits := allowed(n, similarity), votes, places_of(text), grams_of(text), n - GRAM + 1 - edits * GRAM)
            if n >= SHORT:
                classes[max(k for k, (least, *_) in enumerate(CLASSES) if n >= least)].append((len(self.items), item))
            else:
                if q not in plans or sizes[q] + n > PART_RUNS:
                    plans.setdefault(q, []).append([])
                    sizes[q] = 0
                plans[q][-1].append((len(self.items), item))
                sizes[q] += n
            self.items.append(item)
        self.parts = [Part(x, q) for q, parts in plans.items() for x in parts]
        self.windows = [Windows(x, k) for k, x in enumerate(classes) if x]

    def spans(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """``(item, first, last)``: pieces of ``codes`` that may hold an item."""
        for part in self.parts:
            yield from part.spans(codes)
        if not self.windows:
            return
        steps = max(x.steps for x in self.windows)
        kinds, starts = _kinds(codes, steps), window_starts(codes)
        found: list[list[np.ndarray]] = [[] for _ in self.windows]
        for a in range(0, len(starts), WINDOWS):
            mine = starts[a : a + WINDOWS]
            piece = kinds[mine[0] : mine[-1] + steps]
            for walk in range(max(x.walks for x in self.windows)):
                emitted, _ = embed(piece, mine - mine[0], walk, max(x.steps for x in self.windows if walk < x.walks))
                for k, x in enumerate(self.windows):
                    for window, entry in x.agreeing(emitted, walk) if walk < x.walks else ():
                        if len(window):
                            # The item, where it would start, and the walk that says so; places before the text make no negative numbers.
                            begin = mine[window] - x.offsets[entry] + (1 << 20)
                            found[k].append(np.unique((((x.numbers[entry] << 40) + begin) << 3) + walk))
        for k, x in enumerate(self.windows):
            if found[k]:
                key = np.unique(np.concatenate(found[k])) >> 3
                number, begin = key >> 40, (key & ((1 << 40) - 1)) - (1 << 20)
                edits = np.array([self.items[i].edits for i in number])
                new = np.flatnonzero(np.concatenate([[True], (np.diff(number) > 0) | (np.diff(begin) > edits[1:])]))
                last = np.append(new[1:], len(key)) - 1
                enough = last - new + 1 >= x.votes
                new, last = new[enough], last[enough]
                chars = np.array([len(self.items[i].text) for i in number[new]], np.int64)
                yield np.stack([number[new], begin[new] - edits[new], begin[last] + chars + 2 * edits[new]])


def places_of(item: str) -> dict[str, int]:
    """For each character a number whose bits are its places in the item."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def grams_of(text: str) -> list[str]:
    """The runs of ``GRAM`` characters at all places."""
    return [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]


def may_hold(item: Item, text: str) -> bool:
    """Whether ``text`` has as many runs of the item as no allowed edits can take away: an edit takes ``GRAM`` of them at most."""
    return item.shared <= 0 or sum(map(set(grams_of(text)).__contains__, item.grams)) >= item.shared


def fit_distance(item: str, text: str, most: int, masks: dict[str, int] | None = None) -> int:
    """The least edit distance between ``item`` and any piece of ``text``, or ``most + 1`` if that is larger.

    Bit vectors over the item's characters (Myers); a column for each character of the text.
    """
    if item in text:
        return 0
    masks = masks or places_of(item)
    n, known = len(item), masks.get
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, n
    for at in range(0, len(text), 16):
        if score - (len(text) - at) > most and best > most:  # a column lowers the score by 1 at most
            return most + 1
        for c in text[at : at + 16]:
            eq = known(c, 0)
            same = eq | down
            zero = (((eq & up) + up) ^ up) | eq
            plus = down | ~(zero | up) & full
            minus = up & zero
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
                if score < best:
                    best = score
            plus = plus << 1 & full
            up = minus << 1 & full | ~(same | plus) & full
            down = plus & same
    return min(best, most + 1)


@dataclass(frozen=True)
class Leak:
    row: int
    item_id: int
    distance: int
    item_chars: int


def leaks(data: np.ndarray, offsets: np.ndarray, index: ItemIndex, first_only: bool) -> list[Leak]:
    """Items found in the texts ``data[offsets[i]:offsets[i + 1]]``; with ``first_only`` any one for each text."""
    text = normalised(data, offsets)
    codes = _codes(text)
    ends = np.flatnonzero(codes == 0x0A).tolist()
    best: dict[tuple[int, int], int] = {}
    done: set[int] = set()
    for k, first, last in (x for spans in index.spans(codes) for x in spans.T.tolist()):
        item = index.items[k]
        r = bisect.bisect_left(ends, first)
        while r < len(ends) and (begin := ends[r - 1] + 1 if r else 0) < last:
            if not (first_only and r in done or best.get((r, k)) == 0):
                piece = text[max(first, begin) : min(last, ends[r])]
                if may_hold(item, piece) and (distance := fit_distance(item.text, piece, item.edits, item.masks)) <= item.edits:
                    best[r, k] = min(distance, best.get((r, k), distance))
                    done.add(r)
            r += 1
    return [Leak(r, index.items[k].item_id, d, len(index.items[k].text)) for (r, k), d in sorted(best.items())]


def _blocks(benchmark: DataFrame, text: str, item_id: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, so that what is broadcast doesn't grow with the benchmark."""
    block, size = [], 0
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    for r in items.toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text: str = "text", row_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """``doc_id, item_id, distance, item_chars``: each benchmark item that a text holds, and how closely.

    Texts and items are compared as small words with single spaces. A text holds an item if some piece of it is within
    an edit distance of ``(1 - similarity)`` times the item's length. Items below ``SHORT`` characters are always found; longer ones are missed in few of
    a hundred cases where as many characters as allowed are changed at random (the README has the figures), more seldom where fewer are, never where none is. Items of fewer than
    four words and ``LEAST_CHARS`` characters would be found in any text and are never reported; null texts and items hold nothing; repeated rows are reported each; an empty
    table on either side gives no rows. Each block of items is one pass over the documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, distance int, item_chars int"
    found: DataFrame | None = None
    for n, block in enumerate(_blocks(benchmark, text, item_id)):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, similarity)
            for batch in batches:
                for row, data, offsets in text_slices(batch.column(1), SLICE):
                    out = leaks(data, offsets, index, False)
                    ids = batch.column(0).take(pa.array([row + x.row for x in out], pa.int64()))
                    numbers = [pa.array([getattr(x, c) for x in out], t) for c, t in (("item_id", pa.int64()), ("distance", pa.int32()), ("item_chars", pa.int32()))]
                    yield pa.RecordBatch.from_arrays([ids, *numbers], ["doc_id", "item_id", "distance", "item_chars"])

        each = map_arrow(rows, search, schema)
        found = each if n == 0 else (cut(found) if n == 1 else found).unionAll(cut(each))
    return found if found is not None else spark.createDataFrame([], schema)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``docs`` with all its columns without the rows whose text holds a benchmark item, as in ``find_leaks``.

    Rows with a null or empty text stay, and so does every row if there are no items; repeated rows stay or go alike; an empty table gives no rows.
    """
    place = docs.columns.index(text)
    for block in _blocks(benchmark, text, item_id):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, similarity)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, data, offsets in text_slices(batch.column(place), SLICE):
                    keep[[row + x.row for x in leaks(data, offsets, index, True)]] = False
                yield batch.filter(pa.array(keep))

        docs = map_arrow(docs, clean, docs.schema)
    return docs


ship_by_value(__name__)
