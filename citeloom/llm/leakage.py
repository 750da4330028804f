"""Evaluation passages that stand in a training corpus, whole or in part.

One Aho-Corasick automaton holds every run of SEED_WORDS words of the evaluation items (of SEED_LETTERS letters in
scripts without spaces). Texts are scanned once, as their letters and digits alone: case, punctuation, markup, blanks,
line breaks and hyphenation don't show. Around a hit the item is aligned with the text by banded dynamic programming; a
document leaks an item where a stretch of MIN_WORDS words has at most one edit in EDIT_EVERY words (letters: MIN_LETTERS,
LETTER_EVERY).

Why the seeds suffice: n >= 20 words with at most n/10 edits hold 6 words in a row without an edit (90 letters with 6: 12).
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, EDIT_EVERY, SEED_WORDS = 20, 10, 6
MIN_LETTERS, LETTER_EVERY, SEED_LETTERS = 90, 15, 12
#: Items of one automaton, in characters; more items are scanned for in further blocks.
BLOCK_CHARS = 8_000_000
#: Letters of the runs that the first look at unspaced text counts.
LETTER_GRAM = 4
#: Letters of text looked at beyond the item's own length for each edit; longer words end the stretch.
WORD_ROOM = 60

_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]{0,9}(?:\s[^<>]*)?/?>")
_DROP = re.compile(r"[^\w\sัิ-ฺ็-๎]+|_+")
_PIECE = re.compile(_TAG.pattern + r"|&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_UNSPACED = re.compile(r"[฀-๿]")


def words(text: str) -> list[str]:
    """The words of a text, each as its letters and digits, folded; markup parts words, a hyphen doesn't."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _DROP.sub("", text.lower()).split()


def letters(text: str) -> str:
    """The letters and digits of a text, folded; what the scan sees."""
    return "".join(words(text))


def offsets(text: str) -> tuple[str, list[int]]:
    """``letters(text)`` with the place in ``text`` that each of its characters comes from; for reports on single texts."""
    shown, places, at = [], [], 0
    for m in [*_PIECE.finditer(text), None]:
        for i in range(at, m.start() if m else len(text)):
            one = letters(text[i])
            shown.append(one)
            places += [i] * len(one)
        if m:
            one = "" if m.group().startswith("<") else letters(m.group())
            shown.append(one)
            places += [m.start()] * len(one)
            at = m.end()
    return "".join(shown), places


def word_ends(split: list[str]) -> list[int]:
    """Where words end among their letters."""
    return list(accumulate(map(len, split)))


@dataclass
class Item:
    item_id: int
    units: list[str]  # words, or single letters
    unspaced: bool
    text: str = ""
    starts: list[int] = field(default_factory=list)  # of the units in text
    grams: list[str] = field(default_factory=list)  # the runs of LETTER_GRAM letters, of unspaced items

    def __post_init__(self):
        at = 0
        for u in self.units:
            self.starts.append(at)
            at += len(u)
        self.text = "".join(self.units)
        if self.unspaced:
            self.grams = [self.text[i : i + LETTER_GRAM] for i in range(len(self.text) - LETTER_GRAM + 1)]

    def between(self, a: int, b: int) -> str:
        return self.text[self.starts[a] : self.starts[b] if b < len(self.units) else len(self.text)]


def make_item(item_id: int, text: str | None) -> Item | None:
    """None for null and blank items."""
    if not text or not letters(text):
        return None
    flat = letters(text)
    if len(_UNSPACED.findall(flat)) * 2 > len(flat):
        return Item(item_id, list(flat), True)
    return Item(item_id, words(text), False)


class Scanner:
    """The automaton over a block of items, and the check of its hits."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = [x for x in (make_item(i, t) for i, t in items) if x]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            size = SEED_LETTERS if item.unspaced else SEED_WORDS
            for at in range(len(item.units) - size + 1):
                places.setdefault(item.between(at, at + size), []).append((n, at))
        self.seeds = self._needed(places)
        self.automaton = ahocorasick.Automaton()
        for key, where in self.seeds.items():
            self.automaton.add_word(key, (len(key), where))
        if self.seeds:
            self.automaton.make_automaton()

    def _needed(self, places: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
        """The seeds without phrases that many items share, where that is safe: a stretch of words that leaks holds 3 seeds
        after all edits, so shared ones can go from an item as long as no window of it has as many of them. Of letters
        all are kept, since their hits are counted."""
        dropped: dict[int, set[int]] = {}
        out = {}
        for key, where in sorted(places.items(), key=lambda kv: -len(kv[1])):
            keep = []
            for n, at in where:
                gone, window = dropped.setdefault(n, set()), MIN_WORDS - SEED_WORDS
                if len(where) > 4 and not self.items[n].unspaced and sum(1 for x in range(at - window, at + window + 1) if x in gone) < 2:
                    gone.add(at)
                else:
                    keep.append((n, at))
            if keep:
                out[key] = keep
        return out

    def find(self, text: str | None) -> set[int]:
        """Ids of the items that ``text`` leaks; none for null and blank texts."""
        return {self.items[n].item_id for n in self.matches(text)} if text and self.seeds else set()

    def matches(self, text: str) -> dict[int, tuple[int, int, int, int]]:
        """Number of each leaked item in ``items`` -> (units, edits, first and last letter) of a stretch."""
        split = words(text)
        flat, ends = "".join(split), None
        around = Vicinity(flat)
        found: dict[int, tuple[int, int, int, int]] = {}
        tried: dict[tuple[int, int], int] = {}
        for start, n, at in self._hits(flat):
            if n in found:
                continue
            item = self.items[n]
            # On the diagonal of a hit that was tried, later hits inside its exact run would only repeat it.
            diagonal = (n, start - item.starts[at])
            if tried.get(diagonal, -1) >= at:
                continue
            if ends is None and not item.unspaced:
                ends = word_ends(split)
            if not around.plausible(item, at, start):
                run = at
                while run < len(item.units) and flat.startswith(item.units[run], start):
                    start += len(item.units[run])
                    run += 1
                tried[diagonal] = run
                continue
            stretch, tried[diagonal] = aligned(item, flat, at, start, None if item.unspaced else ends)
            if stretch:
                found[n] = stretch
        return found

    def _hits(self, flat: str) -> Iterator[tuple[int, int, int]]:
        """(place in the text, item, unit) of the seeds found. Of unspaced items only those that stand with as many others,
        on diagonals and at places as near to them, as a stretch that is equal enough must hold."""
        band, wide = (2 * MIN_LETTERS - 1) // LETTER_EVERY, 2 * MIN_LETTERS
        edits = MIN_LETTERS // LETTER_EVERY
        least = max(1, MIN_LETTERS - edits - (edits + 1) * (SEED_LETTERS - 1))
        near: dict[int, list[tuple[int, int]]] = {}
        items, step = self.items, band + 1
        for end, (size, where) in self.automaton.iter(flat):
            start = end - size + 1
            for n, at in where:
                if not items[n].unspaced:
                    yield start, n, at
                    continue
                zone = (n << 40) + (start - at) // step
                if zone in near:
                    near[zone].append((start, at))
                else:
                    near[zone] = [(start, at)]
        for zone, hits in near.items():
            more = near.get(zone + 1)
            if len(hits) + (len(more) if more else 0) < least:
                continue
            hits, n, last = sorted(hits + more) if more else hits, (zone + (1 << 39)) >> 40, -1
            for i in range(len(hits) - least + 1):
                if hits[i + least - 1][0] - hits[i][0] <= wide + band:
                    for j in range(max(last + 1, i), i + least):
                        yield hits[j][0], n, hits[j][1]
                    last = i + least - 1


class Vicinity:
    """Whether enough of an item stands anywhere near a place of one text; where not, no stretch through a seed there can be
    equal enough. A window of the least length inside the stretch has at most all its edits (``most``); each spoils one
    word, or LETTER_GRAM of the runs of as many letters."""

    def __init__(self, flat: str):
        self.flat = flat
        self.grams: dict[int, set[str]] = {}

    def plausible(self, item: Item, at: int, start: int) -> bool:
        least, every = (MIN_LETTERS, LETTER_EVERY) if item.unspaced else (MIN_WORDS, EDIT_EVERY)
        most = (2 * least - 1) // every
        lo, hi = max(0, at - least), min(len(item.units), at + least)
        if hi - lo < least:
            return False
        if item.unspaced:
            size, need = least - LETTER_GRAM + 1, least - LETTER_GRAM + 1 - most * LETTER_GRAM
            seen = list(map(self._near(start // least, least, most).__contains__, item.grams[lo : hi - LETTER_GRAM + 1]))
        else:
            size, need, room = least, least - most, most * WORD_ROOM
            near = self.flat[max(0, start - (item.starts[at] - item.starts[lo]) - room) : start + len(item.between(at, hi)) + room]
            seen = [u in near for u in item.units[lo:hi]]
        if sum(seen) < need:
            return False
        sums = [0, *accumulate(seen)]
        return any(b - a >= need for a, b in zip(sums, sums[size:]))

    def _near(self, block: int, least: int, most: int) -> set[str]:
        """The runs of letters around a block of the text."""
        if block not in self.grams:
            near = self.flat[max(0, (block - 1) * least - most) : (block + 2) * least + most]
            self.grams[block] = {near[i : i + LETTER_GRAM] for i in range(len(near) - LETTER_GRAM + 1)}
        return self.grams[block]


def extensions(units: list[str], flat: str, ends: list[int] | None, edits: int) -> list[tuple[int, int]]:
    """By number of edits, up to ``edits``: (most units of the item covered from its start on, letters of ``flat`` used),
    the last unit covered being one that agrees.

    Dynamic programming in a band, one edit after the other: of the states with equally many units left out and text words
    left out only the one that got farthest goes on. Equal units are passed at once; then a unit is left out, a word of
    the text is, or one is taken for the other. ``ends``: where the words of ``flat`` end (None: everywhere); a unit may
    agree across them, so broken and hyphenated words are no edits."""
    out, best = [], (0, 0)
    many, size, whole = len(units), len(flat), frozenset(ends or ())
    states: dict[tuple[int, bool], tuple[int, int]] = {(0, True): (0, 0)}
    for e in range(edits + 1):
        reached: dict[tuple[int, bool], tuple[int, int]] = {}
        for (shift, _), (k, p) in states.items():
            at = k
            even = (k, p) if ends is None or p in whole or not p else None
            while k < many and flat.startswith(units[k], p):
                p += len(units[k])
                k += 1
                if p in whole:
                    even = (k, p)
            if k > at and k > best[0]:
                best = (k, p)
            # A match may end inside a word of the text by chance, so the last one that didn't goes on beside it.
            for key, state in (((shift, True), even), ((shift, False), None if even == (k, p) or ends is None else (k, p))):
                if state and (key not in reached or reached[key] < state):
                    reached[key] = state
            if ends is None and reached[shift, True] < (k, p):
                reached[shift, True] = (k, p)
        out.append(best)
        if e == edits:
            break
        states = {}
        for (shift, _), (k, p) in reached.items():
            if ends is None:
                after = p + 1 if p < size else None
            else:
                i = bisect_right(ends, p)
                after = ends[i] if i < len(ends) else None
            steps = []
            if k < many:
                steps.append(((shift - 1, p in whole or ends is None), k + 1, p))
                if after is not None:
                    steps.append(((shift, True), k + 1, after))
            if after is not None:
                steps.append(((shift + 1, True), k, after))
            for d, k2, p2 in steps:
                if d not in states or states[d] < (k2, p2):
                    states[d] = (k2, p2)
    return out


def aligned(item: Item, flat: str, at: int, start: int, ends: list[int] | None) -> tuple[tuple[int, int, int, int] | None, int]:
    """(units, edits, first and last letter) of a stretch through the seed at unit ``at`` of the item and ``start`` of the
    text that is long and equal enough, None if there is none; and the end of the seed's exact run. Edits next to each other and of words of any length count
    alike, and so do those at the stretch's ends.

    A stretch of twice the least length or more could be cut in two of which one is equal enough, too, so looking at
    shorter ones is enough; they have at most (2 * least - 1) / every edits."""
    least, every = (MIN_LETTERS, LETTER_EVERY) if item.unspaced else (MIN_WORDS, EDIT_EVERY)
    most = (2 * least - 1) // every
    wide = 2 * least
    right_units, back = item.units[at : at + wide], [u[::-1] for u in item.units[max(0, at - wide) : at][::-1]]
    spare = (most + 1) * (1 if item.unspaced else WORD_ROOM)
    ahead = flat[start : start + sum(map(len, right_units)) + spare]
    behind = flat[max(0, start - sum(map(len, back)) - spare) : start][::-1]
    ends_ahead = ends_behind = None
    if ends is not None:
        i = bisect_right(ends, start)
        ends_ahead = [x - start for x in ends[i : i + 2 * wide] if x - start <= len(ahead)]
        j = bisect_left(ends, start)
        ends_behind = [start - x for x in reversed(ends[max(0, j - 2 * wide) : j]) if start - x <= len(behind)]
        if len(ends_behind) < 2 * wide and len(behind) == start:
            ends_behind.append(start)
    run = 0
    for budget in (0, most // 3, most):
        right = extensions(right_units, ahead, ends_ahead, budget)
        left = extensions(back, behind, ends_behind, budget)
        run = run or at + right[0][0]
        for ea, (a, pa) in enumerate(left):
            for eb, (b, pb) in enumerate(right):
                # Units at the stretch's ends may be the changed ones.
                outer = max(0, least - a - b)
                if outer <= len(item.units) - a - b and (ea + eb + outer) * every <= a + b + outer:
                    return (a + b + outer, ea + eb + outer, start - pa, start + pb), run
        # Of the runs of a stretch that's equal enough, some seed has as much of it nearby.
        if budget and left[-1][0] + right[-1][0] < least * 2 // 5:
            break
    return None, run


def blocks(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of BLOCK_CHARS characters; the driver holds one block at a time."""
    block, size = [], 0
    for row in items.select(F.col(key).cast("long"), F.col(text)).where(F.col(text).isNotNull()).orderBy(key).toLocalIterator():
        if block and size + len(row[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


@lru_cache(maxsize=1)
def _scanner(block: tuple[tuple[int, str], ...]) -> Scanner:
    """The last block's scanner, kept by a worker from task to task."""
    return Scanner(list(block))


def _scan(shared, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared.value)
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = scanner.matches(text) if text and scanner.seeds else {}
                where = offsets(text)[1] if places and found else []
                for n, (_, _, a, b) in sorted(found.items()):
                    place = (where[min(a, len(where) - 1)], where[min(b, len(where)) - 1] + 1) if places else ()
                    rows.append((key, scanner.items[n].item_id, *place))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4 if places else 2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "first", "last"][: len(columns)])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, places: bool = False) -> DataFrame:
    """doc_id, item_id of every document that holds a stretch of an item; with ``places`` also where one such stretch begins
    and ends in the text as it stands (first, last: code points from 0, the end excluded). Null and blank texts and items
    match nothing; an empty item table gives no rows. One narrow scan of the corpus for each block of items."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull())
    shape = "doc_id long, item_id long" + (", first long, last long" if places else "")
    out = None
    for block in blocks(items):
        part = texts.mapInArrow(_scan(spark.sparkContext.broadcast(tuple(block)), places), shape)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], shape)
    return out.dropDuplicates(["doc_id", "item_id"])
