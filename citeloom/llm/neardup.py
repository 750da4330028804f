"""Groups of records that share their two texts but for small edits, through BK-trees over Hamming distance.

Texts are folded (case, punctuation, spacing) and exact copies made one. A shard is the set of texts with the same shard
key, and the keys are chosen so that no pair can be missed:

* Of texts of words the keys are pairs of neighbouring words. An edit spoils two of them and a moved sentence one at each
  of its ends, so a text shares at least a known number of its pairs with every text that agrees with it; the rarest
  pairs, as many as are needed for one of those to be among them, are its keys (prefix filtering).
* Of texts in scripts without spaces the keys are the rarest runs of GRAM letters of each window of WINDOW runs next to each
  other: texts that share GRAM + WINDOW - 1 letters in a row have a key in common.

"Rare" is read from counters of a fixed number that all keys share; they set the order alone, so that collisions cost time
and no pairs. In a large shard the texts' fingerprints (256 bits, of letters 512) form a BK-tree, whose children are keyed by their
Hamming distance to the parent, and a search follows only edges within the radius; smaller ones are compared as they are. For words a bit of the fingerprint is the
parity of the words hashed to it: each word that two texts don't share changes one bit at most, so the radius follows from
the agreement demanded and loses nothing. What the trees return is checked by the texts' words (letters).

Keys and fingerprints are shuffled as arrays, one row for each slice of texts and part of the keys. A shard that may have more
than BUCKET texts, by its key's counter, is split into blocks, and each pair of blocks is a shard of its own: nothing is cut off
and no comparison takes more than two blocks. Fingerprints and links never go to the driver.

Pairs of records follow from linked texts: the two texts of a record are an unordered pair, so exchanged roles show, too.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.plans.components import connected_components
from citeloom.session import cut_lineage

#: Least share of the words (letters) of each text that agree.
AGREEMENT = 0.75
#: Letters of a run, and runs of a window, in scripts without spaces.
GRAM, WINDOW = 12, 4
#: Word pairs that moved sentences may spoil.
MOVES = 4
#: Integers of 64 bits of a fingerprint of words, and of letters.
WORD_WIDTH, LETTER_WIDTH = 4, 8
#: Least share of pairs of letters that agreeing texts have in common, and the most counts that pairs of texts are checked with at once.
LETTERS_COMMON, COUNTS = 0.55, 1 << 25
#: Most differing bits of two fingerprints of letters; these are the signs of summed hashes, which bound nothing: of texts of
#: 280 letters 1 in 100 pairs lies beyond it with 15 % of the letters changed at random, half of them with 20 %.
LETTER_RADIUS = 172
#: Texts of a block of a shard, and shared counters.
BUCKET, SLOTS = 20_000, 1 << 18
#: Leaves of trees up to this size are compared as they are.
LEAF = 32
#: Shards up to SMALL are compared many at once, those up to LARGE as they are, larger ones by trees.
SMALL, LARGE = 64, 4096
#: Texts signed at once, keys of a part, and comparisons at once (what fits a processor's cache).
SLICE, PART, TILE = 1 << 14, 2_000_000, 1 << 16
#: Rows in which the tasks' counters are added up.
CHUNKS = 8

_THAI = re.compile(r"[฀-๿]")
_WORD = re.compile(r"[^\W_]+(?:[ัิ-ฺ็-๎]+[^\W_]*)*")

def fold(text: str | None) -> str:
    """The words of a text, case folded, joined by blanks; in scripts without spaces its letters. Empty for null, blank
    and wordless texts."""
    if not text:
        return ""
    s = unicodedata.normalize("NFKC", text).lower()
    words = _WORD.findall(s)
    joined = "".join(words)
    return joined if len(_THAI.findall(joined)) * 2 > len(joined) else " ".join(words)


def units(folded: str) -> list[str]:
    """What is compared: words, or pairs of neighbouring letters."""
    if " " not in folded and _THAI.search(folded):
        return [folded[i : i + 2] for i in range(len(folded) - 1)] or [folded]
    return folded.split(" ")


def agreement(a: str, b: str) -> float:
    """The share of the longer text's words that the other has, too, whatever their order. In scripts without spaces
    pairs of letters are counted; an edit of one letter breaks two of them, so the share lost is halved."""
    x, y = units(a), units(b)
    longer = max(len(x), len(y))
    if min(len(x), len(y)) < AGREEMENT * longer:
        return 0.0
    common = sum((Counter(x) & Counter(y)).values()) / longer
    return common if " " in a or not _THAI.search(a) else 1 - (1 - common) / 2 if common >= LETTERS_COMMON else common / 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _windows(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` values; of all values, if they are fewer."""
    size = min(size, len(values))
    out = np.zeros(len(values) - size + 1, np.uint64)
    for k in range(size):
        out = out * _STEP + values[k : k + len(out)]
    return _mix(out)


def shard_candidates(folded: str) -> np.ndarray:
    """Hashes of all that may become a shard key: word pairs (repeated ones told apart), or runs of letters."""
    if unspaced(folded):
        with np.errstate(over="ignore"):
            return _mix(_windows(_letters(folded), GRAM) + np.uint64(1))
    return _pair_keys(*_tokens(pa.array([folded])))[0]


def _pair_keys(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word pairs of many texts (a text of one word has that one) as keys, and the place of the text of each, in order."""
    with np.errstate(over="ignore"):
        ends, text, pairs = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes), words.copy()
        pairs[:-1] = pairs[:-1] * _STEP + words[1:]
        single, keep = ends[sizes == 1] - 1, np.ones(len(words), bool)
        pairs[single] = words[single]
        keep[ends - 1] = sizes == 1
        pairs, text = _mix(pairs[keep]), text[keep]
        pairs = pairs[np.lexsort((pairs, text))]
        # The i-th of equal pairs is a key of its own, so that pairs count as often as they stand.
        start = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (text[1:] != text[:-1])]))
        nth = np.arange(len(pairs)) - np.repeat(start, np.diff(np.append(start, len(pairs))))
        return _mix(pairs + nth.astype(np.uint64) * _STEP), text


def unspaced(folded: str) -> bool:
    return " " not in folded and bool(_THAI.search(folded))


def _letters(folded: str) -> np.ndarray:
    return _mix(np.frombuffer(folded.encode("utf-32-le"), np.uint32).astype(np.uint64))


def _tokens(folded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and the number of words of each."""
    split = pc.split_pattern(folded, " ")
    words = split.flatten().dictionary_encode()
    hashes = _mix(np.array([zlib.crc32(w.encode()) | len(w) << 32 for w in words.dictionary.to_pylist()], np.uint64))
    return hashes[words.indices.to_numpy()], pc.list_value_length(split).to_numpy().astype(np.int64)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % SLOTS


def shard_keys(folded: str, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard keys of a folded text that isn't empty, and how many texts at most hold each."""
    if not unspaced(folded):
        return _word_shard_keys(*_tokens(pa.array([folded])), counters)[:2]
    with np.errstate(over="ignore"):
        runs = shard_candidates(folded)
        order = counters[_slots(runs)].astype(np.uint64) << np.uint64(32) | runs & np.uint64(0xFFFFFFFF)
        w = min(WINDOW, len(runs))
        keys = np.unique(runs[np.argmin(np.lib.stride_tricks.sliding_window_view(order, w), 1) + np.arange(len(runs) - w + 1)])
        return keys, counters[_slots(keys)]


def _word_shard_keys(words: np.ndarray, sizes: np.ndarray, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shard keys of many texts of words, how many texts at most hold each, and the place of its text."""
    keys, text = _pair_keys(words, sizes)
    most = counters[_slots(keys)]
    order = np.lexsort((keys, most, text))
    keys, most, n = keys[order], most[order], np.maximum(sizes - 1, 1)
    # Up to a quarter of the longer text's words may differ; of this text's pairs that spoils half at most.
    shared = np.maximum(1, n - 2 * (sizes // 4) - MOVES)
    keep = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(n - shared + 1, n)
    return keys[keep], most[keep], text[keep]


def fingerprint(folded: str) -> np.ndarray:
    """WORD_WIDTH integers: the parities of the words hashed to each bit; LETTER_WIDTH of texts of letters: the signs of the
    summed hashes of runs of three and four."""
    if not unspaced(folded):
        return _word_prints(*_tokens(pa.array([folded])))[0]
    with np.errstate(over="ignore"):
        values = _letters(folded)
        runs = np.concatenate([_windows(values, 3), _windows(values, 4)])
        wide = np.stack([_mix(runs ^ np.uint64(7919 * j)) for j in range(LETTER_WIDTH)], axis=1)
        bits = np.unpackbits(wide.view(np.uint8).reshape(len(runs), 8 * LETTER_WIDTH), axis=1)
        ones = sum(bits[lo : lo + 255].sum(0, dtype=np.uint8).astype(np.int64) for lo in range(0, len(runs), 255))
        return np.packbits(ones * 2 > len(runs)).view(np.uint64)


def _word_prints(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    bits = 64 * WORD_WIDTH
    place = np.repeat(np.arange(len(sizes)) * bits, sizes) + ((words >> np.uint64(7)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(place, minlength=len(sizes) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sizes), bits), axis=1).view(np.uint64)


def radius_of(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most differing bits of two texts that may agree, by their sizes (words; letters as negative numbers)."""
    longer, shorter = np.maximum(np.abs(n), np.abs(m)), np.minimum(np.abs(n), np.abs(m))
    most = longer + shorter - 2 * np.ceil(AGREEMENT * longer).astype(np.int64)
    return np.where((n > 0) != (m > 0), -1, np.where(shorter < AGREEMENT * longer, -1, np.where(n > 0, most, LETTER_RADIUS)))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (last axis: their integers)."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``distance``, of arrays whose first axis is the integers: in the least type that holds it."""
    kind = np.uint8 if len(a) < 4 else np.uint16
    out = np.bitwise_count(a[0] ^ b[0]).astype(kind, copy=False)
    for x, y in zip(a[1:], b[1:]):
        out += np.bitwise_count(x ^ y)
    return out


def _near(a: np.ndarray, b: np.ndarray, most: np.ndarray, upper: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (first axis: the integers) of pairs that differ in at most ``most`` (by a) bits; ``upper``:
    of pairs of the same array, the first place before the second."""
    left, right, step = [], [], max(1, TILE // max(1, b.shape[1]))
    for lo in range(0, a.shape[1], step):
        first = lo if upper else 0
        at = np.flatnonzero(_differing(a[:, lo : lo + step, None], b[:, None, first:]) <= most[lo : lo + step, None])
        left.append(at // (b.shape[1] - first) + lo)
        right.append(at % (b.shape[1] - first) + first)
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    return (i[i < j], j[i < j]) if upper else (i, j)


class BKTree:
    """Fingerprints by Hamming distance: the first one is the root, its children are keyed by their distance to it. Up to
    ``leaf`` of them stay a leaf. Searches go down for many fingerprints at once."""

    def __init__(self, prints: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF):
        self.prints, self.rows = prints, np.arange(len(prints)) if rows is None else rows
        self.children: dict[int, BKTree] = {}
        if len(prints) > leaf:
            d = distance(prints[1:], prints[0])
            order = np.argsort(d, kind="stable")
            edges = np.flatnonzero(np.diff(d[order])) + 1
            parts = np.split(order, edges)
            if len(parts) > 1 or d[0] > 0:
                self.children = {int(d[part[0]]): BKTree(prints[1:][part], self.rows[1:][part], leaf) for part in parts}
                self.prints, self.rows = prints[:1], self.rows[:1]

    def join(self, queries: np.ndarray, radius: np.ndarray, at: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places of queries, rows) of all fingerprints within each query's own radius."""
        at = np.arange(len(queries)) if at is None else at
        i, j = _near(np.ascontiguousarray(queries[at].T), np.ascontiguousarray(self.prints.T), radius[at])
        out = [(at[i], self.rows[j])]
        d = distance(queries[at], self.prints[0]) if self.children else at
        for key, child in self.children.items():
            near = at[np.abs(d - key) <= radius[at]]
            if len(near):
                out += child.join(queries, radius, near)
        return out


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [fold(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["raw", "folded"])


def _is_letters(folded: pa.Array) -> pa.Array:
    """As ``unspaced``, of many texts."""
    return pc.and_(pc.invert(pc.match_substring(folded, " ")), pc.match_substring_regex(folded, "[\u0e00-\u0e7f]"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters = np.zeros(SLOTS, np.int64)
    for batch in batches:
        letters = _is_letters(batch.column(0))
        words = batch.column(0).filter(pc.invert(letters))
        found = [shard_candidates(t) for t in batch.column(0).filter(letters).to_pylist()]
        found += [_pair_keys(*_tokens(words.slice(lo, SLICE)))[0] for lo in range(0, len(words), SLICE)]
        for keys in found:
            if len(keys) > SLOTS // 8:
                counters += np.bincount(_slots(keys), minlength=SLOTS)
            else:
                np.add.at(counters, _slots(keys), 1)
    chunks = counters.reshape(CHUNKS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())], names=["chunk", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["chunk", "counts"])


def shared_counters(texts: DataFrame) -> np.ndarray:
    """The counters of all shard key candidates: SLOTS numbers, whatever the size of the corpus."""
    rows = texts.select("folded").mapInArrow(_count, "chunk int, counts binary").repartitionById(CHUNKS, "chunk").mapInArrow(_add, "chunk int, counts binary").collect()
    counters = np.zeros((CHUNKS, SLOTS // CHUNKS), np.int64)
    for chunk, counts in rows:
        counters[chunk] = np.frombuffer(counts, np.int64)
    return counters.reshape(-1)


def _keys_of(folded: pa.Array, letters: bool, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shard keys of texts, how many texts at most hold each, the place of its text; sizes and fingerprints by text."""
    if not letters:
        words, sizes = _tokens(folded)
        return *_word_shard_keys(words, sizes, counters), sizes, _word_prints(words, sizes)
    texts = folded.to_pylist()
    own = [shard_keys(t, counters) for t in texts]
    text = np.repeat(np.arange(len(own)), [len(k) for k, _ in own])
    return np.concatenate([k for k, _ in own]), np.concatenate([m for _, m in own]), text, np.array([-len(t) for t in texts]), np.stack([fingerprint(t) for t in texts])


def _cells(keys: np.ndarray, blocks: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shards of more texts than a block holds: each pair of blocks is a cell. The key of each row's own cell; and the rows,
    keys and sides of the cells it shares with another block."""
    with np.errstate(over="ignore"):
        at = np.flatnonzero(blocks > 1)
        diagonal = keys.copy()
        diagonal[at] = _mix(keys[at] + (own[at] + 1).astype(np.uint64) * _STEP)
        rows = np.repeat(at, blocks[at])
        j = np.arange(len(rows)) - np.repeat(np.cumsum(blocks[at]) - blocks[at], blocks[at])
        rows, j = rows[j != own[rows]], j[j != own[rows]]
        cell = np.minimum(own[rows], j) * blocks[rows] + np.maximum(own[rows], j)
        return diagonal, rows, _mix(keys[rows] ^ _mix((cell + 1).astype(np.uint64))), (own[rows] > j).astype(np.uint16)


_SIGNED = "part int, ids binary, sizes binary, prints binary, keys binary, at binary"


def _sign(shared, letters: bool, parts: int, bucket: int):
    """text, folded -> one row for each part that keys of a slice of texts fall into: the texts' ids, sizes and fingerprints,
    and of each key its last 32 bits and the place of its text. Keys that differ before those meet in the same shard now and
    then, which costs comparisons alone. Parts from ``parts`` on hold the cells of two blocks; there the 16th bit is the side."""

    def rows(batch: pa.RecordBatch, counters: np.ndarray) -> Iterator[tuple]:
        ids = batch.column(0).to_numpy()
        keys, most, text, sizes, prints = _keys_of(batch.column(1), letters, counters)
        blocks = -(-most // bucket)
        own = np.where(blocks > 1, ids[text] % np.maximum(blocks, 1), 0)
        keys, across, others, side = _cells(keys, blocks, own)
        part = np.concatenate([(keys >> np.uint64(32)) % np.uint64(parts), (others >> np.uint64(32)) % np.uint64(parts) + np.uint64(parts)])
        short = np.concatenate([keys, others]) & np.uint64(0xFFFFFFFF)
        at = np.concatenate([text.astype(np.uint16), text[across].astype(np.uint16) | side << np.uint16(15)])
        order = np.argsort(part << np.uint64(32) | short)
        part, short, at = part[order], short[order].astype(np.uint32), at[order]
        edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]).tolist()
        for lo, hi in zip(edges, edges[1:]):
            used, place = np.unique(at[lo:hi] & 0x7FFF, return_inverse=True)
            place = place.astype(np.uint16) | at[lo:hi] & np.uint16(0x8000)
            yield int(part[lo]), ids[used].tobytes(), sizes[used].astype(np.int32).tobytes(), prints[used].tobytes(), short[lo:hi].tobytes(), place.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                out = list(zip(*rows(batch.slice(lo, SLICE), shared.value)))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], names=["part", "ids", "sizes", "prints", "keys", "at"])

    return run


def _part_candidates(key: np.ndarray, at: np.ndarray, side: np.ndarray, sizes: np.ndarray, prints: np.ndarray, across: bool) -> np.ndarray:
    """Pairs of places of texts that share a key and whose fingerprints may belong to texts that agree, each once."""
    order = np.argsort(key, kind="stable")
    key, at, side = key[order], at[order], side[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    lengths = np.diff(np.append(starts, len(key)))
    # No partner of a text may differ in more bits than one as long as itself. Halves of parity fingerprints laid upon each
    # other are the fingerprint of half the width.
    columns = np.ascontiguousarray((prints[:, :2] ^ prints[:, 2:] if sizes[0] > 0 else prints).T)
    most = np.minimum(radius_of(sizes, sizes), 64 * len(columns)).astype(np.uint8 if len(columns) < 4 else np.uint16)
    found: list[np.ndarray] = []
    fresh = 0

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal fresh
        ok = (a != b) & (distance(prints[a], prints[b]) <= radius_of(sizes[a], sizes[b]))
        a, b = a[ok], b[ok]
        found.append(np.minimum(a, b) << 32 | np.maximum(a, b))
        fresh += len(a)
        if fresh > 1 << 22:
            found[:], fresh = [np.unique(np.concatenate(found))], 0

    if not across:
        for n in np.unique(lengths[(lengths > 1) & (lengths <= SMALL)]).tolist():
            later, per = np.triu(np.ones((n, n), bool), 1), max(1, TILE // (n * n))
            own = starts[lengths == n]
            for lo in range(0, len(own), per):
                t = at[own[lo : lo + per, None] + np.arange(n)]
                x = columns[:, t]
                g, ij = np.divmod(np.flatnonzero((_differing(x[:, :, :, None], x[:, :, None, :]) <= most[t][:, :, None]) & later), n * n)
                keep(t[g, ij // n], t[g, ij % n])
    for lo, n in zip(starts[lengths > (1 if across else SMALL)].tolist(), lengths[lengths > (1 if across else SMALL)].tolist()):
        t = at[lo : lo + n]
        inner, outer = (t[side[lo : lo + n] == 0], t[side[lo : lo + n] == 1]) if across else (t, t)
        if not len(inner) or not len(outer):
            continue
        if len(inner) > LARGE:
            pairs = BKTree(columns[:, inner].T, leaf=LARGE).join(columns[:, outer].T, most[outer].astype(np.int64))
            i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            keep(outer[i], inner[j]) if across else keep(outer[i[i < j]], inner[j[i < j]])
        else:
            i, j = _near(columns[:, outer], columns[:, inner], most[outer], upper=not across)
            keep(outer[i], inner[j])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _search(width: int, parts: int):
    """Rows of ``_sign``, a part's rows in one task -> candidate pairs of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[list[np.ndarray]]] = {}
        kinds = (np.int64, np.int32, np.uint64, np.uint32, np.uint16)
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                rows.setdefault(part, []).append([np.frombuffer(batch.column(c + 1)[i].as_buffer(), kind) for c, kind in enumerate(kinds)])
        for part in list(rows):
            pieces = rows.pop(part)
            ids, sizes, prints, key, at = (np.concatenate([p[c] for p in pieces]) for c in range(5))
            first = np.cumsum([0, *[len(p[0]) for p in pieces[:-1]]])
            side = (at >> np.uint16(15)).astype(np.uint8)
            at = (at & np.uint16(0x7FFF)).astype(np.int64) + np.repeat(first, [len(p[3]) for p in pieces])
            both = _part_candidates(key, at, side, sizes.astype(np.int64), prints.reshape(-1, width), part >= parts)
            a, b = ids[both >> 32], ids[both & 0xFFFFFFFF]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def letter_agreements(x: list[str], y: list[str]) -> np.ndarray:
    """``agreement`` of pairs of texts of at least two letters: each distinct text's pairs of letters are counted once."""
    place = {t: i for i, t in enumerate(dict.fromkeys(x + y))}
    values = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in place]
    n = np.array([len(v) - 1 for v in values])
    kinds, at = np.unique(np.concatenate([v[:-1] << 21 | v[1:] for v in values]), return_inverse=True)
    if len(kinds) * len(place) > COUNTS:
        half = len(x) // 2
        return np.concatenate([letter_agreements(x[:half], y[:half]), letter_agreements(x[half:], y[half:])]) if half else np.array([agreement(*p) for p in zip(x, y)])
    counts = np.bincount(np.repeat(np.arange(len(n)) * len(kinds), n) + at, minlength=len(n) * len(kinds)).reshape(len(n), len(kinds))
    counts = counts.astype(np.uint8 if counts.max() < 256 else np.int32)
    a, b = np.array([place[t] for t in x]), np.array([place[t] for t in y])
    shared = np.concatenate([np.minimum(counts[a[i : i + 256]], counts[b[i : i + 256]]).sum(1, dtype=np.int64) for i in range(0, len(a), 256)])
    longer, shorter = np.maximum(n[a], n[b]), np.minimum(n[a], n[b])
    common = shared / longer
    return np.where(shorter < AGREEMENT * longer, 0.0, np.where(common >= LETTERS_COMMON, 1 - (1 - common) / 2, common / 2))


def _check(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            letters = _is_letters(batch.column(2)).to_numpy(zero_copy_only=False) & _is_letters(batch.column(3)).to_numpy(zero_copy_only=False)
            letters &= (pc.utf8_length(batch.column(2)).to_numpy() > 1) & (pc.utf8_length(batch.column(3)).to_numpy() > 1)
            keep, at = np.zeros(len(x), bool), np.flatnonzero(letters)
            if len(at):
                keep[at] = letter_agreements([x[i] for i in at], [y[i] for i in at]) >= threshold
            for i in np.flatnonzero(~letters):
                keep[i] = agreement(x[i], y[i]) >= threshold
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def fold_texts(raw: DataFrame) -> DataFrame:
    """raw, text (64-bit id of the folded text), folded of every distinct value of the column ``raw`` that has words."""
    folded = raw.select("raw").where(F.col("raw").isNotNull()).distinct().select("raw", F.col("raw").alias("r2")).mapInArrow(_fold_rows, "raw string, folded string")
    return folded.where(F.col("folded") != "").select("raw", F.xxhash64("folded").alias("text"), "folded")


def _candidates(texts: DataFrame, shared, letters: bool, parts: int, bucket: int) -> DataFrame:
    signed = texts.select("text", "folded").mapInArrow(_sign(shared, letters, parts, bucket), _SIGNED)
    split = bool((shared.value > bucket).any())
    return signed.repartitionById(parts * (1 + split), "part").mapInArrow(_search(LETTER_WIDTH if letters else WORD_WIDTH, parts), "a long, b long")


def linked_texts(texts: DataFrame, threshold: float = AGREEMENT, bucket: int = BUCKET) -> DataFrame:
    """a, b (a < b): the distinct folded texts that agree. texts: text, folded.

    How many blocks of ``bucket`` texts a shard has follows from its key's counter, which all tasks know."""
    one = cut_lineage(texts.groupBy("text").agg(F.first("folded").alias("folded")))
    counters = shared_counters(one)
    shared = texts.sparkSession.sparkContext.broadcast(counters)
    parts = max(2 * texts.sparkSession.sparkContext.defaultParallelism, -(-int(counters.sum()) // PART))
    letters = ~F.contains("folded", F.lit(" ")) & F.col("folded").rlike(_THAI.pattern)
    found = _candidates(one.where(~letters), shared, False, parts, bucket).unionByName(_candidates(one.where(letters), shared, True, parts, bucket)).distinct()
    left = one.select(F.col("text").alias("a"), F.col("folded").alias("x"))
    right = one.select(F.col("text").alias("b"), F.col("folded").alias("y"))
    return found.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_check(threshold), "a long, b long")


def record_classes(records: DataFrame, key: str, one: str, other: str) -> tuple[DataFrame, DataFrame]:
    """(key, lo, hi): each record's unordered pair of text ids, once per key; and the texts (text, folded). Records of
    which a text is null, blank or wordless have no class. Of rows with the same key the least pair of texts counts."""
    first = records.groupBy(key).agg(F.min(F.struct(F.col(one).alias("s"), F.col(other).alias("t"))).alias("r"))
    rows = first.select(F.col(key).alias("id"), F.col("r.s").alias("s"), F.col("r.t").alias("t")).where(F.col("s").isNotNull() & F.col("t").isNotNull() & F.col("id").isNotNull())
    texts = fold_texts(rows.select(F.explode(F.array("s", "t")).alias("raw")))
    names = texts.select("raw", "text")
    both = rows.join(names.select(F.col("raw").alias("s"), F.col("text").alias("x")), "s").join(names.select(F.col("raw").alias("t"), F.col("text").alias("y")), "t")
    return both.select("id", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")), texts.select("text", "folded").distinct()


def linked_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """lo, hi, lo2, hi2: different classes whose texts agree one to one, each pair once, the lesser class first."""
    near = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    classes = members.select("lo", "hi").distinct()
    touched = near.select("a").distinct()
    # Only classes with a linked text have partners; a text is next to itself, too.
    some = classes.join(touched.withColumnRenamed("a", "lo"), "lo", "left_semi").unionByName(classes.join(touched.withColumnRenamed("a", "hi"), "hi", "left_semi")).distinct()
    wide = near.unionByName(touched.select("a", F.col("a").alias("b")))
    of_lo = wide.select(F.col("a").alias("lo"), F.col("b").alias("p"))
    of_hi = wide.select(F.col("a").alias("hi"), F.col("b").alias("q"))
    grown = some.join(of_lo, "lo", "left").join(of_hi, "hi", "left")
    p, q = F.coalesce("p", "lo"), F.coalesce("q", "hi")
    grown = grown.select("lo", "hi", F.least(p, q).alias("lo2"), F.greatest(p, q).alias("hi2")).where(F.struct("lo", "hi") < F.struct("lo2", "hi2"))
    return grown.join(classes.withColumnsRenamed({"lo": "lo2", "hi": "hi2"}), ["lo2", "hi2"], "left_semi").select("lo", "hi", "lo2", "hi2").distinct()


def near_duplicate_pairs(records: DataFrame, key: str = "id", one: str = "source_mechanism", other: str = "target_mechanism") -> DataFrame:
    """id_a, id_b (id_a < id_b): records that agree in both texts, in the same or in exchanged roles; each pair once.

    Exact copies (after folding) are compared as one class and expanded at the end."""
    members, texts = record_classes(records, key, one, other)
    members, links = cut_lineage(members), cut_lineage(linked_texts(texts))
    pairs = linked_classes(members, links)
    m1 = members.select(F.col("id").alias("i"), "lo", "hi")
    m2 = members.select(F.col("id").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    across = pairs.join(m1, ["lo", "hi"]).join(m2, ["lo2", "hi2"]).select("i", "j")
    same = m1.join(m2.withColumnsRenamed({"lo2": "lo", "hi2": "hi"}), ["lo", "hi"]).where(F.col("i") < F.col("j")).select("i", "j")
    return across.unionByName(same).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def near_duplicate_groups(records: DataFrame, key: str = "id", one: str = "source_mechanism", other: str = "target_mechanism") -> DataFrame:
    """id, group_id, links: every record with a class, the least id of its group, and the number of other classes its own
    is linked to. Copies are members of their class; they aren't paired."""
    members, texts = record_classes(records, key, one, other)
    members, links = cut_lineage(members), cut_lineage(linked_texts(texts))
    pairs = cut_lineage(linked_classes(members, links))
    reps = members.groupBy("lo", "hi").agg(F.min("id").alias("rep"))
    named = pairs.join(reps.withColumnRenamed("rep", "src"), ["lo", "hi"]).join(reps.select(F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("rep").alias("dst")), ["lo2", "hi2"]).select("src", "dst")
    degree = named.select(F.explode(F.array("src", "dst")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    groups = connected_components(named)
    return (
        members.join(reps, ["lo", "hi"])
        .join(degree, "rep", "left")
        .join(groups.withColumnsRenamed({"node": "rep", "component": "grp"}), "rep", "left")
        .select("id", F.coalesce("grp", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    )
