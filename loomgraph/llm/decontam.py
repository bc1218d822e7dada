"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

Texts and items are strings of words (runs of letters and digits, A-Z lower-cased).  A document holds an item if some stretch of it
is within floor(SHARE * words of the item) word edits of the item.

1. Items are put into bands of similar length; each band has one window size.  Every window of every document is looked at; one goes
   on if it has so many of the band's word trigrams as a stretch within the edit bound must have: an edit destroys three trigrams at
   most, so n words keep n - 2 - 3 * edits of theirs (a bound, nothing is lost).  Items of fewer than ``LEAST_WORDS`` words, for which
   that bound says nothing, go by word pairs in the same way, items of one word by the word.
2. The CGK random walk maps each window and item to a string of three times its length: copy the word the walk stands on, step on by a
   bit hashed from (walk, step, word).  Edit distance becomes Hamming distance.  Bit sampling takes ``BITS`` places of it as a key,
   by ``WALKS`` walks times ``TABLES`` keys each.  Windows that share a key with an item are verified by exact approximate matching
   (bit-parallel edit distance, any start and end) of the item in the stretch around the window.
3. The walk loses more the longer items are and the more words were inserted or deleted, so it isn't relied on: wherever a stretch holds
   as many of an item's own trigrams as the bound asks for, the item is verified there too.  Every match within the edit bound is
   found, at any length (recall 1).

Items are a stated query set: they are read in blocks of ``BLOCK``, each broadcast, against all documents.

Defined results: null or wordless texts and items match nothing; items of fewer than 5 words have no edit to give and match exact copies
only; repeated rows each give their rows; a document and item match once, with the least distance and then the first end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import combine, map_arrow, mix64, slices, table, text_bytes, word_hashes

SHARE = 0.2
LEAST_WORDS = 8
WALKS, TABLES, BITS = 4, 12, 4
BLOCK = 5000
#: Items whose trigrams are looked up together; bounds the pairs (place, item) held at once.
GROUP = 64
#: Bytes of text searched at once, and numbers in the arrays made of them (8 bytes each); bound a worker's memory.
PART_BYTES, CELLS = 1 << 18, 1 << 20
#: Window sizes are powers of this.
BAND = 1.1
SCHEMA = "doc_id long, item_id long, distance int, end_word int"

_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Size of the table of a band's trigrams, as a power of 2; hits of other trigrams only let more windows through.
TRIGRAM_BITS = 20


def _low(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << TRIGRAM_BITS) - 1)).astype(np.int64)


def words_of(texts) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(texts)
    return word_hashes(data, offsets, keep=_KEEP)


def walk(rows: np.ndarray, number: int, steps: int) -> np.ndarray:
    """CGK embedding of strings of equal or padded length: (strings, steps).  ``rows``: word hashes, 0 beyond the end."""
    n, width = rows.shape
    padded = np.concatenate((rows, np.zeros((n, 1), np.uint64)), axis=1)
    at = np.zeros(n, np.int64)
    out = np.empty((n, steps), np.uint64)
    line = np.arange(n)
    for j in range(steps):
        w = padded[line, np.minimum(at, width)]
        out[:, j] = w
        factor = ((number + 1) * 0x9E3779B97F4A7C15 + (j + 1) * 0xD1B54A32D192ED03) & 2**64 - 1 | 1
        at += (w * np.uint64(factor) >> np.uint64(63)).astype(np.int64)  # words are mixed hashes, so one product will do
    return out


def sampled(steps: int) -> np.ndarray:
    """(WALKS, TABLES, BITS) places; early places, where walks are still together, are as likely as others."""
    return np.random.Generator(np.random.PCG64(steps)).integers(0, steps, size=(WALKS, TABLES, BITS))


def keys_of(rows: np.ndarray, size: int) -> np.ndarray:
    """(strings, WALKS * TABLES) keys of strings in the band of window size ``size``."""
    steps = 3 * size
    places = sampled(steps)
    out = np.empty((len(rows), WALKS * TABLES), np.uint64)
    for r in range(WALKS):
        e = walk(rows, r, steps)
        for t in range(TABLES):
            key = np.full(len(rows), r * TABLES + t + 1, np.uint64)
            for b in places[r, t]:
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ e[:, b])
            out[:, r * TABLES + t] = key
    return out


def best_match(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """(least distance, first end) of ``item`` in ``text`` with free start and end, if at most ``most`` (Myers 1999)."""
    m = len(item)
    mask: dict[int, int] = {}
    for i, w in enumerate(item):
        mask[w] = mask.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = full, 0, m, None
    for j, w in enumerate(text):
        eq = mask.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def _grams(words: int) -> int:
    return 3 if words >= LEAST_WORDS else min(words, 2)


class Items:
    """A block of benchmark items, ready for search."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        hashes, counts = words_of(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        self.ids, self.words, self.most, self.bands = [], [], [], {}
        for i, (n, e) in zip(ids, zip(counts.tolist(), ends.tolist())):
            if n and i is not None:
                self.ids.append(i)
                self.words.append(hashes[e - n : e])
                self.most.append(int(SHARE * n))
                size = n if n < LEAST_WORDS else max(LEAST_WORDS, round(BAND ** round(np.log(n) / np.log(BAND))))
                self.bands.setdefault(size, []).append(len(self.ids) - 1)
        n, most = np.array(list(map(len, self.words)), np.int64), np.array(self.most, np.int64)
        grams = np.array([_grams(k) for k in n.tolist()], np.int64)
        self.reach, self.need = n + most, n - grams + 1 - grams * most
        self.tables = {}
        self.known = {g: np.zeros(1 << TRIGRAM_BITS, np.uint64) for g in sorted(set(grams.tolist()))}  # which bands have an n-gram, as bits; bands beyond 64 share them
        for size, members in self.bands.items():
            g = _grams(size)
            keys = owner = None
            if g == 3:
                width = max(len(self.words[k]) for k in members)
                rows = np.zeros((len(members), width), np.uint64)
                for r, k in enumerate(members):
                    rows[r, : len(self.words[k])] = self.words[k]
                keys = keys_of(rows, size)
                flat, owner = keys.ravel(), np.repeat(np.array(members), keys.shape[1])
                order = np.argsort(flat, kind="stable")
                keys, owner = flat[order], owner[order]
            bit = np.uint64(1 << len(self.tables) % 64)
            groups = []
            for lo in range(0, len(members), GROUP):
                own = [np.unique(combine(self.words[k], g)) for k in members[lo : lo + GROUP]]
                flat, holder = np.concatenate(own), np.repeat(np.array(members[lo : lo + GROUP]), list(map(len, own)))
                self.known[g][_low(flat)] |= bit
                order = np.argsort(flat, kind="stable")
                groups.append((flat[order], holder[order]))
            self.tables[size] = (g, keys, owner, bit, int(self.reach[members].max()), int(self.need[members].min()), groups)

    def search(self, hashes: np.ndarray, counts: np.ndarray):
        """(row, item, distance, end) of each match in rows of words."""
        ends = np.cumsum(counts)
        row_of = np.repeat(np.arange(len(counts)), counts)
        seen = {}
        for g, known in self.known.items():
            grams = combine(hashes, g)
            marks = known[_low(grams)]
            places = np.flatnonzero((marks != 0) & (row_of[g - 1 :] == row_of[: len(row_of) - g + 1])) if len(grams) else np.zeros(0, np.int64)
            seen[g] = grams, places, marks[places]
        found: dict[tuple[int, int], tuple[int, int]] = {}
        tried: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for size, (g, keys, owners, bit, reach, need, groups) in self.tables.items():
            grams, places, marks = seen[g]
            p = places[(marks & bit) != 0]
            if len(p) < need:
                continue
            a, z = p[: len(p) - need + 1], p[need - 1 :]
            near = (z - a <= reach - g) & (row_of[a] == row_of[z])
            a, z = a[near], z[near]
            if not len(a):
                continue
            for own in groups:
                self._bounded(p, g, grams, own, row_of, hashes, counts, ends, found)
            if g < 3:
                continue
            # every start whose stretch of ``reach`` words holds ``need`` known trigrams
            heads = ends[row_of[a]] - counts[row_of[a]]
            lo = np.maximum(heads, z - (reach - 3))
            cover = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(cover, lo, 1)
            np.add.at(cover, a + 1, -1)
            at = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            stride = max(1, size // 10)  # the walk makes up for a shift by a tenth
            at = at[(at - (ends[row_of[at]] - counts[row_of[at]])) % stride == 0]
            for part in np.array_split(at, max(1, -(-len(at) * 3 * size // CELLS))):
                if not len(part):
                    continue
                row = row_of[part]
                index = part[:, None] + np.arange(size)
                rows = np.where(index < ends[row][:, None], hashes[np.minimum(index, len(hashes) - 1)], np.uint64(0))
                mine = keys_of(rows, size)
                lo = np.searchsorted(keys, mine)
                hit = keys[np.minimum(lo, len(keys) - 1)] == mine
                for w, c in zip(*np.nonzero(hit)):
                    k = lo[w, c]
                    while k < len(keys) and keys[k] == mine[w, c]:
                        self._verify(int(part[w]), int(row[w]), int(owners[k]), size, hashes, counts, ends, found, tried)
                        k += 1
        return [(r, self.ids[i], d, e) for (r, i), (d, e) in sorted(found.items())]

    def _bounded(self, p, g, grams, own, row_of, hashes, counts, ends, found):
        """Verify each item of a group wherever a stretch holds as many of its own n-grams as the edit bound asks for."""
        flat, holder = own
        first = np.searchsorted(flat, grams[p])
        n = np.searchsorted(flat, grams[p], side="right") - first
        low, high = (int(holder.min()), int(holder.max())) if len(holder) else (0, 0)
        if n.sum() > CELLS and low < high:  # half the items at a time
            for half in (holder <= (low + high) // 2, holder > (low + high) // 2):
                self._bounded(p, g, grams, (flat[half], holder[half]), row_of, hashes, counts, ends, found)
            return
        place = np.repeat(p, n)
        item = holder[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        order = np.lexsort((place, item))
        place, item = place[order], item[order]
        far = np.arange(len(place)) + self.need[item] - 1
        last = np.minimum(far, len(place) - 1)
        row = row_of[place]
        near = (far == last) & (item[last] == item) & (row[last] == row) & (place[last] - place <= self.reach[item] - g)
        a, z, item, row = place[near], place[last[near]], item[near], row[near]
        if not len(a):
            return
        lo = np.maximum(ends[row] - counts[row], z + g - self.reach[item])
        hi = np.minimum(ends[row], a + self.reach[item])
        head = np.concatenate(([True], (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])))
        tail = np.append(head[1:], True)
        for k, r, b, e in zip(item[head].tolist(), row[head].tolist(), lo[head].tolist(), hi[tail].tolist()):
            got = best_match(self.words[k].tolist(), hashes[b:e].tolist(), self.most[k])
            if got:
                new = (got[0], b + got[1] - int(ends[r] - counts[r]))
                if (r, k) not in found or new < found[r, k]:
                    found[r, k] = new

    def _verify(self, start, row, item, size, hashes, counts, ends, found, tried):
        step = max(1, size // 2)
        spans = tried.setdefault((row, item), [])
        if any(lo <= start <= hi for lo, hi in spans):
            return
        spans.append((start - step, start + step))
        words, most = self.words[item], self.most[item]
        slack = most + abs(len(words) - size) + step
        first = int(ends[row] - counts[row])
        lo, hi = max(first, start - slack), min(int(ends[row]), start + size + slack)
        got = best_match(words.tolist(), hashes[lo:hi].tolist(), most)
        if got:
            new = (got[0], lo + got[1] - first)
            if (row, item) not in found or new < found[row, item]:
                found[row, item] = new


def _blocks(benchmark: DataFrame, block: int):
    """Broadcasts of (ids, texts) of about ``block`` items."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    n = items.count()
    blocks = max(1, -(-n // block))
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        rows = own.orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))


def matches(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, distance, end_word: each item that a document holds."""
    out = None
    for shared in _blocks(benchmark, block):
        got = map_arrow(docs.select("doc_id", "text"), _searcher(shared), SCHEMA)
        out = got if out is None else out.union(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows whose text holds an item."""
    out = docs
    for shared in _blocks(benchmark, block):
        out = map_arrow(out, _cleaner(shared), docs.schema)
    return out


def _cleaner(shared):
    def work(batches):
        items = Items(*shared.value)
        for batch in batches:
            for part in slices(batch, limit=PART_BYTES):
                keep = np.ones(part.num_rows, bool)
                keep[[g[0] for g in (items.search(*words_of(part.column("text"))) if items.ids else [])]] = False
                yield part.filter(pa.array(keep))

    return work


def _searcher(shared):
    def work(batches):
        items = Items(*shared.value)
        for batch in batches:
            for part in slices(batch, limit=PART_BYTES):
                got = items.search(*words_of(part.column("text"))) if items.ids else []
                ids = part.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.int32())], [x.split()[0] for x in SCHEMA.split(", ")])

    return work


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item; each row by its own text."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
