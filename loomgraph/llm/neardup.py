"""Exact n-gram Jaccard join in size-banded tiles with bitmap signatures.

A document is its set of hashed five-word shingles.  Two link when 100 * intersection >= 80 * union.

1. One pass over the texts gives each set's size, 128-bit fingerprint and 512-bit parity bitmap (bit = parity of the elements hashed
   to it), for sets of over ``WIDE`` elements a second one of two to four bits an element, and counts of shingles common within a task.  Rows of equal fingerprint and size are one set from here on.
2. A second pass gives each set the floor(n / 5) + 1 first elements of one global order, common shingles last, as keys.  Sets that
   link share a key, whatever the order is; so nothing is lost, and putting common shingles last only keeps groups small.  Keys that
   exactly the same sets hold say the same, so one of them stays.
3. A tile is (key, size band or the band above): sets that link are in one band or in neighbouring ones, so they meet in a tile.
   In each tile all sets are held against its center first, one of ``CENTERS`` choices by hash; each set's nearest center by bits is
   verified before its others, then its nearest among those it isn't connected with yet.  What tiles still hold in different classes
   is then held against each other, each pair at its first tile only: sizes and bit counts bound the intersection from above - popcount(a xor b) elements at least are in one set only - and what remains is settled
   by intersecting the sorted arrays.
4. Components of the links give the classes.

Rows per document grow with its length only; groups meet by equi-joins that leave out what is already connected, so that a group of
near copies costs as many links as it has members.  A key that so many sets hold that they'd make one task too large is dealt in
salted parts until its tiles are counted by aggregates.

Defined results: null or wordless text has n_shingles 0 and is linked with nothing; 1 to 4 words are one shingle; rows with the same
doc_id are one node; a null doc_id has component_id null; an empty table gives none.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.components import components

from .common import _MIX, SLICE_BYTES, combine, map_arrow, materialize, mix64, release, slices, table, text_bytes, word_hashes

WORDS = 5
#: A link needs PER_CENT of the union.
PER_CENT = 80
BITS = 512
#: Beyond so many elements the bitmap of BITS fills up, and a second one that grows with the set is held too.
WIDE = 256
#: Shingles counted together, at most, when looking for common ones; and how many of the commonest are put last in the order.
COUNT_SPAN, COMMON_MOST = 4_000_000, 100_000
#: Prefix keys of one set are sent once per task; the memory of which were is bounded.
SEEN_MOST = 1_000_000
#: Partners of one set that are verified in one group; larger stars are split.
STAR = 512
#: Tiles of so many kinds choose their centers each by an order of its own, so that a group of near copies has several.
CENTERS = 16
#: Sets that hold one key are dealt in parts of about so many.
SALT_ROWS = 1_000_000
#: Up to so many pairs the documents asked for (two a pair at most, some 50 bytes each) are broadcast; beyond, documents are shuffled.
BROADCAST_PAIRS = 250_000
#: Keys before its own that a set carries into a tile, to tell pairs that have met before.
BEFORE = 4


def shingle_sets(part: pa.RecordBatch):
    """Sorted distinct shingle hashes of each row."""
    data, offsets = text_bytes(part.column("text"))
    hashes, counts = word_hashes(data, offsets)
    keys = combine(hashes, WORDS)
    at = 0
    for c in counts.tolist():
        if c >= WORDS:
            s = np.sort(keys[at : at + c - WORDS + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif c:
            short = np.zeros(1, np.uint64)
            for k in range(c):
                short = short + hashes[at + k : at + k + 1] * _MIX[20 + k]
            yield mix64(short + _MIX[30:31] * np.uint64(c))
        else:
            yield np.zeros(0, np.uint64)
        at += c


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    a, b = (np.add.reduce(mix64(s ^ _MIX[k])) for k in (40, 41))
    return int(np.int64(np.uint64(a))), int(np.int64(np.uint64(b)))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def parities(s: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap, as longs: each bit says whether an odd number of elements is hashed to it."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


BIT_COLUMNS = [f"b{i}" for i in range(BITS // 64)]
FEATURE_SCHEMA = "doc_id long, common boolean, n int, f0 long, f1 long, " + ", ".join(f"{b} long" for b in BIT_COLUMNS) + ", wide array<long>"


def features(docs: DataFrame) -> DataFrame:
    """A row per document (size, fingerprint, bitmap), and rows with common = true: f0 a shingle, n its count within a task."""

    def common_rows(held: list[np.ndarray]):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        some = counts >= 3
        k, c = _signed(keys[some]), counts[some].astype(np.int32)
        n = len(k)
        zero = pa.array(np.zeros(n, np.int64))
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(np.ones(n, bool)), pa.array(c), pa.array(k), zero] + [zero] * len(BIT_COLUMNS) + [pa.nulls(n, pa.list_(pa.int64()))], NAMES)

    NAMES = [x.split()[0] for x in FEATURE_SCHEMA.split(", ")]

    def work(batches):
        held, size = [], 0
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch):
                n, f0, f1, maps, wide = [], [], [], [], []
                for s in shingle_sets(part):
                    a, b = fingerprint(s) if len(s) else (0, 0)
                    n.append(len(s)), f0.append(a), f1.append(b)
                    maps.append(parities(s, BITS))
                    wide.append(parities(s, 2 << (len(s) - 1).bit_length()) if len(s) > WIDE else None)
                    if (a, b) not in seen:  # equal sets count once: they will be one
                        if len(seen) < SEEN_MOST:
                            seen.add((a, b))
                        held.append(s)
                        size += len(s)
                bits = np.array(maps, np.int64).reshape(len(n), len(BIT_COLUMNS))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.zeros(len(n), bool)), pa.array(n, pa.int32()), pa.array(f0, pa.int64()), pa.array(f1, pa.int64())] + [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(bits.shape[1])] + [pa.array(wide, pa.list_(pa.int64()))], NAMES)
                if size >= COUNT_SPAN:
                    yield common_rows(held)
                    held, size = [], 0
        if held:
            yield common_rows(held)

    return map_arrow(docs.select("doc_id", "text"), work, FEATURE_SCHEMA)


def prefixes(docs: DataFrame, common: np.ndarray, salts: np.ndarray) -> DataFrame:
    """(f0, keys, salts): each set's first floor(n / 5) + 1 elements in the global order.

    Keys travel with half of the fingerprint: of sets that have it in common each takes the keys of all.
    ``common``: hashes, rarest first; ``salts``: in how many parts the sets that hold each are dealt (0: in one).  The row's salts
    are null where none of its keys is dealt in parts, else a part from 1 on for each such key and 0 for the others.
    """
    shared = docs.sparkSession.sparkContext.broadcast((common, salts))  # at most COMMON_MOST numbers each

    def work(batches):
        ranks, parts = shared.value
        order = np.argsort(ranks)
        known = ranks[order]
        maybe = np.zeros(1 << 20, bool)
        maybe[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch):
                f0, keys, dealt = [], [], []
                for s in shingle_sets(part):
                    if not len(s):
                        continue
                    a, b = fingerprint(s)
                    if (a, b) in seen:
                        continue
                    if len(seen) < SEEN_MOST:
                        seen.add((a, b))
                    n, p, salt = len(s), len(s) // 5 + 1, None
                    hit = np.flatnonzero(maybe[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    if len(hit) and len(known):
                        where = np.minimum(np.searchsorted(known, s[hit]), len(known) - 1)
                        is_common = known[where] == s[hit]
                        hit, rank = hit[is_common], np.sort(order[where[is_common]])
                        mask = np.ones(n, bool)
                        mask[hit] = False
                        s = np.concatenate((s[mask], ranks[rank]))
                        of = parts[rank][: max(0, p - (n - len(hit)))]
                        if of.any():
                            salt = np.concatenate((np.zeros(p - len(of), np.int64), np.where(of > 0, 1 + b % np.maximum(of, 1), 0))).tolist()
                    f0.append(a), dealt.append(salt)
                    keys.append(_signed(np.ascontiguousarray(s[:p])))
                ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f0, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(dealt, pa.list_(pa.int32()))], ["f0", "keys", "salts"])

    return map_arrow(docs.select("text"), work, "f0 long, keys array<long>, salts array<int>")


def collapsed(keyed: DataFrame) -> DataFrame:
    """(key, f0) of the keys that two sets or more hold; of keys that the same sets hold, the least.

    The sets that hold a key are told apart by two sums over their f0, 48 bits a set each.  Keys dealt in parts all stay.
    """
    dealt = keyed.repartition("key", "salt").dropDuplicates(["key", "salt", "f0"])
    w = Window.partitionBy("key", "salt")
    m = F.count(F.lit(1)).over(w)
    h0, h1 = (F.sum(F.shiftright(c, 16)).over(w) for c in (F.col("f0"), F.xxhash64("f0")))
    hot = F.col("salt") > 0
    met = dealt.withColumns({"m": m, "h0": F.when(hot, F.col("key")).otherwise(h0), "h1": F.when(hot, F.lit(0)).otherwise(h1)}).where((F.col("m") > 1) | hot)
    return met.groupBy("h0", "h1", "f0").agg(F.min("key").alias("key")).select("key", "f0")


def _xor(a: str, b: str) -> str:
    return " + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in BIT_COLUMNS)


def _distance(a: str, b: str):
    return F.expr(_xor(a, b))


def _bounded(a: str, b: str):
    """Whether sizes and bit counts leave a link possible: I >= 0.8 U means 9 I >= 4 (na + nb)."""
    xor = _xor(a, b)
    small, large = f"least({a}.n, {b}.n)", f"greatest({a}.n, {b}.n)"
    upper = f"least({small}, ({a}.n + {b}.n - ({xor})) div 2)"
    return F.expr(f"100L * {small} >= {PER_CENT}L * {large} AND {100 + PER_CENT}L * ({upper}) >= {PER_CENT}L * ({a}.n + {b}.n)")


def _bounded_wide(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that may link by the bitmaps that grow with the sets; pairs without two of one width all stay."""
    pairs = materialize(pairs, "shingle-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    # of the sets only those asked for are shuffled, as long as their ids may be broadcast
    ends = F.broadcast(ends) if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else ends
    asked = sets.select("sid", "n", "wide").join(ends, "sid", "left_semi")
    x, y = (asked.select(F.col("sid").alias(k), F.col("n").alias("n" + k), F.col("wide").alias("w" + k)) for k in "ab")
    both = pairs.join(x, "a").join(y, "b")
    xor = "aggregate(zip_with(wa, wb, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    may = F.expr(f"wa IS NULL OR wb IS NULL OR size(wa) <> size(wb) OR {100 + PER_CENT}L * ((na + nb - {xor}) div 2) >= {PER_CENT}L * (na + nb)")
    return both.where(may).select(*pairs.columns)


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` with each text compressed by itself (level 9), which takes two thirds of what a shuffle's own codec makes of it."""
    kept = [c for c in rows.columns if c != "text"]

    def work(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=9).compress
        for batch in batches:
            for part in slices(batch):
                packed = [None if t is None else squeeze(t.encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(packed, pa.binary())], [*kept, "packed"])

    return map_arrow(rows, work, ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept] + ["packed binary"]))


def _unpacked(batch: pa.RecordBatch):
    """Runs of rows of ``_packed`` whose texts hold about SLICE_BYTES; a longer single one stays whole."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    kept = [c for c in batch.schema.names if c != "packed"]

    def run(begin, texts):
        rows = batch.slice(begin, len(texts))
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(texts, pa.binary()).view(pa.string())], [*kept, "text"])

    begin, texts, held = 0, [], 0
    for i, packed in enumerate(batch.column("packed")):
        text = None if not packed.is_valid else expand(packed.as_py())
        if texts and held + len(text or b"") > SLICE_BYTES:
            yield run(begin, texts)
            begin, texts, held = i, [], 0
        texts.append(text)
        held += len(text or b"")
    if texts:
        yield run(begin, texts)


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of set ids those that link, by intersecting sorted arrays; a written table.

    The texts of a and its partners meet once per star, and their arrays are made there: a text takes less disk than its array, and
    none is sent once per pair.  Stars of more than about STAR partners are split, with a copy of a in each part.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    partner = pairs.join(parts, "a").select("a", F.col("b").alias("sid"), F.expr("cast(pmod(xxhash64(b), parts) as int)").alias("part"))
    center = parts.select("a", F.col("a").alias("sid"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = partner.union(center).join(sets.select("sid", "owner", "f0", "f1"), "sid").select(F.col("owner").alias("doc_id"), "a", "part", "sid", "f0", "f1")
    asked = F.broadcast(asked) if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else asked
    met = _packed(docs.select("doc_id", "text").join(asked, "doc_id").select("a", "part", "sid", "f0", "f1", "text"))
    met = met.repartition("a", "part").sortWithinPartitions("a", "part", F.col("sid") != F.col("a"))

    def intersect(batches):
        star, mine = None, None
        for batch in batches:
            for part in _unpacked(batch):
                a, b = [], []
                for hub, sid, f0, f1, s in zip(*(part.column(c).to_pylist() for c in ("a", "sid", "f0", "f1")), shingle_sets(part)):
                    if not len(s) or fingerprint(s) != (f0, f1):
                        continue  # another text under the same doc_id
                    if sid == hub:
                        star, mine = hub, s
                        continue
                    assert star == hub, "a star without its center"
                    few, many = sorted((mine, s), key=len)
                    inter = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                    if 100 * inter >= PER_CENT * (len(mine) + len(s) - inter):
                        a.append(hub), b.append(sid)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return materialize(map_arrow(met, intersect, "a long, b long"), "shingle-links")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends have different labels; a set without a label is its own."""
    la, lb = (label.select(F.col("sid").alias(k), F.col("label").alias("l" + k)) for k in "ab")
    return pairs.join(la, "a", "left").join(lb, "b", "left").where("coalesce(la, a) <> coalesce(lb, b)").select(*pairs.columns)


def _labels(links: DataFrame) -> DataFrame:
    """(sid, label) of the sets that have a link."""
    return components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("sid"), F.col("component").alias("label"))


def _split_tiles(tiles: DataFrame, value: str) -> DataFrame:
    """Rows of the tiles that hold two values or more.

    By aggregates, combined before the shuffle and written, so that the join with them is one that adaptive execution can split.
    ``tiles`` is read twice.
    """
    ends = tiles.groupBy("key", "tile").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo <> hi").select("key", "tile")
    return tiles.join(materialize(ends, "shingle-ends"), ["key", "tile"])


def _stars(tiles: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of each set and the center of its tiles."""
    order = F.struct(F.xxhash64(F.pmod("key", F.lit(CENTERS)), "sid").alias("h"), "sid")
    centers = materialize(tiles.groupBy("key", "tile").agg(F.min(order).alias("m"), F.max("sid").alias("hi"), F.min("sid").alias("lo")).where("lo <> hi").select("key", "tile", F.col("m.sid").alias("center")), "shingle-centers")
    met = tiles.join(centers, ["key", "tile"]).where("sid <> center")
    return met.select(F.least("sid", "center").alias("a"), F.greatest("sid", "center").alias("b")).distinct()


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, d) those that are the nearest of one of their ends; a written table."""
    ends = pairs.select("d", "a", "b", F.explode(F.array("a", "b")).alias("end"))
    best = ends.groupBy("end").agg(F.min(F.struct("d", "a", "b")).alias("m"))
    return materialize(best.select("m.a", "m.b").distinct(), "shingle-nearest")


def _across(tiles: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b), once or a few times each, of sets that meet in a tile, have different labels and may link by sizes and bits.

    A set's tiles of one size are ordered by key; it carries the keys of the last ones before.  Two sets that have one of these in
    common have met before and don't meet again, so each pair is kept at its first tile and seldom at another.
    """
    named = materialize(tiles.join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid")), "shingle-named")
    # one exchange by sid serves the grouping and the join with the sets
    split = _split_tiles(named, "label").repartition("sid").groupBy("sid", "tile", "label").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    split = split.join(sets.select("sid", "n", "band", *BIT_COLUMNS), "sid")
    placed = split.select("*", F.posexplode("keys").alias("pos", "key"))
    placed = placed.withColumn("before", F.slice("keys", F.greatest(F.lit(1), F.col("pos") + 1 - BEFORE), F.least(F.col("pos"), F.lit(BEFORE)))).drop("keys", "pos")
    x, y = placed.alias("x"), placed.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.tile") == F.col("y.tile")) & (F.col("x.band") == F.col("x.tile")) & (F.col("x.label") != F.col("y.label"))
    once = (F.col("y.band") < F.col("x.band")) | (F.col("x.sid") < F.col("y.sid"))
    met = x.join(y, meet & once & ~F.arrays_overlap("x.before", "y.before") & _bounded("x", "y"))
    return met.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))


def join_links(docs: DataFrame):
    """(documents: doc_id, n, owner; links: a, b between set ids; sets: sid, owner, ...).  owner is the least doc_id with the set."""
    rows = materialize(features(docs), "shingle-features")
    counted = rows.where("common").groupBy("f0").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "f0").limit(COMMON_MOST).toArrow()
    order = np.arange(counted.num_rows)[::-1]
    common = counted.column("f0").to_numpy().astype(np.int64).view(np.uint64)[order]
    salts = counted.column("c").to_numpy().astype(np.int64)[order] // SALT_ROWS
    salts = np.where(salts > 0, salts + 1, 0)
    mine = rows.where("NOT common AND n > 0 AND doc_id IS NOT NULL")
    agg = [F.min("doc_id").alias("owner"), *[F.first(c).alias(c) for c in [*BIT_COLUMNS, "wide"]]]
    band = F.floor(F.log("n") / F.log(F.lit(100 / PER_CENT))).cast("int")
    sets = mine.groupBy("f0", "f1", "n").agg(*agg).withColumns({"band": band, "sid": F.monotonically_increasing_id()})
    sets = materialize(sets, "shingle-sets")

    part = F.expr("coalesce(salts[pos], 0)")
    keyed = prefixes(docs, common, salts).select("f0", "salts", F.posexplode("keys").alias("pos", "key")).select("key", part.alias("salt"), "f0")
    # sets that have f0 in common all take the keys of all; a link would be lost only if no third set had f0 apart and shared its key
    met = collapsed(keyed).join(sets.select("f0", "sid", "band"), "f0")
    tiles = materialize(met.select("key", "sid", F.explode(F.array("band", F.col("band") + 1)).alias("tile")), "shingle-tiles")

    x, y = sets.drop("wide").alias("x"), sets.drop("wide").alias("y")
    bounded = _stars(tiles).join(x, F.col("a") == F.col("x.sid")).join(y, F.col("b") == F.col("y.sid")).where(_bounded("x", "y"))
    pairs = materialize(_bounded_wide(bounded.select("a", "b", _distance("x", "y").alias("d")), sets), "shingle-pairs")
    links = label = None
    rest = pairs
    for _ in range(2):
        nearest = _nearest(rest)
        found = _verified(nearest, docs, sets)
        links = found if links is None else links.union(found)
        label = _labels(links)
        after = materialize(_apart(rest.join(nearest, ["a", "b"], "left_anti"), label), "shingle-pairs")
        release(nearest, None if rest is pairs else rest)
        rest = after
    more = _bounded_wide(_across(tiles, label, sets).distinct().join(pairs, ["a", "b"], "left_anti"), sets)
    more = materialize(more.union(rest.select("a", "b")), "shingle-pairs")
    release(tiles, pairs, rest)
    if not more.isEmpty():
        links = links.union(_verified(more, docs, sets))
    release(more)
    return rows.where("NOT common").select("doc_id", "n", "f0", "f1"), links, sets


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of ``docs``.

    Components are those of sets, each under the least doc_id that has it; a doc_id that has several sets links them.
    """
    members, links, sets = join_links(docs)
    owner = sets.select("sid", "owner")
    x, y = owner.select(F.col("sid").alias("a"), F.col("owner").alias("u")), owner.select(F.col("sid").alias("b"), F.col("owner").alias("v"))
    edges = links.join(x, "a").join(y, "b").select("u", "v")
    mine = F.struct("f0", "f1", "n")
    several = members.where("n > 0").groupBy("doc_id").agg(F.min(mine).alias("lo"), F.max(mine).alias("hi")).where("lo <> hi").select("doc_id")
    own = members.where("n > 0").join(several, "doc_id").join(sets.select("f0", "f1", "n", "owner"), ["f0", "f1", "n"])
    found = components(edges.union(own.select(F.col("doc_id").alias("u"), F.col("owner").alias("v"))))
    named = sets.join(found, sets["owner"] == found["node"], "left").select("f0", "f1", "n", F.coalesce("component", "owner").alias("component"))
    joined = members.join(named, ["f0", "f1", "n"], "left")
    shown = F.when(F.col("n").eqNullSafe(0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), shown.alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the one with the smallest doc_id, null last; of rows with the same doc_id the first written.

    Classes are those of rows, under a row number that is written once, so null and repeated doc_ids count as rows of their own.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    numbered = rows.select(F.col("__row").alias("doc_id"), "text")
    named = classes(numbered).select(F.col("doc_id").alias("__row"), "component_id").join(rows.select("__row", "doc_id"), "__row")
    stays = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("m")).select("m.__row")
    return rows.join(stays, "__row", "left_semi").select(*docs.columns)


#: Sets, links by common shingles, and what links reach.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least_id AS component_id
FROM sets JOIN (SELECT doc_id, min(other) AS least_id FROM reached GROUP BY doc_id) USING (doc_id)
"""
