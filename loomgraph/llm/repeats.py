"""Exact repeated passages: removes each byte that a string of 200 bytes covers which also starts anywhere else.

Suffixes are sorted only where a repeat can be.  Every string of 200 bytes holds ``ANCHOR``-byte strings; those whose hash is the
least of their 200-byte string (ties: all) are anchors.  Equal strings have equal anchors at equal places, so each repeated string
shares the key (hash) of an anchor with its twin.

1. One pass over the texts emits (key, text id, place) of each anchor, about 1.3 a hundred bytes; keys met once are dropped.  Only a
   key's first two places in a task are compared with those of other tasks; its further ones are known to be repeats and are spread.
2. Anchors left get their surroundings (at most 160 bytes before, 200 after; never beyond their text).
3. Per key the distinct surroundings are deep-shallow sorted, rightwards and (reversed) leftwards.  Neighbours' common prefixes say
   which of them agree on d bytes left and 200 - d right of the anchor, that is, which of its strings are repeated.  Surroundings
   found twice or more as a whole are repeated throughout.  A key with more than ``SORTED_MOST`` surroundings isn't sorted in one
   task: the hashes of its 200-byte strings are grouped instead, spread in the same way.
4. The runs are joined back to the texts, merged, and cut out.

A text that several rows hold is worked on once and removed whole if it has 200 bytes; work is per distinct text.

Defined results: null text counts as empty; texts below 200 bytes lose nothing; rows with equal texts (also rows repeated as a whole)
are repeats of one another; an empty table gives none.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, materialize, mix64, slices, table
from .deepshallow import deep_shallow

LENGTH, ANCHOR = 200, 40
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, size=256, dtype=np.uint64)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class _Powers:
    """Powers of the rolling hash's base and of its inverse, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            n = 2 * n
            one = np.ones(n, np.uint64)
            up, down = one.copy(), one.copy()
            up[1:], down[1:] = np.uint64(_BASE), np.uint64(_INVERSE)
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each run of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, powers: _Powers, length: int = LENGTH, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the anchors of one text."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=total[1:])
    h = mix64((total[size:] - total[:-size]) * down[: n - size + 1])
    width = length - size + 1
    least = _slide(h, width, np.minimum)  # of each string of ``length`` bytes
    low = np.zeros(width - 1, np.uint64)
    most = _slide(np.concatenate((low, least, low)), width, np.maximum)
    at = np.flatnonzero(h == most)
    return at, h[at]


def _arrow(columns, names):
    return pa.RecordBatch.from_arrays(columns, names)


class _Met:
    """Which keys this task has met at two places at least; forgets the others, or all, beyond ``limit`` keys.

    Forgetting only means that more rows are compared between tasks.
    """

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self.at: dict = {}

    def sure(self, keys: list, where: list) -> list[bool]:
        """Per (key, where), whether two other places of the key went out before."""
        at, out = self.at, []
        for k, w in zip(keys, where):
            first = at.get(k)
            out.append(first is True)
            if first is None:
                at[k] = w
            elif first is not True and first != w:
                at[k] = True
        if len(at) > self.limit:
            twice = {k: True for k, first in at.items() if first is True}
            self.at = twice if 2 * len(twice) < self.limit else {}
        return out


def repeated(rows: DataFrame, key: list[str], where: list[str]) -> DataFrame:
    """Rows whose key is met at two different places: those marked ``sure``, and by comparison the others."""
    place = F.struct(*where)
    # a mark of its own for the sure ones: they go to tasks of their own and meet nobody
    w = Window.partitionBy(*key, "spread")
    rows = rows.withColumn("spread", F.when(F.col("sure"), F.xxhash64(*where)))
    met = rows.withColumns({"lo": F.min(place).over(w), "hi": F.max(place).over(w)})
    return met.where("sure OR lo <> hi").drop("sure", "spread", "lo", "hi")


def anchor_rows(texts: DataFrame) -> DataFrame:
    def work(batches):
        powers, met = _Powers(), _Met()
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                keys, ids, places, sure = [], [], [], []
                for tid, t in zip(part.column("tid").to_pylist(), part.column("text").to_pylist()):
                    if tid in seen or not t:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(tid)
                    at, key = anchors(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), powers)
                    keys.append(key), places.append(at), ids.append(np.full(len(at), tid, np.int64))
                    sure += met.sure(key.tolist(), [(tid, p) for p in at.tolist()])
                if keys:
                    columns = pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(places).astype(np.int32))
                    yield _arrow([*columns, pa.array(sure, pa.bool_())], ["key", "tid", "place", "sure"])

    return map_arrow(texts, work, "key long, tid long, place int, sure boolean")


def surroundings(joined: DataFrame) -> DataFrame:
    """(text, places, keys) -> a row per anchor; the bytes are left out where this task has sent the same ones before."""

    def work(batches):
        import xxhash

        seen: set = set()
        done: set = set()
        for batch in batches:
            for part in slices(batch):
                out = [[], [], [], [], [], []]
                for tid, t, hits in zip(part.column("tid").to_pylist(), part.column("text").to_pylist(), part.column("hits").to_pylist()):
                    if tid in done:
                        continue
                    if len(done) < 1_000_000:
                        done.add(tid)
                    b = t.encode("utf-8", "surrogatepass")
                    for hit in hits:
                        p, key = hit["place"], hit["key"]
                        left = max(0, p - (LENGTH - ANCHOR))
                        around = (p - left).to_bytes(2, "big") + b[left : p + LENGTH]
                        mark = xxhash.xxh3_64_intdigest(around) - 2**63
                        new = (key, mark) not in seen
                        if new and len(seen) < 1_000_000:
                            seen.add((key, mark))
                        for column, v in zip(out, (key, mark, tid, p, around if new else None, new)):
                            column.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
                yield _arrow([pa.array(v, t) for v, t in zip(out, types)], ["key", "mark", "tid", "place", "around", "fresh"])

    return map_arrow(joined, work, "key long, mark long, tid long, place int, around binary, fresh boolean")


#: Up to so many surroundings of one key are sorted in one task (about 360 bytes each); beyond, their strings are grouped by hash.
SORTED_MOST = 100_000

#: Up to so many surroundings are compared by pairs, from the common prefixes of neighbours.
PAIRS_MOST = 16


def _groups(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Numbers such that two strings have equal ones if they agree on ``least`` characters at least."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < least)
    return out


def _shared(order: list[int], common: list[int]) -> list[list[int]]:
    """Common prefix lengths of all pairs: the least between them in sorted order."""
    n = len(order)
    out = [[0] * n for _ in range(n)]
    for a in range(n):
        least, x = LENGTH, order[a]
        for b in range(a + 1, n):
            least = min(least, common[b])
            out[x][order[b]] = out[order[b]][x] = least
    return out


def repeated_runs(around: list[tuple[bytes, bool]]) -> list[tuple[int, int] | None]:
    """Per surroundings of one key, the run (from, to; relative to the anchor) that repeated strings cover, or None.

    ``around``: (bytes, whether found twice or more as a whole), distinct.  All strings hold the anchor, so the run is one.
    """
    lefts = [b[2 : 2 + int.from_bytes(b[:2], "big")] for b, _ in around]
    rights = [b[2 + len(x) :] for (b, _), x in zip(around, lefts)]
    n = len(around)
    out: list[tuple[int, int] | None] = [(-len(x), len(y)) if twice and len(x) + len(y) >= LENGTH else None for x, y, (_, twice) in zip(lefts, rights, around)]
    if n == 1:
        return out
    to_right, to_left = deep_shallow(rights), deep_shallow([x[::-1] for x in lefts])
    if n <= PAIRS_MOST:
        left, right = _shared(*to_left), _shared(*to_right)
        for i in range(n):
            if out[i] is None:
                agree = [(x, y) for j, (x, y) in enumerate(zip(left[i], right[i])) if j != i and x + y >= LENGTH]
                if agree:
                    out[i] = (-max(x for x, _ in agree), max(y for _, y in agree))
        return out
    # strings that begin d before the anchor agree where d characters to the left and LENGTH - d to the right do; the groups change
    # only where d passes a common prefix length
    (lo, lc), (ro, rc) = ((np.array(o), np.array(c)) for o, c in (to_left, to_right))
    first, last = max(0, LENGTH - int(rc.max())), min(LENGTH - ANCHOR, int(lc.max()))
    edges = np.unique(np.concatenate(([first, last + 1], lc + 1, LENGTH - rc)))
    edges = edges[(edges >= first) & (edges <= last + 1)]
    begin, end = np.ones(n, np.int64), np.zeros(n, np.int64)
    for d, after in zip(edges[:-1].tolist(), edges[1:].tolist()):
        # at the far end of the stretch more is asked of the left; within it the groups are the same
        both = _groups(lo, lc, d) * (n + 1) + _groups(ro, rc, LENGTH - d)
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        twin = np.zeros(n, bool)
        twin[order[1:][same]] = twin[order[:-1][same]] = True
        begin[twin] = np.minimum(begin[twin], 1 - after)
        end[twin] = np.maximum(end[twin], LENGTH - d)
    for i in np.flatnonzero(end > 0).tolist():
        if out[i] is None:
            out[i] = (int(begin[i]), int(end[i]))
    return out


def sorted_runs(distinct: DataFrame) -> DataFrame:
    """Rows (key, mark, around, twice), all of a key together -> (key, mark, lo, hi)."""

    def flush(key, group, out):
        for (mark, _, _), run in zip(group, repeated_runs([(a, t) for _, a, t in group])):
            if run:
                for column, v in zip(out, (key, mark, *run)):
                    column.append(v)

    def batch_of(out):
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return _arrow([pa.array(v, t) for v, t in zip(out, types)], ["key", "mark", "lo", "hi"])

    def work(batches):
        key, group, out = None, [], [[], [], [], []]
        for batch in batches:
            for k, mark, around, twice in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if k != key:
                    if group:
                        flush(key, group, out)
                    key, group = k, []
                group.append((mark, around, twice))
            if len(out[0]) > 20_000:
                yield batch_of(out)
                out = [[], [], [], []]
        if group:
            flush(key, group, out)
        yield batch_of(out)

    return map_arrow(distinct, work, "key long, mark long, lo int, hi int")


def string_rows(distinct: DataFrame) -> DataFrame:
    """Rows (key, mark, around) -> a row (h1, h2, key, mark, d, sure) per 200-byte string; d bytes of it lie before the anchor."""

    def work(batches):
        import xxhash

        met = _Met()
        for batch in batches:
            out = [[], [], [], [], []]
            for key, mark, b in zip(*(batch.column(c).to_pylist() for c in ("key", "mark", "around"))):
                left = int.from_bytes(b[:2], "big")
                for at in range(2, len(b) - LENGTH + 1):
                    h = xxhash.xxh3_128_digest(b[at : at + LENGTH])
                    for column, v in zip(out, (int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), key, mark, left + 2 - at)):
                        column.append(v)
            sure = met.sure(list(zip(out[0], out[1], out[2], out[4])), out[3])
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield _arrow([*(pa.array(v, t) for v, t in zip(out, types)), pa.array(sure, pa.bool_())], ["h1", "h2", "key", "mark", "d", "sure"])

    return map_arrow(distinct, work, "h1 long, h2 long, key long, mark long, d int, sure boolean")


def grouped_runs(distinct: DataFrame) -> DataFrame:
    """What ``sorted_runs`` gives, for keys of any number of surroundings: repeated strings found by their 128-bit hashes."""
    # with key and d: a string that holds two anchors is one place, met once under each
    found = repeated(string_rows(distinct.select("key", "mark", "around")), ["h1", "h2", "key", "d"], ["mark"])
    some = found.groupBy("key", "mark").agg((-F.max("d")).alias("lo"), (F.lit(LENGTH) - F.min("d")).alias("hi"))
    left = F.conv(F.hex(F.substring("around", 1, 2)), 16, 10).cast("int")
    size = F.octet_length("around") - 2
    whole = distinct.where("twice").where(size >= LENGTH).select("key", "mark", (-left).alias("lo"), (size - left).alias("hi"))
    return some.union(whole).groupBy("key", "mark").agg(F.min("lo").cast("int").alias("lo"), F.max("hi").cast("int").alias("hi"))


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_runs(texts: DataFrame, sorted_most: int = SORTED_MOST) -> DataFrame:
    """texts (tid, text) -> tid, runs: one row per text that has repeats; runs are array<struct<a, b>> in bytes."""
    met = repeated(anchor_rows(texts), ["key"], ["tid", "place"])
    hits = materialize(met.groupBy("tid").agg(F.collect_set(F.struct("place", "key")).alias("hits")), "anchor-hits")
    around = materialize(surroundings(texts.join(hits, "tid")), "anchor-surroundings")
    rows = around.select("key", "mark", "tid", "place").distinct()
    counts = rows.groupBy("key", "mark").agg((F.count(F.lit(1)) > 1).alias("twice"))
    distinct = around.where("around IS NOT NULL").groupBy("key", "mark").agg(F.first("around").alias("around")).join(counts, ["key", "mark"])
    # at least as many as the distinct ones, since each task sends its own; read from two narrow columns
    large = materialize(around.where("fresh").groupBy("key").count().where(F.col("count") > sorted_most).select("key"), "anchor-large-keys")
    any_large = not large.isEmpty()
    few = distinct.join(large, "key", "left_anti") if any_large else distinct
    together = few.select("key", "mark", "around", "twice").repartition("key").sortWithinPartitions("key")
    runs = sorted_runs(together)
    if any_large:
        runs = runs.union(grouped_runs(materialize(distinct.join(large, "key", "left_semi"), "anchor-large")))
    runs = materialize(runs, "anchor-runs")
    placed = rows.join(runs, ["key", "mark"]).select("tid", (F.col("place") + F.col("lo")).alias("a"), (F.col("place") + F.col("hi")).alias("b"))
    copies = texts.where(F.octet_length("text") >= LENGTH).groupBy("tid").agg(F.count(F.lit(1)).alias("c"), F.max(F.octet_length("text")).alias("b")).where("c > 1")
    everything = placed.union(copies.select("tid", F.lit(0).alias("a"), F.col("b").cast("int")))
    return materialize(everything.groupBy("tid").agg(F.collect_list(F.struct("a", "b")).alias("runs")), "text-runs")


def with_id(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tid", F.xxhash64("text", F.reverse("text")))


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, runs (merged) and kept (binary) per row; the remaining bytes may split a character."""
    joined = _joined(docs)

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                done = [_cut(t, r) for t, r in zip(part.column("text").to_pylist(), part.column("runs").to_pylist())]
                runs = pa.array([[{"a": a, "b": b} for a, b in d[1]] for d in done], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
                yield _arrow([part.column("doc_id"), runs, pa.array([d[2] for d in done], pa.binary())], ["doc_id", "runs", "kept"])

    return map_arrow(joined, work, "doc_id long, runs array<struct<a:int,b:int>>, kept binary")


def _joined(docs: DataFrame) -> DataFrame:
    own = with_id(docs.select("doc_id", "text"))
    return own.join(find_runs(own.select("tid", "text")), "tid", "left").select("doc_id", "text", "runs")


def _cut(text: str | None, runs) -> tuple[int, list[tuple[int, int]], bytes]:
    b = (text or "").encode("utf-8", "surrogatepass")
    spans = merge([(r["a"], r["b"]) for r in runs or ()])
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(b[at:lo])
        at = hi
    return len(b), spans, b"".join(kept) + b[at:]


def digest(docs: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            for part in slices(batch):
                done = [_cut(t, r) for t, r in zip(part.column("text").to_pylist(), part.column("runs").to_pylist())]
                n = [pa.array(v, pa.int64()) for v in ([d[0] for d in done], [d[0] - len(d[2]) for d in done], [len(d[1]) for d in done])]
                yield _arrow([part.column("doc_id"), *n, pa.array([hashlib.sha256(d[2]).hexdigest() for d in done], pa.string())], [x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(_joined(docs), work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


#: Bytes as pairs of hexadecimal digits; strings are grouped by their MD5.
ORACLE = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, k, md5(substr(h, 2 * k + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS k FROM texts)),
again AS (SELECT m FROM strings GROUP BY m HAVING count(*) > 1),
steps AS (SELECT doc_id, k, coalesce(k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) > 200, true) AS is_new FROM strings SEMI JOIN again USING (m)),
numbered AS (SELECT doc_id, k, sum(CAST(is_new AS INT)) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM steps),
spans AS (SELECT doc_id, min(k) AS lo, max(k) + 200 AS hi FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS past FROM spans),
cut AS (
  SELECT doc_id, sum(hi - lo) AS removed, count(*) AS n, max(hi) AS last, string_agg(substr(h, 2 * past + 1, 2 * (lo - past)), '' ORDER BY lo) AS kept
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""
