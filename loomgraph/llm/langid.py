"""Language identification by cross-parsing entropy.

For each language the labelled text of a bounded sample is put into a suffix automaton.  Its transitions give, for every place of a
text, the longest piece ending there that occurs in the language's text; from these the text is cross-parsed: from the end of one
phrase, the next is the longest piece that occurs in the language's text.  The phrases, times the log of the language's text length (a
pointer into it costs that many bits), are the cross-parsing entropy of the text; the lowest language wins.

Texts are parsed whole, over words, numbers and punctuation: letters are lower-cased, runs of white space are one space, digits are
one character; a space stands before and after.  The automaton walks many stretches of texts at once, each begun early enough that
what it has matched doesn't depend on where it began; where that fails, the stretch is walked again from further back.

Training sample: per language labelled rows by hash of doc_id, of any length, each text's first ``MAX_CHARS`` characters, until they hold
``CHARS`` characters (the last row whole) or are ``ROWS`` rows; so at most CHARS + MAX_CHARS characters a language.

Defined results: null text, or text without a letter, is ``und`` with score 0; without training rows everything is ``und``; ties go to
the language that sorts first; repeated rows get equal results; a row with null doc_id is no training row and, in the query, not held
out; an empty table gives none; other columns are never read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_mod, map_arrow, slices, table

CHARS, MAX_CHARS, ROWS = 40_000, 2000, 4000
SCHEMA = "doc_id long, lang_pred string, score double"
#: Characters walked as one stretch, and how far before it the walk begins at first (the shorter of the two).
STRETCH, LEAD = 192, 32


def normalized(text: str) -> str:
    """Lower case, white space as single spaces, digits as 0; a space at either end."""
    return " " + " ".join(re.sub(r"\d", "0", text.lower()).split()) + " "


class SuffixAutomaton:
    """All substrings of a text; ``next[state][char]`` leads on, state 0 is the empty string."""

    def __init__(self, text: str):
        nxt: list[dict] = [{}]
        link, length, last = [-1], [0], 0
        for ch in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and ch not in nxt[p]:
                nxt[p][ch] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(ch) == q:
                        nxt[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next, self.link, self.length = nxt, link, length


class Parser:
    """Cross-parses texts against one language's text."""

    def __init__(self, text: str):
        a = SuffixAutomaton(text)
        letters = sorted(set(text))
        self.code = {ord(ch): k for k, ch in enumerate(letters)}
        self.size = len(letters) + 1  # the last stands for characters that the text lacks
        self.lut = np.full(0x3000, len(letters), np.int64)
        for ch, k in self.code.items():
            if ch < len(self.lut):
                self.lut[ch] = k
        # to[state, char]: the state after the longest suffix that goes on (0, the empty match, if none does); most[state, char]: that
        # suffix's length with the character, which bounds the match from then on; no bound where the whole match goes on
        n = len(a.next)
        to = np.zeros((n, self.size), np.int64)
        most = np.zeros((n, self.size), np.int64)
        link, length = np.array(a.link), np.array(a.length, np.int32)
        own_state = np.array([s for s, m in enumerate(a.next) for _ in m], np.int64)
        own_code = np.array([self.code[ord(ch)] for m in a.next for ch in m], np.int64)
        own_to = np.array([t for m in a.next for t in m.values()], np.int64)
        has = np.zeros((n, self.size), bool)
        has[own_state, own_code] = True
        to[own_state, own_code] = own_to
        depth = np.zeros(n, np.int64)
        for s in np.argsort(length, kind="stable")[1:].tolist():
            depth[s] = depth[link[s]] + 1
        for d in range(1, int(depth.max()) + 1):
            s = np.flatnonzero(depth == d)
            up = link[s]
            to[s] = np.where(has[s], to[s], to[up])
            most[s] = np.where(has[up], length[up][:, None] + 1, most[up])
        # one number a move: the new state, as where its row begins, and above it the bound
        self.move = (np.where(has, np.int64(1) << 30, most) << 32 | to * self.size).ravel()
        # the same in half the memory, for walks of fewer than 1023 steps
        self.near = (np.where(has, 1023, np.minimum(most, 1023)) << 22 | to * self.size).astype(np.uint32).ravel() if n * self.size < 1 << 22 else None

    def codes(self, points: np.ndarray) -> np.ndarray:
        low = points < len(self.lut)
        out = self.lut[np.where(low, points, 0)]
        if not low.all():
            out[~low] = [self.code.get(p, self.size - 1) for p in points[~low].tolist()]
        return out

    def matched(self, codes: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray, lead: int) -> np.ndarray:
        """For each place of the stretches [begin, end): the length of the longest piece of the text from ``first`` on that ends there.

        All stretches go on together, each from ``lead`` characters before it; one whose match at its first place reaches back to
        where it was begun, inside the text, goes again from twice as far.
        """
        out = np.zeros(len(codes), np.int32)
        codes = codes.astype(np.uint8 if self.size <= 256 else np.uint32)
        todo, again = np.arange(len(begin)), False
        while len(todo):
            start = np.maximum(first[todo], begin[todo] - lead)
            order = np.argsort(start - end[todo], kind="stable")  # longest first
            todo, start = todo[order], start[order]
            span, before = end[todo] - start, begin[todo] - start
            live = np.searchsorted(-span, -np.arange(int(span[0])), side="left").tolist()
            move, bits, kind = (self.near, 22, np.uint32) if self.near is not None and len(live) < 1023 else (self.move, 32, np.int64)
            low, bits, one = kind((1 << bits) - 1), kind(bits), kind(1)
            state, size, at = np.zeros(len(todo), kind), np.zeros(len(todo), kind), start.copy()
            bad = np.zeros(len(todo), bool)
            marks = {int(x) for x in np.unique(before)}
            for j, n in enumerate(live):
                here, st, sz = at[:n], state[:n], size[:n]
                got = move[st + codes[here]]
                np.bitwise_and(got, low, out=st)
                np.minimum(sz + one, got >> bits, out=sz)
                # a place before ``begin`` belongs to the stretch before, which comes to it at a later step and overwrites this
                if again:
                    mine = before[:n] <= j
                    out[here[mine]] = sz[mine]
                else:
                    out[here] = sz
                if j in marks:  # a match that fills all places before may be longer than was seen
                    bad[:n] |= (before[:n] == j) & (sz == j + 1) & (start[:n] > first[todo[:n]])
                here += 1
            todo, again = todo[bad], True
            lead *= 2
        return out


class Layout:
    """Texts end to end, cut into stretches of about ``width`` places."""

    def __init__(self, offsets: np.ndarray, width: int = STRETCH):
        n = np.diff(offsets)
        parts = -(-n // width)
        owner = np.repeat(np.arange(len(n)), parts)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.offsets, self.first = offsets, offsets[:-1][owner]
        self.begin = self.first + k * width
        self.end = np.minimum(self.begin + width, offsets[1:][owner])
        self.places = np.arange(int(offsets[-1]))
        self.head, self.stop = np.repeat(offsets[:-1], n), np.repeat(offsets[1:], n)


def phrases(parser: Parser, points: np.ndarray, layout: Layout, lead: int = LEAD) -> np.ndarray:
    """Phrases of each text's greedy cross-parse; a character that the language lacks is a phrase of its own."""
    offsets = layout.offsets
    if not len(points):
        return np.zeros(len(offsets) - 1, np.int64)
    length = parser.matched(parser.codes(points), layout.first, layout.begin, layout.end, lead)
    # a piece from i on reaches the last j whose longest match begins at i or before; where these begin never falls
    head = np.maximum(layout.places - length + 1, layout.head)
    reach = np.cumsum(np.bincount(head, minlength=len(head))[: len(head)])
    leave = np.minimum(np.maximum(reach, layout.places + 1), layout.stop)
    # phrases from each place to the end of its stretch, and where the last of them leaves it: all stretches at once, from the back
    n = np.ones(len(leave), np.int32)
    order = np.argsort(layout.begin - layout.end, kind="stable")
    begin, end = layout.begin[order], layout.end[order]
    live = np.searchsorted(begin - end, -np.arange(int((end - begin)[0])), side="left").tolist()
    for j in reversed(range(len(live))):
        at = begin[: live[j]] + j
        to = leave[at]
        at, to = at[(inside := to < end[: live[j]])], to[inside]
        n[at] += n[to]
        leave[at] = leave[to]
    out = []
    for b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        total, i = 0, b
        while i < e:
            total += int(n[i])
            i = int(leave[i])
        out.append(total)
    return np.array(out, np.int64)


def fit(docs: DataFrame, allowed=None) -> dict[str, str]:
    """language -> normalised training text, from rows where ``allowed`` holds."""
    cut = F.substring("text", 1, MAX_CHARS)
    usable = F.col("lang").isNotNull() & cut.rlike("\\p{L}") & F.col("doc_id").isNotNull()
    rows = docs.where(usable if allowed is None else usable & allowed)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = rows.select("lang", "doc_id", F.length(cut).alias("n")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= ROWS)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = ranked.withColumn("before", before).where(F.col("before") < CHARS).select("lang", "doc_id").distinct()
    got = rows.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min(cut).alias("text"))
    texts: dict[str, list] = {}
    for r in got.collect():
        texts.setdefault(r.lang, []).append((r.doc_id, r.text))
    return {k: "".join(normalized(t)[:-1] for _, t in sorted(v)) + " " for k, v in sorted(texts.items())}


_loaded: dict = {}


def parsers(model: dict[str, str]) -> list[Parser]:
    key = hash(tuple(model.items()))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = [Parser(t) for t in model.values()]
    return _loaded[key]


def costs(texts: list[str], model: dict[str, str]) -> np.ndarray:
    """(texts, languages): bits of each text's cross-parse."""
    ready = [normalized(t) for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in ready]))).astype(np.int64)
    points = np.frombuffer("".join(ready).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    layout = Layout(offsets)
    return np.stack([phrases(p, points, layout) * math.log2(len(t) + 1) for p, t in zip(parsers(model), model.values())], axis=1)


def predict(docs: DataFrame, model: dict[str, str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most CHARS + MAX_CHARS characters a language

    def work(batches):
        letter = re.compile(r"[^\W\d_]").search
        langs = list(shared.value)
        for batch in batches:
            for part in slices(batch):
                texts = [x or "" for x in part.column("text").to_pylist()]
                und = np.array([not langs or letter(t) is None for t in texts])
                if langs:
                    cost = costs(texts, shared.value)
                    order = np.argsort(cost, axis=1, kind="stable")
                    best = np.take_along_axis(cost, order[:, :1], 1)[:, 0]
                    second = np.take_along_axis(cost, order[:, 1:2], 1)[:, 0] if len(langs) > 1 else 2 * best
                    names = ["und" if u else langs[k] for u, k in zip(und, order[:, 0])]
                    score = np.where(und, 0.0, second / (best + second))
                else:
                    names, score = ["und"] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", "text"), work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    out = predict(docs, fit(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
