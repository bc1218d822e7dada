"""Quality rules: word and line counts, and tokeniser fertility in bands by language or script.

Fertility of a text, over its words: characters per token of a byte-level vocabulary, share of characters for which a
sentence-piece vocabulary falls back to bytes, and entropy of the token distribution in bits.  A text outside the band of its language (or, where the
language is unknown, of its main script) is rejected.  Each distinct word is tokenised once per worker, with a leading space.

Defined results: null or empty text has zero counts, base_failed true, kept false, and null measures; the entropy band applies to
the entropy over log2 of the number of tokens it could have at most, by size class; repeated rows get equal
results; a missing ``lang`` column counts as null.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, combine, kept, map_arrow, mix64, slices, sums, table, text_bytes, word_hashes
from .tokencount import CACHE_WORDS, counter, vocabulary_path

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
#: Evenness falls with the length of a text, so its bound goes by size class: up to so many tokens each, then all longer texts.
SIZES = (128, 256, 512, 1024)
#: ``derive_bands`` puts bounds at this outer share of clean texts; a size class of fewer than FEW texts takes the next larger one's bound.
OUTER, FEW = 0.001, 20
#: (least, most characters per token; most byte-fallback share; least evenness of tokens by size class), by language, else by script.
#: Languages: ``derive_bands`` of the texts of sf0.1 labelled clean.  Scripts have no labelled texts: Latin takes the least evenness of
#: its languages, all else is a wide guess.
BANDS = {
    "en": (2.106, 2.47, 0.02, (0.825, 0.768, 0.713, 0.673, 0.67)),
    "de": (1.876, 2.183, 0.02, (0.756, 0.756, 0.704, 0.654, 0.65)),
    "fr": (1.706, 2.074, 0.02, (0.746, 0.746, 0.685, 0.638, 0.637)),
    "es": (1.643, 1.994, 0.02, (0.723, 0.723, 0.677, 0.64, 0.64)),
    "script:latin": (1.3, 7.0, 0.05, (0.723, 0.723, 0.677, 0.638, 0.637)),
    "script:cyrillic": (0.6, 6.0, 0.1, (0.5, 0.5, 0.5, 0.5, 0.5)),
    "script:other": (0.2, 6.0, 0.6, (0.4, 0.4, 0.4, 0.4, 0.4)),
}
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, fallback_share double, token_evenness double"


class Fertility(WordTable):
    """word bytes -> (tokens, characters, characters that fall back to bytes, where its token ids begin in ``flat``)."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.tok = counter(byte_path)
        sp = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.pieces = sp
        self.is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
        # words of characters that are pieces themselves never fall back; the others are given to the library
        self.own = frozenset(p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if len(p) == 1)
        super().__init__(self.measure, 4, limit=CACHE_WORDS, dtype=np.int64)

    def clear(self) -> None:
        super().clear()
        self.flat = np.zeros(1 << 16, np.int64)
        self.used = 0

    def fallen(self, word: str) -> int:
        """Byte pieces that the library gives for a word, over the bytes of a character: characters that fall back."""
        ids = np.array(self.pieces.encode(word), np.int64)
        n = int(self.is_byte[ids].sum()) if len(ids) else 0
        return min(len(word), -(-n * len(word) // max(1, len(word.encode("utf-8", "surrogatepass"))))) if n else 0

    def measure(self, words: list[bytes]) -> np.ndarray:
        texts = [w.decode("utf-8", "replace") for w in words]
        encode, find, own = self.tok.encode, self.tok.find, self.own
        ids = [encode(b" " + w) if t.isalpha() else [i for p in find(" " + t) for i in encode(p.encode())] for w, t in zip(words, texts)]
        n = np.array(list(map(len, ids)), dtype=np.int64)
        total = int(n.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * total, np.int64)])
        self.flat[self.used : self.used + total] = list(chain.from_iterable(ids))
        start = self.used + np.cumsum(n) - n
        self.used += total
        size = np.array(list(map(len, texts)), dtype=np.int64)
        fallback = [0 if own.issuperset(t) else self.fallen(t) for t in texts]
        return np.stack([n, size, np.array(fallback, dtype=np.int64), start], axis=1)


def fertility(byte_path: str, piece_path: str) -> Fertility:
    return kept(("fertility", byte_path, piece_path), lambda: Fertility(byte_path, piece_path))


def repeated_words(hashes: np.ndarray, counts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per row, words inside windows of ``width`` words that are found twice or more in the row."""
    out = np.zeros(len(counts), np.int64)
    keys = combine(hashes, width)
    if not len(keys):
        return out
    row = np.repeat(np.arange(len(counts)), counts)
    same = row[: len(keys)] == row[width - 1 :]
    at = np.flatnonzero(same)
    keys = keys[at] ^ mix64(row[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    twin = np.zeros(len(k), bool)
    eq = k[1:] == k[:-1]
    twin[1:] |= eq
    twin[:-1] |= eq
    hit = at[order[twin]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    covered = (np.cumsum(cover[:-1]) > 0).astype(np.int64)
    return sums(covered, counts)


def main_script(text: str) -> str:
    latin = cyrillic = other = 0
    for ch in set(text):
        if ch.isalpha():
            o = ord(ch)
            n = text.count(ch)
            if o < 0x250:
                latin += n
            elif 0x400 <= o < 0x530:
                cyrillic += n
            else:
                other += n
    return "script:" + max((("latin", latin), ("cyrillic", cyrillic), ("other", other)), key=lambda x: x[1])[0]


def rules(docs: DataFrame, byte_path: str, piece_path: str, bands: dict | None = None) -> DataFrame:
    bands = bands or BANDS

    def work(batches):
        f = fertility(byte_path, piece_path)
        for batch in batches:
            for part in slices(batch):
                yield measure(part, f, bands)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return map_arrow(docs.select("doc_id", "text", lang.alias("lang")), work, SCHEMA)


def derive_bands(measured: DataFrame, clean: DataFrame, outer: float = OUTER) -> dict:
    """Bands by language, from rows of ``rules``: ``clean`` (doc_id, lang) names the texts that bands are to hold but for outer shares."""
    size = F.round(F.col("word_chars") / F.col("chars_per_token"))
    n_class = sum((size > s).cast("int") for s in SIZES)
    rows = measured.where("NOT base_failed").join(clean.select("doc_id", "lang").distinct(), "doc_id").withColumn("class", n_class)
    ends = {r.lang: r for r in rows.groupBy("lang").agg(F.percentile("chars_per_token", F.lit(outer)).alias("lo"), F.percentile("chars_per_token", F.lit(1 - outer)).alias("hi")).collect()}
    least = {(r.lang, r["class"]): r.e for r in rows.groupBy("lang", "class").agg(F.count(F.lit(1)).alias("n"), F.percentile("token_evenness", F.lit(outer)).alias("e")).where(F.col("n") >= FEW).collect()}
    out = {}
    for lang, r in sorted(ends.items()):
        bound, by_class = 0.0, []
        for k in reversed(range(len(SIZES) + 1)):
            bound = least.get((lang, k), bound)
            by_class.append(math.floor(1000 * bound) / 1000)
        out[lang] = (math.floor(1000 * r.lo) / 1000, math.ceil(1000 * r.hi) / 1000, 0.02, tuple(reversed(by_class)))
    return out


def measure(part: pa.RecordBatch, f: Fertility, bands: dict) -> pa.RecordBatch:
    texts = [x or "" for x in part.column("text").to_pylist()]
    langs = part.column("lang").to_pylist()
    data, offsets = text_bytes(part.column("text"))
    hashes, counts = word_hashes(data, offsets, lower=False)
    raw = data.tobytes()
    words = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    word_chars = np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], dtype=np.int64)
    n_symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
    n_dup = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        n_dup.append(len(lines) - len(set(lines)))
    n_repeat = repeated_words(hashes, counts)
    ids = f.ids([w for ws in words for w in ws])
    v = f.values[ids].astype(np.int64)
    n_tok, n_own, n_fall = (sums(v[:, k], counts) for k in range(3))
    take = np.repeat(v[:, 3] - (np.cumsum(v[:, 0]) - v[:, 0]), v[:, 0]) + np.arange(int(v[:, 0].sum()))
    key = np.repeat(np.arange(len(texts), dtype=np.int64), n_tok) << 32 | f.flat[take]
    key.sort()
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    c = np.diff(np.append(head, len(key)))
    weight = np.zeros(len(texts))
    np.add.at(weight, key[head] >> 32, c * np.log2(np.maximum(c, 1)))
    has = n_tok > 0
    safe = np.maximum(n_tok, 1)
    entropy = np.where(has, np.log2(safe) - weight / safe, 0.0)
    even = entropy / np.log2(np.minimum(np.maximum(n_tok, 2), 1000))
    cpt, share = word_chars / safe, n_fall / np.maximum(n_own, 1)
    failed = (counts < MIN_WORDS) | (100 * n_repeat > 30 * counts)
    size = np.searchsorted(SIZES, n_tok)
    passed = []
    for i, t in enumerate(texts):
        ok = not failed[i]
        if ok:
            lo, hi, most, least = bands[langs[i]] if langs[i] in bands else bands[main_script(t)]
            ok = bool(lo <= cpt[i] <= hi and share[i] <= most and even[i] >= least[size[i]])
        passed.append(ok)
    f8 = lambda x: pa.array(x, pa.float64(), mask=~has)
    i8 = lambda x: pa.array(x, pa.int64())
    cols = [part.column("doc_id"), i8(counts), i8(word_chars), i8(n_symbols), i8(n_dup), i8(n_repeat), pa.array(failed), pa.array(passed, pa.bool_()), f8(cpt), f8(share), f8(even)]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"), vocabulary_path(BYTE_VOCABULARY), vocabulary_path(PIECE_VOCABULARY))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their columns as they were; each row by its own text."""
    paths = vocabulary_path(BYTE_VOCABULARY), vocabulary_path(PIECE_VOCABULARY)

    def work(batches):
        f = fertility(*paths)
        for batch in batches:
            for part in slices(batch):
                lang = part.column("lang").cast(pa.string()) if "lang" in part.schema.names else pa.nulls(part.num_rows, pa.string())
                asked = pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), lang], ["doc_id", "text", "lang"])
                yield part.filter(measure(asked, f, BANDS).column("kept"))

    return map_arrow(docs, work, docs.schema)
