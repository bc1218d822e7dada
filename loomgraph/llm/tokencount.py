"""Token counts without token ids.

Texts are cut into pre-tokens with the vocabulary's own pattern.  Each distinct pre-token is given to the tokenizer once and its
number of pieces kept; a document's count is the sum, over its pre-tokens, of frequency times pieces.  ``count_tokens`` joins
frequencies with piece counts inside each Python worker (a hash lookup in a bounded table of distinct pre-tokens);
``count_tokens_joined`` does it with a frequency table and a global join, which shuffles a row per document and distinct pre-token,
several times the input (figures in the README).  Both give the same rows.

Defined results: null text counts as empty (0 bytes, 0 tokens); special strings inside a text are one token each, as the library
does by default; repeated rows each give a row; an empty table gives none.  Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, kept, map_arrow, materialize, slices, sums, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Distinct words a worker remembers at most.
CACHE_WORDS = 1_000_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Pieces of byte-level BPE pre-tokens, for a ``.json`` vocabulary.

    Its tokens and ranks go into a rank-based merger, which gives the library's pieces of one pre-token at a tenth of its cost
    (tests hold it against the library).  A text is cut at spaces first: between single spaces the pattern works on each chunk
    alone, so the pre-tokens of a distinct chunk are looked up once; texts where spaces meet other white space go through the
    pattern as a whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_of_char()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.find = regex.compile(PATTERN).findall
        self.special = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if special else None
        self.uneven = re.compile(r"  |\s \s").search
        self.chunks = WordTable(self._count, 1, limit=CACHE_WORDS)

    def _count(self, chunks: list[str]) -> np.ndarray:
        """Pieces of each distinct chunk: mostly one pre-token, a word with the space before it."""
        encode, find = self.encode, self.find
        return np.array([len(encode(c.encode())) if c[1:].isalpha() and c[0] == " " else sum(len(encode(p.encode())) for p in find(c)) for c in chunks], dtype=np.int32).reshape(-1, 1)

    def _plain(self, text: str) -> list[str]:
        """Chunks whose counts add up to the text's."""
        if self.uneven(text):
            return self.find(text)
        head, *rest = text.split(" ")
        return [head] + [" " + c for c in rest]

    def split(self, text: str) -> tuple[list[str], int]:
        """Chunks, and the number of special strings between them."""
        if self.cut is None or not any(x in text for x in self.special):
            return self._plain(text), 0
        parts = self.cut(text)
        return [c for x in parts[::2] for c in self._plain(x)], len(parts) // 2

    def counts(self, texts: list[str]) -> np.ndarray:
        got = [self.split(t) for t in texts]
        flat = [c for chunks, _ in got for c in chunks]
        ids = self.chunks.ids(flat)
        return sums(self.chunks.values[ids, 0], np.array([len(c) for c, _ in got], dtype=np.int64)) + np.array([n for _, n in got], dtype=np.int64)


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def counter(path: str) -> PieceCounter:
    return kept(("counter", path), lambda: PieceCounter(path))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    def work(batches):
        count = counter(path)
        for batch in batches:
            for part in slices(batch):
                texts = [x or "" for x in part.column("text").to_pylist()]
                n = count.counts(texts)
                size = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(docs.select("doc_id", "text"), work, SCHEMA)


def frequencies(docs: DataFrame, path: str) -> DataFrame:
    """row, doc_id, n_bytes, piece, n: a row per document and distinct pre-token; special strings and the document itself have a null
    piece and the number of special strings."""

    def work(batches):
        from collections import Counter

        count = counter(path)
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[] for _ in range(5)]
                for row, i, t in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                    t = t or ""
                    parts = count.cut(t) if count.cut else [t]
                    words = Counter(p for x in parts[::2] for p in count.find(x))
                    size = len(t.encode("utf-8", "surrogatepass"))
                    for column, v in zip(out, ([row] * (len(words) + 1), [i] * (len(words) + 1), [size] * (len(words) + 1), [None, *words], [len(parts) // 2, *words.values()])):
                        column += v
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["row", "doc_id", "n_bytes", "piece", "n"])

    return map_arrow(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), work, "row long, doc_id long, n_bytes long, piece string, n long")


def pieces(words: DataFrame, path: str) -> DataFrame:
    """piece, tokens: each distinct pre-token given to the tokenizer once."""

    def work(batches):
        encode = counter(path).encode
        for batch in batches:
            got = batch.column("piece").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array([len(encode(w.encode("utf-8", "surrogatepass"))) for w in got], pa.int64())], ["piece", "tokens"])

    return map_arrow(words.select("piece").where("piece IS NOT NULL").distinct(), work, "piece string, tokens long")


def count_tokens_joined(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """The rows of ``count_tokens``, by a global join of the frequency table with the pieces of each distinct pre-token."""
    freq = materialize(frequencies(docs, path), "frequencies")
    n = F.sum(F.col("n") * F.coalesce("tokens", F.lit(1)))
    out = freq.join(pieces(freq, path), "piece", "left").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), n.alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
