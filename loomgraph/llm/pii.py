"""Personal data: base spans by fixed formats, more spans by candidate gradient boosting.

Base spans (email, ip, card, phone) follow the contract's formats exactly and always stay.  High-recall generators then propose
further, overlapping spans (secrets and dotted tokens as a whole, key blocks, e-mail addresses written out, long numbers, account
numbers in groups); boosted trees score each from its format and context, the score is calibrated (Platt, by kind) on held-out
examples, and spans at or above the threshold of their kind are added as kinds ``secret``, ``contact``, ``number`` and ``account``,
best score first (the longer of those that agree to a tenth), leaving out what overlaps a base span or a better one.  The threshold of a kind is the
least score at which ``PRECISION`` of the held-out examples at or above it are right.

The trees are fitted here on ``TRAIN_ROWS`` seeded examples written by rule (formats in running text against look-alikes: hashes in
paths and behind cue words, years, sizes, versions, long words, dotted names, tables of numbers; one example in ``MIXED`` stands in the
other's context), so fitting reads no table and is the same everywhere.

Matching is linear in the text: the e-mail search goes from each @ outward, the others never start twice in one run of digits.

Defined results: null text counts as empty; repeated rows get equal results; offsets are code points, ends exclusive; other columns
are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table

KINDS = ("email", "ip", "card", "phone", "secret", "contact", "number", "account")
TRAIN_ROWS = 6000
SEED = 11
#: One example in so many has a context of the other class, so that formats count too.
MIXED = 12
#: Share of right spans that a kind's threshold is to give on held-out examples, and the least threshold.
PRECISION, LEAST = 0.98, 0.5
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = ord(ch) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            end = m.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", b, e) for b, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


#: Generators, by kind: each proposes more than it should.
GENERATORS = (
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9_/+-]{16,}+(?:={1,2}(?![A-Za-z0-9=]))?")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+){2}(?![A-Za-z0-9_-])")),
    ("secret", re.compile(r"-----BEGIN (?:[A-Z]+ )*KEY-----[A-Za-z0-9+/=\s]++-----END (?:[A-Z]+ )*KEY-----")),
    ("contact", re.compile(r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++ ?(?:\[at\]|\(at\)) ?[a-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[a-z0-9-]++)+")),
    ("number", re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ ./()-]{0,2}[0-9]){7,}(?![0-9A-Za-z])")),
    ("account", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
)
_ORDER = tuple(dict.fromkeys(k for k, _ in GENERATORS))
_NEEDS = {"secret": _DIGIT, "account": _DIGIT, "contact": re.compile(r"(?i)[\[(]at[\])]"), "number": _DIGIT}
#: Cue words that make personal data likelier before a span.
CUES = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_ -]?key|key|bearer|auth|ssn|iban|account|passport|tel|telephone|phone|mobile|fax|call|card|visa)\b")
LOOKALIKE_CUES = re.compile(r"(?i)\b(?:commit|sha1|sha256|md5|hash|checksum|rev|version|isbn|issn|doi|serial|size|bytes|total|year|page|id|rfc|build)\b")


def candidates(text: str):
    for kind, pattern in GENERATORS:
        if _NEEDS[kind].search(text) is not None:
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end()


def iban(span: str) -> bool:
    """Whether the check digits of an account number hold (ISO 7064, modulo 97)."""
    s = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, begin: int, end: int) -> list[float]:
    """Format and context of a span."""
    s, before, after = text[begin:end], text[max(0, begin - 24) : begin], text[end : end + 8]
    n = len(s)
    digits = sum(ch.isdigit() for ch in s)
    upper = sum(ch.isupper() for ch in s)
    alpha = sum(ch.isalpha() for ch in s)
    hexes = sum(ch in "0123456789abcdefABCDEF" for ch in s)
    freq = [s.count(ch) / n for ch in set(s)]
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
    return [
        float(_ORDER.index(kind)), min(n, 128), float(s.startswith("-----")), float(s.count(".")), float(iban(s)) if kind == "account" else 0.0, digits, digits / n, upper / n, alpha / n, hexes / n,
        -sum(p * math.log2(p) for p in freq), turns / n, sum(not ch.isalnum() for ch in s), float(s.count("/")), float(s.count("-")),
        float(CUES.search(before) is not None), float(LOOKALIKE_CUES.search(before) is not None), float(before.rstrip().endswith(("=", ":"))),
        float(before.endswith(("'", '"'))), float(after[:1] in ("'", '"')), float(before.endswith("/") or after[:1] == "/"), float(luhn("".join(c for c in s if c.isdigit())) if digits else 0),
    ]


def examples(n: int, seed: int):
    """Labelled candidates from seeded templates."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, dig = "0123456789abcdef", "0123456789"
    base62 = dig + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    b64 = base62 + "-_"

    def account():
        body = pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r.choice([0, 4])) + pick(dig, r.choice([12, 14, 18]))
        land = r.choice(["GB", "DE", "FR", "ES", "NL", "IT"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        whole = f"{land}{check:02d}{body}"
        return " ".join(whole[k : k + 4] for k in range(0, len(whole), 4)) if r.random() < 0.6 else whole

    positive = (
        lambda: (r.choice(["token ", "Bearer ", "jwt=", "cookie: "]), f"ey{pick(b64, r.randint(14, 40))}.ey{pick(b64, r.randint(20, 120))}.{pick(b64, r.randint(20, 60))}", r.choice([" ", '"'])),
        lambda: (r.choice(["", "key:\n", "the file has\n"]), f"-----BEGIN {r.choice(['', 'RSA ', 'EC '])}PRIVATE KEY-----\n{pick(r.choice([base62, 'Ab1', dig]), r.randint(20, 200))}\n-----END PRIVATE KEY-----", "\n"),
        lambda: (r.choice(["IBAN ", "iban: ", "account ", "pay to "]), account(), r.choice([" ", "."])),
        lambda: (f'{r.choice(["token", "secret", "password", "api_key", "API key", "auth", "key"])}{r.choice([" = ", "=", ": "])}{r.choice(["", chr(34), chr(39)])}', pick(r.choice([hexa, base62]), r.choice([20, 24, 32, 40, 64])), r.choice(["", '"', "'"])),
        lambda: (r.choice(["Bearer ", "sent with token ", "the key "]), pick(base62, r.choice([24, 32, 40])), " "),
        lambda: (r.choice(["write to ", "contact: ", "mail "]), f"{word()}.{word()} [at] {word()} [dot] com", " "),
        lambda: (r.choice(["ask ", "from "]), f"{word()}(at){word()}.{r.choice(['org', 'com', 'net'])}", "."),
        lambda: (r.choice(["tel ", "phone: ", "call ", "mobile "]), f"({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)}"[1:], " "),
        lambda: (r.choice(["SSN ", "ssn: ", "account ", "IBAN "]), f"{pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}", "."),
    )
    negative = (
        lambda: (r.choice(["import ", "call ", f"{word()} "]), ".".join(word() + word() + word() + word() for _ in range(3)), r.choice([" ", "("])),
        lambda: (f"{word()} ", f"{word()}{word()}-{word()}{pick(dig, 2)}.{word()}{word()}{word()}.{word()}{word()}{word()}", " "),
        lambda: (r.choice(["model ", "part ", "serial ", f"{word()} "]), f"{pick('ABCDEFGHKLMNPRST', 2)}{pick(dig, 2)} {pick(dig, 4)} {pick(dig, 4)}", " "),
        lambda: (r.choice(["sha512: ", "etag ", "digest "]), pick(base62, r.choice([22, 43, 86])), " "),
        lambda: (r.choice(["rows ", "values ", "table "]), "  ".join(str(r.randint(10, 9999)) for _ in range(5)), " "),
        lambda: (f"{r.choice(['commit ', 'sha256 ', 'checksum ', 'md5: ', 'rev '])}", pick(hexa, r.choice([32, 40, 64])), " "),
        lambda: (f"/{word()}/", pick(hexa, r.choice([20, 32, 40])), f"/{word()}"),
        lambda: (f"{word()} ", "-".join(word() for _ in range(5)) + pick(dig, r.choice([1, 2, 4])), " "),
        lambda: (f"{word()} ", "_".join(word() for _ in range(4)) + pick(dig, 2), " "),
        lambda: (f"{word()} ", f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", " "),
        lambda: (f"{word()} ", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}", " "),
        lambda: (r.choice(["size ", "total ", "isbn ", "serial ", "page ", f"{word()} "]), pick(dig, r.randint(8, 20)), " "),
        lambda: (f"{word()} ", " ".join(pick(dig, r.randint(1, 3)) for _ in range(6)), f" {word()}"),
        lambda: (f"{word()} ", f"{word()}{pick(dig, 2)}{word()}{word()}{word()}", " "),
    )
    for _ in range(n):
        good = r.random() < 0.4
        before, span, after = r.choice(positive if good else negative)()
        if r.random() < 1 / MIXED:
            before = r.choice(negative if good else positive)()[0]
        lead = " ".join(word() for _ in range(3)) + " "
        text = f"{lead}{before}{span}{after}{word()} {word()}"
        b, e = len(lead + before), len(lead + before + span)
        for kind, s, t in candidates(text):
            if s < e and t > b:
                yield text, kind, s, t, good


class Trees:
    """Gradient-boosted regression trees on the logistic loss, with histogram splits, and a Platt scale."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1)
        p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.bias = math.log(p0 / (1 - p0))
        f = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self.rate * self._apply(tree, binned)
        return self

    def _grow(self, x, g, h, rows, depth):
        value = float(g[rows].sum() / (h[rows].sum() + 1.0))
        if depth == 0 or len(rows) < 20:
            return value
        best = (1e-6, None, None)
        whole_g, whole_h = g[rows].sum(), h[rows].sum()
        for j in range(x.shape[1]):
            n = len(self.edges[j]) + 1
            left_g = np.cumsum(np.bincount(x[rows, j], g[rows], n))[:-1]
            left_h = np.cumsum(np.bincount(x[rows, j], h[rows], n))[:-1]
            if len(left_g):
                gain = left_g**2 / (left_h + 1) + (whole_g - left_g) ** 2 / (whole_h - left_h + 1) - whole_g**2 / (whole_h + 1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] is None:
            return value
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1))

    def _apply(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, k, left, right = tree
        return np.where(x[:, j] <= k, self._apply(left, x), self._apply(right, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1)
        return self.bias + self.rate * sum((self._apply(t, binned) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, kinds: np.ndarray) -> Trees:
        """Platt scale and threshold of each kind, from held-out rows."""
        m = self.margin(x)
        self.scale = {}
        self.threshold = {}
        for kind in np.unique(kinds).tolist():
            mine = kinds == kind
            mk, yk, a, b = m[mine], y[mine], 1.0, 0.0
            for _ in range(300):  # gradient steps on two parameters, drawn towards the identity by one row's weight
                p = 1 / (1 + np.exp(-(a * mk + b)))
                a -= 0.05 * float(((p - yk) * mk).mean() + (a - 1) / len(yk))
                b -= 0.05 * float((p - yk).mean() + b / len(yk))
            self.scale[kind] = a, b
            p = 1 / (1 + np.exp(-(a * mk + b)))
            order = np.argsort(-p, kind="stable")
            right = np.cumsum(yk[order]) / np.arange(1, len(yk) + 1)
            last = np.append(p[order][1:] < p[order][:-1], True)  # a threshold takes all rows of its score
            good = np.flatnonzero(last & (right >= PRECISION))
            self.threshold[kind] = max(LEAST, float(p[order][good[-1]])) if len(good) else 1.0
        return self

    def probability(self, x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        a, b = np.array([self.scale.get(k, (1.0, 0.0)) for k in kinds.tolist()]).reshape(-1, 2).T
        return 1 / (1 + np.exp(-(a * self.margin(x) + b)))


def measured(rows: int, seed: int):
    """(features, labels, kinds) of seeded examples."""
    got = list(examples(rows, seed))
    return np.array([features(t, k, b, e) for t, k, b, e, _ in got]), np.array([float(g) for *_, g in got]), np.array([k for _, k, *_ in got])


@lru_cache(maxsize=1)
def model(rows: int = TRAIN_ROWS, seed: int = SEED) -> Trees:
    x, y, kinds = measured(rows, seed)
    held = np.arange(len(y)) % 4 == 0
    return Trees().fit(x[~held], y[~held]).calibrate(x[held], y[held], kinds[held])


def all_spans(text: str, trees: Trees) -> tuple[list, list]:
    """(base spans, base and added spans), each by kind as listed, then start."""
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    base = sorted(base_spans(text), key=order)
    found = list(candidates(text))
    if not found:
        return base, base
    taken = sorted((b, e) for _, b, e in base)
    p = trees.probability(np.array([features(text, *c) for c in found]), np.array([c[0] for c in found]))
    free = _Free(taken)
    best = sorted((-round(x, 1), c[1] - c[2], -x, c) for x, c in zip(p.tolist(), found) if x >= trees.threshold.get(c[0], 1.0))
    extra = [c for *_, c in best if free.take(c[1], c[2])]
    return base, sorted(base + extra, key=order)


class _Free:
    """Which stretches of a text no span has taken yet."""

    def __init__(self, spans: list[tuple[int, int]]):
        import bisect

        self.bisect = bisect.bisect_left
        self.spans: list[tuple[int, int]] = []
        for b, e in spans:  # base spans of different kinds may overlap
            if self.spans and b < self.spans[-1][1]:
                self.spans[-1] = (self.spans[-1][0], max(e, self.spans[-1][1]))
            else:
                self.spans.append((b, e))

    def take(self, b: int, e: int) -> bool:
        i = self.bisect(self.spans, (b, e))
        if i < len(self.spans) and self.spans[i][0] < e or i and self.spans[i - 1][1] > b:
            return False
        self.spans.insert(i, (b, e))
        return True


def join_spans(spans) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def find(docs: DataFrame) -> DataFrame:
    def work(batches):
        trees = model()
        for batch in batches:
            for part in slices(batch):
                got = [all_spans(t or "", trees) for t in part.column("text").to_pylist()]
                n = [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS[:4]]
                digest = pa.array([hashlib.sha256(join_spans(base).encode()).hexdigest() for base, _ in got], pa.string())
                spans = pa.array([join_spans(s) for _, s in got], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *n, digest, spans], [x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select("doc_id", "text"), work, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]`` in text; other columns as they were (n_chars too is made anew if there)."""
    names = docs.columns

    def work(batches):
        trees = model()
        for batch in batches:
            for part in slices(batch):
                out = []
                for t in part.column("text").to_pylist():
                    if t:
                        pieces, at = [], 0
                        for k, b, e in sorted(all_spans(t, trees)[1], key=lambda s: (s[1], -s[2])):
                            if b >= at:
                                pieces += [t[at:b], f"[{k.upper()}]"]
                            at = max(at, e)
                        t = "".join(pieces) + t[at:] if pieces else t
                    out.append(t)
                i = part.schema.get_field_index("text")
                yield part.set_column(i, part.schema.field(i), pa.array(out, part.schema.field(i).type))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = map_arrow(docs, work, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)
