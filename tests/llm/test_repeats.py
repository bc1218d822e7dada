import hashlib
import random

import numpy as np

from loomgraph.llm import repeats
from loomgraph.llm.deepshallow import deep_shallow, lcp


def test_sort_matches_sorted():
    r = random.Random(3)
    for _ in range(500):
        base = bytes(r.choice(b"ab") for _ in range(60))
        s = [base[: r.randint(0, 60)] + bytes(r.choice(b"ab") for _ in range(r.randint(0, 20))) for _ in range(r.randint(1, 40))]
        order, common = deep_shallow(s)
        got = [s[i] for i in order]
        assert got == sorted(s) and sorted(order) == list(range(len(s)))
        assert common == [0] + [lcp(a, b) for a, b in zip(got, got[1:])]


def brute(texts):
    seen = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 199):
            seen.setdefault(t[k : k + 200], []).append((i, k))
    out = []
    for i, t in enumerate(texts):
        gone = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - 199):
            if len(seen[t[k : k + 200]]) > 1:
                gone[k : k + 200] = 1
        spans = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def texts_for_brute():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, long_one = text(60), text(3000)
    texts = [None, "", "a" * 199, "a" * 200, "ab" * 300, text(5), passage, passage, long_one, long_one[500:1500] + text(20)]
    for k in range(30):  # one passage in many surroundings, whole and cut at either end
        cut = r.randint(0, 60)
        texts.append(text(r.randint(0, 40)) + passage[cut // 2 : len(passage) - cut] + text(r.randint(0, 40)))
    return texts


def test_against_brute_force(spark):
    texts = texts_for_brute()
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    got = {x.doc_id: tuple(x)[1:] for x in repeats.digest(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()}
    assert [got[i] for i in range(len(texts))] == brute([(t or "").encode() for t in texts])


def test_empty_table(spark):
    assert repeats.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_keys_are_grouped_by_hash(spark):
    texts = [t for t in texts_for_brute() if t]
    docs = repeats.with_id(spark.createDataFrame([(t,) for t in texts], "text string")).repartition(5)
    runs = [{r.tid: repeats.merge(r.runs) for r in repeats.find_runs(docs, most).collect()} for most in (0, 3, repeats.SORTED_MOST)]
    assert runs[0] == runs[1] == runs[2] and runs[0]


def test_places_known_to_repeat():
    met = repeats._Met(limit=4)
    assert met.sure([1, 1, 1, 1], [(0, 0), (0, 0), (0, 1), (0, 2)]) == [False, False, False, True]
    assert met.sure([2, 3, 4, 5], [(1, 0)] * 4) == [False] * 4 and met.at == {1: True}
    assert met.sure([1, 2], [(9, 9), (9, 8)]) == [True, False]
