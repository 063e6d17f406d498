"""Spelling variants: Gram distances and edits in plain Python, and the whole query against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textmill import llm
from textmill.llm import spelling as S

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, n int, cell string"
LOWER = str.maketrans(S.UPPER, S.UPPER.lower())


def words_of(rows):
    """Counts of the words of (id, text), as the contract has them."""
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def brute(counts):
    """Near words share a pattern: one letter left open, or one left out."""
    opened, less = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            opened[w[:k], w[k + 1:]].add(w)
            less[w[:k] + w[k + 1:]].add(w)
    form, n_near = {}, {}
    for w, n in counts.items():
        near = set().union(*(opened[w[:k], w[k + 1:]] for k in range(len(w)))) - {w}
        near |= less.get(w, set()) | {s for k in range(len(w)) if (s := w[:k] + w[k + 1:]) in counts}
        n_near[w] = len(near)
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, n_near[w], counts.get(form[w]))
    return out


def got(frame):
    rows = frame.select("word", "form", "root", "n", "n_near", "form_n").collect()
    found = {r[0]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_op12(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(words_of(docs))
    assert any(v[0] for v in want.values())
    assert got(llm.QUERIES["op12_spelling"](spark, SF)) == want


@pytest.mark.parametrize("classes", [3, 7])
def test_odd_rows(spark, classes):
    """Chains of forms, ties, long words, letters above ASCII, null ids and texts, repeated rows."""
    long = "abc" * 500
    rows = [(i, "writing " * 3000) for i in range(2)] + [(None, "writting writting  Wriiting writing")] * 90 + [(3, "wrriting wrriting"), (4, "wrritting wrritting"), (5, None), (6, ""), (None, None)]
    rows += [(7, f"{long} {long}a {long}"), (7, f"{long} {long}a {long}"), (8, "Straßenbähn straßenbähn STRAßENBäHN straßenb÷hn straßenb÷hn"), (9, "lőbőabcdefgh abcdefgh abcdegfh abcdegfh"),
             (10, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa")]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    words = S.vocabulary(S.with_slips(S.runs(frame)))
    want = words_of(rows)
    assert {r["word"]: r["n"] for r in words.collect()} == want
    want = brute(want)
    assert len({v[1] for v in want.values()}) < len(want)
    assert got(S.grouped(words, classes=classes)) == want


def test_chain_of_forms(spark):
    """w0 -> w1 -> ... by counts that grow ten times a step."""
    chain = [("abcdefg" + "h" * k, 2 * 10 ** k) for k in range(12)]
    found = got(S.grouped(spark.createDataFrame(chain, "word string, n long")))
    assert {v[1] for v in found.values()} == {chain[-1][0]}


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert S.grouped(S.vocabulary(S.with_slips(S.runs(frame)))).count() == 0


def test_tiles_in_process():
    rng = np.random.default_rng(3)
    for length, other in ((7, 7), (7, 8), (8, 7), (1200, 1201)):
        own, others = rng.integers(97, 100, (40, length)).astype(np.uint8), rng.integers(97, 101, (60, other)).astype(np.uint8)
        for k in range(0, 40, 3):  # plant near ones
            body = bytearray(own[k].tobytes())
            if other > length:
                body.insert(k % length, 99)
            elif other < length:
                del body[k % length]
            else:
                body[k % length] ^= 1
            others[k] = np.frombuffer(bytes(body), np.uint8)
        near = set()
        for i, a in enumerate(w.tobytes() for w in own):
            for j, b in enumerate(w.tobytes() for w in others):
                if len(a) == len(b):
                    hit = sum(x != y for x, y in zip(a, b, strict=True)) == 1
                else:
                    s, t = sorted((a, b), key=len)
                    hit = any(t[:k] + t[k + 1:] == s for k in range(len(t)))
                if hit:
                    near.add((i, j))
        i, j = S.near_pairs(own, others)
        assert near and set(zip(i.tolist(), j.tolist(), strict=True)) == near
