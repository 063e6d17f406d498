"""Groups of spelling variants, by blocked Gram matrices of letter counts.

Two words are near if one inserted, deleted or replaced letter separates them.  Then their
letter counts differ by one letter, or by one letter for another: the squared distance of the
count vectors is at most two, and the lengths differ by at most one.

1. Letters are dealt to a few classes of about equal use.  The numbers of letters of each
   class are a word's cell; they add up to its length, so cells are finer length blocks.  Near
   words lie in cells that differ by one letter, or by one class for another, so each cell
   meets a fixed list of neighbours only.  The number of classes grows with the logarithm of
   the vocabulary, which keeps cells small.
2. A cell gets its neighbours' words, packed.  In tiles of bounded size, one NumPy product of
   count matrices, with the squared norms as two more columns, gives all squared distances;
   pairs at most two apart are compared letter by letter.
3. Each word keeps the number of its near words and the most common one.  If that is common
   enough it is the word's form; forms are followed to the last by pointer doubling, which
   ends after few rounds as counts grow by ``TIMES`` at each step.

Defined cases: a null text has no words; a null id counts as an empty one where letters are
dropped; every one of repeated rows counts; an empty table gives an empty result; other
columns are ignored, whatever their names.  Words have no upper bound of length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

LETTERS = 7  # code points that a word has at least
OCCURRENCES = 2
TIMES = 10  # so many times as common is a word's form
OWN = 2048  # words of a cell, and of its neighbours, in a tile
OTHERS = 8192
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LETTERS) -> DataFrame:
    """(id, run): the maximal runs of at least ``least`` letters, A-Z in lower case."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(rf"([A-Za-zÀ-ÿ]{{{least},}}+)"), F.lit(1))
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run")).withColumn("run", F.translate("run", UPPER, UPPER.lower()))


def with_slips(found: DataFrame) -> DataFrame:
    """(word): one letter of every 31st run or so is dropped, as a hash of id and run decides."""
    h = F.crc32(F.encode(F.concat(F.col("id"), F.lit(":"), F.col("run")), "UTF-8"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    counts = words.filter(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return cut(counts.filter(F.col("n") >= occurrences), "spelling-words")


def _classes(words: DataFrame, number: int) -> list[str]:
    """The letters of each class, of about equal use; at most 90 letters come to the driver."""
    used = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    load, out = [0] * number, [""] * number
    for letter, n in sorted(used, key=lambda r: (-r[1], r[0])):
        k = load.index(min(load))
        load[k] += n
        out[k] += letter
    return out


def _steps(number: int) -> list[list[int]]:
    """From a cell to those that one edit may lead to; the first leads nowhere."""
    unit = lambda k, by: [by if j == k else 0 for j in range(number)]
    one = [unit(k, by) for k in range(number) for by in (1, -1)]
    swap = [[a + b for a, b in zip(unit(i, 1), unit(j, -1), strict=True)] for i in range(number) for j in range(number) if i != j]
    return [[0] * number, *one, *swap]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in the order of cells -> (cell, length, words, counts); words of a cell are of one length."""
    for batch in batches:
        cells = batch.column("cell").to_pylist()
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        edges = [k for k in range(len(cells)) if k == 0 or cells[k] != cells[k - 1]] + [len(cells)]
        parts = [(cells[a], len(words[a]), "".join(words[a:b]).encode("latin-1"), n[a:b].astype(np.int64).tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
        if parts:
            types = (pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), types, strict=True)], ["cell", "length", "words", "counts"])


def squared_distances(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of the letter counts of words (lines of code points below 256), by one product.

    Letters that no own word has share a column: a near word has at most one of them.
    """
    column = np.zeros(256, np.int64)
    present = np.unique(own)
    column[present] = np.arange(1, len(present) + 1)
    width = len(present) + 1
    kind = np.float32 if max(own.shape[1], others.shape[1]) <= 1000 else np.float64  # exact below 2**24, 2**53

    def counts(words: np.ndarray) -> np.ndarray:
        place = column[words] + np.arange(len(words))[:, None] * width
        return np.bincount(place.ravel(), minlength=len(words) * width).reshape(len(words), width).astype(kind)

    a, b = counts(own), counts(others)
    a_side = np.column_stack([a, (a * a).sum(1), np.ones(len(a), kind)])
    b_side = np.column_stack([-2 * b, np.ones(len(b), kind), (b * b).sum(1)])
    return a_side @ b_side.T


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether lines of equal number of ``a`` and ``b`` are one edit apart; lengths differ by at most one."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    short, long = (a, b) if a.shape[1] < b.shape[1] else (b, a)
    n = short.shape[1]
    before, after = long[:, :-1] != short, long[:, 1:] != short
    first = np.where(before.any(1), before.argmax(1), n)  # up to here the two agree
    last = np.where(after.any(1), n - after[:, ::-1].argmax(1), 0)  # from here on, shifted, too
    return last <= first


def near_pairs(own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of ``own`` and ``others`` that are one edit apart."""
    i, j = np.nonzero(squared_distances(own, others) <= 2)
    step = max(1, 4_000_000 // others.shape[1])
    sure = [one_edit(own[i[s:s + step]], others[j[s:s + step]]) for s in range(0, len(i), step)]
    sure = np.concatenate([*sure, np.zeros(0, bool)])
    return i[sure], j[sure]


def _near(rows: pa.Table) -> pa.Table:
    """(word, n, n_near, near, near_n) of the words of a cell, given with its neighbours."""
    parts: dict[tuple[bool, int], list[tuple[bytes, bytes]]] = {}
    for own, length, words, counts in zip(*(rows.column(c).to_pylist() for c in ("own", "length", "words", "counts")), strict=True):
        parts.setdefault((False, length), []).append((words, counts))
        if own:
            parts.setdefault((True, length), []).append((words, counts))
    sides = {k: (np.frombuffer(b"".join(w for w, _ in v), np.uint8).reshape(-1, k[1]), np.frombuffer(b"".join(c for _, c in v), np.int64)) for k, v in parts.items()}
    out: dict[str, list] = {"word": [], "n": [], "n_near": [], "near": [], "near_n": []}
    for (mine, _), (words, n) in sides.items():
        for s in range(0, len(words) if mine else 0, OWN):
            own = words[s:s + OWN]
            number = np.zeros(len(own), np.int64)
            best: list[tuple[int, bytes] | None] = [None] * len(own)  # the smallest of (-n, word)
            for (no, _), (others, other_n) in sides.items():
                for t in range(0, 0 if no else len(others), OTHERS):
                    i, j = near_pairs(own, others[t:t + OTHERS])
                    number += np.bincount(i, minlength=len(own))
                    top = np.full(len(own), -1, np.int64)
                    np.maximum.at(top, i, other_n[t + j])
                    tops = other_n[t + j] == top[i]
                    for k, x in zip(i[tops].tolist(), (t + j[tops]).tolist(), strict=True):
                        entry = (-int(other_n[x]), others[x].tobytes())
                        if best[k] is None or entry < best[k]:
                            best[k] = entry
            out["word"] += [w.tobytes().decode("latin-1") for w in own]
            out["n"] += n[s:s + OWN].tolist()
            out["n_near"] += number.tolist()
            out["near"] += [b and b[1].decode("latin-1") for b in best]
            out["near_n"] += [b and -b[0] for b in best]
    return pa.table({k: pa.array(v, pa.string() if k in ("word", "near") else pa.int64()) for k, v in out.items()})


def near_words(words: DataFrame, classes: int | None = None) -> DataFrame:
    """(word, n, n_near, near, near_n) of a vocabulary (word, n) of letters below code point 256.

    ``near`` is the near word of largest n, the smallest one of several, null if there is none.
    ``classes`` changes the work, never the result.
    """
    number = classes or max(3, math.ceil(math.log2(words.count() + 1)) - 15)
    letters = _classes(words, number)
    cell = F.array(*[F.length("word") - F.length(F.translate("word", x, "")) if x else F.lit(0) for x in letters])
    celled = words.withColumn("cell", cell.cast("array<int>"))
    cells = cut(celled.repartition("cell").sortWithinPartitions("cell", "word").mapInArrow(_packed, "cell array<int>, length long, words binary, counts binary"), "spelling-cells")
    steps = F.explode(F.array(*[F.array(*[F.lit(x) for x in s]) for s in _steps(number)]))
    met = cells.withColumn("step", steps).withColumn("to", F.zip_with("cell", "step", lambda a, b: a + b))
    met = met.select("to", F.forall("step", lambda x: x == 0).alias("own"), "length", "words", "counts")
    there = cells.select(F.col("cell").alias("to")).distinct()
    return met.join(there, "to", "left_semi").groupBy("to").applyInArrow(_near, "word string, n long, n_near long, near string, near_n long")


def followed(forms: DataFrame, most: int, times: int = TIMES) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last; counts of at most ``most`` bound the way."""
    up = cut(forms.select("word", F.col("form").alias("root")), "spelling-up")
    steps = 1
    while times ** steps <= most:
        further = up.select(F.col("word").alias("at"), F.col("root").alias("further"))
        up = cut(up.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-up")
        steps *= 2
    return up


def grouped(words: DataFrame, times: int = TIMES, classes: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n)."""
    common: Column = F.col("near_n") >= times * F.col("n")
    near = cut(near_words(words, classes), "spelling-near")
    near = near.select("word", "n", "n_near", F.when(common, F.col("near")).alias("form"), F.when(common, F.col("near_n")).alias("form_n"))
    most = words.agg(F.max("n")).first()[0] or 0
    roots = followed(near.filter(F.col("form").isNotNull()), most, times)
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(vocabulary(with_slips(runs(table(spark, sf_dir, "documents")))))
