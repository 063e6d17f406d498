"""Benchmark decontamination by FM-indexes of the training text.

The windows of a benchmark item are its runs of ``WINDOW`` words, or all of them if fewer.
The tasks that read the documents index them shard by shard (about 2 MB of whole texts, so
a shard never needs a shuffle): words become symbols, words that no item has separate, and
runs shorter than the shortest window can't hold one and are left out.  Over the symbols of a
shard an FM-index is built (``fmindex``); all windows are searched backwards side by side
through the ranks of its wavelet matrix, occurrences are located by sampled suffix
positions, and overlapping occurrences merge into spans.

The benchmark is the query set.  One of at most ``BLOCK_WORDS`` words is shipped with the one
pass over the documents.  A larger one is read in blocks of that size, one at a time: each
block's pass writes the spans it found, by digest of the text, before the next is read, and a
last pass merges the spans of all blocks.

Defined cases: null or empty text has no words and is clean; an item without words is never
found; items that repeat an id are one item; windows of items without id are hit like all
others, but such items have no id to list or count; an empty benchmark leaves every document clean; an empty table gives an empty result; other columns
are ignored, or kept by ``decontaminated``, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_rows, cut, table
from .fmindex import FMIndex
from .words import ALNUM, Words, shards

WINDOW = 13
BLOCK_WORDS = 200_000
SHARE = 20  # contaminated if a twentieth of the words is hit
SPAN = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64())])
FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(SPAN))])
FOUND_SQL = ("struct<n_words:bigint,n_hit:bigint,items:array<string>,"
             "spans:array<struct<first_word:bigint,end_word:bigint,first_byte:bigint,end_byte:bigint>>>")


class Block(NamedTuple):
    """Windows of some items: word hashes, phrases of symbols, and the items of each phrase."""

    vocabulary: np.ndarray
    phrases: np.ndarray
    lengths: np.ndarray
    item_from: np.ndarray
    item_of: np.ndarray
    names: list[str]


def block_of(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> Block:
    """The distinct windows of ``items``; symbols are 2 + the place in the vocabulary."""
    words = Words([t for _, t in items], ALNUM)
    vocabulary, symbol = np.unique(words.hash, return_inverse=True)
    names = sorted({n for n, _ in items if n is not None})
    number = {n: k for k, n in enumerate(names)}
    owners: dict[bytes, set[int]] = {}
    for k, (name, _) in enumerate(items):
        own = symbol[words.first[k]:words.first[k + 1]].astype(np.int64) + 2
        for at in range(max(1, len(own) - window + 1) if len(own) else 0):
            owner = owners.setdefault(own[at:at + window].tobytes(), set())
            if name is not None:
                owner.add(number[name])
    phrases = np.zeros((len(owners), window), np.int64)
    lengths = np.zeros(len(owners), np.int64)
    for k, key in enumerate(owners):
        p = np.frombuffer(key, np.int64)
        phrases[k, window - len(p):], lengths[k] = p, len(p)
    of = [sorted(v) for v in owners.values()]
    return Block(vocabulary, phrases, lengths, np.concatenate([[0], np.cumsum([len(v) for v in of])]).astype(np.int64),
                 np.array([x for v in of for x in v], np.int64), names)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, read one partition at a time."""
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
    held, size = [], 0
    for name, text in rows.toLocalIterator():
        n = 1 + len(text) // 2
        if held and size + n > block_words:
            yield block_of(held)
            held, size = [], 0
        held.append((name, bytes(text)))
        size += n
    if held:
        yield block_of(held)


def occurrences(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of each occurrence in the texts of ``words``."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words.hash) or not len(block.phrases):
        return none
    bits = np.zeros(1 << 16, bool)  # most words are no benchmark words: a first look by 16 bits
    bits[block.vocabulary >> np.uint64(48)] = True
    likely = np.flatnonzero(bits[words.hash >> np.uint64(48)])
    place = np.minimum(np.searchsorted(block.vocabulary, words.hash[likely]), len(block.vocabulary) - 1)
    same = block.vocabulary[place] == words.hash[likely]
    at, symbol = likely[same], place[same] + 2
    if not len(at):
        return none
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(words.doc[at]) != 0)])
    run = np.cumsum(new) - 1
    long = np.bincount(run)[run] >= block.lengths.min()
    at, symbol, new = at[long], symbol[long], new[long]
    if not len(at):
        return none
    place = np.arange(len(at)) + np.cumsum(new) - 1  # a separator before each run but the first
    text = np.ones(int(place[-1]) + 1, np.int64)
    text[place] = symbol
    word = np.zeros(len(text), np.int64)
    word[place] = at
    which, where = FMIndex(text, int(block.vocabulary.size) + 1).find(block.phrases, block.lengths)
    return which, word[where]


def search(texts: list[bytes], block: Block, before: list | None = None) -> list[dict]:
    """FOUND of each text; ``before`` has that of earlier blocks, or None."""
    out = []
    for lo, hi in shards(texts):
        words = Words(texts[lo:hi], ALNUM)
        which, start = occurrences(words, block)
        mark = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(mark, start, 1)
        np.add.at(mark, start + block.lengths[which], -1)
        items: list[set[str]] = [set() for _ in range(lo, hi)]
        for doc, phrase in set(zip(words.doc[start].tolist(), which.tolist(), strict=True)):
            items[doc].update(block.names[x] for x in block.item_of[block.item_from[phrase]:block.item_from[phrase + 1]])
        if before:
            for k, old in enumerate(before[lo:hi]):
                if old is None:
                    continue
                items[k].update(old["items"])
                for s in old["spans"]:
                    mark[words.first[k] + s["first_word"]] += 1
                    mark[words.first[k] + s["end_word"]] -= 1
        hit = np.cumsum(mark[:-1]) > 0
        at = np.flatnonzero(hit)
        spans: list[list[dict]] = [[] for _ in range(lo, hi)]
        if len(at):
            split = np.flatnonzero((np.diff(at) != 1) | (np.diff(words.doc[at]) != 0)) + 1
            for a, b in zip(at[np.concatenate([[0], split])].tolist(), at[np.concatenate([split, [len(at)]]) - 1].tolist(), strict=True):
                d = int(words.doc[a])
                spans[d].append({"first_word": a - int(words.first[d]), "end_word": b + 1 - int(words.first[d]),
                                 "first_byte": int(words.start[a] - words.base[d]), "end_byte": int(words.end[b] - words.base[d])})
        n_hit = np.bincount(words.doc[hit], minlength=hi - lo)
        out += [{"n_words": int(words.count[k]), "n_hit": int(n_hit[k]), "items": sorted(items[k]), "spans": spans[k]} for k in range(hi - lo)]
    return out


def _scanner(block: Block):
    @F.arrow_udf(FOUND_SQL)
    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        old = before.to_pylist() if before.null_count < len(before) else None
        return pa.array(search(texts.to_pylist(), block, old), FOUND)
    return scan


def found(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "__found") -> DataFrame:
    """``docs`` with a column of FOUND: words, hit words, items found, and merged spans.

    A column of ``docs`` that is named ``out`` is replaced.
    """
    mine = as_rows(docs)
    text = F.coalesce(F.col("row")[text_col].cast("binary"), F.lit("").cast("binary"))
    none, rest = F.lit(None).cast(FOUND_SQL), blocks(benchmark)
    block, more = next(rest, block_of([])), next(rest, None)
    if more is None:
        done = mine.withColumn("found", _scanner(block)(text, none))
    else:
        mine = mine.withColumn("digest", F.sha2(text, 256))
        hits = _merged(mine.select("digest", text.alias("text")), itertools.chain([block, more], rest))
        done = mine.join(hits, "digest", "left").withColumn("found", _scanner(block_of([]))(text, F.col("before")))
    return done.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != out], F.col("found").alias(out))


def _merged(texts: DataFrame, rest: Iterator[Block]) -> DataFrame:
    """(digest, before) of the texts that blocks hit: FOUND with the items and spans of all blocks.

    Equal texts have equal spans, so they are one row from the map side of the grouping on.
    """
    passes = []
    for block in rest:
        got = texts.select("digest", _scanner(block)(F.col("text"), F.lit(None).cast(FOUND_SQL)).alias("found")).filter("found.n_hit > 0")
        passes.append(cut(got.groupBy("digest").agg(F.first("found").alias("found")), "block-hits"))
    every = functools.reduce(DataFrame.unionByName, passes)
    whole = every.groupBy("digest").agg(F.max("found.n_words").alias("n_words"), F.max("found.n_hit").alias("n_hit"),
                                        F.array_distinct(F.flatten(F.collect_list("found.items"))).alias("items"),
                                        F.flatten(F.collect_list("found.spans")).alias("spans"))  # one entry a block
    return whole.select("digest", F.struct("n_words", "n_hit", "items", "spans").alias("before"))


def contaminated(found_col: str = "__found") -> Column:
    hit, words = F.col(f"{found_col}.n_hit"), F.col(f"{found_col}.n_words")
    return (hit > 0) & (hit * SHARE >= words)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, unchanged."""
    mine = as_rows(docs).select("row", F.col("row")[text_col].alias("text"))
    return found(mine, benchmark).filter(~contaminated()).select("row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = found(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "__found")
    return got.select("doc_id", "__found.n_words", "__found.n_hit", F.size("__found.items").cast("long").alias("n_items"),
                      F.sha2(F.array_join(F.array_sort("__found.items"), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, p, p + 12), ' ') AS s, least(len(w), 13) AS k FROM bw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
occ AS (SELECT dw.doc_id, dw.p, dw.k, win.item_id FROM dw JOIN win ON win.k = dw.k AND win.s = array_to_string(list_slice(dw.w, dw.p, dw.p + dw.k - 1), ' ')),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
