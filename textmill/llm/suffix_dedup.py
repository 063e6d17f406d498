"""Suffix-array deduplication of byte strings across documents, by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id; the first copy stays.  A suffix array of all text would have to be one structure;
here every suffix goes to a bucket in which all suffixes with its first ``LENGTH`` bytes are:

1. Of equal texts only the one with the smallest id is looked at; the others go whole.
2. The ``GRAM``-byte gram with the smallest hash in a string of ``LENGTH`` bytes is its anchor
   (about one byte in 14 is one).  Equal strings have equal anchors at equal places, so an
   anchor in one document only settles all its strings.  Anchors are dealt to buckets by
   hash, packed and without the copies that a batch of documents holds.
3. Around each anchor that documents share, the text that its strings cover goes to the
   anchor's bucket.  There the equal contexts are combined, those that differ are put in the
   order of their first document, and a suffix array is built by prefix doubling up to
   ``LENGTH`` bytes.  For each suffix the nearest ones before and after it in suffix order that
   are of a smaller document, within the stretch that shares ``LENGTH`` bytes, give the
   longest previous factor, capped at ``LENGTH``; where it is reached the string is a copy.
4. Each document's copies merge into spans, which are cut out of its bytes.

Strings of anchors that more than ``HOT`` distinct texts have are dealt by their own bytes, one
by one, as a bucket must not hold an anchor that a third of all documents has.

Defined cases: null or empty text has no bytes; texts shorter than ``LENGTH`` lose nothing;
repeats within one document, or between rows of one id, stay; a null id comes after all
others, and such rows with equal texts stay; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions, table
from .words import _LETTER, prefix_hash, scramble, shards, span_hash

LENGTH = 50
GRAM = 24
HOT = 50_000
SHARD = 1 << 20  # bytes of text looked at at once; a longer text is a shard of its own
BUCKET_ANCHORS = 500_000
BUCKET_CONTEXTS = 20_000
LAST = (1 << 63) - 1  # stands for a null id
TEXT_SHIFT = 40  # above the place in a text: which of several texts of one id it is


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, text number, first string, number of strings) of each anchor; strings by start.

    The hash is scrambled once more: anchors have small ones, buckets need even ones.
    """
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    if not (sizes >= length).any():
        return none
    data = np.frombuffer(b"\0".join(texts), np.uint8)
    n = len(data) - gram + 1
    best = span_hash(prefix_hash(_LETTER[data]), np.arange(n), np.arange(gram, n + gram))
    grams, at, span, width = best, np.arange(n), 1, length - gram + 1
    while span < width:  # smallest of ``span`` grams, the first of equal ones
        step = min(span, width - span)
        less = best[step:] < best[:-step]
        at, best, span = np.where(less, at[step:], at[:-step]), np.where(less, best[step:], best[:-step]), span + step
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    inside = np.zeros(len(at) + 1, np.int64)
    long = np.flatnonzero(sizes >= length)
    inside[base[long]] += 1
    np.add.at(inside, base[long] + sizes[long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    own = at[start]
    doc = np.searchsorted(base, start, side="right") - 1
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(start)]]))
    return scramble(grams[own[first]]), doc[first], start[first] - base[doc[first]], count


def packed(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _bucket(token: np.ndarray, buckets: int) -> np.ndarray:
    """By the high bits; the low 48 stay with the token."""
    return ((token >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _spread(buckets: int):
    """Emit the anchors of each batch by bucket: nodes (hashes of texts), anchors each, anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = dict(zip(batch.column("x").to_pylist(), batch.column("text").to_pylist(), strict=True))  # equal ones go once
            nodes, bodies = np.array(list(texts), np.int64), list(texts.values())
            tokens, owners = [], []
            for lo, hi in shards(bodies, SHARD):
                token, doc, _, _ = anchors(bodies[lo:hi])
                tokens.append(token)
                owners.append(doc + lo)
            token, owner = np.concatenate([*tokens, np.zeros(0, np.uint64)]), np.concatenate([*owners, np.zeros(0, np.int64)])
            bucket = _bucket(token, buckets)
            order = np.lexsort((owner, bucket))
            token, owner, bucket = token[order], owner[order], bucket[order]
            names, anchors_, node_, counts = [], [], [], []
            for a, b in _runs(bucket):
                own = _runs(owner[a:b])
                names.append(int(bucket[a]))
                anchors_.append(packed(token[a:b], 6))
                node_.append(nodes[owner[a:b][[s for s, _ in own]]].tobytes())
                counts.append(np.array([e - s for s, e in own], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(anchors_, pa.binary()), pa.array(node_, pa.binary()), pa.array(counts, pa.binary())],
                                             ["bucket", "tokens", "nodes", "counts"])
    return run


def _met(rows: pa.Table) -> pa.Table:
    """(node, n, tokens, hot) of the anchors of a bucket that several nodes have."""
    token = np.concatenate([unpacked(x, 6) for x in rows.column("tokens").to_pylist()])
    node = np.concatenate([np.repeat(np.frombuffer(a, np.int64), np.frombuffer(c, np.int32))
                           for a, c in zip(rows.column("nodes").to_pylist(), rows.column("counts").to_pylist(), strict=True)])
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node = token[new], node[new]
    of = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
    number = np.bincount(of)[of]
    many = number > 1
    token, node, hot = token[many], node[many], number[many] > HOT
    order = np.argsort(node, kind="stable")
    token, node, hot = token[order], node[order], hot[order]
    runs = _runs(node)
    return pa.table({"node": pa.array([int(node[a]) for a, _ in runs], pa.int64()), "n": pa.array([b - a for a, b in runs], pa.int64()),
                     "tokens": pa.array([packed(token[a:b], 6) for a, b in runs], pa.binary()),
                     "hot": pa.array([packed(token[a:b][hot[a:b]], 6) for a, b in runs], pa.binary())})


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd, with their size, for an exchange."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("x"), pa.array([len(t) for t in texts], pa.int64()),
                                          pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())], ["i", "x", "size", "z"])


def _inflated(batch: pa.RecordBatch) -> list[bytes]:
    return [pa.decompress(z, n, "zstd", asbytes=True) for z, n in zip(batch.column("z").to_pylist(), batch.column("size").to_pylist(), strict=True)]


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """The pieces ``data[start:start + size]``, one after the other."""
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return data[shift + np.arange(len(shift))].tobytes()


def _contexts(buckets: int):
    """Emit, by bucket, what the strings of the shared anchors cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, reps = _inflated(batch), np.array(batch.column("i").to_pylist(), np.int64)
            nth = np.array(batch.column("o").to_pylist(), np.int64) << TEXT_SHIFT
            wanted, hot = (([unpacked(b"".join(x), 6) for x in batch.column(c).to_pylist()]) for c in ("tokens", "hot"))
            for lo, hi in shards(bodies, SHARD):
                token, doc, start, count = anchors(bodies[lo:hi])
                low = token & np.uint64((1 << 48) - 1)
                keep, is_hot = np.zeros(len(token), bool), np.zeros(len(token), bool)
                for a, b in _runs(doc):
                    k = lo + int(doc[a])
                    keep[a:b] = np.isin(low[a:b], wanted[k])
                    if len(hot[k]):
                        is_hot[a:b] = np.isin(low[a:b], hot[k])
                token, doc, start, count, is_hot = (x[keep] for x in (token, doc, start, count, is_hot))
                data = np.frombuffer(b"\0".join(bodies[lo:hi]), np.uint8)
                base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in bodies[lo:hi]])])
                if is_hot.any():  # each string by itself, dealt by its own bytes
                    many = np.flatnonzero(is_hot)
                    s = np.repeat(start[many], count[many]) + np.arange(count[many].sum()) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
                    d = np.repeat(doc[many], count[many])
                    sums = prefix_hash(_LETTER[data])
                    own = scramble(span_hash(sums, base[d] + s, base[d] + s + LENGTH))
                    token, doc, start, count = (np.concatenate([x[~is_hot], y]) for x, y in ((token, own), (doc, d), (start, s), (count, np.ones(len(s), np.int64))))
                order = np.lexsort((token, _bucket(token, buckets)))
                token, doc, start, count = (x[order] for x in (token, doc, start, count))
                out = []
                for a, b in _runs(_bucket(token, buckets)):
                    size = count[a:b] + LENGTH - 1
                    text = _gathered(data, base[doc[a:b]] + start[a:b], size)
                    out.append((int(_bucket(token[a:a + 1], buckets)[0]), packed(token[a:b], 6), reps[lo + doc[a:b]].tobytes(), (start[a:b] + nth[lo + doc[a:b]]).tobytes(),
                                count[a:b].astype(np.int32).tobytes(), len(text), pa.compress(text, "zstd", asbytes=True)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.binary()), strict=True)],
                                                     ["bucket", "tokens", "reps", "starts", "counts", "size", "z"])
    return run


def ranks(data: np.ndarray, start: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Equal numbers for equal strings of ``length`` (17 to 64) bytes, in their order, by prefix doubling."""
    key = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k:len(data) + k]
    width = 8
    while 2 * width < length:
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        ahead = np.concatenate([rank[width:], np.zeros(width, np.uint64)])
        key, width = (rank << np.uint64(32)) | ahead, 2 * width
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    return np.unique((rank[start] << np.uint64(32)) | rank[start + length - width], return_inverse=True)[1]


def previous_factor(rank: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each suffix has one of a smaller owner in its stretch of equal ranks.

    The previous smaller owner in suffix order, and the next one, by following the same
    relation of the neighbour until it is smaller or the stretch ends.
    """
    order = np.lexsort((np.arange(len(rank)), rank))
    value, stretch = owner[order], rank[order]
    found = np.zeros(len(rank), bool)
    for flip in (False, True):
        v, s = (value[::-1], stretch[::-1]) if flip else (value, stretch)
        near = np.arange(len(v)) - 1
        near[np.concatenate([[True], s[1:] != s[:-1]])[:len(s)]] = -1
        while len(open_ := np.flatnonzero((near >= 0) & (v[near] >= v))):
            near[open_] = near[near[open_]]
        has = near >= 0
        found[order] |= has[::-1] if flip else has
    return found


def _copies(rows: pa.Table) -> pa.Table:
    """(rep, o, spans) of the bytes of a bucket's contexts that are copies; spans are pairs of int32."""
    token, rep, start, count, pieces = [], [], [], [], []
    for t, r, s, c, size, z in zip(*(rows.column(n).to_pylist() for n in ("tokens", "reps", "starts", "counts", "size", "z")), strict=True):
        token.append(unpacked(t, 6))
        rep.append(np.frombuffer(r, np.int64))
        start.append(np.frombuffer(s, np.int64))
        count.append(np.frombuffer(c, np.int32).astype(np.int64))
        text, ends = pa.decompress(z, size, "zstd", asbytes=True), np.cumsum(count[-1] + LENGTH - 1)
        pieces += [text[e - n:e] for e, n in zip(ends.tolist(), (count[-1] + LENGTH - 1).tolist(), strict=True)]
    token, rep, start, count = (np.concatenate(x) for x in (token, rep, start, count))
    nth, start = start >> TEXT_SHIFT, start & ((1 << TEXT_SHIFT) - 1)
    number: dict[tuple[int, bytes], int] = {}
    context = np.fromiter((number.setdefault(k, len(number)) for k in zip(token.tolist(), pieces, strict=True)), np.int64, len(pieces))
    first = np.full(len(number), LAST, np.int64)
    np.minimum.at(first, context, rep)
    keys = list(number)
    of = np.array([t for t, _ in keys], np.uint64)
    _, which, contexts_of = np.unique(of, return_inverse=True, return_counts=True)
    several = contexts_of[which] > 1  # an anchor with one context needs no suffix order
    copied: dict[int, np.ndarray] = {}
    if several.any():
        ids = np.flatnonzero(several)
        ids = ids[np.argsort(first[ids], kind="stable")]  # contexts in document order
        size = np.array([len(keys[k][1]) for k in ids], np.int64)
        base = np.cumsum(size) - size
        wins = size - LENGTH + 1
        own = np.repeat(np.arange(len(ids)), wins)
        at = base[own] + np.arange(len(own)) - (np.cumsum(wins) - wins)[own]
        data = np.frombuffer(b"".join(keys[k][1] for k in ids), np.uint8)
        hit = previous_factor(ranks(data, at), first[ids][own])
        edge = np.cumsum(wins)
        copied = {int(k): hit[e - w:e] for k, e, w in zip(ids, edge.tolist(), wins.tolist(), strict=True) if hit[e - w:e].any()}
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    later = rep > first[context]
    for j in np.flatnonzero(later).tolist():  # an earlier document has the whole context
        spans.setdefault((int(rep[j]), int(nth[j])), []).append((int(start[j]), int(start[j] + count[j]) + LENGTH - 1))
    for j in np.flatnonzero(~later).tolist():
        if (hit_ := copied.get(int(context[j]))) is not None:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit_.astype(np.int8), [0]])))
            spans.setdefault((int(rep[j]), int(nth[j])), []).extend((int(start[j] + a), int(start[j] + b) + LENGTH - 1) for a, b in zip(edges[0::2], edges[1::2], strict=True))
    out = [(r, np.array(v, np.int32).tobytes()) for r, v in spans.items()]
    return pa.table({"rep": pa.array([k[0] for k, _ in out], pa.int64()), "o": pa.array([k[1] for k, _ in out], pa.int64()), "spans": pa.array([s for _, s in out], pa.binary())})


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans, in order; those that overlap or touch become one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.column_stack([spans[first, 0], reach[np.concatenate([first[1:] - 1, [len(spans) - 1]])]])


def kept(text: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, x, text, parts in zip(batch.column("i").to_pylist(), batch.column("x").to_pylist(), _inflated(batch), batch.column("spans").to_pylist(), strict=True):
            spans = merged(np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2).astype(np.int64))
            rows.append((i, x, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(kept(text, spans)).hexdigest(), spans.ravel().tolist()))
        if rows:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["i", "x", "n_removed", "n_spans", "sha", "edges"])


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: i, x (hash of the text), n_bytes, n_removed, n_spans, kept_sha256, edges.

    ``edges`` are the bounds of the removed spans, in bytes: start, end, start, end, ...
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("i"), F.xxhash64(text).alias("x"), text.cast("binary").alias("text"))
    every = cut(rows.select("i", "x", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("d")), "suffix-rows")
    firsts = every.groupBy("d").agg(F.min(F.struct("i", "x")).alias("f"), F.max("n_bytes").alias("n_bytes")).select("d", F.col("f.i").alias("rep"), F.col("f.x").alias("x"), "n_bytes")
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("x")) - 1  # 0, unless an id has several texts
    firsts = cut(firsts.withColumn("o", nth.cast("long")), "suffix-firsts")

    total = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(partitions(docs), math.ceil(total / 14 / BUCKET_ANCHORS))
    found = (rows.mapInArrow(_spread(buckets), "bucket long, tokens binary, nodes binary, counts binary")
             .groupBy("bucket").applyInArrow(_met, "node long, n long, tokens binary, hot binary"))
    found = cut(found, "shared-anchors")
    number = found.agg(F.sum("n")).first()[0] or 0
    lists = found.groupBy("node").agg(F.collect_list("tokens").alias("tokens"), F.collect_list("hot").alias("hot"))  # of one text
    near = firsts.join(lists, F.col("x") == F.col("node")).select("rep", "node", "o", "tokens", "hot")

    small = rows.mapInArrow(_deflated, "i long, x long, size long, z binary")
    buckets = max(partitions(docs), math.ceil(number / BUCKET_CONTEXTS))
    spans = (small.join(near, (F.col("i") == F.col("rep")) & (F.col("x") == F.col("node"))).select("i", "o", "size", "z", "tokens", "hot")
             .mapInArrow(_contexts(buckets), "bucket long, tokens binary, reps binary, starts binary, counts binary, size long, z binary")
             .groupBy("bucket").applyInArrow(_copies, "rep long, o long, spans binary"))
    spans = cut(spans, "suffix-spans").groupBy("rep", "o").agg(F.collect_list("spans").alias("spans"))  # of one document
    spans = spans.join(firsts.select("rep", "o", F.col("x").alias("fx")), ["rep", "o"])
    gone = (small.join(spans, (F.col("i") == F.col("rep")) & (F.col("x") == F.col("fx"))).select("i", "x", "size", "z", "spans")
            .mapInArrow(_cut_out, "i long, x long, n_removed long, n_spans long, sha string, edges array<long>"))
    gone = gone.groupBy("i", "x").agg(F.first("n_removed").alias("n_removed"), F.first("n_spans").alias("n_spans"), F.first("sha").alias("sha"), F.first("edges").alias("edges"))

    whole = every.join(firsts.select("d", "rep"), "d").join(gone, ["i", "x"], "left")
    copy = (F.col("i") != F.col("rep")) & (F.col("n_bytes") >= LENGTH)
    pick = lambda all_, some, none: F.when(copy, all_).otherwise(F.coalesce(some, none))
    return whole.select(F.when(F.col("i") != LAST, F.col("i")).alias("i"), "x", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0).cast("long")).alias("n_removed"),
                        pick(F.lit(1).cast("long"), F.col("n_spans"), F.lit(0).cast("long")).alias("n_spans"),
                        pick(F.sha2(F.lit(""), 256), F.col("sha"), F.lower(F.hex("d"))).alias("kept_sha256"),
                        pick(F.array(F.lit(0).cast("long"), F.col("n_bytes")), F.col("edges"), F.array().cast("array<long>")).alias("edges"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = removals(table(spark, sf_dir, "documents"))
    return got.select(F.col("i").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
