"""Byte-level BPE: training as Spark rounds, encoding as an Arrow-batched UDF.

Training works on the distinct pre-token chunks with their counts (the
corpus pass is ``pretoken_counts``, a partial + final aggregation).  Each
round counts adjacent pairs weighted by chunk frequency, in each task's batches
by numpy and then with one ``groupBy``, and takes the first pairs by count
(ties: smallest pair).  Sequences are cut between ids that are no such pair,
and equal segments are added up: a table of bounded size, which gives the
greedy merges as long as the next is among the pairs taken (``segments``).  So
a round finds thousands of merges, the same ones as a job for each would.  The
tasks make them in all sequences, a batch at a time.  The merge table (one row
per learned token, bounded by the vocabulary size) is the model.

Encoding takes a trained model or a public vocabulary file.  The ids of a chunk
depend on the chunk only, so each task encodes a distinct chunk once and keeps
it: text and tokens are never shuffled.  A batch is taken apart and put together
again by Arrow and numpy; Python sees its distinct chunks only.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import default_buckets
from ..functions.text import N_BYTES, SPECIAL_TOKENS, byte_tokens, pretokenize
from ..session import materialised


FIRST_PAIRS = 256  # that the first round tries to take
STEPS = 32  # distinct merges of a sequence that are made with those of its whole batch


def _one_merged(ids: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """A sequence with the merges of ``ranks`` made in their order, from left to right; a long one costs n log n."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = [(ranks[x][0], i, x) for i, x in enumerate(a << 32 | b for a, b in zip(ids, ids[1:], strict=False)) if x in ranks]
    heapq.heapify(pairs)
    while pairs:
        _, i, x = heapq.heappop(pairs)
        if ids[i] < 0 or (j := after[i]) >= n or ids[i] << 32 | ids[j] != x:
            continue  # one of the two has merged since
        ids[i], ids[j], after[i] = ranks[x][1], -1, after[j]
        if (k := after[i]) < n:
            before[k] = i
            if (r := ranks.get(y := ids[i] << 32 | ids[k])) is not None:
                heapq.heappush(pairs, (r[0], i, y))
        if (h := before[i]) >= 0 and (r := ranks.get(y := ids[h] << 32 | ids[i])) is not None:
            heapq.heappush(pairs, (r[0], h, y))
    return [i for i in ids if i >= 0]


def _pairs(flat: np.ndarray) -> np.ndarray:
    return flat[:-1].astype(np.int64) << 32 | flat[1:].astype(np.int64)


class _Merges:
    """Merges (left, right, new), to be made in their order."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.ranks = {left << 32 | right: (r, new) for r, (left, right, new) in enumerate(merges)}
        self.new = np.array([m[2] for m in merges], np.int32)
        keys = np.array([left << 32 | right for left, right, _ in merges], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def apply(self, flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences that lie one after the other, merged, each from left to right; ``row`` says whose an id is.

        A step makes the earliest merge of each sequence, in all its places.
        """
        ended = []
        for _ in range(STEPS):
            if not len(self.keys) or len(flat) < 2:
                break
            pairs = _pairs(flat)
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pairs) & (row[:-1] == row[1:]), self.order[at], len(self.keys))
            rank = np.append(rank, len(self.keys))
            begin = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
            first = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(row)))
            more = np.repeat(first < len(self.keys), size)
            hit = (rank == np.repeat(first, size)) & more
            ended.append((flat[~more], row[~more]))
            flat, row, rank, hit = flat[more], row[more], rank[more], np.flatnonzero(hit[more])
            same = np.append(False, (np.diff(hit) == 1) & (rank[hit[1:]] == rank[hit[:-1]]))
            if same.any():  # of pairs that overlap every other one, from the first
                nth = np.arange(len(hit))
                hit = hit[(nth - np.maximum.accumulate(np.where(same, 0, nth))) % 2 == 0]
            flat[hit] = self.new[rank[hit]]
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            flat, row = flat[keep], row[keep]
        if len(self.keys) and len(flat):  # few are left, and long
            begin = np.append(np.flatnonzero(np.diff(row, prepend=row[0] - 1)), len(row))
            for a, b in zip(begin.tolist(), begin[1:].tolist(), strict=False):
                one = np.array(_one_merged(flat[a:b].tolist(), self.ranks), flat.dtype)
                ended.append((one, np.full(len(one), row[a])))
            flat, row = flat[:0], row[:0]
        flat, row = (np.concatenate([x[i] for x in ended] + [(flat, row)[i]]) for i in (0, 1))
        order = np.argsort(row, kind="stable")
        return flat[order], row[order]


def _read(batch: pa.RecordBatch, merges: _Merges) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, the row of each and the rows' counts of a batch of (seq, n), merged, in slices."""
    at, n = 0, batch.column(1).to_numpy(zero_copy_only=False)
    for seq in _cut(batch.column(0)):
        size = pc.list_value_length(seq).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(seq).to_numpy(zero_copy_only=False)
        flat, row = merges.apply(flat, np.repeat(np.arange(len(size)), size))
        yield flat, row, n[at:at + len(size)]
        at += len(size)


def pair_counts(seqs: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """(l, r, count, places) of adjacent ids, after ``merges``; ``places`` doesn't weight them."""
    merges = seqs.sparkSession.sparkContext.broadcast(_Merges(merges))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flat, row, n in _read(batch, merges.value):
                near = row[:-1] == row[1:]
                each, which, places = np.unique(_pairs(flat)[near], return_inverse=True, return_counts=True)
                total = np.zeros(len(each), np.int64)
                np.add.at(total, which, n[row[:-1][near]])
                yield pa.RecordBatch.from_arrays([pa.array((each >> 32).astype(np.int32)), pa.array((each & 0xFFFFFFFF).astype(np.int32)), pa.array(total), pa.array(places)], ["l", "r", "count", "places"])

    found = seqs.mapInArrow(count, "l int, r int, count long, places long").groupBy("l", "r")
    return found.agg(F.sum("count").alias("count"), F.sum("places").alias("places"))


def merged_seqs(seqs: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """Sequences after ``merges``, of two ids at least."""
    merges = seqs.sparkSession.sparkContext.broadcast(_Merges(merges))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flat, row, n in _read(batch, merges.value):
                ends = _offsets(np.bincount(row, minlength=len(n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())), pa.array(n, pa.int64())], ["seq", "n"])

    return seqs.mapInArrow(merge, "seq array<int>, n long").filter(F.size("seq") >= 2)


def segments(seqs: DataFrame, merges: list[tuple[int, int, int]], taken: np.ndarray) -> DataFrame:
    """(seg, n): runs of ids, 4 bytes each, whose neighbours are all pairs of ``taken`` (sorted), after ``merges``.

    ``taken`` are the first pairs by (count, l, r).  A merge of (a, b) makes of (x, a) and (b, y) pairs
    that are not before those in that order, having no more places and larger ids.  So pairs over a cut
    stay behind the last pair taken, and those before it have all their places in the segments.
    """
    spark = seqs.sparkSession.sparkContext
    merges, taken = spark.broadcast(_Merges(merges)), spark.broadcast(taken)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flat, row, n in _read(batch, merges.value):
                if not len(flat):
                    continue
                pairs = _pairs(flat)
                at = np.minimum(np.searchsorted(taken.value, pairs), len(taken.value) - 1)
                begin = np.flatnonzero(np.append(True, (taken.value[at] != pairs) | (row[:-1] != row[1:])))
                size = np.diff(np.append(begin, len(flat)))
                begin, size = begin[size > 1], size[size > 1]
                body = pa.py_buffer(_gathered(flat, begin, size).astype(np.int32).tobytes())
                ends = pa.py_buffer((_offsets(size) * 4).astype(np.int32).tobytes())
                coded = pa.Array.from_buffers(pa.binary(), len(size), [None, ends, body]).dictionary_encode()
                total = np.zeros(len(coded.dictionary), np.int64)
                np.add.at(total, coded.indices.to_numpy(zero_copy_only=False), n[row[begin]])
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(total)], ["seg", "n"])

    return seqs.mapInArrow(cut, "seg binary, n long").groupBy("seg").agg(F.sum("n").alias("n"))


def greedy_merges(flat: np.ndarray, size: np.ndarray, n: np.ndarray, last: tuple[int, int] | None,
                  new: int, n_merges: int) -> list[tuple[int, int, int, int]]:
    """Up to ``n_merges`` merges (left, right, new id, count) of sequences that lie one after the other, ``n`` times each.

    It ends when the first pair by (count, l, r) is behind ``last``, a (-count, pair).  Counts and places
    follow each merge; pairs behind ``last`` are left out, as counts only fall.
    """
    total = len(flat)
    end = np.cumsum(size)
    after, before = np.arange(1, total + 1, dtype=np.int32), np.arange(-1, total - 1, dtype=np.int32)
    after[end - 1], before[end - size] = -1, -1
    pairs, start = _pairs(flat), np.flatnonzero(after[:-1] >= 0)
    pairs = pairs[start]
    order = np.argsort(pairs, kind="stable")
    keys, first, many = np.unique(pairs[order], return_index=True, return_counts=True)
    found = start[order].astype(np.int32)  # places by pair, from left to right
    weight = np.repeat(n, size).astype(np.int64)
    sums = np.add.reduceat(weight[found], first) if len(first) else first
    del pairs, start, order
    ids, after, before, weight, found = (array(x, v.tobytes()) for x, v in (("i", flat.astype(np.int32)), ("i", after), ("i", before), ("q", weight), ("i", found)))
    count = dict(zip(keys.tolist(), sums.tolist(), strict=True))
    places = dict(zip(keys.tolist(), zip(first.tolist(), (first + many).tolist(), strict=True), strict=True))
    heap = [(-c, x) for x, c in count.items()]
    heapq.heapify(heap)
    last = last or (0, 0)
    merges: list[tuple[int, int, int, int]] = []
    while heap and len(merges) < n_merges:
        top = heapq.heappop(heap)
        if top > last:
            break
        c, x = count[top[1]], top[1]
        if c != -top[0]:  # it fell since
            if (-c, x) <= last and c > 0:
                heapq.heappush(heap, (-c, x))
            continue
        left, right = x >> 32, x & 0xFFFFFFFF
        merges.append((left, right, new, c))
        del count[x]
        where = places.pop(x)
        fresh: dict[int, int] = {}
        fresh_at: dict[int, array] = {}
        for i in found[where[0]:where[1]] if type(where) is tuple else where:
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # one of the two has merged since
            w, h, k = weight[i], before[i], after[j]
            if h >= 0:
                y = ids[h]
                if (z := y << 32 | left) in count:
                    count[z] -= w
                elif z in fresh:  # (new, left), where places follow each other
                    fresh[z] -= w
                z = y << 32 | new
                fresh[z] = fresh.get(z, 0) + w
                fresh_at.setdefault(z, array("i")).append(h)
            if k >= 0:
                y = ids[k]
                if (z := right << 32 | y) in count:
                    count[z] -= w
                z = new << 32 | y
                fresh[z] = fresh.get(z, 0) + w
                fresh_at.setdefault(z, array("i")).append(i)
                before[k] = i
            ids[i], ids[j], after[i] = new, -1, k
        for z, c in fresh.items():
            if c > 0 and (-c, z) <= last:
                count[z], places[z] = c, fresh_at[z]
                heapq.heappush(heap, (-c, z))
        new += 1
    return merges


def bpe_train(counts: DataFrame, vocab_size: int, chunk: str = "chunk", n: str = "n",
              checkpoint_every: int = 8, most_pairs: int = 1 << 16, most_ids: int = 1 << 20):
    """Learn ``vocab_size - 256 - len(SPECIAL_TOKENS)`` merges, or as many as there are pairs; returns (vocab, merges) DataFrames.

    A round takes ``most_pairs`` pairs at most, and no more than have segments of ``most_ids`` ids in all,
    but one at least.  Sequences are written anew when ``checkpoint_every`` merges were found since.
    """
    spark = counts.sparkSession
    n_merges = vocab_size - N_BYTES - len(SPECIAL_TOKENS)
    if n_merges < 0:
        raise ValueError("vocab_size must leave room for 256 bytes and the special tokens")
    seqs = counts.select(byte_tokens(chunk).alias("seq"), F.col(n).cast("long").alias("n")).filter(
        F.size("seq") >= 2)
    seqs = materialised(seqs.repartition(default_buckets(seqs)), "bpe-seqs")  # all tasks work, however few bytes it is
    merges = []
    pending: list[tuple[int, int, int]] = []  # merges since the sequences were written
    some = FIRST_PAIRS
    while len(merges) < n_merges:
        top = pair_counts(seqs, pending).orderBy(F.desc("count"), "l", "r").limit(most_pairs + 1).toArrow()
        if not top.num_rows:
            break
        left, right, count, places = (top.column(c).to_numpy().astype(np.int64) for c in ("l", "r", "count", "places"))
        pairs = left << 32 | right
        few = int(np.searchsorted(2 * np.cumsum(places), most_ids, side="right"))  # their segments can't have more ids
        k = min(max(some, few, 1), most_pairs, len(pairs))
        while True:
            segs = materialised(segments(seqs, pending, np.sort(pairs[:k])), "bpe-segs")
            n_ids = (segs.agg(F.sum(F.octet_length("seg"))).first()[0] or 0) // 4
            if n_ids <= most_ids or k == 1:
                break
            k = max(1, k // 4)
        some = min(4 * k, most_pairs) if n_ids < most_ids // 4 else k
        segs = segs.toArrow()
        size = pc.binary_length(segs.column("seg")).to_numpy().astype(np.int64) // 4
        flat = np.frombuffer(b"".join(segs.column("seg").to_pylist()), np.int32)
        whole = k == len(pairs)
        found = greedy_merges(flat, size, segs.column("n").to_numpy(), None if whole else (-int(count[k - 1]), int(pairs[k - 1])), N_BYTES + len(merges), n_merges - len(merges))
        merges += [(len(merges) + r, *m) for r, m in enumerate(found)]
        pending += [m[:3] for m in found]
        if whole or len(merges) == n_merges:
            break
        if len(pending) >= checkpoint_every:
            seqs, pending = materialised(merged_seqs(seqs, pending), "bpe-seqs"), []
    token_bytes = {i: bytes([i]) for i in range(N_BYTES)}
    for _, left, right, new, _ in merges:
        token_bytes[new] = token_bytes[left] + token_bytes[right]
    n_merge = len(merges)
    # n_bytes_compat: bytes after decode (invalid sequences -> U+FFFD) and re-encode
    vocab = [(i, token_bytes[i], False, len(token_bytes[i].decode("utf-8", errors="replace").encode("utf-8")))
             for i in range(N_BYTES + n_merge)]
    vocab += [(N_BYTES + n_merge + i, s.encode("utf-8"), True, 0) for i, s in enumerate(SPECIAL_TOKENS)]
    vocab_df = spark.createDataFrame(vocab, "token_id int, bytes binary, is_special boolean, n_bytes_compat int")
    merges_df = spark.createDataFrame(merges, "rank int, left int, right int, token_id int, count long")
    return vocab_df, merges_df


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a chunk: the pair of neighbours whose bytes have the lowest rank merges first, the leftmost of equals.

    Parts are a linked list over the places of the chunk and pairs wait in a heap, so that a
    long chunk costs n log n.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    pairs = [(ranks[piece[i:i + 2]], i, i + 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
    heapq.heapify(pairs)
    while pairs:
        _, i, end = heapq.heappop(pairs)
        mid = after[i]
        if not alive[i] or mid >= n or after[mid] != end:
            continue  # one of the two has merged since
        after[i], alive[mid] = end, False
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i:after[end]])) is not None:
                heapq.heappush(pairs, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(pairs, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start:start + size]``, one after the other."""
    begin = np.cumsum(size) - size
    return flat[np.repeat(start - begin, size) + np.arange(int(size.sum()))]


ENTRIES = 1 << 20  # chunks or ids that are worked on at a time


def _cut(lists: pa.ListArray, entries: int = ENTRIES) -> Iterator[pa.ListArray]:
    """Consecutive rows of a batch, in slices of about so many entries; a longer row is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64))
    a = 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + entries, side="right")))
        yield lists.slice(a, b - a)
        a = b


def _in_slices(fn, lists: pa.ListArray, kind: pa.DataType) -> pa.Array:
    """``fn`` of a batch, a slice at a time, so that what it needs beside its result doesn't grow with the batch."""
    parts = [fn(part) for part in _cut(lists)]
    out = pa.concat_arrays(parts) if parts else pa.array([], kind)
    del parts
    pa.default_memory_pool().release_unused()
    return out


class _Pieces:
    """Ids of distinct chunks, kept over the batches of a task, about ``most`` of them at a time; long ones aren't kept."""

    def __init__(self, ranks: dict[bytes, int], most: int = 500_000, longest: int = 64):
        self.ranks, self.most, self.longest = ranks, most, longest
        self.known: dict[str, list[int]] = {}

    def encode(self, chunks: pa.ListArray) -> pa.ListArray:
        """The ids of each list of chunks."""
        return _in_slices(self._encode, chunks, pa.list_(pa.int32()))

    def _encode(self, chunks: pa.ListArray) -> pa.ListArray:
        """Each distinct chunk of the slice is looked up once."""
        counts = pc.fill_null(pc.list_value_length(chunks), 0).to_numpy().astype(np.int64)
        coded = pc.list_flatten(chunks).cast(pa.string()).dictionary_encode()
        if len(self.known) > self.most:
            self.known.clear()
        ids = []
        for c in coded.dictionary.to_pylist():
            own = self.known.get(c)
            if own is None:
                own = encode_piece(c.encode("utf-8"), self.ranks) if c else []
                if len(c) <= self.longest:
                    self.known[c] = own
            ids.append(own)
        size = np.fromiter((len(x) for x in ids), np.int64, len(ids))
        flat = np.fromiter((t for x in ids for t in x), np.int32, int(size.sum()))
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = _gathered(flat, (_offsets(size)[:-1])[which], size[which])
        ends = _offsets(size[which])[_offsets(counts)].astype(np.int32)
        missing = chunks.is_null().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(missing, False)) if missing.any() else pa.array(ends), pa.array(tokens, pa.int32()))


class BPEEncoder:
    """Encoder with the same interface as ``ByteEncoder`` (ids, specials, encode/decode Columns).

    ``ranks`` gives the id of each mergeable token by its bytes, 0, 1, ...; they are shipped
    once to each executor, and bounded by the size of the vocabulary.
    """

    name = "bpe"

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ids of mergeable tokens must be 0, 1, ...")
        self.n_mergeable = len(ranks)
        self.special = {s: self.n_mergeable + i for i, s in enumerate(SPECIAL_TOKENS)}
        self.bos = self.special["<|bos|>"]
        self.token_bytes = {i: b for b, i in ranks.items()}
        self._udfs(spark.sparkContext.broadcast(ranks))

    @classmethod
    def trained(cls, vocab: DataFrame, merges: DataFrame) -> BPEEncoder:
        """Of the tables of ``bpe_train``; of tokens with equal bytes the first counts."""
        rows = vocab.filter(~F.col("is_special")).orderBy("token_id").select("token_id", "bytes").collect()
        ranks: dict[bytes, int] = {}
        for r in rows:
            ranks.setdefault(bytes(r["bytes"]), len(ranks))
        return cls(vocab.sparkSession, ranks)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> BPEEncoder:
        """Of a vocabulary file with a token in base64 and its id on each line."""
        lines = spark.read.text(path).filter(F.length("value") > 0).collect()
        return cls(spark, {base64.b64decode(t): int(i) for t, i in (r[0].split() for r in lines)})

    def _udfs(self, ranks):
        @F.arrow_udf("array<int>")
        def encode_chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            pieces = _Pieces(ranks.value)
            for chunks in batches:
                yield pieces.encode(chunks)

        @F.arrow_udf("array<array<int>>")
        def encode_nested(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            pieces = _Pieces(ranks.value)
            for texts in batches:
                counts = pc.fill_null(pc.list_value_length(texts), 0).to_numpy().astype(np.int64)
                missing = texts.is_null().to_numpy(zero_copy_only=False)
                ends = _offsets(counts).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends, mask=np.append(missing, False)) if missing.any() else pa.array(ends), pieces.encode(pc.list_flatten(texts)))

        @F.arrow_udf("string")
        def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = sorted((i, b) for b, i in ranks.value.items())
            data = np.frombuffer(b"".join(b for _, b in tokens), np.uint8)
            size = np.array([len(b) for _, b in tokens] + [0], np.int64)  # one more: specials have no bytes
            start = _offsets(size)[:-1]

            def decode(ids: pa.ListArray) -> pa.Array:
                flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False)
                flat = np.where((flat >= 0) & (flat < len(tokens)), flat, len(tokens)).astype(np.int64)
                body = _gathered(data, start[flat], size[flat]).tobytes()
                counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64)
                ends = _offsets(size[flat])[_offsets(counts)].tolist()
                return pa.array([body[a:b].decode("utf-8", errors="replace") if ok else None for a, b, ok in
                                 zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)], pa.string())

            for ids in batches:
                yield _in_slices(decode, ids, pa.string())

        self._encode_chunks, self._encode_nested, self._decode = encode_chunks, encode_nested, decode_ids

    def encode(self, text: Column) -> Column:
        return self._encode_chunks(pretokenize(text))

    def encode_array(self, arr: Column) -> Column:
        return self._encode_nested(F.transform(arr, lambda t: pretokenize(t)))

    def encode_array2(self, arr: Column) -> Column:
        flat = F.transform(arr, lambda a: F.transform(a, lambda t: pretokenize(t)))
        # one UDF call per row: flatten the outer level, encode, and regroup by sizes
        sizes = F.transform(arr, lambda a: F.size(a))
        enc = self._encode_nested(F.flatten(flat))
        starts = F.transform(sizes, lambda n, i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x))
        return F.zip_with(starts, sizes, lambda st, n: F.slice(enc, st + 1, n))

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)

    def count(self, text: Column) -> Column:
        return F.size(self.encode(text))


def token_bytes_table(vocab: DataFrame) -> DataFrame:
    """Bytes per id: ``n_bytes_true`` and ``n_bytes_compat`` (decode then encode, so an
    invalid lone byte counts 3 for U+FFFD); specials have 0."""
    return vocab.select("token_id", "is_special",
                        F.when(F.col("is_special"), 0).otherwise(F.octet_length("bytes")).alias("n_bytes_true"),
                        "n_bytes_compat")


def token_byte_stats(tb: DataFrame, col: str = "n_bytes_compat") -> DataFrame:
    nz = tb.filter(F.col(col) > 0)
    return nz.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"),
                  F.stddev_samp(col).alias("std"), F.count(F.lit(1)).alias("n"))
