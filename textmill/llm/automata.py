"""Substring dedup by suffix automata of reference shards: every repeated run of words goes.

A word goes if a window of ``LENGTH`` words that covers it also starts anywhere else, in the
same document or in another; no copy stays.

1. The run of ``GRAM`` words with the smallest hash in a window is its anchor.  Equal windows
   have equal anchors at equal places, so anchors that occur once settle all their windows.
2. The words that the windows of a shared anchor cover, its context, are dealt to a shard by
   the anchor.  The distinct contexts of a shard, with the number of their occurrences, are its
   reference: their suffix automaton keeps the states that occur at least twice, and is written.
3. Each automaton is broadcast to all the parts, of bounded size, that hold contexts of its
   shard, and these are streamed through it.  The matching statistics, the length of the longest
   repeated string of words that ends at each word, reach ``LENGTH`` where a window is repeated;
   such windows merge into maximal spans, which are cut out of the documents.

An automaton isn't broadcast to every task: the reference is the corpus itself, so all of them
together grow with the input, and every document would be streamed through every one of them.
A shared passage costs its shard one context for each batch of documents, however many have it.
Contexts of anchors that more than ``HOT`` places have are dealt window by window, by the
window's own words, so that no shard has to hold the surroundings of all of them.  Windows are
compared by their words; hashes only deal them out.

Defined cases: a null or empty text has no words and loses nothing; rows that repeat a text,
with the same id, another or none, are copies of each other and go whole if they have ``LENGTH``
words; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, table
from .suffix_dedup import merged
from .words import _LETTER, prefix_hash, scramble, shards, span_hash

LENGTH = 35
GRAM = 8
HOT = 20_000
SAMPLE = 64
BUCKET = 500_000  # anchors, about
SHARD_BYTES = 1 << 20  # bytes of text looked at at once; a longer text is a shard of its own
CONTEXTS = 4_000  # of a shard, about
PART = 20_000  # contexts that are streamed in one place, about
LAST = (1 << 63) - 1  # stands for a null id


class Sequences:
    """Words of texts that have one space between words: text number, byte bounds and hash."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        inside = self.data != 0x20
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = span_hash(prefix_hash(_LETTER[self.data]), self.start, self.end)
        base = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        doc = np.searchsorted(base, self.start, side="right") - 1
        self.count = np.bincount(doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.count)])  # first word of each text

    def text(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last``, both included, of one text."""
        return self.data[self.start[first]:self.end[last]].tobytes()


def anchors(words: Sequences, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(token, text number, first window, number of windows) of each anchor; windows by their first word."""
    long = np.flatnonzero(words.count >= length)
    if not len(long):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    n = len(words.hash) - gram + 1
    best = span_hash(prefix_hash(words.hash), np.arange(n), np.arange(gram, n + gram))
    grams, at, span, width = best, np.arange(n), 1, length - gram + 1
    while span < width:  # the smallest of ``span`` grams, the first of equal ones
        step = min(span, width - span)
        less = best[step:] < best[:-step]
        at, best, span = np.where(less, at[step:], at[:-step]), np.where(less, best[step:], best[:-step]), span + step
    windows = words.count[long] - length + 1
    doc = np.repeat(long, windows)
    start = np.repeat(words.first[long], windows) + np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    own = at[start]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]))
    number = np.diff(np.concatenate([first, [len(start)]]))
    return scramble(grams[own[first]]), doc[first], start[first] - words.first[doc[first]], number


class Automaton:
    """Suffix automaton of several sequences of symbols, with the occurrences of each state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.occurs = [-1], [0], [0]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.occurs.append(0)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that ``p`` reaches by ``c``, cut so that the way through ``p`` is its longest."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        half = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = half
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = half
            p = self.link[p]
        return half

    def add(self, symbols: list[int], times: int) -> None:
        last = 0
        for c in symbols:
            if c in self.next[last]:
                last = self._split(last, c)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c)
                last = new
            self.occurs[last] += times

    def repeated(self) -> tuple[np.ndarray, ...]:
        """(link, length, from, symbol, to) of the states that occur at least twice; the root is 0.

        What a repeated string holds is repeated, so links and ways from the root stay inside.
        """
        length, link = np.array(self.length), np.array(self.link)
        occurs = self.occurs
        for s in np.argsort(-length, kind="stable")[:-1].tolist():
            occurs[self.link[s]] += occurs[s]
        kept = np.array(occurs) >= 2
        kept[0] = True
        new = np.cumsum(kept) - 1
        edges = [(s, c, t) for s in np.flatnonzero(kept).tolist() for c, t in self.next[s].items() if kept[t]]
        a, c, b = np.array(edges, np.int64).reshape(-1, 3).T
        links = link[kept]
        links[1:] = new[links[1:]]
        return links, length[kept], new[a], c, new[b]


def matching(ways: dict[int, int], link: list[int], length: list[int], symbols: list[int], size: int) -> list[int]:
    """For each symbol the length of the longest string of the automaton that ends there; ``ways`` is by state * size + symbol."""
    out, state, n = [], 0, 0
    for c in symbols:
        to = ways.get(state * size + c)
        while to is None and state:
            state = link[state]
            n = length[state]
            to = ways.get(state * size + c)
        if to is None:
            n = 0
        else:
            state, n = to, n + 1
        out.append(n)
    return out


def _ints(values, kind: str) -> bytes:
    return np.asarray(values).astype(kind).tobytes()


def sequence(text: bytes) -> bytes:
    """The words of a text with one space between them; ASCII white space is the contract's."""
    return b" ".join(text.split())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, d, x, n_words): the digest of a text's words, and its first bytes as a number."""
    for batch in batches:
        bodies = [sequence(t) for t in batch.column("text").to_pylist()]
        digests = [hashlib.sha256(t).digest() for t in bodies]
        yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(digests, pa.binary()), pa.array([_number(d) for d in digests], pa.int64()),
                                          pa.array([t.count(b" ") + 1 if t else 0 for t in bodies], pa.int64())], ["i", "d", "x", "n_words"])


def _number(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _distinct(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], Sequences]]:
    """(x, copies in the batch, words) of the texts of a batch, each once, some at a time."""
    copies: dict[bytes, int] = {}
    for t in batch.column("text").to_pylist():
        t = sequence(t)
        copies[t] = copies.get(t, 0) + 1
    bodies, times = list(copies), list(copies.values())
    for lo, hi in shards(bodies, SHARD_BYTES):
        yield [_number(hashlib.sha256(t).digest()) for t in bodies[lo:hi]], times[lo:hi], Sequences(bodies[lo:hi])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, times, words in _distinct(batch):
            token, doc, _, _ = anchors(words)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(np.array(times, np.int64)[doc])], ["token", "n"])


def _bounds(values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values start and end."""
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _spread(buckets: int, known: list[int]):
    """The anchors of each piece of a batch by bucket: anchors, their texts, and how often they occur.

    Those known to be very common meet nowhere: buckets from ``buckets`` on only pass them on.
    """
    common = np.array(known, np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, times, words in _distinct(batch):
                token, doc, _, _ = anchors(words)
                order = np.lexsort((doc, token))
                token, doc = token[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])[:len(token)])
                number = np.diff(np.concatenate([first, [len(token)]])) * np.array(times, np.int64)[doc[first]]
                token, node = token[first], np.array(x, np.int64)[doc[first]]
                bucket = (((token >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                bucket[np.isin(token, common)] = buckets + abs(x[0]) % buckets
                order = np.argsort(bucket, kind="stable")
                token, node, number, bucket = token[order], node[order], np.minimum(number[order], 255), bucket[order]
                rows = [(int(bucket[a]), token[a:b].tobytes(), node[a:b].tobytes(), _ints(number[a:b], "u1")) for a, b in _bounds(bucket)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], ["bucket", "tokens", "nodes", "numbers"])
    return run


def _met(buckets: int):
    """(x, tokens, hot, places) of the anchors of a bucket that occur more than once."""
    def run(rows: pa.Table) -> pa.Table:
        token, node, number = (np.concatenate([np.frombuffer(v, t) for v in rows.column(c).to_pylist()]) for c, t in (("tokens", np.uint64), ("nodes", np.int64), ("numbers", np.uint8)))
        passed = rows.column("bucket")[0].as_py() >= buckets
        _, of = np.unique(token, return_inverse=True)
        total = np.bincount(of, number)[of]
        many = (total > 1) | passed
        token, node, hot = token[many], node[many], (total[many] > HOT) | passed
        order = np.argsort(node, kind="stable")
        token, node, hot = token[order], node[order], hot[order]
        runs = _bounds(node)
        return pa.table({"x": pa.array([int(node[a]) for a, _ in runs], pa.int64()), "tokens": pa.array([token[a:b].tobytes() for a, b in runs], pa.binary()),
                         "hot": pa.array([token[a:b][hot[a:b]].tobytes() for a, b in runs], pa.binary()), "places": pa.array([b - a for a, b in runs], pa.int64())})
    return run


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, d, size, z): the words of texts that can hold a window, as zstd, for an exchange."""
    for batch in batches:
        rows = [(i, t) for i, t in zip(batch.column("i").to_pylist(), map(sequence, batch.column("text").to_pylist()), strict=True) if t.count(b" ") + 1 >= LENGTH]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([hashlib.sha256(t).digest() for _, t in rows], pa.binary()),
                                          pa.array([len(t) for _, t in rows], pa.int64()), pa.array([pa.compress(t, "zstd", asbytes=True) for _, t in rows], pa.binary())], ["i", "d", "size", "z"])


def _parts(sizes: list[int]) -> list[tuple[int, int]]:
    """Ranges of texts of about ``SHARD_BYTES``."""
    out, start, size = [], 0, 0
    for k, n in enumerate(sizes):
        if size and size + n > SHARD_BYTES:
            out.append((start, k))
            start, size = k, 0
        size += n
    return [*out, (start, len(sizes))] if sizes else out


CONTEXT = {"shard": pa.int64(), "number": pa.int64(), "tokens": pa.binary(), "times": pa.binary(), "sizes": pa.binary(), "size": pa.int64(), "z": pa.binary(),
           "docs": pa.list_(pa.binary()), "of": pa.binary(), "doc": pa.binary(), "at": pa.binary()}
CONTEXT_ROW = "shard long, number long, tokens binary, times binary, sizes binary, size long, z binary, docs array<binary>, of binary, doc binary, at binary"


def _contexts(number: int):
    """A row for each shard and piece of a batch: distinct contexts, and where each occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zs, sizes, ds, weight = (batch.column(c).to_pylist() for c in ("z", "size", "d", "copies"))
            wanted, hot = ([np.frombuffer(b"".join(x), np.uint64) for x in batch.column(c).to_pylist()] for c in ("tokens", "hot"))
            for lo, hi in _parts(sizes):
                words = Sequences([pa.decompress(z, n, "zstd", asbytes=True) for z, n in zip(zs[lo:hi], sizes[lo:hi], strict=True)])
                token, doc, start, count = anchors(words)
                keep, is_hot = np.zeros(len(token), bool), np.zeros(len(token), bool)
                edges = np.searchsorted(doc, np.arange(hi - lo + 1))
                for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    keep[a:b] = np.isin(token[a:b], wanted[lo + k])
                    if len(hot[lo + k]):
                        is_hot[a:b] = np.isin(token[a:b], hot[lo + k])
                token, doc, start, count, is_hot = (x[keep] for x in (token, doc, start, count, is_hot))
                if is_hot.any():  # each window by itself, dealt by its own words
                    many = np.flatnonzero(is_hot)
                    s = np.repeat(start[many], count[many]) + np.arange(count[many].sum()) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
                    d = np.repeat(doc[many], count[many])
                    first = words.first[d] + s
                    own = scramble(scramble(span_hash(prefix_hash(words.hash), first, first + LENGTH)))
                    token, doc, start, count = (np.concatenate([x[~is_hot], y]) for x, y in ((token, own), (doc, d), (start, s), (count, np.ones(len(s), np.int64))))
                shard = ((token >> np.uint64(32)) * np.uint64(number)) >> np.uint64(32)
                order = np.argsort(shard, kind="stable")
                shard, token, doc, start, count = (x[order].astype(np.int64) if k != 1 else x[order] for k, x in enumerate((shard, token, doc, start, count)))
                rows = []
                for a, b in _bounds(shard):
                    first = words.first[doc[a:b]] + start[a:b]
                    place: dict[tuple[int, bytes], int] = {}
                    of = [place.setdefault((t, words.text(f, f + n + LENGTH - 2)), len(place)) for t, f, n in zip(token[a:b].tolist(), first.tolist(), count[a:b].tolist(), strict=True)]
                    times = np.bincount(of, [min(weight[lo + k], 2) for k in doc[a:b].tolist()]).astype(np.int64)
                    own, which = np.unique(doc[a:b], return_inverse=True)
                    text = b"".join(t for _, t in place)
                    rows.append((int(shard[a]), b - a, np.array([t for t, _ in place], np.uint64).tobytes(), _ints(times, "<i8"), _ints([len(t) for _, t in place], "<i4"),
                                 len(text), pa.compress(text, "zstd", asbytes=True), [ds[lo + k] for k in own.tolist()], _ints(of, "<i4"), _ints(which, "<i4"), _ints(start[a:b], "<i4")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CONTEXT.values(), strict=True)], list(CONTEXT))
    return run


def _listed(row: dict) -> Iterator[tuple[int, bytes]]:
    """(token, text) of the distinct contexts of a row."""
    text, ends = pa.decompress(row["z"], row["size"], "zstd", asbytes=True), np.cumsum(np.frombuffer(row["sizes"], "<i4")).tolist()
    return zip(np.frombuffer(row["tokens"], np.uint64).tolist(), (text[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True)


AUTOMATON = "shard long, whole binary, words binary, link binary, length binary, source binary, symbol binary, target binary"


def _automaton(rows: pa.Table) -> pa.Table:
    """The automaton of a shard.  An anchor with a single context needs none: it is whole if it occurs twice."""
    contexts: dict[int, dict[bytes, int]] = {}
    for row in rows.to_pylist():
        for (token, text), n in zip(_listed(row), np.frombuffer(row["times"], "<i8").tolist(), strict=True):
            own = contexts.setdefault(token, {})
            own[text] = own.get(text, 0) + n
    whole = [t for t, own in contexts.items() if len(own) == 1 and next(iter(own.values())) >= 2]
    symbols: dict[bytes, int] = {}
    automaton = Automaton()
    for own in contexts.values():
        if len(own) > 1:
            for text, n in own.items():
                automaton.add([symbols.setdefault(w, len(symbols)) for w in text.split(b" ")], n)
    link, length, source, symbol, target = automaton.repeated()
    used, symbol = np.unique(symbol, return_inverse=True)
    words = list(symbols)
    out = (rows.column("shard")[0].as_py(), np.array(whole, np.uint64).tobytes(), b" ".join(words[k] for k in used.tolist()), *(_ints(x, "<i4") for x in (link, length, source, symbol, target)))
    return pa.table({n: pa.array([v], pa.int64() if n == "shard" else pa.binary()) for n, v in zip((x.split()[0] for x in AUTOMATON.split(", ")), out, strict=True)})


def _streamed(left: pa.Table, right: pa.Table) -> pa.Table:
    """(d, spans) of the contexts of a part; spans are pairs of int32 in words."""
    found: dict[bytes, list[np.ndarray]] = {}
    if left.num_rows and right.num_rows:
        own = left.to_pylist()[0]
        whole = set(np.frombuffer(own["whole"], np.uint64).tolist())
        numbers = {w: k for k, w in enumerate(own["words"].split(b" "))}
        size = len(numbers) + 1  # one more for any other word
        link, length, source, symbol, target = (np.frombuffer(own[c], "<i4").astype(np.int64) for c in ("link", "length", "source", "symbol", "target"))
        ways = dict(zip((source * size + symbol).tolist(), target.tolist(), strict=True))
        link, length = link.tolist(), length.tolist()
        for row in right.to_pylist():
            spans = []
            for token, text in _listed(row):
                if token in whole:
                    spans.append(np.array([[0, text.count(b" ") + 1]]))
                    continue
                reach = np.array(matching(ways, link, length, [numbers.get(w, size - 1) for w in text.split(b" ")], size))
                ends = np.flatnonzero(reach >= LENGTH) + 1
                spans.append(merged(np.column_stack([ends - LENGTH, ends])) if len(ends) else np.zeros((0, 2), np.int64))
            for of, doc, at in zip(*(np.frombuffer(row[c], "<i4").tolist() for c in ("of", "doc", "at")), strict=True):
                if len(spans[of]):
                    found.setdefault(row["docs"][doc], []).append(spans[of] + at)
    return pa.table({"d": pa.array(list(found), pa.binary()), "spans": pa.array([_ints(merged(np.concatenate(v)), "<i4") for v in found.values()], pa.binary())})


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for d, z, size, parts in zip(*(batch.column(c).to_pylist() for c in ("d", "z", "size", "spans")), strict=True):
            words = pa.decompress(z, size, "zstd", asbytes=True).split(b" ")
            spans = merged(np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2).astype(np.int64))
            edges = [0, *spans.ravel().tolist(), len(words)]
            kept = b" ".join(w for a, b in zip(edges[0::2], edges[1::2], strict=True) for w in words[a:b])
            rows.append((d, int((spans[:, 1] - spans[:, 0]).sum()), hashlib.sha256(kept).hexdigest(), spans.ravel().tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)],
                                             ["d", "n_removed", "kept", "edges"])


def _very_common(rows: DataFrame) -> list[int]:
    """At most a thousand anchors: those with a thousandth or more of the occurrences in one text of ``SAMPLE``.

    They occur twice for sure, and often, so they needn't meet.  The choice changes the work, never the result.
    """
    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_tokens, "token long, n long")
    counts = cut(some.groupBy("token").agg(F.sum("n").alias("n")), "automata-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in counts.filter(F.col("n") >= max(total / 1000, HOT / SAMPLE, 2)).collect()]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: i (its id), d (digest of its words), n_words, n_removed, kept_sha256, edges.

    ``edges`` are the bounds of the removed spans, in words: start, end, start, end, ...
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("i"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    every = cut(rows.mapInArrow(_rows, "i long, d binary, x long, n_words long"), "automata-rows")
    firsts = every.groupBy("d").agg(F.min("i").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))

    total = every.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(partitions(docs), math.ceil(total / 14 / BUCKET))
    found = rows.select("text").mapInArrow(_spread(buckets, _very_common(rows)), "bucket long, tokens binary, nodes binary, numbers binary")
    found = cut(found.groupBy("bucket").applyInArrow(_met(buckets), "x long, tokens binary, hot binary, places long"), "automata-shared")
    number = found.agg(F.sum("places")).first()[0] or 0
    lists = found.groupBy("x").agg(F.collect_list("tokens").alias("tokens"), F.collect_list("hot").alias("hot"))  # of one text; of two with one x, both have all
    near = firsts.join(lists.withColumnRenamed("x", "of"), F.col("x") == F.col("of")).select("rep", F.col("d").alias("rd"), "copies", "tokens", "hot")
    small = rows.mapInArrow(_deflated, "i long, d binary, size long, z binary")
    count = max(partitions(docs), math.ceil(number / CONTEXTS))
    contexts = small.join(near, (F.col("i") == F.col("rep")) & (F.col("d") == F.col("rd"))).select("d", "size", "z", "copies", "tokens", "hot")
    contexts = cut(contexts.mapInArrow(_contexts(count), CONTEXT_ROW), "automata-contexts")

    automata = cut(contexts.select("shard", "tokens", "times", "sizes", "size", "z").groupBy("shard").applyInArrow(_automaton, AUTOMATON), "automata")
    filled = contexts.groupBy("shard").agg(F.ceil(F.sum("number") / PART).alias("parts"))
    sent = automata.join(filled.select(F.col("shard").alias("s"), "parts"), F.col("shard") == F.col("s")).drop("s")
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    dealt = contexts.select("shard", "tokens", "sizes", "size", "z", "docs", "of", "doc", "at").join(filled.select(F.col("shard").alias("s"), "parts"), F.col("shard") == F.col("s")).drop("s")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("of", "at", F.col("docs")[0]), "parts")).drop("parts")
    spans = sent.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(_streamed, "d binary, spans binary")
    spans = cut(spans, "automata-spans").groupBy("d").agg(F.collect_list("spans").alias("spans"))  # of one document
    spans = spans.join(firsts.select(F.col("d").alias("fd"), "rep"), F.col("d") == F.col("fd")).select(F.col("fd"), "rep", "spans")
    gone = (small.join(spans, (F.col("i") == F.col("rep")) & (F.col("d") == F.col("fd"))).select("d", "z", "size", "spans")
            .mapInArrow(_cut_out, "d binary, n_removed long, kept string, edges array<long>"))
    gone = gone.groupBy("d").agg(F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept"), F.first("edges").alias("edges"))  # a repeated row
    return every.join(gone, "d", "left").select(
        F.when(F.col("i") != LAST, F.col("i")).alias("i"), "d", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept", F.lower(F.hex("d"))).alias("kept_sha256"), F.coalesce("edges", F.array().cast("array<long>")).alias("edges"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats(table(spark, sf_dir, "documents"))
    return got.select(F.col("i").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
