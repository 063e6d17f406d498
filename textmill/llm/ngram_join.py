"""Exact n-gram Jaccard self-join and its components, by a token-group matrix.

A document's set holds its distinct five-word shingles (all words as one if fewer); documents
link when their sets have a Jaccard similarity of at least 0.8.

1. Equal sets become one node, found by set size and two 64-bit sums over the shingles, and
   numbered; components are of node numbers, whatever ids the rows have.
2. Similar sets share l shingles among the first n - ceil(0.8 n) + l of each, in any order of
   shingles common to all; l is 1 + n / ``SLACK``.  The order puts shingles that are frequent
   in a sample of the documents last (a shipped list of at most ``MAX_FREQUENT``; it decides
   how much work there is, never the result).  Shingles that two nodes share there are kept,
   and nodes that have enough of them.
3. Nodes that share one of four minimum hashes, or two of them, are compared with centres that
   a hash picks among them; links give first components, so that groups of thousands of near
   copies are one component.  A first round takes one centre of each minimum hash, a second
   one the other centres, where the first left two components.
4. Nodes are sorted by component and minimum hash and cut into groups of ``GROUP`` similar
   ones.  The token-group matrix has a row for each kept shingle and group.  Of two groups the
   later one's nodes query the earlier one: those that share enough kept shingles with it, as
   its members' sizes ask for, where it holds another component; a group whose union of shingles can't contain 0.8 of the query's set stays closed; in an opened
   one the exact similarities are computed.  Groups that follow one another are read as a
   block of bounded size, to which a query's set goes once for all its groups there; queries
   of a block are dealt to tasks by their size, so no task holds more than these and a block.
5. Components of all links, by large-star and small-star rounds over the link table.

Links inside a first component aren't listed, as they don't change components.

Defined cases: null or empty text, or one of spaces, has an empty set and is its own
component; of rows that repeat an id, each has its own set; a null id never is a component's
name, unless all its ids are null, so unlinked components can have the same name; ids come
before null ones where ``without_near_copies`` picks the row that stays; an empty table gives
an empty result; other columns are ignored, or kept by ``without_near_copies``, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_rows, cut, dense_sorted_index, partitions, table
from .words import GRAPH, Words, scramble, shards

WIDTH = 5
NUM, DEN = 80, 100  # a link needs DEN * intersection >= NUM * union
SLACK = 20  # of so many shingles one more is looked at, and has to be shared
SAMPLE = 32  # one document in so many tells which shingles are frequent
FREQUENT = 3  # times in the sample
MAX_FREQUENT = 200_000
LEADS = 3
GROUP = 32  # members of a group, a bit each
BLOCK = 128  # groups of a block at most
SHINGLES = 1 << 20  # of a block, one group more at most
QUERY_SHINGLES = 1 << 19  # of the queries that a task gets with a block
BUCKET_BYTES = 16 << 20
SHARD = 1 << 19  # bytes of text whose words a task holds at once
MARKS = 1 << 23  # bits that tell the texts of near nodes from most others, 1 MB
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SUMS = np.array([0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7], np.uint64)
_SEEDS = np.array([0, 0x5555555555555555, 0xCCCCCCCCCCCCCCCC, 0x0F0F0F0F0F0F0F0F], np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for lo, hi in shards(texts, SHARD):
        words = Words(texts[lo:hi], GRAPH)
        n = max(0, len(words.hash) - WIDTH + 1)
        sh = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            sh += scramble(words.hash[k:n + k] * _MULT[k])
        ok = words.doc[:n] == words.doc[WIDTH - 1:]
        doc, sh = words.doc[:n][ok], scramble(sh[ok])
        order = np.lexsort((sh, doc))
        doc, sh = doc[order], sh[order]
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
        doc, sh = doc[new], sh[new]
        at = np.searchsorted(doc, np.arange(hi - lo + 1))
        for k in range(hi - lo):
            if 0 < words.count[k] < WIDTH:  # too short: the whole sequence
                own = words.hash[words.first[k]:words.first[k + 1]]
                out.append(scramble(scramble(own * _MULT[:len(own)]).sum(keepdims=True) + np.uint64(len(own))))
            else:
                out.append(sh[at[k]:at[k + 1]])
    return out


def _sums(s: np.ndarray) -> tuple[int, int]:
    """Two sums over a set that tell it from other sets of its size."""
    a, b = (int(scramble(s * m).sum()) if len(s) else 0 for m in _SUMS)
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def packed(values: np.ndarray, width: int = 6) -> bytes:
    """The low ``width`` bytes of unsigned longs."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, width: int = 6) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").to_pylist()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text).alias("x"), text.cast("binary").alias("text"))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(_texts(batch))
        sums = [_sums(s) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("x"), pa.array([len(s) for s in sets], pa.int64()),
                                          pa.array([a for a, _ in sums], pa.int64()), pa.array([b for _, b in sums], pa.int64())], ["i", "x", "n", "k1", "k2"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(_texts(batch))
        token, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count, pa.int64())], ["token", "n"])


def frequent_shingles(rows: DataFrame) -> np.ndarray:
    """Sorted shingles that occur often in a sample of the documents; at most MAX_FREQUENT."""
    sample = rows.filter(F.pmod(F.xxhash64("i", "x"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).select("token").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def first_shingles(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of which similar sets share ``needed``: the first ones, frequent ones last."""
    n = len(s)
    take = n - -(-NUM * n // DEN) + 1 + n // SLACK
    if len(frequent):
        common = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        s = np.concatenate([s[~common], s[common]])
    return s[:take]


def needed(n):
    """How many of its first shingles a set of ``n`` shares with any similar one, which may be smaller."""
    return F.floor(F.floor(F.col(n) * NUM / DEN) / SLACK) + 1


def needed_between(n: str, lo: str, hi: str):
    """How many of its first shingles a set of ``n`` shares with any similar one of ``lo`` to ``hi`` shingles, at least.

    Two such sets of n and m share o >= NUM (n + m) / (NUM + DEN) shingles, of which the first
    take(n) - (n - o) are among the first of the one, take(m) - (m - o) among those of the other;
    the lesser is in both.  The first grows with m; the second is bounded by a line, least at an end.
    """
    n, lo, hi = F.col(n), F.greatest(lo, F.ceil(F.col(n) * NUM / DEN)), F.least(hi, F.floor(F.col(n) * DEN / NUM))
    one = 1 + F.floor(n / SLACK) - F.ceil(n * NUM / DEN) + F.ceil((n + lo) * NUM / (NUM + DEN))
    line = lambda m: 1 + (m - SLACK + 1) / SLACK - (m * NUM + DEN - 1) / DEN + (n + m) * NUM / (NUM + DEN)
    return F.least(one, F.ceil(F.least(line(lo), line(hi)) - 1e-6))


def _spread(frequent: np.ndarray, buckets: int):
    """Emit, for each batch and bucket of shingle hashes, the first shingles and their nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, tokens, nodes = set(), [], []
            for s in shingle_sets(_texts(batch)):
                if len(s) and (key := _sums(s)) not in seen:  # equal sets of a batch go once
                    seen.add(key)
                    tokens.append(first_shingles(s, frequent))
                    nodes.append(np.full(len(tokens[-1]), key[0], np.int64))
            if not tokens:
                continue
            token, node = np.concatenate(tokens), np.concatenate(nodes).view(np.uint64)
            bucket = ((token & np.uint64(0xFFFFFF)) * np.uint64(buckets)) >> np.uint64(24)
            token >>= np.uint64(16)  # of the bits that go, the bucket has most
            order = np.argsort(bucket, kind="stable")
            token, node, bucket = token[order], node[order], bucket[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            pairs = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in pairs], pa.int64()), pa.array([packed(token[a:b]) for a, b in pairs], pa.binary()),
                                              pa.array([packed(node[a:b]) for a, b in pairs], pa.binary())], ["bucket", "tokens", "nodes"])
    return run


def _met(rows: pa.Table) -> pa.Table:
    """(token, node) of the tokens of a bucket that several nodes have."""
    token = np.concatenate([unpacked(x) for x in rows.column("tokens").to_pylist()])
    node = np.concatenate([unpacked(x) for x in rows.column("nodes").to_pylist()])
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node = token[new], node[new]
    first = np.concatenate([[True], token[1:] != token[:-1]])
    many = (np.bincount(np.cumsum(first) - 1) > 1)[np.cumsum(first) - 1]
    return pa.table({"token": token[many].view(np.int64), "node": node[many].view(np.int64)})


def _described_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets and minimum hashes of rows whose set is the one the node stands for."""
    for batch in batches:
        n, k1, k2, rep = (batch.column(c).to_pylist() for c in ("n", "k1", "k2", "rep"))
        rows = [(rep[j], n[j], packed(s), [int(x) for x in (s[:, None] ^ _SEEDS).min(0).view(np.int64)])
                for j, s in enumerate(shingle_sets(_texts(batch))) if len(s) == n[j] and len(s) and _sums(s) == (k1[j], k2[j])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["rep", "n", "set", "least"])


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(b) < len(a):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if DEN * min(len(a), len(b)) < NUM * max(len(a), len(b)):
        return False
    both = _overlap(a, b)
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y, sx, sy = (batch.column(c).to_pylist() for c in ("x", "y", "sx", "sy"))
        ok = [j for j in range(len(x)) if _linked(np.sort(unpacked(sx[j])), np.sort(unpacked(sy[j])))]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for j in ok], pa.int64()), pa.array([y[j] for j in ok], pa.int64())], ["x", "y"])


class _Group:
    """Up to GROUP member sets as one union of shingles, with a bit for each member that has the shingle."""

    def __init__(self, sets: list[np.ndarray], reps: list[int], comps: list[int]):
        self.reps, self.comps, self.sizes = reps, comps, np.array([len(s) for s in sets])
        token = np.concatenate(sets)
        bit = np.repeat(np.uint32(1) << np.arange(len(sets), dtype=np.uint32), self.sizes)
        order = np.argsort(token, kind="stable")
        token, bit = token[order], bit[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        self.union, self.bits = token[first], np.bitwise_or.reduceat(bit, first).astype("<u4")

    def links(self, s: np.ndarray) -> list[tuple[int, int]]:
        """(rep, comp) of the members similar to the set ``s``; none if the union can't hold enough of it."""
        at = np.minimum(np.searchsorted(self.union, s), len(self.union) - 1)
        at = at[self.union[at] == s]
        if DEN * len(at) < NUM * len(s):
            return []  # the group stays closed
        both = np.unpackbits(self.bits[at].view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").sum(0, dtype=np.int64)[:len(self.reps)]
        ok = DEN * both >= NUM * (len(s) + self.sizes - both)
        return [(self.reps[j], self.comps[j]) for j in np.flatnonzero(ok)]


def _opened(queries: pa.Table, members: pa.Table) -> pa.Table:
    """Links between queries and the members of the groups of a block that they ask."""
    g, reps, comps, own = (members.column(c).to_pylist() for c in ("g", "rep", "comp", "own"))
    of: dict[int, list[int]] = {}
    for j, group in enumerate(g):
        of.setdefault(group, []).append(j)
    groups = {k: _Group([unpacked(own[j]) for j in rows], [reps[j] for j in rows], [comps[j] for j in rows]) for k, rows in of.items()}
    links = []
    for x, comp, s, asked in zip(*(queries.column(c).to_pylist() for c in ("x", "comp", "set", "asked")), strict=True):
        mine, done = unpacked(s), {comp}
        for k in asked:
            for y, other in groups[k].links(mine):
                if other not in done:
                    done.add(other)  # further links to this component change nothing
                    links.append((x, y))
    return pa.table({"x": pa.array([a for a, _ in links], pa.int64()), "y": pa.array([b for _, b in links], pa.int64())})


def _marked(rows: DataFrame, near: DataFrame) -> DataFrame:
    """``rows`` without most of those whose text is no near node's, by a bitmap of MARKS bits; only work depends on it."""
    at = near.select(F.expr(f"cast(pmod(text_hash, {MARKS}) as int)").alias("at"))
    words = at.groupBy(F.expr("shiftright(at, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, at & 63))").alias("bits")).toArrow()
    bits = np.zeros(MARKS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    spark = rows.sparkSession
    marks = spark.createDataFrame(pa.table({"bits": pa.array([bits], pa.list_(pa.int64()))}))
    mark = F.expr(f"getbit(get(bits, cast(shiftright(pmod(x, {MARKS}), 6) as int)), cast(pmod(x, {MARKS}) as int) & 63) = 1")
    return rows.join(F.broadcast(marks), mark, "leftsemi")


def components(links: DataFrame) -> DataFrame:
    """(u, comp) of every linked node but the smallest of its component, which is ``comp``."""
    lo, hi = F.least("x", "y"), F.greatest("x", "y")
    edges = cut(links.filter("x != y").select(hi.alias("u"), lo.alias("v")).distinct(), "links")  # u > v
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == state:
            return edges.select("u", F.col("v").alias("comp"))
        state = tuple(now)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))  # large star
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # small star
        small = large.join(least, "u")
        edges = cut(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: i, x (hash of the text), n_shingles, component (its key; null if the set is empty), component_id."""
    rows = _rows(docs, id_col, text_col)
    every = cut(rows.mapInArrow(_describe, "i long, x long, n long, k1 long, k2 long"), "sets")
    nodes = every.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min(F.struct(F.col("i").isNull().alias("no"), "i", "x")).alias("of"))
    nodes = cut(nodes.select("n", "k1", "k2", F.col("of.i").alias("name"), F.col("of.x").alias("text_hash"), F.monotonically_increasing_id().alias("rep")), "nodes")
    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << 48) - 1))

    # shingles shared among the first ones
    total = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions(docs), math.ceil(total * ((DEN - NUM) / DEN + 1 / SLACK) * 12 / BUCKET_BYTES))
    frequent = frequent_shingles(rows)
    shared = (rows.mapInArrow(_spread(frequent, buckets), "bucket long, tokens binary, nodes binary")
              .groupBy("bucket").applyInArrow(_met, "token long, node long"))
    shared = cut(shared, "shared-shingles")
    counts = shared.groupBy(F.col("node").alias("low")).agg(F.count(F.lit(1)).alias("c"))
    near = nodes.join(counts, low("k1") == F.col("low")).filter(F.col("c") >= needed("n")).select("n", "k1", "k2", "name", "text_hash", "rep")
    near = cut(near, "near-nodes")
    sets = (_marked(rows, near).join(near, F.col("i").eqNullSafe(F.col("name")) & (F.col("x") == F.col("text_hash"))).select("rep", "n", "k1", "k2", "text")
            .mapInArrow(_described_sets, "rep long, n long, set binary, least array<long>"))
    sets = cut(sets, "near-sets")
    if not sets.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():  # rows that repeat id and text
        sets = cut(sets.dropDuplicates(["rep"]), "near-sets-once")

    # first components: comparison with ``LEADS`` nodes of each minimum hash, and of each two of
    # them, whose nodes are closer to one another; hashes pick them, so that a family has many
    two = [F.xxhash64(F.get("least", i), F.get("least", j)) for i in range(len(_SEEDS)) for j in range(i)]
    keys = sets.select("rep", "n", F.posexplode(F.concat("least", F.array(*two))).alias("k", "m"))
    leads = [F.min(F.struct(F.xxhash64("rep", "k", F.lit(t)), "rep", "n")).alias(f"l{t}") for t in range(LEADS)]
    lead = keys.groupBy("k", "m").agg(F.count(F.lit(1)).alias("c"), *leads).filter("c > 1")
    lead = lead.select("k", "m", F.posexplode(F.array_distinct(F.array(*[f"l{t}" for t in range(LEADS)]))).alias("t", "lead"))
    pairs = keys.join(lead, ["k", "m"]).select(F.col("rep").alias("x"), F.col("lead.rep").alias("y"), "n", F.col("lead.n").alias("ln"),
                                                ((F.col("k") < len(_SEEDS)) & (F.col("t") == 0)).alias("early"))
    pairs = pairs.filter((F.col("x") != F.col("y")) & (DEN * F.least("n", "ln") >= NUM * F.greatest("n", "ln")))
    pairs = pairs.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.max("early").alias("early"))
    pairs = cut(pairs, "pairs")
    a, b = sets.select(F.col("rep").alias("x"), F.col("set").alias("sx")), sets.select(F.col("rep").alias("y"), F.col("set").alias("sy"))
    stars = comps = None
    for early in (True, False):  # what the first round joins isn't compared again
        some = pairs.filter(F.col("early") == early)
        if comps is not None:
            of = [comps.select(F.col("u").alias(c), F.col("comp").alias(f"c{c}")) for c in "xy"]
            some = some.join(of[0], "x", "left").join(of[1], "y", "left").filter(F.coalesce("cx", "x") != F.coalesce("cy", "y"))
        found = cut(some.select("x", "y").join(a, "x").join(b, "y").select("x", "y", "sx", "sy").mapInArrow(_verified, "x long, y long"), "star-links")
        stars = found if stars is None else stars.unionByName(found)
        comps = components(stars)

    # token-group matrix over groups of similar nodes
    comp = F.coalesce(F.col("comp"), F.col("rep"))
    grouped = sets.select("rep", "n", F.col("least")[0].alias("m")).distinct().join(comps, F.col("rep") == F.col("u"), "left").select("rep", "n", "m", comp.alias("comp"))
    # components of near copies come first, whole
    order = grouped.join(grouped.groupBy("comp").agg(F.count(F.lit(1)).alias("c")), "comp")
    placed = dense_sorted_index(order, (F.col("c") == 1), F.when(F.col("c") > 1, F.col("comp")), F.col("m"), F.col("rep"), name="groups")
    placed = cut(placed.select("rep", "n", "comp", F.floor(F.col("rank") / GROUP).alias("g")), "placed")
    ids = near.select("rep", low("k1").alias("node"))
    tokens = shared.join(ids, "node").join(placed, "rep").select("token", "rep", "n", "comp", "g")
    tokens = cut(tokens, "tokens")
    open_ = tokens.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1").select("token")
    tokens = cut(tokens.join(open_, "token"), "open-tokens")
    matrix = tokens.groupBy("token", "g").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    asks = tokens.select("token", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), F.col("g").alias("gx"))
    asks = asks.join(matrix, "token").filter(F.col("g") <= F.col("gx"))  # of two nodes one asks
    asks = asks.filter(((F.col("c0") != F.col("cx")) | (F.col("c1") != F.col("cx"))) & (DEN * F.col("nx") >= NUM * F.col("n0")) & (DEN * F.col("n1") >= NUM * F.col("nx")))
    asks = asks.groupBy("x", "g").agg(F.first("cx").alias("comp"), F.first("nx").alias("nx"), F.count(F.lit(1)).alias("c"), F.min("n0").alias("n0"), F.max("n1").alias("n1"))
    asks = asks.filter(F.col("c") >= F.greatest(needed("nx"), needed_between("nx", "n0", "n1"))).select("x", "g", "comp", "nx")

    # groups in blocks: a query's set goes once to a block, with the numbers of the groups it asks
    sizes = placed.groupBy("g").agg(F.sum("n").alias("size")).withColumn("b", F.floor(F.col("g") / BLOCK))
    before = F.sum("size").over(Window.partitionBy("b").orderBy("g")) - F.col("size")  # over BLOCK rows
    blocks = cut(sizes.select("g", "b", F.floor(before / SHINGLES).alias("part")), "blocks")
    asks = asks.join(blocks, "g").groupBy("x", "b", "part").agg(F.first("comp").alias("comp"), F.first("nx").alias("nx"), F.collect_list("g").alias("asked"))
    asks = cut(asks, "queries")
    shares = asks.groupBy("b", "part").agg(F.ceil(F.sum("nx") / QUERY_SHINGLES).alias("shares"))
    asks = asks.join(shares, ["b", "part"]).select("b", "part", F.pmod(F.xxhash64("x"), F.col("shares")).alias("p"), "x", "comp", "asked")
    asking = asks.join(sets.select(F.col("rep").alias("x"), F.col("set").alias("set")), "x")
    wanted = asks.select("b", "part", "p", F.explode("asked").alias("g")).distinct()
    members = (placed.join(wanted, "g").join(sets.select(F.col("rep").alias("s"), F.col("set").alias("own")), F.col("rep") == F.col("s"))
               .select(*[F.col(c).alias(c) for c in ("b", "part", "p", "g", "rep", "comp", "own")]))
    opened = asking.groupBy("b", "part", "p").cogroup(members.groupBy("b", "part", "p")).applyInArrow(_opened, "x long, y long")
    whole = components(stars.unionByName(cut(opened, "opened-links")))

    classes = cut(nodes.join(whole, F.col("rep") == F.col("u"), "left").select("n", "k1", "k2", "name", F.coalesce("comp", "rep").alias("component")), "classes")
    names = classes.groupBy("component").agg(F.min("name").alias("component_id"))
    classes = classes.join(names, "component").select("n", "k1", "k2", "component", "component_id")
    linked = every.filter("n > 0").join(classes, ["n", "k1", "k2"]).select("i", "x", F.col("n").alias("n_shingles"), "component", "component_id")
    empty = every.filter("n = 0").select("i", "x", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("i").alias("component_id"))
    return linked.unionByName(empty)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: of each component the smallest id, and empty texts."""
    found = near_classes(docs, id_col, text_col).filter("n_shingles > 0")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("i").isNull().alias("no"), "i", "x")).alias("b"))
    best = cut(best.select(F.col("b.i").alias("best"), F.col("b.x").alias("x")), "near-winners")
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    mine = as_rows(docs).select("row", F.col("row")[id_col].alias("i"), F.xxhash64(text).alias("h"), (~text.rlike(r"[^\x20\x09-\x0D]")).alias("empty"))
    hit = mine.filter(~F.col("empty")).join(best, F.col("i").eqNullSafe(F.col("best")) & (F.col("h") == F.col("x")))
    hit = hit.withColumn("nth", F.row_number().over(Window.partitionBy("i", "h").orderBy(F.lit(1)))).filter("nth = 1")
    return hit.select("row").unionByName(mine.filter("empty").select("row")).select("row.*")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_classes(table(spark, sf_dir, "documents"))
    return got.select(F.col("i").alias("doc_id"), "n_shingles", "component_id")
