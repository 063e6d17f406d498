"""Corpus operators against brute force, on odd little tables."""

import random

import numpy as np
import pytest
from brute import contamination, exact, lines, lowered, near, suffixes, targets
from pyspark.sql import functions as F

from textmill.llm import decontamination, exact_dedup, license_scan, line_dedup, mixing, ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, i string, x int, d string, copies int, rank int"


def corpus(seed=3, n=90):
    """Texts with copies, near copies, shared passages and lines, empties, nulls and a long one."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ab", "ou", "Thé", "n", "ist", "re", "0", "ß"]) for _ in range(rng.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage, line = prose(60), prose(14)
    texts = [None, "", " ", " \t\n ", "one two", "one  two", "one two three four five", "ONE two three four", "a" * 300, "ab " * 200, "\n\n\n\n", prose(6000)]
    for k in range(n):
        t = prose(rng.choice([3, 8, 30, 120, 200]))
        if k % 3 == 0:
            t = f"{t}\n{line}\n{prose(5)}\n{passage}\n{t[:40]}"
        if k % 4 == 0 and k > 8:
            t = texts[-4] or ""
        if k % 5 == 0 and k > 8:
            w = (texts[-3] or "").split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if k % 7 == 0:
            t = f"{t}  \t{passage}\nsame line\nsecond same line\nthird same"
        texts.append(t)
    texts += ["\n".join(f"line {j % 7}" for j in range(40)), "same line\nsecond same line", prose(4)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(order[k] * 3 + 1, t) for k, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i is None or i % 5 == 0 else f"s{i % 4}", 0, "q", 1, "r", 2, 3) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def test_exact_classes(spark, rows):
    odd = [*rows, (rows[0][0], rows[0][1]), (None, "one two"), (None, "only without id"), (4, "one \n two")]
    got = exact_dedup.exact_classes(frame(spark, odd)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == exact(odd)
    kept = exact_dedup.exact_dedup(frame(spark, odd))
    assert kept.columns == frame(spark, odd).columns
    want = [(i, s) for i, _, _, k, s in exact(odd) if k]
    # a text that only rows without id have keeps one of them
    assert kept.count() == len({s for _, _, _, _, s in exact(odd)}) >= len(want)


def test_near_classes(docs, rows):
    got = {r["i"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_classes(docs).collect()}
    assert got == near(rows)
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    want = {i for i, (n, c) in near(rows).items() if n == 0 or c == i}
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(want)


def test_near_null_and_repeated_ids(spark):
    """Unrelated rows without id or with the same id all stay; their near copies are still found."""
    rng = random.Random(4)
    prose = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    texts = [prose() for _ in range(8)]
    alike = lambda t: f"{t} end"
    rows = [(None, texts[0]), (None, texts[1]), (None, alike(texts[1])), (7, texts[2]), (7, texts[3]), (7, alike(texts[3])),
            (9, texts[4]), (None, alike(texts[4])), (None, texts[5]), (5, texts[6]), (5, alike(texts[7])), (6, texts[7]), (None, texts[0]), (5, texts[6])]
    got = ngram_join.near_classes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    ends = {t: k for k, t in enumerate(texts)}
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.without_near_copies(frame(spark, rows)).select("doc_id", "text").collect()]
    assert sorted(ends[t.removesuffix(" end")] for _, t in kept) == list(range(8))  # one of each group of near copies
    assert {(9, texts[4]), (5, alike(texts[7]))} <= set(kept)  # the smallest id, which isn't null
    assert sorted((r["i"], r["component_id"]) for r in got if r["i"] is not None) == [(5, 5)] * 3 + [(6, 5)] + [(7, 7)] * 3 + [(9, 9)]
    assert len({r["component"] for r in got}) == 8


def test_near_groups_that_one_hash_does_not_join(spark):
    """Chains of near copies, whose ends are not similar, and pairs at the threshold."""
    rng = random.Random(8)
    base = [f"w{j}" for j in range(120)]
    rows, now = [], list(base)
    for k in range(60):
        now = list(now)
        now[rng.randrange(len(now))] = f"v{k}"
        rows.append((1000 - k, " ".join(now)))
    rows += [(2000 + k, " ".join(base[:100 + k] + [f"t{k}-{j}" for j in range(20 - k)])) for k in range(20)]
    got = {r["i"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_classes(frame(spark, rows)).collect()}
    assert got == near(rows)


def test_near_small_blocks(spark, monkeypatch):
    """Many groups, blocks and shares of queries, and a bitmap that is nearly full, give the same components."""
    for name, value in (("GROUP", 3), ("BLOCK", 2), ("SHINGLES", 150), ("QUERY_SHINGLES", 200), ("MARKS", 64), ("LEADS", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(12)
    base = [f"w{j}" for j in range(100)]
    rows = []
    for k in range(60):  # a family around the threshold
        now = list(base)
        for j in rng.sample(range(100), 3):
            now[j] = f"v{k}-{j}"
        rows.append((k + 1, " ".join(now)))
    rows += [(100 + k, " ".join(f"z{k}-{j}" for j in range(30))) for k in range(20)] + [(200, None), (201, " ")]
    got = {r["i"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_classes(frame(spark, rows)).collect()}
    assert got == near(rows)


def test_near_family_asks_few_groups(spark, monkeypatch):
    """Near copies that aren't similar enough to one another don't all ask the groups of all others."""
    asked, old = [], ngram_join.cut

    def cut(df, name):
        got = old(df, name)
        if name == "queries":
            asked.append(got.agg(F.sum(F.size("asked"))).first()[0] or 0)
        return got
    monkeypatch.setattr(ngram_join, "cut", cut)
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    rng = random.Random(15)
    base = [f"w{j}" for j in range(60)]
    rows = []
    for k in range(160):
        now = list(base)
        for j in rng.sample(range(60), 1 + k % 4):
            now[j] = f"v{k}-{j}"
        rows.append((k + 1, " ".join(now + [f"u{k}-{j}" for j in range(k % 5)])))
    got = {r["i"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_classes(frame(spark, rows)).collect()}
    assert got == near(rows)
    assert asked[0] < 1200  # of 160 nodes and 40 groups


def test_first_shingles_meet_by_size(spark):
    rng = np.random.default_rng(2)
    found = []
    for _ in range(400):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.85, 0.95, 1])], rng.integers(0, 1 << 63, int(rng.integers(0, n // 6 + 2)), dtype=np.uint64)]))
        if ngram_join._linked(a, b):
            shared = set(ngram_join.first_shingles(a, a[:0]).tolist()) & set(ngram_join.first_shingles(b, a[:0]).tolist())
            found += [(x, max(0, y - int(rng.integers(0, 9))), y + int(rng.integers(0, 9)), len(shared)) for x, y in ((len(a), len(b)), (len(b), len(a)))]
    least = spark.createDataFrame(found, "n long, lo long, hi long, c long").withColumn("least", ngram_join.needed_between("n", "lo", "hi"))
    assert len(found) > 200 and least.filter("c < least").count() == 0
    # of sets of one size all but a ninth is shared
    assert spark.sql("select 146L n, 146L lo, 146L hi").select(ngram_join.needed_between("n", "lo", "hi")).first()[0] >= 20


def test_first_shingles_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, 3, dtype=np.uint64)]))
        frequent = np.sort(a[rng.random(len(a)) < 0.4])
        if ngram_join._linked(a, b):
            shared = set(ngram_join.first_shingles(a, frequent).tolist()) & set(ngram_join.first_shingles(b, frequent).tolist())
            assert len(shared) >= 1 + (max(len(a), len(b)) * 80 // 100) // ngram_join.SLACK


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    from brute import Sets
    want = Sets(range(300))
    for a, b in pairs:
        want.join(a, b)
    got = {r["u"]: r["comp"] for r in ngram_join.components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {k: want.find(k) for k in range(300) if want.find(k) != k}


def test_contamination(spark, docs, rows, monkeypatch):
    passages = [t for _, t in rows if t and len(t) > 400]
    items = [(1, passages[0][20:260]), (2, passages[1]), (10, "one two"), (2, "ab ab ab"), (3, None), (None, "one two three"), (4, ""), (5, " ".join(["absent"] * 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(rows, items)
    assert sum(w[4] for w in want.values()) > 3

    def got():
        f = decontamination.found(docs, bench).select(
            "doc_id", "__found.n_words", "__found.n_hit", F.size("__found.items"), F.sha2(F.array_join(F.array_sort("__found.items"), ","), 256), decontamination.contaminated())
        return {r[0]: tuple(r)[1:] for r in f.collect()}
    assert got() == want
    spans = decontamination.found(docs, bench).select("text", "__found.*").filter("n_hit > 0").collect()
    for r in spans:
        body = r["text"].encode()
        assert sum(len(decontamination.Words([body[s["first_byte"]:s["end_byte"]]], decontamination.ALNUM).hash) for s in r["spans"]) == r["n_hit"]
    monkeypatch.setattr(decontamination.blocks, "__defaults__", ("item_id", "text", 300))  # many blocks, same result
    assert len(list(decontamination.blocks(bench))) > 2
    assert got() == want
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, w in want.items() if not w[4]}


def test_line_runs(docs, rows):
    for least in (2, 3, 1):
        want = lines(rows, least)
        got = line_dedup.repeated_runs(docs, min_lines=least).collect()
        assert {r["i"]: sorted(k for a, b in r["runs"] for k in range(a, b)) for r in got} == want
        assert all(r["n_removed"] == len(want[r["i"]]) for r in got)
        assert all(b < c for r in got for (_, b), (c, _) in zip(r["runs"], r["runs"][1:], strict=False))
    texts = dict(rows)
    for r in line_dedup.without_repeats(docs).collect():
        parts = (texts[r["doc_id"]] or "").split("\n")
        left = "\n".join(p for k, p in enumerate(parts) if k not in set(want[r["doc_id"]]))
        assert (r["text"] or "") == left


def test_line_runs_of_one_line(spark):
    """A line between other neighbours and a one-line document go; gaps between paragraphs stay."""
    rows = [(1, "a\n\nnotice\n\n\nb"), (2, "notice"), (3, "c\n\nd\nnotice\ne\n\n\nf"), (4, "x\n \nnotice\n\n\nz"), (5, "\n\n"), (6, " ")]
    got = {r["i"]: [tuple(x) for x in r["runs"]] for r in line_dedup.repeated_runs(frame(spark, rows)).collect()}
    assert got == {1: [], 2: [(0, 1)], 3: [(3, 4)], 4: [(2, 4)], 5: [], 6: []}
    assert {i: [k for a, b in v for k in range(a, b)] for i, v in got.items()} == lines(rows)


def test_long_line_runs(spark):
    """Copies of many different lines have long common prefixes after few rounds."""
    body = [f"different {k}" for k in range(40)]
    rows = [(1, "\n".join(body)), (2, "\n".join(body)), (3, "\n".join(["own", *body[5:25], "end"])), (4, "\n".join(body[:7])), (5, "\n".join(body[-3:]))]
    for least in (1, 7, 20, 21):
        got = {r["i"]: sorted(k for a, b in r["runs"] for k in range(a, b)) for r in line_dedup.repeated_runs(frame(spark, rows), min_lines=least).collect()}
        assert got == lines(rows, least)


def test_line_runs_null_and_repeated_ids(spark):
    """A null id comes first; rows that repeat id and text are copies of the first."""
    rows = [(4, "p\nq"), (4, "p\nq"), (None, "q\nr"), (4, "r\ns"), (2, "s\nt")]
    left = [(r["doc_id"], r["text"]) for r in line_dedup.without_repeats(frame(spark, rows)).collect()]
    assert sorted(left, key=repr) == sorted([(None, "q\nr"), (2, "s\nt"), (4, "p"), (4, ""), (4, "")], key=repr)


def test_clashing_names(spark, rows):
    """Stages keep other columns whatever their names, names of the operators' own included."""
    names = ["__d", "__n", "__h", "__found", "__i", "row", "n", "k", "h", "s", "found", "runs", "digest", "copy_no", "a.b", "times", "best", "empty"]
    docs = frame(spark, rows).select("doc_id", "text", "source", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in names])
    bench = spark.createDataFrame([(1, rows[15][1])], "item_id long, text string")
    stages = [exact_dedup.exact_dedup(docs), ngram_join.without_near_copies(docs), line_dedup.without_repeats(docs), decontamination.decontaminated(docs, bench)]
    for kept in stages:
        assert kept.columns == docs.columns
        got = kept.collect()
        assert got and all(r[c] == f"{c}-{r['doc_id']}" for r in got for c in names)
    out = mixing.mixed(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    assert all(r[c] == f"{c}-{r['doc_id']}" for r in out.collect() for c in names if c != "copy_no")


def test_common_prefixes(spark):
    """Suffix order and common prefixes of two short sequences, by comparing lists."""
    rows = [(1, "a\nb\na\nb\na"), (2, "b\na\nb\nc\nz"), (3, "q\na\nb\na\nb\na")]
    table = line_dedup.line_table(frame(spark, rows))
    levels = line_dedup.suffix_ranks(table)
    got = line_dedup.common_prefixes(levels).orderBy("rank").collect()
    texts = {i: t.split("\n") for i, t in rows}
    assert len(got) == sum(w in "ab" for t in texts.values() for w in t)
    for before, r in zip(got, got[1:], strict=False):
        a, b = texts[before["i"]][before["pos"]:], texts[r["i"]][r["pos"]:]
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        assert r["lcp"] == same


def test_mixing(spark, docs, rows):
    got = mixing.decisions(docs, chunk_rows=7).collect()
    again = mixing.decisions(docs.repartition(2), chunk_rows=7).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(got) == len(rows)
    sizes, taken, largest = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    out = mixing.mixed(docs, chunk_rows=7)
    assert out.columns == [*docs.columns, "copy_no"]
    assert out.count() == sum(r["copies"] for r in got)


def test_mixing_repeated_rows(spark):
    rows = [(1, "a b c")] * 5 + [(None, "d e")] * 3 + [(2, None)] * 2 + [(k, "x y z w") for k in range(10, 30)]
    got = mixing.decisions(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert mixing.mixed(frame(spark, rows)).count() == sum(r["copies"] for r in got)


def test_pivotal_keeps_words_and_chances():
    size = np.array([50, 40, 30, 7, 3, 1, 0, 9], float)
    total = np.zeros(len(size))
    for seed in range(3000):
        part = mixing._pivotal(size, np.full(len(size), 0.3), np.random.default_rng(seed), False)
        left = (part > 0) & (part < 1)
        assert left.sum() <= 1
        assert (part * size).sum() == pytest.approx(0.3 * size.sum())
        total += mixing._pivotal(size, part, np.random.default_rng(seed + 10**6), True)
    assert np.allclose(total / 3000, 0.3, atol=0.04)


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["mit-text"].split()
    broken = " ".join([*mit[:12], "oops", *mit[12:]])  # a word inside costs four shingles of 22
    torn = " ".join(w if k % 4 else "x" for k, w in enumerate(mit))
    rows = [(1, None), (2, ""), (3, "four words are few"), (4, f"{'word ' * 3000}{' '.join(mit)} {'tail ' * 50}"), (5, broken), (6, torn), (7, "released UNDER the\n mit LICENSE!"),
            (8, "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0."), (8, "Released under the MIT License.")]
    got = sorted((r["doc_id"], [m["license"] for m in r["matches"]]) for r in license_scan.scan(frame(spark, rows)).collect())
    assert got == [(1, []), (2, []), (3, []), (4, ["mit-text"]), (5, ["mit-text"]), (6, []), (7, ["mit"]), (8, ["cc-by-nc-4.0", "gpl-3.0"]), (8, ["mit"])]
    short = " ".join([*mit[:-2], "end"])
    assert [m["license"] for m in license_scan.scan(frame(spark, [(1, short)])).first()["matches"]] == ["mit-text"]
    with pytest.raises(ValueError):
        license_scan.scan(frame(spark, rows), templates={"short": "all rights reserved"})


def test_license_families(spark):
    """Notices of common families, as they stand in files, are found by the registered templates."""
    gnu = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
    rows = [(1, f"# This library is free software; {gnu.format('Lesser General Public License')}; either version 2.1 of the License, or (at your option) any later version."),
            (2, f"This program is free software: {gnu.format('Affero General Public License')}, either version 3 of the License, or (at your option) any later version."),
            (3, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy"),
            (4, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
                "copyright notice and this permission notice appear in all copies."),
            (5, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
            (6, "This is free and unencumbered software released into the public domain.\n\nAnyone is free"), (7, "No license is named in these plain words at all.")]
    want = {1: "lgpl-2.1", 2: "agpl-3.0", 3: "mpl-2.0", 4: "isc", 5: "cc-by-sa-4.0", 6: "unlicense"}
    for r in license_scan.scan(frame(spark, rows)).collect():
        best = max(r["matches"], key=lambda m: m["contained"], default=None)
        assert (best and best["license"]) == want.get(r["doc_id"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_classes(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert ngram_join.near_classes(none).count() == 0
    assert line_dedup.repeated_runs(none).count() == 0
    assert mixing.decisions(none).count() == 0
    assert mixing.mixed(none).count() == 0
    assert license_scan.scan(none).count() == 0
    assert decontamination.decontaminated(none, bench).count() == 0


def test_empty_benchmark(spark, docs, rows):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminated(docs, bench).count() == len(rows)


def test_lowered_only_ascii():
    assert lowered("ÀB") == "Àb"
