from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare, views
from lakeloom.llm import decontaminate, licences, line_dedup, near_dups
from lakeloom.llm.decontaminate import align
from lakeloom.llm.queries import ORACLE, QUERIES
from lakeloom.llm.shared import components, words_of
from tests.conftest import rows
from tests.llm.conftest import A, B

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    count, problems = compare(spark, views(SMALL), name, SMALL)
    assert not problems and count > 0


def shingles(text):
    words = words_of(text)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(texts, threshold=0.8):
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    sets = {i: shingles(t) for i, t in texts.items()}
    for a, b in combinations(sorted(texts), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def edited(seed, n, base=200):
    """Copies of one text with words replaced at random: some within the similarity of others, some of none."""
    rng = np.random.default_rng(seed)
    first = [f"w{i}" for i in range(base)]
    texts = {}
    for i in range(n):
        words = list(first)
        for at in rng.integers(0, base, rng.integers(0, 9)):
            words[at] = f"x{rng.integers(0, 99999)}"
        texts[i] = " ".join(words)
    return texts


def test_classes_of_a_large_group(spark):
    texts = edited(1, 90)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert dict(rows(near_dups.classes(docs))) == plain_classes(texts)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Blocks of large buckets give the classes that listing all pairs gives."""
    texts = edited(2, 70)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    monkeypatch.setattr(near_dups, "SMALL", 1)
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    assert dict(rows(near_dups.classes(docs))) == plain_classes(texts)


def test_first_shared_band_is_that_of_the_whole_rows(spark):
    """A band that agrees in five rows and the low byte of the sixth is not shared; the pair is compared where it is."""
    nodes, shared, almost = [1, 2], 7, 3
    signed = np.arange(2 * near_dups.SLOTS, dtype=np.uint64).reshape(2, -1) * np.uint64(1 << 20) + np.uint64([[1], [2]])
    for band in (shared, almost):
        signed[1, band * near_dups.ROWS:(band + 1) * near_dups.ROWS] = signed[0, band * near_dups.ROWS:(band + 1) * near_dups.ROWS]
    signed[1, (almost + 1) * near_dups.ROWS - 1] += np.uint64(256)
    keys = [near_dups.bands_of(row) for row in signed]
    assert [a == b for a, b in zip(*keys)] == [band == shared for band in range(near_dups.BANDS)]
    cells = np.arange(50, dtype="<u8").view("u1").reshape(-1, 8)[:, :5].tobytes()
    held = spark.createDataFrame([(n, bytearray(cells)) for n in nodes], "node bigint, cells binary")
    # The low bytes stand beside the bands, as signatures that hold no more.
    facts = spark.createDataFrame([(n, k, bytearray((row & np.uint64(255)).astype(np.uint8).tobytes()))
                                   for n, k, row in zip(nodes, keys, signed)], "node bigint, bands array<bigint>, signature binary")
    unlinked = spark.createDataFrame([(keys[0][shared], shared, n, n, near_dups.SMALL + 1) for n in nodes],
                                     "key bigint, band int, node bigint, component bigint, n bigint")
    assert rows(near_dups.across(unlinked, facts, held, 0.8)) == [(1, 2)]


def test_classes_of_odd_documents(odd_docs, no_docs):
    found = rows(near_dups.classes(odd_docs).filter("doc_id is not null"))
    assert dict(found) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 7, 10: 10, 11: 11}
    assert near_dups.classes(no_docs).count() == 0
    kept = near_dups.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7, 8, 10, 11]


def test_counted_shingles_weigh_more():
    words = np.array([1, 2, 3, 4, 5] * 4, np.uint64)
    assert len(near_dups.cells(words, "set")) == 5 and len(near_dups.cells(words, "count")) == 16


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    shared, a, b = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (800, 100, 100))
    agree = np.mean([near_dups.signature(np.concatenate([shared, a]), 1000) == near_dups.signature(
        np.concatenate([shared, b]), 1000)])
    assert abs(agree - 0.8) < 0.06


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 203), (203, 201)]
    found = dict(rows(components(spark.createDataFrame(path, "a bigint, b bigint"), "test")))
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 201: 200, 203: 200}


def plain_alignment(text, item):
    best = 0
    table = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if item[i - 1] == text[j - 1] else -1),
                              table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(5)
    for _ in range(200):
        text, item = rng.integers(0, 4, rng.integers(1, 14)), rng.integers(0, 4, rng.integers(1, 10))
        score, start, end = align(text, item)
        assert score == plain_alignment(text, item)
        assert plain_alignment(text[start:end], item) == score


def test_copies_of_benchmark_items(spark, odd_docs, no_docs):
    item = " ".join(f"q{i}" for i in range(40))
    swapped = item.replace("q7 ", "zz ").replace("q20 ", "").replace("q31 ", "q31 new ")
    docs = spark.createDataFrame([(1, f"{A} {item} {B}"), (2, f"{A} {swapped}"), (3, A), (4, None), (5, ""), (1, f"{A} {item} {B}"),
                                  (6, " ".join(item.split()[:12])), (7, "Short! one")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "..."), (5, "short one"), (1, item)],
                                  "item_id bigint, text string")
    found = defaultdict(set)
    for r in decontaminate.contaminated(docs, items).collect():
        found[r.doc_id].add((r.item_id, round(r.score, 2)))
    assert found[1] == {(1, 1.0)} and {i for i, _ in found[2]} == {1} and found[7] == {(5, 1.0)}
    assert set(found) == {1, 2, 7}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert decontaminate.contaminated(odd_docs, items).count() == 0


def test_copies_edited_in_every_stretch(spark):
    """Copies that keep three words in a row anywhere are found as the full table finds them, whatever else documents hold."""
    rng = np.random.default_rng(6)
    items = [[f"q{k}x{i}" for i in range(40)] for k in range(8)]
    docs = {}
    for k, item in enumerate(items):
        step = 4 + k % 4
        docs[k] = [f"n{d}" for d in range(30)] + [f"y{i}" if i % step == step // 2 else w for i, w in enumerate(item)]
    # An exact copy, parts of it, and a copy that is stretched by new words.
    docs[20] = items[0]
    docs |= {30 + i: items[1][i:i + 5] for i in range(36)}
    docs[70] = [w for i, own in enumerate(items[2]) for w in ([own] if i < 6 else [own, f"z{rng.integers(99)}"])]
    docs = {d: [str(w) for w in words] for d, words in docs.items()}
    expected = {(d, k): round(score / 80, 6) for d, words in docs.items() for k, item in enumerate(items)
                if (score := plain_alignment(words, item)) >= 40}
    found = decontaminate.contaminated(
        spark.createDataFrame([(d, " ".join(words)) for d, words in docs.items()], "doc_id bigint, text string"),
        spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id): round(r.score, 6) for r in found.collect()} == expected and len(expected) == 10


def one_edit(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    table[:, 0], table[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    return table[-1, -1] <= 1


def plain_lines(texts):
    first, out = {}, []
    order = [(d, i, words_of(line.replace("_", " "))) for d in sorted(texts) for i, line in enumerate(texts[d].split("\n"))]
    for d, i, words in order:
        if words:
            first.setdefault(tuple(words), (d, i))
    near = {w: min([p for v, p in first.items() if p < q and min(len(v), len(w)) >= 8 and one_edit(v, w)], default=q)
            for w, q in first.items()}
    for d, i, words in order:
        if words and near[tuple(words)] < (d, i):
            out.append((d, i, *near[tuple(words)]))
    return sorted(out)


def test_repeated_lines_equal_brute_force(spark, no_broadcast):
    rng = np.random.default_rng(4)
    base = [[f"a{rng.integers(0, 3)}" for _ in range(rng.integers(1, 14))] for _ in range(12)]
    texts = {}
    for d in range(40):
        lines = []
        for _ in range(4):
            words = list(base[rng.integers(0, len(base))])
            for _ in range(rng.integers(0, 3)):
                at = rng.integers(0, len(words))
                kind = rng.integers(0, 3)
                words = words[:at] + [["b"], [], ["b", words[at]]][kind] + words[at + 1:] or ["c"]
            lines.append(" ".join(words))
        texts[d] = "\n".join(lines)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = rows(line_dedup.repeated_lines(docs), "doc_id", "line_no", "kept_doc_id", "kept_line_no")
    assert sorted(found) == plain_lines(texts)


def test_lines_of_odd_documents(odd_docs, no_docs):
    found = rows(line_dedup.repeated_lines(odd_docs), "doc_id", "line_no", "kept_doc_id", "kept_line_no")
    assert sorted(found, key=repr) == sorted([(2, 0, 1, 0), (2, 0, 1, 0), (None, 0, 1, 0), (9, 0, 7, 0), (11, 0, 1, 0),
                                              (11, 1, 7, 0), (11, 2, 1, 0)], key=repr)
    kept = line_dedup.without_repeated_lines(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.filter("doc_id is not null").collect())) == [1, 3, 4, 5, 6, 7, 8, 10]
    assert line_dedup.repeated_lines(no_docs).count() == 0


def test_short_and_unspaced_lines_repeat(spark):
    text = f"haanth\n{A}\n他们在这里工作了很多年\nand ornd"
    docs = spark.createDataFrame([(1, text), (2, text), (3, f"And ornd!\n{B}\n---"), (4, "haanth"), (5, "haanth ornd"), (6, "---")],
                                 "doc_id bigint, text string")
    assert dict(rows(corpus_pipeline.lines(spark, docs, ""))) == {1: text, 3: f"{B}\n---", 5: "haanth ornd", 6: "---"}


U, V = "an unrelated text that nothing else has in common with", "another one which stands here all by itself today"


def test_rows_without_an_id_or_with_one_that_repeats_stay(spark):
    """Rows are told apart by id and text: no row goes because of another one's text."""
    data = [(1, A), (None, A), (None, U), (None, V), (2, A), (2, f"{U} {B}"), (None, f"{V}\n{A}"), (3, f"{B} {V} x"), (3, f"{B} {V} x")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in data],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    alone = [(1, A), (2, f"{U} {B}"), (3, f"{B} {V} x"), (None, U), (None, V)]
    key = lambda found: sorted(((r.doc_id, r.text) for r in found), key=repr)
    assert key(near_dups.one_of_each(docs).collect()) == sorted([*alone, (None, f"{V}\n{A}")], key=repr)
    left = line_dedup.without_repeated_lines(docs).collect()
    # Equal rows stand at one place, so neither drops the other; so do first lines of rows without an id.
    assert key(left) == sorted([*alone, (3, f"{B} {V} x"), (None, V)], key=repr)
    items = spark.createDataFrame([(1, A)], "item_id bigint, text string")
    assert key(decontaminate.clean(docs, items).collect()) == sorted([(2, f"{U} {B}"), *[(3, f"{B} {V} x")] * 2, (None, U), (None, V)],
                                                                     key=repr)


def test_the_copy_that_stays_of_equal_rows(spark):
    docs = spark.createDataFrame([(1, A, "en"), (1, A, "de"), (1, A, None)], "doc_id bigint, text string, lang string")
    assert rows(near_dups.one_of_each(docs)) == [(1, A, None)]


def test_sizes_of_halves_are_worked_out_once(spark):
    """Branches that repeat an expression work it out each time: sizes of ends are columns of a step of their own."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i\na\n\n" + "x " * 50)], "doc_id bigint, text string")
    lines = line_dedup.lines_of(docs, 1, 8)
    assert [r.halves and len(r.halves) for r in lines.orderBy("line_no").collect()] == [2, None, 2]
    plan = lines._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in plan.splitlines() if "substring_index" in line]
    assert steps and not any("LOG2" in line for line in steps)


def test_near_lines_without_an_id(spark):
    """Different lines at one place, as rows without an id have, are compared each by itself."""
    lines = [f"{A} {i}" if i % 2 else f"{B} {i}" for i in range(6)]
    docs = spark.createDataFrame([(None, line) for line in lines] + [(5, A), (6, "q " * 70_000)], "doc_id bigint, text string")
    found = rows(line_dedup.repeated_lines(docs), "doc_id", "line_no", "kept_doc_id", "kept_line_no")
    # Lines that are one word from doc 5 go; of the others all stand at the same place.
    assert found == [(None, 0, 5, 0)] * 3


def test_no_python_in_native_operators(spark):
    for name in ("op3_licence_scan", "op10_line_dedup"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow")


def test_licences(spark, odd_docs):
    mit = ". ".join(licences.SENTENCES[x] for x in ("permission-granted", "notice-included", "as-is"))
    docs = spark.createDataFrame([(1, f"Hello.\n{mit}.\nReleased under the MIT License."), (2, "Licensed under CC BY-NC 4.0."),
                                  (3, "All Rights Reserved!"), (4, None), (5, ""), (2, "Licensed under CC BY-NC 4.0.")],
                                 "doc_id bigint, text string")
    assert rows(licences.scan(docs)) == sorted([
        (1, "MIT", "permission-granted,notice-included,as-is,mit-release", ""), (2, "CC-BY-NC-4.0", "cc-by-nc-4-licensed", ""),
        (2, "CC-BY-NC-4.0", "cc-by-nc-4-licensed", ""), (3, "", "all-rights-reserved", "all-rights-reserved")], key=repr)
    assert licences.scan(odd_docs).count() == 0


WRAPPED = {
    "MIT": """MIT License
Copyright (c) 2020 X
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
}
WRAPPED["BSD-3-Clause"] = WRAPPED["BSD-2-Clause"] + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


def test_wrapped_licences(spark):
    texts = {f"{name}{mark!r}{end!r}": mark + text.replace("\n", end + mark) for name, text in WRAPPED.items()
             for mark in ("", "# ", " * ", "// ") for end in ("\n", "\r\n")}
    ids = dict(enumerate(texts))
    docs = spark.createDataFrame([(i, f"x y\n{texts[name]}\nz") for i, name in ids.items()], "doc_id bigint, text string")
    found = {ids[r.doc_id]: r.licences for r in licences.scan(docs).collect()}
    assert found == {name: name.split("'")[0] for name in texts}
