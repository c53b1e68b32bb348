"""Toxicity, collocations and token links against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare, views
from lakeloom.llm import collocations, token_links, toxicity
from lakeloom.llm.queries import QUERIES, token_file
from tests.conftest import rows
from tests.llm.conftest import SCHEMA

SMALL = "/root/testdata/sf0.001"


# Toxicity

def plain_coordinates(word):
    marked = f"\x02{word}\x03"
    found = Counter()
    for i in range(len(marked)):
        for j in range(i + 1, len(marked)):
            for k in range(j + 1, min(len(marked), i + toxicity.SPAN + 1)):
                found[marked[i], marked[j], marked[k]] += toxicity.DECAY ** (k - i + 1)
    return found


def test_kernel_equals_brute_force():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcéж") for _ in range(rng.randrange(1, 12))) for _ in range(60)] + ["idiot", "i.d.i.o.t", "aaaa"]
    marks = words[::3]
    plain = [plain_coordinates(w) for w in words]
    size = [sum(v * v for v in p.values()) ** 0.5 for p in plain]
    expected = [[(sum(v * plain[3 * j].get(c, 0) for c, v in p.items()) / size[i] / size[3 * j]) ** 3
                 for j in range(len(marks))] for i, p in enumerate(plain)]
    assert np.allclose(toxicity.Landmarks(marks).kernel(words), expected, atol=1e-5)


def test_gaps_and_inserted_letters_are_near():
    near = toxicity.Landmarks(["worthless"]).kernel(["worthless", "wor.th.less", "worxthless", "worthles", "without", "table"])[:, 0]
    assert near[0] > 0.999 and near[1:4].min() > 5 * near[4:].max()


def test_sentences_keep_all_words():
    words, starts = toxicity.sentences("You i d i o t here. Then! " + "w " * 60)
    assert "idiot" in words and [words[i] for i in starts[:3]] == ["you", "then!", "w"]
    assert np.diff(np.append(starts, len(words))).max() <= toxicity.SENTENCE_WORDS
    assert toxicity.sentences(None)[0] == [] and toxicity.sentences(" \n")[0] == []
    whole = " ".join(f"x{i}" for i in range(10_000))
    assert toxicity.sentences(whole)[0] == whole.split()


INSULTS = ["flobnagger", "grindlewort", "snarkpuddle", "drubbish"]


def labelled(seed, count):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("aeioustrnlm") for _ in range(rng.randrange(2, 9))) for _ in range(120)]
    out = []
    for i in range(count):
        words = [rng.choice(clean) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(5, 80))]
        toxic = i % 3 == 0
        if toxic:
            word = rng.choice(INSULTS)
            at = rng.randrange(1, len(word))
            words[rng.randrange(len(words))] = rng.choice([word, word, word[:at] + rng.choice("*x.-") + word[at:]])
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxic_documents_are_found(spark, odd_docs, no_docs):
    data = labelled(5, 900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(1, 1), (None, 1), (7, None)], "doc_id bigint, toxic int")
    held_out = F.col("doc_id") % 5 == 0
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels, ~held_out), held_out).collect()}
    own = [(y, found[i]) for i, _, y in data if i % 5 == 0]
    assert all(r.held_out for _, r in own) and np.mean([r.predicted == y for y, r in own]) > 0.9
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found.values())
    machine = toxicity.train(docs, labels, ~held_out)
    odd = toxicity.score(odd_docs, machine, held_out).collect()
    assert len(odd) == odd_docs.count() and len({r.score for r in odd if r.doc_id in (1, 2)}) == 1
    assert len({r.score for r in odd if r.doc_id in (3, 4, 5)}) == 1 and not any(r.held_out for r in odd if r.doc_id is None)
    assert toxicity.score(no_docs, machine, held_out).count() == 0
    # Without labels, or with one alone, the score is a constant.
    none = toxicity.train(docs, labels.limit(0), ~held_out)
    assert {r.score for r in toxicity.score(odd_docs, none, held_out).collect()} == {0.5}
    ones = toxicity.train(docs, labels.filter("toxic = 1"), ~held_out)
    assert min(r.score for r in toxicity.score(odd_docs, ones, held_out).collect()) > 0.99


def test_labels_are_learnt_without_the_held_out():
    one = toxicity.fit([(y, [t]) for i, t, y in labelled(6, 120)])
    two = toxicity.fit([(y, [t]) for i, t, y in reversed(labelled(6, 120))])
    scores = [toxicity.Scorer(m)(["some flobnagger here"])[0] for m in (one, two)]
    assert abs(scores[0] - scores[1]) < 0.05 and min(scores) > 0.5


def test_a_full_cache_changes_no_score(monkeypatch):
    machine = toxicity.fit([(y, [t]) for _, t, y in labelled(7, 90)])
    texts = [t for _, t, _ in labelled(8, 40)]
    plain = toxicity.Scorer(machine)(texts)
    monkeypatch.setattr(toxicity, "CACHE", 5000)
    scorer = toxicity.Scorer(machine)
    assert np.allclose([scorer([t])[0] for t in texts], plain, atol=1e-6)


# Collocations

def plain_pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in ".,;:!?\n\x0b\x0c\r":
        lower = lower.replace(c, "\n")
    return [[w for w in piece.replace("\t", " ").split(" ") if w] for piece in lower.split("\n")]


def plain_mine(docs, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for words in plain_pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    held = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = {}
    for (lang, words), a in held.items():
        longer = [b for (other, more), b in held.items() if other == lang and len(more) > len(words)
                  and any(more[i:i + len(words)] == words for i in range(len(more) - len(words) + 1))]
        if any(100 * b >= 100 * a for b in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]], n[lang]))
    return sorted(((lang, rank, p.decode(), -a, l, r, total, -score) for lang, some in out.items()
                   for rank, (score, a, p, l, r, total) in enumerate(sorted(some)[:top], 1)), key=repr)


def texts(seed, count=60, vocabulary="a b c dé E été 词"):
    rng = random.Random(seed)
    words = vocabulary.split()
    ends = [" "] * 12 + [".", ", ", "\n", "\t", "  ", "!?", "\x0b", " ; "]
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(40))))
            for _ in range(count)]


@pytest.mark.parametrize("seed,block", [(1, 1 << 18), (2, 7)])
def test_collocations_equal_brute_force(spark, seed, block):
    data = texts(seed) + [(None, None), ("en", ""), ("en", "...")] + [("fr", "one two three four five six")] * 4
    docs = spark.createDataFrame(data, "lang string, text string").repartition(3)
    found = collocations.mine(docs, least=3, longest=5, top=25, bits=12, block=block)
    expected = plain_mine(data, 3, 5, 25)
    assert rows(found, "lang", "rank", "phrase", "a", "l", "r", "n", "score") == expected and len(expected) > 50


def test_collocations_with_few_buckets(spark):
    """Full buckets let more candidates through, and none is lost."""
    data = texts(3, 30)
    docs = spark.createDataFrame(data, "lang string, text string")
    assert rows(collocations.mine(docs, least=4, longest=4, top=9, bits=5)) == plain_mine(data, 4, 4, 9)


def test_collocations_of_odd_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        data = [(r.lang, r.text) for r in docs.collect()]
        assert rows(collocations.mine(docs, least=2, longest=3, top=50, bits=10)) == plain_mine(data, 2, 3, 50)


def test_few_tasks_name_a_candidate(spark):
    """A pass leaves out what those before it have named, so the rows that tasks hand on follow the candidates, not tasks times candidates."""
    data = [("en", f"{i} one two three four {i}") for i in range(600)]
    docs = spark.createDataFrame(data, "lang string, text string").repartition(40)
    levels = [np.full(1 << 7, 255, np.uint8)] * 2
    rare = collocations.named(docs, levels, 10, np.zeros(0, np.uint64)).collect()
    keys = np.unique(np.array([row.key for row in rare], np.int64).view(np.uint64))
    assert len(rare) == len(keys) == 604 + 3 + 600 * 2
    assert collocations.named(docs, levels, 10, keys).count() == 0
    assert {row.k for row in collocations.named(docs, levels, 10, keys[::2]).collect()} == {1, 2}
    for wider in (2, 1000):
        found = collocations.candidates(docs, levels, 10, least=50, wider=wider)
        assert sorted(found.collect()) == sorted((row.lang, row.phrase, row.k) for row in rare)


def test_phrases_beyond_those_known_are_named(spark, monkeypatch):
    monkeypatch.setattr(collocations, "NAMED_PHRASES", 5)
    data = texts(4)
    docs = spark.createDataFrame(data, "lang string, text string").repartition(3)
    assert rows(collocations.mine(docs, least=3, longest=4, top=25, bits=12)) == plain_mine(data, 3, 4, 25)


def test_packed_counts_come_back():
    rng = np.random.default_rng(5)
    number = np.unique(np.append(rng.integers(0, 5 * collocations.PART, 9000), [0, collocations.PART - 1, collocations.PART]))
    n = rng.integers(1, 1 << 32, len(number))
    packed = collocations.packed_counts(number, n)
    back = [(part, *collocations.unpacked_counts(held)) for part, held in zip(*(column.to_pylist() for column in packed.columns))]
    assert np.array_equal(np.concatenate([part * collocations.PART + low for part, low, _ in back]), number)
    assert np.array_equal(np.concatenate([own for *_, own in back]), n)


def test_positions_are_looked_up_in_the_block_of_their_words_only(spark):
    """More blocks of candidates do not mean more lookups: a position has one block for its word and one for all longer phrases."""
    phrases = [("en", " ".join(p), len(p)) for k in (1, 2, 3) for p in itertools.product("abcd", repeat=k)]
    table = collocations.dealt(spark.createDataFrame(phrases, "lang string, phrase string, k int").repartition(3), 5).collect()
    blocks = {row.phrase: row.block for row in table}
    assert len(table) == len(phrases) and len(set(blocks.values())) == 5
    text = "a b d c a a d b".split()
    words = collocations.Words().hashes("en", [[word.encode() for word in text]])
    one, more = collocations.routes(words, 5)
    assert one.tolist() == [blocks[word] for word in text] + [-1]
    assert more.tolist() == [blocks[f"{a} {b}"] for a, b in zip(text, text[1:])] + [-1, -1]
    assert all(blocks[p] == blocks[" ".join(p.split()[:2])] for p in blocks if " " in p)
    for number in range(5):
        own = sorted(row.phrase for row in table if row.block == number)
        trie = collocations.Trie.of([collocations.Words().hashes("en", [p.encode().split()])[:-1].tolist() for p in own])
        found = (trie.counts(words, len(own), 1, np.flatnonzero(one == number))
                 + trie.counts(words, len(own), 3, np.flatnonzero(more == number), least=2))
        assert found.tolist() == [sum(text[i:i + len(p.split())] == p.split() for i in range(len(text))) for p in own]


def test_trie_counts_all_positions():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 9, 4000).astype(np.uint64)
    phrases = sorted({tuple(int(x) for x in rng.integers(1, 9, rng.integers(1, 5))) for _ in range(300)})
    trie = collocations.Trie.of([list(p) for p in phrases])
    plain = [sum(tuple(words[i:i + len(p)].tolist()) == p for i in range(len(words))) for p in phrases]
    assert trie.counts(words, len(phrases), 4).tolist() == plain
    many = sorted({(int(a), int(b)) for a, b in rng.integers(1, 3000, (20_000, 2))})
    trie = collocations.Trie.of([list(p) for p in many])
    text = rng.integers(0, 3000, 50_000).astype(np.uint64)
    pairs = Counter(zip(text.tolist(), text[1:].tolist()))
    assert trie.counts(text, len(many), 2).tolist() == [pairs[p] for p in many]


# Token links

def plain_links(data):
    a, b = token_links.ByteLevel(token_file("byte_bpe_50k.json")), token_links.Pieces(token_file("piece_bpe_32k.model"))
    bytes_a, bytes_b = a.entries(token_file("byte_bpe_50k.json")), b.entries(token_file("piece_bpe_32k.model"))
    held, counts = [], Counter()
    for doc_id, text in data:
        whole, ids = f" {text}".encode(), None
        if text:
            ids = a([text])[0], b([text])[0]
            if any(b"".join(t[i] for i in own) != whole for t, own in zip((bytes_a, bytes_b), ids)):
                ids = None
        if ids is None:
            held.append((doc_id, 0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(t[i]) for i in own]).tolist() for t, own in zip((bytes_a, bytes_b), ids)]
        links = [(x, y) for x, at in zip(ids[0], ends[0]) for y, other in zip(ids[1], ends[1]) if at == other]
        groups, group, i, j = [], ([], []), 0, 0
        while i < len(ids[0]):
            group[0].append(ids[0][i])
            while j < len(ids[1]) and ends[1][j] <= ends[0][i]:
                group[1].append(ids[1][j])
                j += 1
            if ends[0][i] in ends[1]:
                groups.append("|".join(",".join(map(str, side)) for side in group))
                group = ([], [])
            i += 1
        counts.update(links)
        held.append((doc_id, len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (x, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted([(d, n_a, n_b, n, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest)
                   for d, n_a, n_b, n, links, digest in held], key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_token_links_equal_brute_force(spark):
    rng = random.Random(4)
    pool = ["the", "idiot", "été", "naïve", "词", "🙂", " ", "  ", "\n", "\t", "don't", "<|endoftext|>", "<s>", "<0x41>", "3.14", "▁", "a", "\x00",
            "\r\n", "ﬁ", "Ⅳ", "é"]
    data = [(i, "".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randrange(30)))) for i in range(120)]
    data += [(200, None), (201, ""), (None, "without an id"), (3, data[3][1]), (202, " leading"), (203, "word " * 3000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in data], "doc_id bigint, text string, n_a string").repartition(3)
    found = token_links.described(docs, token_file("byte_bpe_50k.json"), token_file("piece_bpe_32k.model"))
    assert rows(found, *COLUMNS) == plain_links(data)


def test_both_libraries_give_the_same_ids():
    from tokenizers import Tokenizer

    path = token_file("byte_bpe_50k.json")
    fast, slow = token_links.ByteLevel(path), Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    rng = random.Random(9)
    pool = [chr(c) for c in [*range(0x250), 0x85, 0xa0, 0x1680, 0x2000, 0x200b, 0x2028, 0x3000, 0xfeff, 0x1f642]] + ["<|endoftext|>", "'LL", " "]
    data = ["".join(rng.choice(pool) for _ in range(rng.randrange(50))) for _ in range(3000)]
    assert fast.encoding is not None
    assert [list(own) for own in fast(data)] == [e.ids for e in slow.encode_batch([f" {t}" for t in data], add_special_tokens=False)]


def test_all_links_are_among_the_linkable_pairs():
    aligner = token_links.Aligner(token_file("byte_bpe_50k.json"), token_file("piece_bpe_32k.model"))
    assert len(aligner.pairs) < 500_000
    a, b = aligner.bytes_a, aligner.bytes_b
    for pair in aligner.pairs[::5000].tolist():
        x, y = a[pair >> 32], b[pair & 0xFFFFFFFF]
        assert x.endswith(y) or y.endswith(x)


def test_token_links_of_odd_documents(spark, odd_docs, no_docs):
    path = token_file("byte_bpe_50k.json"), token_file("piece_bpe_32k.model")
    data = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id != 8]
    assert rows(token_links.described(odd_docs.filter("doc_id is null or doc_id <> 8"), *path), *COLUMNS) == plain_links(data)
    assert token_links.described(no_docs, *path).count() == 0


@pytest.mark.parametrize("name", ["op11_toxicity", "op13_token_links"])
def test_query_covers_the_table(spark, name):
    found = QUERIES[name](spark, SMALL)
    assert found.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count() and set(SCHEMA)


def test_collocations_query_equals_sql(spark):
    count, problems = compare(spark, views("/root/testdata/sf0.01"), "op12_collocations", "/root/testdata/sf0.01")
    assert not problems and count > 50
