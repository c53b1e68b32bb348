import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from lakeloom.llm.packing import Bins, TextIds, first_fit_decreasing, pack, sequences
from lakeloom.llm.queries import token_file


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_file()).encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_are_those_of_whole_texts():
    texts = ["don't it's 12²3 ½ foo_bar ÀÉ ß µ ª", "a<|endoftext|>b", "\x1cx y", "日本語 text", "", " \n ", "İstanbul Σας", "a " * 9]
    for text, ids in zip(texts, TextIds(token_file(), True)(texts)):
        assert [*ids.tolist(), 1] == plain_ids(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_equals_the_plain_loop(sizes):
    where, offset = first_fit_decreasing(np.array(sizes, np.int64), 64)
    room, expected = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bin_ = next((b for b, left in enumerate(room) if left >= sizes[i]), len(room))
        room += [64] if bin_ == len(room) else []
        expected[i] = bin_, 64 - room[bin_]
        room[bin_] -= sizes[i]
    assert {i: (w, o) for i, (w, o) in enumerate(zip(where.tolist(), offset.tolist()))} == expected


def test_bins_use_the_first_with_room():
    bins = Bins(10, 4)
    assert [bins.first_fit(x) for x in (6, 6, 4, 4, 10)] == [0, 1, 0, 1, 2]


def test_every_id_lies_in_one_piece(odd_docs):
    packed = pack(odd_docs, token_file(), length=256, group_pieces=40).collect()
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(r.text)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, same in texts.items():
        if len(set(same)) > 1:
            continue
        ids = plain_ids(same[0])
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert [r.start for r in pieces] == sorted(list(range(0, len(ids), 256)) * len(same))
        for r in pieces:
            part = np.array(ids[r.start:r.start + r.length], "<u4")
            assert (r.doc_tokens, r.ids_crc32, r.length) == (len(ids), zlib.crc32(part.tobytes()), len(part))
    for pieces in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 256


def test_sequences_hold_the_ids(odd_docs):
    packed = pack(odd_docs, token_file(), length=256)
    held = sequences(odd_docs, packed, token_file(), length=256).collect()
    assert sum(len(r.ids) for r in held) == sum(len(plain_ids(r.text)) for r in odd_docs.collect())


def test_no_documents(no_docs):
    assert pack(no_docs, token_file()).count() == 0
