import numpy as np

import corpus_pipeline
from lakeloom.llm.queries import QUERIES
from lakeloom.llm.shared import words_of
from tests.llm.test_documents import plain_classes, plain_lines
from tests.llm.test_packing import plain_ids


def plain_pipeline(texts, items):
    """{doc_id: text} after all filters, by plain loops."""
    texts = {d: t for d, t in texts.items() if t and any(map(str.isalpha, t))}
    gone = {(d, i) for d, i, _, _ in plain_lines(texts)}
    left = {}
    for d, text in texts.items():
        lines = text.split("\n")
        kept = [line for i, line in enumerate(lines) if (d, i) not in gone]
        if len(kept) == len(lines) or words_of("\n".join(kept)):
            left[d] = "\n".join(kept)
    classes = plain_classes(left)
    left = {d: t for d, t in left.items() if classes[d] == d}
    return {d: t for d, t in left.items() if not any(" ".join(words_of(item)) in " ".join(words_of(t)) for item in items)}


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    word = lambda: f"{rng.choice(['al', 'be', 'co', 'du'])}{rng.choice(['na', 'ri', 'to'])}{rng.integers(0, 300)}x"
    items = [" ".join(word() for _ in range(30)) for _ in range(2)]
    texts = {d: "\n".join(" ".join(word() for _ in range(12)) for _ in range(4)) for d in range(30)}
    texts |= {30: texts[3], 31: texts[4] + "\n" + texts[5].split("\n")[1], 32: texts[6].replace(texts[6].split()[5], "zzz"),
              33: texts[7] + " " + items[0], 34: items[1], 35: None, 36: "", 37: "12 !!!"}
    texts[38] = " ".join(texts[9].split()[:-2])
    docs = [(d, t, "en", "s", len(t or "")) for d, t in texts.items()]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").coalesce(1).write.parquet(
        str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = plain_pipeline(texts, items)
    assert {r.doc_id: r.doc_tokens for r in found} == {d: len(plain_ids(t)) for d, t in expected.items()}
    assert 33 not in expected and 30 not in expected and len(expected) < len(texts) - 6


def stored(spark, folder, docs, items, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
    spark.createDataFrame(docs, schema).coalesce(2).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_rows_without_an_id_repeated_rows_and_clashing_columns(spark, tmp_path):
    rng = np.random.default_rng(9)
    text = lambda: " ".join(f"w{rng.integers(0, 10 ** 6)}x" for _ in range(30))
    a, b, c, d, e, item = (text() for _ in range(6))
    # One row without an id is a copy, one holds the item; rows with one id and different texts; equal rows.
    docs = [(1, a), (None, a), (None, b), (None, f"{c} {item}"), (None, c), (2, a), (2, d), (3, e), (3, e), (None, None), (4, ""), (5, "7 !")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _drop string, node string"
    folder = stored(spark, tmp_path, [(i, t, None, "s", None, "x", "y") for i, t in docs], [(1, item), (None, None), (2, "")], schema)
    found = corpus_pipeline.run(spark, folder).collect()
    expected = [(1, a), (None, b), (None, c), (2, d), (3, e)]
    assert sorted(((r.doc_id, r.doc_tokens) for r in found), key=repr) == sorted(((i, len(plain_ids(t))) for i, t in expected), key=repr)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, stored(spark, tmp_path, [], [])).count() == 0


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "line dedup", "near-dedup", "decontamination", "packing"]
    assert len(QUERIES) == 13
