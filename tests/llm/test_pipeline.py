import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lektra.llm import bpe, quality, secrets
from tests.conftest import SF
from tests.llm.test_decontamination import slow as leaks
from tests.llm.test_nearcopies import slow as slow_copies


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in quality.judged(docs).filter("kept").collect()}
    first = slow_copies(kept.items())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in leaks([(d, kept[d]) for d in first], items)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    scan = secrets.Scanner()
    wanted = {d: library.encode(secrets.masked(kept[d], scan.scan([kept[d]])[0]), add_special_tokens=False).ids for d in first - leaked}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, SF).collect()}
    assert leaked and got == wanted


def test_stages_keep_columns_and_take_odd_rows(spark):
    fine = " ".join(f"the word{i} and" for i in range(60)) + "."
    rows = [(1, fine, "en", "s", 1, "x"), (1, fine, "en", "s", 1, "x"), (None, None, None, None, None, None), (2, "", "en", "s", 0, "x"), (3, fine.replace("word", "term") + " token=abcdefghijklmnop", "en", "s", 5, None), (None, "Der " + fine * 300, "de", "s", 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
    assert sorted(r.doc_id for r in now.collect()) == [1, 3]
    assert bpe.encode(now, public_tokenizers.path("word_bpe_49k.json")).count() == now.count()
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
