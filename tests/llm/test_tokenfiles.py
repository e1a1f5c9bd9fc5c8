import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lektra.llm import tokenfiles
from lektra.llm.common import fresh_path
from lektra.llm.queries import WORD_BPE
from tests.conftest import SF

PATH = public_tokenizers.path(WORD_BPE)


def test_codes():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        for top in (1, 255, 256, 257, 65_536, 2**24 + 5, 2**32 - 1):
            ids = (rng.random(n) ** 3 * top).astype(np.uint32)
            ids[: min(n, 2)] = top
            codes = tokenfiles.Codes.of(ids)
            again = tokenfiles.Codes.from_bytes(*([x.tobytes() for x in xs] for xs in (codes.levels, codes.bitmaps, codes.ranks)))
            assert again.between(0, n).tolist() == ids.tolist()
            for a, b in zip(rng.integers(0, n + 1, 40).tolist(), rng.integers(0, n + 1, 40).tolist()):
                assert again.between(min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)].tolist()
            for i in {0, n - 1, n // 2, *range(0, n, 97)} if n else ():
                assert again[i] == ids[i]


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SEGMENT_IDS", 5000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    path = fresh_path(spark, "tokens")
    tokenfiles.write(docs, PATH, path, end_id=2)
    rows = {r.doc_id: r for r in tokenfiles.read(spark, path).collect()}
    library, start, whole = Tokenizer.from_file(PATH), 0, []
    for r in docs.orderBy("doc_id").collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        assert (rows[r.doc_id].start, rows[r.doc_id].n_tokens, rows[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        whole += ids
    assert len(rows) == docs.count()
    for i in (0, 17, len(whole) // 3, len(whole) - 1):
        assert tokenfiles.token_at(spark, path, i) == whole[i]


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(5, "the cat", 1), (5, "the cat", 2), (None, None, 3), (7, "", 4), (6, "a " * 300_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    path = fresh_path(spark, "tokens")
    tokenfiles.write(docs, PATH, path, end_id=2)
    got = sorted(tokenfiles.read(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 1), (5, 1, 3), (5, 4, 3), (6, 7, 300_001), (7, 300_008, 1)]
    empty = fresh_path(spark, "tokens")
    tokenfiles.write(spark.createDataFrame([], docs.schema), PATH, empty, end_id=2)
    assert tokenfiles.read(spark, empty).count() == 0
