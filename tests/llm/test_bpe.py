import hashlib
import os
import subprocess
import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lektra.llm import bpe
from lektra.llm.queries import WORD_BPE

PATH = public_tokenizers.path(WORD_BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def pieces():
    return bpe.PieceTable(bpe.read_spec(PATH))


def same(library, pieces, texts):
    for text, got in zip(texts, pieces.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want, repr(text[:80])
        assert pieces.decode(got) == library.decode(want, skip_special_tokens=False)


def test_odd_texts(library, pieces):
    same(library, pieces, ["", " ", "a<|endoftext|>b<|startoftext|>", "'S'Re don't I'LL we'd", "İΣΑΣ ẞ ǅ", "é Å ẛ̣", "x\x1cy\x1fz\x85w v​u", "aaaaaaaa" * 50, "1234 ½ Ⅷ ²", "👩‍👩‍👧 🏳️‍🌈 日本語テキスト", "<|endoftext|", "\x00\x01", "<|ENDOFTEXT|>"])


def test_each_character(library, pieces):
    same(library, pieces, [f"a{chr(c)}b {chr(c)}" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000])


def test_bands_make_the_same_ids(pieces):
    rng = np.random.default_rng(3)
    bands = bpe.PieceTable(bpe.read_spec(PATH), by_bands=True)
    texts = ["".join(rng.choice(list("aabcdenrst "), 400)) for _ in range(30)] + ["a" * 999, "ab" * 500]
    for a, b in zip(bands.encode(texts), pieces.encode(texts)):
        assert a.tolist() == b.tolist()


def test_documents(spark, library):
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in bpe.round_trip(docs, PATH).collect()}
    for row in docs.collect():
        ids = library.encode(row.text, add_special_tokens=False).ids
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "The cat", "x"), (1, "The cat", None), (None, None, "z"), (3, "", None), (4, "a " * 200_000, "n")]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == [(False, 1, 2), (False, 1, 2), (False, 3, 0), (False, 4, 200_000), (True, 0, 0)]
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_what_parsing_took_is_given_back():
    """In a process of its own: private memory that a table adds."""
    code = f"""
import re
from lektra.llm import bpe
private = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
spec, before = bpe.read_spec({PATH!r}), private()
bpe.piece_table(spec)
print(private() - before)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    told = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=60)
    assert float(told.stdout.strip()) < 30, told.stderr


def test_chunks_of_a_slice_are_not_held_together(pieces):
    """Beyond the ids: chunks are numbered as they are met, so those of one text are Python objects at a time."""
    texts = [" ".join(f"w{(i * j) % 997}" for i in range(500)) for j in range(800)]
    pieces.encode(texts)
    tracemalloc.start()
    found = pieces.encode(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most - sum(x.nbytes for x in found) < 10e6


def test_a_table_that_failed_to_learn_starts_afresh(library, pieces, monkeypatch):
    monkeypatch.setattr(pieces, "merge", lambda symbol, piece: 1 // 0)
    with pytest.raises(ZeroDivisionError):
        pieces.encode(["neverbefore seenwords"])
    monkeypatch.undo()
    same(library, pieces, ["neverbefore seenwords", "", "the <|endoftext|> cat"])


def test_plain_chunks_need_no_pattern(library, monkeypatch):
    """Printable ASCII is told without the regular expression, which took a twentieth of op5's encoding."""
    bands = bpe.PieceTable(bpe.read_spec(PATH), by_bands=True)
    monkeypatch.setattr(bpe, "_SIMPLE", lambda chunk: 1 // 0)
    same(library, bands, ["Plain words, don't they (2024)?"])


def test_pieces_are_merged_once(library, monkeypatch):
    """Chunks that differ by case and punctuation share pieces, which token files merge once."""
    bands, sizes = bpe.PieceTable(bpe.read_spec(PATH), by_bands=True), []
    whole = bands.merge_by_bands
    monkeypatch.setattr(bands, "merge_by_bands", lambda symbol, piece: sizes.append(len(symbol)) or whole(symbol, piece))
    same(library, bands, ["gnarlwort"])
    same(library, bands, ["Gnarlwort gnarlwort, (GNARLWORT)! gnarlwort's", "gnarlwort gnarlwort2gnarlwort"])
    assert sizes[0] == 9 and sum(sizes[1:]) < 12


def test_bands_on_odd_texts(library, monkeypatch):
    bands = bpe.PieceTable(bpe.read_spec(PATH), by_bands=True)
    same(library, bands, [f"a{chr(c)}b {chr(c)} x{chr(c)}" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000])
    same(library, bands, ["", " ", "a<|endoftext|>b Ab, AB", "'S'Re don't I'LL we'd", "é e\u0301 É, \u00c3\u00a9", "日本 x日本, ﬁ"])
    monkeypatch.setattr(bpe, "BAND_MEMORY", (3, 9))  # forgets before each call
    for text in ("one, two three", "Two! one <|endoftext|> ½", "three"):
        same(library, bands, [text])
