import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lektra.llm import alignment, queries
from lektra.llm.bpe import read_spec
from lektra.llm.queries import BYTE_BPE, PIECE_BPE
from tests.conftest import SF

PATHS = [public_tokenizers.path(x) for x in (BYTE_BPE, PIECE_BPE)]


def slow(texts):
    """The contract's columns of each text, with the libraries on whole texts."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    spare = iter(range(256, 512))
    mark = {i: chr(i) if 33 <= i <= 126 or 161 <= i <= 255 and i != 173 else chr(next(spare)) for i in range(256)}
    byte_of = {c: i for i, c in mark.items()}
    found, total = [], Counter()
    for text in texts:
        links, groups, of_a, of_b = [], [], [], []
        if text:
            of_a, of_b = a.encode(" " + text, add_special_tokens=False), b.encode(text)
            raw_a = [bytes(byte_of[c] for c in t) for t in of_a.tokens]
            raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in of_b)]
            of_a = of_a.ids
            if b"".join(raw_a) == b"".join(raw_b) == f" {text}".encode():
                ends = [{}, {}]
                for raw, held in zip((raw_a, raw_b), ends):
                    end = 0
                    for i, x in enumerate(raw):
                        end += len(x)
                        held[end] = i
                i = j = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    x, y = ends[0][end], ends[1][end]
                    links.append((of_a[x], of_b[y]))
                    groups.append(",".join(map(str, of_a[i : x + 1])) + "|" + ",".join(map(str, of_b[j : y + 1])))
                    i, j = x + 1, y + 1
            else:
                of_a, of_b = [], []
        total.update(links)
        found.append((len(of_a), len(of_b), links, ";".join(groups)))
    highest = Counter()
    for (_, y), n in total.items():
        highest[y] = max(highest[y], n)
    return [(n_a, n_b, len(links), len(links), sum(total[x] == highest[x[1]] for x in links), sum(total[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "") for n_a, n_b, links, text in found]


def columns(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups is not None else ""


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    wanted = {r.doc_id: x for r, x in zip(rows, slow([r.text for r in rows]))}
    assert {r.doc_id: columns(r) for r in alignment.aligned(docs.repartition(5), *PATHS).collect()} == wanted
    query = queries.op12_token_alignment(spark, SF).collect()
    assert {r.doc_id: (*(r[c] for c in alignment.COUNTS), r.groups_sha256) for r in query} == wanted


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_odd_texts(spark, monkeypatch, most):
    monkeypatch.setattr(alignment, "MOST_BROADCAST", most)
    monkeypatch.setattr(alignment, "OUTPUT_CHARS", 200)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 300)
    monkeypatch.setattr(alignment, "LONG_TEXT", 50)
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\r\n", "\t", " ", "　", "\x1c", "\x85", " ", "​", "a", "the", "don't", "Ünï", "́", "東京", "\U0001f600", "12", "345", "...", ";\r", "<s>", "<|endoftext|>", "▁", "\x00", "()", "'s", "we'", "}", "﻿", "᠎"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += [None, "", " ", "  ", "\n", "word ", "word  \n ", " word", "x" * 5000, "the " * 3000, "the cat", "the cat", "a▁b c", "▁"]
    rows = [(rng.choice([None, 7, i]) if i % 5 == 0 else i, t, i, "groups") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, segment string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, *columns(r)) for r in alignment.aligned(docs.repartition(3), *PATHS).collect())
    assert got == sorted((d if d is not None else -1, *x) for (d, *_), x in zip(rows, slow(texts)))


def test_no_rows_and_texts_without_tokens(spark):
    schema = "doc_id long, text string"
    assert alignment.aligned(spark.createDataFrame([], schema), *PATHS).count() == 0
    rows = alignment.aligned(spark.createDataFrame([(1, None), (2, "")], schema), *PATHS).collect()
    assert sorted((r.doc_id, *columns(r)) for r in rows) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_cuts_and_refusals():
    tools = alignment.Aligner(*map(read_spec, PATHS))
    assert " " in tools.starts and "\r" not in tools.starts
    for text in ("a b  c\nd \n e\r\nf  g ", " x", "", "東京 都"):
        assert "".join(tools.segments(text)) == f" {text}"
    assert list(tools.segments("a b  c d")) == [" a", " b", "  c", " d"]
    assert not tools.faithful("a▁") and tools.faithful("á\x00€")
    word = read_spec(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        alignment.Aligner(word, read_spec(PATHS[1]))
