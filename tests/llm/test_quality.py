import math
import re

import numpy as np

from lektra.llm import quality
from tests.conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    words = WORDS.findall(text)
    hit, seen = set(), {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(5)}
    lines, earlier, duplicates = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            duplicates += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(hit)


def test_counts_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for row in docs.collect():
        assert quality.count_text(row.text)[:5] == slow_counts(row.text)
    for text in ["", " \n\n", "a", "a b c d e a b c d e", "x x x x x x x", "a\xa0b c", "l\nl\nl\n \n", " ".join(map(str, range(70_000))) + " 0 1 2 3 4"]:
        assert quality.count_text(text)[:5] == slow_counts(text)


def test_wide_codes_stay_exact():
    codes = np.random.default_rng(0).integers(0, 2**20, 3000)
    codes[100:110] = codes[2000:2010]
    assert quality.repeated_words(codes) == 20


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = quality.judged(docs).select("kept", "base_failed", "quality").collect()
    labels = [r["quality"] for r in docs.select("quality").collect()]  # replaced in the verdicts, so read apart
    good = docs.filter("quality = 1")
    assert good.join(quality.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id", "kept"), "doc_id").filter("not kept").count() <= 0.02 * good.count()
    bad = docs.filter("quality = 0")
    assert bad.join(quality.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id", "kept"), "doc_id").filter("kept").count() <= 0.2 * bad.count()
    assert len(rows) == len(labels)


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.7
    right = [0.9, 0.8, 0.75, 0.85]
    votes = np.stack([np.where(rng.random(20_000) < 0.3, 0, np.where(rng.random(20_000) < p, np.where(good, 1, 2), np.where(good, 2, 1))) for p in right], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float), trust=0)
    assert abs(model.prior - 0.7) < 0.03
    assert all(abs(model.accuracy(j) - p) < 0.03 for j, p in enumerate(right))


def slow_votes(c):
    """The votes of one text, from its counts, written anew."""
    words, lines, letters = max(c["n_words"], 1), max(c["n_lines"], 1), max(c["n_letters"], 1)
    spaced = 3 * c["n_unspaced"] < letters
    length, common = c["word_chars"] / words, c["n_common"] / words
    variety = math.log(max(c["n_distinct"], 1)) / math.log(max(c["n_words"], 2))
    upper, ends, clean = c["n_upper"] / words, c["n_ends"] / words, c["n_letters"] / max(c["word_chars"], 1)
    pick = lambda bad, good: 2 if bad else 1 if good else 0
    return [
        pick(c["n_symbols"] / words > 0.1, c["n_symbols"] / words < 0.01),
        pick(length < 2.5 or length > 15, 3 <= length <= 9) if spaced else 3,
        pick(c["n_dup_lines"] / lines > 0.3 or c["n_repeat_words"] / words > 0.1, c["n_dup_lines"] == 0 and c["n_repeat_words"] / words < 0.01),
        pick(variety < 0.7, variety > 0.8) if spaced else 3,
        pick(upper > 0.5, 0.01 <= c["n_capital"] / words <= 0.4 and upper < 0.1) if c["n_upper"] + c["n_capital"] else 3,
        1 if common > 0.08 else 0 if c["n_other_letters"] / letters < 0.005 else 3,
        pick(ends > 0.5, 0.02 <= ends <= 0.35) if spaced else 3,
        pick(letters / max(c["word_chars"], 1) < 0.8, letters / max(c["word_chars"], 1) > 0.92),
    ]


def test_verdicts_match_em_over_single_documents(spark):
    """EM by plain loops over every document, without patterns, against the verdicts of the operator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    counts = [dict(zip(quality.COUNTS, quality.count_text(r.text))) for r in rows]
    votes = [slow_votes(c) for c in counts]
    n = len(rows)
    good = [1 / (1 + math.exp(-1 - 0.5 * v.count(1) + 4 * v.count(2))) for v in votes]
    for _ in range(500):
        prior = (sum(good) + 1) / (n + 2)
        rates = []
        for j in range(8):
            sums = [[1 + 0.1 * n * quality.EXPECTED[v][k] + sum((g if k == 0 else 1 - g) for g, vote in zip(good, votes) if vote[j] == v) for k in (0, 1)] for v in range(3)]
            rates.append([[sums[v][k] / sum(s[k] for s in sums) for k in (0, 1)] for v in range(3)])
        last = good
        good = []
        for vote in votes:
            a, b = prior, 1 - prior
            for j, v in enumerate(vote):
                if v < 3:
                    a, b = a * rates[j][v][0], b * rates[j][v][1]
            good.append(a / (a + b))
        if max(abs(x - y) for x, y in zip(good, last)) < 1e-7:
            break
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    for r, c, g in zip(rows, counts, good):
        failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        assert got[r.doc_id].base_failed == failed and abs(got[r.doc_id].quality - g) < 0.01
        assert got[r.doc_id].kept == (not failed and g >= 0.5) or abs(g - 0.5) < 0.01


CLEAN = {
    "ru": "Сегодня утром мы вышли из дома рано, потому что поезд отправлялся в семь часов. На станции было много людей, и все ждали своего поезда. Мой брат купил газету и кофе, а я смотрел в окно и думал о предстоящей поездке к морю.",
    "pl": "Wczoraj wieczorem poszliśmy do kina, żeby zobaczyć nowy film. Było bardzo dużo ludzi, ale udało nam się znaleźć dobre miejsca. Po filmie rozmawialiśmy długo w kawiarni i wróciliśmy do domu dopiero przed północą.",
    "tr": "Dün akşam arkadaşlarımla birlikte sinemaya gittik. Film çok güzeldi ama biraz uzundu. Sonra bir kafede oturup çay içtik ve uzun uzun sohbet ettik. Eve döndüğümde saat gece yarısını geçmişti ve hemen uyudum.",
    "ar": "ذهبنا أمس إلى السوق لشراء الخضروات والفواكه. كان الجو جميلا والناس كثيرون. اشترى أخي تفاحا وبرتقالا، ثم عدنا إلى البيت وتناولنا الغداء مع العائلة. في المساء قرأت كتابا جديدا عن تاريخ المدينة القديمة.",
    "ja": "今日は天気がとても良いです。 朝早く起きて、 公園を散歩しました。 たくさんの人がいて、 子供たちが遊んでいました。 その後、 友達と一緒に 昼ご飯を食べました。 午後は図書館で 本を読んで過ごしました。",
    "nl": "Gisteren zijn we met de trein naar zee gereden. Het was mooi weer, dus we bleven de hele dag op het strand liggen. Mijn broer kocht ijsjes en mijn zus las een boek. Laat in de avond kwamen we moe maar tevreden thuis.",
}


def test_clean_texts_of_other_languages_stay_and_bad_ones_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bad = ["BUY NOW!! " * 30 + "CHEAP!! " + " ".join(f"WORD{i}!!" for i in range(40)), " | ".join(f"x{i}" for i in range(80)), " ".join(f"cell{i}***" for i in range(60))]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*CLEAN.values(), *bad])], docs.schema)
    got = {r.doc_id - 10**6: r.kept for r in quality.judged(docs.union(more)).filter("doc_id >= 1000000").collect()}
    assert [got[i] for i in range(len(CLEAN))] == [True] * len(CLEAN), dict(zip(CLEAN, got.values()))
    assert [got[len(CLEAN) + i] for i in range(len(bad))] == [False] * len(bad)


def test_nulls_ties_and_clashing_columns(spark):
    fine = " ".join(f"the word{i} and" for i in range(40)) + "."
    rows = [(1, fine, "k", 1), (1, fine, None, 2), (None, None, "k", 3), (2, "", "k", 4), (3, "a " * 100_000, "k", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = quality.judged(docs).collect()
    assert [r.n_words for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0))] == [120, 120, 0, 100_000, 0]
    assert all(r.base_failed and not r.kept for r in got if r.doc_id != 1)
    left = quality.filtered(docs)
    assert left.schema == docs.schema and {r.n_words for r in left.collect()} <= {1, 2}
    empty = spark.createDataFrame([], docs.schema)
    assert quality.judged(empty).count() == 0 and quality.filtered(empty).count() == 0
