"""Operator 2: quality rules by weak supervision.

Rules look at counts of a text and vote good, vote bad or abstain. The votes of all documents are counted by
vote pattern in Spark (4 to the power of the number of rules patterns at most, so the driver's share is
bounded), expectation-maximisation over these counts estimates how often each rule votes each way on good and
on bad documents, and each document is kept by the posterior probability of being good. A document that the
base rules fail goes in any case.

No rule asks for a language: the list of frequent words can only speak for a text, and is not asked where letters that its
languages lack occur; rules that look at words or at upper case can't judge a script without blanks or case; votes that a
rule can't cast count for neither class. No rule is switched by the length of a text; vocabulary is
measured by the logarithms of distinct and of all words, which hardly moves with length.

Defined results: a null or blank text has no words and fails the base rules; repeated rows and ties in the id are
judged row by row; an empty table gives an empty table; columns of the input whose names the operator makes are
replaced. Texts are never cut.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lektra.llm.common import BLANKS, text_slices, written

_WORDS = re.compile(rf"[^{BLANKS}]+")
SYMBOLS = "#*$%&|<>"

#: Frequent words of the corpus languages.
COMMON_WORDS = frozenset("the of and to in is that a it was for on are as with be by at this have from or an der die das und ist von zu den mit sich des auf für im dem ein eine als auch le la les de et un une est que qui dans pour pas en du des au el los las del se por con para una no su al lo como y".split())

#: The letters of these languages.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäæçèéêëíîïñóôöœùúûüÿß"
#: Marks that end a sentence in one of many scripts.
ENDS = ".!?…。！？؟।"
#: First and last code point of blocks whose scripts write no blanks between words.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_capital", "n_common", "n_ends", "n_lines", "n_letters", "n_other_letters", "n_unspaced")
RULES = ("symbols", "word_length", "repetition", "variety", "capitals", "common_words", "sentences", "letters")


@cache
def kinds_of_characters() -> np.ndarray:
    """For each code point: 1 a letter, mark or number of the corpus languages, 2 another one, 3 one of a script without blanks, 0 no such."""
    found = 2 * np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), np.uint8, 0x110000)
    for first, last in UNSPACED:
        found[first : last + 1] = np.where(found[first : last + 1] > 0, 3, 0)
    found[[*map(ord, "0123456789" + LETTERS + LETTERS.upper().replace("SS", ""))]] = 1
    return found


def repeated_words(codes: np.ndarray, width: int = 5) -> int:
    """How many words stand in a window of ``width`` words that the text has twice or more; exact, as codes are."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    window, top = codes[:n], int(codes.max()) + 1
    for k in range(1, width):
        window = window * top + codes[k : k + n]
        if k + 1 < width and (int(window.max()) + 1) * top >= 2**62:
            window = np.unique(window, return_inverse=True)[1]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    steps = np.zeros(len(codes) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(steps)[:-1]))


def count_text(text: str) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    words = _WORDS.findall(text)
    codes: dict[str, int] = {}
    coded = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    kinds = np.bincount(kinds_of_characters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=4)
    upper = sum(map(str.isupper, words))
    return (
        len(words),
        len("".join(words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(coded) if len(codes) < len(words) else 0,
        len(codes),
        upper,
        sum(w[0].isupper() for w in words) - sum(w[0].isupper() for w in words if w.isupper()),
        sum(map(COMMON_WORDS.__contains__, map(str.lower, words))),
        sum(w[-1] in ENDS for w in words),
        len(lines),
        int(kinds[1:].sum()),
        int(kinds[2] + kinds[3]),
        int(kinds[3]),
    )


def counted(docs: DataFrame, text_col: str = "text", *, keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with the columns of COUNTS, and without the text unless ``keep_text``."""
    kept = [c for c in docs.columns if c not in COUNTS]
    at = kept.index(text_col)
    stay = [c for c in kept if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, at):
            found = np.array([count_text(x or "") for x in part.column(at).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), *(pa.array(found[:, i]) for i in range(len(COUNTS)))], names=[*stay, *COUNTS])

    chosen = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = StructType([*(chosen.schema[c] for c in stay), *(StructField(name, LongType()) for name in COUNTS)])
    return chosen.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> list[Column]:
    """For each of RULES: 1 good, 2 bad, 0 neither though it can judge the text, 3 it can't judge it."""
    words, lines, letters = (F.greatest(c, F.lit(1)) for c in ("n_words", "n_lines", "n_letters"))
    spaced = 3 * F.col("n_unspaced") < letters

    def rule(bad: Column, good: Column, able: Column | None = None) -> Column:
        vote = F.when(bad, 2).when(good, 1).otherwise(0)
        return vote if able is None else F.when(able, vote).otherwise(3)

    def share(name: str) -> Column:
        return F.col(name) / words

    variety = F.log(F.greatest("n_distinct", F.lit(1)).cast("double")) / F.log(F.greatest("n_words", F.lit(2)).cast("double"))
    length = share("word_chars")
    return [
        rule(share("n_symbols") > 0.1, share("n_symbols") < 0.01),
        rule((length < 2.5) | (length > 15), length.between(3, 9), spaced),
        rule((F.col("n_dup_lines") / lines > 0.3) | (share("n_repeat_words") > 0.1), (F.col("n_dup_lines") == 0) & (share("n_repeat_words") < 0.01)),
        rule(variety < 0.7, variety > 0.8, spaced),
        rule(share("n_upper") > 0.5, share("n_capital").between(0.01, 0.4) & (share("n_upper") < 0.1), F.col("n_upper") + F.col("n_capital") > 0),
        rule(F.lit(False), share("n_common") > 0.08, (share("n_common") > 0.08) | (F.col("n_other_letters") / letters < 0.005)),
        rule(share("n_ends") > 0.5, share("n_ends").between(0.02, 0.35), spaced),
        rule(letters / F.greatest("word_chars", F.lit(1)) < 0.8, letters / F.greatest("word_chars", F.lit(1)) > 0.92),
    ]


@dataclass(frozen=True)
class Model:
    """Share of good documents, and for each rule how often it abstains, votes good, votes bad on those of the (good, bad) documents that it can judge."""

    prior: float
    rates: tuple[tuple[tuple[float, float], ...], ...]
    rounds: int

    def accuracy(self, rule: int) -> float:
        """The share of right votes among the votes of a rule."""
        good, bad = self.prior, 1 - self.prior
        (_, (gg, gb), (bg, bb)) = self.rates[rule]
        cast = good * (gg + bg) + bad * (gb + bb)
        return (good * gg + bad * bb) / cast if cast else 0.5

    def posterior(self) -> Column:
        """The probability that a document is good, from its votes."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, rates in zip(votes(), self.rates):
            neither, good, bad = (math.log(g / b) for g, b in rates)
            odds = odds + F.when(vote == 0, neither).when(vote == 1, good).when(vote == 2, bad).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


#: How a rule is expected to vote (neither, good, bad) on good and on bad documents, before any are seen.
EXPECTED = np.array([[0.08, 0.3], [0.9, 0.2], [0.02, 0.5]])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, *, trust: float = 0.1, rounds: int = 500, tolerance: float = 1e-7) -> Model:
    """Two classes and rules that are independent in each; patterns has a row of votes for each count.

    EXPECTED counts like a share of ``trust`` of all documents, at every size of the input. Posteriors start from the votes, where
    one for bad weighs more than those for good: a defect shows to few rules. A vote of 3 is left out: that a
    rule can't judge a script or a language is no sign of either class.
    """
    total, before, done = counts.sum(), -np.inf, 0
    good = 1 / (1 + np.exp(-1 - 0.5 * (patterns == 1).sum(1) + 4.0 * (patterns == 2).sum(1)))
    cast = [patterns == v for v in range(3)]
    for done in range(1, rounds + 1):
        weights = np.stack([counts * good, counts * (1 - good)])
        prior = float(np.clip((weights[0].sum() + 1) / (total + 2), 1e-4, 1 - 1e-4))
        rates = np.stack([(weights @ of).T + 1.0 for of in cast], 1) + trust * total * EXPECTED  # rule, vote, class
        rates /= rates.sum(1, keepdims=True)
        logs = np.log(np.array([prior, 1 - prior]))[None, :] + sum(of @ np.log(rates[:, v, :]) for v, of in enumerate(cast))
        top = logs.max(1, keepdims=True)
        likely = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        good = np.exp(logs[:, 0] - likely)
        score = float((counts * likely).sum() / max(total, 1))
        if abs(score - before) < tolerance:
            break
        before = score
    return Model(prior, tuple(tuple((float(g), float(b)) for g, b in rule) for rule in rates), done)


def fit(counted_docs: DataFrame) -> Model:
    """EM over the vote patterns of all documents."""
    pattern = sum((vote * 4**j for j, vote in enumerate(votes())), F.lit(0))
    found = counted_docs.groupBy(pattern.alias("pattern")).count().collect()  # 4 ** len(RULES) rows at most
    if not found:
        return Model(0.5, ((((1 / 3), (1 / 3)),) * 3,) * len(RULES), 0)
    codes = np.array([r["pattern"] for r in found], np.int64)
    patterns = np.stack([codes // 4**j % 4 for j in range(len(RULES))], axis=1)
    return expectation_maximisation(patterns, np.array([r["count"] for r in found], float))


def accuracies(model: Model) -> dict[str, float]:
    """What the fit says of each rule: the share of right ones among the votes that it casts."""
    return {name: model.accuracy(j) for j, name in enumerate(RULES)}


def judged(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with COUNTS, quality (posterior), base_failed and kept; without the text unless ``keep_text``.

    Texts are counted once: the rows with their counts are written to the shared folder, the fit reads the counts alone.
    """
    counts = written(counted(docs, text_col, keep_text=keep_text), "quality-counts")
    model = fit(counts)
    made = counts.withColumns({"quality": model.posterior(), "base_failed": base_failed()})
    return made.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def filtered(docs: DataFrame) -> DataFrame:
    """The kept rows with the columns of ``docs``; made columns are told apart from columns of the same name."""
    own = [f"__{i}" for i in range(len(docs.columns))]
    names = {f"__{i}": "text" if c == "text" else f"__{i}" for i, c in enumerate(docs.columns)}
    moved = docs.toDF(*(names[x] for x in own))
    return judged(moved).filter("kept").select(*(F.col(names[x]).alias(c) for x, c in zip(own, docs.columns)))
