"""Arrow functions for what Spark's own functions can't say."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

#: Characters of a chunk, which ends after a line break in its second half if there is one.
CHUNK = 28_000
#: Texts of a batch that are Python objects at a time.
TEXTS = 128


def by_pieces(texts: pa.Array, of: Callable, kind: pa.DataType | None = None) -> pa.Array:
    """A function of each text, null for null; all but a piece of the batch stays in Arrow, so a worker holds little more than its batch and what is made of it."""
    kind = kind or pa.string()
    made = [pa.array([None if t is None else of(t) for t in texts.slice(i, TEXTS).to_pylist()], kind) for i in range(0, len(texts), TEXTS)]
    return pa.concat_arrays(made) if made else pa.array([], kind)


@F.arrow_udf(StringType())
def unicode_nfc(texts: pa.Array) -> pa.Array:
    return by_pieces(texts, lambda t: unicodedata.normalize("NFC", t))


def chunks_of(text: str, most: int = CHUNK) -> list[dict]:
    out, at = [], 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            line = text.rfind("\n", at + most // 2, end)
            end = line + 1 if line >= 0 else end
        out.append({"start": at, "text": text[at:end]})
        at = end
    return out


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("text", StringType())])))
def chunked(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: chunks_of(t or ""))


def repair(text: str) -> str:
    """UTF-8 that was read as Latin-1 is read again, if that leaves fewer odd characters."""
    odd = lambda t: sum(t.count(c) for c in "ÃÂâ�")
    for code in ("latin-1", "cp1252"):
        try:
            again = text.encode(code).decode("utf-8", "ignore")
        except UnicodeEncodeError:
            continue
        if odd(again) < odd(text):
            return again
    return text


@F.arrow_udf(StringType())
def repaired(texts: pa.Array) -> pa.Array:
    return by_pieces(texts, repair)


@F.pandas_udf(BinaryType())
def packed_vectors(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats; the vectors of a batch are packed together."""
    sizes = np.array([0 if v is None else 4 * len(v) for v in vectors], np.int64)
    raw = np.concatenate([np.empty(0, "<f4"), *(v for v in vectors if v is not None)]).astype("<f4").tobytes()
    ends = np.cumsum(sizes)
    return pd.Series([None if v is None else raw[end - n : end] for v, n, end in zip(vectors, sizes.tolist(), ends.tolist())], dtype=object)


@F.pandas_udf(ArrayType(DoubleType()))
def decoded_vectors(blobs: pd.Series) -> pd.Series:
    """Null for a blob whose length is no multiple of four."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").astype(float))


@F.pandas_udf(StringType())
def fnv1a64(texts: pd.Series) -> pd.Series:
    """Sixteen hexadecimal digits; the texts of a batch are gone through together, byte by byte."""
    raw = [b"" if t is None else t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data, begins = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes
    values = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    order = np.argsort(-sizes, kind="stable")
    for place in range(int(sizes.max(initial=0))):
        going = order[: np.searchsorted(-sizes[order], -place, side="left")]
        values[going] = (values[going] ^ data[begins[going] + place]) * np.uint64(0x100000001B3)
    return pd.Series([None if t is None else f"{v:016x}" for t, v in zip(texts, values.tolist())], dtype=object)


def mend(text: str) -> str:
    """JSON from what a model said: fences and talk around it, bare keys, and commas too many or too few."""
    text = re.sub(r"```[a-z]*", "", text)
    begin, end = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=0), max(text.rfind("]"), text.rfind("}"))
    text = text[begin : end + 1] if end >= begin else text
    text = text.translate(str.maketrans("“”‘’", "\"\"''"))
    text = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', text)
    text = re.sub(r",(\s*[\]}])", r"\1", text)
    return re.sub(r"\}(\s*)\{", r"},\1{", text)


@F.arrow_udf(StringType())
def jsonish(texts: pa.Array) -> pa.Array:
    return by_pieces(texts, mend)


def laid_out(text: str | None) -> str | None:
    """JSON objects and arrays over lines, two blanks a level; null for anything else."""
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return None
    return json.dumps(value, indent=2, ensure_ascii=False) if isinstance(value, (dict, list)) else None


@F.arrow_udf(StringType())
def pretty_json(texts: pa.Array) -> pa.Array:
    return by_pieces(texts, laid_out)
