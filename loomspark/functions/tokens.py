"""Lexical tokens: NFKC and case folding, words and CJK runs with their bigrams.  Arrow-batched, because the JVM has no NFKC."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# The CJK ranges (Hangul counts as a word script) and the words that say nothing about a task.
CJK_RANGES = ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x3134F))
GENERIC_TOKENS = (
    "the a an and or to of for in on my our me we please continue help write writing style voice identity project task agent ai update test tests fix code "
    "我的 我们 帮我 继续 一下 这个 那个 之前 现在 项目 任务 测试 更新 优化 写作 风格 语音 助手"
).split()

_CJK = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)
_PLAIN = re.compile(r"[a-z0-9][a-z0-9_.\-]*")


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


class _Classes(dict):
    """The class of each character by its code, found when first met."""

    def __missing__(self, code: int) -> str:
        kind = unicodedata.category(chr(code))[0]
        if any(a <= code <= b for a, b in CJK_RANGES):
            found = "c"
        else:
            found = "w" if kind in "LN" else "m" if kind == "M" else "j" if chr(code) in "_.-" else " "
        self[code] = found
        return found


_CLASSES = _Classes()


def _classes(text: str) -> str:
    """One letter per character: c CJK, w word, m mark, j joiner inside words, blank for anything else."""
    return text.translate(_CLASSES)


#: Over the classes: a word run takes marks and joiners along, a CJK run marks only.
_RUNS = re.compile(r"w[wmj]*|c[cm]*")


def tokenize(text: str | None) -> list[str]:
    """Tokens in order, repeats kept: runs of at least two characters; CJK runs of three or more also give their bigrams."""
    if not text:
        return []
    folded = fold(text)
    if folded.isascii():
        return [t for t in _PLAIN.findall(folded) if len(t) >= 2]
    tokens = []
    for run in _RUNS.finditer(_classes(folded)):
        token = folded[run.start() : run.end()]
        if len(token) >= 2:
            tokens.append(token)
            if run.group()[0] == "c" and len(token) >= 3:
                tokens += [token[i : i + 2] for i in range(len(token) - 1)]
    return tokens


@pandas_udf(ArrayType(StringType()))
def tokens(text: pd.Series) -> pd.Series:
    return pd.Series([tokenize(t) for t in text], dtype=object)


@pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else fold(t) for t in text], dtype=object)


@pandas_udf(ArrayType(StringType()))
def top_tokens(text: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([[t for t, _ in Counter(tokenize(x)).most_common(int(n))] for x, n in zip(text, limit, strict=True)], dtype=object)


def keywords(docs: DataFrame, key: str, text: Column, limit: int = 120) -> DataFrame:
    """key, keywords: each row's most frequent tokens, ties by first occurrence; one narrow pass, as a row is one text."""
    return docs.select(key, top_tokens(text, F.lit(limit)).alias("keywords"))


def corpus_keywords(rows: DataFrame, key: str, text: Column, order: Column, limit: int = 120) -> DataFrame:
    """key, keywords over all texts of a key, in ``order``: counts are pre-aggregated, no key's texts are gathered.

    Ties by the first occurrence (row order, then place in the row).
    """
    flat = rows.select(key, order.alias("_row"), F.posexplode(tokens(text)).alias("_at", "token"))
    counts = flat.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_row", "_at")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("k")).select(key, F.col("k.token").alias("keywords"))
