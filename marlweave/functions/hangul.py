"""Korean stems: an iterative rule, so the one part of text analysis that runs in Python, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = re.compile("[가-힣]+")
STRINGS = T.ArrayType(T.StringType())
#: Particles, endings and derivational suffixes, by length.
SUFFIXES = {
    4: "이라도",
    3: "으로써 으로서 이라고 에게서 이라도 습니다 합니다 입니다 ㅂ니다 적으로 인가요",
    2: "인지 인가 화된 적인 성이 되어 하여 되며 하며 한다 된다 했다 되고 하고 되는 하는 이다 되다 하다 든가 다가 고서 면서 으면 도록 아서 어서 거나 지만 는데 이야 든지 이랑 이며 이나 라도 마저 조차 마다 같이 만큼 처럼 보다 까지 부터 한테 께서 에게 에서 으로 라고",
    1: "들 하 상 성 화 적 음 기 됨 함 임 겠 었 았 라 자 게 니 지 고 서 면 며 여 요 야 랑 나 로 와 과 만 도 에 를 을 가 이 는 은 의 께",
}
BY_LENGTH = {n: frozenset(s.split()) for n, s in SUFFIXES.items()}
OPERATORS = frozenset("관하 관한 관련 대하 대한 대해 어떻게 어떻 어떤 무슨 뭐 무엇".split())
PARTICLES = frozenset("를 을 가 이 는 은 의".split())
COPULAS = frozenset("이라 이냐 인지 이어 이에 예요 입니까 인가".split())
ROOTS = ("답변", "말씀", "말해", "알려", "설명")
TAILS = frozenset("주십시오 줘 주세 주세요 하시오 하세요 해주십시오 해줘 해주세 해주세요 해".split())


@lru_cache(maxsize=1)
def suffixes() -> tuple[tuple[int, frozenset[str]], ...]:
    every = {s for group in BY_LENGTH.values() for s in group} | {"입니까"}
    return tuple((n, frozenset(s for s in every if len(s) == n)) for n in sorted({len(s) for s in every}, reverse=True))


def stem(word: str) -> str:
    """Takes off the longest suffix that leaves two characters, again and again."""
    while len(word) >= 3:
        for n, group in suffixes():
            if len(word) - n >= 2 and word[-n:] in group:
                word = word[:-n]
                break
        else:
            return word
    return word


def query_stem(word: str) -> str | None:
    """The stem of a question's word; None for words of grammar alone."""
    s = stem(word)
    if len(s) > 3:
        if s.endswith("이란"):
            s = s[:-2]
        elif s.endswith("화란"):
            s = s[:-1]
    if s in OPERATORS | PARTICLES | COPULAS or any(s.startswith(r) and s[len(r) :] in TAILS for r in ROOTS):
        return None
    return s


@F.pandas_udf(STRINGS)
def stems(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [stem(w) for w in RUN.findall(t)] if t else [])


@F.pandas_udf(STRINGS)
def query_stems(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [s for w in RUN.findall(t) if (s := query_stem(w)) is not None] if t else [])


@F.pandas_udf(STRINGS)
def characters(text: pd.Series) -> pd.Series:
    """Distinct characters of stemmed Korean words."""
    return text.map(lambda t: sorted({c for w in RUN.findall(t.casefold()) for c in stem(w)}) if t else [])


@F.pandas_udf(STRINGS)
def query_characters(text: pd.Series) -> pd.Series:
    return text.map(lambda t: sorted({c for w in RUN.findall(t.casefold()) for c in (query_stem(w) or "")}) if t else [])


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)
