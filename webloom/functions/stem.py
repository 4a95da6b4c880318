"""Stop words, and the Snowball stemmer for English (Porter2), by its published description."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The common English list, and the Danish list with punctuation marks.
STOP_EN = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has
    had having do does did doing a an the and but if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over under again further then once here there when
    where why how all any both each few more most other some such no nor not only own same so than too very s t can will just
    don should now""".split()
)
STOP_DA = tuple(
    """af alle andet andre at begge da de den denne der deres
    det dette dig din dog du ej eller en end ene eneste enhver
    et fem fire flere fleste for fordi forrige fra få før god han
    hans har hendes her hun hvad hvem hver hvilken hvis hvor hvordan
    hvorfor hvornår i ikke ind ingen intet jeg jeres kan kom kommer
    lav lidt lille man mand mange med meget men mens mere mig ned
    ni nogen noget ny nyt nær næste næsten og op otte over på se
    seks ses som stor store syv ti til to tre ud var er
    ' - _ : . ! \\ & ( ) , ’ ? .. a""".split()
)

VOWELS = "aeiouy"
#: Words with a stem of their own, and words that stay as they are after the plural's step.
OWN = dict(
    skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl",
    **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
)
STAY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = dict(
    tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate", alism="al",
    aliti="al", alli="al", fulness="ful", ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", ogi="og", fulli="ful", lessli="less", li="",
)
STEP3 = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="", ative="")
STEP4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")


def _after(w: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel begins, from ``start`` on."""
    for i in range(start + 1, len(w)):
        if w[i] not in VOWELS and w[i - 1] in VOWELS:
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


def _suffix(w: str, among) -> str | None:
    """The longest of ``among`` that ``w`` ends in."""
    return max((s for s in among if w.endswith(s)), key=len, default=None)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    w = word.replace("’", "'")
    if len(w) <= 2:
        return w
    if w in OWN:
        return OWN[w]
    w = w.removeprefix("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS) else c for i, c in enumerate(w))
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _after(w, 0)
    r2 = _after(w, r1)
    if s := _suffix(w, ("'", "'s", "'s'")):
        w = w[: -len(s)]
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in STAY:
        return w
    s = _suffix(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in VOWELS for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if w[-1:] in ("y", "Y") and len(w) > 2 and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    s = _suffix(w, STEP2)
    if s and len(w) - len(s) >= r1:
        before = w[: -len(s)]
        if not (s == "ogi" and not before.endswith("l")) and not (s == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            w = before + STEP2[s]
    s = _suffix(w, STEP3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + STEP3[s]
    s = _suffix(w, STEP4)
    if s and len(w) - len(s) >= r2 and not (s == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(StringType())
def stem_en(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of lower-case words; null for null."""
    for s in words:
        yield s.map(lambda w: None if w is None else stem(w))
