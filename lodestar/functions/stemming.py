"""Search tokens with English stemming: the Porter2 algorithm as published, over Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import ENGLISH_STOP, search_text

#: Texts whose words are in memory as objects at once.
TEXTS_AT_ONCE = 500
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Words with stems of their own.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    def after(start: int) -> int:
        m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, start)
        return m.end() if m else len(word)

    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = after(0) if first is None else first
    return r1, after(r1)


def short_syllable(word: str) -> bool:
    return bool(re.search(f"(?:[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])$", word))


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word; words with other letters than a to z stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    if word in UNCHANGED:
        return word
    word = re.sub(f"^y|(?<=[{VOWELS}])y", "Y", word.removeprefix("'"))
    r1, r2 = regions(word)
    for ending in ("'s'", "'s", "'"):
        if word.endswith(ending):
            word = word[: -len(ending)]
            break
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{VOWELS}].", word[:-1]):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word
    if word.endswith(("eed", "eedly")):
        cut = 3 if word.endswith("eed") else 5
        if len(word) - cut >= r1:
            word = word[:-cut] + "ee"
    else:
        m = re.search("(ingly|edly|ing|ed)$", word)
        if m and re.search(f"[{VOWELS}]", word[: m.start()]):
            word = word[: m.start()]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(DOUBLES):
                word = word[:-1]
            elif r1 >= len(word) and short_syllable(word):
                word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    for ending, new in STEP2.items():
        if word.endswith(ending):
            if len(word) - len(ending) >= r1:
                word = word[: -len(ending)] + new
            break
    else:
        if word.endswith("ogi") and len(word) - 3 >= r1 and word[-4:-3] == "l":
            word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in tuple("cdeghkmnrt"):
            word = word[:-2]
    for ending, new in STEP3.items():
        if word.endswith(ending):
            if len(word) - len(ending) >= r1:
                word = word[: -len(ending)] + new
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]
    for ending in STEP4:
        if word.endswith(ending):
            if len(word) - len(ending) >= r2:
                word = word[: -len(ending)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
            word = word[:-3]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not short_syllable(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def _tokens_at_once(texts: pa.Array) -> pa.Array:
    stop = frozenset(ENGLISH_STOP)
    return pa.array([[stem(w) for w in re.findall(r"[^\W_]+", (t.as_py() or "").lower()) if w not in stop] for t in texts], pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stems(texts: pa.Array) -> pa.Array:
    """Made for a few texts at a time: of all others only Arrow's bytes are in memory, no words as objects."""
    parts = [_tokens_at_once(texts.slice(at, TEXTS_AT_ONCE)) for at in range(0, len(texts), TEXTS_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def stemmed(text: Column) -> Column:
    """Search tokens in order, stemmed, without stop words."""
    return _stems(search_text(text))
