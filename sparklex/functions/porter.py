"""Porter's stemming algorithm, with his later revisions (-bli, -logi)."""

from __future__ import annotations

import re

_V = "(?:[aeiou]|(?<=[^aeiou])y)"
_PAIRS2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_PAIRS3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_ENDS4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c or v for each letter; y is a consonant at the start and after a vowel."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, pairs: dict[str, str]) -> str:
    end = max((e for e in pairs if word.endswith(e)), key=len, default=None)
    if end and _measure(word[: -len(end)]) > 0:
        return word[: -len(end)] + pairs[end]
    return word


def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        end = next((e for e in ("ed", "ing") if word.endswith(e)), None)
        if end and "v" in _shape(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word):
                word = word if word[-1] in "lsz" else word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _PAIRS2), _PAIRS3)
    end = max((e for e in _ENDS4 if word.endswith(e)), key=len, default=None)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def simple_tokens(text: str, lowercase: bool = True, remove_stopwords: bool = False, stemming: bool = False, min_token_len: int = 1) -> list[str]:
    """ASCII word runs of one string: length filter (bytes), stopwords, then stems, not filtered again.

    Text ends at a NUL.
    """
    from sparklex.functions.tokenize import ENGLISH_STOPWORDS

    tokens = re.findall("[0-9A-Za-z_]+", (text or "").split("\0")[0])
    tokens = [t.lower() for t in tokens] if lowercase else tokens
    tokens = [t for t in tokens if len(t) >= min_token_len and not (remove_stopwords and t in ENGLISH_STOPWORDS)]
    return [stem(t) for t in tokens] if stemming else tokens


def is_stopword(word: str) -> bool:
    from sparklex.functions.tokenize import ENGLISH_STOPWORDS

    return word in ENGLISH_STOPWORDS
