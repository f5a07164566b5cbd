"""Tokenizers as column expressions: text column in, array<string> column out.

Everything but user callables stays in the JVM.  Null texts have no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

ENGLISH_STOPWORDS = frozenset(
    """a i be he me we if of am an in on do no so to up or as is at it by my i'd had did and she the are off all i'm him own who too
    her for nor our has was his its get got not but out you few how why any he'd we'd once same some here were more i've have each
    such with both i'll will them whom from than been then when down into over your he's it's does this hers ours that what most
    they only very she'd you'd could would while we're there where these those we've above being doing which until he'll we'll
    again under other after their she's who's let's how's why's yours can't don't won't isn't ought about below they'd should
    you're before you've itself myself during having she'll you'll here's when's that's what's theirs shan't hadn't didn't aren't
    hasn't wasn't cannot they're because they've himself herself through they'll between further there's where's weren't haven't
    doesn't mustn't against yourself couldn't wouldn't ourselves shouldn't themselves yourselves""".split()
)

CORE_PATTERN = "[0-9A-Za-z_]+"
WORD_PATTERN = r"[\p{L}\p{N}_]+"
SPACE_PATTERN = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Patterns as they are handed to Java, where it reads another form of the same class faster: the first class of a union is
#: tried first, and nearly all characters of words are in it.
IN_JAVA = {SPACE_PATTERN: f"[[!-~]{SPACE_PATTERN[:-1]}]+"}
MODES = {"regex": CORE_PATTERN, "unicode_word": WORD_PATTERN, "whitespace": SPACE_PATTERN}

Expression = Callable[[Column], Column]


def extract(pattern: str, group: int = 0) -> Expression:
    pattern = IN_JAVA.get(pattern, pattern)
    return lambda text: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def core_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and ``_``, lower-cased after they are cut out."""
    return F.transform(extract(CORE_PATTERN)(text), F.lower)


def cased_tokens(text: Column) -> Column:
    return extract(CORE_PATTERN)(text)


def core_case(tokenize: Any) -> bool | None:
    """Whether a tokenizer that cuts at CORE_PATTERN and does nothing else lower-cases its tokens; None for all others."""
    if isinstance(tokenize, Analyzer) and tokenize.base is None:
        return tokenize.lowercase
    return tokenize is core_tokens if tokenize in (core_tokens, cased_tokens) else None


def host_tokens(tokenize: Any, text: str) -> list[str] | None:
    """Tokens of one string on the driver, where that is sure to equal what Spark makes of it; else None."""
    lowercase = core_case(tokenize)
    if lowercase is None:
        return None
    found = re.findall(CORE_PATTERN, text)
    return [t.lower() for t in found] if lowercase else found


def casefold(token: Column) -> Column:
    """Lower case with sharp s written out, as full case folding does.

    Other letters whose folding differs from their lower case (ligatures, Greek final
    sigma and the like) need ``exact_casefold``.
    """
    return F.replace(F.lower(token), F.lit("ß"), F.lit("ss"))


def exact_casefold(tokens: Column) -> Column:
    """Full Unicode case folding of an array of tokens; each distinct token of an Arrow batch is folded once."""

    @F.arrow_udf("array<string>")
    def folded(lists: pa.Array) -> pa.Array:
        return each_distinct(lists, str.casefold)

    return folded(tokens)


def stopword_set(stopwords: Any = None, extra: Iterable[str] | None = None, lowercase: bool = True) -> frozenset[str]:
    """``True`` or "english": the built-in words; a sequence: those; nothing: none."""
    if isinstance(stopwords, str) and stopwords != "english":
        raise ValueError(f"unknown stopwords {stopwords!r}; 'english' is built in")
    if isinstance(extra, str):
        raise TypeError("extra_stopwords is a sequence of strings")
    base = ENGLISH_STOPWORDS if stopwords is True or stopwords == "english" else stopwords or ()
    words = [*base, *(extra or ())]
    if not all(isinstance(w, str) for w in words):
        raise TypeError("stopwords are strings")
    return frozenset(w.casefold() if lowercase else w for w in words)


def checked_tokens(tokens: Any) -> list[str]:
    """What a tokenizer callable returned, as a list of strings."""
    if isinstance(tokens, str):
        raise TypeError("a tokenizer returns a sequence of tokens, not one string")
    out = list(tokens)
    if not all(isinstance(t, str) for t in out):
        raise TypeError("a tokenizer returns strings")
    return out


#: Bytes of text that are Python objects at once; an Arrow batch can hold 10,000 texts of any length.
SLICE = 1 << 20


def slices(sizes: pa.Array, most: int) -> Iterator[slice]:
    """Runs of rows whose sizes (null: 0) add up to ``most`` or less; a larger row is alone."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


#: Bytes of text that ``core_words`` cuts at once.
PIECE = 1 << 22


def core_words(texts: pa.Array, lowercase: bool = True, most: int = PIECE) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """``core_tokens`` (or ``cased_tokens``) of texts: (tokens of some bytes of them, where each row's tokens start and end in that).

    Words of CORE_PATTERN are ASCII, so they are found in the bytes of UTF-8.  A null text
    has no tokens.  About ``most`` bytes are cut at once; a token is never cut in two.
    """
    kept = np.zeros(256, np.uint8)  # what becomes of a byte, 0: no part of a word
    for byte in re.findall("[0-9A-Za-z_]", bytes(range(128)).decode()):
        kept[ord(byte)] = ord(byte.lower() if lowercase else byte)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    low = 0
    while low < len(flat):
        high = min(low + most, len(flat))
        while high < len(flat) and kept[flat[high - 1]]:  # on to the end of the word, or of the text
            text_end = int(ends[np.searchsorted(ends, high)])
            rest = flat[high : min(text_end, high + most)]
            stop = np.flatnonzero(kept[rest] == 0)
            high += int(stop[0]) if len(stop) else len(rest)
            if len(stop) or high == text_end:
                break
        letters = kept[flat[low:high]]
        word = letters != 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cuts = ends[np.searchsorted(ends, low, "right") : np.searchsorted(ends, high)] - low  # where texts meet
        first[cuts], last[cuts - 1] = word[cuts], word[cuts - 1]
        starts = np.flatnonzero(first)
        lengths = np.flatnonzero(last) + 1 - starts
        tokens = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, np.cumsum(lengths))), pa.py_buffer(letters[word]))
        yield tokens, np.searchsorted(starts, ends - low)
        low = high


def each_distinct(lists: pa.Array, function: Callable[[str], str]) -> pa.Array:
    """Lists of strings with ``function`` of every string; each distinct string is handed over once, and only those are Python objects."""
    flat = lists.flatten().dictionary_encode()
    words = [function(t) for t in flat.dictionary.to_pylist()]
    if not all(isinstance(w, str) for w in words):
        raise TypeError("a function of tokens, such as a stemmer, returns a string")
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(words, pa.string()).take(flat.indices), mask=lists.is_null())


def tokenized(texts: pa.Array, function: Callable[[str], Iterable[str]], most: int = SLICE) -> pa.Array:
    """Tokens of texts by a Python function; those of ``most`` bytes of text, or of one longer text, are Python objects at once."""
    kind = pa.list_(pa.string())
    made = [pa.array([checked_tokens(function(t or "")) for t in texts[rows].to_pylist()], kind) for rows in slices(pc.binary_length(texts), most)]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def callable_tokens(function: Callable[[str], Iterable[str]]) -> Expression:
    """A Python tokenizer as an Arrow UDF."""

    @F.arrow_udf("array<string>")
    def tokens(texts: pa.Array) -> pa.Array:
        return tokenized(texts, function)

    return lambda text: tokens(text)


def stemmed(function: Callable[[str], str]) -> Expression:
    """An array<string> column with every token passed through a Python stemmer; a null array is empty.

    Each distinct token of an Arrow batch is stemmed once.
    """

    @F.arrow_udf("array<string>")
    def stems(tokens: pa.Array) -> pa.Array:
        return each_distinct(tokens, function)

    return lambda tokens: stems(F.coalesce(tokens, F.array().cast("array<string>")))


@dataclass(frozen=True, init=False)
class Tokenizer:
    """Splits by ``mode``, then folds case, drops short tokens and stopwords, and stems.

    Modes: ``regex`` (``pattern``, in Java's dialect; with one group, that group),
    ``unicode_word`` and ``whitespace``.  Stemmed tokens are folded and filtered again.
    ``exact_folding`` folds case by full Unicode rules, in Python; else by ``casefold``.

    Called with a column it gives an expression; with a string, the list of its tokens.
    """

    mode: str
    pattern: str
    lowercase: bool
    stopwords: frozenset[str]
    stemmer: Callable[[str], str] | None
    min_token_len: int
    exact_folding: bool

    def __init__(self, mode: str = "regex", *, pattern: str | None = None, lowercase: bool = True, stopwords: Any = None, extra_stopwords: Iterable[str] | None = None, stemmer: Callable[[str], str] | None = None, min_token_len: int = 1, exact_folding: bool = False):
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
        if pattern is not None and mode != "regex":
            raise ValueError("only mode 'regex' takes a pattern")
        if min_token_len < 1:
            raise ValueError("min_token_len is 1 at least")
        if stemmer is not None and not callable(stemmer):
            raise TypeError("stemmer is not callable")
        made = {"mode": mode, "pattern": pattern or MODES[mode], "lowercase": lowercase, "stopwords": stopword_set(stopwords, extra_stopwords, lowercase), "stemmer": stemmer, "min_token_len": min_token_len, "exact_folding": exact_folding}
        for name, value in made.items():
            object.__setattr__(self, name, value)

    def _group(self) -> int:
        groups = re.compile(self.pattern).groups if self.mode == "regex" else 0
        if groups > 1:
            raise TypeError("a pattern of several groups doesn't give strings")
        return groups

    def split(self, text: Column) -> Column:
        return extract(self.pattern, self._group())(text)

    def tokenize(self, text: str) -> list[str]:
        """Tokens of one string, on the driver.

        Patterns are read in Python's dialect here.
        """
        if not isinstance(text, str):
            raise TypeError("a text is a string")
        if self.mode == "whitespace":
            tokens = text.split()
        elif self.mode == "unicode_word":
            tokens = re.findall(r"\w+", text)  # in Python, \w is the letters and numbers of all scripts, and _
        else:
            self._group()
            tokens = re.findall(self.pattern, text)
        tokens = self._kept(tokens)
        return self._kept(checked_tokens(map(self.stemmer, tokens))) if self.stemmer else tokens

    def _kept(self, tokens: list[str]) -> list[str]:
        if self.lowercase:
            tokens = [t.casefold() if self.exact_folding else t.lower().replace("ß", "ss") for t in tokens]
        return [t for t in tokens if len(t) >= self.min_token_len and t not in self.stopwords]

    def process(self, tokens: Column) -> Column:
        """Case folding, filters and stemming of an array column."""
        tokens = self._filtered(tokens)
        return self._filtered(stemmed(self.stemmer)(tokens)) if self.stemmer else tokens

    def _filtered(self, tokens: Column) -> Column:
        if self.lowercase:
            tokens = exact_casefold(tokens) if self.exact_folding else F.transform(tokens, casefold)
        words = F.array(*map(F.lit, sorted(self.stopwords))) if self.stopwords else None

        def keep(t: Column) -> Column:
            fine = F.length(t) >= self.min_token_len
            return fine if words is None else fine & ~F.array_contains(words, t)

        return F.filter(tokens, keep)

    def __call__(self, text: Any) -> Any:
        return self.tokenize(text) if isinstance(text, str) else self.process(self.split(text))

    def to_state(self) -> dict[str, Any]:
        if self.stemmer is not None:
            raise TypeError("a callable stemmer can't be saved")
        return {"mode": self.mode, "pattern": self.pattern if self.mode == "regex" else None, "lowercase": self.lowercase, "stopwords": sorted(self.stopwords), "min_token_len": self.min_token_len, "exact_folding": self.exact_folding}

    @classmethod
    def from_state(cls, state: dict[str, Any]) -> Tokenizer:
        return cls(**state)

    def __repr__(self) -> str:
        return f"Tokenizer(mode={self.mode!r}, lowercase={self.lowercase}, stopwords={len(self.stopwords)}, stemmer={self.stemmer is not None})"


@dataclass(frozen=True)
class Analyzer:
    """The whole way from text to terms: a base tokenizer, then a second pass with a model's own settings."""

    base: Any = None  # None: core_tokens; else a Tokenizer or a callable
    post: Tokenizer | None = None
    lowercase: bool = True

    @classmethod
    def of(cls, tokenizer: Any = None, lowercase: bool = True, stopwords: Any = None, extra_stopwords: Iterable[str] | None = None, stemmer: Callable[[str], str] | None = None) -> Analyzer:
        """Settings left out keep to the JVM core tokenizer."""
        own = {"lowercase": lowercase, "stopwords": stopwords, "extra_stopwords": extra_stopwords, "stemmer": stemmer}
        if tokenizer is None:
            plain = stopwords in (None, False) and extra_stopwords is None and stemmer is None
            return cls(lowercase=lowercase) if plain else cls(Tokenizer(**own), None, lowercase)
        if isinstance(tokenizer, str):
            tokenizer = Tokenizer(tokenizer, lowercase=False)
        elif not callable(tokenizer):
            raise TypeError("tokenizer is None, a mode's name, a Tokenizer or a callable")
        return cls(tokenizer, Tokenizer(**own), lowercase)

    def __call__(self, text: Column) -> Column:
        if self.base is None:
            return core_tokens(text) if self.lowercase else cased_tokens(text)
        tokens = self.base(text) if isinstance(self.base, Tokenizer) else callable_tokens(self.base)(text)
        return self.post.process(tokens) if self.post else tokens

    def to_state(self) -> dict[str, Any]:
        if self.base is not None and not isinstance(self.base, Tokenizer):
            raise TypeError("a callable tokenizer can't be saved")
        return {"base": self.base and self.base.to_state(), "post": self.post and self.post.to_state(), "lowercase": self.lowercase}

    @classmethod
    def from_state(cls, state: dict[str, Any]) -> Analyzer:
        base, post = (state[x] and Tokenizer.from_state(state[x]) for x in ("base", "post"))
        return cls(base, post, state["lowercase"])
