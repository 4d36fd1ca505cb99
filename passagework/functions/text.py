"""Text functions as column expressions, shared by indexing, retrieval and metrics."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the analyser's stop words, punctuation and ideograph ranges
STOP_WORDS = ("a", "an", "the", "of", "and", "or", "is", "are", "was", "were", "to", "in", "on", "for")
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CJK_PUNCTUATION = "，。！？；：、“”‘’（）《》【】…—　"
CJK = "一-鿿㐀-䶿"

_PUNCTUATION = "[" + "".join("\\" + c for c in ASCII_PUNCTUATION) + CJK_PUNCTUATION + "]"
_TOKEN = f"[{CJK}]|[a-zA-Z]+|[0-9]+"
_SENTENCE = "[^。！？!?\n]+[。！？!?]?"
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def _unstable() -> str:
    """Matches a character outside the blocks below in which NFKC changes nothing, whatever stands beside it."""
    blocks = ((0x0, 0x300), (0x2010, 0x2060), (0x3000, 0x3040), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4))
    stable = lambda c: unicodedata.is_normalized("NFKC", chr(c)) and not unicodedata.combining(chr(c))
    kept = []
    for first, stop in blocks:
        for same, run in itertools.groupby(range(first, stop), stable):
            run = list(run)
            if same:
                kept.append(f"\\x{{{run[0]:x}}}-\\x{{{run[-1]:x}}}")
    return f"[^{''.join(kept)}]"


_UNSTABLE = _unstable()
#: Matches a character beyond U+00FF, or one up to it that NFKC changes. Single characters are a lookup in the regex engine, each range of _UNSTABLE a comparison.
_UNUSUAL = f"[^{''.join(f'\\x{{{c:x}}}' for c in range(0x100) if unicodedata.is_normalized('NFKC', chr(c)))}]"


def half_width(text: Column) -> Column:
    """Full-width forms as ASCII; texts without any, nearly all, skip the translation, which handles one character at a time."""
    return F.when(text.rlike("[\uff01-\uff5e\u3000]"), F.translate(text, _FULL, _HALF)).otherwise(text)


def nfkc(text: Column) -> Column:
    """Unicode NFKC, which Spark has no function for: full-width forms are translated, and only texts that hold other characters it could change are sent to Python."""

    @F.pandas_udf("string")
    def composed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    plain = half_width(text)
    return F.coalesce(composed(F.when(plain.rlike(_UNUSUAL) & plain.rlike(_UNSTABLE), text)), plain)


def nfkc_each(texts: Column) -> Column:
    """A list's strings in NFKC, null as empty; lambdas can't hold the Python step, so it is done on the list as one text."""
    whole = F.array_join(F.transform(texts, lambda t: F.replace(F.coalesce(t, F.lit("")), F.lit("\x1e"), F.lit(" "))), "\x1e")
    return F.when(F.size(texts) == 0, texts).otherwise(F.split(nfkc(whole), "\x1e"))


def strip(text: Column) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _folded(text: Column, exact: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.lower(nfkc(text) if exact else half_width(text))


def normalize(text: Column, exact: bool = True) -> Column:
    """NFKC, lower case without punctuation, single spaces. Without exact only full-width forms become ASCII, and no row meets Python."""
    return F.trim(F.regexp_replace(F.regexp_replace(_folded(text, exact), _PUNCTUATION, " "), r"(?U)\s+", " "))


def tokens(text: Column, drop_stop_words: bool = False, exact: bool = True) -> Column:
    """One ideograph, a run of ASCII letters or of ASCII digits; anything else separates, so punctuation needn't be replaced first."""
    found = F.regexp_extract_all(_folded(text, exact), F.lit(_TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS)) if drop_stop_words else found


def index_tokens(text: Column, exact: bool = True) -> Column:
    """Tokens without stop words, then the pairs of neighbours in that list that are both ideographs."""
    found = tokens(text, True, exact)
    ideograph = lambda t: t.rlike(f"^[{CJK}]$")
    pairs = F.zip_with(found, F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), lambda a, b: F.when(ideograph(a) & ideograph(b), F.concat(a, b)))
    # texts without ideographs, most of them, skip the pairs
    return F.when(text.rlike(f"[{CJK}]"), F.concat(found, F.filter(pairs, lambda p: p.isNotNull()))).otherwise(found)


_TOKENS = re.compile(_TOKEN)
_IDEOGRAPH = re.compile(f"[{CJK}]")
#: UTF-8 bytes with blanks for all but ASCII letters, and for all but digits.
_LETTERS, _DIGITS = (bytes(c if c < 128 and getattr(chr(c), kind)() else 32 for c in range(256)) for kind in ("isalpha", "isdigit"))
#: Punctuation, and white space by Java's (?U)\\s, which Python's \\s isn't the same as.
_DROPPED = re.compile(_PUNCTUATION[:-1] + "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def folded(text: str) -> str:
    """NFKC in lower case, of one text in a task."""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def term_counts(text: str, lowered: str) -> tuple[Counter, int]:
    """How often each of index_tokens() is in a text, which is given folded too, and how many there are."""
    if lowered.isascii() or not _IDEOGRAPH.search(lowered):
        # runs of letters and of digits; their order says nothing here
        coded = lowered.encode()
        found = coded.translate(_LETTERS).decode().split() + coded.translate(_DIGITS).decode().split()
    else:
        found = _TOKENS.findall(lowered)
    counts = Counter(found)
    n = len(found) - sum(counts.pop(w, 0) for w in STOP_WORDS)
    if not text.isascii() and _IDEOGRAPH.search(text):
        kept = [t for t in found if t not in STOP_WORDS]
        pairs = [a + b for a, b in itertools.pairwise(kept) if _IDEOGRAPH.match(a) and _IDEOGRAPH.match(b)]
        counts.update(pairs)
        n += len(pairs)
    return counts, n


def squeezed(lowered: str) -> str:
    """normalize() without spaces, of a text that is given folded."""
    return _DROPPED.sub("", lowered)


def ngram_counts(lowered: str, n: int = 3) -> Counter:
    """How often each of char_ngrams() is in a text that is given folded."""
    s = squeezed(lowered)
    return Counter([s[i : i + n] for i in range(len(s) - n + 1)] if len(s) >= n else [s] if s else [])


def char_ngrams(text: Column, n: int = 3, exact: bool = True) -> Column:
    """Code-point windows of the normalised text without spaces; a shorter text is one window, an empty one none."""
    s = F.replace(normalize(text, exact), F.lit(" "), F.lit(""))
    # a look-ahead finds overlapping windows in one pass; a substring for each would begin to count at the text's start
    windows = lambda x: F.when(F.length(x) < n, F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    # as a list of one the text is computed once, and outside of the lambda
    return F.flatten(F.transform(F.filter(F.array(s), lambda x: x != ""), windows))


def once(value: Column) -> Column:
    """A generator that keeps a costly value from being computed again in each use of its column."""
    return F.explode(F.array(value))


def sentences(text: Column) -> Column:
    """Runs up to an ideographic stop, ! or ?, or a line's end; an ASCII full stop ends none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_SENTENCE), F.lit(0))


def citation_numbers(text: Column) -> Column:
    """Distinct numbers in [1][2] marks, in the order of first occurrence."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))
