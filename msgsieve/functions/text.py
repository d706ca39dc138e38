"""Text expressions: signals, cleaning, tokens, n-grams, keyword replacement.

Everything here is a ``Column`` built from Spark's own functions, so it runs in
the JVM next to the scan.  Character classes are spelled out because Java's
``\\s``, ``\\d`` and ``\\b`` are ASCII-only while message text is not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

from msgsieve.functions.evaluation import bind

# --- fixed values: character classes and patterns ----------------------------
# Classes are made of properties and single characters: ranges beyond Latin-1
# cost the JVM matcher several times as much.
WS = r"[\p{IsWhite_Space}\x1c\x1d\x1e\x1f]"
NWS = r"[^\p{IsWhite_Space}\x1c\x1d\x1e\x1f]"
# Letters of a host name; ignoring case brings in the two dotted/dotless i,
# the long s and the Kelvin sign.
LETTER = r"a-zA-Z\x{130}\x{131}\x{17f}\x{212a}"
# A host may only start where a run of letters and digits starts or where the
# previous match ended: any later start in the run would fail the same way, and
# skipping those starts keeps long runs without a dot linear.
URL = (
    rf"(?iu)(?:https?://|www\.){NWS}+"
    rf"|(?:\G|(?<![{LETTER}0-9]))[{LETTER}0-9][-{LETTER}0-9]*+\.[{LETTER}]{{2,}}(?:/{NWS}*)?"
)
# Every match of URL contains one of these, and most messages contain none.
URL_HINT = rf"\.[{LETTER}]{{2}}|://|[wW]{{3}}\."
# 0 or +66 with 8-9 digits, 0xx-xxx-xxxx, or a short number 1xxx; the first
# character is matched alone so that the matcher can skip the rest of the text.
PHONE = (
    r"[+01](?:(?<=0)[0-9]{8,9}|(?<=\+)66[0-9]{8,9}"
    r"|(?<=0)[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}|(?<=1)[0-9]{3,4})"
)
NUMBER = r"\p{Nd}+"
NOT_UPPER = r"[^\p{IsUppercase}]++"
NOT_KEPT = r"[^\p{Alnum}\p{InThai}.,!?%]++"
# Characters that are kept, or become kept when lower-cased.
KEPT_RAW = r"[\p{Alnum}\p{InThai}.,!?%\x{130}\x{212a}]"
WORD_CHARS = {
    "compat": r"[\p{L}\p{N}_]+",
    "marks": r"[\p{L}\p{M}\p{N}_]+",
}


def strip(text: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(~text.rlike(NWS), F.lit(True))


def signals(text: Column) -> dict[str, Column]:
    """The seven numeric signals of a raw text; null counts as empty.

    Matches that are many are counted by the length of what a replacement leaves:
    ``regexp_count`` makes a string of every match.
    """
    text = F.coalesce(text, F.lit(""))
    length = F.length(text)
    # the word put in front takes leading white space, so that only marks are left
    words = F.length(F.regexp_replace(F.concat(F.lit("a "), text), rf"{NWS}++{WS}*+", "x")) - 1
    numbers = F.regexp_count(text, F.lit(NUMBER))
    capitals = F.length(F.regexp_replace(text, NOT_UPPER, ""))
    return {
        "text_length": length,
        "word_count": words,
        "url_count": F.when(text.rlike(URL_HINT), F.regexp_count(text, F.lit(URL))).otherwise(F.lit(0)),
        "phone_count": F.regexp_count(text, F.lit(PHONE)),
        "exclamation_count": length - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "number_ratio": numbers / F.greatest(words, F.lit(1)),
        "caps_ratio": capitals / F.greatest(length, F.lit(1)),
    }


def clean(text: Column, keep_signals: bool = True) -> Column:
    """Mark URLs and phones, lower-case, keep Thai, Latin, digits and ``.,!?%``.

    Characters outside the kept set and white space both become one blank, so
    the result is the runs of kept characters joined by blanks.
    """
    text = F.coalesce(text, F.lit(""))
    url_mark, phone_mark = (" URL ", " PHONE ") if keep_signals else (" ", " ")
    marked = F.when(text.rlike(URL_HINT), F.regexp_replace(text, URL, url_mark)).otherwise(text)
    marked = F.regexp_replace(marked, PHONE, phone_mark)
    return F.trim(F.regexp_replace(F.lower(marked), NOT_KEPT, " "))


def has_content(text: Column) -> Column:
    """Whether ``clean(text)`` is not blank, without cleaning.

    Holds as long as URLs and phones leave a mark.
    """
    return F.coalesce(text.rlike(KEPT_RAW), F.lit(False))


# --- tokenisers ---------------------------------------------------------------

Tokenizer = Callable[[Column], Column]


def whitespace_tokenizer(text: Column) -> Column:
    """Split cleaned text, in which blanks are the only white space."""
    return F.split(text, " ")


def callable_tokenizer(build: Callable[[], Callable[[str], Iterable[str]]]) -> Tokenizer:
    """Plug in a Python word segmenter.

    ``build`` runs once per task and returns the segmenting function; rows reach
    it in Arrow batches.
    """

    @F.pandas_udf("array<string>")
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = build()
        for texts in batches:
            yield texts.map(lambda value: list(cut(value or "")))

    # so declared, a filter on the tokens does not run the segmenter again
    return segment.asNondeterministic()


TOKENIZERS: dict[str, Tokenizer] = {"whitespace": whitespace_tokenizer}


def register_tokenizer(name: str, build: Callable[[], Callable[[str], Iterable[str]]]) -> None:
    """Make a Python segmenter available under ``name``."""
    TOKENIZERS[name] = callable_tokenizer(build)


def _tokenizer(tokenizer: str | Tokenizer) -> Tokenizer:
    if callable(tokenizer):
        return tokenizer
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {tokenizer!r}; have {sorted(TOKENIZERS)}")
    return TOKENIZERS[tokenizer]


def tokenize(
    text: Column,
    tokenizer: str | Tokenizer = "whitespace",
    stopwords: Sequence[str] = (),
) -> Column:
    """Tokens of a cleaned text, stripped, without blanks and stop words."""
    tokens = _tokenizer(tokenizer)(text)
    if tokenizer != "whitespace":
        tokens = F.transform(tokens, strip)
    tokens = F.filter(tokens, lambda t: t != "")
    if stopwords:
        # isin over literals becomes a hash-set lookup in the optimizer
        tokens = F.filter(tokens, lambda t: ~t.isin(list(stopwords)))
    return tokens


def process(
    text: Column,
    tokenizer: str | Tokenizer = "whitespace",
    stopwords: Sequence[str] = (),
    keep_signals: bool = True,
) -> Column:
    """Clean, tokenise and join the tokens with blanks."""
    cleaned = clean(text, keep_signals)
    if tokenizer == "whitespace" and not stopwords:
        return cleaned  # splitting at blanks and joining again changes nothing
    return F.array_join(tokenize(cleaned, tokenizer, stopwords), " ")


# --- keyword replacement ------------------------------------------------------


def replace_keywords(text: Column, replacements: Mapping[str, str]) -> Column:
    """Replace whole words, ignoring case, one rule after the other."""
    for word, replacement in replacements.items():
        pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}_])\Q{word}\E(?![\p{{L}}\p{{N}}_])"
        literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
        text = F.regexp_replace(text, pattern, literal)
    return text


# --- vectoriser terms ---------------------------------------------------------


def word_tokens(text: Column, token_mode: str = "compat") -> Column:
    """Lower-cased word tokens, single characters included."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_CHARS[token_mode]), F.lit(0))


def ngrams(tokens: Column, ngram_range: tuple[int, int] = (1, 2)) -> Column:
    """All n-grams of ``ngram_range``, joined by a blank, shorter ones first."""
    low, high = ngram_range

    def grams(t: Column, n: int) -> Column:
        if n == 1:
            return t
        starts = F.greatest(F.size(t) - (n - 1), F.lit(0))
        shifted = [F.slice(t, F.lit(k + 1), starts) for k in range(n)]
        joined = shifted[0]
        for part in shifted[1:]:
            joined = F.zip_with(joined, part, lambda a, b: F.concat(a, F.lit(" "), b))
        return joined

    return bind(tokens, lambda t: F.concat(*[grams(t, n) for n in range(low, high + 1)]))


def term_counts(terms: Column) -> Column:
    """``array<struct<term, tf>>`` of an array of terms, in term order.

    Equal terms stand next to each other after sorting, so run lengths give the
    counts inside the row; no shuffle on (document, term) is needed.
    """

    def runs(s: Column) -> Column:
        n = F.size(s)
        positions = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(
            positions, lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2))
        )
        return bind(
            starts,
            lambda st: F.transform(
                st,
                lambda at, k: F.struct(
                    F.get(s, at - 1).alias("term"),
                    (F.coalesce(F.get(st, k + 1), n + 1) - at).alias("tf"),
                ),
            ),
        )

    return bind(F.sort_array(terms), runs)
