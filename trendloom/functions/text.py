"""Column expressions for text: cleaning, tokenizing, n-grams, phrases.

All are built-in Spark SQL expressions (regexp_replace, regexp_extract_all,
higher-order functions), so they run inside whole-stage codegen; no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the cleaning and token patterns.
# clean: a URL up to the end of its line, or any run of characters other than
#        ASCII letters, digits, '#' and '@', becomes one space.
# token: the public tweet tokenizer's rules as far as they can match cleaned,
#        lower-case text, in its order: phone numbers, emoticons with the eyes
#        '8', handles, hashtags (#+ then at least two word chars), words of
#        three or more letters (which end before a digit), other words, and a
#        bare '#' or '@'.
# hang:  four or more equal signs in a row become three before tokenizing.
CLEAN_PATTERN = r"https?://[^\n]*[\r\n]*|[^0-9a-zA-Z#@]+"
TOKEN_PATTERN = (r"(?:[01] *)?(?:[0-9]{3} *)?[0-9]{3} *[0-9]{4}|8o?[dp@]|[dp@]o?8|@\w+|#+\w\w+"
                 r"|[a-z]{3,}|\w+|[#@]")
HANG_PATTERN, HANG_THREE = "(###)#+|(@@@)@+", "$1$2"
WORD_CLEAN_PATTERN = r"[^0-9a-zA-Z#@]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col, url_mode: str = "line") -> Column:
    """X1. ``url_mode='line'`` drops a URL and the rest of its line (the
    reference behaviour); ``'token'`` drops only the URL itself."""
    col = _c(col)
    if url_mode == "line":
        return F.regexp_replace(col, CLEAN_PATTERN, " ")
    if url_mode == "token":
        return F.regexp_replace(F.regexp_replace(col, r"https?://\S*", " "),
                                WORD_CLEAN_PATTERN, " ")
    raise ValueError(f"unknown url_mode {url_mode!r}")


def tokenize(col) -> Column:
    """X2. Lower-case, then all token matches in order (array<string>).  Each step
    names the one before once, so the text is cleaned once however it is used."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(_c(col)), HANG_PATTERN, HANG_THREE), F.lit(TOKEN_PATTERN), 0)


def clean_tokens(col, url_mode: str = "line") -> Column:
    """clean_text then tokenize: the term sequence of a text."""
    return tokenize(clean_text(col, url_mode))


def ngrams(tokens, n: int) -> Column:
    """X3. The n-grams of a token array joined by one space, in order.

    ``tokens`` should be a column reference (project the tokens first):
    Catalyst does not share subexpressions inside lambdas, so passing the
    tokenizer expression itself would re-run it for every gram position.

    ``sequence(0, k)`` with a negative k counts down, so arrays shorter than
    n are guarded to give an empty list.
    """
    tokens = _c(tokens)
    if n == 1:
        return F.coalesce(tokens, F.array().cast("array<string>"))
    # gram i = tokens[i] + ' ' + ... + tokens[i+n-1]: zip n shifted slices of
    # equal length (size - n + 1); no per-gram array is built.
    k = F.size(tokens) - n + 1
    grams = F.slice(tokens, 1, k)
    for j in range(1, n):
        grams = F.zip_with(grams, F.slice(tokens, j + 1, k), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngrams_range(tokens, min_n: int = 1, max_n: int = 3) -> Column:
    """All 1..max_n grams of a token array, concatenated."""
    parts = [ngrams(tokens, n) for n in range(min_n, max_n + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def phrase_terms(col) -> Column:
    """A tracked phrase as its distinct terms, tokenized the same way as the
    texts it is matched against."""
    return F.array_distinct(clean_tokens(F.trim(_c(col))))
