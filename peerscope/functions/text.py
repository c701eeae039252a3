"""Text normalisation as pure Column expressions (JVM side, no Python UDF).

``normalize_text`` reproduces the cleaning of the recommender: lowercase,
keep only ASCII letters and whitespace, split the six contractions a
Treebank-style word tokenizer splits on such text, split on whitespace,
drop stop words and (for submissions) one-letter tokens, join by a space.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
# English stop words: the classic NLTK list without the entries that hold an
# apostrophe (those can never match after cleaning), in the list's order.
STOP_WORDS: tuple[str, ...] = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above
below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor
not only own same so than too very s t can will just don should now d ll m o re
ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan
shouldn wasn weren won wouldn
""".split())

# Contractions the word tokenizer splits on letters-only text:
# (word, left part, right part).
CONTRACTIONS: tuple[tuple[str, str, str], ...] = (
    ("cannot", "can", "not"),
    ("gimme", "gim", "me"),
    ("gonna", "gon", "na"),
    ("gotta", "got", "ta"),
    ("lemme", "lem", "me"),
    ("wanna", "wan", "na"),
)

# Characters Python's str.split() and regex \s treat as whitespace, as a Java
# character-class body: Java's \s, the Unicode White_Space property and the
# four information separators 0x1C-0x1F.
WHITESPACE_CLASS = r"\s\p{IsWhite_Space}\x1c-\x1f"
# ---------------------------------------------------------------------------

_NON_LETTER = rf"[^a-zA-Z{WHITESPACE_CLASS}]"
_SPLIT = rf"[{WHITESPACE_CLASS}]+"
_NON_BLANK = rf"[^{WHITESPACE_CLASS}]"


def _contraction_pattern() -> tuple[str, str]:
    """One regex with a group pair per contraction.

    Groups that did not take part in the match expand to nothing in Java's
    replacement, so a single pass splits whichever word matched.
    """
    alternatives = "|".join(rf"\b({left})({right})\b" for _, left, right in CONTRACTIONS)
    lefts = "".join(f"${2 * i + 1}" for i in range(len(CONTRACTIONS)))
    rights = "".join(f"${2 * i + 2}" for i in range(len(CONTRACTIONS)))
    return alternatives, f"{lefts} {rights}"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(text: Column | str) -> Column:
    """True for NULL or text without a non-whitespace character (Unicode aware)."""
    t = as_column(text)
    return t.isNull() | ~t.rlike(_NON_BLANK)


def clean_letters(text: Column | str) -> Column:
    """Lowercase, then delete every character that is neither a letter a-z nor whitespace.

    Deleting (not replacing by a space) glues ``don't`` to ``dont``.
    NULL becomes the empty string.
    """
    t = F.lower(F.coalesce(as_column(text), F.lit("")))
    return F.regexp_replace(t, _NON_LETTER, "")


def split_contractions(text: Column | str) -> Column:
    pattern, replacement = _contraction_pattern()
    return F.regexp_replace(as_column(text), pattern, replacement)


def word_tokens(text: Column | str, stop_words: Sequence[str] = STOP_WORDS,
                min_token_len: int = 1) -> Column:
    """array<string> of cleaned tokens in text order, duplicates kept."""
    cleaned = split_contractions(clean_letters(text))
    tokens = F.split(cleaned, _SPLIT)
    stop = list(stop_words)
    min_len = max(int(min_token_len), 1)

    def keep(x: Column) -> Column:
        cond = F.length(x) >= min_len
        if stop:
            cond = cond & ~x.isin(stop)
        return cond

    return F.filter(tokens, keep)


def normalize_text(text: Column | str, stop_words: Sequence[str] = STOP_WORDS,
                   min_token_len: int = 1) -> Column:
    """Processed text: tokens joined by one space; '' when nothing is left.

    ``min_token_len=1`` is the corpus version, ``2`` the submission version
    (one-letter tokens dropped).
    """
    return F.array_join(word_tokens(text, stop_words, min_token_len), " ")


def model_tokens(processed_text: Column | str) -> Column:
    """Tokens the TF-IDF model sees: words of at least two characters.

    The input is processed text (letters separated by single spaces), on
    which the ``\\b\\w\\w+\\b`` token pattern equals a split plus a length filter.
    """
    return F.filter(F.split(as_column(processed_text), " "), lambda x: F.length(x) >= 2)


def with_bigrams(words: Column | str) -> Column:
    """Unigrams followed by the bigrams of adjacent words, joined by a space."""
    w = as_column(words)
    n = F.size(w)
    heads = F.slice(w, 1, F.greatest(n - 1, F.lit(0)))
    bigrams = F.transform(heads, lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
    return F.concat(w, bigrams)


def text_prefix(text: Column | str, length: int = 2000) -> Column:
    """First ``length`` characters, lowercased (name search window)."""
    return F.lower(F.substring(F.coalesce(as_column(text), F.lit("")), 1, length))


def keep_rows(df, column: str, predicate):
    """Rows of ``df`` where ``predicate(col(column))`` holds, evaluating the column once.

    A plain ``where`` on a computed column is pushed below the projection
    that computes it, and the (regex-heavy) expression is then evaluated
    twice. A one-element ``explode`` cannot have filters pushed into it, and
    Spark only infers generator filters for bare attributes.
    """
    marker = "_keep_" + column
    kept = df.select("*", F.explode(F.filter(F.array(F.col(column)), predicate)).alias(marker))
    return kept.drop(marker)
