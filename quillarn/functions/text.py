"""Text normalisers as column expressions. All give null for null."""
from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 32 ASCII punctuation characters, and a class of all punctuation, these among it.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PUNCTUATION = r"\p{P}$+<=>^`|~"
SPACES = r"\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}"


def fold(x: Column) -> Column:
    """Lower case that also joins what upper case joins: ß with ss, final with other sigma."""
    return F.replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def bare(x: Column) -> Column:
    """Folded, without punctuation and white space; accents and other symbols stay."""
    return F.regexp_replace(fold(x), f"[{PUNCTUATION}{SPACES}]+", "")


def name_key(x: Column) -> Column:
    """Folded, without underscores and blanks; null for what is blank then."""
    return F.nullif(F.regexp_replace(fold(x), f"[_{SPACES}]+", ""), F.lit(""))


def _squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, f"[{SPACES}]+", " "))


def _plain(x: Column) -> Column:
    """Without ASCII punctuation and English articles, single blanks."""
    return _squeeze(F.regexp_replace(F.translate(x, ASCII_PUNCTUATION, ""), r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "))


def answer_text(x: Column) -> Column:
    """The form answers are scored in: lower case, no ASCII punctuation, no English articles, single blanks."""
    return _plain(F.lower(x))


def _fold_all(texts: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(texts)
    folded = [unicodedata.normalize("NFKC", t).casefold() for t in distinct]
    return pd.Series([folded[c] if c >= 0 else None for c in codes], dtype=object)


def nfkc_casefold(x: Column) -> Column:
    """NFKC, then full case folding. Only texts beyond ASCII go to Python, as Arrow batches; for ASCII it is lower case."""
    fold_all = F.pandas_udf(_fold_all, T.StringType())
    return F.coalesce(fold_all(F.when(x.rlike(r"[^\x00-\x7f]"), x)), F.lower(x))


def first_line_answer(x: Column) -> Column:
    """The answer in a generated text: its first line, up to a following question and without closing semicolons."""
    line = F.split(F.trim(F.regexp_replace(x, f"^[{SPACES}]+|[{SPACES}]+$", "")), r"[\n\r]")[0]
    cut = F.regexp_replace(line, r"(?is)\s*[;,:-]?\s*question\s*:.*$", "")
    return F.regexp_replace(cut, f"[;{SPACES}]+$", "")


def before_question(x: Column) -> Column:
    """The first line, or all that stands before a line that begins a question."""
    return F.trim(F.when(F.contains(x, F.lit("\nQuestion:")), F.substring_index(x, "\nQuestion:", 1)).otherwise(F.substring_index(x, "\n", 1)))


def decoder_answer(x: Column) -> Column:
    """The first line of what stands before a following question, which may also follow a semicolon."""
    cut = F.regexp_replace(F.regexp_replace(x, f"^[{SPACES}]+|[{SPACES}]+$", ""), r"(?is)(?:^|\n|;\s*)question\s*:.*$", "")
    line = F.split(F.regexp_replace(cut, f"^[{SPACES}]+|[{SPACES}]+$", ""), r"[\n\r]")[0]
    return F.regexp_replace(line, f"[;{SPACES}]+$", "")


@lru_cache(4096)
def _pattern(p: str) -> re.Pattern:
    return re.compile(p, re.IGNORECASE)


def _search_all(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    return pd.Series([bool(t is not None and p and _pattern(p).search(t)) for t, p in zip(texts, patterns)], dtype=bool)


def regex_search(text: Column, pattern: Column) -> Column:
    """Whether the pattern of the row is found in its text, in any letter case; patterns are Python's, so rows go there as
    Arrow batches. False for a null text and a null or empty pattern; a broken pattern raises."""
    return F.pandas_udf(_search_all, T.BooleanType())(text, pattern)


def yes_no(x: Column) -> Column:
    """``yes`` or ``no`` where a text is just that once normalised, else null."""
    t = answer_text(x)
    return F.when(t.isin("yes", "no"), t)


def yes_no_prefix(x: Column) -> Column:
    """``yes`` or ``no`` where a text begins with that word, else null."""
    return F.nullif(F.regexp_extract(answer_text(x), r"^(yes|no)(?![\p{L}\p{N}_])", 1), F.lit(""))


def words(x: Column) -> Column:
    """Words between white space of any kind."""
    return F.filter(F.split(_squeeze(x), " "), lambda w: w != "")


def prefix_features(x: Column) -> dict[str, Column]:
    """What a policy sees of the text written so far: whether there is any, its words, characters and digits, and whether it
    is a year."""
    bare_text = F.regexp_replace(F.coalesce(x, F.lit("")), f"^[{SPACES}]+|[{SPACES}]+$", "")
    return {
        "prefix_nonempty": (bare_text != "").cast("double"),
        "prefix_words": F.size(words(F.coalesce(x, F.lit("")))).cast("double"),
        "prefix_chars": F.length(bare_text).cast("double"),
        "prefix_numeric": bare_text.rlike(r"\p{Nd}").cast("double"),
        "prefix_year": bare_text.rlike(r"^\p{Nd}{4}$").cast("double"),
    }


def search_terms(x: Column, limit: int | None = None) -> Column:
    """Lower-case runs of at least two word characters, of the first ``limit`` characters."""
    return F.regexp_extract_all(F.lower(F.substring(x, 1, limit) if limit else x), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def stripped(x: Column) -> Column:
    """Without white space at the ends; null where nothing is left."""
    return F.nullif(F.regexp_replace(x, f"^[{SPACES}]+|[{SPACES}]+$", ""), F.lit(""))


def clean_list(x: Column) -> Column:
    """Stripped elements in order, each once, blanks dropped."""
    return F.array_distinct(F.array_compact(F.transform(x, stripped)))


def weak_key(x: Column) -> Column:
    """NFKC and case folded, single blanks; punctuation stays."""
    return _squeeze(nfkc_casefold(x))


def strong_key(x: Column) -> Column:
    """NFKC and case folded, without ASCII punctuation and English articles."""
    return _plain(nfkc_casefold(x))


def token_digest(ids: Column) -> Column:
    """SHA-256 of tokens as unsigned 32-bit numbers, lowest byte first."""
    four = lambda t: F.lpad(F.hex(t.cast("bigint")), 8, "0")
    turned = F.transform(ids, lambda t: F.concat(*[F.substring(four(t), k, 2) for k in (7, 5, 3, 1)]))
    return F.sha2(F.unhex(F.array_join(turned, "")), 256)


def _general(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else f"{v:.8g}")


def coefficient_key(x: Column) -> Column:
    """A coefficient as files name it: eight significant digits, no trailing zeros."""
    return F.pandas_udf(_general, T.StringType())(x.cast("double"))


def pass_label(fraction: Column) -> Column:
    """``pass`` and a fraction between 0 and 1 with at most seven digits, ``p`` for the point; others raise."""
    shown = F.replace(F.rtrim(F.rtrim(F.format_string("%.7f", fraction), F.lit("0")), F.lit(".")), F.lit("."), F.lit("p"))
    return F.when((fraction > 0) & (fraction < 1), F.concat(F.lit("pass"), shown)).otherwise(F.raise_error(F.lit("a label needs a fraction between 0 and 1")).cast("string"))


def bucket(x: Column, salt: str, n: int = 100) -> Column:
    """A text's bucket of ``n``, by the first eight hexadecimal digits of its salted SHA-256."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(salt), x), 256), 1, 8), 16, 10).cast("bigint") % n).cast("int")
