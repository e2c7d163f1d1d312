"""Text expressions: normalisation, tokens, filters, marks and affixes. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode ranges of Arabic diacritics (U+064B to U+0652, U+0670) and the tatweel.
DIACRITICS = "[\\u064B-\\u0652\\u0670]"
TATWEEL = "\\u0640"
# Letters folded to one form, in the order alef maksura, alef variants, teh marbuta.
FOLD_FROM, FOLD_TO = "ىأإآٱة", "يااااه"

UNICODE_SPACE = "(?U)\\s+"


def normalize_text(text: Column, fold: bool = True) -> Column:
    """Text without punctuation, tatweel and diacritics, letter variants folded if fold, outer white space stripped; null stays null."""
    bare = F.regexp_replace(text, f"\\p{{P}}|{TATWEEL}|{DIACRITICS}", "")
    if fold:
        bare = F.translate(bare, FOLD_FROM, FOLD_TO)
    return F.regexp_replace(bare, "(?U)^\\s+|\\s+$", "")


def spoken_form(text: Column, fold: bool = True) -> Column:
    """Underscores as spaces, then normalised."""
    return normalize_text(F.replace(text, F.lit("_"), F.lit(" ")), fold)


def tokens(text: Column) -> Column:
    """White-space tokens without empty ones."""
    return F.filter(F.split(text, UNICODE_SPACE), lambda x: x != "")


def first_tokens(text: Column, n: int = 64) -> Column:
    """The first n tokens."""
    return F.slice(tokens(text), 1, n)


def is_word(text: Column, most_tokens: int = 2) -> Column:
    """Whether text is usable as a word entry: at most most_tokens tokens, longer than one character, not only digits."""
    few = F.size(tokens(text)) <= most_tokens
    return F.coalesce(few & (F.char_length(text) > 1) & ~text.rlike("(?U)^\\p{Nd}+$"), F.lit(False))


def mark_first(sentence: Column, target: Column, left: str = "[TGT]", right: str = "[/TGT]") -> Column:
    """sentence with the first occurrence of target marked, word or not; null where it does not occur."""
    at = F.position(target, sentence)
    marked = F.concat(F.substr(sentence, F.lit(1), at - 1), F.lit(left), target, F.lit(right), F.substr(sentence, at + F.char_length(target)))
    return F.when(at > 0, marked)


def mark_first_word(sentence: Column, target: Column, left: str = "[TGT]", right: str = "[/TGT]") -> Column:
    """sentence with the first whole-word occurrence of target marked; unchanged where there is none."""
    pattern = F.concat(F.lit("(?s)^(.*?)(?<![\\p{L}\\p{N}_])(\\Q"), target, F.lit("\\E)(?![\\p{L}\\p{N}_])(.*)$"))
    parts = [F.regexp_extract_all(sentence, pattern, F.lit(k)) for k in (1, 2, 3)]
    first = [F.get(p, F.lit(0)) for p in parts]
    return F.when(F.size(parts[1]) > 0, F.concat(first[0], F.lit(left), first[1], F.lit(right), first[2])).otherwise(sentence)


def edit_share(a: Column, b: Column) -> Column:
    """Levenshtein distance of the normalised words over the longer raw length without spaces; 0 if both are empty."""
    longest = F.greatest(F.char_length(F.replace(a, F.lit(" "), F.lit(""))), F.char_length(F.replace(b, F.lit(" "), F.lit(""))))
    return F.coalesce(F.levenshtein(normalize_text(a), normalize_text(b)) / F.nullif(longest, F.lit(0)), F.lit(0.0))


def prefix_of(long: Column, short: Column) -> Column:
    """What long has before short, if long ends with short and is 1 to 3 characters longer."""
    gap = F.char_length(long) - F.char_length(short)
    return F.when(gap.between(1, 3) & F.endswith(normalize_text(long), normalize_text(short)), F.substr(long, F.lit(1), gap))


def suffix_of(long: Column, short: Column) -> Column:
    """What long has after short, if long starts with short and is 1 to 3 characters longer."""
    gap = F.char_length(long) - F.char_length(short)
    return F.when(gap.between(1, 3) & F.startswith(normalize_text(long), normalize_text(short)), F.substr(long, F.char_length(short) + 1))


def parse_pairs(line: Column) -> Column:
    """`0-0 1-2` as array<struct<src:int,tgt:int>>; blank gives an empty array."""
    return F.transform(
        tokens(line),
        lambda x: F.struct(F.split(x, "-").getItem(0).cast("int").alias("src"), F.split(x, "-").getItem(1).cast("int").alias("tgt")),
    )


def positions_to_words(words: Column, positions: Column) -> Column:
    """The words at 0-based positions, joined by spaces in position order."""
    return F.array_join(F.transform(F.array_sort(positions), lambda i: F.get(words, i)), " ")
