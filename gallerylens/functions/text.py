"""Text expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache, reduce
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Letters that compatibility decomposition leaves alone, and their ASCII spelling.
SPECIAL = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i"}
#: Numbers in words.
NUMBERS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90", "hundred": "100", "thousand": "1000"}
#: Contractions written without their apostrophe.
CONTRACTIONS = {"dont": "don't", "cant": "can't", "wont": "won't", "im": "i'm", "ive": "i've", "id": "i'd", "youre": "you're", "youve": "you've", "hes": "he's", "shes": "she's", "isnt": "isn't", "arent": "aren't", "wasnt": "wasn't", "werent": "weren't", "didnt": "didn't", "hasnt": "hasn't", "havent": "haven't", "wouldnt": "wouldn't", "couldnt": "couldn't", "shouldnt": "shouldn't", "lets": "let's"}
#: Articles, and ASCII punctuation.
ARTICLES = ["a", "an", "the"]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: Cyrillic and Greek letters in ASCII, small; capital ones have the first letter capital.
LETTERS = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia io".split(), strict=True)) | dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))


@cache
def _accents() -> tuple[str, str]:
    """Letters whose compatibility decomposition is an ASCII letter and marks, and these letters."""
    found = {c: d for c in (chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000) if len(d := unicodedata.normalize("NFKD", c)) > 1}
    pairs = [(c, d[0]) for c, d in found.items() if d[0].isascii() and d[0].isalpha() and all(map(unicodedata.combining, d[1:]))]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _per_text(spell) -> Callable[[Column], Column]:
    """A string function over Arrow batches, nulls staying; its state is a text at a time."""

    @F.arrow_udf("string")
    def run(c: pa.Array) -> pa.Array:
        return pa.array((None if (x := v.as_py()) is None else spell(x) for v in c), pa.string())

    return run


def decomposed(text: str) -> str:
    """What compatibility decomposition leaves in ASCII."""
    return text if text.isascii() else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


@cache
def _letters() -> tuple[re.Pattern, dict[str, str]]:
    """Letters that have a spelling of their own, as a pattern and a table."""
    letters = SPECIAL | LETTERS | {k.upper(): v.capitalize() for k, v in LETTERS.items() if len(k.upper()) == 1}
    for x in map(chr, range(0x370, 0x530)):  # marked Greek and Cyrillic letters are those without their marks
        if x not in letters and (base := unicodedata.normalize("NFKD", x)[0]) in letters:
            letters[x] = letters[base]
    return re.compile(f"[{''.join(letters)}]"), letters


def romanized(text: str) -> str:
    if text.isascii():
        return text
    pattern, letters = _letters()
    return decomposed(pattern.sub(lambda m: letters[m[0]], text))


def strip_accents(c: Column) -> Column:
    """What compatibility decomposition leaves in ASCII: letters without their marks, ligatures and full-width forms spelled out; all else is dropped."""
    return _per_text(decomposed)(c)


def fold_accents(c: Column) -> Column:
    """Latin letters without their marks; all else stays."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, *_accents()))


def transliterate(c: Column) -> Column:
    """ASCII spelling of Latin, Cyrillic and Greek letters and of what decomposes to such; characters without one are dropped."""
    return _per_text(romanized)(c)


def html_unescape(c: Column) -> Column:
    """Text with its entities decoded in one pass: the 252 names of HTML 4, &apos;, and numbers of the basic plane; a no-break space as a space."""
    table = F.create_map(*(F.lit(x) for n, p in (name2codepoint | {"apos": 39}).items() for x in (f"&{n};", " " if n == "nbsp" else chr(p))))
    runs = F.regexp_extract_all(c, F.lit(r"&#[0-9]{1,5};|&#[xX][0-9a-fA-F]{1,4};|&[A-Za-z0-9]+;|&|[^&]+"), F.lit(0))
    code = lambda hexed: F.decode(F.unhex(F.lpad(hexed, 4, "0")), "UTF-16BE")
    digits = lambda r, at: F.substr(r, F.lit(at), F.length(r) - at)
    number = lambda r: digits(r, 3).try_cast("int")
    decimal = lambda r: F.when(number(r).between(1, 0xD7FF) | number(r).between(0xE000, 0xFFFF), code(F.hex(number(r))))
    numeric = lambda r: F.coalesce(F.when(F.lower(r).startswith("&#x"), code(digits(r, 4))).otherwise(decimal(r)), r)
    # what stands between entities is no key of the table
    entity = lambda r: F.when(~r.startswith("&"), r).when(r.startswith("&#"), numeric(r)).otherwise(F.coalesce(F.try_element_at(table, r), r))
    return F.when(c.contains("&"), F.array_join(F.transform(runs, entity), "")).otherwise(c)


def clear_title(c: Column) -> Column:
    return transliterate(F.lower(F.regexp_replace(html_unescape(c), r"(?U)\W+", "")))


def clear_artist(c: Column) -> Column:
    return F.replace(transliterate(F.lower(c)), F.lit(" "), F.lit("-"))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def contains_any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def style_query(c: Column) -> Column:
    """Without what stands in parentheses, in title case; two names that are also other things get a suffix."""
    base = F.trim(F.initcap(F.regexp_replace(c, r"\(.*\)", "")))
    return F.when(base.isin("Realism", "Symbolism"), F.concat(base, F.lit(" (arts)"))).otherwise(base)


def display_name(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))


def reference_cleanup(c: Column) -> Column:
    """Lower case without accents, no runs of periods, a space after each period, single spaces."""
    bare = F.regexp_replace(strip_accents(F.lower(c)), r"\.\.+", "")
    return squeeze(F.regexp_replace(bare, r"\.(?!\s)", ". "))


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def after_last(c: Column, mark: str) -> Column:
    """What follows the last mark, or all."""
    return F.substring_index(c, mark, -1)


def truncate_words(c: Column, n: int) -> Column:
    """The first n words; a cut text keeps its final period."""
    words = F.split(c, " ")
    cut = F.array_join(F.slice(words, 1, n), " ")
    return F.when(F.size(words) <= n, c).when(c.endswith(".") & ~cut.endswith("."), F.concat(cut, F.lit("."))).otherwise(cut)


def verdict(c: Column, marker: str) -> Column:
    """Whether the answer after the marker starts with yes."""
    return F.lower(F.ltrim(F.regexp_replace(F.substring_index(c, marker, -1), r"^\s+", ""))).startswith("yes")


def robust_answer(c: Column) -> Column:
    """An answer in the form in which answers are compared.

    Lower case; a period goes unless a digit stands on either side; of whole words, runs of letters, digits and
    underscores, numbers become digits, articles go and contractions get their apostrophe; commas between digits
    go; other punctuation but ' : , becomes a space; single spaces.
    """
    bare = F.regexp_replace(F.lower(c), r"(?<![0-9])\.(?![0-9])", "")
    table = F.create_map(*(F.lit(x) for kv in (NUMBERS | dict.fromkeys(ARTICLES, "") | CONTRACTIONS).items() for x in kv))
    runs = F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    mapped = F.array_join(F.transform(runs, lambda w: F.coalesce(F.try_element_at(table, w), w)), "")
    joined = F.regexp_replace(mapped, r"(?<=[0-9]),(?=[0-9])", "")
    return squeeze(F.regexp_replace(joined, r"[!\"#$%&()*+\-./;<=>?@\[\\\]^_`{|}~]", " "))


#: How Treebank tokens part, as (pattern, replacement) one after another.
TREEBANK = [
    (r'^"', "`` "), (r'([ (\[{<])"', "$1 `` "), (r"([:,])([^0-9])", " $1 $2"), (r"([:,])$", " $1 "), (r"\.\.\.", " ... "), (r"([;@#$%&])", " $1 "), (r"([^.])(\.)([\])}>\"']*)\s*$", "$1 $2$3 "), (r"([?!])", " $1 "), (r"([^'])' ", "$1 ' "),
    (r"([\]\[(){}<>])", " $1 "), (r"--", " -- "), (r"^|$", " "), (r'"', " '' "), (r"([^' ])('[sSmMdD]|') ", "$1 $2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)\b(can)(not)\b", "$1 $2"), (r"(?i)\b(d)('ye)\b", "$1 $2"), (r"(?i)\b(gim)(me)\b", "$1 $2"), (r"(?i)\b(gon)(na)\b", "$1 $2"), (r"(?i)\b(got)(ta)\b", "$1 $2"), (r"(?i)\b(lem)(me)\b", "$1 $2"), (r"(?i)\b(wan)(na)\s", "$1 $2 "),
]


def treebank(c: Column) -> Column:
    """The tokens of a sentence as in the Penn Treebank: punctuation and the ends of contractions stand alone."""
    return words(reduce(lambda x, rule: F.regexp_replace(x, *rule), TREEBANK, c))


def without_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def words(c: Column) -> Column:
    """Words at white space, as they are, without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-cased words at white space, without empty ones."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
