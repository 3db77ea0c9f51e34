"""Normalization, tokens and keys as column expressions.

All take and return columns and stay inside Catalyst. Missing text is ''
throughout.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx


def filled(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: Column) -> Column:
    """Tokens between runs of white space, without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def first(tokens: Column) -> Column:
    return F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))


def literal_set(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


def _significant(text: Column, stop: list[str], least: int) -> Column:
    return F.filter(words(text), lambda w: ~w.isin(stop) & (F.length(w) >= least))


def _plain_v1(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(filled(c)), lx.POSSESSIVE, ""), lx.NOT_WORD_V1, " ")


def clean_tokens_v1(c: Column) -> Column:
    """Significant lower-case words over ASCII, Devanagari and accented Latin letters."""
    return _significant(_plain_v1(c), lx.STOP_V1, 2)


def clean_tokens_v2(c: Column) -> Column:
    """Significant lower-case words of any script, without web addresses."""
    text = F.regexp_replace(F.lower(filled(c)), lx.POSSESSIVE, "")
    return _significant(F.regexp_replace(F.regexp_replace(text, lx.WEB_PARTS, " "), lx.NOT_WORD_V2, " "), lx.STOP_V2, 2)


def keyword_v1(c: Column) -> Column:
    """First significant word of three letters or more, or ''."""
    return first(_significant(_plain_v1(c), lx.STOP_KEYWORD_V1, 3))


def keyword_v2(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(filled(c)), lx.POSSESSIVE, ""), lx.NOT_WORD_V2, " ")
    return first(_significant(text, lx.STOP_KEYWORD_V2, 3))


def name_aliases(c: Column) -> Column:
    """The lower-case name, then the parts of three letters or more around the first kind of trade-name marker that it has."""
    low = F.lower(filled(c))
    parts = F.array().cast("array<string>")
    for pattern in reversed(lx.TRADE_NAMES):
        parts = F.when(low.rlike(pattern), F.filter(F.transform(F.split(low, pattern, -1), lambda p: F.btrim(p, F.lit(" \t\n\r\f\x0b"))), lambda p: F.length(p) >= 3)).otherwise(parts)
    return F.concat(F.array(low), parts)


def compact_name(c: Column) -> Column:
    """Letters, digits and underscores of the lower-case name without a web domain."""
    return F.regexp_replace(F.regexp_replace(F.lower(filled(c)), lx.TOP_DOMAIN, ""), r"[^\p{L}\p{N}_]+", "")


def compact_text(c: Column) -> Column:
    """Like compact_name, with whole web addresses removed."""
    return F.regexp_replace(F.regexp_replace(F.lower(filled(c)), lx.WEB_PARTS, ""), r"[^\p{L}\p{N}_]+", "")


def numbers(c: Column) -> Column:
    """Distinct numbers between word boundaries, in order."""
    return F.array_distinct(F.regexp_extract_all(filled(c), F.lit(r"\b\d+\b"), F.lit(0)))


def postal_codes(c: Column) -> Column:
    return F.regexp_extract_all(filled(c), F.lit(lx.POSTAL), F.lit(0))


def building(c: Column) -> Column:
    """First number with what is attached to it, lower-cased, `/` as `_`; '' if none."""
    return F.replace(F.lower(F.regexp_extract(F.trim(filled(c)), lx.BUILDING, 0)), F.lit("/"), F.lit("_"))


def indic(c: Column) -> Column:
    return filled(c).rlike(lx.INDIC)


def indic_runs(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(filled(c), F.lit(lx.INDIC_RUN), F.lit(0)), lambda x: F.trim(x))


# --- transliteration -------------------------------------------------------

#: Consonant order that the Indic blocks share, by offset from 0x15, and independent vowels by offset from 0x05.
_CONSONANTS = "k kh g gh n c ch j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v s s s h".split()
_VOWELS = "a aa i ii u uu r l e e e ai o o o au".split()
_SIGNS = "aa i ii u uu r rr e e e ai o o o au".split()


def _indic_letter(c: int) -> str | None:
    at = (c - 0x900) % 0x80
    if at in (0x01, 0x02):
        return "m"
    if at == 0x03:
        return "h"
    if 0x05 <= at <= 0x14:
        return _VOWELS[at - 0x05]
    if 0x15 <= at <= 0x39:
        return _CONSONANTS[at - 0x15]
    if 0x3E <= at <= 0x4C:
        return _SIGNS[at - 0x3E]
    if 0x66 <= at <= 0x6F:
        return str(at - 0x66)
    return "" if at in (0x3C, 0x3D, 0x4D) else None


#: Ranges whose letters decompose into ASCII ones, letters that do not, and what has no width.
_RANGES = [(0xA0, 0x250), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0x2100, 0x2150), (0xFB00, 0xFB07), (0xFF00, 0xFF5F)]
_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "Æ": "AE", "Œ": "OE", "Ø": "O", "’": "'", "‘": "'", "‌": "", "‍": ""}


def _indic_letters() -> dict[str, str]:
    """Letters of the Devanagari block, which stands for all Indic ones."""
    return {chr(c): " " if letter is None else letter for c in range(0x900, 0x980) for letter in [_indic_letter(c)]}


def _plain_letters() -> dict[str, str]:
    """Letters outside the Indic blocks by what is left of them in ASCII; combining marks vanish."""
    found = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if ord(x) < 128) for lo, hi in _RANGES for c in range(lo, hi)}
    marks = {chr(c): "" for c in range(0x300, 0x370)}
    return {c: x or " " for c, x in found.items()} | marks | _LETTERS


def to_ascii(text: str) -> str:
    """Accents off Latin letters, and Indic letters by the layout that their blocks share; the rest becomes spaces."""
    if text.isascii():
        return text
    indic, plain = _indic_letters(), _plain_letters()
    one = lambda ch: ch if ord(ch) < 128 else indic[chr(0x900 + (ord(ch) - 0x900) % 0x80)] if 0x900 <= ord(ch) < 0xD80 else plain.get(ch, " ")
    return re.sub(" +", " ", "".join(map(one, text)))


def _replaced(c: Column, table: dict[str, str]) -> Column:
    """Characters replaced by a table: those that become one character or none in one pass, the others one by one."""
    short = {k: v for k, v in table.items() if len(v) <= 1}
    kept = sorted(short, key=lambda k: len(short[k]), reverse=True)  # what vanishes comes last, where there is nothing to become
    c = F.translate(c, "".join(kept), "".join(short[k] for k in kept))
    return reduce(lambda x, k: F.replace(x, F.lit(k), F.lit(table[k])), [k for k in table if k not in short], c)


def transliterated(c: Column) -> Column:
    """to_ascii as a column; text that is ASCII already passes by after one look."""
    base = "".join(map(chr, range(0x900, 0x980)))
    others = "".join(map(chr, range(0x980, 0xD80)))
    indic_text = _replaced(F.translate(c, others, base * (len(others) // len(base))), _indic_letters())
    text = F.when(c.rlike("[\\u0900-\\u0D7F]"), indic_text).otherwise(c)
    text = F.when(text.rlike("[^\\x00-\\x7F]"), F.regexp_replace(_replaced(text, _plain_letters()), "[^\\x00-\\x7F]", " ")).otherwise(text)
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.regexp_replace(text, " +", " ")).otherwise(c)


# --- record normalization --------------------------------------------------


def base_norm_ascii(c: Column) -> Column:
    """Normalization of text that is ASCII already: lower case, `&` as and, only letters and digits, no words for missing."""
    text = F.replace(F.lower(filled(c)), F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(F.regexp_replace(text, "['`´]", ""), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, lx.MISSING_WORDS, " "), r"\s+", " "))


def base_norm(c: Column) -> Column:
    """base_norm_ascii of transliterated text."""
    return base_norm_ascii(transliterated(filled(c)))


def each_word(c: Column, f) -> Column:
    return F.array_join(F.transform(words(c), f), " ")


def translate_words(c: Column, table: dict[str, str]) -> Column:
    """Replace whole words by a dictionary."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return each_word(c, lambda w: F.coalesce(F.try_element_at(entries, w), w))


def fix_digits(c: Column) -> Column:
    """Words of letters and 0, 1, 5 with at least three letters lose the digits: 5hree is shree."""

    def fix(w: Column) -> Column:
        letters = F.length(F.translate(w, "015", ""))
        return F.when(w.rlike("^[a-z015]*[015][a-z015]*$") & (letters >= 3), F.translate(w, "015", "ols")).otherwise(w)

    return each_word(c, fix)


def strip_honorifics(c: Column) -> Column:
    return F.regexp_replace(c, lx.HONORIFIC, "")


def strip_website(raw: Column, name: Column) -> Column:
    """The normalized name without address parts, if the raw name looks like a web address."""
    return F.when(filled(raw).rlike(lx.WEBSITE), F.trim(F.regexp_replace(name, lx.WEBSITE_ENDS, ""))).otherwise(name)


def alternate_name(c: Column) -> Column:
    """What follows the first alias marker, or ''."""
    return F.when(c.rlike(lx.ALIAS), F.trim(F.element_at(F.split(c, lx.ALIAS, 2), -1))).otherwise("")


def core_name(c: Column) -> Column:
    """The name without legal forms and articles; all of it if nothing else is left."""
    kept = F.filter(words(c), lambda w: ~w.isin(lx.LEGAL))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words(c)), " ")


def acronym(core: Column) -> Column:
    return F.when(F.size(words(core)) >= 2, F.array_join(F.transform(words(core), lambda w: F.substring(w, 1, 1)), "")).otherwise("")


def phonetic_word(w: Column) -> Column:
    w = reduce(lambda x, rule: F.replace(x, F.lit(rule[0]), F.lit(rule[1])), lx.PHONETIC, w)
    w = F.regexp_replace(w, "m(?=[tdkgcjs])", "n")
    w = F.concat(F.substring(w, 1, 1), F.regexp_replace(F.substr(w, F.lit(2)), "[aeiouy]", ""))
    return F.regexp_replace(w, r"(.)\1+", "$1")


def phonetic(c: Column) -> Column:
    return each_word(c, phonetic_word)


def tidy_numbers(c: Column) -> Column:
    """45th is 45, 0684 is 684, 110 201 is 110201; zeros go before groups are joined."""
    c = F.regexp_replace(c, r"\b(\d+)(?:st|nd|rd|th)\b", "$1")
    return F.regexp_replace(F.regexp_replace(c, r"\b0+(\d)", "$1"), r"\b(\d{3}) (\d{3})\b", "$1$2")


def state_codes(c: Column, learned: dict[str, str] | None = None) -> Column:
    """State names, longest first, replaced by their codes; each place is replaced once."""
    table = lx.STATES | (learned or {})
    # names of one length cannot contain each other, and codes are marked until the end
    for n in sorted({len(k.split()) for k in table}, reverse=True):
        names = sorted((k for k in table if len(k.split()) == n), key=len, reverse=True)
        if n > 1:
            c = reduce(lambda x, k: F.regexp_replace(x, rf"\b{k}\b", f"@{table[k]}@"), names, c)
        else:
            c = translate_words(c, {k: f"@{table[k]}@" for k in names})
    return F.replace(c, F.lit("@"), F.lit(""))


def postal(address: Column) -> Column:
    """Last number of five or six digits, or ''."""
    found = F.filter(F.regexp_extract_all(address, F.lit(r"\b\d+\b"), F.lit(0)), lambda x: F.length(x).between(5, 6))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def number_words(address: Column) -> Column:
    return F.regexp_extract_all(address, F.lit(r"\b\d+\b"), F.lit(0))


# --- keys and tokens -------------------------------------------------------


def name_tokens(c: Column) -> Column:
    joined = F.replace(c, F.lit(" "), F.lit(""))
    return F.concat(F.filter(words(c), lambda w: F.length(w) >= 3), F.when(F.length(joined) >= 6, F.array(F.concat(F.lit("NS"), joined))).otherwise(F.array().cast("array<string>")))


def _nums(c: Column) -> Column:
    return F.filter(words(c), lambda w: w.rlike("^[0-9]+$"))


def _alpha(c: Column, least: int) -> Column:
    return F.filter(words(c), lambda w: w.rlike(r"^\p{L}+$") & (F.length(w) >= least))


def address_keys(c: Column, with_sequence: bool = False) -> Column:
    """firstnumber_word for words of four letters, P with postal numbers, and optionally S with the first three numbers."""
    nums, empty = _nums(c), F.array().cast("array<string>")
    head = F.get(nums, F.lit(0))
    keys = F.when(F.size(nums) > 0, F.transform(_alpha(c, 4), lambda w: F.concat(head, F.lit("_"), w))).otherwise(empty)
    parts = [keys, F.transform(F.filter(nums, lambda n: F.length(n).between(5, 6)), lambda n: F.concat(F.lit("P"), n))]
    if with_sequence:
        parts.append(F.when(F.size(nums) >= 2, F.array(F.concat(F.lit("S"), F.array_join(F.slice(nums, 1, 3), "_")))).otherwise(empty))
    return F.concat(*parts)


def phonetic_tokens(c: Column) -> Column:
    """F with the skeleton of each word, and G with those of neighbours."""
    t = F.filter(F.transform(_alpha(c, 3), phonetic_word), lambda w: F.length(w) >= 3)
    pairs = F.when(F.size(t) >= 2, F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(F.lit("G"), a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(t, lambda w: F.concat(F.lit("F"), w)), pairs)


def name_address_keys(name: Column, address: Column, places: int = 12, with_numbers: bool = False) -> Column:
    """name word|place word for the first four words of the name and the first words of the address."""
    n = F.slice(F.array_distinct(F.filter(words(name), lambda w: F.length(w) >= 3)), 1, 4)
    kept = F.filter(words(address), lambda w: (w.rlike(r"^\p{L}+$") & (F.length(w) >= 4)) | (F.lit(with_numbers) & w.rlike("^[0-9]+$")))
    a = F.slice(F.array_distinct(kept), 1, places)
    return F.flatten(F.transform(n, lambda x: F.transform(a, lambda y: F.concat(x, F.lit("|"), y))))


def ngrams_of(w: Column, n: int) -> Column:
    """Character n-grams of a string; a shorter one is its own, an empty one has none."""
    size = F.length(w)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
    return F.when(size >= n, many).when(size > 0, F.array(w)).otherwise(F.array().cast("array<string>"))


def char_wb(c: Column, lo: int, hi: int) -> Column:
    """Character n-grams inside words framed by spaces."""
    framed = F.transform(words(F.lower(c)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int) -> Column:
        return F.flatten(F.transform(framed, lambda w: ngrams_of(w, n)))

    return F.concat(*map(of, range(lo, hi + 1)))


def shared_file_id(url: Column) -> Column:
    """The id of a shared file in its address, as /d/<id>/ or id=<id>; '' if there is none."""
    long = F.regexp_extract(filled(url), r"/d/([A-Za-z0-9_-]{10,})", 1)
    return F.when(long != "", long).otherwise(F.regexp_extract(filled(url), r"[?&]id=([A-Za-z0-9_-]{10,})", 1))


def tie_break(name: Column, address: Column, entity: Column) -> Column:
    """Hash that orders otherwise equal candidates."""
    return F.md5(F.concat_ws("|", F.lower(filled(name)), F.lower(filled(address)), entity))


def full_text(name: Column, address: Column) -> Column:
    return F.concat_ws(" ", filled(name), filled(address))


def record_text(name: Column, address: Column, country: Column) -> Column:
    """A record as one text for a pair scorer: name | address | country."""
    return F.concat_ws(" | ", filled(name), filled(address), filled(country))


def human_bytes(c: Column) -> Column:
    """12.0 KB and the like."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.format_string("%.1f TB", c / 1024.0**4)
    for i in reversed(range(4)):
        out = F.when(F.abs(c) < 1024.0 ** (i + 1), F.concat(F.format_string("%.1f ", c / 1024.0**i), F.lit(units[i]))).otherwise(out)
    return out


def normalized_name(c: Column, fold=base_norm) -> Column:
    """A name's normalization without a learned dictionary."""
    return translate_words(strip_honorifics(fix_digits(strip_website(c, fold(c)))), lx.NAME_WORDS)


def normalized_record(df, name: str = "business_name", address: str = "business_address", country: str = "country", translate: dict[str, str] | None = None, states: dict[str, str] | None = None, fold=base_norm):
    """df with the thirteen derived columns of a record."""
    df = df.withColumns({"country_key": fold(F.col(country)), "__n": fold(F.col(name)), "__a": fold(F.col(address))})
    is_indic, is_web = indic(F.col(name)), filled(name).rlike(lx.WEBSITE)
    n = F.col("__n")
    if translate:
        n = F.when(is_indic, translate_words(n, translate)).otherwise(n)
    n = strip_honorifics(fix_digits(strip_website(F.col(name), n)))
    df = df.withColumn("name_n", translate_words(n, lx.NAME_WORDS))
    df = df.withColumn("addr_n", state_codes(translate_words(tidy_numbers(F.col("__a")), lx.ADDRESS_WORDS), states))
    df = df.withColumns({"name_alt": alternate_name(F.col("name_n")), "name_core": core_name(F.col("name_n")), "is_web": is_web.cast("byte"), "is_indic": is_indic.cast("byte")})
    nums = number_words(F.col("addr_n"))
    return df.withColumns({"acronym": acronym(F.col("name_core")), "name_ph": phonetic(F.col("name_core")), "postal": postal(F.col("addr_n")), "first_num": first(nums), "nums": F.array_join(nums, " ")}).drop("__n", "__a")


def encoder_tokens(c: Column, lo: int = 3, hi: int = 4, joined: bool = True) -> Column:
    """Inputs of a hashed encoder: character n-grams in words, W with each word, and N with the joined text."""
    parts = [char_wb(c, lo, hi), F.transform(words(F.lower(c)), lambda w: F.concat(F.lit("W"), w))]
    if joined:
        parts.append(F.array(F.concat(F.lit("N"), F.replace(F.lower(c), F.lit(" "), F.lit("")))))
    return F.concat(*parts)
