"""Problem 10: one form for texts that look the same.

Every character is reduced to a prototype class; each class has the set of scripts in which it can be written.  The sets
are intersected over the letters of a token; the first script of the intersection (Latin, Cyrillic, Greek, Armenian,
Cherokee, Coptic, Lisu) gives the token's spelling, so mixed-script and whole-script look-alikes fall together and words
of one script stay as they are.  A token that no single script can write takes the first spelling of each letter.  A
letter of a script without look-alikes (ideographs, kana, Hangul, Arabic, ..) ends the token, so a word beside it is
resolved on its own.  Letters that differ in a visible mark are no look-alikes, so a dotless i stays.  The remaining
forms are normalised: full- and half-width forms, ligatures, Roman numerals, letters of mathematical fonts and radicals
to plain letters and ideographs, minus and special hyphens to the hyphen, all spaces to a blank, line ends
to \\n, combining accents to composed letters; invisible characters go, unless they shape what is seen (joiners between
emoji or in Arabic and Indic words, selectors after emoji, direction overrides).  Blanks at line ends cannot be seen and
go.  Accents, case, digits, raised digits and visible signs stay.

Null stays null and is in no pair (as is a null doc_id), nor is a text without a visible character.  Repeated rows pair with nothing new.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake.session import checkpoint, spread, table

# fixed values: letters of other scripts that look like a Latin letter, by Latin letter
CYRILLIC = {"a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ѵ", "w": "ԝ", "x": "х", "y": "у", "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "Q": "Ԛ", "S": "Ѕ", "T": "Т", "V": "Ѵ", "W": "Ԝ", "X": "Х", "Y": "Ү"}
GREEK = {"o": "ο", "v": "ν", "c": "ϲ", "j": "ϳ", "A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "J": "Ϳ", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ"}
ARMENIAN = {"o": "օ", "h": "հ", "n": "ո", "u": "ս", "g": "ց", "q": "զ", "O": "Օ", "S": "Տ", "U": "Ս"}
CHEROKEE = {"A": "Ꭺ", "C": "Ꮯ", "D": "Ꭰ", "E": "Ꭼ", "G": "Ꮐ", "H": "Ꮋ", "J": "Ꭻ", "K": "Ꮶ", "L": "Ꮮ", "M": "Ꮇ", "P": "Ꮲ", "R": "Ꭱ", "S": "Ꮪ", "T": "Ꭲ", "V": "Ꮩ", "W": "Ꮃ", "Y": "Ꮍ", "Z": "Ꮓ", "b": "Ꮟ", "d": "Ꮷ", "h": "Ꮒ"}
COPTIC = {"C": "Ⲥ", "H": "Ⲏ", "I": "Ⲓ", "K": "Ⲕ", "M": "Ⲙ", "N": "Ⲛ", "O": "Ⲟ", "P": "Ⲣ", "T": "Ⲧ", "X": "Ⲭ", "Y": "Ⲩ", "c": "ⲥ", "o": "ⲟ", "p": "ⲣ"}
LISU = {"A": "ꓮ", "B": "ꓐ", "C": "ꓚ", "D": "ꓓ", "E": "ꓰ", "F": "ꓝ", "G": "ꓖ", "H": "ꓧ", "I": "ꓲ", "J": "ꓙ", "K": "ꓗ", "L": "ꓡ", "M": "ꓟ", "N": "ꓠ", "O": "ꓳ", "P": "ꓑ", "R": "ꓣ", "S": "ꓢ", "T": "ꓔ", "U": "ꓴ", "V": "ꓦ", "W": "ꓪ", "X": "ꓫ", "Y": "ꓬ", "Z": "ꓜ"}
LATIN = {"g": "ɡ", "a": "ɑ", "c": "ᴄ", "o": "ᴏ", "s": "ꜱ", "v": "ᴠ", "w": "ᴡ", "z": "ᴢ"}
MORE = {"Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S"}  # further letters of a script that has one for the prototype already
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Lisu")

_SPELL = {"Latin": {}, "Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Cherokee": CHEROKEE, "Coptic": COPTIC, "Lisu": LISU}
#: letter -> its prototype
_PROTO = {v: k for m in (*_SPELL.values(), LATIN) for k, v in m.items()} | MORE
_CLASS_SCRIPTS = {k: frozenset(["Latin", *(s for s, m in _SPELL.items() if k in m)]) for k in set(_PROTO.values())}


def _fold_table() -> dict[int, str | None]:
    """By rule from the character database: compatibility forms that look the same, spaces, invisible characters."""
    out: dict[int, str | None] = {}
    for c in range(0xA0, 0x30000):
        ch = chr(c)
        if unicodedata.category(ch) == "Zs":
            out[c] = " "
            continue
        d = unicodedata.decomposition(ch)
        letter = d.startswith("<font>") or d.startswith("<compat>") and 0x2E80 <= c <= 0x2FDF  # mathematical fonts; radicals
        if d.startswith(("<wide>", "<narrow>")) or letter or 0xFB00 <= c <= 0xFB06 or 0x2160 <= c <= 0x217F:
            out[c] = unicodedata.normalize("NFKC", ch)
        elif unicodedata.category(ch) == "Cf" and c not in (0x200C, 0x200D, 0x202D, 0x202E) and not 0x600 <= c <= 0x8E2 and not 0x13430 <= c <= 0x1343F:
            out[c] = None
    out |= {0x2010: "-", 0x2011: "-", 0x2212: "-", 0xB5: "μ", 0x180E: None, 0x34F: None, 0x115F: None, 0x1160: None, 0x3164: None, 0xFFA0: None, 0x17B4: None, 0x17B5: None}
    out |= {c: None for c in (*range(0x180B, 0x180E), *range(0xE0000, 0xE1000))}
    return out


def _char_class(codes: list[int]) -> str:
    ranges, start = [], None
    for i, c in enumerate(codes):
        start = c if start is None else start
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            ranges.append(f"\\U{start:08x}-\\U{c:08x}")
            start = None
    return "[" + "".join(ranges) + "]"


_FOLD = _fold_table()
#: one for each plane's sake: a class within the basic plane is a table, one that goes beyond is searched range by range
_FOLDED = re.compile(_char_class([c for c in sorted(_FOLD) if c < 0x10000]))
_BEYOND = re.compile("[^\\u0000-\\uffff]")
_FOLDED_BEYOND = re.compile(_char_class([c for c in sorted(_FOLD) if c >= 0x10000]))
_SHAPING = re.compile("[\u200c\u200d\ufe00-\ufe0f]")
_JOINERS = re.compile(
    "(?<![؀-ࣿऀ-෿က-႟ក-៿])[‌‍]+(?![\U0001f000-\U0001faff☀-➿←-⇿⬀-⯿])"
    "|(?<![\U0001f000-\U0001faff☀-➿←-⇿⬀-⯿️؀-ࣿऀ-෿က-႟ក-៿])[‌‍]+"
    "|‌+(?=[\U0001f000-\U0001faff])"
    "|(?<![©®‼⁉™ℹ←-⇿⌀-⯿〰〽㊗㊙\U0001f000-\U0001faff0-9#*])[︀-️]+"
)
_TOKEN = re.compile(r"[^\W\d_][^\W\d_̀-ͯ]*(?:[̀-ͯ]+[^\W\d_]*)*")
_FOREIGN = re.compile("[ɑɡᴄᴏꜱᴠᴡᴢͰ-֏\u13a0-\u13ff\u2c80-\u2cff\ua4d0-\ua4ff]")
_TRAIL = re.compile(r"[ \t\f\v]+(?=\n|\Z)")


@cache
def _script(ch: str) -> frozenset[str] | None:
    """Scripts that can write the letter's class, by its name in the character database; empty for a script without
    look-alikes, None for what has no script."""
    p = _PROTO.get(ch, ch)
    if p in _CLASS_SCRIPTS:
        return _CLASS_SCRIPTS[p]
    if not ch.isalpha():
        return None
    name = unicodedata.name(ch, "").split(" ")[0].capitalize()
    return frozenset([name]) & frozenset(SCRIPTS)


def _spell(m: re.Match) -> str:
    token = m.group()
    if not _FOREIGN.search(token):
        return token
    out, run = [], []
    for ch in token:
        if _script(ch) == frozenset():
            out += [*_spell_run(run), ch]
            run = []
        else:
            run.append(ch)
    return "".join([*out, *_spell_run(run)])


def _spell_run(run: list[str]) -> list[str]:
    """Letters in the first script that can write them all, else each in its first spelling."""
    able = frozenset(SCRIPTS)
    for ch in run:
        if (s := _script(ch)) is not None:
            able &= s
    chosen = next((s for s in SCRIPTS if s in able), None)
    spell = _SPELL.get(chosen, {})
    return [spell.get(p, p) for p in (_PROTO.get(ch, ch) for ch in run)]


def normalize(text: str | None) -> str | None:
    if text is None:
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        for _ in range(2):  # an invisible character may have hidden another's neighbour
            if _FOLDED.search(text) or _BEYOND.search(text) and _FOLDED_BEYOND.search(text):
                text = text.translate(_FOLD)
            if not _SHAPING.search(text):
                break
            text = _JOINERS.sub("", text)
        if _FOREIGN.search(text):
            text = _TOKEN.sub(_spell, unicodedata.normalize("NFD", text))
        text = unicodedata.normalize("NFC", text)
    if "\x00" in text or "\x0b" in text or "\x0c" in text or " \n" in text or "\t\n" in text or text[-1:].isspace():
        text = _TRAIL.sub("", text).rstrip()
    return text


def normalized(documents: DataFrame) -> DataFrame:
    """doc_id, text in its one form."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [normalize(t) for t in b["text"]]})

    return spread(documents.select(F.col("doc_id").cast("string"), "text")).mapInPandas(fn, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def pairs(documents: DataFrame) -> DataFrame:
    """doc_a < doc_b: different strings with one visible form.

    Only digests travel.  Forms with a single spelling drop out first; then the spellings of a form are paired, and only
    these pairs are expanded to documents, so a spelling with a third of all rows never meets itself.
    """

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            rows = [(d, digest(n), digest(t)) for d, t in zip(b["doc_id"], b["text"]) if t is not None and (n := normalize(t)) and not n.isspace()]
            yield pd.DataFrame(rows, columns=["doc_id", "form", "spelling"])

    found = spread(documents.where("text is not null and doc_id is not null").select("doc_id", "text")).mapInPandas(fn, "doc_id bigint, form binary, spelling binary")
    rows = checkpoint(found.distinct())
    several = rows.groupBy("form").agg(F.min("spelling").alias("least"), F.max("spelling").alias("most")).where("least <> most").select("form")
    rows = rows.join(several, "form", "left_semi")
    kinds = rows.select("form", "spelling").distinct()
    met = kinds.withColumnRenamed("spelling", "sa").join(kinds.withColumnRenamed("spelling", "sb"), "form").where("sa < sb").select("sa", "sb")
    spelt = rows.select("spelling", "doc_id")
    out = met.join(spelt.withColumnsRenamed({"spelling": "sa", "doc_id": "x"}), "sa").join(spelt.withColumnsRenamed({"spelling": "sb", "doc_id": "y"}), "sb")
    return out.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).where("doc_a <> doc_b").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "documents"))


def p10_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(table(spark, sf_dir, "documents"))


def p10_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, nulls, unstable, emptied: forms that a second pass changes, and visible texts that have no form."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = [normalize(t) for t in b["text"]]
            rows = [(n is None, n is not None and normalize(n) != n, bool(t) and not n and any(c.isalnum() for c in t)) for t, n in zip(b["text"], forms)]
            yield pd.DataFrame(rows, columns=["none", "moved", "gone"])

    checked = spread(table(spark, sf_dir, "documents").select("text")).mapInPandas(fn, "none boolean, moved boolean, gone boolean")
    return checked.agg(F.count("*").alias("documents"), F.count_if("none").alias("nulls"), F.count_if("moved").alias("unstable"), F.count_if("gone").alias("emptied"))


SQL = {"p10_stable": "SELECT count(*) AS documents, count(*) FILTER (text IS NULL) AS nulls, 0 AS unstable, 0 AS emptied FROM documents"}
