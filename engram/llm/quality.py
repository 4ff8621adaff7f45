"""Statistics of each text that tell running sentences from lists, tables and junk.

A text is cut into units: the sentences of its lines, a hard-wrapped sentence put together again. A unit is a running
sentence when enough of its words are common words of one language and more than one of them occur; so the cells of a
table, the entries of a list, records and encoded bytes are none, whatever marks them. Beside that stand repetition
statistics: the shares of repeated lines and paragraphs, and how much of the text its dominant word n-gram covers.
``kind`` combines all of them by rules. Plain counts are JVM expressions, which are not computed where they are not
selected; what needs the languages' words or repetition is read in one pass over each text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import strip
from engram.sources.tables import one_row_each

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
UNSEEN = re.compile(r"[\s\x00-\x1f\x7f-\x9f\xad\u0600-\u0605\u061c\u06dd\u070f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb\U000e0001-\U000e007f]+")
SYMBOL = re.compile(r"[\w\s]+")
#: Beside these, a character may leave no mark.
ODD = re.compile(r"[^ -~\n¡-¬®-˿぀-鿿]")
KANA = re.compile("[぀-ヿ]")
CJK = re.compile("[぀-ヿ㐀-鿿々ー]")
ENDS = re.compile(r"[.!?…。！？][\"'’”»)\]]*$")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'’”»)\]]*\s+|(?<=[。！？])")
MARKER = re.compile(r"^\s*(?:[-*+•–—·>]|#{1,6}|\(?\w{1,3}[.)]|\[[ xX]?\])\s+")
PARAGRAPH = re.compile(r"\n\s*\n")
SPEAKER = re.compile(r"^\s*[^\W\d_]{2,20}:\s+")

#: Smallest share of common words in a running sentence, and how many different ones.
SHARE, DIFFERENT, LEAST_WORDS = 0.2, 2, 4
#: The same share for a unit of at least so many words that begins and ends like a sentence.
FORMED_SHARE, FORMED_WORDS = 0.12, 8
#: Largest share of symbols in a running sentence, and the longest word of one.
SYMBOLS, LONGEST = 0.25, 40
#: Smallest share of characters in common Japanese words.
KANA_SHARE = 0.06
#: Words of the n-grams; what the dominant one covers in junk, and with how many words; repeated parts of boilerplate.
GRAM, JUNK_COVERAGE, JUNK_WORDS, BOILERPLATE_COVERAGE, BOILERPLATE = 3, 0.5, 12, 0.3, 0.5

# A word, what leaves no mark, a line's end, and list markers, for the JVM's regular expressions.
J_WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*(?:['\x{2019}][\p{L}\p{N}][\p{L}\p{N}\p{M}]*)*"
J_UNSEEN = r"[\p{Z}\p{Cc}\p{Cf}\x{200b}]+"
J_SYMBOL = r"[\p{L}\p{N}\p{M}\p{Z}\p{Cc}\p{Cf}]+"
J_ENDS = "[.!?…。！？][\"'’”»)\\]]*$"
J_MARKER = "^(?:[-*+•–—·>]|#{1,6}|[(]?[\\p{L}\\p{N}_]{1,3}[.)]|\\[[ xX]?\\])\\p{Z}+"

READ = "n_visible long, common_word_share double, prose_share double, duplicate_line_share double, duplicate_paragraph_share double, top_ngram_coverage double, kind string"


def plain(s: str) -> str:
    """Lower case without accents, compatibility forms resolved."""
    if s.isascii():
        return s.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


@lru_cache(maxsize=1 << 16)
def word_key(w: str) -> str:
    """A word for comparison; single letters keep their accents, since most of them are words in some language."""
    return plain(w) if len(w) > 1 else w.lower()


def word_keys(s: str) -> list[str]:
    """The words of a text for comparison."""
    return TOKEN.findall(s.lower()) if s.isascii() else [word_key(w) for w in TOKEN.findall(s)]


def visible(s: str) -> int:
    """The characters that leave a mark: no white space, control or format characters."""
    if ODD.search(s):
        return len(UNSEEN.sub("", s))
    return len(s) - s.count(" ") - s.count("\n")


class Prose:
    """Tells running sentences by the common words of the languages: {language: words}."""

    def __init__(self, common: dict[str, set[str]]):
        self.spaced = {lang: {word_key(unicodedata.normalize("NFC", w)) for w in ws} for lang, ws in common.items() if not any(CJK.search(w) for w in ws)}
        self.known = set().union(*self.spaced.values())
        solid = sorted({w for ws in common.values() for w in ws if CJK.search(w)}, key=len, reverse=True)
        self.solid = re.compile("|".join(map(re.escape, solid))) if solid else None

    def best(self, words: list[str]) -> tuple[int, int, dict[str, int]]:
        """Of the language that fits best: how many common words, and how many different ones; and each language's."""
        hits = [w for w in words if w in self.known]
        by = {lang: own for lang, ws in self.spaced.items() if (own := [w for w in hits if w in ws])} if hits else {}
        return (*max(((len(x), len(set(x))) for x in by.values()), default=(0, 0)), {k: len(x) for k, x in by.items()})

    def sentence(self, unit: str, words: list[str], marks: int, common: int, different: int) -> bool | None:
        """Whether a unit is a running sentence; None if it is too short to tell. ``marks``: its visible characters."""
        cjk = None if unit.isascii() else CJK.search(unit)
        if marks > LONGEST and not cjk and max(map(len, unit.split())) > max(LONGEST, marks // 2):
            return False
        letters = sum(map(len, words))
        if marks - letters > SYMBOLS * marks and len(SYMBOL.sub("", unit)) > SYMBOLS * marks:
            return False
        if cjk and self.solid is not None:
            body = re.sub(r"[\W\d_]+", "", unit)
            if len(CJK.findall(body)) * 2 > len(body):
                if len(body) < 6:
                    return None
                return bool(KANA.search(body)) and sum(map(len, self.solid.findall(body))) >= KANA_SHARE * len(body)
        if not words or "".join(words).isdigit():
            return False
        if len(words) < LEAST_WORDS:
            return None
        formed = len(words) >= FORMED_WORDS and bool(ENDS.search(unit)) and unit.lstrip("\"'“«¿¡(")[:1].isupper()
        return common >= (FORMED_SHARE if formed else SHARE) * len(words) and different >= DIFFERENT

    def units(self, text: str) -> Iterator[list[str]]:
        """The sentences of each block of lines; wrapped lines are put together, list entries stay apart."""
        block: list[str] = []
        for line in [*text.split("\n"), ""]:
            line = line.strip()
            starts = not line or not block or bool(MARKER.match(line)) or bool(SPEAKER.match(line))
            wrapped = block and not starts and not ENDS.search(block[-1]) and len(block[-1]) >= 40 and len(block[-1].rsplit(None, 1)[-1]) <= LONGEST
            if block and not wrapped:
                yield [x for x in SENTENCE.split(" ".join(block)) if x]
                block = []
            if line:
                block.append(line)

    def read(self, text: str) -> tuple[int, float, list[str]]:
        """The visible characters in running sentences, the share of the best language's common words, and all words.

        Units too short to tell go with the one before in their block."""
        total, said, by = 0, [], Counter()
        for block in self.units(text):
            seen, states = [], []
            for u in block:
                words = word_keys(u)
                common, different, each = self.best(words)
                marks = visible(u)
                by.update(each)
                said += words
                seen.append(marks)
                states.append(self.sentence(u, words, marks, common, different))
            last = next((s for s in states if s is not None), False)
            for n, s in zip(seen, states):
                last = last if s is None else s
                total += n * last
        return total, max(by.values(), default=0) / max(1, len(said)), said


def _repeated(parts: list[str]) -> float:
    """The share of characters in parts that occurred before."""
    if len(set(parts)) == len(parts):
        return 0.0
    seen: set[str] = set()
    again = total = 0
    for p in parts:
        total += len(p)
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def top_coverage(words: list[str]) -> float:
    """The share of the words' characters that the dominant n-gram covers; 0 if none occurs twice."""
    grams = list(zip(*(words[i:] for i in range(GRAM))))
    if len(set(grams)) == len(grams):
        return 0.0
    most = max(n * sum(map(len, g)) for g, n in Counter(grams).items() if n > 1)
    return min(1.0, most / sum(map(len, words)))


def kind_of(text: str, seen: int, lines: list[str], n_words: int, share: float, repeated: float, coverage: float) -> str:
    """The combined rules: the same few words over and over are junk, whatever they are; running sentences that repeat
    each other are boilerplate; else the form of the lines decides."""
    if share >= 0.5 and not (coverage >= JUNK_COVERAGE and n_words >= JUNK_WORDS):
        return "boilerplate" if repeated >= BOILERPLATE or (n_words > 30 and coverage >= BOILERPLATE_COVERAGE) else "prose"
    if share >= 0.5 or not n_words:
        return "junk"
    lists = sum(bool(MARKER.match(x)) for x in lines) / len(lines)
    if lists >= 0.5:
        return "list"
    delimiters = Counter(c for x in lines for c in ("|", "\t", ";", ",") if x.count(c) >= 2)
    if len(lines) > 1 and any(n >= 0.6 * len(lines) for n in delimiters.values()):
        return "table"
    dense = max(map(len, text.split())) > 0.5 * seen or len(SYMBOL.sub("", text)) + text.count("_") > 0.3 * seen
    return "junk" if dense else "list"


def read(text: str | None, prose: Prose) -> tuple:
    """The values of ``READ`` for one text; zeros and kind 'empty' for null, empty and blank ones."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)  # an accent is no character of its own
    seen = visible(text)
    if not seen:
        return (0, 0.0, 0.0, 0.0, 0.0, 0.0, "empty")
    lines = [x for y in text.splitlines() if (x := y.strip())]
    paragraphs = [x for y in PARAGRAPH.split(text) if (x := y.strip())] if len(lines) > 1 else []
    chars, common, words = prose.read(text)
    share, of_lines, of_paragraphs, coverage = chars / seen, _repeated(lines), _repeated(paragraphs), top_coverage(words)
    return (seen, common, share, of_lines, of_paragraphs, coverage, kind_of(text, seen, lines, len(words), share, max(of_lines, of_paragraphs), coverage))


def text_statistics(df: DataFrame, id_col: str, text_col: str, common: dict[str, set[str]]) -> DataFrame:
    """(id_col, counts, shares, kind) of each text. Rows of one id are one row: that with the smallest text, nulls last;
    null ids drop out. Null, empty and blank texts have zeros and kind 'empty'. ``prose_share`` is the part of the
    visible characters in running sentences. Other columns are ignored."""
    rows = one_row_each(df.select(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("none"), F.col(text_col).alias("text")), "id", F.min)

    @F.pandas_udf(f"struct<{READ.replace(' long', ':long').replace(' double', ':double').replace(' string', ':string')}>")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        prose = Prose(common)
        for texts in batches:
            yield pd.DataFrame([read(t, prose) for t in texts], columns=[x.split()[0] for x in READ.split(", ")])

    got = rows.select("id", F.coalesce("text", F.lit("")).alias("text"), values(F.col("text")).alias("r"))
    return got.select(F.col("id").alias(id_col), *counts(F.col("text")), *[F.col(f"r.{x.split()[0]}") for x in READ.split(", ")])


def counts(text: Column) -> list[Column]:
    """The plain counts of a text that isn't null, as expressions; all zero where nothing is visible."""
    seen = F.regexp_replace(text, J_UNSEEN, "") != ""
    words = F.regexp_extract_all(text, F.lit(f"({J_WORD})"), F.lit(1))
    n_words = F.size(words)
    letters = F.length(F.array_join(words, ""))
    size = F.greatest(F.length(text), F.lit(1))
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"), lambda x: strip(x) != "")
    of_lines = lambda test: F.when(seen, F.size(F.filter(lines, lambda x: test(strip(x)))) / F.greatest(F.size(lines), F.lit(1))).otherwise(0.0)
    or_zero = lambda c, name: F.when(seen, c).otherwise(F.lit(0)).alias(name)
    return [
        F.length(text).cast("long").alias("n_chars"), or_zero(n_words.cast("long"), "n_words"), or_zero(letters / F.greatest(n_words, F.lit(1)), "mean_word_length"),
        or_zero(F.length(F.regexp_replace(text, J_SYMBOL, "")) / size, "symbol_ratio"), or_zero(F.length(F.regexp_replace(text, r"\P{Nd}+", "")) / size, "digit_ratio"),
        or_zero(F.size(lines).cast("long"), "n_lines"), of_lines(lambda x: F.regexp_like(x, F.lit(J_ENDS))).alias("end_punctuation_share"), of_lines(lambda x: F.regexp_like(x, F.lit(J_MARKER))).alias("list_line_share"),
    ]
