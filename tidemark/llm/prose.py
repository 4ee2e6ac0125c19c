"""How much of a text is running sentences, and simple counts of its words, symbols and lines."""

from __future__ import annotations

import re

# Common English and Spanish words of two letters and more.
COMMON_WORDS = frozenset(
    """
    the of and to in is that for it on as with was at by from but be are this have has had not they he she his her its their
    we our you your which were or an who said will would could should can may than after when what how no one there
    been if so up out about into over also only most some any all other before because while where between during until per
    did do does does had him them these those then just back them many much made make last same
    el la los las de del que en por se un una con para no es al lo su sus como pero si más ya muy este esta estos estas
    son fue han hay había según entre sobre desde hasta cuando donde todo todos también porque puede pueden sin dijo
    """.split()
)

_is_common = COMMON_WORDS.__contains__

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TAG = re.compile(r"<[^<>]*>")
_BULLET = re.compile(r"^(?:[-*•·–—▪◦‣]|\(?\d{1,3}[.)]|[a-zA-Z][.)])\s+")
_QUOTE = re.compile(r"^(?:>\s*)+|^(?:Q|A|P|R):\s+")
_END = re.compile(r"[.!?…:][\"'”’»)\]]*$")
_STOP = re.compile(r"[.!?…][\"'”’»)\]]*$")

#: A line of running sentences has at least this share of common words, and of letters and blanks.
COMMON_SHARE, PLAIN_SHARE, MIN_WORDS = 0.14, 0.72, 4


def lines_of(text: str) -> list[str]:
    """The lines of a text with mixed line ends, without white space around them."""
    return [x.strip("\ufeff \t\u00a0").strip() for x in text.splitlines()]


def words_of(line: str) -> list[str]:
    """The words of a line in lower case."""
    return WORD.findall(line.lower())


def running(line: str, words: list[str]) -> bool:
    """Whether a line with its words reads, by itself, as running sentences."""
    if len(words) < MIN_WORDS:
        return False
    bare = _QUOTE.sub("", line)
    item = _BULLET.match(bare)
    if item:
        bare = bare[item.end() :]
        if not _STOP.search(bare):
            return False
    if bare is not line or "<" in line:
        words = words_of(_TAG.sub(" ", bare))
        if len(words) < MIN_WORDS:
            return False
    plain = sum(map(len, words)) + bare.count(" ")
    if plain < PLAIN_SHARE * len(bare):
        return False
    common = sum(map(_is_common, words))
    return common >= COMMON_SHARE * len(words) and common >= 1


def prose_chars(lines: list[str], words: list[list[str]]) -> tuple[int, int]:
    """Characters in running sentences, and characters of all lines, white space around lines not counted.

    A short or bare line goes with a running line before it that breaks off in mid-sentence.
    """
    inside = total = 0
    open_before = False
    for line, own in zip(lines, words, strict=True):
        n = len(line)
        if not n:
            open_before = False
            continue
        total += n
        yes = running(line, own)
        if not yes and open_before:
            plain = sum(map(len, own)) + line.count(" ")
            follows = line[0].islower() or bool(_STOP.search(line)) and not _BULLET.match(line)
            yes = follows and plain >= 0.6 * n
        if yes:
            inside += n
        open_before = yes and not _STOP.search(line)
    return inside, total


def prose_share(text: str) -> float:
    """The share of a text's characters in running sentences; zero for a text without any."""
    lines = [x for x in lines_of(text) if x]
    inside, total = prose_chars(lines, [words_of(x) for x in lines])
    return inside / total if total else 0.0


STATISTICS = ("words", "mean_word_length", "symbol_ratio", "digit_ratio", "lines", "ended_line_share", "common_word_share", "short_line_share", "longest_word")


def statistics(text: str) -> list[float]:
    """The values of STATISTICS; a text without words or lines has zeros."""
    words, lines = words_of(text), [x for x in lines_of(text) if x]
    lengths = list(map(len, words))
    letters, n, m = sum(lengths), len(words), len(lines)
    solid, digits = sum(map(len, text.split())), sum(map(text.count, "0123456789"))
    return [
        float(n),
        letters / n if n else 0.0,
        max(solid - letters - digits, 0) / solid if solid else 0.0,
        digits / solid if solid else 0.0,
        float(m),
        sum(1 for x in lines if _END.search(x)) / m if m else 0.0,
        sum(map(_is_common, words)) / n if n else 0.0,
        sum(1 for x in lines if len(x) < 40) / m if m else 0.0,
        float(max(lengths, default=0)),
    ]
