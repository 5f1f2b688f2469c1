"""Text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuematch import fixed_values as fv

# Characters cut by strip(): Unicode white space and the four separators 1C-1F.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# A noncharacter, reserved for internal marks and never part of a text.
_MARK = "\ufdd0"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def normalize_whitespace(c: Column) -> Column:
    """Unix line ends, single blanks, at most one empty line, no outer blanks."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def file_stem(name: Column) -> Column:
    last = F.element_at(F.split(name, "/"), -1)
    return F.regexp_replace(last, r"^(.+)\.[^.]+$", "$1")


def episode_number(name: Column) -> Column:
    """First run of up to six digits in the file stem; NULL when there is none."""
    digits = F.regexp_extract(file_stem(name), r"([0-9]{1,6})", 1)
    return F.when(digits != "", digits.cast("int"))


def split_scenes(text: Column, header: str = fv.SCENE_HEADER) -> Column:
    """Scenes of a text, each from its header up to the next one.

    Text before the first header is dropped, pieces are stripped and empty
    ones left out. Works on the row's own text: no shuffle. Headers are found
    case-insensitively, per line; ``header`` is a Java pattern.
    """
    marked = F.regexp_replace(text, f"(?midU){header}", _MARK + "$0")
    pieces = F.split(marked, _MARK)
    scenes = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), strip)
    return F.filter(scenes, lambda s: s != "")


def header_keyword(header: str) -> str:
    """First word of two or more capitals in the pattern, for messages."""
    words = re.findall(r"[A-Z]{2,}", header)
    return words[0] if words else header


def words(c: Column) -> Column:
    """Tag name as words: underscores become blanks."""
    return F.replace(c, F.lit("_"), F.lit(" "))


def title_case(c: Column) -> Column:
    """Words with a capital after every character that is no letter, such as a hyphen, a digit or an apostrophe."""
    pieces = F.split(F.lower(words(c)), r"(?<=\P{L})")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def tag_prompts(category: Column, name: Column) -> Column:
    """Three sentences describing a tag."""
    prompts = []
    for template in fv.TAG_PROMPT_TEMPLATES:
        pieces = re.split(r"(\{tag\}|\{category\})", template)
        parts = [
            words(name) if p == "{tag}" else words(category) if p == "{category}" else F.lit(p)
            for p in pieces
            if p
        ]
        prompts.append(F.concat(*parts))
    return F.array(*prompts)
