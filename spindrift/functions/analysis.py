"""Analysers: how a text becomes terms, the same for an index, its questions and filters on names."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

# Words that an English index leaves out.
ENGLISH_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not",
    "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

# The suffix rules of Porter's published algorithm, by step.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """``c`` for every consonant and ``v`` for every vowel; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return shape(stem).count("vc")


def short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last one not w, x or y."""
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def longest_suffix(word: str, suffixes: Iterable[str]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two characters are their own."""
    if len(word) < 3:
        return word
    # Plurals.
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Past and progressive forms.
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        end = longest_suffix(word, ("ed", "ing"))
        if end and "v" in shape(word[: -len(end)]):
            word = word[: -len(end)]
            if word[-2:] in ("at", "bl", "iz"):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and short_end(word):
                word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    # Derived forms.
    for rules in (STEP2, STEP3):
        end = longest_suffix(word, rules)
        if end and measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + rules[end]
    end = longest_suffix(word, STEP4)
    stem = word[: -len(end)] if end else word
    if end and measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
        word = stem
    # What is left of a last e, and a double l.
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or m == 1 and not short_end(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


#: Words whose stems a worker keeps.
KEPT = 200_000


@dataclass
class Analyser:
    """Runs of ``[a-z0-9]`` of the lower-cased text; ``english`` leaves out stop words and possessive s, and stems the rest."""

    english: bool = False
    stems: dict[str, str] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"english": self.english, "stems": {}}

    def terms(self, text: str | None) -> list[str | None]:
        """The term at each word's position; None where a word is left out."""
        lowered = (text or "").lower()
        if not self.english:
            return re.findall("[a-z0-9]+", lowered)
        found = re.findall("[a-z0-9]+", re.sub("'s([^a-z0-9]|$)", r" \1", lowered))
        if len(self.stems) > KEPT:
            self.stems.clear()
        stems, stop = self.stems, ENGLISH_STOPWORDS
        for w in set(found).difference(stems):
            stems[w] = None if w in stop else porter(w)
        return [stems[w] for w in found]


PLAIN, ENGLISH = Analyser(), Analyser(english=True)
