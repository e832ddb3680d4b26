"""The Porter2 English stemmer, after its published description, and English stop words."""

from __future__ import annotations

import re
from functools import lru_cache

#: English stop words.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
    just don should now""".split()
)
#: Words with stems of their own.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffixes of the second and third step and what replaces them in the first region.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
VOWEL, CONSONANT = "[aeiouy]", "[^aeiouy]"


def _region(word: str) -> int:
    """Where the part behind the first vowel and consonant begins."""
    m = re.search(f"{VOWEL}{CONSONANT}", word)
    return m.end() if m else len(word)


def _ends_short(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word))


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = word.removeprefix("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = _region(word) if start is None else start
    r2 = r1 + _region(word[r1:])
    word = re.sub(r"'s'$|'s$|'$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"{VOWEL}.*.s$", word):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    if m := re.search(r"(eedly|eed)$", word):
        if m.start() >= r1:
            word = word[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", word)) and re.search(VOWEL, word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _ends_short(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and re.match(CONSONANT, word[-2]):
        word = word[:-1] + "i"
    for suffix in sorted([*STEP2, "ogi", "li"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r1:
                if suffix == "ogi":
                    word = word[:-1] if word[:at].endswith("l") else word
                elif suffix == "li":
                    word = word[:at] if at and word[at - 1] in "cdeghkmnrt" else word
                else:
                    word = word[:at] + STEP2[suffix]
            break
    for suffix in sorted([*STEP3, "ative"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if suffix == "ative":
                word = word[:at] if at >= r2 else word
            elif at >= r1:
                word = word[:at] + STEP3[suffix]
            break
    for suffix in sorted([*STEP4, "ion"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r2 and (suffix != "ion" or word[:at].endswith(("s", "t"))):
                word = word[:at]
            break
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not _ends_short(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
