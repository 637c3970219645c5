"""English stems of words, by the published English (Porter2) Snowball algorithm."""

from __future__ import annotations

import re

# The algorithm's letters, endings and exceptions, and the stop words of the english configuration.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
VALID_LI = "cdeghkmnrt"
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first non-vowel that follows a vowel, and again from there."""

    def after(start: int) -> int:
        m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, start)
        return m.end() if m else len(word)

    known = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = known if known is not None else after(0)
    return r1, after(r1)


def _short(word: str, r1: int) -> bool:
    """Whether a word ends in a short syllable and has nothing in R1."""
    return r1 >= len(word) and bool(re.search(f"(?:[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])$", word))


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _step1b(word: str, r1: int) -> str:
    end = _longest(word, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if end in ("eed", "eedly"):
        return word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    stem = word[: len(word) - len(end)]
    if not end or not re.search(f"[{VOWELS}]", stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem.endswith(DOUBLES):
        return stem[:-1]
    return stem + "e" if _short(stem, r1) else stem


def _step2(word: str, r1: int) -> str:
    end = _longest(word, (*STEP2, "ogi", "li"))
    stem = word[: len(word) - len(end)]
    if not end or len(stem) < r1:
        return word
    if end == "ogi":
        return stem + "og" if stem.endswith("l") else word
    if end == "li":
        return stem if stem[-1:] in tuple(VALID_LI) else word
    return stem + STEP2[end]


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in EXCEPTIONS or word in INVARIANT:
        return EXCEPTIONS.get(word, word)
    word = re.sub(f"(^|[{VOWELS}])y", r"\1Y", word.removeprefix("'"))
    r1, r2 = _regions(word)
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and re.search(f"[{VOWELS}]", word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word.lower()
    word = _step1b(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _step2(word, r1)
    end = _longest(word, (*STEP3, "ative"))
    if end and len(word) - len(end) >= r1:
        if end != "ative":
            word = word[: -len(end)] + STEP3[end]
        elif len(word) - 5 >= r2:
            word = word[:-5]
    end = _longest(word, (*STEP4, "ion"))
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short(word[:-1], 0 if len(word) < 2 else len(word)))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def lexeme(term: str) -> str:
    """The stem of a lower-case term, or nothing for a stop word."""
    return "" if term in STOP_WORDS else stem(term)
