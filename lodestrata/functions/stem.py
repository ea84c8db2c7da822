"""English stems by the Snowball project's published algorithm (Porter 2), and its stop words."""

from __future__ import annotations

import functools
import re

# Words that are neither indexed nor searched for.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now""".split()

# Words whose stems are given, and, after the plural is off, words that stay.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SPECIAL |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
STAY = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# Beginnings that end the part before R1.
LONG = ("gener", "commun", "arsen")
# Endings and what takes their place, by step; those of steps 2 and 3 within R1, of step 4 within R2.
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive",
    "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
#: Endings that need more than their region: what has to stand before them.
BEFORE = {"ogi": "l", "li": "[cdeghkmnrt]", "ion": "[st]"}
# Letters as the algorithm names them; Y is a y that is no vowel.
VOWEL, DOUBLE = "[aeiouy]", "bb|dd|ff|gg|mm|nn|pp|rr|tt"
_REGION = re.compile(f".*?{VOWEL}[^aeiouy]")
_FIRST = re.compile(f"{'|'.join(LONG)}|.*?{VOWEL}[^aeiouy]")
#: A short syllable at the end.
SHORT = f"(?:^{VOWEL}[^aeiouy]|[^aeiouy]{VOWEL}[^aeiouywxY])$"
_SHORT, _VOWEL, _DOUBLE = re.compile(SHORT), re.compile(VOWEL), re.compile(f"(?:{DOUBLE})$")
_WORD, _VOWEL_Y, _OWN = re.compile("[a-z']+"), re.compile(f"({VOWEL})y"), re.compile(r"(?:'s'|'s|')$")
_BEFORE = {end: re.compile(f"{x}$") for end, x in BEFORE.items()}
#: The last two letters of the endings of steps 2 to 4: most words have none of them.
_TAILS = {id(rules): frozenset(end[-2:] for end in rules) for rules in (STEP2, STEP3, STEP4)}


def _ending(w: str, endings) -> str | None:
    """The longest of some endings that the word has."""
    return next((w[-n:] for n in range(min(7, len(w)), 0, -1) if w[-n:] in endings), None)


def _replace(w: str, rules: dict[str, str], start: int) -> str:
    """The longest ending replaced, if it lies from `start` on and after what it needs."""
    if w[-2:] not in _TAILS[id(rules)]:
        return w
    end = _ending(w, rules)
    if end is None or len(w) - len(end) < start or (end in BEFORE and not _BEFORE[end].search(w[: -len(end)])):
        return w
    return w[: -len(end)] + rules[end]


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other letters than a-z stay."""
    if len(word) <= 2 or not _WORD.fullmatch(word):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = _OWN.sub("", word.removeprefix("'")) if "'" in word else word
    if "y" in w:
        w = _VOWEL_Y.sub(r"\1Y", "Y" + w[1:] if w[0] == "y" else w)
    m = _FIRST.match(w)
    r1 = m.end() if m else len(w)
    m = _REGION.match(w, r1)
    r2 = m.end() if m else len(w)
    # plurals
    end = _ending(w, ("sses", "ied", "ies", "us", "ss", "s")) if w.endswith(("s", "d")) else None
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in STAY:
        return w
    # past and progressive forms
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly")) if w.endswith(("ed", "ly", "ng")) else None
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    w = _replace(w, STEP2, r1)
    if not (w.endswith("ative") and len(w) - 5 < r2):
        w = _replace(w, STEP3, r1)
    w = _replace(w, STEP4, r2)
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")
