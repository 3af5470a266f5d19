"""The Porter2 (English Snowball) stemmer, from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# The algorithm's exceptional forms and suffix tables.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()

ENDS2, ENDS3, ENDS4 = tuple(STEP2), tuple(STEP3), tuple(STEP4)
LAST = frozenset("'\nsdgy") | {end[-1] for end in (*ENDS2, *ENDS3, *ENDS4)} | set("el")  # of all words that a step changes
VOWEL, VOWEL_OTHER = re.compile(f"[{VOWELS}]"), re.compile(f"[{VOWELS}][^{VOWELS}]")
Y_AFTER_VOWEL, POSSESSIVE = re.compile(f"(?<=[{VOWELS}])y"), re.compile("('s'|'s|')$")
EED, ED_ING = re.compile("(eedly|eed)$"), re.compile("(ingly|edly|ing|ed)$")
SHORT_END = re.compile(f"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$")


def regions(w: str) -> tuple[int, int]:
    start = 0
    for head in ("gener", "commun", "arsen"):
        if w.startswith(head):
            start = len(head)
            break
    else:
        m = VOWEL_OTHER.search(w)
        start = m.end() if m else len(w)
    m = VOWEL_OTHER.search(w, start)
    return start, m.end() if m else len(w)


def short_end(w: str) -> bool:
    return bool(SHORT_END.search(w)) or bool(VOWEL_OTHER.fullmatch(w))


def porter2(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    if w[-1] not in LAST:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    if w in SAME:
        return w
    if w.startswith("y"):
        w = "Y" + w[1:]
    if "y" in w:
        w = Y_AFTER_VOWEL.sub("Y", w)
    r1, r2 = regions(w)
    if "'" in w:
        w = POSSESSIVE.sub("", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    if "eed" in w and (m := EED.search(w)):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif ("ing" in w or "ed" in w) and (m := ED_ING.search(w)) and VOWEL.search(w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for end, new in STEP2.items() if w.endswith(ENDS2) else ():
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1] == "l") and (end != "li" or w[at - 1] in "cdeghkmnrt"):
                w = w[:at] + new
            break
    for end, new in STEP3.items() if w.endswith(ENDS3) else ():
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                w = w[:at] + new
            break
    for end in STEP4 if w.endswith(ENDS4) else ():
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1] in "st"):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """Words of two bytes or fewer and hyphenated words pass through."""
    return word if len(word.encode()) <= 2 or "-" in word else porter2(word)
