"""English stop words and the published Snowball English stemming rules, for distinct words only."""

from __future__ import annotations

#: The stop words of English full-text search.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or because as until while of at by for with
    about against between into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now""".split()
)
#: Words with a stem of their own, and words that stay.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STAY = frozenset("sky news howe atlas cosmos bias andes".split())
STAY_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Suffixes and what replaces them, the longest that fits first, in the region given.
STEP_2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and the same again."""

    def after(i: int) -> int:
        while i < len(w) and w[i] not in VOWELS:
            i += 1
        while i < len(w) and w[i] in VOWELS:
            i += 1
        return min(i + 1, len(w))

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS + "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    if w in STAY:
        return w
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in STAY_1A:
        return w.lower()
    # past and progressive forms
    for suffix in ("eedly", "eed"):
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + "ee"
            break
    else:
        for suffix in ("ingly", "edly", "ing", "ed"):
            if w.endswith(suffix):
                rest = w[: -len(suffix)]
                if any(c in VOWELS for c in rest):
                    if rest.endswith(("at", "bl", "iz")):
                        rest += "e"
                    elif rest.endswith(DOUBLES):
                        rest = rest[:-1]
                    elif _short_end(rest) and r1 >= len(rest):
                        rest += "e"
                    w = rest
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # derivations
    for suffix, new in STEP_2:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for suffix, new in STEP_3:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for suffix in STEP_4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2:
                w = w[: -len(suffix)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()
