"""The Porter and Paice/Husk stemmers, from their published definitions, as vectorised functions of tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix tables of the algorithm's steps 2, 3 and 4.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(stem: str) -> str:
    """Consonants and vowels of a stem as c and v; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif _doubled(cut) and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP_2, _STEP_3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP_4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def porter_stem(token: Column) -> Column:
    """Stems of a token column; give it distinct tokens, it costs Python time."""

    @F.pandas_udf("string")
    def stem(tokens: pd.Series) -> pd.Series:
        return tokens.map(porter, na_action="ignore")

    return stem(token)


# The published Paice/Husk rules. A reversed ending, "*" if the word must be whole, how many letters go,
# what comes instead, and ">" to go on or "." to stop.
PAICE_HUSK = (
    "ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct. hsi3> i*1. i1y> "
    "ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1. "
    "mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> "
    "ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. "
    "vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s."
)


def _paice_rules(text: str) -> list[tuple[str, bool, int, str, bool]]:
    out = []
    for rule in text.split():
        m = re.fullmatch(r"([a-z]+)(\*?)(\d)([a-z]*)([.>])", rule)
        out.append((m[1][::-1], bool(m[2]), int(m[3]), m[4], m[5] == ">"))
    return out


def paice_husk(word: str, rules: str = PAICE_HUSK) -> str:
    """The stem of a lower-case word by rules that are applied until one says stop or none fits.

    A stem keeps a vowel or y: two letters if it starts with a vowel, else three.
    """
    by_end: dict[str, list] = {}
    for rule in _paice_rules(rules):
        by_end.setdefault(rule[0][-1], []).append(rule)
    whole, now = True, word
    while now:
        for ending, only_whole, n, more, on in by_end.get(now[-1], ()):
            if not now.endswith(ending) or only_whole and not whole:
                continue
            new = now[: len(now) - n] + more
            if n and not (len(new) >= 2 if new[:1] in "aeiou" and new else len(new) >= 3 and any(c in "aeiouy" for c in new)):
                continue
            whole = whole and new == now
            now = new
            break
        else:
            return now
        if not on:
            return now
    return now


def longest_ending(word: str, endings: dict[str, Callable[[str], bool] | None], recode: Sequence[tuple[str, str]] = ()) -> str:
    """The stem after the longest ending that leaves two letters and whose condition holds, then one recoding of the stem's end.

    The method of Lovins, whose table of endings is a parameter: each ending
    with a condition on the stem, or none.
    """
    for n in range(min(11, len(word) - 2), 0, -1):
        ending = word[-n:]
        if ending in endings and (endings[ending] is None or endings[ending](word[:-n])):
            word = word[:-n]
            break
    if len(word) > 2 and word[-1] == word[-2] and word[-1] in "bdglmnprst":
        word = word[:-1]
    for old, new in recode:
        if word.endswith(old):
            return word[: len(word) - len(old)] + new
    return word


def paice_husk_stem(token: Column) -> Column:
    """Paice/Husk stems of a token column; give it distinct tokens."""

    @F.pandas_udf("string")
    def stem(tokens: pd.Series) -> pd.Series:
        return tokens.map(paice_husk, na_action="ignore")

    return stem(token)
