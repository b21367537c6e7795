"""Syllables of English words from hyphenation-style patterns.

A pattern is letters with digits between them, as in Liang's hyphenation method:
at every place of a word the largest digit of all matching patterns counts. Here
digits stand between two vowels, where an odd one parts them and an even one
keeps them together, and after a vowel that may be mute, where an even one says
that it is. A full stop is the word's beginning or end. The patterns are rules
of English spelling; those with a higher digit are exceptions to those below.
"""

from __future__ import annotations

import re

VOWELS = frozenset("aeiouy")
CONSONANTS = "bcdfghjklmnpqrstvwxz"

#: Two vowels that belong to two syllables, as a rule, and where they do not.
PARTED = """
i1a i1o i1u e1o u1a u1o a1o i1i
ti2on si2on ci2on gi2on xi2on ti2ous ci2ous gi2ous ti2a ci2al ci2an gi2an ri2age li2on ni2on .li3on shi2on si2ast
gu2a su2ade su2av pe2opl ge2on ge2ous le2opar je2op
i1ety i1enc ti2ence ci2ence sci3en .consci4en i1ent ti2ent ci2ent di1et qui1et i1er. i1est. .pi2er .ti2er ldi2er shi2er nti2er pri2est li1en.
cre1at cre1as pancre3as incre2as .cre2as decre2as .cre2am re1act re1ali re1all ide1a are1a nause1a ine1ar nucle1ar ure1a rrhe1a trache1a the1at
e1ing be1ing e1um e1us re1inf re1ins re1int .re2ins de1it nucle1i ste1o
o1em o1ech po1et co1ef o1ing o1ic. o1ics. co1inc ego1i hero1in co1ag co1ac .o1as co1op co1ord .o1oph o1oph zo1ol o1eff
la1it mosa1ic archa1ic na1iv a1erob
ru1el lu1enc lu1ent fu1el du1et gru1el cru1el lu1id u1ity gu3ity nu1in tu1it su1ic ru1in u1ish. flu1or
y1a y1e y1i y1o y1u .y2a .y2e .y2i .y2o .y2u .ey2e eye2s
"""
#: Final e, es and ed: mute as a rule, and where they are spoken.
MUTE = """
e2. e2s. e2d. se3s. xe3s. ze3s. ce3s. ge3s. che3s. she3s. ache4s. te3d. de3d.
recipe3. simile3. trophe3. epitome3. perbole3. acne3. nemone3. ncope3. .karate3. .cafe3. .finale3. .sesame3. raphe3.
nake3d. wicke3d. .sacre3d. ndre3d. hatre3d. rugge3d. .ragge3d. .crooke3d. infrare3d. .biase3s. .argue3.
e2ment. le3ment ce3ment. .ance2ment nce4ment. ace4ment. cre3ment e2ments. e2ful e2less e2ly. e2ness some2t some2w some2b some2o some2d there2f there2b where2v e2where e2body e2thing e2work
"""
#: A consonant before m at the end of a word makes a syllable of its own.
SYLLABIC_M = re.compile(r"(?:s|th)ms?$")


def _table() -> tuple[dict[str, tuple[tuple[int, int], ...]], int]:
    spoken_le = [f"{c}le3{end}" for c in CONSONANTS if c not in "lrw" for end in (".", "s.", "d.")]
    table: dict[str, tuple[tuple[int, int], ...]] = {}
    for pattern in (PARTED + MUTE).split() + spoken_le:
        letters, digits = "", []
        for sign in pattern:
            if sign.isdigit():
                digits.append((len(letters), int(sign)))
            else:
                letters += sign
        table[letters] = (*table.get(letters, ()), *digits)
    return table, max(map(len, table))


_TABLE, _LONGEST = _table()


def _silent_u(marked: str, i: int) -> bool:
    """u after q, and u that keeps a g hard before e or i, is no vowel of its own."""
    return marked[i] == "u" and (marked[i - 1] == "q" or (marked[i - 1] == "g" and marked[i + 1] in "ei" and not marked.startswith("ity", i + 1)))


def syllables(word: str) -> int:
    """Syllables of a lower-case word of ASCII letters, 1 at least. Works through the whole word in linear time."""
    marked = f".{word}."
    value = [0] * (len(marked) + 1)
    for start in range(len(marked)):
        for end in range(start + 2, min(start + _LONGEST, len(marked)) + 1):
            for place, digit in _TABLE.get(marked[start:end], ()):
                if digit > value[start + place]:
                    value[start + place] = digit
    total, before = 0, False
    for i in range(1, len(marked) - 1):
        vowel = marked[i] in VOWELS and not _silent_u(marked, i)
        if vowel:
            after = marked[i + 1] in VOWELS
            if not before or value[i] % 2 == 1:
                total += 1
                # a nucleus that is this one letter is mute if the place after it says so
                if not after and marked[i] == "e" and value[i + 1] and value[i + 1] % 2 == 0:
                    total -= 1
        before = vowel
    if SYLLABIC_M.search(word):
        total += 1
    return max(1, total)
