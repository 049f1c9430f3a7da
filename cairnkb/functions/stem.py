"""French stems by the published Snowball description, as rule data and one small machine.

A word's regions decide what may go: RV begins after the first vowel that is not its first
letter (after the third letter where it begins with two vowels), R1 after the first other
letter behind a vowel, R2 likewise within R1. In a word i and u between vowels, y beside one
and u after q count as no vowels; they are written in capitals meanwhile.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

# The description's vowels, endings and replacements.
VOWELS = "aeiouyâàëéêèïîôûù"
#: Endings of the first step: group -> (region that the ending must lie in, what takes its place).
STANDARD = {
    "ance iqUe isme able iste eux ances iqUes ismes ables istes": ("R2", ""),
    "atrice ateur ation atrices ateurs ations": ("R2", ""),
    "logie logies": ("R2", "log"),
    "usion ution usions utions": ("R2", "u"),
    "ence ences": ("R2", "ent"),
    "ement ements": ("RV", ""),
    "ité ités": ("R2", ""),
    "if ive ifs ives": ("R2", ""),
    "eaux": ("", "eau"),
    "aux": ("R1", "al"),
    "euse euses": ("R2", ""),
    "issement issements": ("R1", ""),
    "amment": ("RV", "ant"),
    "emment": ("RV", "ent"),
    "ment ments": ("RV", ""),
}
#: What is looked at once an ending of a group is gone: (ending, its region, replacement, what else if outside the region: region and replacement).
AFTER = {
    "ation": [("ic", "R2", "", ("", "iqU"))],
    "ement": [("ativ", "R2", "", None), ("iv", "R2", "", None), ("eus", "R2", "", ("R1", "eux")), ("abl", "R2", "", None), ("iqU", "R2", "", None), ("ièr", "RV", "i", None), ("Ièr", "RV", "i", None)],
    "ité": [("abil", "R2", "", ("", "abl")), ("ic", "R2", "", ("", "iqU")), ("iv", "R2", "", None)],
    "if": [("icat", "R2", "", None), ("at", "R2", "", None)],
}
VERBS_I = """îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante
issantes issants isse issent isses issez issiez issions issons it"""
VERBS_GO = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
VERBS_E = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"


def _longest(endings: str) -> list[str]:
    return sorted(endings.split(), key=len, reverse=True)


_STANDARD = sorted(((e, names.split()[0], region, new) for names, (region, new) in STANDARD.items() for e in names.split()), key=lambda x: -len(x[0]))
_GROUP = {"atrice": "ation"}
_I, _OTHER = _longest(VERBS_I), _longest(f"ions {VERBS_GO} {VERBS_E}")
_GO, _E = set(VERBS_GO.split()), set(VERBS_E.split())


def marked(word: str) -> str:
    """The word with capitals for the i, u and y that count as no vowels."""
    out = list(word)
    for at, letter in enumerate(word):
        before, after = at > 0 and out[at - 1] in VOWELS, at + 1 < len(word) and word[at + 1] in VOWELS
        if letter in "iu" and before and after or letter == "y" and (before or after) or letter == "u" and at > 0 and word[at - 1] == "q":
            out[at] = letter.upper()
    return "".join(out)


def regions(word: str) -> dict[str, int]:
    """Where RV, R1 and R2 begin."""

    def behind(start: int) -> int:
        found = re.search(f"[{VOWELS}][^{VOWELS}]", word[start:])
        return start + found.end() if found else len(word)

    if re.match(f"[{VOWELS}]{{2}}", word) or re.match("par|col|tap", word):
        rv = min(3, len(word))
    else:
        found = re.search(f"[{VOWELS}]", word[1:])
        rv = 1 + found.end() if found else len(word)
    r1 = behind(0)
    return {"": 0, "RV": rv, "R1": r1, "R2": behind(r1)}


def _standard(word: str, at: dict[str, int]) -> tuple[str, str]:
    """The word after the first step, and the group of the ending that was found."""
    ending, group, region, new = next((x for x in _STANDARD if word.endswith(x[0])), ("", "", "", ""))
    start = len(word) - len(ending)
    if not ending:
        return word, ""
    rest = word[:start]
    if group == "euse" and start < at["R2"]:
        return (rest + "eux" if start >= at["R1"] else word), group
    if group == "issement" and not (start >= at["R1"] and rest[-1:] not in VOWELS):
        return word, group
    if group == "ment" and not (start - 1 >= at["RV"] and rest[-1:] in VOWELS):
        return word, group
    if start < at[region]:
        return word, group
    word = rest + new
    for more, inside, put, other in AFTER.get(_GROUP.get(group, group), []):
        if word.endswith(more):
            cut = len(word) - len(more)
            if more == "ativ" and cut < at["R2"]:
                return (word[:-2] if cut + 2 >= at["R2"] else word), group
            if more == "icat" and cut < at["R2"]:
                return (word[:-4] + "iqU" if cut + 2 >= at["R2"] else word), group
            if cut >= at[inside]:
                return word[:cut] + put, group
            if other and cut >= at[other[0]]:
                return word[:cut] + other[1], group
            return word, group
    return word, group


def _verb(word: str, at: dict[str, int]) -> str:
    rv = word[at["RV"] :]
    ending = next((e for e in _I if rv.endswith(e)), None)
    if ending and len(rv) > len(ending) and rv[-len(ending) - 1] not in VOWELS:
        return word[: -len(ending)]
    ending = next((e for e in _OTHER if rv.endswith(e)), None)
    if ending is None or ending == "ions" and len(word) - 4 < at["R2"]:
        return word
    word = word[: -len(ending)]
    return word[:-1] if ending in _E and word.endswith("e") and len(word) > at["RV"] else word


def _residual(word: str, at: dict[str, int]) -> str:
    if word.endswith("s") and word[-2:-1] not in tuple("aiouès"):
        word = word[:-1]
    rv = word[at["RV"] :]
    if rv.endswith("ion"):
        return word[:-3] if len(word) - 3 >= at["R2"] and rv[-4:-3] in ("s", "t") else word
    for ending in ("ière", "Ière", "ier", "Ier"):
        if rv.endswith(ending):
            return word[: -len(ending)] + "i"
    if rv.endswith("e"):
        return word[:-1]
    return word[:-1] if rv.endswith("ë") and word[:-1].endswith("gu") else word


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    word = marked(word)
    at = regions(word)
    new, group = _standard(word, at)
    changed = new != word
    if not changed or group in ("amment", "emment", "ment"):
        verb = _verb(new, at)
        # the last step obeyed decides: a verb step that leaves the word as it is was obeyed too
        changed, new = verb != new, verb
    if changed:
        new = re.sub("ç$", "c", re.sub("Y$", "i", new))
    else:
        new = _residual(new, at)
    if new.endswith(("enn", "onn", "ett", "ell", "eill")):
        new = new[:-1]
    new = re.sub(f"[éè]([^{VOWELS}]+)$", r"e\1", new)
    return new.lower()


def stems(words: Column) -> Column:
    """The stems of an array of words, in order; each distinct word's is made once a batch (a null array has none)."""
    ship(SparkSession.active())

    @F.arrow_udf("array<string>")
    def of(arrays: pa.Array) -> pa.Array:
        flat = arrays.flatten().dictionary_encode()
        made = pa.array([w if w is None else stem(w) for w in flat.dictionary.to_pylist()], pa.string())
        sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy()
        return _lists(sizes, made.take(flat.indices))

    return of(words)


def with_stems(words: Column, plain: str) -> Column:
    """An array of words and after them, once each, the stems that are not among them of those words that match ``plain`` whole."""
    ship(SparkSession.active())

    @F.arrow_udf("array<string>")
    def of(arrays: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy().astype(np.int64)
        flat = arrays.flatten().dictionary_encode()
        every = {w: i for i, w in enumerate(flat.dictionary.to_pylist())}
        own = len(every)
        fits = re.compile(plain).fullmatch
        stem_of = np.array([every.setdefault(stem(w), len(every)) if w and fits(w) else i for i, w in enumerate(list(every))], np.int64)
        code, row = pc.fill_null(flat.indices, 0).to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        other = np.flatnonzero(stem_of[code] != code) if own else code
        key, first = np.unique(row[other] * len(every) + stem_of[code[other]], return_index=True)
        new = ~np.isin(key, np.unique(row * len(every) + code))
        key = key[new][np.argsort(first[new])]
        more = np.bincount(key // max(1, len(every)), minlength=len(sizes))
        order = np.argsort(np.concatenate([row, key // max(1, len(every))]), kind="stable")
        made = pa.array(list(every), pa.string()).take(pa.array(np.concatenate([code, key % max(1, len(every))])[order]))
        return _lists(sizes + more, made)

    return of(words)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def stemmed(words: DataFrame, column: str = "word") -> DataFrame:
    """``(word, stem)`` of the distinct words of a column."""
    each = words.select(F.col(column).alias("word")).filter("word is not null").distinct()
    return each.select("word", F.get(stems(F.array("word")), F.lit(0)).alias("stem"))
