"""Organisation names: normalisation, legal forms and phonetic keys."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparkledger.functions.text import jaccard, trigrams, words_of
from sparkledger.storage import ship_package

# fixed values: which words name a legal form, and how words are written
US_FORMS = ("co", "company", "corp", "corporation", "inc", "incorporated", "llc", "llp", "lp")
FOREIGN_FORMS = ("ag", "bv", "gmbh", "kg", "ltd", "nv", "plc", "pte", "pty", "pvt", "sa", "sarl")
SPELLED_OUT = ("llc", "llp", "lp", "sa", "bv", "nv", "pte", "pvt")
REWRITES = {"and": "&", "pharmaceutical": "pharma", "pharmaceuticals": "pharma", "laboratories": "labs", "laboratory": "labs", "mfg": "manufacturing", "usa": "us", "u": "us", "limited": "ltd"}
LEFT_OUT = (*US_FORMS, "the")


def _dotted(word: str) -> str:
    """A pattern for the letters of a word with full stops and spaces between them."""
    return r"\b" + r"\.?\s*".join(word) + r"\.?\b"


def ascii_fold(c: Column) -> Column:
    """Without accents and other characters that ASCII lacks."""

    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())

    # most names are ASCII already and need not leave the JVM for that; folding is for the rest
    return F.when(c.rlike(r"[^\x00-\x7F]"), pandas_udf(fold, "string")(c)).otherwise(c)


def name_tokens(folded: Column) -> Column:
    """Lower-case words of an ASCII name, spelled-out legal forms joined."""
    text = F.regexp_replace(F.lower(folded), "&", " and ")
    text = F.regexp_replace(text, r"\bu\.?\s*s\.?\s*a\.?\b", " usa ")
    for form in SPELLED_OUT:
        text = F.regexp_replace(text, _dotted(form), f" {form} ")
    return words_of(F.regexp_replace(text, "[^a-z0-9]+", " "))


def _mapped(word: Column, table: dict[str, str]) -> Column:
    out = F.when(F.lit(False), word)
    for a, b in table.items():
        out = out.when(word == a, b)
    return out.otherwise(word)


def normalize_name(folded: Column) -> Column:
    """A name without US legal forms and articles, its words rewritten; foreign legal forms stay."""
    kept = F.filter(F.transform(name_tokens(folded), lambda w: _mapped(w, REWRITES)), lambda w: ~w.isin(*LEFT_OUT))
    return F.array_join(kept, " ")


def foreign_forms(folded: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(name_tokens(folded), lambda w: _mapped(w, {"limited": "ltd"})), lambda w: w.isin(*FOREIGN_FORMS))))


def us_forms(folded: Column) -> Column:
    return F.array_distinct(F.filter(name_tokens(folded), lambda w: w.isin(*US_FORMS)))


def token_key(normalized: Column) -> Column:
    """Distinct words in order, joined."""
    return F.array_join(F.array_sort(F.array_distinct(words_of(normalized))), " ")


def form_conflict(left_foreign: Column, left_us: Column, right_foreign: Column, right_us: Column) -> Column:
    """Why two names of different spelling can't be one entity by their legal forms, or null."""
    some = lambda a: F.size(a) > 0
    mixed = (some(left_foreign) & some(right_us)) | (some(right_foreign) & some(left_us))
    other = some(left_foreign) & some(right_foreign) & (left_foreign != right_foreign)
    return F.when(mixed, "foreign and US legal forms").when(other, "different foreign legal forms")


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(words_of(a)), F.array_distinct(words_of(b)))


def similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def _word_grams(text: str) -> list[str]:
    out = []
    for w in re.findall("[a-z0-9]+", (text or "").lower()):
        padded = f"  {w} "
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


def word_similarity_of(a: str, b: str) -> float:
    """The greatest share that a's trigrams reach with those of any contiguous extent of b's trigram sequence."""
    own, seq = set(_word_grams(a)), _word_grams(b)
    if not own or not seq:
        return 0.0
    best = 0.0
    hits = [i for i, g in enumerate(seq) if g in own]
    for x, i in enumerate(hits):
        seen: set[str] = set()
        shared = 0
        last = i
        for j in hits[x:]:
            for g in seq[last : j + 1]:
                if g not in seen:
                    seen.add(g)
                    shared += g in own
            last = j + 1
            best = max(best, shared / len(own | seen))
    return best


def word_similarity(a: Column, b: Column) -> Column:
    """word_similarity_of() as a column."""
    ship_package()
    run = lambda a, b: pd.Series([word_similarity_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
    return pandas_udf(run, "double")(a, b)


def metaphone_of(word: str, size: int = 8) -> str:
    """A phonetic key by the published Metaphone rules: consonant sounds, vowels only in front."""
    w = re.sub(r"([^c])\1+", r"\1", re.sub("[^a-z]", "", (word or "").lower()))
    for start, rest in (("ae", "e"), ("gn", "n"), ("kn", "n"), ("pn", "n"), ("wr", "r"), ("x", "s"), ("wh", "w")):
        if w.startswith(start):
            w = rest + w[len(start) :]
            break
    vowels, out, i = "aeiou", [], 0
    at = lambda k: w[k] if 0 <= k < len(w) else ""
    while i < len(w) and len(out) < size:
        c, after, step = w[i], at(i + 1), 1
        if c in vowels:
            if i == 0:
                out.append(c.upper())
        elif c == "b":
            if not (i == len(w) - 1 and at(i - 1) == "m"):
                out.append("B")
        elif c == "c":
            if w[i : i + 3] == "cia" or after == "h":
                out.append("K" if after == "h" and at(i - 1) == "s" else "X")
                step = 2 if after == "h" else 1
            elif after and after in "iey":
                if at(i - 1) != "s":
                    out.append("S")
            else:
                out.append("K")
        elif c == "d":
            if after == "g" and at(i + 2) and at(i + 2) in "eyi":
                out.append("J")
                step = 2
            else:
                out.append("T")
        elif c == "g":
            if after == "h" and at(i + 2) not in tuple(vowels):
                pass
            elif after == "n" and (i + 2 == len(w) or w[i:] == "gned"):
                pass
            elif after and after in "iey":
                out.append("J")
            else:
                out.append("K")
        elif c == "h":
            if after and after in vowels and at(i - 1) not in ("c", "s", "p", "t", "g"):
                out.append("H")
        elif c == "k":
            if at(i - 1) != "c":
                out.append("K")
        elif c == "p":
            out.append("F" if after == "h" else "P")
            step = 2 if after == "h" else 1
        elif c == "q":
            out.append("K")
        elif c == "s":
            if after == "h" or w[i : i + 3] in ("sio", "sia"):
                out.append("X")
                step = 2 if after == "h" else 1
            else:
                out.append("S")
        elif c == "t":
            if w[i : i + 3] in ("tia", "tio"):
                out.append("X")
            elif after == "h":
                out.append("0")
                step = 2
            elif w[i : i + 3] != "tch":
                out.append("T")
        elif c == "v":
            out.append("F")
        elif c in "wy":
            if after and after in vowels:
                out.append(c.upper())
        elif c == "x":
            out += ["K", "S"]
        elif c == "z":
            out.append("S")
        else:
            out.append(c.upper())
        i += step
    return "".join(out)[:size]


def metaphone(word: Column | str) -> Column:
    """metaphone_of() as a column."""
    ship_package()
    return pandas_udf(lambda words: words.map(metaphone_of), "string")(word)


def normalize_names(raw: Iterable[str]) -> list[str]:
    """normalize_name() of a few names without a session, for validation on the driver."""
    out = []
    for name in raw:
        text = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower().replace("&", " and ")
        text = re.sub(r"\bu\.?\s*s\.?\s*a\.?\b", " usa ", text)
        for form in SPELLED_OUT:
            text = re.sub(_dotted(form), f" {form} ", text)
        words = (REWRITES.get(w, w) for w in re.findall("[a-z0-9]+", text))
        out.append(" ".join(w for w in words if w not in LEFT_OUT))
    return out
