"""Texts garbled by decoding with a wrong character encoding.

For every pair of a true encoding and one it was wrongly read as, and for repeated misreadings, the garbled
form of every character that the texts' languages use is computed beforehand. An Aho-Corasick automaton finds
all of them in one pass over a text. A garbled form may also be proper text (a capital before a quotation
mark, a foreign letter), so each hit is held against its surroundings: the word it stands in must be one that
proper text cannot have, and its repair one that it can. Only the spans that pass are replaced; text between
them stays untouched. A text of which every letter belongs to one alphabet, and stands where letters of it stand, is
correct, whichever of the world's languages it is in; and single bytes taken for others count only in texts with words
that no language has. Documents are independent of each other: nothing is shuffled or collected.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The letters beyond ASCII of each language's alphabet, small ones.
ALPHABETS = {
    "de": "äöüß",
    "fr": "àâçéèêëîïôœùûü",
    "pl": "ąćęłńóśźż",
    "pt": "àáâãçéêíóôõú",
    "bg": "абвгдежзийклмнопрстуфхцчшщъьюя",
}
# The letters beyond ASCII of more alphabets, by which correct texts in other languages are known.
OTHER_ALPHABETS = (
    "áéíñóúüªº", "àçèéíïòóúü", "áčďéěíňóřšťúůýž", "áäčďéíĺľňóôŕšťúýž", "áéíóöőúüű", "ăâîșțşţ", "çğıöşüâîûİ", "åäöæøéèüàóô",
    "áðéíóúýþæö", "ąčęėįšųūž", "āčēģīķļņšūž", "äõöüšž", "čćđšž", "āēīōū", "âêîôûŵŷ", "ċġħżàèìòù", "ĉĝĥĵŝŭ", "àèéìíîòóùú",
    "áéëèïóöüĳ", "áéíóúñẽĩõũ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "абвгдеёжзійклмнопрстуўфхцчшыьэюя",
    "абвгдђежзијклљмнњопрстћуфхцчџш", "абвгдѓежзѕијклљмнњопрстќуфхцчџш", "αάβγδεέζηήθιίϊΐκλμνξοόπρσςτυύϋΰφχψωώ",
    "àáâãèéêìíòóôõùúýăđĩũơư" + "".join(map(chr, range(0x1EA1, 0x1EFA, 2))),
)
# Letters of names, which stand in texts of any language.
NAME_LETTERS = "áéöü"
MARKS = "‘’“”„–—…«»€£§°©®™·¿¡½¼¾²³±×\xa0\xad"
COMBINING = "̧̨̀́̂̃̆̇̈"

SMALL = "".join(dict.fromkeys("".join(ALPHABETS.values()) + NAME_LETTERS))
LETTERS = SMALL + "".join(c.upper() for c in SMALL if len(c.upper()) == 1)
PROPER = LETTERS + MARKS
OPENING, CLOSING = "„“«‘‚", "”“»’…"

# The encodings that texts are taken for by mistake, by the letters their true bytes stood for.
WESTERN = ("cp1252", "latin-1", "iso8859-15", "mac_roman", "cp850", "cp437", "cp1250", "iso8859-2", "cp852", "cp1254", "cp1257", "mac_latin2")
CYRILLIC = ("cp1251", "iso8859-5", "koi8-r", "cp866", "mac_cyrillic")
ALL = WESTERN + CYRILLIC
# Encodings that only UTF-8 is taken for; of the last ones a letter's two bytes are one or two characters.
ONLY_UTF8 = ("cp1253", "cp1255", "cp1256", "cp1258", "iso8859-7", "iso8859-9", "iso8859-16", "cp737", "cp857", "cp874", "koi8-u")
MULTI_BYTE = ("shift_jis", "gbk", "big5", "euc_kr")
ORDER = {e: k for k, e in enumerate((*ALL, *ONLY_UTF8, *MULTI_BYTE))}
#: How often a misreading may have happened on top of another, and as which encodings beyond the first time.
DEPTH, AGAIN = 3, ("cp1252", "latin-1")


@lru_cache(None)
def _tables(encoding: str) -> tuple[tuple[str, ...], dict[str, int]]:
    """Characters of the 256 bytes, undefined bytes as the control character of the same number, and back."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return tuple(chars), {c: b for b, c in reversed(list(enumerate(chars)))}


def misread(text: str, true: str, taken: str) -> str | None:
    """What text becomes when its bytes are taken for another encoding; None if it has no bytes in the true one."""
    if taken in MULTI_BYTE:
        try:
            return text.encode(true).decode(taken)
        except UnicodeError:
            return None
    if true == "utf-8":
        data = text.encode()
    else:
        back = _tables(true)[1]
        if any(c not in back for c in text):
            return None
        data = bytes(back[c] for c in text)
    chars = _tables(taken)[0]
    return "".join(chars[b] for b in data)


class Patterns:
    """forms: garbled form to the (pair, original) it may come from; a pair is (true, taken, times)."""

    def __init__(self) -> None:
        self.forms: dict[str, list[tuple[tuple[str, str, int], str]]] = {}
        for c in dict.fromkeys(PROPER + COMBINING):
            for taken in ALL:
                form = misread(c, "utf-8", taken)
                self._add(form, ("utf-8", taken, 1), c)
                level = {form}
                for times in range(2, DEPTH + 1):
                    level = {misread(f, "utf-8", w) for f in level for w in {taken, *AGAIN}}
                    for f in level:
                        self._add(f, ("utf-8", taken, times), c)
            for taken in (*ONLY_UTF8, *MULTI_BYTE):
                form = misread(c, "utf-8", taken)
                if form and not form.isascii() and form[0] != c:
                    self._add(form, ("utf-8", taken, 1), c)
            for true in ALL:
                if c in _tables(true)[1]:
                    for taken in ALL:
                        form = misread(c, true, taken)
                        if true != taken and form != c and ord(form) > 127:
                            self._add(form, (true, taken, 1), c)
        for lost in ["\ufffd", *map(chr, range(0x80, 0xA0))]:  # of these no original is left
            self.forms.setdefault(lost, [])
        # Single characters are only told to be there; what they may stand for is looked at word by word.
        self.automaton = ahocorasick.Automaton()
        lone = [f for f in self.forms if len(f) == 1 and kind(f) != "O"]
        for form in self.forms.keys() - set(lone):
            self.automaton.add_word(form, form)
        self.automaton.make_automaton()
        self.single = re.compile(f"[{re.escape(''.join(lone))}]")

    def _add(self, form: str, pair: tuple[str, str, int], original: str) -> None:
        of = self.forms.setdefault(form, [])
        if (pair, original) not in of:
            of.append((pair, original))


@lru_cache(1)
def patterns() -> Patterns:
    return Patterns()


# What a character is: A letter of ASCII, N of the alphabets above, X other Latin, C Bulgarian or Russian,
# K other Cyrillic, G Greek, O other scripts, M mark, S a sign that words don't have, - all else.
_SIGNS = re.compile("[\x80-\x9fƒˆˇ˘-˝ı∂-⋿⌐⌠⌡─-◿�¤¦¨¯´¸¬¶µ¹ªºÞþÐð‡†•‰‹›ﬁ-ﬂ◊]")


@lru_cache(4096)
def kind(c: str) -> str:
    if c.isascii():
        return "A" if c.isalpha() else "-"
    if c in LETTERS and not "Ѐ" <= c <= "ӿ":
        return "N"
    if "А" <= c <= "я" or c in "ёЁ":
        return "C"
    if "Ѐ" <= c <= "ӿ":
        return "K"
    if _SIGNS.match(c):
        return "S"
    if c in MARKS:
        return "M"
    if "Ͱ" <= c <= "Ͽ":
        return "G"
    if c.isalpha():
        return "X" if c <= "ɏ" else "O"
    return "-"


_UNITS = re.compile(r"^[(]*(?:[kcdm]?m[²³])[).,;:!?]*$")
# A small letter before a capital, and letters that are no words, on their own.
_LOOSE = re.compile(r"^[(\[]*(?:[äçèêëîïñòóôöùûüœß][A-Z]|[äçëîïñòöùûüœß][).,;:!?\]]*$)")


@lru_cache(65536)
def strangeness(word: str) -> int:
    """2 for a word that proper text cannot have, 1 for an unusual one, else 0. Words are cut at blanks and line ends."""
    if word.isascii():
        return 0
    if any("\u0300" <= c <= "\u036f" for c in word):
        word = unicodedata.normalize("NFC", word)
    kinds = "".join(map(kind, word))
    if "S" in kinds:
        return 2
    level = 0
    if "X" in kinds or "K" in kinds:
        level = 1
    if re.search("[ANX][CK]|[CK][ANX]|G[NXM]|[NX]G|[CKANX][CKANX]?K[CK]", kinds):
        return 2
    if not _UNITS.match(word):
        for i, k in enumerate(kinds):
            c, before, after = word[i], word[i - 1 : i], word[i + 1 : i + 2]
            if k == "M" and c not in "‘’–—…·©®™\xad\xa0" and before.isalpha():
                if c in "§¿¡¼½¾²³±×" or (after.isalpha() and c in "„“”«»€£°"):
                    return 2
            if k in "NXCK" and c.isupper() and before.islower():
                return 2
            if k in "NXCK" and c.islower() and i > 1 and before.isupper() and word[i - 2].isupper() and word[i - 2 : i] != "Mc":
                return 2
    if _LOOSE.match(word):
        return 2
    runs = re.findall("[NX]{3,}", kinds)
    if runs:
        letters = {c.lower() for c, k in zip(word, kinds, strict=True) if k in "NX"}
        if not any(letters <= set(a) | set(NAME_LETTERS) for a in ALPHABETS.values()):
            return 2
    return level


Pair = tuple[str, str, int]
_WORD = re.compile("[^ \t\r\n]+")


def _beyond(text: str) -> list[str]:
    """The words that aren't ASCII."""
    return [w for w in text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") if not w.isascii()]




def _plausible(text: str, start: int, form: str, original: str) -> bool:
    """Whether a hit of two or more characters can be what it looks like."""
    before, earlier = text[start - 1 : start] if start else "", text[start - 2 : start - 1] if start > 1 else ""
    if kind(form[0]) == "O":
        after = text[start + len(form) : start + len(form) + 1]
        return any(x.isascii() and x.isalpha() for x in (before, after)) and "O" not in (before and kind(before), after and kind(after))
    capital = lambda c: c.isupper() and kind(c) in "ANC" and c not in "ÂÃÄÅĂĹÐÑРСГВ"
    small = original.isalpha() and original.islower()
    if small and capital(before) and (capital(earlier) or not earlier.isalpha() and len(form) == 2 and form[1] in CLOSING):
        return False
    if len(form) == 2 and kind(form[0]) == "N" and form[0].isupper() and form[1] in CLOSING and ((before and before in OPENING) or capital(before)):
        return False
    if original in "ąęńß" and not (before.isalpha() or (before and ord(before) > 127)):
        return False
    return True


# No form has ASCII in it, and those of one character are of East Asian scripts.
_FORM_RUN = re.compile("[\x80-\U0010ffff]{2,}|[\u2e80-\U0010ffff]")


def _hits(text: str) -> tuple[list[tuple[int, str, Pair, str]], bool]:
    """Hits (place, form, pair, original) of two or more characters that stand the check, and whether there are any
    others. Of those that overlap, the pair that covers most of the text goes first, then the longer form."""
    p = patterns()
    long: list[tuple[int, str, Pair, str]] = []
    doubted: list[tuple[int, str, Pair, str]] = []
    single = p.single.search(text) is not None
    for run in _FORM_RUN.finditer(text):
        for end, form in p.automaton.iter(run[0]):
            start = run.start() + end - len(form) + 1
            for pair, o in p.forms[form]:
                (long if _plausible(text, start, form, o) else doubted).append((start, form, pair, o))
    if not long:
        return long, single
    covered: Counter[Pair] = Counter()
    for _, form, pair, _ in long:
        covered[pair] += len(form)
    long.sort(key=lambda h: (-covered[h[2]], -len(h[1]), ORDER[h[2][1]], h[0]))
    taken = bytearray(len(text))
    out = []
    for h in long:
        end = h[0] + len(h[1])
        if not any(taken[h[0] : end]):
            taken[h[0] : end] = b"\1" * len(h[1])
            out.append(h)
    # What precedes a doubted hit is no proper text if it is a hit of the same pair.
    used = {h[2] for h in out}
    for h in sorted(doubted):
        end = h[0] + len(h[1])
        if h[0] and taken[h[0] - 1] and h[2] in used and not any(taken[h[0] : end]):
            taken[h[0] : end] = b"\1" * len(h[1])
            out.append(h)
    return sorted(out), single


class _Back(dict):
    """For str.translate: true characters by those taken for them, U+FFFD for what the taken encoding lacks."""

    def __missing__(self, c: int) -> int:
        return 0xFFFD


@lru_cache(None)
def _back(pair: Pair) -> _Back:
    true, taken = _tables(pair[0])[0], _tables(pair[1])[0]
    back = _Back({ord(t): ord(c) for t, c in reversed(list(zip(taken, true, strict=True)))})
    back.update({b: b for b in range(128)})
    return back


def _undo(text: str, pair: Pair) -> str | None:
    u = text.translate(_back(pair))
    return None if "\ufffd" in u else u


_RUN = re.compile("[\x80-\U0010ffff]+")


def _decode_runs(text: str, taken: str, times: int) -> str:
    """Runs beyond ASCII that are UTF-8 as bytes of taken, for scripts whose forms were not computed."""
    back = _tables(taken)[1]

    def fix(m: re.Match) -> str:
        s = m[0]
        try:
            for _ in range(times):
                s = bytes(back[c] for c in s).decode()
        except (KeyError, UnicodeDecodeError):
            return m[0]
        return s

    return _RUN.sub(fix, text)


@lru_cache(1)
def _single_pairs() -> tuple[Pair, ...]:
    seen = Counter(pair for form, of in patterns().forms.items() if len(form) == 1 for pair, _ in of if pair[0] != "utf-8")
    return tuple(sorted(seen, key=lambda p: (ALL.index(p[0]), ALL.index(p[1]))))


def _best_pair(words: list[str]) -> Pair | None:
    """The pair that turns most of the strange words into proper ones, the first in order of those that tie."""
    best, most = None, 0
    for pair in _single_pairs():
        n = 0
        for w in words:
            u = _undo(w, pair)
            n += u is not None and u != w and strangeness(u) == 0
        if n > most:
            best, most = pair, n
    return best


def _replace(text: str, hits: list[tuple[int, str, Pair, str]]) -> str:
    parts, at = [], 0
    for start, form, _, original in hits:
        parts += [text[at:start], original]
        at = start + len(form)
    return "".join([*parts, text[at:]])


def _strange(text: str) -> list[str]:
    return [w for w in dict.fromkeys(_beyond(text)) if strangeness(w)]


_AFTER = re.compile(r"[^\W\d_][€£¿§]")


def _undeniable(text: str) -> bool:
    """Whether it has a word that no language has, or a sign where one ends that only begins words and numbers."""
    return any(strangeness(w) == 2 for w in _beyond(text)) or _AFTER.search(text) is not None


def _mend_words(text: str, pair: Pair) -> str:
    """Undoes a misreading of single bytes in strange words that it makes proper, and in the whole of those lines
    in which all words beyond ASCII are proper afterwards."""

    def fix(m: re.Match) -> str:
        u = _undo(m[0], pair) if strangeness(m[0]) else None
        return m[0] if u is None or strangeness(u) else u

    lines = []
    for line in re.split(r"(?<=\n)", text):
        words = [w for w in _WORD.findall(line) if not w.isascii()]
        whole = _undo(line, pair) if any(map(strangeness, words)) else None
        lines.append(whole if whole is not None and not any(strangeness(_undo(w, pair) or w) for w in words) else _WORD.sub(fix, line))
    return "".join(lines)


@lru_cache(1)
def _alphabets() -> tuple[frozenset[str], ...]:
    both = lambda a: frozenset(a + "".join(c.upper() for c in a))
    return tuple(both(a) for a in (*OTHER_ALPHABETS, *ALPHABETS.values()))


_MARK = frozenset(MARKS + "µ‰†‡•←→↑↓≤≥≠∞′″№−‐‑\u2009\u200a\u202f")
_INSIDE = re.compile(r"[^\W\d_][§¿¡¼½¾²³±×„“”«»€£°µ‰†‡•][^\W\d_]|[^\W\d_][§¿¡¼½¾¹²³±€£]")
_MIXED = re.compile("[A-Za-zÀ-ɏ][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-zÀ-ɏ]")


def _odd_case(word: str) -> bool:
    """A capital beyond ASCII after a small letter, or a small one after two capitals."""
    for i in range(1, len(word)):
        c = word[i]
        if c.isascii():
            continue
        if c.isupper() and word[i - 1].islower():
            return True
        if c.islower() and i > 1 and word[i - 2 : i].isupper() and word[i - 2 : i].isalpha():
            return True
    return False


def fits_one_alphabet(text: str) -> bool:
    """Whether all letters of text beyond ASCII are of one alphabet, in a case that words have, and its signs stand
    between words."""
    beyond = {c for c in unicodedata.normalize("NFC", text) if not c.isascii()}
    letters = {c for c in beyond if c not in _MARK}
    if not any(letters <= a for a in _alphabets()):
        return False
    # A few letters of another script in a text in Latin letters are no words of it.
    foreign = sum("Ͱ" <= c <= "ӿ" for c in text)
    if foreign and 8 * foreign < sum(c.isascii() and c.isalpha() for c in text):
        return False
    return not _INSIDE.search(text) and not _MIXED.search(text) and not any(map(_odd_case, _WORD.findall(text)))


def examine(text: str | None) -> tuple[bool, bool, str | None, str | None]:
    """Whether text is garbled anywhere, whether all of it could be restored, the text with what could be, and the
    misreadings, as true>taken, in the order of their names. A null text is not garbled."""
    if not text or text.isascii():
        return False, False, text, None
    hits, single = _hits(text)
    if not hits and not single:
        return False, False, text, None
    if (not hits and not _undeniable(text)) or (all(h[1].isalpha() for h in hits) and fits_one_alphabet(text)):
        return False, False, text, None
    # Forms of several characters first, then single ones; or single ones alone, where that leaves less.
    best: tuple[int, str, set[Pair]] | None = None
    for first in (hits, []) if hits else ([],):
        mended, used = _replace(text, first), {h[2] for h in first}
        strange = _strange(mended)
        for _, taken, times in sorted(used) if strange else ():
            mended = _WORD.sub(lambda m: u if strangeness(m[0]) and not strangeness(u := _decode_runs(m[0], taken, times)) else m[0], mended)  # noqa: B023
            strange = _strange(mended)
        pair = _best_pair(strange) if strange else None
        if pair:
            after = _mend_words(mended, pair)
            if after != mended:
                mended, used = after, used | {pair}
                strange = _strange(mended)
        if best is None or len(strange) < best[0]:
            best = (len(strange), mended, used)
        if not strange:
            break
    _, mended, used = best
    if not used and not any(strangeness(w) == 2 for w in _strange(text)):
        return False, False, text, None
    left = any(strangeness(w) == 2 for w in _strange(mended))
    return True, not left, mended, ", ".join(sorted({f"{a}>{b}" + (f" x{n}" if n > 1 else "") for a, b, n in used})) or None


def repair(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The garbled rows of docs: key, restored (whether all of the text could be), fixed (the text with what could
    be restored) and misread (the pairs of encodings, null if none was recognised).

    Null, empty and plain ASCII texts are never garbled; texts are taken whole, however long. Repeated rows give
    repeated rows; other columns of docs are not read.
    """
    schema = T.StructType([docs.schema[key], T.StructField("restored", T.BooleanType()), T.StructField("fixed", T.StringType()), T.StructField("misread", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [examine(t) for t in b.column(1).to_pylist()]
            rows = [i for i, s in enumerate(seen) if s[0]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array([seen[i][1] for i in rows], pa.bool_()), pa.array([seen[i][2] for i in rows], pa.string()), pa.array([seen[i][3] for i in rows], pa.string())],
                [key, "restored", "fixed", "misread"],
            )

    # Texts of ASCII alone are told by their length in bytes, in the JVM.
    wide = docs.select(key, text).filter(F.octet_length(text) > F.char_length(text))
    return wide.mapInArrow(run, schema)
