"""Spellings of names across scripts: folding, bounded edit distance, deletion keys."""

from __future__ import annotations

import re
import unicodedata

# Arabic letters by their usual Latin rendering in names.
LETTERS = {
    "ا": "a", "أ": "a", "إ": "i", "آ": "a", "ٱ": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d",
    "ط": "t", "ظ": "z", "ع": "a", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "ة": "h", "و": "u", "ؤ": "u", "ي": "i", "ى": "a", "ئ": "i", "ء": "", "پ": "p", "چ": "ch", "گ": "g", "ڤ": "v",
}
_TABLE = str.maketrans(LETTERS)
_ARABIC = re.compile("[ء-ي]")
_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789")


def words(text: str) -> list[str]:
    """Lower-case words without marks, tatweel and punctuation; compatibility forms unified."""
    t = unicodedata.normalize("NFKC", text).replace("ـ", "").translate(_DIGITS)
    t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c) or c in "ٕٔٓ")
    t = unicodedata.normalize("NFC", t).replace("&", " and ").replace("+", " and ")
    return re.findall(r"[^\W_]+", t)


def is_arabic(word: str) -> bool:
    return bool(_ARABIC.search(word))


def fold(word: str) -> str:
    """A key that spellings of one sound share: Latin letters, long vowels short, no doubled letters."""
    w = word.translate(_TABLE) if is_arabic(word) else word
    w = w.replace("ou", "u").replace("oo", "u").replace("ee", "i").replace("ea", "a") if len(w) > 4 else w
    w = w.translate(str.maketrans("owye", "uuii"))
    return re.sub(r"(.)\1+", r"\1", w)


def distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (edits and swaps of neighbours); most + 1 if it is more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most and (before is None or min(last) > most):
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def deletions(word: str, most: int = 1) -> set[str]:
    """The word and all it becomes by deleting up to ``most`` letters: words within the distance share one."""
    out = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def allowed(word: str) -> int:
    """Edits a word of this length may carry."""
    return 0 if len(word) < 4 else 1 if len(word) < 9 else 2


def forms(word: str) -> set[str]:
    """The writings under which a word is compared: as it stands (Latin only) and folded."""
    return {fold(word)} if is_arabic(word) else {word, fold(word)}


class Vocabulary:
    """Reference words, found by edit distance through deletion keys.

    A word is compared as written and folded; what is found is its folded form.
    """

    def __init__(self, entries: set[str], most: int = 2) -> None:
        self.most = most
        self.names: dict[str, set[str]] = {}
        for e in entries:
            for f in forms(e):
                self.names.setdefault(f, set()).add(fold(e))
        self.keys: dict[str, set[str]] = {}
        for w in self.names:
            for k in deletions(w, min(allowed(w), most)):
                self.keys.setdefault(k, set()).add(w)

    def _candidates(self, form: str) -> set[str]:
        """Entries that may be within the allowed distance of a form."""
        return {w for k in deletions(form, min(allowed(form), self.most)) for w in self.keys.get(k, ())}

    def near(self, word: str) -> list[tuple[str, float]]:
        """Folded entries within the allowed distance with a similarity of 0 to 1; an exact one alone, else the nearest."""
        found: dict[str, tuple[int, int]] = {}
        for form in forms(word):
            for n in self.names.get(form, ()):
                found[n] = (0, len(form))
        if not found:
            for form in forms(word):
                for w in self._candidates(form):
                    most = min(allowed(form), allowed(w), self.most)
                    if (d := distance(form, w, most)) <= most:
                        for n in self.names[w]:
                            found[n] = min(found.get(n, (99, 1)), (d, max(len(form), len(w))))
        best = min((d for d, _ in found.values()), default=0)
        return sorted((n, 1 - d / size) for n, (d, size) in found.items() if d == best)


class LongVocabulary(Vocabulary):
    """A vocabulary of long words within two edits, for a tenth of the deletion keys.

    Of two edits, one half of a word takes one at most (a swap across the cut is one in each
    half). So halves are looked up with one deletion, beside each cut of the word asked for
    that may meet theirs, and what is found is compared whole.
    """

    def __init__(self, entries: set[str]) -> None:
        super().__init__(set())
        self.most = 2
        for e in entries:
            for f in forms(e):
                self.names.setdefault(f, set()).add(fold(e))
        self.halves: tuple[dict[str, list[str]], dict[str, list[str]]] = ({}, {})
        self.letters: dict[str, int] = {}
        for w in sorted(self.names):
            if allowed(w):
                self.letters[w] = self._letters(w)
                for half, at in zip((w[: len(w) // 2], w[len(w) // 2 :]), self.halves):
                    for k in deletions(half):
                        at.setdefault(k, []).append(w)

    @staticmethod
    def _letters(word: str) -> int:
        """The letters of a word as bits; an edit changes two of them at most."""
        out = 0
        for c in word:
            out |= 1 << ord(c) % 64
        return out

    def _candidates(self, form: str) -> set[str]:
        seen = self._letters(form)
        middle, out = len(form) // 2, set()
        for cut in range(max(0, middle - 2), min(len(form), middle + 3) + 1):
            for half, at in zip((form[:cut], form[cut:]), self.halves):
                for k in deletions(half):
                    out.update(at.get(k, ()))
        return {w for w in out if (self.letters[w] ^ seen).bit_count() <= 4}
