"""Job titles as sets of canonical words, whatever their order, noise and abbreviation."""

from __future__ import annotations

import re

from sightline.llm.spelling import deletions, distance, words

# Abbreviations in titles.
SHORT = {
    "sr": "senior", "snr": "senior", "jr": "junior", "jnr": "junior", "princ": "principal", "asst": "assistant", "insp": "inspector", "admin": "administrator", "admn": "administrator", "dev": "developer", "devel": "developer", "tech": "technician", "techn": "technician", "engr": "engineer", "eng": "engineer", "engg": "engineering", "spec": "specialist", "coord": "coordinator", "supv": "supervisor", "supvr": "supervisor", "ofc": "officer", "offr": "officer", "mgr": "manager", "mktg": "marketing", "procur": "procurement", "proc": "procurement", "mech": "mechanical", "instr": "instrumentation", "maint": "maintenance", "elec": "electrical", "elect": "electrical", "qa": "quality", "qc": "quality", "acct": "accountant", "cons": "consultant", "dir": "director", "exec": "executive", "op": "operator", "opr": "operator", "anal": "analyst", "desig": "designer", "aud": "auditor", "ctrl": "controller", "compl": "compliance", "sec": "security", "db": "database", "hr": "human", "it": "it",
}
# Words and phrases that advertise rather than describe.
NOISE = {"we", "are", "hiring", "now", "urgent", "urgently", "required", "needed", "wanted", "immediate", "joining", "joiner", "for", "the", "a", "an", "of", "in", "at", "and", "m", "f", "d", "w", "x", "ksa", "saudi", "national", "nationals", "arabia", "grade", "level", "lot", "phase", "ref", "job", "vacancy", "new", "opening", "only", "based", "riyadh"}
# Ranks within a title and what they are called.
LEVELS = {"junior", "senior", "lead", "chief", "principal", "assistant", "intern", "head", "deputy", "trainee", "associate", "manager", "director"}
GRADES = {"i": "g1", "ii": "g2", "iii": "g3", "iv": "g4", "v": "g5", "1": "g1", "2": "g2", "3": "g3", "4": "g4", "5": "g5"}
_ASIDE = re.compile(r"\[[^\]]*\]|\(\s*[mfdwx](?:\s*/\s*[mfdwx])+\s*\)|#\s*\d+|\b(?:lot|ref|phase)\.?\s*\d+", re.I)


class TitleWords:
    """The words of a corpus of titles with their counts; reads single titles.

    ``counts`` holds every word that stands in at least a fixed share of all titles, so its
    size is bounded by the mean length of a title over that share.
    """

    def __init__(self, counts: dict[str, int], places: set[str], ratio: float = 3.0) -> None:
        self.counts = {w: n for w, n in counts.items() if len(w) > 1 and w not in SHORT and w not in NOISE and w not in places and not w.isdigit()}
        self.places = places
        keys: dict[str, set[str]] = {}
        for w in self.counts:
            if len(w) >= 4:
                for k in deletions(w):
                    keys.setdefault(k, set()).add(w)
        self.keys = keys
        # A word one edit from a far commoner one is a misspelling of it.
        self.fixed = {}
        for w, n in self.counts.items():
            better = [x for k in deletions(w) for x in keys.get(k, ()) if x != w and len(w) >= 6 and self.counts[x] >= ratio * n and distance(w, x, 1) <= 1]
            if better:
                self.fixed[w] = max(better, key=lambda x: (self.counts[x], x))
        # A word made of two far commoner ones is those two, run together.
        common = {w for w in self.counts if w not in self.fixed}
        self.apart = {w: [w[:i], w[i:]] for w, n in self.counts.items() for i in range(3, len(w) - 2) if {w[:i], w[i:]} <= common and min(self.counts[w[:i]], self.counts[w[i:]]) >= ratio * n}
        self.good = common - set(self.apart)
        self.memo: dict[str, list[str]] = {}

    def word(self, w: str) -> list[str]:
        """Canonical words of one written word: expanded, corrected or taken apart."""
        if w not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[w] = self._word(w)
        return self.memo[w]

    def _word(self, w: str) -> list[str]:
        if w in SHORT:
            return [SHORT[w]]
        if w in self.apart:
            return self.apart[w]
        if w in self.fixed:
            return [self.fixed[w]]
        if w in self.good or len(w) < 4:
            return [w]
        for i in range(3, len(w) - 2):
            if w[:i] in self.good and w[i:] in self.good:
                return [w[:i], w[i:]]
        near = {x for k in deletions(w) for x in self.keys.get(k, ()) if x in self.good and distance(w, x, 1) <= 1}
        if near:
            return [max(near, key=lambda x: (self.counts[x], x))]
        for i in range(3, len(w) - 2):
            for a, b in ((w[:i], w[i:]),):
                x = [p for k in deletions(a) for p in self.keys.get(k, ()) if p in self.good and distance(a, p, 1) <= 1] if b in self.good else []
                y = [p for k in deletions(b) for p in self.keys.get(k, ()) if p in self.good and distance(b, p, 1) <= 1] if a in self.good else []
                if x or y:
                    return [x[0], b] if x else [a, y[0]]
        return [w]

    def read(self, title: str) -> tuple[list[str], list[str]]:
        """(sorted words of the work and focus, sorted levels and grades) of a title."""
        raw = [w for w in words(_ASIDE.sub(" ", title))]
        joined: list[str] = []
        i = 0
        while i < len(raw):
            # Words torn apart: two neighbours that together are a commoner word.
            if i + 1 < len(raw) and (run := raw[i] + raw[i + 1]) in self.good and min(self.counts.get(raw[i], 0), self.counts.get(raw[i + 1], 0)) < self.counts[run]:
                joined.append(run)
                i += 2
            else:
                joined.append(raw[i])
                i += 1
        work, level = set(), set()
        for w in joined:
            if w in GRADES:
                level.add(GRADES[w])
                continue
            if w in NOISE or w in self.places or w.isdigit():
                continue
            for x in self.word(w):
                if x in LEVELS:
                    level.add(x)
                elif x not in NOISE and x not in self.places:
                    work.add(x)
        return sorted(work), sorted(level - {"g1"})
