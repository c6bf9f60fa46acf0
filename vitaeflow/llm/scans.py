"""Repair of text from scanned pages with a trained character editor.

Lines of a value that are page furniture (running headers, page marks and numbers) are
removed by an averaged perceptron that looks at their position, their build, what they
interrupt, and how often lines of that shape stand in the corpus.  A running header is a
shape that makes a share of all lines of the corpus; it is removed inside a line too, whole
or with its last letters cut.  A second perceptron then walks over the suspicious stretches
and predicts, per character, keep, replace, delete, line-join or space.  Both models are
trained here, on clean values of the corpus that are damaged on purpose; the sample they are
fitted on is bounded by a parameter, while the word counts and line shapes they look at
cover all values.  A value is damaged if the editor changes it.

Stretches whose words are all ordinary words of the corpus are kept without asking the
editor.  A word is suspicious if undoing one or two misreadings turns it into a word that
is several times as frequent.
"""

from __future__ import annotations

import hashlib
import random
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Words, the most frequent ones, whose counts are sent to every task.
MOST_WORDS = 1_000_000
#: Bits a word has in the filter that tells words without a count, and the most bits of that filter (128 MB).
BITS, MOST_BITS = 32, 1 << 30
#: Values the editor is fitted on.
TRAINED_ON = 3_000
#: Letters of the longest word; longer runs are no words of a language and are kept as they are.
LONGEST = 40
#: Share of all lines from which a shape is looked up, and from which it may be a running header (seen this often).
SHAPE_SHARE, HEADER_SHARE, HEADER_SEEN = 0.001, 0.005, 3
#: How many times as frequent as the word itself its correction must be.
RATIO = 4

# What scanners make of letters, as (read, meant).
MISREAD = (
    ("c", "e"), ("f", "t"), ("l", "i"), ("l", "I"), ("0", "o"), ("0", "O"), ("1", "l"), ("1", "I"), ("1", "i"), ("rn", "m"), ("m", "rn"), ("5", "S"), ("5", "s"),
    ("ü", "ti"), ("li", "h"), ("n", "ri"), ("6", "G"), ("8", "B"), ("cl", "d"), ("vv", "w"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("I", "l"), ("h", "b"), ("ii", "n"),
)
# Letters that scanners lose, as (read, meant): one of two equal ones, a thin one beside another.
LOST = (("s", "ss"), ("l", "ll"), ("r", "rr"), ("t", "tt"), ("f", "ff"), ("f", "fi"), ("l", "li"), ("r", "ri"), ("t", "ti"))
HYPHENS = "-¬\xad‐"
_WORD = re.compile(r"[^\W_]+")
_SIGNS = re.compile(r"[\n\r¬\xad‐ﬀﬁﬂ]|\w- ")
#: How page marks without words are built, with # for a number; headers of words are made up in training.
MARKS = ("[#]", "- # -", "p. #", "#", "--- page # ---", "(#)", "— # —", "#.", "| #")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|a|o|s)$")


class Perceptron:
    """Averaged perceptron over string features."""

    def __init__(self):
        self.w: dict[str, dict[str, float]] = {}
        self._sum: dict[tuple[str, str], float] = defaultdict(float)
        self._at: dict[tuple[str, str], int] = defaultdict(int)
        self.n = 0

    def predict(self, features: list[str], classes: list[str]) -> str:
        best, top = classes[0], None
        for c in classes:
            s = sum(self.w[f].get(c, 0.0) for f in features if f in self.w)
            if top is None or s > top:
                best, top = c, s
        return best

    def learn(self, features: list[str], classes: list[str], truth: str) -> None:
        self.n += 1
        guess = self.predict(features, classes)
        if guess != truth:
            for f in features:
                for c, d in ((truth, 1.0), (guess, -1.0)):
                    w = self.w.setdefault(f, {})
                    self._sum[f, c] += (self.n - self._at[f, c]) * w.get(c, 0.0)
                    self._at[f, c] = self.n
                    w[c] = w.get(c, 0.0) + d

    def average(self) -> None:
        for (f, c), at in self._at.items():
            total = self._sum[f, c] + (self.n - at) * self.w[f][c]
            self.w[f][c] = total / max(1, self.n)
        self._sum, self._at = defaultdict(float), defaultdict(int)


_READ: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _read, _meant in MISREAD:
    _READ[_read[0]].append((_read, _meant))
_SHORT: dict[str, list[str]] = defaultdict(list)
for _read, _meant in LOST:
    _SHORT[_read].append(_meant[1:])


def has_sign(w: str) -> bool:
    """Whether a word holds a digit or a letter that scanners put for others."""
    return any(c.isdigit() for c in w) or not w.isascii()


def undone(w: str) -> Iterator[list[tuple[str, tuple[str, ...]]]]:
    """Words that undoing one lost letter, or one, two or three misreadings gives, level by level, with the operations."""
    frontier = [(w, tuple("K" for _ in w), 0)]
    for depth in range(3 if has_sign(w) or len(w) >= 7 else 2):
        nxt = []
        for s, ops, at in frontier:
            # ``s`` keeps the characters of ``w`` from ``at`` on; its start is corrected already
            shift = len(s) - len(w)
            for i in range(at, len(w)):
                for read, meant in _READ.get(w[i], ()):
                    if w.startswith(read, i):
                        t = s[: i + shift] + meant + s[i + shift + len(read) :]
                        nxt.append((t, ops[:i] + (f"R:{meant}",) + ("D",) * (len(read) - 1) + ops[i + len(read) :], i + len(read)))
        level = [(t, o) for t, o, _ in nxt]
        if depth == 0:  # a word that has lost one letter
            keep = tuple("K" for _ in w)
            level += [(w[: i + 1] + more + w[i + 1 :], keep[:i] + (f"I:{more}",) + keep[i + 1 :]) for i, c in enumerate(w) for more in _SHORT.get(c, ())]
        yield level
        frontier = nxt


class Words:
    """Counts of the words of the corpus and the corrections they allow."""

    def __init__(self, counts: dict[str, int] | Held):
        self.n = counts
        self.memo: dict[str, tuple[str, tuple[str, ...]] | None] = {}

    def corrections(self, w: str) -> Iterable[list[tuple[str, tuple[str, ...]]]]:
        return undone(w)

    def known(self, w: str) -> bool:
        return self.n.get(w, 0) >= 3 or w.isdigit()

    def fix(self, w: str) -> tuple[str, tuple[str, ...]] | None:
        """The word meant and the operation at each character of ``w``, if ``w`` looks misread."""
        if w in self.memo:
            return self.memo[w]
        got = self._fix(w) if 2 <= len(w) <= LONGEST and not w.isdigit() and not _ORDINAL.match(w) else None
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[w] = got
        return got

    def _fix(self, w: str) -> tuple[str, tuple[str, ...]] | None:
        for level in self.corrections(w):
            counted = [(c, t, ops) for t, ops in level if (c := self.n.get(t, 0))]
            if not counted:
                continue
            own = self.n.get(w, 0)
            need = max(2 if has_sign(w) else 3, RATIO * own) if len(w) > 2 else max(50, 50 * own)
            best = max(counted, key=lambda x: x[0])  # the first of the most frequent
            if best[0] >= need:
                return best[1], best[2]
        return None

    def sound(self, w: str) -> bool:
        return self.known(w) or self.fix(w) is not None


def _places(word: str, bits: int) -> Iterator[int]:
    """Where a word stands in a filter of so many bits."""
    h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=16).digest(), "little")
    for _ in range(4):
        yield h & (bits - 1)
        h >>= 32


class Held:
    """Counts of the frequent words and of those that were looked up.  Words outside the filter have none; the others
    that are asked for are written down."""

    def __init__(self, frequent: dict[str, int], marks: bytes):
        self.frequent, self.marks, self.bits = frequent, marks, 8 * len(marks)
        self.hold({})

    def hold(self, counts: dict[str, int]) -> None:
        self.counts, self.missing, self.misses = counts, set(), 0

    def get(self, w: str, default: int = 0) -> int:
        n = self.frequent.get(w) or self.counts.get(w)
        if n is not None:
            return n
        if w in self.missing or self.may(w):
            self.missing.add(w)
            self.misses += 1
        return default

    def may(self, w: str) -> bool:
        """Whether a word may have a count."""
        return w in self.frequent or all(self.marks[p >> 3] >> (p & 7) & 1 for p in _places(w, self.bits))


class HeldWords(Words):
    """Words over :class:`Held` counts; only corrections that no missing count touched are remembered."""

    def __init__(self, held: Held):
        super().__init__(held)
        self.near: dict[str, tuple[list[tuple[str, tuple[str, ...]]], ...]] = {}

    def corrections(self, w: str) -> Iterable[list[tuple[str, tuple[str, ...]]]]:
        if w not in self.near:
            if len(self.near) > 500_000:
                self.near.clear()
            # no word outside the frequent ones can be several times as frequent as one of them
            may = self.n.frequent.__contains__ if w in self.n.frequent else self.n.may
            self.near[w] = tuple(some for level in undone(w) if (some := [x for x in level if may(x[0])]))
        return self.near[w]

    def fix(self, w: str) -> tuple[str, tuple[str, ...]] | None:
        before = self.n.misses
        got = super().fix(w)
        if self.n.misses > before:
            self.memo.pop(w, None)
        return got


def _shape(line: str) -> str:
    """A line with # for its numbers, in lower case, blanks squeezed."""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "#", line.strip())).lower()


def header_pattern(shapes: list[str]) -> re.Pattern | None:
    """Running headers of several words and a number inside a line; the last word may lack its last two letters."""
    forms = []
    for s in sorted(shapes, key=lambda s: (-len(s), s)):
        parts = s.split(" ")
        if "#" in parts and sum(p.isalpha() for p in parts) >= 2:
            made = [r"\d{1,4}" if p == "#" else re.escape(p) for p in parts]
            if parts[-1].isalpha() and len(parts[-1]) > 6:
                made[-1] = re.escape(parts[-1][:-2]) + f"(?:{re.escape(parts[-1][-2])}(?:{re.escape(parts[-1][-1])})?)?"
            forms.append(r"\s+".join(made))
    return re.compile(rf"\s*(?<!\w)(?:{'|'.join(forms)})(?!\w)\s*", re.I) if forms else None


def line_features(line: str, place: str, before: str, after: str, words: Words, share: float) -> list[str]:
    """Position, build and surroundings of a line within its value, and the share of its shape among all lines."""
    s = _shape(line)
    raw = line.strip()
    toks = _WORD.findall(raw)
    plain = [t for t in toks if not t.isdigit()]
    letters = [c for c in raw if c.isalpha()]
    case = "none" if not letters else "upper" if all(c.isupper() for c in letters) else "title" if all(t[:1].isupper() for t in plain if len(t) > 3) and plain[0][:1].isupper() else "lower" if all(c.islower() for c in letters) else "mixed"
    left, right = re.search(r"([^\W_]*)([^\w\s]*)\s*$", before), re.match(r"\s*([^\W_]*)", after)
    torn = bool(left[2]) and left[2][-1] in HYPHENS
    bridge = torn and words.sound(left[1][-LONGEST:] + right[1][:LONGEST])
    joins = torn and words.sound(left[1][-LONGEST:] + (toks[0][:LONGEST] if toks else ""))
    number = any(t.isdigit() for t in toks)
    bucket = "often" if share >= HEADER_SHARE else "some" if share >= SHAPE_SHARE else "seldom"
    build = f"{number}|{min(len(plain), 4)}|{case}"
    marks = re.sub(r"[^\W\d_]+", "a", s)[:24]
    edge = "digits" if raw[:1].isdigit() else "digits-end" if raw[-1:].isdigit() else "other"
    return [f"place={place}", f"share={bucket}", f"share={bucket}|{place}", f"share={bucket}|{number}", f"build={build}", f"build={build}|{place}", f"marks={marks}", f"marks={marks}|{place}", f"short={len(s) < 30}",
            f"bridge={bridge}", f"joins={joins}", f"torn={torn}|{raw[:1].islower()}", f"next={right[1][:1].islower()}|{place}", f"edge={edge}|{place}|{number}"]


class Editor:
    """Line model and character model, trained on damaged copies of clean values."""

    LINE = ["text", "furniture"]

    def __init__(self, words: Words, shapes: dict[str, float] | None = None, headers: list[str] = ()):
        self.words, self.shapes, self.headers = words, shapes or {}, list(headers)
        self.inline = header_pattern(self.headers)
        self.lines, self.chars = Perceptron(), Perceptron()

    def find_headers(self, seen: dict[str, int]) -> None:
        """The shapes that are running headers: often enough a line, and furniture to the line model."""
        self.headers = sorted(s for s, n in seen.items() if n >= HEADER_SEEN and self.shapes.get(s, 0) >= HEADER_SHARE and self._furniture(re.sub("#", "7", s), "inner", "", ""))
        self.inline = header_pattern(self.headers)

    def _share(self, line: str) -> float:
        """Share of the shape of a line, or of that shape with a number before or after it."""
        s = _shape(line)
        return max(self.shapes.get(x, 0.0) for x in ((s,) if "#" in s else (s, f"# {s}", f"{s} #")))

    def _furniture(self, line: str, place: str, before: str, after: str) -> bool:
        return self.lines.predict(line_features(line, place, before, after, self.words, self._share(line)), self.LINE) == "furniture"

    # ---- lines -----------------------------------------------------------------------

    def _keep_lines(self, text: str) -> str:
        lines = re.split(r"\r\n|\n|\r", text)
        if self.inline:  # a header within another mark or a line of text
            slim = [self.inline.sub(" ", x) for x in lines]
            lines = [y if y.strip() else x for x, y in zip(lines, slim)]
        kept = []
        for i, line in enumerate(lines):
            place = "only" if len(lines) == 1 else "first" if i == 0 else "last" if i == len(lines) - 1 else "inner"
            if not line.strip():
                continue
            if len(lines) > 1 and self._furniture(line, place, kept[-1] if kept else "", next((x for x in lines[i + 1 :] if x.strip()), "")):
                continue
            kept.append(line)
        return "\n".join(kept)

    # ---- characters ------------------------------------------------------------------

    def _break_features(self, text: str, i: int, sign: str) -> list[str]:
        end, start = i, i
        while end and text[end - 1] in HYPHENS + " \r":
            end -= 1
        while start < len(text) and text[start] in HYPHENS + " \r\n":
            start += 1
        left = re.search(r"[^\W_]*$", text[max(0, end - LONGEST) : end]).group()
        right = re.match(r"[^\W_]*", text[start : start + LONGEST]).group()
        joined = left + right
        both = f"{self.words.sound(joined)}|{self.words.known(left)}|{self.words.known(right)}"
        return [f"{sign}", f"{sign}|{both}", f"{sign}|lower={right[:1].islower()}", f"{sign}|next={right}", f"{sign}|joined={self.words.sound(joined)}", f"{sign}|compound={self.words.n.get(left + '-' + right, 0) > 2}", f"{sign}|left={left}"]

    def _features(self, t: str, i: int, ops: dict[int, str], before: str) -> list[str]:
        c, p, n = t[i], t[i - 1 : i], t[i + 1 : i + 2]
        f = [f"c={c}", f"pc={p}{c}", f"cn={c}{n}", f"pcn={p}{c}{n}", f"fix={ops.get(i, 'K')}", f"fix={ops.get(i, 'K')}|{c}", "any"]
        if c in HYPHENS and n in (" ", "\n", "\r") and (m := re.compile(r"[ \r]*\n?[ ]*[^\W_]").match(t, i + 1)):
            f += self._break_features(t, i, "hyphen-line" if "\n" in m.group() else "hyphen-blank")
        elif c == "\n":
            f += self._break_features(t, i, "line-after-hyphen" if before in tuple(HYPHENS) else "line")
        elif c in " \r":
            after = re.compile(r"[ \r]*").match(t, i + 1).end()
            if before and before in HYPHENS and i and t[i - 1] in HYPHENS + " \r":
                f += self._break_features(t, i, "blank-line" if t[after : after + 1] == "\n" else "blank")
        elif c in HYPHENS:
            f.append(f"sign={c}")
        return f

    def _choices(self, t: str, i: int, ops: dict[int, str], before: str) -> list[str]:
        c = t[i]
        if c == "\n":
            return ["S", "J"]
        if c in HYPHENS:
            return ["K", "J"] if c != "-" or t[i + 1 : i + 2].isspace() else ["K"]
        if c in " \r":
            return ["K", "J"] if before in tuple(HYPHENS) else ["K"]
        return ["K", ops[i][0]] if i in ops else ["K"]  # replace, delete or insert, as the corrected word has it

    def _spans(self, t: str) -> dict[int, str]:
        """Operations the word counts suggest, by position; words broken over a line count as one."""
        ops: dict[int, str] = {}
        for m in re.finditer(r"[^\W_]+(?:[-¬\xad‐][ \r]*\n?[ ]*[^\W_]+)*", t):
            at = [i for i in range(m.start(), m.end()) if t[i].isalnum()]
            w = "".join(t[i] for i in at)
            pieces = _WORD.findall(m.group())
            broken = len(pieces) > 1
            if broken and not self.words.known(w) and (all(self.words.known(p) for p in pieces) or self.words.fix(w) is None):
                w, broken = "", False
            for word, where in [(w, at)] if w and (broken or len(pieces) == 1) else [(p.group(), range(m.start() + p.start(), m.start() + p.end())) for p in _WORD.finditer(m.group())]:
                got = self.words.fix(word) if not self.words.n.get(word, 0) > 10**9 else None
                if got:
                    ops.update((i, o) for i, o in zip(where, got[1]) if o != "K")
        return ops

    def edit(self, t: str, gold: list[str] | None = None) -> str:
        ops = self._spans(t)
        out, joined, before = [], False, ""  # ``before``: the last character that is no blank
        for i, c in enumerate(t):
            choices = self._choices(t, i, ops, before)
            if len(choices) == 1:
                op = "K"
            else:
                f = self._features(t, i, ops, before)
                if c in " \r\n":
                    f.append(f"after-join={joined}")
                if gold is not None:
                    meant = gold[i][0] if gold[i] == ops.get(i, gold[i]) else "K"
                    truth = meant if meant in choices else choices[0]
                    self.chars.learn(f, choices, truth)
                    op = truth
                else:
                    op = self.chars.predict(f, choices)
            if op == "K":
                out.append(c)
            elif op == "S":
                out.append(" ")
            elif op == "I":
                out.append(c + ops[i][2:])
            elif op == "R":
                out.append(ops[i][2:])
            if c in HYPHENS:
                joined = op == "J"
            elif c not in " \r\n":
                joined = False
            if c not in " \r":
                before = c
        return "".join(out)

    def repair(self, value: str) -> str:
        """One continuous line: furniture out, words joined, misread characters corrected."""
        t = self._keep_lines(value) if "\n" in value or "\r" in value else value
        for _ in range(2):
            t = self.edit(t)
            slim = self.inline.sub(" ", t) if self.inline else t
            if slim == t:
                break
            t = slim
        return re.sub(r"\s+", " ", t).strip()

    def suspicious(self, value: str) -> bool:
        return bool(_SIGNS.search(value)) or bool(self.inline and self.inline.search(value)) or any(self.words.fix(w) is not None for w in _WORD.findall(value))

    def damaged(self, value: str) -> str | None:
        """The repaired text of a damaged value, else nothing."""
        if not self.suspicious(value):
            return None
        fixed = self.repair(value)
        return fixed if fixed != re.sub(r"[^\S\n\r]+", " ", value).strip() else None

    # ---- training --------------------------------------------------------------------

    def train(self, clean: list[str], seed: int = 7, rounds: int = 2) -> None:
        rng = random.Random(seed)
        for _ in range(rounds):
            rng.shuffle(clean)
            for line in clean:
                self._train_lines(line, rng)
                damaged, gold = damage(line, rng)
                self.edit(damaged, gold)
        self.lines.average()
        self.chars.average()

    def _train_lines(self, line: str, rng: random.Random) -> None:
        words = line.split(" ")
        if len(words) < 3:
            return
        numbers = [i for i in range(1, len(words)) if words[i][:1].isdigit()]
        at = sorted({*rng.sample(range(1, len(words)), min(2, len(words) - 1)), *(numbers[:1] if rng.random() < 0.3 else ())})
        parts = [" ".join(words[a:b]) for a, b in zip([0, *at], [*at, len(words)])]
        for k in range(len(parts) - 1):  # some breaks stand inside a word
            w = parts[k + 1].split(" ")[0]
            if rng.random() < 0.4 and w.isalpha() and len(w) > 4:
                cut = rng.randint(2, len(w) - 2)
                parts[k], parts[k + 1] = f"{parts[k]} {w[:cut]}{rng.choice(HYPHENS)}", parts[k + 1][cut:]
        for i, p in enumerate(parts):
            place = "first" if i == 0 else "last" if i == len(parts) - 1 else "inner"
            before, after = parts[i - 1] if i else "", parts[i + 1] if i + 1 < len(parts) else ""
            self.lines.learn(line_features(p, place, before, after, self.words, self._share(p)), self.LINE, "text")
        for _ in range(2):
            mark = self._mark([w for w in words if w.isalpha()], rng)
            i = rng.randint(1, len(parts) - 1)
            share = self._share(mark) or (HEADER_SHARE * rng.choice((2, 2, 0.3, 0)))
            long = max(re.findall(r"[^\W\d_]+", mark), key=len, default="")
            if len(long) > 4 and rng.random() < 0.25:  # a header broken over a line is joined first
                cut = mark.index(long) + rng.randint(2, len(long) - 2)
                pieces = (mark[:cut] + rng.choice(HYPHENS), mark[cut:])
                for x, left, right in ((pieces[0], parts[i - 1], pieces[1]), (pieces[1], pieces[0], parts[i])):
                    self.lines.learn(line_features(x, "inner", left, right, self.words, self._share(x)), self.LINE, "text")
            elif any(c.isdigit() for c in mark) or share >= HEADER_SHARE:
                self.lines.learn(line_features(mark, "inner", parts[i - 1], parts[i], self.words, share), self.LINE, "furniture")

    def _mark(self, words: list[str], rng: random.Random) -> str:
        """A page mark, or a made-up running header of some words and mostly a number."""
        if rng.random() < 0.4 or not words:
            mark = rng.choice(MARKS)
        else:
            some = [rng.choice(words) for _ in range(rng.randint(1, 4))]
            if len(some) > 2:
                some[rng.randint(1, len(some) - 2)] = rng.choice(("of", "the", "and", "de"))
            some = rng.choice((str.upper, str.lower, lambda x: re.sub(r"\b\w{4,}", lambda m: m.group().title(), x)))(" ".join(some))
            mark = rng.choice(("# {}", "{} #", "{}   #", "{} #   {}", "{} # {}", "#   {}", "{}")).replace("{}", some, 1).replace("{}", rng.choice(words))
        mark = mark.replace("#", str(rng.randint(1, 1200)))
        return damage(mark, rng, breaks=False)[0] if rng.random() < 0.15 else mark


def damage(line: str, rng: random.Random, breaks: bool = True, misread: float = 0.06) -> tuple[str, list[str]]:
    """A damaged copy of a clean line, and for each of its characters the operation that undoes it."""
    out: list[str] = []
    gold: list[str] = []
    i = 0
    while i < len(line):
        c = line[i]
        hit = None
        if c.isalpha() and rng.random() < misread:
            fits = [(r, m) for r, m in MISREAD + LOST if line.startswith(m, i)]
            hit = rng.choice(fits) if fits else None
        if hit:
            read, meant = hit
            out.extend(read)
            gold.extend([f"I:{meant[len(read):]}" if meant.startswith(read) else f"R:{meant}"] + ["D"] * (len(read) - 1))
            i += len(meant)
            continue
        out.append(c)
        gold.append("K")
        if breaks and c == " " and rng.random() < 0.04:
            out[-1], gold[-1] = "\n", "S"
        elif breaks and c.isalpha() and line[i + 1 : i + 2].isalpha() and line[i - 1 : i].isalpha() and rng.random() < 0.03:
            hyphen = rng.choice(HYPHENS + "--")
            gap = rng.choice(["\n", " \n", "\r\n", " "])
            out.extend(hyphen + gap)
            gold.extend("J" * (1 + len(gap)))
        i += 1
    return "".join(out), gold


def word_counts(values: DataFrame) -> DataFrame:
    """``word, n`` over all values, hyphenated compounds included; counted per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for v in b.column(0).to_pylist():
                c.update(_WORD.findall(v))
                if "-" in v:
                    c.update(re.findall(r"[^\W_]+-[^\W_]+", v))
            if len(c) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
                c.clear()
        if c:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    return values.where("value is not null").select("value").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: The worker's editor, by the mark of the broadcast it was made from.
_EDITORS: dict[str, Editor] = {}


def line_shapes(values: DataFrame) -> DataFrame:
    """``shape, n, share`` of the short lines of broken values that make at least :data:`SHAPE_SHARE` of them:
    at most ``1 / SHAPE_SHARE`` rows, whatever the number of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = Counter(_shape(x)[:61] for v in b.column(0).to_pylist() for x in re.split(r"\r\n|\n|\r", v) if x.strip())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["shape", "n"])

    counted = values.where(F.col("value").rlike("[\n\r]")).select("value").mapInArrow(run, "shape string, n long").groupBy("shape").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    total = counted.agg(F.sum("n").alias("total"))
    return counted.where("n > 1 and length(shape) <= 60").crossJoin(F.broadcast(total)).where(F.col("n") >= SHAPE_SHARE * F.col("total")).select("shape", "n", (F.col("n") / F.col("total")).alias("share"))


def train_editor(counts: dict[str, int], sample: list[str], lines: dict[str, tuple[int, float]] | None = None) -> Editor:
    """An editor for a corpus of these word counts and line shapes, fitted on the clean ones of the sampled values."""
    words = Words(counts)
    lines = lines or {}
    editor = Editor(words, {s: share for s, (_, share) in lines.items()})
    pieces = re.compile(r"([^\W_]+)- ([^\W_]+)")
    suspect = header_pattern([s for s, (n, share) in lines.items() if n >= HEADER_SEEN and share >= HEADER_SHARE])
    whole = [v for v in sample if not re.search(r"[\n\r¬\xad‐ﬀﬁﬂ]", v) and not (suspect and suspect.search(v)) and not any(words.sound("".join(m)) for m in pieces.findall(v))]
    editor.train([v for v in whole if all(words.known(w) and words.fix(w) is None for w in _WORD.findall(v))])
    editor.find_headers({s: n for s, (n, _) in lines.items()})
    return editor


_BROKEN = re.compile(r"([^\W_]+)[-¬\xad‐][ \r]*\n?[ ]*([^\W_]+)")


def _words_of(v: str) -> set[str]:
    """Words whose counts the editor asks for first: those of the value, those joined over a break, compounds."""
    found = set(_WORD.findall(v))
    at, m = 0, _BROKEN.search(v)
    while m:
        found |= {m[1] + m[2], f"{m[1]}-{m[2]}"}
        at = m.start(2)
        m = _BROKEN.search(v, at)
    for run in re.findall(r"[^\W_]+(?:[-¬\xad‐][ \r]*\n?[ ]*[^\W_]+)+", v):
        found.add("".join(_WORD.findall(run)))
    return found


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(uid, w) for uid, v in zip(*(c.to_pylist() for c in b.columns)) for w in _words_of(v)]
        cols = list(zip(*rows)) if rows else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], names=["uid", "word"])


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(w, t) for w in b.column(0).to_pylist() if len(w) >= 2 and not w.isdigit() and not _ORDINAL.match(w) for t in {t for level in undone(w) for t, _ in level}]
        cols = list(zip(*rows)) if rows else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())], names=["word", "meant"])


def counts_held(counts: DataFrame) -> dict[str, int]:
    rows = counts.toPandas()
    return dict(zip(rows["word"], rows["n"].astype(int)))


def word_marks(counts: DataFrame, n: int) -> bytes:
    """A filter of the ``n`` words that have a count: whoever is not in it has none."""
    bits = 1 << 15
    while bits < min(BITS * n, MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([p + 1 for w in b.column(0).to_pylist() for p in _places(w, bits)], pa.int64())], names=["place"])

    placed = counts.select("word").mapInArrow(run, "place long")
    parts = placed.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("marks"))
    marks = bytearray(bits >> 3)
    for part, some in parts.toLocalIterator():
        at = (part - 1) << 12
        marks[at : at + len(some)] = some
    return bytes(marks)


def _joined_damage(values: DataFrame, counts: DataFrame, n: int, most_words: int, editor: Editor) -> DataFrame:
    """The same result for a vocabulary of any size.  The editor works with the counts it has, first of the most
    frequent words, and writes down those it misses; values that miss none are done, the others come again with all
    they asked for, until none is left."""
    kind = values.schema["record_id"].dataType.simpleString()
    frequent = counts_held(counts.orderBy(F.desc("n"), "word").limit(most_words))
    handle = values.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, frequent, editor.shapes, editor.headers, editor.lines.w, editor.chars.w, word_marks(counts, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = handle.value
        e = _EDITORS.get(data[0])
        if e is None:
            _EDITORS.clear()
            e = Editor(HeldWords(Held(data[1], data[6])), data[2], data[3])
            e.lines.w, e.chars.w = data[4], data[5]
            _EDITORS[data[0]] = e
        held = e.words.n
        for b in batches:
            out = []
            for uid, t, r, v, known in zip(*(c.to_pylist() for c in b.columns)):
                held.hold({k["word"]: k["n"] for k in known or ()})
                f = e.damaged(v)
                if not held.missing:
                    if f is not None:
                        out.append((uid, t, r, v, f, None))
                    continue
                if known is None:
                    for w in _words_of(v):
                        held.get(w)
                        e.words.fix(w)
                out.append((uid, t, r, v, None, [*held.counts, *held.missing]))
            cols = list(zip(*out)) if out else [[]] * 6
            types = (pa.int64(), pa.string(), b.column(2).type, pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], names=["uid", "table_name", "record_id", "value", "repaired", "asked"])

    schema = f"uid long, table_name string, record_id {kind}, value string, repaired string, asked array<string>"
    left = values.withColumn("uid", F.monotonically_increasing_id()).withColumn("known", F.lit(None).cast("array<struct<word:string,n:bigint>>"))
    found = None
    while True:
        came = cut_lineage(left.select("uid", "table_name", "record_id", "value", "known").mapInArrow(run, schema))
        done = came.where("asked is null").select("table_name", "record_id", "value", "repaired")
        found = done if found is None else found.unionByName(done)
        again = came.where("asked is not null")
        if again.isEmpty():
            return found
        asked = again.select("uid", F.explode("asked").alias("word")).join(counts, "word", "left")
        packed = asked.groupBy("uid").agg(F.collect_list(F.struct("word", F.coalesce("n", F.lit(0)).alias("n"))).alias("known"))
        left = again.drop("repaired", "asked").join(packed, "uid")


def scan_damage(values: DataFrame, trained_on: int = TRAINED_ON, most_words: int = MOST_WORDS) -> DataFrame:
    """``table_name, record_id, value, repaired`` of every damaged value.

    ``values`` has table_name, record_id and value.  Defined results: null and empty values
    are no case; repeated rows come out as often as they came in; an empty table gives no
    rows; hyphens, numbers and page numbers that belong to the text stay.  The counts of
    the ``most_words`` most frequent words are sent to every task; those of further ones are
    joined to the values that ask for them, until each has every count it asks for."""
    spark = values.sparkSession
    values = values.where("value is not null and value <> ''").select("table_name", "record_id", "value")
    counts = cut_lineage(word_counts(values).where("n > 1"))
    sample = sorted({r[0] for r in values.select("value").orderBy(F.xxhash64("value"), "value").limit(2 * trained_on).collect()})
    # whatever the number of words, the models are fitted on those of the sample and their corrections
    here = spark.createDataFrame([(0, v) for v in sample], "uid long, value string").mapInArrow(_looked_up, "uid long, word string").select("word").distinct()
    kept = counts_held(counts.join(here.union(here.mapInArrow(_corrections, "word string, meant string").select("meant")).distinct(), "word", "left_semi"))
    lines = {r[0]: (r[1], r[2]) for r in line_shapes(values).collect()}
    editor = train_editor(kept, sample, lines)
    n = counts.count()
    if n > most_words:
        return _joined_damage(values, counts, n, most_words, editor)
    handle = spark.sparkContext.broadcast((uuid.uuid4().hex, counts_held(counts), editor.shapes, editor.headers, editor.lines.w, editor.chars.w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = handle.value
        e = _EDITORS.get(data[0])
        if e is None:
            _EDITORS.clear()
            e = Editor(Words(data[1]), data[2], data[3])
            e.lines.w, e.chars.w = data[4], data[5]
            _EDITORS[data[0]] = e
        for b in batches:
            rows = [(t, r, v, f) for t, r, v in zip(*(c.to_pylist() for c in b.columns)) if (f := e.damaged(v)) is not None]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], b.column(1).type), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["table_name", "record_id", "value", "repaired"])

    kind = values.schema["record_id"].dataType.simpleString()
    return values.mapInArrow(run, f"table_name string, record_id {kind}, value string, repaired string")
