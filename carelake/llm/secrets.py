"""Secrets in text: fixed patterns, and a password guess-cost search over values in credential contexts.

The guess cost of a value is the least sum of log10 guesses over all ways to cut it into words, dates, repeats, keyboard
walks and brute-force spans. Words cost by their rank among common passwords and the words of a public vocabulary, letters of a
brute-force span what random ones do. A value after a credential key whose cost is high is a secret, whatever its alphabet or
length; plain words or a date after such a key are not.

Spans are (kind, start, end) in code points, end exclusive. Kinds in order: assign (the value, or the whole match), access, hex, guess. A guess
span is added only where no base span covers it.

Defined results: a null text is empty and has no spans; repeated rows each get their own result.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits is one match, so shorter runs need no match of their own
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
#: Credential keys beyond the base ones, and a value of any printable characters.
_CONTEXT = re.compile(
    r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|auth(?:orization)?|credentials?|access_?key|private_?key|bearer|login)"""
    r"""["']?[\x20\t]*(?:[:=]|\bis\b)[\x20\t]*(?:bearer[\x20\t]+)?["'`]?([^\s"'`<>|,;]+)""",
    re.IGNORECASE | re.ASCII,
)
_CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "login")
MIN_COST = 10.0

# Words that guessers try first, most common first; the words of the vocabulary follow them.
COMMON_WORDS = (
    "password qwerty welcome admin letmein dragon monkey login master hello freedom whatever shadow sunshine princess football "
    "baseball secret summer winter spring autumn love test guest root user default changeme example sample demo temp public private "
    "access token key code money computer internet server system database service company michael jordan jennifer thomas charlie "
    "andrew daniel george robert william orange purple yellow silver golden flower butterfly chocolate cookie banana pepper ginger "
    "tiger soccer hockey killer ranger hunter buster batman superman starwars matrix pass word the and you for not this that with "
    "value string null none true false your here enter insert replace placeholder redacted hidden unknown required optional"
).split()
_RANK = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
_LEET = str.maketrans("013457@$!", "oleastasi")
_LEET_CHARACTERS = frozenset("013457@$!")
_WALKS = tuple(w + "|" + w[::-1] for w in ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm"))
_WALK_KEYS = frozenset(w[i : i + 3] for w in _WALKS for i in range(len(w) - 2))
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
#: Letters of the longest word, date and repeated unit; longer walks are taken as far as they go.
LONGEST = 20
#: Letters of a value that is compared with itself letter by letter; longer ones as arrays.
SHORT = 64
#: log10 guesses of a brute-force span: to begin one, and for each character by what the span is made of.
START = 1.0
LETTER, DIGIT, LETTER_OR_DIGIT, ANY = math.log10(26), 1.0, math.log10(62), math.log10(95)
_DIVISORS = {u: [d for d in range(1, u) if u % d == 0] for u in range(1, LONGEST + 1)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def word_ranks(path: str) -> dict[str, int]:
    """Ranks of plain words of 3 to ``LONGEST`` letters: the common ones, then whole words of a vocabulary file in its order."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks = dict(_RANK)
    for token in sorted(vocabulary, key=vocabulary.get):
        word = token.removesuffix("</w>").lower()
        if token != word and 3 <= len(word) <= LONGEST and word.isascii() and word.isalpha():
            ranks.setdefault(word, len(ranks) + 1)
    return ranks


@lru_cache(4096)
def _kinds(c: str) -> tuple[bool, bool, bool, bool]:
    """Whether a character is a small letter, a capital, a digit, and a letter or digit; others only cost as any character."""
    if not c.isascii():
        return False, False, False, False
    return c.islower(), c.isupper(), c.isdigit(), c.isalnum()


def _brute(text: str) -> float:
    kinds = [_kinds(c) for c in text]
    if all(k[0] for k in kinds) or all(k[1] for k in kinds) or (kinds[0][1] and all(k[0] for k in kinds[1:])):
        return START + LETTER * len(text)
    return START + len(text) * (DIGIT if all(k[2] for k in kinds) else LETTER_OR_DIGIT if all(k[3] for k in kinds) else ANY)


def _segment(text: str, ranks: dict[str, int] = _RANK) -> float:
    """log10 guesses of a whole piece as a word, a date or a walk; infinite if it is none."""
    n, low, best = len(text), text.lower(), math.inf
    if n <= LONGEST:
        leet = low if _LEET_CHARACTERS.isdisjoint(low) else low.translate(_LEET)
        for word, turned in ((low, 0.0), (leet, 1.0), (low[::-1], 0.3)):
            if rank := ranks.get(word):
                case = 0.0 if text == low else 0.3 if text in (low.upper(), low.capitalize()) else 0.3 * sum(c.isupper() for c in text)
                best = min(best, math.log10(rank) + turned + case)
    if n >= 3:
        if low[:3] in _WALK_KEYS and any(low in w for w in _WALKS):
            best = min(best, 1.5 + 0.3 * n)
        if text[0] in "0123" and _DATE.fullmatch(text):
            best = min(best, 4.6)
    return best


def _run_lengths(value: str, u: int) -> list[int]:
    out = [0] * len(value)
    if not u or not any(map(eq, value, value[u:])):
        return out
    for at in range(len(value) - u - 1, -1, -1):
        if value[at] == value[at + u]:
            out[at] = out[at + 1] + 1
    return out


def _agreement(value: str) -> list[np.ndarray] | list[list[int]]:
    """For every unit size: how many characters from each place on equal the one a unit later."""
    if len(value) <= SHORT:
        return [_run_lengths(value, u) for u in range(min(LONGEST, len(value) // 2) + 1)]
    points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, out = len(points), [np.zeros(len(points), np.int64)]
    for u in range(1, min(LONGEST, n // 2) + 1):
        ends = np.append(np.flatnonzero(points[:-u] != points[u:]), n - u)
        place = np.arange(n - u)
        out.append(np.append(ends[np.searchsorted(ends, place)] - place, np.zeros(u, np.int64)))
    return out


def guess_cost(value: str, enough: float = MIN_COST, ranks: dict[str, int] = _RANK) -> float:
    """log10 of the guesses for the cheapest segmentation of the whole value; costs from ``enough`` on read as ``enough``.

    Pieces are words, dates, walks, brute-force spans and repeats of such a piece of at most ``LONGEST`` letters. Costs never fall
    along a segmentation, so a start at ``enough`` is not extended. A brute-force span is carried character by character, one
    for each make-up, and a repeat from its second unit on, one for each place in the unit; so time grows with the length.
    """
    n = len(value)
    cost = [0.0] + [math.inf] * n
    low, equal = value.lower(), _agreement(value)
    units = [u for u in range(1, len(equal)) if int(max(equal[u]) if isinstance(equal[u], list) else equal[u].max()) >= u]  # those that some place repeats
    if len(low) != n:  # some letters have no small form of one character
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    prefixes, leet = _prefixes(ranks), low.translate(_LEET)
    segments: dict[str, float] = {}
    pieces: dict[str, float] = {}

    def segment(text: str) -> float:
        if (c := segments.get(text)) is None:
            c = segments[text] = _segment(text, ranks)
        return c

    def piece(text: str) -> float:
        if (c := pieces.get(text)) is None:
            c = pieces[text] = min(_brute(text), segment(text))
        return c

    open_ = [math.inf] * 6  # brute-force spans: small, capital, capital then small, digits, letters and digits, any
    # by unit size: stretches that agree with themselves a unit later, as their end and the starts in them by place in the unit
    repeats: dict[int, list[tuple[int, dict[int, list[tuple[float, int]]]]]] = {}
    reach = 0
    for at in range(n + 1):
        if at:
            small, capital, digit, plain = _kinds(value[at - 1])
            base = cost[at - 1] + START if cost[at - 1] < enough else math.inf
            first = base + LETTER
            open_ = [
                min(open_[0] + LETTER, first) if small else math.inf, min(open_[1] + LETTER, first) if capital else math.inf,
                first if capital else open_[2] + LETTER if small else math.inf, min(open_[3], base) + DIGIT if digit else math.inf,
                min(open_[4], base) + LETTER_OR_DIGIT if plain else math.inf, min(open_[5], base) + ANY,
            ]
            cost[at] = min(cost[at], *open_)
            for u in list(repeats) if repeats else ():
                if repeats[u][0][0] < at:
                    repeats[u] = [r for r in repeats[u] if r[0] >= at]
                    if not repeats[u]:
                        del repeats[u]
                        continue
                for _, starts in repeats[u]:
                    for paid, start in starts.get(at % u, ()):
                        if at - start >= max(3, 2 * u):
                            cost[at] = min(cost[at], paid + math.log10((at - start) // u))
        here = cost[at]
        if at == n:
            break
        if here >= enough:
            if at >= reach and not repeats and min(open_) >= enough:
                return enough
            continue
        key = low[at : at + 3]
        if key in prefixes or key in _WALK_KEYS or value[at] in "0123" or leet[at : at + 3] in prefixes:
            for size in range(3, min(LONGEST, n - at) + 1):
                step = here + segment(value[at : at + size])
                if step < enough:
                    cost[at + size] = min(cost[at + size], step)
                    reach = max(reach, at + size)
        size = LONGEST + 1
        while at + size <= n and any(low[at : at + size] in w for w in _WALKS):
            cost[at + size] = min(cost[at + size], here + 1.5 + 0.3 * size)
            reach, size = max(reach, at + size), size + 1
        for u in units:
            if 2 * u > n - at:
                break
            if equal[u][at] < u:
                continue
            paid = here + piece(value[at : at + u])
            if paid >= enough:
                continue
            # a unit that repeats itself costs less by its own unit, unless it is a cheap word
            inner = next((d for d in _DIVISORS[u] if equal[d][at] >= u - d), 0)
            if inner and paid >= here + piece(value[at : at + inner]) + math.log10(u // inner):
                continue
            end = int(at + u + equal[u][at])
            runs = repeats.setdefault(u, [])
            if not runs or runs[-1][0] != end:
                runs.append((end, {}))
            starts = runs[-1][1]
            older = starts.get(at % u, [])
            # the start that costs less at two units goes on to: what the older one has counted matters ever less
            if not any(p + math.log10((at - s) // u + 2) <= paid + math.log10(2) for p, s in older):
                starts[at % u] = [(p, s) for p, s in older if p < paid] + [(paid, at)]
    return min(cost[n], enough)


@lru_cache(4)
def _prefix_set(key: int, n: int) -> frozenset[str]:
    ranks = _KNOWN[key]
    return frozenset(w[:3] for w in ranks) | frozenset(w[::-1][:3] for w in ranks)


_KNOWN: dict[int, dict[str, int]] = {}


def _prefixes(ranks: dict[str, int]) -> frozenset[str]:
    """First letters of all words and of all words turned round."""
    _KNOWN[id(ranks)] = ranks
    return _prefix_set(id(ranks), len(ranks))


def find_secrets(text: str, ranks: dict[str, int] = _RANK, whole: bool = False) -> list[tuple[str, int, int]]:
    """All spans of one text by start, then kind. An assign span is the value, or with ``whole`` all of its match."""
    low, part = text.lower(), 0 if whole else 2
    spans: list[tuple[str, int, int]] = []
    if any(h in low for h in _ASSIGN_HINTS):
        spans += [("assign", m.start(part), m.end(part)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if any(h in low for h in _CONTEXT_HINTS):
        base = sorted((x, y) for _, x, y in spans)
        costs: dict[str, float] = {}  # each different value is costed once
        at = covered = 0  # base spans that start up to here, and how far they reach
        for m in _CONTEXT.finditer(text):
            a, b = m.span(1)
            b = a + len(m[1].rstrip(".:!?)]}"))
            while at < len(base) and base[at][0] <= a:
                covered, at = max(covered, base[at][1]), at + 1
            if covered >= b:
                continue
            if (cost := costs.get(value := text[a:b])) is None:
                cost = costs[value] = guess_cost(value, ranks=ranks)
            if cost >= MIN_COST:
                spans.append(("guess", a, b))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch], held, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in batch.column("text"):
            spans = find_secrets(t.as_py() or "", held.value, whole)
            base = [s for s in spans if s[0] != "guess"]
            n = [sum(s[0] == k for s in spans) for k in KINDS]
            rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        names = ["n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *names])


def secret_report(docs: DataFrame, vocabulary: str | None = None, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans. No row is shuffled.

    ``vocabulary`` is a vocabulary file with word ends, by default that of a public tokenizer; its words, at most as many as it
    has tokens, go to the tasks. ``whole`` reports assignments from their key to the end of the value, not the value alone.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(word_ranks(vocabulary or default_vocabulary()))
    fields = f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _scan(batches, held, whole), fields)
