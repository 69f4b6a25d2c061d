"""Secret scan: base patterns and sliding-window entropy with allow-list suppression (operator 10).

The base kinds are fixed patterns. On top of them, candidate strings (runs of
token characters that hold a digit) are scanned per character class: a window
slides over the string, symbol counts are updated by the character that enters
and the one that leaves, and the window's Shannon entropy follows from the
running sum of c*log2(c). A string whose best window reaches its class's limit
is a finding.

Base findings and what the allow-list knows are cut out of a candidate first, and
what remains on either side is scanned for itself: they silence no neighbour. A
known word silences the part between separators that holds it, and of a very long
part only the slices that hold it. A remainder below its limit is scanned again
part by part, as a separator makes its class a wider one with a higher limit.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.frames import bounded_batches, pick

#: Fixed patterns; offsets are code points, the span is the whole match.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")
MIN_ASSIGN, MIN_ACCESS = 8, 16

MIN_CANDIDATE = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE, re.ASCII)
#: What stands between separators, the separators, and how far on either side a known word silences its part.
PART = re.compile(r"[A-Za-z0-9]+")
SEPARATORS = "+/_=-"
REACH = 64
WINDOW = 20
#: Entropy in bits a symbol that the best window of a class must reach, highest class first met.
LIMITS = (("hex", re.compile(r"[0-9a-fA-F]+\Z"), 3.0), ("alnum", re.compile(r"[A-Za-z0-9]+\Z"), 3.7),
          ("base64", re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 3.9))
#: Strings that are known to be no secrets: placeholders, UUIDs, dates and plain numbers. Patterns that begin with .* are
#: sought in each part, the others at a candidate's start.
ALLOW = (r"(?i).*(example|sample|placeholder|changeme|dummy|x{6,})", r"[0-9+/_=-]+\Z",
         r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_PLOGP = [0.0] + [c * math.log2(c) for c in range(1, 257)]


def best_entropy(text: str, window: int = WINDOW, enough: float = math.inf) -> float:
    """Highest Shannon entropy of a window, by counts updated one character at a time; stops at ``enough``."""
    size = min(window, len(text))
    if not size:
        return 0.0
    counts: dict[str, int] = {}
    total = 0.0  # sum of c*log2(c)
    log_size, low = math.log2(size), math.inf
    bound = size * (log_size - enough)
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += _PLOGP[c + 1] - _PLOGP[c]
        if i >= size:
            old = text[i - size]
            c = counts[old]
            counts[old] = c - 1
            total += _PLOGP[c - 1] - _PLOGP[c]
        if i >= size - 1 and total < low:
            low = total
            if low <= bound:
                break
    return log_size - low / size


def _has_digit(text: str) -> bool:
    return any(c in text for c in "0123456789")


def _reaches(word: str, window: int, limits) -> bool:
    """Whether the best window of a string that holds a digit reaches the limit of the string's class."""
    if not _has_digit(word):
        return False
    limit = next((limit for _, form, limit in limits if form.match(word)), math.inf)
    return limit < math.inf and best_entropy(word, window, limit) >= limit


def _known(word: str, words: re.Pattern, shapes: re.Pattern) -> list[tuple[int, int]]:
    """Spans of a candidate that the allow-list knows."""
    m = shapes.match(word)
    out = [m.span()] if m and m.end() else []
    if words.search(word):  # else none of its parts holds one
        for m in PART.finditer(word):
            out += [(max(m.start(), w.start() - REACH), min(m.end(), w.end() + REACH))
                    for w in words.finditer(word, m.start(), m.end())]
    return out


def _rest(word: str, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the cuts leave of a candidate, without the separators beside a cut, where it is long enough."""
    out, at = [], 0
    for s, e in sorted([*cuts, (len(word), len(word))]):
        a, b = at, s
        while at and a < b and word[a] in SEPARATORS:
            a += 1
        while s < len(word) and a < b and word[b - 1] in SEPARATORS:
            b -= 1
        if b - a >= MIN_CANDIDATE:
            out.append((a, b))
        at = max(at, e)
    return out


def scan(text: str, window: int = WINDOW, limits=LIMITS, allow=None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every finding, by start and then kind as listed."""
    words, shapes = _allow(ALLOW) if allow is None else allow
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found = list(base)
    base.sort()
    ahead = 0  # base findings from here on can meet the candidate
    for m in CANDIDATE.finditer(text):
        word, first = m.group(), m.start()
        if not _has_digit(word):
            continue
        while ahead < len(base) and base[ahead][2] <= first:
            ahead += 1
        cuts = _known(word, words, shapes)
        for i in range(ahead, len(base)):
            s, _, e = base[i]
            if s >= m.end():
                break
            if e > first:
                cuts.append((max(s - first, 0), min(e - first, len(word))))
        for s, e in _rest(word, cuts):
            piece = word[s:e]
            if (known := shapes.match(piece)) and known.end() == len(piece):
                continue
            if _reaches(piece, window, limits):
                found.append((first + s, 3, first + e))
                continue
            for p in PART.finditer(piece):
                if MIN_CANDIDATE <= p.end() - p.start() < len(piece) and not shapes.match(p.group()) and _reaches(
                        p.group(), window, limits):
                    found.append((first + s + p.start(), 3, first + s + p.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def _allow(patterns) -> tuple[re.Pattern, re.Pattern]:
    """The patterns sought in each part (those that begin with .*), and those matched at a candidate's start."""
    both = [[], []]
    for p in patterns:
        bare = p.removeprefix("(?i)")
        sought = bare.removeprefix(".*")
        both[sought == bare].append(f"(?:{sought})" if bare == p else f"(?i:{sought})")
    return tuple(re.compile("|".join(b) or r"(?!)") for b in both)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    Rows are looked at on their own: repeated ones repeat their findings, an empty table has none.
    ``spans`` joins kind:start:end by commas, in code points, end exclusive, by start and then kind;
    ``base_sha256`` hashes the same list without the entropy findings. Null text is empty: no finding.
    ``allow`` holds regular expressions. One that begins with ``.*`` is sought in the parts (between separators) and silences what it
    finds and ``REACH`` characters of the part on either side; any other is matched at a candidate's start and silences what it matches.
    """

    def run(batches):
        import pyarrow as pa
        known = _allow(allow)
        for batch in batches:
            out = [[], [], [], [], [], []]
            for text in batch.column(1).to_pylist():
                found = scan(text, window, LIMITS, known) if text else []
                kinds = [k for _, k, _ in found]
                base = ",".join(f"{k}:{s}:{e}" for s, k, e in found if k != "entropy")
                for col, v in zip(out, (*(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(),
                                        ",".join(f"{k}:{s}:{e}" for s, k, e in found)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string()),
                 pa.array(out[5], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    bounded_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, "
                                "base_sha256 string, spans string")
