"""Personal data in whole texts: fixed patterns, and a semi-Markov model of whole spans.

The patterns (``base_spans``) find e-mail addresses, IPv4 addresses, card and phone numbers.
They are applied in linear time, whatever the text.

The model looks at *fields*: runs of words on one line, one space apart, that hold a digit or
an ``@``, or stand around the word "dot". In a field, candidate segments are runs of at most
``MOST_TOKENS`` tokens and ``MOST_CHARS`` characters with the form of any kind of personal data
(``_may_be``). Features are of the whole candidate: its shape, the number of its digits, check
sums, what stands beside it, the nearest cue word before it. The best segmentation of a
field chooses boundaries and kinds together. It is trained on labelled lines that the module
makes from a seed. Segments that overlap no base span are added to the base spans, which all stay."""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sonagrid.llm import semicrf, spans

BASE = ("email", "ip", "card", "phone")
#: Kinds in the order in which they are listed; those after the base kinds are the model's own.
KINDS = (*BASE, "iban", "mac", "ip6", "ssn", "secret")
LABELS = ("", *KINDS)
MOST_TOKENS, MOST_CHARS, MOST_DIGITS = 10, 128, 34
#: Words before a candidate among which a cue is looked for.
CUE_WORDS = 4

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no match can begin inside a run of digits if none begins at its first digit
_IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOT = re.compile(rb"(?<![^\s\[(])dot(?![^\s\])])", re.IGNORECASE)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b < 58)


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = (d - 48) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: bytes) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find(b"@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        free = found.end() if found else at + 1
        if found:
            yield begin, free
        at = text.find(b"@", free)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(begin, end, kind) in bytes, by begin, then kind. ``text`` is UTF-8."""
    out = [(i, j, 0) for i, j in _emails(text)]
    out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip(b"0")) < 4 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b"."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].translate(None, b" -")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(m[0].translate(None, _NOT_DIGIT)) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


#: What may be a token, before marks at its ends are taken off.
_PIECE = re.compile(r"""[^\s"'=<>,;|{}]+""")
#: A label before a colon has a letter that is no hexadecimal digit and so many characters at most.
_LABEL, MOST_LABEL = re.compile(r"[A-Za-z]*[G-Zg-z][A-Za-z]*"), 24
_NUMBERS = re.compile(r"[+(]?\(?\d[\d ().-]*\d")
_EMAIL_LIKE = re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+")
_SPOKEN = re.compile(r"[\w.-]+ [(\[]?at[)\]]? [\w-]+( [(\[]?dot[)\]]? [a-z]{2,12})+", re.IGNORECASE)
_SHAPES = {
    "mac": re.compile(r"[0-9a-f]{2}([:-][0-9a-f]{2}){5}", re.IGNORECASE),
    "ip6": re.compile(r"[0-9a-f]{0,4}(:[0-9a-f]{0,4}){3,7}", re.IGNORECASE),
    "ssn": re.compile(r"\d{3}-\d{2}-\d{4}"),
    "ip4": re.compile(r"\d{1,3}(\.\d{1,3}){3}"),
    "date": re.compile(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{1,2}:\d{2}(:\d{2})?"),
    "card": re.compile(r"\d{4}([ -]\d{4}){2,3}([ -]?\d{1,3})?|\d{12,19}"),
    "nanp": re.compile(r"(\+?\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}"),
}
#: Words that announce a kind.
_CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write"), "phone": ("phone", "tel", "call", "fax", "mobile", "telephone", "cell"), "card": ("card", "visa", "credit", "pan"), "ip": ("ip", "host", "address", "server"),
    "iban": ("iban", "account", "bank"), "mac": ("mac", "device", "ethernet"), "ssn": ("ssn", "social", "security"), "secret": ("token", "secret", "key", "password", "apikey", "api_key", "passwd", "auth"),
    "number": ("order", "isbn", "invoice", "version", "page", "commit", "no", "id", "serial", "on", "since", "at"),
}
_CUE = {word: kind for kind, words in _CUES.items() for word in words}
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_IBAN = re.compile(r"[A-Z]{2}\d{2}([ ]?[A-Z0-9]){11,30}")


def _iban_holds(text: str) -> bool:
    flat = text.replace(" ", "")
    return len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _may_be(text: str, digits: int) -> bool:
    """Whether a run of tokens has the form of any kind."""
    if "@" in text or "dot" in text.lower():
        return bool(_EMAIL_LIKE.fullmatch(text) or _SPOKEN.fullmatch(text))
    if ":" in text:
        return bool(_SHAPES["mac"].fullmatch(text) or _SHAPES["ip6"].fullmatch(text))
    if 7 <= digits <= 19 and _NUMBERS.fullmatch(text):
        return True
    if " " not in text and digits and len(text) >= 16:
        return text.isascii() and text.replace("_", "").replace("-", "").isalnum()
    return bool(_IBAN.fullmatch(text) or _SHAPES["mac"].fullmatch(text))


@lru_cache(maxsize=1 << 14)
def _of_span(text: str) -> tuple[str, ...]:
    """Features of a candidate by itself."""
    digits = sum(c.isascii() and c.isdigit() for c in text)
    shape = re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}" if len(m[0]) < 20 else "9+", re.sub(r"[^\W\d_]+", "a", text))
    out = ["any", f"shape {shape}" if len(shape) < 40 else "shape long", f"digits {min(digits, 36)}", f"first {text[0] if not text[0].isalnum() else 'd' if text[0].isdigit() else 'a'}", f"last {text[-1] if not text[-1].isalnum() else 'd' if text[-1].isdigit() else 'a'}"]
    marks = "".join(sorted({c for c in text if not c.isalnum()}))
    out += [f"marks {marks}", "letters" if any(c.isalpha() for c in text) else "no letters"]
    out += [name for name, shaped in _SHAPES.items() if shaped.fullmatch(text)]
    if _EMAIL_LIKE.fullmatch(text):
        out.append("like email")
    if _SPOKEN.fullmatch(text):
        out.append("spoken email")
    flat = text.replace(" ", "").replace("-", "")
    if flat.isascii() and flat.isdigit() and 12 <= len(flat) <= 19:
        out.append("luhn" if luhn(flat.encode()) else "not luhn")
    if "ip4" in out:
        out.append("parts fit" if all(int(p) <= 255 for p in text.split(".")) else "parts over")
    if _IBAN.fullmatch(text):
        out.append("iban" if _iban_holds(text) else "not iban")
    if text.isascii() and text.isalnum() and 0 < digits < len(text):
        out.append(f"{'hex' if _HEX.fullmatch(text) else 'mixed'} {next((n for n in (64, 40, 32, 16) if len(text) >= n), 0)}{'' if len(text) in (32, 40, 64) else '+'}")
    if text.startswith("+") and 9 <= digits <= 15 and not any(c.isalpha() for c in text):
        out.append("international")
    if text.count("(") != text.count(")"):
        out.append("unbalanced")
    return tuple(out)


def _cue(before: str) -> str:
    """The kind that the nearest cue word before a place announces."""
    for word in reversed(re.findall(r"[\w-]+", before.lower())[-CUE_WORDS:]):
        if word in _CUE:
            return _CUE[word]
    return "none"


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Begin and end of each token of a field: what stands between white space, quotes and
    the like, without a label, the marks that end a sentence or an open bracket."""
    out = []
    for m in _PIECE.finditer(text):
        begin, end = m.span()
        colon = text.find(":", begin, min(end - 1, begin + MOST_LABEL))
        if colon > begin and _LABEL.fullmatch(text, begin, colon):
            begin = colon + 1
        end -= len(text[begin:end]) - len(text[begin:end].rstrip(".:!?"))
        if begin < end and text[begin] in "([" and not re.search(r"[)\]]", text[begin:end]):
            begin += 1
        if begin < end and text[end - 1] in ")]" and not re.search(r"[(\[]", text[begin:end]):
            end -= 1
        if begin < end:
            out.append((begin, end))
    return out


def candidates(text: str, before: str, after: str) -> tuple[list[tuple[int, int]], list[semicrf.Segment]]:
    """(begin and end of each token, candidate segments) of a field, with the text around it.
    A segment is tokens that stand one space apart."""
    tokens = tokens_of(text)
    digits = [sum(c.isascii() and c.isdigit() for c in text[a:b]) for a, b in tokens]
    out = []
    for i, (begin, _) in enumerate(tokens):
        left, total = None, 0
        for j in range(i, min(i + MOST_TOKENS, len(tokens))):
            end, total = tokens[j][1], total + digits[j]
            if end - begin > MOST_CHARS or total > MOST_DIGITS and j > i or j > i and text[tokens[j - 1][1] : tokens[j][0]] != " ":
                break
            held = text[begin:end]
            if not _may_be(held, total):
                continue
            if left is None:
                prior = text[begin - 1] if begin else before[-1:] or " "
                left = (f"left {'a' if prior.isalnum() else prior}", _cue(before + text[max(0, begin - 64) : begin]))
            next_ = text[end] if end < len(text) else after[:1] or " "
            own = _of_span(held)
            names = [*own, left[0], f"right {'a' if next_.isalnum() else next_}", f"cue {left[1]}"]
            names += [f"{left[1]} & {x}" for x in own if x.startswith(("hex", "mixed", "digits", "luhn", "not luhn"))]
            if j + 1 < len(tokens) and digits[j + 1] and digits[j]:
                names.append("goes on")
            if i and digits[i - 1] and digits[i]:
                names.append("came before")
            out.append((i, j + 1, tuple(names)))
    return tokens, out


def fields(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, begin, end) in bytes of the fields of texts laid end to end."""
    starts, ends, first = spans.word_spans(spans.NONSPACE[data], offsets)
    if not len(starts):
        return []
    so_far = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    at, digit, colon = so_far(data == 64), so_far((data >= 48) & (data < 58)), so_far(data == 58)
    text = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
    spoken = np.zeros(len(starts), bool)
    for m in _DOT.finditer(data.tobytes()):
        k = int(np.searchsorted(starts, m.start(), side="right")) - 1
        spoken[max(k - 5, 0) : k + 3] = True
    active = (at[ends] + digit[ends] > at[starts] + digit[starts]) | spoken
    joined = np.zeros(len(starts) + 1, bool)  # with the word before
    joined[1:-1] = active[1:] & active[:-1] & (starts[1:] == ends[:-1] + 1) & (text[1:] == text[:-1]) & (data[ends[:-1] - (ends[:-1] == len(data))] == 32)
    heads, last = np.flatnonzero(active & ~joined[:-1]), np.flatnonzero(active & ~joined[1:])
    held = lambda x: x[ends[last]] - x[starts[heads]]
    words = so_far(spoken)
    worth = (held(digit) + held(colon) >= 7) | (held(at) > 0) | (words[last + 1] > words[heads])
    return [(int(text[i]), int(starts[i]), int(ends[j])) for i, j in zip(heads[worth], last[worth], strict=True)]


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_LETTERS) for _ in range(rng.randint(2, 9)))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, valid: bool) -> str:
    while True:
        d = _digits(rng, rng.choice((15, 16, 16, 16)))
        if luhn(d.encode()) == valid:
            return d if rng.random() < 0.5 or len(d) != 16 else rng.choice(" -").join(d[k : k + 4] for k in range(0, 16, 4))


def _iban(rng: random.Random) -> str:
    land, body = rng.choice(("DE", "FR", "GB", "ES")), _digits(rng, 18)
    check = 98 - int(body + str(int(land[0], 36)) + str(int(land[1], 36)) + "00") % 97
    flat = f"{land}{check:02d}{body}"
    return flat if rng.random() < 0.5 else " ".join(flat[k : k + 4] for k in range(0, len(flat), 4))


def _made(rng: random.Random, kind: str) -> str:
    d = lambda n: _digits(rng, n)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    host = f"{_word(rng)}.{rng.choice(('com', 'org', 'net', 'example.com', 'co.uk'))}"
    forms = {
        "email": lambda: rng.choice((f"{_word(rng)}{d(1)}@{host}", f"{_word(rng)}.{_word(rng)}@{host}", f"{_word(rng)} at {_word(rng)} dot com", f"{_word(rng)} [at] {_word(rng)} [dot] org", f"{_word(rng)} (at) {_word(rng)} (dot) net")),
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "card": lambda: _card(rng, True),
        "phone": lambda: rng.choice((f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{rng.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"+{rng.randint(30, 49)}{d(9)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}")),
        "iban": lambda: _iban(rng),
        "mac": lambda: rng.choice(":-").join(f"{rng.randint(10, 99)}" if k % 2 else hexes(2) for k in range(6)),
        "ip6": lambda: rng.choice((":".join(hexes(4) for _ in range(8)), f"2001:{d(2)}8::{hexes(3)}:{d(4)}", f"fe80::{hexes(4)}:{d(4)}:{hexes(4)}")),
        "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "secret": lambda: hexes(rng.choice((32, 40, 40, 64))) if rng.random() < 0.7 else f"sk_{''.join(rng.choice(_LETTERS + '0123456789') for _ in range(24))}{d(3)}",
        "": lambda: rng.choice((f"{rng.randint(1900, 2030)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", f"{d(1)}.{d(2)}.{d(4)}", f"{d(2)}.{d(7)}", f"{d(3)} {d(3)} {d(3)}", f"{d(8)}", f"{d(10)}", f"{d(13)}", _card(rng, False), f"{rng.randint(256, 999)}.{d(3)}.{d(3)}.{d(3)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"IMG_{d(8)}_{d(6)}", f"{d(4)} {d(4)}", f"{d(2)} {d(3)} {d(1)} {d(3)} {d(2)}", f"@{_word(rng)}{d(2)}", f"{_word(rng)} at {_word(rng)} the dot", f"{d(3)}.{d(3)} {d(3)}.{d(3)}", f"{d(3)},{d(3)},{d(3)}", f"{d(20)}{d(9)}", hexes(12) + d(2))),
    }
    return forms[kind]()


def made_lines(many: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """(a line, its spans) with and without personal data, the same for a seed."""
    rng = random.Random(seed)
    for _ in range(many):
        line, held = "", []
        for kind in [rng.choice((*KINDS, *KINDS, "", "", "", "", "")) for _ in range(rng.choice((1, 1, 1, 2)))]:
            line += (" " if line and line[-1] != " " else "") + " ".join(_word(rng) for _ in range(rng.randint(0, 4)))
            sure = kind in ("secret", "ssn") or rng.random() < 0.4
            if sure or kind == "" and rng.random() < 0.3:
                cue = rng.choice(_CUES[kind if kind in _CUES and kind else "number"])
                line += (" " if line else "") + cue + rng.choice((" ", ": ", " = ", '="', " is "))
            elif line:
                line += " "
            text = _made(rng, kind)
            if kind:
                held.append((len(line), len(line) + len(text), kind))
            line += text + rng.choice(("", "", ".", ",", '"', ";"))
        yield line + rng.choice(("", " " + _word(rng))), held


def example(line: str, held: list[tuple[int, int, str]]) -> Iterator[tuple[int, list[semicrf.Segment], list[tuple[int, int, int]]]]:
    """Tokens, candidates and true segments of the fields of a line; spans that are not
    candidates are left out."""
    data = np.frombuffer(line.encode(), np.uint8)
    for _, begin, end in fields(data, np.array([0, len(data)])):
        tokens, segments = candidates(line[begin:end], line[max(0, begin - 64) : begin], line[end : end + 1])
        at = {(tokens[i][0] + begin, tokens[j - 1][1] + begin): (i, j) for i, j, _ in segments}
        true = [(*at[a, b], LABELS.index(kind)) for a, b, kind in held if (a, b) in at]
        if segments:
            yield len(tokens), segments, sorted(true)


@lru_cache(maxsize=1)
def model(many: int = 1500, seed: int = 7) -> semicrf.Model:
    """Trained on ``many`` made lines: a model of fixed size, whatever the corpus."""
    return semicrf.train(LABELS, [e for line, held in made_lines(many, seed) for e in example(line, held)])


def _places(data: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))


def found_in(trained: semicrf.Model, data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """(base spans, all spans) of each text: (start, end, kind) in code points, by start,
    then kind."""
    many = len(offsets) - 1
    base: list[list[tuple]] = [[] for _ in range(many)]
    every: list[list[tuple]] = [[] for _ in range(many)]
    # the byte between texts is in no pattern
    text = b"\n".join(data[offsets[k] : offsets[k + 1]].tobytes() for k in range(many))
    begins = offsets[:-1] + np.arange(many)
    points = _places(np.frombuffer(text, np.uint8))
    sure = _Spans(base_spans(text))
    for i, j, kind in sure.every:
        k = int(np.searchsorted(begins, i, side="right")) - 1
        base[k].append((int(points[i] - points[begins[k]]), int(points[j] - points[begins[k]]), kind))
    for k, begin, end in fields(data, offsets):
        shift = int(begins[k] - offsets[k])
        if sure.fill(begin + shift, end + shift):
            continue
        shown = data[begin:end].tobytes().decode("utf-8", "replace")
        prior = data[max(int(offsets[k]), begin - 64) : begin].tobytes().decode("utf-8", "replace")
        later = data[end : min(end + 4, int(offsets[k + 1]))].tobytes().decode("utf-8", "replace")
        tokens, segments = candidates(shown, prior, later)
        if not segments:
            continue
        at = np.concatenate(([0], np.cumsum([len(c.encode()) for c in shown], dtype=np.int64))) + begin + shift  # bytes before each character
        for i, j, y in trained.decode(len(tokens), segments):
            a, b = int(at[tokens[i][0]]), int(at[tokens[j - 1][1]])
            if not sure.meet(a, b):
                every[k].append((int(points[a] - points[begins[k]]), int(points[b] - points[begins[k]]), y - 1))
    for k in range(many):
        every[k] = sorted([*every[k], *base[k]], key=lambda x: (x[0], x[2], x[1]))
    return base, every


class _Spans:
    """Base spans; those of a kind lie one after another, so that a look-up need not go
    through all of them."""

    def __init__(self, found: list[tuple[int, int, int]]) -> None:
        self.every = found
        kinds = [[x for x in found if x[2] == kind] for kind in range(len(BASE))]
        self.sides = [([x[0] for x in mine], [x[1] for x in mine]) for mine in kinds]

    def near(self, begin: int, end: int) -> list[tuple[int, int]]:
        """Those that have a byte of [begin, end)."""
        return [(i, j) for starts, ends in self.sides for i, j in zip(starts[bisect_right(ends, begin) : bisect_left(starts, end)], ends[bisect_right(ends, begin) : bisect_left(starts, end)], strict=True)]

    def meet(self, begin: int, end: int) -> bool:
        return bool(self.near(begin, end))

    def fill(self, begin: int, end: int) -> bool:
        """Whether one of them is the whole of [begin, end)."""
        return any(i <= begin and end <= j for i, j in self.near(begin, end))


_SPAN = "array<struct<kind:string,start:long,end:long>>"


def _scanned(trained: semicrf.Model):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = spans.column_bytes(batch.column(1))
            for lo, hi in spans.slices(offsets):
                base, every = found_in(trained, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                shown = [[[{"kind": KINDS[y], "start": a, "end": b} for a, b, y in row] for row in rows] for rows in (base, every)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(pa.array(x, kind) for x in shown)], ["doc_id", "base", "spans"])

    return run


def find(docs: DataFrame, trained: semicrf.Model | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, base and spans (arrays of kind, start, end in code points,
    by start, then kind); ``spans`` has the base spans and those of the model.

    A null or empty text has none. Repeated rows and null ids stay. An empty table gives no
    rows. Bytes that are not UTF-8 are in no span of a pattern and count as the code points
    that their lead bytes open. Columns beyond key and text are not looked at."""
    trained = trained or model()
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_scanned(trained), f"doc_id long, base {_SPAN}, spans {_SPAN}")


def shown(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
