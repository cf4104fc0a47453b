"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and the
words that announce identifiers. A deterministic parser for each kind of anchor expands to the
left and right and validates. No pattern is ever searched for where no anchor stands.

Kinds of the base: email, ip, card, phone (matches are leftmost and do not overlap within a kind;
a match that fails its validation is dropped without another try). Added kinds:
- url: a scheme (http, https, ftp; small, capital or capitalised) and `://`, up to white space,
  quotes or angle brackets, less trailing `.,;:!?)]}`; at least one character must remain.
- account: an IBAN whose remainder is 1; or, after a word for an account (and `number`, `no`, `:`,
  `#`, `=` or spaces), 6 to 34 of `A-Z0-9-` that hold 5 digits or more.
- secret: after a word for a credential, `=` or `:` and perhaps a quote, 16 or more of
  `A-Za-z0-9_+/=-`.

Cases: a null text is empty and has no spans; spans are in code points, ends exclusive; repeated
rows, and ties, give repeated results; a very long text is scanned whole, an empty table gives no
rows, and columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
#: What is personal, and so replaced by default: an address of a page is found, but stays.
PERSONAL = (*BASE_KINDS, "account", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}

#: The characters of the base's patterns, and the words that announce identifiers.
DIGITS = frozenset(string.digits)
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
LABEL = frozenset(string.ascii_letters + string.digits + "-")
PHONE = frozenset(" ().-" + string.digits)
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "routing")
SECRET_CUES = ("token", "secret", "password", "api_key", "apikey")
URL_END = frozenset(" \t\n\r\x0b\x0c<>\"'")
ACCOUNT = frozenset(string.ascii_uppercase + string.digits + "-")
SECRET = frozenset(string.ascii_letters + string.digits + "_+/=-")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def run_of(text: str, at: int, allowed: frozenset[str], most: int | None = None) -> int:
    """End of the run of allowed characters from `at`; no further than `most` characters, if given."""
    n = len(text) if most is None else min(len(text), at + most)
    while at < n and text[at] in allowed:
        at += 1
    return at


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "@+":
        found.add_word(c, (c, c))
    for d in DIGITS:
        found.add_word(d, ("digit", d))
    for s in SCHEMES:
        for form in (s, s.upper(), s.capitalize()):
            found.add_word(form, ("scheme", form))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, form))
    found.make_automaton()
    return found


class Finder:
    """Expands the anchors of one text, from left to right."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans: list[Span] = []
        self.floor = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended

    def add(self, kind: str, start: int, end: int) -> None:
        self.spans.append((start, end, kind))

    def email(self, at: int) -> None:
        text, floor, start = self.text, self.floor["email"], at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        end = run_of(text, at + 1, LABEL)
        if start == at or end == at + 1:
            return
        dotted = False
        while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
            end, dotted = run_of(text, end + 1, LABEL), True
        if dotted:
            self.floor["email"] = end
            self.add("email", start, end)

    def phone(self, at: int) -> None:
        text = self.text
        if at + 1 >= len(text) or text[at + 1] not in DIGITS:
            return
        end = run_of(text, at + 2, PHONE)
        while end > at + 3 and text[end - 1] not in DIGITS:
            end -= 1
        if end <= at + 3 or text[end - 1] not in DIGITS:
            return
        if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
            self.add("phone", at, end)

    def digit(self, at: int) -> None:
        if at >= self.floor["ip"]:
            self.ip(at)
        if at >= self.floor["card"]:
            self.card(at)
        if at >= 2 and at >= self.floor["account"]:
            self.iban(at)

    def ip(self, at: int) -> None:
        text, ends = self.text, [run_of(self.text, at, DIGITS)]
        while len(ends) < 4 and ends[-1] + 1 < len(text) and text[ends[-1]] == "." and text[ends[-1] + 1] in DIGITS:
            ends.append(run_of(text, ends[-1] + 1, DIGITS))
        if len(ends) < 4:
            self.floor["ip"] = ends[0]
            return
        self.floor["ip"] = end = ends[3]
        if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in text[at:end].split(".")):
            self.add("ip", at, end)

    def card(self, at: int) -> None:
        text, end = self.text, at + 1
        while True:
            if end < len(text) and text[end] in DIGITS:
                end += 1
            elif end + 1 < len(text) and text[end] in " -" and text[end + 1] in DIGITS:
                end += 2
            else:
                break
        self.floor["card"] = end
        if end - at >= 12:
            digits = text[at:end].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                self.add("card", at, end)

    def iban(self, at: int) -> None:
        """Two capitals before the first two digits; groups may be parted by single spaces."""
        text = self.text
        if not (text[at - 2 : at].isascii() and text[at - 2 : at].isalpha() and text[at - 2 : at].isupper()) or (at >= 3 and text[at - 3].isalnum()):
            return
        end, value = at, text[at - 2 : at]
        while end < len(text) and len(value) < 34:
            if text[end] in ACCOUNT and text[end] != "-":
                value, end = value + text[end], end + 1
            elif text[end] == " " and len(value) % 4 == 0 and end + 1 < len(text) and text[end + 1] in ACCOUNT and text[end + 1] != "-":
                end += 1
            else:
                break
        if 15 <= len(value) and value[3:4] in DIGITS and not (end < len(text) and text[end].isalnum()) and iban(value):
            self.floor["account"] = end
            self.add("account", at - 2, end)

    def scheme(self, at: int, form: str) -> None:
        if at < self.floor["url"] or (at and self.text[at - 1].isalnum()):
            return
        end = body = at + len(form)
        while end < len(self.text) and self.text[end] not in URL_END:
            end += 1
        while end > body and self.text[end - 1] in ".,;:!?)]}":
            end -= 1
        if end > body:
            self.floor["url"] = end
            self.add("url", at, end)

    def cue(self, kind: str, at: int, form: str) -> None:
        text, end = self.text, at + len(form)
        if (at and text[at - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
            return
        value = run_of(text, end, frozenset(" "))
        if kind == "account":
            for word in ("number", "no.", "no", "nr.", "nr"):
                if text[value : value + len(word)].lower() == word and not text[value + len(word) : value + len(word) + 1].isalpha():
                    value += len(word)
                    break
            value = run_of(text, value, frozenset(" :#="))
            stop = run_of(text, value, ACCOUNT, 35)  # a longer run is none, however long
            body = text[value:stop]
            good = 6 <= len(body) <= 34 and sum(c in DIGITS for c in body) >= 5
        else:
            mark = run_of(text, value, frozenset("=:"), 2)
            if mark != value + 1:
                return
            value = run_of(text, mark, frozenset(" "))
            value += text[value : value + 1] in ("'", '"') and value < len(text)
            if value < self.floor[kind]:  # inside the last match, which would be scanned again
                return
            stop = run_of(text, value, SECRET)
            good = stop - value >= 16
        if good and value >= self.floor[kind]:
            self.floor[kind] = stop
            self.add(kind, value, stop)


def find_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind as listed."""
    found = Finder(text)
    for last, (what, form) in anchors().iter(text):
        at = last - len(form) + 1
        if what == "digit":
            found.digit(at)
        elif what == "@":
            found.email(at)
        elif what == "+":
            found.phone(at)
        elif what == "scheme":
            found.scheme(at, form)
        else:
            found.cue(what, at, form)
    return sorted(found.spans, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def redact(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, gives way to its first kind in capitals."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in spans)


SPAN_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and places of the personal data in every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [find_spans(t) for t in texts_of(b.column("text"))]
            base = [[s for s in x if s[2] in BASE_KINDS] for x in every]
            counts = [pa.array([sum(s[2] == k for s in x) for x in base], pa.int64()) for k in BASE_KINDS]
            digests = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, digests, pa.array(map(joined, every), pa.string())], [x.split()[0] for x in SPAN_SCHEMA.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SPAN_SCHEMA)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", kinds: tuple[str, ...] = PERSONAL) -> DataFrame:
    """The same rows and columns with data of the given kinds replaced, and lengths in characters
    renewed. A null text stays null."""
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None else redact(t, [s for s in find_spans(t) if s[2] in kinds]) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            if size is not None:
                changed = [old if new is None else len(new) for old, new in zip(cols[size].to_pylist(), texts, strict=True)]
                cols[size] = pa.array(changed, cols[size].type)
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
