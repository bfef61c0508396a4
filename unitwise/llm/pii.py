"""Personal data: base patterns, and identifiers in disguise found on a normalised text.

Four kinds are looked for: email, ip, card and phone. The base patterns run on the source text. Then
a chain of transducers rewrites the text (look-alike letters and digits to ASCII, invisible characters
away, "[at]" and "at ... dot" to @ and ".", runs of spelled digits to digits), each output character
carrying the source range it stands for. Identifiers found there, under stricter forms of the same
rules, are mapped back; those that overlap no base span of their kind are added.

Nulls and empty texts have no spans. Offsets are code points, ends exclusive. Scans are linear in the
length of the text, however long its runs of digits or letters. Repeated rows give equal results. Spelled digits count in
runs of seven and more; shorter groups of them, as in an address spelled part by part, stay words. An empty table gives no
rows; columns besides id and text are kept by `mask` and not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
_DIGIT = re.compile(r"[0-9]").search
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done, "email"
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, leftmost and not overlapping within a kind."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT(text) is None:
        return out
    if text.count(".") >= 3:
        out += [(*m.span(), "ip") for m in _IP(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD(text):
        if m.end() - m.start() >= 14:
            digits = _NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in _PHONE(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- transducers: (text, [(start, end) of each character]) -> the same, rewritten

_LOOKALIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХУІЈЅαοντικρχυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTXYIJSaovtikpxuABEZHIKMNOPTYX", strict=True))
_DASHES = "".join(map(chr, [*range(0x2010, 0x2016), 0x2212, 0xFE63, 0xFF0D]))
_DOTS = "".join(map(chr, [0x2024, 0x3002, 0xFF0E, 0xFF61]))
_INVISIBLE = "".join(map(chr, [*range(0x200B, 0x200E), 0x2060, 0xFEFF, 0xAD]))


def _folded(c: str) -> str:
    """What a character is read as: itself, or its ASCII form."""
    new = "" if c in _INVISIBLE else "-" if c in _DASHES else "." if c in _DOTS else _LOOKALIKE.get(c)
    if new is None:
        k = unicodedata.normalize("NFKC", c)
        d = unicodedata.digit(c, None)
        new = str(d) if d is not None and "0" <= str(d) <= "9" and not k.isascii() else k if len(k) == 1 and k.isascii() else c
    return new


#: Every character that is read as another, the gate being made of the same. Outside these ranges (ideographs, syllables, surrogates, private use, planes above 1) none is; a test holds that over all of Unicode.
_FOLD = {c: new for c in map(chr, [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000)]) if (new := _folded(c)) != c}
#: Those of the basic plane as a class (looked up by a bitmap, where a class that reaches beyond is searched range by range), the rest by themselves.
_ODD_BASIC = re.compile(f"[{''.join(re.escape(c) for c in _FOLD if c < chr(0x10000))}]").search
_ODD = re.compile(f"[{''.join(map(re.escape, _FOLD))}]")
_BEYOND = re.compile("[\U00010000-\U0010ffff]").search

_DIGIT_WORDS = dict(zip("zero oh one two three four five six seven eight nine".split(), "00123456789", strict=True))
_WORD = "|".join(_DIGIT_WORDS)
_PLUS = r"plus[\x20]+"
_SPELLED = re.compile(rf"(?i)\b(?:{_PLUS})?(?:double[\x20]+|triple[\x20]+)?(?:{_WORD})(?:[\x20,.-]{{1,2}}(?:(?:double|triple)[\x20]+)?(?:{_WORD}|[0-9]))+\b")
_SPELLED_PART = re.compile(rf"(?i)plus|double|triple|{_WORD}|[0-9]|[.]")
_AT = re.compile(r"(?i)(?<!\x20)(?:\x20*+[\[({<]\x20*+(?:at|@)\x20*+[\])}>]\x20*+|\x20++at\x20++|\x20++@\x20*+|@\x20++)").finditer
_DOT = r"(?:(?<!\x20)\x20*+[\[({<]\x20*+(?:dot|\.)\x20*+[\])}>]\x20*+|(?<!\x20)\x20++dot\x20++|\.)"
#: What stands before an at, read backwards, and what follows it: names of any length, any number of them, between dots.
_NAMES_BACK = re.compile(r"(?i)[A-Za-z0-9_%+-]++(?:(?:\x20*+[\])}>]\x20*+(?:tod|\.)\x20*+[\[({<]\x20*+|\x20++tod\x20++|\.)[A-Za-z0-9_%+-]++)*+").match
_NAMES = re.compile(rf"(?i)[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++").match
_DOT_ONCE = re.compile(f"(?i){_DOT}")
_WORDY = re.compile(r"(?i)\bdot\b|[\[({<]").search
_DOTTED_IP = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:(?:\x20*+[\[({{<]\x20*+(?:dot|\.)\x20*+[\])}}>]\x20*+|\x20++dot\x20++)[0-9]{{1,3}}){{3}}(?![0-9])")
_BRACKETED = re.compile(r"[\[({<]\x20*(?:at|@|dot|\.)\x20*[\])}>]").search
_TWO_DIGIT_WORDS = re.compile(rf"(?:{_WORD})[\x20,.-]{{1,2}}(?:double[\x20]+|triple[\x20]+)?(?:{_WORD}|[0-9])").search


class Tape:
    """A text under rewriting; `at[i]` is the source range of character i."""

    def __init__(self, text: str):
        self.text, self.at = text, [(i, i + 1) for i in range(len(text))]

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Each edit (start, end, new): every new character stands for the whole source range that it replaces."""
        text, at, done = [], [], 0
        for start, end, new in edits:
            if start < done:
                continue
            text.append(self.text[done:start])
            at += self.at[done:start]
            source = (self.at[start][0], self.at[end - 1][1])
            text.append(new)
            at += [source] * len(new)
            done = end
        self.text, self.at = "".join([*text, self.text[done:]]), at + self.at[done:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.at[start][0], self.at[end - 1][1]


def _fold_characters(tape: Tape) -> None:
    tape.replace([(*m.span(), _FOLD[m[0]]) for m in _ODD.finditer(tape.text)])


def _spelled_digits(tape: Tape) -> None:
    edits = []
    for m in _SPELLED.finditer(tape.text):
        repeat, plain, per_digit = 1, "", []
        for p in _SPELLED_PART.finditer(m[0]):
            w = p[0].lower()
            if w in ("double", "triple"):
                repeat = 2 if w == "double" else 3
                continue
            new = "+" if w == "plus" else _DIGIT_WORDS.get(w, w)
            per_digit.append((m.start() + p.start(), m.start() + p.end(), new * repeat))
            plain += new * repeat if new.isdigit() else ""
            repeat = 1
        if len(plain) >= 7:
            edits.append((m.start(), m.end(), "".join(x[2] for x in per_digit if x[2] != ".")))
    tape.replace(edits)


def _at_and_dot(tape: Tape) -> None:
    text, edits, done, before = tape.text, [], 0, 0
    for m in _AT(text):
        reach, before = max(done, before), m.end()  # names reach over no other at, so that each place is read once from either side
        right = _NAMES(text, m.end())
        left = right and _NAMES_BACK(text[reach : m.start()][::-1])
        if not left:
            continue
        start, sign = m.start() - left.end(), m[0]
        local, domain = text[start : m.start()], right[0]
        plain_dots = not _WORDY(local + " " + domain)
        if sign == "@" and plain_dots:
            continue
        if not _WORDY(sign) and "@" not in sign and plain_dots:
            continue  # "at" as a word counts only with "dot" or brackets
        edits += [(start + d.start(), start + d.end(), ".") for d in _DOT_ONCE.finditer(local)]
        edits.append((*m.span(), "@"))
        edits += [(m.end() + d.start(), m.end() + d.end(), ".") for d in _DOT_ONCE.finditer(domain)]
        done = right.end()
    for m in _DOTTED_IP.finditer(tape.text):
        edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _DOT_ONCE.finditer(m[0])]
    tape.replace(sorted(edits))


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of identifiers that only the normalised text shows."""
    odd, low = not text.isascii() and (_ODD_BASIC(text) is not None or _BEYOND(text) is not None and _ODD.search(text) is not None), text.lower()
    spelled = _TWO_DIGIT_WORDS(low) is not None
    around = " dot " in low or "@" in low and (" @" in low or "@ " in low) or _BRACKETED(low) is not None
    if not (odd or spelled or around):
        return []
    tape = Tape(text)
    if odd:
        _fold_characters(tape)
    if odd or spelled:
        _spelled_digits(tape)
    _at_and_dot(tape)
    if tape.text == text:
        return []
    out = []
    for start, end, kind in base_spans(tape.text):
        span = tape.source(start, end)
        if text[span[0] : span[1]] != tape.text[start:end] and not any(k == kind and s < span[1] and span[0] < e for s, e, k in base):
            out.append((*span, kind))
    return out


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), both ordered."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, ordered(base + disguised_spans(text, base))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def masked(text: str | None) -> str | None:
    """The text with each found identifier replaced by its kind in brackets; overlapping ones are merged under the first kind."""
    found = spans(text)[1]
    if not found:
        return text
    out, done, i = [], 0, 0
    while i < len(found):
        start, end, kind = found[i]
        while i + 1 < len(found) and found[i + 1][0] < end:
            i += 1
            end = max(end, found[i][1])
        out += [text[done:start], f"[{kind.upper()}]"]
        done, i = end, i + 1
    return "".join([*out, text[done:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans: array<struct<kind, start, end, base>> of each row."""
    ship(docs.sparkSession)
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base, every = spans(t)
                held = set(base)
                rows.append([{"kind": k, "start": s, "end": e, "base": (s, e, k) in held} for s, e, k in every])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(struct))], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the text column masked; every other column stays as it is. A null text stays null."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([masked(t) for t in b.column(place).to_pylist()], b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([*b.columns[:place], new, *b.columns[place + 1 :]], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of base spans by kind, base_sha256, spans, and n_added (spans that only the method finds)."""
    from pyspark.sql import functions as F

    found = find(docs, id_col, text_col)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base AND x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added"))


def digest_of(found: list[Span]) -> str:
    return hashlib.sha256(joined(found).encode()).hexdigest()
