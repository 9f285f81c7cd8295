"""Personal data behind disguises: offset-preserving normalisation, detection, and spans in the source."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domweave.llm.common import spread

_LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТХУаеорсухіѕјԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυ‐‑‒–—−＠．․。﹒﹫",
        "ABEKMHOPCTXYaeopcyxisjdhABEZHIKMNOPTYXavopu------@.....@",
    )
)


def _single(c: str) -> str | None:
    """The one ASCII character that a compatibility form or a decimal digit of another script stands for."""
    if c.isdecimal():
        return str(int(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() and plain.isprintable() and plain != " " else None


#: Characters each of which becomes one other, so that no offset moves.
HOMOGLYPHS = {ord(c): p for c in map(chr, range(0x80, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 if (p := _single(c))}
HOMOGLYPHS |= {ord(c): p for c, p in _LOOKALIKES.items()}
# apart, as a class that holds characters beyond the first plane is searched one range after another
_STRANGE = re.compile("[%s]" % "".join(chr(k) for k in sorted(HOMOGLYPHS) if k < 0x10000))
_BEYOND = re.compile("[\U00010000-\U0001ffff]")
#: Characters without width, which are taken out.
_UNSEEN = "­​‌‍⁠﻿"

_DIGITS = {w: str(k) for k, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_SPELLED = "zero|one|two|three|four|five|six|seven|eight|nine|oh"
#: At least five spelled digits with only spaces, hyphens, dots or commas between them.
_NUMBER = re.compile(rf"\b(?:{_SPELLED})(?:[ ,.\-]{{1,2}}(?:{_SPELLED})){{4,}}\b", re.I)
_WORD_DIGIT = re.compile(_SPELLED, re.I)
_TIMES = {"double": 2, "triple": 3}
_UNIT = rf"(?:\b(?:(?:double|triple)[ \-]{{1,2}})?(?:{_SPELLED})\b|(?<!\w)\+?\d++(?!\w))"
_BETWEEN = r"[\s,.\-()]++(?:(?:dot|point|dash|hyphen)\b[\s,.\-()]++)?"
#: Spelled digits and numerals with white space, signs, "dot" or "dash" between them.
_MIXED = re.compile(rf"{_UNIT}(?:{_BETWEEN}{_UNIT})+", re.I)
_UNITS = re.compile(_UNIT, re.I)
_SPELLED_WORD = re.compile(rf"\b(?:{_SPELLED})\b", re.I)
#: Most digits of an identifier: a payment card.
_MOST_DIGITS = 19
_MARK = r"[\[({<]"
_END = r"[\])}>]"
# white space around them is added in code: a pattern that begins with it is searched anew from every blank
_AT = re.compile(rf"{_MARK}\s*(?:at|@)\s*{_END}", re.I)
_DOT = re.compile(rf"{_MARK}\s*(?:dot|\.)\s*{_END}", re.I)
#: "name_at_host_dot_com", with underscores or hyphens throughout.
_JOINED = re.compile(r"(?<![\w.+%\-])[a-z0-9]++(?:[._+\-](?!at[_\-])[a-z0-9]++){0,15}(?P<sep>[_\-])(?P<at>at)(?P=sep)(?P<host>[a-z0-9]++(?:(?P=sep)(?!dot(?P=sep))[a-z0-9]++){0,3}(?:(?P=sep)dot(?P=sep)[a-z0-9]++){0,7}(?P=sep)dot(?P=sep)[a-z]{2,24})(?![\w\-])", re.I)
_JOINED_AT = re.compile(r"_at_|-at-", re.I)
#: Last parts of host names that bare words may end in: generic ones, and two letters that are no common word.
_TOP = "(?:com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|xyz|online|site|shop|store|tech|cloud|blog|example|test|invalid|(?!(?:am|an|as|at|be|by|do|go|he|if|in|is|it|la|my|no|of|on|or|so|to|up|we)\\b)[a-z]{2})"
_COUNTRY_WORD = "(?:am|an|as|at|be|by|do|go|he|if|in|is|it|la|my|no|of|on|or|so|to|up|we)"
_SEP = r"(?:\s+dot\s+|\.)"
#: "name at host dot com" with any parts of it disguised; what of it is taken is decided by `_address`. 64 characters hold at most 32 parts.
_ADDRESS = re.compile(rf"(?<![\w.+\-%])[a-z0-9_+\-%]++(?:{_SEP}[a-z0-9_+\-%]++){{0,31}}(?P<at>\s+at\s+|\s*@\s*)(?P<host>[a-z0-9\-]{{1,63}}(?:{_SEP}[a-z0-9\-]{{1,63}}){{0,15}}{_SEP}[a-z]{{2,24}})(?![\w\-])", re.I)
#: A host that stands without a mark: a bare dot before a last part that is no common word, or is the last word before a stop.
_BARE_HOST = re.compile(rf"(?!(?:the|a|an|this|that|each|every|my|our|his|her|its|your|their|any|some|one)\b)[a-z0-9\-]{{1,63}}(?:{_SEP}[a-z0-9\-]{{1,63}}){{0,15}}\s+dot\s+(?:{_TOP}|{_COUNTRY_WORD}(?=\s*(?:$|[.,;:!?)\]}}>\"'])))(?:{_SEP}[a-z]{{2,24}}){{0,3}}(?![\w\-])", re.I)
_BARE_DOT = re.compile(r"\s+dot\s+", re.I)
_DISGUISED = re.compile(r"[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]|\sdot\s|\s@|@\s", re.I)

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\w])|(?<![\w.])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\w)|(?<!\w)\d{10}(?!\w)")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
_CARD = re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{5})(?!\w)")
_SSN = re.compile(r"(?<![\w\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w\-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_LIKELY = re.compile(r"@|\d[\d ().\-]{5}")


class Text:
    """A text as it is rewritten, and where its characters come from.

    Each replacement keeps, for the stretch it wrote, the stretch of the source
    it stands for; between those the two run in step.
    """

    def __init__(self, source: str) -> None:
        self.plain = source
        self.edges: list[tuple[int, int, int, int]] = []

    def replace(self, found: list[tuple[int, int, str]]) -> None:
        """Writes the strings in place of the stretches, ascending and apart, of the text as it is now."""
        if not found:
            return
        out, edges, at, length = [], [], 0, 0
        for a, b, new in found:
            out += [self.plain[at:a], new]
            length += a - at
            edges.append((length, length + len(new), *self.source(a, b)))
            length, at = length + len(new), b
        out.append(self.plain[at:])
        old, olds, shifts = self.edges, [f[:2] for f in found], []
        total = 0
        for a, b, new in found:
            total += len(new) - (b - a)
            shifts.append(total)
        starts = [a for a, _ in olds]
        for na, nb, sa, sb in old:
            k = bisect_right(starts, na) - 1
            if k >= 0 and na < olds[k][1]:
                continue  # inside what was replaced
            moved = shifts[k] if k >= 0 else 0
            edges.append((na + moved, nb + moved, sa, sb))
        self.plain, self.edges = "".join(out), sorted(edges)

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The stretch of the source for a stretch that isn't empty."""
        return self._at(a)[0], self._at(b - 1)[1]

    def _at(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.edges, i, key=lambda e: e[0]) - 1
        if k < 0:
            return i, i + 1
        na, nb, sa, sb = self.edges[k]
        return (sa, sb) if i < nb else (sb + i - nb, sb + i - nb + 1)


def normalised(source: str) -> Text:
    """The text after the transducers, each over what the one before it wrote."""
    text = Text(source)
    if not source.isascii():
        if _STRANGE.search(source) or _BEYOND.search(source):
            text.plain = source.translate(HOMOGLYPHS)  # one for one
        if any(c in source for c in _UNSEEN):
            text.replace([(m.start(), m.end(), "") for m in re.finditer(f"[{_UNSEEN}]+", text.plain) if m.end() > m.start()])
    if _DISGUISED.search(text.plain):
        marks = [(*_with_blanks(text.plain, *m.span()), c) for p, c in ((_AT, "@"), (_DOT, ".")) for m in p.finditer(text.plain)]
        text.replace(_apart(marks))
        bare = [r for m in _ADDRESS.finditer(text.plain) for r in _address(text, m)]
        text.replace(_apart(bare))
    if _JOINED_AT.search(text.plain):
        text.replace([r for m in _JOINED.finditer(text.plain) for r in _joined(m)])
    if _SPELLED_WORD.search(text.plain):
        text.replace([r for m in _MIXED.finditer(text.plain) if _SPELLED_WORD.search(m.group()) for r in _read_out(m.group(), m.start())])
    spelled = []
    for m in _NUMBER.finditer(text.plain):
        words = list(_WORD_DIGIT.finditer(m.group()))
        # each digit stands for its word and what separates it from the next
        ends = [w.start() for w in words[1:]] + [words[-1].end()]
        spelled += [(m.start() + w.start(), m.start() + e, _DIGITS[w.group().lower()]) for w, e in zip(words, ends)]
    text.replace(spelled)
    return text


def _with_blanks(plain: str, a: int, b: int) -> tuple[int, int]:
    while a and plain[a - 1].isspace():
        a -= 1
    while b < len(plain) and plain[b].isspace():
        b += 1
    return a, b


def _joined(m: re.Match) -> list[tuple[int, int, str]]:
    sep, (a, b) = m["sep"], m.span("at")
    word, base = f"{sep}dot{sep}", m.start("host")
    host, at, out = m["host"].lower(), 0, [(a - 1, b + 1, "@")]
    while (at := host.find(word, at)) >= 0:
        out.append((base + at, base + at + len(word), "."))
        at += len(word)
    return out


def _said(word: str) -> str:
    """The digits of a unit, in lower case: "five", "double five", or a numeral as it is."""
    *times, last = re.split(r"[ \-]+", word) if word[0].isalpha() else [word]
    return _DIGITS.get(last, last) * (_TIMES[times[0]] if times else 1)


def _address(text: Text, m: re.Match) -> list[tuple[int, int, str]]:
    """What to write for the disguises of an address; none if it may be prose.

    A mark is an at sign or an at or dot in brackets. Beside one, bare words and
    any last part are taken. Without one the host has to look like one.
    """

    def marked(k: int) -> bool:
        a, b = text.source(k, k + 1)
        return b - a > 1

    plain, (a, b), end = text.plain, m.span("at"), m.end()
    at, dots = plain[a:b], [d.span() for d in _BARE_DOT.finditer(plain, b, end)]
    if at == "@":
        if not dots and not marked(a):
            return []  # an address as it is
    else:
        even = at[0].isspace() and at[-1].isspace()
        if "@" in at and not even or "@" not in at and not any(marked(k) for k in range(b, end) if plain[k] == "."):
            host = _BARE_HOST.match(plain, b)
            if not host:
                return []
            end = host.end()
    dots = [d.span() for d in _BARE_DOT.finditer(plain, m.start(), end) if d.end() <= a or d.start() >= b]
    return [(a, b, "@")] * (at != "@") + [(x, y, ".") for x, y in dots]


def _is_number(digits: str) -> bool:
    """Whether the whole string is an identifier of digits."""
    plain = re.sub(r"\D", "", digits)
    if _SSN.fullmatch(digits) or _IP.fullmatch(digits):
        return True
    return bool(_CARD.fullmatch(digits) and plain[0] in "3456" and luhn(plain) or _PHONE.fullmatch(digits) and 10 <= len(plain) <= 15)


def _read_out(run: str, base: int) -> list[tuple[int, int, str]]:
    """What to write for the identifiers in a run of spelled digits and numerals.

    What most often stands between single digits joins them to groups; what
    else stands between them is kept as a dot, a hyphen or a space, and if that
    is no identifier, left out. Of the stretches of whole groups that are one,
    with a spelled digit in it, the longest from the left are taken.
    """
    units = [(u.start(), u.end(), u.group().lower()) for u in _UNITS.finditer(run)]
    digits = [_said(w) for _, _, w in units]
    said = [w[0].isalpha() for _, _, w in units]
    between = [run[x[1] : y[0]].lower() for x, y in zip(units, units[1:])]
    single = [len(d) == 1 or w for d, w in zip(digits, said)]
    kept = ["." if "dot" in t or "point" in t or t == "." else "-" if "-" in t or "dash" in t or "hyphen" in t else " " for t in between]
    counts = Counter(t for k, t in enumerate(between) if single[k] and single[k + 1] and kept[k] != ".")
    weak = max(counts, key=lambda t: (counts[t], t == " "), default=None)
    inner = [single[k] and single[k + 1] and t == weak for k, t in enumerate(between)]
    n, out, first = len(units), [], 0
    while first < n:
        if first and inner[first - 1]:
            first += 1
            continue
        best, grouped, joined, words = None, "", "", 0
        for k in range(first, n):
            if k > first:
                if digits[k][0] == "+":
                    break
                grouped += "" if inner[k - 1] else kept[k - 1]
            grouped, joined, words = grouped + digits[k], joined + digits[k], words + said[k]
            if len(joined) > _MOST_DIGITS + 1:
                break
            if words and len(joined) > 3 and (k == n - 1 or not inner[k]):
                if _is_number(grouped):
                    best = (k, True)
                elif (words > 2 or words == k + 1 - first) and _is_number(joined):
                    best = (k, False)
        if best is None:
            first += 1
            continue
        last, in_groups = best
        for k in range(first, last + 1):
            a, b, word = units[k]
            sep = kept[k] if k < last and in_groups and not inner[k] else ""
            if k < last and not sep:
                b = units[k + 1][0]  # a digit stands for what separates it from the next, too
            if run[a:b] != digits[k]:
                out.append((base + a, base + b, digits[k]))
            if sep and run[b : units[k + 1][0]] != sep:
                out.append((base + b, base + units[k + 1][0], sep))
        first = last + 1
    return out


def _apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for f in sorted(found):
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def detect(source: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the identifiers, by place; of those that overlap the first kind wins."""
    if not source:
        return []
    text = normalised(source)
    plain, found, taken = text.plain, [], []

    def take(kind: str, a: int, b: int, value: str) -> None:
        k = bisect_right(taken, (a, b))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
            taken.insert(k, (a, b))
            found.append((kind, *text.source(a, b), value))

    if "@" in plain:
        for m in _EMAIL.finditer(plain):
            take("email", m.start(), m.end(), m.group().lower())
    if _LIKELY.search(plain):
        for m in _IBAN.finditer(plain):
            if iban(m.group().replace(" ", "")):
                take("iban", m.start(), m.end(), m.group().replace(" ", ""))
        for m in _CARD.finditer(plain):
            digits = re.sub(r"\D", "", m.group())
            if digits[0] in "3456" and luhn(digits):
                take("card", m.start(), m.end(), digits)
        for m in _SSN.finditer(plain):
            take("ssn", m.start(), m.end(), m.group())
        for m in _IP.finditer(plain):
            take("ip", m.start(), m.end(), m.group())
        for m in _PHONE.finditer(plain):
            digits = re.sub(r"\D", "", m.group())
            spelled = text.source(m.start(), m.end()) != (m.start(), m.end()) and source[slice(*text.source(m.start(), m.end()))] != m.group()
            if 10 <= len(digits) <= 15 and (len(digits) != len(m.group()) or spelled):
                take("phone", m.start(), m.end(), "+" * m.group().startswith("+") + digits)
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def find_private(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value, surface): each identifier of each document.

    `start` and `end` are offsets in characters of the text as it is, `surface`
    is what stands there and `value` the identifier it stands for. Emails,
    telephone numbers, payment cards (with a valid check digit), IPv4
    addresses, US social security numbers and IBANs (with valid check digits)
    are found, plain or behind homoglyphs, characters without width, spelled
    digits ("double five" too) and at/dot disguises. Spelled digits, also beside numerals, are read
    as telephone numbers, cards, IPv4 addresses (with "dot") and social security
    numbers (with hyphens or "dash"); not as IBANs, unless five or more of them
    follow each other.

    "name at host.com" without a mark is taken for prose.

    Defined results: null and empty texts have no rows; very long texts are
    read whole, in time that grows with their length; a null doc_id is kept;
    repeated rows give repeated rows; of identifiers that overlap the first in
    the order email, iban, card, ssn, ip, phone stays; an empty table gives an
    empty table. Other columns are not read, so their names can't clash.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(doc_id, *f, text[f[1] : f[2]]) for f in detect(text)]
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "kind", "start", "end", "value", "surface"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, "doc_id long, kind string, start int, end int, value string, surface string")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Every identifier in every document."""
    return find_private(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
