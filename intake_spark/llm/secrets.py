"""Secret scan: fixed patterns on the text and on every layer that decoding uncovers.

Base kinds, each leftmost and non-overlapping on its own, in code points with exclusive ends:

* ``assign``: ``(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)``, ASCII letters of the
  names in either case, a value of 8 characters or more
* ``access``: ``AKIA[A-Z0-9]+`` of 16 characters or more
* ``hex``: ``[0-9a-f]+`` of 32 characters or more

Matches that fail the length are dropped after matching. A worklist then unwraps layers until none is left: percent escapes, ``\\u``, ``\\x`` and
numeric character references, base64 in both alphabets, also wrapped over lines of 18 characters or more, and gzip, zlib or bzip2 data of any
number of members inside base64. Bytes that are not clean UTF-8 text (control characters, other encodings, binary) are not dropped: their printable ASCII
stretches are scanned, without ANSI codes, also as UTF-16 if there is a NUL; all patterns are ASCII, so that covers Latin-1 and the like. Each uncovered layer is scanned and searched
for further layers. Escapes keep a place for every character, so a find maps back to its own stretch of the text; a find inside base64 maps to
the whole encoded stretch. A layer that has been seen for the same stretch is not opened again, which ends cycles. A compressed
layer of more than ``LARGEST`` characters is not opened for reasons of memory; its stretch is reported as ``packed``, so that it does not pass unseen.

Defined cases: a null text counts as empty and has no spans; texts are scanned whole; repeated rows get equal results; an
empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intake_spark.llm import words as W

KINDS = ["assign", "access", "hex", "packed"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LARGEST = 16_000_000
#: A base64 stretch shorter than this can't hold a name, a sign and a value of 8 characters.
SHORTEST = 18
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
BASE64_PART = re.compile(r"[A-Za-z0-9]{%d,}={0,2}" % SHORTEST)
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f�]")
#: Base64 that goes on behind a line break.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{%d,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}" % SHORTEST)
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
ANSI = re.compile(r"\x1b\[[0-?]*[ -/]*[@-~]")
#: The shortest find is a name of 5, a sign and a value of 8 characters.
PRINTABLE = re.compile(r"[\t\n\r\x20-\x7e]{14,}")
PIECE = 4096

Span = tuple[int, int, int]  # start, kind, end
Place = Callable[[int, int], tuple[int, int]]


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out)


def _unescaped(text: str, pattern: re.Pattern, letters: Callable[[re.Match], list[tuple[str, int, int]]]) -> tuple[str, list[int], list[int]] | None:
    """The text with every match replaced, and where each new character begins and ends in the old text."""
    out, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        new = letters(m)
        if not new:
            continue
        out.append(text[at:m.start()])
        starts += range(at, m.start())
        ends += range(at + 1, m.start() + 1)
        for c, s, e in new:
            out.append(c)
            starts.append(s)
            ends.append(e)
        at = m.end()
    if not at:
        return None
    out.append(text[at:])
    starts += range(at, len(text))
    ends += range(at + 1, len(text) + 1)
    return "".join(out), starts, ends


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    raw, out, i = bytes.fromhex(m[0].replace("%", "")), [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                c = raw[i:i + n].decode()
            except UnicodeDecodeError:
                continue
            break
        else:
            c, n = "�", 1
        n = min(n, len(raw) - i)
        out.append((c, m.start() + 3 * i, m.start() + 3 * (i + n)))
        i += n
    return out


def _escape(m: re.Match) -> list[tuple[str, int, int]]:
    single = m[1] or m[2] or m[3]
    if single or m[4]:
        code = int(single, 16) if single else int(m[4])
        return [(chr(code), m.start(), m.end())] if code < 0xD800 or 0xDFFF < code < 0x110000 else []
    units, out, i = [int(m[0][k + 2:k + 6], 16) for k in range(0, len(m[0]), 6)], [], 0
    while i < len(units):
        n, code = 1, units[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            n, code = 2, 0x10000 + ((code - 0xD800) << 10) + units[i + 1] - 0xDC00
        out.append((chr(code) if not 0xD800 <= code < 0xE000 else "�", m.start() + 6 * i, m.start() + 6 * (i + n)))
        i += n
    return out


class _TooLarge(Exception):
    pass


def _member(raw: bytes, make: Callable, room: int) -> tuple[bytes, bytes]:
    """What the first member holds, as far as it can be read, and the bytes behind it."""
    work, out, size = make(), [], 0
    for at in range(0, len(raw), PIECE):
        try:
            new = work.decompress(raw[at:at + PIECE], room + 1 - size)
        except (zlib.error, OSError, EOFError, ValueError):
            break
        out.append(new)
        size += len(new)
        if size > room:
            raise _TooLarge
        if work.eof:
            return b"".join(out), work.unused_data + raw[at + PIECE:]
    return b"".join(out), b""


def _inflated(raw: bytes) -> bytes | None:
    for magic, make in ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"x", lambda: zlib.decompressobj()), (b"BZh", bz2.BZ2Decompressor)):
        if raw.startswith(magic):
            out, size = [], 0
            while raw.startswith(magic):
                new, rest = _member(raw, make, LARGEST - size)
                if not new and not rest:
                    break
                raw = rest
                out.append(new)
                size += len(new)
            return b"".join([*out, raw]) if size else None
    return None


def _stretches(text: str) -> str:
    """The printable stretches that can hold a find, apart from each other by a sign that no pattern has."""
    return "\x0c".join(PRINTABLE.findall(ANSI.sub("", text)))


def _readable(raw: bytes) -> tuple[list[str], bool]:
    """Texts that the bytes can be read as, and whether they are clean."""
    packed = _inflated(raw)
    data = raw if packed is None else packed
    try:
        text = data.decode()
        if not CONTROL.search(text):
            return [text] * bool(text), True
    except UnicodeDecodeError:
        pass
    found = [_stretches(data.decode("latin-1"))]
    if b"\0" in data:
        found += [_stretches(data.decode(c, "replace")) for c in ("utf-16-le", "utf-16-be")]
    return [f for f in found if f], False


def _opened(body: str) -> tuple[list[str] | None, bool]:
    """Texts inside a base64 stretch, None if it is too large to open; and whether they are clean."""
    body = body.rstrip("=").translate({45: "+", 95: "/"})
    if len(body) % 4 == 1:
        return [], False
    try:
        return _readable(base64.b64decode(body + "=" * (-len(body) % 4), validate=True))
    except binascii.Error:
        return [], False
    except _TooLarge:
        return None, False


def _wrapped(text: str) -> Iterator[tuple[str, int, int]]:
    """Base64 over several lines, joined: lines of one width (the first may be shorter) up to a shorter one, with and without that one."""
    for m in WRAPPED.finditer(text):
        lines = list(LINE.finditer(text, m.start(), m.end()))
        first = 0
        while first < len(lines) - 1:
            width, last = len(lines[first + 1][0]), first + 1
            while last + 1 < len(lines) and len(lines[last][0]) == width and len(lines[last + 1][0]) <= width:
                last += 1
            for end in {last, last - 1} - {first}:
                yield "".join(x[0] for x in lines[first:end + 1]), lines[first].start(), lines[end].end()
            first = last


def _base64(text: str) -> Iterator[tuple[str | None, int, int]]:
    """(decoded text, start, end); None for a stretch that is too large to open."""
    for body, start, end in _wrapped(text):
        for found in (None,) if (opened := _opened(body)[0]) is None else opened:
            yield found, start, end
    for m in BASE64.finditer(text):
        tries = [m] if BASE64_PART.fullmatch(m[0]) else [m, *BASE64_PART.finditer(text, m.start(), m.end())]
        for t in tries:
            opened, clean = _opened(t[0])
            for found in (None,) if opened is None else opened:
                yield found, t.start(), t.end()
            if opened is None or (clean and opened and t is m):
                break


def layers(text: str) -> Iterator[tuple[str, Place, int, int]]:
    """Layers one step below ``text``: their text, where a stretch of theirs lies in ``text``, and the stretch they cover."""
    for pattern, letters in ((PERCENT, _percent), (ESCAPE, _escape)):
        found = _unescaped(text, pattern, letters)
        if found:
            new, starts, ends = found
            yield new, lambda s, e, a=starts, b=ends: (a[s], b[e - 1]), 0, len(text)
    for new, start, end in _base64(text):
        yield new, lambda s, e, a=start, b=end: (a, b), start, end


def added_spans(text: str) -> set[Span]:
    """Spans that only decoding shows, by a worklist of layers with the places they come from."""
    out: set[Span] = set()
    seen = {(text, 0, len(text))}
    work: deque[tuple[str, list[Place]]] = deque([(text, [])])
    while work:
        layer, path = work.popleft()

        def home(s: int, e: int, path: list[Place] = path) -> tuple[int, int]:
            for place in reversed(path):
                s, e = place(s, e)
            return s, e

        if path:
            out |= {(home(s, e)[0], k, home(s, e)[1]) for s, k, e in base_spans(layer)}
        for new, place, start, end in layers(layer):
            start, end = home(start, end)
            if new is None:
                out.add((start, 3, end))
            elif (new, start, end) not in seen:
                seen.add((new, start, end))
                work.append((new, [*path, place]))
    return out


NAMES = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"akia"]
MARKS = [b"\\u", b"\\x", b"&#"]
_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True
_B64_BYTES = np.zeros(256, bool)
_B64_BYTES[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_")] = True
PERCENT_BYTES = re.compile(rb"%[0-9A-Fa-f]{2}")


def _rows_with_runs(block: W.Block, mask: np.ndarray, least: int) -> np.ndarray:
    """Rows where a run of such bytes is long enough (a run over the border of two texts may add a row)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask[block.data], [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    first = np.searchsorted(block.offsets, start[long], "right") - 1
    last = np.searchsorted(block.offsets, end[long], "left") - 1
    out = np.zeros(block.rows, bool)
    for a, b in zip(first.tolist(), last.tolist()):
        out[a:b + 1] = True
    return out


def suspects(block: W.Block) -> Iterator[bool]:
    """Whether a text can hold anything at all; the patterns run on these texts only."""
    runs = _rows_with_runs(block, _HEX_BYTES, 32) | _rows_with_runs(block, _B64_BYTES, SHORTEST)
    for i in range(block.rows):
        if runs[i]:
            yield True
            continue
        raw = block.text(i)
        low = raw.lower()
        yield any(n in low for n in NAMES) or any(n in raw for n in MARKS) or (b"%" in raw and bool(PERCENT_BYTES.search(raw)))


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), sorted by start, kind and end."""
    base = base_spans(text)
    return base, sorted({*base, *added_spans(text)})


def _each(column: pa.Array) -> Iterator[tuple[str, list[Span], list[Span]]]:
    for block in W.blocks(column):
        for i, look in enumerate(suspects(block)):
            if look:
                text = block.text(i).decode()
                yield text, *find(text)
            else:
                yield "", [], []


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            counts, shas, lists = [[], [], []], [], []
            for _, base, spans in _each(batch.column(1)):
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                shas.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                lists.append(_listed(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(lists, pa.string())], names=names)

    return own.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def hide(docs: DataFrame, text: str = "text", instead: str = "[SECRET]") -> DataFrame:
    """The rows and columns of ``docs``; each stretch of overlapping spans is replaced. Texts without finds stay as they are."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            at = names.index(text)
            old = batch.column(at)
            new = [_hidden(t, spans, instead) if spans else o for o, (t, _, spans) in zip(old.to_pylist(), _each(old))]
            yield pa.RecordBatch.from_arrays([pa.array(new, old.type) if k == at else batch.column(k) for k in range(len(names))], names=names)

    return docs.mapInArrow(run, docs.schema)


def _hidden(text: str, spans: list[Span], instead: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], instead]
        at = max(at, end)
    return "".join([*out, text[at:]])
