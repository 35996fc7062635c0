"""Secret scans with a recursive decoding worklist.

Every text is scanned for the base patterns.  Then a worklist of *layers* is
worked off: in each layer, runs that can be decoded (percent escapes, Unicode
escapes, base64, and compressed bytes inside base64) are unwrapped into further
layers, each with a map from its characters to the span of the original text
that they stand for.  Each new layer is scanned and unwrapped in turn, until
nothing new appears.  A layer that was met before (by the digest of its
content) is not taken up again, so the work ends even when an encoding yields
itself.

Base64 is tried on each run of its letters as a whole.  A run that does not
decode so may hold a value beside words (``see/<base64>``, ``id_<base64>``): it is
decoded at each of the four places where a group of letters can begin, and every
stretch of readable text in the bytes is a layer, as is what unpacks from a gzip
or zlib header in them.  Runs that follow each other over line breaks are decoded
together in the same way, for what goes over a break.

Rows are independent: one pass over the table by Arrow batches, no shuffle.
``max_layer`` bounds the bytes that a task holds of what one compressed run
unpacks to; a run that unpacks to more is read in overlapping windows, and
counted in ``n_refused`` (refused as one layer).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from bisect import bisect_right
from collections import deque
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexlab.llm.common import batches

KINDS = ("assign", "access", "hex")  # fixed order of the contract

# Fixed patterns of the contract.
_KEY = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password") + "|" + "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 and more; a shorter run never matches

MAX_LAYER = 64 << 20

# an escaped escape sign, once or often, belongs to the escape behind it: a run is resolved to its fixpoint at once
_PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_PERCENT_ONE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_SLASH = r"\\(?:(?:u005[cC]|x5[cC]|U0000005[cC]|u\{0{0,4}5[cC]\})(?=[uUx]))*"
_ESCAPE = re.compile(rf"(?:{_SLASH}(?:u[0-9A-Fa-f]{{4}}|U[0-9A-Fa-f]{{8}}|x[0-9A-Fa-f]{{2}}|u\{{[0-9A-Fa-f]{{1,6}}\}}))+")
_ESCAPE_ONE = re.compile(rf"{_SLASH}(?:u([0-9A-Fa-f]{{4}})|U([0-9A-Fa-f]{{8}})|x([0-9A-Fa-f]{{2}})|u\{{([0-9A-Fa-f]{{1,6}})\}})")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
# a run of 16 letters and more, with the runs on the lines around it
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]+\r?\n[\x20\t]*)?[A-Za-z0-9+/_-]{16,}"
                     r"(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
# readable text of the length of the shortest match, in UTF-8
_STRETCH = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
                      rb"|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def scan(text: str) -> list[tuple[int, int, int]]:
    """Base matches: ``(start, kind, end)``, in order."""
    found = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                found.append((m.start(), 1, m.end()))
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end()))
    return sorted(found)


def _readable(data: bytes) -> str | None:
    """The bytes as text, if they are UTF-8 without control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and not _CONTROL.search(text) else None


def _is_packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0)


def _inflated(parts, most: int):
    """Bytes that gzip or zlib parts unpack to, in pieces of up to ``most``;
    members behind the first one are read on."""
    d, rest = None, b""
    try:
        for part in parts:
            data = rest + part
            while data or d:
                if d is None:
                    if len(data) < 3 or not _is_packed(data):
                        break
                    d = zlib.decompressobj(47)  # gzip or zlib by the header
                piece = d.decompress(data, most)
                if piece:
                    yield piece
                data = d.unused_data if d.eof else d.unconsumed_tail
                if d.eof:
                    d = None
                elif not piece and not data:
                    break
            rest = b"" if d else data
            if len(rest) > 2:
                return  # something else follows
    except zlib.error:
        return


def _unpacked(data: bytes, most: int):
    """Text inside gzip or zlib bytes (nested ones too); an iterator over
    overlapping windows of the bytes if they are more than ``most``; or None."""
    seen, rest, large = set(), iter(()), False
    while _is_packed(data):
        mark = hashlib.sha256(data).digest()
        if mark in seen:
            return None
        seen.add(mark)
        pieces, held, size = _inflated(chain((data,), rest), most), [], 0
        for piece in pieces:
            held.append(piece)
            size += len(piece)
            if size > most:
                break
        data, rest, large = b"".join(held), pieces, size > most
    return _windows(chain((data,), rest), min(1 << 20, most // 2)) if large else _readable(data)


def _windows(pieces, overlap: int):
    tail = b""
    for piece in pieces:
        window = tail + piece
        yield window
        tail = window[max(0, len(window) - overlap):]


def _open(data: bytes, most: int, start: int, end: int, out: list, seen: set) -> tuple[bool, int]:
    """Adds what ``data`` unpacks to to ``out``: its text, or, if it is more than
    ``most``, the kinds found in its windows and the number of layers in them.
    Whether there was any, and the number of packed runs that were that large."""
    got = _unpacked(data, most)
    if got is None:
        return False, 0
    if isinstance(got, str):
        out.append((got, start, end))
        return True, 0
    # of this run only: an equal run elsewhere has spans of its own; what is around it
    # stays known, so a run that yields itself ends
    kinds, layers, large, own = set(), 0, 1, set(seen)
    for window in got:
        for m in _STRETCH.finditer(window):
            mark = hashlib.sha256(m.group()).digest()
            if mark not in own:
                own.add(mark)
                _, every, n, more = find(m.group().decode("utf-8"), most, own)
                kinds.update(k for _, k, _ in every)
                layers, large = layers + 1 + n, large + more
    out.append(((kinds, layers), start, end))
    return True, large


def _percent_run(run: str) -> tuple[str, list[tuple[int, int]]]:
    """Characters of a run of percent escapes (UTF-8), and the span of each."""
    escapes = list(_PERCENT_ONE.finditer(run))
    data, text, spans, i = bytes(int(m.group(1), 16) for m in escapes), [], [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                text.append(data[i:i + n].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            text.append("\N{REPLACEMENT CHARACTER}")
        n = min(n, len(data) - i)
        spans.append((escapes[i].start(), escapes[i + n - 1].end()))
        i += n
    return "".join(text), spans


def _escape_run(run: str) -> tuple[str, list[tuple[int, int]]]:
    """Characters of a run of backslash escapes, and the span of each."""
    text, spans, units = [], [], []
    for m in _ESCAPE_ONE.finditer(run):
        units.append((int(m.group(m.lastindex), 16), m.start(), m.end()))
    i = 0
    while i < len(units):
        code, start, end = units[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
            code, end, i = 0x10000 + ((code - 0xD800) << 10) + units[i + 1][0] - 0xDC00, units[i + 1][2], i + 1
        text.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\N{REPLACEMENT CHARACTER}")
        spans.append((start, end))
        i += 1
    return "".join(text), spans


def _unescaped(text: str, pattern: re.Pattern, decode) -> tuple[str, array, array] | None:
    """The whole text with all runs of ``pattern`` decoded, and the start and
    end in ``text`` of each of its characters."""
    parts, start, end, at = [], array("q"), array("q"), 0
    for m in pattern.finditer(text):
        chars, spans = decode(m.group())
        parts += (text[at:m.start()], chars)
        start.extend(range(at, m.start()))
        end.extend(range(at + 1, m.start() + 1))
        start.extend(m.start() + a for a, _ in spans)
        end.extend(m.start() + b for _, b in spans)
        at = m.end()
    if not parts:
        return None
    parts.append(text[at:])
    start.extend(range(at, len(text)))
    end.extend(range(at + 1, len(text) + 1))
    return "".join(parts), start, end


def _plain(run: str) -> bool:
    return run.isalpha() and (run.islower() or run.isupper() or run.istitle())


def _bytes(run: str) -> bytes:
    """The bytes of base64 letters of either alphabet; a last letter that gives none is left out."""
    run = run[:-1] if len(run) % 4 == 1 else run
    return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))


def _parts(runs: list[tuple[int, int, str]], most: int, out: list, begun: set, seen: set) -> int:
    """Adds to ``out`` the layers that begin anywhere in runs that stand together
    (start, end and letters of each); of several runs, those that reach over a
    line break.  There a character stands for the run or runs that it is in.
    The number of packed runs of more than ``most`` is returned."""
    letters = "".join(r for _, _, r in runs)
    if _plain(letters):
        return 0
    ends = list(accumulate(len(r) for _, _, r in runs))
    refused = 0

    def run_of(offset: int, last: bool) -> int:  # of the first or last letter of a byte
        return bisect_right(ends, at + offset // 3 * 4 + offset % 3 + last)

    for at in range(4):
        data = _bytes(letters[at:])
        packed = [m.start() for m in _PACKED.finditer(data) if m.start() % 3 == 0]
        for o in packed:
            i = run_of(o, False)
            if len(runs) == 1:
                refused += _open(data[o:], most, runs[0][0] + at + o // 3 * 4, runs[0][1], out, seen)[1]
            elif i < len(runs) - 1:
                got, no = _open(data[o:], most, runs[i][0], runs[-1][1], out, seen)
                refused += no
                if got:
                    begun.add(i)
        for m in _STRETCH.finditer(data):
            decoded = m.group().decode("utf-8")
            first, last = run_of(m.start(), False), run_of(m.end() - 1, True)
            if len(runs) == 1:
                begin, end = runs[0][0] + at + m.start() // 3 * 4 + m.start() % 3, at + (m.end() - 1) // 3 * 4 + (m.end() - 1) % 3 + 2
                out.append((decoded, begin, runs[0][1] if end >= ends[0] else runs[0][0] + end))
            elif first < last:
                start, end, o = array("q"), array("q"), m.start()
                for c in decoded:
                    n = len(c.encode("utf-8"))
                    start.append(runs[run_of(o, False)][0])
                    end.append(runs[run_of(o + n - 1, True)][1])
                    o += n
                out.append((decoded, start, end))
    return refused


def _below(text: str, most: int, seen: set):
    """Layers one step below ``text``: ``(decoded, starts, ends)`` with the span
    in ``text`` of each character; base64 stands as a whole for each character in
    it.  And the number of packed runs of more than ``most``."""
    out, refused = [], 0
    for mark, pattern, decode in (("%", _PERCENT, _percent_run), ("\\", _ESCAPE, _escape_run)):
        if mark in text and (got := _unescaped(text, pattern, decode)):
            out.append(got)
    for m in _BASE64.finditer(text):
        runs = [(r.start(), r.end(), r.group().rstrip("=")) for r in _RUN.finditer(text, m.start(), m.end())]
        begun = set()  # runs in which packed bytes begin that go on behind a line break
        if len(runs) > 1:
            refused += _parts(runs, most, out, begun, seen)
        for i, (start, end, run) in enumerate(runs):
            if len(run) < 16 or i in begun or _plain(run):
                continue
            if len(run) % 4 != 1:
                got, no = _open(_bytes(run), most, start, end, out, seen)
                refused += no
                if got:
                    continue
            refused += _parts([(start, end, run)], most, out, begun, seen)
    return out, refused


def find(text: str, max_layer: int = MAX_LAYER, seen: set | None = None) -> tuple[list, list, int, int]:
    """``(base, all, layers, refused)`` of one text; spans are
    ``(start, kind, end)`` in the text's own code points."""
    base = scan(text)
    found, seen = set(base), set() if seen is None else seen
    # a layer: its text, and start and end in the original of its characters
    # (two arrays; two numbers if all stand for one span; None: the original)
    work, n_layers, refused = deque([(text, None, None)]), 0, 0
    while work:
        layer, first, last = work.popleft()
        below, no = _below(layer, max_layer, seen)
        refused += no
        for decoded, start, end in below:
            if isinstance(first, int):
                start, end = first, last
            elif first is not None and isinstance(start, int):
                start, end = first[start], last[end - 1]
            elif first is not None:
                start, end = array("q", (first[a] for a in start)), array("q", (last[b - 1] for b in end))
            whole = isinstance(start, int)
            if isinstance(decoded, tuple):
                found.update((start, kind, end) for kind in decoded[0])
                n_layers += decoded[1]
                continue
            mark = hashlib.sha256(f"{start if whole else ''}:{end if whole else ''}:".encode()
                                  + decoded.encode("utf-8", "surrogatepass")).digest()
            if mark in seen:
                continue
            seen.add(mark)
            n_layers += 1
            found.update((start, kind, end) if whole else (start[a], kind, end[b - 1]) for a, kind, b in scan(decoded))
            work.append((decoded, start, end))
    return base, sorted(found), n_layers, refused


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", max_layer: int = MAX_LAYER) -> DataFrame:
    """One row per row of ``docs``: ``key``, base counts by kind, ``base`` and
    ``spans`` (``kind:start:end`` by start, then kind, comma-joined; code
    points, end exclusive), ``n_layers`` unwrapped and ``n_refused``.

    Null and empty texts have no spans; repeated rows and null keys each give
    their row; other columns are ignored; an empty table gives an empty result.
    """
    src = docs.select(key, text)
    schema = T.StructType([src.schema[key]] + [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")]
                          + [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()),
                             T.StructField("n_layers", T.LongType()), T.StructField("n_refused", T.LongType())])
    names = schema.names

    def run(frames):
        for batch in batches(frames):
            rows = []
            for body in batch.column(1):
                base, every, layers, refused = find(body.as_py() or "", max_layer)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, joined(base), joined(every), layers, refused))
            cols = list(zip(*rows))
            arrays = [batch.column(0)] + [pa.array(c, pa.string() if names[i + 1] in ("base", "spans") else pa.int64())
                                          for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return src.mapInArrow(run, schema)
