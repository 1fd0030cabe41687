"""Secrets: known patterns, and strings in a sensitive context that a primed compressor finds new.

Candidates are what the base patterns match, and long strings of key characters that follow a sensitive name. For each, the
marginal compressed bytes are measured: zstandard is primed with a dictionary of identifiers and code idioms, and compresses
the surrounding text with and without the candidate. A candidate that costs nearly as many bits for each character as a
random one is incompressible. Base matches always stay; other candidates are reported if they are incompressible.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

# The base patterns, in the order in which spans of one start are listed. Letters of the names in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs of AKIA[A-Z0-9]+ of 20+ characters; a shorter match holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

CONTEXT = re.compile(
    r"""(?:passphrase|pwd|credentials?|private_?key|access_?key|secret_?key|auth(?:orization)?|bearer|signature|session_?id|client_?secret|conn(?:ection)?_?str(?:ing)?)["']?\x20*(?:[:=]|\x20)\x20*["']?(?:(?:basic|bearer)\x20+)?([A-Za-z0-9+/_=.~-]{16,})""",
    re.ASCII | re.IGNORECASE,
)
HINTS = ("pass", "secret", "token", "api", "akia")
MORE_HINTS = ("passphrase", "pwd", "credential", "private", "access", "secret", "auth", "bearer", "signature", "session", "conn")  # one in each name of CONTEXT

# What code and settings around a secret are made of; primes the compressor.
IDENTIFIERS = """
authorization bearer basic client_id client_secret access_token refresh_token api_key apikey secret_key private_key public_key password
passwd passphrase credential credentials username user_name session_id sessionid signature connection_string database_url endpoint
https://www. http:// localhost 127.0.0.1 example.com config.get os.environ process.env System.getenv import from return function const
var let public static final void string int boolean true false null none undefined self this class def lambda async await export default
placeholder changeme your_token_here your-api-key-here xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ example_value not_a_real_secret test_token dummy_password sample_key path/to/file some_identifier_name
 = " : " => ' == != () {} [] ; , the and for with that this from are was is of to in on by be as at it
"""


@dataclass(frozen=True)
class Novelty:
    """surround: characters of context on each side; least_bits: marginal bits for each character that count as incompressible."""

    surround: int = 160
    least_bits: float = 3.2
    least_length: int = 16
    level: int = 3


class _Meter:
    def __init__(self, how: Novelty):
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.how, self.zstd = how, zstandard.ZstdCompressor(level=how.level, dict_data=primed, write_content_size=False, write_checksum=False)

    def bits(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bits for each character of text[start:end]."""
        before, after = text[max(0, start - self.how.surround) : start].encode(), text[end : end + self.how.surround].encode()
        found = text[start:end].encode()
        more = len(self.zstd.compress(before + after + b"\n" + found)) - len(self.zstd.compress(before + after + b"\n"))
        return 8 * max(0, more) / max(1, len(found))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; leftmost non-overlapping matches of each kind, failing ones dropped."""
    low, out = text.lower(), []
    if any(h in low for h in HINTS[:4]):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan_text(text: str, meter: _Meter) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[float]]:
    """Base spans, all spans, and the bits of all spans. A novel span overlaps no base span."""
    base = base_spans(text)
    found = [(s, k, e, meter.bits(text, s, e)) for s, k, e in base]
    low = text.lower()
    if any(h in low for h in MORE_HINTS):
        for m in CONTEXT.finditer(text):
            s, e = m.span(1)
            found_here = m[1]
            mixed = any(c.isdigit() for c in found_here) and any(c.isalpha() for c in found_here)
            if mixed and e - s >= meter.how.least_length and not any(s < be and bs < e for bs, _, be in base):
                b = meter.bits(text, s, e)
                if b >= meter.how.least_bits:
                    found.append((s, 3, e, b))
    found.sort()
    return base, [x[:3] for x in found], [x[3] for x in found]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(how: Novelty):
    schema = pa.schema([("id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("bits", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = _Meter(how)
        for ids, texts in rows_of(batches):
            rows = []
            for i, text in zip(ids, texts, strict=True):
                base, spans, bits = scan_text(text or "", meter)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)] + [len(spans) - len(base)]
                rows.append((i, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), bits))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Novelty | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_novel, base_sha256, spans, bits) for each row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. A null text counts as empty; an empty text
    has no spans, and base_sha256 is that of the empty string. Rows that repeat an id and null ids come back one by one. An
    empty table gives an empty result.
    """
    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = two.mapInArrow(_scan(how or Novelty()), "id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, bits array<double>")
    return out.withColumnRenamed("id", id_col)


def masked(text: str, meter: _Meter, mark: str = "[SECRET]") -> str:
    """text with each span, or each run of overlapping spans, replaced by mark."""
    merged: list[list[int]] = []
    for s, _, e in scan_text(text, meter)[1]:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    for s, e in reversed(merged):
        text = text[:s] + mark + text[e:]
    return text


def mask(docs: DataFrame, text_col: str = "text", how: Novelty | None = None) -> DataFrame:
    """docs with every reported span of the texts replaced by [SECRET]. Null texts stay null; other columns stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = _Meter(how or Novelty())
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [None if t is None else masked(t, meter) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
