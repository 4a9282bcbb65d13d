"""Secret scanning: Aho-Corasick prefilter, anchored expressions near hits, embedded checksums.

One automaton finds the keywords in the lower-case text; a second one finds runs of 24 hexadecimal digits in a
copy of the text in which every such digit is the same symbol. Expressions run only at the places of hits and
never search. Both copies keep the positions of the text (one symbol per code point).

Base kinds (spans of the whole match, leftmost and non-overlapping per kind, code points, end exclusive):
``assign`` (keyword, separator, value of 6 or more), ``access`` (``AKIA`` and capitals or digits, 20 or more),
``hex`` (24 or more). The method adds tokens whose last six characters are the base-62 CRC-32 of their body
(``github``, ``npm``): these are reported only if the checksum holds.

Cases: a null text counts as empty and has no spans; repeated rows give repeated results; long texts are scanned
whole; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keywords and expressions of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_DIGITS = bytes(120 if chr(c) in "0123456789abcdef" else 46 for c in range(256))
_MACHINES: list = []


def checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32."""
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.rjust(6, "0")


def _automata():
    if not _MACHINES:
        import ahocorasick

        keys, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            keys.add_word(word, (len(word), kind))
        runs.add_word("x" * MIN_HEX, MIN_HEX)
        keys.make_automaton()
        runs.make_automaton()
        _MACHINES.extend([keys, runs])
    return _MACHINES


def _valid(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match.group(2)) >= MIN_VALUE
    if kind == "access":
        return match.end() - match.start() >= MIN_ACCESS
    return checksum(match.group(1)) == match.group(2)


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    keys, runs = _automata()
    plain = text.encode("latin-1", "replace")  # one byte per code point
    done = dict.fromkeys(KINDS, 0)
    found = []
    expressions = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}
    hits = sorted((end - size + 1, kind) for end, (size, kind) in keys.iter(plain.translate(_LOWER).decode("latin-1")))
    for start, kind in hits:
        if start >= done[kind] and (match := expressions[kind].match(text, start)):
            done[kind] = match.end()
            if _valid(kind, match):
                found.append((start, match.end(), kind))
    for end, size in runs.iter(plain.translate(_DIGITS).decode("latin-1")):
        if end >= done["hex"]:
            match = HEX.match(text, end - size + 1)
            done["hex"] = match.end()
            found.append((match.start(), match.end(), "hex"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans as text."""

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                spans = scan(value.as_py() or "")
                base = [s for s in spans if s[2] in BASE]
                rows.append((*(sum(s[2] == kind for s in base) for kind in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact_text(text: str | None) -> str | None:
    """The text with every span, overlapping ones together, replaced by ``[SECRET]``."""
    spans = scan(text or "")
    if not spans:
        return text
    out, place = [], 0
    for start, end, _ in spans:
        if start >= place:
            out += [text[place:start], "[SECRET]"]
        place = max(place, end)
    return "".join(out) + text[place:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All documents, with their columns; secrets in the text are replaced and the length follows."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(redact_text, na_action="ignore")

    out = docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
