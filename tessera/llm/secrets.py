"""Secret scans: rule spans, and spans found by dictionary-primed zstandard novelty."""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: All that may be secret is made of these characters; hex and access matches lie within such a string.
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: A sensitive word; the rest of its line and the next line are its context.
_WORD = re.compile(r"passw|passphrase|pwd|secret|token|credential|auth|bearer|api.?key|access.?key|private.?key|signing|webhook|client.?id", re.I | re.A)
#: What a value stands behind in code, configuration and addresses with credentials.
_VALUE = re.compile(r"(?:[=:]\x20?[\"'`]?|[\"'`(<>,]|//[\w.-]{1,64}:)\Z")

#: Identifiers and values of ordinary code, before those of the corpus; a string made of these is no secret.
IDENTIFIERS = (
    "access_token refresh_token client_secret client_id api_key apikey password passwd username authorization bearer "
    "example placeholder changeme your-api-key-here xxxxxxxxxxxxxxxx undefined function return import export default "
    "configuration environment variable settings production development staging localhost application service request "
    "response session cookie header content-type application/json https://www.example.com/path/to/resource index.html "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000-0000-0000-0000-000000000000 "
)


def identifiers(docs: DataFrame, least: int = 3, most: int = 2048) -> str:
    """IDENTIFIERS and the corpus's own: of all strings of 8 to 40 letters, digits, _ and - that begin with a letter or _
    and are in `least` documents or more, the `most` that most documents have (ties by code point), most common last.

    Counted by Spark over all whole texts; a dictionary of at most 41 * `most` characters comes back, at every size.
    """
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_-])[A-Za-z_][A-Za-z0-9_-]{7,39}(?![A-Za-z0-9_-])"), F.lit(0)))).alias("w"))
    top = each.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(most)
    return IDENTIFIERS + " ".join(r["w"] for r in reversed(top.collect())) + " "


class Novelty:
    """Marginal compressed bits a character of a string beyond a dictionary and its surroundings."""

    def __init__(self, known: str = IDENTIFIERS):
        self.prime = zstandard.ZstdCompressionDict(known.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.prime.precompute_compress(level=19)
        self.make = zstandard.ZstdCompressor(level=19, dict_data=self.prime, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, candidate: str, before: str, after: str) -> float:
        """What is known leads the surroundings, so that the candidate doesn't pay for the first match of a block."""
        lead = f"{IDENTIFIERS[:64]}{after} {before} ".encode("utf-8", "replace")
        return 8.0 * (len(self.make.compress(lead + candidate.encode())) - len(self.make.compress(lead))) / len(candidate)


def jumbled(word: str) -> bool:
    """Do capitals, small letters and digits all occur, and change in 40 % of places or more, as in no made-up name?"""
    kind = ["A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "." for c in word]
    return {"A", "a", "0"} <= set(kind) and sum(x != y for x, y in zip(kind, kind[1:])) >= 0.4 * (len(kind) - 1)


def contexts(text: str) -> list[tuple[int, int]]:
    """Stretches that follow a sensitive word on its line and the next line, in order and apart."""
    out: list[tuple[int, int]] = []
    done = 0
    for m in _WORD.finditer(text):
        end = len(text)
        if (line := text.find("\n", m.end())) >= 0 and (line := text.find("\n", line + 1)) >= 0:
            end = line
        if end > done:
            out.append((max(done, m.end()), end))
            done = end
    return out


def scan(text: str | None, novelty: Novelty, least_bits: float = 4.6, value_bits: float = 5.2, around: int = 256) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, by start, then kind as in KINDS.

    assign, access and hex are rules. All strings of 16 or more token characters with letters and digits that no rule
    span overlaps are candidates in two contexts: behind a sensitive word on its line or on the next line, or, with 20
    or more characters and jumbled(), where a value stands (behind =, :, a quote, a bracket, or a user name of an
    address). One that costs at least `least_bits` a character (in the second context `value_bits`) beyond dictionary and
    surroundings is novel. Letters alone aren't measured: a long word costs as much. Null or empty: none.
    """
    if not text:
        return []
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    words = [m.span() for m in _TOKEN.finditer(text)]
    for s, e in words:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text, s, e)]
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text, s, e)]
    if words:
        base, near = list(out), None
        for s, e in words:
            word = text[s:e]
            if not re.search("[0-9]", word) or not re.search("[A-Za-z]", word) or any(a < e and s < b for a, b, _ in base):
                continue
            near = contexts(text) if near is None else near
            bits = least_bits if any(a <= s and e <= b for a, b in near) else None
            if bits is None and e - s >= 20 and jumbled(word) and _VALUE.search(text[max(0, s - 72):s]):
                bits = value_bits
            if bits is not None and novelty(word, text[max(0, s - around):s], text[e:e + around]) >= bits:
                out.append((s, e, "novel"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find(docs: DataFrame, known: str | None = None, least_bits: float = 4.6, value_bits: float = 5.2) -> DataFrame:
    """docs(doc_id, text) to doc_id, spans array<struct<start, end, kind>>: one row per row, an empty array if none.

    The dictionary is counted first (see identifiers()) unless `known` gives one; then a narrow map: one Arrow pass over
    whole texts, no shuffle. Null text counts as empty; repeated rows are separate; other columns are not read.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    known = identifiers(docs) if known is None else known

    def run(batches):
        novelty = Novelty(known)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                rows = [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t.as_py(), novelty, least_bits, value_bits)] for t in part.column("text")]
                yield pa.record_batch([part.column("doc_id"), pa.array(rows, span)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")
