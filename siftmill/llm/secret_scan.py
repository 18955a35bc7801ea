"""Secrets in whole texts: fixed patterns, and strings that nothing around them explains.

Three base kinds (assign, access, hex) are plain patterns. The method adds the kind `novel`: every
long token that follows a sensitive word, and the body of every private key block, is a candidate; it
is compressed with zstandard after a raw dictionary made of common identifiers and of the text around
it, and the bytes it adds are compared with its length. Words, identifiers and paths of the
surroundings are in the dictionary and add little; a key or a password adds nearly its own length and
is reported. Long strings over few letters (digits, hex, base32) cost less than their length however
random they are: they are compared with what their own letters cost in random order and without any
dictionary. Where the same string is a candidate more than once, its other places are taken out of
the text around it.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import map_batches, table_of, whole_texts

# The base patterns, the shortest matches that count, the order of kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGNED = 6
KINDS = ("assign", "access", "hex", "novel")

# Sensitive words of the method; a candidate starts within REACH characters after one, same line.
SENSITIVE = (
    "password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key",
    "access_key", "access key", "accesskey", "private key", "private_key", "credential", "bearer",
    "authorization", "client_id", "signature", "webhook",
)
REACH = 64
SHORTEST = 16
# Added bytes per character from which a candidate counts as unexplained.
NOVELTY = 0.7
# Share of the bytes its shuffled letters cost alone from which a long candidate counts as random, and
# the added bytes below which nothing does: a run of one letter costs as much shuffled.
RANDOMNESS = 0.9
FEWEST_BYTES = 16
# Characters of the text on either side that serve as its dictionary.
AROUND = 4096
_CONTEXT = re.compile("|".join(map(re.escape, SENSITIVE)), re.ASCII | re.IGNORECASE)
_CANDIDATE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_=.~-]{%d,}" % (SHORTEST - 1))
# A private key block: its head, header lines and the lines of its body, whose ends may be written as
# escapes. No part gives back what it took, so a text is read once.
_BREAK = r"(?:\s|\\[nr])"
_BLOCK = re.compile(
    r"-----BEGIN (?:[A-Z0-9]{1,16} ){0,4}PRIVATE KEY(?: BLOCK)?-----" + _BREAK + r"*+"
    r"(?:[A-Za-z][A-Za-z-]{0,30}: [^\n]{0,200}\n" + _BREAK + r"*+){0,8}+"
    r"([A-Za-z0-9+/=]{16,}+(?:" + _BREAK + r"++[A-Za-z0-9+/=]{16,}+)*+"
    r"(?:" + _BREAK + r"++[A-Za-z0-9+/=]{1,15}+(?=" + _BREAK + r"*+-----END))?)"
)
_GATE = ("passw", "secret", "token", "key", "passphrase", "pwd", "credential", "bearer", "auth",
         "client_id", "signature", "webhook")
IDENTIFIERS = (
    "import include define public private static class return function const struct string number "
    "integer boolean default value values config configuration settings environment variable "
    "username password passwd passphrase secret token access_token refresh_token api_key apikey "
    "client_id client_secret private_key public_key credential credentials authorization bearer "
    "signature certificate session cookie header request response endpoint service account "
    "database connection host port user admin root localhost example placeholder changeme test "
    "http:// https:// www. .com .org .net /usr/local/bin /home/user /var/lib /etc/ .json .yaml "
    "getenv environ process.env os.environ System.getProperty null none undefined true false "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890 xxxxxxxxxxxxxxxx"
)
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("n_novel", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
])
Span = tuple[int, str, int]


def base_spans(text: str, low: str | None = None) -> list[Span]:
    """(start, kind, end) of the three base kinds."""
    low = text.lower() if low is None else low
    found = []
    if any(w in low for w in ("passw", "secret", "token", "key")):
        found += [
            (m.start(), "assign", m.end()) for m in ASSIGN.finditer(text)
            if len(m.group(2)) >= ASSIGNED
        ]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def added_bytes(candidate: str, around: str) -> int:
    """Bytes that `candidate` adds after the identifiers and the text around it.

    What the frame itself costs, measured on the empty string, is taken off.
    """
    known = f"{IDENTIFIERS} {around}".encode()
    primed = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(
        level=19, dict_data=primed, write_checksum=False, write_content_size=False,
        write_dict_id=False,
    )
    return len(press.compress(candidate.encode())) - len(press.compress(b""))


def shuffled_bytes(candidate: str) -> int:
    """Bytes of the candidate's letters in a fixed random order, without a dictionary."""
    letters = list(candidate)
    random.Random(len(letters)).shuffle(letters)
    press = zstandard.ZstdCompressor(level=19, write_checksum=False, write_content_size=False)
    return len(press.compress("".join(letters).encode())) - len(press.compress(b""))


def is_novel(candidate: str, around: str) -> bool:
    """Whether neither the identifiers nor the text around explain the candidate."""
    added = added_bytes(candidate, around)
    if added >= NOVELTY * len(candidate):
        return True
    return added >= FEWEST_BYTES and added >= RANDOMNESS * shuffled_bytes(candidate)


def novel_spans(text: str, low: str | None = None) -> list[Span]:
    """Candidates that their surroundings do not explain: long tokens after a sensitive word on its
    line, and bodies of private key blocks."""
    low = text.lower() if low is None else low
    if not any(w in low for w in _GATE):
        return []
    found: dict[tuple[int, int], None] = {}
    for word in _CONTEXT.finditer(text):
        stop = text.find("\n", word.end())
        stop = min(word.end() + REACH, stop if stop >= 0 else len(text))
        at = word.end()
        # Behind this place no candidate's shortest form starts in reach; a long one is read on.
        last = stop + SHORTEST - 1
        while at < stop and (m := _CANDIDATE.search(text, at, last)):
            at = _CANDIDATE.match(text, m.start()).end()
            found[m.start(), at] = None
    if "PRIVATE KEY" in text:
        found.update(dict.fromkeys(m.span(1) for m in _BLOCK.finditer(text)))
    places: dict[str, list[tuple[int, int]]] = {}
    for start, end in found:
        places.setdefault(text[start:end], []).append((start, end))
    for same in places.values():
        same.sort()
    made = []
    for start, end in found:
        candidate = text[start:end]
        before, after = max(0, start - AROUND), end + AROUND
        # A secret that stands twice must not explain itself.
        same = places[candidate]
        first = bisect_right(same, (before - len(candidate), len(text)))
        others = same[first:bisect_left(same, (after, 0))]
        around = _without(text, before, after, others)
        if is_novel(candidate, around):
            made.append((start, "novel", end))
    return made


def _without(text: str, start: int, end: int, places: list[tuple[int, int]]) -> str:
    """text[start:end] with a blank for each of the `places`, which are in order."""
    made = []
    for a, b in places:
        made.append(text[start:max(a, start)])
        start = b
    return " ".join([*made, text[start:max(end, start)]])


def _joined(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in order)


def scan(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) for every row.

    Spans are kind:start:end in code points by start and kind. Null texts count as empty: no spans
    and the digest of the empty string. Repeated rows and null ids stay; no rows give no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = {n: [] for n in _SCHEMA.names[1:]}
        for t in batch.column("text").to_pylist():
            low = t.lower()
            base = base_spans(t, low)
            added = novel_spans(t, low)
            kinds = [k for _, k, _ in base]
            rows["n_assign"].append(kinds.count("assign"))
            rows["n_access"].append(kinds.count("access"))
            rows["n_hex"].append(kinds.count("hex"))
            rows["n_novel"].append(len(added))
            rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            rows["spans"].append(_joined(base + added))
        return table_of({"doc_id": batch.column("doc_id"), **rows}, _SCHEMA)

    return map_batches(
        whole_texts(docs, ident, text), run,
        "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, "
        "spans string",
    )


def masked(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones joined, replaced by `mark`."""
    low = text.lower()
    spans = sorted((a, b) for a, _, b in base_spans(text, low) + novel_spans(text, low))
    made, end = [], 0
    for a, b in spans:
        if a >= end:
            made += [text[end:a], mark]
        end = max(end, b)
    return "".join([*made, text[end:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """`docs` with secrets masked in `text`; null texts stay null, all other columns and rows stay.

    `length` names a column with the number of characters; it is renewed where the text changed.
    """
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column(text).to_pylist()
        new = [None if t is None else masked(t) for t in old]
        columns = {n: batch.column(n) for n in names}
        columns[text] = pa.array(new, batch.schema.field(text).type)
        if length in names:
            kind = batch.schema.field(length).type
            sizes = [
                n if a == b else len(b)
                for n, a, b in zip(batch.column(length).to_pylist(), old, new, strict=True)
            ]
            columns[length] = pa.array(sizes, kind)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    # Only the schema's names and types count here; the rows come from the batches.
    return map_batches(docs.select(*[F.col(f"`{n}`") for n in names]), run, docs.schema)
